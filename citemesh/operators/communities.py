"""Static and dynamic communities. A cluster is a (year, cluster) group; similarities are in long form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cluster_label, cosine
from .storage import SMALL, TASK_ROWS, forget, small_parts, stored


def centroid(df: DataFrame, keys: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """(keys, embedding, embedding_std): element-wise (weighted) mean and population deviation."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(*keys, w.alias("__w"), F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    g = rows.groupBy(*keys, "pos").agg((F.sum(F.col("x") * F.col("__w")) / F.sum("__w")).alias("mean"), F.stddev_pop("x").alias("std"))
    whole = g.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("__l"))
    return whole.select(*keys, F.transform("__l", lambda x: x["mean"]).alias("embedding"), F.transform("__l", lambda x: x["std"]).alias("embedding_std"))


def cluster_table(members: DataFrame, year: str = "year", cluster: str = "cluster", vector: str = "embedding") -> DataFrame:
    """A row for each cluster and year: size, centroid, deviation and label. All years in one pass."""
    size = members.groupBy(year, cluster).agg(F.count("*").alias("size"))
    return size.join(centroid(members, [year, cluster], vector), [year, cluster]).withColumn("c_t_label", cluster_label(F.col(cluster), F.col(year)))


def similarity_cosine(clusters: DataFrame) -> DataFrame:
    """(year, c_t, c_t1, score): clusters of a year against those of the next."""
    a = clusters.select((F.col("year") + 1).alias("year"), F.col("cluster").alias("c_t"), F.col("embedding").alias("ea"))
    b = clusters.select("year", F.col("cluster").alias("c_t1"), F.col("embedding").alias("eb"))
    return a.join(b, "year").select("year", "c_t", "c_t1", cosine("ea", "eb").alias("score")).filter("score is not null")


def overlap_jaccard(left: DataFrame, right: DataFrame, member: str, a: str, b: str) -> DataFrame:
    """(a, b, score > 0): Jaccard of member sets by an equi-join on the member; pairs without a common
    member are 0 and left out."""
    l, r = left.select(a, member).distinct(), right.select(b, member).distinct()
    na, nb = l.groupBy(a).agg(F.count("*").alias("na")), r.groupBy(b).agg(F.count("*").alias("nb"))
    both = l.join(r, member).groupBy(a, b).agg(F.count("*").alias("n"))
    return both.join(na, a).join(nb, b).select(a, b, (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("score"))


def similarity_members(members: DataFrame, member: str = "paper_id") -> DataFrame:
    """(year, c_t, c_t1, score) by shared members; pairs without any are left out."""
    one = members.select((F.col("year") + 1).alias("year"), F.col("cluster").alias("c_t"), member)
    two = members.select("year", F.col("cluster").alias("c_t1"), member)
    na, nb = one.groupBy("year", "c_t").agg(F.count_distinct(member).alias("na")), two.groupBy("year", "c_t1").agg(F.count_distinct(member).alias("nb"))
    n = one.distinct().join(two.distinct(), ["year", member]).groupBy("year", "c_t", "c_t1").agg(F.count("*").alias("n"))
    return n.join(na, ["year", "c_t"]).join(nb, ["year", "c_t1"]).select("year", "c_t", "c_t1", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("score"))


class Events:
    """Community events from similarities. `year` is that of t+1; c_t and c_t1 are arrays of labels."""

    def __init__(self, clusters: DataFrame, similarity: DataFrame, threshold: float, size_threshold: float = 0.1):
        similarity = stored(similarity.select("year", "c_t", "c_t1", "score"))
        years = similarity.select("year").distinct()
        lab = lambda c, y: cluster_label(F.col(c), y)
        matches = similarity.filter(F.col("score") >= threshold)
        self.matches = stored(matches.select("year", lab("c_t", F.col("year") - 1).alias("c_t"), lab("c_t1", F.col("year")).alias("c_t1")))  # five kinds of events read it
        named = stored(clusters.select("year", "size", lab("cluster", F.col("year")).alias("label")))
        self.before = named.select((F.col("year") + 1).alias("year"), F.col("label").alias("c_t"), F.col("size").alias("size_t")).join(F.broadcast(years), "year")  # a row for each year
        self.after = named.select("year", F.col("label").alias("c_t1"), F.col("size").alias("size_t1")).join(F.broadcast(years), "year")
        self.theta = size_threshold

    def merges(self) -> DataFrame:
        g = self.matches.groupBy("year", "c_t1").agg(F.array_sort(F.collect_list("c_t")).alias("c_t")).filter("size(c_t) >= 2")
        return g.select("year", "c_t", F.array("c_t1").alias("c_t1"), F.lit("merge").alias("event_type"))

    def splits(self) -> DataFrame:
        g = self.matches.groupBy("year", "c_t").agg(F.array_sort(F.collect_list("c_t1")).alias("c_t1")).filter("size(c_t1) >= 2")
        return g.select("year", F.array("c_t").alias("c_t"), "c_t1", F.lit("split").alias("event_type"))

    def births(self) -> DataFrame:
        new = self.after.join(self.matches, ["year", "c_t1"], "left_anti")
        return new.select("year", F.lit(None).cast("array<string>").alias("c_t"), F.array("c_t1").alias("c_t1"), F.lit("birth").alias("event_type"))

    def deaths(self) -> DataFrame:
        gone = self.before.join(self.matches, ["year", "c_t"], "left_anti")
        return gone.select("year", F.array("c_t").alias("c_t"), F.lit(None).cast("array<string>").alias("c_t1"), F.lit("death").alias("event_type"))

    def continuations(self) -> DataFrame:
        """Exactly one match, in no other event; growth by the threshold is expansion, loss contraction."""
        one = self.matches.groupBy("year", "c_t").agg(F.count("*").alias("n"), F.max("c_t1").alias("c_t1")).filter("n = 1")
        taken = self.merges().select("year", F.explode("c_t").alias("c_t")).union(self.splits().select("year", F.explode("c_t")))
        rest = one.join(taken, ["year", "c_t"], "left_anti").join(self.before, ["year", "c_t"], "left").join(self.after, ["year", "c_t1"], "left")
        kind = F.when(F.col("size_t") * (1 - F.lit(self.theta)) >= F.col("size_t1"), "contraction").when(F.col("size_t") * (1 + F.lit(self.theta)) <= F.col("size_t1"), "expansion").otherwise("continuation")
        return rest.select("year", F.array("c_t").alias("c_t"), F.array("c_t1").alias("c_t1"), kind.alias("event_type"))

    def all(self) -> DataFrame:
        return self.merges().unionByName(self.splits()).unionByName(self.births()).unionByName(self.deaths()).unionByName(self.continuations())

    def missing(self) -> DataFrame:
        """Labels in no event; empty if the table is complete."""
        e = self.all()
        there = e.select(F.explode("c_t").alias("label")).union(e.select(F.explode("c_t1")))
        every = self.before.select(F.col("c_t").alias("label")).union(self.after.select("c_t1"))
        return every.distinct().join(there, "label", "left_anti")

    def check(self) -> DataFrame:
        e = self.all()
        if e.isEmpty():
            raise ValueError("no community events")
        if not self.missing().isEmpty():
            raise ValueError("clusters without an event")
        return e

    def edges(self) -> DataFrame:
        """(src, dst, type): exploded events between clusters."""
        kinds = {"continuation": "CONTINUES_AS", "expansion": "CONTINUES_AS", "contraction": "CONTINUES_AS", "split": "SPLITS_INTO", "merge": "MERGES_INTO"}
        flat = self.all().select("year", "event_type", F.explode_outer("c_t").alias("src"), "c_t1").select("year", "event_type", "src", F.explode_outer("c_t1").alias("dst"))
        type_of = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
        return flat.filter("src is not null and dst is not null").select("year", "src", "dst", type_of[F.col("event_type")].alias("type"))

    def flags(self) -> DataFrame:
        """(label, born, died) of all clusters."""
        e = self.all()
        born = e.filter("event_type = 'birth'").select(F.explode("c_t1").alias("label"), F.lit(True).alias("b")).distinct()
        died = e.filter("event_type = 'death'").select(F.explode("c_t").alias("label"), F.lit(True).alias("d")).distinct()
        every = self.before.select(F.col("c_t").alias("label")).union(self.after.select("c_t1")).distinct()
        out = every.join(born, "label", "left").join(died, "label", "left")
        return out.select("label", F.coalesce("b", F.lit(False)).alias("born"), F.coalesce("d", F.lit(False)).alias("died"))


def noise_to_cluster(noise: DataFrame, clusters: DataFrame, key: str, vector: str = "embedding", part: int = SMALL) -> DataFrame:
    """(key, cluster, similarity): each noise row's nearest centroid; ties go to the smallest cluster.
    Centroids are broadcast, a bounded part at a time; each part leaves a row's best of it."""
    found = None
    rows = noise.select(key, F.col(vector).alias("__v"))
    of = lambda d: d.groupBy(key).agg(F.max(F.struct("similarity", "c")).alias("m")).select(key, "m.similarity", "m.c")
    for c in small_parts(clusters.select("cluster", F.col("embedding").alias("__c")), rows=part):
        s = rows.crossJoin(c).select(key, cosine("__v", "__c").alias("similarity"), (-F.col("cluster")).alias("c"))  # rows against bounded centroids
        best = stored(of(s))
        found = best if found is None else found.union(best)
    return of(found).select(key, (-F.col("c")).alias("cluster"), "similarity")


def event_matrix(events: DataFrame, features: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """Counts of event kinds for each cluster, joined to its features (clusters without events keep zeros)."""
    n = events.groupBy(key).pivot("event_type", kinds).count()
    return features.join(n, key, "left").na.fill(0, kinds)


def event_matrix_with_deaths(pairs: DataFrame, features: DataFrame | None = None, kinds: tuple[str, ...] = ("SPLITS_INTO", "MERGES_INTO", "CONTINUES_AS", "DIES")) -> DataFrame:
    """(key, a count for each kind, features): pairs(t1, year1, born1, died1, event_type, t2, born2, died2)
    are clusters and, if any, what becomes of them. A death is a row of its own: of t1 where it was born and
    died at once, or died in the first year; of t2 where that died. Each cluster dies once. Clusters without
    any event have no row; those without features keep their counts."""
    first = pairs.agg(F.min("year1").alias("__first"))  # one row
    p = pairs.crossJoin(F.broadcast(first))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    dead = p.filter((yes("born1") & yes("died1")) | yes("died2") | (yes("died1") & (F.col("year1") == F.col("__first"))))
    dead = dead.select(F.when(yes("died2"), F.col("t2")).otherwise(F.col("t1")).alias("key")).distinct().withColumn("event_type", F.lit("DIES"))
    rows = p.filter("event_type is not null").select(F.col("t1").alias("key"), "event_type").union(dead)
    n = rows.groupBy("key").pivot("event_type", list(kinds)).count().na.fill(0, list(kinds))
    return n if features is None else n.join(features, "key", "left")


def first_keyphrases(papers: DataFrame, cluster: str = "cluster", phrases: str = "keyphrases", order: str = "id") -> DataFrame:
    """(cluster, keyphrases): those of a cluster's first paper that has any."""
    return papers.filter(F.col(phrases).isNotNull()).groupBy(cluster).agg(F.min_by(phrases, order).alias(phrases))


def network_match_count(similarity: DataFrame, a: str, threshold: float) -> DataFrame:
    """(a, matches) of those with exactly one counterpart at or over the threshold."""
    return similarity.filter(F.col("score") >= threshold).groupBy(a).agg(F.count("*").alias("matches")).filter("matches = 1")


def within_window(clusters: DataFrame, year: int, part: int = SMALL) -> DataFrame:
    """(cluster, other, score) of all pairs of a year's clusters, which is the answer's size; one side is
    broadcast a bounded part at a time."""
    a = clusters.filter(F.col("year") == year).select("cluster", "embedding")
    out = None
    for b in small_parts(a.select(F.col("cluster").alias("other"), F.col("embedding").alias("__e")), rows=part):
        got = stored(a.crossJoin(b).select("cluster", "other", cosine("embedding", "__e").alias("score")))
        out = got if out is None else out.union(got)
    return out


def cosine_within(df: DataFrame, keys: list[str], key: str, vector: str, block: int = 2048) -> DataFrame:
    """(a, b, score) of all pairs a < b of a group's rows, which is the answer's size; null where a vector is zero or
    null. A task gets two blocks of about so many rows of a group, and makes their cosines by one product."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(*keys, F.col(key).alias("k"), F.when(~F.exists(v, lambda x: x.isNull()), v).alias("v")).dropna(subset=[*keys, "k"])
    sizes = stored(rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    tiles = sizes.agg(F.sum(F.expr("cast(blocks as bigint) * (blocks + 1) div 2"))).first()[0] or 1
    dealt = rows.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64("k"), "blocks").cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(*keys, "k", "v", "own", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"))
    kind = rows.schema["k"].dataType.simpleString()

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        width = max((len(v) for v in pdf["v"] if v is not None), default=0)
        x = np.array([np.zeros(width) if v is None else v for v in pdf["v"]], float).reshape(len(pdf), width)
        length = np.sqrt((x * x).sum(axis=1))
        k, own, t1, t2 = pdf["k"].to_numpy(), pdf["own"].to_numpy(), pdf["t1"].iloc[0], pdf["t2"].iloc[0]
        p, q = np.flatnonzero(own == t1), np.flatnonzero(own == t2)
        i, j = np.nonzero(k[p][:, None] != k[q]) if t1 != t2 else np.nonzero(k[p][:, None] < k[q])
        with np.errstate(divide="ignore", invalid="ignore"):
            score = ((x[p] @ x[q].T) / (length[p][:, None] * length[q]))[i, j]
        score[(length[p[i]] == 0) | (length[q[j]] == 0)] = np.nan
        low, high = np.minimum(p[i], q[j]), np.maximum(p[i], q[j])  # rows are in the order of their keys
        return pd.DataFrame({"a": k[low], "b": k[high], "score": score})

    made = dealt.repartition(int(min(tiles, 2000)), *keys, "t1", "t2").groupBy(*keys, "t1", "t2").applyInPandas(tile, f"a {kind}, b {kind}, score double")
    return made


def citation_interdisciplinarity(cites: DataFrame, clusters: DataFrame, year: int, primary: DataFrame | None = None) -> DataFrame:
    """(citing, n_refs, score) of papers that cite in `year`: shares of their references' clusters, zero
    for the others, scored without building the vector. clusters: (paper, cluster, year); primary: citing
    papers with a cluster of their own, if those alone count."""
    known = clusters.filter((F.col("cluster") > -1) & (F.col("year") <= year)).select(F.col("paper").alias("cited"), "cluster")
    e = cites.filter(F.col("year") == year).select("cited", "citing")
    if primary is not None:
        e = e.join(primary.select(F.col("paper").alias("citing")), "citing", "left_semi")
    n = clusters.filter(F.col("cluster") > -1).agg((F.max("cluster") + 1).cast("double").alias("n"))
    per = e.join(known, "cited").groupBy("citing", "cluster").agg(F.count("*").alias("k"))
    sums = per.groupBy("citing").agg(F.sum("k").alias("n_refs"), F.max("k").cast("double").alias("mk"), F.sum(F.col("k").cast("double") * F.col("k")).alias("kk"))
    total = F.col("n_refs").cast("double")
    mean = 1.0 / F.col("n")
    var = F.col("kk") / (total * total) / F.col("n") - mean * mean
    score = F.least(F.lit(1.0), F.col("n") / (F.col("n") - 1) * (1 - F.col("mk") / total) * (1 - F.sqrt(F.greatest(var, F.lit(0.0)))))
    return sums.crossJoin(F.broadcast(n)).select("citing", "n_refs", score.alias("score"))


def citation_fractions(edges: DataFrame, clusters: DataFrame, rows: int = 0) -> DataFrame:
    """(paper, cluster, fraction) over the neighbours of each paper, either way. The number of partitions
    follows the edges, so a task's sorts and counts don't grow with them; `rows` tells what they are made of."""
    edges = stored(edges.select("citing", "cited"), -(-rows // TASK_ROWS))
    sym = edges.select(F.col("citing").alias("paper"), F.col("cited").alias("other")).union(edges.select("cited", "citing"))
    n = sym.join(clusters.select(F.col("paper").alias("other"), "cluster"), "other").groupBy("paper", "cluster").agg(F.count("*").alias("k"))
    out = n.withColumn("fraction", F.col("k") / F.sum("k").over(Window.partitionBy("paper"))).select("paper", "cluster", "fraction")
    out = stored(out, -(-2 * edges.count() // TASK_ROWS))
    forget(edges)
    return out
