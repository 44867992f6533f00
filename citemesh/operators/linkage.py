"""Record linkage: score groups, fuzzy text, tiered fills and merges with provenance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import null_labels
from .relational import fill_tiers, top_n
from .storage import stored


def best_score(df: DataFrame, key: str, score: str, goal: str, threshold: float = 0.2) -> DataFrame:
    """Rows sorted by falling score; the first whose drop to the next, relative to that next score, exceeds
    the threshold and whose goal is not null. A single row has no drop and no match."""
    w = Window.partitionBy(key).orderBy(F.desc(score), goal)
    following = F.lead(score).over(w)
    drop = F.when((following == 0) & (F.col(score) > 0), F.lit(float("inf"))).otherwise(F.try_divide(F.col(score) - following, following))
    found = df.withColumn("drop", drop).filter(F.col("drop") > threshold).filter(F.col(goal).isNotNull())
    return top_n(found, [key], [F.desc(score), goal], 1, "__r").drop("__r")


def _indel(x: str, y: str) -> float:
    """1 - (insertions + deletions) / (both lengths). Bit-parallel, one big integer per text."""
    if not x and not y:
        return 1.0
    masks: dict[str, int] = {}
    for i, c in enumerate(x):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    s = full
    for c in y:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return 2.0 * (len(x) - s.bit_count()) / (len(x) + len(y))


def _indels(xs: list[str], ys: list[str]) -> np.ndarray:
    """_indel() of many pairs, none over 63 characters: a pair's bits are one word of an array."""
    codes = lambda t, n: np.array(t, dtype=f"U{max(1, n)}").view(np.uint32).reshape(len(t), -1)
    nx, ny = np.array([len(t) for t in xs]), np.array([len(t) for t in ys])
    x, y = codes(xs, nx.max()), codes(ys, ny.max())
    one = np.uint64(1)
    full = (one << nx.astype(np.uint64)) - one
    s = full.copy()
    for j in range(ny.max()):
        mask = np.zeros(len(xs), np.uint64)
        for i in range(nx.max()):
            mask |= (x[:, i] == y[:, j]).astype(np.uint64) << np.uint64(i)
        u = s & mask & full
        s = np.where(j < ny, ((s + u) | (s - u)) & full, s)
    total = nx + ny
    return np.where(total == 0, 1.0, 2.0 * (nx - np.bitwise_count(s).astype(int)) / np.maximum(total, 1))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - (insertions + deletions) / (both lengths), lower-cased: twice the longest common subsequence
    over the lengths' sum. Pairs of short texts are scored together, by their lengths."""
    out, lots = np.full(len(a), np.nan), {}
    for i, (x, y) in enumerate(zip(a, b)):
        if x is None or y is None:
            continue
        x, y = x.lower(), y.lower()
        if max(len(x), len(y)) > 63:
            out[i] = _indel(x, y)
        else:
            lots.setdefault((len(x) // 8, len(y) // 8), []).append((i, x, y))
    for lot in lots.values():
        at, xs, ys = zip(*lot)
        out[list(at)] = _indels(list(xs), list(ys))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("grams", T.ArrayType(T.StringType()))]))
def _gram_lists(texts: pd.Series, size: pd.Series) -> pd.DataFrame:
    """Length of the lower-cased text, and its runs of `size` characters, each with its number among equal ones."""

    def one(t: str, q: int) -> list[str]:
        t, seen, out = t.lower(), {}, []
        for i in range(len(t) - q + 1):
            g = t[i : i + q]
            seen[g] = seen.get(g, -1) + 1
            out.append(f"{q}{g}{seen[g]}")
        return out

    return pd.DataFrame({"n": [len(t.lower()) for t in texts], "grams": [one(t, int(q)) for t, q in zip(texts, size, strict=True)]})


def lost_grams(n: Column | float, q: int, threshold: float):
    """How many of the q-grams of a text of n characters a text of that indel ratio can lack, at most.
    A common subsequence of threshold * (n + m) / 2 is left after n less that many deletions, each of which
    spoils q grams, and m less that many insertions, each of which spoils q - 1; the worst m is the least
    or the largest that allows the threshold."""
    worst = lambda m: q * n + (q - 1) * m - (2 * q - 1) * threshold * (n + m) / 2
    ends = [worst(n * threshold / (2 - threshold)), worst(n * (2 - threshold) / threshold)]
    return F.greatest(*ends) if isinstance(n, Column) else max(ends)


def fuzzy_candidates(left: DataFrame, right: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """(block..., __l, __t): all pairs of left(block, __l) and right(block, __t) texts that may reach a ratio
    of `threshold` (over 0). Rare grams first, a text of n grams that can lack d of them in a match has one
    of its first d + 1 among the first of any match: only those are joined. Runs of up to five characters
    are used, as the threshold allows, where texts are long enough; single ones, counted, for short texts
    and their possible matches, or for all where the threshold is low. Equal empty texts are found too."""
    # the longest runs of which a third is left in a match, and the shortest length from which one always is
    run = max((q for q in range(1, 6) if lost_grams(1.0, q, threshold) <= 0.65), default=1)
    runs_from = next(n for n in range(run, 1000) if all(k - run + 1 - lost_grams(k, run, threshold) >= 1 for k in range(n, 2 * n + 2))) if run > 1 else 0
    n = F.col("__n")
    sides = []
    for df, text in ((left, "__l"), (right, "__t")):
        rows = df.select(*block, text).distinct()
        parts = []
        for q in sorted({1, run}):
            made = rows.withColumn("__g", _gram_lists(F.col(text), F.lit(q))).select(*block, text, F.col("__g.n").alias("__n"), F.col("__g.grams").alias("__grams"))
            if run > 1:
                made = made.filter(n >= runs_from if q > 1 else n * threshold < runs_from * (2 - threshold))
            none = F.when(n == 0, F.array(F.lit(""))).otherwise(F.col("__grams"))
            parts.append(made.select(*block, text, "__n", (F.floor(lost_grams(n.cast("double"), q, threshold) + 1e-6) + 1).alias("__first"), F.lit(q).alias("__q"), F.explode(none).alias("__gram")))
        sides.append(stored(parts[0] if len(parts) == 1 else parts[0].union(parts[1])))
    often = sides[0].select("__gram").union(sides[1].select("__gram")).groupBy("__gram").agg(F.count("*").alias("__often"))
    firsts = []
    for df, text in zip(sides, ("__l", "__t"), strict=True):
        by = Window.partitionBy(*block, text, "__q").orderBy("__often", "__gram")  # a text's grams
        firsts.append(df.join(often, "__gram").withColumn("__at", F.row_number().over(by)).filter(F.col("__at") <= F.greatest(F.col("__first"), F.lit(1))).select(*block, text, F.col("__n").alias("__n" + text[2:]), "__gram"))
    both = firsts[0].join(firsts[1], [*block, "__gram"])
    a, b = F.col("__nl"), F.col("__nt")
    return both.filter(2 * F.least(a, b) >= F.lit(threshold) * (a + b) - 1e-9).select(*block, "__l", "__t").distinct()


def fuzzy_best(left: DataFrame, right: DataFrame, block: list[str], left_text: str, right_text: str, threshold: float = 0.0, tie: str | None = None) -> DataFrame:
    """Within blocks, the best right row for each left row (row_id) by indel ratio, at least `threshold`;
    ties go by `tie`, else by the right text. Only different texts are scored, once for each two that
    fuzzy_candidates() gives for a threshold over 0 (with 0, all of a block); of a text's right rows the first
    by `tie` stands for it. A block may be large if the threshold is not low."""
    by = [tie] if tie and tie != right_text else []
    first = F.min(F.struct(*by, *(c for c in right.columns if c not in [*block, right_text, *by]), F.lit(0).alias("__z"))).alias("__row")
    r = right.filter(F.col(right_text).isNotNull()).groupBy(*block, right_text).agg(first)
    l = left.filter(F.col(left_text).isNotNull()).select(*block, F.col(left_text).alias("__l")).distinct()
    if threshold > 0:
        r = stored(r)
        pairs = fuzzy_candidates(l, r.select(*block, F.col(right_text).alias("__t")), block, threshold)
        pairs = pairs.withColumn("score", indel_ratio(F.col("__l"), F.col("__t"))).filter(F.col("score") >= threshold)
        pairs = pairs.withColumnRenamed("__t", right_text).join(r, [*block, right_text])
    else:
        pairs = l.join(r, block).withColumn("score", indel_ratio(F.col("__l"), F.col(right_text))).filter(F.col("score") >= threshold)
    order = F.struct((-F.col("score")).alias("s"), *(F.col(f"__row.{c}") for c in by), F.col(right_text).alias("t"))
    best = pairs.groupBy(*block, "__l").agg(F.min_by(F.struct("score", right_text, "__row"), order).alias("__b"))
    rest = [c for c in right.columns if c not in [*block, right_text]]
    out = left.withColumn("__l", F.col(left_text)).join(best, [*block, "__l"]).drop("__l")
    return out.select("*", F.col(f"__b.{right_text}").alias(right_text), *(F.col(f"__b.__row.{c}").alias(c) for c in rest), F.col("__b.score").alias("score")).drop("__b")


def clean_operators(c: Column) -> Column:
    """Without the words AND, OR, NEAR and NOT."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\b(AND|OR|NEAR|NOT)\b", ""), " +", " "))


def author_merge(wos: DataFrame, scholar: DataFrame, paper: str = "paper") -> DataFrame:
    """Each author of one record takes the best named author of the same paper in the other; no cut-off.
    With a last_name and a position, each row also says whether its paper's last names are in order (a
    single author's aren't)."""
    if {"last_name", "position"} <= set(wos.columns):
        w = Window.partitionBy(paper).orderBy("position")  # a paper's authors
        wrong = F.col("last_name") > F.lead("last_name").over(w)
        every = Window.partitionBy(paper)
        wos = wos.withColumn("__wrong", F.coalesce(wrong, F.lit(False)).cast("int"))
        wos = wos.withColumn("authorListAlphabetizedLastName", (F.sum("__wrong").over(every) == 0) & (F.count("*").over(every) > 1)).drop("__wrong")
    left = wos.withColumn("__n", clean_operators(F.col("name")))
    right = scholar.select(paper, F.col("author_id"), clean_operators(F.col("name")).alias("__m"))
    return fuzzy_best(left, right, [paper], "__n", "__m", tie="author_id").drop("__n", "__m")


def merge_records(wos: DataFrame, scholar: DataFrame) -> DataFrame:
    """Scholar rows join by id, else by DOI. The abstract is the first that exists; its source names the
    scholar whenever it has one; abstract_missing lists the sources that lack it."""
    by_id = scholar.filter("paper_id is not null").dropDuplicates(["paper_id"]).select("paper_id", F.col("abstract").alias("a1"), F.lit(True).alias("m1"))
    by_doi = scholar.filter("doi is not null").dropDuplicates(["doi"]).select("doi", F.col("abstract").alias("a2"))
    out = wos.join(by_id, "paper_id", "left").join(by_doi, "doi", "left")
    other = F.when(F.col("m1"), F.col("a1")).otherwise(F.col("a2"))
    out = out.withColumn("abstract_ss", other).withColumnRenamed("abstract", "abstract_wos").drop("a1", "a2", "m1")
    source = F.when(F.col("abstract_ss").isNotNull(), "Semantic Scholar").when(F.col("abstract_wos").isNotNull(), "Web of Science")
    return out.withColumns({"abstract": F.coalesce("abstract_wos", "abstract_ss"), "abstract_source": source, "abstract_missing": null_labels({"abstract_wos": "Web of Science", "abstract_ss": "Semantic Scholar"})})


def find_ids(df: DataFrame, matches: DataFrame, key: str = "row_id") -> DataFrame:
    """Missing DOIs are filled from title matches(key, doi, paper_id); every matched row gets the scholar's
    id, as id_ss."""
    m = matches.groupBy(key).agg(F.min_by("doi", "paper_id").alias("__doi"), F.min("paper_id").alias("id_ss"))
    return df.join(m, key, "left").withColumn("doi", F.coalesce("doi", "__doi")).drop("__doi")


def geocode_institutions(institutions: DataFrame, lookup: DataFrame) -> DataFrame:
    """Latitude and longitude of institutions with a city and a country, by the first of their addresses;
    the street, then the postal code, then the city must fit the lookup."""
    fields = {"street": "addresses", "city": "cities", "state": "states", "postalcode": "postalCodes", "country": "countries"}
    rows = institutions.withColumns({k: F.try_element_at(v, F.lit(1)) for k, v in fields.items()}).filter("city is not null and country is not null")
    return geocode(rows, lookup, [["street", "city", "country"], ["postalcode", "city", "country"], ["city", "country"]])


def geocode(places: DataFrame, lookup: DataFrame, tiers: list[list[str]]) -> DataFrame:
    """Latitude and longitude by ever coarser keys; `tier` counts from 1, null if none fits."""
    out = places
    for i, keys in enumerate(tiers):
        t = lookup.groupBy(*keys).agg(F.min(F.struct("lat", "lon")).alias(f"__g{i}"))
        out = out.join(t, keys, "left")
    found = [F.col(f"__g{i}") for i in range(len(tiers))]
    tier = F.coalesce(*(F.when(g.isNotNull(), F.lit(i + 1)) for i, g in enumerate(found)))
    return out.withColumn("__g", F.coalesce(*found)).withColumns({"lat": F.col("__g.lat"), "lon": F.col("__g.lon"), "tier": tier}).drop("__g", *(f"__g{i}" for i in range(len(tiers))))


def fill_doi(df: DataFrame, by_title: DataFrame, by_citation: DataFrame, key: str = "row_id") -> DataFrame:
    return fill_tiers(df, key, "doi", [by_title, by_citation], "doi_source")
