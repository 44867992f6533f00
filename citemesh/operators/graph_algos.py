"""Graph measures as iterative joins. Edge frames have columns src and dst; loops write each round's
state to the folder that executors share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.columns import graph_indices
from .relational import surrogate_ids
from .storage import PARTITIONS, SMALL_BYTES, TASK_ROWS, file_bytes, forget, stored


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected, without loops or repeats."""
    e = edges.select("src", "dst").filter("src <> dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) counting edges at both ends; isolates have 0."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    return nodes.join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def clustering(edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, lcc). Each edge points from its end of lower degree, so that a node's list of ends is
    short (at most the root of twice the edges); two lists meet at an edge, not every pair of ends."""
    sym = stored(both_ways(edges))
    deg = sym.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    e = sym.filter("src < dst").join(deg.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(deg.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    low, high = F.struct(F.col("ds").alias("d"), F.col("src").alias("id")), F.struct(F.col("dd").alias("d"), F.col("dst").alias("id"))
    one = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, high).otherwise(low).alias("b"))
    ahead = stored(one.groupBy("a").agg(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["id"]).alias("ids")))
    # a node's list goes to each node in it, cut to those behind that node
    sent = ahead.filter(F.size("ids") > 1).select("a", "ids", F.posexplode("ids").alias("p", "b")).filter(F.col("p") + 1 < F.size("ids"))
    sent = sent.select("a", "b", F.slice("ids", F.col("p") + 2, F.size("ids")).alias("rest"))
    closed = sent.join(ahead.toDF("b", "ids"), "b").select("a", "b", F.array_intersect("rest", "ids").alias("c")).filter(F.size("c") > 0)
    met = F.concat(F.transform(F.array("a", "b"), lambda x: F.struct(x.alias("id"), F.size("c").cast("bigint").alias("n"))), F.transform("c", lambda x: F.struct(x.alias("id"), F.lit(1).cast("bigint").alias("n"))))
    tri = closed.select(F.explode(met).alias("x")).groupBy("x.id").agg(F.sum("x.n").alias("triangles"))
    out = deg.join(tri, "id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    d = F.col("degree").cast("double")
    return out.withColumn("lcc", F.when(F.col("degree") > 1, 2 * F.col("triangles") / (d * (d - 1))).otherwise(F.lit(0.0)))


def shortest_paths(edges: DataFrame, sources: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """(src, dst, distance) of all finite positive hop counts: breadth first, all sources at once."""
    e = edges.select("src", "dst").filter("src <> dst").distinct()
    start = sources.select(F.col("id").alias("src")) if sources is not None else e.select("src").distinct()
    seen = frontier = stored(start.select("src", F.col("src").alias("dst"), F.lit(0).alias("distance")))
    k = 0
    while max_hops is None or k < max_hops:
        k += 1
        step = frontier.select("src", F.col("dst").alias("via")).join(e.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        frontier = stored(step.join(seen, ["src", "dst"], "left_anti").withColumn("distance", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.filter("distance > 0")


#: Sources whose state a node holds at a time.
SOURCES = 32


def _each(f, n: int = SOURCES) -> Column:
    return F.array(*(f(i) for i in range(n)))


def _batches(nodes: DataFrame, batch: int = SOURCES):
    """Of nodes(id), a batch of sources at a time: (id, place in the batch)."""
    placed = stored(surrogate_ids(nodes.select("id").distinct(), ["id"], 0, "__at"))
    for b in range(-(-placed.count() // batch)):
        yield placed.filter(F.expr(f"__at div {batch} = {b}")).select("id", (F.col("__at") % batch).cast("int").alias("i"))
    forget(placed)


def _watched(df: DataFrame, **values: Column) -> tuple[DataFrame, dict]:
    """df as a table in the shared folder, and aggregates of its rows, found while it is written."""
    seen = Observation()
    return stored(df.observe(seen, *(v.alias(k) for k, v in values.items()))), seen.get


def weighted_paths(edges: DataFrame, sources: DataFrame | None = None, delta: float | None = None, batch: int = SOURCES) -> DataFrame:
    """(src, dst, distance) with least sums of weight, from the given sources or all. Delta-stepping: a
    node's state is an array of distances, one for each source of a batch, and marks of those that are
    shorter than when they were last passed on; in a step, marked distances of the lowest bucket are passed
    along the edges. Buckets are `delta` wide at first (the mean weight, unless given) and twice as wide at each
    step, so steps grow with the edges of a path and not with its length. Weights must not be negative; edges
    without a weight are none. Rows for pairs are only made of the final state."""
    e = edges.filter("src <> dst and weight is not null").groupBy("src", "dst").agg(F.min("weight").cast("double").alias("weight"))
    e, known = _watched(e, mean=F.avg("weight"), low=F.min("weight"))
    if known["low"] is not None and known["low"] < 0:
        raise ValueError("weights must not be negative")
    far = F.lit(float("inf"))
    least = F.array_min(F.zip_with("d", "todo", lambda d, t: F.when(t, d)))
    start = sources.select("id") if sources is not None else e.select(F.col("src").alias("id"))
    found = []
    for own in _batches(start, batch):
        batch = own.count()
        width = delta or known["mean"] or 1.0
        at = own.select("id", _each(lambda i: F.when(F.col("i") == i, F.lit(0.0)).otherwise(far), batch).alias("d"), _each(lambda i: F.col("i") == i, batch).alias("todo"))
        state, seen = _watched(at, low=F.min(least))
        while seen["low"] is not None:
            limit = F.lit((seen["low"] // width + 1) * width)
            passed = lambda x, t: t & (x < limit)
            now = state.filter(F.exists(F.zip_with("d", "todo", passed), lambda x: x))
            step = now.select(F.col("id").alias("src"), F.zip_with("d", "todo", lambda x, t: F.when(passed(x, t), x)).alias("d")).join(e, "src")
            step = step.groupBy(F.col("dst").alias("id")).agg(_each(lambda i: F.min(F.col("d")[i] + F.col("weight")), batch).alias("new"))
            kept = state.select("id", "d", F.zip_with("d", "todo", lambda x, t: t & ~(x < limit)).alias("todo"))
            both = kept.join(step, "id", "full").select("id", *(F.coalesce(c, _each(lambda i, z=z: z, batch)).alias(c) for c, z in (("d", far), ("new", far), ("todo", F.lit(False)))))
            both = both.withColumn("new", F.transform("new", lambda x: F.coalesce(x, far)))
            shorter = F.zip_with("d", "new", lambda x, y: y < x)
            both = both.select("id", F.zip_with("d", "new", lambda x, y: F.least(x, y)).alias("d"), F.zip_with("todo", shorter, lambda x, y: x | y).alias("todo"))
            old, (state, seen) = state, _watched(both, low=F.min(least))
            width *= 2
            forget(old)
        pairs = state.select(F.col("id").alias("dst"), F.posexplode("d").alias("i", "distance")).filter(F.col("distance") < far)
        found.append(stored(pairs.join(own.select(F.col("id").alias("src"), "i"), "i").filter("src <> dst").select("src", "dst", "distance")))
        forget(state)
    forget(e)
    if not found:
        return edges.select("src", "dst", F.lit(0.0).alias("distance")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def betweenness(edges: DataFrame, sources: DataFrame | None = None, batch: int = SOURCES) -> DataFrame:
    """(id, score) of a directed graph: on how many shortest paths between two other nodes a node lies, in
    parts where there are several; of paths from the given sources only, or from all nodes. For a batch of
    sources, a node's state is one bit a source, and at the level where it is met its path counts; these tables
    of the levels are read again backward, to add up what each node lends to those before it."""
    e = stored(edges.select("src", "dst").filter("src <> dst").distinct())
    ids = stored(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct())
    start = ids if sources is None else sources.select("id").join(ids, "id", "left_semi")
    bit = [F.lit(1 << i).cast("bigint") for i in range(batch)]
    has = lambda mask, i: F.col(mask).bitwiseAND(bit[i]) != 0
    add = lambda c, name: _each(lambda i: F.sum(F.col(c)[i]), batch).alias(name)
    scores = []
    for own in _batches(start, batch):
        batch = own.count()
        at = own.select("id", F.expr("shiftleft(1L, i)").alias("met"), _each(lambda i: (F.col("i") == i).cast("double"), batch).alias("paths"))
        levels = [stored(at.select("id", "met", F.col("met").alias("new"), "paths"))]
        while True:
            front = levels[-1].filter("new <> 0").select(F.col("id").alias("src"), "paths")
            step = front.join(e, "src").groupBy(F.col("dst").alias("id")).agg(add("paths", "come"))
            both = levels[-1].select("id", "met").join(step, "id", "full").withColumn("met", F.coalesce("met", F.lit(0).cast("bigint")))
            fresh = [(F.coalesce(F.col("come")[i], F.lit(0.0)) > 0) & ~has("met", i) for i in range(batch)]
            new = sum((F.when(f, b).otherwise(F.lit(0).cast("bigint")) for f, b in zip(fresh[1:], bit[1:batch], strict=True)), F.when(fresh[0], bit[0]).otherwise(F.lit(0).cast("bigint")))
            both = both.withColumn("new", new)
            both = both.select("id", F.col("met").bitwiseOR(F.col("new")).alias("met"), "new", F.when(F.col("new") != 0, _each(lambda i: F.when(has("new", i), F.col("come")[i]).otherwise(F.lit(0.0)), batch)).alias("paths"))
            level, seen = _watched(both, n=F.sum((F.col("new") != 0).cast("bigint")))
            if not seen["n"]:
                forget(level)
                break
            levels.append(level)
        lent, parts = None, []
        for k in range(len(levels) - 1, 0, -1):  # a source itself is between nothing
            here = levels[k].filter("new <> 0").select("id", "paths")
            if lent is None:
                here = here.withColumn("d", _each(lambda i: F.lit(0.0), batch))
            else:
                come = e.join(lent, "dst").groupBy(F.col("src").alias("id")).agg(add("c", "come"))
                here = here.join(come, "id", "left").select("id", "paths", F.coalesce(F.zip_with("paths", "come", lambda p, c: p * c), _each(lambda i: F.lit(0.0), batch)).alias("d"))
            here = stored(here)
            parts.append(here)
            lent = here.select(F.col("id").alias("dst"), F.zip_with("paths", "d", lambda p, d: F.when(p > 0, (1 + d) / p).otherwise(F.lit(0.0))).alias("c"))
        if parts:
            total = parts[0]
            for p in parts[1:]:
                total = total.union(p)
            scores.append(stored(total.select("id", F.aggregate("d", F.lit(0.0), lambda s, x: s + x).alias("score")).groupBy("id").agg(F.sum("score").alias("score"))))
        forget(*levels, *parts)
    if not scores:
        return ids.withColumn("score", F.lit(0.0))
    total = scores[0]
    for s in scores[1:]:
        total = total.union(s)
    return ids.join(total.groupBy("id").agg(F.sum("score").alias("score")), "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of weighted undirected edges (src < dst) under (id, community)."""
    total = edges.agg(F.sum("weight")).first()[0]
    named = edges.join(labels.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src").join(labels.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst")
    inside = named.filter("cs = cd").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    ends = named.select(F.explode(F.array(F.struct(F.col("cs").alias("c"), "weight"), F.struct(F.col("cd").alias("c"), "weight"))).alias("x")).groupBy("x.c").agg(F.sum("x.weight").alias("k"))
    return inside / total - ends.agg(F.sum(F.pow(F.col("k") / (2 * total), 2.0))).first()[0]


def local_moves(e: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """(id, community) of weighted edges (src <= dst, loops allowed) after synchronous moves, and whether a
    node moved: in each round a node joins the neighbouring community of largest modularity gain; only
    moves to smaller labels are taken in even rounds and to larger in odd ones, so that neighbours don't
    swap. Ends when two rounds in a row move nothing, or after so many rounds."""
    sym = stored(e.filter("src <> dst").union(e.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    ends = e.select(F.col("src").alias("id"), "weight").union(e.select(F.col("dst"), "weight"))  # a loop counts twice
    k = ends.groupBy("id").agg(F.sum("weight").alias("k"))
    two_m = k.agg(F.sum("k")).first()[0] or 1.0
    labels = stored(k.select("id", "k", F.col("id").alias("community")))
    any_moved, still = False, 0
    for r in range(rounds):
        tot = labels.groupBy("community").agg(F.sum("k").alias("tot"))
        near = sym.join(labels.select(F.col("id").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
        own = labels.select(F.col("id").alias("src"), "k", F.col("community").alias("mine"))
        gain = near.join(own, "src").join(tot, "community")
        value = F.col("w") - (F.col("tot") - F.when(F.col("community") == F.col("mine"), F.col("k")).otherwise(0.0)) * F.col("k") / two_m
        gain = gain.withColumn("value", value)
        stay = gain.filter("community = mine").select("src", F.col("value").alias("stay"))
        way = F.col("community") < F.col("mine") if r % 2 == 0 else F.col("community") > F.col("mine")
        alone = own.join(tot.withColumnRenamed("community", "mine"), "mine").select("src", (-(F.col("tot") - F.col("k")) * F.col("k") / two_m).alias("alone"))
        best = gain.filter(way).groupBy("src").agg(F.max(F.struct("value", "community")).alias("best")).join(stay, "src", "left").join(alone, "src")
        moves = best.filter(F.col("best.value") > F.coalesce("stay", "alone") + 1e-12).select(F.col("src").alias("id"), F.col("best.community").alias("to"))
        new = stored(labels.join(moves, "id", "left").select("id", "k", F.coalesce("to", "community").alias("community"), F.col("to").isNotNull().alias("moved")))
        moved = new.filter("moved").limit(1).count()
        labels = new.drop("moved")
        any_moved, still = any_moved or bool(moved), 0 if moved else still + 1
        if still == 2:
            break
    return labels.select("id", "community"), any_moved


#: Bytes that tasks get of each node of a graph: its community's number, and a community's sum of weights.
NODE_BYTES = 12


def _pairs(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different pair of numbers, in order, with its sum."""
    pair, at = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)
    return pair >> 32, pair & 0xFFFFFFFF, np.bincount(at, w, len(pair))


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists, the row, the neighbour and the weight of each entry."""
    many = b.column("to").value_lengths().to_numpy()
    return np.repeat(np.arange(len(many)), many), b.column("to").flatten().to_numpy(), b.column("w").flatten().to_numpy()


def _neighbour_lists(flat: DataFrame, parts: int, alike: bool = False) -> DataFrame:
    """(id, k, to, w): a node's different neighbours, of flat(src, dst, w), their weights and the sum of these. With
    `alike`, a neighbour weighs 1 however often it comes, and a node to itself 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last node may go on

        def made(src, dst, w):
            first = np.flatnonzero(np.diff(src, prepend=-1))
            offsets = pa.array(np.append(first, len(src)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(dst.astype(np.int32)), pa.array(w))]
            return pa.RecordBatch.from_arrays([pa.array(src[first].astype(np.int32)), pa.array(np.add.reduceat(w, first)), *lists], ["id", "k", "to", "w"])

        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(c).to_numpy() for c in ("src", "dst", "w")]
            src, dst, w = _pairs(*(now if held is None else map(np.concatenate, zip(held, now, strict=True))))
            w = np.where(src == dst, 2.0, 1.0) if alike else w
            cut = np.searchsorted(src, src[-1])
            if cut:
                yield made(src[:cut], dst[:cut], w[:cut])
            held = [src[cut:], dst[cut:], w[cut:]]
        if held is not None:
            yield made(*held)

    dealt = flat.repartition(parts, "src").sortWithinPartitions("src")
    return stored(dealt.mapInArrow(run, "id int, k double, to array<int>, w array<double>"))


def _held_moves(lists: DataFrame, k: np.ndarray, rounds: int) -> tuple[np.ndarray, bool]:
    """local_moves() of neighbour lists: tasks get each node's community and each community's sum, and give the moves."""
    sc, two_m = lists.sparkSession.sparkContext, float(k.sum()) or 1.0
    label, any_moved, still = np.arange(len(k), dtype=np.int32), False, 0
    for r in range(rounds):
        sent = sc.broadcast((label, np.bincount(label, k, len(k))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, less=r % 2 == 0) -> Iterator[pa.RecordBatch]:
            label, tot = sent.value
            for b in batches:
                ids, k = b.column("id").to_numpy(), b.column("k").to_numpy()
                row, to, w = _flat(b)
                other = to != ids[row]
                row, c, w = _pairs(row[other], label[to[other]], w[other])
                mine = label[ids]
                stay = -(tot[mine] - k) * k / two_m
                here = c == mine[row]
                value = w - (tot[c] - np.where(here, k[row], 0.0)) * k[row] / two_m
                stay[row[here]] = value[here]
                way = np.flatnonzero(c < mine[row] if less else c > mine[row])
                way = way[np.lexsort((c[way], value[way], row[way]))]
                best = way[np.append(row[way][1:] != row[way][:-1], True)] if len(way) else way
                best = best[value[best] > stay[row[best]] + 1e-12]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[best]]), pa.array(c[best].astype(np.int32))], ["id", "to"])

        moves = lists.mapInArrow(run, "id int, to int").toArrow()  # a row for each node at most
        sent.destroy()
        label = label.copy()
        label[moves["id"].to_numpy()] = moves["to"].to_numpy()
        any_moved, still = any_moved or len(moves) > 0, 0 if len(moves) else still + 1
        if still == 2:
            break
    return label, any_moved


def _held_louvain(e: DataFrame, n: int, parts: int, alike: bool, rounds: int, levels: int) -> DataFrame:
    """(id, community) of edges(src, dst, weight) of numbered nodes below n. Edges lie as lists by node; in a round only
    moves leave the tasks, and a level shuffles its edges once."""
    sc = e.sparkSession.sparkContext
    ends = F.array(F.struct("src", "dst", F.col("weight").alias("w")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("w")))
    lists = nodes = _neighbour_lists(e.select(F.explode(ends).alias("x")).select("x.*"), parts, alike)
    loop = e.filter("src = dst").groupBy("src").agg((F.lit(2.0) if alike else F.sum("weight") * 2).alias("w")).toArrow()
    known = lists.select("id", "k").toArrow()  # a row for each node
    k = np.zeros(n)
    k[known["id"].to_numpy()] = known["k"].to_numpy()
    simple = k.copy()
    simple[loop["src"].to_numpy()] -= loop["w"].to_numpy()
    total, loops = simple.sum() / 2, loop["w"].to_numpy().sum()
    labels, value = None, None
    for _ in range(levels):
        found, moved = _held_moves(lists, k, rounds)
        new = found if labels is None else found[labels]
        if labels is not None and not moved:
            break
        sent = sc.broadcast(found)
        if moved:

            def within(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                s = 0.0
                for b in batches:
                    row, to, w = _flat(b)
                    s += w[sent.value[b.column("id").to_numpy()][row] == sent.value[to]].sum()
                yield pa.RecordBatch.from_arrays([pa.array([s])], ["s"])

            inside = (lists.mapInArrow(within, "s double").agg(F.sum("s")).first()[0] - loops) / 2
            now = inside / total - np.square(np.bincount(new, simple, n) / (2 * total)).sum()
            if labels is not None and now <= value + 1e-9:
                break
            value = now
        labels = new
        if not moved:
            break

        def joined(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, to, w = _flat(b)
                src, dst, w = _pairs(sent.value[b.column("id").to_numpy()][row], sent.value[to], w)
                yield pa.RecordBatch.from_arrays([pa.array(src.astype(np.int32)), pa.array(dst.astype(np.int32)), pa.array(w)], ["src", "dst", "w"])

        was, lists = lists, _neighbour_lists(lists.mapInArrow(joined, "src int, dst int, w double"), parts)
        k = np.bincount(found, k, n)
        if was is not nodes:
            forget(was)
    sent = sc.broadcast(labels)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sent.value[b.column("id").to_numpy()])], ["id", "community"])

    out = stored(nodes.select("id").mapInArrow(named, "id int, community int"))
    forget(nodes, *(() if lists is nodes else (lists,)))
    return out


def louvain(edges: DataFrame, rounds: int = 6, levels: int = 4) -> DataFrame:
    """(id, community): local moves, then communities become nodes and the same is done again, until no
    level gains modularity. Labels aren't those of a sequential run; modularity compares. Nodes get numbers in
    the order of their ids (whole numbers that lie close together are their own); while these take SMALL_BYTES
    at most, tasks get all nodes' communities, and larger graphs' are joined with the edges in each round."""
    weighted = "weight" in edges.columns
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *([F.col("weight").cast("double")] if weighted else []))
    e, kind, most = e.filter("src is not null"), e.schema["src"].dataType.simpleString(), SMALL_BYTES // NODE_BYTES
    if not weighted:
        e = e.withColumn("weight", F.lit(1.0))
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    e, known = _watched(e, n=F.count("*"), low=F.min("src") if whole else F.lit(None).cast("int"), high=F.max("dst") if whole else F.lit(None).cast("int"))
    parts = max(int(e.sparkSession.conf.get(PARTITIONS)), -(-2 * known["n"] // TASK_ROWS))
    if known["low"] is not None and known["high"] - known["low"] < most:
        low = known["low"]
        numbered = e.select(*((F.col(c) - F.lit(low)).cast("int").alias(c) for c in ("src", "dst")), F.coalesce("weight", F.lit(0.0)).alias("weight"))
        out = _held_louvain(numbered, known["high"] - low + 1, parts, not weighted, rounds, levels)
        forget(e)
        return out.select(*((F.col(c).cast("bigint") + F.lit(low)).cast(kind).alias(c) for c in ("id", "community")))
    codes = surrogate_ids(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct(), ["id"], 0, "__at")
    codes = stored(codes.select("id", F.col("__at").cast("int").alias("at")))
    n = codes.count()
    if n > most:
        forget(codes)
        return _joined_louvain(e.groupBy("src", "dst").agg((F.sum("weight") if weighted else F.lit(1.0)).alias("weight")), rounds, levels)
    numbered = stored(e.join(codes.toDF("src", "a"), "src").join(codes.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.coalesce("weight", F.lit(0.0)).alias("weight")))
    out = _held_louvain(numbered, n, parts, not weighted, rounds, levels)
    forget(e, numbered)
    named = out.join(codes.toDF("name", "id"), "id").join(codes.toDF("to", "community"), "community")
    return named.select(F.col("name").alias("id"), F.col("to").alias("community"))


def _joined_louvain(e: DataFrame, rounds: int, levels: int) -> DataFrame:
    """louvain() of edges (src <= dst, weight) by joins of all edges with the nodes' communities."""
    e = stored(e)
    labels, value, simple = None, None, e.filter("src <> dst")
    for _ in range(levels):
        found, moved = local_moves(e, rounds)
        new = found if labels is None else stored(labels.select("id", F.col("community").alias("was")).join(found.select(F.col("id").alias("was"), "community"), "was").select("id", "community"))
        now = modularity(simple, new) if labels is not None or moved else None
        if labels is not None and (not moved or now <= value + 1e-9):
            break
        labels, value = new, now
        if not moved:
            break
        a = found.select(F.col("id").alias("src"), F.col("community").alias("a"))
        b = found.select(F.col("id").alias("dst"), F.col("community").alias("b"))
        e = stored(e.join(a, "src").join(b, "dst").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "weight").groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
        if simple.limit(1).count() == 0:
            break
    return labels


#: Limits of the statistics' flags.
FLAGS = (("beta", "<", 1.0, "few links for the nodes"), ("alpha", "<", 0.5, "few of the possible cycles"), ("gamma", "<", 0.5, "few of the possible links"), ("diameter", ">", 5, "far from end to end"), ("efficiency", ">", 2, "long paths on average"), ("transitivity", "<", 0.5, "neighbours are seldom linked"))


def describe(nodes: DataFrame, edges: DataFrame, full: bool = False, sources: int | None = None) -> DataFrame:
    """One row of graph statistics. full adds nodes without edges, mean local clustering (of all nodes),
    the largest and the mean finite distance; those take paths from all nodes, or with `sources` from so
    many nodes, chosen by a hash: then the diameter is a lower bound and the mean an estimate."""
    edges = stored(edges.select("src", "dst")) if full else edges  # five plans read them
    n = nodes.agg(F.count("*").alias("num_nodes")).crossJoin(edges.agg(F.count("*").alias("num_edges")))  # one row each
    out = n.select("*", *(v.alias(k) for k, v in graph_indices(F.col("num_nodes"), F.col("num_edges")).items()))
    if full:
        some = None if sources is None else nodes.select("id").orderBy(F.xxhash64("id"), "id").limit(sources)
        ends = distance_counts(edges, some)
        paths = ends.agg(F.max("distance").cast("bigint").alias("diameter"), (F.sum(F.col("distance") * F.col("n")) / F.sum("n")).alias("efficiency"))
        lone = degrees(nodes, edges).filter("degree = 0").agg(F.count("*").alias("isolates"))
        lcc = nodes.select("id").join(clustering(edges), "id", "left").agg(F.avg(F.coalesce("lcc", F.lit(0.0))).alias("transitivity"))
        out = out.crossJoin(lone).crossJoin(lcc).crossJoin(paths).withColumn("isolate_fraction", F.try_divide(F.col("isolates").cast("double"), F.col("num_nodes")))
    return out


def flagged(stats: DataFrame) -> DataFrame:
    """stats with `flags`: what is out of the usual range."""
    tests = [F.when(F.expr(f"{c} {op} {limit}"), F.lit(f"{c}: {said}")) for c, op, limit, said in FLAGS if c in stats.columns]
    return stats.withColumn("flags", F.array_compact(F.array(*tests)))


#: Edges of a graph that a task may hold whole (about 16 bytes each), if its files are within SMALL_BYTES.
HELD = 4_000_000


def _held_counts(e: DataFrame, start: DataFrame, most: int | None) -> DataFrame:
    """distance_counts() of a graph that each task holds: tasks share out the sources, 64 at a time, and go
    breadth first with one word of bits a node. The graph's size was checked before."""
    spark = e.sparkSession
    t = e.toArrow()
    codes, ids = pd.factorize(np.concatenate([t["src"].to_pandas(), t["dst"].to_pandas()]))
    src, dst = codes[: len(t)], codes[len(t) :].astype(np.int32)
    order = np.argsort(src, kind="stable")
    first = np.searchsorted(src[order], np.arange(len(ids) + 1))
    known = start.distinct().join(e.select(F.col("src").alias("id")).distinct(), "id", "left_semi").toArrow()["id"].to_pandas()
    mine = np.sort(pd.Index(ids).get_indexer(known))
    graph = spark.sparkContext.broadcast((first, dst[order], mine))
    batches = -(-len(mine) // 64)

    def count(frames):
        first, dst, mine = graph.value
        n = len(first) - 1
        for frame in frames:
            found: dict[int, int] = {}
            for b in frame["id"]:
                at = mine[b * 64 : b * 64 + 64]
                bits = np.uint64(1) << np.arange(len(at), dtype=np.uint64)
                seen, come = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                seen[at] = bits
                k = 0
                while len(at) and (most is None or k < most):
                    k += 1
                    out = first[at + 1] - first[at]
                    edge = np.arange(out.sum()) + np.repeat(first[at] - np.cumsum(out) + out, out)
                    to = dst[edge]
                    np.bitwise_or.at(come, to, np.repeat(bits, out))
                    at = np.unique(to) if len(to) * 8 < n else np.flatnonzero(come)
                    bits = come[at] & ~seen[at]
                    come[at] = 0
                    at, bits = at[bits != 0], bits[bits != 0]
                    seen[at] |= bits
                    if len(at):
                        found[k] = found.get(k, 0) + int(np.bitwise_count(bits).sum(dtype=np.int64))
            yield pd.DataFrame({"distance": list(found), "n": list(found.values())}).astype({"distance": "int32", "n": "int64"})

    some = spark.range(0, batches, 1, max(1, min(batches, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(count, "distance int, n bigint")
    return stored(some.groupBy("distance").agg(F.sum("n").alias("n")))


def _near_counts(e: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """distance_counts() of one or two hops: each edge is read twice, whatever the number of sources, and
    pairs of two hops are counted once each by a distinct."""
    mine = e.join(start.distinct(), F.col("src") == F.col("id"), "left_semi")
    one = mine.select("src", "dst", F.lit(1).alias("distance"))
    if most == 1:
        met = one
    elif most < 1:
        met = one.limit(0)
    else:
        two = mine.select("src", F.col("dst").alias("via")).join(e.select(F.col("src").alias("via"), "dst"), "via").filter("src <> dst")
        met = one.union(two.select("src", "dst", F.lit(2).alias("distance"))).groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    return stored(met.groupBy("distance").agg(F.count("*").alias("n")))


def distance_counts(edges: DataFrame, sources: DataFrame | None = None, batch: int = 256, most: int | None = None, held: int = HELD) -> DataFrame:
    """(distance, n): how many ordered pairs are so far apart, of distances up to `most` if given. A graph of
    at most `held` edges is broadcast and tasks share out the sources. Of a larger one, sources go in batches; in each, a node's state
    is one bit a source, so a level is one join of the nodes met last with the edges and one aggregate, and
    memory is a node's few bytes, not a row for each pair. Bits are counted while a level is written. With
    `most` of 2 or less, such a graph's pairs are made and counted at once, without batches."""
    spark = edges.sparkSession
    e = stored(edges.select("src", "dst").filter("src <> dst").distinct())
    start = e.select(F.col("src").alias("id")) if sources is None else sources.select("id")
    if file_bytes(e) <= SMALL_BYTES and e.limit(held + 1).count() <= held:
        out = _held_counts(e, start, most)
        forget(e)
        return out
    if most is not None and most <= 2:
        out = _near_counts(e, start, most)
        forget(e)
        return out
    found: dict[int, int] = {}
    zero = F.lit(0).cast("bigint")
    for own in _batches(start, batch):
        words = -(-own.count() // 64)
        each = lambda f, n=words: _each(f, n)
        mine = each(lambda w: F.when(F.expr(f"i div 64 = {w}"), F.expr("shiftleft(1L, i % 64)")).otherwise(zero))
        seen = stored(own.select("id", mine.alias("seen"), mine.alias("new")))
        k, more = 0, True
        while more and (most is None or k < most):
            k += 1
            step = e.join(seen.filter(F.exists("new", lambda x: x != 0)).select(F.col("id").alias("src"), "new"), "src")
            step = step.groupBy(F.col("dst").alias("id")).agg(each(lambda w: F.bit_or(F.col("new")[w])).alias("come"))
            both = seen.select("id", "seen").join(step, "id", "full").select("id", *(F.coalesce(c, each(lambda w: zero)).alias(c) for c in ("seen", "come")))
            both = both.select("id", F.zip_with("seen", "come", lambda x, y: x.bitwiseOR(y)).alias("seen"), F.zip_with("seen", "come", lambda x, y: F.bitwise_not(x).bitwiseAND(y)).alias("new"))
            old, (seen, got) = seen, _watched(both, n=F.sum(F.aggregate("new", zero, lambda s, x: s + F.bit_count(x))))
            forget(old)
            more = bool(got["n"])
            if more:
                found[k] = found.get(k, 0) + got["n"]
        forget(seen)
    forget(e)
    return spark.createDataFrame(sorted(found.items()), "distance int, n bigint")  # a row for each distance


def negative_edges(edges: DataFrame, k: int = 1, seed: int = 7, shared: bool = False) -> DataFrame:
    """(src, neg_dst, k_index): k sampled ends for each edge, in proportion to in-degree**0.75; with
    `shared`, edges of one hash class of 1,024 share their draws. Weights are whole numbers (millionths),
    laid out in the order of the ids over range partitions; a draw is an MD5 of seed, edge and k, taken
    modulo their sum, and meets its range through cells of equal width."""
    w = edges.groupBy(F.col("dst").alias("id")).agg(F.floor(F.pow(F.count("*").cast("double"), F.lit(0.75)) * 1e6).cast("bigint").alias("w"))
    rows = stored(w.repartitionByRange("id").sortWithinPartitions("id").withColumn("__p", F.spark_partition_id()))
    sums = rows.groupBy("__p").agg(F.sum("w").alias("s"))  # a row for each partition
    before = sums.select("__p", (F.sum("s").over(Window.orderBy("__p")) - F.col("s")).alias("__b"))
    upto = F.sum("w").over(Window.partitionBy("__p").orderBy("id")) + F.col("__b")
    laid = rows.join(F.broadcast(before), "__p").select("id", (upto - F.col("w")).alias("lo"), upto.alias("hi"))
    total = rows.agg(F.sum("w").alias("total"), F.greatest(F.floor(F.sum("w") / F.count("*")), F.lit(1)).alias("width"))
    name = [F.pmod(F.xxhash64("src", "dst"), F.lit(1024)).cast("string")] if shared else [F.col("src").cast("string"), F.col("dst").cast("string")]
    draws = edges.select("src", "dst", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k_index")).crossJoin(F.broadcast(total))  # one row
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *name, F.col("k_index").cast("string"))), 1, 15), 16, 10).cast("bigint")
    draws = draws.withColumn("u", F.pmod(drawn, F.col("total"))).withColumn("cell", F.expr("u div width"))
    cells = laid.crossJoin(F.broadcast(total)).select("id", "lo", "hi", F.explode(F.expr("sequence(lo div width, (hi - 1) div width)")).alias("cell"))
    return draws.join(cells, "cell").filter("u >= lo and u < hi").select("src", F.col("id").alias("neg_dst"), "k_index")
