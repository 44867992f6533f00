"""MinHash near-duplicates with sequential Bayesian verification.

A document is the set of its distinct word shingles. Its signature is HASHES minima of independent hashes of
the set; BANDS bands of ROWS minima are its buckets. A pair of similarity 0.85 or more shares no band with a
probability of (1 - 0.85 ** ROWS) ** BANDS at most (7e-9).

Candidates (pairs with a band in common and sizes that allow the similarity) are verified in steps: after
each BATCH of minima the number of equal ones gives a posterior of their similarity (Beta, from a uniform
prior); a pair is dropped once the probability that it reaches the threshold is under MISS, so most pairs are
dropped after one or two batches. Those that remain are compared exactly, on their full sets: false links
don't occur, a true link is missed with a probability of about MISS a step.

Equal sets are one class, by a 128-bit fingerprint. Classes in a bucket with another are ordered by the least
bucket that reaches them, so that those alike lie together, and cut into tiles of bounded size; each two tiles
with a bucket in common are one group of rows, so that a bucket of any size is spread over tasks, no pair is
emitted, and a group's memory is bounded. Within a group, pairs that links have already joined are not
compared again, so a large group of near copies costs about one comparison a member; only a spanning forest
of links leaves it.

Edge cases: a row is a document, whatever its id. Null or empty texts and texts of white space have no
shingles and no links, and are kept under their own id. Texts under the shingle length are one shingle.
Repeated rows and rows of one id are documents of their own with equal sets: one of them is kept (duplicates()
only says whether the id is the smallest of its group; unique() leaves one row). Rows without an id link like
others; component_id is the smallest id there is, null where there is none. Extra columns are not read, so
their names don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard_join as jj
from ._shared import components, cut, drop, small_or_not

WORDS = 3
PERCENT = 85
HASHES, BANDS, ROWS = 160, 32, 5
#: Minima compared at a time, and the probability at which a pair is dropped.
BATCH, MISS = 32, 1e-9
#: Cells of the table of a set's hashes that are computed at a time.
CELLS = 1 << 18
_U = np.uint64


@lru_cache(maxsize=4)
def multipliers(hashes: int = HASHES) -> np.ndarray:
    """Odd 64-bit numbers by the rule of a finaliser."""
    return jj.mix(np.arange(1, hashes + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """A set's signature: of each multiplier, the least upper half of its products with the set."""
    k = multipliers()
    out, step = np.empty(len(k), np.uint64), max(1, CELLS // len(hashes))
    for at in range(0, len(k), step):
        out[at : at + step] = (k[at : at + step, None] * hashes).min(axis=1)
    return (out >> _U(32)).astype(np.uint32)


def buckets(signature: np.ndarray) -> np.ndarray:
    """A hash of each band."""
    total = np.arange(BANDS, dtype=np.uint64) + _U(1)
    for row in signature.reshape(BANDS, ROWS).T:
        total = jj.mix(total * _U(0x9E3779B97F4A7C15) + row)
    return total


@lru_cache(maxsize=64)
def least_equal(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """How many of n minima must be equal for a pair to go on: with fewer, the posterior probability of a
    similarity of `percent` or more (that n + 1 draws at it hit no more often) is under `miss`."""
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def prepared(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, x, n, k1, k2, sigs) of docs(doc_id, x, text): size, fingerprint and buckets of each row's
    set. A set that a task has met already gives no buckets again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for part, sets, prints in jj._each(batches, words):
            sigs = []
            for h, k in zip(sets, prints, strict=True):
                sigs.append(buckets(minima(h)) if len(h) and k not in seen else h[:0])
                if len(seen) >= jj.SEEN:
                    seen.clear()
                seen.add(k)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(h) for h in sets], pa.int64()), *(pa.array([k[i] for k in prints], pa.int64()) for i in range(2)), jj._lists(sigs)], ["doc_id", "x", "n", "k1", "k2", "sigs"])

    return docs.select("doc_id", "x", "text").mapInArrow(run, "doc_id bigint, x bigint, n bigint, k1 bigint, k2 bigint, sigs array<bigint>")


def links(tile: np.ndarray, sigs: list[np.ndarray], sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links of documents of one or two tiles (within the tile, or across the two),
    by the documents' places."""
    n, order = np.array([len(s) for s in sets]), np.arange(len(sets))
    mins = np.stack([minima(s) for s in sets])
    at, bucket = np.repeat(order, [len(s) for s in sigs]), np.concatenate(sigs)
    by = np.lexsort((at, bucket))
    at, bucket = at[by], bucket[by]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
    ends = np.concatenate([starts[1:], [len(bucket)]])
    mine: dict[int, list[int]] = {}
    for k in np.flatnonzero(ends - starts > 1).tolist():
        for place in at[starts[k] : ends[k] - 1].tolist():  # partners have higher places
            mine.setdefault(place, []).append(k)
    # the component of each place, by its smallest member
    of, both, forest = order.copy(), tile.min() != tile.max(), []
    for a in sorted(mine):
        near = np.concatenate([at[starts[k] : ends[k]] for k in mine[a]])
        b = np.unique(near[(near > a) & (of[near] != of[a])])
        if both:
            b = b[tile[b] != tile[a]]
        b = b[100 * np.minimum(n[b], n[a]) >= percent * np.maximum(n[b], n[a])]
        equal = np.zeros(len(b), np.int64)
        for lo in range(0, mins.shape[1], BATCH):
            hi = min(lo + BATCH, mins.shape[1])
            equal += (mins[b, lo:hi] == mins[a, lo:hi]).sum(axis=1)
            go = equal >= least_equal(hi, percent)
            b, equal = b[go], equal[go]
        for c in b.tolist():
            if of[c] == of[a]:  # joined meanwhile
                continue
            common = len(np.intersect1d(sets[a], sets[c], assume_unique=True))
            if 100 * common >= percent * (n[a] + n[c] - common):
                forest.append((a, c))
                x, y = sorted((of[a], of[c]))
                of[of == y] = x
    return forest


def linked(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): the forest of each two tiles t1, t2 of rows(t1, t2, tile, cid, sigs, elements)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, {}

        def done() -> pa.RecordBatch:
            ids, rows = np.array(list(group), np.int64), list(group.values())
            forest = links(np.array([r[0] for r in rows]), [r[1] for r in rows], [r[2] for r in rows], percent)
            return pa.RecordBatch.from_arrays([pa.array(ids[[p[i] for p in forest]] if forest else ids[:0]) for i in range(2)], ["a", "b"])

        for b in batches:
            t1, t2, tile, cid = (b.column(i).to_pylist() for i in range(4))
            for i in range(b.num_rows):
                if (t1[i], t2[i]) != key:
                    if group:
                        yield done()
                    key, group = (t1[i], t2[i]), {}
                if cid[i] not in group:  # tasks may have given a set twice
                    group[cid[i]] = tile[i], b.column(4)[i].values.to_numpy(), np.array(b.column(5)[i].values.to_numpy()).view(np.uint64)
        if group:
            yield done()

    rows = rows.select("t1", "t2", "tile", "cid", "sigs", "elements").repartition("t1", "t2").sortWithinPartitions("t1", "t2", "cid")
    return rows.mapInArrow(run, "a bigint, b bigint")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id, kept, text_key, group_key): for each row its set's size, the smallest
    id that its links reach, whether that is its own, the xxhash64 of its text, and a number of its component
    (null without shingles)."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("x"), F.col(text_col).alias("text"))
    ready = cut(prepared(docs, words))
    key = ["k1", "k2", "n"]
    some = ready.filter("n > 0")
    classes = some.groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x")).alias("row"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    heads = cut(ready.select("doc_id", "x", *key))
    # buckets that hold two classes or more; extremes are found before rows are brought together
    sigs = cut(some.select("k1", F.explode("sigs").alias("sig")).distinct())
    drop(ready)
    full = sigs.groupBy("sig").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).filter("lo <> hi").select("sig")
    alive = cut(sigs.join(full, "sig").join(classes.select("k1", "cid"), "k1").select("sig", "cid"))
    drop(sigs)
    placed = cut(jj.tiled(alive, classes.select("cid", "n")))
    at = cut(alive.join(placed.select("cid", "tile"), "cid"))
    drop(alive)
    # of each bucket its tiles, two by two
    spots = at.select("sig", "tile").distinct()
    spread = spots.join(spots.groupBy("sig").count().filter("count > 1").select("sig"), "sig")
    across = spread.alias("s").join(spread.alias("t"), F.expr("s.sig = t.sig and s.tile < t.tile")).select("s.sig", F.col("s.tile").alias("t1"), F.col("t.tile").alias("t2"))
    within = at.select("sig", F.col("tile").alias("t1"), F.col("tile").alias("t2"), "tile", "cid")
    apart = at.join(across, "sig").filter("tile = t1 or tile = t2").select("sig", "t1", "t2", "tile", "cid")
    members = within.union(apart).groupBy("t1", "t2", "tile", "cid").agg(F.collect_list("sig").alias("sigs"))  # BANDS at most
    # the text of one row of each class
    wanted = placed.select("cid").join(classes.select("cid", "row"), "cid").select("cid", F.col("row.doc_id").alias("id"), F.col("row.x").alias("h"))
    wanted, _ = small_or_not(wanted)
    sets = cut(jj.shingle_sets(docs.join(wanted, docs.x.eqNullSafe(wanted.h) & docs.doc_id.eqNullSafe(wanted.id)).select("cid", "text"), words))
    pairs = cut(linked(members.join(sets, "cid"), percent))
    drop(at, placed, sets, wanted)
    labels = components(pairs)
    named = classes.select("cid", *key, "class_id").join(labels.select(F.col("id").alias("cid"), "component"), "cid", "left")
    named = cut(named.withColumn("component", F.coalesce("component", "cid")))
    least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = cut(named.join(least, "component").select(*key, "component_id", F.col("component").alias("group_key")))
    drop(pairs, labels, classes)
    out = heads.join(named, key, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("group_key").isNull()))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept", F.col("x").alias("text_key"), "group_key")


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """docs without near-duplicates: of each group one row, with the smallest id (rows without shingles stay)."""
    found = duplicates(docs, id_col, text_col, percent, words)
    first = found.filter("group_key is not null").groupBy("group_key").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_key").alias("x"))).alias("row"))
    rows = docs.withColumns({"__id": F.col(id_col).cast("bigint"), "__x": F.xxhash64(text_col), "__r": F.monotonically_increasing_id()})
    rows = cut(rows)
    keep = first.select(F.col("row.id").alias("__id"), F.col("row.x").alias("__x"))
    one = rows.join(keep, rows["__id"].eqNullSafe(keep["__id"]) & rows["__x"].eqNullSafe(keep["__x"])).groupBy(rows["__id"], rows["__x"]).agg(F.min("__r").alias("__r"))
    bare = found.filter("group_key is null").select(F.col(id_col).alias("__id"), F.col("text_key").alias("__x")).distinct()
    alone = rows.join(bare, rows["__id"].eqNullSafe(bare["__id"]) & rows["__x"].eqNullSafe(bare["__x"]), "left_semi").select("__r")
    return rows.join(one.select("__r").union(alone), "__r", "left_semi").select(*docs.columns)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def components_sql(words: int, percent: int) -> str:
    """DuckDB SQL of tables s (doc_id, n_shingles) and c (doc_id, component_id), by a join on shingles."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(list_slice(w, i, i + {words - 1}), ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
s AS (SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles FROM w LEFT JOIN n ON n.doc_id = w.doc_id),
h AS (SELECT doc_id, hash(g) AS g FROM e),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {percent} * (x.n + y.n - common)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reach FROM w UNION SELECT r.id, t.b FROM r JOIN t ON t.a = r.reach),
c AS (SELECT id AS doc_id, min(reach) AS component_id FROM r GROUP BY id)
"""


OP12_SQL = components_sql(WORDS, PERCENT) + "SELECT s.doc_id, n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.doc_id = s.doc_id"
