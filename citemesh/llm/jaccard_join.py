"""N-gram Jaccard join by PartEnum signatures, and its connected components.

A document is the set of its distinct word shingles. Sizes fall into bands that grow by about 1/0.62; a set
carries the tag of its own band and, if a linked set may be that large, the tag of the next, so linked sets
have a tag in common. Under a tag the domain of shingle hashes is cut into partitions of n2 cells, and a
set's signatures are its projections on the subsets of n2 - 1 cells. A subset counts if it holds enough
elements (a few, by tag); one of a partition's subsets survives one difference if all of them count. A
linked set differs in at most d elements, so the first partitions in which d + 1 differences would be
needed to spoil every subset that counts hold one that both sets have: those are given, and no more.
Sets without enough such partitions repeat this under other hashes, level by level.

Equal sets are one class, by a 128-bit fingerprint. Classes that share a signature with another are ordered
by the least signature that reaches them (two steps), so that those alike lie together, and the order is
cut into tiles of bounded size. Each pair of tiles with a signature in common is one group of rows: in it
all pairs with a shared signature are compared exactly, links are counted, and only a spanning forest of
links leaves it. So every pair is compared once, nothing is emitted by pair, and a group's memory is
bounded whatever the size of a bucket; only the work on sets that are all alike but all different grows
with their square, as their links do.

Edge cases: a row is a document, whatever its id. Null or empty texts and texts of white space have no
shingles, no class and no links; component_id is then their own id. Texts under the shingle length are one
shingle. Repeated rows and rows of one id are documents of their own (equal ones form a class). Rows without
an id link like others; component_id is the smallest id there is, null where there is none. Extra columns
are not read, so their names don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import column_slices, components, cut, drop, partitions, small_or_not

WORDS = 4
PERCENT = 85
#: Shingles in a tile.
TILE = 1 << 19
#: Hashes tried for sets with too few cells that count.
LEVELS = 12
#: Bytes of a text whose words are listed at once.
PIECE = 1 << 22
#: Fingerprints a task remembers, so that copies give their signatures once a task.
SEEN = 200_000
_U = np.uint64
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(self) > 200_000:
            self.clear()
        self[word] = h
        return h


def word_hashes(text: str | None, known: WordHash) -> np.ndarray:
    """The hash of each word. Bytes lower-case and split as ASCII only."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out, at = [], 0
    while at < len(data):
        end = _SPACE.search(data, at + PIECE) if at + PIECE < len(data) else None
        stop = end.start() if end else len(data)
        words = data[at:stop].lower().split()
        out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        at = stop
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_hashes(text: str | None, known: WordHash, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    h = word_hashes(text, known)
    if not len(h):
        return h
    n = min(words, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total += h[i : len(h) - n + 1 + i] * (_K[i % 7] + _U(2 * (i // 7)))
    total = mix(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def most_in_reach(n: int, percent: int) -> int:
    """The size of the largest set that may link with one of n elements."""
    return n * 100 // percent


@lru_cache(maxsize=8)
def bands(percent: int = PERCENT, most: int = 1 << 40) -> tuple[int, ...]:
    """The largest size in each band."""
    out, low = [], 1
    while low <= most:
        top = low
        while most_in_reach(top, percent) > top and most_in_reach(top, percent) * 62 <= low * 100:
            top = most_in_reach(top, percent)
        out.append(max(top, most_in_reach(low, percent)))
        low = out[-1] + 1
    return tuple(out)


def differences(n: int, other: int, percent: int) -> int:
    """In how many elements linked sets of those sizes differ at most."""
    return (n + other) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=1024)
def cut_of(tag: int, percent: int) -> tuple[int, int, int]:
    """(partitions, cells in each, least elements of a subset that counts) under a tag."""
    tops = bands(percent)
    spoilt = differences(tops[tag], tops[tag], percent) + 1
    if spoilt <= 4:
        return (spoilt + 1) // 2 + 1, 3, 1
    return (int(spoilt * 1.15) + 3) // 2, 2, 2 if tops[tag] >= 40 else 1


def tags(n: int, percent: int) -> list[tuple[int, int]]:
    """(tag, most differences) of a set of n elements; none where linked sets are equal."""
    tops = bands(percent)
    band, reach = int(np.searchsorted(tops, n)), most_in_reach(n, percent)
    out = [(band, differences(n, min(reach, tops[band]), percent))]
    if reach > tops[band]:
        out.append((band + 1, differences(n, reach, percent)))
    return [x for x in out if x[1]]


def signatures(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a sorted set."""
    out = []
    for tag, most in tags(len(hashes), percent) if len(hashes) else []:
        n1, n2, least = cut_of(tag, percent)
        subsets = list(combinations(range(n2), n2 - 1))
        for level in range(LEVELS):
            h = hashes if not level else np.sort(mix(hashes ^ _K[level % 7] + _U(level)))
            cell = ((h >> _U(32)) * _U(n1 * n2) >> _U(32)).astype(np.int64)
            count = np.bincount(cell, minlength=n1 * n2)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ _K[6]))])
            ends = np.concatenate([[0], np.cumsum(count)])
            part = (sums[ends[1:]] - sums[ends[:-1]]).reshape(n1, n2)
            count = count.reshape(n1, n2)
            holds = np.stack([count[:, list(s)].sum(axis=1) >= least for s in subsets], axis=1)
            weight = holds.sum(axis=1) if n2 == 2 else np.where(holds.all(axis=1), 2, holds.any(axis=1))
            given = np.cumsum(weight) - weight <= most  # those before don't suffice
            salt = mix(np.arange(n1, dtype=np.uint64) + _U((tag << 40) + (level << 32)))
            own = np.stack([mix(salt + _U(s) + sum(part[:, j] * _K[j] for j in subset)) for s, subset in enumerate(subsets)], axis=1)
            out.append(own[holds & given[:, None]])
            if weight.sum() > most:
                break
        else:
            out.append(np.array([tag], np.uint64))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _prints(h: np.ndarray) -> tuple[int, int]:
    """A set's fingerprint."""
    return tuple(int(mix(h ^ k).sum(dtype=np.uint64).astype(np.int64)) for k in (_K[3], _K[4]))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)))


def _each(batches: Iterator[pa.RecordBatch], words: int):
    """Of each bounded piece of the batches: the piece, its texts' sets and their fingerprints; text is last."""
    known = WordHash()
    for b in batches:
        for lo, hi in column_slices(b.column(b.num_columns - 1)):
            part = b.slice(lo, hi - lo)
            sets = [shingle_hashes(t, known, words) for t in part.column(b.num_columns - 1).to_pylist()]
            yield part, sets, [_prints(h) for h in sets]


def prepared(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(doc_id, x, n, k1, k2, sigs) of docs(doc_id, x, text): size, fingerprint and signatures of each
    row's set. A set that a task has met already gives no signatures again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for part, sets, prints in _each(batches, words):
            sigs = []
            for h, k in zip(sets, prints, strict=True):
                sigs.append(signatures(h, percent) if k not in seen else h[:0])
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(k)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(h) for h in sets], pa.int64()), *(pa.array([k[i] for k in prints], pa.int64()) for i in range(2)), _lists(sigs)], ["doc_id", "x", "n", "k1", "k2", "sigs"])

    return docs.select("doc_id", "x", "text").mapInArrow(run, "doc_id bigint, x bigint, n bigint, k1 bigint, k2 bigint, sigs array<bigint>")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(cid, elements) of docs(cid, text), once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for part, sets, _ in _each(batches, words):
            ids, new = part.column(0).to_pylist(), []
            for i, c in enumerate(ids):
                if c not in seen:
                    new.append(i)
                    seen.add(c)
            if len(seen) >= SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in new], pa.int64()), _lists([sets[i] for i in new])], ["cid", "elements"])

    return docs.select("cid", "text").mapInArrow(run, "cid bigint, elements array<bigint>")


def tiled(alive: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cid, tile) of alive(sig, cid), sizes(cid, n): classes in the order of the least signature that
    reaches them, cut where the sum of their sizes passes a multiple of TILE."""
    spark = alive.sparkSession
    near = alive.groupBy("cid").agg(F.min("sig").alias("l"))
    for _ in range(2):
        least = alive.join(near, "cid").groupBy("sig").agg(F.min("l").alias("l"))
        near = cut(alive.join(least, "sig").groupBy("cid").agg(F.min("l").alias("l")))
    rows = cut(near.join(sizes, "cid").repartitionByRange(partitions(spark), "l", "cid").sortWithinPartitions("l", "cid").withColumn("p", F.spark_partition_id()))
    sums = rows.groupBy("p").agg(F.sum("n").alias("s"))  # a row for each partition
    before = sums.select("p", (F.sum("s").over(Window.orderBy("p")) - F.col("s")).alias("before"))
    upto = Window.partitionBy("p").orderBy("l", "cid").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("own", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(F.broadcast(before), "p")
    return placed.select("cid", "n", F.floor((F.col("before") + F.col("own")) / F.lit(float(TILE))).cast("int").alias("tile"))


def compare(ids: np.ndarray, tile: np.ndarray, sigs: list[np.ndarray], sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For documents of one or two tiles: each one's number of links, and a spanning forest of the links
    (within the tile, or across the two), by the documents' places. Pairs without a common signature are
    no links."""
    n = np.array([len(s) for s in sets])
    links, forest = np.zeros(len(ids), np.int64), []
    at = np.repeat(np.arange(len(ids)), [len(s) for s in sigs])
    _, bucket = np.unique(np.concatenate(sigs), return_inverse=True)
    order = np.lexsort((at, bucket))
    at, bucket = at[order], bucket[order]
    ends = np.concatenate([np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    starts = np.concatenate([[0], ends[:-1]])
    mine: dict[int, list[int]] = {}
    for k, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if hi - lo > 1:
            for place in at[lo : hi - 1].tolist():  # partners have higher places
                mine.setdefault(place, []).append(k)
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(int(element.max()) + 1 if len(element) else 1, bool)
    both = tile.min() != tile.max()
    up = np.arange(len(ids))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    partner = np.zeros(len(ids), bool)
    for a, buckets in mine.items():
        for k in buckets:
            partner[at[starts[k] : ends[k]]] = True
        partner[: a + 1] = False
        b = np.flatnonzero(partner)
        partner[b] = False
        b = b[100 * np.minimum(n[b], n[a]) >= percent * np.maximum(n[b], n[a])]
        if both:
            b = b[tile[b] != tile[a]]
        if not len(b):
            continue
        own = element[first[a] : first[a + 1]]
        mark[own] = True
        for lo in range(0, len(b), 1024):
            some = b[lo : lo + 1024]
            lengths = n[some]
            skip = np.repeat(first[some] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            hit = np.concatenate([[0], np.cumsum(mark[element[np.arange(len(skip)) + skip]])])
            stop = np.cumsum(lengths)
            common = hit[stop] - hit[stop - lengths]
            some = some[100 * common >= percent * (lengths + n[a] - common)]
            links[a] += len(some)
            links[some] += 1
            for c in some.tolist():
                x, y = root(a), root(c)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    forest.append((a, c))
        mark[own] = False
    return links, forest


def compared(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, links) of rows(t1, t2, tile, cid, sigs, elements): for each class its links in a pair of
    tiles, with b null, and the forest's pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, {}

        def done():
            ids = np.array(list(group), np.int64)
            links, forest = compare(ids, np.array([r[0] for r in group.values()]), [r[1] for r in group.values()], [r[2] for r in group.values()], percent)
            some = np.flatnonzero(links)
            a = np.concatenate([ids[some], ids[[x for x, _ in forest]]])
            b = pa.array([None] * len(some) + ids[[y for _, y in forest]].tolist(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array(np.concatenate([links[some], np.zeros(len(forest), np.int64)]), pa.int64())], ["a", "b", "links"])

        for b in batches:
            t1, t2, tile, cid = (b.column(i).to_pylist() for i in range(4))
            for i in range(b.num_rows):
                if (t1[i], t2[i]) != key:
                    if group:
                        yield done()
                    key, group = (t1[i], t2[i]), {}
                if cid[i] not in group:  # tasks may have given a set twice
                    group[cid[i]] = tile[i], b.column(4)[i].values.to_numpy(), np.array(b.column(5)[i].values.to_numpy())
        if group:
            yield done()

    rows = rows.select("t1", "t2", "tile", "cid", "sigs", "elements").repartition("t1", "t2").sortWithinPartitions("t1", "t2")
    return rows.mapInArrow(run, "a bigint, b bigint, links bigint")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id, class_id, n_links, text_key, group_key): for each row its set's size,
    the smallest id that its links reach, the smallest id with an equal set, the number of other sets that
    its set links with, the xxhash64 of its text, and a number of its component (null without shingles)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("x"), F.col(text_col).alias("text"))
    ready = cut(prepared(docs, percent, words))
    key = ["k1", "k2", "n"]
    some = ready.filter("n > 0")
    classes = some.groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x")).alias("row"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    # buckets by a set's first print: rows that stand next to another one in their bucket
    sigs = some.select("k1", F.explode("sigs").alias("sig")).repartition("sig")
    by = Window.partitionBy("sig").orderBy("k1").rowsBetween(-1, 1)
    shared = sigs.withColumns({"lo": F.min("k1").over(by), "hi": F.max("k1").over(by)}).filter("lo <> hi").select("sig", "k1").distinct()
    shared = cut(shared)
    heads = cut(ready.select("doc_id", "x", *key))
    drop(ready)
    alive = cut(shared.join(classes.select("k1", "cid"), "k1").select("sig", "cid"))
    placed = cut(tiled(alive, classes.select("cid", "n")))
    at = cut(alive.join(placed.select("cid", "tile"), "cid"))
    drop(shared, alive)
    # a group of rows for each two tiles that a bucket has documents in
    spots = at.select("sig", "tile").distinct()
    many = spots.groupBy("sig").count().filter("count > 1").select("sig")
    spread = spots.join(many, "sig")
    across = spread.alias("s").join(spread.alias("t"), F.expr("s.sig = t.sig and s.tile < t.tile")).select("s.sig", F.col("s.tile").alias("t1"), F.col("t.tile").alias("t2"))
    own = at.select("sig", F.col("tile").alias("t1"), F.col("tile").alias("t2"), "tile", "cid")
    far = at.join(across, "sig").filter("tile = t1 or tile = t2").select("sig", "t1", "t2", "tile", "cid")
    members = own.union(far).groupBy("t1", "t2", "tile", "cid").agg(F.collect_list("sig").alias("sigs"))
    # the texts of one row of each class
    wanted = placed.select("cid").join(classes.select("cid", "row"), "cid").select("cid", F.col("row.doc_id").alias("id"), F.col("row.x").alias("h"))
    wanted, _ = small_or_not(wanted)
    texts = docs.join(wanted, docs.x.eqNullSafe(wanted.h) & docs.doc_id.eqNullSafe(wanted.id)).select("cid", "text")
    sets = cut(shingle_sets(texts, words))
    out = cut(compared(members.join(sets, "cid"), percent))
    links = out.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("n_links"))
    labels = components(out.filter("b is not null").select("a", "b"))
    named = classes.select("cid", *key, "class_id").join(labels.select(F.col("id").alias("cid"), "component"), "cid", "left").join(links, "cid", "left")
    named = cut(named.withColumn("component", F.coalesce("component", "cid")).withColumn("n_links", F.coalesce("n_links", F.lit(0))))
    least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = named.join(least, "component").select(*key, "class_id", "component_id", "n_links", F.col("component").alias("group_key"))
    drop(at, placed, sets, out)
    out = heads.join(named, key, "left")
    own = [F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("doc_id")).alias(c) for c in ("component_id", "class_id")]
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), *own, F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("x").alias("text_key"), "group_key")
