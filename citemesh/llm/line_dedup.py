"""Line deduplication by pairwise alignment.

Documents that share a line, by its hash, overlap; a line shorter than 25 characters counts together with
the lines next to it, up to 25, as shorter blocks never go. The partner that a later text gets through a
hash is the hash's first holder, rare or not, so the pairs grow with the lines that texts share, never with
the square of a hash's holders. Each pair is aligned by patience diff over its lines' hashes: common ends,
then the longest increasing run of lines unique on both sides, then between them. What a diff can't hold,
as the block was moved or is repeated, is aligned by itself. Aligned blocks of at least 25 characters go
from the later document, and blank lines with the lines on both sides of them.

So a line goes if and only if it lies in a block of at least 25 characters that an earlier text has too:
each line of a block lies in one of its shortest runs of that length, and the run's first holder is a
partner. The same texts lose the same lines, however many others hold them. Texts are judged as they came.

Texts move as 64-bit hashes and lengths of their lines. Equal texts are one text, its first holder's; their
later copies go whole, if they have 25 characters, and count one partner.

Edge cases: null and empty texts have no lines to share; blank lines share nothing, but count inside a
block; rows repeated with one id and text are one document and get the same result; several texts of one
id, and of rows without an id, are documents of their own in the order of their hash; a null id comes
last; extra columns are not read; an empty table gives no rows. A text of any length is one row of hashes,
and a pair takes memory in proportion to its lines.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, drop, slices

MIN_CHARS = 25
LAST_ID = (1 << 63) - 1
KEY = "struct<id:bigint,a:bigint,b:bigint>"


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Aligned (place in a, place in b), in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: i for i, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and in_a.get(x) == 1}
        common = [(i, where[x]) for i, x in enumerate(a[a0:a1], a0) if x in where]
        if not common:
            continue
        # longest increasing run of places in b
        tails: list[int] = []
        ends: list[int] = []
        back = [-1] * len(common)
        for k, (_, j) in enumerate(common):
            at = bisect_left(tails, j)
            if at == len(tails):
                tails.append(j)
                ends.append(k)
            else:
                tails[at], ends[at] = j, k
            back[k] = ends[at - 1] if at else -1
        chain, k = [], ends[-1]
        while k >= 0:
            chain.append(common[k])
            k = back[k]
        chain.reverse()
        last = (a0, b0)
        for i, j in chain:
            todo.append((last[0], i, last[1], j))
            last = (i, j)  # the next segment starts with this pair
        todo.append((last[0], a1, last[1], b1))
    return sorted(out)


def blocks(a: Sequence, b: Sequence, sizes: Sequence, min_chars: int = MIN_CHARS) -> list[tuple[int, int]]:
    """Ranges of b's lines that are aligned to consecutive lines of a and long enough; sizes: of b's lines."""
    out, run = [], []
    for i, j in [*patience(a, b), (-2, -2)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(sizes[x] for _, x in run) >= min_chars:
                out.append((run[0][1], run[-1][1] + 1))
            run = []
        run.append((i, j))
    return out


def runs(size: Sequence, min_chars: int = MIN_CHARS) -> set[tuple[int, int]]:
    """Ranges of lines of these sizes: for each line the shortest from it on, and the shortest up to it, of
    min_chars."""
    out = set()
    lo = total = 0
    for hi, n in enumerate(size, 1):
        total += n
        while total - size[lo] >= min_chars:
            out.add((lo, hi))
            total -= size[lo]
            lo += 1
        if total >= min_chars:
            out.add((lo, hi))
    # from each line on: the first end that is far enough
    hi = total = 0
    for lo, n in enumerate(size):
        while hi < len(size) and total < min_chars:
            total += size[hi]
            hi += 1
        if total >= min_chars:
            out.add((lo, hi))
        total -= n
    return {(a, b) for a, b in out if size[a] and size[b - 1]}


def shared_lines(a: Sequence, a_sizes: Sequence, b: Sequence, sizes: Sequence, min_chars: int = MIN_CHARS) -> list[int]:
    """Places of b's lines in blocks aligned with a: the diff's, then those that it can't hold in order."""
    gone = {x for r in blocks(a, b, sizes, min_chars) for x in range(*r)}
    in_a = set(a)
    left = [(lo, hi) for lo, hi in runs(sizes, min_chars) if b[lo] in in_a and b[hi - 1] in in_a and not gone.issuperset(range(lo, hi))]
    if left:
        one, two = np.array(a, np.int64).tobytes(), np.array(b, np.int64).tobytes()
        there = {one[8 * lo : 8 * hi] for lo, hi in runs(a_sizes, min_chars)}
        gone.update(x for lo, hi in left if two[8 * lo : 8 * hi] in there for x in range(lo, hi))
    return sorted(gone)


def with_blanks(lines: Sequence[str], lost: set[int]) -> set[int]:
    """The lost lines that aren't blank, and the blank ones between two of them that no other line parts."""
    out, blank, before = set(), [], False
    for i, line in enumerate(lines):
        if not line.strip():
            blank.append(i)
            continue
        if i in lost:
            out.add(i)
            out.update(blank if before else ())
        before, blank = i in lost, []
    return out


def _signed(data: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(data), "big", signed=True)


def prepared(docs: DataFrame) -> DataFrame:
    """(k, lines, sizes, runs, total) of docs(k, text): hashes and lengths of a text's lines, the hashes by
    which it meets others, and the sum of the lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                hashes, lengths, held = [], [], []
                for text in texts[lo:hi]:
                    lines = (text or "").split("\n")
                    own = [_signed(x.encode("utf-8", "surrogatepass")) for x in lines]
                    size = [len(x.strip()) for x in lines]
                    packed = np.array(own, np.int64).tobytes()
                    hashes.append(own)
                    lengths.append(size)
                    held.append(list({own[a] if b == a + 1 else _signed(packed[8 * a : 8 * b]) for a, b in runs(size)}))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(hashes, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int32())), pa.array(held, pa.list_(pa.int64())), pa.array([sum(x) for x in lengths], pa.int64())], ["k", "lines", "sizes", "runs", "total"])

    return docs.select("k", "text").mapInArrow(run, f"k {KEY}, lines array<bigint>, sizes array<int>, runs array<bigint>, total bigint")


def partners(held: DataFrame) -> DataFrame:
    """(later, first): the keys of each text and of the first holders of its hashes; held(k, r): the hashes
    that each holds."""
    # written, so that the join reads two shuffles and a frequent hash can be split over tasks
    n = cut(held.groupBy("r").agg(F.min("k").alias("first"), F.count("*").alias("n")).filter("n > 1").select("r", "first"))
    return held.join(n, "r").filter("k <> first").select(F.col("k").alias("later"), "first").distinct()


def aligned(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(k, gone) for each pair that leaves something to delete: places of lines of the later text k."""
    one = texts.select(F.col("k").alias("first"), F.col("lines").alias("a"), F.col("sizes").alias("a_sizes"))
    two = texts.select(F.col("k").alias("later"), F.col("lines").alias("b"), "sizes")
    both = pairs.join(one, "first").join(two, "later").select(F.col("later").alias("k"), "a", "a_sizes", "b", "sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                gone = [shared_lines(*(x.as_py() for x in pair)) for pair in zip(*part.columns[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(gone, pa.list_(pa.int32()))], ["k", "gone"])

    return both.mapInArrow(run, f"k {KEY}, gone array<int>").filter("size(gone) > 0")


def remove_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_lines, n_deleted, n_partners, kept_md5[, kept]) for each row; n_deleted counts lines, n_partners
    the earlier texts that a block is aligned with, the first holders of its hashes."""
    key = F.struct(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text_col).alias("a"), F.xxhash64(F.lit(7), text_col).alias("b"))
    docs = df.select(key.alias("k"), F.col(text_col).alias("text"))
    texts = cut(prepared(docs))
    copies = cut(texts.groupBy("k.a", "k.b").agg(F.min("k").alias("first"), F.max("k").alias("last")).filter("first <> last"))
    later = cut(texts.select("k", "k.a", "k.b", "total").join(copies, ["a", "b"]).filter("k <> first").select("k", "total").distinct())
    alone = cut(texts.join(later, "k", "left_anti").dropDuplicates(["k"]))
    drop(texts)
    pairs = cut(partners(alone.select("k", F.explode("runs").alias("r"))))
    gone = cut(aligned(pairs, alone))
    gone = gone.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"), F.count("*").alias("n_partners"), F.lit(False).alias("whole"))
    gone = gone.union(later.filter(f"total >= {MIN_CHARS}").select("k", F.lit(None).cast("array<int>"), F.lit(1).cast("bigint"), F.lit(True)))
    rows = df.select(F.col(id_col), F.col(text_col).alias("text"), key.alias("k")).join(gone, "k", "left")
    kind = df.schema[id_col].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                part, out = batch.slice(lo, hi - lo), []
                for text, places, whole in zip(texts[lo:hi], part.column(2).to_pylist(), part.column(4).to_pylist(), strict=True):
                    lines = text.split("\n") if text else []
                    lost = set(range(len(lines))) if whole else with_blanks(lines, set(places or ()))
                    kept = "\n".join(x for i, x in enumerate(lines) if i not in lost)
                    out.append((len(lines), len(lost), hashlib.md5(kept.encode("utf-8", "surrogatepass")).hexdigest(), kept))
                cols = [part.column(0), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), part.column(3), pa.array([r[2] for r in out])]
                names = ["id", "n_lines", "n_deleted", "n_partners", "kept_md5"]
                if with_text:
                    cols, names = [*cols, pa.array([r[3] for r in out])], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(cols, names)

    made = rows.select(id_col, "text", "gone", F.coalesce("n_partners", F.lit(0)).alias("n_partners"), F.coalesce("whole", F.lit(False)).alias("whole"))
    return made.mapInArrow(apply, f"id {kind}, n_lines bigint, n_deleted bigint, n_partners bigint, kept_md5 string" + ", kept string" * with_text).withColumnRenamed("id", id_col)
