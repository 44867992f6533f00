"""Suffix-array deduplication of repeated byte strings.

Removes every byte of a text that lies in a 100-byte string which also starts earlier, in a document of
smaller id or earlier in the same one. Strings are judged on the input; matches never cross documents.

1. Every 100-byte window has an anchor: the 32-byte string with the smallest hash in it, the leftmost if
   several. Equal windows have equal anchors at equal offsets. Anchors are sorted by hash over range
   partitions, so that one repeated by any share of documents lies in many tasks, and those with an equal
   neighbour are kept (a partition's outer rows too, as their neighbours are out of sight).
2. Kept anchors of one text per class of equal texts fetch the bytes of their windows. (A later copy of an
   equal text of 100 bytes or more goes whole and needs no search.)
3. Anchor groups are packed into blocks of bounded size; a long group into several. Of a group's rows with
   equal bytes only the earliest is sorted, the others repeat it whole. A block's windows are
   the suffixes to sort, one bucket of first bytes at a time: by 32 bytes, longer ties by the ranks of the
   difference-cover sample behind them, which are computed once per block. Neighbours with 100 bytes in
   common are equal; all but the earliest are marked. Anchors are laid at multiples of the cover's period,
   so equal windows always reach the sample after the same number of bytes.
4. Where a group has several blocks, their earliest windows meet in a map-side minimum.

Memory is bounded by a block, 1 MB of a long text, and one text where its spans are cut out.

Edge cases: null is empty; texts under 100 bytes lose nothing; a null id comes last; rows repeated with
one id and text are one document and get the same result; several texts of one id, and of rows without an
id, are documents of their own in the order of their MD5: each has a number (`sub`) from a global sort, and
texts are told apart by all 128 bits. An empty table gives no rows; extra columns stay unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, drop, small_or_not, utf8

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1  # anchors to choose from in a window
PERIOD = 32
SEGMENT = 1 << 20
GROUP_ROWS = 4096
BLOCK_BYTES = 3 << 20
BUCKET = 1 << 18
LAST_ID = (1 << 63) - 1
_U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_LOW = _U(127)


def difference_cover(period: int) -> list[int]:
    """Residues such that every difference modulo the period is one of two of them (greedy)."""
    cover, seen = [0, 1], {0, 1, period - 1}
    while len(seen) < period:
        best = max((r for r in range(period) if r not in cover), key=lambda r: (len({(r - c) % period for c in cover} | {(c - r) % period for c in cover} - seen), -r))
        seen |= {(best - c) % period for c in cover} | {(c - best) % period for c in cover}
        cover.append(best)
    return sorted(cover)


COVER = difference_cover(PERIOD)
#: From each residue, bytes to the next sample position.
AHEAD = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))


class Rolling:
    """64-bit polynomial hashes of all substrings of one length in a buffer."""

    def __init__(self):
        self.size = 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 1 << 16)
            self.up, self.down = (self._powers(b) for b in (_B, pow(_B, -1, 1 << 64)))

    def _powers(self, base: int) -> np.ndarray:
        out = np.full(self.size + 1, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def hashes(self, data: np.ndarray, length: int) -> np.ndarray:
        n = len(data)
        self._grow(n)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data] * self.up[:n], out=sums[1:])
        return _mix((sums[length:] - sums[: n + 1 - length]) * self.down[: n + 1 - length])


def anchors(data: np.ndarray, ends: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, ...]:
    """(hash, anchor, first window, last window) for each run of windows with one anchor; ends[i]: where
    the text of byte i ends."""
    n = len(data)
    windows = n - LENGTH + 1
    if windows <= 0:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    gram = rolling.hashes(data, GRAM) & ~_LOW
    m = len(gram)
    rows = -(-m // SPAN)
    key = np.full(rows * SPAN, np.iinfo(np.uint64).max, np.uint64)
    key[:m] = gram
    key = (key.reshape(rows, SPAN) & ~_LOW) | np.arange(SPAN, dtype=np.uint64)
    before = np.minimum.accumulate(key, axis=1).ravel()
    after = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    p = np.arange(windows)
    left, right = after[:windows], before[SPAN - 1 : SPAN - 1 + windows]
    own = (left & ~_LOW) <= (right & ~_LOW)
    best = np.where(own, left, right)
    base = np.where(own, p - p % SPAN, (p + SPAN - 1) - (p + SPAN - 1) % SPAN)
    at = base + (best & _LOW).astype(np.int64)
    good = p + LENGTH <= ends[:windows]
    p, at, best = p[good], at[good], best[good]
    if not p.size:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(p) != 1)]))
    last = np.concatenate([new[1:] - 1, [p.size - 1]])
    return (best[new] >> _U(7)).astype(np.int64), at[new], p[new], p[last]


def text_md5(text: str) -> Column:
    return F.md5(utf8(F.coalesce(F.col(text), F.lit(""))))


def numbered(docs: DataFrame) -> DataFrame:
    """docs(doc, text, ...) with sub: 0 where a doc has one text only, else a number that tells its texts
    apart and rises with their MD5. What is small goes by checked broadcast, else by shuffle on the MD5."""
    slim = docs.select("doc", text_md5("text").alias("m"))
    several = slim.groupBy("doc").agg(F.min("m").alias("a"), F.max("m").alias("b")).filter("a <> b").select("doc")
    several, _ = small_or_not(several)
    order = slim.join(several, "doc", "left_semi").distinct().repartitionByRange("doc", "m").sortWithinPartitions("doc", "m")
    subs, few = small_or_not(order.withColumn("sub", F.monotonically_increasing_id() + 1))
    if few and subs.isEmpty():
        return docs.withColumn("sub", F.lit(0).cast("bigint"))
    return docs.withColumn("m", text_md5("text")).join(subs, ["m", "doc"], "left").drop("m").withColumn("sub", F.coalesce("sub", F.lit(0)))


def all_anchors(docs: DataFrame) -> DataFrame:
    """(h, doc, sub, pos) of every anchor of docs(doc, sub, text); pos packs place and the windows' bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        parts: list[tuple[int, int, int, bytes]] = []
        held = 0

        def flush():
            nonlocal held
            data = np.frombuffer(b"".join(x[3] for x in parts), np.uint8)
            sizes = np.array([len(x[3]) for x in parts])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            h, at, lo, hi = anchors(data, np.repeat(starts + sizes, sizes), rolling)
            of = np.searchsorted(starts, lo, "right") - 1
            ids = np.array([x[0] for x in parts], np.int64)[of]
            subs = np.array([x[1] for x in parts], np.int64)[of]
            place = at - starts[of] + np.array([x[2] for x in parts], np.int64)[of]
            pos = (place << 14) | ((at - lo) << 7) | (at - hi)
            parts.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids), pa.array(subs), pa.array(pos)], ["h", "doc", "sub", "pos"])

        for b in batches:
            for doc, sub, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass") if text.is_valid else b""
                if len(data) < LENGTH:
                    continue
                for s in range(0, len(data) - LENGTH + 1, SEGMENT):
                    parts.append((doc, sub, s, data[s : s + SEGMENT + LENGTH - 1]))
                    held += len(parts[-1][3])
                    if held >= SEGMENT:
                        yield flush()
        if parts:
            yield flush()

    return docs.select("doc", "sub", "text").mapInArrow(run, "h bigint, doc bigint, sub bigint, pos bigint")


def repeated_anchors(found: DataFrame) -> DataFrame:
    """(doc, sub, h, salt, edge, pos) of the anchors with an equal one elsewhere. Rows of one hash are numbered
    into groups (salt) of bounded size; edge: others of that hash may be out of sight."""
    ordered = found.repartitionByRange("h", "doc", "sub", "pos").sortWithinPartitions("h", "doc", "sub", "pos").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # the last row so far, and its number in its run
        first = True

        def out(h, doc, sub, pos, number, keep, edge, part):
            salt = number // GROUP_ROWS + (part << 20)
            cols = [pa.array(x[keep]) for x in (doc, sub, h, salt, edge, pos)]
            return pa.RecordBatch.from_arrays(cols, ["doc", "sub", "h", "salt", "edge", "pos"])

        part = 0
        for b in batches:
            if not b.num_rows:
                continue
            h, doc, sub, pos, parts = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            part, start = int(parts[0]), 0
            if carry is not None:
                h, doc, sub, pos = (np.concatenate([[c], x]) for c, x in zip(carry[:4], (h, doc, sub, pos), strict=True))
                start = carry[4]
            once = np.concatenate([[True], (np.diff(h) != 0) | (np.diff(doc) != 0) | (np.diff(sub) != 0) | (np.diff(pos) != 0)])
            h, doc, sub, pos = h[once], doc[once], sub[once], pos[once]
            new = np.concatenate([[True], np.diff(h) != 0])
            starts = np.flatnonzero(new)
            number = np.arange(len(h)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(h)]])))
            number[: starts[1] if len(starts) > 1 else len(h)] += start
            keep = ~new | (number > 0)
            keep[:-1] |= ~new[1:]
            edge = number >= GROUP_ROWS
            if carry is not None:
                keep[0], edge[0] = keep[0] | carry[6], edge[0] | carry[5]
            if first:  # the partition's first run may go on in the partition before
                keep[0] = edge[0] = True
                first = False
            carry = (h[-1], doc[-1], sub[-1], pos[-1], int(number[-1]), bool(edge[-1]), bool(keep[-1]))
            if len(h) > 1:
                yield out(h[:-1], doc[:-1], sub[:-1], pos[:-1], number[:-1], keep[:-1], edge[:-1], part)
        if carry is not None:
            yield out(*(np.array([carry[i]]) for i in range(5)), np.array([True]), np.array([True]), part)

    return ordered.mapInArrow(run, "doc bigint, sub bigint, h bigint, salt bigint, edge boolean, pos bigint")


def contexts(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """(h, salt, edge, doc, sub, lo, ahead, bytes): for each listed anchor the bytes of its windows, from
    window lo on; the anchor is `ahead` bytes further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "salt", "edge", "doc", "sub", "lo", "ahead", "bytes"]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            for i in range(b.num_rows):
                doc, sub, text = (b.column(k)[i].as_py() for k in range(3))
                data = (text or "").encode("utf-8", "surrogatepass")
                taken = b.column(3)[i].values
                pos = taken.field("pos").to_numpy(zero_copy_only=False)
                x, a, z = pos >> 14, (pos >> 7) & 127, pos & 127
                lo, hi = (x - a).tolist(), (x - z + LENGTH).tolist()
                n = len(lo)
                yield pa.RecordBatch.from_arrays(
                    [taken.field("h"), taken.field("salt"), taken.field("edge"), pa.array([doc] * n, kinds[3]), pa.array([sub] * n, kinds[4]), pa.array(lo, kinds[5]), pa.array(a, kinds[6]), pa.array([data[s:e] for s, e in zip(lo, hi, strict=True)], kinds[7])], names)

    rows = docs.join(lists, ["doc", "sub"]).select("doc", "sub", "text", "list")
    return rows.mapInArrow(run, "h bigint, salt bigint, edge boolean, doc bigint, sub bigint, lo bigint, ahead bigint, bytes binary")


class Block:
    """The windows of some anchor groups, laid out with every anchor at a multiple of the period."""

    def __init__(self, rows: list[tuple]):
        """rows: (group, doc, sub, lo, ahead, bytes)"""
        sizes = np.array([len(r[5]) for r in rows])
        ahead = np.array([r[4] for r in rows])
        starts, at = np.empty(len(rows), np.int64), 0
        for i in range(len(rows)):
            at += (-at - ahead[i]) % PERIOD
            starts[i] = at
            at += sizes[i]
        self.data = np.zeros(at + 4 * LENGTH + 2 * PERIOD, np.uint8)
        for s, r in zip(starts.tolist(), rows, strict=True):
            self.data[s : s + len(r[5])] = np.frombuffer(r[5], np.uint8)
        self.size = at
        counts = sizes - LENGTH + 1
        self.row = np.repeat(np.arange(len(rows)), counts)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.offset = np.arange(len(self.row)) - first[self.row]
        self.place = starts[self.row] + self.offset
        words = np.zeros(len(self.data) - 7, np.uint64)
        for k in range(8):
            words |= self.data[k : len(self.data) - 7 + k].astype(np.uint64) << _U(56 - 8 * k)
        self.words = words
        self.ranks = self.sample_ranks()

    def sample_ranks(self) -> np.ndarray:
        """At each position of the cover sample the rank of what follows, to at least LENGTH bytes: first
        by one period, then doubled, as a sample position plus the period is one again."""
        n = self.size + LENGTH + PERIOD
        at = np.flatnonzero(IN_COVER[np.arange(n) % PERIOD])
        order = np.lexsort([self.words[at + 8 * k] for k in (3, 2, 1, 0)])
        same = np.ones(len(at) - 1, bool)
        for k in range(4):
            w = self.words[at[order] + 8 * k]
            same &= w[1:] == w[:-1]
        rank = np.zeros(n + 4 * PERIOD, np.int64)
        rank[at[order]] = 1 + np.concatenate([[0], np.cumsum(~same)])
        known = PERIOD
        while known < LENGTH:
            a, b = rank[at], np.where(at + known < n, rank[np.minimum(at + known, n)], 0)
            pair = a * (len(at) + 2) + b
            rank[at] = 1 + np.unique(pair, return_inverse=True)[1].ravel()
            known *= 2
        return rank

    def buckets(self) -> Iterator[np.ndarray]:
        """The windows' numbers, by ranges of their first bytes, of about BUCKET each where bytes differ."""
        lead = self.words[self.place]
        if len(lead) <= BUCKET:
            yield np.arange(len(lead))
            return
        edges = np.unique(np.sort(lead[:: max(1, len(lead) // 4096)])[:: max(1, 4096 * BUCKET // len(lead))])
        bucket = np.searchsorted(edges, lead, "right")
        order = np.argsort(bucket, kind="stable")
        yield from np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)

    def classes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows in suffix order, whether each begins a class of equal windows), a bucket at a time."""
        for own in self.buckets():
            place = self.place[own]
            residue = place % PERIOD
            behind = self.ranks[place + AHEAD[residue]]
            order = np.lexsort([behind, residue, *(self.words[place + 8 * k] for k in (3, 2, 1, 0))])
            own, place = own[order], place[order]
            same = np.ones(len(own) - 1, bool)
            for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
                w = self.words[place + k]
                same &= w[1:] == w[:-1]
            yield own, np.concatenate([[True], ~same])


def marked(found: DataFrame) -> DataFrame:
    """(kind, doc, sub, s, e, h, fp): kind 0, bytes [s, e) that start no window's first occurrence; kind 1,
    the earliest occurrence in its block of a window whose group has other blocks."""
    rows = found.repartition("h", "salt").sortWithinPartitions("h", "salt")
    names = ["kind", "doc", "sub", "s", "e", "h", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        groups: list[tuple] = []  # rows of whole groups
        edges: dict[int, bool] = {}
        size = 0

        def solve():
            nonlocal size
            block = Block(groups)
            h = np.array([r[0] for r in groups], np.int64)
            doc, sub, lo = (np.array([r[i] for r in groups], np.int64) for i in (1, 2, 3))
            edge = np.array([r[6] for r in groups], bool)
            dup = np.zeros(len(block.row), bool)
            first_of_edge = []
            p = lo[block.row] + block.offset
            for own, new in block.classes():
                cls = np.cumsum(new) - 1
                r = block.row[own]
                order = np.lexsort([p[own], sub[r], doc[r], cls])
                o, c = own[order], cls[order]
                begins = np.concatenate([[True], np.diff(c) != 0])
                head = o[np.flatnonzero(begins)][c]
                rh, ro = block.row[head], block.row[o]
                dup[o] = (doc[ro] != doc[rh]) | (sub[ro] != sub[rh]) | (p[o] != p[head])
                heads = o[begins]
                first_of_edge.append(heads[edge[block.row[heads]]])
            d = np.flatnonzero(dup)
            cols = [[], [], [], [], [], [], []]
            if d.size:
                cuts = np.concatenate([[True], (np.diff(d) != 1) | (np.diff(block.row[d]) != 0)])
                a = d[cuts]
                z = d[np.concatenate([np.flatnonzero(cuts)[1:] - 1, [d.size - 1]])]
                cols = [np.zeros(len(a), np.int32), doc[block.row[a]], sub[block.row[a]], p[a], p[z] + LENGTH, np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)]
            f = np.concatenate(first_of_edge) if first_of_edge else np.empty(0, np.int64)
            if f.size:
                fp = rolling.hashes(block.data, LENGTH)[block.place[f]].view(np.int64)
                more = [np.ones(len(f), np.int32), doc[block.row[f]], sub[block.row[f]], p[f], p[f] + LENGTH, h[block.row[f]], fp]
                cols = [np.concatenate([a, b]).astype(b.dtype) if len(a) else b for a, b in zip(cols, more, strict=True)]
            groups.clear()
            edges.clear()
            size = 0
            if len(cols[0]):
                return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
            return None

        pending: list[tuple] = []
        whole: list[tuple] = []  # spans that repeat an earlier span byte by byte
        at = None

        def close():
            nonlocal size
            edge = any(r[6] for r in pending) or len(pending) >= GROUP_ROWS
            # rows with all bytes equal are one row, the earliest; the others go whole
            first: dict[tuple, tuple] = {}
            for r in pending:
                same = first.setdefault((r[4], r[5]), r)
                if r[1:4] < same[1:4]:
                    first[r[4], r[5]] = r
            if len(first) < len(pending):
                for r in pending:
                    if r[1:4] != first[r[4], r[5]][1:4]:
                        whole.append((r[1], r[2], r[3], r[3] + len(r[5])))
            # a lone row has no equal here; it matters only to other blocks of its group
            if len(first) > 1 or edge:
                groups.extend((*r[:6], edge) for r in first.values())
                size += sum(len(r[5]) for r in first.values())
            pending.clear()

        def spans():
            n = len(whole)
            cols = [np.zeros(n, np.int32), *(np.array([r[i] for r in whole], np.int64) for i in range(4)), np.zeros(n, np.int64), np.zeros(n, np.int64)]
            whole.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

        for b in batches:
            c = [b.column(i).to_pylist() for i in range(8)]
            for h, salt, edge, doc, sub, lo, ahead, data in zip(*c, strict=True):
                if at != (h, salt):
                    close()
                    at = (h, salt)
                    if size >= BLOCK_BYTES and (out := solve()) is not None:
                        yield out
                    if len(whole) >= 50_000:
                        yield spans()
                pending.append((h, doc, sub, lo, ahead, data, edge))
        close()
        if whole:
            yield spans()
        if groups and (out := solve()) is not None:
            yield out

    return rows.mapInArrow(run, "kind int, doc bigint, sub bigint, s bigint, e bigint, h bigint, fp bigint")


def spans_of(docs: DataFrame) -> DataFrame:
    """(doc, sub, spans, whole): what goes from docs(doc, sub, text); whole: all of it."""
    at = F.struct("doc", "sub")
    keyed = docs.select("doc", "sub", text_md5("text").alias("m"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    classes = cut(keyed.filter(f"n >= {LENGTH}").groupBy("m", "n").agg(F.min(at).alias("first"), F.max(at).alias("last")))
    later = keyed.join(classes.filter("first <> last"), ["m", "n"]).filter(at != F.col("first")).select("doc", "sub").distinct()
    later, _ = small_or_not(later)

    texts = docs.join(later, ["doc", "sub"], "left_anti").select("doc", "sub", "text")
    found = cut(all_anchors(texts))
    again = cut(repeated_anchors(found))
    drop(found)
    lists = again.groupBy("doc", "sub").agg(F.collect_list(F.struct("h", "salt", "edge", "pos")).alias("list"))
    marks = cut(marked(contexts(texts, lists)))
    drop(again, classes)

    firsts = marks.filter("kind = 1")
    order = F.struct("doc", "sub", "s")
    best = firsts.groupBy("h", "fp").agg(F.min(order).alias("best"), F.count("*").alias("n")).filter("n > 1")
    more = firsts.join(best, ["h", "fp"]).filter(order != F.col("best")).select("doc", "sub", "s", "e")
    spans = marks.filter("kind = 0").select("doc", "sub", "s", "e").union(more)
    spans = spans.select("doc", "sub", F.struct("s", "e").alias("span"), F.lit(False).alias("whole"))
    gone = later.select("doc", "sub", F.lit(None).cast("struct<s:bigint,e:bigint>").alias("span"), F.lit(True).alias("whole"))
    return spans.union(gone).groupBy("doc", "sub").agg(F.collect_list("span").alias("spans"), F.max("whole").alias("whole"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary, removed array<struct<s,e>>]) for each row."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = numbered(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)).alias("doc"), F.col(text_col).alias("text")))
    spans = spans_of(docs.select("doc", "sub", "text"))
    rows = docs.join(spans, ["doc", "sub"], "left").select("id", "text", "spans", "whole")
    extra = ", kept binary, removed array<struct<s:bigint,e:bigint>>" if with_bytes else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                out = []
                for i in range(part.num_rows):
                    text = part.column(1)[i].as_py()
                    data = (text or "").encode("utf-8", "surrogatepass")
                    if part.column(3)[i].as_py():
                        cutout = [(0, len(data))]
                    else:
                        cutout = []
                        listed = part.column(2)[i].values
                        if listed is not None and len(listed):
                            s, e = listed.field("s").to_numpy(zero_copy_only=False), listed.field("e").to_numpy(zero_copy_only=False)
                            order = np.argsort(s, kind="stable")
                            s, e = s[order], np.maximum.accumulate(e[order])
                            new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                            cutout = list(zip(s[new].tolist(), e[np.concatenate([new[1:] - 1, [len(s) - 1]])].tolist(), strict=True))
                    kept, at = [], 0
                    for s, e in cutout:
                        kept.append(data[at:s])
                        at = e
                    kept.append(data[at:])
                    kept = b"".join(kept)
                    row = [len(data), len(data) - len(kept), len(cutout), hashlib.sha256(kept).hexdigest()]
                    out.append(row + [kept, [{"s": s, "e": e} for s, e in cutout]] if with_bytes else row)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]
                names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"]
                cols = [pa.array([r[k] for r in out], kinds[k]) for k in range(6 if with_bytes else 4)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names[: len(cols) + 1])

    made = rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{extra}")
    return made.withColumnRenamed("id", id_col)
