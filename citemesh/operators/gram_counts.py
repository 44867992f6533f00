"""Counts of n-grams by keys of their terms. A task counts what it reads and sends sorted keys and counts, packed,
a row for each bucket of keys and cluster; terms' texts are only made for the few that are asked for.

A key is 60 bits and its bucket's number (10 bits more for a thousand buckets) of two mixes of the tokens' 64-bit hashes. Of
three billion terms any two share all of that with a probability of 0.4 percent; they would count as one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: N-grams that a task holds before it sends their counts, tokens it takes at once, n-grams for a bucket and fewest buckets.
HELD, AT_ONCE, PER_BUCKET, BUCKETS = 1 << 21, 1 << 20, 1 << 21, 32
_MIX = tuple(np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def pack(a: np.ndarray) -> bytes:
    """Unsigned numbers by their lower bytes, as many as the largest needs, each byte's place together."""
    width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    width = len(b) // n if n else 0
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


def keys(hashes: np.ndarray, at: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, bucket) of the n-grams that start at these places."""
    x = np.full(len(at), n, np.uint64)
    y = x + _MIX[2]
    for j in range(n):
        h = hashes[at + j]
        x, y = _stirred(x ^ h) * _MIX[2], _stirred(y + h * _MIX[3])
    return x >> np.uint64(4), (y & np.uint64(buckets - 1)).astype(np.int32)


def places(length: np.ndarray, must: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place among all tokens, row) of the n-grams of rows of so many tokens: all, or those that hold the token `must`."""
    first = np.where(must < 0, 0, np.maximum(must - n + 1, 0))
    last = np.where(must < 0, length - n, np.minimum(length - n, must))
    count = np.maximum(last - first + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    begin = np.cumsum(length) - length + first - (np.cumsum(count) - count)
    return begin[row] + np.arange(len(row)), row


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about AT_ONCE tokens at a time; a row is never divided."""
    for b in batches:
        ends, at = np.cumsum(pc.list_value_length(b.column("hashes")).to_numpy(zero_copy_only=False)), 0
        while at < b.num_rows:
            till = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            yield b.slice(at, till - at)
            at = till


def _grams(b: pa.RecordBatch, sizes: tuple[int, ...], buckets: int, codes: dict):
    """(n, place, cluster's code, key, bucket) of the n-grams of some rows."""
    length = pc.list_value_length(b.column("hashes")).to_numpy(zero_copy_only=False)
    hashes = b.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    cluster = b.column("cluster").dictionary_encode(null_encoding="encode")
    code = np.array([codes.setdefault(v, len(codes)) for v in cluster.dictionary.to_pylist()], np.int64)[cluster.indices.to_numpy()]
    for n in sizes:
        at, row = places(length, b.column("must").to_numpy(), n)
        yield n, at, code[row], *keys(hashes, at, n, buckets)


def _sums(order: tuple[np.ndarray, ...], count: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of some columns, sorted by the last one first, and the sums of their counts."""
    by = np.lexsort(order)
    cols = [c[by] for c in order]
    new = np.ones(len(by), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    start = np.flatnonzero(new)
    sums = np.diff(start, append=len(by)) if count is None else np.add.reduceat(count[by], start) if len(by) else count
    return [c[start] for c in cols], sums


def counts(rows: DataFrame, sizes: tuple[int, ...], buckets: int) -> DataFrame:
    """(bucket, cluster, n, keys, counts) of rows (cluster, hashes, must), packed: each key once for a task's share."""
    kind = rows.schema["cluster"].dataType.simpleString()

    def packed(held: list, names: list, arrow) -> Iterator[pa.RecordBatch]:
        (key, bucket, code), count = _sums(tuple(np.concatenate(c) for c in zip(*held, strict=True)), None)
        start = np.flatnonzero(np.diff(code, prepend=-1) | np.diff(bucket, prepend=-1))
        out = [(bucket[i], names[code[i]], k - i, pack(np.diff(key[i:k], prepend=np.uint64(0))), pack(count[i:k] - 1)) for i, k in zip(start, [*start[1:], len(key)], strict=True)]
        for i in range(0, len(out), 10_000):
            b, c, n, x, y = zip(*out[i : i + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(c, arrow), pa.array(n, pa.int32()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["bucket", "cluster", "n", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, size, arrow = {}, [], 0, None
        for b in _slices(batches):
            arrow = b.schema.field("cluster").type
            for _, _, code, key, bucket in _grams(b, sizes, buckets, codes):
                held.append((key, bucket, code))
                size += len(key)
            if size >= HELD:
                yield from packed(held, list(codes), arrow)
                held, size = [], 0
        if size:
            yield from packed(held, list(codes), arrow)

    return rows.select("cluster", "hashes", "must").mapInArrow(run, f"bucket int, cluster {kind}, n int, keys binary, counts binary")


def best(packed: DataFrame, mean: float, top: int, slack: float) -> DataFrame:
    """(bucket, cluster, square, best, terms) of each bucket: the sum of squares of tf * ln(mean / total), the largest `top` of
    these values, and (key, tf, raw) of all that are not more than `slack` under the least of them."""
    kind = packed.schema["cluster"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        cluster = t.column("cluster").combine_chunks().dictionary_encode(null_encoding="encode")
        n = t.column("n").to_numpy()
        key = np.concatenate([np.cumsum(unpack(b, k)) for b, k in zip(t.column("keys").to_pylist(), n, strict=True)])
        count = np.concatenate([unpack(b, k) for b, k in zip(t.column("counts").to_pylist(), n, strict=True)]).astype(np.int64) + 1
        (code, key), tf = _sums((np.repeat(cluster.indices.to_numpy().astype(np.int64), n), key), count)
        start = np.flatnonzero(np.diff(key, prepend=key[0] + np.uint64(1)))
        total = np.repeat(np.add.reduceat(tf, start), np.diff(start, append=len(key)))
        raw = tf * np.log(mean / total)
        by = np.argsort(code, kind="stable")
        out = []
        for c in np.split(by, np.flatnonzero(np.diff(code[by])) + 1):
            r = raw[c]
            most = np.sort(np.partition(r, len(r) - top)[-top:])[::-1] if len(r) > top else np.sort(r)[::-1]
            keep = c[r >= most[-1] - slack] if len(r) > top else c
            out.append((int(code[c[0]]), float(r @ r), most, [{"key": int(k), "tf": int(f), "raw": float(x)} for k, f, x in zip(key[keep], tf[keep], raw[keep], strict=True)]))
        code, square, most, terms = zip(*out, strict=True)
        kinds = pa.list_(pa.struct([("key", pa.int64()), ("tf", pa.int64()), ("raw", pa.float64())]))
        bucket = t.column("bucket")[0].as_py()
        names = cluster.dictionary.take(pa.array(code))
        return pa.table({"bucket": pa.array([bucket] * len(code), pa.int32()), "cluster": names, "square": pa.array(square), "best": pa.array([m.tolist() for m in most], pa.list_(pa.float64())), "terms": pa.array(terms, kinds)})

    return packed.groupBy("bucket").applyInArrow(run, f"bucket int, cluster {kind}, square double, best array<double>, terms array<struct<key: bigint, tf: bigint, raw: double>>")


def texts(rows: DataFrame, sizes: tuple[int, ...], buckets: int, wanted: pd.Series | None) -> DataFrame:
    """(cluster, bucket, key, term) of the n-grams of rows (cluster, tok, hashes, must) with wanted keys, or of all: each
    once for some rows of a task."""
    kind = rows.schema["cluster"].dataType.simpleString()
    wanted = None if wanted is None else np.unique(wanted.to_numpy()).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen = {}, set()
        for b in _slices(batches):
            tok = b.column("tok").flatten()
            for n, at, code, key, bucket in _grams(b, sizes, buckets, codes):
                if wanted is not None:
                    if not len(wanted):
                        return
                    some = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                    at, code, key, bucket = at[some], code[some], key[some], bucket[some]
                (key, bucket, code), at = _firsts((key, bucket, code), at)
                if wanted is not None:
                    rows = list(zip(key.tolist(), bucket.tolist(), code.tolist(), strict=True))
                    new = np.array([r not in seen for r in rows], bool)
                    seen.update(rows)
                    at, code, key, bucket = at[new], code[new], key[new], bucket[new]
                if not len(key):
                    continue
                term = pc.binary_join_element_wise(*(tok.take(pa.array(at + j)) for j in range(n)), " ")
                names = pa.array(list(codes), b.schema.field("cluster").type).take(pa.array(code))
                yield pa.RecordBatch.from_arrays([names, pa.array(bucket), pa.array(key.astype(np.int64)), term], ["cluster", "bucket", "key", "term"])

    return rows.select("cluster", "tok", "hashes", "must").mapInArrow(run, f"cluster {kind}, bucket int, key bigint, term string")


def _firsts(cols: tuple[np.ndarray, ...], at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of some columns, and for each the place of one."""
    by = np.lexsort(cols)
    new = np.ones(len(by), bool)
    new[1:] = np.logical_or.reduce([c[by[1:]] != c[by[:-1]] for c in cols])
    return [c[by[new]] for c in cols], at[by[new]]


def with_hashes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hashes", F.transform("tok", lambda x: F.xxhash64(x)))
