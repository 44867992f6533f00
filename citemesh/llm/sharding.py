"""Hilbert-curve sharding [native].

Several metadata dimensions are quantised at their quantiles, the cell's index on a Hilbert curve
orders the rows, and runs of that order become shards: rows near in every dimension lie in the same
files, so readers can skip files by any of the dimensions' ranges.

Law `rows`: shard sizes differ by at most one row. The order is the range-partitioned sort by (curve
index, checksum, id): a third of all rows in one cell, source or group of equal texts still spreads
over many tasks. A rank is a partition's offset plus a row's place in it.

Numbers are cut at approximate quantiles (a mergeable sketch), strings at exact ones, in the order of
their UTF-8 bytes and by their whole length: their distinct values are counted, sorted over range
partitions and summed from partition to partition. Only the cuts come to the driver.

Edge cases: a null in a dimension is its lowest value; a null text has size 8 and a null checksum; an
empty text has size 8 and checksum 0; an empty table gives no rows; repeated rows each take a slot, and
rows that are equal in all that orders them lie in the order they were read, so that any number of them
spreads over tasks; texts of any length are moved whole; columns that the operator adds replace columns of
the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, utf8

SHARDS = 24
BITS = 5


def curve_table(dims: int) -> tuple[list[int], int]:
    """Transitions of the Hilbert curve in `dims` dimensions from Gray codes (entry point, direction):
    for state s and cell bits c, entry s * 2**dims + c holds digit * states + next state."""
    n, full, states = dims, (1 << dims) - 1, dims << dims
    rot = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & full
    gray = lambda i: i ^ (i >> 1)
    inverse = {gray(i): i for i in range(1 << n)}
    trailing = lambda i: next(k for k in range(n + 1) if not i >> k & 1)
    entry = lambda i: 0 if i == 0 else gray(2 * ((i - 1) // 2))
    turn = lambda i: 0 if i == 0 else (trailing(i - 1) if i % 2 == 0 else trailing(i)) % n
    out = []
    for e in range(1 << n):
        for d in range(n):
            for c in range(1 << n):
                digit = inverse[rot(c ^ e, n - (d + 1) % n)]
                to_e, to_d = e ^ rot(entry(digit), d + 1), (d + turn(digit) + 1) % n
                out.append(digit * states + to_e * n + to_d)
    return out, states


def curve_index(cells: list[str], bits: int = BITS) -> Column:
    """The Hilbert index of integer columns below 2**bits, as a JVM expression."""
    n = len(cells)
    table, states = curve_table(n)
    corner = " + ".join(f"shiftleft(cast(shiftright(`{c}`, i) & 1 as int), {k})" for k, c in enumerate(cells))
    step = f"element_at(array({','.join(map(str, table))}), a.s * {1 << n} + {corner} + 1)"
    return F.expr(f"aggregate(sequence({bits - 1}, 0, -1), named_struct('s', 0, 'h', 0L), (a, i) -> named_struct('s', {step} % {states}, 'h', a.h * {1 << n}L + cast({step} div {states} as bigint)), a -> a.h)")


def string_cuts(df: DataFrame, name: str, bits: int = BITS) -> list[str]:
    """The values at the column's 2**bits - 1 quantiles (fewer where one value holds several)."""
    counts = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).count()
    # the ids hold for this one sort only, so they are written down
    counts = cut(counts.repartitionByRange("v").sortWithinPartitions("v").withColumn("at", F.monotonically_increasing_id()))
    counts = counts.withColumn("part", F.shiftright("at", 33))
    sums = counts.groupBy("part").agg(F.sum("count").alias("n"))  # a row for each partition
    sums = sums.select("part", F.expr("sum(n) over (order by part) - n").alias("before"), F.expr("sum(n) over ()").alias("total"))
    upto = counts.withColumn("own", F.expr("sum(count) over (partition by part order by at)")).join(F.broadcast(sums), "part").withColumn("upto", F.col("before") + F.col("own"))
    step = f"(({{}}) * {1 << bits} div total)"
    found = upto.filter(step.format("upto") + " > " + step.format("upto - count")).filter("upto < total")
    return sorted((r["v"] for r in found.select("v").collect()), key=lambda v: v.encode("utf-8", "surrogatepass"))  # fewer than 2**bits


def quantised(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """Adds __c0, __c1, ...: each dimension's cell between its quantiles (at most 2**bits - 1 cuts
    each, the only thing that comes to the driver)."""
    kinds = dict(df.dtypes)
    at = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = [d for d in dims if kinds[d] != "string"]
    found = df.agg(*(F.percentile_approx(F.col(d).cast("double"), at, 10_000).alias(f"q{k}") for k, d in enumerate(numbers))).first() if numbers else []
    cuts = {d: sorted(set(found[k] or ())) for k, d in enumerate(numbers)}
    for k, d in enumerate(dims):
        bounds = cuts[d] if d in cuts else string_cuts(df, d, bits)
        value = F.col(d).cast("double") if d in cuts else F.col(d)
        above = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < value)) if bounds else F.lit(0)
        df = df.withColumn(f"__c{k}", F.when(value.isNull(), 0).otherwise(above).cast("int"))
    return df


def hilbert_shards(df: DataFrame, dims: list[str], shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all, if None) with size, text_crc32, curve, law, shard, slot and grown_shard."""
    added = ["size", "text_crc32", "curve", "law", "shard", "slot", "grown_shard"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in added]
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 8
    df = df.withColumn("size", size).withColumn("text_crc32", F.crc32(utf8(text_col)))
    df = quantised(df, dims, bits)
    df = df.withColumn("curve", curve_index([f"__c{k}" for k in range(len(dims))], bits))
    order = ["curve", "text_crc32", id_col, "__row"]
    df = df.withColumn("__row", F.monotonically_increasing_id()).select(*dict.fromkeys([*keep, "size", "text_crc32", "curve", id_col, "__row"]))
    df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = cut(df.withColumn("__at", F.monotonically_increasing_id()))  # the ids hold for this one sort only, so they are written down
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranked.groupBy(part.alias("__part")).count()  # a row for each sorted partition
    sizes = sizes.select("__part", F.expr("sum(count) over (order by __part) - count").alias("__before"), F.expr("sum(count) over ()").alias("__n"))
    rank = F.col("__before") + F.col("__within")
    out = ranked.withColumn("__part", part).withColumn("__within", within).join(F.broadcast(sizes), "__part").withColumn("__rank", rank)
    out = out.withColumn("shard", F.expr(f"cast(__rank * {shards} div __n as int)"))
    out = out.withColumn("slot", F.expr(f"__rank - (cast(shard as bigint) * __n + {shards - 1}) div {shards}"))
    return out.select(*keep, "size", "text_crc32", "curve", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder for each shard, rows in curve order, so that file statistics prune in every dimension."""
    order = ["shard", "slot"]
    sharded.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("shard").parquet(path)
