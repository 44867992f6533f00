"""Table operators: first rows, fills, upserts, ordinals, buckets, splits and masks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import recode, spark_type
from .storage import stored


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """A row for each key, the first in order (nulls first); rows that tie are told apart by all their
    columns. A minimum, which is taken map-side first, so that a common key is no single task's."""
    rest = [c for c in df.columns if c not in keys]
    if not rest or any(t.startswith("map") for _, t in df.dtypes) or any(isinstance(o, Column) for o in order):
        return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
    by = F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), *(F.col(c) for c in rest))
    first = df.groupBy(*keys).agg(F.min(by).alias("__first"))
    return first.select(*((F.col(c) if c in keys else F.col(f"__first.{c}").alias(c)) for c in df.columns))


def top_n(df: DataFrame, keys: list[str], order: list[str | Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def project_properties(df: DataFrame, rules: list[dict], only_renamed: bool = True) -> DataFrame:
    """Renames and casts by rules old/new/type; unknown types raise."""
    made = [F.col(r["old"]).cast(spark_type(r["type"])).alias(r["new"]) for r in rules]
    used = {r["old"] for r in rules}
    return df.select(*made, *([] if only_renamed else [c for c in df.columns if c not in used]))


def fill_tiers(df: DataFrame, key: str, target: str, tiers: list[DataFrame], source: str | None = None) -> DataFrame:
    """Null targets are filled from the first tier (key, target) that has a value; `source` names the tier."""
    out = df
    for i, t in enumerate(tiers):
        out = out.join(t.select(key, F.col(target).alias(f"__t{i}")), key, "left")
    tiers_cols = [F.col(f"__t{i}") for i in range(len(tiers))]
    if source:
        out = out.withColumn(source, reduce(lambda w, x: w.when(x[1].isNotNull(), F.lit(x[0] + 1)), enumerate(tiers_cols), F.when(F.col(target).isNotNull(), F.lit(0))))
    return out.withColumn(target, F.coalesce(F.col(target), *tiers_cols)).drop(*(f"__t{i}" for i in range(len(tiers))))


def upsert(old: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Batch rows set all properties the batch lists, null included; other properties and rows stay."""
    listed = [c for c in batch.columns if c not in keys]
    new = batch.select(*keys, *(F.col(c).alias(f"__{c}") for c in listed), F.lit(True).alias("__new"))
    joined = old.join(new, keys, "full")
    cols = [F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in old.columns else F.col(f"__{c}").alias(c) for c in listed]
    return joined.select(*keys, *(c for c in old.columns if c not in keys and c not in listed), *cols)


def minmax(c: str, group: list[str] | None = None) -> Column:
    w = Window.partitionBy(*(group or []))
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.try_divide(F.col(c) - lo, (hi - lo).cast("double"))


def minmax_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min-max scaling by an aggregate that is one row, so nothing is gathered in one task."""
    ends = df.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.crossJoin(F.broadcast(ends))
    return out.withColumns({c: F.try_divide((F.col(c) - F.col(f"__lo_{c}")).cast("double"), (F.col(f"__hi_{c}") - F.col(f"__lo_{c}")).cast("double")) for c in columns}).drop(*ends.columns)


def surrogate_ids(df: DataFrame, order: list[str], start: int | Column = 0, name: str = "id") -> DataFrame:
    """Gapless ids from `start` in the given order. Rows are sorted over range partitions; a partition's
    offset comes from the sizes of those before it."""
    s = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    s = s.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    s = stored(s)  # both uses must see one sort, on whichever executors
    sizes = s.groupBy("__p").count()
    before = sizes.withColumn("__b", F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).select("__p", F.coalesce("__b", F.lit(0)).alias("__b"))
    first = F.lit(start) if isinstance(start, int) else start
    return s.join(F.broadcast(before), "__p").withColumn(name, (first + F.col("__b") + F.col("__i") - 1).cast("bigint")).drop("__p", "__i", "__b")


def positions(df: DataFrame, order: list[str], name: str = "pos", total: str | None = None) -> DataFrame:
    """0-based place in a total order, and the number of rows."""
    out = surrogate_ids(df, order, 0, name)
    return out if total is None else out.crossJoin(F.broadcast(df.agg(F.count("*").alias(total))))  # one row


def pivot_counts(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(key).pivot(column, values).count().na.fill(0, values)


def match_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("n"), *((F.try_divide(F.count(c).cast("double"), F.count("*"))).alias(f"{c}_rate") for c in columns))


def date_buckets(starts: DataFrame, until: Column, frequency: str = "monthly", start: str = "start") -> DataFrame:
    """(bucket_start, bucket_end): ends are the day before the next start, but the next start itself if
    daily; the last, open bucket is dropped."""
    step = {"monthly": "interval 1 month", "weekly": "interval 7 days", "daily": "interval 1 day"}[frequency]
    rows = starts.select(F.explode(F.sequence(F.col(start).cast("date"), until.cast("date"), F.expr(step))).alias("bucket_start"))
    nxt = F.lead("bucket_start").over(Window.orderBy("bucket_start"))
    return rows.withColumn("bucket_end", nxt if frequency == "daily" else F.date_sub(nxt, 1)).filter("bucket_end is not null")


def range_filter() -> Column:
    """A bucket's range as a search filter."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd'T'00:00:00'Z'")
    return F.format_string("[%s TO %s]", day("bucket_start"), day("bucket_end"))


def range_filters(buckets: DataFrame) -> DataFrame:
    return buckets.select(range_filter().alias("filter"))


def walk_forward(df: DataFrame, order: list[str], train_fraction: float = 0.6, n_splits: int = 1, test_fraction: float | None = None) -> DataFrame:
    """(split, part) for each row in time order: fold k tests the next test_size rows behind its training
    rows; with one split the last test_size rows are tested."""
    rows = positions(df, order, total="__n")
    test = 1 - train_fraction if test_fraction is None else test_fraction
    size = F.greatest(F.lit(1), F.bround(F.col("__n") * test).cast("int")) if n_splits == 1 else F.greatest(F.lit(1), F.floor(F.col("__n") / (n_splits + 1)).cast("int"))
    rows = rows.withColumn("__size", size).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    begin = F.col("__n") - (n_splits - F.col("split")) * F.col("__size")
    part = F.when(F.col("pos") < begin, "train").when(F.col("pos") < begin + F.col("__size"), "test")
    return rows.withColumn("part", part).filter("part is not null").drop("__n", "__size")


def position_masks(df: DataFrame, order: list[str], train: float = 0.6, val: float = 0.2) -> DataFrame:
    rows = positions(df, order, total="__n")
    a, b = F.floor(F.col("__n") * train), F.floor(F.col("__n") * val)
    return rows.withColumns({"train": F.col("pos") < a, "val": (F.col("pos") >= a) & (F.col("pos") < a + b), "test": F.col("pos") >= a + b}).drop("__n")


def temporal_split(df: DataFrame, year: str, train_fraction: float = 0.6) -> DataFrame:
    """Adds `part`: training years are those up to the largest whose cumulative share is within the
    fraction; no year is divided."""
    n = df.groupBy(year).count()
    w = Window.orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    share = n.select(year, (F.sum("count").over(w) / F.sum("count").over(Window.partitionBy())).alias("__share"))
    last = share.filter(F.col("__share") <= train_fraction).agg(F.max(year).alias("__last"))
    return df.crossJoin(F.broadcast(last)).withColumn("part", F.when(F.col(year) <= F.col("__last"), "train").otherwise("test")).drop("__last")


def condense_recode(df: DataFrame, renames: dict[str, str], skip: list[str], codes: dict[str, dict]) -> DataFrame:
    """Survey recode: columns are dropped, renamed, and their codes turned to labels."""
    return df.select(*((recode(F.col(c), codes[c]) if c in codes else F.col(c)).alias(renames.get(c, c)) for c in df.columns if c not in skip))


def pages(hits: int, page: int = 25_000) -> int:
    return max(1, math.ceil(hits / page))
