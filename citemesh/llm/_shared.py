"""What the operators of this subpackage share: lineage cuts in the cluster's shared folder,
size-checked broadcasts, name-safe columns, Arrow helpers and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast, and bytes of its compressed file: bounds, whatever the input's size.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 8 << 20
#: Spark's setting that deletes a query's shuffle files when the query ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LEFT: dict[str, weakref.ref] = {}


def setting(spark: SparkSession, key: str, default: str | None = None) -> str | None:
    """A session setting, or the one the context was started with."""
    return spark.conf.get(key, None) or spark.sparkContext.getConf().get(key) or default


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. One of our own only where it is unset and all
    runs on this machine."""
    found = setting(spark, "spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="citemesh-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


@atexit.register
def _sweep() -> None:
    for path, ref in list(_LEFT.items()):
        spark = ref()
        try:
            if spark is not None:
                _delete(spark, path)
        except Exception:  # the session has ended; the folder's owner clears it
            return


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, so a lost
    executor costs a re-read and each row is computed once; the shuffles behind it go when it is written.
    Nullability widens as Parquet's does."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    was = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, was or "false")
    _LEFT[path] = weakref.ref(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Deletes tables made by cut() that no later plan reads."""
    for df in cuts:
        path = getattr(df, "_cut_path", None)
        if path:
            _LEFT.pop(path, None)
            _delete(df.sparkSession, path)


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """A cut of df, broadcast if it has at most `rows` rows in files of BROADCAST_BYTES, and whether it is."""
    df = cut(df)
    fs, p = _folder(df.sparkSession, df._cut_path)
    few = fs.getContentSummary(p).getLength() <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows
    return (F.broadcast(df), True) if few else (df, False)


def join_hot(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 16, rows: int = BROADCAST_ROWS) -> DataFrame:
    """big joined with small (unique in `on`) where a key of big may hold any share of its rows:
    broadcast behind a count of small, else salted on both sides."""
    small, few = small_or_not(small, rows)
    if few:
        return big.join(small, on, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # a salt from the row itself, so that a repeated task deals its rows as before
    return big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")).join(salted, [*on, "__salt"], how).drop("__salt")


def utf8(col: str | Column) -> Column:
    return F.encode(col if isinstance(col, Column) else F.col(col), "UTF-8")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(texts: list, weight=len, most: int = 4 << 20):
    """Index ranges of a batch whose weights add up to about `most`, so that memory doesn't follow
    the size of a batch; one text is never split here."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        total += weight(t) if t is not None else 0
        if total >= most:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def column_slices(column: pa.Array, most: int = 1 << 20):
    """slices() of an Arrow column of texts by their bytes, before any is made a Python object."""
    yield from slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), weight=int, most=most)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id each id of `edges` reaches. Labels spread along edges and
    jump to their label's label, so rounds grow with the logarithm of a path's length; each round is
    written to the shared folder. No component, however large, is gathered anywhere."""
    both = cut(edges.select(F.col(a).alias("s"), F.col(b).alias("d")).union(edges.select(F.col(b), F.col(a))).filter("s <> d").distinct())
    labels = cut(both.groupBy(F.col("s").alias("id")).agg(F.least(F.col("id"), F.min("d")).alias("component")))
    while True:
        near = both.join(labels, both.d == labels.id).groupBy("s").agg(F.min("component").alias("c"))
        wide = labels.join(near, labels.id == near.s).select("id", F.col("component").alias("was"), F.least("component", "c").alias("component"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = cut(wide.join(up, "component", "left").select("id", "was", F.least("component", F.coalesce("up", "component")).alias("component")))
        changed = new.filter("was <> component").limit(1).count()
        drop(labels)
        labels = new
        if not changed:
            break
    drop(both)
    out = labels.select("id", "component")
    out._cut_path = getattr(labels, "_cut_path", None)
    return out
