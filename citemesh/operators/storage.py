"""Tables written down in the folder that all executors share: lineage ends there, and rows that several
plans read are computed once."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast or crossed, whatever the input's size.
SMALL = 100_000
#: Bytes of its files that such a side may have.
SMALL_BYTES = 128 << 20
#: Spark's setting that deletes a query's shuffle files when the query ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's number of partitions of a shuffle, and rows of one that a task may get where the number is raised.
PARTITIONS, TASK_ROWS = "spark.sql.shuffle.partitions", 1_000_000
#: Tables that are still there, with their sessions.
_THERE: dict[str, weakref.ref] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="citemesh-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder; what is there when the session ends is deleted."""
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    _THERE[path] = weakref.ref(spark)
    return path


def stored(df: DataFrame, parts: int = 0) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and the shuffles behind it go. They have
    `parts` partitions at least, so that what a task gets of many rows is bounded."""
    spark = df.sparkSession
    path = new_folder(spark)
    was, number = spark.conf.get(FREE_SHUFFLES, None), spark.conf.get(PARTITIONS)
    spark.conf.set(FREE_SHUFFLES, "true")
    if parts > int(number):
        spark.conf.set(PARTITIONS, parts)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, was or "false")
        spark.conf.set(PARTITIONS, number)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def stored_model(spark: SparkSession, model):
    """model as it is read back from the shared folder, without its training summary: that of two classes holds
    the session, which can't go to tasks once a query of the session was observed."""
    path = new_folder(spark)
    model.save(path)
    return type(model).load(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by stored() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_stored_path", None)
        if path and _THERE.pop(path, None):
            _delete(df.sparkSession, path)


@atexit.register
def _sweep() -> None:
    """The tables that results may still have read go with the session."""
    for path, ref in list(_THERE.items()):
        spark = ref()
        try:
            if spark is not None:
                _delete(spark, path)
        except Exception:  # the session has ended; the folder's owner clears it
            return


def file_bytes(table: DataFrame) -> int:
    """Bytes of the files of a table made by stored()."""
    sc = table.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(table._stored_path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def small_parts(df: DataFrame, rows: int = SMALL, size: int = SMALL_BYTES):
    """df in parts that may each be broadcast, one at a time: as many as its rows and the bytes of its
    largest row ask for. The caller writes down what it makes of a part before it takes the next."""
    df = stored(df)
    bytes_of = sum((_size_of(f) for f in df.schema), F.lit(8))
    n, most = df.agg(F.count("*"), F.max(bytes_of)).first()
    parts = max(1, -(-n // rows), -(-n * (most or 0) // size))
    if parts == 1:
        yield F.broadcast(df)
    else:
        from .relational import surrogate_ids

        placed = surrogate_ids(df, [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))], 0, "__at")
        for i in range(parts):
            yield F.broadcast(placed.filter(F.expr(f"__at % {parts} = {i}")).drop("__at"))
        forget(placed)
    forget(df)


def _size_of(f) -> Column:
    kind = f.dataType.typeName()
    return F.greatest(F.lit(0), F.size(f.name)) * 8 if kind == "array" else F.coalesce(F.octet_length(f.name), F.lit(0)) if kind in ("string", "binary") else F.lit(8)
