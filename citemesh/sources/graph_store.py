"""A property graph kept as tables that batches are merged into."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import keep_first, upsert
from ..operators.storage import forget, stored


@dataclass
class GraphStore:
    """Nodes by label and edges by type under a folder, each a Parquet table parted by a hash of its key into
    `buckets`. A batch reads and rewrites only the buckets that its keys fall into, by dynamic partition
    overwrite; the files of all others stay. Merging is idempotent, so a batch that is delivered again, after
    a failure between two buckets too, leaves the same graph. Give enough buckets for one to fit a task; the number is
    a folder's for good."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def _read(self, kind: str, name: str) -> DataFrame | None:
        path = f"{self.path}/{kind}/{name}"
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(path)

    def _merge(self, kind: str, name: str, batch: DataFrame, keys: list[str]) -> None:
        rest = [c for c in batch.columns if c not in keys]
        batch = keep_first(batch, keys, [F.col(c).desc_nulls_last() for c in rest] or keys)  # one row a key, whatever the order
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
        batch = stored(batch.withColumn("bucket", bucket))
        old = self._read(kind, name)
        if old is not None:
            touched = [r[0] for r in batch.select("bucket").distinct().collect()]  # as many as there are buckets
            merged = upsert(old.filter(F.col("bucket").isin(touched)).drop("bucket"), batch.drop("bucket"), keys).withColumn("bucket", bucket)
        else:
            merged = batch
        merged = stored(merged)  # nothing is read from the files that are replaced
        out = merged.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", *keys)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{kind}/{name}")
        forget(batch, merged)

    def nodes(self, label: str) -> DataFrame:
        df = self._read("nodes", label)
        if df is None:
            raise KeyError(f"no nodes {label!r}")
        return df.drop("bucket")

    def edges(self, kind: str) -> DataFrame:
        df = self._read("edges", kind)
        if df is None:
            raise KeyError(f"no edges {kind!r}")
        return df.drop("bucket")

    def merge_nodes(self, label: str, batch: DataFrame) -> None:
        """batch(id, properties): new ids are added; of known ones the listed properties are set, null
        included, and others stay. Rows without an id are left out; of one id in a batch the row with the largest
        values counts."""
        self._merge("nodes", label, batch.filter("id is not null"), ["id"])

    def merge_edges(self, kind: str, batch: DataFrame, start: str, end: str) -> None:
        """batch(src, dst, properties), merged on both ends; edges whose ends the store lacks are left out."""
        known = batch
        for side, label in (("src", start), ("dst", end)):
            known = known.join(self.nodes(label).select(F.col("id").alias(side)), side, "left_semi")
        self._merge("edges", kind, known, ["src", "dst"])
