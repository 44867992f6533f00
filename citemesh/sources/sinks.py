"""Graph import files and commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import EdgeSet, NodeSet


def write_nodes(nodes: NodeSet, path: str) -> None:
    nodes.export_rows().write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_edges(edges: EdgeSet, path: str, start: str, end: str) -> None:
    edges.export_rows(start, end).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def import_command(node_files: list[str], edge_files: list[str], bin_path: str = "bin", database: str = "neo4j") -> str:
    """The bulk import call for exported files."""
    parts = [f"{bin_path}/neo4j-admin import", f"--database={database}", *(f"--nodes={f}" for f in node_files), *(f"--relationships={f}" for f in edge_files), "--skip-bad-relationships"]
    return " ".join(parts)


def write_embeddings(df: DataFrame, path: str, vector: str = "embedding", joined: bool = True) -> None:
    out = df.withColumn(vector, F.array_join(F.transform(vector, lambda x: x.cast("string")), ";")) if joined else df.withColumn(vector, F.to_json(vector))
    out.write.mode("overwrite").option("header", True).csv(path)


def write_graph(nodes: dict[str, NodeSet], edges: dict[str, EdgeSet], path: str, form: str = "parquet") -> None:
    """A folder for each label and type, as parquet, json or csv (lists and timestamps as text)."""
    if form not in ("parquet", "json", "csv"):
        raise ValueError(f"unknown form {form!r}")
    for kind, sets in (("nodes", nodes), ("edges", edges)):
        for k, x in sets.items():
            df = x.df
            if form == "csv":
                df = df.withColumns({c: F.array_join(F.transform(c, lambda v: v.cast("string")), ";") for c, t in df.dtypes if t.startswith("array")})
            w = df.write.mode("overwrite")
            (w.option("header", True) if form == "csv" else w).format(form).save(f"{path}/{kind}/{k}")


def import_command_of(nodes: dict[str, NodeSet], edges: dict[str, tuple[str, EdgeSet, str]], path: str, **options) -> str:
    """Writes each set as an import file below `path` and returns the call that takes them all."""
    for k, n in nodes.items():
        write_nodes(n, f"{path}/nodes/{k}")
    for k, (a, e, b) in edges.items():
        write_edges(e, f"{path}/edges/{k}", a.lower(), b.lower())
    return import_command([f"{path}/nodes/{k}" for k in nodes], [f"{path}/edges/{k}" for k in edges], **options)


def upload(df: DataFrame, path: str, form: str = "parquet", partitions: int | None = None) -> str:
    """df in any store that Spark can write to."""
    (df if partitions is None else df.repartition(partitions)).write.mode("overwrite").format(form).save(path)
    return path


def transfer_snapshot(spark, source: str, target: str, partitions: int | None = None) -> int:
    """Compressed text lines from one store to another, uncompressed; returns the number of lines."""
    df = spark.read.text(source)
    upload(df, target, "text", partitions)
    return spark.read.text(target).count()


def put_batches(df: DataFrame, put, chunk: int = 8192) -> DataFrame:
    """(rows, batches) for each task: hands Arrow batches of at most `chunk` rows to put(batch) where the rows
    are, so nothing passes through the driver."""
    import pyarrow as pa

    def run(batches):
        rows = n = 0
        for b in batches:
            for lo in range(0, b.num_rows, chunk):
                part = b.slice(lo, chunk)
                put(part)
                rows, n = rows + part.num_rows, n + 1
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([n], pa.int64())], ["rows", "batches"])

    return df.mapInArrow(run, "rows bigint, batches bigint")


def put_graph(nodes: dict[str, NodeSet], edges: dict[str, EdgeSet], put) -> dict[str, int]:
    """Bulk import: every set's rows in Arrow batches through put(kind, name, batch); rows by name."""
    out = {}
    for kind, sets in (("nodes", nodes), ("edges", edges)):
        for k, x in sets.items():
            out[k] = put_batches(x.df, lambda b, kind=kind, k=k: put(kind, k, b)).agg(F.sum("rows")).first()[0] or 0
    return out
