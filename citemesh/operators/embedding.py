"""Embedders behind a protocol, and neighbour aggregation for graph embeddings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import add
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored_model


class Embedder(Protocol):
    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


class HashingEmbedder:
    """Deterministic stand-in for a text model: signed hashed character trigrams, of length 1."""

    def __init__(self, width: int = 64):
        self.width = width

    def vector(self, text: str | None) -> list[float]:
        import zlib

        v = np.zeros(self.width)
        t = f"  {(text or '').lower()} "
        for gram, count in Counter(map(add, map(add, t, t[1:]), t[2:])).items():
            h = zlib.crc32(gram.encode())
            v[h % self.width] += count if h >> 16 & 1 else -count
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        at, names, schema = df.columns.index(text), df.columns, df.schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = pa.array([self.vector(x) for x in b.column(at).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*b.columns, made], [*names, out])

        return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", `{out}` array<double>")


def document_text(title: Column, abstract: Column, sep: str = "[SEP]") -> Column:
    return F.concat_ws(f" {sep} ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")))


def mean_neighbours(vertices: DataFrame, edges: DataFrame, vector: str = "features") -> DataFrame:
    """(id, agg): the element-wise mean over in-neighbours; null without any."""
    n = edges.select("src", F.col("dst").alias("id")).join(vertices.select(F.col("id").alias("src"), F.posexplode(vector).alias("pos", "x")), "src")
    m = n.groupBy("id", "pos").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("agg"))
    return vertices.select("id").join(m, "id", "left")


def sage_layer(vertices: DataFrame, edges: DataFrame, own: np.ndarray, neigh: np.ndarray, bias: np.ndarray, activation: bool = True) -> DataFrame:
    """(id, features): own @ x + neigh @ mean of in-neighbours + bias, rectified unless it is the last."""
    both = vertices.join(mean_neighbours(vertices, edges), "id")

    @F.pandas_udf("array<double>")
    def apply(x, agg):
        import pandas as pd

        a = np.array(x.tolist(), float)
        m = np.array([np.zeros(a.shape[1]) if v is None else v for v in agg], float)
        out = a @ own.T + m @ neigh.T + bias
        return pd.Series((np.maximum(out, 0) if activation else out).tolist())

    return both.select("id", apply("features", "agg").alias("features"))


def edge_loss(positive: DataFrame, negative: DataFrame, score: str = "score") -> DataFrame:
    """Mean binary cross-entropy of edge scores."""
    rows = positive.select(F.col(score).alias("s"), F.lit(1.0).alias("y")).union(negative.select(F.col(score), F.lit(0.0)))
    p = 1 / (1 + F.exp(-F.col("s")))
    return rows.agg(F.avg(-(F.col("y") * F.ln(F.greatest(p, F.lit(1e-12))) + (1 - F.col("y")) * F.ln(F.greatest(1 - p, F.lit(1e-12))))).alias("loss"))


def split_edges(edges: DataFrame, masks: DataFrame, kind: str = "full") -> DataFrame:
    """Edges with train/val/test masks from those of both ends (full), the source or the destination."""
    names = ["train", "val", "test"]
    s = masks.select(F.col("id").alias("src"), *(F.col(m).alias(f"s_{m}") for m in names))
    d = masks.select(F.col("id").alias("dst"), *(F.col(m).alias(f"d_{m}") for m in names))
    both = edges.join(s, "src").join(d, "dst")
    pick = {"full": lambda m: F.col(f"s_{m}") & F.col(f"d_{m}"), "src": lambda m: F.col(f"s_{m}"), "dst": lambda m: F.col(f"d_{m}")}[kind]
    return both.select(*edges.columns, *(pick(m).alias(m) for m in names))


def inductive_split(masks: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, src, dst): the edges of the subgraphs of the train, val and test nodes; edges between parts
    belong to none."""
    part = F.when(F.col("train"), "train").when(F.col("val"), "val").when(F.col("test"), "test")
    m = masks.select("id", part.alias("part")).filter("part is not null")
    a, b = m.select(F.col("id").alias("src"), "part"), m.select(F.col("id").alias("dst"), F.col("part").alias("other"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").filter("part = other").select("part", "src", "dst")


def masks_from_ids(vertices: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, train, val, test) of vertices by parts(id, part); those in no part are false in all."""
    p = vertices.select("id").join(parts, "id", "left")
    return p.select("id", *(F.coalesce(F.col("part") == m, F.lit(False)).alias(m) for m in ("train", "val", "test")))


def sage_predict(vertices: DataFrame, edges: DataFrame, layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """(id, features): all nodes layer by layer with all of their neighbours; each layer is written down
    before the next reads it. layers: (own, neighbour, bias) weights."""
    from .storage import stored

    out = vertices.select("id", "features")
    for i, (own, neigh, bias) in enumerate(layers):
        out = stored(sage_layer(out, edges, own, neigh, bias, i < len(layers) - 1))
    return out


def probe(train: DataFrame, test: DataFrame, vector: str, label: str, **params) -> DataFrame:
    """(rows, micro_f1) of a one-vs-rest logistic regression on embeddings; for one label a row micro-F1 is
    the share that is right."""
    from pyspark.ml.classification import LogisticRegression, OneVsRest
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    index = StringIndexer(inputCol=label, outputCol="__y", handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
    tr, te = (index.transform(d.withColumn("__x", array_to_vector(F.col(vector).cast("array<double>")))) for d in (train, test))
    model = OneVsRest(classifier=LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=50, **params), featuresCol="__x", labelCol="__y", predictionCol="__q").fit(tr)
    model = stored_model(train.sparkSession, model)
    return model.transform(te).agg(F.count("*").alias("rows"), F.avg((F.col("__q") == F.col("__y")).cast("double")).alias("micro_f1"))


def endpoint_positions(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges as dense positions; those with an unknown end go. vertices: (id, pos)."""
    a = vertices.select(F.col("id").alias("src"), F.col("pos").alias("src_pos"))
    b = vertices.select(F.col("id").alias("dst"), F.col("pos").alias("dst_pos"))
    return edges.join(a, "src").join(b, "dst").select("src_pos", "dst_pos")
