"""Training of a neighbour-mean layer on links: sampled neighbourhoods, gradients summed over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embedding import mean_neighbours
from .relational import top_n
from .storage import forget, stored

#: Slices in which a hub's neighbours are drawn first.
SLICES = 32


def sampled_neighbours(edges: DataFrame, fanout: int, seed: int = 0) -> DataFrame:
    """(src, dst): for each dst the `fanout` in-neighbours of the smallest seeded hashes, all if fewer."""
    e = edges.select("src", "dst").distinct().withColumn("__h", F.xxhash64(F.lit(seed), "src", "dst"))
    e = e.withColumn("__s", F.pmod("__h", F.lit(SLICES)))
    e = top_n(e, ["dst", "__s"], ["__h", "src"], fanout).select("src", "dst", "__h")
    return top_n(e, ["dst"], ["__h", "src"], fanout).select("src", "dst")


def link_rows(vertices: DataFrame, edges: DataFrame, positive: DataFrame, negative: DataFrame) -> DataFrame:
    """(u, v, y) of each link: both ends' features, each followed by the mean of its neighbours' (zeros without any)."""
    means = mean_neighbours(vertices, edges).withColumnRenamed("id", "__i")
    x = vertices.join(means, F.col("id") == F.col("__i"))
    zeros = F.transform("features", lambda _: F.lit(0.0))
    x = stored(x.select("id", F.concat(F.col("features").cast("array<double>"), F.coalesce("agg", zeros)).alias("f")))
    links = positive.select("src", "dst", F.lit(1.0).alias("y")).union(negative.select("src", "dst", F.lit(0.0)))
    return links.join(x.toDF("src", "u"), "src").join(x.toDF("dst", "v"), "dst").select("u", "v", "y")


def loss_and_gradient(rows: DataFrame, weights: np.ndarray, bias: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean cross-entropy of links scored by the inner product of their ends' layers, and its gradient. The
    layer isn't rectified, as the last one of sage_predict(), so that scores may be negative. Each task sums its own links; the driver gets one sum for each weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, dw, db = 0, 0.0, np.zeros_like(weights), np.zeros_like(bias)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                u, v = (np.array(part.column(c).to_pylist(), float) for c in ("u", "v"))
                y = part.column("y").to_numpy()
                hu, hv = u @ weights + bias, v @ weights + bias
                s = (hu * hv).sum(1)
                loss += float((np.logaddexp(0, s) - y * s).sum())
                d = (0.5 * (1 + np.tanh(s / 2)) - y)[:, None]
                du, dv = d * hv, d * hu
                dw += u.T @ du + v.T @ dv
                db += du.sum(0) + dv.sum(0)
                n += part.num_rows
        total = np.concatenate([[n, loss], dw.ravel(), db])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["at", "s"])

    sums = rows.select("u", "v", "y").mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s"))
    total = np.zeros(2 + weights.size + bias.size)
    for r in sums.collect():  # a row for each weight
        total[r["at"]] = r["s"]
    n = max(total[0], 1)
    return total[1] / n, total[2 : 2 + weights.size].reshape(weights.shape) / n, total[2 + weights.size :] / n


def train_sage(vertices: DataFrame, edges: DataFrame, positive: DataFrame, negative: DataFrame, width: int, fanout: int = 25, epochs: int = 10, rate: float = 0.05, seed: int = 0) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], list[float]]:
    """((own, neighbour, bias) weights of one layer, as sage_predict() takes them, and the loss before each
    epoch and after the last), by Adam on all links; vertices: (id, features). Ends that are no vertices
    take their links along. No vertices raise."""
    first = vertices.select(F.size("features").alias("n")).first()
    if first is None:
        raise ValueError("no vertices")
    dims = first["n"]
    r = np.random.default_rng(seed)
    weights, bias = r.normal(size=(2 * dims, width)) / np.sqrt(2 * dims), np.zeros(width)
    rows = stored(link_rows(vertices, sampled_neighbours(edges, fanout, seed), positive, negative))
    losses = []
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (weights, bias)]
    for epoch in range(1, epochs + 1):
        loss, *gradient = loss_and_gradient(rows, weights, bias)
        losses.append(loss)
        for i, (p, g) in enumerate(zip((weights, bias), gradient, strict=True)):
            m, v = 0.9 * state[i][0] + 0.1 * g, 0.999 * state[i][1] + 0.001 * g * g
            state[i] = m, v
            p -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    losses.append(loss_and_gradient(rows, weights, bias)[0])
    forget(rows)
    return (weights[:dims].T, weights[dims:].T, bias), losses
