"""Approximate nearest neighbours by low-dimensional stable projections indexed by a kd-tree.

Vectors are projected to 8 dimensions by Gaussian vectors (2-stable: a projected squared distance over
the true one is chi-square with 8 degrees of freedom). The upper levels of the kd-tree are fitted on the
projections of a bounded sample (`SAMPLE` rows by a hash of the id) and cut the projected space into
regions, at most `REGIONS`; every row is placed in its region, and a region's rows in blocks of bounded
size by a hash of their id. Each block keeps its distinct vectors in the tree's lower levels.

A query first goes to its own region's blocks. The k-th distance found there says which other regions it
has to see: those whose box of projections is so near that, were an unseen vector nearer than the k-th
found, the chi-square law would not say with probability `sure` that its projection had been met already.
In a block a query takes leaves in the order of their projected distance, verifies their vectors by the
true distance and stops by the same test. The lists are merged. All rows are indexed and all of the stated
queries asked; a task holds one block and one batch of queries. Equal vectors are one point with its
smallest ids, in a batch as it is read and in a block: more than k + 1 of them can never be among a query's
neighbours, so nothing is lost to a common vector, and none fills a block.

Edge cases: vectors that are null, zero, or hold nulls, NaN or infinities take no part, nor do rows without
an id; vectors of another length have no distance, so each length is searched for itself; with fewer
candidates than k all are returned; equal distances go by id; rows repeated under one id count once, and
of several vectors under one id the one of smallest hash counts; extra columns are not read, so their names
don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut, drop, partitions, small_or_not

NEAREST = 10
DIMENSIONS = 8
SURE = 0.97
#: Rows and bytes of a block, regions of a length's vectors, and rows that regions are fitted on.
BLOCK_ROWS = 16_384
BLOCK_BYTES = 32 << 20
REGIONS = 1024
SAMPLE = 16_384
LEAF = 64
SEED = 3


def chi_square(x: float, dims: int = DIMENSIONS) -> float:
    """The chi-square distribution function, for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total if x < 1400 else 1.0


def chi_square_at(p: float, dims: int = DIMENSIONS) -> float:
    lo, hi = 0.0, 1400.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, dims) < p else (lo, mid)
    return hi


class Tree:
    """A kd-tree over rows of `points`: split at the median of the widest dimension down to LEAF rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.low, self.high, self.kids, self.rows = [], [], [], []
        todo = [(np.arange(len(points)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            at = len(self.kids)
            own = points[rows]
            self.low.append(own.min(axis=0))
            self.high.append(own.max(axis=0))
            self.kids.append([-1, -1])
            self.rows.append(rows)
            if parent >= 0:
                self.kids[parent][side] = at
            wide = self.high[at] - self.low[at]
            if len(rows) > leaf and wide.max() > 0:
                d = int(wide.argmax())
                order = np.argpartition(own[:, d], len(rows) // 2)
                self.rows[at] = None
                todo += [(rows[order[: len(rows) // 2]], at, 0), (rows[order[len(rows) // 2 :]], at, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def near(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(squared distance of a leaf's box, its rows), nearest first."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        dist = np.einsum("ij,ij->i", gap, gap)
        heap = [(dist[0], 0)]
        while heap:
            d, at = heapq.heappop(heap)
            if self.rows[at] is not None:
                yield d, self.rows[at]
            else:
                for k in self.kids[at]:
                    heapq.heappush(heap, (dist[k], k))


class Block:
    """Distinct vectors of a block, each with its k + 1 smallest ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projection: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        self.vectors, group = np.unique(vectors, axis=0, return_inverse=True)
        self.ids: list[list[int]] = [[] for _ in self.vectors]
        for i, g in zip(ids.tolist(), group.ravel().tolist(), strict=True):
            own = self.ids[g]
            if len(own) <= k and (not own or own[-1] != i):
                own.append(i)
        self.tree = Tree(self.vectors @ projection)
        self.k, self.enough = k, chi_square_at(SURE, projection.shape[1])

    def search(self, qid: int, q: np.ndarray, pq: np.ndarray, bound: float = math.inf) -> list[tuple[float, int]]:
        """The k nearest that are no farther than the bound."""
        best: list[tuple[float, int]] = []  # (-distance, -id): the worst on top
        for edge, rows in self.tree.near(pq):
            if edge > self.enough * bound**2:
                break
            diff = self.vectors[rows] - q
            dist = np.sqrt((diff * diff).sum(axis=1))
            close = dist <= bound
            for d, row in zip(dist[close].tolist(), rows[close].tolist(), strict=True):
                if d > bound:
                    continue
                for i in self.ids[row]:
                    if i == qid:
                        continue
                    if len(best) < self.k:
                        heapq.heappush(best, (-d, -i))
                    elif (-d, -i) > best[0]:
                        heapq.heapreplace(best, (-d, -i))
                if len(best) == self.k:
                    bound = min(bound, -best[0][0])
        return [(-d, -i) for d, i in best]


class Regions:
    """The upper levels of a kd-tree, fitted on sample points: the largest leaf is split at the median of
    its widest dimension until there are enough."""

    def __init__(self, sample: np.ndarray, rows: int, most: int, block_rows: int):
        leaves = [(-len(sample), 0, sample)]
        self.nodes: list[list] = [[-1, 0.0, -1, -1]]  # dimension, cut, below, above; or -1 and the leaf's number
        settled = []
        while leaves and len(leaves) + len(settled) < most:
            _, at, own = heapq.heappop(leaves)
            wide = np.ptp(own, axis=0) if len(own) else np.zeros(1)
            d = int(wide.argmax())
            at_most = own[:, d] <= np.median(own[:, d]) if wide.max() > 0 else None
            if at_most is None or at_most.all():
                settled.append((0, at, own))
                continue
            below, above = len(self.nodes), len(self.nodes) + 1
            self.nodes[at] = [d, float(np.median(own[:, d])), below, above]
            self.nodes += [[-1, 0.0, -1, -1], [-1, 0.0, -1, -1]]
            heapq.heappush(leaves, (-int(at_most.sum()), below, own[at_most]))
            heapq.heappush(leaves, (-int((~at_most).sum()), above, own[~at_most]))
        self.blocks = []  # of each leaf
        for number, (_, at, own) in enumerate([*leaves, *settled]):
            self.nodes[at][2] = number
            self.blocks.append(max(1, math.ceil(len(own) / max(1, len(sample)) * rows / block_rows)))

    def of(self, points: np.ndarray) -> np.ndarray:
        """The leaves' numbers of points."""
        out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            d, edge, below, above = self.nodes[at]
            if d < 0:
                out[rows] = below
            elif len(rows):
                low = points[rows, d] <= edge
                todo += [(below, rows[low]), (above, rows[~low])]
        return out


def projection(width: int, dims: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, dims))


def _vectors(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def usable(vec: str) -> Column:
    v = F.transform(vec, lambda x: x.cast("double"))
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def fitted(rows: DataFrame, dims: int, block_rows: int, regions: int) -> tuple[dict[int, Regions], dict[int, int], dict[int, int]]:
    """For each length of rows(id, vec): its regions, the number of their first, and of their first block."""
    trees, first, block, at, blocks = {}, {}, {}, 0, 0
    widths = {r["width"]: r["count"] for r in rows.groupBy(F.size("vec").alias("width")).count().collect()}  # a row for each length
    for width, n in sorted(widths.items()):
        some = rows.filter(F.size("vec") == width).filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < min(1.0, SAMPLE / n) * (1 << 30))

        def projected(batches: Iterator[pa.RecordBatch], p=projection(width, dims)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(list(_vectors(b.column(0)) @ p), pa.list_(pa.float64()))], ["p"])

        sample = [r["p"] for r in some.select("vec").mapInArrow(projected, "p array<double>").collect()]  # SAMPLE rows or so
        size = max(256, min(block_rows, BLOCK_BYTES // (8 * width))) if block_rows == BLOCK_ROWS else block_rows
        trees[width] = Regions(np.array(sample, float).reshape(len(sample), dims), n, max(1, min(regions, -(-n // size))), size)
        first[width], block[width] = at, blocks
        at, blocks = at + len(trees[width].blocks), blocks + sum(trees[width].blocks)
    return trees, first, block


def nearest(df: DataFrame, query: Column, k: int = NEAREST, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMENSIONS, block_rows: int = BLOCK_ROWS, regions: int = REGIONS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where `query` holds, against all rows."""
    spark = df.sparkSession
    kind = df.schema[vec_col].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    rows = df.filter(usable(vec_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"), F.coalesce(query, F.lit(False)).alias("is_query"))
    several = rows.select("id", F.xxhash64("vec").alias("h")).groupBy("id").agg(F.min("h").alias("least"), F.max("h").alias("most")).filter("least <> most").select("id", "least")
    several, _ = small_or_not(several)
    rows = rows.join(several, "id", "left").filter(F.col("least").isNull() | (F.col("least") == F.xxhash64("vec"))).drop("least")
    trees, first, block = fitted(rows, dims, block_rows, regions)
    if not trees:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    starts = {w: np.concatenate([[0], np.cumsum(t.blocks)]) + block[w] for w, t in trees.items()}  # of regions' blocks
    n_blocks = sum(sum(t.blocks) for t in trees.values())
    enough = chi_square_at(SURE, dims)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mats: dict[int, np.ndarray] = {}
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy()
            for width in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == width))
                ids, asked = part.column(0).to_numpy(), part.column(2).to_numpy(zero_copy_only=False)
                vecs = _vectors(part.column(1))
                # of equal vectors the k + 1 smallest ids are candidates, and all that are asked stay queries
                _, group = np.unique(vecs, axis=0, return_inverse=True)
                order = np.lexsort((ids, group.ravel()))
                g = group.ravel()[order]
                heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                place_in = np.arange(len(g)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(g)]])))
                again = np.concatenate([[False], (g[1:] == g[:-1]) & (ids[order][1:] == ids[order][:-1])])
                candidate = np.zeros(len(ids), bool)
                candidate[order] = (place_in <= k) & ~again if not again.any() else ~again
                keep = np.flatnonzero(candidate | asked)
                tree, p = trees[width], mats.setdefault(width, projection(width, dims))
                points = vecs[keep] @ p
                region = tree.of(points)
                own = np.array(tree.blocks)[region]
                sub = (ids[keep].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % own
                part = part.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([pa.array(region + first[width], pa.int32()), pa.array(starts[width][region] + sub, pa.int32()), part.column(0), part.column(1), pa.array(candidate[keep]), part.column(2), pa.array(list(points), pa.list_(pa.float64()))], ["region", "block", "id", "vec", "candidate", "asked", "p"])

    placed = cut(rows.select("id", "vec", "is_query").mapInArrow(place, f"region int, block int, id bigint, vec array<{kind}>, candidate boolean, asked boolean, p array<double>"))
    candidates = placed.filter("candidate").select("block", F.lit(0).alias("kind"), "id", "vec", F.lit(None).cast("double").alias("bound"))
    asked = placed.filter("asked").dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held, index, at = [], [], None, None
        for b in batches:
            block, kind, ids, bounds = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            edges = np.flatnonzero(np.diff(block) | np.diff(kind)) + 1
            out = []
            for lo, hi in zip([0, *edges], [*edges, b.num_rows], strict=True):
                if at != block[lo]:
                    held_ids, held, index, at = [], [], None, block[lo]
                vecs = _vectors(b.column(3).slice(lo, hi - lo))
                if kind[lo] == 0:
                    held_ids.append(ids[lo:hi])
                    held.append(vecs)
                    continue
                if index is None:
                    if not held:
                        continue
                    p = projection(vecs.shape[1], dims)
                    index = Block(np.concatenate(held_ids), np.concatenate(held), p, k)
                    held_ids, held = [], []
                for i, v, pv, most in zip(ids[lo:hi].tolist(), vecs, vecs @ p, bounds[lo:hi].tolist(), strict=True):
                    out += [(i, near, d) for d, near in index.search(i, v, pv, most)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    parts = min(n_blocks, 16 * partitions(spark))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def searched(queries: DataFrame) -> DataFrame:
        """The k nearest of each of queries(block, id, vec, bound) in its blocks."""
        stream = candidates.union(queries.select("block", F.lit(1), "id", "vec", "bound"))
        stream = stream.repartitionById(parts, F.col("block") % parts).sortWithinPartitions("block", "kind", "id")
        found = stream.mapInArrow(run, "query_id bigint, vec_id bigint, score double").distinct()
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    everywhere = F.lit(float("inf")).alias("bound")
    blocks_of = F.create_map(*(F.lit(int(x)) for w, t in trees.items() for r in range(len(t.blocks)) for x in (first[w] + r, starts[w][r]))), F.create_map(*(F.lit(int(x)) for w, t in trees.items() for r in range(len(t.blocks)) for x in (first[w] + r, starts[w][r + 1] - 1)))
    own = asked.select(F.explode(F.sequence(blocks_of[0][F.col("region")], blocks_of[1][F.col("region")])).alias("block"), "id", "vec", everywhere)
    found = cut(searched(own))
    if any(len(t.blocks) > 1 for t in trees.values()):
        ends = [f(F.col("p")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(dims)]
        boxes = {r["region"]: (np.array(r[1 : dims + 1]), np.array(r[dims + 1 :])) for r in placed.filter("candidate").groupBy("region").agg(*ends).collect()}  # REGIONS rows a length at most
        groups = {w: [(r, first[w] + r) for r in range(len(t.blocks)) if first[w] + r in boxes] for w, t in trees.items()}

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            corners = {w: (np.array([boxes[x][0] for _, x in g]), np.array([boxes[x][1] for _, x in g])) for w, g in groups.items() if g}
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    widths = part.column(2).value_lengths().to_pylist()
                    to, of = [], []
                    for i, (region, point, bound, w) in enumerate(zip(part.column(0).to_pylist(), _vectors(part.column(3)), part.column(4).to_pylist(), widths, strict=True)):
                        low, high = corners[w]
                        gap = np.maximum(np.maximum(low - point, point - high), 0)
                        for g in np.flatnonzero((gap * gap).sum(axis=1) <= enough * bound**2).tolist():
                            r, number = groups[w][g]
                            if number != region:
                                blocks = range(int(starts[w][r]), int(starts[w][r + 1]))
                                to += blocks
                                of += [i] * len(blocks)
                    taken = part.take(pa.array(of, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), taken.column(1), taken.column(2), taken.column(4)], ["block", "id", "vec", "bound"])

        bound = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("score")).otherwise(F.lit(float("inf"))).alias("bound"))
        known = asked.join(bound, asked.id == bound.query_id, "left").select("region", "id", "vec", "p", F.coalesce("bound", everywhere).alias("bound"))
        more = searched(known.mapInArrow(route, f"block int, id bigint, vec array<{kind}>, bound double"))
        found = cut(found.union(more).drop("rank").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    drop(placed)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
