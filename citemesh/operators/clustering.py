"""Density clustering and soft assignment behind Spark's estimators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import surrogate_ids
from .storage import forget, stored, stored_model


#: Rows of a group that one task compares with so many others at a time.
BLOCK = 2048
#: Rows of which a task may hold a table of all pairs.
TABLE = 4096
#: Pairs that are compared at a time.
AT_ONCE = 1 << 20


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product; they are off by _slack() at most."""
    out = x @ y.T
    out *= -2
    out += (x * x).sum(axis=1)[:, None]
    out += (y * y).sum(axis=1)
    return np.maximum(out, 0, out=out)


def _slack(*parts: np.ndarray) -> float:
    """How far _squares(), and the squares of exact distances, may be off."""
    return 32 * (parts[0].shape[1] + 8) * np.finfo(float).eps * max((float((x * x).sum(axis=1).max(initial=0.0)) for x in parts), default=0.0)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact distances of the rows of x from those of y, one by one."""
    return np.sqrt(((x - y) ** 2).sum(axis=1))


def _nearest(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The k least distances of each row of x from rows of y, in rising order. Products tell which may be
    among them, and those alone are measured exactly."""
    k = min(k, len(y))
    out, slack = np.empty((len(x), k)), 2 * _slack(x, y)
    step = max(1, AT_ONCE // len(y))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        near = _squares(part, y)
        row, col = np.nonzero(near <= np.partition(near, k - 1, axis=1)[:, k - 1 : k] + slack)
        d = np.concatenate([_apart(part[row[i : i + 65536]], y[col[i : i + 65536]]) for i in range(0, len(row), 65536)])
        order = np.lexsort((d, row))
        first = np.searchsorted(row, np.arange(len(part)))
        out[at : at + step] = d[order[first[:, None] + np.arange(k)]]
    return out


def _core(x: np.ndarray, k: int) -> np.ndarray:
    """Distance to the k-th nearest row, itself being the first."""
    return _nearest(x, x, k)[:, k - 1]


def _may_join(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Ends of all edges that may be in the minimum spanning tree of mutual reachability: those that aren't
    surely heavier than the way between their ends through the tree by rounded distances (Prim). None if they
    are many, as with equal rows."""
    n, slack = len(x), 2 * _slack(x)
    far = _squares(x, x)
    np.maximum(far, (core * core)[:, None], out=far)
    np.maximum(far, core * core, out=far)
    way = np.zeros((n, n))  # the heaviest edge between two rows met so far, in the order they are met
    best, come, free = far[0].copy(), np.zeros(n, int), np.ones(n, bool)
    place, order, left, right, many = np.zeros(n, int), np.zeros(n, int), [], [], 0
    best[0], free[0] = np.inf, False
    for i in range(1, n):
        at = int(best.argmin())
        w, p = best[at], place[come[at]]
        heavy = np.maximum(way[p, :i], w)
        way[i, :i], way[:i, i] = heavy, heavy
        to = order[:i][far[at, order[:i]] <= heavy + slack]
        many += len(to)
        if many > 16 * n:
            return None
        left.append(to)
        right.append(np.full(len(to), at))
        order[i], place[at], free[at], best[at] = at, i, False, np.inf
        nearer = (far[at] < best) & free
        np.copyto(best, far[at], where=nearer)
        come[nearer] = at
    a, b = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, b), np.maximum(a, b)


def _mst(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, a, b) of the minimum spanning tree of mutual reachability, a < b. Of equal weights the edge with
    the smaller ends counts as lighter, so there is one tree, and a part's tree holds all that the whole's tree
    has within the part. Of up to TABLE rows, the edges that may be in it are found by matrix products
    and measured exactly; else, and where these are many, a row of exact distances is made at a time."""
    n = len(x)
    some = _may_join(x, core) if 2 < n <= TABLE else None
    if some is None:
        return _prim(x, core)
    a, b = some
    w = np.maximum(np.maximum(_apart(x[a], x[b]), core[a]), core[b])
    order = np.lexsort((b, a, w))
    a, b, w = a[order], b[order], w[order]
    up, taken = list(range(n)), []
    for e, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while up[p] != p:
            up[p] = up[up[p]]
            p = up[p]
        while up[q] != q:
            up[q] = up[up[q]]
            q = up[q]
        if p != q:
            up[p] = q
            taken.append(e)
    return w[taken], a[taken], b[taken]


def _prim(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_mst() by Prim with one row of exact distances at a time."""
    n = len(x)
    best, low, high, done = np.full(n, np.inf), np.full(n, n), np.full(n, n), np.zeros(n, bool)
    weight, a, b, at = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0), int), np.empty(max(n - 1, 0), int), 0
    place = np.arange(n)
    for i in range(n - 1):
        done[at] = True
        d = np.maximum(np.maximum(np.sqrt(((x - x[at]) ** 2).sum(axis=1)), core), core[at])
        lo, hi = np.minimum(place, at), np.maximum(place, at)
        nearer = ~done & ((d < best) | ((d == best) & ((lo < low) | ((lo == low) & (hi < high)))))
        best[nearer], low[nearer], high[nearer] = d[nearer], lo[nearer], hi[nearer]
        open_ = np.where(done, np.inf, best)
        ties = np.flatnonzero(open_ == open_.min())
        at = int(ties[np.lexsort((high[ties], low[ties]))[0]])
        weight[i], a[i], b[i] = best[at], low[at], high[at]
    order = np.lexsort((b, a, weight))
    return weight[order], a[order], b[order]


def condensed(n: int, weight: np.ndarray, a: np.ndarray, b: np.ndarray, core: np.ndarray, least: int) -> dict[str, np.ndarray | dict]:
    """From a spanning tree's edges in rising order (ends are places 0 to n - 1): labels (-1 is noise),
    probabilities, outlier scores (how much earlier than the last of its cluster a row leaves it), and each
    cluster's persistence (its excess of mass, as a share of what it could be). The single linkage tree is condensed to
    clusters of `least` rows, and those of the largest excess of mass are taken. Linear memory: a few numbers a
    row."""
    labels, prob, outlier = np.full(n, -1), np.zeros(n), np.zeros(n)
    if n < max(2, least):
        return {"labels": labels, "probabilities": prob, "outliers": outlier, "persistence": {}}
    lam = lambda d: 1 / d if d > 0 else 1e12
    up, top = list(range(n)), list(range(n))
    size, kids, dist = [1] * n, [], []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for w, p, q in zip(weight.tolist(), a.tolist(), b.tolist(), strict=True):
        p, q = root(p), root(q)
        kids.append((top[p], top[q]))
        dist.append(w)
        size.append(size[top[p]] + size[top[q]])
        if size[top[p]] < size[top[q]]:
            p, q = q, p
        up[q] = p
        top[p] = len(size) - 1
    whole = 2 * n - 2
    # each row leaves the cluster it is in at some level; a cluster ends where it falls into two
    left, home = np.zeros(n), np.full(n, whole)
    birth, parent, children, todo = {whole: 0.0}, {whole: None}, {whole: []}, [(whole, whole)]
    while todo:  # a node of the linkage within a cluster
        v, c = todo.pop()
        if v < n:
            left[v], home[v] = lam(core[v]), c
            continue
        at, pair = lam(dist[v - n]), kids[v - n]
        big = [u for u in pair if size[u] >= least]
        if len(big) == 2:
            for u in sorted(pair):
                birth[u], parent[u], children[u] = at, c, []
                children[c].append(u)
                todo.append((u, u))
            continue
        for u in pair:
            if u in big:
                todo.append((u, c))
                continue
            inside = [u]
            while inside:
                u = inside.pop()
                if u < n:
                    left[u], home[u] = at, c
                else:
                    inside += kids[u - n]
    order = sorted(birth)  # children before parents
    number = {c: i for i, c in enumerate(order)}
    of = np.array([number[c] for c in home.tolist()])
    begun = np.array([birth[c] for c in order])
    mass = np.bincount(of, weights=np.maximum(0.0, left - begun[of]), minlength=len(order))
    most = np.zeros(len(order))
    np.maximum.at(most, of, left)
    first = np.full(len(order), n)
    np.minimum.at(first, of, np.arange(n))
    stab, chosen = {}, {}
    for i, c in enumerate(order):
        for u in children[c]:
            mass[i] += (birth[u] - birth[c]) * size[u]
            most[i] = max(most[i], most[number[u]])
            first[i] = min(first[i], first[number[u]])
        below = sum(stab[u] for u in children[c])
        chosen[c] = mass[i] >= below and c != whole
        stab[c] = mass[i] if chosen[c] else below
    under = {}  # the chosen cluster that a cluster is part of
    for c in reversed(order):
        above = under.get(parent[c], -1)
        under[c] = above if above != -1 else c if chosen[c] else -1
    final = sorted((c for c in order if under[c] == c), key=lambda c: first[number[c]])
    label = {c: i for i, c in enumerate(final)}
    mine = np.array([label.get(under[c], -1) for c in order])
    labels = mine[of]
    ends = np.array([most[number[c]] for c in final])
    inside = labels >= 0
    prob[inside] = np.divide(left[inside], ends[labels[inside]], out=np.ones(inside.sum()), where=ends[labels[inside]] > 0)
    held, peak = np.bincount(labels[inside], minlength=len(final)), left.max()
    outlier = np.where(most[of] > 0, (most[of] - left) / np.where(most[of] > 0, most[of], 1.0), 0.0)
    return {"labels": labels, "probabilities": prob, "outliers": outlier, "persistence": {i: float(stab[c] / (held[i] * peak)) if peak > 0 else 1.0 for i, c in enumerate(final)}}


def density_labels(x: np.ndarray, min_cluster_size: int = 5, min_samples: int | None = None) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """(labels, probabilities, persistence) of rows in one place. Quadratic in time, linear in memory."""
    n = len(x)
    core = _core(x, min(min_samples or min_cluster_size, n)) if n else np.zeros(0)
    out = condensed(n, *_mst(x, core), core, min_cluster_size)
    return out["labels"], out["probabilities"], out["persistence"]


def _tiles(rows: DataFrame, block: int):
    """rows(g, i, ...), i counting a group's rows: those of each two blocks of so many, under (g, t1, t2), dealt to as
    many partitions as there are pairs of blocks (2,000 at most), whatever their bytes."""
    sizes = rows.groupBy("g").agg(F.max("i").alias("__last"))
    last = F.floor(F.col("__last") / block).cast("int")
    tiles = sizes.agg(F.sum((last + 1).cast("bigint") * (last + 2) / 2)).first()[0]
    each = rows.join(sizes, "g").withColumn("own", F.floor(F.col("i") / block).cast("int"))
    each = each.select("*", F.explode(F.sequence(F.lit(0), last)).alias("other")).drop("__last")
    each = each.select("g", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), *(c for c in rows.columns if c != "g"), "own")
    return each.repartition(int(max(1, min(tiles or 1, 2000))), "g", "t1", "t2").groupBy("g", "t1", "t2")


def _held(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Vectors of a tile, their blocks, and the tile's two blocks."""
    return np.array(pdf["v"].tolist(), float), pdf["own"].to_numpy(), pdf["t1"].iloc[0], pdf["t2"].iloc[0]


def core_distances(rows: DataFrame, k: int) -> DataFrame:
    """(g, i, core) of rows(g, i, v): each two blocks of a group are one task's work, which gives a row's k
    least distances there; the k least of all are merged."""

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        (x, own, t1, t2), ids, out = _held(pdf), pdf["i"].to_numpy(), []
        for a, b in {(t1, t2), (t2, t1)}:
            out += zip(ids[own == a], _nearest(x[own == a], x[own == b], k), strict=True)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]] * len(out), "i": [i for i, _ in out], "d": [d for _, d in out]})

    found = _tiles(rows, 4 * BLOCK).applyInPandas(near, "g bigint, i bigint, d array<double>")
    merged = found.groupBy("g", "i").agg(F.flatten(F.collect_list("d")).alias("d"))  # k for each block of the group
    return merged.select("g", "i", F.element_at(F.array_sort("d"), F.least(F.lit(k), F.size("d"))).alias("core"))


def spanning_edges(rows: DataFrame) -> DataFrame:
    """(g, a, b, w) of rows(g, i, core, v): the trees of each two blocks, which hold all edges of the group's
    tree (an edge that is heaviest on a cycle in a part is so in the whole)."""

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        w, a, b = _mst(np.array(pdf["v"].tolist(), float), pdf["core"].to_numpy())
        ids = pdf["i"].to_numpy()
        return pd.DataFrame({"g": np.full(len(w), pdf["g"].iloc[0]), "a": ids[a], "b": ids[b], "w": w})

    return _tiles(rows, BLOCK).applyInPandas(tree, "g bigint, a bigint, b bigint, w double").distinct()


def minimum_forest(edges: DataFrame) -> DataFrame:
    """The edges of each group's minimum spanning tree, of edges(g, a, b, w), a < b, by Boruvka's rounds: each
    component takes its lightest edge to another one (ties by the ends), joined components get one name, and
    edges within one go. Rounds are tables in the shared folder; components halve at least."""
    rest = stored(edges.select("g", "a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y")))
    taken = []
    while not rest.isEmpty():
        light = F.min(F.struct("w", "a", "b", "to")).alias("e")
        ends = rest.select("g", "w", "a", "b", F.col("x").alias("c"), F.col("y").alias("to")).union(rest.select("g", "w", "a", "b", F.col("y"), F.col("x")))
        best = stored(ends.groupBy("g", "c").agg(light).select("g", "c", "e.*"))
        taken.append(stored(best.select("g", "a", "b", "w").distinct()))
        # two components that take one edge are a root: the smaller; all others hang on to whom they reach
        back = best.select("g", F.col("c").alias("to"), F.col("to").alias("back"))
        up = stored(best.join(back, ["g", "to"], "left").select("g", "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("up")))
        while True:
            above = up.select("g", F.col("c").alias("up"), F.col("up").alias("top"))
            new = stored(up.join(above, ["g", "up"]).select("g", "c", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            still = new.filter("moved").isEmpty()
            forget(up)
            up = new.drop("moved")
            up._stored_path = new._stored_path
            if still:
                break
        name = lambda end: up.select("g", F.col("c").alias(end), F.col("up").alias(f"{end}2"))
        new = stored(rest.join(name("x"), ["g", "x"]).join(name("y"), ["g", "y"]).filter("x2 <> y2").select("g", "a", "b", "w", F.col("x2").alias("x"), F.col("y2").alias("y")))
        forget(rest, best, up)
        rest = new
    forget(rest)
    out = edges.limit(0) if not taken else taken[0]
    for t in taken[1:]:
        out = out.union(t)
    return out.select("g", "a", "b", "w")


def hdbscan(df: DataFrame, group: str, key: str, vector: str, min_cluster_size: int = 5, min_samples: int | None = None, scores: bool = False) -> DataFrame:
    """(group, key, label, probability), with scores also outlier_score and the cluster's persistence (null
    for noise). Exact at any size: rows are numbered within their group; a group of up to 2 * BLOCK rows is one
    task's work; of larger ones, core distances and spanning trees are found by tasks of two blocks, and the
    group's tree by rounds of joins. What one task gets of such a group is its tree in rising order: three numbers
    a row, no vectors. A row without a vector is noise, with probability 0. Rows of one key are rows of
    their own."""
    t = {c: df.schema[c].dataType.simpleString() for c in (group, key)}
    extra = ", outlier_score double, persistence double"
    rows = df.select(F.col(group).alias("gk"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    bare = rows.filter("v is null").select(F.col("gk").alias(group), F.col("k").alias(key), F.lit(-1).alias("label"), F.lit(0.0).alias("probability"), F.lit(0.0).alias("outlier_score"), F.lit(None).cast("double").alias("persistence"))
    known = rows.filter("v is not null")
    groups = stored(surrogate_ids(known.groupBy("gk").agg(F.count("*").alias("n")), ["gk"], 0, "g"))
    placed = stored(known.join(groups.withColumnRenamed("gk", "__gk"), F.col("gk").eqNullSafe(F.col("__gk"))).drop("__gk"))

    def finish(g: pd.DataFrame, out: dict) -> pd.DataFrame:
        held = pd.Series(out["persistence"], dtype="float64").reindex(out["labels"]).to_numpy()
        return pd.DataFrame({group: g["gk"].to_numpy(), key: g["k"].to_numpy(), "label": out["labels"].astype("int32"), "probability": out["probabilities"], "outlier_score": out["outliers"], "persistence": held})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        x = np.array(pdf["v"].tolist(), float)
        core = _core(x, min(min_samples or min_cluster_size, len(x)))
        return finish(pdf, condensed(len(x), *_mst(x, core), core, min_cluster_size))

    schema = f"{group} {t[group]}, {key} {t[key]}, label int, probability double{extra}"
    out = placed.filter(F.col("n") <= 2 * BLOCK).groupBy("g").applyInPandas(whole, schema).union(bare)
    large = placed.filter(F.col("n") > 2 * BLOCK)
    if not groups.filter(F.col("n") > 2 * BLOCK).isEmpty():
        # places in the order of the keys, over range partitions
        order = stored(surrogate_ids(large.select("g", "gk", "k", "v", "n"), ["g", "k", "v"], 0, "at"))
        first = order.groupBy("g").agg(F.min("at").alias("first"))
        order = stored(order.join(first, "g").withColumn("i", F.col("at") - F.col("first")).drop("at", "first"))
        core = core_distances(order.select("g", "i", "v"), min_samples or min_cluster_size)
        points = stored(order.join(core, ["g", "i"]))
        tree = stored(minimum_forest(spanning_edges(points.select("g", "i", "core", "v"))))

        def tree_labels(pts: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
            pts, edges = pts.sort_values("i"), edges.sort_values(["w", "a", "b"])
            return finish(pts, condensed(len(pts), edges["w"].to_numpy(), edges["a"].to_numpy(), edges["b"].to_numpy(), pts["core"].to_numpy(), min_cluster_size))

        made = points.select("g", "gk", "k", "i", "core").groupBy("g").cogroup(tree.groupBy("g")).applyInPandas(tree_labels, schema)
        out = out.unionByName(made)
    return out if scores else out.drop("outlier_score", "persistence")


def validity_index(x: np.ndarray, labels: np.ndarray) -> tuple[float, dict[int, float]]:
    """(DBCV, a value for each cluster): how much sparser it is between clusters than within, from -1 to 1,
    by size, noise counting in the whole. Distances are Euclidean; densities are in logarithms. A row of
    distances at a time: memory is linear in the rows. Whatever order they come in, the value is the same."""
    order = np.lexsort([labels, *x.T])
    x, labels, d = x[order], labels[order], x.shape[1]
    names = [c for c in sorted(set(labels.tolist())) if c >= 0 and (labels == c).sum() > 1]
    core, inner, sparse = {}, {}, {}
    for c in names:
        own = x[labels == c]
        core[c] = np.empty(len(own))
        for i, p in enumerate(own):
            with np.errstate(divide="ignore", over="ignore"):
                logs = -d * np.log(np.sqrt(((own - p) ** 2).sum(axis=1)))
                logs[i] = -np.inf
                top = 0 if np.isposinf(logs.max()) else logs.max()
                core[c][i] = np.exp(-(top + np.log(np.exp(logs - top).sum() / (len(own) - 1))) / d)
        weight, a, b = _mst(own, core[c])
        degree = np.bincount(np.concatenate([a, b]), minlength=len(own))
        inner[c] = np.flatnonzero(degree > 1) if (degree > 1).any() else np.arange(len(own))
        both = (degree[a] > 1) & (degree[b] > 1)
        sparse[c] = weight[both].max() if both.any() else weight.max()
    apart = dict.fromkeys(names, np.inf)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            there, far = x[labels == b][inner[b]], core[b][inner[b]]
            m = min(np.maximum(np.maximum(np.sqrt(((there - p) ** 2).sum(axis=1)), far), r).min() for p, r in zip(x[labels == a][inner[a]], core[a][inner[a]], strict=True))
            apart[a], apart[b] = min(apart[a], m), min(apart[b], m)
    value = {c: (apart[c] - sparse[c]) / max(apart[c], sparse[c]) if np.isfinite(apart[c]) and max(apart[c], sparse[c]) > 0 else 0.0 for c in names}
    return float(sum((labels == c).sum() / len(x) * value[c] for c in names)) if len(names) > 1 else 0.0, value


def _densities(rows: DataFrame) -> DataFrame:
    """(g, i, core) of rows(g, i, n, v): validity_index()'s core distances, in sums over each two blocks."""

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        x, own, t1, t2 = _held(pdf)
        ids, half, slack, made = pdf["i"].to_numpy(), x.shape[1] / 2, 1e6 * _slack(x), []
        for a, b in {(t1, t2), (t2, t1)}:
            mine, there, names, others = x[own == a], x[own == b], ids[own == a], ids[own == b]
            if a == b and len(mine) < 2:
                continue
            step = max(1, AT_ONCE // len(there))
            for at in range(0, len(mine), step):
                far = _squares(mine[at : at + step], there)
                row, col = np.nonzero(far < slack)  # too near for a rounded product
                for i in range(0, len(row), 65536):
                    r, c = row[i : i + 65536], col[i : i + 65536]
                    far[r, c] = _apart(mine[at + r], there[c]) ** 2
                far[names[at : at + step, None] == others] = np.inf
                with np.errstate(divide="ignore", invalid="ignore"):
                    logs = -half * np.log(far)
                    top = logs.max(axis=1)
                    equal = np.isposinf(top)
                    top[equal] = 0
                    made.append(pd.DataFrame({"g": pdf["g"].iloc[0], "i": names[at : at + step], "top": top, "s": np.where(equal, np.inf, np.exp(logs - top[:, None]).sum(axis=1)), "d": 2 * half}))
        return pd.concat(made) if made else pd.DataFrame({"g": [], "i": [], "top": [], "s": [], "d": []})

    found = _tiles(rows.drop("n"), 4 * BLOCK).applyInPandas(part, "g bigint, i bigint, top double, s double, d double")
    most = found.groupBy("g", "i").agg(F.max("top").alias("top"), F.max("d").alias("d"), F.max("s").alias("s"), F.collect_list(F.struct("top", "s")).alias("each"))  # one for each block
    total = F.aggregate("each", F.lit(0.0), lambda t, x: t + x["s"] * F.exp(x["top"] - F.col("top")))
    core = F.when(F.col("s") == float("inf"), 0.0).otherwise(F.exp(-(F.col("top") + F.ln(total / (F.col("n") - 1))) / F.col("d")))
    return most.join(rows.select("g", "i", "n"), ["g", "i"]).select("g", "i", core.alias("core"))


def _separations(rows: DataFrame) -> DataFrame:
    """(h, apart) of rows(g, i, h, core, v), i in the order of the clusters h of a group g: the least mutual
    reachability of a cluster's rows and those of the group's other clusters, over each two blocks."""

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x, own, t1, t2 = _held(pdf)
        h, core, slack, found = pdf["h"].to_numpy(), pdf["core"].to_numpy(), 2 * _slack(x), {}
        a, b = own == t1, own == t2
        (p, q), (hp, hq), (cp, cq) = ((z[a], z[b]) for z in (x, h, core))
        step = max(1, AT_ONCE // max(len(q), 1))

        def lower(far: np.ndarray, names: np.ndarray, at: int, turned: bool) -> None:
            least = far.min(axis=1)
            for name in np.unique(names):
                limit = least[names == name].min() + slack
                if not np.isfinite(limit):
                    continue
                some = np.flatnonzero((names == name) & (least <= limit))
                for r in some:
                    c = np.flatnonzero(far[r] <= limit)
                    i, j = (at + c, r) if turned else (at + r, c)
                    d = np.sqrt(((p[i] - q[j]) ** 2).sum(axis=1))
                    found[name] = min(found.get(name, np.inf), np.maximum(np.maximum(d, cp[i]), cq[j]).min())

        for at in range(0, len(p) if len(q) else 0, step):
            far = _squares(p[at : at + step], q)
            np.maximum(np.maximum(far, (cp[at : at + step] ** 2)[:, None], out=far), cq**2, out=far)
            far[hp[at : at + step, None] == hq] = np.inf
            lower(far, hp[at : at + step], at, False)
            lower(far.T, hq, at, True)
        return pd.DataFrame({"h": list(found), "apart": list(found.values())}).astype({"h": "int64", "apart": "float64"})

    return _tiles(rows, BLOCK).applyInPandas(part, "h bigint, apart double").groupBy("h").agg(F.min("apart").alias("apart"))


def _large_validity(rows: DataFrame) -> DataFrame:
    """(gk, dbcv) of rows(g, gk, n, label, v) of large groups: validity_index() by tasks of two blocks of rows, for
    core distances and trees of a cluster and for how far clusters of a group are apart; trees of
    large clusters come from minimum_forest()."""
    inside = rows.filter("label >= 0")
    clusters = stored(surrogate_ids(inside.groupBy("g", "label").agg(F.count("*").alias("size")).filter("size > 1"), ["g", "label"], 0, "h"))
    at = stored(surrogate_ids(inside.join(clusters, ["g", "label"]).select("g", "h", F.col("size").alias("n"), "v", F.reverse("v").alias("r")), ["h", "r"], 0, "at").drop("r"))
    first = at.groupBy("h").agg(F.min("at").alias("of_h"))
    group = at.groupBy("g").agg(F.min("at").alias("of_g"))
    points = stored(at.join(first, "h").join(group, "g").select(F.col("g").alias("group"), F.col("h").alias("g"), (F.col("at") - F.col("of_h")).alias("i"), (F.col("at") - F.col("of_g")).alias("j"), "n", "v"))
    core = stored(_densities(points.select("g", "i", "n", "v")))
    points2 = stored(points.join(core, ["g", "i"]))
    edges = stored(spanning_edges(points2.select("g", "i", "core", "v")))
    few = edges.join(clusters.select(F.col("h").alias("g"), "size"), "g")
    tree = few.filter(F.col("size") <= BLOCK).select("g", "a", "b", "w")
    many = few.filter(F.col("size") > BLOCK)
    if not many.isEmpty():
        tree = tree.union(minimum_forest(many.select("g", "a", "b", "w")).distinct())
    tree = stored(tree)
    degree = stored(tree.select("g", F.explode(F.array("a", "b")).alias("i")).groupBy("g", "i").agg((F.count("*") > 1).alias("inner")))
    ends = tree.join(degree.toDF("g", "a", "ia"), ["g", "a"]).join(degree.toDF("g", "b", "ib"), ["g", "b"])
    sparse = ends.groupBy("g").agg(F.coalesce(F.max(F.when(F.col("ia") & F.col("ib"), F.col("w"))), F.max("w")).alias("sparse"))
    alone = degree.groupBy("g").agg((~F.bool_or("inner")).alias("all"))
    chosen = points2.join(degree, ["g", "i"]).join(alone, "g").filter(F.col("inner") | F.col("all"))
    apart = _separations(stored(chosen.select(F.col("group").alias("g"), F.col("j").alias("i"), F.col("g").alias("h"), "core", "v")))
    found = clusters.join(sparse.withColumnRenamed("g", "h"), "h").join(apart, "h", "left")
    most = F.greatest("apart", "sparse")
    value = F.when(F.col("apart").isNotNull() & (most > 0), (F.col("apart") - F.col("sparse")) / most).otherwise(0.0)
    total = found.groupBy("g").agg(F.sum(F.col("size") * value).alias("s"))
    named = rows.groupBy("g", "n").agg(F.first("gk").alias("gk"))  # a row for each group
    return named.join(total, "g", "left").select("gk", F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)).alias("dbcv"))


def cluster_validity(df: DataFrame, group: str, vector: str, label: str) -> DataFrame:
    """(group, dbcv, num_clusters, noise_share): the tuning scores of each group's clustering. A group of up to
    2 * BLOCK rows is one task's work; larger ones are dealt to tasks of two blocks of their rows."""
    kind = df.schema[group].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = pdf["label"].to_numpy()
        return pd.DataFrame({"gk": [pdf["gk"].iloc[0]], "dbcv": [validity_index(np.array(pdf["v"].tolist(), float), labels)[0]]})

    rows = df.select(F.col(group).alias("gk"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    noise = F.col("label") == -1
    groups = rows.groupBy("gk").agg(F.count("*").alias("n"), F.count_distinct(F.when(~noise, F.col("label"))).cast("int").alias("num_clusters"), F.avg(noise.cast("double")).alias("noise_share"))
    groups = stored(surrogate_ids(groups, ["gk"], 0, "g"))
    placed = stored(rows.join(groups.select("g", "n", F.col("gk").alias("__gk")), F.col("gk").eqNullSafe(F.col("__gk"))).drop("__gk"))
    scores = placed.filter(F.col("n") <= 2 * BLOCK).groupBy("g").applyInPandas(one, f"gk {kind}, dbcv double")
    large = placed.filter(F.col("n") > 2 * BLOCK)
    if not groups.filter(F.col("n") > 2 * BLOCK).isEmpty():
        scores = scores.union(_large_validity(large))
    out = groups.join(scores.withColumnRenamed("gk", "__gk"), F.col("gk").eqNullSafe(F.col("__gk")))
    return out.select(F.col("gk").alias(group), "dbcv", "num_clusters", "noise_share")


def solution_scores(found: DataFrame, vectors: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """Of each group's clustering, as hdbscan(scores=True) gives it: dbcv, number of clusters and of noise
    rows, and mean and (population) standard deviation of the clusters' persistence and of the rows'
    probabilities and outlier scores. Without clusters, persistence is null."""
    noise = F.col("label") == -1
    rows = found.groupBy(group).agg(F.count_distinct(F.when(~noise, F.col("label"))).alias("num_clusters"), F.count_if(noise).alias("num_noise_points"), *(f(c).alias(f"{n}_{e}") for c, n in (("probability", "probability"), ("outlier_score", "outlier_score")) for f, e in ((F.avg, "mean"), (F.stddev_pop, "std"))))
    each = found.filter(~noise).groupBy(group, "label").agg(F.max("persistence").alias("p"))
    held = each.groupBy(group).agg(F.avg("p").alias("persistence_mean"), F.stddev_pop("p").alias("persistence_std"))
    named = vectors.select(group, key, vector).join(found.select(group, key, "label"), [group, key])
    dbcv = cluster_validity(named, group, vector, "label").select(group, "dbcv")
    return rows.join(held, group, "left").join(dbcv, group)


def soft_cluster(df: DataFrame, key: str, vector: str, label: str, train_share: float = 0.6, folds: int = 0, seed: int = 7) -> DataFrame:
    """Adds predicted and probability from a multinomial logistic model on standardised vectors, trained on
    a stratified share of the rows that aren't noise. With folds, regularisation is cross-validated over
    25 strengths from 1e-4 to 1e4."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = df.withColumn("__raw", array_to_vector(vector)).withColumn("__y", F.col(label).cast("double"))
    known = rows.filter(F.col(label) > -1)
    n = [r[0] for r in known.select(label).distinct().collect()]  # a row for each cluster
    if len(n) < 2:
        raise ValueError("soft clustering needs two clusters")
    train = known.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1000)) < int(train_share * 1000))
    lr = LogisticRegression(featuresCol="__x", labelCol="__y", probabilityCol="__p", predictionCol="__q", rawPredictionCol="__r", maxIter=50, regParam=0.01)
    pipe = Pipeline(stages=[StandardScaler(inputCol="__raw", outputCol="__x", withMean=True), lr])
    if folds:
        grid = ParamGridBuilder().addGrid(lr.regParam, [10.0 ** (-4 + 8 * e / 24) for e in range(25)]).build()
        fitted = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol="__y", predictionCol="__q", metricName="accuracy"), numFolds=folds, seed=seed).fit(train).bestModel
    else:
        fitted = pipe.fit(train)
    out = stored_model(df.sparkSession, fitted).transform(rows).withColumn("membership", vector_to_array("__p"))
    return out.withColumn("predicted", F.col("__q").cast("int")).withColumn("probability", F.array_max("membership")).drop("__raw", "__y", "__x", "__p", "__q", "__r")


def check_soft(df: DataFrame, label: str, agreement: float = 0.9) -> None:
    """Memberships must sum to (0, 1] and agree with the hard labels of most rows that aren't noise."""
    total = F.aggregate("membership", F.lit(0.0), lambda s, x: s + x)
    r = df.agg(F.min(total).alias("lo"), F.max(total).alias("hi"), F.avg(F.when(F.col(label) > -1, (F.col(label) == F.col("predicted")).cast("double"))).alias("same")).first()
    if not (r.lo > 0 and r.hi <= 1 + 1e-9):
        raise AssertionError("memberships out of range")
    if r.same < agreement:
        raise AssertionError(f"hard and soft labels agree for only {r.same:.0%}")


def cluster_info(df: DataFrame, label: str, probability: str) -> DataFrame:
    """Number of clusters (noise aside), rows, noise share and mean probability."""
    return df.agg(F.count_distinct(F.when(F.col(label) > -1, F.col(label))).alias("num_clusters"), F.count("*").alias("rows"), F.avg((F.col(label) == -1).cast("double")).alias("noise_share"), F.avg(probability).alias("mean_probability"))


def reduce_dimensions(df: DataFrame, vector: str, k: int, out: str = "reduced") -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("__v", array_to_vector(vector))
    return PCA(k=k, inputCol="__v", outputCol="__o").fit(rows).transform(rows).withColumn(out, vector_to_array("__o")).drop("__v", "__o")
