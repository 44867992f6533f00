"""Forms that a size chooses give the same rows: held graphs and joins by level, centroids in parts, n-grams
of clusters that are many tasks'."""

import random

import numpy as np
from pyspark.sql import functions as F

from citemesh.operators import clustering as K
from citemesh.operators import communities as M
from citemesh.operators import graph_algos as A
from citemesh.operators import text as X
from citemesh.operators.clustering import validity_index


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_distance_counts_of_held_and_joined_graphs(spark):
    e = spark.range(500).select((F.xxhash64("id", F.lit(1)) % 150).cast("string").alias("src"), (F.xxhash64("id", F.lit(2)) % 150).cast("string").alias("dst"))
    some = e.select(F.col("src").alias("id")).distinct().orderBy("id").limit(70).union(spark.createDataFrame([("nowhere",)], "id string"))
    for sources, most in ((None, None), (some, None), (some, 2)):
        held = rows(A.distance_counts(e, sources, most=most))
        assert held == rows(A.distance_counts(e, sources, most=most, held=0)) and held
    assert rows(A.distance_counts(e.limit(0))) == rows(A.distance_counts(e.limit(0), held=0)) == []
    loops = spark.createDataFrame([(1, 1), (2, 3), (2, 3)], "src int, dst int")
    assert rows(A.distance_counts(loops)) == [(1, 1)]


def test_nearest_centroids_in_parts(spark):
    r = np.random.default_rng(3)
    c = spark.createDataFrame([(i, r.normal(size=4).tolist(), 2020) for i in range(23)] + [(23, [0.0] * 4, 2020), (24, None, 2020)], "cluster int, embedding array<double>, year int")
    n = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(60)] + [(60, None), (61, [0.0] * 4)], "id int, embedding array<double>")
    whole = rows(M.noise_to_cluster(n, c, "id").select("id", "cluster"))
    assert whole == rows(M.noise_to_cluster(n, c, "id", part=4).select("id", "cluster"))
    have = {x.cluster: np.array(x.embedding) for x in c.collect() if x.cluster < 23}
    for x in n.filter("id < 60").collect():
        v = np.array(x.embedding)
        assert dict((k, w) for k, w in whole)[x.id] == max(have, key=lambda k: v @ have[k] / np.linalg.norm(v) / np.linalg.norm(have[k]))
    pairs = lambda p: rows(M.within_window(c.filter("cluster < 23"), 2020, p).select("cluster", "other", F.round("score", 9)))
    assert pairs(100) == pairs(5) and len(pairs(5)) == 23 * 23


def test_ngrams_of_a_cluster_in_many_tasks(spark):
    r = random.Random(5)
    docs = [(c, i, None if r.random() < 0.1 else " ".join(r.choice(["", "red", "fox", "ab"]) for _ in range(r.randint(0, 4)))) for c in ("hot", "cold", None) for i in range(400 if c == "hot" else 9)]
    df = spark.createDataFrame(docs, "cluster string, id int, text string").repartition(7)
    want = []
    for c in ("hot", "cold", None):
        words = []
        for _, i, t in sorted((d for d in docs if d[0] == c), key=lambda d: d[1]):
            words += (["[SEP]"] if i else []) + (t or "").split()
        want += [(c, " ".join(words[i : i + n])) for n in (2, 3) for i in range(len(words) - n + 1)]
    got = [tuple(x) for x in X.cluster_ngrams(df, "cluster", "text", "id").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert X.cluster_ngrams(df.limit(0), "cluster", "text", "id").count() == 0


def test_bigrams_query(spark, tmp_path):
    import re
    from collections import Counter

    from citemesh.plans.catalog import QUERIES

    r = random.Random(9)
    docs = [(i % 30, None if i == 3 else " ".join(r.choice(["the", "Red", "fox", "a", "été", "[SEP]", "x_1", ","]) for _ in range(r.randint(0, 12)))) for i in range(40)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    n, held = Counter(), {}
    for i, t in docs:
        w = [x for x in re.findall(r"\w{2,}|\[SEP\]", t or "") if x not in X.STOP_WORDS]
        for pair in zip(w, w[1:]):
            n[" ".join(pair)] += 1
            held.setdefault(" ".join(pair), set()).add(i)
    assert {(x.term, x.n, x.docs) for x in QUERIES["bigrams"](spark, str(tmp_path)).collect()} == {(k, v, len(held[k])) for k, v in n.items()}


def test_validity_over_blocks(spark, monkeypatch):
    """A large group's score is dealt over tasks of two blocks, and is that of one task: with ties, equal rows, noise,
    a cluster of two rows and one of one."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 0.3, (90, 3)), r.normal(3, 0.3, (70, 3)), r.integers(8, 11, (60, 3)).astype(float), r.uniform(-5, 15, (13, 3))])
    labels = np.concatenate([np.repeat([0, 1, 2], [90, 70, 60]), [3, 3, 4], np.full(10, -1)])
    rows = [(2000, v.tolist(), c) for v, c in zip(x, labels.tolist())] + [(2001, v.tolist(), c % 2) for v, c in zip(x[:50], range(50))] + [(None, v.tolist(), 0) for v in x[:40]]
    df = spark.createDataFrame(rows, "year int, v array<double>, label int").repartition(3)
    monkeypatch.setattr(K, "BLOCK", 32)
    got = {q.year: q for q in K.cluster_validity(df, "year", "v", "label").collect()}
    assert abs(got[2000].dbcv - validity_index(x, labels)[0]) < 1e-9 and abs(got[2001].dbcv - validity_index(x[:50], np.arange(50) % 2)[0]) < 1e-9
    assert got[None].dbcv == 0 and got[2000].num_clusters == 5 and abs(got[2000].noise_share - 10 / 233) < 1e-12


def test_products_find_the_exact_tree():
    """Core distances and trees by matrix products are those of exact distances, bit by bit, with near and equal rows."""
    r = np.random.default_rng(4)
    for k in range(20):
        x = r.integers(0, 3 + k % 4, (60, 2)).astype(float) if k % 2 else 100 + r.normal(0, 1e-6 if k % 3 else 1, (60, 8))
        core = K._core(x, 3)
        assert (core == np.array([np.sort(np.sqrt(((x - p) ** 2).sum(axis=1)))[2] for p in x])).all()
        for got, want in zip(K._mst(x, core), K._prim(x, core)):
            assert (got == want).all()


def test_cosines_within_groups_over_blocks(spark):
    r = np.random.default_rng(6)
    made = [(k % 3, k, r.normal(0, 1, 4).tolist()) for k in range(60)] + [(0, 60, [0.0] * 4), (1, 61, None), (None, 62, [1.0] * 4)]
    df = spark.createDataFrame(made, "g int, k bigint, v array<double>").repartition(3)
    got = {(q.a, q.b): q.score for q in M.cosine_within(df, ["g"], "k", "v", block=8).collect()}
    assert set(got) == {(x[1], y[1]) for x in made for y in made if x[0] is not None and x[0] == y[0] and x[1] < y[1]}
    vectors = {k: np.array(v) for _, k, v in made if v}
    for (a, b), s in got.items():
        assert s is None if {a, b} & {60, 61} else abs(s - vectors[a] @ vectors[b] / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b])) < 1e-12


def test_indel_ratios_of_many_pairs(spark):
    """Texts of all lengths, scored together or alone, against a table of common subsequences."""
    from citemesh.operators import linkage as L

    r = random.Random(8)
    texts = ["", "a", "x\0", "ÀB c", *("".join(r.choices("abÉ ", k=n)) for n in (3, 7, 8, 9, 30, 62, 63, 64, 65, 80))]

    def want(x, y):
        x, y = x.lower(), y.lower()
        row = [0] * (len(y) + 1)
        for a in x:
            row = _next(row, a, y)
        return 1.0 if not x and not y else 2 * row[-1] / (len(x) + len(y))

    def _next(row, a, y):
        out = [0]
        for j, b in enumerate(y):
            out.append(row[j] + 1 if a == b else max(out[-1], row[j + 1]))
        return out

    pairs = [(x, y) for x in texts for y in texts]
    got = L.indel_ratio.func(*(__import__("pandas").Series([*t, None]) for t in zip(*pairs)))
    assert [round(g, 12) for g in got[:-1]] == [round(want(x, y), 12) for x, y in pairs] and np.isnan(got.iloc[-1])


def test_triangles_by_lists(spark):
    e = spark.range(400).select((F.xxhash64("id", F.lit(3)) % 40).alias("src"), (F.xxhash64("id", F.lit(4)) % 40).alias("dst"))
    near: dict = {}
    for a, b in {(x, y) for r in e.collect() for x, y in ((r.src, r.dst), (r.dst, r.src)) if x != y}:
        near.setdefault(a, set()).add(b)
    got = {q.id: (q.degree, q.triangles) for q in A.clustering(e).collect()}
    assert got == {a: (len(n), sum(c in near[b] for b in n for c in n) // 2) for a, n in near.items()} and max(t for _, t in got.values()) > 3


def test_paths_keep_nodes_and_small_numbers(spark, monkeypatch):
    """What expand() writes of a path is its nodes and hops; an edge is known by its ends, not by a joint name."""
    from citemesh.operators import graph as G

    written = []
    monkeypatch.setattr(G, "stored", lambda df, f=G.stored: written.append(df.columns) or f(df))
    e = [("a>b", "c"), ("c", "a"), ("a", "b>c")]
    nodes = G.NodeSet(spark.createDataFrame([(x,) for x in ("a>b", "c", "a", "b>c")], "id string"), "N")
    g = G.PropertyGraph().add_nodes(nodes).add_edges("N", G.EdgeSet(spark.createDataFrame(e, "src string, dst string"), "R"), "N")
    got = g.expand("R", nodes.df.filter("id = 'a>b'"), 1, 5, "out").collect()
    assert sorted((x.hops, x.end_id) for x in got) == [(1, "c"), (2, "a"), (3, "b>c")]
    assert [x.edges for x in got if x.hops == 3] == [["R:a>b>c", "R:c>a", "R:a>b>c"]]
    assert written and not any({"edge", "edges", "types", "type"} & set(c) for c in written)


def test_reachable_by_arrays(spark, monkeypatch):
    """Shortest hop counts by brute force, with a hub, ids beyond 4 bytes and as text, and starts dealt to several tasks."""
    from citemesh.operators import graph as G

    r = random.Random(3)
    monkeypatch.setattr(G, "ROW_NODES", 3)
    for shift, kind in ((0, int), (2**40, int), (0, str)):
        edges = [(kind(shift + r.randint(0, 30)), kind(shift + r.randint(0, 30))) for _ in range(60)] + [(kind(shift + 5), kind(shift + i)) for i in range(20)]
        name = "string" if kind is str else "bigint"
        df = spark.createDataFrame([*edges, (edges[0][0], None)], f"src {name}, dst {name}")
        starts = [kind(shift + i) for i in range(0, 40, 3)]
        want = []
        for s in starts:
            met, at = {s: 0}, {s}
            for k in range(1, 4):
                at = {b for a, b in edges if a in at} - met.keys()
                met |= dict.fromkeys(at, k)
            want += [(s, n, k) for n, k in met.items() if k]
        assert rows(G.reachable(df, spark.createDataFrame([(s,) for s in starts], f"id {name}"), 3)) == sorted(want)


def test_partitions_follow_the_edges(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(M, "TASK_ROWS", 10, raising=False)
    monkeypatch.setattr(M, "stored", lambda df, parts=0, f=M.stored: asked.append(parts) or f(df, parts))
    edges = spark.createDataFrame([(i, i % 7 + 100) for i in range(60)], "citing bigint, cited bigint")
    clusters = spark.createDataFrame([(i + 100, i % 2) for i in range(7)] + [(0, 5)], "paper bigint, cluster int")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    got = {(x.paper, x.cluster): x.fraction for x in M.citation_fractions(edges, clusters).collect()}
    assert got == {**{(i, i % 7 % 2): 1.0 for i in range(60)}, (100, 5): 1.0}
    assert max(asked) == 12 and spark.conf.get("spark.sql.shuffle.partitions") == was
