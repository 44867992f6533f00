"""Literal fixtures, one for each semantic corner."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citemesh.functions import columns as C
from citemesh.functions import nested as N
from citemesh.operators import communities as M
from citemesh.operators import graph as G
from citemesh.operators import graph_algos as A
from citemesh.operators import linkage as L
from citemesh.operators import modeling as D
from citemesh.operators import relational as R
from citemesh.operators import text as X
from citemesh.operators.clustering import density_labels, hdbscan
from citemesh.operators.embedding import HashingEmbedder, sage_layer
from citemesh.plans.pipeline import CANCEL, Pipeline, PipelineFlag, Stage
from citemesh.sources import bibliographic as B
from citemesh.sources import sinks
from citemesh.streaming.ingest import ingest


def one(spark, c, **cols):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items())).select(c.alias("x")).first().x


def test_positions(spark):
    df = spark.createDataFrame([([("1", "A"), ("2", "B"), ("3", "C")],), ([("1", "A")],), ([("1", "B"), ("2", "A")],)], "a array<struct<authorId:string,name:string>>")
    got = [r.x for r in df.select(N.author_positions(F.col("a")).alias("x")).collect()]
    assert [(p.authorListPosition, p.authorListPositionReversed, p.authorListAlphabetized) for p in got[0]] == [(1, -3, True), (2, -2, True), (3, -1, True)]
    assert [(p.authorListPosition, p.authorListPositionReversed, p.authorListAlphabetized) for p in got[1]] == [(1, -1, False)]
    assert not got[2][0].authorListAlphabetized


def test_grants_uneven(spark):
    df = spark.createDataFrame([([1, 2, 3], ["x", "y"])], "i array<int>, a array<string>")
    got = df.select(N.zip_structs(grantId=F.col("i"), funder=F.col("a")).alias("x")).first().x
    assert [tuple(g) for g in got] == [(1, "x"), (2, "y")]


def test_best_score(spark):
    df = spark.createDataFrame([("q", 10.0, "a"), ("q", 9.8, "b"), ("q", 5.0, "c"), ("q", 4.9, "d"), ("one", 3.0, "z")], "k string, score double, goal string")
    assert [(r.k, r.score) for r in L.best_score(df, "k", "score", "goal").collect()] == [("q", 9.8)]
    # relative to the next score: (9.8 - 5) / 5 is 0.96, and 10 against 8.2 is 0.2195 of 8.2
    assert L.best_score(df, "k", "score", "goal", 0.95).count() == 1 and L.best_score(df, "k", "score", "goal", 0.97).count() == 0
    two = spark.createDataFrame([("q", 10.0, "a"), ("q", 8.2, "b"), ("z", 1.0, "c"), ("z", 0.0, "d")], "k string, score double, goal string")
    assert {(r.k, r.score) for r in L.best_score(two, "k", "score", "goal").collect()} == {("q", 10.0), ("z", 1.0)}


def test_scalars(spark):
    assert one(spark, C.jaccard(F.array(F.lit(1), F.lit(2), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)
    assert one(spark, C.interdisciplinarity(F.array(F.lit(0.5), F.lit(0.5)))) == 1.0
    assert one(spark, C.interdisciplinarity(F.array(F.lit(1.0), F.lit(0.0)))) == 0.0
    assert one(spark, C.clean_special(F.lit("a+b&&c(d)?"))) == "abcd"
    assert one(spark, C.clean_special(F.lit("#1 a/b;c'd\\e||f"))) == "1 ab;c'd\\ef"
    assert one(spark, C.full_citation(F.array(F.lit("Ann Lee"), F.lit("Bo Ek")), F.lit("2001-05-06").cast("date"), F.lit("A Title"), F.lit("Nature"))) == 'ann lee, bo ek 2001, "a title" nature'
    assert one(spark, C.full_citation(F.lit(None).cast("array<string>"), F.lit(None).cast("date"), F.lit(None).cast("string"), F.lit("X"))) == ' , "" x'
    assert one(spark, C.preprocess_text(F.lit("Hé Llo\nx_y"))) == "h llo xy"
    assert one(spark, C.fill_vector(F.array(F.lit(0), F.lit(2)), F.array(F.lit(0.25), F.lit(0.5)), 3)) == [0.25, 0.0, 0.5]
    with pytest.raises(Exception):
        one(spark, C.fill_vector(F.array(F.lit(3)), F.array(F.lit(1.0)), 3))
    with pytest.raises(ValueError):
        C.spark_type("decimal")
    assert C.spark_type("date[]") == "array<date>" and "point[]" in C.allowed_types()


def test_condense(spark):
    df = spark.createDataFrame([(1, "Yes", "No"), (2, "No", "No"), (3, "No", "Yes"), (4, "Yes", "Yes")], "i int, A string, B string")
    C.check_flags(df, ["A", "B"])
    assert [r.x for r in df.orderBy("i").select(C.condense_flags(["A", "B"]).alias("x")).collect()] == ["A", None, "B", "A;B"]
    with pytest.raises(ValueError):
        C.check_flags(df.filter("A = 'Yes'"), ["A"])


SIZES = {"a": 100, "b": 100, "x": 105, "y": 111}


def events(spark, scores, sizes, threshold=0.5):
    n = {"a": 0, "b": 1, "x": 0, "y": 1, "z": 2, "d": 2}
    clusters = spark.createDataFrame([(2000 if k in "abd" else 2001, n[k], s) for k, s in sizes.items()], "year int, cluster int, size int")
    sim = spark.createDataFrame([(2001, n[p], n[q], s) for (p, q), s in scores.items()], "year int, c_t int, c_t1 int, score double")
    return M.Events(clusters, sim, threshold, 0.1)


@pytest.mark.parametrize(
    "scores,sizes,want",
    [
        ({("a", "x"): 0.9, ("b", "x"): 0.9}, {"a": 1, "b": 1, "x": 2}, {("merge", 2, 1)}),
        ({("a", "x"): 0.9, ("a", "y"): 0.9}, {"a": 1, "x": 1, "y": 1}, {("split", 1, 2)}),
        ({("a", "x"): 0.1}, {"a": 1, "x": 1}, {("birth", 0, 1), ("death", 1, 0)}),
        ({("a", "x"): 0.9}, {"a": 100, "x": 105}, {("continuation", 1, 1)}),
        ({("a", "x"): 0.9}, {"a": 100, "x": 111}, {("expansion", 1, 1)}),
        ({("a", "x"): 0.9}, {"a": 100, "x": 89}, {("contraction", 1, 1)}),
        ({("a", "x"): 0.9}, {"a": 100, "x": 110}, {("continuation", 1, 1)}),
        ({("a", "x"): 0.9}, {"a": 100, "x": 90}, {("contraction", 1, 1)}),
    ],
)
def test_events(spark, scores, sizes, want):
    e = events(spark, scores, sizes)
    assert {(r.event_type, len(r.c_t or []), len(r.c_t1 or [])) for r in e.check().collect()} == want


def test_temporal_split(spark):
    df = spark.range(100).select(F.when(F.col("id") < 40, 2000).when(F.col("id") < 70, 2001).otherwise(2002).alias("Year"))
    assert {r.Year for r in R.temporal_split(df, "Year", 0.6).filter("part = 'train'").collect()} == {2000}


def test_walk_forward_and_masks(spark):
    got = R.walk_forward(spark.range(10), ["id"], 0.6).collect()
    assert {r.id for r in got if r.part == "train"} == set(range(6)) and {r.id for r in got if r.part == "test"} == set(range(6, 10))
    m = R.position_masks(spark.range(10), ["id"]).collect()
    assert [sum(r[k] for r in m) for k in ("train", "val", "test")] == [6, 2, 2]


def test_endpoint_rules(spark):
    nodes = G.NodeSet.build(spark.createDataFrame([("1",), ("2",), (None,), ("1",)], "k string"), "P", "k")
    assert nodes.df.count() == 2
    e = spark.createDataFrame([("1", "2"), (None, "2"), ("1", "2"), ("1", "9"), ("2", "2")], "s string, d string")
    assert [tuple(r) for r in G.EdgeSet.build(e, "CITED_BY", "s", "d", nodes, nodes).df.collect()] == [("1", "2")]


def test_ideal_point(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 1.0), (2, 0.8, 0.8)], "t int, a double, b double")
    r = D.best_trial(df, {"a": "maximize", "b": "maximize"}, "t").first()
    assert r.t == 2 and r.distance == pytest.approx(0.08**0.5)
    assert {x.t for x in D.pareto(df, "t", {"a": "maximize", "b": "maximize"}).collect()} == {0, 1, 2}


def test_surrogate_ids_are_gapless(spark):
    got = R.surrogate_ids(spark.range(100).repartition(7), ["id"], 5, "n").orderBy("id").collect()
    assert [r.n for r in got] == list(range(5, 105))


def test_indel_ratio(spark):
    df = spark.createDataFrame([("abcd", "ABXD"), ("", ""), ("a", "b"), (None, "x")], "a string, b string")
    assert [r.x for r in df.select(L.indel_ratio("a", "b").alias("x")).collect()] == [0.75, 1.0, 0.0, None]


def test_affiliations(spark):
    p = spark.createDataFrame([("p", [("1", [("X",)]), ("2", [("Y",)])])], "id string, authors array<struct<authorId:string,institutions:array<struct<institution:string>>>>")
    assert {tuple(r) for r in N.affiliations(p).collect()} == {("1", "X"), ("2", "Y")}
    assert len(N.affiliations(p, compat=True).collect()) == 4


def test_trails_over_several_types(spark):
    """Every path without a repeated edge, by brute force, on a small graph with loops and two labels."""
    import random

    r = random.Random(6)
    knows = sorted({(f"a{r.randint(0, 5)}", f"a{r.randint(0, 5)}") for _ in range(9)} | {("a1", "a1")})
    wrote = sorted({(f"a{r.randint(0, 5)}", f"b{r.randint(0, 2)}") for _ in range(5)})
    frame = lambda rows, cols: spark.createDataFrame(rows, cols)
    people, books = (G.NodeSet(frame([(f"{k}{i}", i) for i in range(n)], "id string, no int"), label) for k, n, label in (("a", 6, "Person"), ("b", 3, "Book")))
    g = G.PropertyGraph().add_nodes(people).add_nodes(books)
    g.add_edges("Person", G.EdgeSet(frame([*knows, ("a0", "gone")], "src string, dst string"), "KNOWS"), "Person").add_edges("Person", G.EdgeSet(frame(wrote, "src string, dst string"), "WROTE"), "Book")
    edges = [("KNOWS", *e) for e in knows] + [("WROTE", *e) for e in wrote]

    def trails(at, way, most):
        out, todo = [], [(at, (), (at,))]
        while todo:
            node, used, nodes = todo.pop()
            for e in edges:
                for a, b in {"out": [(e[1], e[2])], "in": [(e[2], e[1])], "both": sorted({(e[1], e[2]), (e[2], e[1])})}[way]:
                    if a == node and e not in used and len(used) < most:
                        todo.append((b, (*used, e), (*nodes, b)))
                        out.append((at, (*nodes, b), tuple(f"{t}:{x}>{y}" for t, x, y in (*used, e))))
        return out

    starts = people.df.select("id")
    for way in ("out", "in", "both"):
        got = g.expand("KNOWS|WROTE", starts, 1, 4, way).collect()
        want = [t for i in range(6) for t in trails(f"a{i}", way, 4)]
        assert sorted((x.start_id, tuple(x.nodes), tuple(x.edges)) for x in got) == sorted(want)
        assert all(x.hops == len(x.types) == len(x.edges) and x.end_id == x.nodes[-1] and x.end_label == ("Book" if x.end_id[0] == "b" else "Person") for x in got)
    two = g.path([("KNOWS*0..2", "out"), ("WROTE", "out")], F.col("n0_no") < 2)
    heads = [(f"a{i}", f"a{i}") for i in range(2)] + [(s, n[-1]) for i in range(2) for s, n, e in trails(f"a{i}", "out", 2) if all(x.startswith("KNOWS") for x in e)]
    assert sorted((x.n0_id, x.n1_id, x.n2_id) for x in two.collect()) == sorted((s, n, b) for s, n in heads for a, b in wrote if a == n)
    hops = [("KNOWS", "both"), ("KNOWS|WROTE", "out"), ("WROTE", "in")]
    want = {(x.n0_id, x.n3_id): x["count"] for x in g.path([("KNOWS", "out"), ("KNOWS", "in"), ("WROTE", "out")]).groupBy("n0_id", "n3_id").count().collect()}
    assert {(x.start_id, x.end_id): x.paths for x in g.path_counts([("KNOWS", "out"), ("KNOWS", "in"), ("WROTE", "out")]).collect()} == want
    assert g.path_counts(hops, starts.limit(0)).count() == 0 and g.expand("KNOWS", starts.limit(0)).count() == 0


def test_paths_and_betweenness(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src int, dst int")
    assert {tuple(r) for r in A.shortest_paths(e).collect()} == {(1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 3, 1), (2, 4, 2), (3, 4, 1)}
    assert {tuple(r) for r in A.betweenness(e).collect()} == {(1, 0.0), (2, 2.0), (3, 2.0), (4, 0.0)}


def test_paths_in_batches(spark):
    """Scores and distances of random graphs, sources in batches, by brute force."""
    import random
    from collections import deque
    from heapq import heappop, heappush

    r = random.Random(8)
    rows = [(r.randint(0, 13), r.randint(0, 13), r.choice([0.0, 1.0, 2.5, 7.0, None])) for _ in range(45)]
    e = spark.createDataFrame(rows, "src int, dst int, weight double")
    near = {i: sorted({b for a, b, _ in rows if a == i and b != i}) for i in range(14)}
    ids = {x for a, b, _ in rows if a != b for x in (a, b)}

    def brandes(sources):
        score = dict.fromkeys(ids, 0.0)
        for s in sources:
            d, n, order, todo = {s: 0}, {s: 1}, [], deque([s])
            while todo:
                v = todo.popleft()
                order.append(v)
                for w in near[v]:
                    if w not in d:
                        d[w], n[w] = d[v] + 1, 0
                        todo.append(w)
                    if d[w] == d[v] + 1:
                        n[w] += n[v]
            lent = dict.fromkeys(order, 0.0)
            for v in reversed(order):
                lent[v] = sum(n[v] / n[w] * (1 + lent[w]) for w in near[v] if d[w] == d[v] + 1)
                score[v] += lent[v] if v != s else 0
        return {k: round(v, 9) for k, v in score.items()}

    assert {x.id: round(x.score, 9) for x in A.betweenness(e, batch=8).collect()} == brandes(ids)
    some = spark.createDataFrame([(1,), (5,), (99,)], "id int")
    assert {x.id: round(x.score, 9) for x in A.betweenness(e, some).collect()} == brandes({1, 5} & ids)

    want = {}
    for s in {a for a, b, w in rows if w is not None and a != b}:
        best, heap = {}, [(0.0, s)]
        while heap:
            x, v = heappop(heap)
            if v not in best:
                best[v] = x
                for a, b, w in rows:
                    if a == v and w is not None and a != b:
                        heappush(heap, (x + w, b))
        want |= {(s, v): x for v, x in best.items() if v != s}
    assert {(x.src, x.dst): x.distance for x in A.weighted_paths(e, None, 1.5, 8).collect()} == want
    assert {(x.src, x.dst): x.distance for x in A.weighted_paths(e, some).collect()} == {k: v for k, v in want.items() if k[0] in (1, 5)}
    assert A.weighted_paths(e, some.limit(0)).count() == 0
    with pytest.raises(ValueError, match="negative"):
        A.weighted_paths(spark.createDataFrame([(1, 2, -1.0)], "src int, dst int, weight double"))


def test_describe_and_distances(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2)], "src int, dst int")
    assert {tuple(r) for r in A.distance_counts(e).collect()} == {(1, 4), (2, 4), (3, 1)}
    path = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert [tuple(r) for r in A.distance_counts(path.filter("src < 5")).collect()] == [(k, 6 - k) for k in range(1, 6)]
    cycle = spark.range(300).select(F.col("id").alias("src"), ((F.col("id") + 1) % 12 + F.floor(F.col("id") / 12) * 12).alias("dst"))
    assert {r.n for r in A.distance_counts(spark.range(300).select(F.col("id").alias("src"), (F.floor(F.col("id") / 3) * 3 + (F.col("id") + 1) % 3).alias("dst"))).collect()} == {300} and cycle.count() == 300
    d = A.flagged(A.describe(spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "id int"), e, True)).first()
    assert (d.isolates, d.diameter, d.isolate_fraction) == (1, 3, 0.2) and abs(d.efficiency - 15 / 9) < 1e-9 and abs(d.transitivity - (1 + 1 + 1 / 3) / 5) < 1e-9
    assert [f.partition(":")[0] for f in d.flags] == ["beta", "alpha", "gamma", "transitivity"]


def test_negative_edges_follow_their_weights(spark):
    e = spark.range(4000).select(F.col("id").alias("src"), F.when(F.col("id") < 3000, 1).otherwise(2).alias("dst"))
    got = {r.neg_dst: r["count"] for r in A.negative_edges(e, 5).groupBy("neg_dst").count().collect()}
    want = 3000**0.75 / (3000**0.75 + 1000**0.75)
    assert sum(got.values()) == 20_000 and abs(got[1] / 20_000 - want) < 0.02
    shared = A.negative_edges(e, 2, shared=True)
    assert shared.count() == 8000 and shared.select("src", "neg_dst").distinct().count() <= 8000


def test_louvain_goes_on_over_levels(spark):
    """A ring of 12 triangles: communities of triangles, and then of neighbouring ones."""
    pairs = [(3 * t + a, 3 * t + b) for t in range(12) for a, b in ((0, 1), (1, 2), (0, 2))] + [(3 * t, 3 * ((t + 1) % 12) + 1) for t in range(12)]
    e = spark.createDataFrame(pairs, "src int, dst int")
    labels = A.louvain(e)
    triangles = spark.range(36).select(F.col("id").cast("int").alias("id"), F.floor(F.col("id") / 3).alias("community"))
    w = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit(1.0).alias("weight"))
    assert labels.count() == 36 and A.modularity(w, labels) >= A.modularity(w, triangles) - 0.05


def test_cluster_ngrams_cross_documents(spark):
    df = spark.createDataFrame([("c", 1, "the red apple"), ("c", 2, None), ("c", 3, "Green"), ("d", 1, "one two one two")], "cluster string, id int, text string")
    got = sorted((r.cluster, r.term) for r in X.cluster_ngrams(df, "cluster", "text", "id").collect())
    c = ["red", "apple", "[SEP]", "[SEP]", "Green"]
    want = [("c", " ".join(c[i : i + n])) for n in (2, 3) for i in range(len(c) - n + 1)] + [("d", t) for t in ("one two", "two one", "one two", "one two one", "two one two")]
    assert got == sorted(want)
    # by hand: 7 and 5 n-grams, so the mean is 6; `one two` is twice in all, the others once
    s = {r.term: r.score for r in X.cluster_tfidf(df, "cluster", "text", "id").filter("cluster = 'd'").collect()}
    raw = {"one two": 2 * np.log(6 / 2), "two one": np.log(6), "one two one": np.log(6), "two one two": np.log(6)}
    length = np.sqrt(sum(v * v for v in raw.values()))
    assert {k: round(v, 9) for k, v in s.items()} == {k: round(v / length, 9) for k, v in raw.items()}


def test_fuzzy_best_is_all_pairs(spark):
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcAB ") for _ in range(r.randint(0, 9)))
    left, right = [(i, i % 3, word()) for i in range(60)] + [(99, 1, None)], [(i, i % 3, word()) for i in range(50)] + [(98, 1, None)]

    def ratio(a, b):
        a, b = a.lower(), b.lower()
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return 2 * t[-1][-1] / (len(a) + len(b)) if a or b else 1.0

    l = spark.createDataFrame(left, "row_id int, block int, name string")
    q = spark.createDataFrame(right, "rid int, block int, found string")
    long = [(200 + i, 1, "".join(r.choice("abcdefgh İé") for _ in range(r.randint(5, 60)))) for i in range(25)]
    typos = lambda t: "".join(c for c in t if r.random() > 0.06) + r.choice(["", "x"])
    left += long
    right += [(300 + i, 1, typos(t)) for i, (_, _, t) in enumerate(long * 2)]
    l, q = spark.createDataFrame(left, l.schema), spark.createDataFrame(right, q.schema)
    for least in (0.5, 0.9, 0.0):
        got = {x.row_id: (x.rid, round(x.score, 9)) for x in L.fuzzy_best(l, q, ["block"], "name", "found", least, "rid").collect()}
        want = {}
        for i, b, a in left:
            best = min(((-ratio(a, f), j) for j, c, f in right if c == b and a is not None and f is not None and ratio(a, f) >= least), default=None)
            if best:
                want[i] = (best[1], round(-best[0], 9))
        assert got == want, least


def test_fuzzy_candidates_are_few(spark):
    """Long titles at a high threshold: about as many pairs as there are matches, not the square."""
    import random

    r = random.Random(4)
    titles = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(8)) for _ in range(600)]
    l = spark.createDataFrame([(1, t) for t in titles], "b int, __l string")
    q = spark.createDataFrame([(1, t[:20] + t[22:]) for t in titles], "b int, __t string")
    found = {(x["__l"], x["__t"]) for x in L.fuzzy_candidates(l, q, ["b"], 0.92).collect()}
    assert {(t, t[:20] + t[22:]) for t in titles} <= found and len(found) < 600 * 600 / 10


def test_publication_graph(spark):
    from citemesh.operators import builders as B

    inst = "array<struct<institution:string,city:string,country:string>>"
    rows = [
        ("p1", "2001-01-01", "a\nb", ["p2", "x9", None], [("1", "Ann", [("U", "Oslo", "NO")], 1), ("2", "Bo", [("F", None, "SE")], 2)], [("g1", "F"), ("", "G"), ("g2", "F")]),
        ("p2", "2002-01-01", "t", ["p2"], [("1", "Ann", [("U", "Rome", "IT")], 1), (None, "No", [], 2)], [("g", "")]),
        (None, None, None, None, None, None),
    ]
    r = spark.createDataFrame(rows, f"id string, date string, title string, ref_ids array<string>, authors array<struct<authorId:string,name:string,institutions:{inst},authorListPosition:int>>, funding array<struct<grantId:string,funder:string>>")
    people, papers, (whole, funders, only) = B.author_nodes(r), B.publication_nodes(r, [{"old": "title", "new": "title", "type": "string"}], text=("title",)), B.organisation_nodes(r)
    assert {tuple(x) for x in people.df.collect()} == {("1", "Ann"), ("2", "Bo")} and people.labels == "Person;Author"
    assert {tuple(x) for x in papers.df.collect()} == {("p1", "ab"), ("p2", "t"), ("x9", None)}
    assert {x.id for x in funders.df.collect()} == {"F", "G"} and {x.id for x in only.df.collect()} == {"U"} and {(x.id, tuple(x.cities or ())) for x in whole.df.collect()} == {("U", ("Oslo",)), ("F", (None,)), ("G", ())}
    assert {(x.src, x.dst) for x in B.citation_edges(r, papers).df.collect()} == {("p2", "p1"), ("x9", "p1")}
    wrote = B.authorship_edges(r, people, papers)
    assert {(x.src, x.dst, x.authorListPosition) for x in wrote.df.collect()} == {("1", "p1", 1), ("2", "p1", 2), ("1", "p2", 1)}
    assert {(x.src, x.dst) for x in B.affiliation_edges(r, people, whole).df.collect()} == {("1", "U"), ("2", "F")}
    assert {(x.src, x.dst, x.grantId) for x in B.funding_edges(r, whole, papers).df.collect()} == {("F", "p1", "g1"), ("G", "p1", None)}
    g = G.PropertyGraph().add_nodes(people).add_nodes(papers).add_edges("Person", wrote, "Publication").add_edges("Publication", B.citation_edges(r, papers), "Publication")
    assert {(x.n0_id, x.n2_id, x.n3_id) for x in g.path([("WROTE", "out"), ("CITED_BY", "out"), ("WROTE", "in")], F.col("n0_name") == "Ann").collect()} == {("1", "p1", "1"), ("1", "p1", "2")}
    d = g.describe(full=True)
    assert {tuple(x) for x in d["labels"].collect()} == {("Person;Author", 2), ("Publication", 3)} and {tuple(x) for x in d["types"].collect()} == {("WROTE", 3), ("CITED_BY", 2)}
    assert d["isolates"].count() == 0 and d["stats"].first().num_nodes == 5
    assert G.is_directed("(a)-[r]->(b)") and not G.is_directed("(a)-[r]-(b)")
    assert {x.id for x in g.properties_of("Person", spark.createDataFrame([("2", "test")], "id string, part string")).collect()} == {"2"}
    lookup = spark.createDataFrame([("a street", "0150", "Oslo", "NO", 1.0, 2.0)], "street string, postalcode string, city string, country string, lat double, lon double")
    placed = whole.df.withColumns({"addresses": F.array(F.lit("elsewhere")), "postalCodes": F.array(F.lit("0150")), "states": F.lit(None).cast("array<string>")})
    assert [(x.id, x.lat, x.tier) for x in L.geocode_institutions(placed, lookup).collect()] == [("U", 1.0, 2)]


def test_death_rows(spark):
    cols = "t1 string, year1 int, born1 boolean, died1 boolean, event_type string, t2 string, born2 boolean, died2 boolean"
    rows = [("a", 2001, True, True, None, None, None, None), ("b", 2000, False, True, None, None, None, None), ("c", 2001, False, False, "SPLITS_INTO", "d", False, True), ("c", 2001, False, False, "SPLITS_INTO", "e", False, False), ("f", 2001, False, False, "MERGES_INTO", "d", False, True), ("g", 2002, False, True, None, None, None, None)]
    got = {r.key: (r.SPLITS_INTO, r.MERGES_INTO, r.CONTINUES_AS, r.DIES) for r in M.event_matrix_with_deaths(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"a": (0, 0, 0, 1), "b": (0, 0, 0, 1), "c": (2, 0, 0, 0), "d": (0, 0, 0, 1), "f": (0, 1, 0, 0)}


def test_responses(spark):
    body = lambda x: __import__("json").dumps(x)
    r = spark.createDataFrame([("http://s/paper/search?query=%22Red+Apples%22&fields=title", body({"total": 2, "data": [{"paperId": "1", "title": "Red apple"}, {"paperId": "2", "title": "red apples", "externalIds": {"DOI": "d2"}}]})), ("http://s/paper/search?query=none", body({"total": 0, "data": []})), ("u", "not json")], "url string, body string")
    assert [(x.query, x.paper_id, x.doi, x.score) for x in B.scholar_matches(r).collect()] == [('"Red Apples"', "2", "d2", 1.0)]
    one = spark.createDataFrame([("a", body({"paperId": "1", "title": "t", "authors": []})), ("b", body({"paperId": "1", "title": "t"})), ("c", body({"error": "Paper not found"})), ("d", ""), ("e", body({"message": "Forbidden"}))], "url string, body string")
    assert [(x.request, x.paperId, x.authors) for x in B.scholar_papers(one).collect()] == [("a", "1", None)]
    c = spark.createDataFrame([("a", body({"message": {"items": [{"DOI": "x", "title": ["X"], "score": 9.0}, {"DOI": "y", "title": ["Y"], "score": 3.0}]}})), ("b", body({"message": [{"DOI": "z", "score": 2.0}, {"score": 1.0}]})), ("c", "?")], "url string, body string")
    assert {(x.url, x.DOI, x.title) for x in B.crossref_matches(c).collect()} == {("a", "x", "X"), ("b", "z", None)}
    g = spark.createDataFrame([("a", body([{"display_name": "Oslo", "lat": "59.5", "lon": "10.25"}])), ("b", "[]")], "url string, body string")
    assert [tuple(x) for x in B.geocoded(g).collect()] == [("a", "Oslo", 59.5, 10.25)]
    p = spark.createDataFrame([("Oslo", None)], "city string, state string")
    assert B.geocode_urls(p, "http://g", {"city": "city", "state": "state"}).first().url == "http://g/search?format=json&limit=1&city=Oslo"
    h = spark.createDataFrame([("http://s/select?q=solar+cells&rows=0", body({"response": {"numFound": 60000}}))], "url string, body string")
    assert [tuple(x)[1:] for x in B.hit_counts(h).collect()] == [("solar cells", 60_000)]
    assert B.solr_urls(B.hit_counts(h), "http://s", start=1).count() == 2
    b = spark.createDataFrame([("2020-01-01", "2020-01-31", 30_000), ("2020-02-01", "2020-02-29", 10)], "bucket_start string, bucket_end string, hits int").withColumns({c: F.col(c).cast("date") for c in ("bucket_start", "bucket_end")})
    urls = B.bucket_urls(b, "http://s", fields=["id", "doi"]).orderBy("number", "start").collect()
    assert [(u.number, u.start) for u in urls] == [(0, 0), (0, 25_000), (1, 0)] and "2020-02-29T00%3A00%3A00Z" in urls[2].url and "fl=id,doi" in urls[0].url
    assert B.bucket_urls(b, "http://s", start=1).count() == 1
    with pytest.raises(ValueError):
        B.scholar_urls(p, "http://s", "city", fields=["nope"])
    assert B.scholar_urls(p, "http://s", "city", "Author").first().url == "http://s/author/Oslo"
    assert B.secret(spark, "K", {"K": "v"}) == "v"
    with pytest.raises(KeyError):
        B.secret(spark, "NONE_SUCH", {})


def test_schema_helpers_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], "x")], "a int, `b:string[]` array<string>, c string")
    assert C.columns_of_class(df, "string") == ["b:string[]", "c"] and C.columns_of_class(df, "int") == ["a"]
    assert C.check_header_types(df, "string[]") == ["b:string[]"] and C.check_header_types(df, ":int", "int", csv=False) == ["a"]
    with pytest.raises(ValueError):
        C.check_header_types(df, ":int", "int")
    assert one(spark, C.utc_text(F.lit("2020-07-01 12:00:00").cast("timestamp_ntz"), "Europe/Oslo")) == "2020-07-01T10:00:00Z"
    assert one(spark, C.repaired_doi(F.lit(None).cast("string"), F.array(F.lit("a"), F.lit("b")))) == "b"
    nodes = G.NodeSet.build(spark.createDataFrame([("1", "a"), ("2", "b")], "id string, t string"), "P", "id", [{"old": "t", "new": "t", "type": "string"}])
    edges = G.EdgeSet(spark.createDataFrame([("1", "2")], "src string, dst string"), "E")
    for form in ("csv", "json", "parquet"):
        sinks.write_graph({"P": nodes}, {"E": edges}, str(tmp_path / form), form)
        assert spark.read.format(form).option("header", True).load(str(tmp_path / form / "nodes" / "P")).count() == 2
    assert sinks.import_command_of({"P": nodes}, {"E": ("P", edges, "P")}, str(tmp_path / "i")).count("--") == 4
    out = str(tmp_path / "put")
    __import__("os").makedirs(out)

    def put(kind, name, batch):
        import os
        import uuid

        with open(os.path.join(out, f"{kind}-{name}-{uuid.uuid4().hex}"), "w") as f:
            f.write(str(batch.num_rows))

    assert sinks.put_graph({"P": nodes}, {"E": edges}, put) == {"P": 2, "E": 1}
    assert sum(int((tmp_path / "put" / f).read_text()) for f in __import__("os").listdir(out)) == 3
    sinks.upload(spark.createDataFrame([("x",), ("y",)], "value string"), str(tmp_path / "up"), "text")
    assert sinks.transfer_snapshot(spark, str(tmp_path / "up"), str(tmp_path / "down")) == 2


def test_validity_and_large_groups(spark):
    from citemesh.operators.clustering import validity_index

    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 0.1, (40, 2)), r.normal(5, 0.1, (40, 2))])
    good, each = validity_index(x, np.repeat([0, 1], 40))
    bad, _ = validity_index(x, np.tile([0, 1], 40))
    assert good > 0.8 and bad < 0 and set(each) == {0, 1}
    slices = np.concatenate([x, r.normal(2, 1, (8000, 2))])
    import tracemalloc

    tracemalloc.start()
    validity_index(slices, np.concatenate([np.repeat([0, 1], 40), np.full(8000, -1)]))
    assert tracemalloc.get_traced_memory()[1] < 20 << 20  # no table of all pairs
    tracemalloc.stop()


def test_density_clusters_of_any_size(spark, monkeypatch):
    """A group dealt over many tasks has the labels of one in a single task, with ties (points of a grid),
    equal rows, a group without clusters and rows without vectors."""
    from citemesh.operators import clustering as K

    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 0.3, (40, 3)), r.normal(3, 0.3, (40, 3)), r.integers(8, 11, (50, 3)).astype(float), r.uniform(-5, 15, (15, 3))])
    rows = [(2000, i, v.tolist()) for i, v in enumerate(x)] + [(2001, 500 + i, v.tolist()) for i, v in enumerate(x[:12])] + [(2002, 900, [1.0, 2.0, 3.0]), (2002, 901, None), (None, 950, [0.0] * 3)]
    df = spark.createDataFrame(rows, "year int, k int, v array<double>").repartition(3)
    want = {q.k: q for q in K.hdbscan(df, "year", "k", "v", scores=True).collect()}
    labels, prob, held = density_labels(x, 5)
    assert [want[i].label for i in range(len(x))] == labels.tolist() and len(held) >= 2 and all(0 <= p <= 1 for p in held.values())
    assert np.allclose([want[i].probability for i in range(len(x))], prob)
    monkeypatch.setattr(K, "BLOCK", 32)
    got = {q.k: q for q in K.hdbscan(df, "year", "k", "v", scores=True).collect()}
    assert got == want and len(got) == len(rows) and got[901].label == got[900].label == got[950].label == -1
    scores = {q.year: q for q in K.solution_scores(spark.createDataFrame(list(want.values()), K.hdbscan(df, "year", "k", "v", scores=True).schema), df.filter("v is not null"), "year", "k", "v").collect()}
    s = scores[2000]
    assert (s.num_clusters, s.num_noise_points) == (len(held), int((labels == -1).sum()))
    assert abs(s.persistence_mean - np.mean(list(held.values()))) < 1e-12 and abs(s.probability_std - prob.std()) < 1e-9 and abs(s.dbcv - K.validity_index(x, labels)[0]) < 1e-9
    far = [want[i].outlier_score for i in range(len(x) - 15, len(x))]
    assert all(0 <= q.outlier_score <= 1 for q in want.values()) and np.mean(far) > s.outlier_score_mean


def test_tree_is_the_smallest(spark):
    """Of the total order of edges, by sorting them all."""
    from citemesh.operators import clustering as K

    x = np.random.default_rng(5).integers(0, 4, (40, 2)).astype(float)
    core = K._core(x, 3)
    every = sorted((max(np.sqrt(((x[a] - x[b]) ** 2).sum()), core[a], core[b]), a, b) for b in range(40) for a in range(b))
    up, want = list(range(40)), []
    for w, a, b in every:
        ra, rb = a, b
        while up[ra] != ra:
            ra = up[ra]
        while up[rb] != rb:
            rb = up[rb]
        if ra != rb:
            up[ra] = rb
            want.append((w, a, b))
    assert list(zip(*(v.tolist() for v in K._mst(x, core)))) == want
    e = spark.createDataFrame([(1, a, b, float(w)) for w, a, b in every], "g bigint, a bigint, b bigint, w double")
    assert sorted((q.w, q.a, q.b) for q in K.minimum_forest(e).distinct().collect()) == want


def test_last_names_in_order(spark):
    wos = spark.createDataFrame([("r1", "p", "Ann Ek", "Ek", 1), ("r2", "p", "Bo Aas", "Aas", 2), ("r3", "q", "Ann Ek", "Ek", 1), ("r4", "s", "A B", "B", 1), ("r5", "s", "C D", "D", 2)], "row_id string, paper string, name string, last_name string, position int")
    ss = spark.createDataFrame([("p", "1", "Ann Ek"), ("p", "2", "Bo NOT Aas"), ("q", "1", "A. Ek"), ("s", "3", "A B")], "paper string, author_id string, name string")
    got = {r.row_id: (r.author_id, r.authorListAlphabetizedLastName) for r in L.author_merge(wos, ss).collect()}
    assert got == {"r1": ("1", False), "r2": ("2", False), "r3": ("1", False), "r4": ("3", True), "r5": ("3", True)}


def test_layers_and_probe(spark):
    from citemesh.operators.embedding import masks_from_ids, probe, sage_predict

    v = spark.createDataFrame([(1, [1.0, -1.0]), (2, [0.0, 1.0]), (3, [2.0, 2.0])], "id int, features array<double>")
    e = spark.createDataFrame([(1, 2), (3, 2), (2, 3)], "src int, dst int")
    own, neigh, bias = np.array([[1.0, 0], [0, 2]]), np.array([[0.5, 0], [0, 1.0]]), np.array([0.1, 0.0])
    got = {r.id: np.array(r.features) for r in sage_predict(v, e, [(own, neigh, bias), (own, neigh, bias)]).collect()}
    x, into = {1: np.array([1.0, -1]), 2: np.array([0.0, 1]), 3: np.array([2.0, 2])}, {1: [], 2: [1, 3], 3: [2]}
    for last in (False, True):
        new = {i: own @ x[i] + neigh @ (np.mean([x[j] for j in into[i]], axis=0) if into[i] else np.zeros(2)) + bias for i in x}
        x = new if last else {i: np.maximum(w, 0) for i, w in new.items()}
    assert all(np.allclose(got[i], x[i]) for i in x)
    df = spark.createDataFrame([([float(i % 2), 1.0], "ab"[i % 2]) for i in range(40)], "v array<double>, y string")
    assert probe(df, df, "v", "y").first().micro_f1 == 1.0
    parts = spark.createDataFrame([(1, "train"), (2, "val")], "id int, part string")
    assert {tuple(r) for r in masks_from_ids(v, parts).collect()} == {(1, True, False, False), (2, False, True, False), (3, False, False, False)}
    assert D.reshaped_probabilities(spark.createDataFrame([(0.25, 1.0)], "a_proba double, b_proba double"), ["a", "b"]).first().probabilities == [[0.75, 0.25], [0.0, 1.0]]


def test_louvain_parts_two_cliques(spark):
    pairs = [(a, b) for g in ((0, 1, 2, 3), (4, 5, 6, 7)) for a in g for b in g if a < b] + [(3, 4)]
    e = spark.createDataFrame(pairs, "src int, dst int")
    labels = A.louvain(e)
    assert A.modularity(e.withColumn("weight", F.lit(1.0)), labels) > 0.3


def test_text_and_mmr(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],)], "t array<string>")
    assert [r.x for r in df.select(X.ngrams(F.col("t")).alias("x")).collect()] == [["a b", "b c", "a b c"], []]
    got = X.mmr(np.array([1.0, 0]), np.array([[1.0, 0], [0.99, 0.1], [0.2, 1.0]]), ["a", "b", "c"], 2)
    assert got == ["a", "c"]


def test_density_clusters(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 0.1, (30, 2)), r.normal(5, 0.1, (30, 2)), [[20.0, 20.0]]])
    labels, prob, _ = density_labels(x, 5)
    assert set(labels[:30]) == {0} and set(labels[30:60]) == {1} and labels[60] == -1 and prob.max() <= 1
    df = spark.createDataFrame([(2000, i, v.tolist()) for i, v in enumerate(x)], "year int, k int, v array<double>")
    assert hdbscan(df, "year", "k", "v").filter("label >= 0").select("label").distinct().count() == 2


def test_sage_and_embedder(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, features array<double>")
    e = spark.createDataFrame([(1, 2)], "src int, dst int")
    got = {r.id: r.features for r in sage_layer(v, e, np.eye(2), np.eye(2), np.zeros(2)).collect()}
    assert got == {1: [1.0, 0.0], 2: [1.0, 1.0]}
    w = HashingEmbedder(8)
    assert w.vector("abc") == w.vector("ABC") and w.vector("") != w.vector("x")


def test_pipeline(spark, tmp_path):
    p = Pipeline([Stage("load", lambda n: spark.range(n), {"n": (5, False)}, cache=True), Stage("more", lambda df, k: df.withColumn("k", F.lit(k)), {"df": ("load", True), "k": (2, False)})], {"n": 7})
    assert p.run(str(tmp_path)).count() == 7 and spark.read.parquet(f"{tmp_path}/more").count() == 7
    assert [r["stage"] for r in p.report()] == ["load", "more"] and p.output("load").count() == 7
    with pytest.raises(ValueError):
        p.run()
    with pytest.raises(ValueError):
        Pipeline([Stage("a", lambda x: x, {"x": ("b", True)})])
    with pytest.raises(ValueError):
        Pipeline([PipelineFlag("x")])
    q = Pipeline([Stage("a", lambda: CANCEL), Stage("b", lambda: 1 / 0)])
    q.run()
    assert q.cancelled


def test_sources(spark, tmp_path):
    q = spark.createDataFrame([("solar cells", 60_000)], "query string, hits long")
    urls = B.solr_urls(q, "http://s", sort="id asc").orderBy("start").collect()
    assert [r.start for r in urls] == [0, 25_000, 50_000] and "q=solar+cells" in urls[0].url
    assert B.scholar_urls(spark.createDataFrame([("10.1/x",)], "d string"), "http://s", "d", fields=["title"]).first().url == "http://s/paper/DOI:10.1/x?fields=title"
    with pytest.raises(ValueError):
        B.scholar_urls(q, "http://s", "query", "nope")
    body = '{"response":{"docs":[{"id":"1","doi":["a","b"],"date":"2020-01-02T00:00:00Z"}]}}'
    got = B.fetch(B.solr_urls(q, "http://s"), lambda u: (200, body), workers=2)
    d = B.solr_documents(got, "id string, doi array<string>, date string").collect()
    assert len(d) == 3 and d[0].DOI == "b" and d[0].query == "solar cells" and d[0].date.year == 2020
    nodes = G.NodeSet.build(spark.createDataFrame([("1", "a\nb")], "id string, t string"), "P", "id", [{"old": "t", "new": "t", "type": "string"}])
    sinks.write_nodes(nodes, str(tmp_path / "n"))
    assert spark.read.option("header", True).csv(str(tmp_path / "n")).first().t == "a b"
    assert sinks.import_command(["n.csv"], ["e.csv"]).count("--") == 4
    assert B.polite_limit(50) == 40 and B.polite_limit(5) == 5


def test_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"id":"1"}\n{"id":"2"}\n')
    seen = []
    for extra in (None, '{"id":"3"}\n'):
        if extra:
            (src / "2.json").write_text(extra)
        ingest(spark, str(src), "id string", str(tmp_path / "cp"), lambda df, n: seen.extend(r.id for r in df.collect()))
    assert sorted(seen) == ["1", "2", "3"]
