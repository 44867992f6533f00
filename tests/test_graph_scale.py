"""Graph loops take rounds by the hops of paths, not by their lengths or the number of sources."""

import random
from collections import Counter

from pyspark.sql import functions as F

from citemesh.operators import graph_algos as A


def test_weighted_paths_take_steps_by_hops(spark, monkeypatch):
    hops = [(0, 1, 5000.0), (1, 2, 4000.0), (0, 2, 20000.0), (2, 3, 0.0), (0, 4, 1.0), (4, 3, 9500.0), (3, 5, 9999.0)]
    e = spark.createDataFrame(hops, "src int, dst int, weight double")
    written, watched = [], A._watched
    monkeypatch.setattr(A, "_watched", lambda df, **v: written.append(1) or watched(df, **v))
    got = A.weighted_paths(e, spark.createDataFrame([(0,)], "id int"), 1.0)
    assert {(r.dst, r.distance) for r in got.collect()} == {(1, 5000.0), (2, 9000.0), (3, 9000.0), (4, 1.0), (5, 18999.0)}
    assert len(written) < 30  # a bucket of width 1 each took as many steps as there are distances


def test_near_counts_without_batches(spark, monkeypatch):
    e = spark.range(400).select((F.xxhash64("id", F.lit(1)) % 90).alias("src"), (F.xxhash64("id", F.lit(2)) % 90).alias("dst"))
    some = e.select(F.col("src").alias("id")).distinct().orderBy("id").limit(40)
    want = [[tuple(r) for r in A.distance_counts(e, s, most=m).orderBy("distance").collect()] for s in (None, some) for m in (1, 2)]
    monkeypatch.setattr(A, "_batches", None)
    assert want == [[tuple(r) for r in A.distance_counts(e, s, most=m, held=0).orderBy("distance").collect()] for s in (None, some) for m in (1, 2)]
    assert [len(w) for w in want] == [1, 2, 1, 2]


def test_communities_by_lists_and_by_joins(spark, monkeypatch):
    """Neighbours lie as lists by node, so rounds don't join edges; the labels are those of the joins, for any ids."""
    pairs = [(5 * g + a, 5 * g + b) for g in range(6) for a in range(5) for b in range(a)] + [(5 * g, 5 * (g + 1) + 2) for g in range(5)]
    rows = [(a, b, 1.0 + (a + b) % 3) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs[:9]] + [(3, 3, 2.0), (40, 40, 1.0), (None, None, 1.0)]
    e = spark.createDataFrame(rows, "src int, dst int, weight double").repartition(3)
    joined = []
    monkeypatch.setattr(A, "_joined_louvain", lambda *a, f=A._joined_louvain: joined.append(1) or f(*a))
    for df in (e, e.drop("weight")):
        close = {r.id: r.community for r in A.louvain(df, 4, 2).collect()}
        far = df.withColumns({c: F.lpad(F.col(c).cast("string"), 4, "0") for c in ("src", "dst")})
        names = {int(r.id): int(r.community) for r in A.louvain(far, 4, 2).collect()}
        assert not joined
        with monkeypatch.context() as m:
            m.setattr(A, "SMALL_BYTES", 24)
            assert {r.id: r.community for r in A.louvain(df, 4, 2).collect()} == close == names
        assert joined.pop() and len(close) == 31 and 2 <= len(set(close.values())) <= 12
    assert A.louvain(e.limit(0)).count() == 0


def test_path_counts_of_few_and_many_starts(spark, monkeypatch):
    """Counts by a column for each start, and in long form, where a hop may end at two kinds of nodes."""
    from citemesh.operators import graph as G

    frame = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    node = lambda k, n: G.NodeSet(spark.createDataFrame([(f"{i}",) for i in range(n)], "id string"), k)
    g = G.PropertyGraph().add_nodes(node("A", 5)).add_nodes(node("B", 7))
    r = random.Random(2)
    e = {k: sorted({(f"{r.randrange(a)}", f"{r.randrange(b)}") for _ in range(14)}) for k, a, b in (("AB", 5, 7), ("BA", 7, 5), ("BB", 7, 7))}
    for k, rows in e.items():
        g.add_edges(k[0], G.EdgeSet(frame(rows), k), k[1])
    hops = [("AB", "out"), ("BA|BB", "out"), ("AB|BB", "both"), ("BB", "in")]
    want = Counter()
    for a, b in e["AB"]:
        for kind, c in [*(("A", y) for x, y in e["BA"] if x == b), *(("B", y) for x, y in e["BB"] if x == b)]:
            if kind == "A":
                third = [y for x, y in e["AB"] if x == c]
            else:  # A nodes that AB edges lead back to have no BB edge
                third = [y for x, y in e["BB"] if x == c] + [x for x, y in e["BB"] if y == c and x != y]
            want.update((a, s) for d in third for s, t in e["BB"] if t == d)
    got = lambda starts=None: {(x.start_id, x.end_id): x.paths for x in g.path_counts(hops, starts).collect()}
    some = spark.createDataFrame([("1",), ("3",), ("gone",)], "id string")
    for most in (64, 5, 2, 0):
        monkeypatch.setattr(G, "WIDE", most, raising=False)
        assert got() == dict(want) and got(some) == {k: n for k, n in want.items() if k[0] in ("1", "3")} and got(some.limit(0)) == {}


def test_ends_made_of_the_same_records_are_not_looked_up(spark):
    from citemesh.operators import builders as B
    from citemesh.operators import graph as G

    r = spark.createDataFrame([("p1", None, ["p2", "x", None], [("a",), ("b",)]), ("p2", None, ["p1", "p2"], [("a",), (None,)]), ("p2", None, ["p1"], None), (None, None, ["p1"], [("c",)])], "id string, date date, ref_ids array<string>, authors array<struct<authorId: string>>")
    hops = [("WROTE", "out"), ("CITED_BY", "out"), ("WROTE", "in")]

    def counts(people, papers):
        g = G.PropertyGraph().add_nodes(people).add_nodes(papers)
        wrote = B.authorship_edges(r, people, papers).written("src", "dst")
        g.add_edges("Person", wrote, "Publication").add_edges("Publication", B.citation_edges(r, papers), "Publication")
        p = g.path_counts(hops)
        return p._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi"), {(x.start_id, x.end_id): x.paths for x in p.collect()}

    people, papers = B.author_nodes(r), B.publication_nodes(r)
    # p1 (a, b) is cited by p2 (a), p2 by p1
    want = {("a", "a"): 2, ("b", "a"): 1, ("a", "b"): 1}
    assert counts(people, papers) == (0, want)
    other = B.publication_nodes(r.filter("id is not null"))
    found = counts(people, other)
    assert found[1] == want and found[0] > 0
    people.df = people.df.filter("id <> 'b'")  # no longer what was made of the records
    found = counts(people, papers)
    assert found[1] == {("a", "a"): 2}


def test_records_of_odd_lines(spark, tmp_path):
    """Lines without a known supplier are references without an author; orders without lines have neither."""
    from citemesh.plans.record_queries import records

    rows = {
        "region": ("r_regionkey int, r_name string", [(0, "R")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0), (9, "M", 0)]),
        "supplier": ("s_suppkey int, s_name string, s_nationkey int", [(1, "one", 0), (2, None, 9)]),
        "customer": ("c_custkey int, c_nationkey int, c_mktsegment string", [(1, 0, "X")]),
        "orders": ("o_orderkey int, o_custkey int, o_orderdate date, o_orderpriority string", [(k, 1, None, "1") for k in (1, 2, 3)] + [(4, 7, None, "1")]),
        "lineitem": ("l_orderkey int, l_partkey int, l_suppkey int", [(1, 5, 2), (1, 5, 1), (1, 6, 1), (2, 7, 99), (2, None, None), (4, 5, 1), (None, 1, 1)]),
    }
    for name, (kind, r) in rows.items():
        spark.createDataFrame(r, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {x.id: x for x in records(spark, str(tmp_path)).collect()}
    assert set(got) == {"1", "2", "3"}
    assert {k: sorted(x.ref_ids or []) for k, x in got.items()} == {"1": ["5", "6"], "2": ["7"], "3": []}
    assert got["2"].authors is None and got["3"].authors is None
    assert [(a.authorId, a.name, a.institutions[0].institution, a.authorListPosition, a.authorListPositionReversed) for a in got["1"].authors] == [("1", "one", "N", 1, -2), ("2", None, "M", 2, -1)]
