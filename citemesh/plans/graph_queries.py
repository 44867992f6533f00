"""Graph, linkage, community, text and model-selection queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import communities as M
from ..operators import embedding as E
from ..operators import graph as G
from ..operators import graph_algos as A
from ..operators import linkage as L
from ..operators import modeling as D
from ..operators import relational as R
from ..operators import text as X
from .queries import query, r6
from .views import AUTHORS, CITES, FLOW, MEMBERS, TRADE, TRIALS, cites, flow, members, table, trade, trials

# ---- property graph


def _nodes(spark, sf, name, key, label, rules=(), where=None, order=None):
    t = table(spark, sf, name)
    return G.NodeSet.build(t.filter(where) if where else t, label, key, list(rules), order=order)


@query("SELECT o_custkey::VARCHAR AS id, name FROM (SELECT o_custkey, o_orderpriority AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_custkey % 10 <> 0) WHERE n = 1")
def node_set(spark, sf):
    o = table(spark, sf, "orders").withColumn("k", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")))
    return G.NodeSet.build(o, "Person", "k", [{"old": "o_orderpriority", "new": "name", "type": "string"}], ("Author",), ["o_orderkey"]).df


@query("SELECT src, dst, quantity FROM (SELECT l_partkey::VARCHAR AS src, l_suppkey::VARCHAR AS dst, l_quantity AS quantity, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_quantity) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) WHERE n = 1")
def edge_set(spark, sf):
    parts = _nodes(spark, sf, "part", "p_partkey", "Part")
    supp = _nodes(spark, sf, "supplier", "s_suppkey", "Supplier", where="s_acctbal > 0")
    return G.EdgeSet.build(table(spark, sf, "lineitem"), "MADE_BY", "l_partkey", "l_suppkey", parts, supp, [{"old": "l_quantity", "new": "quantity", "type": "double"}], order=["l_orderkey", "l_quantity"]).df


@query(f"WITH {AUTHORS} SELECT author::VARCHAR AS id, min(name) AS name FROM authors GROUP BY 1")
def author_nodes(spark, sf):
    from ..functions.nested import explode_unique
    from .views import papers_struct

    a = explode_unique(papers_struct(spark, sf), "authors", ["authorId"], ["paper"])
    return G.NodeSet.build(a, "Person", "authorId", [{"old": "name", "new": "name", "type": "string"}], ("Author",)).df


@query("SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS status, o_totalprice AS price FROM orders UNION ALL SELECT 'part' || l_partkey, NULL, NULL FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def publication_nodes_with_refs(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    stubs = table(spark, sf, "lineitem").select(F.concat(F.lit("part"), "l_partkey").alias("id")).distinct()
    return o.unionByName(stubs, allowMissingColumns=True)


@query("SELECT n_name AS id, n_nationkey < 15 AS institution, n_nationkey > 8 AS is_funder, CASE WHEN n_nationkey > 8 THEN 'Institution;Funder' ELSE 'Institution' END AS labels FROM nation")
def institution_funder_split(spark, sf):
    n = table(spark, sf, "nation")
    inst = n.filter("n_nationkey < 15").select(F.col("n_name").alias("id"))
    fund = n.filter("n_nationkey > 8").select(F.col("n_name").alias("id"))
    only = inst.join(fund, "id", "left_anti").select("id", F.lit(True).alias("institution"), F.lit(False).alias("is_funder"), F.lit("Institution").alias("labels"))
    both = fund.join(inst.withColumn("i", F.lit(True)), "id", "left").select("id", F.coalesce("i", F.lit(False)).alias("institution"), F.lit(True).alias("is_funder"), F.lit("Institution;Funder").alias("labels"))
    return only.union(both)


@query("SELECT coalesce(a.id, b.id) AS id, a.name, CASE WHEN b.id IS NOT NULL THEN b.balance ELSE a.balance END AS balance FROM (SELECT c_custkey::VARCHAR AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal + 1 END AS balance FROM customer WHERE c_custkey % 2 = 0) b ON a.id = b.id")
def upsert_nodes(spark, sf):
    c = table(spark, sf, "customer")
    old = G.NodeSet(c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), "Person")
    new = G.NodeSet(c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") + 1).alias("balance")), "Person")
    return old.merged(new).df


# the stored graph after two batches, the second of them delivered twice
@query("SELECT coalesce(a.id, b.id) AS id, a.name, CASE WHEN b.id IS NOT NULL THEN b.balance ELSE a.balance END AS balance, CASE WHEN b.id IS NOT NULL THEN b.segment END AS segment FROM (SELECT c_custkey::VARCHAR AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT c_custkey::VARCHAR AS id, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal + 1 END AS balance, c_mktsegment AS segment FROM customer WHERE c_nationkey < 12) b ON a.id = b.id")
def stored_merge(spark, sf):
    import uuid

    from ..operators.storage import shared_folder
    from ..sources.graph_store import GraphStore

    c, store = table(spark, sf, "customer"), GraphStore(spark, f"{shared_folder(spark).rstrip('/')}/graph-{uuid.uuid4().hex}", 16)
    store.merge_nodes("Person", c.filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))
    batch = c.filter("c_nationkey < 12").select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") + 1).alias("balance"), F.col("c_mktsegment").alias("segment"))
    for _ in range(2):
        store.merge_nodes("Person", batch)
    return store.nodes("Person").select("id", "name", "balance", "segment")


@query("SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, CASE WHEN b.src IS NOT NULL THEN b.q ELSE a.q END AS q FROM (SELECT l_partkey::VARCHAR AS src, l_suppkey::VARCHAR AS dst, sum(l_quantity) AS q FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1, 2) a FULL JOIN (SELECT l_partkey::VARCHAR AS src, l_suppkey::VARCHAR AS dst, max(l_quantity) AS q FROM lineitem WHERE l_partkey % 3 = 0 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1, 2) b ON a.src = b.src AND a.dst = b.dst")
def upsert_edges(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("src"), F.col("l_suppkey").cast("string").alias("dst"), "l_quantity", "l_partkey")
    old = G.EdgeSet(l.filter("l_partkey % 2 = 0").groupBy("src", "dst").agg(F.sum("l_quantity").alias("q")), "MADE_BY")
    new = G.EdgeSet(l.filter("l_partkey % 3 = 0").groupBy("src", "dst").agg(F.max("l_quantity").alias("q")), "MADE_BY")
    return old.merged(new, _nodes(spark, sf, "part", "p_partkey", "Part"), _nodes(spark, sf, "supplier", "s_suppkey", "Supplier", where="s_acctbal > 0")).df


def _citation_graph(spark, sf):
    p = G.NodeSet(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("brand")), "Part")
    o = G.NodeSet(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.year("o_orderdate").alias("year")), "Order")
    e = G.EdgeSet(cites(spark, sf).select(F.col("cited").cast("string").alias("src"), F.col("citing").cast("string").alias("dst")), "CITED_BY")
    return G.PropertyGraph().add_nodes(p).add_nodes(o).add_edges("Part", e, "Order")


@query(f"WITH {CITES} SELECT p_brand AS brand, year, count(*) AS n FROM cites JOIN part ON cited = p_partkey WHERE p_size < 10 OR p_size >= 10 GROUP BY 1, 2")
def one_hop_match(spark, sf):
    return _citation_graph(spark, sf).match("CITED_BY").groupBy(F.col("src_brand").alias("brand"), F.col("dst_year").alias("year")).agg(F.count("*").alias("n"))


@query(f"WITH {CITES} SELECT p_partkey::VARCHAR AS src, CAST(count(citing) AS BIGINT) AS n FROM part LEFT JOIN (SELECT * FROM cites WHERE year = 1996) ON cited = p_partkey GROUP BY 1")
def optional_match(spark, sf):
    m = _citation_graph(spark, sf).match("CITED_BY", dst_where=F.col("dst_year") == 1996, optional=True)
    return m.groupBy(F.col("src_id").alias("src")).agg(F.count("dst_id").alias("n"))


@query("SELECT p_partkey::VARCHAR AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def not_pattern(spark, sf):
    p = _nodes(spark, sf, "part", "p_partkey", "Part")
    e = G.EdgeSet(table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").cast("string").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")), "BULK")
    return G.PropertyGraph().add_nodes(p).add_edges("Part", e, "Supplier").without("Part", "BULK").select("id")


@query(f"WITH {FLOW}, h AS (SELECT src AS start, dst AS node, 1 AS hops FROM flow UNION SELECT a.src, b.dst, 2 FROM flow a JOIN flow b ON a.dst = b.src) SELECT start, node, CAST(min(hops) AS INTEGER) AS hops FROM h WHERE start <> node GROUP BY 1, 2")
def khop2(spark, sf):
    return G.reachable(flow(spark, sf), table(spark, sf, "part").select(F.col("p_partkey").alias("id")), 2)


@query(f"WITH {TRADE} SELECT dst AS src, src AS dst, round(weight, 2) AS weight, 'SOLD_TO' AS type FROM trade")
def invert_edges(spark, sf):
    e = G.EdgeSet(trade(spark, sf), "TRADES").inverted("SOLD_TO")
    return e.df.select("src", "dst", F.round("weight", 2).alias("weight"), F.lit(e.type).alias("type"))


@query(f"WITH {TRADE}, e AS (SELECT DISTINCT src, dst FROM trade ORDER BY src, dst LIMIT 20) SELECT n_nationkey AS id, n_name FROM nation WHERE n_nationkey IN (SELECT src FROM e UNION SELECT dst FROM e)")
def viz_extract(spark, sf):
    return G.viz_extract(trade(spark, sf), table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), "n_name"), 20)[1]


@query("SELECT src, dst, day FROM (SELECT n_name AS src, o_orderkey::VARCHAR AS dst, o_orderdate::DATE AS day, row_number() OVER (PARTITION BY n_name, o_orderkey ORDER BY o_orderdate) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey > 8) WHERE n = 1")
def funding_edges(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    papers = _nodes(spark, sf, "orders", "o_orderkey", "Publication")
    funders = _nodes(spark, sf, "nation", "n_name", "Institution", where="n_nationkey > 8")
    return G.EdgeSet.build(o, "FUNDED", "n_name", "o_orderkey", funders, papers, [{"old": "o_orderdate", "new": "day", "type": "date"}], order=["o_orderdate"]).df


@query("SELECT o_orderkey::VARCHAR AS \"id:ID(order-ref)\", strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS day, o_orderstatus || ';' || o_orderpriority AS \"tags[]\", lower((o_totalprice > 100000)::VARCHAR) AS big, 'a b' AS note, 'Order' AS \":LABEL\" FROM orders")
def export_rows(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").alias("day"), F.array("o_orderstatus", "o_orderpriority").alias("tags"), (F.col("o_totalprice") > 100000).alias("big"), F.lit("a\nb").alias("note"))
    return G.NodeSet(o, "Order").export_rows("order")


# ---- graph algorithms


@query(f"WITH {FLOW}, c AS (SELECT (SELECT count(*) FROM part)::DOUBLE AS v, (SELECT count(*) FROM flow)::DOUBLE AS e) SELECT v::BIGINT AS num_nodes, e::BIGINT AS num_edges, round(e / v, 6) AS beta, round((e - v) / (0.5 * v * v - 1.5 * v + 1), 6) AS alpha, round(e / (0.5 * v * v - 0.5 * v), 6) AS gamma FROM c")
def graph_indices(spark, sf):
    d = A.describe(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), flow(spark, sf))
    return d.select("num_nodes", "num_edges", *(r6(c).alias(c) for c in ("beta", "alpha", "gamma")))


@query(f"WITH {FLOW}, ends AS (SELECT src AS id FROM flow UNION ALL SELECT dst FROM flow) SELECT p_partkey AS id, count(e.id) AS degree FROM part LEFT JOIN ends e ON e.id = p_partkey GROUP BY 1")
def degree_isolates(spark, sf):
    return A.degrees(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), flow(spark, sf))


@query(f"""WITH {FLOW}, s AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM flow UNION ALL SELECT dst, src FROM flow)),
d AS (SELECT src AS id, count(*) AS degree FROM s GROUP BY 1),
t AS (SELECT a.src AS id, count(*) / 2 AS k FROM s a JOIN s b ON a.src = b.src AND a.dst <> b.dst JOIN s c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1)
SELECT d.id, degree, coalesce(k, 0)::BIGINT AS triangles, round(CASE WHEN degree > 1 THEN 2 * coalesce(k, 0) / (degree * (degree - 1)::DOUBLE) ELSE 0 END, 6) AS lcc FROM d LEFT JOIN t USING (id)""")
def lcc(spark, sf):
    return A.clustering(flow(spark, sf)).select("id", "degree", "triangles", r6("lcc").alias("lcc"))


# distances by how many pairs have them: new pairs of each length, from all pairs of one less
@query(f"""WITH RECURSIVE {TRADE}, p AS (SELECT src, dst, 1 AS d FROM trade UNION SELECT p.src, t.dst, p.d + 1 FROM p JOIN trade t ON p.dst = t.src WHERE p.d < 12),
m AS (SELECT src, dst, min(d) AS d FROM p WHERE src <> dst GROUP BY 1, 2),
s AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM trade UNION ALL SELECT dst, src FROM trade)),
g AS (SELECT src AS id, count(*) AS degree FROM s GROUP BY 1),
t AS (SELECT a.src AS id, count(*) AS k FROM s a JOIN s b ON a.src = b.src AND a.dst <> b.dst JOIN s c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1),
l AS (SELECT sum(CASE WHEN degree > 1 THEN coalesce(k, 0)::DOUBLE / (degree * (degree - 1)) ELSE 0 END) / (SELECT count(*) FROM nation) AS transitivity FROM g LEFT JOIN t USING (id)),
v AS (SELECT count(*) AS n FROM nation), e AS (SELECT count(*) AS n FROM trade)
SELECT v.n AS num_nodes, e.n AS num_edges, (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT src FROM s)) AS isolates, round((SELECT transitivity FROM l), 6) AS transitivity,
(SELECT max(d)::BIGINT FROM m) AS diameter, round((SELECT avg(d::DOUBLE) FROM m), 6) AS efficiency FROM v, e""")
def describe_full(spark, sf):
    d = A.describe(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id")), trade(spark, sf), True)
    return d.select("num_nodes", "num_edges", "isolates", r6("transitivity").alias("transitivity"), "diameter", r6("efficiency").alias("efficiency"))


# the graph that grows, from a stated number of sources; exact on the small graph above
@query()
def describe_sampled(spark, sf):
    d = A.describe(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), flow(spark, sf), True, 256)
    return A.flagged(d).select("num_nodes", "num_edges", "isolates", r6("transitivity").alias("transitivity"), "diameter", r6("efficiency").alias("efficiency"), F.array_join("flags", ";").alias("flags"))


@query(f"""WITH RECURSIVE {TRADE}, p AS (SELECT src, dst, 1 AS d FROM trade UNION SELECT p.src, t.dst, p.d + 1 FROM p JOIN trade t ON p.dst = t.src WHERE p.d < 12),
m AS (SELECT src, dst, min(d) AS d FROM p WHERE src <> dst GROUP BY 1, 2) SELECT max(d)::BIGINT AS diameter, round(avg(d::DOUBLE), 6) AS mean_distance, count(*) AS pairs FROM m""")
def apsp_diameter(spark, sf):
    d = A.distance_counts(trade(spark, sf))
    return d.agg(F.max("distance").cast("bigint").alias("diameter"), r6(F.sum(F.col("distance") * F.col("n")).cast("double") / F.sum("n")).alias("mean_distance"), F.sum("n").alias("pairs"))


@query(f"""WITH RECURSIVE {FLOW}, p AS (SELECT src AS start, dst AS node, 1 AS d FROM flow UNION SELECT p.start, f.dst, p.d + 1 FROM p JOIN flow f ON f.src = p.node WHERE p.d < 3),
m AS (SELECT start, node, min(d) AS d FROM p WHERE start <> node GROUP BY ALL) SELECT d::INTEGER AS distance, count(*) AS n FROM m WHERE d < 3 GROUP BY ALL""")
def flow_distances(spark, sf):
    return A.distance_counts(flow(spark, sf), batch=2048, most=2)


@query(f"""WITH RECURSIVE {TRADE}, e AS (SELECT src, dst, abs(src - dst)::DOUBLE AS w FROM trade),
p AS (SELECT src, dst, w, 1 AS n FROM e UNION SELECT p.src, e.dst, min(p.w + e.w), p.n + 1 FROM p JOIN e ON p.dst = e.src WHERE p.n < 24 GROUP BY p.src, e.dst, p.n)
SELECT src, dst, min(w) AS distance FROM p WHERE src <> dst GROUP BY 1, 2""")
def weighted_paths(spark, sf):
    return A.weighted_paths(trade(spark, sf).select("src", "dst", F.abs(F.col("src") - F.col("dst")).cast("double").alias("weight")))


# flow goes from smaller to larger parts, so each path's length is the ends' difference: what differs is who is reached
@query(f"""WITH RECURSIVE {FLOW}, s AS (SELECT p_partkey AS src FROM part WHERE p_size = 50 ORDER BY p_retailprice, p_partkey LIMIT 8),
r AS (SELECT src, src AS dst FROM s UNION SELECT r.src, f.dst FROM r JOIN flow f ON f.src = r.dst) SELECT src, dst, (dst - src)::DOUBLE AS distance FROM r WHERE src <> dst""")
def flow_paths(spark, sf):
    start = table(spark, sf, "part").filter("p_size = 50").orderBy("p_retailprice", "p_partkey").limit(8).select(F.col("p_partkey").alias("id"))
    return A.weighted_paths(flow(spark, sf).withColumn("weight", (F.col("dst") - F.col("src")).cast("double")), start, 50.0)


# a node's score is the sum over pairs of the share of their shortest paths that pass it
@query(f"""WITH RECURSIVE {TRADE}, e AS (SELECT src, dst FROM trade), r AS (SELECT src AS s, dst AS v, 1 AS d FROM e UNION SELECT r.s, e.dst, r.d + 1 FROM r JOIN e ON e.src = r.v WHERE r.d < 12),
dist AS (SELECT s, v, min(d) AS d FROM r WHERE s <> v GROUP BY ALL),
p AS (SELECT src AS s, dst AS v, 1 AS d, 1::DOUBLE AS n FROM e UNION ALL SELECT p.s, e.dst, p.d + 1, sum(p.n) FROM p JOIN e ON e.src = p.v JOIN dist ON dist.s = p.s AND dist.v = e.dst AND dist.d = p.d + 1 GROUP BY p.s, e.dst, p.d),
b AS (SELECT x.v AS id, sum(x.n * y.n / z.n) AS score FROM p x JOIN p y ON y.s = x.v JOIN p z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d GROUP BY 1),
a AS (SELECT id, coalesce(score, 0) AS score FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) LEFT JOIN b USING (id))
SELECT id, round((score - min(score) OVER ()) / nullif(max(score) OVER () - min(score) OVER (), 0), 6) AS score FROM a""")
def betweenness(spark, sf):
    b = A.betweenness(trade(spark, sf))
    return R.minmax_scaled(b, ["score"]).select("id", r6("score").alias("score"))


@query()
def flow_betweenness(spark, sf):
    """On the shortest paths from a few parts, in the graph of all orders."""
    start = table(spark, sf, "part").filter("p_size = 50").orderBy("p_retailprice", "p_partkey").limit(8).select(F.col("p_partkey").alias("id"))
    return A.betweenness(flow(spark, sf), start).select("id", r6("score").alias("score"))


@query()
def louvain(spark, sf):
    return A.louvain(flow(spark, sf))


# weights are whole numbers, so that the layout of the ranges is the same in any engine
@query(f"""WITH {FLOW}, w AS (SELECT dst AS id, floor(pow(count(*)::DOUBLE, 0.75::DOUBLE) * 1e6::DOUBLE)::BIGINT AS w FROM flow GROUP BY 1),
laid AS (SELECT id, (sum(w) OVER (ORDER BY id) - w)::BIGINT AS lo, (sum(w) OVER (ORDER BY id))::BIGINT AS hi FROM w), t AS (SELECT sum(w)::BIGINT AS total FROM w),
d AS (SELECT src, k::INTEGER AS k_index, ('0x' || substr(md5('7:' || src || ':' || dst || ':' || k), 1, 15))::BIGINT % total AS u FROM flow, t, (SELECT unnest(range(0, 2)) AS k))
SELECT src, id AS neg_dst, k_index FROM d ASOF JOIN laid ON d.u >= laid.lo""")
def negative_edges(spark, sf):
    return A.negative_edges(flow(spark, sf), 2)


# ---- linkage


@query("""WITH s AS (SELECT user_id, event_id, value, CASE WHEN event_id % 3 <> 0 THEN event_type END AS goal FROM events),
d AS (SELECT *, (value - lead(value) OVER w) / lead(value) OVER w AS drop FROM s WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, goal ASC NULLS FIRST, event_id))
SELECT user_id, value, goal FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, goal) AS n FROM d WHERE drop > 0.2 AND goal IS NOT NULL) WHERE n = 1""")
def best_score_group(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "value", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("goal"))
    return L.best_score(e, "user_id", "value", "goal").select("user_id", "value", "goal")


@query("""WITH k AS (SELECT c_mktsegment AS a, c_nationkey % 5 AS b, c_nationkey % 2 AS c, c_custkey FROM customer),
l AS (SELECT DISTINCT c_mktsegment AS a, c_nationkey % 5 AS b, c_nationkey % 2 AS c, c_nationkey::DOUBLE AS lat, (c_nationkey * 2)::DOUBLE AS lon FROM customer WHERE c_nationkey < 13),
t1 AS (SELECT a, b, c, min(struct_pack(lat := lat, lon := lon)) AS g FROM l GROUP BY 1, 2, 3), t2 AS (SELECT b, c, min(struct_pack(lat := lat, lon := lon)) AS g FROM l WHERE true GROUP BY 1, 2), t3 AS (SELECT c, min(struct_pack(lat := lat, lon := lon)) AS g FROM l GROUP BY 1)
SELECT c_custkey, coalesce(t1.g, t2.g, t3.g).lat AS lat, coalesce(t1.g, t2.g, t3.g).lon AS lon, CASE WHEN t1.g IS NOT NULL THEN 1 WHEN t2.g IS NOT NULL THEN 2 WHEN t3.g IS NOT NULL THEN 3 END AS tier
FROM k LEFT JOIN t1 USING (a, b, c) LEFT JOIN t2 USING (b, c) LEFT JOIN t3 USING (c)""")
def geocode_fallback(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("a"), (F.col("c_nationkey") % 5).alias("b"), (F.col("c_nationkey") % 2).alias("c"), "c_custkey", "c_nationkey")
    lookup = c.filter("c_nationkey < 13").select("a", "b", "c", F.col("c_nationkey").cast("double").alias("lat"), (F.col("c_nationkey") * 2).cast("double").alias("lon")).distinct()
    return L.geocode(c.drop("c_nationkey"), lookup, [["a", "b", "c"], ["b", "c"], ["c"]]).select("c_custkey", "lat", "lon", "tier")


@query("""SELECT p_partkey AS row_id, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_brand END, CASE WHEN p_partkey % 3 = 0 THEN p_type END, CASE WHEN p_partkey % 5 = 0 THEN p_name END) AS doi,
CASE WHEN p_partkey % 2 = 0 THEN 0 WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 5 = 0 THEN 2 END AS doi_source FROM part""")
def tiered_fill(spark, sf):
    p = table(spark, sf, "part").withColumn("row_id", F.col("p_partkey"))
    df = p.select("row_id", F.when(F.col("row_id") % 2 == 0, F.col("p_brand")).alias("doi"))
    title = p.filter("row_id % 3 = 0").select("row_id", F.col("p_type").alias("doi"))
    citation = p.filter("row_id % 5 = 0").select("row_id", F.col("p_name").alias("doi"))
    return L.fill_doi(df, title, citation)


@query("""WITH b AS (SELECT c_custkey AS paper_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS wos, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS ss FROM customer)
SELECT paper_id, coalesce(wos, ss) AS abstract, CASE WHEN ss IS NOT NULL THEN 'Semantic Scholar' WHEN wos IS NOT NULL THEN 'Web of Science' END AS abstract_source,
array_to_string(list_filter([CASE WHEN wos IS NULL THEN 'Web of Science' END, CASE WHEN ss IS NULL THEN 'Semantic Scholar' END], lambda x: x IS NOT NULL), ';') AS missing FROM b""")
def abstract_source(spark, sf):
    c = table(spark, sf, "customer")
    wos = c.select(F.col("c_custkey").alias("paper_id"), F.lit(None).cast("string").alias("doi"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("abstract"))
    ss = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("paper_id"), F.lit(None).cast("string").alias("doi"), F.col("c_mktsegment").alias("abstract"))
    return L.merge_records(wos, ss).select("paper_id", "abstract", "abstract_source", C.list_join(F.col("abstract_missing")).alias("missing"))


def _lcs(pairs: str) -> str:
    """SQL of (a, b, score): the ratio of each two texts of pairs(a, b), row by row of the table of longest common subsequences."""
    row = "list_transform(range(1, len(s) + 1), lambda k: list_max(list_transform(range(1, k + 1), lambda i: greatest(s[i], CASE WHEN i > 1 AND ascii(lower(a)[i - 1]) = c[1] THEN s[i - 1] + 1 ELSE 0 END))))"
    rows = f"list_reduce(list_prepend(list_transform(range(0, length(a) + 1), lambda i: 0), list_transform(string_split(lower(b), ''), lambda c: [ascii(c)])), lambda s, c: {row})"
    return f"SELECT a, b, 2.0::DOUBLE * r[len(r)] / (length(a) + length(b)) AS score FROM (SELECT a, b, {rows} AS r FROM {pairs})"


@query(f"""WITH l AS (SELECT p_partkey AS row_id, p_brand, p_type || ' ' || p_name AS title FROM part), r AS (SELECT DISTINCT p_brand, p_name AS found FROM part),
d AS (SELECT DISTINCT title AS a, found AS b FROM l JOIN r USING (p_brand)), s AS ({_lcs("d")})
SELECT row_id, title, found, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, found) AS n FROM l JOIN r USING (p_brand) JOIN s ON a = title AND b = found WHERE score >= 0.6) WHERE n = 1""")
def fuzzy_title(spark, sf):
    p = table(spark, sf, "part")
    left = p.select(F.col("p_partkey").alias("row_id"), "p_brand", F.concat_ws(" ", "p_type", "p_name").alias("title"))
    return L.fuzzy_best(left, p.select("p_brand", F.col("p_name").alias("found")), ["p_brand"], "title", "found", 0.6).select("row_id", "title", "found", r6("score").alias("score"))


# the pairs of names are those that stand in one paper
@query(f"""WITH {AUTHORS}, n AS (SELECT paper, author, name, replace(name, '#', ' ') AS clean FROM authors), d AS (SELECT DISTINCT x.clean AS a, y.name AS b FROM n x JOIN n y USING (paper)), s AS ({_lcs("d")})
SELECT row_id, paper, author_id, round(score, 6) AS score FROM (SELECT x.paper || '-' || x.author AS row_id, x.paper, y.author AS author_id, score, row_number() OVER (PARTITION BY x.paper, x.author ORDER BY score DESC, y.author) AS n
FROM n x JOIN n y ON y.paper = x.paper JOIN s ON a = x.clean AND b = y.name) WHERE n = 1""")
def fuzzy_authors(spark, sf):
    from .views import papers_struct

    a = papers_struct(spark, sf).select("paper", F.explode("authors").alias("a")).select("paper", F.col("a.authorId").alias("author_id"), F.col("a.name").alias("name"))
    wos = a.select(F.concat_ws("-", "paper", "author_id").alias("row_id"), "paper", F.regexp_replace("name", "#", " NOT ").alias("name"))
    return L.author_merge(wos, a).select("row_id", "paper", "author_id", r6("score").alias("score"))


# ---- communities


def _clusters(spark, sf):
    return M.cluster_table(members(spark, sf))


CENTROIDS = f"""{MEMBERS}, flat AS (SELECT year, cluster, paper_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM members),
cen AS (SELECT year, cluster, pos, avg(x) AS m, stddev_pop(x) AS s FROM flat GROUP BY 1, 2, 3),
size AS (SELECT year, cluster, count(*) AS size FROM members GROUP BY 1, 2),
sim AS (SELECT b.year, a.cluster AS c_t, b.cluster AS c_t1, sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))) AS score FROM cen a JOIN cen b ON b.year = a.year + 1 AND a.pos = b.pos GROUP BY 1, 2, 3)"""
EVENTS = CENTROIDS + """, y AS (SELECT DISTINCT year FROM sim),
match AS (SELECT year, 'cluster' || c_t || '_' || (year - 1) AS c_t, 'cluster' || c_t1 || '_' || year AS c_t1 FROM sim WHERE score >= 0.15),
old AS (SELECT y.year, 'cluster' || cluster || '_' || size.year AS c_t, size FROM size JOIN y ON y.year = size.year + 1),
new AS (SELECT y.year, 'cluster' || cluster || '_' || size.year AS c_t1, size FROM size JOIN y ON y.year = size.year),
merges AS (SELECT year, string_agg(c_t, ';' ORDER BY c_t) AS c_t, c_t1, 'merge' AS event_type FROM match GROUP BY year, c_t1 HAVING count(*) >= 2),
splits AS (SELECT year, c_t, string_agg(c_t1, ';' ORDER BY c_t1) AS c_t1, 'split' AS event_type FROM match GROUP BY year, c_t HAVING count(*) >= 2),
births AS (SELECT year, NULL::VARCHAR AS c_t, c_t1, 'birth' AS event_type FROM new WHERE (year, c_t1) NOT IN (SELECT year, c_t1 FROM match)),
deaths AS (SELECT year, c_t, NULL::VARCHAR AS c_t1, 'death' AS event_type FROM old WHERE (year, c_t) NOT IN (SELECT year, c_t FROM match)),
one AS (SELECT year, c_t, max(c_t1) AS c_t1 FROM match GROUP BY 1, 2 HAVING count(*) = 1),
free AS (SELECT * FROM one WHERE (year, c_t) NOT IN (SELECT m.year, m.c_t FROM match m JOIN (SELECT year, c_t1 FROM match GROUP BY 1, 2 HAVING count(*) >= 2) g ON m.year = g.year AND m.c_t1 = g.c_t1)),
cont AS (SELECT f.year, f.c_t, f.c_t1, CASE WHEN o.size * (1 - 0.1::DOUBLE) >= n.size THEN 'contraction' WHEN o.size * (1 + 0.1::DOUBLE) <= n.size THEN 'expansion' ELSE 'continuation' END AS event_type FROM free f JOIN old o ON o.year = f.year AND o.c_t = f.c_t JOIN new n ON n.year = f.year AND n.c_t1 = f.c_t1)"""


def _events(spark, sf):
    c = _clusters(spark, sf)
    return M.Events(c, M.similarity_cosine(c), 0.15)


def _flat(df):
    return df.select("year", F.array_join("c_t", ";").alias("c_t"), F.array_join("c_t1", ";").alias("c_t1"), "event_type")


@query(f"WITH {CENTROIDS} SELECT year, cluster, size, 'cluster' || cluster || '_' || year AS label, round(sum(m), 4) AS mean_sum, round(sum(s), 4) AS std_sum FROM cen JOIN size USING (year, cluster) GROUP BY 1, 2, 3")
def cluster_table(spark, sf):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 4)
    return _clusters(spark, sf).select("year", "cluster", "size", F.col("c_t_label").alias("label"), total("embedding").alias("mean_sum"), total("embedding_std").alias("std_sum"))


@query(f"WITH {MEMBERS}, flat AS (SELECT cluster, paper_id % 5 + 1 AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM members), c AS (SELECT cluster, pos, sum(w * x) / sum(w) AS m FROM flat GROUP BY 1, 2) SELECT cluster, round(sum(m), 4) AS mean_sum FROM c GROUP BY 1")
def weighted_centroid(spark, sf):
    c = M.centroid(members(spark, sf), ["cluster"], "embedding", F.col("paper_id") % 5 + 1)
    return c.select("cluster", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("mean_sum"))


@query(f"WITH {MEMBERS} SELECT year, cluster, count(*) AS n, md5(string_agg(paper_id::VARCHAR, ';' ORDER BY paper_id)) AS papers FROM members GROUP BY 1, 2")
def cluster_members(spark, sf):
    g = members(spark, sf).groupBy("year", "cluster").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("paper_id")).alias("papers"))
    return g.select("year", "cluster", "n", F.md5(C.list_join(F.col("papers"))).alias("papers"))


@query(f"WITH {CENTROIDS} SELECT year, c_t, c_t1, round(score, 6) AS score FROM sim")
def similarity_t_t1(spark, sf):
    return M.similarity_cosine(_clusters(spark, sf)).select("year", "c_t", "c_t1", r6("score").alias("score"))


_MEM = "m AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_nationkey AS cluster, c_custkey AS paper_id FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"


@query(f"""WITH {_MEM}, k AS (SELECT * FROM m), n AS (SELECT year, cluster, count(*) AS n FROM k GROUP BY 1, 2),
o AS (SELECT b.year, a.cluster AS c_t, b.cluster AS c_t1, count(*) AS n FROM k a JOIN k b ON b.year = a.year + 1 AND a.paper_id = b.paper_id GROUP BY 1, 2, 3)
SELECT o.year, c_t, c_t1, round(o.n::DOUBLE / (a.n + b.n - o.n), 6) AS score FROM o JOIN n a ON a.year = o.year - 1 AND a.cluster = c_t JOIN n b ON b.year = o.year AND b.cluster = c_t1""")
def similarity_members(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = o.select(F.year("o_orderdate").alias("year"), F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("paper_id")).distinct()
    return M.similarity_members(m).withColumn("score", r6("score"))


for _name, _part, _of in (("events_merge", "merges", "merges"), ("events_split", "splits", "splits"), ("events_birth", "births", "births"), ("events_death", "deaths", "deaths"), ("events_continuity", "cont", "continuations")):
    query(f"WITH {EVENTS} SELECT year, c_t, c_t1, event_type FROM {_part}", _name)(lambda spark, sf, of=_of: _flat(getattr(_events(spark, sf), of)()))


@query(f"WITH {EVENTS} SELECT * FROM merges UNION ALL SELECT * FROM splits UNION ALL SELECT * FROM births UNION ALL SELECT * FROM deaths UNION ALL SELECT * FROM cont")
def events_all(spark, sf):
    return _flat(_events(spark, sf).all())


@query(f"""WITH {EVENTS}, multi AS (SELECT year, c_t1 FROM match GROUP BY 1, 2 HAVING count(*) >= 2), multi0 AS (SELECT year, c_t FROM match GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT year, c_t AS src, c_t1 AS dst, 'MERGES_INTO' AS type FROM match JOIN multi USING (year, c_t1) UNION ALL SELECT year, c_t, c_t1, 'SPLITS_INTO' FROM match JOIN multi0 USING (year, c_t) UNION ALL SELECT year, c_t, c_t1, 'CONTINUES_AS' FROM cont""")
def event_edges(spark, sf):
    return _events(spark, sf).edges()


@query(f"WITH {EVENTS}, every AS (SELECT c_t AS label FROM old UNION SELECT c_t1 FROM new) SELECT label, label IN (SELECT c_t1 FROM births) AS born, label IN (SELECT c_t FROM deaths) AS died FROM every")
def event_flags(spark, sf):
    return _events(spark, sf).flags()


@query(f"WITH {CENTROIDS}, c AS (SELECT * FROM cen WHERE year = 2017) SELECT a.cluster, b.cluster AS other, round(sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))), 6) AS score FROM c a JOIN c b ON a.pos = b.pos GROUP BY 1, 2")
def within_window_cosine(spark, sf):
    return M.within_window(_clusters(spark, sf), 2017).withColumn("score", r6("score"))


@query(f"""WITH {CENTROIDS}, noise AS (SELECT * FROM flat WHERE year = 2016), c AS (SELECT * FROM cen WHERE year = 2017),
s AS (SELECT paper_id, c.cluster, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS similarity FROM noise JOIN c USING (pos) GROUP BY 1, 2)
SELECT paper_id, cluster, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY similarity DESC, cluster) AS n FROM s) WHERE n = 1""")
def noise_to_cluster(spark, sf):
    noise = members(spark, sf).filter("year = 2016")
    return M.noise_to_cluster(noise, _clusters(spark, sf).filter("year = 2017"), "paper_id").withColumn("similarity", r6("similarity"))


@query("""WITH l AS (SELECT DISTINCT p_size % 7 AS a, p_partkey AS id FROM part), r AS (SELECT DISTINCT p_brand AS b, p_partkey AS id FROM part), na AS (SELECT a, count(*) AS n FROM l GROUP BY 1), nb AS (SELECT b, count(*) AS n FROM r GROUP BY 1),
o AS (SELECT a, b, count(*) AS n FROM l JOIN r USING (id) GROUP BY 1, 2) SELECT o.a, o.b, round(o.n::DOUBLE / (na.n + nb.n - o.n), 6) AS score FROM o JOIN na USING (a) JOIN nb USING (b)""")
def cluster_vs_community(spark, sf):
    p = table(spark, sf, "part").select((F.col("p_size") % 7).alias("a"), F.col("p_brand").alias("b"), F.col("p_partkey").alias("id"))
    return M.overlap_jaccard(p, p, "id", "a", "b").withColumn("score", r6("score"))


@query("SELECT u.user_id AS key, round(u.v, 4) AS v, " + ", ".join(f"coalesce(e.{k}, 0) AS {k}" for k in ("click", "view")) + " FROM (SELECT user_id, avg(value) AS v FROM events GROUP BY 1) u LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1) e USING (user_id)")
def event_matrix(spark, sf):
    e = table(spark, sf, "events")
    features = e.groupBy(F.col("user_id").alias("key")).agg(F.round(F.avg("value"), 4).alias("v"))
    return M.event_matrix(e.withColumn("key", F.col("user_id")), features, "key", ["click", "view"])


# ---- text and modelling


@query("SELECT source AS cluster, md5(string_agg(text, ' [SEP] ' ORDER BY doc_id)) AS h FROM documents WHERE text IS NOT NULL GROUP BY 1")
def cluster_text(spark, sf):
    return X.cluster_text(table(spark, sf, "documents"), "source", "text", "doc_id").select(F.col("source").alias("cluster"), F.md5("text").alias("h"))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOP_WORDS)


# each cluster's text is one, with the separator between documents: n-grams cross and hold it
@query(rf"""WITH d AS (SELECT source AS cluster, list_filter(regexp_extract_all(string_agg(translate(lower(coalesce(text, '')), chr(10) || chr(9), '  '), ' [SEP] ' ORDER BY doc_id), '[\pL\pN_]{{2,}}|\[SEP\]'), lambda x: x NOT IN ({_STOP})) AS tok FROM documents GROUP BY 1),
g AS (SELECT cluster, unnest(list_concat(list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]), list_transform(range(1, len(tok) - 1), lambda i: tok[i] || ' ' || tok[i + 1] || ' ' || tok[i + 2]))) AS term FROM d),
tf AS (SELECT cluster, term, count(*) AS tf FROM g GROUP BY 1, 2), total AS (SELECT term, sum(tf) AS total FROM tf GROUP BY 1),
mean AS (SELECT floor(avg(n))::DOUBLE AS m FROM (SELECT cluster, sum(tf) AS n FROM tf GROUP BY 1)),
raw AS (SELECT cluster, term, tf, tf * ln(m / total) AS raw FROM tf JOIN total USING (term), mean), len AS (SELECT cluster, sqrt(sum(raw * raw)) AS l FROM raw GROUP BY 1),
s AS (SELECT cluster, term, tf, raw / l AS score FROM raw JOIN len USING (cluster))
SELECT cluster, term, tf, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, term) AS rank FROM s) WHERE rank <= 30""")
def cluster_tfidf_top30(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("cluster"), "doc_id", C.preprocess_text(F.col("text"), "other").alias("text"))
    return X.cluster_tfidf(d, "cluster", "text", "doc_id").select("cluster", "term", "tf", r6("score").alias("score"), "rank")


@query("""WITH n AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT y, sum(n) OVER (ORDER BY y) / sum(n) OVER () AS f FROM n), l AS (SELECT max(y) AS last FROM s WHERE f <= 0.6)
SELECT year(o_orderdate)::INTEGER AS year, CASE WHEN year(o_orderdate) <= (SELECT last FROM l) THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM orders GROUP BY 1, 2""")
def temporal_split(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"))
    return R.temporal_split(o, "year").groupBy("year", "part").agg(F.count("*").alias("n"))


@query("WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer), k AS (SELECT *, greatest(1, floor(n / 4)::BIGINT) AS size FROM o), s AS (SELECT *, unnest(range(0, 3)) AS split FROM k) SELECT c_custkey, split::INTEGER AS split, CASE WHEN pos < n - (3 - split) * size THEN 'train' ELSE 'test' END AS part FROM s WHERE pos < n - (3 - split) * size + size")
def walk_forward_split(spark, sf):
    return R.walk_forward(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], n_splits=3).select("c_custkey", "split", "part")


@query("WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer) SELECT c_custkey, pos < floor(n * 0.6) AS train, pos >= floor(n * 0.6) AND pos < floor(n * 0.6) + floor(n * 0.2) AS val, pos >= floor(n * 0.6) + floor(n * 0.2) AS test FROM o")
def position_masks(spark, sf):
    return R.position_masks(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"]).select("c_custkey", "train", "val", "test")


@query(f"WITH {FLOW} SELECT src, dst, src % 3 = 0 AND dst % 3 = 0 AS train, src % 3 = 1 AND dst % 3 = 1 AS val, src % 3 = 2 AND dst % 3 = 2 AS test FROM flow")
def edge_masks(spark, sf):
    return E.split_edges(flow(spark, sf), _masks(spark, sf))


def _masks(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), *((F.col("p_partkey") % 3 == i).alias(n) for i, n in enumerate(("train", "val", "test"))))


@query(f"WITH {FLOW} SELECT part, src, dst FROM (SELECT CASE WHEN src % 3 = dst % 3 THEN ['train', 'val', 'test'][src % 3 + 1] END AS part, src, dst FROM flow) WHERE part IS NOT NULL")
def inductive_split(spark, sf):
    return E.inductive_split(_masks(spark, sf), flow(spark, sf))


@query(f"WITH {FLOW}, p AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS pos FROM part) SELECT a.pos AS src_pos, b.pos AS dst_pos FROM flow JOIN p a ON src = a.id JOIN p b ON dst = b.id")
def endpoint_positions(spark, sf):
    n = R.surrogate_ids(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name"), ["p_name", "id"], 0, "pos")
    return E.endpoint_positions(flow(spark, sf), n.select("id", "pos"))


_SCALED = f"{TRIALS}, mm AS (SELECT min(m1) AS a1, max(m1) AS b1, min(m2) AS a2, max(m2) AS b2, min(m3) AS a3, max(m3) AS b3 FROM trials), dist AS (SELECT trial, sqrt(power(1 - (m1 - a1) / (b1 - a1), 2) + power((m2 - a2) / (b2 - a2), 2) + power(1 - (m3 - a3) / (b3 - a3), 2)) AS distance FROM trials, mm)"


@query(f"WITH {_SCALED} SELECT trial, round(distance, 6) AS distance FROM dist")
def ideal_point(spark, sf):
    return D.ideal_point(trials(spark, sf), {"m1": "maximize", "m2": "minimize", "m3": "maximize"}).select("trial", r6("distance").alias("distance"))


@query(f"WITH {_SCALED} SELECT trial, round(distance, 6) AS distance FROM dist ORDER BY dist.distance, trial LIMIT 1")
def best_trial(spark, sf):
    return D.best_trial(trials(spark, sf), {"m1": "maximize", "m2": "minimize", "m3": "maximize"}, "trial").select("trial", r6("distance").alias("distance"))


@query("WITH e AS (SELECT event_id AS i, 1000 - event_id * 0.05::DOUBLE + value AS err FROM events), f AS (SELECT regr_slope(err, i) AS s, regr_intercept(err, i) AS b FROM e) SELECT round(s, 6) AS slope, round(b, 4) AS intercept, ceil(-b / s)::BIGINT AS convergence_trial FROM f")
def learning_rate(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("i"), (1000 - F.col("event_id") * F.lit(0.05) + F.col("value")).alias("err"))
    return D.learning_rate(e, "i", "err").select(r6("slope").alias("slope"), F.round("intercept", 4).alias("intercept"), "convergence_trial")


@query(f"WITH {TRIALS} SELECT trial FROM trials a WHERE NOT EXISTS (SELECT 1 FROM trials b WHERE b.m1 >= a.m1 AND b.m2 <= a.m2 AND b.m3 >= a.m3 AND (b.m1 > a.m1 OR b.m2 < a.m2 OR b.m3 > a.m3))")
def pareto_trials(spark, sf):
    return D.pareto(trials(spark, sf), "trial", {"m1": "maximize", "m2": "minimize", "m3": "maximize"}).select("trial")


_PRED = "p AS (SELECT (l_quantity > 20)::INT AS a, (l_discount > 0.04)::INT AS b, (l_quantity > 25)::INT AS ap, (l_discount > 0.03)::INT AS bp FROM lineitem)"


def _pred(spark, sf):
    return table(spark, sf, "lineitem").select(*(c.cast("int").alias(n) for n, c in (("a", F.col("l_quantity") > 20), ("b", F.col("l_discount") > 0.04), ("a_pred", F.col("l_quantity") > 25), ("b_pred", F.col("l_discount") > 0.03))))


@query(f"WITH {_PRED} SELECT 'a&b' AS rule, count(*) FILTER (WHERE a = 1 AND b = 1) AS n FROM p")
def violations(spark, sf):
    return D.violations(_pred(spark, sf), [("a", "b")])


@query(f"WITH {_PRED}, r AS (SELECT 'a' AS label, a AS y, ap AS q FROM p UNION ALL SELECT 'b', b, bp FROM p), c AS (SELECT label, count(*) FILTER (WHERE y = 1 AND q = 1) AS tp, count(*) FILTER (WHERE y = 0 AND q = 1) AS fp, count(*) FILTER (WHERE y = 1 AND q = 0) AS fn FROM r GROUP BY 1), u AS (SELECT * FROM c UNION ALL SELECT 'micro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM c) SELECT *, round(5.0::DOUBLE * tp / (5 * tp + 4 * fn + fp), 6) AS fbeta FROM u")
def fbeta_counts(spark, sf):
    return D.fbeta(_pred(spark, sf), ["a", "b"], 2.0).withColumn("fbeta", r6("fbeta"))


@query(f"WITH {FLOW}, v AS (SELECT p_partkey AS id, [p_size::DOUBLE, p_partkey::DOUBLE] AS x FROM part) SELECT v.id, round(avg(s.x[1]), 6) AS x0, round(avg(s.x[2]), 6) AS x1 FROM v LEFT JOIN flow t ON t.dst = v.id LEFT JOIN v s ON s.id = t.src GROUP BY 1")
def sage_mean_hop(spark, sf):
    v = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_partkey").cast("double")).alias("features"))
    return E.mean_neighbours(v, flow(spark, sf)).select("id", r6(F.col("agg")[0]).alias("x0"), r6(F.col("agg")[1]).alias("x1"))


@query("WITH l AS (SELECT label, vec_id % 7 = 0 AS noise FROM embeddings) SELECT count(DISTINCT label) FILTER (WHERE NOT noise) AS num_clusters, round(avg(noise::INT::DOUBLE), 6) AS noise_share FROM l")
def cluster_scores(spark, sf):
    l = table(spark, sf, "embeddings").select(F.when(F.col("vec_id") % 7 != 0, F.col("label")).alias("label"))
    return l.agg(F.count_distinct("label").alias("num_clusters"), r6(F.avg(F.col("label").isNull().cast("double"))).alias("noise_share"))


@query("WITH s AS (SELECT year, n, n / sum(n) OVER () AS share FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1)) SELECT year, round(share, 6) AS share, round(sum(share) OVER (ORDER BY year), 6) AS cumulative FROM s")
def cumulative_share(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))  # a row for each year
    s = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return s.select("year", r6("share").alias("share"), r6(F.sum("share").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0))).alias("cumulative"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_totalprice >= 50000) WHERE n = 1")
def top1_after_threshold(spark, sf):
    o = table(spark, sf, "orders").filter("o_totalprice >= 50000")
    return R.top_n(o, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 1).select("o_custkey", "o_orderkey", "o_totalprice")


@query()
def soft_cluster(spark, sf):
    from ..operators.clustering import soft_cluster as run

    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.when(F.col("vec_id") % 9 == 0, F.lit(-1)).otherwise(F.col("label")).alias("label"))
    return run(e, "vec_id", "embedding", "label").select("vec_id", "label", "predicted", r6("probability").alias("probability"))


@query()
def hdbscan(spark, sf):
    from ..operators.clustering import hdbscan as run

    return run(members(spark, sf), "year", "paper_id", "embedding", min_cluster_size=5)


@query()
def mmr(spark, sf):
    d = table(spark, sf, "documents").select(F.try_to_number(F.regexp_extract("source", "([0-9]+)", 1), F.lit("999999999")).cast("int").alias("cluster"), "doc_id", C.preprocess_text(F.col("text"), "other").alias("text"))
    return X.keyphrases(d, "cluster", "text", "doc_id", E.HashingEmbedder(32)).select("cluster", F.array_join("keyphrases", ";").alias("keyphrases"))


@query()
def rf_events(spark, sf):
    l = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_size") > 25).cast("int").alias("big"), (F.col("p_retailprice") > 1200).cast("int").alias("dear"))
    out, _ = D.model_binary_events(l.filter("p_partkey % 3 <> 0"), l.filter("p_partkey % 3 = 0"), ["size", "price"], ["big", "dear"], numTrees=5, maxDepth=4)
    return D.fbeta(out, ["big", "dear"]).withColumn("fbeta", r6("fbeta"))
