"""Queries of the graph builders, response parsers and what is written back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import builders as B
from ..operators import communities as M
from ..operators import embedding as E
from ..operators import graph as G
from ..operators import linkage as L
from ..operators.storage import SMALL, stored
from ..sources import bibliographic as S
from .queries import query, r6
from .views import FLOW, MEMBERS, flow, members, table

#: Orders as records: lines are references and authors, the supplier's nation an author's institution, the
#: customer's nation, or a fund by market segment, the funder.
RECORDS = """wrote AS (SELECT DISTINCT l_orderkey AS paper, l_suppkey AS author, s_name AS name, n_name AS inst, r_name AS country FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cited AS (SELECT DISTINCT l_partkey AS ref, l_orderkey AS paper FROM lineitem),
paid AS (SELECT o_orderkey AS paper, CASE WHEN n_nationkey > 8 THEN n_name ELSE 'Fund ' || c_mktsegment END AS funder, c_custkey::VARCHAR AS grant_id, o_orderdate::DATE AS day FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def records(spark, sf):
    t = lambda n: table(spark, sf, n)
    l = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").repartition("l_orderkey")  # keys only are shuffled
    place = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "n_name", "r_name")
    few = t("supplier").limit(10 * SMALL + 1).count() <= 10 * SMALL  # rows of four short columns
    l = l.join(F.broadcast(place) if few else place, "l_suppkey", "left")
    author = F.when(F.col("n_name").isNotNull(), F.struct("l_suppkey", "s_name", F.array(F.struct(F.col("n_name").alias("institution"), F.col("r_name").alias("country"))).alias("inst")))
    lines = l.groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("ref_ids"), F.array_sort(F.collect_set(author)).alias("a"))
    lines = lines.withColumn("a", F.when(F.size("a") > 0, F.col("a")))
    authors = F.transform("a", lambda x, i: F.struct(x["l_suppkey"].cast("string").alias("authorId"), x["s_name"].alias("name"), x["inst"].alias("institutions"), (i + 1).alias("authorListPosition"), (i - F.size("a")).alias("authorListPositionReversed")))
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    funder = F.when(F.col("n_nationkey") > 8, F.col("n_name")).otherwise(F.concat(F.lit("Fund "), "c_mktsegment"))
    o = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("o_orderkey", F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("title"), F.array(F.struct(F.col("c_custkey").cast("string").alias("grantId"), funder.alias("funder"))).alias("funding"))
    return o.join(lines.select("l_orderkey", "ref_ids", authors.alias("authors")), F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey", "o_orderkey")


def _sets(spark, sf):
    r = stored(records(spark, sf))  # read by every set
    return r, B.author_nodes(r), B.publication_nodes(r, [{"old": "title", "new": "title", "type": "string"}]), *B.organisation_nodes(r)


@query(f"WITH {RECORDS} SELECT author::VARCHAR AS id, min(name) AS name FROM wrote GROUP BY 1")
def build_author_nodes(spark, sf):
    return B.author_nodes(records(spark, sf)).df


@query(f"WITH {RECORDS} SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS title FROM orders UNION ALL SELECT DISTINCT ref::VARCHAR, NULL FROM cited WHERE ref NOT IN (SELECT o_orderkey FROM orders)")
def build_publication_nodes(spark, sf):
    return _sets(spark, sf)[2].df


@query(f"WITH {RECORDS}, i AS (SELECT inst AS id, min(country) AS country FROM wrote GROUP BY 1), f AS (SELECT DISTINCT funder AS id FROM paid) SELECT coalesce(i.id, f.id) AS id, CASE WHEN f.id IS NULL THEN 'Institution' ELSE 'Institution;Funder' END AS labels, coalesce(country, '') AS countries FROM i FULL JOIN f ON i.id = f.id")
def build_organisation_nodes(spark, sf):
    _, _, _, whole, funders, only = _sets(spark, sf)
    named = funders.df.select("id", F.lit(funders.labels).alias("labels")).union(only.df.select("id", F.lit(only.labels)))
    return whole.df.join(named, "id").select("id", "labels", F.coalesce(F.array_join("countries", ";"), F.lit("")).alias("countries"))


@query(f"WITH {RECORDS} SELECT DISTINCT funder AS id, funder AS name FROM paid")
def unique_funders(spark, sf):
    return B.unique_funders(records(spark, sf))


@query(f"WITH {RECORDS} SELECT ref::VARCHAR AS src, paper::VARCHAR AS dst, o_orderdate::DATE AS day FROM cited JOIN orders ON paper = o_orderkey WHERE ref <> paper")
def build_citation_edges(spark, sf):
    r, _, papers, *_ = _sets(spark, sf)
    return B.citation_edges(r, papers).df.select("src", "dst", F.col("publicationDate").cast("date").alias("day"))


@query(f"WITH {RECORDS} SELECT author::VARCHAR AS src, paper::VARCHAR AS dst, o_orderdate::DATE AS day, CAST(row_number() OVER w AS INTEGER) AS pos, CAST(row_number() OVER w - 1 - count(*) OVER (PARTITION BY paper) AS INTEGER) AS rev FROM wrote JOIN orders ON paper = o_orderkey WINDOW w AS (PARTITION BY paper ORDER BY author)")
def build_authorship_edges(spark, sf):
    r, people, papers, *_ = _sets(spark, sf)
    return B.authorship_edges(r, people, papers).df.select("src", "dst", F.col("publicationDate").cast("date").alias("day"), F.col("authorListPosition").alias("pos"), F.col("authorListPositionReversed").alias("rev"))


@query(f"WITH {RECORDS} SELECT DISTINCT author::VARCHAR AS src, inst AS dst FROM wrote")
def build_affiliation_edges(spark, sf):
    r, people, _, whole, *_ = _sets(spark, sf)
    return B.affiliation_edges(r, people, whole).df


@query(f"WITH {RECORDS} SELECT funder AS src, paper::VARCHAR AS dst, day, grant_id FROM paid")
def build_funding_edges(spark, sf):
    r, _, papers, whole, *_ = _sets(spark, sf)
    return B.funding_edges(r, whole, papers).df.select("src", "dst", F.col("date").cast("date").alias("day"), F.col("grantId").alias("grant_id"))


def publication_graph(spark, sf):
    r, people, papers, whole, *_ = _sets(spark, sf)
    for n in (people, papers, whole):  # each is read by several edge sets
        n.df = stored(n.df)
    g = G.PropertyGraph().add_nodes(people).add_nodes(papers).add_nodes(whole)
    return g.add_edges("Person", B.authorship_edges(r, people, papers), "Publication").add_edges("Publication", B.citation_edges(r, papers), "Publication").add_edges("Person", B.affiliation_edges(r, people, whole), "Institution").add_edges("Institution", B.funding_edges(r, whole, papers), "Publication")


@query(f"WITH {RECORDS}, aff AS (SELECT DISTINCT author, inst FROM wrote) SELECT aff.inst AS institution, x.author::VARCHAR AS other, count(*) AS paths FROM aff JOIN wrote w ON w.author = aff.author JOIN cited c ON c.ref = w.paper AND c.ref <> c.paper JOIN wrote x ON x.paper = c.paper GROUP BY 1, 2")
def multi_hop_path(spark, sf):
    # what the paths go along: nobody funds, nodes and edges have no properties
    none = F.array().cast("array<struct<grantId: string, funder: string>>").alias("funding")
    authors = F.transform("authors", lambda x: F.struct(x["authorId"].alias("authorId"), x["institutions"].alias("institutions")))
    r = stored(records(spark, sf).select("id", F.lit(None).cast("date").alias("date"), "ref_ids", authors.alias("authors"), none))
    people, papers, (whole, _, _) = B.author_nodes(r), B.publication_nodes(r), B.organisation_nodes(r)
    whole.df = stored(whole.df)
    wrote = B.authorship_edges(r, people, papers).written("src", "dst")  # two hops go along it
    g = G.PropertyGraph().add_nodes(people).add_nodes(papers).add_nodes(whole)
    g.add_edges("Person", wrote, "Publication").add_edges("Publication", B.citation_edges(r, papers), "Publication").add_edges("Person", B.affiliation_edges(r, people, whole), "Institution")
    p = g.path_counts([("AFFILIATED_WITH", "in"), ("WROTE", "out"), ("CITED_BY", "out"), ("WROTE", "in")])
    return p.select(F.col("start_id").alias("institution"), F.col("end_id").alias("other"), "paths")


def shop_graph(spark, sf):
    """Regions, nations, customers, orders and parts as a graph of four edge types; ids name their label."""
    node = lambda name, col, label: G.NodeSet(table(spark, sf, name).select(F.concat(F.lit(label[0]), F.col(col).cast("string")).alias("id")), label)
    edge = lambda name, a, b, kind, ends: G.EdgeSet(table(spark, sf, name).select(F.concat(F.lit(ends[0]), F.col(a).cast("string")).alias("src"), F.concat(F.lit(ends[1]), F.col(b).cast("string")).alias("dst")).distinct(), kind)
    g = G.PropertyGraph()
    for args in (("region", "r_regionkey", "Region"), ("nation", "n_nationkey", "Nation"), ("customer", "c_custkey", "Customer"), ("orders", "o_orderkey", "Order"), ("part", "p_partkey", "Part")):
        g.add_nodes(node(*args))
    g.add_edges("Region", edge("nation", "n_regionkey", "n_nationkey", "HAS_NATION", "RN"), "Nation").add_edges("Nation", edge("customer", "c_nationkey", "c_custkey", "HAS_CUSTOMER", "NC"), "Customer")
    return g.add_edges("Customer", edge("orders", "o_custkey", "o_orderkey", "PLACED", "CO"), "Order").add_edges("Order", edge("lineitem", "l_orderkey", "l_partkey", "CONTAINS", "OP"), "Part")


SHOP = """hop AS (SELECT 'HAS_NATION' AS t, 'R' || r_regionkey AS a, 'N' || n_nationkey AS b FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'HAS_CUSTOMER', 'N' || n_nationkey, 'C' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'PLACED', 'C' || c_custkey, 'O' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT DISTINCT 'CONTAINS', 'O' || o_orderkey, 'P' || p_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


@query(f"""WITH RECURSIVE {SHOP}, p AS (SELECT a AS start, b AS node, 1 AS hops, t AS types FROM hop WHERE a[1] = 'R' UNION ALL SELECT p.start, hop.b, p.hops + 1, p.types || '/' || hop.t FROM p JOIN hop ON hop.a = p.node WHERE p.hops < 10)
SELECT start, hops::INTEGER AS hops, types, count(*) AS paths, count(DISTINCT node) AS ends FROM p GROUP BY ALL""")
def path_expand(spark, sf):
    p = shop_graph(spark, sf).path([("HAS_NATION|HAS_CUSTOMER|PLACED|CONTAINS*1..10", "out")], F.col("n0_label") == "Region")
    return p.groupBy(F.col("n0_id").alias("start"), F.col("r1_hops").alias("hops"), F.array_join("r1_types", "/").alias("types")).agg(F.count("*").alias("paths"), F.count_distinct("n1_id").alias("ends"))


@query(f"""WITH {SHOP}, e AS (SELECT row_number() OVER () AS id, * FROM hop WHERE t IN ('PLACED', 'CONTAINS')), s AS (SELECT id, t, a AS x, b AS y FROM e UNION ALL SELECT id, t, b, a FROM e)
SELECT f.t || '/' || g.t AS types, substr(g.y, 1, 1) AS end_kind, count(*) AS trails, count(DISTINCT g.y) AS ends FROM s f JOIN s g ON g.x = f.y AND g.id <> f.id WHERE f.x[1] = 'O' GROUP BY ALL""")
def typed_trails(spark, sf):
    g = shop_graph(spark, sf)
    p = g.expand("PLACED|CONTAINS", g.nodes["Order"].df.select(F.lit("Order").alias("label"), "id"), 2, 2)
    return p.groupBy(F.array_join("types", "/").alias("types"), F.substring("end_id", 1, 1).alias("end_kind")).agg(F.count("*").alias("trails"), F.count_distinct("end_id").alias("ends"))


@query(f"""WITH {RECORDS}, n AS (SELECT 'Person;Author' AS name, count(DISTINCT author) AS n FROM wrote UNION ALL SELECT 'Publication', count(*) FROM (SELECT o_orderkey FROM orders UNION SELECT ref FROM cited) UNION ALL SELECT 'Institution', count(*) FROM (SELECT inst FROM wrote UNION SELECT funder FROM paid)),
e AS (SELECT 'WROTE' AS name, count(*) AS n FROM wrote UNION ALL SELECT 'CITED_BY', count(*) FROM cited WHERE ref <> paper UNION ALL SELECT 'AFFILIATED_WITH', count(*) FROM (SELECT DISTINCT author, inst FROM wrote) UNION ALL SELECT 'FUNDED', count(*) FROM paid) SELECT * FROM n UNION ALL SELECT * FROM e""")
def describe_counts(spark, sf):
    d = publication_graph(spark, sf).describe()
    return d["labels"].select(F.col("label").alias("name"), "n").union(d["types"].select("type", "n"))


@query("SELECT p_brand AS brand, count(*) AS n FROM part WHERE p_size > 20 GROUP BY 1")
def query_gateway(spark, sf):
    p = G.NodeSet(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_brand", "p_size"), "Part")
    return G.PropertyGraph().add_nodes(p).query("SELECT p_brand AS brand, count(*) AS n FROM Part WHERE p_size > :least GROUP BY 1", least=20)


_PAIRS = """pairs AS (SELECT 'k' || o_custkey AS t1, year(o_orderdate) AS year1, o_orderstatus = 'F' AS born1, o_orderstatus <> 'P' AS died1,
CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'SPLITS_INTO' WHEN '2' THEN 'MERGES_INTO' WHEN '5' THEN NULL ELSE 'CONTINUES_AS' END AS event_type, 'k' || (o_custkey + 1) AS t2, o_totalprice > 250000 AS died2 FROM orders)"""


@query(f"""WITH {_PAIRS}, dead AS (SELECT DISTINCT CASE WHEN died2 THEN t2 ELSE t1 END AS key, 'DIES' AS event_type FROM pairs WHERE (born1 AND died1) OR died2 OR (died1 AND year1 = (SELECT min(year1) FROM pairs))),
r AS (SELECT t1 AS key, event_type FROM pairs WHERE event_type IS NOT NULL UNION ALL SELECT * FROM dead) SELECT key, """ + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS \"{k}\"" for k in ("SPLITS_INTO", "MERGES_INTO", "CONTINUES_AS", "DIES")) + " FROM r GROUP BY 1")
def event_matrix_deaths(spark, sf):
    kind = C.recode(F.substring("o_orderpriority", 1, 1), {"1": "SPLITS_INTO", "2": "MERGES_INTO", "3": "CONTINUES_AS", "4": "CONTINUES_AS"})
    o = table(spark, sf, "orders").select(F.concat(F.lit("k"), "o_custkey").alias("t1"), F.year("o_orderdate").alias("year1"), (F.col("o_orderstatus") == "F").alias("born1"), (F.col("o_orderstatus") != "P").alias("died1"), kind.alias("event_type"), F.concat(F.lit("k"), F.col("o_custkey") + 1).alias("t2"), F.lit(False).alias("born2"), (F.col("o_totalprice") > 250000).alias("died2"))
    return M.event_matrix_with_deaths(o)


@query(f"WITH {MEMBERS}, c AS (SELECT year, cluster, row_number() OVER (ORDER BY year, cluster) + 99 AS id FROM (SELECT DISTINCT year, cluster FROM members)) SELECT paper_id::VARCHAR AS src, id::VARCHAR AS dst, round(embedding[1], 6) AS probability, 'm1' AS model FROM members JOIN c USING (year, cluster)")
def cluster_memberships(spark, sf):
    m = members(spark, sf)
    papers = m.select(F.col("paper_id").alias("id"), "year", F.col("cluster").alias("clusterLabel"), F.col("embedding")[0].alias("membershipProbability"))
    _, _, e = B.cluster_graph(papers, m.select("year", F.col("cluster").alias("label")).distinct(), 100, "m1")
    return e.df.select("src", "dst", r6("membershipProbability").alias("probability"), F.col("modelID").alias("model"))


@query("SELECT source AS cluster, arg_min(lang, doc_id) AS keyphrases FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def first_keyphrases(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("cluster"), F.when(F.col("lang").isNotNull(), F.array("lang")).alias("keyphrases"), F.col("doc_id").alias("id"))
    return M.first_keyphrases(d).select("cluster", F.array_join("keyphrases", ";").alias("keyphrases"))


@query("SELECT doc_id AS id, md5(regexp_replace(text, '[\r\n]+', ' ', 'g')) AS abstract FROM documents WHERE doc_id IS NOT NULL")
def text_scan(spark, sf):
    d = table(spark, sf, "documents").withColumn("title", F.lit(None).cast("string"))
    return B.text_rows(d, "doc_id", "title", "text").select("id", F.md5("abstract").alias("abstract"))


@query(f"WITH {FLOW}, v AS (SELECT p_partkey AS id, p_size <= 25 AS train FROM part) SELECT src, dst, (SELECT count(*) FROM v WHERE train) AS vertices FROM flow JOIN v a ON src = a.id AND a.train JOIN v b ON dst = b.id AND b.train")
def labelled_citation_graph(spark, sf):
    p = table(spark, sf, "part")
    v = p.select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double")).alias("a"), F.array(F.col("p_retailprice")).alias("b"))
    parts = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 25, "Train").otherwise("Test").alias("part"))
    vertices, edges = B.labelled_citations(v, flow(spark, sf), parts, "Train", ["a", "b"])
    return edges.crossJoin(F.broadcast(vertices.filter("size(features) = 2").agg(F.count("*").alias("vertices"))))  # one row


@query("SELECT p_partkey::VARCHAR AS id, min(p_name) AS title, CASE WHEN p_size > 10 THEN 'doi' || p_partkey END AS doi FROM part WHERE p_brand <> 'Brand#1' GROUP BY ALL")
def scholar_parse(spark, sf):
    p = table(spark, sf, "part")
    found = F.struct(F.col("p_partkey").cast("string").alias("paperId"), F.struct(F.when(F.col("p_size") > 10, F.concat(F.lit("doi"), "p_partkey")).alias("DOI")).alias("externalIds"), F.col("p_name").alias("title"), F.array().cast("array<string>").alias("fieldsOfStudy"))
    body = F.when(F.col("p_brand") == "Brand#1", F.to_json(F.struct(F.lit("Paper not found").alias("error")))).otherwise(F.to_json(found))
    return S.scholar_papers(p.select(F.concat(F.lit("u"), "p_partkey").alias("url"), body.alias("body"))).filter("fieldsOfStudy is null").select(F.col("paperId").alias("id"), "title", F.col("DOI").alias("doi"))


@query("""WITH s AS (SELECT user_id, value, CASE WHEN event_id % 3 <> 0 THEN event_type END AS goal FROM events),
d AS (SELECT *, (value - lead(value) OVER w) / lead(value) OVER w AS drop FROM s WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, goal ASC NULLS FIRST))
SELECT user_id::VARCHAR AS user_id, value AS score, goal AS doi FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, goal) AS n FROM d WHERE drop > 0.2 AND goal IS NOT NULL) WHERE n = 1""")
def crossref_parse(spark, sf):
    e = table(spark, sf, "events")
    item = F.struct(F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("DOI"), F.array("event_type").alias("title"), F.col("value").alias("score"))
    r = e.groupBy(F.col("user_id").cast("string").alias("url")).agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("items")).alias("message"))).alias("body"))
    return S.crossref_matches(r).select(F.col("url").alias("user_id"), "score", F.col("DOI").alias("doi"))


@query("SELECT s_suppkey AS row_id, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, 'd' || s_suppkey) AS doi, 'p' || s_suppkey AS id_ss FROM supplier")
def title_search_ids(spark, sf):
    s = table(spark, sf, "supplier")
    df = s.select(F.col("s_suppkey").alias("row_id"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("doi"))
    return L.find_ids(df, s.select(F.col("s_suppkey").alias("row_id"), F.concat(F.lit("d"), "s_suppkey").alias("doi"), F.concat(F.lit("p"), "s_suppkey").alias("paper_id")))


@query(f"""WITH {FLOW}, v AS (SELECT p_partkey AS id, p_size::DOUBLE AS x FROM part),
one AS (SELECT v.id, greatest(0, v.x + coalesce(avg(s.x), 0)) AS x FROM v LEFT JOIN flow t ON t.dst = v.id LEFT JOIN v s ON s.id = t.src GROUP BY v.id, v.x)
SELECT one.id, round(one.x + coalesce(avg(s.x), 0), 6) AS x FROM one LEFT JOIN flow t ON t.dst = one.id LEFT JOIN one s ON s.id = t.src GROUP BY one.id, one.x""")
def layerwise_inference(spark, sf):
    v = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double")).alias("features"))
    eye = (np.eye(1), np.eye(1), np.zeros(1))
    return E.sage_predict(v, flow(spark, sf), [eye, eye]).select("id", r6(F.col("features")[0]).alias("x"))


@query()
def probe(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    test = F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    return E.probe(e.filter(~test), e.filter(test), "embedding", "label").select("rows", r6("micro_f1").alias("micro_f1"))


@query()
def cluster_validity(spark, sf):
    from ..operators.clustering import cluster_validity as run

    return run(members(spark, sf), "year", "embedding", "cluster").withColumn("dbcv", r6("dbcv"))


@query()
def clustering_solution(spark, sf):
    from ..operators.clustering import hdbscan, solution_scores

    rows = members(spark, sf)
    found = hdbscan(rows, "year", "paper_id", "embedding", scores=True)
    s = solution_scores(found, rows, "year", "paper_id", "embedding")
    return s.select("year", "num_clusters", "num_noise_points", *(r6(c).alias(c) for c in s.columns if c not in ("year", "num_clusters", "num_noise_points")))
