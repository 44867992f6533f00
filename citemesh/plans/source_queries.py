"""Queries of request builders, recorded responses, fan-out, and of what is written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import embedding as E
from ..operators import graph as G
from ..operators import text as X
from ..operators.storage import new_folder
from ..sources import bibliographic as S
from ..sources import sinks as K
from .queries import query, r6
from .views import FLOW, flow, table

BASE = "http://search"


def _counted(spark, sf):
    """(query, hits): a search for each customer's name, with a thousand hits for each of its orders."""
    n = table(spark, sf, "orders").groupBy("o_custkey").count()
    c = table(spark, sf, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(F.col("c_name").alias("query"), (F.coalesce("count", F.lit(0)) * 9000).cast("bigint").alias("hits"))


@query("""WITH n AS (SELECT c_name AS query, count(o_orderkey) * 9000 AS hits FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name),
p AS (SELECT *, unnest(range(0, greatest(CAST(ceil(hits / 25000.0) AS BIGINT), 1))) * 25000 AS start FROM n)
SELECT query, CAST(start AS INTEGER) AS start, 'http://search/select?q=' || replace(query, '#', '%23') || '&q.op=AND&fl=*,score&start=' || start || '&rows=25000&sort=date asc' AS url FROM p""")
def search_pages(spark, sf):
    return S.solr_urls(_counted(spark, sf), BASE, sort="date asc").select("query", "start", "url")


@query("""WITH n AS (SELECT c_custkey AS k, c_name AS query, count(o_orderkey) * 9000 AS hits FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT query, CASE WHEN hits % 2 = 0 OR hits > 90000 THEN hits END AS hits FROM n""")
def search_hits(spark, sf):
    """Hits of recorded searches; bodies that are cut off give null."""
    whole = F.to_json(F.struct(F.struct(F.col("hits").alias("numFound"), F.array().cast("array<string>").alias("docs")).alias("response")))
    body = F.when((F.col("hits") % 2 == 0) | (F.col("hits") > 90000), whole).otherwise(F.substring(whole, 1, 25))
    r = _counted(spark, sf).select(F.concat(F.lit(f"{BASE}/select?q="), F.url_encode("query"), F.lit("&rows=0")).alias("url"), body.alias("body"))
    return S.hit_counts(r).select("query", "hits")


@query("""SELECT 'user ' || user_id AS query, event_id::VARCHAR AS id, CASE WHEN event_id % 3 = 1 THEN '10.1/' || event_id WHEN event_id % 3 = 2 THEN '10.2/' || event_id END AS "DOI", year(ts)::INTEGER AS year FROM events""")
def search_documents(spark, sf):
    """Recorded search responses of at most a thousand documents, to a row for each document."""
    id_ = F.col("event_id").cast("string")
    doi = F.when(F.col("event_id") % 3 == 1, F.array(F.concat(F.lit("10.1/"), id_))).when(F.col("event_id") % 3 == 2, F.array(F.lit("10.0/x"), F.concat(F.lit("10.2/"), id_)))
    doc = F.struct(id_.alias("id"), doi.alias("doi"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.lit("x").alias("score"))
    pages = table(spark, sf, "events").groupBy("user_id", F.expr("event_id div 1000").alias("page")).agg(F.collect_list(doc).alias("docs"))
    url = F.concat(F.lit(f"{BASE}/select?q=user%20"), F.col("user_id").cast("string"), F.lit("&start="), F.col("page").cast("string"))
    r = pages.select(url.alias("url"), F.to_json(F.struct(F.struct("docs").alias("response"))).alias("body"))
    return S.solr_documents(r, "id: string, doi: array<string>, date: string, score: string", drop=["score"]).select("query", "id", "DOI", F.year("date").alias("year"))


@query("""WITH b AS (SELECT date_trunc('month', o_orderdate)::DATE AS a, count(*) * 700 AS hits FROM orders GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY a) - 1 AS number FROM b),
p AS (SELECT *, unnest(range(0, greatest(CAST(ceil(hits / 5000.0) AS BIGINT), 1))) * 5000 AS start FROM n WHERE number >= 6)
SELECT number, CAST(start AS INTEGER) AS start, 'http://search/select?q=*%3A*&q.op=AND&fl=id,title&start=' || start || '&rows=5000&fq=date%3A%5B' || strftime(a, '%Y-%m-%d') || 'T00%3A00%3A00Z+TO+' || strftime(last_day(a), '%Y-%m-%d') || 'T00%3A00%3A00Z%5D' AS url FROM p""")
def corpus_pull(spark, sf):
    """A pull by months that is taken up again at the seventh."""
    a = F.trunc("o_orderdate", "month")
    b = table(spark, sf, "orders").groupBy(a.alias("bucket_start")).agg((F.count("*") * 700).alias("hits")).withColumn("bucket_end", F.last_day("bucket_start"))
    return S.bucket_urls(b, BASE, fields=["id", "title"], page=5000, start=6).select("number", "start", "url")


@query("""SELECT p_partkey AS k, 'http://scholar/paper/DOI:10.1/' || p_partkey || '?fields=title,authors' AS doi, 'http://scholar/paper/PMID:10.1/' || p_partkey AS pubmed,
'http://scholar/author/10.1/' || p_partkey AS author, 'http://scholar/paper/search?query=%2210.1%2F' || p_partkey || '%22&fields=title' AS keyword FROM part""")
def scholar_requests(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string")).alias("v"))
    for name, kind, fields in (("doi", "DOI", ["title", "authors"]), ("pubmed", "PubMed", None), ("author", "Author", None), ("keyword", "keyword", ["title"])):
        p = S.scholar_urls(p, "http://scholar", "v", kind, fields).withColumnRenamed("url", name)
    return p.drop("v")


@query("""SELECT p_partkey AS k, 'http://works/works?query.bibliographic=' || replace(p_name, ' ', '+') || '&rows=20&mailto=me@here' AS url FROM part""")
def citation_requests(spark, sf):
    return S.crossref_urls(table(spark, sf, "part"), "http://works", "p_name", "me@here").select(F.col("p_partkey").alias("k"), "url")


@query("""SELECT c_custkey AS k, c_name AS address, (c_acctbal::DECIMAL(12, 2)::VARCHAR)::FLOAT::DOUBLE AS latitude, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey::DOUBLE END AS longitude FROM customer WHERE c_custkey % 5 <> 0""")
def geocoded_places(spark, sf):
    """Recorded geocoder answers: the first place of a list, numbers that can't be read are null."""
    c = table(spark, sf, "customer").withColumn("k", F.col("c_custkey").cast("string"))
    urls = S.geocode_urls(c, "http://map", {"q": "k", "country": "c_mktsegment"})
    place = F.struct(F.col("c_name").alias("display_name"), F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("lat"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey").cast("string")).otherwise("?").alias("lon"))
    other = F.struct(F.lit("elsewhere").alias("display_name"), F.lit("0").alias("lat"), F.lit("0").alias("lon"))
    got = S.geocoded(urls.select("url", F.when(F.col("c_custkey") % 5 == 0, F.lit("[]")).otherwise(F.to_json(F.array(place, other))).alias("body")))
    return got.select(F.regexp_extract("url", "&q=([0-9]+)", 1).cast("bigint").alias("k"), "address", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))


def _answer(url: str) -> tuple[int, str]:
    """A stand-in service: some requests break off, some are refused for good."""
    n = int(url.rsplit("/", 1)[1])
    if n % 11 == 0:
        raise OSError("broken off")
    return (503 if n % 7 == 0 else 200), f"<{n}>"


@query("SELECT o_orderkey AS k, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 503 ELSE 200 END AS INTEGER) AS status, '<' || o_orderkey || '>' AS body FROM orders WHERE o_orderkey % 11 <> 0")
def fetched(spark, sf):
    """A request for each order through a fan-out of eight workers with a retry; those broken off give no row."""
    urls = table(spark, sf, "orders").select(F.concat(F.lit("http://service/"), F.col("o_orderkey").cast("string")).alias("url"))
    return S.fetch(urls, _answer, workers=8, retries=1).select(F.element_at(F.split("url", "/"), -1).cast("bigint").alias("k"), "status", "body")


@query("SELECT o_orderkey AS id, o_orderpriority AS title, CAST(1 AS BIGINT) AS files FROM orders")
def page_scan(spark, sf):
    """Compressed JSON lines written and read again, with the file that each came from."""
    path = new_folder(spark)
    table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title")).write.option("compression", "gzip").json(path)
    pages = S.read_pages(spark, path, "id bigint, title string")
    return pages.select("id", "title", F.col("_source_file").endswith(".json.gz").cast("bigint").alias("files"))


@query("SELECT o_orderpriority AS folder, CAST(sum(strlen(o_orderkey::VARCHAR) + 1) AS BIGINT) AS bytes FROM orders GROUP BY 1")
def object_scan(spark, sf):
    """Bytes of stored objects by folder, from their content."""
    path = new_folder(spark)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderpriority").alias("folder"))
    o.write.partitionBy("folder").text(path)
    b = S.read_bytes(spark, f"{path}/*/")
    return b.groupBy(F.url_decode(F.regexp_extract("path", "folder=([^/]*)/", 1)).alias("folder")).agg(F.sum(F.octet_length("content").cast("bigint")).alias("bytes"))


@query("SELECT p_name AS line, count(*) AS n FROM part GROUP BY 1")
def snapshot_lines(spark, sf):
    """A compressed snapshot moved to another store, uncompressed."""
    source, target = new_folder(spark), new_folder(spark)
    table(spark, sf, "part").select("p_name").write.option("compression", "gzip").text(source)
    K.transfer_snapshot(spark, source, target, 4)
    return spark.read.text(target).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def _parts(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    nodes = G.NodeSet.build(p, "Part", "p_partkey", [{"old": "p_name", "new": "name", "type": "string"}, {"old": "p_size", "new": "size", "type": "long"}], ("Thing",))
    return nodes, G.EdgeSet.build(flow(spark, sf), "NEXT", "src", "dst", nodes, nodes)


@query(f"WITH {FLOW} SELECT 'node' AS kind, p_partkey::VARCHAR AS a, p_name AS b, 'Part;Thing' AS label FROM part UNION ALL SELECT 'edge', src::VARCHAR, dst::VARCHAR, 'NEXT' FROM flow")
def import_files(spark, sf):
    """Quoted import files of nodes and edges, read again by their headers."""
    n, e = new_folder(spark), new_folder(spark)
    nodes, edges = _parts(spark, sf)
    K.write_nodes(nodes, n)
    K.write_edges(edges, e, "part", "part")
    read = lambda p: spark.read.option("header", True).csv(p)
    v, w = read(n), read(e)
    col = lambda d, start: F.col(f"`{next(c for c in d.columns if start in c)}`")
    one = v.select(F.lit("node").alias("kind"), col(v, ":ID(").alias("a"), col(v, "name").alias("b"), col(v, ":LABEL").alias("label"))
    return one.union(w.select(F.lit("edge"), col(w, ":START_ID"), col(w, ":END_ID"), col(w, ":TYPE")))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def embedding_file(spark, sf):
    """Vectors written as joined text and split into numbers again."""
    path = new_folder(spark)
    K.write_embeddings(table(spark, sf, "embeddings").select("vec_id", "embedding"), path)
    back = spark.read.option("header", True).schema("vec_id bigint, embedding string").csv(path).withColumn("v", C.parse_floats(F.col("embedding")))
    return back.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(f"WITH {FLOW} SELECT src::VARCHAR AS src, dst::VARCHAR AS dst FROM flow JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_size > 10 AND b.p_size > 10")
def graph_files(spark, sf):
    """A whole graph written by label and type, and loaded without the edges whose ends were left out."""
    path = new_folder(spark)
    nodes, edges = _parts(spark, sf)
    K.write_graph({"Part": G.NodeSet(nodes.df.filter("size > 10"), "Part")}, {"NEXT": edges}, path)
    return S.load_graph(spark, f"{path}/nodes/Part", f"{path}/edges/NEXT")[1].select("src", "dst")


@query("SELECT CAST(count(*) AS BIGINT) AS rows, true AS bounded FROM lineitem")
def arrow_put(spark, sf):
    """Rows handed over in Arrow batches of 500 at most, where they are."""
    got = K.put_batches(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), lambda b: None if b.num_rows <= 500 else 1 / 0, 500)
    return got.agg(F.sum("rows").alias("rows"), (F.sum("batches") * 500 >= F.sum("rows")).alias("bounded"))


@query("SELECT o_orderkey AS k, strftime(o_orderdate::TIMESTAMP - INTERVAL 5 HOUR - INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM orders")
def local_to_utc(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), C.utc_text(F.col("o_orderdate").cast("timestamp_ntz"), "+05:30").alias("utc"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s, l_returnflag AS f FROM lineitem WHERE l_returnflag IN ('R', 'A'))
SELECT f AS type, s_nationkey::BIGINT AS nation, count(*) AS n FROM e JOIN supplier ON s = s_suppkey GROUP BY 1, 2""")
def either_type(spark, sf):
    """Orders' hops to suppliers by either of two types."""
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("src"), F.col("l_suppkey").cast("string").alias("dst"), "l_returnflag").distinct()
    g = G.PropertyGraph().add_nodes(G.NodeSet(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id")), "Order"))
    g = g.add_nodes(G.NodeSet(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_nationkey").cast("bigint").alias("nation")), "Supplier"))
    for f in ("R", "A"):
        g = g.add_edges("Order", G.EdgeSet(l.filter(F.col("l_returnflag") == f).drop("l_returnflag"), f), "Supplier")
    return g.match(["R", "A"]).groupBy(F.col("rel_type").alias("type"), F.col("dst_nation").alias("nation")).agg(F.count("*").alias("n"))


@query()
def bigrams(spark, sf):
    """Two-word runs of whole texts after stop words went."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(X.ngrams(X.tokens(F.col("text")), (2,))).alias("term"))
    per = d.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query(f"""WITH {FLOW}, s AS (SELECT sum(ln(1 + exp(-(a.p_size - b.p_size) / 10.0::DOUBLE))) AS x, count(*) AS n FROM flow JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst),
t AS (SELECT sum(ln(1 + exp((a.p_size + b.p_size) / 50.0::DOUBLE))) AS x, count(*) AS n FROM flow JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst)
SELECT round((s.x + t.x) / (s.n + t.n), 6) AS loss FROM s, t""")
def link_loss(spark, sf):
    """Mean cross-entropy of scores of edges that are there and of others."""
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    e = flow(spark, sf).join(p.toDF("src", "a"), "src").join(p.toDF("dst", "b"), "dst")
    return E.edge_loss(e.select(((F.col("a") - F.col("b")) / 10).alias("score")), e.select(((F.col("a") + F.col("b")) / 50).alias("score"))).select(r6("loss").alias("loss"))
