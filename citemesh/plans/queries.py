"""The registered queries, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import nested as N
from ..operators import communities as M
from ..operators import graph as G
from ..operators import modeling as D
from ..operators import relational as R
from .catalog import ORACLES, QUERIES
from .views import AUTHORS, CITES, MEMBERS, REFS, TRADE, cites, members, papers_struct, ref_cluster, table, trade


def query(sql: str | None = None, name: str | None = None):
    """Registers f(spark, sf_dir) under its name, and its oracle."""

    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return put


def r6(c):
    return F.round(c, 6)


# ---- citations and interdisciplinarity


@query(f"""WITH {CITES}, {REFS}, known AS (SELECT paper AS cited, cluster FROM ref_cluster WHERE year <= 1998 AND cluster > -1),
n AS (SELECT CAST(max(cluster) + 1 AS DOUBLE) AS n FROM ref_cluster),
per AS (SELECT citing, cluster, count(*) AS k FROM cites JOIN known USING (cited) WHERE year = 1998 GROUP BY 1, 2),
s AS (SELECT citing, CAST(sum(k) AS BIGINT) AS n_refs, CAST(max(k) AS DOUBLE) AS mk, sum(CAST(k AS DOUBLE) * k) AS kk FROM per GROUP BY 1)
SELECT citing, n_refs, round(least(CAST(1 AS DOUBLE), n / (n - 1) * (1 - mk / n_refs) * (1 - sqrt(greatest(kk / (CAST(n_refs AS DOUBLE) * n_refs) / n - (1 / n) * (1 / n), 0)))), 6) AS score FROM s, n""")
def interdisciplinarity_citation(spark, sf):
    out = M.citation_interdisciplinarity(cites(spark, sf), ref_cluster(spark, sf), 1998)
    return out.withColumn("score", r6("score"))


@query(f"""WITH {CITES}, {REFS}, sym AS (SELECT citing + 1000000000 AS paper, cited AS other FROM cites UNION ALL SELECT cited, citing + 1000000000 FROM cites),
n AS (SELECT s.paper, r.cluster, count(*) AS k FROM sym s JOIN ref_cluster r ON s.other = r.paper GROUP BY 1, 2)
SELECT paper, cluster, round(CAST(k AS DOUBLE) / sum(k) OVER (PARTITION BY paper), 6) AS fraction FROM n""")
def citation_fractions_undirected(spark, sf):
    e = cites(spark, sf).select((F.col("citing") + 1000000000).alias("citing"), "cited")
    return M.citation_fractions(e, ref_cluster(spark, sf).select("paper", "cluster"), table(spark, sf, "lineitem").count()).withColumn("fraction", r6("fraction"))


@query(f"WITH {MEMBERS}, l AS (SELECT paper_id, list_transform(embedding, lambda x: abs(x)) AS p FROM members) SELECT paper_id, round(least(1.0::DOUBLE, len(q)::DOUBLE / (len(q) - 1) * (1 - list_max(q)) * (1 - list_stddev_pop(q))), 6) AS score FROM (SELECT paper_id, list_transform(p, lambda x: x / list_sum(p)) AS q FROM l WHERE list_sum(p) > 0)")
def interdisciplinarity_vector(spark, sf):
    m = members(spark, sf).select("paper_id", F.transform("embedding", lambda x: F.abs(x)).alias("p"))
    m = m.withColumn("total", F.aggregate("p", F.lit(0.0), lambda s, x: s + x)).filter("total > 0")
    return m.select("paper_id", r6(C.interdisciplinarity(F.transform("p", lambda x: x / F.col("total")))).alias("score"))


# ---- relational core


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT o_orderkey) AS papers FROM orders GROUP BY 1")
def papers_by_year(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count_distinct("o_orderkey").alias("papers"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT o_custkey) AS authors FROM orders GROUP BY 1")
def authors_by_year(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count_distinct("o_custkey").alias("authors"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_pairs(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("SELECT c_nationkey, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n = 1")
def dedupe_keep_first(spark, sf):
    return R.keep_first(table(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"]).select("c_nationkey", "c_custkey", "c_name")


@query("SELECT c.c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, o.p) AS segment FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS p FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def left_fill_coalesce(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("segment"))
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("segment"))
    return R.fill_tiers(c, "c_custkey", "segment", [o]).select("c_custkey", "segment")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def anti_join(spark, sf):
    o = table(spark, sf, "orders").filter("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def semi_endpoint_integrity(spark, sf):
    a = G.NodeSet(table(spark, sf, "part").filter("p_size < 20").select(F.col("p_partkey").cast("string").alias("id")), "Part")
    b = G.NodeSet(table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("id")), "Supplier")
    e = G.EdgeSet.build(table(spark, sf, "lineitem"), "MADE_BY", "l_partkey", "l_suppkey", a, b)
    return e.df.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def union_missing_cols(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query(f"WITH {TRADE} SELECT src, dst FROM trade UNION ALL SELECT dst, src FROM trade")
def undirected_double(spark, sf):
    return G.EdgeSet(trade(spark, sf), "TRADES").undirected()


@query("SELECT DISTINCT id FROM (SELECT 'p' || l_partkey AS id FROM lineitem UNION ALL SELECT 's' || l_suppkey FROM lineitem)")
def unique_endpoints(spark, sf):
    e = table(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS \"{k}\"" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def event_pivot(spark, sf):
    return R.pivot_counts(table(spark, sf, "events"), "user_id", "event_type", ["click", "error", "purchase", "signup", "view"])


@query("SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS scaled FROM part")
def minmax_scale(spark, sf):
    return R.minmax_scaled(table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("scaled")), ["scaled"]).withColumn("scaled", r6("scaled"))


@query("SELECT count(*) AS n, round(count(a)::DOUBLE / count(*), 6) AS a_rate, round(count(b)::DOUBLE / count(*), 6) AS b_rate FROM (SELECT CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS a, nullif(c_mktsegment, 'BUILDING') AS b FROM customer)")
def match_rate(spark, sf):
    c = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("a"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("b"))
    return R.match_rate(c, ["a", "b"]).select("n", r6("a_rate").alias("a_rate"), r6("b_rate").alias("b_rate"))


@query("SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY s_name, s_suppkey) AS id, s_suppkey FROM supplier")
def surrogate_ids(spark, sf):
    top = table(spark, sf, "nation").agg(F.max("n_nationkey").alias("top"))
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name").crossJoin(F.broadcast(top))
    return R.surrogate_ids(s, ["s_name", "s_suppkey"], F.col("top") + 1).select("id", "s_suppkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def filter_by_ids(spark, sf):
    ids = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query(f"WITH {MEMBERS} SELECT paper_id, round(list_sum(embedding), 4) AS total FROM members WHERE year = 2017 AND embedding IS NOT NULL ORDER BY paper_id")
def embedding_scan(spark, sf):
    m = members(spark, sf).filter("year = 2017 and embedding is not null").orderBy("paper_id")
    return m.select("paper_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("SELECT id, title, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ';') END AS tags FROM (SELECT *, row_number() OVER (PARTITION BY id, title ORDER BY seq) AS n FROM (SELECT CASE WHEN event_id % 10 <> 0 THEN user_id END AS id, event_type AS title, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN [event_type] ELSE []::VARCHAR[] END AS tags FROM events) WHERE id IS NOT NULL) WHERE n = 1")
def clean_api_result(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 10 != 0, F.col("user_id")).alias("id"), F.col("event_type").alias("title"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, F.array("event_type")).otherwise(F.array().cast("array<string>")).alias("tags"))
    e = R.keep_first(e.filter("id is not null"), ["id", "title"], ["seq"])
    return e.select("id", "title", C.list_join(N.empty_to_null("tags")).alias("tags"))


@query("SELECT n_name, n_regionkey::BIGINT AS region FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)")
def new_keys_only(spark, sf):
    n = table(spark, sf, "nation")
    new = n.agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_regionkey").cast("bigint")))).alias("new"))  # 25 tags
    old = n.filter("n_nationkey % 2 = 0").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_regionkey").cast("bigint")))).alias("old"))
    return new.crossJoin(old).select(F.explode(C.new_keys(F.col("new"), F.col("old"))).alias("n_name", "region"))


@query("SELECT p_brand AS trial, round(avg(p_retailprice), 6) AS price_mean, round(stddev_pop(p_retailprice), 6) AS price_std FROM part GROUP BY 1")
def repeat_stats(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("trial"), F.col("p_retailprice").alias("price"))
    return D.trial_stats(p, "trial", ["price"]).select("trial", r6("price_mean").alias("price_mean"), r6("price_std").alias("price_std"))


@query("SELECT o_orderkey, o_orderdate, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000 OR (o_orderstatus IN ('F', 'P') AND c_acctbal <= 0)")
def filters(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.filter((F.col("o_totalprice") > 300000) | (F.col("o_orderstatus").isin("F", "P") & (F.col("c_acctbal") <= 0))).select("o_orderkey", "o_orderdate", "c_name")


@query("SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS balance FROM customer")
def masked_assignment(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") < 0, F.lit(0.0)).otherwise(F.col("c_acctbal")).alias("balance"))


@query("SELECT id, name, kind FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prio) AS n FROM (SELECT n_name AS id, n_name AS name, 'institution' AS kind, 0 AS prio FROM nation WHERE n_nationkey < 15 UNION ALL SELECT n_name, n_name, 'funder', 1 FROM nation WHERE n_nationkey > 8)) WHERE n = 1")
def union_keep_first(spark, sf):
    n = table(spark, sf, "nation")
    a = n.filter("n_nationkey < 15").select(F.col("n_name").alias("id"), F.col("n_name").alias("name"), F.lit("institution").alias("kind"), F.lit(0).alias("prio"))
    b = n.filter("n_nationkey > 8").select(F.col("n_name").alias("id"), F.col("n_name").alias("name"), F.lit("funder").alias("kind"), F.lit(1).alias("prio"))
    return R.keep_first(a.union(b), ["id"], ["prio"]).select("id", "name", "kind")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def order_limit(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(C.capped_limit(100))


# ---- scalars and arrays


# the 21 tokens, each on its own; && and || go with their characters
@query("SELECT c_custkey, " + "replace(" * 19 + "c_name || '+' || c_mktsegment || '&&(x)?;#a/b'" + "".join(f", '{t}', '')" for t in ["+", "-", "&", "|", "!", "(", ")", "{", "}", "[", "]", "^", '"', "~", "*", "?", ":", "/", "#"]) + " AS clean FROM customer")
def clean_special(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", C.clean_special(F.concat("c_name", F.lit("+"), "c_mktsegment", F.lit("&&(x)?;#a/b"))).alias("clean"))


@query("SELECT doc_id, md5(CASE WHEN lang = 'en' THEN regexp_replace(translate(lower(coalesce(text, '')), chr(10) || chr(9), '  '), '[^A-Za-z0-9 ]+', '', 'g') ELSE translate(lower(coalesce(text, '')), chr(10) || chr(9), '  ') END) AS h FROM documents")
def preprocess_text(spark, sf):
    c = F.when(F.col("lang") == "en", C.preprocess_text(F.col("text"))).otherwise(C.preprocess_text(F.col("text"), "other"))
    return table(spark, sf, "documents").select("doc_id", F.md5(c).alias("h"))


@query("""SELECT o_orderkey, lower(substr(coalesce(c_name || ', ' || c_mktsegment, ''), 1, 200)) || ' ' || year(o_orderdate)::VARCHAR || ', "' || lower(coalesce(nullif(o_orderpriority, '1-URGENT'), '')) || '" ' || lower(o_orderstatus) AS citation FROM orders JOIN customer ON o_custkey = c_custkey""")
def full_citation(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select("o_orderkey", C.full_citation(F.array("c_name", "c_mktsegment"), F.col("o_orderdate"), F.nullif("o_orderpriority", F.lit("1-URGENT")), F.col("o_orderstatus")).alias("citation"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def iso_timestamp(spark, sf):
    return table(spark, sf, "events").select("event_id", C.iso_timestamp(F.col("ts")).alias("iso"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_flatten(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").alias("props")).select("event_id", F.col("props.k").alias("k"))


@query("SELECT p_partkey, nullif(regexp_extract(p_brand, '^Brand#([0-9])[0-9]$', 1), '') AS maker, nullif(regexp_extract(p_brand, '^Brand#[0-9]([0-9])$', 1), '') AS line FROM part")
def regex_columns(spark, sf):
    return C.extract_groups(table(spark, sf, "part"), "p_brand", {"maker": "Brand#([0-9])[0-9]", "line": "Brand#[0-9]([0-9])"}).select("p_partkey", "maker", "line")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS status, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 5 WHEN '2' THEN 4 WHEN '3' THEN 3 END AS weight FROM orders")
def recode_map(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.recode(F.col("o_orderstatus"), {"F": "finished", "O": "open"}, F.lit("other")).alias("status"), C.recode(F.substring("o_orderpriority", 1, 1), {"1": 5, "2": 4, "3": 3}).alias("weight"))


@query("SELECT c_custkey, nullif(concat_ws(';', CASE WHEN c_acctbal > 5000 THEN 'rich' END, CASE WHEN c_nationkey < 10 THEN 'near' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'builder' END), '') AS flags FROM customer")
def condense_flags(spark, sf):
    yes = lambda c: F.when(c, "Yes").otherwise("No")
    c = table(spark, sf, "customer").select("c_custkey", yes(F.col("c_acctbal") > 5000).alias("F_rich"), yes(F.col("c_nationkey") < 10).alias("F_near"), yes(F.col("c_mktsegment") == "BUILDING").alias("F_builder"))
    return c.select("c_custkey", C.condense_flags(["F_rich", "F_near", "F_builder"], "F_").alias("flags"))


@query("SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'name' END, CASE WHEN c_custkey % 3 = 0 THEN 'segment' END], lambda x: x IS NOT NULL), ';') AS missing FROM customer")
def null_labels(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 != 0, F.col("c_name")).alias("a"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("b"))
    return c.select("c_custkey", C.list_join(C.null_labels({"a": "name", "b": "segment"})).alias("missing"))


@query("""WITH b AS (SELECT CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS DATE) AS bucket_start FROM orders),
e AS (SELECT bucket_start, CAST(lead(bucket_start) OVER (ORDER BY bucket_start) - INTERVAL 1 DAY AS DATE) AS bucket_end FROM b)
SELECT bucket_start, bucket_end, '[' || strftime(bucket_start, '%Y-%m-%d') || 'T00:00:00Z TO ' || strftime(bucket_end, '%Y-%m-%d') || 'T00:00:00Z]' AS filter FROM e WHERE bucket_end IS NOT NULL""")
def date_buckets(spark, sf):
    ends = table(spark, sf, "orders").agg(F.trunc(F.min("o_orderdate").cast("date"), "month").alias("start"), F.max("o_orderdate").cast("date").alias("until"))
    b = R.date_buckets(ends, F.col("until"), "monthly")
    return b.withColumn("filter", R.range_filter())


@query("SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def days_between(spark, sf):
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "l_partkey", F.datediff("l_shipdate", "o_orderdate").cast("bigint").alias("days"))


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, make_date(year(o_orderdate), 1, 1) AS start_date, make_date(year(o_orderdate), 12, 31) AS end_date FROM orders")
def year_window(spark, sf):
    y = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    a, b = C.year_window(F.col("year"))
    return y.select("year", a.alias("start_date"), b.alias("end_date"))


@query(f"WITH {MEMBERS} SELECT DISTINCT 'cluster' || cluster || '_' || year AS label FROM members")
def cluster_labels(spark, sf):
    return members(spark, sf).select(C.cluster_label(F.col("cluster"), F.col("year")).alias("label")).distinct()


@query(f"WITH {MEMBERS} SELECT a.paper_id AS a, b.paper_id AS b, round(list_dot_product(a.embedding, b.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding))), 6) AS score FROM members a JOIN members b ON a.cluster = b.cluster AND a.year = b.year AND a.paper_id < b.paper_id")
def cosine_pairs(spark, sf):
    return M.cosine_within(members(spark, sf), ["year", "cluster"], "paper_id", "embedding").withColumn("score", r6("score"))


@query("WITH n AS (SELECT c_nationkey AS k, list(DISTINCT c_custkey // 7) AS segs FROM customer GROUP BY 1) SELECT a.k AS a, b.k AS b, round(len(list_intersect(a.segs, b.segs))::DOUBLE / len(list_distinct(list_concat(a.segs, b.segs))), 6) AS score FROM n a JOIN n b ON a.k < b.k")
def jaccard_sets(spark, sf):
    n = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("a")).agg(F.collect_set(F.expr("c_custkey div 7")).alias("sa"))
    b = n.select(F.col("a").alias("b"), F.col("sa").alias("sb"))
    return n.join(b, F.col("a") < F.col("b")).select("a", "b", r6(C.jaccard("sa", "sb")).alias("score"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: (1 - x::DOUBLE) * (1 - x::DOUBLE)))), 6) AS distance, array_to_string(list_transform(embedding, lambda x: (round(x::DOUBLE * 100))::BIGINT), ';') AS joined FROM embeddings")
def list_join(spark, sf):
    e = table(spark, sf, "embeddings")
    ones = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (1 - x.cast("double")) * (1 - x.cast("double"))))
    return e.select("vec_id", r6(ones).alias("distance"), C.list_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 100).cast("bigint"))).alias("joined"))


@query("SELECT p_partkey, array_to_string(list_transform(range(0, 5), lambda i: CASE WHEN i = p_partkey % 5 THEN p_size WHEN i = (p_partkey + 1) % 5 THEN 1 ELSE 0 END), ';') AS v FROM part")
def zero_filled_vector(spark, sf):
    p = table(spark, sf, "part")
    v = C.fill_vector(F.array((F.col("p_partkey") % 5).cast("int"), ((F.col("p_partkey") + 1) % 5).cast("int")), F.array(F.col("p_size").cast("double"), F.lit(1.0)), 5)
    return p.select("p_partkey", C.list_join(F.transform(v, lambda x: x.cast("int"))).alias("v"))


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name, c_nationkey::BIGINT AS nation FROM customer")
def project_properties(spark, sf):
    return R.project_properties(table(spark, sf, "customer"), [{"old": "c_custkey", "new": "id", "type": "string"}, {"old": "c_name", "new": "name", "type": "string"}, {"old": "c_nationkey", "new": "nation", "type": "long"}])


# ---- nested


@query("SELECT author AS \"authorId\", min(name) AS name FROM (" + f"WITH {AUTHORS} SELECT * FROM authors" + ") GROUP BY 1")
def explode_unique(spark, sf):
    return N.explode_unique(papers_struct(spark, sf), "authors", ["authorId"], ["paper"]).select("authorId", "name")


@query(f"WITH {AUTHORS} SELECT paper, author, CAST(row_number() OVER w AS INTEGER) AS pos, CAST(row_number() OVER w - 1 - count(*) OVER (PARTITION BY paper) AS INTEGER) AS rev FROM authors WINDOW w AS (PARTITION BY paper ORDER BY author)")
def author_positions(spark, sf):
    p = papers_struct(spark, sf).select("paper", F.explode(N.author_positions(F.col("authors"))).alias("a"))
    return p.select("paper", F.col("a.authorId").alias("author"), F.col("a.authorListPosition").alias("pos"), F.col("a.authorListPositionReversed").alias("rev"))


@query(f"WITH {AUTHORS}, o AS (SELECT paper, name, lead(name) OVER (PARTITION BY paper ORDER BY nation, author) AS nxt FROM authors) SELECT paper, bool_and(coalesce(name <= nxt, true)) AND count(*) > 1 AS alphabetized FROM o GROUP BY 1")
def alphabetized_flag(spark, sf):
    by_nation = F.array_sort(F.transform("authors", lambda a: F.struct(a["s_nationkey"].alias("n"), a["authorId"].alias("authorId"), a["name"].alias("name"))))
    p = papers_struct(spark, sf).select("paper", N.author_positions(by_nation).alias("a"))
    return p.select("paper", F.col("a")[0]["authorListAlphabetized"].alias("alphabetized"))


@query("SELECT c_custkey, CAST(least(c_custkey % 4, 2) AS INTEGER) AS n, CASE WHEN c_custkey % 4 > 0 THEN '1x' ELSE '' END || CASE WHEN c_custkey % 4 > 1 THEN ',2y' ELSE '' END AS joined FROM customer")
def zip_structs(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), (F.col("c_custkey") % 4).cast("int")).alias("ids"), F.array(F.lit("x"), F.lit("y")).alias("names"))
    z = c.select("c_custkey", N.zip_structs(grantId=F.col("ids"), funder=F.col("names")).alias("z"))
    return z.select("c_custkey", F.size("z").alias("n"), F.array_join(F.transform("z", lambda x: F.concat(x["grantId"].cast("string"), x["funder"])), ",").alias("joined"))


@query("WITH l AS (SELECT l_orderkey AS id, 'n' || (l_suppkey % 3) AS name, l_partkey AS inst FROM lineitem), g AS (SELECT id, name, count(*) AS k, CAST(sum(inst) AS BIGINT) AS s FROM l GROUP BY 1, 2) SELECT id, string_agg(name || ':' || k || ':' || s, ';' ORDER BY name) AS authors FROM g GROUP BY 1")
def nested_group(spark, sf):
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.concat(F.lit("n"), F.col("l_suppkey") % 3).alias("name"), F.col("l_partkey").alias("inst"))).alias("x"))
    l = l.select("id", F.transform("x", lambda a: a["name"]).alias("author_name"), F.transform("x", lambda a: a["name"]).alias("author_last"), F.transform("x", lambda a: a["inst"]).alias("author_inst"))
    out = N.nested_authors(l, "id", {"institution": "author_inst"})
    total = lambda a: F.aggregate(a["institutions"], F.lit(0).cast("bigint"), lambda s, x: s + x["institution"])
    return out.select("id", F.array_join(F.transform("authors", lambda a: F.concat_ws(":", a["name"], F.size(a["institutions"]).cast("string"), total(a).cast("string"))), ";").alias("authors"))


@query(f"WITH {AUTHORS} SELECT DISTINCT author, n_name AS institution FROM authors JOIN nation ON nation = n_nationkey")
def affiliations(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    a = papers_struct(spark, sf).select("paper", F.explode("authors").alias("a")).select("paper", "a.*").join(n, "s_nationkey")
    p = a.groupBy(F.col("paper").alias("id")).agg(F.collect_list(F.struct("authorId", F.array(F.struct(F.col("n_name").alias("institution"))).alias("institutions"))).alias("authors"))
    return N.affiliations(p)


@query(f"WITH {AUTHORS} SELECT paper, string_agg(name, ';' ORDER BY author) AS names FROM authors GROUP BY 1")
def field_lists(spark, sf):
    return papers_struct(spark, sf).select("paper", F.array_join(N.field_list(F.col("authors"), "name"), ";").alias("names"))


@query("SELECT DISTINCT n_name AS name, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey")
def unique_institutions(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    p = n.select(F.col("n_nationkey").alias("id"), F.array(F.struct(F.array(F.struct(F.col("n_name").alias("institution"), F.col("r_name").alias("country"))).alias("institutions"))).alias("authors"))
    return N.unique_institutions(p, order="id").select("name", F.col("country")[0].alias("country"))
