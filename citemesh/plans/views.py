"""Views over the test tables that stand for bibliographic data, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MEMBERS = "members AS (SELECT CAST(2016 + vec_id % 3 AS INTEGER) AS year, label AS cluster, vec_id AS paper_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"
CITES = "cites AS (SELECT DISTINCT l_partkey AS cited, l_orderkey AS citing, CAST(year(o_orderdate) AS INTEGER) AS year FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
REFS = "ref_cluster AS (SELECT p_partkey AS paper, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS cluster, CAST(1995 + p_partkey % 7 AS INTEGER) AS year FROM part)"
TRADE = """revenue AS (SELECT c_nationkey AS src, s_nationkey AS dst, sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS exact
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
trade AS (SELECT src, dst, CAST(exact AS DOUBLE) AS weight FROM (SELECT *, exact * count(*) OVER (PARTITION BY src) > sum(exact) OVER (PARTITION BY src) AS strong FROM revenue) WHERE strong)"""
FLOW = """flow AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS dst FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) WHERE dst IS NOT NULL)"""
TRIALS = "trials AS (SELECT p_brand AS trial, avg(p_retailprice) AS m1, stddev_pop(p_retailprice) AS m2, CAST(count(*) AS DOUBLE) AS m3, avg(CAST(p_size AS DOUBLE)) AS m4, max(p_retailprice) AS m5 FROM part GROUP BY 1)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def members(spark, sf):
    return table(spark, sf, "embeddings").select((F.lit(2016) + F.col("vec_id") % 3).cast("int").alias("year"), F.col("label").alias("cluster"), F.col("vec_id").alias("paper_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def cites(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("cited"), F.col("l_orderkey").alias("citing")).distinct()
    return l.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("citing"), F.year("o_orderdate").alias("year")), "citing").select("cited", "citing", "year")


def ref_cluster(spark, sf):
    part = table(spark, sf, "part")
    brands = part.select("p_brand").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("p_brand")) - 1)  # 25 brands
    return part.join(brands, "p_brand").select(F.col("p_partkey").alias("paper"), "cluster", (F.lit(1995) + F.col("p_partkey") % 7).cast("int").alias("year"))


def trade(spark, sf):
    """Edges from each nation to those it spends more on than on its average partner; sums are exact."""
    exact = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", exact.alias("r"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    g = l.join(o, "l_orderkey").join(c, "c_custkey").join(s, "l_suppkey").filter("src <> dst").groupBy("src", "dst").agg(F.sum("r").alias("exact"))
    w = Window.partitionBy("src")  # a row for each two nations
    return g.withColumn("strong", F.col("exact") * F.count("*").over(w) > F.sum("exact").over(w)).filter("strong").select("src", "dst", F.col("exact").cast("double").alias("weight"))


def flow(spark, sf):
    """Edges from each part to the next larger one in the same order: a graph that grows with the tables."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()  # one shuffle for both
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_partkey"))
    return l.select(F.col("l_partkey").alias("src"), nxt.alias("dst")).filter("dst is not null").distinct()


def trials(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("trial")).agg(F.avg("p_retailprice").alias("m1"), F.stddev_pop("p_retailprice").alias("m2"), F.count("*").cast("double").alias("m3"), F.avg(F.col("p_size").cast("double")).alias("m4"), F.max("p_retailprice").alias("m5"))


def papers_struct(spark, sf):
    """Orders as papers with author structs: the customers' suppliers by line."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name"), "s_nationkey")
    a = F.array_sort(F.collect_list(F.struct(F.col("l_suppkey").alias("authorId"), "name", "s_nationkey")))
    return l.join(s, "l_suppkey").groupBy(F.col("l_orderkey").alias("paper")).agg(a.alias("authors"))


AUTHORS = "authors AS (SELECT DISTINCT l_orderkey AS paper, l_suppkey AS author, s_name AS name, s_nationkey AS nation FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
