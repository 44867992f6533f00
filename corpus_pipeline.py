"""A training corpus from raw documents: language, near duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last
return the columns of documents. Between stages the rows are written to the shared folder, so a lost
executor costs at most a stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemesh.llm import decontamination, jaccard_join, language_id, mixing, sharding
from citemesh.llm._shared import cut, join_hot, small_or_not

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Posterior below which no learned language fits better than all others together.
LEAST_SCORE = 0.5
#: Near duplicates: shingles of five words, Jaccard of 0.8 or more.
WORDS, PERCENT = 5, 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null and empty texts among them) or without a clear language.
    Ids don't matter: rows without one, repeated rows and several texts of one id are judged each by its
    text; a null lang is never learned from. Whole texts are read, however long."""
    langs, p = language_id.learn(docs, ~language_id.held_out())
    named = language_id.predict(docs.select(COLUMNS), langs, p, keep=COLUMNS)
    return named.filter(f"lang_pred <> 'und' and score >= {LEAST_SCORE}").select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each component: the one of smallest id (rows without an id come last), then of the
    smallest hash of its text, then of the smallest other columns. A row is a document, so of repeated rows
    one stays, and two texts of one id both stay unless they link. Texts without words all stay."""
    found = cut(jaccard_join.jaccard_components(docs, percent=PERCENT, words=WORDS).filter("group_key is not null").select("doc_id", "text_key", "group_key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    first = found.groupBy("group_key").agg(first, F.count("*").alias("n")).filter("n > 1").select("group_key", "first")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    grouped = cut(join_hot(found, first, ["group_key"]).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__x"), stays.alias("stays")))
    gone, _ = small_or_not(grouped.filter("not stays").select("__id", "__x").distinct())
    again, _ = small_or_not(grouped.filter("stays").groupBy("__id", "__x").count().filter("count > 1").select("__id", "__x"))
    docs = docs.select(COLUMNS)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__x"))
    kept = docs.join(gone, same, "left_anti")
    once = kept.join(again, same, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return kept.join(again, same, "left_anti").union(once.select("doc_id", "text", "rest.*").select(COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item or its template with other values. Null and empty texts
    hold none; rows without an id, repeated rows and several texts of one id are judged each by its text;
    an empty benchmark rejects nothing."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.clean(docs, benchmark).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources meet weights of n**0.5, and shuffles them. A null source is one of
    its own; rows of one id, and all without an id, share a count and are repeated alike; texts are moved
    whole and never looked at."""
    return mixing.poisson_mix(docs).select(COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and place, in Hilbert order of source, language and length. A null counts
    as a dimension's lowest value; every row takes a place, repeated ones and those without an id too."""
    return sharding.hilbert_shards(docs, ["source", "lang", "n_chars"], keep=COLUMNS)


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", near_duplicate_stage),
    ("template_decontamination", decontamination_stage),
    ("poisson_mix", mixing_stage),
    ("hilbert_shards", sharding_stage),
]
#: Language models and similarity components are no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
