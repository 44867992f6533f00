"""The queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, html_text, jaccard_join, language_id, lexical_search, line_dedup, minhash_dedup, mixing, projected_search, sharding, suffix_dedup, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_lines(_table(spark, sf_dir, "documents"))


def op3_projected_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected_search.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    langs, p = language_id.learn(docs, ~language_id.held_out())
    return language_id.predict(docs, langs, p).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mixing.poisson_mix(docs).select(*docs.columns, "n_copies", "copy", F.round("rate", 9).alias("rate"), "shuffle_key")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return sharding.hilbert_shards(docs, ["source", "lang", "n_chars"], keep=["doc_id"])


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "n_windows", F.round("coverage", 6).alias("coverage"), "verbatim")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op11_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


OP6_SQL = minhash_dedup.components_sql(jaccard_join.WORDS, jaccard_join.PERCENT) + """,
q AS (SELECT a AS id, b AS twin FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common = x.n AND common = y.n),
k AS (SELECT id AS doc_id, min(twin) AS class_id FROM (SELECT doc_id AS id, doc_id AS twin FROM w UNION ALL SELECT id, twin FROM q UNION ALL SELECT twin, id FROM q) GROUP BY id),
o AS (SELECT t.a AS doc_id, count(DISTINCT k.class_id) AS n_links FROM t JOIN k ON k.doc_id = t.b JOIN k j ON j.doc_id = t.a WHERE k.class_id <> j.class_id GROUP BY t.a)
SELECT s.doc_id, s.n_shingles, c.component_id, k.class_id, coalesce(o.n_links, 0) AS n_links
FROM s JOIN c ON c.doc_id = s.doc_id JOIN k ON k.doc_id = s.doc_id LEFT JOIN o ON o.doc_id = s.doc_id
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_line_dedup, op3_projected_search, op4_language_id, op5_poisson_mix, op6_jaccard_join, op7_hilbert_shards, op8_html_text, op9_template_leaks, op10_token_counts, op11_treap_search, op12_minhash_dedup, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op5_poisson_mix": mixing.OP5_SQL, "op6_jaccard_join": OP6_SQL, "op11_treap_search": lexical_search.OP11_SQL, "op12_minhash_dedup": minhash_dedup.OP12_SQL, "op13_source_divergence": divergence.OP13_SQL}
