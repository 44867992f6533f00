"""Mixing sources to target weights by Poisson replication.

A source of n rows and target share w of `total` rows repeats each row w * total / n times on average.
A row's count inverts the Poisson distribution with that mean at a number hashed from seed and id, so
it needs no state, is the same in every run, and sources meet their weights in expectation. Rows are
exploded by their count and put in the order of a second hash, a global shuffle.

Edge cases: a null source is a source of its own; a null id hashes as `null`; repeated rows share their
id's count; a source of weight 0 goes; texts, however long, null or empty, are moved whole and never looked
at; an empty table gives no rows; a clashing `copy`, `n_copies`, `rate` or `shuffle_key` column is
replaced. Any share of rows may lie in one source: the rates come from a map-side count and are joined by
checked broadcast or salts. A distribution is held from 12 deviations and 30 below its mean to as much
above, so its length grows with the root of the rate; what is left out is below 1e-30. The order is cut
into partitions at equal steps of the second hash, which is uniform, so no sampling pass is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import join_hot, partitions

SEED = 20260
ALPHA = 0.5


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, alpha: float = ALPHA, total: int | None = None) -> DataFrame:
    """(__source, rate, __lo, __cdf) for each source: its mean repetition, and the distribution from count __lo to
    where less than 1e-30 is left. Weights not given are n**alpha (alpha below 1 lifts small sources)."""
    key = F.coalesce(F.concat(F.lit("s:"), F.col(source_col)), F.lit("n"))
    n = docs.groupBy(key.alias("__source")).count()
    if weights:
        given = F.create_map(*(F.lit(x) for k, w in weights.items() for x in ("n" if k is None else f"s:{k}", float(w))))
        n = n.withColumn("w", F.coalesce(given[F.col("__source")], F.lit(0.0)))
    else:
        n = n.withColumn("w", F.pow(F.col("count").cast("double"), F.lit(alpha)))
    whole = n.agg(F.sum("w").alias("sum_w"), F.sum("count").alias("sum_n"))
    size = F.lit(float(total)) if total is not None else F.col("sum_n").cast("double")
    n = n.crossJoin(F.broadcast(whole)).withColumn("rate", F.col("w") / F.col("sum_w") * size / F.col("count"))  # one row
    reach = "(12 * sqrt(rate) + 30)"
    n = n.filter("rate > 0").withColumns({"lo": F.expr(f"cast(greatest(0, rate - {reach}) as int)"), "top": F.expr(f"cast(rate + {reach} as int)")})
    # log of lo!, and then the distribution, summed from lo
    n = n.withColumn("f", F.expr("if(lo > 1, aggregate(sequence(2, greatest(2, lo)), 0D, (a, k) -> a + ln(k)), 0D)"))
    step = "a.f + if(k > greatest(1, lo), ln(k), 0D)"
    n = n.withColumn("cdf", F.expr(f"""
        aggregate(sequence(lo, top), named_struct('f', f, 'c', 0D, 'out', cast(array() as array<double>)), (a, k) ->
            named_struct('f', {step},
                         'c', a.c + exp(-rate + k * ln(rate) - ({step})),
                         'out', array_append(a.out, a.c + exp(-rate + k * ln(rate) - ({step})))), a -> a.out)"""))
    return n.select("__source", "rate", F.col("lo").alias("__lo"), F.col("cdf").alias("__cdf"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, total: int | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs' rows, each as often as its count says, with copy (from 0), n_copies, rate and shuffle_key,
    in the order of shuffle_key."""
    docs = docs.drop("copy", "n_copies", "rate", "shuffle_key")
    key = F.coalesce(F.concat(F.lit("s:"), F.col(source_col)), F.lit("n"))
    rated = join_hot(docs.withColumn("__source", key), rates(docs, source_col, weights, alpha, total), ["__source"]).drop("__source")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rated = rated.withColumn("__u", unit_hash(F.lit(str(seed)), name)).withColumn("n_copies", F.expr("__lo + size(filter(__cdf, c -> c <= __u))")).drop("__lo", "__cdf", "__u")
    out = rated.filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    mixed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), name, F.col("copy").cast("string"))), 1, 15), 16, 10).cast("bigint")
    n = partitions(docs.sparkSession)
    part = F.floor(F.col("shuffle_key") / F.lit(float(1 << 60)) * n).cast("int")  # the key has 60 bits
    return out.withColumn("shuffle_key", mixed).repartitionById(n, part).sortWithinPartitions("shuffle_key", id_col, "copy")


OP5_SQL = f"""
WITH n AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM n) * (SELECT sum(n)::DOUBLE FROM n) / n AS rate FROM n),
p AS (SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
      FROM r, LATERAL (SELECT unnest(range(0, CAST(floor(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k)),
u AS (SELECT doc_id, text, lang, source, n_chars, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)!r} AS u FROM documents),
c AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, r.rate, (SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM u.source AND p.c <= u.u) AS n_copies
      FROM u JOIN r ON r.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, text, lang, source, n_chars, n_copies::INTEGER AS n_copies, copy::INTEGER AS copy, round(rate, 9) AS rate,
       ('0x' || substr(md5('{SEED}-order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy), 1, 15))::BIGINT AS shuffle_key
FROM c, LATERAL (SELECT unnest(range(0, n_copies)) AS copy)
"""
