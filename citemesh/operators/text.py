"""Cluster keyphrases: tokens, n-grams, cluster TF-IDF and maximal marginal relevance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import gram_counts as K
from .relational import surrogate_ids, top_n
from .storage import SMALL, forget, stored

SEPARATOR = " [SEP] "
#: English stop words, and one publisher's name.
STOP_WORDS = tuple("i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't elsevier".split())


def cluster_text(docs: DataFrame, cluster: str, text: str, order: str, sep: str = SEPARATOR) -> DataFrame:
    """(cluster, text): all texts of a cluster in order. Unbounded by nature; cluster_tfidf() doesn't need it."""
    whole = F.array_sort(F.collect_list(F.struct(order, text)))
    return docs.filter(F.col(text).isNotNull()).groupBy(cluster).agg(F.array_join(F.transform(whole, lambda x: x[text]), sep).alias("text"))


def tokens(c: Column, stop: tuple[str, ...] | None = STOP_WORDS) -> Column:
    """Words of two characters or more and separators, as they are written, without stop words."""
    found = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]{2,}|\[SEP\])"), 1)
    return found if not stop else F.filter(found, lambda x: ~x.isin(*stop))


def _runs(c: Column, n: int, last: Column, first: Column | None = None) -> Column:
    """The n-grams at the places `first` (0) to under `last` of a token array, which is a name or a lambda's variable: its
    elements are read in place, where slices of it would each copy it."""
    first = F.lit(0) if first is None else first
    grams = F.transform(F.sequence(first, last - 1), lambda i: F.concat_ws(" ", *(F.get(c, i + j) for j in range(n))))
    return F.when(last > first, grams).otherwise(F.array().cast("array<string>"))


def ngrams(c: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """All n-grams of a token array, joined by a space. The array is bound to a variable, so that what it is
    made of is evaluated once a row, not at every place."""
    return F.flatten(F.transform(F.array(c), lambda t: F.concat(*(_runs(t, n, F.size(t) - n + 1) for n in sizes))))


def _borders(docs: DataFrame, cluster: str, text: str, order: str, longest: int, stop: tuple[str, ...] | None) -> DataFrame:
    """(cluster, n, tok, must) of each document: its number of tokens; its last tokens, the separator at the place `must` and
    the first tokens behind that, null for a cluster's last document. Documents get their places by a sort over ranges
    of (cluster, order), so a large cluster is many tasks'; only the tokens at their ends are sorted and sent."""
    tok = tokens(F.coalesce(F.col(text), F.lit("")), stop)
    ends = lambda t: F.struct(F.size(t).alias("n"), F.slice(t, 1, longest).alias("head"), F.slice(t, F.greatest(F.lit(1), F.size(t) - longest + 2), longest - 1).alias("tail"))
    rows = docs.select(F.col(cluster).alias("cluster"), F.col(order).alias("__o"), F.transform(F.array(tok), ends)[0].alias("e")).select("cluster", "__o", "e.*")
    rows = surrogate_ids(stored(rows), ["cluster", "__o"], 0, "__at").drop("__o")  # the sort reads twice, texts are taken apart once
    sent = rows.select(F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("k"), "__at", F.col("cluster").alias("__c"), F.col("head").alias("h")).select((F.col("__at") - F.col("k")).alias("__at"), "k", "__c", "h")
    behind = sent.groupBy("__at", "__c").agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("behind"))  # one for each k at most
    both = rows.join(behind, (rows["__at"] == behind["__at"]) & rows["cluster"].eqNullSafe(F.col("__c")), "left").select("cluster", "n", "tail", "behind")
    joint = F.array(F.lit("[SEP]"))
    after = F.slice(F.flatten(F.transform("behind", lambda x: F.concat(joint, x["h"]))), 1, longest)
    return both.select("cluster", "n", F.concat("tail", after).alias("tok"), F.size("tail").alias("must"))


def _token_rows(docs: DataFrame, borders: DataFrame, cluster: str, text: str, stop: tuple[str, ...] | None) -> DataFrame:
    """(cluster, tok, must): documents, and the tokens around each separator, whose n-grams are those with the separator."""
    own = docs.select(F.col(cluster).alias("cluster"), tokens(F.coalesce(F.col(text), F.lit("")), stop).alias("tok"), F.lit(-1).alias("must"))
    return own.union(borders.filter("tok is not null").select("cluster", "tok", "must"))


def cluster_ngrams(docs: DataFrame, cluster: str, text: str, order: str, sizes: tuple[int, ...] = (2, 3), stop: tuple[str, ...] | None = STOP_WORDS) -> DataFrame:
    """(cluster, term) of each n-gram of a cluster's text, which is its documents in order with a separator
    between them: n-grams cross from one document to the next. Documents are read where they lie; only their ends are sorted."""
    rows = _token_rows(docs, _borders(docs, cluster, text, order, max(sizes), stop), cluster, text, stop)
    inside = F.col("must") < 0
    first = lambda n: F.when(inside, 0).otherwise(F.greatest(F.lit(0), F.col("must") - n + 1))
    # the tokens are bound to a variable, so that they are taken from a text once
    grams = F.flatten(F.transform(F.array("tok"), lambda t: F.concat(*(_runs(t, n, F.when(inside, F.size(t) - n + 1).otherwise(F.least(F.col("must") + 1, F.size(t) - n + 1)), first(n)) for n in sizes))))
    return rows.select(F.col("cluster").alias(cluster), F.explode(grams).alias("term"))


def cluster_tfidf(docs: DataFrame, cluster: str, text: str, order: str, sizes: tuple[int, ...] = (2, 3), stop: tuple[str, ...] | None = STOP_WORDS, top: int | None = 30) -> DataFrame:
    """(cluster, term, tf, score, rank): idf is ln(int(mean number of n-grams of a cluster) / total of the
    term), rows have length 1; equal scores go by term. With `top`, all n-grams are counted by keys (gram_counts), which are
    shuffled once, packed; a term's text is made only if its score reaches the least of its cluster's `top` largest.
    Without, in long form."""
    if top is None:
        return _all_tfidf(docs, cluster, text, order, sizes, stop)
    borders = stored(_borders(docs, cluster, text, order, max(sizes), stop))
    size = borders.groupBy("cluster").agg(F.sum("n").alias("t"), F.count("*").alias("d")).select((F.col("t") + F.col("d") - 1).alias("t"))
    n = size.select(sum((F.greatest(F.lit(0), F.col("t") - k + 1) for k in sizes), F.lit(0)).alias("n")).filter("n > 0")
    mean, most, total = n.agg(F.floor(F.avg("n")).cast("double"), F.max("n"), F.sum("n")).first()
    if mean is None:  # no n-grams
        mean, most, total = 1.0, 1, 1
    buckets = max(K.BUCKETS, 1 << (total // K.PER_BUCKET).bit_length())
    rows = K.with_hashes(_token_rows(docs, borders, cluster, text, stop))
    # scores that differ by less than 2e-9 may be equal when rounded; a row is no longer than its n-grams by the largest weight
    slack = 2e-9 * most * max(np.log(mean), np.log(total / mean))
    found = stored(K.best(K.counts(rows, sizes, buckets), mean, top, float(slack)), buckets // 4)
    least = top_n(found.select("cluster", F.explode("best").alias("most")), ["cluster"], [F.desc("most")], top).filter(F.col("rank") == top).select("cluster", F.col("most").alias("least"))
    known = found.groupBy("cluster").agg(F.sqrt(F.sum("square")).alias("length")).join(least, "cluster", "left")
    score = F.try_divide("raw", "length")
    picked = found.select("cluster", "bucket", F.inline("terms")).join(known, "cluster").withColumn("score", score)
    picked = stored(picked.filter(F.coalesce(F.col("score") >= F.try_divide("least", "length") - 2e-9, F.lit(True))).select("cluster", "bucket", "key", "tf", "score"))
    forget(found)
    few = picked.limit(SMALL + 1).count() <= SMALL
    out = K.texts(rows, sizes, buckets, picked.select("key").distinct().toPandas()["key"] if few else None).distinct()
    out = out.join(picked, ["cluster", "bucket", "key"]).select(F.col("cluster").alias(cluster), "term", "tf", "score")
    order_by = [F.desc("__by"), "term"]  # a column: as an expression it would be rounded again in every comparison of the sort
    sliced = out.withColumns({"__by": F.round("score", 9), "__s": F.pmod(F.xxhash64("term"), F.lit(32))})
    some = top_n(sliced, [cluster, "__s"], order_by, top, "__r").drop("__s", "__r")
    return top_n(some, [cluster], order_by, top).drop("__by")


def _all_tfidf(docs: DataFrame, cluster: str, text: str, order: str, sizes: tuple[int, ...], stop: tuple[str, ...] | None) -> DataFrame:
    """(cluster, term, tf, score) of all terms. N-grams are counted once, in long form."""
    tf = stored(cluster_ngrams(docs, cluster, text, order, sizes, stop).groupBy(cluster, "term").agg(F.count("*").alias("tf")))
    mean = tf.groupBy(cluster).agg(F.sum("tf").alias("n")).agg(F.floor(F.avg("n")).cast("double").alias("mean"))  # one row
    total = F.sum("tf").over(Window.partitionBy("term"))  # a row for each cluster that has the term
    raw = stored(tf.withColumn("total", total).crossJoin(F.broadcast(mean)).select(cluster, "term", "tf", (F.col("tf") * F.ln(F.col("mean") / F.col("total"))).alias("raw")))
    forget(tf)
    known = stored(raw.groupBy(cluster).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length")))
    few = known.limit(SMALL + 1).count() <= SMALL
    return raw.join(F.broadcast(known) if few else known, cluster).select(cluster, "term", "tf", F.try_divide("raw", "length").alias("score"))


def mmr(doc: np.ndarray, words: np.ndarray, names: list[str], top_n: int = 5, diversity: float = 0.8) -> list[str]:
    """Maximal marginal relevance by cosines; the first is the most similar to the document."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    near, among = unit(words) @ unit(doc), unit(words) @ unit(words).T
    chosen = [int(near.argmax())]
    while len(chosen) < min(top_n, len(names)):
        rest = [i for i in range(len(names)) if i not in chosen]
        value = (1 - diversity) * near[rest] - diversity * among[np.ix_(rest, chosen)].max(axis=1)
        chosen.append(rest[int(value.argmax())])
    return [names[i] for i in chosen]


def mmr_phrases(candidates: DataFrame, cluster: str, top_n: int = 5, diversity: float = 0.8) -> DataFrame:
    """(cluster, keyphrases): candidates hold term, embedding and the cluster's doc_embedding, at most a
    few dozen terms a cluster."""
    if not 0 < top_n < 30:
        raise ValueError("top_n must be under 30")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("term")
        got = mmr(np.array(pdf["doc_embedding"].iloc[0]), np.array(pdf["embedding"].tolist()), pdf["term"].tolist(), top_n, diversity)
        return pd.DataFrame({cluster: [pdf[cluster].iloc[0]], "keyphrases": [[g.replace("[SEP]", "").strip() for g in got]]})

    return candidates.groupBy(cluster).applyInPandas(one, f"{cluster} {candidates.schema[cluster].dataType.simpleString()}, keyphrases array<string>")


def keyphrases(docs: DataFrame, cluster: str, text: str, order: str, embedder, vector: str | None = None, top_n: int = 5) -> DataFrame:
    """Candidates by cluster TF-IDF, embedded, then MMR against the cluster's mean vector. Noise (label
    below 0) is dropped. Without a `vector` column the embedder makes those of the texts, of which only sums leave a task;
    documents that have one are written down, so that it is made once."""
    from .communities import centroid

    docs = docs.filter(F.col(cluster) > -1)
    if vector is None:
        vector, with_vectors = "__v", embedder.embed(docs.select(cluster, text), text, "__v")
    else:
        docs = with_vectors = stored(docs)
    terms = stored(cluster_tfidf(docs, cluster, text, order).select(cluster, "term"))
    with_vec = embedder.embed(terms.select("term").distinct(), "term", "embedding")
    means = centroid(with_vectors, [cluster], vector).select(cluster, F.col("embedding").alias("doc_embedding"))
    return mmr_phrases(terms.join(with_vec, "term").join(means, cluster), cluster, top_n)
