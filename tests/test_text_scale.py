"""N-grams of long documents, and the best terms of a cluster of many equal ones."""

import time

from pyspark.sql import functions as F

from citemesh.operators import text as X
from citemesh.operators.embedding import HashingEmbedder


def test_ngrams_read_a_long_text_once(spark):
    words = [f"w{i}" for i in range(15_000)]
    df = spark.createDataFrame([(" ".join(words),), ("one",), ("",), (None,)], "text string")
    start = time.time()
    got = [r[0] for r in df.select(X.ngrams(X.tokens(F.col("text")), (2, 3))).collect()]
    assert got[0] == [" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)] and got[1:] == [[], [], []]
    assert time.time() - start < 30  # minutes, if the text was taken apart again at every place


def test_best_terms_against_all_ranked(spark):
    docs = [(c, i, " ".join(f"t{(i * 7 + j * j * (c + 1)) % m}" for j in range(60))) for c, m in ((0, 5), (1, 997), (2, 40)) for i in range(30)]
    df = spark.createDataFrame([*docs, (3, 0, "lone words"), (4, 0, "")], "cluster int, id int, text string")
    everything = X.cluster_tfidf(df, "cluster", "text", "id", top=None).collect()
    want = []
    for c in range(5):
        rows = sorted((r for r in everything if r.cluster == c), key=lambda r: (-round(r.score, 9), r.term))[:30]
        want += [(c, r.term, r.tf, k + 1) for k, r in enumerate(rows)]
    got = X.cluster_tfidf(df, "cluster", "text", "id").select("cluster", "term", "tf", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 61


def test_hashed_trigrams(spark):
    import zlib

    import numpy as np

    t = "Abc abcé漢 \U0001f600abc"
    v, low = np.zeros(8), f"  {t.lower()} "
    for i in range(len(low) - 2):
        h = zlib.crc32(low[i : i + 3].encode())
        v[h % 8] += 1 if h >> 16 & 1 else -1
    assert HashingEmbedder(8).vector(t) == (v / np.linalg.norm(v)).tolist()


def test_keyphrases_make_vectors_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(text):
        made.add(1)
        return HashingEmbedder(8).vector(text)

    d = spark.range(40).select((F.col("id") % 2).cast("int").alias("cluster"), "id", F.concat_ws(" ", F.lit("red fox"), F.col("id").cast("string"), F.lit("runs home")).alias("text"))
    out = X.keyphrases(d.withColumn("v", vector("text")), "cluster", "text", "id", HashingEmbedder(8), "v").collect()
    assert len(out) == 2 and made.value == 40


def _shuffled(spark, run):
    """Bytes that tasks have shuffled meanwhile, and what run() gave."""

    def sent():
        time.sleep(1)  # what ended is counted by then
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = sent()
    out = run()
    return sent() - before, out


def test_best_terms_shuffle_packed_keys(spark):
    import random
    from collections import Counter

    import numpy as np

    r = random.Random(3)
    docs = [(c, i, " ".join(f"word{int(r.paretovariate(0.3)) % 90_000}" for _ in range(800))) for i in range(150) for c in ("a", "b")]
    df = spark.createDataFrame(docs, "cluster string, id int, text string").repartition(3)
    sent, got = _shuffled(spark, lambda: X.cluster_tfidf(df.persist(), "cluster", "text", "id").collect())
    tf = {}
    for c in ("a", "b"):
        t = " [SEP] ".join(d[2] for d in sorted(docs, key=lambda d: d[1]) if d[0] == c).split()
        tf[c] = Counter(" ".join(t[i : i + n]) for n in (2, 3) for i in range(len(t) - n + 1))
    total, mean = tf["a"] + tf["b"], sum(map(Counter.total, tf.values())) // 2
    want = {}
    for c, have in tf.items():
        raw = {k: v * np.log(mean / total[k]) for k, v in have.items()}
        length = np.sqrt(sum(v * v for v in raw.values()))
        best = sorted(raw, key=lambda k: (-round(raw[k] / length, 9), k))[:30]
        want |= {(c, k): (have[k], i + 1, round(raw[k] / length, 9)) for i, k in enumerate(best)}
    assert {(x.cluster, x.term): (x.tf, x["rank"], round(x.score, 9)) for x in got} == want
    assert sent < 12 * sum(len(have) for have in tf.values()) + 3_000_000  # texts of terms, sent twice, are more than that


def test_packed_numbers_and_places():
    import numpy as np

    from citemesh.operators import gram_counts as K

    for a in ([], [0], [0, 0], [255, 256, 1], [2**64 - 1, 0]):
        assert K.unpack(K.pack(np.array(a, np.uint64)), len(a)).tolist() == a
    at, row = K.places(np.array([0, 1, 4, 5, 3]), np.array([-1, -1, -1, 2, 0]), 3)
    # all of the third, those of the fourth with its third token, that of the last with its first one
    assert list(zip(at.tolist(), row.tolist(), strict=True)) == [(1, 2), (2, 2), (5, 3), (6, 3), (7, 3), (10, 4)]


def test_best_terms_in_small_pieces(spark, monkeypatch):
    """More ties than may be broadcast, clusters without a name or n-grams: as all terms ranked."""
    from citemesh.operators import gram_counts as K

    df = spark.createDataFrame([("x", i, f"p{i} q{i} r{i}" if i % 3 else None) for i in range(60)] + [(None, 1, "p1 q1 p1 q1"), ("y", 1, "p1 q1"), ("z", 1, None)], "cluster string, id int, text string")
    everything = X.cluster_tfidf(df, "cluster", "text", "id", top=None).collect()
    want = []
    for c in ("x", "y", "z"):
        rows = sorted((r for r in everything if r.cluster == c), key=lambda r: (-round(r.score, 9), r.term))[:30]
        want += [(c, r.term, r.tf, round(r.score, 9), k + 1) for k, r in enumerate(rows)]
    monkeypatch.setattr(X, "SMALL", 3)
    for name in ("PER_BUCKET", "BUCKETS"):
        monkeypatch.setattr(K, name, 4)
    got = X.cluster_tfidf(df, "cluster", "text", "id").select("cluster", "term", "tf", F.round("score", 9), "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 31


def test_keyphrases_write_no_texts(spark):
    d = spark.range(300).select((F.col("id") % 2).cast("int").alias("cluster"), "id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(999_983)).cast("string")))).alias("text"))
    from citemesh.operators import text

    written, was = [], text.stored

    def stored(df, *args):
        out = was(df, *args)
        written.append(out.columns)
        return out

    text.stored = stored
    try:
        got = X.keyphrases(d, "cluster", "text", "id", HashingEmbedder(8)).collect()
    finally:
        text.stored = was
    given = X.keyphrases(HashingEmbedder(8).embed(d, "text", "v"), "cluster", "text", "id", HashingEmbedder(8), "v").collect()
    assert sorted(got) == sorted(given) and len(got) == 2
    assert written and not any("text" in c or "v" in c for c in written)
