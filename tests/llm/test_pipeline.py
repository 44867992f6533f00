"""run() against a brute-force version of its stages on a small corpus."""

import hashlib
import math
import random
from collections import Counter

import xxhash

import corpus_pipeline as cp
from citemesh.llm import mixing

from .test_jaccard_join import shingles

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    r = random.Random(9)
    words = {"en": "the of and water house river market garden letter number winter summer between something".split(), "de": "der die und wasser haus fluss markt garten brief zahl winter sommer zwischen etwas".split()}
    item = "Which of these numbers is the largest when all seven apples are counted twice in the morning before lunch"
    new = lambda lang, n: " ".join(r.choice(words[lang]) + r.choice(["", "s", "en"]) for _ in range(n))
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        rows.append((i, new(lang, r.randint(30, 90)), lang, f"s{i % 4}" if i % 5 else None))
    for i in range(160, 180):
        base = rows[r.randrange(160)]
        rows.append((i, base[1] if i % 2 else base[1] + " tail", base[2], base[3]))
    rows += [(200, rows[1][1] + " " + item, "en", "s1"), (201, None, "en", "s1"), (202, "123 456", "en", "s1"), (203, "", "de", "s2"), rows[7]]
    # several texts of one id, rows without an id, twins and near twins among them, and a very long text
    alone, long = new("en", 50), new("en", 60_000)
    rows += [(8, new("en", 40), "en", "s3"), (8, new("en", 45), None, None), (None, alone, "en", "s0"), (None, alone, "en", "s0"), (None, alone + " end", "en", None), (None, rows[9][1], "de", "s1"), (None, new("de", 30), "de", "s2")]
    rows += [(300, long, "en", "s2"), (301, long + " " + new("en", 40), "en", "s2"), (302, long + " " + item, "en", "s2")]
    return [(*x, len(x[1]) if x[1] is not None else None) for x in rows], [(0, item), (1, "Another item that nothing in here contains at all, not even by chance, says the editor")]


def one_of_each(rows):
    """Rows without near copies: of each component the row that comes first by id, text hash, other columns."""
    sets = [shingles(x[1], 5) for x in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    first = {}
    for i, x in enumerate(rows):
        h = xxhash.xxh64_intdigest(x[1], seed=42)
        rest = tuple((v is not None, v or 0) for v in x[2:])
        key = (x[0] is None, x[0] or 0, h - (1 << 64) if h >> 63 else h, rest)
        first[root(i)] = min(first.get(root(i), (key, x)), (key, x), key=lambda y: y[0])
    return [x for _, x in first.values()]


def test_run_is_the_brute_force_version(spark, tmp_path):
    rows, items = corpus()
    # a column of one more name, and a clash with what stages add
    df = spark.createDataFrame([(*x, "y", 1) for x in rows], COLUMNS + ", shard string, lang_pred int").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in cp.STAGES] == ["language_id", "jaccard_join", "template_decontamination", "poisson_mix", "hilbert_shards"]

    kept = one_of_each([x for x in rows if x[1] and any(c.isalpha() for c in x[1])])
    kept = [x for x in kept if items[0][1] not in x[1]]
    assert sum(x[0] is None for x in kept) == 2 and sum(x[0] == 8 for x in kept) == 3 and {300} == {x[0] for x in kept if x[0] in (300, 301, 302)}
    n = Counter(x[3] for x in kept)
    w = {s: math.sqrt(k) for s, k in n.items()}
    want = Counter()
    for x in kept:
        lam = w[x[3]] / sum(w.values()) * len(kept) / n[x[3]]
        u = int(hashlib.md5(f"{mixing.SEED}:{'null' if x[0] is None else x[0]}".encode()).hexdigest()[:13], 16) / (1 << 52)
        k, p, c = 0, math.exp(-lam), math.exp(-lam)
        while u >= c:
            k += 1
            p *= lam / k
            c += p
        if k:
            want[x] = k
    got = cp.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got) == want
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(k)) for s, k in sizes.items())


def test_each_stage_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
