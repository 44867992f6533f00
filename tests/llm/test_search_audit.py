"""Operators 11 to 13 against brute force, and the edge cases of their docstrings."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from citemesh.llm import divergence, lexical_search, minhash_dedup

from .test_jaccard_join import brute


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words_of(r, n, vocabulary):
    return " ".join(r.choice(vocabulary) for _ in range(n))


VOCABULARY = [f"w{i}" for i in range(8)] + ["Été", "ETE", "über-x", "日本", "a1", "x_y", "the", "THE"] + [f"rare{i}" for i in range(60)]


# 11: search
def best(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(i, Counter(term.findall(lower(t)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total = len(bags), sum(x for _, _, x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    want = defaultdict(set)
    for i, t in items:
        want[i] |= set(term.findall(lower(t)))
    out = []
    for item, terms in want.items():
        scores = []
        for i, b, size in bags:
            m = 50 + 50 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in terms if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("leaf", "k"), [(1, 3), (16, 50)])
def test_search(spark, monkeypatch, leaf, k):
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    monkeypatch.setattr(lexical_search, "POSTINGS", 500)
    monkeypatch.setattr(lexical_search, "AT_ONCE", 300)
    r = random.Random(leaf)
    docs = [(i, words_of(r, r.randint(0, 40), VOCABULARY)) for i in range(300)] + [(7, "rare1 rare2")] * 3 + [(None, "rare1 w1"), (900, None), (901, ""), (902, "... !")]
    docs += [(1000 + i, "rare3 the rare4") for i in range(150)] + [(2000, words_of(r, 30_000, VOCABULARY))]
    items = [(i, words_of(r, r.randint(1, 30), VOCABULARY)) for i in range(40)] + [(50, None), (51, "rare1"), (51, "rare2"), (52, "nowhere"), (53, "Rare3, rare3 THE")]
    df = spark.createDataFrame([(a, b, 1, 2.0) for a, b in docs], "doc_id bigint, text string, score int, rank double").repartition(3)
    it = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id bigint, text string, doc_id int")
    want = best(docs, items, k)
    for term_bytes in (lexical_search.TERM_BYTES, 900):
        got = lexical_search.ranked(df, it, k=k, term_bytes=term_bytes)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical_search.ranked(docs.limit(0), items).count() == lexical_search.ranked(docs, items.limit(0)).count() == 0
    assert [tuple(x) for x in lexical_search.ranked(docs, items).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // 3000))]


def test_treaps_are_heaps_in_search_order():
    r = np.random.default_rng(3)
    tid, doc, docs = np.repeat(np.arange(5), 200), np.concatenate([np.sort(r.choice(1000, 200, replace=False)) for _ in range(5)]), 1000
    t = lexical_search.Treaps(tid, doc, r.integers(0, 4, 1000), 6, docs)
    assert t.root[5] == -1

    def walk(node):
        if node < 0:
            return []
        for child in (t.left[node], t.right[node]):
            assert child < 0 or t.adds[child] <= t.adds[node]
        return walk(t.left[node]) + [int(t.doc[node])] + walk(t.right[node])

    for i in range(5):
        assert walk(t.root[i]) == doc[tid == i].tolist()
    # the highest within an interval
    node, lo, hi = np.repeat(t.root[:5], 50), r.integers(-1, 900, 250), r.integers(1, 100, 250)
    got = t.within(node, lo, lo + hi)
    for g, i, a, b in zip(got, np.repeat(np.arange(5), 50), lo, lo + hi):
        inside = [x for x in range(i * 200, i * 200 + 200) if a < t.doc[x] < b]
        assert (g < 0 and not inside) or t.adds[g] == max(t.adds[x] for x in inside) and g in inside


def test_search_prunes(monkeypatch):
    """A rare term's documents are found without scoring all others."""
    r = np.random.default_rng(1)
    docs = 4000
    tid = np.concatenate([np.zeros(docs, int), np.ones(20, int)])
    doc = np.concatenate([np.arange(docs), r.choice(docs, 20, replace=False)])
    adds = np.concatenate([r.integers(1, 50, docs), r.integers(500, 900, 20)])
    t = lexical_search.Treaps(tid, doc, adds, 2, docs)
    visits = []
    within = t.within
    monkeypatch.setattr(t, "within", lambda node, lo, hi: visits.append(len(node)) or within(node, lo, hi))
    q, d, s = lexical_search.search(t, [np.array([0, 1])], np.array([1, 10]), 10)
    total = np.bincount(doc, weights=adds * np.array([1, 10])[tid], minlength=docs).astype(int)
    assert sorted(zip((-s).tolist(), d.tolist())) == sorted(zip((-total).tolist(), range(docs)))[:10]
    assert sum(visits) < docs / 4


# 12: MinHash
def near(r, words, share):
    return [w if r.random() > share else f"n{r.randint(0, 9999)}" for w in words]


def test_minhash(spark):
    r = random.Random(5)
    docs = []
    for g in range(25):
        base = [f"t{r.randint(0, 3000)}" for _ in range(r.choice([4, 20, 60, 200]))]
        docs += [" ".join(near(r, base, r.choice([0, 0.005, 0.02, 0.06]))) for _ in range(r.randint(1, 12))]
    hot = [f"h{i}" for i in range(150)]
    docs += [" ".join(near(r, hot, 0.01)) for _ in range(150)] + ["a b c d"] * 40 + ["A  b\tC d", "a b", "a", "a a a a", "", " \n", None, "é É b", "é é b"]
    docs += [" ".join(f"l{r.randint(0, 10**6)}" for _ in range(60_000))] * 2
    rows = [(i + 1, t) for i, t in enumerate(docs)] + [(5, docs[4])] * 2 + [(None, docs[0]), (None, "only here"), (None, None)]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, True, "x") for i, t in rows], "doc_id bigint, text string, kept boolean, n string").repartition(4)
    got = minhash_dedup.duplicates(df).collect()
    want = brute(rows, 85, 3)
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == sorted(((w[0], w[1], w[2]) for w in want), key=str)
    assert all(x.kept == (x.doc_id == x.component_id if x.doc_id is not None and x.component_id is not None else x.n_shingles == 0) for x in got)
    left = minhash_dedup.unique(df).collect()
    groups = {x.group_key for x in got if x.group_key is not None}
    assert len(left) == len(groups) + sum(x.group_key is None for x in got)
    assert minhash_dedup.duplicates(df.limit(0)).count() == minhash_dedup.unique(df.limit(0)).count() == 0


def test_minhash_over_tiles(spark, monkeypatch):
    """A large group of near copies, dealt over many tiles, is one component."""
    monkeypatch.setattr(minhash_dedup.jj, "TILE", 2000)
    r = random.Random(2)
    hot = [f"h{i}" for i in range(120)]
    rows = [(i, " ".join(near(r, hot, 0.008))) for i in range(200)] + [(1000 + i, words_of(r, 50, VOCABULARY)) for i in range(50)]
    got = {x.doc_id: x.component_id for x in minhash_dedup.duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {w[0]: w[2] for w in brute(rows, 85, 3)}


def test_signatures_estimate_and_steps_prune():
    r = np.random.default_rng(7)
    for share in (0.3, 0.6, 0.9):
        both, own = r.integers(0, 2**63, 2000, dtype=np.uint64), [r.integers(0, 2**63, 1000, dtype=np.uint64) for _ in range(2)]
        n = int(2000 * share)
        a, b = (np.concatenate([both[:n], o[: 2000 - n]]) if len(o) >= 2000 - n else np.concatenate([both[:n], o]) for o in own)
        j = n / len(np.union1d(a, b))
        assert abs((minhash_dedup.minima(a) == minhash_dedup.minima(b)).mean() - j) < 0.15
    least = [minhash_dedup.least_equal(n) for n in (32, 64, 96, 128, 160)]
    assert least == sorted(least) and 0 < least[0] < 0.85 * 32 and least[-1] < 0.85 * 160
    # by simulation of the posterior: no more than `miss` beyond, and the bound is tight
    t = 0.85
    tail = lambda n, m: sum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))
    for n in (32, 160):
        m = minhash_dedup.least_equal(n)
        assert tail(n, m - 1) < minhash_dedup.MISS <= tail(n, m)
    s = minhash_dedup.minima(np.arange(50, dtype=np.uint64))
    assert len(s) == minhash_dedup.HASHES and len(minhash_dedup.buckets(s)) == minhash_dedup.BANDS


# 13: divergence
def distances(rows):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", term.findall(lower(t))) for t, lang, source in rows]
    df, tf = Counter(), Counter()
    for lang, source, ts in docs:
        df.update((lang, t) for t in set(ts))
        tf.update((lang, source, t) for t in ts)
    out = []
    for lang in {x[0] for x in docs}:
        kept = [t for (la, t), n in df.items() if la == lang and n >= 3]
        sources = {x[1] for x in docs if x[0] == lang}
        v = len(kept)
        count = {s: {t: tf[lang, s, t] for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v) for t in kept}
        rate, q = {s: p(count[s]) for s in sources}, p(whole)
        for s in sources:
            f = [(sum((rate[s][t] - rate[o][t]) ** 2 // rate[o][t] for t in kept), o) for o in sources if o != s]
            g = [((rate[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[s][t] and rate[s][t] > q[t]]
            for part, found in (("pair", f), ("term", g)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found, 1) if part == "pair" or i <= 200]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(2, 20, 5), (64, 1 << 14, 1 << 12)])
def test_divergence(spark, monkeypatch, sizes):
    for name, x in zip(("BLOCK", "STRIP", "CHUNK"), sizes):
        monkeypatch.setattr(divergence, name, x)
    monkeypatch.setattr(divergence, "TABLE", 50)
    r = random.Random(4)
    vocabulary = [f"x{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Été", "ÉTÉ", "日本", "A", "a"]
    rows = [(words_of(r, r.randint(0, 40), vocabulary), r.choice(["en", "en", "fr", None]), r.choice(["s0", "s0", "s0", "s1", "s2", "s3", "s4", None])) for _ in range(250)]
    rows += [("same words here", "en", "s1")] * 5 + [(None, "en", "empty"), ("", "en", ""), ("123 4", "de", "s1"), ("once", "de", "s2"), ("alone alone", "xx", "one")] + [("alone", "xx", "one")] * 3
    rows += [(words_of(r, 50_000, vocabulary), "fr", "long")]
    df = spark.createDataFrame([(i % 7, *x, "v", 1) for i, x in enumerate(rows)], "doc_id int, text string, lang string, source string, v string, rank int").repartition(3)
    assert sorted(map(tuple, divergence.audit(df).collect())) == distances(rows)
    assert divergence.audit(df.limit(0)).count() == 0


def test_rates_are_exact_for_large_counts(spark):
    r = random.Random(1)
    some = [(c, n, v) for n, v in ((r.randint(1, 10**15), r.randint(1, 10**9)) for _ in range(200)) for c in (0, n, r.randint(0, n))]
    want = [1 + 10**9 * (c + 1) // (n + v) for c, n, v in some]
    c, n, v = (np.array(x) for x in zip(*some))
    assert divergence.rates(c, n + v).tolist() == want
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(some)], "i int, c bigint, n bigint, v bigint")
    assert [x.p for x in df.withColumn("p", divergence.rate("c", "n", "v")).orderBy("i").collect()] == want
