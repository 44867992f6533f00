import random
import re

import numpy as np
import pytest

from citemesh.llm import jaccard_join as jj

SPLIT = re.compile("[^\x20\x09-\x0d]+")


def shingles(t, words=4):
    ws = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not ws:
        return frozenset()
    n = min(words, len(ws))
    return frozenset(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))


def brute(rows, percent=85, words=4):
    """Of each row: id, set size, smallest id its links reach, number of other sets linked."""
    rows = [(i, shingles(t, words)) for i, t in rows]
    sets = list({s for _, s in rows if s})
    up, links = {s: s for s in sets}, dict.fromkeys(sets, 0)

    def root(x):
        while up[x] is not x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if 100 * len(x & y) >= percent * len(x | y):
                links[x] += 1
                links[y] += 1
                up[root(x)] = root(y)
    least = {}
    for i, s in rows:
        if s and i is not None:
            least[root(s)] = min(i, least.get(root(s), i))
    return [(i, len(s), least.get(root(s)) if s else i, links.get(s, 0)) for i, s in rows]


def order(rows):
    return sorted(map(tuple, rows), key=str)


def texts(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    long = lambda k: [r.choice(vocabulary) for _ in range(k)]

    def edit(ws, k):
        ws = list(ws)
        for _ in range(k):
            at = r.randrange(len(ws))
            ws[at : at + 1] = r.choice([[], [r.choice(vocabulary)], [ws[at], "new"]])
        return ws

    rows = [(i, " ".join(long(r.choice([1, 2, 3, 4, 5, 8, 12, 30, 100, 300])))) for i in range(n)]
    for i in range(n):
        base = rows[r.randrange(n)][1].split()
        rows.append((n + i, " ".join(edit(base, r.randint(0, max(1, len(base) // 30)))) or None))
    core = long(150)
    rows += [(1000 + i, " ".join(edit(core, r.randint(1, 4)))) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "a b c"), (2004, "A  b\tC"), (2005, "a b c d"), (3, rows[3][1]), (2006, "É a b c d"), (2007, "é a b c d"), (2008, "x y a b c")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rows = texts(seed) + [(None, "a b c d e f g h i"), (70, "a b c d e f g h i"), (None, "a b c d e f g h i j"), (None, None), (3, "another text of the same id")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, n int, sig string").repartition(3)
    got = jj.jaccard_components(df).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert order(got) == order(brute(rows))


def test_pipeline_threshold(spark):
    rows = texts(3, 40)
    got = jj.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=80, words=5).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert order(got) == order(brute(rows, 80, 5))


def test_buckets_over_many_tiles(spark, monkeypatch):
    """A third of all rows are near copies, one row is very long, and tiles hold a few sets each."""
    monkeypatch.setattr(jj, "TILE", 400)
    r = random.Random(5)
    core = [f"w{r.randrange(500)}" for _ in range(90)]
    rows = [(i, " ".join(core[:k] + [f"x{i}"] + core[k:])) for i, k in ((i, r.randrange(90)) for i in range(80))]
    rows += [(100 + i, " ".join(f"w{r.randrange(500)}" for _ in range(r.randint(3, 60)))) for i in range(150)]
    long = " ".join(f"v{r.randrange(3000)}" for _ in range(300_000))
    rows += [(500, long), (501, long + " and one more"), (502, long + " " + rows[0][1])]
    got = jj.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert order(got) == order(brute(rows))


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert jj.jaccard_components(df).count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, "other words here now")], "doc_id bigint, text string")
    got = {(r.doc_id, r.component_id) for r in jj.jaccard_components(df).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_signature(percent):
    r = np.random.default_rng(1)
    for _ in range(1500):
        n = int(r.integers(5, 400)) if r.random() < 0.5 else int(r.integers(5, 40))
        a = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        most = n * (100 - percent) // 100
        k = int(r.integers(0, most + 1))
        b = np.concatenate([a[k:], r.integers(0, 1 << 63, int(r.integers(0, most - k + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both) and len(a) != both:
            assert set(jj.signatures(a, percent).tolist()) & set(jj.signatures(b, percent).tolist())


@pytest.mark.parametrize("percent", [80, 85])
def test_unrelated_sets_share_no_signature(percent):
    r = np.random.default_rng(2)
    for n in (6, 7, 9, 12, 18, 25, 40, 100, 400):
        seen, total = {}, 0
        for _ in range(200):
            for s in jj.signatures(np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)), percent).tolist():
                seen[s] = seen.get(s, 0) + 1
        assert max(seen.values()) == 1
