import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from citemesh.llm import decontamination, html_text, language_id, line_dedup, mixing, projected_search, sharding, token_counts
from pyspark.sql import functions as F


# 7: sharding
@pytest.mark.parametrize("dims", [2, 3])
def test_hilbert_curve_steps_by_one(spark, dims):
    bits = 3
    cells = spark.range(1 << bits * dims).select(*(F.shiftright("id", bits * k).bitwiseAND((1 << bits) - 1).cast("int").alias(f"c{k}") for k in range(dims)))
    got = {r.h: tuple(r[:dims]) for r in cells.withColumn("h", sharding.curve_index([f"c{k}" for k in range(dims)], bits)).collect()}
    assert sorted(got) == list(range(1 << bits * dims))
    assert all(sum(abs(a - b) for a, b in zip(got[i], got[i + 1])) == 1 for i in range(len(got) - 1))


def test_shards(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["", "a", "é" * r.randint(1, 50), None]), r.choice(["x", None]), r.choice(["s1", "s2", None]), r.choice([1, 5, None]), "clash") for i in range(300)]
    rows += [(None, None, None, None, None, "c")] * 3 + [(7, "same", "x", "s1", 4, "c")] * 90
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string")
    got = sharding.hilbert_shards(df, ["source", "lang", "n_chars"]).collect()
    assert len(got) == len(rows)
    n = Counter(x.shard for x in got)
    assert max(n.values()) - min(n[s] for s in range(24)) <= 1 and set(n) <= set(range(24))
    assert all(sorted(x.slot for x in got if x.shard == s) == list(range(n[s])) for s in n)
    for x in got:
        assert x.size == len((x.text or "").encode()) + 8 and x.text_crc32 == (None if x.text is None else zlib.crc32(x.text.encode())) and x.law == "rows" and x.grown_shard is None
    order = [x.curve for x in sorted(got, key=lambda x: (x.shard, x.slot))]
    assert order == sorted(order)
    assert sharding.hilbert_shards(df.limit(0), ["source"]).count() == 0
    long = spark.createDataFrame([(1, "é" * 1_000_000), (2, None)], "doc_id bigint, text string")
    assert {(r.doc_id, r.size) for r in sharding.hilbert_shards(long, ["doc_id"]).collect()} == {(1, 2_000_008), (2, 8)}


def test_strings_are_cut_by_their_whole_length(spark):
    """Sources that share a long prefix, and one that holds a third of all rows."""
    names = [f"a-very-long-common-prefix/{i:03d}" for i in range(64)]
    rows = [(i, names[i % 64]) for i in range(1280)] + [(2000 + i, names[20]) for i in range(640)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string").repartition(5)
    got = {r.source: r["__c0"] for r in sharding.quantised(df, ["source"]).select("source", "__c0").distinct().collect()}
    values = sorted(s for _, s in rows)
    cuts = {values[-(-len(values) * i // 32) - 1] for i in range(1, 32)} - {values[-1]}
    assert got == {s: sum(c < s for c in cuts) for s in names}
    assert sharding.string_cuts(df.limit(0), "source") == []


def test_write_shards(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("s").alias("source"))
    sharding.write_shards(sharding.hilbert_shards(df, ["source"], shards=4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4


# 5: mixing
def test_poisson_counts(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "x") for i in range(3000)] + [(None, None, "y"), (5, "hot", "z"), (5, "hot", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, copy string")
    names = mixing.poisson_mix(df.withColumns({"lo": F.lit(1), "cdf": F.lit(2), "f": F.lit(3), "u": F.lit(4), "count": F.lit(5)}))
    assert {"lo", "cdf", "f", "u", "count"} <= set(names.columns) and {(r.lo, r.cdf, r.f, r.u) for r in names.collect()} == {(1, 2, 3, 4)}
    got = mixing.poisson_mix(df).collect()
    rate = {}
    n = Counter(s for _, s, _ in rows)
    w = {s: math.sqrt(k) for s, k in n.items()}
    for s in n:
        rate[s] = w[s] / sum(w.values()) * len(rows) / n[s]
    import hashlib

    def count(i, lam):
        u = int(hashlib.md5(f"{mixing.SEED}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        k, p, c = 0, math.exp(-lam), math.exp(-lam)
        while u >= c:
            k += 1
            p *= lam / k
            c += p
        return k

    want = Counter()
    for i, s, _ in rows:
        want[i, s] += count(i, rate[s])
    assert Counter((r.doc_id, r.source) for r in got) == +want
    keys = [r.shuffle_key for r in got]
    assert keys == sorted(keys)
    assert mixing.poisson_mix(df.limit(0)).count() == 0


def test_given_weights_and_large_rates(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20, "a").otherwise("b").alias("source"))
    got = mixing.poisson_mix(df, weights={"a": 1.0}, total=40_000).groupBy("source").count().collect()
    assert [r.source for r in got] == ["a"] and abs(got[0]["count"] - 40_000) < 1000


def test_texts_are_mixed_whole(spark):
    long = "word " * 300_000
    rows = [(1, long, "a"), (2, "", "a"), (3, None, "b"), (4, "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.poisson_mix(df, weights={"a": 1.0, "b": 1.0, None: 1.0}, total=60).collect()
    assert {(r.doc_id, r.text, r.source) for r in got} == set(rows)
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)


# 10: token counts
def greedy(word, vocabulary, mark="_"):
    text, at, n = mark + word, 0, 0
    while at < len(text):
        for end in range(len(text), at, -1):
            p = text[at:end]
            if p in vocabulary and (p.startswith(mark)) == (at == 0):
                break
        else:
            return -1
        at, n = end, n + 1
    return n


def test_longest_match_is_greedy():
    r = random.Random(2)
    for _ in range(60):
        vocabulary = {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(2, 25))}
        vocabulary |= {"_" + "".join(r.choice("abc") for _ in range(r.randint(0, 4))) for _ in range(r.randint(1, 8))}
        automaton = token_counts.LongestMatch(tuple(vocabulary), "_")
        for _ in range(60):
            w = "".join(r.choice("abcd" if r.random() < 0.1 else "abc") for _ in range(r.randint(1, 14)))
            assert automaton.count(w) == greedy(w, vocabulary), (w, vocabulary)


def test_token_counts_of_rows(spark):
    rows = [(1, "ab abc  x\n", 0), (2, None, 0), (3, "", 0), (None, "ab", 0), (1, "ab abc  x\n", 0), (4, "ab" * 5000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int")
    got = sorted((tuple(r) for r in token_counts.token_counts(df, vocabulary=("▁", "▁ab", "a", "b", "c", "ab")).collect()), key=str)
    assert got == sorted([(1, 3, 4, 1), (2, 0, 0, 0), (3, 0, 0, 0), (None, 1, 1, 0), (1, 3, 4, 1), (4, 1, 5000, 0)], key=str)


# 4: language id
PIECES = ("▁", "▁th", "a", "b", "c", "th", "e", "ab", "abc", "bc", "t", "h", "▁a")


def all_segmentations(word, p, ids, unseen):
    text = "▁" + word
    sums = [np.ones(p.shape[1])]
    for e in range(1, len(text) + 1):
        total = np.zeros(p.shape[1])
        for s in range(e):
            i = ids.get(text[s:e], unseen if e - s == 1 else None)
            if i is not None:
                total = total + sums[s] * p[i]
        sums.append(total)
    return sums[-1]


def test_forward_sums_all_segmentations():
    r = np.random.default_rng(1)
    v = language_id.Vocabulary(PIECES)
    p = r.random((len(PIECES) + 1, 3)) / 10
    words = ["".join(r.choice(list("abcthez"), int(r.integers(1, 12)))) for _ in range(300)]
    want = np.log([all_segmentations(w, p, v.ids, v.unseen) for w in words])
    assert np.allclose(v.forward(words, p), want)
    assert np.allclose([v.long_word(w, p) for w in words], want)
    counts = np.ones(len(words))
    uses = v.expected(words, counts, np.ascontiguousarray(p[:, 0]))
    lengths = np.array([len(x) for x in PIECES] + [1])
    assert np.isclose((uses * lengths).sum(), sum(len(w) + 1 for w in words))


def test_language_of_rows(spark):
    r = random.Random(3)
    words = {"x": ["the", "abc", "that", "bath"], "y": ["cab", "bec", "eeb", "cca"]}
    rows = [(i, " ".join(r.choice(words["xy"[i % 2]]) for _ in range(20)), "xy"[i % 2], "s") for i in range(200)]
    rows += [(500, None, "x", "s"), (501, "12 !", "y", "s"), (502, "the " * 30, None, "s"), (None, "the that", "x", "s"), (503, "the" * 4000, None, "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    langs, p = language_id.learn(df, ~language_id.held_out(), pieces=PIECES)
    got = {r.doc_id: r for r in language_id.predict(df, langs, p, pieces=PIECES).collect()}
    assert langs == ["x", "y"] and got[500].lang_pred == got[501].lang_pred == "und" and got[501].score == 0
    assert got[502].lang_pred == got[503].lang_pred == got[None].lang_pred == "x"
    held = [r for r in rows[:200] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and all(got[i].lang_pred == lang for i, _, lang, _ in held)
    assert language_id.predict(df.limit(0), langs, p, pieces=PIECES).count() == 0
    none, q = language_id.learn(df.limit(0), ~language_id.held_out(), pieces=PIECES)
    assert {r.lang_pred for r in language_id.predict(df, none, q, pieces=PIECES).collect()} == {"und"}


def test_letters_ties_and_long_words(spark):
    rows = [(1, "² ½ ① ⅷ 12 _ !", "x"), (2, "a² b", "x"), (3, "zz zz", "y"), (4, "th" * 500, "y"), (5, "th" * 500, "y")] + [(10 + i, "abc th", lang) for i in range(40) for lang in ("x", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    langs, p = language_id.learn(df.filter("doc_id >= 10"), F.lit(True), pieces=PIECES)
    got = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language_id.predict(df, langs, p, pieces=PIECES).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] == "x" and got[10] == ("x", 0.5)  # equal models: the first in order
    langs, p = language_id.learn(df, F.col("doc_id").isin(3, 4, 5, 10, 11), pieces=PIECES)
    assert {r.doc_id: r.lang_pred for r in language_id.predict(df, langs, p, pieces=PIECES).collect()}[4] == "y"


def test_every_language_is_learned(spark):
    """300 languages, most of them rare, each with a letter of its own."""
    letters = [chr(0x4E00 + i) for i in range(300)]
    pieces = (language_id.MARK, *letters)
    rows = [(i, letters[i % 300] * 3, f"l{i % 300:03d}") for i in range(600)] + [(1000 + i, f"{letters[0]} {i} {letters[0]}", "l000") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    langs, p = language_id.learn(df, F.lit(True), pieces=pieces)
    assert langs == [f"l{i:03d}" for i in range(300)] and p.shape == (302, 300)
    got = language_id.predict(df, langs, p, pieces=pieces, keep=["doc_id", "lang"]).collect()
    assert len(got) == len(rows) and all(r.lang == r.lang_pred for r in got)


def test_held_out_accuracy(spark):
    """On the given documents, those that learning never reads."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, p = language_id.learn(docs, ~language_id.held_out())
    held = docs.filter(language_id.held_out()).filter("lang is not null and text is not null")
    named = language_id.predict(held, langs, p, keep=["doc_id", "lang"]).filter("lang_pred <> 'und'").collect()
    assert len(named) > 100 and sum(r.lang == r.lang_pred for r in named) / len(named) >= 0.95


# 3: nearest neighbours
def exact_neighbours(good, q):
    return sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:10]


def searched(df, **options):
    got = {}
    for x in projected_search.nearest(df, F.col("vec_id") % 100 == 0, **options).orderBy("query_id", "rank").collect():
        assert x.rank == len(got.setdefault(x.query_id, [])) + 1
        got[x.query_id].append((x.score, x.vec_id))
    return got


@pytest.mark.parametrize("block_rows,regions", [(600, 1024), (100, 4), (5000, 1)])
def test_neighbours(spark, block_rows, regions):
    r = np.random.default_rng(4)
    base = r.standard_normal((1500, 16)).round(3)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(base)]
    rows += [(2000 + i, rows[100][1], 0) for i in range(200)] + [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] * 16, 0), (3003, [1.0, None] * 8, 0), (100, rows[100][1], 0), (3100, [math.inf] * 16, 0), (None, rows[3][1], 0)]
    # another length has no distance to the others
    rows += [(4000 + i, [1.0 + i, 2.0], 0) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int").repartition(3)
    got = searched(df, block_rows=block_rows, regions=regions)
    good = {i: np.array(v) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    assert set(got) == {i for i in good if i % 100 == 0}
    hit = total = 0
    for q in got:
        want = exact_neighbours(good, q)
        assert len(got[q]) == len(want) and got[q] == sorted(got[q])
        for d, i in got[q]:
            assert abs(d - float(np.sqrt(((good[q] - good[i]) ** 2).sum()))) < 1e-9
        hit += len({i for _, i in want} & {i for _, i in got[q]})
        total += len(want)
    assert [i for _, i in got[100]] == list(range(2000, 2010)) and [i for _, i in got[4000]] == [4001, 4002, 4003]
    assert hit / total >= 0.9, hit / total
    few = spark.createDataFrame(rows[:3], df.schema)
    assert projected_search.nearest(few, F.col("vec_id") == 0).count() == 2
    assert projected_search.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_vectors_of_one_id_and_a_common_vector(spark):
    """Of several vectors under one id one counts, wherever its rows lie; a third of all rows may be equal."""
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.standard_normal((600, 8)))] + [(1000 + i, [1.0] * 8) for i in range(300)]
    rows += [(100, [3.0] * 8), (7, [2.0] * 8), (7, [2.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    got = searched(df, block_rows=100)
    assert {len(x) for x in got.values()} == {10} and all(len({i for _, i in x}) == 10 for x in got.values())
    assert [i for _, i in got[1000]] == list(range(1001, 1011)) and [i for _, i in got[1200]] == list(range(1000, 1010))
    assert got == searched(df.repartition(2), block_rows=100)


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    good = {x.vec_id: np.array(x.embedding, float) for x in df.collect()}
    got = searched(df, block_rows=2000)
    want = {q: {i for _, i in exact_neighbours(good, q)} for q in list(got)[:50]}
    assert sum(len(w & {i for _, i in got[q]}) for q, w in want.items()) >= 0.9 * 10 * len(want)


# 8: pages
PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies and more cookies to do things.</p></div><div class="wrap"><div class="post-{n}"><h1>Title &amp; more</h1><p>First <b>bold</b>text,<br>line{n} &#233;.<p>Second
  para <!-- c --> here with some length to it.</p><form><p>Sign up now please</p></form></div><aside class="x"><p>Other things to read that are long enough to matter here.</p></aside>
<div id="comments"><p>{comments}</p></div></div><footer>&copy; me</footer></body></html>"""


def test_pages(spark):
    rows = [(n, "http://Host.example.org/a?b", PAGE.format(n=n, comments="Reader says " * (200 if n == 3 else 1)), "x") for n in range(6)]
    rows += [(10, None, None, "x"), (11, "http://h/", "", "x"), (12, "http://h/", "just text", "x"), (13, "http://h/", "<div><p>open &lt;", "x"), (0, "http://Host.example.org/a?b", rows[0][2], "x"), (14, "http://h/", "<!-- never closed", "x")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()}
    for n in range(6):
        assert got[n].text == f"Title & more First boldtext, line{n} é. Second para here with some length to it.", got[n].text
        assert got[n].n_chars == len(got[n].text)
    assert got[10].text == got[11].text == got[14].text == "" and got[12].text == "just text" and got[13].text == "open <"
    assert html_text.extract(spark.createDataFrame(rows[:1], "page_id bigint, url string, html string, text string").limit(0)).count() == 0


@pytest.mark.parametrize(
    "html,text",
    [
        ('<body><nav>N</nav><main><div class="lead"><p>The lead of some length.</p></div><div class="body"><p>The body, longer than that, with more words in it to read.</p></div></main></body>', "The lead of some length. The body, longer than that, with more words in it to read."),
        ('<body><div class="x"><div class="lead"><p>The lead of some length.</p></div><div class="body"><p>The body, longer than that, with more words.</p></div></div><footer>F</footer></body>', "The lead of some length. The body, longer than that, with more words."),
        ('<body><svg width="1"/><p>After a drawing.</p><svg><title>t</title><text>no</text></svg></body>', "After a drawing."),
        ('<article><figure><img src="x"><figcaption>A caption.</figcaption></figure><p>Where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><fieldset><legend>Box</legend>Kept.</fieldset></article>', "A caption. Where x=1 holds. Box Kept."),
        ('<body><header>Site</header><article><header class="article-header"><h1>Head</h1></header><div class="market-share"><p>One.</p></div><div class="legal-history"><p>Two.</p></div><div class="search-results-text">Three.</div><div id="ad-hoc">Four.</div></article></body>', "Head One. Two. Three. Four."),
        ('<body><div class="site-header"><h1>Site</h1></div><div class="post"><div class="post-header"><h1>Head</h1></div><p>The text of the post.</p><div class="post-comments"><p>A reader says.</p></div><div class="ad-box-3">Buy.</div></div><div id="footerBar">F</div></body>', "Head The text of the post."),
        ('<body><form><p>Name</p><select><option>a</option></select></form><table><tr><td>One<td>Two</table><ul><li>Three<li>Four</ul><button>Go</button></body>', "One Two Three Four"),
        ("<p>open &lt; &nbsp; \n text<script>never closed <p>no", "open < text"),
        ("<p data-x=it's>Hello all</p><p>Don't go</p>", "Hello all Don't go"),
        ('<article><p>The text.</p><div class="user-comments">A</div><div class="comment-thread">B</div><div class="cookiebanner">C</div><div class="advertisement-wide">D</div><div class="related">More.</div><div id="share">Share of all.</div></article>', "The text. More. Share of all."),
        ('<div data-id="nav" title="a > b">Kept <b>b</p>c</b> 1 < 2 <3 </ x> d</div><![CDATA[&amp;', "Kept b c 1 < 2 <3 d &amp;"),
        ('<p>a<span hidden>no<b>no</span>b</b>c', "a bc"),
        ('<div class="cookie-notice">We use cookies.</div><p hidden>no</p><p style="display: none">no</p>', ""),
    ],
)
def test_text_of_one_page(html, text):
    assert html_text.extracted(html, []) == text


@pytest.mark.parametrize("html", ["".join(f"<div><p>part {i}</p>" for i in range(3000)), "<a href='x " * 90_000, '<a href="x ' * 90_000, "<" * 1_000_000, "<div>" * 3000 + "</span></p></b>" * 60_000, "<b>" * 20_000 + "x" + "</i>" * 20_000, "<div><b>" * 3000 + "</b>" * 30_000, "<!--" * 200_000, "<div " + "=" * 500_000])
def test_hostile_pages_take_linear_time(html):
    began = time.time()
    html_text.extracted(html, [])
    assert time.time() - began < 10  # all at once they took hours when depth or quotes cost their square


def test_a_winner_is_weighed_against_the_page(spark):
    article = "<article><p>" + "word " * 180 + "</p></article>"
    assert html_text.extracted(f'<div class="teaser"><p>Teaser small.</p></div>{article}', ["body div.teaser"]) == ("word " * 180).strip()
    assert html_text.extracted('<div class="a"><p>one two three four</p></div><div class="b"><p>one two</p></div>', ["body div.a"]) == "one two three four"


def generated_page(r, kind):
    """(html, main text) of a page whose host lays out its pages in one of three ways."""
    words = lambda n: " ".join(r.choice(["river", "garden", "letter", "winter", "house", "number"]) for _ in range(n))
    made = []

    def block(tag, n, extra=""):
        t = words(n) + "."
        made.append(t)
        return f"<{tag}{extra}>{t.replace(' ', r.choice([' ', '  ', chr(10)]), 1)}</{tag}>"

    head = block("h1", 5)
    lead = block("p", r.randint(15, 25), ' class="intro"')
    rest = "".join(block(r.choice(["p", "p", "blockquote", "h2"]), r.randint(8, 60)) for _ in range(r.randint(3, 8)))
    items = "<ul>" + "".join(block("li", r.randint(3, 9)) for _ in range(r.randint(0, 4))) + "</ul>"
    aside = f'<{"aside" if r.random() < 0.5 else "div class=sidebar"}><p>{words(30)}</p>'
    aside += "</aside>" if aside.startswith("<aside") else "</div>"
    junk = [f"<nav><a href=/>{words(3)}</a></nav>", f'<div class="ad-{r.randint(1, 9)}"><p>{words(9)}</p></div>', f'<div id="cookie-notice">{words(12)}</div>', aside, f"<form><label>{words(4)}</label></form>"]
    r.shuffle(junk)
    inner = {0: f"<article>{head}{lead}{rest}{items}</article>", 1: f'<div class="post p{r.randint(1, 99)}"><div class="post-header">{head}</div><div class="lead">{lead}</div><div class="body">{rest}{items}</div></div>', 2: f"<main><section>{head}{lead}</section><section>{rest}{items}</section></main>"}[kind]
    html = f'<html><head><title>{words(4)}</title></head><body><header>{words(4)}</header>{"".join(junk[:3])}<div class="wrap">{inner}{junk[3]}</div>{junk[4]}<section class="comments"><p>{words(r.randint(5, 200))}</p></section><footer>{words(8)}</footer></body></html>'
    return html, " ".join(made)


def test_generated_pages(spark):
    """Against the text that a page was made from."""
    r = random.Random(12)
    pages = [(i, f"http://host{i % 7}.example/{i}", *generated_page(r, i % 7 % 3)) for i in range(210)]
    got = {x.page_id: x.text for x in html_text.extract(spark.createDataFrame([p[:3] for p in pages], "page_id bigint, url string, html string").repartition(5)).collect()}
    assert all(got[i] == text for i, _, _, text in pages)


def test_votes_and_very_long_pages(spark):
    """Equal votes go by path; a host without a path that has a fifth of its votes leaves each page its own."""
    page = '<div class="{0}"><p>text of {0}</p></div>'
    rows = [(0, "http://a/", page.format("x")), (1, "http://a/", page.format("y")), (2, "http://a/", page.format("y") + '<div class="x"><p>longer text of the other, which is the page\'s own vote by far</p></div>')]
    rows += [(10 + i, "http://b/", page.format("abcdefghijkl"[i])) for i in range(12)]
    rows += [(100, "http://c/", "<article>" + "<p>word word</p>" * 100_000 + "</article>"), (101, "http://c/", "<div>" * 3000 + "deep")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[0] == "text of x" and got[1] == "text of y" and all(got[10 + i] == f"text of {'abcdefghijkl'[i]}" for i in range(12))
    assert got[100] == " ".join(["word word"] * 100_000) and got[101] == "deep"
    paths = {r.host: r.winners for r in html_text.host_paths(spark.createDataFrame([(0, "http://a/", page.format("x")), (1, "http://a/", page.format("y"))], "page_id bigint, url string, html string")).collect()}
    assert paths == {"a": ["body div.x", "body div.y"]}


# 9: decontamination
def test_leaks(spark):
    q = "A train leaves Boston at 9 km per hour and reaches, with Alice Smith aboard, the town of Salem after 45 minutes while Alice sleeps."
    new = q.replace("Boston", "Lyon").replace("Alice", "Marie").replace("9", "14").replace("45", "50")
    bad = q.replace("while Alice", "while, as, Bob")
    r = random.Random(5)
    filler = lambda n: " ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(n))
    rows = [(1, filler(50) + " " + q + " " + filler(20), 0), (2, filler(9) + " " + new, 0), (3, filler(400), 0), (4, None, 0), (5, "", 0), (6, q.lower().replace(",", ""), 0), (7, " ".join(q.split()[:8]) + " " + filler(30), 0), (None, q, 0), (8, "Short one.", 0), (9, "short  ONE", 0), (10, "a short one here", 0), (1, filler(3), 0)]
    rows += [(11, "9 9 9 9 9 9 9 9 9 9 9 9 9", 0)]
    bench = spark.createDataFrame([(0, q, 1), (1, None, 1), (2, "", 1), (3, "Short one", 1), (4, "1 2 3 4 5 6 7 8 9 10 11", 1), (None, q, 1)], "item_id bigint, text string, doc_id int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int").repartition(3)
    got = {(x.doc_id, x.item_id, x.verbatim) for x in decontamination.leaks(docs, bench).collect()}
    assert got == {(1, 0, True), (2, 0, False), (6, 0, True), (None, 0, True), (8, 3, True), (9, 3, True), (10, 3, True)}, got
    kept = {(r.doc_id, r.text) for r in decontamination.clean(docs, bench).collect()}
    assert {k[0] for k in kept} == {1, 3, 4, 5, 7, 11} and bad
    assert decontamination.leaks(docs.limit(0), bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_case_and_white_space_aside(spark):
    q = "A train leaves Boston at 9 km per hour and reaches, with Alice Smith aboard, the town of Salem after 45 minutes while Alice sleeps."
    new = q.replace("Boston", "Lyon").replace("Alice", "Marie")
    copies = [q, q.lower().replace(",", ""), q.upper(), q.title(), q.replace(" ", "\n"), q.replace(" ", " \u00a0 "), new.replace(" ", "  "), q.lower().replace("45", "50"), q.replace("9 km", "9KM")]
    other = ["while marie sleeps and waits for the next train to the town", q.lower().replace("9", "8").replace("45 minutes", "x y z").replace("salem after", "one two").replace("reaches", "a b c d e f")]
    rows = [(i, "filler words come first " + t + " and more of them") for i, t in enumerate(copies)] + [(100 + i, t) for i, t in enumerate(other)]
    rows += [(200, "it was anna bert clara dora emil fritz greta hans ida who came")]
    bench = spark.createDataFrame([(0, q), (1, ": Anna Bert Clara Dora Emil Fritz Greta Hans Ida")], "item_id bigint, text string")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {(x.doc_id, x.item_id): x.verbatim for x in decontamination.leaks(docs, bench).collect()}
    assert got == {**{(i, 0): i not in (6, 7) for i in range(9)}, (200, 1): True}, got
    assert {r.doc_id for r in decontamination.clean(docs, bench).collect()} == {100, 101}


def test_leaks_of_short_items_and_numbers(spark):
    rows = [(1, "a short one here"), (2, "Short one."), (3, "so the code is 3 14 15 92 65 35 89 79 32 and no other"), (4, "3 14 15 92 65 35 89 79 33"), (5, "9 9 9 9 9 9 9 9 9 9 9"), (6, "he wrote 31 41 on it"), (7, "he wrote 31 42 on it"), (8, "one short"), (9, "and What is 7\nplus 8?")]
    items = [(3, "Short one"), (4, "3 14 15 92 65 35 89 79 32"), (5, "31 41"), (6, "what is 5 plus 6"), (7, ""), (8, None), (9, "...")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {(x.doc_id, x.item_id, x.verbatim) for x in decontamination.leaks(docs, bench).collect()}
    assert got == {(1, 3, True), (2, 3, True), (3, 4, True), (4, 4, False), (6, 5, True), (9, 6, False)}, got  # row 4 holds half of the item's windows
    assert decontamination.leaks(docs.limit(0), bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0


def template(text):
    """(kind, value) of each token of a plain ASCII text: # a number, ~ a unit behind one, @ a name."""
    import re

    out = []
    for m in re.finditer(r"[A-Za-z]+|[0-9]+", text):
        word, before = m.group(), text[: m.start()]
        if word.isdigit():
            out.append(("#", word))
        elif word[0].isupper() and len(word) > 1 and re.search(r"[A-Za-z0-9,;:] $", before):
            out.append(("@", word.lower()))
        elif out and out[-1][0] == "#" and re.search(r"[0-9] ?$", before) and word.lower() in ("km", "kg", "hours"):
            out.append(("~", word.lower()))
        else:
            out.append((word.lower(), word.lower()))
    return out


def brute_leaks(docs, items):
    """Every document against every item, window by window."""
    slots, out = ("#", "@", "~"), set()
    typed = lambda t: tuple(k for k, _ in t)
    folded = lambda t: tuple(v if k == "@" else k for k, v in t)
    word = lambda keys: any(k not in slots for k in keys)
    for item_id, text in items:
        item = template(text)
        if not item:
            continue
        n = min(8, len(item))
        mine = {i: item[i : i + n] for i in range(len(item) - n + 1)}
        if any(word(typed(w)) for w in mine.values()):
            keys = {i: {typed(w), folded(w)} for i, w in mine.items() if word(typed(w))}
        elif any(word(folded(w)) for w in mine.values()):
            keys = {i: {folded(w)} for i, w in mine.items() if word(folded(w))}
        else:
            keys = {i: {("values", *(v for _, v in w))} for i, w in mine.items()}
        for doc_id, other in docs:
            doc = template(other)
            at = {}
            for pos in range(len(doc) - n + 1):
                w = doc[pos : pos + n]
                theirs = {typed(w), folded(w)} | ({("values", *(v for _, v in w))} if set(folded(w)) <= {"#", "~"} else set())
                for i in keys:
                    if keys[i] & theirs:
                        at.setdefault(pos - i, set()).add(i)
            found, verbatim = set(), False
            for shift, places in at.items():
                covered = sorted({j for i in places for j in range(i, i + n)})
                pairs = {(item[j][1], doc[j + shift][1]) for j in covered if item[j][0] in slots}
                if len({a for a, _ in pairs}) == len(pairs):
                    found |= places
                    verbatim |= [v for _, v in item] == [v for _, v in doc[shift : shift + len(item)]] if shift >= 0 else False
            if found and 2 * len(found) >= len(keys):
                out.add((doc_id, item_id, len(keys), len(found), verbatim))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_leaks_are_those_of_brute_force(spark, seed):
    r = random.Random(seed)
    names, units = ["Anna", "Boris", "Lyon", "Salem"], ["km", "kg", "hours"]

    def tokens(n):
        out = []
        for _ in range(n):
            x = r.random()
            out += [r.choice(names)] if x < 0.15 else [str(r.randint(1, 40))] if x < 0.25 else [str(r.randint(1, 40)), r.choice(units)] if x < 0.35 else [r.choice(["the", "train", "goes", "to", "and", "waits", "there,", "so"])]
        return out

    def changed(words):
        to = {w: r.choice([w, r.choice(names) if w in names else str(r.randint(1, 40))]) for w in set(words) if w in names or w.isdigit()}
        words = [(to[w] if r.random() < 0.97 else r.choice(names)) if w in to else w for w in words]
        x = r.random()
        if x < 0.2:
            words = words[: max(1, round(len(words) * r.uniform(0.3, 1)))]
        elif x < 0.4:
            words.insert(r.randrange(len(words) + 1), "so")
        return [w.lower() for w in words] if r.random() < 0.2 else words

    made = [tokens(r.choice([2, 4, 7, 9, 15, 30])) for _ in range(12)] + [["3", "14", "15"], [str(i) for i in range(12)], ["So", *names, *names, "Anna", "Salem"]]
    docs = [(i, " ".join([*tokens(r.randint(0, 12)), *changed(r.choice(made)), *tokens(r.randint(0, 12))])) for i in range(120)]
    docs += [(500 + i, " ".join(x)) for i, x in enumerate(made)]
    items = [(i, " ".join(x)) for i, x in enumerate(made)]
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = brute_leaks(docs, items)
    assert {(x.doc_id, x.item_id, x.n_windows, round(x.coverage * x.n_windows), x.verbatim) for x in got} == want
    assert len(got) == len(want) > 20 and {x.verbatim for x in got} == {True, False}


# 2: lines
def test_patience_is_a_common_subsequence():
    r = random.Random(6)
    for _ in range(300):
        a = [r.choice("abcdefghij") for _ in range(r.randint(0, 15))]
        b = [r.choice("abcdefghij") for _ in range(r.randint(0, 15))]
        got = line_dedup.patience(a, b)
        assert got == diff(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert len(line_dedup.patience(list("abcdef"), list("xabcyef"))) == 5


def longest_run(pairs):
    """The longest increasing run by quadratic search; of several, the one that ends last, and so on back."""
    length = []
    for k, (_, j) in enumerate(pairs):
        length.append(1 + max((length[x] for x in range(k) if pairs[x][1] < j), default=0))
    out, want, before = [], max(length), len(pairs)
    while want:
        before = max(k for k in range(before) if length[k] == want)
        out.append(pairs[before])
        want -= 1
    return out[::-1]


def diff(a, b, i=0, j=0):
    """Pairs of places that patience diff aligns in a and b, which start at i and j."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(i, j), *diff(a[1:], b[1:], i + 1, j + 1)]
    if a[-1] == b[-1]:
        return [*diff(a[:-1], b[:-1], i, j), (i + len(a) - 1, j + len(b) - 1)]
    once = [(x, b.index(line)) for x, line in enumerate(a) if a.count(line) == 1 == b.count(line)]
    if not once:
        return []
    run = longest_run(once)
    x, y = run[0]
    out = diff(a[:x], b[:y], i, j)
    for (x, y), (u, v) in zip(run, [*run[1:], (len(a), len(b))]):
        out += diff(a[x:u], b[y:v], i + x, j + y)
    return out


def common_blocks(a, b):
    """Places of b's lines in blocks of 25 characters that a has too, by comparing every two places."""
    gone = set()
    for j in range(len(b)):
        for i in range(len(a)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if sum(len(x.strip()) for x in b[j : j + n]) >= 25:
                gone |= set(range(j, j + n))
    return gone


def brute_lines(rows):
    """Every document against all earlier ones, however many hold a line."""
    import hashlib

    import xxhash

    key = lambda i, t: (line_dedup.LAST_ID if i is None else i, (xxhash.xxh64_intdigest(t, 42) + (1 << 63)) % (1 << 64)) if t else None
    docs = sorted({(key(i, t), t) for i, t in rows if t})
    first = {}
    for _, t in docs:
        lines = t.split("\n")
        for lo, hi in line_dedup.runs([len(x.strip()) for x in lines]):
            first.setdefault(tuple(lines[lo:hi]), t)
    out = []
    for i, t in rows:
        lines = t.split("\n") if t else []
        earlier = {other for k, other in docs if t and k < key(i, t)}
        found = set().union(*(common_blocks(x.split("\n"), lines) for x in earlier))
        full = [j for j, x in enumerate(lines) if x.strip()]
        gone = {j for j in full if j in found}
        for x, y in zip(full, full[1:]):
            if {x, y} <= gone:
                gone |= set(range(x, y))
        partners = {first[tuple(lines[lo:hi])] for lo, hi in line_dedup.runs([len(x.strip()) for x in lines])} & (earlier - {t})
        if t in earlier:
            long = sum(len(x.strip()) for x in lines) >= 25
            gone, partners = (set(range(len(lines))), {t}) if long else (set(), set())
        kept = "\n".join(x for j, x in enumerate(lines) if j not in gone)
        out.append((i, len(lines), len(gone), len(partners), hashlib.md5(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_lines_in_blocks_of_either_order(seed):
    r = random.Random(seed)
    code = lambda lines: [zlib.crc32(x.encode()) for x in lines]
    size = lambda lines: [len(x.strip()) for x in lines]
    words = ["", " ", "x", "nine char", "twelve chars", "a line of twenty-five and more", "another long line, as long as that"]
    for _ in range(300):
        a, b = ([r.choice(words) for _ in range(r.randint(0, 14))] for _ in range(2))
        got = line_dedup.with_blanks(b, set(line_dedup.shared_lines(code(a), size(a), code(b), size(b))))
        assert {i for i in got if b[i].strip()} == {i for i in common_blocks(a, b) if b[i].strip()}
        diffed = {i for lo, hi in line_dedup.blocks(code(a), code(b), size(b)) for i in range(lo, hi) if b[i].strip()}
        assert diffed <= got


@pytest.mark.parametrize("n", [20, 120])
def test_lines_go_at_any_number_of_holders(spark, n):
    x, us = "the one line x that is long enough", [f"line u{k} which is long enough too" for k in range(1, 7)]
    rows = [(i, "\n".join([x, *us, f"own line {i} of this document here"])) for i in range(n)]
    rows += [(5000, x + "\nown line of 5000"), (6000, "\n".join([*us, x, "own line of 6000"])), (7000, "\n".join([us[0], "?", us[0], "", x, " ", x, ""]))]
    got = {r.doc_id: r.n_deleted for r in line_dedup.remove_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0: 0} | dict.fromkeys(range(1, n), 7) | {5000: 1, 6000: 7, 7000: 6}


@pytest.mark.parametrize("seed", range(3))
def test_hot_lines_are_those_of_brute_force(spark, seed):
    r = random.Random(seed)
    hot = ["a frequent line that is long enough", "short hot", "another short", "a second frequent line of text", "", "third short"]
    rows = [(i, "\n".join(r.choice([*hot, f"line {r.randrange(40)} which some documents hold"]) for _ in range(r.randint(1, 9)))) for i in range(220)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted((tuple(x) for x in line_dedup.remove_lines(df).collect()), key=str) == brute_lines(rows)


def test_line_dedup(spark):
    r = random.Random(7)
    line = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(r.randint(1, 6)))
    rows = [(i, "\n".join(line() for _ in range(r.randint(1, 12)))) for i in range(60)]
    block = [line() + str(k) for k in range(5)]
    rows += [(100 + i, "\n".join([line(), *block[: r.randint(1, 5)], "", line()])) for i in range(30)]
    rows += [(150 + i, "\n".join(r.sample(block, 4))) for i in range(10)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (None, "\n".join(block)), (None, "\n".join(block[1:])), (303, rows[0][1]), (303, rows[0][1]), (303, rows[1][1] + "\n" + block[2]), (304, "short"), (305, "short")]
    rows += [(400, "\n".join(f"a line of its own, number {i}" for i in range(300))), (401, "\n".join(f"a line of its own, number {i}" for i in range(1, 300)))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, k int, n_lines string").repartition(3)
    assert sorted((tuple(x) for x in line_dedup.remove_lines(df).collect()), key=str) == brute_lines(rows)
    assert line_dedup.remove_lines(df.limit(0)).count() == 0


def test_very_long_texts_of_lines(spark):
    long = "\n".join(f"line {i} of a very long text {i * i}" for i in range(60_000))
    got = {r.doc_id: (r.n_lines, r.n_deleted) for r in line_dedup.remove_lines(spark.createDataFrame([(1, long), (2, "x" * 2_000_000), (3, "first\n" + long)], "doc_id bigint, text string")).collect()}
    assert got == {1: (60_000, 0), 2: (1, 0), 3: (60_001, 60_000)}


def test_lines_of_large_groups(spark):
    long = "a passage of one line that is long enough to go"
    rows = [(i, f"own {i}\n{long}\nown too {i}") for i in range(80)] + [(200 + i, "a short text\nof two lines of it") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.n_deleted for r in line_dedup.remove_lines(df).collect()}
    assert got == {i: (0 if i in (0, 200) else 1 if i < 200 else 2) for i, _ in rows}


def test_runs_cover_every_block():
    r = random.Random(8)
    for _ in range(300):
        lines = ["x" * r.choice([0, 1, 3, 8, 15, 20, 30]) for _ in range(r.randint(1, 9))]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if lines[a] and lines[b - 1] and sum(map(len, lines[a:b])) >= line_dedup.MIN_CHARS:
                    inside = [x for x in line_dedup.runs([len(x) for x in lines]) if a <= x[0] and x[1] <= b]
                    assert all(any(lo <= i < hi for lo, hi in inside) for i in range(a, b) if lines[i])


def test_block_of_later_holders(spark):
    block = ["red apples", "green pears", "blue plums"]
    rows = [(1, f"{block[0]}\nx1"), (2, f"y2\n{block[1]}"), (3, f"z3\n{block[2]}\nw3"), (4, "\n".join(["p4", *block, "q4"])), (5, "\n".join(["r5", *block, "s5"]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.n_deleted for r in line_dedup.remove_lines(df).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 3}
