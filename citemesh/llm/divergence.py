"""Source divergence audit: how far apart the sources of a language are, and which terms make a source special.

Each task counts terms by group (a language's source) and hands on what it has whenever its tables pass
a bound. A language's vocabulary is dealt into strips of some STRIP terms by hash, and a group's counts of
CHUNK terms are packed into one vector. Groups of a language stand in blocks of BLOCK. Every vector is
copied to each tile of two blocks that its own block belongs to; the task of a tile and a strip holds its
two blocks' rates of one chunk at a time and adds up the tile's submatrix chunk after chunk. Terms that
neither block has are added by their number. Sums over strips make the matrix, so that work on a large
language is spread by blocks and strips, and a task's memory is bounded by 2 * BLOCK * CHUNK counts.

All arithmetic is on 64-bit integers: a rate is a long division in three steps of a thousand, exact while
a language has less than 9e15 tokens.

Edge cases: null text, lang and source count as ''. A row is a document, repeated rows too, whatever its
id. Sources without terms are groups with counts of 0. A language with no kept term gives pairs of value 0
and no terms; one with a single source gives no pairs. Equal values are ranked by the item's UTF-8 bytes.
Extra columns are not read, so their names don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import column_slices, cut, drop, join_hot
from ._terms import LETTERS, pieces, texts_of

#: Documents of a language that a kept term is in, at least.
LEAST = 3
#: Terms listed for a group.
TERMS = 200
#: What one is counted as.
SCALE = 1_000_000_000
#: Terms in a strip (on average) and in a chunk, and groups in a block.
STRIP, CHUNK, BLOCK = 1 << 14, 1 << 12, 64
#: Entries of a task's tables of counts before they are handed on.
TABLE = 400_000


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, tf, df) of docs(lang, source, text): occurrences, and documents that hold the
    term. A row with an empty term stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tf: dict[tuple, Counter] = {}
        df: dict[tuple, Counter] = {}
        held = 0

        def rows() -> pa.RecordBatch:
            groups, sizes, terms, n, d = [], [], [], [], []
            for g, c in tf.items():
                groups.append(g)
                sizes.append(len(c) + 1)
                terms += [b"", *c]
                n += [0, *c.values()]
                own = df[g]
                d += [0, *(own[t] for t in c)]
            at = pa.array(np.repeat(np.arange(len(groups)), sizes))
            names = [pa.array([g[i] for g in groups], pa.string()).take(at) for i in range(2)]
            return pa.RecordBatch.from_arrays([*names, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "tf", "df"])

        for b in batches:
            for lo, hi in column_slices(b.column(2)):
                part = b.slice(lo, hi - lo)
                for lang, source, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts_of(part.column(2)), strict=True):
                    g = lang, source
                    if g not in tf:
                        tf[g], df[g] = Counter(), Counter()
                    n, d, seen = tf[g], df[g], set()
                    held -= len(n)
                    for words in pieces(data, LETTERS):
                        n.update(words)
                        seen.update(words)
                    d.update(seen)
                    held += len(n)
                    if held >= TABLE:
                        yield rows()
                        tf.clear()
                        df.clear()
                        held = 0
        if tf:
            yield rows()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, tf bigint, df bigint")


def rate(count: str, n: str, v: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (n + v)), by long division."""
    total, rest, out = F.col(n) + F.col(v), F.col(count) + 1, F.lit(1).cast("bigint")
    for unit in (1_000_000, 1_000, 1):
        out = out + F.call_function("div", rest * 1000, total) * unit
        rest = (rest * 1000) % total
    return out


def rates(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """rate() of arrays; total is n + v."""
    out, rest = np.ones(np.broadcast_shapes(count.shape, total.shape), np.int64), count + 1
    for unit in (1_000_000, 1_000, 1):
        q, rest = np.divmod(rest * 1000, total)
        out += q * unit
    return out


def tiles(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value) of rows(lang, strip, bi, bj, chunk, gid, total, v, counts): for each tile the
    sums over one strip of f between all its groups, both ways. Rows of chunk -1 name the tile's groups,
    their n + v, and the number of the strip's terms."""

    def add(out: np.ndarray, p: np.ndarray, na: int, same: bool, times: np.ndarray | int = 1) -> None:
        """p: a row for each group, those of the first block first."""
        second = p if same else p[na:]
        for i in range(len(p) if same else na):
            square = (p[i] - second) ** 2
            out[i, 0 if same else na :] += (square // second).sum(axis=1) * times
            if not same:
                out[na:, i] += (square // p[i]).sum(axis=1) * times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, groups, total, v, out, seen, now, held = None, [], [], 0, None, 0, -1, []

        def open_matrix() -> None:
            """All groups of the tile are known."""
            nonlocal out, na, place
            if out is None:
                place, na = {g: i for i, g in enumerate(groups)}, sum(g // BLOCK == key[2] for g in groups)
                out = np.zeros((len(groups), len(groups)), np.int64)

        def chunk() -> None:
            """The chunk that has been read."""
            nonlocal seen
            if not held:
                return
            at, column = np.unique(np.concatenate([p for _, p, _ in held]), return_inverse=True)
            count, lo = np.zeros((len(groups), len(at)), np.int64), 0
            for g, p, c in held:
                count[place[g], column[lo : lo + len(p)]] = c
                lo += len(p)
            add(out, rates(count, np.array(total)[:, None]), na, key[2] == key[3])
            seen += len(at)
            held.clear()

        def done() -> pa.RecordBatch:
            open_matrix()
            chunk()
            same = key[2] == key[3]
            if v > seen:  # neither block has these
                add(out, rates(np.zeros((len(groups), 1), np.int64), np.array(total)[:, None]), na, same, v - seen)
            ok = ~np.eye(len(groups), dtype=bool)
            if not same:  # pairs within a block are another tile's work
                ok[:na, :na] = ok[na:, na:] = False
            a, b = np.nonzero(ok)
            ids = np.array(groups)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(a), pa.string()), pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64()), pa.array(out[a, b], pa.int64())], ["lang", "a", "b", "value"])

        na, place = 0, {}
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            lists = batch.column(8)
            flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            pos, tf = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            for i, (lang, strip, bi, bj, c, gid, t, n) in enumerate(zip(*columns, strict=True)):
                if (lang, strip, bi, bj) != key:
                    if key is not None:
                        yield done()
                    key, groups, total, v, out, seen, now = (lang, strip, bi, bj), [], [], n, None, 0, -1
                if c < 0:
                    groups.append(gid)
                    total.append(t)
                    continue
                open_matrix()
                if c != now:
                    chunk()
                    now = c
                held.append((gid, np.array(pos[ends[i] : ends[i + 1]]), np.array(tf[ends[i] : ends[i + 1]])))
        if key is not None:
            yield done()

    rows = rows.select("lang", "strip", "bi", "bj", "chunk", "gid", "total", "v", "counts")
    rows = rows.repartition("lang", "strip", "bi", "bj").sortWithinPartitions("lang", "strip", "bi", "bj", "chunk", "gid")
    return rows.mapInArrow(run, "lang string, a bigint, b bigint, value bigint")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): of each source its distance to each other source of the
    language (part pair, every rank) and the terms it has above the language's rate (part term)."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counted = cut(term_counts(named).groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")))
    vocabulary = cut(counted.filter("term <> ''").groupBy("lang", "term").agg(F.sum("df").alias("d"), F.sum("tf").alias("n")).filter(F.col("d") >= least).drop("d"))
    sources = counted.filter("term = ''").select("lang", "source")
    sized = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n_lang"))
    langs = sources.groupBy("lang").agg(F.count("*").alias("groups")).join(sized, "lang", "left").na.fill(0, ["v", "n_lang"])
    langs = cut(langs.withColumns({"strips": F.greatest(F.lit(1), F.ceil(F.col("v") / STRIP)).cast("int"), "blocks": F.ceil(F.col("groups") / BLOCK).cast("int")}))
    # terms by strip and place in it
    dealt = join_hot(vocabulary, langs.select("lang", "strips"), ["lang"]).withColumn("strip", F.pmod(F.xxhash64("term"), F.col("strips")).cast("int"))
    placed = cut(dealt.select("lang", "term", F.col("n").alias("n_term"), "strip", (F.row_number().over(Window.partitionBy("lang", "strip").orderBy("term")) - 1).alias("pos")))
    kept = cut(counted.filter("term <> ''").drop("df").join(placed, ["lang", "term"]))
    sums = kept.groupBy("lang", "source").agg(F.sum("tf").alias("n"))
    groups = sources.withColumn("gid", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint") - 1)
    groups = cut(groups.join(sums, ["lang", "source"], "left").na.fill(0, ["n"]).join(langs, "lang"))
    # every tile of two blocks: its groups, then its vectors
    tile = [F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj")]
    block = F.floor(F.col("gid") / BLOCK).cast("int").alias("own")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    in_strip = placed.groupBy("lang", "strip").agg(F.count("*").alias("v_strip"))
    heads = groups.select("*", block, F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip")).join(in_strip, ["lang", "strip"], "left").select("*", others)
    packed = join_hot(kept, groups.select("lang", "source", "gid", "blocks"), ["lang", "source"])
    chunk = F.floor(F.col("pos") / CHUNK).cast("int")
    packed = packed.groupBy("lang", "strip", "gid", "blocks", chunk.alias("chunk")).agg(F.collect_list(F.struct("pos", "tf")).alias("counts"))
    empty = F.array().cast("array<struct<pos:int,tf:bigint>>")
    nothing = F.lit(0).cast("bigint")
    rows = heads.select("lang", "strip", *tile, F.lit(-1).alias("chunk"), "gid", (F.col("n") + F.col("v")).alias("total"), F.coalesce("v_strip", nothing).alias("v"), empty.alias("counts"))
    rows = rows.union(packed.select("*", block, others).select("lang", "strip", *tile, "chunk", "gid", nothing, nothing, "counts"))
    values = cut(tiles(rows).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    name = lambda end, to: groups.select("lang", F.col("gid").alias(end), F.col("source").alias(to))
    pairs = values.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(own))
    # a task keeps the first ranks of what it has before groups are brought together
    special = join_hot(kept, groups.select("lang", "source", "n", "v", "n_lang"), ["lang", "source"])
    special = special.withColumns({"p": rate("tf", "n", "v"), "q": rate("n_term", "n_lang", "v")}).filter("p > q")
    special = special.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    special = special.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= terms)
    out = cut(pairs.select(columns).union(special.select(columns)))
    drop(counted, vocabulary, langs, placed, kept, groups, values)
    return out


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n_term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n_term) AS n_lang FROM k GROUP BY lang),
g AS (SELECT e.lang, e.source, coalesce(s.n, 0) AS n_group FROM (SELECT DISTINCT lang, source FROM d) e LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s ON s.lang = e.lang AND s.source = e.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n_group + l.v) AS p, 1 + ({SCALE}::HUGEINT * (k.n_term + 1)) // (l.n_lang + l.v) AS q
      FROM g JOIN l ON l.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= {TERMS}
"""
