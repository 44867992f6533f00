"""Ranked lexical search: the best documents for each item, over inverted treaps.

A search counts the words of every document and keeps its postings of the items' terms. Documents are dealt
to blocks of some POSTINGS postings; a block's task makes a treap of each term's postings: a search tree by
the document's place in the order of ids, a heap by the score that the posting adds (of equal ones, a random
one is higher). A node's score is therefore the most that any document below it gets from that term.

An item's terms are traversed together: an interval of documents, with each term's highest node in it, goes
on only if the sum of these maxima can still enter the item's k best so far. If it does, the document of the
node that adds most is scored, and the interval falls into those before and after it, for which each treap is
descended to its highest node there. Intervals of LEAF documents at most are scored whole. All intervals of a
depth, of several items at a time, are one step on arrays. Blocks return their k best for each item, and the
best of these are the result: a document that is not among its block's k best is not among all documents'.

Items' terms go to the tasks, TERM_BYTES of items at a time; more items take more passes over documents.

Edge cases: null texts have no terms; such items find nothing, such documents are not counted. Items of
one id (or of none) are one item with the terms of all. A row is a document, whatever its id; of equal scores the
smaller id comes first, no id last, and rows of one id in any fixed order. Extra columns are not read, so
their names don't matter; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import column_slices, cut, drop, partitions
from ._terms import LETTERS_DIGITS, pieces, texts_of

BEST = 50
#: Postings of a block, at most on average, and below which blocks aren't made smaller for more tasks.
POSTINGS, FEW_POSTINGS = 1 << 20, 1 << 16
#: Bytes of the terms of items that are searched in one pass.
TERM_BYTES = 8 << 20
#: Documents of an interval that are scored without going on.
LEAF = 16
#: Documents of a block times items that are traversed at a time.
AT_ONCE = 1 << 18


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), distinct, of items(item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in column_slices(b.column(1)):
                part = b.slice(lo, hi - lo)
                own = [set().union(*pieces(t, LETTERS_DIGITS)) if t else set() for t in texts_of(part.column(1))]
                at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array([t for x in own for t in x], pa.binary()).cast(pa.string())], ["item_id", "term"])

    return items.select("item_id", "text").mapInArrow(run, "item_id bigint, term string").distinct()


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, r, n, tids, tfs) of docs(doc_id, text) with terms: their number, and which of `terms` (by
    place) they hold how often. r tells rows of one id apart once the table is written."""
    number = {t.encode(): i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = 0
        for b in batches:
            for lo, hi in column_slices(b.column(1), most=1 << 19):
                ids, n, key = b.column(0).slice(lo, hi - lo), np.zeros(hi - lo, np.int64), []
                for i, data in enumerate(texts_of(b.column(1).slice(lo, hi - lo))):
                    for words in pieces(data, LETTERS_DIGITS) if data else ():
                        n[i] += len(words)
                        found = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                        key.append(found[found >= 0] + i * len(terms))
                key, tf = np.unique(np.concatenate(key) if key else np.empty(0, np.int64), return_counts=True)
                doc, tid = np.divmod(key, max(1, len(terms)))
                ends = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (tid, tf)]
                rows = pa.RecordBatch.from_arrays([ids, pa.array(np.arange(r, r + hi - lo)), pa.array(n), *lists], ["doc_id", "r", "n", "tids", "tfs"])
                r += hi - lo
                yield rows.filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, r bigint, n bigint, tids array<int>, tfs array<int>")


class Treaps:
    """The treaps of a block: postings by (term, document), each with what it adds per unit of weight, and
    its children (-1: none); roots by term."""

    def __init__(self, tid: np.ndarray, doc: np.ndarray, adds: np.ndarray, terms: int, docs: int):
        order = np.argsort(tid * np.int64(docs) + doc, kind="stable")
        self.docs, self.doc, self.adds = docs, doc[order].astype(np.int32), adds[order]
        self.key = tid[order] * np.int64(docs) + self.doc
        ends = np.searchsorted(self.key, np.arange(terms + 1, dtype=np.int64) * docs)
        self.left, self.right = np.full(len(doc), -1, np.int32), np.full(len(doc), -1, np.int32)
        self.root = self._build(ends[:-1], ends[1:])

    def _build(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The highest posting of each range, with all below it linked, depth by depth."""
        n = len(self.doc)
        chance = np.random.default_rng(1).integers(0, 1 << 14, n)
        high = [self.adds << 42 | chance << 28 | np.arange(n)]  # ranges' maxima by powers of two
        while 2 << len(high) - 1 <= int((hi - lo).max(initial=0)):
            h, half = high[-1], 1 << len(high) - 1
            high.append(np.maximum(h[:-half], h[half:]))

        def top(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            out, size = np.full(len(lo), -1, np.int64), hi - lo
            level = np.zeros(len(lo), np.int64)
            some = size > 0
            level[some] = np.frexp(size[some].astype(np.float64))[1] - 1
            for j in np.unique(level[some]).tolist():
                at = np.flatnonzero(some & (level == j))
                out[at] = np.maximum(high[j][lo[at]], high[j][hi[at] - (1 << j)]) & (1 << 28) - 1
            return out

        root = node = top(lo, hi)
        while len(node):
            some = node >= 0
            node, lo, hi = node[some], lo[some], hi[some]
            l, r = top(lo, node), top(node + 1, hi)
            self.left[node], self.right[node] = l, r
            lo, hi, node = np.concatenate([lo, node + 1]), np.concatenate([node, hi]), np.concatenate([l, r])
        return root

    def within(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Down from each node to the highest one with lo < document < hi; -1: none."""
        node = node.copy()
        at = np.arange(len(node))
        while len(at):
            doc = self.doc[node[at]]
            low, over = doc <= lo[at], doc >= hi[at]
            out = low | over
            at, low = at[out], low[out]
            node[at] = np.where(low, self.right[node[at]], self.left[node[at]])
            at = at[node[at] >= 0]
        return node


def best_of(items: np.ndarray, docs: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each item; of equal scores those of smaller docs."""
    order = np.lexsort((docs, -scores, items))
    own = items[order]
    first = np.searchsorted(own, own)
    return order[np.arange(len(own)) - first < k]


def search(treaps: Treaps, queries: list[np.ndarray], weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) of the k best documents of each query (an array of terms)."""
    t = np.concatenate([np.empty(0, np.int64), *queries])
    q = np.repeat(np.arange(len(queries)), [len(x) for x in queries])
    some = (treaps.root[t] >= 0) & (weight[t] > 0)
    t, q = t[some], q[some]
    # an interval: its query and ends, and cells: a term's node each, by interval
    query, cell_at = np.unique(q, return_inverse=True)
    lo, hi = np.full(len(query), -1, np.int64), np.full(len(query), treaps.docs, np.int64)
    term, node = t, treaps.root[t]
    least = np.ones(len(queries), np.int64)  # a score that is not beaten by k
    best = [np.empty(0, np.int64)] * 3

    def scored(query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        nonlocal best
        some = score >= least[query]
        best = [np.concatenate([a, b[some]]) for a, b in zip(best, (query, doc, score), strict=True)]
        keep = best_of(*best, k)
        best = [a[keep] for a in best]
        n = np.bincount(best[0], minlength=len(queries))
        last = np.cumsum(n)[n >= k] - 1
        least[n >= k] = best[2][last]

    while len(query):
        adds = treaps.adds[node] * weight[term]
        bound = np.zeros(len(query), np.int64)
        np.add.at(bound, cell_at, adds)
        on = bound >= least[query]
        leaf = on & (hi - lo <= LEAF + 1)
        if leaf.any():  # all documents of the interval, by its postings
            place = np.cumsum(leaf) - 1
            own = leaf[cell_at]
            at, base = place[cell_at[own]], term[own] * treaps.docs
            starts = np.searchsorted(treaps.key, base + lo[leaf][at] + 1)
            sizes = np.searchsorted(treaps.key, base + hi[leaf][at]) - starts
            post = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
            slot = np.repeat(at, sizes) * LEAF + treaps.doc[post] - np.repeat(lo[leaf][at] + 1, sizes)
            total = np.zeros(len(lo[leaf]) * LEAF, np.int64)
            np.add.at(total, slot, treaps.adds[post] * np.repeat(weight[term[own]], sizes))
            got = np.flatnonzero(total)
            scored(query[leaf][got // LEAF], lo[leaf][got // LEAF] + 1 + got % LEAF, total[got])
            on &= ~leaf
        own = on[cell_at]
        cell_at, term, node, adds = (np.cumsum(on) - 1)[cell_at[own]], term[own], node[own], adds[own]
        query, lo, hi = query[on], lo[on], hi[on]
        if not len(query):
            break
        # the document that some term adds most for, scored by all terms
        order = np.lexsort((-adds, cell_at))
        split = treaps.doc[node[order[np.searchsorted(cell_at[order], np.arange(len(query)))]]].astype(np.int64)
        want = term * treaps.docs + split[cell_at]
        at = np.minimum(np.searchsorted(treaps.key, want), len(treaps.key) - 1)
        total = np.zeros(len(query), np.int64)
        np.add.at(total, cell_at, np.where(treaps.key[at] == want, treaps.adds[at] * weight[term], 0))
        scored(query, split, total)
        sides = [treaps.within(node, lo[cell_at], split[cell_at]), treaps.within(node, split[cell_at], hi[cell_at])]
        node = np.concatenate(sides)
        cell_at, term = np.concatenate([cell_at, cell_at + len(query)]), np.concatenate([term, term])
        query, lo, hi = np.concatenate([query, query]), np.concatenate([lo, split]), np.concatenate([split, hi])
        some = node >= 0
        cell_at, term, node = cell_at[some], term[some], node[some]
        used, cell_at = np.unique(cell_at, return_inverse=True)
        query, lo, hi = query[used], lo[used], hi[used]
    return tuple(best)


def block_best(rows: DataFrame, ids: list, queries: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item_id, doc_id, r, score): the k best of each partition of rows for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        doc_id = pa.concat_arrays([b.column(0) for b in held])
        r = np.concatenate([b.column(1).to_numpy() for b in held])
        n = np.concatenate([b.column(2).to_numpy() for b in held])
        size = np.concatenate([b.column(3).value_lengths().to_numpy() for b in held])
        tid, tf = (np.concatenate([b.column(i).flatten().to_numpy() for b in held]).astype(np.int64) for i in (3, 4))
        m = 50 + 50 * n * n_docs // n_terms
        doc = np.repeat(np.arange(len(n)), size)
        treaps = Treaps(tid, doc, 1_000_000_000 * tf // (1000 * tf + 20 * m[doc]), len(weight), len(n))
        step = max(1, AT_ONCE // len(n))
        for at in range(0, len(queries), step):
            query, doc, score = search(treaps, queries[at : at + step], weight, k)
            yield pa.RecordBatch.from_arrays([pa.array([ids[at + i] for i in query.tolist()], pa.int64()), doc_id.take(pa.array(doc)), pa.array(r[doc]), pa.array(score)], ["item_id", "doc_id", "r", "score"])

    return rows.select("doc_id", "r", "n", "tids", "tfs").mapInArrow(run, "item_id bigint, doc_id bigint, r bigint, score bigint")


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = BEST, term_bytes: int = TERM_BYTES) -> DataFrame:
    """(item id, rank, doc id, score): the k documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    terms = cut(item_terms(items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text"))))
    passes = max(1, -(-(terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0) // term_bytes))
    found = None
    for p in range(passes):
        own = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p)
        words: dict[str, int] = {}
        wanted: dict[int | None, list[int]] = {}
        for item, term in own.collect():  # about term_bytes
            wanted.setdefault(item, []).append(words.setdefault(term, len(words)))
        if not words:
            continue
        index = cut(postings(docs, list(words)))
        n_docs, n_terms, n_postings = index.agg(F.count("*"), F.sum("n"), F.sum(F.size("tids"))).first()
        if n_postings:
            df = index.select(F.explode("tids").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
            weights = df.select("t", F.floor(1000 * F.ln((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("bigint"))
            weight = np.zeros(len(words), np.int64)
            for t, w in weights.collect():  # a row for each term of the items
                weight[t] = w
            blocks = max(-(-n_postings // POSTINGS), min(partitions(spark), -(-n_postings // FEW_POSTINGS)))
            block = F.pmod(F.xxhash64("doc_id", "r", "n"), F.lit(blocks)).cast("int")
            dealt = index.repartitionById(blocks, block).sortWithinPartitions(F.asc_nulls_last("doc_id"), "r", "n")
            ids = list(wanted)
            best = block_best(dealt, ids, [np.array(sorted(wanted[i]), np.int64) for i in ids], weight, n_docs, n_terms, k)
            by = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "r")
            best = cut(best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k))
            found = best if found is None else found.union(best)
        drop(index)
    drop(terms)
    if found is None:
        found = spark.createDataFrame([], "item_id bigint, doc_id bigint, r bigint, score bigint, rank int")
    return found.select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms_sql(table: str, key: str) -> str:
    return rf"SELECT {key}, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM {table}"


OP11_SQL = f"""
WITH t AS ({_terms_sql("documents", "doc_id")}),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
a AS (SELECT count(*) AS n_all, sum(n)::BIGINT AS l_all FROM n),
m AS (SELECT doc_id, 50 + (50 * n * n_all) // l_all AS m FROM n, a),
w AS (SELECT term, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), a),
i AS (SELECT DISTINCT item_id, term FROM ({_terms_sql("benchmark", "item_id")})),
s AS (SELECT item_id, f.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM i JOIN f USING (term) JOIN w USING (term) JOIN m ON m.doc_id = f.doc_id GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {BEST}
"""
