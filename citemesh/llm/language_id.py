"""Language identification by unigram pieces, summed over all segmentations.

Over a fixed public vocabulary each language has piece probabilities. A word's probability is the sum
over all its segmentations (forward algorithm); a text's is the product over its words (maximal runs of
letters, lower-cased, led by the word mark). The probabilities come from expectation maximisation on
word counts: expected uses of each piece from forward and backward sums.

Learning reads a bounded sample of the learnable rows: at most about `per_language` rows of each lang value,
chosen by a hash of text. Every value is learned, however many there are: the model, which the driver and each
Python worker hold, grows with them (8 bytes a piece and language, 16 MB for 64 languages), and words are
scored and remembered in so much smaller portions. Whole texts are learned from; words of more than 40 characters
(scripts without spaces) are learned in runs of 40. Prediction reads every whole text. Words are scored
once per task, many at a time, one character position after another; a word's result is kept until the
cache is full.

Letters are Unicode's (categories L*), so digits, numerals such as superscripts and fractions, marks and
signs are none. Edge cases: a null text or one without a letter is `und` with score 0; long words take a
scaled pass in time proportional to their length; if nothing can be learned all rows are `und`; ties go to
the first language in order; repeated rows, rows of one id and rows without an id are predicted each by its
text; extra columns stay unread; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import column_slices, cut, drop, join_hot
from .pieces import MARK, PIECES, load_pieces

PER_LANGUAGE = 1500
ROUNDS = 2
SMOOTH = 0.05
UNSEEN = 1e-7
LONGEST = 40
#: Words by languages whose results are kept, and that are scored at a time.
CACHED, AT_ONCE = 150_000 * 16, 8192 * 16
#: Runs of letters, and of numerals that are no decimal digits; those go in a second look.
WORDS = re.compile(r"[^\W\d_]+")
#: Keeps forward sums near 1: the usual probability of a character.
PER_CHAR = 12.0
_MUL, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def words_in(text: str) -> list[str]:
    """Maximal runs of letters, lower-cased."""
    found = WORDS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split(" ")) if x]


class Vocabulary:
    """Pieces by id, with a hash table of all their prefixes to walk many words at once."""

    def __init__(self, pieces: tuple[str, ...]):
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.unseen = len(pieces)  # stands for a character that is no piece
        self.longest = max(map(len, pieces), default=1)
        nodes: dict[str, int] = {}
        for p in pieces:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], -1)
        nodes.update(self.ids)
        self.bits = max(10, (8 * len(nodes)).bit_length())
        keys, vals = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -2, np.int64)
        texts = list(nodes)
        hashes = np.zeros(len(texts), np.uint64)
        for i, t in enumerate(texts):
            h = 0
            for c in t:
                h = ((h ^ ord(c)) * int(_STEP) + 0x9E3779B9) & (2**64 - 1)
            hashes[i] = h
        at = self._slots(hashes)
        self.probes = 1
        for h, s, t in zip(hashes, at, texts, strict=True):
            k = 0
            while vals[s] != -2:
                s, k = (s + 1) & ((1 << self.bits) - 1), k + 1
            keys[s], vals[s] = h, nodes[t]
            self.probes = max(self.probes, k + 1)
        self.keys, self.vals = keys, vals

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return ((h * _MUL) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, h: np.ndarray) -> np.ndarray:
        """For prefix hashes: the piece's id, -1 for a mere prefix, -2 for neither."""
        s = self._slots(h)
        out = np.where(self.keys[s] == h, self.vals[s], -2)
        out[self.vals[s] == -2] = -2
        todo = np.flatnonzero((self.keys[s] != h) & (self.vals[s] != -2))
        for _ in range(self.probes - 1):
            if not todo.size:
                break
            s[todo] = (s[todo] + 1) & ((1 << self.bits) - 1)
            t = s[todo]
            hit = (self.keys[t] == h[todo]) & (self.vals[t] != -2)
            out[todo[hit]] = self.vals[t[hit]]
            todo = todo[~hit & (self.vals[t] != -2)]
        return out

    def matches(self, words: list[str]) -> tuple[list[list[tuple[np.ndarray, np.ndarray]]], np.ndarray]:
        """by[e][k]: which words have pieces of length k + 1 that end at position e, and those pieces' ids;
        with the words' lengths. Every word gets its mark in front."""
        n = len(words)
        length = np.fromiter((len(w) + 1 for w in words), np.int64, n)
        width = int(length.max())
        flat = "".join((MARK + w).ljust(width, "\0") for w in words).encode("utf-32-le")
        chars = np.frombuffer(flat, np.uint32).reshape(n, width).T.astype(np.uint64)  # position by word
        by: list[list] = [[] for _ in range(width + 1)]
        alive = np.flatnonzero((np.arange(width)[:, None] < length[None, :]).ravel())
        h = np.zeros(alive.size, np.uint64)
        for k in range(min(self.longest, width)):
            s, w = alive // n, alive % n
            h = (h ^ chars[s + k, w]) * _STEP + np.uint64(0x9E3779B9)
            found = self.look(h)
            if k == 0:
                single = np.where(found >= 0, found, self.unseen)
                self._put(by, s, w, single, k)
            else:
                self._put(by, s[found >= 0], w[found >= 0], found[found >= 0], k)
            on = found != -2
            on &= s + k + 1 < length[w]
            alive, h = alive[on], h[on]
            if not alive.size:
                break
        return by, length

    @staticmethod
    def _put(by: list, s: np.ndarray, w: np.ndarray, ids: np.ndarray, k: int) -> None:
        edges = np.searchsorted(s, np.arange(len(by)))  # s ascends
        for at in range(len(by) - 1):
            a, b = edges[at], edges[at + 1]
            if b > a:
                by[at + k + 1].append((at, w[a:b], ids[a:b]))

    def forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log probabilities, word by language, for words of up to LONGEST characters."""
        by, length = self.matches(words)
        alpha = self._alpha(by, len(words), p)
        return np.log(alpha[length, np.arange(len(words))]) - length[:, None] * math.log(PER_CHAR)

    def _alpha(self, by: list, n: int, p: np.ndarray) -> np.ndarray:
        alpha = np.zeros((len(by), n, p.shape[1]))
        alpha[0] = 1
        for e in range(1, len(by)):
            for s, w, ids in by[e]:
                alpha[e, w] += alpha[s, w] * p[ids] * PER_CHAR ** (e - s)
        return alpha

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words seen `counts` times, under one language's p."""
        by, length = self.matches(words)
        n, p = len(words), p[:, None]
        alpha = self._alpha(by, n, p)[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[length, np.arange(n)] = 1
        out = np.zeros(p.shape[0])
        weight = counts / alpha[length, np.arange(n)]
        for e in range(len(by) - 1, 0, -1):
            for s, w, ids in by[e]:
                use = p[ids, 0] * PER_CHAR ** (e - s) * beta[e, w]
                out += np.bincount(ids, alpha[s, w] * use * weight[w], minlength=out.size)
                beta[s, w] += use
        return out

    def long_word(self, word: str, p: np.ndarray) -> np.ndarray:
        """The forward algorithm on one word of any length, rescaled on the way; the last `longest` sums are kept."""
        text, total = MARK + word, np.zeros(p.shape[1])
        recent = [np.ones(p.shape[1])]
        for e in range(1, len(text) + 1):
            now = np.zeros(p.shape[1])
            for k in range(1, min(self.longest, e) + 1):
                i = self.ids.get(text[e - k : e], self.unseen if k == 1 else None)
                if i is not None:
                    now = now + recent[-k] * p[i]
            recent.append(now)
            recent = recent[-self.longest :]
            scale = now.copy()
            if (scale < 1e-100).any():
                recent = [x / scale for x in recent]
                total += np.log(scale)
        return total + np.log(recent[-1])


@lru_cache(maxsize=2)
def _vocabulary(pieces: tuple[str, ...]) -> Vocabulary:
    return Vocabulary(pieces)


def _portion(cells: int, languages: int) -> int:
    """How many words of so many languages make up the cells; with few languages as with 16."""
    return max(64, cells // max(16, languages))


def _many(items: list, most: int = 8192):
    items = sorted(items, key=len)
    for i in range(0, len(items), most):
        yield items[i : i + most]


def learn(docs: DataFrame, learnable: Column, text_col: str = "text", lang_col: str = "lang", pieces_path: str = PIECES, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS, pieces: tuple[str, ...] | None = None) -> tuple[list[str], np.ndarray]:
    """Languages in order, and piece probabilities (pieces and the unseen character, by language)."""
    pieces = pieces or load_pieces(pieces_path)
    rows = docs.filter(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(pieces) + 1, 0))
    often = {k: per_language / n for k, n in sizes.items() if n > per_language}
    drawn = F.pmod(F.xxhash64("text", F.lit(4)), F.lit(1 << 20))
    if len(often) <= 1000:
        share = F.create_map(*(F.lit(x) for kv in often.items() for x in kv)) if often else F.create_map(F.lit(""), F.lit(1.0))
        sample = rows.filter(drawn < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(1.0)) * float(1 << 20))
    else:
        known = rows.sparkSession.createDataFrame(list(often.items()), "lang string, share double")
        sample = join_hot(rows, known, ["lang"], "left").filter(drawn < F.coalesce("share", F.lit(1.0)) * float(1 << 20)).select("lang", "text")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen.setdefault(lang, Counter()).update(w[i : i + LONGEST] for w in words_in(text.as_py()) for i in range(0, len(w), LONGEST))
            flat = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    counts = cut(sample.mapInArrow(words_of, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    p = np.full((len(pieces) + 1, len(langs)), 1.0 / len(pieces))
    p[-1] = UNSEEN
    at = {k: i for i, k in enumerate(langs)}
    for _ in range(rounds):
        held = p

        def uses(batches: Iterator[pa.RecordBatch], p=held) -> Iterator[pa.RecordBatch]:
            v, total = _vocabulary(pieces), {}  # by language
            for b in batches:
                rows: dict[str, dict[str, int]] = {}
                for lang, w, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    rows.setdefault(lang, {})[w] = n
                for lang, of in rows.items():
                    for words in _many(list(of), 4096):
                        used = v.expected(words, np.array([of[w] for w in words], float), np.ascontiguousarray(p[:, at[lang]]))
                        total[lang] = total.get(lang, 0) + used
            for lang, used in total.items():
                i = np.flatnonzero(used)
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(np.full(len(i), at[lang], np.int32)), pa.array(used[i])], ["piece", "lang", "n"])

        c, found = np.zeros_like(p), counts.mapInArrow(uses, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()  # at most pieces x languages
        c[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
        c += SMOOTH
        p = c / c[:-1].sum(axis=0)
        p[-1] = UNSEEN
    drop(counts)
    return langs, p


def predict(df: DataFrame, langs: list[str], p: np.ndarray, id_col: str = "doc_id", text_col: str = "text", pieces_path: str = PIECES, pieces: tuple[str, ...] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (only the id, if None) with lang_pred and score, the posterior under equal priors."""
    pieces = pieces or load_pieces(pieces_path)
    keep = [c for c in ([id_col] if keep is None else keep) if c not in ("lang_pred", "score")]
    read = list(dict.fromkeys([*keep, text_col]))
    source = df.select(read)
    at_text = read.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(p)  # pieces by languages, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = _vocabulary(pieces), shared.value
        known: dict[str, int] = {}
        logs = np.zeros((1024, p.shape[1]))
        cached, at_once = _portion(CACHED, p.shape[1]), _portion(AT_ONCE, p.shape[1])

        def score_new(words: set[str]) -> None:
            nonlocal logs
            if len(known) + len(words) > cached:
                known.clear()
            while len(known) + len(words) > len(logs):
                logs = np.concatenate([logs, np.zeros_like(logs)])
            short = [w for w in words if len(w) <= LONGEST]
            for some in _many(short, at_once):
                got = v.forward(some, p)
                a = len(known)
                logs[a : a + len(some)] = got
                known.update(zip(some, range(a, a + len(some)), strict=True))
            for w in words:
                if len(w) > LONGEST:
                    a = len(known)
                    logs[a] = v.long_word(w, p)
                    known[w] = a

        for b in batches:
            pred, score = [], []
            for lo, hi in column_slices(b.column(at_text), most=_portion(1 << 24, p.shape[1])):
                lists = [words_in(t) if t and langs else [] for t in b.column(at_text).slice(lo, hi - lo).to_pylist()]
                new = set().union(*lists)
                if len(known) + len(new) > cached:
                    known.clear()
                new -= known.keys()
                if new:
                    score_new(new)
                for ws in lists:
                    if not ws:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    total = logs[np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                    best = int(total.argmax())
                    pred.append(langs[best])
                    score.append(float(1.0 / np.exp(total - total[best]).sum()))
            cols = [b.column(read.index(c)) for c in keep] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "lang_pred", "score"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"])
    return source.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that learning never reads: crc32 of the id as text, modulo 4, is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
