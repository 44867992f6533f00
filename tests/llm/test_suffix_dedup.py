import hashlib
import random

import numpy as np
import pytest

from citemesh.llm import suffix_dedup as sd

SCHEMA = "doc_id bigint, text string, key string, h bigint"


def brute(rows):
    """Removed ranges of each (id, text), by a dictionary of all windows."""
    docs = sorted({(sd.LAST_ID if i is None else i, t or "") for i, t in rows}, key=lambda x: (x[0], hashlib.md5(x[1].encode()).hexdigest()))
    seen, out = {}, {}
    for i, t in docs:
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if seen.setdefault(w, (i, t, p)) != (i, t, p):
                gone[p : p + 100] = True
        out[i, t] = gone
    return out


def expected(rows):
    out, found = [], brute(rows)
    for i, t in rows:
        gone = found[sd.LAST_ID if i is None else i, t or ""]
        data = np.frombuffer((t or "").encode(), np.uint8)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def made(spark, rows):
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in sd.remove_repeats(df).collect()), key=str)


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randint(1, 9)))
    long = lambda n: " ".join(word() for _ in range(n))
    passage, other = long(60), long(30)
    rows = [(i, long(r.randint(5, 120))) for i in range(25)]
    rows += [(30 + i, long(r.randint(0, 20)) + passage + long(r.randint(0, 20)) + other) for i in range(12)]
    rows += [(60, passage[:99]), (61, passage[:100]), (62, passage[3:160]), (63, "x" * 350), (64, "x" * 99), (65, "ab" * 200)]
    rows += [(70, None), (71, ""), (None, passage), (None, None), (72, rows[3][1]), (73, rows[3][1]), (5, rows[5][1]), (74, passage * 3), (6, other + long(40))]
    rows += [(80, long(3000))]
    rows += [(81, rows[-1][1][500:4000] + "!")]
    return rows


@pytest.mark.parametrize("seed,group", [(1, sd.GROUP_ROWS), (2, 2)])
def test_same_as_brute_force(spark, monkeypatch, seed, group):
    monkeypatch.setattr(sd, "GROUP_ROWS", group)
    rows = texts(seed)
    assert made(spark, rows) == expected(rows)


def test_many_texts_without_id(spark):
    """Each is a document of its own, however alike their checksums; so are several texts of one id."""
    r = random.Random(11)
    new = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(r.randint(20, 50)))
    rows = [(None, new()) for _ in range(10_000)]
    rows += [(None, rows[k][1][:150] + new()) for k in range(0, 400, 4)] + [(9, new()) for _ in range(50)] + [(9, rows[-1][1][20:180]), (8, rows[3][1][5:]), (None, rows[7][1])]
    assert made(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert made(spark, []) == []


def test_difference_cover():
    assert {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER} == set(range(sd.PERIOD))


def test_small_segments_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(sd, "SEGMENT", 700)
    monkeypatch.setattr(sd, "BUCKET", 64)
    rows = texts(3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((tuple(r) for r in sd.remove_repeats(docs).collect()), key=str) == expected(rows)


def test_block_orders_suffixes():
    r = random.Random(5)
    rows = [(1, i, 0, 0, 20, bytes(r.choice(b"ab") for _ in range(150))) for i in range(20)] + [(1, 99, 0, 0, 20, b"a" * 150), (1, 98, 0, 0, 20, b"a" * 150)]
    block = sd.Block(rows)
    for own, new in block.classes():
        keys = [(bytes(block.data[p : p + 32]), p % sd.PERIOD, bytes(block.data[p : p + 100])) for p in block.place[own]]
        assert keys == sorted(keys)
        assert [a[2] == b[2] for a, b in zip(keys, keys[1:])] == [not x for x in new[1:]]
