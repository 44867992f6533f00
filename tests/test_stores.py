"""The stored graph and the paged data source."""

import json
import os
import re
from datetime import date
from urllib.parse import unquote

from citemesh.sources.graph_store import GraphStore
from citemesh.sources.paged import PagedSearch, buckets
from pyspark.sql import functions as F

DOCS = [{"id": f"d{i}", "date": f"2020-{1 + i % 6:02d}-{1 + i % 28:02d}T00:00:00Z", "title": f"t {i}"} for i in range(95)]


def answer(url):
    """A recorded service: pages of DOCS; every request is noted in a file that the environment names."""
    if log := os.environ.get("CITEMESH_TEST_LOG"):
        with open(log, "a") as f:
            f.write(url + "\n")
    u = unquote(url)
    lo, hi = re.search(r"\[(\S+)T00.*TO (\S+)T23", u).groups()
    start, rows = (int(re.search(rf"{k}=(\d+)", u)[1]) for k in ("start", "rows"))
    found = [d for d in DOCS if lo <= d["date"][:10] <= hi]
    return 200, json.dumps({"response": {"numFound": len(found), "docs": found[start : start + rows]}})


def down(url):
    return 503, "busy"


def reader(r, **more):
    o = {"fetcher": "tests.test_stores:answer", "base": "http://x", "start": "2020-01-01", "end": "2020-06-30", "page": "4", "schema": "id string, date date, title string"}
    return r.format("paged_search").options(**o | more)


def test_buckets():
    assert buckets(date(2020, 1, 1), date(2020, 3, 10), "monthly") == [(date(2020, 1, 1), date(2020, 1, 31)), (date(2020, 2, 1), date(2020, 2, 29)), (date(2020, 3, 1), date(2020, 3, 10))]
    assert [len(buckets(date(2019, 12, 30), date(2020, 1, 2), f)) for f in ("daily", "weekly", "monthly")] == [4, 1, 2]


def test_paged_scan(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSearch)
    assert {(r.id, str(r.date), r.title) for r in reader(spark.read).load().collect()} == {(d["id"], d["date"][:10], d["title"]) for d in DOCS}
    spring = reader(spark.read).load().filter((F.col("date") >= F.lit("2020-03-05").cast("date")) & (F.col("date") < F.lit("2020-05-01").cast("date")))
    monkeypatch.setenv("CITEMESH_TEST_LOG", str(tmp_path / "asked"))
    assert {r.id for r in spring.collect()} == {d["id"] for d in DOCS if "2020-03-05" <= d["date"][:10] < "2020-05-01"}
    # the driver's requests, if the plan ran in a process that sees the variable, leave out January and June
    if (tmp_path / "asked").exists():
        assert not re.search("2020-01-01T|2020-06-01T", unquote((tmp_path / "asked").read_text()))
    try:
        reader(spark.read, fetcher="tests.test_stores:down", retries="0").load().count()
    except Exception as e:
        assert "503" in str(e)
    else:
        raise AssertionError("an error of the service must end the scan")


def test_paged_stream_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(PagedSearch)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        s = reader(spark.readStream, bucketsPerTrigger="2").load()
        q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()

    run()
    first = spark.read.parquet(out).count()
    run()
    got = [r.id for r in spark.read.parquet(out).collect()]
    assert first == len(got) == len(set(got)) == len(DOCS)


def test_merge_into_a_store(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"), 8)
    people = spark.createDataFrame([(f"p{i}", f"n{i}", i) for i in range(40)] + [(None, "x", 1)], "id string, name string, age int")
    store.merge_nodes("Person", people)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(tmp_path / "graph") for f in names if f.endswith(".parquet")}
    before = files()
    batch = spark.createDataFrame([("p1", None, "a@b"), ("new", 7, None), ("new", 5, None)], "id string, age int, mail string")
    store.merge_nodes("Person", batch)
    after = files()
    same = [f for f in before if after.get(f) == before[f]]
    assert len(before) == len(after) == 8 and 6 <= len(same) <= 7  # only the two ids' buckets are new
    want = {(f"p{i}", f"n{i}", None if i == 1 else i, "a@b" if i == 1 else None) for i in range(40)} | {("new", None, 7, None)}
    assert {tuple(r) for r in store.nodes("Person").select("id", "name", "age", "mail").collect()} == want
    store.merge_nodes("Person", batch)  # again
    assert {tuple(r) for r in store.nodes("Person").select("id", "name", "age", "mail").collect()} == want
    knows = spark.createDataFrame([("p1", "p2", 1.0), ("p1", "nobody", 1.0), ("new", "p1", 2.0)], "src string, dst string, w double")
    store.merge_edges("KNOWS", knows, "Person", "Person")
    store.merge_edges("KNOWS", knows.filter("dst = 'p2'").withColumn("w", F.lit(9.0)), "Person", "Person")
    assert {tuple(r) for r in store.edges("KNOWS").select("src", "dst", "w").collect()} == {("p1", "p2", 9.0), ("new", "p1", 2.0)}


def test_merge_under_a_stream(spark, tmp_path):
    from citemesh.streaming.ingest import ingest

    store = GraphStore(spark, str(tmp_path / "graph"), 4)
    for k in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"id": f"p{i}", "age": 10 * k + i}) + "\n" for i in range(k, k + 3)))
        ingest(spark, str(tmp_path / "in"), "id string, age int", str(tmp_path / "mark"), lambda df, n: store.merge_nodes("Person", df))
    assert {tuple(r) for r in store.nodes("Person").collect()} == {("p0", 0), ("p1", 11), ("p2", 12), ("p3", 13)}
