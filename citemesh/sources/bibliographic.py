"""Request builders, response parsers and recorded fetches. No network in here: a fetcher is passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefixes of the paper identifiers the scholar service takes.
ID_PREFIXES = {"S2": "", "DOI": "DOI:", "ArXiv": "ARXIV:", "MAG": "MAG:", "ACL": "ACL:", "PubMed": "PMID:", "PubMedCentral": "PMCID:", "URL": "URL:", "CorpusID": "CorpusID:", "Medline": "PMID:"}
PAGE = 25_000


def hit_counts(responses: DataFrame, body: str = "body") -> DataFrame:
    """(url, query, hits) of recorded searches: how many records each would give; null where the response
    can't be read."""
    r = responses.withColumn("__r", F.from_json(body, "response struct<numFound: bigint>"))
    return r.select("url", F.url_decode(F.regexp_extract("url", "[?&]q=([^&]*)", 1)).alias("query"), F.col("__r.response.numFound").alias("hits"))


def solr_urls(queries: DataFrame, base: str, query: str = "query", hits: str = "hits", filters: Column | None = None, fields: str = "*,score", sort: str | None = None, page: int = PAGE, start: int = 0) -> DataFrame:
    """A row for each page of each query's hits; a scan that broke off goes on from page number `start`."""
    rows = _pages(queries, hits, page).filter(F.col("start") >= start * page)
    parts = [F.lit(f"{base}/select?q="), F.url_encode(F.col(query)), F.lit("&q.op=AND&fl="), F.lit(fields), F.lit("&start="), F.col("start").cast("string"), F.lit(f"&rows={page}")]
    if filters is not None:
        parts += [F.lit("&fq="), F.url_encode(filters)]
    if sort:
        parts.append(F.lit(f"&sort={sort}"))
    return rows.withColumn("url", F.concat(*parts))


def bucket_urls(buckets: DataFrame, base: str, column: str = "date", fields: list[str] | None = None, page: int = PAGE, start: int = 0) -> DataFrame:
    """A full-corpus pull: a row for each page of each date bucket(bucket_start, bucket_end, hits), oldest
    first by `number`; buckets before `start` are left out, so a pull can be taken up again."""
    from ..operators.relational import range_filter, surrogate_ids

    b = surrogate_ids(buckets, ["bucket_start"], 0, "number").filter(F.col("number") >= start)
    b = b.withColumns({"filter": F.concat(F.lit(f"{column}:"), range_filter()), "query": F.lit("*:*")})
    return solr_urls(b, base, filters=F.col("filter"), fields=",".join(fields) if fields else "*,score", page=page)


def _pages(queries: DataFrame, hits: str, page: int) -> DataFrame:
    rows = queries.withColumn("start", F.explode(F.expr(f"transform(sequence(0, greatest(cast(ceil({hits} / {page}D) as int), 1) - 1), i -> i * {page})")))
    return rows


#: Fields of a paper that the scholar service can return.
PAPER_FIELDS = "paperId externalIds url title abstract venue year referenceCount citationCount influentialCitationCount isOpenAccess fieldsOfStudy authors authors.authorId authors.name authors.url authors.aliases citations references embedding tldr".split()


def scholar_urls(ids: DataFrame, base: str, value: str, kind: str = "DOI", fields: list[str] | None = None, exact: bool = True) -> DataFrame:
    """A row for each identifier of a kind, author id or keyword search; unknown fields raise."""
    if unknown := [f for f in fields or [] if f not in PAPER_FIELDS]:
        raise ValueError(f"unknown fields {unknown}")
    tail = f"?fields={','.join(fields)}" if fields else ""
    if kind == "keyword":
        q = F.concat(F.lit('"'), F.col(value), F.lit('"')) if exact else F.col(value)
        return ids.withColumn("url", F.concat(F.lit(f"{base}/paper/search?query="), F.url_encode(q), F.lit(tail.replace("?", "&"))))
    if kind == "Author":
        return ids.withColumn("url", F.concat(F.lit(f"{base}/author/"), F.col(value), F.lit(tail)))
    if kind not in ID_PREFIXES:
        raise ValueError(f"unknown identifier kind {kind!r}")
    return ids.withColumn("url", F.concat(F.lit(f"{base}/paper/{ID_PREFIXES[kind]}"), F.col(value), F.lit(tail)))


def crossref_urls(queries: DataFrame, base: str, query: str, email: str, rows: int = 20, bibliographic: bool = True) -> DataFrame:
    name = "query.bibliographic" if bibliographic else "query"
    return queries.withColumn("url", F.concat(F.lit(f"{base}/works?{name}="), F.url_encode(F.col(query)), F.lit(f"&rows={rows}&mailto={email}")))


def polite_limit(header: int) -> int:
    return header - 10 if header > 10 else header


def solr_documents(responses: DataFrame, schema: str, body: str = "body", drop: list[str] | None = None) -> DataFrame:
    """Documents of search responses: dates parsed, DOI the last of the list, the query from the URL."""
    d = responses.withColumn("__r", F.from_json(body, f"response struct<docs: array<struct<{schema}>>>"))
    d = d.select("url", F.explode("__r.response.docs").alias("__d")).select(F.url_decode(F.regexp_extract("url", "[?&]q=([^&]*)", 1)).alias("query"), "__d.*")
    if "doi" in d.columns:
        d = d.withColumn("DOI", F.try_element_at("doi", F.lit(-1)))
    if "date" in d.columns:
        d = d.withColumn("date", F.try_to_timestamp("date"))
    return d.drop(*(drop or []))


#: What is read of a scholar record.
SCHOLAR = "paperId string, externalIds struct<DOI: string>, url string, title string, abstract string, authors array<struct<authorId: string, name: string, url: string>>, fieldsOfStudy array<string>, isOpenAccess boolean, error string, message string"


def scholar_papers(responses: DataFrame, body: str = "body") -> DataFrame:
    """A row for each paper of single-record responses: those with an error or a message, and bodies that
    can't be read, give none; empty lists are null; repeated (id, title) rows and rows without an id go."""
    p = responses.select("url", F.from_json(body, SCHOLAR).alias("p")).select(F.col("url").alias("request"), "p.*")
    p = p.filter("error is null and message is null and paperId is not null").drop("error", "message")
    p = p.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in ("authors", "fieldsOfStudy")}).withColumn("DOI", F.col("externalIds.DOI")).drop("externalIds")
    from ..operators.relational import keep_first

    return keep_first(p, ["paperId", "title"], ["request"])


def scholar_matches(responses: DataFrame, threshold: float = 0.85, body: str = "body") -> DataFrame:
    """(url, query, paper_id, doi, title, abstract, score): of each keyword search the record whose title is
    most like the query, if like enough; equal scores go by id."""
    from ..operators.linkage import indel_ratio

    r = responses.select("url", F.from_json(body, f"data array<struct<{SCHOLAR}>>").alias("r"))
    q = F.url_decode(F.regexp_extract("url", "[?&]query=([^&]*)", 1))
    d = r.select("url", q.alias("query"), F.explode("r.data").alias("d")).filter("d.title is not null")
    d = d.withColumn("score", indel_ratio(F.col("d.title"), F.regexp_replace("query", '^"|"$', "")))
    d = d.filter(F.col("score") >= threshold).select("url", "query", F.col("d.paperId").alias("paper_id"), F.col("d.externalIds.DOI").alias("doi"), F.col("d.title").alias("title"), F.col("d.abstract").alias("abstract"), "score")
    best = F.min_by(F.struct("paper_id", "doi", "title", "abstract", "score"), F.struct((-F.col("score")).alias("s"), "paper_id")).alias("b")
    return d.groupBy("url", "query").agg(best).select("url", "query", "b.*")


def crossref_matches(responses: DataFrame, threshold: float = 0.2, body: str = "body") -> DataFrame:
    """(url, DOI, title, score): of each search the best record of its high-scoring group, if it has one.
    Records are under message.items, else under message itself; without scores there is no match."""
    from ..operators.linkage import best_score

    item = "struct<DOI: string, title: array<string>, score: double>"
    r = responses.select("url", F.from_json(body, f"message struct<items: array<{item}>>").alias("a"), F.from_json(body, f"message array<{item}>").alias("b"))
    i = r.select("url", F.explode(F.coalesce("a.message.items", "b.message")).alias("i")).select("url", F.col("i.DOI").alias("DOI"), F.try_element_at("i.title", F.lit(1)).alias("title"), F.col("i.score").alias("score"))
    return best_score(i.filter("score is not null"), "url", "score", "DOI", threshold).select("url", "DOI", "title", "score")


def geocode_urls(places: DataFrame, base: str, columns: dict[str, str]) -> DataFrame:
    """Places with the request for their coordinates; columns: the service's parameter to a column. Null
    parameters are left out."""
    parts = [F.concat(F.lit(f"&{k}="), F.url_encode(F.col(c))) for k, c in columns.items()]
    return places.withColumn("url", F.concat(F.lit(f"{base}/search?format=json&limit=1"), *(F.coalesce(p, F.lit("")) for p in parts)))


def geocoded(responses: DataFrame, body: str = "body") -> DataFrame:
    """(url, address, latitude, longitude) of the first place in each response; those without one give no row."""
    r = responses.select("url", F.from_json(body, "array<struct<display_name: string, lat: string, lon: string>>").alias("r"))
    p = r.select("url", F.try_element_at("r", F.lit(1)).alias("p")).filter("p is not null")
    return p.select("url", F.col("p.display_name").alias("address"), F.expr("try_cast(p.lat as float)").alias("latitude"), F.expr("try_cast(p.lon as float)").alias("longitude"))


def fetch(urls: DataFrame, fetcher: Callable[[str], tuple[int, str]], workers: int = 3, retries: int = 0, pause: float = 0.0, strict: bool = False) -> DataFrame:
    """(url, status, body) by at most `workers` tasks; failed requests give no row, or with `strict` end the
    job. Errors 400 to 599 are tried again so many times. Rows are keyed by their url."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for f in frames:
            out = []
            for u in f["url"]:
                for attempt in range(retries + 1):
                    try:
                        status, body = fetcher(u)
                    except OSError:
                        if strict:
                            raise
                        break
                    if pause:
                        time.sleep(pause)
                    if not 400 <= status <= 599 or attempt == retries:
                        out.append((u, status, body))
                        break
            yield pd.DataFrame(out, columns=["url", "status", "body"])

    return urls.select("url").repartition(workers).mapInPandas(run, "url string, status int, body string")


def recorded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url string, status int, body string").json(path)


def read_pages(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """JSON lines (gzip too) with the file's name as _source_file, so the venue column `source` stays."""
    df = spark.read.schema(schema).json(path).withColumn("_source_file", F.col("_metadata.file_name"))
    return df if limit is None else df.limit(limit)


def read_bytes(spark: SparkSession, path: str, suffix_after: str | None = None) -> DataFrame:
    df = spark.read.format("binaryFile").load(path)
    return df if suffix_after is None else df.filter(F.col("path") > suffix_after)


def count_objects(spark: SparkSession, path: str) -> int:
    return spark.read.format("binaryFile").load(path).select("path").count()


def load_graph(spark: SparkSession, vertices: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a graph kept as Parquet; edges with an unknown end go."""
    v, e = spark.read.parquet(vertices), spark.read.parquet(edges)
    ids = v.select("id")
    return v, e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def secret(spark: SparkSession, name: str, environ: dict | None = None) -> str:
    """A key from the environment, else from the session's settings under citemesh.secret; never from a file
    in a working folder."""
    import os

    found = (os.environ if environ is None else environ).get(name) or spark.conf.get(f"citemesh.secret.{name}", None)
    if not found:
        raise KeyError(f"no secret {name!r} in the environment or the session")
    return found
