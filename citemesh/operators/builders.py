"""Node and edge sets of a publication graph from harmonised records.

Records hold id, date, ref_ids array<string>, authors array<struct<authorId, name, url, ..., institutions
array<struct<institution, address, city, state, postal_code, country>>>> and funding
array<struct<grantId, funder>>. Every set is a plan over DataFrames; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import strip_newlines
from ..functions.nested import explode_unique, unique_institutions
from .graph import EdgeSet, NodeSet
from .relational import keep_first

#: The properties of an authorship.
AUTHORSHIP = {"authorListPosition": "int", "authorListPositionReversed": "int", "authorListAlphabetized": "boolean", "authorListAlphabetizedLastName": "boolean"}
#: An institution's address fields and their names as lists of a node.
ADDRESS = {"address": "addresses", "city": "cities", "state": "states", "postal_code": "postalCodes", "country": "countries"}


def author_nodes(records: DataFrame, id_col: str = "id") -> NodeSet:
    """People, by the first record that names them."""
    a = explode_unique(records, "authors", ["authorId"], [id_col])
    have = [c for c in ("name", "url") if c in a.columns]
    rules = [{"old": c, "new": "semanticScholarURL" if c == "url" else c, "type": "string"} for c in have]
    people = NodeSet.build(a, "Person", "authorId", rules, ("Author",))
    people.made = (people.df, records, "authors")
    return people


def publication_nodes(records: DataFrame, properties: list[dict] | None = None, id_col: str = "id", refs: str = "ref_ids", text: tuple[str, ...] = ()) -> NodeSet:
    """Records and, behind them, everything they cite as nodes without properties. Line breaks in the text
    columns go; of rows with one id the first by its properties stays, a record before a reference."""
    clean = records.withColumns({c: F.regexp_replace(c, r"\n|\\n", "") for c in text})
    own = NodeSet.build(clean, "Publication", id_col, properties)
    cited = records.select(F.explode(refs).alias("id")).select(F.col("id").cast("string")).filter("id is not null").distinct()
    new = cited.join(own.df.select("id"), "id", "left_anti")
    df = own.df.unionByName(new, allowMissingColumns=True)
    return NodeSet(df, "Publication", made=(df, records, id_col, refs))


def unique_funders(records: DataFrame, funding: str = "funding") -> DataFrame:
    """(id, name) of all funders named; the name is the id."""
    f = records.select(F.explode(funding).alias("g")).select(F.col("g.funder").alias("name")).filter("trim(name) <> ''").distinct()
    return f.select(F.col("name").alias("id"), "name")


def organisation_nodes(records: DataFrame, authors: str = "authors", funding: str = "funding", id_col: str = "id") -> tuple[NodeSet, NodeSet, NodeSet]:
    """(all, funders, institutions that fund nothing): institutions come first, so a name that is both keeps
    its addresses and is a funder, not an institution only."""
    inst = unique_institutions(records, authors, order=id_col)
    inst = inst.withColumnsRenamed({k: v for k, v in ADDRESS.items() if k in inst.columns}).withColumn("id", F.col("name"))
    fund = unique_funders(records, funding)
    lists = [c for c in inst.columns if c not in ("id", "name")]
    inst = inst.select("id", "name", *lists)
    only_fund = fund.join(inst.select("id"), "id", "left_anti")
    both = inst.join(fund.select("id"), "id", "left_semi")
    funders = both.unionByName(only_fund, allowMissingColumns=True)
    only = inst.join(fund.select("id"), "id", "left_anti")
    return NodeSet(only.unionByName(funders), "Institution"), NodeSet(funders.select("id", "name"), "Institution", ("Funder",)), NodeSet(only, "Institution")


def citation_edges(records: DataFrame, papers: NodeSet, id_col: str = "id", refs: str = "ref_ids", date: str = "date") -> EdgeSet:
    """(reference)-[CITED_BY]->(paper) with the citing paper's date."""
    r = records.select(F.explode(refs).alias("ref"), F.col(id_col).alias("paper"), F.col(date).alias("date"))
    sure = ("src", "dst") if papers.holds(records, id_col, refs) else ()
    return EdgeSet.build(r, "CITED_BY", "ref", "paper", papers, papers, [{"old": "date", "new": "publicationDate", "type": "datetime"}], sure=sure)


def authorship_edges(records: DataFrame, people: NodeSet, papers: NodeSet, id_col: str = "id", authors: str = "authors", date: str = "date") -> EdgeSet:
    """(person)-[WROTE]->(paper) with the date and the author's place in the list."""
    rows = records.select(F.col(id_col).alias("__paper"), F.col(date).alias("__date"), F.posexplode(authors).alias("__pos", "a")).select("__paper", "__date", "__pos", "a.*").filter("authorId is not null")
    sure = (*(["src"] if people.holds(records, authors) else []), *(["dst"] if papers.made[:3] == (papers.df, records, id_col) else []))
    rules = [{"old": "__date", "new": "publicationDate", "type": "datetime"}] + [{"old": c, "new": c, "type": t} for c, t in AUTHORSHIP.items() if c in rows.columns]
    return EdgeSet.build(rows, "WROTE", "authorId", "__paper", people, papers, rules, order=["__pos"], sure=sure)


def affiliation_edges(records: DataFrame, people: NodeSet, organisations: NodeSet, authors: str = "authors") -> EdgeSet:
    """(person)-[AFFILIATED_WITH]->(organisation), each author with their own, by the organisation's name."""
    own = records.select(F.explode(authors).alias("a")).select(F.col("a.authorId").alias("author"), F.explode("a.institutions").alias("i")).select("author", F.col("i.institution").alias("name")).dropna().distinct()
    named = own.join(organisations.df.select("id", "name"), "name").select("author", "id")
    return EdgeSet.build(named, "AFFILIATED_WITH", "author", "id", people, organisations)


def funding_edges(records: DataFrame, organisations: NodeSet, papers: NodeSet, id_col: str = "id", funding: str = "funding", date: str = "date") -> EdgeSet:
    """(organisation)-[FUNDED]->(paper) with date and grant; of several grants for one paper the first stays."""
    g = records.select(F.col(id_col).alias("paper"), F.col(date).alias("date"), F.posexplode(funding).alias("pos", "g")).select("paper", "date", "pos", F.nullif("g.grantId", F.lit("")).alias("grantId"), F.nullif("g.funder", F.lit("")).alias("funder")).filter("funder is not null")
    named = g.join(organisations.df.select(F.col("id").alias("org"), F.col("name").alias("funder")), "funder")
    return EdgeSet.build(named, "FUNDED", "org", "paper", organisations, papers, [{"old": "date", "new": "date", "type": "datetime"}, {"old": "grantId", "new": "grantId", "type": "string"}], order=["pos"])


def cluster_graph(papers: DataFrame, clusters: DataFrame, start_id: int = 0, model_id: str | None = None) -> tuple[NodeSet, NodeSet, EdgeSet]:
    """(papers, clusters, memberships) to write back. papers: id, clusterLabel, membershipProbability,
    clusterMembershipProbabilities and interdisciplinarityScore; clusters: label, year, keyphrases and
    embedding. Cluster ids go on from `start_id` in the order of their years and labels; noise (-1) belongs
    to no cluster."""
    from ..functions.columns import year_window
    from .relational import surrogate_ids

    first, last = year_window(F.col("year"))
    c = surrogate_ids(clusters.filter("label > -1"), ["year", "label"], start_id, "__id").withColumns({"startDate": first, "endDate": last})
    nodes = NodeSet(c.select(F.col("__id").cast("string").alias("id"), *(x for x in c.columns if x not in ("__id", "id"))), "LanguageCluster")
    keep = [x for x in ("clusterMembershipProbabilities", "interdisciplinarityScore", "clusterLabel") if x in papers.columns]
    paper_nodes = NodeSet(papers.select(F.col("id").cast("string").alias("id"), *keep), "Publication")
    known = nodes.df.select(F.col("id").alias("dst"), F.col("label").alias("clusterLabel"), "year")
    on = ["clusterLabel", "year"] if "year" in papers.columns else ["clusterLabel"]
    e = papers.join(known if "year" in on else known.drop("year"), on).select(F.col("id").cast("string").alias("src"), "dst", "membershipProbability", F.lit(model_id).cast("string").alias("modelID"))
    return paper_nodes, nodes, EdgeSet(keep_first(e, ["src", "dst"], ["membershipProbability"]), "IS_CLUSTER_MEMBER_OF")


def text_rows(records: DataFrame, id_col: str = "id", title: str = "title", abstract: str = "abstract", limit: int | None = None) -> DataFrame:
    """(id, title, abstract) of records with an id, as embedders read them; a limit takes the first by id."""
    rows = records.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), strip_newlines(F.col(title)).alias("title"), strip_newlines(F.col(abstract)).alias("abstract"))
    return rows if limit is None else rows.orderBy("id").limit(limit)


def labelled_citations(vertices: DataFrame, edges: DataFrame, parts: DataFrame, part: str, features: list[str], directed: bool = True) -> tuple[DataFrame, DataFrame]:
    """(vertices with their feature arrays joined in one, edges among them) of one part (Train, Test);
    undirected edges go both ways."""
    inside = parts.filter(F.col("part") == part).select("id")
    v = vertices.join(inside, "id", "left_semi").select("id", F.concat(*(F.col(f) for f in features)).alias("features"))
    e = edges.select("src", "dst").join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return v, (e if directed else e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
