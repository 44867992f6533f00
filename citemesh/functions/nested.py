"""Operators on arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_unique(df: DataFrame, array: str, keys: list[str] | None = None, order: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row for each struct; of those with equal keys the first by `order` and place stays."""
    rows = df.select(*(keep or []), *(F.col(o).alias(f"__{o}") for o in order or []), F.posexplode(array).alias("__pos", "__e")).filter("__e is not null")
    rows = rows.select(*(keep or []), *(f"__{o}" for o in order or []), "__pos", "__e.*")
    if keys:
        by = Window.partitionBy(*keys).orderBy(*(f"__{o}" for o in order or []), "__pos")
        rows = rows.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")
    return rows.drop("__pos", *(f"__{o}" for o in order or []))


def field_list(array: Column | str, key: str) -> Column:
    """One field of each struct; null for an empty list."""
    return F.when(F.size(array) > 0, F.transform(array, lambda x: x[key]))


def zip_structs(**arrays: Column) -> Column:
    """Structs of parallel lists, as many as the shortest has."""
    names = list(arrays)
    zipped = F.arrays_zip(*(c.alias(n) for n, c in arrays.items()))
    n = F.least(*(F.size(c) for c in arrays.values())) if len(names) > 1 else F.size(arrays[names[0]])
    named = F.transform(zipped, lambda x: F.struct(*(x.getField(k).alias(k) for k in names)))
    return F.slice(named, F.lit(1), n)


def author_positions(authors: Column) -> Column:
    """Structs with position (from 1), reversed position (-1 last) and whether names are in order (a
    single author isn't)."""
    n = F.size(authors)
    names = F.transform(authors, lambda a: a["name"])
    in_order = (n > 1) & F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.coalesce(F.try_element_at(names, i) <= F.try_element_at(names, i + 1), n == 1))
    return F.transform(authors, lambda a, i: F.struct(a["authorId"].alias("authorId"), a["name"].alias("name"), (i + 1).alias("authorListPosition"), (i - n).alias("authorListPositionReversed"), in_order.alias("authorListAlphabetized")))


def nested_authors(df: DataFrame, id_col: str, fields: dict[str, str], name: str = "author_name", last: str = "author_last") -> DataFrame:
    """Parallel lists to authors[] with institutions[] each, grouped by name in order; empty lists are null.
    fields: institution field to list column."""
    lists = {"name": name, "last_name": last, **fields}
    rows = df.select(id_col, F.posexplode(F.arrays_zip(*(F.col(c).alias(k) for k, c in lists.items()))).alias("pos", "a")).select(id_col, "pos", "a.*").filter("name is not null")
    place = F.struct("pos", F.struct(*fields).alias("inst"))
    by_name = rows.groupBy(id_col, "name").agg(F.min_by("last_name", "pos").alias("last_name"), F.transform(F.array_sort(F.collect_list(place)), lambda x: x["inst"]).alias("institutions"))
    authors = by_name.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("name", "last_name", "institutions"))).alias("authors"))
    return df.join(authors, id_col, "left")


def unique_institutions(df: DataFrame, authors: str = "authors", keys: tuple[str, ...] = ("institution",), order: str | None = None) -> DataFrame:
    """A row for each institution name with the list of each address field. Rows are first made unique in
    `keys`; with the name alone, as by default, each list has one entry."""
    two = df.select(*([order] if order else []), F.explode(authors).alias("a")).select(*([order] if order else []), F.posexplode("a.institutions").alias("pos", "i"))
    rows = two.select(*([F.col(order).alias("__o")] if order else [F.lit(0).alias("__o")]), "pos", "i.*").filter("institution is not null and trim(institution) <> ''")
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__o", "pos", *(c for c in rows.columns if c not in ("__o", "pos"))))).filter("__n = 1")
    fields = [c for c in rows.columns if c not in ("__o", "pos", "__n", "institution")]
    whole = rows.groupBy(F.col("institution").alias("name")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__l"))
    return whole.select("name", *(F.col("__l")[f].alias(f) for f in fields))


def affiliations(df: DataFrame, paper: str = "id", authors: str = "authors", compat: bool = False) -> DataFrame:
    """Distinct (author, institution). Each author keeps their own institutions; with compat, all authors
    of a paper are paired with all institutions of the paper."""
    own = df.select(paper, F.explode(authors).alias("a"))
    pairs = own.select(paper, F.col("a.authorId").alias("author"), F.explode("a.institutions").alias("i")).select(paper, "author", F.col("i.institution").alias("institution"))
    if compat:
        pairs = own.select(paper, F.col("a.authorId").alias("author")).join(pairs.select(paper, "institution"), paper)
    return pairs.select("author", "institution").dropna().distinct()


def empty_to_null(c: Column | str) -> Column:
    return F.when(F.size(c) > 0, F.col(c) if isinstance(c, str) else c)
