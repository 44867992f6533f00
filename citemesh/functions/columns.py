"""Scalar and array expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters with a meaning in the search server's query language.
SPECIAL = "+-&|!(){}[]^\"~*?:/#"
#: Property types of the graph import format and their Spark types.
TYPES = {"int": "int", "long": "bigint", "short": "smallint", "byte": "tinyint", "float": "float", "double": "double", "boolean": "boolean", "char": "string", "string": "string", "point": "struct<lat:double,lon:double>", "date": "date", "datetime": "timestamp", "localdatetime": "timestamp_ntz", "time": "string", "localtime": "string", "duration": "interval day to second"}


def allowed_types() -> list[str]:
    return [*TYPES, *(f"{t}[]" for t in TYPES)]


def spark_type(name: str) -> str:
    """Spark's type for a property type; arrays end in []."""
    base = name.removesuffix("[]")
    if base not in TYPES:
        raise ValueError(f"unknown property type {name!r}")
    return f"array<{TYPES[base]}>" if name.endswith("[]") else TYPES[base]


def clean_special(c: Column) -> Column:
    return F.translate(c, SPECIAL, "")


def preprocess_text(c: Column, language: str = "english") -> Column:
    """Null to empty, lower case, line breaks and tabs to spaces; in English all but letters, digits and spaces go."""
    out = F.translate(F.lower(F.coalesce(c, F.lit(""))), "\n\t", "  ")
    return F.regexp_replace(out, "[^A-Za-z0-9 ]+", "") if language == "english" else out


def strip_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "[\r\n]+", " ")


def full_citation(authors: Column, date: Column, title: Column, venue: Column) -> Column:
    """`authors year, "title" venue`, all in lower case; authors are joined by a comma and cut at 200
    characters; missing parts are empty."""
    empty = F.lit("")
    names = F.lower(F.substring(F.array_join(F.coalesce(authors, F.array().cast("array<string>")), ", "), 1, 200))
    return F.concat(names, F.lit(" "), F.coalesce(F.year(date).cast("string"), empty), F.lit(', "'), F.lower(F.coalesce(title, empty)), F.lit('" '), F.lower(F.coalesce(venue, empty)))


def iso_timestamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def list_join(c: Column, sep: str = ";") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


def parse_floats(c: Column, sep: str = ";") -> Column:
    return F.transform(F.split(c, sep), lambda x: x.cast("double"))


def extract_groups(df: DataFrame, column: str, patterns: dict[str, str], prefix: str = "^", suffix: str = "$") -> DataFrame:
    """A column for each name, with its pattern's first group; null where it doesn't match."""
    return df.withColumns({n: F.nullif(F.regexp_extract(column, f"{prefix}{p}{suffix}", 1), F.lit("")) for n, p in patterns.items()})


def null_labels(columns: dict[str, str]) -> Column:
    """Labels of the columns that are null in a row."""
    return F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(n)) for c, n in columns.items())))


def condense_flags(columns: list[str], prefix: str = "", yes: str = "Yes") -> Column:
    """Names of the columns that say yes, joined by `;`; null if none does."""
    return F.nullif(F.concat_ws(";", *(F.when(F.col(c) == yes, F.lit(c.removeprefix(prefix))) for c in columns)), F.lit(""))


def check_flags(df: DataFrame, columns: list[str]) -> None:
    """Each flag column must hold both Yes and No, and nothing else."""
    got = df.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in columns)).first()
    bad = [c for c in columns if got[c] != ["No", "Yes"]]
    if bad:
        raise ValueError(f"not Yes/No columns: {bad}")


def recode(c: Column, codes: dict, default: Column | None = None) -> Column:
    """Codes to labels by a literal map; others to default (null)."""
    found = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))[c]
    return found if default is None else F.coalesce(found, default)


def capped_limit(user: int | None, cap: int = 20_000) -> int:
    return cap if user is None else min(user, cap)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def jaccard(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def distance_to_ones(columns: list[Column]) -> Column:
    return F.sqrt(sum(((1 - c) * (1 - c) for c in columns[1:]), (1 - columns[0]) * (1 - columns[0])))


def fill_vector(labels: Column, values: Column, n: int) -> Column:
    """A vector of length n with values at their labels and 0 elsewhere; raises on a label out of range,
    a repeated label or lists of unequal length."""
    m = F.map_from_arrays(labels, values)  # repeated keys raise
    ok = (F.size(labels) == F.size(values)) & F.forall(labels, lambda x: (x >= 0) & (x < n))
    return F.when(ok, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at(m, i.cast("int")), F.lit(0.0)))).otherwise(F.raise_error(F.lit("labels out of range or of another number than values")).cast("array<double>"))


def interdisciplinarity(p: Column) -> Column:
    """n/(n-1) * (1 - max) * (1 - population deviation) of a membership vector, at most 1."""
    n = F.size(p).cast("double")
    mean = F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(p, F.lit(0.0), lambda s, x: s + x * x) / n - mean * mean
    return F.least(F.lit(1.0), n / (n - 1) * (1 - F.array_max(p)) * (1 - F.sqrt(F.greatest(var, F.lit(0.0)))))


def cluster_label(label: Column, year: Column) -> Column:
    return F.concat(F.lit("cluster"), label.cast("string"), F.lit("_"), year.cast("string"))


def year_window(year: Column) -> tuple[Column, Column]:
    return F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31))


def graph_indices(v: Column, e: Column) -> dict[str, Column]:
    """beta, alpha and gamma from counts of nodes and edges."""
    v, e = v.cast("double"), e.cast("double")
    return {"beta": F.try_divide(e, v), "alpha": F.try_divide(e - v, 0.5 * v * v - 1.5 * v + 1), "gamma": F.try_divide(e, 0.5 * v * v - 0.5 * v)}


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def columns_of_class(df: DataFrame, *kinds: str) -> list[str]:
    """Columns whose type is, or holds in an array, struct or map, one of these (int, array, struct, ...)."""
    from pyspark.sql import types as T

    def within(t) -> set[str]:
        inner = [t.elementType] if isinstance(t, T.ArrayType) else [t.keyType, t.valueType] if isinstance(t, T.MapType) else [f.dataType for f in t.fields] if isinstance(t, T.StructType) else []
        return {t.simpleString().partition("<")[0].partition("(")[0]}.union(*map(within, inner))

    return [f.name for f in df.schema.fields if within(f.dataType) & set(kinds)]


def check_header_types(df: DataFrame, suffix: str, kind: str | None = None, csv: bool = True) -> list[str]:
    """Columns whose header ends in a property type, and those of a Spark type; for files, a column of that
    type without the suffix in its header raises."""
    found = [c for c in df.columns if c.endswith(suffix)]
    for c, t in df.dtypes:
        if kind and (t == kind or t.partition("<")[0] == kind):
            if csv and suffix not in c:
                raise ValueError(f"column {c!r} is of type {t} but its header lacks {suffix!r}")
            if c not in found:
                found.append(c)
    return found


def vectors_to_lists(df: DataFrame) -> DataFrame:
    """Vector columns as arrays of doubles, which every sink can hold."""
    from pyspark.ml.functions import vector_to_array

    return df.withColumns({f.name: vector_to_array(f.name) for f in df.schema.fields if f.dataType.typeName() in ("vectorudt", "vector")})


def utc_text(c: Column, zone: str = "UTC", pattern: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> Column:
    """A local time of a zone as UTC text (F.current_timestamp() for now)."""
    return F.date_format(F.convert_timezone(F.lit(zone), F.lit("UTC"), c.cast("timestamp_ntz")), pattern)


def repaired_doi(doi: Column, listed: Column) -> Column:
    """The DOI, or the last of the listed ones where it is missing."""
    return F.coalesce(doi, F.try_element_at(listed, F.lit(-1)))


def new_keys(new: Column, old: Column) -> Column:
    """Entries of a map whose keys the other lacks."""
    return F.map_filter(new, lambda k, _: ~F.coalesce(F.map_contains_key(old, k), F.lit(False)))
