"""Benchmark decontamination by template canonicalisation [native].

Texts become tokens: runs of letters and digits, case and punctuation aside, where a number is `#`, a
capitalised word within a sentence `@`, a unit behind a number `~`, each before its raw value; white space
of any kind and length is one blank. A token's template is its type, or the lower-cased word. Windows of 8
template tokens are hash-joined with the benchmark's; a document is a candidate for an item if at least
half of the item's windows occur in it. Windows that match along one offset are aligned, and their slots
must be consistent: each raw value of the item stands for one raw value in the document, case aside. So a
question with new numbers and names is caught, and a text that only looks alike in its placeholders is not.

Each item window is also looked for with names folded to lower case like any word, so only numbers and
units are typed there: a copy in lower case, CAPITALS or Title Case is found. Windows of names alone are
evidence for an item that has no others, and windows of numbers and units alone for one that has neither,
if their values are the same. An item under 8 tokens is one window of its own length, looked for anywhere
in a document.

All in DataFrame expressions. Edge cases: null and empty texts match nothing, and items without a token
are none; rows without an id are told apart by their text's hash, as are several texts of one id; repeated
rows give one result; an item matches by any number of ties and is returned once; an empty benchmark or an
empty table gives no rows; extra columns are not read. The benchmark's windows are broadcast behind a
check of their number and bytes; else the same join runs by shuffle, with salts, as many documents may
share a window. Whole texts are read, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, join_hot, small_or_not

WINDOW = 8
COVERAGE = 0.5
#: Units that follow numbers.
UNITS = "mm cm dm m km in ft yd mi mile miles metre metres meter meters inch inches foot feet g kg mg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces l ml cl litre litres liter liters gallon gallons s ms sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent pct kph mph km/h m/s hz khz mhz ghz w kw v a j kj cal kcal k c f degree degrees"
#: The capital is looked for first, as it is rare; then what stands before it.
_NAME = r"(\p{Lu}(?<=[\p{L}\p{N},;:][ \t]\p{Lu})[\p{L}\p{M}]+)"
_NUMBER = r"([0-9]+(?:[.,][0-9]+)*)"
_UNIT = rf"(#[0-9.,]+[ \t]?)({'|'.join(sorted((u for u in UNITS.split() if u.isalpha()), key=len, reverse=True))}|%|€|\$|£)(?![\p{{L}}\p{{N}}])"
_SPLIT = r"[^\p{L}\p{M}\p{N}#@~.,%€$£]+|[.,](?![0-9])|(?<![0-9])[.,]"


#: White space besides the blank.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A token's value, case and type aside.
_VALUE = "lower(translate({}, '@~', ''))"
_VALUES = "xxhash64(transform({}, x -> " + _VALUE.format("x") + "), 'values')"
_AFTER_NUMBER = "({0} > 0 and get({1}, {0} - 1) like '#%' and " + _VALUE.format("{1}[{0}]") + " in (" + ", ".join(f"'{u}'" for u in UNITS.split() if u.isalpha()) + "))"


def tokens(text: Column) -> Column:
    """Raw tokens; slots start with their type's sign."""
    t = F.translate(F.coalesce(text, F.lit("")), "#@~" + _SPACES, "   " + " " * len(_SPACES))
    t = F.regexp_replace(t, "  +", " ")
    t = F.regexp_replace(t, _NAME, "@$1")
    t = F.regexp_replace(t, _NUMBER, " #$1")
    t = F.regexp_replace(t, "(?i)" + _UNIT, "$1 ~$2 ")
    return F.filter(F.split(t, _SPLIT), lambda x: F.length(x) > 0)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: a generator stands between it and what reads it, as
    a plain projection would be copied into each lambda that names it and run for each element."""
    return df.withColumn(name, F.explode(F.array(value)))


def both_hashes(df: DataFrame) -> DataFrame:
    """df(tokens) with __h, the tokens' template hashes, and __f, the same with names as lower-case words."""
    df = once(df, "__h", F.expr("transform(tokens, x -> if(ascii(x) in (35, 64, 126), bigint(ascii(x)), xxhash64(lower(x))))"))
    folded = f"case when v <> 126 and get(__h, i - 1) = 35 and {_AFTER_NUMBER.format('i', 'tokens')} then 126L when v = 64 then xxhash64({_VALUE.format('tokens[i]')}) else v end"
    return once(df, "__f", F.expr(f"transform(__h, (v, i) -> {folded})"))


def both_windows(df: DataFrame, lengths: list[tuple[int, bool]], keep: list[str]) -> DataFrame:
    """df(keep, tokens) as keep with (pos, h): each window of the lengths by template, each that holds a name again
    with names as words, and, for lengths with True, each of numbers and units alone by its values."""
    df = once(both_hashes(df), "__d", F.expr("filter(sequence(0, size(__h) - 1), j -> __h[j] <> __f[j])"))
    df = once(df, "__n", F.expr("size(filter(__f, v -> v in (35, 126)))"))
    parts = []
    for n, values in lengths:
        last = f"(size(__h) - {n})"
        named = f"array_distinct(flatten(transform(__d, j -> if(greatest(0, j - {n - 1}) <= least(j, {last}), sequence(greatest(0, j - {n - 1}), least(j, {last})), array()))))"
        made = "transform({}, i -> named_struct('pos', i, 'h', xxhash64(slice({}, i + 1, %d))))" % n
        typed = made.format(f"sequence(0, {last})", "__h")
        parts.append(f"case when {last} < 0 then array() when size(__d) = 0 then {typed} else concat({typed}, {made.format(named, '__f')}) end")
        if values:
            alone = f"filter(sequence(0, {last}), i -> forall(slice(__f, i + 1, {n}), v -> v in (35, 126)))"
            parts.append(f"case when __n < {n} then array() else transform({alone}, i -> named_struct('pos', i, 'h', {_VALUES.format(f'slice(tokens, i + 1, {n})')})) end")
    each = f"concat({', '.join(parts)})" if parts else "array(named_struct('pos', 0, 'h', 0L))"
    return once(df.filter("size(tokens) > 0"), "__w", F.expr(each)).select(*keep, F.inline("__w")).filter(F.lit(bool(parts)))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """items(item_id, tokens) as (item_id, item_pos, h, n, by_value): the windows of n tokens that hold an ordinary
    word, by template and with names as words; of an item without such, those that hold a name; without
    these, those of numbers and units, by value. A shorter item is one window."""
    df = once(both_hashes(items), "n", F.expr(f"least(size(tokens), {window})"))
    w = f"named_struct('pos', i, 'h', slice(__h, i + 1, n), 'f', slice(__f, i + 1, n), 'values', {_VALUES.format('slice(tokens, i + 1, n)')})"
    df = once(df, "__w", F.expr(f"transform(sequence(0, size(__h) - n), i -> {w})"))
    word = "exists(x.{}, v -> v not in (35, 64, 126))"
    some = "transform(filter(__w, x -> %s), x -> named_struct('pos', x.pos, 'hs', array_distinct(%s)))"
    typed = some % (word.format("h"), "array(xxhash64(x.h), xxhash64(x.f))")
    names = some % (word.format("f"), "array(xxhash64(x.f))")
    values = some % ("true", "array(x.values)")
    has = "exists(__w, x -> {})".format
    df = df.withColumn("by_value", F.expr(f"not {has(word.format('h'))} and not {has(word.format('f'))}"))
    df = df.select("item_id", "n", "by_value", F.inline(F.expr(f"case when {has(word.format('h'))} then {typed} when not by_value then {names} else {values} end")))
    return df.select("item_id", F.col("pos").alias("item_pos"), F.explode("hs").alias("h"), "n", "by_value")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, th, item_id, n_windows, coverage, verbatim) for each document and benchmark item in it; th
    hashes the text; verbatim if the whole item stands in it, case and punctuation aside."""
    items = once(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")), "tokens", tokens(F.col("text"))).select("item_id", "tokens")
    items = cut(items.filter(F.col("item_id").isNotNull() & (F.size("tokens") > 0)))
    of_items = cut(item_windows(items, window))
    # one row for each length up to the window's
    lengths = sorted(map(tuple, of_items.groupBy("n").agg(F.bool_or("by_value")).collect()))
    of_items = of_items.select("item_id", "item_pos", "h").distinct()
    total = of_items.groupBy("item_id").agg(F.count_distinct("item_pos").alias("n_windows"))

    keyed = docs.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    split = once(keyed, "tokens", tokens(F.col("text"))).select("doc", "th", "tokens")
    found = both_windows(split, lengths, ["doc", "th"])
    hits = join_hot(found.select("doc", "th", "pos", "h"), of_items, ["h"])
    hits = cut(hits.select("doc", "th", "item_id", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct())
    enough = hits.groupBy("doc", "th", "item_id").agg(F.count_distinct("item_pos").alias("n")).join(total, "item_id").filter(F.col("n") >= F.col("n_windows") * coverage)
    hits = cut(hits.join(enough.select("doc", "th", "item_id", "n_windows"), ["doc", "th", "item_id"]))
    # the aligned slots of each document, item and offset
    lines = hits.groupBy("doc", "th", "item_id", "n_windows", "shift").agg(F.collect_set("item_pos").alias("at"))
    wanted, _ = small_or_not(hits.select("doc", "th").distinct())
    texts = once(keyed.join(wanted, ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"]), "theirs", tokens(F.col("text"))).select("doc", "th", "theirs")
    lines = lines.join(texts, ["doc", "th"]).join(items, "item_id")
    lines = once(lines, "p", F.expr(f"array_distinct(flatten(transform(at, p -> sequence(p, p + least(size(tokens), {window}) - 1))))"))
    slot = "substring(tokens[j], 1, 1) in ('#', '@', '~') or " + _AFTER_NUMBER.format("j", "tokens")
    lines = once(lines, "pairs", F.expr(f"array_distinct(transform(filter(p, j -> {slot}), j -> named_struct('mine', {_VALUE.format('tokens[j]')}, 'theirs', {_VALUE.format('theirs[j + shift]')})))"))
    lines = lines.filter("size(array_distinct(transform(pairs, x -> x.mine))) = size(pairs)")
    same = f"{_VALUE.format('tokens[j]')} <=> {_VALUE.format('get(theirs, j + shift)')}"
    lines = lines.withColumn("verbatim", F.expr(f"forall(sequence(0, size(tokens) - 1), j -> {same})"))
    each = lines.select("doc", "th", "item_id", "n_windows", "verbatim", F.explode("at").alias("item_pos"))
    out = each.groupBy("doc", "th", "item_id", "n_windows").agg(F.count_distinct("item_pos").alias("n"), F.bool_or("verbatim").alias("verbatim"))
    out = out.filter(F.col("n") >= F.col("n_windows") * coverage)
    return out.select(F.nullif("doc", F.lit(-(1 << 63))).alias("doc_id"), "th", "item_id", "n_windows", (F.col("n") / F.col("n_windows")).alias("coverage"), "verbatim")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that hold a benchmark item."""
    bad, _ = small_or_not(leaks(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).distinct())
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__d")) & (F.xxhash64(text_col) == F.col("__t")), "left_anti")
