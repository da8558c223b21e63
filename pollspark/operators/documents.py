"""Checks of nested documents: declared rules, one row per broken rule.

A rule is a function of a document (a struct column) and of the place it stands at, and gives an array of findings
(rule, place, found). All rules of a document are one projection, so a table of documents is read once whatever the
number of rules; nested maps and arrays are walked by higher-order functions, never exploded. Rules between rows
(days without gaps, order, counts) are equi-joins and one-row aggregates and need no sort of the table.

A missing value breaks every rule about it; a rule about the parts of a missing map or array finds nothing more than
the missing part itself, which ``required`` reports.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

Rule = Callable[[Column, Column], Column]
FINDINGS = "array<struct<rule: string, place: string, found: string>>"
CORRUPT = "_corrupt_record"


def parsed(texts: DataFrame, schema: T.StructType, column: str = "value", name: str = "doc") -> DataFrame:
    """JSON texts as structs; a text that is no such document keeps itself in the field ``_corrupt_record``."""
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return texts.withColumn(name, F.from_json(column, whole, {"columnNameOfCorruptRecord": CORRUPT}))


def _at(place: Column, path: str) -> Column:
    return F.concat_ws(".", F.nullif(place, F.lit("")), F.lit(path))


def _get(doc: Column, path: str) -> Column:
    return reduce(lambda d, name: d[name], path.split("."), doc)


def _finding(rule: str, place: Column, found: Column, broken: Column) -> Column:
    """One finding where ``broken`` is true or unknown, else none."""
    one = F.array(F.struct(F.lit(rule).alias("rule"), place.alias("place"), found.cast("string").alias("found")))
    return F.when(F.coalesce(broken, F.lit(True)), one).otherwise(F.array().cast(FINDINGS))


def readable() -> Rule:
    """The text is JSON of the expected form."""
    return lambda doc, place: _finding("readable", place, F.lit("not a document"), doc.isNull() | doc[CORRUPT].isNotNull())


def required(*paths: str) -> Rule:
    def rule(doc: Column, place: Column) -> Column:
        return F.concat(*[_finding("required", _at(place, p), F.lit("missing"), _get(doc, p).isNull()) for p in paths])
    return rule


def holds(name: str, path: str, condition: Callable[[Column], Column], show: Callable[[Column], Column] = lambda v: v.cast("string")) -> Rule:
    """``condition`` of the value at ``path`` is true; ``show`` says how the value is reported."""
    def rule(doc: Column, place: Column) -> Column:
        value = _get(doc, path)
        return _finding(name, _at(place, path), F.coalesce(show(value), F.lit("missing")), ~condition(value))
    return rule


def equals(path: str, value: object) -> Rule:
    return holds("equals", path, lambda v: v == F.lit(value))


def positive(path: str) -> Rule:
    return holds("positive", path, lambda v: v > 0)


def filled(path: str) -> Rule:
    """A text that is not empty."""
    return holds("filled", path, lambda v: F.length(v) > 0)


def populated(path: str) -> Rule:
    """A list or map with an entry."""
    return holds("populated", path, lambda v: F.size(v) > 0, lambda v: F.when(v.isNotNull(), F.size(v)).cast("string"))


def has_size(path: str, n: int) -> Rule:
    return holds("size", path, lambda v: F.size(v) == n, lambda v: F.when(v.isNotNull(), F.size(v)).cast("string"))


def matches(path: str, pattern: str) -> Rule:
    return holds("matches", path, lambda v: v.rlike(pattern))


def between(path: str, low: float, high: float) -> Rule:
    return holds("between", path, lambda v: v.between(low, high))


def _keys(doc: Column, path: str) -> Column:
    value = _get(doc, path) if path else doc
    return F.map_keys(value)


def exactly_keys(path: str, names: list[str]) -> Rule:
    """A map has these keys and no others."""
    def rule(doc: Column, place: Column) -> Column:
        want, have = F.array(*[F.lit(n) for n in names]), _keys(doc, path)
        lost, more = F.array_sort(F.array_except(want, have)), F.array_sort(F.array_except(have, want))
        found = F.concat_ws("; ", F.when(F.size(lost) > 0, F.concat(F.lit("without "), F.array_join(lost, ","))),
                            F.when(F.size(more) > 0, F.concat(F.lit("besides "), F.array_join(more, ","))))
        return _finding("keys", _at(place, path), F.coalesce(F.nullif(found, F.lit("")), F.lit("missing")), (F.size(lost) > 0) | (F.size(more) > 0))
    return rule


def contains_keys(path: str, names: list[str]) -> Rule:
    """A map or a list of texts has at least these keys."""
    def rule(doc: Column, place: Column) -> Column:
        lost = F.array_sort(F.array_except(F.array(*[F.lit(n) for n in names]), _get(doc, path)))
        return _finding("contains", _at(place, path), F.coalesce(F.concat(F.lit("without "), F.array_join(lost, ",")), F.lit("missing")), F.size(lost) > 0)
    return rule


def ascending(fields: list[str]) -> Rule:
    """The named fields do not fall, in this order; pairs that fall, or lack a value, are reported."""
    def rule(doc: Column, place: Column) -> Column:
        falls = F.concat_ws(",", *[F.when(~F.coalesce(doc[a] <= doc[b], F.lit(False)), F.lit(f"{a}>{b}")) for a, b in zip(fields, fields[1:])])
        return _finding("ascending", place, falls, falls != "")
    return rule


def decimals(fields: list[str], digits: int) -> Rule:
    """No field has more decimals; those that have are reported."""
    def rule(doc: Column, place: Column) -> Column:
        long = F.concat_ws(",", *[F.when(F.round(doc[f], digits) != doc[f], F.lit(f)) for f in fields])
        return _finding("decimals", place, long, long != "")
    return rule


def descending_list(path: str, field: str) -> Rule:
    """Entries of a list stand by falling ``field``; the first place that rises is reported."""
    def rule(doc: Column, place: Column) -> Column:
        value = F.transform(_get(doc, path), lambda e: e[field])
        rises = F.filter(F.transform(value, lambda v, i: F.when((i > 0) & ~F.coalesce(F.get(value, i - 1) >= v, F.lit(False)), i)), lambda i: i.isNotNull())
        return _finding("descending", _at(place, path), F.get(rises, F.lit(0)), F.size(rises) > 0)
    return rule


def each(path: str, *rules: Rule) -> Rule:
    """The rules for every value of a map, or every entry of a list; an empty ``path`` is the document itself."""
    def of_map(doc: Column, place: Column) -> Column:
        def one(entry: Column) -> Column:
            return F.concat(*[r(entry["value"], F.concat(_at(place, path), F.lit("["), entry["key"], F.lit("]"))) for r in rules])
        return F.coalesce(F.flatten(F.transform(F.map_entries(_get(doc, path)), one)), F.array().cast(FINDINGS))
    return of_map


def each_entry(path: str, *rules: Rule) -> Rule:
    """The rules for every entry of a list; places count from 0."""
    def of_list(doc: Column, place: Column) -> Column:
        def one(entry: Column, i: Column) -> Column:
            return F.concat(*[r(entry, F.concat(_at(place, path), F.lit("["), i.cast("string"), F.lit("]"))) for r in rules])
        return F.coalesce(F.flatten(F.transform(_get(doc, path), one)), F.array().cast(FINDINGS))
    return of_list


def check(docs: DataFrame, doc: str, rules: list[Rule], place: Column) -> DataFrame:
    """(rule, place, found) of every broken rule, in one pass over the documents."""
    found = F.concat(*[r(F.col(doc), place) for r in rules])
    return docs.select(F.inline(found))


def steps(rows: DataFrame, day: str, place: Callable[[Column], Column]) -> DataFrame:
    """Days that stand more than once, and days whose next day is missing though later ones exist.

    Days are counted first; the neighbour is an equi-join of the counts, so neither a sort nor a window is needed.
    """
    counts = rows.groupBy(F.col(day).alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d IS NOT NULL")
    later = counts.select(F.date_sub("d", 1).alias("d"), F.lit(True).alias("followed"))
    last = counts.agg(F.max("d").alias("last"))
    seen = counts.join(later, "d", "left").crossJoin(last)  # one row
    twice = seen.where("n > 1").select(F.lit("once").alias("rule"), place(F.col("d")).alias("place"), F.col("n").cast("string").alias("found"))
    gaps = seen.where("followed IS NULL AND d < last").select(F.lit("no gaps").alias("rule"), place(F.col("d")).alias("place"), F.lit("no next day").alias("found"))
    return twice.unionByName(gaps)


def in_order(rows: DataFrame, position: str, value: str, falling: bool, place: Callable[[Column], Column]) -> DataFrame:
    """Rows that stand at the wrong side of the row before them; ``position`` counts rows without a gap."""
    own = rows.select(F.col(position).alias("p"), F.col(value).alias("v"))
    before = own.select((F.col("p") + 1).alias("p"), F.col("v").alias("b"))
    wrong = F.col("b") < F.col("v") if falling else F.col("b") > F.col("v")
    return own.join(before, "p").where(F.coalesce(wrong, F.lit(True))).select(
        F.lit("in order").alias("rule"), place(F.col("p")).alias("place"), F.concat_ws(" then ", F.col("b").cast("string"), F.col("v").cast("string")).alias("found"))


def counted(rows: DataFrame, header: DataFrame, path: str) -> DataFrame:
    """The header's number at ``path`` against the rows there are; both sides are one row."""
    said = header.select(_get(F.col("doc"), path).alias("said"))
    both = rows.agg(F.count(F.lit(1)).alias("there")).crossJoin(said)
    return both.where(~F.coalesce(F.col("said") == F.col("there"), F.lit(False))).select(
        F.lit("count").alias("rule"), F.lit(path).alias("place"), F.concat_ws(" of ", F.col("there").cast("string"), F.coalesce(F.col("said").cast("string"), F.lit("missing"))).alias("found"))
