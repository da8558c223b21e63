"""The rules of the three published documents, as written by ``plans.publish``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pollspark import dims, schemas
from pollspark.operators import documents as D

_ELECTION = [D.required("date"), D.populated("results")]
_COLOUR = r"^#"


def _day(day: Column) -> Column:
    return F.concat(F.lit("timeseries["), day.cast("string"), F.lit("]"))


def timeseries(header: DataFrame, rows: DataFrame, parties: list[str]) -> DataFrame:
    """Broken rules of the daily document: ``header`` and ``rows`` hold JSON texts in ``value``; ``parties`` are keys."""
    head = D.parsed(header, schemas.TIMESERIES_DOC)
    rules = [
        D.readable(), D.required("metadata"), D.equals("metadata.model", "spline"), D.filled("metadata.generated_at"),
        D.positive("metadata.n_days"), D.equals("metadata.source_period_days", dims.GRID_DAYS), D.equals("metadata.bsw_in_sonstige", True),
        D.has_size("metadata.quantiles", len(dims.QUANTILE_LEVELS)), D.has_size("metadata.parties", len(parties)),
        D.required("parties"), D.exactly_keys("parties", parties), D.each("parties", D.required("display"), D.matches("color", _COLOUR)),
        D.populated("elections"), D.each_entry("elections", *_ELECTION)]
    days = D.parsed(rows, schemas.TIMESERIES_ROW)
    per_day = [D.readable(), D.holds("a date", "date", lambda d: d.try_cast("date").isNotNull()), D.exactly_keys("parties", parties),
               D.each("parties", D.required(*dims.QUANTILE_KEYS), D.ascending(dims.QUANTILE_KEYS), D.decimals(dims.QUANTILE_KEYS, 3))]
    dated = days.select(F.col("doc.date").try_cast("date").alias("day"))
    place = F.concat(F.lit("timeseries["), F.coalesce("doc.date", F.lit("?")), F.lit("]"))
    parts = [D.check(head, "doc", rules, F.lit("")), D.check(days, "doc", per_day, place), D.steps(dated, "day", _day), D.counted(days, head, "metadata.n_days")]
    return _named("timeseries", parts)


def snapshot(document: DataFrame, parties: list[str]) -> DataFrame:
    """Broken rules of the snapshot document."""
    meta = ["n_polls_total", "n_polls_last_30d", "last_poll_date", "last_poll_pollster"]
    rules = [D.readable(), D.required("date"), D.equals("model", "spline"), D.filled("generated_at"), D.has_size("parties", len(parties)),
             D.each_entry("parties", D.required("id", "display", *dims.QUANTILE_KEYS), D.matches("color", _COLOUR), D.between("median", 0, 1)),
             D.descending_list("parties", "median"), D.required(*[f"meta.{m}" for m in meta])]
    return _named("snapshot", [D.check(D.parsed(document, schemas.CURRENT_DOC), "doc", rules, F.lit(""))])


def polls(header: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Broken rules of the polls document; ``columns`` have to be listed."""
    head = D.parsed(header, schemas.POLLS_DOC)
    one = D.parsed(rows, schemas.POLL_ROW)
    keys = [k for _, _, k, _ in dims.PARTIES]
    rules = [D.readable(), D.filled("generated_at"), D.positive("n_polls"), D.contains_keys("columns", columns)]
    per_poll = [D.readable(), D.holds("a date", "date", lambda d: d.try_cast("date").isNotNull()), D.required("pollster"), D.decimals(keys, 3),
                *[D.holds("share", k, lambda v: v.isNull() | v.between(0, 1)) for k in keys]]
    place = F.concat(F.lit("polls["), F.concat_ws(" ", F.col("doc.date"), F.col("doc.pollster")), F.lit("]"))
    parts = [D.check(head, "doc", rules, F.lit("")), D.check(one, "doc", per_poll, place), D.counted(one, head, "n_polls")]
    return _named("polls", parts)


def _named(document: str, parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(document).alias("document"), "rule", "place", "found")
