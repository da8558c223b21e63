"""Date expressions: the fixed grid, the month-restarting floor, field periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def iso(d: Column | str) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def grid_index(d: Column, origin: str, days: int = 14) -> Column:
    """1-based index of the half-open period of ``days`` days that holds ``d``."""
    return (F.floor(F.datediff(d, F.lit(origin).cast("date")) / days) + 1).cast("int")


def grid_index_closed(d: Column, origin: str, last_t: Column | int, days: int = 14) -> Column:
    """As ``grid_index`` over breaks 1..last_t, the last break belonging to the period before.

    This is the rule of the daily export: the first day of the last period shows the values of
    the period before it, and days after it stay in the last period.
    """
    last = F.lit(last_t) if isinstance(last_t, int) else last_t
    t = grid_index(d, origin, days)
    at_break = F.datediff(d, F.lit(origin).cast("date")) == (last - 1) * days
    return F.when(at_break & (last > 1), last - 1).otherwise(F.least(t, last)).cast("int")


def grid_start(t: Column, origin: str, days: int = 14) -> Column:
    return F.date_add(F.lit(origin).cast("date"), ((t - 1) * days).cast("int"))


def month_floor(d: Column, days: int) -> Column:
    """Floor to a unit of ``days`` days that starts again on day 1 of every month."""
    step = (F.floor((F.dayofmonth(d) - 1) / days) * days).cast("int")
    return F.date_add(F.trunc(d, "MM"), step)


def dotted_date(text: Column) -> Column:
    """``dd.mm.yyyy``; anything else becomes null."""
    return F.try_to_date(text, "d.M.yyyy")


# Patterns of a field period such as "27.12.–02.01." or "??.??.–16.10.".
FIELD_START = r"(\d+)\.(\d+)[^0-9]+\d+\.\d+"
FIELD_END = r"(?:\?\?\.\?\?\.[^\d]+|bis\s*|(?:\d+\.\d+[^0-9]+))(\d+)\.(\d+)\."


def _year_guess(text: Column, pattern: str, published: Column) -> tuple[Column, Column]:
    day = F.regexp_extract(text, pattern, 1)
    month = F.regexp_extract(text, pattern, 2)
    year = F.year(published) - F.when(
        month.try_cast("int") > F.month(published), 1).otherwise(0)
    parsed = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-M-d")
    found = F.coalesce(F.length(day) > 0, F.lit(False))
    return F.when(found & published.isNotNull(), parsed), found


def field_period(text: Column, published: Column) -> tuple[Column, Column]:
    """Start and end of a field period; the year follows from the publication date.

    A month after the publication month means the year before. A part that is absent is null; a
    part that is present but no date makes both null.
    """
    start, has_start = _year_guess(text, FIELD_START, published)
    end, has_end = _year_guess(text, FIELD_END, published)
    broken = (has_start & start.isNull()) | (has_end & end.isNull())
    return F.when(~broken, start), F.when(~broken, end)


def day_series(spark: SparkSession, start: str, end: str, name: str = "date") -> DataFrame:
    """One row per day, both ends included."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return spark.range(1).select(F.explode(days).alias(name))


def days_through(periods: DataFrame, t: str, origin: str, days: int = 14) -> DataFrame:
    """One row per day (date) from ``origin`` to the end of the last period of a table; a one-row maximum ends it."""
    last = periods.agg(F.max(t).alias("last"))
    first = F.lit(origin).cast("date")
    end = F.date_add(first, (F.col("last") * days - 1).cast("int"))
    return last.where("last >= 1").select(F.explode(F.sequence(first, end)).alias("date"))


def days_open(spark: SparkSession, start: str, end: str, facts: DataFrame, day: Column) -> DataFrame:
    """One row per day (date) from ``start`` to ``end``, or to the last ``day`` of ``facts`` where that is later."""
    last = facts.agg(F.greatest(F.lit(end).cast("date"), F.max(day)).alias("last"))
    return last.select(F.explode(F.sequence(F.lit(start).cast("date"), F.col("last"))).alias("date"))
