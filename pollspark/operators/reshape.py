"""Long to wide, wide to long, patterns and nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_wide(df: DataFrame, ids: list[str], name: str, value: str, columns: list[str],
            fill: float | None = None, prefix: str = "") -> DataFrame:
    """Long to wide over a given list of names, in one shuffle on ``ids``."""
    def cell(c: str) -> Column:
        v = F.max(F.when(F.col(name) == c, F.col(value)))
        return (v if fill is None else F.coalesce(v, F.lit(fill))).alias(f"{prefix}{c}")

    return df.groupBy(*ids).agg(*[cell(c) for c in columns])


def to_wide_sum(df: DataFrame, ids: list[str], name: Column, value: Column,
                columns: list[str]) -> DataFrame:
    """Sum per (id, name) and spread over columns at once.

    A listed name whose values are all missing gives 0, a name that is not listed gives null.
    Sum and spread share one shuffle with map-side partial sums, so a hot id stays cheap.
    """
    def cell(c: str) -> Column:
        is_c = F.coalesce(name == c, F.lit(False))
        total = F.coalesce(F.sum(F.when(is_c, value)), F.lit(0.0))
        return F.when(F.count_if(is_c) > 0, total).alias(c)

    return df.groupBy(*ids).agg(*[cell(c) for c in columns])


def to_wide_structs(df: DataFrame, ids: list[str], name: str, values: list[str],
                    columns: list[str]) -> DataFrame:
    """Several values per name, as columns ``{name}__{value}``."""
    return df.groupBy(*ids).agg(*[
        F.max(F.when(F.col(name) == c, F.col(v))).alias(f"{c}__{v}")
        for c in columns for v in values
    ])


def to_long(df: DataFrame, ids: list[str], columns: list[str], name: str,
            value: str) -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def with_missing_columns(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """Add absent columns as typed nulls."""
    return df.withColumns({
        c: F.lit(None).cast(kind) for c in columns if c not in df.columns})


def party_columns(df: DataFrame) -> list[str]:
    """Columns that are no metadata, in name order."""
    # Names of metadata columns.
    known = {
        "publishing_date", "Zeitraum", "Befragte", "mode", "survey_count", "sampling_start_day",
        "sampling_end_day", "period", "uuid", "pollster", "Empty",
    }
    return sorted(c for c in df.columns if c not in known)


def column_profile(df: DataFrame, order: list[str]) -> DataFrame:
    """One row: per column the number of known values and the first known value as text.

    "First" is by ``order``, so the result does not depend on partitioning.
    """
    at = F.struct(*order)
    aggs = []
    for c in df.columns:
        aggs.append(F.count(c).alias(f"{c}__n"))
        aggs.append(F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), at))
                    .alias(f"{c}__first"))
    return df.agg(*aggs)


def percent_columns(df: DataFrame, order: list[str], pattern: str) -> list[str]:
    """Text columns whose first known value looks like a percentage; one row is looked at."""
    names = [c for c in df.columns if isinstance(df.schema[c].dataType, T.StringType)]
    first = column_profile(df.select(*order, *[c for c in names if c not in order]), order)
    tests = first.select(*[
        F.coalesce(F.col(f"{c}__first").rlike(pattern), F.lit(False)).alias(c) for c in names])
    row = tests.first()
    return [c for c in names if row[c]]


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns without any value; one aggregate decides, one row reaches the driver."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c] > 0])


def reporting_pattern(df: DataFrame, poll: str, party: str, order: dict[str, int],
                      sep: str = " | ") -> DataFrame:
    """Per poll the parties it reports: label, index array, one 0/1 flag per party.

    The flags are map-side maxima over a fixed party list, so rows need not be unique per party
    and a poll of any size sends one row per task.
    """
    names = sorted(order, key=order.get)
    flags = df.groupBy(poll).agg(*[
        F.max((F.col(party) == p).cast("int")).alias(f"has_{p}") for p in names])
    has = {p: F.col(f"has_{p}") == 1 for p in names}
    return flags.select(
        poll, F.concat_ws(sep, *[F.when(has[p], F.lit(p)) for p in names]).alias("pattern"),
        F.array_compact(F.array(*[F.when(has[p], F.lit(order[p])) for p in names]))
        .alias("party_idx"),
        *[f"has_{p}" for p in names])


def nest_by_key(df: DataFrame, ids: list[str], key: str, fields: list[str],
                name: str) -> DataFrame:
    """Rows (id, key, fields) to one row per id with a map from key to struct.

    A row without a key has no place in the map; its id still gets one.
    """
    entry = F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("key"), F.struct(*fields).alias("value")))
    return df.groupBy(*ids).agg(
        F.map_from_entries(F.array_sort(
            F.collect_list(entry),
            lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0),
        )).alias(name))


def complete_map(nested: Column, names: list[str], fields: list[str]) -> Column:
    """A map of structs with exactly the keys ``names``, in order; what is missing has null fields."""
    none = F.struct(*[F.lit(None).cast("double").alias(f) for f in fields])
    keys = F.array(*[F.lit(n) for n in names])
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.try_element_at(nested, k), none)))


def explode_shares(df: DataFrame, ids: list[str], shares: str) -> DataFrame:
    """Map of party to value into long rows."""
    return df.select(*ids, F.explode(shares).alias("party", "vote_share"))


def tagged_union(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """Union by name; a column says where a row comes from, absent columns are null."""
    out = None
    for name, df in parts.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
