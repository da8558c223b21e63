"""Lookups and time joins.

No join carries a broadcast hint: Spark broadcasts a side only when its size is below
``spark.sql.autoBroadcastJoinThreshold``, and otherwise sorts and merges, where adaptive execution
splits skewed partitions. Facts are aggregated to cells before a join wherever the result allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pollspark.functions.dates import grid_index, grid_index_closed
from pollspark.operators.ordered import ROWS_PER_BIN
from pollspark.session import checkpointed


def missing_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(*on).distinct().join(right.select(*on).distinct(), on, "left_anti")


def unseen(incoming: DataFrame, known: DataFrame, on: str) -> DataFrame:
    return incoming.join(known.select(on).distinct(), on, "left_anti")


def same_keys(rows: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key meets a null key; the key columns are those of ``rows``."""
    theirs = per_key.withColumnsRenamed({k: f"__same_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__same_{k}")) for k in keys])
    return rows.join(theirs, same, how).drop(*[f"__same_{k}" for k in keys])


BROADCAST_BYTES = 8 << 20


def counted_bytes(df: DataFrame) -> int:
    """Bytes of a table's values: 16 for each number, the length of each text and of each nested value as text."""
    text = [F.octet_length(F.col(f"`{c}`").cast("string")) for c, kind in df.dtypes if kind == "string" or "<" in kind]
    size = sum([F.coalesce(t, F.lit(0)) for t in text], F.lit(16 * len(df.columns)))
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def salted_lookup(rows: DataFrame, per_key: DataFrame, keys: list[str], salt_by: list[str],
                  n_rows: int, rows_per_salt: int = ROWS_PER_BIN, nulls_meet: bool = False) -> DataFrame:
    """Inner join of rows with one row per key, for keys that may hold a large part of the rows.

    A lookup side of up to ``BROADCAST_BYTES``, counted, is broadcast, and the rows stay where they
    are. Beyond, every key is split by a hash of ``salt_by``; the lookup row is copied to exactly the (key,
    salt) pairs that occur, so the lookup side never outgrows the rows. A table of ``n_rows``
    within one share is joined as it is. Null keys are dropped as in any equi-join, or find the
    lookup's null key where ``nulls_meet``.
    """
    if not nulls_meet:
        per_key = per_key.dropna(subset=keys)
    salts = -(-n_rows // max(1, rows_per_salt))
    if salts <= 1:
        return same_keys(rows, per_key, keys)
    per_key = checkpointed(per_key)  # written once: it is measured, and then joined
    if counted_bytes(per_key) <= BROADCAST_BYTES:
        return same_keys(rows, F.broadcast(per_key), keys)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)))
    spread = same_keys(salted.select(*keys, "__salt").distinct(), per_key, keys)
    return same_keys(salted, spread, [*keys, "__salt"]).drop("__salt")


def counts_before(facts: DataFrame, day: str, anchors: DataFrame, anchor: str, days: int,
                  count: Column | None = None, name: str = "n") -> DataFrame:
    """Per anchor date the facts of the ``days`` days up to and including it.

    Facts are counted per day first and each anchor is spread over its days, so this is an
    equi-join of a calendar-sized table, not a range join of the facts.
    """
    daily = facts.groupBy(F.col(day).alias("__d")).agg(
        (F.count(F.lit(1)) if count is None else count).alias("__n"))
    spread = anchors.select(
        anchor,
        F.explode(F.sequence(F.date_sub(anchor, days), F.col(anchor))).alias("__d"),
    ).distinct()
    per_anchor = spread.join(daily, "__d", "left").groupBy(anchor).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias(name))
    return anchors.join(per_anchor, anchor, "left")


def within_span(rows: DataFrame, day: str, other: DataFrame, other_day: str) -> DataFrame:
    """Rows whose date lies in the date span of another table (a one-row aggregate)."""
    span = other.agg(F.min(other_day).alias("__lo"), F.max(other_day).alias("__hi"))
    return rows.crossJoin(span).where(
        F.col(day).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def before_cutoff(df: DataFrame, day: str, days: int) -> DataFrame:
    """Rows dated before the latest date less ``days``."""
    top = df.agg(F.max(day).alias("__top"))
    return df.crossJoin(top).where(
        F.col(day) < F.date_sub(F.col("__top"), days)).drop("__top")


def latest_only(df: DataFrame, t: str) -> DataFrame:
    """Rows of the latest period."""
    top = df.agg(F.max(t).alias("__top"))
    return df.join(top, F.col(t) == F.col("__top"), "left_semi")


def days_of_periods(spark_days: DataFrame, trend: DataFrame, origin: str, days: int = 14,
                    last_t: Column | int | None = None) -> DataFrame:
    """Spread period rows over days by an equi-join on the period index.

    With ``last_t`` the closed rule of the daily export applies; otherwise periods are half-open.
    """
    day = F.col("date")
    t = (grid_index(day, origin, days) if last_t is None
         else grid_index_closed(day, origin, last_t, days))
    return spark_days.withColumn("t", t).join(trend, "t")


def era_index(eras: DataFrame, calendar: DataFrame, idx: str) -> DataFrame:
    """Start and end of every era as calendar indexes, with flags for dates outside it."""
    start = calendar.select(F.col("date").alias("start_date"), F.col(idx).alias("idx_start"))
    end = calendar.select(F.col("date").alias("end_date"), F.col(idx).alias("idx_end"))
    return (
        eras.join(start, "start_date", "left").join(end, "end_date", "left")
        .withColumns({
            "always_entered": F.col("idx_start").isNull().cast("int"),
            "never_exited": F.col("idx_end").isNull().cast("int"),
        })
    )


def redirect_residual(rows: DataFrame, flags: DataFrame, on: list[str], party: str, value: str,
                      residual: str, ids: list[str]) -> DataFrame:
    """Move the value of parties a pattern does not report to the residual category.

    ``flags`` holds (on…, party, reported); a party without a flag counts as reported. The total
    per id stays the same.
    """
    joined = rows.join(flags, [*on, party], "left")
    target = F.when(F.coalesce(F.col("reported"), F.lit(1)) == 0, F.lit(residual)).otherwise(
        F.col(party))
    return joined.groupBy(*ids, target.alias(party)).agg(F.sum(value).alias(value))


def shared_units(pairs: DataFrame, source: str, unit: str) -> DataFrame:
    """Per source its units and how many of them another source covers as well.

    Counts sources per unit instead of pairing sources, so a unit that all sources cover costs
    one row per source.
    """
    edges = pairs.select(source, unit).distinct()
    per_unit = edges.groupBy(unit).agg(F.count(F.lit(1)).alias("__s"))
    return edges.join(per_unit, unit).groupBy(source).agg(
        F.count(F.lit(1)).alias("n_units"),
        F.count_if(F.col("__s") > 1).alias("n_shared_units"))


def source_components(pairs: DataFrame, source: str, unit: str) -> DataFrame:
    """Component label per source: sources linked through shared units get one label.

    Effects of sources are identified only inside one component. Labels shrink to the smallest
    name. A round takes the least label over the shared units, then the label of that label, so
    long chains need few rounds; rounds end when no label changes. Each is cut with a checkpoint.
    """
    edges = checkpointed(pairs.select(source, unit).distinct())
    label = edges.groupBy(source).agg(F.min(source).alias("component"))
    while True:
        by_unit = edges.join(label, source).groupBy(unit).agg(F.min("component").alias("__c"))
        near = edges.join(by_unit, unit).groupBy(source).agg(F.min("__c").alias("__c"))
        of_label = label.select(F.col(source).alias("__c"), F.col("component").alias("__next"))
        moved = near.join(of_label, "__c").join(label, source)
        nxt = checkpointed(moved.select(source, F.least("__c", "__next").alias("component"),
                                        (F.least("__c", "__next") != F.col("component")).alias("__moved")))
        label = nxt.drop("__moved")
        if nxt.where("__moved").isEmpty():
            return label


def sorted_positions(keys: DataFrame, key: str, name: str = "position") -> DataFrame:
    """Position from 1 of every distinct key in sorted order; for calendar-sized key lists."""
    return keys.select(key).distinct().withColumn(
        name, F.row_number().over(Window.orderBy(key)))
