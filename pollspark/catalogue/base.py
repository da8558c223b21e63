"""Registry and the shared views of the tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pollspark import dims
from pollspark.functions.dates import grid_index
from pollspark.functions.numeric import sum0

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    fn: QueryFn
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        REGISTRY[name or fn.__name__] = Query(fn, sql)
        return fn
    return register


# Fixed values of the stand-in data.
ORIGIN = "1995-01-01"
LAST_DAY = "2001-12-31"
AS_OF = "2001-11-05"
CUTOFF_T = 150
ELECTIONS = ["1996-03-10", "1997-06-15", "1998-09-27", "1999-10-03", "2000-11-19"]
TYPE_MAP = {"ECONOMY": "economy", "LARGE": "large", "MEDIUM": "medium", "SMALL": "small"}
PARTIES = ["economy", "large", "medium", "small", "other"]
PARTY_IDX = {p: i + 1 for i, p in enumerate(PARTIES)}
LEVELS = dims.QUANTILE_LEVELS
LEVEL_KEYS = dims.QUANTILE_KEYS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def size_of(spark: SparkSession, sf: str, name: str) -> int:
    """Row count of a table; Parquet answers it from the file footers."""
    return table(spark, sf, name).count()


def party_of(p_type: Column) -> Column:
    return dims.map_lookup(TYPE_MAP, p_type, F.lit("other"))


def party_dim(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", party_of(F.col("p_type")).alias("party"))


def line_parties(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Line items with their party."""
    lines = table(spark, sf, "lineitem").select("l_partkey", *cols)
    return lines.join(party_dim(spark, sf), F.col("l_partkey") == F.col("p_partkey")).select(
        *cols, "party")


def votes(spark: SparkSession, sf: str) -> DataFrame:
    """Votes per poll and party."""
    return line_parties(spark, sf, "l_orderkey", "l_quantity").groupBy("l_orderkey", "party").agg(
        sum0(F.col("l_quantity")).alias("votes"))


def orders(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("day"), *cols)


def elections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in ELECTIONS], "d string").select(
        F.to_date("d").alias("election_date"))


def cells(spark: SparkSession, sf: str, *by: Column) -> DataFrame:
    """Votes per cell of order columns, one column per party (null where a party has no line).

    Lines are summed per order first, on the map side. That aggregate and the join with the
    orders share one shuffle on the order key, and only wide rows go through it.
    """
    lines = line_parties(spark, sf, "l_orderkey", "l_quantity")
    wide = lines.groupBy("l_orderkey").agg(*[
        F.sum(F.when(F.col("party") == p, F.col("l_quantity"))).alias(p) for p in PARTIES])
    o = table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    joined = wide.join(o.select("o_orderkey", *by), wide.l_orderkey == o.o_orderkey)
    names = [c for c in joined.columns if c not in ("l_orderkey", "o_orderkey", *PARTIES)]
    return joined.groupBy(*names).agg(*[F.sum(p).alias(p) for p in PARTIES])


def long_cells(wide: DataFrame) -> DataFrame:
    by = [c for c in wide.columns if c not in PARTIES]
    return wide.unpivot(by, PARTIES, "party", "y").where(F.col("y").isNotNull())


def period() -> Column:
    return grid_index(F.col("day"), ORIGIN).alias("t")


def period_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Votes per 14-day period and party: a calendar-sized table."""
    return long_cells(cells(spark, sf, period()))


def draws(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """Line items as draws of the cell (t, party)."""
    lines = line_parties(spark, sf, "l_shipdate", "l_extendedprice", *extra)
    return lines.select(
        grid_index(F.col("l_shipdate").cast("date"), ORIGIN).alias("t"), "party",
        (F.col("l_extendedprice") / 100000).alias("value"), *extra)


def r6(c: Column) -> Column:
    """Round for comparison across engines; adding 0.0 turns -0.0 into 0.0."""
    return F.round(c, 6) + F.lit(0.0)


# ---- SQL fragments -------------------------------------------------------------------------

SQL_PARTY = """CASE p_type WHEN 'ECONOMY' THEN 'economy' WHEN 'LARGE' THEN 'large'
 WHEN 'MEDIUM' THEN 'medium' WHEN 'SMALL' THEN 'small' ELSE 'other' END"""
SQL_PARTY_IDX = """CASE party WHEN 'economy' THEN 1 WHEN 'large' THEN 2 WHEN 'medium' THEN 3
 WHEN 'small' THEN 4 ELSE 5 END"""


def sql_t(day: str) -> str:
    return (f"CAST(floor(date_diff('day', DATE '{ORIGIN}', CAST({day} AS DATE)) / 14.0) AS INTEGER)"
            " + 1")


CTE_VOTES = f"""votes AS (SELECT l_orderkey, {SQL_PARTY} AS party, sum(l_quantity) AS votes
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
CTE_PERIOD = f"""{CTE_VOTES}, period AS (SELECT {sql_t('o_orderdate')} AS t, party, sum(votes) AS y
 FROM votes JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
CTE_SHARE = f"""{CTE_PERIOD}, share AS (SELECT t, party, y, y / sum(y) OVER (PARTITION BY t) AS s
 FROM period)"""
CTE_DRAWS = f"""draws AS (SELECT {sql_t('l_shipdate')} AS t, {SQL_PARTY} AS party,
 l_extendedprice / 100000 AS value, l_linenumber, l_returnflag, l_orderkey, l_quantity
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""
SQL_ELECTIONS = "(VALUES " + ", ".join(f"(DATE '{d}')" for d in ELECTIONS) + ") e(election_date)"


def sql_quantiles(keys: str, source: str, value: str = "value") -> str:
    cols = ", ".join(
        f"quantile_cont({value}, {p}) AS {k}" for p, k in zip(LEVELS, LEVEL_KEYS))
    return f"SELECT {keys}, {cols} FROM {source} GROUP BY {keys}"
