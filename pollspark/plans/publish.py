"""Published documents: daily time series, current snapshot, polls, benchmark.

Rows of unbounded number are JSON lines beside a one-row header; nothing is gathered into one
document that grows with the polls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollspark import dims
from pollspark.functions.dates import grid_start, iso
from pollspark.operators import joins, reshape
from pollspark.schemas import PARTY_COLS

_KEY = {col: key for col, _, key, _ in dims.PARTIES}
_BY_LABEL = {label: (key, color) for _, label, key, color in dims.PARTIES}
DIGITS = 3


def _r3(c: Column | str) -> Column:
    """Three decimals; the last bits of a sum are rounded off first, so that they decide no tie."""
    return F.bround(F.round(c, 9), DIGITS)


def party_key(label: Column) -> Column:
    return dims.map_lookup({k: v[0] for k, v in _BY_LABEL.items()}, label)


def daily_rows(trend: DataFrame, days: DataFrame, origin: str = dims.GRID_ORIGIN,
               step: int = dims.GRID_DAYS, last_t: int | None = None) -> DataFrame:
    """(date, parties: map of key to seven rounded quantiles), one row per day.

    Nesting is done once per period, before a period is spread over its days.
    """
    named = trend.select("t", party_key(F.col("party")).alias("key"),
                         *[_r3(k).alias(k) for k in dims.QUANTILE_KEYS])
    nested = reshape.nest_by_key(named, ["t"], "key", dims.QUANTILE_KEYS, "parties")
    return joins.days_of_periods(days, nested, origin, step, last_t).select(
        iso("date").alias("date"), "parties")


def timeseries_header(daily: DataFrame, elections: DataFrame, parties: list[str], n_draws: int,
                      diagnostics: tuple[int | None, int | None], generated_at: Column) -> DataFrame:
    """One row: metadata, party labels, elections (parties without a result are left out)."""
    keys = [_BY_LABEL[p][0] for p in parties]
    cols = {label: col for col, label, _, _ in dims.PARTIES}
    span = daily.agg(F.count(F.lit(1)).alias("n_days"),
                     F.array(F.min("date"), F.max("date")).alias("date_range"))
    entries = F.array(*[
        F.struct(F.lit(_BY_LABEL[p][0]).alias("key"), _r3(cols[p]).alias("value")) for p in parties])
    results = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    # A few dozen elections.
    held = elections.agg(F.array_sort(F.collect_list(F.struct(
        iso("election_date").alias("date"), F.col("election_year").alias("year"),
        results.alias("results"))), lambda a, b: F.when(a["date"] < b["date"], -1)
        .when(a["date"] > b["date"], 1).otherwise(0)).alias("elections"))
    meta = F.struct(
        F.lit("spline").alias("model"), generated_at.alias("generated_at"),
        F.lit(n_draws).cast("bigint").alias("n_draws"), "n_days", "date_range",
        F.lit(dims.GRID_DAYS).alias("source_period_days"),
        F.array(*[F.lit(k) for k in keys]).alias("parties"), F.lit(True).alias("bsw_in_sonstige"),
        F.array(*[F.lit(q) for q in dims.QUANTILE_LEVELS]).alias("quantiles"),
        F.struct(F.lit(diagnostics[0]).cast("bigint").alias("n_divergent"),
                 F.lit(diagnostics[1]).cast("bigint").alias("max_treedepth_hits")).alias("diagnostics"))
    labels = F.create_map(*[x for p in parties for x in (
        F.lit(_BY_LABEL[p][0]),
        F.struct(F.lit(p).alias("display"), F.lit(_BY_LABEL[p][1]).alias("color")))])
    return span.crossJoin(held).select(
        meta.alias("metadata"), labels.alias("parties"), "elections")


def current_snapshot(trend: DataFrame, polls: DataFrame, as_of: Column, generated_at: Column,
                     origin: str = dims.GRID_ORIGIN, step: int = dims.GRID_DAYS) -> DataFrame:
    """One row: the latest period's parties by median, largest first, and totals of the polls."""
    latest = joins.latest_only(trend, "t")
    color = dims.map_lookup({k: v[1] for k, v in _BY_LABEL.items()}, F.col("party"))
    entry = F.struct(
        party_key(F.col("party")).alias("id"), F.col("party").alias("display"),
        color.alias("color"), *[_r3(k).alias(k) for k in (
            "median", "q05", "q10", "q25", "q75", "q90", "q95")])
    by_median = lambda a, b: (
        F.when(a["median"] > b["median"], -1).when(a["median"] < b["median"], 1)
        .when(a["id"] < b["id"], -1).otherwise(1))
    # One entry per party.
    doc = latest.groupBy("t").agg(F.array_sort(F.collect_list(entry), by_median).alias("parties"))
    day = F.col("date_published")
    meta = polls.agg(
        F.count(F.lit(1)).alias("n_polls_total"),
        F.count_if(day >= F.date_sub(as_of, 30)).alias("n_polls_last_30d"),
        iso(F.max(day)).alias("last_poll_date"),
        F.min_by("pollster", F.struct(-F.unix_date(day), "pollster", "poll_id"))
        .alias("last_poll_pollster"))
    return doc.crossJoin(meta).select(
        iso(grid_start(F.col("t"), origin, step)).alias("date"), F.lit("spline").alias("model"),
        generated_at.alias("generated_at"), "parties",
        F.struct("n_polls_total", "n_polls_last_30d", "last_poll_date", "last_poll_pollster")
        .alias("meta"))


def poll_rows(polls: DataFrame) -> DataFrame:
    """Polls for display: shares 0–1 with three decimals, newest first."""
    cols = [c for c in PARTY_COLS if c in polls.columns]
    return polls.orderBy(F.desc("date_published"), "pollster", "poll_id").select(
        iso("date_published").alias("date"), "pollster", F.col("n").alias("sample_size"),
        *[_r3(F.col(c) / 100).alias(_KEY[c]) for c in cols])


def polls_header(rows: DataFrame, generated_at: Column) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_polls")).select(
        generated_at.alias("generated_at"), "n_polls",
        F.array(*[F.lit(c) for c in rows.columns]).alias("columns"))


def json_lines(rows: DataFrame, keep_nulls: bool = False) -> DataFrame:
    """Every row as one JSON text; nulls are left out unless ``keep_nulls``."""
    options = {"ignoreNullFields": "false"} if keep_nulls else {}
    return rows.select(F.to_json(F.struct(*rows.columns), options).alias("value"))


def write_document(header: DataFrame, rows: DataFrame | None, path: str,
                   keep_nulls: bool = False) -> None:
    """``{path}/header`` with one object and ``{path}/rows`` with one object per line."""
    json_lines(header).write.mode("overwrite").text(f"{path}/header")
    if rows is not None:
        json_lines(rows, keep_nulls).write.mode("overwrite").text(f"{path}/rows")


def export_all(trend: DataFrame, polls: DataFrame, results: DataFrame, days: DataFrame,
               parties: list[str], n_draws: int, diagnostics: tuple[int | None, int | None],
               as_of: Column, generated_at: Column, out: str, last_t: int | None = None,
               origin: str = dims.GRID_ORIGIN) -> None:
    """Write the three published documents."""
    daily = daily_rows(trend, days, origin, last_t=last_t)
    header = timeseries_header(daily, results, parties, n_draws, diagnostics, generated_at)
    write_document(header, daily, f"{out}/timeseries")
    write_document(current_snapshot(trend, polls, as_of, generated_at, origin), None,
                   f"{out}/snapshot")
    rows = poll_rows(polls)
    write_document(polls_header(rows, generated_at), rows, f"{out}/polls", keep_nulls=True)


def benchmark_document(header: dict[str, str], sections: dict[str, DataFrame]) -> DataFrame:
    """One JSON text of a run: header texts and every section as an array of objects.

    Sections are summaries, one row per party, election or parameter.
    """
    doc = None
    for name, df in sections.items():
        one = df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
        doc = one if doc is None else doc.crossJoin(one)
    meta = F.struct(*[F.lit(v).alias(k) for k, v in header.items()])
    return doc.select(F.to_json(F.struct(meta.alias("metadata"), *sections)).alias("value"))


def append_benchmark(sections: dict[str, DataFrame], run_ts: str, out: str) -> None:
    """Append the check tables of one run to a metrics table, one JSON text per row."""
    for name, df in sections.items():
        json_lines(df).withColumns({"section": F.lit(name), "run_ts": F.lit(run_ts)}).write.mode(
            "append").partitionBy("run_ts", "section").parquet(out)
