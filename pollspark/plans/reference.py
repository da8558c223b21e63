"""Election results, source registry, coverage checks, election cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pollspark import dims
from pollspark.functions.numeric import residual_share, row_sum
from pollspark.operators import joins, quantiles, reshape
from pollspark.schemas import PARTY_COLS, POLLSTERS, RESULTS

_KNOWN = [c for c in PARTY_COLS if c != dims.RESIDUAL]


def build_results(spark: SparkSession, wide: DataFrame) -> DataFrame:
    """Results per election; the residual closes every row to 1, unfounded parties are null."""
    year = F.col("election_year")
    past = wide.withColumnsRenamed({
        "CDU/CSU": "cdu_csu", "SPD": "spd", "GRÜNE": "gruene", "FDP": "fdp", "LINKE": "linke",
        "AfD": "afd"}).withColumns({
            "afd": F.when(year >= 2013, F.col("afd")),
            "linke": F.when(year >= 1990, F.col("linke"))})
    past = reshape.with_missing_columns(past, ["bsw"]).select(
        "election_year", "election_date", *_KNOWN)
    latest = spark.createDataFrame(
        [tuple(dims.RESULT_2025[c] for c in ("election_year", "election_date", *_KNOWN))],
        "election_year int, election_date string, " + ", ".join(f"{c} double" for c in _KNOWN),
    ).withColumn("election_date", F.to_date("election_date"))
    both = past.unionByName(latest).where(year >= dims.RESULTS_FROM_YEAR)
    return both.withColumn(dims.RESIDUAL, residual_share(_KNOWN)).select(
        *RESULTS.fieldNames()).orderBy("election_date")


def unbalanced(results: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Elections whose shares do not add up to 1."""
    return results.withColumn("row_sum", row_sum(PARTY_COLS)).where(
        F.abs(F.col("row_sum") - 1) > tolerance)


def party_presence(results: DataFrame) -> DataFrame:
    """Number of elections in which each party has a result, most first."""
    long = reshape.to_long(results, ["election_date"], PARTY_COLS, "party", "share")
    return long.groupBy("party").agg(F.count("share").alias("n_elections")).orderBy(
        F.desc("n_elections"), "party")


def build_pollsters(polls: DataFrame, n_rows: int, as_of: Column,
                    meta: DataFrame | None = None) -> DataFrame:
    """Coverage per source joined with its metadata; ``n_rows`` bounds the polls for the median."""
    meta = dims.pollster_dim(polls.sparkSession) if meta is None else meta
    stats = polls.groupBy("pollster").agg(
        F.count(F.lit(1)).alias("n_polls"), F.min("date_published").alias("first_poll"),
        F.max("date_published").alias("last_poll"),
        (F.avg(F.col("n").isNotNull().cast("int")) * 100).alias("pct_n_known"))
    med = quantiles.exact_quantiles(
        polls.withColumn("__n", F.col("n").cast("double")), ["pollster"], "__n", [0.5],
        ["median_n"], n_rows).select("pollster", "median_n")
    active = F.col("last_poll") >= F.date_sub(as_of, dims.ACTIVE_DAYS)
    return stats.join(med, "pollster", "left").join(meta, "pollster", "left").withColumn(
        "active", active).select(*POLLSTERS.fieldNames()).orderBy("pollster")


def without_metadata(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("full_name").isNull()).select("pollster")


def verify_coverage(polls: DataFrame, results: DataFrame, registry: DataFrame) -> DataFrame:
    """Report rows (check, item, n): unregistered sources, party columns, polls before elections."""
    spark = polls.sparkSession
    missing = joins.missing_keys(polls, registry, ["pollster"]).select(
        F.lit("source not registered").alias("check"), F.col("pollster").alias("item"),
        F.lit(None).cast("bigint").alias("n"))
    in_results = set(results.columns) & set(PARTY_COLS)
    in_polls = set(polls.columns) & set(PARTY_COLS)
    odd = ([("party only in results", c, None) for c in sorted(in_results - in_polls)]
           + [("party only in polls", c, None) for c in sorted(in_polls - in_results)])
    columns = spark.createDataFrame(odd, "check string, item string, n bigint")
    near = joins.counts_before(polls, "date_published", results.select("election_date"),
                               "election_date", 30).select(
        F.lit("polls in the 30 days before").alias("check"),
        F.col("election_date").cast("string").alias("item"), "n")
    return missing.unionByName(columns).unionByName(near)


def clean_elections(districts: DataFrame) -> DataFrame:
    """District votes to one row per election: totals, rates, shares, merged and residual parties."""
    total = {"Total_Eligible_Voters": "eligible_voters", "Total_Voters": "number_voters",
             "Total_Valid_Votes": "valid_votes"}
    party = {"CDU": "cdu", "CSU": "csu", "SPD": "spd", "Greens": "gruene_comb", "FDP": "fdp",
             "Left": "linke_pds_comb", "AfD": "afd", "REP": "rep"}
    votes = {p: f"{p}_votes" if p == "REP" else f"{p}_Votes" for p in party}
    agg = districts.groupBy("election_year").agg(
        *[F.sum(c).alias(n) for n, c in total.items()],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(votes[p]) for p, c in party.items()])
    agg = agg.withColumns({
        "Turnout_Rate": F.col("Total_Voters") / F.col("Total_Eligible_Voters"),
        "Valid_Vote_Rate": F.col("Total_Valid_Votes") / F.col("Total_Voters"),
        **{f"{p}_Percent": F.col(votes[p]) / F.col("Total_Valid_Votes") for p in party}})
    pct = lambda p: F.col(f"{p}_Percent")
    agg = agg.withColumns({
        "CDU/CSU": pct("CDU") + pct("CSU"), "SPD": pct("SPD"), "GRÜNE": pct("Greens"),
        "FDP": pct("FDP"), "LINKE": pct("Left"), "AfD": pct("AfD"), "REP": pct("REP")})
    agg = agg.withColumn("Sonstige", residual_share(
        ["CDU/CSU", "SPD", "FDP", "LINKE", "GRÜNE", "AfD", "REP"]))
    return agg.join(dims.election_dates_dim(districts.sparkSession), "election_year", "left")


ELECTION_PARTIES = ["CDU/CSU", "SPD", "GRÜNE", "FDP", "LINKE", "AfD", "REP", "Sonstige"]


def elections_wide(full: DataFrame) -> DataFrame:
    return full.select("election_year", "election_date", *[f"`{p}`" for p in ELECTION_PARTIES])


def elections_long(full: DataFrame) -> DataFrame:
    return elections_wide(full).unpivot(
        ["election_year", "election_date"], [F.col(f"`{p}`") for p in ELECTION_PARTIES],
        "party", "vote_share")
