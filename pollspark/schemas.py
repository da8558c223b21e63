"""Explicit schemas; nothing in the package infers types from text."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical party columns, in output order.
PARTY_COLS = ["cdu_csu", "spd", "gruene", "fdp", "afd", "linke", "bsw", "sonstige"]


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _D, _I, _L, _DT, _B = (
    T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.DateType(), T.BooleanType(),
)

RAW_LONG = _struct(
    ("uuid", _S), ("publishing_date", _DT), ("Befragte", _S), ("Zeitraum", _S), ("mode", _S),
    ("survey_count", _D), ("sampling_start_day", _DT), ("sampling_end_day", _DT),
    ("party", _S), ("vote_share", _D),
)

# Scraped rows before the split by party: one row per poll and page.
RAW_WIDE = _struct(
    ("pollster", _S), ("url", _S), ("row_no", _I), ("publishing_date", _DT), ("Befragte", _S),
    ("Zeitraum", _S), ("shares", T.MapType(_S, _D)), ("mode", _S), ("survey_count", _I),
    ("sampling_start_day", _DT), ("sampling_end_day", _DT), ("uuid", _S),
)

POLLS = _struct(
    ("poll_id", _S), ("pollster", _S), ("date_published", _DT), ("date_start", _DT),
    ("date_end", _DT), ("n", _I), ("method", _S), ("befragte_raw", _S), ("zeitraum_raw", _S),
    *[(c, _D) for c in PARTY_COLS], ("raw_vote_share_sum", _D),
)

REJECTED = T.StructType(POLLS.fields + [T.StructField("rejection_reason", _S, True)])

RESULTS = _struct(("election_year", _I), ("election_date", _DT), *[(c, _D) for c in PARTY_COLS])

POLLSTERS = _struct(
    ("pollster", _S), ("full_name", _S), ("primary_method", _S), ("active", _B), ("n_polls", _L),
    ("first_poll", _DT), ("last_poll", _DT), ("median_n", _D), ("pct_n_known", _D), ("notes", _S),
)

ELECTIONS_WIDE = _struct(
    ("election_year", _I), ("election_date", _DT), ("CDU/CSU", _D), ("SPD", _D), ("GRÜNE", _D),
    ("FDP", _D), ("LINKE", _D), ("AfD", _D), ("REP", _D), ("Sonstige", _D),
)

ELECTIONS_LONG = _struct(
    ("election_year", _I), ("election_date", _DT), ("party", _S), ("vote_share", _D),
)

DISTRICT_VOTES = _struct(
    ("election_year", _I), ("eligible_voters", _L), ("number_voters", _L), ("valid_votes", _L),
    ("cdu", _L), ("csu", _L), ("spd", _L), ("gruene_comb", _L), ("fdp", _L),
    ("linke_pds_comb", _L), ("afd", _L), ("rep", _L),
)

DRAWS = _struct(
    ("chain", _I), ("iter", _I), ("variable", _S), ("i", _I), ("j", _I), ("value", _D),
)

PARTY_ERAS = _struct(("party", _S), ("start_date", _DT), ("end_date", _DT))

CATALOGUE = T.MapType(
    _S, _struct(("current", _S), ("historical", T.MapType(_S, _S))),
)

_QUANTILES = _struct(*[(q, _D) for q in ("q05", "q10", "q25", "median", "q75", "q90", "q95")])

TIMESERIES_DOC = _struct(
    ("metadata", _struct(
        ("model", _S), ("generated_at", _S), ("n_draws", _L), ("n_days", _L),
        ("date_range", T.ArrayType(_S)), ("source_period_days", _I), ("parties", T.ArrayType(_S)),
        ("bsw_in_sonstige", _B), ("quantiles", T.ArrayType(_D)),
        ("diagnostics", _struct(("n_divergent", _L), ("max_treedepth_hits", _L))),
    )),
    ("parties", T.MapType(_S, _struct(("display", _S), ("color", _S)))),
    ("elections", T.ArrayType(_struct(
        ("date", _S), ("year", _I), ("results", T.MapType(_S, _D)),
    ))),
)

TIMESERIES_ROW = _struct(("date", _S), ("parties", T.MapType(_S, _QUANTILES)))

CURRENT_DOC = _struct(
    ("date", _S), ("model", _S), ("generated_at", _S),
    ("parties", T.ArrayType(_struct(
        ("id", _S), ("display", _S), ("color", _S),
        *[(q, _D) for q in ("median", "q05", "q10", "q25", "q75", "q90", "q95")],
    ))),
    ("meta", _struct(
        ("n_polls_total", _L), ("n_polls_last_30d", _L), ("last_poll_date", _S),
        ("last_poll_pollster", _S),
    )),
)

# Columns of a poll in the polls document are those of the parties in the canonical table.
POLLS_DOC = _struct(("generated_at", _S), ("n_polls", _L), ("columns", T.ArrayType(_S)))

POLL_ROW = _struct(("date", _S), ("pollster", _S), ("sample_size", _L), *[(k, _D) for k in (
    "CDU_CSU", "SPD", "GRUENE", "FDP", "AfD", "LINKE", "BSW", "Sonstige")])
