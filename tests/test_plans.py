"""Composite jobs on literal frames."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pollspark import dims, schemas
from pollspark.functions.dates import day_series
from pollspark.operators import series
from pollspark.plans import canonical, checks, model_input, publish, reference, trend

d = dt.date


def as_of():
    return F.lit("2024-06-01").cast("date")


def raw(spark, polls):
    """polls: (uuid, published, befragte, n, start, end, pollster, file, {party: share})."""
    rows = [(u, p, b, "z", "", n, s, e, party, v, src, f)
            for u, p, b, n, s, e, src, f, shares in polls for party, v in shares.items()]
    fields = list(schemas.RAW_LONG.fields)
    from pyspark.sql import types as T
    schema = T.StructType(fields + [T.StructField("pollster", T.StringType()),
                                    T.StructField("source_file", T.StringType())])
    return spark.createDataFrame(rows, schema)


P = d(2024, 5, 1)
FULL = {"CDU/CSU": 30.0, "SPD": 20.0, "GRÜNE": 15.0, "FDP": 5.0, "AfD": 18.0, "PDS": 2.0, "LINKE": 2.0,
        "FW": 3.0, "Sonstige": 5.0, "Nichtwähler/Unentschl.": 25.0}


@pytest.fixture(scope="module")
def raw_polls(spark):
    return raw(spark, [
        ("u1", P, "T• 1.004", 1004.0, P, P, "Forsa", "current.csv", FULL),
        ("u2", P, "T• 1.004", 1004.0, P, P, "Forsa", "historical.csv", FULL),
        ("u3", P, "O • 2.000", 2000.0, P, P, "INSA", "current.csv", {**FULL, "BSW": None, "neu": 0.5}),
        ("u4", P, "?", 0.0, P, P, "INSA", "current.csv", FULL),
        ("u5", None, None, None, None, None, "GMS", "current.csv", {"SPD": 50.0, None: 1.0}),
    ])


def test_canonicalize(spark, raw_polls, tmp_path):
    polls, rejected = canonical.canonicalize(raw_polls, as_of(), str(tmp_path))
    got = {r.pollster: r for r in polls.collect()}
    assert polls.columns == schemas.POLLS.fieldNames() and set(got) == {"Forsa", "INSA"}
    f = got["Forsa"]
    assert (f.linke, f.sonstige, f.bsw, f.raw_vote_share_sum, f.method, f.n) == (4.0, 8.0, None, 100.0, "phone", 1004)
    assert (got["INSA"].bsw, got["INSA"].sonstige, got["INSA"].method) == (0.0, 8.5, "online")
    bad = {r.pollster: r.rejection_reason for r in spark.read.parquet(f"{tmp_path}/rejected_polls").collect()}
    assert bad == {
        "INSA": "V2: n=0 outside [500,50000]",
        "GMS": "V1: vote_share_sum=51.0 outside [95,105]; V3: date validity check failed; "
               "V5: null in required field (pollster/date_published)"}
    assert rejected.count() == 2


def test_harmonise_then_pivot_equals_one_shuffle(raw_polls):
    from pollspark.operators.reshape import to_wide
    two = to_wide(canonical.harmonise(raw_polls), ["uuid"], "party_canonical", "vote_share", schemas.PARTY_COLS)
    one = canonical.to_wide(raw_polls).select("uuid", *schemas.PARTY_COLS)
    assert sorted(map(str, two.collect())) == sorted(map(str, one.collect()))


def test_load_long(spark, raw_polls):
    valid, _ = canonical.split(canonical.checked(raw_polls, as_of()))
    long = canonical.load_long(valid, dims.MODEL_PARTIES)
    assert {r.party for r in long.select("party").distinct().collect()} == set(dims.MODEL_PARTIES)
    assert long.count() == 2 * 7
    assert canonical.load_long(valid).count() == 2 * 8


def test_migrate_ids(spark, raw_polls):
    old = raw_polls.drop("source_file").where("party is not null")
    new = canonical.migrate_ids(old)
    assert new.where(~F.col("uuid").rlike("^[0-9a-f]{64}$")).count() == 0
    # u1 and u2 are one poll; the poll with missing keys stays.
    assert new.select("uuid").distinct().count() == 4
    again = canonical.migrate_ids(new)
    assert sorted(map(str, again.collect())) == sorted(map(str, new.collect()))


ELECTIONS = [
    (1987, d(1987, 1, 25), .44, .37, .08, .09, 0.0, 0.0, 0.0, .02),
    (2009, d(2009, 9, 27), .338, .230, .107, .146, .119, 0.0, .01, .05),
    (2021, d(2021, 9, 26), .241, .257, .148, .115, .049, .103, 0.0, .087)]


def test_build_results(spark):
    wide = spark.createDataFrame(ELECTIONS, schemas.ELECTIONS_WIDE)
    res = reference.build_results(spark, wide)
    rows = res.collect()
    assert [r.election_year for r in rows] == [2009, 2021, 2025]
    assert rows[0].afd is None and rows[1].afd == 0.103 and rows[1].bsw is None
    assert rows[2].sonstige == pytest.approx(0.045)
    assert rows[0].sonstige == pytest.approx(1 - .338 - .230 - .107 - .146 - .119)
    assert reference.unbalanced(res).count() == 0
    n = {r.party: r.n_elections for r in reference.party_presence(res).collect()}
    assert (n["afd"], n["bsw"], n["spd"]) == (2, 1, 3)


def test_registry_and_coverage(spark):
    rows = [("a", "GMS", d(2024, 5, 1), 1000), ("b", "GMS", d(2010, 5, 1), None), ("c", "New", d(2009, 9, 1), 500)]
    polls = spark.createDataFrame(rows, "poll_id string, pollster string, date_published date, n int")
    reg = reference.build_pollsters(polls, 3, as_of())
    got = {r.pollster: r for r in reg.collect()}
    assert got["GMS"].active and not got["New"].active and got["New"].full_name is None
    assert (got["GMS"].n_polls, got["GMS"].median_n, got["GMS"].pct_n_known) == (2, 1000.0, 50.0)
    assert [r.pollster for r in reference.without_metadata(reg).collect()] == ["New"]
    res = reference.build_results(spark, spark.createDataFrame(ELECTIONS, schemas.ELECTIONS_WIDE))
    report = reference.verify_coverage(polls, res, reg.where("pollster <> 'New'")).collect()
    assert ("source not registered", "New", None) in [tuple(r) for r in report]
    near = {r.item: r.n for r in report if r.check.startswith("polls in")}
    assert near == {"2009-09-27": 1, "2021-09-26": 0, "2025-02-23": 0}
    assert sum(r.check == "party only in results" for r in report) == 8


def test_clean_elections(spark):
    rows = [(2021, 100, 80, 50, 10, 5, 12, 7, 5, 2, 5, None), (2021, 100, 70, 50, 10, 5, 13, 8, 6, 3, 5, 1)]
    full = reference.clean_elections(spark.createDataFrame(rows, schemas.DISTRICT_VOTES))
    r = full.first()
    assert (r.Total_Eligible_Voters, r.Turnout_Rate, r.Valid_Vote_Rate) == (200, 0.75, 100 / 150)
    assert r["CDU/CSU"] == pytest.approx(0.3) and r.election_date == d(2021, 9, 26) and r.REP_votes == 1
    long = reference.elections_long(full)
    assert long.count() == 8 and long.agg(F.sum("vote_share")).first()[0] == pytest.approx(1)
    assert reference.elections_wide(full).columns[2:] == reference.ELECTION_PARTIES


def model_long(spark):
    def poll(uid, day, n, **over):
        base = {"CDU/CSU": 30.0, "SPD": 25.0, "GRÜNE": 20.0, "FDP": 5.0, "AfD": None, "LINKE": 10.0, "Sonstige": 10.0}
        return [(uid, day, n, "A", p, v) for p, v in {**base, **over}.items()]
    data = (poll("p1", d(1998, 1, 1), 1000) + poll("p2", d(1998, 1, 14), 333) + poll("p3", d(1998, 1, 15), 1000)
            + poll("p4", d(1998, 1, 2), 1000, SPD=0.0) + poll("p5", d(1998, 1, 2), None)
            + poll("p6", d(1997, 12, 31), 1000) + poll("p7", d(1998, 1, 3), 1000, FDP=None))
    return spark.createDataFrame(
        data, "uuid string, publishing_date date, survey_count int, pollster string, party string, vote_share double")


def test_model_input(spark):
    usable = model_input.usable_polls(model_long(spark), "1998-01-01", "1998-12-31")
    assert {r.uuid for r in usable.select("uuid").distinct().collect()} == {"p1", "p2", "p3", "p5"}
    counts = model_input.poll_counts(usable, dims.MODEL_PARTIES)
    got = {r.uuid: r for r in counts.collect()}
    assert set(got) == {"p1", "p2", "p3"} and got["p2"]["SPD"] == 83 and got["p1"]["AfD"] == 0
    agg = {r.t: r for r in model_input.period_counts(counts, dims.MODEL_PARTIES).collect()}
    assert agg[1]["SPD"] == 333 and agg[2]["CDU/CSU"] == 300
    res = spark.createDataFrame([(1998, d(1998, 9, 27), .35, .41, .07, .06, None, .05, None, .06)], schemas.RESULTS)
    e = model_input.election_shares(res, "1998-01-01", "1999-01-01", dims.MODEL_PARTIES, 30)
    r = e.first()
    assert r.t == 20 and r["AfD"] == pytest.approx(0.001 / 1.001)
    assert sum(r[p] for p in dims.MODEL_PARTIES) == pytest.approx(1)
    assert model_input.knots(e, 30) == [20] and model_input.knots(e, 20) == []
    pos = {r.t: r.obs_idx for r in model_input.observed_periods(counts, e).collect()}
    assert pos == {1: 1, 2: 2, 20: 3}


def test_older_input_path(spark):
    long = model_long(spark)
    parties = dims.MODEL_PARTIES
    df = model_input.transform_polls(long, "1998-01-01", "1998-12-31", parties)
    assert {r.uuid for r in df.select("uuid").distinct().collect()} == {"p2", "p3", "p4", "p5", "p7"}
    mean = (1000 * 5 + 333) / 6  # over all rows, also those outside the window
    assert df.where("uuid = 'p5'").first().survey_count == pytest.approx(mean)
    pat = model_input.with_pattern(df, parties, "Sonstige")
    cal = model_input.calendar(spark, "1998-01-01", "1998-12-31")
    rounding = spark.createDataFrame([("A", 0.5)], "pollster string, rounding double")
    s = model_input.survey_counts(pat, parties, cal, rounding, 100, days_cutoff=0)
    got = {r.uuid: r for r in s.collect()}
    assert sorted(r.survey_idx for r in got.values()) == list(range(1, 5))
    assert got["p7"]["FDP"] is None and got["p2"]["SPD"] == 83 and got["p2"].rounding == 0.5
    ranges = model_input.pattern_ranges(s).collect()
    assert sum(r.last - r.first + 1 for r in ranges) == 4
    per = {r.party: r["count"] for r in model_input.presence(s, parties).groupBy("party").count().collect()}
    assert per["CDU/CSU"] == 4 and per["FDP"] == 3 and per["SPD"] == 3 and "AfD" not in per


def test_calendar_layers(spark):
    cal = model_input.calendar(spark, "2024-01-01", "2024-02-29")
    rows = {r.date: r for r in cal.collect()}
    assert len(rows) == 60
    assert [rows[d(2024, 1, k)].layer1_aggregate_idx for k in (1, 14, 15, 28, 29, 31)] == [1, 1, 2, 2, 3, 3]
    assert [rows[d(2024, 1, k)].layer2_aggregate_idx for k in (1, 28, 29)] == [1, 1, 2]
    assert rows[d(2024, 2, 1)].layer1_aggregate_idx == 4


@pytest.fixture(scope="module")
def drawn(spark):
    """Share draws of 3 periods and 7 parties, with their names."""
    rng = np.random.default_rng(5)
    rows = []
    for chain in range(4):
        for it in range(50):
            for t in range(1, 4):
                p = rng.dirichlet(np.array([30, 20, 15, 6, 15, 6, 8]) * 20)
                rows += [(chain, it, f"pi[{t},{j + 1}]", float(v)) for j, v in enumerate(p)]
    return spark.createDataFrame(rows, "chain int, iter int, variable string, value double").cache()


@pytest.fixture(scope="module")
def trended(drawn):
    return trend.trend_table(trend.parse_names(drawn), dims.MODEL_PARTIES, 4200).cache()


def test_trend(drawn, trended):
    rows = trended.collect()
    assert len(rows) == 21 and {r.date for r in rows} == {d(1998, 1, 1), d(1998, 1, 15), d(1998, 1, 29)}
    for r in rows:
        q = [r[k] for k in dims.QUANTILE_KEYS]
        assert q == sorted(q)
    one = [r.value for r in drawn.where("variable = 'pi[2,5]'").collect()]
    got = trended.where("t = 2 and party = 'AfD'").first()
    assert np.allclose([got[k] for k in dims.QUANTILE_KEYS], np.quantile(one, dims.QUANTILE_LEVELS))


def test_daily_shares_keep_every_day(spark, trended):
    cal = model_input.calendar(spark, "1998-01-01", "1998-03-31")
    out = trend.daily_shares(trended, cal)
    assert out.select("date").distinct().count() == 90
    assert out.where("party is null").count() > 0


def test_published_documents(spark, trended, tmp_path):
    """The published documents keep the invariants of their consumers."""
    polls = spark.createDataFrame([
        ("b", "GMS", d(2024, 5, 1), None, None, 1000, "phone", None, None, 30.0, 20.0, 15.0, 5.0, 18.0, 4.0, None, 8.0, 100.0),
        ("a", "INSA", d(2024, 5, 1), None, None, None, "online", None, None, 30.0, 20.0, 15.0, 5.0, 18.05, 4.0, 2.0, 6.0, 100.0),
        ("c", "INSA", d(2020, 5, 1), None, None, 900, "online", None, None, 30.0, 20.0, 15.0, 5.0, 18.0, 4.0, None, 8.0, 100.0),
    ], schemas.POLLS)
    res = spark.createDataFrame([(1998, d(1998, 1, 20), .35, .41, .07, .06, None, .05, None, .06)], schemas.RESULTS)
    days = day_series(spark, "1998-01-01", "1998-02-11")
    now = F.lit("2024-06-01T00:00:00+0000")
    publish.export_all(trended, polls, res, days, dims.MODEL_PARTIES, 200, (1, None), as_of(), now, str(tmp_path), last_t=3)

    head = spark.read.schema(schemas.TIMESERIES_DOC).json(f"{tmp_path}/timeseries/header").first()
    keys = ["CDU_CSU", "SPD", "GRUENE", "FDP", "AfD", "LINKE", "Sonstige"]
    m = head.metadata
    assert (m.model, m.n_days, m.source_period_days, m.bsw_in_sonstige, m.n_draws) == ("spline", 42, 14, True, 200)
    assert m.generated_at and len(m.quantiles) == 7 and m.parties == keys
    assert m.date_range == ["1998-01-01", "1998-02-11"]
    assert (m.diagnostics.n_divergent, m.diagnostics.max_treedepth_hits) == (1, None)
    assert set(head.parties) == set(keys) and all(v.display and v.color[0] == "#" for v in head.parties.values())
    assert head.elections[0].date == "1998-01-20" and "AfD" not in head.elections[0].results
    assert head.elections[0].results["SPD"] == 0.41

    rows = spark.read.schema(schemas.TIMESERIES_ROW).json(f"{tmp_path}/timeseries/rows")
    got = {r.date: r.parties for r in rows.collect()}
    assert len(got) == 42
    first = d(1998, 1, 1)
    assert sorted(got) == [(first + dt.timedelta(i)).isoformat() for i in range(42)]
    for parties in got.values():
        assert set(parties) == set(keys)
        for q in parties.values():
            v = [q[k] for k in dims.QUANTILE_KEYS]
            assert v == sorted(v) and all(round(x, 3) == x for x in v)
    assert got["1998-01-29"] == got["1998-01-28"] != got["1998-01-30"]  # closed last break

    cur = spark.read.schema(schemas.CURRENT_DOC).json(f"{tmp_path}/snapshot/header").first()
    med = [p.median for p in cur.parties]
    assert len(med) == 7 and med == sorted(med, reverse=True) and all(0 <= x <= 1 for x in med)
    assert cur.date == "1998-01-29" and all(p.id and p.display and p.color[0] == "#" for p in cur.parties)
    assert (cur.meta.n_polls_total, cur.meta.n_polls_last_30d, cur.meta.last_poll_date, cur.meta.last_poll_pollster) == (
        3, 0, "2024-05-01", "GMS")

    head = json.loads(spark.read.text(f"{tmp_path}/polls/header").first().value)
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/polls/rows").collect()]
    assert head["n_polls"] == len(lines) == 3 and "BSW" in head["columns"]
    by = {(x["pollster"], x["date"]): x for x in lines}
    gms = by["GMS", "2024-05-01"]
    assert gms["BSW"] is None and "sample_size" in by["INSA", "2024-05-01"] and gms["CDU_CSU"] == 0.3
    assert by["INSA", "2024-05-01"]["AfD"] == 0.18  # 0.1805 to three places, half to even
    assert [x["date"] for x in lines] == sorted((x["date"] for x in lines), reverse=True)


def test_benchmark_appends(spark, tmp_path):
    df = spark.createDataFrame([("SPD", 0.9)], "party string, coverage_90 double")
    for ts in ("r1", "r2"):
        publish.append_benchmark({"election": df, "ppc": df}, ts, f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").count() == 4


def test_retrodictive_checks(spark, drawn):
    x = trend.parse_names(drawn)
    idx = model_input.party_index(spark, dims.MODEL_PARTIES)
    dr = x.join(idx, x.j == idx.party_idx).select(F.col("i").alias("t"), "party", "value", "chain", "iter")
    e = spark.createDataFrame([(d(1998, 1, 20), 2, "SPD", 0.2), (d(1998, 1, 20), 2, "FDP", 0.9)],
                              "election_date date, t int, party string, actual double")
    cov = {r.party: r for r in checks.coverage(checks.election_recovery(dr, e, 4200)).collect()}
    assert cov["SPD"].coverage_90 == 1 and cov["FDP"].coverage_90 == 0 and cov[None].coverage_90 == 0.5
    obs = dr.groupBy("t", "party").agg(F.avg("value").alias("share"))
    s = {r.party: r for r in checks.residual_summary(checks.residuals(obs, dr, 4200)).collect()}
    assert len(s) == 7 and all(abs(r.mean_residual) < 0.01 and r.rmse >= 0 for r in s.values())
    h = {(r.i, r.j): r.rhat for r in checks.rhat(x).collect()}
    assert len(h) == 21 and all(0.9 < v < 1.2 for v in h.values())


def test_pit_and_ppc_treat_ties_apart(spark):
    rep = spark.createDataFrame([("s", "A", 5, 5), ("s", "A", 6, 5), ("s", "A", 4, 5), ("s", "A", -1, 5)],
                                "survey string, party string, y_rep int, y int")
    ok = rep.where("y_rep >= 0")
    assert checks.pit(ok, ["survey", "party"]).first().pit == pytest.approx(2 / 3)
    assert checks.ppc_p_value(rep, ["party"]).first().p_value == pytest.approx(1 / 3)
    pits = spark.createDataFrame([("A", -1, 0.5), ("A", 3, 0.97), ("A", 3, None), ("A", 30, 0.06)],
                                 "party string, horizon int, pit double")
    got = {r.horizon_bin: (r.coverage_50, r.coverage_90, round(r.bias, 6), r.n_obs) for r in checks.pit_coverage(pits).collect()}
    assert got == {"fit": (1.0, 1.0, 0.0, 1), "1-4w": (0.0, 0.0, 0.47, 1), ">26w": (0.0, 1.0, -0.44, 1)}


def test_calibration_elpd_and_models(spark):
    rows = [(o, "A", 0.5, i / 100) for o in (1, 2) for i in range(101)] + [(3, "A", 0.99, i / 100) for i in range(101)]
    reps = spark.createDataFrame(rows, "obs_idx int, party string, observed double, simulated double")
    assert checks.predictive_calibration(reps, 303).first().coverage_90 == pytest.approx(2 / 3)
    ll = spark.createDataFrame([(1, 0, -1.0), (1, 0, -3.0), (2, 0, -4.0), (3, 5, -7.0)], "survey_idx int, horizon int, value double")
    got = {r.horizon_bin: (r.elpd_mean, r.n_obs, r.elpd_per_obs) for r in checks.elpd_by_horizon(ll).collect()}
    assert got == {"fit": (-6.0, 2, -3.0), "5-12w": (-7.0, 1, -7.0)}
    run = lambda s: spark.createDataFrame([(s, 1, 0, 400.0, 1.01), (s, 2, 1, 300.0, 1.02)],
                                          "seconds double, n_divergent int, depth_hits int, ess double, rhat double")
    cmp = {r.model: tuple(r)[1:] for r in checks.compare_models({"rw": run(1.0), "spline": run(2.0)}).collect()}
    assert cmp == {"rw": (2.0, 3, 1, 300.0, 1.02), "spline": (4.0, 3, 1, 300.0, 1.02)}
    prof = spark.createDataFrame([(c, n, t, t / 2, t / 2, 10) for c in (1, 2) for n, t in (("lik", 3.0), ("prior", 1.0))],
                                 "chain int, name string, total_time double, forward_time double, reverse_time double, autodiff_calls long")
    r = checks.profile_summary(prof).collect()
    assert [x.name for x in r] == ["lik", "prior"] and r[0].pct_total_time == 75 and r[0].time_per_call_us == pytest.approx(3e5)


def test_parameter_recovery_and_changes(spark):
    dr = spark.createDataFrame([("tau", None, None, 1.0), ("tau", None, None, 3.0), ("pi", 1, 2, 0.5)],
                               "variable string, i int, j int, value double")
    truth = spark.createDataFrame([("tau", None, None, 2.5), ("pi", 1, 2, 0.4)], "variable string, i int, j int, true_value double")
    got = {r.variable: (r.true_value, r["mean"]) for r in checks.parameter_recovery(dr, truth).collect()}
    assert got == {"tau": (2.5, 2.0), "pi": (0.4, 0.5)}
    ch = spark.createDataFrame([(1, 0.2), (1, -0.3), (1, 0.1), (2, 0.0)], "t int, delta double")
    assert {r.t: round(r.change_prob, 3) for r in checks.change_probability(ch).collect()} == {1: 0.667, 2: 0.0}
    dv = spark.createDataFrame([(1, 1, 2.0, True), (1, 1, -4.0, True), (1, 2, 0.0, False)], "chain int, iter int, value double, divergent boolean")
    got = {r.iter: (r.max_abs, r.ratio, r.divergent) for r in checks.divergence_profile(dv).collect()}
    assert got == {1: (4.0, 2.0, True), 2: (0.0, None, False)}


def test_house_effects_sum_to_zero(spark):
    rnd = random.Random(1)
    data = [(s, u, b + u / 10 + rnd.random() / 100) for s, b in (("a", 0.0), ("b", 1.0), ("c", -0.5)) for u in range(5)]
    df = spark.createDataFrame(data, "s string, u int, v double")
    h = {r.s: r.house_effect for r in checks.house_effects(df, "s", "u", "v").collect()}
    assert sum(h.values()) == pytest.approx(0) and h["b"] > h["a"] > h["c"]


def test_softmax_and_path(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 900.0), (2, "b", 900.0)], "t int, party string, x double")
    out = series.softmax_rows(df, ["t"], "x")
    assert all(abs(r.s - 1) < 1e-12 for r in out.groupBy("t").agg(F.sum("share").alias("s")).collect())
    basis = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5)], "t int, k int, b double")
    beta = spark.createDataFrame([(9, 0, "a", 2.0), (9, 1, "a", 4.0)], "draw int, k int, party string, beta double")
    assert trend.spline_path(basis, beta).first().alpha == 3.0
    assert trend.path_shares(basis, beta).first().share == 1.0


def test_composite_checks(spark, drawn):
    x = trend.parse_names(drawn)
    idx = model_input.party_index(spark, dims.MODEL_PARTIES)
    dr = x.join(idx, x.j == idx.party_idx).select(F.col("i").alias("t"), "party", "value")
    e = spark.createDataFrame([(d(1998, 1, 20), 2, "SPD", 0.2)], "election_date date, t int, party string, actual double")
    obs = dr.groupBy("t", "party").agg(F.avg("value").alias("share"))
    reps = spark.createDataFrame([(1, "A", 0.5, i / 10) for i in range(11)],
                                 "obs_idx int, party string, observed double, simulated double")
    out = checks.retrodictive(dr, e, obs, reps, 4200, 11)
    doc = json.loads(publish.benchmark_document({"model_name": "spline"}, {
        "residuals": out["residuals"], "ppc": out["ppc"], "recovery": out["election_recovery"]}).first().value)
    assert doc["metadata"]["model_name"] == "spline" and len(doc["residuals"]) == 7
    assert doc["ppc"] == [{"party": "A", "coverage_90": 1.0}]
    ll = spark.createDataFrame([(1, 0, -1.0)], "survey_idx int, horizon int, value double")
    rep = spark.createDataFrame([(1, "A", 0, 5, 5), (1, "A", 0, 4, 5)], "survey_idx int, party string, horizon int, y_rep int, y int")
    mse = spark.createDataFrame([("mse_fit", 1, None, 0.1), ("mse_fit", 1, None, 0.3)], "variable string, i int, j int, value double")
    h = checks.by_horizon(ll, rep, mse)
    assert h["elpd"].first().elpd_per_obs == -1.0 and h["coverage"].first().coverage_50 == 1.0
    assert h["mse"].first()["mean"] == pytest.approx(0.2)
    s = checks.sampler_totals(spark.createDataFrame([(1, 2), (3, 0)], "num_divergent int, num_max_treedepth int")).first()
    assert tuple(s) == (4, 2)


def test_series_operators(spark):
    df = spark.createDataFrame([("a", t, float(v)) for t, v in ((1, 1), (2, 3), (3, 2), (5, 6))], "k string, t int, v double")
    r = series.roughness(df, ["k"], "t", "v").first()
    assert (r.roughness, r.max_d2, r.rises, r.gaps) == (4.0, 5.0, 2, 1)
    w = series.weighted_trailing(df, ["k"], "t", "v", [0.5, 0.25], "w").orderBy("t").collect()
    assert [x.w for x in w] == [0.0, 0.5, 1.75, 1.75]
    p = series.path(df, ["k"], "t", "v", "p").orderBy("t").collect()
    assert [x.p for x in p] == [1, 4, 6, 12]
    q = series.fit_quality(df.withColumn("f", F.col("v") + 0.5), ["k"], "v", "f").first()
    assert q.max_abs_error == 0.5 and q.r == pytest.approx(1) and q.r2 == pytest.approx(1 - 1 / 14)
    a = spark.createDataFrame([([1.0, 2.0], [0.5, 1.0], [0.1, -0.1])], "e array<double>, l array<double>, x array<double>")
    lng, short = series.long_short_shares(F.col("l"), F.col("e"))
    got = a.select(lng.alias("lng"), short.alias("short"), series.share_error(F.col("e"), F.col("x")).alias("err")).first()
    sm = lambda z: np.exp(z) / np.exp(z).sum()
    assert np.allclose(np.array(got.lng) + np.array(got.short), sm(np.array([1.0, 2.0])))
    assert np.allclose(got.err, sm(np.array([1.1, 1.9])) - sm(np.array([1.0, 2.0])))


def test_pattern_exclusion(spark):
    df = spark.createDataFrame([("u1", "A", 1.0), ("u1", "R", 1.0), ("u2", "R", 2.0), ("u3", "A", 1.0)],
                               "uuid string, party string, vote_share double")
    out = model_input.with_pattern(df, ["A", "R"], "R")
    assert {r.uuid: (r.pattern, r.pattern_idx) for r in out.collect()} == {"u1": ("A | R", 1), "u2": ("R", 2)}
    assert {r.uuid for r in model_input.with_pattern(df, ["A", "R"], "R", "A | R").collect()} == {"u2"}


def test_document_rules(spark):
    """Each kind of rule on one broken document; a sound one has no finding."""
    from pollspark import schemas
    from pollspark.operators import documents as D

    good = '{"date":"2024-01-01","parties":{"A":{"q05":0.1,"q10":0.2,"q25":0.2,"median":0.3,"q75":0.4,"q90":0.5,"q95":0.6}}}'
    bad = good.replace('"q10":0.2', '"q10":0.25').replace('"q95":0.6', '"q95":0.6004').replace('"A"', '"B"').replace("2024-01-01", "2024-01-03")
    texts = spark.createDataFrame([(good,), (bad,), ("{not json",), (None,)], "value string")
    docs = D.parsed(texts, schemas.TIMESERIES_ROW)
    rules = [D.readable(), D.exactly_keys("parties", ["A"]), D.each("parties", D.ascending(dims.QUANTILE_KEYS), D.decimals(dims.QUANTILE_KEYS, 3))]
    found = sorted(tuple(r) for r in D.check(docs, "doc", rules, F.coalesce("doc.date", F.lit("?"))).collect())
    assert found == sorted([
        ("keys", "2024-01-03.parties", "without A; besides B"), ("ascending", "2024-01-03.parties[B]", "q10>q25"),
        ("decimals", "2024-01-03.parties[B]", "q95"), ("readable", "?", "not a document"), ("readable", "?", "not a document"),
        ("keys", "?.parties", "missing"), ("keys", "?.parties", "missing")])
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-03",), ("2024-01-03",), (None,)], "d string").selectExpr("cast(d AS date) AS d")
    found = {(r.rule, r.place, r.found) for r in D.steps(days, "d", lambda d: d.cast("string")).collect()}
    assert found == {("once", "2024-01-03", "2"), ("no gaps", "2024-01-01", "no next day")}
    assert D.steps(days.limit(0), "d", lambda d: d.cast("string")).count() == 0
    rows = spark.createDataFrame([(0, 5), (1, 3), (2, 4)], "p int, v int")
    assert [tuple(r) for r in D.in_order(rows, "p", "v", True, lambda p: p.cast("string")).collect()] == [("in order", "2", "3 then 4")]
