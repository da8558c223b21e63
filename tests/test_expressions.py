"""Column expressions on literal rows."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pollspark import dims
from pollspark.functions import dates, hashing, numeric as N, text as X
from pollspark.schemas import PARTY_COLS

d = dt.date


def column(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_sample_size(spark):
    raw = ["2.004", "?", "TOM• 1.004", "T• 1.001", "?.500", "O • 850", "abc", None, "."]
    assert column(spark, X.sample_size, raw) == [2004, 0, 1004, 1001, 1500, 850, None, None, None]


def test_mode_and_method(spark):
    raw = ["T• 1.001", "TOM• 5", "O 7", "1.000", None, "XY 3", "3 T"]
    assert column(spark, X.mode_code, raw) == ["T", "TOM", "O", "", "", "XY", "T"]
    assert column(spark, X.survey_method, raw) == [
        "phone", "mixed", "online", "unknown", "unknown", "unknown", "unknown"]


def test_percent_and_blank(spark):
    assert column(spark, X.percent_value, ["36,3 %", "6%", " 4,5 % ", "–", None, "x"]) == [
        36.3, 6.0, 4.5, None, None, None]
    assert column(spark, X.blank_to_null, [" a ", "", "–", "  ", None]) == ["a", None, None, None, None]


def test_headers(spark):
    raw = ["CDU /  CSU", "SPD", " ", "GRÜNE*", "Nichtwähler/\nUnentschl."]
    assert column(spark, X.header_name, raw) == [
        "CDU/CSU", "SPD", "Empty", "GRÜNE", "Nichtwähler/ Unentschl"]


def test_number_text(spark):
    values = [36.3, 6.0, 0.0, 0.5, 88.89999999999999, 0.1 + 0.2, 100.0, 10.05, None]
    assert column(spark, X.number_text, values, "double") == [
        "36.3", "6", "0", "0.5", "88.9", "0.3", "100", "10.05", None]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.integers(0, 100000), min_size=200, max_size=200))
def test_number_text_is_shortest(spark, ints):
    values = [i / 1000 for i in ints]
    assert column(spark, X.number_text, values, "double") == [f"{v:.15g}" for v in values]


@pytest.mark.parametrize("href,want", [
    ("/a/b", "http://x.de/a/b"), ("b.htm", "http://x.de/u/b.htm"), ("./b.htm", "http://x.de/u/b.htm"),
    ("../c.htm", "http://x.de/c.htm"), ("//y.de/z", "http://y.de/z"), ("https://q.de", "https://q.de"),
    ("#top", "http://x.de/u/a.htm?k=1#top"), ("?p=2", "http://x.de/u/a.htm?p=2"),
    ("", "http://x.de/u/a.htm?k=1")])
def test_absolute_url(spark, href, want):
    url = X.absolute_url(F.lit("http://x.de/u/a.htm?k=1"), F.lit(href))
    assert spark.range(1).select(url.alias("u")).first().u == want


def test_dotted_date(spark):
    assert column(spark, dates.dotted_date, ["01.02.2024", "1.2.2024", "31.02.2024", "n. a.", None]) == [
        d(2024, 2, 1), d(2024, 2, 1), None, None, None]


def test_field_period(spark):
    rows = [
        ("27.12.–02.01.", d(2024, 1, 5), d(2023, 12, 27), d(2024, 1, 2)),
        ("01.10.–16.10.", d(2013, 10, 23), d(2013, 10, 1), d(2013, 10, 16)),
        ("??.??.–16.10.", d(2013, 10, 23), None, d(2013, 10, 16)),
        ("bis 16.10.", d(2013, 10, 23), None, d(2013, 10, 16)),
        ("31.02.–16.10.", d(2013, 10, 23), None, None),
        ("24.06.–06.06.", d(2007, 6, 13), d(2007, 6, 24), d(2007, 6, 6)),
        ("01.10.–16.10.", None, None, None), (None, d(2013, 10, 23), None, None), ("x", d(2013, 10, 23), None, None)]
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i int, x string, p date")
    s, e = dates.field_period(F.col("x"), F.col("p"))
    got = df.select("i", s.alias("s"), e.alias("e")).orderBy("i").collect()
    assert [(r.s, r.e) for r in got] == [(r[2], r[3]) for r in rows]


def test_two_grids_differ(spark):
    days = [d(1998, 1, 1), d(1998, 1, 14), d(1998, 1, 15), d(1998, 2, 1), d(1997, 12, 31)]
    assert column(spark, lambda x: dates.grid_index(x, "1998-01-01"), days, "date") == [1, 1, 2, 3, 0]
    months = [d(2024, 1, 14), d(2024, 1, 15), d(2024, 1, 29), d(2024, 1, 31), d(2024, 2, 1)]
    assert column(spark, lambda x: dates.month_floor(x, 14), months, "date") == [
        d(2024, 1, 1), d(2024, 1, 15), d(2024, 1, 29), d(2024, 1, 29), d(2024, 2, 1)]


def test_closed_last_break(spark):
    # Three periods start on day 0, 14 and 28; the first day of the third shows the second.
    days = [d(1998, 1, 1) + dt.timedelta(n) for n in (0, 13, 14, 27, 28, 29, 41)]
    assert column(spark, lambda x: dates.grid_index_closed(x, "1998-01-01", 3), days, "date") == [
        1, 1, 2, 2, 2, 3, 3]


def test_indexed_name(spark):
    df = spark.createDataFrame([("pi[12,3]",), ("tau",)], "v string")
    b, i, j = X.indexed_name(F.col("v"))
    assert [tuple(r) for r in df.select(b, i, j).collect()] == [("pi", 12, 3), ("", None, None)]


def test_golden_poll_id(spark):
    """A published id of a rejected poll, rebuilt from its printed values."""
    row = dict(pollster="Allensbach", date_published=d(1998, 12, 16), date_start=None, date_end=None,
               n=None, cdu_csu=36.3, spd=39.4, gruene=7.2, fdp=6.0, afd=0.0, linke=0.0, bsw=None, sonstige=0.0)
    df = spark.createDataFrame([tuple(row.values())], (
        "pollster string, date_published date, date_start date, date_end date, n int, "
        + ", ".join(f"{c} double" for c in PARTY_COLS)))
    c = F.col
    got = df.select(hashing.poll_id(c("pollster"), c("date_published"), c("date_start"),
                                    c("date_end"), c("n"), PARTY_COLS).alias("h")).first().h
    assert got == "cc60e667ade2e0dbac07ef90038e46eb4080b882c913ac5af581b73cff5a9d75"


def test_row_id_ignores_new_empty_columns(spark):
    df = spark.sql("""SELECT 'A' s, DATE'2024-01-05' p, CAST(NULL AS DATE) a, DATE'2024-01-02' e, 1004 n,
      map('SPD', 20.0D, 'FDP', 5.5D) m1, map('FDP', 5.5D, 'SPD', 20.0D, 'BSW', CAST(NULL AS DOUBLE)) m2""")
    args = [F.col(c) for c in "spaen"]
    r = df.select(hashing.row_id(*args, F.col("m1")).alias("x"), hashing.row_id(*args, F.col("m2")).alias("y")).first()
    import hashlib
    want = hashlib.sha256(b"A|2024-01-05|none|2024-01-02|1004|FDP=5.5|SPD=20.0").hexdigest()
    assert r.x == r.y == want
    assert df.select(hashing.is_content_id(F.lit(want)).alias("a"),
                     hashing.is_content_id(F.lit("a-b")).alias("b")).first() == (True, False)


def test_fingerprint_ignores_order(spark):
    a = spark.range(1000)
    f = lambda x: tuple(hashing.fingerprint(x).first())
    assert f(a) == f(a.orderBy(F.desc("id")).repartition(7))
    assert f(a) != f(a.where("id <> 5"))
    assert f(a.where("false")) == (0, 0)


def test_lgamma(spark):
    xs = [1e-3, 0.1, 0.5, 1.0, 2.0, 3.7, 10.0, 1234.5, 1e6, 1e12]
    got = column(spark, N.lgamma, xs, "double")
    assert np.allclose(got, [math.lgamma(x) for x in xs], rtol=1e-12, atol=1e-11)


def test_log_scores(spark):
    y, p = [3, 5, 2], [0.2, 0.5, 0.3]
    df = spark.createDataFrame(list(zip(y, p)), "y int, p double")
    got = df.agg(N.multinomial_log_score(F.col("y"), F.col("p"), F.lit(10)).alias("m"),
                 N.dirichlet_multinomial_log_score(F.col("y"), F.col("p") * 4).alias("d"),
                 F.sum(N.poisson_log_score(F.col("y"), F.col("p"))).alias("q")).first()
    lg = math.lgamma
    m = lg(11) + sum(a * math.log(b) - lg(a + 1) for a, b in zip(y, p))
    dm = lg(11) + lg(4) - lg(14) + sum(lg(a + 4 * b) - lg(4 * b) - lg(a + 1) for a, b in zip(y, p))
    q = sum(a * math.log(b) - b - lg(a + 1) for a, b in zip(y, p))
    assert np.allclose([got.m, got.d, got.q], [m, dm, q])


def test_spline_basis_sums_to_one():
    t = np.arange(1, 51)
    b = N.bspline_rows(t, [10, 20, 20.5, 40], 1, 50)
    assert b.shape == (50, 8)
    assert np.allclose(b.sum(axis=1), 1) and (b >= -1e-12).all()
    assert np.isclose(b[0, 0], 1) and np.isclose(b[-1, -1], 1)


def test_spline_basis_against_direct_recursion():
    grid = [1.0] * 4 + [7.0, 13.0] + [20.0] * 4

    def value(i, k, x):
        if k == 0:
            return 1.0 if grid[i] <= x < grid[i + 1] else 0.0
        out = 0.0
        if grid[i + k] > grid[i]:
            out += (x - grid[i]) / (grid[i + k] - grid[i]) * value(i, k - 1, x)
        if grid[i + k + 1] > grid[i + 1]:
            out += (grid[i + k + 1] - x) / (grid[i + k + 1] - grid[i + 1]) * value(i + 1, k - 1, x)
        return out

    t = np.linspace(1, 19.9, 40)
    want = [[value(i, 3, x) for i in range(6)] for x in t]
    assert np.allclose(N.bspline_rows(t, [7, 13], 1, 20), want)


def test_spline_column(spark):
    df = spark.range(1, 11).select(N.bspline_basis(F.col("id"), [5.0], 1.0, 10.0).alias("b"))
    assert np.allclose([sum(r.b) for r in df.collect()], 1)


def test_weights_and_bins(spark):
    r = spark.range(1).select(
        N.entry_exit_weight(F.lit(50), F.lit(10), F.lit(90), F.lit(1.0)).alias("mid"),
        N.entry_exit_weight(F.lit(10), F.lit(10), F.lit(90), F.lit(1.0)).alias("edge"),
        N.entry_exit_weight(F.lit(-99), F.lit(10), F.lit(90), F.lit(1.0), F.lit(1), F.lit(1)).alias("always"),
        N.ceiling_share(F.lit(0.2), F.lit(0.4)).alias("top"),
        N.is_close(F.lit(1.0), F.lit(1.0 + 1e-9)).alias("near"),
        N.is_finite(F.lit(float("inf"))).alias("fin")).first()
    assert r.mid == pytest.approx(1) and r.edge == pytest.approx(0.5) and r.always == 1
    assert r.top == pytest.approx(0.52) and r.near and not r.fin
    assert column(spark, N.horizon_bin, [-3, 0, 1, 4, 5, 12, 13, 26, 27, None], "int") == [
        "fit", "fit", "1-4w", "1-4w", "5-12w", "5-12w", "13-26w", "13-26w", ">26w", None]


def test_softmax_is_stable(spark):
    df = spark.createDataFrame([([1000.0, 1001.0, 999.0],)], "a array<double>")
    got = df.select(N.softmax_array(F.col("a")).alias("s")).first().s
    e = np.exp([-1, 0, -2])
    assert np.allclose(got, e / e.sum())


def test_party_map(spark):
    raw = ["CDU/CSU", "PDS", "LinkePDS", "PIRATEN", "REP/DVU", "new one", None]
    assert column(spark, dims.canonical_party, raw) == [
        "cdu_csu", "linke", "linke", "sonstige", "sonstige", "sonstige", "sonstige"]


def test_null_sums(spark):
    df = spark.createDataFrame([(None, None), (1.0, None)], "a double, b double")
    assert [r.s for r in df.select(N.row_sum(["a", "b"]).alias("s")).collect()] == [0.0, 1.0]
    assert df.agg(N.sum0(F.col("b")).alias("s")).first().s == 0.0


def test_interval_index_and_position(spark):
    xs = [0.5, 1.0, 2.9, 3.0, 7.0, 9.0, None]
    assert column(spark, lambda x: N.interval_index(x, [1.0, 3.0, 7.0]), xs, "double") == [0, 1, 1, 2, 3, 3, None]
    assert column(spark, lambda x: N.interval_index(x, [1.0, 3.0, 7.0], True), xs, "double") == [0, 1, 1, 2, 2, 3, None]
    assert column(spark, lambda x: N.list_position(x, ["b", "a"]), ["a", "b", "c", None]) == [2, 1, None, None]


def test_absorbed_party(spark):
    c = [F.lit(x) for x in (0.2, 0.6, 0.3, 0.1)]
    r = spark.range(1).select(N.absorbed_correlation(*c).alias("r"), N.absorbed_sigma(*c).alias("s")).first()
    assert r.r == pytest.approx((0.2 * 0.3 + 0.6 * 0.1) / 0.4)
    assert r.s == pytest.approx(math.sqrt((0.09 * 0.04 + 0.01 * 0.36) / 0.16))


def test_character_references(spark):
    cases = {"M&uuml;ller &amp; S&#246;hne": "Müller & Söhne", "&#xFC;&#x1F600;": "ü😀", "&amp;lt; &lt;": "&lt; <", "&#38;gt; &gt;": "&gt; >", "&unknown; & x": "&unknown; & x",
             "&euro;&nbsp;&apos;&Auml;": "€\u00a0'Ä", "": "", "&#0;&#55296;&#9999999;": "&#0;&#55296;&#9999999;"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "h string")
    got = {r.h: r.t for r in df.select("h", X.unescaped(F.col("h")).alias("t")).collect()}
    assert got == {**cases, None: None}
