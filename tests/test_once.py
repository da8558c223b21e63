"""Steps that several readers share are made once, and lists that rows meet stay short."""

import random

from pyspark.sql import functions as F

from pollspark.catalogue import jobs
from pollspark.catalogue import standin as S
from pollspark.operators import ordered
from pollspark.plans import update
from pollspark.sources import files, pages


def test_the_ingest_reads_parsed_rows(spark, tmp_path, monkeypatch):
    head = "".join(f"<th>{c}</th>" for c in ("", "SPD", "Befragte", "Zeitraum"))
    row = "<tr><td>01.02.1999</td><td>41,5 %</td><td>T • 1.000</td><td>20.01.–30.01.</td></tr>"
    html = f'<table class="wilko"><thead><tr>{head}</tr></thead><tbody>{row}</tbody></table>'
    spark.createDataFrame([("a", "http://a", html)], update.PAGES).write.json(f"{tmp_path}/pages")
    read, real = [], update.ingest.append_unseen
    monkeypatch.setattr(update.ingest, "append_unseen", lambda batch, *a: (read.extend(batch.inputFiles()), real(batch, *a)))
    assert update.scrape(spark, f"{tmp_path}/pages", f"{tmp_path}/out") == (1, 0)
    assert read and all("/parsed/" in f for f in read)


def test_plain_pages_give_the_events_of_the_parser():
    r = random.Random(5)
    parts = ['<table class="wilko">', '<table class="x wilko">', "<table>", "</table>", "<thead>", "</thead>", "<tbody>", "</tbody>", "<tr>", "</tr>",
             "<td>", "</td>", "<th>", "</th>", "<p>", "a", " b ", "1 > 0", '"', "\n", "é", '<td class="">', '<th class="n">', "</div>"]
    odd = ["&amp;", "<br/>", "<!-- <td> -->", "<TD>", "<", "<script>", "<td id=x>", "</td x>", '</td class="y">']
    for k in range(4000):
        some = [r.choice(parts if k % 3 or r.random() < 0.9 else odd) for _ in range(r.randint(0, 25))]
        html = '<table class="wilko"><thead>' * (k % 2) + "".join(some)
        fast, slow = pages._Table("wilko"), pages._Table("wilko")
        fast.read(html)
        slow.feed(html)
        slow.close()
        assert (fast.header, fast.rows) == (slow.header, slow.rows), html


def test_the_bins_inside_a_bin_lie_in_short_lists(spark, monkeypatch):
    monkeypatch.setattr(ordered, "LITERALS", 4)
    df = spark.range(6000).select((F.col("id") * 7919 % 6000).alias("t"), "id").cache()
    placed, two = ordered.with_bins(df, df, ["t", "id"], 6000, 10)
    lists = [len(r) for r in placed._jdf.queryExecution().optimizedPlan().toString().split("__block")]
    rows = placed.orderBy("t").select("__bin", "__sub").collect()
    assert two and len(lists) > 1 and rows == sorted(rows) and len(set(rows)) > 300


def test_valid_polls_are_made_once_for_the_coverage_report(spark, sf, monkeypatch):
    calls, real = [], S.valid_polls
    monkeypatch.setattr(S, "valid_polls", lambda *a: (calls.append(a), real(*a))[1])
    read, build = [], jobs.reference.build_pollsters
    monkeypatch.setattr(jobs.reference, "build_pollsters", lambda polls, *a: (read.extend(polls.inputFiles()), build(polls, *a))[1])
    assert jobs.job_coverage(spark, sf).count()
    assert len(calls) == 1 and read and all("/covered-" in f for f in read)


def test_raw_polls_are_made_once_for_the_source_files(spark, sf, monkeypatch):
    read, write = [], files.write_source_files
    monkeypatch.setattr(files, "write_source_files", lambda df, *a: (read.extend(df.inputFiles()), write(df, *a)))
    assert jobs.source_files(spark, sf).count()
    assert read and all("/raw-" in f for f in read)


def test_source_and_file_names_of_a_tree(spark, tmp_path):
    df = spark.createDataFrame([("u", 1.0)], "uuid string, vote_share double")
    for source in ("A B", "x.csv", "ü"):
        files.write_csv(df.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in files.schemas.RAW_LONG.fields]), f"{tmp_path}/t/{source}/current.csv")
    found = files.scan_tree(spark, f"{tmp_path}/t").select("pollster", "source_file").collect()
    assert sorted(map(tuple, found)) == [("A B", "current.csv"), ("x.csv", "current.csv"), ("ü", "current.csv")]
