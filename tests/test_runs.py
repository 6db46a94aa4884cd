"""Launch settings, line ends of drops, labelled input and the headline cache."""

import datetime as dt
import os
import subprocess
import sys
import zipfile

from pyspark.sql import functions as F

from tidewire import dictionaries as DI
from tidewire import schema as S
from tidewire.plans import flows as P
from tidewire.session import materialize
from tidewire.sources import files as FS
from tidewire.sources import gkg

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_launch_settings_stay(tmp_path):
    code = ("from tidewire.session import get_spark; s = get_spark('local[1]', shuffle_partitions=8); "
            "print('GOT', s.conf.get('spark.sql.shuffle.partitions'), s.sparkContext.getCheckpointDir(), s.conf.get('spark.sql.adaptive.enabled'))")
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": f"--conf spark.sql.shuffle.partitions=4000 --conf spark.checkpoint.dir=file://{tmp_path} "
                        "--conf spark.sql.adaptive.enabled=false --driver-memory 1g pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=ROOT, capture_output=True, text=True, timeout=120).stdout
    _, width, folder, adaptive = next(x for x in out.splitlines() if x.startswith("GOT")).split()
    assert width == "4000" and folder.startswith(f"file:{tmp_path}") and adaptive == "false"


def _line(rid, text="t"):
    f = [""] * 27
    f[0], f[3], f[4], f[10] = rid, "bbc.co.uk", f"https://x/{rid}.html", text
    return "\t".join(f)


def test_only_newlines_end_a_line(spark, scratch):
    d = os.path.join(scratch, "drops")
    os.makedirs(d)
    lines = [_line(f"20260228001500-{k}", f"a{c}b") for k, c in enumerate(" \x85\x0c\x1c")]
    with zipfile.ZipFile(f"{d}/20260228001500.gkg.csv.zip", "w") as z:
        z.writestr("drop.csv", "\r\n".join(lines) + "\r\n")
    got = {r[S.RID]: r["V2ENHANCEDLOCATIONS"] for r in gkg.read_drops(spark, d).collect()}
    assert got == {f"20260228001500-{k}": f"a{c}b" for k, c in enumerate(" \x85\x0c\x1c")}


def test_csvs_with_repeated_or_missing_columns(spark, scratch):
    texts = {"a.csv": "date,headline,headline\n2025-01-01,h1,h2\n", "b.csv": "date,other\n2025-01-02,x\n", "c.csv": "headline,date\nh3,2025-01-03\n"}
    for name, text in texts.items():
        with open(f"{scratch}/{name}", "w") as f:
            f.write(text)
    left: list[str] = []
    out = FS.read_monthly_csvs(spark, FS.list_files(spark, scratch, ".csv"), skipped=left)
    assert {(r["date"], r["headline"], r["headline.1"], r["source_file"]) for r in out.collect()} == {("2025-01-01", "h1", "h2", "a.csv"), ("2025-01-03", "h3", None, "c.csv")}
    assert [p.rsplit("/", 1)[-1] for p in left] == ["b.csv"]


def _articles(spark):
    rows = [("20250101000000-1", dt.datetime(2025, 1, 1), "https://a.co.uk/n/1000001/x.html", "s", "man held with knife", "-1,2", "KNOWN"),
            ("20250101000000-2", dt.datetime(2025, 1, 1), "https://a.co.uk/n/1000002/x.html", "s", None, "3,2", None)]
    return spark.createDataFrame(rows, f"{S.RID} string, {S.DATE} timestamp_ntz, {S.URL} string, {S.SOURCE} string, {S.HEADLINE} string, `V1.5TONE` string, {S.TYPES} string")


def test_labels_that_are_there_stay(spark):
    out = P.enrich_articles(_articles(spark), DI.BINDING_TEXT_CATEGORIES)
    got = {r[S.RID]: r[S.TYPES] for r in out.collect()}
    assert got["20250101000000-1"] == "KNOWN" and got["20250101000000-2"] == "UNKNOWN"


def test_second_run_extracts_nothing(spark):
    from tidewire.operators import headlines as H
    urls = spark.createDataFrame([("https://b/p",), ("https://b/none",), ("https://c/some-slug-1234567",)], "url string")
    pages = spark.createDataFrame([("https://b/p", "<title>B</title>"), ("https://b/p", None), ("https://b/p", "<title>A</title>"), ("https://b/none", "<p>x</p>")], "url string, html string")
    first = H.resolve_headlines(urls, pages, None, {"uk"})
    assert {r.url: r.headline for r in first.collect()} == {"https://b/p": "B", "https://b/none": None, "https://c/some-slug-1234567": "some slug"}
    cache = P.written_back(None, first)
    assert {r.url: r.headline for r in cache.collect()} == {"https://b/p": "B", "https://b/none": S.MISSED_HEADLINE, "https://c/some-slug-1234567": "some slug"}
    changed = pages.withColumn("html", F.lit("<title>changed</title>"))
    second = {r.url: (r.headline, r.cache_entry) for r in H.resolve_headlines(urls, changed, cache, {"uk"}).collect()}
    assert second["https://b/p"] == ("B", None) and second["https://c/some-slug-1234567"] == ("some slug", None)
    assert second["https://b/none"] == ("changed", "changed")  # a miss is tried again


def test_written_tables_have_no_marker_file(spark):
    table = materialize(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), "marker-test")
    names = os.listdir(table._materialized_at.removeprefix("file:"))
    assert [n for n in names if n.startswith("part-")] and not [n for n in names if "_SUCCESS" in n]
    assert sorted(map(tuple, table.collect())) == [(1, "a"), (2, "b")]
