"""Batch entry points end to end on landed records."""

import os

import pytest
from pyspark.sql import functions as F

from tidewire import dictionaries as DI
from tidewire import schema as S
from tidewire.plans import bindings as B
from tidewire.plans import flows as P
from tidewire.sources import gkg

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_run_batch_filter_months_reextract(spark, scratch):
    recs = B.records(spark, SF)
    landed = os.path.join(scratch, "landed")
    gkg.land(recs, landed)
    pages = B.table(spark, SF, "pages")
    out = os.path.join(scratch, "enriched")
    e = P.run_batch(spark, landed, "2024-01-01 00:00:00", "2024-01-03 23:59:59", DI.BINDING_SITES,
                    DI.BINDING_THEMES, DI.BINDING_LOCATIONS, DI.BINDING_TEXT_CATEGORIES, pages, None,
                    DI.BINDING_ACRONYMS, out=out)
    n = e.count()
    assert n > 0
    assert e.columns[:3] == ["date", "tone", "daily_avg_tone"]
    # every record's url is not a fetched page: slug fallback gives the article id text
    assert e.where(F.col(S.HEADLINE) == "").count() == 0
    assert spark.read.parquet(out).count() == n
    months = os.path.join(scratch, "months")
    P.filter_months(spark.read.parquet(landed), months, DI.BINDING_SITES, DI.BINDING_THEMES,
                    DI.BINDING_LOCATIONS)
    r = P.reextract_month(spark, months, "2024-01", pages, None, DI.BINDING_ACRONYMS,
                          DI.BINDING_TEXT_CATEGORIES)
    assert r.count() > 0
    with pytest.raises(FileNotFoundError):
        P.reextract_month(spark, months, "1999-01", pages, None, DI.BINDING_ACRONYMS, DI.BINDING_TEXT_CATEGORIES)


def test_enrich_csv_rows_and_cache(spark):
    from tidewire.operators import headlines as H
    rows = spark.createDataFrame(
        [("2025-01-01", "https://a.co.uk/news/man-held-1234567", "s"), ("2025-01-02", "ftp://x/y", "t"),
         ("2025-01-03", "https://b.co.uk/p", "u"), ("2025-01-04", "https://c.co.uk/q", "v")],
        "date string, V1DOCUMENTIDENTIFIER string, V2SOURCECOMMONNAME string")
    pages = spark.createDataFrame([("https://b.co.uk/p", "<title> Page B </title>"),
                                   ("https://c.co.uk/q", "<p>no title</p>")], "url string, html string")
    cache = spark.createDataFrame([("https://a.co.uk/news/man-held-1234567", "__MISSED HEADLINE__"),
                                   ("https://c.co.uk/q", "Cached C")], "url string, headline string")
    res = H.resolve_headlines(rows.select(F.col(S.URL).alias("url")), pages, cache, {"uk"})
    got = {r["url"]: (r["headline"], r["cache_entry"]) for r in res.collect()}
    assert got["https://a.co.uk/news/man-held-1234567"] == ("man held", "man held")  # miss marker ignored, slug
    assert got["ftp://x/y"] == (None, None)
    assert got["https://b.co.uk/p"] == ("Page B", "Page B")
    assert got["https://c.co.uk/q"] == ("Cached C", None)
    res2 = H.resolve_headlines(rows.select(F.col(S.URL).alias("url")), pages, None, {"uk"})
    assert {r["url"]: r["cache_entry"] for r in res2.collect()}["https://c.co.uk/q"] == "__MISSED HEADLINE__"
    out = H.enrich_csv_rows(rows, res)
    assert out.columns[:2] == ["date", "headline"] and out.count() == 4
    with pytest.raises(ValueError):
        H.enrich_csv_rows(rows.drop(S.URL), res)
    up = H.cache_upsert(cache.withColumn("seen_at", F.lit("2025-01-01").cast("timestamp")),
                        res.select("url", F.col("cache_entry").alias("headline"))
                        .where(F.col("headline").isNotNull()).withColumn("seen_at", F.lit("2025-02-01").cast("timestamp")))
    assert {r["url"]: r["headline"] for r in up.collect()}["https://a.co.uk/news/man-held-1234567"] == "man held"


def test_folder_jobs(spark, scratch):
    import pandas as pd
    folder = os.path.join(scratch, "cleaned")
    os.makedirs(folder)
    pd.DataFrame({
        "date": ["2025-01-02 00:15:00", "2025-01-02", "01/03/2025", "bad", "2025-01-03 10:00:00", "2025-02-01"],
        "headline": ["cafÃ© fire", "cafÃ© fire", "cafÃ© fire", "x", "  ", "other"],
        "headline_is_duplicate": ["True", "TRUE", " true ", "True", "True", "True"],
        "crime_types": ["ARSON", "ARSON, THEFT", "ARSON", "ARSON", "ARSON", "THEFT"],
        "crime_type": ["ARSON", "ARSON", "ARSON", "ARSON", "ARSON", "THEFT"],
        "GKGRECORDID": ["r1", "r2", "r3", "r4", "r5", "r6"],
        "V1DOCUMENTIDENTIFIER": ["u1", "u2", "u3", "u4", "u5", "u6"],
        "V2SOURCECOMMONNAME": ["a", "b", "c", "d", "e", "f"],
    }).to_csv(os.path.join(folder, "m1.csv"), index=False, encoding="utf-8-sig")
    pd.DataFrame({"date": ["2025-01-05"], "other": ["no headline"]}).to_csv(os.path.join(folder, "m2.csv"), index=False)
    out = os.path.join(scratch, "summary_out")
    s = P.summary_from_csv_folder(spark, folder, out=out)
    rows = {(str(r["Day"]), r["headline"]): r for r in s.collect()}
    assert rows[("2025-01-02", "café fire")]["count_day"] == 2  # mojibake repaired, mixed dates parsed
    assert rows[("2025-01-02", "café fire")]["Headline_Source"] == "u2"  # midnight < 00:15
    assert all(h != "x" and h.strip() for _, h in rows)  # bad date and blank headline dropped
    assert spark.read.json(os.path.join(out, "json")).count() == s.count()
    t = P.timeline_from_csv_folder(spark, folder).collect()
    assert {r["Top Headline"] for r in t} == {"cafÃ© fire", "other"}
