"""IO: zipped drops, landing and range scans, monthly CSVs, file health."""

import io
import os
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tidewire import schema as S
from tidewire.sources import files as FS
from tidewire.sources import gkg


def _line(rid, source="bbc.co.uk", n=27, themes="KILL,120;HATE_CRIME,300", tone="-3.5,1.2,4.7"):
    f = [""] * n
    f[0], f[3], f[4], f[8], f[15] = rid, source, f"https://x/{rid}.html", themes, tone
    f[10] = "4#London, England#UK;4#Barking Riverside#UK"
    f[13] = "NA"
    return "\t".join(f)


def _zip(path, text: bytes):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("drop.csv", text)


def test_zipped_drops(spark, scratch):
    d = os.path.join(scratch, "drops")
    os.makedirs(d)
    good = "\n".join([_line("20260228001500-1"), _line("20260228001500-2")]).encode()
    _zip(f"{d}/20260228001500.gkg.csv.zip", good)
    _zip(f"{d}/20260228003000.gkg.csv.zip", "\n".join([_line("20260228003000-1", n=28)]).encode())
    _zip(f"{d}/20260228004500.gkg.csv.zip", "\n".join([_line("x", n=26)]).encode())
    _zip(f"{d}/20260228010000.gkg.csv.zip", (_line("y") + "\n" + _line("z", n=28)).encode())
    _zip(f"{d}/20260228011500.gkg.csv.zip", _line("w").encode() + b"\xff\xfe")
    _zip(f"{d}/20260228013000.gkg.csv.zip", b"")
    with open(f"{d}/20260228014500.gkg.csv.zip", "wb") as fh:
        fh.write(b"not a zip")
    rec = gkg.read_drops(spark, d)
    got = {r[S.RID]: r for r in rec.collect()}
    assert set(got) == {"20260228001500-1", "20260228001500-2", "20260228003000-1"}
    r = got["20260228001500-1"]
    assert str(r[S.DATE]) == "2026-02-28 00:15:00"
    assert r["V1ORGANIZATIONS"] is None and r["V1THEMES"] is None
    assert rec.columns == list(S.PARSED_COLUMNS) + [S.DATE]
    status = {os.path.basename(p): s for p, s, _ in gkg.drop_report(spark, d).collect()}
    assert status["20260228004500.gkg.csv.zip"] == "too_few_columns"
    assert status["20260228010000.gkg.csv.zip"] == "ragged"
    assert status["20260228011500.gkg.csv.zip"] == "invalid_utf8"
    assert status["20260228013000.gkg.csv.zip"] == "empty"
    assert status["20260228014500.gkg.csv.zip"] == "bad_zip"
    first = gkg.read_drops(spark, d, drop_first_line=True)
    assert first.count() == 1  # each good drop loses its first line, like the reference


def test_land_and_scan_range(spark, scratch):
    rows = [(f"r{i}", (pd.Timestamp("2026-03-01") + pd.Timedelta(minutes=15 * i)).to_pydatetime()) for i in range(300)]
    df = spark.createDataFrame(rows, "GKGRECORDID string, date timestamp_ntz")
    out = os.path.join(scratch, "landed")
    gkg.land(df, out)
    got = gkg.scan_range(spark, out, "2026-03-02 00:00:00", "2026-03-02 23:59:59")
    assert got.count() == 96
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan
    gkg.land(df.where("GKGRECORDID = 'r0'"), out, mode="overwrite")
    assert spark.read.parquet(out).count() == 300 - 96 + 1  # only day 2026-03-01 replaced


def test_text_drops(spark, scratch):
    d = os.path.join(scratch, "text")
    os.makedirs(d)
    with open(f"{d}/20260301000000.gkg.csv", "w") as fh:
        fh.write(_line("20260301000000-1") + "\n" + _line("20260301000000-2") + "\n")
    with open(f"{d}/20260301001500.gkg.csv", "w") as fh:
        fh.write(_line("bad", n=20) + "\n")
    got = gkg.read_text_drops(spark, d)
    assert sorted(r[0] for r in got.select(S.RID).collect()) == ["20260301000000-1", "20260301000000-2"]


def test_monthly_csvs_and_sinks(spark, scratch):
    a = os.path.join(scratch, "m1_2025-01-01_to_2025-01-31.csv")
    b = os.path.join(scratch, "m2.csv")
    c = os.path.join(scratch, "m3.csv")
    pd.DataFrame({"date": ["2025-01-02 00:15:00", "02/03/2025"], "headline": ['say "hi", now', "line\nbreak"],
                  "crime_types": ["THEFT", "UNKNOWN"]}).to_csv(a, index=False, encoding="utf-8-sig")
    pd.DataFrame({"date": ["2025-01-05"], "headline": ["x"], "extra": ["e"]}).to_csv(b, index=False)
    pd.DataFrame({"date": ["2025-01-05"], "other": ["no headline"]}).to_csv(c, index=False)
    u = FS.read_monthly_csvs(spark, [a, b, c])
    rows = sorted(u.collect(), key=lambda r: r["headline"])
    assert [r["headline"] for r in rows] == ['line\nbreak', 'say "hi", now', "x"]
    assert "extra" in u.columns and "source_file" in u.columns and u.columns[0] == "date"
    out = FS.csv_to_parquet(spark, a, os.path.join(scratch, "pq"))
    assert out.endswith("2025-01-01_to_2025-01-31_23-59-59.parquet")
    assert spark.read.parquet(out).count() == 2
    target = os.path.join(scratch, "out.csv")
    FS.write_csv(u, target)
    assert FS.free_path(spark, target) == os.path.join(scratch, "out (1).csv")
    man = FS.dataset_manifest(spark, scratch)
    assert {"m2.csv", "m3.csv"} <= {r[0] for r in man.collect()}


def test_corrupt_file_report(spark, scratch):
    d = os.path.join(scratch, "pq")
    os.makedirs(d)
    big = pd.DataFrame({f"c{i}": range(2000) for i in range(6)})
    big.to_parquet(f"{d}/good.parquet")
    big[["c0", "c1"]].to_parquet(f"{d}/narrow.parquet")
    raw = open(f"{d}/good.parquet", "rb").read()
    open(f"{d}/truncated.parquet", "wb").write(raw[: len(raw) // 2])
    open(f"{d}/tiny.parquet", "wb").write(b"PAR1xxPAR1")
    open(f"{d}/garbage.parquet", "wb").write(b"x" * 5000)
    bad = bytearray(raw)
    bad[len(raw) // 2: len(raw) // 2 + 200] = b"\x00" * 200
    open(f"{d}/damaged.parquet", "wb").write(bytes(bad))
    rep = {os.path.basename(r["path"]): r["reason"] for r in FS.corrupt_file_report(spark, d).collect()}
    assert rep["good.parquet"] is None
    assert rep["narrow.parquet"] == "few_columns"
    assert rep["truncated.parquet"] == "bad_magic"
    assert rep["tiny.parquet"] == "too_small"
    assert rep["garbage.parquet"] == "bad_magic"
    assert rep["damaged.parquet"] in ("unreadable", None)


def test_zip_helper_roundtrip():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a.csv", _line("1"))
    status, lines = gkg._inflate(buf.getvalue(), False)
    assert status == "ok" and len(lines) == 1 and F is not None


def test_ingest_missing_only(spark, scratch):
    d = os.path.join(scratch, "drops2")
    os.makedirs(d)
    landed = os.path.join(scratch, "landed2")
    _zip(f"{d}/20260301000000.gkg.csv.zip", _line("20260301000000-1").encode())
    _zip(f"{d}/20260301001500.gkg.csv.zip", _line("20260301001500-1").encode())
    _zip(f"{d}/20260301003000.gkg.csv.zip", b"")  # empty: stays missing
    got = gkg.ingest_missing(spark, d, landed, "2026-03-01 00:00:00", "2026-03-01 00:45:00")
    assert len(got) == 3 and spark.read.parquet(landed).count() == 2
    _zip(f"{d}/20260301004500.gkg.csv.zip", _line("20260301004500-1").encode())
    got = gkg.ingest_missing(spark, d, landed, "2026-03-01 00:00:00", "2026-03-01 00:45:00")
    assert [os.path.basename(p) for p in got] == ["20260301003000.gkg.csv.zip", "20260301004500.gkg.csv.zip"]
    assert spark.read.parquet(landed).count() == 3


def test_a_table_of_one_large_row_group_is_dealt_out(spark, scratch):
    """Its scan is planned as many splits, of which one holds every row."""
    from tidewire.plans import bindings as B
    spark.range(5000).selectExpr("id", "sha2(string(id), 256) AS text").coalesce(1).write.parquet(f"{scratch}/t.parquet")
    spark.range(5000).selectExpr("id", "sha2(string(id), 256) AS text").repartition(16).write.parquet(f"{scratch}/u.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.parquet(f"{scratch}/t.parquet").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        t = B.table(spark, scratch, "t")
        held = t.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert held < 5000 / 4 and t.selectExpr("sum(id)").first()[0] == 5000 * 4999 // 2
        # rows that lie evenly are left where they are
        assert B.spread_over(spark.read.parquet(f"{scratch}/u.parquet"), spark.sparkContext.defaultParallelism) == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_stamp_is_cut_from_a_long_path_at_once(spark):
    """The path is not tried at every place: 300 rows took minutes."""
    import time
    paths = ["/".join(["x" * 20_000] * 3) + f"/20260228{h:02d}1500.gkg.csv.zip" for h in range(24)] + ["20260228001500.zip", "a/20260228001500/b.zip", "a/", "", None]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k int, p string")
    began = time.monotonic()
    got = [r.s for r in rows.select("k", gkg.stamp_from_path(F.col("p")).alias("s")).orderBy("k").collect()]
    assert time.monotonic() - began < 15
    assert [f"{s:%Y%m%d%H%M%S}" if s else None for s in got] == [f"20260228{h:02d}1500" for h in range(24)] + ["20260228001500", None, None, None, None]
