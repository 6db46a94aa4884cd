"""Structured Streaming forms: incremental ingest, dedup, daily tone."""

import os

from pyspark.sql import functions as F

from tidewire import schema as S
from tidewire.sources import gkg
from tidewire.streaming import ingest as ST

from test_sources import _line


def _write(d, stamp, ids, tone="1.0,2"):
    with open(f"{d}/{stamp}.gkg.csv", "w") as fh:
        fh.write("\n".join(_line(f"{stamp}-{i}", tone=tone) for i in ids) + "\n")


def test_available_now_ingest_is_incremental(spark, scratch):
    src, dst, ck = (os.path.join(scratch, x) for x in ("src", "dst", "ck"))
    os.makedirs(src)
    _write(src, "20260301000000", [1, 2])
    _write(src, "20260301001500", [1])
    ST.ingest_available(spark, src, dst, ck).awaitTermination()
    assert spark.read.parquet(dst).count() == 3
    _write(src, "20260302000000", [1, 2, 3])
    ST.ingest_available(spark, src, dst, ck).awaitTermination()
    landed = spark.read.parquet(dst)
    batch = gkg.read_text_drops(spark, src)
    assert landed.count() == 6
    assert sorted(r[0] for r in landed.select(S.RID).collect()) == sorted(r[0] for r in batch.select(S.RID).collect())
    ST.ingest_available(spark, src, dst, ck).awaitTermination()  # restart: nothing new
    assert spark.read.parquet(dst).count() == 6
    assert sorted(r[0] for r in landed.select("day").distinct().collect())[0].isoformat() == "2026-03-01"


def test_stream_dedup_and_daily_tone(spark, scratch):
    src = os.path.join(scratch, "src2")
    os.makedirs(src)
    _write(src, "20260301000000", [1, 2], tone="2,0")
    _write(src, "20260301001500", [1], tone="4,0")
    with open(f"{src}/20260301003000.gkg.csv", "w") as fh:  # same record id again
        fh.write(_line("20260301000000-1", tone="100,0") + "\n")
    stream = ST.drop_stream(spark, src)
    q = (ST.dedup_stream(stream).writeStream.format("memory").queryName("dedup_out")
         .option("checkpointLocation", os.path.join(scratch, "ck1")).trigger(availableNow=True).start())
    q.awaitTermination()
    ids = sorted(r[0] for r in spark.sql("select GKGRECORDID from dedup_out").collect())
    assert ids == ["20260301000000-1", "20260301000000-2", "20260301001500-1"]
    _write(src, "20260305000000", [9], tone="0,0")  # advances the watermark past 2026-03-01
    q = (ST.daily_tone_stream(ST.drop_stream(spark, src)).writeStream.format("memory").queryName("tone_out")
         .option("checkpointLocation", os.path.join(scratch, "ck2")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.sql("select * from tone_out").collect()
    day1 = [r for r in rows if str(r["Date"]) == "2026-03-01"]
    assert day1 and abs(day1[0]["Tone"] - (2 + 2 + 4 + 100) / 4) < 1e-9
    assert F is not None


def test_stream_rejects_ragged_file_like_batch(spark, scratch):
    src, dst, ck = (os.path.join(scratch, x) for x in ("src3", "dst3", "ck3"))
    os.makedirs(src)
    _write(src, "20260301000000", [1, 2])
    with open(f"{src}/20260301001500.gkg.csv", "w") as fh:  # ragged: 27 and 20 fields
        fh.write(_line("20260301001500-1") + "\n" + _line("20260301001500-2", n=20) + "\n")
    ST.ingest_available(spark, src, dst, ck).awaitTermination()
    got = sorted(r[0] for r in spark.read.parquet(dst).select(S.RID).collect())
    assert got == sorted(r[0] for r in gkg.read_text_drops(spark, src).select(S.RID).collect())
    assert got == ["20260301000000-1", "20260301000000-2"]
