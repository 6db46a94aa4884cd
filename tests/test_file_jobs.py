"""Bucketed headline cache, total order over files."""

import glob
import os

import pandas as pd
from pyspark.sql import functions as F

from tidewire.sources import headline_store as HS
from tidewire.sources import quarantine as Q
from tidewire.sources import sorted_files as SO


def entries(spark, rows):
    return spark.createDataFrame(rows, "url string, headline string, seen_at long")


def state(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_upsert_writes_only_buckets_with_a_change(spark, scratch):
    path = f"{scratch}/store"
    HS.upsert_store(spark, path, entries(spark, [(f"u{k}", f"h{k}", 5) for k in range(2000)]), 32)
    before = state(path)
    assert len(before) == 32
    change = [("u1", "newer", 6), ("fresh", "first", 1), ("u2", "older", 4), ("u3", "h3", 5), ("u4", "a lesser headline", 5), (None, "x", 9)]
    touched = HS.upsert_store(spark, path, entries(spark, change), 7)
    after = state(path)
    buckets = {r.url: r.b for r in entries(spark, change).select("url", HS.bucket_of(F.col("url"), 32).alias("b")).collect()}
    assert touched == sorted({buckets["u1"], buckets["fresh"]})
    kept = [p for p in before if not any(f"/bucket={b}/" in p for b in touched)]
    assert len(kept) == 32 - len(touched) and all(after[p] == before[p] for p in kept)
    assert not any(p in after for p in before if p not in kept)
    got = {r.url: (r.headline, r.seen_at) for r in HS.read_store(spark, path).collect()}
    want = {f"u{k}": (f"h{k}", 5) for k in range(2000)} | {"u1": ("newer", 6), "fresh": ("first", 1)}
    assert got == want and HS.read_store(spark, path).count() == 2001
    # the same entries again change nothing
    assert HS.upsert_store(spark, path, entries(spark, change)) == [] and state(path) == after


def test_entries_of_one_run_may_repeat_a_url(spark, scratch):
    path = f"{scratch}/store"
    HS.upsert_store(spark, path, entries(spark, [("u", "a", 1), ("u", "b", 3), ("u", "c", 3), ("u", None, 2)]), 4)
    assert [tuple(r) for r in HS.read_store(spark, path).select("url", "headline", "seen_at").collect()] == [("u", "c", 3)]


def test_an_entry_with_a_time_replaces_one_without(spark, scratch):
    path = f"{scratch}/store"
    HS.upsert_store(spark, path, entries(spark, [("u", "a", None), ("v", None, 3), ("w", "c", 3)]), 4)
    HS.upsert_store(spark, path, entries(spark, [("u", "b", 1), ("v", "d", 3), ("w", "e", None)]))
    assert {tuple(r)[:3] for r in HS.read_store(spark, path).collect()} == {("u", "b", 1), ("v", "d", 3), ("w", "c", 3)}


def test_positions_follow_the_total_order(spark, scratch):
    path = f"{scratch}/sorted"
    rows = spark.range(5000).select((F.col("id") * 7919 % 1000).alias("a"), F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 13).alias("b")).repartition(6)
    SO.write_sorted(rows, path, F.col("a").asc(), F.col("b").asc())
    got = sorted(SO.read_positions(spark, path).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(1, 5001))
    key = lambda r: (r.a, r.b is not None, r.b or 0)
    assert [key(r) for r in got] == sorted(key(r) for r in rows.collect())
    assert SO.order_faults(spark, path, ["a", "b"]).count() == 0


def test_faults_inside_files_and_across_borders_are_found(spark, scratch):
    path = f"{scratch}/unsorted"
    for part in ([1, 2, 5], [4, 6], [7, 9, 8]):
        spark.createDataFrame([(k,) for k in part], "a int").coalesce(1).write.mode("append").parquet(f"{path}-{part[0]}")
    os.makedirs(path)
    for k, part in enumerate((1, 4, 7)):
        src = glob.glob(f"{path}-{part}/*.parquet")[0]
        with open(src, "rb") as f, open(f"{path}/part-0000{k}.parquet", "wb") as g:
            g.write(f.read())
    assert {tuple(r) for r in SO.order_faults(spark, path, ["a"]).collect()} == {(4, "border"), (8, "inside")}


def test_empty_table_has_no_positions(spark, scratch):
    SO.write_sorted(spark.range(0), f"{scratch}/none", F.col("id"))
    assert SO.read_positions(spark, f"{scratch}/none").count() == 0 == SO.order_faults(spark, f"{scratch}/none", ["id"]).count()


def damaged(folder):
    """A folder of files, whole and damaged in known ways: name -> fault."""
    os.makedirs(f"{folder}/sub")
    frame = pd.DataFrame({f"c{k}": range(3000) for k in range(6)})
    frame.to_parquet(f"{folder}/whole.parquet", row_group_size=500)
    frame.head(900).to_parquet(f"{folder}/sub/short.parquet")
    frame[["c0", "c1"]].to_parquet(f"{folder}/narrow.parquet")
    frame.head(0).to_parquet(f"{folder}/empty.parquet")
    raw, short = (open(f"{folder}/{n}.parquet", "rb").read() for n in ("whole", "sub/short"))
    foot = lambda b: len(b) - 8 - int.from_bytes(b[-8:-4], "little")
    files = {"cut": raw[: len(raw) // 2], "tiny": b"PAR1xxPAR1",
             "written_over": short + raw[len(short):],  # a shorter file over a longer one: its old end still stands
             "long_footer": short[: foot(short)] + raw[foot(raw):], "other_footer": raw[: foot(raw)] + short[foot(short):],
             "lost_middle": raw[: len(raw) // 4] + raw[len(raw) // 2:],
             "footer_size": raw[:-8] + (1 << 30).to_bytes(4, "little") + b"PAR1"}
    for name, data in files.items():
        with open(f"{folder}/{name}.parquet", "wb") as f:
            f.write(data)
    return {"cut": "bad_magic", "tiny": "too_small", "written_over": "bad_chunks", "long_footer": "bad_chunks", "other_footer": "bad_chunks",
            "lost_middle": "bad_chunks", "footer_size": "bad_footer", "narrow": "few_columns", "empty": "empty", "whole": None, "short": None}


def test_health_by_footer(spark, scratch):
    want = damaged(f"{scratch}/in")
    got = {os.path.basename(r.path)[:-8]: r for r in Q.file_health(spark, f"{scratch}/in").collect()}
    assert {n: r.reason for n, r in got.items()} == want
    assert (got["whole"].rows, got["whole"].columns, got["short"].rows) == (3000, 6, 900)


def test_files_that_spark_wrote_are_whole(spark, scratch):
    rows = spark.range(4000).select("id", *(F.when(F.col("id") % 7 > k, F.col("id").cast("string")).alias(f"c{k}") for k in range(5)), F.array("id").alias("a"))
    rows.repartition(3).write.option("parquet.block.size", 20000).parquet(f"{scratch}/s")
    assert {r.reason for r in Q.file_health(spark, f"{scratch}/s").collect()} == {None}


def test_quarantine_moves_faulty_files_and_settles_an_ended_run(spark, scratch, monkeypatch):
    want = damaged(f"{scratch}/in")
    monkeypatch.setattr(Q, "settle", lambda *a: 1 / 0)
    try:
        Q.quarantine(spark, f"{scratch}/in", f"{scratch}/pen", f"{scratch}/audit")
    except ZeroDivisionError:
        pass
    monkeypatch.undo()
    faulty = {n for n, r in want.items() if r}
    assert Q.settle(spark, f"{scratch}/audit") == len(faulty) and Q.settle(spark, f"{scratch}/audit") == 0
    assert {os.path.basename(p)[9:-8] for p in glob.glob(f"{scratch}/pen/*.parquet")} == faulty
    assert {os.path.basename(p)[:-8] for p in glob.glob(f"{scratch}/in/**/*.parquet", recursive=True)} == {"whole", "short"}
    assert Q.quarantine(spark, f"{scratch}/in", f"{scratch}/pen", f"{scratch}/audit").count() == 0
    audit = spark.read.parquet(f"{scratch}/audit").collect()
    assert {os.path.basename(r.path)[:-8]: r.reason for r in audit} == {n: want[n] for n in faulty}


def test_a_large_monthly_csv_is_read_by_many_tasks(spark, scratch, monkeypatch):
    """Quoted line breaks, doubled quotes, empty fields, short and empty lines lie across the pieces' bounds; files
    that aren't plain go to Spark's own reader.  Rows are those of whole files."""
    import random
    from tidewire.sources import files as FS
    rng = random.Random(4)
    fields = ['"a ""b"", c\nd"', '""', "", " x ", '"\n\n"', '"é,\n""\n"', "plain", '"""q"""']
    body = lambda n: "".join(rng.choice(["\n", "only\n"]) if k % 17 == 3 else f"{k},{rng.choice(fields)},{rng.choice(fields)}\n" for k in range(n))
    texts = {"a b+c": body(400), "two": body(300)[:-1], "bare": body(50) + 'x,5" pipe,y\n' + body(50), "returns": body(100).replace("\n", "\r\n"), "small": "1,2,3\n"}
    paths = []
    for name, text in texts.items():
        paths.append(f"{scratch}/{name}.csv")
        with open(paths[-1], "w", newline="") as f:
            f.write("date,headline,crime_types\n" + text)
    key = lambda df: sorted(map(repr, df.select("date", "headline", "crime_types", "source_file").collect()))
    want = key(FS.read_monthly_csvs(spark, paths))
    monkeypatch.setattr(FS, "CSV_BLOCK", 37)
    for piece in (100, 501):
        monkeypatch.setattr(FS, "CSV_PIECE", piece)
        df, whole = FS._read_in_pieces(spark, ["date", "headline", "crime_types"], paths)
        assert [p.rsplit("/", 1)[1] for p in whole] == ["bare.csv", "returns.csv", "small.csv"]
        assert df.rdd.getNumPartitions() > 5
        assert key(FS.read_monthly_csvs(spark, paths)) == want
