"""Range cache, commit records, the zip source, streams over their history, and large dictionaries."""

import datetime as dt
import io
import os
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewire import schema as S
from tidewire.functions import automaton as AU
from tidewire.functions import terms as TM
from tidewire.operators import ranges as R
from tidewire.plans import range_cache as RC
from tidewire.sources import gkg, landing
from tidewire.sources import zip_source as Z
from tidewire.streaming import history as HI
from tidewire.streaming import ingest as ST

from test_sources import _line, _zip

T0 = dt.datetime(2026, 3, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def hours(df):
    return sorted(tuple((x - T0).total_seconds() / 3600 if isinstance(x, dt.datetime) else x for x in r) for r in df.collect())


# ---- ranges

def frame(spark, rows, cols="k long, start timestamp_ntz, end timestamp_ntz"):
    return spark.createDataFrame(rows, cols)


def test_islands_and_gaps_by_hand(spark):
    s = dt.timedelta(seconds=1)
    rows = [(1, at(0), at(10)), (1, at(2), at(3)), (1, at(10) + s, at(12)), (1, at(20), at(21)), (1, None, at(9)), (1, at(30), at(29)), (2, at(5), at(6)), (1, at(0), at(4))]
    islands = R.merge_ranges(frame(spark, rows), ["k"])
    assert sorted((r.k, r.start, r.end, r.ranges) for r in islands.collect()) == [(1, at(0), at(12), 4), (1, at(20), at(21), 1), (2, at(5), at(6), 1)]
    asked = frame(spark, [(1, at(-1), at(25)), (2, at(5), at(6)), (3, at(0), at(1))])
    left = R.uncovered(asked, islands, ["k"])
    assert sorted((r.k, r.start, r.end) for r in left.collect()) == [(1, at(-1), at(0) - s), (1, at(12) + s, at(20) - s), (1, at(21) + s, at(25)), (3, at(0), at(1))]


@pytest.mark.parametrize("seed", range(4))
def test_islands_and_gaps_second_by_second(spark, seed):
    rng = random.Random(seed)
    sec = lambda n: T0 + dt.timedelta(seconds=n)
    spans = [(rng.randrange(3), a := rng.randrange(300), a + rng.randrange(25)) for _ in range(40)]
    covered = {(k, t) for k, a, b in spans for t in range(a, b + 1)}
    islands = R.merge_ranges(frame(spark, [(k, sec(a), sec(b)) for k, a, b in spans]), ["k"])
    got = [(r.k, int((r.start - T0).total_seconds()), int((r.end - T0).total_seconds())) for r in islands.collect()]
    assert {(k, t) for k, a, b in got for t in range(a, b + 1)} == covered and sum(b - a + 1 for _, a, b in got) == len(covered)
    left = R.uncovered(frame(spark, [(k, sec(20), sec(280)) for k in range(4)]), islands, ["k"])
    free = [(r.k, int((r.start - T0).total_seconds()), int((r.end - T0).total_seconds())) for r in left.collect()]
    assert sorted((k, t) for k, a, b in free for t in range(a, b + 1)) == [(k, t) for k in range(4) for t in range(20, 281) if (k, t) not in covered]


# ---- range cache

def test_cache_filters_only_what_is_uncovered(spark, scratch):
    recs = spark.createDataFrame([(f"r{h}", at(h), h) for h in range(0, 240, 3)], f"{S.RID} string, date timestamp_ntz, n long")
    seen = []

    def keep(label):
        def run(df):
            seen.append(sorted(r.n for r in df.select("n").collect()))
            return df.where("n % 2 = 0").withColumn("by", F.lit(label))
        return run

    def ask(a, b, label):
        seen.clear()
        return sorted((r.n, r.by) for r in RC.filter_range(recs, scratch + "/cache", at(a), at(b), keep(label)).collect())

    even = lambda a, b: [n for n in range(0, 240, 6) if a <= n <= b]
    assert ask(24, 48, "one") == [(n, "one") for n in even(24, 48)]
    assert ask(120, 126, "two") == [(n, "two") for n in even(120, 126)]
    # the gap between two cached ranges is filtered; cached rows win
    assert ask(30, 130, "three") == [(n, "one" if n <= 48 else "two" if 120 <= n <= 126 else "three") for n in even(30, 130)]
    assert seen == [[n for n in range(51, 131, 3) if not 120 <= n <= 126]]
    # covered: nothing is filtered, rows that are equal in whole count once
    assert ask(24, 126, "four") == [(n, "one" if n <= 48 else "two" if n >= 120 else "three") for n in even(24, 126)]
    assert seen == []
    # the name holds whole first days: the day is filtered from midnight on
    assert ask(150, 160, "five") == [(n, "five") for n in even(150, 160)]
    assert seen == [[n for n in range(144, 161, 3)]]
    assert ask(144, 160, "six") == [(n, "five") for n in even(144, 160)]
    # a range without rows covers its dates too
    assert ask(1000, 1010, "seven") == [] and ask(1000, 1010, "eight") == [] and seen == []


def test_failed_write_leaves_no_range(spark, scratch):
    recs = spark.createDataFrame([("r", at(1))], f"{S.RID} string, date timestamp_ntz")
    with pytest.raises(Exception):
        RC.filter_range(recs, scratch + "/c", at(0), at(5), lambda df: df.withColumn("x", F.raise_error(F.lit("stop"))))
    assert RC.cached_names(spark, scratch + "/c").count() == 0
    assert RC.filter_range(recs, scratch + "/c", at(0), at(5), lambda df: df).count() == 1


# ---- commit records

@pytest.fixture
def drops(scratch):
    d = os.path.join(scratch, "drops")
    os.makedirs(d)
    for k, stamp in enumerate(("20260301000000", "20260301001500", "20260302000000")):
        _zip(f"{d}/{stamp}.gkg.csv.zip", "\n".join(_line(f"{stamp}-{i}") for i in range(k + 1)).encode())
    return d


def ids(df):
    return sorted(r[0] for r in df.select(S.RID).collect())


ALL = ["20260301000000-0", "20260301001500-0", "20260301001500-1", "20260302000000-0", "20260302000000-1", "20260302000000-2"]
WHEN = ("2026-03-01 00:00:00", "2026-03-02 23:45:00")


@pytest.mark.parametrize("where", ["write", "publish"])
def test_a_write_that_fails_halfway_is_repeated(spark, scratch, drops, monkeypatch, where):
    """The second day's run dies while it writes, or after it; the next call gives the same rows as one that never failed."""
    landed = os.path.join(scratch, "landed")
    good = getattr(landing, {"write": "write_run", "publish": "publish"}[where])
    calls = []

    def dies(*args, **kw):
        calls.append(1)
        if len(calls) == 2:
            if where == "write":  # some files are there already
                good(args[0].limit(1), *args[1:], **kw)
            raise OSError("lost")
        return good(*args, **kw)

    monkeypatch.setattr(landing, good.__name__, dies)
    with pytest.raises(OSError):
        gkg.ingest_missing(spark, drops, landed, *WHEN)
    assert ids(gkg.scan_range(spark, landed, *WHEN)) == ALL[:3]
    assert len(ids(spark.read.parquet(landed))) > 3  # rows that don't count
    assert len(gkg.ingest_missing(spark, drops, landed, *WHEN)) == 1
    assert ids(gkg.scan_range(spark, landed, *WHEN)) == ALL
    assert gkg.ingest_missing(spark, drops, landed, *WHEN) == []
    assert len(landing.sweep(spark, landed, older_than_s=-5)) == 1
    assert ids(gkg.scan_range(spark, landed, *WHEN)) == ALL == ids(spark.read.parquet(landed))


def test_two_runs_that_publish_the_same_drops(spark, scratch, drops):
    landed = os.path.join(scratch, "landed")
    recs = gkg.read_drops(spark, drops)
    for _ in range(2):
        run = landing.new_run()
        landing.write_run(recs, landed, run)
        landing.publish(spark, landed, run)
    assert spark.read.parquet(landed).count() == 12 and ids(landing.read_landed(spark, landed)) == ALL
    assert {r["drop"]: r["rows"] for r in landing.published(spark, landed).collect()} == {"20260301000000": 1, "20260301001500": 2, "20260302000000": 3}


def test_folder_without_manifest_is_read_but_not_mixed(spark, scratch, drops):
    landed = os.path.join(scratch, "old")
    gkg.land(gkg.read_drops(spark, drops), landed)
    assert ids(gkg.scan_range(spark, landed, *WHEN)) == ALL
    with pytest.raises(ValueError, match="manifest"):
        gkg.ingest_missing(spark, drops, landed, *WHEN)


# ---- zip source

BAD = {"a-ragged": "x\ty\nz", "b-short": "x\ty", "c-empty": "", "d-bytes": None, "f-inside": _line("1") + "\n\n" + _line("2")}


@pytest.mark.parametrize("text", [b"a\tb\n\nc\td\n", b"\n\na\tb\n", b"a\tb\r\nc\td\r\n\r\n\n", b"a\tb\nc\td", b"\n\r\n", b"a\tb\nc\xff\td\n", "é\tü\n".encode() * 9, b"a\tb\nc\n", b""])
@pytest.mark.parametrize("block", [1, 3, 7, 1 << 20])
def test_blocks_of_lines_are_judged_like_lines(monkeypatch, text, block):
    monkeypatch.setattr(Z, "BLOCK", block)
    monkeypatch.setattr(gkg, "EXPECTED_FIELDS", 2)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("x.csv", text)
    status, lines = gkg._inflate(packed.getvalue(), False)
    z = zipfile.ZipFile(packed)
    assert Z.check(z) == (status, len(lines))
    if status == "ok":
        assert [x for b in Z._blocks(z, "x.csv") for x in b][: len(lines)] == lines


def test_small_drops_still_occupy_every_core(spark, drops):
    """All drops together are far under ``bytesPerPartition``."""
    spark.dataSource.register(Z.ZipDrops)
    files = Z.listed(drops)
    assert len(Z.packed(drops, files, Z.spread(files, Z.BYTES_PER_PARTITION, 1))) == 1
    rows = Z.read_zipped(spark, drops)
    assert len(files) >= rows.rdd.getNumPartitions() > min(len(files), spark.sparkContext.defaultParallelism) // 2


def test_zip_source_keeps_the_rules_of_a_file(spark, scratch, drops):
    for name, text in BAD.items():
        with zipfile.ZipFile(f"{drops}/{name}.zip", "w") as z:
            z.writestr("x.csv", text.encode() if text is not None else b"\xff" + _line("1").encode())
    with open(f"{drops}/e-none.zip", "wb") as f:
        f.write(b"no zip")
    _zip(f"{drops}/20260303000000.zip", (_line("20260303000000-0").replace("\t", "\t", 1) + "\r\n" + _line("20260303000000-1") + "\r\n\r\n\n").encode())
    spark.dataSource.register(Z.ZipDrops)
    for limit in (1, 10**9):
        lines = spark.read.format(Z.NAME).option("bytesPerPartition", limit).load(drops)
        status = {os.path.basename(r.file_path): r.status for r in lines.collect()}
        assert {k: v for k, v in status.items() if v != "ok"} == {"a-ragged.zip": "ragged", "b-short.zip": "too_few_columns", "c-empty.zip": "empty", "d-bytes.zip": "invalid_utf8", "e-none.zip": "bad_zip", "f-inside.zip": "ragged"}
        assert lines.rdd.getNumPartitions() == (10 if limit == 1 else 1)
        key = lambda r: tuple(map(str, r))
        assert sorted(map(key, Z.read_zipped(spark, drops, bytesPerPartition=limit).collect())) == sorted(map(key, gkg.read_drops(spark, drops).collect()))
    assert Z.read_zipped(spark, scratch + "/nothing").count() == 0


def test_lines_come_in_batches(monkeypatch):
    monkeypatch.setattr(gkg, "LINES_PER_BATCH", 3)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a", "\n".join(_line(str(k)) for k in range(8)))

    class One:
        def open_input_file(self, path):
            return io.BytesIO(buf.getvalue())

    got = list(Z.read_drop(One(), "p", "shown"))
    assert [b.num_rows for b in got] == [3, 3, 2] and [n for b in got for n in b.column(2).to_pylist()] == list(range(8))


def test_zip_stream_takes_each_drop_once(spark, scratch, drops):
    def drain():
        q = (Z.stream_zipped(spark, drops).writeStream.format("parquet").option("path", scratch + "/out")
             .option("checkpointLocation", scratch + "/ck").trigger(availableNow=True).start())
        q.awaitTermination()
        return ids(spark.read.parquet(scratch + "/out"))

    assert drain() == ALL
    assert drain() == ALL
    _zip(f"{drops}/20260305000000.gkg.csv.zip", _line("20260305000000-9").encode())
    _zip(f"{drops}/20260306000000.gkg.csv.zip", b"")
    assert drain() == [*ALL, "20260305000000-9"]


# ---- dedup over the whole history

def test_a_repeat_a_year_later_is_dropped(spark, scratch):
    src = scratch + "/src"
    os.makedirs(src)

    def put(stamp, rids, source="a.com"):
        with open(f"{src}/{stamp}.gkg.csv", "w") as f:
            f.write("\n".join(_line(r).replace("\t", "\t") for r in rids) + "\n")

    def drain():
        q = HI.land_deduped(ST.drop_stream(spark, src), scratch + "/out", scratch + "/ck")
        q.awaitTermination()
        return q

    put("20250301000000", ["20250301000000-1", "20250301000000-2", "20250301000000-1"])
    q = drain()
    assert HI.state_size(q)["rows"] == 2
    before = spark.conf.get(HI.PROVIDER)
    put("20260301000000", ["20250301000000-1", "20260301000000-7"])
    q = drain()
    rows = spark.read.parquet(scratch + "/out")
    assert ids(rows) == ["20250301000000-1", "20250301000000-2", "20260301000000-7"]
    size = HI.state_size(q)
    assert size["rows"] == 3 and size["bytes"] > 0  # one entry per distinct id, and nothing else
    assert spark.conf.get(HI.PROVIDER) == before


# ---- large dictionaries

def plain_count(text, patterns):
    return sum(len(re.findall(p, text)) for p in patterns)


@pytest.mark.parametrize("seed", range(4))
def test_automaton_counts_like_one_regex_per_entry(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ABÉ_") for _ in range(rng.randrange(1, 4)))
    entries = [rng.choice([" ", "-", "'", "  "]).join(word() for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    entries += entries[:5]  # listed twice: counts twice
    texts = ["".join(rng.choice([word(), " ", "-", ".", "'", rng.choice(entries)]) for _ in range(rng.randrange(40))) for _ in range(150)] + ["", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    bounded, plain = TM.word_terms(entries), TM.substring_terms(entries)
    odd = TM.pattern_terms([r"A+B", r"\bB(A|É)"])
    got = {r.k: tuple(r)[1:] for r in df.select("k", AU.count_terms("t", bounded), AU.count_terms("t", plain), AU.count_terms("t", bounded + odd), AU.count_terms("t", odd)).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        b, p = plain_count(t, [rf"\b{re.escape(e)}\b" for e in entries]), plain_count(t, [re.escape(e) for e in entries])
        o = plain_count(t, [r"A+B", r"\bB(?:A|É)"])
        assert got[k] == (b, p, b + o, o), t


def test_automaton_classifies_like_the_regexes(spark):
    cats = {"x": [r"\bfire\b", "smoke"], "y": [r"stab(bed|bing)", "knife"], "none": [], "z": ["smoke", r"\bout of town\b"]}
    texts = ["a fire", "fires", "SMOKED", "he was stabbed out of town", None, "", "knife", "out of townhouse"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    a, b = AU.classify("t", cats), TM.classify("t", cats)
    rows = df.select("k", a.alias("a"), b.alias("b")).orderBy("k").collect()
    assert [r.a for r in rows] == [r.b for r in rows] == [["x"], ["UNKNOWN"], ["x", "z"], ["y", "z"], ["UNKNOWN"], ["UNKNOWN"], ["y"], ["UNKNOWN"]]
