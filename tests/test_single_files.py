"""Files under their own names, byte for byte."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.sources import files as FS
from tidewire.sources import single_files as SI

ODD = 'a "quoted", text\nover two lines; é'


def table(spark, n=3000, parts=7):
    return spark.range(n).repartition(parts).select("id", F.when(F.col("id") % 5 == 0, ODD).when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("t"))


def left_over(folder):
    return [x for x in os.listdir(folder) if x.startswith(".") and not x.endswith(".crc")]


def test_one_csv_with_a_mark_in_order(spark, scratch, monkeypatch):
    monkeypatch.setattr(SI, "BLOCK", 100)
    path = SI.write_csv_file(table(spark), f"{scratch}/out/x.csv", F.col("id"))
    data = open(path, "rb").read()
    assert path.endswith("/x.csv") and data[:3] == SI.BOM and data.count(SI.BOM) == 1 and data.count(b"id,t\n") == 1
    got = pd.read_csv(path, keep_default_na=False, dtype=str)
    assert got["id"].tolist() == [str(k) for k in range(3000)]
    assert got["t"].tolist() == [ODD if k % 5 == 0 else str(k) if k % 7 else "" for k in range(3000)]
    assert FS.read_csv(spark, path).columns == ["id", "t"] and FS.read_csv(spark, path).count() == 3000
    assert SI.write_csv_file(table(spark, 3), f"{scratch}/out/x.csv", bom=False).endswith("x (1).csv") and open(path, "rb").read() == data
    assert not left_over(f"{scratch}/out")


def test_csv_and_json_without_rows(spark, scratch):
    assert open(SI.write_csv_file(table(spark).limit(0), f"{scratch}/o/x.csv"), "rb").read() == SI.BOM + b"id,t\n"
    assert json.load(open(SI.write_json_array(table(spark).limit(0), f"{scratch}/o/x.json"))) == []
    assert SI.write_named_csvs(table(spark).limit(0), f"{scratch}/n", name_col="t") == []


def test_json_array_keeps_nulls_and_order(spark, scratch):
    got = json.load(open(SI.write_json_array(table(spark).withColumn("at", F.timestamp_seconds(F.lit(0.5)).cast("timestamp_ntz")), f"{scratch}/o/x.json", F.col("id").desc())))
    assert [r["id"] for r in got] == list(range(2999, -1, -1)) and {r["at"][-6:] for r in got} == {"00.500"}
    assert all(r["t"] == (ODD if r["id"] % 5 == 0 else str(r["id"]) if r["id"] % 7 else None) for r in got)


def test_a_file_per_input_under_its_name(spark, scratch):
    """One name holds most rows; names with spaces, signs and no name at all."""
    name = F.when(F.col("id") % 10 == 1, "2024 a&b=c%.csv").when(F.col("id") % 10 == 2, F.lit(None)).when(F.col("id") % 10 == 3, "").otherwise("hot.csv")
    rows = table(spark).withColumn("source_file", name)
    folder = f"{scratch}/n"
    assert SI.write_named_csvs(rows, folder, F.col("id")) == ["2024 a&b=c%.csv", "hot.csv", "unnamed.csv"] and not left_over(folder)
    kinds = {1: "2024 a&b=c%.csv", 2: "unnamed.csv", 3: "unnamed.csv"}
    for file in set(kinds.values()) | {"hot.csv"}:
        got = pd.read_csv(f"{folder}/{file}")
        assert got.columns.tolist() == ["id", "t"] and got["id"].tolist() == [k for k in range(3000) if kinds.get(k % 10, "hot.csv") == file]
    SI.write_named_csvs(rows.where("id = 4"), folder, F.col("id"), bom=True)  # replaced; the others stay
    assert open(f"{folder}/hot.csv", "rb").read() == SI.BOM + b"id,t\n4,4\n" and len(pd.read_csv(f"{folder}/unnamed.csv")) == 600
    with pytest.raises(ValueError):
        SI.write_named_csvs(rows.withColumn("source_file", F.lit("../x.csv")), folder)


def test_many_tasks_write_one_file_and_read_it(spark, scratch, monkeypatch):
    """No task holds more than a piece or a split of the array."""
    monkeypatch.setattr(SI, "PIECE", 10_000)
    pieces = SI._pieces({"x": [("a", 25_000), ("b", 3)]}, b"[\n", b"\n]\n", 2)
    assert [(p[1], p[2], p[3], p[4]) for p in pieces] == [(None, 0, 2, 0), ("a", 0, 10_000, 2), ("a", 10_000, 10_000, 10_002), ("a", 20_000, 5_000, 20_002), ("b", 0, 1, 25_002), (None, 0, 3, 25_003)]
    path = SI.write_json_array(table(spark), f"{scratch}/o/x.json", F.col("id"))
    assert [r["id"] for r in json.load(open(path))] == list(range(3000)) and not left_over(f"{scratch}/o")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = SI.read_json_array(spark, path, "id long, t string")
        assert got.rdd.getNumPartitions() > 3
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, table(spark).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    empty = SI.write_json_array(table(spark).limit(0), f"{scratch}/o/y.json")
    assert SI.read_json_array(spark, empty, "id long, t string").count() == 0


@pytest.mark.parametrize("text", ['[\n{"id":1}\n{"id":2}\n]\n', '[\n{"id":1},\n{"id":2},\n]\n', '[\n{"id":1},\n{"id":2}\n', '{"id":1},\n{"id":2}\n]\n', '[\n{"id":1}\n]\n[\n]\n'])
def test_what_is_no_array_is_not_read(spark, scratch, text):
    with open(f"{scratch}/x.json", "w") as f:
        f.write(text)
    with pytest.raises(ValueError):
        SI.read_json_array(spark, f"{scratch}/x.json", "id long")
