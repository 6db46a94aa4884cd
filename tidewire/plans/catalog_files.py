"""Registered queries of file jobs: bucketed headline cache, total order, file health, files under their own names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as FI
from ..sources import headline_store as HS
from ..sources import quarantine as Q
from ..sources import single_files as SI
from ..sources import sorted_files as SO
from . import bindings as B
from .catalog import register, scratch

STORE_BUCKETS = 64


@register("headline_store", f"""
SELECT url, headline, seen_at, CAST(('0x' || substr(md5(url), 1, 8))::BIGINT % {STORE_BUCKETS} AS INTEGER) AS bucket FROM (
  SELECT 'https://s.example.com/news/' || CAST(o_custkey AS VARCHAR) AS url, o_orderpriority AS headline, CAST(o_orderdate AS DATE) AS seen_at,
         row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderpriority DESC) AS k
  FROM orders WHERE o_custkey IS NOT NULL) WHERE k = 1""")
def q_headline_store(spark, d):
    """The cache is made of one half of the orders and takes the other, old entries included."""
    o = B.table(spark, d, "orders")
    rows = o.where("o_custkey IS NOT NULL").select(F.concat(F.lit("https://s.example.com/news/"), F.col("o_custkey").cast("string")).alias("url"),
                                                   F.col("o_orderpriority").alias("headline"), F.col("o_orderdate").cast("date").alias("seen_at"), "o_orderkey")
    path = scratch(spark, "headline-store")
    odd = F.col("o_orderkey") % 2 == 1
    HS.upsert_store(spark, path, rows.where(odd), STORE_BUCKETS)
    HS.upsert_store(spark, path, rows.where(~odd))
    return HS.read_store(spark, path)


SORTED = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("sorted_positions", f"SELECT row_number() OVER (ORDER BY {', '.join(f'{c} NULLS FIRST' for c in SORTED)}) AS position, {', '.join(SORTED)} FROM lineitem")
def q_sorted_positions(spark, d):
    """O1: the position of every row of a table written in total order."""
    path = scratch(spark, "sorted")
    SO.write_sorted(B.table(spark, d, "lineitem").select(*SORTED), path, *(F.col(c).asc() for c in SORTED))
    return SO.read_positions(spark, path)


@register("file_health", """
SELECT kind, CAST(NULL AS VARCHAR) AS reason, CAST(count(*) AS BIGINT) AS rows, CAST(6 AS BIGINT) AS columns FROM (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'narrow' WHEN event_id % 3 = 1 THEN 'whole' ELSE 'wide' END AS kind FROM events) WHERE kind <> 'narrow' GROUP BY kind
UNION ALL SELECT 'narrow', 'few_columns', count(*), 2 FROM events WHERE event_id % 3 = 0 HAVING count(*) > 0
UNION ALL SELECT 'cut', 'bad_magic', 0, NULL""")
def q_file_health(spark, d):
    """The events in files of six and of two columns, and a copy that lacks its end."""
    ev = B.table(spark, d, "events").select("event_id", "event_type", "value", "user_id")
    wide = ev.withColumn("twice", F.col("event_id") * 2).withColumn("half", F.col("event_id") / 2)
    path = scratch(spark, "health")
    kind = F.col("event_id") % 3
    for name, rows in (("narrow", ev.where(kind == 0).select("event_id", "value")), ("whole", wide.where(kind == 1)), ("wide", wide.where(kind == 2))):
        rows.write.parquet(f"{path}/{name}")
    cut_copy(spark, FI.list_files(spark, f"{path}/whole", ".parquet")[0], f"{path}/cut/part.parquet")
    found = Q.file_health(spark, path).withColumn("kind", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1))
    return found.groupBy("kind", "reason").agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows"), F.max("columns").alias("columns"))


def cut_copy(spark, source: str, target: str) -> None:
    """The first half of a file, copied by the file system's streams."""
    jvm = spark.sparkContext._jvm
    fs, a = FI._fs(spark, source)
    _, b = FI._fs(spark, target)
    reader, writer = fs.open(a), fs.create(b)
    try:
        jvm.org.apache.commons.io.IOUtils.copyLarge(reader, writer, 0, fs.getFileStatus(a).getLen() // 2)
    finally:
        reader.close()
        writer.close()


@register("csv_file", "SELECT 'efbbbf' AS first_bytes, event_id, event_type, CAST(user_id AS VARCHAR) AS user_id, NULLIF(props, '') AS props FROM events")
def q_csv_file(spark, d):
    """One CSV with a byte order mark, JSON texts quoted, read back; the second writer takes a free name."""
    ev = B.table(spark, d, "events").select("event_id", "event_type", "user_id", "props")
    wanted = f"{scratch(spark, 'csv-file')}/events.csv"
    SI.write_csv_file(ev.limit(0), wanted)
    path = SI.write_csv_file(ev, wanted, F.col("event_id"))
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.select(F.lit(first_bytes(spark, path, 3)).alias("first_bytes"), F.col("event_id").cast("long"), "event_type", "user_id", "props")


@register("json_array", "SELECT event_id, event_type, user_id, value, props, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS ts FROM events")
def q_json_array(spark, d):
    """One JSON array of all events, read back as one document."""
    ev = B.table(spark, d, "events").select("event_id", "event_type", "user_id", "value", "props", "ts")
    path = SI.write_json_array(ev, f"{scratch(spark, 'json-array')}/events.json", F.col("event_id"))
    schema = "event_id long, event_type string, user_id long, value double, props string, ts string"
    return SI.read_json_array(spark, path, schema)


@register("named_files", """
SELECT o_orderpriority || '.csv' AS file_name, count(*) AS rows, CAST(sum(o_custkey) AS BIGINT) AS customers,
       CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + length(CAST(o_custkey AS VARCHAR)) + 2) + length('o_orderkey,o_custkey') + 1 AS BIGINT) AS bytes
FROM orders WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL GROUP BY o_orderpriority""")
def q_named_files(spark, d):
    """Orders in one CSV per priority, under its name; sizes from the manifest, rows from the files."""
    o = B.table(spark, d, "orders").where("o_orderkey IS NOT NULL AND o_custkey IS NOT NULL")
    folder = scratch(spark, "named-files")
    SI.write_named_csvs(o.select("o_orderkey", "o_custkey", F.concat("o_orderpriority", F.lit(".csv")).alias("source_file")), folder, F.col("o_orderkey"))
    rows = spark.read.schema("o_orderkey long, o_custkey long").option("header", True).csv(f"{folder}/*.csv").withColumn("file_name", F.url_decode(F.col("_metadata.file_name")))
    counts = rows.groupBy("file_name").agg(F.count("*").alias("rows"), F.sum("o_custkey").alias("customers"))
    sizes = FI.dataset_manifest(spark, folder).select(F.url_decode("file_name").alias("file_name"), F.col("length").alias("bytes"))
    return counts.join(sizes, "file_name")


def first_bytes(spark, path: str, n: int) -> str:
    """The first bytes of a file, as hex."""
    fs, p = FI._fs(spark, path)
    f = fs.open(p)
    try:
        return bytes(f.read() for _ in range(n)).hex()
    finally:
        f.close()
