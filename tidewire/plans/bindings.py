"""Bindings of the news data model onto the driver's test tables.

The driver supplies TPC-H-like tables plus ``documents``/``pages``/``events``.
Each binding derives a frame of the reference's data model from them with
Spark expressions only, so every registered query reads the whole given
tables and its work grows with them.

* articles    -- ``lineitem`` joined with ``part``: one article per line
  item; headline = part name, source = supplier, url carries the order key as
  a 6+ digit article id, tone (integer percent) from tax and discount.
* records     -- ``documents``: one knowledge-graph record per document,
  themes = the text's words as ``WORD,1`` tokens, locations = the text,
  date = 15-minute steps by document id.
* tone events -- ``events``: tone tuple from ``value`` (in cents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S

#: first instant of the synthetic record clock used by :func:`records`
RECORD_EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, spread over the cores when its file layout is coarser.

    The test tables are single Parquet row groups, which Spark cannot split:
    every narrow step after the scan (string building, whole-text regexes)
    would run in one task.  When a scan yields fewer partitions than the
    session's parallelism the rows are dealt round-robin over that many
    partitions.  So they are when most rows stand in a few of the scan's
    partitions: a split without the middle of a row group holds no rows, so a
    file of few large row groups gives many partitions and little to most of them.
    Inputs laid out for a cluster (many files / row groups)
    already have enough partitions and are left untouched -- no extra shuffle.
    """
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    key = (path, spark.sparkContext.applicationId)
    if key not in _SPREAD:  # planning the scan once per table
        _SPREAD[key] = spread_over(df, spark.sparkContext.defaultParallelism)
    return df.repartition(_SPREAD[key]) if _SPREAD[key] else df


_SPREAD: dict = {}


def spread_over(df: DataFrame, want: int) -> int:
    """The partitions that a scan's rows are to be dealt over; 0 if they lie well as they are: no
    partition holds more than twice an even share.  Rows are counted by the files' footers."""
    parts = df.rdd.getNumPartitions()
    if parts < want:
        return want
    held = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("rows"))
    rows, most = held.agg(F.sum("rows"), F.max("rows")).first()
    return parts if rows and most * want > 2 * rows else 0


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article rows (rid, date, source, url, headline, tone tuple)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_tax", "l_discount")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    j = li.join(pa, li.l_partkey == pa.p_partkey)
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias(S.RID),
        F.col("l_shipdate").alias(S.DATE),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias(S.SOURCE),
        F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example.com/news/"),
                 (F.col("l_orderkey") + 100000).cast("string"), F.lit(".html")).alias(S.URL),
        F.col("p_name").alias(S.HEADLINE),
        F.concat_ws(",", F.round((F.col("l_tax") - F.col("l_discount")) * 100).cast("bigint"),
                    F.round(F.col("l_tax") * 100).cast("bigint"),
                    F.round(F.col("l_discount") * 100).cast("bigint")).alias("V1.5TONE"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed knowledge-graph records (10 columns + ``date``) from documents."""
    doc = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    date = (F.lit(RECORD_EPOCH).cast("timestamp_ntz")
            + F.make_dt_interval(days=F.expr("doc_id div 96").cast("int"), mins=(F.col("doc_id") % 96 * 15).cast("int")))
    # the text's words (A-Z runs of the upper-cased text) as WORD,1 tokens
    words = F.regexp_replace(F.regexp_replace(F.upper(F.col("text")), "[^A-Z]+", ";"), "^;+|;+$", "")
    themes = F.regexp_replace(words, "([A-Z]+)", "$1,1")
    # built inside one Generate so filters on these derived columns cannot be
    # inlined below it (each text-derived column is computed once per row)
    return doc.select(F.inline(F.array(F.struct(
        F.concat(F.date_format(date, "yyyyMMddHHmmss"), F.lit("-"), F.col("doc_id").cast("string")).alias(S.RID),
        F.col("source").alias(S.SOURCE),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/news/"),
                 (F.col("doc_id") + 100000).cast("string"), F.lit("/story.html")).alias(S.URL),
        F.col("lang").alias("V1THEMES"),
        themes.alias("V2ENHANCEDTHEMES"),
        F.col("lang").alias("V1LOCATIONS"),
        F.col("text").alias("V2ENHANCEDLOCATIONS"),
        F.lit(None).cast("string").alias("V1ORGANIZATIONS"),
        F.lit(None).cast("string").alias("V2ENHANCEDORGANIZATIONS"),
        F.concat_ws(",", F.col("n_chars") % 21 - 10, F.col("n_chars"), F.col("doc_id")).alias("V1.5TONE"),
        date.alias(S.DATE),
    ))))


def tone_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a tone tuple from ``events`` (value in cents)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "value", "event_type")
    return ev.select(
        F.col("event_id").alias(S.RID), F.col("ts").alias(S.DATE),
        F.col("event_type").alias(S.SOURCE),
        F.concat(F.round(F.col("value") * 100).cast("bigint").cast("string"), F.lit(",1,2")).alias("V1.5TONE"),
    )


def drop_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` rendered as raw 27-field tab-separated drop lines.

    Record id = the event's 15-minute drop stamp + event id; NA and empty
    fields exercise the parser's null tokens.
    """
    ev = table(spark, sf_dir, "events")
    ts = F.col("ts")
    drop = (F.date_trunc("hour", ts).cast("timestamp_ntz")
            + F.make_dt_interval(mins=(F.floor(F.minute(ts) / 15) * 15).cast("int")))
    rid = F.concat(F.date_format(drop, "yyyyMMddHHmmss"), F.lit("-"), F.col("event_id").cast("string"))
    fields = [F.lit("")] * len(S.RAW_COLUMNS)
    fields[0] = rid
    fields[1] = F.date_format(drop, "yyyyMMddHHmmss")
    fields[3] = F.concat(F.col("event_type"), F.lit(".example.com"))
    fields[4] = F.concat(F.lit("https://"), F.col("event_type"), F.lit(".example.com/"),
                         (F.col("event_id") + 100000).cast("string"), F.lit(".html"))
    fields[7] = F.upper(F.col("event_type"))
    fields[8] = F.concat(F.upper(F.col("event_type")), F.lit(","), F.col("user_id").cast("string"))
    fields[10] = F.col("props")
    fields[13] = F.lit("NA")
    fields[15] = F.concat(F.round(F.col("value") * 100).cast("bigint").cast("string"), F.lit(",1,2"))
    fields[26] = F.lit("<xml/>")
    return ev.select(F.concat_ws("\t", *fields).alias("value"))


def write_drops(spark: SparkSession, sf_dir: str, files: int = 8) -> str:
    """Write :func:`drop_lines` as text drops into the checkpoint folder."""
    import uuid
    from ..session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/drops/{uuid.uuid4().hex}"
    drop_lines(spark, sf_dir).repartition(files).write.text(path)
    return path


def relabelled(lines: DataFrame, suffix: str, source: str) -> DataFrame:
    """Raw lines with ``suffix`` behind the record id and another source."""
    f = F.split("value", "\t", -1)
    return lines.select(F.concat_ws("\t", F.concat(f[0], F.lit(suffix)), F.slice(f, 2, 2), F.lit(source), F.slice(f, 5, len(S.RAW_COLUMNS))).alias("value"))


def write_zip_drops(lines: DataFrame, folder: str) -> str:
    """Write raw lines as zipped drops, one per stamp (the first 14 characters), into a shared folder."""
    spark = lines.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)

    def write(pdf):
        import io
        import zipfile

        import pandas as pd
        import pyarrow.fs as pafs
        fs, inner = pafs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        stamp = pdf["stamp"].iloc[0]
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(f"{stamp}.gkg.csv", "\n".join(pdf["value"]) + "\n")
        with fs.open_output_stream(f"{inner}/{stamp}.gkg.csv.zip") as f:
            f.write(buf.getvalue())
        return pd.DataFrame({"stamp": [stamp]})

    lines.select(F.substring("value", 1, 14).alias("stamp"), "value").groupBy("stamp").applyInPandas(write, "stamp string").agg(F.count("*")).collect()
    return folder
