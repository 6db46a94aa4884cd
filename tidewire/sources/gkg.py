"""Raw knowledge-graph drops: read, validate, parse, land.

A drop is one zipped, headerless, tab-separated file per 15 minutes.  Spark
has no zip reader, so the only Python step is the unzip: ``binaryFile``
lists the drops (a partition holds at most ``maxPartitionBytes`` of zipped
content) and ``mapInPandas`` inflates each one into lines.  Splitting into
the 27 columns, null tokens, timestamps and everything after run JVM-side.

File-level rules follow the reference reader: a file with fewer than 27
fields, with lines of differing field counts, with invalid UTF-8, or empty is
rejected as a whole; extra fields are cut.  One deliberate difference (D1):
the reference reads the first line as a header and so loses one record per
drop; here all lines are kept unless ``drop_first_line=True``.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import text as X

#: The text tokens the reference's CSV reader turns into null
#: (pyarrow's default null spellings).
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
               "1.#QNAN", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null")

EXPECTED_FIELDS = len(S.RAW_COLUMNS)

#: Lines of a drop that one Arrow batch carries.
LINES_PER_BATCH = 10_000

LINES_SCHEMA = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("line", T.StringType()),
])


def _inflate(content: bytes, drop_first_line: bool) -> tuple[str, list[str]]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            if not names:
                return "empty_zip", []
            raw = z.read(names[0])
    except (zipfile.BadZipFile, OSError, EOFError):
        return "bad_zip", []
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return "invalid_utf8", []
    # only \n ends a line (with an optional \r before it), as in the text reader
    lines = [ln.removesuffix("\r") for ln in text.split("\n")]
    while lines and lines[-1] == "":
        lines.pop()
    if not lines:
        return "empty", []
    counts = {ln.count("\t") + 1 for ln in lines}
    if len(counts) > 1:
        return "ragged", []
    if counts.pop() < EXPECTED_FIELDS:
        return "too_few_columns", []
    return "ok", (lines[1:] if drop_first_line else lines)


def _unzip_batches(drop_first_line: bool):
    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                status, lines = _inflate(bytes(content), drop_first_line)
                if status != "ok":
                    yield pd.DataFrame({"file_path": [path], "status": [status],
                                        "line_no": pd.Series([None], dtype="object"), "line": [None]})
                # one drop at a time, in pieces of bounded length
                for at in range(0, len(lines) if status == "ok" else 0, LINES_PER_BATCH):
                    part = lines[at:at + LINES_PER_BATCH]
                    yield pd.DataFrame({"file_path": path, "status": "ok", "line": part,
                                        "line_no": pd.Series(range(at, at + len(part)), dtype="object")})
    return run


def read_drop_lines(spark: SparkSession, path, drop_first_line: bool = False,
                    glob: str = "*.zip") -> DataFrame:
    """Lines of zipped drops with a per-file status (rejected files keep one
    row with a null line, so they can be reported).  ``path`` is a folder or
    a list of drop files."""
    paths = [path] if isinstance(path, str) else list(path)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(paths).select("path", "content"))
    return files.mapInPandas(_unzip_batches(drop_first_line), LINES_SCHEMA)


def split_fields(lines: DataFrame, line: str = "line") -> DataFrame:
    """Line -> the 27 named string columns (extra fields cut, null tokens)."""
    keep = [c for c in lines.columns if c != line]
    # a projection of its own: the line is split once, not twice for each column
    parts = lines.select(*keep, F.split(F.col(line), "\t", -1).alias("_parts"))
    cols = []
    for i, name in enumerate(S.RAW_COLUMNS):
        v = F.get("_parts", F.lit(i))
        cols.append(F.when(v.isin(*NULL_TOKENS), F.lit(None)).otherwise(v).alias(name))
    return parts.select(*keep, *cols)


def stamp_from_path(path_col) -> "F.Column":
    """``YYYYMMDDHHMMSS`` in a file name -> timestamp (NTZ), else null."""
    # cut at the last slash: a pattern held to the end tries every place of a long path, for each line
    name = F.substring_index(path_col, "/", -1)
    digits = F.regexp_extract(name, r"(\d{14})", 1)
    return X.stamp_time(digits)


def read_drops(spark: SparkSession, path, drop_first_line: bool = False) -> DataFrame:
    """S1 + S2 + X2: parsed records (10 columns + ``date``) of all good drops.

    ``date`` comes from the drop's file name, else from the record id.
    """
    lines = read_drop_lines(spark, path, drop_first_line).where(F.col("status") == "ok")
    raw = split_fields(lines)
    date = F.coalesce(stamp_from_path(F.col("file_path")), X.record_time(F.col(S.RID)))
    return raw.select(*[F.col(f"`{c}`") for c in S.PARSED_COLUMNS], date.alias(S.DATE))


def drop_report(spark: SparkSession, path: str) -> DataFrame:
    """S15 for raw drops: per file its status and line count."""
    lines = read_drop_lines(spark, path)
    return lines.groupBy("file_path", "status").agg(F.count("line").alias("lines"))


def parse_text_lines(t: DataFrame) -> DataFrame:
    """``file_path, line`` rows -> parsed records; files whose lines have
    differing or too few fields are rejected whole: one per-file aggregate,
    then an anti join with the few bad files, so good lines need no shuffle."""
    t = t.withColumn("_n", F.size(F.split("line", "\t", -1)))
    bad = (t.groupBy("file_path").agg(F.min("_n").alias("lo"), F.max("_n").alias("hi"))
           .where((F.col("lo") != F.col("hi")) | (F.col("lo") < EXPECTED_FIELDS)).select("file_path"))
    raw = split_fields(t.join(bad, "file_path", "left_anti").drop("_n"))
    date = F.coalesce(stamp_from_path(F.col("file_path")), X.record_time(F.col(S.RID)))
    return raw.select(*[F.col(f"`{c}`") for c in S.PARSED_COLUMNS], date.alias(S.DATE))


def read_text_drops(spark: SparkSession, path: str) -> DataFrame:
    """Unzipped drops (plain or gzip text): same parse, JVM only."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("line"))
    return parse_text_lines(t)


def land(df: DataFrame, path: str, date: str = S.DATE, mode: str = "append",
         records_per_file: int = 2_000_000) -> None:
    """Write records partitioned by calendar ``day`` (one folder per day
    replaces the 96 small files per day; dynamic overwrite replaces only the
    days present in ``df``).

    Rows are clustered by day with a rebalance: AQE cuts a large day into
    as many tasks as its bytes need and joins small days, and a file holds at
    most ``records_per_file`` records.
    """
    out = df.withColumn("day", F.to_date(F.col(date))).hint("rebalance", "day")
    w = out.write.option("maxRecordsPerFile", records_per_file).partitionBy("day")
    if mode == "overwrite":
        w = w.option("partitionOverwriteMode", "dynamic")
    w.mode(mode).parquet(path)


def scan_range(spark: SparkSession, path: str, start, end, date: str = S.DATE,
               skip_corrupt: bool = False) -> DataFrame:
    """S3: landed records in an inclusive range; the ``day`` predicate prunes
    partitions before any file is opened.  An unreadable file fails the read
    unless ``skip_corrupt`` asks to pass over it (``files.corrupt_file_report``
    then says which files those were)."""
    from . import landing
    df = landing.read_landed(spark, path, skip_corrupt)
    return (df.where(F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
            .where(F.col(date).between(F.lit(start), F.lit(end))))


def ingest_missing(spark: SparkSession, drops: str, landed: str, start, end,
                   glob: str = "*.zip") -> list[str]:
    """S16/T4 (batch form): land only the drops of ``[start, end]`` whose
    15-minute stamp has no published rows yet; returns the drop files read.

    The grid minus the stamps of the manifest is a Spark anti join (J8); the drop folder
    is listed without reading content, and the paths of missing stamps reach
    the driver one day after the other to name the read.  Each day is a run of its own
    (``landing``): written, then published by one manifest file.  A run that fails
    halfway leaves nothing that counts, so it can be repeated at any time.
    A drop that yielded no rows (corrupt, empty) stays missing and is tried
    again next time (D13).
    """
    from ..operators import grid as G
    from . import landing
    from .files import _fs
    bounds = spark.range(1).select(F.lit(start).cast("timestamp_ntz").alias("start"),
                                   F.lit(end).cast("timestamp_ntz").alias("end"))
    grid = G.interval_grid(bounds)
    fs, p = _fs(spark, landed)
    if landing.has_manifest(spark, landed):
        missing = grid.join(landing.published(spark, landed).select(F.col("drop").alias("stamp")), "stamp", "left_anti")
    elif fs.exists(p) and any(s.getPath().getName().startswith("day=") for s in fs.listStatus(p)):
        raise ValueError(f"{landed} holds records without a manifest: land new drops in a folder of their own")
    else:
        missing = grid
    listing = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
               .option("recursiveFileLookup", "true").load(drops).select("path"))
    wanted = listing.withColumn("stamp", F.date_format(stamp_from_path(F.col("path")), "yyyyMMddHHmmss"))
    due = wanted.join(missing.select("stamp"), "stamp", "left_semi").select("stamp", "path").orderBy("stamp", "path")
    done: list[str] = []

    def land_day(files: list[str]) -> None:
        run = landing.new_run()
        landing.write_run(read_drops(spark, files), landed, run)
        landing.publish(spark, landed, run)
        done.extend(files)

    day: list[str] = []
    last = None
    # day by day, at most 96 stamps at once
    for stamp, file in due.toLocalIterator():
        if day and stamp[:8] != last:
            land_day(day)
            day = []
        last = stamp[:8]
        day.append(file)
    if day:
        land_day(day)
    return sorted(done)
