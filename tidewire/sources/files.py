"""Monthly CSV inputs, sinks and file health.

Driver-side work is limited to file *metadata* (listing names, reading a CSV
header for the required-column gate, choosing a free output name); no data
passes through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import text as X


#: Bytes of a CSV with line breaks in its fields that one task reads, and that it holds at once.
CSV_PIECE = 64 << 20
CSV_BLOCK = 4 << 20
_CSV_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_CSV_RECORD = re.compile(f"{_CSV_FIELD}(?:,{_CSV_FIELD})*")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """File paths (not contents) of a folder, sorted, via the Hadoop FS."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(p)
                  if s.isFile() and s.getPath().getName().lower().endswith(suffix))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """S5/S7 input: header, all columns as text, quotes/newlines inside
    fields restored; Spark drops a UTF-8 BOM by itself."""
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .option("inferSchema", False).option("encoding", "UTF-8").csv(path))


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV: only its first line is read (through the
    Hadoop FS, no Spark job); a UTF-8 BOM is dropped."""
    import csv
    jvm = spark.sparkContext._jvm
    fs, p = _fs(spark, path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
    try:
        line = reader.readLine() or ""
    finally:
        reader.close()
    return next(csv.reader([line.lstrip("\ufeff")]), [])


def _csv_records(f, start: int, end: int, inside: bool) -> Iterator[list[bytes]]:
    """Records that begin after the first line end at or behind ``start`` (at 0: with the file), up to the
    first line end at or behind ``end``.  ``inside``: whether ``start`` lies within quotes.  Line ends
    within quotes are none."""
    f.seek(start)
    held, at, quotes, begun = b"", start, int(inside), start == 0
    while block := f.read(CSV_BLOCK):
        codes = np.frombuffer(block, np.uint8)
        depth = np.cumsum(codes == 34) + quotes
        quotes = int(depth[-1])
        cuts = np.flatnonzero((codes == 10) & (depth % 2 == 0))
        stop = cuts[cuts + at >= end][:1]
        last, done, out = 0, False, []
        for c in cuts.tolist():
            if begun:
                out.append(held + block[last:c])
            held, last, begun = b"", c + 1, True
            if len(stop) and c == stop[0]:
                done = True
                break
        if out:
            yield out
        if done:
            return
        held = held + block[last:] if begun else b""
        at += len(block)
    if held:
        yield [held]


def _read_in_pieces(spark: SparkSession, cols: Sequence[str], files: Sequence[str]) -> tuple[DataFrame | None, list[str]]:
    """The rows of large files with these columns, many tasks to a file, and the files left for Spark's own
    reader: small ones, and those that aren't plain (a carriage return, a quote amid a field, no UTF-8).

    Spark can't split a file whose fields hold line breaks.  Here a first job counts the quotes of each piece,
    which tells whether the next one begins within a field; a second one looks whether all records are plain."""
    sizes = {p: _fs(spark, p)[0].getFileStatus(_fs(spark, p)[1]).getLen() for p in files}
    pieces = [(p, a, min(a + CSV_PIECE, n)) for p, n in sizes.items() if n > CSV_PIECE for a in range(0, n, CSV_PIECE)]
    if not pieces:
        return None, list(files)

    def opened(path: str):
        import pyarrow.fs as pafs
        fs, inner = pafs.FileSystem.from_uri(path)
        return fs.open_input_file(inner)

    def count(batches):
        for pdf in batches:
            for p, a, b in pdf.itertuples(index=False):
                quotes, returns, left = 0, 0, b - a
                with opened(p) as f:
                    f.seek(a)
                    while left > 0 and (block := f.read(min(CSV_BLOCK, left))):
                        quotes, returns, left = quotes + block.count(b'"'), returns + block.count(b"\r"), left - len(block)
                yield pd.DataFrame({"path": [p], "a": [a], "b": [b], "quotes": [quotes], "returns": [returns]})

    def plain(batches):
        for pdf in batches:
            for p, a, b, inside in pdf.itertuples(index=False):
                try:
                    with opened(p) as f:
                        ok = all(_CSV_RECORD.fullmatch(r.decode("utf-8")) for rs in _csv_records(f, a, b, bool(inside)) for r in rs)
                except UnicodeDecodeError:
                    ok = False
                yield pd.DataFrame({"path": [p], "ok": [ok]})

    def records(batches):
        for pdf in batches:
            for p, a, b, inside in pdf.itertuples(index=False):
                header = a == 0
                with opened(p) as f:
                    for rs in _csv_records(f, a, b, bool(inside)):
                        text = [r.decode("utf-8") for r in rs[int(header):] if r]
                        header = False
                        yield pd.DataFrame({"path": [p] * len(text), "record": pd.Series(text, dtype="object")})

    # one row per CSV_PIECE bytes comes to the driver
    dealt = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(len(rows))
    counted = dealt(pieces, "path string, a long, b long").mapInPandas(count, "path string, a long, b long, quotes long, returns long").collect()
    odd, within, before = set(), [], {}
    for r in sorted(counted, key=lambda r: (r.path, r.a)):
        within.append((r.path, r.a, r.b, before.get(r.path, 0) % 2 == 1))
        before[r.path] = before.get(r.path, 0) + r.quotes
        odd |= {r.path} if r.returns else set()
    odd |= {p for p, n in before.items() if n % 2}
    schema = "path string, a long, b long, inside boolean"
    if within := [x for x in within if x[0] not in odd]:
        odd |= {r.path for r in dealt(within, schema).mapInPandas(plain, "path string, ok boolean").where("NOT ok").select("path").distinct().collect()}
    whole = [p for p in files if p in odd or p not in before]
    if not (within := [x for x in within if x[0] not in odd]):
        return None, whole
    shown = {p: _fs(spark, p)[1].toUri().toString() for p in {x[0] for x in within}}
    ddl = ", ".join(f"`{c.replace('`', '``')}` string" for c in cols)
    rows = dealt(within, schema).mapInPandas(records, "path string, record string")
    rows = rows.join(F.broadcast(spark.createDataFrame(list(shown.items()), "path string, shown string")), "path")
    parsed = rows.select(F.from_csv("record", ddl, {"escape": '"'}).alias("r"), "shown")
    name = F.url_decode(F.regexp_extract("shown", r"([^/]*)$", 1))
    return parsed.select(*(F.col("r")[c].alias(c) for c in cols), name.alias("source_file")), whole


def read_monthly_csvs(spark: SparkSession, paths: Iterable[str],
                      required: Sequence[str] = (S.DATE, S.HEADLINE),
                      skipped: list[str] | None = None) -> DataFrame | None:
    """Files stacked by column name (missing columns -> null), with
    ``source_file``.  Files that lack a required column are left out; ``skipped``
    takes their paths.

    Only header lines are read on the driver (no Spark job per file).  Files with
    equal headers are one read with an explicit all-text schema, so the plan grows
    with the number of different headers and not of files.  Large plain files are read
    in pieces by many tasks.  A name that a header
    repeats gets a number behind it (``a``, ``a.1``), as readers of such files do.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        seen: dict[str, int] = {}
        cols = []
        for c in csv_header(spark, p):
            k = seen[c] = seen.get(c, -1) + 1
            cols.append(f"{c}.{k}" if k else c)
        if set(required) <= set(cols):
            by_header.setdefault(tuple(cols), []).append(p)
        elif skipped is not None:
            skipped.append(p)
    out = None
    for cols, every in by_header.items():
        large, files = _read_in_pieces(spark, cols, every)
        if large is not None:
            out = large if out is None else out.unionByName(large, allowMissingColumns=True)
        if not files:
            continue
        schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
        df = (spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True)
              .option("escape", '"').option("encoding", "UTF-8").csv(files))
        name = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1))
        df = df.select(*(F.col(f"`{c}`") for c in cols), name.alias("source_file"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_per_source_file(df: DataFrame, path: str, key: str = "source_file") -> None:
    """One output folder per input file (same name), one job."""
    df.write.mode("overwrite").partitionBy(key).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """S6 sink; the default mode never overwrites."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S7 sink: header, quoted as needed.  Difference: no UTF-8 BOM (Spark
    writes none; readers of these files, Spark included, do not need it)."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S8 sink: JSON lines, ISO timestamps."""
    (df.write.mode(mode).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS")
     .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS").json(path))


def free_path(spark: SparkSession, base: str) -> str:
    """``base`` if unused, else ``root (1).ext``, ``root (2).ext`` ..."""
    fs, p = _fs(spark, base)
    if not fs.exists(p):
        return base
    root, dot, ext = base.rpartition(".")
    if not dot or "/" in ext:
        root, ext = base, ""
    i = 1
    while True:
        cand = f"{root} ({i}).{ext}" if ext else f"{root} ({i})"
        fs2, p2 = _fs(spark, cand)
        if not fs2.exists(p2):
            return cand
        i += 1


def csv_to_parquet(spark: SparkSession, csv_path: str, out_dir: str) -> str:
    """Convert a CSV whose name holds ``YYYY-MM-DD_to_YYYY-MM-DD``; the
    output is named ``start_to_end_23-59-59.parquet``; no range -> error."""
    import re
    name = csv_path.rsplit("/", 1)[-1]
    m = re.search(r"(\d{4}-\d{2}-\d{2})_to_(\d{4}-\d{2}-\d{2})", name)
    if not m:
        raise ValueError("Could not extract date range from filename.")
    out = f"{out_dir.rstrip('/')}/{m.group(1)}_to_{m.group(2)}_23-59-59.parquet"
    read_csv(spark, csv_path).write.mode("errorifexists").parquet(out)
    return out


def deliver_articles(df: DataFrame, path: str) -> DataFrame:
    """P7 + F9 + S7/S10: date column required, valid duplicate flags only,
    written under a free name; returns the written frame."""
    from ..operators import clean as C
    from ..operators import filters as FL
    d = C.date_column(df)
    if dict(df.dtypes)[d] == "string":
        df = df.withColumn(d, X.parse_mixed_date(F.col(d)))
    out = FL.valid_flag_rows(df)
    write_csv(out, free_path(df.sparkSession, path))
    return out


def dataset_manifest(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """File names, sizes and times of a folder, without reading content
    (``binaryFile`` skips ``content`` when it is not selected)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
             .select("path", "length", "modificationTime"))
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), "length",
                        "modificationTime")


REPORT_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("length", T.LongType()),
    T.StructField("reason", T.StringType()), T.StructField("rows", T.LongType()),
    T.StructField("columns", T.LongType()),
])


def _check_parquet(batches):
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq
    for pdf in batches:
        out = []
        for path, length in zip(pdf["path"], pdf["length"]):
            reason, rows, cols = None, None, None
            try:
                fs, inner = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(inner) as f:
                    head = f.read(4)
                    f.seek(max(int(length) - 4, 0))
                    tail = f.read(4)
                if int(length) < 1000:
                    reason = "too_small"
                elif head != b"PAR1" or tail != b"PAR1":
                    reason = "bad_magic"
                else:
                    with fs.open_input_file(inner) as f:
                        pf = pq.ParquetFile(f)
                        rows, cols = pf.metadata.num_rows, pf.metadata.num_columns
                        for i in range(pf.num_row_groups):
                            pf.read_row_group(i)
                    if rows == 0:
                        reason = "empty"
                    elif cols < 5:
                        reason = "few_columns"
            except Exception:  # noqa: BLE001 -- any failure means unreadable
                reason = reason or "unreadable"
            out.append((path, int(length), reason, rows, cols))
        yield pd.DataFrame(out, columns=["path", "length", "reason", "rows", "columns"], dtype="object")


def corrupt_file_report(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """S14 + S15: one row per Parquet file with ``reason`` (null = healthy):
    ``too_small`` (< 1000 bytes), ``bad_magic`` (no ``PAR1`` at both ends),
    ``unreadable``, ``empty`` or ``few_columns`` (< 5).  Files are listed by
    ``binaryFile`` without their content and checked in parallel tasks; the
    report replaces the reference's delete (quarantine is the caller's call).
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(folder).select("path", "length"))
    return files.mapInPandas(_check_parquet, REPORT_SCHEMA)
