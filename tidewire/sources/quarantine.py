"""Parquet file health without reading data pages, and quarantine with an audit table.

A file is judged by its footer: its length must fit the file, and the column chunks it names must lie
one behind another between the leading magic and the footer, each starting with a page header.  So a
file that was cut, written over by another one or given another file's footer is
found by reading the footer and a byte per column chunk, whatever its size.  Damage inside data pages isn't
looked for; a scan of the pages finds that (``files.corrupt_file_report``).
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import REPORT_SCHEMA, _fs

#: Fewest bytes and columns of a file that counts as whole.
LEAST_BYTES, LEAST_COLUMNS = 1000, 5
#: First byte of every page header: field 1, a 32-bit integer.
PAGE_HEADER = b"\x15"
AUDIT = "path string, length long, reason string, moved_to string, run string"


def footer_fault(f, length: int) -> tuple[str | None, int | None, int | None]:
    """(fault or None, rows, columns) of an open file of so many bytes."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    if length < LEAST_BYTES:
        return "too_small", None, None
    f.seek(0)
    head = f.read(4)
    f.seek(length - 8)
    tail = f.read(8)
    if head != b"PAR1" or tail[4:] != b"PAR1":
        return "bad_magic", None, None
    footer = length - 8 - int.from_bytes(tail[:4], "little")
    if footer < 4:
        return "bad_footer", None, None
    try:
        meta = pq.read_metadata(f)
    except (pa.ArrowException, OSError):
        return "bad_footer", None, None
    rows, columns, at = meta.num_rows, meta.num_columns, 4
    if rows != sum(meta.row_group(g).num_rows for g in range(meta.num_row_groups)):
        return "bad_footer", rows, columns
    if rows == 0:
        return "empty", rows, columns
    for g in range(meta.num_row_groups):
        for c in range(columns):
            chunk = meta.row_group(g).column(c)
            start = chunk.data_page_offset
            if chunk.dictionary_page_offset:
                start = min(start, chunk.dictionary_page_offset)
            if start < at or start + chunk.total_compressed_size > footer:
                return "bad_chunks", rows, columns
            at = start + chunk.total_compressed_size
            if chunk.total_compressed_size:
                f.seek(start)
                if f.read(1) != PAGE_HEADER:
                    return "bad_chunks", rows, columns
    return "few_columns" if columns < LEAST_COLUMNS else None, rows, columns


def _check(batches):
    import pyarrow.fs as pafs
    for pdf in batches:
        out = []
        for path, length in zip(pdf["path"], pdf["length"], strict=True):
            try:
                fs, inner = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(inner) as f:
                    reason, rows, cols = footer_fault(f, int(length))
            except Exception:  # noqa: BLE001 -- what can't be opened is unreadable
                reason, rows, cols = "unreadable", None, None
            out.append((path, int(length), reason, rows, cols))
        yield pd.DataFrame(out, columns=["path", "length", "reason", "rows", "columns"], dtype="object")


def file_health(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """One row per Parquet file below a folder: path, length, reason (null: whole), rows, columns."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(folder).select("path", "length"))
    return files.mapInPandas(_check, REPORT_SCHEMA)


def quarantine(spark: SparkSession, folder: str, pen: str, audit: str, glob: str = "*.parquet") -> DataFrame:
    """Move faulty files of ``folder`` into ``pen`` by renames and return this run's audit rows (path,
    length, reason, moved_to, run).  The audit is written before any file moves and
    ``settle`` moves what an ended run left, so no file moves unrecorded."""
    run = uuid.uuid4().hex
    faulty = file_health(spark, folder, glob).where("reason IS NOT NULL")
    name = F.concat(F.lit(f"{pen.rstrip('/')}/"), F.substring(F.md5("path"), 1, 8), F.lit("-"), F.regexp_extract("path", r"([^/]*)$", 1))
    faulty.select("path", "length", "reason", name.alias("moved_to"), F.lit(run).alias("run")).write.mode("append").parquet(audit)
    settle(spark, audit)
    return spark.read.schema(AUDIT).parquet(audit).where(F.col("run") == run)


def settle(spark: SparkSession, audit: str) -> int:
    """Make the moves that the audit lists and nobody made yet; returns their number."""
    moved = 0
    for r in spark.read.schema(AUDIT).parquet(audit).select("path", "moved_to").toLocalIterator():
        fs, source = _fs(spark, r["path"])
        _, target = _fs(spark, r["moved_to"])
        if fs.exists(source) and not fs.exists(target):
            fs.mkdirs(target.getParent())
            if not fs.rename(source, target):
                raise OSError(f"{r['path']} could not be moved to {r['moved_to']}")
            moved += 1
    return moved
