"""Files under names of their own: one CSV with a byte order mark (S7), one JSON array (S8), one CSV per input file.

Tasks write parts in the wanted order; a second job puts the parts of each file together, in
blocks of ``BLOCK`` bytes, and a third moves the whole files to their names.  So a lost task
leaves no half file under a wanted name, a retry writes the same bytes, and the driver sees names only.
Where the folder is a mounted one, tasks write pieces of up to ``PIECE`` bytes at their places, many
tasks to one file; other file systems have no such writes, and one task puts a file together there.

A file has its header even without rows; a table without rows gives no named files.  A null or empty
name goes to ``unnamed``; a name that holds ``/`` raises.  Rows that tie in ``order`` come in any order.
"""

from __future__ import annotations

import csv
import io
import os
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import _fs, free_path

BLOCK = 8 << 20
PIECE = 64 << 20
BOM = b"\xef\xbb\xbf"
_NAME = "_tidewire_file"


def _header(columns: Sequence[str], bom: bool) -> bytes:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(columns)
    return BOM * bom + out.getvalue().encode()


def _parts(spark: SparkSession, staging: str) -> list[str]:
    """Part files below ``staging`` as relative paths, in the order of their partitions."""
    fs, p = _fs(spark, staging)
    root, found, it = fs.makeQualified(p).toString().rstrip("/"), [], fs.listFiles(p, True)
    while it.hasNext():
        path = it.next().getPath()
        if path.getName().startswith("part-"):
            found.append(path.toString()[len(root) + 1 :])
    return sorted(found)


def _pieces(files: dict[str, list[tuple[str, int]]], head: bytes, tail: bytes, trim: int) -> list[tuple]:
    """(name, part, start, length, place in the file, bytes instead of a part): what each file is made of."""
    out: list[tuple] = []
    for name, parts in files.items():
        out.append((name, None, 0, len(head), 0, head))
        at, left = len(head), sum(n for _, n in parts) - trim if parts else 0
        for part, size in parts:
            for start in range(0, min(size, left), PIECE):
                n = min(PIECE, size - start, left)
                out.append((name, part, start, n, at, None))
                at, left = at + n, left - n
        out.append((name, None, 0, len(tail), at, tail))
    return out


def _join_in_place(spark: SparkSession, root: str, sub: str, files: dict[str, list[str]], hidden: str, head: bytes, tail: bytes, trim: int) -> None:
    """Pieces of the files, written where they belong by many tasks; a piece written twice is the same."""
    fs, _ = _fs(spark, root)
    sized = {name: [(x, fs.getFileStatus(_fs(spark, f"{root}/{sub}/{x}")[1]).getLen()) for x in parts] for name, parts in files.items()}
    pieces = _pieces(sized, head, tail, trim)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        _, base = pafs.FileSystem.from_uri(root)
        for pdf in batches:
            for name, part, start, n, place, given in pdf.itertuples(index=False):
                with open(os.open(f"{base}/.{name}.{hidden}", os.O_WRONLY | os.O_CREAT, 0o644), "wb") as out:
                    out.seek(place)
                    if part is None:
                        out.write(given)
                        continue
                    with open(f"{base}/{sub}/{part}", "rb") as source:
                        source.seek(start)
                        while n > 0 and (block := source.read(min(BLOCK, n))):
                            out.write(block)
                            n -= len(block)
                    if n:
                        raise OSError(f"{part} is shorter than it was")
            yield pd.DataFrame({"n": [len(pdf)]})

    tasks = max(1, sum(p[3] for p in pieces) // PIECE, min(len(files), spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame(pieces, "name string, part string, start long, n long, place long, given binary").repartition(tasks)
    if (done := rows.mapInPandas(write, "n long").agg(F.sum("n")).first()[0]) != len(pieces):
        raise RuntimeError(f"{done} of {len(pieces)} pieces were written")


def _publish(spark: SparkSession, folder: str, staging: str, files: dict[str, list[str]], head: bytes, tail: bytes = b"", trim: int = 0) -> None:
    """Join the parts of each file; ``trim`` bytes at the end of the last part are left out."""
    fs, p = _fs(spark, folder)
    root, sub, hidden = fs.makeQualified(p).toString(), staging.rsplit("/", 1)[1], uuid.uuid4().hex
    joined = fs.getUri().getScheme() == "file"
    if joined:
        _join_in_place(spark, root, sub, files, hidden, head, tail, trim)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        where, base = pafs.FileSystem.from_uri(root)
        for pdf in batches:
            for name, parts in zip(pdf["name"], pdf["parts"], strict=True):
                if joined:
                    if where.get_file_info(f"{base}/.{name}.{hidden}").is_file:  # else an earlier attempt moved it
                        where.move(f"{base}/.{name}.{hidden}", f"{base}/{name}")
                    yield pd.DataFrame({"name": [name]})
                    continue
                paths, tmp = [f"{base}/{sub}/{x}" for x in parts], f"{base}/.{name}.{uuid.uuid4().hex}"
                left = sum(i.size for i in where.get_file_info(paths)) - trim if paths else 0
                with where.open_output_stream(tmp) as out:
                    out.write(head)
                    for path in paths:
                        with where.open_input_stream(path) as part:
                            while left > 0 and (block := part.read(min(BLOCK, left))):
                                out.write(block)
                                left -= len(block)
                    out.write(tail)
                where.move(tmp, f"{base}/{name}")
                yield pd.DataFrame({"name": [name]})

    rows = spark.createDataFrame(list(files.items()), "name string, parts array<string>").repartition(max(1, len(files)))
    done = rows.mapInPandas(join, "name string").count()
    if done != len(files):
        raise RuntimeError(f"{done} of {len(files)} files were written")
    fs.delete(_fs(spark, staging)[1], True)


def _staging(folder: str) -> str:
    return f"{folder.rstrip('/')}/.staging-{uuid.uuid4().hex}"


def write_csv_file(df: DataFrame, path: str, *order: Column, bom: bool = True) -> str:
    """One CSV with header in this order, with a byte order mark unless told otherwise; written
    under a free name (S10), which is returned."""
    spark, path = df.sparkSession, free_path(df.sparkSession, path)
    folder, name = path.rsplit("/", 1)
    staging = _staging(folder)
    (df.orderBy(*order) if order else df).write.option("escape", '"').csv(staging)
    _publish(spark, folder, staging, {name: _parts(spark, staging)}, _header(df.columns, bom))
    return path


def write_json_array(df: DataFrame, path: str, *order: Column) -> str:
    """One JSON array of records in this order, nulls kept, ISO timestamps; free name as above."""
    spark, path = df.sparkSession, free_path(df.sparkSession, path)
    folder, name = path.rsplit("/", 1)
    staging, iso = _staging(folder), "yyyy-MM-dd'T'HH:mm:ss.SSS"
    options = {"ignoreNullFields": "false", "timestampFormat": iso, "timestampNTZFormat": iso}
    rows = (df.orderBy(*order) if order else df).select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), options).alias("value"))
    rows.write.option("lineSep", ",\n").text(staging)
    _publish(spark, folder, staging, {name: _parts(spark, staging)}, b"[\n", b"\n]\n", trim=2)
    return path


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a file of ``write_json_array``, read in splits: a record has a line of its own.
    That the lines make one array is checked: brackets around it, a comma behind each record but the last."""
    lines = spark.read.option("lineSep", "\n").text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    bracket, open_end = F.col("value").isin("[", "]", ""), ~F.col("value").endswith(",")
    seen = lines.select("value", at.alias("at")).agg(
        F.min("at")["value"].alias("first"), F.max("at")["value"].alias("last"), F.count_if(bracket).alias("brackets"), F.count_if(~bracket).alias("records"),
        F.count_if(~bracket & open_end).alias("ends"), F.max(F.when(~bracket, F.col("at")))["value"].endswith(",").alias("comma")).first()
    # an array without records has an empty line between its brackets
    if (seen["first"], seen["last"], seen["brackets"], seen["ends"], seen["comma"] or False) != ("[", "]", 2 if seen["records"] else 3, min(seen["records"], 1), False):
        raise ValueError(f"{path} is not one JSON array with a record a line")
    rows = lines.where(~bracket).select(F.from_json(F.regexp_replace("value", ",$", ""), schema, {"mode": "FAILFAST"}).alias("r"))
    return rows.select("r.*")


def write_named_csvs(df: DataFrame, folder: str, *order: Column, name_col: str = "source_file", bom: bool = False, unnamed: str = "unnamed.csv") -> list[str]:
    """One CSV per value of ``name_col``, under that name and without that column; a file of
    that name is replaced.  The names are returned.  One name may hold most rows: its parts come from many tasks."""
    spark, staging = df.sparkSession, _staging(folder)
    given = F.col(f"`{name_col}`").cast("string")
    rows = df.withColumn(_NAME, F.when(given != "", given).otherwise(F.lit(unnamed))).drop(name_col)
    rows.orderBy(_NAME, *order).write.partitionBy(_NAME).option("escape", '"').csv(staging)
    files: dict[str, list[str]] = {}
    for part in _parts(spark, staging):
        files.setdefault(unquote(part.split("/", 1)[0].split("=", 1)[1]), []).append(part)
    if odd := [x for x in files if "/" in x]:
        raise ValueError(f"not a file name: {odd[0]!r}")
    if files:
        _publish(spark, folder, staging, files, _header([c for c in df.columns if c != name_col], bom))
    return sorted(files)
