"""Landed records with a commit record per drop.

Every write goes to a folder of its own, ``<path>/run=<run>/day=<day>/``.  Nothing in it counts until
the run is published: one small file ``<path>/_manifest/<run>.parquet`` with a row per drop (its
stamp, the run, the rows it gave), put there by a single rename.  A write that fails halfway, or whose
driver dies before the rename, leaves rows that no reader sees, and is simply run again.  Where two
runs have published the same drop, readers take the one published first, so rows are never
doubled.  ``sweep`` deletes folders that were never published.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import grid as G
from .files import _fs

MANIFEST = "_manifest"
MANIFEST_SCHEMA = "drop string, run string, rows long, published_at timestamp"


def new_run() -> str:
    return f"r{uuid.uuid4().hex}"


def has_manifest(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, f"{path.rstrip('/')}/{MANIFEST}")
    return fs.exists(p)


def write_run(records: DataFrame, path: str, run: str, date: str = S.DATE, records_per_file: int = 2_000_000) -> None:
    """Write the records of a run by day; they count once ``publish`` is through."""
    out = records.withColumn("drop", G.stamp_text(F.col(date))).withColumn("day", F.to_date(F.col(date))).hint("rebalance", "day")
    out.write.option("maxRecordsPerFile", records_per_file).partitionBy("day").parquet(f"{path.rstrip('/')}/run={run}")


def publish(spark: SparkSession, path: str, run: str) -> None:
    """Make the drops of a written run count, all at once.  A run without rows publishes nothing, so its
    drops stay missing and are tried again (D13)."""
    base = path.rstrip("/")
    fs, data = _fs(spark, f"{base}/run={run}")
    if not any(s.isDirectory() for s in fs.listStatus(data)):
        return
    rows = spark.read.parquet(f"{base}/run={run}").groupBy("drop").agg(F.count("*").alias("rows"))
    rows = rows.select("drop", F.lit(run).alias("run"), "rows", F.current_timestamp().alias("published_at"))
    staged = f"{base}/{MANIFEST}/_staging-{run}"
    rows.coalesce(1).write.parquet(staged)  # one row per drop of a run
    _, folder = _fs(spark, staged)
    part = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    _, place = _fs(spark, f"{base}/{MANIFEST}/{run}.parquet")
    if not fs.rename(part, place):
        raise OSError(f"could not publish run {run}")
    fs.delete(folder, True)


def published(spark: SparkSession, path: str) -> DataFrame:
    """(drop, run, rows): the run that counts for each drop."""
    if not has_manifest(spark, path):
        return spark.createDataFrame([], "drop string, run string, rows long")
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path.rstrip('/')}/{MANIFEST}")
    first = rows.groupBy("drop").agg(F.min(F.struct("published_at", "run", "rows")).alias("m"))
    return first.select("drop", "m.run", "m.rows")


def read_landed(spark: SparkSession, path: str, skip_corrupt: bool = False) -> DataFrame:
    """The records that count, with their ``day``; a folder without a manifest is read as it is."""
    files = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower())
    if not has_manifest(spark, path):
        return files.parquet(path)
    return files.parquet(path).join(published(spark, path).select("drop", "run"), ["drop", "run"], "left_semi").drop("drop", "run")


def sweep(spark: SparkSession, path: str, older_than_s: float = 7 * 86400) -> list[str]:
    """Delete the folders of runs that were never published and are older than that; returns their names."""
    fs, p = _fs(spark, path)
    runs = {s.getPath().getName()[4:]: s for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith("run=")}
    _, m = _fs(spark, f"{path.rstrip('/')}/{MANIFEST}")
    known = {s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(m)} if fs.exists(m) else set()
    old = sorted(r for r, s in runs.items() if r not in known and s.getModificationTime() <= (time.time() - older_than_s) * 1000)
    for r in old:
        fs.delete(runs[r].getPath(), True)
    return old
