"""Filtering a range of dates through a cache of filtered ranges.

The cache is a folder of Parquet tables named ``<first day>_to_<end>.parquet`` (X14).  A request
reads the cached ranges that overlap it, filters only what none of them covers, lets cached
rows win over newly filtered ones, and saves the whole under its own name.  Coverage is that of
the merged ranges, so a gap between two cached ranges is filtered (the reference looks at the
outermost bounds only); a cached range without rows covers its dates too.

A table counts once it stands under its name, and it gets there by a rename after it is written in
full, so a run that fails leaves only a hidden folder behind.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import duplicates as D
from ..operators import grid as G
from ..operators import ranges as R
from ..sources.files import _fs


def at(ts: dt.datetime) -> Column:
    """A moment without a zone, whatever the session's zone is."""
    return F.lit(f"{ts:%Y-%m-%d %H:%M:%S}").cast("timestamp_ntz")


def range_name(start: dt.datetime, end: dt.datetime) -> str:
    return f"{start:%Y-%m-%d}_to_{end:%Y-%m-%d_%H-%M-%S}.parquet"


def cached_names(spark: SparkSession, cache: str) -> DataFrame:
    """(file_name) of the tables of a cache folder: one metadata row each."""
    fs, p = _fs(spark, cache)
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return spark.createDataFrame([(n,) for n in found if not n.startswith(("_", "."))], "file_name string")


def save_range(df: DataFrame, cache: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Write ``df`` as the cached rows of the days from ``start``'s on to ``end``; replaces a table of that name."""
    spark, folder = df.sparkSession, cache.rstrip("/")
    hidden, final = f"{folder}/_{uuid.uuid4().hex}", f"{folder}/{range_name(start, end)}"
    df.write.parquet(hidden)
    fs, new = _fs(spark, hidden)
    _, place = _fs(spark, final)
    if fs.exists(place):
        fs.delete(place, True)
    if not fs.rename(new, place):
        raise OSError(f"could not publish {final}")
    return spark.read.parquet(final)


def filter_range(records: DataFrame, cache: str, start: dt.datetime, end: dt.datetime,
                 keep: Callable[[DataFrame], DataFrame], date: str = S.DATE, key: str = S.RID) -> DataFrame:
    """The rows that ``keep`` leaves of ``records`` from ``start`` to ``end``, both included, read from the
    cache as far as it goes.  Names hold whole first days, so the days are filtered from midnight on.

    A request that the cache covers reads it only, less rows that are equal in whole, and saves nothing;
    else one row stays per ``key``, a cached one first."""
    spark = records.sparkSession
    first = dt.datetime(start.year, start.month, start.day)
    inside = F.col(date).between(at(start), at(end))
    ranges = G.overlapping_ranges(G.cached_ranges(cached_names(spark, cache)), str(first), str(end))
    ranges = spark.createDataFrame(ranges.collect(), ranges.schema)  # one row per cached file
    request = spark.range(1).select(at(first).alias("start"), at(end).alias("end"))
    left = R.uncovered(request, R.merge_ranges(ranges)).orderBy("start").collect()  # no more than cached files, and one
    paths = [f"{cache.rstrip('/')}/{r.file_name}" for r in ranges.select("file_name").collect()]
    cached = spark.read.parquet(*paths).where(F.col(date).between(at(first), at(end))) if paths else None
    if not left:
        return D.drop_exact_duplicates(cached.where(inside))
    gaps = reduce(lambda a, b: a | b, [F.col(date).between(at(g.start), at(g.end)) for g in left])
    new = keep(records.where(gaps))
    if cached is not None:
        both = cached.withColumn("_cached", F.lit(True)).unionByName(new.withColumn("_cached", F.lit(False)), allowMissingColumns=True)
        new = D.dedup_records(both, key, prefer="_cached", date=date).drop("_cached")
    else:
        new = D.dedup_records(new, key, date=date)
    return save_range(new, cache, first, end).where(inside)
