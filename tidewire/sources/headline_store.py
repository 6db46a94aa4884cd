"""Headline cache on disk in url buckets.

The cache lies under ``<path>/buckets=N/bucket=K``: N is fixed when it is made, K comes from
a digest of the url.  An upsert reads and rewrites only the buckets that hold an
entry that changes something; all other files stay as they are.  It is idempotent, so a run
that was ended halfway is repeated with the same entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.headlines import cache_upsert
from ..session import dematerialize, materialize
from .files import _fs

COLUMNS = ("url", "headline", "seen_at")
#: Buckets of a new cache; at most so many numbers reach the driver in an upsert.
BUCKETS = 256


def bucket_of(url, buckets: int):
    return (F.conv(F.substring(F.md5(url), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def store_buckets(spark: SparkSession, path: str) -> int | None:
    """The number of buckets of a cache; None where there is none yet."""
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    found = [int(n.split("=")[1]) for n in names if n.startswith("buckets=")]
    if len(found) > 1:
        raise ValueError(f"{path} holds caches of {sorted(found)} buckets")
    return found[0] if found else None


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """url, headline, seen_at, bucket of all entries, one row per url."""
    return spark.read.parquet(path).select(*COLUMNS, F.col("bucket").cast("int").alias("bucket"))


def _write(df: DataFrame, path: str, buckets: int) -> None:
    rows = df.select(*COLUMNS, F.lit(buckets).alias("buckets"), bucket_of(F.col("url"), buckets).alias("bucket"))
    (rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("buckets", "bucket").parquet(path))


def upsert_store(spark: SparkSession, path: str, new: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Put entries into the cache (newest ``seen_at`` of a url, then the greatest headline); returns the
    buckets that were written.  ``buckets`` counts for a new cache only.  Null urls are passed over."""
    new = new.where("url IS NOT NULL").select(*COLUMNS)
    new = cache_upsert(new.limit(0), new)
    known = store_buckets(spark, path)
    if known is None:
        _write(new, path, buckets)
        return sorted(r.bucket for r in read_store(spark, path).select("bucket").distinct().collect())
    # only buckets that an entry falls into are read, only those that it changes are written
    new = materialize(new.withColumn("bucket", bucket_of(F.col("url"), known)), "headline-entries")
    held = [r.bucket for r in new.select("bucket").distinct().collect()]
    old = read_store(spark, path).where(F.col("bucket").isin(held))
    wins = F.struct("n.seen_at", "n.headline") > F.struct("o.seen_at", "o.headline")  # nulls are least
    beaten = old.alias("o").join(new.alias("n"), (F.col("o.bucket") == F.col("n.bucket")) & (F.col("o.url") == F.col("n.url")) & ~wins)
    change = new.join(beaten.select(F.col("n.url").alias("url")), "url", "left_anti")
    touched = sorted(r.bucket for r in change.select("bucket").distinct().collect())
    if touched:
        both = cache_upsert(old.where(F.col("bucket").isin(touched)), new.where(F.col("bucket").isin(touched)))
        merged = materialize(both, "headline-buckets")  # what is read can't be overwritten
        _write(merged, path, known)
        dematerialize(merged)
    dematerialize(new)
    return touched
