"""Time grids, incremental bookkeeping and cached ranges (T1-T3, T8, J8,
J9, A12, A13, S11, S16).

Grids are calendar-bounded (96 points per day, 12 months per year), so they
are generated with ``sequence`` + ``explode`` from one bounds row; the data
side is never collected.  Anti-joins against the data are regular shuffled
joins whose small side AQE may broadcast at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X



def _quarter():
    return F.make_dt_interval(mins=F.lit(15))


def floor_15min(ts: Column) -> Column:
    """Timestamp floored to its 15-minute drop (NTZ kept)."""
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz")
    return hour + F.make_dt_interval(mins=(F.floor(F.minute(ts) / 15) * 15).cast("int"))


def stamp_text(ts: Column) -> Column:
    """``YYYYMMDDHHMMSS`` text of a drop."""
    return F.date_format(ts, "yyyyMMddHHmmss")


def interval_grid(bounds: DataFrame, start: str = "start", end: str = "end",
                  out: str = "ts") -> DataFrame:
    """Every 15 minutes from ``start`` to ``end``, both ends included.

    ``bounds`` has one row per range (a request, or a min/max aggregate).
    """
    seq = F.sequence(F.col(start).cast("timestamp_ntz"), F.col(end).cast("timestamp_ntz"), _quarter())
    g = bounds.select(F.explode(F.when(F.col(start) <= F.col(end), seq)).alias(out))
    return g.withColumn("stamp", stamp_text(F.col(out)))


def recent_grid(now: DataFrame, now_col: str = "now", hours_back: int = 24) -> DataFrame:
    """``hours_back * 4`` drops ending at ``now`` floored to 15 minutes,
    newest first (``i`` = 0 is the newest)."""
    n = hours_back * 4
    fl = floor_15min(F.col(now_col))
    g = now.select(fl.alias("_now"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    ts = (F.col("_now") - F.make_dt_interval(mins=F.col("i") * 15)).cast("timestamp_ntz")
    return g.select("i", ts.alias("ts"), stamp_text(ts).alias("stamp"))


def missing_intervals(grid: DataFrame, landed: DataFrame, ts: str = "ts",
                      landed_ts: str = "ts") -> DataFrame:
    """Grid drops with no landed rows (a drop only counts once it
    produced rows, so a corrupt or empty file is fetched again)."""
    have = landed.select(floor_15min(F.col(landed_ts)).alias("_t")).distinct()
    return grid.join(have, grid[ts] == have["_t"], "left_anti")


def month_range(year_month: Column) -> tuple[Column, Column]:
    """First and last day of a month (``yyyy-MM-01`` date in)."""
    first = F.trunc(year_month, "MM")
    return first, F.last_day(first)


def months_to_process(bounds: DataFrame, done: DataFrame, start: str = "start",
                      end: str = "end", done_month: str = "month") -> DataFrame:
    """T3 + S11: months between two dates minus the months already done."""
    months = bounds.select(F.explode(F.sequence(F.trunc(F.col(start), "MM"), F.trunc(F.col(end), "MM"),
                                                F.expr("INTERVAL 1 MONTH"))).alias("month"))
    months = months.select("month", F.last_day("month").alias("month_end"))
    return months.join(done.select(F.trunc(F.col(done_month), "MM").alias("month")).distinct(),
                       "month", "left_anti")


def month_groups(df: DataFrame, ts: str = "date") -> DataFrame:
    """Per ``yyyyMM`` group the first and last timestamp and rows."""
    return (df.where(F.col(ts).isNotNull())
            .groupBy(F.date_format(ts, "yyyyMM").alias("month_key"))
            .agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("rows")))


def cached_ranges(names: DataFrame, name: str = "file_name") -> DataFrame:
    """Parse ``start_to_end_HH-MM-SS.parquet`` names; bad names dropped."""
    r = names.select(name, X.range_from_name(F.col(name), "parquet").alias("_r"))
    return (r.select(name, F.col("_r.start").alias("start"), F.col("_r.end").alias("end"))
            .where(F.col("start").isNotNull()))


def overlapping_ranges(ranges: DataFrame, start, end) -> DataFrame:
    """Cached ranges that overlap the request (``c_end >= s and c_start <= e``)."""
    return ranges.where((F.col("end") >= F.lit(start)) & (F.col("start") <= F.lit(end)))


def slice_overlaps(rows: DataFrame, ranges: DataFrame, start, end, ts: str = "date",
                   range_key: str = "file_name", row_key: str = "file_name") -> DataFrame:
    """J9 slice: rows of overlapping cached ranges, cut to the request."""
    ov = overlapping_ranges(ranges, start, end).select(range_key)
    return (rows.join(ov, rows[row_key] == ov[range_key], "left_semi")
            .where(F.col(ts).between(F.lit(start), F.lit(end))))


def cache_coverage(ranges: DataFrame, start, end) -> DataFrame:
    """Does the union of overlapping ranges cover the request?

    ``covered_minmax`` is the reference rule (min start <= s and max end >= e,
    blind to gaps, D6); ``gap_days`` counts request days outside every range.
    """
    ov = overlapping_ranges(ranges, start, end)
    mm = ov.agg(F.min("start").alias("min_start"), F.max("end").alias("max_end"),
                F.count(F.lit(1)).alias("ranges"))
    days = ov.sparkSession.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))
    covered = ov.select(F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("day")).distinct()
    gaps = days.join(covered, "day", "left_anti").agg(F.count(F.lit(1)).alias("gap_days"))
    out = mm.withColumn("covered_minmax", F.coalesce(
        (F.col("min_start") <= F.lit(start)) & (F.col("max_end") >= F.lit(end)), F.lit(False)))
    return out.withColumn("gap_days", gaps.scalar())
