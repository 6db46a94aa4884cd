"""Tone extraction and daily tone averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X


def extract_tone(df: DataFrame, col: str = "V1.5TONE", out: str = "tone") -> DataFrame:
    """First field of the tone tuple as double; column absent -> null."""
    if col in df.columns:
        return df.withColumn(out, X.tone(F.col(f"`{col}`")))
    return df.withColumn(out, F.lit(None).cast("double"))


def daily_tone_series(df: DataFrame, date: str = S.DATE, tone: str = "tone",
                      day_col: str = "Date", tone_col: str = "Tone") -> DataFrame:
    """A1: mean tone per calendar day (null days dropped, nulls skipped)."""
    return (df.where(F.col(date).isNotNull())
            .groupBy(F.to_date(date).alias(day_col))
            .agg(F.avg(tone).alias(tone_col)))


def add_daily_avg_tone(df: DataFrame, date: str = S.DATE, tone: str = "tone",
                       out: str = "daily_avg_tone", source: DataFrame | None = None) -> DataFrame:
    """Attach each row's calendar-day mean tone (null date -> null).

    A window partitioned by day would put a whole day in one task.  The day
    means are a partial/final aggregate with one row per calendar day -- a
    bound set by the calendar (36,525 rows per century), not by the data
    volume -- so broadcasting them is safe and the big side is not shuffled.
    """
    # ``source``: the rows to average when ``df`` carries joins the average
    # does not need (keeps them out of the aggregation branch)
    days = daily_tone_series(source if source is not None else df, date, tone, "_day", out)
    return (df.join(F.broadcast(days), F.to_date(F.col(date)) == F.col("_day"), "left")
            .drop("_day"))
