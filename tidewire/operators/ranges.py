"""Ranges of time: merging them into islands, and what a request has left over.

Bounds are closed and dates have whole seconds (as drop stamps do), so ranges that end and start one
``STEP`` apart touch.  ``by`` names the columns that keep ranges apart (a cache, a customer); each
key's ranges are ordered by Spark's window, which spills.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = "INTERVAL 1 SECOND"


def _after(ts: Column) -> Column:
    return ts + F.expr(STEP)


def _before(ts: Column) -> Column:
    return ts - F.expr(STEP)


def merge_ranges(ranges: DataFrame, by: Sequence[str] = (), start: str = "start", end: str = "end") -> DataFrame:
    """``by``, start, end, ranges: disjoint islands, and how many ranges each is made of.  Nested,
    overlapping and touching ranges become one; ranges without a bound, or that end before they start, none."""
    known = ranges.where(F.col(start) <= F.col(end)).select(*by, F.col(start).alias("start"), F.col(end).alias("end"))
    known = known.groupBy(*by, "start").agg(F.max("end").alias("end"), F.count("*").alias("ranges"))
    order = Window.partitionBy(*by).orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") > _after(reach)), 1).otherwise(0)
    numbered = known.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(order))
    return numbered.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("ranges").alias("ranges")).drop("_island")


def uncovered(requests: DataFrame, islands: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, start, end: the parts of each request (``by``, start, end) in none of the islands of its
    key, in order; none for a request that is covered.  Requests of one key are disjoint."""
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"i.{c}")) for c in by]
    met = [*keys, F.col("i.end") >= F.col("r.start"), F.col("i.start") <= F.col("r.end")]
    mine = [F.col(f"r.{c}").alias(c) for c in by] + [F.col("r.start").alias("_from"), F.col("r.end").alias("_to")]
    held = requests.alias("r").join(islands.alias("i"), met).select(*mine, F.col("i.start").alias("start"), F.col("i.end").alias("end"))
    # what follows the request bounds its last gap
    bound = requests.alias("r").select(*mine, _after(F.col("r.end")).alias("start"), F.col("r.end").alias("end"))
    order = Window.partitionBy(*by, "_from", "_to").orderBy("start")
    gaps = held.unionByName(bound).withColumn("_last", F.lag("end").over(order))
    gaps = gaps.select(*by, F.coalesce(_after(F.col("_last")), F.col("_from")).alias("start"), _before(F.col("start")).alias("end"))
    return gaps.where("start <= end")
