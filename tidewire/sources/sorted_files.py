"""A table in total order over many files (O1).

``write_sorted`` range-partitions and sorts; file names follow the ranges.  The position of a row is its
place in its file plus the rows of all files before it, so positions need one count per
file and no window over all rows.  ``order_faults`` checks both inside files and across their borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, *order: Column) -> None:
    """Parquet files that hold ``df`` in this order, file by file; nothing is overwritten."""
    df.orderBy(*order).write.mode("errorifexists").parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def read_positions(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """The rows of a sorted table with their position from 1."""
    rows = _placed(spark, path)
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    # one row per file, on the partition numbers that stand in the names
    ahead = sizes.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_ahead"))
    return rows.join(ahead, "_file").withColumn(name, (F.col("_ahead") + F.col("_row") + 1).cast("long")).drop("_file", "_row", "_ahead")


def order_faults(spark: SparkSession, path: str, keys: list[str], name: str = "position") -> DataFrame:
    """(position, where) of rows that come before the row ahead of them, nulls first; ``where`` is
    ``inside`` or ``border``.  ``keys`` are columns in ascending order."""
    rows = _placed(spark, path).select("_file", "_row", F.struct(*keys).alias("_key"))
    window = Window.partitionBy("_file").orderBy("_row")
    inside = rows.withColumn("_before", F.lag("_key").over(window)).where("_before > _key").select("_file", "_row", F.lit("inside").alias("where"))
    ends = rows.groupBy("_file").agg(F.count("*").alias("_n"), F.min_by("_key", "_row").alias("_first"), F.max_by("_key", "_row").alias("_last"))
    files = Window.orderBy("_file")
    ends = ends.withColumn("_ahead", F.sum("_n").over(files) - F.col("_n")).withColumn("_before", F.lag("_last").over(files))
    border = ends.where("_before > _first").select("_file", F.lit(0).cast("long").alias("_row"), F.lit("border").alias("where"))
    return (inside.unionByName(border).join(ends.select("_file", "_ahead"), "_file")
            .select((F.col("_ahead") + F.col("_row") + 1).cast("long").alias(name), "where"))
