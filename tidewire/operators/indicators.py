"""Data steps of the country-indicator explorer.

Only the data side of the dashboard is rebuilt: value coercion like
JavaScript's unary ``+``, the year slice, axis extents, domains and the
one-decimal labels.  Rendering is out of scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def js_number(c: Column, blank_is_null: bool = False) -> Column:
    """``+value`` -- blank -> 0 (or null for GINI), text -> NaN."""
    t = F.trim(c.cast("string"))
    num = F.coalesce(t.try_cast("double"), F.lit(float("nan")))
    blank = F.lit(None).cast("double") if blank_is_null else F.lit(0.0)
    return F.when(c.isNull(), blank).when(t == "", blank).otherwise(num)


def region_label(continent: Column, region: Column) -> Column:
    """``Continent || Region || 'Other'`` (blank counts as missing)."""
    return F.coalesce(F.nullif(continent, F.lit("")), F.nullif(region, F.lit("")), F.lit("Other"))


def one_decimal(c: Column) -> Column:
    """One-decimal label."""
    return F.format_string("%.1f", c)


def indicator_slice(df: DataFrame, year: int, x: str, y: str, gini: str = "GINI Index") -> DataFrame:
    """F16 + A14 + X17 + X19: rows of one year where both indicators are
    numeric, with labels and the slice's axis extents."""
    def num(name):
        return js_number(F.col(f"`{name}`"), blank_is_null=(name == gini))
    s = (df.where(F.col("Year") == year)
         .select("Country", region_label(F.col("Continent"), F.col("Region")).alias("Region"),
                 num(x).alias("x"), num(y).alias("y")))
    s = s.where(F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull() & ~F.isnan("y"))
    # one row a country: the whole slice is small, so its extents are one window over it
    whole = Window.partitionBy(F.lit(1))
    ext = [fn(c).over(whole).alias(f"{c}_{n}") for c in ("x", "y") for n, fn in (("min", F.min), ("max", F.max))]
    return s.select("Country", "Region", "x", "y", one_decimal(F.col("x")).alias("x_label"),
                    one_decimal(F.col("y")).alias("y_label"), *ext)


def indicator_domains(df: DataFrame) -> DataFrame:
    """Distinct years (ascending via ``ord``), the latest year, and the
    distinct region labels, as ``kind, value, ord`` rows."""
    years = df.select(F.col("Year")).where(F.col("Year").isNotNull()).distinct()
    latest = years.agg(F.max("Year").alias("Year"))
    regions = df.select(region_label(F.col("Continent"), F.col("Region")).alias("value")).distinct()
    return (years.select(F.lit("year").alias("kind"), F.col("Year").cast("string").alias("value"),
                         F.col("Year").alias("ord"))
            .unionByName(latest.select(F.lit("latest_year").alias("kind"),
                                       F.col("Year").cast("string").alias("value"), F.col("Year").alias("ord")))
            .unionByName(regions.select(F.lit("region").alias("kind"), "value",
                                        F.lit(None).cast("int").alias("ord"))))
