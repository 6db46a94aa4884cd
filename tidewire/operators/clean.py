"""Column shaping and the monthly cleaning job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X


def drop_columns(df: DataFrame, names: Sequence[str] = S.DROPPED_COLUMNS) -> DataFrame:
    """Drop the listed columns that exist (missing ones ignored)."""
    return df.drop(*[n for n in names if n in df.columns])


def priority_order(df: DataFrame, first: Sequence[str] = S.ENRICHED_FIRST) -> DataFrame:
    """``first`` columns (those present) first, the rest in input order."""
    head = [c for c in first if c in df.columns]
    rest = [c for c in df.columns if c not in head]
    return df.select(*[F.col(f"`{c}`") for c in head + rest])


def first_columns(df: DataFrame, n: int = 24) -> DataFrame:
    """Keep only the first ``n`` columns."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[:n]])


def type_after_types(df: DataFrame, types: str = S.TYPES, typ: str = S.TYPE) -> DataFrame:
    """Place ``crime_type`` right after ``crime_types``."""
    if types not in df.columns or typ not in df.columns:
        return df
    cols = [c for c in df.columns if c != typ]
    i = cols.index(types) + 1
    cols = cols[:i] + [typ] + cols[i:]
    return df.select(*[F.col(f"`{c}`") for c in cols])


def date_column(df: DataFrame) -> str:
    """The date column (``date``, ``v2date`` or ``v1date``, any case)."""
    for c in df.columns:
        if c.lower() in ("date", "v2date", "v1date"):
            return c
    raise ValueError("No date column found in DataFrame.")


def coerce_numeric(df: DataFrame, cols: Sequence[str] = S.CLEAN_NUMERIC_COLUMNS) -> DataFrame:
    """Numeric coercion (``pd.to_numeric(errors='coerce')``) of the
    listed columns that exist; text columns are parsed to double, columns
    that are already numeric keep their type (as ``to_numeric`` does)."""
    for c in cols:
        if c in df.columns and dict(df.dtypes)[c] == "string":
            df = df.withColumn(c, X.parse_number(F.col(f"`{c}`")))
    return df


#: The comma variants and apostrophes the cleaning job rewrites.
TYPE_COMMA_VARIANTS = "，﹐﹑､"
TYPE_APOSTROPHES = "’‘‛ʻʽ`´'"


def clean_type_text(c):
    """E1 text part: strip one outer quote each side, unify commas, squeeze
    repeated commas, drop apostrophes; null -> ''."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    t = F.regexp_replace(t, r'^"|"$', "")
    t = F.regexp_replace(t, f"[{TYPE_COMMA_VARIANTS}]", ",")
    t = F.regexp_replace(t, ",+", ",")
    return F.regexp_replace(t, f"[{TYPE_APOSTROPHES}]", "")


def explode_crime_types(df: DataFrame, types: str = S.TYPES, typ: str = S.TYPE) -> DataFrame:
    """One row per label of ``crime_types`` in ``crime_type``.

    Split on ``\\s*,\\s*``; empty pieces are kept (``''`` gives one row
    ``''``), no column -> unchanged.  ``explode`` is a narrow, per-row
    generator: no shuffle.
    """
    if types not in df.columns:
        return df
    out = df.withColumn(types, clean_type_text(F.col(types)))
    return out.withColumn(typ, F.explode(F.split(F.col(types), r"\s*,\s*", -1)))


def clean_articles(df: DataFrame) -> DataFrame:
    """S17 as one job: first 24 columns, numeric coercion, explode, reorder."""
    d = first_columns(df, 24)
    d = coerce_numeric(d)
    d = explode_crime_types(d)
    return type_after_types(d)
