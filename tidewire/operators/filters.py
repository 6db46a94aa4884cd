"""Article filters (F1-F9, F11, F17; legacy F2b-F6b, F8).

All predicates are Column expressions, so a chain of ``where`` calls is one
Filter node that Catalyst pushes into the Parquet scan where it can (date
ranges, source equality).  Order matters for cost only: cheap tests first
(date, source), regex scans last -- Catalyst does not reorder by cost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions import add_columns_once
from ..functions import terms as TM


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def fill_upper(df: DataFrame, cols: Sequence[str] = S.FILTER_TEXT_COLUMNS) -> DataFrame:
    """Null -> '' then upper-case, for the columns present."""
    for c in cols:
        if c in df.columns:
            df = df.withColumn(c, F.upper(F.coalesce(_c(c), F.lit(""))))
    return df


def date_between(date: str, start, end) -> Column:
    """inclusive range (``end`` a day means its 23:59:59)."""
    return F.col(date).between(F.lit(start), F.lit(end))


def source_in(source: str, sites: Sequence[str]) -> Column:
    """exact membership after upper-casing."""
    return F.upper(_c(source)).isin(list(sites))


def source_matches_legacy(source: str, sites: Sequence[str]) -> Column:
    """Legacy -- sites as an *unescaped* regex alternation, substring match."""
    return F.coalesce(_c(source).rlike("|".join(sites)), F.lit(False))


def has_theme(themes_col: str, themes: Sequence[str]) -> Column:
    """a whole ``THEME,offset`` token (or a last token without offset),
    case-insensitive; null -> false."""
    alt = "|".join(TM.escape(t) for t in themes)
    return F.coalesce(_c(themes_col).rlike(f"(?i)(?:^|;)(?:{alt})(?:,|$)"), F.lit(False))


def has_theme_legacy(themes_col: str, themes: Sequence[str]) -> Column:
    """Any theme as a case-insensitive substring."""
    alt = "|".join(TM.escape(t) for t in themes)
    return F.coalesce(_c(themes_col).rlike(f"(?i)(?:{alt})"), F.lit(False))


def location_legacy(v1: str, v2: str, locations: Sequence[str]) -> Column:
    """a location term (case-insensitive) in V1 or V2 locations."""
    alt = "|".join(locations)
    p = f"(?i)(?:{alt})"
    return F.coalesce(_c(v1).rlike(p), F.lit(False)) | F.coalesce(_c(v2).rlike(p), F.lit(False))


def location_mentions(col: str, locations: Sequence[str]) -> Column:
    r"""sum over the list of ``\bTERM\b`` matches (repeats count again)."""
    return TM.count_terms(_c(col), TM.word_terms(locations))


def theme_mentions(col: str, themes: Sequence[str]) -> Column:
    """sum over the list of substring matches (nested themes double)."""
    return TM.count_terms(_c(col), TM.substring_terms(themes))


def location_blocks_legacy(col: str, locations: Sequence[str]) -> Column:
    """``;`` blocks with at least 2 ``#`` whose 2nd field contains a term."""
    terms = F.array(*[F.lit(t) for t in locations])

    def ok(b):
        parts = F.split(b, "#", -1)
        return (F.size(parts) >= 3) & F.exists(terms, lambda t: F.contains(parts[1], t))
    return F.size(F.filter(F.split(F.coalesce(_c(col), F.lit("")), ";", -1), ok))


def theme_distinct_legacy(col: str, themes: Sequence[str]) -> Column:
    """Number of distinct themes contained as substrings."""
    c = F.coalesce(_c(col), F.lit(""))
    return sum((F.contains(c, F.lit(t)).cast("int") for t in dict.fromkeys(themes)), F.lit(0))


def filter_articles(df: DataFrame, start, end, sites: Sequence[str], themes: Sequence[str],
                    locations: Sequence[str], min_locations: int = 2, min_themes: int = 2,
                    date: str = S.DATE) -> DataFrame:
    """P6, then date range, source, theme, and both mention counts >= 2.

    Adds ``london_mentions`` and ``crime_mentions`` like the reference.
    """
    d = fill_upper(df)
    d = d.where(date_between(date, start, end))
    d = d.where(source_in(S.SOURCE, sites))
    d = d.where(has_theme("V2ENHANCEDTHEMES", themes))
    # counts evaluated once per row (see add_columns_once), then >= thresholds
    return add_columns_once(d, {
        "london_mentions": location_mentions("V2ENHANCEDLOCATIONS", locations),
        "crime_mentions": theme_mentions("V2ENHANCEDTHEMES", themes),
    }, keep=lambda r: (r["london_mentions"] >= min_locations) & (r["crime_mentions"] >= min_themes))


def filter_articles_legacy(df: DataFrame, sites: Sequence[str], themes: Sequence[str],
                           locations: Sequence[str]) -> DataFrame:
    """Legacy F7: P6 (5 columns), regex sites, substring themes, V1/V2
    locations, >= 2 location blocks and >= 2 distinct themes."""
    d = fill_upper(df, S.FILTER_TEXT_COLUMNS + ("V1THEMES",))
    d = d.where(source_matches_legacy(S.SOURCE, sites))
    d = d.where(has_theme_legacy("V2ENHANCEDTHEMES", themes))
    d = d.where(location_legacy("V1LOCATIONS", "V2ENHANCEDLOCATIONS", locations))
    return add_columns_once(d, {
        "london_mentions": location_blocks_legacy("V2ENHANCEDLOCATIONS", locations),
        "crime_mentions": theme_distinct_legacy("V2ENHANCEDTHEMES", themes),
    }, keep=lambda r: (r["london_mentions"] >= 2) & (r["crime_mentions"] >= 2))


def filter_funnel(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """one pass, rows passing each predicate cumulatively (and alone).

    ``predicates`` is ordered; output columns ``rows``, ``<name>_kept`` (rows
    passing it and all earlier ones) and ``<name>_alone``.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    acc = F.lit(True)
    for name, p in predicates.items():
        p = F.coalesce(p, F.lit(False))
        acc = acc & p
        aggs.append(F.count_if(acc).alias(f"{name}_kept"))
        aggs.append(F.count_if(p).alias(f"{name}_alone"))
    return df.agg(*aggs)


def drop_unknown(df: DataFrame, col: str = S.TYPES, trim: bool = False,
                 upper: bool = True) -> DataFrame:
    """remove ``UNKNOWN`` rows, null-safe (nulls are kept)."""
    e = _c(col).cast("string")
    e = F.trim(e) if trim else e
    e = F.upper(e) if upper else e
    return df.where(~e.eqNullSafe(F.lit("UNKNOWN")))


def valid_flag_rows(df: DataFrame, flag: str = S.DUP) -> DataFrame:
    """keep rows whose duplicate flag is a valid boolean.

    Text flags must be exactly ``True/False/TRUE/FALSE``; boolean flags must
    be non-null.
    """
    if dict(df.dtypes).get(flag) == "boolean":
        return df.where(_c(flag).isNotNull())
    return df.where(_c(flag).isin("True", "False", "TRUE", "FALSE"))


def location_top2(df: DataFrame, col: str = "V2ENHANCEDLOCATIONS", key: str = S.RID,
                  name: str = "LONDON") -> DataFrame:
    """F8 (optional in the reference): keep records whose 2 most frequent
    location names (2nd ``#`` field of each ``;`` block) include ``name``.

    Ties at rank 2 are broken by name ascending.
    """
    blocks = (df.select(key, F.explode(F.split(F.coalesce(_c(col), F.lit("")), ";", -1)).alias("b"))
              .select(key, F.get(F.split("b", "#", -1), 1).alias("loc"))
              .where(F.col("loc").isNotNull() & (F.col("loc") != "")))
    cnt = blocks.groupBy(key, "loc").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), F.col("loc").asc())
    top = (cnt.withColumn("_rk", F.row_number().over(w)).where((F.col("_rk") <= 2)
           & (F.col("loc") == name)).select(key).distinct())
    return df.join(top, key, "left_semi")
