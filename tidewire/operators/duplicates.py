"""Duplicate-headline logic.

Scale notes.  A window ``count() over (partition by headline)`` would put a
hot headline (blank, null, a viral story) -- possibly a third of all rows --
into one task.  Instead the counts are a partial/final aggregation (map-side
combine, so hot keys cost nothing extra) joined back on the key; with AQE
skew-join splitting on, the hot key's partition of the big side is split
across tasks while the one-row-per-key side is replicated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import add_columns_once
from ..functions import text as X


def _null_spread(key, rid):
    """Key for an outer join that must never match when ``key`` is null.

    Null keys would all hash to one shuffle partition; replacing them by a
    unique value that cannot occur on the other side spreads them evenly.
    """
    return F.coalesce(key, F.concat(F.lit("\u0000"), rid.cast("string")))


def headline_counts(df: DataFrame, headline: str = S.HEADLINE) -> DataFrame:
    """One row per headline (null is a headline too) with its row count."""
    return df.groupBy(headline).agg(F.count(F.lit(1)).alias("_n"))


def flag_duplicates(df: DataFrame, headline: str = S.HEADLINE, out: str = S.DUP,
                    counts: DataFrame | None = None) -> DataFrame:
    """``out`` = the headline occurs on more than one row.

    Null headlines are equal to each other (pandas ``duplicated(keep=False)``),
    so the join is null-safe.  ``counts`` may carry extra per-headline columns
    (computed once per distinct headline) that are joined in as well.
    """
    cnt = counts if counts is not None else headline_counts(df, headline)
    cnt = cnt.withColumnRenamed(headline, "_h")
    j = df.join(cnt, df[headline].eqNullSafe(cnt["_h"]), "left")
    return j.withColumn(out, F.col("_n") > 1).drop("_h", "_n")


def multi_headline_groups(df: DataFrame, url: str = S.URL, source: str = S.SOURCE,
                          headline: str = S.HEADLINE) -> DataFrame:
    """(source, article id) groups carrying more than one distinct
    non-null headline, as ``_src, _gid, _multi``.

    Groups with a null source or null article id are skipped, as pandas
    ``groupby`` drops null keys.  ``min <> max`` equals ``nunique > 1`` and is
    a plain partial aggregation (no ``collect_set``).
    """
    keyed = add_columns_once(df.select(url, source, headline), {"_aid": X.article_id(F.col(url))})
    return (keyed.where(F.col("_aid").isNotNull() & F.col(source).isNotNull())
            .groupBy(F.col(source).alias("_src"), F.col("_aid").alias("_gid"))
            .agg((F.min(headline) != F.max(headline)).alias("_multi"))
            .where(F.col("_multi")))


def correct_false_duplicates(df: DataFrame, url: str = S.URL, source: str = S.SOURCE,
                             headline: str = S.HEADLINE, flag: str = S.DUP,
                             rid: str = S.RID, groups: DataFrame | None = None) -> DataFrame:
    """Rows of a :func:`multi_headline_groups` group are not duplicates
    (flag -> False).  ``groups`` may be passed precomputed (e.g. written once
    so the planner can size it)."""
    keyed = add_columns_once(df, {"_aid": X.article_id(F.col(url))})
    if groups is None:
        groups = multi_headline_groups(df, url, source, headline)
    spread = _null_spread(F.col("_aid"), F.col(rid))
    j = keyed.join(groups, (F.col(source) == F.col("_src")) & (spread == F.col("_gid")), "left")
    return (j.withColumn(flag, F.when(F.col("_multi"), F.lit(False)).otherwise(F.col(flag)))
            .drop("_aid", "_src", "_gid", "_multi"))


def same_article_groups(df: DataFrame, url: str = S.URL, source: str = S.SOURCE,
                        rid: str = S.RID) -> DataFrame:
    """J10 re-aimed: the "same article" relation as equivalence classes.

    Two records are the same article when source and non-null article id
    agree.  Instead of emitting every pair of a group (quadratic in the size
    of a hot group) each record gets its class: the smallest record id of the
    class and the class size, from one partial/final aggregation joined back.
    Two records are the same article exactly when their ``article_key`` match.
    """
    base = (df.select(F.col(rid).alias("rid"), F.col(source).alias("source"),
                      X.article_id(F.col(url)).alias("article_id"))
            .where(F.col("article_id").isNotNull() & F.col("source").isNotNull()))
    cls = base.groupBy("source", "article_id").agg(
        F.min("rid").alias("article_key"), F.count(F.lit(1)).alias("records_in_article"))
    return base.join(cls, ["source", "article_id"])


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row per key combination under an explicit order.

    ``order`` lists Columns compared ascending, nulls first (callers negate or
    wrap them for other directions).  Implemented as ``min(struct(order, row))``, a
    partial/final aggregation that carries each row once: a key holding a third
    of all rows is reduced map-side instead of being sorted in one task as a
    window would.  The whole row is the last tie-breaker, so the pick is
    deterministic.
    """
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], row.alias("row"))
    picked = df.groupBy(*keys).agg(F.min(ranked)["row"].alias("_row"))
    out = picked.select(*keys, *[F.col("_row")[c].alias(c) for c in others])
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def dedup_records(df: DataFrame, key: str = S.RID, prefer: str | None = None,
                  date: str = S.DATE) -> DataFrame:
    """One row per record id; rows with ``prefer`` true (cached rows) win,
    then the earliest ``date`` (null dates last)."""
    order = []
    if prefer:
        order.append(~F.coalesce(F.col(prefer), F.lit(False)))
    order += [F.col(date).isNull(), F.col(date)]
    return first_per_key(df, [key], order)


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row duplicates removed (hash aggregate, map-side combine)."""
    return df.dropDuplicates()
