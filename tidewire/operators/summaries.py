"""Headline summaries: daily/monthly top-3, annotated timeline, frequency
histogram (A2-A10, W3-W7, J2-J7, O1-O2, F10-F15).

Every "first row" rule of the reference depends on pandas row order, which
has no meaning on a cluster; here each one has an explicit order (date, then
record id), documented per function.  Ranking ties are broken by headline
ascending, so results are reproducible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions import text as X
from . import duplicates as D


def is_true_text(c) -> "F.Column":
    """``upper(trim(str(flag))) == 'TRUE'`` for text or boolean flags."""
    return F.upper(X.strip(c.cast("string"))) == "TRUE"


def not_unknown(c, trim: bool = True, upper: bool = True):
    """Null-safe ``!= 'UNKNOWN'`` (pandas keeps NaN rows on ``!=``)."""
    e = c.cast("string")
    if trim:
        e = X.strip(e)
    if upper:
        e = F.upper(e)
    return ~e.eqNullSafe(F.lit("UNKNOWN"))


def known_duplicates(df: DataFrame, flag: str = S.DUP, types: str = S.TYPES,
                     headline: str = S.HEADLINE, date: str = S.DATE) -> DataFrame:
    """Duplicated headlines with a known crime type, non-blank
    headline and a date."""
    return df.where(is_true_text(F.col(flag)) & not_unknown(F.col(types))
                    & (X.strip(F.coalesce(F.col(headline), F.lit(""))) != "")
                    & F.col(date).isNotNull())


def prepare_headline_rows(df: DataFrame, headline: str = S.HEADLINE,
                          date: str = S.DATE) -> DataFrame:
    """The per-file preparation of the summary job (X7, F12, X4, F13):
    mojibake repair (null -> ''), blank headlines dropped, mixed-format date
    text parsed, unparseable dates dropped."""
    out = df.withColumn(headline, X.fix_mojibake(F.col(headline)))
    out = out.where(X.strip(F.col(headline)) != "")
    if dict(out.dtypes)[date] == "string":
        out = out.withColumn(date, X.parse_mixed_date(F.col(date)))
    return out.where(F.col(date).isNotNull())


def _top_k(counts: DataFrame, part: list[str], k: int, rank: str, top: str) -> DataFrame:
    # row_number <= k is planned as WindowGroupLimit: each map task keeps only
    # its local top k per group before the exchange.
    w = Window.partitionBy(*part).orderBy(F.col("count").desc(), F.col(S.HEADLINE).asc())
    return (counts.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
            .withColumn(top, F.lit(True)))


def headline_counts_by_day(f: DataFrame) -> DataFrame:
    """Distinct records (``_rid``) of each (Day, Month, headline) and, with ``_m`` 1 and no Day, of each
    (Month, headline).

    A record's days of a month are the bits of one number, so both counts come from one hash
    aggregation of the rows, without a copy of each row for either of them."""
    bit = F.expr("shiftleft(1L, dayofmonth(Day) - 1)")
    per_record = f.groupBy("Month", S.HEADLINE, "_rid").agg(F.bit_or(bit).alias("_days"))
    days = [F.sum(F.when(F.col("_rid").isNotNull(), F.getbit("_days", F.lit(d)).cast("long")).otherwise(0)).alias(f"_{d}") for d in range(31)]
    # a day whose records have no id counts 0 but is a day all the same
    seen = F.bit_or("_days").alias("_seen")
    g = per_record.groupBy("Month", S.HEADLINE).agg(F.count("_rid").alias("_all"), seen, *days)
    def row(day, count, m, there):
        return F.struct(day.alias("Day"), count.alias("count"), F.lit(m).alias("_m"), there.alias("_is"))

    each = F.array(row(F.lit(None).cast("date"), F.col("_all"), 1, F.lit(True)),
                   *(row(F.date_add(F.to_date("Month"), d), F.col(f"_{d}"), 0, F.getbit("_seen", F.lit(d)) == 1) for d in range(31)))
    return g.select("Month", S.HEADLINE, F.inline(F.filter(each, lambda r: r["_is"]))).drop("_is")


def earliest_sources(f: DataFrame) -> DataFrame:
    """headline, Headline_Source: the url of the least (date, record id, url) of each headline, of rows with a url.
    The dates are reduced first, by hash; only rows of a headline's first date are compared in whole."""
    known = f.where(F.col("_url").isNotNull())
    first = known.groupBy(F.col(S.HEADLINE).alias("_h")).agg(F.min("_date").alias("_first"))
    early = known.join(first, (F.col(S.HEADLINE) == F.col("_h")) & (F.col("_date") == F.col("_first")))
    return early.groupBy("_h").agg(F.min(F.struct("_rid", "_url"))["_url"].alias("Headline_Source"))


def headline_summary(df: DataFrame, k: int = 3, rid: str = S.RID, url: str = S.URL,
                     date: str = S.DATE, materialize: bool = True) -> DataFrame:
    """Daily and monthly top-k duplicated headlines, merged (the flagship).

    Input: cleaned article rows (possibly exploded by crime type, hence the
    distinct record counts) with ``date, headline, headline_is_duplicate,
    crime_types, GKGRECORDID, V1DOCUMENTIDENTIFIER``.

    Output columns: ``Day, Month, headline, count_day, Rank_Day, Top_Day,
    count_month, Rank_Month, Top_Month, Headline_Source``; for each
    (Month, Rank_Month) -- a null Rank_Month is one group per month -- the
    row with the highest ``count_day`` (ties: earlier Day, then headline).
    ``Headline_Source`` is the url of the headline's earliest record
    (date, record id) with a url.

    Plan: the rows that count are written once to the checkpoint folder, with the
    five columns that are needed.  From there one hash aggregation yields the
    (day, headline) and (month, headline) distinct-record counts, another
    the earliest sources; everything after runs on those grouped rows,
    whose windows are bounded by the calendar (days or months of one
    headline) or are top-k windows planned as ``WindowGroupLimit``.  The
    reference's full outer join of the daily and monthly lists becomes a
    window over (month, headline): each daily row gets its month's values,
    and a monthly row without daily rows is kept on its own.
    """
    from ..session import materialize as _mat
    base = known_duplicates(df).select(X.day(F.col(date)).alias("Day"), X.month_start(F.col(date)).alias("Month"), S.HEADLINE,
                                       F.col(rid).alias("_rid"), F.col(date).alias("_date"), F.col(url).alias("_url"))
    if materialize:
        base = _mat(base, "known_duplicates")
    g = headline_counts_by_day(base)
    monthly = F.col("_m") == 1
    w_rank = Window.partitionBy("_m", "Day", "Month").orderBy(F.col("count").desc(), F.col(S.HEADLINE).asc())
    top = g.withColumn("_rank", F.row_number().over(w_rank)).where(F.col("_rank") <= k)
    w_mh = Window.partitionBy("Month", S.HEADLINE)
    top = (top.withColumn("count_month", F.max(F.when(monthly, F.col("count"))).over(w_mh))
              .withColumn("Rank_Month", F.max(F.when(monthly, F.col("_rank"))).over(w_mh))
              .withColumn("_days", F.count(F.when(~monthly, F.lit(1))).over(w_mh)))
    sources = earliest_sources(base)
    top = top.where(~monthly | (F.col("_days") == 0)).join(sources, F.col(S.HEADLINE) == F.col("_h"), "left")
    j = top.select(
        "Day", "Month", S.HEADLINE,
        F.when(monthly, F.lit(0).cast("bigint")).otherwise(F.col("count")).alias("count_day"),
        F.when(~monthly, F.col("_rank")).alias("Rank_Day"),
        (~monthly).alias("Top_Day"),
        "count_month", "Rank_Month",
        F.col("Rank_Month").isNotNull().alias("Top_Month"),
        "Headline_Source")
    w = Window.partitionBy("Month", "Rank_Month").orderBy(
        F.col("count_day").desc(), F.col("Day").asc_nulls_last(), F.col(S.HEADLINE).asc())
    j = j.withColumn("_z", F.row_number().over(w)).where("_z = 1").drop("_z")
    return j.select("Day", "Month", S.HEADLINE, "count_day", "Rank_Day", "Top_Day",
                    "count_month", "Rank_Month", "Top_Month", "Headline_Source")


def headline_sources(df: DataFrame, headline: str = S.HEADLINE, url: str = S.URL,
                     date: str = S.DATE, rid: str = S.RID) -> DataFrame:
    """One url per headline -- the earliest record (date, nulls last,
    then record id) that has a url.  ``min`` of a struct is a partial/final
    aggregate, so a hot headline is reduced map-side."""
    key = F.struct(F.col(date).isNull().alias("n"), F.col(date).alias("d"),
                   F.col(rid).alias("r"), F.col(url).alias("u"))
    return (df.where(F.col(url).isNotNull() & F.col(headline).isNotNull())
            .groupBy(headline).agg(F.min(key)["u"].alias("Headline_Source")))


def sort_summary(df: DataFrame) -> DataFrame:
    """O1: Month, Rank_Month (nulls last), count_day descending."""
    return df.orderBy(F.col("Month").asc(), F.col("Rank_Month").asc_nulls_last(),
                      F.col("count_day").desc())


def restrict_to_known(top: DataFrame, rows: DataFrame, headline: str = S.HEADLINE) -> DataFrame:
    """Keep top-list rows whose headline occurs in ``rows`` (semi join)."""
    return top.join(rows.select(headline).distinct(), headline, "left_semi")


def headline_timeline(df: DataFrame, date: str = S.DATE, source: str = S.SOURCE,
                      rid: str = S.RID, materialize: bool = True) -> DataFrame:
    """Monthly distinct duplicated headlines annotated with the month's top
    headline (by number of distinct sources), its first date and crime types.

    Steps: date parsed and required; flag true; ``crime_type`` not exactly
    ``UNKNOWN`` (null kept); one row per (headline, source) -- the earliest by
    (date, record id); per month the distinct headline count and the top
    headline (most sources, ties: headline asc); first date and sorted
    distinct ``crime_types`` of the top headlines.

    Plan: the (headline, source) table is far smaller than the input and has
    two consumers, so it is written once to the checkpoint folder (lineage cut
    there).  The per-month count and top-1 are one partial/final aggregation
    (``min_by`` on (-sources, headline)) -- no window holding a month's
    headlines in one task; the top headlines (one per month) are broadcast to
    restrict the per-headline aggregation.
    """
    from ..session import materialize as _mat
    d = df
    if dict(d.dtypes)[date] == "string":
        d = d.withColumn(date, X.parse_mixed_date(F.col(date)))
    if S.TYPE in d.columns:
        known = not_unknown(F.col(S.TYPE), trim=False, upper=False)
    else:
        # unexploded rows: a record survives when any of its labels would
        # survive the explode-then-filter of the reference (same result, no
        # row blow-up); the explode also rewrites the label text, so do that too
        from .clean import clean_type_text
        d = d.withColumn(S.TYPES, clean_type_text(F.col(S.TYPES)))
        labels = F.split(F.col(S.TYPES), r"\s*,\s*", -1)
        known = F.exists(labels, lambda t: t != "UNKNOWN")
    d = d.where(F.col(date).isNotNull() & is_true_text(F.col(S.DUP)) & known)
    d = d.select(S.HEADLINE, source, date, rid, S.TYPES)
    d = D.first_per_key(d, [S.HEADLINE, source], [F.col(date), F.col(rid)])
    d = d.withColumn("Month", X.month_start(F.col(date)))
    if materialize:
        d = _mat(d, "timeline_pairs")
    hm = d.groupBy("Month", S.HEADLINE).agg(F.count(source).alias("source_count"))
    key = F.when(F.col(S.HEADLINE).isNotNull(),
                 F.struct((-F.col("source_count")).alias("n"), F.col(S.HEADLINE).alias("h")))
    per_month = hm.groupBy("Month").agg(
        F.count(S.HEADLINE).alias("distinct_headline_count"),
        F.min_by(F.struct(F.col(S.HEADLINE).alias("h"), F.col("source_count").alias("n")), key).alias("_top"))
    # One top headline per month: a calendar-bounded set, safe to broadcast.
    top_h = F.broadcast(per_month.select(F.col("_top.h").alias(S.HEADLINE)).where(F.col(S.HEADLINE).isNotNull())
                        .distinct())
    per_h = (d.join(top_h, S.HEADLINE, "left_semi").groupBy(S.HEADLINE)
             .agg(F.min(date).alias("_first"),
                  F.when(F.count(S.TYPES) > 0, F.array_join(F.array_sort(F.collect_set(S.TYPES)), ", ")).alias("Crime Types")))
    out = per_month.join(per_h, per_month["_top.h"] == per_h[S.HEADLINE], "left")
    return out.select("Month", "distinct_headline_count",
                      F.col("_top.h").alias("Top Headline"),
                      F.col("_top.n").alias("Top Headline Count"),
                      X.us_date_text(F.col("_first")).alias("Headline Date"), "Crime Types")


def crime_types_by_headline(df: DataFrame, headline: str = S.HEADLINE,
                            types: str = S.TYPES) -> DataFrame:
    """Sorted distinct ``crime_types`` joined by ``, `` per headline.

    ``collect_set`` holds distinct label strings only (bounded by the number
    of label combinations), and is combined map-side.
    """
    return (df.where(F.col(headline).isNotNull()).groupBy(headline)
            .agg(F.array_join(F.array_sort(F.collect_set(types)), ", ").alias("crime_types_list")))


def duplicate_frequency(df: DataFrame, min_count: int = 3, rid: str = S.RID) -> DataFrame:
    """Distinct records per duplicated headline, kept if >= min_count."""
    return (df.where(is_true_text(F.col(S.DUP)) & F.col(S.HEADLINE).isNotNull())
            .groupBy(S.HEADLINE).agg(F.count_distinct(rid).alias("dup_count"))
            .where(F.col("dup_count") >= min_count))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """A10: equal-width histogram as numpy/matplotlib compute it.

    Edges ``min + i*(max-min)/bins`` (last edge = max), the last bin closed;
    min = max widens the range by 0.5 on both sides.  The global min/max come
    from one scalar subquery (a tiny separate job, no join); the bin index is
    computed in staged projections so every intermediate value is an
    attribute and the expression tree stays linear.  Empty bins are emitted.
    """
    stats = df.agg(F.struct(F.min(value).cast("double").alias("mn"),
                            F.max(value).cast("double").alias("mx")).alias("s"))
    s = stats.scalar()
    nb = float(bins)

    def bounds(frame):
        f = frame.withColumn("_s", s)
        f = f.withColumns({
            "_lo": F.when(F.col("_s.mn") == F.col("_s.mx"), F.col("_s.mn") - 0.5).otherwise(F.col("_s.mn")),
            "_hi": F.when(F.col("_s.mn") == F.col("_s.mx"), F.col("_s.mx") + 0.5).otherwise(F.col("_s.mx")),
        }).drop("_s")
        return f.withColumn("_step", (F.col("_hi") - F.col("_lo")) / F.lit(nb))

    def edge(i):
        return F.when(i >= bins, F.col("_hi")).otherwise(i.cast("double") * F.col("_step") + F.col("_lo"))

    x = F.col("_x")
    f = bounds(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_x")))
    f = f.withColumn("_i", F.least(F.floor((x - F.col("_lo")) * (F.lit(nb) / (F.col("_hi") - F.col("_lo"))))
                                   .cast("int"), F.lit(bins - 1)))
    f = f.withColumn("_e", edge(F.col("_i")))
    f = f.withColumn("_i", F.when(x < F.col("_e"), F.col("_i") - 1).otherwise(F.col("_i")))
    f = f.withColumn("_e", edge(F.col("_i") + 1))
    f = f.withColumn("bin", F.when((x >= F.col("_e")) & (F.col("_i") != bins - 1), F.col("_i") + 1)
                     .otherwise(F.col("_i")))
    counted = f.groupBy("bin").agg(F.count(F.lit(1)).alias("headlines"))
    grid = bounds(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")))
    grid = grid.withColumn("bin_start", edge(F.col("bin"))).withColumn("bin_end", edge(F.col("bin") + 1))
    out = grid.join(counted, "bin", "left")
    return out.select("bin", "bin_start", "bin_end",
                      F.coalesce(F.col("headlines"), F.lit(0)).alias("headlines"))


def duplicate_histogram(df: DataFrame, bins: int = 50, min_count: int = 3,
                        materialize: bool = True) -> DataFrame:
    """A10 over A9: histogram of duplicate frequencies (>= min_count).

    The frequency table (one row per duplicated headline) feeds both the
    min/max subquery and the binning, so it is written once to the
    checkpoint folder instead of being computed twice.
    """
    from ..session import materialize as _mat
    freq = duplicate_frequency(df, min_count)
    if materialize:
        freq = _mat(freq, "dup_frequency")
    return histogram(freq, "dup_count", bins)
