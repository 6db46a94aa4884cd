"""End-to-end plans built from the operators.

``enrich_articles`` is the enrichment step of the batch run (duplicate flag,
false-duplicate correction, tone, daily mean tone, crime labels, keyword
count, column order) as one lazy DataFrame: three exchanges (headline,
(source, article id), and the broadcast day means), no driver round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import terms as TM
from ..operators import clean as C
from ..operators import duplicates as D
from ..operators import filters as FL
from ..operators import summaries as SU
from ..operators import tone as TN


def label_headlines(counts: DataFrame, categories: dict, headline: str = S.HEADLINE) -> DataFrame:
    """X15 + X16 on a table of distinct headlines (each computed once)."""
    h = F.coalesce(F.col(headline), F.lit(""))
    kw = TM.pattern_terms(TM.keyword_patterns(categories))
    return (counts.withColumn(S.TYPES, F.array_join(TM.classify(h, categories), ", "))
            .withColumn("crime_keyword_count", TM.count_terms(F.lower(h), kw)))


def enrich_articles(df: DataFrame, categories: dict, stage_side_tables: bool = True) -> DataFrame:
    """run-batch step 2 over articles that already carry a ``headline``.

    Labels are computed on the distinct-headline table that the duplicate
    flag needs anyway, so each regex runs once per distinct headline, not
    once per row.

    With ``stage_side_tables`` the two per-key side tables (headline counts
    with labels; multi-headline article groups) are written once to the
    checkpoint folder.  Their real sizes then become the planner's
    statistics: a side under ``spark.sql.autoBroadcastJoinThreshold`` is
    broadcast and the article rows are not shuffled at all; a larger side
    falls back to a sort-merge join (AQE splitting skewed keys).  The size
    check is Spark's own, made on measured files, not a guess.
    """
    from ..session import materialize
    known = None
    if S.TYPES in df.columns:  # labelled already: those labels stay
        known = (df.where(F.col(S.TYPES).isNotNull()).groupBy(F.col(S.HEADLINE).alias("_h"))
                 .agg(F.min(S.TYPES).alias("_known")))
        df = df.drop(S.TYPES, "crime_keyword_count")
    if stage_side_tables:
        df = materialize(df, "articles")  # filtered and headlined: everything below reads this copy
    counts = label_headlines(D.headline_counts(df), categories)
    if known is not None:
        counts = (counts.join(known, F.col(S.HEADLINE).eqNullSafe(F.col("_h")), "left")
                  .withColumn(S.TYPES, F.coalesce("_known", S.TYPES)).drop("_h", "_known"))
    groups = D.multi_headline_groups(df)
    if stage_side_tables:
        counts = materialize(counts, "headline_labels")
        groups = materialize(groups, "article_groups")
    d = D.flag_duplicates(df, counts=counts)
    d = D.correct_false_duplicates(d, groups=groups)
    d = TN.extract_tone(d)
    d = TN.add_daily_avg_tone(d, source=TN.extract_tone(df.select(S.DATE, "`V1.5TONE`")))
    d = d.withColumn(S.HEADLINE, F.coalesce(F.col(S.HEADLINE), F.lit("")))
    return C.priority_order(d, S.ENRICHED_FIRST)


def cleaned_articles(enriched: DataFrame) -> DataFrame:
    """S17 on an enriched frame: explode labels into ``crime_type``."""
    return C.type_after_types(C.explode_crime_types(enriched))


# ------------------------------------------------------------ batch entry points
def run_batch(spark, landed: str, start, end, sites, themes, locations, categories: dict,
              pages: DataFrame, cache: DataFrame | None, acronyms, out: str | None = None,
              cache_out: str | None = None, cache_store: str | None = None) -> DataFrame:
    """The monthly/yearly batch run as one job (reference ``run_batch``).

    Landed records of the inclusive range (partition-pruned scan) -> F7
    filter -> dropped columns -> record-level dedup -> headlines resolved per
    distinct url (cache, fetched pages, slug) -> enrichment.  With ``out``
    the result is written partitioned by month (T8: one job, no month loop);
    either way the enriched DataFrame is returned.  ``cache_out`` names a folder
    for the headline cache with this run's headlines, slugs and misses added, so
    the next run extracts only what is new.  ``cache_store`` names a bucketed cache
    (``headline_store``) that is read when no ``cache`` is given and of which only
    the buckets with new entries are rewritten.
    """
    from ..session import materialize
    from ..operators import headlines as H
    from ..sources import gkg
    from ..sources import headline_store as HS
    if cache is None and cache_store and HS.store_buckets(spark, cache_store):
        cache = HS.read_store(spark, cache_store).drop("bucket")
    recs = gkg.scan_range(spark, landed, start, end)
    f = FL.filter_articles(recs, start, end, sites, themes, locations)
    f = materialize(D.dedup_records(C.drop_columns(f.drop("day"))), "filtered")
    resolved = materialize(H.resolve_headlines(f.select(F.col(S.URL).alias("url")), pages, cache, acronyms), "headlines")
    if cache_out:
        written_back(cache, resolved).write.mode("overwrite").parquet(cache_out)
    if cache_store:
        HS.upsert_store(spark, cache_store, written_back(None, resolved))
    enriched = enrich_articles(H.attach_headlines(f, resolved), categories)
    if out:
        (enriched.withColumn("month", F.date_format(S.DATE, "yyyy-MM"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("month").parquet(out))
    return enriched


def written_back(cache: DataFrame | None, resolved: DataFrame) -> DataFrame:
    """The headline cache with the entries of a resolution added, newest first per url."""
    from ..operators import headlines as H
    now = F.current_timestamp().cast("timestamp_ntz").alias("seen_at")
    new = resolved.where(F.col("cache_entry").isNotNull()).select("url", F.col("cache_entry").alias("headline"), now)
    if cache is None:
        return new
    old = cache if "seen_at" in cache.columns else cache.withColumn("seen_at", F.lit(None).cast("timestamp_ntz"))
    return H.cache_upsert(old, new)


def filter_months(records: DataFrame, out: str, sites, themes, locations) -> None:
    """Filter every month of the landed records in one job, output
    partitioned by ``month`` (replaces the reference's per-month loop)."""
    bounds_all = ("0001-01-01 00:00:00", "9999-12-31 23:59:59")
    f = FL.filter_articles(records, *bounds_all, sites, themes, locations)
    (f.withColumn("month", F.date_format(S.DATE, "yyyy-MM")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(out))


def reextract_month(spark, filtered: str, month: str, pages: DataFrame, cache: DataFrame | None,
                    acronyms, categories: dict) -> DataFrame:
    """Reuse one filtered month (``month='YYYY-MM'`` partition of
    :func:`filter_months` output), redo headline extraction, enrich.
    Good cached headlines are used; misses are tried again.  A missing month
    is an error."""
    from ..operators import headlines as H
    from ..sources.files import _fs
    fs, p = _fs(spark, f"{filtered.rstrip('/')}/month={month}")
    if not fs.exists(p):
        raise FileNotFoundError(f"Missing filtered month {month} under {filtered}")
    f = spark.read.parquet(filtered).where(F.col("month") == month).drop("month")
    resolved = H.resolve_headlines(f.select(F.col(S.URL).alias("url")), pages, cache, acronyms)
    return enrich_articles(H.attach_headlines(f, resolved), categories)


def legacy_daily_tone(records: DataFrame, sites, themes, locations) -> DataFrame:
    """Legacy single-drop run intent (parse -> legacy filter -> tone ->
    daily mean)."""
    f = FL.filter_articles_legacy(records, sites, themes, locations)
    return TN.daily_tone_series(TN.extract_tone(f))


# ------------------------------------------------------------ folder entry points
SUMMARY_REQUIRED = (S.DATE, S.HEADLINE)
TIMELINE_REQUIRED = (S.HEADLINE, S.SOURCE, S.DATE, S.DUP, S.TYPE, S.TYPES)


def summary_from_csv_folder(spark, folder: str, out: str | None = None, k: int = 3) -> DataFrame:
    """Headline summary job over a folder of cleaned monthly CSVs.

    Every CSV of ``folder`` is read on its own and skipped without ``date``
    and ``headline``; headlines get the mojibake repair, blank ones and rows
    with an unparseable date are dropped; then the daily/monthly top-k
    summary.  With ``out`` the result is written as CSV and as JSON lines
    under ``out`` (separate from the input folder).
    """
    from ..sources import files as FS
    rows = FS.read_monthly_csvs(spark, FS.list_files(spark, folder, ".csv"), SUMMARY_REQUIRED)
    if rows is None:
        raise ValueError(f"no usable CSV in {folder}")
    s = SU.sort_summary(SU.headline_summary(SU.prepare_headline_rows(rows), k=k))
    if out:
        FS.write_csv(s.coalesce(1), f"{out.rstrip('/')}/csv", mode="overwrite")
        FS.write_json(s.coalesce(1), f"{out.rstrip('/')}/json", mode="overwrite")
    return s


def timeline_from_csv_folder(spark, folder: str, out: str | None = None) -> DataFrame:
    """Annotated timeline job over a folder of cleaned monthly CSVs (files
    without the six required columns are skipped)."""
    from ..sources import files as FS
    rows = FS.read_monthly_csvs(spark, FS.list_files(spark, folder, ".csv"), TIMELINE_REQUIRED)
    if rows is None:
        raise ValueError(f"no usable CSV in {folder}")
    t = SU.headline_timeline(rows)
    if out:
        FS.write_csv(t.coalesce(1), out, mode="overwrite")
    return t
