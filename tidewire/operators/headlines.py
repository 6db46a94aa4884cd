"""Headline resolution and the headline cache.

The reference fetches each url over HTTP with a thread pool and memoises
results in SQLite.  Here the fetched pages are a table (``url, html``; html
null = the fetch failed) and the cache is a keyed table
(``url, headline, seen_at``).  Resolution is a join chain on ``url`` --
computed once per *distinct* url, then joined back -- so repeated urls cost
one extraction, like the memo, but distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X


def valid_cached(cache: DataFrame, url: str = "url", headline: str = "headline") -> DataFrame:
    """Cache rows that count as a hit (the miss marker and ``''`` do not), one per url:
    the newest where the cache has ``seen_at``, else the greatest headline."""
    hits = cache.where(F.col(headline).isNotNull() & (F.col(headline) != "") & (F.col(headline) != S.MISSED_HEADLINE))
    order = [F.col("seen_at")] if "seen_at" in cache.columns else []
    return hits.groupBy(url).agg(F.max(F.struct(*order, F.col(headline).alias("_h")))["_h"].alias(headline))


def cache_upsert(cache: DataFrame, new: DataFrame, url: str = "url",
                 seen_at: str = "seen_at") -> DataFrame:
    """One row per url, the newest ``seen_at`` wins (ties: headline).

    ``max_by`` is a partial/final aggregate: a url written many times is
    reduced map-side, never sorted in one task.
    """
    both = cache.select(url, "headline", seen_at).unionByName(new.select(url, "headline", seen_at))
    key = F.struct(F.col(seen_at).alias("t"), F.col("headline").alias("h"))
    return (both.groupBy(url).agg(F.max_by(F.struct("headline", seen_at), key).alias("_r"))
            .select(url, F.col("_r.headline").alias("headline"), F.col(f"_r.{seen_at}").alias(seen_at)))


def resolve_headlines(urls: DataFrame, pages: DataFrame, cache: DataFrame | None,
                      acronyms, url: str = "url") -> DataFrame:
    """Per distinct url -- valid cache hit, else (http urls only) the
    page's og/twitter/title headline, else, only when the fetch failed (html
    null), the url-slug headline.

    Returns ``url, headline, cache_entry``: ``cache_entry`` is what the
    reference writes back (the extracted headline, the slug, or the miss
    marker for a page without a title; null when nothing is written).
    """
    u = urls.select(url).where(F.col(url).isNotNull()).distinct()
    if cache is not None:
        hits = valid_cached(cache, "url", "headline").select(F.col("url").alias(url), F.col("headline").alias("_cached"))
        u = u.join(hits, url, "left")
    else:
        u = u.withColumn("_cached", F.lit(None).cast("string"))
    is_http = F.col(url).startswith("http")
    # Only pages that the cache doesn't answer are extracted, and only the short
    # headline goes on, one per url: a fetched page before a failed one, the
    # newest where pages say when (``fetched_at``), then the greatest headline.
    wanted = u.where(F.col("_cached").isNull() & is_http).select(url)
    p = pages.withColumnRenamed("url", url).join(wanted, url, "left_semi")
    order = [F.col("fetched_at")] if "fetched_at" in pages.columns else []
    found = F.struct(F.col("html").isNotNull().alias("ok"), *order, X.headline_from_html(F.col("html")).alias("h"))
    p = (p.select(url, found.alias("_p")).groupBy(url).agg(F.max("_p").alias("_p"))
         .select(url, F.col("_p.h").alias("_from_html"), (~F.col("_p.ok")).alias("_failed")))
    j = u.join(p, url, "left")
    # no page row at all counts as a failed fetch, like a null html
    failed = F.coalesce(F.col("_failed"), F.lit(True))
    slug = X.headline_from_url(F.col(url), acronyms)
    fetched = F.when(failed, slug).otherwise(F.col("_from_html"))
    j = j.withColumn("_new", F.when(F.col("_cached").isNull() & is_http, fetched))
    entry = (F.when(F.col("_cached").isNotNull() | ~is_http, F.lit(None))
             .when(failed, F.col("_new"))
             .otherwise(F.coalesce(F.col("_new"), F.lit(S.MISSED_HEADLINE))))
    # NFC for every returned headline (cached, page or slug), once per url
    return j.select(url, X.nfc(F.coalesce(F.col("_cached"), F.col("_new"))).alias("headline"),
                    entry.alias("cache_entry"))


def attach_headlines(df: DataFrame, resolved: DataFrame, url: str = S.URL) -> DataFrame:
    """Join resolved headlines back onto article rows (NFC is applied in
    extraction)."""
    r = resolved.select(F.col("url").alias("_u"), F.col("headline").alias(S.HEADLINE))
    base = df.drop(S.HEADLINE) if S.HEADLINE in df.columns else df
    return base.join(r, base[url] == r["_u"], "left").drop("_u")


def enrich_csv_rows(df: DataFrame, resolved: DataFrame) -> DataFrame:
    """Add ``headline`` to rows read from a CSV, CSV priority order;
    the url column is required."""
    from . import clean as C
    if S.URL not in df.columns:
        raise ValueError(f"input is missing the '{S.URL}' column required for headline extraction")
    return C.priority_order(attach_headlines(df, resolved), S.CSV_ENRICH_FIRST)
