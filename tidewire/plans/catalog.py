"""Registered queries: one per operator key, each with its DuckDB oracle.

Each entry is ``name -> (spark_fn(spark, sf_dir) -> DataFrame, sql | None)``.
Every query reads the driver's tables through :mod:`.bindings` and runs over
the whole tables; an entry without SQL is checked by row count only and has
a brute-force test in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dictionaries as DI
from .. import schema as S
from ..functions import terms as TM
from ..functions import text as X
from ..operators import clean as C
from ..operators import duplicates as D
from ..operators import filters as FL
from ..operators import summaries as SU
from ..operators import tone as TN
from ..session import materialize
from . import bindings as B
from . import oracle as O
from . import flows as P

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


CATS = DI.BINDING_HEADLINE_CATEGORIES

# ------------------------------------------------------------------ SQL CTEs
SQL_ARTICLES = """
articles AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS GKGRECORDID,
         l_shipdate AS date,
         'S' || CAST(l_suppkey AS VARCHAR) AS V2SOURCECOMMONNAME,
         'https://s' || CAST(l_suppkey AS VARCHAR) || '.example.com/news/'
           || CAST(l_orderkey + 100000 AS VARCHAR) || '.html' AS V1DOCUMENTIDENTIFIER,
         p_name AS headline,
         concat_ws(',', CAST(round((l_tax - l_discount) * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT),
                   CAST(round(l_discount * 100) AS BIGINT)) AS "V1.5TONE"
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

SQL_ENRICHED = SQL_ARTICLES + f""",
hcounts AS (
  SELECT headline, count(*) AS n,
         {O.classify('headline', CATS)} AS crime_types,
         {O.keyword_count('headline', CATS)} AS crime_keyword_count
  FROM articles GROUP BY headline),
a1 AS (
  SELECT a.*, h.n > 1 AS dup0, h.crime_types, h.crime_keyword_count,
         {O.article_id('a.V1DOCUMENTIDENTIFIER')} AS aid
  FROM articles a LEFT JOIN hcounts h ON a.headline IS NOT DISTINCT FROM h.headline),
multi AS (
  SELECT V2SOURCECOMMONNAME AS src, aid FROM a1
  WHERE aid IS NOT NULL AND V2SOURCECOMMONNAME IS NOT NULL
  GROUP BY 1, 2 HAVING min(headline) <> max(headline)),
a2 AS (
  SELECT a1.*, CASE WHEN m.src IS NOT NULL THEN false ELSE dup0 END AS headline_is_duplicate,
         {O.tone('a1."V1.5TONE"')} AS tone
  FROM a1 LEFT JOIN multi m ON a1.V2SOURCECOMMONNAME = m.src AND a1.aid = m.aid),
days AS (SELECT CAST(date AS DATE) AS d, avg(tone) AS daily_avg_tone FROM a2
         WHERE date IS NOT NULL GROUP BY 1),
enriched AS (
  SELECT a2.date, a2.tone, days.daily_avg_tone, a2.crime_keyword_count, a2.crime_types,
         coalesce(a2.headline, '') AS headline, a2.headline_is_duplicate,
         a2.V1DOCUMENTIDENTIFIER, a2.V2SOURCECOMMONNAME, a2.GKGRECORDID, a2."V1.5TONE"
  FROM a2 LEFT JOIN days ON CAST(a2.date AS DATE) = days.d)"""

SQL_CLEANED = SQL_ENRICHED + r""",
cleaned AS (
  SELECT e.* EXCLUDE (crime_types), t.crime_types, unnest(string_split_regex(t.crime_types, '\s*,\s*')) AS crime_type
  FROM enriched e, LATERAL (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(
       coalesce(e.crime_types, ''), '^"|"$', '', 'g'), '[，﹐﹑､]', ',', 'g'), ',+', ',', 'g'),
       '[’‘‛ʻʽ`´'']', '', 'g') AS crime_types) t)"""


def enriched(spark, d):
    return P.enrich_articles(B.articles(spark, d), CATS)


def cleaned(spark, d):
    return P.cleaned_articles(enriched(spark, d))


# ------------------------------------------------------------ flagship etc.
SQL_SUMMARY = "WITH " + SQL_CLEANED + r""",
f AS (
  SELECT CAST(date AS DATE) AS Day, date_trunc('month', date) AS Month, headline,
         GKGRECORDID AS rid, V1DOCUMENTIDENTIFIER AS url, date
  FROM cleaned
  WHERE upper(trim(CAST(headline_is_duplicate AS VARCHAR))) = 'TRUE'
    AND upper(trim(crime_types)) IS DISTINCT FROM 'UNKNOWN'
    AND trim(coalesce(headline, '')) <> '' AND date IS NOT NULL),
dc AS (SELECT Day, Month, headline, count(DISTINCT rid) AS n FROM f GROUP BY 1, 2, 3),
d3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Day ORDER BY n DESC, headline) AS rk FROM dc) WHERE rk <= 3),
mc AS (SELECT Month, headline, count(DISTINCT rid) AS n FROM f GROUP BY 1, 2),
m3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Month ORDER BY n DESC, headline) AS rk FROM mc) WHERE rk <= 3),
src AS (SELECT headline, url AS Headline_Source FROM (
          SELECT headline, url, row_number() OVER (PARTITION BY headline ORDER BY date, rid) AS z
          FROM f WHERE url IS NOT NULL) WHERE z = 1),
j AS (
  SELECT d3.Day, coalesce(d3.Month, m3.Month) AS Month, coalesce(d3.headline, m3.headline) AS headline,
         coalesce(d3.n, 0) AS count_day, CAST(d3.rk AS INTEGER) AS Rank_Day, d3.rk IS NOT NULL AS Top_Day,
         m3.n AS count_month, CAST(m3.rk AS INTEGER) AS Rank_Month, m3.rk IS NOT NULL AS Top_Month
  FROM d3 FULL OUTER JOIN m3 ON d3.Month = m3.Month AND d3.headline = m3.headline),
k AS (
  SELECT j.*, src.Headline_Source,
         row_number() OVER (PARTITION BY Month, Rank_Month ORDER BY count_day DESC, Day ASC NULLS LAST, j.headline) AS z
  FROM j LEFT JOIN src ON j.headline = src.headline)
SELECT Day, Month, headline, count_day, Rank_Day, Top_Day, count_month, Rank_Month, Top_Month, Headline_Source
FROM k WHERE z = 1"""


@register("headline_summary", SQL_SUMMARY)
def q_headline_summary(spark, d):
    """Flagship.  The reference reads the cleaned (exploded) monthly files;
    the summary counts *distinct* record ids and filters on ``crime_types``,
    and the explode never drops or invents a record, so the explode is
    skipped here (same result, checked by the oracle over the exploded rows
    and by ``tests/test_summaries.py``), saving a 1.65x row blow-up before
    the distinct aggregation."""
    return SU.headline_summary(enriched(spark, d))


SQL_TIMELINE = "WITH " + SQL_CLEANED + r""",
f AS (
  SELECT headline, V2SOURCECOMMONNAME AS src, date, GKGRECORDID AS rid, crime_types FROM cleaned
  WHERE date IS NOT NULL AND upper(trim(CAST(headline_is_duplicate AS VARCHAR))) = 'TRUE'
    AND crime_type IS DISTINCT FROM 'UNKNOWN'),
u AS (SELECT * EXCLUDE (z) FROM (
        SELECT *, row_number() OVER (PARTITION BY headline, src ORDER BY date, rid, crime_types) AS z FROM f)
      WHERE z = 1),
m AS (SELECT *, date_trunc('month', date) AS Month FROM u),
mc AS (SELECT Month, count(DISTINCT headline) AS distinct_headline_count FROM m GROUP BY 1),
hm AS (SELECT Month, headline, count(DISTINCT src) AS source_count FROM m WHERE headline IS NOT NULL GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Month ORDER BY source_count DESC, headline) AS rn FROM hm) WHERE rn = 1),
ph AS (SELECT headline, strftime(min(date), '%m/%d/%Y') AS "Headline Date",
              array_to_string(list_sort(list_distinct(list(crime_types))), ', ') AS "Crime Types"
       FROM m WHERE headline IN (SELECT headline FROM top) GROUP BY 1)
SELECT mc.Month, mc.distinct_headline_count, top.headline AS "Top Headline",
       top.source_count AS "Top Headline Count", ph."Headline Date", ph."Crime Types"
FROM mc LEFT JOIN top ON mc.Month = top.Month LEFT JOIN ph ON top.headline = ph.headline"""


@register("headline_timeline", SQL_TIMELINE)
def q_headline_timeline(spark, d):
    """Reads enriched rows: the ``crime_type`` test of the exploded input is
    applied as "any label survives" (see ``headline_timeline``)."""
    return SU.headline_timeline(enriched(spark, d))


@register("enrich_articles", "WITH " + SQL_ENRICHED + " SELECT * FROM enriched")
def q_enrich_articles(spark, d):
    return enriched(spark, d)


@register("clean_articles", "WITH " + SQL_CLEANED + """
SELECT date, tone, daily_avg_tone, crime_keyword_count, crime_types, crime_type, headline,
       headline_is_duplicate, V1DOCUMENTIDENTIFIER, V2SOURCECOMMONNAME, GKGRECORDID, "V1.5TONE"
FROM cleaned""")
def q_clean_articles(spark, d):
    return C.clean_articles(enriched(spark, d))


# ---------------------------------------------------------- duplicate logic
@register("dup_flag", "WITH " + SQL_ARTICLES + """,
h AS (SELECT headline, count(*) AS n FROM articles GROUP BY 1)
SELECT a.GKGRECORDID, a.headline, h.n > 1 AS headline_is_duplicate
FROM articles a LEFT JOIN h ON a.headline IS NOT DISTINCT FROM h.headline""")
def q_dup_flag(spark, d):
    return D.flag_duplicates(B.articles(spark, d)).select(S.RID, S.HEADLINE, S.DUP)


@register("dup_flag_corrected", "WITH " + SQL_ENRICHED + """
SELECT GKGRECORDID, headline, headline_is_duplicate FROM a2""")
def q_dup_flag_corrected(spark, d):
    art = B.articles(spark, d)
    a = D.correct_false_duplicates(D.flag_duplicates(art), groups=D.multi_headline_groups(art))
    return a.select(S.RID, S.HEADLINE, S.DUP)


@register("same_article_groups", "WITH " + SQL_ARTICLES + f""",
b AS (SELECT GKGRECORDID AS rid, V2SOURCECOMMONNAME AS source,
             {O.article_id('V1DOCUMENTIDENTIFIER')} AS article_id FROM articles),
c AS (SELECT source, article_id, min(rid) AS article_key, count(*) AS records_in_article
      FROM b WHERE article_id IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2)
SELECT b.source, b.article_id, b.rid, c.article_key, c.records_in_article
FROM b JOIN c ON b.source = c.source AND b.article_id = c.article_id""")
def q_same_article_groups(spark, d):
    return D.same_article_groups(B.articles(spark, d))


@register("dedup_record", "WITH " + SQL_ARTICLES + """,
k AS (SELECT split_part(GKGRECORDID, '-', 1) || '-' || split_part(GKGRECORDID, '-', 2) AS okey,
             V2SOURCECOMMONNAME < 'S5' AS is_cached, * EXCLUDE (GKGRECORDID) FROM articles)
SELECT okey, is_cached, date, V2SOURCECOMMONNAME, V1DOCUMENTIDENTIFIER, headline, "V1.5TONE" FROM (
  SELECT *, row_number() OVER (PARTITION BY okey ORDER BY is_cached DESC, date IS NULL, date,
         is_cached, date, V2SOURCECOMMONNAME, V1DOCUMENTIDENTIFIER, headline, "V1.5TONE") AS z FROM k)
WHERE z = 1""")
def q_dedup_record(spark, d):
    a = B.articles(spark, d)
    k = a.select(F.concat_ws("-", F.split(S.RID, "-").getItem(0), F.split(S.RID, "-").getItem(1)).alias("okey"),
                 (F.col(S.SOURCE) < "S5").alias("is_cached"), S.DATE, S.SOURCE, S.URL, S.HEADLINE, "`V1.5TONE`")
    return D.dedup_records(k, key="okey", prefer="is_cached")


@register("union_distinct", "WITH " + SQL_ENRICHED + """
SELECT DISTINCT V2SOURCECOMMONNAME, headline, crime_types FROM enriched""")
def q_union_distinct(spark, d):
    return D.drop_exact_duplicates(enriched(spark, d).select(S.SOURCE, S.HEADLINE, S.TYPES))


SQL_RECORDS = r"""
records AS (
  SELECT strftime(ts, '%Y%m%d%H%M%S') || '-' || CAST(doc_id AS VARCHAR) AS GKGRECORDID,
         source AS V2SOURCECOMMONNAME,
         'https://' || source || '.example.com/news/' || CAST(doc_id + 100000 AS VARCHAR) || '/story.html' AS V1DOCUMENTIDENTIFIER,
         lang AS V1THEMES,
         regexp_replace(regexp_replace(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z]+', ';', 'g'),
                        '^;+|;+$', '', 'g'), '([A-Z]+)', '\1,1', 'g') AS V2ENHANCEDTHEMES,
         lang AS V1LOCATIONS, text AS V2ENHANCEDLOCATIONS,
         CAST(NULL AS VARCHAR) AS V1ORGANIZATIONS, CAST(NULL AS VARCHAR) AS V2ENHANCEDORGANIZATIONS,
         concat_ws(',', n_chars % 21 - 10, n_chars, doc_id) AS "V1.5TONE",
         ts AS date
  FROM (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id * 15 AS BIGINT)) AS ts FROM documents))"""


@register("union_parts", "WITH " + SQL_ARTICLES + "," + SQL_RECORDS + """
SELECT GKGRECORDID, date, V2SOURCECOMMONNAME, V1DOCUMENTIDENTIFIER FROM articles
UNION ALL
SELECT GKGRECORDID, date, V2SOURCECOMMONNAME, V1DOCUMENTIDENTIFIER FROM records""")
def q_union_parts(spark, d):
    cols = [S.RID, S.DATE, S.SOURCE, S.URL]
    return B.articles(spark, d).select(*cols).unionByName(B.records(spark, d).select(*cols))


# -------------------------------------------------------------------- tone
SQL_TONE_EVENTS = """
tev AS (SELECT event_id AS GKGRECORDID, ts AS date, event_type AS V2SOURCECOMMONNAME,
               CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || ',1,2' AS "V1.5TONE" FROM events)"""


@register("tone_extract", "WITH " + SQL_TONE_EVENTS + f"""
SELECT GKGRECORDID, "V1.5TONE", {O.tone('"V1.5TONE"')} AS tone FROM tev""")
def q_tone_extract(spark, d):
    return TN.extract_tone(B.tone_events(spark, d)).select(S.RID, "`V1.5TONE`", "tone")


@register("daily_avg_tone", "WITH " + SQL_TONE_EVENTS + f""",
t AS (SELECT *, {O.tone('"V1.5TONE"')} AS tone FROM tev),
dd AS (SELECT CAST(date AS DATE) AS d, avg(tone) AS daily_avg_tone FROM t WHERE date IS NOT NULL GROUP BY 1)
SELECT t.GKGRECORDID, t.date, t.tone, dd.daily_avg_tone FROM t LEFT JOIN dd ON CAST(t.date AS DATE) = dd.d""")
def q_daily_avg_tone(spark, d):
    t = TN.add_daily_avg_tone(TN.extract_tone(B.tone_events(spark, d)))
    return t.select(S.RID, S.DATE, "tone", "daily_avg_tone")


@register("daily_tone_series", "WITH " + SQL_TONE_EVENTS + f"""
SELECT CAST(date AS DATE) AS "Date", avg({O.tone('"V1.5TONE"')}) AS "Tone" FROM tev
WHERE date IS NOT NULL GROUP BY 1""")
def q_daily_tone_series(spark, d):
    return TN.daily_tone_series(TN.extract_tone(B.tone_events(spark, d)))


# ------------------------------------------------------- summaries (parts)
@register("duplicate_frequency", "WITH " + SQL_CLEANED + """
SELECT headline, count(DISTINCT GKGRECORDID) AS dup_count FROM cleaned
WHERE upper(trim(CAST(headline_is_duplicate AS VARCHAR))) = 'TRUE' AND headline IS NOT NULL
GROUP BY 1 HAVING count(DISTINCT GKGRECORDID) >= 3""")
def q_duplicate_frequency(spark, d):
    # distinct record counts: the explode of the cleaned input is result-neutral
    return SU.duplicate_frequency(enriched(spark, d))


@register("duplicate_histogram", "WITH " + SQL_CLEANED + """,
fr AS (SELECT headline, CAST(count(DISTINCT GKGRECORDID) AS DOUBLE) AS x FROM cleaned
       WHERE upper(trim(CAST(headline_is_duplicate AS VARCHAR))) = 'TRUE' AND headline IS NOT NULL
       GROUP BY 1 HAVING count(DISTINCT GKGRECORDID) >= 3),
st AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
              CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM fr),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(50)),
e AS (SELECT bin, CASE WHEN bin >= 50 THEN hi ELSE CAST(bin AS DOUBLE) * ((hi - lo) / 50.0) + lo END AS b0,
             CASE WHEN bin + 1 >= 50 THEN hi ELSE CAST(bin + 1 AS DOUBLE) * ((hi - lo) / 50.0) + lo END AS b1
      FROM g, st),
i0 AS (SELECT x, LEAST(CAST(floor((x - lo) * (50.0 / (hi - lo))) AS INTEGER), 49) AS i FROM fr, st),
i1 AS (SELECT i0.x, CASE WHEN i0.x < e.b0 THEN i0.i - 1 ELSE i0.i END AS i FROM i0 JOIN e ON e.bin = i0.i),
i2 AS (SELECT CASE WHEN i1.x >= e.b1 AND i1.i <> 49 THEN i1.i + 1 ELSE i1.i END AS bin FROM i1 JOIN e ON e.bin = i1.i),
c AS (SELECT bin, count(*) AS headlines FROM i2 GROUP BY 1)
SELECT e.bin, e.b0 AS bin_start, e.b1 AS bin_end, coalesce(c.headlines, 0) AS headlines
FROM e LEFT JOIN c ON e.bin = c.bin""")
def q_duplicate_histogram(spark, d):
    # distinct record counts: the explode of the cleaned input is result-neutral
    return SU.duplicate_histogram(enriched(spark, d))


@register("crime_types_by_headline", "WITH " + SQL_ENRICHED + """
SELECT headline, array_to_string(list_sort(list_distinct(list(crime_types))), ', ') AS crime_types_list
FROM enriched WHERE headline IS NOT NULL GROUP BY 1""")
def q_crime_types_by_headline(spark, d):
    return SU.crime_types_by_headline(enriched(spark, d))


@register("headline_source", "WITH " + SQL_ENRICHED + """
SELECT headline, Headline_Source FROM (
  SELECT headline, V1DOCUMENTIDENTIFIER AS Headline_Source,
         row_number() OVER (PARTITION BY headline ORDER BY date IS NULL, date, GKGRECORDID, V1DOCUMENTIDENTIFIER) AS z
  FROM enriched WHERE V1DOCUMENTIDENTIFIER IS NOT NULL AND headline IS NOT NULL) WHERE z = 1""")
def q_headline_source(spark, d):
    return SU.headline_sources(enriched(spark, d))


@register("known_duplicates", "WITH " + SQL_CLEANED + """
SELECT GKGRECORDID, date, headline, crime_type FROM cleaned
WHERE upper(trim(CAST(headline_is_duplicate AS VARCHAR))) = 'TRUE'
  AND upper(trim(crime_types)) IS DISTINCT FROM 'UNKNOWN'
  AND trim(coalesce(headline, '')) <> '' AND date IS NOT NULL""")
def q_known_duplicates(spark, d):
    return SU.known_duplicates(cleaned(spark, d)).select(S.RID, S.DATE, S.HEADLINE, S.TYPE)


@register("drop_unknown", "WITH " + SQL_ENRICHED + """
SELECT GKGRECORDID, headline, crime_types FROM enriched
WHERE upper(crime_types) IS DISTINCT FROM 'UNKNOWN'""")
def q_drop_unknown(spark, d):
    return FL.drop_unknown(enriched(spark, d)).select(S.RID, S.HEADLINE, S.TYPES)


@register("explode_types", "WITH " + SQL_CLEANED + """
SELECT GKGRECORDID, crime_types, crime_type FROM cleaned""")
def q_explode_types(spark, d):
    return C.explode_crime_types(enriched(spark, d)).select(S.RID, S.TYPES, S.TYPE)


@register("headline_semi", "WITH " + SQL_CLEANED + """,
f AS (SELECT date_trunc('month', date) AS Month, headline, GKGRECORDID AS rid FROM cleaned
      WHERE upper(trim(CAST(headline_is_duplicate AS VARCHAR))) = 'TRUE'
        AND upper(trim(crime_types)) IS DISTINCT FROM 'UNKNOWN'
        AND trim(coalesce(headline, '')) <> '' AND date IS NOT NULL),
mc AS (SELECT Month, headline, count(DISTINCT rid) AS count FROM f GROUP BY 1, 2),
m3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Month ORDER BY count DESC, headline) AS rk FROM mc) WHERE rk <= 3)
SELECT Month, headline, count, CAST(rk AS INTEGER) AS Rank_Month FROM m3
WHERE headline IN (SELECT headline FROM f)""")
def q_headline_semi(spark, d):
    f = SU.known_duplicates(cleaned(spark, d)).select(X.month_start(F.col(S.DATE)).alias("Month"), S.HEADLINE, S.RID)
    f = materialize(f, "known_duplicates")  # read for the counts and for the semi join
    mc = f.groupBy("Month", S.HEADLINE).agg(F.count_distinct(S.RID).alias("count"))
    m3 = SU._top_k(mc, ["Month"], 3, "Rank_Month", "Top_Month").drop("Top_Month")
    return SU.restrict_to_known(m3, f)


@register("deliver_articles", "WITH " + SQL_ENRICHED + """
SELECT * FROM enriched WHERE headline_is_duplicate IS NOT NULL""")
def q_deliver_articles(spark, d):
    e = enriched(spark, d)
    C.date_column(e)
    return FL.valid_flag_rows(e)


# ----------------------------------------------------- records and filters
SITES, THEMES, LOCS = DI.BINDING_SITES, DI.BINDING_THEMES, DI.BINDING_LOCATIONS
F_START, F_END = "2024-01-03 00:00:00", "2024-03-31 23:59:59"


def _sql_in(values) -> str:
    return ", ".join(O.lit(v) for v in values)


THEME_RE = "(?i)(?:^|;)(?:" + "|".join(TM.escape(t) for t in THEMES) + ")(?:,|$)"
SQL_LOC_COUNT = O.count_terms(O.upper("V2ENHANCEDLOCATIONS"), TM.word_terms(LOCS))
SQL_THEME_COUNT = O.count_terms(O.upper("V2ENHANCEDTHEMES"), TM.substring_terms(THEMES))


@register("location_mentions", "WITH " + SQL_RECORDS + f"""
SELECT GKGRECORDID, {SQL_LOC_COUNT} AS london_mentions FROM records""")
def q_location_mentions(spark, d):
    r = FL.fill_upper(B.records(spark, d))
    return r.select(S.RID, FL.location_mentions("V2ENHANCEDLOCATIONS", LOCS).alias("london_mentions"))


@register("theme_mentions", "WITH " + SQL_RECORDS + f"""
SELECT GKGRECORDID, {SQL_THEME_COUNT} AS crime_mentions FROM records""")
def q_theme_mentions(spark, d):
    r = FL.fill_upper(B.records(spark, d))
    return r.select(S.RID, FL.theme_mentions("V2ENHANCEDTHEMES", THEMES).alias("crime_mentions"))


@register("filter_theme", "WITH " + SQL_RECORDS + f"""
SELECT GKGRECORDID FROM records WHERE coalesce(regexp_matches(V2ENHANCEDTHEMES, {O.lit(THEME_RE)}), false)""")
def q_filter_theme(spark, d):
    return B.records(spark, d).where(FL.has_theme("V2ENHANCEDTHEMES", THEMES)).select(S.RID)


@register("filter_source", "WITH " + SQL_RECORDS + f"""
SELECT GKGRECORDID, V2SOURCECOMMONNAME FROM records WHERE upper(V2SOURCECOMMONNAME) IN ({_sql_in(SITES)})""")
def q_filter_source(spark, d):
    return B.records(spark, d).where(FL.source_in(S.SOURCE, SITES)).select(S.RID, S.SOURCE)


@register("filter_date_range", "WITH " + SQL_RECORDS + f"""
SELECT GKGRECORDID, date FROM records
WHERE date BETWEEN TIMESTAMP '{F_START}' AND TIMESTAMP '{F_END}'""")
def q_filter_date_range(spark, d):
    r = B.records(spark, d)
    return r.where(FL.date_between(S.DATE, F_START, F_END)).select(S.RID, S.DATE)


SQL_FILTERED = "WITH " + SQL_RECORDS + f""",
up AS (SELECT * REPLACE ({O.upper("coalesce(V2ENHANCEDTHEMES, '')")} AS V2ENHANCEDTHEMES,
                         {O.upper("coalesce(V1LOCATIONS, '')")} AS V1LOCATIONS,
                         {O.upper("coalesce(V2ENHANCEDLOCATIONS, '')")} AS V2ENHANCEDLOCATIONS,
                         {O.upper("coalesce(V2SOURCECOMMONNAME, '')")} AS V2SOURCECOMMONNAME) FROM records),
cand AS (SELECT * FROM up
  WHERE date BETWEEN TIMESTAMP '{F_START}' AND TIMESTAMP '{F_END}'
    AND V2SOURCECOMMONNAME IN ({_sql_in(SITES)})
    AND coalesce(regexp_matches(V2ENHANCEDTHEMES, {O.lit(THEME_RE)}), false)),
counted AS (SELECT *, {O.count_terms("V2ENHANCEDLOCATIONS", TM.word_terms(LOCS))} AS london_mentions,
                      {O.count_terms("V2ENHANCEDTHEMES", TM.substring_terms(THEMES))} AS crime_mentions FROM cand)"""


@register("filter_articles", SQL_FILTERED + """
SELECT * FROM counted WHERE london_mentions >= 2 AND crime_mentions >= 2""")
def q_filter_articles(spark, d):
    return FL.filter_articles(B.records(spark, d), F_START, F_END, SITES, THEMES, LOCS)


@register("project_article", SQL_FILTERED + """
SELECT date, london_mentions, crime_mentions, V1DOCUMENTIDENTIFIER, V2ENHANCEDTHEMES, V2SOURCECOMMONNAME,
       GKGRECORDID, V1THEMES, V1LOCATIONS, V2ENHANCEDLOCATIONS, V1ORGANIZATIONS, V2ENHANCEDORGANIZATIONS, "V1.5TONE"
FROM counted WHERE london_mentions >= 2 AND crime_mentions >= 2""")
def q_project_article(spark, d):
    f = FL.filter_articles(B.records(spark, d), F_START, F_END, SITES, THEMES, LOCS)
    return C.priority_order(C.drop_columns(f), S.ENRICHED_FIRST)


@register("filter_funnel", "WITH " + SQL_RECORDS + f""",
up AS (SELECT date, {O.upper("coalesce(V2SOURCECOMMONNAME, '')")} AS src,
              {O.upper("coalesce(V2ENHANCEDTHEMES, '')")} AS th,
              {O.upper("coalesce(V2ENHANCEDLOCATIONS, '')")} AS loc FROM records),
p AS (SELECT date BETWEEN TIMESTAMP '{F_START}' AND TIMESTAMP '{F_END}' AS p1, src IN ({_sql_in(SITES)}) AS p2,
             coalesce(regexp_matches(th, {O.lit(THEME_RE)}), false) AS p3,
             {O.count_terms("loc", TM.word_terms(LOCS))} >= 2 AS p4,
             {O.count_terms("th", TM.substring_terms(THEMES))} >= 2 AS p5 FROM up)
SELECT count(*) AS "rows",
       CAST(count_if(p1) AS BIGINT) AS date_kept, CAST(count_if(p1) AS BIGINT) AS date_alone,
       CAST(count_if(p1 AND p2) AS BIGINT) AS site_kept, CAST(count_if(p2) AS BIGINT) AS site_alone,
       CAST(count_if(p1 AND p2 AND p3) AS BIGINT) AS theme_kept, CAST(count_if(p3) AS BIGINT) AS theme_alone,
       CAST(count_if(p1 AND p2 AND p3 AND p4) AS BIGINT) AS locations_kept,
       CAST(count_if(p4) AS BIGINT) AS locations_alone,
       CAST(count_if(p1 AND p2 AND p3 AND p4 AND p5) AS BIGINT) AS themes2_kept,
       CAST(count_if(p5) AS BIGINT) AS themes2_alone
FROM p""")
def q_filter_funnel(spark, d):
    r = FL.fill_upper(B.records(spark, d))
    return FL.filter_funnel(r, {
        "date": FL.date_between(S.DATE, F_START, F_END),
        "site": FL.source_in(S.SOURCE, SITES),
        "theme": FL.has_theme("V2ENHANCEDTHEMES", THEMES),
        "locations": FL.location_mentions("V2ENHANCEDLOCATIONS", LOCS) >= 2,
        "themes2": FL.theme_mentions("V2ENHANCEDTHEMES", THEMES) >= 2,
    })


# legacy profile (substring / regex semantics)
LEGACY_SITES = ("SRC1", "SRC2.")
SQL_LEG_BLOCKS = (f"len(list_filter(string_split(regexp_replace(coalesce(V2ENHANCEDTHEMES, ''), "
                  f"'([^;,]+),([0-9]+)', '4#\\1#\\2', 'g'), ';'), lambda b: len(string_split(b, '#')) >= 3 "
                  f"AND list_bool_or([contains(string_split(b, '#')[2], t) FOR t IN [{_sql_in(LOCS)}]])))")


@register("filter_source_legacy", "WITH " + SQL_RECORDS + f"""
SELECT GKGRECORDID, upper(V2SOURCECOMMONNAME) AS V2SOURCECOMMONNAME FROM records
WHERE coalesce(regexp_matches(upper(V2SOURCECOMMONNAME), {O.lit('|'.join(LEGACY_SITES))}), false)""")
def q_filter_source_legacy(spark, d):
    r = FL.fill_upper(B.records(spark, d))
    return r.where(FL.source_matches_legacy(S.SOURCE, LEGACY_SITES)).select(S.RID, S.SOURCE)


@register("filter_theme_legacy", "WITH " + SQL_RECORDS + f"""
SELECT GKGRECORDID FROM records
WHERE coalesce(regexp_matches(V2ENHANCEDTHEMES, {O.lit('(?i)(?:' + '|'.join(TM.escape(t) for t in ('ERTH', 'OUQUE')) + ')')}), false)""")
def q_filter_theme_legacy(spark, d):
    return B.records(spark, d).where(FL.has_theme_legacy("V2ENHANCEDTHEMES", ("ERTH", "OUQUE"))).select(S.RID)


@register("filter_location_legacy", "WITH " + SQL_RECORDS + f"""
SELECT GKGRECORDID FROM records
WHERE coalesce(regexp_matches(V1LOCATIONS, '(?i)(?:DE|FR)'), false)
   OR coalesce(regexp_matches(V2ENHANCEDLOCATIONS, '(?i)(?:DE|FR)'), false)""")
def q_filter_location_legacy(spark, d):
    r = B.records(spark, d)
    return r.where(FL.location_legacy("V1LOCATIONS", "V2ENHANCEDLOCATIONS", ("DE", "FR"))).select(S.RID)


@register("location_blocks_legacy", "WITH " + SQL_RECORDS + f"""
SELECT GKGRECORDID, CAST({SQL_LEG_BLOCKS} AS INTEGER) AS london_mentions FROM records""")
def q_location_blocks_legacy(spark, d):
    r = B.records(spark, d)
    blocks = F.regexp_replace(F.coalesce(F.col("V2ENHANCEDTHEMES"), F.lit("")), r"([^;,]+),([0-9]+)", "4#$1#$2")
    r = r.withColumn("_blocks", blocks)
    return r.select(S.RID, FL.location_blocks_legacy("_blocks", LOCS).alias("london_mentions"))


@register("theme_distinct_legacy", "WITH " + SQL_RECORDS + f"""
SELECT GKGRECORDID, CAST(({' + '.join(f"CAST(contains(coalesce(V2ENHANCEDTHEMES, ''), {O.lit(t)}) AS INTEGER)" for t in dict.fromkeys(THEMES))}) AS INTEGER) AS crime_mentions
FROM records""")
def q_theme_distinct_legacy(spark, d):
    r = B.records(spark, d)
    return r.select(S.RID, FL.theme_distinct_legacy("V2ENHANCEDTHEMES", THEMES).alias("crime_mentions"))


# --------------------------------------------------- classification / text
TCATS = DI.BINDING_TEXT_CATEGORIES


@register("classify_headline", f"""
SELECT doc_id, {O.classify('text', TCATS)} AS crime_types FROM documents""")
def q_classify_headline(spark, d):
    doc = B.table(spark, d, "documents")
    return doc.select("doc_id", F.array_join(TM.classify(F.col("text"), TCATS), ", ").alias("crime_types"))


@register("keyword_count", f"""
SELECT doc_id, {O.keyword_count('text', TCATS)} AS crime_keyword_count FROM documents""")
def q_keyword_count(spark, d):
    doc = B.table(spark, d, "documents")
    kw = TM.pattern_terms(TM.keyword_patterns(TCATS))
    return doc.select("doc_id", TM.count_terms(F.lower(F.coalesce(F.col("text"), F.lit(""))), kw)
                      .alias("crime_keyword_count"))


@register("record_time", "WITH " + SQL_RECORDS + """
SELECT GKGRECORDID, try_strptime(substr(GKGRECORDID, 1, 14), '%Y%m%d%H%M%S') AS record_time FROM records""")
def q_record_time(spark, d):
    return B.records(spark, d).select(S.RID, X.record_time(F.col(S.RID)).alias("record_time"))


@register("article_id", "WITH " + SQL_ARTICLES + "," + SQL_RECORDS + f""",
u AS (SELECT url FROM pages UNION ALL SELECT V1DOCUMENTIDENTIFIER FROM articles
      UNION ALL SELECT V1DOCUMENTIDENTIFIER FROM records)
SELECT url, {O.article_id('url')} AS article_id FROM u""")
def q_article_id(spark, d):
    u = (B.table(spark, d, "pages").select("url")
         .unionByName(B.articles(spark, d).select(F.col(S.URL).alias("url")))
         .unionByName(B.records(spark, d).select(F.col(S.URL).alias("url"))))
    return u.select("url", X.article_id(F.col("url")).alias("article_id"))


ACR = sorted(DI.BINDING_ACRONYMS)


def slug_urls(spark, d):
    part = B.table(spark, d, "part")
    slugs = part.select(F.concat(F.lit("https://news.example.com/"), F.lower("p_type"), F.lit("/"),
                                 F.regexp_replace("p_name", " ", "-"), F.lit("-"),
                                 (F.col("p_partkey") + 100000).cast("string"), F.lit(".html")).alias("url"))
    return B.table(spark, d, "pages").select("url").unionByName(slugs)


@register("headline_from_url", r"""
WITH u AS (SELECT url FROM pages UNION ALL
           SELECT 'https://news.example.com/' || lower(p_type) || '/' || replace(p_name, ' ', '-') || '-'
                  || CAST(p_partkey + 100000 AS VARCHAR) || '.html' FROM part),
p AS (SELECT url, regexp_replace(regexp_replace(regexp_extract(url,
        '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', ''), '^/+|/+$', '', 'g') AS path FROM u),
s AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1),
        '\.html?$', ''), '-id[A-Za-z0-9]+$', ''), '-(\d{6,})$', '') AS slug FROM p),
w AS (SELECT url, list_transform(list_filter(list_transform(string_split(slug, '-'),
        lambda x: lower(regexp_replace(x, '[^\p{L}\p{N}_-]', '', 'g'))), lambda x: x <> ''),
        lambda x: CASE WHEN x IN (""" + _sql_in(ACR) + r""") THEN upper(x) ELSE x END) AS words FROM s)
SELECT url, CASE WHEN url IS NULL OR len(words) = 0 THEN NULL ELSE array_to_string(words, ' ') END AS headline FROM w""")
def q_headline_from_url(spark, d):
    return slug_urls(spark, d).select("url", X.headline_from_url(F.col("url"), ACR).alias("headline"))


#: entities that the test titles hold, in decoding order
SQL_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&")):
    SQL_TITLE = f"replace({SQL_TITLE}, '{_entity}', '{_char}')"
SQL_TITLE = f"nfc_normalize(trim({SQL_TITLE}))"
#: head tags put before a page by its id, and the headline they mean (None: the page's own title)
META = {
    1: ('<meta property="og:title" content="New > old &amp; more {}">', "New > old & more {}"),
    2: ("<meta name='twitter:title' content='Tweet &quot;{}&quot; Caf&eacute;'>", 'Tweet "{}" Café'),
    3: ('<meta content="First {}" name="x" property="og:title">', "First {}"),
    4: ('<!-- <meta property="og:title" content="Old {}"> --><titlebar>no</titlebar>', None),
    5: ('<meta property="og:title" content=""><meta name="twitter:title" content="Blank og {}">', "Blank og {}"),
}
SQL_META = "CASE page_id % 6 " + " ".join("WHEN {} THEN '{}'".format(k, h.replace("{}", "' || page_id || '")) for k, (_, h) in META.items() if h) + f" ELSE {SQL_TITLE} END"


def meta_pages(spark, d):
    """The pages with og and twitter tags, comments and look-alike tags in front."""
    head = F.lit("")
    for k, (tag, _) in META.items():
        head = F.when(F.col("page_id") % 6 == k, F.replace(F.lit(tag), F.lit("{}"), F.col("page_id").cast("string"))).otherwise(head)
    return B.table(spark, d, "pages").withColumn("html", F.concat(head, "html"))


@register("headline_from_html", f"SELECT page_id, url, {SQL_META} AS headline FROM pages WHERE starts_with(url, 'http')")
def q_headline_from_html(spark, d):
    pages = meta_pages(spark, d)
    return pages.where(F.col("url").startswith("http")).select(
        "page_id", "url", X.headline_from_html(F.col("html")).alias("headline"))


def _low6(k: int) -> str:
    return f"(unicode(m[{k}:{k}]) & 63)"


#: latin-1 cut, then every valid UTF-8 sequence of its code points (RE2 has no bytes)
SQL_MOJIBAKE = r"""CASE WHEN text IS NULL THEN '' ELSE array_to_string(list_transform(regexp_extract_all(
  regexp_replace(text, '[^\x{00}-\x{FF}]', '', 'g'),
  '[\x{00}-\x{7F}]+|[\x{C2}-\x{DF}][\x{80}-\x{BF}]|\x{E0}[\x{A0}-\x{BF}][\x{80}-\x{BF}]|[\x{E1}-\x{EC}\x{EE}\x{EF}][\x{80}-\x{BF}]{2}|\x{ED}[\x{80}-\x{9F}][\x{80}-\x{BF}]|\x{F0}[\x{90}-\x{BF}][\x{80}-\x{BF}]{2}|[\x{F1}-\x{F3}][\x{80}-\x{BF}]{3}|\x{F4}[\x{80}-\x{8F}][\x{80}-\x{BF}]{2}'),
  lambda m: CASE WHEN unicode(m) < 128 THEN m WHEN unicode(m) < 224 THEN chr((unicode(m) & 31) * 64 + """ + _low6(2) + """)
    WHEN unicode(m) < 240 THEN chr((unicode(m) & 15) * 4096 + """ + _low6(2) + " * 64 + " + _low6(3) + """)
    ELSE chr((unicode(m) & 7) * 262144 + """ + _low6(2) + " * 4096 + " + _low6(3) + " * 64 + " + _low6(4) + """) END), '') END"""
#: appended to or put into texts: UTF-8 read as latin-1 (of a real U+FFFD, of the euro sign), and a cut sequence
BROKEN_TAIL = " ï¿½ â\u0082¬ Ã"
SQL_BROKEN = f"""broken AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text
  WHEN 1 THEN replace(replace(text, 'é', 'Ã©'), 'ó', 'Ã³') || '{BROKEN_TAIL}'
  ELSE replace(text, 'e', 'ï¿½') END AS text FROM documents)"""


def broken_texts(spark, d):
    """Document texts, two thirds of them damaged in different ways."""
    doc = B.table(spark, d, "documents")
    t = F.col("text")
    one = F.concat(F.replace(F.replace(t, F.lit("é"), F.lit("Ã©")), F.lit("ó"), F.lit("Ã³")), F.lit(BROKEN_TAIL))
    return doc.select("doc_id", F.when(F.col("doc_id") % 3 == 0, t).when(F.col("doc_id") % 3 == 1, one)
                      .otherwise(F.replace(t, F.lit("e"), F.lit("ï¿½"))).alias("text"))


@register("fix_mojibake", "WITH " + SQL_BROKEN + "\nSELECT doc_id, " + SQL_MOJIBAKE + " AS text FROM broken")
def q_fix_mojibake(spark, d):
    return broken_texts(spark, d).select("doc_id", X.fix_mojibake(F.col("text")).alias("text"))


@register("normalize_text", """
SELECT doc_id, translate(text, '，﹐､‚ˏ' || chr(160), ',,,,, ') AS text FROM documents""")
def q_normalize_text(spark, d):
    doc = B.table(spark, d, "documents")
    return doc.select("doc_id", X.normalize_commas(F.col("text")).alias("text"))


SQL_DATE_TEXT = """
dt AS (SELECT o_orderkey, CASE o_orderpriority
         WHEN '1-URGENT' THEN strftime(o_orderdate, '%m/%d/%Y')
         WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
         WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%m-%d')
         WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y%m%d%H%M%S')
         ELSE 'bad ' || CAST(o_orderkey AS VARCHAR) END AS date_text FROM orders)"""


@register("parse_dates", "WITH " + SQL_DATE_TEXT + """
SELECT o_orderkey, date_text, coalesce(
  try_strptime(trim(date_text), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(date_text), '%Y-%m-%dT%H:%M:%S'),
  try_strptime(trim(date_text), '%Y-%m-%d %H:%M'), try_strptime(trim(date_text), '%Y-%m-%d'),
  try_strptime(trim(date_text), '%m/%d/%Y %H:%M:%S'), try_strptime(trim(date_text), '%m/%d/%Y %H:%M'),
  try_strptime(trim(date_text), '%m/%d/%Y'), try_strptime(trim(date_text), '%Y%m%d%H%M%S')) AS date
FROM dt""")
def q_parse_dates(spark, d):
    o = B.table(spark, d, "orders")
    p, od = F.col("o_orderpriority"), F.col("o_orderdate")
    text = (F.when(p == "1-URGENT", F.date_format(od, "MM/dd/yyyy"))
            .when(p == "2-HIGH", F.date_format(od, "yyyy-MM-dd HH:mm:ss"))
            .when(p == "3-MEDIUM", F.date_format(od, "yyyy-MM-dd"))
            .when(p == "4-NOT SPECIFIED", F.date_format(od, "yyyyMMddHHmmss"))
            .otherwise(F.concat(F.lit("bad "), F.col("o_orderkey").cast("string"))))
    t = o.select("o_orderkey", text.alias("date_text"))
    return t.withColumn("date", X.parse_mixed_date(F.col("date_text")))


# ------------------------------------------------------- grids and caches
from ..operators import grid as G  # noqa: E402
from ..operators import headlines as H  # noqa: E402
from ..operators import indicators as IND  # noqa: E402


def event_bounds(spark, d):
    ev = B.table(spark, d, "events")
    return ev.agg(G.floor_15min(F.min("ts")).alias("start"), G.floor_15min(F.max("ts")).alias("end"))


SQL_GRID = """
b AS (SELECT time_bucket(INTERVAL '15 minutes', min(ts)) AS s, time_bucket(INTERVAL '15 minutes', max(ts)) AS e FROM events),
g AS (SELECT unnest(generate_series(s, e, INTERVAL '15 minutes')) AS ts FROM b)"""


@register("interval_grid", "WITH " + SQL_GRID + """
SELECT ts, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM g""")
def q_interval_grid(spark, d):
    return G.interval_grid(event_bounds(spark, d))


@register("missing_intervals", "WITH " + SQL_GRID + """
SELECT ts, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM g
WHERE ts NOT IN (SELECT DISTINCT time_bucket(INTERVAL '15 minutes', ts) FROM events WHERE ts IS NOT NULL)""")
def q_missing_intervals(spark, d):
    ev = B.table(spark, d, "events").where(F.col("ts").isNotNull())
    return G.missing_intervals(G.interval_grid(event_bounds(spark, d)), ev)


@register("recent_grid", """
WITH n AS (SELECT time_bucket(INTERVAL '15 minutes', max(ts)) AS now FROM events)
SELECT CAST(i AS INTEGER) AS i, now - to_minutes(i * 15) AS ts, strftime(now - to_minutes(i * 15), '%Y%m%d%H%M%S') AS stamp
FROM n, (SELECT range AS i FROM range(96))""")
def q_recent_grid(spark, d):
    now = B.table(spark, d, "events").agg(F.max("ts").alias("now"))
    return G.recent_grid(now, hours_back=24)


@register("months_to_process", """
WITH b AS (SELECT make_date(year(min(ts)), 1, 1) AS s, make_date(year(max(ts)), 12, 31) AS e FROM events),
m AS (SELECT CAST(unnest(generate_series(s, e, INTERVAL 1 MONTH)) AS DATE) AS month FROM b),
done AS (SELECT DISTINCT CAST(date_trunc('month', ts) AS DATE) AS month FROM events WHERE ts IS NOT NULL)
SELECT month, last_day(month) AS month_end FROM m WHERE month NOT IN (SELECT month FROM done)""")
def q_months_to_process(spark, d):
    """Months of the years covered by ``events`` that have no data yet."""
    ev = B.table(spark, d, "events")
    bounds = ev.agg(F.make_date(F.year(F.min("ts")), F.lit(1), F.lit(1)).alias("start"),
                    F.make_date(F.year(F.max("ts")), F.lit(12), F.lit(31)).alias("end"))
    done = ev.where(F.col("ts").isNotNull()).select(F.to_date("ts").alias("month"))
    return G.months_to_process(bounds, done)


@register("month_groups", """
SELECT strftime(ts, '%Y%m') AS month_key, min(ts) AS start, max(ts) AS "end", count(*) AS "rows"
FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def q_month_groups(spark, d):
    return G.month_groups(B.table(spark, d, "events"), ts="ts")


def cache_names(spark, d):
    o = B.table(spark, d, "orders")
    good = o.select(F.concat(F.date_format(F.trunc("o_orderdate", "MM"), "yyyy-MM-dd"), F.lit("_to_"),
                             F.date_format(F.last_day("o_orderdate"), "yyyy-MM-dd"),
                             F.lit("_23-59-59.parquet")).alias("file_name"))
    bad = o.select(F.concat(F.lit("bad_"), F.col("o_orderstatus"), F.lit(".parquet")).alias("file_name"))
    return good.unionByName(bad).distinct()


SQL_NAMES = """
names AS (SELECT DISTINCT file_name FROM (
  SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') || '_to_' || strftime(last_day(o_orderdate), '%Y-%m-%d')
         || '_23-59-59.parquet' AS file_name FROM orders
  UNION ALL SELECT 'bad_' || o_orderstatus || '.parquet' FROM orders)),
parsed AS (SELECT file_name,
  try_strptime(regexp_extract(file_name, '(?i)^(\\d{4}-\\d{2}-\\d{2})_to_(\\d{4}-\\d{2}-\\d{2}_\\d{2}-\\d{2}-\\d{2})\\.parquet$', 1), '%Y-%m-%d') AS s0,
  try_strptime(regexp_extract(file_name, '(?i)^(\\d{4}-\\d{2}-\\d{2})_to_(\\d{4}-\\d{2}-\\d{2}_\\d{2}-\\d{2}-\\d{2})\\.parquet$', 2), '%Y-%m-%d_%H-%M-%S') AS e0
  FROM names),
ranges AS (SELECT file_name, CASE WHEN s0 IS NOT NULL AND e0 IS NOT NULL THEN s0 END AS start,
                  CASE WHEN s0 IS NOT NULL AND e0 IS NOT NULL THEN e0 END AS "end" FROM parsed)""".replace("\\\\", "\\")
REQ_START, REQ_END = "1996-03-15 00:00:00", "1997-02-10 23:59:59"


@register("parse_range_name", "WITH " + SQL_NAMES + """
SELECT file_name, start, "end" FROM ranges""")
def q_parse_range_name(spark, d):
    n = cache_names(spark, d)
    r = n.select("file_name", X.range_from_name(F.col("file_name"), "parquet").alias("_r"))
    return r.select("file_name", F.col("_r.start").alias("start"), F.col("_r.end").alias("end"))


@register("cache_overlap", "WITH " + SQL_NAMES + f"""
, ov AS (SELECT file_name FROM ranges WHERE start IS NOT NULL AND "end" >= TIMESTAMP '{REQ_START}' AND start <= TIMESTAMP '{REQ_END}'),
rows AS (SELECT o_orderkey, o_orderdate AS date,
                strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') || '_to_' || strftime(last_day(o_orderdate), '%Y-%m-%d')
                || '_23-59-59.parquet' AS file_name FROM orders)
SELECT o_orderkey, date, file_name FROM rows
WHERE file_name IN (SELECT file_name FROM ov) AND date BETWEEN TIMESTAMP '{REQ_START}' AND TIMESTAMP '{REQ_END}'""")
def q_cache_overlap(spark, d):
    ranges = G.cached_ranges(cache_names(spark, d))
    o = B.table(spark, d, "orders")
    rows = o.select("o_orderkey", F.col("o_orderdate").alias("date"),
                    F.concat(F.date_format(F.trunc("o_orderdate", "MM"), "yyyy-MM-dd"), F.lit("_to_"),
                             F.date_format(F.last_day("o_orderdate"), "yyyy-MM-dd"),
                             F.lit("_23-59-59.parquet")).alias("file_name"))
    return G.slice_overlaps(rows, ranges, REQ_START, REQ_END)


@register("cache_coverage", "WITH " + SQL_NAMES + f"""
, ov AS (SELECT * FROM ranges WHERE start IS NOT NULL AND "end" >= TIMESTAMP '{REQ_START}' AND start <= TIMESTAMP '{REQ_END}'),
days AS (SELECT CAST(unnest(generate_series(DATE '{REQ_START[:10]}', DATE '{REQ_END[:10]}', INTERVAL 1 DAY)) AS DATE) AS day),
cov AS (SELECT DISTINCT CAST(unnest(generate_series(CAST(start AS DATE), CAST("end" AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM ov)
SELECT min(start) AS min_start, max("end") AS max_end, count(*) AS ranges,
       coalesce(min(start) <= TIMESTAMP '{REQ_START}' AND max("end") >= TIMESTAMP '{REQ_END}', false) AS covered_minmax,
       (SELECT count(*) FROM days WHERE day NOT IN (SELECT day FROM cov)) AS gap_days
FROM ov""")
def q_cache_coverage(spark, d):
    return G.cache_coverage(G.cached_ranges(cache_names(spark, d)), REQ_START, REQ_END)


# ------------------------------------------------------- headline cache
SQL_PAGE_CACHE = r"""
oldc AS (SELECT url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS headline,
                TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS seen_at FROM pages),
newc AS (SELECT url, upper(replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 'ß', 'ss')) AS headline,
                TIMESTAMP '2024-01-01 00:00:00' + to_minutes(500 - page_id) AS seen_at FROM pages)"""


def page_caches(spark, d):
    pages = B.table(spark, d, "pages")
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    old = pages.select("url", title.alias("headline"),
                       (t0 + F.make_dt_interval(mins=F.col("page_id").cast("int"))).alias("seen_at"))
    new = pages.select("url", F.upper(title).alias("headline"),
                       (t0 + F.make_dt_interval(mins=(F.lit(500) - F.col("page_id")).cast("int"))).alias("seen_at"))
    return old, new


@register("headline_cache_upsert", "WITH " + SQL_PAGE_CACHE + """
SELECT url, headline, seen_at FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY seen_at DESC, headline DESC) AS z
  FROM (SELECT * FROM oldc UNION ALL SELECT * FROM newc)) WHERE z = 1""")
def q_headline_cache_upsert(spark, d):
    old, new = page_caches(spark, d)
    return H.cache_upsert(old, new)


SQL_RESOLVE = f"""WITH slug AS ({QUERIES["headline_from_url"][1]}),
u AS (SELECT DISTINCT url, headline AS slug FROM slug WHERE url IS NOT NULL),
c AS (SELECT url, max(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))) AS cached FROM pages WHERE page_id % 3 = 0 GROUP BY 1),
p AS (SELECT url, max({SQL_META}) AS h FROM pages WHERE page_id % 7 <> 0 GROUP BY 1)
SELECT u.url,
       CASE WHEN nullif(cached, '') IS NOT NULL THEN nfc_normalize(cached) WHEN NOT starts_with(u.url, 'http') THEN NULL
            WHEN p.url IS NULL THEN nfc_normalize(slug) ELSE h END AS headline,
       CASE WHEN nullif(cached, '') IS NOT NULL OR NOT starts_with(u.url, 'http') THEN NULL
            WHEN p.url IS NULL THEN slug ELSE coalesce(h, '{S.MISSED_HEADLINE}') END AS cache_entry
FROM u LEFT JOIN c ON c.url = u.url LEFT JOIN p ON p.url = u.url"""


@register("headline_resolve", SQL_RESOLVE)
def q_headline_resolve(spark, d):
    """Article urls resolved through the cache (a third of the pages), pages (some
    fetched twice, some failed) and the slug."""
    old, _ = page_caches(spark, d)
    pages = meta_pages(spark, d)
    fetched = pages.withColumn("html", F.when(F.col("page_id") % 7 != 0, F.col("html")))
    twice = fetched.unionByName(pages.where("page_id % 2 = 0 AND page_id % 7 <> 0"))
    third = old.join(pages.where("page_id % 3 = 0").select("url"), "url", "left_semi")
    return H.resolve_headlines(slug_urls(spark, d), twice, third, ACR)


# ------------------------------------------------------- indicators
SQL_IND = """
ind AS (
  SELECT n_name AS Country, CAST(year(o_orderdate) AS INTEGER) AS "Year",
         CASE WHEN r_name = 'AMERICA' THEN '' ELSE r_name END AS Continent, r_name AS Region,
         CAST(count(*) AS VARCHAR) AS "Wealth Index",
         CASE WHEN count_if(o_orderpriority = '1-URGENT') = 0 THEN '' ELSE CAST(count_if(o_orderpriority = '1-URGENT') AS VARCHAR) END AS "GINI Index",
         CASE WHEN count(DISTINCT c_custkey) < 3 THEN 'n/a' ELSE CAST(count(DISTINCT c_custkey) AS VARCHAR) END AS "Adult Literacy Rate (%)"
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3, 4)"""


def indicators(spark, d):
    o = B.table(spark, d, "orders")
    c = B.table(spark, d, "customer")
    n = B.table(spark, d, "nation")
    r = B.table(spark, d, "region")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey) \
         .join(r, n.n_regionkey == r.r_regionkey)
    urgent = F.count_if(F.col("o_orderpriority") == "1-URGENT")
    cust = F.count_distinct("c_custkey")
    return j.groupBy(F.col("n_name").alias("Country"), F.year("o_orderdate").alias("Year"),
                     F.when(F.col("r_name") == "AMERICA", F.lit("")).otherwise(F.col("r_name")).alias("Continent"),
                     F.col("r_name").alias("Region")).agg(
        F.count(F.lit(1)).cast("string").alias("Wealth Index"),
        F.when(urgent == 0, F.lit("")).otherwise(urgent.cast("string")).alias("GINI Index"),
        F.when(cust < 3, F.lit("n/a")).otherwise(cust.cast("string")).alias("Adult Literacy Rate (%)"))


def _sql_js(col, gini=False):
    blank = "CAST(NULL AS DOUBLE)" if gini else "0.0"
    return (f"CASE WHEN {col} IS NULL OR trim({col}) = '' THEN {blank} "
            f"ELSE coalesce(TRY_CAST(trim({col}) AS DOUBLE), CAST('NaN' AS DOUBLE)) END")


@register("indicator_slice", "WITH " + SQL_IND + f""",
s AS (SELECT Country, coalesce(nullif(Continent, ''), nullif(Region, ''), 'Other') AS Region,
             {_sql_js('"Wealth Index"')} AS x, {_sql_js('"Adult Literacy Rate (%)"')} AS y
      FROM ind WHERE "Year" = 1996),
k AS (SELECT * FROM s WHERE x IS NOT NULL AND NOT isnan(x) AND y IS NOT NULL AND NOT isnan(y))
SELECT Country, Region, x, y, printf('%.1f', x) AS x_label, printf('%.1f', y) AS y_label,
       (SELECT min(x) FROM k) AS x_min, (SELECT max(x) FROM k) AS x_max,
       (SELECT min(y) FROM k) AS y_min, (SELECT max(y) FROM k) AS y_max
FROM k""")
def q_indicator_slice(spark, d):
    return IND.indicator_slice(indicators(spark, d), 1996, "Wealth Index", "Adult Literacy Rate (%)")


@register("indicator_domains", "WITH " + SQL_IND + """
SELECT 'year' AS kind, CAST("Year" AS VARCHAR) AS value, "Year" AS ord FROM (SELECT DISTINCT "Year" FROM ind WHERE "Year" IS NOT NULL)
UNION ALL SELECT 'latest_year', CAST(max("Year") AS VARCHAR), CAST(max("Year") AS INTEGER) FROM ind
UNION ALL SELECT DISTINCT 'region', coalesce(nullif(Continent, ''), nullif(Region, ''), 'Other'), CAST(NULL AS INTEGER) FROM ind""")
def q_indicator_domains(spark, d):
    return IND.indicator_domains(indicators(spark, d))


@register("indicator_gini", "WITH " + SQL_IND + f"""
SELECT Country, "Year", {_sql_js('"GINI Index"', gini=True)} AS gini FROM ind""")
def q_indicator_gini(spark, d):
    ind = indicators(spark, d)
    return ind.select("Country", "Year", IND.js_number(F.col("`GINI Index`"), blank_is_null=True).alias("gini"))


# ------------------------------------------------------- location top 2
@register("location_top2", "WITH " + SQL_RECORDS + """,
b AS (SELECT GKGRECORDID, unnest(string_split(regexp_replace(coalesce(V2ENHANCEDTHEMES, ''), '([^;,]+),([0-9]+)', '4#\\1#\\2', 'g'), ';')) AS blk FROM records),
l AS (SELECT GKGRECORDID, string_split(blk, '#')[2] AS loc FROM b),
c AS (SELECT GKGRECORDID, loc, count(*) AS n FROM l WHERE loc IS NOT NULL AND loc <> '' GROUP BY 1, 2),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY GKGRECORDID ORDER BY n DESC, loc) AS rk FROM c) WHERE rk <= 2)
SELECT GKGRECORDID, V2SOURCECOMMONNAME FROM records WHERE GKGRECORDID IN (SELECT GKGRECORDID FROM t WHERE loc = 'THE')""".replace("\\\\", "\\"))
def q_location_top2(spark, d):
    r = B.records(spark, d)
    blocks = F.regexp_replace(F.coalesce(F.col("V2ENHANCEDTHEMES"), F.lit("")), r"([^;,]+),([0-9]+)", "4#$1#$2")
    r = r.withColumn("_blocks", blocks)
    return FL.location_top2(r, col="_blocks", name="THE").select(S.RID, S.SOURCE)


# ------------------------------------------------------- raw drops
from ..sources import gkg as GK  # noqa: E402
from ..streaming import ingest as STR  # noqa: E402

SQL_DROPS = r"""
ev AS (SELECT *, time_bucket(INTERVAL '15 minutes', ts) AS drop_ts FROM events),
lines AS (SELECT strftime(drop_ts, '%Y%m%d%H%M%S') || '-' || CAST(event_id AS VARCHAR) AS GKGRECORDID,
                 event_type || '.example.com' AS V2SOURCECOMMONNAME,
                 'https://' || event_type || '.example.com/' || CAST(event_id + 100000 AS VARCHAR) || '.html' AS V1DOCUMENTIDENTIFIER,
                 upper(event_type) AS V1THEMES,
                 upper(event_type) || ',' || CAST(user_id AS VARCHAR) AS V2ENHANCEDTHEMES,
                 CAST(NULL AS VARCHAR) AS V1LOCATIONS,
                 CASE WHEN props IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND',
                      '1.#QNAN', 'N/A', 'NA', 'NULL', 'NaN', 'n/a', 'nan', 'null') THEN NULL ELSE props END AS V2ENHANCEDLOCATIONS,
                 CAST(NULL AS VARCHAR) AS V1ORGANIZATIONS, CAST(NULL AS VARCHAR) AS V2ENHANCEDORGANIZATIONS,
                 CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || ',1,2' AS "V1.5TONE",
                 drop_ts AS date
          FROM ev)"""


@register("gkg_ingest", "WITH " + SQL_DROPS + " SELECT * FROM lines")
def q_gkg_ingest(spark, d):
    """Raw text drops derived from ``events`` parsed back."""
    return GK.read_text_drops(spark, B.write_drops(spark, d))


@register("incremental_ingest", "WITH " + SQL_DROPS + " SELECT * FROM lines")
def q_incremental_ingest(spark, d):
    """T4: the same drops landed by an ``availableNow`` file stream (the
    stream's checkpoint records processed drops), read back."""
    import uuid
    src = B.write_drops(spark, d)
    base = f"{src}-landed-{uuid.uuid4().hex}"
    STR.ingest_available(spark, src, f"{base}/data", f"{base}/_checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/data").drop("batch", "day")


# ------------------------------------------------- sources and cleaning at work
from ..sources import files as FI  # noqa: E402


def scratch(spark, name):
    import uuid
    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


@register("parsed_range_scan", "WITH " + SQL_DROPS + """, b AS (SELECT min(date) + (max(date) - min(date)) / 4 AS s, min(date) + (max(date) - min(date)) / 2 AS e FROM lines)
SELECT GKGRECORDID, V2SOURCECOMMONNAME, date FROM lines, b WHERE date BETWEEN date_trunc('day', s) AND date_trunc('day', e) + INTERVAL '6 hours'""")
def q_parsed_range_scan(spark, d):
    """Drops landed by day, then an inclusive range read by partition."""
    out = scratch(spark, "landed")
    GK.land(GK.read_text_drops(spark, B.write_drops(spark, d)), out)
    lo, hi = spark.read.parquet(out).agg(F.min(S.DATE), F.max(S.DATE)).first()
    start = (lo + (hi - lo) / 4).replace(hour=0, minute=0, second=0, microsecond=0)
    end = (lo + (hi - lo) / 2).replace(hour=6, minute=0, second=0, microsecond=0)
    return GK.scan_range(spark, out, f"{start:%Y-%m-%d %H:%M:%S}", f"{end:%Y-%m-%d %H:%M:%S}").select(S.RID, S.SOURCE, S.DATE)


SQL_MONTHLY = """m AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date,
  CASE WHEN o_orderpriority = '5-LOW' THEN ' a "quoted", line' || chr(10) || 'two ' ELSE o_orderpriority END AS headline,
  CASE o_orderstatus WHEN 'F' THEN ' unknown ' WHEN 'O' THEN 'THEFT' ELSE 'FRAUD, THEFT' END AS crime_types FROM orders)"""


@register("monthly_union", "WITH " + SQL_MONTHLY + """
SELECT CAST(o_orderkey AS VARCHAR) AS id, date, headline, CASE WHEN month < '1995-01' THEN NULL ELSE crime_types END AS crime_types, month FROM m
WHERE month >= '1993-01'""")
def q_monthly_union(spark, d):
    """Monthly CSVs (quotes, newlines, three header forms) stacked by name;
    files without a headline column are left out."""
    o = B.table(spark, d, "orders")
    text = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(' a "quoted", line\ntwo ')).otherwise(F.col("o_orderpriority"))
    types = F.when(F.col("o_orderstatus") == "F", " unknown ").when(F.col("o_orderstatus") == "O", "THEFT").otherwise("FRAUD, THEFT")
    rows = o.select(F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date"),
                    text.alias("headline"), types.alias("crime_types"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    out = scratch(spark, "monthly")
    files = max(2, o.rdd.getNumPartitions())  # a file is written by one task
    for name, part, cols in (("a", F.col("month") < "1993-01", ["id", "date", "month"]),
                             ("b", (F.col("month") >= "1993-01") & (F.col("month") < "1995-01"), ["date", "headline", "id", "month"]),
                             ("c", F.col("month") >= "1995-01", ["id", "date", "headline", "crime_types", "month"])):
        (rows.where(part).select(*cols).repartition(files).write.option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{out}/{name}"))
    paths = [p for name in "abc" for p in FI.list_files(spark, f"{out}/{name}", ".csv")]
    return FI.read_monthly_csvs(spark, paths).select("id", "date", "headline", "crime_types", "month")


@register("monthly_known", "WITH " + SQL_MONTHLY + """
SELECT o_orderkey, crime_types FROM m WHERE trim(upper(crime_types)) <> 'UNKNOWN'""")
def q_monthly_known(spark, d):
    """F11/S19 on text labels with blanks and other case."""
    o = B.table(spark, d, "orders")
    types = F.when(F.col("o_orderstatus") == "F", " unknown ").when(F.col("o_orderstatus") == "O", "THEFT").otherwise("FRAUD, THEFT")
    rows = o.select("o_orderkey", types.alias("crime_types"))
    return rows.where(SU.not_unknown(F.col("crime_types")))


@register("first_of_wide", "SELECT " + ", ".join(f"l_orderkey + {k} AS c{k}" for k in range(24)) + " FROM lineitem")
def q_first_of_wide(spark, d):
    """P3 on 30 columns: the first 24 stay."""
    li = B.table(spark, d, "lineitem")
    return C.first_columns(li.select(*[(F.col("l_orderkey") + k).alias(f"c{k}") for k in range(30)]), 24)


@register("coerce_text_numbers", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN round(value, 2) ELSE NULL END AS tone,
       CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS london_mentions FROM events""")
def q_coerce_text_numbers(spark, d):
    """X5 on text with bad values: numbers stay, everything else is null."""
    ev = B.table(spark, d, "events")
    k = F.col("event_id") % 5
    tone = (F.when(k == 0, F.col("value").cast("string")).when(k == 1, F.concat(F.lit(" "), F.round("value", 2).cast("string")))
            .when(k == 2, F.lit("abc")).when(k == 3, F.lit("")).otherwise(F.lit("1d")))
    num = F.when(k == 4, F.lit("n/a")).otherwise(F.col("user_id").cast("string"))
    return ev.select("event_id", X.parse_number(tone).alias("tone"), X.parse_number(num).alias("london_mentions"))


@register("headline_summary_sorted", "SELECT * FROM (" + QUERIES["headline_summary"][1] + ") ORDER BY Month, Rank_Month NULLS LAST, count_day DESC")
def q_headline_summary_sorted(spark, d):
    """O1 over the flagship's rows."""
    return SU.sort_summary(QUERIES["headline_summary"][0](spark, d))


from . import catalog_files, catalog_incremental  # noqa: E402, F401
