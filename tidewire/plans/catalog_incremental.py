"""Registered queries of the range cache, the commit records, zipped drops, streams over several
deltas, and dictionaries of full size.  Imported by :mod:`.catalog` after its own queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import automaton as AU
from ..functions import terms as TM
from ..operators import filters as FL
from ..operators import ranges as R
from ..sources import gkg as GK
from ..sources import landing as LA
from ..sources import zip_source as Z
from ..streaming import history as HI
from ..streaming import ingest as STR
from . import bindings as B
from . import oracle as O
from . import range_cache as RC
from .catalog import LOCS, SITES, SQL_DROPS, SQL_LOC_COUNT, SQL_RECORDS, SQL_THEME_COUNT, THEME_RE, THEMES, _sql_in, register, scratch

# ------------------------------------------------------- ranges
SQL_RANGES = """
ranges AS (SELECT o_custkey AS owner, o_orderdate AS "start", o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) - INTERVAL 1 SECOND AS "end" FROM orders WHERE o_orderkey % 40 > 0),
edges AS (SELECT owner, "start" AS t, 1 AS d FROM ranges UNION ALL SELECT owner, "end" + INTERVAL 1 SECOND, -1 FROM ranges),
depth AS (SELECT owner, t, sum(sum(d)) OVER (PARTITION BY owner ORDER BY t) AS open, sum(d) AS d FROM edges GROUP BY owner, t),
turns AS (SELECT owner, t, open, lag(open, 1, 0) OVER (PARTITION BY owner ORDER BY t) AS before FROM depth),
ups AS (SELECT owner, t, row_number() OVER (PARTITION BY owner ORDER BY t) AS k FROM turns WHERE before = 0 AND open > 0),
downs AS (SELECT owner, t, row_number() OVER (PARTITION BY owner ORDER BY t) AS k FROM turns WHERE before > 0 AND open = 0),
islands AS (SELECT u.owner, u.t AS "start", v.t - INTERVAL 1 SECOND AS "end" FROM ups u JOIN downs v ON v.owner = u.owner AND v.k = u.k)"""
WANT = (dt.datetime(1996, 3, 15), dt.datetime(1998, 2, 10, 23, 59, 59))


def order_ranges(spark, d):
    """One range per order, up to 39 days long: nested, overlapping, touching and disjoint ones per customer."""
    o = B.table(spark, d, "orders").where("o_orderkey % 40 > 0")
    end = F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 40).cast("int")) - F.expr("INTERVAL 1 SECOND")
    return o.select(F.col("o_custkey").alias("owner"), F.col("o_orderdate").cast("timestamp_ntz").alias("start"), end.cast("timestamp_ntz").alias("end"))


@register("merged_ranges", "WITH " + SQL_RANGES + """
SELECT i.owner, i."start", i."end", (SELECT count(*) FROM ranges r WHERE r.owner = i.owner AND r."start" BETWEEN i."start" AND i."end") AS ranges FROM islands i""")
def q_merged_ranges(spark, d):
    """Each customer's ranges as islands."""
    return R.merge_ranges(order_ranges(spark, d), ["owner"])


@register("uncovered_ranges", "WITH " + SQL_RANGES + f""",
want AS (SELECT DISTINCT o_custkey AS owner, TIMESTAMP '{WANT[0]}' AS lo, TIMESTAMP '{WANT[1]}' AS hi FROM orders),
inside AS (SELECT w.owner, i."start", i."end" FROM want w JOIN islands i ON i.owner = w.owner AND i."end" >= w.lo AND i."start" <= w.hi),
begins AS (SELECT owner, lo AS b FROM want UNION SELECT i.owner, i."end" + INTERVAL 1 SECOND FROM inside i JOIN want w USING (owner) WHERE i."end" < w.hi),
free AS (SELECT b.owner, b.b FROM begins b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.owner = b.owner AND b.b BETWEEN i."start" AND i."end"))
SELECT f.owner, f.b AS "start", coalesce((SELECT min(i."start") FROM inside i WHERE i.owner = f.owner AND i."start" > f.b) - INTERVAL 1 SECOND, w.hi) AS "end" FROM free f JOIN want w USING (owner)""")
def q_uncovered_ranges(spark, d):
    """What each customer's ranges leave of two years."""
    ranges = order_ranges(spark, d)
    asked = B.table(spark, d, "orders").select(F.col("o_custkey").alias("owner")).distinct()
    asked = asked.select("owner", F.lit(WANT[0]).cast("timestamp_ntz").alias("start"), F.lit(WANT[1]).cast("timestamp_ntz").alias("end"))
    return R.uncovered(asked, R.merge_ranges(ranges, ["owner"]), ["owner"])


#: Cached before the request comes: two nested ranges, one that touches the first, one apart, one past the request's start.
CACHED = [(dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 4, 23, 59, 59)), (dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 4, 11, 59, 59)),
          (dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5, 23, 59, 59)), (dt.datetime(2024, 1, 7), dt.datetime(2024, 1, 8, 6, 0, 0)),
          (dt.datetime(2023, 12, 1), dt.datetime(2024, 1, 1, 12, 0, 0))]
ASKED = (dt.datetime(2024, 1, 1), dt.datetime(2034, 12, 31, 23, 59, 59))
SQL_LABEL = " ".join(f"WHEN date BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}' THEN 'cached {k}'" for k, (a, b) in enumerate(CACHED))


@register("range_cache_filter", "WITH " + SQL_RECORDS + f"""
SELECT GKGRECORDID, date, CASE {SQL_LABEL} ELSE 'new' END AS filtered_by FROM records
WHERE date BETWEEN TIMESTAMP '{ASKED[0]}' AND TIMESTAMP '{ASKED[1]}' AND lower(V2SOURCECOMMONNAME) IN ({_sql_in(s.lower() for s in SITES)})
  AND coalesce(regexp_matches(V2ENHANCEDTHEMES, {O.lit(THEME_RE)}), false) AND {SQL_LOC_COUNT} >= 2 AND {SQL_THEME_COUNT} >= 2""")
def q_range_cache_filter(spark, d):
    """J9 + A13 + U3: the whole clock asked for when five ranges are cached.  Rows say which run filtered
    them, so a cached range that is filtered again, or a gap that isn't, shows."""
    cache, recs = scratch(spark, "range-cache"), B.records(spark, d)

    def keep(label, lo, hi):
        return lambda df: FL.filter_articles(df, lo, hi, SITES, THEMES, LOCS).select(S.RID, S.DATE, F.lit(label).alias("filtered_by"))

    for k, (a, b) in enumerate(CACHED):
        RC.save_range(keep(f"cached {k}", a, b)(recs.where(F.col(S.DATE).between(F.lit(a), F.lit(b)))), cache, a, b)
    got = RC.filter_range(recs, cache, *ASKED, keep("new", *ASKED))
    again = RC.filter_range(recs, cache, *ASKED, keep("again", *ASKED))  # covered now: read only
    assert again.where("filtered_by = 'again'").isEmpty()
    return got


# ------------------------------------------- drops: commit records, zips
@register("ingest_commit", "WITH " + SQL_DROPS + " SELECT * FROM lines")
def q_ingest_commit(spark, d):
    """Zipped drops landed by several runs, of which one dies before it is published, one is
    repeated and one lands drops that another has published too; each row counts once."""
    base = scratch(spark, "commit")
    lines = B.drop_lines(spark, d)
    zips = B.write_zip_drops(lines, f"{base}/zips")
    bounds = lines.agg(F.min(F.substring("value", 1, 14)), F.max(F.substring("value", 1, 14))).first()
    lo, mid, hi = (dt.datetime.strptime(s, "%Y%m%d%H%M%S") for s in (bounds[0], f"{bounds[0][:6]}10000000", bounds[1]))
    recs = GK.read_drops(spark, zips)
    lost, twice = LA.new_run(), LA.new_run()
    LA.write_run(recs.where(F.col(S.DATE) < F.lit(mid)), f"{base}/landed", lost)  # its driver dies here
    GK.ingest_missing(spark, zips, f"{base}/landed", lo, mid)
    LA.write_run(recs.where(F.col(S.DATE) < F.lit(mid)), f"{base}/landed", twice)
    LA.publish(spark, f"{base}/landed", twice)
    GK.ingest_missing(spark, zips, f"{base}/landed", lo, hi)
    assert GK.ingest_missing(spark, zips, f"{base}/landed", lo, hi) == []
    return GK.scan_range(spark, f"{base}/landed", lo, hi).drop("day")


@register("zip_source_ingest", "WITH " + SQL_DROPS + """
SELECT GKGRECORDID, V2SOURCECOMMONNAME, "V1.5TONE", date, count(*) AS n_batch, count(*) AS n_stream FROM lines GROUP BY ALL""")
def q_zip_source_ingest(spark, d):
    """Zipped drops through the data source, read as a table and as a stream that is stopped,
    given more drops and started again."""
    base = scratch(spark, "zip-source")
    lines = B.drop_lines(spark, d).withColumn("late", F.substring("value", 7, 2) > "15")
    zips = B.write_zip_drops(lines.where("NOT late"), f"{base}/zips")

    def drain():
        q = (Z.stream_zipped(spark, zips).writeStream.format("parquet").option("path", f"{base}/stream")
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()

    drain()
    B.write_zip_drops(lines.where("late"), zips)
    drain()
    cols = [S.RID, S.SOURCE, "`V1.5TONE`", S.DATE]
    both = Z.read_zipped(spark, zips).select(*cols, F.lit(1).alias("b"), F.lit(0).alias("s")).union(spark.read.parquet(f"{base}/stream").select(*cols, F.lit(0), F.lit(1)))
    return both.groupBy(*cols).agg(F.sum("b").alias("n_batch"), F.sum("s").alias("n_stream"))


# ------------------------------------------------ streams over two deltas
@register("stream_history_dedup", "WITH " + SQL_DROPS + r"""
SELECT GKGRECORDID, V2SOURCECOMMONNAME, date FROM lines
UNION ALL SELECT GKGRECORDID || '-b', 'late.example.com', date FROM lines WHERE CAST(split_part(GKGRECORDID, '-', 2) AS BIGINT) % 3 = 1""")
def q_stream_history_dedup(spark, d):
    """T5: a second delta repeats a third of the ids long after, with other payload, and brings new ones; the
    stream has been stopped in between."""
    base = scratch(spark, "history")
    lines = B.drop_lines(spark, d)
    number = F.split(F.split("value", "\t")[0], "-")[1].cast("long") % 3
    lines.write.mode("append").text(f"{base}/drops")
    land = lambda: HI.land_deduped(STR.drop_stream(spark, f"{base}/drops"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    land()
    again = B.relabelled(lines.where(number == 0), "", "late.example.com").union(B.relabelled(lines.where(number == 1), "-b", "late.example.com"))
    again.write.mode("append").text(f"{base}/drops")
    land()
    return spark.read.parquet(f"{base}/out").select(S.RID, S.SOURCE, S.DATE)


@register("stream_daily_tone", "WITH " + SQL_DROPS + """,
rows AS (SELECT date, CAST(split_part("V1.5TONE", ',', 1) AS DOUBLE) AS tone FROM lines),
cut AS (SELECT date_trunc('day', max(date)) - INTERVAL 10 DAY AS c FROM rows),
one AS (SELECT date, tone FROM rows, cut WHERE date < c),
two AS (SELECT date, tone FROM rows, cut WHERE date >= c
        UNION ALL SELECT date, tone FROM rows, cut WHERE date >= c - INTERVAL 6 HOUR AND date < c
        UNION ALL SELECT date, tone FROM rows, cut WHERE date >= c - INTERVAL 6 DAY AND date < c - INTERVAL 5 DAY),
marks AS (SELECT (SELECT max(date) FROM one) - INTERVAL 1 DAY AS w1, (SELECT max(date) FROM rows) - INTERVAL 1 DAY AS w2),
seen AS (SELECT * FROM one UNION ALL SELECT date, tone FROM two, marks WHERE date_trunc('day', date) + INTERVAL 1 DAY > w1)
SELECT CAST(date_trunc('day', date) AS DATE) AS Date, avg(tone) AS Tone, count(*) AS records FROM seen, marks
GROUP BY 1, w2 HAVING date_trunc('day', min(date)) + INTERVAL 1 DAY <= w2""")
def q_stream_daily_tone(spark, d):
    """T4 + T6: two deltas with a stop between them; the second brings rows that are six hours late, which count,
    and rows that are five days late, whose days are closed."""
    base = scratch(spark, "tone-stream")
    lines = B.drop_lines(spark, d).withColumn("t", F.to_timestamp_ntz(F.substring("value", 1, 14), F.lit("yyyyMMddHHmmss")))
    cut = F.date_trunc("day", F.lit(lines.agg(F.max("t")).first()[0])).cast("timestamp_ntz") - F.expr("INTERVAL 10 DAY")
    back = lambda days, hours=0: cut - F.make_dt_interval(days=F.lit(days), hours=F.lit(hours))
    one, two = lines.where(F.col("t") < cut), lines.where(F.col("t") >= cut)
    late = lines.where((F.col("t") >= back(0, 6)) & (F.col("t") < cut)).union(lines.where((F.col("t") >= back(6)) & (F.col("t") < back(5))))

    def drain():
        q = (STR.daily_tone_stream(STR.drop_stream(spark, f"{base}/drops")).writeStream.format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()

    one.select("value").write.mode("append").text(f"{base}/drops")
    drain()
    two.union(late).select("value").write.mode("append").text(f"{base}/drops")
    drain()
    return spark.read.parquet(f"{base}/out")


# --------------------------------------- dictionaries of full size
#: Entries of the reference's place list and of its pattern table.
PLACES, PATTERNS = 282, 335
IRREGULAR = {"seven": r"que(lle|ment)", "eight": "in{2}g", "nine": "[aeiou]{3}n", "ten": "t(o|a)ti", "eleven": "st.{2}lich", "zero": "(ver|ge)ein", "one": "e+de"}
NUMBERS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven"]


def ranked_words(docs, pattern, most):
    """The ``most`` most frequent matches of a pattern in the upper-cased texts: a dictionary from the table itself."""
    words = docs.select(F.explode(F.regexp_extract_all(F.upper("text"), F.lit(pattern), F.lit(0))).alias("w"))
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "w").limit(most)
    return [r.w for r in top.orderBy(F.col("n").desc(), "w").collect()]


def _sql_ranked(pattern, most):
    words = f"SELECT unnest(regexp_extract_all({O.upper('text')}, '{pattern}')) AS w FROM documents"
    return f"SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS k FROM ({words}) GROUP BY w ORDER BY k LIMIT {most}"


#: Runs of word characters between marks, so that a marked entry is found where its words are whole.
SQL_MARKED = r"regexp_replace({}, '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g')"
SQL_TERMS = f"""single AS ({_sql_ranked('[A-Z]{4,}', PLACES - 82)}), pairs AS ({_sql_ranked('[A-Z]{3,} [A-Z]{3,}', 82)}),
terms AS (SELECT w FROM single UNION ALL SELECT w FROM pairs)"""


@register("location_mentions_dictionary", f"""WITH {SQL_TERMS},
marked AS (SELECT {SQL_MARKED.format('w')} AS m FROM terms),
texts AS (SELECT doc_id, {SQL_MARKED.format(O.upper("coalesce(text, '')"))} AS t FROM documents)
SELECT doc_id, CAST(sum((len(t) - len(replace(t, m, ''))) // len(m)) AS BIGINT) AS mentions FROM texts, marked GROUP BY doc_id""")
def q_location_mentions_dictionary(spark, d):
    """F5 with 282 entries, one word or two, by one automaton."""
    docs = B.table(spark, d, "documents")
    terms = ranked_words(docs, "[A-Z]{4,}", PLACES - 82) + ranked_words(docs, "[A-Z]{3,} [A-Z]{3,}", 82)
    return docs.select("doc_id", AU.count_terms(F.upper("text"), TM.word_terms(terms)).alias("mentions"))


SQL_PATTERNS = f"words AS ({_sql_ranked('[A-Z]{5,}', PATTERNS - len(IRREGULAR))}), pats AS (SELECT lower(w) AS p, (k - 1) % {len(NUMBERS)} AS c, k % 2 = 0 AS whole FROM words)"
SQL_CASES = "\n".join(f"CASE WHEN bool_or(c = {i} AND hit)" + (f" OR any_value(regexp_matches(low, '{IRREGULAR[n]}'))" if n in IRREGULAR else "") + f" THEN '{n}' END," for i, n in enumerate(NUMBERS))


@register("classify_dictionary", f"""WITH {SQL_PATTERNS},
texts AS (SELECT doc_id, lower(text) AS low, {SQL_MARKED.format("lower(coalesce(text, ''))")} AS t FROM documents),
hits AS (SELECT doc_id, low, c, CASE WHEN whole THEN contains(t, chr(1) || p || chr(2)) ELSE contains(low, p) END AS hit FROM texts, pats)
SELECT doc_id, coalesce(nullif(concat_ws(', ', {SQL_CASES.rstrip(',')}), ''), 'UNKNOWN') AS crime_types FROM hits GROUP BY doc_id""")
def q_classify_dictionary(spark, d):
    """X15 with 335 patterns in twelve categories: whole words, substrings and seven true regexes."""
    docs = B.table(spark, d, "documents")
    words = [w.lower() for w in ranked_words(docs, "[A-Z]{5,}", PATTERNS - len(IRREGULAR))]
    cats = {n: [rf"\b{w}\b" if k % 2 else w for k, w in enumerate(words) if k % len(NUMBERS) == i] + ([IRREGULAR[n]] if n in IRREGULAR else []) for i, n in enumerate(NUMBERS)}
    return docs.select("doc_id", F.array_join(AU.classify(F.col("text"), cats), ", ").alias("crime_types"))
