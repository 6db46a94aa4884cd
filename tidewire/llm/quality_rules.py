"""Quality rules (operator 2): risk-controlled thresholds, in DataFrame functions.

Each text has five defect rates (per mille): symbols, capitals and exclamation marks
among the characters of words, repeated words among words, and repeated lines among lines.
A rate is compared with a cutoff of its stratum (the language).  The cutoffs come from
labelled documents (quality 1 is good):

* even ids certify.  A cutoff is certified where the exact binomial test refutes a false
  rejection rate of ALPHA / 5 or more: P(Bin(n, ALPHA / 5) <= good documents
  rejected) <= DELTA / tests.  Cutoffs are tested in a fixed sequence from the strictest
  down, so a test is a (stratum, rate) pair, and Bonferroni's correction divides by their
  number.  With probability 1 - DELTA, no stratum loses more than ALPHA of its good documents.
* odd ids choose.  Of the certified cutoffs, the highest that still rejects ``YIELD`` of the
  bad documents that the best one rejects; a rate that rejects none gets no cutoff.

Nulls: a null text has no words and fails the base rule; a null language is a stratum of
its own; labels with a null doc_id or quality teach nothing.  Empty tables certify nothing.
Repeated rows each count and give a row each.  Extra columns are kept by ``filter_documents`` and
ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import SPACES, documents, split_words
from tidewire.session import materialize

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
ALPHA, DELTA, YIELD = 0.05, 0.05, 0.9
#: Width of a step of the cutoff grid, per mille.
STEP = 20
RATES = ("symbols", "capitals", "exclaims", "repeats", "dup_lines")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeated_words(w: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more in the array ``w``."""
    n = F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))
    hashes = F.transform(F.arrays_zip(*(F.slice(w, k + 1, n).alias(f"w{k}") for k in range(WINDOW))), lambda z: F.xxhash64(z))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("at")))
        return F.transform(F.array(placed), lambda s: _cover(F.sort_array(F.transform(
            F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])), lambda x: x["at"]))))[0]

    def _cover(at: Column) -> Column:
        return F.transform(F.array(at), lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))[0]

    return F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))[0].cast("long")


def with_signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Struct column ``_q`` with the counts of each row's text, beside the row itself."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda s: F.length(F.translate(s, SPACES, "")) > 0)
    words = F.transform(F.array(split_words(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))[0]
    dup = F.transform(F.array(lines), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))[0]
    count = lambda chars: (F.length(text) - _without(text, chars)).cast("long")
    return docs.withColumns({"_w": words, "_l": dup}).withColumn("_q", F.struct(
        "_w.n_words", _without(text, SPACES).cast("long").alias("word_chars"), count(SYMBOLS).alias("n_symbols"), "_l.n_dup_lines", "_w.n_repeat_words",
        "_l.n_lines", count(CAPITALS).alias("n_capitals"), count("!").alias("n_exclaims"))).drop("_w", "_l")


def base_failed(q: str = "_q.") -> Column:
    return (F.col(f"{q}n_words") < LEAST_WORDS) | (100 * F.col(f"{q}n_repeat_words") > MOST_REPEATED * F.col(f"{q}n_words"))


def rates(q: str = "_q.") -> dict[str, Column]:
    """Steps of the grid that each rate has reached (0: less than one step)."""
    part = lambda n, of: F.expr(f"coalesce(1000 * {q}{n} div {q}{of}, 0) div {STEP}").cast("int")
    return dict(zip(RATES, (part("n_symbols", "word_chars"), part("n_capitals", "word_chars"), part("n_exclaims", "word_chars"),
                            part("n_repeat_words", "n_words"), part("n_dup_lines", "n_lines")), strict=True))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k): terms by their ratio, summed in logarithms."""
    odds = p / (1 - p)
    start = F.struct((n * F.log1p(F.lit(-p))).alias("term"), (n * F.log1p(F.lit(-p))).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * F.lit(odds))
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["total"] - top) + F.exp(term - top))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n, F.lit(1.0)).otherwise(F.aggregate(steps, start, add, lambda acc: F.exp(acc["total"])))


def cutoffs(signals: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a stratum: the certified and chosen cutoff of each rate (null: none).
    ``signals``: doc_id, stratum, _q."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    one = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    lab = signals.where(~base_failed()).select("doc_id", "stratum", F.array(*(F.struct(F.lit(k).alias("rate"), v.alias("step")) for k, v in rates().items())).alias("r")).join(one, "doc_id")
    hist = materialize(lab.select("doc_id", "stratum", "quality", F.inline("r")).groupBy("stratum", "rate", "step").agg(
        F.sum(F.expr("CAST(quality = 1 AND doc_id % 2 = 0 AS BIGINT)")).alias("good"), F.sum(F.expr("CAST(quality = 0 AND doc_id % 2 <> 0 AS BIGINT)")).alias("bad")), "quality-histogram")
    pair = Window.partitionBy("stratum", "rate")
    down = pair.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    tested = hist.select("stratum", "rate", "step", F.sum("good").over(pair).alias("n"), F.sum("good").over(down).alias("k"), F.sum("bad").over(down).alias("caught")).where("step > 0")
    tests = max(1, hist.select("stratum", "rate").distinct().count())
    sure = tested.where(binomial_tail(F.col("k"), F.col("n"), ALPHA / len(RATES)) <= DELTA / tests)
    best = sure.withColumn("most", F.max("caught").over(pair)).where((F.col("caught") > 0) & (F.col("caught") >= YIELD * F.col("most")))
    chosen = best.groupBy("stratum", "rate").agg(F.max("step").alias("cut"))
    return chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rate") == k, F.col("cut"))).alias(f"_cut_{k}") for k in RATES))


def verdict() -> Column:
    """Kept: passes the base rule and no rate reaches its cutoff."""
    over = [F.coalesce(v >= F.col(f"_cut_{k}"), F.lit(False)) for k, v in rates().items()]
    return ~(base_failed() | over[0] | over[1] | over[2] | over[3] | over[4])


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, the signals, base_failed and kept of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).cast("string").alias("text"))
    signals = materialize(with_signals(rows).drop("text"), "quality-signals")
    cuts = materialize(cutoffs(signals, labels), "quality-cutoffs")
    return signals.join(cuts, "stratum", "left").select("doc_id", "stratum", "_q.*", base_failed().alias("base_failed"), verdict().alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.  The cutoffs are fitted
    first; then each text is judged where it lies, so no text is shuffled."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col("text").cast("string").alias("text"))
    signals = materialize(with_signals(rows.drop("_row")).drop("text"), "quality-signals")
    cuts = materialize(cutoffs(signals, labels), "quality-cutoffs")
    return with_signals(rows).join(cuts, "stratum", "left").where(verdict()).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: signals and verdict of every text of ``documents``."""
    out = judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WS = r"[ \t\n\x0B\f\r]"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '{_WS}+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM d),
grams AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM w, unnest(range(1, len(ws) - {WINDOW - 2})) AS t(i)),
twice AS (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM grams JOIN twice USING (r, g), range(0, {WINDOW}) AS o(k) GROUP BY r),
q AS (SELECT w.r, doc_id, stratum, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '{_WS}', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(text) - length(translate(text, '{CAPITALS}', '')) AS n_capitals,
             length(text) - length(replace(text, '!', '')) AS n_exclaims FROM w LEFT JOIN rep USING (r)),
s AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
             [coalesce(1000 * n_symbols // nullif(word_chars, 0), 0) // {STEP}, coalesce(1000 * n_capitals // nullif(word_chars, 0), 0) // {STEP},
              coalesce(1000 * n_exclaims // nullif(word_chars, 0), 0) // {STEP}, coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) // {STEP},
              coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) // {STEP}] AS steps FROM q),
one AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
hist AS (SELECT stratum, rate, steps[rate] AS step, count(*) FILTER (quality = 1 AND doc_id % 2 = 0) AS good, count(*) FILTER (quality = 0 AND doc_id % 2 <> 0) AS bad
         FROM s JOIN one USING (doc_id), range(1, 6) AS o(rate) WHERE NOT base_failed GROUP BY ALL),
tested AS (SELECT *, sum(good) OVER (PARTITION BY stratum, rate)::BIGINT AS n, sum(good) OVER z::BIGINT AS k, sum(bad) OVER z::BIGINT AS caught FROM hist
           WINDOW z AS (PARTITION BY stratum, rate ORDER BY step DESC ROWS UNBOUNDED PRECEDING)),
sure AS (SELECT *, max(caught) OVER (PARTITION BY stratum, rate) AS most FROM tested WHERE step > 0 AND
         CASE WHEN k >= n THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA / len(RATES)}) + (n - i) * ln(1 - {ALPHA / len(RATES)})))) END
         <= {DELTA} / (SELECT count(*) FROM (SELECT DISTINCT stratum, rate FROM hist))),
cut AS (SELECT stratum, rate, max(step) AS cut FROM sure WHERE caught > 0 AND caught >= {YIELD} * most GROUP BY ALL),
bad AS (SELECT DISTINCT r FROM s JOIN cut USING (stratum) WHERE s.steps[cut.rate] >= cut.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept FROM s LEFT JOIN bad USING (r)
"""
