"""Spelling variant grouping (operator 13): words one edit apart by pivotal grams.

1. Words: maximal runs of Latin letters, A-Z lowered; of some occurrences one letter is
   deleted (see ``variant``).  Each task counts its own words, and only (word, count) rows are
   shuffled.  ``MIN_LENGTH`` and ``MIN_COUNT`` choose the words to group.
2. Bigrams have one global order: the number of words that hold them, then their letters.  The
   alphabet has 90 letters, so the order has at most 8,100 rows, whatever the corpus.
3. A word's prefix holds its rarest ``Q * TAU + 1`` bigrams, and every other as rare as the last.
   Dynamic programming chooses ``TAU + 1`` of them that don't overlap and are rarest in total: the pivots.
   One edit spoils at most one of two disjoint bigrams, so of two near words, the one whose
   prefix ends earlier in the order has a pivot that lies in the other's prefix.
4. Position limits: a pivot of a word of n letters at place p is found at p in words of n
   letters, at p or p + 1 in words of n + 1, at p or p - 1 in words of n - 1.  These are
   equality keys of one join, whose rows are verified by the exact distance.
5. A word's form is its most frequent near word, where that is at least ``RATIO`` times as frequent;
   roots follow the forms by pointer doubling (frequencies grow fivefold a step, so chains are short).

A word has a bounded number of near words (letters of the alphabet times places), so no group
grows with the corpus.

Nulls: a null text has no words; a null doc_id counts as an empty one.  Repeated rows count
again.  Texts without such words and empty tables give no rows.  Ties of frequency go to the
smallest word in code-point order.  Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import bounded_batches, documents, id_text
from tidewire.session import dematerialize, materialize

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Length of a gram and edits between near words.
Q, TAU = 2, 1
#: Of the occurrences, by hash, one in so many is misspelt.
EVERY = 199
#: Words that one task counts before it hands its counts on.
HELD_WORDS = 200_000
LOWER = {c: c + 32 for c in range(65, 91)}
RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % MIN_LENGTH)


def variant(low: str, head: int) -> str:
    """The lowered run as it is counted; ``head``: crc32 of '<doc_id>:'."""
    h = zlib.crc32(low.encode(), head)
    if h % EVERY:
        return low
    at = h % len(low)
    return low[:at] + low[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of MIN_LENGTH letters or more."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if text is None:
                    continue
                head = zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(RUN.findall(text)).items():
                    word = variant(run.lower() if run.isascii() else run.translate(LOWER), head)
                    if len(word) >= MIN_LENGTH:
                        total[word] += n
            if len(total) > HELD_WORDS:
                yield pd.DataFrame(total.items(), columns=["word", "n"])
                total.clear()
        yield pd.DataFrame(total.items(), columns=["word", "n"])

    rows = id_text(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bigrams(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - Q + 1), lambda p: F.substring(word, p, F.lit(Q)))


def gram_order(words: DataFrame) -> dict[str, int]:
    """Rank of each bigram, rarest first: at most 8,100 entries."""
    held = words.select(F.explode(F.array_distinct(bigrams(F.col("word")))).alias("gram")).groupBy("gram").count()
    ordered = sorted((n, g) for g, n in held.toPandas().itertuples(index=False))
    return {g: k for k, (_, g) in enumerate(ordered)}


def prefix_of(ranks: list[int]) -> list[int]:
    """Places of the grams of the prefix, ascending."""
    last = sorted(ranks)[min(Q * TAU, len(ranks) - 1)]
    return [p for p, r in enumerate(ranks) if r <= last]


def pivots_of(places: list[int], ranks: list[int]) -> list[int]:
    """TAU + 1 places, each at least Q after the one before, of the least total rank.
    ``best[k]``: (cost, places) of the best k grams among the places that end before the next."""
    best: list[list[tuple]] = []  # one row per place: best choices that end there or earlier
    for j, p in enumerate(places):
        before = next((best[i] for i in range(j - 1, -1, -1) if places[i] + Q <= p), [(0, ())])
        row = list(best[j - 1]) if j else [(0, ())]
        for k, (cost, chosen) in enumerate(before[: TAU + 1]):
            new = (cost + ranks[p], (*chosen, p))
            if k + 1 >= len(row):
                row.append(new)
            elif new < row[k + 1]:
                row[k + 1] = new
        best.append(row)
    return list(best[-1][TAU + 1][1])


def gram_keys(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """(word, last, pivot, rank, place, length): the grams of each word's prefix, and its pivots
    under every place and length at which a near word may hold them."""
    shared = words.sparkSession.sparkContext.broadcast(order)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = shared.value
        for pdf in batches:
            rows = []
            for w in pdf["word"]:
                n = len(w)
                ranks = [rank[w[p : p + Q]] for p in range(n - Q + 1)]
                places = prefix_of(ranks)
                last = max(ranks[p] for p in places)
                rows.extend((w, last, False, ranks[p], p, n) for p in places)
                for p in pivots_of(places, ranks):
                    for d in range(-TAU, TAU + 1):
                        lo, hi = min(0, d), max(0, d)
                        rows.extend((w, last, True, ranks[p], p + s, n + d) for s in range(lo, hi + 1))
            yield pd.DataFrame(rows, columns=["word", "last", "pivot", "rank", "place", "length"])

    return words.select("word").mapInPandas(keys, "word string, last int, pivot boolean, rank int, place int, length int")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near) in both directions, of all words exactly one edit apart."""
    keys = materialize(gram_keys(words, gram_order(words)), "gram-keys")
    on = ["rank", "place", "length"]
    a = keys.where("pivot").select(*on, F.col("word").alias("a"), F.col("last").alias("a_last"))
    b = keys.where("NOT pivot").select(*on, F.col("word").alias("b"), F.col("last").alias("b_last"))
    met = a.join(b, on).where("a_last <= b_last AND a <> b").where(F.levenshtein("a", "b", TAU) == TAU)
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    out = materialize(pairs, "near-pairs")
    dematerialize(keys)
    return out.select(F.col("a").alias("word"), F.col("b").alias("near")).union(out.select("b", "a"))


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every row of (word, form): the end of its chain of forms."""
    hops = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        nxt = hops.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        out = materialize(hops.join(nxt, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        moved = not out.where("moved").isEmpty()
        dematerialize(hops)
        if not moved:
            return out.select("word", "root")
        hops = out.select("word", "root")
        hops._materialized_at = out._materialized_at


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` that is long and frequent enough."""
    words = materialize(word_counts(docs).where(F.col("n") >= MIN_COUNT), "spelling-words")
    near = near_pairs(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    top = near.groupBy("word").agg(F.count("*").alias("n_near"), F.max("near_n").alias("near_n"))
    top = top.join(words, "word").withColumn("far", F.col("near_n") >= RATIO * F.col("n"))
    chosen = near.join(top.where("far").select("word", "near_n"), ["word", "near_n"]).groupBy("word", "near_n").agg(F.min("near").alias("form"))
    forms = materialize(chosen.select("word", "form", F.col("near_n").alias("form_n")), "spelling-forms")
    out = words.join(top.select("word", "n_near"), "word", "left").join(forms, "word", "left").join(with_roots(forms), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every word of the corpus, its near words, form and root."""
    return variants(documents(spark, sf_dir))
