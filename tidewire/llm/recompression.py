"""Substring dedup (operator 11): long repeats of words by recompression.

A window is ``WINDOW`` consecutive words of one document.  Words covered by a window whose word
sequence also starts anywhere else, in the same document or another, go.

1. Recompression: in each of ``ROUNDS`` rounds first every run of one symbol, then every pair of
   a left and a right symbol (the symbol's hash says which it is in this round) becomes one
   symbol.  A symbol's name is the digest of what it stands for, so all tasks give the same run or pair the
   same name without an exchange.  Each symbol also carries the range of words that its
   forming depended on (``reach``): where that range is equal, the symbol is too.
2. Anchors: of the symbols whose reach lies inside a window, the one of the highest round and
   then of the least name is the window's anchor.  Equal windows hold equal symbols inside, so they have equal
   anchors at equal places.  Neighbouring windows mostly share theirs; a run of them is one
   posting: (symbol, context).  The symbol's key takes along the half window before or after the anchor, whichever
   lies in all windows of the run; the context is a digest of all words that the run covers.
3. Symbols that occur once are dropped.  Postings equal in symbol and context are repeats, each one of
   all its windows.
4. What is left are symbols with several contexts, at the edges of repeats: one posting of each context is
   looked at window by window, and equal windows are counted.  So a passage that a third of the
   documents share costs one posting per anchor and document, and pairs are never formed.

The result is exact but for clashes of 128-bit digests.  Texts of more than ``PIECE`` words are parsed in pieces
that overlap by a window; a piece's edge is outside every reach, so results don't depend on the cut.

Nulls: a null text has no words; null doc_ids are told apart by their texts.  Texts shorter than a window lose
nothing.  Repeated rows are documents of their own: with a window's length they go entirely.  Empty tables give
no rows; other columns are ignored (``without_repeats`` keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import bounded_batches, documents, id_text, mix, sealed, split_words, unsealed
from tidewire.session import dematerialize, materialize

WINDOW, ROUNDS = 35, 3
#: Words of a piece of a text, and about as many are parsed at once.
PIECE = 150_000
#: Word hashes that a task remembers.
KNOWN_WORDS = 500_000

U = np.uint64
BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))


class WordNames:
    """64-bit names of words given as bytes; 0 stands for an edge and names no word."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, ws: list[bytes]) -> np.ndarray:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, ws), U, len(ws))
        except KeyError:
            for w in set(ws):
                if w not in known:
                    known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") or 1
            return np.fromiter(map(known.__getitem__, ws), U, len(ws))


def split(text: str | None) -> list[bytes]:
    """Words of a text: bytes.split() parts at just the six separators."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class RangeHash:
    """Digests of any ranges of an array of names, by a polynomial over 64 bits."""

    def __init__(self, names: np.ndarray, base: np.uint64):
        inverse = U(pow(int(base), -1, 1 << 64))
        powers = np.cumprod(np.concatenate(([U(1)], np.full(len(names), base, U))))
        self.back = np.cumprod(np.concatenate(([U(1)], np.full(len(names), inverse, U))))
        self.sums = np.concatenate(([U(0)], np.cumsum(names * powers[:-1])))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a])


class Level:
    """Symbols of one round, by place: name, first word, and reach [low, high) in words."""

    def __init__(self, name, start, low, high):
        self.name, self.start, self.low, self.high = name, start, low, high

    def runs(self) -> Level:
        """Every maximal run of one symbol becomes one; both neighbours decide where it ends."""
        x, edge = self.name, self.name == 0
        head = np.concatenate(([True], (x[1:] != x[:-1]) | edge[1:]))
        at = np.flatnonzero(head)
        k = np.diff(np.append(at, len(x)))
        name = np.where(k > 1, mix(x[at] * U(0xD6E8FEB86659FD93) + k.astype(U)), x[at])
        low = self.low[np.maximum(at - 1, 0)]
        high = self.high[np.minimum(at + k, len(x) - 1)]
        return Level(name, self.start[at], np.where(edge[at], self.low[at], low), np.where(edge[at], self.high[at], high))

    def pairs(self, seed: int) -> Level:
        """Every left symbol joins a right symbol after it; a symbol alone is so because of the one
        after it, if it is a left one, else because of the one before it."""
        x, edge = self.name, self.name == 0
        is_left = (mix(x ^ U(seed * 0xA0761D6478BD642F & (1 << 64) - 1)) >> U(17)) & U(1) == 1
        left, right = is_left & ~edge, ~is_left & ~edge
        joins = np.append(left[:-1] & right[1:], False)
        at = np.flatnonzero(~np.concatenate(([False], joins[:-1])))
        after, before, joined = np.minimum(at + 1, len(x) - 1), np.maximum(at - 1, 0), joins[at]
        name = np.where(joined, mix(mix(x[at]) * U(0xE7037ED1A0B428DB) + x[after]), x[at])
        low = np.where(right[at], self.low[before], self.low[at])
        high = np.where(left[at], self.high[after], self.high[at])
        return Level(name, self.start[at], low, high)


def parse(names: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    """Levels 0 (words) to ``rounds``; ``names`` begins and ends with an edge (0)."""
    at = np.arange(len(names))
    levels = [Level(names, at, at, at + 1)]
    for r in range(1, rounds + 1):
        levels.append(levels[-1].runs().pairs(r))
    return levels


def least(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each range [lo, hi), not empty, the place of its least key, the first of equals."""
    n = hi - lo
    table = [np.arange(len(keys))]
    while 1 << len(table) <= int(n.max(initial=1)):
        t, step = table[-1], 1 << (len(table) - 1)
        a, b = t[: len(t) - step], t[step:]
        table.append(np.where(keys[b] < keys[a], b, a))
    power = np.frexp(n.astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.int64)
    for k in np.unique(power).tolist():
        m = power == k
        a, b = table[k][lo[m]], table[k][hi[m] - (1 << k)]
        out[m] = np.where(keys[b] < keys[a], b, a)
    return out


def postings(names: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(symbol, context, first window, windows) of each run of windows with one anchor; ``names``: words of several
    pieces, with an edge (0) before, between and after them."""
    total = len(names)
    inside = np.concatenate(([0], np.cumsum(names == 0)))
    w = np.flatnonzero(inside[window:] == inside[: total + 1 - window]) if total >= window else np.zeros(0, np.int64)
    place, key, todo = np.empty(len(w), np.int64), np.empty(len(w), U), np.arange(len(w))
    for r, level in reversed(list(enumerate(parse(names, rounds)))):
        if not len(todo):
            break
        lo = np.concatenate(([0], np.cumsum(np.bincount(level.low, minlength=total + 1))))[w[todo]]
        hi = np.cumsum(np.bincount(level.high, minlength=total + 1))[w[todo] + window]
        has = hi > lo
        at = todo[has]
        ranked = mix(level.name + U(r))
        j = least(ranked, lo[has], hi[has])
        place[at], key[at] = level.start[j], ranked[j]
        todo = todo[~has]
    half = (window + 1) // 2
    before = place - w > window - half
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1] + 1) | (place[1:] != place[:-1]) | (key[1:] != key[:-1]) | (before[1:] != before[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(w)))
    start, p, b = w[first], place[first], before[first]
    middle = RangeHash(names, BASES[0])(np.where(b, p - half, p), np.where(b, p, p + half))
    symbol = mix(middle + key[first] * U(2) + b.astype(U))
    context = RangeHash(mix(names), BASES[1])(start, start + size + window - 1)
    return symbol, mix(context + (p - start).astype(U)), start, size


def parsed(words: list[np.ndarray], window: int = WINDOW, rounds: int = ROUNDS) -> list[list[np.ndarray]]:
    """For each document its postings' symbols, contexts, first windows and numbers of windows."""
    pieces = [(d, s, ws[s : s + PIECE + window - 1]) for d, ws in enumerate(words) for s in range(0, max(len(ws) - window + 1, 0), PIECE)]
    out: list[list] = [[] for _ in words]
    group: list = []
    held = 0
    edge = np.zeros(1, U)
    for k, piece in enumerate(pieces):
        group.append(piece)
        held += len(piece[2]) + 1
        if held < PIECE and k + 1 < len(pieces):
            continue
        symbol, context, start, size = postings(np.concatenate([edge] + [x for _, _, ws in group for x in (ws, edge)]), window, rounds)
        begins = np.cumsum([1] + [len(ws) + 1 for _, _, ws in group])
        cuts = np.searchsorted(start, begins)
        for (d, s, _), at, a, b in zip(group, begins[:-1], cuts[:-1], cuts[1:], strict=True):
            out[d].append((symbol[a:b], context[a:b], start[a:b] - at + s, size[a:b]))
        group, held = [], 0
    nothing = (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return [[np.concatenate(x) for x in zip(*(found or [nothing]), strict=True)] for found in out]


def text_key(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): rows with the same id and text share results."""
    return sealed(id_text(docs)).withColumn("h", F.xxhash64("text"))


def parsed_documents(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """(doc_id, h, n_words, whole_sha256, posts) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = WordNames()
        for pdf in batches:
            counts, shas, arrays = [], [], []
            for text in pdf["text"]:
                ws = split(text)
                counts.append(len(ws))
                shas.append(hashlib.sha256(b" ".join(ws)).hexdigest())
                arrays.append(names(ws))
            found = parsed(arrays, window, rounds)
            out = pd.DataFrame({"doc_id": pdf["doc_id"].array, "h": pdf["h"].array, "n_words": counts, "whole_sha256": shas})
            yield out.assign(symbol=[x[0].view(np.int64) for x in found], context=[x[1].view(np.int64) for x in found],
                             start=[x[2].astype(np.int32) for x in found], size=[x[3].astype(np.int32) for x in found])

    return text_key(docs).mapInPandas(run, "doc_id long, h long, n_words long, whole_sha256 string, symbol array<long>, context array<long>, start array<int>, size array<int>")


def shared_postings(made: DataFrame) -> DataFrame:
    """(doc_id, h, start, size, times, open): postings that are repeats (times > 1), and those whose symbol
    has other contexts (open: to be looked at window by window; one posting of each context)."""
    posts = made.select("doc_id", "h", F.explode(F.arrays_zip("symbol", "context", "start", "size")).alias("p")).select("doc_id", "h", "p.*")
    # written first: a join of two plain exchanges lets Spark split a symbol that many postings hold
    often = materialize(posts.groupBy("symbol").count().where("count > 1").select("symbol"), "repeat-symbols")
    shared = materialize(posts.join(often, "symbol", "left_semi"), "repeat-shared")
    me = F.xxhash64("doc_id", "h", "start")
    contexts = materialize(shared.groupBy("symbol", "context").agg(F.count("*").alias("times"), F.max(me).alias("one")), "repeat-contexts")
    several = materialize(contexts.groupBy("symbol").agg(F.count("*").alias("contexts")).where("contexts > 1"), "repeat-several")
    seen = materialize(contexts.join(several, "symbol", "left").where("times > 1 OR contexts > 1"), "repeat-seen")
    rows = shared.join(seen, ["symbol", "context"]).withColumn("open", F.col("contexts").isNotNull() & (F.col("one") == me)).where("times > 1 OR open")
    out = materialize(rows.select("doc_id", "h", "start", "size", F.least("times", F.lit(2)).cast("int").alias("times"), "open"), "repeat-postings")
    dematerialize(often, shared, contexts, several, seen)
    return out


def covered(n: int, spans) -> np.ndarray:
    """Which of n words lie in one of the spans [a, b)."""
    edges = np.zeros(n + 1, np.int64)
    for a, b in spans:
        np.add.at(edges, np.asarray(a, np.int64), 1)
        np.add.at(edges, np.asarray(b, np.int64), -1)
    return np.cumsum(edges[:-1]) > 0


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def window_hits(texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, h, hits): windows of open postings of single contexts that are equal to another window."""
    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = WordNames()
        for pdf in batches:
            for doc_id, h, text, start, size, times, is_open in pdf[["doc_id", "h", "text", "start", "size", "times", "open"]].itertuples(index=False):
                if not np.any(is_open):
                    continue
                ws = names(split(text))
                o = np.asarray(is_open, bool)
                start, size, times = start[o].astype(np.int64), size[o].astype(np.int64), times[o]
                at = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                one, two = RangeHash(ws, BASES[0])(at, at + window), RangeHash(mix(ws), BASES[1])(at, at + window)
                yield pd.DataFrame({"doc_id": doc_id, "h": h, "at": at.astype(np.int32), "w1": one.view(np.int64), "w2": two.view(np.int64), "times": np.repeat(times, size)})

    rows = materialize(texts.mapInPandas(hashes, "doc_id long, h long, at int, w1 long, w2 long, times int"), "repeat-windows")
    equal = rows.groupBy("w1", "w2").agg(F.sum("times").alias("n")).where("n > 1").select("w1", "w2")
    hits = rows.where("times = 1").join(equal, ["w1", "w2"], "left_semi")
    out = materialize(hits.groupBy("doc_id", "h").agg(F.collect_list("at").alias("hits")), "repeat-hits")
    dematerialize(rows)
    return out


def repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, h, n_words, n_removed, kept_sha256, first, last) of every row: the words [first[i], last[i]) go."""
    made = materialize(parsed_documents(docs, window, rounds), "repeat-parsed")
    marks = shared_postings(made)
    per_text = marks.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "size", "times", "open")).alias("m"))
    sizes = made.select("doc_id", "h", "n_words").dropDuplicates(["doc_id", "h"])
    listed = sizes.join(per_text, ["doc_id", "h"]).select("doc_id", "h", "n_words", *(F.col(f"m.{c}").alias(c) for c in ("start", "size", "times", "open")))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gone = []
            for n, start, size, times in pdf[["n_words", "start", "size", "times"]].itertuples(index=False):
                again = np.asarray(times) > 1
                gone.append(bool(covered(n, [(start[again], start[again].astype(np.int64) + size[again] + window - 1)]).all()))
            yield pdf.assign(whole=gone)

    kinds = "doc_id long, h long, n_words long, start array<int>, size array<int>, times array<int>, open array<boolean>"
    listed = materialize(listed.mapInPandas(whole, f"{kinds}, whole boolean"), "repeat-texts")
    wanted = listed.where(~F.col("whole") | F.array_contains("open", True))
    texts = materialize(text_key(docs).where("text IS NOT NULL").join(wanted, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]), "repeat-wanted")
    hits = window_hits(texts, window)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, h, text, start, size, times, hit in pdf[["doc_id", "h", "text", "start", "size", "times", "hits"]].itertuples(index=False):
                ws, again = split(text), np.asarray(times) > 1
                hit = np.zeros(0, np.int64) if hit is None else np.asarray(hit, np.int64)
                mask = covered(len(ws), [(start[again], start[again].astype(np.int64) + size[again] + window - 1), (hit, hit + window)])
                kept = b" ".join(w for w, go in zip(ws, mask.tolist(), strict=True) if not go)
                rows.append((doc_id, h, int(mask.sum()), hashlib.sha256(kept).hexdigest(), *spans_of(mask)))
            yield pd.DataFrame(rows, columns=["doc_id", "h", "n_removed", "kept_sha256", "first", "last"])

    part = texts.where("NOT whole").join(hits, ["doc_id", "h"], "left").mapInPandas(cut, "doc_id long, h long, n_removed long, kept_sha256 string, first array<int>, last array<int>")
    all_gone = listed.where("whole").select("doc_id", "h", F.col("n_words").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"),
                                            F.array(F.lit(0)).alias("first"), F.array(F.col("n_words").cast("int")).alias("last"))
    done = part.unionByName(all_gone)
    none = F.array().cast("array<int>")
    out = made.select("doc_id", "h", "n_words", "whole_sha256").join(done, ["doc_id", "h"], "left")
    out = out.select("doc_id", "h", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
                     F.coalesce("first", none).alias("first"), F.coalesce("last", none).alias("last"))
    result = materialize(unsealed(out), "repeats")
    dematerialize(made, marks, listed, texts, hits)
    return result


def keep_words(text: Column, first: Column, last: Column) -> Column:
    """The words outside the spans, joined by one space."""
    held = F.filter(split_words(text), lambda _, i: ~F.exists(F.arrays_zip(first.alias("a"), last.alias("b")), lambda s: (s["a"] <= i) & (i < s["b"])))
    return F.array_join(held, " ")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the words that stay as the text of those rows that lose some."""
    gone = repeats(docs, window).where("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "first", "last").dropDuplicates(["_id", "_h"])
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_key"), F.col("text").cast("string").alias("_text"))
    rows = rows.join(gone, F.col("_key").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_h")), "left")
    text = F.when(F.col("first").isNull(), F.col("_text")).otherwise(keep_words(F.col("_text"), F.col("first"), F.col("last")))
    return rows.select(*(text.alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: for each document its words, those removed, and a digest of the rest."""
    return repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: Every window as a text of its own.
SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p, len(ws) AS n FROM docs),
starts AS (SELECT d.r, s.p, md5(array_to_string(list_slice(d.ws, s.p, s.p + {WINDOW - 1}), ' ')) AS win FROM docs d JOIN (SELECT r, p FROM words WHERE p + {WINDOW - 1} <= n) s ON s.r = d.r),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY win) AS c FROM starts) WHERE c > 1),
marked AS (SELECT w.r, w.p, w.w, max(CASE WHEN a.p IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.r ORDER BY w.p ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS go
           FROM words w LEFT JOIN again a ON a.r = w.r AND a.p = w.p),
kept AS (SELECT r, sum(go)::BIGINT AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (go = 0) AS rest FROM marked GROUP BY r)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.rest, '')) AS kept_sha256 FROM docs d LEFT JOIN kept k ON k.r = d.r
"""
