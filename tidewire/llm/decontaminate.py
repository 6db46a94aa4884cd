"""Benchmark decontamination (operator 9): spaced-seed hashing.

Words are lowered runs of letters and digits.  Each mask looks at some positions
of a window and ignores the others, so a window hashes alike whatever stands at
the ignored places.  An item's masks (``seeds``) are those of its span length: every set of places where
a span may differ leaves one of them whole, so no overlap is without a hit.  Hashes of all benchmark windows are joined with those of every training
window (a table of the benchmark's words and hashes goes to the tasks, ``BLOCK_WORDS``
at a time; a larger benchmark takes several passes, each written before the next block is sent).  Each hit fixes an alignment of an
item with the text; along it, an overlap counts where some ``SPAN`` words in a row (the
whole item if it is shorter) agree in at least ``SHARE`` of the places.  A text with an overlap is
contaminated.

Nulls: a null text holds nothing; null items or item ids and items without words are
passed over.  Repeated items or rows count once each; empty tables give clean or no rows.
``filter_documents`` keeps all columns; elsewhere others are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import bounded_batches, documents, id_text, mix, windows
from tidewire.session import dematerialize, materialize

#: Positions that count within a window; ``seeds`` adds what these leave open.
MASKS = ("110110011", "1101011001", "11110001", "1010101011", "10011011")
SPAN = 13
SHARE = 0.75
#: Positions that an added mask looks at, at least; all that must agree where those are fewer.
WEIGHT = 5
#: Words of benchmark items that one pass broadcasts (about 100 bytes each with their hashes).
BLOCK_WORDS = 500_000
#: Words of texts that are hashed at a time, a longer text at once.
TEXT_WORDS = 200_000
#: Hits of windows that are held at a time before equal alignments become one.
PAIRS = 1_000_000
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@lru_cache
def seeds(span: int) -> frozenset[tuple[int, ...]]:
    """Masks for spans of so many words: whichever places differ, as many as SHARE allows, some
    mask finds all its positions elsewhere.  MASKS, then the fewest others that a greedy cover needs."""
    agree = math.ceil(SHARE * span)

    def hits(mask: tuple[int, ...], differ: tuple[int, ...]) -> bool:
        return any(not {k + p for p in mask}.intersection(differ) for k in range(span - mask[-1]))

    given = [m for m in (tuple(k for k, c in enumerate(m) if c == "1") for m in MASKS) if m[-1] < span]
    differ = [d for d in combinations(range(span), span - agree) if not any(hits(m, d) for m in given)]
    best = None
    for weight in range(agree, min(WEIGHT, agree) - 1, -1):
        masks = ((0, *rest) for rest in combinations(range(1, span), weight - 1))
        covers, left, more = {m: {d for d in differ if hits(m, d)} for m in masks}, set(differ), []
        while left:
            more.append(max(covers, key=lambda m: len(covers[m] & left)))
            left -= covers[more[-1]]
        best = more if best is None or len(more) < len(best) else best
    return frozenset([*given, *best])


class Benchmark:
    """Word numbers, items and sorted window hashes of a block of items."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.vocab: dict[str, int] = {}
        self.items = [(i, np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.int64)) for i, ws in items]
        r = np.random.default_rng(5)
        self.value = r.integers(1, 1 << 63, len(self.vocab) + 1, np.int64).astype(np.uint64)
        own = [seeds(min(SPAN, len(ws))) if ws else frozenset() for _, ws in items]
        self.masks = sorted(frozenset().union(*own))
        self.tables = []
        for mask in self.masks:
            h, item, at = [], [], []
            for k, (_, ids) in enumerate(self.items):
                if mask not in own[k]:
                    continue
                got = windows(self.value[ids], mask[-1] + 1, mask)
                h.append(got)
                item.append(np.full(len(got), k))
                at.append(np.arange(len(got)))
            h, item, at = map(np.concatenate, (h, item, at))
            order = np.argsort(h, kind="stable")
            near = np.zeros(1 << 20, bool)  # cheap test that comes before the search
            near[h & np.uint64((1 << 20) - 1)] = True
            self.tables.append((h[order], item[order], at[order], near))

    def alignments(self, ids: np.ndarray, starts: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, offset of the item's start in ``ids``) of every hit; ``starts`` of the texts in ``ids``, which gaps
        of unknown words keep apart.  Windows with a word that no item has (0) where the mask looks can't be an item's, and are left out."""
        out: set[tuple[int, int, int]] = set()
        known = ids > 0
        for mask, (h, item, at, near) in zip(self.masks, self.tables, strict=True):
            m = len(ids) - mask[-1]
            if m <= 0:
                continue
            all_known = known[:m].copy()
            for k in mask[1:]:
                all_known &= known[k : k + m]
            where = np.flatnonzero(all_known)
            got = np.full(len(where), 0x243F6A8885A308D3, np.uint64)  # the hash of ``windows``
            for k in mask:
                got = mix(got + self.value[ids[where + k]] * np.uint64(2 * k + 0x10001))
            close = near[got & np.uint64((1 << 20) - 1)]
            where, got = where[close], got[close]
            if not len(where):
                continue
            lo, hi = np.searchsorted(h, got, "left"), np.searchsorted(h, got, "right")
            size = hi - lo
            ends = np.cumsum(size)
            a = 0
            while a < len(where):  # as many windows at a time as make about PAIRS hits
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
                n = size[a:b]
                of = np.repeat(lo[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                place = np.repeat(where[a:b], n)
                hits = np.unique(np.stack([np.searchsorted(starts, place, "right") - 1, item[of], place - at[of]]), axis=1)
                out.update(zip(*hits.tolist(), strict=True))
                a = b
        return out

    def of_texts(self, texts: Iterable[str | None]) -> Iterator[dict[int, int]]:
        """``overlaps`` of each text; about TEXT_WORDS words are hashed in one go."""
        own, size = [], 0
        for text in texts:
            ws = words_of(text)
            own.append(np.fromiter(map(self.vocab.get, ws, repeat(0)), np.int64, len(ws)))
            size += len(ws)
            if size >= TEXT_WORDS:
                yield from self.of_ids(own)
                own, size = [], 0
        yield from self.of_ids(own)

    def overlaps(self, text: str | None) -> dict[int, int]:
        """item id -> most agreeing words of SPAN in a row, where there are enough."""
        return next(self.of_texts([text]))

    def of_ids(self, texts: list[np.ndarray]) -> list[dict[int, int]]:
        found: list[dict[int, int]] = [{} for _ in texts]
        if not texts:
            return found
        gap = np.zeros(SPAN, np.int64)
        starts = np.cumsum([0, *(len(ids) + SPAN for ids in texts[:-1])])
        for t, k, at in self.alignments(np.concatenate([x for ids in texts for x in (ids, gap)]), starts):
            ids, start = texts[t], at - int(starts[t])
            item_id, own = self.items[k]
            a, b = max(0, -start), min(len(own), len(ids) - start)
            span = min(SPAN, len(own))
            if b - a < span:
                continue
            same = np.concatenate([[0], np.cumsum(own[a:b] == ids[start + a : start + b])])
            most = int((same[span:] - same[:-span]).max())
            if most >= SHARE * span:
                found[t][item_id] = max(most, found[t].get(item_id, 0))
        return found


def blocks(benchmark: DataFrame) -> Iterator[Benchmark]:
    """The benchmark in blocks of bounded size, read one item at a time."""
    items, size = [], 0
    for row in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        ws = words_of(row["text"])
        if not ws:
            continue
        items.append((int(row["item_id"]), ws))
        size += len(ws)
        if size >= BLOCK_WORDS:
            yield Benchmark(items)
            items, size = [], 0
    if items:
        yield Benchmark(items)


def _scan(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """Add ``_hits`` (item, matched) of one block to rows that have ``text``."""
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([[{"item": i, "matched": m} for i, m in sorted(found.items())] for found in shared.value.of_texts(series)])

    udf = F.pandas_udf(find, "array<struct<item:long,matched:long>>")
    return rows.withColumn("_hits", F.concat("_hits", udf("text")))


def overlaps(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``rows`` with array ``_hits`` of the benchmark items found in ``text``.  Only the last block stays
    in the plan that is returned; after each earlier one the rows are written and the block is given up,
    so driver and tasks hold one block at a time."""
    spark = rows.sparkSession
    bounded_batches(spark)
    rows = rows.withColumn("_hits", F.array().cast("array<struct<item:long,matched:long>>"))
    shared = written = None
    for block in blocks(benchmark):
        if shared is not None:
            rows, before = materialize(rows, "benchmark-pass"), written
            shared.destroy()
            written = rows
            if before is not None:
                dematerialize(before)
        shared = spark.sparkContext.broadcast(block)
        rows = _scan(rows, shared)
    return rows


def filter_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with their own columns."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text").cast("string").alias("text"))
    return overlaps(rows, benchmark).where(F.size("_hits") == 0).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: benchmark items found in each document."""
    found = overlaps(id_text(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_sort(F.transform("_hits", lambda h: h["item"]))
    return found.select("doc_id", (F.size("_hits") > 0).alias("contaminated"), F.size("_hits").cast("long").alias("n_items"), F.array_join(items.cast("array<string>"), ",").alias("items"),
                        F.coalesce(F.array_max(F.transform("_hits", lambda h: h["matched"])), F.lit(0)).cast("long").alias("most_matched"))
