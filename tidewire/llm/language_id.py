"""Language ID (operator 6): multinomial naive Bayes over hashed character n-grams.

A text is lowered, everything but letters becomes a boundary, and the 1- to 3-grams of
code points that hold a letter are hashed into ``BUCKETS``.  Counts of
(language, bucket) cover every labelled document that is not held out (the remainder
of crc32 of its id by ``FOLDS`` is not 0).  The table of log probabilities has
languages x BUCKETS entries, whatever the size of the corpus, and is broadcast; the
texts of an Arrow batch are scored together in numpy, as sparse rows of (bucket, count).

Nulls: a text that is null or has no letter is ``und`` with score 0; rows without lang
or doc_id teach nothing (a null doc_id isn't held out).  With no rows to learn from,
everything is ``und``.  Ties go to the first language in code point order.  Repeated
rows each count and each give a row; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import bounded_batches, documents, sealed, unsealed

BUCKETS = 1 << 15
FOLDS = 5
SMOOTHING = 0.5
#: Code points that are turned into features at once.
CHUNK = 1 << 18
#: Sparse entries that are multiplied at once.
ENTRIES = 1 << 20

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def features(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of a text, a chunk at a time."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(codes), CHUNK):
        c = codes[max(0, at - 2) : at + CHUNK]
        c = np.where(letters()[c], c, np.uint32(0))
        if at == 0:
            c = np.concatenate([np.zeros(1, np.uint32), c])
        if at + CHUNK >= len(codes):
            c = np.concatenate([c, np.zeros(1, np.uint32)])
        new = 0 if at == 0 else 2  # characters that the chunk before has counted
        one, two = c[new:], c[1:] + c[:-1] * np.uint32(0x01000193)
        two, three = two[max(0, new - 1):], c[2:] + c[1:-1] * np.uint32(0x01000193) + c[:-2] * np.uint32(0x9E3779B1)
        some2 = (c[1:] != 0)[max(0, new - 1):] | (c[:-1] != 0)[max(0, new - 1):]
        h = np.concatenate([one[one != 0] * np.uint32(0x85EBCA6B), two[some2] * np.uint32(0xC2B2AE35) + np.uint32(1), three[c[1:-1] != 0] * np.uint32(0x27D4EB2F) + np.uint32(2)])
        h ^= h >> np.uint32(15)
        yield (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 15)


def counts(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of (text, lang); bucket -1 counts documents."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, np.ndarray] = {}
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                c = own.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                c[-1] += 1
                for f in features(text):
                    c[:-1] += np.bincount(f, minlength=BUCKETS)
        for lang, c in own.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "bucket": np.where(at == BUCKETS, -1, at).astype(np.int32), "n": c[at]})

    return rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities, languages in code point order."""

    def __init__(self, table: pd.DataFrame):
        self.langs = sorted(table["lang"].unique())
        c = np.zeros((BUCKETS + 1, len(self.langs)))
        c[table["bucket"].to_numpy(), table["lang"].map({x: k for k, x in enumerate(self.langs)}).to_numpy(dtype=int)] = table["n"]
        prior, c = c[-1], c[:-1] + SMOOTHING
        self.prior = np.log(prior / prior.sum()) if len(self.langs) else prior
        self.logs = np.log(c / c.sum(axis=0)).astype(np.float32)

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Labels and scores of a batch: sparse rows of (bucket, count), multiplied together."""
        total, some = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts), bool)
        rows: list[int] = []
        buckets: list[np.ndarray] = []
        ns: list[np.ndarray] = []
        size = 0
        for k, text in enumerate(texts):
            for f in features(text) if text and self.langs else ():
                if not len(f):
                    continue
                some[k], c = True, np.bincount(f, minlength=BUCKETS)
                at = np.flatnonzero(c)
                rows.append(k)
                buckets.append(at)
                ns.append(c[at])
                size += len(at)
                if size >= ENTRIES:
                    self._add(total, rows, buckets, ns)
                    rows, buckets, ns, size = [], [], [], 0
        self._add(total, rows, buckets, ns)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
        return [self.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, score, 0.0)

    def _add(self, total: np.ndarray, rows: list[int], buckets: list[np.ndarray], ns: list[np.ndarray]) -> None:
        """Add the product of sparse rows (a text may have several) and the log probabilities."""
        if not rows:
            return
        starts = np.concatenate([[0], np.cumsum([len(x) for x in buckets])[:-1]])
        at, n = np.concatenate(buckets), np.concatenate(ns).astype(np.float64)
        for lang in range(len(self.langs)):
            np.add.at(total[:, lang], rows, np.add.reduceat(self.logs[at, lang] * n, starts))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the labelled rows outside the held-out fold."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % FOLDS != 0))
    return Model(counts(rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))).toPandas())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            langs, scores = m.predict(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"].astype(bool), "lang_pred": langs, "score": scores})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return unsealed(sealed(rows).mapInPandas(score, "doc_id long, held_out boolean, lang_pred string, score double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the language of every text of ``documents``."""
    bounded_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return identify(docs, train(docs))
