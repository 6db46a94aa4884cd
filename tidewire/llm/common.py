"""Shared pieces of the training-data operators."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every operator here: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: str.translate table that turns every separator into a space.
TO_SPACE = {ord(c): " " for c in SPACES}
#: Stands for a null id within Python.
NULL_ID = -(1 << 63)
#: Bytes of one Arrow batch handed to a Python worker, so long texts can't fill it.
BATCH_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch unless the session already does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, str((1 << 31) - 1), f"{(1 << 31) - 1}b"):
        spark.conf.set(key, str(BATCH_BYTES))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a table, whatever other columns it has."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def sealed(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A null id as a number of its own: pandas would turn a column of longs with a null
    into doubles, which can't hold all longs."""
    return df.withColumn(id_col, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)))


def unsealed(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return df.withColumn(id_col, F.nullif(F.col(id_col), F.lit(NULL_ID)))


def words(text: str | None) -> list[str]:
    """Maximal runs of characters other than SPACES."""
    if not text:
        return []
    return [w for w in text.translate(TO_SPACE).split(" ") if w]


def split_words(col):
    """The same as a Column: array of words, [] for null."""
    return F.coalesce(F.array_remove(F.split(col, f"[{SPACES}]+", -1), ""), F.array().cast("array<string>"))


def sha_spans(spans: list[tuple[str, int, int]]) -> tuple[str, str]:
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return joined, hashlib.sha256(joined.encode()).hexdigest()


#: One random 64-bit number for each byte at each of 64 places in a word.
_PLACES = np.frombuffer(hashlib.shake_256(b"tidewire words").digest(64 * 256 * 8), "<u8").astype(np.uint64)
_SEPARATES = np.isin(np.arange(256), [ord(c) for c in SPACES])


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 text, all at once: the sum of the numbers of a word's bytes at
    their places, taken 1, 3, 5, ... times from one run of 64 places to the next."""
    b = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(_SEPARATES[b], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values = _PLACES[((inside & 63) << 8) + b[~_SEPARATES[b]]]
    if int(lengths.max()) > 64:
        values = values * ((inside >> 6) * 2 + 1).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    cuts = np.cumsum(lengths)
    return mix(sums[cuts] - sums[cuts - lengths])


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mix of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def windows(h: np.ndarray, n: int, offsets: tuple[int, ...] | None = None) -> np.ndarray:
    """One hash for each window of n words; offsets: the positions that count (all)."""
    offsets = tuple(range(n)) if offsets is None else offsets
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, 0x243F6A8885A308D3, np.uint64)
    for k in offsets:
        out = mix(out + h[k : k + m] * np.uint64(2 * k + 0x10001))
    return out
