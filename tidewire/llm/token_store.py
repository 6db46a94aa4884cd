"""Token-ID output (operator 10): directly addressable codes.

Ids are split into 8-bit chunks.  Level 0 holds the low chunk of every id, level 1
the next chunk of those that need one, and so on.  Each level has a bitmap that
says whether an id continues on the next level, and a rank directory (ones before
each block of 512 bits), so the place of id i's chunk on the next level is
rank(i): any token is read by at most four byte reads and no block is decoded.

A table of segments is written (Parquet is only the container; ``payload`` is the
format above): ``part, seg, docs, tokens, payload``, where the payload starts with
the doc ids and lengths of the segment.  Segments follow ascending doc_id.

Nulls: a null text is empty (only the end id); a null doc_id sorts first and stays
null.  Rows that repeat a doc_id stay separate rows, ordered by the hash of their texts, then
by their texts; so one id (or no id) on many rows fills many tasks.
Empty tables give an empty store.  Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import bounded_batches, documents, id_text, sealed, unsealed
from tidewire.session import ensure_checkpoint_dir

END_ID = 2
BLOCK = 512
#: Places that are looked up at once.
PLACES = 1 << 14
SEGMENT_TOKENS = 1 << 18
#: Words a worker remembers; beyond it the memory starts afresh.
KEEP_WORDS = 800_000
#: ASCII capitals, the only ones lowered before the tokenizer sees a word (it lowers the rest).
LOWER = {c: c + 32 for c in range(65, 91)}
#: Words cut at once: printable ASCII without apostrophes (contractions are pre-tokens).
PLAIN = re.compile(r"[\t\r -&(-~]+")
PRE_TOKEN = re.compile(r"[a-z]+|[0-9]|[^a-z0-9\s]+")
#: Letters whose lower case depends on their place or is longer.
SPECIAL_CASE = re.compile("[\u03a3\u0130]")


# ---- the code ------------------------------------------------------------------

def pack(ids: np.ndarray) -> bytes:
    """Directly addressable code of unsigned 32-bit ids."""
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(more, dtype=np.uint32)])[: len(rest) + 1 : BLOCK].astype("<u4")
        levels.append((len(rest), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ones.tobytes()))
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            break
    head = np.array([len(levels), *(x for n, *_ in levels for x in (n,))], "<u4").tobytes()
    return head + b"".join(c + b + r for _, c, b, r in levels)


class Packed:
    """Read access to one packed array, at byte ``at`` of ``data``."""

    def __init__(self, data: bytes, at: int = 0):
        n = int(np.frombuffer(data, "<u4", 1, at)[0])
        sizes = np.frombuffer(data, "<u4", n, at + 4)
        self.levels, at = [], at + 4 + 4 * n
        for size in map(int, sizes):
            nb, nr = (size + 7) // 8, size // BLOCK + 1
            chunks = np.frombuffer(data, np.uint8, size, at)
            bits = np.frombuffer(data, np.uint8, nb, at + size)
            ones = np.frombuffer(data, "<u4", nr, at + size + nb)
            self.levels.append((chunks, bits, ones))
            at += size + nb + 4 * nr
        self.end = at

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """Random access: one chunk and one rank a level."""
        value = 0
        for level, (chunks, bits, ones) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            first = block * BLOCK // 8
            rank = int(ones[block]) + int(np.bitwise_count(bits[first : i >> 3]).sum())
            i = rank + int(np.bitwise_count(np.uint8(bits[i >> 3] & ((1 << (i & 7)) - 1))))
        return value

    def at(self, places: np.ndarray) -> np.ndarray:
        """Random access to many places, as ``__getitem__`` does for one."""
        out = np.zeros(len(places), np.uint32)
        for a in range(0, len(places), PLACES):
            i = np.asarray(places[a : a + PLACES], np.int64)
            value, live = out[a : a + PLACES], np.arange(len(i))
            for level, (chunks, bits, ones) in enumerate(self.levels):
                value[live] |= chunks[i].astype(np.uint32) << np.uint32(8 * level)
                more = (bits[i >> 3] >> (i & 7).astype(np.uint8) & 1).astype(bool)
                live, i = live[more], i[more]
                if not len(i):
                    break
                first = i // BLOCK * (BLOCK // 8)
                near = first[:, None] + np.arange(BLOCK // 8)
                full = np.where(near < (i >> 3)[:, None], np.bitwise_count(bits[np.minimum(near, len(bits) - 1)]), 0).sum(axis=1, dtype=np.int64)
                below = bits[i >> 3] & ((1 << (i & 7)) - 1).astype(np.uint8)
                i = ones[i // BLOCK].astype(np.int64) + full + np.bitwise_count(below)
        return out

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = self.levels[0][0].astype(np.uint32)
        where = np.arange(len(out))
        for level, (_, bits, _) in enumerate(self.levels[:-1], 1):
            where = where[np.unpackbits(bits, bitorder="little")[: len(where)].astype(bool)]
            out[where] |= self.levels[level][0].astype(np.uint32) << np.uint32(8 * level)
        return out


def segment(doc_ids: list[int], ids: list[np.ndarray]) -> bytes:
    """Payload of a segment: doc count, doc ids, lengths, packed ids."""
    lens = np.array([len(x) for x in ids], "<u4")
    return (np.array([len(ids)], "<u8").tobytes() + np.array(doc_ids, "<i8").tobytes() + lens.tobytes() + pack(np.concatenate(ids) if ids else np.zeros(0, np.uint32)))


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, Packed]:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    return np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<u4", n, 8 + 8 * n), Packed(data, 8 + 12 * n)


# ---- tokenizing ----------------------------------------------------------------

class WordTokenizer:
    """Encodes texts with a tokenizer whose pre-tokenizer never crosses a space:
    each space-separated word is encoded once and remembered, as the bytes of its
    ids.  Words whose pre-tokens are plain to see (ASCII without apostrophes, letters
    with sentence marks behind) are cut into them; lowered letters need no normalizer
    and only a split at spaces.  All others go through the whole tokenizer."""

    MARKS = ".,;:!?"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _words(self, ws: list[str]) -> None:
        """Encode lowered letter words as one text: a word ends where a token does
        that ends words.  If the counts differ, one by one."""
        if not ws:
            return
        ids = np.array(self.plain.encode_batch_fast([" ".join(ws)], add_special_tokens=False)[0].ids, np.int64)
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cuts) != len(ws):
            self._each(ws)
            return
        raw, a = ids.astype("<u4").tobytes(), 0
        for w, b in zip(ws, cuts.tolist(), strict=True):
            self.known[w] = raw[a:b]
            a = b

    def _each(self, ws: list[str]) -> None:
        for w, e in zip(ws, self.tok.encode_batch_fast(ws, add_special_tokens=False), strict=True) if ws else ():
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def _learn(self, miss: list[str]) -> None:
        known = self.known
        if len(known) > KEEP_WORDS:
            known.clear()
            known[""] = b""
        letters, odd, built, capital = {}, {}, [], []
        for w in miss:
            if w.isascii() and w.isalpha():
                low = w.lower()
                if low not in known:
                    letters[low] = None
                if low != w:
                    capital.append((w, low))
                continue
            if w.isascii():
                parts = PRE_TOKEN.findall(w.translate(LOWER)) if PLAIN.fullmatch(w) and "<|" not in w else [w]
            else:
                core = w.rstrip(self.MARKS)
                if core.isalpha() and is_normalized("NFC", core) and not SPECIAL_CASE.search(core):
                    parts = [core.lower(), w[len(core):]]
                else:
                    parts = [w]
            for p in parts:
                if p not in known:
                    (letters if p.isalpha() and (p is not w) else odd)[p] = None
            if parts != [w]:
                built.append((w, parts))
        self._words(list(letters))
        self._each(list(odd))
        for w, low in capital:
            known[w] = known[low]
        for w, parts in built:
            known[w] = b"".join([known[p] for p in parts])

    def __call__(self, text: str | None) -> np.ndarray:
        """Ids of a text, unsigned 32-bit."""
        if not text:
            return np.zeros(0, "<u4")
        ws, known = text.replace("\n", " ").split(" "), self.known
        try:
            return np.frombuffer(b"".join(map(known.__getitem__, ws)), "<u4")
        except KeyError:
            self._learn([w for w in dict.fromkeys(ws) if w not in known])
        try:
            return np.frombuffer(b"".join(map(known.__getitem__, ws)), "<u4")
        except KeyError:  # some were forgotten when the memory started afresh
            parts = []
            for w in ws:
                if w not in known:
                    self._learn([w])
                parts.append(known[w])
            return np.frombuffer(b"".join(parts), "<u4")


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


# ---- Spark jobs ----------------------------------------------------------------

def write_store(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` and write the segments, ascending by doc_id."""
    bounded_batches(docs.sparkSession)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seg, tok = TaskContext.get().partitionId(), 0, tokenizer(tokenizer_path)
        keys, ids, size = [], [], 0
        for pdf in batches:
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                got = np.append(tok(t), np.uint32(end_id))
                keys.append(int(d))
                ids.append(got)
                size += len(got)
                if size >= SEGMENT_TOKENS:
                    yield pd.DataFrame({"part": [part], "seg": [seg], "tokens": [size], "payload": [segment(keys, ids)]})
                    keys, ids, size, seg = [], [], 0, seg + 1
        if ids:
            yield pd.DataFrame({"part": [part], "seg": [seg], "tokens": [size], "payload": [segment(keys, ids)]})

    rows = sealed(id_text(docs)).withColumn("h", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    rows.mapInPandas(encode, "part int, seg int, tokens long, payload binary").write.parquet(out)


def read_store(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, first_id, last_id, probe, probe_id[, ids]) of each document of a store.

    The first and last id and the one at place ``probe`` (``ids_crc32`` modulo ``n_tokens``) are
    read by rank directories alone."""
    bounded_batches(spark)
    segs = spark.read.parquet(path)
    # tokens before each part, then before each segment of a part: two small windows
    parts = segs.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = segs.select("part", "seg", (F.sum("tokens").over(Window.partitionBy("part").orderBy("seg")) - F.col("tokens")).alias("seg_start"))
    starts = inside.join(before, "part").select("part", "seg", (F.col("part_start") + F.col("seg_start")).alias("seg_start"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start, data in zip(pdf["seg_start"], pdf["payload"], strict=True):
                keys, lens, packed = read_segment(data)
                ids, cuts = packed.all().astype("<u4"), np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
                parts = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                crcs = np.array([zlib.crc32(x.tobytes()) for x in parts], np.int64)
                probe = crcs % lens
                first, last, some = (packed.at(x).astype(np.int64) for x in (cuts[:-1], cuts[1:] - 1, cuts[:-1] + probe))
                out = pd.DataFrame({"doc_id": keys, "start": int(start) + cuts[:-1], "n_tokens": lens.astype(np.int64), "ids_crc32": crcs,
                                    "first_id": first, "last_id": last, "probe": probe, "probe_id": some})
                yield out.assign(ids=[x.astype(np.int64) for x in parts]) if with_ids else out

    rows = segs.join(starts, ["part", "seg"]).select("seg_start", "payload")
    return unsealed(rows.mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, first_id long, last_id long, probe long, probe_id long" + ", ids array<long>" * with_ids))


def token_at(payload: bytes, i: int) -> int:
    """The i-th token of a segment, by rank directories alone."""
    return read_segment(payload)[2][i]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: write the store of ``documents``, read it back."""
    import public_tokenizers

    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-store-{uuid.uuid4().hex}"
    write_store(documents(spark, sf_dir), out, public_tokenizers.path("word_bpe_49k.json"))
    return read_store(spark, out, with_ids=False)
