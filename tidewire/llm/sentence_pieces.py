"""SentencePiece encoding and decoding (operator 5) by a max-plus parallel scan.

A segmentation is a path over a text's positions; a state is (position, last piece).  Adding a
piece costs nothing where it may follow the last one, and minus infinity elsewhere: in a BPE
model two pieces may stand side by side if and only if merging their two strings gives back just
these two, and the one path from start to end is the model's encoding.  In a unigram
model any piece may follow, its weight is its score, and the heaviest path wins.  Two characters that
stand together in no piece form a barrier, where every state is the same.

Texts longer than ``GIANT`` are cut into chunks of ``CHUNK`` characters anywhere.  Each chunk yields its
transfer matrix: for each state in which its left edge can be crossed (pieces that cover or
touch the edge), the states in which its right edge is crossed, with the best weight.  The matrices
are combined by max-plus products, blocks of chunks first, then blocks; the best final state
fixes the states at all block edges, then at all chunk edges.  Then each chunk is backtraced on its
own, and the pieces are put together in order.  Shorter texts are one chunk.

Decoding turns pieces to bytes, spaces for their marks, joins them, and drops the
space that encoding puts first.

Nulls: a null text is encoded like an empty one (no ids); a null doc_id is kept.  Repeated
rows each give a row.  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import bounded_batches, documents, id_text, sealed, unsealed
from tidewire.session import materialize

GIANT = 1 << 15
CHUNK = 1 << 13
#: Chunks whose matrices are multiplied in one task.
BLOCK = 64
KEEP_WORDS = 400_000
KEEP_PAIRS = 400_000
#: New words up to this length are merged many at a time, and texts whose new words are.
NARROW, TEXTS = 24, 512
#: Words up to this length are merged; the work grows with the square of the length.
SHORT = 48
MARK = "▁"
WORDS = re.compile("▁+[^▁]*|[^▁]+")
#: Of a string that is no piece.
NO_RANK = 1 << 60
#: No last piece: start of the text or a barrier.
FRESH = -1
STATE = "struct<o:int,t:int>"


class Pieces:
    """Vocabulary of a model and the paths over a text."""

    def __init__(self, ids: dict[str, int], scores: dict[int, float], byte_ids: list[int], bpe: bool = True):
        self.ids, self.scores, self.byte_ids, self.bpe = ids, scores, byte_ids, bpe
        self.longest = max(map(len, ids), default=1)
        self.text = {i: p for p, i in ids.items()}
        self.inside = {p[k : k + 2] for p in ids for k in range(len(p) - 1)}
        self.worst = min(scores.values(), default=0.0) - 10
        # merges go by these: equal scores have equal ranks
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[scores[i]] for p, i in ids.items()}
        self.known: dict[str, bytes] = {}
        self.held = set().union(*ids)
        self.joins: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.pairs: dict[int, bool] = {}

    def merges(self, s: str) -> list[str]:
        """Byte-pair merging of a short string: best score first, then leftmost."""
        parts, rank = list(s), self.rank.get
        joined = [rank(s[k : k + 2], NO_RANK) for k in range(len(s) - 1)]
        while joined:
            best = min(joined)
            if best == NO_RANK:
                break
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = rank(parts[at - 1] + parts[at], NO_RANK)
            if at < len(joined):
                joined[at] = rank(parts[at] + parts[at + 1], NO_RANK)
        return parts

    def pair_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (first id, second id) of all pairs of pieces that make a piece, with its rank and id; a last key for none."""
        if self.joins is None:
            ids = self.ids
            found = [((a << 32) | b, self.rank[p], i) for p, i in ids.items() for k in range(1, len(p))
                     if (a := ids.get(p[:k])) is not None and (b := ids.get(p[k:])) is not None]
            self.joins = tuple(np.array(x, np.int64) for x in zip(*sorted([*found, (1 << 62, NO_RANK, -1)]), strict=True))
        return self.joins

    def merge_many(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length whose characters are pieces or part of none: ``merges`` of them all, one merge of
        each a turn.  A character without a piece is a number below 0 that joins nothing, and is spelled in bytes."""
        keys, ranks, made = self.pair_table()

        def look(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = (a << 32) | b
            at = np.searchsorted(keys, key)
            return np.where(keys[at] == key, at, len(keys) - 1)

        width = len(words[0])
        text = "".join(words)
        known = {c: self.ids.get(c, ~ord(c)) for c in set(text)}
        ids = np.fromiter(map(known.__getitem__, text), np.int64, len(text)).reshape(-1, width)
        pair = look(ids[:, :-1], ids[:, 1:])  # place in the table of each neighbouring pair
        size, out, live = np.full(len(words), width), ids.copy(), np.arange(len(words))
        columns = np.arange(width)
        while len(live):
            rank = ranks[pair]
            at = rank.argmin(1)  # the leftmost of the best
            row = np.arange(len(live))
            go = rank[row, at] < NO_RANK
            out[live[~go], : ids.shape[1]] = ids[~go]
            live, ids, pair, at = live[go], ids[go], pair[go], at[go]
            if not len(live):
                break
            row = np.arange(len(live))
            size[live] -= 1
            ids[row, at] = made[pair[row, at]]
            left = columns[: ids.shape[1] - 1]
            ids = np.where(left <= at[:, None], ids[:, :-1], ids[:, 1:])
            pair = np.where(left[:-1] < at[:, None], pair[:, :-1], pair[:, 1:])
            n = ids.shape[1]
            if n == 1:
                out[live, :1] = ids
                break
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < n - 1)
            pair[before, at[before] - 1] = look(ids[before, at[before] - 1], ids[before, at[before]])
            pair[after, at[after]] = look(ids[after, at[after]], ids[after, at[after] + 1])
        used = columns < size[:, None]
        flat, ends = out[used].astype("<u4").tobytes(), (np.cumsum(size) * 4).tolist()
        coded = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for k in np.flatnonzero((used & (out < 0)).any(1)).tolist():
            row = [[i] if i >= 0 else [self.byte_ids[b] for b in chr(~i).encode("utf-8", "surrogatepass")] for i in out[k, : size[k]].tolist()]
            coded[k] = np.array([i for part in row for i in part], "<u4").tobytes()
        return coded

    def new_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words between barriers: those of one length together, others one by one."""
        out, by_length = {}, {}
        within = {c for c in self.held.intersection(set().union(*words)) if c not in self.ids}  # they may merge, but are no pieces
        for w in words:
            if self.bpe and 1 < len(w) <= NARROW and within.isdisjoint(w):
                by_length.setdefault(len(w), []).append(w)
            else:
                out[w] = self.word(w)
        for own in by_length.values():
            out.update(zip(own, self.merge_many(own), strict=True))
        return out

    def weight(self, last: int, piece: int) -> float | None:
        """Of adding a piece behind ``last``; None: may not follow."""
        if not self.bpe:
            return self.scores[piece] if piece >= 0 else self.worst
        key = (last + 2) << 32 | (piece + 2)
        fits = self.pairs.get(key)
        if fits is None:
            if len(self.pairs) > KEEP_PAIRS:
                self.pairs.clear()
            own = [self.text[x] for x in (last, piece) if x >= 0]
            fits = self.pairs[key] = self.merges("".join(own)) == own if piece >= 0 else True
        return 0.0 if fits else None

    def barrier(self, x: str, at: int) -> bool:
        return at == 0 or at == len(x) or x[at - 1 : at + 1] not in self.inside

    def walk(self, x: str, a: int, last: int, stop: int, end: int) -> dict[int, tuple[float, int, int]]:
        """Best way to each position from a: position -> (weight, last piece, position
        before).  Pieces start before ``stop`` and end by ``end``.  -2: a character
        without a piece."""
        best = {a: (0.0, last, -1)}
        for i in range(a + 1, end + 1):
            top = None
            for j in range(max(a, i - self.longest), min(i, stop)):
                if j not in best:
                    continue
                t = self.ids.get(x[j:i])
                if t is None:
                    if i - j > 1 or x[j] in self.ids:
                        continue
                    t = -2
                before = best[j]
                w = self.weight(FRESH if self.barrier(x, j) else before[1], t)
                if w is not None and (top is None or before[0] + w > top[0]):
                    top = (before[0] + w, t, j)
                    if self.bpe:
                        break
            if top is not None:
                best[i] = top
        return best

    def spell(self, x: str, best: dict, end: int) -> list[int]:
        """Ids of the path that ends at ``end``."""
        out: list[list[int]] = []
        while best[end][2] >= 0:
            _, t, j = best[end]
            out.append([t] if t >= 0 else [self.byte_ids[b] for b in x[j:end].encode("utf-8", "surrogatepass")])
            end = j
        return [i for part in reversed(out) for i in part]

    def word(self, s: str) -> bytes:
        """Ids of a string that lies between barriers, where there is but one state: a
        short one by merging, a long one by its path."""
        if self.bpe and len(s) <= SHORT:
            out = []
            for p in self.merges(s):
                i = self.ids.get(p)
                out += [i] if i is not None else [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
        else:
            out = self.spell(s, self.walk(s, 0, FRESH, len(s), len(s)), len(s))
        return pack(f"<{len(out)}I", *out)

    def encode(self, x: str) -> np.ndarray:
        """Ids of a normalised string between barriers; its words are remembered."""
        return self.encode_many([x])[0]

    def encode_many(self, xs: list[str]) -> list[np.ndarray]:
        """``encode`` of each string; words that are new to the task are merged together."""
        known = self.known
        known[""] = b""
        texts = [WORDS.findall(x) if MARK * 2 in x or "\0" in x else x.replace(MARK, "\0" + MARK).split("\0") for x in xs]
        parts = [list(map(known.get, words)) for words in texts]
        lacking = [(words, p, [k for k, got in enumerate(p) if got is None]) for words, p in zip(texts, parts, strict=True) if None in p]
        if lacking:
            new = self.new_words({words[k] for words, _, at in lacking for k in at})
            for words, p, at in lacking:
                for k in at:
                    p[k] = new[words[k]]
            if len(known) > KEEP_WORDS:
                known.clear()
            known.update((w, got) for w, got in new.items() if len(w) <= 40)
        return [np.frombuffer(b"".join(p), "<u4") for p in parts]

    # ---- chunks: x holds the chunk [s, e) with up to ``longest`` characters on both sides

    def entries(self, x: str, s: int) -> list[tuple[int, int]]:
        """States (offset of the first boundary from s, last piece) at the left edge."""
        if self.barrier(x, s):
            return [(0, FRESH)]
        return [(j - s, t) for i in range(max(0, s - self.longest), s) for j in range(s, min(len(x), i + self.longest) + 1) if (t := self.ids.get(x[i:j])) is not None]

    def edges(self, x: str, s: int, e: int) -> tuple[int, int] | None:
        """First and last barrier within [s, e]."""
        first = next((k for k in range(s, e + 1) if self.barrier(x, k)), None)
        return None if first is None else (first, next(k for k in range(e, first - 1, -1) if self.barrier(x, k)))

    def exits(self, x: str, best: dict, e: int, final: bool) -> list[tuple[int, int, float]]:
        """States (offset from e, last piece, weight) at the right edge."""
        return [(i - e, FRESH if self.barrier(x, i) and i == e else t, w) for i, (w, t, j) in best.items() if i >= e and (j < e or i == e) and (not final or i == e)]

    def transfer(self, x: str, s: int, e: int, final: bool) -> list[tuple[int, int, int, int, float]]:
        """The chunk's matrix: (offset in, piece in, offset out, piece out, weight)."""
        far, b, out = len(x) if not final else e, self.edges(x, s, e), []
        if b is None:
            for o, t in self.entries(x, s):
                if s + o >= e:  # one piece covers the whole chunk
                    out.append((o, t, s + o - e, t, 0.0))
                else:
                    out += [(o, t, *z) for z in self.exits(x, self.walk(x, s + o, t, e, far), e, final)]
            return out
        body = 0.0 if self.bpe else self.walk(x, b[0], FRESH, b[1], b[1])[b[1]][0]
        tail = self.exits(x, self.walk(x, b[1], FRESH, e, far), e, final)
        for o, t in self.entries(x, s):
            head = self.walk(x, s + o, t, b[0], b[0]).get(b[0]) if s + o <= b[0] else None
            if head is not None:
                out += [(o, t, p, q, head[0] + body + w) for p, q, w in tail]
        return out

    def backtrace(self, x: str, s: int, e: int, into: tuple[int, int], out: tuple[int, int]) -> np.ndarray:
        """Ids of the chunk's pieces between its two edge states."""
        return self.backtrace_many([(x, s, e, into, out)])[0]

    def backtrace_many(self, chunks: list[tuple[str, int, int, tuple[int, int], tuple[int, int]]]) -> list[np.ndarray]:
        """``backtrace`` of each chunk; words between their barriers that are new to the task are merged together."""
        heads, bodies, tails = [], [], []
        for x, s, e, into, out in chunks:
            a, z, b = s + into[0], e + out[0], self.edges(x, s, e)
            head, body, tail = [], "", []
            if a < z and b is None:
                head = self.spell(x, self.walk(x, a, into[1], e, z), z)
            elif a < z:
                head, body = self.spell(x, self.walk(x, a, into[1], b[0], b[0]), b[0]), x[b[0] : b[1]]
                tail = self.spell(x, self.walk(x, b[1], FRESH, e, z), z) if z > b[1] else []
            heads.append(head)
            bodies.append(body)
            tails.append(tail)
        between = self.encode_many(bodies)
        return [np.concatenate([np.array(h, "<u4"), ids, np.array(t, "<u4")]) for h, ids, t in zip(heads, between, tails, strict=True)]


def product(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """Max-plus product of two matrices."""
    rows: dict[tuple, list] = {}
    for i, j, k, m, w in b:
        rows.setdefault((i, j), []).append((k, m, w))
    best: dict[tuple, float] = {}
    for i, j, k, m, w in a:
        for p, q, v in rows.get((k, m), ()):
            if best.get((i, j, p, q), -np.inf) < w + v:
                best[i, j, p, q] = w + v
    return [(*k, w) for k, w in best.items()]


def edge_states(matrices: list[list[tuple]], first: tuple, last: tuple | None) -> list[tuple]:
    """The states at all edges of a row of matrices on the best path from ``first`` to
    ``last`` (None: any)."""
    reach, back = {first: 0.0}, []
    for m in matrices:
        step, come = {}, {}
        for i, j, k, q, w in m:
            if (i, j) in reach and step.get((k, q), -np.inf) < reach[i, j] + w:
                step[k, q], come[k, q] = reach[i, j] + w, (i, j)
        reach = step
        back.append(come)
    state = last if last is not None else max(sorted(reach), key=reach.get)
    states = [state]
    for come in reversed(back):
        state = come[state]
        states.append(state)
    return states[::-1]


class Codec:
    """A SentencePiece BPE model with byte fallback: normalising, encoding, decoding."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.bytes_of = {i: sp.id_to_piece(i).replace(MARK, " ").encode() for i in plain}
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of |= {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.table = [self.bytes_of.get(i, b"") for i in range(sp.get_piece_size())]
        self.pieces = Pieces({sp.id_to_piece(i): i for i in plain}, {i: sp.get_score(i) for i in plain}, byte_ids)

    def normal(self, text: str | None) -> str:
        return self.sp.normalize(text) if text else ""

    def encode(self, text: str | None) -> np.ndarray:
        return self.pieces.encode(self.normal(text))

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        return self.pieces.encode_many([self.normal(t) for t in texts])

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode(self, ids) -> str:
        text = self.decode_bytes(ids).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def chunks_of(c: Codec, text: str, size: int) -> Iterator[tuple[int, str, int, int, bool]]:
    """(number, text with its surroundings, start, end, whether it is the last)."""
    x, far = c.normal(text), c.pieces.longest
    for k, a in enumerate(range(0, max(1, len(x)), size)):
        b, left = min(len(x), a + size), max(0, a - far)
        yield k, x[left : b + far], a - left, b - left, b == len(x)


DIGEST = "n_tokens long, ids_crc32 long, text_crc32 long"


def digest(c: Codec, ids: np.ndarray) -> tuple[int, int, int]:
    """Number of ids, crc32 of the ids (little-endian, 32 bits), crc32 of the text they decode to."""
    return len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(c.decode(ids.tolist()).encode())


def encode_short(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and their digest, in one pass."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for pdf in batches:
            texts = pdf["text"].tolist()
            ids = [i.astype(np.int32) for k in range(0, len(texts), TEXTS) for i in c.encode_many(texts[k : k + TEXTS])]
            out = pd.DataFrame([digest(c, i) for i in ids], columns=["n_tokens", "ids_crc32", "text_crc32"])
            yield out.assign(doc_id=pdf["doc_id"].array, ids=ids)

    return rows.mapInPandas(run, f"doc_id long, ids array<int>, {DIGEST}")


def encode_giant(rows: DataFrame, path: str, size: int = CHUNK) -> DataFrame:
    """The scan: chunks, matrices, edge states, backtraces."""
    key = ["doc_id", "h", "copy"]  # names one row, also among rows that repeat
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("doc_id")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for pdf in batches:
            for d, h, n, t in zip(pdf["doc_id"], pdf["h"], pdf["copy"], pdf["text"], strict=True):
                parts = chunks_of(c, t, size)
                while got := list(islice(parts, BLOCK)):
                    out = pd.DataFrame(got, columns=["chunk", "x", "s", "e", "final"])
                    out["m"] = [[dict(zip(("i", "j", "k", "q", "w"), z, strict=True)) for z in c.pieces.transfer(x, s, e, f)] for _, x, s, e, f in got]
                    yield out.assign(doc_id=d, h=h, copy=n, block=out["chunk"] // BLOCK)

    matrix = "array<struct<i:int,j:int,k:int,q:int,w:double>>"
    ids = "doc_id long, h long, copy int, block int, chunk int"
    cuts = materialize(rows.mapInPandas(cut, f"{ids}, x string, s int, e int, final boolean, m {matrix}"), "piece-chunks")

    def many(column) -> list[list[tuple]]:
        return [[(z["i"], z["j"], z["k"], z["q"], z["w"]) for z in m] for m in column]

    def head(pdf: pd.DataFrame, n: int) -> pd.DataFrame:
        """The key columns of the group, n times."""
        return pd.concat([pdf[[c for c in (*key, "block") if c in pdf]].iloc[:1]] * n, ignore_index=True)

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        total, *more = many(pdf.sort_values("chunk")["m"])
        for m in more:
            total = product(total, m)
        return head(pdf, 1).assign(m=[[dict(zip(("i", "j", "k", "q", "w"), z, strict=True)) for z in total]])

    def block_edges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        at = edge_states(many(pdf["m"]), (0, FRESH), None)
        return pdf[[*key, "block"]].assign(a=[{"o": o, "t": t} for o, t in at[:-1]], z=[{"o": o, "t": t} for o, t in at[1:]])

    def chunk_edges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        a, z = pdf["a"].iloc[0], pdf["z"].iloc[0]
        at = edge_states(many(pdf["m"]), (a["o"], a["t"]), (z["o"], z["t"]))
        return pdf[[*key, "chunk"]].assign(a=[{"o": o, "t": t} for o, t in at[:-1]], z=[{"o": o, "t": t} for o, t in at[1:]])

    blocks = cuts.groupBy(*key, "block").applyInPandas(multiply, f"doc_id long, h long, copy int, block int, m {matrix}")
    between = blocks.groupBy(*key).applyInPandas(block_edges, f"doc_id long, h long, copy int, block int, a {STATE}, z {STATE}")
    inner = cuts.join(between, [*key, "block"]).select(*key, "block", "chunk", "m", "a", "z")
    states = inner.groupBy(*key, "block").applyInPandas(chunk_edges, f"doc_id long, h long, copy int, chunk int, a {STATE}, z {STATE}")
    states = materialize(states, "piece-states")

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for pdf in batches:
            parts = [(x, s, e, (a["o"], a["t"]), (z["o"], z["t"])) for x, s, e, a, z in zip(pdf["x"], pdf["s"], pdf["e"], pdf["a"], pdf["z"], strict=True)]
            own = [i.astype(np.int32) for k in range(0, len(parts), BLOCK) for i in c.pieces.backtrace_many(parts[k : k + BLOCK])]
            yield pdf[["doc_id", "h", "copy", "chunk"]].assign(doc_id=pdf["doc_id"], ids=own)

    traced = cuts.join(states, [*key, "chunk"]).select(*key, "chunk", "x", "s", "e", "a", "z")
    traced = traced.mapInPandas(trace, "doc_id long, h long, copy int, chunk int, ids array<int>")
    parts = traced.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    return parts.select("doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def encode(docs: DataFrame, path: str, giant: int = GIANT, size: int = CHUNK) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32, text_crc32 of every row."""
    bounded_batches(docs.sparkSession)
    rows = sealed(id_text(docs))
    long = F.coalesce(F.length("text"), F.lit(0)) > giant

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for pdf in batches:
            out = pd.DataFrame([digest(c, np.asarray(i)) for i in pdf["ids"]], columns=["n_tokens", "ids_crc32", "text_crc32"])
            yield out.assign(doc_id=pdf["doc_id"].array, ids=pdf["ids"].array)

    joined = encode_giant(rows.where(long), path, size).mapInPandas(check, f"doc_id long, ids array<int>, {DIGEST}")
    out = unsealed(encode_short(rows.where(~long), path).unionByName(joined))
    return out.select("doc_id", "n_tokens", "ids_crc32", "text_crc32", "ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [c.decode(i.tolist()) for i in pdf["ids"]]})

    return unsealed(sealed(encoded.select("doc_id", "ids")).mapInPandas(run, "doc_id long, text string"))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: ids of every whole text of ``documents``, and a digest of what they decode to."""
    return encode(documents(spark, sf_dir), model_path())
