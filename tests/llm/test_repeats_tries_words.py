"""Operators 11 to 13 against brute force, and on nulls, ties, repeats and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewire.llm import prefix_trie, recompression, spelling_variants

SF = "/root/testdata/sf0.001"
WS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, symbol long, h long, start int, first int"


# ---- 11 substring dedup

def plain_repeats(texts, size):
    """(n_words, n_removed, kept_sha256) of each text, by a table of all windows."""
    docs = [WS.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(ws[i : i + size]) for ws in docs for i in range(len(ws) - size + 1))
    out = []
    for ws in docs:
        gone = set()
        for i in range(len(ws) - size + 1):
            if seen[tuple(ws[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check_repeats(spark, texts, size, rounds=recompression.ROUNDS):
    docs = spark.createDataFrame([(k, t, 1, 2, 3, 4) for k, t in enumerate(texts)], DOCS).repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.repeats(docs, size, rounds).collect()}
    assert [got[k] for k in range(len(texts))] == plain_repeats(texts, size)


def test_repeats_on_the_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.query(spark, SF).collect()}
    assert [got[r.doc_id] for r in rows] == plain_repeats([r.text for r in rows], recompression.WINDOW)


@pytest.mark.parametrize(("size", "letters", "rounds"), [(5, 3, 2), (6, 1, 3), (9, 2, 3), (35, 4, 3), (35, 40, 4), (12, 5, 0)])
def test_repeats_of_any_kind(spark, monkeypatch, size, letters, rounds):
    """Few different words, so that windows repeat inside texts, overlap and share symbols with others;
    runs of one word; repeats with one word changed; pieces smaller than texts."""
    rng = random.Random(size * 100 + letters)
    word = lambda: f"w{rng.randrange(letters)}"
    base = [word() for _ in range(150)]
    texts = ["", None, " ", base[0], " ".join(base), " ".join(base), " ".join(["again"] * 90), " ".join(["one", "two"] * 60)]
    for _ in range(24):
        a, b = rng.randrange(100), rng.randrange(100)
        part = base[a : a + rng.randrange(60)]
        if len(part) > 5 and rng.random() < 0.5:
            part[rng.randrange(len(part))] = "changed"
        texts.append(rng.choice([" ", "\n", " \t "]).join([word() for _ in range(rng.randrange(30))] + part + base[b : b + rng.randrange(60)]))
    check_repeats(spark, texts, size, rounds)


def test_pieces_of_long_texts(spark):
    """The cut of a long text into pieces doesn't show: equal windows have equal symbols in every cut."""
    rng = random.Random(8)
    ws = [f"w{rng.randrange(3)}".encode() for _ in range(2000)]
    names = recompression.WordNames()(ws)

    def symbols(piece):
        old, recompression.PIECE = recompression.PIECE, piece
        try:
            (symbol, _, start, size), = recompression.parsed([names], 35)
        finally:
            recompression.PIECE = old
        return {i: s for s, a, n in zip(symbol.tolist(), start.tolist(), size.tolist()) for i in range(a, a + n)}

    whole = symbols(10_000)
    assert len(whole) == 1966
    assert symbols(64) == whole and symbols(501) == whole
    long = " ".join(f"x{k}" for k in range(recompression.PIECE + 500))
    shifted = "a b c " + long
    check_repeats(spark, [long, shifted, long[:5000]], 35)


def test_kept_texts_and_clashing_columns(spark):
    shared = " ".join(f"s{k}" for k in range(40))
    rows = [(1, f"before {shared} after", 1, 1, 1, 1), (2, f"other   {shared}", 1, 1, 1, 1), (None, "short\n text", 1, 1, 1, 1), (3, None, 1, 1, 1, 1), (None, f"null id {shared}", 1, 1, 1, 1)]
    out = recompression.without_repeats(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "symbol", "h", "start", "first"]
    assert sorted(map(str, [(r.doc_id, r.text) for r in out.collect()])) == sorted(map(str, [(1, "before after"), (2, "other"), (None, "short\n text"), (3, None), (None, "null id")]))


def test_rows_that_repeat_go(spark):
    text = " ".join(f"s{k}" for k in range(35))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text + " more"), (3, text[:-4])], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in recompression.repeats(docs).collect())
    assert got == [(1, 35, 35), (1, 35, 35), (2, 36, 35), (3, 34, 0)]
    assert recompression.repeats(docs.limit(0)).count() == 0


# ---- 12 prefix trie

def plain_trie(rows, rebuild=True):
    """Rows of the trie of (conv_id, turn, role, text), node by node."""
    convs = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - c % 5, [])[:h] + mine[h:] if rebuild else mine
    members = collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    kids = collections.Counter(n[:-1] for n in members if n)
    out = set()
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in cs if len(paths[c]) == len(node))))
        out.add((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), kids[node], sum(not kids[n] for n in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_rows(df):
    got = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(got) == len(set(got))
    return set(got)


CONVS = "conv_id long, turn long, role string, text string, node string, cls long, path string"


def test_trie_of_the_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(prefix_trie.query(spark, SF)) == plain_trie(rows)


@pytest.mark.parametrize("rebuild", [True, False])
@pytest.mark.parametrize("seed", range(3))
def test_trie_of_any_shape(spark, rebuild, seed):
    """Long shared paths that part inside blocks, at their edges and at the root; conversations that end inside
    others; copies; null turns, roles and texts; a conversation of another's turns only."""
    rng = random.Random(seed)
    stem = [(rng.choice("ua"), f"turn {k} é") for k in range(40)]
    rows = []
    for c in rng.sample(range(3000 if seed else 90), 70):
        p = stem[: rng.choice([0, 1, 3, 4, 5, 8, 9, 12, 40])] + [(rng.choice("ua"), rng.choice(["x", "y", "", None])) for _ in range(rng.choice([0, 0, 1, 2, 6]))]
        p = p or [(None, None)]
        rows += [(c, None if t == 0 and seed == 1 else t * 2, r, x, "n", 1, "p") for t, (r, x) in enumerate(p)]
    rows += [(5000 + k, 0, "u", "same", "n", 1, "p") for k in range(0, 400, 3)] + [(None, 0, "u", "nobody's", "n", 1, "p")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, CONVS).repartition(5)
    assert trie_rows(prefix_trie.trie(df, rebuild)) == plain_trie([r[:4] for r in rows], rebuild)


def test_trie_ends_over_many_chunks(spark):
    """Ids of one end in several chunks, in numerical order, through one hash."""
    ids = [k * 700 for k in range(60)] + [3, 10**12]
    df = spark.createDataFrame([(c, 1, "u", "hello") for c in ids], "conv_id long, turn long, role string, text string").repartition(4)
    assert trie_rows(prefix_trie.trie(df, False)) == plain_trie([(c, 1, "u", "hello") for c in ids], False)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], CONVS)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "u", "x")], "conv_id long, turn long, role string, text string")).count() == 0


# ---- 13 spelling variants

def plain_counts(rows):
    lower = {c: c + 32 for c in range(65, 91)}
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-z\u00C0-\u00FF]+", text or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def plain_variants(rows):
    """Rows by the deletions of each word: words one edit apart share one of them, or one is the other's."""
    n = plain_counts(rows)
    cut = collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            cut[w[:i], w[i + 1 :]].add(w)  # replaced at i
            cut["", w[:i] + w[i + 1 :], "short"].add(w)
    near = collections.defaultdict(set)
    for key, ws in cut.items():
        if len(key) == 2:
            for w in ws:
                near[w] |= ws - {w}
        elif key[1] in n:
            for w in ws:
                near[w].add(key[1])
                near[key[1]].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def variant_rows(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_variants_of_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain_variants(rows)
    assert sum(w[4] for w in want) > 100
    assert variant_rows(spelling_variants.query(spark, SF)) == want


@pytest.mark.parametrize("seed", range(3))
def test_variants_of_similar_words(spark, seed):
    """Words of few letters, so that bigrams repeat inside words and tie in rarity; chains of forms; ties."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé"[: 2 + seed % 2]) for _ in range(rng.randrange(5, 10))) for _ in range(250)} | {"×÷×÷×÷", "ÀÀÀÀÀÀ", "ααααααα"}
    rows = [(None, None), (1, ""), (None, "Ending ending ENDING endıng " * 3)]
    for k, w in enumerate(sorted(words)):
        times = 5 ** rng.randrange(1, 5) if k % 3 else 6
        rows.append((k if k % 7 else None, " ".join([w.upper() if w.isascii() and k % 2 else w] * times)))
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n long").repartition(4)
    want = plain_variants(rows)
    assert any(w[1] and w[2] != w[1] for w in want)
    assert variant_rows(spelling_variants.variants(df)) == want
    assert spelling_variants.variants(df.limit(0)).count() == 0


def test_misspelt_words(spark):
    """Occurrences that lose a letter are counted as what is left."""
    rows = [(k, "considered ÉCONOMIE " * 3) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = plain_variants(rows)
    assert len(want) > 2 and variant_rows(spelling_variants.variants(df)) == want


def test_pivots_are_disjoint_and_rarest():
    rng = random.Random(3)
    for _ in range(500):
        ranks = [rng.randrange(6) for _ in range(rng.randrange(5, 12))]
        places = spelling_variants.prefix_of(ranks)
        got = spelling_variants.pivots_of(places, ranks)
        pairs = [(ranks[p] + ranks[q]) for i, p in enumerate(places) for q in places[i + 1 :] if q - p >= 2]
        assert got[1] - got[0] >= 2 and sum(ranks[p] for p in got) == min(pairs) and set(got) <= set(places)
