"""Sharding against a plain descent, slots of hot rows, benchmark overlaps against all alignments."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

from tidewire.llm import decontaminate, sharding

SF = "/root/testdata/sf0.001"


def descend(key, t):
    def draw(level, children):
        bits = lambda c: int(hashlib.md5(f"{key}/{level}{c}".encode()).hexdigest()[:12], 16)
        return min((-math.log((bits(c) + 0.5) / 2**48) / w, c) for c, w in children.items())[1]

    region = draw("region", {r: sum(sum(x.values()) for x in racks.values()) for r, racks in t.items()}) if len(t) > 1 else next(iter(t))
    racks = t[region]
    rack = draw("rack", {k: sum(x.values()) for k, x in racks.items()}) if len(racks) > 1 else next(iter(racks))
    return draw("shard", racks[rack]) if len(racks[rack]) > 1 else next(iter(racks[rack]))


def test_sharding_equals_a_plain_descent(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    small, big = sharding.tree(), sharding.grow(sharding.tree(), sharding.SHARDS)
    got = sharding.query(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (descend(r.doc_id, small), descend(r.doc_id, big))
    seen = collections.defaultdict(list)
    for r in got:
        seen[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in seen.values())


@pytest.mark.parametrize("bucket_rows", [7, 50_000])
def test_slots_of_hot_rows_are_gapless_and_repeatable(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(sharding, "RUN", 10)
    rows = [(None, "copy")] * 101 + [(None, None)] * 10 + [(3, "copy")] * 20 + [(k, f"text {k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    run = lambda: [tuple(r) for r in sharding.shard_documents(docs, sharding.tree(), sharding.grow(sharding.tree(), 40)).collect()]
    got = run()
    assert len(got) == len(rows) and sorted(got, key=str) == sorted(run(), key=str)
    seen = collections.defaultdict(list)
    for r in got:
        seen[r[4]].append(r[5])
    assert all(sorted(s) == list(range(len(s))) for s in seen.values())


def all_alignments(text, items):
    ws, found = decontaminate.words_of(text), {}
    for item_id, own in items:
        span = min(decontaminate.SPAN, len(own))
        most = 0
        for start in range(span - len(own), len(ws) - span + 1):
            a, b = max(0, -start), min(len(own), len(ws) - start)
            if b - a < span:
                continue
            same = np.cumsum([0] + [own[k] == ws[start + k] for k in range(a, b)])
            most = max(most, int((same[span:] - same[:-span]).max()))
        if most >= decontaminate.SHARE * span:
            found[item_id] = max(most, found.get(item_id, 0))
    return found


@pytest.mark.parametrize("block_words,pairs", [(500_000, 1_000_000), (60, 3)])
def test_overlaps_equal_all_alignments(spark, monkeypatch, block_words, pairs):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(12).collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").orderBy("item_id").limit(8).collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(10**6 + r.item_id, f"so {r.text} it goes") for r in bench] + [(-1, "la " * 300), (-2, None), (-3, "")]
    items = [(r.item_id, r.text) for r in bench] + [(10**6, "la " * 40), (10**6 + 1, "la la la")]
    got = decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    plain = [(i, decontaminate.words_of(t)) for i, t in items]
    assert {r.doc_id: {h["item"]: h["matched"] for h in r["_hits"]} for r in got} == {d: all_alignments(t, [x for x in plain if x[1]]) for d, t in rows}
    assert sum(bool(r["_hits"]) for r in got) >= len(bench)


@pytest.mark.parametrize("text_words", [1, 40, 10**6])
def test_texts_hashed_together_keep_apart(monkeypatch, text_words):
    """Many texts in one go give what each gives alone; an item cut by the end of a text is in neither part."""
    monkeypatch.setattr(decontaminate, "TEXT_WORDS", text_words)
    item, other = [f"w{k}" for k in range(16)], [f"o{k}" for k in range(5)]
    block = decontaminate.Benchmark([(1, item), (2, other)])
    texts = [" ".join(item[:8]), " ".join(item[8:]), None, "", " ".join(other), "x " + " ".join(item), " ".join(other + item), " ".join(item[:8]), "x y"]
    got = list(block.of_texts(texts))
    assert got == [block.overlaps(t) for t in texts]
    assert got == [{}, {}, {}, {}, {2: 5}, {1: 13}, {1: 13, 2: 5}, {}, {}]
