"""Every operator and stage on nulls, empty and long texts, repeated rows, ties, empty
tables and clashing extra columns; results that every operator must keep."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import decontaminate, language_id, line_dedup, ngram_join, pii, prefix_trie, quality_rules, recompression, secret_scan, sentence_pieces, sharding, spelling_variants, token_store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, gone int, line_no int, token long, _q string"
PROSE = "the quick brown fox jumps over a lazy dog while seven wizards quietly box with five jumping onyx cats near old mills"


def rows():
    long_text = " ".join(f"word{k % 977} and{k}" for k in range(30_000))
    texts = [PROSE, None, "", PROSE, "  \n \t\n", "one", long_text, PROSE + " today", "x" * 5000, "naïve café 中文 🙂   end. " + PROSE.upper()]
    out = [(k, t, "en" if k % 2 else None, "s", None if t is None else len(t), "clash", 1, 2, 3, "q") for k, t in enumerate(texts)]
    return [*out, (None, PROSE, "en", None, None, None, None, None, None, None), out[0], (5, "another text of the same id " + PROSE[::-1], "en", "s", 0, "clash", 1, 2, 3, "q")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    """A folder of tables with the edge rows, and one with empty tables."""
    out = {}
    for name, frame in (("edge", docs), ("none", docs.limit(0))):
        d = str(tmp_path_factory.mktemp(name))
        frame.write.parquet(f"{d}/documents.parquet")
        labels = spark.createDataFrame([(0, 1, 0), (None, 1, 0), (3, None, 0), (4, 0, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
        bench = spark.createDataFrame([(1, PROSE), (1, PROSE), (None, "a b c"), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
        (labels if name == "edge" else labels.limit(0)).write.parquet(f"{d}/labels.parquet")
        (bench if name == "edge" else bench.limit(0)).write.parquet(f"{d}/benchmark.parquet")
        out[name] = d
    return out


QUERIES = [secret_scan.query, quality_rules.query, pii.query, sharding.query, sentence_pieces.query, language_id.query, ngram_join.query, line_dedup.query, decontaminate.query, token_store.query, recompression.query]


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.__module__.rsplit(".", 1)[-1])
def test_queries_give_a_row_for_each_row(spark, tables, query):
    got = query(spark, tables["edge"]).collect()
    want = sorted(str(r[0]) for r in rows())
    assert sorted(str(r["doc_id"]) for r in got) == want
    assert query(spark, tables["none"]).count() == 0


def test_nulls_and_empties(spark, tables):
    by = lambda q, *cols: {(r["doc_id"], *(r[c] for c in cols)) for r in q(spark, tables["edge"]).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (4, "und", 0.0)} <= by(language_id.query, "lang_pred", "score")
    assert {(1, 0, 1), (2, 0, 2), (4, 0, 4), (3, 19, 0), (7, 20, 0), (None, 19, 0)} <= by(ngram_join.query, "n_shingles", "component_id")
    assert {(1, False), (2, False), (4, False)} <= by(decontaminate.query, "contaminated")
    assert {(0, True), (3, True), (None, True)} <= by(decontaminate.query, "contaminated")
    assert {(1, 1, zlib.crc32(b"\2\0\0\0")), (2, 1, zlib.crc32(b"\2\0\0\0"))} <= by(token_store.query, "n_tokens", "ids_crc32")
    assert {(1, 0, 0), (2, 0, 0)} <= by(sentence_pieces.query, "n_tokens", "ids_crc32")
    assert {(1, 16, 0), (2, 16, 0)} <= by(sharding.query, "size", "text_crc32")
    assert {(1, 0, True, False), (2, 0, True, False), (4, 0, True, False), (5, 1, True, False)} <= by(quality_rules.query, "n_words", "base_failed", "kept")
    # the first line of its kind stays: the null id comes first; the blank lines stay
    assert {(None, ""), (0, "0"), (3, "0"), (4, ""), (7, "0")} <= by(line_dedup.query, "removed")


def test_slots_are_gapless(spark, tables):
    got = sharding.query(spark, tables["edge"]).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()
    assert all(r.n == r.d == r.m + 1 for r in got)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_columns(spark, docs, tables, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, tables["edge"])
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    kept = [r.doc_id for r in out.select("doc_id").collect()]
    want = {"quality_rules": [3, 5, 6, 7, 9, 0, 0, None], "line_dedup": [None, 1, 2, 4, 5, 5, 6, 8, 9], "ngram_jaccard_join": [0, 1, 2, 4, 5, 5, 6, 8, 9],
            "benchmark_decontamination": [1, 2, 4, 5, 5, 6, 8], "sentencepiece": [r[0] for r in rows()]}[name]
    assert sorted(map(str, kept)) == sorted(map(str, want)), name
    assert stage(spark, docs.limit(0), tables["none"]).count() == 0


def test_pipeline_runs(spark, tables):
    out = corpus_pipeline.run(spark, tables["edge"])
    assert {r.doc_id for r in out.collect()} == {5, 6}
    assert corpus_pipeline.run(spark, tables["none"]).count() == 0
