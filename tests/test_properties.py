"""Property tests (hypothesis): layering invariants and summary structure."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire import schema as S
from tidewire.functions import terms as TM
from tidewire.operators import duplicates as D
from tidewire.operators import summaries as SU

ALPHA = st.sampled_from(["A", "B", "AB", "BA", "É", "_", "1"])
TERM = st.lists(ALPHA, min_size=1, max_size=3).map("".join)
WORD_TERM = st.lists(st.sampled_from(["A", "AB", "B", "BAB", "É"]), min_size=1, max_size=2).map(" ".join)
TEXT = st.lists(st.sampled_from(["A", "B", "AB", "BA", " ", ",", "É", "_", "1", "A B", ";"]), max_size=30).map("".join)


def _py_layer_count(text, terms):
    # Python's re reads the same layer regexes as Java for these patterns; its classes are
    # Unicode-aware without Java's (?U) flag
    return sum(len(re.findall(r.removeprefix("(?U)"), text)) for r in TM.layer_regexes(TM.layer_terms(terms)))


@settings(max_examples=400, deadline=None)
@given(st.lists(WORD_TERM, min_size=1, max_size=8), TEXT)
def test_word_layers_equal_per_term_sum(words, text):
    terms = TM.word_terms(words)
    brute = sum(len(re.findall(r"\b" + re.escape(w) + r"\b", text)) for w in words)
    assert _py_layer_count(text, terms) == brute


@settings(max_examples=400, deadline=None)
@given(st.lists(TERM, min_size=1, max_size=8), TEXT)
def test_substring_layers_equal_per_term_sum(words, text):
    terms = TM.substring_terms(words)
    brute = sum(len(re.findall(re.escape(w), text)) for w in words)
    assert _py_layer_count(text, terms) == brute


@settings(max_examples=200, deadline=None)
@given(st.lists(TERM, min_size=1, max_size=12, unique=True))
def test_trie_matches_same_language(words):
    pat = re.compile("^(?:" + TM.trie_alternation(words) + ")$")
    for w in words:
        assert pat.match(w)
    for w in ["", "Z", "AAAAAAA"]:
        assert bool(pat.match(w)) == (w in words)


def test_summary_structure(spark):
    from test_summaries import SCHEMA, _fixture
    df = spark.createDataFrame(_fixture(21, 600), SCHEMA)
    s = SU.headline_summary(df)
    # daily ranks stay within 1..k (the final per-(Month, Rank_Month) pick may
    # drop daily rows, so gaps are allowed in the merged output)
    assert s.where((F.col("Rank_Day") < 1) | (F.col("Rank_Day") > 3)).count() == 0
    assert s.where(F.col("Top_Day") != F.col("Rank_Day").isNotNull()).count() == 0
    # one row per (Month, Rank_Month), null Rank_Month included
    assert s.groupBy("Month", "Rank_Month").count().where("count > 1").count() == 0
    # every monthly top-3 row survives the merge (full outer conservation)
    f = SU.known_duplicates(df).withColumn("Month", F.date_trunc("MM", S.DATE).cast("timestamp_ntz"))
    months = f.select("Month").distinct().count()
    tops = s.where(F.col("Top_Month")).count()
    assert tops <= 3 * months and tops >= months


def test_dup_flag_is_count_gt_one(spark):
    rows = [(str(i), h) for i, h in enumerate(["a", "a", "b", None, None, "c", "", ""])]
    df = spark.createDataFrame(rows, "GKGRECORDID string, headline string")
    got = {r[0]: r[1] for r in D.flag_duplicates(df).select(S.RID, S.DUP).collect()}
    counts = {}
    for _, h in rows:
        counts[h] = counts.get(h, 0) + 1
    assert got == {i: counts[h] > 1 for i, h in rows}
