"""Layered term counting and classification against brute-force Python."""

import random
import re

from pyspark.sql import functions as F

from tidewire.functions import terms as TM

WORDS = ["BARKING", "RIVERSIDE", "BARKING RIVERSIDE", "ISLINGTON", "NEW", "NEW CROSS", "CROSS",
         "HAM", "EAST HAM", "ÉCOLE", "A", "A A", "ST. JOHN'S", "KING'S CROSS"]
FILLER = ["THE", "OF", "É", "BARKINGS", "XHAM", "HAM_", "123", "CROSSROAD", "ISLINGTONIAN"]
SEPS = [" ", ", ", "; ", "#", "-", "  ", "\n", ".", "_", "é"]


def _texts(n, seed=7):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        parts = [rnd.choice(WORDS + FILLER) for _ in range(rnd.randint(0, 25))]
        text = ""
        for p in parts:
            text += p + rnd.choice(SEPS)
        out.append(text)
    return out + ["", "A A A", "BARKING RIVERSIDE", "NEW CROSS CROSS NEW"]


def _brute_words(text, terms):
    return sum(len(re.findall(r"\b" + re.escape(t) + r"\b", text)) for t in terms)


def _brute_sub(text, terms):
    return sum(len(re.findall(re.escape(t), text)) for t in terms)


def test_word_layers_exact(spark):
    terms = ["BARKING", "BARKING RIVERSIDE", "ISLINGTON", "ISLINGTON", "NEW CROSS", "NEW", "CROSS",
             "EAST HAM", "HAM", "A A", "A", "ÉCOLE", "ST. JOHN'S", "KING'S CROSS"]
    texts = _texts(400)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(df.select("i", TM.count_terms("t", TM.word_terms(terms)).alias("n")).collect())
    for i, t in enumerate(texts):
        assert got[i] == _brute_words(t, terms), t
    assert len(TM.layer_terms(TM.word_terms(terms))) < len(terms)


def test_substring_layers_exact(spark):
    terms = ["CRIME", "HATE_CRIME", "VIOLENCE", "GANG_VIOLENCE", "HAM", "AM", "THE", "HE"]
    rnd = random.Random(3)
    alphabet = ["CRIME", "HATE_", "VIOLENCE", "GANG_", ";", ",1", "THE", "HAM", "AM", "X"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(df.select("i", TM.count_terms("t", TM.substring_terms(terms)).alias("n")).collect())
    for i, t in enumerate(texts):
        assert got[i] == _brute_sub(t, terms)


def test_null_counts_zero(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(TM.count_terms("t", TM.word_terms(["A"]))).first()[0] == 0


CATS = {
    "THEFT": [r"\btheft\b", r"\bshoplift\w*"],
    "BURGLARY": [r"\bburglar\w*", r"\bshoplift\w*"],
    "ODD": [r"\bfalse ID\b"],
    "WEAPON": [r"\bknife\b", r"\bstab(bed|bing)\b"],
}


def test_classify_and_keyword_count(spark):
    want = [("Shoplifter caught", ["THEFT", "BURGLARY"], 1), ("man stabbed with knife", ["WEAPON"], 2),
            ("False ID used in theft", ["THEFT"], 2),  # the keyword is lowered, the category's pattern isn't
            ("nothing here", ["UNKNOWN"], 0), (None, ["UNKNOWN"], 0), ("", ["UNKNOWN"], 0),
            ("burglars and burglary", ["BURGLARY"], 2), ("stabbing stabbed knife knife", ["WEAPON"], 4)]
    df = spark.createDataFrame([(h,) for h, *_ in want], "h string")
    kw = TM.pattern_terms(TM.keyword_patterns(CATS))
    rows = df.select(TM.classify("h", CATS).alias("c"),
                     TM.count_terms(F.lower(F.coalesce("h", F.lit(""))), kw).alias("k")).collect()
    assert [(list(r["c"]), r["k"]) for r in rows] == [(c, k) for _, c, k in want]


def _rule_dictionary(n=300):
    """A large place-like dictionary built from a rule: syllable pairs and
    two-word names, with some repeats (weights) and prefix families."""
    syl = ["BAR", "KING", "HAM", "TON", "NEW", "CROSS", "ST", "GREEN", "WOOD", "LEY", "FORD", "BROOK"]
    out = []
    for a in syl:
        for b in syl:
            out.append(a + b)
            if len(out) % 3 == 0:
                out.append(f"{a} {b}")
    out += out[:12]  # repeated entries count twice
    return out[:n]


def test_large_dictionary_trie_layers_exact(spark):
    terms = _rule_dictionary()
    rnd = random.Random(9)
    syl = ["BAR", "KING", "HAM", "TON", "NEW", "CROSS", "ST", "GREEN", "WOOD", "LEY", "FORD", "BROOK", "X"]
    texts = []
    for _ in range(300):
        words = ["".join(rnd.choice(syl) for _ in range(rnd.randint(1, 2))) for _ in range(rnd.randint(0, 40))]
        texts.append("".join(w + rnd.choice([" ", ", ", ";", "  "]) for w in words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(df.select("i", TM.count_terms("t", TM.word_terms(terms)).alias("n")).collect())
    for i, t in enumerate(texts):
        assert got[i] == _brute_words(t, terms)
    layers = TM.layer_terms(TM.word_terms(terms))
    assert len(layers) < 10 and max(len(x) for x in layers) > 100
