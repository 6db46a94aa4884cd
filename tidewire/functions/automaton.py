"""Dictionary terms by one automaton per text (F5, F6, X15, X16 with large dictionaries).

``terms.count_terms`` runs one regex per layer, and the layers grow with the dictionary.  Here all literal
entries are one Aho-Corasick automaton, so a text is read once however many entries there are; it is
built once per Python worker from the entries that come with the function.  Entries that are true regexes
keep a regex of their own, on the JVM.

A match counts as in Python's ``re``: entries between word boundaries need a change between word
characters (letters, digits, ``_``) and others at both ends, matches of one entry don't overlap, and an
entry that is listed twice counts twice.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .terms import Term, _is_word, pattern_terms, unicode_classes

_BUILT: dict[tuple, object] = {}


def _automaton(entries: tuple[tuple[str, bool], ...]):
    """The automaton of (text, bounded) entries; values are their lengths and places."""
    if entries not in _BUILT:
        import ahocorasick
        made = ahocorasick.Automaton()
        places: dict[str, list[int]] = {}
        for k, (text, _) in enumerate(entries):
            places.setdefault(text, []).append(k)
        for text, ks in places.items():
            made.add_word(text, (len(text), tuple(ks)))
        made.make_automaton()
        _BUILT.clear()  # one dictionary at a time is in use in a task
        _BUILT[entries] = made
    return _BUILT[entries]


def matches(text: str, entries: tuple[tuple[str, bool], ...]) -> dict[int, int]:
    """Entry's place -> its number of matches, of the entries found in ``text``."""
    found: dict[int, int] = {}
    ends: dict[int, int] = {}
    n = len(text)
    for last, (size, ks) in _automaton(entries).iter(text):
        a, b = last - size + 1, last + 1
        edge = None
        for k in ks:
            if entries[k][1]:
                if edge is None:
                    edge = ((_is_word(text[a - 1]) if a else False) != _is_word(text[a])) and ((_is_word(text[b]) if b < n else False) != _is_word(text[last]))
                if not edge:
                    continue
            if ends.get(k, 0) <= a:
                ends[k] = b
                found[k] = found.get(k, 0) + 1
    return found


def _split(terms: Sequence[Term]) -> tuple[tuple[tuple[str, bool], ...], list[int], list[Term]]:
    """Distinct literal entries, how often each is listed, and the others."""
    literal = Counter((t.text, t.bounded) for t in terms if t.raw is None and t.text)
    return tuple(literal), list(literal.values()), [t for t in terms if t.raw is not None]


def count_terms(col: Column | str, terms: Sequence[Term]) -> Column:
    """Sum over ``terms`` of non-overlapping match counts in ``col``; null counts 0."""
    entries, times, irregular = _split(terms)
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))

    @pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sum(times[k] * n for k, n in matches(t, entries).items()) for t in texts], dtype="int64")

    parts = [F.regexp_count(c, F.lit(t.regex)) for t in irregular]
    return reduce(lambda a, b: a + b, parts, count(c) if entries else F.lit(0).cast("long"))


def classify(col: Column | str, categories: dict[str, Sequence[str]], unknown: str = "UNKNOWN", lower: bool = True) -> Column:
    """Multi-label classification as ``terms.classify``: categories with a hit, in their order."""
    c = F.col(col) if isinstance(col, str) else col
    text = F.lower(c) if lower else c
    names = list(categories)
    of = {name: pattern_terms(pats) for name, pats in categories.items()}
    entries, _, _ = _split([t for ts in of.values() for t in ts])
    owners: list[list[int]] = [[i for i, name in enumerate(names) if any(t.raw is None and (t.text, t.bounded) == e for t in of[name])] for e in entries]

    @pandas_udf("array<int>")
    def hit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sorted({i for k in matches(t, entries) for i in owners[k]}) for t in texts])

    hits = hit(F.coalesce(text, F.lit("")))
    labels = []
    for i, name in enumerate(names):
        test = F.array_contains(hits, i)
        raws = [t.raw for t in of[name] if t.raw is not None]
        if raws:
            test = test | text.rlike(unicode_classes("|".join(f"(?:{r})" for r in raws)))
        labels.append(F.when(test, F.lit(name)))
    arr = F.array_compact(F.array(*labels)) if labels else F.array().cast("array<string>")
    return F.when(c.isNull() | (F.size(arr) == 0), F.array(F.lit(unknown))).otherwise(arr)
