"""Exact dictionary term counting and multi-label classification.

The reference sums, over every dictionary entry, the number of regex matches
in a text column (one pass per entry).  One Spark expression per entry makes
a plan with hundreds of regex scans; one big alternation is *wrong*, because
an alternation consumes text and so hides overlapping entries (``BARKING``
inside ``BARKING RIVERSIDE`` must count for both) and repeated entries (an
entry listed twice counts twice).

Here the entries are split into *layers*: inside a layer no two entries can
overlap in any text, so one ``regexp_count`` over the layer's alternation
counts every entry of the layer exactly.  The result is
``sum(regexp_count(text, layer_i))`` -- a handful of JVM-side expressions,
planned once, evaluated inside whole-stage codegen.  Layering is plan-time
Python over the (small) dictionary, not per-row work.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = set("\\.^$|?*+()[]{}")


def escape(term: str) -> str:
    """Escape a literal so Java, Python and RE2 all read it literally."""
    return "".join("\\" + ch if ch in _META else ch for ch in term)


_CLASS_ESCAPE = re.compile(r"\\[wWdDsSbB]")


def unicode_classes(pattern: str) -> str:
    """Python's ``\\w``/``\\d``/``\\s``/``\\b`` are Unicode-aware; Java's are ASCII (``\\b`` from Java 19)
    unless ``(?U)`` is set, so patterns using them get the flag."""
    return "(?U)" + pattern if _CLASS_ESCAPE.search(pattern) else pattern


def _is_word(ch: str) -> bool:
    return ch == "_" or ch.isalnum()


_WORD_PATTERN = re.compile(r"^\\b(.+)\\b$")
_REGEX_SYNTAX = re.compile(r"(?<!\\)[.^$|?*+()\[\]{}]|\\[^\\.^$|?*+()\[\]{}]")


@dataclass(frozen=True)
class Term:
    """A dictionary entry reduced to what layering needs.

    ``text`` is the literal the entry matches; ``bounded`` says whether it
    must sit between word boundaries (``\\bTEXT\\b``).  ``raw`` keeps an
    irregular regex that is not a plain literal; such entries get a layer of
    their own.
    """

    text: str
    bounded: bool
    raw: str | None = None

    @property
    def regex(self) -> str:
        if self.raw is not None:
            return unicode_classes(self.raw)
        body = escape(self.text)
        return rf"(?U)\b{body}\b" if self.bounded else body


def term_from_pattern(pattern: str) -> Term:
    r"""Classify a regex dictionary entry: ``\bliteral\b``, plain literal, or raw."""
    m = _WORD_PATTERN.match(pattern)
    inner = m.group(1) if m else pattern
    if _REGEX_SYNTAX.search(inner):
        # e.g. r"\bstab(bed|bing)\b": keep as its own regex.
        unesc = None
    else:
        unesc = inner.replace("\\", "")
    if unesc is None:
        return Term(text=pattern, bounded=False, raw=pattern)
    if m and unesc and _is_word(unesc[0]) and _is_word(unesc[-1]):
        return Term(text=unesc, bounded=True)
    if m:
        return Term(text=pattern, bounded=False, raw=pattern)
    return Term(text=unesc, bounded=False)


def _can_overlap(a: Term, b: Term) -> bool:
    """True if some text holds a match of ``a`` and one of ``b`` that overlap."""
    if a.raw is not None or b.raw is not None:
        return True
    x, y = a.text, b.text
    for k in range(-(len(y) - 1), len(x)):
        # y starts at offset k relative to x.
        lo, hi = min(0, k), max(len(x), k + len(y))
        merged: dict[int, str] = {}
        ok = True
        for i, ch in enumerate(x):
            merged[i] = ch
        for j, ch in enumerate(y):
            p = k + j
            if p in merged and merged[p] != ch:
                ok = False
                break
            merged[p] = ch
        if not ok:
            continue
        if a.bounded or b.bounded:
            edges = []
            if a.bounded:
                edges += [0, len(x)]
            if b.bounded:
                edges += [k, k + len(y)]
            for p in edges:
                if lo < p < hi and _is_word(merged[p - 1]) == _is_word(merged[p]):
                    ok = False
                    break
        if ok:
            return True
    return False


def layer_terms(terms: Sequence[Term]) -> list[list[Term]]:
    """Greedy colouring: each term goes to the first layer it cannot overlap."""
    layers: list[list[Term]] = []
    for t in terms:
        for layer in layers:
            if t.raw is None and layer[0].raw is None and not any(_can_overlap(t, o) for o in layer):
                layer.append(t)
                break
        else:
            layers.append([t])
    return layers


def trie_alternation(words: Iterable[str]) -> str:
    """Prefix-factored alternation of literals (``NEW(?:HAM)?|...``).

    A flat alternation makes the regex engine try every term at every text
    position; the trie shares prefixes, so a position is rejected after its
    first character in most branches.  Inside a layer at most one term can
    match at a position, so the trie matches exactly what the flat
    alternation matches.
    """
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        alts = [escape(ch) + emit(child) for ch, child in sorted(node.items()) if ch != ""]
        if not alts:
            return ""
        end = "" in node
        if len(alts) == 1 and not end:
            return alts[0]
        return "(?:" + "|".join(alts) + ")" + ("?" if end else "")
    return emit(root)


def layer_regexes(layers: Iterable[Sequence[Term]]) -> list[str]:
    out = []
    for layer in layers:
        if len(layer) == 1:
            out.append(layer[0].regex)
            continue
        bounded = layer[0].bounded
        body = trie_alternation(t.text for t in layer)
        out.append(rf"(?U)\b(?:{body})\b" if bounded else f"(?:{body})")
    return out


def word_terms(words: Iterable[str]) -> list[Term]:
    r"""Entries that are matched as ``\bWORD\b`` (location style)."""
    return [Term(text=w, bounded=True) for w in words]


def substring_terms(words: Iterable[str]) -> list[Term]:
    """Entries matched as plain substrings (theme style)."""
    return [Term(text=w, bounded=False) for w in words]


def pattern_terms(patterns: Iterable[str]) -> list[Term]:
    return [term_from_pattern(p) for p in patterns]


def count_terms(col: Column | str, terms: Sequence[Term]) -> Column:
    """Exact sum over ``terms`` of non-overlapping match counts in ``col``.

    Null input counts 0 (the reference fills nulls with ``""`` first).
    """
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    regs = layer_regexes(layer_terms(list(terms)))
    if not regs:
        return F.lit(0)
    parts = [F.regexp_count(c, F.lit(r)) for r in regs]
    return reduce(lambda a, b: a + b, parts)


def classify(col: Column | str, categories: dict[str, Sequence[str]],
             unknown: str = "UNKNOWN", lower: bool = True) -> Column:
    """Multi-label classification, dictionary order, first hit per category.

    Returns ``array<string>``; a text with no hit (or null) gets
    ``[unknown]``.  One alternation per category: existence needs no layering.
    """
    c = F.col(col) if isinstance(col, str) else col
    text = F.lower(c) if lower else c
    hits = []
    for cat, pats in categories.items():
        if not pats:
            continue
        test = text.rlike(unicode_classes("|".join(f"(?:{p})" for p in pats)))
        cores = [term_from_pattern(p) for p in pats]
        if all(t.raw is None for t in cores):
            # literal entries: a byte search for any literal gates the regex,
            # so most texts of a rare category never run it
            gate = reduce(lambda a, b: a | b, [F.contains(text, F.lit(t.text)) for t in cores])
            test = gate & test
        hits.append(F.when(test, F.lit(cat)))
    arr = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return F.when(c.isNull() | (F.size(arr) == 0), F.array(F.lit(unknown))).otherwise(arr)


def keyword_patterns(categories: dict[str, Sequence[str]]) -> list[str]:
    """Sorted distinct lower-cased patterns of all categories (keyword count)."""
    return sorted({p.lower() for pats in categories.values() for p in pats})
