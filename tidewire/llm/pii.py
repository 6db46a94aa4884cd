"""Personal data (operator 3): rules, then offset-preserving deobfuscation.

Base spans come from four fixed rules over the text as it is.  The transducers then
rewrite a copy: look-alike letters and digits of other scripts become ASCII, invisible
characters go, runs of spelled digits become digits, letters standing for digits
within numbers become digits, and ``[at]`` / ``dot`` disguises become ``@`` and ``.``.  Each
transducer keeps, for every piece of its output, the source characters it came from.
The rules run again over the copy; what they find there is mapped back to source
offsets and added unless it lies in a base span of its kind.

Nulls: a null text is empty; a null doc_id is kept.  Repeated rows each give their own
result row; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.common import bounded_batches, documents, id_text, sealed, sha_spans, unsealed

KINDS = ("email", "ip", "card", "phone")
# fixed values: the rules' patterns
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the whole run of local characters before it, the domain after
    (what leftmost matching finds, without trying every start of a long run)."""
    free, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and LOCAL.match(text, a - 1):
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            free = m.end()
        else:
            free = at + 1  # no later match starts in a run that this @ ends
        at = text.find("@", free)


def rules(text: str) -> list[tuple[str, int, int]]:
    """Spans of the rules, by start, then in the order of KINDS."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[ -]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


# ---- transducers ---------------------------------------------------------------

# fixed values: look-alikes of other scripts
LOOKALIKE = dict(zip("аеорсухіјѕԁһӏԛԝАВЕКМНОРСТУХЅІЈαορνικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlqwABEKMHOPCTYXSIJaopviktuABEZHIKMNOPTYX", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
DASHES = "‐‑‒–—−﹣－"
BLANKS = "      　"
# fixed values: spelled digits by language, zero to nine
SPELLED = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DIGIT = {w: str(k) for line in SPELLED for k, w in enumerate(line.split())} | {"oh": "0", "o": "0", "ein": "1", "zwo": "2", "une": "1"}
WORD = "|".join(sorted((w for w in DIGIT if w != "o"), key=lambda w: (-len(w), w)))
_DOT = r"(?:[\x20\t]*[\[({<][\x20\t]*(?:dot|punkt|point|punto|\.)[\x20\t]*[\])}>][\x20\t]*|[\x20\t]+(?:dot|punkt|punto|point)[\x20\t]+)"
_AT = r"(?:[\x20\t]*[\[({<][\x20\t]*(?:at|ät|arroba|arobase|@)[\x20\t]*[\])}>][\x20\t]*|[\x20\t]+(?:at|ät|arroba|arobase)[\x20\t]+)"
DISGUISE = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})", re.I)
_ITEM = rf"(?:(?:{WORD})(?![^\W\d_])|[0-9]+)"
DIGIT_RUN = re.compile(rf"(?<![^\W_])(?:plus[\x20-]+)?{_ITEM}(?:(?:[\x20,-]{{1,3}}|{_DOT}){_ITEM}){{3,}}", re.I)
SPELLED_ITEM = re.compile(rf"(?P<word>{WORD})(?![^\W\d_])|(?P<num>[0-9]+)|(?P<plus>plus[\x20-]+)|(?P<dot>{_DOT})|(?P<sep>[\x20,-]+)", re.I)
#: Runs of digits and letters like digits; a single letter at an end, apart by a space, may be a digit or a word.
MIXED_NUMBER = re.compile(r"(?<![A-Za-z0-9])[+]?[0-9OoIl][0-9OoIl().\x20-]*[0-9OoIl](?![A-Za-z0-9])")
MIXED_BETWEEN = re.compile(r"(?<![A-Za-z0-9])(?![OoIl]\x20)[+]?[0-9OoIl][0-9OoIl().\x20-]*[0-9OoIl](?<!\x20[OoIl])(?![A-Za-z0-9])")
MIXED_IP = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl]+(?:\.[0-9OoIl]+){3}(?![A-Za-z0-9])")
ANY_DIGIT = re.compile("[0-9]")
#: Cheap tests that come first: without them the costly patterns find nothing to do.
LETTERS = re.compile(r"[^\W\d_]+")
RUN_WORDS = frozenset(DIGIT) | {"dot", "punkt", "point", "punto"}
BRACKETED = re.compile(r"[\[({<][\x20\t]*(?:at|ät|arroba|arobase|@|dot|punkt|point|punto|\.)[\x20\t]*[\])}>]", re.I)
BARE_DOT = re.compile(r"[\x20\t](?:dot|punkt|punto|point)[\x20\t]")
AS_DIGIT = str.maketrans("OoIl", "0011")


def _fold_table() -> dict[int, str | None]:
    """Characters whose compatibility form is one ASCII character, decimal digits of
    all scripts, and the fixed look-alikes."""
    table: dict[int, str | None] = {}
    for cp in range(128, sys.maxunicode + 1):
        c = chr(cp)
        if (d := unicodedata.decimal(c, None)) is not None:
            table[cp] = str(d)
        elif 0x2000 <= cp and len(n := unicodedata.normalize("NFKC", c)) == 1 and "\x21" <= n <= "\x7e":
            table[cp] = n
    table |= {ord(c): "-" for c in DASHES} | {ord(c): " " for c in BLANKS} | {ord(a): b for a, b in LOOKALIKE.items()}
    return table


_FOLD: list = []


def fold() -> tuple[dict, frozenset]:
    if not _FOLD:
        table = _fold_table()
        _FOLD[:] = [table, frozenset(map(chr, table)) | frozenset(INVISIBLE)]
    return _FOLD[0], _FOLD[1]


def may_spell(text: str) -> bool:
    """Whether three words in a row, numbers aside, belong to a spelled number."""
    return "111" in "".join(["1" if w in RUN_WORDS else "0" for w in LETTERS.findall(text.lower())])


class Rewrite:
    """Output text of transducers with, for each piece, its place in the source."""

    def __init__(self, text: str):
        self.text = text
        self.pieces = [(0, 0, len(text), len(text))]  # out start, source start, out length, source length

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [a, b) of the current text, ascending and apart, by a string."""
        if not edits:
            return
        parts, cuts, at = [], [], 0
        for a, b, new in edits:
            cuts += [(at, a, None), (a, b, new)]
            at = b
        cuts.append((at, len(self.text), None))
        pieces, out = [], 0
        for a, b, new in cuts:
            if new is None:
                if a < b:
                    for p in self._slice(a, b):
                        pieces.append((out, p[1], p[2], p[3]))
                        out += p[2]
                    parts.append(self.text[a:b])
            else:
                s, e = self.source(a, b)
                pieces.append((out, s, len(new), e - s))
                out += len(new)
                parts.append(new)
        self.text, self.pieces = "".join(parts), pieces

    def _slice(self, a: int, b: int) -> Iterator[tuple[int, int, int, int]]:
        k = bisect_right(self.pieces, (a, sys.maxsize)) - 1
        while k < len(self.pieces) and self.pieces[k][0] < b:
            o, s, n, m = self.pieces[k]
            if n:
                lo, hi = max(a, o), min(b, o + n)
                if lo < hi:
                    yield (lo, s + lo - o, hi - lo, hi - lo) if n == m else (lo, s, hi - lo, m)
            k += 1

    def source(self, a: int, b: int) -> tuple[int, int]:
        """Source span of output [a, b): whole pieces where lengths differ."""
        if a >= b:
            return (a, a)
        got = list(self._slice(a, b))
        return got[0][1], got[-1][1] + got[-1][3]


def _spelled(run: str) -> str | None:
    """Digits of a run of spelled digits; None if too few are spelled."""
    out, words = [], 0
    for m in SPELLED_ITEM.finditer(run):
        if m["word"]:
            out.append(DIGIT[m["word"].lower()])
            words += 1
        elif m["num"]:
            out.append(m["num"])
        elif m["plus"]:
            out.append("+")
        elif m["dot"]:
            out.append(".")
    return "".join(out) if words >= 3 else None


def letters_in(text: str, numbers: re.Pattern) -> list[int]:
    """Places of letters for digits; the rules decide on the copy what the runs are."""
    runs = (m for pattern in (numbers, MIXED_IP) for m in pattern.finditer(text) if ANY_DIGIT.search(m.group()))
    return sorted({m.start() + k for m in runs for k, c in enumerate(m.group()) if c in "OoIl"})


def deobfuscate(text: str) -> list[tuple[Rewrite, list[tuple[int, int, bool]]]]:
    """Rewritten texts, each with its source spans of (bare) at/dot disguises: two where letters
    may be digits or words, none if nothing was rewritten."""
    r = Rewrite(text)
    if not text.isascii():
        table, odd = fold()
        if seen := odd.intersection(text):
            r.apply([(m.start(), m.end(), table.get(ord(m.group()), "")) for m in re.finditer("[" + "".join(map(re.escape, seen)) + "]", text)])
    if may_spell(r.text):
        r.apply([(m.start(), m.end(), new) for m in DIGIT_RUN.finditer(r.text) if (new := _spelled(m.group()))])
    readings = [[]]
    if ANY_DIGIT.search(r.text):
        readings = [letters_in(r.text, MIXED_NUMBER)]
        if readings[0] and (other := letters_in(r.text, MIXED_BETWEEN)) != readings[0]:
            readings.append(other)
    out = []
    for letters in readings:
        copy = Rewrite(r.text)
        copy.pieces = r.pieces
        copy.apply([(k, k + 1, copy.text[k].translate(AS_DIGIT)) for k in letters])
        edits, marks = [], []
        for m in DISGUISE.finditer(copy.text) if BRACKETED.search(copy.text) or BARE_DOT.search(copy.text.lower()) else ():
            edits.append((m.start(), m.end(), "@" if m["at"] else "."))
            marks.append((*copy.source(m.start(), m.end()), m.group().strip()[0] not in "[({<", bool(m["at"])))
        copy.apply(edits)
        if copy.text != text:
            out.append((copy, marks))
    return out


def all_spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base and added spans), each by start, then kind."""
    text = text or ""
    base = rules(text)
    more = set()
    for kind, a, b, r, marks in ((*span, *copy) for copy in deobfuscate(text) for span in rules(copy[0].text)):
        s, e = r.source(a, b)
        if any(k == kind and x <= s and e <= y for k, x, y in base):
            continue
        if kind == "email":
            own = [m for m in marks if s <= m[0] and m[1] <= e]
            # a bare "at" counts only together with a disguised dot; the top level is letters
            if any(m[2] and m[3] for m in own) and not any(not m[3] for m in own):
                continue
            if not r.text[:b].rsplit(".", 1)[-1].isalpha():
                continue
        more.add((kind, s, e))
    return base, sorted({*base, *more}, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as text and array."""
    bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                base, every = all_spans(text)
                rows.append((*(sum(k == kind for k, *_ in base) for kind in KINDS), sha_spans(base)[1], sha_spans(every)[0],
                             [{"kind": k, "a": a, "b": b} for k, a, b in every]))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"])
            yield out.assign(doc_id=pdf["doc_id"].to_numpy())

    return unsealed(sealed(id_text(docs)).mapInPandas(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind:string,a:int,b:int>>"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: personal data in every whole text of ``documents``."""
    return scan_pii(documents(spark, sf_dir)).drop("found")
