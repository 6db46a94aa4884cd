"""Scalar column functions (JVM-side unless stated).

Each function maps Columns to a Column, so it composes into ``select`` /
``withColumn`` and stays inside whole-stage codegen.  The two helpers that
need Python (NFC normalisation, HTML entity decoding) are Arrow-batched
``pandas_udf``s that only see the short strings already cut out by JVM
regexes, never the whole page.
"""

from __future__ import annotations

import html as _html
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import terms as _terms


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- tone
# Text pandas.to_numeric accepts: optional sign, digits/dots, exponent, inf.
_NUMERIC_TEXT = r"(?i)^\s*[-+]?([0-9.]+(e[-+]?[0-9]+)?|inf|infinity)\s*$"


def parse_number(c: Column | str) -> Column:
    """Coerce text to double like ``pd.to_numeric(errors='coerce')``.

    Spark alone would also accept ``1d``/``1f`` suffixes; the guard rejects them.
    """
    c = _c(c)
    return F.when(c.rlike(_NUMERIC_TEXT), F.trim(c).try_cast("double"))


def tone(c: Column | str) -> Column:
    """First comma-separated field of a tone tuple as double; bad -> null."""
    return parse_number(F.get(F.split(_c(c), ",", -1), 0))


# ------------------------------------------------------------ time
def record_time(record_id: Column | str) -> Column:
    """Record id ``YYYYMMDDHHMMSS-n`` -> event timestamp (NTZ)."""
    return stamp_time(F.substring(_c(record_id), 1, 14))


def stamp_time(digits: Column) -> Column:
    """``YYYYMMDDHHMMSS`` -> timestamp without a zone, so no session zone moves it."""
    iso = F.regexp_replace(digits, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6")
    return F.when(digits.rlike(r"^\d{14}$"), iso.try_cast("timestamp_ntz"))


#: Rewrites of date texts to ISO order, tried in this order: (pattern of the date, replacement).
#: Slashes with the year last are month first.
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_DATE_FORMS = (
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?=$|[T\s])", "$1-$2-$3"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?=$|\s)", "$3-$1-$2"),
    (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
)
_DAY_MONTH = r"(?i)^(\d{1,2})\s+([a-z]{3})[a-z]*\.?,?\s+(\d{4})(?=$|\s)"
_MONTH_DAY = r"(?i)^([a-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})(?=$|\s)"
_TIME = r"^(\d{4}-\d{1,2}-\d{1,2})(?:[T\s]+(\d{1,2}:\d{2})(:\d{2}(?:\.\d{1,6})?)?\s*(?:Z|UTC|[+]00:?00)?)?$"


def parse_mixed_date(c: Column | str) -> Column:
    """Mixed-format date text -> timestamp (NTZ); unparseable -> null.

    ISO (``-``, ``/`` or ``.``; blank or ``T``; seconds and fractions optional; ``Z``),
    US slashes, digits only, and day or month names first.  Everything is rewritten
    to ISO text and cast without a zone, so the session's zone moves nothing.
    """
    c = strip(_c(c).cast("string"))
    for pattern, order in ((_DAY_MONTH, (3, 2, 1)), (_MONTH_DAY, (3, 1, 2))):
        year, name, date = (F.regexp_extract(c, pattern, g) for g in order)
        at = F.instr(F.lit(_MONTHS), F.lower(name))
        month = F.when((at > 0) & (at % 3 == 1), ((at + 2) / 3).cast("int").cast("string")).otherwise(F.lit("0"))
        c = F.when(c.rlike(pattern), F.concat(year, F.lit("-"), month, F.lit("-"), date, F.regexp_replace(c, pattern, ""))).otherwise(c)
    iso = c
    for pattern, order in reversed(_DATE_FORMS):
        iso = F.when(c.rlike(pattern), F.regexp_replace(c, pattern, order)).otherwise(iso)
    clock = F.regexp_extract(iso, _TIME, 2)
    seconds = F.regexp_extract(iso, _TIME, 3)
    full = F.concat(F.regexp_extract(iso, _TIME, 1), F.lit(" "), F.when(clock == "", F.lit("00:00")).otherwise(clock),
                    F.when(seconds == "", F.lit(":00")).otherwise(seconds))
    return F.when(iso.rlike(_TIME), full.try_cast("timestamp_ntz"))


def strip(c: Column) -> Column:
    """Text without white space of any kind at both ends (``F.trim`` cuts spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def day(c: Column | str) -> Column:
    return F.to_date(_c(c))


def month_start(c: Column | str) -> Column:
    """Timestamp of the first instant of the month (pandas ``to_period('M')``)."""
    return F.date_trunc("MM", _c(c)).cast("timestamp_ntz")


def us_date_text(c: Column | str) -> Column:
    """``MM/dd/yyyy`` text."""
    return F.date_format(_c(c), "MM/dd/yyyy")


# ---------------------------------------------------------- text fixes
#: The comma look-alikes the reference maps to ``,`` in
#: ``normalize_commas`` (full-width, small, halfwidth ideographic, low-9
#: quote, modifier letter low vertical line) and NBSP mapped to a space.
COMMA_LOOKALIKES = "，﹐､‚ˏ"


def normalize_commas(c: Column | str) -> Column:
    return F.translate(_c(c), COMMA_LOOKALIKES + "\u00a0", "," * len(COMMA_LOOKALIKES) + " ")


def fix_mojibake(c: Column | str) -> Column:
    """latin-1 encode then utf-8 decode, both dropping errors; null -> ''.

    Deliberately lossy like the reference: a correctly written accented letter
    becomes an invalid byte and is dropped.
    """
    c = _c(c)
    latin = F.regexp_replace(c, r"[^\x00-\xFF]", "")
    # U+FFFD marks invalid bytes below, so the bytes of a real one are kept out of the way
    parts = F.transform(F.split(latin, "\u00ef\u00bf\u00bd", -1), lambda p: F.regexp_replace(
        F.make_valid_utf8(F.encode(p, "ISO-8859-1").cast("string")), "\ufffd", ""))
    fixed = F.array_join(parts, "\ufffd")
    return F.when(c.isNull(), F.lit("")).otherwise(fixed)


# ----------------------------------------------------------- urls
_URL_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def url_path(url: Column | str) -> Column:
    """Path component as ``urllib.parse.urlparse(u).path`` (params cut)."""
    p = F.regexp_extract(_c(url), _URL_PATH, 1)
    return F.regexp_replace(p, r";[^/]*$", "")


def headline_from_url(url: Column | str, acronyms: Iterable[str]) -> Column:
    """Headline guessed from the url slug (X8 + X9).

    Last path part, ``.htm(l)``, ``-idXXXX`` and ``-NNNNNN`` suffixes cut,
    split on ``-``, non-word characters removed, words lower-cased except
    acronyms (upper-cased), joined by a space; nothing left -> null.
    """
    path = F.regexp_replace(url_path(url), r"^/+|/+$", "")
    slug = F.regexp_extract(path, r"([^/]*)$", 1)
    slug = F.regexp_replace(slug, r"\.html?$", "")
    slug = F.regexp_replace(slug, r"-id[A-Za-z0-9]+$", "")
    slug = F.regexp_replace(slug, r"-(\d{6,})$", "")
    acr = sorted({a.lower() for a in acronyms})
    acr_arr = F.array(*[F.lit(a) for a in acr]) if acr else F.array().cast("array<string>")
    words = F.transform(F.split(slug, "-", -1),
                        lambda w: F.lower(F.regexp_replace(w, r"(?U)[^\w-]", "")))
    words = F.filter(words, lambda w: w != "")
    words = F.transform(words, lambda w: F.when(F.array_contains(acr_arr, w), F.upper(w)).otherwise(w))
    out = F.array_join(words, " ")
    return F.when(_c(url).isNull() | (F.size(words) == 0), F.lit(None).cast("string")).otherwise(out)


def article_id(url: Column | str) -> Column:
    """Numeric article id: 6+ digits after ``/`` followed by ``.`` or ``/``."""
    return F.nullif(F.regexp_extract(_c(url), r"/(\d{6,})(?=[./])", 1), F.lit(""))


# --------------------------------------------------------- html title (X11)
#: Comments, scripts and styles: nothing in them is a tag.
_NOT_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*?"""


def _meta_content(html: Column, attr: str, value: str) -> Column:
    """content of ``<meta {attr}="{value}" content="...">`` in either order."""
    tag = F.regexp_extract(html, rf"""(?is)<meta\b(?={_ATTRS}\b{attr}\s*=\s*["']{value}["']){_ATTRS}\bcontent\s*=\s*("[^"]*"|'[^']*')""", 1)
    return F.nullif(F.substring(tag, 2, F.greatest(F.length(tag) - 2, F.lit(0))), F.lit(""))


def html_title_candidates(html: Column | str) -> Column:
    """Struct of raw (entity-encoded) og, twitter and ``<title>`` texts."""
    h = F.regexp_replace(_c(html), _NOT_MARKUP, "")
    title = r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"
    return F.struct(
        _meta_content(h, "property", "og:title").alias("og"),
        _meta_content(h, "name", "twitter:title").alias("tw"),
        F.when(h.rlike(title), F.regexp_extract(h, title, 1)).alias("title"),
    )


@F.pandas_udf(T.StringType())
def _pick_headline(og: pd.Series, tw: pd.Series, title: pd.Series) -> pd.Series:
    def pick(a, b, t):
        for cand in (a, b, t):
            if isinstance(cand, str):
                text = _html.unescape(cand)
                if cand == "" or text == "":
                    continue
                return unicodedata.normalize("NFC", text.strip())
        return None
    return pd.Series([pick(a, b, t) for a, b, t in zip(og, tw, title)], dtype=object)


def headline_from_html(html: Column | str) -> Column:
    """og:title, else twitter:title, else ``<title>`` text; entities decoded,
    trimmed, NFC.  Empty values fall through, whitespace-only ones give ``''``;
    no candidate -> null."""
    cand = html_title_candidates(html)
    return _pick_headline(cand["og"], cand["tw"], cand["title"])


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC (no built-in Spark function exists)."""
    return s.map(lambda x: unicodedata.normalize("NFC", x) if isinstance(x, str) else x)


# --------------------------------------------------- file-name ranges
def range_from_name(name: Column | str, kind: str = "parquet") -> Column:
    """``start, end`` timestamps encoded in a file name; bad name -> nulls.

    ``kind='parquet'``: ``YYYY-MM-DD_to_YYYY-MM-DD_HH-MM-SS.parquet`` (filtered
    cache); ``kind='csv'``: first ``YYYY-MM-DD_to_YYYY-MM-DD`` anywhere in the
    name, end at 23:59:59.
    """
    n = _c(name)
    if kind == "parquet":
        m = r"(?i)^(\d{4}-\d{2}-\d{2})_to_(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})\.parquet$"
        ok = n.rlike(m)
        start = F.regexp_extract(n, m, 1)
        end = F.regexp_replace(F.regexp_extract(n, m, 2), r"_(\d{2})-(\d{2})-(\d{2})$", " $1:$2:$3")
    else:
        m = r"(\d{4}-\d{2}-\d{2})_to_(\d{4}-\d{2}-\d{2})"
        ok = n.rlike(m)
        start = F.regexp_extract(n, m, 1)
        end = F.concat(F.regexp_extract(n, m, 2), F.lit(" 23:59:59"))
    start, end = start.try_cast("timestamp_ntz"), end.try_cast("timestamp_ntz")
    both = ok & start.isNotNull() & end.isNotNull()
    return F.struct(F.when(both, start).alias("start"), F.when(both, end).alias("end"))
