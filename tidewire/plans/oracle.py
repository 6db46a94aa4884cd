"""DuckDB SQL builders for the correctness oracle.

Only used to write the independent SQL of ``oracle_sql()``; no query runs
through here on Spark.  DuckDB's RE2 differs from Java regexes in three ways
that matter:

* ``\\b`` is ASCII-only in RE2 while Java and Python treat accented letters
  as word characters.  Word boundaries are therefore spelled out with
  ``[^\\p{L}\\p{N}_]`` classes.  Because such a class consumes a character,
  two matches separated by one character would compete for it; doubling every
  non-word character (in the text and in the term) gives each match its own.
* ``upper('ß')`` is ``'ẞ'`` in DuckDB and ``'SS'`` in Java: mapped first.
* no look-ahead: the article-id pattern consumes its delimiter instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..functions import terms as TM

NW = r"[^\p{L}\p{N}_]"


def lit(s: str) -> str:
    """SQL string literal (DuckDB keeps backslashes verbatim)."""
    return "'" + s.replace("'", "''") + "'"


def upper(expr: str) -> str:
    return f"upper(replace({expr}, 'ß', 'ss'))"


def _double_nonword(s: str) -> str:
    return "".join(ch if (ch == "_" or ch.isalnum()) else ch + ch for ch in s)


def bounded_regex(pattern: str) -> str:
    r"""``\bX\b`` -> explicit-boundary form (existence tests only)."""
    t = TM.term_from_pattern(pattern)
    if t.raw is not None:
        raise ValueError(f"no oracle form for irregular pattern {pattern!r}")
    body = TM.escape(t.text)
    return f"(?:^|{NW}){body}(?:{NW}|$)" if t.bounded else body


def count_terms(expr: str, terms: Sequence[TM.Term]) -> str:
    """Sum of one match count per dictionary entry (no layers, no shared alternation)."""
    e = f"coalesce({expr}, '')"
    doubled = f"regexp_replace({e}, '({NW})', '\\1\\1', 'g')"
    parts = []
    for t in terms:
        if t.raw is not None:
            raise ValueError("no oracle form for irregular patterns")
        if t.bounded:
            pat = rf"(?:^|{NW})\Q{_double_nonword(t.text)}\E(?:{NW}|$)"
            parts.append(f"len(regexp_extract_all({doubled}, {lit(pat)}))")
        else:
            quoted = rf"\Q{t.text}\E"
            parts.append(f"len(regexp_extract_all({e}, {lit(quoted)}))")
    return "CAST((" + " + ".join(parts or ["0"]) + ") AS INTEGER)"


def classify(expr: str, categories: dict) -> str:
    """Labels joined by ``, `` (``UNKNOWN`` when none), text lower-cased."""
    low = f"lower(coalesce({expr}, ''))"
    cases = []
    for cat, pats in categories.items():
        alt = "|".join(f"(?:{bounded_regex(p)})" for p in pats)
        cases.append(f"CASE WHEN regexp_matches({low}, {lit(alt)}) THEN {lit(cat)} END")
    return f"coalesce(nullif(concat_ws(', ', {', '.join(cases)}), ''), 'UNKNOWN')"


def keyword_count(expr: str, categories: dict) -> str:
    kw = TM.pattern_terms(TM.keyword_patterns(categories))
    return count_terms(f"lower(coalesce({expr}, ''))", kw)


TONE_RE = r"(?i)^\s*[-+]?([0-9.]+(e[-+]?[0-9]+)?|inf|infinity)\s*$"


def parse_number(expr: str) -> str:
    return f"CASE WHEN regexp_matches({expr}, {lit(TONE_RE)}) THEN TRY_CAST(trim({expr}) AS DOUBLE) END"


def tone(expr: str) -> str:
    return parse_number(f"split_part({expr}, ',', 1)")


def article_id(expr: str) -> str:
    return f"nullif(regexp_extract({expr}, '/(\\d{{6,}})[./]', 1), '')"
