"""Scalar text functions as Spark Column expressions (no UDFs).

Each function maps one Column to another and stays inside whole-stage codegen,
so it runs unchanged in batch and streaming plans.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay equal to the behaviour being reproduced)
# ---------------------------------------------------------------------------
# Whitespace removed by a full strip: every code point for which Python's
# str.isspace() is true (29 characters), derived by rule rather than listed.
WS29 = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())

# Numeral pattern: comma-grouped thousands, then a number with one optional
# "/" or "." inside, then a plain digit run. Alternatives are tried in this
# order at the leftmost position, without word boundaries.
NUMERAL_PATTERN = r"\d{1,3}(?:,\d{3})+|\d+[\/\.]{0,1}\d+|\d+"
# Java regex needs UNICODE_CHARACTER_CLASS for \d to cover non-ASCII digits the
# way Python's str patterns do.
NUMERAL_PATTERN_JAVA = "(?U)" + NUMERAL_PATTERN

# Text used for a missing value, as str(None) renders it.
NULL_TEXT = "None"
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_text(c) -> Column:
    """str(x): cast to string; a null becomes the text 'None' (SC1)."""
    col = _c(c)
    return F.coalesce(col.cast("string"), F.lit(NULL_TEXT))


def full_strip(c) -> Column:
    """str.strip(): remove all 29 Unicode whitespace characters at both ends (SC2)."""
    return F.btrim(_c(c), F.lit(WS29))


def strip_quotes(c) -> Column:
    """strip() then strip('"'): whitespace first, then double quotes, no second
    whitespace pass (SC3)."""
    return F.btrim(full_strip(c), F.lit('"'))


def text_part(c, strip: bool) -> Column:
    """str(x), optionally stripped: the building block of every message."""
    t = to_text(c)
    return full_strip(t) if strip else t


def numerals(c) -> Column:
    """All numerals in a text, leftmost-first (SC5)."""
    return F.regexp_extract_all(_c(c), F.lit(NUMERAL_PATTERN_JAVA), F.lit(0))


def numeral_count(c) -> Column:
    return F.size(numerals(c))


def has_single_number(c) -> Column:
    """True when exactly one numeral is found (FL1)."""
    return numeral_count(c) == F.lit(1)


def flatten_newlines(c) -> Column:
    """Replace '\\n' by a space; '\\r' is kept as written (SC6)."""
    return F.replace(_c(c), F.lit("\n"), F.lit(" "))


def suffix_from(c, offset) -> Column:
    """Characters after the first `offset` code points (SC8)."""
    off = F.lit(offset) if isinstance(offset, int) else _c(offset)
    return F.substr(_c(c), off + F.lit(1))


def strip_prompt(generated, prompt) -> Column:
    """Cut the prompt off a generated text by the prompt's *length* (no prefix
    test), then strip (PJ7)."""
    return full_strip(suffix_from(generated, F.char_length(_c(prompt))))


# ---------------------------------------------------------------------------
# SQL text for the DuckDB oracles (same fixed values, spelled for DuckDB).
# ---------------------------------------------------------------------------
def ws_sql() -> str:
    """WS29 as a DuckDB string expression built from chr() calls."""
    return "(" + " || ".join(f"chr({ord(ch)})" for ch in WS29) + ")"


def sql_str(s: str) -> str:
    """A DuckDB string literal for arbitrary text (newlines via chr(10))."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + " || chr(10) || ".join(quoted) + ")" if len(parts) > 1 else quoted[0]
