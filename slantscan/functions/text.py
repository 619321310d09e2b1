"""Text column functions.

All are JVM-side expressions: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split() whitespace, written as one class that Java regex and
# RE2 (DuckDB) both read the same way. Java's and RE2's ``\s`` are ASCII only.
WS_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)

MAX_TOKENS = 256


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_text(c: Column | str) -> Column:
    """B1: strip, collapse every whitespace run to one space (null stays null)."""
    return F.trim(F.regexp_replace(_col(c), WS_CLASS, " "))


def clean_text(c: Column | str) -> Column:
    """B2: as ``normalise_text`` but null becomes ''."""
    return F.coalesce(normalise_text(c), F.lit(""))


def lower_text(c: Column | str) -> Column:
    """G1."""
    return F.lower(_col(c))


def tokens(normalised: Column | str) -> Column:
    """Whitespace tokens of already normalised text; '' gives an empty array."""
    n = _col(normalised)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def truncated_tokens(c: Column | str, max_tokens: int = MAX_TOKENS) -> Column:
    """The first ``max_tokens`` whitespace tokens of the normalised text.

    Stands for the classifier's truncation at 256 positions; the sub-word
    vocabulary of the original network is not reproduced.
    """
    return F.slice(tokens(normalise_text(c)), 1, max_tokens)
