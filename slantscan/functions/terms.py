"""Term containment over lower-cased text.

The detector matches every term as a *substring* of the lower-cased text and
counts distinct terms present, not occurrences. The same term occurs in many
lists (``welfare`` is coded language, an economic term and a pair member), so
a ``TermIndex`` numbers the distinct terms and gives every row one bitmap of
those present (63 terms a long). A list of terms is then a few masks: G3 is
``bits[k] & mask != 0``, G2 the sum of ``bit_count(bits[k] & mask)``. These
are JVM-side expressions of a size that hardly grows with the lexicon. How the
bits are found is the engine's business: one Aho-Corasick pass per text
(``automaton``, default), one regex pass
(``regex``) or one ``contains`` per term (``contains``).
"""

from __future__ import annotations

import importlib.util
from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import text_bits_udf
from .text import normalise_text

BITS = 63  # terms per long; the sign bit is left alone
# Engine used when none is named; it needs pyahocorasick on driver and workers
# and fails without it. "regex" and "contains" are pure JVM, slower, and give
# identical results.
DEFAULT_ENGINE = "automaton"
# A session can choose the engine without code changes, e.g. the pure-JVM one:
#   spark.conf.set("spark.slantscan.termEngine", "regex")
ENGINE_CONF = "spark.slantscan.termEngine"


def session_engine(df: DataFrame, engine: str | None) -> str | None:
    """The explicit engine, else the session's ``spark.slantscan.termEngine``."""
    if engine:
        return engine
    try:
        return df.sparkSession.conf.get(ENGINE_CONF, None)
    except Exception:  # noqa: BLE001
        return None


BEFORE, BEHIND = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"  # word boundaries


def _regex_char(ch: str) -> str:
    return ch if (ch.isascii() and ch.isalnum()) or ch == " " else "\\" + ch


def trie_pattern(terms: Iterable[str]) -> str:
    """One regular expression that, at a position, matches the longest term starting there.

    The terms are merged into a prefix tree, so a position costs one branch
    per distinct next character instead of one comparison per term; optional
    continuations are greedy, so the first match found is the longest.
    """
    root: dict = {}
    for t in terms:
        node = root
        for ch in t:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        alts = [_regex_char(ch) + emit(node[ch]) for ch in sorted(k for k in node if k)]
        if not alts:
            return ""
        body = alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"
        if "" in node:
            return "(?:" + body + ")?"
        return body

    return emit(root)


class TermIndex:
    """Distinct terms in first-seen order, held by the driver and every task (a lexicon that is
    too large for that is joined, see ``operators.lexicon``); term ``i`` is bit ``i % 63`` of element
    ``i // 63`` of the bitmap column.

    ``engine="automaton"`` (default) finds all terms in one pass per text.
    ``engine="regex"`` does so on the JVM: a zero-width look-ahead of
    ``trie_pattern`` at every position, read with the built-in
    ``regexp_extract_all``, yields the longest term starting at each position;
    a term is present iff it is a prefix of one of those. That covers nested
    and overlapping terms (``demographic`` inside ``demographics``, ``race``
    inside ``embrace``) exactly like substring search. ``engine="contains"``
    runs one ``contains`` per term.

    With ``word_boundary=True`` (off by default: the published detector finds
    ``race`` in ``embrace``) a term counts only where neither the character
    before it nor that behind it is a letter or a digit. The JVM engines look
    for that only in texts that contain the term.
    """

    ENGINES = ("regex", "contains", "automaton")

    def __init__(self, terms: Iterable[str], prefix: str = "__t", engine: str | None = None, word_boundary: bool = False):
        self.word_boundary = word_boundary
        self.engine = engine or DEFAULT_ENGINE
        if self.engine not in self.ENGINES:
            raise ValueError(f"engine must be one of {self.ENGINES}")
        if self.engine == "automaton" and importlib.util.find_spec("ahocorasick") is None:
            raise ImportError(f"engine 'automaton' needs pyahocorasick; install it or set {ENGINE_CONF} to 'regex'")
        self.terms: list[str] = list(dict.fromkeys(terms))
        if any(t == "" for t in self.terms):
            raise ValueError("empty term")
        self.place = {t: i for i, t in enumerate(self.terms)}
        self.bits = f"{prefix}bits"
        self.raw_bits = f"{prefix}rawbits"

    def __len__(self) -> int:
        return len(self.terms)

    def __contains__(self, term: str) -> bool:
        return term in self.place

    def masks(self, terms: Iterable[str]) -> dict[int, int]:
        """Element of the bitmap -> mask of the given terms in it."""
        out: dict[int, int] = {}
        for t in terms:
            k, bit = divmod(self.place[t], BITS)
            out[k] = out.get(k, 0) | 1 << bit
        return out

    def pattern(self) -> str:
        return "(?=(" + trie_pattern(self.terms) + "))"

    def extensions(self, term: str) -> list[str]:
        """Indexed terms that start with ``term`` (itself first)."""
        return [term] + [c for c in self.terms if c != term and c.startswith(term)]

    def bitmap_sql(self, present: dict[str, str]) -> str:
        """Bitmap of the terms for which ``present`` holds a true condition."""
        words = [[] for _ in range(-(-len(self.terms) // BITS))]
        for t, condition in present.items():
            k, bit = divmod(self.place[t], BITS)
            words[k].append(f"CASE WHEN {condition} THEN {1 << bit}L ELSE 0L END")
        return "array(" + ", ".join(balanced_sql("|", w, "0L") for w in words) + ")"

    def add_bits(self, df: DataFrame, lowered: str, raw_lower: str | None = None) -> DataFrame:
        """JVM engines: the bitmap of the lower-cased text in column ``lowered``, and
        that of the raw text in ``raw_lower`` if named.

        A term without a space is in the raw text iff it is in the normalised
        text; a multi-word term in the raw text is also in the normalised one.
        """
        if self.engine == "contains":
            present = {t: f"contains(`{lowered}`, {sql_string(t)})" + self.edges_sql(t, lowered) for t in self.terms}
            df = df.select("*", F.expr(self.bitmap_sql(present)).alias(self.bits))
        else:
            caps = f"{self.bits}caps"
            longest = F.regexp_extract_all(F.col(lowered), F.lit(self.pattern()), 1)
            df = df.select("*", F.array_distinct(longest).alias(caps))
            present = {t: balanced_sql("OR", [f"array_contains(`{caps}`, {sql_string(c)})" for c in self.extensions(t)], "false")
                       + self.edges_sql(t, lowered) for t in self.terms}
            df = df.select("*", F.expr(self.bitmap_sql(present)).alias(self.bits)).drop(caps)
        if raw_lower is None:
            return df
        hits = self.hits()
        present = {t: hits.any_sql([t]) + (f" AND contains(`{raw_lower}`, {sql_string(t)})" + self.edges_sql(t, raw_lower) if " " in t else "")
                   for t in self.terms}
        return df.select("*", F.when(F.col(raw_lower) == F.col(lowered), F.col(self.bits))
                         .otherwise(F.expr(self.bitmap_sql(present))).alias(self.raw_bits))

    def edges_sql(self, term: str, lowered: str) -> str:
        """The further condition that the term stands between word boundaries."""
        if not self.word_boundary:
            return ""
        quoted = "".join(_regex_char(ch) for ch in term)
        return f" AND rlike(`{lowered}`, {sql_string(BEFORE + quoted + BEHIND)})"

    def hits(self, raw: bool = False) -> "Hits":
        """``raw``: the raw text's bitmap was made too."""
        return Hits(self, raw)


def sql_string(s: str) -> str:
    """Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def balanced_sql(op: str, parts: Sequence[str], empty: str) -> str:
    """``parts`` joined by ``op`` as a parenthesised tree of log depth (a left-deep
    chain of hundreds of nodes overflows the JVM stack during analysis)."""
    parts = list(parts)
    if not parts:
        return empty
    while len(parts) > 1:
        nxt = [f"({parts[i]} {op} {parts[i + 1]})" for i in range(0, len(parts) - 1, 2)]
        if len(parts) % 2:
            nxt.append(parts[-1])
        parts = nxt
    return parts[0]


class Hits:
    """Column expressions over the bitmap of a ``TermIndex``.

    With ``raw=True`` an expression answers for the raw (not
    whitespace-normalised) lower-cased text, where its bitmap was made.
    Each is one SQL expression (one call into the JVM).
    """

    def __init__(self, index: TermIndex, raw: bool = False):
        self.index = index
        self.raw_bits = index.raw_bits if raw else index.bits

    def _masked(self, terms: Iterable[str], raw: bool) -> list[str]:
        name = self.raw_bits if raw else self.index.bits
        return [f"(`{name}`[{k}] & {m}L)" for k, m in self.index.masks(terms).items()]

    def count_sql(self, terms: Sequence[str], raw: bool = False) -> str:
        parts, left = [], Counter(terms)
        while left:  # a term listed twice counts twice
            parts += [f"bit_count({w})" for w in self._masked(left, raw)]
            left = Counter({t: n - 1 for t, n in left.items() if n > 1})
        return balanced_sql("+", parts, "0")

    def any_sql(self, terms: Sequence[str], raw: bool = False) -> str:
        if not terms:
            return "false"
        return f"({balanced_sql('|', self._masked(terms, raw), '0L')} != 0L)"

    def hit(self, term: str, raw: bool = False) -> Column:
        return F.expr(self.any_sql([term], raw))

    def count(self, terms: Sequence[str], raw: bool = False) -> Column:
        """Number of listed terms present (a term listed twice counts twice)."""
        return F.expr(self.count_sql(terms, raw))

    def any(self, terms: Sequence[str], raw: bool = False) -> Column:
        """G3."""
        return F.expr(self.any_sql(terms, raw))

    def matched(self, terms: Sequence[str], raw: bool = False) -> Column:
        """Present terms in list order."""
        if not terms:
            return F.array().cast("array<string>")
        items = ", ".join(f"CASE WHEN {self.any_sql([t], raw)} THEN {sql_string(t)} END" for t in terms)
        return F.expr(f"array_compact(array({items}))")

    def places(self) -> Column:
        """Numbers of all present terms (``index.terms[number]``), ascending."""
        return F.expr(f"""flatten(transform(`{self.index.bits}`, (w, k) -> CASE WHEN w = 0L THEN CAST(array() AS ARRAY<INT>)
            ELSE transform(filter(sequence(0, {BITS - 1}), b -> (shiftright(w, b) & 1L) = 1L), b -> k * {BITS} + b) END))""")


LOWER = "__lt"
RAW_LOWER = "__lraw"


def with_term_flags(df: DataFrame, text: str, index: TermIndex, raw: bool = False,
                    keep: Sequence[str] = ()) -> DataFrame:
    """Add the bitmap of the indexed terms, with ``raw`` also that of the raw text.

    With ``keep`` (indexed terms), ``__lt`` holds the normalised lower-cased
    text wherever it contains one of them; elsewhere it may be empty.

    The ``automaton`` engine reads the raw text and normalises it itself
    (Python's split/join is several times cheaper than a Unicode whitespace
    regex on the JVM). JVM engines bind the lower-cased text in one projection
    and read it once per term in the next; Catalyst keeps them apart (the text
    is referenced many times and is not cheap).
    """
    if not index.terms:
        empty = F.array().cast("array<bigint>")
        df = df.select("*", empty.alias(index.bits), F.lit("").alias(LOWER))
        return df.select("*", empty.alias(index.raw_bits)) if raw else df
    if index.engine == "automaton":
        udf = text_bits_udf(index.terms, BITS, index.bits, index.raw_bits if raw else None,
                            LOWER if keep else None, keep, index.word_boundary)
        found = f"{index.bits}found"
        return df.select("*", udf(F.col(text)).alias(found)).select("*", f"{found}.*").drop(found)
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.select("*", F.lower(normalise_text(whole)).alias(LOWER),
                   *([F.lower(whole).alias(RAW_LOWER)] if raw else []))
    return index.add_bits(df, LOWER, RAW_LOWER if raw else None)


def drop_work_columns(df: DataFrame, own: list[str], prefix: str = "__") -> DataFrame:
    """Drop what the plan added; ``own`` are the caller's columns, whatever their names."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix) and c not in own])
