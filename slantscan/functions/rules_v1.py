"""V1 lexicon features (G14-G18) and rule chain (H1).

G14 works on whitespace tokens, not substrings: the base word must equal a
token, its window is five tokens either side of its *first* place, and a
context word counts when it equals a token of the window. Tokens keep their
punctuation, and multi-word context entries never equal a token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from .rule_model import V1, RuleSet
from .rules_v2 import _when, seq_sum, weighted
from .terms import LOWER, Hits, sql_string
from .text import tokens

WORDS = "__v1_words"


def base_words(lex: RuleSet = V1) -> list[str]:
    return [base for base, _, _ in lex.pairs["context"]]


def terms(lex: RuleSet = V1) -> list[str]:
    """Every term V1 reads as a substring, plus the base words of the context
    pairs (a base word can only be a token of a text that contains it)."""
    return [t for ts in lex.terms.values() for t in ts] + base_words(lex)


def window_name(i: int) -> str:
    return f"__v1_win{i}"


def pos_name(i: int) -> str:
    return f"__v1_pos{i}"


def count_name(i: int) -> str:
    return f"__v1_n{i}"


def tag_name(i: int) -> str:
    return f"__v1_tag{i}"


def add_token_windows(df: DataFrame, lowered: str = LOWER, lex: RuleSet = V1) -> DataFrame:
    """Tokens of the normalised lower-cased text and, per pair, the window
    around the first place of its base word (empty when absent)."""
    pairs = lex.pairs["context"]
    df = df.select("*", tokens(F.col(lowered)).alias(WORDS))
    pos = [F.expr(f"CAST(array_position(`{WORDS}`, {sql_string(base)}) AS INT)").alias(pos_name(i))
           for i, (base, _, _) in enumerate(pairs)]
    df = df.select("*", *pos)
    k = L.V1_CONTEXT_WINDOW
    wins = []
    for i, _ in enumerate(pairs):
        p = f"`{pos_name(i)}`"
        start0 = f"greatest(0, {p} - {k + 1})"
        end0 = f"least(size(`{WORDS}`), {p} + {k})"
        wins.append(F.expr(f"CASE WHEN {p} > 0 THEN slice(`{WORDS}`, {start0} + 1, {end0} - {start0}) "
                           f"ELSE CAST(array() AS ARRAY<STRING>) END").alias(window_name(i)))
    df = df.select("*", *wins)
    found = [_pair_sql(i, base, ctx) for i, (base, ctx, _) in enumerate(pairs)]
    df = df.select("*", *[F.expr(n).alias(count_name(i)) for i, (n, _) in enumerate(found)])
    return df.select("*", *[F.expr(t).alias(tag_name(i)) for i, (_, t) in enumerate(found)])


def _pair_sql(i: int, base: str, ctx: list[str]) -> tuple[str, str]:
    """(number of context words in the window, tag or null) for pair ``i``;
    the tag reads the count column, so each window is scanned once."""
    win = f"`{window_name(i)}`"
    present = [f"array_contains({win}, {sql_string(c)})" for c in ctx]
    n = "(" + " + ".join(f"CAST({p} AS INT)" for p in present) + ")"
    first = "CASE " + " ".join(f"WHEN {p} THEN {sql_string(c)}" for p, c in zip(present, ctx)) + " END"
    return n, f"CASE WHEN `{count_name(i)}` > 0 THEN concat({sql_string(base + '-')}, {first}) END"


def token_context(lex: RuleSet = V1) -> tuple[Column, list[Column]]:
    """(score contribution, tag per pair or null), pairs in list order."""
    parts, tags = [], []
    for i, (_, _, weight) in enumerate(lex.pairs["context"]):
        n = f"`{count_name(i)}`"
        parts.append(F.expr(f"CASE WHEN {n} > 0 THEN {weight!r}D * {n} ELSE 0.0D END"))
        tags.append(F.col(tag_name(i)))
    return seq_sum(parts), tags


def group_list(h: Hits, raw: bool = False, lex: RuleSet = V1) -> Column:
    """At least three distinct group terms."""
    return h.count(lex.terms["explicit"], raw) >= 3


def war_context(h: Hits, raw: bool = False, lex: RuleSet = V1) -> Column:
    """A term of war beside a group term."""
    return h.any(lex.terms["war"], raw) & (h.count(lex.terms["explicit"], raw) > 0)


def context_score(h: Hits, raw: bool = False, lex: RuleSet = V1) -> tuple[Column, Column]:
    """G18 (with G15-G17): (score capped at 1, ordered tags).

    ``raw=True`` reads substring terms from the raw text, as the V1
    explanation does; tokens are the same either way.
    """
    pair_score, pair_tags = token_context(lex)

    def some(name):
        return h.any(lex.terms[name], raw)

    def add(s, name):
        return s + _when(some(name), weighted(h, lex, name, raw))

    s = add(add(add(pair_score, "pseudo_scientific"), "cultural_supremacy"), "property_economic")
    first_tags = pair_tags + [
        F.when(some("pseudo_scientific"), F.lit(L.V1_TAG_PSEUDO)),
        F.when(some("cultural_supremacy"), F.lit(L.V1_TAG_SUPREMACY)),
        F.when(some("property_economic"), F.lit(L.V1_TAG_PROPERTY)),
    ]
    kinds = F.size(F.array_distinct(F.array_compact(F.array(*first_tags))))
    s = s * _when(kinds > 1, F.lit(1.0) + F.lit(0.1) * kinds, 1.0)  # G15
    groups, war = group_list(h, raw, lex), war_context(h, raw, lex)
    s = add(add(s, "historical"), "analytical")
    s = s + _when(groups, 0.25)  # G16
    s = s + _when(war, 0.2)  # G17
    tags = F.array_compact(F.array(*first_tags, *[
        F.when(some("historical"), F.lit(L.V1_TAG_HISTORICAL)),
        F.when(some("analytical"), F.lit(L.V1_TAG_ANALYTICAL)),
        F.when(groups, F.lit(L.V1_TAG_GROUPS)),
        F.when(war, F.lit(L.V1_TAG_WAR)),
    ]))
    return F.least(s, F.lit(1.0)), tags


def lexicon_score(h: Hits, lex: RuleSet = V1) -> Column:
    """G5 (V1): 0.35 / 0.30 / 0.35 per term."""
    return (weighted(h, lex, "explicit") + weighted(h, lex, "coded")) + weighted(h, lex, "stereotype")


def features(h: Hits, lex: RuleSet = V1) -> dict[str, Column]:
    ctx, tags = context_score(h, lex=lex)
    return {
        "explicit": weighted(h, lex, "explicit"),
        "coded": weighted(h, lex, "coded"),
        "stereotype": weighted(h, lex, "stereotype"),
        "econ_stereo": h.any(lex.terms["jobs"]) & h.any(lex.terms["they"]),
        "ctx": ctx,
        "tags": tags,
    }


def final_score(f: dict[str, Column], model_score: Column) -> Column:
    """H1 steps 4-9."""
    tags = f["tags"]
    stereo = f["stereotype"] * _when(f["econ_stereo"], 1.5, 1.0)
    both = F.array_contains(tags, L.V1_TAG_HISTORICAL) & F.array_contains(tags, L.V1_TAG_GROUPS)
    ctx = f["ctx"] * _when(both, 1.4, 1.0)
    pattern = F.least(((f["explicit"] + f["coded"]) + stereo) + ctx, F.lit(1.0))
    s = F.lit(L.V1_MODEL_WEIGHT) * model_score + F.lit(L.V1_PATTERN_WEIGHT) * pattern
    n = F.size(tags)
    s = F.when(n >= 2, F.least(s * (F.lit(1.0) + F.lit(0.15) * n), F.lit(1.0))).otherwise(s)
    s = F.when(F.array_contains(tags, L.V1_TAG_ANALYTICAL) & (n > 1),
               F.least(s * F.lit(1.2), F.lit(1.0))).otherwise(s)
    return s


def pattern_tags(h: Hits, raw_context_tags: Column, lex: RuleSet = V1) -> Column:
    """H6 (V1): lexicon pattern names on the raw text, then the context tags."""
    items = [
        (h.any(lex.terms["explicit"], raw=True), "explicit racial terms"),
        (h.any(lex.terms["coded"], raw=True), "coded racial language"),
        (h.any(lex.terms["stereotype"], raw=True), "racial stereotyping"),
        (h.any(lex.terms["pseudo_scientific"], raw=True), "pseudo-scientific racial bias"),
        (h.any(lex.terms["property_economic"], raw=True), "economic-based racial bias"),
        (h.any(lex.terms["cultural_supremacy"], raw=True), "cultural supremacy bias"),
    ]
    head = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in items]))
    return F.concat(head, raw_context_tags)
