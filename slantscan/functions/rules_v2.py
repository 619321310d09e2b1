"""V2 lexicon features (G5-G13, G19, G20) and rule chain (H2, H3).

Every feature is a column expression over the term bitmap of one
``TermIndex`` (see ``terms.py``). Running sums that the rule set compares
with strict thresholds are built in the same order as the rule set adds
them, so that float results agree to the last bit; adding ``0.0`` or
multiplying by ``1.0`` is exact, which lets each conditional step be a
single multiplication or ``greatest`` instead of a nested ``when`` that
would copy the whole expression tree at every step.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as L
from .rule_model import V2, RuleSet
from .terms import Hits


def seq_sum(parts: Sequence[Column], start: float = 0.0) -> Column:
    out: Column = F.lit(start)
    for p in parts:
        out = out + p
    return out


def _when(cond: Column, value: float | Column, other: float = 0.0) -> Column:
    return F.when(cond, value).otherwise(F.lit(other))


def terms(lex: RuleSet = V2) -> list[str]:
    """Every term the V2 score, features and explanation read."""
    return lex.all_terms()


# ---- G6: share of categories with at least one term ----------------------

def category_coverage(h: Hits, categories: dict[str, list[str]], raw: bool = False) -> Column:
    if not categories:
        return F.lit(0.0)
    hit = h.count([], raw)
    for cat_terms in categories.values():
        hit = hit + h.any(cat_terms, raw).cast("int")
    return hit / F.lit(len(categories))


def intent_scores(h: Hits, lex: RuleSet = V2) -> dict[str, Column]:
    names = dict(zip(L.V2_INTENT_MARKERS, L.V2_INTENT_NAMES))
    return {names.get(group, group): category_coverage(h, cats) for group, cats in lex.categories["intent"].items()}


def framing_scores(h: Hits, lex: RuleSet = V2) -> dict[str, Column]:
    return {name: category_coverage(h, cats) for name, cats in lex.categories["framing"].items()}


def evidence_scores(h: Hits, lex: RuleSet = V2) -> dict[str, Column]:
    return {name: category_coverage(h, cats) for name, cats in lex.categories["evidence"].items()}


STRUCTURES = tuple(L.V2_STATEMENT_STRUCTURES)


def structure_scores(h: Hits, lex: RuleSet = V2) -> dict[str, Column]:
    """A term inside some 3-word window of the normalised text.

    A term of at most three words lies in a 3-word window iff it is a substring
    of the normalised lower-cased text; one of more words lies in none.
    """
    out = {}
    for name in STRUCTURES:
        comps = lex.categories["structure"].get(name, {})
        out[name] = category_coverage(h, {c: [t for t in ts if t.count(" ") <= 2] for c, ts in comps.items()})
    return out


# ---- G8: relationship pairs ------------------------------------------------

RELATION_OUTPUTS = {
    ("research_findings", "positive"): "positive_research",
    ("research_findings", "negative"): "negative_research",
    ("systemic_discussion", "factual"): "factual_systemic",
    ("systemic_discussion", "biased"): "biased_systemic",
}


def relation_scores(h: Hits, raw: bool = False, lex: RuleSet = V2) -> dict[str, Column]:
    """The pair's weight (0.3) per pair with both members present, capped at 1.0."""
    out = {}
    for key, name in RELATION_OUTPUTS.items():
        s = seq_sum([_when(h.hit(a, raw) & h.hit(b, raw), w) for a, b, w in lex.relations[key]])
        out[name] = F.least(s, F.lit(1.0))
    return out


# ---- G9-G13 ----------------------------------------------------------------

def primary_any_secondary(h: Hits, pairs) -> Column:
    """+weight per primary present together with any of its secondaries."""
    return seq_sum([_when(h.hit(p) & h.any(secs), w) for p, secs, w in pairs])


def economic_contrast(h: Hits, lex: RuleSet = V2) -> Column:
    return primary_any_secondary(h, lex.pairs["economic_contrast"])


def positive_research(h: Hits, lex: RuleSet = V2) -> Column:
    return primary_any_secondary(h, lex.pairs["positive_research"])


def factual_marker(h: Hits, lex: RuleSet = V2) -> Column:
    return h.any(lex.terms["factual_marker"])


def legitimate_systemic(h: Hits, lex: RuleSet = V2) -> Column:
    """+0.6 per pattern hit, and +0.2 more if any factual marker is present."""
    fm = factual_marker(h, lex)
    parts: list[Column] = []
    for p, secs, w in lex.pairs["legitimate_systemic"]:
        c = h.hit(p) & h.any(secs)
        parts.append(_when(c, w))
        parts.append(_when(c & fm, L.V2_LEGITIMATE_FACTUAL_BONUS))
    return seq_sum(parts)


def all_groups(h: Hits, *groups: Sequence[str]) -> Column:
    """0.8 when every group has a term present."""
    cond = F.lit(True)
    for g in groups:
        cond = cond & h.any(g)
    return _when(cond, 0.8)


def historical_education(h: Hits, lex: RuleSet = V2) -> Column:
    return all_groups(h, lex.terms["historical"], lex.terms["educational"], lex.terms["critical"])


def systemic_discussion(h: Hits, lex: RuleSet = V2) -> Column:
    return all_groups(h, lex.terms["systemic"], lex.terms["solution"], lex.terms["factual"])


def cultural_bias(h: Hits, lex: RuleSet = V2) -> Column:
    """0.7 with both kinds of terms, 0.5 with one kind, else 0."""
    dec = h.count(lex.terms["cultural_decline"]) > 0
    usv = h.count(lex.terms["us_vs_them"]) > 0
    return F.when(dec & usv, F.lit(0.7)).when(dec | usv, F.lit(0.5)).otherwise(F.lit(0.0))


def evidence_quality(h: Hits, lex: RuleSet = V2) -> Column:
    """+0.2 per high-quality category hit, -0.2 per low-quality one, in that order.

    Kept as the same float running sum: 3 - 3 categories leave 5.6e-17,
    which counts as positive evidence.
    """
    out: Column = F.lit(0.0)
    for cat_terms in lex.categories["evidence"].get("high_quality", {}).values():
        out = out + _when(h.any(cat_terms), 0.2)
    for cat_terms in lex.categories["evidence"].get("low_quality", {}).values():
        out = out - _when(h.any(cat_terms), 0.2)
    return out


def strong_indicator(h: Hits, lex: RuleSet = V2) -> Column:
    """G19."""
    return h.any(lex.terms["strong"])


def research_direction(h: Hits, lex: RuleSet = V2) -> Column:
    """Positive research terms and no negative ones."""
    return h.any(lex.terms["positive_finding"]) & ~h.any(lex.terms["negative_finding"])


def lexicon_counts(h: Hits, lex: RuleSet = V2) -> dict[str, Column]:
    return {f"{name}_n": h.count(lex.terms[name]) for name in ("explicit", "coded", "stereotype")}


def weighted(h: Hits, lex: RuleSet, name: str, raw: bool = False) -> Column:
    """Weight times number of the list's terms present; several weights in order of their first term."""
    parts = [h.count(ts, raw) * F.lit(w) for w, ts in lex.by_weight(name)]
    return functools.reduce(operator.add, parts) if parts else F.lit(0.0)


def lexicon_score(h: Hits, lex: RuleSet = V2) -> Column:
    """0.4 per explicit, coded and stereotype term."""
    return (weighted(h, lex, "explicit") + weighted(h, lex, "coded")) + weighted(h, lex, "stereotype")


# ---- H2: the rule chain ------------------------------------------------------

FEATURES = [
    "lex", "hist", "cult", "sys", "econ", "posres", "legit", "eq", "fact",
    "fm", "no_blame", "no_refusal", "research_dir", "strong", "demo_changes", "minority_comm",
]


def features(h: Hits, lex: RuleSet = V2) -> dict[str, Column]:
    """Every input of the chain, one column each (evaluated once per row)."""
    return {
        "lex": lexicon_score(h, lex),
        "hist": historical_education(h, lex),
        "cult": cultural_bias(h, lex),
        "sys": systemic_discussion(h, lex),
        "econ": economic_contrast(h, lex),
        "posres": positive_research(h, lex),
        "legit": legitimate_systemic(h, lex),
        "eq": evidence_quality(h, lex),
        "fact": category_coverage(h, lex.categories["intent"].get("factual_discussion", {})),
        "fm": factual_marker(h, lex),
        "no_blame": ~h.any(lex.terms["blame"]),
        "no_refusal": ~h.any(lex.terms["refusal"]),
        "research_dir": research_direction(h, lex),
        "strong": strong_indicator(h, lex),
        "demo_changes": h.any(lex.terms["demographic_change"]),
        "minority_comm": h.any(lex.terms["minority_community"]),
    }


def base_score(f: dict[str, Column]) -> Column:
    """Steps 2 and 11-15 (base score before the model is mixed in)."""
    b = F.greatest(f["lex"], F.lit(0.0))
    b = b * _when(f["hist"] > 0.5, 0.1, 1.0)
    b = b * _when((f["hist"] > 0.5) & (f["eq"] > 0), 0.5, 1.0)
    b = F.greatest(b, f["cult"])  # only lifts when cult > 0; b >= 0
    b = b * _when((f["sys"] > 0.5) & (f["eq"] > 0) & (f["fact"] > 0.5) & f["no_blame"], 0.1, 1.0)
    b = b * _when(f["research_dir"] & (f["fact"] > 0.5), 0.2, 1.0)
    b = F.greatest(b, _when(f["strong"], 0.8))
    return b


def final_score(f: dict[str, Column], base: Column, model_score: Column) -> Column:
    """Steps 16-25."""
    s = F.lit(L.V2_MODEL_WEIGHT) * model_score + F.lit(L.V2_PATTERN_WEIGHT) * base
    s = s * _when(f["hist"] > 0.7, 0.2, 1.0)
    s = F.greatest(s, _when(f["cult"] > 0.6, 0.6))
    s = s * _when((f["sys"] > 0.7) & (f["eq"] > 0) & f["no_blame"], 0.2, 1.0)
    s = F.greatest(s, _when(f["econ"] > 0.6, f["econ"]))
    s = s * _when((f["posres"] > 0.7) & (f["eq"] > 0), 0.1, 1.0)
    s = s * _when((f["legit"] > 0.6) & (f["eq"] > 0) & f["no_refusal"], 0.1, 1.0)
    s = s * _when(f["demo_changes"] & (f["posres"] > 0.6), 0.1, 1.0)
    s = s * _when(f["minority_comm"] & (f["legit"] > 0.6) & f["fm"], 0.1, 1.0)
    return F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))


# ---- explanation inputs (H6/H7) ----------------------------------------------

def pattern_tags(h: Hits, structures: dict[str, Column], relations: dict[str, Column], lex: RuleSet = V2) -> Column:
    """H6 (V2): ordered pattern names; lexicon checks read the raw text."""
    items = [
        (h.any(lex.terms["explicit"], raw=True), "explicit racial terms"),
        (h.any(lex.terms["coded"], raw=True), "coded racial language"),
        (h.any(lex.terms["stereotype"], raw=True), "racial stereotyping"),
        (h.any(lex.terms["economic"], raw=True), "economic bias language"),
        (structures["factual_research"] > 0.5, "research-based language"),
        (structures["systemic_analysis"] > 0.5, "systemic analysis"),
        (structures["biased_generalization"] > 0.5, "biased generalizations"),
        (relations["positive_research"] > 0.3, "positive research findings"),
        (relations["negative_research"] > 0.3, "negative research claims"),
        (relations["factual_systemic"] > 0.3, "factual systemic discussion"),
        (relations["biased_systemic"] > 0.3, "biased systemic claims"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in items]))


def structure_sentences(structures: dict[str, Column], relations: dict[str, Column],
                        confidence: Column) -> Column:
    """The V2 sentences on research-based and systemic framing."""
    research = F.when(
        structures["factual_research"] > 0.5,
        F.when(
            relations["positive_research"] > 0.3,
            F.concat(
                F.lit("While the text uses research-based language to present findings, "),
                _when(confidence > 0.6, F.lit("it appears to use this framework to mask bias. "), "")
                .cast("string"),
            ),
        ).otherwise(F.lit("The text uses academic language to present biased views. ")),
    ).otherwise(F.lit(""))
    systemic = F.when(
        structures["systemic_analysis"] > 0.5,
        F.when(
            relations["factual_systemic"] > 0.3,
            F.concat(
                F.lit("The text discusses systemic issues, but "),
                _when(confidence > 0.6, F.lit("may use this framework to express bias. "), "")
                .cast("string"),
            ),
        ).otherwise(F.lit("The text uses systemic analysis to present biased views. ")),
    ).otherwise(F.lit(""))
    return F.concat(research, systemic)
