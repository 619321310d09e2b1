"""The lists that the rule sets read, as rows and compiled for one call.

A row is (version, name, kind, category, ordinal, term, weight):

======== ============================================ ==========================
kind     category                                     read as
======== ============================================ ==========================
term     none                                         list of terms, each with a weight where a score counts them
list     none                                         list of terms of a condition
pair     the first member                             first member with any of its second members (term);
                                                      rows of one first member in sequence are one pair
category the category                                 ``name`` is ``group.list``; share of categories with a term
relation the first member                             ``name`` is ``relation.group.kind``; both members of a row
======== ============================================ ==========================

``RuleSet`` compiles one version's rows; the rule functions take it and turn it
into numbers and masks of the terms of a ``TermIndex``. ``default_rows`` are the
published lists, so the default rule set takes the same way as a user's table. A
name that a table lacks is an empty list: its rule never fires. Names that no rule
reads are refused. Terms are compared with the lower-cased text as they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from .. import lexicons as L

# name -> (kind, lists, weight where a row names none)
SPEC: dict[str, dict[str, tuple]] = {
    "v2": {
        "explicit": ("term", L.EXPLICIT_RACIAL_TERMS, L.V2_WEIGHTS["explicit"]),
        "coded": ("term", L.V2_CODED_RACIAL_TERMS, L.V2_WEIGHTS["coded"]),
        "stereotype": ("term", L.V2_RACIAL_STEREOTYPES, L.V2_WEIGHTS["stereotype"]),
        "economic": ("term", L.V2_ECONOMIC_BIAS_TERMS, None),
        "strong": ("term", L.V2_STRONG_INDICATORS, None),
        "factual_marker": ("term", L.V2_FACTUAL_DISCUSSION_MARKERS, None),
        "historical": ("list", L.V2_HISTORICAL_TERMS, None),
        "educational": ("list", L.V2_EDUCATIONAL_TERMS, None),
        "critical": ("list", L.V2_CRITICAL_TERMS, None),
        "cultural_decline": ("list", L.V2_CULTURAL_DECLINE_TERMS, None),
        "us_vs_them": ("list", L.V2_US_VS_THEM_TERMS, None),
        "systemic": ("list", L.V2_SYSTEMIC_TERMS, None),
        "solution": ("list", L.V2_SOLUTION_TERMS, None),
        "factual": ("list", L.V2_FACTUAL_MARKERS, None),
        "positive_finding": ("list", L.V2_POSITIVE_RESEARCH_TERMS, None),
        "negative_finding": ("list", L.V2_NEGATIVE_RESEARCH_TERMS, None),
        "blame": ("list", L.V2_BLAME_TERMS, None),
        "refusal": ("list", L.V2_REFUSAL_TERMS, None),
        "demographic_change": ("list", L.V2_DEMOGRAPHIC_CHANGE_TERMS, None),
        "minority_community": ("list", L.V2_MINORITY_COMMUNITY_TERMS, None),
        "economic_contrast": ("pair", L.V2_ECONOMIC_CONTRAST_PAIRS, L.V2_ECONOMIC_CONTRAST_WEIGHT),
        "positive_research": ("pair", L.V2_POSITIVE_RESEARCH_PATTERNS, L.V2_POSITIVE_RESEARCH_WEIGHT),
        "legitimate_systemic": ("pair", L.V2_LEGITIMATE_SYSTEMIC_PATTERNS, L.V2_LEGITIMATE_SYSTEMIC_WEIGHT),
        "intent": ("category", L.V2_INTENT_MARKERS, None),
        "framing": ("category", L.V2_FRAMING_MARKERS, None),
        "evidence": ("category", L.V2_EVIDENCE_MARKERS, None),
        "structure": ("category", L.V2_STATEMENT_STRUCTURES, None),
        "relation": ("relation", L.V2_CONTEXTUAL_RELATIONSHIPS, L.V2_RELATION_WEIGHT),
    },
    "v1": {
        "explicit": ("term", L.EXPLICIT_RACIAL_TERMS, L.V1_WEIGHTS["explicit"]),
        "coded": ("term", L.V1_CODED_RACIAL_TERMS, L.V1_WEIGHTS["coded"]),
        "stereotype": ("term", L.V1_RACIAL_STEREOTYPES, L.V1_WEIGHTS["stereotype"]),
        "pseudo_scientific": ("term", L.V1_PSEUDO_SCIENTIFIC_TERMS, 0.2),
        "property_economic": ("term", L.V1_PROPERTY_ECONOMIC_TERMS, 0.15),
        "cultural_supremacy": ("term", L.V1_CULTURAL_SUPREMACY_TERMS, 0.2),
        "historical": ("term", L.V1_HISTORICAL_BIAS_TERMS, 0.2),
        "analytical": ("term", L.V1_ANALYTICAL_BIAS_TERMS, 0.15),
        "war": ("list", L.V1_WAR_TERMS, None),
        "jobs": ("list", L.V1_ECONOMIC_TERMS, None),
        "they": ("list", L.V1_STEREOTYPE_TERMS, None),
        "context": ("pair", L.V1_CONTEXTUAL_PAIRS, L.V1_CONTEXT_WEIGHT),
    },
}
KINDS = ("term", "list", "pair", "category", "relation")


def default_rows(versions: Iterable[str] = ("v2", "v1"), kinds: Iterable[str] = KINDS) -> list[tuple]:
    """The published lists as rows, in their order."""
    out = []

    def add(version, name, kind, weight, members):
        out.extend((version, name, kind, category, i, term, weight) for i, (category, term) in enumerate(members))

    for v in versions:
        for name, (kind, lists, weight) in SPEC[v].items():
            if kind not in kinds:
                continue
            if kind in ("term", "list"):
                add(v, name, kind, weight, [(None, t) for t in lists])
            elif kind == "pair":
                add(v, name, kind, weight, [(first, t) for first, seconds in lists for t in seconds])
            elif kind == "category":
                for group, categories in lists.items():
                    add(v, f"{name}.{group}", kind, weight, [(c, t) for c, terms in categories.items() for t in terms])
            else:
                for group, relations in lists.items():
                    for which, pairs in relations.items():
                        add(v, f"{name}.{group}.{which}", kind, weight, pairs)
    return out


class RuleSet:
    """One version's lists.

    ``terms[name]``: terms; ``weights[name]``: their weights; ``pairs[name]``:
    (first, seconds, weight); ``categories[name][group]``: category -> terms;
    ``relations[(group, kind)]``: (first, second, weight).
    """

    def __init__(self, version: str, rows: Iterable[tuple]):
        if version not in SPEC:
            raise ValueError(f"version must be one of {sorted(SPEC)}")
        self.version = version
        self.terms: dict[str, list[str]] = defaultdict(list)
        self.weights: dict[str, dict[str, float]] = defaultdict(dict)
        self.pairs: dict[str, list[tuple[str, list[str], float]]] = defaultdict(list)
        self.categories: dict[str, dict[str, dict[str, list[str]]]] = defaultdict(dict)
        self.relations: dict[tuple[str, str], list[tuple[str, str, float]]] = defaultdict(list)
        own = [r for r in rows if r[0] == version]
        for _, name, kind, category, _, term, weight in sorted(own, key=lambda r: (r[1], r[4] if r[4] is not None else 0)):
            self._add(name, kind, category, term, weight)

    def _add(self, name, kind, category, term, weight):
        spec = SPEC[self.version].get(name.split(".")[0])
        if spec is None or spec[0] != kind or not term or name.count(".") != {"category": 1, "relation": 2}.get(kind, 0):
            raise ValueError(f"no rule of {self.version} reads {kind} {name!r} with term {term!r}; names are {sorted(SPEC[self.version])}")
        if kind in ("pair", "category", "relation") and not category:
            raise ValueError(f"{kind} {name!r}, term {term!r}, needs a category")
        weight = spec[2] if weight is None else float(weight)
        if kind in ("term", "list"):
            self.terms[name].append(term)
            self.weights[name][term] = weight
        elif kind == "pair":
            pairs = self.pairs[name]
            if pairs and pairs[-1][0] == category:
                pairs[-1][1].append(term)
            else:
                pairs.append((category, [term], weight))
        elif kind == "category":
            group, which = name.split(".")
            self.categories[group].setdefault(which, {}).setdefault(category, []).append(term)
        else:
            _, group, which = name.split(".")
            self.relations[(group, which)].append((category, term, weight))

    def by_weight(self, name: str) -> list[tuple[float, list[str]]]:
        """The list's terms by weight, weights in order of their first term."""
        out: dict[float, list[str]] = {}
        for t in self.terms[name]:
            out.setdefault(self.weights[name][t], []).append(t)
        return list(out.items())

    def all_terms(self) -> list[str]:
        out = [t for ts in self.terms.values() for t in ts]
        out += [t for pairs in self.pairs.values() for first, seconds, _ in pairs for t in (first, *seconds)]
        out += [t for groups in self.categories.values() for cats in groups.values() for ts in cats.values() for t in ts]
        out += [t for pairs in self.relations.values() for first, second, _ in pairs for t in (first, second)]
        return out


V2 = RuleSet("v2", default_rows(["v2"]))
V1 = RuleSet("v1", default_rows(["v1"]))


def rule_set(lexicon, version: str) -> RuleSet:
    """The published rule set (None), the given one, or that of a table of rows."""
    if lexicon is None:
        return {"v2": V2, "v1": V1}[version]
    if isinstance(lexicon, RuleSet):
        if lexicon.version != version:
            raise ValueError(f"a rule set of {lexicon.version} can't score {version}")
        return lexicon
    mine = lexicon.where(lexicon["version"] == version)
    cols = ["version", "name", "kind", "category", "ordinal", "term", "weight"]
    return RuleSet(version, [tuple(r) for r in mine.select(*cols).collect()])
