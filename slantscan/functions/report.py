"""Decision, category scores, confidence band, explanation, suggestion (H3-H8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as L


def decide(score: Column, threshold: float = L.BIAS_THRESHOLD) -> Column:
    """H3: strictly greater than the threshold."""
    return score > F.lit(threshold)


def category_scores(race: Column) -> Column:
    """H4: only race is scored; the other three are 0."""
    return F.create_map(
        F.lit("race"), race,
        F.lit("gender"), F.lit(0.0),
        F.lit("religion"), F.lit(0.0),
        F.lit("sexual_orientation"), F.lit(0.0),
    )


def confidence_band(score: Column) -> Column:
    """H5."""
    return (
        F.when(score > 0.8, F.lit("highly confident"))
        .when(score > 0.6, F.lit("moderately confident"))
        .otherwise(F.lit("somewhat confident"))
    )


def two_decimals(x: Column) -> Column:
    """Python's ``f'{x:.2f}'`` for scores in [0, 1] (half-even on the binary value)."""
    return F.format_number(x, 2)


def explanation(is_biased: Column, confidence: Column, tags: Column,
                middle: Column | None = None, race: Column | None = None) -> Column:
    """H7: fixed sentence when not biased, else confidence, band, optional
    framing sentences, detected patterns and the race score."""
    race = confidence if race is None else race
    middle = F.lit("") if middle is None else middle
    text = F.concat(
        F.lit("The text shows signs of bias (confidence: "), two_decimals(confidence), F.lit("). "),
        F.lit("The model is "), confidence_band(confidence), F.lit(" this text contains bias. "),
        middle,
        F.when(F.size(tags) > 0,
               F.concat(F.lit("Detected patterns include: "), F.array_join(tags, ", "), F.lit(". ")))
        .otherwise(F.lit("")),
        F.when(race > 0, F.concat(F.lit("Racial bias score: "), two_decimals(race))).otherwise(F.lit("")),
    )
    return F.when(is_biased, text).otherwise(F.lit(L.NOT_BIASED_EXPLANATION))


def top_category(scores: dict[str, Column]) -> Column:
    """First category (in map order) with the highest score."""
    names = [c for c in L.CATEGORY_ORDER if c in scores]
    best = F.greatest(*[scores[c] for c in names]) if len(names) > 1 else scores[names[0]]
    out = F.lit(None).cast("string")
    for c in reversed(names):
        out = F.when(scores[c] == best, F.lit(c)).otherwise(out)
    return out


def suggest(is_biased: Column, scores: dict[str, Column]) -> Column:
    """H8: the suggestion for the top category; null when not biased."""
    lookup = F.create_map(*[x for k, v in L.SUGGESTIONS.items() for x in (F.lit(k), F.lit(v))])
    return F.when(
        is_biased,
        F.coalesce(F.element_at(lookup, top_category(scores)), F.lit(L.DEFAULT_SUGGESTION)),
    )
