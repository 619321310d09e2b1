"""Scoring and analysis plans (H1, H2, H9) over a DataFrame of texts.

Each plan is a chain of projections over the input: no shuffle, no join.
Term matching is one pass per text (see ``functions/terms.py``); every
feature, rule and report column is a JVM expression. A row's score is computed once and reused by decision, explanation
and suggestion (the published detector re-ran the scorer up to three times
per text).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import report, rules_v1, rules_v2
from ..functions.rule_model import V1, V2, RuleSet, rule_set
from ..functions.terms import Hits, TermIndex, drop_work_columns, session_engine, with_term_flags
from ..session import spread

MODEL_SCORE = "model_score"


def _model(df: DataFrame, model_score: str | None) -> Column:
    if model_score and model_score in df.columns:
        return F.coalesce(F.col(model_score).cast("double"), F.lit(0.0))
    return F.lit(0.0)


def _materialise(df: DataFrame, cols: dict[str, Column], prefix: str) -> tuple[DataFrame, dict[str, Column]]:
    df = df.select("*", *[c.alias(prefix + k) for k, c in cols.items()])
    return df, {k: F.col(prefix + k) for k in cols}


def _refuse_clashes(df: DataFrame, names: list[str]) -> None:
    clash = [c for c in df.columns if c in names]
    if clash:
        raise ValueError(f"the table already has columns {clash}; rename or drop them")


def term_hits(df: DataFrame, text: str, terms: Sequence[str], engine: str | None = None,
              word_boundary: bool = False) -> tuple[DataFrame, Hits]:
    """The bitmap of these terms alone, for a feature of a few lists. ``engine="contains"`` keeps
    it on the JVM, where normalising the text alone costs more than the default's single pass."""
    idx = TermIndex(terms, engine=session_engine(df, engine), word_boundary=word_boundary)
    return with_term_flags(spread(df), text, idx), idx.hits()


def v2_flags(df: DataFrame, text: str, raw: bool = False, engine: str | None = None, lex: RuleSet = V2,
             word_boundary: bool = False) -> tuple[DataFrame, Hits]:
    """The bitmap of the V2 terms; V2 reads no token features."""
    idx = TermIndex(rules_v2.terms(lex), engine=session_engine(df, engine), word_boundary=word_boundary)
    return with_term_flags(spread(df), text, idx, raw=raw), idx.hits(raw)


def v1_flags(df: DataFrame, text: str, raw: bool = False, engine: str | None = None, lex: RuleSet = V1,
             word_boundary: bool = False) -> tuple[DataFrame, Hits]:
    """The bitmap of the V1 terms and the token windows. A base word can only be
    a token of a text that contains it: only such texts are tokenised."""
    idx = TermIndex(rules_v1.terms(lex), engine=session_engine(df, engine), word_boundary=word_boundary)
    out = with_term_flags(spread(df), text, idx, raw=raw, keep=rules_v1.base_words(lex))
    return rules_v1.add_token_windows(out, lex=lex), idx.hits(raw)


def score_v2(df: DataFrame, text: str = "comment_text", model_score: str | None = MODEL_SCORE,
             engine: str | None = None, keep_work: bool = False, lexicon: DataFrame | RuleSet | None = None,
             word_boundary: bool = False) -> DataFrame:
    """H2: adds ``bias_score`` and ``is_biased``. ``lexicon``: rows of ``functions.rule_model``
    (default: the published lists); they are read on the driver and held by every task.
    ``word_boundary``: terms count only where no letter or digit stands next to them."""
    m = _model(df, model_score)
    keep = df.columns
    _refuse_clashes(df, ["bias_score", "is_biased"])
    lex = rule_set(lexicon, "v2")
    d, h = v2_flags(df, text, engine=engine, lex=lex, word_boundary=word_boundary)
    d, f = _materialise(d, rules_v2.features(h, lex), "__f_")
    d = d.select(*keep, *f.values())
    d = d.select("*", rules_v2.base_score(f).alias("__base"))
    d = d.select("*", rules_v2.final_score(f, F.col("__base"), m).alias("bias_score"))
    d = d.select("*", report.decide(F.col("bias_score")).alias("is_biased"))
    return d if keep_work else drop_work_columns(d, keep)


def score_v1(df: DataFrame, text: str = "comment_text", model_score: str | None = MODEL_SCORE,
             engine: str | None = None, keep_work: bool = False, lexicon: DataFrame | RuleSet | None = None,
             word_boundary: bool = False) -> DataFrame:
    """H1: adds ``bias_score`` and ``is_biased`` (and ``context_tags``). ``lexicon`` and
    ``word_boundary`` as in ``score_v2``."""
    m = _model(df, model_score)
    keep = df.columns
    _refuse_clashes(df, ["bias_score", "is_biased", "context_tags"])
    lex = rule_set(lexicon, "v1")
    d, h = v1_flags(df, text, engine=engine, lex=lex, word_boundary=word_boundary)
    d, f = _materialise(d, rules_v1.features(h, lex), "__f_")
    d = d.select(*keep, *f.values())
    d = d.select("*", rules_v1.final_score(f, m).alias("bias_score"))
    d = d.select("*", report.decide(F.col("bias_score")).alias("is_biased"),
                 F.col("__f_tags").alias("context_tags"))
    return d if keep_work else drop_work_columns(d, keep)


def analyze(df: DataFrame, text: str = "comment_text", model_score: str | None = MODEL_SCORE,
            version: str = "v2", engine: str | None = None, as_struct: bool = False,
            lexicon: DataFrame | RuleSet | None = None, word_boundary: bool = False) -> DataFrame:
    """H9: decision, confidence, category scores, explanation, suggestion.

    ``lexicon`` and ``word_boundary`` as in ``score_v2``. A table that has one of the added columns already
    is refused. The explanation reads the raw text like the published detector (a term
    broken over a line is scored but not explained); pass normalised text
    to avoid that.
    """
    if version not in ("v1", "v2"):
        raise ValueError("version must be 'v1' or 'v2'")
    fields = ["is_biased", "confidence", "category_scores", "explanation", "alternative"]
    _refuse_clashes(df, ["analysis"] if as_struct else [*fields, "pattern_tags"])
    m = _model(df, model_score)
    keep = df.columns
    lex = rule_set(lexicon, version)
    if version == "v2":
        d, h = v2_flags(df, text, raw=True, engine=engine, lex=lex, word_boundary=word_boundary)
        d, f = _materialise(d, rules_v2.features(h, lex), "__f_")
        d, st = _materialise(d, rules_v2.structure_scores(h, lex), "__st_")
        d, rel = _materialise(d, rules_v2.relation_scores(h, raw=True, lex=lex), "__rel_")
        d = d.select(*keep, *f.values(), *st.values(), *rel.values(),
                     rules_v2.pattern_tags(h, st, rel, lex).alias("__tags"))
        d = d.select("*", rules_v2.base_score(f).alias("__base"))
        d = d.select("*", rules_v2.final_score(f, F.col("__base"), m).alias("__score"))
        conf = F.col("__score")
        middle = rules_v2.structure_sentences(st, rel, conf)
    else:
        d, h = v1_flags(df, text, raw=True, engine=engine, lex=lex, word_boundary=word_boundary)
        d, f = _materialise(d, rules_v1.features(h, lex), "__f_")
        _, raw_tags = rules_v1.context_score(h, raw=True, lex=lex)
        d = d.select("*", raw_tags.alias("__rawtags"))
        d = d.select(*keep, *f.values(), rules_v1.pattern_tags(h, F.col("__rawtags"), lex).alias("__tags"))
        d = d.select("*", rules_v1.final_score(f, m).alias("__score"))
        conf = F.col("__score")
        middle = None
    d = d.select("*", report.decide(conf).alias("__biased"))
    biased = F.col("__biased")
    scores = {"race": conf, "gender": F.lit(0.0), "religion": F.lit(0.0), "sexual_orientation": F.lit(0.0)}
    added = [
        biased.alias("is_biased"),
        conf.alias("confidence"),
        report.category_scores(conf).alias("category_scores"),
        report.explanation(biased, conf, F.col("__tags"), middle).alias("explanation"),
        report.suggest(biased, scores).alias("alternative"),
    ]
    out = d.select("*", F.struct(*added).alias("analysis")) if as_struct else d.select("*", *added, F.col("__tags").alias("pattern_tags"))
    return drop_work_columns(out, keep)
