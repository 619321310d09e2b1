"""Lexicons as a table of rows: compiled to what the rules read, changed by a user's rows."""

import pytest
from pyspark.sql import functions as F

from conftest import texts_df
from slantscan import lexicons as L
from slantscan.functions import rule_model as M
from slantscan.functions import rules_v1, rules_v2
from slantscan.operators.lexicon import lexicon_matches
from slantscan.plans.analyze import analyze, score_v1, score_v2
from slantscan.sources import lexicon_table as T


def test_default_rows_compile_to_the_published_lists():
    assert M.V2.terms["coded"] == L.V2_CODED_RACIAL_TERMS and M.V2.terms["refusal"] == L.V2_REFUSAL_TERMS
    for name, lists in (("economic_contrast", L.V2_ECONOMIC_CONTRAST_PAIRS), ("positive_research", L.V2_POSITIVE_RESEARCH_PATTERNS), ("legitimate_systemic", L.V2_LEGITIMATE_SYSTEMIC_PATTERNS)):
        assert [(a, b) for a, b, _ in M.V2.pairs[name]] == [(a, list(b)) for a, b in lists]
    assert [(a, b) for a, b, _ in M.V1.pairs["context"]] == [(a, list(b)) for a, b in L.V1_CONTEXTUAL_PAIRS]
    for name, lists in (("intent", L.V2_INTENT_MARKERS), ("framing", L.V2_FRAMING_MARKERS), ("evidence", L.V2_EVIDENCE_MARKERS), ("structure", L.V2_STATEMENT_STRUCTURES)):
        assert M.V2.categories[name] == lists
        assert all(list(M.V2.categories[name][g]) == list(lists[g]) for g in lists)
    for group, kinds in L.V2_CONTEXTUAL_RELATIONSHIPS.items():
        for kind, pairs in kinds.items():
            assert [(a, b) for a, b, _ in M.V2.relations[(group, kind)]] == pairs
    assert {r[2] for r in T.rows()} == set(M.KINDS)


@pytest.mark.parametrize("version", ["v2", "v1"])
def test_the_table_scores_as_the_default(spark, version):
    texts = ["Urban immigrants drain welfare, research shows lower crime.", "They always say these people are lazy.", "", None,
             "Communities face barriers to access in healthcare; studies indicate disparities in employment.", "The civil war list of black, white and cuban units."]
    df = texts_df(spark, texts, 0.4)
    cols = ["id", "is_biased", "confidence", "explanation", "alternative", "pattern_tags"]
    a = analyze(df, version=version).select(*cols).orderBy("id").collect()
    b = analyze(df, version=version, lexicon=T.rule_df(spark)).select(*cols).orderBy("id").collect()
    assert a == b


def test_a_user_row_changes_the_score(spark):
    df = texts_df(spark, ["the quokka sat"], 0.0)
    row = spark.createDataFrame([("v2", "coded", "term", None, 99, "quokka", 0.9), ("v1", "coded", "term", None, 99, "quokka", None)], T.SCHEMA)
    own = T.rule_df(spark).unionByName(row)
    assert score_v2(df).first().bias_score == 0.0
    r = score_v2(df, lexicon=own).first()
    assert r.bias_score == pytest.approx(0.7 * 0.9) and r.is_biased
    assert score_v1(df, lexicon=own).first().bias_score == pytest.approx(0.65 * 0.3)
    assert "coded racial language" in analyze(df, lexicon=own).first().pattern_tags
    assert {(m.version, m.term) for m in lexicon_matches(df, own).where("term = 'quokka'").collect()} == {("v1", "quokka"), ("v2", "quokka")}


def test_weights_differ_within_a_list(spark):
    rows = [("v2", "coded", "term", None, i, t, w) for i, (t, w) in enumerate([("aa", 0.1), ("bb", 0.25), ("cc", 0.1)])]
    lex = M.RuleSet("v2", rows)
    r = score_v2(texts_df(spark, ["aa bb cc", "bb", "cc aa", "x"], 0.0), lexicon=lex).orderBy("id").collect()
    assert [x.bias_score for x in r] == pytest.approx([0.7 * 0.45, 0.7 * 0.25, 0.7 * 0.2, 0.0])


def test_missing_lists_never_fire(spark):
    lex = M.RuleSet("v2", [])
    got = analyze(texts_df(spark, ["racist urban they research shows"], 0.5), lexicon=lex).first()
    assert got.confidence == pytest.approx(0.15) and got.pattern_tags == []
    got = analyze(texts_df(spark, ["racist urban they"], 0.5), lexicon=M.RuleSet("v1", []), version="v1").first()
    assert got.confidence == pytest.approx(0.175) and got.pattern_tags == []


def test_rows_that_no_rule_reads_are_refused():
    for row in [("v2", "codded", "term", None, 0, "x", None), ("v2", "coded", "pair", "a", 0, "x", None), ("v2", "intent", "category", "a", 0, "x", None),
                ("v2", "coded", "term", None, 0, "", None), ("v1", "context", "pair", None, 0, "x", None), ("v2", "relation.a", "relation", "a", 0, "x", None)]:
        with pytest.raises(ValueError):
            M.RuleSet(row[0], [row])
    with pytest.raises(ValueError):
        M.rule_set(M.V1, "v2")


def test_clashing_columns_are_refused(spark):
    df = texts_df(spark, ["a"], 0.1)
    for c in ("confidence", "explanation", "alternative", "is_biased", "pattern_tags", "category_scores"):
        with pytest.raises(ValueError, match=c):
            analyze(df.withColumn(c, F.lit(1)))
    assert analyze(df.withColumn("confidence", F.lit(1)), as_struct=True).first().confidence == 1
    with pytest.raises(ValueError, match="bias_score"):
        score_v2(df.withColumn("bias_score", F.lit(1)))


def test_terms_of_both_versions_are_indexed():
    assert set(rules_v2.terms()) == set(M.V2.all_terms()) and "library" not in rules_v1.terms()
