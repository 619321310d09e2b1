"""Golden scores derived by hand from the rule sets (FIXTURES.md §5)."""

import pytest
from pyspark.sql import functions as F

from slantscan.plans.analyze import analyze, score_v1, score_v2
from slantscan.sources.tables import PLANTED_SENTENCES as S

from conftest import texts_df

WEATHER = "The weather is nice today."
JOBS = "Those people are taking all our jobs and living off welfare."
RACE = "People from that race are always causing trouble."
# two control texts of the published paired test set (pairs 1 and 3)
PAIR1 = ("During the Jim Crow era, African Americans faced systematic discrimination in voting, \n"
         "    education, and employment, demonstrating how institutionalized racism shaped American society.")
PAIR3 = ("Research shows performance disparities between racial groups can be traced to systemic \n"
         "    inequalities in educational resources and opportunities.")

V2 = [
    (WEATHER, lambda m: .3 * m),
    (JOBS, lambda m: min(1.0, .84 + .3 * m)),
    (RACE, lambda m: .28 + .3 * m),
    (PAIR1, lambda m: .3 * m),
    (PAIR3, lambda m: .56 + .3 * m),
    (S[0], lambda m: .3 * m),
    (S[7], lambda m: .06 * m),
    (S[8], lambda m: .35 + .3 * m),
    (S[9], lambda m: .35 + .3 * m),
    (S[10], lambda m: max(.6, .49 + .3 * m)),
    (S[13], lambda m: 1.0),
    (S[14], lambda m: .7),
    (S[19], lambda m: .56 + .3 * m),
    (S[20], lambda m: .028 + .03 * m),
]
V1 = [
    (WEATHER, lambda m: .35 * m),
    (JOBS, lambda m: .53625 + .35 * m),
    (RACE, lambda m: .2275 + .35 * m),
    (S[0], lambda m: .35 * m),
    (S[22], lambda m: 1.0),
]
MODELS = [0.0, 0.15, 0.5, 0.95, 1.0]


@pytest.mark.parametrize("m", MODELS)
def test_v2_golden(spark, m):
    texts = [t for t, _ in V2]
    got = {r.id: r for r in score_v2(texts_df(spark, texts, m)).collect()}
    for i, (t, f) in enumerate(V2):
        assert got[i].bias_score == pytest.approx(f(m), abs=1e-9), t
        assert got[i].is_biased == (f(m) > 0.33), t


@pytest.mark.parametrize("m", MODELS)
def test_v1_golden(spark, m):
    texts = [t for t, _ in V1]
    got = {r.id: r for r in score_v1(texts_df(spark, texts, m)).collect()}
    for i, (t, f) in enumerate(V1):
        assert got[i].bias_score == pytest.approx(f(m), abs=1e-9), t


def test_v2_without_terms_never_flagged(spark):
    r = score_v2(texts_df(spark, ["plain words only"], 1.0)).first()
    assert r.bias_score == pytest.approx(0.3) and not r.is_biased


def test_explanation_and_suggestion(spark):
    a = analyze(texts_df(spark, [JOBS, WEATHER], 0.5)).orderBy("id").collect()
    assert a[0].is_biased and a[0].explanation.startswith("The text shows signs of bias (confidence: 0.99). "
                                                          "The model is highly confident this text contains bias. ")
    assert "Detected patterns include: coded racial language, racial stereotyping, economic bias language" in a[0].explanation
    assert a[0].explanation.endswith("Racial bias score: 0.99")
    assert a[0].alternative.startswith("Consider focusing on individual characteristics")
    assert a[0].category_scores == {"race": pytest.approx(0.99), "gender": 0.0, "religion": 0.0, "sexual_orientation": 0.0}
    assert not a[1].is_biased and a[1].explanation == "No significant bias detected in the text." and a[1].alternative is None


def test_line_broken_term_scored_not_explained(spark):
    a = analyze(texts_df(spark, [S[26]], 1.0)).first()
    assert a.confidence == pytest.approx(0.3 + 0.28)  # 'inner city' counts after normalisation
    assert "coded racial language" not in a.explanation  # but the raw text does not contain it


def test_v1_explanation_lists_context_tags(spark):
    a = analyze(texts_df(spark, [S[22]], 0.0), version="v1").first()
    assert a.is_biased and a.confidence == 1.0
    for tag in ["historical bias context", "analytical bias language", "multiple ethnic group references",
                "war-ethnic context", "explicit racial terms"]:
        assert tag in a.explanation


def test_struct_output(spark):
    a = analyze(texts_df(spark, [JOBS], 0.0), as_struct=True)
    assert a.schema["analysis"].dataType.fieldNames() == ["is_biased", "confidence", "category_scores",
                                                         "explanation", "alternative"]


def test_scores_in_unit_interval_and_versions_agree_with_analyze(spark):
    from pyspark.sql import functions as F

    from slantscan.sources.tables import planted
    p = planted(spark, "/root/testdata/sf0.001")
    for fn in (score_v1, score_v2):
        s = fn(p).agg(F.min("bias_score").alias("lo"), F.max("bias_score").alias("hi")).first()
        assert 0.0 <= s.lo <= s.hi <= 1.0
    a = analyze(p).select("id", F.col("confidence").alias("bias_score"), "is_biased")
    b = score_v2(p).select("id", "bias_score", "is_biased")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _v2_counts(spark, text):
    from slantscan.functions import rules_v2
    from slantscan.plans.analyze import v2_flags
    d, h = v2_flags(texts_df(spark, [text]), "comment_text")
    return d.select(*[c.alias(k) for k, c in rules_v2.lexicon_counts(h).items()]).first()


def test_q2_q3_substrings_inside_words_and_nested_terms(spark):
    c = _v2_counts(spark, "Suburban mathematics embrace.")
    assert c.explicit_n == 1 and c.coded_n == 1  # 'race' in embrace, 'urban' in suburban
    c = _v2_counts(spark, "Demographics: taking our jobs.")
    assert c.explicit_n == 2 and c.coded_n == 2  # demographic+demographics, our jobs+taking our jobs


def test_q9_q12_v1_token_context(spark):
    from pyspark.sql import functions as F
    # 'way of life' never equals a token; 'property' is a base twice -> the same tag twice
    r = score_v1(texts_df(spark, ["Property values matter in a traditional way of life."], 0.0)).first()
    assert r.context_tags == ["property-values", "traditional-values", "property-values",
                              "property/economic dog whistles"]
    ctx = (0.15 * 1 + 0.15 * 1 + 0.15 * 1 + 0.15 * 1) * (1 + 0.1 * 3)
    coded = 2 * 0.30  # property values, way of life (coded phrases are substrings)
    pattern = min(coded + ctx, 1.0)
    final = min((0.35 * 0.0 + 0.65 * pattern) * (1 + 0.15 * 4), 1.0)
    assert r.bias_score == pytest.approx(final, abs=1e-12)


def test_two_decimals_match_python_formatting(spark):
    import random

    from slantscan.functions.report import two_decimals
    rnd = random.Random(3)
    vals = [i / 1000 for i in range(1001)] + [k / 8 for k in range(9)] + [rnd.random() for _ in range(2000)]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    for r in df.select("x", two_decimals(F.col("x")).alias("s")).collect():
        assert r.s == f"{r.x:.2f}"


def test_threshold_edges_are_strict(spark):
    from slantscan.functions.report import confidence_band, decide
    df = spark.createDataFrame([(0.33,), (0.3300001,), (0.6,), (0.6000001,), (0.8,), (0.8000001,)], "x double")
    got = [(r.b, r.band) for r in df.select(decide(F.col("x")).alias("b"), confidence_band(F.col("x")).alias("band")).collect()]
    assert got == [(False, "somewhat confident"), (True, "somewhat confident"), (True, "somewhat confident"),
                   (True, "moderately confident"), (True, "moderately confident"), (True, "highly confident")]
