"""C1 and G2 by the inverted q-gram join: equal to Python's `in`, for lexicons of any size."""

import random
from collections import Counter

import pytest

from slantscan.operators import lexicon as LX

LEX = "version string, name string, ordinal int, term string"


def brute(rows, lexicon):
    out = Counter()
    for k, t in rows:
        low = " ".join((t or "").split()).lower()
        out.update((k, v, n, term) for v, n, _, term in lexicon if term in low)
    return out


def random_case(seed):
    rng = random.Random(seed)
    alphabet = ["a", "b", "c", " ", "é", "ß", "Ω", "\U0001f600", ".", "\n"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(80)]
    rows += [(None, rows[3][1]), (5, rows[5][1]), (5, "abc"), (90, None), (91, ""), (92, "aaaaaaaaaaaaaaaa")] + [(100 + i, "hot text abc \U0001f600é") for i in range(60)]
    terms = {"".join(rng.choice(alphabet[:9]) for _ in range(rng.randrange(1, 12))) for _ in range(150)} | {"aaaaaaaa", "aaaaaaaaa", "a", "hot text abc \U0001f600é", "t abc \U0001f600"}
    lexicon = [("v1" if rng.random() < 0.5 else "v2", rng.choice("xy"), i, t) for i, t in enumerate(sorted(terms)) for _ in range(2)]
    return rows, sorted(set(lexicon))


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_equal_brute_force(spark, seed):
    rows, lexicon = random_case(seed)
    df = spark.createDataFrame(rows, "id long, comment_text string").repartition(3)
    got = Counter(tuple(r) for r in LX.gram_matches(df, spark.createDataFrame(lexicon, LEX)).collect())
    assert got == brute(rows, lexicon)


def test_without_a_held_lexicon_results_stay(spark, monkeypatch):
    rows, lexicon = random_case(3)
    df, lex = spark.createDataFrame(rows, "id long, comment_text string"), spark.createDataFrame(lexicon, LEX)
    lex = lex.dropDuplicates(["version", "name", "term"])
    want = Counter(tuple(r) for r in LX.lexicon_matches(df, lex).collect())
    counts = LX.term_counts(df, lex)
    monkeypatch.setattr(LX, "HELD", 10)
    assert Counter(tuple(r) for r in LX.lexicon_matches(df, lex).collect()) == want
    more = LX.term_counts(df, lex)
    assert more.columns == counts.columns
    assert Counter(tuple(r) for r in more.collect()) == Counter(tuple(r) for r in counts.collect())


def test_300000_terms(spark):
    rng = random.Random(4)
    terms = list({"".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(6, 12))) for _ in range(310_000)})[:300_000]
    assert len(terms) == 300_000 > LX.HELD
    rows = [(i, " x ".join(rng.choice(terms) for _ in range(5))) for i in range(100)]
    lex = spark.createDataFrame([("v", "n", i, t) for i, t in enumerate(terms)], LEX)
    got = Counter(tuple(r) for r in LX.lexicon_matches(spark.createDataFrame(rows, "id long, comment_text string"), lex).collect())
    known = set(terms)
    want = Counter()
    for k, t in rows:
        low = " ".join(t.split()).lower()
        want.update((k, "v", "n", g) for g in {low[i : i + n] for n in range(6, 12) for i in range(len(low) - n + 1)} if g in known)
    assert got == want


def test_empty_lexicon_and_empty_term(spark):
    df = spark.createDataFrame([(1, "abc")], "id long, comment_text string")
    assert LX.gram_matches(df, spark.createDataFrame([], LEX)).count() == 0
    assert LX.gram_counts(df, spark.createDataFrame([], LEX)).columns == ["id"]
    assert LX.gram_matches(df, spark.createDataFrame([("v", "n", 0, None)], LEX)).count() == 0
    with pytest.raises(Exception, match="empty term"):
        LX.gram_matches(df, spark.createDataFrame([("v", "n", 0, "")], LEX)).count()


# ---- word boundaries ---------------------------------------------------------------

WORDS = ["race", "embrace", "a b", "they don't", "(x", "c++", "é", "r", "race a", "\\E", "10"]


def between_words(low, term):
    at = low.find(term)
    while at >= 0:
        if not (at and low[at - 1].isalnum()) and not low[at + len(term) : at + len(term) + 1].isalnum():
            return True
        at = low.find(term, at + 1)
    return False


def edge_texts(seed=6):
    rng = random.Random(seed)
    parts = ["race", "embrace", " ", "  ", "\n", "a", "b", "'", "they don't", "(x", "c++", "é", "1", "10", "-", "r", "\\E", "Race A"]
    return ["embrace", "a race.", "traced", "the race", None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(200)]


@pytest.mark.parametrize("engine", ["automaton", "regex", "contains"])
def test_word_boundaries_in_every_engine(spark, engine):
    from slantscan.functions.terms import TermIndex, with_term_flags
    texts = edge_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, comment_text string")
    idx = TermIndex(WORDS, engine=engine, word_boundary=True)
    d = with_term_flags(df, "comment_text", idx, raw=True)
    got = {r.id: r for r in d.select("id", idx.hits().matched(WORDS).alias("m"), idx.hits(True).matched(WORDS, raw=True).alias("raw")).collect()}
    for i, t in enumerate(texts):
        low = " ".join((t or "").split()).lower()
        assert got[i].m == [w for w in WORDS if between_words(low, w)], t
        assert got[i].raw == [w for w in WORDS if between_words((t or "").lower(), w)], t


def test_word_boundaries_in_the_gram_join_and_the_score(spark):
    from slantscan.plans.analyze import analyze, score_v1, score_v2
    df = spark.createDataFrame(list(enumerate(edge_texts())), "id long, comment_text string")
    lex = spark.createDataFrame([("v", "n", i, w) for i, w in enumerate(WORDS)], LEX)
    a = Counter(tuple(r) for r in LX.lexicon_matches(df, lex, word_boundary=True).collect())
    assert a == Counter(tuple(r) for r in LX.gram_matches(df, lex, word_boundary=True).collect())
    one = spark.createDataFrame([(1, "we embrace the urbane", 0.0), (2, "the urban race", 0.0)], "id long, comment_text string, model_score double")
    for score in (score_v2, score_v1):
        plain, strict = ({r.id: r.bias_score for r in score(one, word_boundary=w).collect()} for w in (False, True))
        assert plain[1] == plain[2] == strict[2] > 0 and strict[1] == 0
    assert [r.pattern_tags for r in analyze(one, word_boundary=True).orderBy("id").collect()] == [[], ["explicit racial terms", "coded racial language"]]


# ---- only posted grams leave a text ---------------------------------------------------


def test_texts_give_posted_grams_only(spark):
    """What a text sends into the join does not grow with its length."""
    rng = random.Random(9)
    long = "".join(rng.choice("bcdfg hklm") for _ in range(20_000)) + " zebra crossings at noon"
    terms = ["zebra", "z", "crossings at", "qq"]
    df, lex = spark.createDataFrame([(1, long)], "id long, comment_text string"), spark.createDataFrame([("v", "n", i, t) for i, t in enumerate(terms)], LEX)
    posted, lengths = LX._posted(LX._entries(lex))
    grams = LX._with_grams(LX._texts(df, "comment_text", "id"), posted, lengths).first()["__grams"]
    assert {"zebra", "z"} <= set(grams) and len(grams) == len(set(grams)) < 50
    assert sorted(r.term for r in LX.gram_matches(df, lex).collect()) == ["crossings at", "z", "zebra"]


@pytest.mark.parametrize("held", [0, LX.HELD])
def test_held_or_not_the_gram_join_is_the_same(spark, monkeypatch, held):
    monkeypatch.setattr(LX, "HELD", held)
    rows, lexicon = random_case(10)
    rows += [(200, "abc" * 9 + "abcabcabd"), (201, "a\0 \0b"), (202, "\U0001f600" * 20)]
    lexicon = [*lexicon, ("v1", "x", 900, "abcabcabcabd"), ("v1", "x", 901, "\0b"), ("v2", "y", 902, "\U0001f600" * 9), ("v2", "y", 903, "a\0")]
    df, lex = spark.createDataFrame(rows, "id long, comment_text string"), spark.createDataFrame(lexicon, LEX)
    assert Counter(tuple(r) for r in LX.gram_matches(df, lex).collect()) == brute(rows, lexicon)


def test_hits_are_counted_before_they_meet_the_lexicons(spark):
    """A word of many items is one hit a text, not one an item."""
    from conftest import SF_SMALL
    from slantscan.plans import registry as R
    plan = R.Q["lexicon_matches_grams"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate [term")
