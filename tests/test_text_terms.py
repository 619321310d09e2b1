import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slantscan.functions.terms import TermIndex, trie_pattern, with_term_flags
from slantscan.functions.text import clean_text, normalise_text, truncated_tokens

EDGE = [None, "", "   ", "a\tb", "a\u00a0b", "a\u2003b", "x\n    y", "  Mixed CASE  ",
        "tab\t\tand\r\nnewline", "\u3000lead and trail\u0085", "x\x1cy"]


def test_normalise_matches_python_split(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGE)], "id int, t string")
    got = {r.id: (r.n, r.c) for r in df.select("id", normalise_text("t").alias("n"), clean_text("t").alias("c")).collect()}
    for i, t in enumerate(EDGE):
        want = None if t is None else " ".join(t.split())
        assert got[i][0] == want
        assert got[i][1] == (want or "")


def test_truncated_tokens(spark):
    text = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(text,), ("",)], "t string")
    rows = df.select(truncated_tokens("t").alias("k")).collect()
    assert len(rows[0].k) == 256 and rows[0].k[0] == "w0" and rows[0].k[-1] == "w255"
    assert rows[1].k == []


TERMS = ["race", "racial", "racist", "demographic", "demographics", "they", "they all", "they always",
         "I heard", "won't work", "self-sufficient", "our jobs", "taking our jobs", "way of life",
         "our way of life", "a", "ab", "abc", "bc", "c++", "x.y"]

TEXTS = ["embrace the demographics", "they always said they all won't work", "taking our jobs is our way of life",
         "i heard it", "abc", "self-sufficient racist traced", "c++ and x.y and xzy", "", "nothing"]


def present(df, idx, raw=False):
    """Per row the set of indexed terms that each single-term expression finds."""
    h = idx.hits(raw)
    rows = with_term_flags(df, "t", idx, raw=raw).select(
        "id", *[h.hit(t, raw).alias(f"h{i}") for i, t in enumerate(idx.terms)]).collect()
    return {r.id: {t for i, t in enumerate(idx.terms) if r[f"h{i}"]} for r in rows}


@pytest.mark.parametrize("engine", TermIndex.ENGINES)
def test_engines_equal_substring_semantics(spark, engine):
    idx = TermIndex(TERMS, engine=engine)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    found = present(df, idx)
    for i, text in enumerate(TEXTS):
        low = " ".join(text.split()).lower()
        assert found[i] == {t for t in TERMS if t in low}, (engine, text)


@pytest.mark.parametrize("engine", TermIndex.ENGINES)
def test_bitmaps_over_several_longs(spark, engine):
    """More terms than a long has bits; counts, repeats in a list, numbers of the
    matched terms, raw texts, nulls and the kept text."""
    terms = [f"w{i:03d}" for i in range(150)] + ["w001 w002"]
    idx = TermIndex(terms, engine=engine)
    texts = ["w000 w062 W063 w064 w125 w126 w149", "w001\n w002", "w001 w002", None, "", " ".join(terms)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    h = idx.hits(raw=True)
    rows = with_term_flags(df, "t", idx, raw=True, keep=["w063"]).select(
        "id", h.count(terms).alias("n"), h.count(["w062", "w063", "w062"]).alias("twice"), h.count([]).alias("none"),
        h.any(terms).alias("any"), h.any([]).alias("never"), h.places().alias("places"),
        h.hit("w001 w002").alias("split"), h.hit("w001 w002", raw=True).alias("raw_split"),
        h.count(["w001", "w002"], raw=True).alias("raw_n"), h.matched(["w149", "w000"]).alias("matched"), "__lt")
    for r in rows.collect():
        low = " ".join((texts[r.id] or "").split()).lower()
        want = [i for i, t in enumerate(terms) if t in low]
        assert r.n == len(want) and r.places == want and r.any == bool(want), texts[r.id]
        assert r.twice == 2 * ("w062" in low) + ("w063" in low) and r.none == 0 and not r.never
        assert r.split == ("w001 w002" in low) and r.raw_split == ("w001 w002" in (texts[r.id] or ""))
        assert r.raw_n == ("w001" in low) + ("w002" in low)
        assert r.matched == [t for t in ("w149", "w000") if t in low]
        assert r["__lt"] == low if "w063" in low else r["__lt"] in ("", low)


def test_trie_pattern_longest_first():
    import re
    p = re.compile("(?=(" + trie_pattern(["they", "they all", "they always"]) + "))")
    assert [m.group(1) for m in p.finditer("they always")] == ["they always"]


ALPHABET = "abcr ey'-.+x"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, min_size=1, max_size=6), min_size=1, max_size=12, unique=True),
       st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=8))
def test_engines_property(spark, terms, texts):
    terms = [t for t in terms if t.strip() == t and "  " not in t and t]
    if not terms:
        return
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    results = [present(df, TermIndex(terms, engine=e)) for e in TermIndex.ENGINES]
    assert results[0] == results[1] == results[2]
    raws = [present(df, TermIndex(terms, engine=e), raw=True) for e in TermIndex.ENGINES]
    assert raws[0] == raws[1] == raws[2] == {i: {t for t in terms if t in x.lower()} for i, x in enumerate(texts)}


def test_analyze_same_for_every_engine(spark):
    from slantscan.plans.analyze import analyze, score_v1
    from slantscan.sources.tables import PLANTED_SENTENCES, planted
    extra = ["The inner\n    city and our\tjobs", "These\u00a0people   on welfare", "  \u3000 ", None,
             "Research shows\nimproved outcomes; they lack\r\nvalues"] + PLANTED_SENTENCES
    df = planted(spark, "/root/testdata/sf0.001").unionByName(
        spark.createDataFrame([(10_000 + i, t, 0.5) for i, t in enumerate(extra)],
                              "id long, comment_text string, model_score double"))
    outs = [analyze(df, engine=e).select("id", "confidence", "explanation", "pattern_tags") for e in
            ("automaton", "regex", "contains")]
    for o in outs[1:]:
        assert outs[0].exceptAll(o).count() == 0 and o.exceptAll(outs[0]).count() == 0
    v1 = [score_v1(df, engine=e).select("id", "bias_score", "context_tags") for e in ("automaton", "contains")]
    assert v1[0].exceptAll(v1[1]).count() == 0


def test_adding_neutral_word_changes_no_count(spark):
    from slantscan.plans.analyze import v2_flags
    from slantscan.functions import rules_v2
    base = ["These people rely on welfare.", "Research shows improved outcomes."]
    rnd = random.Random(1)
    more = [t + " " + rnd.choice(["zzz", "qqq", "xyzzy"]) for t in base]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(base + more)], "id int, comment_text string")
    d, h = v2_flags(df, "comment_text")
    c = d.select("id", *[v.alias(k) for k, v in rules_v2.lexicon_counts(h).items()]).orderBy("id").collect()
    assert [tuple(r)[1:] for r in c[:2]] == [tuple(r)[1:] for r in c[2:]]


def test_matcher_without_its_library_fails(monkeypatch):
    """No silent change of engine: the caller names another one."""
    import importlib.util
    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None)
    with pytest.raises(ImportError, match="pyahocorasick"):
        TermIndex(["race"])
    assert TermIndex(["race"], engine="regex").engine == "regex"


def test_lexicon_table_and_term_counts(spark):
    from slantscan.operators.lexicon import lexicon_matches, term_counts
    from slantscan.sources.lexicon_table import lexicon_df
    lex = lexicon_df(spark, ("v1",))
    assert {r.name for r in lex.select("name").distinct().collect()} == {
        "explicit", "coded", "stereotype", "pseudo_scientific", "property_economic",
        "cultural_supremacy", "historical", "analytical"}
    texts = ["Studies show group differences in property values.", "Nothing here.", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, comment_text string")
    counts = {r.id: r for r in term_counts(df, lex).collect()}
    rows = lex.collect()
    for i, t in enumerate(texts):
        low = " ".join((t or "").split()).lower()
        for name in ("explicit", "coded", "pseudo_scientific", "property_economic"):
            want = sum(r.term in low for r in rows if r.name == name)
            assert counts[i][f"n_{name}"] == want, (t, name)
    m = lexicon_matches(df, lex).collect()
    assert all(r.id == 0 for r in m) and ("pseudo_scientific", "studies show") in {(r.lexicon, r.term) for r in m}
