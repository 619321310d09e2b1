"""Both rule chains against their DuckDB statement on random texts.

Texts are random mixes of lexicon terms (V1 and V2), filler words and
whitespace of several kinds, with random model scores: many more rule
combinations and threshold edges than the planted corpus reaches.
"""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slantscan.functions import rules_v1, rules_v2
from slantscan.plans import oracle as O
from slantscan.plans.analyze import analyze

from conftest import texts_df  # noqa: F401

N = 1500
FILLER = ["the", "a", "of", "and", "people", "city", "values", "is", "they", "them", "work",
          "Research", "SHOWS", "in", "to", "property", "traditional", "data", "access", "race"]
SPACES = [" ", " ", " ", "  ", "\n", "\t", " ", ", ", ". "]


def random_texts(seed=11):
    rnd = random.Random(seed)
    vocab = sorted(set(rules_v2.terms()) | set(rules_v1.terms()))
    rows = []
    for i in range(N):
        k = rnd.randint(0, 9)
        words = [rnd.choice(vocab) if rnd.random() < 0.6 else rnd.choice(FILLER) for _ in range(k)]
        text = "".join(w + rnd.choice(SPACES) for w in words)
        if rnd.random() < 0.3:
            text = text.upper() if rnd.random() < 0.5 else text.title()
        rows.append((i, text, rnd.choice([0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 1.0])))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    rows = random_texts()
    df = spark.createDataFrame(rows, "id long, comment_text string, model_score double")
    con = duckdb.connect()
    con.register("t", pd.DataFrame(rows, columns=["id", "comment_text", "model_score"]))
    return df, con


SRC = "src AS (SELECT id, comment_text, model_score FROM t)"


def _compare(spark_rows, duck_rows, cols):
    a = {r[0]: tuple(r[1:]) for r in spark_rows}
    b = {r[0]: tuple(r[1:]) for r in duck_rows}
    assert a.keys() == b.keys()
    bad = [(k, a[k], b[k]) for k in a if a[k] != b[k]]
    assert not bad, bad[:3]


def test_v2_random(data):
    df, con = data
    sql = (f"WITH {O.v2_analysis_ctes(SRC)} SELECT id, round(score, 9), score > {O.D(0.33)}, "
           f"{O.explanation_sql('score', 'tags', O.v2_middle())} FROM v2t")
    sp = analyze(df).select("id", F.round("confidence", 9), "is_biased", "explanation").collect()
    _compare(sp, con.execute(sql).fetchall(), 3)


def test_v1_random(data):
    df, con = data
    sql = (f"WITH {O.v1_score_ctes(SRC)}, v1t AS (SELECT *, {O.v1_pattern_tags_expr()} AS ptags FROM v1) "
           f"SELECT id, round(score, 9), score > {O.D(0.33)}, {O.explanation_sql('score', 'ptags')} FROM v1t")
    sp = analyze(df, version="v1").select("id", F.round("confidence", 9), "is_biased", "explanation").collect()
    _compare(sp, con.execute(sql).fetchall(), 3)
