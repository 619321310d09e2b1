import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slantscan.operators import aggregate as AG
from slantscan.operators import prep as P
from slantscan.operators import sample as S


def test_dedup_keeps_first_in_source_order(spark):
    rows = [(5, 2, "same"), (3, 1, "same"), (9, 1, "same"), (1, 0, "other"), (2, 3, None), (4, 1, None)]
    df = spark.createDataFrame(rows, "id long, source_rank int, comment_text string")
    got = sorted((r.id, r.source_rank, r.comment_text) for r in P.dedup_keep_first(df).collect())
    assert got == [(1, 0, "other"), (3, 1, "same"), (4, 1, None)]


def test_dedup_hot_key_partial_aggregation(spark):
    df = spark.range(0, 30000).select(F.col("id"), (F.col("id") % 3).cast("int").alias("source_rank"),
                                      F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("comment_text"))
    out = P.dedup_keep_first(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan.replace(" ", "") or "partial" in plan
    assert out.filter(F.col("comment_text") == "hot").first().id == 0
    assert out.count() == 20001


def test_annotator_means_ignores_missing(spark):
    rows = [(1, 0.2, None), (1, 0.4, None), (2, None, None)]
    df = spark.createDataFrame(rows, "comment_id long, toxic double, insult double")
    got = {r.comment_id: r for r in P.annotator_means(df, scores=["toxic", "insult"]).collect()}
    assert got[1].toxic == pytest.approx(0.3) and got[1].insult is None and got[2].toxic is None


def _comments(spark, rows):
    cols = ["identity_attack", "severe_toxicity", "insult", "threat"] + P.RACE_COLUMNS
    schema = "id long, comment_text string, target double, " + ", ".join(f"{c} double" for c in cols)
    return spark.createDataFrame(rows, schema)


def test_labels_are_strict(spark):
    z = [None] * 9
    rows = [
        (1, "a", 0.9, 0.2, None, None, 0.2, 0.21, *[None] * 4),   # metrics .2 (not > .2) but threat .2 -> no
        (2, "b", 0.1, 0.25, None, None, None, 0.25, *[None] * 4),  # v2 yes, v1 no (<= .3)
        (3, "c", None, 0.31, None, None, None, None, None, None, 0.31, None),  # both yes
        (4, "d", None, *z),
    ]
    df = P.fill_missing(_comments(spark, rows))
    v1 = {r.id: r.race_bias for r in P.derive_label(df, "v1").collect()}
    v2 = {r.id: r.race_bias for r in P.derive_label(df, "v2").collect()}
    assert v1 == {1: 0, 2: 0, 3: 1, 4: 0}
    assert v2 == {1: 0, 2: 1, 3: 1, 4: 0}


def test_target_split_skips_missing(spark):
    df = _comments(spark, [(1, "a", 0.5, *[None] * 9), (2, "b", 0.51, *[None] * 9), (3, "c", None, *[None] * 9)])
    r = P.target_split(df).first()
    assert (r.total, r.toxic_n, r.non_toxic_n) == (3, 1, 1)


def test_require_columns(spark):
    with pytest.raises(ValueError, match="identity_attack"):
        P.require_columns(spark.createDataFrame([(1,)], "black int"))


def test_eligible_length_edges(spark):
    df = spark.createDataFrame([(1, 1, "x" * 50), (2, 1, "x" * 51), (3, 0, "x" * 60)], "id long, label int, comment_text string")
    assert [r.id for r in P.eligible(df, 1).collect()] == [2]


def _labelled(spark, n0, n1):
    rows = [(i, f"t{i}", 0) for i in range(n0)] + [(n0 + i, f"t{n0 + i}", 1) for i in range(n1)]
    return spark.createDataFrame(rows, "id long, comment_text string, label int")


def test_balanced_sample_exact_and_partition_independent(spark):
    df = _labelled(spark, 300, 40)
    a = S.balanced_sample(df, cap=25)
    b = S.balanced_sample(df.repartition(7), cap=25)
    ga = sorted((r.id, r.label) for r in a.collect())
    assert ga == sorted((r.id, r.label) for r in b.collect())
    assert sum(1 for _, l in ga if l == 0) == 25 and sum(1 for _, l in ga if l == 1) == 25
    c = S.balanced_sample(df, cap=1000)  # class smaller than the cap
    assert c.filter("label = 1").count() == 40 and c.filter("label = 0").count() == 40


def test_balanced_sample_empty_class(spark):
    df = _labelled(spark, 10, 0)
    assert S.balanced_sample(df).count() == 10
    with pytest.raises(ValueError):
        S.balanced_sample(df, fallback="raise")


def test_stratified_split_ceil(spark):
    df = _labelled(spark, 11, 7)
    got = S.stratified_split(df).groupBy("label", "split").count().collect()
    counts = {(r.label, r.split): r["count"] for r in got}
    assert counts[(0, "val")] == math.ceil(11 * 0.2) and counts[(1, "val")] == math.ceil(7 * 0.2)
    approx = S.stratified_split(_labelled(spark, 5000, 0), exact=False).filter("split = 'val'").count()
    assert 850 < approx < 1150


def test_shuffle_rank_and_debug_sample(spark):
    df = _labelled(spark, 30, 0)
    r = [x.shuffle_rank for x in S.shuffle(df).collect()]
    assert sorted(r) == list(range(1, 31))
    assert S.debug_sample(df, 1000).count() == 30 and S.debug_sample(df, 7).count() == 7


def test_best_candidate_ties_and_zero(spark):
    rows = [(1, "a", 0.5, 0.0, 1.0), (2, "b", 0.6, 0.7, 0.9), (3, "c", 0.9, 0.7, 0.8)]
    cand = spark.createDataFrame(rows, "ordinal int, params string, train_f1 double, val_f1 double, val_loss double")
    assert S.best_candidate(cand).first().ordinal == 2
    assert S.best_candidate(cand.filter("ordinal = 1")).count() == 0


def test_class_weights_and_metrics(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    w = AG.class_weights(df).first()
    assert w.negative_weight == pytest.approx(8 / 12) and w.positive_weight == pytest.approx(2.0)
    assert AG.pos_weight(df).first().pos_weight == pytest.approx(3.0)
    assert AG.class_weights(df.filter("label = 0")).first().positive_weight is None
    pm = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "pred int, label int")
    m = AG.binary_metrics(pm).first()
    p, r = 2 / (3 + 1e-10), 2 / (3 + 1e-10)
    assert (m.tp, m.fp, m.fn) == (2, 1, 1) and m.f1 == pytest.approx(2 * p * r / (p + r + 1e-10))


def test_focal_loss_matches_numpy(spark):
    x = np.array([-3.0, -0.5, 0.0, 2.0, 7.5])
    y = np.array([0.0, 1.0, 1.0, 0.0, 1.0])
    bce = np.maximum(x, 0) - x * y + np.log1p(np.exp(-np.abs(x)))
    want = float(np.mean((1 - np.exp(-bce)) ** 2 * bce))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "logit double, label int")
    assert AG.focal_loss(df).first().focal_loss == pytest.approx(want)


def test_union_sources_and_attach(spark):
    a = spark.createDataFrame([(1, "x", 0.5)], "id long, comment_text string, target double")
    b = spark.createDataFrame([(2, "y")], "id long, comment_text string")
    u = P.union_sources([a, b]).orderBy("id").collect()
    assert [(r.id, r.source_rank, r.target) for r in u] == [(1, 0, 0.5), (2, 1, None)]
    sc = spark.createDataFrame([(1, 0.9)], "id long, model_score double")
    got = {r.id: r.model_score for r in P.attach_scores(P.union_sources([a, b]), sc).collect()}
    assert got == {1: 0.9, 2: 0.0}


def test_empty_class_guard(spark):
    with pytest.raises(ValueError):
        AG.empty_class_guard(_labelled(spark, 5, 0))
    assert AG.empty_class_guard(_labelled(spark, 5, 2)) == (5, 2)


def test_prepare_job_v1_v2(spark):
    from slantscan.plans.train import prepare
    from slantscan.sources import tables as T
    comments = T.comments(spark, "/root/testdata/sf0.001")
    for version, cap in (("v1", 1000), ("v2", 2000)):
        ps = prepare(spark, comments, version=version)
        dist = ps.distribution.first()
        n = min(dist.positives, dist.negatives, cap)
        t = ps.training.collect()
        assert len(t) == 2 * n and sorted(r.shuffle_rank for r in t) == list(range(1, 2 * n + 1))
        w = ps.class_weights.first()
        assert w.total == dist.total


def test_spread_is_off_unless_asked_for(spark):
    from slantscan.session import SPREAD_KEY, spread
    one = spark.range(100).coalesce(1)
    assert spread(one) is one
    spark.conf.set(SPREAD_KEY, "6")
    try:
        assert spread(one).rdd.getNumPartitions() == 6
        assert sorted(r.id for r in spread(one).collect()) == list(range(100))
    finally:
        spark.conf.unset(SPREAD_KEY)


def test_user_columns_survive(spark):
    from slantscan.plans.analyze import analyze, score_v1, score_v2
    df = spark.createDataFrame([(1, "black crime", 0.2, "mine")], "id long, comment_text string, model_score double, __mine string")
    for out in (score_v2(df), score_v1(df), analyze(df)):
        assert out.first()["__mine"] == "mine" and [c for c in out.columns if c.startswith("__")] == ["__mine"]


def test_keys_are_not_filled_and_scores_do_not_multiply(spark):
    df = spark.createDataFrame([(None, "a", None), (2, "b", 0.5)], "id long, comment_text string, black double")
    assert sorted((r.id or 0, r.black) for r in P.fill_missing(df).collect()) == [(0, 0.0), (2, 0.5)]
    assert P.fill_missing(df).filter("id IS NULL").count() == 1
    sc = spark.createDataFrame([(2, 0.4), (2, 0.9)], "id long, model_score double")
    got = P.attach_scores(df, sc).collect()
    assert len(got) == 2 and {r.model_score for r in got} == {0.0, 0.9}


def test_samples_refine_the_border_prefix(spark, monkeypatch):
    """Several levels of hash prefixes give the rows of a plain sort."""
    import hashlib
    monkeypatch.setattr(S, "FEW", 1)
    monkeypatch.setattr(S, "PREFIX", 1)
    df = spark.range(500).selectExpr("id", "cast(id % 3 = 0 AS int) AS label")
    order = sorted(range(500), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert {r.id for r in S.debug_sample(df, 137).collect()} == set(order[:137])
    val = {r.id for r in S.stratified_split(df).filter("split = 'val'").collect()}
    assert val == {i for k in (0, 1) for c in [[i for i in order if (i % 3 == 0) == bool(k)]] for i in c[: math.ceil(len(c) * 0.2)]}
    assert [r.id for r in S.shuffle(df).orderBy("shuffle_rank").collect()] == order
    assert S.debug_sample(df, 0).count() == 0 and S.debug_sample(df.limit(0), 5).count() == 0


def test_dedup_hot_null_and_tied_rows(spark):
    rows = [(k, 0, "same") for k in range(300, 100, -1)] + [(1, 1, None), (2, 0, None), (5, 3, "x"), (5, 3, "x"), (None, 2, "y"), (7, 2, "y")]
    df = spark.createDataFrame(rows, "id long, source_rank int, comment_text string")
    got = sorted((r.comment_text or "", r.source_rank, r.id or 0) for r in P.dedup_keep_first(df).collect())
    assert got == [("", 0, 2), ("same", 0, 101), ("x", 3, 5), ("y", 2, 0)]


def test_lexicon_versions_stay_apart(spark):
    from slantscan.operators.lexicon import lexicon_matches, term_counts
    from slantscan.sources.lexicon_table import lexicon_df
    df = spark.createDataFrame([(1, "the black urban lazy")], "id long, comment_text string")
    m = lexicon_matches(df, lexicon_df(spark)).filter("lexicon = 'explicit' AND term = 'black'").collect()
    assert sorted(r.version for r in m) == ["v1", "v2"]
    assert term_counts(df, lexicon_df(spark)).first().n_v2_explicit == 1
    assert term_counts(df, lexicon_df(spark, ("v2",))).first().n_explicit == 1


def test_class_examples_of_the_whole_training_table(spark):
    from conftest import SF_SMALL
    from slantscan.plans import registry
    t = registry._training(spark, SF_SMALL)
    got = {r.id for r in registry.Q["class_examples_all"](spark, SF_SMALL).collect()}
    key = F.md5(F.concat_ws(":", F.lit(str(S.SEED)), F.col("id").cast("string")))
    want = set()
    for label in (0, 1):
        long = t.where((F.col("label") == label) & (F.length(registry.clean_text("comment_text")) > 50))
        want |= {r.id for r in long.orderBy(key, "id").limit(5).collect()}
    assert got == want and len(got) == 10


def test_prepare_counts_the_written_table_once(spark):
    from slantscan.plans.train import prepare
    from slantscan.sources import tables as T
    comments = T.comments(spark, "/root/testdata/sf0.001")
    for version in ("v1", "v2"):
        ps = prepare(spark, comments, version=version)
        whole = P.dedup_keep_first(comments) if version == "v2" else comments
        labelled = P.prepare_training_set(whole, version)
        assert ps.distribution.first() == AG.label_distribution(labelled).first()
        assert ps.target_split.first() == P.target_split(whole).first()
        assert ps.class_weights.first() == AG.class_weights(labelled).first()
    ps = prepare(spark, comments, debug_rows=50)
    assert ps.distribution.first()["total"] == 50
    none = comments.withColumn("identity_attack", F.lit(0.0)).withColumn("severe_toxicity", F.lit(0.0)).withColumn("insult", F.lit(0.0)).withColumn("threat", F.lit(0.0))
    with pytest.raises(ValueError, match="one or both classes"):
        prepare(spark, none)
    with pytest.raises(ValueError, match="black"):
        prepare(spark, comments.drop("black"))
