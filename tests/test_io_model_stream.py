import os
import shutil
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from slantscan.operators import model as M
from slantscan.operators import prep as P
from slantscan.plans import registry as R
from slantscan.plans.analyze import analyze
from slantscan.sources import csv as C
from slantscan.sources import tables as T
from slantscan.streaming.score_stream import start_parquet_stream

from conftest import SF_SMALL


def test_csv_round_trip_and_optional_sources(spark):
    d = tempfile.mkdtemp(prefix="slantscan-csv-")
    train = os.path.join(d, "train.csv")
    pd.DataFrame({"id": [1, 2], "comment_text": ['he said "no",\nthen left', "back\\slash"], "target": [0.7, None],
                  "extra": ["a", "b"], "black": [0.5, 0.1]}).to_csv(train, index=False)
    ann = os.path.join(d, "ann.csv")
    pd.DataFrame({"comment_id": [1, 1], "toxic": [0.2, 0.4]}).to_csv(ann, index=False)
    df = C.load_sources(spark, [(train, "comments"), (os.path.join(d, "missing.csv"), "comments"), (ann, "annotations")])
    rows = df.orderBy("source_rank", "id").collect()
    assert rows[0].comment_text == 'he said "no",\nthen left' and rows[1].comment_text == "back\\slash"
    assert rows[2].comment_id == 1 and rows[2].toxic == pytest.approx(0.3)
    assert C.load_sources(spark, [(os.path.join(d, "missing.csv"), "comments")]) is None
    out = os.path.join(d, "bias_dataset")
    C.write_training_set(df.select("comment_text", F.lit(1).alias("label")).filter("comment_text is not null"), out, "csv")
    back = C.read_training_set(spark, out, "csv").collect()
    assert sorted(r.comment_text for r in back) == sorted(['he said "no",\nthen left', "back\\slash"])


def test_csv_columns_go_by_name(spark):
    d = tempfile.mkdtemp(prefix="slantscan-csv-")
    path = os.path.join(d, "train.csv")
    pd.DataFrame({"black": [0.7, None], "obscene": [0.1, 0.2], "comment_text": ["a", "b"], "id": [5, 6],
                  "identity_attack": [0.3, 0.4]}).to_csv(path, index=False)
    rows = {r.id: r for r in C.read_comments(spark, path).collect()}
    assert (rows[5].black, rows[5].identity_attack, rows[5].comment_text) == (0.7, 0.3, "a") and rows[6].black is None
    assert set(C.read_comments(spark, path).columns) == {"id", "comment_text", "black", "identity_attack"}
    with pytest.raises(ValueError, match="latino"):
        P.require_columns(C.read_comments(spark, path))
    with pytest.raises(ValueError, match="comment_id"):
        C.read_annotations(spark, path)
    assert C.load_sources(spark, [(path, "comments"), (path, "annotations")]).count() == 2


def test_csv_bad_rows_are_not_zeroed(spark):
    d = tempfile.mkdtemp(prefix="slantscan-csv-")
    path = os.path.join(d, "train.csv")
    with open(path, "w") as f:
        f.write("id,comment_text,black\n1,good,0.5\n2,bad number,much\n3,too few\n4,too,0.1,many\n5,empty,\n")
    good = C.read_comments(spark, path, bad="reject").collect()
    assert sorted((r.id, r.black) for r in good) == [(1, 0.5), (5, None)]
    assert C.read_comments(spark, path, bad="only").count() == 3
    with pytest.raises(Exception, match="doesn't fit its columns"):
        C.read_comments(spark, path).collect()


def test_stream_restart_loses_nothing(spark):
    src, sink = tempfile.mkdtemp(prefix="slantscan-src-"), tempfile.mkdtemp(prefix="slantscan-sink-")
    docs = T.read_table(spark, SF_SMALL, "documents")

    def prep(s):
        return s.select(F.col("doc_id").alias("id"), F.col("text").alias("comment_text"))
    for k in range(2):  # start, stop, another file arrives, start again
        docs.filter(F.col("doc_id") % 2 == k).coalesce(1).write.mode("append").parquet(src)
        q = start_parquet_stream(spark, src, docs.schema, sink, prepare=prep)
        q.awaitTermination(300)
    stream = spark.read.parquet(sink).select("id", "confidence")
    batch = analyze(prep(docs)).select("id", "confidence")
    assert stream.count() == docs.count() and stream.exceptAll(batch).count() == 0


def test_classifier_train_validate_save(spark):
    d = R._labelled_docs(spark, SF_SMALL)
    m = M.train_classifier(d.filter("split = 'train'"), max_iter=10)
    v = M.validate(m, d.filter("split = 'val'")).first()
    assert v.n > 0 and 0.0 <= v.f1 <= 1.0 and v.val_loss >= 0.0
    path = tempfile.mkdtemp(prefix="slantscan-model-")
    M.save_model(m, path)
    again = M.model_scores(d.limit(5), M.load_model(path)).collect()
    assert all(0.0 <= r.model_score <= 1.0 for r in again)


def test_candidates_share_features(spark):
    """A candidate is the model that a fit of its own would give."""
    d = R._labelled_docs(spark, SF_SMALL)
    train, val = d.filter("split = 'train'"), d.filter("split = 'val'")
    grid = [{"reg_param": 0.1, "max_iter": 5}, {"reg_param": 0.01, "max_iter": 5, "weighted": False}]
    cand, models = M.select_model(train, val, grid)
    got = cand.orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == [1, 2] and got[1].params == "reg_param=0.01,max_iter=5,weighted=False"
    for r, m, params in zip(got, models, grid, strict=True):
        own = M.validate(M.train_classifier(train, **params), val).first()
        kept = M.validate(m, val).first()
        for one in (own, kept):
            assert abs(one.f1 - r.val_f1) < 1e-9 and abs(one.val_loss - r.val_loss) < 1e-6


class LengthScorer:
    """A stand-in external model (shipped by value: workers cannot import test modules)."""

    def score(self, texts):
        return texts.str.len().clip(upper=100) / 100.0


def test_external_scorer(spark):
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    df = spark.createDataFrame([(1, "abc"), (2, "x" * 500)], "id long, comment_text string")
    got = {r.id: r.model_score for r in M.external_scores(df, LengthScorer).collect()}
    assert got == {1: pytest.approx(0.03), 2: pytest.approx(1.0)}


@pytest.mark.parametrize("version", ["v2", "v1"])
def test_stream_equals_batch(spark, version):
    docs = T.read_table(spark, SF_SMALL, "documents")
    sink = tempfile.mkdtemp(prefix="slantscan-sink-")

    def prep(s):
        return s.select(F.col("doc_id").alias("id"), T.planted_text(F.col("doc_id"), F.col("text")).alias("comment_text"),
                        T.model_score(F.col("doc_id")).alias("model_score"))
    q = start_parquet_stream(spark, SF_SMALL, docs.schema, sink, prepare=prep, glob="documents.parquet",
                             version=version)
    q.awaitTermination(300)
    stream = R.flat_analysis(spark.read.parquet(sink))
    batch = R.flat_analysis(analyze(prep(docs), version=version))
    assert stream.count() == batch.count() == docs.count()
    assert stream.exceptAll(batch).count() == 0


def test_session_engine_setting(spark):
    from slantscan.plans.analyze import score_v2
    from slantscan.sources.tables import planted
    p = planted(spark, SF_SMALL)
    base = score_v2(p).select("id", "bias_score")
    spark.conf.set("spark.slantscan.termEngine", "regex")
    try:
        plan = score_v2(p)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" in plan and "ArrowEvalPython" not in plan
        assert score_v2(p).select("id", "bias_score").exceptAll(base).count() == 0
    finally:
        spark.conf.unset("spark.slantscan.termEngine")


def test_stream_in_micro_batches(spark):
    src = tempfile.mkdtemp(prefix="slantscan-src-")
    docs = T.read_table(spark, SF_SMALL, "documents")
    for k in range(3):  # three files arrive
        docs.filter(F.col("doc_id") % 3 == k).coalesce(1).write.mode("append").parquet(src)
    sink = tempfile.mkdtemp(prefix="slantscan-sink-")

    def prep(s):
        return s.select(F.col("doc_id").alias("id"), F.col("text").alias("comment_text"))
    q = start_parquet_stream(spark, src, docs.schema, sink, prepare=prep, max_files_per_trigger=1)
    q.awaitTermination(300)
    assert len(q.recentProgress) >= 3
    stream = spark.read.parquet(sink).select("id", "confidence", "explanation")
    batch = analyze(prep(docs)).select("id", "confidence", "explanation")
    assert stream.count() == docs.count() and stream.exceptAll(batch).count() == 0


def test_train_bias_model_end_to_end(spark):
    from slantscan.plans.train import train_bias_model
    d = tempfile.mkdtemp(prefix="slantscan-e2e-")
    comments = T.comments(spark, SF_SMALL).toPandas()
    comments.drop(columns=["source_rank"]).to_csv(os.path.join(d, "train.csv"), index=False)
    T.annotations(spark, SF_SMALL).toPandas().to_csv(os.path.join(d, "ann.csv"), index=False)
    cand = train_bias_model(spark, [(os.path.join(d, "train.csv"), "comments"),
                                    (os.path.join(d, "absent.csv"), "comments"),
                                    (os.path.join(d, "ann.csv"), "annotations")],
                            os.path.join(d, "bias_dataset"), os.path.join(d, "model"), fmt="csv")
    rows = cand.collect()
    assert len(rows) == 3 and sum(r.selected for r in rows) <= 1
    written = C.read_training_set(spark, os.path.join(d, "bias_dataset"), "csv")
    dist = written.groupBy("label").count().collect()
    assert len(dist) == 2 and dist[0]["count"] == dist[1]["count"]
    assert train_bias_model(spark, [(os.path.join(d, "absent.csv"), "comments")], d + "/x", d + "/y") is None


@pytest.mark.parametrize("parts", [0, 1, 3])
def test_registered_stream_reads_a_table_in_parts(spark, parts):
    """The documents table may be a folder of files (of any number, also without rows), not only one file."""
    sf = tempfile.mkdtemp(prefix="slantscan-parts-")
    docs = T.read_table(spark, SF_SMALL, "documents")
    (docs.repartition(parts) if parts else docs.limit(0)).write.parquet(f"{sf}/documents.parquet")
    stream, batch = R.Q["score_stream"](spark, sf), R.Q["analyze"](spark, sf)
    assert stream.schema == batch.schema
    assert stream.count() == batch.count() == (docs.count() if parts else 0)
    assert stream.exceptAll(batch).count() == 0


def test_registered_stream_reads_one_file_beside_partitioned_tables(spark):
    """Of a table in one file only that file is listed: folders beside it may be partitioned in any way."""
    sf = tempfile.mkdtemp(prefix="slantscan-beside-")
    shutil.copy(f"{SF_SMALL}/documents.parquet", sf)
    T.read_table(spark, SF_SMALL, "pages").withColumn("part", F.col("page_id") % 2) \
        .write.partitionBy("part").parquet(f"{sf}/pages.parquet")
    stream, batch = R.Q["score_stream"](spark, sf), R.Q["analyze"](spark, sf)
    assert stream.count() == batch.count() == T.read_table(spark, SF_SMALL, "documents").count()
    assert stream.exceptAll(batch).count() == 0
