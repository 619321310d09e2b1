"""Classifier scores: training, validation, selection and batch scoring.

The published detector fine-tunes a large network on a GPU; it is not
available here, so its probability enters the rule chain as a column. This
module gives that column two sources:

* a distributed Spark ML text classifier (tokenise, hash, IDF, logistic
  regression with class weights), trained and applied on the cluster;
* any external scorer object with ``score(pd.Series) -> pd.Series`` of
  probabilities, applied in an iterator pandas UDF (one scorer per task).

The Spark ML model is a different, weaker model than the network: its F1 is
its own, not the published detector's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..session import ensure_checkpoint_dir
from .aggregate import EPS, focal_term
from .sample import best_candidate

NUM_FEATURES = 1 << 18


def with_class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """D3 as a weight column: n / (2 n_c) per row (two counts, then a projection)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    n, p = row["n"], row["p"]
    neg = n - p
    w_pos = n / (2.0 * p) if p else 0.0
    w_neg = n / (2.0 * neg) if neg else 0.0
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(w_pos)).otherwise(F.lit(w_neg)))


def feature_stages() -> list:
    """Tokens, hashed term frequencies and IDF: what no candidate's parameters change."""
    tok = RegexTokenizer(inputCol="__clean", outputCol="__tokens", pattern=r"\W+", minTokenLength=1)
    tf = HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=NUM_FEATURES)
    return [tok, tf, IDF(inputCol="__tf", outputCol="__features", minDocFreq=1)]


def regression(label: str = "label", weight: str | None = "weight", reg_param: float = 0.01,
               max_iter: int = 50) -> LogisticRegression:
    lr = LogisticRegression(featuresCol="__features", labelCol=label, regParam=reg_param,
                            maxIter=max_iter, probabilityCol="__prob", rawPredictionCol="__raw",
                            predictionCol="__pred")
    return lr.setWeightCol(weight) if weight else lr


def pipeline(text: str = "comment_text", label: str = "label", weight: str | None = "weight",
             reg_param: float = 0.01, max_iter: int = 50) -> Pipeline:
    return Pipeline(stages=[*feature_stages(), regression(label, weight, reg_param, max_iter)])


def _prepare(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("__clean", clean_text(text))


def train_classifier(train: DataFrame, text: str = "comment_text", label: str = "label",
                     reg_param: float = 0.01, max_iter: int = 50, weighted: bool = True) -> PipelineModel:
    """Fit on the cluster; class weights (D3) as ``weightCol``."""
    df = _prepare(train, text).withColumn(label, F.col(label).cast("double"))
    if weighted:
        df = with_class_weights(df, label)
    return pipeline(text, label, "weight" if weighted else None, reg_param, max_iter).fit(df)


def model_scores(df: DataFrame, model: PipelineModel, text: str = "comment_text",
                 out: str = "model_score", keep_logit: bool = False) -> DataFrame:
    """I1 (Spark ML): probability of the positive class per row."""
    scored = model.transform(_prepare(df, text))
    cols = [c for c in df.columns] + [vector_to_array("__prob")[1].alias(out)]
    if keep_logit:
        cols.append(vector_to_array("__raw")[1].alias("logit"))
    return scored.select(*cols)


def external_scores(df: DataFrame, make_scorer: Callable[[], object], text: str = "comment_text",
                    out: str = "model_score") -> DataFrame:
    """I1 (external): ``make_scorer()`` is called once per task; its ``score``
    maps a batch of normalised texts to probabilities."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for texts in batches:
            yield pd.Series(scorer.score(texts), dtype="float64").reset_index(drop=True)

    return df.withColumn(out, score(clean_text(text)))


def validate(model: PipelineModel, val: DataFrame, text: str = "comment_text",
             label: str = "label", gamma: float = 2.0) -> DataFrame:
    """TP/FP/FN, precision, recall, F1 and focal loss in one aggregate."""
    return _metrics(model_scores(val, model, text, keep_logit=True), label, gamma)


def _metrics(s: DataFrame, label: str, gamma: float = 2.0) -> DataFrame:
    y = F.col(label).cast("double")
    pred = (F.col("model_score") > 0.5).cast("int")
    c = s.agg(
        F.count_if((pred == 1) & (y == 1)).cast("double").alias("tp"),
        F.count_if((pred == 1) & (y == 0)).cast("double").alias("fp"),
        F.count_if((pred == 0) & (y == 1)).cast("double").alias("fn"),
        F.avg(focal_term(F.col("logit"), y, gamma)).alias("val_loss"),
        F.count(F.lit(1)).alias("n"),
    )
    pr = F.col("tp") / (F.col("tp") + F.col("fp") + F.lit(EPS))
    rc = F.col("tp") / (F.col("tp") + F.col("fn") + F.lit(EPS))
    return c.select("n", "tp", "fp", "fn", pr.alias("precision"), rc.alias("recall"),
                    (F.lit(2.0) * pr * rc / (pr + rc + F.lit(EPS))).alias("f1"), "val_loss")


DEFAULT_GRID = [{"reg_param": 0.1, "max_iter": 30}, {"reg_param": 0.01, "max_iter": 50},
                {"reg_param": 0.001, "max_iter": 100}]


def select_model(train: DataFrame, val: DataFrame, grid: Sequence[dict] = DEFAULT_GRID,
                 text: str = "comment_text", label: str = "label") -> tuple[DataFrame, list[PipelineModel]]:
    """I4: fit each candidate on the cluster, score it on the validation part,
    pick the best by validation F1 (E8).

    Texts are read once: the features are fitted and class weights counted once,
    and both parts' features are checkpointed. The loop is over a handful of
    parameter sets on the driver; in it only the regression runs, each fit and
    each metric a Spark job over the features."""
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    y = F.col(label).cast("double").alias(label)
    weighted = with_class_weights(train.withColumn(label, y), label, "weight")
    shaped = Pipeline(stages=feature_stages()).fit(_prepare(weighted, text))
    tr = shaped.transform(_prepare(weighted, text)).select("__features", label, "weight").checkpoint()
    va = shaped.transform(_prepare(val, text)).select("__features", y).checkpoint()

    def metrics(m, part: DataFrame):
        prob, raw = (vector_to_array(c)[1] for c in ("__prob", "__raw"))
        return _metrics(m.transform(part).select(label, prob.alias("model_score"), raw.alias("logit")), label).first()

    rows, models = [], []
    for i, params in enumerate(grid, start=1):
        own = dict(params)
        m = regression(label, "weight" if own.pop("weighted", True) else None, **own).fit(tr)
        t, v = metrics(m, tr), metrics(m, va)
        rows.append((i, ",".join(f"{k}={x}" for k, x in params.items()), float(t["f1"]),
                     float(v["f1"]), float(v["val_loss"])))
        models.append(PipelineModel([*shaped.stages, m]))
    cand = spark.createDataFrame(rows, "ordinal int, params string, train_f1 double, val_f1 double, val_loss double")
    return cand, models


def best(cand: DataFrame) -> DataFrame:
    return best_candidate(cand)


def save_model(model: PipelineModel, path: str) -> None:
    """A6."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
