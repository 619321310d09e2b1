"""The training-set preparation job as one Spark plan.

sources -> annotator means -> union -> dedup -> (written, counted once) ->
guard -> fill -> label -> projection -> balanced sample -> shuffle -> sink. The
prepared table is written into the cluster's shared folder before the sample
reads it again: the lineage is cut, and executors lost later do not recompute
the preparation. All counts of targets and labels are one aggregate over the written
table's few columns. (An ``Observation`` on the write would need no such job, but in
Spark 4.1 a session that has observed once can't fit Spark ML models any more: its
tasks can't be serialised.)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as AG
from ..operators import prep as P
from ..operators import sample as S
from ..session import written


@dataclass
class PreparedSet:
    training: DataFrame          # balanced, shuffled (id, comment_text, label, shuffle_rank)
    class_weights: DataFrame     # D3 over the full labelled table
    distribution: DataFrame      # D2 over the full labelled table
    target_split: DataFrame      # B9 over the merged table


def prepare(spark: SparkSession, merged: DataFrame, version: str = "v2", cap: int | None = None,
            seed: int = S.SEED, debug_rows: int | None = None, dedup: bool | None = None) -> PreparedSet:
    """``dedup`` defaults to the version's behaviour: V2 de-duplicates the
    stacked sources by text, V1 (one source) does not."""
    dedup = (version == "v2") if dedup is None else dedup
    df = P.dedup_keep_first(merged) if dedup else merged
    df, seen = _written_and_counted(df, version)
    if debug_rows:
        df, seen = _written_and_counted(S.debug_sample(df, debug_rows, seed), version)
    AG.require_classes(seen["negatives"], seen["positives"])
    labelled = _labelled(df, version)
    cap = cap if cap is not None else (S.V1_CAP if version == "v1" else S.V2_CAP)
    sample = S.shuffle(S.balanced_sample(labelled, cap=cap, seed=seed), seed)

    def row(**names):
        return spark.range(1).select(*[F.lit(seen[n]).cast("long").alias(c) for c, n in names.items()])
    weights = AG.weights_of(row(total="total", n_negative="negatives", n_positive="positives"))
    distribution = row(total="total", positives="positives", negatives="negatives")
    return PreparedSet(sample, weights, distribution, row(total="total", toxic_n="toxic_n", non_toxic_n="non_toxic_n"))


def _labelled(df: DataFrame, version: str) -> DataFrame:
    return P.training_projection(P.derive_label(P.require_columns(P.fill_missing(df)), version))


def _written_and_counted(df: DataFrame, version: str) -> tuple[DataFrame, dict]:
    """The table, written, and D2's and B9's counts of it."""
    P.require_columns(df)
    metrics, threshold = (P.V1_METRICS, P.V1_LABEL_THRESHOLD) if version == "v1" else (P.V2_METRICS, P.V2_LABEL_THRESHOLD)
    filled = {c: f"__filled_{c}" for c in [*metrics, *P.RACE_COLUMNS]}
    table = written(df, "prepared")
    d = table.select("*", *[F.coalesce(F.col(c), F.lit(0.0)).alias(f) for c, f in filled.items()])
    label = P.label_expr([filled[c] for c in metrics], [filled[c] for c in P.RACE_COLUMNS], threshold)
    targets = P.target_metrics()[1:] if "target" in df.columns else [F.lit(0).alias(n) for n in ("toxic_n", "non_toxic_n")]
    seen = d.select("*", label.alias("__label")).agg(*AG.distribution_metrics("__label"), *targets).first()
    return table, seen.asDict()


def train_model(spark: SparkSession, dataset_path: str, model_path: str, fmt: str = "parquet",
                grid=None, seed: int = S.SEED) -> DataFrame:
    """§3.3: training set file -> stratified 80/20 split -> candidates fitted
    on the cluster -> the best by validation F1 saved to ``model_path``
    (nothing is saved when every validation F1 is 0, as a best F1 must be
    strictly above 0). Returns the candidate metrics with a ``selected`` flag."""
    from ..operators import model as M
    from ..sources.csv import read_training_set

    data = P.drop_empty(read_training_set(spark, dataset_path, fmt))
    if "id" not in data.columns:  # a row key for the seeded split
        data = data.withColumn("id", F.xxhash64("comment_text", "label"))
    data = S.stratified_split(data, 0.2, seed=seed).checkpoint(eager=True)
    train, val = data.filter(F.col("split") == "train"), data.filter(F.col("split") == "val")
    cand, models = M.select_model(train, val, grid or M.DEFAULT_GRID)
    best = M.best(cand).collect()
    if best:
        M.save_model(models[best[0]["ordinal"] - 1], model_path)
    chosen = {r["ordinal"] for r in best}
    return cand.withColumn("selected", F.col("ordinal").isin(list(chosen)) if chosen else F.lit(False))


def train_bias_model(spark: SparkSession, sources, dataset_path: str, model_path: str,
                     version: str = "v2", fmt: str = "parquet") -> DataFrame | None:
    """§3.2 + §3.3: load the sources (the first required), prepare the
    balanced training set, write it, train. Returns the candidate metrics, or
    None when the required source cannot be read."""
    from ..sources.csv import load_sources, write_training_set

    merged = load_sources(spark, sources)
    if merged is None:
        return None
    if "id" not in merged.columns:
        merged = merged.withColumn("id", F.xxhash64("source_rank", "comment_text"))  # whatever the file splits
    prepared = prepare(spark, merged, version=version)
    write_training_set(prepared.training.select("comment_text", "label"), dataset_path, fmt)
    return train_model(spark, dataset_path, model_path, fmt)
