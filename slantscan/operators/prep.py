"""Preparation of the training table.

All of it is one lazy plan: projections and filters stay in whole-stage
codegen and reach the scan; the two aggregations (annotator means, dedup)
aggregate partially before the shuffle, so a hot key (one text or one
comment id holding a third of all rows) is reduced in every map task first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text

RACE_COLUMNS = ["black", "white", "asian", "latino", "other_race_or_ethnicity"]
V1_METRICS = ["identity_attack", "severe_toxicity", "insult"]
V2_METRICS = ["identity_attack", "severe_toxicity", "insult", "threat"]
V1_LABEL_THRESHOLD = 0.3
V2_LABEL_THRESHOLD = 0.2
REQUIRED_COLUMNS = ["identity_attack"] + RACE_COLUMNS
SCORE_COLUMNS = ["toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"]

KEY_COLUMNS = ["id", "comment_id", "source_rank"]

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def drop_empty(df: DataFrame, text: str = "comment_text") -> DataFrame:
    """B2 + B3: clean the text, keep rows with something left."""
    return df.withColumn(text, clean_text(text)).filter(F.length(text) > 0)


def eligible(df: DataFrame, label_value: int, label: str = "label", text: str = "comment_text",
             min_len: int = 50) -> DataFrame:
    """Rows of one class whose text is longer than ``min_len``."""
    return df.filter((F.col(label) == label_value) & (F.length(text) > min_len))


def fill_missing(df: DataFrame, value: float = 0.0) -> DataFrame:
    """Every missing number becomes ``value``, but keys stay null. Text stays null (dropped later by B3)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC) and f.name not in KEY_COLUMNS]
    return df.na.fill(value, subset=cols) if cols else df


def require_columns(df: DataFrame, names: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Stop with the list of missing columns."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def label_expr(metrics: Sequence[str], identities: Sequence[str], threshold: float) -> Column:
    """1 when the row maximum of both groups is above the threshold."""
    def row_max(cols):
        return F.greatest(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])
    cond = (row_max(metrics) > threshold) & (row_max(identities) > threshold)
    return F.coalesce(cond, F.lit(False)).cast("int")


def derive_label(df: DataFrame, version: str = "v2", out: str = "race_bias") -> DataFrame:
    if version == "v1":
        return df.withColumn(out, label_expr(V1_METRICS, RACE_COLUMNS, V1_LABEL_THRESHOLD))
    return df.withColumn(out, label_expr(V2_METRICS, RACE_COLUMNS, V2_LABEL_THRESHOLD))


def training_projection(df: DataFrame, keep_id: bool = True) -> DataFrame:
    """Text and label only (plus the row key)."""
    cols = (["id"] if keep_id and "id" in df.columns else []) + [F.col("comment_text"), F.col("race_bias").alias("label")]
    return df.select(*cols)


def target_split(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts above / at-or-below the threshold; missing targets are in neither."""
    return df.agg(*target_metrics(threshold))


def target_metrics(threshold: float = 0.5) -> list[Column]:
    """B9's aggregates, for ``agg`` beside others."""
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("target") > threshold).alias("toxic_n"),
        F.count_if(F.col("target") <= threshold).alias("non_toxic_n"),
    ]


def predict(df: DataFrame, value: str = "logit", threshold: float = 0.5, is_logit: bool = True) -> DataFrame:
    """Adds ``prob`` (the sigmoid of a logit, or the given probability) and
    ``pred``, 1 if it is above ``threshold`` (a missing value predicts 0)."""
    v = F.col(value).cast("double")
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-v)) if is_logit else v
    return df.withColumn("prob", prob).withColumn("pred", F.coalesce(F.col("prob") > threshold, F.lit(False)).cast("int"))


def union_sources(dfs: Sequence[DataFrame], rank_col: str = "source_rank") -> DataFrame:
    """stack by column name, missing columns null, tagged with the source's rank."""
    out = None
    for rank, df in enumerate(dfs):
        tagged = df if rank_col in df.columns else df.withColumn(rank_col, F.lit(rank))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def dedup_keep_first(df: DataFrame, key: str = "comment_text",
                     order: Sequence[str] = ("source_rank", "id")) -> DataFrame:
    """One row per distinct key, the first in source order; null keys form one group.

    No text is sorted or moved to find the first: the order columns and a
    128-bit fingerprint of the key alone are aggregated (partially before the
    shuffle, so a key repeated a billion times costs one row per map task), and
    only fingerprints that occur more than once come back as a join side: rows
    that are not the first of such a one are dropped. Where duplicates are few,
    that side is broadcast by its measured size and the text never shuffles.
    Rows that are equal in key and order columns are one row.
    """
    cols = df.columns
    k = F.struct(F.col(key).isNull().alias("n"), F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))
    narrow = df.select(k.alias("__k"), *order)
    first = F.struct(*[F.struct(F.col(c).isNotNull().alias("is"), F.col(c).alias("v")) for c in order])
    many = (narrow.groupBy("__k").agg(F.min(first).alias("__first"), F.count(F.lit(1)).alias("__n"))
            .filter(F.col("__n") > 1).select(F.col("__k").alias("__dup"), "__first"))
    out = df.select("*", k.alias("__k"), first.alias("__o")).join(many, F.col("__k") == F.col("__dup"), "left")
    once = out.filter(F.col("__dup").isNull()).select(*cols)
    again = out.filter(F.col("__dup").isNotNull() & (F.col("__o") == F.col("__first")))
    return once.unionByName(again.dropDuplicates(["__k"]).select(*cols))


def annotator_means(df: DataFrame, key: str = "comment_id",
                    scores: Sequence[str] = SCORE_COLUMNS) -> DataFrame:
    """Mean of every score per comment; missing values ignored."""
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in scores])


def attach_scores(df: DataFrame, scores: DataFrame, key: str = "id",
                  score: str = "model_score") -> DataFrame:
    """The classifier's score per comment, 0 when absent. Of several scores
    for one key the highest counts, so no comment is multiplied."""
    s = scores.groupBy(key).agg(F.max(score).alias("__s"))
    return df.join(s, key, "left").withColumn(score, F.coalesce(F.col("__s"), F.lit(0.0))).drop("__s")


def attach_annotations(df: DataFrame, means: DataFrame, key: str = "id",
                       means_key: str = "comment_id") -> DataFrame:
    """Annotator means beside each comment (null when never annotated)."""
    m = means.withColumnRenamed(means_key, key)
    clash = [c for c in m.columns if c != key and c in df.columns]
    m = m.select(key, *[F.col(c).alias(f"ann_{c}" if c in clash else c) for c in m.columns if c != key])
    return df.join(m, key, "left")


def prepare_training_set(comments: DataFrame, version: str = "v2") -> DataFrame:
    """M5 chain: fill -> require -> label -> projection (dedup is up to the caller)."""
    return training_projection(derive_label(require_columns(fill_missing(comments)), version))
