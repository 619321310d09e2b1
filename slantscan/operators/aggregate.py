"""Global and grouped aggregates (D2-D8, D7 guard).

Each is one ``agg``: partial aggregation per task, one small final merge.
Divisions use ``try_divide`` (ANSI mode is on, and an empty class would
otherwise raise inside the job).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-10


def distribution_metrics(label: str = "label") -> list[Column]:
    """D2's aggregates, for ``agg`` beside others."""
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(label) == 0).alias("negatives"),
    ]


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """D2."""
    return df.agg(*distribution_metrics(label))


def empty_class_guard(df: DataFrame, label: str = "label") -> tuple[int, int]:
    """(negatives, positives); raises when either class is empty."""
    row = label_distribution(df, label).first()
    return require_classes(row["negatives"], row["positives"])


def require_classes(negatives: int, positives: int) -> tuple[int, int]:
    """D7 on counts that are known already."""
    if positives == 0 or negatives == 0:
        raise ValueError("No examples found for one or both classes")
    return negatives, positives


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """D3: n / (2 n_c) per class."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(label) == 0).alias("n_negative"),
        F.count_if(F.col(label) == 1).alias("n_positive"),
    )
    return weights_of(counts)


def weights_of(counts: DataFrame) -> DataFrame:
    """D3 of a row of total, n_negative and n_positive."""
    return counts.select(
        "total", "n_negative", "n_positive",
        F.try_divide(F.col("total").cast("double"), F.col("n_negative") * 2).alias("negative_weight"),
        F.try_divide(F.col("total").cast("double"), F.col("n_positive") * 2).alias("positive_weight"),
    )


def pos_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Negatives / positives."""
    return df.agg(F.try_divide(F.count_if(F.col(label) == 0).cast("double"),
                               F.count_if(F.col(label) == 1)).alias("pos_weight"))


def metrics_from_counts(tp: Column, fp: Column, fn: Column) -> list[Column]:
    precision = tp / (tp + fp + F.lit(EPS))
    recall = tp / (tp + fn + F.lit(EPS))
    return [precision.alias("precision"), recall.alias("recall"),
            (F.lit(2.0) * (precision * recall) / (precision + recall + F.lit(EPS))).alias("f1")]


def binary_metrics(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """TP, FP, FN, precision, recall and F1, each denominator + 1e-10."""
    p, y = F.col(pred), F.col(label)
    counts = df.agg(
        F.count_if((p == 1) & (y == 1)).alias("tp"),
        F.count_if((p == 1) & (y == 0)).alias("fp"),
        F.count_if((p == 0) & (y == 1)).alias("fn"),
    )
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return counts.select("tp", "fp", "fn", *metrics_from_counts(tp, fp, fn))


def bce_with_logits(x: Column, y: Column) -> Column:
    """Numerically stable binary cross-entropy on a logit."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def focal_term(x: Column, y: Column, gamma: float = 2.0) -> Column:
    bce = bce_with_logits(x, y)
    return F.pow(F.lit(1.0) - F.exp(-bce), F.lit(gamma)) * bce


def focal_loss(df: DataFrame, logit: str = "logit", label: str = "label", gamma: float = 2.0) -> DataFrame:
    """Mean of (1 - p_t)^gamma * BCE."""
    x, y = F.col(logit).cast("double"), F.col(label).cast("double")
    return df.agg(F.avg(focal_term(x, y, gamma)).alias("focal_loss"), F.count(F.lit(1)).alias("n"))


def domain_report(results: DataFrame, domain: str = "domain", *more: str) -> DataFrame:
    """Per domain (and what else is named, as the kind): texts, flagged texts, mean confidence."""
    return results.groupBy(domain, *more).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("is_biased")).alias("flagged"),
        F.avg("confidence").alias("mean_confidence"),
    )
