"""Evaluation reports over analysed texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregate import binary_metrics


def evaluate_rows(analysed: DataFrame, labels: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """Every labelled row with its true and predicted label side by side,
    whether they agree, and the analysis (confidence, explanation and the
    columns ``analysed`` holds besides). One join on ``key``."""
    true = labels.select(key, F.col(label).cast("int").alias("label"))
    pred = F.col("is_biased").cast("int")
    return analysed.join(true, key).withColumn("pred", pred).withColumn("correct", F.col("pred") == F.col("label"))


def evaluate(analysed: DataFrame, labels: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """Precision / recall / F1 of the predicted against the true label."""
    return binary_metrics(evaluate_rows(analysed.select(key, "is_biased"), labels, key, label))


def split_tag(df: DataFrame, tag: str = "tag", domain: str = "domain", kind: str = "kind") -> DataFrame:
    """A ``Domain - Kind`` tag as two columns, cut at the first `` - `` (what stands behind
    may hold more of them); without one, the whole tag is the domain and the kind is null."""
    parts = F.split(F.col(tag), " - ", 2)
    trimmed = [F.trim(F.get(parts, F.lit(i))) for i in (0, 1)]
    return df.withColumn(domain, trimmed[0]).withColumn(kind, trimmed[1])


def gold_label(number: str | Column) -> Column:
    """The published fixture's true label by the number of an example: of the first two
    pairs the second member is the biased one, from the third pair on the first."""
    n = F.col(number) if isinstance(number, str) else number
    return F.when(n < 5, n % 2 == 0).otherwise(n % 2 == 1).cast("int")


def pair_margin(results: DataFrame, pair: str = "pair", biased_flag: str = "is_biased_member",
                confidence: str = "confidence") -> DataFrame:
    """Per pair, confidence of the biased member minus that of the control.

    One grouped aggregate (partial before the shuffle); a pair with one
    member only keeps that member's signed confidence.
    """
    signed = F.when(F.col(biased_flag), F.col(confidence)).otherwise(-F.col(confidence))
    return results.groupBy(pair).agg(F.sum(signed).alias("margin"), F.count(F.lit(1)).alias("members"))
