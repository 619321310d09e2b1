"""Inputs derived from the driver tables (FIXTURES.md §3-4).

Every derived table is a projection (or a generate) of a driver table, so its
size grows with the data. The same formulas are written as SQL for the DuckDB
oracle in ``plans/oracle.py``; keep both in step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Our own test sentences, each built to reach one branch of the rule sets.
# FIXED VALUES: the golden scores in the tests depend on these exact texts.
PLANTED_SENTENCES = [
    "The library opens at nine and closes at five on weekdays.",
    "The census lists asian and latino households by county.",
    "Urban rents rose again and property values followed.",
    "Those people never answer when called.",
    "These people and every immigrant rely on welfare in the inner city.",
    "Demographics differ, and taking our jobs is our way of life now.",
    "Records of discrimination from the world war period resulted in persecution that was documented.",
    "Historical discrimination was documented, measured and verified as a dark chapter.",
    "Social trust is declining in small towns.",
    "Our community meets on Monday.",
    "Our neighborhoods see an erosion of community standards.",
    "Research shows systemic barriers and the context of limited access, while empirical programs and resources help minority communities.",
    "Research shows systemic barriers and the context of limited access, while empirical programs help, but some blame racial groups.",
    "Skilled workers contribute while the lazy drain the system.",
    "Illegal parking is fined here.",
    "Research shows lower crime rates in diverse areas, a comprehensive and measured finding about demographic changes and conditions for immigrant families.",
    "Research shows beneficial effects and also worse outcomes for minority pupils in that context.",
    "Communities that are underserved face disparities in healthcare and employment by race.",
    "Underserved communities asked a racial question.",
    "They claim genetic limits and cultural deficiencies in their kind.",
    "An empirical, verified and comprehensive claim that people believe is always clearly right about race, as underserved communities face economic disparities.",
    "Experts call the property values and prices in each neighborhood character changing.",
    "What percentage of truly hated rebel units, black, white or cuban, fought in the civil war is economic in nature.",
    "Studies show group differences and western values in cultural norms with hereditary factors of genetic traits.",
    "Research proves they are inferior and studies show deficient, lazy habits that they always blame; they lack values and are refusing to work.",
    "When research shows improved outcomes, evidence indicates positive results for black residents, higher than before.",
    "The inner\n    city bus runs late.",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sentence(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in PLANTED_SENTENCES]), (index + 1).cast("int"))


def planted_text(doc_id: Column, text: Column) -> Column:
    """FIXTURES §4: the document text with 0, 1 or 2 test sentences appended."""
    n = len(PLANTED_SENTENCES)
    s1 = _sentence((doc_id * 7) % n)
    s2 = _sentence((doc_id * 11 + 5) % n)
    return (
        F.when(doc_id % 4 == 0, text)
        .when(doc_id % 4 == 1, F.concat(text, F.lit(" "), s1))
        .otherwise(F.concat(text, F.lit(" "), s1, F.lit(" "), s2))
    )


def model_score(doc_id: Column) -> Column:
    """Stand-in classifier probability per document (FIXTURES §3)."""
    return ((doc_id * 37) % 101) / F.lit(100.0)


def logit(doc_id: Column) -> Column:
    return ((doc_id % 41) - 20) / F.lit(4.0)


def planted(spark: SparkSession, sf_dir: str, with_model: bool = True) -> DataFrame:
    """(id, comment_text[, model_score]) over every document."""
    d = read_table(spark, sf_dir, "documents")
    cols = [F.col("doc_id").alias("id"), planted_text(F.col("doc_id"), F.col("text")).alias("comment_text")]
    if with_model:
        cols.append(model_score(F.col("doc_id")).alias("model_score"))
    return d.select(*cols)


def _nullif(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None).cast("double")).otherwise(value)


def _only(cond: Column, value: Column) -> Column:
    return F.when(cond, value).otherwise(F.lit(None).cast("double"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comment table (FIXTURES §2 schema) derived from ``documents``."""
    d = F.col("doc_id")
    return read_table(spark, sf_dir, "documents").select(
        d.alias("id"),
        (d % 4).cast("int").alias("source_rank"),
        F.col("text").alias("comment_text"),
        _nullif(d % 13 == 0, (d % 11) / F.lit(10.0)).alias("target"),
        _nullif(d % 9 == 0, (d * 3 % 10) / F.lit(10.0)).alias("identity_attack"),
        ((d * 7 % 10) / F.lit(20.0)).alias("severe_toxicity"),
        _nullif(d % 8 == 0, (d * 13 % 9) / F.lit(10.0)).alias("insult"),
        ((d % 5) / F.lit(10.0)).alias("threat"),
        _only(d % 5 == 0, (d % 7) / F.lit(10.0)).alias("black"),
        _only(d % 6 == 1, (d % 5) / F.lit(10.0)).alias("white"),
        _only(d % 7 == 2, (d % 6) / F.lit(10.0)).alias("asian"),
        _only(d % 11 == 3, (d % 9) / F.lit(10.0)).alias("latino"),
        _only(d % 13 == 4, (d % 4) / F.lit(10.0)).alias("other_race_or_ethnicity"),
    )


ANNOTATION_MULTIPLIERS = {
    "toxic": 7, "severe_toxic": 3, "obscene": 11, "threat": 13, "insult": 17, "identity_hate": 19,
}


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three annotator rows per document (FIXTURES §3), generated per row."""
    d = F.col("doc_id")
    a = F.col("annotator")
    base = read_table(spark, sf_dir, "documents").select(
        d, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("annotator"))
    cols = [d.alias("comment_id")]
    for name, mult in ANNOTATION_MULTIPLIERS.items():
        cols.append(_nullif((d + a) % 6 == 0, ((d * mult + a * 5) % 10) / F.lit(10.0)).alias(name))
    return base.select(*cols)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, model_score) for every document."""
    return read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), model_score(F.col("doc_id")).alias("model_score"))


def labelled_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, logit, label) for every labelled document: label = ``labels.toxic``."""
    lab = read_table(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").alias("id"), logit(F.col("doc_id")).alias("logit"),
                      F.col("toxic").cast("int").alias("label"))
