"""The corpus pipeline: language, quality, near-duplicates, mix, packed sequences.

Each stage takes the documents that the one before it kept, as they were written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slantscan.llm import langid, minhash, mixing, packing, quality
from slantscan.llm.common import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    return langid.keep_known(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.
    Rows that repeat the id and text of the one that stays go; rows with a null
    id take no part and stay."""
    scratch = Scratch(spark)
    found = scratch.save(minhash.near_duplicates(docs), "found")
    gone = scratch.save(found.where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    stay = _beside(docs, gone, "gone_id", "left_anti")
    many = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    many = scratch.save(many.select(F.col("doc_id").alias("many_id")), "many")
    if many.limit(1).count() == 0:  # ids are unique, as they should be
        return stay
    once = _beside(stay, many, "many_id", "left_anti")
    again = _beside(stay, many, "many_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(again)


def _beside(docs: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """``docs`` with or without the rows of ``ids``, whatever the columns of ``docs`` are called."""
    return docs.alias("__docs").join(ids.alias("__ids"), F.col("__docs.doc_id") == F.col(f"__ids.{column}"), how)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [("language", language), ("quality", good), ("near_duplicates", distinct), ("mix", mix), ("pack", pack)]

ORACLE_SQL = None  # trained models and tokenizer ids are beyond SQL; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
