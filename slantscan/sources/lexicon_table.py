"""Lexicons as a table: (version, name, kind, category, ordinal, term, weight).

``functions.rule_model`` says how rows of each kind are read. Users can pass
their own table of this shape to the scorers (``lexicon=``) and to the lexicon
operators; the latter look at version, name, ordinal and term only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.rule_model import KINDS, default_rows

SCHEMA = T.StructType([
    T.StructField("version", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("category", T.StringType(), True),
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("term", T.StringType(), False),
    T.StructField("weight", T.DoubleType(), True),
])


def rows(versions=("v2", "v1"), kinds=KINDS) -> list[tuple]:
    """The published lists of the given kinds."""
    return default_rows(versions, kinds)


def rule_df(spark: SparkSession, versions=("v2", "v1")) -> DataFrame:
    """All that the rule sets read: take it, change rows, and score with it."""
    return spark.createDataFrame(rows(versions), SCHEMA)


def lexicon_df(spark: SparkSession, versions=("v2", "v1"), kinds=("term",)) -> DataFrame:
    """The lists of which a text's matches are reported."""
    return spark.createDataFrame(rows(versions, kinds), SCHEMA)
