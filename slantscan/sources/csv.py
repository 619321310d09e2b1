"""CSV and Parquet sources and sinks (A1-A5).

CSV columns are found by header name, in any order; the known ones get their
types by a checked cast, columns that the file lacks are not invented (so
``require_columns`` can name them), others are ignored. Quoted texts may span
lines and hold doubled quotes, as the published data sets do; files are read in
byte ranges all the same, cut at the real ends of records (``records.py``), which
takes one or two passes over them before the reading. With ``multi_line=False``,
for files whose texts hold no line breaks, there are no such passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prep import SCORE_COLUMNS, require_columns, union_sources
from .records import records

D = T.DoubleType()

COMMENT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("comment_text", T.StringType()),
    T.StructField("target", D),
    T.StructField("identity_attack", D),
    T.StructField("severe_toxicity", D),
    T.StructField("insult", D),
    T.StructField("threat", D),
    T.StructField("black", D),
    T.StructField("white", D),
    T.StructField("asian", D),
    T.StructField("latino", D),
    T.StructField("other_race_or_ethnicity", D),
])

ANNOTATION_SCHEMA = T.StructType([
    T.StructField("comment_id", T.LongType()),
    *[T.StructField(c, D) for c in SCORE_COLUMNS],
])

TRAINING_SCHEMA = T.StructType([
    T.StructField("comment_text", T.StringType()),
    T.StructField("label", T.IntegerType()),
])

_CORRUPT = "__line"
_BOM = "\ufeff"


def _raw(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """All columns as text, under their header names; a row with too few or too many cells has ``__line``."""
    how = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    reader = spark.read.options(**how, header=True, multiLine=multi_line, encoding="UTF-8")
    names = reader.csv(path).columns  # reads the header
    if not multi_line:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _CORRUPT]])
        # every file has this header; without pruning, so that a row is checked whichever columns are asked for
        return reader.schema(schema).option("enforceSchema", False).option("columnPruning", False).csv(path)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, _CORRUPT])
    rows = records(spark, path).select("first", F.inline(F.array(F.from_csv("value", schema, how))))
    other = F.col(_CORRUPT).isNotNull()
    for i, n in enumerate(names):  # a repeated name has its number behind it, an empty one is made up
        cell = F.ltrim(F.col(f"`{n}`"), F.lit(_BOM))
        other = other | ~F.coalesce(cell.isin(n.lstrip(_BOM), n.lstrip(_BOM).removesuffix(str(i))), F.lit(True))
    stop = F.raise_error(F.lit(f"{path}: the files' headers differ")).cast("boolean")
    body = F.when(F.col("first"), F.when(other, stop).otherwise(False)).otherwise(True)
    return rows.filter(body).select(*[f"`{n}`" for n in [*names, _CORRUPT]])


def _read(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str], multi_line: bool,
          bad: str) -> DataFrame:
    if bad not in ("raise", "reject", "only"):
        raise ValueError("bad must be 'raise', 'reject' or 'only'")
    raw = _raw(spark, path, multi_line)
    raw = raw.select(*[F.col(f"`{c}`").alias(c.strip().lstrip(_BOM)) for c in raw.columns])
    require_columns(raw, required)
    known = [f for f in schema.fields if f.name in raw.columns]
    wrong = F.col(_CORRUPT).isNotNull()
    for f in known:
        if f.dataType != T.StringType():
            cell = F.trim(f.name)
            wrong = wrong | ((cell != "") & _cast(f).isNull())
    wrong = F.coalesce(wrong, F.lit(False))
    cells = [_cast(f).alias(f.name) for f in known]
    if bad == "only":
        return raw.filter(wrong).select(*raw.columns)
    if bad == "reject":
        return raw.filter(~wrong).select(*cells)
    # a predicate on the row: whatever is asked of the table, a count too, no projection can prune it
    row = F.to_json(F.struct(*[F.col(f.name) for f in known], F.col(_CORRUPT)))
    stop = F.raise_error(F.concat(F.lit(f"{path}: a row doesn't fit its columns: "), F.substring(row, 1, 500)))
    return raw.filter(F.when(wrong, stop.cast("boolean")).otherwise(True)).select(*cells)


def _cast(f: T.StructField) -> Column:
    return F.col(f.name) if f.dataType == T.StringType() else F.trim(f.name).try_cast(f.dataType)


def read_comments(spark: SparkSession, path: str, schema: T.StructType = COMMENT_SCHEMA,
                  required: Sequence[str] = ("comment_text",), multi_line: bool = True, bad: str = "raise") -> DataFrame:
    """A1: the known columns that the file has, by header name.

    A row with too few or too many cells, or a cell that isn't a number where
    one belongs, stops the job (``bad='raise'``), is left out (``'reject'``) or
    is all that is returned, as text (``'only'``, to count or look at them).
    An empty cell is null.
    """
    return _read(spark, path, schema, required, multi_line, bad)


def read_annotations(spark: SparkSession, path: str, multi_line: bool = True, bad: str = "raise") -> DataFrame:
    """A2: one row per annotator; ``comment_id`` is required."""
    return _read(spark, path, ANNOTATION_SCHEMA, ["comment_id"], multi_line, bad)


def load_sources(spark: SparkSession, sources: Sequence[tuple[str, str]],
                 readers: dict | None = None) -> DataFrame | None:
    """A3: read ``(path, kind)`` sources in order and stack them (F1).

    The first source is required: if it cannot be read, None is returned.
    Later sources are optional: one that is missing or lacks its required
    columns is reported and skipped. ``kind`` is 'comments' or 'annotations'
    (the latter are averaged per comment first, D1).
    """
    from ..operators.prep import annotator_means

    readers = readers or {"comments": read_comments, "annotations": read_annotations}
    frames = []
    for rank, (path, kind) in enumerate(sources):
        try:
            df = readers[kind](spark, path)
            df.schema  # noqa: B018  (resolves the path now, not at the first action)
        except (AnalysisException, ValueError) as e:
            why = e.getCondition() if isinstance(e, AnalysisException) else e
            if rank == 0:
                print(f"Error loading required source {path}: {why}")
                return None
            print(f"Skipping optional source {path}: {why}")
            continue
        if kind == "annotations":
            df = annotator_means(df, scores=[c for c in SCORE_COLUMNS if c in df.columns])
        frames.append(df)
    return union_sources(frames)


def write_training_set(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A4: header CSV (as published) or Parquet (default)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        w.parquet(path)


def read_training_set(spark: SparkSession, path: str, fmt: str = "parquet", bad: str = "raise") -> DataFrame:
    """A5. An empty text comes back as null from CSV; clean it (B2) afterwards."""
    if fmt == "csv":
        return _read(spark, path, TRAINING_SCHEMA, ["comment_text", "label"], True, bad)
    return spark.read.parquet(path)
