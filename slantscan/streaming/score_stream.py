"""Scoring a stream of comments or AI output.

Every scoring and report column is a stateless projection, so the streaming
plan is the batch plan over ``readStream``: no state store, no watermark.
The sink is Parquet; the checkpoint belongs to the sink and lies in it unless
the caller names another, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.analyze import analyze


def score_stream(stream: DataFrame, text: str = "comment_text", model_score: str | None = "model_score",
                 version: str = "v2") -> DataFrame:
    """H9 on a streaming DataFrame (same columns as the batch ``analyze``)."""
    return analyze(stream, text=text, model_score=model_score, version=version)


def stream_path(table: DataFrame, path: str) -> str:
    """What to stream of the Parquet table that was read as ``table`` from ``path``. A file stream reads
    folders or a pattern: a table in one file is a pattern that only this file matches, as its folder
    may hold other tables, whose files would be listed and their partitions mixed."""
    folder, _, name = path.rstrip("/").rpartition("/")
    files = table.inputFiles()
    one = files[0].split("/") if len(files) == 1 else []
    return f"{folder or '.'}/[{name[0]}]{name[1:]}" if one[-1:] == [name] and one[-2] != name else path


def start_parquet_stream(spark: SparkSession, source: str, schema: T.StructType, sink: str,
                         prepare=None, text: str = "comment_text", version: str = "v2",
                         checkpoint: str | None = None, available_now: bool = True,
                         max_files_per_trigger: int | None = None,
                         glob: str | None = None) -> StreamingQuery:
    """Read Parquet files as they arrive in folder ``source`` (optionally only
    names matching ``glob``), analyse, append to ``sink``.

    ``checkpoint`` (default: ``_checkpoint`` in the sink, which readers of the
    sink pass over) must stay the same for a sink: it says which files have
    been scored, and the sink's own log relies on it."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source)
    if prepare is not None:
        stream = prepare(stream)
    out = score_stream(stream, text=text, version=version)
    ckpt = checkpoint or f"{sink.rstrip('/')}/_checkpoint"
    writer = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.outputMode("append").start()
