"""CSV records of files with quoted line breaks, read in byte ranges.

A range of a file can't tell whether its first line begins a record or lies
inside a quoted cell. Spark splits the files into ranges at line ends; a first
pass follows every range's quotes from both states, outside and inside a cell,
and leaves one small row: the state at its end for either. Composing these along
a file (a scan over one row a range) fixes each range's true state and, for one
that starts inside a cell, the range in which that cell's record began. A second
pass cuts the ranges at the real ends of records. A record that crosses a range's
end is a piece in each range that it touches; a pass over the files puts the
pieces together and writes them, so that reading goes over the files once more
only. A record may be of any length and touch any number of ranges.

A quote opens a cell only where the cell begins; a doubled quote inside is a
quote; what follows a closing quote belongs to the cell, up to the next comma.
Records end with LF or CR LF outside cells.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

CLOSING = re.compile(rb'[^"]*+(?:""[^"]*+)*+"')  # from inside a cell to behind the quote that closes it
BATCH_BYTES, BATCH_ROWS = 1 << 22, 4096

RANGE = "file long, start long, outside boolean, inside boolean, ends boolean"
PIECE = "file long, owner long, start long, value binary, first boolean"


def leaves_inside(line: bytes, inside: bool) -> bool:
    """Whether a cell is open at the end of a line that begins outside or inside a cell."""
    at = 0
    while True:
        if not inside:  # at the beginning of a cell
            if not line.startswith(b'"', at):
                at = line.find(b',"', at) + 1
                if not at:
                    return False
            at += 1
        m = CLOSING.match(line, at)
        if not m:
            return True
        at = line.find(b",", m.end()) + 1
        if not at:
            return False
        inside = False


def _lines(batches):
    """(file, start, line) of each line, in order."""
    for b in batches:
        yield from zip(b.column("file").to_pylist(), b.column("start").to_pylist(), b.column("value").to_pylist())


def _ranges(batches):
    """A row of RANGE for each range: is a cell open at its end, if it starts outside / inside
    of one, and does a record end in it if it starts inside."""
    rows, key = [], None
    outside = inside = ends = False
    for file, start, line in _lines(batches):
        if (file, start) != key:
            if key:
                rows.append((*key, outside, inside, ends))
            key, outside, inside, ends = (file, start), False, True, False
        if b'"' in line:
            same = outside == inside
            outside = leaves_inside(line, outside)
            inside = outside if same else leaves_inside(line, inside)
        ends = ends or not inside
    if key:
        rows.append((*key, outside, inside, ends))
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
    names = ["file", "start", "outside", "inside", "ends"]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def true_starts(ranges: DataFrame) -> DataFrame:
    """The ranges that start or end inside a cell: file, start, is_inside (at its start), owner
    (start of the range in which that cell's record begins).

    A range maps the state at its start to that at its end. Either both states end
    alike, which settles it, or they are kept or swapped: the state at a range's
    start is the last settled one, swapped as often as since then.
    """
    by_place = Window.partitionBy("file").orderBy("start")
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    settles = F.col("outside") == F.col("inside")
    r = ranges.withColumn("swaps", F.sum(F.when(F.col("outside") & ~F.col("inside"), 1).otherwise(0)).over(by_place))
    r = r.withColumn("before", F.coalesce(F.lag("swaps").over(by_place), F.lit(0)))
    settled = F.last(F.when(settles, F.struct(F.col("outside").alias("state"), "swaps")), ignorenulls=True).over(before)
    r = r.withColumn("settled", F.coalesce(settled, F.struct(F.lit(False).alias("state"), F.lit(0).cast("long").alias("swaps"))))
    odd = (F.col("before") - F.col("settled.swaps")) % 2 == 1
    r = r.withColumn("is_inside", F.col("settled.state") != odd)
    left_open = F.when(F.col("is_inside"), F.col("inside")).otherwise(F.col("outside"))
    begins = left_open & (~F.col("is_inside") | F.col("ends"))
    r = r.withColumn("owner", F.last(F.when(begins, F.col("start")), ignorenulls=True).over(before))
    return r.where(F.col("is_inside") | left_open).select("file", "start", "is_inside", "owner")


def _cut(inside: dict[int, dict[int, int]], pieces: bool):
    """Rows of PIECE: whole records (owner null), or only the pieces of records that cross a range's end."""

    def batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "owner", "start", "value", "first"])

    def run(batches):
        rows, size, key, owner = [], 0, None, None
        open_, begun, header = [], True, False  # lines of the record at hand; does it begin in this range; is it its file's first

        def flush():  # the range ends inside a record
            if open_ and pieces:
                rows.append((key[0], key[1] if begun else owner, key[1], b"\n".join(open_), header and begun))

        for file, start, line in _lines(batches):
            if (file, start) != key:
                flush()
                key, owner = (file, start), inside.get(file, {}).get(start)
                open_, begun, header = [], owner is None, start == 0
                is_open = owner is not None
            open_.append(line)
            if b'"' in line:
                is_open = leaves_inside(line, is_open)
            if is_open:
                continue
            if begun and not pieces or not begun and pieces:
                value = open_[0] if len(open_) == 1 else b"\n".join(open_)
                if begun:
                    value = value.removesuffix(b"\r")
                if value or not begun:
                    rows.append((file, None if begun else owner, start, value, header and begun))
                    size += len(value)
            header = header and begun and open_ in ([b""], [b"\r"])  # empty lines before the header don't count
            open_, begun = [], True
            if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield batch(rows)
                rows, size = [], 0
        flush()
        yield batch(rows)

    return run


def records(spark: SparkSession, path: str) -> DataFrame:
    """value (a record's text), first (is it the first of its file). Empty lines outside of cells are no records.

    One pass over the files is run now, as a job, and a second one if records cross
    ranges. They leave a row for each range that starts inside a cell, on the driver,
    and the pieces of the records that cross a range's end, as a table in the
    session's ``spark.checkpoint.dir``.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    crossed = true_starts(lines.mapInArrow(_ranges, RANGE)).collect()
    inside: dict[int, dict[int, int]] = {}
    for r in crossed:
        if r["is_inside"]:
            inside.setdefault(r["file"], {})[r["start"]] = r["owner"]
    whole = lines.mapInArrow(_cut(inside, False), PIECE).select("value", "first")
    if crossed:
        p = written(lines.mapInArrow(_cut(inside, True), PIECE), "csv").groupBy("file", "owner")
        p = p.agg(F.sort_array(F.collect_list(F.struct("start", F.col("value").cast("string").alias("value")))).alias("p"), F.max("first").alias("first"))
        p = p.select(F.array_join(F.col("p.value"), "\n").alias("v"), "first")
        joined = F.expr("CASE WHEN endswith(v, '\\r') THEN left(v, length(v) - 1) ELSE v END")
        whole = whole.unionByName(p.select(joined.cast("binary").alias("value"), "first"))
    return whole.select(F.col("value").cast("string").alias("value"), "first")
