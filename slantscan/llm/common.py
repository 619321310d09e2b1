"""What several operators share: written intermediate tables, connected
components over an edge table, and small NumPy helpers used inside tasks."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a one-machine session (``local[...]``) gets a scratch
    folder; any other session is refused, because executors would not see a
    machine-local folder.
    """
    d = spark.conf.get(CHECKPOINT_KEY, None)
    if d:
        return d.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="slantscan-llm-")
    spark.conf.set(CHECKPOINT_KEY, d)
    return d


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python workers in batches of at most ``rows`` rows.

    Spark's usual 10,000 rows are tens of MB of text on either side of the pipe,
    for each task. The setting is read when a plan is made, so it stays set.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """``text_batches`` for the plans that are run inside; the session's own setting comes back after them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    text_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(key, old)


class Scratch:
    """Written intermediate tables of one operator call in the shared folder.

    Each cuts the lineage (a lost executor re-reads files instead of repeating
    the work) and gives the optimizer true sizes, so a join broadcasts a side
    only if its files are below ``spark.sql.autoBroadcastJoinThreshold``.
    Tables are removed by ``drop`` or when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/slantscan-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, texts: bool = False) -> DataFrame:
        """``df`` as written; with ``texts`` packed tightly, as whole texts are most of it."""
        w = df.write.mode("overwrite")
        (w.option("compression", "zstd") if texts else w).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for n in names:
            self._delete(self.path(n))

    def _delete(self, path: str) -> None:
        with contextlib.suppress(Exception):  # a session that has ended, or no JVM (Spark Connect): files stay
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (node, component),
    component being the smallest node reachable. Nodes without edges are absent.

    Alternating large-star and small-star steps: each links the neighbours of a
    node to the smallest of them, by one grouped minimum and one join, so hubs
    are pre-aggregated before the shuffle and a hub's rows are split by
    adaptive skew handling. The edge table never grows; rounds are logarithmic
    in a component's size (two for the star-shaped edges that the operators
    emit). Nothing but one emptiness flag a round reaches the driver.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = scratch.save(pairs.distinct(), f"{tag}-0")
    old, k = f"{tag}-0", 0
    while not _is_star_forest(e):
        k += 1
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m")), f"{tag}-m{k}")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"{tag}-l{k}")
        low2 = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}-n{k}")
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.save(small.union(low2.select("u", F.col("m").alias("v"))).distinct(), f"{tag}-{k}")
        scratch.drop(old, f"{tag}-m{k}", f"{tag}-l{k}", f"{tag}-n{k}")
        old = f"{tag}-{k}"
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _is_star_forest(e: DataFrame) -> bool:
    """Every child has one parent, and no parent is a child."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(
        e.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    )
    g = ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p"))
    return g.where("c > 1 OR (c > 0 AND p > 0)").limit(1).count() == 0


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node reachable for each of nodes 0..n-1 under the pairs (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        root = new
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def row_groups(batches, columns, at_least: int = 65536):
    """Regroup sorted Arrow batches into chunks of whole groups.

    ``columns`` are the grouping columns by which the rows of the partition are
    sorted. Yields (table, starts) where ``starts`` holds each group's first
    row and the row count at its end. A chunk grows only until it holds
    ``at_least`` rows or the group at hand is complete.
    """
    import pyarrow as pa

    held: list = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < at_least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        starts = _starts(t, columns)
        if len(starts) > 2:
            cut = int(starts[-2])
            yield t.slice(0, cut), starts[:-1]
            t = t.slice(cut)
        held, rows = t.to_batches(), t.num_rows
        at_least = max(at_least, 2 * rows) if len(starts) <= 2 else at_least
    if rows:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, _starts(t, columns)


def _starts(t, columns) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in columns:
        v = t.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def binary_matrix(column, dtype) -> np.ndarray:
    """A column of equally long binary values as a matrix, without copying rows one by one."""
    import pyarrow as pa

    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = a.chunk(0)
    if not len(a):
        return np.zeros((0, 0), dtype)
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]]
    return raw.reshape(len(a), -1).view(dtype)
