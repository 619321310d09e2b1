"""Whitening of embeddings, fitted on distinct vectors.

Components are scaled to whole numbers x, so that equal vectors can be told from
near ones. Identical x are grouped to one row with its number of copies; the fit
weighs a distinct x by that count, or by one, so that a passage repeated a million
times needn't bend the axes. The covariance is a weighted product of the
centred matrix with itself, made block by block inside tasks: a first pass gives
the weights' sum and the sums by dimension, exactly, a second one the product of
what is left after the mean is subtracted. The eigenvectors of the covariance
whiten each distinct x once, and the result is joined back to the rows.

Only matrices of dimension x dimension reach the driver. A vector that is more
than a thousandth of all rows is joined back by a broadcast of those vectors (a
thousand at most), so a hot one isn't gathered into one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantscan.llm import vectors
from slantscan.llm.common import Scratch

SCALE = 256
COMPONENTS = 4
HOT = 1000  #: a vector is hot if it makes more than 1/HOT of all rows; there are HOT of them at most
RANK = 1e-12  #: a component with less than this part of the trace is no component


def scaled(df: DataFrame, id_col="vec_id", vec_col="embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, x = floor(scale * vector), of the rows whose vector is neither null nor
    empty and holds no null and no non-finite entry."""
    kind = "array<float>" if dict(df.dtypes).get(vec_col) == "array<float>" else "array<double>"
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = v.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)))
    return v.select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("x"))


def _key():
    """128 bits that stand for x in shuffles."""
    return F.struct(F.xxhash64("x").alias("a"), F.xxhash64(F.lit("second"), "x").alias("b"))


def _weights(t, weigh: str) -> np.ndarray:
    return t.column("n").to_numpy().astype(np.int64) if weigh == "count" else np.ones(t.num_rows, np.int64)


def _integers(column) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy().reshape(len(a), -1)


def _sums(weigh: str):
    """Each task's sum of weights (dimension -1) and of weighted x by dimension."""

    def run(batches):
        n, total = 0, 0
        for b in batches:
            if b.num_rows:
                w = _weights(b, weigh)
                n += int(w.sum())
                total = total + w @ _integers(b.column("x"))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))], pa.int32()), pa.array([n, *total.tolist()], pa.int64())], names=["dim", "s"])

    return run


def _products(weigh: str, mean: np.ndarray):
    """Each task's weighted product of its centred rows, a row for each dimension."""

    def run(batches):
        c = np.zeros((len(mean), len(mean)))
        for b in batches:
            if b.num_rows:
                y = _integers(b.column("x")) - mean
                c += (y * _weights(b, weigh)[:, None]).T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(len(c)), pa.int32()), pa.array(list(c))], names=["dim", "c"])

    return run


def _add_rows(batches):
    """Rows of partial products, all of a dimension in one task: their sums."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for d, row in zip(b.column("dim").to_pylist(), vectors.matrix(b.column("c"))):
            total[d] = total[d] + row if d in total else row
    yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["dim", "c"])


def _whiten(n: int, sums: list[int], axes: np.ndarray):
    """For each distinct x: its deviation, exactly, and its whitened components."""
    mean = np.array(sums) / n

    def run(batches):
        for b in batches:
            x = _integers(b.column("x")) if b.num_rows else np.zeros((0, len(sums)), np.int64)
            most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
            kind = np.int64 if most * most * len(sums) < 1 << 63 else object
            y = n * x.astype(kind) - np.array(sums, kind)
            deviation = (y * y).sum(axis=1).tolist()
            white = (x - mean) @ axes
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("n"), pa.array(deviation, pa.decimal128(38, 0)), pa.array(list(white), pa.list_(pa.float64()))],
                names=["key", "n", "deviation", "whitened"],
            )

    return run


def fit(distinct: DataFrame, weigh: str = "one") -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """(n, sums by dimension, eigenvalues falling, unit eigenvectors in columns) of the
    weighted covariance of ``distinct`` (x, n), divisor n. The sign of an eigenvector
    makes its largest entry positive."""
    s = {r["dim"]: r["s"] for r in distinct.mapInArrow(_sums(weigh), "dim int, s long").groupBy("dim").agg(F.sum("s").alias("s")).collect()}
    if not s:
        return 0, [], np.zeros(0), np.zeros((0, 0))
    n = s.pop(-1)
    sums = [s[i] for i in range(len(s))]
    d = len(sums)
    parts = distinct.mapInArrow(_products(weigh, np.array(sums) / n), "dim int, c array<double>")
    rows = parts.repartition("dim").mapInArrow(_add_rows, "dim int, c array<double>").collect()  # one row a dimension
    v = np.zeros((d, d))
    for r in rows:
        v[r["dim"]] = r["c"]
    e, u = np.linalg.eigh((v + v.T) / (2 * n))
    e, u = e[::-1], u[:, ::-1]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(d)] < 0, -1, 1)
    return n, sums, e, u


def whiten(df: DataFrame, id_col="vec_id", vec_col="embedding", components: int = COMPONENTS, weigh: str = "one", scale: int = SCALE) -> DataFrame:
    """A row for each valid vector and component: vec_id, component (from 1, by falling
    eigenvalue), n (sum of weights), deviation (decimal: sum over dimensions of
    (n * x - S) squared, exact), whitened, explained (share of the trace),
    identity_error (largest absolute entry of the whitened fit list's covariance
    minus the identity, one value).

    ``weigh``: 'one' or 'count', a distinct vector's weight in the fit. Vectors that
    are null, empty or hold null or non-finite entries take no part; zero vectors
    do. Vectors of another length than the longest take no part. Repeated rows and
    null ids are rows like others. Only components with a variance are returned: a
    table with fewer than two distinct vectors, or none, gives no rows.
    """
    if weigh not in ("one", "count"):
        raise ValueError("weigh must be 'one' or 'count'")
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = scaled(df, id_col, vec_col, scale)
    length = rows.agg(F.max(F.size("x"))).first()[0]
    rows = rows.where(F.size("x") == F.lit(length)).withColumn("key", _key())
    grouped = rows.groupBy("key", "x").agg(F.count(F.lit(1)).alias("n"))
    distinct = scratch.save(grouped, "distinct")
    n, sums, e, u = fit(distinct, weigh)
    trace = float(e.sum()) if len(e) else 0.0
    kept = [i for i in range(min(components, len(e))) if e[i] > RANK * trace]
    if not kept:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    axes = u[:, kept] / np.sqrt(e[kept])
    key = "key struct<a:bigint,b:bigint>"
    white = scratch.save(distinct.mapInArrow(_whiten(n, sums, axes), f"{key}, n long, deviation decimal(38,0), whitened array<double>"), "white")
    error = _identity_error(white, weigh, len(kept))
    total = white.agg(F.sum("n")).first()[0]
    hot = scratch.save(white.where(F.col("n") * HOT > total), "hot")  # HOT rows at most
    ids = rows.select("vec_id", "key")
    taken = ["vec_id", "deviation", "whitened"]
    out = ids.join(F.broadcast(hot), "key").select(*taken)
    cold = ids.join(F.broadcast(hot.select("key")), "key", "left_anti")
    out = out.unionByName(cold.join(white.where(F.col("n") * HOT <= total), "key").select(*taken))
    out = out.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(e[i] / trace)) for i in kept]), F.col("i") + 1)
    return out.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def _identity_error(white: DataFrame, weigh: str, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity."""
    w = F.col("n").cast("double") if weigh == "count" else F.lit(1.0)
    c = [F.element_at("whitened", i + 1) for i in range(k)]
    first = white.agg(F.sum(w).alias("n"), *[F.sum(w * c[i]).alias(f"s{i}") for i in range(k)]).first()
    mean = [first[f"s{i}"] / first["n"] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    second = white.agg(*[F.sum(w * (c[i] - mean[i]) * (c[j] - mean[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
    return max(abs(second[f"p{i}_{j}"] / first["n"] - (i == j)) for i, j in pairs)
