"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample; every row is put into its leaf of every
tree. A query goes through all trees at once with one priority queue: the node
with the smallest margin seen on its way comes next, whichever tree it is in,
until the leaves taken hold the wanted part of all rows. Each taken leaf is
reranked exactly against the queries that asked for it, block by block.

Largest inner product is made nearness first: a component that lifts every
vector to one norm is added to the rows and 0 to the queries.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slantscan.llm.common import Scratch, row_groups
from slantscan.llm.vectors import matrix, valid

TREES = 8
DEPTH = 5  #: splits from root to leaf
SEARCH = 1.5  #: rows in the leaves a query takes, each tree's counted, as a part of all rows
SAMPLE = 20_000  #: rows that trees are fitted on at most
BLOCK = 4096  #: rows of a leaf in one block
QUERY_BLOCK = 4096  #: queries of a leaf in one block
NEAREST = 20


def fit(sample: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Directions (trees, 2**depth - 1, dims) and thresholds of complete binary
    trees: the children of node k are 2k + 1 (below) and 2k + 2. A node splits
    its sample at the median along the line through two of its members, or along
    a random direction where they are equal."""
    rng = np.random.default_rng(seed)
    nodes = 2**depth - 1
    w, t = np.zeros((trees, nodes, sample.shape[1])), np.zeros((trees, nodes))
    for tree in range(trees):
        members = {0: np.arange(len(sample))}
        for k in range(nodes):
            own = members.pop(k)
            d = np.zeros(sample.shape[1])
            if len(own) > 1:
                a, b = rng.choice(len(own), 2, replace=False)
                d = sample[own[a]] - sample[own[b]]
            if not d.any():
                d = rng.normal(size=sample.shape[1])
            d /= np.linalg.norm(d)
            p = sample[own] @ d
            t[tree, k] = np.median(p) if len(own) else 0.0
            w[tree, k] = d
            members[2 * k + 1], members[2 * k + 2] = own[p <= t[tree, k]], own[p > t[tree, k]]
    return w, t


def leaves(x: np.ndarray, w: np.ndarray, t: np.ndarray, depth: int) -> np.ndarray:
    """The leaf (0 .. 2**depth - 1) of each row in each tree."""
    out = np.zeros((len(x), len(w)), np.int64)
    for tree in range(len(w)):
        node = np.zeros(len(x), np.int64)
        p = x @ w[tree].T
        for _ in range(depth):
            at = np.arange(len(x)), node
            node = 2 * node + 1 + (p[at] > t[tree][node])
        out[:, tree] = node - (2**depth - 1)
    return out


def search(q: np.ndarray, w: np.ndarray, t: np.ndarray, depth: int, size: np.ndarray, want: float) -> list[tuple[int, int]]:
    """The (tree, leaf) pairs a query takes: best margin first over all trees,
    until their rows number ``want``. size: rows by tree and leaf."""
    first = 2**depth - 1
    margin = w @ q - t
    queue = [(0.0, tree, 0) for tree in range(len(w))]
    out, rows = [], 0
    while queue and rows < want:
        far, tree, node = heapq.heappop(queue)
        while node < first:
            m = margin[tree, node]
            heapq.heappush(queue, (max(far, abs(m)), tree, 2 * node + 1 + (m <= 0)))
            node = 2 * node + 1 + (m > 0)
        leaf = node - first
        if size[tree, leaf]:
            out.append((tree, leaf))
            rows += size[tree, leaf]
    return out


def nearest(df: DataFrame, id_col="vec_id", vec_col="embedding", query_every: int = 20, k: int = NEAREST, trees: int = TREES, depth: int = DEPTH, part: float = SEARCH, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` rows with the largest inner
    product found for each row whose id ``query_every`` divides.

    Scores are exact inner products in double precision of the original vectors;
    ties go to the smaller vec_id. Null, zero and non-finite vectors and rows
    without an id take no part; vectors are compared with those of their own
    length. Rows that repeat an id and vector count once; of an id with several
    vectors each is a candidate and the best stands. An empty table, or no other
    row, gives no rows. Other columns are not looked at.
    """
    scratch = Scratch(df.sparkSession)
    rows = valid(df, id_col, vec_col).withColumn("dims", F.size("vec")).withColumn("norm2", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = scratch.save(rows, "rows")
    found = None
    per = rows.groupBy("dims").agg(F.count("*").alias("n"), F.max("norm2").alias("most")).collect()  # one row a vector length
    for r in sorted(per, key=lambda r: r["dims"]):
        one = _search_one(rows.where(F.col("dims") == r["dims"]), scratch, r["dims"], r["n"], r["most"], query_every, k, trees, depth, part, sample)
        found = one if found is None else found.unionByName(one)
    schema = "query_id long, rank int, vec_id long, score double"
    return df.sparkSession.createDataFrame([], schema) if found is None else found


def _search_one(rows, scratch, dims, n, most, query_every, k, trees, depth, part, sample) -> DataFrame:
    lift = lambda x: np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1, keepdims=True), 0))])
    fit_on = rows.select("vec").orderBy(F.xxhash64("vec_id")).limit(sample) if n > sample else rows.select("vec")
    x = lift(np.array([v for (v,) in fit_on.collect()]))  # ``sample`` rows at most
    depth = min(depth, max(0, int(np.log2(max(1, len(x) / 16)))))
    w, t = fit(x, trees, depth)

    def assign(batches):
        for b in batches:
            v = matrix(b.column(1))
            leaf = leaves(lift(v), w, t, depth)
            flat = pa.array(leaf.ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * trees, pa.int32()), flat)], names=["vec_id", "vec", "leaf"])

    kind = dict(rows.dtypes)["vec"]
    indexed = rows.select("vec_id", "vec").mapInArrow(assign, f"vec_id long, vec {kind}, leaf array<int>")
    indexed = scratch.save(indexed, f"indexed{dims}")
    posted = indexed.select("vec_id", "vec", F.posexplode("leaf").alias("tree", "leaf"))
    counts = posted.groupBy("tree", "leaf").count().collect()  # trees * 2 ** depth rows at most
    size = np.zeros((trees, 2**depth), np.int64)
    for c in counts:
        size[c["tree"], c["leaf"]] = c["count"]

    def ask(batches):
        for b in batches:
            ids, v = b.column(0).to_numpy(), matrix(b.column(1))
            q = np.hstack([v, np.zeros((len(v), 1))])
            row, tree, leaf = [], [], []
            for i in range(len(q)):
                for a, c in search(q[i], w, t, depth, size, part * n):
                    row.append(i)
                    tree.append(a)
                    leaf.append(c)
            row = np.array(row, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), b.column(1).take(pa.array(row)), pa.array(tree, pa.int32()), pa.array(leaf, pa.int32())], names=["vec_id", "vec", "tree", "leaf"])

    queries = rows.where(F.pmod("vec_id", F.lit(query_every)) == 0).select("vec_id", "vec")
    asked = queries.repartition(F.xxhash64("vec_id")).mapInArrow(ask, f"vec_id long, vec {kind}, tree int, leaf int")
    asked = scratch.save(asked, f"asked{dims}")
    asks = np.zeros_like(size)
    for c in asked.groupBy("tree", "leaf").count().collect():
        asks[c["tree"], c["leaf"]] = c["count"]

    # A leaf's rows and its queries meet block by block; a block pair is one group.
    blocks = pd.DataFrame([(a, c, -(-size[a, c] // BLOCK), -(-asks[a, c] // QUERY_BLOCK)) for a in range(trees) for c in range(2**depth) if asks[a, c]], columns=["tree", "leaf", "kr", "kq"])
    blocks = rows.sparkSession.createDataFrame(blocks.astype(int), "tree int, leaf int, kr int, kq int") if len(blocks) else None
    schema = "query_id long, vec_id long, score double"
    if blocks is None:
        found = rows.sparkSession.createDataFrame([], schema)
    else:
        blocks = F.broadcast(blocks)  # trees * 2 ** depth rows at most
        own = lambda many: F.pmod(F.xxhash64("vec_id"), F.col(many)).cast("int")
        spread = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
        left = posted.join(blocks, ["tree", "leaf"]).select("tree", "leaf", own("kr").alias("br"), spread("kq").alias("bq"), F.lit(1).alias("side"), "vec_id", "vec")
        right = asked.join(blocks, ["tree", "leaf"]).select("tree", "leaf", spread("kr").alias("br"), own("kq").alias("bq"), F.lit(0).alias("side"), "vec_id", "vec")
        both = left.unionByName(right).withColumn("block", F.expr("br * 65536L + bq")).drop("br", "bq")
        both = both.repartition("tree", "leaf", "block").sortWithinPartitions("tree", "leaf", "block", "side")
        found = both.mapInArrow(_rerank(k), schema)
    # the blocks' best, each once; an id's best vector stands
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def _rerank(k: int):
    def run(batches):
        for table, starts in row_groups(batches, ["tree", "leaf", "block"], at_least=2 * BLOCK):
            ids, side = table.column("vec_id").to_numpy(), table.column("side").to_numpy()
            v = matrix(table.column("vec"))
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                q = s + int((side[s:e] == 0).sum())
                if q == s or q == e:
                    continue
                for a in range(s, q, 256):
                    yield from _best(ids[a : min(q, a + 256)], v[a : min(q, a + 256)], ids[q:e], v[q:e], k)

    return run


def _best(qid, q, rid, r, k):
    near = q @ r.T
    near[qid[:, None] == rid[None, :]] = -np.inf
    if len(rid) > k:  # all that reach the k-th value, ties and rounding included
        least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        row, col = np.nonzero((near >= least - 1e-9 * np.maximum(1, np.abs(least))) & np.isfinite(near))
    else:
        row, col = np.nonzero(np.isfinite(near))
    score = np.array([_dot(q[i], r[j]) for i, j in zip(row, col, strict=True)])
    yield pa.RecordBatch.from_arrays([pa.array(qid[row], pa.int64()), pa.array(rid[col], pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    """One value for a pair wherever it is met: the same sum in the same order."""
    return float(np.dot(a, b))
