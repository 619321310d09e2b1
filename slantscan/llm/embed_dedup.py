"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine c differ by 2 - 2c in squared distance. Rotated and
split into blocks of ``BLOCK_DIMS`` dimensions, two linked vectors differ in at
least one block by no more than that block's part of it. In each block the space
is divided into cells; a vector lives in one cell and visits those that its
block's budget reaches, so a cell meets every pair within the budget. A pair is
counted in the first block in which it is within the budget, by exact integer
arithmetic on rotated coordinates that were rounded to a fixed grid (the budget
is widened by the rounding), and confirmed by its cosine.

Equal vectors are one row with a weight. A cell's rows are dealt out as pairs of
blocks of bounded size; tasks give back counts and spanning connections only,
never pairs, so a group of copies costs comparisons but no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantscan.llm.common import Scratch, components, local_roots, row_groups
from slantscan.llm.vectors import matrix, valid

COSINE = 0.95
BLOCK_DIMS = 4
SAMPLE = 20_000  #: rows that cells are fitted on at most
CELL = 8192  #: rows that live in a cell, on average over the cells
DEEPEST = 12  #: splits from the whole space to a cell at most
HOME_BLOCK, VISIT_BLOCK = 16384, 32768
TILE = 128  #: rows that are compared at once; their surroundings bound what with
GRID = 1 << 20  #: rotated coordinates are rounded to 1 / GRID


def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation."""
    return np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))[0]


class Subspaces:
    """Blocks of rotated coordinates and the cells of each, fitted on a sample."""

    def __init__(self, dims: int, cosine: float, sample: np.ndarray, depth: int):
        self.dims, self.cosine = dims, cosine
        many = -(-dims // BLOCK_DIMS)
        edges = [dims * k // many for k in range(many + 1)]
        self.blocks = list(zip(edges[:-1], edges[1:], strict=True))
        self.turn = rotation(dims)
        slack = 8 * dims  # of two roundings, a part of the whole budget's root, in grid steps
        whole = (math.sqrt(max(0.0, 2 - 2 * cosine)) * GRID + slack) ** 2
        self.budget = [whole * (e - s) / dims for s, e in self.blocks]
        x = self.coordinates(sample)
        self.cells = [self._split(x[:, s:e], depth) for s, e in self.blocks]

    def coordinates(self, unit: np.ndarray) -> np.ndarray:
        return np.rint(unit @ self.turn * GRID)

    @staticmethod
    def _split(x: np.ndarray, depth: int) -> list:
        """A complete binary tree of (dimension, value): at the median of the widest dimension."""
        members, out = {0: np.arange(len(x))}, []
        for k in range(2**depth - 1):
            at = members.pop(k)
            own = x[at]
            d = int(np.argmax(own.std(axis=0))) if len(own) else 0
            v = float(np.floor(np.median(own[:, d]))) + 0.5 if len(own) else 0.5
            out.append((d, v))
            above = x[at, d] > v
            members[2 * k + 1], members[2 * k + 2] = at[~above], at[above]
        return out

    def home(self, block: int, x: np.ndarray) -> np.ndarray:
        tree, node = self.cells[block], np.zeros(len(x), np.int64)
        dims = np.array([d for d, _ in tree], np.int64)
        cut = np.array([v for _, v in tree])
        for _ in range((len(tree) + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] > cut[node])
        return node - len(tree)

    def reached(self, block: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells whose part of the space is within the budget."""
        tree, most = self.cells[block], self.budget[block]
        todo = [(0, np.arange(len(x)), np.zeros_like(x))]
        rows, cells = [], []
        while todo:
            node, at, off = todo.pop()
            if not len(at):
                continue
            if node >= len(tree):
                rows.append(at)
                cells.append(np.full(len(at), node - len(tree)))
                continue
            d, cut = tree[node]
            gap = x[at, d] - cut
            for child, far in ((2 * node + 1, gap > 0), (2 * node + 2, gap <= 0)):
                o = off.copy()
                o[far, d] = np.maximum(o[far, d], np.abs(gap[far]))
                ok = (o * o).sum(axis=1) <= most
                todo.append((child, at[ok], o[ok]))
        return np.concatenate(rows), np.concatenate(cells)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _key(batches):
    """A fingerprint of each vector; -0.0 counts as 0.0."""
    for b in batches:
        a = b.column(1)
        keys = [hashlib.blake2b((np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) + 0.0).tobytes(), digest_size=16).digest() for v in a]
        yield pa.RecordBatch.from_arrays([b.column(0), a, pa.array(keys, pa.binary())], names=["vec_id", "vec", "key"])


def near_duplicates(df: DataFrame, id_col="vec_id", vec_col="embedding", cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept.

    Rows link if their cosine in double precision is ``cosine`` or more, whatever
    their other columns; component_id is the smallest id reachable, kept marks
    it. Null, zero and non-finite vectors link with nothing; nor do vectors of
    different lengths. n_links counts the other rows, equal ones included (rows
    that repeat an id are other rows). Of an id with several vectors n_links sums
    those of all, and all are connected. A null id takes no part: n_links 0,
    component_id null, kept true. An empty table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = valid(df, id_col, vec_col)
    kind = dict(rows.dtypes)["vec"]
    rows = scratch.save(rows.mapInArrow(_key, f"vec_id long, vec {kind}, key binary"), "rows")
    classes = rows.groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    classes = scratch.save(classes.withColumn("class", F.monotonically_increasing_id()).withColumn("dims", F.size("vec")), "classes")
    held = scratch.save(rows.select("vec_id", "key").join(classes.select("key", "class"), "key").select("vec_id", "class"), "held")

    found = []
    for r in classes.groupBy("dims").agg(F.count("*").alias("n")).orderBy("dims").collect():  # one row a vector length
        found.append(_join(classes.where(F.col("dims") == r["dims"]), r["dims"], r["n"], cosine, sample, scratch))
    if not found:
        found = [spark.createDataFrame([], "class long, n long, root long")]
    links = found[0]
    for f in found[1:]:
        links = links.unionByName(f)
    counts = scratch.save(links.where("n > 0").groupBy("class").agg(F.sum("n").alias("n")), "counts")
    both = held.groupBy("vec_id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a <> z")
    same_id = held.join(both, "vec_id").where("class <> a").select("a", F.col("class").alias("b"))
    edges = links.where("root <> class").select(F.col("class").alias("a"), F.col("root").alias("b")).union(same_id)
    comp = scratch.save(components(edges, scratch, "linked"), "linked")
    named = scratch.save(classes.select("class", "first_id").join(comp, F.col("class") == F.col("node")).select("class", "first_id", "component"), "named")
    lowest = scratch.save(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "lowest")
    named = scratch.save(named.join(lowest, "component").select("class", "component_id"), "by_class")
    info = classes.select("class", "first_id", "weight").join(counts, "class", "left").join(named, "class", "left")
    info = info.select("class", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
    per_id = held.distinct().join(scratch.save(info, "info"), "class").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    per_id = scratch.save(per_id, "per_id")
    out = df.select(F.col(id_col).cast("long").alias("vec_id")).join(per_id, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _join(classes: DataFrame, dims: int, n: int, cosine: float, sample: int, scratch: Scratch) -> DataFrame:
    """(class, n, root): rows that a class links with, and a class it is connected with."""
    few = classes.select("vec") if n <= sample else classes.select("vec").orderBy(F.xxhash64("class")).limit(sample)
    fitted = _unit(np.array([v for (v,) in few.collect()], np.float64))  # ``sample`` rows at most
    depth = int(min(DEEPEST, max(0, round(math.log2(max(1, n / CELL)))), max(0, math.log2(max(1, len(fitted) / 4)))))
    space = Subspaces(dims, cosine, fitted, depth)
    cells = 2**depth

    def place(batches):  # rows that live in and that reach each cell
        for b in batches:
            x = space.coordinates(_unit(matrix(b.column(0))))
            at, lives, visits = [], [], []
            for k, (s, e) in enumerate(space.blocks):
                at.append(k * cells + np.arange(cells))
                lives.append(np.bincount(space.home(k, x[:, s:e]), minlength=cells))
                visits.append(np.bincount(space.reached(k, x[:, s:e])[1], minlength=cells))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (at, lives, visits)], names=["cell", "lives", "visits"])

    count = classes.select("vec").mapInArrow(place, "cell long, lives long, visits long").groupBy("cell").agg(F.sum("lives").alias("l"), F.sum("visits").alias("v"))
    homes, guests = np.ones((2, len(space.blocks) * cells), np.int64)
    for r in count.collect():  # a row per cell
        homes[r["cell"]], guests[r["cell"]] = max(1, -(-r["l"] // HOME_BLOCK)), max(1, -(-r["v"] // VISIT_BLOCK))

    def deal(batches):
        for b in batches:
            ids, v = b.column(0).to_numpy(), matrix(b.column(2))
            x = space.coordinates(_unit(v))
            mix = (ids * 0x9E3779B1 >> 8) & 0x7FFFFFFF
            row, cell, pair, role = [], [], [], []
            for k, (s, e) in enumerate(space.blocks):
                live = k * cells + space.home(k, x[:, s:e])
                at, reach = space.reached(k, x[:, s:e])
                reach = reach + k * cells
                own = reach == live[at]
                single = (homes[reach] == 1) & (guests[reach] == 1)
                # role 2: lives here and is compared with; 1: compared with; 0: lives here
                for r, c, kind in ((at[own & single], reach[own & single], 2), (at[~(own & single)], reach[~(own & single)], 1)):
                    many = homes[c]
                    i = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    r, c = np.repeat(r, many), np.repeat(c, many)
                    row.append(r)
                    cell.append(c)
                    pair.append(i * 65536 + mix[r] % guests[c])
                    role.append(np.full(len(r), kind))
                r = np.flatnonzero((homes[live] > 1) | (guests[live] > 1))
                c = live[r]
                many = guests[c]
                j = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                r, c = np.repeat(r, many), np.repeat(c, many)
                row.append(r)
                cell.append(c)
                pair.append(mix[r] // 7 % homes[c] * 65536 + j)
                role.append(np.zeros(len(r), np.int64))
            row, cell, pair, role = (np.concatenate(z) for z in (row, cell, pair, role))
            for a in range(0, len(row), 8192):
                z = pa.array(row[a : a + 8192])
                yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + 8192]), pa.array(pair[a : a + 8192]), pa.array(role[a : a + 8192].astype(np.int32)), b.column(0).take(z), b.column(1).take(z), b.column(2).take(z)], names=["cell", "pair", "role", "class", "weight", "vec"])

    kind = dict(classes.dtypes)["vec"]
    dealt = classes.select("class", "weight", "vec").mapInArrow(deal, f"cell long, pair long, role int, class long, weight long, vec {kind}")
    dealt = dealt.repartition("cell", "pair").sortWithinPartitions("cell", "pair")

    def compare(batches):
        for t, starts in row_groups(batches, ["cell", "pair"], at_least=HOME_BLOCK):
            ids, weight, role = (t.column(c).to_numpy() for c in ("class", "weight", "role"))
            unit = _unit(matrix(t.column("vec")))
            x = space.coordinates(unit)
            block = t.column("cell").to_numpy() // cells
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                g = np.arange(s, e)
                lives, others = g[role[s:e] != 1], g[role[s:e] != 0]
                if len(lives) and len(others):
                    yield from _compare(space, int(block[s]), ids, weight, unit, x, lives, others)

    return scratch.save(dealt.mapInArrow(compare, "class long, n long, root long"), f"found{dims}")


def _tiles(x: np.ndarray, at: np.ndarray):
    """Rows that lie close together: halved along the widest dimension down to TILE rows."""
    if len(at) <= TILE:
        yield at
        return
    d = int(np.argmax(np.ptp(x[at], axis=0)))
    at = at[np.argsort(x[at, d], kind="stable")]
    yield from _tiles(x, at[: len(at) // 2])
    yield from _tiles(x, at[len(at) // 2 :])


def _compare(space: Subspaces, block: int, ids, weight, unit, x, lives, others):
    """Rows of ``others`` that each of ``lives`` links with, first met in this block.

    A tile of neighbours is held only against rows that the budget reaches from
    their common surroundings; single precision rules out what is far from the
    cosine, and what is left is decided exactly: budgets, then the cosine."""
    s, e = space.blocks[block]
    y, y32 = x[others], unit[others].astype(np.float32)
    for at in _tiles(x[:, s:e], lives):
        low, high = x[at, s:e].min(axis=0), x[at, s:e].max(axis=0)
        gap = np.maximum(np.maximum(low - y[:, s:e], y[:, s:e] - high), 0)
        near = np.flatnonzero((gap * gap).sum(axis=1) <= space.budget[block])
        if not len(near):
            continue
        rough = unit[at].astype(np.float32) @ y32[near].T >= space.cosine - 1e-4
        rough &= ids[at][:, None] != ids[others[near]][None, :]
        found = np.count_nonzero(rough)
        if not found:
            continue
        if found * 4 > rough.size:
            i, j = _dense(space, block, ids, unit, x, at, others[near], rough)
        else:
            i, j = _sparse(space, block, ids, unit, x, at, others[near], *np.nonzero(rough))
        if not len(i):
            continue
        b = others[near]
        n = np.bincount(i, weight[b[j]], minlength=len(at)).astype(np.int64)
        node, inv = np.unique(np.concatenate([ids[at[i]], ids[b[j]]]), return_inverse=True)
        root = node[local_roots(len(node), inv[: len(i)], inv[len(i) :])]
        own = np.zeros(len(node), np.int64)
        has = np.flatnonzero(n)
        own[np.searchsorted(node, ids[at[has]])] = n[has]
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(own), pa.array(root)], names=["class", "n", "root"])


def _dense(space, block, ids, unit, x, a, b, ok):
    """Most pairs are close: whole matrices. Squared distances of whole numbers
    below 2 ** 53 are exact, whatever the order of the sums."""
    for k in range(block + 1):
        s, e = space.blocks[k]
        p, q = x[a, s:e], x[b, s:e]
        within = (p**2).sum(axis=1)[:, None] + (q**2).sum(axis=1)[None, :] - 2 * (p @ q.T) <= space.budget[k]
        ok &= within if k == block else ~within
        if not ok.any():
            break
    cos = unit[a] @ unit[b].T
    for i, j in zip(*np.nonzero(ok & (np.abs(cos - space.cosine) < 1e-9)), strict=True):
        ok[i, j] = _cosine(unit[a[i]], unit[b[j]], ids[a[i]], ids[b[j]]) >= space.cosine
    ok &= (cos >= space.cosine) | (np.abs(cos - space.cosine) < 1e-9)
    return np.nonzero(ok)


def _sparse(space, block, ids, unit, x, a, b, i, j):
    out_i, out_j = [], []
    starts, end = [s for s, _ in space.blocks[: block + 1]], space.blocks[block][1]
    for z in range(0, len(i), 1 << 15):
        p, q = i[z : z + (1 << 15)], j[z : z + (1 << 15)]
        within = np.add.reduceat((x[a[p], :end] - x[b[q], :end]) ** 2, starts, axis=1) <= np.array(space.budget[: block + 1])
        first = within[:, block] & ~within[:, :block].any(axis=1)
        p, q = p[first], q[first]
        cos = np.einsum("ij,ij->i", unit[a[p]], unit[b[q]])
        good = cos >= space.cosine
        for m in np.flatnonzero(np.abs(cos - space.cosine) < 1e-9):
            good[m] = _cosine(unit[a[p[m]]], unit[b[q[m]]], ids[a[p[m]]], ids[b[q[m]]]) >= space.cosine
        out_i.append(p[good])
        out_j.append(q[good])
    return np.concatenate(out_i), np.concatenate(out_j)


def _cosine(a, b, i, j) -> float:
    """A pair's cosine, the same from either side."""
    a, b = (a, b) if i < j else (b, a)
    return math.fsum((a * b).tolist())
