"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Every text gives its full set of five-word shingles, the set's fingerprint
   and a signature of ``COORDS`` minima. Equal sets are one class; its smallest
   id stands for it from here on, so thousands of copies are one row.
2. A class is posted under each coordinate-value pair. Pairs held by one class
   join nothing. The others are ranked by how many classes hold them; if two
   classes agree in at least ``MATCHES`` of ``COORDS`` coordinates, they share a
   pair among the first ``COORDS - MATCHES + 1`` of either (prefix), and the
   long lists at the end of the ranking are never merged (skip): their
   agreements are read off the signatures that travel with the posting.
3. In each posting list collisions are counted and the classes that agree in at
   least ``MATCHES`` coordinates connected; a long list is dealt out as pairs of
   blocks, so none meets in one task. Only a spanning set of connections leaves
   a task.
4. Connected classes form families; within a family (again by pairs of blocks
   of bounded text) links are confirmed on the full shingle sets and connected.

At similarity 0.75 a pair agrees in 48 of 64 coordinates on average with a
standard deviation of 3.5; the threshold of 34 is four of them below, so a
linked pair is missed with probability 3e-5 or less.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantscan.llm.common import Scratch, binary_matrix, components, local_roots, row_groups, text_batches
from slantscan.llm.shingles import shingle_set, stream

COORDS = 64
MATCHES = 34
LIST_BLOCK = 1024  #: classes of a posting list in one block
FAMILY_BLOCK = 1 << 20  #: shingles of a family in one block
SIMILARITY = 75  #: percent

_A, _B = stream(COORDS, 11) | np.uint64(1), stream(COORDS, 12)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each of COORDS multiply-add hashes, its upper 32 bits."""
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[k : k + 2048, None] * _A + _B).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _sketch(batches):
    """doc_id, text -> doc_id, n_shingles, fingerprint of the set, signature."""
    for b in batches:
        n, key, sig = [], [], []
        for t in b.column(1):
            s = shingle_set(t.as_py())
            n.append(len(s))
            key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sig.append(signature(s).view(np.int32) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.list_(pa.int32()))],
            names=["doc_id", "n_shingles", "fingerprint", "sig"],
        )


def _collide(batches):
    """Sorted postings (token, block, class, sig8) -> connections (a, b) of classes
    that agree in at least MATCHES coordinates."""
    for t, starts in row_groups(batches, ["token", "block"]):
        if len(starts) < 2:
            continue
        sig = binary_matrix(t.column("sig8"), np.uint8)
        ids, node = np.unique(t.column("class").to_numpy(), return_inverse=True)
        end = np.repeat(starts[1:], np.diff(starts))
        at = np.arange(len(end))
        found_i, found_j, d = [], [], 1
        while True:
            at = at[at + d < end[at]]
            if not len(at):
                break
            for k in range(0, len(at), 1 << 17):
                i = at[k : k + (1 << 17)]
                i = i[node[i] != node[i + d]]
                i = i[(sig[i] == sig[i + d]).sum(axis=1) >= MATCHES]
                found_i.append(node[i])
                found_j.append(node[i + d])
            d += 1
            if d % 64 == 0:  # keep what was found small: connections, not pairs
                found_i, found_j = _thin(len(ids), found_i, found_j)
        found_i, found_j = _thin(len(ids), found_i, found_j)
        if len(found_i) and len(found_i[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[found_i[0]]), pa.array(ids[found_j[0]])], names=["a", "b"])


def _thin(n: int, i: list, j: list):
    if not i:
        return i, j
    root = local_roots(n, np.concatenate(i), np.concatenate(j))
    k = np.flatnonzero(root != np.arange(n))
    return [k], [root[k]]


def _confirm(batches):
    """Sorted family members (family, block, side, class, sig8, text) -> confirmed
    links (a, b), as many as connect what is linked within the block pair."""
    for t, starts in row_groups(batches, ["family", "block"], at_least=256):
        sig = binary_matrix(t.column("sig8"), np.uint8)
        reps, side = t.column("class").to_numpy(), t.column("side").to_numpy()
        text = t.column("text")
        out_a, out_b = [], []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if e - s < 2:
                continue
            sets = [shingle_set(text[int(k)].as_py()) for k in range(s, e)]
            for i, j in _links(sets, sig[s:e], side[s:e]):
                out_a.append(reps[s + i])
                out_b.append(reps[s + j])
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def _links(sets: list, sig: np.ndarray, side: np.ndarray):
    """Links (i, j) between sets that connect all that are linked. side: 0 and 1
    for the two blocks of a pair (only pairs across count), 2 for one block."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(ids.max() + 1, bool)
    root = np.arange(n)
    done = np.zeros(n, bool)
    # the member nearest to the family's common signature first: it connects most at once
    values = np.array([np.bincount(sig[:, c], minlength=256)[sig[:, c]] for c in range(COORDS)])
    for i in np.argsort(-values.sum(axis=0), kind="stable"):
        done[i] = True
        may = ~done & (root != root[i])
        if side[i] != 2:
            may &= side != side[i]
        may &= 100 * np.minimum(size, size[i]) >= SIMILARITY * np.maximum(size, size[i])
        j = np.flatnonzero(may)
        j = j[(sig[j] == sig[i]).sum(axis=1) >= MATCHES]
        if not len(j):
            continue
        mark[ids[at[i] : at[i + 1]]] = True
        take = np.repeat(at[j] - np.concatenate([[0], np.cumsum(size[j])[:-1]]), size[j]) + np.arange(size[j].sum())
        both = np.add.reduceat(mark[ids[take]].astype(np.int64), np.concatenate([[0], np.cumsum(size[j])[:-1]]))
        mark[ids[at[i] : at[i + 1]]] = False
        for k in j[100 * both >= SIMILARITY * (size[j] + size[i] - both)]:
            if root[k] != root[i]:
                yield int(i), int(k)
                root[root == max(root[k], root[i])] = min(root[k], root[i])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Rows link if 100 * |intersection| >= 75 * |union| of their full shingle
    sets; component_id is the smallest id reachable, kept marks it. Texts that
    are null, empty or without words have no shingles and link with nothing
    (kept). Rows that repeat an id are one document with several texts: they get
    one component and are all marked alike. A row whose id is null takes no
    part: component_id null, kept true. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = rows.mapInArrow(_sketch, "doc_id long, n_shingles long, fingerprint binary, sig array<int>")
    sketch = scratch.save(sketch, "sketch")
    some = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = some.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    sig8 = "unhex(array_join(transform(sig, x -> lpad(hex(x & 255), 2, '0')), ''))"
    # the number is written with the class, so it stays what it is
    classes = scratch.save(classes.withColumn("class", F.monotonically_increasing_id()).withColumn("sig8", F.expr(sig8)), "classes")
    held = some.select("doc_id", "fingerprint").distinct().join(classes.select("fingerprint", "class"), "fingerprint")
    held = scratch.save(held.select("doc_id", "class"), "held")
    first = held.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a <> z")
    same_id = scratch.save(held.join(first, "doc_id").where("class <> a").select("a", F.col("class").alias("b")), "same_id")

    tokens = classes.select("class", F.posexplode("sig").alias("c", "v")).selectExpr(
        "class", "shiftleft(cast(c AS long), 32) | (cast(v AS long) & 4294967295) AS token"
    )
    shared = scratch.save(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    ranked = tokens.join(shared, "token").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("pairs"))
    # the pairs that no other class holds rank first and use up the prefix
    prefix = f"slice(pairs, 1, greatest(0, {COORDS - MATCHES + 1} - ({COORDS} - size(pairs))))"
    posted = ranked.selectExpr("class", f"inline({prefix})").join(classes.select("class", "sig8"), "class")
    posted = posted.withColumn("k", F.expr(f"cast(ceil(n / {LIST_BLOCK}) AS int)")).withColumn("own", F.expr("cast(pmod(xxhash64(class), k) AS int)"))
    blocks = "transform(sequence(0, k - 1), x -> cast(least(x, own) AS long) * k + greatest(x, own))"
    posted = posted.select("token", F.explode(F.expr(blocks)).alias("block"), "class", "sig8")
    links = posted.repartition("token", "block").sortWithinPartitions("token", "block").mapInArrow(_collide, "a long, b long")
    families = scratch.save(components(links.union(same_id), scratch, "families"), "families")

    members = classes.join(families, classes["class"] == families.node).select("class", "first_id", "n_shingles", "sig8", F.col("component").alias("family"))
    members = scratch.save(members, "members")
    sizes = scratch.save(members.groupBy("family").agg(F.sum("n_shingles").alias("total")), "sizes")
    members = members.join(sizes, "family").withColumn("k", F.expr(f"cast(ceil(total / {FAMILY_BLOCK}) AS int)"))
    members = members.withColumn("own", F.expr("cast(pmod(xxhash64(class, 7L), k) AS int)"))
    members = scratch.save(members.select("class", "first_id", "family", "k", "own", "sig8"), "dealt")
    texts = rows.where("text IS NOT NULL").join(members, rows.doc_id == members.first_id)
    texts = texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["class", "h"])  # repeated rows of one id
    blocks = (
        "transform(sequence(0, k - 1), x -> struct(cast(least(x, own) AS long) * k + greatest(x, own) AS block, "
        "CASE WHEN x = own THEN 2 WHEN own < x THEN 0 ELSE 1 END AS side))"
    )
    pairs = texts.select("family", F.explode(F.expr(blocks)).alias("p"), "class", "sig8", "text")
    pairs = pairs.select("family", "p.block", "p.side", "class", "sig8", "text")
    pairs = pairs.repartition("family", "block").sortWithinPartitions("family", "block")
    confirmed = pairs.mapInArrow(_confirm, "a long, b long")
    linked = scratch.save(components(confirmed.union(same_id), scratch, "linked"), "linked")

    named = classes.select("class", "first_id").join(linked, classes["class"] == linked.node)
    named = scratch.save(named.select("class", "component", "first_id"), "named")
    lowest = scratch.save(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "lowest")
    by_class = scratch.save(named.join(lowest, "component").select("class", "component_id"), "by_class")
    by_class = classes.select("class", "first_id").join(by_class, "class", "left").select("class", F.coalesce("component_id", "first_id").alias("component_id"))
    by_id = scratch.save(held.join(by_class, "class").groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "by_id")
    out = sketch.select("doc_id", "n_shingles").join(by_id, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)).alias("kept"))
