"""Ranked lexical search by hashed max-sketches.

A term's impact in a document depends on its count there and on the document's
length. A document's impacts fold into a sketch of WIDTH coordinates: each term
is hashed to one, and a coordinate keeps the largest impact that falls on it. For
a query, the weights of its terms times the impacts at their coordinates sum up
to at least the document's score. All queries of a block look up their
coordinates in the sketches of a batch of documents at once; each query then
takes documents in descending order of these bounds and rescores them exactly,
until the bound falls below the score of its last hit so far.

Texts are read twice, first for the counts over all documents (terms, documents
with a term, occurrences), then for sketches, bounds and scores. Hits leave a
task as k rows for each query, so no postings and no texts are shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slantscan.llm.common import Scratch, small_batches

WIDTH = 1 << 14  #: coordinates of a sketch
BEST = 10
BLOCK = 1 << 17  #: terms of the queries that are searched for in one pass (one query at least)
PART = 512  #: documents that are sketched at once, at most

#: what a term may consist of stays, A-Z in lower case, anything else is a blank
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII (UTF-8)."""
    return text.translate(_KEEP).split() if text else []


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _count(vocabulary: frozenset):
    """For each task: documents with terms (row ""), their terms (row " "), and documents with each term of the vocabulary."""

    def run(batches):
        found, docs, length = Counter(), 0, 0
        for b in batches:
            for t in b.column("text").to_pylist():
                ts = terms(t)
                docs += bool(ts)
                length += len(ts)
                found.update(vocabulary.intersection(ts))
        names = [b"", b" ", *found]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([docs, length, *found.values()], pa.int64())], names=["term", "n"])

    return run


class _Queries:
    """The queries of a block: their terms' coordinates and weights, and the best hits so far."""

    def __init__(self, queries: list[dict[bytes, int]], weights: dict[bytes, int], best: int):
        self.terms = [[(t, n * weights[t]) for t, n in q.items() if weights.get(t)] for q in queries]
        self.at = [np.array([_coordinate(t) for t, _ in q], np.int64) for q in self.terms]
        self.weight = [np.array([w for _, w in q], np.int64) for q in self.terms]
        self.best = best
        self.hits: list[list[tuple]] = [[] for _ in queries]  # (-score, no id, id), ascending

    def search(self, ids: list, counts: list[dict[bytes, int]], base: np.ndarray) -> None:
        """``counts``: terms of each document, ``base``: 8 * m of each."""
        sketch = _sketch(counts, base)
        for q, at in enumerate(self.at):
            if not len(at):
                continue
            bound = self.weight[q] @ sketch[at]  # of every document
            hits = self.hits[q]
            least = -hits[-1][0] if len(hits) == self.best else 1
            near = np.flatnonzero(bound >= least)
            for d in near[np.argsort(-bound[near], kind="stable")]:
                if bound[d] < least:
                    break
                key = (ids[d] is None, ids[d] or 0)
                if len(hits) == self.best and bound[d] == least and key > hits[-1][1:]:
                    continue  # a tie at best, behind the last hit
                score = self._score(q, counts[d], int(base[d]))
                if score > 0 and (len(hits) < self.best or (-score, *key) < hits[-1]):
                    hits.append((-score, *key))
                    hits.sort()
                    del hits[self.best :]
                    least = -hits[-1][0] if len(hits) == self.best else 1

    def _score(self, q: int, count: dict[bytes, int], base: int) -> int:
        score = 0
        for t, w in self.terms[q]:
            tf = count.get(t)
            if tf:
                score += w * ((1_000_000_000 * tf) // (1000 * tf + base))
        return score


def _coordinate(term: bytes) -> int:
    return zlib.crc32(term) % WIDTH


def _sketch(counts: list[dict[bytes, int]], base: np.ndarray) -> np.ndarray:
    """WIDTH x documents: the largest impact of the document's terms at each coordinate."""
    sizes = [len(c) for c in counts]
    doc = np.repeat(np.arange(len(counts)), sizes)
    at = np.fromiter((zlib.crc32(t) for c in counts for t in c), np.int64, len(doc)) % WIDTH
    tf = np.fromiter((n for c in counts for n in c.values()), np.int64, len(doc))
    sketch = np.zeros((WIDTH, len(counts)), np.int32)  # an impact is below a million
    np.maximum.at(sketch.reshape(-1), at * len(counts) + doc, ((1_000_000_000 * tf) // (1000 * tf + base[doc])).astype(np.int32))
    return sketch


def _search(queries, weights, docs: int, length: int, best: int):
    def run(batches):
        block = _Queries(queries, weights, best)
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for i in range(0, len(ids), PART):
                found = [(d, ts) for d, t in zip(ids[i : i + PART], texts[i : i + PART]) if (ts := terms(t))]
                if found:
                    base = np.array([8 * (25 + 75 * len(ts) * docs // length) for _, ts in found], np.int64)
                    block.search([d for d, _ in found], [Counter(ts) for _, ts in found], base)
        rows = [(q, None if null else d, -score) for q, hits in enumerate(block.hits) for score, null, d in hits]
        cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["query", "doc_id", "score"])

    return run


def blocks(items: DataFrame, most: int = BLOCK) -> Iterator[list[tuple]]:
    """(item_id, counts of the item's terms) in blocks of ``most`` terms; the driver holds one block at a time."""
    block, size = [], 0
    for r in items.toLocalIterator():
        count = Counter(terms(r["text"]))
        if block and size + len(count) > most:
            yield block
            block, size = [], 0
        block.append((r["item_id"], dict(count)))
        size += len(count)
    if block:
        yield block


def rank(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", best: int = BEST, block: int = BLOCK) -> DataFrame:
    """The ``best`` highest-scoring documents of each item: item_id, rank (from 1), doc_id, score.

    Scores above 0 only; equal ones by ascending doc_id, null ids last, repeated
    rows of an id as documents of their own. A null or empty text has no terms: as
    a document it counts nowhere, as an item it finds nothing. Repeated items are
    ranked one by one. Without documents or items there are no rows. Texts are
    read whole; other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").cast("binary").alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    with small_batches(spark):
        for k, queries in enumerate(blocks(asked, block)):
            out = out.unionByName(scratch.save(_rank_block(d, queries, best), f"block{k}"))
    return out


def _rank_block(d: DataFrame, queries: list[tuple], best: int) -> DataFrame:
    spark = d.sparkSession
    vocabulary = frozenset(t for _, q in queries for t in q)  # BLOCK terms at most, or those of one item
    counted = d.mapInArrow(_count(vocabulary), "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {bytes(r["term"]): r["n"] for r in counted.collect()}
    docs, length = found.pop(b"", 0), found.pop(b" ", 0)
    weights = {t: weight(df, docs) for t, df in found.items()}
    hits = d.mapInArrow(_search([q for _, q in queries], weights, docs, length, best), "query int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id")
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    names = spark.createDataFrame(pa.table([pa.array(range(len(queries)), pa.int32()), pa.array([i for i, _ in queries], pa.int64())], names=["query", "item_id"]))
    return hits.join(names, "query").select("item_id", "rank", "doc_id", "score")
