"""Best-fit packing of token sequences by exact-complement hashing.

Only a piece's length matters for where it fits, so packing is worked out on the
table of lengths (at most ``capacity`` rows, whatever the input): the longest
piece left opens a sequence; its gap is looked up among the lengths, the sums of
two and the sums of three lengths still available; a combination that fills it
exactly is used as often as its pieces last. If none fills it, the longest piece
that fits (best fit) is put in and the rest of the gap looked up again. What
comes out is a list of patterns (lengths and how often), at most a few thousand.
Pieces are then numbered within their length, without a global sort, and the
number says which copy of which pattern a piece belongs to.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slantscan.llm.common import Scratch, text_batches

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END_OF_TEXT = "<|endoftext|>"
RANK_GROUP = 20_000  #: pieces of one length numbered in one group on average


class TokenBytes:
    """Ids of texts as little-endian 32-bit bytes.

    The vocabulary and its merge ranks come from the tokenizer file itself.
    Texts are encoded whole, into an array: to look words up in a memory of ids
    costs more, as texts hold many different words. Tests hold the ids against
    the ``tokenizers`` library.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def token_bytes(name: str) -> TokenBytes:
    return TokenBytes(public_tokenizers.path(name) if "/" not in name else name)


def _pieces(tokenizer: str, capacity: int):
    def run(batches):
        enc = token_bytes(tokenizer)
        for b in batches:
            doc, num, start, length, crc = [], [], [], [], []
            for k, t in enumerate(b.column(1)):
                ids = enc.encode(t.as_py() or "") + b"\0\0\0\0"
                n = len(ids) // 4
                cut = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for p, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    doc.append(k)
                    num.append(p)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[4 * s : 4 * e]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc, pa.int64())), pa.array(num, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def patterns(count: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, number of such sequences), using up ``count``."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in count.items():
        left[length] = n
    out = []
    while left.any():
        held = [int(np.flatnonzero(left)[-1])]
        gap = capacity - held[0]
        while gap:
            left_now = left.copy()
            for x in held:
                left_now[x] -= 1
            fill = _exact(left_now, gap)
            if fill:
                held += fill
                break
            fits = np.flatnonzero(left_now[: gap + 1] > 0)
            if not len(fits):
                break
            held.append(int(fits[-1]))
            gap -= held[-1]
        need = np.bincount(held, minlength=capacity + 1)
        times = int((left[need > 0] // need[need > 0]).min())
        left -= times * need
        out.append((held, times))
    return out


def _exact(left: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths that sum to the gap, the longest first."""
    if left[gap] > 0:
        return [gap]
    pair = _pair(left, gap)
    if pair:
        return pair
    for a in np.flatnonzero(left[:gap] > 0)[::-1]:
        a = int(a)
        if 3 * a < gap:
            return None
        left[a] -= 1
        pair = _pair(left, gap - a, a)
        left[a] += 1
        if pair:
            return [a, *pair]
    return None


def _pair(left: np.ndarray, gap: int, most: int | None = None) -> list[int] | None:
    """The pair with the longest length (at most ``most``) that sums to the gap."""
    if gap < 2:
        return None
    a = np.arange((gap + 1) // 2, min(gap - 1, most or gap) + 1)
    ok = (left[a] > 0) & (left[gap - a] > 0) & ((2 * a != gap) | (left[a] > 1))
    a = a[ok]
    return [int(a[-1]), gap - int(a[-1])] if len(a) else None


def _slots(found: list[tuple[list[int], int]]) -> pd.DataFrame:
    """Where the pieces of a length numbered from 0 go: rank_from on, sequence
    and offset of the first, by length and rank_from."""
    rows, used, base = [], {}, 0
    for held, times in found:
        offset = 0
        for length in held:
            rows.append((length, used.get(length, 0), base, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        base += times
    return pd.DataFrame(rows, columns=["length", "rank_from", "sequence", "offset"]).sort_values(["length", "rank_from"], ignore_index=True)


def _place(slots: pd.DataFrame):
    key = slots["length"].to_numpy() * (1 << 48) + slots["rank_from"].to_numpy()
    rank_from, sequence, offset = (slots[c].to_numpy() for c in ("rank_from", "sequence", "offset"))

    def run(frames):
        for f in frames:
            at = np.searchsorted(key, f["length"].to_numpy() * (1 << 48) + f["rank"].to_numpy(), side="right") - 1
            f["sequence_id"] = sequence[at] + f["rank"].to_numpy() - rank_from[at]
            f["offset"] = offset[at]
            yield f.drop(columns="rank")

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens.

    A document is its text's ids (null text: none) and the end id 0. Longer ones
    are cut into pieces of ``capacity``, the first of which may be shorter. One
    row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Repeated rows and rows with a null id are documents of their own. An empty
    table gives no rows. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = rows.mapInArrow(_pieces(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = scratch.save(pieces, "pieces")
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots = _slots(patterns(lengths, capacity))

    # Number the pieces of each length: groups of bounded size, offset by the groups before them.
    groups = max(1, -(-max(lengths.values(), default=1) // RANK_GROUP))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    pieces = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(groups)).cast("int"))
    sizes = pieces.groupBy("length", "g").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sizes = scratch.save(sizes.select("length", "g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "sizes")
    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("length", "g").orderBy(*order)))
    ranked = ranked.join(sizes, ["length", "g"]).withColumn("rank", F.expr("base + r - 1"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInPandas(_place(slots), schema)
