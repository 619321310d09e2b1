"""Lexicon operators over a text column (C1, G2-G4 as table operators).

The theta join "text contains term" is done in one of two ways, with equal
results. A lexicon of up to ``HELD`` rows is read on the driver and given to the
matcher that every task holds: one projection per row, an ``explode`` of the
numbers of the matched terms and an equi-join with the lexicon's rows. A larger
one stays a table: a term of up to ``GRAM`` characters is posted under itself, a
longer one under that of its grams that the fewest terms hold. Texts give those of
their distinct grams that may be posted, an equi-join finds the terms, and ``contains``
confirms the longer ones. Neither is a cross join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import BEFORE, BEHIND, TermIndex, session_engine, with_term_flags
from ..functions.text import normalise_text
from ..session import spread, written

HELD = 100_000  # rows of a lexicon that the tasks hold; a larger one is joined by q-grams
GRAM = 8  # characters of a gram at most: all of a term's, if it has no more
HELD_CHARS = 8_000_000  # characters of the terms of a broadcast lexicon
SLOTS = 1 << 22  # bits that say which grams may be posted, whatever the lexicon's size


def collect_lexicon(lexicon: DataFrame) -> list[tuple[str | None, str, str]] | None:
    """(version, name, term) rows in (version, name, ordinal) order, or None if there are more than HELD.
    A table without ``version`` is one version, null."""
    small = _entries(lexicon, "ordinal").limit(HELD + 1).collect()
    if len(small) > HELD:
        return None
    rows = sorted(small, key=lambda r: (r["version"] or "", r["lexicon"], r["ordinal"]))
    return [(r["version"], r["lexicon"], r["term"]) for r in rows]


def _entries(lexicon: DataFrame, *more: str) -> DataFrame:
    version = F.col("version") if "version" in lexicon.columns else F.lit(None).cast("string").alias("version")
    return lexicon.select(version, F.col("name").alias("lexicon"), "term", *more).where("term IS NOT NULL")


def lexicon_matches(df: DataFrame, lexicon: DataFrame, text: str = "comment_text",
                    key: str = "id", engine: str | None = None, word_boundary: bool = False) -> DataFrame:
    """One row (key, version, lexicon, term) per lexicon term contained in a text, with
    ``word_boundary`` only where no letter or digit stands next to it."""
    entries = collect_lexicon(lexicon)
    if entries is None:
        return gram_matches(df, lexicon, text, key, word_boundary)
    idx = TermIndex([t for *_, t in entries], engine=session_engine(df, engine), word_boundary=word_boundary)
    d = with_term_flags(spread(df.select(key, text)), text, idx)
    found = d.select(key, F.explode(idx.hits().places()).alias("__place"))
    # from Arrow, so that Spark knows the table's size and broadcasts it if that is small
    versions, names, terms = zip(*entries) if entries else ((), (), ())
    table = df.sparkSession.createDataFrame(pa.table({
        "__at": pa.array([idx.place[t] for t in terms], pa.int32()), "version": pa.array(versions, pa.string()),
        "lexicon": pa.array(names, pa.string()), "term": pa.array(terms, pa.string())}))
    return found.join(table, F.col("__place") == F.col("__at")).select(key, "version", "lexicon", "term")


def term_counts(df: DataFrame, lexicon: DataFrame, text: str = "comment_text",
                key: str = "id", engine: str | None = None, word_boundary: bool = False) -> DataFrame:
    """G2 per lexicon: one count column each, ``n_<name>``, or ``n_<version>_<name>``
    where the table holds several versions."""
    entries = collect_lexicon(lexicon)
    if entries is None:
        return gram_counts(df, lexicon, text, key, word_boundary)
    idx = TermIndex([t for *_, t in entries], engine=session_engine(df, engine), word_boundary=word_boundary)
    d = with_term_flags(spread(df.select(key, text)), text, idx)
    h = idx.hits()
    lists: dict[tuple, list[str]] = {}
    for v, n, t in entries:
        lists.setdefault((v, n), []).append(t)
    cols = [h.count(list(dict.fromkeys(ts))).alias(c) for c, ts in zip(_names(lists), lists.values())]
    return d.select(key, *cols)


def _names(lists) -> list[str]:
    several = len({v for v, _ in lists}) > 1
    return [f"n_{v}_{n}" if several else f"n_{n}" for v, n in lists]


# ---- lexicons of any size -------------------------------------------------------


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters of a text that has so many."""
    at = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(n))))


def _texts(df: DataFrame, text: str, *more: str) -> DataFrame:
    """``__lt``: the normalised lower-cased text, ``__fp``: 128 bits that stand for it in shuffles."""
    d = df.select(*more, F.lower(normalise_text(F.coalesce(F.col(text), F.lit("")))).alias("__lt"))
    return d.withColumn("__fp", F.struct(F.xxhash64("__lt").alias("a"), F.xxhash64(F.lit("second"), "__lt").alias("b")))


_PLACE = np.random.default_rng(8).integers(1, 1 << 31, GRAM + 1, np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = np.uint32(33 - SLOTS.bit_length())


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _slots(chars: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """For each of ``lengths`` that the text has, the slots (0 to SLOTS - 1) of its runs of so many characters."""
    out, total = [], np.zeros(len(chars), np.uint32)
    for n in range(1, min(len(chars), max(lengths, default=0)) + 1):
        total = total[: len(chars) - n + 1] + (chars[n - 1 :] + np.uint32(1)) * _PLACE[n - 1]
        if n in lengths:
            out.append(((total ^ (total >> np.uint32(15))) * _PLACE[-1]) >> _SHIFT)
    return out


def _held_grams(text: str, lengths: list[int], held: np.ndarray, last: np.ndarray) -> set[str]:
    """The distinct runs of ``lengths`` characters whose slots are ``held``. ``last`` is room for 65,536 numbers."""
    chars = _chars(text)
    slots = _slots(chars, lengths)
    if not slots:
        return set()
    slot = np.concatenate(slots)
    hit = np.flatnonzero(held.take(slot))
    end = np.cumsum([len(x) for x in slots])
    of = np.searchsorted(end, hit, side="right")
    n, at = np.array(lengths)[of], hit - np.append(0, end)[of]
    # of equal runs one is cut out: each is held against the last in its slot
    place, key = np.arange(len(hit)), slot[hit] & np.uint32(0xFFFF)
    last[key] = place
    other = last[key]
    same, chars = n == n[other], np.append(chars, np.zeros(GRAM, np.uint32))
    for k in range(GRAM):
        same &= (n <= k) | (chars.take(at + k) == chars.take(at.take(other) + k))
    once = (place == other) | ~same
    return {text[i : i + m] for i, m in zip(at[once].tolist(), n[once].tolist())}


def _number_grams(batches):
    """__term, __gram -> __term, __gram, __slot."""
    for b in batches:
        n = [int(_slots(_chars(g), [len(g)])[0][0]) for g in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["__term", "__gram", "__slot"])


def _text_grams(lengths: list[int], bits: bytes, column: int):
    """Rows with a text in ``column`` -> the same rows and the distinct grams of the text whose slots ``bits`` holds."""

    def run(batches):
        held = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").view(bool)
        last = np.zeros(1 << 16, np.int64)
        for b in batches:
            found, end = [], [0]
            for t in b.column(column):
                found += _held_grams(t.as_py() or "", lengths, held, last)
                end.append(len(found))
            grams = pa.ListArray.from_arrays(pa.array(end, pa.int32()), pa.array(found, pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, grams], names=[*b.schema.names, "__grams"])

    return run


def _posted(entries: DataFrame) -> tuple[DataFrame, list[int]]:
    """(__term, __gram, __slot) with each term under that of its grams which the fewest terms
    hold, and the lengths of these grams. The table, one row a term, is written."""
    empty = F.when(F.length("__term") == 0, F.raise_error(F.lit("empty term")).cast("boolean")).otherwise(True)
    terms = entries.select(F.col("term").alias("__term")).where(empty).distinct()
    of_term = F.when(F.length("__term") <= GRAM, F.array("__term")).otherwise(_grams(F.col("__term"), GRAM))
    grams = terms.select("__term", F.explode(of_term).alias("__gram"))
    frequent = grams.groupBy("__gram").agg(F.count(F.lit(1)).alias("__n"))
    rarest = grams.join(frequent, "__gram").groupBy("__term").agg(F.min(F.struct("__n", "__gram")).alias("m"))
    posted = rarest.select("__term", F.col("m.__gram").alias("__gram")).mapInArrow(_number_grams, "__term string, __gram string, __slot long")
    posted = written(posted, "grams")
    lengths = [r[0] for r in posted.select(F.length("__gram")).distinct().collect()]  # GRAM rows at most
    return posted, sorted(lengths)


def _with_grams(texts: DataFrame, posted: DataFrame, lengths: list[int]) -> DataFrame:
    """``texts`` and ``__grams``: their distinct grams that may be posted. A bit map of fixed
    size says which may; a gram that it lets pass wrongly meets no posting."""
    slot = F.col("__slot") + 1  # the bit map functions count from 1
    parts = posted.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    bits = bytearray(SLOTS // 8)
    for r in parts.collect():  # 4 KB each, SLOTS bits at most
        at = (r["part"] - 1) * len(r["bits"])
        bits[at : at + len(r["bits"])] = r["bits"]
    schema = T.StructType([*texts.schema.fields, T.StructField("__grams", T.ArrayType(T.StringType()))])
    return texts.mapInArrow(_text_grams(lengths, bytes(bits), texts.columns.index("__lt")), schema)


def _found(texts: DataFrame, entries: DataFrame, few: bool, word_boundary: bool) -> DataFrame:
    """``texts`` with each distinct term of ``entries`` that they hold, ``__term``.

    Postings of a lexicon that is ``few`` are broadcast and meet the grams beside their text.
    Otherwise candidates are found by joining grams alone, and equal texts are one candidate.
    """
    posted, lengths = _posted(entries)
    held, posted = _with_grams(texts, posted, lengths), posted.drop("__slot")
    if few:
        pairs = held.select(*texts.columns, F.explode("__grams").alias("__gram")).join(F.broadcast(posted), "__gram")
        # a short term is its own gram, so the text holds it
        sure = F.lit(False) if word_boundary else F.length("__term") <= GRAM
        return pairs.where(sure | _holds(word_boundary)).select(*texts.columns, "__term")
    candidates = held.select("__fp", F.explode("__grams").alias("__gram")).join(posted, "__gram").select("__fp", "__term").distinct()
    return texts.join(candidates, "__fp").where(_holds(word_boundary)).select(*texts.columns, "__term")


def _few(entries: DataFrame) -> bool:
    """Whether the tasks can hold the lexicon."""
    r = entries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    return r["n"] <= HELD and r["chars"] <= HELD_CHARS


def _holds(word_boundary: bool) -> Column:
    """Whether ``__lt`` holds ``__term``."""
    if not word_boundary:
        return F.contains("__lt", "__term")
    quoted = F.concat(F.lit("\\Q"), F.replace("__term", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.contains("__lt", "__term") & F.rlike("__lt", F.concat(F.lit(BEFORE), quoted, F.lit(BEHIND)))


def gram_matches(df: DataFrame, lexicon: DataFrame, text: str = "comment_text", key: str = "id", word_boundary: bool = False) -> DataFrame:
    """C1 by an inverted q-gram join, for a lexicon of any size; one of more than ``HELD`` rows
    stays a table of the executors."""
    entries = written(_entries(lexicon), "lexicon")
    few = _few(entries)
    found = _found(_texts(df, text, key), entries, few, word_boundary)
    entries = F.broadcast(entries) if few else entries
    return found.join(entries, F.col("__term") == F.col("term")).select(key, "version", "lexicon", "term")


def gram_counts(df: DataFrame, lexicon: DataFrame, text: str = "comment_text", key: str = "id", word_boundary: bool = False) -> DataFrame:
    """``term_counts`` for a lexicon of any size; its names, which become columns, are collected."""
    entries = written(_entries(lexicon).distinct(), "lexicon")
    texts = _texts(df, text, key)
    sure = _found(texts.drop(key), entries, _few(entries), word_boundary).select("__fp", "__term").distinct()
    lists = [(r["version"], r["lexicon"]) for r in entries.select("version", "lexicon").distinct().orderBy("version", "lexicon").collect()]
    cols = _names(lists)
    mine = [F.col("version").eqNullSafe(F.lit(v)) & (F.col("lexicon") == n) for v, n in lists]
    n = sure.join(entries, F.col("__term") == F.col("term")).groupBy("__fp").agg(*[F.count_if(m).alias(c) for m, c in zip(mine, cols)]) if lists else sure
    out = texts.join(n, "__fp", "left")
    return out.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])
