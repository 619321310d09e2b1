"""Multi-pattern substring matching for large lexicons (Arrow batches).

Spark has no multi-pattern search: ``contains`` scans the text once per term
(about 15 ns per byte and term on Spark 4.1) and one alternation regex is
interpreted per position. An Aho-Corasick automaton finds every term in one
pass. This helper runs it inside an iterator Arrow UDF: the automaton is
built once per task, text arrives in Arrow batches, and the result is one
bitmap per row that all features read JVM-side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITMAP = T.ArrayType(T.LongType(), False)


def text_bits_udf(terms: Sequence[str], bits: int, out: str, raw_out: str | None = None,
                  low_out: str | None = None, keep: Sequence[str] = (), word_boundary: bool = False):
    """Arrow UDF: raw text -> struct of

    * ``out``: bitmap of the terms in the normalised lower-cased text; term
      ``i`` is bit ``i % bits`` of element ``i // bits``;
    * ``raw_out`` (if named): the same for the raw lower-cased text;
    * ``low_out`` (if named): the normalised lower-cased text where it holds
      a term of ``keep``, else the empty string.

    With ``word_boundary`` a term counts where neither the character before it nor
    that behind it is a letter or a digit.

    Normalisation is Python's own ``' '.join(text.split())`` followed by
    ``lower()`` (the published semantics); the JVM engines emulate it with
    ``functions.text.WS_CLASS``. Missing text is the empty string. The function
    is self-contained (imports inside, no module globals), so it is shipped by
    value; workers need numpy, pyarrow and pyahocorasick and fail without them.
    """
    terms = tuple(terms)
    width = -(-len(terms) // bits)
    kept = frozenset(i for i, t in enumerate(terms) if t in set(keep))
    many = frozenset(i for i, t in enumerate(terms) if " " in t)  # may be split over lines in the raw text
    fields = [T.StructField(out, BITMAP, False)]
    if raw_out:
        fields.append(T.StructField(raw_out, BITMAP, False))
    if low_out:
        fields.append(T.StructField(low_out, T.StringType(), False))
    names = [f.name for f in fields]

    @F.arrow_udf(T.StructType(fields))
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick
        import numpy
        import pyarrow

        automaton = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            automaton.add_word(t, i)
        automaton.make_automaton()
        mask = 2 ** (numpy.arange(len(terms), dtype="int64") % bits)

        def bitmaps(sets):
            n = len(sets)
            ids = numpy.fromiter((i for s in sets for i in s), "int64")
            rows = numpy.repeat(numpy.arange(n), [len(s) for s in sets])
            words = numpy.zeros(n * width, dtype="int64")
            numpy.bitwise_or.at(words, rows * width + ids // bits, mask[ids])
            ends = numpy.arange(0, n * width + 1, width, dtype="int32")
            return pyarrow.ListArray.from_arrays(pyarrow.array(ends), pyarrow.array(words))

        sizes = [len(t) for t in terms]

        def free(low, start, stop):
            return not (start and low[start - 1].isalnum()) and not low[stop : stop + 1].isalnum()

        def hits(low):
            if not word_boundary:
                return {i for _, i in automaton.iter(low)}
            return {i for at, i in automaton.iter(low) if free(low, at + 1 - sizes[i], at + 1)}

        def holds(low, term):
            at = low.find(term)
            while word_boundary and at >= 0 and not free(low, at, at + len(term)):
                at = low.find(term, at + 1)
            return at >= 0

        for texts in batches:
            sets, raw_sets, lows = [], [], []
            for value in texts:
                text = value.as_py() or ""
                norm = " ".join(text.split())
                low = norm.lower()
                found = hits(low)
                sets.append(found)
                if raw_out:
                    if text != norm and not found.isdisjoint(many):
                        # a multi-word term in the raw text is also in the
                        # normalised one: only those found there need a look
                        raw_low = text.lower()
                        found = {i for i in found if i not in many or holds(raw_low, terms[i])}
                    raw_sets.append(found)
                if low_out:
                    lows.append("" if sets[-1].isdisjoint(kept) else low)
            columns = [bitmaps(sets)]
            if raw_out:
                columns.append(bitmaps(raw_sets))
            if low_out:
                columns.append(pyarrow.array(lows, pyarrow.string()))
            yield pyarrow.StructArray.from_arrays(columns, names=names)

    return match
