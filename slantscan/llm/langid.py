"""Language identification by Bayesian evidence fusion.

A text gives each language the likelihood of its letter trigrams. To it come
what the markup declares (weighed by how often declarations agree with texts)
and a prior of the address: counts of text-only decisions, summed by host and by
address suffix, shrink a host's shares toward its suffix's and those toward the
global ones. A document is rejected if it has no letters, if chance explains
them better than any language does, or if none reaches half of the posterior.

Every language that enough rows of the whole table declare has a trigram model,
trained on a bounded sample of its rows; every other count covers all rows.
Declarations are read as their primary subtag in lower case.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantscan.llm.common import Scratch, text_batches
from slantscan.llm.html_extract import text_of

SAMPLE = 20_000  #: rows, on average, that the trigram models are trained on; each language an equal part at most
LANGUAGE_ROWS = 200  #: rows, on average, that a language may have of them however many languages there are
LEAST_ROWS = 5  #: rows of the whole table that a language needs for a model of its own
HELD = 256  #: languages whose counts a task holds before it passes them on
ROW_WEIGHT = 2000  #: trigrams that a row of the sample weighs at most; all of its text is counted
BUCKETS = 1 << 14  #: hashed trigrams
TEMPER = 3.0  #: trigrams overlap: so many count as one observation
SHRINK = 20.0  #: documents that a prior weighs
ADDED = 0.5  #: added to a trigram's count
CHANCE = math.log(1 / 27**3)  #: of a trigram of letters and gaps drawn evenly
UNKNOWN = 0.01  #: prior of letters that belong to none of the languages
LEAST = 0.5  #: posterior that a language needs

# letters in lower case and all bytes of multi-byte characters; anything else is a gap
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of the text's letters; runs of other characters are one gap."""
    if not text:
        return np.zeros(0, np.int64)
    c = _CLASS[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    c = c[(c != 0) | (np.append(1, c[:-1]) != 0)].astype(np.uint32)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    h = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA6B) ^ c[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    return (h >> np.uint32(18)).astype(np.int64)


def _counts(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            t, g = total.setdefault(lang, np.zeros(BUCKETS)), trigrams(text.as_py())
            t += np.bincount(g, minlength=BUCKETS) * min(1.0, ROW_WEIGHT / max(1, len(g)))
            if len(total) >= HELD:
                yield from _flush(total)
                total = {}
    yield from _flush(total)


def _flush(total):
    for lang, t in total.items():
        k = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), lang, np.int32)), pa.array(k), pa.array(t[k])], names=["lang", "bucket", "n"])


class Model:
    """Trigram log likelihoods by language."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        total = counts.sum(axis=1, keepdims=True)
        self.table = np.log((counts + ADDED) / (total + ADDED * BUCKETS)).T.astype(np.float64)

    def score(self, text: str | None) -> np.ndarray:
        """Log likelihood by language, and last the number of trigrams."""
        t = trigrams(text)
        s = np.zeros(len(self.names))
        for k in range(0, len(t), 1 << 16):
            s += self.table[t[k : k + (1 << 16)]].sum(axis=0)
        return np.append(s, len(t))


def code(declared: Column) -> Column:
    """The primary subtag in lower case (en of EN, en-US, en_GB.UTF-8); null without one."""
    c = F.lower(F.regexp_extract(declared, r"^\s*([^\s_.,;:@-]+)", 1))
    return F.when(c != "", c)


def train(docs: DataFrame, text_col: str, declared_col: str, id_col: str, sample: int = SAMPLE) -> Model:
    """Models of the declared languages, each on all of its rows or a sample by hashed id and text."""
    d = docs.select(code(F.col(declared_col).cast("string")).alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, text_col).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = {r["lang"]: r["count"] for r in d.groupBy("lang").count().where(F.col("count") >= LEAST_ROWS).collect()}
    names = sorted(rows)
    if not names:
        return Model(names, np.zeros((0, BUCKETS)))
    most = max(LANGUAGE_ROWS, sample // len(names))
    below = F.array(*[F.lit(min(1 << 40, (most << 40) // rows[x])) for x in names])
    d = d.select((F.array_position(F.array(*map(F.lit, names)), F.col("lang")) - 1).cast("int").alias("lang"), "text", "h").where("lang >= 0")
    d = d.where(F.pmod("h", F.lit(1 << 40)) < below[F.col("lang")])
    c = d.select("lang", "text").mapInArrow(_counts, "lang int, bucket long, n double")
    c = c.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows a language at most
    counts = np.zeros((len(names), BUCKETS))
    counts[c.column("lang").to_numpy(), c.column("bucket").to_numpy()] = c.column("n").to_numpy()
    return Model(names, counts)


def scores(model: Model):
    """A column function: the text's scores."""

    @F.arrow_udf("array<double>")
    def score(text: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in text], pa.list_(pa.float64()))

    return score


def _let(value: Column, then) -> Column:
    """``then`` of ``value``, which is made once however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


class Evidence:
    """What is known beside the texts: address priors and the declarations' worth."""

    def __init__(self, docs: DataFrame, model: Model, scratch: Scratch, s: Column, declared: Column, host: Column, suffix: Column):
        self.names = model.names
        size = len(self.names)
        if not size:  # nothing to know
            return
        s = docs.select(s.alias("s"), declared.alias("declared"), host.alias("host"), suffix.alias("suffix"))
        s = s.withColumn("p", self._posterior("s", F.array(*[F.lit(0.0)] * size))).where(F.col("s")[size] > 0)
        sums = [F.sum(F.col("p")[k]).alias(f"p{k}") for k in range(size)]
        per = scratch.save(s.groupBy("declared", "host", "suffix").agg(*sums, F.count("*").alias("n")), "per_address")
        again = [F.sum(f"p{k}").alias(f"p{k}") for k in range(size)]
        whole = per.agg(*again).first()
        counts = np.array([whole[k] or 0.0 for k in range(size)])
        share = (counts + 1) / (counts.sum() + size)
        # how often a declaration goes with a text's language: declared by one of ``names`` only
        worth = np.full((size, size), 1.0)
        for r in per.where(F.col("declared").isin(self.names)).groupBy("declared").agg(*again).collect():
            worth[self.names.index(r["declared"])] += [r[f"p{k}"] or 0.0 for k in range(size)]
        self.worth = np.log(worth / worth.sum(axis=0, keepdims=True))
        glob = F.array(*[F.lit(float(x)) for x in share])
        counts = F.array(*[F.col(f"p{k}") for k in range(size)])
        by_suffix = per.groupBy("suffix").agg(*again).select(F.col("suffix").alias("suffix1"), counts.alias("of_suffix"))
        by_host = per.groupBy("host", "suffix").agg(*again).withColumnRenamed("host", "host1")
        by_host = by_host.join(scratch.save(by_suffix, "by_suffix"), F.col("suffix").eqNullSafe(F.col("suffix1")), "left")
        by_host = by_host.select("host1", F.col("suffix").alias("suffix2"), counts.alias("of_host"), "of_suffix")
        self.by_host = scratch.save(by_host, "by_host")
        self.share = glob

    @staticmethod
    def _shrunk(counts: Column, own: Column, above: Column) -> Column:
        """Shares of ``counts`` without a document's own part, shrunk toward ``above``."""
        rest = F.zip_with(counts, own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
        return _let(rest, lambda c: _let(_total(c) + SHRINK, lambda n: F.zip_with(c, above, lambda a, b: (a + SHRINK * b) / n)))

    def _posterior(self, s: str, more: Column) -> Column:
        """Softmax of the tempered text scores and other log evidence."""
        logs = F.zip_with(F.slice(F.col(s), 1, len(self.names)), more, lambda a, b: a / TEMPER + b)
        e = _let(logs, lambda x: _let(F.array_max(x), lambda top: F.transform(x, lambda y: F.exp(y - top))))
        return _let(e, lambda x: _let(_total(x), lambda n: F.transform(x, lambda y: y / n)))

    def decide(self, df: DataFrame, s: str, declared: Column, host: Column, suffix: Column) -> DataFrame:
        """Adds language, confidence and known to ``df``, whose column ``s`` holds scores."""
        size = len(self.names)
        if not size:
            return df.select("*", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("known"))
        j = df.join(self.by_host, host.eqNullSafe(F.col("host1")) & suffix.eqNullSafe(F.col("suffix2")), "left").drop("host1", "suffix2")
        rows = [[0.0] * size, *self.worth.tolist()]  # first that of no declaration, or of a language without a model
        worth = F.expr("array(" + ",".join("array(" + ",".join(f"{x!r}D" for x in r) + ")" for r in rows) + ")")
        worth = F.get(worth, F.coalesce(F.array_position(F.array(*map(F.lit, self.names)), declared), F.lit(0)).cast("int"))
        # a document's text counts in its own evidence, so not in the prior of its host and suffix
        j = j.withColumn("__own", self._posterior(s, F.array(*[F.lit(0.0)] * size)))
        prior = self._shrunk(F.col("of_host"), F.col("__own"), self._shrunk(F.col("of_suffix"), F.col("__own"), self.share))
        log_prior = F.transform(F.coalesce(prior, self.share), lambda x: F.log(x))
        p = self._posterior(s, F.zip_with(log_prior, worth, lambda a, b: a + b))
        j = j.withColumn("__p", p).withColumn("confidence", F.array_max("__p"))
        at = F.array_position("__p", F.col("confidence")).cast("int")
        j = j.withColumn("language", F.element_at(F.array(*map(F.lit, self.names)), at))
        beyond_chance = (F.element_at(F.col(s), at) - F.col(s)[size] * CHANCE) / TEMPER
        known = (F.col(s)[size] > 0) & (beyond_chance > math.log(UNKNOWN)) & (F.col("confidence") >= LEAST)
        j = j.withColumn("known", F.coalesce(known, F.lit(False)))
        return j.withColumn("language", F.when(F.col("known"), F.col("language"))).drop("__p", "__own", "of_host", "of_suffix")


def _name(df: DataFrame, column: str | None) -> Column:
    return F.col(f"`{column}`").cast("string") if column else F.lit(None).cast("string")


def identify(docs: DataFrame, id_col="doc_id", text_col="text", declared_col="lang", host_col="source", suffix_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, language, confidence, known.

    ``declared_col`` holds the language that the markup or metadata declare,
    ``host_col`` the host or source, ``suffix_col`` the address suffix, if any
    (``page_evidence`` gets them from pages). Null texts and texts without
    letters have no language: known false, language null. Null declarations say
    nothing; null hosts share one prior. Rows with a null id, and repeated rows,
    are rows like others. A language is the primary subtag of declarations in lower
    case. One that fewer than LEAST_ROWS rows declare has no model; without any
    model nothing is known. An empty table gives no rows. Extra columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    text_batches(docs.sparkSession)
    d = docs.select(*(_name(docs, c).alias(a) for c, a in ((text_col, "text"), (declared_col, "declared"), (host_col, "host"), (suffix_col, "suffix"))), F.col(id_col).alias("doc_id"))
    model = train(d, "text", "declared", "doc_id")
    # without the text a row is small: score it once, for the addresses and for itself
    d = scratch.save(d.withColumn("s", scores(model)("text")).drop("text"), "scored")
    known = Evidence(d, model, scratch, F.col("s"), code(F.col("declared")), F.col("host"), F.col("suffix"))
    out = known.decide(d, "s", code(F.col("declared")), F.col("host"), F.col("suffix"))
    return out.select("doc_id", "language", "confidence", "known")


def keep_known(docs: DataFrame, id_col="doc_id", text_col="text", declared_col="lang", host_col="source", suffix_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is known, with all their columns, as they were."""
    scratch = Scratch(docs.sparkSession)
    text_batches(docs.sparkSession)
    d = docs.select(
        *(_name(docs, c).alias(a) for c, a in ((text_col, "text"), (declared_col, "declared"), (host_col, "host"), (suffix_col, "suffix"))),
        F.col(f"`{id_col}`").alias("doc_id"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    model = train(d, "text", "declared", "doc_id")
    # the rows are written with their scores, which cost more than the copy: each text is scored once
    d = scratch.save(d.withColumn("s", scores(model)("text")).drop("text"), "scored", texts=True)
    known = Evidence(d, model, scratch, F.col("s"), code(F.col("declared")), F.col("host"), F.col("suffix"))
    return known.decide(d, "s", code(F.col("declared")), F.col("host"), F.col("suffix")).where("known").select("row.*")


def identify_pages(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """One row per row of ``pages``: page_id, language, confidence, known.

    The text is the page's main text; the markup declares the language, and the
    address gives host and suffix, so that a host's prior shrinks toward that of
    its suffix. A null page, or one without text, has no language; a null or odd
    address has no host, and such pages share one prior. An empty table gives no
    rows. Extra columns are not looked at.
    """
    scratch = Scratch(pages.sparkSession)
    text_batches(pages.sparkSession)
    p = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    p = page_evidence(p).select("page_id", "declared", "host", "suffix", text_of("html").alias("text"))
    p = scratch.save(p, "texts", texts=True)  # the pages are read and parsed once
    return identify(p, "page_id", "text", "declared", "host", "suffix").withColumnRenamed("doc_id", "page_id")


def page_evidence(pages: DataFrame, url_col="url", html_col="html") -> DataFrame:
    """Adds declared (the html element's lang), host and suffix (the host's last part) to pages."""
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    lang = F.lower(F.regexp_extract(F.col(html_col), r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return pages.select("*", F.when(lang != "", lang).alias("declared"), F.when(host != "", host).alias("host"), F.when(host.contains("."), F.substring_index(host, ".", -1)).alias("suffix"))
