"""Document quality by hierarchical empirical Bayes.

A document classifier (logistic regression on a text's form) gives each document
its evidence. Its expected share of good documents is summed by path and by
host; a host's share shrinks toward the global one and a path's toward its
host's, the less the more documents there are and the more hosts (paths) differ.
The path's share, less the document's own part in it, is the prior that its evidence
is weighed against.

The classifier is fitted on a bounded sample of labelled rows; the counts cover
all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantscan.llm.common import Scratch, text_batches

SAMPLE = 20_000  #: labelled rows, on average, that the classifier is fitted on at most
RIDGE = 1e-2
LEAST = 0.3  #: probability of being good that a document needs
FEATURES = ("symbols", "shouting", "upper", "repeats", "bars", "digits", "mean_word", "word_spread", "sentences", "distinct", "log_words")

_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in "#$%&*^~<>{}[]=@\\_+`"]] = 1
_KIND[ord("!")] = 2
_KIND[65:91] = 3
_KIND[97:123] = 4
_KIND[48:58] = 5
_KIND[ord("|")] = 6
_KIND[[ord(c) for c in ".,;:?"]] = 7
_KIND[[32, *range(9, 14)]] = 8
_KIND[128:] = 4


def features(text: str | None) -> list[float]:
    """Form of the whole text; zeros without words."""
    b = (text or "").encode("utf-8", "replace")
    words = b.split()
    if not words:
        return [0.0] * len(FEATURES)
    kind = np.bincount(_KIND[np.frombuffer(b, np.uint8)], minlength=9)
    ink, letters, n = len(b) - kind[8], max(1, kind[3] + kind[4]), len(words)
    size = np.fromiter(map(len, words), np.float64, n)
    same = sum(map(bytes.__eq__, words[1:], words))
    return [
        kind[1] / ink,
        kind[2] / ink,
        kind[3] / letters,
        same / n,
        kind[6] / n,
        kind[5] / ink,
        min(size.mean(), 50.0) / 10,
        min(size.std(), 50.0) / 10,
        kind[7] / n,
        len(set(words)) / n,
        float(np.log1p(n)) / 10,
    ]


def fit(x: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Ridge logistic regression by Newton steps: (mean, scale, weights with the
    bias last, log odds of the labels)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + RIDGE * np.append(w[:-1], 0)
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    share = (y.sum() + 1) / (len(y) + 2)
    return mean, scale, w, float(np.log(share / (1 - share)))


class Classifier:
    """Evidence of a text: its log odds of being good, less those of the labels."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE):
        lab = labels.select(F.col("doc_id").alias("label_id"), F.col(label_col).cast("double").alias("y")).where("label_id IS NOT NULL AND y IS NOT NULL")
        lab = lab.groupBy("label_id").agg(F.max("y").alias("y"))  # a repeated label counts once
        n = lab.count()
        if n > sample:
            lab = lab.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < int(sample / n * (1 << 20)))
        rows = docs.select(F.col(id_col).alias("id"), _features(F.col(text_col)).alias("f")).where(F.col("id").isNotNull())
        once = rows.join(lab, F.col("id") == F.col("label_id")).groupBy("id", "y").agg(F.min("f").alias("f"))  # a repeated id counts once
        got = once.select("f", "y").collect()  # ``sample`` rows
        y = np.array([r["y"] for r in got])
        self.mean, self.scale, self.w, self.base = np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES) + 1), 0.0
        self.share = 0.5
        if len(y) and y.min() < y.max():
            self.mean, self.scale, self.w, self.base = fit(np.array([r["f"] for r in got]), y)
            self.share = float((y.sum() + 1) / (len(y) + 2))
        elif len(y):
            self.share = float((y.sum() + 1) / (len(y) + 2))

    def column(self, text: Column) -> Column:
        mean, scale, w, base = self.mean, self.scale, self.w, self.base

        @F.arrow_udf("double")
        def evidence(t: pa.Array) -> pa.Array:
            x = np.array([features(v.as_py()) for v in t]).reshape(-1, len(FEATURES))
            return pa.array(((x - mean) / scale) @ w[:-1] + w[-1] - base)

        return evidence(text)


def _features(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def form(t: pa.Array) -> pa.Array:
        return pa.array([features(v.as_py()) for v in t], pa.list_(pa.float64()))

    return form(text)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))


def _strength(groups: DataFrame) -> float:
    """How many documents a prior weighs: by moments, from how far shares of
    groups (good, n, above: the share they shrink toward) spread beyond chance."""
    r = groups.where("n >= 2").agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("above"), 2)).alias("spread"),
        F.sum(F.col("above") * (1 - F.col("above"))).alias("chance"),
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
    ).first()
    if not r["k"]:
        return 50.0
    between = max(1e-6, (r["spread"] - r["chance"]) / r["n"])
    return float(min(1e4, max(2.0, r["chance"] / r["k"] / between - 1)))


def site_priors(scored: DataFrame, share: float, scratch: Scratch) -> DataFrame:
    """(host, path, p) -> a row per host and path: prior of a good document there, and
    the counts and strengths that it is made of, for ``without_own``."""
    paths = scratch.save(scored.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count("*").alias("n")), "paths")
    total = paths.agg(F.sum("good"), F.sum("n")).first()
    every = {"sum_good": float(total[0] or 0.0) + 10 * share, "sum_n": float(total[1] or 0) + 10}
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).withColumn("above", F.lit(every["sum_good"] / every["sum_n"]))
    hosts = scratch.save(hosts, "hosts")
    host_m = _strength(hosts)
    prior = (F.col("good") + host_m * F.col("above")) / (F.col("n") + host_m)
    hosts = hosts.select(F.col("host").alias("host1"), prior.alias("above"), F.col("good").alias("host_good"), F.col("n").alias("host_n"))
    paths = paths.join(scratch.save(hosts, "host_shares"), F.col("host").eqNullSafe(F.col("host1")))
    paths = scratch.save(paths.drop("host1"), "path_counts")
    m = _strength(paths)
    prior = (F.col("good") + m * F.col("above")) / (F.col("n") + m)
    fixed = {**every, "host_m": host_m, "path_m": m}
    cols = [F.col("host").alias("host1"), F.col("path").alias("path1"), prior.alias("prior"), "good", "n", "host_good", "host_n"]
    return scratch.save(paths.select(*cols, *[F.lit(x).alias(c) for c, x in fixed.items()]), "priors")


def without_own(p: Column) -> Column:
    """The prior of a row of ``site_priors`` without a document's own share ``p``, which its
    evidence counts already: a site of one document says nothing about it."""
    every = (F.col("sum_good") - p) / (F.col("sum_n") - 1)
    host = (F.col("host_good") - p + F.col("host_m") * every) / (F.col("host_n") - 1 + F.col("host_m"))
    return (F.col("good") - p + F.col("path_m") * host) / (F.col("n") - 1 + F.col("path_m"))


def _prepared(docs, labels, id_col, text_col, host_col, path_col, label_col, keep_row: bool):
    scratch = Scratch(docs.sparkSession)
    text_batches(docs.sparkSession)
    model = Classifier(docs, labels, id_col, text_col, label_col)
    cols = [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    cols += [(F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")).alias(a) for c, a in ((host_col, "host"), (path_col, "path"))]
    if keep_row:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # each text is scored once, for the sites and for itself; rows that are to be kept are written with their scores
    d = scratch.save(docs.select(*cols).withColumn("evidence", model.column(F.col("text"))).drop("text"), "scored", texts=keep_row)
    log_share = float(np.log(model.share / (1 - model.share)))
    own = _sigmoid(F.col("evidence") + log_share)
    scored = d.select("host", "path", own.alias("p"))
    priors = site_priors(scored, model.share, scratch)
    same = F.col("host").eqNullSafe(F.col("host1")) & F.col("path").eqNullSafe(F.col("path1"))
    j = d.join(priors, same, "left").withColumn("site_prior", F.coalesce(without_own(own), F.lit(model.share)))
    edge = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("site_prior")))
    return j.withColumn("score", _sigmoid(F.col("evidence") + _logit(edge))).withColumn("kept", F.col("score") >= LEAST)


def classify(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", host_col="source", path_col="lang", label_col="quality") -> DataFrame:
    """One row per row of ``docs``: doc_id, evidence, site_prior, score, kept.

    ``labels`` (doc_id, label_col of 0 and 1) name some documents. Texts that are
    null, empty or without words have the form of no words and are scored by it
    and their site. Null hosts and paths are groups of their own. Without labels,
    or with one kind only, evidence is 0 and the site's prior decides. Repeated
    rows and null ids are rows like others (a repeated label counts once, and the
    classifier is fitted on one row of each labelled id). An empty table gives no rows. Extra columns are not looked at.
    """
    return _prepared(docs, labels, id_col, text_col, host_col, path_col, label_col, False).select("doc_id", "evidence", "site_prior", "score", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", host_col="source", path_col="lang", label_col="quality") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, as they were."""
    return _prepared(docs, labels, id_col, text_col, host_col, path_col, label_col, True).where("kept").select("row.*")
