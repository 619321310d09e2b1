"""Quality rules by weak supervision.

Each rule looks at one figure of a text's form and votes for good (1), for bad
(-1), or abstains (0). No rule decides alone: the rules are taken as
independent given the document's unknown quality, each with an accuracy, and
expectation-maximisation finds the accuracies and the share of good documents
from the votes alone. A document's posterior probability of being good replaces
"must pass all rules".

The votes of all documents are summed to one row for each pattern of votes (3 to
the number of rules at most), which is all that the estimation needs: it sees
every document, in a table whose size does not depend on how many there are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantscan.llm.common import Scratch, small_batches

LEAST_WORDS = 50  #: base rule: fewer words fail
REPEATED = 50  #: base rule: a larger percentage of repeated words fails
KEEP = 0.5  #: posterior probability of being good that a document needs
ROUNDS = 60  #: steps of the estimation
ACCURACY, SHARE, PRIOR = 0.8, 0.8, 10.0  #: what accuracies and the share of good start from, and the documents that this counts as

#: rule -> (part, whole, good, bad): the part as a percentage of the whole, or without a whole the part
#: itself, against the bounds of a vote for good and for bad. Most rules are alarms, with no vote for
#: good: that a text has no digits doesn't make it good.
RULES = {
    "length": ("n_words", None, ">= 100", "< 50"),
    "short_words": ("word_chars", "n_words", None, "< 250"),
    "long_words": ("word_chars", "n_words", None, "> 1500"),
    "symbols": ("n_symbols", "n_words", None, "> 10"),
    "odd": ("n_odd_words", "n_words", "<= 5", "> 20"),
    "marks": ("n_marks", "word_chars", "<= 8", "> 15"),
    "upper": ("n_upper", "word_chars", None, "> 30"),
    "shouts": ("n_shouts", "n_words", None, "> 20"),
    "digits": ("n_digits", "word_chars", None, "> 30"),
    "lines": ("n_dup_lines", "n_lines", None, "> 30"),
    "repeats": ("n_repeat_words", "n_words", None, "> 30"),
}
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_odd_words", "n_marks", "n_upper", "n_shouts", "n_digits")

_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_MARKS = [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]  #: visible ASCII beside letters and digits

_ODD = re.compile(rb"[!#$%&*+/<=>@\[\\\]^_`{|}~][^\x20\x09-\x0D]*")  #: from a word's first character of this kind to its end


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, each counted once."""
    n = len(words) - 2
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words))
    d = len(numbers)
    if d == len(words):
        return 0
    pairs = w[:-1] * d + w[1:]
    if d >= 1 << 21:  # three numbers don't fit into 63 bits: number the pairs
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * d + w[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    found = np.zeros(n, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : n + k] |= found
    return int(covered.sum())


def figures(text: bytes | None) -> tuple[int, ...]:
    """What FIGURES names, of the whole text (UTF-8). Words are runs of anything but
    space, tab, line feed, vertical tab, form feed and carriage return, at which bytes split."""
    if not text:
        return (0,) * len(FIGURES)
    words = text.split()
    kind = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - kind[128:192].sum() - kind[9:14].sum() - kind[32]  # code points that aren't blank
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        int(chars),
        int(kind[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(1 for _ in _ODD.finditer(text)),
        int(kind[_MARKS].sum()),
        int(kind[65:91].sum()),
        int(kind[ord("!")]),
        int(kind[48:58].sum()),
    )


def _figures(batches):
    for b in batches:
        rows = np.array([figures(t) for t in b.column("text").to_pylist()], np.int64).reshape(-1, len(FIGURES))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, rows.T)], names=["doc_id", *FIGURES])


def vote_sql(rule: str) -> str:
    """The vote of a rule: 1, -1 or 0. A whole of nothing abstains."""
    part, whole, good, bad = RULES[rule]
    p, w = (f"100 * {part}", whole) if whole else (part, "1")
    yes = f" WHEN {p} {good} * {w} THEN 1" if good else ""
    return f"CASE WHEN {w} = 0 THEN 0{yes} WHEN {p} {bad} * {w} THEN -1 ELSE 0 END"


def estimate(votes: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over patterns of votes (rows of ``votes``, found ``n`` times).

    A rule that votes is right with its accuracy, whatever the document's quality;
    an abstention says nothing. Returns the posterior of each pattern, the
    accuracies and the share of good documents. PRIOR documents that vote as
    expected keep good and bad from changing places and an accuracy from 0 and 1.
    """
    yes, no = (votes == 1).astype(float), (votes == -1).astype(float)
    right, share = np.full(votes.shape[1], ACCURACY), SHARE
    for _ in range(rounds):
        p = posterior(votes, right, share)
        right = ((n * p) @ yes + (n * (1 - p)) @ no + PRIOR * ACCURACY) / (n @ (yes + no) + PRIOR)
        share = ((n * p).sum() + PRIOR * SHARE) / (n.sum() + PRIOR)
    return posterior(votes, right, share), right, float(share)


def posterior(votes: np.ndarray, right: np.ndarray, share: float) -> np.ndarray:
    return 1 / (1 + np.exp(-(np.log(share / (1 - share)) + votes @ np.log(right / (1 - right)))))


def judge(docs: DataFrame, id_col="doc_id", text_col="text", keep: float = KEEP) -> DataFrame:
    """A row per row of ``docs``: doc_id, FIGURES, a column ``vote_<rule>`` for each
    rule, posterior, base_failed and kept.

    ``base_failed``: fewer than LEAST_WORDS words, or more than REPEATED percent of
    them repeated. ``kept``: not failed, and a posterior of ``keep`` or more. A
    null or empty text has no words and fails; repeated rows and null ids are
    judged row by row; an empty table gives none. Texts are read whole. Other
    columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    schema = f"doc_id {dict(d.dtypes)['doc_id']}, " + ", ".join(f"{c} long" for c in FIGURES)
    d = d.mapInArrow(_figures, schema).select("*", *[F.expr(vote_sql(r)).cast("tinyint").alias(f"vote_{r}") for r in RULES])
    with small_batches(spark):
        d = scratch.save(d, "votes")
    names = [f"vote_{r}" for r in RULES]
    seen = d.groupBy(*names).count().collect()  # 3 ** len(RULES) rows at most
    votes = np.array([r[: len(names)] for r in seen], float).reshape(-1, len(names))
    p, *_ = estimate(votes, np.array([r["count"] for r in seen], float))
    table = pa.table([*map(pa.array, votes.T.astype(np.int8)), pa.array(p)], names=[*names, "posterior"])
    d = d.join(spark.createDataFrame(table), names)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    return d.select("doc_id", *FIGURES, *names, "posterior", failed.alias("base_failed"), (~failed & (F.col("posterior") >= keep)).alias("kept"))
