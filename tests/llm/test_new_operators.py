"""Quality rules, lexical search, whitening: against brute force and odd inputs."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from slantscan.llm import lexical, queries, rules, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_words string, posterior int, key string, query int, score string"


def docs_of(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z") for i, t in rows], DOCS)


# ---- rules -------------------------------------------------------------------


def brute_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len({i + k for i, w in enumerate(windows) if w in often for k in range(3)}),
        "n_lines": len(lines),
        "n_odd_words": sum(bool(re.search(r"[!#$%&*+/<=>@\[\\\]^_`{|}~]", w)) for w in words),
        "n_marks": sum(c.isascii() and c.isprintable() and not c.isalnum() and c != " " for c in text),
        "n_upper": len(re.findall("[A-Z]", text)),
        "n_shouts": text.count("!"),
        "n_digits": len(re.findall("[0-9]", text)),
    }


ODD_TEXTS = [
    None, "", " \n\t ", "a", "a b c a b c", "a a a a", "x\ny\nx\n\n \nx \n", " é ü ñ!", "a\x0bb\x0cc\rd\x1ce\x85f",
    "# * $ % & | < > @ ~ ^", "der die das " * 200, "Ä" * 5000, "a b c d a b x y c d a", "\x00 a\x7f ퟿", "WORD!! " * 60,
]


def test_figures_against_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = ODD_TEXTS + ["".join(rng.choice(list("ab \nc!é#"), rng.integers(0, 80))) for _ in range(300)]
    got = {r.doc_id: r for r in rules.judge(docs_of(spark, enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        assert {c: got[i][c] for c in rules.FIGURES} == brute_figures(t), t


def test_repeated_words_with_more_numbers_than_fit():
    words = [b"%d" % i for i in range(1 << 21)] + [b"5", b"6", b"7"]
    assert rules.repeated_words(words) == 6


def test_estimation_recovers_the_accuracies():
    rng = np.random.default_rng(0)
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.85])
    y = np.where(rng.random(200_000) < 0.7, 1, -1)
    votes = np.where(rng.random((len(y), 5)) < right, y[:, None], -y[:, None]) * (rng.random((len(y), 5)) < 0.8)
    patterns, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, found, share = rules.estimate(patterns.astype(float), n.astype(float), rounds=200)
    assert np.abs(found - right).max() < 0.02 and abs(share - 0.7) < 0.02
    assert ((p[at.ravel()] > 0.5) == (y > 0)).mean() > 0.93


def test_judge_keeps_good_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    found = rules.judge(docs).join(labels, "doc_id").where("NOT base_failed").select("kept", "quality").collect()
    assert np.mean([r.kept == bool(r.quality) for r in found]) > 0.97


def test_rules_without_rows_and_with_nulls(spark):
    assert rules.judge(docs_of(spark, [])).count() == 0
    rows = [(None, "a b"), (None, None), (3, "some words"), (3, "some words")]
    got = rules.judge(docs_of(spark, rows)).collect()
    assert len(got) == 4 and all(r.base_failed and not r.kept for r in got)
    assert [r.n_words for r in got if r.doc_id is None and r.n_words] == [2]


# ---- lexical search ------------------------------------------------------------


def brute_rank(docs, items, best=10):
    split = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(i, split.findall((t or "").translate(low))) for i, t in docs]
    found = [(i, Counter(ts), len(ts)) for i, ts in found if ts]
    n_docs, length = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        q = Counter(split.findall((text or "").translate(low)))
        scores = []
        for i, c, n in found:
            m = 25 + (75 * n * n_docs) // length
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in q.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:best], 1)]
    return out


def got_rank(df):
    return [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("block", [1 << 17, 5])
def test_rank_against_brute_force(spark, block):
    rng = np.random.default_rng(7)
    vocabulary = ["a", "B", "é", "über", "x1", "Ω", "the", "The", "foo", "bar-baz", " ", "9"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 30))) for _ in range(200)]
    docs = [*enumerate(texts), (7, texts[7]), (7, "foo"), (None, texts[9]), (None, None), (500, ""), (501, "foo " * 50_000)]
    items = [(1, "foo über THE foo"), (2, None), (3, "--"), (4, "nowhere"), (5, "a a a b"), (5, "Ω 9"), (None, "x1")]
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    d = docs_of(spark, docs).repartition(5)
    assert order(got_rank(lexical.rank(d, asked, block=block))) == order(brute_rank(docs, items))


def test_rank_with_narrow_sketches_is_exact(spark, monkeypatch):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    counts = [(i, Counter(ts)) for i, t in rows if (ts := lexical.terms(t.encode()))]
    n_docs, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    want = sorted((i, r, s) for i, r, _, s in brute_rank(rows, items))
    for width in (1, 64):
        monkeypatch.setattr(lexical, "WIDTH", width)
        q = lexical._Queries([dict(Counter(lexical.terms(t.encode()))) for _, t in items], {t: lexical.weight(n, n_docs) for t, n in df.items()}, 10)
        for part in (counts[:90], counts[90:]):
            base = np.array([8 * (25 + 75 * c.total() * n_docs // length) for _, c in part])
            q.search([i for i, _ in part], [c for _, c in part], base)
        assert sorted((items[k][0], r, -h[0]) for k, hits in enumerate(q.hits) for r, h in enumerate(hits, 1)) == want


def test_a_sketch_bounds_every_score(spark):
    counts = [Counter({b"t%d" % i: 1 + i % 5 for i in range(j, j + 400)}) for j in range(30)]
    base = np.full(30, 8 * 100)
    sketch = lexical._sketch(counts, base)
    for d, c in enumerate(counts):
        for t, tf in c.items():
            assert sketch[lexical._coordinate(t), d] >= 10**9 * tf // (1000 * tf + 800)


def test_rank_of_nothing(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank(docs_of(spark, []), items).count() == 0
    assert lexical.rank(docs_of(spark, [(1, "a"), (2, None)]), items.where("false")).count() == 0
    assert lexical.rank(docs_of(spark, [(1, None)]), items).count() == 0


# ---- whitening -------------------------------------------------------------------


def brute_whiten(rows, weigh="one", k=4):
    ok = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    copies = Counter(tuple(x) for _, x in ok)
    x = np.array(list(copies))
    w = np.array(list(copies.values())) if weigh == "count" else np.ones(len(x), int)
    n, s = int(w.sum()), (w[:, None] * x).sum(axis=0)
    y = x - s / n
    v = (y * w[:, None]).T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = {}
    for i, r in ok:
        white = (np.array(r) - s / n) @ u / np.sqrt(e)
        out.setdefault(i, []).append((sum((n * a - int(b)) ** 2 for a, b in zip(r, s)), white))
    return n, e / np.trace(v), out


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, "k", 1) for i, v in rows], "vec_id long, embedding array<float>, x int, key string, n int")


@pytest.mark.parametrize("weigh", ["one", "count"])
def test_whitening_against_brute_force(spark, weigh):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.1] + 10
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third of all rows is one vector
    rows += [(2000, None), (2001, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, [0.0] * 6), (2005, []), (3, rows[3][1]), (2006, [-0.0] * 6)]
    n, share, want = brute_whiten(rows, weigh)
    got = whitening.whiten(vectors_of(spark, rows).repartition(4), weigh=weigh).collect()
    assert len(got) == 4 * sum(map(len, want.values()))
    for r in got:
        deviation, white = want[r.vec_id][0]
        assert r.n == n and r.deviation == deviation and r.identity_error < 1e-9
        assert abs(abs(r.whitened) - abs(white[r.component - 1])) < 1e-7 and abs(r.explained / share[r.component - 1] - 1) < 1e-9
    signs = {(r.component, np.sign(r.whitened * want[r.vec_id][0][1][r.component - 1])) for r in got if abs(r.whitened) > 1e-3}
    assert len(signs) == 4  # one sign a component


def test_whitening_of_the_whole_table(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    n, share, want = brute_whiten(rows)
    got = queries.op13_whitening(spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint"
    for r in got.collect():
        deviation, white = want[r.vec_id][0]
        assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-4
        assert abs(abs(r.whitened) - abs(white[r.component - 1])) < 1e-6 and abs(r.explained / share[r.component - 1] - 1) < 1e-4


def test_whitening_without_variance_and_of_few_dimensions(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    got = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (None, [3.0, 2.0]), (4, [9.0])])).collect()
    assert sorted((r.vec_id or 0, r.component, abs(r.whitened)) for r in got) == [(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0)]


def test_exact_deviation_beyond_64_bits(spark):
    rows = [(i, [float(2**40 * (i % 7)), 1.0 * i]) for i in range(50)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(vectors_of(spark, rows)).where(F.col("component") == 1).collect()}
    _, _, want = brute_whiten(rows)
    assert {i: int(d) for i, d in got.items()} == {i: w[0][0] for i, w in want.items()}


# ---- archives of an input that isn't repeatable --------------------------------------


def test_archives_of_an_input_that_reorders_itself(spark):
    """Every read of the input gives other rows an id and a place; no payload may be lost."""
    from pyspark.sql import types as T

    from slantscan.llm import warc

    @F.udf(T.DoubleType())
    def chance():
        import random

        return random.random()

    pages = spark.range(60, numPartitions=6).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.concat(F.lit("p" * 150), (F.col("id") % 5).cast("string")).alias("html"))
    shuffled = pages.orderBy(chance.asNondeterministic()())
    assert shuffled.select("page_id").collect() != shuffled.select("page_id").collect()
    got = warc.round_trip(shuffled).collect()
    assert len(got) == 60 and sum(r.record_type == "response" for r in got) == 5
    assert all(r.payload_bytes == 151 and r.payload_digest for r in got)
    assert all(r.refers_to == r.page_id % 5 for r in got if r.record_type == "revisit")


def test_a_revisit_without_its_response_fails(spark):
    from slantscan.llm import warc
    from slantscan.llm.common import Scratch

    pages = spark.createDataFrame([(i, "http://x", "q" * 200) for i in range(4)], "page_id long, url string, html string")
    scratch = Scratch(spark)
    found = warc.resolve(scratch.save(warc.records(pages), "records"), scratch)
    warc.write(found.where("record_type = 'revisit'"), scratch.path("archive"))
    assert warc.digest_rows(spark, scratch.path("archive")).count() == 3
    with pytest.raises(Exception, match="is the response of revisit"):
        warc.digest_rows(spark, scratch.path("archive"), strict=True).collect()
