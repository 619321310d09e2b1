"""MinHash and embedding near-duplicates, and components, against brute force."""

import random
import re

import numpy as np
import pytest
from slantscan.llm import embed_dedup, minhash, queries
from slantscan.llm.common import Scratch, components, local_roots

SF = "/root/testdata/sf0.001"


def smallest(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {}
    links = []
    keys = [(i, d, shingles(t)) for i, (d, t) in enumerate(rows)]
    for i, (_, d, s) in enumerate(keys):
        sets[i] = s
        for j in range(i):
            o = keys[j][2]
            same_id = d is not None and d == keys[j][1] and s and o
            if same_id or (s and o and d is not None and keys[j][1] is not None and 100 * len(s & o) >= 75 * len(s | o)):
                links.append((j, i))
    root = smallest(range(len(keys)), links)
    low = {}
    for i, d, s in keys:
        if d is not None:
            low[root[i]] = min(low.get(root[i], d), d)
    by_id = {}
    for i, d, s in keys:
        if d is not None and s:
            by_id[d] = min(by_id.get(d, d), low[root[i]])
    return sorted((d is not None, d or 0, len(s), by_id.get(d, d), by_id.get(d, d) == d) for i, d, s in keys)


def got(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_minhash_whole_table(spark):
    docs = queries.table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(queries.op9_minhash(spark, SF)) == brute(rows)


def test_minhash_cases(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefgh", k=4))
    base = [word() for _ in range(200)]

    def near(n):
        w = list(base)
        for _ in range(n):
            w[rnd.randrange(len(w))] = word()
        return " ".join(w)

    rows = [(k, near(k % 9)) for k in range(60, 0, -1)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "one two"), (104, "ONE\vtwo"), (105, "one two three"), (None, "one two"), (None, None)]
    rows += [(106, " ".join(base * 50)), (107, " ".join(base * 50)), (107, " ".join(base * 50))]  # very long; a repeated row
    rows += [(108, "p q r s t u v"), (108, "entirely other words in here now"), (109, "P Q R S T U V")]  # an id with two texts
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, component_id string, kept string")
    assert got(minhash.near_duplicates(df)) == [(a, b, c, d if a else None, e if a else True) for a, b, c, d, e in brute(rows)]
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_minhash_blocks(spark, monkeypatch):
    """Long posting lists and large families are dealt out as pairs of blocks."""
    rnd = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(rnd.randrange(12)):
            w[rnd.randrange(len(w))] = f"x{rnd.random()}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(minhash, "LIST_BLOCK", 16)
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 2000)
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def vectors(df):
    return sorted(((r.vec_id is not None, r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in df.collect())


def brute_vectors(rows, least=0.95):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, count = [], {}
    for a in range(len(ok)):
        for b in range(len(ok)):
            if a != b and len(ok[a][1]) == len(ok[b][1]):
                x, y = np.array(ok[a][1], float), np.array(ok[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links.append((ok[a][0], ok[b][0]))
                    count[ok[a][0]] = count.get(ok[a][0], 0) + 1
    root = smallest({i for i, _ in rows if i is not None}, links)
    return sorted(((i is not None, i or 0), count.get(i, 0) if i is not None else 0, root.get(i), root.get(i) == i if i is not None else True) for i, _ in rows)


def test_embeddings_whole_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in queries.table(spark, SF, "embeddings").collect()]
    assert vectors(queries.op6_embed_dedup(spark, SF)) == brute_vectors(rows)


@pytest.mark.parametrize("dims", [3, 20])
def test_embeddings_cases(spark, dims, monkeypatch):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(12, dims))
    rows = [(k, (centres[k % 12] + rng.normal(size=dims) * 0.12 * (k % 5)).tolist()) for k in range(300, 0, -1)]
    rows += [(1000 + k, centres[0].tolist()) for k in range(30)]  # equal
    rows += [(2000, (centres[0] * 7).tolist()), (2001, (-centres[0]).tolist()), (2002, [0.0] * dims), (2003, None), (2004, [None] * dims)]
    rows += [(2005, [float("nan")] * dims), (2006, [float("inf")] + [1.0] * (dims - 1)), (2007, [1.0]), (2008, [2.0]), (2009, []), (None, centres[0].tolist())]
    monkeypatch.setattr(embed_dedup, "CELL", 40)
    monkeypatch.setattr(embed_dedup, "HOME_BLOCK", 16)
    monkeypatch.setattr(embed_dedup, "VISIT_BLOCK", 48)
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<double>, label string, n_links int")
    assert vectors(embed_dedup.near_duplicates(df)) == brute_vectors(rows)
    assert embed_dedup.near_duplicates(df.limit(0)).collect() == []


def test_components(spark):
    rnd = random.Random(3)
    chain = [(k, k + 1) for k in range(300, 400)]
    hub = [(k, 950) for k in range(900, 940)]
    some = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(90)]
    links = chain + hub + some + [(7, 7)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    found = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark), "t")
    assert {r.node: r.component for r in found.collect()} == smallest(nodes, [x for x in links if x[0] != x[1]])
    root = local_roots(500, np.array([a for a, _ in chain]), np.array([b for _, b in chain]))
    assert set(root[300:401]) == {300} and root[0] == 0
