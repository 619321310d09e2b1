"""Extraction, packing, archives, chats: brute force and exact round trips."""

import hashlib
import html
import re
import struct
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from slantscan.llm import chat, html_extract, packing, queries, warc
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pages_whole_table(spark):
    want = {}
    for i, u, h in duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall():
        a = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        want[i] = (u, " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", a))).split()))
    got = {r.page_id: r for r in queries.op1_html(spark, SF).collect()}
    assert {i: (r.url, r.text) for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


PAGE = """<html><body><header class=top><h1>Site</h1></header><div id="wrap" class="with-sidebar"><div class="post"><h2>Title</h2>
<div class="body"><p>First para, with text. And more&nbsp;of it.</p><p>Short.</p><ul><li>item one<li>item <i>t</i>wo</ul>
<table><tr><td>a<td>b</table><p>Some closing words, as long as the others are.</div></div>
<div class="sidebar"><p>Buy now, pay later! It is a long text indeed, with commas, and more of it than there is elsewhere.</p></div></div>
<div id=comments><article class=comment><p>I disagree, with all of it, and so on, and on, and on.</p></article></div>
<div class="cookie-notice">We use cookies, of course. Accept?</div><form>Name <input></form><footer>c</footer></body></html>"""


@pytest.mark.parametrize(
    "page, text",
    [
        (PAGE, "Title First para, with text. And more of it. Short. item one item two a b Some closing words, as long as the others are."),
        ("<p>Just a &lt;text&gt; &amp no more", "Just a <text> & no more"),
        ("plain text only", "plain text only"),
        ("<div class=ad>x</div>", ""),
        ("<script>var a='<p>no</p>'</script>", ""),
        ("<article><header><h1>T</h1><span>by me</span></header><p>a<b>b</b>c<br>d</p><aside>no</aside></article>", "T abc d"),
        ("<a title='x>y'>l</a><p title=\"unclosed>text</p> more", "l text more"),
        ("<p>" + "word " * 50_000 + "</p>", ("word " * 50_000).strip()),
        ("", ""),
        (None, ""),
    ],
)
def test_page_cases(page, text):
    assert html_extract.main_text(page) == text


SAYS = "This part says one thing, then another, and it goes on at some length about both. "


@pytest.mark.parametrize(
    "page",
    [
        "<body><div>{7}</div><div>{3}</div></body>",
        "<body><section>{13}</section><section>{4}</section><section>{3}</section></body>",
        "<body><div id=content><div>{7}</div><ul><li>short list</ul><div>{3}</div></div></body>",
        "<body><div id=top><a>Home</a> <a>About</a></div><div><div>{7}</div><div class=caption><i>A caption</i></div><div>{3}</div></div></body>",
        "<body><table><tr><td><p>{7}</p></td></tr></table><p>{3}</p></body>",
    ],
)
def test_split_article(page):
    page = re.sub(r"\{(\d+)\}", lambda m: "<p>" + "</p><p>".join([SAYS.strip()] * int(m[1])) + "</p>", page)
    want = " ".join(re.sub(r"<[^>]+>", " ", page.replace("<a>Home</a> <a>About</a>", "")).split())
    assert html_extract.main_text(page) == want


@pytest.mark.parametrize("times", [1, 10])
def test_long_quotation(times):
    para, long = SAYS.strip() * 3, " ".join([SAYS.strip()] * 15 * times)
    page = f"<body><div>{f'<p>{para}</p>' * 20}<blockquote><p>{long}</p></blockquote></div></body>"
    assert html_extract.main_text(page) == f"{para} " * 20 + long
    cells = f"<body><table><tr><td><a>Home</a><td><p>{para}</p><p>{long}</p></table>{f'<p>{para}</p>' * 5}</body>"
    assert html_extract.main_text(cells) == f"{para} {long}" + f" {para}" * 5


@pytest.mark.parametrize(
    "page",
    [
        '<body><div class="content-sidebar-wrap">{5}</div></body>',
        '<body><article class="post category-social">{5}</article></body>',
        "<body><div>{5}<section id=discussion><h2>Discussion</h2>{1}</section><section id=related-work>{1}</section><section id=search-algorithms>{1}</section><h2 id=hidden-costs>Hidden costs</h2>{1}</div></body>",
        '<body><article><h1>T</h1>{3}<div class="section" id="discussion">{1}</div><h2 id="related">More</h2>{1}</article></body>',
        "<body><form id=aspnetForm><h1>Title</h1>{5}</form></body>",
        '<body><form><div class="elementor-widget elementor-widget-text">{2}</div><div class="elementor-widget">{2}</div></form></body>',
        '<body><div class="post-header"><h1>Title</h1></div><div class="post">{4}</div></body>',
        '<body><div class="widget">{2}</div><div class="widget">{2}</div><div class="widget">{2}</div></body>',
        '<body><div id=wrap class=sidebar><h1 class="page-header">Title</h1>{4}</div></body>',
    ],
)
def test_names_that_say_something_else(page):
    whole = re.sub(r"\{(\d+)\}", lambda m: "<p>" + "</p><p>".join([SAYS.strip()] * int(m[1])) + "</p>", page)
    want = " ".join(re.sub(r"<[^>]+>", " ", whole).split())
    assert html_extract.main_text(whole) == want
    # what isn't the article goes as before
    other = '<div class="sidebar"><p>Buy now, pay later!</p></div><div id=comments><p>I disagree, with all of it.</p></div><div class="my-social-x"><a>Tell, your friends.</a></div><form>Name <input></form>'
    if "class=sidebar" not in page and '"widget"' not in page:
        assert html_extract.main_text(whole.replace("</body>", other + "</body>")) == want


REPLY = "<p>I disagree with all of it, and so do my friends.</p>"


@pytest.mark.parametrize(
    "more",
    [
        f"<section id=comments><h2>Comments</h2>{REPLY * 4}</section>",
        f'<section id="reader-comments" class="x">{REPLY * 30}</section>',
        f'<div class="user-comments">{REPLY * 4}</div>',
        f'<ol class="comment-thread"><li>{REPLY}<li>{REPLY}</ol>',
        "<section id=newsletter><h2>Stay in touch</h2><p>Get our letter every week, free of charge. It has news, and more.</p></section>",
    ],
)
@pytest.mark.parametrize("page", ["<body><article><h1>T</h1>{4}@</article></body>", "<body><article><h1>T</h1>{4}</article>@</body>", "<body><div><h1>T</h1>{4}</div>@</body>", "<body><div><article><h1>T</h1>{4}</article></div>@</body>"])
def test_comments_and_boxes_go(page, more):
    page = re.sub(r"\{(\d+)\}", lambda m: f"<p>{SAYS.strip()}</p>" * int(m[1]), page)
    want = "T" + f" {SAYS.strip()}" * 4
    assert html_extract.main_text(page.replace("@", more)) == want


def test_replies_and_closing_line_go():
    body = f"<p>{SAYS.strip()}</p>" * 4
    want = "T" + f" {SAYS.strip()}" * 4
    reply = f"<article><p>by a reader</p>{REPLY}</article>"
    assert html_extract.main_text(f"<article><h1>T</h1>{body}{reply * 9}</article>") == want
    for line in ("&copy; 2024 Some Paper. All rights reserved.", "Copyright 2019 by the authors"):
        assert html_extract.main_text(f"<body><div><h1>T</h1>{body}<p>{line}</p></div></body>") == want
    # a word on the matter is text, and so are parts that have headings
    last = "All rights reserved."  # the tables have it as a paragraph of articles
    assert html_extract.main_text(f"<body><div><h1>T</h1>{body}<p>{last}</p></div></body>") == f"{want} {last}"
    last = "Copyright law changed in many ways, and nobody knows why."
    assert html_extract.main_text(f"<article><h1>T</h1>{body}<p>{last}</p></article>") == f"{want} {last}"
    part = f"<article><h2>Part</h2>{REPLY}</article>"
    assert html_extract.main_text(f"<article><h1>T</h1>{body}{part}</article>") == f"{want} Part {re.sub('<.*?>', '', REPLY)}"


LINKS = "<div><div><a>One more</a></div><div><a>And another</a></div></div>"


@pytest.mark.parametrize("page", [f"<article><h1>T</h1><div>{{4}}</div>{LINKS}</article>", f"<body><h1>T</h1><div>{{4}}</div>{LINKS}</body>"])
def test_path_values_decide(page, monkeypatch):
    page = page.replace("{4}", f"<p>{SAYS.strip()}</p>" * 4)
    want = "T" + f" {SAYS.strip()}" * 4
    assert html_extract.main_text(page) == want
    monkeypatch.setattr(html_extract, "path_values", lambda found: {b[1].path: 1.0 for b in found})
    assert html_extract.main_text(page) == f"{want} One more And another"


def test_links_among_the_text_stay():
    page = f"<article><h1>T</h1><p>{SAYS.strip()}</p><ul><li><a>One more</a><li><a>And another</a></ul><p>{SAYS.strip()}</p></article>"
    assert html_extract.main_text(page) == f"T {SAYS.strip()} One more And another {SAYS.strip()}"


def test_pages_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, "t"), (1, "u", "<p>x</p>", "t"), (1, "u", "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html_extract.extract(df).collect()) == [(0, ""), (1, "x"), (1, "x")]
    assert html_extract.extract(df.limit(0)).collect() == []


def check_packed(rows, texts, tokenizer, capacity=2048):
    want = Counter()
    for d, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        n = len(ids)
        cut = [0, n] if n <= capacity else [0, *range(n % capacity or capacity, n + 1, capacity)]
        for p, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            want[(d, p, s, e - s, zlib.crc32(struct.pack(f"<{e - s}I", *ids[s:e])))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert at.get(r.sequence_id, 0) == r.offset
        at[r.sequence_id] = r.offset + r.length
    assert all(n <= capacity for n in at.values())
    return len(at), -(-sum(r.length for r in rows) // capacity)


def test_packing_whole_table(spark, tokenizer):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    used, least = check_packed(queries.op2_packing(spark, SF).collect(), texts, tokenizer)
    assert used <= least + 2


def test_packing_cases(spark, tokenizer):
    texts = [(1, None), (2, ""), (None, "a b"), (3, "x" * 10), (3, "x" * 10), (4, "it's  two \n spaces<|endoftext|> here  and 12 34   é"), (5, "word " * 9000)]
    texts += [(6, " lead"), (7, "tab\t and \r\n line"), (8, "日本 語  テキスト 😀 😀"), (9, "end "), (10, "\n\n \n"), (11, "!" * 5000)]
    df = spark.createDataFrame([(d, t, "s") for d, t in texts], "doc_id long, text string, length string")
    check_packed(packing.pack(df).collect(), texts, tokenizer)
    assert packing.pack(df.limit(0)).collect() == []


def test_encoding_costs_no_more_than_the_encoder(tokenizer):
    """Texts of many different words: what surrounds the encoder must not cost more than it does."""
    import random
    import time
    rng = random.Random(3)
    rounds = [[" ".join("".join(rng.choices("abcdefghijklmnopqrst", k=rng.randrange(2, 12))) for _ in range(2000)) for _ in range(40)] for _ in range(3)]
    enc = packing.TokenBytes(public_tokenizers.path("byte_bpe_50k.json"))

    def seconds(encode, texts):
        began = time.process_time()
        for t in texts:
            encode(t)
        return time.process_time() - began

    own = min(seconds(enc.encode, texts) for texts in rounds)
    assert own < 1.3 * min(seconds(lambda t: enc.encoding.encode(t, allowed_special="all"), texts) for texts in rounds)
    texts = rounds[0]
    assert enc.encode(texts[0]) == struct.pack(f"<{len(ids := tokenizer.encode(texts[0], add_special_tokens=False).ids)}I", *ids)
    assert enc.encode("") == b""


def test_patterns():
    count = {2000: 3, 48: 2, 30: 2, 18: 1, 10: 2, 8: 2, 1024: 2, 700: 3, 600: 1, 2048: 4}
    found = packing.patterns(dict(count))
    used = Counter()
    for held, times in found:
        assert sum(held) <= 2048
        for x in held:
            used[x] += times
    assert used == Counter(count)
    assert packing._exact(_left({5: 1, 7: 1, 3: 1}), 15) == [7, 5, 3]
    assert packing._exact(_left({5: 1}), 10) is None
    assert packing._exact(_left({5: 2}), 10) == [5, 5]


def _left(count):
    import numpy as np

    a = np.zeros(2049, np.int64)
    for k, n in count.items():
        a[k] = n
    return a


def archived(df):
    return sorted(tuple((v is None, v if v is not None else 0) for v in (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in df.collect())


TRICKY = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9


def test_archives(spark):
    rows = [(3, None, TRICKY), (1, "u\r\n x", TRICKY), (None, "v", TRICKY), (1, "u\r\n x", TRICKY), (2, "v", None), (5, "z", "\r\n"), (6, "z", "x\r"), (7, "z", "\n\r\n\r"), (8, "é", "é" * 50), (9, "é", "é" * 50), (10, "q", "s" * 99), (11, "q", "s" * 99)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    want, seen = [], set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (h or "").encode()
        sha = hashlib.sha256(b).hexdigest()
        first = min(r[0] for r in rows if r[2] == h and r[0] is not None)
        again = len(b) >= 100 and sha in seen
        seen.add(sha)
        want.append(tuple((v is None, v if v is not None else 0) for v in (i, len(b), sha, "revisit" if again else "response", first if again else None)))
    assert archived(warc.round_trip(df)) == sorted(want)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_rewrite_over_archives(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x" * 200), (2, "b", "x" * 200), (3, "c", "y" * 200)], "page_id long, url string, html string")
    other = spark.createDataFrame([(0, "d", "x" * 200), (4, "e", "y" * 300)], "page_id long, url string, html string")
    warc.archive(df, f"{tmp_path}/in/a")
    warc.archive(other, f"{tmp_path}/in/b")
    warc.rewrite(spark, f"{tmp_path}/in/*", f"{tmp_path}/out")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.digest_rows(spark, f"{tmp_path}/out").collect()}
    assert got == {0: ("response", None, 200), 1: ("revisit", 0, 200), 2: ("revisit", 0, 200), 3: ("response", None, 200), 4: ("response", None, 300)}
    heads = warc.read(spark, f"{tmp_path}/out").where("record_type = 'revisit'").collect()
    assert all(r.refers_to_uri == "d" and not r.payload for r in heads)


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|im_end|>", "<\\\\|", "a<", "|b", "<<||>", chat.START + chat.END, "\n \n", "é😀<|"])
def test_chat_escapes(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    turns = [("user", text), ("assistant", text), ("odd\nrole\\n<|", text)]
    assert chat.parse(chat.render(turns)[0]) == turns


def test_chats(spark):
    import pandas as pd

    tricky = [(1, 2, "assistant", "  \n\nlead<|im_end|>"), (1, 1, "user", None), (1, 3, "assistant", ""), (1, 3, "assistant", ""), (1, None, None, "late 😀é"), (None, 0, "assistant", "no id"), (2, 0, "assistant", "long " * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in tricky], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    rows = pd.DataFrame(tricky, columns=["conv_id", "turn", "role", "text"]).fillna({"role": "", "text": ""})
    for c, order in ((1, [1, 0, 2, 3, 4]), (None, [5]), (2, [6])):
        turns = [(rows.role[k], rows.text[k]) for k in order]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.formatted_chars == len(r.formatted) and len(r.ids) == len(r.loss) == r.n_tokens
    assert chat.format_chats(df.limit(0)).collect() == []


def test_chats_whole_table(spark):
    rows = duckdb.sql(f"SELECT conv_id, role, coalesce(text, '') FROM '{SF}/conversations.parquet' ORDER BY conv_id, turn").fetchall()
    rows += [(-1, "user", queries.PROBE), (-1, "assistant", queries.PROBE)]
    by = {}
    for c, r, t in rows:
        by.setdefault(c, []).append((r, t))
    got = queries.op10_chat(spark, SF).collect()
    assert {r.conv_id for r in got} == set(by)
    for r in got:
        loss = "".join(t for a, t in by[r.conv_id] if a == "assistant")
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and r.n_turns == len(by[r.conv_id])
