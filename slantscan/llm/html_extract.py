"""Main text of web pages by tag-path ratios.

A page becomes a row of text blocks, each with its root-to-leaf tag path. Per
path, text length and punctuation are summed over the page; the ratios of text
and of punctuation to blocks are smoothed along the page, fused (their product,
less what is link text) and thresholded. The paths above the threshold hold the
article's running text. The article element that holds most of it is kept, or
without one the smallest container around all of it, body included - with its
headings and short blocks, without the subtrees that tags, roles or class names
mark as something else (names and forms only if their text agrees). In either,
blocks of links stay only where path values find content; articles in the
article that read like replies go, and without an article element a closing
copyright line.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from slantscan.llm.common import text_batches

THRESHOLD = 0.25  #: part of the text's median fused path value that a content path reaches
PARAGRAPH = 300.0  #: path value that always suffices: that of 100 characters with two marks of punctuation
SMOOTH = (0.25, 0.5, 0.25)  #: weights of a block's neighbours along the page
CONTAINER = 0.6  #: part of the content paths' text that an article element holds

# Element names of HTML and usual class names
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style noscript template iframe title textarea svg math canvas object audio video noframes xmp".split())
SKIP = set("head nav footer aside button select option optgroup datalist fieldset legend label dialog menu map input".split()) | RAW
CONTAINERS = set("html body div section article main td center blockquote".split())
PARTS = set("blockquote td".split())  #: containers that are never all of an article
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul td th tr tbody thead tfoot caption".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
OTHER = set(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsense adsbygoogle banner banners sponsor sponsored sponsors promo promos promotion "
    "nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs sidebar sidebars sidenav footer masthead topbar toolbar "
    "cookie cookies consent gdpr ccpa notice notices notification notifications alert popup modal overlay lightbox paywall disclaimer "
    "newsletter subscribe subscription signup signin login register search searchbox "
    "comment comments commentlist commentform disqus reply replies respond discussion "
    "share sharing social follow related recommended recommendations teaser outbrain taboola widget widgets pagination pager copyright skip "
    "hidden invisible".split()
)
TALK = set("comment comments commentlist commentform disqus reply replies respond discussion".split())
#: words beside those of OTHER in a name that is wholly about something else
BESIDE = set("box boxes bar list area wrap wrapper container holder inner outer block module panel pane region left right top bottom main primary secondary site global page post posts article articles item items button buttons btn link links icon icons text title group section row col column field fields zone slot unit small large mobile desktop sticky fixed".split())
#: ids that even a section has for its kind, not for its heading
BOXES = set("comments commentlist disqus replies respond newsletter subscribe signup sidebar navbar breadcrumbs footer masthead banner advert adverts advertisement ads paywall gdpr recommendations taboola outbrain".split())
THREAD = set("user users reader readers visitor visitors thread threads tree content body author entry view stream feed facebook fb wp".split())  #: words beside those of TALK
HEADER = set("header pageheader siteheader".split())
OWN = set("post entry article story title chapter recipe content section document page review lesson".split())  #: words beside header: the article's own
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMED = set("section article main p li dt dd pre figure figcaption blockquote".split()) | HEADINGS | INLINE  #: their ids name the text, not its kind
WEAK, STRONG, TALKS = 1, 2, 3  #: some of a name's words are in OTHER; all are, or a form; all are, of readers' talk
MODIFIERS = set("with has no without not".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+|\d+")
PLAIN = 80  #: characters that make a block running text without punctuation
LEAST_KEPT = 200  #: characters of running text for which a marked subtree stays beside other text
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？।؟]")
_NOTICE = re.compile(r"\W{0,3}(?:©|\(c\)|copyright\b)\W{0,3}(?:©|\(c\)|copyright\b|by\b|\d{4}\b)", re.I)
LINE = 200  #: characters that a copyright line has at most
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


class _Element:
    __slots__ = ("tag", "path", "up", "skip", "head", "link", "article", "mark", "marks")

    def __init__(self, tag, path, up, skip, head, link, article, mark, marks):
        self.tag, self.path, self.up, self.skip, self.head, self.link, self.article, self.mark, self.marks = tag, path, up, skip, head, link, article, mark, marks


def _marked(tag: str, attrs: str) -> tuple[bool, int, bool, bool]:
    """What attributes say of an element: it is hidden or of another role; its names
    mark it (0, WEAK, STRONG, TALKS); it is a header; the article's own header."""
    other = header = own = False
    mark, names = 0, []
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        if name in ("class", "id"):
            names += [(name, one) for one in value.split()]
        elif name == "role":
            other |= value.strip().lower() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            other = True
        elif name == "style":
            other |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    if tag in HEADINGS or tag == "main":
        return other, 0, False, False
    named = tag in NAMED or ("class", "section") in names
    for name, one in names:
        words = {w.lower(): None for w in _NAME.findall(one)}
        if not words or next(iter(words)) in MODIFIERS:
            continue
        said = OTHER & words.keys()
        if name == "id" and named and not (said and said <= BOXES and (tag == "section" or ("class", "section") in names)):
            continue
        if said:
            beside = BESIDE | THREAD if said <= TALK - {"discussion"} else BESIDE
            whole = all(w in OTHER or w in beside or w.isdigit() for w in words)
            if name == "id" and named and not whole:
                continue
            mark = max(mark, (TALKS if said <= TALK else STRONG) if whole else WEAK)
        if not HEADER.isdisjoint(words):
            header, own = True, own or not OWN.isdisjoint(words)
    return other, mark, header, own


def blocks(page: str):
    """The page's text blocks in order: (text, element it starts in, characters in links)."""
    root = _Element("", "", None, False, False, False, False, 0, False)
    top, out, parts, owner, linked, at = root, [], [], None, 0, 0

    def close():
        nonlocal parts, owner, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, owner, linked))
        parts, owner, linked = [], None, 0

    def add(raw):
        nonlocal owner, linked
        if top.skip or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if owner is None and not text.isspace():
            owner = top
            while owner.tag in INLINE:
                owner = owner.up
        parts.append(text)
        if top.link:
            linked += len(text)

    def pop_to(element):
        nonlocal top
        top = element.up

    while True:
        m = _TOKEN.search(page, at)
        add(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, ending, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag not in INLINE and tag != "br":
            close()
        if tag == "br":
            add(" ")
            continue
        if ending:
            e = top
            while e is not root and e.tag != tag:
                e = e.up
            if e is not root and not (tag in INLINE and _crosses(top, e)):
                pop_to(e)
            continue
        if tag in RAW:  # its content isn't markup
            end = _END[tag].search(page, at)
            if not attrs.endswith("/"):
                at = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        if tag == "body":  # a head that wasn't closed ends here
            while top is not root and top.tag != "html":
                top = top.up
        if tag in CLOSES_P:
            _close_open(top, {"p"}, CONTAINERS - {"center"}, pop_to)
        if tag in HEADINGS:
            _close_open(top, HEADINGS, CONTAINERS, pop_to)
        if tag in CLOSES:
            _close_open(top, *CLOSES[tag], pop_to)
        article = top.article or tag in ("article", "main")
        skip, head, mark = top.skip or tag in SKIP, top.head, STRONG if tag == "form" else 0
        header = own = False
        if not skip and attrs.strip() and tag not in ("html", "body"):
            skip, named, header, own = _marked(tag, attrs)
            if tag == "article":  # one in another may be a reader's
                named, header = named if named > WEAK and any(x.tag == "article" for x in _line(top)) else 0, False
            if tag in INLINE:  # part of a block
                skip, named = skip or named > WEAK or named == WEAK and tag == "a", 0
            mark = max(mark, named)
        if (header or tag == "header") and not head:
            head = True
            skip = skip or not (article or own or top.tag == "section" and not header)
        path = top.path if tag in INLINE else f"{top.path}/{tag}"
        top = _Element(tag, path, top, skip, head, top.link or tag == "a", article, mark, top.marks or mark > 0)
        if tag in INLINE and skip and not top.up.skip:
            parts.append(" ")
    close()
    # of the article's header only headings belong to the text
    return [b for b in out if not b[1].head or any(e.tag in HEADINGS for e in _line(b[1]))]


def _line(e: _Element):
    while e is not None and e.tag:
        yield e
        e = e.up


def _crosses(top: _Element, e: _Element) -> bool:
    """An inline end tag doesn't close the block elements opened since."""
    while top is not e:
        if top.tag not in INLINE:
            return True
        top = top.up
    return False


def _close_open(top: _Element, tags: set, stop: set, pop_to) -> None:
    e, found = top, None
    while e is not None and e.tag and e.tag not in stop:
        if e.tag in tags:
            found = e
        e = e.up
    if found is not None:
        pop_to(found)


def path_values(found: list) -> dict[str, float]:
    """Fused text and punctuation ratio of each tag path, smoothed along the page."""
    paths = [b[1].path for b in found]
    names, which = np.unique(paths, return_inverse=True)
    length = np.array([len(b[0]) for b in found], float)
    punct = np.array([len(_PUNCT.findall(b[0])) for b in found], float)
    links = np.minimum(np.array([b[2] for b in found], float), length)
    n = np.bincount(which)
    per = lambda x: np.bincount(which, x) / n
    text_ratio, punct_ratio = per(length)[which], per(punct)[which]

    def smooth(x):
        pad = np.pad(x, 1, mode="edge")
        return SMOOTH[0] * pad[:-2] + SMOOTH[1] * pad[1:-1] + SMOOTH[2] * pad[2:]

    fused = smooth(text_ratio) * (1 + smooth(punct_ratio))
    plain = 1 - np.bincount(which, links) / np.maximum(np.bincount(which, length), 1)
    return dict(zip(names.tolist(), (per(fused) * plain).tolist(), strict=True))


def main_text(page: str | None) -> str:
    """The article's text: blocks in page order, joined by one space."""
    found = _unmarked(blocks(page)) if page else []
    if not found:
        return ""
    content = content_blocks(found)
    article = _article(found, content)
    if article is not None:
        return " ".join(b[0] for b in _of_article(article, found, content))
    kept = _inside(_widen(_common(found, content), found), found, content)
    last = len(kept)
    while last > 1 and len(kept[last - 1][0]) <= LINE and _NOTICE.match(kept[last - 1][0]):
        last -= 1
    return " ".join(b[0] for b in kept[:last])


def content_blocks(found: list) -> list[bool]:
    """Whether each block's path is above the threshold: a part of the path value that
    half of the page's text reaches, so that a few long blocks don't raise it, and
    never above that of plain paragraphs."""
    value = path_values(found)
    values = np.array([value[b[1].path] for b in found])
    order = np.argsort(values)
    upto = np.cumsum(np.array([len(b[0]) for b in found], float)[order])
    middle = values[order[np.searchsorted(upto, upto[-1] / 2)]]
    content = [v >= min(THRESHOLD * middle, PARAGRAPH) and v > 0 for v in values.tolist()]
    return content if any(content) else [True] * len(found)


def _unmarked(found: list) -> list:
    """The blocks without the subtrees that their names, or a form, mark as something else.

    A subtree whose names say it in part only goes if it is links or has no running
    text. One whose names say it wholly stays if it holds most of the page's running
    text, unless an article element stands outside of it or it is readers' talk beside
    other text. If next to nothing were left, running text stays wherever it is.
    """
    if not any(b[1].marks for b in found):
        return found
    below: dict[int, list] = {}  # characters, in links, running text, in articles, outside headings
    runs, article, every = [], False, 0
    for (text, e, linked), ok in zip(found, content_blocks(found), strict=True):
        n, inside, told = len(text), False, False
        run = n if _runs((text, e, linked), ok) else 0
        plain = 0 if e.tag in HEADINGS else n
        for x in _line(e):
            inside = inside or x.tag in ("article", "main")
            if x.mark:
                told = told or x.mark > WEAK
                s = below.setdefault(id(x), [0, 0, 0, 0, 0])
                for k, more in enumerate((n, min(linked, n), run, run * inside, plain)):
                    s[k] += more
        article = article or inside and run > 0 and not told
        every += plain
        runs.append(run)
    total = sum(runs)

    def idle(x):
        s = below[id(x)]
        return 2 * s[1] >= s[0] or not s[2]

    def gone(x):
        s = below[id(x)]
        if x.mark == WEAK:
            return 2 * s[1] >= s[0] or not s[2] and total > 0
        alone = every <= s[4]
        most = 2 * s[2] > total and (alone or s[2] >= LEAST_KEPT and x.mark != TALKS)
        return idle(x) or not most or article and not s[3]

    def rest(out):
        return [b for b in found if not any(x.mark and out(x) for x in _line(b[1]))]

    kept = rest(gone)
    if 10 * sum(len(b[0]) for b in kept if b[1].tag not in HEADINGS and 2 * b[2] < len(b[0])) < total:
        kept = rest(idle)
    return kept


def _article(found: list, content: list) -> _Element | None:
    """The article (or main) element that holds most of the content paths' text, if there is one."""
    held: dict[int, int] = {}
    total, best = 0, None
    for (text, e, _), ok in zip(found, content, strict=True):
        if ok:
            total += len(text)
            for x in _line(e):
                if x.tag in ("article", "main"):
                    held[id(x)] = held.get(id(x), 0) + len(text)
    for _, e, _ in found:
        article = next((x for x in _line(e) if held.get(id(x), 0) >= CONTAINER * total), None)
        if article is not None and (best is None or any(x is best for x in _line(article))):
            best = article  # the innermost
    if best is None or best.tag == "article":
        return best
    above = [x for x in _line(best) if x.tag == "article"]
    return above[-1] if above else best


def _of_article(article: _Element, found: list, content: list) -> list:
    """The article's blocks: those of the content paths, headings, and of the rest what
    isn't links or has its nearest container in common with content paths. An article in it without headings of its own is a reply: it goes if the
    article's own running text is at least as long, or LEAST_KEPT characters."""
    inside, replies, own = [], {}, 0
    for b, ok in zip(found, content, strict=True):
        line = [*_line(b[1])]
        at = next((k for k, x in enumerate(line) if x is article), None)
        if at is None:
            continue
        reply = next((x for x in line[:at][::-1] if x.tag == "article"), None) if article.tag == "article" else None
        n = len(b[0]) if _runs(b, ok) else 0
        if reply is None:
            own += n
        else:
            r = replies.setdefault(id(reply), [0, False])
            r[0], r[1] = r[0] + n, r[1] or b[1].tag in HEADINGS
        inside.append((b, ok, reply))
    gone = {x for x, (n, headed) in replies.items() if not headed and (own >= LEAST_KEPT or own >= n > 0)}
    holds = {id(x) for b, ok, _ in inside if ok and (x := _near(b[1])) is not None}
    kept = [b for b, ok, reply in inside if id(reply) not in gone and (ok or b[1].tag in HEADINGS or 2 * b[2] < len(b[0]) or id(_near(b[1])) in holds)]
    return kept or [b for b, _, _ in inside]


def _near(e: _Element) -> _Element | None:
    return next((x for x in _line(e) if x.tag in CONTAINERS), None)


def _runs(block: tuple, ok: bool) -> bool:
    """Whether a block is running text."""
    text, _, linked = block
    return ok and 2 * linked < len(text) and (len(text) >= PLAIN or bool(_PUNCT.search(text)))


def _common(found: list, content: list) -> _Element:
    """The smallest container around all blocks of the content paths; at last the page."""
    lines = [[*_line(b[1])][::-1] for b, ok in zip(found, content, strict=True) if ok]
    first = lines[0]
    depth = min(len(x) for x in lines)
    for line in lines:
        while depth and line[depth - 1] is not first[depth - 1]:
            depth -= 1
    while depth and first[depth - 1].tag not in CONTAINERS - PARTS:
        depth -= 1
    if depth:
        return first[depth - 1]
    top = found[0][1]
    while top.up is not None:
        top = top.up
    return top


def _widen(best: _Element, found: list) -> _Element:
    """Over parents below body that add only headings."""
    while best.up is not None and best.up.tag in CONTAINERS - PARTS and best.up.tag not in ("html", "body"):
        more = [b for b in found if any(x is best.up for x in _line(b[1])) and not any(x is best for x in _line(b[1]))]
        if not all(b[1].tag in HEADINGS for b in more):
            break
        best = best.up
    return best


def _inside(best: _Element, found: list, content: list) -> list:
    """The container's blocks: those of the content paths, headings, what stands in
    a container that holds text of content paths itself, and of the rest what isn't
    links; in body only if it stands directly there or between content blocks."""
    page = best.tag in ("", "html", "body")
    at = [k for k, ok in enumerate(content) if ok]
    holds = {id(x) for k in at if (x := _near(found[k][1])) is not None and x.tag not in ("html", "body")}
    kept = []
    for k, (b, ok) in enumerate(zip(found, content, strict=True)):
        text, e, linked = b
        line = list(_line(e))
        if best.tag and not any(x is best for x in line):
            continue
        if ok or e.tag in HEADINGS or any(id(x) in holds for x in line):
            kept.append(b)
        elif 2 * linked < len(text) and (not page or at[0] < k < at[-1] or _near(e) in (best, None)):
            kept.append(b)
    first = next(k for k, b in enumerate(found) if b is kept[0])
    while first and found[first - 1][1].tag in HEADINGS:  # the title may stand before the container
        first -= 1
        kept.insert(0, found[first])
    return kept


def _extract(batches):
    for b in batches:
        text = [main_text(t.as_py()) for t in b.column(2)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


@F.arrow_udf(StringType())
def text_of(page: pa.Array) -> pa.Array:
    """The main text of each page, as a column function."""
    return pa.array([main_text(x.as_py()) for x in page], pa.string())


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Null or empty html, or html without text, gives the empty text. Null ids and
    addresses stay null; repeated rows give equal rows; broken markup is read as
    browsers do as far as text and nesting go. The whole page is read. One pass,
    no shuffle; an empty table gives no rows. Other columns are not looked at.
    """
    text_batches(pages.sparkSession)
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return p.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
