"""Main text of HTML pages by nearest-URL page differencing.

Pages are cut into lines of text (blocks), each with what the markup says of it. Pages of a host are put
in the order of their URL paths. A page is paired with the nearest page around it, by the path that begins most like its
own, that is no copy: pages that share clearly more with it than another neighbour does share an article, not the
template alone. The longest common subsequence of the pair's lines is what the template repeats, and is deleted:

* outside articles that markup names, every shared line;
* inside such an article, where pages often carry the same paragraph, the lines that all neighbours share
  (four at least) if those are the lesser part of the article.

Markup then takes what is left of menus, sidebars, notices and the like, which differ from page to page.

Only line keys are compared across pages. The order over all pages is made by range partitions and cut in
blocks of pages that overlap, so a host with a third of the pages is many blocks' work.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, frugal, plain, table, written

#: Fixed names. Elements whose content is never text.
NO_TEXT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "audio", "video", "head", "title", "textarea", "select", "datalist", "map"}
#: Elements that hold no article text.
ASIDE = {"nav", "footer", "aside", "menu", "dialog", "button", "fieldset"}
#: Elements that hold none unless they hold most of the page: some systems put whole pages in a form.
MAYBE = {"form"}
#: Elements that end a block.
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose end tags are often left out, and what closes them.
LOOSE = {"p": BLOCK - {"hr"} | {"hr"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: Words that name, as a whole class or id or as its words, what is not the article.
NOTICE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "promo", "promotion", "sponsor", "sponsored", "sidebar", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay",
    "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "related", "recommended", "recommendations", "widget", "widgets",
    "pager", "pagination", "toolbar", "skip", "hidden", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
}
#: Of these, words that subjects of articles have too, and the words beside which they name a part of the page.
SUBJECTS = {"share", "social", "reply"}
PARTS = {
    "bar", "bars", "box", "boxes", "button", "buttons", "link", "links", "list", "icon", "icons", "media", "tool", "tools", "block", "area", "wrap", "wrapper", "section", "row", "item", "items", "group", "top", "bottom", "left", "right", "inner", "outer",
    "site", "js", "follow", "this", "to", "network", "networks", "strip", "panel", "count", "counts", "form", "title", "post", "page", "article", "container", "content", "footer", "header", "fixed", "sticky", "floating", "inline", "on", "us", "m", "c", "b",
}
#: Words that do so outside articles only.
FRAME = {"header", "masthead", "footer"}
#: Words of a class or id that is about the layout around the article: whatever else it names is not this element.
LAYOUT = {"with", "has", "no", "without", "content", "main", "page", "layout", "wrapper", "container", "body", "article", "post", "entry"}
#: Elements that hold an end tag's reach, and elements whose end tags reach out of any.
WALLS = {"td", "th", "table", "article", "main", "body"}
REACH = {"table", "tr", "tbody", "article", "main", "body", "html", "section", "div"}
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {k: re.compile(rf"</{k}\b[^>]*>", re.I) for k in ("script", "style", "textarea", "title", "iframe", "noscript", "template")}
#: Link-only lines in a row, outside any article, that are a menu.
MENU = 3
#: Neighbours on each side that a page is compared with, and how many must share a line inside an article.
NEAR, ALL = 4, 4
#: A neighbour that shares so many times the characters that another shares is a copy, in part at least.
MORE = 1.25
#: Characters by which neighbours may differ in any case.
SLACK = 80
#: Pages in a block.
BLOCK_PAGES = 256


def _named(value: str, in_article: bool) -> bool:
    """A class or id that names what is not the article."""
    names = [set(re.split(r"[^a-z0-9]+", re.sub("([a-z])([A-Z])", r"\1-\2", name).lower())) for name in value.split()]
    if any(x & LAYOUT for x in names):
        names = [x for x in names if x & NOTICE and not x & LAYOUT and len(x) == 1]
        return bool(names) and len(value.split()) == 1
    return any(_notice(x) or (x & FRAME and not in_article) for x in names)


def _notice(words: set[str]) -> bool:
    """Words of a name that is no article's; those that a subject may have too only beside words of a page's parts."""
    found = words & NOTICE
    return bool(found) and (not found <= SUBJECTS or all(w in PARTS or w in SUBJECTS or not w.isalpha() for w in words))


def _aside(name: str, attributes: str, in_article: bool) -> str:
    """What an element is: ``aside`` for certain, ``maybe`` by its class or id, or ``plain``."""
    if name in ASIDE or (name == "header" and not in_article):
        return "aside"
    whole = name in ("html", "body")
    what = "maybe" if name in MAYBE else "plain"
    for key, a, b, c in _ATTRIBUTE.findall(attributes or ""):
        key, value = key.lower(), a or b or c
        if key == "role" and value.lower() in ROLES and not whole:
            if value.lower() != "form":
                return "aside"
            what = "maybe"
        # hidden until a script shows it: what holds most of a page is the page
        hidden = key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)
        if hidden and not whole:
            what = "maybe"
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and _named(value, in_article):
            what = "maybe"
    return what


class _Open:
    """Open elements; the place of the last one of a name, or of a kind, is found without going through all."""

    def __init__(self):
        self.stack: list[tuple[str, str]] = []  # element and what it is
        self.of: dict[str, list[int]] = defaultdict(list)
        self.block: list[int] = []  # elements that end a block
        self.wall: list[int] = []  # elements that end tags of others don't reach out of

    def push(self, name: str, what: str) -> None:
        at = len(self.stack)
        self.stack.append((name, what))
        self.of[name].append(at)
        if name in BLOCK or name == "option":
            self.block.append(at)
        if name in WALLS:
            self.wall.append(at)

    def pop(self) -> tuple[str, str]:
        name, what = self.stack.pop()
        for places in (self.of[name], self.block, self.wall):
            if places and places[-1] == len(self.stack):
                places.pop()
        return name, what

    def closed_by(self, name: str) -> int | None:
        """Where the element stands that a new one ends, whose end tag was left out."""
        for k in reversed(self.block):
            top = self.stack[k][0]
            if top in LOOSE and name in LOOSE[top]:
                return k
            if top not in LOOSE or top != "p" and name in ("ul", "ol", "table", "dl"):
                return None
        return None


def _tags(html: str) -> Iterator[tuple[str, int, int, str, str]]:
    """(kind, begin, end, name, attributes): text, open or close; what is neither is left out. Each character is read a few times at most."""
    at, n, last = 0, len(html), {q: html.rfind(q) for q in ("\"", "'", ">", "-->")}
    while at < n:
        if html[at] != "<":
            end = html.find("<", at)
            end = n if end < 0 else end
            yield "text", at, end, "", ""
            at = end
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4) if last["-->"] >= at + 4 else -1
            at = n if end < 0 else end + 3
            continue
        if html.startswith("<![CDATA[", at):
            end = html.find("]]>", at)
            end = n if end < 0 else end
            yield "text", at + 9, end, "", ""
            at = end + 3
            continue
        if html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(html, at)
        if not m or at > last[">"]:
            yield "text", at, at + 1, "", ""
            at += 1
            continue
        k = m.end()
        while True:  # to the > outside quotes
            q = _QUOTE.search(html, k)
            if not q:
                k = html.find(">", m.end())  # a quote that nothing ends is no quote
                break
            k = q.end()
            if q.group() == ">":
                k -= 1
                break
            if last[q.group()] < k:
                k = html.find(">", m.end())
                break
            k = html.find(q.group(), k) + 1
        end = n if k < 0 else k + 1
        yield ("close" if m.group(1) else "open"), at, end, m.group(2).lower(), html[m.end() : end - 1]
        at = end


def blocks(html: str | None) -> list[tuple[str, bool, bool, float]]:
    """(text, in the article, in something that is not the article, share of link text) of each line of a page, in order.

    An element that only its class or id calls something else than the article is taken at its word
    unless it holds over half of the page's text. Damaged markup is read as far as it goes: end tags of nothing are
    left out, quotes that nothing ends are no quotes, and a < that begins no tag is text.
    """
    lines: list[tuple[str, bool, bool, float, tuple]] = []
    opened = _Open()
    depth = {"article": 0, "aside": 0, "none": 0, "link": 0}
    maybe: list[int] = []  # open elements that may not be the article
    held: list[str] = []
    linked = count = 0
    html = html or ""

    def end_block() -> None:
        nonlocal linked
        if held:
            raw = "".join(held)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                lines.append((text, depth["article"] > 0, depth["aside"] > 0, linked / max(1, len(raw)), tuple(maybe)))
            held.clear()
        linked = 0

    def close(until: int) -> None:
        while len(opened.stack) > until:
            name, what = opened.pop()
            if name in BLOCK or name in NO_TEXT or what in ("article", "aside", "maybe"):
                end_block()
            if what in depth:
                depth[what] -= 1
            elif what == "maybe":
                maybe.pop()

    skip, unclosed = 0, set()
    for kind, begin, end, name, attributes in _tags(html):
        if begin < skip:
            if end <= skip:
                continue
            begin = skip if kind == "text" else begin
        if kind == "text":
            text = html[begin:end]
            if not depth["none"]:
                held.append(text)
                if depth["link"]:
                    linked += len(text)
            continue
        if kind == "close":
            places = opened.of[name]
            # an end tag doesn't reach out of the cell, list or section it stands in
            if places and not (name not in REACH and opened.wall and opened.wall[-1] > places[-1]):
                close(places[-1])
            if name == "p" or name in BLOCK:
                end_block()
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                end_block()
            continue
        ended = opened.closed_by(name)
        if ended is not None:
            close(ended)
        if name in BLOCK:
            end_block()
        if attributes.endswith("/") and name not in BLOCK and name not in _RAW:
            continue
        if name in _RAW:
            closing = None if name in unclosed else _RAW[name].search(html, end)
            if not closing:
                unclosed.add(name)
            if name in ("noscript", "template", "iframe") or closing or name in ("script", "style"):
                skip = closing.end() if closing else len(html)
                continue
        what = "plain"
        if name in NO_TEXT:
            what = "none"
        elif name in ("article", "main") or attributes and re.search(r"itemprop\s*=\s*[\"']?articleBody|role\s*=\s*[\"']?main", attributes, re.I):
            what = "article"
        elif name == "a":
            what = "link"
        if what in ("plain", "link"):
            called = _aside(name, attributes, depth["article"] > 0)
            what = called if called != "plain" else what
        if what in ("article", "aside", "maybe"):
            end_block()
        opened.push(name, what)
        if what in depth:
            depth[what] += 1
        elif what == "maybe":
            maybe.append(count)
            count += 1
    close(0)
    end_block()
    size: dict[int, int] = defaultdict(int)
    for text, *_, inside in lines:
        for k in inside:
            size[k] += len(text)
    whole = sum(len(x[0]) for x in lines)
    return [(text, article, aside or any(2 * size[k] <= whole for k in inside), links) for text, article, aside, links, inside in lines]


def common(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence of a and b."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where = defaultdict(list)
    for j in range(head, len(b) - tail):
        where[b[j]].append(j)
    ends: list[int] = []  # last place in b of the best chain of each length
    links: list[tuple[int, tuple | None]] = []
    for i in range(head, len(a) - tail):
        for j in reversed(where.get(a[i], ())):
            k = bisect_left(ends, j)
            node = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(node)
            else:
                ends[k], links[k] = j, node
    middle, node = [], links[-1] if links else None
    while node:
        middle.append(node[0])
        node = node[1]
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


def differing(path: str, mine: list[int], sizes: list[int], inside: list[int], near: list[tuple[str, list[int]]]) -> list[int]:
    """Places of the lines of a page that its template repeats.

    mine, sizes and inside: key, characters, and whether it is inside an article of each line. near: paths and keys of pages around
    it, in any order.
    """
    met = []
    for other, keys in near:
        places = common(mine, keys)
        if len(places) < len(mine) and len(places) < len(keys):  # one that has no line of its own is a copy
            same = next((i for i, (c, d) in enumerate(zip(path, other, strict=False)) if c != d), min(len(path), len(other)))
            met.append((-same, sum(sizes[k] for k in places), places))
    if not met:
        return []
    least = min(x[1] for x in met)
    _, _, places = min((x for x in met if x[1] <= MORE * least + SLACK), key=lambda x: x[0])
    out = [k for k in places if not inside[k]]
    if len(met) >= ALL:
        every = set(places).intersection(*(x[2] for x in met))
        often = [k for k in sorted(every) if inside[k]]
        if 2 * sum(sizes[k] for k in often) < sum(n for n, i in zip(sizes, inside, strict=True) if i):
            out += often
    return sorted(out)


def article(page: list[tuple[str, bool, bool, float]], shared: set[int]) -> list[str]:
    """The lines that stay: shared holds the places of lines that the template repeats."""
    left = [x for k, x in enumerate(page) if k not in shared]
    if any(inside and not aside for _, inside, aside, _ in left):
        return [text for text, inside, aside, _ in left if inside and not aside]
    out: list[str] = []
    run: list[str] = []
    for text, _, aside, links in [*left, ("", False, True, 0.0)]:
        if links > 0.8 and not aside:
            run.append(text)
            continue
        out += run if len(run) < MENU else []  # bare links in a row are a menu
        out += [] if aside else [text]
        run = []
    return out


def _key(lines: list) -> list[int]:
    from xxhash import xxh64_intdigest

    return [xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t, *_ in lines]


def _line_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pages = [blocks(x) for x in pdf["html"]]
        sizes = [[len(text) for text, *_ in page] for page in pages]
        inside = [[bool(article and not aside) for _, article, aside, _ in page] for page in pages]
        yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "h": pdf["h"], "host": pdf["host"], "path": pdf["path"], "keys": [_key(page) for page in pages], "sizes": sizes, "inside": inside})


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """The lines to delete of the pages of a block; pages of the blocks beside it are there to be compared with."""
    pdf = pdf.sort_values("at", ignore_index=True)
    host, path, keys = pdf["host"].tolist(), pdf["path"].tolist(), [x.tolist() for x in pdf["keys"]]
    own = pdf.index[pdf["own"]].tolist()
    out = []
    for k in own:
        near = [j for j in range(max(0, k - NEAR), min(len(pdf), k + NEAR + 1)) if j != k and host[j] == host[k]]
        out.append(differing(path[k], keys[k], pdf["sizes"][k].tolist(), pdf["inside"][k].tolist(), [(path[j], keys[j]) for j in near]))
    return pd.DataFrame({"page_id": pdf["page_id"].astype("Int64").iloc[own].array, "h": pdf["h"].iloc[own].array, "shared": pd.Series(out, dtype=object)})


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = ["\n".join(article(blocks(x), set() if s is None else set(list(s)))) for x, s in zip(pdf["html"], pdf["shared"], strict=True)]
        yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def template_lines(pages: DataFrame) -> DataFrame:
    """page_id, h (hash of URL and html), shared: the places of the lines that differencing deletes, of every page. pages: from _keyed()."""
    keyed = pages.select("page_id", "h", "host", "path", "html").mapInPandas(frugal(_line_keys), "page_id long, h long, host string, path string, keys array<long>, sizes array<int>, inside array<boolean>")
    keyed = written(keyed)  # range partitions read their input twice
    order = ["host", "path", "page_id", "h"]
    keyed = checkpointed(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    parts = keyed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    # a row a partition
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    placed = keyed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(parts), "part").withColumn("at", F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "base")
    block = lambda at: F.floor(at / BLOCK_PAGES)
    mine = block(F.col("at"))
    # a page at a block's edge goes to the block beside it as well
    to = F.array_distinct(F.array(mine, block(F.col("at") - NEAR), block(F.col("at") + NEAR)))
    met = placed.select("*", mine.alias("home"), F.explode(to).alias("block")).withColumn("own", F.col("block") == F.col("home")).drop("home")
    return met.groupBy("block").applyInPandas(_shared, "page_id long, h long, shared array<int>")


def _keyed(pages: DataFrame) -> DataFrame:
    pages = plain(pages, page_id="long", url="string", html="string")
    url = F.regexp_extract(F.coalesce("url", F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce("url", F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", 2)
    return pages.withColumn("host", F.lower(F.regexp_replace(url, "^(www|m)\\.", ""))).withColumn("path", path).withColumn("h", F.xxhash64("url", "html"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    pages: page_id, url, html (other columns are ignored). Null html is empty and gives an empty text;
    a null URL or one without a host is compared with other such pages; pages alone on their host, and
    those among copies of themselves, lose only what markup marks; repeated rows come each; an empty table
    gives no rows. Ties of equal paths go by page_id; of equally near pages the first is taken. Html of any length and depth is read in
    time that grows with its length.
    """
    pages = _keyed(pages)
    shared = template_lines(pages).where(F.size("shared") > 0).dropDuplicates(["page_id", "h"]).select(F.col("page_id").alias("p"), F.col("h").alias("g"), "shared")
    out = pages.join(shared, pages["page_id"].eqNullSafe(shared["p"]) & (pages["h"] == shared["g"]), "left")
    return out.select("page_id", "url", "html", "shared").mapInPandas(frugal(_texts), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
