"""Main text of web pages by a site style tree.

The pages of a host are merged: elements that stand at the same path (tag, class words, place among like siblings) are one
node of the host's tree. Over the different articles of a host, a node's content has an entropy (are its texts diverse?) and so has its presentation (are the
sequences of its children diverse?); a node that is nearly constant in both is unimportant, and its branch is removed from every page. Copies of
an article count once. What pages mark up as furniture (navigation, footers, asides, forms, adverts, notices, comments) is unimportant at once, and
an article or main element bounds the content.

The tree is never held whole: it is a table of (host, node, feature) counts, aggregated by Spark; only each host's unimportant nodes go back to its pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, text_slices

#: Different articles that must show a node before it can be unimportant, and their least share of the host's.
LEAST_PAGES = 8
LEAST_SHARE = 0.3
#: A node whose entropy is below this share of the greatest possible one is unimportant.
LEAST_IMPORTANCE = 0.25
#: The share of a list's or block's text in links that makes it a menu, where no article or main element bounds the content.
MENU_LINKS = 0.8

FEATURES = "host bigint, node bigint, kind int, feature bigint, article bigint"
TEXTS = "page_id bigint, url string, text string"

# Elements of HTML by what they do.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html caption dd dt li option optgroup legend tbody tfoot thead tr".split()) | {"dd", "dt", "li"}
CELLS = frozenset("td th br".split())
#: Elements whose start ends an open element of these kinds, up to the nearest of the bounds.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, {"html"}), "article": ({"nav"}, {"aside", "section"}), "main": ({"nav", "header", "footer", "aside"}, set()),
}
FURNITURE_TAGS = frozenset(
    "aside audio button canvas datalist dialog embed footer form head header iframe map menu nav noembed noframes noscript object script search select style svg template textarea title video xmp".split()
)
FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header "
    "legal login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommendations recommended related reply replies respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Words before which a furniture word only says what a block has or lacks.
HAVING = frozenset("has with without no hide show is".split())

# a tag ends at the first > outside quotes; with a quote left open at the first one, without any at the end of the page
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>|[^>]*\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def number(*parts: object) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


@dataclass
class Node:
    tag: str
    parent: int
    words: str  # class and id, without digits
    named: bool  # marked up as furniture, whatever it holds
    called: bool  # by its class, id or tag, unless it holds the article
    first: int  # segments from here
    last: int = 0  # to here
    places: list[int] = field(default_factory=list)  # children


class Page:
    """A page's elements, and its text in segments: (element, text, starts a block, in a link)."""

    def __init__(self, payload: str) -> None:
        self.nodes = [Node("", -1, "", False, False, 0)]
        self.segments: list[tuple[int, str, bool, bool]] = []
        self._open, self._counts, self._fresh = [0], {}, True
        at, size = 0, len(payload)
        while at < size:
            found = _TOKEN.search(payload, at)
            if found is None:
                self._text(payload[at:])
                break
            self._text(payload[at : found.start()])
            at = found.end()
            if found[2] is None:
                continue
            tag = found[2].lower()
            if found[1]:
                self._end(tag)
                continue
            self._start(tag, found[3])
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(payload, at)
                at = end.end() if end else size
                self._end(tag)
        self._close(0)
        self.nodes[0].last = len(self.segments)
        self.ends = [i + 1 for i in range(len(self.nodes))]  # the first element behind each branch
        for i in range(len(self.nodes) - 1, -1, -1):
            if self.nodes[i].places:
                self.ends[i] = self.ends[self.nodes[i].places[-1]]

    def _text(self, raw: str) -> None:
        if raw and not raw.isspace():
            text = html.unescape(raw)
            self.segments.append((self._open[-1], text, self._fresh, self._counts.get("a", 0) > 0))
            self._fresh = False
        elif raw and self.segments and not self._fresh:
            self.segments.append((self._open[-1], " ", False, False))

    def _close(self, place: int) -> None:
        while len(self._open) > max(place, 1):
            node = self.nodes[self._open.pop()]
            node.last = len(self.segments)
            self._counts[node.tag] -= 1
            if node.tag in BLOCK:
                self._fresh = True

    def _last(self, tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> int:
        """Place among the open elements of the innermost of tags inside the innermost of bounds; 0 if there is none."""
        if not any(self._counts.get(t) for t in tags):
            return 0
        for place in range(len(self._open) - 1, 0, -1):
            tag = self.nodes[self._open[place]].tag
            if tag in tags:
                return place
            if tag in bounds:
                return 0
        return 0

    def _start(self, tag: str, raw: str) -> None:
        if tag in CLOSES_P and (place := self._last({"p"}, {"button", "table", "td", "th", "object", "template"})):
            self._close(place)
        if tag in ENDS:
            while place := self._last(*ENDS[tag]):
                self._close(place)
        if tag in BLOCK:
            self._fresh = True
        elif tag in CELLS and self.segments and not self._fresh:
            self.segments.append((self._open[-1], " ", False, False))
        if tag in VOID:
            return
        attributes = {(m[1] or m[5]).lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw else {}
        words = [w.lower() for w in _WORD.findall(f"{attributes.get('class', '')} | {attributes.get('id', '')}")] if attributes else []
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN_STYLE.search(attributes.get("style", "")))
        role = attributes.get("role", "").lower() in FURNITURE_ROLES
        called = tag not in ("html", "body") and any(w in FURNITURE_WORDS and (i == 0 or words[i - 1] not in HAVING) for i, w in enumerate(words))
        node = Node(tag, self._open[-1], ".".join(words), hidden or role or tag in FURNITURE_TAGS and tag not in ("form", "header"), called or tag in ("form", "header"), len(self.segments))
        self.nodes[node.parent].places.append(len(self.nodes))
        self._open.append(len(self.nodes))
        self._counts[tag] = self._counts.get(tag, 0) + 1
        self.nodes.append(node)

    def _end(self, tag: str) -> None:
        """Ends of elements that are not open count for nothing; those of inline elements do not end blocks."""
        if place := self._last({tag}, frozenset() if tag in BLOCK else BLOCK | {"td", "th"}):
            self._close(place)
        if tag in BLOCK:
            self._fresh = True

    def letters(self) -> list[tuple[int, int]]:
        """Characters before each segment: all, and in links."""
        out, total, linked = [(0, 0)], 0, 0
        for _, text, _, link in self.segments:
            n = len(text) - text.count(" ")
            total, linked = total + n, linked + n * link
            out.append((total, linked))
        return out


def content(page: Page) -> tuple[list[bool], list[int]]:
    """Which elements may hold main text, and the roots of the content: articles, else main elements, else the page itself.

    An element called furniture by its class, and a form or header, is none if it holds such a root; a header inside a root that holds a heading is part of it.
    """
    nodes = page.nodes
    kept = [True] * len(nodes)
    roots: dict[str, list[int]] = {"article": [], "main": []}
    for i, node in enumerate(nodes[1:], 1):
        kept[i] = kept[node.parent] and not node.named
        if kept[i] and node.tag in roots and not node.called:
            roots[node.tag].append(i)
    before = page.letters()
    size = lambda i: before[nodes[i].last][0] - before[nodes[i].first][0]

    holds = [False] * len(nodes)
    headed = [False] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        node = nodes[i]
        holds[i] |= kept[i] and node.tag in roots and not node.called
        headed[i] |= kept[i] and node.tag in ("h1", "h2", "h3")
        holds[node.parent] |= holds[i]
        headed[node.parent] |= headed[i]
    whole, any_root = size(0), bool(roots["article"] or roots["main"])
    inside = [False] * len(nodes)
    for i, node in enumerate(nodes[1:], 1):
        inside[i] = inside[node.parent] or node.tag in roots and not node.called
        if node.called and kept[i]:
            spared = holds[i] or (node.tag == "header" and inside[i] and headed[i] and "comment" not in node.words) or (not any_root and headed[i] and 2 * size(i) >= whole)
            kept[i] = spared and kept[node.parent]
        else:
            kept[i] = kept[i] and kept[node.parent]
    for kind in ("article", "main"):
        found = [i for i in roots[kind] if kept[i] and size(i)]
        if found:
            outer = []
            for i in found:
                if not outer or i >= page.ends[outer[-1]]:
                    outer.append(i)
            return kept, outer
    for i, node in enumerate(nodes[1:], 1):
        if not kept[node.parent]:
            kept[i] = False
        elif kept[i] and node.tag in ("ul", "ol", "div", "section", "p", "table"):
            a, b = before[node.first], before[node.last]
            if b[0] > a[0] and b[1] - a[1] >= MENU_LINKS * (b[0] - a[0]) and sum(nodes[j].tag == "a" for j in range(i, min(page.ends[i], i + 64))) >= 3:
                kept[i] = False
    return kept, [0]


def keys(page: Page) -> list[int]:
    """The node of the host's tree at which each element stands.

    Of like siblings the first two and the last two have places of their own, those between share one.
    """
    out = [number("")] * len(page.nodes)
    for i, node in enumerate(page.nodes):
        like: dict[tuple[str, str], list[int]] = {}
        for j in node.places:
            like.setdefault((page.nodes[j].tag, page.nodes[j].words), []).append(j)
        for name, found in like.items():
            n = len(found)
            for k, j in enumerate(found):
                out[j] = number(out[i], *name, k if k < 2 else k - n if n - k <= 2 else 2)
    return out


def features(page: Page) -> tuple[list[tuple[int, int, int]], int]:
    """(node, kind, feature) of every element that may hold main text, below the roots: its text (kind 0) and the sequence of its children
    (kind 1); and the hash of all text that may be main text, by which copies of an article are told."""
    kept, roots = content(page)
    at, sums = keys(page), [0]
    for i, text, _, _ in page.segments:
        sums.append((sums[-1] + (number(" ".join(text.split())) if kept[i] and not text.isspace() else 0)) & ((1 << 64) - 1))
    whole = lambda i: ((sums[page.nodes[i].last] - sums[page.nodes[i].first]) & ((1 << 64) - 1)) - (1 << 63)
    out = []
    for root in roots:
        for i in range(root + 1, page.ends[root]):
            node = page.nodes[i]
            if not kept[i] or node.tag not in BLOCK or node.first == node.last:
                continue
            out.append((at[i], 0, whole(i)))
            looks = [page.nodes[j].tag for j in node.places if page.nodes[j].tag in BLOCK]
            if looks:
                out.append((at[i], 1, number(*looks)))
    return out, number(*(whole(r) for r in roots))


def main_text(payload: str, gone: set[int]) -> str:
    """Blocks of the main text, one a line, without the branches at the nodes in gone."""
    page = Page(payload)
    kept, roots = content(page)
    if gone:
        at = keys(page)
        for i, node in enumerate(page.nodes[1:], 1):
            kept[i] = kept[i] and kept[node.parent] and not (at[i] in gone and i not in roots)
    lines, ends = [[]], -1
    for root in roots:
        for s in range(max(page.nodes[root].first, 0), page.nodes[root].last):
            i, text, fresh, _ = page.segments[s]
            if fresh or s != ends:
                lines.append([])
            ends = s + 1
            if kept[i]:
                lines[-1].append(text)
    return "\n".join(x for x in (" ".join("".join(line).split()) for line in lines) if x)


def host_of(url: Column) -> Column:
    """The host's name in lower case; empty where the url has none or is null."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, node, n_articles, content, presentation: the nodes of each host's tree with their importance.

    content, presentation: the entropy of the node's texts and of its children's sequences over the host's different articles that have it, as a share of the
    greatest possible; presentation is 0 for nodes without block children. hosts are hashes of names.
    """

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            rows: list[tuple[int, int, int, int, int]] = []
            for host, payload in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                if payload:
                    found, article = features(Page(payload))
                    rows += [(host, *f, article) for f in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(zip(*rows))], ["host", "node", "kind", "feature", "article"])

    rows = pages.select(F.xxhash64(host_of(F.col("url"))).alias("host"), "html").mapInArrow(seen, FEATURES)
    once = rows.distinct()
    counts = once.groupBy("host", "node", "kind", "feature").agg(F.count(F.lit(1)).alias("c"))
    nodes = counts.groupBy("host", "node", "kind").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
    share = F.when(F.col("n") > 1, (F.log("n") - F.col("s") / F.col("n")) / F.log("n")).otherwise(1.0)
    by = lambda kind: F.max(F.when(F.col("kind") == kind, share))
    return nodes.groupBy("host", "node").agg(F.max("n").alias("n_articles"), by(0).alias("content"), F.coalesce(by(1), F.lit(0.0)).alias("presentation"))


def unimportant(tree: DataFrame) -> DataFrame:
    """host, gone: the nodes of each host that are nearly constant in content and presentation over enough different articles."""
    most = tree.groupBy("host").agg(F.max("n_articles").alias("most"))
    low = tree.filter((F.greatest("content", "presentation") < LEAST_IMPORTANCE) & (F.col("n_articles") >= LEAST_PAGES)).join(most, "host").filter(F.col("n_articles") >= LEAST_SHARE * F.col("most"))
    return low.groupBy("host").agg(F.collect_list("node").alias("gone"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page, one line for each block.

    Character references are decoded (HTML's rules, also without a semicolon), white space inside a block (br and table cells included) becomes one space, empty
    blocks go. A null or empty page, or one that is all furniture, has the empty text. Repeated rows and ids are pages of their own (copies of an article count once in the tree); a null url is a host
    of its own name ''. Broken markup follows HTML's rules for unclosed paragraphs, list items and cells; what no element closes ends with the page.
    """
    gone = cut(unimportant(style_tree(pages)), "gone")
    with_gone = pages.select("page_id", "url", "html", F.xxhash64(host_of(F.col("url"))).alias("host")).join(gone, "host", "left").select("page_id", "url", "html", "gone")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            texts = [main_text(h, set(g or ())) if h else "" for h, g in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])
        give_back()

    return with_gone.mapInArrow(read, TEXTS).withColumn("n_chars", F.length("text").cast("bigint"))
