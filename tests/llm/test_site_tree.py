"""Main text of pages: markup rules by hand, the tree's entropies by brute force, whole tables by a second parser."""

import math
import random
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from sparkloom.llm import queries, site_tree

PAGES = "page_id bigint, url string, html string, text string, host int"


class ArticleLines(HTMLParser):
    """Lines of the article element, for pages whose only block elements in it are p and h1."""

    def __init__(self):
        super().__init__()
        self.inside, self.lines = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1"):
            self.lines.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.lines.append("")

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "t", 1) for i, u, h in rows], PAGES)


def texts(df):
    return {r["page_id"]: r["text"] for r in site_tree.extract(df).collect()}


def test_query_equals_a_second_parser(spark):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        parser = ArticleLines()
        parser.feed(r["html"])
        parser.close()
        want[r["page_id"], r["url"]] = "\n".join(x for x in (" ".join(line.split()) for line in parser.lines) if x)
    out = queries.op12_html_extraction(spark, sf).collect()
    assert {(r["page_id"], r["url"]): r["text"] for r in out} == want and len(out) == len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in out)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &lt;b&gt; text &amp more &#233;&#x20AC;&nbsp;end", "plain <b> text & more é€ end"),
        ("<p>one<p>two\n three<br>four", "one\ntwo three four"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("<p>a <b>bold</b>,<i> it</i></p>", "a bold, it"),
        ("<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>", "x\ny\n1 2\n3"),
        ("<script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style><!-- <p>no</p> --><p>yes", "yes"),
        ("<p>kept</p><script>never closed <p>no", "kept"),
        ("<p>2 < 3 and a<b</p>", "2 < 3 and a"),
        ("<p title='a > b' data-x=\"<p>\">yes</p>", "yes"),
        ('<p title="open>yes</p><p>more</p>', "yes\nmore"),
        ("<p>a</p></div></b></i><p>b</p><!-- open", "a\nb"),
        ("<nav><a href=/>Home</a></nav><article><h1>T</h1><p>body</p></article><footer>c", "T\nbody"),
        ("<header><h1>Site</h1></header><main><header><h1>T</h1></header><p>body</p><aside>no</aside><form><p>no</p></form></main>", "T\nbody"),
        ("<body class='has-sidebar'><div id=sidebar>no</div><div class='post with-comments'><h1>T</h1><p>body text that is long</p></div><section class=comments><article class=comment>no</article></section>", "T\nbody text that is long"),
        ("<form id=aspnet><article><p>yes</p></article><div class='cookie-notice'>no</div></form>", "yes"),
        ("<article><p>yes</p><div class=ad>no</div><div hidden>no</div><p style='display:none'>no</p><div role=dialog>no</div></article><p>outside</p>", "yes"),
        ("<article><p>one</p></article><article><p>two</p></article>", "one\ntwo"),
        ("<nav><a>Home</a><article><p>yes</p></article>", "yes"),
        ("<ul><li><a href=1>a b</a><li><a href=2>c d</a><li><a href=3>e f</a></ul><p>text <a href=4>link</a> text</p>", "text link text"),
        ("<nav>all</nav><footer>furniture</footer>", ""),
    ],
)
def test_markup(page, text):
    assert site_tree.main_text(page, set()) == text


def site(n, notice="Read more on our partners' pages", copies=0):
    rnd = random.Random(n)
    body = lambda k: "".join(f"<p>{' '.join(rnd.choice('abcdefgh') * rnd.randint(1, 5) for _ in range(6))} {k}</p>" for _ in range(rnd.randint(2, 5)))
    copied = "<p>same article</p><p>same end</p>"
    return [f"<div><div>top line</div><div><h2>title {k if k >= copies else 'same'}</h2>{body(k) if k >= copies else copied}<div>{notice}</div></div></div>" for k in range(n)]


def test_the_tree_removes_what_is_constant_and_keeps_copies(spark):
    pages = [(k, f"http://a.example/{k}", h) for k, h in enumerate(site(40, copies=25))]
    pages += [(100 + k, f"http://Small.example/{k}", h) for k, h in enumerate(site(3))]
    out = texts(frame(spark, pages))
    assert all("partners" not in out[k] and "top line" not in out[k] and f"title {k if k >= 25 else 'same'}" in out[k] for k in range(40))
    assert all(out[k] == "title same\nsame article\nsame end" for k in range(25))
    assert all("partners" in out[100 + k] for k in range(3))  # too few articles to tell


def test_entropies_equal_brute_force(spark):
    pages = [(k, f"http://h{k % 2}.example/", h) for k, h in enumerate(site(30, copies=6) + site(12)[:4] * 3)]
    seen = defaultdict(set)
    for _, url, payload in pages:
        rows, article = site_tree.features(site_tree.Page(payload))
        for node, kind, feature in rows:
            seen[url[7:9], node, kind].add((feature, article))
    got = Counter()
    for r in site_tree.style_tree(frame(spark, pages)).collect():
        got[r["n_articles"], round(r["content"], 6)] += 1
    contents = Counter()
    for (_, _, kind), found in seen.items():
        if kind == 0:
            n = len(found)
            h = -sum(c / n * math.log(c / n) for c in Counter(f for f, _ in found).values())
            contents[n, round(h / math.log(n), 6) if n > 1 else 1.0] += 1
    assert got == contents


def test_nulls_repeats_long_pages_and_empty_tables(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 40000 + "</article>"
    deep = "<div>" * 30000 + "deep" + "<b>" * 30000
    rows = [(1, None, None), (1, None, "<p>a</p>"), (None, "", ""), (2, "no url", "<p>b</p>"), (2, "no url", "<p>b</p>"), (3, "http://x/", long), (4, "http://x/", deep)]
    out = sorted(((r["page_id"], r["url"], r["text"][:9], r["n_chars"]) for r in site_tree.extract(frame(spark, rows)).collect()), key=repr)
    want = [(1, None, "", 0), (1, None, "a", 1), (None, "", "", 0), (2, "no url", "b", 1), (2, "no url", "b", 1), (3, "http://x/", "word & wo", 12 * 40000 - 1), (4, "http://x/", "deep", 4)]
    assert out == sorted(want, key=repr)
    assert site_tree.extract(frame(spark, [])).collect() == []
