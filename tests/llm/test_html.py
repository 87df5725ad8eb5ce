"""Main text of pages: rules, broken markup and site templates."""

import random
from html.parser import HTMLParser

import pytest

from gradewell.llm import html, queries

SF = "/root/testdata/sf0.01"

CASES = [
    ("", ""),
    ("plain &lt;text&gt;", "plain <text>"),
    ("<p>a &amp;amp; b<p>c<br>d", "a &amp; b\nc d"),
    ("<nav>x</nav><header>y</header><article><header><h1>T</h1></header><p> a\n b </p><footer>f</footer></article><footer>z</footer>", "T\na b"),
    ('<div class="page has-sidebar"><article><p>in</p><div class="ad">buy</div></article><div class="sidebar">s</div></div>', "in"),
    ('<article><p>a</p></article><section id="comments"><article><p>reader</p></article></section>', "a"),
    ('<article><p>a</p><div class="comment-list"><p>reader</p></div></article>', "a"),
    ("<main><h1>H</h1><p>m</p></main><p>out</p>", "H\nm"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>", "x\ny\nz"),
    ("<p>1 < 2 and <b>bold</b>er</p><script>var t='</p><p>no';</script><style>p{}</style>", "1 < 2 and bolder"),
    ('<p title="a > b">t</p><!-- <p>no</p> --><p>u', "t\nu"),
    ('<form><p>no</p></form><div role="navigation">no</div><div hidden>no</div><div class="cookie-notice">no</div><p>yes</p>', "yes"),
    ('<p data-hidden="no" data-class="ad">seen</p><p style="color:red; display: none">no</p><input type="hidden" value="x"><p>also', "seen\nalso"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("</p></div><p>x</b>y</p>", "xy"),
    ('<a href="x', '<a href="x'),
    ("<p>&nbsp;a&#233;&eacute;&#x1F600; &bogus;</p>", "aéé\U0001f600 &bogus;"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_pages(page, text):
    assert html.main_text(page) == text


def test_query_gives_the_documents_back(spark):
    docs = {"\n".join(" ".join(x.split()) for x in r.text.split("\n") if x.strip()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()}
    rows = queries.op8_html_extraction(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    for r in rows:  # a heading, then a document's paragraphs
        assert r.n_chars == len(r.text) and r.text.split("\n", 1)[1] in docs


def test_templates_of_a_site_go(spark):
    bar = "<div><span>Our site</span><ul><li>Home<li>News</ul></div>"
    page = lambda k, host: (k, f"https://{host}/{k}", f"<title>t{k}</title><body>{bar}<div><p>Story {k}</p><p>Same words here</p></div></body>", 1)
    rows = [page(k, "big.example") for k in range(12)] + [page(100 + k, "small.example") for k in range(3)]
    rows += [(200 + k, f"https://copies.example/{k}", "<title>one</title><div><div>part</div><p>copied story</p></div>", 1) for k in range(30)]
    rows += [(None, None, None, 1), (None, None, None, 1), (300, None, "<p>no host", 1), (301, "https://big.example/x", "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got[3] == "Story 3"  # the bar and the repeated paragraph recur under many titles
    assert got[101] == "Our site\nHome\nNews\nStory 101\nSame words here"
    assert got[205] == "part\ncopied story"  # copies of one page are no template
    assert (got[None], got[300], got[301]) == ("", "no host", "")
    assert html.extract(pages).count() == len(rows) and html.extract(pages.limit(0)).count() == 0


def test_recurring_blocks_in_articles_go(spark):
    common = "<h2>Stay close</h2><p>Write to <b>us</b></p><blockquote>Said often</blockquote>Loose words"
    rows = [(k, f"https://a.example/{k}", f"<title>t{k}</title><article><h1>Head {k}</h1><p>Story {k}</p>{common}</article>") for k in range(10)]
    menu = "<ul><li>Home</li></ul>"  # a rule drops it on nine pages, only recurrence on the tenth
    rows += [(20 + k, f"https://b.example/{k}", f"<title>t{k}</title><nav>{menu}</nav><p>Tale {k}</p>" if k else f"<title>t0</title>{menu}<p>Tale 0</p>") for k in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (20_000, 0):  # to every task, and joined by key
        got = {r.page_id: r.text for r in html.extract(pages, most=most).collect()}
        assert got == {k: f"Head {k}\nStory {k}" for k in range(10)} | {20 + k: f"Tale {k}" for k in range(10)}


def test_share_of_a_hosts_pages(spark):
    bar, part = "<div><span>Our site</span></div>", "<p>Shared by some</p>"
    page = lambda k, host, title, extra: (k, f"https://{host}/{k}", f"<title>{title}</title><body>{bar}<p>Story {k}</p>{extra}</body>")
    rows = [page(k, "small.example", f"t{k}", "") for k in range(4)]
    rows += [page(100 + k, "same.example", "The site", "") for k in range(20)]
    rows += [page(1000 + k, "hot.example", f"t{k}", part if k < 99 else "") for k in range(1000)]
    rows += [page(3000 + k, "hot2.example", f"t{k}", part if k < 100 else "") for k in range(1000)]
    rows += [(5000 + k, f"https://copies.example/{k}", f"<title>t{k}</title><body>{bar}<p>One story</p></body>") for k in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert [got[k] for k in (0, 3, 100, 119)] == ["Story 0", "Story 3", "Story 100", "Story 119"]
    assert (got[1000], got[1999]) == ("Story 1000\nShared by some", "Story 1999")  # 99 of 1000 are not many
    assert (got[3000], got[3999]) == ("Story 3000", "Story 3999")
    assert got[5000] == "Our site\nOne story"  # one page, whatever its titles


def test_common_sentences_of_articles_stay(spark):
    """Inside articles half of a host's pages must share a block, outside a tenth."""
    said, notice = "<p>Said by some</p>", "<p>Write to us</p>"
    page = lambda k: (k, f"https://a.example/{k}", f"<div>Top</div><article><p>Story {k}</p>{said if k < 12 else ''}{notice if k < 20 else ''}</article>")
    pages = spark.createDataFrame([page(k) for k in range(40)], "page_id long, url string, html string")
    for most in (20_000, 0):
        got = {r.page_id: r.text for r in html.extract(pages, most=most).collect()}
        assert (got[3], got[15], got[30]) == ("Story 3\nSaid by some", "Story 15", "Story 30")


class Tree(HTMLParser):
    """Every element of a well-formed page as (tag, parts): a plain tree."""

    def __init__(self):
        super().__init__()
        self.stack, self.raw = [["", []]], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "noscript"):
            self.raw += 1
        elif tag not in html.VOID:
            self.stack.append([tag, []])

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title", "noscript"):
            self.raw -= 1
        elif tag not in html.VOID:
            done = self.stack.pop()
            assert done[0] == tag
            self.stack[-1][1].append((done[0], tuple(done[1])))

    def handle_data(self, data):
        if not self.raw and data.split():
            self.stack[-1][1].append(" ".join(data.split()))


def subtrees(node, out):
    """Candidates: block elements with text that hold no article, main or body; says whether there is text, and a wrapper."""
    tag, parts = node
    text = wrap = False
    for p in parts:
        t, w = (True, False) if isinstance(p, str) else subtrees(p, out)
        text, wrap = text or t, wrap or w
    if text and not wrap and tag in html.BLOCK and tag not in html.WRAPS:
        out.add(node)
    return text, wrap or tag in html.WRAPS


def test_recurring_subtrees_against_plain_counts(spark):
    """Lists and paragraphs that a quarter of a host's pages share, counted over plain trees."""
    rng = random.Random(4)
    menus = [f"<nav><ul>{''.join(f'<li><a href=x>{h} {k}</a></li>' for k in range(4))}</ul></nav>" for h in range(5)]
    foots = [f"<div class=x><p>Foot {k}</p><section>Part <b>{k}</b></section></div>" for k in range(6)]
    rows = []
    for i in range(300):
        host = rng.randrange(5)
        own = "".join(f"<p>Page {i} part {j}</p>" for j in range(rng.randrange(1, 4)))
        rows.append((i, f"https://h{host}.example/{i}", f"<html><body>{menus[host] if rng.random() < 0.6 else ''}<article><h1>Title {i}</h1>{own}{rng.choice(foots)}</article>{rng.choice(foots)}</body></html>"))
    want, pages_of, seen = {}, {}, {}
    for i, url, page in rows:
        tree = Tree()
        tree.feed(page)
        found = set()
        for n in tree.stack[0][1]:
            subtrees(n, found)
        host = html.host_of(url)
        pages_of[host] = pages_of.get(host, 0) + 1
        for f in found:
            seen[host, f] = seen.get((host, f), 0) + 1
    for (host, f), n in seen.items():
        if n >= 4 and n >= 0.1 * pages_of[host]:
            want.setdefault(host, []).append(n >= 0.5 * pages_of[host])
    table = spark.createDataFrame(rows, "_key long, url string, html string")
    got = {}
    for r in html.template_hashes(table)[1].collect():
        got.setdefault(r.host, []).append(r.everywhere)
    assert {h: sorted(v) for h, v in got.items()} == {h: sorted(v) for h, v in want.items()} and sum(map(len, want.values())) > 60


def test_templates_alone(spark):
    """Without the rules on tags and names, what recurs still goes, and what differs from page to page stays."""
    page = lambda k: (k, f"https://a.example/{k}", f"<body><nav><ul><li>Home<li>News</ul></nav><nav><p>Own menu {k}</p></nav><article><p>Story {k}</p></article><footer>All rights</footer></body>")
    pages = spark.createDataFrame([page(k) for k in range(8)], "page_id long, url string, html string")
    assert {r.text for r in html.extract(pages, rules=False).collect()} == {f"Own menu {k}\nStory {k}" for k in range(8)}
    assert {r.text for r in html.extract(pages).collect()} == {f"Story {k}" for k in range(8)}


def test_deep_and_long_pages():
    assert html.main_text("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert html.main_text("<p>" + "word " * 200_000) == ("word " * 200_000).strip()
    assert html.main_text("<" * 20_000) == "<" * 20_000
