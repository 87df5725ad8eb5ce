"""Main text of web pages: semantic rules and site template removal.

``parse`` walks a page once, with an element stack, and gives its text blocks with the elements
around each, and a hash of each element's subtree (tag, texts, children).  ``extract`` counts those
hashes per host, those of paragraphs, headings and parts that go by a rule too, over pages of
different content and deletes subtrees that recur on a share of the host's pages (a larger one inside
an article or main part, where a sentence may be common without being a template); beside that, what
is a menu, form, advert, notice, comment and the like by its tag, role, class or id goes.  If a page
has an article (else a main part), only what lies inside it is text.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|type|style)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math canvas object textarea select title xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption head search".split())
DROP = frozenset("nav footer aside form head menu dialog button audio video search datalist".split())
WRAPS = frozenset("html body main article".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
JUNK = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login sidebar rail menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead social share sharing sharebar related recommended recommendations widget widgets toolbar pagination pager skip alert".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
SCOPE = frozenset("table ul ol dl menu html body article main section div td th".split())


class Page:
    """Blocks [(text, open elements)], per element its hash (0: no candidate) and whether it is inside an article or main part."""

    __slots__ = ("blocks", "hashes", "inner")

    def __init__(self):
        self.blocks, self.hashes, self.inner = [], [], []


def _junk(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element goes by its rules, and whether that is final (an article inside it goes too)."""
    if tag in DROP or tag == "header" and not in_article:
        return True, True
    if not attrs:
        return False, False
    words: set[str] = set()
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role":
            if value.strip().lower() in ROLES and tag not in WRAPS:
                return True, True
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            if tag not in ("html", "body"):
                return True, True
        elif name == "style":
            if _GONE.search(value) and tag not in ("html", "body"):
                return True, True
        elif name != "type":
            words.update(_WORD.findall(_CAMEL.sub(" ", value).lower()))
    if tag in ("html", "body", "main"):
        return False, False
    if words & COMMENTS:
        return True, True
    if tag == "article":
        return bool(words & {"ad", "ads", "advert", "sponsored", "promo"}), True
    return bool(words & JUNK) or "header" in words and not in_article and "site" in words, False


def parse(html: str, hashing: bool = True, rules: bool = True) -> Page:
    """Parse one page; ``hashing`` fills the subtree hashes; without ``rules`` nothing goes by tag, role, class or id.

    Broken markup is taken as it comes: unclosed paragraphs and list items end at the next one, an
    end tag without a start is ignored, a ``<`` that starts no tag is text.
    """
    import xxhash

    page, stack = Page(), []  # entries: [tag, index, junk, final, parts, had_text, holds_main]
    buffer: list[str] = []
    articles = mains = hidden = 0  # open ones; hidden: open inline elements that go by their rules
    blocks, hashes, inner = page.blocks, page.hashes, page.inner
    found_article = found_main = False
    digest = xxhash.xxh64_intdigest

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    def flush():
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                junk = any(e[2] for e in stack)
                around = tuple(e[1] for e in stack)
                if hashing and stack and stack[-1][0] in WRAPS:  # no block of its own: the run of text is one
                    around += (len(hashes),)
                    hashes.append(signed(digest(f"#text\x00{text}")))
                    inner.append(articles > 0 or mains > 0)
                blocks.append((text, around, articles > 0, mains > 0, junk))
                if hashing and stack:
                    stack[-1][4].append(text)
                    stack[-1][5] = True

    def close():
        nonlocal articles, mains, hidden
        if stack[-1][0] in BLOCK:
            flush()
        tag, index, junk, _, parts, had, holds = stack.pop()
        if junk and tag not in BLOCK:
            hidden -= 1
        if tag == "article" and not junk:
            articles -= 1
        elif tag == "main":
            mains -= 1
        if hashing:
            h = digest("\x00".join([tag, *parts])) if parts else 0
            if stack:
                up = stack[-1]
                up[4].append(f"{tag}:{h}")
                up[5] |= had
                up[6] |= holds or tag in WRAPS
            if had and not holds and tag not in WRAPS and tag in BLOCK:
                hashes[index] = signed(h)

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            if not hidden:
                buffer.append(html[at:])
            break
        if m.start() > at and not hidden:
            buffer.append(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:  # an end tag
            if tag in BLOCK:
                flush()
            if tag == "p" and not any(e[0] == "p" for e in stack):
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    while len(stack) > k:
                        close()
                    break
                if stack[k][0] in SCOPE and tag not in BLOCK:
                    break
            continue
        attrs = m[3] or m[6] or ""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if not attrs.endswith("/") or tag in ("script", "style"):
                at = end.end() if end else n
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                buffer.append(" " if tag in ("br", "img", "wbr") and tag != "wbr" else "")
            continue
        if tag in BLOCK:
            flush()
            ends = CLOSES.get(tag, ()) + (("p",) if tag not in ("html", "body", "head") else ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    while len(stack) > k:
                        close()
                    ends = tuple(e for e in ends if e not in ("li",))
                    if not ends:
                        break
                elif stack[k][0] in SCOPE:
                    break
            if tag == "body":
                while stack and stack[-1][0] == "head":
                    close()
        junk, final = _junk(tag, attrs, articles > 0) if rules else (False, False)
        if tag in ("article", "main") and not junk and not any(e[3] and e[2] for e in stack):
            hidden = 0
            for e in stack:
                e[2] = False  # a wrapper named after its sidebar or banner is no such thing
        if tag == "article" and not junk:
            articles += 1
            found_article = found_article or not any(e[2] for e in stack)
        elif tag == "main":
            mains += 1
            found_main = found_main or not any(e[2] for e in stack)
        if junk and tag not in BLOCK:
            hidden += 1
        stack.append([tag, len(hashes), junk, final, [], False, False])
        hashes.append(0)
        inner.append(articles > 0 or mains > 0)
    flush()
    while stack:
        close()
    if found_article and rules:
        page.blocks = [b for b in blocks if b[2] and not b[4]]
    elif found_main and rules:
        page.blocks = [b for b in blocks if b[3] and not b[4]]
    else:
        page.blocks = [b for b in blocks if not b[4]]
    return page


def main_text(html: str | None, removed: dict[int, bool] | None = None, rules: bool = True) -> str:
    """Text of a page without the subtrees whose hashes are in ``removed``: true for everywhere, false for outside articles and main parts."""
    if not html:
        return ""
    page = parse(html, bool(removed), rules)
    gone = {k for k, h in enumerate(page.hashes) if h and h in removed and (removed[h] or not page.inner[k])} if removed else set()
    return "\n".join(b[0] for b in page.blocks if not gone.intersection(b[1]))


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def template_hashes(pages: DataFrame, min_pages: int = 4, share: float = 0.1, inner_share: float = 0.5, url_col: str = "url", html_col: str = "html", key: str = "_key", rules: bool = True):
    """Subtrees around text that would stay ``(key, host, kept)``, and the recurring ``(host, hash, everywhere)``.

    A subtree recurs if at least ``min_pages`` different pages of its host hold it, in what would
    stay or not, and at least ``share`` of the host's different pages do; ``everywhere`` if at least
    ``inner_share`` of them do.  Pages differ if the texts that would stay do: many copies of one page
    count as one.  Pages without a host or markup have no candidates.
    """

    def run(batches):
        import xxhash

        for batch in batches:
            rows = []
            for k, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                host = host_of(url)
                if not html or not host:
                    continue
                page = parse(html, rules=rules)
                content = xxhash.xxh64_intdigest("\n".join(b[0] for b in page.blocks) or html) >> 1
                kept = {page.hashes[i] for b in page.blocks for i in b[1]} - {0}
                rows.append((k, host, content, list({0, *page.hashes}), list(kept)))  # 0 stands for the page itself
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "host", "content", "hashes", "kept"])

    found = cut(pages.select(F.col(key).cast("string"), F.col(url_col), F.col(html_col)).mapInArrow(run, "key string, host string, content long, hashes array<long>, kept array<long>"))
    counts = found.select("host", "content", F.explode("hashes").alias("hash")).distinct().groupBy("host", "hash").count()
    often = cut(counts.where(F.col("count") >= min_pages))
    total = often.where("hash = 0").select("host", F.col("count").alias("total"))
    recurring = often.where("hash != 0").join(total, "host").where(F.col("count") >= share * F.col("total"))
    return found.select("key", "host", "kept"), cut(recurring.select("host", "hash", (F.col("count") >= inner_share * F.col("total")).alias("everywhere")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 4, share: float = 0.1, inner_share: float = 0.5, most: int = 20_000, rules: bool = True) -> DataFrame:
    """``(id_col, url_col, text)`` of each page: its main text, blocks joined by one line feed.

    Character references are decoded once, white space inside a block becomes one space, and empty
    blocks go.  Null or empty html gives an empty text; a null url only means that no template is
    known; repeated rows and null ids each give a row.  Up to ``most`` recurring subtrees go to every
    task; beyond that they are joined by key (salted, since one subtree may be on a third of all
    pages), with the same result.  Without ``rules`` only recurring subtrees, scripts and styles go.
    """
    row = (id_col, url_col, html_col)
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.concat_ws("-", F.hex(F.xxhash64(*row)), F.hex(F.xxhash64(F.lit(1), *row))).alias("_key"))
    found, recurring = template_hashes(slim, min_pages, share, inner_share, "url", "html", rules=rules)
    few, table = recurring.limit(most + 1).collect(), {}
    if len(few) <= most:
        for r in few:
            table.setdefault(r["host"], {})[r["hash"]] = r["everywhere"]
        work = slim.select("id", "url", "html", F.lit(None).cast("map<bigint,boolean>").alias("gone"))
    else:
        salts = F.explode(F.array(*map(F.lit, range(16)))).alias("salt")
        mine = found.select("key", "host", F.explode("kept").alias("hash"), F.pmod(F.xxhash64("key"), F.lit(16)).cast("int").alias("salt"))
        hits = mine.join(recurring.select("*", salts), ["host", "hash", "salt"]).select("key", "hash", "everywhere").distinct()
        gone = cut(hits.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("hash", "everywhere"))).alias("gone")))  # at most one page's subtrees
        work = slim.join(gone, slim["_key"] == gone["key"], "left").select("id", "url", "html", "gone")
    kind = work.schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [main_text(h, dict(g) if g else table.get(host_of(u)), rules) for u, h, g in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    out = work.mapInArrow(run, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
