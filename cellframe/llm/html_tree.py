"""Main text of web pages by a site style tree.

The DOM trees of a host's pages are merged: an element node is a path of tags (with class or id words), and what pages
show there are its styles. Two entropies say how much a node matters on that site. Presentation: the ways in which pages
arrange the children of the node, -sum p log_m p over the m pages that have it (1 where m is 1). Content: a text block
that k of the m pages share has entropy log k / log m, and the node's content importance is 1 minus the mean over its
blocks. An element's importance is the presentation entropy weighted against the mean of its children's importance,
with weight GAMMA to the power of the number of its child nodes; a leaf's is its content importance. On hosts with
LEAST_PAGES pages or more the own text of nodes below THRESHOLD is removed from each page; what lies deeper goes by its
own nodes, so an article stays in a wrapper whose other text is shared. Nothing inside an article element is removed so:
copied articles would look like a template. Tags, roles and class words that name page furniture
(navigation, footers, forms, adverts, comments and so on) mark presentation nodes on any host; inside an article, of the
words only whole class words of containers do.

The text of a page is what is left: character references decoded, white space inside a block made one space, blocks in
page order joined by line feeds. ``br`` ends a block. Null html gives empty text; null urls form one host; broken markup
is read on as browsers do (unknown closing tags are skipped, open elements end with their parent); repeated pages and
ties are kept; an empty table gives an empty table."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import arrow_batch, arrow_fields, map_rows, text_slices
from cellframe.spark import settle

THRESHOLD, GAMMA, LEAST_PAGES = 0.25, 0.9, 8
#: Largest table of removable branches that goes to every task, in bytes; a larger one is joined by host.
MAX_BROADCAST_BYTES = 8 << 20

# HTML tag names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg object select option button canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img ruby rt rp data "
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder "
    "munderover semantics annotation annotation-xml".split()
)
FURNITURE = frozenset("head nav footer aside form menu dialog fieldset".split())
P_ENDERS = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Class or id words and roles that name furniture.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comment-list commentlist consent cookie cookies "
    "copyright disqus footer header hidden login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo "
    "promoted recommended related replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog form".split())
CONTENT = ("article", "main")
#: Elements whose class words, as a whole, count inside an article.
CONTAINERS = frozenset("article div section ul ol li dl table".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)>|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z][a-z0-9-]*")


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url or "")
    return m[1].lower() if m else ""


class Page:
    """Blocks of a page in order, each with the path of its element and whether page furniture holds it; and for each
    path the arrangements of children."""

    def __init__(self, html: str | None):
        self.blocks: list[tuple[str, str]] = []
        self.styles: set[tuple[str, int]] = set()
        self._stack: list[tuple[str, str, bool, list[str]]] = [("", "", False, [])]
        self._text: list[str] = []
        self._inside = 0  # of article or main
        if html:
            self._read(html)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text = []
            if text:
                self.blocks.append((self._stack[-1][1] if not self._stack[-1][2] else "!", text))

    def _pop(self) -> None:
        self._flush()
        tag, path, noise, children = self._stack.pop()
        if children and not noise:
            self.styles.add((path, zlib.crc32(" ".join(children).encode())))
        self._inside -= tag in CONTENT

    def _open(self, tag: str, attributes: str) -> None:
        self._flush()
        if tag in P_ENDERS:
            self._close("p", ("button", "td", "th", "li", "div", "article", "section"))
        for sibling in SIBLINGS.get(tag, ()):
            self._close(sibling, SCOPES[tag])
        noise, mark = tag in FURNITURE, ""
        if tag == "header":
            noise = not self._inside
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name in ("class", "id"):
                    words = _WORDS.findall(value)
                    mark += "".join("." + w for w in words)
                    if self._inside or tag in CONTENT:
                        noise = noise or name == "class" and tag in CONTAINERS and not NOISE.isdisjoint(value.split())
                    else:
                        noise = noise or tag not in ("html", "body") and any(w in NOISE or NOISE & set(w.split("-")) and w.split("-")[0] not in CONTENT for w in words)
                elif name == "role":
                    noise = noise or value in NOISE_ROLES
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                    noise = True
        parent = self._stack[-1]
        label = tag + mark
        parent[3].append(label)
        self._stack.append((tag, f"{parent[1]}/{label}", noise or parent[2], []))
        self._inside += tag in CONTENT

    def _close(self, tag: str, scope: tuple[str, ...] = ()) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] == tag:
                while len(self._stack) > k:
                    self._pop()
                return
            if self._stack[k][0] in scope:
                return

    def _read(self, html: str) -> None:
        at, n, find = 0, len(html), _MARKUP.search
        lower: str | None = None
        while at < n:
            m = find(html, at)
            if m is None:
                break
            if m.start() > at:
                self._text.append(unescape(html[at : m.start()]))
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag in RAW:
                if not m[1] and not m[3].endswith("/"):
                    lower = lower if lower is not None else html.lower()
                    end = lower.find("</" + tag, at) if len(lower) == n else -1
                    if end < 0:
                        found = re.compile("</" + tag, re.I).search(html, at)
                        end = found.start() if found else -1
                    if end < 0:
                        at = n
                    else:
                        close = html.find(">", end)
                        at = close + 1 if close >= 0 else n
            elif tag == "br":
                self._flush()
            elif tag in INLINE:
                if not m[1] and m[3]:
                    continue
            elif m[1]:
                if any(x[0] == tag for x in self._stack):
                    self._close(tag)
                else:
                    self._flush()
            elif tag in VOID:
                self._flush()
            else:
                self._open(tag, m[3])
        if at < n:
            self._text.append(unescape(html[at:]))
        while len(self._stack) > 1:
            self._pop()
        self._flush()

    def text(self, removed: frozenset[str] | tuple = ()) -> str:
        """Blocks outside furniture whose own element is not removed."""
        return "\n".join(t for p, t in self.blocks if p != "!" and p not in removed)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of pages by (host, path, kind, feature): kind 0 is a path's arrangement, 1 a block of text."""
    fields = arrow_fields("host string, path string, kind int, feature long, pages long")
    counts: Counter = Counter()
    for part in text_slices(batches, 1):
        for url, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
            host, page = host_of(url), Page(html)
            # inside an article no branch is removed, so nothing needs to be known there
            counts.update((host, p, 0, s) for p, s in page.styles if not _in_content(p))
            counts.update({(host, p, 1, zlib.crc32(t.encode())) for p, t in page.blocks if p != "!" and not _in_content(p)})
        if len(counts) > 200_000:
            yield arrow_batch(fields, [(*k, n) for k, n in counts.items()])
            counts.clear()
    if counts:
        yield arrow_batch(fields, [(*k, n) for k, n in counts.items()])


def _in_content(path: str) -> bool:
    return any(step.split(".")[0] in CONTENT for step in path.split("/"))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, pages, presentation, content, importance of the nodes outside articles of each host's merged tree."""
    facts = pages.select("url", "html").mapInArrow(_facts, "host string, path string, kind int, feature long, pages long")
    facts = facts.groupBy("host", "path", "kind", "feature").agg(F.sum("pages").alias("k"))
    size = pages.select(_host(F.col("url")).alias("host")).groupBy("host").agg(F.count("*").alias("m"))
    facts = facts.join(size, "host")
    log_m = F.log(F.col("m").cast("double"))
    share = F.col("k") / F.col("m")
    is_style, is_block = F.col("kind") == 0, F.col("kind") == 1
    nodes = facts.groupBy("host", "path").agg(
        F.max("m").alias("m"),
        F.sum(F.when(is_style & (F.col("m") > 1), -share * F.log(share) / log_m)).alias("presentation"),
        F.sum(F.when(is_block, F.col("k") * F.when(F.col("m") > 1, F.log(F.col("k").cast("double")) / log_m).otherwise(0.0))).alias("_h"),
        F.sum(F.when(is_block, F.col("k"))).alias("_n"),
        F.sum(F.when(is_style, 1)).alias("children"),
    )
    nodes = nodes.select("host", "path", F.col("m").alias("pages"), "presentation", (1 - F.col("_h") / F.col("_n")).alias("content"), "children")
    weight = F.pow(F.lit(GAMMA), F.least(F.col("children"), F.lit(20)))
    own = F.when(F.col("presentation").isNull(), F.coalesce("content", F.lit(1.0))).otherwise(
        (1 - weight) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("presentation"))) + weight * F.coalesce("content", F.col("presentation"))
    )
    return nodes.withColumn("importance", own)


def _host(url):
    plain = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return F.lower(plain)


def removable(tree: DataFrame) -> DataFrame:
    """host, removed: the paths of each host's nodes of low importance. An element goes when all its text does, so the
    paths that hold text are enough, each for the blocks of its own."""
    low = (F.col("importance") < THRESHOLD) & (F.col("pages") >= LEAST_PAGES) & F.col("content").isNotNull() & ~F.col("path").rlike(r"^(/html[^/]*)?(/body[^/]*)?$")
    return tree.filter(low).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("removed"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of (page_id, url, html)."""
    low = settle(removable(style_tree(pages)))
    size = low.agg(F.sum(F.length(F.concat_ws("", "removed")) + F.length("host") + 16).alias("b")).first()["b"] or 0
    keyed = pages.select("page_id", "url", "html").withColumn("host", _host(F.col("url")))
    rows = keyed.join(F.broadcast(low) if size <= MAX_BROADCAST_BYTES else low, "host", "left")

    def start():
        def row(page_id, url, html, removed):
            text = Page(html).text(frozenset(removed or ()))
            return [(page_id, url, text, len(text))]

        return row

    return map_rows(rows.select("page_id", "url", "html", "removed"), "page_id long, url string, text string, n_chars long", start)
