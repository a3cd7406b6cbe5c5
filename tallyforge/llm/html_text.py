"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of style nodes. Every element and
every run of text is one, named by its path of tags with their classes and ids,
equal siblings by their number. Two entropies tell template from content: how
much a node's inner structure varies over its pages (presentation), and how
rarely its texts repeat (content). A branch that is shared by enough pages goes
from each of them if it scores low and nothing below it scores high. Inside an
article only boxes and their parts go, never its running text; what holds an
article stays. Text outside a marked article is kept where the tree finds it to
be content. Elements that are not article by their nature or name (menus,
footers, forms, scripts, adverts, comments) are in the tree as well, and go in
any case. A path on fewer than ``min_pages`` pages of its host is not judged:
there natures, names and the marked article decide alone.

The tree is counted by partial aggregates over (host, path, value), so a host
with a third of all pages is spread like any other; what comes back to a page is
the list of its own judged paths. Equal pages of a host count once. Nodes whose
score cannot matter (roots, an article's running text outside boxes) are not
counted.

Defined cases: null or empty html gives an empty text; a null or unparsable url
is a host of its own name; broken markup is closed where HTML would; rows
repeating an id are extracted one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.columns import col, short_batches
from tallyforge.session import settle

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("head script style noscript template nav header footer aside form button select textarea option "
                       "iframe object svg canvas audio video menu dialog".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody "
                   "tfoot thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What stays whatever its score, and what else of an article does: its headlines and running text.
ROOTS = frozenset("html body article main".split())
RUNNING = HEADINGS | frozenset("p pre blockquote header".split())
#: A start tag of a key's kind ends an open element of the given kinds.
ENDS_OPEN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "body": ("head",)}
#: What an article's own text stands in: no name removes these inside an article.
TEXT_PARTS = RUNNING | frozenset("li dt dd td th tr caption figcaption".split())
#: Elements that are never shown as text.
UNSHOWN = frozenset("head script style noscript template iframe object svg canvas audio video".split())
#: Classes and ids that name what is not the article, as a whole.
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promoted promotion promotions "
    "banner banners sidebar side-bar nav navbar navigation menu menus breadcrumb breadcrumbs foot footer masthead header page-header "
    "site-header cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay comment comments "
    "replies reply disqus share sharing social related recommended recommendation recommendations newsletter subscribe signup login search "
    "pagination pager widget widgets toolbar".split())
#: Parts that such a name may stand before in a longer one, as in comment-list; header, page and the like are too common to.
HOLDERS = frozenset("area bar block body box button buttons container form frame group holder inner item items left link links list outer "
                    "panel right row section slot top unit wrap wrapper".split())
HEADER_OF = frozenset("site page main top global".split())


def is_noise_name(name: str, inside: bool) -> bool:
    """Whether one class or id names noise: as a whole, or outside an article by its last part or by what it is a box of."""
    name = name.lower().replace("_", "-")
    if name in NOISE_NAMES:
        return True
    if inside:
        return False
    first, *middle, last = name.split("-") if "-" in name else (name, "")
    if last in ("header", "foot"):
        return first in HEADER_OF
    return last in NOISE_NAMES or last in HOLDERS and any(part in NOISE_NAMES for part in (first, *middle))


NODES = "page_key long, host string, path long, style long, contents array<long>"
#: A hot path's judgement is dealt to so many parts of its pages.
SALTS = 32
_PARAGRAPH_END = BLOCKS - {"html", "body"}


class Page(HTMLParser):
    """Text blocks of a page in order, each with the nodes above it, and the tree of all nodes."""

    def __init__(self, lists: bool = True):
        super().__init__(convert_charrefs=True)
        self.lists = lists                                # whether natures and names remove elements, or the tree alone does
        self.stack: list[tuple[str, int, bool]] = []      # tag, path, noise
        self.blocks: list[tuple[str, tuple[int, ...], bool, bool]] = []   # text, paths, in article, noise
        self.children: dict[int, dict[str, int]] = {}
        self.order: dict[int, list[str]] = {}
        self.nodes: dict[int, tuple[int, bool]] = {}      # path above, whether the node may go; in document order
        self.holders: set[int] = set()                    # nodes that hold an article
        self.parts: list[str] = []
        self.noise_parts: list[str] = []
        self.articles = 0
        self.found_article = False

    def _node(self, above: int, sign: str, may_go: bool) -> int:
        """The path of a new child, told apart from equal ones before it."""
        same = self.children.setdefault(above, {})
        same[sign] = nth = same.get(sign, 0) + 1
        self.order.setdefault(above, []).append(sign)
        path = xxhash.xxh64_intdigest(f"{above}/{sign}:{nth}") - (1 << 63)
        self.nodes[path] = (above, may_go)
        return path

    def _block(self, parts: list[str], above: list[tuple[str, int, bool]], noise: bool) -> None:
        text = " ".join("".join(parts).split())
        if text:
            inside = self.articles > 0
            leaf = self._node(above[-1][1] if above else 0, "#text", not inside)
            self.blocks.append((text, (*(p for _, p, _ in above), leaf), inside, noise))

    def _flush_noise(self) -> None:
        if self.noise_parts:
            self._block(self.noise_parts, self.stack, True)
            self.noise_parts = []

    def _flush(self) -> None:
        self._flush_noise()
        if self.parts:
            # noise inside a line is not above the line's text
            end = len(self.stack)
            while end and self.stack[end - 1][2]:
                end -= 1
            self._block(self.parts, self.stack[:end], False)
            self.parts = []

    def _pop(self) -> None:
        if self.stack[-1][2]:
            self._flush_noise()
        tag, _, noise = self.stack.pop()
        if tag in ("article", "main") and not noise:
            self.articles -= 1

    def _close_open(self, kinds: tuple[str, ...], stops: frozenset[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in kinds:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i][0] in stops:
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self._flush()
        elif tag in ("br", "td", "th"):
            (self.noise_parts if self.stack and self.stack[-1][2] else self.parts).append(" ")
        if tag in VOID:
            return
        if tag in _PARAGRAPH_END:
            self._close_open(("p",), frozenset(("article", "section", "div", "td", "li", "body", "aside", "footer", "nav")))
        if tag in ENDS_OPEN:
            self._close_open(ENDS_OPEN[tag], frozenset(("ul", "ol", "dl", "table", "select")) - {tag})
        given = {k: v or "" for k, v in attrs}
        names = f"{given.get('class', '')} {given.get('id', '')}".strip()
        above = self.stack[-1] if self.stack else ("", 0, False)
        inside = self.articles > 0
        named = tag not in ROOTS and tag not in HEADINGS and not (inside and tag in TEXT_PARTS)
        noise = above[2] or tag in UNSHOWN or self.lists and (
            tag in NOISE_TAGS or given.get("role", "").lower() in NOISE_ROLES or "hidden" in given or given.get("aria-hidden") == "true"
            or named and any(is_noise_name(n, inside) for n in names.split()))
        if above[2] and tag in HEADINGS and inside and any(t == "header" for t, _, _ in self.stack):
            noise = False                                  # an article's own heading
        sign = ".".join([tag, *sorted(given.get("class", "").split())]) + (f"#{given['id']}" if given.get("id") else "")
        path = self._node(above[1], sign, tag not in ROOTS and (not inside or tag in BLOCKS and tag not in RUNNING))
        self.stack.append((tag, path, noise))
        if tag in ("article", "main") and not noise:
            if not inside:
                self.holders.update(p for _, p, _ in self.stack)
            self.articles += 1
            self.found_article = True

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if any(t == tag for t, _, _ in self.stack):
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        # noise may stand inside a line of text, as a script or a button does
        if not (self.stack and self.stack[-1][2]):
            self.parts.append(data)
        elif self.stack[-1][0] not in ("script", "style"):
            self.noise_parts.append(data)

    def close(self) -> None:
        super().close()
        self._flush()


def parsed(html: str, lists: bool = True) -> Page:
    page = Page(lists)
    page.feed(html)
    page.close()
    return page


def style_nodes(page: Page) -> dict[int, tuple[int, list[int]]]:
    """For each node whose score matters: a hash of its structure, and hashes of the texts below it."""
    matters: dict[int, bool] = {0: False}
    for path, (above, may_go) in page.nodes.items():
        matters[path] = matters[above] or may_go and path not in page.holders
    texts: dict[int, set[int]] = {}
    for text, paths, _, _ in page.blocks:
        if matters[paths[-1]]:
            h = xxhash.xxh64_intdigest(text) - (1 << 63)
            for p in paths:
                if matters[p]:
                    texts.setdefault(p, set()).add(h)
    return {p: (xxhash.xxh64_intdigest(" ".join(page.order.get(p, []))) - (1 << 63), sorted(t)) for p, t in texts.items()}


def main_text(page: Page, low: set[int], high: set[int]) -> str:
    """The page's blocks without noise and low-scoring branches; of what an article does not hold, the high-scoring ones."""
    saved: set[int] = set()
    for p in high:
        while (p := page.nodes[p][0] if p in page.nodes else 0) and p not in saved:
            saved.add(p)
    gone = {p for p in low - saved - page.holders if p in page.nodes and page.nodes[p][1]}
    return "\n".join(text for text, paths, inside, noise in page.blocks
                     if not noise and (inside or not page.found_article or paths[-1] in high) and gone.isdisjoint(paths))


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def importance(nodes: DataFrame, weight: float = 0.9) -> DataFrame:
    """host, path, pages, importance of every style node (0: the same on every page, 1: never repeats)."""
    per_node = nodes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"))
    # entropy of the structures, to the base of the number of pages
    styles = (nodes.groupBy("host", "path", "style").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("s"))
              .select("host", "path", F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log2("m"))).otherwise(1.0).alias("presentation")))
    # a text on n of m pages has the entropy log_m n; the mean is over all its places
    contents = (nodes.select("host", "path", F.explode("contents").alias("content"))
                .groupBy("host", "path", "content").agg(F.count(F.lit(1)).alias("n"))
                .groupBy("host", "path").agg(F.sum("n").alias("places"), F.sum(F.col("n") * F.log2("n")).alias("s")))
    repeated = F.col("s") / (F.col("places") * F.log2("pages"))
    content = F.when(F.col("pages") > 1, 1 - F.coalesce(repeated, F.lit(0.0))).otherwise(1.0)
    return (per_node.join(styles, ["host", "path"]).join(contents, ["host", "path"], "left")
            .select("host", "path", "pages", ((1 - weight) * F.col("presentation") + weight * content).alias("importance")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 8,
            min_importance: float = 0.2, lists: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for every page; without ``lists`` the tree and the marked article decide alone."""
    short_batches(pages.sparkSession)
    html = F.coalesce(col(html_col), F.lit(""))
    rows = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), html.alias("html"), host_of(col(url_col)).alias("host"))
    rows = rows.withColumn("page_key", F.xxhash64("host", "html"))

    def nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_key", pa.int64()), ("host", pa.string()), ("path", pa.int64()), ("style", pa.int64()),
                            ("contents", pa.list_(pa.int64()))])
        for batch in batches:
            out = [{"page_key": k, "host": h, "path": p, "style": s, "contents": c}
                   for k, h, x in zip(*(c.to_pylist() for c in batch.columns)) for p, (s, c) in style_nodes(parsed(x, lists)).items()]
            yield pa.RecordBatch.from_pylist(out, schema)

    # equal pages of a host say nothing about its template
    nodes = settle(rows.select("page_key", "host", "html").mapInArrow(nodes_of, NODES).dropDuplicates(["page_key", "path"]), "style-nodes")
    judged = settle(importance(nodes).filter(F.col("pages") >= min_pages)
                    .select("host", "path", (F.col("importance") < min_importance).alias("is_low")), "style-tree")
    # the judged paths of a page are at most its own
    of_page = (nodes.select("host", "path", "page_key", F.pmod("page_key", F.lit(SALTS)).cast("int").alias("salt"))
               .join(judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "path", "salt"])
               .groupBy("page_key").agg(F.collect_list(F.when(F.col("is_low"), F.col("path"))).alias("low"),
                                        F.collect_list(F.when(~F.col("is_low"), F.col("path"))).alias("high")))

    def text_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(parsed(x, lists), set(low or ()), set(high or ())) for x, low, high in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    pages_type = rows.schema["page_id"].dataType.simpleString()
    return (rows.join(of_page, "page_key", "left").select("page_id", "url", "html", "low", "high")
            .mapInArrow(text_of, f"page_id {pages_type}, url string, text string, n_chars long"))
