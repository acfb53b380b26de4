"""HTML extraction by a site style tree (operator 9).

The DOMs of a host's pages are merged by path: an element node of the tree is a path of tags
with their classes and ids. Over the pages that have it, a node has a presentation importance,
the entropy of its child tags, and a content importance, the entropy of its text, each divided
by the log of the number of pages; what looks the same on every page scores 0, what differs on
each scores 1. Branches of low importance are removed from each page, and the remaining blocks
are its main text.

Entropy alone would drop an article that a site repeats and keep adverts that change, so marks
count too. Elements that say they are menus, adverts, forms, comments and so on go. What an
``article`` or ``main`` holds is measured against that element's own importance, so that a
repeated article stays while a box that is alike in all articles goes; its headings and
paragraphs stay.

A null page is empty and gives an empty text; pages without a host share one tree. Repeated
rows are extracted each by itself and counted each in the tree. Elements nested deeper than
``DEEPEST`` become siblings, as in browsers; their text stays. Time is linear in a page's length.
"""

from __future__ import annotations

import html as entities
import re

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._base import map_rows, table, text_of
from palimpsest.sources.store import Store

NAME = "op9_html_extraction"
#: A branch goes if its importance is below LOW on a site with LEAST_PAGES pages that have it.
LOW, LEAST_PAGES = 0.3, 8
#: The share of content in a node's importance; the rest is presentation.
CONTENT = 0.9
DEEPEST = 512

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead caption tr ul".split()
)
CELL = frozenset(("td", "th", "br"))
#: What a start tag ends: the open elements of these names, up to the nearest of the walls.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
WALLS = ("button", "td", "th", "caption", "table", "article", "section", "div", "body")
GONE = frozenset(
    "head title script style noscript template nav aside footer form button select textarea input iframe object svg canvas "
    "audio video dialog menu xmp noembed noframes map embed".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Inside a main element only such elements may go: boxes, not its headings and paragraphs.
BOX = frozenset("div section ul ol dl table figure details fieldset center span".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login search social share sharing related recommended recommendations comment comments disqus "
    "respond widget widgets toolbar pager pagination copyright".split()
)


class Node:
    """An element: its path, the path of the main element around it, and what its marks say."""

    __slots__ = ("tag", "path", "drop", "main", "within", "box", "kids")

    def __init__(self, tag: str, path: int, drop: bool, main: bool, within: int = 0, box: bool = False):
        self.tag, self.path, self.drop, self.main, self.within, self.box, self.kids = tag, path, drop, main, within, box, []


def _path(parent: int, tag: str, name: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{parent}/{tag} {name}") >> 1


class _Open:
    """The open elements, with the places of each tag: every question takes the same time at any depth."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def last(self, tags) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        for node in reversed(self.stack[at:]):
            self.places[node.tag].pop()
        del self.stack[at:]


def _drops(tag: str, attrs: dict, name: str, inside: bool, main: bool) -> bool:
    """Do an element's marks say that it is no main text."""
    return (
        tag in GONE
        or (tag == "header" and not inside)
        or attrs.get("role", "").lower() in ROLES
        or "hidden" in attrs
        or attrs.get("aria-hidden") == "true"
        or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        or (not main and tag not in ("html", "body") and not NOISE.isdisjoint(re.split(r"[^a-z0-9]+", name)))
    )


def parse(page: str) -> list[Node]:
    """The DOM as its elements in page order, the root first; they hold elements and texts.

    End tags may be missing anywhere.
    """
    nodes = [Node("#root", 0, False, False)]
    here = _Open(nodes[0])
    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            here.stack[-1].kids.append(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if place := here.last((tag,)):
                here.cut(place)
            continue
        attrs = {a.lower(): (v or w or x) for a, v, w, x in reversed(ATTRIBUTE.findall(m[3]))} if m[3].strip() else {}
        ends, walls = CLOSES.get(tag) or ((("p",), WALLS) if tag in BLOCK else ((), ()))
        if ends and (place := here.last(ends)) > here.last(walls):
            here.cut(place)
        if len(here.stack) > DEEPEST:
            here.cut(DEEPEST)
        above = here.stack[-1]
        name = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
        main = tag in ("article", "main") or attrs.get("role", "").lower() == "main" or attrs.get("itemprop", "").lower() == "articlebody"
        drop = _drops(tag, attrs, name, here.last(("article", "main")) > 0, main)
        within = above.path if above.main else above.within
        node = Node(tag, _path(above.path, tag, " ".join(sorted(set(name.split())))), drop, main, within, not main and (not within or tag in BOX))
        above.kids.append(node)
        nodes.append(node)
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = end.start() if end else len(page)
        elif tag not in VOID:
            here.push(node)
    return nodes


B64, M64 = 0x9E3779B97F4A7C15, (1 << 64) - 1


def styles(nodes: list[Node]) -> dict[int, tuple[int, bool, int, int]]:
    """By path: the path of the main element around it, whether it may go, and hashes of its child
    tags and of its text, all of the page's elements there together, in page order.

    A text's hash is a polynomial over its parts, so an element's is put together from its
    children's, last elements first.
    """
    held: dict[int, tuple[int, int]] = {}
    out: dict[int, list] = {}
    for n in reversed(nodes):
        total, power, tags = 0, 1, []
        for k in n.kids:
            if isinstance(k, str):
                text = " ".join(entities.unescape(k).split())
                h, p = (xxhash.xxh3_64_intdigest(text), B64) if text else (0, 1)
            else:
                h, p = held.pop(id(k))
                tags.append(k.tag)
            total, power = (total * p + h) & M64, power * p & M64
        held[id(n)] = total, power
        if n.tag in ("#root", "html", "body"):
            continue
        shape = xxhash.xxh3_64_intdigest(" ".join(tags))
        seen = out.setdefault(n.path, [n.within, n.box and not n.drop, 0, 1, 0, 1])
        seen[2], seen[3] = (shape * seen[3] + seen[2]) & M64, seen[3] * B64 & M64
        seen[4], seen[5] = (total * seen[5] + seen[4]) & M64, seen[5] * power & M64
    return {path: (within, box, shape >> 1, words >> 1) for path, (within, box, shape, _, words, _) in out.items()}


def _mains(root: Node) -> list[Node]:
    """The topmost elements that claim the main content; within one, its only article."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        for k in reversed(node.kids):
            if isinstance(k, Node) and not k.drop and not k.main:
                todo.append(k)
            elif isinstance(k, Node) and not k.drop:
                inner = _mains(k) if k.tag != "article" else []
                found.append(inner[0] if len(inner) == 1 else k)
    return found


def main_text(page: str, noise: frozenset = frozenset()) -> str:
    """The blocks of the main content, without the branches whose paths are in ``noise``."""
    root = parse(page)[0]
    blocks: list[str] = []
    line: list[str] = []

    def flush():
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    todo: list = [*reversed(_mains(root) or [root])]
    while todo:
        k = todo.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            line.append(k)
        elif not (k.drop or k.path in noise):
            if k.tag in CELL:
                line.append(" ")
            if k.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(k.kids)
    flush()
    return "\n\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1)


def _keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, html, host, page): pages of a host with the same html share the key ``page``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    return rows.withColumn("page", F.unhex(F.md5(F.concat_ws("\n", "host", "html"))))


def page_styles(rows: DataFrame) -> DataFrame:
    """(page, host, path, within, box, shape, words) of every element node of rows (page, host, html)."""

    def make():
        def f(pages, hosts, texts):
            found = [(p, h, path, *node) for p, h, t in zip(pages, hosts, texts) for path, node in styles(parse(t)).items()]
            return list(zip(*found)) or [[]] * 7

        return f

    return map_rows(rows, ["page", "host", "html"], make, "page binary, host string, path long, within long, box boolean, shape long, words long")


def style_tree(seen: DataFrame) -> DataFrame:
    """(host, path, within, box, pages, presentation, content, importance) of every node of every site."""
    kinds = F.explode(F.array(F.struct(F.lit("shape").alias("kind"), F.col("shape").alias("value")), F.struct(F.lit("words").alias("kind"), F.col("words").alias("value"))))
    # A page may hold a path as a box that can go and another as a marked one: it is a box if any is.
    counts = seen.select("host", "path", "within", "box", kinds.alias("k")).groupBy("host", "path", "k.kind", "k.value").agg(F.count("*").alias("n"), F.min("within").alias("within"), F.max("box").alias("box"))
    m, spread = F.sum("n"), F.sum(F.col("n") * F.ln("n"))
    # -sum(p ln p) / ln m with p = n / m; a node of one page is important.
    entropy = F.when(m <= 1, F.lit(1.0)).otherwise((F.ln(m) - spread / m) / F.ln(m))
    each = counts.groupBy("host", "path", "kind").agg(m.alias("pages"), entropy.alias("entropy"), F.min("within").alias("within"), F.max("box").alias("box"))
    both = each.groupBy("host", "path").agg(
        F.min("within").alias("within"),
        F.max("box").alias("box"),
        F.max("pages").alias("pages"),
        F.max(F.when(F.col("kind") == "shape", F.col("entropy"))).alias("presentation"),
        F.max(F.when(F.col("kind") == "words", F.col("entropy"))).alias("content"),
    )
    return both.withColumn("importance", CONTENT * F.col("content") + (1 - CONTENT) * F.col("presentation"))


def noise_of(tree: DataFrame, low: float = LOW, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, path) of the branches that go: of low importance, in a main element by its measure."""
    around = tree.select("host", F.col("path").alias("within"), F.col("importance").alias("around"))
    rows = tree.where("box").join(around, ["host", "within"], "left")
    return rows.where((F.col("pages") >= least_pages) & (F.col("importance") < low * F.coalesce("around", F.lit(1.0)))).select("host", "path")


def extract(
    pages: DataFrame,
    low: float = LOW,
    least_pages: int = LEAST_PAGES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    store = Store(pages.sparkSession)
    rows = _keyed(pages, id_col, url_col, html_col)
    seen = store.save(page_styles(rows))
    tree = store.save(style_tree(seen))
    noise = store.save(noise_of(tree, low, least_pages))
    # A page is sent the noise among its own nodes, no more.
    own = store.save(seen.join(noise, ["host", "path"]).groupBy("page").agg(F.collect_set("path").alias("noise")))
    store.keep(own)
    rows = rows.join(own, "page", "left")

    def make():
        def f(ids, urls, texts, noise):
            out = [main_text(t, frozenset(n or ())) for t, n in zip(texts, noise)]
            return ids, urls, out, [len(t) for t in out]

        return f

    return map_rows(rows, ["page_id", "url", "html", "noise"], make, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
