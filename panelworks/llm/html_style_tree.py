"""Main text of web pages by site style trees.

The pages of a host are merged into one tree whose nodes are element paths with their presentation (tag, classes, id).
For each node Spark counts on how many pages it stands, with which sequences of children (presentation) and with which
texts below it (content). A node is important when its presentation varies or its content differs from page to page:

    importance = (1 - GAMMA) * entropy of its child sequences + GAMMA * (1 - mean entropy of its texts)

with entropies to the base of the number of pages. What few pages say counts for less: of n pages, the share
log(n) / log(n + 1) of what importance lacks to one. So a branch that one page holds is important, equal texts on two pages
stay (0.37 at least), and on three or more they go. A branch is removed from each page of the host if it and all branches
below it are of low importance: the mean over a wrapper says nothing of the article within it. Only elements and texts
that are not outside by their meaning are counted.

Elements that are never main text by their meaning (menus, forms, scripts, asides, ...) go on every host, also on hosts
with one page, where a tree tells nothing. A class, id or role says so only as a whole word of the attribute
(`sidebar`; of `with-sidebar` the tree decides), never on html, body, an article or main part, and not on an element that
holds the page's only article or main part. Where a page marks its article or main part, text outside is left out, and
inside only branches that carry a class or id can be of low importance.

Equal pages of a host count once, wherever they lie: the hashes of all pages are counted first, and only pages that have
copies are shuffled. Counts are summed in the tasks before the shuffle, so a hot host costs no more than its distinct texts. The list of low
branches is written once and read back, so that Spark broadcasts it by its size on disk or else shuffles.

Defined cases: a null or empty html has an empty text; a null url is a host of its own; broken markup is read as far as
it goes (an unclosed comment or script ends with the page); repeated pages are each given a text, and equal pages
of a host count once; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.llm import kernel
from panelworks.llm.catalogue import read, registered
from panelworks.scale import cut_lineage

GAMMA = 0.9
# Branches below this importance go.
LOW = 0.3
# Sums that a task holds before it sends them.
HELD_SUMS = 300_000

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|object|select|button)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|</(?P<end>[a-z][\w:-]*+)[^>]*+>?"
    r"|<(?P<tag>[a-z][\w:-]*+)(?P<attributes>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<broken>[a-z][\w:-]*+)[^>]*+>?"
    r"|<[!?/][^>]*+>?",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"\shidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset(("article", "main"))
WHOLE = MAIN | {"html", "body"}
NEVER = frozenset("nav footer aside form head menu dialog fieldset input label option".split())
# Whole words of class, id or role that say that a branch is not main text.
ROLES = frozenset(
    "nav navigation navbar menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising banner "
    "sponsor sponsored promo cookie cookies consent notice alert popup modal overlay share sharing social related "
    "recommended comment comments reply replies discussion disqus breadcrumb breadcrumbs pagination pager newsletter "
    "subscribe signup login search widget toolbar skip copyright complementary contentinfo form".split()
)
# An open element that the start of another one closes.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


@dataclass
class _Element:
    tag: str
    node: int
    styled: bool
    never: bool  # not main text, whatever it holds
    role: bool  # not main text, unless it holds the page's only article or main part
    inside_main: bool
    parent: _Element | None
    outside: bool = False
    holds_main: bool = False
    children: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.outside = self.never or self.role or (self.parent is not None and self.parent.outside)


@dataclass
class Page:
    """What one page tells: nodes with the hash of their children and their parent, and blocks with the branches that hold them."""

    nodes: list[tuple[int, int, int]]
    blocks: list[tuple[str, tuple[_Element, ...]]]
    has_main: bool


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def _label(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Presentation of an element, whether it carries a class or id, and whether its kind, or its role, is not main text."""
    if not attributes or attributes.isspace():
        return tag, False, tag in NEVER, False
    found = [(m[0].lower(), m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(attributes)]
    words = [w.lower() for _, value in found for w in _PARTS.findall(value)]
    role = tag not in WHOLE and any(w in ROLES for _, value in found for w in value.lower().split())
    return " ".join([tag, *words]), bool(found), tag in NEVER or bool(_HIDDEN.search(attributes)), role


def parse(html: str) -> Page:
    root = _Element("", 0, False, False, False, False, None)
    stack, elements, nodes, blocks, text = [root], [], [], [], []
    has_main, at = False, 0

    def flush() -> None:
        if text:
            words = " ".join(unescape("".join(text)).split())
            text.clear()
            if words:
                blocks.append((words, tuple(stack)))

    def pop() -> None:
        element = stack.pop()
        if element.tag in BLOCKS:
            nodes.append((element, _hash(*element.children), stack[-1].node))

    for found in _MARKUP.finditer(html):
        if found.start() > at:
            text.append(html[at : found.start()])
        at = found.end()
        tag, end = found["tag"] or found["broken"], found["end"]
        if tag:
            tag = tag.lower()
            if tag in BLOCKS:
                flush()
                if any(e.tag == "p" for e in stack):
                    _close(stack, pop, ("p",))
                if tag in CLOSES:
                    _close(stack, pop, CLOSES[tag])
                label, styled, never, role = _label(tag, found["attributes"] or "")
                parent = stack[-1]
                inside = parent.inside_main or tag in MAIN
                node = _hash(parent.node, label)
                parent.children.append(node)
                if tag not in VOID:
                    stack.append(_Element(tag, node, styled, never, role or (tag == "header" and not inside), inside, parent))
                    elements.append(stack[-1])
                    if tag in MAIN:
                        has_main = has_main or not stack[-1].outside
                        for element in stack:
                            element.holds_main = True
            elif tag in VOID:
                text.append(" ")
            else:
                _, _, never, role = _label(tag, found["attributes"] or "")
                if never or role or stack[-1].outside:  # an inline element; its text must not run into the block
                    flush()
                parent = stack[-1]
                if not (found["attributes"] or "").endswith("/"):
                    stack.append(_Element(tag, parent.node, False, never, role, parent.inside_main, parent))
                    elements.append(stack[-1])
        elif end:
            end = end.lower()
            if end in BLOCKS:
                flush()
            here = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == end), 0)
            if here and (end in BLOCKS or not any(e.tag in BLOCKS for e in stack[here:])):
                if stack[-1].outside:
                    flush()
                while len(stack) > here:
                    pop()
    text.append(html[at:])
    flush()
    while len(stack) > 1:
        pop()
    if not has_main and any(e.holds_main and e.role for e in elements):
        for e in elements:
            e.outside = e.never or (e.role and not e.holds_main) or e.parent.outside
    return Page([(e.node, children, above) for e, children, above in nodes if not e.outside], blocks, has_main)


def _close(stack: list[_Element], pop, tags: tuple[str, ...]) -> None:
    """Close the nearest open element of these kinds, unless it lies beyond one that starts a part of its own."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            while len(stack) > k:
                pop()
            return
        if stack[k].tag in ("table", "ul", "ol", "dl", "article", "section", "div", "main", "body") and "p" not in tags:
            return


def candidates(page: Page) -> Iterator[tuple[str, tuple[_Element, ...]]]:
    """Blocks that are not outside by meaning, with the block elements that hold them."""
    for words, path in page.blocks:
        if not (path[-1].outside or (page.has_main and not path[-1].inside_main)):
            yield words, tuple(e for e in path if e.tag in BLOCKS)


def main_text(page: Page, low: set[int]) -> str:
    """Blocks of the page without the branches that are outside by meaning or of low importance."""
    return "\n".join(words for words, path in candidates(page) if not any(e.node in low and (e.styled or not e.inside_main) and e.tag not in WHOLE for e in path))


def with_host(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host)."""
    host = F.regexp_extract(F.lower(F.col("url")), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.select("page_id", "url", "html", F.coalesce(host, F.lit("")).alias("host"))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, html), equal pages of a host once; pages without copies are not shuffled, only their hashes."""
    keyed = pages.filter("html <> ''").select("host", F.xxhash64("html").alias("own"), "html")
    copies = cut_lineage(keyed.groupBy("host", "own").count().filter("count > 1").select("host", "own"), "style-copies")
    first = keyed.join(copies, ["host", "own"], "left_semi").groupBy("host", "own").agg(F.first("html").alias("html"))
    return keyed.join(copies, ["host", "own"], "left_anti").unionByName(first).select("host", "html")


_SUMS = "host string, node long, kind int, feature long, n long"
PRESENTATION, CONTENT, ANCESTOR = 0, 1, 2


def style_counts(pages: DataFrame) -> DataFrame:
    """The merged trees: on how many pages of a host a node has a child sequence, or a text below it; and its ancestors."""

    def rows(sums: dict[tuple[str, int, int, int], int]) -> pa.RecordBatch:
        keys = list(sums)
        return kernel.record_batch(host=pa.array([k[0] for k in keys], pa.string()), node=pa.array([k[1] for k in keys], pa.int64()), kind=pa.array([k[2] for k in keys], pa.int32()), feature=pa.array([k[3] for k in keys], pa.int64()), n=pa.array(list(sums.values()), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int, int], int] = {}
        placed: set[tuple[str, int]] = set()
        for batch in kernel.slices(batches, "html"):
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = parse(html)
                found = {(node, PRESENTATION, children) for node, children in {n: c for n, c, _ in page.nodes}.items()}
                for words, path in candidates(page):
                    feature = _hash(words)
                    found.update((e.node, CONTENT, feature) for e in path)
                if len(placed) > HELD_SUMS:
                    placed.clear()
                parent = {n: p for n, _, p in page.nodes}
                for node in parent:
                    if (host, node) not in placed:
                        placed.add((host, node))
                        above = node
                        while above := parent.get(above, 0):
                            found.add((node, ANCESTOR, above))
                for node, kind, feature in found:
                    sums[host, node, kind, feature] = sums.get((host, node, kind, feature), 0) + 1
                if len(sums) > HELD_SUMS:
                    yield rows(sums)
                    sums = {}
        yield rows(sums)

    return distinct_pages(pages).mapInArrow(run, _SUMS).groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n"))


def node_sums(counts: DataFrame) -> DataFrame:
    """Sums of each node in the row of the ancestor 0, and a row for each of its ancestors."""
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value).otherwise(0))
    spread = F.col("n") * F.log("n")
    return counts.groupBy("host", "node", F.when(F.col("kind") == ANCESTOR, F.col("feature")).otherwise(0).alias("ancestor")).agg(
        of(PRESENTATION, F.col("n")).alias("n_pages"), of(PRESENTATION, spread).alias("child_spread"), of(CONTENT, F.col("n")).alias("n_texts"), of(CONTENT, spread).alias("text_spread")
    )


def _weighed(sums: DataFrame) -> DataFrame:
    base = F.log(F.col("n_pages").cast("double"))
    presentation = (base - F.col("child_spread") / F.col("n_pages")) / base
    content = F.when(F.col("n_texts") > 0, 1 - F.col("text_spread") / (F.col("n_texts") * base)).otherwise(0.0)
    return sums.filter("ancestor = 0 and n_pages > 1").select("host", "node", "n_pages", ((1 - GAMMA) * presentation + GAMMA * content).alias("importance"))


def importances(counts: DataFrame) -> DataFrame:
    """(host, node, n_pages, importance) of the nodes on more than one page."""
    return _weighed(node_sums(counts))


def low_branches(pages: DataFrame) -> DataFrame:
    """(host, low): the branches of each host that go, with all below them; their number is that of the host's templates."""
    sums = cut_lineage(node_sums(style_counts(pages)), "style-sums")
    evidence = F.log("n_pages") / F.log(F.col("n_pages") + 1)
    low = _weighed(sums).filter(1 - evidence * (1 - F.col("importance")) < LOW).select("host", "node")
    above = sums.filter("ancestor <> 0").join(low, ["host", "node"], "left_anti").select("host", F.col("ancestor").alias("node")).distinct()
    return cut_lineage(low.join(above, ["host", "node"], "left_anti").groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("low")), "style-tree")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    hosted = with_host(pages)
    joined = hosted.join(low_branches(hosted), "host", "left").select("page_id", "url", "html", "low")
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, "html"):
            texts = [main_text(parse(h), set(low or ())) if h else "" for h, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True)]
            yield kernel.record_batch(page_id=batch.column("page_id"), url=batch.column("url"), text=pa.array(texts, pa.string()), n_chars=pa.array(np.array([len(t) for t in texts], dtype=np.int64)))

    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


@registered("op1_html_style_tree")
def op1_html_style_tree(spark: SparkSession, folder: str) -> DataFrame:
    return extract(read(spark, folder, "pages"))
