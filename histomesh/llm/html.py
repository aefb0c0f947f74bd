"""Main text of web pages by composite text density.

A page becomes a DOM (implied end tags, void and raw-text elements, stray tags tolerated) in one forward pass. Elements whose tag or ARIA role
says that they are no article (scripts, forms, menus, footers and the like) and hidden ones are cut off; so are reader comments by
name, which no density tells from an article. Everything else is decided by density. A node's composite text density is its characters per
tag, weighed by its share of link text; its density sum adds the densities of its children. The least density on the path from the node
of the largest sum to the body is the threshold, and of the nodes at or above it the one of the largest sum is the article's subtree. If it
holds an article or main element, the one of those with the largest sum is taken. Within the subtree, blocks of mostly link
text go, and blocks with an advert's or a notice's name whose density is below the subtree's.
Inline formatting (b, i, span, br) counts as text of its block, not as a tag.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histomesh.llm.common import bound_arrow, table

# Fixed values of HTML and ARIA.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre "
    "search section summary table tbody td tfoot th thead tr ul br caption option".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
CUT = frozenset("head nav footer aside form script style noscript template iframe object embed button select textarea svg canvas audio video dialog menu noembed noframes xmp title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: End tags of inline elements don't reach out of these.
BARRIERS = ("article", "main", "body", "table")
#: Names (class or id) of reader comments; names of menus, adverts and notices, which count against a block of low density only.
COMMENTS = frozenset("comment comments respond replies disqus".split())
HINTS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs ad ads advert advertisement banner sponsor sponsored promo cookie cookies consent notice notices popup share sharing social related recommended newsletter subscribe sidebar pagination".split())
#: Blocks of running text, which their links never condemn.
RUNNING = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6".split())
NAME, EQUALS, BARE = re.compile(r"[^\s/>=][^\s/>=]*|=[^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
GAP, TAG, TOKENS = re.compile(r"[\s/]*"), re.compile(r"</?[a-zA-Z][^\s/>]*"), re.compile(r"[\s_-]+")


class Node:
    __slots__ = ("tag", "up", "parts", "cut", "hinted", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, up: Node | None, cut: bool, hinted: bool = False):
        self.tag, self.up, self.cut, self.hinted = tag, up, cut, hinted
        self.parts: list = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """(name, value) pairs of a tag from behind its name, and the place behind its >; the page's length if it never ends. Reads on, never back."""
    out, end = [], len(page)
    while True:
        at = GAP.match(page, at).end()
        if at >= end:
            return out, end
        if page[at] == ">":
            return out, at + 1
        m = NAME.match(page, at)
        at, value = m.end(), ""
        if e := EQUALS.match(page, at):
            at = e.end()
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote:
                stop = page.find(quote, at + 1)
                if stop < 0:
                    return out, end
                value, at = page[at + 1 : stop], stop + 1
            else:
                b = BARE.match(page, at)
                value, at = b[0], b.end()
        out.append((m[0].lower(), value.strip().lower()))


def judged(tag: str, pairs: list[tuple[str, str]], inside: bool) -> tuple[bool, bool]:
    """(cut off, has the name of an advert or notice). inside: within an article or main part, where a header holds the title."""
    if tag in CUT or tag == "header" and not inside:
        return True, False
    hinted = False
    if tag not in ("html", "body", "article", "main"):
        for name, value in pairs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
                return True, False
            if name in ("class", "id"):
                names = TOKENS.split(value)
                if not COMMENTS.isdisjoint(names):
                    return True, False
                hinted |= not HINTS.isdisjoint(names)
    return False, hinted


class _Open:
    """The stack of open elements, with the places of each tag and of blocks, so that no step walks it."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, k: int) -> None:
        """Closes the element at place k and all within it."""
        while len(self.nodes) > k:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCKS:
                self.blocks.pop()

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all nodes in page order."""
    root = Node("html", None, False)
    nodes, open_, since, at, end = [root], _Open(root), 0, 0, len(page)

    def text(upto: int) -> None:
        if upto > since:
            open_.nodes[-1].parts.append(entities.unescape(page[since:upto]))

    while (at := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), at):
            text(at)
            stop = page.find("-->", at + 4) + 3 if page.startswith("<!--", at) else page.find(">", at) + 1
            since = at = stop if stop > at else end
            continue
        m = TAG.match(page, at)
        if not m:
            at += 1
            continue
        text(at)
        closing = page[at + 1] == "/"
        tag = m[0][2 if closing else 1 :].lower()
        pairs, stop = attributes(page, m.end())
        alone = page.startswith("/>", stop - 2)
        since = at = stop
        if closing:
            k = open_.last(tag)
            # an inline end tag stays within its article, table or cell
            if k and (tag in ("html", "body", "article", "main", "table", "div", "section") or k > open_.last(*BARRIERS)):
                open_.close(k)
            continue
        if tag == "html" or tag == "body" and open_.last("body"):
            continue
        if tag in BLOCKS and tag != "br" and open_.blocks and open_.nodes[open_.blocks[-1]].tag == "p":
            open_.close(open_.blocks[-1])
        if tag in CLOSES:
            while (k := open_.last(*CLOSES[tag])) > open_.last(*HOLDS[tag]):
                open_.close(k)
        up = open_.nodes[-1]
        node = Node(tag, up, *judged(tag, pairs, tag == "header" and open_.last("article", "main") > 0))
        up.parts.append(node)
        nodes.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            if not node.cut:
                node.parts.append(entities.unescape(page[at : stop.start() if stop else end]))
            since = at = (page.find(">", stop.end()) + 1 or end) if stop else end
        elif tag not in VOID and not alone or tag in ("div", "p", "a", "b", "i", "span", "article", "section"):
            open_.push(node)
    text(end)
    for node in nodes:
        node.cut |= bool(node.up and node.up.cut)
    return root, nodes


def density(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """Composite text density of c characters, t tags, lc link characters and lt link tags; share: of link text in the body. Zero counts as one
    in every denominator."""
    plain, t, lc, lt = max(1, c - lc), max(1, t), max(1, lc), max(1, lt)
    if not c:
        return 0.0
    return c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(math.log(c / plain * lc + share * c + math.e))


def weigh(nodes: list[Node]) -> None:
    """Sets counts, densities and density sums, children first. What is cut counts as nothing."""
    for node in reversed(nodes):
        if node.cut:
            continue
        for x in node.parts:
            if isinstance(x, str):
                node.chars += len(" ".join(x.split()))
            elif not x.cut:
                node.chars += x.chars
                node.tags += x.tags + (x.tag == "a" or x.tag in BLOCKS and x.tag != "br")
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        if not node.cut and node.chars:
            node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
            if node.up and node.tag in BLOCKS:
                node.up.total += node.density


def article(nodes: list[Node]) -> Node | None:
    """The subtree of the largest density sum among blocks at or above the threshold; None for a page without text."""
    live = [x for x in nodes if not x.cut and x.chars and x.tag in BLOCKS]
    if not live:
        return None
    rank = lambda x: (x.total, x.density)
    best = max(live, key=rank)
    threshold, x = best.density, best
    while x:
        threshold = min(threshold, x.density)
        x = x.up
    top = max((x for x in live if x.density >= threshold), key=rank)
    within, held = {id(top)}, []
    for x in nodes:
        if x.up and id(x.up) in within:
            within.add(id(x))
            if x.tag in ("article", "main") and not x.cut and x.chars:
                held.append(x)
    return max(held, key=rank) if held else top


def trim(top: Node) -> None:
    """Cuts, within the article, blocks of mostly link text and blocks with an advert's or a notice's name that are less dense than the article."""
    todo = [top]
    while todo:
        for x in todo.pop().parts:
            if isinstance(x, str) or x.cut:
                continue
            links = x.tag in BLOCKS and x.tag not in RUNNING and x.link_tags > 1 and 2 * x.link_chars > x.chars
            if links or x.hinted and x.density < top.density:
                x.cut = True
            else:
                todo.append(x)


def text_of(top: Node) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if words := " ".join("".join(line).split()):
            blocks.append(words)
        line.clear()

    todo: list = [top]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif not x.cut:
            if block := x.tag in BLOCKS:
                flush()
                todo.append(None)
            todo.extend(reversed(x.parts))
    flush()
    return " ".join(blocks)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    _, nodes = parse(page)
    weigh(nodes)
    top = article(nodes)
    if not top:
        return ""
    trim(top)
    return text_of(top)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with html_col replaced by text (the article; empty if there is none) and n_chars. A null or empty page has no text; broken
    markup is read as far as it goes; columns of pages named text or n_chars are replaced; repeated rows get equal texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    bound_arrow(pages.sparkSession)
    others = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]
    rows = pages.select(*[F.col(f"`{c}`") for c in others], F.col(html_col).cast("string").alias("page"))
    schema = rows.schema
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    return rows.mapInArrow(run, StructType([*schema.fields[:-1], StructField("text", StringType()), StructField("n_chars", LongType())]))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
