"""Main text of web pages by composite text density.

A page is read into a tree by one pass of a tokeniser that follows the usual rules for unclosed tags. For every node the
characters and tags below it, and those inside links, give its composite density: characters per tag, raised or lowered
by the share of link text. A node's density sum adds up its children's densities, but for those of inline formatting, which belong to the
block around them. The subtree of greatest density sum is content; the least density on the path from it up to body is the threshold, and
a block beside the path is content, too, if its density passes the threshold, its text is mostly no link text, and it holds at least ASIDE of
the winner's characters or stands between such blocks; so are the headings before what is content. Inside the winner, a block of nothing
but links, three or more, that does not pass the threshold is a menu and goes. Of equal sums, article or main wins, then the one with more characters, then
the first in page order.

What is never content is set aside first: scripts, styles, forms, navigation, page headers and footers, sidebars, and
blocks whose role, class or id names them as such, as notices, adverts or reader comments; also what browsers do not show (templates, noscript, hidden
elements) and drawings. Formulas and what stands in object, canvas, audio and video stay. Character references are decoded, white space
inside a block becomes one space, blocks are joined by an empty line.

Cases: a null or empty page, or one without text, gives the empty string; broken markup (open tags, stray ends, a cut
comment) is read as far as it goes; text without any tag is one block; repeated rows give repeated rows; a page of any length is
read whole, without recursion.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title select annotation annotation-xml".split())
DROPPED = frozenset("nav footer aside form button menu dialog head".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2
h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
FORMATTING = frozenset("a abbr b bdi bdo big cite code em font i kbd mark q s samp small span strike strong sub sup tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Share of the winner's characters that a block beside its path must hold, unless it stands between such blocks.
ASIDE = 0.1
#: Tags that end an open element of the named kinds, up to the named fence.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
#: Words of a role, class or id that name what is no content.
BOILERPLATE = frozenset("""ad ads advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs comment comments commentlist contentinfo
cookie cookies consent copyright disqus footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain pager
pagination paywall popup promo promos promotion related recommended reply replies respond search share sharing sidebar sidebars signup social
sponsor sponsored subscribe subscription taboola toolbar widget widgets""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attributes2>[^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: Names that say what a layout has or lacks, not what an element is.
LAYOUT = re.compile(r"(?:with|without|has|no|is|js|enable|enabled|show|hide)[-_]", re.I)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "text", "skip", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, skip: bool = False):
        self.tag, self.parent, self.children, self.text, self.skip = tag, parent, [], None, skip
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def named_as_boilerplate(attributes: str) -> bool:
    """Whether role, class, id or style say that an element is no content."""
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key not in ("hidden", "aria-hidden", "style", "role", "class", "id"):
            continue
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif key == "role":
            if value.lower() in ROLES:
                return True
        elif any(w.lower() in BOILERPLATE for name in value.split() if not LAYOUT.match(name) for w in PARTS.findall(name)):
            return True
    return False


def tree(page: str) -> tuple[Node, list[Node]]:
    """The root, and all nodes in page order; text nodes have tag ''."""
    root = Node("html", None)
    nodes, here, at = [root], root, 0
    open_tags = {"html": 1}

    def add(tag: str, skip: bool = False) -> Node:
        child = Node(tag, here, skip)
        here.children.append(child)
        nodes.append(child)
        return child

    def leave(node: Node) -> Node:
        open_tags[node.tag] -= 1
        return node.parent

    size = len(page)
    while at < size:
        found = TOKEN.search(page, at)
        stop = found.start() if found else size
        if stop > at:
            add("").text = page[at:stop]
        if not found:
            break
        at = found.end()
        closing, tag, attributes = found["end"] or found["end2"], (found["tag"] or found["tag2"] or "").lower(), found["attributes"] or found["attributes2"] or ""
        if not tag:
            if found.group().startswith("<![CDATA["):
                add("").text = found.group()[9:].removesuffix("]]>")
            continue
        if closing:
            if open_tags.get(tag, 0) and tag not in ("html", "body"):
                while here.tag != tag:
                    here = leave(here)
                here = leave(here)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else size if tag in ("script", "style") else at
            add(tag, True)
            continue
        if tag == "body" and open_tags.get("body") or tag == "html":
            continue
        if tag in ("body", "article", "main", "div", "header", "nav") and open_tags.get("head"):
            while here.tag != "head":
                here = leave(here)
            here = leave(here)
        if tag in BLOCKS and open_tags.get("p"):
            while open_tags["p"]:
                here = leave(here)
        if tag in CLOSES:
            kinds, fence = CLOSES[tag]
            node, reach = here, None
            while node is not None and node.tag not in fence:
                reach = node if node.tag in kinds else reach
                node = node.parent
            if reach is not None:
                while here is not reach:
                    here = leave(here)
                here = leave(here)
        skip = tag in DROPPED or tag not in ("html", "body", "main", "article") and bool(attributes) and named_as_boilerplate(attributes)
        if tag == "header" and not (open_tags.get("article") or open_tags.get("main")):
            skip = True
        child = add(tag, skip)
        if tag not in VOID and not attributes.endswith("/"):
            here = child
            open_tags[tag] = open_tags.get(tag, 0) + 1
    return root, nodes


def densities(nodes: list[Node]) -> None:
    """Counts and composite densities of all nodes, children before parents; what is set aside counts for nothing."""
    for node in nodes:
        if node.parent is not None and node.parent.skip:
            node.skip = True
    body_chars = body_links = 0
    for node in reversed(nodes):
        if node.skip:
            continue
        if node.tag == "":
            node.chars = len(SPACE.sub(" ", node.text).strip())
        elif node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        up = node.parent
        if up is None:
            body_chars, body_links = node.chars, node.link_chars
        else:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
            up.tags += node.tags + (node.tag != "")
    share = body_links / body_chars if body_chars else 0.0
    for node in reversed(nodes):
        if node.skip or node.tag == "" or not node.chars:
            continue
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        node.density = c / t * math.log(max(c / lc * t / lt, 1.0) + 1e-9, base) if base > 1 else c / t
        node.density = max(node.density, 0.0)
        if node.parent is not None and node.tag not in FORMATTING:
            node.parent.total += node.density


def blocks(top: list[Node]) -> list[str]:
    """The text of the subtrees, one string for each block, in page order."""
    out, line = [], []

    def flush() -> None:
        text = SPACE.sub(" ", references.unescape("".join(line))).strip()
        if text:
            out.append(text)
        line.clear()

    stack: list[tuple[Node, bool]] = [(n, False) for n in reversed(top)]
    while stack:
        node, ended = stack.pop()
        if ended:
            flush()
        elif node.tag == "":
            line.append(node.text)
        elif node.tag == "br":
            line.append(" ")
        elif not node.skip:
            if node.tag in BLOCKS:
                flush()
                stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children))
    flush()
    return out


def content(nodes: list[Node]) -> list[Node]:
    """The subtrees that hold the main text, in page order: the one of greatest density sum, and blocks beside its path that pass the threshold."""
    real = [n for n in nodes if not n.skip and n.tag and n.chars]
    if not real:
        return []
    best = max(real, key=lambda n: (n.total, n.tag in ("article", "main"), n.chars))
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path if n.tag != "html" or n is best)
    # a winner that is no block of its own stands for the one around it
    while path[0].tag not in BLOCKS and len(path) > 1:
        path.pop(0)
    best = path[0]
    _drop_menus(best, threshold)
    chosen, top = [best], best
    for up in path[1:]:
        dense = [n is top or not n.skip and n.chars > 0 and _passes(n, threshold) for n in up.children]
        sure = [k for k, n in enumerate(up.children) if n is top or dense[k] and n.chars >= ASIDE * best.chars]
        passing = {id(n) for k, n in enumerate(up.children) if dense[k] and sure[0] <= k <= sure[-1]}
        # headings count as far as nothing but headings stands between them and what is content
        wanted, part = False, []
        for node in reversed(up.children):
            if node is top:
                part.extend(reversed(chosen))
                wanted = True
            elif node.skip or not node.chars:
                continue
            elif id(node) in passing or wanted and node.tag in HEADINGS:
                part.append(node)
                wanted = True
                if node.tag not in HEADINGS:
                    _drop_menus(node, threshold)
            else:
                wanted = False
        chosen, top = part[::-1], up
    return chosen


def _passes(node: Node, threshold: float) -> bool:
    return node.tag in BLOCKS and node.tag not in HEADINGS and node.density >= threshold and 3 * node.link_chars < node.chars


def _drop_menus(node: Node, threshold: float) -> None:
    """Sets aside the blocks below a node that are nothing but three or more links."""
    stack = [node]
    while stack:
        for child in stack.pop().children:
            if child.skip or not child.chars or child.tag not in BLOCKS:
                continue
            if child.link_chars >= child.chars and child.link_tags >= 3 and child.density < threshold:
                child.skip = True
            else:
                stack.append(child)


def extract(page: str) -> str:
    """The main text of a page."""
    _, nodes = tree(page)
    densities(nodes)
    return "\n\n".join(blocks(content(nodes)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of (page_id, url, html)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py() or "") for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
