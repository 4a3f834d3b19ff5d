"""Main text of web pages by composite text density.

The page becomes a tree. For every node the link-adjusted density of characters
per tag is

    density = C/T * log_b(C/L' * T/L'')    with b = ln(C/N * L + L_body/C_body * C + e)

where C are the characters below the node, T its tags, L the characters inside
links, N = C - L, and zero counts are taken as one. A node's score is the sum of
its children's densities, phrases aside. The chosen node is the one with the largest sum. The
threshold is the smallest density among the nodes from the body down to it. Of
every node that reaches the threshold, anywhere on the page, the subtree with the
largest sum is main content. As the logarithm grows with a node's size, a shorter
part of the same text would miss it; so a node whose characters outside links per
tag reach the smallest such number of the path counts too. Link lists below the
threshold and all boilerplate elements go.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, schema_with, with_columns

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe noembed noframes xmp svg math select".split())
BLOCKS = frozenset(("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption").split())
DROPPED = frozenset("nav aside footer form button input label menu dialog object canvas audio video".split())
CLOSES_P = BLOCKS - {"html", "body", "option"}
#: A new one of these ends an open one of the same set.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = frozenset("ul ol dl table html body td th article section div".split())
# Words in class, id or role that name something other than the article, and words that say nothing beside them.
OTHER = frozenset(("ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments cookie cookies complementary consent contentinfo disqus "
                   "footer masthead menu nav navbar navigation newsletter notice popup promo promotion promotions reactions related replies search share sharing sidebar social sponsor sponsored "
                   "subscribe toolbar").split())
NEUTRAL = frozenset(("area articles bar block bottom box button buttons container content form global group header icons inner items left links list main media outer page pages "
                     "panel posts primary right row secondary section signup site slot stories strip text thread top unit widget wrap wrapper").split())
#: Only these are whole parts of a page; in a paragraph, heading or phrase a name is the author's, unless it says advertisement.
PARTS = frozenset("div section ul ol dl table tbody tr td nav header figure center fieldset iframe details".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements sponsored".split())
#: Heads of the page; inside the article such a part holds its title.
HEADS = frozenset("header masthead".split())
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "chars", "tags", "links", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, drop: bool):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.children: list[Node | str] = []
        self.chars = self.tags = self.links = self.link_tags = 0
        self.density = self.total = 0.0


def attributes_of(tag: str) -> dict[str, str]:
    """Attributes by name, the first of a name; one without a value is empty."""
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(tag):
        found.setdefault(name.lower(), a or b or c)
    return found


def hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(UNSEEN.search(attributes.get("style", "")))


def names_of(attributes: dict[str, str]) -> list[list[str]]:
    """The words of each name in class, id and role; numbers count for nothing."""
    names = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower().split()
    return [[w for w in re.split("[-_]+", n) if w and not w.isdigit()] for n in names]


def foreign(tag: str, names: list[list[str]], inside: bool) -> bool:
    """Is this part of the page, by its names, something other than the article?

    A name counts whole: each of its words must say so or say nothing, and one must say so
    ("related-posts" is foreign, "related-work" is not). ``inside`` an article or main element
    a header holds its title.
    """
    other = ADVERTS if tag not in PARTS else OTHER if inside else OTHER | HEADS
    return any(words and not other.isdisjoint(words) and all(w in other or w in NEUTRAL for w in words) for words in names)


def parse(page: str) -> Node:
    """A forgiving tree: unclosed paragraphs and items end where HTML ends them, stray end tags are skipped."""
    root = node = Node("html", None, False)
    at, size = 0, len(page)
    opened = {"html": 1}
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at:m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if opened.get(name):
                while node.tag != name:
                    opened[node.tag] -= 1
                    node = node.parent
                opened[name] -= 1
                node = node.parent or root
                opened["html"] = 1
            continue
        attributes = m.group(3) or ""
        if name == "html" or name == "body" and opened.get("body"):
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in CLOSES_P and opened.get("p"):
            node = _close(node, {"p"}, BARRIERS, opened)
        if name in SIBLINGS:
            node = _close(node, SIBLINGS[name], BARRIERS - {"td", "th"} if name in ("tr", "td", "th") else BARRIERS, opened)
        found = attributes_of(attributes) if attributes else {}
        inside = bool(opened.get("article") or opened.get("main"))
        drop = name in DROPPED or name in ("header", "noscript") and not inside or bool(found) and (hidden(found) or foreign(name, names_of(found), inside))
        child = Node(name, node, drop and name not in ("body", "article", "main"))
        node.children.append(child)
        if name not in VOID and not attributes.endswith("/"):
            node = child
            opened[name] = opened.get(name, 0) + 1
        elif attributes.endswith("/") and name not in VOID:
            node = child
            opened[name] = opened.get(name, 0) + 1
    return root


def _close(node: Node, tags: set[str], barriers: frozenset[str], opened: dict[str, int]) -> Node:
    """The parent of the nearest open element of ``tags`` that no barrier hides; else the node itself."""
    up = node
    while up.parent is not None and up.tag not in tags:
        if up.tag in barriers:
            return node
        up = up.parent
    if up.tag not in tags or up.parent is None:
        return node
    while node is not up:
        opened[node.tag] -= 1
        node = node.parent
    opened[up.tag] -= 1
    return up.parent


def in_order(root: Node) -> list[Node]:
    """Nodes, parents first, without recursion: pages may nest deeper than Python's stack."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def measure(root: Node) -> list[Node]:
    """Fill counts, densities and sums of all nodes."""
    nodes = in_order(root)
    for node in nodes[1:]:
        node.drop |= node.parent.drop
    for node in reversed(nodes):
        if node.drop:
            continue
        for c in node.children:
            if isinstance(c, str):
                node.chars += len("".join(html.unescape(c).split()))
            elif not c.drop:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.links += c.links
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.links = node.chars
    body = root
    ratio = body.links / max(1, body.chars)
    for node in nodes:
        if node.drop or not node.chars:
            continue
        c, t, l, k = node.chars, max(1, node.tags), max(1, node.links), max(1, node.link_tags)
        n = max(1, c - node.links)
        base = math.log(c / n * l + ratio * c + math.e)
        node.density = c / t * max(0.0, math.log(max(1.0, c / l * t / k)) / max(1e-9, math.log(max(base, 1.0 + 1e-9)))) if base > 1 else c / t
    for node in reversed(nodes):  # a phrase is part of its block's text, unless it holds blocks itself
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.drop and (c.tag in BLOCKS or c.total > 0))
    return nodes


def main_nodes(root: Node, nodes: list[Node]) -> tuple[list[Node], float]:
    """The parents-first nodes whose subtrees are the content, none inside another, in page order; and the body-path threshold.

    An article or main element around the chosen node is taken whole. Where
    nothing has a sum (plain text in the body), the body is the content.
    """
    best = max(nodes, key=lambda x: x.total if not x.drop else -1.0)
    if best.total <= 0:
        best = root
    path, up = [best], best
    while up.parent is not None:
        up = up.parent
        path.append(up)
    threshold = min((x.density for x in path if x.density > 0), default=0.0)
    plain = min((_plain(x) for x in path if x.density > 0), default=0.0)
    around = next((x for x in path if x.tag == "article"), None) or next((x for x in path if x.tag == "main"), None) or best
    largest: dict[Node, Node] = {}  # of each subtree, the first node with the largest sum
    for node in reversed(nodes):
        if not node.drop:
            below = [largest[c] for c in node.children if isinstance(c, Node) and not c.drop]
            largest[node] = max([node, *below], key=lambda x: x.total)
    above, kept = set(path), {around}
    for node in nodes:
        if not node.drop and node.density > 0 and node not in above and (node.density >= threshold or _plain(node) >= plain):
            top = largest[node]
            while top.tag not in BLOCKS and top.parent not in above:  # a phrase belongs to its block
                top = top.parent
            kept.add(top)
    tops, inside = [], set()
    for node in nodes:
        if node in kept and node.parent not in inside:
            tops.append(node)
        if node in kept or node.parent in inside:
            inside.add(node)
    return tops, threshold


def _plain(node: Node) -> float:
    """Characters outside links per tag."""
    return (node.chars - node.links) / max(1, node.tags)


def blocks_of(top: Node, threshold: float) -> list[str]:
    """Texts of the blocks in page order; link lists below the threshold go."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(line)).strip()
        if text:
            out.append(text)
        line.clear()

    stack: list[tuple[Node | str | None, bool]] = [(top, False)]
    while stack:
        item, leave = stack.pop()
        if isinstance(item, str):
            line.append(html.unescape(item))
            continue
        block = item.tag in BLOCKS or item.tag == "br"
        if leave:
            flush()
            continue
        if item.drop or item is not top and item.tag in ("ul", "ol", "table", "div", "section") and item.chars and item.links * 2 > item.chars and item.density < threshold:
            continue
        if block:
            flush()
            stack.append((item, True))
        stack.extend((c, False) for c in reversed(item.children))
    flush()
    return out


def extract(page: str) -> str:
    """The main text of one page; empty if there is none."""
    root = parse(page)
    tops, threshold = main_nodes(root, measure(root))
    return "\n\n".join(block for top in tops for block in blocks_of(top, threshold))


def extract_text(pages: DataFrame, source: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``: the main text of each whole page.

    Null or empty pages give an empty text. A column named ``out`` is replaced.
    Rows are independent, nothing is shuffled.
    """
    pages = pages.drop(*([out] if out != source else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, source):
            yield with_columns(piece, {out: pa.array([extract(p) if p else "" for p in piece.column(source).to_pylist()], pa.string())})
    return pages.mapInArrow(run, schema_with(pages, f"`{out}` string"))
