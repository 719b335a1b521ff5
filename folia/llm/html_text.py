"""Main text of web pages by composite text density.

The page becomes a tree. For each node C counts the characters below it, T its tags, LC and LT
those of links; the composite density is

    C/T * log_{ln(C/(C-LC) * LC + LC_body/C_body * C + e)} (C/LC * T/LT)

with zero denominators taken as 1: high for text, low for lists of links. A node's density sum
is that of its children. The subtree of the greatest sum is the core of the article; the least
density on its path from the body is the threshold: each node above it whose ancestors are above
it too adds its own subtree of the greatest sum, and a headline before the core joins it.
Elements that are no article by their nature (menus, forms, scripts) don't take part. Names of
classes and ids are weighed with what a container holds: one named as a menu or a share bar goes
if its links or its few characters a tag agree, one named as an advert, a notice, a sidebar or
comments, which density can't tell from prose, goes unless it holds a headline, the main part or
most of the text. Names of paragraphs and headings mean nothing.

The page is scanned once, in time linear in its length.

Defined results: a null or empty page, or one without text outside such elements, has an empty
text; unclosed, unknown or stray tags are mended as browsers do; a tag without its end is text;
elements nested over ``MAX_DEPTH`` deep follow each other at that depth; repeated rows are
extracted one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import table

#: The rest of a tag with quoted values, and a tag's name.
_TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: Elements that are open at once (a fixed value of browsers).
MAX_DEPTH = 512
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
#: Elements by kind (fixed values).
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr br math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIPPED = frozenset("nav footer aside form script style noscript template iframe svg button select textarea dialog menu canvas audio video head title".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Names of a whole class token or id, alone or with a part of a page before or a part of the element after:
#: of prose that is no article, and of links.
_PART = r"(?:[_-](?:area|bar|block|box|buttons?|container|content|form|inner|items?|links?|list|menu|nav|notice|posts?|section|slot|unit|widget|wrap|wrapper|\d+))*"
_PLACE = r"(?:(?:site|page|main|top|bottom|left|right|primary|secondary|global|post|entry|cookie)[_-])?"
_ASIDE = re.compile(_PLACE + r"(?:ads?|advert\w*|adsense|banner|comments?|commentlist|cookies?|consent|disqus|footer|gdpr|modal|newsletter|notices?|overlay|popup|promos?|promotion|replies|reply|respond|sidebar\d*"
                    r"|sponsor\w*|subscribe|subscription|widgets?)" + _PART)
_LINKS = re.compile(_PLACE + r"(?:breadcrumbs?|header|masthead|menus?|nav|navbar|navigation|related|share|sharing|skip|social|toolbar)" + _PART)
#: A container named for links is one with so few characters a tag, or with a third of them in links.
FEW_CHARS = 40
#: Start tags that close an open element of the second kind within the third.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_KEPT = frozenset(("html", "body", "article", "main"))


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "first", "last", "density", "named")

    def __init__(self, tag: str, parent: "Node | None", first: int):
        self.tag, self.parent, self.children = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.first = self.last = first
        self.density = 0.0
        self.named = 0


def _skipped(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in SKIPPED or (tag == "header" and not in_article):
        return True
    if not attributes or tag in _KEPT:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in SKIPPED_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$|/)", re.sub(r"""=\s*("[^"]*"|'[^']*')""", "", attributes)))


def _named(tag: str, attributes: str) -> int:
    """Whether a class or id names a container as prose that is no article (2), or as links (1)."""
    if not attributes or tag in _KEPT or tag == "p" or tag in HEADINGS:
        return 0
    tokens = [t for name, value in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for t in value.strip("\"'").lower().split()]
    return 2 if any(map(_ASIDE.fullmatch, tokens)) else int(any(map(_LINKS.fullmatch, tokens)))


def _without_named(root: Node, pieces: list[tuple[int, str, Node]]) -> None:
    """Take out the named nodes that their content does not clear."""
    if not any(x.named for x in _nodes(root)):
        return
    nodes = _nodes(root)
    _count(nodes, pieces)
    holds: dict[Node, tuple[int, int]] = {}
    for x in reversed(nodes):
        inner = [holds[c] for c in x.children]
        holds[x] = (sum(i[0] for i in inner) + (x.tag in ("main", "h1")), sum(i[1] for i in inner) + (x.tag == "article"))
    articles, gone = holds[root][1], set()
    for x in nodes:
        if x.parent in gone:
            gone.add(x)
        elif x.named:
            main, own = holds[x]
            cleared = main or own and own == articles or 2 * x.chars > root.chars
            if not cleared and (x.named == 2 or 3 * x.link_chars > x.chars or x.chars < FEW_CHARS * max(1, x.tags)):
                gone.add(x)
                for i in range(x.first, x.last):
                    pieces[i] = (pieces[i][0], "", pieces[i][2])
    if gone:
        for x in nodes:
            x.children = [c for c in x.children if c not in gone]


def parse(page: str) -> tuple[Node, list[tuple[int, str, Node]]]:
    """The tree and the pieces of text (block number, text, node) outside skipped elements."""
    root = Node("html", None, 0)
    stack, skips, pieces, opened = [root], [False], [], Counter()
    block, at, n, last, quoted = 0, 0, len(page), page.rfind(">"), True

    def text(raw: str) -> None:
        if raw and not skips[-1]:
            pieces.append((block, html.unescape(raw), stack[-1]))

    def pop(k: int) -> None:
        for node in stack[k:]:
            node.last = len(pieces)
            opened[node.tag] -= 1
        del stack[k:], skips[k:]

    while at < n:
        begin = page.find("<", at)
        if begin < 0 or begin > last:
            if (begin := page.find("<!--", at)) >= 0:  # a comment without its end
                text(page[at:begin])
            else:
                text(page[at:])
            break
        if page.startswith("<!--", begin):
            text(page[at:begin])
            end = page.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        if page[begin + 1 : begin + 2] in ("!", "?"):
            text(page[at:begin])
            at = page.index(">", begin) + 1
            continue
        closing = page[begin + 1] == "/"
        name = _TAG_NAME.match(page, begin + 1 + closing)
        if name is None:  # no tag: a sign, or an end tag without a name
            text(page[at:begin] if closing else page[at : begin + 1])
            at = page.index(">", begin) + 1 if closing else begin + 1
            continue
        end = _TAG_END.match(page, name.end()) if quoted else None
        # Once a quote has no end, quotes mean nothing any more: so there is one such scan a page.
        quoted = end is not None
        text(page[at:begin])
        at = end.end() if end else page.index(">", name.end()) + 1
        attributes, tag = page[name.end() : at - 1], name.group().lower()
        if tag not in INLINE:
            block += 1
        if closing:
            for k in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                if stack[k].tag == tag:
                    pop(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in ("html", "body") and opened[tag]:
            continue
        if tag not in INLINE and stack[-1].tag not in _KEPT:  # a block element ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    pop(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in _CLOSES:
            own, within = _CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in within:
                    break
                if stack[k].tag in own:
                    pop(k)
                    break
        skip = skips[-1] or _skipped(tag, attributes, opened["article"] + opened["main"] > 0)
        if tag == "br":
            text(" ")
        if tag in VOID:
            if not skip:
                child = Node(tag, stack[-1], len(pieces))
                stack[-1].children.append(child)
            continue
        node = Node(tag, stack[-1], len(pieces))
        node.named = _named(tag, attributes)
        if not skip:
            stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at, last + 1)
            if not skip:
                raw = page[at : end.start() if end else n]
                pieces.append((block, html.unescape(raw), node))
                node.last = len(pieces)
            at = end.end() if end else n
            continue
        if attributes.endswith("/") and tag in ("svg", "math", "path"):
            continue
        if len(stack) > MAX_DEPTH:
            if skips[-1]:
                continue
            pop(MAX_DEPTH)
            if not skip:
                node.parent.children.pop()
                node.parent = stack[-1]
                stack[-1].children.append(node)
        stack.append(node)
        skips.append(skip)
        opened[tag] += 1
    pop(1)
    root.last = len(pieces)
    _without_named(root, pieces)
    return root, pieces


def _nodes(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.children)
    return out


def _count(nodes: list[Node], pieces: list[tuple[int, str, Node]]) -> None:
    """Characters and tags, and those of links, below every node."""
    for x in nodes:
        x.chars = x.tags = x.link_chars = x.link_tags = 0
    for _, text, node in pieces:
        node.chars += len("".join(text.split()))
    for node in reversed(nodes):
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, 1
        if node.parent is not None:
            p = node.parent
            p.chars += node.chars
            p.tags += node.tags + 1
            p.link_chars += node.link_chars
            p.link_tags += node.link_tags


def _measure(root: Node, pieces: list[tuple[int, str, Node]]) -> list[Node]:
    nodes = _nodes(root)
    _count(nodes, pieces)
    body = next((x for x in nodes if x.tag == "body"), root)
    ratio = body.link_chars / max(1, body.chars)
    for x in nodes:
        if x.chars:
            base = math.log(x.chars / max(1, x.chars - x.link_chars) * x.link_chars + ratio * x.chars + math.e)
            inner = x.chars / max(1, x.link_chars) * max(1, x.tags) / max(1, x.link_tags)
            x.density = x.chars / max(1, x.tags) * math.log(max(inner, 1.0)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 + 1e-9 else x.chars / max(1, x.tags) * math.log(max(inner, 1.0))
    return nodes


def _strongest(nodes: list[Node]) -> dict[Node, Node]:
    """The node of the greatest density sum in each subtree; one whose text is mostly its own stands for itself."""
    found: dict[Node, tuple[float, Node]] = {}
    for x in reversed(nodes):
        inner = sum(c.chars for c in x.children)
        own = x.tag == "p" or x.tag in INLINE or x.tag in HEADINGS or 2 * inner <= x.chars
        top = (sum(c.density for c in x.children), x)
        found[x] = (max(x.density, top[0]), x) if own else max([top, *(found[c] for c in x.children)], key=lambda y: y[0])
    return {x: y for x, (_, y) in found.items()}


def main_nodes(root: Node, pieces: list[tuple[int, str, Node]]) -> list[Node]:
    """The subtree of the greatest density sum and those of its surroundings above the threshold."""
    nodes = _measure(root, pieces)
    body = next((x for x in nodes if x.tag == "body"), root)
    best, most = body, -1.0
    for x in nodes:
        total = sum(c.density for c in x.children)
        if total > most:
            best, most = x, total
    path, x = [], best
    while x is not None and x is not body:
        path.append(x)
        x = x.parent
    while best is not body and best.parent is not None and (best.tag in INLINE or best.tag == "p"):
        best = best.parent
    plain = lambda x: x.chars / max(1, x.tags)
    # Composite densities grow with a section's size, so one without many links may also pass by characters a tag.
    threshold, least = min(x.density for x in (body, *path)), min(plain(x) for x in (body, *path))
    passes = lambda x: x.chars > 0 and (x.density >= threshold or plain(x) >= least and x.link_chars * 3 <= x.chars)
    strongest, on_path = _strongest(nodes), {body, *path}
    out, todo = [best], [body]
    while todo:
        x = todo.pop()
        if x is best:
            continue
        for c in x.children:
            # A headline before the core belongs to it however short it is.
            if c in on_path or passes(c):
                todo.append(c)
                if c not in on_path:
                    out.append(strongest[c])
            elif c.tag == "h1" and x in on_path and c.first < best.first:
                out.append(c)
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root, pieces = parse(page)
    blocks: dict[int, list[str]] = {}
    for i in sorted({i for node in main_nodes(root, pieces) for i in range(node.first, node.last)}):
        number, text, _ = pieces[i]
        blocks.setdefault(number, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(x) for x in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
