"""Main text of web pages by tag-path ratios.

A page is read as a tree. Each leaf text belongs to a tag path from the root; over a page a
path's text length and punctuation are summed and set against its number of nodes. The
two ratios are smoothed along the page's order of paths, fused by their product, and
thresholded by their spread. What stands on the paths above the threshold is content, and the region of
the article is the innermost container that holds most of it. Everything outside the region goes,
whatever it is called. Inside, all on content paths stays, and so does the rest, such as headings, list
items and short paragraphs, but for what looks like furniture.

Names only weigh in: a path within furniture (by its tag, or by a whole class, id or role of which each
part is in ``NAMED``; a name or a form alone does not make most of a page furniture) has its fused ratio
multiplied by ``DOUBT`` before the threshold; one within a form or readers' comments, which may be
prose of any length, has none.

Defined results: a null or empty page, or one without text, has an empty text; markup that is
not closed or nested properly is repaired as browsers do for paragraphs, list items and
cells; a page is read in time linear in its length and depth, so very long ones, unclosed tags and
deep nesting do no harm; repeated rows are read alike; columns other than page_id, url and html are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|svg|math|canvas|object|textarea|title|select|video|audio"
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINER = frozenset("html body div section article main center table tbody tr td".split())
FURNITURE = frozenset("nav footer aside form button menu dialog head label fieldset input".split())
NAMED = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply replies share sharing social related newsletter subscribe popup modal widget toolbar pagination skip legal copyright".split())
#: Of these the ones whose text may be prose of any length: readers' comments and forms.
PROSE = frozenset("comment comments disqus reply replies form".split())
HEADER = frozenset({"header", "topbar"})
#: Elements that no name makes junk.
NEVER = frozenset("html body main article".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUND = frozenset("ul ol dl table td th div section article main body html nav aside header footer form blockquote".split())

# quantifiers are possessive, so that a tag which is never closed is read once
INSIDE = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b{INSIDE}>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<attrs>{INSIDE})>|<[!?/a-zA-Z][^>]*(?:>|\Z)", re.S | re.I)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PUNCTUATION = re.compile(r"[.,;:!?。，¿¡]")
SPREAD, DOUBT, MOST = 0.5, 0.02, 0.8


class Node:
    __slots__ = ("tag", "up", "path", "depth", "inside", "prose", "soft", "hard", "junk", "lost", "n", "size", "content", "title")

    def __init__(self, tag: str, up: Node | None, names: str, n: int, paths: dict):
        self.tag, self.up, self.n = tag, up, n
        self.depth = up.depth + 1 if up else 0
        self.path = paths.setdefault((up.path if up else -1, tag, names), len(paths))
        named = [re.split(r"[_-]+", x) for x in names.lower().split()]
        within = up is not None and up.inside
        self.inside = within or tag in ("article", "main")
        header = any(len(x) == 1 and x[0] in HEADER for x in named) and not within
        known = [x for x in named if NAMED.issuperset(x)]
        self.hard = tag in FURNITURE and tag != "form" or tag == "header" and not within
        self.soft = tag not in NEVER and (tag == "form" or header or bool(known))
        self.prose = self.soft and (tag == "form" or any(PROSE.intersection(x) for x in known))
        self.junk = self.lost = self.title = False
        self.size = self.content = 0


def mark(nodes: list[Node], found: list[tuple[Node, int, str]]) -> None:
    """Set ``junk``: furniture, named nodes, and all within them; and ``lost``: forms and comments of these.

    A node that only its name or a form's tag marks is spared if it holds most of the text
    outside the furniture, unless an article or main element lies elsewhere.
    """
    for x in nodes[1:]:
        x.junk = x.hard or x.up.junk
    for x, _, text in found:
        if not x.junk:
            x.size += len(text.strip())
    holds = [x.tag in ("article", "main") and not x.junk for x in nodes]
    for x in reversed(nodes[1:]):
        x.up.size += x.size
        holds[x.up.n] += holds[x.n]
    for x in nodes[1:]:
        spared = 2 * x.size > nodes[0].size and (holds[x.n] or not holds[0])
        x.junk = x.hard or x.up.junk or x.soft and not spared
        x.lost = x.up.lost or x.prose and not spared


def leaves(page: str) -> tuple[list[Node], list[tuple[Node, int, str]]]:
    """All nodes, parents first; and (node, block number, text) in page order.

    A block ends where an element that is not inline begins or ends.
    """
    paths: dict = {}
    root = Node("#root", None, "", 0, paths)
    nodes, open_, counts = [root], [root], defaultdict(int)
    out, block, last = [], 0, 0

    def leave(n: int) -> None:
        for x in open_[n:]:
            counts[x.tag] -= 1
        del open_[n:]

    for m in TOKEN.finditer(page):
        if m.start() > last:
            out.append((open_[-1], block, page[last : m.start()]))
        last = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            out.append((open_[-1], block, " "))
            continue
        if tag not in INLINE:
            block += 1
        if m["end"]:
            if counts[tag]:
                i = len(open_) - 1
                while open_[i].tag != tag and not (tag in INLINE and open_[i].tag in BOUND):
                    i -= 1
                if open_[i].tag == tag:
                    leave(i)
        elif tag not in VOID:
            closes = CLOSES.get(tag) or ({"p"} if tag not in INLINE else ())
            if any(counts[c] for c in closes):
                i = len(open_) - 1
                while i:
                    if open_[i].tag in closes:
                        leave(i)
                        if tag != "tr":
                            break
                    elif open_[i].tag in BOUND:
                        break
                    i -= 1
            if not m["attrs"].endswith("/"):
                names = " ".join(a[1] or a[2] or a[3] for a in ATTR.findall(m["attrs"])) if m["attrs"] else ""
                x = Node(tag, open_[-1], names, len(nodes), paths)
                nodes.append(x)
                open_.append(x)
                counts[tag] += 1
    if last < len(page):
        out.append((open_[-1], block, page[last:]))
    mark(nodes, out)
    return nodes, out


def content_paths(found: list[tuple[Node, int, str]]) -> set[int]:
    """The tag paths whose smoothed, fused and weighted ratios reach the threshold."""
    size, marks, nodes, weight = defaultdict(int), defaultdict(int), defaultdict(set), defaultdict(float)
    for node, _, text in found:
        t = text.strip()
        if t:
            size[node.path] += len(t)
            marks[node.path] += len(PUNCTUATION.findall(t))
            nodes[node.path].add(node.n)
            weight[node.path] = max(weight[node.path], 0.0 if node.lost else DOUBT if node.junk else 1.0)
    if not size:
        return set()
    paths = list(size)
    per = np.array([len(nodes[p]) for p in paths], float)
    kernel = np.array([0.25, 0.5, 0.25])
    smooth = lambda v: np.convolve(np.pad(v, 1, mode="edge"), kernel, "valid")
    fused = smooth(np.array([size[p] for p in paths]) / per) * (1 + smooth(np.array([marks[p] for p in paths]) / per))
    fused *= np.array([weight[p] for p in paths])
    return {p for p, s in zip(paths, fused) if s > 0 and s >= SPREAD * fused.std()}


def region(nodes: list[Node], found: list[tuple[Node, int, str]], good: set[int]) -> Node | None:
    """The innermost container of most of the text on the paths ``good``; an article or main element if one holds over half."""
    for node, _, text in found:
        if t := text.strip():
            if node.path in good:
                node.content += len(t)
            node.title = node.title or node.tag == "h1" and not node.junk
    for x in reversed(nodes[1:]):
        x.up.content += x.content
        x.up.title = x.up.title or x.title
    total = nodes[0].content
    if not total:
        return None
    named = [x for x in nodes if x.tag in ("article", "main") and not x.lost and 2 * x.content > total]
    if named:
        return max(named, key=lambda x: x.depth)
    below = defaultdict(list)
    for x in nodes[1:]:
        if x.tag in CONTAINER and x.content >= MOST * total:
            below[x.up.n].append(x)
    best = nodes[0]
    while inner := [x for x in below[best.n] if x.title or not best.title]:
        best = inner[0]
    return best


def main_text(page: str | None) -> str:
    nodes, found = leaves(page or "")
    good = content_paths(found)
    best = region(nodes, found, good)
    if best is None:
        return ""
    held = [False] * len(nodes)
    for x in nodes:  # parents first
        held[x.n] = x is best or x.up is not None and held[x.up.n]
    blocks: dict[int, list[str]] = {}
    for node, block, text in found:
        if held[node.n] and (node.path in good or not node.junk):
            blocks.setdefault(block, []).append(text)
    lines = (" ".join(unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


@F.pandas_udf(T.StringType())
def extracted(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    x = pages.select("page_id", "url", extracted("html").alias("text"))
    return x.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
