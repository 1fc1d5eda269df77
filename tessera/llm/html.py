"""Main text of HTML pages by composite text density (Sun, Song and Liao 2011).

A page becomes a tree in flat arrays, in page order. Every node gets its characters per tag, adjusted by the
share of link characters and link tags; a node's density sum adds up the densities of its children. The subtree
with the largest sum is the main content. The least density on its path to the body is the threshold that
decides what else beside that path belongs to it. Marked elements (article, main and the like) only add: the
nearest one around the main content is taken whole. Elements that are never part of an article (scripts, menus,
forms, and what whole names in class or id call adverts, comments and the like) are left out before densities are
computed; names that only hint at that leave the decision to density.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import texts_in

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?:(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<odd>[^>]*+)(?:>|\Z))|<[!?/][^>]*+(?:>|\Z)""",
    re.DOTALL,
)
#: One attribute after another, each with its value, so that nothing within a value passes for a name.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt html legend option optgroup tbody td tfoot th thead title tr".split()) | {"dd", "dt", "li"}
#: A start tag ends an open element of these names, unless one of the others was opened since.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
CELLS = frozenset({"td", "th", "table", "caption", "object"})
PARTS = frozenset({"tr", "tbody", "thead", "tfoot"})
NOISE_TAGS = frozenset("script style noscript template head nav footer aside form button select textarea input iframe svg canvas object dialog menu title audio video map".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Whole names in class or id that mark what no article has, whatever its density.
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored nav navbar navigation breadcrumb breadcrumbs pagination sidebar sidenav footer"
    " masthead comment comments commentlist comment-list comments-area disqus disqus_thread respond cookie cookies cookie-banner cookie-notice consent gdpr newsletter".split()
)
#: Names of what holds a whole page; other names beside them tell its state, as in "page sidebar".
PAGE_NAMES = frozenset({"page", "site", "layout"})
#: Whole names that hint at it: such an element stays only within the main content, and only as dense as the body path is at least.
HINTS = frozenset(
    "banner notice alert popup modal overlay menu pager widget widgets promo promotion share sharing social related recommended recommendations subscribe subscription signup login replies".split()
)
CONTENT_TAGS = frozenset({"article", "main"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})


class Tree:
    """Nodes in page order: node i's subtree is i to last[i]. ``pieces`` has texts, and None at block edges."""

    def __init__(self, html: str):
        self.tag, self.parent, self.noise, self.main, self.hint = ["html"], [-1], [False], [False], [False]
        self.pieces: list[tuple[int, str | None]] = []
        named = self._read(html)
        n = len(self.tag)
        self.last = list(range(n))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            self.last[p] = max(self.last[p], self.last[i])
        # An element that holds the page's heading or its main element is no noise, whatever its names say.
        heads = [i for i in range(n) if not self.noise[i] and self.tag[i] in ("h1", "main")]
        for i in range(1, n):
            if i in named:
                k = bisect_right(heads, i)
                self.noise[i] |= k == len(heads) or heads[k] > self.last[i]
            self.noise[i] |= self.noise[self.parent[i]]

    def _read(self, html: str) -> set[int]:
        """Reads a page; the elements that only their names mark as noise."""
        named: set[int] = set()
        tag, pieces = self.tag, self.pieces
        # Open elements from the root, and the depths at which each name is open, so nothing is searched for.
        stack, names, depths = [0], ["html"], {"html": [0]}
        at, n = 0, len(html)

        def pop_to(depth: int) -> None:
            while len(names) > depth:
                depths[names.pop()].pop()
                if tag[i := stack.pop()] in BLOCK:
                    pieces.append((i, None))

        def nearest(some) -> int:
            return max((d[-1] for x in some if (d := depths.get(x))), default=0)

        while at < n:
            m = MARKUP.search(html, at)
            a, b = m.span() if m else (n, n)
            if a > at and not self.noise[stack[-1]]:
                pieces.append((stack[-1], html[at:a]))
            at = b
            if not m or not m["name"]:
                continue
            name = m["name"].lower()
            if m["close"] and name != "br":
                depth = nearest((name,))
                if depth and name != "body" and (name in CELLS or name in PARTS or depth > nearest(CELLS)):
                    pop_to(depth)
                continue
            if name in ("html", "body") and depths.get("body"):
                continue
            if name in CLOSES_P and (depth := nearest(("p",))) > nearest(CELLS):
                pop_to(depth)
            if name in IMPLIED:
                ends, bounds = IMPLIED[name]
                if (depth := nearest(ends)) > nearest(bounds):
                    pop_to(depth)
            if name == "body" and depths.get("head"):
                pop_to(depths["head"][0])
            if name == "br":
                pieces.append((stack[-1], " "))
            above = stack[-1]
            i = len(tag)
            noise, main, hint, by_name = self._kind(name, m["attrs"] or m["odd"] or "", any(depths.get(x) for x in CONTENT_TAGS))
            if by_name:
                named.add(i)
            tag.append(name)
            self.parent.append(above)
            self.noise.append(noise or self.noise[above])
            self.main.append(main)
            self.hint.append(hint)
            if name in BLOCK:
                pieces.append((i, None))
            if name in RAW:
                end = RAW[name].search(html, at)
                at = html.find(">", end.end()) + 1 or n if end else n
            elif name not in VOID and not (m["attrs"] or "").endswith("/"):
                depths.setdefault(name, []).append(len(names))
                stack.append(i)
                names.append(name)
        return named

    def _kind(self, name: str, attrs: str, inside: bool) -> tuple[bool, bool, bool, bool]:
        """Whether an element is noise; whether it marks the article; whether its names hint at noise, or say so."""
        main = name in CONTENT_TAGS
        inside = inside or main
        if name in NOISE_TAGS or name == "header" and not inside:
            return True, False, False, False
        if not attrs.strip(" /"):
            return False, main, False, False
        found: dict[str, str] = {}
        for k, v in ATTRIBUTE.findall(attrs):
            found.setdefault(k.lower(), (v[1:-1] if v[:1] in ("'", '"') else v).lower())
        if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
            return True, False, False, False
        role = found.get("role", "")
        main = main or role in ("main", "article") or found.get("itemprop") == "articlebody"
        own = {*found.get("class", "").split(), *found.get("id", "").split()}
        if name == "article" and own & {"comment", "reply", "teaser", "related", "ad", "advert"}:
            return True, False, False, False
        if main or name in ("html", "body"):
            return False, main, False, False
        header = not inside and bool(own & {"header", "site-header", "page-header", "global-header", "top-header"})
        return role in NOISE_ROLES or header, False, bool(own & HINTS), bool(own & NOISE_NAMES) and not own & PAGE_NAMES


def density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Link-adjusted characters per tag; ``ratio`` is the body's share of link characters."""
    if not chars:
        return 0.0
    tags, link_chars, link_tags, plain = tags or 1, link_chars or 1, link_tags or 1, chars - link_chars or 1
    return chars / tags * math.log(chars * tags / (link_chars * link_tags)) / math.log(math.log(chars * link_chars / abs(plain) + ratio * chars + math.e))


def extract(html: str | None) -> str:
    """The article's text: white space within a block as one space, blocks joined by one space; empty where there is none."""
    return main_text(Tree(html)) if html else ""


def densities(tree: Tree) -> tuple[list[float], list[float], int, list[tuple[int, str | None]]]:
    """Every node's density and density sum, the body, and the pieces of text outside noise, decoded."""
    n, tag, parent = len(tree.tag), tree.tag, tree.parent
    link = [False] * n
    for i in range(1, n):
        link[i] = tag[i] == "a" or link[parent[i]]
    own, links = [0] * n, [0] * n
    pieces = [(i, unescape(t) if t and "&" in t else t) for i, t in tree.pieces if not tree.noise[i]]
    for i, text in pieces:
        if text:
            size = len(" ".join(text.split()))
            own[i] += size
            links[i] += size * link[i]
    chars, link_chars = own[:], links[:]
    tags, link_tags = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if not tree.noise[i]:
            p = parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + link[i]
    body = next((i for i in range(n) if tag[i] == "body"), 0)
    ratio = link_chars[body] / chars[body] if chars[body] else 0.0
    dense = [density(chars[i], tags[i], link_chars[i], link_tags[i], ratio) for i in range(n)]
    sums = [density(own[i], 0, links[i], int(link[i]), ratio) for i in range(n)]
    for i in range(n - 1, 0, -1):
        if not tree.noise[i]:
            sums[parent[i]] += dense[i]
    return dense, sums, body, pieces


def main_text(tree: Tree) -> str:
    n, tag, parent = len(tree.tag), tree.tag, tree.parent
    dense, sums, body, pieces = densities(tree)
    if not any(t and not t.isspace() for _, t in pieces):
        return ""
    inside = [i for i in range(body, tree.last[body] + 1) if not tree.noise[i]]
    best = max(inside, key=lambda i: (sums[i], -i))
    path = [best]
    while path[-1] != body:
        path.append(parent[path[-1]])
    threshold = min(dense[i] for i in path)
    whole = next((i for i in path if tree.main[i]), best)
    # Beside the path: what is as dense as the least dense node on it; a block of bare text other than a heading,
    # a paragraph or a marked element must be as dense as the main content. Hinted noise is no part of it.
    on, above = set(path), set(path[1:])
    beside = [i for i in inside if i not in on and parent[i] in above and dense[i] >= threshold and not tree.hint[i]]
    chosen = [whole] + [i for i in beside if tag[i] in HEADINGS or tag[i] == "p" or tree.main[i] or sums[i] > dense[i] or tag[i] in BLOCK and dense[i] >= dense[best]]
    # How many chosen elements hold each node, and how many hinted ones that are less dense than the body path.
    held, left_out = [0] * (n + 1), [0] * (n + 1)
    for i in chosen:
        held[i] += 1
        held[tree.last[i] + 1] -= 1
    for i in inside:
        if tree.hint[i] and i not in on and dense[i] < threshold:
            left_out[i] += 1
            left_out[tree.last[i] + 1] -= 1
    held, left_out = list(accumulate(held)), list(accumulate(left_out))
    text = "".join(" " if t is None else t for i, t in pieces if held[i] and not left_out[i])
    return " ".join(text.split())


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: a map without any shuffle.

    Null, empty and article-less pages give an empty text; a page cut in mid-markup gives what it holds; repeated
    rows, null ids and null urls come out as they went in; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            texts = [extract(x) for x in texts_in(batch.column("html"))]
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
