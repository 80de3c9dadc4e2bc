"""Main text of web pages by composite text density.

A page becomes a tree of nodes by a tolerant parser (unclosed and implied tags, raw script and style text, comments,
quoted attributes) that reads it once from left to right. Elements that by the HTML standard are no article text
(navigation, page headers, footers, asides, forms, scripts, styles, ...) are cut off.

Density decides what the article is. For every node left, with C characters, T tags, LC characters in links and LT links
below it, the link-adjusted density is C/T * log_b(C/LC * T/LT), b = ln(C/(C-LC) * LC + LCbody/Cbody * C + e). A node's
density sum adds up its children's densities. The subtree with the largest sum is found; the smallest density on the
path from it to the body is the threshold; going down from the body, a node that reaches the threshold contributes the
subtree below it with the largest sum. If the largest sum is the body's, the body is taken whole, unless one container's
sum exceeds that of all that stands beside it.

Names only annotate. Elements whose class, id or role names an advert, menu, notice, comment area, ... add nothing to
the sums and are left out of the text, unless they hold a `main`, an `h1` or an `article` without such a name (a wrapper
called after something beside the article), or nothing else is left of the page. Paragraphs, list items and headings are
left out for names of adverts, comments and the like only, not for being called a notice. An `article` or `main` around a
subtree that density has found is taken whole: it breaks the tie between the text and the heading above it.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined by one space.

Defined results: null or empty html and pages without text give an empty string; a comment or raw element that never
ends takes the rest of the page with it, as in the HTML standard; a tag that never ends is text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing

# fixed values of the HTML language
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
# what is no article
CUT_TAGS = frozenset("nav footer aside form script style noscript template iframe object embed svg canvas button select textarea input dialog head title menu noembed noframes xmp".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form toolbar".split())
# what an element is called after that is no article: by any word of its name, or by the last one only
STRONG_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments commentlist disqus cookie cookies consent gdpr newsletter subscribe subscription share sharing social related recommended recommendations sidebar sidenav menu menus navbar breadcrumb breadcrumbs pagination pager popup modal".split())
LAST_WORDS = frozenset("nav navigation aside banner footer notice notices alert overlay signup replies reply respond teaser widget widgets toolbar legal disclaimer login search skip".split())
STATES = frozenset("has with without no is not show hide js".split())  # begin names that say what an element lacks or contains
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption summary".split())

_SHORT_COMMENT, _COMMENT_END = re.compile(r"<!---?>"), re.compile(r"--!?>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>=]")
_BLANK = re.compile(r"\s*")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _tag_end(page: str, at: int, absent: set[str]) -> int:
    """Where the `>` of a tag stands whose attributes begin at `at`, outside of quoted values; -1 if the page ends before.

    absent: quotes of which none is left ahead; one that is never closed is read like any other character.
    """
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        at = _BLANK.match(page, m.end()).end()
        quote = page[at : at + 1]
        if quote in ("'", '"') and quote not in absent:
            close = page.find(quote, at + 1)
            if close < 0:
                absent.add(quote)
            at = max(at, close) + 1
    return -1


def tokens(page: str) -> Generator[tuple[str, str, bool, str, int], int | None, None]:
    """(text, name, closing, attributes, end of the tag) for each tag and the text before it; the last one has no name.

    Where raw text follows a tag, its end is sent in.
    """
    at, end, text, absent = 0, len(page), 0, set()
    while (at := page.find("<", at)) >= 0:
        after = page[at + 1 : at + 2]
        if after == "!" and page.startswith("<!--", at):
            if m := _SHORT_COMMENT.match(page, at):
                stop = m.end()
            else:
                m = _COMMENT_END.search(page, at + 4)
                stop = m.end() if m else end
        elif after in ("!", "?") and after:
            stop = page.find(">", at) + 1 or end
        else:
            closing = after == "/"
            m = _NAME.match(page, at + 1 + closing)
            if not m:
                at += 1
                continue
            stop = _tag_end(page, m.end(), absent)
            if stop < 0:
                break
            jump = yield page[text:at], m[0].lower(), closing, page[m.end() : stop], stop + 1
            at = text = jump or stop + 1
            continue
        yield page[text:at], "", False, "", stop
        at = text = stop
    yield page[text:], "", False, "", end


class Tree:
    """Nodes in page order: parent, tag, attributes, and the texts (node, text) between them."""

    def __init__(self, page: str):
        self.parent, self.tag, self.attributes = [-1], ["#root"], [""]
        self.content: list[tuple[int, str]] = []  # (node, text), or (node, "") where a block begins or ends
        self.body = 0
        self._open: dict[str, int] = {}  # how many elements of a name are open
        stack, seen = [0], set()
        reader = tokens(page)
        token = next(reader, None)
        while token is not None:
            text, name, closing, attributes, at = token
            jump = None
            if text:
                self.content.append((stack[-1], text))
            if name and closing:
                self._close(stack, name)
            elif name:
                jump = self._start(page, stack, seen, name, attributes, at)
            try:
                token = reader.send(jump)
            except StopIteration:
                token = None

    def _start(self, page: str, stack: list[int], seen: set[str], name: str, attributes: str, at: int) -> int | None:
        """Opens an element; returns where reading goes on if it holds raw text."""
        if name in CLOSES_P:
            self._imply(stack, {"p"}, {"button", "table", "td", "th", "li", "dd", "div", "article", "section", "body", "blockquote"})
        elif name in SIBLINGS:
            self._imply(stack, *SIBLINGS[name])
        if name in ("html", "body"):
            if name in seen:
                return None
            seen.add(name)
        if name == "body":
            self._imply(stack, {"head"}, {"html"})
        node = len(self.parent)
        self.parent.append(stack[-1])
        self.tag.append(name)
        self.attributes.append(attributes)
        if name == "body":
            self.body = node
        if name not in INLINE:
            self.content.append((node, ""))
        if name in VOID or attributes.endswith("/") and name not in INLINE and name not in CLOSES_P:
            return None
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if name in ("textarea", "title"):
                self.content.append((node, page[at : close.start() if close else len(page)]))
            return close.end() if close else len(page)
        stack.append(node)
        self._open[name] = self._open.get(name, 0) + 1
        return None

    def _pop(self, stack: list[int], depth: int) -> None:
        for node in stack[depth:]:
            self._open[self.tag[node]] -= 1
            if self.tag[node] not in INLINE:
                self.content.append((node, ""))
        del stack[depth:]

    def _imply(self, stack: list[int], names: set[str], bounds: set[str]) -> None:
        if not any(self._open.get(x) for x in names):
            return
        lowest = None
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag in names:
                lowest = depth
            elif tag in bounds:
                break
        if lowest is not None:
            self._pop(stack, lowest)

    def _close(self, stack: list[int], name: str) -> None:
        if not self._open.get(name):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag == name:
                self._pop(stack, depth)
                return
            # a stray inline or paragraph end tag closes nothing beyond its block
            if (name in INLINE or name == "p") and tag in ("article", "main", "section", "div", "body", "td", "th", "li", "table"):
                return


def _is_cut(tag: str, inside_article: bool) -> bool:
    return tag in CUT_TAGS or tag == "header" and not inside_article


def _is_beside(tag: str, attributes: str, inside_article: bool) -> bool:
    """Whether an element is called after something that is no article."""
    if not attributes or tag in ("html", "body", "main", "#root"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        if name.lower() == "role":
            if value.lower() in CUT_ROLES:
                return True
            continue
        for token in value.split():
            words = [w.lower() for w in _WORD.findall(token)]
            if not words or words[0] in STATES:
                continue
            if STRONG_WORDS.intersection(words) or tag not in TEXT_TAGS and words[-1] in LAST_WORDS:
                return True
            if not inside_article and tag not in TEXT_TAGS and words[-1] == "header" and (len(words) == 1 or words[0] in ("page", "site", "main", "top")):
                return True
    return False


def _sums(parent: list[int], own: list[int], alive: list[bool]) -> list[int]:
    """own, summed over each node and the living nodes below it."""
    out = [x if a else 0 for x, a in zip(own, alive, strict=True)]
    for i in range(len(out) - 1, 0, -1):
        out[parent[i]] += out[i]
    return out


def densities(tree: Tree, own: list[int], alive: list[bool], body: int) -> tuple[list[int], list[float]]:
    """Characters and link-adjusted characters per tag of every node; own: characters directly in each node."""
    parent, tag, n = tree.parent, tree.tag, len(tree.parent)
    link = [False] * n
    for i in range(1, n):
        link[i] = link[parent[i]] or tag[i] == "a"
    chars = _sums(parent, own, alive)
    links = _sums(parent, [x if at else 0 for x, at in zip(own, link, strict=True)], alive)
    tags = _sums(parent, [1] * n, alive)
    link_tags = _sums(parent, [int(t == "a") for t in tag], alive)
    ratio = links[body] / max(1, chars[body])
    out = [0.0] * n
    for i in range(n):
        c, lc = chars[i], links[i]
        if alive[i] and c:
            t, lt = max(1, tags[i] - 1), max(1, link_tags[i] - (tag[i] == "a"))
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            out[i] = c / t * math.log(max(c / max(1, lc) * t / lt, 1.0)) / math.log(max(base, 1.0000001))
    return chars, out


def main_nodes(tree: Tree, chars: list[int], density: list[float], alive: list[bool], body: int) -> set[int]:
    """The roots of the subtrees that density chooses."""
    parent, tag, n = tree.parent, tree.tag, len(tree.parent)
    total, blocks = [0.0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if alive[i]:
            total[parent[i]] += density[i]
            blocks[parent[i]] += chars[i] > 0 and tag[i] not in INLINE
    # a node without children holds its own text: its density is its sum
    whole = [total[i] or density[i] for i in range(n)]
    live = [i for i in range(n) if alive[i] and chars[i]]
    tops = ("html", "body", "#root")
    best = max(live, key=lambda i: (whole[i], -i))
    if tag[best] in tops:
        # a container holds its own against the body if what stands beside it adds up to less
        below = max((i for i in live if tag[i] not in tops and (blocks[i] > 1 or tag[i] in ("article", "main"))), key=lambda i: (whole[i], -i), default=-1)
        up = below
        while up > 0 and parent[up] != body:
            up = parent[up]
        if up <= 0 or total[body] - density[up] >= whole[below]:
            return {best}  # the paragraphs stand in the body itself: its own density is no threshold for its children
        best = below
    threshold, up = density[best], best
    while up not in (body, 0):
        up = parent[up]
        threshold = min(threshold, density[up])
    # the node with the largest sum below each node, itself included
    peak = list(range(n))
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if alive[i] and whole[peak[i]] > whole[peak[p]]:
            peak[p] = peak[i]
    chosen, reached = set(), [False] * n
    for i in range(n):
        if i and reached[parent[i]]:
            reached[i] = True
        elif i not in (body, 0) and alive[i] and chars[i] and density[i] >= threshold - 1e-9 and tag[i] not in ("html", "head"):
            reached[i] = True
            # an inline root would cut its block apart
            chosen.add(i if tag[peak[i]] in INLINE else peak[i])
    return chosen or {body}


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    tree = Tree(page)
    parent, tag = tree.parent, tree.tag
    n = len(parent)
    alive, scope, beside = [True] * n, [False] * n, [False] * n  # scope: inside an article or main element
    for i in range(1, n):
        p = parent[i]
        scope[i] = scope[p] or tag[i] in ("article", "main")
        alive[i] = alive[p] and not _is_cut(tag[i], scope[p])
        beside[i] = alive[i] and _is_beside(tag[i], tree.attributes[i], scope[p])
    own, decoded = [0] * n, []
    for node, text in tree.content:
        if text and alive[node]:
            text = html.unescape(text) if "&" in text else text
            own[node] += len("".join(text.split()))
        decoded.append(text)
    # a main, an h1 or the longest article voids what the elements around it are called
    size = _sums(parent, own, alive)
    articles = [i for i in range(n) if tag[i] == "article" and alive[i] and not beside[i]]
    longest = max(articles, key=lambda i: (size[i], -i), default=-1)
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        holds[parent[i]] |= holds[i] or alive[i] and (tag[i] in ("main", "h1") or i == longest)
    left = list(alive)
    for i in range(1, n):
        left[i] = left[parent[i]] and alive[i] and (not beside[i] or holds[i])
    if _sums(parent, own, left)[0]:
        alive = left
    body = tree.body
    chars, density = densities(tree, own, alive, body)
    if not chars[body]:
        body = 0
        chars, density = densities(tree, own, alive, body)
    if not chars[body]:
        return ""
    chosen = main_nodes(tree, chars, density, alive, body)
    # the outermost article or main around each node, itself included
    outer = [-1] * n
    for i in range(1, n):
        outer[i] = outer[parent[i]] if outer[parent[i]] >= 0 else i if tag[i] in ("article", "main") else -1
    chosen = {outer[i] if outer[i] >= 0 else i for i in chosen}
    taken = [False] * n
    out = []
    for i in range(n):
        taken[i] = alive[i] and (i in chosen or i > 0 and taken[parent[i]])
    for (node, _), text in zip(tree.content, decoded, strict=True):
        if taken[node]:
            out.append(text if text else " ")
    return " ".join("".join(out).split())


def extract_pages(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row: key, url, text and n_chars (code points)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column("_page")]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_key", "_url", "text", "n_chars"])

    picked = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{url}`").alias("_url"), F.col(f"`{page}`").cast("string").alias("_page"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[:2])
    out = picked.mapInArrow(releasing(work), f"{kinds}, text string, n_chars long")
    return out.select(F.col("_key").alias(key), F.col("_url").alias(url), "text", "n_chars")
