"""Main text of web pages by tree scoring.

A page becomes a tree of blocks. Subtrees that are no part of an article by their
element, role or name (menus, sidebars, adverts, forms, comments, ...) are taken out
first. Every text block left passes points to its ancestors, one for itself, one per
comma and up to three for its length, the whole to its parent, half to the next one and
less further up, discounted by the share of its text that is links. Containers add the
points of their kind and are discounted by their own link density; the best one and
those of its siblings that look like parts of the same text are the article.

Pages are independent, so Spark only splits the rows; nothing is shuffled. Time and
memory of a page are proportional to its length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: what a paragraph passes to its ancestors, nearest first
SHARES = (1.0, 0.5, 0.25, 0.125, 0.0625)
#: a sibling of the best container with this share of its points is part of the text
SIBLING = 0.2
#: characters for which a block gets one point, and the most points it gets for them
PER_POINT, MOST = 100, 3
#: a list or table with this share of links and links enough is a menu
MENU_DENSITY, MENU_LINKS = 0.8, 3
#: characters of a block that is text for sure
LONG = 80

# Fixed values of HTML: elements by their kind.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select "
    "summary table tbody td template tfoot th thead tr ul".split())
_CLOSES_P = _BLOCKS - frozenset("body caption dd dt head html legend li option select tbody td template tfoot th thead tr".split())
#: an element that ends open elements of these kinds, unless one of the others stands between
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
_IN_HEAD = frozenset("meta link base template".split())
_P_SCOPE = ("table", "td", "th", "button", "object")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# What is no part of an article, by element, role and word of class or id.
_OUT = frozenset("nav aside footer form dialog select button script style template head iframe object svg canvas "
                 "audio video menu map datalist fieldset label progress meter noscript textarea title option".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search searchbox alert alertdialog dialog menu menubar "
                       "form toolbar tablist status note".split())
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising advertorial sponsor sponsors sponsored promo "
    "promos promoted promotion promotions banner banners nav navbar navigation navi menu menus submenu breadcrumb "
    "breadcrumbs pagination pager sidebar sidebars sidenav aside rail footer footers foot masthead topbar toolbar header "
    "headers comment comments commentlist commenting disqus respond replies reply cookie cookies consent gdpr notice "
    "notices notification notifications alert alerts popup popups modal overlay lightbox newsletter subscribe "
    "subscription signup signin login register registration social share sharing shares sharebar related recommended "
    "recommendations trending outbrain taboola widget widgets form forms search searchform searchbox skip "
    "disclaimer copyright feedback".split())
#: a word after one of these says what is not there or how a page is laid out
_NOT = frozenset("no not non has have with without hide show is js".split())
#: words of containers of an article, and of parts of one
_IN_WORDS = frozenset("article articles body content entry hentry main page post story text blog".split())
_ARTICLE_WORDS = frozenset("article entry hentry post story".split())
_PARTS = frozenset("p pre blockquote figure table ul ol dl".split())
_CONTAINERS = frozenset("#page html body article main section div td".split())
_WHOLE_WORDS = _ARTICLE_WORDS | {"content"}

_TAG = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|(!--)|([!?/]))")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?|[\s/]*=""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}


class Node:
    """An element; ``at`` and ``end`` bound the text blocks below it."""

    __slots__ = ("tag", "parent", "block", "words", "role", "hidden", "mute", "at", "end", "out", "article", "points",
                 "children")

    def __init__(self, tag: str, parent, block, attributes: dict, at: int):
        self.tag, self.parent, self.at, self.end = tag, parent, at, at
        self.block, self.mute = block, False  # the nearest block around it
        self.words = [w.lower() for k in ("class", "id") for w in _WORD.findall(attributes.get(k) or "")]
        self.role = (attributes.get("role") or "").strip().lower()
        style = (attributes.get("style") or "").replace(" ", "").lower()
        self.hidden = ("hidden" in attributes or (attributes.get("aria-hidden") or "").lower() == "true"
                       or "display:none" in style or "visibility:hidden" in style)
        self.out = self.article = False
        self.points = 0.0
        self.children: list[Node] = []


class Text:
    """A run of text within one block: pieces, and how many of its characters are links."""

    __slots__ = ("node", "pieces", "linked", "links", "text")

    def __init__(self, node: Node):
        self.node, self.pieces, self.linked, self.links, self.text = node, [], 0, 0, ""


class Page:
    """Blocks and texts of a page in order."""

    def __init__(self, source: str):
        self.nodes: list[Node] = []
        self.texts: list[Text] = []
        self._stack: list[Node] = []
        self._depth: dict[str, list[int]] = {}
        self._blocks: list[int] = []
        self._run: Text | None = None
        self._link = self._mute = 0
        self._push("#page", {})
        self._parse(source)
        while self._stack:
            self._pop()
        for t in self.texts:
            # a reference is decoded where it stands: tags part texts, not references
            t.text = " ".join("".join(t.pieces).split())
            t.pieces = []

    def _push(self, tag: str, attributes: dict) -> None:
        parent = self._stack[-1] if self._stack else None
        node = Node(tag, parent, self._stack[self._blocks[-1]] if self._blocks else None, attributes, len(self.texts))
        if tag in _BLOCKS or tag == "#page":
            self._run = None
            self._blocks.append(len(self._stack))
        elif node.hidden or tag in _OUT or _named_out(node):
            # text in an inline element has the block around it, which may stay
            node.mute = True
            self._mute += 1
        if parent is not None:
            parent.children.append(node)
        self._depth.setdefault(tag, []).append(len(self._stack))
        self._stack.append(node)
        self.nodes.append(node)

    def _pop(self) -> None:
        node = self._stack.pop()
        self._depth[node.tag].pop()
        node.end = len(self.texts)
        self._mute -= node.mute
        if node.tag == "a":
            self._link = 0
        if node.tag in _BLOCKS or node.tag == "#page":
            self._run = None
            self._blocks.pop()

    def _pop_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            self._pop()

    def _at(self, tags) -> int:
        """Depth of the innermost open element of some kinds, -1 if there is none."""
        return max((self._depth[t][-1] for t in tags if self._depth.get(t)), default=-1)

    def _open(self, tag: str, attributes: dict) -> None:
        if self._stack[-1].tag == "head" and tag not in _IN_HEAD:
            self._pop()
        if tag in _CLOSES_P and (p := self._at(("p",))) > self._at(_P_SCOPE):
            self._pop_to(p)
        if tag in _HEADINGS and (h := self._at(_HEADINGS)) >= 0 and h == self._blocks[-1]:
            self._pop_to(h)
        if tag in _ENDS:
            ends, unless = _ENDS[tag]
            bound = self._at(unless)
            over = [d[-1] for t in ends if (d := self._depth.get(t)) and d[-1] > bound]
            # all of them: a row ends its cells too
            while over:
                self._pop_to(min(over))
                over = [d[-1] for t in ends if (d := self._depth.get(t)) and d[-1] > bound]
        if tag == "a" and self._depth.get("a"):
            self._link = 0
        if tag in ("html", "body") and self._depth.get(tag):
            return
        if tag == "br":
            self._say(" ")
        elif tag == "hr":
            self._run = None
        if tag in _VOID:
            return
        self._push(tag, attributes)
        if tag == "a" and "href" in attributes:
            self._link = 1

    def _close(self, tag: str) -> None:
        if tag == "br":
            self._say(" ")
        if tag == "a":
            self._link = 0
        open_at = self._depth.get(tag)
        if tag == "p":
            self._run = None
        if not open_at or tag in ("html", "body", "#page"):
            return
        if self._at(_P_SCOPE if tag == "p" else _ENDS[tag][1] if tag in _ENDS else ()) > open_at[-1]:
            return
        # the end of an inline element does not end the blocks inside it
        if tag in _BLOCKS or self._blocks[-1] < open_at[-1]:
            self._pop_to(open_at[-1])

    def _say(self, raw: str) -> None:
        if self._mute or self._run is None and raw.isspace():
            return
        if self._stack[-1].tag == "head":
            self._pop()
        if self._run is None:
            self._run = Text(self._stack[self._blocks[-1]])
            self.texts.append(self._run)
        said = html.unescape(raw) if "&" in raw else raw
        self._run.pieces.append(said)
        if self._link:
            self._run.linked += len(said)
            self._run.links += self._link == 1
            self._link = 2

    def _parse(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                self._say(s[at:])
                return
            m = _TAG.match(s, lt)
            if m is None:  # a "<" that begins no tag is text
                nxt = s.find("<", lt + 1)
                nxt = n if nxt < 0 else nxt
                self._say(s[at:nxt])
                at = nxt
                continue
            if lt > at:
                self._say(s[at:lt])
            slash, name, comment, other = m.groups()
            if comment:
                end = s.find("-->", m.end())
                if s.startswith((">", "->"), m.end()):
                    at = s.index(">", m.end()) + 1
                else:
                    at = n if end < 0 else end + 3
            elif other:
                end = s.find(">", m.end())
                at = n if end < 0 else end + 1
            else:
                at, attributes = self._attributes(s, m.end())
                tag = name.lower()
                if slash:
                    self._close(tag)
                elif tag in _RAW:
                    end = _RAW_END[tag].search(s, at)
                    if end is None:
                        return
                    at = s.find(">", end.end()) + 1 or n
                else:
                    self._open(tag, attributes)

    @staticmethod
    def _attributes(s: str, at: int) -> tuple[int, dict]:
        found: dict[str, str] = {}
        while at < len(s) and s[at] != ">":
            m = _ATTRIBUTE.match(s, at)
            if m is None or m.end() == at:
                at += 1
                continue
            at = m.end()
            if m.group(1):
                value = m.group(2) or m.group(3) or m.group(4) or ""
                found.setdefault(m.group(1).lower(), html.unescape(value) if "&" in value else value)
        return at + 1, found


def _named_out(node: Node) -> bool:
    """Whether a class or id names a part that is no article text."""
    words = node.words
    for before, w in zip(["", *words], words, strict=False):
        if w in _OUT_WORDS and before not in _NOT and not (
                w in ("header", "headers", "page") and (node.article or _ARTICLE_WORDS.intersection(words))):
            return True
    return False


def _mark(page: Page) -> None:
    """Set ``out`` on the subtrees that are no part of an article, ``article`` inside one."""
    size, linked, links, long = [0], [0], [0], [0]
    for t in page.texts:
        size.append(size[-1] + len(t.text))
        linked.append(linked[-1] + t.linked)
        links.append(links[-1] + t.links)
        long.append(long[-1] + (t.node.tag == "p" and len(t.text) >= LONG))
    holds: set[int] = set()
    for node in page.nodes:
        if node.tag in ("article", "main") or node.role == "main":
            up = node.parent
            while up is not None and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
    for node in page.nodes:  # parents come before their children
        up = node.parent
        if up is not None:
            node.out = up.out
            node.article = up.article or up.tag in ("article", "main") or up.role in ("main", "article")
        if node.out or node.tag in ("#page", "html", "body"):
            continue
        if node.hidden:
            node.out = True
        elif id(node) in holds:  # a wrapper of the article, whatever its name
            continue
        elif node.tag == "form" and long[node.end] - long[node.at] >= 3:  # a page within one form
            continue
        elif node.tag in _OUT or node.role in _OUT_ROLES or node.tag == "header" and not node.article:
            node.out = True
        elif node.tag in ("article", "main"):
            node.out = any(w in ("comment", "comments", "reply", "replies") for w in node.words)
        elif _named_out(node):
            node.out = True
        elif node.tag in ("ul", "ol", "table", "dl"):
            a, z = node.at, node.end
            node.out = (links[z] - links[a] >= MENU_LINKS
                        and linked[z] - linked[a] >= MENU_DENSITY * (size[z] - size[a]) > 0)


def _semantic(node: Node) -> bool:
    return node.tag in ("article", "main") or node.role in ("main", "article")


def _density(node: Node, size: list[int], linked: list[int]) -> float:
    total = size[node.end] - size[node.at]
    return (linked[node.end] - linked[node.at]) / total if total else 0.0


def _kind(node: Node) -> float:
    """Points of a container for what it is."""
    points = 25.0 if _semantic(node) else 0.0
    points += {"div": 5.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0,
               "li": -3.0, "table": 0.0, "address": -3.0}.get(node.tag, -5.0 if node.tag in _HEADINGS else 0.0)
    return points + (25.0 if _IN_WORDS.intersection(node.words) else 0.0)


def main_text(source: str) -> str:
    """The main text of a page, its blocks joined by line feeds; empty if there is none."""
    page = Page(source)
    _mark(page)
    size, linked = [0], [0]
    for t in page.texts:
        live = bool(t.text) and not t.node.out
        size.append(size[-1] + (len(t.text) if live else 0))
        linked.append(linked[-1] + (min(t.linked, len(t.text)) if live else 0))
    scored: dict[int, Node] = {}
    for i, t in enumerate(page.texts):
        chars = size[i + 1] - size[i]
        if not chars:
            continue
        worth = 1 + t.text.count(",") + t.text.count("，") + t.text.count("、") + min(chars / PER_POINT, MOST)
        worth *= 1 - (linked[i + 1] - linked[i]) / chars
        # a run of text is a paragraph of its block, or of its parent if the block is a paragraph itself
        node = t.node if t.node.tag in _CONTAINERS else t.node.block
        for share in SHARES:
            if node is None:
                break
            node.points += worth * share
            scored[id(node)] = node
            node = node.block
    if not scored:
        return ""
    rank = {}
    for k, node in scored.items():
        rank[k] = (node.points + _kind(node)) * (1 - _density(node, size, linked))
    # the first in page order of the best, which is the outer one of two of equal points
    order = {id(n): i for i, n in enumerate(page.nodes)}
    best = max(scored.values(), key=lambda n: (rank[id(n)], -order[id(n)]))
    up = best
    while up is not None:  # a part of an article stands for the whole of it
        if _semantic(up) or up.tag in ("div", "section", "td") and _WHOLE_WORDS.intersection(up.words):
            best = up
            break
        up = up.block
    wanted, whole = [best], _semantic(best)
    if best.parent is not None and best.tag not in ("body", "html"):
        need = SIBLING * rank.get(id(best), 0.0)
        for n in best.parent.children:
            if n is best or n.out:
                continue
            chars = size[n.end] - size[n.at]
            loose = _density(n, size, linked) < 0.25
            if whole:
                keep = n.tag == best.tag and loose
            else:
                keep = loose and chars > 0 and (chars >= LONG or rank.get(id(n), 0.0) >= need
                                                or n.tag in _HEADINGS or n.tag in _PARTS)
            if keep:
                wanted.append(n)
    wanted.sort(key=lambda n: n.at)
    lines = []
    spans = [(n.at, n.end) for n in wanted]
    if len(wanted) > 1 and not whole:
        # text that stands loose between the parts belongs to their parent
        spans += [(i, i + 1) for i in range(best.block.at, best.block.end) if page.texts[i].node is best.block]
    for a, z in sorted(spans):
        lines += [page.texts[i].text for i in range(a, z) if size[i + 1] > size[i]]
    return "\n".join(lines)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [main_text(h.decode("utf-8", "replace")) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    A null or empty page, and one without text, gives an empty text of 0 characters.
    Null ids and urls stay null; repeated rows give a row each; other columns are
    ignored; an empty table gives no rows. Pages of any length are read whole; markup
    that is broken or never closed is read as far as it makes sense. Character
    references are decoded, white space within a block becomes one space, blocks are
    joined by one line feed; headings, captions, lists and tables of the article stay.
    """
    view = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("html"))
    out = view.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
