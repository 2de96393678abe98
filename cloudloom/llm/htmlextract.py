"""Main text of HTML pages: boosted trees score DOM nodes, and one decoding chooses among them together.

The decoding walks the tree once: on any path from the root the labels are first outside, then main
text, then outside again. So no node inside a dropped part of an article comes back, and an article
isn't both kept and dropped. The trees are fitted here, on pages from a generator that knows which of
their parts are main text (see training_pages); the generator's words are made up, so only structure
counts.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cloudloom.llm.gbt import Trees, fit
from cloudloom.llm.shared import map_batches, renamed

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript template svg".split())
SILENT = frozenset("head select option optgroup button datalist object audio video canvas map progress meter".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
#: Elements that can stand in head; any other start tag, and text that isn't blank, ends it.
IN_HEAD = frozenset("head html base basefont bgsound link meta noframes noscript script style template title".split())
#: A start tag of a key closes the open elements of its value, up to the nearest element that holds such items.
CLOSES = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)),
    "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")),
    "tbody": frozenset(("thead", "tbody", "tfoot", "tr", "td", "th")), "tfoot": frozenset(("thead", "tbody", "tr", "td", "th")),
}
HOLDS_ITEMS = frozenset("ul ol dl menu dir table select div section article main body".split())
HOLDS_P = frozenset("td th caption button table object html body".split())

# Words of class, id and role attributes that speak for or against main text.
FOR = frozenset("article body content entry main post story text".split())
AGAINST = frozenset(
    "ad ads advert advertisement adverts alert banner bar breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies"
    " copyright disqus footer form gdpr header links login masthead menu meta modal nav navbar navigation newsletter notice pagination popup privacy"
    " promo recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toc toolbar"
    " topbar widget widgets".split()
)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPLIT = re.compile(r"[^a-z]+")
_END = re.compile(r"[.!?,;:]")


class Page:
    """The block elements of a page in document order, and its text blocks."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.depth, self.tokens = ["#"], [-1], [0], [frozenset()]
        self.tags = [0]  # elements opened in each node, inline ones too
        self.linked = [0]  # characters of link text in each node's own blocks
        self.blocks: list[tuple[int, str]] = []
        self._parts: list[str] = []
        self._links = 0
        self._stack: list[tuple[str, int]] = [("#", 0)]
        self._open: dict[str, int] = defaultdict(int)
        self._read(source)

    def _flush(self) -> None:
        if self._parts:
            node = self._stack[-1][1]
            if text := " ".join("".join(self._parts).split()):
                self.blocks.append((node, text))
                self.linked[node] += min(self._links, len(text))
            self._parts, self._links = [], 0

    def _pop(self) -> None:
        tag, _ = self._stack[-1]
        if tag in BLOCK:
            self._flush()
        self._stack.pop()
        self._open[tag] -= 1

    def _close(self, tag: str, limits: frozenset[str] = frozenset()) -> None:
        """Close the nearest open element of this tag, and all in it, if no limit stands between."""
        if not self._open[tag]:
            return
        for name, _ in reversed(self._stack):
            if name == tag:
                break
            if name in limits:
                return
        while self._stack[-1][0] != tag:
            self._pop()
        self._pop()

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            if self._open["p"]:
                self._close("p", HOLDS_P)
            if closes := CLOSES.get(tag):
                for name, _ in reversed(self._stack[1:]):
                    if name in closes:
                        self._close(name)
                        if tag in ("tr", "tbody", "tfoot") and any(self._open[c] for c in closes) and self._stack[-1][0] in closes:
                            continue
                        break
                    if name in HOLDS_ITEMS:
                        break
            self._flush()
        node = self._stack[-1][1]
        self.tags[node] += 1
        if tag in VOID:
            if tag == "br":
                self._parts.append(" ")
            return
        if tag in BLOCK:
            tokens: set[str] = set()
            if attributes:
                for found in _ATTRIBUTE.findall(attributes):
                    tokens.update(_SPLIT.split("".join(found[1:]).lower()))
            self.tag.append(tag)
            self.parent.append(node)
            self.depth.append(self.depth[node] + 1)
            self.tokens.append(frozenset(tokens))
            self.tags.append(0)
            self.linked.append(0)
            node = len(self.tag) - 1
        self._stack.append((tag, node))
        self._open[tag] += 1

    def _text(self, text: str, plain: bool = False) -> None:
        if self._open["head"] and self._stack[-1][0] == "head" and not text.isspace():
            self._close("head")
        if not any(self._open[t] for t in self._silent):
            text = html.unescape(text) if "&" in text and not plain else text
            self._parts.append(text)
            if self._open["a"]:
                self._links += len(text.strip())

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        self._silent: set[str] = set()
        while at < size:
            mark = source.find("<", at)
            if mark < 0:
                mark = size
            if mark > at:
                self._text(source[at:mark])
            if mark == size:
                break
            found = _TAG.match(source, mark) or _LOOSE_TAG.match(source, mark)
            if found is None:
                other = _MARKUP.match(source, mark)
                if other:
                    at = other.end()
                elif re.match(r"</?[a-zA-Z]", source[mark : mark + 3]):
                    break  # a tag that the page's end cuts off
                else:
                    self._text("<")
                    at = mark + 1
                continue
            closing, tag, attributes = found.groups()
            tag, at = tag.lower(), found.end()
            if closing:
                self._close(tag)
                continue
            if self._open["head"] and tag not in IN_HEAD:
                self._close("head")
            if tag == "xmp":  # its text stands as it is written
                end = re.compile(r"</xmp(?=[\s/>])", re.IGNORECASE).search(source, at)
                self._start("xmp", attributes)
                self._text(source[at : end.start() if end else size], plain=True)
                at = end.start() if end else size
            elif tag in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(source, at)
                close = source.find(">", end.end()) if end else -1
                at = close + 1 if close >= 0 else size
            else:
                if tag in SILENT:
                    self._silent.add(tag)
                self._start(tag, attributes)
        self._flush()
        while len(self._stack) > 1:
            self._pop()


TAG_GROUPS = (
    ("article", "main"), ("section",), ("div", "center"), ("p",), ("h1", "h2"), ("h3", "h4", "h5", "h6"), ("li", "ul", "ol", "dl", "dt", "dd", "menu"),
    ("table", "tbody", "tr", "td", "th", "thead", "caption"), ("nav",), ("aside",), ("header", "hgroup"), ("footer",), ("form", "fieldset", "legend"),
    ("blockquote", "pre", "xmp", "figure", "figcaption"), ("body", "html", "#"),
)
_GROUP = {tag: k for k, tags in enumerate(TAG_GROUPS) for tag in tags}
_OUTER = frozenset(("nav", "aside", "footer", "form", "header"))
WIDTH = len(TAG_GROUPS) + 29


def _title_place(page: Page) -> int:
    """The first h1 with text, or -1."""
    return next((node for node, _ in page.blocks if page.tag[node] == "h1"), -1)


def _siblings(page: Page, children: dict[int, list[int]], chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node: the share of its children with the most common make-up, the characters of its largest sibling, and whether that one stands before it.

    All children count, however many; a child's make-up is its tag and the set of its own children's.
    """
    n = len(page.tag)
    alike, largest, before = np.zeros(n), np.zeros(n), np.zeros(n)
    for up, own in children.items():
        if len(own) > 1:
            made = Counter((page.tag[k], frozenset(page.tag[c] for c in children.get(k, ()))) for k in own)
            alike[up] = max(made.values()) / len(own)
            sizes = chars[own]
            first = int(np.argmax(sizes))
            second = float(np.partition(sizes, -2)[-2])
            for place, k in enumerate(own):
                largest[k] = second if place == first else sizes[first]
                before[k] = place != first and own[first] < k
    return alike, largest, before


def node_features(page: Page) -> np.ndarray:
    """A row of WIDTH features for each node of the page."""
    n = len(page.tag)
    own, marks, paragraphs = np.zeros(n), np.zeros(n), np.zeros(n)
    before, seen = np.full(n, -1.0), 0
    for node, text in page.blocks:
        if before[node] < 0:
            before[node] = seen
        own[node] += len(text)
        marks[node] += len(_END.findall(text))
        paragraphs[node] += page.tag[node] == "p"
        seen += len(text)
    parent = np.array(page.parent)
    chars, tags, links, stops, ps = own.copy(), np.array(page.tags, float), np.array(page.linked, float), marks, paragraphs
    for k in range(n - 1, 0, -1):  # children come after their parents
        up = parent[k]
        for v in (chars, tags, links, stops, ps):
            v[up] += v[k]
        if before[k] >= 0 and (before[up] < 0 or before[up] > before[k]):
            before[up] = before[k]
    first_title, heads, pieces = _title_place(page), np.zeros(n), np.zeros(n)
    for node, _ in page.blocks:
        heads[node] += page.tag[node] in ("h1", "h2", "h3", "h4", "h5", "h6")
        pieces[node] += 1
    children: dict[int, list[int]] = defaultdict(list)
    last = np.arange(n)  # the last node of each subtree
    for k in range(n - 1, 0, -1):
        up = parent[k]
        heads[up] += heads[k]
        pieces[up] += pieces[k]
        last[up] = max(last[up], last[k])
        children[up].append(k)
    alike, largest, shorter_before = _siblings(page, children, chars)
    count, index = np.zeros(n), np.zeros(n)
    good, bad = np.zeros(n), np.zeros(n)
    good_up, bad_up, outer_up, main_up = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n):
        up = parent[k]
        good[k], bad[k] = len(page.tokens[k] & FOR), len(page.tokens[k] & AGAINST)
        if up >= 0:
            index[k] = count[up]
            count[up] += 1
            good_up[k], bad_up[k] = good_up[up] + good[up], bad_up[up] + bad[up]
            outer_up[k] = outer_up[up] + (page.tag[up] in _OUTER)
            main_up[k] = main_up[up] + (page.tag[up] in ("article", "main"))
    up = np.maximum(parent, 0)
    siblings = np.maximum(count[up], 1)
    total = max(chars[0], 1.0)
    rest = (chars[up] - own[up] - chars) / np.maximum(siblings - 1, 1)
    x = np.zeros((n, WIDTH))
    x[np.arange(n), [_GROUP.get(t, 2) for t in page.tag]] = 1
    columns = (
        good, bad, good_up, bad_up, outer_up, main_up, np.log1p(chars), np.log1p(own), links / np.maximum(chars, 1), chars / (1 + tags), np.array(page.depth),
        siblings, index / siblings, np.log1p(np.maximum(rest, 0)), ps, stops / np.maximum(chars, 1), chars / total, (links / np.maximum(chars, 1))[up],
        before / total, (chars / (1 + tags))[up], bad[up], np.log1p(chars[up]),
        alike, alike[up], chars / np.maximum(largest, 1), shorter_before, np.log1p(chars / np.maximum(pieces, 1)), heads / np.maximum(pieces, 1),
        np.where((np.arange(n) <= first_title) & (first_title <= last), 0, np.sign(np.arange(n) - first_title)),
    )
    x[:, len(TAG_GROUPS) :] = np.column_stack(columns)
    return x


#: What a change of label along a path costs, in log-odds; it keeps single odd nodes with their parents.
CHANGE = 2.0
CLIP = 6.0
#: Elements that hold the whole page. They are main text only if most of the text stands in them directly.
ROOTS = frozenset(("#", "html", "body"))


def decode(page: Page, logits: np.ndarray) -> np.ndarray:
    """Whether each node is main text: the best labels that run outside, main, outside along every path."""
    n = len(page.tag)
    gain = np.clip(logits, -CLIP, CLIP)
    own = np.zeros(n)
    for node, text in page.blocks:
        own[node] += len(text)
    for k in range(n):
        if page.tag[k] in ROOTS:
            gain[k] = CLIP if 2 * own[k] > own.sum() else -n * CLIP
    best = np.zeros((n, 3))  # of a subtree, by its root's label: before, main, after
    turn = np.zeros((n, 3), dtype=np.int64)  # by the parent's label: the label taken
    best[:, 1] = gain
    for k in range(n - 1, 0, -1):
        outside, main, after = best[k]
        cost = CHANGE * (page.tag[page.parent[k]] not in ROOTS)
        options = ((outside, main - cost), (main, after - cost), (after,))
        for label, values in enumerate(options):
            step = int(np.argmax(values))
            turn[k, label] = label + step
            best[page.parent[k], label] += values[step]
    label = np.zeros(n, dtype=np.int64)
    label[0] = int(best[0, 1] > best[0, 0])
    for k in range(1, n):
        label[k] = turn[k, label[page.parent[k]]]
    return label == 1


def training_pages(n: int, seed: int = 7, wide: bool = False) -> Iterator[tuple[str, list[str]]]:
    """n made-up pages, each with the blocks of its main text; on wide ones some runs of like parts are up to 100 times as long."""
    chance = random.Random(seed)

    def many(low: int, high: int) -> int:
        """How many like parts follow each other."""
        k = chance.randint(low, high)
        return int(k * 100 ** chance.random()) if wide and chance.random() < 0.3 else k

    letters = ["".join(chance.choice("bcdfghklmnprstvz") + chance.choice("aeiouäé") for _ in range(chance.randint(1, 4))) for _ in range(2000)]

    def words(low: int, high: int, stop: str = ".") -> str:
        out = [chance.choice(letters) for _ in range(chance.randint(low, high))]
        if chance.random() < 0.1:  # text without a language's marks
            return " ".join(out[: chance.randint(1, 3)] * chance.randint(1, 1 + high // 4))
        for k in range(7, len(out) - 1, 9):
            out[k] += chance.choice((",", ".", ""))
        return (" ".join(out)).capitalize() + stop

    layout = ("hd", "ft", "row", "col", "col-4", "col-8", "box", "inner", "block", "grid", "wrap", "l1", "r2", "cell", "unit", "panel")

    def attribute(*names: str) -> str:
        name = chance.choice(names)
        if chance.random() < 0.3:  # names that tell nothing
            return f' class="{chance.choice(layout)}"'
        return chance.choice(("", f' class="{name}"', f' id="{name}"', f' class="{name} {chance.choice(letters)}"', f' class="x-{name}"'))

    def sure(*names: str) -> str:
        return attribute(*names) or f' class="{names[0]}"'

    def links(k: int) -> str:
        if chance.random() < 0.3:
            return " ".join(f'<a href="/{chance.choice(letters)}">{words(1, 3, "")}</a>' for _ in range(k))
        return "<ul>" + "".join(f'<li><a href="/{chance.choice(letters)}">{words(1, 3, "")}</a></li>' for _ in range(k)) + "</ul>"

    def plain() -> str:
        return f' class="{chance.choice(layout)}"' if chance.random() < 0.7 else ""

    def top_bar() -> str:
        """A site's head whose names don't tell: a short name and links."""
        name = chance.choice((words(1, 3, ""), f'<a href="/">{words(1, 3, "")}</a>', f"<h2>{words(1, 3, '')}</h2>"))
        return f"<div{plain()}>{name} {links(chance.randint(2, 8))}</div>" if chance.random() < 0.8 else f"<div{plain()}>{name}</div>"

    def side_bar(tag: str = "div") -> str:
        """A column of links and teasers whose names don't tell."""
        parts = [f"<h3>{words(1, 3, '')}</h3>{links(chance.randint(3, 9))}" for _ in range(chance.randint(1, 3))]
        if chance.random() < 0.4:
            parts.append(f"<h4>{words(1, 3, '')}</h4><p>{words(3, 20)}</p>")
        return f"<{tag}{plain()}>{''.join(parts)}</{tag}>"

    def reader_notes() -> str:
        """Readers' comments whose names don't tell: many parts made alike, each short, with who wrote it."""
        who = lambda: chance.choice((f"<h4>{words(1, 2, '')}</h4>", f"<b>{words(1, 2, '')}</b> ", f"<p><a href='/u'>{words(1, 2, '')}</a></p>"))
        item = chance.choice(("div", "li", "article"))
        made = [f"<{item}{plain()}>{who()}<p>{words(3, 40)}</p></{item}>" for _ in range(many(3, 9))]
        inner = f"<ul>{''.join(made)}</ul>" if item == "li" else "".join(made)
        return f"<div{plain()}><h3>{words(1, 3, '')}</h3>{inner}</div>"

    def bottom_bar() -> str:
        return f"<div{plain()}>{chance.choice(('&copy; ', 'Copyright ', ''))}{words(1, 8, '')} {links(chance.randint(2, 6))}</div>"

    def outside(kind: int | None = None) -> str:
        """A part that isn't main text."""
        kind = chance.randrange(12) if kind is None else kind
        if kind == 0:
            return f"<nav{attribute('nav', 'menu')}>{links(chance.randint(2, 9))}</nav>"
        if kind == 1:
            return f"<div{sure('menu', 'navbar', 'breadcrumbs', 'toolbar')}>{links(chance.randint(2, 6))}</div>"
        if kind == 2:
            return f"<header{attribute('header', 'masthead')}><h1>{words(1, 4, '')}</h1><p>{words(2, 9)}</p></header>"
        if kind == 3:
            return f"<div{sure('ad', 'advert', 'sponsored', 'promo', 'banner')}>{chance.choice(('', '<p>'))}{words(4, 40)}</div>"
        if kind == 4:
            return f"<aside{attribute('sidebar', 'related')}><h3>{words(1, 4, '')}</h3>{chance.choice((links(4), '<p>' + words(8, 50) + '</p>'))}</aside>"
        if kind == 5:
            return f"<div{sure('sidebar', 'widget', 'related', 'recommended')}><h4>{words(1, 4, '')}</h4>{links(4)}<p>{words(5, 30)}</p></div>"
        if kind == 6:
            return f"<div{sure('cookie-notice', 'gdpr', 'consent', 'alert', 'popup', 'notice')}><p>{words(8, 40)}</p><button>{words(1, 2, '')}</button></div>"
        if kind == 7:
            return f"<form{attribute('newsletter', 'search', 'login')} action=/x><p>{words(4, 20)}</p><label>{words(1, 4, '')}</label><input name=q><button>go</button></form>"
        if kind == 8:
            own = "".join(f"<div{attribute('comment')}><h4>{words(1, 2, '')}</h4><p>{words(5, 60)}</p><p>{words(3, 40)}</p></div>" for _ in range(many(1, 5)))
            return f"<{(t := chance.choice(('section', 'div')))}{sure('comments', 'disqus', 'replies')}><h3>{words(1, 3, '')}</h3>{own}</{t}>"
        if kind == 9:
            return f"<div{sure('share', 'social', 'tags', 'meta', 'byline')}><a href=/a>{words(1, 2, '')}</a> <a href=/b>{words(1, 2, '')}</a> {words(1, 5, '')}</div>"
        if kind == 10:
            return f"<footer{attribute('footer')}>{chance.choice(('&copy; ', '<p>'))}{words(4, 40)}{chance.choice(('', links(3)))}</footer>"
        return f"<div{sure('footer', 'copyright', 'subscribe', 'newsletter')}><p>{words(4, 40)}</p></div>"

    def inside(blocks: list[str]) -> str:
        """A part of main text, whose blocks are added to the list."""
        kind, out = chance.randrange(12), []

        def block(tag: str, low: int, high: int, attributes: str = "") -> str:
            text = words(low, high)
            blocks.append(text)
            if chance.random() < 0.2:
                first, _, rest = text.partition(" ")
                shown = f"<b>{first}</b> {rest}" if chance.random() < 0.5 else f'<a href="/y">{first}</a> {rest}'
            else:
                shown = text
            return f"<{tag}{attributes}>{shown}" + ("" if tag == "p" and chance.random() < 0.15 else f"</{tag}>")

        if kind < 6:
            out += [block("p", 1, chance.choice((2, 12, 60, 120))) for _ in range(many(1, 6))]
        elif kind == 6:
            out.append(block(chance.choice(("h2", "h3")), 1, 8))
        elif kind == 7:
            out += ["<ul>", *[block("li", 2, 20) for _ in range(many(2, 6))], "</ul>"]
        elif kind == 8:
            out += ["<blockquote>", block("p", 5, 40), "</blockquote>"]
        elif kind == 9:
            out += ["<table>", *["<tr>" + block("td", 1, 5) + block("td", 1, 5) + "</tr>" for _ in range(many(1, 4))], "</table>"]
        elif kind == 10:
            out += ["<figure><img src=/z.png>", block("figcaption", 3, 15), "</figure>"]
        else:
            tag = chance.choice(("div", "section"))
            out += [f"<{tag}{attribute('text', 'entry')}>", *[block("p", 2, 60) for _ in range(chance.randint(1, 4))], f"</{tag}>"]
        return "".join(out)

    for _ in range(n):
        blocks: list[str] = []
        body = []
        if chance.random() < 0.85:
            blocks.append(words(2, 12))
            body.append(f"<h1>{blocks[-1]}</h1>")
        for _ in range(chance.randint(1, 9)):
            body.append(inside(blocks))
            if chance.random() < 0.12:
                body.append(outside())
        if not blocks:
            body.append(inside(blocks))
        tag, names = chance.choice(
            (("article", ("post", "story")), ("article", ("article",)), ("main", ("main",)), ("div", ("content", "post", "entry-content", "article-body", "story")), ("section", ("content", "main")), ("div", ("wrapper",)), ("td", ("content",)), ("", ("",)), ("", ("",)))
        )
        core = "".join(body) if not tag else f"<{tag}{attribute(*names)}>{''.join(body)}</{tag}>"
        if tag == "td":
            core = f"<table><tr>{core}</tr></table>"
        if chance.random() < 0.3:
            core = f"<div{attribute('container', 'page', 'wrapper')}>{chance.choice(('', outside()))}{core}{chance.choice(('', outside()))}</div>"
        top = [outside() for _ in range(chance.randint(0, 4))]
        end = [outside() for _ in range(chance.randint(0, 4))]
        if chance.random() < 0.3:
            top.insert(0, outside(0))
        if chance.random() < 0.4:
            end.append(outside(10))
        if chance.random() < 0.3:  # a page whose names don't tell, in columns or in a table, around an article of some length
            while sum(map(len, blocks)) < 600:
                body.append("".join(inside(blocks)))
            after = chance.choice(("", reader_notes()))
            if chance.random() < 0.4:
                cells = [f"<td{chance.choice((plain(), ' class=menu'))}>{chance.choice((links(6), side_bar()))}</td>", f"<td{plain()}>{''.join(body)}</td>"]
                if chance.random() < 0.5:
                    cells.append(side_bar("td"))
                core = f"<table><tr><td colspan=3>{top_bar()}</td></tr><tr>{''.join(cells)}</tr></table>"
            else:
                tag = chance.choice(("article", "div", "div", "section", "main"))
                article = f"<{tag}{plain()}>{''.join(body)}</{tag}>{after}"
                columns = [f"<div{plain()}>{article}</div>", side_bar()]
                core = "".join(columns[:: chance.choice((1, -1))]) if chance.random() < 0.7 else article
                if chance.random() < 0.6:
                    core = f"<div{plain()}>{core}</div>"
            top, end = [chance.choice((top_bar, outside))()], [chance.choice((bottom_bar, outside))()]
        script = '<script>var t="</p>";</script>' if chance.random() < 0.5 else ""
        yield f"<!DOCTYPE html><html><head><title>{words(2, 6, '')}</title>{script}</head><body>{''.join(top)}{core}{''.join(end)}</body></html>", blocks


TRAINING_PAGES, TREES, DEPTH = 2500, 100, 5
#: For so many training pages there is a wide one, so that the trees know long runs of comments from long articles.
PAGES_A_WIDE_ONE = 8
_fitted: dict[int, Trees] = {}


def labelled_nodes(pages: Iterator[tuple[str, list[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the pages' nodes: main text if most of a node's characters are."""
    xs, ys = [], []
    for source, blocks in pages:
        page, wanted = Page(source), iter([*blocks, None])
        chars, good = np.zeros(len(page.tag)), np.zeros(len(page.tag))
        want = next(wanted)
        for node, text in page.blocks:
            chars[node] += len(text)
            if text == want:
                good[node] += len(text)
                want = next(wanted)
        for k in range(len(page.tag) - 1, 0, -1):
            chars[page.parent[k]] += chars[k]
            good[page.parent[k]] += good[k]
        # what holds the article and much else is outside: only the article itself is main text
        has = (chars > 0) & ~np.isin(page.tag, tuple(ROOTS))
        xs.append(node_features(page)[has])
        ys.append((good[has] > 0.7 * chars[has]).astype(float))
    return np.concatenate(xs), np.concatenate(ys)


def model(pages: int = TRAINING_PAGES) -> Trees:
    """The trees fitted on so many training pages and the wide ones added to them, once per process."""
    if pages not in _fitted:
        made = chain(training_pages(pages), training_pages(pages // PAGES_A_WIDE_ONE, seed=8, wide=True))
        _fitted[pages] = fit(*labelled_nodes(made), trees=TREES, depth=DEPTH)
    return _fitted[pages]


def main_text(sources: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page: its blocks in order, one to a line; empty for null, blank or pages without any."""
    pages = [Page(s or "") for s in sources]
    rows = [node_features(p) for p in pages]
    logits = trees.logits(np.concatenate(rows)) if rows else np.empty(0)
    out, at = [], 0
    for page, x in zip(pages, rows, strict=True):
        kept = decode(page, logits[at : at + len(x)])
        at += len(x)
        out.append("\n".join(text for node, text in page.blocks if kept[node]))
    return out


def extract(pages: DataFrame, trees: Trees | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row: the main text of the whole page and its length in code points.

    A null page counts as empty and gives an empty text, and so does a page without main text. Pages are
    read whole at any length, each in one row's memory. Of labellings that score alike the one with less
    main text is taken. Repeated rows and null ids each come back, equal pages with equal texts; an empty
    table gives an empty result; other columns are not read.
    """
    held = pages.sparkSession.sparkContext.broadcast(trees or model())

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t for at in range(0, batch.num_rows, 256) for t in main_text(batch.column(2).slice(at, 256).to_pylist(), held.value)]
        sizes = pa.array([len(t) for t in texts], type=pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), sizes], ["id", "url", "text", "n_chars"])

    rows = renamed(pages, id=id_col, url=url_col, html=html_col).selectExpr("cast(id as long) id", "url", "html")
    return map_batches(rows, per_batch, "id long, url string, text string, n_chars long")
