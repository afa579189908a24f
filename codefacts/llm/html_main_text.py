"""Main text of web pages by gradient-boosted trees over DOM nodes.

Each element of a page is a node with features of its subtree (text, links, density, children), of its attributes (do
their tokens or its tag speak of furniture or of content), of its depth and place, and of its siblings. Boosted
regression trees, trained here on nodes labelled by known texts, give each node the odds of being main text. Decoding is hierarchical: each
subtree is either all out, all in, or split among its children and its own texts, whichever has the largest sum of log
odds weighted by the text that the choice decides; a node inside a chosen one can't contradict it.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, prepare, sampled

#: Fixed: elements without an end tag; without text of their own; that end a paragraph; that stand inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript svg math head title iframe object canvas textarea select option button".split())
BLOCKS = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul body html".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Fixed: what can stand in a head; silent elements that an end tag inside can't leave; those that a block ends.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
FENCES = frozenset("iframe noscript object script style template textarea title".split())
FOREIGN = frozenset(("svg", "math"))


def _ends(tags: str, ended: str, fence: str, silent: frozenset[str] = SILENT) -> dict[str, tuple[frozenset[str], frozenset[str]]]:
    return {t: (frozenset(ended.split()), silent | frozenset(fence.split())) for t in tags.split()}


#: Fixed: tags that end open elements without an end tag: which, and what keeps them from it.
ENDS = (
    _ends("li", "li", "ul ol menu") | _ends("dt dd", "dt dd", "dl") | _ends("rt rp", "rt rp", "ruby") | _ends("rtc rb", "rt rp rtc rb", "ruby")
    | _ends("td th", "td th caption", "table tr") | _ends("tr", "td th tr caption colgroup", "table")
    | _ends("thead tbody tfoot colgroup caption", "td th tr thead tbody tfoot colgroup caption", "table")
    | _ends("option", "option", "select datalist optgroup", FENCES) | _ends("optgroup", "option optgroup", "select datalist", FENCES)
)
#: Fixed: tags and attribute tokens of page furniture and of content.
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog".split())
FURNITURE = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disqus "
    "footer header legal login masthead menu meta modal nav navbar navigation newsletter notice paywall popup promo promoted "
    "related reply replies share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
CONTENT = frozenset("article articlebody body content entry main mainentity post story text".split())

#: Characters of a block that is found in a known text by more than chance.
TELLING = 25

_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def plain(text: str) -> str:
    return " ".join(text.split())


@dataclass
class Node:
    tag: str
    parent: Node | None
    depth: int
    tokens: frozenset[str] = frozenset()
    parts: list = field(default_factory=list)  # texts and nodes in page order
    chars: int = 0
    linked: int = 0
    tags: int = 0
    paragraphs: int = 0
    own: int = 0  # characters of its own texts
    children: list = field(default_factory=list)
    place: int = 0  # among its siblings, and how many and how long they are
    siblings: int = 1
    around: int = 0


class Tree(HTMLParser):
    """A forgiving tree of elements: unknown ends are skipped, missing ends are added, the end of the page ends all.

    Silent elements are nodes while they are open, but hang from no other node, so they and all in them are no part of the tree.
    """

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, 0)
        self.open: dict[str, list[Node]] = defaultdict(list)  # the open nodes of each tag, the deepest last
        self.begun = False  # the head is over, whether or not its end was seen
        last = page.rfind("<")
        if last >= 0 and page.find(">", last) < 0 and (page[last + 1 : last + 2].isalpha() or page[last + 1 : last + 2] in ("/", "!", "?")):
            page = page[:last]  # an unfinished tag at the end
        self.feed(page)
        self.close()
        self._measure()

    def handle_starttag(self, tag, attrs):
        if tag == "html" or tag == "head" and (self.begun or self.open["head"]):
            return
        if tag == "body" and not self.open["template"] or self.at.tag == "head" and tag not in IN_HEAD:
            self._end_head()
        if tag == "body":
            return
        if tag in BLOCKS:
            self._end_open(FOREIGN, frozenset(("foreignobject", "desc", "title", "annotation-xml")))
        if tag in ("select", "form", "input", "textarea"):
            self._end_open(frozenset(("select", "option")), FENCES | {"button"})
        if tag == "p" or tag in BLOCKS:
            self._end_open(frozenset(("p",)), (BLOCKS | SILENT) - {"p"})
        if tag in ENDS:
            self._end_open(*ENDS[tag])
        self.begun |= not self.open["head"] and tag != "head" and tag not in IN_HEAD
        names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label"))
        node = Node(tag, self.at, self.at.depth + 1, frozenset(t.lower() for t in _TOKEN.findall(names)))
        if tag not in SILENT:
            self.at.parts.append(node)
            self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag].append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._end_open(frozenset((tag,)), FENCES - {tag})

    def _deepest(self, tags: frozenset[str]) -> Node | None:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), key=lambda n: n.depth, default=None)

    def _end_open(self, tags: frozenset[str], fence: frozenset[str]) -> None:
        """Ends the open nodes of these tags that no open node of ``fence`` holds, and with them all that they hold."""
        while (node := self._deepest(tags)) is not None:
            held = self._deepest(fence)
            if held is not None and held.depth > node.depth:
                return
            self._end(node)
            if len(tags) == 1:
                return

    def _end(self, node: Node) -> None:
        while self.at is not node.parent:
            self.open[self.at.tag].pop()
            self.at = self.at.parent

    def _end_head(self) -> None:
        if self.open["head"]:
            self._end(self.open["head"][0])
        self.begun = True

    def handle_data(self, data):
        if data and not data.isspace():
            if self.at.tag == "head":
                self._end_head()
            self.begun |= not self.open["head"] and self.at.tag not in SILENT
        self.at.parts.append(data)

    def _measure(self) -> None:
        self.order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            self.order.append(node)
            stack += reversed(node.children)
        for node in reversed(self.order):
            node.own = node.chars = sum(len(plain(p)) for p in node.parts if not isinstance(p, Node))
            around = sum(c.chars for c in node.children)
            for k, child in enumerate(node.children):
                node.chars += child.chars
                node.linked += child.chars if child.tag == "a" else child.linked
                node.tags += child.tags + 1
                node.paragraphs += child.paragraphs + (child.tag == "p")
                child.place, child.siblings, child.around = k, len(node.children), around


FEATURES = (
    "chars", "link_density", "tags_per_char", "paragraphs", "depth", "children", "furniture", "furniture_above", "content",
    "content_above", "place", "siblings", "sibling_share", "paragraph", "heading", "link", "block", "text_before",
    "own_share", "page_content", "page_furniture",
)


def marked_furniture(node: Node) -> bool:
    """Whether a tag or an attribute speaks of furniture; the header of an article's title doesn't."""
    return bool(node.tokens & FURNITURE) or node.tag in FURNITURE_TAGS and not _title(node)


def _title(node: Node) -> bool:
    return node.tag == "header" and node.parent is not None and node.parent.tag in ("article", "main") and any(c.tag in HEADINGS for c in node.children)


def node_features(tree: Tree) -> np.ndarray:
    """One row per node, in page order. Sizes count up to where they stop telling main text from furniture."""
    total, before = max(1, tree.root.chars), 0
    furniture: dict[int, int] = {}
    content: dict[int, int] = {}
    rows = []
    # a page that marks its content or its furniture says more by what it leaves unmarked than one without marks
    marks = [(int(n.tag in ("article", "main")) + len(n.tokens & CONTENT) > 0, marked_furniture(n)) for n in tree.order]
    page_content, page_furniture = any(c for c, _ in marks), min(4, sum(f for _, f in marks))
    for node in tree.order:
        parent = node.parent
        above = furniture.get(id(parent), 0) if parent else 0
        inside = content.get(id(parent), 0) if parent else 0
        odd = int(node.tag in FURNITURE_TAGS and not _title(node)) + len(node.tokens & FURNITURE)
        good = int(node.tag in ("article", "main")) + len(node.tokens & CONTENT)
        furniture[id(node)], content[id(node)] = above + odd, inside + good
        rows.append((
            math.log1p(min(node.chars, 2000)), node.linked / max(1, node.chars), node.tags / max(1, node.chars), math.log1p(min(node.paragraphs, 8)),
            min(node.depth, 8), math.log1p(min(len(node.parts), 8)), odd, above, good, inside, node.place / node.siblings, math.log1p(min(node.siblings, 8)),
            min(1.0, node.chars / max(1, node.around)), node.tag == "p", node.tag in HEADINGS, node.tag == "a",
            node.tag in BLOCKS, before / total, node.own / max(1, node.chars),
            page_content, page_furniture,
        ))
        before += node.own
    return np.array(rows, float)


@dataclass(frozen=True)
class Stump:
    """A regression tree as arrays: inner nodes have a feature and a cut, leaves a value."""

    feature: tuple[int, ...]
    cut: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    value: tuple[float, ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right = map(np.asarray, (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        for _ in range(len(feature)):
            inner = feature[at] >= 0
            if not inner.any():
                break
            low = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)
        return np.asarray(self.value)[at]


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, rate: float) -> Stump:
    out: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": [], "value": []}

    def add(rows: np.ndarray, level: int) -> int:
        me = len(out["value"])
        g, h = gradient[rows].sum(), hessian[rows].sum()
        for key, value in (("feature", -1), ("cut", 0.0), ("left", 0), ("right", 0), ("value", float(rate * g / (h + 1.0)))):
            out[key].append(value)
        best = (1e-6, -1, 0.0)
        for f in range(x.shape[1] if level < depth else 0):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, gs, hs = x[order, f], np.cumsum(gradient[order])[:-1], np.cumsum(hessian[order])[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[v[1:] == v[:-1]] = 0
            if len(gain) and gain.max() > best[0]:
                i = int(gain.argmax())
                best = (float(gain[i]), f, float((v[i] + v[i + 1]) / 2))
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            out["feature"][me], out["cut"][me] = best[1], best[2]
            out["left"][me], out["right"][me] = add(rows[low], level + 1), add(rows[~low], level + 1)
        return me

    add(np.arange(len(x)), 0)
    return Stump(*(tuple(out[k]) for k in ("feature", "cut", "left", "right", "value")))


@dataclass(frozen=True)
class Boosted:
    start: float
    trees: tuple[Stump, ...]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3) -> Boosted:
    """Gradient boosting of the logistic loss with Newton steps."""
    share = np.clip((y * weight).sum() / max(weight.sum(), 1e-9), 0.01, 0.99)
    start, trees = float(np.log(share / (1 - share))), []
    odds = np.full(len(x), start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-odds))
        trees.append(_grow(x, weight * (y - p), weight * p * (1 - p), depth, rate))
        odds = odds + trees[-1].predict(x)
    return Boosted(start, tuple(trees))


def placed_blocks(node: Node) -> tuple[list[str], dict[int, tuple[int, int]]]:
    """The texts of a subtree, one per block, white space made one space; and by id, which of them each block element holds."""
    out, line, stack, places = [], [], [(node, 0, iter(node.parts))], {}

    def border() -> None:
        if text := plain("".join(line)):
            out.append(text)
        line.clear()

    while stack:
        at, first, parts = stack[-1]
        part = next(parts, None)
        if part is None:
            stack.pop()
            if at.tag in BLOCKS:
                border()
                places[id(at)] = first, len(out)
        elif isinstance(part, Node):
            if part.tag in BLOCKS:
                border()
            if part.tag == "br":
                line.append(" ")
            stack.append((part, len(out), iter(part.parts)))
        else:
            line.append(part)
    border()
    return out, places


def blocks(node: Node) -> list[str]:
    return placed_blocks(node)[0]


def choices(tree: Tree, odds: np.ndarray) -> tuple[list[str], list[bool]]:
    """What becomes of each node's subtree ("in", "split" or "out") and, where it is split, of its own text, in the order of
    the nodes.

    For every node the best sum over its subtree is that of leaving all out (0), of taking all in (the log odds of
    every node in it, weighted by its own text), or of the best choices of its children and of its own line: its own text
    with the elements inside the line. A line goes or stays as a whole: where the text's odds are positive, a link with
    weak odds stays in its sentence and only what the odds are clearly against is left out; where they are not, the
    elements' sums must make up for it, and else they go with it. Of equal sums the one that takes the subtree whole counts.
    """
    place = {id(n): i for i, n in enumerate(tree.order)}
    every, best, choice, own = np.zeros(len(place)), np.zeros(len(place)), [""] * len(place), [False] * len(place)
    inline = [False] * len(place)
    for i in range(len(place) - 1, -1, -1):
        node = tree.order[i]
        mine = odds[i] * node.own
        every[i], split, line = mine, 0.0, mine
        inside = [k for k in map(place.get, map(id, node.children)) if inline[k]]
        inline[i] = node.tag not in BLOCKS and len(inside) == len(node.children)
        for child in node.children:
            k = place[id(child)]
            every[i] += every[k]
            if mine > 0 and child.tag not in BLOCKS and every[k] + odds[i] * child.chars >= best[k]:
                best[k], choice[k] = every[k], "in"
            if node.own and inline[k]:
                line += best[k]
            else:
                split += best[k]
        own[i] = line > 0 if mine <= 0 and node.own else mine > 0
        if own[i] or not node.own:
            split += max(0.0, line) if node.own else 0.0
        else:
            for k in inside:
                best[k], choice[k] = 0.0, "out"
        best[i] = max(every[i], split, 0.0)
        choice[i] = "out" if best[i] <= 0 else "in" if every[i] >= split else "split"
    return choice, own


def decode(tree: Tree, odds: np.ndarray) -> list[Node]:
    """The nodes that are chosen as whole subtrees, in page order."""
    choice = dict(zip(map(id, tree.order), choices(tree, odds)[0]))
    chosen, stack = [], [tree.root]
    while stack:
        node = stack.pop()
        if choice[id(node)] == "in":
            chosen.append(node)
        elif choice[id(node)] == "split":
            stack += reversed(node.children)
    return chosen


def decoded(tree: Tree, odds: np.ndarray) -> list[str]:
    """The blocks of the main text in page order: whole subtrees, and the own texts of split nodes by their line. A page that says
    nothing of furniture and has nothing chosen is main text as a whole."""
    fate = {id(n): (c, o) for n, c, o in zip(tree.order, *choices(tree, odds))}
    root = Node("html", None, 0)
    stack = [(tree.root, root, False)]
    while stack:
        node, copy, whole = stack.pop()
        choice, own = fate[id(node)]
        whole = whole or choice == "in"
        for part in node.parts:
            if not isinstance(part, Node):
                copy.parts.append(part if whole or choice == "split" and own else " ")
            elif whole or fate[id(part)][0] != "out" or part.tag in BLOCKS or part.tag in VOID:
                copy.parts.append(Node(part.tag, copy, 0))
                if whole or fate[id(part)][0] != "out":
                    stack.append((part, copy.parts[-1], whole))
            else:
                copy.parts.append(" ")  # what is left out parts the words around it
    found = blocks(root)
    if not found and not any(map(marked_furniture, tree.order)):
        return blocks(tree.root)  # nothing on the page speaks of furniture
    return found


def main_texts(pages: list[str], model: Boosted, together: int = 64) -> list[str]:
    """The main text of each page; the trees look at the nodes of ``together`` pages at a time."""
    out = []
    for start in range(0, len(pages), together):
        trees = [Tree(p) for p in pages[start : start + together]]
        rows = [node_features(t) for t in trees]
        odds = np.split(model.log_odds(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
        out += [" ".join(decoded(t, o)) for t, o in zip(trees, odds)]
    return out


def labelled_nodes(page: str, known: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights. A node is main text if all its blocks are found in the known text and one of them is
    long enough to tell or they hold all of it, or if the node around it is main text. Where furniture stands among a
    node's own texts, they alone are asked, since they are what its odds decide."""
    tree, known = Tree(page), plain(known)
    texts, places = placed_blocks(tree.root)
    # sums over the blocks, so that the work does not grow with the depth: not found, telling, characters
    bad, telling, chars = (np.concatenate([[0], np.cumsum(c, dtype=np.int64)]) for c in (
        [t not in known for t in texts], [len(t) >= TELLING for t in texts], [len(t) + 1 for t in texts],
    ))

    def of(texts: list[str]) -> bool:
        return bool(texts) and all(t in known for t in texts) and (max(map(len, texts)) >= TELLING or bool(known) and known in " ".join(texts))

    def found(node: Node) -> bool:
        if node.tag not in BLOCKS:
            return of(blocks(node))
        i, j = places[id(node)]
        if i == j or bad[j] > bad[i]:
            return False
        return telling[j] > telling[i] or 0 < len(known) < chars[j] - chars[i] and known in " ".join(texts[i:j])

    whole: dict[int, bool] = {}
    y = []
    for node in tree.order:
        above = whole.get(id(node.parent), False)
        alone = node.parent is not None and len(node.parent.children) == 1 and not node.parent.own
        whole[id(node)] = above if above or alone else found(node)
        own = node.own and not whole[id(node)] and of([t for p in node.parts if not isinstance(p, Node) and (t := plain(p))])
        y.append(whole[id(node)] or own)
    weight = [np.log1p(node.chars) for node in tree.order]
    return node_features(tree), np.array(y, float), np.array(weight, float)


#: Pages that every model is taught, so that it knows kinds of furniture that its sample may lack. Written for this
#: purpose: t, s, i, m and b are main text (s short, i with elements inside its line, m in several paragraphs, b the same as
#: bare lines), f is furniture; lengths vary so that only structure tells.
TEMPLATES = (
    "<html><body><header><h2>{f}</h2><p>{f}</p></header><main><p>{t}</p><p>{m}</p></main><aside><h3>{f}</h3><p>{f}</p></aside><footer><p>{f}</p></footer></body></html>",
    "<div class='cookie-notice'><p>{f}</p></div><div class='post-content'><p>{t}</p><p>{m}</p></div><div id='comments'><h3>{f}</h3><div class='comment'><p>{f}</p></div><div class='comment'><p>{f}</p></div></div>",
    "<nav><a href='/'>{f}</a> <a href='/n'>{f}</a></nav><article><h1>{t}</h1><div class='ad'>{f}</div><p>{m}</p></article><section class='comments'><p>{f}</p></section>",
    "<div id='sidebar'><ul><li><a href='/a'>{f}</a></li><li><a href='/b'>{f}</a></li></ul></div><div class='article'><p>{t}</p><blockquote>{m}</blockquote></div><form><p>{f}</p><input name='mail'></form>",
    "<article><p>{t}</p><aside class='related'><p>{f}</p></aside><p>{m}</p><form><label>{f}</label></form></article><div class='newsletter'><p>{f}</p></div>",
    "<div class='notice banner'><p>{f}</p></div><div class='story'><div><p>{t}</p></div><div><p>{m}</p></div></div><div class='share'><a href='#'>{f}</a> <a href='#'>{f}</a></div><div class='related'><a href='/x'>{f}</a></div>",
    "<nav><a href='/'>{f}</a></nav><article><p>{t}</p><p>{m}</p></article>",
    "<nav><a href='/'>{f}</a></nav><article>{t}<br><div class='ad'>{f}</div>{b}</article><section class='comments'><div>{f}</div></section>",
    "<div class='menu'>{f}<br>{f}</div><div class='post'>{t}<aside class='related'><a href='/x'>{f}</a></aside>{b}<div class='share'>{f}</div></div><footer>{f}</footer>",
    "<header>{f}</header><main>{t}<br><br>{b}</main><div class='comments'>{f}<div class='comment'>{f}</div></div>",
    # without a wrapper, or without furniture: what is unmarked is main text (s is short, i has elements inside its line)
    "<html><body><p>{s}</p></body></html>",
    "{t}",
    "{t}<br>{b}",
    "<body><p>{t}</p><p>{m}</p></body>",
    "<div>{t}</div><div>{m}</div>",
    "<body><div><div>{t}</div><div>{m}</div></div></body>",
    "<body><h1>{s}</h1><p>{t}</p><p>{m}</p></body>",
    "<table><tr><td>{t}</td></tr><tr><td>{m}</td></tr></table>",
    "<table><tr><td>{t}</td></tr></table><footer>{f}</footer>",
    "<ul><li>{t}</li><li>{m}</li></ul>",
    "<body><p>{i}</p><p>{m}</p></body>",
    "<article><p>{i}</p></article>",
    "<p>{t}</p><p>{m}</p><div class='sidebar'>{f}</div>",
    "<body><p>{t}</p><p>{m}</p><div class='sidebar'><p>{f}</p><a href='/x'>{f}</a></div></body>",
    "<nav><a href='/'>{f}</a></nav><p>{i}</p><p>{m}</p><footer><p>{f}</p></footer>",
    "<nav><ul><li><a href='/'>{f}</a></li></ul></nav><div><div>{t}</div><div>{m}</div></div><footer>{f}</footer>",
    "<header><p>{f}</p></header><div>{t}<br>{b}</div><div class='comments'><p>{f}</p></div>",
    "<div class='menu'><a href='/'>{f}</a></div><h1>{s}</h1><p>{t}</p><p>{m}</p><div class='ad'>{f}</div>",
    "<nav><a href='/'>{f}</a></nav><table><tr><td>{t}</td><td>{m}</td></tr></table><footer><p>{f}</p></footer>",
    "<article><header><h1>{s}</h1></header><p>{t}</p><p>{m}</p></article>",
    "<header><a href='/'>{f}</a></header><article><header><h1>{s}</h1></header><p>{i}</p><p>{m}</p></article><aside><p>{f}</p></aside>",
    "<nav><a href='/'>{f}</a></nav><main><section><h2>{s}</h2><p>{i}</p></section><section><h2>{s}</h2><ul><li>{s}</li><li>{m}</li></ul></section></main><footer>{f}</footer>",
)


def _words(rng: random.Random, least: int, most: int) -> str:
    return " ".join("".join(rng.choice("aeioulnrstmd") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(least, most)))


def taught_pages(variants: int = 12, seed: int = 5, templates: tuple[str, ...] | None = None) -> list[tuple[str, str]]:
    """Each template with texts of random words and lengths, and its main text."""
    rng, pages = random.Random(seed), []
    for template in (templates or TEMPLATES) * variants:
        parts: list[str] = []

        def fill(match: re.Match, parts: list[str] = parts) -> str:
            kind = match.group(1)
            if kind == "f":
                return _words(rng, 1, rng.choice((8, 25, 60))) + rng.choice((".", ""))
            if kind in "mb":
                several = [_words(rng, 5, 60) + "." for _ in range(rng.choice((1, 2, 5, 12, 40)))]
                parts.extend(several)
                tag = "li" if template[match.start() - 4 : match.start()] == "<li>" else "td" if template[match.start() - 4 : match.start()] == "<td>" else \
                    "div" if template[match.start() - 5 : match.start()] == "<div>" else "p"
                return (f"</{tag}><{tag}>" if kind == "m" else "<br>").join(several)
            if kind == "i":
                pieces = [_words(rng, 1, 12) for _ in range(rng.choice((3, 5, 7)))]
                parts.append(" ".join(pieces) + ".")
                tags = ("b", "a", "em", "span", "i", "strong")
                shown = [p if j % 2 == 0 else f"<{t}{' href=/x' if t == 'a' else ''}>{p}</{t}>" for j, p in enumerate(pieces) for t in [rng.choice(tags)]]
                return " ".join(shown) + "."
            parts.append(_words(rng, 2, 8) if kind == "s" else _words(rng, 5, 60) + ".")
            return parts[-1]

        page = re.sub(r"\{([tsmbif])\}", fill, template)
        pages.append((page, " ".join(parts)))
    return pages


def train(pages: list[tuple[str, str]]) -> Boosted:
    """The model of pages with their known texts and of the pages above."""
    parts = [labelled_nodes(p, t) for p, t in [*pages, *taught_pages()]]
    return boost(*(np.concatenate(c) for c in zip(*parts)))


#: Pages that a model is trained on, at most: those whose ids have the smallest hashes.
SAMPLE = 300


def train_from(pages: DataFrame, docs: DataFrame, known: str = r"^[a-z]+://[^/]+/[^/]+/([0-9]+)", sample: int = SAMPLE) -> Boosted:
    """A model from pages whose url names the document that they show (``known``'s group is its doc_id).

    At most ``sample`` pages, whatever the size of the tables: those whose ids have the smallest hashes. Pages without a
    url of that form or without the document it names teach nothing; with none at all the pages in this module do.
    """
    spark = docs.sparkSession
    number = F.nullif(F.regexp_extract("url", known, 1), F.lit("")).try_cast("long")
    rows = pages.select("page_id", F.xxhash64("html").alias("hash"), number.alias("doc_id"), "html").dropna()
    # keys first, then the pages and texts that they name: all bounded by the parameter, copies once
    keys = sampled(rows.select("page_id", "hash", "doc_id"), sample, "page_id", "hash").distinct().collect()
    picked = F.broadcast(spark.createDataFrame(keys, rows.drop("html").schema))
    chosen = rows.join(picked, rows.columns[:3], "left_semi").groupBy(*rows.columns[:3]).agg(F.min("html").alias("html")).collect()
    chosen = sorted(chosen, key=lambda r: (r["page_id"], r["hash"]))
    ids = spark.createDataFrame([(i,) for i in sorted({r["doc_id"] for r in chosen})], "doc_id long")
    texts = docs.select("doc_id", "text").dropna().join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    known_texts = {r["doc_id"]: r["text"] for r in texts.collect()} if chosen else {}
    return train([(r["html"], known_texts[r["doc_id"]]) for r in chosen if r["doc_id"] in known_texts])


def extract(pages: DataFrame, model: Boosted, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The main text of every page: columns ``keep``, text and n_chars (its code points), one row per row of ``pages``.

    Blocks are joined by one space in page order. A null, empty or furniture-only page has the empty text. Broken
    markup is mended as browsers do: missing ends are added, an unfinished tag at the end is dropped. Null and repeated
    ids and copies are rows like all others; other columns are ignored. Nothing is shuffled.
    """
    spark = prepare(pages.sparkSession)
    rows = pages.select(*(named(c).alias(f"k{i}") for i, c in enumerate(keep)), F.coalesce(named(html_col).cast("string"), F.lit("")).alias("html"))
    shared = spark.sparkContext.broadcast(model)  # 41 small trees
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(batch.column("html").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"])

    types = dict(rows.dtypes)
    out = rows.mapInArrow(run, ", ".join([*(f"{n} {types[n]}" for n in names), "text string"]))
    return out.select(*(F.col(n).alias(k) for n, k in zip(names, keep)), "text", F.length("text").cast("long").alias("n_chars"))
