"""Main text of web pages by tree scoring.

A page becomes a tree; what is never content (scripts, menus, adverts, comments and so on, by tag, role or
class name) is left out. Forms and names that also mark whole layouts ("search", "sidebar", "notice") only make
a container doubtful: it is left out as well, unless it holds most of the page's text outside links and hardly
any is left without it. Each paragraph passes points for its length and its commas to its ancestors, discounted
by the share of text inside links; the container with most points, siblings that reach a share of them and
unlinked blocks between those are the article. Its blocks are returned in page order, but for unnamed menus: lists
and divisions, not in an article element, whose text is links.

Null and empty pages, and pages without text of their own, give an empty text; repeated rows give equal texts.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, text_or_empty

TAG = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>""", re.S
)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never content, by tag; a header counts as a page's own only outside an article.
DROPPED = frozenset("head nav footer aside button select option svg canvas object audio video dialog menu fieldset label input".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open paragraph ends where one of these begins.
ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("table ul ol dl div section article main body html td th li blockquote".split())
#: Parts of class names and ids that are never an article's own.
BAD_WORDS = frozenset(
    "ad ads advert advertisement adverts adbox sponsor sponsored cookie cookies consent gdpr nav navbar navigation menu breadcrumb breadcrumbs "
    "comment comments disqus reply replies respond pagination pager".split()
)
#: Parts that also name the layout of a whole page.
DOUBTFUL_WORDS = frozenset(
    "promo promotion banner notice alert popup modal overlay sidebar side rail footer header masthead share sharing social related recommended "
    "newsletter subscribe signup login search widget toolbar skip".split()
)
#: Beside these, a part says what a container lacks or surrounds, not what it is.
LAYOUT_WORDS = frozenset("no non without with has".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary menu menubar".split())
DOUBTFUL_ROLES = frozenset("search form dialog alert alertdialog".split())
GOOD_WORDS = frozenset("article content post entry story body main text blog".split())
ARTICLES = frozenset(("article", "main"))
SIBLING_SHARE = 0.2
#: Outside of article elements these are menus if that share of their characters stands in links.
LISTS, MENU_SHARE = frozenset(("div", "section", "ul", "ol", "table")), 0.8
#: A doubtful container is taken in if the text outside is less than this share of its own; less in an article.
OUTSIDE_SHARE, OUTSIDE_ARTICLE_SHARE = 0.25, 0.1


class Node:
    __slots__ = ("tag", "parent", "dropped", "article", "score", "chars", "linked", "weight", "gate")

    def __init__(self, tag, parent, dropped, article, weight, doubtful=False):
        self.tag, self.parent, self.dropped, self.article, self.weight = tag, parent, dropped, article, weight
        self.score = 0.0
        self.chars = self.linked = 0
        self.gate = Gate(parent.gate) if doubtful and not dropped else parent.gate if parent else Gate(None)


class Gate:
    """The nearest doubtful container (or the page): what it holds outside of further ones, and those."""

    __slots__ = ("parent", "inner", "own", "total", "article", "open")

    def __init__(self, parent):
        self.parent, self.inner, self.own, self.total, self.article, self.open = parent, [], 0, 0, False, parent is None
        if parent is not None:
            parent.inner.append(self)


def _bad_name(name: str) -> tuple[bool, bool]:
    """Whether one class or id is a name of boilerplate, or a doubtful one."""
    parts = set(re.split(r"[^a-z]+", name))
    if len(parts) > 1 and not parts.isdisjoint(LAYOUT_WORDS):
        return False, False
    return not parts.isdisjoint(BAD_WORDS), not parts.isdisjoint(DOUBTFUL_WORDS)


def _marks(attrs: str) -> tuple[bool, bool, float]:
    """Whether attributes mark boilerplate, whether they are doubtful, and the bonus of a name that promises content.

    A name that stands alone and promises content makes other names of the container doubtful only.
    """
    if not attrs or attrs.isspace():
        return False, False, 0.0
    bad, named, doubtful, weight, promised = False, False, False, 0.0, False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            for one in value.split():
                b, d = _bad_name(one)
                named, doubtful = named or b, doubtful or d
                promised |= one in GOOD_WORDS
            weight += 5.0 * (not GOOD_WORDS.isdisjoint(re.split(r"[^a-z]+", value)))
        elif name == "role":
            bad |= value in BAD_ROLES
            doubtful |= value in DOUBTFUL_ROLES
        elif name == "style":
            bad |= "display:none" in value.replace(" ", "")
        elif name in ("hidden", "aria-hidden"):
            bad |= value != "false"
    return bad or (named and not promised), doubtful or named, weight


def _parse(page: str) -> tuple[Node, list[tuple[Node, str, int]]]:
    """The root and the blocks in page order: (node that holds the block, text, characters inside links)."""
    root = Node("html", None, False, False, 0.0)
    node, blocks, text, links, linked, at = root, [], [], 0, 0, 0
    holder = root

    def flush():
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined and not holder.dropped:
                blocks.append((holder, joined, min(linked, len(joined))))
            text.clear()
        linked = 0

    def put(raw):
        nonlocal linked
        if raw and not holder.dropped:
            raw = html.unescape(raw)
            text.append(raw)
            if links:
                linked += len(raw.strip())

    stack: list[Node] = [root]

    def move(to):
        nonlocal node, holder
        flush()
        node = holder = to

    pos, end = 0, len(page)
    while True:
        m = TAG.search(page, pos)
        if m is None:
            put(page[pos:end])
            break
        put(page[pos : m.start()])
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS or tag in DROPPED:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        move(stack[-1])
                        break
                    if tag == "p" and stack[i].tag in FENCES:
                        break
            continue
        attrs = m[3] or ""
        if tag in RAW and not attrs.endswith("/"):
            close = re.compile(f"</{tag}[^>]*>", re.I).search(page, pos)
            pos = close.end() if close else end
            text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "hr":
            flush()
        elif tag == "a":
            links += 1
        elif tag in VOID:
            continue
        elif tag in BLOCKS or tag in DROPPED:
            if tag in ENDS_P and stack[-1].tag == "p":
                stack.pop()
            if tag in ALIKE:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ALIKE[tag]:
                        del stack[i:]
                        break
                    if stack[i].tag in FENCES:
                        break
            if tag == "body":
                stack = [s for s in stack if s.tag != "head"]
            parent = stack[-1]
            bad, doubtful, weight = _marks(attrs)
            if tag in ("html", "body", "article", "main"):
                bad = doubtful = False
            dropped = parent.dropped or bad or tag in DROPPED or (tag == "header" and not parent.article)
            inside = parent.article or tag in ARTICLES
            child = Node(tag, parent, dropped, inside, weight + (25.0 if tag in ARTICLES else 0.0), doubtful or tag == "form")
            stack.append(child)
            links = 0
            move(child)
    flush()
    return root, blocks


def _open_gates(root: Node, blocks: list[tuple[Node, str, int]]) -> None:
    """Take in doubtful containers that hold most of the text outside links, the largest first, then those inside."""
    gates = [root.gate]
    for gate in gates:
        gates.extend(gate.inner)
    for holder, text, linked in blocks:
        holder.gate.own += len(text) - linked
        holder.gate.article |= holder.article
    for gate in reversed(gates):
        gate.total = gate.own + sum(g.total for g in gate.inner)
    clean, article = root.gate.own, root.gate.article
    waiting = [(-g.total, i, g) for i, g in enumerate(root.gate.inner)]
    heapq.heapify(waiting)
    rest, made = sum(g.total for g in root.gate.inner), len(waiting)
    while waiting:
        gate = heapq.heappop(waiting)[2]
        share = OUTSIDE_ARTICLE_SHARE if article else OUTSIDE_SHARE
        if 2 * gate.total < clean + rest or clean >= share * gate.total:
            break
        gate.open, clean, rest, article = True, clean + gate.own, rest - gate.own, article or gate.article
        for g in gate.inner:
            heapq.heappush(waiting, (-g.total, made, g))
            made += 1


def main_text(page: str) -> str:
    """Blocks of the article joined by blank lines; empty if the page has no text of its own."""
    root, blocks = _parse(page)
    _open_gates(root, blocks)
    blocks = [b for b in blocks if b[0].gate.open]
    for holder, text, linked in blocks:
        points = (1.0 + text.count(",") + min(len(text) / 100.0, 3.0)) * (1.0 - linked / len(text))
        # A bare container holds its own text; a paragraph-like block gives its points to what is above.
        up, level = (holder if holder.tag in FENCES and holder.tag not in ("li", "td", "th", "blockquote") else holder.parent) or root, 0
        while up is not None:
            up.score += points / (1.0 if level == 0 else 2.0 if level == 1 else 3.0 * level)
            up.chars += len(text)
            up.linked += linked
            up, level = up.parent, level + 1
    scored: dict[int, Node] = {}
    for holder, _, _ in blocks:
        up = holder
        while up is not None and id(up) not in scored:
            scored[id(up)] = up
            up = up.parent

    def total(n: Node) -> float:
        return (n.score + (n.weight if n.chars else 0.0)) * (1.0 - n.linked / n.chars if n.chars else 0.0)

    best = max(scored.values(), key=total, default=None)
    if best is None:
        return ""
    least = SIBLING_SHARE * total(best)
    kept = {id(best)}
    if best.parent is not None and best.tag not in ("body", "html"):
        for n in scored.values():
            alike = n.tag == best.tag or best.tag not in ARTICLES
            if n.parent is best.parent and n is not best and alike and total(n) >= least:
                kept.add(id(n))

    def branch(n) -> Node | None:
        """The kept container above a block, else the part of the best one's parent that the block is in; none if in a menu."""
        while n is not None and id(n) not in kept and n.parent is not best.parent and n is not best.parent:
            if n.tag in LISTS and not n.article and n.chars and n.linked >= MENU_SHARE * n.chars:
                return None
            n = n.parent
        return n

    held = [(branch(holder), text, linked) for holder, text, linked in blocks]
    places = [i for i, (n, _, _) in enumerate(held) if n is not None and id(n) in kept]

    def between(n, text, linked) -> bool:
        if n is None or id(n) in kept:
            return n is not None
        chars, links = (len(text), linked) if n is best.parent else (n.chars, n.linked)
        return 2 * links < chars

    return "\n\n".join(text for n, text, linked in held[min(places, default=0) : max(places, default=-1) + 1] if between(n, text, linked))


def main_text_of(pages: DataFrame, page: str = "html") -> Column:
    """Column of the main text of raw pages; null and empty pages give an empty text, long ones are read whole."""
    small_batches(pages.sparkSession)

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text)

    texts.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(texts, "string")(text_or_empty(page))
