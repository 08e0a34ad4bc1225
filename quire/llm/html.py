"""Main text of web pages by tree scoring (operator 5).

The page is read into a tree of elements (missing end tags are implied as
browsers do for paragraphs, list items, rows and cells). Subtrees that are never
article text by their tag, role or class (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) are left out; a class
or id word alone leaves no element out that holds the article. Every
block of running text earns points: one for itself, one for each comma, up to
three for its length; it passes them to its ancestors, halved at each step
after the parent. A container's points are discounted by its link density (the
share of its text inside links). From the container with most points one climbs
to the whole it is part of: the nearest article or main; where there is none,
the highest element below the body, on a way up of few links, that has headings
or sections beside it. Siblings of that are kept too when their own points reach
a fifth of its points or, if it is not an article or main, they are unlinked
paragraphs, headings or sections. Paragraphs and headings that stand beside an
article inside its main are parts of it; a heading is so only where what follows
it is kept. All blocks of what is kept are returned in page order.

Inside an article, and on paragraphs and headings, a class word speaks against an
element only as a whole class (``related``, ``sidebar``) or in one made of such
words and words of layout (``related-posts``), not in ``related-work``.

White space inside a block becomes one space; blocks are joined by one \\n.
The walk is iterative, so depth of nesting is no limit; memory is one page.

Defined results: null or empty html, and pages without running text, give an
empty text; broken markup is read as far as it goes; repeated rows get equal
texts; other columns pass through unchanged.
"""

from __future__ import annotations

import heapq
import html as _html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import free_name

TOKEN = re.compile(r"""<!--(?:.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?][^>]*>?|</[^>]*>?""",
                   re.S)
#: Name and value of each attribute; a value without its end quote reaches to the end.
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?""")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td "
                   "tfoot th thead tr ul caption").split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
          "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
DROP_TAGS = frozenset(("head script style noscript template nav footer aside form button select option textarea input iframe "
                       "object embed svg math canvas audio video dialog menu title xmp noembed noframes").split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
DROP_WORDS = frozenset(("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner "
                        "cookie cookies consent notice notices popup modal overlay newsletter subscribe signup login "
                        "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side widget widgets "
                        "comment comments commentlist disqus reply replies respond "
                        "share sharing social related recommended footer masthead pagination pager").split())
#: Those of them that name what readers add and other articles.
READER_WORDS = frozenset("comment comments commentlist disqus reply replies respond related recommended".split())
#: Words that say where or in what form something stands, not what it is.
LAYOUT_WORDS = frozenset(("area bar block body bottom box btn button buttons card cards col column container content form "
                          "group icons inner item items left link links list main outer page panel post posts article articles "
                          "primary right row secondary section site slot story stories thread title top unit wrap wrapper").split())
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
#: Points that an element which marks the article by its name starts with.
ARTICLE_POINTS = 25.0
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an article is made of, and the share of linked text that makes them lists of links.
PARTS = HEADINGS | {"section", "hgroup"}
LINES = HEADINGS | {"p", "hgroup"}
LINKED = 0.25


class _Node:
    __slots__ = ("tag", "parent", "items", "drop", "word", "points", "chars", "linked", "order")

    def __init__(self, tag, parent, drop, order, word=0):
        self.tag, self.parent, self.items, self.drop, self.order, self.word = tag, parent, [], drop, order, word
        self.points, self.chars, self.linked = 0.0, 0, 0


def _unwanted(tag: str, attributes: str, in_article: bool) -> tuple[bool, int]:
    """Whether the element is never article text, and whether its class or id has
    a word that speaks against it: 1, or 2 for a word of ``READER_WORDS``."""
    if tag in DROP_TAGS or (tag == "header" and not in_article):
        return True, 0
    if "=" not in attributes and "hidden" not in attributes.lower() or tag in ("html", "body", "article", "main"):
        return False, 0
    word, seen, strict = 0, set(), in_article or tag in LINES
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in seen:          # the first of equal names counts
            continue
        seen.add(name)
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            return True, 0
        if name == "role" and value.strip().lower() in DROP_ROLES:
            return True, 0
        if name in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in SPLIT.split(one) if w]
                if strict and any(w not in DROP_WORDS and w not in LAYOUT_WORDS for w in words):
                    continue
                for w in words:
                    if w in DROP_WORDS:
                        word = max(word, 2 if w in READER_WORDS else 1)
    return False, word


def _judge_words(nodes: list[_Node]) -> None:
    """Drop the elements that have a word against them, unless they hold the
    article: a main; an article, itself in none, with no less unlinked text than
    the articles already kept; or most of the page's unlinked text, in an article
    or main or where none is kept with text. What has a reader word holds the
    article only where no article or main is kept with text. Elements are judged
    from the outside, those with more text first."""
    if not any(x.word and not x.drop for x in nodes):
        return
    n = len(nodes)
    text, linked, heading, marked, inside, holds = [0] * n, [False] * n, [False] * n, [False] * n, [False] * n, [0] * n
    zone, clean, below = [0] * n, {0: 0}, {}      # zone: the nearest element with a word; clean: text of its articles
    for x in nodes:
        if x.drop:
            continue
        i, p = x.order, x.parent.order if x.parent else 0
        linked[i], heading[i] = linked[p] or x.tag == "a", heading[p] or x.tag in HEADINGS
        marked[i], inside[i] = marked[p] or x.tag in ("article", "main"), inside[p] or x.tag == "article"
        zone[i] = zone[p]
        if x.word:
            zone[i] = i
            clean[i] = 0
            below.setdefault(zone[p], []).append(x)
        if not linked[i]:
            text[i] = sum(len(t.strip()) for t in x.items if isinstance(t, str))
            if marked[i] and not heading[i]:
                clean[zone[i]] += text[i]
    for x in reversed(nodes):
        if x.parent is not None and not x.drop:
            p = x.parent.order
            text[p] += text[x.order]
            holds[p] |= holds[x.order] | (2 if x.tag == "main" else 1 if x.tag == "article" else 0)
    kept = clean[0]
    waiting = [(x.word, -text[x.order], x.order) for x in below.get(0, ())]
    heapq.heapify(waiting)
    while waiting:
        word, _, i = heapq.heappop(waiting)
        most, p = 2 * text[i] > text[0], nodes[i].parent.order
        article = holds[i] & 1 and not inside[p]
        if word == 2:
            stays = not kept and (holds[i] or most)
        else:
            stays = holds[i] & 2 or (article and text[i] >= kept) or (most and (marked[p] or not kept))
        if stays:
            kept += clean[i]
            for x in below.get(i, ()):
                heapq.heappush(waiting, (x.word, -text[x.order], x.order))
        else:
            nodes[i].drop = True
    for x in nodes:
        x.drop = x.drop or (x.parent is not None and x.parent.drop)


def _tree(page: str) -> tuple[_Node, list[_Node]]:
    root = _Node("#root", None, False, 0)
    nodes, at, articles, depth = [root], root, 0, {}
    place, end = 0, len(page)
    while place < end:
        m = TOKEN.search(page, place)
        if m is None:
            at.items.append(page[place:])
            break
        if m.start() > place:
            at.items.append(page[place:m.start()])
        place = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if depth.get(tag):
                while True:
                    depth[at.tag] -= 1
                    articles -= at.tag == "article"
                    found, at = at.tag == tag, at.parent
                    if found:
                        break
            continue
        if tag in VOID:
            at.items.append(" ")
            continue
        closes, stop = CLOSES.get(tag, (None, None))
        if closes is None and tag in BLOCK and depth.get("p"):
            closes, stop = {"p"}, {"td", "th", "table", "button", "article", "section", "div", "body"}
        if closes:
            x, last = at, None
            while x is not root and x.tag not in stop:
                if x.tag in closes:
                    last = x
                x = x.parent
            if last is not None:
                while at is not last.parent:
                    depth[at.tag] -= 1
                    articles -= at.tag == "article"
                    at = at.parent
        drop, word = (True, 0) if at.drop else _unwanted(tag, m[3], articles > 0)
        node = _Node(tag, at, drop, len(nodes), word)
        at.items.append(node)
        nodes.append(node)
        if tag in RAW_END:
            stop_at = RAW_END[tag].search(page, place)
            place = stop_at.start() if stop_at else end
            close = page.find(">", place)
            place = close + 1 if stop_at and close >= 0 else end
            continue
        at = node
        depth[tag] = depth.get(tag, 0) + 1
        articles += tag == "article"
    _judge_words(nodes)
    return root, nodes


def _blocks(top: _Node) -> list[tuple[_Node, str, int]]:
    """(element, text, characters in links) of each block below ``top``, in page
    order: text between two starts or ends of block elements."""
    out, piece = [], []
    linked, holder = 0, top
    stack = [(top, iter(top.items), 0, top)]

    def flush():
        nonlocal piece, linked
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                out.append((holder, text, min(linked, len(text))))
        piece, linked = [], 0

    while stack:
        node, items, links, block = stack[-1]
        for x in items:
            if isinstance(x, str):
                x = _html.unescape(x) if "&" in x else x
                holder = block
                piece.append(x)
                if links:
                    linked += len(x.strip())
            elif not x.drop:
                is_block = x.tag in BLOCK
                if is_block:
                    flush()
                stack.append((x, iter(x.items), links + (x.tag == "a"), x if is_block else block))
                break
        else:
            stack.pop()
            if node.tag in BLOCK or node is top:
                flush()
    return out


def _whole(best: _Node) -> _Node:
    """The element whose part the best container is: the nearest article or main,
    else the highest one below the body that has headings or sections beside it."""
    x = best
    while x is not None:
        if x.tag in ("article", "main"):
            return x
        x = x.parent
    top, x = best, best
    while x.parent is not None and x.parent.tag not in ("body", "html", "#root"):
        below, x = x, x.parent
        if x.linked >= LINKED * x.chars:
            break
        if any(isinstance(y, _Node) and y is not below and not y.drop and y.chars and y.tag in PARTS for y in x.items):
            top = x
    return top


def _beside(top: _Node) -> set[int]:
    """Numbers of the paragraphs and headings beside an article, or beside what
    holds it, inside its main: unlinked ones, headings only where the next thing
    with text or dropped, other than headings, is kept."""
    main, found = top, set()
    while main is not None and main.tag != "main":
        main = main.parent
    x = top
    while main is not None and x is not main:
        follows = False
        for y in reversed(x.parent.items):
            if not isinstance(y, _Node):
                follows = follows and not y.strip()
            elif y is x:
                follows = True
            elif y.drop or (y.chars and y.tag not in LINES):
                follows = False
            elif y.chars:
                stays = y.linked < LINKED * y.chars and (y.tag == "p" or follows)
                follows = stays if y.tag == "p" else follows
                if stays:
                    found.add(y.order)
        x = x.parent
    return found


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root, nodes = _tree(page)
    blocks = _blocks(root)
    if not blocks:
        return ""
    for node, text, linked in blocks:
        n, x, share = len(text), node, 1.0
        points = (1.0 + text.count(",") + text.count("、") + min(3.0, n / 100)) * (1 - linked / n)
        # a container is what holds the paragraph; bare text inside one is its own
        x = node.parent if (node.tag in ("p", "pre", "li", "td", "blockquote") or node.tag in HEADINGS) and node.parent else node
        node.chars += n
        node.linked += linked
        while x is not None:
            x.points += points * share
            share /= 2
            x = x.parent
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.chars += x.chars
            x.parent.linked += x.linked
    best, most = root, -1.0
    for x in nodes:
        if x.chars and not x.drop and (x.tag in BLOCK or x is root):
            x.points = (x.points + (ARTICLE_POINTS if x.tag in ("article", "main") else 0.0)) * (1 - x.linked / x.chars)
            if x.points > most and x.tag != "p" and x.tag != "li" and x.tag not in HEADINGS:
                best, most = x, x.points
    top = _whole(best)
    keep = {top.order}
    if top.parent is not None:
        for x in top.parent.items:
            if isinstance(x, _Node) and not x.drop and x is not top and x.chars:
                part = (x.tag == "p" or x.tag in PARTS) and x.linked < LINKED * x.chars
                if x.points >= max(10.0, 0.2 * top.points) or (part and top.tag not in ("article", "main")):
                    keep.add(x.order)
    if top.tag == "article":
        keep |= _beside(top)
    kept = []
    for node, text, _ in blocks:
        x = node
        while x is not None and x.order not in keep:
            x = x.parent
        if x is not None:
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` with the main text and its length in code points."""
    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        return column.map(main_text, na_action=None)

    text = free_name(pages, text)
    out = pages.withColumn(text, texts(F.col(html)))
    return out.withColumn(free_name(out, n_chars), F.length(text).cast("long"))
