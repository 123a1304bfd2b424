"""Operator 7: main text of web pages by composite text density.

Each page becomes a small DOM.  Elements that are never article text (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments; by tag, role or class words) carry no text.  Class words alone don't
exclude a node that holds the longest main or article element, or most of the
characters outside links of the page or of that element; nor one whose class
has other words too ("ad-hoc", "share-price"), unless it is mostly links or,
outside of articles, a block of low density.  Every other node has

    density = C / T * log_b((C / LC) * (T / LT)),
    b = ln(C / (C - LC) * LC + LCbody / Cbody * C + e)

with C characters, T tags, LC and LT those of links.  The densest node sets
the threshold: the least density on the path from body to it.  Of the nodes
at or above the threshold the one with the largest sum of child densities is
selected, and from there the article (else main element) around it, if any.

The work is per page, so Spark deals pages out as its readers split them and
no exchange is needed.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import utf8

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table
    tbody td tfoot th thead tr ul""".split()
)
RAW = "script|style|textarea|title|iframe|noembed|noframes|xmp"
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
#: An opening tag of the key closes the nearest open one of the set, unless a wall stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements without article text.
DROP_TAG = frozenset(
    """head nav footer aside form script style noscript template button select option input textarea iframe object
    embed svg canvas audio video map dialog menu datalist title link meta noembed noframes""".split()
)
DROP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
DROP_WORD = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion promoted
    nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager toc masthead topbar toolbar
    footer sidebar aside rail widget widgets related recommended recommendations share sharing social sharebar
    cookie cookies consent gdpr notice notices alert popup modal overlay lightbox paywall subscribe subscription
    newsletter signup login search comment comments commentlist respond replies reply disqus discussion skip""".split()
)
HEADER_WORD = frozenset("header siteheader pageheader".split())
LAYOUT_WORD = frozenset("has no with without".split())
#: Words that say nothing of the content beside a word of the sets above.
NEUTRAL_WORD = frozenset(
    """a an and the of for on in to by my our site page web main top bottom left right center middle upper lower first last
    primary secondary global local mobile desktop wrap wrapper wrapped container box block section area region zone panel
    pane bar row col column grid list item items link links button buttons btn icon icons inner outer content body text
    unit slot space place holder placeholder position fixed sticky static floating small medium large big xs sm md lg xl
    js id div ui module component group set title heading label message msg form field input hidden visible open closed
    post posts article articles user reader more read latest popular top hot news story stories blog policy accept info
    google dfp gpt amp leaderboard skyscraper rectangle square horizontal vertical header head foot bottom end start
    level depth current active disabled dropdown toggle trigger tab tabs to up us all new count number thread form""".split()
)

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:{RAW})\b[^>]*>.*?(?:</(?:{RAW})\s*>|\Z)|<[!?][^>]*>|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: What class words say of a node: nothing, that it isn't article text, or that with other words beside.
NO_DOUBT, NAMED, MIXED = 0, 1, 2
#: Elements within text, of which other words beside are believed.
TEXT_TAG = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th span b i em strong a code mark q cite small sub sup u figure figcaption".split())


class Node:
    __slots__ = ("tag", "parent", "dropped", "link", "role_main", "chars", "tags", "link_chars", "link_tags", "density", "total", "begin", "end", "children", "doubt", "in_article", "own")

    def __init__(self, tag: str, parent: Node | None, begin: int) -> None:
        self.tag, self.parent, self.begin, self.end = tag, parent, begin, begin
        self.dropped = self.link = self.role_main = self.in_article = False
        self.doubt = NO_DOUBT
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.children: list[Node] = []


def doubt(value: str, in_article: bool) -> int:
    """What the names of a class or id attribute say."""
    out = NO_DOUBT
    unwanted = DROP_WORD if in_article else DROP_WORD | HEADER_WORD
    if {w.lower() for w in WORDS.findall(value)} & LAYOUT_WORD:
        # "has-sidebar" and the like name the layout around the article
        return out
    for name in value.split():
        words = {w.lower() for w in WORDS.findall(name)}
        if words & unwanted:
            if words <= unwanted | NEUTRAL_WORD:
                return NAMED
            out = MIXED
    return out


def dropped(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, int]:
    """(never article text, is the main element, doubt by class words) of an element."""
    drop, main, doubts = tag in DROP_TAG or (tag == "header" and not in_article), tag == "main", [NO_DOUBT]
    if drop or not attributes.strip():
        return drop, main, NO_DOUBT
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape("".join(values))
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            doubts.append(doubt(value, in_article))
        elif name == "role":
            drop, main = drop or value.strip().lower() in DROP_ROLE, main or value.strip().lower() == "main"
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            drop = True
        elif name == "style":
            drop = drop or bool(HIDDEN.search(value))
    return drop, main, NAMED if NAMED in doubts else max(doubts)


SHORT_STACK = 64


def parse(html: str) -> tuple[Node, list[tuple[str, bool]]]:
    """(root, pieces): pieces are (text, False) and block borders ("", True) in
    page order; a node owns the pieces from begin to end."""
    root = Node("#root", None, 0)
    pieces: list[tuple[str, bool]] = []
    stack = [root]
    articles = drops = 0
    opened: dict[str, int] = defaultdict(int)    # elements of a tag that are open: tags that close none cost no search

    def close(to: int) -> None:
        nonlocal articles, drops
        while len(stack) > to:
            node = stack.pop()
            opened[node.tag] -= 1
            if node.tag in BLOCK:
                pieces.append(("", True))
            node.end = len(pieces)
            articles -= node.tag in ("article", "main")
            drops -= node.dropped

    def text(raw: str) -> None:
        if not raw or drops:
            return
        said = unescape(raw) if "&" in raw else raw
        pieces.append((said, False))
        n = len("".join(said.split()))
        stack[-1].chars += n

    at = 0
    for m in TOKEN.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        ends, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if ends:
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in ENDS_P:
            closing, walls = {"p"}, BLOCK - {"p"}
        else:
            closing, walls = (), ()
        for closing, walls in [(closing, walls), IMPLIED.get(tag, ((), ()))]:
            # a short stack is searched faster than asked about
            if closing and (len(stack) < SHORT_STACK or any(opened[t] for t in closing)):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in closing:
                        close(k)
                        break
                    if stack[k].tag in walls:
                        break
        if tag == "body" and opened["head"]:
            close(next(k for k, n in enumerate(stack) if n.tag == "head"))
        if tag in BLOCK:
            pieces.append(("", True))
        node = Node(tag, stack[-1], len(pieces))
        node.dropped, node.role_main, node.doubt = dropped(tag, attributes, articles > 0)
        node.in_article = articles > 0
        node.link = tag == "a"
        if tag in VOID:
            if tag == "br":
                pieces.append((" ", False))
            if not drops:
                stack[-1].tags += 1
            continue
        if not drops and not node.dropped:
            stack[-1].children.append(node)
        articles += tag in ("article", "main")
        drops += node.dropped
        opened[tag] += 1
        stack.append(node)
    text(html[at:])
    close(0)
    return root, pieces


def _sum_up(root: Node) -> list[Node]:
    """All nodes, parents first, with characters and tags of their subtrees."""
    order = [root]
    for node in order:
        order.extend(node.children)
    for node in order:
        node.own = (node.chars, node.tags)
    for node in reversed(order):
        for c in node.children:
            node.chars += c.chars
            node.tags += c.tags + 1
            node.link_chars += c.link_chars
            node.link_tags += c.link_tags + c.link
        if node.link:
            node.link_chars = node.chars
    return order


def prune(root: Node) -> list[Node]:
    """Take out the nodes that their class words exclude, and return them."""
    order = _sum_up(root)
    out: list[Node] = []
    if any(n.doubt for n in order):
        body = next((n for n in order if n.tag == "body"), root)
        plain = lambda n: n.chars - n.link_chars
        leads = [n for n in order if n.tag == "main" or n.role_main] or [n for n in order if n.tag == "article"]
        lead = max(leads, key=lambda n: n.chars, default=None)
        above, n = set(), lead
        while n is not None:
            above.add(n)
            n = n.parent
        inside = {lead or body}
        for n in order:
            if n.parent in inside:
                inside.add(n)
        most, low = plain(lead or body), density(body, body)

        def excluded(n: Node) -> bool:
            if n in above or (n in inside and 2 * plain(n) > most):
                return False
            if n.doubt == NAMED:
                return True
            return 2 * n.link_chars > n.chars or not (n.in_article or n.tag in TEXT_TAG or density(n, body) >= low)

        for n in order:
            if n.doubt and excluded(n):
                n.dropped = True
                out.append(n)
    for n in order:
        n.children = [c for c in n.children if not c.dropped]
        n.chars, n.tags = n.own
        n.link_chars = n.link_tags = 0
    return out


def density(node: Node, body: Node) -> float:
    c, t = node.chars, max(1, node.tags)
    if not c:
        return 0.0
    links, link_tags = max(1, node.link_chars), max(1, node.link_tags)
    b = math.log(c / max(1, c - node.link_chars) * node.link_chars + body.link_chars / max(1, body.chars) * c + math.e)
    adjusted = math.log(c / links * t / link_tags) if c * t > links * link_tags else 0.0
    return c / t * adjusted / max(math.log(b), 1e-3) if b > 1 + 1e-9 else c / t * adjusted


def select(root: Node) -> Node:
    """The subtree that holds the main text."""
    order = _sum_up(root)
    body = next((n for n in order if n.tag == "body"), root)
    inside, keep = {body}, [body]
    for n in order:
        if n.parent in inside:
            inside.add(n)
            keep.append(n)
    for n in keep:
        n.density = density(n, body)
    for n in keep:
        n.total = sum(c.density for c in n.children)
    densest = max(keep, key=lambda n: n.density)
    threshold, n = densest.density, densest
    while n is not body:
        n = n.parent
        threshold = min(threshold, n.density)
    best = max((n for n in keep if n.density >= threshold), key=lambda n: n.total, default=body)
    best = best if best.total else densest
    around, n = None, best
    while n is not None and n is not root:
        if n.tag == "article" or (around is None and (n.tag == "main" or n.role_main)):
            around = n
        n = n.parent
    return around or best


def main_text(html: str) -> str:
    """Blocks of the main text, one a line; "" if there are none."""
    root, pieces = parse(html)
    out = prune(root)
    node = select(root)
    for n in out:
        if node.begin <= n.begin:
            pieces[n.begin : n.end] = [("", True) if n.tag in BLOCK else ("", False)] * (n.end - n.begin)
    blocks, line = [], []
    for said, border in pieces[node.begin : node.end]:
        if not border:
            line.append(said)
        elif line:
            blocks.append(" ".join("".join(line).split()))
            line = []
    blocks.append(" ".join("".join(line).split()))
    return "\n".join(b for b in blocks if b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = utf8(batch.column(2))
        for a in range(0, batch.num_rows, 256):
            b = min(a + 256, batch.num_rows)
            texts = [main_text(data[offs[i] : offs[i + 1]].tobytes().decode()) for i in range(a, b)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))],
                ["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row.

    NULL, empty or text-free html gives an empty text.  Unclosed, misnested
    and cut-off markup is read as far as it goes.  Rows are independent:
    repeats are repeated, an empty table is empty, extra columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extract, f"page_id {kind}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long")
