"""Main text of web pages by minimum-cut labelling.

A page's text falls into blocks between the starts and ends of block elements. A logistic classifier gives each block the
log odds of content: from its words, sentence ends and links, whether it is a heading, and bounded evidence of the
elements around it (semantic tags, class and id names, the page's article, the element that holds most of its prose).
Names that authors also give to parts of an article (discussion, thread, ad-free) count against content only where the text
under them isn't mostly prose; like neighbours that each hold a short line, then prose, are comments whatever their names.
Its costs are the capacities to the two terminals. Neighbouring blocks, and next blocks under the same parent, are joined
by smoothness edges, stronger the nearer they stand in the element tree and of the order of one paragraph's evidence.
The minimum cut of that graph is the cheapest labelling: it pulls a short line between paragraphs into the text, and a
sentence between links out of it. Blocks whose terminal outweighs all their edges are settled first, which no minimum cut
contradicts; the rest goes through augmenting paths (Dinic).

The scanner reads a page once, from left to right: a quote opens a value only after an equals sign, an end tag without an
open element is found by a count, and markup that never closes ends the page.

The whole html is read. Null or empty html, and pages without content blocks, give an empty text. Repeated rows, rows with
equal or null ids and null urls are pages of their own. Columns that aren't to be kept are not read.
An empty table gives no rows; a very long page is a slice of its own, read in time linear in its length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lakeaudit.llm.spark import by_slice, table

MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?/])")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)?(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea", "iframe", "noembed", "xmp")}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NO_TAGS = frozenset("nav aside footer form button menu dialog".split())
HIDDEN_TAGS = frozenset("head noscript template svg select object canvas audio video datalist".split())
LEAVES = frozenset("p pre blockquote li dt dd h1 h2 h3 h4 h5 h6".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Words of class and id names. A token with a strong one speaks against content; a weak one does if no good one is beside it.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist commentary consent cookie cookies discussion disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter outbrain pager pagination popup promo reply replies respond responses sidebar signup sponsor sponsored subscribe taboola thread toolbar topbar".split()
)
WEAK = frozenset("alert banner disclaimer feedback header notice notices related search share sharing skip social tagcloud tags widget widgets".split())
#: Strong words that authors use for parts of an article as well: they speak against content only where the text agrees.
DOUBTFUL = frozenset("ad ads adv discussion reply replies respond responses sponsor sponsored thread".split())
GOOD = frozenset("article body content entry main post story text".split())
#: Parts of names that say something of a whole page, as in has-sidebar, or take a word back, as in ad-free.
ABOUT = frozenset("has with no without is open enabled closed disabled free".split())
#: First words of headings that open a part after the article.
AFTER = frozenset("comment comments kommentare commentaires comentarios responses replies antworten related newsletter advertisement anzeige".split())
LEGAL = re.compile(r"©|\(c\) *[12][0-9]{3}|copyright|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados", re.I)

#: The classifier: log odds of content.
BIAS, BY_WORDS, MOST_WORDS, BY_STOPS, BY_LINKS, AS_HEADING, AS_TITLE = -1.0, 0.9, 4.0, 0.8, -4.0, 0.8, 2.0
IN_HIDDEN, IN_NO_TAG, STRONG_NAME, WEAK_NAME, GOOD_NAME, AFTER_CUE, IN_NESTED, LEGAL_LINE = -12.0, -8.0, -7.0, -2.5, 1.0, -2.5, -3.0, -2.5
IN_THREAD = -7.0
IN_ARTICLE, OUT_OF_ARTICLE, IN_CORE, OUT_OF_CORE = 1.5, -2.5, 1.0, -2.0
SMOOTH = 2.0  #: of an edge between siblings
CORE = 0.6  #: share of the prose that the core element holds


class Node:
    __slots__ = ("tag", "parent", "depth", "at", "first", "end", "hidden", "no", "header", "strong", "doubt", "weak", "good", "article")

    def __init__(self, tag: str, parent: Node | None, at: int, first: int, attributes: list[tuple[str, str]]):
        self.tag, self.parent, self.at, self.first, self.end = tag, parent, at, first, -1
        self.depth = parent.depth + 1 if parent else 0
        for flag in ("hidden", "no", "header", "strong", "doubt", "weak", "good"):
            setattr(self, flag, parent is not None and getattr(parent, flag))
        self.hidden |= tag in HIDDEN_TAGS
        self.no |= tag in NO_TAGS
        self.header |= tag == "header"
        self.article = tag in ("article", "main")
        for key, value in attributes:
            if key in ("class", "id", "role") and tag not in ("html", "body"):
                value = value[:1000]  # names, not text
                self.article |= key == "role" and value.lower() in ("main", "article")
                for token in value.split():
                    names = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()))
                    if not names & ABOUT:
                        self.strong |= bool(names & STRONG - DOUBTFUL)
                        self.doubt |= bool(names & DOUBTFUL)
                        self.weak |= bool(names & WEAK) and not names & GOOD
                        self.good |= bool(names & GOOD)
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s{0,9}:\s{0,9}none", value, re.I)):
                self.hidden = True


class Block:
    __slots__ = ("node", "text", "links", "words", "stops")

    def __init__(self, node: Node, text: str, links: float):
        self.node, self.text, self.links = node, text, links
        self.words, self.stops = text.count(" ") + 1, sum(map(text.count, ".!?。！？"))


def attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """The attributes from a place inside a tag, and the place after its end; that of the page, if it never ends."""
    found = []
    while at < len(page):
        m = ATTRIBUTE.match(page, at)
        at = m.end()
        if m[1]:
            found.append((m[1].lower(), m[2] or m[3] or m[4] or ""))
        if page.startswith(">", at):
            return found, at + 1
        if m.end() == m.start():
            at += 1
    return found, len(page)


def blocks(page: str) -> tuple[list[Node], list[Block]]:
    """The elements in the order of their starts (the page itself first) and the blocks of text."""
    out: list[Block] = []
    root = here = Node("", None, 0, 0, [])
    nodes, open_tags, raw = [root], Counter(), []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal raw, linked
        if raw and (text := " ".join(html.unescape("".join(raw)).split())):
            out.append(Block(here, text, min(1.0, linked / len(text))))
        raw, linked = [], 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            raw.append(piece)
            if in_link:
                linked += len(piece)

    def close() -> None:
        nonlocal here
        here.end = len(out)
        open_tags[here.tag] -= 1
        here = here.parent

    while m := MARKUP.search(page, at):
        add(page[at : m.start()])
        if not m[2]:
            if m[0] == "<!--":
                short = page.startswith((">", "->"), m.end())
                end = page.find(">", m.end()) + 1 if short else page.find("-->", m.end()) + 3
                at = len(page) if end < m.end() else end
            else:
                at = page.find(">", m.end()) + 1 or len(page)
            continue
        tag, own, at = m[2].lower(), [], m.end()
        if page.startswith(">", at):
            at += 1
        else:
            own, at = attributes(page, at)
        empty = page.startswith("/>", at - 2)
        if tag in INLINE:
            if tag == "a":
                in_link = not m[1]
            elif tag in ("br", "img"):
                raw.append(" ")
            continue
        flush()
        if m[1]:
            if open_tags[tag] > 0:
                while here.tag != tag:
                    close()
                close()
                in_link = False
            continue
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            at = page.find(">", at) + 1 or len(page)
            continue
        if here.tag == "p" and (tag in CLOSES_P or here.parent.tag in SIBLING.get(tag, ())):
            close()
        while here.tag in SIBLING.get(tag, ()):
            close()
        if tag not in VOID and not empty:
            here = Node(tag, here, len(nodes), len(out), own)
            nodes.append(here)
            open_tags[tag] += 1
    add(page[at:])
    flush()
    for n in nodes:
        n.end = len(out) if n.end < 0 else n.end
    return nodes, out


def heaviest(nodes: list[Node], prose: list[float]) -> tuple[Node, list[float]]:
    """The deepest element that holds CORE of all prose, and what each element holds."""
    mass = list(prose)
    for n in reversed(nodes[1:]):
        mass[n.parent.at] += mass[n.at]
    core = nodes[0]
    for n in nodes[1:]:  # a child comes after its parent, and one child at most holds so much
        if n.parent is core and n.tag not in LEAVES and mass[n.at] >= CORE * mass[0] > 0:
            core = n
    return core, mass


def after_cues(found: list[Block]) -> list[bool]:
    """Whether a block lies after a heading of AFTER, under the heading's parent."""
    out, end = [], 0
    for i, b in enumerate(found):
        if b.words <= 5 and b.node.tag in HEADING and b.node.parent and re.split(r"\W+", b.text.lower().lstrip("0123456789 "), maxsplit=1)[0] in AFTER:
            end = max(end, b.node.parent.end)
        out.append(i < end)
    return out


def is_prose(b: Block) -> bool:
    return b.links < 0.3 and b.words >= 8 and b.stops > 0


def settle_doubts(nodes: list[Node], found: list[Block]) -> None:
    """Doubtful names become strong where the text under them agrees: unless it is mostly prose, with few short lines (names, dates, links) between."""
    doubtful = {n.at for n in nodes if n.doubt}
    for n in nodes[1:]:
        if n.at in doubtful and n.parent.at not in doubtful:
            own = found[n.first : n.end]
            prose = [b for b in own if is_prose(b)]
            short = sum(not is_prose(b) and b.node.tag not in HEADING for b in own)
            agrees = 2 * short >= len(prose) or 5 * sum(b.words for b in prose) < 4 * sum(b.words for b in own)
            n.strong |= agrees
            n.weak |= not agrees
        elif n.at in doubtful:  # as the element that has the name
            n.strong |= n.parent.strong
            n.weak |= n.parent.weak


def in_threads(nodes: list[Node], found: list[Block]) -> list[bool]:
    """Whether a block lies in one of three or more like neighbours that each hold a short line, then prose: comments, whatever their names."""
    out = [0] * (len(found) + 1)
    like: dict[tuple[int, str], list[Node]] = {}
    for n in nodes[1:]:
        own = found[n.first : min(n.end, n.first + 8)]
        if n.tag in ("div", "li", "section", "article") and len(own) > 1 and own[0].words <= 4 and not own[0].stops and own[0].node.tag not in (*HEADING, "dt", "td", "th") and any(map(is_prose, own[1:3])):
            like.setdefault((n.parent.at, n.tag), []).append(n)
    for units in like.values():
        if len(units) >= 3:
            for n in units:
                out[n.first] += 1
                out[n.end] -= 1
    return [depth > 0 for depth in accumulate(out[:-1])]


def log_odds(nodes: list[Node], found: list[Block]) -> list[float]:
    """Of content against boilerplate for each block, by the classifier."""
    settle_doubts(nodes, found)
    threads = in_threads(nodes, found)
    plain, named = [0.0] * len(nodes), [0.0] * len(nodes)
    after = after_cues(found)
    for i, b in enumerate(found):
        if not (b.node.no or b.node.hidden) and b.links < 0.5:
            weight = b.words if b.words >= 8 or (b.stops and b.words >= 3) else b.words / 10
            named[b.node.at] += weight
            plain[b.node.at] += 0 if b.node.strong or after[i] else weight
    trust = 4 * sum(plain) >= sum(named)  # where names would leave little, they say nothing
    core, mass = heaviest(nodes, plain if trust else named)
    most = max((mass[n.at] for n in nodes if n.article), default=0)
    articles = [n for n in nodes if n.article and mass[n.at] >= CORE * most > 0]
    main = max(articles, key=lambda n: (n.depth, mass[n.at]), default=None)
    core_range = range(core.first, core.end) if core.parent and (main is None or (main.tag == "main" and main.first <= core.first < core.end <= main.end)) else None
    inside, nested = [0] * (len(found) + 1), [0] * (len(found) + 1)
    for n in nodes:
        if main and n.article and (n is main or (n.tag == "article" == main.tag and mass[n.at] >= 0.25 * mass[main.at] and (n.end <= main.first or n.first >= main.end))):
            inside[n.first] += 1
            inside[n.end] -= 1
    if main and main.tag == "article":
        for n in nodes:
            if n.tag == "article" and n is not main and main.first <= n.first and n.end <= main.end and n.depth > main.depth:
                nested[n.first] += 1
                nested[n.end] -= 1
    inside, nested = ([depth > 0 for depth in accumulate(x[:-1])] for x in (inside, nested))  # ranges may nest as deep as the page
    out = []
    for i, b in enumerate(found):
        n = b.node
        z = BIAS + BY_WORDS * min(MOST_WORDS, math.log(b.words)) + BY_STOPS * min(3, b.stops) + BY_LINKS * b.links
        z += AS_TITLE if n.tag == "h1" else AS_HEADING if n.tag in HEADING else 0
        in_core = core_range is None or i in core_range
        no = n.no or (n.header and not (inside[i] if main else core_range is not None and in_core))
        strong = n.strong and trust
        z += IN_HIDDEN * n.hidden + IN_NO_TAG * no
        z += STRONG_NAME if strong else WEAK_NAME if n.weak and not inside[i] else GOOD_NAME if n.good else 0
        if main:
            z += OUT_OF_ARTICLE if not inside[i] else IN_NESTED if nested[i] else 0 if no or strong else IN_ARTICLE
        if core_range is not None:
            z += OUT_OF_CORE if not in_core else 0 if no or strong else IN_CORE
        out.append(z + IN_THREAD * threads[i] + AFTER_CUE * after[i] + LEGAL_LINE * bool(b.words <= 40 and LEGAL.search(b.text)))
    return out


def distance(a: Node, b: Node, most: int = 8) -> int:
    """Steps between two elements in the tree, most at most."""
    steps = 0
    while a is not b and steps < most:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, SMOOTH * 2 ** (min(0, 2 - distance(found[i - 1].node, b.node)) / 2)))
        parent = b.node.parent.at if b.node.parent else -1
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, SMOOTH / 2))
        last[parent] = i
    return edges


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labels that minimise the sum of max(0, odds) where False, max(0, -odds) where True, and of cut edges."""
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    z, label = list(odds), [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(z[i]) >= sum(near[i].values()):
            label[i] = z[i] > 0
            for j, w in near[i].items():
                z[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, max_flow([z[i] for i in rest], rest, near), strict=True):
            label[i] = side
    return label


def max_flow(z: list[float], rest: list[int], near: list[dict[int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut (Dinic; source s, sink t)."""
    n = len(rest)
    s, t, at = n, n + 1, {i: k for k, i in enumerate(rest)}
    to, cap, arcs = [], [], [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: float, back: float) -> None:
        arcs[a].append(len(to))
        to.append(b)
        cap.append(forth)
        arcs[b].append(len(to))
        to.append(a)
        cap.append(back)

    for k, i in enumerate(rest):
        arc(s, k, max(z[k], 0.0), 0.0)
        arc(k, t, max(-z[k], 0.0), 0.0)
        for j, w in near[i].items():
            if at[j] > k:
                arc(k, at[j], w, w)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            a = queue.popleft()
            for e in arcs[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        nxt, path, a = [0] * (n + 2), [], s
        while True:
            if a == t:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[a] < len(arcs[a]) and not (cap[e := arcs[a][nxt[a]]] > 1e-9 and level[to[e]] == level[a] + 1):
                nxt[a] += 1
            if nxt[a] < len(arcs[a]):
                path.append(e)
                a = to[e]
            elif path:
                a = to[path.pop() ^ 1]
                nxt[a] += 1
            else:
                break


def main_text(page: str) -> tuple[str, int, int]:
    """The text, the number of the page's blocks, and of those that the cut labels otherwise than their own odds."""
    nodes, found = blocks(page)
    odds = log_odds(nodes, found)
    label = min_cut(odds, smoothness(found))
    # What a browser doesn't show is never text, whatever stands around it.
    kept = [b.text for b, content in zip(found, label, strict=True) if content and not b.node.hidden]
    return " ".join(kept), len(found), sum(content != (z > 0) for content, z in zip(label, odds, strict=True))


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns to keep, text, n_chars, n_blocks and n_moved (blocks whose label smoothness changed). One pass without a shuffle."""
    kinds = dict(pages.select(*keep).dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [main_text(x.as_py() or "") for x in batch.column(len(keep))]
        cols = [pa.array([x[0] for x in got], pa.string()), *(pa.array(c, pa.int64()) for c in ([len(x[0]) for x in got], [x[1] for x in got], [x[2] for x in got]))]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *cols], [*keep, "text", "n_chars", "n_blocks", "n_moved"])

    return pages.select(*keep, html_col).mapInArrow(by_slice(run, html_col), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string, n_chars long, n_blocks long, n_moved long"]))


def op3_html_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
