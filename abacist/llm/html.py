"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html as entities
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.llm.common import spare

# Names of HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody "
    "td template textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not markup.
LITERAL = frozenset("script style textarea title xmp noembed noframes iframe".split())
SILENT = frozenset("script style title head template noscript iframe noembed noframes svg math object canvas audio video textarea select option optgroup button datalist".split())
#: A start tag ends an open element of these names, up to the given border.
CLOSES = {
    "p": ({"p"}, {"button", "td", "th", "caption", "html"}),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
ENDS_P = BLOCKS - {"br", "body", "html", "head", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "title"}
# Words in class, id and role that tell what an element is for.
APART = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion aside comment comments commentlist disqus reply replies "
    "respond related recommended recommendations trending newsletter subscribe signup cookie cookies consent gdpr nav navigation navbar menu "
    "breadcrumb breadcrumbs footer contentinfo complementary share sharing social pagination pager outbrain taboola".split()
)
AROUND = frozenset(
    "sidebar header masthead banner notice notices alert popup modal overlay login search toolbar widget widgets popular skip copyright legal "
    "disclaimer tagcloud topbar bottombar dialog form".split()
)
INSIDE = frozenset("article articlebody main content post entry story text body".split())
NOT = frozenset("has with no without hide".split())
APART_TAGS = frozenset("nav aside footer dialog menu".split())
AROUND_TAGS = frozenset("header form fieldset".split())
MAIN_TAGS = frozenset("article main".split())
#: Elements that their end tag ends even from inside a block that they hold, and the borders of that.
FORMATTING = frozenset("b big code em font i nobr s small strike strong tt u".split())
SCOPE = frozenset("caption html td th table template object".split())

#: Costs, in one unit: what a block pays for the label that its signs speak against.
APART_COST, AROUND_COST, MAIN_COST, INSIDE_COST = 8.0, 6.0, 6.0, 1.5
OUTSIDE_COST = 4.0
LONG_COST, SENTENCE_COST, HEADING_COST, LINK_COST, SHORT_COST = 1.5, 0.5, 1.0, 3.0, 0.25
#: Smoothness: neighbours in the page, more if they share a parent, and blocks of one container.
NEXT_EDGE, SIBLING_EDGE, CONTAINER_EDGE = 0.3, 0.7, 0.5

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<!--|<[!?][^>]*>|</[^a-zA-Z][^>]*>|</?[a-zA-Z][^>]*\Z""")
_SIGNS = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ENDS = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in LITERAL}
_SPACE = re.compile(r"\s+")


class _Element:
    __slots__ = ("tag", "apart", "around", "main", "inside", "silent", "hides", "link", "number")

    def __init__(self, tag, up, attributes, number):
        self.tag, self.number, self.hides = tag, number, tag in SILENT
        self.apart, self.around, self.main, self.inside = up.apart, up.around, up.main, up.inside
        self.link = up.link or tag == "a"
        apart, around, inside = tag in APART_TAGS, tag in AROUND_TAGS, False
        main = tag in MAIN_TAGS
        if tag == "header" and up.main:
            around = False
        if attributes and "=" in attributes or "hidden" in attributes:
            for name, a, b, c in _SIGNS.findall(attributes):
                name, value = name.lower(), (a or b or c).lower()
                if name == "style":
                    self.hides = self.hides or bool(_HIDDEN.search(value))
                elif name in ("hidden", "aria-hidden"):
                    self.hides = self.hides or (value != "false" and (name == "hidden" or value == "true"))
                elif tag not in ("html", "body"):
                    parts = _PARTS.findall(value)
                    real = {p for k, p in enumerate(parts) if not k or parts[k - 1] not in NOT}
                    apart = apart or bool(real & APART)
                    inside = inside or bool(real & INSIDE)
                    around = around or (bool(real & AROUND) and not main and not (up.main and "header" in real and not real & (AROUND - {"header"})))
                    main = main or (name == "role" and "main" in real) or "articlebody" in real
        self.silent = up.silent or self.hides
        if main and not apart:
            # The article inside a wrapper is not what the wrapper's name says.
            self.main, self.around = True, False
        self.apart = self.apart or apart
        self.around = self.around or (around and not main)
        self.inside = self.inside or inside


class _Root:
    tag, apart, around, main, inside, silent, link, number = "", False, False, False, False, False, False, 0


def blocks(page: str):
    """Text blocks in page order: (text, letters in links, element, heading)."""
    stack, out, buffer, linked = [_Root()], [], [], 0
    number, at, n = 0, 0, len(page)

    def end():
        nonlocal linked
        if buffer:
            text = _SPACE.sub(" ", "".join(buffer)).strip(" ")
            if text:
                top = next(e for e in reversed(stack) if e.tag in BLOCKS or not e.tag)
                out.append((text, linked, top, top.tag[:1] == "h" and top.tag[1:].isdigit()))
            buffer.clear()
            linked = 0

    def say(text):
        nonlocal linked
        top = stack[-1]
        if text and not top.silent:
            text = entities.unescape(text)
            buffer.append(text)
            if top.link:
                linked += len(text)

    def close(names, border):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                end()
                del stack[k:]
                return
            if stack[k].tag in border:
                return

    def end_inline(tag):
        """Ends the innermost open element of that name; only formatting ends from inside a block."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                if any(e.tag in BLOCKS for e in stack[k + 1 :]):
                    del stack[k]
                    for up, e in zip(stack[k - 1 :], stack[k:]):
                        e.silent = up.silent or e.hides
                else:
                    del stack[k:]
                return
            if stack[k].tag in (SCOPE if tag in FORMATTING else BLOCKS) or stack[k].tag in SILENT:
                return

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0] == "<!--":
                stop = page.find("-->", at)
                at = n if stop < 0 else stop + 3
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if tag == "p" and not any(e.tag == "p" for e in stack):
                end()
            elif tag in BLOCKS or tag in SILENT or tag == "a":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        if tag in BLOCKS:
                            end()
                        del stack[k:]
                        break
            else:
                end_inline(tag)
            continue
        if tag in BLOCKS:
            end()
        if tag in ENDS_P:
            close(*CLOSES["p"])
        if tag in CLOSES and tag != "p":
            close(*CLOSES[tag])
        attributes = m[3] or m[6] or ""
        if tag in LITERAL:
            stop = _ENDS[tag].search(page, at)
            at = n if stop is None else stop.end()
        elif tag not in VOID and (tag in BLOCKS or tag in SILENT or tag == "a" or "hidden" in attributes or "none" in attributes) and not (attributes.endswith("/") and tag in SILENT):
            if tag == "a":  # links do not nest
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "a":
                        del stack[k]
                        break
                    if stack[k].tag in BLOCKS:
                        break
            number += 1
            stack.append(_Element(tag, stack[-1], attributes, number))
        elif tag not in VOID and tag not in SILENT and any(e.tag == tag for e in stack):  # so that its end tag does not end the outer one
            number += 1
            stack.append(_Element(tag, stack[-1], "", number))
    end()
    return out


def costs(found) -> list[float]:
    """For every block how much speaks for content (above 0) or for boilerplate (below)."""
    has_main = any(e.main and not e.apart for _, _, e, _ in found)
    out = []
    for text, linked, e, heading in found:
        words = text.count(" ") + 1
        score = (LONG_COST if words >= 12 else -SHORT_COST if words < 4 else 0.25) + (SENTENCE_COST if text[-1] in ".!?。！？…\"”»" else 0)
        score += HEADING_COST * heading
        if 2 * linked > len(text):
            score -= LINK_COST
        if e.apart:
            score = -APART_COST
        elif e.around:
            score -= AROUND_COST
        elif e.main:
            score = MAIN_COST + max(score, -LINK_COST)
        else:
            score += INSIDE_COST * e.inside - OUTSIDE_COST * has_main
        out.append(score)
    return out


def cut(found, scores) -> list[bool]:
    """Which blocks are on the content side of a minimum cut."""
    n = len(found)
    head: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []

    def edge(a, b, c):
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((c, c))

    groups: dict[int, int] = {}
    for k in range(n):
        if k:
            edge(k - 1, k, NEXT_EDGE + (SIBLING_EDGE if found[k][2] is found[k - 1][2] else 0))
        # A node for each container joins its blocks, however far apart they stand.
        place = found[k][2].number
        if place in groups:
            edge(groups[place], k, CONTAINER_EDGE)
        else:
            groups[place] = len(head)
            head.append([])
            edge(groups[place], k, CONTAINER_EDGE)
    total = len(head)
    supply = [max(s, 0.0) for s in scores] + [0.0] * (total - n)
    demand = [max(-s, 0.0) for s in scores] + [0.0] * (total - n)
    while True:  # shortest paths from blocks with supply left to blocks with demand left
        level = [-1] * total
        queue = deque(k for k in range(n) if supply[k] > 1e-9)
        for k in queue:
            level[k] = 0
        hit = False
        while queue:
            a = queue.popleft()
            hit = hit or demand[a] > 1e-9
            for x in head[a]:
                if room[x] > 1e-9 and level[to[x]] < 0:
                    level[to[x]] = level[a] + 1
                    queue.append(to[x])
        if not hit:
            return [level[k] >= 0 for k in range(n)]
        left = [0] * total
        for s in range(n):
            while supply[s] > 1e-9:
                path, a = [], s
                while demand[a] <= 1e-9:
                    edges = head[a]
                    while left[a] < len(edges):
                        x = edges[left[a]]
                        if room[x] > 1e-9 and level[to[x]] == level[a] + 1:
                            break
                        left[a] += 1
                    if left[a] < len(edges):
                        path.append(edges[left[a]])
                        a = to[path[-1]]
                    elif path:
                        a = to[path.pop() ^ 1]
                        left[a] += 1
                    else:
                        break
                if demand[a] <= 1e-9:
                    break
                flow = min([supply[s], demand[a], *[room[x] for x in path]])
                supply[s] -= flow
                demand[a] -= flow
                for x in path:
                    room[x] -= flow
                    room[x ^ 1] += flow


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return " ".join(b[0] for b, keep in zip(found, cut(found, costs(found))) if keep)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """`pages` with the main text of the whole html and its code points (`n_chars`) added, or replaced.

    The page falls into blocks of text at block elements.  Signs of a block
    (its containers' names and roles, links, length, headings) are the costs of
    the two labels; blocks that follow each other or share a container pay for
    different labels.  The minimum cut of that graph gives the labels.

    Null or empty html and pages without content give an empty text.  A page
    that is not closed properly is read as browsers do: open comments, scripts
    and styles run to the end.
    """
    kept = [c for c in pages.columns if c.lower() not in (out.lower(), "n_chars")]
    schema = pages.select(*[f"`{c}`" for c in kept]).schema.add(out, "string").add("n_chars", "long")
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html_col}`").alias(spare(pages, "_html_")))

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                texts = [main_text(x.as_py()) for x in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, out, "n_chars"])

    return rows.mapInArrow(run, schema)
