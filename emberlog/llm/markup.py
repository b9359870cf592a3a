"""Blocks of text in an HTML page, and the containers around them."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from html import unescape
from itertools import islice

TOKEN = re.compile(
    r"<!--(?:.*?-->|>|.*\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
QUALIFIED = re.compile(r"(?:has|with|without|no|is)[-_]", re.IGNORECASE)
QUALIFIED_INSIDE = re.compile(r"[-_](?:has|with|without|no)[-_].*", re.IGNORECASE)
DIGITS = re.compile(r"\d+")

# Element names of HTML by their role, and names that mark what is not
# the article.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    """
    a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr
    q rp rt ruby s samp small span strike strong sub sup time tt u var
    """.split()
)
DROPPED = frozenset(
    """
    head script style noscript template svg canvas iframe object audio video select
    textarea button title xmp noembed noframes datalist dialog
    """.split()
)
AROUND = frozenset("nav footer menu".split())
# Elements that are no part of the article unless they hold more than this share of the
# page's free text: some sites wrap every page in one.
WRAPPERS = {"form": 0.5, "aside": 0.9, "header": 0.9}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SAME_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
LIMITS = frozenset("ul ol dl table select".split())
OTHER_PARTS = frozenset(
    """
    ad ads advert adverts advertisement advertising adsense sponsor sponsored promo
    promotion banner cookie cookies consent gdpr notice notices newsletter subscribe
    signup share sharing social related recommended recommendations sidebar comment
    comments disqus respond replies menu navbar nav navigation breadcrumb breadcrumbs
    footer popup modal overlay pagination pager toolbar widget masthead paywall
    """.split()
)
OTHER_ROLES = frozenset(
    "navigation banner complementary contentinfo search dialog alert alertdialog form".split()
)
KEPT_TAGS = frozenset("html body main article".split())
# How far a name marks what is no article: by a part between others, by its first or last
# part, or in whole. An element marked by a part is left out unless it holds more than
# this share of the page's free text, one marked in whole unless no text is left.
INNER, OUTER, WHOLE = 1, 2, 3
LEAST_KEPT = {INNER: 0.5, OUTER: 0.9}
ARTICLES = ("article", "main")
# Containers below this depth go by the path of the one at it, which keeps paths short;
# their text belongs to that path.
DEEPEST = 64


@dataclass
class Element:
    tag: str
    path: str
    parent: int
    depth: int
    in_article: bool
    # "" if its text counts, else why not: "hard", "around" or "header".
    left_out: str
    # INNER or OUTER if a part of a name marks it, else 0.
    mark: int = 0
    # Whether it is a wrapper outside of any article's header.
    wraps: bool = False


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    # (element, text, characters inside links) in page order.
    blocks: list[tuple[int, str, int]] = field(default_factory=list)
    # Whether any name marks what is no article.
    marked: bool = False

    def chain(self, element: int):
        while element >= 0:
            yield element
            element = self.elements[element].parent


def mark_of(name: str) -> int:
    if QUALIFIED.match(name):
        return 0
    parts = [p.lower() for p in NAME_PART.findall(QUALIFIED_INSIDE.sub("", name))]
    marks = [p in OTHER_PARTS for p in parts]
    if not any(marks):
        return 0
    return WHOLE if all(marks) else OUTER if marks[0] or marks[-1] else INNER


def named(attributes: str) -> tuple[str, int]:
    """The generalised classes of a tag, and how far they mark what is no article."""
    classes, other = [], 0
    for kind, value in ATTRIBUTE.findall(attributes):
        value, kind = value.strip("\"'"), kind.lower()
        if kind == "role":
            other = WHOLE if value.strip().lower() in OTHER_ROLES else other
            continue
        names = value.split()
        if kind == "class":
            classes += names
        for name in names:
            other = max(other, mark_of(name))
    general = sorted({DIGITS.sub("#", c.lower()) for c in classes})
    return "".join(f".{c}" for c in general), other


def without_minor(
    page: Page, most: Callable[[Element], float | None], resets: tuple[str, ...] = ()
) -> None:
    """Drops the blocks inside elements that hold no more than a share of the page's
    free text, given by ``most`` where the element is to be judged, unless none is left.
    What is inside an element of ``resets`` stays, whatever is around it."""
    judged = [most(e) for e in page.elements]
    if not any(share is not None for share in judged):
        return
    free = [0] * len(page.elements)
    total = 0
    for element, text, linked in page.blocks:
        own = max(0, len(text) - linked)
        total += own
        if element >= 0:
            free[element] += own
    for n in range(len(free) - 1, -1, -1):
        if page.elements[n].parent >= 0:
            free[page.elements[n].parent] += free[n]
    dropped: list[bool] = []
    for n, (e, share) in enumerate(zip(page.elements, judged)):
        own = share is not None and free[n] <= share * total
        dropped.append(own or e.parent >= 0 and dropped[e.parent] and e.tag not in resets)
    page.blocks = [b for b in page.blocks if b[0] < 0 or not dropped[b[0]]] or page.blocks


def parse(html: str) -> Page:
    """The page's elements and the blocks that count; if there are none because of names
    and roles, those that are there without regard to these."""
    page = parse_marked(html, False)
    without_minor(page, lambda e: WRAPPERS[e.tag] if e.wraps else None, ARTICLES)
    without_minor(page, lambda e: LEAST_KEPT.get(e.mark))
    return parse_marked(html, True) if page.marked and not page.blocks else page


def parse_marked(html: str, regardless: bool) -> Page:
    page, stack = Page(), []
    elements = page.elements
    # For each tag the places of its open elements in the stack, outermost first.
    open_at: defaultdict[str, list[int]] = defaultdict(list)
    pieces: list[str] = []
    linked, links, at, size = 0, 0, 0, len(html)

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(pieces)).split())
        if text and not (stack and elements[stack[-1]].left_out):
            page.blocks.append((stack[-1] if stack else -1, text, linked))
        pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if links:
            linked += len(text)

    def close(tags: tuple[str, ...], limits: frozenset = frozenset()) -> None:
        """Pops up to the nearest of ``tags``, if it is open inside ``limits``."""
        nearest = max((open_at[tag][-1] for tag in tags if open_at[tag]), default=-1)
        limit = max((open_at[tag][-1] for tag in limits if open_at[tag]), default=-1)
        if nearest < 0 or limit > nearest:
            return
        flush()
        for element in reversed(stack[nearest:]):
            open_at[elements[element].tag].pop()
        del stack[nearest:]

    def inherited(tag: str, other: int) -> str:
        above = elements[stack[-1]].left_out if stack else ""
        if tag in DROPPED or other == WHOLE and tag not in KEPT_TAGS:
            return "hard"
        if above == "hard":
            return "hard"
        if tag in ARTICLES and not other:
            return ""
        if tag in HEADINGS and above == "header":
            return ""
        if tag == "header" and not above and stack and elements[stack[-1]].in_article:
            return "header"
        return above or ("around" if tag in AROUND else "")

    while at < size:
        found = TOKEN.search(html, at)
        if not found:
            add(html[at:])
            break
        if found.start() > at:
            add(html[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag, closing, attributes = found[2].lower(), bool(found[1]), found[3]
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag == "a":
            links = 0 if closing else 1
        if closing:
            if tag not in INLINE:
                flush()
            close((tag,))
            continue
        classes, other = named(attributes) if attributes else ("", 0)
        if other:
            page.marked = True
            other = 0 if regardless else other
        if tag in INLINE and not other:
            continue
        if tag not in INLINE:
            flush()
            close(("p",), LIMITS | KEPT_TAGS)
            if tag in SAME_CLOSES:
                close(SAME_CLOSES[tag], LIMITS)
        elif pieces:
            flush()
        if attributes.rstrip().endswith("/") and tag in ("svg", "object"):
            continue
        parent = stack[-1] if stack else -1
        over = elements[parent] if stack else None
        depth = over.depth + 1 if over else 0
        path = tag + classes
        if over:
            path = f"{over.path}>{path}" if depth < DEEPEST else over.path
        inside = tag in ARTICLES or bool(over and over.in_article)
        mark = other if other != WHOLE and tag not in KEPT_TAGS else 0
        left_out = inherited(tag, other)
        wraps = tag in WRAPPERS and not left_out
        elements.append(Element(tag, path, parent, depth, inside, left_out, mark, wraps))
        open_at[tag].append(len(stack))
        stack.append(len(elements) - 1)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            at = end.start() if end else size
    flush()
    return page


def best_container(page: Page) -> tuple[str, float]:
    """The path of the container with the most text of its own, and its score.

    A block counts by its characters outside links, for its container in full and for
    the one above by half. A container inside an article stands for the article.
    """
    scores: dict[int, float] = {}
    for element, text, linked in page.blocks:
        free = max(0, len(text) - linked)
        worth = free * free / len(text) + text.count(",") * 10
        chain = list(islice(page.chain(element), 4))
        inner = chain[1:] if chain and page.elements[chain[0]].tag not in ("body", "div") else chain
        for share, container in zip((1.0, 0.5, 0.25), inner or chain):
            scores[container] = scores.get(container, 0.0) + share * worth
    if not scores:
        return "", 0.0
    best = max(scores, key=lambda e: (scores[e], -e))
    score = scores[best]
    for tag in ARTICLES:
        around = [e for e in page.chain(best) if page.elements[e].tag == tag]
        if around:
            best = around[-1]
            break
    return page.elements[best].path, score


def text_at(page: Page, path: str) -> str:
    """Blocks inside any container with this path, in page order; all without a path."""
    inside: list[bool] = []
    for e in page.elements:
        inside.append(e.path == path or e.parent >= 0 and inside[e.parent])
    return "\n\n".join(
        text for element, text, _ in page.blocks if not path or element >= 0 and inside[element]
    )
