"""Operator 7: main text of web pages by tag-path ratios.

A page's text falls into blocks, each with its root-to-leaf path of block
elements.  For every path the text length and the punctuation are summed over
its blocks and divided by their number; both ratios are smoothed along the page
by a Gaussian over neighbouring blocks of one section, fused by product, and a
path counts as content when its fused ratio reaches a share of the page's
mean.  Content is the element around the content paths that holds most of the
fused mass, grown over headings and sections beside it; its blocks are kept in
page order, short ones too, so a brief paragraph or heading of the article isn't
lost, and link lists of a marked article stay.  A class that only tells the
layout (``with-sidebar``, ``no-sidebar``, ``side-by-side``) leaves nothing out, a
quotation in an ``aside`` of an article is part of it.

Menus, page headers and footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are left out by element, role, class or id before
ratios are taken.  A page is read whole, once, in its own row; tags need not be
balanced.

Time grows with the page and, for blocks with text, with the depth of their
paths; a very long page or text is read whole like any other.  Further columns
of ``pages`` are ignored.

Defined results: null or empty html gives the empty text; a page without
markup is its text; repeated rows are extracted each; an empty table gives no
rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<raw>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>|\Z)|[^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style textarea title noscript template iframe noembed noframes svg math object audio video canvas xmp".split())
LEFT_OUT = frozenset("nav footer aside form button select dialog menu search head fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "option", "optgroup", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adbox|adsense|advert\w*|banners?|breadcrumbs?|comment\w*|cookies?|consent|gdpr|disqus|discussion"
    r"|footers?|foot|masthead|menus?|nav|navbar|navigation|topbar|newsletter|notices?|notification|alert|pagination|pager|paywall|popup|modal|overlay"
    r"|promo\w*|recommend\w*|related|repl(?:y|ies)|respond|share|sharing|sidebar|side|social|sponsor\w*|subscribe|toolbar|widgets?|signup|login|search)(?:$|[\s_-])",
    re.I,
)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|head)(?:$|[\s_-])", re.I)
LAYOUT = re.compile(r"(?<!\S)(?:(?:with|without|has|have|no|not|is|in|side-by)[_-]\S*|\S+[_-](?:open|closed|left|right|layout)(?!\S))", re.I)  # classes that say how a page is laid out
QUOTE = re.compile(r"\s*<(?:blockquote|q)\b", re.I)
QUOTE_NAMES = re.compile(r"pull-?_?quote|(?:^|[\s_-])quote(?:$|[\s_-])", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¡¿]")


@dataclass
class Block:
    path: tuple[int, ...]  # open elements, by number
    names: str
    text: list[str] = field(default_factory=list)
    linked: int = 0


def left_out(tag: str, attributes: str, inside: bool, quote: bool = False) -> bool:
    """Whether an element and what it holds is no article text; ``inside``: of an
    article or main element; ``quote``: it begins with a quotation."""
    if tag == "aside" and inside and (quote or QUOTE_NAMES.search(attributes)):
        return False
    if tag in LEFT_OUT:
        return True
    if tag == "header" and not inside:
        return True
    if attributes and not attributes.isspace():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
                return True
            if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                if NAMES.search(value) and NAMES.search(LAYOUT.sub(" ", value)) or HEADER_NAMES.search(value) and not inside:
                    return True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
    return False


def blocks_of(page: str) -> tuple[list[Block], dict[int, str]]:
    """(blocks with text, in page order; name of each element number)."""
    out: list[Block] = []
    names: dict[int, str] = {}
    stack: list[tuple[str, int, bool]] = []  # tag, number, left out
    block: Block | None = None
    at = number = 0
    open_now: dict[str, int] = defaultdict(int)  # elements of each tag on the stack

    def add(text: str) -> None:
        nonlocal block
        if not text or stack and stack[-1][2]:
            return
        if block is None:
            if text.isspace():
                return
            chain = [(t, n) for t, n, _ in stack if t in BLOCKS]
            block = Block(tuple(n for _, n in chain), "/".join(t for t, _ in chain))
            out.append(block)
        block.text.append(text)
        if open_now["a"]:
            block.linked += len(text)

    def close(upto: int) -> None:
        nonlocal block
        for tag, _, _ in stack[upto:]:
            open_now[tag] -= 1
            if tag in BLOCKS:
                block = None
        del stack[upto:]

    while True:
        m = MARKUP.search(page, at)
        add(entities.unescape(page[at : m.start()] if m else page[at:]))
        if m is None:
            return out, names
        at = m.end()
        if m["raw"]:
            add(m["raw"])
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1) if open_now[tag] else ():
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in ("article", "main", "body", "td") and tag not in BLOCKS:
                    break
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in UNREAD:
            if not m["attributes"].rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1) if open_now["p"] else ():
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, -1, -1) if any(open_now[t] for t in SIBLINGS[tag]) else ():
                if stack[i][0] in SIBLINGS[tag]:
                    close(i)
                    if tag != "tr" or stack and stack[-1][0] != "tr":
                        break
                elif stack[i][0] in SCOPES[tag]:
                    break
        if tag in BLOCKS:
            block = None
        if tag in VOID:
            continue
        number += 1
        names[number] = tag
        inside = open_now["article"] + open_now["main"] > 0
        out_here = bool(stack and stack[-1][2]) or left_out(tag, m["attributes"], inside, tag == "aside" and bool(QUOTE.match(page, at)))
        open_now[tag] += 1
        stack.append((tag, number, out_here))


def smoothed(values: list[float], section: list, sigma: float) -> list[float]:
    """Gaussian mean over neighbours of the same section."""
    reach = max(1, round(3 * sigma))
    kernel = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for j in range(max(0, i - reach), min(len(values), i + reach + 1)):
            if section[j] == section[i]:
                k = kernel[abs(i - j)]
                total += k * values[j]
                weight += k
        out.append(total / weight)
    return out


def grown(root: int, kept: list[tuple[Block, str]], names: dict[int, str], linked: float) -> set[int]:
    """``root`` and what belongs to it beside it: an element that adds a heading and
    little link text around it takes its place, and a section brings the sections
    next to it."""
    way = next(b.path[: b.path.index(root) + 1] for b, _ in kept if root in b.path)  # from the page to the root
    beside: dict[int, list[tuple[Block, str]]] = defaultdict(list)  # by the depth at which blocks leave that way
    for b, t in kept:
        depth = next((i for i, (x, y) in enumerate(zip(b.path, way)) if x != y), min(len(b.path), len(way)))
        if depth < len(way):
            beside[depth].append((b, t))
    level = len(way) - 1
    for depth in sorted(beside, reverse=True):
        new = beside[depth]
        heads = any(b.path and names.get(b.path[-1]) in HEADINGS for b, _ in new)
        if not depth or names.get(way[depth - 1]) in ("body", "html") or not heads or sum(b.linked for b, _ in new) >= linked * sum(len(t) for _, t in new):
            break
        level = depth - 1
    roots = {way[level]}
    if names.get(way[level]) == "section":
        roots |= {b.path[level] for b, _ in kept if b.path[:level] == way[:level] and len(b.path) > level and names.get(b.path[level]) == "section"}
    return roots


def main_blocks(found: list[Block], names: dict[int, str], sigma: float = 1.0, share: float = 0.3, linked: float = 0.6) -> list[str]:
    """Texts of the blocks that hold the article."""
    texts = [" ".join("".join(b.text).split()) for b in found]
    kept = [(b, t) for b, t in zip(found, texts) if t]
    if not kept:
        return []
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for b, t in kept:
        length[b.names] += max(0, len(t) - b.linked)
        marks[b.names] += len(PUNCTUATION.findall(t))
        count[b.names] += 1
    section = [b.path[:-1] for b, _ in kept]
    by_length = smoothed([length[b.names] / count[b.names] for b, _ in kept], section, sigma)
    by_marks = smoothed([marks[b.names] / count[b.names] for b, _ in kept], section, sigma)
    fused = [a * (1 + p) for a, p in zip(by_length, by_marks)]
    path_score = defaultdict(list)
    for (b, _), f in zip(kept, fused):
        path_score[b.names].append(f)
    mean = sum(fused) / len(fused)
    content = {p for p, f in path_score.items() if sum(f) / len(f) >= share * mean}
    mass: dict[int, float] = defaultdict(float)  # of the elements around content blocks
    for (b, t), f in zip(kept, fused):
        if b.names in content:
            for n in b.path or (0,):
                mass[n] += f * len(t)
    total = max((mass[n] for n in mass), default=0.0)
    marked = [n for n in mass if names.get(n) in ("article", "main")]
    if marked:
        best = max(mass[n] for n in marked)
        roots = {n for n in marked if mass[n] >= share * best}
    else:  # the innermost element that still holds nearly all of the mass
        roots = {max((n for n in mass if mass[n] >= 0.9 * total), default=0)}
        if names.get(max(roots)) in ("p", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote"):
            roots = {b.path[-2] if len(b.path) > 1 else 0 for b, _ in kept if b.path and b.path[-1] in roots}
        if len(roots) == 1 and 0 not in roots:
            roots = grown(max(roots), kept, names, linked)
    inside = lambda b: 0 in roots or not roots.isdisjoint(b.path)
    # a marked article keeps its lists of links too: what isn't its own was left out by name
    return [t for b, t in kept if inside(b) and (marked or b.linked < linked * len(t) or b.names in content)]


def extract(page: str | None) -> str:
    """Main text of a page; blocks joined by an empty line."""
    return "\n\n".join(main_blocks(*blocks_of(page or "")))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column("html")]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
