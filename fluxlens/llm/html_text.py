"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block element. Page furniture (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments) is dropped by tag, role and name, but names alone do not decide: a heading is never
furniture for its slug, an identifier counts only when all of its words are such names, and an element around most of the
page's blocks is a wrapper whatever it is called. The other lines weigh as much as their text: within an article or main
element all of it and more, elsewhere what is not in links. Weights are summed over a sliding window of lines; the side with
more weight is the text, within the elements or around them, and there it runs from the first point where the sum surges to
the last where it dives. Everything between them that is not furniture is kept.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.llm.tasks import pieces

#: Lines of a window, the weight at which it belongs to the text, and how much more text in an article or main element weighs.
WINDOW = 3
SURGE = 80
PRIOR = 8
#: An element around this share of a page's blocks, and as many of them, is a wrapper.
WRAPPER_SHARE, WRAPPER_BLOCKS = 0.5, 4

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|iframe|textarea|title)\b(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|</?[a-zA-Z][^<>]*(?:>|\Z|(?=<))",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split()
)
#: Dropped with what they hold, without ending the line they stand in.
_DROPPED = frozenset("svg object canvas select noscript template annotation annotation-xml".split())
#: Blocks that end an svg element left open before them, as in browsers.
_BREAKOUT = frozenset("blockquote div dl dt dd h1 h2 h3 h4 h5 h6 li ol p pre table ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset("nav footer aside form dialog menu button fieldset head".split())
#: Furniture whatever it holds.
_ALWAYS = frozenset("nav footer aside dialog menu button head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|banner|sponsor(?:ed|s)?|promo(?:tion)?s?|cookies?|consent|gdpr|notice|notification|alert|"
    r"sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|toolbar|topbar|comments?|disqus|replies|respond|share|sharing|social|related|recommended|"
    r"newsletter|subscribe|subscription|signup|popup|modal|overlay|widget|login|search|pagination|pager|skip|copyright)(?:$|[\s_-])",
    re.I,
)
#: Words that an identifier may have besides furniture names, and names that mark furniture as identifiers too.
_NEUTRAL = frozenset(
    "area articles bar block bottom box buttons column container content footer group head header icons inner item items left links list main media more module "
    "outer page panel pane post posts right row section site slot thread top widget wrap wrapper".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCKS = frozenset("p li td dd pre blockquote".split()) | _HEADINGS
_TOPICS = re.compile(r"(?:advertising|advertisements?|alert|banner|copyright|notice|notification|promotions?|search|sharing|side|social|sponsors?|subscription|login)", re.I)
_HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|head)(?:$|[\s_-])", re.I)
_COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|disqus|respond|related|promo|teaser|ads?|advert)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Line:
    """The text of one block, how much of it is in links, and whether it lies in an article or main element."""

    text: str
    linked: int
    inside: bool


def _telling(attributes: str) -> dict[str, str]:
    """The attributes that tell about an element's role."""
    if not attributes or attributes.isspace():
        return {}
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)}


def _is_for_comments(tag: str, attributes: str) -> bool:
    """Whether an element holds readers' comments, adverts or links to other pages, however long they are."""
    found = _telling(attributes)
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    return bool(_COMMENT_NAMES.search(names)) or (tag == "form" and "comment" in names)


def _is_furniture(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _FURNITURE or (tag == "header" and not inside):
        return True
    found = _telling(attributes)
    if not found or tag in ("html", "body"):
        return False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return True
    if tag in _HEADINGS:
        return False
    classes, identifier = found.get("class", ""), found.get("id", "")
    if tag in ("article", "main") or found.get("role", "").lower() == "main":
        return tag != "main" and bool(_COMMENT_NAMES.search(f"{classes} {identifier}"))
    if found.get("role", "").lower() in _ROLES:
        return True
    if _names_furniture(identifier) or (not inside and bool(_HEADER_NAMES.search(f"{classes} {identifier}"))):
        return True
    return any(map(_names_furniture, classes.split())) if inside else bool(_NAMES.search(classes))


def _names_furniture(name: str) -> bool:
    """Whether a name consists of furniture words, with neutral words and numbers beside them; a single word that may be a topic does not tell."""
    words = [w for w in re.split(r"[\s_-]+", name.lower()) if w]
    if not _NAMES.search(name) or (len(words) == 1 and _TOPICS.fullmatch(name)):
        return False
    return all(w in _NEUTRAL or w.isdigit() or _NAMES.search(w) for w in words)


class _Extents:
    """Where elements end and how many blocks they hold, found in one pass over a page's tags."""

    def __init__(self, marks: list[re.Match]):
        self.ends: dict[int, int] = {}
        self.blocks: list[int] = []
        open_: dict[str, list[int]] = {}
        for m in marks:
            tag = (m["tag"] or "").lower()
            if not tag or tag in _VOID or tag in _INLINE:
                continue
            if m["close"]:
                if open_.get(tag):
                    self.ends[open_[tag].pop()] = m.start()
            else:
                open_.setdefault(tag, []).append(m.start())
                if tag in _BLOCKS:
                    self.blocks.append(m.start())

    def wraps(self, at: int) -> bool:
        """Whether the element that opens at a place holds most of the page's blocks."""
        inside = bisect_left(self.blocks, self.ends.get(at, 1 << 62)) - bisect_left(self.blocks, at)
        return inside >= max(WRAPPER_BLOCKS, WRAPPER_SHARE * len(self.blocks))

    def closed_after(self, at: int, place: int) -> bool:
        """Whether the element that opens at a place is closed somewhere after another place."""
        return self.ends.get(at, -1) > place


def lines(page: str) -> list[Line]:
    """The page's lines without markup and furniture, in page order; empty ones are left out."""
    out: list[Line] = []
    open_: list[tuple[str, bool, bool, int]] = []  # tag, furniture, article or main, place
    marks = list(_MARKUP.finditer(page))
    extents = _Extents(marks)
    parts: list[str] = []
    linked = links = furniture = inside = 0

    def end_line() -> None:
        nonlocal linked
        if furniture:
            return
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Line(text, min(linked, len(text)), inside > 0))
            parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal furniture, inside
        _, drops, root, _ = open_.pop()
        furniture -= drops
        inside -= root

    at = 0
    for m in marks:
        if m.start() > at and not furniture:
            text = page[at : m.start()]
            parts.append(text)
            if links:
                linked += len(text.strip())
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in _INLINE:
            if tag == "a":
                links = 0 if m["close"] else 1
            elif m["close"]:
                if any(t == tag and drops for t, drops, _, _ in open_[-8:]):
                    end_line()
                    while open_[-1][0] != tag:
                        pop()
                    pop()
            elif m["attributes"] and not m["attributes"].endswith("/") and _is_furniture(tag, m["attributes"], inside > 0):
                end_line()
                open_.append((tag, True, False, m.start()))
                furniture += 1
            continue
        if tag in _DROPPED and not m["close"]:
            if not (m["attributes"] or "").endswith("/"):
                open_.append((tag, True, False, m.start()))
                furniture += 1
            continue
        if tag not in _DROPPED:
            end_line()
            links = 0
        if m["close"]:
            if any(o[0] == tag for o in open_):
                while open_[-1][0] != tag:
                    pop()
                pop()
                if tag not in _DROPPED:
                    end_line()
            continue
        if furniture and tag in _BREAKOUT:
            inner = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] in ("svg", "foreignobject") or not open_[i][1] and open_[i][0] in _BREAKOUT), -1)
            if inner >= 0 and open_[inner][0] == "svg":
                while len(open_) > inner:
                    pop()
                end_line()
        if tag in _VOID or (m["attributes"] or "").endswith("/"):
            continue
        drops = _is_furniture(tag, m["attributes"] or "", inside > 0)
        if drops and tag not in _ALWAYS and not _is_for_comments(tag, m["attributes"] or "") and extents.wraps(m.start()):
            drops = False
        root = tag in ("article", "main") and not drops
        if root and furniture:
            outer = next(o for o in open_ if o[1])
            if tag == "main" or not extents.closed_after(outer[3], m.start()):
                # what was left open before the text is over
                while furniture:
                    pop()
                end_line()
            else:
                root = False
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and open_ and open_[-1][0] == tag:
            pop()
        open_.append((tag, drops, root, m.start()))
        furniture += drops
        inside += root
    if not furniture:
        parts.append(page[at:])
    furniture = 0
    end_line()
    return out


def _stretch(found: list[Line], weights: list[int]) -> str:
    """The lines from the first surge of the windows' weight to the last dive, and around them up to lines without weight."""
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    least = min(SURGE, max(1, max(sums, default=0) // 2))
    surges = [i for i, total in enumerate(sums) if total >= least]
    if not surges:
        return ""
    first, last = surges[0], min(surges[-1] + WINDOW, len(found)) - 1
    while first and weights[first - 1]:
        first -= 1
    while last + 1 < len(found) and weights[last + 1]:
        last += 1
    own = [i for i in range(first, last + 1) if weights[i]]
    return " ".join(line.text for line in found[own[0] : own[-1] + 1])


def main_text(page: str | None) -> str:
    """The text between surge and dive points, its blocks joined by one space; null or textless pages give ''.

    Lines of article and main elements and the lines around them are weighed against each other: text in the elements
    weighs PRIOR times as much, so they lose only to a text many times as long.
    """
    found = lines(page or "")
    within = [line for line in found if line.inside]
    around = [line for line in found if not line.inside]
    inner = [PRIOR * len(line.text) for line in within]
    outer = [max(0, len(line.text) - line.linked) for line in around]
    if sum(inner) >= sum(outer) and within:
        return _stretch(within, inner)
    return _stretch(around, outer)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row for each row: page_id, url, text, n_chars (code points).

    A null or textless page gives an empty text. Null identifiers and addresses and repeated rows stay; other columns
    are not read; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    read = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return read.mapInArrow(run, "page_id long, url string, text string, n_chars long")
