"""Main-text extraction from HTML by tag-path ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the HTML standard: elements without content, raw-text elements, and elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg math object canvas textarea select option button head title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag on the left ends an open element on the right.
ENDS = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}), "option": frozenset({"option"}),
}
FORMATTING = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var".split())
#: Element names, roles and class or id words of page furniture.
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog button label fieldset".split())
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer sidebar side aside widget ad ads advert adverts advertisement advertising sponsor"
    " sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social"
    " related recommended recommendations comment comments respond reply replies disqus discussion form pagination pager toolbar copyright legal disclaimer tags meta byline".split()
)
MAIN_TAGS = frozenset({"article", "main"})
#: A quote opens a string only after "="; other quotes are plain, and a tag ends at the first ">" if its strings leave none.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+>|[^>]*>)|[^<]+|<", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+|(?<=[a-z])[A-Z][a-z]*")
_PUNCT = re.compile(r"[.,;:!?…。，；：！？、]")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """Text of one block element in page order, with the number of its root-to-leaf tag path."""

    path: int
    parts: list[str] = field(default_factory=list)
    furniture: bool = False
    mark: int = -1
    main: int = 0
    linked: int = 0

    @cached_property
    def text(self) -> str:
        return _SPACE.sub(" ", "".join(self.parts)).strip()


@dataclass
class Element:
    """An open element: its tag and path, what it inherits, and its innermost mark of furniture (-1: none)."""

    tag: str
    path: int
    hidden: bool = False
    main: int = 0
    mark: int = -1
    ended: bool = False


class Paths:
    """Tag paths as numbers: a path is its parent's number and a name, so that deep pages need no long strings."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, str], int] = {}
        self.parent = [0]

    def below(self, parent: int, name: str) -> int:
        own = self.number.setdefault((parent, name), len(self.parent))
        if own == len(self.parent):
            self.parent.append(parent)
        return own


class Stack:
    """The open elements, with the places of each tag and of the blocks, so that no token looks through all of them."""

    def __init__(self) -> None:
        self.elements: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of open blocks but p
        self.root = Element("", 0)

    def top(self) -> Element:
        return self.elements[-1] if self.elements else self.root

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of one of these tags; -1 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def last_block(self) -> int:
        return max(self.blocks[-1] if self.blocks else -1, self.last("p"))

    def push(self, element: Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self.elements))
        if element.tag in BLOCK and element.tag != "p":
            self.blocks.append(len(self.elements))
        self.elements.append(element)

    def cut(self, place: int) -> None:
        """Ends the element at this place and all inside it."""
        while len(self.elements) > place or (self.elements and self.elements[-1].ended):
            gone = self.elements.pop()
            if not gone.ended:
                self.places[gone.tag].pop()
                if self.blocks and self.blocks[-1] == len(self.elements):
                    self.blocks.pop()

    def end_alone(self, place: int) -> None:
        """Ends the innermost element of its tag, while what is inside it stays open."""
        self.elements[place].ended = True
        self.places[self.elements[place].tag].pop()


def _marks(tag: str, attrs: str) -> tuple[bool, bool, str]:
    """Whether an element looks like page furniture, whether it is hidden, and its name with its class for the tag path."""
    words, name, gone, hidden = set(), tag, tag in FURNITURE_TAGS, False
    for key, *values in _ATTR.findall(attrs):
        value = next((v for v in values if v), "")
        key = key.lower()
        if key in ("class", "id", "role"):
            words |= {w.lower() for w in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", value) if w}
            if key == "class":
                name += "." + ".".join(sorted(value.lower().split()))
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            hidden = True
    if tag not in MAIN_TAGS and tag not in ("html", "body") and words & FURNITURE_WORDS:
        gone = True
    return gone, hidden, name


def _judge(blocks: list[Block], around: list[int], holds_main: list[bool], main_outside: bool) -> None:
    """Sets aside the blocks below a mark of furniture that holds; ``around`` has the next mark outside of each.

    All marks hold if an article or main element stands outside of them. Else a mark does not hold for an element with most
    of the page's unlinked text, nor for one with an article or main element and at least as much text as outside of marks.
    """
    inside, total, outside = [0] * len(around), 0, 0
    for b in blocks:
        if not b.furniture:
            free = max(0, len(b.text) - b.linked)
            total += free
            if b.mark < 0:
                outside += free
            else:
                inside[b.mark] += free
    for k in range(len(around) - 1, -1, -1):  # marks are numbered from the outside
        if around[k] >= 0:
            inside[around[k]] += inside[k]
            holds_main[around[k]] |= holds_main[k]
    gone: list[bool] = []
    for k, outer in enumerate(around):
        holds = main_outside or not (2 * inside[k] > total or (holds_main[k] and inside[k] >= outside))
        gone.append(holds or (outer >= 0 and gone[outer]))
    for b in blocks:
        b.furniture |= b.mark >= 0 and gone[b.mark]


def blocks_of(html: str, paths: Paths | None = None) -> list[Block]:
    """The blocks of a page with text, by one pass over its tokens; broken and cut markup is closed as browsers do.

    The work grows with the length of the page, however deep it is nested and however many elements stay open.
    """
    paths = paths or Paths()
    out: list[Block] = []
    stack = Stack()
    around: list[int] = []  # of every mark of furniture, the one around it
    holds_main: list[bool] = []
    endless: set[str] = set()  # raw elements that nothing ends any more
    main_outside = False
    now: Block | None = None
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            piece = m.group(0)
            if piece[0] == "<" and len(piece) > 1:
                continue
            if piece == "<" and re.match(r"/?[a-zA-Z!]", html[at : at + 2]):
                break  # a tag that the end of the page cut off
            if now is None:
                top = stack.top()
                now = Block(top.path, furniture=top.hidden, mark=top.mark, main=top.main)
                out.append(now)
            text = unescape(piece)
            now.parts.append(text)
            if stack.places.get("a"):
                now.linked += len(text)
            continue
        tag, closing = tag.lower(), m.group(1)
        if tag in RAW and not closing:
            end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            if end or tag in ("script", "style", "textarea", "title"):
                at = end.end() if end else n
            elif not end:
                endless.add(tag)
            continue
        if tag == "br" or tag == "wbr":
            if now is not None and tag == "br":
                now.parts.append("\n")
            continue
        if tag in BLOCK or tag in RAW:
            now = None
        if closing:
            place = stack.last(tag)
            if place >= 0 and (tag not in FORMATTING or stack.last_block() < place):
                stack.cut(place)
            elif place >= 0:
                stack.end_alone(place)
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            while (place := stack.last("p")) >= 0 and (not stack.blocks or stack.blocks[-1] < place):
                stack.cut(place)
        if tag in ENDS:
            place = stack.last(*ENDS[tag])
            if place >= 0 and place > stack.last("ul", "ol", "dl", "table"):
                stack.cut(place)
        gone, hidden, name = _marks(tag, m.group(3) or "")
        up = stack.top()
        path, main, mark = up.path if tag in FORMATTING else paths.below(up.path, name), up.main, up.mark
        if tag in MAIN_TAGS and not up.hidden:
            main = main or path
            main_outside |= mark < 0
            if mark >= 0:
                holds_main[mark] = True
        # a heading block of the article itself is no page header
        own_header = tag == "header" and up.main > 0
        if gone and not own_header:
            around.append(mark)
            mark = len(holds_main)
            holds_main.append(False)
        stack.push(Element(tag, path, up.hidden or (hidden and not own_header), main, mark))
    out = [b for b in out if b.text]
    _judge(out, around, holds_main, main_outside)
    return out


def content_blocks(html: str | None, smooth: float = 1.0, threshold: float = 0.25) -> list[str]:
    """The texts of the content blocks of a page, in page order.

    Page furniture (by element, role, class or id) is set aside, unless it holds the page's text (``_judge``). All other blocks of one tag path are judged together:
    text length and punctuation per path over the number of its blocks (tag-path ratios), damped by the share of linked
    text, smoothed over the neighbouring paths of one parent, and fused as a geometric mean. A path is content if its
    value reaches ``threshold`` times the page's mean, weighted by text. An article or main element is also judged as one
    path with all below it: if it passes, all its blocks are content, short ones too, and what stands outside is not.
    """
    paths = Paths()
    blocks = [(b, b.text) for b in blocks_of(html or "", paths) if not b.furniture]
    if not blocks:
        return []
    sums: dict[int, np.ndarray] = {}
    mains: dict[int, np.ndarray] = {}
    for b, text in blocks:
        own = np.array([len(text), len(_PUNCT.findall(text)) + 0.5, 1, min(b.linked, len(text))])
        sums[b.path] = sums.get(b.path, 0) + own
        if b.main:
            mains[b.main] = mains.get(b.main, 0) + own
    names = list(sums)

    def ratios(totals: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        length, punct, count, linked = np.array(totals).T
        free = (1 - linked / np.maximum(length, 1)) / count
        return length * free, punct * free

    parents = [paths.parent[p] for p in names]
    fused = np.ones(len(names))
    for r in ratios(list(sums.values())):
        level = r.copy()
        for k in range(len(names)):
            near = [r[j] for j in (k - 1, k + 1) if 0 <= j < len(names) and parents[j] == parents[k]]
            level[k] = (r[k] + smooth * sum(near) / 2) / (1 + smooth * len(near) / 2)
        fused *= level
    value = np.sqrt(fused)
    least = threshold * np.average(value, weights=[s[0] for s in sums.values()])
    if mains:
        whole = np.sqrt(np.prod(ratios(list(mains.values())), axis=0))
        passed = {m for m, v in zip(mains, whole.tolist()) if v >= least}
        if passed:
            return [text for b, text in blocks if b.main in passed]
    good = {p for p, v in zip(names, value.tolist()) if v >= least}
    return [text for b, text in blocks if b.path in good]


def main_text(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` with text (blocks joined by two newlines, empty if none) and n_chars (its code points).

    Each page is judged by itself, whole and whatever its length; null html gives an empty text; nothing is shuffled; an empty table stays empty.
    The new columns replace columns of the same name.
    """
    pages = pages.drop("text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(content_blocks(h)) for h in batch.column(batch.schema.get_field_index("html")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names, "text", "n_chars"])

    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.mapInArrow(run, schema)
