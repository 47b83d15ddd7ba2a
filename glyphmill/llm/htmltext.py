"""Main-text extraction from HTML by minimum-cut labelling.

Method: a page is cut into blocks of text at block-level tags. A logistic
classifier on a block's own features, on its ancestors and on its place in the page
gives the cost of calling it content and of calling it boilerplate, the negative
logarithms of the probabilities; these are the capacities to the two terminals.
Neighbours in page order and in the DOM are joined by edges that make different
labels cost something, the less the farther apart they are in the tree. The minimum
cut, found by maximum flow, is the labelling of least total cost: a block of weak
evidence takes the label of its surroundings.

The weights are learned (``learn``) from the labelled pages of ``htmlpages``, each
with and without class names and with and without article elements.

Text: character references are decoded, white space inside a block becomes one
space, ends are trimmed, blocks are joined in page order by two line feeds.

Defined cases: null and empty pages give an empty text; a comment without end
hides the rest, a tag without end is dropped; a ``<`` that starts no tag is text;
end tags without start are ignored; elements may be nested to any depth and pages
have any length; blocks whose labels cost the same go by the cut that the flow
leaves on the side of content; repeated rows are extracted one by one; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bound_batches

# Names of HTML elements by role, and words of class, id and role
# attributes that hint at what a container holds.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul""".split()
)
RAW_TAGS = frozenset("script style template noscript iframe noframes textarea title svg object canvas audio video select datalist".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button select fieldset search head".split())
CONTENT_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dt dd td th option".split())
#: Words of places: they tell whatever stands beside them.
PLACE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay nav navbar navigation menu menubar
    breadcrumb breadcrumbs sidebar widget widgets footer masthead topbar toolbar pagination pager skiplink newsletter comment comments commentlist disqus contentinfo""".split()
)
#: Words of purposes: they tell as the last word of a name, and hint elsewhere.
PURPOSE_WORDS = frozenset(
    """aside notice notices notification alert related recommended recommendations share sharing social subscribe subscription signup login register search discussion replies reply
    respond reviews copyright disclaimer legal tags tagcloud complementary skip""".split()
)
CONTENT_WORDS = frozenset("article content post entry story main body text prose maincontent articlebody".split())
#: Words that say nothing at the end of a name, and words that turn a name around.
EMPTY_WORDS = frozenset("box wrapper wrap container area section block inner outer list item items slot panel row col column group left right top bottom".split())
NEGATIONS = frozenset("no not has with without is".split())
#: Closed by the start of one of these: an open element of the key, unless one of
#: SCOPES was opened since.
CLOSES = {
    "p": BLOCK_TAGS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option"]),
    **{h: HEADINGS for h in HEADINGS},
}
SCOPES = frozenset("ul ol dl table article section div main".split())
#: What the start of a tag closes.
CLOSED_BY = {tag: [key for key, starts in CLOSES.items() if tag in starts] for tag in BLOCK_TAGS}
#: Features of a block, and their weights as ``learn`` gives them for ``htmlpages``.
FEATURES = "bias length stop links paragraph heading item in_content beside_content in_boilerplate content_word purpose_word before_heading".split()
WEIGHTS = [-1.33, 3.34, -0.25, -5.13, 0.49, 1.72, 3.36, 0.91, -2.53, -4.05, 4.42, -2.25, -1.68]
#: Smoothness: costs of different labels for neighbours in page order and for
#: neighbours in one container, and what a step further apart leaves of the first.
ADJACENT, SIBLINGS, DECAY = 0.8, 2.0, 0.5

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_WORDS = re.compile(r"[a-z0-9]+")
_ENDS = (".", "!", "?", ":", '"', "”", "»", "…")


@dataclass(slots=True)
class Element:
    """An element with what it and its ancestors say about the text inside."""

    tag: str
    depth: int
    parent: Element | None
    content: bool = False
    boilerplate: bool = False
    good: bool = False
    purpose: bool = False
    mark: str | None = None


@dataclass(slots=True)
class Block:
    element: Element
    text: str
    words: int
    linked: int


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def hints(names: str) -> tuple[bool, bool, bool]:
    """Whether names (of classes and the like) speak of content, of a place of
    boilerplate, or of a purpose that boilerplate has. The last word of a name
    tells what the thing is: main-menu is a menu, search-results-intro an intro."""
    good = place = purpose = False
    for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower().split():
        words = _WORDS.findall(name)
        if not words or words[0] in NEGATIONS:
            continue
        told = [w for w in words if w not in EMPTY_WORDS and not w.isdigit()]
        head = told[-1] if told else words[-1]
        if any(w in PLACE_WORDS for w in words) or head in PURPOSE_WORDS:
            place = True
        elif any(w in PURPOSE_WORDS for w in words):
            purpose = True
        elif head in CONTENT_WORDS:
            good = True
    return good, place, purpose


def open_element(tag: str, raw: str, parent: Element | None) -> Element:
    """The element with what its tag and attributes say about its text."""
    e = Element(tag, parent.depth + 1, parent, parent.content, parent.boilerplate, parent.good, parent.purpose, parent.mark) if parent else Element(tag, 0, None)
    e.content |= tag in CONTENT_TAGS
    e.boilerplate |= tag in BOILERPLATE_TAGS or tag == "header" and not e.content
    if raw.strip() and tag not in ("html", "body"):
        a = attributes(raw)
        good, place, purpose = hints(" ".join(a.get(k, "") for k in ("class", "id", "role", "aria-label", "itemprop")))
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        e.boilerplate |= place or hidden
        # an article about something related is an article
        e.purpose |= purpose and tag not in CONTENT_TAGS
        e.good |= good and not place
        e.mark = a.get("data-keep", e.mark)
    return e


def blocks_of(page: str) -> list[Block]:
    """The blocks of text of a page in order."""
    root = Element("", -1, None)
    stack, out = [root], []
    text: list[str] = []
    linked, in_link = 0, False
    #: Where in the stack the open elements of a tag are, and those of SCOPES, so
    #: that no tag searches a deep stack.
    places: dict[str, list[int]] = {}
    scopes: list[int] = []

    def leave(k: int) -> None:
        for e in stack[k:]:
            places[e.tag].pop()
            if e.tag in SCOPES:
                scopes.pop()
        del stack[k:]

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            out.append(Block(stack[-1], joined, joined.count(" ") + 1, linked))
        text.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                if stack[-1].tag != "head":
                    raw = html.unescape(raw)
                    text.append(raw)
                    linked += len(raw.split()) if in_link else 0
            continue
        if m[5] and not m[0].endswith(">"):
            break
        closing, rest = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag == "a":
                in_link = False
            elif tag in BLOCK_TAGS:
                flush()
                if places.get(tag):
                    leave(places[tag][-1])
                    in_link = False
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag == "a":
            in_link = "href" in rest.lower()
            continue
        if tag in RAW_TAGS:
            if tag == "svg" and rest.rstrip().endswith("/"):
                continue
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if close:
                at = page.find(">", close.end()) + 1 or end
            elif tag in ("script", "style", "textarea", "title"):
                break
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag == "body":
                k = len(stack)
                while k > 1 and stack[k - 1].tag == "head":
                    k -= 1
                leave(k)
            within = scopes[-1] if scopes else 0
            closed = [places[key][-1] for key in CLOSED_BY[tag] if places.get(key) and places[key][-1] > within]
            if closed:
                leave(min(closed))
            if tag not in VOID_TAGS:
                stack.append(open_element(tag, rest, stack[-1]))
                places.setdefault(tag, []).append(len(stack) - 1)
                if tag in SCOPES:
                    scopes.append(len(stack) - 1)
    flush()
    return out


def features(blocks: list[Block]) -> list[list[float]]:
    """FEATURES of every block."""
    any_content = any(b.element.content for b in blocks)
    first = next((i for i, b in enumerate(blocks) if b.element.tag in ("h1", "h2") and not b.element.boilerplate), 0)
    out = []
    for i, b in enumerate(blocks):
        e = b.element
        out.append(
            [
                1.0, math.log1p(min(b.words, 60)) / math.log1p(60), float(b.text.endswith(_ENDS)), min(b.linked / b.words, 1.0), float(e.tag in ("p", "pre", "blockquote", "figcaption")),
                float(e.tag in HEADINGS), float(e.tag in ITEMS), float(e.content), float(any_content and not e.content), float(e.boilerplate), float(e.good), float(e.purpose),
                float(i < first),
            ]
        )
    return out


def evidence(blocks: list[Block], weights: list[float] | None = None) -> list[float]:
    """Log-odds that each block is content."""
    w = WEIGHTS if weights is None else weights
    return [sum(a * b for a, b in zip(row, w)) for row in features(blocks)]


def learn(pages: Iterable[str], ridge: float = 0.5) -> list[float]:
    """Weights of a logistic fit to pages with ``data-keep`` marks."""
    rows, labels = [], []
    for page in pages:
        blocks = blocks_of(page)
        rows += features(blocks)
        labels += [float(b.element.mark == "1") for b in blocks]
    x, y = np.array(rows), np.array(labels)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return [round(float(v), 2) for v in w]


def distance(a: Element, b: Element, most: int) -> int:
    """Steps between two elements of the tree, counted up to ``most``."""
    x: Element | None = a
    y: Element | None = b
    n = 0
    while x is not y and n < most:
        if x is not None and (y is None or x.depth >= y.depth):
            x = x.parent
        else:
            y = y.parent
        n += 1
    return n


def edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Pairs of blocks with what different labels cost."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            w = ADJACENT * DECAY ** max(0, distance(blocks[i - 1].element, b.element, 16) - 2)
            if w > 1e-3:
                out.append((i - 1, i, w))
        container = id(b.element.parent)
        if container in last:
            out.append((last[container], i, SIBLINGS))
        last[container] = i
    return out


class Flow:
    """Maximum flow by shortest layers (Dinic), without recursion."""

    def __init__(self, n: int):
        self.edges: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def add(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.edges[a].append(len(self.to))
        self.to.append(b), self.room.append(there)
        self.edges[b].append(len(self.to))
        self.to.append(a), self.room.append(back)

    def _layers(self, source: int) -> list[int]:
        layer = [-1] * len(self.edges)
        layer[source], queue = 0, [source]
        for a in queue:
            for e in self.edges[a]:
                if self.room[e] > 1e-9 and layer[self.to[e]] < 0:
                    layer[self.to[e]] = layer[a] + 1
                    queue.append(self.to[e])
        return layer

    def side(self, source: int, sink: int) -> list[bool]:
        """Which nodes stay on the source's side of a minimum cut."""
        while (layer := self._layers(source))[sink] >= 0:
            nexts = [0] * len(self.edges)
            path: list[int] = []
            at = source
            while True:
                if at == sink:
                    least = min(self.room[e] for e in path)
                    for k, e in enumerate(path):
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    k = next(k for k, e in enumerate(path) if self.room[e] <= 1e-9)
                    at = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while nexts[at] < len(self.edges[at]):
                    e = self.edges[at][nexts[at]]
                    if self.room[e] > 1e-9 and layer[self.to[e]] == layer[at] + 1:
                        break
                    nexts[at] += 1
                else:
                    if at == source:
                        break
                    e = path.pop()
                    at = self.to[e ^ 1]
                    nexts[at] += 1
                    continue
                path.append(e)
                at = self.to[e]
        return [x >= 0 for x in layer]


def costs(z: float) -> tuple[float, float]:
    """What the labels boilerplate and content cost a block with log-odds ``z``."""
    return math.log1p(math.exp(min(z, 30))), math.log1p(math.exp(min(-z, 30)))


def label(blocks: list[Block]) -> list[bool]:
    """True for the blocks that the minimum cut calls content."""
    n = len(blocks)
    flow = Flow(n + 2)
    for i, z in enumerate(evidence(blocks)):
        boilerplate, content = costs(z)
        flow.add(n, i, boilerplate)
        flow.add(i, n + 1, content)
    for i, j, w in edges(blocks):
        flow.add(i, j, w, w)
    return flow.side(n, n + 1)[:n]


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, keep in zip(blocks, label(blocks)) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(id, url, text) of every row's whole page."""
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    return rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string")
