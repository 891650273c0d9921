"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes blocks (the text between block-level tags, character references decoded, white space runs made one space)
with the chain of elements that hold them. A linear classifier over block features — element chain, class and id words,
length, share of linked text — gives log odds for content against boilerplate. Its weights are fitted (:func:`fit`) to the
blocks whose elements say what they are, so that these features can tell about the others. The odds become a flow network:

- *terminal capacities*: positive odds from the source (cost of calling the block boilerplate), negative ones to the sink;
- *smoothness edges* both ways: between neighbouring blocks, weaker the further apart they are in the element tree, and
  between consecutive blocks of one parent element.

Maximum flow (Dinic) leaves the blocks on the source's side of a minimum cut: content. Their texts in page order, one per
line, are the page's text.

Names and roles of elements, and words of class and id that name boilerplate and nothing else, weigh more than all other
features; words that a story's own parts may carry too (more, legal, popular) are one weak feature, which the text or the
blocks beside it overrule. Neither count on html and body nor on the elements around the main element or around the article
with most text.

Never part of any block: scripts, styles, markup, comments, the head, form controls. Null and empty html gives an empty
text with 0 characters. Broken markup is read on as far as it goes: unclosed elements end with their parents, an unfinished
tag at the end is dropped; a head ends at the first text or element that cannot be in it, an unclosed form control at the
next flow element, and unclosed media, objects and maps hide nothing. Pages are handled row by row, so repeated rows, repeated or null ids do not matter; extra
columns are carried only if asked for. An empty table gives an empty result. A page is one task's work; memory is that of
the page.
"""

from __future__ import annotations

import html as references
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements (fixed values: HTML's vocabulary).
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
SILENT = frozenset("head select option optgroup button datalist object canvas audio video map".split())
#: Silent elements whose end tag may be left out: the head before the first element that cannot be in it, the others before
#: the next element that is no inline one. A control without its end tag is closed like them; others without it are not silent.
HEAD_ONLY = frozenset("base basefont bgsound link meta script style template title noscript noframes".split())
OPTIONS = frozenset("option optgroup".split())
CONTROLS = frozenset("select datalist button".split())
AUTO_CLOSED = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
               "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_ELEMENTS = frozenset("nav footer aside form menu dialog fieldset address".split())
CONTENT_ELEMENTS = frozenset("article main".split())
ROOTS = frozenset("html body".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
#: Words of class and id attributes that name boilerplate.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo cookie cookies"
    " consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share"
    " sharing social sidebar aside widget related recommended recommendation recommendations trending"
    " breadcrumb breadcrumbs crumbs menu nav navbar navigation footer masthead topbar toolbar pagination pager paging"
    " tagcloud comment comments commentlist reply replies respond disqus".split()
)
#: Words that name boilerplate on some pages and parts of the story on others.
DOUBTFUL_WORDS = frozenset(
    "more legal popular meta byline follow tags search alert register promotion commercial copyright disclaimer".split()
)
DOUBTFUL, SURE = 1, 2
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
CONTENT_WORDS = frozenset("article content post entry story text main body".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.DOTALL
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    #: (number, tag, judgement) of the open elements, outermost first.
    chain: tuple
    linked: int


@dataclass(frozen=True)
class Weights:
    """Log odds per feature, and the strength of the smoothness edges. Those of :data:`FITTED` are a prior of the fit."""

    article: float = 3.0
    content_words: float = 1.0
    boilerplate: float = -9.0
    doubtful: float = -2.5
    paragraph: float = 1.5
    heading: float = 0.5
    item: float = -0.5
    per_character: float = 0.01
    most_for_length: float = 2.0
    linked: float = -4.0
    offset: float = -0.5
    neighbour: float = 1.2
    sibling: float = 0.6


class Judgement(NamedTuple):
    """What an element says about the text in it."""

    boilerplate: bool  # by its name or role
    worded: int  # by words of class and id: 0, DOUBTFUL or SURE
    content: bool
    content_words: bool
    main: bool
    words: frozenset


def element(tag: str, attributes: str) -> Judgement:
    words: set[str] = set()
    role = ""
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        value = value.strip("\"'").lower()
        if name.lower() == "role":
            role = value
        else:
            words.update(WORD.findall(value))
    main = tag == "main" or role == "main"
    content = main or tag in CONTENT_ELEMENTS or role == "article"
    # Words of a page's outermost elements tell how it is laid out.
    worded = 0
    if tag not in ROOTS:
        sure = words & (COMMENT_WORDS if content else BOILERPLATE_WORDS)
        worded = SURE if sure else DOUBTFUL if not content and words & DOUBTFUL_WORDS else 0
    boilerplate = tag in BOILERPLATE_ELEMENTS or role in BOILERPLATE_ROLES
    return Judgement(boilerplate, worded, content, bool(words & CONTENT_WORDS), main, frozenset(words))


class Reader:
    """Splits a page into blocks, keeping the chain of open elements."""

    def __init__(self, unended: frozenset = frozenset()) -> None:
        self.blocks: list[Block] = []
        self.open: list[tuple] = []  # (number, tag, judgement)
        self.pieces: list[tuple[str, bool]] = []
        self.links = 0
        self.silent = 0
        self.number = 0
        self.known = unended  # silent elements without end tag, from an earlier reading
        self.unended: set[int] = set()
        self.bounded = 0  # open elements that the next flow element closes

    def flush(self) -> None:
        if self.pieces:
            text = " ".join(references.unescape("".join(p for p, _ in self.pieces)).split())
            if text:
                linked = sum(len(p) for p, in_link in self.pieces if in_link)
                self.blocks.append(Block(text, tuple(e for e in self.open if e[1] not in INLINE), linked))
            self.pieces = []

    def pop(self) -> tuple[int, str]:
        number, name, _ = self.open.pop()
        self.links -= name == "a"
        self.silent -= self.is_silent(number, name)
        self.bounded -= self.is_bounded(number, name)
        return number, name

    def is_silent(self, number: int, tag: str) -> bool:
        return tag in SILENT and (number not in self.known or tag in CONTROLS)

    def is_bounded(self, number: int, tag: str) -> bool:
        return tag in OPTIONS or tag in CONTROLS and number in self.known

    def close(self, tag: str) -> None:
        if any(e[1] == tag for e in self.open):
            while True:
                number, name = self.pop()
                if name == tag:
                    break
                self.missed(number, name)

    def missed(self, number: int, tag: str) -> None:
        """An element ends without its end tag."""
        if tag in SILENT and tag != "head" and tag not in OPTIONS:
            self.unended.add(number)

    def end_bounded(self) -> None:
        """Closes all from the outermost element that ends before a flow element."""
        while self.bounded:
            self.missed(*self.pop())

    def end_head(self) -> None:
        if self.open and self.open[-1][1] == "head":
            self.flush()
            self.pop()

    def start(self, tag: str, attributes: str) -> None:
        if tag not in HEAD_ONLY:
            self.end_head()
        if tag == "br":
            self.pieces.append((" ", False))
            return
        if tag not in INLINE:
            self.flush()
            if self.bounded and tag not in VOID and tag not in OPTIONS:
                self.end_bounded()
            ended = AUTO_CLOSED.get(tag) or (AUTO_CLOSED["p"] if tag not in VOID else ())
            for name in ended:
                at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][1] == name), -1)
                limits = ("ul", "ol", "table", "dl", "article", "section", "div", "blockquote", "main", "nav", "aside", "form")
                if at >= 0 and not any(e[1] in limits for e in self.open[at + 1 :]):
                    self.close(name)
        if tag in VOID:
            return
        self.number += 1
        self.open.append((self.number, tag, element(tag, attributes)))
        self.links += tag == "a"
        self.silent += self.is_silent(self.number, tag)
        self.bounded += self.is_bounded(self.number, tag)

    def read(self, page: str) -> list[Block]:
        self.scan(page)
        if self.unended:
            # Only the whole page tells which end tags are missing.
            again = Reader(frozenset(self.unended))
            again.scan(page)
            self.blocks = again.blocks
        clear_wrappers(self.blocks)
        return self.blocks

    def scan(self, page: str) -> None:
        at = 0
        while at < len(page):
            match = TOKEN.search(page, at)
            upto = match.start() if match else len(page)
            if upto > at and self.silent and self.open[-1][1] == "head" and not page[at:upto].isspace():
                self.end_head()
            if upto > at and not self.silent:
                self.pieces.append((page[at:upto], self.links > 0))
            if not match:
                break
            at = match.end()
            tag = (match.group(2) or "").lower()
            if not tag:
                continue
            if match.group(1):
                if tag not in INLINE:
                    self.flush()
                self.close(tag)
            elif tag in RAW:
                if tag not in ("svg", "math"):
                    self.flush()
                end = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            else:
                self.start(tag, match.group(3))
        self.flush()
        while self.open:
            self.missed(*self.pop())


def texts_by_holder(blocks: list[Block], fits: Callable[[str, Judgement], bool]) -> tuple[dict[int, int], dict[int, tuple]]:
    """Of each element that fits and stands in no boilerplate element: the length of the unlinked text that no element
    in between calls boilerplate, each text at its innermost such element; and the elements around it."""
    length: dict[int, int] = {}
    around: dict[int, tuple] = {}
    for block in blocks:
        chain = block.chain
        at = next((i for i in range(len(chain) - 1, -1, -1) if fits(*chain[i][1:]) and not chain[i][2].worded), -1)
        if at < 0 or any(judged.boilerplate for _, _, judged in chain[: at + 1]):
            continue
        inside = not any(judged.boilerplate or judged.worded for _, _, judged in chain[at + 1 :])
        number = chain[at][0]
        around[number] = chain[:at]
        length[number] = length.get(number, 0) + inside * (len(block.text) - block.linked)
    return length, around


def wrappers(blocks: list[Block]) -> set[int]:
    """Elements whose boilerplate words do not speak of the text in them: those around the main element and around the
    content element with most text, and those around other content elements with the same name and words as one of them.
    On a page without text in content elements, elements with content words take their place if all stand in such wrappers."""
    length, around = texts_by_holder(blocks, lambda _, judged: judged.content)
    if not any(length.values()):
        length, around = texts_by_holder(blocks, lambda tag, judged: judged.content_words and tag not in ROOTS)
        if any(not any(e[2].worded for e in chain) for chain in around.values()):
            return set()
    if not length:
        return set()
    first = list(around[max(length, key=length.__getitem__)])
    for block in blocks:
        at = next((i for i in range(len(block.chain) - 1, -1, -1) if block.chain[i][2].main), 0)
        first.extend(block.chain[:at])
    found = {number for number, _, judged in first if judged.worded}
    alike = {(tag, judged.words) for _, tag, judged in first if judged.worded}
    return found | {n for chain in around.values() for n, tag, judged in chain if judged.worded and (tag, judged.words) in alike}


def clear_wrappers(blocks: list[Block]) -> None:
    """Takes the boilerplate words from the :func:`wrappers`."""
    if any(e[2].worded for block in blocks for e in block.chain) and (cleared := wrappers(blocks)):
        for block in blocks:
            block.chain = tuple((n, tag, j._replace(worded=0) if n in cleared else j) for n, tag, j in block.chain)


class Standing(NamedTuple):
    """What the elements around a block say about it."""

    inside: bool  # a content element
    words: bool  # content words
    doubtful: bool
    named: bool  # boilerplate by an element's name or role
    worded: bool  # boilerplate by words


def standing(block: Block) -> Standing:
    inside = words = doubtful = False
    for _, tag, judged in block.chain:
        inside = inside or judged.content
        words = words or judged.content_words
        named = judged.boilerplate or tag == "header" and not inside
        if named or judged.worded == SURE:
            return Standing(inside, words, doubtful, named, judged.worded == SURE)
        doubtful = doubtful or judged.worded == DOUBTFUL
    return Standing(inside, words, doubtful, False, False)


#: Weights that are fitted, in the order of :func:`features`.
FITTED = ("offset", "content_words", "doubtful", "paragraph", "heading", "item", "linked", "per_character")


def features(block: Block, around: Standing, weights: Weights) -> tuple[float, ...]:
    """Values that the weights of :data:`FITTED` multiply."""
    share = min(1.0, block.linked / max(1, len(block.text)))
    tag = block.chain[-1][1] if block.chain else ""
    length = min(weights.most_for_length / Weights.per_character, len(block.text) * (1 - share))
    return (1, around.words, around.doubtful, tag in ("p", "pre", "blockquote"), tag in HEADINGS, tag == "li", share, length)


def odds(block: Block, weights: Weights) -> float:
    """Log odds of content against boilerplate."""
    around = standing(block)
    out = weights.article * around.inside + weights.boilerplate * (around.named or around.worded)
    return out + sum(getattr(weights, name) * x for name, x in zip(FITTED, features(block, around, weights)))


#: Steps in which the fit counts the share of linked text and the length.
STEPS = 10


def cell(block: Block, weights: Weights) -> int | None:
    """Number of a block's features, rounded, and of its label; None if its elements do not tell what it is. Labels come
    from names and roles of elements alone: inside a boilerplate element, or inside a content element and nothing else."""
    around = standing(block)
    if around.worded or not (around.inside or around.named):
        return None
    _, words, doubtful, paragraph, heading, item, share, length = features(block, around, weights)
    most = weights.most_for_length / Weights.per_character
    tag = paragraph + 2 * heading + 3 * item
    out = int(not around.named)
    for value, size in ((words, 2), (doubtful, 2), (tag, 4), (round(share * STEPS), STEPS + 1), (round(length / most * STEPS), STEPS + 1)):
        out = out * size + int(value)
    return out


CELLS = 2 * 2 * 2 * 4 * (STEPS + 1) ** 2


def fitted(counts: np.ndarray, prior: Weights = Weights(), hold: float = 0.25) -> Weights:
    """Logistic regression on the number of blocks per cell; both labels weigh the same. ``hold`` is the strength (per
    block) that draws every weight to the prior, so the fit does not depend on the number of pages. With blocks of one label
    only, the prior."""
    label, words, doubtful, tag, share, length = np.unravel_index(np.arange(CELLS), (2, 2, 2, 4, STEPS + 1, STEPS + 1))
    sums = np.array([counts[label == k].sum() for k in (0, 1)], float)
    if not sums.all():
        return prior
    weight = counts / sums[label] / 2
    # Lengths in the unit of the prior's hundred characters, so that one strength suits all weights.
    scale = np.array([1, 1, 1, 1, 1, 1, 1, 100.0])
    most = prior.most_for_length / Weights.per_character
    x = np.stack([np.ones(CELLS), words, doubtful, tag == 1, tag == 2, tag == 3, share / STEPS, length / STEPS * most / 100], axis=1)
    start = np.array([getattr(prior, name) for name in FITTED]) * scale
    w = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (weight * (p - label)) + hold * (w - start)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + hold * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return replace(prior, **dict(zip(FITTED, (w / scale).tolist())))


def fit(pages: DataFrame, html: str = "html", prior: Weights = Weights(), hold: float = 0.25) -> Weights:
    """:func:`fitted` on the blocks of all pages. A task sends its counts; ``CELLS`` rows at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for block in Reader().read(page or ""):
                    if (at := cell(block, prior)) is not None:
                        counts[at] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], ["cell", "n"])

    counts = np.zeros(CELLS, np.int64)
    parts = pages.select(pages[html].alias("_html")).mapInArrow(run, "cell int, n long")
    for row in parts.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[row["cell"]] = row["n"]
    return fitted(counts, prior, hold)


@dataclass
class Network:
    """Residual capacities in hundredths; edge e and e ^ 1 are each other's reverse."""

    n: int
    head: list[int] = field(default_factory=list)
    room: list[int] = field(default_factory=list)
    out: list[list[int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.out = [[] for _ in range(self.n)]

    def edge(self, a: int, b: int, there: int, back: int = 0) -> None:
        for x, y, room in ((a, b, there), (b, a, back)):
            self.out[x].append(len(self.head))
            self.head.append(y)
            self.room.append(room)

    def levels(self, source: int) -> list[int]:
        level = [-1] * self.n
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in self.out[u]:
                v = self.head[e]
                if self.room[e] and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        return level

    def maximum_flow(self, source: int, sink: int) -> list[int]:
        """Dinic; returns the levels of the last search: the source's side of the cut has one of at least 0."""
        while (level := self.levels(source))[sink] >= 0:
            turn = [0] * self.n
            path: list[int] = []
            u = source
            while True:
                if u == sink:
                    amount = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= amount
                        self.room[e ^ 1] += amount
                    full = next(i for i, e in enumerate(path) if not self.room[e])
                    u = self.head[path[full] ^ 1]
                    del path[full:]
                    continue
                edges = self.out[u]
                while turn[u] < len(edges):
                    e = edges[turn[u]]
                    if self.room[e] and level[self.head[e]] == level[u] + 1:
                        break
                    turn[u] += 1
                if turn[u] < len(edges):
                    path.append(edges[turn[u]])
                    u = self.head[path[-1]]
                elif path:
                    u = self.head[path.pop() ^ 1]
                    turn[u] += 1
                else:
                    break
        return level


def distance(a: tuple, b: tuple) -> int:
    """Elements to leave and to enter on the way from one chain to the other."""
    same = 0
    for x, y in zip(a, b):
        if x[0] != y[0]:
            break
        same += 1
    return len(a) + len(b) - 2 * same


def label(blocks: list[Block], weights: Weights = Weights()) -> list[bool]:
    """Whether each block is content."""
    n = len(blocks)
    if not n:
        return []
    costs = [round(100 * odds(b, weights)) for b in blocks]
    if min(costs) > 0 or max(costs) <= 0:
        return [c > 0 for c in costs]  # one terminal has no edge: nothing flows
    network = Network(n + 2)
    last_of: dict[int, int] = {}
    for i, (block, cost) in enumerate(zip(blocks, costs)):
        if cost > 0:
            network.edge(n, i, cost)
        elif cost < 0:
            network.edge(i, n + 1, -cost)
        if i:
            room = round(100 * weights.neighbour / (1 + distance(blocks[i - 1].chain, block.chain)))
            if room:
                network.edge(i - 1, i, room, room)
        parent = block.chain[-2][0] if len(block.chain) > 1 else 0
        if parent in last_of:
            room = round(100 * weights.sibling)
            network.edge(last_of[parent], i, room, room)
        last_of[parent] = i
    level = network.maximum_flow(n, n + 1)
    return [level[i] >= 0 for i in range(n)]


def main_text(page: str | None, weights: Weights = Weights()) -> str:
    blocks = Reader().read(page or "")
    return "\n".join(b.text for b, content in zip(blocks, label(blocks, weights)) if content)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), weights: Weights = Weights()) -> DataFrame:
    """``keep`` plus text and n_chars of every row."""
    chosen = pages.select(*keep, pages[html].alias("_html"))
    schema = "".join(f"`{n}` {kind}, " for n, kind in chosen.dtypes if n != "_html") + "`text` string, `n_chars` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*keep, "text", "n_chars"],
            )

    return chosen.mapInArrow(run, schema)


def labelled_blocks(pages: DataFrame, html: str = "html", key: str = "page_id", weights: Weights = Weights()) -> DataFrame:
    """Every block of every page: key, block (from 0), text, odds and whether it is content."""
    chosen = pages.select(pages[key].alias("_key"), pages[html].alias("_html"))
    kind = chosen.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, texts, scores, content = [], [], [], [], []
            for i, page in enumerate(batch.column(1).to_pylist()):
                blocks = Reader().read(page or "")
                rows.extend([i] * len(blocks))
                number.extend(range(len(blocks)))
                texts.extend(b.text for b in blocks)
                scores.extend(odds(b, weights) for b in blocks)
                content.extend(label(blocks, weights))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(texts, pa.string()),
                 pa.array(scores, pa.float64()), pa.array(content, pa.bool_())],
                ["_key", "block", "text", "odds", "content"],
            )

    return chosen.mapInArrow(run, f"_key {kind}, block int, text string, odds double, content boolean").withColumnRenamed("_key", key)
