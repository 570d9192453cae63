"""Main text of web pages, by a linear-chain conditional random field over leaf blocks.

A page is cut into its leaf blocks: runs of text between tags that begin or end a
block. Ancestor tags, words of their class and id attributes, and simple facts of
the text are a block's features; the field's two labels are main text and the rest.
Weights come from labelled pages by maximum likelihood (html_pages), labels of a
page by Viterbi's algorithm.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements whose text isn't shown as text, those that are raw, those that stand in a line, those without an end tag.
HIDDEN = frozenset("head script style template title textarea select option button svg math iframe object noscript canvas audio video datalist".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the key is closed by one of these.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul td th tr dd dt".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]), "head": frozenset(["body"]),
}
#: What a search for an element to close doesn't look beyond.
SCOPES = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "p": frozenset("article aside blockquote body div figure footer form header li main nav section table td th".split())}

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[a-z]+")


class Place:
    """A chain of open block elements. fresh has the features that no element above gave; above is the chain without the last element."""

    __slots__ = ("above", "tag", "depth", "fresh", "below")

    def __init__(self, above: Place | None, tag: str, fresh: tuple[str, ...]):
        self.above, self.tag, self.fresh, self.below = above, tag, fresh, {}
        self.depth = 0 if above is None else above.depth + 1

    def features(self) -> tuple[str, ...]:
        out, at = [], self
        while at is not None:
            out.extend(at.fresh)
            at = at.above
        return (*sorted(out), *self.own())

    def own(self) -> tuple[str, str]:
        return f"own:{self.tag}", f"depth:{min(self.depth, 8)}"


@dataclass
class Block:
    text: str
    path: Place
    linked: int


class _Places:
    """Chains that pages share, let go when there are many."""

    most = 50_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.root, self.n = Place(None, "", ()), 0


_places = _Places()
#: The elements whose end a tag may be.
ENDS = {tag: [k for k, by in CLOSED_BY.items() if tag in by] for by in CLOSED_BY.values() for tag in by}


def _words(attributes: str) -> frozenset[str]:
    return frozenset(w for m in _NAMES.finditer(attributes) for w in _PART.findall(m[1].lower()))


@lru_cache(maxsize=4096)
def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    """Features of a tag and of the words of its class, id and role."""
    return (f"in:{tag}", *(f"class:{w}" for w in sorted(_words(attributes)))) if "=" in attributes else (f"in:{tag}",)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in their order, white space inside each made single spaces.

    Time and memory grow with the page's length: a block holds the chain of its elements, not a copy."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], Place]] = []
    texts: list[str] = []
    n_open: defaultdict[str, int] = defaultdict(int)  # by tag, and by feature of the open block elements
    if _places.n > _places.most:
        _places.clear()
    state = {"linked": 0, "hidden": 0, "links": 0}
    page = page or ""

    def end_block() -> None:
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                out.append(Block(text, stack[-1][2] if stack else _places.root, state["linked"]))
            texts.clear()
        state["linked"] = 0

    def pop_to(depth: int) -> None:
        if any(t not in INLINE for t, _, _ in stack[depth:]):
            end_block()
        for tag, marks, _ in stack[depth:]:
            state["hidden"] -= tag in HIDDEN
            state["links"] -= tag == "a"
            n_open[tag] -= 1
            for f in marks:
                n_open[f] -= 1
        del stack[depth:]

    def push(tag: str, attributes: str) -> None:
        above, marks = stack[-1][2] if stack else _places.root, ()
        if tag not in INLINE:
            marks = _marks(tag, attributes)
            place = above.below.get(marks)
            if place is None:
                place = above.below[marks] = Place(above, tag, tuple(f for f in marks if not n_open[f]))
                _places.n += 1
            above = place
            for f in marks:
                n_open[f] += 1
        stack.append((tag, marks, above))
        n_open[tag] += 1
        state["hidden"] += tag in HIDDEN
        state["links"] += tag == "a"

    def put(raw: str) -> None:
        if raw and not state["hidden"]:
            text = html_lib.unescape(raw) if "&" in raw else raw
            texts.append(text)
            if state["links"]:
                state["linked"] += len(text)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = None
            if n_open[tag]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        depth = k
                        break
                    if tag in INLINE and stack[k][0] not in INLINE:
                        break
            if depth is not None:
                pop_to(depth)
            elif tag not in INLINE:
                end_block()
            continue
        if tag in VOID:
            if tag == "br":
                put("\n")
            elif tag == "hr":
                end_block()
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            if tag not in HIDDEN:
                put(page[at : close.start() if close else n])
            if close:
                end = page.find(">", close.end())
                at = n if end < 0 else end + 1
            else:
                at = n
            continue
        if m[3].endswith("/>") and tag in ("svg", "math", "path"):
            continue
        for depth in range(len(stack) - 1, -1, -1) if any(n_open[t] for t in ENDS.get(tag, ())) else ():
            open_tag = stack[depth][0]
            if tag in CLOSED_BY.get(open_tag, ()):
                pop_to(depth)
                if open_tag not in ("td", "th", "dt", "dd"):
                    break
            elif open_tag not in INLINE and open_tag in SCOPES["p"]:
                break
        if tag not in INLINE:
            end_block()
            if stack and stack[-1][0] == "head" and tag not in HIDDEN:
                pop_to(len(stack) - 1)
        push(tag, m[3])
    end_block()
    return out


def _bucket(n: int) -> int:
    return 0 if n < 2 else min(n.bit_length() - 1, 8)


def text_features(block: Block, place: int, n_blocks: int) -> tuple[str, ...]:
    text = block.text
    words = text.count(" ") + 1
    share = block.linked / max(len(text), 1)
    return (
        f"words:{_bucket(words)}", "links:all" if share > 0.8 else "links:some" if share > 0.2 else "links:none",
        f"end:{'stop' if text[-1] in '.!?…\"”’' else 'comma' if text[-1] in ',;:' else 'no'}",
        "mark:copyright" if "©" in text else "mark:no", f"place:{'first' if place == 0 else 'last' if place == n_blocks - 1 else 'mid'}",
    )


def features(page_blocks: list[Block]) -> list[tuple[str, ...]]:
    n = len(page_blocks)
    return [b.path.features() + text_features(b, k, n) for k, b in enumerate(page_blocks)]


@dataclass
class Field:
    """Weights: feature -> what it adds to 'main' over 'rest'; moves[i][j]: from label i to j (1 is main); start."""

    weights: dict[str, float]
    base: float
    moves: tuple[tuple[float, float], tuple[float, float]]
    start: float

    def __post_init__(self):
        self.by_place: dict[Place, float] = {}

    def __getstate__(self):
        return (self.weights, self.base, self.moves, self.start)

    def __setstate__(self, state):
        self.weights, self.base, self.moves, self.start = state
        self.by_place = {}

    def of_place(self, place: Place) -> float:
        """What the features of a chain add but its own tag and depth, by what its upper part adds."""
        chain, get = [], self.weights.get
        while place is not None and place not in self.by_place:
            chain.append(place)
            place = place.above
        known = 0.0 if place is None else self.by_place[place]
        for place in reversed(chain):
            known += sum(get(f, 0.0) for f in place.fresh)
            self.by_place[place] = known
        return known

    def emissions(self, page_blocks: list[Block]) -> list[float]:
        get, n = self.weights.get, len(page_blocks)
        if len(self.by_place) > _places.most:
            self.by_place.clear()
        return [self.base + self.of_place(b.path) + sum(get(f, 0.0) for f in (*b.path.own(), *text_features(b, k, n))) for k, b in enumerate(page_blocks)]

    def decode(self, page_blocks: list[Block]) -> list[bool]:
        """Viterbi's best labels."""
        (rr, rm), (mr, mm) = self.moves
        back: list[tuple[bool, bool]] = []
        rest = main = 0.0
        for k, e in enumerate(self.emissions(page_blocks)):
            if not k:
                rest, main = 0.0, e + self.start
                continue
            from_main = (main + mr > rest + rr, main + mm > rest + rm)
            rest, main = (main + mr if from_main[0] else rest + rr), (main + mm if from_main[1] else rest + rm) + e
            back.append(from_main)
        labels = [main > rest] if page_blocks else []
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def extract(self, page: str | None) -> str:
        found = blocks(page)
        return " ".join(b.text for b, keep in zip(found, self.decode(found)) if keep)


def likelihood(theta: np.ndarray, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray]:
    """Log likelihood of the labels y and its gradient, by the forward-backward recursion.

    theta: weights, one that stays 0, base, start, four moves. x: pages by blocks by
    places of features in theta. real: whether a page has such a block."""
    (n, longest, width), nothing = x.shape, len(theta) - 7
    w, base, start, moves = theta[: nothing + 1], theta[-6], theta[-5], theta[-4:].reshape(2, 2)
    e = np.stack([np.zeros((n, longest)), w[x].sum(2) + base], 2)
    e[:, 0, 1] += start
    ahead = np.zeros((n, longest, 2))
    ahead[:, 0] = e[:, 0]
    for k in range(1, longest):
        ahead[:, k] = np.where(real[:, k, None], np.logaddexp.reduce(ahead[:, k - 1, :, None] + moves, axis=1) + e[:, k], ahead[:, k - 1])
    total = np.logaddexp.reduce(ahead[:, -1], axis=1)
    behind, pair = np.zeros((n, longest, 2)), np.zeros((2, 2))
    for k in range(longest - 2, -1, -1):
        go = moves + (e[:, k + 1] + behind[:, k + 1])[:, None, :]
        behind[:, k] = np.where(real[:, k + 1, None], np.logaddexp.reduce(go, axis=2), behind[:, k + 1])
        pair += (np.exp(ahead[:, k, :, None] + go - total[:, None, None]) * real[:, k + 1, None, None]).sum(0)
    d = (y - np.exp(ahead[..., 1] + behind[..., 1] - total[:, None])) * real
    both = real[:, 1:]
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)])
    g = np.zeros_like(theta)
    np.add.at(g, x.ravel(), np.repeat(d.ravel(), width))
    g[nothing] = 0
    g[-6], g[-5] = d.sum(), d[:, 0].sum()
    g[-4:] = (seen - pair).ravel()
    said = (e[..., 1] * y * real).sum() + (seen * moves).sum()
    return float(said - total.sum()), g


def train(pages, rounds: int = 150, rate: float = 0.15, shrink: float = 1e-3) -> Field:
    """The field of greatest likelihood (with a ridge) for pages, pairs of HTML and the words of their main text.

    All pages go through the forward-backward recursion side by side; Adam climbs the gradient."""
    names: dict[str, int] = {}
    rows, labels = [], []
    for page, main in pages:
        found = blocks(page)
        if found:
            rows.append([[names.setdefault(f, len(names)) for f in fs] for fs in features(found)])
            labels.append([sum(w.rstrip(".?!") in main for w in b.text.split()) * 2 > len(b.text.split()) for b in found])
    n, longest, width = len(rows), max(map(len, rows)), max(len(f) for r in rows for f in r)
    x = np.full((n, longest, width), len(names))  # the last weight stays 0
    y, real = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (r, ls) in enumerate(zip(rows, labels)):
        for k, f in enumerate(r):
            x[i, k, : len(f)] = f
        y[i, : len(ls)], real[i, : len(ls)] = ls, True
    theta = np.zeros(len(names) + 1 + 6)
    m = v = np.zeros_like(theta)
    for step in range(1, rounds + 1):
        g = likelihood(theta, x, y, real)[1] / -n + shrink * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    moves = theta[-4:].reshape(2, 2)
    return Field({f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 1e-6}, float(theta[-6]), tuple(tuple(map(float, r)) for r in moves), float(theta[-5]))


@lru_cache(maxsize=1)
def default_field() -> Field:
    from starling.llm.html_pages import labelled_pages

    return train(labelled_pages())


def extract_text(pages: DataFrame, model: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    A null or empty html, or one without main text, gives an empty text. Repeated
    rows are each extracted, an empty table gives none, and columns beyond the
    three named are ignored."""
    model = model or default_field()

    @F.arrow_udf("text string, n_chars long")
    def extract(html: pa.Array) -> pa.Array:
        texts = [model.extract(x.as_py()) for x in html]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["text", "n_chars"])

    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extract(F.col(html_col)).alias("r"))
    return found.select("page_id", "url", "r.*")
