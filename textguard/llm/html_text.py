"""Main text of web pages: a recurrent labeller reads a page's blocks in both directions."""

from __future__ import annotations

import html
import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.llm.common import Columns, append, texts
from textguard.llm.html_samples import sample_pages

#: Elements that start a block of their own.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "iframe label legend li main menu nav noscript ol optgroup option p pre search section select "
    "summary table tbody td template textarea tfoot th thead title tr ul".split()
)
#: Elements without an end, and those whose text is no text of the page.
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style".split())
#: An open element of the left kind ends where one of the right kinds starts.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"},
    "head": {"body"},
}
#: Elements across which nothing is closed by a start.
_WALLS = frozenset("table ul ol dl select article section aside nav body".split())

#: A quote holds a value together only right after "="; any other is a plain character of its tag.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|[^>])*+)>|</?[a-zA-Z][^<>]*(?=<|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


#: What is left where no tag ends any more: comments, and tags cut off by the next or the end.
_REST = re.compile(r"<!--.*|<[!?][^>]*|</?[a-zA-Z][^<>]*", re.DOTALL)
_OPENING = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[a-zA-Z]", re.DOTALL)
_NAME_END = re.compile(r"[\s/>]")
_EVENT = re.compile(r"=\s*([\"'])|>")
_CUT_OFF = re.compile(r"</?[a-zA-Z][^<>]*")


class _Careful:
    """Tokens as ``_TOKEN`` finds them, in time linear in a page whose tags do not end.

    Where the search for a tag's end came to nothing, any later one that reaches one of the places
    it passed outside of quotes comes to nothing as well. Such stretches are remembered, so each
    place is looked at a fixed number of times.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.name_end = 0

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start, end, slash, name and attributes of the next token from ``at`` on."""
        page = self.page
        while opening := _OPENING.search(page, at):
            start = opening.start()
            if page[start + 1] in "!?":
                return start, opening.end(), "", "", ""
            if self.name_end < opening.end():
                found = _NAME_END.search(page, opening.end())
                self.name_end = found.start() if found else len(page)
            end = self._end(self.name_end)
            if end >= 0:
                slash = "/" if page[start + 1] == "/" else ""
                name = page[start + 1 + len(slash) : self.name_end]
                return start, end + 1, slash, name, page[self.name_end : end]
            cut = _CUT_OFF.match(page, start).end()
            if cut == len(page) or page[cut] == "<":
                return start, cut, "", "", ""
            at = start + 1
        return None

    def _end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` ends, or -1."""
        page, tried = self.page, []
        while at <= self.last[">"]:
            i = bisect_right(self.starts, at) - 1
            if i >= 0 and at <= self.ends[i]:
                break
            stop = self.starts[i + 1] if i + 1 < len(self.starts) else len(page) + 1
            event = _EVENT.search(page, at)
            while event and event[1] and event.end() > self.last[event[1]]:
                event = _EVENT.search(page, event.start() + 1)  # a quote that nothing ends
            if event is None or event.start() >= stop:
                tried.append((at, stop - 1 if event else len(page)))
                break
            if not event[1]:
                return event.start()
            tried.append((at, event.start()))
            at = page.index(event[1], event.end()) + 1
        for start, end in tried:
            i = bisect_right(self.starts, start)
            self.starts.insert(i, start)
            self.ends.insert(i, end)
        return -1


class _Stack:
    """The open elements, with what a block's path asks of them kept up to date."""

    def __init__(self) -> None:
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.at: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.blocks: list[int] = []
        self.words: dict[str, int] = {}
        self.buckets: dict[int, int] = {}

    def push(self, name: str, words: tuple[str, ...]) -> None:
        here = len(self.open)
        self.open.append((name, words))
        self.at.setdefault(name, []).append(here)
        if name in _WALLS:
            self.walls.append(here)
        if name in BLOCKS:
            self.blocks.append(here)
        for word in words:
            n = self.words[word] = self.words.get(word, 0) + 1
            if n == 1:
                bucket = _bucket(word)
                self.buckets[bucket] = self.buckets.get(bucket, 0) + 1

    def cut(self, depth: int) -> None:
        while len(self.open) > depth:
            name, words = self.open.pop()
            self.at[name].pop()
            if name in _WALLS:
                self.walls.pop()
            if name in BLOCKS:
                self.blocks.pop()
            for word in words:
                self.words[word] -= 1
                if not self.words[word]:
                    del self.words[word]
                    bucket = _bucket(word)
                    self.buckets[bucket] -= 1
                    if not self.buckets[bucket]:
                        del self.buckets[bucket]

    def top(self, names: Iterable[str]) -> int:
        """The place of the innermost open element of these, or -1."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def links(self) -> int:
        return len(self.at.get("a", ()))

    def last(self) -> list[str]:
        """The last three words of the path."""
        words: list[str] = []
        for _, more in reversed(self.open[-3:]):
            words[:0] = more
        return words[-3:]


#: For each element that starts, the open ones that it may end.
_ENDED_BY = {
    name: ("p", *(left for left, rights in _CLOSES.items() if name in rights)) for name in BLOCKS
}


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str, float]]:
    """The leaf blocks of a page in order: tag path, text, share of its characters in links.

    The path has the names of the open elements and the words of their class, id and role. Text
    has its references decoded and its white space folded; blocks without text are left out.
    Comments, scripts and styles are no text. Markup may be broken anywhere.
    """
    for stack, text, linked in _leaves(page):
        yield tuple(t for _, names in stack.open for t in names), text, linked


def _tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start, end, slash, name and attributes of each token; the caller sends where to go on."""
    at, careful = 0, None
    while True:
        if careful is None:
            token = _TOKEN.search(page, at)
            if token is None:
                return
            found = (token.start(), token.end(), token[1] or "", token[2] or "", token[3] or "")
            if not found[3] and page[found[0] + 1] not in "!?":
                careful = _Careful(page)  # a tag without an end; looking for more would add up
        else:
            found = careful.next(at)
            if found is None:
                return
        at = yield found


def _leaves(page: str) -> Iterator[tuple[_Stack, str, float]]:
    """As ``blocks``, but with the stack itself, as it is at that moment."""
    stack = _Stack()
    parts: list[str] = []
    linked = 0
    raw_ends = {name: True for name in RAW}

    def flush() -> Iterator[tuple[_Stack, str, float]]:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                yield stack, text, min(1.0, linked / max(1, len(text)))
            parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if stack.links():
            linked += len(piece.strip())

    at, n = 0, len(page)
    last_end = page.rfind(">")
    tokens = _tokens(page)
    token = next(tokens, None)
    while at < n:
        if token is None:
            add(page[at:])
            break
        start, end, slash, name, attributes = token
        if start > at:
            add(page[at:start])
        at, name = end, name.lower()
        if name:
            block = name in BLOCKS
            if slash:
                if block:
                    yield from flush()
                depth = stack.top((name,))
                if depth >= 0 and (block or not stack.blocks or stack.blocks[-1] < depth):
                    stack.cut(depth)
            elif name in RAW:
                found = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(page, at) if raw_ends[name] else None
                raw_ends[name] = found is not None
                at = found.end() if found else n
            else:
                if block:
                    yield from flush()
                    ended = stack.top(_ENDED_BY[name])
                    if ended >= 0 and (not stack.walls or ended >= stack.walls[-1]):
                        stack.cut(ended)
                if name in EMPTY:
                    parts.append(" ")
                else:
                    words = [w.lower() for m in _NAMES.finditer(attributes) for w in _PART.findall(m[1] or m[2] or m[3] or "")]
                    stack.push(name, (name, *(f".{w}" for w in words)))
        if at > last_end:  # no tag ends any more
            add(_REST.sub("", page[at:]))
            break
        try:
            token = tokens.send(at)
        except StopIteration:
            token = None
    yield from flush()


#: Buckets of path and word vectors, their sizes, and the units of each direction.
PATHS, WORDS, PATH_SIZE, WORD_SIZE, UNITS = 512, 512, 16, 6, 16
INPUT = PATH_SIZE + WORD_SIZE + 3
#: Blocks that are read at once in a worker, padding included.
PADDED = 1 << 16


@dataclass
class Page:
    """Blocks as the network reads them: buckets of all paths and words, and how many each has."""

    paths: np.ndarray = field(default_factory=lambda: np.empty(0, int))
    path_counts: np.ndarray = field(default_factory=lambda: np.empty(0, int))
    path_weights: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))
    words: np.ndarray = field(default_factory=lambda: np.empty(0, int))
    word_counts: np.ndarray = field(default_factory=lambda: np.empty(0, int))
    numbers: np.ndarray = field(default_factory=lambda: np.empty((0, 3), np.float32))


@dataclass
class Labeller:
    """Weights of the network; ``probabilities`` reads pages."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        one = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        made = {"paths": rng.standard_normal((PATHS, PATH_SIZE)).astype(np.float32) * 0.3,
                "words": rng.standard_normal((WORDS, WORD_SIZE)).astype(np.float32) * 0.3,
                "out": one(2 * UNITS), "out_bias": np.zeros(1, np.float32)}
        for way in ("ahead", "back"):
            made |= {f"{way}_x": one(INPUT, 4 * UNITS), f"{way}_h": one(UNITS, 4 * UNITS)}
            bias = np.zeros(4 * UNITS, np.float32)
            bias[UNITS : 2 * UNITS] = 1
            made[f"{way}_b"] = bias
        return cls(made)

    def inputs(self, page: Page) -> np.ndarray:
        """A row for each block."""
        rows = np.empty((len(page.numbers), INPUT), np.float32)
        rows[:, :PATH_SIZE] = _sums(self.weights["paths"], page.paths, page.path_counts, page.path_weights)
        counts = page.word_counts
        rows[:, PATH_SIZE:-3] = _sums(self.weights["words"], page.words, counts) / np.maximum(counts, 1)[:, None]
        rows[:, -3:] = page.numbers
        return rows

    def run(self, x: np.ndarray, there: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """States of one direction for (step, page, input), and what the gradient needs."""
        w = self.weights
        steps, pages = there.shape
        z_x = x @ w[f"{way}_x"] + w[f"{way}_b"]
        h = np.zeros((pages, UNITS), np.float32)
        c = np.zeros_like(h)
        out, kept = np.zeros((steps, pages, UNITS), np.float32), []
        for t in range(steps) if way == "ahead" else range(steps - 1, -1, -1):
            z = z_x[t] + h @ w[f"{way}_h"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * UNITS]))
            i, f, o = gates[:, :UNITS], gates[:, UNITS : 2 * UNITS], gates[:, 2 * UNITS :]
            g = np.tanh(z[:, 3 * UNITS :])
            live = there[t][:, None]
            c_new = np.where(live, f * c + i * g, c)
            squashed = np.tanh(c_new)
            h_new = np.where(live, o * squashed, h)
            kept.append((t, h, c, i, f, o, g, squashed))
            h, c = h_new, c_new
            out[t] = h
        return out, kept

    def probabilities(self, pages: list[Page]) -> list[np.ndarray]:
        """Of each block of each page, the probability that it is main text."""
        sizes = [len(page.numbers) for page in pages]
        order = sorted(range(len(pages)), key=sizes.__getitem__)
        found: list[np.ndarray] = [np.empty(0)] * len(pages)
        group: list[int] = []
        for i in [*order, None]:
            if group and (i is None or (len(group) + 1) * sizes[i] > PADDED):
                x, there = self.padded([pages[j] for j in group])
                p = self.forward(x, there)[0]
                for column, j in enumerate(group):
                    found[j] = p[: sizes[j], column]
                group = []
            if i is not None and sizes[i]:
                group.append(i)
        return found

    def padded(self, pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
        longest = max(len(page.numbers) for page in pages)
        x = np.zeros((longest, len(pages), INPUT), np.float32)
        there = np.zeros((longest, len(pages)), bool)
        for column, page in enumerate(pages):
            x[: len(page.numbers), column] = self.inputs(page)
            there[: len(page.numbers), column] = True
        return x, there

    def forward(self, x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, list]:
        ahead, kept_a = self.run(x, there, "ahead")
        back, kept_b = self.run(x, there, "back")
        both = np.concatenate((ahead, back), 2)
        z = both @ self.weights["out"] + self.weights["out_bias"][0]
        return 1 / (1 + np.exp(-z)), both, kept_a, kept_b


def encoded(page: str) -> tuple[Page, list[str]]:
    """What the network reads of a page's blocks, and their texts."""
    made, found = Page(), []
    paths, weights, words, path_counts, word_counts, numbers = [], [], [], [], [], []
    for stack, text, linked in _leaves(page):
        last = stack.last()
        paths += stack.buckets
        weights += stack.buckets.values()
        paths += (_bucket(f"{t}/{len(last) - i}") for i, t in enumerate(last))
        weights += [1] * len(last)
        path_counts.append(len(stack.buckets) + len(last))
        split = text.lower().split()
        words += map(_BUCKETS.__getitem__, split)
        word_counts.append(len(split))
        head = bool(last) and last[-1] in ("h1", "h2", "h3")
        numbers.append((math.log1p(len(text)) / 4, linked, head))
        found.append(text)
    made.paths, made.words = np.array(paths, int), np.array(words, int)
    made.path_weights = np.array(weights, np.float32)
    made.path_counts, made.word_counts = np.array(path_counts, int), np.array(word_counts, int)
    made.numbers = np.array(numbers, np.float32).reshape(-1, 3)
    return made, found


class _Buckets(dict):
    """Buckets of words, remembered up to a number of words; which bounds memory alone."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        bucket = self[word] = zlib.crc32(word.encode()) % WORDS
        return bucket


_BUCKETS = _Buckets()


@lru_cache(maxsize=20_000)
def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % PATHS


def _sums(vectors: np.ndarray, flat: np.ndarray, counts: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Sums of consecutive runs of vectors, weighted; runs may be empty."""
    out = np.zeros((len(counts), vectors.shape[1]), np.float32)
    some = counts > 0
    if some.any():
        starts = (np.cumsum(counts) - counts)[some]
        rows = vectors[flat] if weights is None else vectors[flat] * weights[:, None]
        out[some] = np.add.reduceat(rows, starts, axis=0)
    return out


@lru_cache(maxsize=2)
def train(seed: int = 7, pages: int = 500, rounds: int = 8, rate: float = 0.01, batch: int = 25) -> Labeller:
    """A network trained on generated pages, whose blocks are known to be main text or not.

    Back-propagation through time with Adam; the same arguments give the same network.
    """
    model = Labeller.fresh(seed)
    samples = []
    for page, main in sample_pages(seed, pages):
        rows, found = encoded(page)
        samples.append((rows, np.array([t in main for t in found], np.float32)))
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), batch):
            group = [samples[i] for i in order[at : at + batch]]
            slopes = _gradient(model, group)
            step += 1
            for k, g in slopes.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                size = np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8
                model.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / size
    return model


def _gradient(model: Labeller, group: list[tuple]) -> dict[str, np.ndarray]:
    """Slopes of the mean log loss over the blocks of a group of pages."""
    w = model.weights
    x, there = model.padded([rows for rows, _ in group])
    p, both, kept_a, kept_b = model.forward(x, there)
    truth = np.zeros_like(p)
    for column, (_, y) in enumerate(group):
        truth[: len(y), column] = y
    miss = (p - truth) * there / there.sum()
    slopes = {"out": np.einsum("tp,tpu->u", miss, both), "out_bias": np.array([miss.sum()], np.float32)}
    to_states = miss[:, :, None] * w["out"]
    to_x = np.zeros_like(x)
    for way, kept, d_out in (("ahead", kept_a, to_states[..., :UNITS]), ("back", kept_b, to_states[..., UNITS:])):
        d_wx, d_wh, d_b = (np.zeros_like(w[f"{way}_{k}"]) for k in "xhb")
        d_h = np.zeros((x.shape[1], UNITS), np.float32)
        d_c = np.zeros_like(d_h)
        for t, h, c, i, f, o, g, squashed in reversed(kept):
            live = there[t][:, None]
            d_h = d_h + d_out[t]
            d_new_c = d_c + d_h * o * (1 - squashed**2)
            d_z = np.concatenate(
                (d_new_c * g * i * (1 - i), d_new_c * c * f * (1 - f), d_h * squashed * o * (1 - o), d_new_c * i * (1 - g * g)), 1
            ) * live
            d_wx += x[t].T @ d_z
            d_wh += h.T @ d_z
            d_b += d_z.sum(0)
            to_x[t] += d_z @ w[f"{way}_x"].T
            d_h = np.where(live, d_z @ w[f"{way}_h"].T, d_h)
            d_c = np.where(live, d_new_c * f, d_c)
        slopes |= {f"{way}_x": d_wx, f"{way}_h": d_wh, f"{way}_b": d_b}
    d_paths, d_words = np.zeros_like(w["paths"]), np.zeros_like(w["words"])
    for column, (page, _) in enumerate(group):
        slope = to_x[: len(page.numbers), column]
        each = np.repeat(slope[:, :PATH_SIZE], page.path_counts, axis=0)
        np.add.at(d_paths, page.paths, each * page.path_weights[:, None])
        share = slope[:, PATH_SIZE:-3] / np.maximum(page.word_counts, 1)[:, None]
        np.add.at(d_words, page.words, np.repeat(share, page.word_counts, axis=0))
    return slopes | {"paths": d_paths, "words": d_words}


def main_text(frame: DataFrame, model: Labeller, body: str = "html", out: str = "text") -> DataFrame:
    """The frame with the main text of each whole page, blocks joined by an empty line.

    Each block is labelled by the network from the blocks before and after it. A null or empty
    page, or one without main text, gives the empty text. Repeated rows give repeated texts; a
    column named as ``out`` is replaced.
    """

    def make() -> Callable[[pa.RecordBatch], Columns]:
        def columns(batch: pa.RecordBatch) -> Columns:
            made: list[str] = []
            pages = texts(batch, body)
            for at in range(0, len(pages), 500):
                rows, found = zip(*map(encoded, pages[at : at + 500]), strict=True)
                for p, t in zip(model.probabilities(list(rows)), found, strict=True):
                    made.append("\n\n".join(text for text, chance in zip(t, p, strict=True) if chance >= 0.5))
            return {out: pa.array(made, pa.string())}

        return columns

    return append(frame, make, [T.StructField(out, T.StringType())])


def with_length(frame: DataFrame, text: str = "text") -> DataFrame:
    return frame.withColumn("n_chars", F.char_length(text).cast("long"))
