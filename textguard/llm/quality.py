"""Quality rules by line labels: a linear-chain conditional random field marks content lines."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.llm.common import Columns, append, one_text_each, texts

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: The base rule: fewer words, or a larger share of repeated words in per cent, fails.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Least share of words in content lines of a document that is kept.
CONTENT_SHARE = 0.5
#: Labelled documents the model is fitted on, and the longest of them in bytes.
SAMPLE, SAMPLE_BYTES, SAMPLE_LINES = 1500, 100_000, 5000
#: Lines of a chain that is trained on, and of each of the three parts of a glued one.
CHAIN, GLUED = 64, 21

FEATURES = (
    "one", "log_words", "no_words", "few_words", "symbols", "capitals", "marks", "distinct",
    "seen_before", "sentence_end", "word_length", "digits",
)


@dataclass
class Crf:
    """Weights of a chain of two labels, boilerplate 0 and content 1."""

    emit: np.ndarray = field(default_factory=lambda: np.zeros((2, len(FEATURES))))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def viterbi(self, lines: np.ndarray) -> list[int]:
        """The best labels of a document's lines; ties go to content."""
        scores = (lines @ self.emit.T).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        back = []
        a, b = 0.0, 0.0
        for i, (e0, e1) in enumerate(scores):
            if i == 0:
                a, b = self.start[0] + e0, self.start[1] + e1
                continue
            to0, to1 = int(b + s10 >= a + s00), int(b + s11 >= a + s01)
            back.append((to0, to1))
            a, b = (b + s10 if to0 else a + s00) + e0, (b + s11 if to1 else a + s01) + e1
        if not scores:
            return []
        labels = [int(b >= a)]
        for pointers in reversed(back):
            labels.append(pointers[labels[-1]])
        return labels[::-1]


def line_features(lines: list[str]) -> np.ndarray:
    """A row of features for each line of a document."""
    rows, seen = [], set()
    for line in lines:
        words = line.split()
        n = len(words)
        if not n:
            rows.append((1.0, 0, 1.0, 1.0, 0, 0, 0, 1.0, 0, 0, 0, 0))
            continue
        symbols = sum(map(line.count, SYMBOLS))
        rows.append(
            (
                1.0,
                math.log1p(n) / 4,
                0.0,
                float(n < 4),
                min(1.0, symbols / n),
                float(line == line.upper() and line != line.lower()),
                min(1.0, line.count("!") / n),
                len(set(words)) / n,
                float(line in seen),
                float(line.rstrip()[-1] in ".?!:;\"'…。"),
                min(2.0, len(line) / n / 8),
                min(1.0, sum(w[0].isdigit() for w in words) / n),
            )
        )
        seen.add(line)
    return np.array(rows, float).reshape(-1, len(FEATURES))


def glued(documents: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chains of three parts of documents whose labels alternate, with the label of each line.

    A document is glued between two of the other label, its first lines after the last ones of
    the one before; each document of the rarer label comes up in two chains.
    """
    by = [[x for x, label in documents if label == which and len(x)] for which in (0, 1)]
    rarer = min(by, key=len)
    chains = []
    for i in range(len(rarer) if all(by) else 0):
        for middle in (0, 1):
            inner = by[middle][i % len(by[middle])]
            before, after = (by[1 - middle][(2 * i + k) % len(by[1 - middle])] for k in (0, 1))
            parts = before[-GLUED:], inner[:GLUED], after[:GLUED]
            labels = [[label] * len(part) for label, part in zip((1 - middle, middle, 1 - middle), parts, strict=True)]
            chains.append((np.concatenate(parts), np.concatenate(labels).astype(int)))
    return chains


def train(documents: list[tuple[np.ndarray, int]], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Crf:
    """Fits by gradient ascent on the likelihood of line labels; the same input fits the same.

    A document's label stands for each of its lines. Where labels change between lines is learned
    from glued documents. Without documents of both labels all lines are content.
    """
    if len({label for _, label in documents}) < 2:
        return Crf()
    chains = [(x[i : i + CHAIN], np.full(len(x[i : i + CHAIN]), y)) for x, y in documents for i in range(0, len(x), CHAIN)]
    chains += glued(documents)
    longest = max(len(x) for x, _ in chains)
    n = len(chains)
    x, y = np.zeros((n, longest, len(FEATURES))), np.zeros((n, longest), int)
    size = np.array([len(c) for c, _ in chains])
    for i, (c, labels) in enumerate(chains):
        x[i, : len(c)], y[i, : len(c)] = c, labels
    there = np.arange(longest) < size[:, None]
    # Chains of either label and of both weigh the same, and each chain of a kind as one.
    kind = np.array([3 if len(set(labels)) > 1 else labels[0] for _, labels in chains])
    kinds, place, counts = np.unique(kind, return_inverse=True, return_counts=True)
    share = 1 / len(kinds) / counts[place] / size
    truth = np.eye(2)[y] * there[:, :, None]
    seen = np.zeros((2, 2))
    for a, b in np.ndindex(2, 2):
        moves = (y[:, :-1] == a) & (y[:, 1:] == b) & there[:, 1:]
        seen[a, b] = (moves * share[:, None]).sum()
    model = Crf()
    parameters = [model.emit, model.step, model.start]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for round_ in range(1, rounds + 1):
        score = x @ model.emit.T
        ahead = np.empty((longest, n, 2))
        ahead[0] = model.start + score[:, 0]
        for t in range(1, longest):
            move = _logsum(ahead[t - 1][:, :, None] + model.step, 1) + score[:, t]
            ahead[t] = np.where(there[:, t, None], move, ahead[t - 1])
        total = _logsum(ahead[-1], 1)
        behind = np.zeros((longest, n, 2))
        for t in range(longest - 2, -1, -1):
            move = _logsum(model.step + (score[:, t + 1] + behind[t + 1])[:, None, :], 2)
            behind[t] = np.where(there[:, t + 1, None], move, 0.0)
        chance = np.exp(ahead + behind - total[None, :, None]).transpose(1, 0, 2) * there[:, :, None]
        miss = (truth - chance) * share[:, None, None]
        steps = seen.copy()
        for t in range(1, longest):
            both = ahead[t - 1][:, :, None] + model.step + (score[:, t] + behind[t])[:, None, :]
            live = share * there[:, t]
            steps -= (np.exp(both - total[:, None, None]) * live[:, None, None]).sum(0)
        slopes = [
            np.einsum("ntl,ntf->lf", miss, x) - decay * model.emit,
            steps - decay * model.step,
            miss[:, 0].sum(0) - decay * model.start,
        ]
        for p, g, m, v in zip(parameters, slopes, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**round_)) / (np.sqrt(v / (1 - 0.99**round_)) + 1e-8)
    return model


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Crf:
    """A model fitted on at most ``sample`` labelled documents.

    Those of over ``SAMPLE_BYTES`` bytes or ``SAMPLE_LINES`` lines teach nothing; of documents with
    the same id the one whose text has the least hash does.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``quality`` (0 or 1). The
    sample has the smallest hashes of doc_id, so it does not depend on how tables are stored.
    Features are made where the texts are; only they come to the driver.
    """
    chosen = (
        labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    sampled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sampled = sampled.filter(F.octet_length("text").between(1, SAMPLE_BYTES))
    sampled = sampled.filter(F.length(F.regexp_replace("text", "[^\n]+", "")) < SAMPLE_LINES)
    sampled = one_text_each(sampled, "quality")

    def make() -> Callable[[pa.RecordBatch], Columns]:
        return lambda batch: {
            "lines": pa.array([line_features(t.split("\n")).ravel().tolist() for t in texts(batch, "text")])
        }

    lines = append(sampled, make, [T.StructField("lines", T.ArrayType(T.DoubleType()))])
    rows = lines.select("doc_id", "lines", "quality").collect()
    rows.sort(key=lambda r: r.doc_id)
    return train([(np.reshape(r.lines, (-1, len(FEATURES))), r.quality) for r in rows])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that are found twice or more, the first time included.

    Runs of 1, 2, 4 and 8 words are numbered so that equal runs, and only they, share a number.
    """
    n = len(words)
    if n <= window:
        return 0
    known: dict[bytes, int] = {}
    runs = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    step = 1
    while step < window:
        if int(runs.max()) + 1 == len(runs):
            return 0
        runs = pd.factorize(runs[:-step] * (n + 1) + runs[step:])[0].astype(np.int64)
        step *= 2
    twice = np.bincount(runs)[runs] > 1
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:n] > 0).sum())


COLUMNS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("content_share", T.DoubleType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
]


def verdict(text: str, model: Crf) -> tuple:
    """The values of ``COLUMNS`` for a text."""
    words = text.encode().split()
    n = len(words)
    lines = text.split("\n")
    seen: set[str] = set()
    copies = 0
    for line in lines:
        if line.strip(" \t\n\v\f\r"):
            copies += line in seen
            seen.add(line)
    repeated = repeated_words(words)
    marks = model.viterbi(line_features(lines))
    content = sum(len(line.encode().split()) for line, mark in zip(lines, marks, strict=True) if mark)
    share = content / n if n else 0.0
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    return n, chars, symbols, copies, repeated, share, failed, not failed and share >= CONTENT_SHARE


def judged(frame: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """The frame with the counts, the base rule and the verdict on each whole text.

    Words are runs of other than ASCII white space. ``word_chars`` counts code points in words,
    ``n_symbols`` characters of ``#*$%&|<>``, ``n_dup_lines`` lines with a word that equal an
    earlier line, ``n_repeat_words`` words in 8-word windows found twice or more.
    ``content_share`` is the share of words in lines that the model marks as content.
    A null text has no words; a text without words has share 0 and fails. Repeated rows get
    repeated verdicts, columns of these names are replaced.
    """

    def make() -> Callable[[pa.RecordBatch], Columns]:
        def columns(batch: pa.RecordBatch) -> Columns:
            made: Iterable[tuple] = zip(*(verdict(t, model) for t in texts(batch, text)), strict=True)
            return {f.name: pa.array(c) for f, c in zip(COLUMNS, made, strict=True)}

        return columns

    return append(frame, make, COLUMNS)


def keep(frame: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """The rows whose text is kept, with their own columns."""
    # By place, as a column may have any name.
    names = [f"__{i}" for i in range(len(frame.columns))]
    marked = judged(frame.toDF(*names), model, names[frame.columns.index(text)])
    return marked.filter("kept").select(*names).toDF(*frame.columns)
