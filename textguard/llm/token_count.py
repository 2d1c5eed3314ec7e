"""Token counts by the whole-token shortcut."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.llm.common import Columns, Shipped, append, texts
from textguard.llm.merging import Merger, Pool
from textguard.llm.splitting import Splitter

#: Pre-tokens of a byte-level tokenizer: a contraction, letters, digits or other signs with at
#: most one space before them, and runs of white space that leave the last one to what follows.
#: Fixed value of the public format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others are numbered from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def read_model(data: bytes) -> dict:
    """Merger and added strings of a byte-level BPE file; refuses other kinds.

    A merge's rank is its place in the file, and a pair listed twice has its first place.
    """
    file = json.loads(data)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    added = file.get("added_tokens", [])
    options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")
    if (
        model.get("type") != "BPE"
        or before.get("type") != "ByteLevel"
        or not before.get("use_regex", True)
        or before.get("add_prefix_space")
        or file.get("normalizer")
        or model.get("ignore_merges")
        or any(map(model.get, options))
        or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added)
    ):
        raise ValueError("not a plain byte-level BPE file")
    vocabulary = model["vocab"]
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    rank = {pair: i for i, pair in reversed(list(enumerate(pairs)))}
    rows = [(vocabulary[a], vocabulary[b], i) for (a, b), i in rank.items()]
    left, right, ranks = np.array(rows, np.int64).reshape(-1, 3).T
    result = np.array([vocabulary[a + b] for a, b in pairs])
    single = np.array([vocabulary[letter] for _, letter in sorted(byte_letters().items())])
    strings = sorted((a["content"] for a in added), key=len, reverse=True)
    return {
        "merger": Merger(left, right, ranks, result, single),
        "vocabulary": vocabulary,
        "added": regex.compile("|".join(map(regex.escape, strings))) if strings else None,
    }


def prove_whole(data: bytes) -> frozenset[str]:
    """Vocabulary strings that, as a pre-token of their own, encode as exactly one token.

    Each is merged alone; one that an earlier merge pulls apart is no whole token. Strings that
    are no UTF-8 text cannot be a pre-token and are left out.
    """
    model = read_model(data)
    byte = {letter: b for b, letter in byte_letters().items()}
    words = [w for w in model["vocabulary"] if w and all(letter in byte for letter in w)]
    pieces = [bytes(map(byte.__getitem__, w)) for w in words]
    symbols, counts = model["merger"].merge(pieces)
    first = np.cumsum(counts) - counts
    whole = set()
    for word, piece, n, at in zip(words, pieces, counts, first, strict=True):
        if n == 1 and symbols[at] == model["vocabulary"][word]:
            try:
                whole.add(piece.decode())
            except UnicodeDecodeError:
                continue
    return frozenset(whole)


class Counter:
    """Counts tokens of texts; made of a ``tokenizers`` file and its proven whole tokens."""

    def __init__(self, data: bytes, whole: frozenset[str]):
        model = read_model(data)
        self.merger, self.added, self.whole = model["merger"], model["added"], whole
        self.split = Splitter(PATTERN)
        self.pool = Pool(self._count)

    def _count(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of pre-tokens: 1 for a whole token; only the rest is merged."""
        counts = np.ones(len(parts), np.int32)
        rest = [i for i, part in enumerate(parts) if part not in self.whole]
        counts[rest] = self.merger.merge([parts[i].encode() for i in rest])[1]
        return counts, np.ones(len(parts), np.int64)

    def count(self, values: list[str]) -> list[int]:
        """Tokens of each text; an added string in it is one token and parts the rest."""
        self.pool.trim()
        strings, numbers = [], []
        for value in values:
            pieces = self.added.split(value) if self.added else [value]
            parts = [part for piece in pieces for part in self.split(piece)]
            strings.append(len(pieces) - 1)
            numbers.append(self.pool.number(parts, len(parts)))
        self.pool.fill()
        return [s + int(self.pool.values[n].sum()) for s, n in zip(strings, numbers, strict=True)]


@lru_cache(maxsize=4)
def _proven(file: Shipped) -> frozenset[str]:
    return prove_whole(file.data.value)


@lru_cache(maxsize=4)
def worker_counter(file: Shipped, whole: Broadcast) -> Counter:
    """The worker process's counter; it remembers pre-tokens from task to task."""
    return Counter(file.data.value, whole.value)


def count_tokens(
    frame: DataFrame, path: str, text: str = "text", out: str = "n_tokens"
) -> DataFrame:
    """Tokens of each whole text by a byte-level ``tokenizers`` file, in ``out``.

    The proof of whole tokens runs once on the driver; the set is as large as the vocabulary and
    is sent to the workers. Pre-tokens in it count 1 and all others are merged. Added strings in
    a text (such as an end mark) count as one token, as the library does by default; no token is
    added at either end and nothing is truncated. A null or empty text has 0 tokens. Rows are
    independent; a column named as ``out`` is replaced, other columns stay.
    """
    spark = frame.sparkSession
    file = Shipped(spark, path)
    whole = spark.sparkContext.broadcast(_proven(file))

    def make() -> Callable[[pa.RecordBatch], Columns]:
        counter = worker_counter(file, whole)
        return lambda batch: {out: pa.array(counter.count(texts(batch, text)), pa.int64())}

    return append(frame, make, [T.StructField(out, T.LongType())])


def with_limit(frame: DataFrame, limit: int, text: str = "text") -> DataFrame:
    """Adds ``n_bytes`` (UTF-8 bytes, 0 for null) and ``over_limit`` (more tokens than limit)."""
    return frame.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
            "over_limit": F.col("n_tokens") > limit,
        }
    )
