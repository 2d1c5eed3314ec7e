"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textguard.llm.common import Columns, Shipped, append, texts
from textguard.llm.merging import Merger, Pool
from textguard.llm.splitting import Splitter


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank in each line."""
    lines = (line.split() for line in data.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


def merger_of(ranks: dict[bytes, int]) -> Merger:
    """A token forms of any two tokens whose bytes it has; its rank is its id."""
    rows = [
        (ranks[token[:i]], ranks[token[i:]], rank)
        for token, rank in ranks.items()
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    left, right, rank = np.array(rows, np.int64).reshape(-1, 3).T
    result = np.arange(max(ranks.values()) + 1)
    single = np.array([ranks[bytes([b])] for b in range(256)])
    return Merger(left, right, rank, result, single)


class Encoder:
    """Encodes texts by ranks of byte strings, each match of a pattern separately."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = read_ranks(data)
        self.merger = merger_of(self.ranks)
        self.split = Splitter(pattern)
        self.pool = Pool(self._merge)

    def _merge(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens. One that is a token itself has that id, however it would merge."""
        pieces = [p.encode() for p in parts]
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int32)
        known = whole >= 0
        values, counts = self.merger.merge([p for p, k in zip(pieces, known, strict=True) if not k])
        all_counts = np.ones(len(parts), np.int64)
        all_counts[~known] = counts
        out = np.empty(int(all_counts.sum()), np.int32)
        place = np.cumsum(all_counts) - all_counts
        single = np.zeros(len(out), bool)
        single[place[known]] = True
        out[single] = whole[known]
        out[~single] = values
        return out, all_counts

    def encode(self, values: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        self.pool.trim()
        numbers = [self.pool.number(parts := self.split(v), len(parts)) for v in values]
        self.pool.fill()
        return [self.pool.expand(n) for n in numbers]


class Decoder:
    """Token bytes by id. An id without a token is an error, never skipped."""

    def __init__(self, data: bytes):
        self.tokens = {rank: token for token, rank in read_ranks(data).items()}

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def worker_encoder(ranks: Shipped, pattern: str) -> Encoder:
    """The worker process's encoder; it remembers pre-tokens from task to task."""
    return Encoder(ranks.data.value, pattern)


@lru_cache(maxsize=4)
def worker_decoder(ranks: Shipped) -> Decoder:
    return Decoder(ranks.data.value)


def encode(
    frame: DataFrame,
    path: str,
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    lossless: str | None = None,
) -> DataFrame:
    """Token ids of each whole text, as an array of integers in ``ids``.

    ``path`` names a file of ranks on the driver, ``pattern`` splits a text into pre-tokens.
    ``lossless`` names a column that says whether the ids decode to the text again; it is found
    where the ids are made. A null or empty text has no ids. Rows are independent: repeated rows
    give repeated results, an empty table an empty one. Columns named as the new ones are
    replaced, others stay. The time grows with a text's length times the logarithm of its
    longest pre-token.
    """
    ranks = Shipped(frame.sparkSession, path)

    def make() -> Callable[[pa.RecordBatch], Columns]:
        encoder = worker_encoder(ranks, pattern)
        decoder = worker_decoder(ranks) if lossless else None

        def encoded(batch: pa.RecordBatch) -> Columns:
            values = texts(batch, text)
            rows = encoder.encode(values)
            ends = np.cumsum([0, *map(len, rows)])
            flat = np.concatenate([np.empty(0, np.int32), *rows])
            made = {ids: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))}
            if decoder:
                same = [decoder.decode(r) == v.encode() for r, v in zip(rows, values, strict=True)]
                made[lossless] = pa.array(same, pa.bool_())
            return made

        return encoded

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    return append(frame, make, fields + [T.StructField(lossless, T.BooleanType())] * bool(lossless))


def decode(frame: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The bytes that ids stand for, in ``out``; no ids or null give no bytes.

    An id without a token, or a null one, is an error.
    """
    ranks = Shipped(frame.sparkSession, path)

    def make() -> Callable[[pa.RecordBatch], Columns]:
        decoder = worker_decoder(ranks)

        def decoded(batch: pa.RecordBatch) -> Columns:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            return {out: pa.array([decoder.decode(np.array(r or [], object)) for r in rows], pa.binary())}

        return decoded

    return append(frame, make, [T.StructField(out, T.BinaryType())])


DIGESTS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]


def round_trip(frame: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass and keeps only digests of both.

    Adds ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers) and
    ``decoded_sha256`` (of the decoded bytes), in lower-case hex. Nulls and clashing names as in
    ``encode``.
    """
    ranks = Shipped(frame.sparkSession, path)

    def make() -> Callable[[pa.RecordBatch], Columns]:
        encoder, decoder = worker_encoder(ranks, pattern), worker_decoder(ranks)

        def digests(batch: pa.RecordBatch) -> Columns:
            counts, of_ids, of_bytes = [], [], []
            for ids in encoder.encode(texts(batch, text)):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(decoder.decode(ids)).hexdigest())
            columns = (counts, of_ids, of_bytes)
            return {f.name: pa.array(c) for f, c in zip(DIGESTS, columns, strict=True)}

        return digests

    return append(frame, make, DIGESTS)
