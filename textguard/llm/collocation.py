"""Phrase collocations by prefix-free parsing.

Texts are cut at words that their own letters pick, so equal passages are cut alike wherever they
stand. A chunk reaches past its end by as many words as the longest phrase has beside its first
one, and every phrase belongs to the chunk in which it starts; so each occurrence lies in one
chunk and is counted once. Phrases are counted inside the dictionary of different chunks, each
weighted by how often the parse has it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.common import PIECE, pieces
from textguard.session import ship_package, written

#: One word in so many ends a chunk.
TRIGGER = 32
#: Bits of the sieve of phrases that may grow; it has this size whatever the corpus.
SIEVE = 1 << 26
#: Entries of a task's tables, after which they are handed on or forgotten.
ENTRIES = 1 << 19
#: Parts of a lang that pick their best phrases apart.
PARTS = 64

_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: A-Z in lower case, piece ends as line ends, tabs as spaces.
_PLAIN = bytes(
    10 if b in _PIECE_ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


def _items(array: pa.Array, kind: type) -> list[bytes]:
    """The items of a binary array without nulls, faster than one by one."""
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].tolist() if len(array) else [0]
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def _whole(array: pa.Array) -> bytes:
    """All items of a binary array in a row."""
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int32)
    return data.to_pybytes()[ends[array.offset] : ends[array.offset + len(array)]] if len(array) and data else b""


class Words:
    """The words of a buffer of lower-case text, one space after each.

    ``text`` has them in a row, ``starts`` where each begins and where one after the last would,
    ``piece`` a number that changes from piece to piece, ``code`` and ``different`` which of the
    different words each is.
    """

    def __init__(self, buffer: bytes):
        raw = np.frombuffer(buffer, np.uint8)
        ends = raw == 10
        apart = ends | (raw == 32)
        before = np.concatenate([[True], apart[:-1]]) if len(raw) else apart
        first = np.flatnonzero(~apart & before)
        kept = ~apart
        kept[1:] |= apart[1:] & ~apart[:-1]
        text = raw[kept]
        text[apart[kept]] = 32
        self.text = text.tobytes() + b" " * (len(raw) > 0 and not apart[-1])
        after = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32) + 1
        self.starts = np.concatenate([[0], after])
        self.piece = np.cumsum(ends, dtype=np.int32)[first]
        spans = pa.py_buffer(self.starts.astype(np.int64))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, spans, pa.py_buffer(self.text)])
        coded = words.dictionary_encode()
        self.code = coded.indices.to_numpy().astype(np.int64)
        self._different = coded.dictionary

    @cached_property
    def different(self) -> list[bytes]:
        """Each with its space."""
        return _items(self._different, np.int64)

    def __len__(self) -> int:
        return len(self.code)

    def spans(self, first: np.ndarray, end: np.ndarray, mark: bytes = b"") -> list[bytes]:
        """Words joined by spaces, from the first up to before the end, with a mark behind."""
        text = self.text
        return [text[a:b] + mark for a, b in zip(self.starts[first].tolist(), (self.starts[end] - 1).tolist())]


def chunks_of(words: Words, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, owned end and whole end of the chunks of a buffer."""
    if not len(words):
        return (np.empty(0, np.int64),) * 3
    letters = np.frombuffer(words.text, np.uint8).astype(np.int64)
    lengths = np.diff(words.starts) - 1
    # What a word is made of decides, not where it stands.
    picks = (131 * letters[words.starts[:-1]] + 31 * letters[words.starts[1:] - 2] + 17 * lengths) % TRIGGER == 0
    last = np.append(words.piece[1:] != words.piece[:-1], True)
    owned = np.flatnonzero(picks | last) + 1
    piece_ends = np.flatnonzero(last) + 1
    whole = np.minimum(owned + longest - 1, piece_ends[np.searchsorted(piece_ends, owned)])
    return np.concatenate([[0], owned[:-1]]), owned, whole


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The rows of each lang, which is the first column."""
    langs = batch.column(0).dictionary_encode()
    codes = langs.indices.to_numpy()
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, batch.filter(pa.array(codes == i))


def dictionary(frame: DataFrame, longest: int = 5, text: str = "text", lang: str = "lang") -> DataFrame:
    """The parse of all texts: ``lang``, ``chunk``, ``owned`` and ``n``, each different chunk once.

    ``chunk`` is words joined by spaces with a line end behind, in UTF-8; phrases that start in
    the first ``owned`` of them are its own. A null text is empty, a null lang is ``und``.
    """
    ship_package(frame.sparkSession)

    def rows(found: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, mine in found.items():
            if mine:
                chunks, owned = zip(*mine)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(mine), pa.string()), pa.array(chunks, pa.binary()), pa.array(owned, pa.int32()), pa.array(mine.values(), pa.int64())],
                    names=["lang", "chunk", "owned", "n"],
                )
        found.clear()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in pieces(batches):
            for lang, some in _by_lang(batch):
                words = Words(b"\n".join(_items(some.column(1), np.int32)).translate(_PLAIN))
                first, owned, whole = chunks_of(words, longest)
                chunks = words.spans(first, whole, b"\n")
                found.setdefault(lang, Counter()).update(zip(chunks, (owned - first).tolist()))
            if sum(map(len, found.values())) >= ENTRIES:
                yield from rows(found)
        yield from rows(found)

    texts = frame.select(F.coalesce(F.col(lang), F.lit("und")), F.coalesce(F.col(text), F.lit("")).cast("binary"))
    parsed = texts.mapInArrow(run, "lang string, chunk binary, owned int, n long")
    return parsed.groupBy("lang", "chunk", "owned").agg(F.sum("n").alias("n"))


#: Odd number by which the hash of a phrase is moved on before the next word's is added.
_STEP = 0x9E3779B97F4A7C15


def _slots(words: np.ndarray, size: int, bits: int) -> np.ndarray:
    """The sieve's place of each run of ``size`` words, given the words' hashes."""
    n = max(0, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * np.uint64(_STEP) + words[i : i + n]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return ((total >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def _hashes(words: Words, lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang, 12)
    each = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.different), np.uint64, len(words.different))
    return each[words.code]


def _same(words: Words, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An example of each different phrase that starts at ``first``, and which one each is."""
    several = len(words._different)
    code, width = words.code[first], several
    for i in range(1, size):
        if width * several >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            width = len(first)
        code, width = code * several + words.code[first + i], width * several
    _, example, which = np.unique(code, return_index=True, return_inverse=True)
    return first[example], which


def counted(parse: DataFrame, size: int, sieve: np.ndarray | None) -> DataFrame:
    """``lang``, ``phrase`` and ``a`` of phrases of ``size`` words that may be frequent.

    A phrase is counted if the sieve has both phrases one word shorter that it holds (there is
    none for single words); all of its occurrences then are.
    """
    ship_package(parse.sparkSession)
    sent = None if sieve is None else parse.sparkSession.sparkContext.broadcast(sieve)

    def count(lang: str, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        owned, weight = (batch.column(i).to_numpy() for i in (2, 3))
        words = Words(_whole(batch.column(1)))
        last = np.append(words.piece[1:] != words.piece[:-1], True)
        end = np.flatnonzero(last) + 1
        at = np.concatenate([[0], end[:-1]])
        starts = np.maximum(0, np.minimum(owned, end - at - size + 1))  # a phrase ends in the chunk
        first = np.repeat(at, starts) + np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
        weight = np.repeat(weight, starts)
        if sent is not None:
            bits = sent.value
            slots = _slots(_hashes(words, lang), size - 1, len(bits) * 8)
            may = (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0
            keep = may[first] & may[first + 1]
            first, weight = first[keep], weight[keep]
        if len(first):
            example, which = _same(words, first, size)
            total = np.zeros(len(example), np.int64)
            np.add.at(total, which, weight)
            phrases = pa.array(words.spans(example, example + size), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(total), pa.string()), phrases, pa.array(total)], names=["lang", "phrase", "a"]
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(_joined(batches)):
            for lang, some in _by_lang(batch):
                yield from count(lang, some)

    narrow = parse.select("lang", "chunk", "owned", "n")
    some = narrow.mapInArrow(run, "lang string, phrase string, a long")
    return some.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together, so that more of their equal phrases meet."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= PIECE:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, size = [], 0
    if size:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def sieve_of(frequent: DataFrame, size: int, bits: int = SIEVE) -> np.ndarray:
    """A bit for each frequent phrase of ``size`` words. Two may share one, which costs only time.

    Bits are joined where they are made and come to the driver as at most ``bits`` / 64 numbers.
    """
    ship_package(frequent.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            slots = []
            for lang, some in _by_lang(batch):
                # Phrases of equal size stand in a row, so every size-th run is one of them.
                words = Words(_whole(some.column(1)))
                slots.append(_slots(_hashes(words, lang), size, bits)[::size])
            slots = np.concatenate(slots) if slots else np.empty(0, np.int64)
            masks = (np.uint64(1) << (slots & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slots >> 6), pa.array(masks)], names=["at", "mask"])

    marks = frequent.select("lang", F.concat("phrase", F.lit("\n")).cast("binary")).mapInArrow(run, "at long, mask long")
    table = marks.groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    sieve = np.zeros(bits // 64, np.int64)
    sieve[table["at"].to_numpy()] = table["mask"].to_numpy()
    return sieve.view(np.uint8)


def frequent_phrases(parse: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """``lang``, ``phrase``, ``size`` and ``a`` of the phrases with ``a`` >= ``least``, and ``lang``, ``n``.

    Lengths are counted one after the other. A phrase is no more frequent than those inside it,
    so only phrases are counted of which the last round left both that are one word shorter; a
    sieve of fixed size tells which, and what it lets through by chance is counted exactly and
    dropped.
    """
    words = written(counted(parse, 1, None), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    found = words.filter(F.col("a") >= least).withColumn("size", F.lit(1))
    last, every = found, found
    for size in range(2, longest + 1):
        sieve = sieve_of(last, size - 1)
        if not sieve.any():
            break
        last = counted(parse, size, sieve).filter(F.col("a") >= least)
        last = written(last.withColumn("size", F.lit(size)), "phrases")
        every = every.unionByName(last)
    return written(every, "frequent"), totals


def _part(phrase: Column | str, start: int | Column, n: int | Column) -> Column:
    words = F.split(phrase, " ")
    start, n = (F.lit(x) if isinstance(x, int) else x for x in (start, n))
    return F.array_join(F.slice(words, start, n), " ")


def collocations(
    frame: DataFrame, least: int = 100, longest: int = 5, covered: int = 100, top: int = 2000, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The best phrases of each lang: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase is 2 to ``longest`` words of a piece that occur there ``a`` >= ``least`` times, with
    overlaps. Cut after its first words into parts that occur ``l`` and ``r`` times, it scores
    floor(1000 a n / (l r)), ``n`` being all words of the lang; the cut that scores least counts,
    of equal ones the first. Phrases inside a longer one with 100 f(longer) >= ``covered`` * a
    are left out. Ranks go by score, then ``a``, both the highest first, then phrase in byte order.

    Null texts are empty, a null lang is ``und``, repeated rows count again, other columns are not
    looked at, and an empty table gives no rows. Products are decimals of 38 digits.
    """
    parse = written(dictionary(frame, longest, text, lang), "parse")
    every, totals = frequent_phrases(parse, least, longest)
    candidates = every.filter("size > 1")
    # Parts of phrases, each the place where it is cut.
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    cuts = candidates.withColumn("k", cut).withColumns(
        {"first": _part("phrase", 1, F.col("k")), "rest": _part("phrase", F.col("k") + 1, F.col("size") - F.col("k"))}
    )
    known = every.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    cuts = cuts.join(known, ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("first").alias("rest"), F.col("l").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    up = F.expr("cast(1000 * cast(a as decimal(17,0)) * cast(n as decimal(17,0)) as decimal(38,0))")
    score = F.call_function("div", up, (wide("l") * wide("r")).cast("decimal(38,0)"))
    scored = cuts.join(F.broadcast(totals), "lang").withColumn("score", score)
    worst = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    judged = scored.groupBy("lang", "phrase", "a", "n").agg(worst)
    # All shorter phrases inside each candidate, with the most frequent of those that hold them.
    inside = F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), "
        "i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    )
    holds = candidates.filter("size > 2").select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("held"))
    holds = holds.groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    kept = judged.join(holds, ["lang", "phrase"], "left")
    kept = kept.filter(F.coalesce(100 * F.col("held") < covered * F.col("a"), F.lit(True)))
    best = [F.desc("cut.score"), F.desc("a"), F.col("phrase")]
    # Each part of a lang gives its own best, so that no task orders all phrases of a lang.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))
    kept = kept.withColumn("rank", some).filter(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)))
    ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
