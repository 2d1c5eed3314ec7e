"""How far sources differ: terms counted again by sharded minimal perfect hashes.

A first pass finds the terms of each lang that enough documents have. Each shard of them gets a
minimal perfect hash, which takes every stored term to a slot of its own and any other string
to some slot; the term stored there tells which. Shards are broadcast in lots of bounded size, and
one more pass for each lot adds up dense counts by group and slot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.common import pieces
from textguard.session import ship_package, written

#: Terms of a shard, about, and bytes of the shards that are broadcast at once.
SHARD, LOT = 8192, 32 << 20
#: Keys that share a displacement, on average.
LOAD = 3
#: Entries of a task's tables, and bytes of its dense counts, after which they are handed on.
ENTRIES, DENSE = 1 << 19, 64 << 20
#: Slots of a block and sources of a tile, which bound what a task compares.
BLOCK, TILE = 2048, 256

#: Letters stay, A-Z in lower case; all else below 128 parts terms.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_PLAIN).split()


# --- minimal perfect hashes ------------------------------------------------------------------


def _hashes(keys: Sequence[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k, 7) for k in keys), np.uint64, len(keys))


def _place(hashes: np.ndarray, moves: np.ndarray | int, n: int) -> np.ndarray:
    """The slot of each hash under its displacement."""
    z = (hashes ^ (np.asarray(moves, np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    return (z % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """Takes the hashes of ``n`` keys to 0 .. n - 1, each to another; any other to some slot.

    Keys are put in bins by hash, and the bins, the fullest first, each look for a displacement
    that takes all their keys to free slots; bins of one key take the slots left over, told apart
    by a negative number. ``moves`` holds one number for each bin.
    """

    def __init__(self, moves: np.ndarray, n: int):
        self.moves, self.n = moves, n

    @classmethod
    def of(cls, hashes: np.ndarray) -> PerfectHash:
        n = len(hashes)
        bins = max(1, -(-n // LOAD))
        own = (hashes >> np.uint64(33)).astype(np.int64) % bins
        order = np.argsort(own, kind="stable")
        sizes = np.bincount(own, minlength=bins)
        starts = np.cumsum(sizes) - sizes
        moves = np.zeros(bins, np.int64)
        free = np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable").tolist():
            size = int(sizes[b])
            if size < 2:
                break
            mine = hashes[order[starts[b] : starts[b] + size]]
            if len(np.unique(mine)) < size:
                raise ValueError("keys with equal hashes")
            move = 0
            while True:
                # Many displacements are tried at once.
                tried = np.arange(move + 1, move + 65)
                slots = _place(mine[None, :], tried[:, None], n)
                fits = free[slots].all(1)
                fits[fits] = [len(set(s)) == size for s in slots[fits].tolist()]
                if fits.any():
                    at = int(np.argmax(fits))
                    moves[b] = tried[at]
                    free[slots[at]] = False
                    break
                move += 64
        alone = np.flatnonzero(sizes == 1)
        moves[alone] = -1 - np.flatnonzero(free)[: len(alone)]
        return cls(moves, n)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        moves = self.moves[(hashes >> np.uint64(33)).astype(np.int64) % len(self.moves)]
        slots = _place(hashes, np.maximum(moves, 0), self.n)
        return np.where(moves < 0, -1 - moves, slots)


def shards(kept: DataFrame) -> DataFrame:
    """``lang``, ``shard``, ``n``, ``moves`` and ``terms`` (in the order of their slots).

    ``kept`` has each term once, with its lang. A shard has about ``SHARD`` terms whatever the
    vocabulary, as they are dealt by hash.
    """
    ship_package(kept.sparkSession)
    sizes = kept.groupBy("lang").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    dealt = kept.join(sizes, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), F.col("term").cast("binary").alias("term")
    )

    def build(table: pa.Table) -> pa.Table:
        keys = table["term"].to_pylist()
        hashes = _hashes(keys)
        made = PerfectHash.of(hashes)
        ordered: list = [None] * len(keys)
        for slot, key in zip(made(hashes).tolist(), keys):
            ordered[slot] = key
        return pa.table(
            {
                "lang": table["lang"][:1].combine_chunks(), "shard": table["shard"][:1].combine_chunks(),
                "n": pa.array([len(keys)], pa.int64()), "moves": pa.array([made.moves.astype("<i8").tobytes()], pa.binary()),
                "terms": pa.array([ordered], pa.list_(pa.binary())),
            }
        )

    return dealt.groupBy("lang", "shard").applyInArrow(
        build, "lang string, shard int, n long, moves binary, terms array<binary>"
    )


class Lookup:
    """Slots, counted from the first of their lang, of the terms in the shards of a lot."""

    def __init__(self, lot: list[dict]):
        self.shards: dict[str, dict[int, tuple]] = {}
        self.count: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.width = 0
        for row in lot:
            lang, base = row["lang"], row["base"]
            # Shards of a lang stand in the order of their slots.
            first = self.first.setdefault(lang, base)
            buffers = [None, pa.py_buffer(row["offsets"]), pa.py_buffer(row["keys"])]
            stored = pa.BinaryArray.from_buffers(pa.binary(), row["n"], buffers)
            made = PerfectHash(np.frombuffer(row["moves"], "<i8"), row["n"])
            self.shards.setdefault(lang, {})[row["shard"]] = (made, stored, base - first)
            self.count[lang] = row["shards"]
            self.width = max(self.width, base - first + row["n"])

    def __call__(self, lang: str, shard: np.ndarray, keys: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 for one that is not stored."""
        found = np.full(len(hashes), -1, np.int64)
        for number in np.unique(shard).tolist():
            if number in self.shards.get(lang, {}):
                made, stored, base = self.shards[lang][number]
                at = np.flatnonzero(shard == number)
                slots = made(hashes[at])
                same = pc.equal(stored.take(pa.array(slots)), keys.take(pa.array(at))).to_numpy(zero_copy_only=False)
                found[at[same]] = base + slots[same]
        return found


# --- the two passes --------------------------------------------------------------------------


def _items(array: pa.Array) -> list[bytes]:
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].tolist() if len(array) else [0]
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def document_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``term`` and ``docs``, the documents of the lang that have the term."""

    def handed(found: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, mine in found.items():
            if mine:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(mine), pa.string()), pa.array(mine.keys(), pa.binary()).cast(pa.string()), pa.array(mine.values(), pa.int64())],
                    names=["lang", "term", "docs"],
                )
        found.clear()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in pieces(batches):
            for lang, text in zip(batch.column(0).to_pylist(), _items(batch.column(2))):
                found.setdefault(lang, Counter()).update(set(terms(text)))
            if sum(map(len, found.values())) >= ENTRIES:
                yield from handed(found)
        yield from handed(found)

    some = docs.mapInArrow(run, "lang string, term string, docs long")
    return some.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def _recounted(docs: DataFrame, sent) -> DataFrame:
    """``lang``, ``source``, ``slot`` and ``count`` of the stored terms of a lot, by task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(sent.value)
        width, most = lookup.width, DENSE
        dense: dict[tuple[str, str], np.ndarray] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in dense.items():
                slots = np.flatnonzero(counts)
                if len(slots):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(slots), pa.string()), pa.array([source] * len(slots), pa.string()), pa.array(slots + lookup.first[lang]), pa.array(counts[slots])],
                        names=["lang", "source", "slot", "count"],
                    )
            dense.clear()

        for batch in pieces(batches):
            groups: dict[tuple[str, str], list] = {}
            for i, group in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                groups.setdefault(group, []).append(i)
            texts = _items(batch.column(2))
            langs: dict[str, list] = {}
            for group, rows in groups.items():
                if group[0] in lookup.shards:
                    langs.setdefault(group[0], []).append((group, Counter(terms(b" ".join(texts[i] for i in rows)))))
            for lang, some in langs.items():
                keys = list(set().union(*(c for _, c in some)))
                hashes = _hashes(keys)
                array = pa.array(keys, pa.binary())
                slots = lookup(lang, _shard(keys, lookup.count[lang]), array, hashes)
                slot_of = {k: s for k, s in zip(keys, slots.tolist()) if s >= 0}
                for group, counts in some:
                    if group not in dense:
                        if (len(dense) + 1) * width * 8 > most:
                            yield from handed()
                        dense[group] = np.zeros(width, np.int64)
                    pairs = [(slot_of[k], n) for k, n in counts.items() if k in slot_of]
                    if pairs:
                        at, n = np.array(pairs, np.int64).T
                        dense[group][at] += n
        yield from handed()

    return docs.mapInArrow(run, "lang string, source string, slot long, count long")


def _shard(keys: Sequence[bytes], shards: int) -> np.ndarray:
    """The shard of each key, as Spark's ``pmod(xxhash64(term), shards)`` deals them."""
    signed = np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys)).view(np.int64)
    return np.mod(signed, shards)


def _normal(frame: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    empty = F.lit("")
    return frame.select(
        F.coalesce(lang, empty).alias("lang"), F.coalesce(source, empty).alias("source"), F.coalesce(text, empty).cast("binary").alias("text")
    )


def _rate(count: Column | str, total: str, terms: Column | str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exactly."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    up = ((wide(count) + 5) * F.lit(1_000_000_000)).cast("decimal(38,0)")
    down = (wide(total) + 5 * wide(terms)).cast("decimal(38,0)")
    return (F.call_function("div", up, down) + 1).cast("long")


def recount(frame: DataFrame, least: int = 30, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the audit needs of a corpus, as tables.

    ``lang``, ``slot``, ``term`` of the terms that at least ``least`` documents of a lang have;
    ``lang``, ``source``, ``slot``, ``count`` of those a group has; and all groups, with ``terms``
    (of the lang) and ``total`` (of the group's counts).
    """
    spark = frame.sparkSession
    ship_package(spark)
    docs = _normal(frame, text, lang, source)
    groups = written(docs.groupBy("lang", "source").agg(F.count("*").alias("rows")), "groups")
    kept = written(document_counts(docs).filter(F.col("docs") >= least).select("lang", "term"), "kept-terms")
    built = written(shards(kept), "perfect-hashes")
    sizes = written(kept.groupBy("lang").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"), F.count("*").alias("terms")), "vocabularies")
    # A shard's first slot in its lang, and the lot of bounded size that it is broadcast with.
    upto = Window.partitionBy("lang").orderBy("shard")
    length = F.octet_length("moves") + F.aggregate("terms", F.lit(0), lambda t, x: t + F.octet_length(x) + 16)
    header = built.select("lang", "shard", "n", length.cast("long").alias("bytes"))
    header = header.withColumn("base", F.sum("n").over(upto) - F.col("n"))
    running = F.sum("bytes").over(Window.orderBy("lang", "shard").rowsBetween(Window.unboundedPreceding, 0))
    header = written(header.withColumn("lot", F.floor(running / LOT).cast("int")).join(sizes, "lang"), "shard-headers")
    slots = built.join(header.select("lang", "shard", "base"), ["lang", "shard"])
    slots = slots.select("lang", "base", F.posexplode("terms").alias("at", "key"))
    slots = slots.select("lang", (F.col("base") + F.col("at")).alias("slot"), F.col("key").cast("string").alias("term"))
    counts = None
    for row in header.select("lot").distinct().orderBy("lot").toLocalIterator():
        mine = header.filter(F.col("lot") == row["lot"]).select("lang", "shard", "base", "shards")
        sent = spark.sparkContext.broadcast(_lot(built.join(mine, ["lang", "shard"])))
        some = _recounted(docs, sent).groupBy("lang", "source", "slot").agg(F.sum("count").alias("count"))
        some = written(some, "counts")
        counts = some if counts is None else counts.unionByName(some)
    if counts is None:
        counts = spark.createDataFrame([], "lang string, source string, slot long, count long")
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = groups.join(sizes.select("lang", "terms"), "lang", "left").join(totals, ["lang", "source"], "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", F.coalesce("terms", zero).alias("terms"), F.coalesce("total", zero).alias("total"))
    return slots, counts, written(groups, "groups")


def _lot(rows: DataFrame) -> list[dict]:
    """Shards of about ``LOT`` bytes together, as they are broadcast."""
    out = []
    for row in rows.orderBy("lang", "shard").toArrow().to_pylist():
        keys = row.pop("terms")
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        out.append(row | {"offsets": ends.tobytes(), "keys": b"".join(keys)})
    return out


# --- the audit -------------------------------------------------------------------------------


def audit(frame: DataFrame, least: int = 30, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` of every group of lang and source.

    Terms are runs of letters and of characters from U+0080 on, A-Z in lower case; a lang keeps
    those of at least ``least`` of its documents. A group's rate of each is 1 + floor(10^9 (count
    + 5) / (all counts + 5 terms)). ``pair``: each other source of the lang, with the sum of the
    differences of rates. ``term``: a kept term of the group whose rate is above the lang's,
    with the difference, the first ``top``. Ranks go by value, the highest first, then item.

    Null texts, langs and sources are empty. Repeated rows are documents of their own, groups
    without a kept term have all rates alike, a lang without terms has pairs of value 0, other
    columns are not looked at, and an empty table gives no rows. Rates are exact decimals.
    """
    slots, counts, groups = recount(frame, least, text, lang, source)
    rated = counts.join(groups, ["lang", "source"]).withColumn("p", _rate("count", "total", "terms"))
    rated = written(rated.select("lang", "source", "slot", "count", "p"), "rates")
    pairs = _pairs(rated, groups).withColumn("part", F.lit("pair"))
    found = pairs.unionByName(_over(rated, groups, slots).withColumn("part", F.lit("term")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    # The sources of a lang are all listed; of terms each task keeps the first of a group.
    ranked = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    listed = found.filter("part = 'pair'").withColumn("rank", F.row_number().over(order))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return ranked.select(*columns).unionByName(listed.select(*columns))


def _over(rated: DataFrame, groups: DataFrame, slots: DataFrame) -> DataFrame:
    """Terms that a group uses more than its lang: ``lang``, ``source``, ``item``, ``value``."""
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("terms").alias("terms"))
    used = rated.groupBy("lang", "slot").agg(F.sum("count").alias("count"))
    used = used.join(whole, "lang").select("lang", "slot", _rate("count", "total", "terms").alias("q"))
    named = used.join(slots, ["lang", "slot"])
    over = rated.join(named, ["lang", "slot"]).filter("p > q")
    return over.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def _pairs(rated: DataFrame, groups: DataFrame) -> DataFrame:
    """Summed differences of the rates of two sources, both ways.

    Rates are laid out densely in blocks of slots. A task compares two tiles of sources on a
    block; sums of blocks are added afterwards.
    """
    rest = F.when(F.col("terms") > 0, _rate(F.lit(0), "total", F.greatest("terms", F.lit(1))))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    listed = groups.select("lang", "source", "terms", F.coalesce(rest, F.lit(0)).alias("rest"), number.alias("number"))
    listed = listed.withColumn("tile", F.floor(F.col("number") / TILE).cast("int"))
    listed = written(listed, "sources")
    tiles = listed.groupBy("lang").agg((F.max("tile") + 1).alias("tiles"))
    last = F.greatest(F.ceil(F.col("terms") / BLOCK), F.lit(1)).cast("int") - 1
    every = listed.withColumn("block", F.explode(F.sequence(F.lit(0), last)))
    block = F.floor(F.col("slot") / BLOCK).cast("int")
    held = rated.groupBy("lang", "source", block.alias("block")).agg(
        F.collect_list(F.struct((F.col("slot") % BLOCK).cast("int").alias("at"), "p")).alias("held")  # a block's at most
    )
    rows = every.join(held, ["lang", "source", "block"], "left").join(tiles, "lang")
    width = F.least(F.col("terms") - F.col("block").cast("long") * BLOCK, F.lit(BLOCK)).cast("int")
    rows = rows.select(
        "lang", "source", "block", "tile", "number", width.alias("width"), "rest",
        F.coalesce("held.at", F.array().cast("array<int>")).alias("at"), F.coalesce("held.p", F.array().cast("array<long>")).alias("p"),
        F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"),
    )
    rows = rows.withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")})

    def compare(table: pa.Table) -> pa.Table:
        names, tile = table["source"].to_pylist(), table["tile"].to_numpy()
        order = table["number"].to_numpy()
        width = int(table["width"][0].as_py())
        dense = np.repeat(table["rest"].to_numpy()[:, None], width, axis=1)
        for i, (at, p) in enumerate(zip(table["at"], table["p"])):
            dense[i, at.values.to_numpy()] = p.values.to_numpy()
        first, second = int(table["a"][0].as_py()), int(table["b"][0].as_py())
        left, right = np.flatnonzero(tile == first), np.flatnonzero(tile == second)
        out: tuple[list, list, list] = ([], [], [])
        for i in left.tolist():
            others = right[order[right] > order[i]] if first == second else right
            sums = np.abs(dense[others] - dense[i]).sum(axis=1)
            out[0].extend([names[i]] * len(others))
            out[1].extend(names[j] for j in others.tolist())
            out[2].extend(sums.tolist())
        return pa.table(
            {
                "lang": pa.array([table["lang"][0].as_py()] * len(out[0]), pa.string()), "source": pa.array(out[0], pa.string()),
                "item": pa.array(out[1], pa.string()), "value": pa.array(out[2], pa.int64()),
            }
        )

    some = rows.groupBy("lang", "block", "a", "b").applyInArrow(compare, "lang string, source string, item string, value long")
    once = written(some.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pairs")
    back = once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return once.unionByName(back)
