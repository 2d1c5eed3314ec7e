"""SimHash near-duplicates by segment popcounts and a grid join."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.llm.common import Columns, append, texts
from textguard.llm.components import components
from textguard.session import written

BITS = 64
#: Bits of a segment. Its popcount is 0, 1 or 2, one digit of a cell's number.
SEGMENT = 2
#: Branches that the rows of one fingerprint are dealt to, and parts of a branch.
BRANCHES = 32
#: Shingles whose bits are counted at once in a worker.
CHUNK = 1 << 16


def fingerprints(text: str, shingle: int, prints: int = 1, seed: int = 42) -> list[int]:
    """SimHashes of a text, as signed 64-bit integers; all 0 for a text without words.

    A-Z are lowered, words are split at ASCII white space, shingles are runs of ``shingle`` words
    with repeats (a shorter text is one shingle). A bit is 1 if it is set in over half of the
    shingles' hashes. The first hash is XXH64, the others are mixed from it.
    """
    words = text.encode().lower().split()
    if not words:
        return [0] * prints
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros((prints, BITS), np.int64)
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : min(n, at + CHUNK)].tolist(), last[at : at + CHUNK].tolist())
        hashes = np.array([digest(whole[a:b], seed) for a, b in pairs], "<u8")
        for which in range(prints):
            own = _mixed(hashes, which) if which else hashes
            bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            # Sums of up to 255 rows fit a byte, which is several times faster than wide sums.
            head = len(bits) // 255 * 255
            small = np.add.reduce(bits[:head].reshape(-1, 255, BITS), axis=1, dtype=np.uint8)
            counts[which] += small.sum(0, dtype=np.int64) + bits[head:].sum(0, dtype=np.int64)
    packed = np.packbits((2 * counts > n).astype(np.uint8), axis=1, bitorder="little")
    return packed.view("<i8")[:, 0].tolist()


def _mixed(hashes: np.ndarray, which: int) -> np.ndarray:
    """Other 64-bit hashes of the same shingles."""
    z = hashes + np.uint64(which * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def fingerprinted(frame: DataFrame, shingle: int, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """The frame with each whole text's SimHash as a long; a column of that name is replaced.

    Null and empty texts get 0.
    """

    def make() -> Callable[[pa.RecordBatch], Columns]:
        return lambda batch: {
            out: pa.array([fingerprints(t, shingle)[0] for t in texts(batch, text)], pa.int64())
        }

    return append(frame, make, [T.StructField(out, T.LongType())])


def near_pairs(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs ``a``, ``b`` of different fingerprints with at most ``distance`` differing bits.

    ``prints`` is a table with longs in ``fingerprint``, different within a ``kind`` (a small
    integer, 0 where there is no such column); only those of a kind are compared, and pairs carry
    it. The popcounts of the segments of a fingerprint are a point whose Manhattan distance to
    another point is never larger than the Hamming distance. Of two halves of the segments at
    least one is within half the distance, so points are laid out on a grid for each half and
    every fingerprint meets the cells one step up from its own; bits are compared exactly where
    two meet. A pair can come up several times.
    """
    if distance not in (0, 1, 2, 3):
        raise ValueError("the grid finds pairs of up to 3 differing bits")
    kind = F.col("kind") if "kind" in prints.columns else F.lit(0)
    halves = [_half(i) for i in range(2)]
    cells = prints.select("fingerprint", kind.alias("kind"), F.posexplode(F.array(*halves)).alias("half", "counts"))
    powers = F.array(*(F.lit(3**i) for i in range(BITS // SEGMENT // 2)))
    own = F.aggregate(F.zip_with("counts", powers, lambda c, p: c * p), F.lit(0), lambda total, x: total + x)
    # One number for kind, half and cell; a step up stays within the half's numbers.
    grid = (F.col("kind") * 2 + F.col("half")).cast("long") * 3 ** (BITS // SEGMENT // 2)
    cells = cells.withColumn("cell", grid + own)
    up = F.filter(F.zip_with("counts", powers, lambda c, p: F.when(c < SEGMENT, p)), F.isnotnull)
    ring = F.concat(F.array(F.lit(0)), up) if distance > 1 else F.array(F.lit(0))
    here = cells.select(F.col("fingerprint").alias("b"), "cell", "kind")
    probes = cells.select(F.col("fingerprint").alias("a"), "cell", F.explode(ring).alias("step"))
    probes = probes.select("a", (F.col("cell") + F.col("step")).alias("at"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, distance)
    joined = probes.join(here.hint("shuffle_hash"), (F.col("at") == F.col("cell")) & near)
    return joined.select("a", "b", "kind") if "kind" in prints.columns else joined.select("a", "b")


def _half(which: int) -> Column:
    """Popcounts of the segments of one half of the bits."""
    shift = which * BITS // 2
    return F.array(
        *(
            F.bit_count(F.shiftrightunsigned("fingerprint", shift + i).bitwiseAND(F.lit(3)))
            for i in range(0, BITS // 2, SEGMENT)
        )
    )


def clustered(frame: DataFrame, order: Column, distance: int = 3, out: str = "component_id") -> DataFrame:
    """The frame with the smallest ``order`` of each near-duplicate group in ``out``.

    The frame has ``fingerprint`` (a long, not null) and must be a table; repeated fingerprints
    are one class, so copies are never paired, and groups reach as far as links do. Keep it
    narrow: it is shuffled by fingerprint and a part of its rows, so that no task gets all copies.
    Nulls of ``order`` count only where a group has nothing else. A column named as ``out`` is
    replaced, names that begin with ``__sim_`` are kept for this.
    """
    frame = frame.drop(out).withColumn("__sim_part", F.pmod(F.xxhash64(order), F.lit(BRANCHES**2)))
    parts = written(frame.groupBy("fingerprint", "__sim_part").agg(F.min(order).alias("__first")), "parts")
    classes = written(parts.groupBy("fingerprint").agg(F.min("__first").alias("__first")), "classes")
    joined = components(near_pairs(classes.select("fingerprint"), distance))
    linked = joined.withColumnsRenamed({"id": "fingerprint", "component": "__root"})
    grouped = classes.join(linked, "fingerprint", "inner")
    firsts = grouped.groupBy("__root").agg(F.min("__first").alias("__least"))
    moved = grouped.join(firsts, "__root").select("fingerprint", "__least")
    every = classes.join(moved, "fingerprint", "left")
    least = every.select("fingerprint", F.coalesce("__least", "__first").alias(out))
    # A class tells its branches, each of them its parts, and those their rows.
    branch = F.pmod("__sim_part", F.lit(BRANCHES)).alias("__sim_branch")
    branches = parts.select("fingerprint", branch).distinct().join(least, "fingerprint")
    told = parts.select("fingerprint", "__sim_part", branch).join(branches, ["fingerprint", "__sim_branch"])
    return frame.join(told.drop("__sim_branch"), ["fingerprint", "__sim_part"]).drop("__sim_part")


def as_hex(fingerprint: str) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def one_of_each(
    frame: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = 3, prints: int = 8
) -> DataFrame:
    """The rows of a frame without near-duplicates: of each group that with the smallest key.

    Texts link if any of their ``prints`` SimHashes differ in at most ``distance`` bits; several
    hashes find more of the texts that are only somewhat alike. Texts without words are one
    group. Null keys come last, and of repeated keys one row stays. The frame is written once
    with its fingerprints, groups are found on them alone, and columns and their order stay.
    """
    columns = frame.columns

    def make() -> Callable[[pa.RecordBatch], Columns]:
        kind = pa.list_(pa.int64())
        return lambda batch: {
            "__prints": pa.array([fingerprints(t, shingle, prints) for t in texts(batch, text)], kind)
        }

    marked = append(frame, make, [T.StructField("__prints", T.ArrayType(T.LongType()))])
    marked = written(marked.withColumn("__row", F.monotonically_increasing_id()), "fingerprinted")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("__row").alias("row"))
    narrow = marked.select("__prints", order.alias("order"))
    classes = narrow.groupBy("__prints").agg(F.min("order").alias("order"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    each = classes.select("id", F.posexplode("__prints").alias("kind", "fingerprint"))
    firsts = written(each.groupBy("kind", "fingerprint").agg(F.min("id").alias("first")), "firsts")
    same = each.join(firsts, ["kind", "fingerprint"]).select(F.col("id").alias("a"), F.col("first").alias("b"))
    near = near_pairs(firsts.select("kind", "fingerprint"), distance)
    for end in ("a", "b"):
        ids = firsts.select("kind", F.col("fingerprint").alias(end), F.col("first").alias(f"__{end}"))
        near = near.join(ids, ["kind", end])
    links = same.unionByName(near.select(F.col("__a").alias("a"), F.col("__b").alias("b")))
    joined = components(links)
    grouped = classes.join(joined, "id", "left").withColumn("group", F.coalesce("component", "id"))
    kept = grouped.groupBy("group").agg(F.min("order").alias("least")).select(F.col("least.row").alias("__row"))
    # The rows that go are fewer than those that stay; Spark may send them to where the texts are.
    gone = written(marked.select("__row").join(kept, "__row", "left_anti"), "gone")
    return marked.join(gone, "__row", "left_anti").select(*columns)
