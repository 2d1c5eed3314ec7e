"""Near-duplicate embeddings by counting collisions of one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.components import components
from textguard.session import ship_package, written

#: Projections, half a window as a part of the distance of a pair at the threshold, and the
#: recall the count is calibrated to for such a pair.
PROJECTIONS, HALF_WINDOW, RECALL = 96, 0.75, 1 - 1e-6
#: Vectors of a block, and queries that are counted at once.
BLOCK, QUERIES = 2048, 128

LINKS = "id long, weight long, root long"


def least_count(projections: int, half_window: float, recall: float) -> int:
    """The largest count that a pair at the threshold reaches with the wanted probability.

    A Gaussian projection of a pair's difference is Gaussian with the pair's distance as its
    deviation, so a window catches it with a fixed chance and counts are binomial. Nearer pairs
    collide more often.
    """
    chance = math.erf(half_window / math.sqrt(2))
    missed, least = 0.0, 0
    for k in range(projections + 1):
        missed += math.comb(projections, k) * chance**k * (1 - chance) ** (projections - k)
        if missed > 1 - recall:
            break
        least = k + 1
    return least


def directions(size: int, projections: int = PROJECTIONS, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, projections))


def near_pairs(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs of unit vectors with cosine of at least ``threshold``, in pieces.

    Pairs are of a row of ``x`` and one of ``y``, or of two rows of ``x`` (the first before the
    second) where ``y`` is None. Each projection of all candidates is sorted; the window around
    a query's own value is a run of that order, and the runs a candidate is in are counted.
    Pairs whose count passes are verified by their exact cosine.
    """
    own = y is None
    y = x if own else y
    reach = HALF_WINDOW * math.sqrt(2 - 2 * threshold)
    least = least_count(PROJECTIONS, HALF_WINDOW, RECALL)
    across = directions(x.shape[1])
    asked, values = x @ across, y @ across
    order = np.argsort(values, axis=0, kind="stable").astype(np.int32)
    ranked = np.take_along_axis(values, order, 0)
    # A hair is added against rounding; a wider window misses nothing.
    starts = np.stack([np.searchsorted(ranked[:, k], asked[:, k] - reach - 1e-9) for k in range(PROJECTIONS)], 1).tolist()
    ends = np.stack([np.searchsorted(ranked[:, k], asked[:, k] + reach + 1e-9, "right") for k in range(PROJECTIONS)], 1).tolist()
    columns = list(np.ascontiguousarray(order.T))
    for at in range(0, len(x), QUERIES):
        ones, others = [], []
        for q in range(at, min(len(x), at + QUERIES)):
            runs = [column[a:b] for column, a, b in zip(columns, starts[q], ends[q], strict=True)]
            counts = np.bincount(np.concatenate(runs), minlength=len(y))
            near = np.flatnonzero(counts >= least)
            if own:
                near = near[near > q]
            if len(near):
                ones.append(np.full(len(near), q))
                others.append(near)
        if ones:
            a, b = np.concatenate(ones), np.concatenate(others)
            for part in range(0, len(a), 1 << 18):
                i, j = a[part : part + (1 << 18)], b[part : part + (1 << 18)]
                held = np.einsum("nd,nd->n", x[i], y[j]) >= threshold
                yield i[held], j[held]


def _links(ids: np.ndarray, copies: np.ndarray, x: np.ndarray, split: int | None, threshold: float) -> tuple:
    """Of one task's vectors: ids, links of each to other vectors, and the least id they reach.

    With ``split`` only pairs across that row are sought.
    """
    shift = 0 if split is None else split
    pieces = near_pairs(x, None, threshold) if split is None else near_pairs(x[:split], x[split:], threshold)
    weight = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), int)
    rank[order] = root
    for i, j in pieces:
        j = j + shift
        np.add.at(weight, i, copies[j])
        np.add.at(weight, j, copies[i])
        # Rows are held by the rank of their ids, so that the smallest rank is the smallest id.
        a, b = rank[i], rank[j]
        while True:
            least = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, before[a], least)
            np.minimum.at(root, before[b], least)
            root = root[root]
            if np.array_equal(root, before):
                break
    found = weight > 0
    return ids[found], weight[found], ids[order][root[rank]][found]


def links(classes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``id``, ``weight`` (links to other vectors) and ``root`` (a smaller id it is joined to).

    ``classes`` has ``id``, ``label``, ``unit`` (a unit vector) and ``copies`` and must be a
    table. The vectors of a label are dealt by hash into blocks of about ``block``, and two
    blocks meet in a task, so no task holds more however many vectors share a label. A task
    gives one row for each of its linked vectors, never its pairs.
    """
    ship_package(classes.sparkSession)
    counts = classes.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = classes.join(counts, "label").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(
        "label", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"),
        "mine", "id", "copies", "unit",
    )

    def task(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        second = np.asarray(table["mine"]) != low
        # Rows of a task come in any order; sorted, a rerun works alike.
        order = np.lexsort((np.asarray(table["id"]), second))
        ids, copies = np.asarray(table["id"])[order], np.asarray(table["copies"])[order]
        units = table["unit"].chunk(0)
        x = np.asarray(units.flatten()).reshape(len(ids), -1)[order]
        split = None if low == high else int((~second).sum())
        found = _links(ids, copies, x, split, threshold)
        return pa.table([pa.array(c, pa.int64()) for c in found], ["id", "weight", "root"])

    return met.groupBy("label", "low", "high").applyInArrow(task, LINKS)


def near_duplicates(
    frame: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK,
) -> DataFrame:
    """``key`` with ``n_links``, ``component_id`` and ``kept`` for each row.

    Rows link if their labels are equal and their cosine is at least ``threshold``. A row links
    with nothing if its key, label or vector is null, or its vector is empty, zero, of another
    length or holds a null or non-finite component; it is then a component of its own and, with a
    key, kept. Equal directions are one class and never paired: ``n_links`` counts all other rows
    linked directly, copies included, and repeated rows are rows. ``component_id`` is the
    smallest key reachable. Classes are told apart by 128 bits of hashes of the unit vector.
    """
    numbers = F.col(vector).cast("array<double>")
    sound = F.col(vector).isNotNull() & F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    top = F.array_max(F.transform(numbers, F.abs))
    sound = sound & (top > 0) & F.col(label).isNotNull() & F.col(key).isNotNull()
    rows = frame.select(
        F.col(key).alias("__key"), F.col(label).alias("__label"), numbers.alias("v"),
        F.coalesce(sound, F.lit(False)).alias("sound"),
    )
    # Components are scaled before they are squared, so that none overflows.
    scaled = rows.withColumn("v", F.expr("CASE WHEN sound THEN transform(v, x -> x / array_max(transform(v, y -> abs(y)))) END"))
    norm = "sqrt(aggregate(v, 0D, (total, x) -> total + x * x))"
    unit = scaled.withColumn("norm", F.expr(norm)).withColumn("unit", F.expr("transform(v, x -> x / norm)"))
    group = F.struct(F.col("__label").cast("string"), F.size("unit"))
    marked = unit.select("__key", "sound", group.alias("label"), "unit").withColumns(
        {"k1": F.xxhash64("label", "unit"), "k2": F.xxhash64(F.lit("2"), "unit", "label")}
    )
    narrow = written(marked.drop("unit", "label"), "vectors")
    classes = (
        marked.filter("sound")
        .groupBy("k1", "k2")
        .agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("__key").alias("first"))
    )
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    found = written(links(classes.select("id", "label", "unit", "copies"), threshold, block), "links")
    weights = found.groupBy("id").agg(F.sum("weight").alias("weight"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    least = (
        joined.join(classes.select("id", "first"), "id")
        .groupBy("component")
        .agg(F.min("first").alias("component_id"))
    )
    joined = joined.join(least, "component").select("id", "component_id")
    known = classes.select("k1", "k2", "id", "copies", "first").join(weights, "id", "left").join(joined, "id", "left")
    known = known.select(
        "k1", "k2", F.lit(True).alias("sound"),
        (F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "first").alias("component_id"),
    )
    every = narrow.join(known, ["k1", "k2", "sound"], "left")
    component = F.coalesce("component_id", "__key")
    return every.select(
        F.col("__key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("__key") == component, F.lit(False)).alias("kept"),
    )
