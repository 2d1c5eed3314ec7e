"""Exact top-k inner products by norm-bucketed retrieval.

Vectors of integers are grouped by length into buckets. A query's k-th best product so far,
over its own length and the longest vector of a bucket, is the least cosine that a better
vector of that bucket must reach; from this local threshold each query and bucket take one of
three ways: the bucket is passed over, it is pruned by coordinates, or by lengths.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.common import pieces
from textguard.session import ship_package, written

#: Rows of a bucket, and the longest vectors that give every query its first threshold.
BUCKET, SEEDS = 1024, 4096
#: Numbers of a group of queries, which a task holds, and vectors that it meets there.
HELD, MET = 1 << 20, 1 << 16
#: Components are below this after scaling, so that products of 2,048 of them fit a long.
REACH = 1 << 26
#: Least local cosine for pruning by coordinates, and the part of a bucket it must leave at most.
COORDINATES, LEFT = 0.5, 0.25
#: Pairs that are verified, and queries that are multiplied, at once.
PAIRS, QUERIES = 1 << 16, 512
SLACK = 1e-9


def quantised(frame: DataFrame, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id``, ``dim``, ``vec`` and ``length2`` of each different row with whole vector.

    ``vec`` holds floor(scale * x) of all components as little-endian integers, of two bytes each
    where all of them fit and else of four; ``length2`` is its squared length. Rows with a null
    id, a null vector, a null or non-finite component or one of REACH and more after scaling take
    no part. Rows equal in id and vector count once; other columns are not looked at.
    """
    ship_package(frame.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, vectors = batch.column(0), batch.column(1)
            sizes = np.diff(np.asarray(vectors.offsets))
            values = vectors.values.slice(vectors.offsets[0].as_py(), int(sizes.sum()))
            x = np.floor(scale * values.cast(pa.float64()).to_numpy(zero_copy_only=False))
            with np.errstate(invalid="ignore"):
                bad = ~(np.abs(x) < REACH)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            whole = np.bincount(owner, bad, minlength=len(sizes)) == 0
            whole &= ~np.asarray(vectors.is_null()) & ~np.asarray(ids.is_null())
            x[bad] = 0
            wide = np.bincount(owner, (x < -32768) | (x > 32767), minlength=len(sizes)) > 0
            length2 = np.bincount(owner, x * x, minlength=len(sizes))
            starts = np.concatenate([[0], np.cumsum(sizes)])
            short, long = x.astype("<i2"), x.astype("<i4")
            rows = np.flatnonzero(whole)
            vecs = [(long if wide[i] else short)[starts[i] : starts[i + 1]].tobytes() for i in rows]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), pa.array(sizes[rows], pa.int32()), pa.array(vecs, pa.binary()), pa.array(length2[rows], pa.float64())],
                names=["id", "dim", "vec", "length2"],
            )

    narrow = frame.select(F.col(key).cast("long"), F.col(vector).cast("array<double>"))
    return narrow.mapInArrow(run, "id long, dim int, vec binary, length2 double").distinct()


def _matrix(vecs: Iterable[bytes], dim: int) -> np.ndarray:
    vecs = list(vecs)
    out = np.empty((len(vecs), dim))
    narrow = np.fromiter((len(v) == 2 * dim for v in vecs), bool, len(vecs))
    for wide, kind in ((False, "<i2"), (True, "<i4")):
        at = np.flatnonzero(narrow != wide)
        if len(at):
            out[at] = np.frombuffer(b"".join(vecs[i] for i in at), kind).reshape(len(at), dim)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products, exactly: in doubles where no sum can pass their whole numbers."""
    if a.size == 0 or b.size == 0 or a.shape[1] * np.abs(a).max() * np.abs(b).max() < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.size == 0 or a.shape[1] * np.abs(a).max() * np.abs(b).max() < 2.0**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))


class Search:
    """The best ``k`` of the candidates seen so far for each of a group of queries."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, seeds: tuple[np.ndarray, np.ndarray]):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        safe = np.where(self.lengths > 0, self.lengths, 1)[:, None]
        self.unit = matrix / safe
        # The two largest coordinates say most about where a near vector can lie.
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :2]
        self.least = np.full(len(ids), np.iinfo(np.int64).min)
        self.best = (np.empty(0, np.int64),) * 3
        for at in range(0, len(ids), QUERIES):
            some = _products(matrix[at : at + QUERIES], seeds[1])
            own = ids[at : at + QUERIES, None] == seeds[0]
            some[own] = np.iinfo(np.int64).min
            if some.shape[1] >= k:
                self.least[at : at + QUERIES] = np.partition(some, -k, axis=1)[:, -k]

    def meet(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        """A bucket of candidates, the longest first."""
        lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        reach = self.lengths * lengths[0]
        least = np.where(self.least == np.iinfo(np.int64).min, -np.inf, self.least.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            # The cosine that a vector of the bucket must reach; nothing is needed at 0 and below.
            local = np.where(reach > 0, least / reach, np.where(least > 0, np.inf, 0))
            floor = np.where(least > 0, least / self.lengths * (1 - SLACK), -1)
        live = local <= 1 + SLACK
        # Lengths fall within a bucket, so those long enough stand in front.
        prefix = np.where(live, np.searchsorted(-lengths, -floor, "right"), 0)
        picked = np.zeros(len(self.ids), bool)
        found = []
        sharp = np.flatnonzero(live & (local > COORDINATES))
        if len(sharp):
            sharp, near = self._by_coordinates(sharp, np.minimum(local[sharp], 1), prefix[sharp], matrix, lengths)
            picked[sharp] = True
            found += [(q, ids[c], s) for q, c, s in near]
        rest = np.flatnonzero((prefix > 0) & ~picked)
        for at in range(0, len(rest), QUERIES):
            some = rest[at : at + QUERIES]
            upto = prefix[some].max()
            scores = _products(self.matrix[some], matrix[:upto])
            q, c = np.nonzero(scores >= self.least[some, None])
            found.append((some[q], ids[c], scores[q, c]))
        self._keep(found)

    def _by_coordinates(self, queries, local, prefix, matrix, lengths):
        """The queries that coordinates prune well, and their pairs with the products."""
        safe = np.where(lengths > 0, lengths, 1)[:, None]
        unit = matrix / safe
        order = np.argsort(unit, axis=0, kind="stable")
        ranked = np.take_along_axis(unit, order, axis=0)
        turn = np.arccos(local)
        low, high = np.empty((2, len(queries))), np.empty((2, len(queries)))
        first, last = np.empty((2, len(queries)), np.int64), np.empty((2, len(queries)), np.int64)
        focus = self.focus[queries].T if self.focus.shape[1] > 1 else np.repeat(self.focus[queries].T, 2, axis=0)
        for i in range(2):
            angle = np.arccos(np.clip(self.unit[queries, focus[i]], -1, 1))
            low[i] = np.cos(np.minimum(np.pi, angle + turn)) - SLACK
            high[i] = np.cos(np.maximum(0, angle - turn)) + SLACK
            for f in np.unique(focus[i]):
                at = np.flatnonzero(focus[i] == f)
                first[i, at] = np.searchsorted(ranked[:, f], low[i, at], "left")
                last[i, at] = np.searchsorted(ranked[:, f], high[i, at], "right")
        which = np.argmin(last - first, axis=0)
        each = np.arange(len(queries))
        start, size = first[which, each], np.maximum(0, (last - first)[which, each])
        good = np.flatnonzero(size <= LEFT * prefix)
        pairs, at = [], 0
        ends = np.cumsum(size[good])
        while at < len(good):
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            part = good[at:upto]
            owner = np.repeat(part, size[part])
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
            rows = order[start[owner] + offset, focus[which[owner], owner]]
            other = 1 - which[owner]
            value = unit[rows, focus[other, owner]]
            fits = (rows < prefix[owner]) & (value >= low[other, owner]) & (value <= high[other, owner])
            owner, rows = owner[fits], rows[fits]
            scores = _paired(self.matrix[queries[owner]], matrix[rows])
            enough = scores >= self.least[queries[owner]]
            pairs.append((queries[owner[enough]], rows[enough], scores[enough]))
            at = upto
        return queries[good], pairs

    def _keep(self, found: list) -> None:
        q, c, s = (np.concatenate(x) for x in zip(self.best, *found))
        other = c != self.ids[q]
        q, c, s = q[other], c[other], s[other]
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        kth = place == self.k - 1
        self.least[q[kth]] = np.maximum(self.least[q[kth]], s[kth])
        kept = place < self.k
        self.best = (q[kept], c[kept], s[kept])


def top(frame: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: the ``k`` highest inner products.

    ``queries`` is a condition on ``id``, a row's key as a long, that picks the queries; candidates are all rows with
    another id. Products are of the integers floor(scale * x) and exact, ties go to the smaller
    id, and a query has fewer rows only where there are fewer candidates. Only vectors of as many
    components are compared. What takes no part says ``quantised``; of rows that share an id but
    not the vector each is a query and a candidate. An empty table gives no rows.

    Of equal vectors at most the ``k + 1`` smallest ids can be among anyone's best, so a vector
    that fills a third of the table becomes that many rows before any is compared. Queries are
    dealt into groups of bounded size, candidates into slices; a task holds one group, streams one
    slice past it in order of length, and raises its thresholds on the way. All are given a first
    threshold by the ``SEEDS`` longest vectors, the only ones sent to the driver. Nothing is
    left out: a bucket, a coordinate range or the shorter end of a bucket is passed over only
    where no vector in it can reach a query's threshold.
    """
    spark = frame.sparkSession
    vectors = written(quantised(frame, scale, key, vector), "vectors")
    copies = Window.partitionBy("dim", "vec").orderBy("id")
    candidates = vectors.withColumn("__n", F.row_number().over(copies)).filter(F.col("__n") <= k + 1).drop("__n")
    candidates = written(candidates, "candidates")
    # Of equal rows with several ids any few would do as seeds: a threshold is only ever too low.
    asked = vectors.filter(queries)
    sizes = candidates.agg(F.count("*"), F.max("dim")).first()
    n_queries = asked.count()
    groups = -(-n_queries // max(QUERIES, HELD // max(1, sizes[1] or 1))) or 1
    width = 2 * spark.sparkContext.defaultParallelism
    slices = max(-(-sizes[0] // MET), min(-(-sizes[0] // BUCKET), -(-width // groups)), 1)
    group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    part = F.pmod(F.xxhash64("vec"), F.lit(slices)).cast("int")
    sent = spark.sparkContext.broadcast(_seeds(candidates))
    columns = ("dim", "group", "slice", "asks", "id", "vec", "length2")
    left = asked.select("dim", group.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(True).alias("asks"), "id", "vec", "length2")
    right = candidates.select("dim", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), part.alias("slice"), F.lit(False).alias("asks"), "id", "vec", "length2")
    dealt = left.select(*columns).unionByName(right.select(*columns))
    dealt = dealt.repartition(max(1, min(groups * slices, 20 * width)), "dim", "group", "slice")
    dealt = dealt.sortWithinPartitions("dim", "group", "slice", F.desc("asks"), F.desc("length2"), "id")
    found = dealt.mapInArrow(_searched(sent, k), "query_id long, twin long, vec_id long, score long")
    order = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _seeds(candidates: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the longest, by number of components."""
    longest = candidates.orderBy(F.desc("length2"), "id").limit(SEEDS)
    table = longest.select("id", "dim", "vec").toArrow()
    dims, ids = table["dim"].to_numpy(), table["id"].to_numpy()
    vecs = table["vec"].to_pylist()
    return {
        int(d): (ids[dims == d], _matrix((vecs[i] for i in np.flatnonzero(dims == d)), int(d)))
        for d in np.unique(dims)
    }


def _searched(sent, k: int):
    """Streams sorted rows past the queries of each group."""
    import xxhash

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, search, waiting = None, None, ([], [])

        def emptied(search: Search | None) -> Iterator[pa.RecordBatch]:
            if search is not None and len(search.best[0]):
                q, c, s = search.best
                yield pa.RecordBatch.from_arrays(
                    [pa.array(search.ids[q]), pa.array(search.twins[q]), pa.array(c), pa.array(s)],
                    names=["query_id", "twin", "vec_id", "score"],
                )

        def flush(last: bool) -> None:
            """Searches the waiting rows, by whole buckets."""
            nonlocal waiting
            ids, vecs = waiting
            upto = len(ids) if last else len(ids) // BUCKET * BUCKET
            for at in range(0, upto, BUCKET):
                some = slice(at, min(at + BUCKET, upto))
                search.meet(np.array(ids[some], np.int64), _matrix(vecs[some], place[0]))
            waiting = (ids[upto:], vecs[upto:])

        def begin() -> Search:
            ids, vecs = waiting
            nothing = np.empty(0, np.int64), np.empty((0, place[0]))
            made = Search(np.array(ids, np.int64), _matrix(vecs, place[0]), k, sent.value.get(place[0], nothing))
            made.twins = np.array([xxhash.xxh64_intdigest(v) >> 1 for v in vecs], np.int64)
            return made

        for batch in pieces(batches):
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            ids, vecs = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            turns = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1) | (asks[1:] != asks[:-1])) + 1
            edges = [0, *turns.tolist(), len(ids)]
            for at, upto in zip(edges, edges[1:]):
                if tuple(keys[at]) != place:
                    if search is not None:
                        flush(True)
                        yield from emptied(search)
                    place, search, waiting = tuple(keys[at]), None, ([], [])
                if not asks[at] and search is None:
                    search, waiting = begin(), ([], [])
                waiting[0].extend(ids[at:upto])
                waiting[1].extend(vecs[at:upto])
                if search is not None:
                    flush(False)
        if search is not None:
            flush(True)
            yield from emptied(search)

    return run
