"""Toxicity scores by a classifier that is held to the same score when identities are swapped."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.llm.common import Columns, append, one_text_each, texts

#: Buckets of hashed words, words the model may use, labelled rows it is fitted on, the longest
#: text among these in bytes.
BUCKETS, USED, SAMPLE, SAMPLE_BYTES = 1 << 18, 400, 20_000, 100_000
#: Weight of the squared change of a score under a swap, and of the absolute weights.
SWAP_PENALTY, SPARSITY = 10.0, 1e-4

#: Identity terms by kind; a term is swapped for another of its kind.
IDENTITIES = (
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("female", "male", "nonbinary", "transgender"),
    ("gay", "lesbian", "straight", "bisexual", "heterosexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled", "autistic"),
    ("frau", "mann"),
    ("femme", "homme"),
    ("mujer", "hombre"),
)
_KIND = {term: kind for kind in IDENTITIES for term in kind}
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    bias: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)

    def score(self, text: str) -> float:
        get = self.weights.get
        total = self.bias + sum(get(b, 0.0) for b in word_buckets(set(words(text))))
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall(text.lower())


def word_buckets(found: set[str]) -> set[int]:
    return {zlib.crc32(w.encode()) % BUCKETS for w in found}


def swapped(found: list[str]) -> list[str] | None:
    """The words with each identity term replaced by another of its kind; None without any.

    The text itself picks the replacement, so a rerun swaps alike.
    """
    terms = sorted({w for w in found if w in _KIND})
    if not terms:
        return None
    turn = zlib.crc32(" ".join(terms).encode())
    other = {w: _KIND[w][(_KIND[w].index(w) + 1 + turn % (len(_KIND[w]) - 1)) % len(_KIND[w])] for w in terms}
    return [other.get(w, w) for w in found]


def train(rows: list[tuple[np.ndarray, np.ndarray | None, int]], rounds: int = 400) -> Model:
    """Sparse logistic regression with a penalty on score changes under swaps.

    ``rows`` have the buckets of a text, those of its swapped form (or None) and the label. Only
    the ``USED`` buckets that tell labels apart best are used. Accelerated proximal gradient; the
    same rows give the same model. Without both labels every score is the share of label 1.
    """
    y = np.array([r[2] for r in rows], np.float32)
    n, hot = len(rows), int(y.sum()) if len(y) else 0
    if not n or hot in (0, n):
        share = np.clip((hot + 0.5) / (n + 1), 0.01, 0.99)
        return Model(float(np.log(share / (1 - share))))
    seen = np.zeros((2, BUCKETS))
    for found, _, label in rows:
        seen[label, found] += 1
    total = seen.sum(0)
    expected = total * hot / n
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = expected * (1 - hot / n) * (1 - total / n)
        signal = np.where((total >= 3) & (spread > 0), (seen[1] - expected) ** 2 / spread, 0)
    used = np.argsort(-signal, kind="stable")[:USED]
    used = used[signal[used] > 0]
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))

    def matrix(lists: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(lists), len(used)), np.float32)
        for i, found in enumerate(lists):
            at = place[found]
            out[i, at[at >= 0]] = 1
        return out

    x = matrix([r[0] for r in rows])
    pairs = [r for r in rows if r[1] is not None]
    change = matrix([r[0] for r in pairs]) - matrix([r[1] for r in pairs]) if pairs else np.zeros((0, len(used)))
    change = change[np.abs(change).any(1)]
    # Labels weigh the same, so that a rare label is not given up for a common one.
    weight = np.where(y == 1, 0.5 / hot, 0.5 / (n - hot)).astype(np.float32)
    bound = 0.25 * _norm(x * np.sqrt(weight)[:, None]) + 2 * SWAP_PENALTY * _norm(change) / max(1, len(change)) + 0.25
    w, b = np.zeros(len(used), np.float32), 0.0
    ahead, ahead_b, t = w.copy(), b, 1.0
    for _ in range(rounds):
        # Single precision throughout: mixed with double the whole matrix would be copied each time.
        miss = weight * (1 / (1 + np.exp(-np.clip(x @ ahead + np.float32(ahead_b), -60, 60))) - y)
        slope = x.T @ miss
        if len(change):
            slope = slope + 2 * SWAP_PENALTY * (change.T @ (change @ ahead)) / len(change)
        new = ahead - (slope / bound).astype(np.float32)
        new = np.sign(new) * np.maximum(np.abs(new) - SPARSITY / bound, 0)
        new_b = ahead_b - miss.sum() / bound
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + np.float32((t - 1) / t_new) * (new - w)
        ahead_b = new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return Model(float(b), {int(k): float(v) for k, v in zip(used, w, strict=True) if v})


def _norm(x: np.ndarray) -> float:
    """Largest eigenvalue of x'x, by power iteration."""
    if not x.size:
        return 0.0
    v = np.full(x.shape[1], 1 / np.sqrt(x.shape[1]), np.float32)
    for _ in range(30):
        v = x.T @ (x @ v)
        size = float(np.linalg.norm(v))
        if not size:
            return 0.0
        v /= size
    return 1.05 * size


def held_out(key: str = "doc_id") -> Column:
    """Whether a row's labels are kept from the model: crc32 of the id as text is 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model fitted on at most ``sample`` labelled rows that are not held out.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``toxic`` (0 or 1). The sample
    has the smallest hashes of doc_id. Words are hashed where the texts are; only buckets come to
    the driver, those of texts of up to ``SAMPLE_BYTES`` bytes. Of rows with the same id the one
    whose text has the least hash is taken.
    """
    chosen = (
        labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL")
        .filter(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    sampled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sampled = sampled.filter(F.octet_length("text").between(1, SAMPLE_BYTES))
    sampled = one_text_each(sampled, "toxic")
    kind = T.ArrayType(T.IntegerType())

    def make() -> Callable[[pa.RecordBatch], Columns]:
        def columns(batch: pa.RecordBatch) -> Columns:
            plain, other = [], []
            for text in texts(batch, "text"):
                found = words(text)
                turned = swapped(found)
                plain.append(sorted(word_buckets(set(found))))
                other.append(None if turned is None else sorted(word_buckets(set(turned))))
            return {"buckets": pa.array(plain, pa.list_(pa.int32())), "swapped": pa.array(other, pa.list_(pa.int32()))}

        return columns

    made = append(sampled, make, [T.StructField("buckets", kind), T.StructField("swapped", kind)])
    found = made.select("doc_id", "buckets", "swapped", "toxic").toArrow()
    return train(_rows(found))


def _rows(found: pa.Table) -> list[tuple]:
    """Rows for ``train`` as arrays, in an order that does not depend on how they came."""
    found = found.combine_chunks()
    ids, labels = found["doc_id"].to_pylist(), found["toxic"].to_pylist()
    plain, other = ([v.values.to_numpy() if v.is_valid else None for v in found[c]] for c in ("buckets", "swapped"))
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    return [(plain[i], other[i], labels[i]) for i in order]


def scored(frame: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The frame with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) for each whole text.

    A null, empty or wordless text gets the score of no evidence. Columns of these names are
    replaced; repeated rows get repeated scores.
    """

    def make() -> Callable[[pa.RecordBatch], Columns]:
        return lambda batch: {"score": pa.array([model.score(t) for t in texts(batch, text)], pa.float64())}

    found = append(frame, make, [T.StructField("score", T.DoubleType())])
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
