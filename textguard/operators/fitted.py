"""A scorer fitted on labelled texts and applied by Spark itself, without a Python worker.

Multinomial naive Bayes over the counts of a text's words. Fitting is sums, combined before the
shuffle, so it reads all labelled texts; every word of theirs counts. The weights of the words are
a table: those of the most frequent words, a bounded number, are broadcast to the texts, and what
a text holds besides these meets the others in a join.
"""

from __future__ import annotations

import math

from pyspark.ml import Model, PipelineModel
from pyspark.ml.util import (
    DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import fixed
from textguard.operators.second_pass import VERDICT_SCHEMA
from textguard.session import written

#: Most words whose weights are broadcast, of the most frequent ones; the others are joined.
VOCABULARY = 1 << 18

_WEIGHTS = "word string, weight double, frequent boolean"


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)


class WordBayes(Model, MLWritable, MLReadable):
    """Adds ``prediction`` to rows with a ``text``, which itself is left out of the result.

    ``weights`` has for each word by how much it speaks for label 1; ``prior`` is that of no word.
    """

    def __init__(self, weights: DataFrame | None = None, prior: float = 0.0, joined: bool = False):
        super().__init__()
        self.weights, self.prior, self.joined = weights, prior, joined

    def _transform(self, dataset: DataFrame) -> DataFrame:
        carried = [c for c in dataset.columns if c != "text"]
        rows = dataset.withColumn("_row", F.monotonically_increasing_id())
        said = rows.select("_row", *carried, F.explode_outer(_words("text")).alias("word"))
        keys = ["_row", *carried]
        frequent = F.broadcast(self.weights.filter("frequent").drop("frequent"))
        met = said.join(frequent, "word", "left")
        total = F.coalesce(F.sum("weight"), F.lit(0.0)).alias("_sum")
        if self.joined:
            # Rows without such a word get one of their own that is in no table, not all the same.
            other = F.when(F.col("weight").isNull(), F.col("word"))
            other = F.coalesce(other, F.concat(F.lit("#"), "_row"))
            parts = met.groupBy(*keys, other.alias("word")).agg(total, F.count("*").alias("_times"))
            rest = self.weights.filter("NOT frequent").drop("frequent")
            more = F.col("_sum") + F.coalesce(F.col("weight") * F.col("_times"), F.lit(0.0))
            sums = parts.join(rest, "word", "left").groupBy(*keys).agg(F.sum(more).alias("_sum"))
        else:
            sums = met.groupBy(*keys).agg(total)
        label = F.when(F.col("_sum") + F.lit(self.prior) > 0, 1.0).otherwise(0.0)
        return sums.select(*carried, label.alias("prediction"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: WordBayes):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        about = {"prior": self.model.prior, "joined": self.model.joined}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=about)
        self.model.weights.write.parquet(f"{path}/weights")


class _Reader(MLReader):
    def load(self, path: str) -> WordBayes:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        weights = self.sparkSession.read.schema(_WEIGHTS).parquet(f"{path}/weights")
        model = WordBayes(weights, about["prior"], about["joined"])
        model._resetUid(about["uid"])
        return model


def fit(labelled: DataFrame, text: str, label: str, vocabulary: int = VOCABULARY) -> PipelineModel:
    """A model of the texts whose ``label`` is 1 (malicious) or 0; rows without either are left out.

    Words are runs of a-z in the lower-cased text. The model is a plain ``pyspark.ml`` one: it can
    be saved, and loaded where it is used. At most ``vocabulary`` words are broadcast.
    """
    rows = labelled.filter(F.col(text).isNotNull() & F.col(label).isin(0, 1))
    rows = written(rows.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label")), "labelled")
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    said = rows.select("label", F.explode(_words("text")).alias("word"))
    counts = written(
        said.groupBy("word").agg(
            F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")
        ),
        "words",
    )
    # How many words occur 1, 2 to 3, 4 to 7 times, and so on: a few rows.
    often = F.length(F.bin(F.col("n0") + F.col("n1"))).alias("often")
    levels = counts.groupBy(often).agg(F.count("*").alias("k"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    levels = sorted(levels.collect(), reverse=True)
    words, least = 0, 0
    for level in levels:
        words += level["k"]
        if words > vocabulary:
            least = level["often"] + 1
            break
    k = sum(level["k"] for level in levels)
    s0, s1 = (sum(level[c] for level in levels) + k for c in ("n0", "n1"))
    for_one = F.log((F.col("n1") + 1) / F.lit(s1)) - F.log((F.col("n0") + 1) / F.lit(s0))
    if len(n) == 2:
        prior = math.log((n[1] + 1) / (n[0] + 1))
    else:  # there is nothing to choose from
        for_one, prior = F.lit(0.0), 1.0 if 1 in n else -1.0
    weights = counts.select("word", for_one.alias("weight"), (often >= least).alias("frequent"))
    return PipelineModel([WordBayes(written(weights, "weights"), prior, least > 0)])


def score(candidates: DataFrame, model: PipelineModel, sanitized: str) -> DataFrame:
    """Verdicts of a fitted model: a verdict table as ``second_pass.score`` writes it.

    ``candidates`` has ``text_hash`` and the text itself, each distinct text once or more often;
    equal texts get equal verdicts.
    """
    rows = candidates.filter("text_hash IS NOT NULL").select("text_hash", F.col(sanitized).alias("text"))
    answer = F.when(F.col("prediction") == 1, fixed.BAD_VERDICT).otherwise("SAFE")
    judged = model.transform(rows).select("text_hash", answer.alias("verdict"), F.lit("ok").alias("status"))
    return written(judged.select(*(f.split()[0] for f in VERDICT_SCHEMA.split(", "))), "verdicts")
