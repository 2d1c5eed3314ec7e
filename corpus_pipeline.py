"""The corpus pipeline: stages over documents, each written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm import bpe, mixing, pii, quality, simhash
from textguard.llm.queries import KEY
from textguard.session import spread, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the line labels keep, with their own columns.

    Null and empty texts go, as they have too few words; repeated rows share their verdict, whole
    texts of any length are judged, and an empty table stays empty.
    """
    docs = spread(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.keep(docs, quality.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, as the SimHash operator's query finds them.

    Fingerprints of three-word shingles that differ in at most 3 bits link, and groups reach as
    far as links do. The smallest doc_id of a group stays, null last; of repeated rows and texts
    one; all texts without words are one group.
    """
    return simhash.one_of_each(spread(docs), shingle=3, distance=3, prints=1)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; ``n_chars`` counts the new text.

    A null text stays null, an empty one empty; repeated rows get the same surrogates.
    """
    made = pii.pseudonymised(spread(docs), KEY, count="__count").drop("__count")
    return made.withColumn("n_chars", F.char_length("text").cast("long"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to 3 times, as they are.

    A document without words is taken once; a null source is a source of its own.
    """
    return mixing.repeated(spread(docs), ["doc_id"])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and whether they decode to the text again; null is empty."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(spread(docs), path, public_tokenizers.PATTERN, lossless="lossless")
    return encoded.withColumn("n_tokens", F.size("ids").cast("long")).drop("text")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing_sources", mixing_sources),
    ("tokens", tokens),
]

#: Line labels, SimHash, keyed surrogates and merges cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
