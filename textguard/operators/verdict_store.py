"""Verdicts kept between runs, so that a text is scored once for each model and version.

The store is a table of folders: model and version, then buckets of the hash, then the run that
added the rows. A run reads only the hashes of its model and version, scores what they lack, and
writes a folder of its own in each bucket; run again under its name it starts from the same
known verdicts and overwrites what it wrote, so nothing is kept twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.operators import second_pass as second
from textguard.session import written

SCHEMA = "text_hash string, verdict string, model_name string, version string, bucket int, run string"
#: Folders of a model's hashes. Both sides of a look-up know them, so files of few buckets suffice.
BUCKETS = 16


def _bucket(text_hash: str) -> Column:
    return F.conv(F.substring(text_hash, 1, 2), 16, 10).cast("int") % BUCKETS


def _place(value: str) -> str:
    """A name as it may stand in a folder's name, different names differently."""
    return "".join(c if c.isalnum() and c.isascii() else f"_{ord(c):x}_" for c in value) or "_"


def known(spark: SparkSession, path: str, model_name: str, version: str, but: str | None = None) -> DataFrame:
    """``text_hash`` and ``verdict`` of one model and version, without those of the run ``but``.

    A store that nothing was written to yet has none; a folder that cannot be read is an error.
    """
    try:
        rows = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SCHEMA)
    mine = rows.filter((F.col("model_name") == _place(model_name)) & (F.col("version") == _place(version)))
    if but is not None:
        mine = mine.filter(F.col("run") != _place(but))
    # Runs that ran at the same time may both have a hash.
    return mine.groupBy("text_hash").agg(F.min("verdict").alias("verdict"))


def score(
    prompts: DataFrame,
    make_scorer: Callable[[str], second.Scorer],
    model_name: str,
    path: str,
    run: str,
    version: str = "1",
    batch_rows: int = 64,
    seconds: float = 5.0,
) -> DataFrame:
    """Verdicts of all ``prompts``, of which only those that the store lacks are scored.

    ``prompts`` comes from ``second_pass.candidates`` and is read more than once. Known hashes
    and missing ones are told apart by a join of hashes; texts meet only the missing. New answers
    are added to the store under ``run``; a text without an answer is not, so a later run asks
    again. ``version`` names what else a verdict depends on, such as the instruction.
    """
    spark = prompts.sparkSession
    prompts = written(prompts.select("text_hash", "prompt"), "prompts")
    stored = written(known(spark, path, model_name, version, but=run), "known-verdicts")
    found = prompts.select("text_hash").join(stored, "text_hash").withColumn("status", F.lit("ok"))
    missing = prompts.join(stored.select("text_hash"), "text_hash", "left_anti")
    scored = second.score(missing, make_scorer, model_name, batch_rows, seconds=seconds)
    fresh = scored.filter("status = 'ok'").select(
        "text_hash", "verdict", F.lit(_place(model_name)).alias("model_name"), F.lit(_place(version)).alias("version"),
        _bucket("text_hash").alias("bucket"), F.lit(_place(run)).alias("run"),
    )
    keys = ("model_name", "version", "bucket", "run")
    fresh.hint("rebalance", "bucket").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*keys).parquet(path)
    return found.unionByName(scored)
