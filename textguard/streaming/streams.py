"""The row-level functions on streams, and live counts per time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textguard.functions import egress, inbound
from textguard.plans.flows import MakeScorer, text_flow
from textguard.sources.rules import DLP, Rule


def read_files(spark: SparkSession, path: str, schema: StructType, per_trigger: int | None = None):
    """A stream of the parquet files that arrive under ``path``."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def sanitized(stream: DataFrame, text: str, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Replace ``text`` by its sanitised form and say in ``threat`` whether it was flagged."""
    return stream.withColumn(text, inbound.sanitize(text, rules)).withColumn(
        "threat", inbound.flagged(text)
    )


def decided(stream: DataFrame, payload: str, rules: Sequence[Rule] = DLP) -> DataFrame:
    """Add the leak report; written with ``partition_by='action'``, BLOCK and ALLOW rows part."""
    return egress.with_dlp_report(stream, payload, rules)


def counted(
    stream: DataFrame, time: str | Column, by: Sequence[str], length: str, late: str
) -> DataFrame:
    """Events per tumbling window. Rows more than ``late`` behind the newest one are dropped."""
    time = F.col(time) if isinstance(time, str) else time
    return (
        stream.withColumn("_time", time.cast("timestamp"))
        .withWatermark("_time", late)
        .groupBy(F.window("_time", length).alias("_w"), *by)
        .agg(F.count("*").alias("n"))
        .select(F.col("_w.start").alias("window_start"), *by, "n")
    )


def append_to(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    partition_by: str | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Append to parquet files, each row once whatever fails and restarts."""
    writer = stream.writeStream.outputMode("append").format("parquet").option(
        "checkpointLocation", checkpoint
    )
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def keep_counts(
    counts: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Keep window counts current under ``path``; read them with ``current_counts``.

    Each batch writes the windows it changed to folders of its own, below those of their days. A
    batch that is run again overwrites its folders, so nothing is counted twice. Open windows
    are there from their first event on, which append mode would hold back.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        changed = batch.select(
            "*", F.to_date("window_start").alias("day"), F.lit(batch_id).alias("batch_id")
        )
        # Few files for each day and batch; Spark splits a day that is large.
        changed.hint("rebalance", "day").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("day", "batch_id").parquet(path)

    writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(write).start()


def current_counts(
    spark: SparkSession, path: str, by: Sequence[str], since: object = None
) -> DataFrame:
    """The newest count of each window; ``since`` reads only the days from that one on.

    ``by`` names columns, with their types (``"user_id bigint"``) where they are no strings. No
    counts yet is an empty result.
    """
    typed = [b if " " in b else f"{b} string" for b in by]
    by = [b.split()[0] for b in by]
    fields = ", ".join(["window_start timestamp", *typed, "n bigint", "day date", "batch_id bigint"])
    try:
        counts = spark.read.schema(fields).parquet(path)
    except AnalysisException:  # nothing was written yet
        counts = spark.createDataFrame([], fields)
    if since is not None:
        counts = counts.filter(F.col("day") >= F.lit(since))
    return counts.groupBy("window_start", *by).agg(F.max_by("n", "batch_id").alias("n"))


def compact(spark: SparkSession, path: str, by: Sequence[str], day: object, target: str) -> None:
    """Write the newest counts of a closed day to ``target``, in few files.

    A closed day gets no more counts; readers of old days read ``target`` from then on.
    """
    counts = current_counts(spark, path, by, day).filter(F.to_date("window_start") == F.lit(day))
    counts.hint("rebalance").write.mode("overwrite").parquet(target)


def guarded(
    stream: DataFrame,
    text: str,
    path: str,
    checkpoint: str,
    make_scorer: MakeScorer,
    model_name: str,
    rules: Sequence[Rule] | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Both passes on a stream: each micro-batch is sanitised, scored and written below ``path``.

    A batch that is run again overwrites its own folder, so each row is there once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        done = text_flow(batch, text, rules, make_scorer, model_name)
        done.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(write).start()
