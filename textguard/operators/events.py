"""Security events: the log, its feed, counts per time window, latency percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from textguard.session import written

EVENT_SCHEMA = "event_time timestamp, source_id string, kind string, rule_id string, matches bigint"


def as_events(findings: DataFrame, key: str, event_time: Column) -> DataFrame:
    """Findings as rows of the event log."""
    return findings.select(
        event_time.cast("timestamp").alias("event_time"),
        F.col(key).cast("string").alias("source_id"),
        "kind",
        "rule_id",
        "matches",
    )


def append_events(events: DataFrame, path: str, batch: str | None = None) -> None:
    """Append to the log, one folder per day, so that a feed reads only the days it asks for.

    Rebalancing by day keeps the files few; Spark splits a day that is large. ``batch`` names
    what is appended: appending it again overwrites the folders it has, so a rerun does not
    double it. A log is written either always with or always without names.
    """
    daily = events.withColumn("event_day", F.to_date("event_time"))
    if batch is None:
        daily.hint("rebalance", "event_day").write.mode("append").partitionBy("event_day").parquet(path)
        return
    named = daily.withColumn("batch", F.lit(batch)).hint("rebalance", "event_day")
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "event_day", "batch"
    ).parquet(path)


def append_stream(
    events: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append a stream to the log; a micro-batch that is run again overwrites its own events."""
    writer = events.writeStream.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(lambda rows, n: append_events(rows, path, f"{n:010d}")).start()


def event_feed(
    events: DataFrame,
    time: str = "event_time",
    since: object = None,
    until: object = None,
    **equals: Sequence[object],
) -> DataFrame:
    """Events in ``[since, until)`` whose named columns hold one of the given values.

    Of a log with day folders only the days asked for are read.
    """
    days = "event_day" in events.columns and time == "event_time"
    if since is not None:
        events = events.filter(F.col(time) >= F.lit(since))
        if days:
            events = events.filter(F.col("event_day") >= F.lit(since).cast("date"))
    if until is not None:
        events = events.filter(F.col(time) < F.lit(until))
        if days:
            events = events.filter(F.col("event_day") <= F.lit(until).cast("date"))
    for name, values in equals.items():
        events = events.filter(F.col(name).isin(*values))
    return events


def window_counts(
    events: DataFrame, time: str, by: Sequence[str], length: str = "1 hour"
) -> DataFrame:
    """Events per tumbling window: ``window_start``, the ``by`` columns, ``n``."""
    return (
        events.groupBy(F.window(time, length).alias("w"), *by)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), *by, "n")
    )


def percentiles(
    frame: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    in_order: int = 1_000_000,
) -> DataFrame:
    """Exact interpolated percentiles: the ``by`` columns, ``prob``, ``value``.

    Equal values are counted first, so a value that fills the table is one row. Where no group
    has more than ``in_order`` different values, each group's counts are summed in order. Beyond
    that the counts of all groups are ranged by value over all tasks and the sums of the ranges
    before are added, so no task puts a whole group in order. Both ways are exact, and neither
    repeats. Repeated ``probs`` give repeated rows.
    """
    by = list(by)
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    values = frame.select(group.alias("_g"), *by, F.col(value).cast("double").alias("_v"))
    counts = values.filter("_v IS NOT NULL").groupBy("_g", *by, "_v").agg(F.count("*").alias("_c"))
    counts = written(counts, "value-counts")
    sizes = counts.groupBy("_g").agg(F.count("*").alias("_different"), F.sum("_c").alias("_n"))
    sizes = written(sizes, "group-sizes")
    if (sizes.agg(F.max("_different")).first()[0] or 0) > in_order:
        placed = counts.repartitionByRange(_parts(frame), "_g", "_v")
        placed = written(placed.withColumn("_part", F.spark_partition_id()), "ranges")
        earlier = Window.partitionBy("_g").orderBy("_part")
        sums = placed.groupBy("_g", "_part").agg(F.sum("_c").alias("_sum"))
        before = F.sum("_sum").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.select("_g", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
        counts = placed.join(sums, ["_g", "_part"])
        order = Window.partitionBy("_g", "_part").orderBy("_v")
    else:
        counts = counts.withColumn("_before", F.lit(0))
        order = Window.partitionBy("_g").orderBy("_v")
    upto = F.col("_before") + F.sum("_c").over(order)
    wanted = F.explode(F.array(*(F.lit(float(p)) for p in dict.fromkeys(probs))))
    rank = (F.col("_n") - 1) * F.col("prob")
    at = F.floor(rank)
    ranked = counts.withColumn("_upto", upto).join(sizes, "_g").withColumn("prob", wanted)

    def value_at(position: Column) -> Column:
        holds = (position >= F.col("_upto") - F.col("_c")) & (position < F.col("_upto"))
        return F.max(F.when(holds, F.col("_v")))

    picked = ranked.groupBy("_g", *by, "prob").agg(
        value_at(at).alias("_a"),
        value_at(F.least(at + 1, F.col("_n") - 1)).alias("_b"),
        F.first(rank - at).alias("_f"),
    )
    found = picked.select(
        *by, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("value")
    )
    times = {float(p): list(probs).count(p) for p in probs}
    if max(times.values(), default=1) == 1:
        return found
    repeats = F.element_at(F.create_map(*(F.lit(x) for kv in times.items() for x in kv)), F.col("prob"))
    return found.withColumn("_i", F.explode(F.sequence(F.lit(1), repeats))).drop("_i")


def sketches(frame: DataFrame, value: str, by: Sequence[str], k: int = 400) -> DataFrame:
    """A KLL sketch of the values of each group, to be stored as a table and merged later.

    A sketch has a bounded size and is combined before the shuffle, so a group may be of any size.
    Values that are NULL or NaN take no part; a group without any other has no sketch.
    """
    values = frame.select(*by, F.col(value).cast("double").alias("_v"))
    values = values.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return values.groupBy(*by).agg(F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"))


def merged(stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stored sketches merged over the columns that ``by`` leaves out, as days into a month."""
    return stored.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_percentiles(stored: DataFrame, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Values of the group near the wanted ranks: ``by``, ``prob``, ``value``.

    With the default ``k`` a value's rank is off by under 1 % of the group, at 99 % confidence;
    ``percentiles`` is the exact form.
    """
    probs = [float(p) for p in dict.fromkeys(probs)]
    values = F.array(*(F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for p in probs))
    each = F.arrays_zip(F.array(*map(F.lit, probs)).alias("prob"), values.alias("value"))
    return stored.select(*by, F.inline(each).alias("prob", "value"))


def _parts(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
