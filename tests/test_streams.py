import datetime as dt

from pyspark.sql import functions as F

from textguard.functions import egress, inbound
from textguard.operators import events, findings
from textguard.plans import planted
from textguard.streaming import streams


def _rows(spark, start, end):
    return spark.range(start, end).withColumn("s", F.lit("text")).select(
        "id", planted.with_phrase("s", F.col("id")).alias("t")
    )


def _run(stream, path, folder, **more):
    streams.append_to(stream, path, str(folder / "progress"), available_now=True, **more).awaitTermination()


def test_restarted_stream_gives_the_batch_result(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for step in range(3):
        _rows(spark, step * 50, step * 50 + 50).write.mode("append").parquet(source)
        stream = streams.read_files(spark, source, spark.read.parquet(source).schema, per_trigger=2)
        _run(streams.sanitized(stream, "t"), out, tmp_path)
    batch = _rows(spark, 0, 150).select(
        "id", inbound.sanitize("t").alias("t"), inbound.hit("t").alias("threat")
    )
    assert sorted(spark.read.parquet(out).collect()) == sorted(batch.collect())


def test_block_and_allow_rows_part(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _rows(spark, 0, 160).write.parquet(source)
    stream = streams.read_files(spark, source, spark.read.parquet(source).schema)
    _run(streams.decided(stream, "t"), out, tmp_path, partition_by="action")
    blocked = spark.read.parquet(f"{out}/action=BLOCK")
    allowed = spark.read.parquet(f"{out}/action=ALLOW")
    batch = egress.with_dlp_report(_rows(spark, 0, 160), "t")
    assert blocked.count() == batch.filter("action = 'BLOCK'").count() > 0
    assert allowed.count() + blocked.count() == 160
    assert not blocked.filter("safe").count()


def test_event_log_from_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "log")
    _rows(spark, 0, 160).write.parquet(source)
    stream = streams.read_files(spark, source, spark.read.parquet(source).schema)
    day = F.date_add(F.lit("2024-03-01").cast("date"), (F.col("id") % 3).cast("int"))
    log = events.as_events(findings.findings(stream, "id", "t"), "id", day)
    log = log.withColumn("event_day", F.to_date("event_time"))
    _run(log, out, tmp_path, partition_by="event_day")
    back = spark.read.parquet(out)
    batch = events.as_events(findings.findings(_rows(spark, 0, 160), "id", "t"), "id", day)
    assert sorted(back.drop("event_day").collect()) == sorted(batch.collect())
    assert back.select("event_day").distinct().count() == 3


def _events(spark, minutes, kind):
    at = F.timestamp_add("MINUTE", F.col("m"), F.lit("2024-05-01 00:00:00").cast("timestamp"))
    frame = spark.createDataFrame([(m,) for m in minutes], "m int")
    return frame.select(at.cast("timestamp_ntz").alias("ts"), F.lit(kind).alias("kind"))


def test_live_counts(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "counts")

    def step(minutes, kind):
        _events(spark, minutes, kind).coalesce(1).write.mode("append").parquet(source)
        stream = streams.read_files(spark, source, spark.read.parquet(source).schema)
        counts = streams.counted(stream, "ts", ["kind"], "1 hour", "30 minutes")
        streams.keep_counts(counts, out, str(tmp_path / "progress"), available_now=True).awaitTermination()
        rows = streams.current_counts(spark, out, ["kind"]).collect()
        return {(r.window_start.hour, r.kind): r.n for r in rows}

    assert streams.current_counts(spark, out, ["kind"]).isEmpty()  # nothing is written yet
    assert step([1, 2, 61], "a") == {(0, "a"): 2, (1, "a"): 1}  # the open window is there too
    assert step([3, 62, 170], "b") == {(0, "a"): 2, (0, "b"): 1, (1, "a"): 1, (1, "b"): 1, (2, "b"): 1}
    today, later = dt.date(2024, 5, 1), dt.date(2024, 5, 2)
    assert streams.current_counts(spark, out, ["kind"], since=today).count() == 5
    assert streams.current_counts(spark, out, ["kind"], since=later).isEmpty()
    # Minute 170 closed everything before 140: the late row is dropped, the others count.
    assert step([4, 175, 150], "a") == {
        (0, "a"): 2, (0, "b"): 1, (1, "a"): 1, (1, "b"): 1, (2, "b"): 1, (2, "a"): 2
    }


def test_a_closed_day_is_compacted(spark, tmp_path):
    source, out, old = (str(tmp_path / n) for n in ("in", "counts", "old"))
    rows = _events(spark, range(0, 600, 7), "a")
    rows.write.parquet(source)
    stream = streams.read_files(spark, source, rows.schema)
    counts = streams.counted(stream, "ts", ["kind"], "1 hour", "30 minutes")
    streams.keep_counts(counts, out, str(tmp_path / "p"), available_now=True).awaitTermination()
    streams.compact(spark, out, ["kind"], dt.date(2024, 5, 1), old)
    before = streams.current_counts(spark, out, ["kind"])
    assert sorted(spark.read.parquet(old).collect()) == sorted(before.collect())


def test_appending_a_batch_again_does_not_double_it(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.range(50).select(
        F.timestamp_seconds(F.col("id") * 40_000).alias("event_time"), F.col("id").cast("string").alias("source_id")
    )
    for batch in ("a", "b", "a"):
        events.append_events(rows, log, batch)
    feed = events.event_feed(spark.read.parquet(log), since="1970-01-03", until="1970-01-05")
    assert spark.read.parquet(log).count() == 100
    assert feed.count() == 2 * rows.filter("event_time >= '1970-01-03' AND event_time < '1970-01-05'").count()
    plan = feed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_day" in plan


def test_stream_and_batch_windows_agree(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "counts")
    rows = _events(spark, range(0, 600, 7), "a")
    rows.write.parquet(source)
    stream = streams.read_files(spark, source, rows.schema)
    counts = streams.counted(stream, "ts", ["kind"], "1 hour", "30 minutes")
    streams.keep_counts(counts, out, str(tmp_path / "p"), available_now=True).awaitTermination()
    batch = events.window_counts(rows, "ts", ["kind"])
    found = streams.current_counts(spark, out, ["kind"])
    text = F.date_format("window_start", "HH:mm").alias("w")
    assert sorted(found.select(text, "kind", "n").collect()) == sorted(batch.select(text, "kind", "n").collect())


def test_merged_sketches_are_near_the_exact_percentiles(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 3).alias("g"), (F.col("id") % 30).alias("day"),
        F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 11 == 0, float("nan"))
        .otherwise((F.hash("id") % 10_000).cast("double")).alias("v"),
    )
    stored = events.sketches(rows, "v", ["g", "day"])
    merged = events.merged(stored, ["g"])
    found = events.sketched_percentiles(merged, [0.1, 0.5, 0.99, 0.5], ["g"]).collect()
    assert len(found) == 9
    kept = rows.filter("v IS NOT NULL AND NOT isnan(v)").toPandas()
    for r in found:
        values = kept[kept.g == r.g].v
        assert abs((values <= r.value).mean() - r.prob) < 0.015
    nothing = events.sketches(rows.withColumn("v", F.lit(None).cast("double")), "v", ["g"])
    assert events.sketched_percentiles(nothing, [0.5], ["g"]).collect() == []
