"""Live sums with late rows and closed days, and two sinks, against one batch over all rows."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from textguard.functions import egress
from textguard.plans import planted
from textguard.streaming import live, streams

START = dt.datetime(2024, 5, 1)
SCHEMA = "id bigint, ts timestamp, kind string"


def _rows(spark, rows):
    """(id, minutes after the start or None, kind)."""
    made = [(i, None if m is None else START + dt.timedelta(minutes=m), k) for i, m, k in rows]
    return spark.createDataFrame(made, SCHEMA)


def _sums(path):
    measures = {"n": F.count("*"), "big": F.count_if(F.col("id") > 4)}
    return live.Sums(str(path), "ts", "1 hour", "30 minutes", ("kind string",), measures)


def _state(spark, sums):
    found = sums.current(spark).collect()
    return {(int((r.window_start - START).total_seconds() // 3600), r.kind): (r.n, r.big) for r in found}


def test_counts_and_late_rows_are_all_events(spark, tmp_path):
    sums = _sums(tmp_path / "s")
    assert _state(spark, sums) == {} and sums.late_rows(spark, SCHEMA).isEmpty()
    first = _rows(spark, [(0, 1, "a"), (1, 2, None), (2, 61, "a"), (3, None, "a")])
    second = _rows(spark, [(4, 3, "a"), (5, 170, "a")])  # 3: the newest was 61, so still open
    third = _rows(spark, [(6, 4, "a"), (7, 119, "a"), (8, 175, "b")])  # the edge is 140: 4, 119 late
    for n, batch in enumerate((first, second, third)):
        sums.write(batch, n)
    want = {(0, "a"): (2, 0), (0, None): (1, 0), (1, "a"): (1, 0), (2, "a"): (1, 1), (2, "b"): (1, 1)}
    assert _state(spark, sums) == want
    late = {(r.id, r.why, r.batch_id) for r in sums.late_rows(spark, SCHEMA).collect()}
    assert late == {(3, "no time", 0), (6, "late", 2), (7, "late", 2)}
    sums.write(third, 2)  # run again
    assert _state(spark, sums) == want and sums.late_rows(spark, SCHEMA).count() == 3
    sums.write(third.limit(0), 3)
    assert _state(spark, sums) == want


def test_closed_days_take_the_place_of_their_parts(spark, tmp_path):
    sums = _sums(tmp_path / "s")
    batches = [
        _rows(spark, [(n * 10 + k, n * 450 + k * 37, "ab"[k % 2]) for k in range(8)]) for n in range(14)
    ]
    for n, batch in enumerate(batches):
        sums.write(batch, n, tidy_every=4)
    everything = sum((_rows_of(b) for b in batches), [])
    late = {r.id for r in sums.late_rows(spark, SCHEMA).collect()}
    want = {}
    for i, m, k in everything:
        if i not in late:
            n, big = want.get((m // 60, k), (0, 0))
            want[m // 60, k] = (n + 1, big + (i > 4))
    assert _state(spark, sums) == want
    closed = {p.name for p in Path(sums.path, "closed").glob("day=*")}
    parts = {p.name for p in Path(sums.path, "open").glob("day=*")}
    assert {f"day=2024-05-0{d}" for d in (1, 2, 3)} <= closed
    assert parts and "day=2024-05-01" not in parts  # folders do not grow with the batches
    assert sum(1 for _ in Path(sums.path, "marks").glob("slot=*")) == 2
    since = sums.current(spark, dt.date(2024, 5, 4)).agg(F.sum("n")).first()[0]
    assert since == sum(n for (h, _), (n, _) in want.items() if h >= 72)
    # The last batch again, after its days were closed and tidied.
    sums.write(batches[-1], 13, tidy_every=1)
    sums.tidy(spark, 14)
    assert _state(spark, sums) == want


def _rows_of(frame):
    return [(r.id, int((r.ts - START).total_seconds() // 60), r.kind) for r in frame.collect()]


def test_a_failure_between_closing_and_removing_doubles_nothing(spark, tmp_path, monkeypatch):
    sums = _sums(tmp_path / "s")
    for n, minutes in enumerate((5, 3000, 6000)):
        sums.write(_rows(spark, [(n, minutes, "a")]), n)
    before = _state(spark, sums)

    def fails(*_):
        raise OSError("no such node")

    sums.tidy(spark, 3)  # closes
    assert _state(spark, sums) == before
    monkeypatch.setattr(live, "_remove", fails)
    with pytest.raises(OSError):
        sums.tidy(spark, 3)
    assert _state(spark, sums) == before
    monkeypatch.undo()
    sums.tidy(spark, 3)
    sums.tidy(spark, 3)
    assert _state(spark, sums) == before
    assert not Path(sums.path, "open", "day=2024-05-01").exists()


def test_a_stream_restarted(spark, tmp_path):
    source, sums = str(tmp_path / "in"), _sums(tmp_path / "s")
    for step in range(3):
        rows = _rows(spark, [(step * 100 + k, step * 50 + k, "a") for k in range(60)])
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = streams.read_files(spark, source, rows.schema, per_trigger=1)
        sums.start(stream, str(tmp_path / "p"), True, 2).awaitTermination()
    counted = sums.current(spark).agg(F.sum("n")).first()[0]
    assert counted + sums.late_rows(spark, SCHEMA).count() == 180


def test_levels(spark):
    rows = spark.createDataFrame([("x", 1, 2), ("x", 2, 3), (None, 1, 4)], "s string, d int, n bigint")
    found = {(r.level, r.s, r.d, r.n) for r in live.levels(rows, ["s", "d"], ["n"]).collect()}
    assert found == {
        ("", None, None, 9), ("s", "x", None, 5), ("s", None, None, 4), ("d", None, 1, 6), ("d", None, 2, 3),
        ("s,d", "x", 1, 2), ("s,d", "x", 2, 3), ("s,d", None, 1, 4),
    }
    assert live.levels(rows.limit(0), ["s"], ["n"]).collect() == []


def test_only_a_missing_table_is_an_empty_one(spark, tmp_path):
    assert live.read_or_empty(spark, str(tmp_path / "none"), "a int").isEmpty()
    spark.range(1).write.parquet(str(tmp_path / "some"))
    with pytest.raises(AnalysisException):
        live.read_or_empty(spark, str(tmp_path / "some"), "a int, a int").collect()


def test_two_sinks_and_a_batch_run_again(spark, tmp_path, monkeypatch):
    source, bad, good = (str(tmp_path / n) for n in ("in", "bad", "good"))
    rows = spark.range(160).withColumn("s", F.lit("text")).select(
        "id", planted.with_phrase("s", F.col("id")).alias("t")
    )
    rows.write.parquet(source)
    want = {r.id: r.action for r in egress.with_dlp_report(rows, "t").collect()}

    def run():
        stream = streams.read_files(spark, source, rows.schema)
        live.part_by_action(stream, "t", bad, good, str(tmp_path / "p"), available_now=True).awaitTermination()
        return {p: {(r.id, r.action) for r in spark.read.parquet(p).collect()} for p in (bad, good)}

    got = run()
    assert got[bad] == {i for i in want.items() if i[1] == "BLOCK"} and got[bad]
    assert got[good] == {i for i in want.items() if i[1] == "ALLOW"} and got[good]
    for commit in (tmp_path / "p" / "commits").iterdir():  # as if the batch had not been confirmed
        commit.unlink()
    assert run() == got
    assert spark.read.parquet(bad).count() + spark.read.parquet(good).count() == 160


def test_a_batch_without_late_rows_is_worked_out_once(spark, tmp_path):
    worked = spark.sparkContext.accumulator(0)

    @F.udf("timestamp")
    def at(n):
        worked.add(1)
        return dt.datetime(2024, 1, 1, n % 5, 30)

    rows = spark.range(100).select(F.lit("a").alias("kind"), at(F.col("id").cast("int")).alias("ts"))
    sums = live.Sums(str(tmp_path), "ts", "1 hour", "30 minutes", ("kind string",), {"n": F.count("*")})
    sums.write(rows, 0)
    assert worked.value == 100
    assert [r.n for r in sums.current(spark).collect()] == [20] * 5
