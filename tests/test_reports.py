import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import brute
from textguard.operators import events, findings
from textguard.plans import planted
from textguard.sources import rules


@pytest.fixture(scope="module")
def frame(spark):
    return spark.range(320).withColumn("s", F.lit("text")).select(
        "id", (F.col("id") % 3).alias("g"), planted.with_phrase("s", F.col("id")).alias("t")
    )


def _counts(text):
    inbound = {
        r.rule_id: len(brute.re.findall(r.pattern, text)) for r in rules.INJECTION
    }
    return {**inbound, **brute.counts(text)}


def test_findings_and_monitor(frame):
    texts = {r.id: (r.g, r.t) for r in frame.collect()}
    expected = {
        (i, rule, n) for i, (_, t) in texts.items() for rule, n in _counts(t).items() if n
    }
    found = findings.findings(frame, "id", "t").collect()
    assert {(r.id, r.rule_id, r.matches) for r in found} == expected and len(found) == len(expected)

    off = rules.toggle(rules.INJECTION, sudo_rm=False)
    rows = findings.rule_monitor(frame, "t", off + rules.DLP, by=["g"]).collect()
    assert len(rows) == 3 * 9
    for r in rows:
        hits = [n for g, t in texts.values() if g == r.g and (n := _counts(t)[r.rule_id])]
        assert (r.hits, r.texts_hit) == (sum(hits), len(hits))
    empty = findings.rule_monitor(frame.filter("id < 0"), "t").collect()
    assert len(empty) == 10 and all((r.hits, r.texts_hit) == (0, 0) for r in empty)


def test_a_changed_detector_is_counted_as_written(frame):
    changed = rules.Rule("api_key", 1, "dlp", "pii_leak_prevention", "curl")
    row = findings.rule_monitor(frame, "t", [changed]).first()
    assert row.hits == frame.filter(F.contains("t", F.lit("curl"))).count()


def test_overview(frame):
    row = findings.overview(frame, "t", "t").first()
    texts = [r.t for r in frame.collect()]
    assert row.requests == 320
    assert row.injections_blocked == sum("[SECURITY SANITIZATION" in brute.clean(t) for t in texts)
    assert row.dlp_events == sum(any(brute.counts(t).values()) for t in texts)


def test_event_log(spark, frame, tmp_path):
    found = findings.findings(frame, "id", "t")
    day = F.timestamp_add("DAY", F.col("id") % 4, F.lit("2024-03-01 12:00:00").cast("timestamp"))
    path = str(tmp_path / "log")
    for kind in ("injection", "dlp"):
        events.append_events(
            events.as_events(found.filter(F.col("kind") == kind), "id", day), path
        )
    log = spark.read.parquet(path)
    assert log.count() == found.count()
    feed = events.event_feed(
        log, "event_day", dt.date(2024, 3, 2), dt.date(2024, 3, 3), rule_id=["api_key"]
    )
    assert {int(r.source_id) % 4 for r in feed.collect()} <= {1}
    plan = feed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_day" in plan
    assert "PushedFilters: [IsNotNull(rule_id), EqualTo(rule_id,api_key)]" in plan


@pytest.mark.parametrize("kind", ["spread", "hot"])
def test_percentiles_are_exact(spark, kind):
    rnd = np.random.default_rng(4)
    values = {
        "spread": rnd.normal(size=30_000),
        "hot": np.where(rnd.random(30_000) < 0.6, 7.0, rnd.random(30_000) * 20),
    }[kind]
    groups = np.where(np.arange(30_000) % 3 > 0, "big", (np.arange(30_000) % 30).astype(str))
    frame = spark.createDataFrame(
        [*zip(groups.tolist(), values.tolist()), ("big", None), ("1", 3.5)],
        "g string, v double",
    ).repartition(8)
    probs = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]

    def check(rows, by_group):
        for r in rows:
            mine = values[groups == r.g] if by_group else np.append(values, 3.5)
            mine = [3.5] if by_group and r.g == "1" else mine
            assert r.value == pytest.approx(np.quantile(mine, r.prob), rel=1e-12, abs=1e-12)

    rows = events.percentiles(frame, "v", probs, by=["g"]).collect()
    assert len(rows) == 6 * (len(set(groups)) + 1)
    check(rows, True)
    check(events.percentiles(frame, "v", probs, in_order=100).collect(), False)
    check(events.percentiles(frame, "v", probs, by=["g"], in_order=50).collect(), True)


@pytest.mark.parametrize("in_order", [10, 10_000])
def test_percentiles_of_equal_values_and_repeated_probs(spark, in_order):
    n = F.col("id")
    frame = spark.range(20_000).select(F.when(n < 10_010, 0.0).otherwise(n).cast("double").alias("v"))
    rows = events.percentiles(frame, "v", [0.5, 0.5, 0.75], in_order=in_order).collect()
    values = np.where(np.arange(20_000) < 10_010, 0.0, np.arange(20_000))
    want = [np.quantile(values, p) for p in (0.5, 0.5, 0.75)]
    assert sorted(r.value for r in rows) == pytest.approx(sorted(want))
    assert events.percentiles(frame.limit(0), "v", [0.5], in_order=in_order).isEmpty()

