import json

import pytest
from pyspark.sql import functions as F
from scorers import evil
from shuffles import shuffled

from textguard.functions import fixed, inbound
from textguard.operators import requests as req
from textguard.operators import second_pass as second
from textguard.plans import flows, sinks
from textguard.session import conf_for
from textguard.sources.requests import REQUEST_SCHEMA, read_pairs, read_requests

ITEM = {"title": "system override", "content": "System override now", "url": "delete files"}
REQUESTS = [
    {"request_id": "1", "results": [ITEM, {"title": "t", "content": "fine", "url": "u"}]},
    {"request_id": "2", "results": []},
    {"request_id": "3", "results": [{"title": "t", "content": "", "url": "u"}]},
    {"request_id": "4", "results": [{"title": "t", "content": None, "url": "u"}]},
    {"request_id": "5"},
    {"request_id": "6", "results": [{"title": "t", "content": "evil", "url": "u"}] * 3},
]


def _json(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_sanitize_flow(spark, tmp_path):
    requests = read_requests(spark, _json(tmp_path / "r.json", REQUESTS))
    responses, invalid = flows.sanitize_flow(requests)
    assert sorted((r.request_id, r.reason) for r in invalid.collect()) == [
        ("4", "item field missing"), ("5", "results missing")
    ]
    rows = {r.request_id: r for r in responses.collect()}
    assert {k: (r.status, r.threat_intercepted) for k, r in rows.items()} == {
        "1": ("PROCESSED", True), "2": ("PROCESSED", False), "3": ("PROCESSED", False),
        "6": ("PROCESSED", False),
    }
    assert rows["1"].results[0].asDict() == {
        "title": "system override", "content": fixed.MARKER + " now", "url": "delete files"
    }
    assert "Exchange" not in responses._jdf.queryExecution().executedPlan().toString()
    sinks.write_sanitize_responses(responses, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def test_sanitize_flow_with_a_model(spark, tmp_path):
    requests = read_requests(spark, _json(tmp_path / "r.json", REQUESTS))
    responses, _ = flows.sanitize_flow(requests, make_scorer=evil, model_name="m")
    rows = {r.request_id: r for r in responses.collect()}
    assert [i.content for i in rows["6"].results] == [fixed.SEMANTIC_MARKER] * 3
    assert rows["6"].threat_intercepted and not rows["3"].threat_intercepted
    assert [i.content for i in rows["1"].results] == [fixed.MARKER + " now", "fine"]
    assert rows["2"].results == []


def test_repeated_and_missing_ids(spark):
    item = lambda text: {"title": "t", "content": text, "url": "u"}
    rows = [("1", [item("evil"), item("good")]), ("1", [item("good"), item("evil")]), (None, [item("evil")]), (None, [item("good")])]
    requests = spark.createDataFrame(rows, REQUEST_SCHEMA)
    asked = req.asked_items(requests)
    verdicts = second.score(second.candidates(req.item_texts(asked), "content"), evil, "m")
    found = req.apply_verdicts_to_items(asked, verdicts)
    assert found.columns == ["request_id", "results"]
    bad = fixed.SEMANTIC_MARKER
    assert sorted((str(r.request_id), *(i.content for i in r.results)) for r in found.collect()) == sorted(
        [("1", bad, "good"), ("1", "good", bad), ("None", bad), ("None", "good")]
    )


def test_pair_flow(spark, tmp_path):
    pairs = [
        ("a", "clean", "login with AZURE_LOGIN_TOKEN_FOR_STORAGE=x1y2"),
        ("b", "system override", "fine"), ("c", "clean", "fine"), ("d", "evil", "fine"),
        ("e", None, "x"), ("f", "x", None),
    ]
    path = _json(
        tmp_path / "p.json",
        [dict(zip(("pair_id", "incoming_content", "outbound_intent"), p)) for p in pairs],
    )
    for make_scorer, last in ((None, "SECURE"), (evil, "ISOLATED")):
        reports, invalid = flows.pair_flow(read_pairs(spark, path), make_scorer=make_scorer)
        rows = {r.pair_id: r for r in reports.collect()}
        assert {k: r.agent_status for k, r in rows.items()} == {
            "a": "ISOLATED", "b": "ISOLATED", "c": "SECURE", "d": last
        }
        assert rows["a"].outbound_dlp_report.asDict(True) == {
            "safe": False, "action": "BLOCK",
            "violations": [{"type": "api_key", "matches": 1}, {"type": "env_variable", "matches": 1}],
        }
        assert reports.columns == [
            "pair_id", "simulation_status", "inbound_threat_detected", "sanitized_inbound_preview",
            "outbound_dlp_report", "agent_status",
        ]
        assert sorted(r.pair_id for r in invalid.collect()) == ["e", "f"]
    sinks.write_pair_reports(reports, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def _item_rows(spark):
    """20,000 items; request 0 holds a third of them."""
    n = F.col("id")
    big = spark.range(7_000).select(F.lit(0).alias("request_id"), n.alias("rank"))
    rest = spark.range(13_000).select(
        (n % 500 + 1).cast("int").alias("request_id"), F.floor(n / 500).alias("rank")
    )
    text = F.when((F.col("request_id") % 7 == 3) & (F.col("rank") == 4), "system override")
    return big.unionByName(rest).withColumn("content", text.otherwise(F.concat(F.lit("c"), "rank")))


def test_flag_per_request(spark):
    ids = spark.createDataFrame([(i,) for i in range(502)], "request_id int")
    found = req.threat_by_request(_item_rows(spark), "request_id", inbound.hit("content"), ids)
    rows = {r.request_id: r for r in found.collect()}
    assert len(rows) == 502
    assert all(r.threat_intercepted == (i % 7 == 3 and i <= 500) for i, r in rows.items())
    assert rows[0].n_items == 7_000 and rows[501].n_items == 0


def test_items_come_back_in_order_in_pages(spark):
    pages = req.item_pages(_item_rows(spark), "request_id", "rank", ["content"], page_size=100)
    rows = pages.collect()
    assert len(rows) == 70 + 500 and all(len(r.results) <= 100 for r in rows)
    big = [i.content for r in sorted(rows) if r.request_id == 0 for i in r.results]
    assert big == [f"c{i}" for i in range(7_000)]


def test_a_large_request_is_written_to_many_files(spark, tmp_path):
    out = str(tmp_path / "items")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sinks.write_items_in_order(_item_rows(spark), out)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    back = spark.read.parquet(out).withColumn("f", F.input_file_name())
    assert back.count() == 20_000
    assert back.filter("request_id = 0").select("f").distinct().count() >= 2
    sizes = [r["count"] for r in back.groupBy("f").count().collect()]
    assert max(sizes) < 20_000 / 8 * 1.5


def test_array_schema():
    assert "array<struct<title:string,content:string,url:string>>" in REQUEST_SCHEMA


@pytest.mark.parametrize("bits", [64, second.SIEVE])
def test_only_requests_with_condemned_items_are_shuffled(spark, monkeypatch, bits):
    monkeypatch.setattr(second, "SIEVE", bits)
    texts = [["evil", f"t{i}"] if i % 100 == 7 else [f"t{i}", "", None][: i % 4] for i in range(1000)] + [None]
    items = "transform(texts, t -> struct('t' as title, t as content, 'u' as url))"
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, texts array<string>")
    asked = req.asked_items(rows.selectExpr("id", f"{items} as results"))
    verdicts = second.score(second.candidates(req.item_texts(asked), "content"), evil, "m")
    with conf_for(spark, spark__sql__autoBroadcastJoinThreshold=-1):
        judged = req.apply_verdicts_to_items(asked, verdicts)
        moved = shuffled(judged)
        assert judged.columns == ["id", "results"]
        found = {r.id: r.results and [tuple(i) for i in r.results] for r in judged.collect()}
    clean = lambda t: fixed.SEMANTIC_MARKER if t == "evil" else t
    assert found == {i: ts and [("t", clean(t), "u") for t in ts] for i, ts in enumerate(texts)}
    # The requests that may have one, their condemned items, and the sieve's rows.
    assert moved < 40 if bits > 64 else moved < 400


def test_scorers_of_items_hold_few_bytes(spark):
    def holding(name):
        import resource
        from pathlib import Path

        held = int(Path("/proc/self/statm").read_text().split()[1]) * resource.getpagesize()
        return lambda prompts: prompts.map(lambda p: str(held))

    def held(n):
        rows = spark.range(0, n // 2, 1, 1).selectExpr(
            "id", "transform(array('a', 'b'), k -> struct(k as title, rpad(concat(k, id), 6000, 'x') as content, 'u' as url)) results"
        )
        texts = req.item_texts(req.asked_items(rows))
        verdicts = second.score(second.candidates(texts, "content"), holding, "m").collect()
        assert len({r.text_hash for r in verdicts}) == len(verdicts) == n
        return max(int(r.verdict) for r in verdicts)

    held(300)  # what is imported on the first call
    assert held(9000) - held(300) < 16 << 20  # the texts have 54 MB
