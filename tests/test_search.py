import json

from pyspark.sql import functions as F

from textguard.functions import fixed
from textguard.plans import flows, sinks
from textguard.sources import search

FULL = {"title": "T", "content": "system override", "url": "u", "score": 1.5, "tags": ["a"]}
LANDED = [
    {"request_id": "1", "provider": "SearXNG", "fetch_status": 200,
     "results": [FULL, {"url": "u2"}, {"title": None, "content": None, "url": "u3"}]},
    {"request_id": "2", "provider": "brave", "fetch_status": 200,
     "web": {"results": [{"title": "B", "description": "d", "content": "ignored", "url": "b"}]}},
    {"request_id": "3", "fetch_status": 200, "results": []},
    {"request_id": "4", "provider": "searxng", "fetch_status": 503, "results": [FULL]},
    {"request_id": "5", "provider": "other", "fetch_status": 200, "results": [FULL]},
    {"request_id": "6", "provider": "searxng", "fetch_status": 200},
    {"request_id": "7", "provider": "brave", "fetch_status": 200, "results": [FULL]},
    {"request_id": "8", "fetch_status": 200, "results": [FULL, FULL]},
]
REQUESTS = [(str(i), f"q{i} ~/x") for i in range(1, 10)] + [("a", ""), ("b", None)]


def _landed(spark, folder):
    path = folder / "landed.json"
    lines = [json.dumps(r) for r in LANDED] + ['{"request_id": "9", "results": [']
    path.write_text("\n".join(lines))
    return search.read_landed(spark, str(path))


def test_normalized_rows(spark, tmp_path):
    found = search.normalize(_landed(spark, tmp_path))
    rows = found.collect()
    items = {r.request_id: [tuple(i) for i in r["items"]] for r in rows}
    full = ("T", "system override", "u")
    assert items == {
        "1": [full, ("", "", "u2"), (None, None, "u3")], "2": [("B", "d", "b")], "3": [], "4": [],
        "5": [], "6": [], "7": [], "8": [full, full], None: [],
    }
    assert [r._corrupt for r in rows if r._corrupt] == ['{"request_id": "9", "results": [']
    no_key = search.normalize(_landed(spark, tmp_path), brave_key=False)
    assert not no_key.filter("request_id = '2'").first()["items"]


def test_item_rows_and_union_keep_order_and_copies(spark, tmp_path):
    found = search.normalize(_landed(spark, tmp_path)).select("request_id", "items")
    rows = search.item_rows(found)
    assert [r["rank"] for r in rows.filter("request_id = '1'").orderBy("rank").collect()] == [0, 1, 2]
    assert search.union_items(rows, rows).count() == 2 * rows.count() == 12


def test_body_text_gives_the_same(spark, tmp_path):
    rows = [
        (r["request_id"], r.get("provider"), r["fetch_status"],
         json.dumps({k: r[k] for k in ("results", "web") if k in r}))
        for r in LANDED
    ]
    frame = spark.createDataFrame(
        rows, "request_id string, provider string, fetch_status int, body string"
    )
    columns = ("request_id", "items")
    parsed = search.normalize(search.parse_body(frame)).select(*columns)
    landed = search.normalize(_landed(spark, tmp_path)).select(*columns).filter("request_id IS NOT NULL")
    assert sorted(parsed.collect()) == sorted(landed.collect())


def test_search_flow_and_its_sink(spark, tmp_path):
    requests = spark.createDataFrame(REQUESTS, "request_id string, q string")
    responses, refused = flows.search_flow(requests, _landed(spark, tmp_path))
    assert sorted(tuple(r) for r in refused.collect()) == [
        ("a", 400, fixed.MISSING_QUERY), ("b", 400, fixed.MISSING_QUERY)
    ]
    rows = {r.request_id: r for r in responses.collect()}
    assert len(rows) == 9 and all(r.verified for r in rows.values())
    assert rows["1"].query == "q1 ~/x" and rows["1"].secured_query == "q1 documentation context"
    assert [i.content for i in rows["1"].results] == [fixed.MARKER, "", None]
    assert rows["4"].fetch_status == 503 and rows["4"].results == []
    assert rows["9"].fetch_status is None and rows["9"].results == []
    out = str(tmp_path / "out")
    sinks.write_search_responses(responses, out)
    lines = [json.loads(r.value) for r in spark.read.text(out).collect()]
    first = next(x for x in lines if x["request_id"] == "1")
    assert first["results"][2] == {"title": None, "content": None, "url": "u3"}
    assert "secured_query" not in first


def test_results_are_read_without_a_shuffle(spark, tmp_path):
    found = search.normalize(_landed(spark, tmp_path)).select(F.size("items"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_damaged_bodies(spark, tmp_path):
    bodies = {
        "page": "<html>502</html>", "cut": '{"results":[{"title":"a"', "object": '{"results":{"title":"a"}}', "empty": "",
        "text": '{"results":"x"}', "none": None, "fine": '{"results":[{"title":"a"}]}', "no results": '{"q":1}',
        "web": '{"web":[1]}', "array": "[1]",
    }
    rows = [(k, "searxng", 200, b) for k, b in bodies.items()]
    landed = spark.createDataFrame(rows, "request_id string, provider string, fetch_status int, body string")
    found = {r.request_id: r for r in search.normalize(search.parse_body(landed)).collect()}
    fine = {"none", "fine", "no results"}
    assert {k for k, r in found.items() if r.parse_ok} == fine
    assert {k for k, r in found.items() if r["items"]} == {"fine"}
    path = tmp_path / "landed.json"
    path.write_text('{"request_id":"a","provider":"searxng","fetch_status":200,"results":[{"title":"t"}]}\n<html>\n')
    read = search.normalize(search.read_landed(spark, str(path))).collect()
    assert sorted((str(r.request_id), r.parse_ok) for r in read) == [("None", False), ("a", True)]
