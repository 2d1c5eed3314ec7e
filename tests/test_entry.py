"""Every registered query against its SQL, and the shape of the plans."""

import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from textguard.operators import requests, second_pass
from textguard.plans.queries import QUERIES as OWN
from textguard.session import written

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "conversations", "labels", "benchmark", "events")
QUERIES, ORACLE = {k: q for k, q in queries().items() if k in OWN}, oracle_sql()
ONE_PASS = (
    "sanitize_documents", "threat_flag", "dlp_counts", "dlp_report", "pixel_urls",
    "anonymize_queries", "provider_routing", "custom_rules_sanitize",
)


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as connection:
        for name in TABLES:
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
        yield connection


def test_entry(spark):
    assert entry(spark).count() == 200


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(OWN) <= set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    mine = [tuple(r) for r in frame.select(*columns).collect()]
    found = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})")
    theirs = found.fetchall()
    assert len(theirs) > 0
    assert sorted(mine, key=repr) == sorted(theirs, key=repr)
    assert sorted(d[0] for d in db.execute(ORACLE[name]).description) == columns


@pytest.mark.parametrize("name", QUERIES)
def test_plan(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if name in ONE_PASS:  # the only shuffle there may be is the one that spreads a small scan
        shuffles = plan.count("Exchange ")
        assert shuffles == plan.count("REPARTITION_BY_NUM")


@pytest.mark.parametrize(
    "name, function, most",
    [
        ("sanitize_requests", "regexp_replace", 6), ("normalize_searxng", "from_json", 2),
        ("normalize_brave", "from_json", 2), ("provider_routing", "from_json", 2),
        ("semantic_candidates", "SortAggregate", 0), ("semantic_prompt", "SortAggregate", 0),
    ],
)  # a body and its items are each parsed once, a rule is named once
def test_nothing_is_done_twice(spark, name, function, most):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(function) == most


@pytest.mark.parametrize(
    "name, parses",
    [("guarded_documents", 0), ("requests_guarded", 0), ("search_guarded", 2), ("settings_guarded", 0),
     ("search_by_settings", 2), ("semantic_candidates", 0), ("pairs_guarded", 0)],
)
def test_each_text_is_folded_once(spark, monkeypatch, name, parses):
    """Of all that a flow with a model runs, one plan has the rules, once, and above the spread."""
    plans = []

    def kept(frame, label):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return written(frame, label)

    for module in (second_pass, requests):
        monkeypatch.setattr(module, "written", kept)
    plans.append(QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString())
    rules = [re.sub(r"(regexp_replace\()+verdict#", "", p).count("regexp_replace") for p in plans]
    # The anonymiser of a search request has two of its own.
    assert sum(rules) == (8 if name.startswith("search") else 6), rules
    assert sum(p.count("from_json") for p in plans) == parses  # a body, and its items
    for plan in plans:
        below = plan.split("REPARTITION_BY_NUM", 1)[1:]
        assert not any("regexp_replace" in b or "rlike" in b.lower() for b in below)


def test_scan_reads_only_what_is_used(spark, capsys):
    QUERIES["sanitize_documents"](spark, FOLDER).explain("formatted")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in capsys.readouterr().out
    QUERIES["event_feed_filter"](spark, FOLDER).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in plan
    assert "In(event_type, [error,signup])" in plan
