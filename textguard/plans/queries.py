"""The registered queries, over the driver's tables with planted phrases."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import anonymize, egress, fixed, inbound
from textguard.operators import catalogue, events, findings, fitted, gating, verdict_store
from textguard.operators import requests as req
from textguard.operators import second_pass as second
from textguard.plans import flows, planted, sinks
from textguard.session import new_path, spread, written
from textguard.sources import rules, search, settings
from textguard.sources.requests import split_valid_pairs
from textguard.streaming import live, streams

CUSTOM_PATTERNS = (r"(?i)closing\s+line", r"the [a-z]+ing ")
MEETING = ("[SECURITY SAN", "TRIGGERED]", " ATION", "ZATION TRIG", "SUDO")
BLOCKED = ("closing line", "a.b.", "of the", "SUDO")


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def documents(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    rows = spread(table(spark, folder, "documents", "doc_id", "text", *more), "doc_id")
    return rows.withColumn("text", planted.with_phrase("text", F.col("doc_id")))


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    rows = spread(rows, "conv_id", "turn")
    return rows.withColumn(
        "text", planted.with_phrase("text", F.col("conv_id") * 3 + F.col("turn"))
    )


# --- inbound -------------------------------------------------------------------------------


def sanitize_documents(spark, folder):
    return documents(spark, folder).select("doc_id", inbound.sanitize("text").alias("sanitized"))


def sanitize_pages(spark, folder):
    pages = spread(table(spark, folder, "pages", "page_id", "html"), "page_id")
    text = planted.with_phrase("html", F.col("page_id"))
    return pages.select("page_id", inbound.sanitize(text).alias("sanitized"))


def sanitize_conversations(spark, folder):
    return conversations(spark, folder).select(
        "conv_id", "turn", inbound.sanitize("text").alias("sanitized")
    )


def injection_hits_by_rule(spark, folder):
    return findings.rule_monitor(documents(spark, folder), "text", rules.INJECTION).drop("kind")


def threat_flag(spark, folder):
    clean = documents(spark, folder).select("doc_id", inbound.sanitize("text").alias("clean"))
    return clean.select(
        "doc_id",
        inbound.flagged("clean").alias("threat"),
        inbound.open_for_model("clean").alias("second_pass"),
    )


def threat_rows_only(spark, folder):
    hits = documents(spark, folder).filter(inbound.hit("text"))
    return hits.select("doc_id", inbound.sanitize("text").alias("sanitized"))


def custom_rules_sanitize(spark, folder):
    own = rules.custom_rules(CUSTOM_PATTERNS)
    rules.check_rules(spark, own)
    return documents(spark, folder).select(
        "doc_id", inbound.sanitize("text", own).alias("sanitized")
    )


def row_rules_sanitize(spark, folder):
    own = F.when(F.col("lang") == "en", F.array(*(F.lit(p) for p in CUSTOM_PATTERNS)))
    rows = documents(spark, folder, "lang").withColumn("patterns", own)
    clean = gating.sanitize_by_lists(rows, "text", "patterns")
    return clean.select("doc_id", F.col("text").alias("sanitized"))


def blocklist_sanitize(spark, folder):
    chosen = rules.blocklist_rules(BLOCKED)
    return documents(spark, folder).select(
        "doc_id", inbound.sanitize("text", chosen).alias("sanitized")
    )


def _of_items(spark, folder, words):
    """A user's list: some words of every benchmark item, in the order of the items."""
    items = table(spark, folder, "benchmark", "item_id", "text").orderBy("item_id")
    return [r.w for r in items.select(words.alias("w")).collect()]


def blocklist_phrases(spark, folder):
    """The rules, then a block list: the openings of all benchmark items among other phrases."""
    opening = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    phrases = [*BLOCKED, *_of_items(spark, folder, opening), *MEETING]
    clean = catalogue.sanitize_phrases(documents(spark, folder), "text", phrases)
    return clean.select("doc_id", F.col("text").alias("sanitized"))


def catalogue_findings(spark, folder):
    """Findings of a rule for each of the first words of every benchmark item and the next, beside the built-in ones."""
    items = _of_items(spark, folder, F.slice(F.split("text", "[^A-Za-z]+"), 1, 11))
    own = [
        rules.Rule(f"item_{i}_{n}", i, "injection", "own", rf"(?i){one}[ .,]+{two}")
        for i, words in enumerate(items)
        for n, (one, two) in enumerate(zip(words, words[1:]))
    ]
    found = catalogue.findings(
        documents(spark, folder), "doc_id", "text", [*own, *rules.INJECTION, *rules.DLP]
    )
    return found.select("doc_id", "kind", "rule_id", "matches")


def rule_toggle(spark, folder):
    chosen = rules.toggle(rules.INJECTION, system_override=False, sudo_rm=False)
    return documents(spark, folder).select(
        "doc_id", inbound.sanitize("text", chosen).alias("sanitized")
    )


# --- outbound ------------------------------------------------------------------------------


def dlp_counts(spark, folder):
    counts = egress.match_counts("text")
    return documents(spark, folder).select("doc_id", *(n.alias(k) for k, n in counts.items()))


def dlp_violations_long(spark, folder):
    return findings.findings(documents(spark, folder), "doc_id", "text", rules.DLP).select(
        "doc_id", F.col("rule_id").alias("type"), "matches"
    )


def dlp_action(spark, folder):
    unsafe = egress.leaks("text")
    checked = documents(spark, folder).select("doc_id", unsafe.alias("unsafe"))
    return checked.select(
        "doc_id", (~F.col("unsafe")).alias("safe"), egress.action(F.col("unsafe")).alias("action")
    )


def dlp_report(spark, folder):
    report = egress.with_dlp_report(documents(spark, folder), "text")
    listed = F.transform(
        "violations", lambda v: F.concat_ws(":", v["type"], v["matches"].cast("string"))
    )
    return report.select("doc_id", "safe", "action", F.array_join(listed, ",").alias("violations"))


def pixel_urls(spark, folder):
    return documents(spark, folder).select(
        "doc_id", F.explode(egress.pixel_urls("text")).alias("url")
    )


# --- search --------------------------------------------------------------------------------


def search_requests(spark, folder):
    rows = table(spark, folder, "benchmark", "item_id", "text")
    q = F.when(F.col("item_id") % 7 == 3, "").when(F.col("item_id") % 7 == 5, None)
    q = q.otherwise(planted.with_paths("text", F.col("item_id")))
    return rows.select(F.col("item_id").alias("request_id"), q.alias("q"))


def anonymize_queries(spark, folder):
    rows = table(spark, folder, "benchmark", "item_id", "text").select(
        "item_id", planted.with_paths("text", F.col("item_id")).alias("query")
    )
    return rows.withColumn("secured_query", anonymize.secured_query("query"))


def search_request_split(spark, folder):
    asked, refused = search.split_requests(search_requests(spark, folder))
    return asked.select(
        "request_id", F.lit(200).alias("status"), "secured_query",
        F.lit(None).cast("string").alias("error"),
    ).unionByName(
        refused.select(
            "request_id", "status", F.lit(None).cast("string").alias("secured_query"), "error"
        )
    )


def landed_pages(spark, folder):
    """Pages as landed provider responses of two items each, still as JSON text.

    Every fifth page lacks the title key; every seventh lacks the content of its first item.
    """
    page = F.col("page_id")
    rows = spread(table(spark, folder, "pages", "page_id", "url", "html"), "page_id")
    title = F.when(page % 5 != 0, F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    first = F.when(page % 7 != 0, planted.with_phrase("html", page))
    provider = (
        F.when(page % 4 == 0, "SearXNG").when(page % 4 == 1, "brave").when(page % 4 == 2, "other")
    )

    def body(content_key):
        return F.array(
            F.struct(title.alias("title"), first.alias(content_key), F.col("url").alias("url")),
            F.struct(
                F.lit("second").alias("title"), F.lit("").alias(content_key),
                F.lit(None).cast("string").alias("url"),  # to_json leaves the key out
            ),
        )

    searxng = F.to_json(F.struct(body("content").alias("results")))
    brave = F.to_json(F.struct(F.struct(body("description").alias("results")).alias("web")))
    return rows.select(
        page.alias("request_id"),
        provider.alias("provider"),
        F.when(page % 11 == 10, 500).otherwise(200).alias("fetch_status"),
        F.when(page % 4 == 1, brave).otherwise(searxng).alias("body"),
    )


def _items_of(spark, folder, provider):
    landed = search.parse_body(landed_pages(spark, folder))
    chosen = search.normalize(landed.filter(search.provider_name() == provider))
    return search.item_rows(chosen).select("request_id", "rank", "title", "content", "url")


def normalize_searxng(spark, folder):
    return _items_of(spark, folder, search.SEARXNG)


def normalize_brave(spark, folder):
    return _items_of(spark, folder, search.BRAVE)


def provider_union(spark, folder):
    return search.union_items(
        normalize_searxng(spark, folder), normalize_brave(spark, folder)
    )


def provider_routing(spark, folder):
    routed = search.normalize(search.parse_body(landed_pages(spark, folder)))
    return routed.select(
        "request_id", "fetch_status", F.size("items").cast("bigint").alias("n_items")
    )


def page_requests(spark, folder):
    """A request for every page, so that every landed response is asked for."""
    items = table(spark, folder, "benchmark", "item_id", "text")
    page, n = F.col("page_id"), items.count()
    rows = table(spark, folder, "pages", "page_id").withColumn("item_id", page % max(n, 1))
    q = F.when(page % 7 == 3, "").when(page % 7 == 5, None)
    q = q.otherwise(planted.with_paths("text", page))
    return rows.join(items, "item_id").select(page.alias("request_id"), q.alias("q"))


def search_responses(spark, folder, **model):
    landed = search.parse_body(landed_pages(spark, folder))
    responses, _ = flows.search_flow(page_requests(spark, folder), landed, **model)
    return _flat_responses(responses)


def _flat_responses(responses):
    kept = [
        c for c in ("request_id", "query", "secured_query", "verified", "fetch_status")
        if c in responses.columns
    ]
    return responses.select(*kept, F.posexplode_outer("results").alias("rank", "item")).select(
        *kept, "rank", "item.title", "item.content", "item.url"
    )


def search_guarded(spark, folder):
    return search_responses(spark, folder, make_scorer=keyword_scorer, model_name="keywords")


def search_partial(spark, folder):
    """Responses with an item in the middle that is a number, or null, or an object."""
    page = F.col("page_id")
    rows = spread(table(spark, folder, "pages", "page_id", "url", "html"), "page_id")
    item = F.to_json(F.struct(planted.with_phrase("html", page).alias("content"), "url"))
    middle = F.when(page % 3 == 0, "5").when(page % 3 == 1, "null").otherwise('{"title":"x"}')
    body = F.concat(
        F.lit('{"results":['), item, F.lit(","), middle, F.lit(","), item, F.lit("]}")
    )
    landed = rows.select(
        page.alias("request_id"), F.lit("searxng").alias("provider"),
        F.lit(200).alias("fetch_status"), body.alias("body"),
    )
    found = search.normalize(search.parse_body(landed))
    return found.select(
        "request_id", "fetch_status", "parse_ok",
        F.size("items").cast("bigint").alias("n_items"),
        F.element_at("items", 1)["content"].alias("content"),
    )


def search_damaged(spark, folder):
    """Responses of status 200 whose body is a web page, cut off, or has no list of results."""
    page = F.col("page_id")
    rows = spread(table(spark, folder, "pages", "page_id", "url", "html"), "page_id")
    item = F.to_json(F.struct(planted.with_phrase("html", page).alias("content"), "url"))
    whole = F.concat(F.lit('{"results":['), item, F.lit("]}"))
    body = (
        F.when(page % 4 == 0, F.coalesce("html", F.lit("")))
        .when(page % 4 == 1, F.substring(whole, 1, 24))
        .when(page % 4 == 2, F.concat(F.lit('{"results":'), item, F.lit("}"))).otherwise(whole)
    )
    landed = rows.select(
        page.alias("request_id"), F.lit("searxng").alias("provider"),
        F.lit(200).alias("fetch_status"), body.alias("body"),
    )
    found = search.normalize(search.parse_body(landed))
    return found.select(
        "request_id", "parse_ok", F.size("items").cast("bigint").alias("n_items"),
        F.get("items", F.lit(0))["content"].alias("content"),
    )


def search_sink(spark, folder):
    """Search responses written as JSON and read again."""
    landed = search.parse_body(landed_pages(spark, folder))
    responses, _ = flows.search_flow(page_requests(spark, folder), landed)
    path = new_path(spark, "search-responses")
    sinks.write_search_responses(responses, path)
    schema = responses.drop("secured_query").schema
    return _flat_responses(spark.read.schema(schema).json(path))


# --- requests ------------------------------------------------------------------------------


def line_requests(spark, folder, request_id=None):
    """Each document is a request, each of its lines an item."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(
            F.col("source").alias("title"), line.alias("content"), F.col("lang").alias("url")
        ),
    )
    request_id = F.col("doc_id") if request_id is None else request_id
    return documents(spark, folder, "source", "lang").select(
        request_id.alias("request_id"), lines.alias("results")
    )


def sanitize_requests(spark, folder):
    responses, _ = flows.sanitize_flow(line_requests(spark, folder))
    return _flat_requests(responses)


def requests_guarded(spark, folder):
    """With a model, and with ids that repeat."""
    shared = F.floor(F.col("doc_id") / 2)
    responses, _ = flows.sanitize_flow(
        line_requests(spark, folder, shared), None, keyword_scorer, "keywords"
    )
    return _flat_requests(responses)


def requests_sink(spark, folder):
    """Sanitise responses written as JSON and read again."""
    responses, _ = flows.sanitize_flow(line_requests(spark, folder))
    path = new_path(spark, "sanitize-responses")
    sinks.write_sanitize_responses(responses, path)
    return _flat_requests(spark.read.schema(responses.schema).json(path))


def _flat_requests(responses):
    return responses.select(
        "request_id", "status", "threat_intercepted",
        F.posexplode_outer("results").alias("rank", "item"),
    ).filter("rank IS NOT NULL").select(
        "request_id", "status", "threat_intercepted", "rank",
        "item.title", "item.content", "item.url",
    )


def request_threat(spark, folder):
    return req.threat_by_request(
        conversations(spark, folder), "conv_id", inbound.hit("text")
    )


def request_pages(spark, folder):
    items = conversations(spark, folder).withColumn("content", inbound.sanitize("text"))
    pages = req.item_pages(items, "conv_id", "turn", ["role", "content"], page_size=4)
    joined = F.array_join(F.transform("results", lambda i: F.concat_ws(":", i["role"], i["content"])), "|")
    return pages.select(
        "conv_id", "page", F.size("results").cast("bigint").alias("n_items"),
        joined.alias("results"),
    )


def conversation_pairs(spark, folder):
    """A user turn is inbound; the assistant turn right after it, where there is one, is outbound."""
    turns = conversations(spark, folder)
    asked = turns.filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("incoming_content")
    )
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("outbound_intent")
    )
    return asked.join(answered, ["conv_id", "turn"], "left").select(
        F.concat_ws("-", "conv_id", "turn").alias("pair_id"),
        "incoming_content",
        "outbound_intent",
    )


def agent_status(spark, folder, **model):
    reports, _ = flows.pair_flow(conversation_pairs(spark, folder), **model)
    return _flat_reports(reports)


def pairs_guarded(spark, folder):
    return agent_status(spark, folder, make_scorer=keyword_scorer, model_name="keywords")


def pairs_sink(spark, folder):
    """Pair reports written as JSON and read again."""
    reports, _ = flows.pair_flow(conversation_pairs(spark, folder))
    path = new_path(spark, "pair-reports")
    sinks.write_pair_reports(reports, path)
    return _flat_reports(spark.read.schema(reports.schema).json(path))


def _flat_reports(reports):
    return reports.select(
        "pair_id", "simulation_status", "inbound_threat_detected", "sanitized_inbound_preview",
        "outbound_dlp_report.safe", "outbound_dlp_report.action", "agent_status",
    )


def pair_quarantine(spark, folder):
    _, invalid = split_valid_pairs(conversation_pairs(spark, folder))
    return invalid.select("pair_id", "reason")


# --- reports -------------------------------------------------------------------------------


def overview_stats(spark, folder):
    return findings.overview(documents(spark, folder, "source"), "text", "text", by=["source"])


def rule_monitor(spark, folder):
    return findings.rule_monitor(documents(spark, folder, "lang"), "text", by=["lang"])


def event_log(spark, folder):
    """Findings written to the event log and read back as a feed."""
    found = findings.findings(documents(spark, folder), "doc_id", "text")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 5).cast("int"))
    path = new_path(spark, "event-log")
    events.append_events(events.as_events(found, "doc_id", day), path)
    log = spark.read.parquet(path)
    feed = events.event_feed(
        log, "event_day", F.lit("2024-01-01").cast("date"), F.lit("2024-01-06").cast("date"),
        kind=["injection", "dlp"],
    )
    return feed.select(
        F.date_format("event_time", "yyyy-MM-dd").alias("day"),
        "source_id", "kind", "rule_id", "matches",
    )


def event_feed_filter(spark, folder):
    log = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type")
    since, until = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-05", "2024-01-20"))
    feed = events.event_feed(
        log, "ts", since, until, event_type=["error", "signup"], user_id=list(range(1, 40))
    )
    return feed.select("event_id", "user_id", "event_type")


def latency_percentiles(spark, folder):
    log = table(spark, folder, "events", "event_type", "value")
    found = events.percentiles(log, "value", [0.5, 0.95, 0.99], by=["event_type"])
    return found.select("event_type", "prob", F.round("value", 6).alias("value"))


def latency_percentiles_hot(spark, folder):
    """Half the values equal, few of them put in order at once, one percentile asked for twice."""
    log = table(spark, folder, "events", "event_id", "event_type", "value")
    hot = log.withColumn("value", F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(F.col("value")))
    found = events.percentiles(hot, "value", [0.5, 0.5, 0.95], by=["event_type"], in_order=100)
    return found.select("event_type", "prob", F.round("value", 6).alias("value"))


def latency_sketched(spark, folder):
    """Sketches by day and type, stored, merged by type; are the ranks of their percentiles within 2 %?"""
    log = table(spark, folder, "events", "event_type", "value", "ts")
    daily = log.withColumn("day", F.to_date("ts"))
    stored = written(events.sketches(daily, "value", ["event_type", "day"]), "daily-sketches")
    merged = events.merged(stored, ["event_type"])
    found = events.sketched_percentiles(merged, [0.5, 0.95, 0.99], ["event_type"])
    ranks = log.filter("value IS NOT NULL").join(
        found.withColumnRenamed("value", "near"), "event_type"
    )
    ranks = ranks.groupBy("event_type", "prob").agg(
        F.avg((F.col("value") < F.col("near")).cast("int")).alias("below"),
        F.avg((F.col("value") <= F.col("near")).cast("int")).alias("upto"),
    )
    within = (F.col("below") - 0.02 <= F.col("prob")) & (F.col("prob") <= F.col("upto") + 0.02)
    return ranks.select("event_type", "prob", within.alias("within"))


def _hour_text(frame):
    return frame.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def event_counts_tumbling(spark, folder):
    log = table(spark, folder, "events", "ts", "event_type")
    return _hour_text(events.window_counts(log, "ts", ["event_type"]))


# --- second pass ---------------------------------------------------------------------------


def _clean_documents(spark, folder):
    return documents(spark, folder).select("doc_id", inbound.sanitize("text").alias("text"))


def _asked_documents(spark, folder):
    return second.asked(_clean_documents(spark, folder), "text")


def semantic_candidates(spark, folder):
    found = second.candidates(_asked_documents(spark, folder), "text")
    return found.select("text_hash", "copies")


def semantic_prompt(spark, folder):
    found = second.candidates(_asked_documents(spark, folder), "text")
    return found.select("text_hash", "prompt")


def _labelled_verdicts(spark, folder, clean):
    """``labels`` as a model's answers, one per distinct text; unlabelled texts have none."""
    labels = table(spark, folder, "labels", "doc_id", "toxic")
    by_text = clean.select("doc_id", second.text_hash("text").alias("text_hash")).join(
        labels, "doc_id"
    )
    answer = F.when(F.max("toxic") == 1, " not malicious\n").otherwise("SAFE")
    return by_text.groupBy("text_hash").agg(
        answer.alias("verdict"), F.lit("ok").alias("status")
    )


def semantic_apply(spark, folder):
    clean = written(_clean_documents(spark, folder), "clean")
    verdicts = written(_labelled_verdicts(spark, folder, clean), "verdicts")
    return second.apply_verdicts(clean, verdicts, "text").withColumnRenamed("text", "sanitized")


def keyword_scorer(model_name: str):
    """A stand-in model: one phrase is bad, texts with a link get no answer."""

    def answer(prompt: str) -> str | None:
        if "://" in prompt:
            return None
        return "Malicious." if "ordinary closing line" in prompt else "safe"

    return lambda prompts: pd.Series([answer(p) for p in prompts], dtype=object)


def semantic_scored(spark, folder):
    prompts = second.candidates(_asked_documents(spark, folder), "text")
    return second.score(prompts, keyword_scorer, "keywords")


def outage_scorer(model_name: str):
    """The stand-in model, but out of reach for any call with a link in it."""
    answer = keyword_scorer(model_name)

    def scorer(prompts):
        if prompts.str.contains("://", regex=False).any():
            raise second.ScorerUnavailable
        return answer(prompts)

    return scorer


def semantic_outage(spark, folder):
    prompts = second.candidates(_asked_documents(spark, folder), "text")
    return second.score(prompts, outage_scorer, "keywords")


def slow_scorer(model_name: str):
    """The stand-in model, but some texts make it wait for ever."""
    answer = keyword_scorer(model_name)

    def scorer(prompts):
        lengths = prompts.str.len() - len(fixed.PROMPT_HEAD) - len(fixed.PROMPT_TAIL)
        if (lengths % 499 == 0).any():
            time.sleep(3600)
        return answer(prompts)

    return scorer


def semantic_deadline(spark, folder):
    """Calls that never end cost only the texts that cause it."""
    prompts = second.candidates(_asked_documents(spark, folder), "text")
    return second.score(prompts, slow_scorer, "keywords", batch_rows=4, seconds=0.5)


def later_scorer(model_name: str):
    """Another answer to everything, as a changed model would give."""
    return lambda prompts: pd.Series(["later"] * len(prompts), dtype=object)


def semantic_incremental(spark, folder):
    """Two runs over a store: the second scores only the texts that the first had not."""
    path = new_path(spark, "verdict-store")
    first = second.candidates(_asked_documents(spark, folder), "text")
    verdict_store.score(first, keyword_scorer, "keywords", path, "day 1")
    turns = conversations(spark, folder).select(inbound.sanitize("text").alias("text"))
    both = _clean_documents(spark, folder).select("text").unionByName(turns)
    again = second.candidates(second.asked(both, "text"), "text")
    return verdict_store.score(again, later_scorer, "keywords", path, "day 2")


def semantic_fitted(spark, folder):
    """Verdicts of a model fitted on the labelled documents, saved and loaded again."""
    labels = table(spark, folder, "labels", "doc_id", "toxic")
    asked = _asked_documents(spark, folder)
    path = new_path(spark, "fitted-scorer")
    learned = asked.filter("text_hash IS NOT NULL").join(labels, "doc_id")
    fitted.fit(learned, "text", "toxic").save(path)
    verdicts = fitted.score(asked, PipelineModel.load(path), "text")
    judged = second.apply_verdicts(asked, verdicts, "text")
    return judged.select("doc_id", "malicious")


def guarded_documents(spark, folder):
    return flows.text_flow(
        documents(spark, folder), "text",
        make_scorer=keyword_scorer, model_name="keywords",
    ).withColumnRenamed("text", "sanitized")


# --- settings ------------------------------------------------------------------------------


def source_settings(spark, folder):
    """Settings for every source, made from the source's number; missing parts stay NULL."""
    sources = table(spark, folder, "documents", "source").distinct()
    n = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    modules = F.struct(
        F.when(n % 5 == 2, False).alias("indirect_injection"),
        F.when(n % 5 == 3, False).alias("jailbreaks"),
        F.when(n % 5 == 3, False).alias("destructive_commands"),
        F.when(n % 3 == 0, True).alias("pii_leak_prevention"),
    )
    return sources.select(
        F.col("source").alias("profile_id"),
        F.when(n % 5 == 0, False).alias("global_protection_enabled"),
        F.when(n % 5 == 1, "strict").when(n % 5 == 2, "permissive").alias("security_profile"),
        F.when(n % 5 != 4, modules).alias("active_modules"),
        F.struct(
            F.when(n == 12, True).alias("use_ollama_evaluator"),
            F.when(n == 12, "phi3:mini").alias("selected_model"),
        ).alias("local_llm_verification"),
        F.when(n % 5 == 4, F.array(*(F.lit(b) for b in BLOCKED))).alias("custom_user_patterns"),
    )


def settings_defaults(spark, folder):
    filled = settings.with_defaults(source_settings(spark, folder))
    return filled.withColumn("blocklist", F.array_join("blocklist", "|"))


def config_gated_sanitize(spark, folder):
    profiles = written(settings.with_defaults(source_settings(spark, folder)), "settings")
    rows = gating.with_settings(
        documents(spark, folder, "source"), profiles, "source"
    )
    reported = egress.with_dlp_report(rows, "text", enabled=F.col("pii_leak_prevention"))
    return reported.select(
        "doc_id", gating.gated_sanitize("text").alias("sanitized"), "use_model", "action"
    )


def settings_guarded(spark, folder):
    profiles = written(settings.with_defaults(source_settings(spark, folder)), "settings")
    return flows.settings_flow(
        documents(spark, folder, "source"), profiles, "text", "source",
        make_scorer=keyword_scorer,
    ).withColumnRenamed("text", "sanitized").drop("source", "reason")


def settings_unlisted_model(spark, folder):
    """The strict profiles name a model that no list has; it is asked all the same."""
    own = F.when(F.col("security_profile") == "strict", "own-model:1b").otherwise(
        F.col("local_llm_verification.selected_model")
    )
    named = source_settings(spark, folder).withColumn(
        "local_llm_verification", F.col("local_llm_verification").withField("selected_model", own)
    )
    profiles = written(settings.with_defaults(named), "settings")
    return flows.settings_flow(
        documents(spark, folder, "source"), profiles, "text", "source",
        make_scorer=keyword_scorer,
    ).withColumnRenamed("text", "sanitized").drop("source")


def _profiles(spark, folder):
    return written(settings.with_defaults(source_settings(spark, folder)), "settings")


def _own_profile(row_id):
    return F.concat(F.lit("src"), (row_id % 20).cast("string"))


def search_by_settings(spark, folder):
    requests = page_requests(spark, folder).withColumn("profile_id", _own_profile(F.col("request_id")))
    responses, _ = flows.search_flow(
        requests, search.parse_body(landed_pages(spark, folder)),
        make_scorer=keyword_scorer, settings=_profiles(spark, folder),
    )
    return _flat_responses(responses)


def requests_by_settings(spark, folder):
    requests = line_requests(spark, folder).withColumn("profile_id", _own_profile(F.col("request_id")))
    responses, _ = flows.sanitize_flow(
        requests, make_scorer=keyword_scorer, settings=_profiles(spark, folder)
    )
    return _flat_requests(responses)


def pairs_by_settings(spark, folder):
    conv = F.split_part("pair_id", F.lit("-"), F.lit(1)).cast("bigint")
    pairs = conversation_pairs(spark, folder).withColumn("profile_id", _own_profile(conv))
    reports, _ = flows.pair_flow(
        pairs, make_scorer=keyword_scorer, settings=_profiles(spark, folder)
    )
    return _flat_reports(reports)


# --- streams -------------------------------------------------------------------------------


def _stream(spark, folder, name, *keys):
    batch = spark.read.parquet(f"{folder}/{name}.parquet")
    # As a pattern the path may name one file or a folder of files.
    stream = streams.read_files(spark, f"{folder}/{name}[.]parquet", batch.schema)
    return spread(stream, *keys, like=batch) if keys else stream


def _landed(spark, stream, name, partition_by=None):
    path = new_path(spark, name)
    query = streams.append_to(
        stream, path, new_path(spark, "progress"), partition_by, available_now=True
    )
    query.awaitTermination()
    return spark.read.parquet(path)


def _stream_documents(spark, folder):
    rows = _stream(spark, folder, "documents", "doc_id").select("doc_id", "text")
    return rows.withColumn("text", planted.with_phrase("text", F.col("doc_id")))


def stream_sanitize(spark, folder):
    stream = streams.sanitized(_stream_documents(spark, folder), "text")
    return _landed(spark, stream, "stream-sanitized").withColumnRenamed("text", "sanitized")


def stream_dlp(spark, folder):
    stream = streams.decided(_stream_documents(spark, folder), "text").select(
        "doc_id", "safe", "action"
    )
    return _landed(spark, stream, "stream-dlp", "action").select("doc_id", "safe", "action")


def stream_event_counts(spark, folder):
    log = _stream(spark, folder, "events").select("ts", "event_type")
    counts = streams.counted(log, "ts", ["event_type"], "1 hour", "10 minutes")
    path = new_path(spark, "stream-counts")
    query = streams.keep_counts(counts, path, new_path(spark, "progress"), available_now=True)
    query.awaitTermination()
    return _hour_text(streams.current_counts(spark, path, ["event_type"]))


def stream_counts_late(spark, folder):
    """Counts and late rows of events that come in four batches, a seventh of them in the last."""
    log = table(spark, folder, "events", "event_id", "ts", "event_type")
    tenth = F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10))
    log = log.withColumn("b", F.when(F.col("event_id") % 7 == 0, 3).otherwise(tenth))
    source, path = new_path(spark, "event-batches"), new_path(spark, "stream-sums")
    sums = live.Sums(path, "ts", "1 hour", "10 minutes", ("event_type string",), {"n": F.count("*")})
    progress = new_path(spark, "progress")
    for b in range(4):  # the stream is stopped and goes on with each
        log.filter(F.col("b") == b).write.mode("append").parquet(source)
        stream = streams.read_files(spark, source, log.schema)
        sums.start(stream, progress, available_now=True, tidy_every=2).awaitTermination()
    late = sums.late_rows(spark, "event_id bigint, ts timestamp_ntz, event_type string")
    lost = events.window_counts(late, "ts", ["event_type"]).withColumnRenamed("n", "late")
    both = sums.current(spark).withColumn("late", F.lit(0)).unionByName(
        lost.withColumns({"n": F.lit(0), "window_start": F.col("window_start").cast("timestamp")})
    )
    whole = both.groupBy("window_start", "event_type").agg(
        F.sum("n").cast("bigint").alias("n"), F.sum("late").cast("bigint").alias("late")
    )
    return _hour_text(whole)


def stream_parted(spark, folder):
    """BLOCK and ALLOW rows in sinks of their own."""
    paths = {action: new_path(spark, f"sink-{action}") for action in (fixed.BLOCK, fixed.ALLOW)}
    query = live.part_by_action(
        _stream_documents(spark, folder), "text", *paths.values(), new_path(spark, "progress"),
        available_now=True,
    )
    query.awaitTermination()
    sinks = [spark.read.parquet(p).withColumn("sink", F.lit(a)) for a, p in paths.items()]
    return sinks[0].unionByName(sinks[1]).select("doc_id", "safe", "action", "sink")


def stream_overview(spark, folder):
    """The overview by source and day and all their levels, kept by a stream and a batch run again."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 5).cast("int"))
    measures = {
        "requests": F.count("*"),
        "injections_blocked": F.count_if(F.col("hit")),
        "dlp_events": F.count_if(F.col("leak")),
    }
    sums = live.Sums(
        new_path(spark, "overview"), "at", "1 day", "1 day", ("source string",), measures
    )
    rows = _stream(spark, folder, "documents", "doc_id").select("doc_id", "text", "source")
    batch = documents(spark, folder, "source")
    rows = rows.withColumn("text", planted.with_phrase("text", F.col("doc_id")))
    rows, batch = (
        r.select("source", day.cast("timestamp").alias("at"), inbound.hit("text").alias("hit"),
                 egress.leaks("text").alias("leak"))
        for r in (rows, batch)
    )
    sums.start(rows, new_path(spark, "progress"), available_now=True).awaitTermination()
    sums.write(batch, 0)
    daily = sums.current(spark).withColumn("day", F.date_format("window_start", "yyyy-MM-dd"))
    return live.levels(daily, ["source", "day"], list(measures))


def stream_event_log(spark, folder):
    """Findings of a stream in the event log."""
    found = findings.findings(_stream_documents(spark, folder), "doc_id", "text")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 5).cast("int"))
    path = new_path(spark, "event-log")
    logged = events.as_events(found, "doc_id", day)
    query = events.append_stream(logged, path, new_path(spark, "progress"), available_now=True)
    query.awaitTermination()
    feed = events.event_feed(spark.read.parquet(path), since="2024-01-01", until="2024-01-06")
    return feed.select(
        F.date_format("event_time", "yyyy-MM-dd").alias("day"),
        "source_id", "kind", "rule_id", "matches",
    )


def stream_guarded(spark, folder):
    """Both passes on a stream."""
    path = new_path(spark, "stream-guarded")
    query = streams.guarded(
        _stream_documents(spark, folder), "text", path, new_path(spark, "progress"),
        keyword_scorer, "keywords", available_now=True,
    )
    query.awaitTermination()
    rows = spark.read.parquet(path).drop("batch_id")
    return rows.withColumnRenamed("text", "sanitized")


QUERIES = {
    f.__name__: f
    for f in (
        sanitize_documents, sanitize_pages, sanitize_conversations, injection_hits_by_rule,
        threat_flag, threat_rows_only, custom_rules_sanitize, row_rules_sanitize,
        blocklist_sanitize, rule_toggle, dlp_counts, dlp_violations_long, dlp_action, dlp_report,
        pixel_urls, anonymize_queries, search_request_split, normalize_searxng, normalize_brave,
        provider_union, provider_routing, search_responses, sanitize_requests, request_threat,
        request_pages, agent_status, pair_quarantine, overview_stats, rule_monitor, event_log,
        event_feed_filter, latency_percentiles, event_counts_tumbling, semantic_candidates,
        semantic_prompt, semantic_apply, semantic_scored, guarded_documents, settings_defaults,
        config_gated_sanitize, settings_guarded, stream_sanitize, stream_dlp, stream_event_counts,
        search_guarded, search_partial, search_sink, requests_guarded, requests_sink,
        pairs_guarded, pairs_sink, latency_percentiles_hot, semantic_outage,
        settings_unlisted_model, search_by_settings, requests_by_settings, pairs_by_settings,
        stream_event_log, stream_guarded, semantic_deadline, semantic_incremental, semantic_fitted,
        search_damaged, blocklist_phrases, catalogue_findings,
        latency_sketched, stream_counts_late, stream_parted, stream_overview,
    )
}
