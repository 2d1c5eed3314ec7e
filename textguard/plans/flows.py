"""Whole flows: search, sanitise requests, inbound/outbound pairs, plain text tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.functions import egress, inbound
from textguard.operators import gating
from textguard.operators import requests as req
from textguard.operators import second_pass as second
from textguard.sources import search
from textguard.sources.requests import split_valid_pairs, split_valid_requests
from textguard.sources.rules import DLP, INJECTION, Rule, check_rules
from textguard.sources.settings import unlisted

MakeScorer = Callable[[str], second.Scorer]


def search_flow(
    requests: DataFrame,
    landed: DataFrame,
    rules: Sequence[Rule] | None = None,
    brave_key: bool = True,
    make_scorer: MakeScorer | None = None,
    model_name: str = "",
    settings: DataFrame | None = None,
    profile_id: str = "profile_id",
) -> tuple[DataFrame, DataFrame]:
    """Search responses and refused requests, with the second pass where a model is given.

    With ``settings`` (from ``with_defaults``) each request's ``profile_id`` says how its
    results are treated and which model is asked.

    ``requests`` has ``request_id`` and ``q``; ``landed`` has at most one response for each.
    The raw query is echoed, the anonymised one is what the provider was sent. A request
    without a response has no results and a NULL ``fetch_status``.
    """
    _checked(requests, rules)
    asked, refused = search.split_requests(requests)
    found = search.normalize(landed, brave_key)
    joined = asked.join(found.select("request_id", "fetch_status", "items"), "request_id", "left")
    items = F.coalesce("items", F.array().cast(search.ITEMS_TYPE))
    own = [profile_id] if settings is not None else []
    responses = joined.select(
        "request_id",
        F.col("q").alias("query"),
        "secured_query",
        F.lit(True).alias("verified"),
        "fetch_status",
        items.alias("results"),
        *own,
    )
    if settings is None:
        clean = req.sanitize_items("results", rules, search=True)
        responses = responses.withColumn("results", clean)
        if make_scorer:
            responses = _guarded_items(responses, make_scorer, model_name)
    else:
        responses = _items_by_settings(responses, settings, profile_id, make_scorer, rules, True)
    return responses, refused


def _checked(frame: DataFrame, *sets: Sequence[Rule] | None) -> None:
    """Refuse a user's rules that do not compile before the job, not in one of its tasks."""
    own = [r for rules in sets if rules and rules not in (INJECTION, DLP) for r in rules]
    check_rules(frame.sparkSession, own)


def _guarded_items(requests: DataFrame, make_scorer: MakeScorer, model_name: str) -> DataFrame:
    """Requests with the condemned of their sanitised ``results`` replaced."""
    asked = req.asked_items(requests)
    prompts = second.candidates(req.item_texts(asked), "content")
    return req.apply_verdicts_to_items(asked, second.score(prompts, make_scorer, model_name))


def _items_by_settings(
    requests: DataFrame,
    settings: DataFrame,
    profile_id: str,
    make_scorer: MakeScorer | None,
    rules: Sequence[Rule] | None,
    search: bool,
) -> DataFrame:
    """Requests with their ``results`` treated by each one's own settings; ``reason`` beside them."""
    kept = requests.columns
    rows = gating.with_settings(requests, settings, profile_id)
    clean = req.gated_items("results", rules or INJECTION, search)
    rows = rows.withColumns({"results": clean, "reason": unlisted()})
    if make_scorer:
        wanted = F.col("protected") & F.col("use_model")
        rows = rows.select(*kept, "reason", "model_name", wanted.alias("_asked"))
        asked = req.asked_items(rows, enabled=F.col("_asked"), model_name="model_name")
        texts = req.item_texts(asked, model_name="model_name")
        prompts = second.candidates(texts, "content", model_name="model_name")
        rows = req.apply_verdicts_to_items(asked, second.score_by_model(prompts, make_scorer))
    return rows.select(*kept, "reason")


def sanitize_flow(
    requests: DataFrame,
    rules: Sequence[Rule] | None = None,
    make_scorer: MakeScorer | None = None,
    model_name: str = "",
    settings: DataFrame | None = None,
    profile_id: str = "profile_id",
) -> tuple[DataFrame, DataFrame]:
    """Sanitise responses, one row per request, and the invalid requests with a reason.

    Without a model this is one pass over the requests with no shuffle. ``settings`` as in
    ``search_flow``.
    """
    _checked(requests, rules)
    valid, invalid = split_valid_requests(requests)
    if settings is not None:
        clean = _items_by_settings(valid, settings, profile_id, make_scorer, rules, False)
        return req.with_request_report(clean), invalid
    clean = valid.withColumn("results", req.sanitize_items("results", rules))
    if make_scorer:
        clean = _guarded_items(clean, make_scorer, model_name)
    return req.with_request_report(clean), invalid


def pair_flow(
    pairs: DataFrame,
    rules: Sequence[Rule] | None = None,
    dlp_rules: Sequence[Rule] = DLP,
    make_scorer: MakeScorer | None = None,
    model_name: str = "",
    settings: DataFrame | None = None,
    profile_id: str = "profile_id",
) -> tuple[DataFrame, DataFrame]:
    """Pair reports and the invalid pairs with a reason.

    ``settings`` as in ``search_flow``; a pair whose profile does not ask for leak prevention is
    let through without a report.
    """
    _checked(pairs, rules, dlp_rules)
    valid, invalid = split_valid_pairs(pairs)
    if settings is not None:
        column, kept = "sanitized_inbound_preview", valid.columns
        rows = gating.with_settings(valid, settings, profile_id)
        rows = rows.withColumn(column, gating.gated_sanitize("incoming_content", rules or INJECTION))
        leaks = F.col("pii_leak_prevention") & F.col("protected")
        rows = egress.with_dlp_report(rows, "outbound_intent", dlp_rules, enabled=leaks)
        rows = rows.withColumn("reason", unlisted())
        report = ("safe", "violations", "action", "is_null")
        if make_scorer:
            wanted = F.col("protected") & F.col("use_model")
            rows = second.asked(rows, column, wanted, "model_name")
            prompts = second.candidates(rows, column, model_name="model_name")
            rows = second.apply_verdicts(rows, second.score_by_model(prompts, make_scorer), column)
        rows = rows.select(*kept, column, "reason", *(c for c in report if c in rows.columns))
        return req.with_agent_status(rows), invalid
    if not make_scorer:
        return req.pair_report(valid, rules, dlp_rules), invalid
    column = "sanitized_inbound_preview"
    clean = egress.with_dlp_report(
        valid.withColumn(column, inbound.sanitize("incoming_content", rules)),
        "outbound_intent",
        dlp_rules,
    )
    clean = second.asked(clean, column)
    verdicts = second.score(second.candidates(clean, column), make_scorer, model_name)
    judged = second.apply_verdicts(clean, verdicts, column).drop("malicious")
    return req.with_agent_status(judged), invalid


def text_flow(
    frame: DataFrame,
    text: str,
    rules: Sequence[Rule] | None = None,
    make_scorer: MakeScorer | None = None,
    model_name: str = "",
) -> DataFrame:
    """Any table with its text column sanitised, and ``threat`` beside it."""
    _checked(frame, rules)
    clean = frame.withColumn(text, inbound.sanitize(text, rules))
    if make_scorer:
        clean = second.asked(clean, text)
        verdicts = second.score(second.candidates(clean, text), make_scorer, model_name)
        clean = second.apply_verdicts(clean, verdicts, text).drop("malicious")
    return clean.withColumn("threat", inbound.flagged(text))


def settings_flow(
    frame: DataFrame,
    settings: DataFrame,
    text: str,
    profile_id: str,
    make_scorer: MakeScorer | None = None,
    rules: Sequence[Rule] = INJECTION,
) -> DataFrame:
    """A table sanitised by each row's own protection settings: ``threat`` and ``reason`` beside it.

    ``settings`` comes from ``with_defaults``. Rows whose settings ask for a model are scored by
    the one they name, listed or not, all in one job; protection that is off leaves the text as
    it is, so nothing is scored. ``reason`` says what in a row's settings is not listed.
    """
    _checked(frame, rules)
    kept = frame.columns
    clean = gating.with_settings(frame, settings, profile_id)
    clean = clean.withColumns({text: gating.gated_sanitize(text, rules), "reason": unlisted()})
    if make_scorer:
        wanted = F.col("protected") & F.col("use_model")
        clean = second.asked(clean, text, wanted, "model_name")
        prompts = second.candidates(clean, text, model_name="model_name")
        clean = second.apply_verdicts(clean, second.score_by_model(prompts, make_scorer), text)
    return clean.select(*kept, inbound.flagged(text).alias("threat"), "reason")
