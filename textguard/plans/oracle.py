"""The registered queries in SQL, on the same tables, with the patterns as stated."""

from __future__ import annotations

from textguard.functions import fixed
from textguard.plans import planted
from textguard.plans.planted import quoted
from textguard.plans.queries import BLOCKED, CUSTOM_PATTERNS, MEETING
from textguard.sources.rules import DLP, INJECTION

DOC = planted.with_phrase_sql("text", "doc_id")
DOCS = f"SELECT doc_id, source, lang, {DOC} AS t FROM documents"
CONV = planted.with_phrase_sql("text", "conv_id * 3 + turn")
CONVS = f"SELECT conv_id, turn, role, {CONV} AS t FROM conversations"


def fold(text: str, patterns=tuple(r.pattern for r in INJECTION)) -> str:
    for p in patterns:
        text = f"regexp_replace({text}, {quoted(p)}, {quoted(fixed.MARKER)}, 'g')"
    return text


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}))"


def matches(text: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {quoted(p)})" for p in patterns) + ")"


def flagged(text: str) -> str:
    return f"contains({text}, {quoted(fixed.MARKER_PREFIX)})"


def is_open(text: str) -> str:
    return f"(length({text}) > 0 AND NOT contains({text}, {quoted(fixed.MARKER)}))"


def anonymized(query: str) -> str:
    bare = f"regexp_replace({query}, {quoted(fixed.PRIVATE_TOKENS)}, '', 'g')"
    return rf"regexp_replace({bare}, '^\s+|\s+$', '', 'g') || {quoted(fixed.QUERY_SUFFIX)}"


LEAK = matches("t", [r.pattern for r in DLP])
HIT = f"({matches('t', [r.pattern for r in INJECTION])} OR {flagged('t')})"
ACTION = f"CASE WHEN {LEAK} THEN 'BLOCK' ELSE 'ALLOW' END"
RULES = [("injection", r) for r in INJECTION] + [("dlp", r) for r in DLP]


def monitor(chosen, by: str = "") -> str:
    group = f" GROUP BY {by}" if by else ""
    by = f"{by}, " if by else ""
    parts = (
        f"SELECT {by}{quoted(kind)} AS kind, {quoted(r.rule_id)} AS rule_id, "
        f"sum({count('t', r.pattern)})::BIGINT AS hits, "
        f"count(*) FILTER ({count('t', r.pattern)} > 0) AS texts_hit FROM ({DOCS}){group}"
        for kind, r in chosen
    )
    return " UNION ALL ".join(parts)


def long_findings(chosen) -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, {quoted(kind)} AS kind, {quoted(r.rule_id)} AS rule_id, "
        f"{count('t', r.pattern)} AS matches FROM ({DOCS})"
        for kind, r in chosen
    )


# --- search --------------------------------------------------------------------------------

QUERY = planted.with_paths_sql("text", "item_id")
REQUESTS = (
    "SELECT item_id AS request_id, CASE WHEN item_id % 7 = 3 THEN '' WHEN item_id % 7 = 5 "
    f"THEN NULL ELSE {QUERY} END AS q FROM benchmark"
)
_FIRST = (
    "SELECT page_id AS request_id, page_id % 4 AS p, CASE WHEN page_id % 11 = 10 THEN 500 "
    "ELSE 200 END AS fetch_status, 0 AS rank, "
    "CASE WHEN page_id % 5 = 0 THEN '' ELSE "
    "regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title, "
    f"CASE WHEN page_id % 7 = 0 THEN '' ELSE {planted.with_phrase_sql('html', 'page_id')} END "
    "AS content, url FROM pages"
)
_SECOND = (
    "SELECT page_id AS request_id, page_id % 4 AS p, CASE WHEN page_id % 11 = 10 THEN 500 "
    "ELSE 200 END AS fetch_status, 1 AS rank, 'second' AS title, '' AS content, '' AS url "
    "FROM pages"
)
LANDED = f"({_FIRST} UNION ALL {_SECOND})"
_SEARXNG = "fetch_status = 200 AND p IN (0, 3)"
_BRAVE = "fetch_status = 200 AND p = 1"
_ITEM = "SELECT request_id, rank, title, content, url"

PAGE_REQUESTS = (
    "SELECT page_id AS request_id, CASE WHEN page_id % 7 = 3 THEN '' WHEN page_id % 7 = 5 "
    f"THEN NULL ELSE {planted.with_paths_sql('b.text', 'page_id')} END AS q FROM pages "
    "JOIN benchmark b ON b.item_id = page_id % (SELECT count(*) FROM benchmark)"
)

# --- pairs ---------------------------------------------------------------------------------

PAIRS = (
    "SELECT concat(u.conv_id, '-', u.turn) AS pair_id, u.t AS incoming, a.t AS outgoing "
    f"FROM ({CONVS}) u LEFT JOIN ({CONVS}) a ON a.conv_id = u.conv_id "
    "AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'"
)
_OUT = matches("outgoing", [r.pattern for r in DLP])

# --- second pass ---------------------------------------------------------------------------

CLEAN = f"SELECT doc_id, {fold('t')} AS t FROM ({DOCS})"
_PROMPT = (
    f"{quoted(fixed.PROMPT_HEAD)} || t || {quoted(fixed.PROMPT_TAIL)}"
)
_ANSWER = (
    "CASE WHEN contains(t, '://') THEN NULL WHEN contains(t, 'ordinary closing line') "
    "THEN 'Malicious.' ELSE 'safe' END"
)


def judged(condition: str) -> str:
    return (
        f"CASE WHEN {is_open('t')} AND {condition} THEN {quoted(fixed.SEMANTIC_MARKER)} "
        "ELSE t END"
    )


# --- settings ------------------------------------------------------------------------------

_N = r"regexp_extract(source, '(\d+)', 1)::INT"
SETTINGS = f"""
SELECT source,
  CASE WHEN n % 5 = 0 THEN false ELSE true END AS protected,
  CASE WHEN n % 5 = 1 THEN 'strict'
       WHEN n % 5 = 2 THEN 'permissive' ELSE 'balanced' END AS security_profile,
  NOT (n % 5 = 2) AS indirect_injection,
  NOT (n % 5 = 3) AS jailbreaks,
  NOT (n % 5 = 3) AS destructive_commands,
  (n % 5 != 4 AND n % 3 = 0) AS pii_leak_prevention,
  ((n % 5 = 1 OR n = 12)) AS use_model,
  CASE WHEN n = 12 THEN 'phi3:mini' ELSE 'qwen2.5-coder:1.5b' END AS model_name,
  CASE WHEN n % 5 = 4 THEN {quoted('|'.join(BLOCKED))} ELSE '' END AS blocklist
FROM (SELECT DISTINCT source, {_N} AS n FROM documents)
"""


def blocked(text: str) -> str:
    for phrase in BLOCKED:
        text = f"replace({text}, {quoted(phrase)}, {quoted(fixed.MARKER)})"
    return text


def gated(rows: str) -> str:
    """One step per rule, each reading the step before it; then block list and main switch.

    ``rows`` have the text as ``t`` and as ``raw``, and the settings.
    """
    for r in INJECTION:
        done = f"regexp_replace(t, {quoted(r.pattern)}, {quoted(fixed.MARKER)}, 'g')"
        rows = f"SELECT * REPLACE (CASE WHEN {r.module} THEN {done} ELSE t END AS t) FROM ({rows})"
    return (
        "SELECT * REPLACE (CASE WHEN NOT protected THEN raw "
        f"WHEN blocklist != '' THEN {blocked('t')} ELSE t END AS t) FROM ({rows})"
    )


def _gated_rows() -> str:
    return gated(
        f"SELECT d.doc_id, d.t AS raw, d.t, s.* FROM ({DOCS}) d JOIN ({SETTINGS}) s USING (source)"
    )


def own_settings(rows: str, row_id: str) -> str:
    """``rows`` with the settings of the profile that ``row_id`` picks, or the defaults."""
    return f"""
        SELECT r.*, coalesce(protected, true) AS protected,
          coalesce(indirect_injection, true) AS indirect_injection,
          coalesce(jailbreaks, true) AS jailbreaks,
          coalesce(destructive_commands, true) AS destructive_commands,
          coalesce(pii_leak_prevention, false) AS pii_leak_prevention,
          coalesce(use_model, false) AS use_model, coalesce(blocklist, '') AS blocklist
        FROM ({rows}) r LEFT JOIN ({SETTINGS}) s ON s.source = concat('src', {row_id} % 20)
    """


_SANITIZED = f"SELECT doc_id, {fold('t')} AS sanitized FROM ({DOCS})"
_COUNTS = (
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, "
    "count(*) AS n FROM events GROUP BY 1, 2"
)



def _responses(content: str, items: str = "") -> str:
    """Search responses; ``content`` is what becomes of a sanitised content ``t``."""
    landed = f"SELECT * FROM {LANDED} WHERE ({_SEARXNG}) OR ({_BRAVE})"
    items = items or f"SELECT *, {fold('content')} AS t FROM ({landed})"
    return (
        f"SELECT r.request_id, q AS query, {anonymized('q')} AS secured_query, true AS verified, "
        "f.fetch_status, i.rank, i.title, i.content, i.url "
        f"FROM ({PAGE_REQUESTS}) r "
        f"LEFT JOIN (SELECT DISTINCT request_id, fetch_status FROM {LANDED}) f USING (request_id) "
        f"LEFT JOIN (SELECT request_id, rank, title, {content} AS content, url FROM "
        f"({items})) i "
        "USING (request_id) WHERE coalesce(q, '') != ''"
    )


_LINES = (
    "SELECT doc_id, source, lang, rank, lines[rank + 1] AS t "
    "FROM (SELECT *, unnest(range(len(lines)))::INT AS rank FROM "
    f"(SELECT *, string_split(t, chr(10)) AS lines FROM ({DOCS})))"
)


def _requests(request_id: str, content: str, lines: str = "") -> str:
    """Lines as items; ``content`` is what becomes of a sanitised line ``t``."""
    lines = lines or f"SELECT * REPLACE ({fold('t')} AS t) FROM ({_LINES})"
    return (
        f"SELECT {request_id} AS request_id, 'PROCESSED' AS status, bool_or(hit) OVER "
        "(PARTITION BY doc_id) AS threat_intercepted, rank, source AS title, content, "
        f"lang AS url FROM (SELECT *, {flagged('content')} AS hit FROM ("
        f"SELECT *, {content} AS content FROM ({lines})))"
    )


def _statuses(clean: str, pairs: str = "") -> str:
    """Pair reports; ``clean`` is what becomes of a sanitised inbound text ``t``."""
    pairs = pairs or (
        f"SELECT pair_id, {fold('incoming')} AS t, "
        f"{_OUT} AS leak FROM ({PAIRS}) WHERE outgoing IS NOT NULL"
    )
    return (
        "SELECT pair_id, 'COMPLETED' AS simulation_status, hit AS inbound_threat_detected, "
        "clean AS sanitized_inbound_preview, NOT leak AS safe, "
        "CASE WHEN leak THEN 'BLOCK' ELSE 'ALLOW' END AS action, "
        "CASE WHEN hit OR leak THEN 'ISOLATED' ELSE 'SECURE' END AS agent_status FROM ("
        f"SELECT *, {flagged('clean')} AS hit FROM (SELECT *, {clean} AS clean FROM ({pairs})))"
    )


_GUARDED = (
    f"SELECT doc_id, sanitized, {flagged('sanitized')} AS threat FROM (SELECT doc_id, "
    + judged(f"coalesce({_ANSWER} = 'Malicious.', false)")
    + f" AS sanitized FROM ({CLEAN}))"
)
_SCORED = (
    f"SELECT DISTINCT sha256(t) AS text_hash, {_ANSWER} AS verdict, "
    f"CASE WHEN {_ANSWER} IS NULL THEN 'unavailable' ELSE 'ok' END AS status "
    f"FROM ({CLEAN}) WHERE {is_open('t')}"
)
_SLOW = f"CASE WHEN length(t) % 499 = 0 THEN NULL ELSE {_ANSWER} END"
_DEADLINE = (
    f"SELECT DISTINCT sha256(t) AS text_hash, {_SLOW} AS verdict, "
    f"CASE WHEN {_SLOW} IS NULL THEN 'unavailable' ELSE 'ok' END AS status "
    f"FROM ({CLEAN}) WHERE {is_open('t')}"
)
_INCREMENTAL = (
    f"WITH d AS (SELECT DISTINCT t, {_ANSWER} AS known FROM ({CLEAN}) WHERE {is_open('t')}), "
    f"b AS (SELECT t FROM d UNION SELECT t FROM (SELECT {fold('t')} AS t FROM ({CONVS})) WHERE {is_open('t')}) "
    "SELECT sha256(b.t) AS text_hash, coalesce(d.known, 'later') AS verdict, 'ok' AS status "
    "FROM b LEFT JOIN d ON d.t = b.t"
)
# Multinomial naive Bayes with one added to every count, as sums over words.
_FITTED = (
    f"WITH a AS (SELECT doc_id, t FROM ({CLEAN}) WHERE {is_open('t')}), "
    "w AS (SELECT doc_id, unnest(regexp_extract_all(lower(t), '[a-z]+')) AS w FROM a), "
    "x AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL), "
    "l AS (SELECT doc_id, toxic FROM labels JOIN a USING (doc_id) WHERE toxic IN (0, 1)), "
    "c AS (SELECT toxic, w, sum(n) AS n FROM x JOIN l USING (doc_id) GROUP BY ALL), "
    "v AS (SELECT DISTINCT w FROM c), k AS (SELECT count(*) AS k FROM v), "
    "p AS (SELECT toxic, ln((count(*) + 1) / ((SELECT count(*) FROM l) + (SELECT count(DISTINCT toxic) FROM l))) AS p "
    "FROM l GROUP BY toxic), "
    "s AS (SELECT toxic, sum(n) AS s FROM c GROUP BY toxic), "
    "f AS (SELECT p.toxic, v.w, ln((coalesce(c.n, 0) + 1) / (s.s + k.k)) AS f "
    "FROM p CROSS JOIN v CROSS JOIN k JOIN s ON s.toxic = p.toxic LEFT JOIN c ON c.toxic = p.toxic AND c.w = v.w), "
    "y AS (SELECT x.doc_id, f.toxic, sum(x.n * f.f) AS y FROM x JOIN f USING (w) GROUP BY ALL), "
    "z AS (SELECT a.doc_id, p.toxic, p.p + coalesce(y.y, 0) AS z FROM a CROSS JOIN p "
    "LEFT JOIN y ON y.doc_id = a.doc_id AND y.toxic = p.toxic), "
    "m AS (SELECT doc_id, max_by(toxic, z) = 1 AS malicious FROM z GROUP BY doc_id) "
    f"SELECT doc_id, coalesce(malicious, false) AS malicious FROM ({CLEAN}) LEFT JOIN m USING (doc_id)"
)
_LOG = (
    "SELECT strftime(DATE '2024-01-01' + (doc_id % 5)::INT, '%Y-%m-%d') AS day, "
    "doc_id::VARCHAR AS source_id, kind, rule_id, matches "
    f"FROM ({long_findings(RULES)}) WHERE matches > 0"
)
_BY_SETTINGS = judged(f"protected AND use_model AND coalesce({_ANSWER} = 'Malicious.', false)")

_PHRASES = (
    f"list_concat([{', '.join(map(quoted, BLOCKED))}], (SELECT list(array_to_string("
    "string_split(text, ' ')[1:3], ' ') ORDER BY item_id) FROM benchmark), "
    f"[{', '.join(map(quoted, MEETING))}])"
)
_ITEM_RULES = (
    "SELECT concat('item_', i, '_', n) AS rule_id, '(?i)' || w[n + 1] || '[ .,]+' || w[n + 2] AS pattern "
    "FROM (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, "
    "string_split_regex(text, '[^A-Za-z]+')[1:11] AS w, unnest(range(len(w) - 1)) AS n FROM benchmark)"
)
ORACLE = {
    "sanitize_documents": _SANITIZED,
    "sanitize_pages": (
        f"SELECT page_id, {fold(planted.with_phrase_sql('html', 'page_id'))} AS sanitized FROM pages"
    ),
    "sanitize_conversations": (
        f"SELECT conv_id, turn, {fold('t')} AS sanitized FROM ({CONVS})"
    ),
    "injection_hits_by_rule": (
        f"SELECT rule_id, hits, texts_hit FROM ({monitor(RULES[:len(INJECTION)])})"
    ),
    "threat_flag": (
        f"SELECT doc_id, {flagged('t')} AS threat, {is_open('t')} AS second_pass FROM ({CLEAN})"
    ),
    "threat_rows_only": f"{_SANITIZED} WHERE {HIT}",
    "custom_rules_sanitize": (
        f"SELECT doc_id, {fold('t', CUSTOM_PATTERNS)} AS sanitized FROM ({DOCS})"
    ),
    "row_rules_sanitize": (
        f"SELECT doc_id, CASE WHEN lang = 'en' THEN {fold('t', CUSTOM_PATTERNS)} "
        f"ELSE {fold('t')} END AS sanitized FROM ({DOCS})"
    ),
    "blocklist_sanitize": f"SELECT doc_id, {blocked(fold('t'))} AS sanitized FROM ({DOCS})",
    "blocklist_phrases": (
        f"SELECT doc_id, list_reduce(list_concat([{fold('t')}], {_PHRASES}), "
        f"lambda acc, p: replace(acc, p, {quoted(fixed.MARKER)})) AS sanitized FROM ({DOCS})"
    ),
    "catalogue_findings": (
        f"SELECT doc_id, kind, rule_id, matches FROM ({long_findings(RULES)}) WHERE matches > 0 "
        "UNION ALL SELECT * FROM (SELECT doc_id, 'injection', rule_id, "
        f"len(regexp_extract_all(t, pattern)) AS matches FROM ({DOCS}), ({_ITEM_RULES})) WHERE matches > 0"
    ),
    "rule_toggle": (
        "SELECT doc_id, "
        + fold("t", [r.pattern for r in INJECTION if r.rule_id not in ("system_override", "sudo_rm")])
        + f" AS sanitized FROM ({DOCS})"
    ),
    "dlp_counts": (
        "SELECT doc_id, "
        + ", ".join(f"{count('t', r.pattern)} AS {r.rule_id}" for r in DLP)
        + f" FROM ({DOCS})"
    ),
    "dlp_violations_long": (
        f"SELECT doc_id, rule_id AS type, matches FROM ({long_findings(RULES[len(INJECTION):])}) "
        "WHERE matches > 0"
    ),
    "dlp_action": f"SELECT doc_id, NOT {LEAK} AS safe, {ACTION} AS action FROM ({DOCS})",
    "dlp_report": (
        f"SELECT doc_id, NOT {LEAK} AS safe, {ACTION} AS action, concat_ws(',', "
        + ", ".join(
            f"CASE WHEN {count('t', r.pattern)} > 0 THEN concat('{r.rule_id}:', {count('t', r.pattern)}) END"
            for r in DLP
        )
        + f") AS violations FROM ({DOCS})"
    ),
    "pixel_urls": (
        f"SELECT doc_id, unnest(regexp_extract_all(t, {quoted(fixed.MARKDOWN_PIXEL)}, 1)) AS url "
        f"FROM ({DOCS})"
    ),
    "anonymize_queries": (
        f"SELECT item_id, q AS query, {anonymized('q')} AS secured_query "
        f"FROM (SELECT item_id, {QUERY} AS q FROM benchmark)"
    ),
    "search_request_split": (
        "SELECT request_id, CASE WHEN coalesce(q, '') = '' THEN 400 ELSE 200 END AS status, "
        f"CASE WHEN coalesce(q, '') != '' THEN {anonymized('q')} END AS secured_query, "
        f"CASE WHEN coalesce(q, '') = '' THEN {quoted(fixed.MISSING_QUERY)} END AS error "
        f"FROM ({REQUESTS})"
    ),
    "normalize_searxng": f"{_ITEM} FROM {LANDED} WHERE {_SEARXNG}",
    "normalize_brave": f"{_ITEM} FROM {LANDED} WHERE {_BRAVE}",
    "provider_union": (
        f"{_ITEM} FROM {LANDED} WHERE {_SEARXNG} UNION ALL {_ITEM} FROM {LANDED} WHERE {_BRAVE}"
    ),
    "provider_routing": (
        f"SELECT request_id, fetch_status, count(*) FILTER ({_SEARXNG} OR {_BRAVE}) AS n_items "
        f"FROM {LANDED} GROUP BY 1, 2"
    ),
    "search_responses": _responses("t"),
    "search_guarded": _responses(judged(f"coalesce({_ANSWER} = 'Malicious.', false)")),
    "search_sink": f"SELECT * EXCLUDE (secured_query) FROM ({_responses('t')})",
    "search_partial": (
        "SELECT page_id AS request_id, 200 AS fetch_status, page_id % 3 = 2 AS parse_ok, "
        "CASE WHEN page_id % 3 = 2 THEN 3 ELSE 1 END::BIGINT AS n_items, "
        f"{planted.with_phrase_sql('html', 'page_id')} AS content FROM pages"
    ),
    "search_damaged": (
        "SELECT page_id AS request_id, page_id % 4 = 3 AS parse_ok, "
        "CASE WHEN page_id % 4 = 3 THEN 1 ELSE 0 END::BIGINT AS n_items, "
        f"CASE WHEN page_id % 4 = 3 THEN {planted.with_phrase_sql('html', 'page_id')} END AS content FROM pages"
    ),
    "sanitize_requests": _requests("doc_id", "t"),
    "requests_sink": _requests("doc_id", "t"),
    "requests_guarded": _requests(
        "doc_id // 2", judged(f"coalesce({_ANSWER} = 'Malicious.', false)")
    ),
    "request_threat": (
        f"SELECT conv_id, bool_or({HIT}) AS threat_intercepted, count(*) AS n_items, "
        f"'PROCESSED' AS status FROM ({CONVS}) GROUP BY conv_id"
    ),
    "request_pages": (
        "SELECT conv_id, turn // 4 AS page, count(*) AS n_items, "
        f"string_agg(role || ':' || {fold('t')}, '|' ORDER BY turn) AS results "
        f"FROM ({CONVS}) GROUP BY 1, 2"
    ),
    "agent_status": _statuses("t"),
    "pairs_sink": _statuses("t"),
    "pairs_guarded": _statuses(judged(f"coalesce({_ANSWER} = 'Malicious.', false)")),
    "pair_quarantine": (
        f"SELECT pair_id, 'outbound_intent missing' AS reason FROM ({PAIRS}) WHERE outgoing IS NULL"
    ),
    "overview_stats": (
        f"SELECT source, count(*) AS requests, count(*) FILTER ({HIT}) AS injections_blocked, "
        f"count(*) FILTER ({LEAK}) AS dlp_events FROM ({DOCS}) GROUP BY source"
    ),
    "rule_monitor": monitor(RULES, "lang"),
    "event_log": _LOG,
    "stream_event_log": _LOG,
    "event_feed_filter": (
        "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' "
        "AND ts < TIMESTAMP '2024-01-20' AND event_type IN ('error', 'signup') "
        "AND user_id BETWEEN 1 AND 39"
    ),
    "latency_percentiles": (
        "SELECT event_type, prob, round(v, 6) AS value FROM ("
        + " UNION ALL ".join(
            f"SELECT event_type, {p}::DOUBLE AS prob, quantile_cont(value, {p}) AS v "
            "FROM events GROUP BY event_type"
            for p in (0.5, 0.95, 0.99)
        )
        + ")"
    ),
    "latency_percentiles_hot": (
        "SELECT event_type, prob, round(v, 6) AS value FROM ("
        + " UNION ALL ".join(
            f"SELECT event_type, {p}::DOUBLE AS prob, quantile_cont("
            f"CASE WHEN event_id % 2 = 0 THEN 0 ELSE value END, {p}) AS v "
            "FROM events GROUP BY event_type"
            for p in (0.5, 0.5, 0.95)
        )
        + ")"
    ),
    "event_counts_tumbling": _COUNTS,
    "semantic_candidates": (
        f"SELECT sha256(t) AS text_hash, count(*) AS copies FROM ({CLEAN}) "
        f"WHERE {is_open('t')} GROUP BY 1"
    ),
    "semantic_prompt": (
        f"SELECT DISTINCT sha256(t) AS text_hash, {_PROMPT} AS prompt FROM ({CLEAN}) "
        f"WHERE {is_open('t')}"
    ),
    "semantic_apply": (
        f"WITH c AS ({CLEAN}), bad AS (SELECT t, max(toxic) = 1 AS toxic FROM c "
        "JOIN labels USING (doc_id) GROUP BY t) "
        f"SELECT doc_id, {is_open('t')} AND coalesce(toxic, false) AS malicious, "
        f"{judged('coalesce(toxic, false)')} AS sanitized FROM c LEFT JOIN bad USING (t)"
    ),
    "semantic_scored": _SCORED,
    "semantic_outage": _SCORED,
    "semantic_deadline": _DEADLINE,
    "semantic_incremental": _INCREMENTAL,
    "semantic_fitted": _FITTED,
    "guarded_documents": _GUARDED,
    "stream_guarded": _GUARDED,
    "settings_defaults": (
        "SELECT source AS profile_id, protected, security_profile, indirect_injection, "
        "jailbreaks, destructive_commands, pii_leak_prevention, use_model, model_name, blocklist "
        f"FROM ({SETTINGS})"
    ),
    "config_gated_sanitize": (
        "SELECT doc_id, t AS sanitized, use_model, CASE WHEN pii_leak_prevention AND "
        f"{matches('raw', [r.pattern for r in DLP])} THEN 'BLOCK' ELSE 'ALLOW' END AS action "
        f"FROM ({_gated_rows()})"
    ),
    "settings_guarded": (
        f"SELECT doc_id, sanitized, {flagged('sanitized')} AS threat FROM (SELECT doc_id, "
        f"{_BY_SETTINGS} AS sanitized FROM ({_gated_rows()}))"
    ),
    "settings_unlisted_model": (
        f"SELECT doc_id, sanitized, {flagged('sanitized')} AS threat, reason FROM (SELECT doc_id, "
        f"{_BY_SETTINGS} AS sanitized, CASE WHEN security_profile = 'strict' THEN "
        f"'model not listed' END AS reason FROM ({_gated_rows()}))"
    ),
    "search_by_settings": _responses(
        _BY_SETTINGS,
        gated(
            own_settings(
                f"SELECT *, content AS t, content AS raw FROM {LANDED} "
                f"WHERE ({_SEARXNG}) OR ({_BRAVE})",
                "request_id",
            )
        ),
    ),
    "requests_by_settings": _requests(
        "doc_id",
        _BY_SETTINGS,
        gated(own_settings(f"SELECT *, t AS raw FROM ({_LINES})", "doc_id")),
    ),
    "pairs_by_settings": _statuses(
        _BY_SETTINGS,
        "SELECT * REPLACE (leak AND pii_leak_prevention AND protected AS leak) FROM ("
        + gated(
            own_settings(
                f"SELECT pair_id, split_part(pair_id, '-', 1)::BIGINT AS conv, incoming AS t, "
                f"incoming AS raw, {_OUT} AS leak FROM ({PAIRS}) WHERE outgoing IS NOT NULL",
                "conv",
            )
        )
        + ")",
    ),
    "stream_sanitize": f"SELECT *, {flagged('sanitized')} AS threat FROM ({_SANITIZED})",
    "stream_dlp": f"SELECT doc_id, NOT {LEAK} AS safe, {ACTION} AS action FROM ({DOCS})",
    "stream_event_counts": _COUNTS,
    "stream_parted": (
        f"SELECT doc_id, NOT {LEAK} AS safe, {ACTION} AS action, {ACTION} AS sink FROM ({DOCS})"
    ),
    "stream_counts_late": (
        "WITH e AS (SELECT *, date_trunc('hour', ts) AS w, CASE WHEN event_id % 7 = 0 THEN 3 "
        "ELSE least(2, (day(ts) - 1) // 10) END AS b FROM events), "
        "x AS (SELECT b, max(max(ts)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 "
        "PRECEDING) - INTERVAL 10 MINUTE AS edge FROM e GROUP BY b), "
        "l AS (SELECT *, coalesce(w + INTERVAL 1 HOUR <= edge, false) AS gone FROM e JOIN x USING (b)) "
        "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, "
        "count(*) FILTER (NOT gone) AS n, count(*) FILTER (gone) AS late FROM l GROUP BY ALL"
    ),
    "stream_overview": (
        "SELECT source, day, concat_ws(',', CASE WHEN grouping(source) = 0 THEN 'source' END, "
        "CASE WHEN grouping(day) = 0 THEN 'day' END) AS level, sum(n)::BIGINT AS requests, "
        "sum(hit)::BIGINT AS injections_blocked, sum(leak)::BIGINT AS dlp_events FROM ("
        "SELECT source, strftime(DATE '2024-01-01' + (doc_id % 5)::INT, '%Y-%m-%d') AS day, 1 AS n, "
        f"{HIT}::INT AS hit, {LEAK}::INT AS leak FROM ({DOCS})) GROUP BY CUBE (source, day)"
    ),
    "latency_sketched": (
        "SELECT DISTINCT event_type, prob, true AS within FROM events, "
        "(SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS prob) WHERE value IS NOT NULL"
    ),
}
