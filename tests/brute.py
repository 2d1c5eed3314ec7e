"""Row-at-a-time Python with ``re``, to check the column functions against."""

import re

from textguard.functions import fixed

INBOUND = (
    fixed.IGNORE_PREVIOUS,
    fixed.SYSTEM_OVERRIDE,
    fixed.DELETE_FILES,
    fixed.PERSONA_OVERRIDE,
    fixed.RESPOND_ONLY,
    fixed.SUDO_RM,
)
OUTBOUND = {
    "api_key": fixed.API_KEY,
    "env_variable": fixed.ENV_VARIABLE,
    "dns_exfiltration": fixed.DNS_EXFILTRATION,
    "markdown_pixel": fixed.MARKDOWN_PIXEL,
}


def clean(text, patterns=INBOUND):
    out = text or ""
    for pattern in patterns:
        out = re.sub(pattern, fixed.MARKER, out)
    return out


def counts(text):
    return {name: len(re.findall(p, text or "")) for name, p in OUTBOUND.items()}


def urls(text):
    return re.findall(fixed.MARKDOWN_PIXEL, text or "")


def secured(query):
    return re.sub(fixed.PRIVATE_TOKENS, "", query).strip() + fixed.QUERY_SUFFIX
