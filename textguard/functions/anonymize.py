"""Search-query anonymising: private paths and settings files out, a neutral suffix on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions import fixed
from textguard.functions.dialect import PREFIX, SPACE, to_java

_PRIVATE = to_java(fixed.PRIVATE_TOKENS)
# trim() only knows the space character. The end is matched by a lookbehind that allows one
# attempt per gap, so a long gap inside the query costs one pass.
_ENDS = rf"{PREFIX}\A[{SPACE}]++|(?<![{SPACE}])[{SPACE}]++\z"


def strip_private(query: Column | str) -> Column:
    """Remove home paths and names of ``.json`` and ``.env`` files; what surrounds them stays."""
    query = F.col(query) if isinstance(query, str) else query
    return F.regexp_replace(query, F.lit(_PRIVATE), F.lit(""))


def strip_ends(text: Column | str) -> Column:
    """Remove whitespace of any kind at both ends."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(text, F.lit(_ENDS), F.lit(""))


def secured_query(query: Column | str) -> Column:
    """What is sent to a search provider in place of the raw query."""
    return F.concat(strip_ends(strip_private(query)), F.lit(fixed.QUERY_SUFFIX))
