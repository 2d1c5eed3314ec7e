"""Column parts of the second pass: the prompt, the reading of a verdict, its effect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions import fixed
from textguard.functions.anonymize import strip_ends


def prompt(text: Column | str) -> Column:
    """The fixed instruction with the whole text between its quotes."""
    text = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(fixed.PROMPT_HEAD), text, F.lit(fixed.PROMPT_TAIL))


def is_malicious(verdict: Column | str) -> Column:
    """A verdict condemns by containing the word, so 'not malicious' does too. NULL does not."""
    verdict = F.col(verdict) if isinstance(verdict, str) else verdict
    found = F.contains(F.upper(strip_ends(verdict)), F.lit(fixed.BAD_VERDICT))
    return F.coalesce(found, F.lit(False))


def apply_verdict(text: Column | str, malicious: Column | str) -> Column:
    """A condemned text is replaced whole; without a verdict it stays as it is."""
    text = F.col(text) if isinstance(text, str) else text
    malicious = F.col(malicious) if isinstance(malicious, str) else malicious
    return F.when(malicious, F.lit(fixed.SEMANTIC_MARKER)).otherwise(text)
