"""Redaction and masking of personal data by a fixed sequence of patterns, in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contract import MASK_CARD, MASK_PHONE, MASK_SSN
from ..contract import PII_CANDIDATE as CANDIDATE
from ..contract import PII_PATTERNS as PATTERNS
from .text import bound


def replace_each(text: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """``text`` with every match of ``pattern`` replaced by a function of the match."""

    def replaced(t: Column) -> Column:
        between = F.split(t, pattern, -1)
        instead = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), new)
        joined = F.array_join(F.zip_with(between, instead, lambda b, i: F.concat(b, F.coalesce(i, F.lit("")))), "")
        return F.when(t.rlike(pattern), joined).otherwise(t)

    return bound(text, replaced)


def _last_four(match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    return F.when(F.length(digits) >= 4, F.right(digits, F.lit(4))).otherwise(F.lit("****"))


def _mask_email(match: Column) -> Column:
    local = F.substring_index(match, "@", 1)
    domain = F.substring(match, F.length(local) + 2, F.length(match))
    ends = F.concat(F.left(local, F.lit(1)), F.lit("***"), F.right(local, F.lit(1)))
    return F.concat(F.when(F.length(local) <= 1, F.lit("***")).otherwise(ends), F.lit("@"), domain)


#: By kind, the partial mask of a match; kinds without one are always replaced whole.
MASKS: dict[str, Callable[[Column], Column]] = {
    "email": _mask_email,
    "phone": lambda m: F.concat(F.lit(MASK_PHONE), _last_four(m)),
    "card": lambda m: F.concat(F.lit(MASK_CARD), _last_four(m)),
    "ip": lambda m: F.concat(F.substring_index(m, ".", 2), F.lit(".***.***")),
    "ssn": lambda m: F.concat(F.lit(MASK_SSN), _last_four(m)),
}


def _stages(text: Column, mask: bool) -> Column:
    for kind, name, pattern in PATTERNS:
        if mask and kind in MASKS:
            text = replace_each(text, pattern, MASKS[kind])
        else:
            text = F.regexp_replace(text, pattern, f"[PII_{name}]")
    return text


def redact_pii(text: Column, mask: bool = False) -> Column:
    """The text with personal data replaced by its class, or partly masked."""
    return F.when(text.rlike(CANDIDATE), _stages(text, mask)).otherwise(text)


def has_pii(text: Column) -> Column:
    """Whether any pattern matches the text at its place in the sequence.

    No match equals what replaces it, so that is whether redaction changes the text.
    """
    return F.coalesce(redact_pii(text) != text, F.lit(False))
