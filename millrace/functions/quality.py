"""Quality gates on a text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, words


@dataclass(frozen=True)
class Gates:
    """Limits of the gates. They are tried in the order empty, short, long, words, unique words, ASCII."""

    min_chars: int = 50
    max_chars: int = 20_000
    min_words: int = 8
    min_unique_ratio: float = 0.25
    min_ascii_ratio: float = 0.85


def reason(text: Column, gates: Gates = Gates()) -> Column:
    """Name of the first gate that the text fails; null where it passes all."""
    length = F.length(text)
    ascii_only = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / length

    def by_words(every: Column) -> Column:
        unique = F.size(F.array_distinct(every)) / F.size(every)
        return (
            F.when(F.size(every) < gates.min_words, "too few words")
            .when((F.size(every) > 0) & (unique < gates.min_unique_ratio), "low unique-word ratio")
            .when(ascii_only < gates.min_ascii_ratio, "low ASCII ratio")
        )

    return (
        F.when(text.isNull() | (text == ""), "empty text")
        .when(length < gates.min_chars, "too short")
        .when(length > gates.max_chars, "too long")
        .otherwise(bound(words(text), by_words))
    )


def message(text: Column, gates: Gates = Gates()) -> Column:
    """``reason`` with the figure and the limit."""
    every = words(text)
    length = F.length(text)
    unique = F.size(F.array_distinct(every)) / F.greatest(F.size(every), F.lit(1))
    ascii_only = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / F.greatest(length, F.lit(1))
    why = reason(text, gates)

    def figure(form: str, value: Column, limit) -> Column:
        return F.concat(why, F.format_string(form, value, F.lit(limit)))

    return (
        F.when(why == "too short", figure(" (%d < %s chars)", length, gates.min_chars))
        .when(why == "too long", figure(" (%d > %s chars)", length, gates.max_chars))
        .when(why == "too few words", figure(" (%d < %s)", F.size(every), gates.min_words))
        .when(why == "low unique-word ratio", figure(" (%.3f < %s)", unique, str(gates.min_unique_ratio)))
        .when(why == "low ASCII ratio", figure(" (%.3f < %s)", ascii_only, str(gates.min_ascii_ratio)))
        .otherwise(why)
    )
