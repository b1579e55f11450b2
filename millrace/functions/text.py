"""Text and hash functions on columns, in built-in expressions, and ICU's for Unicode normalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word as Unicode sees it; unlike ``\\w`` it means the same to every regular-expression engine in use here.
WORD = r"[\p{L}\p{N}_]+"
_SPACES = r"[\s\p{Z}]+"
#: Control characters become spaces before runs of these become one, so both go in one pass.
_BLANKS = r"[\s\p{Z}\x00-\x1F\x7F-\x9F]+"


def nfkc(text: Column) -> Column:
    """NFKC form, by the ICU library that Spark brings along: in the JVM, and no text is gathered for it."""
    # Spark takes the call for one whose results differ, so that it is never repeated for the columns made from it.
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.isNotNull(), composed)


def strip_html(text: Column) -> Column:
    """Every tag becomes one space; entities and the content of scripts and styles stay."""
    return F.regexp_replace(text, r"<[^>]+>", " ")


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def clean_text(text: Column, html: bool = True, normalise: bool = True) -> Column:
    """NFKC, then tags, control characters and white space to single spaces."""
    text = nfkc(text) if normalise else text
    text = strip_html(text) if html else text
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


def words(text: Column) -> Column:
    """Array of the words, as written."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case with single spaces, as compared by the record hash."""
    return collapse(F.lower(text))


def record_hash(fields: dict[str, Column], normalise: bool = True) -> Column:
    """SHA-256 of a record as compact JSON with sorted keys, its strings folded unless ``normalise`` is off.

    Null fields are written as ``null``, as distinct from absent ones.
    """
    parts = []
    for name in sorted(fields):
        value = fold(fields[name]) if normalise else fields[name]
        # The string as JSON, without the object {"v": ... } around it.
        bare = bound(F.to_json(F.struct(value.alias("v"))), lambda j: F.substring(j, F.lit(6), F.length(j) - 6))
        shown = F.when(value.isNull(), F.lit("null")).otherwise(bare)
        parts.append(F.concat(F.to_json(F.array(F.lit(name))).substr(2, len(name) + 2), F.lit(":"), shown))
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def content_hash(instruction: Column, output: Column) -> Column:
    """SHA-256 of both texts, as they are, joined by three bars; a null is no text and differs from every one."""
    one = lambda text: F.coalesce(F.sha2(text, 256), F.lit("null"))
    with_null = F.sha2(F.concat_ws("|||", one(instruction), one(output)), 256)
    return F.coalesce(F.sha2(F.concat(instruction, F.lit("|||"), output), 256), with_null)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the lower-case trimmed text; a shorter text is its own only one."""

    def grams(t: Column) -> Column:
        def windows(chars: Column) -> Column:
            starts = F.sequence(F.lit(1), F.size(chars) - n + 1)
            return F.array_distinct(F.transform(starts, lambda i: F.concat(*[F.element_at(chars, i + k) for k in range(n)])))

        chars = F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))
        return F.when(F.length(t) < n, F.array(t)).otherwise(bound(chars, windows))

    return bound(F.lower(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), grams)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 0 where one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def quality_text(fields: list[Column], budget: int | None = None) -> Column:
    """The string fields joined by spaces; with a ``budget``, cut where their characters together exceed it."""
    if budget is None:
        return F.concat_ws(" ", *fields)
    parts, used = [], F.lit(0)
    for field in fields:
        left = F.greatest(F.lit(budget) - used, F.lit(0))
        parts.append(F.when(field.isNotNull() & (left > 0), F.substring(field, F.lit(1), left)))
        used = used + F.least(F.coalesce(F.length(field), F.lit(0)), left)
    return F.concat_ws(" ", *parts)


def sft_text(instruction: Column, input_: Column, output: Column, eos: str = "</s>") -> Column:
    """One training text of a record, in headed sections; the input section only where it is not blank."""

    def section(name: str, body: Column) -> Column:
        return F.concat(F.lit(f"### {name}:\n"), body)

    blank = F.coalesce(F.trim(F.regexp_replace(input_, _SPACES, " ")), F.lit("")) == ""
    return F.concat_ws(
        "\n\n",
        section("Instruction", instruction),
        F.when(~blank, section("Input", input_)),
        F.concat(section("Response", output), F.lit(eos)),
    )
