"""Conversion of records to the common instruction and chat formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import REQUIRED, ROLES, SYSTEM


def _message(role: str, content: Column, names: tuple[str, str] = ("role", "content")) -> Column:
    return F.struct(F.lit(role).alias(names[0]), content.alias(names[1]))


def _with_input(lead: str) -> Column:
    given = F.coalesce(F.col("input"), F.lit("")) != ""
    return F.when(given, F.concat("instruction", F.lit(lead), "input")).otherwise(F.col("instruction"))


def alpaca() -> list[Column]:
    return [F.col("instruction"), F.col("input"), F.col("output")]


def sharegpt() -> list[Column]:
    names = ("from", "value")
    turns = F.array(_message("human", _with_input("\n\nContext: "), names), _message("gpt", F.col("output"), names))
    return [turns.alias("conversations")]


def chatml() -> list[Column]:
    return [F.array(_message("user", _with_input("\n\n")), _message("assistant", F.col("output"))).alias("messages")]


def openai() -> list[Column]:
    turns = [("system", F.lit(SYSTEM)), ("user", _with_input("\n\n")), ("assistant", F.col("output"))]
    return [F.array(*[_message(role, content) for role, content in turns]).alias("messages")]


FORMATS: dict[str, Callable[[], list[Column]]] = {"alpaca": alpaca, "sharegpt": sharegpt, "chatml": chatml, "openai": openai}


def check_format(name: str) -> None:
    """A name that is no format's is a ValueError."""
    if name not in FORMATS:
        raise ValueError(f"unknown format {name!r}; known are {sorted(FORMATS)}")


def convert(records: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """Records ``(instruction, input, output)`` in the named format, with the ``keep`` columns in front."""
    check_format(name)
    return records.select(*(keep or []), *FORMATS[name]())


def preview_role(role: Column) -> Column:
    """The role under which a preview shows a turn; unknown ones are the user's."""
    pairs = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.lower(role)), F.lit("user"))


def preview(rows: DataFrame, n: int = 5, order: str = "rec_id") -> DataFrame:
    """The first ``n`` rows in any of the formats as turns ``(role, content)``."""
    columns = rows.columns
    if "conversations" in columns:
        turns = F.transform(
            "conversations", lambda t: F.struct(preview_role(t["from"]).alias("role"), t["value"].alias("content"))
        )
    elif "messages" in columns:
        turns = F.transform(
            "messages",
            lambda t: F.struct(
                F.when(t["role"].isin("user", "assistant", "system"), t["role"]).otherwise("user").alias("role"),
                t["content"].alias("content"),
            ),
        )
    else:
        turns = F.array(_message("user", F.col("instruction")), _message("assistant", F.coalesce("output", F.lit(""))))
    return rows.orderBy(order).limit(n).select(order, turns.alias("turns"))
