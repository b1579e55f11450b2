"""Generation: evolving instructions and answering them through a pluggable model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..operators.records import keep_columns, rename_outputs


class Model(Protocol):
    """A language model as the pipeline sees it; instances are sent to the executors."""

    def evolve(self, instructions: list[str]) -> list[str]:
        """A harder or more specific version of each instruction."""

    def answer(self, instructions: list[str]) -> list[str | None]:
        """An answer to each instruction."""


class StubModel:
    """A deterministic stand-in for tests: its texts follow from the instruction alone."""

    def evolve(self, instructions: list[str]) -> list[str]:
        return [f"{i} Explain why." for i in instructions]

    def answer(self, instructions: list[str]) -> list[str | None]:
        digest = lambda i: hashlib.sha256(i.encode()).hexdigest()
        return [f"Answer {digest(i)} to: {i[:200]}" for i in instructions]


class EndpointModel:
    """Any backend behind one function from prompts to completions, such as a local server or a remote service."""

    TEMPLATE = "Rewrite the following instruction so that it is more demanding:\n\n{}"

    def __init__(self, complete: Callable[[list[str]], list[str | None]]) -> None:
        self.complete = complete

    def evolve(self, instructions: list[str]) -> list[str]:
        got = self.complete([self.TEMPLATE.format(i) for i in instructions])
        return [new or old for new, old in zip(got, instructions)]

    def answer(self, instructions: list[str]) -> list[str | None]:
        return self.complete(instructions)


def generate(rows: DataFrame, model: Model, evolutions: int, batch_size: int = 64) -> DataFrame:
    """The rows with ``evolved_instruction`` after ``evolutions`` rounds and the ``generation`` that answers it.

    Rows need ``instruction`` and go to the model in batches of ``batch_size``; other columns are carried along.
    """
    schema = StructType(list(rows.schema.fields))
    at = schema.names.index("instruction")
    names = [*schema.names, "evolved_instruction", "generation"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                evolved = part.column(at).to_pylist()
                for _ in range(evolutions):
                    evolved = model.evolve(evolved)
                new = [pa.array(evolved, pa.string()), pa.array(model.answer(evolved), pa.string())]
                yield pa.record_batch([*part.columns, *new], names)

    for name in ("evolved_instruction", "generation"):
        schema = schema.add(name, "string")
    return rows.mapInArrow(run, schema)


def distil(rows: DataFrame, model: Model, evolutions: int, batch_size: int = 64, min_length: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(instruction, output)`` with the ``keep`` columns: generated, long enough, under the original instruction."""
    made = generate(rows, model, evolutions, batch_size)
    return keep_columns(rename_outputs(made, min_length), [*keep, "instruction", "output"])
