"""Chunking of documents: by characters, and by paragraphs and sentences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import CHUNK_SIZE, OVERLAP

#: White space after a sentence's end and before a capital letter (Latin, with its supplements and extensions).
SENTENCE = r"(?<=[.!?])\s+(?=[A-Z\x{C0}-\x{24F}])"
PARAGRAPH = r"\n\s*\n"
_STRIP = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def check_parameters(chunk_size: int, overlap: int) -> None:
    """Reject sizes that cannot make progress."""
    if chunk_size <= 0 or overlap < 0:
        raise ValueError(f"chunk_size must be positive and overlap not negative: {chunk_size}, {overlap}")
    if not overlap < chunk_size:
        raise ValueError(f"an overlap of {overlap} leaves nothing of chunks of {chunk_size}")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, _STRIP, "")


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that occurs, finer ones inside long pieces.

    Separators stay at the start of the piece that follows them. Short pieces are gathered; when the next one would not
    fit, a chunk is closed and pieces are kept from its end for as long as they make no more than ``overlap``.
    """
    separator, finer = separators[-1], ()
    for i, s in enumerate(separators):
        if s == "" or s in text:
            separator, finer = s, separators[i + 1 :]
            break
    if separator:
        parts = text.split(separator)
        pieces = [p for p in [parts[0], *(separator + p for p in parts[1:])] if p]
    else:
        pieces = list(text)
    chunks: list[str] = []
    held: list[str] = []

    def gather() -> None:
        window: list[str] = []
        total = 0
        for piece in held:
            if total + len(piece) > size and window:
                chunks.append("".join(window).strip())
                while total > overlap or (total + len(piece) > size and total > 0):
                    total -= len(window.pop(0))
            window.append(piece)
            total += len(piece)
        if window:
            chunks.append("".join(window).strip())
        held.clear()

    for piece in pieces:
        if len(piece) < size:
            held.append(piece)
            continue
        gather()
        if finer:
            chunks.extend(split_recursively(piece, size, overlap, finer))
        else:
            chunks.append(piece.strip())
    gather()
    return [c for c in chunks if c]


def character_chunks(text: Column, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """Array of character chunks; null for null and blank texts."""
    check_parameters(chunk_size, overlap)

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None or not t.strip() else split_recursively(t, chunk_size, overlap))

    return split(text)


def paragraphs(text: Column) -> Column:
    """Array of the stripped paragraphs that are not blank."""
    return F.filter(F.transform(F.split(text, PARAGRAPH), _strip), lambda p: p != "")


def fragments(text: Column, chunk_size: int = CHUNK_SIZE) -> Column:
    """Array of the paragraphs, longer ones cut into sentences."""

    def cut(p: Column) -> Column:
        sentences = F.filter(F.transform(F.split(p, SENTENCE), _strip), lambda s: s != "")
        return F.when(F.length(p) <= chunk_size, F.array(p)).otherwise(sentences)

    return F.flatten(F.transform(paragraphs(text), cut))


def merged(pieces: Column, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """Neighbouring fragments joined by blank lines up to ``chunk_size``; single longer ones cut by characters."""

    def merge(fragments) -> list[str]:
        out: list[str] = []
        open_, length = [], 0
        for fragment in fragments:
            if open_ and length + 2 + len(fragment) <= chunk_size:
                open_.append(fragment)
                length += 2 + len(fragment)
                continue
            if open_:
                out.append("\n\n".join(open_))
            open_, length = [fragment], len(fragment)
            if length > chunk_size:
                out.extend(split_recursively(fragment, chunk_size, overlap))
                open_, length = [], 0
        if open_:
            out.append("\n\n".join(open_))
        return out

    @F.pandas_udf("array<string>")
    def apply(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else merge(x))

    return apply(pieces)


def overlapped(chunks: Column, overlap: int = OVERLAP) -> Column:
    """Every chunk but the first preceded by the end of the one before it and a space."""
    if overlap <= 0:
        return chunks
    shifted = F.concat(F.array(F.lit(None).cast("string")), F.slice(chunks, F.lit(1), F.greatest(F.size(chunks) - 1, F.lit(0))))
    tail = lambda p: F.concat(F.right(p, F.lit(overlap)), F.lit(" "))
    # The shifted array of an empty one is longer than it; its only pair has no chunk and goes.
    joined = F.zip_with(chunks, shifted, lambda c, p: F.when(p.isNull(), c).otherwise(F.concat(tail(p), c)))
    return F.filter(joined, lambda c: c.isNotNull())


def semantic_chunks(
    text: Column, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP, respect_paragraphs: bool = True
) -> Column:
    """Array of chunks that follow paragraphs and sentences; null for null and blank texts."""
    check_parameters(chunk_size, overlap)
    if not respect_paragraphs:
        return character_chunks(text, chunk_size, overlap)
    chunks = overlapped(merged(fragments(text, chunk_size), chunk_size, overlap), overlap)
    return F.when(_strip(text) != "", F.filter(chunks, lambda c: _strip(c) != ""))


def chunk_documents(
    docs: DataFrame,
    semantic: bool = False,
    chunk_size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, chunk_no, chunk)`` of all documents; null and blank texts give no rows."""
    make = semantic_chunks if semantic else character_chunks
    chunks = make(F.col(text_col), chunk_size, overlap)
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(chunks).alias("chunk_no", "chunk"))
