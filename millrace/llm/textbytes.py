"""Words and hashes of many texts at once, as numpy operations on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


#: A word: letters with their marks. The masks below ask the same library, so both always agree.
WORD = regex.compile(r"[\p{L}\p{M}]+")
_LETTER, _NUMBER = regex.compile(r"[\p{L}\p{M}]"), regex.compile(r"\p{N}")
#: By code point: 0 not looked up yet, 1 neither, 2 letter or mark, 3 number. Filled as characters are met.
_KIND = np.zeros(0x110000, np.uint8)


def _ascii(letter: int, number: int) -> np.ndarray:
    lut = np.ones(256, np.uint8)
    lut[ord("a") : ord("z") + 1] = lut[ord("A") : ord("Z") + 1] = letter
    lut[ord("0") : ord("9") + 1] = number
    return lut


_ASCII = _ascii(2, 3)


def kinds(raw: np.ndarray) -> np.ndarray:
    """2 for each byte of a letter or mark of any script, 3 for one of a number, 1 for all else (broken UTF-8 too)."""
    out = _ASCII[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if not len(lead):
        return out
    first = raw[lead].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = first & np.array([0x1F, 0x0F, 0x07])[size - 2]
    sound = lead + size <= len(raw)
    for k in (1, 2, 3):
        more = k < size
        byte = raw[np.minimum(lead + k, len(raw) - 1)].astype(np.int64)
        sound &= ~more | (byte & 0xC0 == 0x80)
        point = np.where(more, (point << 6) | (byte & 0x3F), point)
    sound &= point < len(_KIND)
    lead, size, point = lead[sound], size[sound], point[sound]
    for c in np.unique(point[_KIND[point] == 0]).tolist():
        _KIND[c] = 2 if _LETTER.match(chr(c)) else 3 if _NUMBER.match(chr(c)) else 1
    kind = _KIND[point]
    for k in range(4):
        inside = size > k
        out[lead[inside] + k] = kind[inside]
    return out


def letters(raw: np.ndarray) -> np.ndarray:
    """True for every byte of a letter or mark of any script."""
    return kinds(raw) == 2


def alnum(raw: np.ndarray) -> np.ndarray:
    """True for every byte of a letter, mark or number of any script."""
    return kinds(raw) > 1


def slices(batches, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in cuts of about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, one after another, and the ``n + 1`` places where they meet. Null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each longest run of True that stays within one text."""
    n = len(mask)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = mask.copy()
    starts[1:] &= ~mask[:-1] | edge[1:n]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:] | edge[1:n]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(at, first, "right") - 1


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The base of the polynomial hash raised to 0 ... n - 1, modulo 2**64."""
    out = np.full(n, _P, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Spans:
    """Polynomial hashes of spans of some bytes: that of ``xy`` is ``code(x) + powers[len(x)] * code(y)``."""

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        if n:
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(n), dtype=np.uint64, out=self.sums[1:])
        self.back = np.full(n + 1, _INVERSE, np.uint64)
        self.back[0] = 1
        self.back = np.cumprod(self.back, dtype=np.uint64)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.back[starts]


def span_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial hash of each span."""
    return Spans(raw)(starts, ends)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal spans wherever they lie."""
    return mix64(span_codes(raw, starts, ends))


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted ``table``, -1 where it is not there."""
    if not len(table):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def hash_of(text: str) -> np.uint64:
    """``span_hashes`` of one string."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]
