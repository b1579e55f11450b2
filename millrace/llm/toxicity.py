"""Toxicity of text behind leetspeak, spacing and repetition: noisy-channel decoding, then a learned word score."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import integer_id, table
from .textbytes import Spans, as_bytes, hash_of, letters, member, mix64, runs, slices, span_codes, span_hashes

#: Bounds of the labelled sample from which word weights are learned: documents of each class, and characters of one.
DOCS_PER_CLASS = 3000
LONGEST_SAMPLE = 20_000
#: Share of the learned toxic words in the character model; the rest is the corpus.
LEXICON_SHARE = 0.3

LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou",
}
#: Log probability that a blank was put into a word.
SPLIT = -2.0
_SYMBOLS = 64


def _symbol_table() -> np.ndarray:
    """Byte to symbol: 0 white space and ends, letters, digits, signs that stand for letters, the rest by groups."""
    lut = np.full(256, 43, np.int64)
    lut[:33] = 0
    for i in range(26):
        lut[ord("a") + i] = lut[ord("A") + i] = 1 + i
    for i in range(10):
        lut[ord("0") + i] = 27 + i
    for i, c in enumerate("@$!|+*"):
        lut[ord(c)] = 37 + i
    for b in range(128, 256):
        lut[b] = 44 + b % 20
    return lut


_LUT = _symbol_table()
_CODE = _LUT.tolist()


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Symbol trigrams counted over every text of the table; the result has a fixed size."""

    def count(batches):
        total = np.zeros(_SYMBOLS**3, np.int64)
        for batch in slices(batches, "text"):
            raw, at = as_bytes(batch.column(0))
            # Two ends of text between any two texts, so that no trigram spans them.
            symbols = np.zeros(len(raw) + 2 * len(at), np.int64)
            symbols[np.arange(len(raw)) + 2 * np.repeat(np.arange(1, len(at)), np.diff(at))] = _LUT[raw]
            code = (symbols[:-2] * _SYMBOLS + symbols[1:-1]) * _SYMBOLS + symbols[2:]
            total += np.bincount(code, minlength=_SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["code", "n"])

    counted = docs.select(F.col(text_col).alias("text")).filter("text IS NOT NULL").mapInArrow(count, "code long, n long")
    rows = counted.groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_SYMBOLS**3, np.float64)
    for r in rows:
        out[r.code] = r.n
    return out.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)


def language_model(counts: np.ndarray, lexicon: dict[str, float] | None = None) -> np.ndarray:
    """Log probability of a symbol after two others: interpolated trigrams of the corpus, mixed with the lexicon's."""

    def interpolated(c: np.ndarray) -> np.ndarray:
        one = (c.sum(axis=(0, 1)) + 1) / (c.sum() + _SYMBOLS)
        pairs = c.sum(axis=0)
        two = (pairs + 20 * one) / (pairs.sum(axis=1, keepdims=True) + 20)
        return (c + 5 * two[None]) / (c.sum(axis=2, keepdims=True) + 5)

    p = interpolated(counts)
    if lexicon:
        c = np.zeros_like(counts)
        for word in lexicon:
            s = [0, 0, *_LUT[np.frombuffer(word.encode(), np.uint8)], 0]
            for a, b, x in zip(s, s[1:], s[2:]):
                c[a, b, x] += 1000.0
        p = (1 - LEXICON_SHARE) * p + LEXICON_SHARE * interpolated(c)
    return np.log(p)


def decode(token: str, lm: np.ndarray | list[float], spaced: bool = False) -> str:
    """The most probable original of a token (Viterbi over its lattice of readings).

    A sign of ``LEET`` reads as one of its letters or as itself; a run of equal signs as so many, or as one or two;
    letters that stood apart (``spaced``) may have had a word's end between them, and signs that are no digits may have
    been put between them. Each reading has a channel cost and the character model scores what was read. ``lm`` may be
    given as a flat list, which Python reads faster.
    """
    flat = lm if isinstance(lm, list) else lm.ravel().tolist()
    runs_of: list[tuple[str, int]] = []
    for c in token:
        if runs_of and runs_of[-1][0] == c:
            runs_of[-1] = (c, runs_of[-1][1] + 1)
        else:
            runs_of.append((c, 1))
    # By the last two symbols: the best score, and what was read as a chain of (before, piece).
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for at, (c, n) in enumerate(runs_of):
        readings = [(c, 0.0), *((x, -0.7 if c != "*" else -1.5) for x in LEET.get(c, ""))]
        pieces: list[tuple[str, float]] = []
        for x, cost in readings:
            pieces.append((x * n, n * cost))
            if n >= 2:
                pieces.append((x, cost - (0.5 if n > 2 else 2.0)))
            if n > 2:
                pieces.append((x * 2, 2 * cost - 0.7))
        if spaced and at:
            pieces += [(" " + piece, cost - 1.0) for piece, cost in pieces]
            if c in LEET and not c.isdigit():
                pieces.append(("", -2.0))
        coded = [(piece, cost, [_CODE[byte] for byte in piece.encode()]) for piece, cost in pieces]
        reached: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a0, b0), (before, chain) in best.items():
            for piece, cost, symbols in coded:
                score, a, b = before + cost, a0, b0
                for s in symbols:
                    score += flat[(a * _SYMBOLS + b) * _SYMBOLS + s]
                    a, b = b, s
                have = reached.get((a, b))
                if have is None or score > have[0]:
                    reached[a, b] = (score, (chain, piece))
        best = reached
    chain = max(((score + flat[(a * _SYMBOLS + b) * _SYMBOLS], chain) for (a, b), (score, chain) in best.items()), key=lambda x: x[0])[1]
    out = []
    while chain:
        chain, piece = chain
        out.append(piece)
    return "".join(reversed(out))


def squeeze(word: str) -> str:
    """The word with runs of a letter shortened to one."""
    return "".join(c for i, c in enumerate(word) if i == 0 or word[i - 1] != c)


#: Lengths in bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8, 9)


def word_features(codes: Spans, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places of words, hashes): each whole word, and each beginning of a longer word."""
    size = ends - starts
    out = [(np.arange(len(starts)), mix64(codes(starts, ends)))]
    for k in BEGINNINGS:
        longer = np.flatnonzero(size > k)
        out.append((longer, mix64(codes(starts[longer], starts[longer] + k) ^ np.uint64(k))))
    return out


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places of words, hashes): all features of some words."""
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    size = np.array([len(w.encode()) for w in words], np.int64)
    ends = np.cumsum(size)
    place, hashes = zip(*word_features(Spans(raw), ends - size, ends))
    return np.concatenate(place), np.concatenate(hashes)


@dataclass
class Channel:
    """The decoder and the score: character model, weights by feature hash (sorted), toxic words to match whole."""

    lm: np.ndarray
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lexicon: list[str] = field(default_factory=list)
    bias: float = -30.0
    threshold: float = 0.5

    def __post_init__(self) -> None:
        self.words = np.sort(np.array([hash_of(w) for w in self.lexicon], np.uint64))
        self.squeezed = np.unique(np.array([hash_of(squeeze(w)) for w in self.lexicon], np.uint64))
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        self.near_words = np.zeros(1 << 16, bool)
        self.near_words[(self.words >> np.uint64(48)).astype(np.int64)] = True
        self.cache: dict[tuple[str, bool], str] = {}
        self.flat: list[float] = []

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` of known features, and which features they are."""
        maybe = np.flatnonzero(self.near[(hashes >> np.uint64(48)).astype(np.int64)])
        which = member(hashes[maybe], self.hashes)
        return maybe[which >= 0], which[which >= 0]

    def is_word(self, hashes: np.ndarray) -> np.ndarray:
        """Places in ``hashes`` of toxic words."""
        maybe = np.flatnonzero(self.near_words[(hashes >> np.uint64(48)).astype(np.int64)])
        return maybe[member(hashes[maybe], self.words) >= 0]

    def spell(self, text: str) -> float:
        """Log probability of a text between blanks under the character model."""
        s = [0, 0, *(_CODE[byte] for byte in text.encode()), 0]
        return float(sum(self.lm[a, b, c] for a, b, c in zip(s, s[1:], s[2:])))

    def closes(self, parts: list[str]) -> bool:
        """Whether parts between blanks are more probably one word that was split, at ``SPLIT`` a gap, than words."""
        return self.spell("".join(parts)) + SPLIT * (len(parts) - 1) > self.spell(" ".join(parts))

    def read(self, token: str, spaced: bool = False) -> str:
        self.flat = self.flat or self.lm.ravel().tolist()
        if len(token) > 64:
            return decode(token, self.flat, spaced)
        got = self.cache.get((token, spaced))
        if got is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            got = self.cache[token, spaced] = decode(token, self.flat, spaced)
        return got


@dataclass
class Read:
    """A batch as written (words of each text) and what was restored: (text number, seen, read)."""

    doc: np.ndarray
    features: list[tuple[np.ndarray, np.ndarray]]
    found: list[tuple[int, str, str]]


def restore(channel: Channel, texts: pa.Array) -> Read:
    """The words of the texts and the readings of their ambiguous tokens.

    Tokens without an ambiguous sign have a lattice of one path and are not decoded. Decoded are tokens of letters and
    signs of ``LEET`` wherever the signs stand (the lattice may keep them as written), letters repeated three times,
    words that are a toxic word once their doubled letters are single, three or more single characters with anything
    but letters and digits between them, and what white space bounds when it has such a token among parts. Any number
    of parts of any length that make a toxic word are joined across gaps of any length; where the gaps are white space
    alone and no part is a single letter, only if the character model finds the whole word more probable
    (``Channel.closes``). Letters are counted as characters, whatever their bytes.
    """
    raw, at = as_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    n = len(raw)
    found: list[tuple[int, str, str]] = []
    if not n:
        return Read(np.zeros(0, np.int64), [], found)
    letter = letters(raw)
    starts, ends, doc = runs(letter, at)
    codes = Spans(raw)
    features = word_features(codes, starts, ends)

    def cut(s: int, e: int) -> str:
        return raw[s:e].tobytes().decode(errors="replace")

    def read(d: int, token: str, spaced: bool = False) -> None:
        got = channel.read(token, spaced)
        if got != token or spaced:
            found.append((int(d), token, got))

    leet = np.zeros(256, bool)
    leet[[ord(c) for c in LEET]] = True
    sign = leet[raw]
    # Characters: their first bytes, and the bytes of each as one number.
    head = (raw & 0xC0) != 0x80
    head[at[:-1][at[:-1] < n]] = True
    place = np.flatnonzero(head)
    width = np.diff(np.append(place, n))
    char = raw[place].astype(np.int64)
    for j in (1, 2, 3):
        more = np.flatnonzero(width > j)
        char[more] |= raw[place[more] + j].astype(np.int64) << 8 * j
    again = np.zeros(len(place), bool)
    again[1:] = (char[1:] == char[:-1]) & letter[place[1:]]
    again[np.searchsorted(place, at[:-1][at[:-1] < n])] = False
    same = np.repeat(again, width)
    flag = np.zeros(n, bool)
    flag[place[1:]] = again[1:] & again[:-1]
    chars = np.concatenate([[0], np.cumsum(head)])
    s2, e2, d2 = runs(letter | sign, at)
    flags = np.concatenate([[0], np.cumsum(flag)])
    signs = np.concatenate([[0], np.cumsum(sign)])
    n_signs = signs[e2] - signs[s2]
    odd = (flags[e2] > flags[s2]) | ((n_signs > 0) & (n_signs < e2 - s2))
    for s, e, d in zip(s2[odd].tolist(), e2[odd].tolist(), d2[odd].tolist()):
        read(d, cut(s, e))

    if len(channel.squeezed) and len(starts):
        kept = letter & ~same
        upto = np.concatenate([[0], np.cumsum(kept)])
        doubled = np.flatnonzero((upto[ends] - upto[starts] < ends - starts) & (flags[ends] == flags[starts]))
        single = mix64(span_codes(raw[kept], upto[starts[doubled]], upto[ends[doubled]]))
        close = doubled[member(single, channel.squeezed) >= 0]
        for i in close[member(mix64(codes(starts[close], ends[close])), channel.words) < 0].tolist():
            read(doc[i], cut(starts[i], ends[i]))

    # What white space bounds, without the marks between its parts, if one of these is to be decoded.
    s3, e3, d3 = runs(raw > 32, at)
    odd_before = np.concatenate([[0], np.cumsum(odd)])
    first, last = np.searchsorted(s2, s3), np.searchsorted(s2, e3)
    parted = (last - first > 1) & (odd_before[last] > odd_before[first])
    for s, e, d in zip(s3[parted].tolist(), e3[parted].tolist(), d3[parted].tolist()):
        read(d, raw[s:e][(letter | sign)[s:e]].tobytes().decode(errors="replace"))
    # Letters with the same sign put between each two.
    for s, e, d in zip(s2[odd].tolist(), e2[odd].tolist(), d2[odd].tolist()):
        if chars[e] - chars[s] >= 5 and sign[s:e].sum() > 1:
            token = cut(s, e)
            if token[1] in LEET and len(set(token[1::2])) == 1:
                read(d, token[::2])

    one = chars[e2] - chars[s2] == 1
    if one.any():
        joined = np.zeros(len(one), bool)
        joined[1:] = one[1:] & one[:-1] & (d2[1:] == d2[:-1])
        heads, chain = np.flatnonzero(one & ~joined), np.flatnonzero(one)
        size = np.diff(np.append(np.searchsorted(chain, heads), len(chain)))
        for h, k in zip(heads[size >= 3].tolist(), size[size >= 3].tolist()):
            if letter[s2[h : h + k]].sum() * 2 > k:
                s, e = s2[h], e2[h + k - 1]
                read(d2[h], raw[s:e][(letter | sign)[s:e]].tobytes().decode(errors="replace"), True)

    if len(channel.words) and len(starts) > 1:
        longest = max(len(w.encode()) for w in channel.lexicon)
        only = Spans(raw[letter])
        upto = np.concatenate([[0], np.cumsum(letter)])
        blanks = np.concatenate([[0], np.cumsum(raw <= 32)])
        single = chars[ends] - chars[starts] == 1
        # By the words before: gaps with a sign in them or a single letter at one side.
        plain = blanks[starts[1:]] - blanks[ends[:-1]] < starts[1:] - ends[:-1]
        plain = np.concatenate([[0], np.cumsum(~(plain | single[1:] | single[:-1]))])
        gap = doc[1:] == doc[:-1]
        first, parts = np.flatnonzero(gap), 2
        while len(first):
            last = first + parts - 1
            first = first[upto[ends[last]] - upto[starts[first]] <= longest]
            code = mix64(only(upto[starts[first]], upto[ends[first + parts - 1]]))
            for i in first[channel.is_word(code)].tolist():
                j = i + parts - 1
                if plain[j] - plain[i] == parts - 1 and not channel.closes([cut(starts[k], ends[k]) for k in range(i, j + 1)]):
                    continue
                whole = raw[starts[i] : ends[j]]
                read_as = whole[letter[starts[i] : ends[j]]].tobytes().decode(errors="replace")
                found.append((int(doc[i]), cut(starts[i], ends[j]), read_as))
            first = first[first + parts < len(starts)]
            first = first[gap[first + parts - 1]]
            parts += 1
    return Read(doc, features, found)


def text_features(channel: Channel, texts: pa.Array, known: bool = True) -> tuple[np.ndarray, np.ndarray, Read]:
    """(text numbers, features) of the restored texts, each pair once: known features by place, or all by hash."""
    got = restore(channel, texts)
    docs, keys = [], []

    def add(doc: np.ndarray, hashes: np.ndarray) -> None:
        if known:
            at, which = channel.find(hashes)
            docs.append(doc[at])
            keys.append(which)
        else:
            docs.append(doc)
            keys.append(hashes)

    for place, hashes in got.features:
        add(got.doc[place], hashes)
    # The words of all readings at once, as a batch has thousands of readings of a word or two.
    owned = [(d, w) for d, _, read in got.found for w in _words(read)]
    if owned:
        place, hashes = features_of([w for _, w in owned])
        add(np.array([d for d, _ in owned])[place], hashes)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), got
    doc, key = np.concatenate(docs), np.concatenate(keys)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return doc[new], key[new], got


def score(channel: Channel, texts: pa.Array) -> tuple[np.ndarray, Read]:
    """Probability of toxicity of each text, from the distinct known features of its restored form."""
    doc, which, got = text_features(channel, texts)
    total = np.bincount(doc, channel.values[which] if len(doc) else None, len(texts))
    return 1 / (1 + np.exp(-np.clip(total + channel.bias, -30, 30))), got


def regress(x: np.ndarray, y: np.ndarray, l1: float = 0.0005, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty and classes of equal weight, by accelerated proximal gradient."""
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    w, b, v, c, t = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 1.0
    probe, largest = np.ones(x.shape[1], np.float32), 0.0
    for _ in range(20):
        probe = x.T @ (balance * (x @ probe))
        largest = float(np.linalg.norm(probe))
        probe /= max(largest, 1e-12)
    rate = 4.0 / (1.1 * largest + 1.0)
    for _ in range(steps):
        g = balance * (1 / (1 + np.exp(-np.clip(x @ v.astype(np.float32) + c, -30, 30))) - y).astype(np.float32)
        new = v - rate * (x.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        d = c - rate * float(g.sum())
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), d + (t - 1) / t2 * (d - b)
        w, b, t = new, d, t2
    return w, b


def fit(sample: list[tuple[str, int]], counts: np.ndarray, features: int = 1000, least: int = 4) -> Channel:
    """Weights of words and word beginnings by logistic regression, from labelled texts.

    Texts are restored with the corpus model first. Candidates are the ``features`` of highest G-squared among those in
    at least ``least`` texts. The threshold divides a held-out third with the highest F1. With one class only, or no
    sample, there are no weights and every text scores about 0.
    """
    channel = Channel(language_model(counts))
    y = np.array([t for _, t in sample], float)
    if len(set(y.tolist())) < 2:
        return channel
    texts = pa.array([t for t, _ in sample], pa.string())

    def parts():
        """(first text, features) of a few texts at a time: the driver's memory is small."""
        for start in range(0, len(sample), 64):
            yield start, text_features(channel, texts.slice(start, 64), known=False)

    # Most features are rare: a first pass counts them by slot, a second keeps those whose slot is not.
    slots = np.zeros(1 << 22, np.int32)
    for _, (_, k, _) in parts():
        np.add.at(slots, (k >> np.uint64(42)).astype(np.int64), 1)
    doc, key = [], []
    for start, (d, k, _) in parts():
        often = slots[(k >> np.uint64(42)).astype(np.int64)] >= least
        doc.append(d[often] + start)
        key.append(k[often])
    doc, key = np.concatenate(doc), np.concatenate(key)
    hashes, inverse = np.unique(key, return_inverse=True)
    a = np.bincount(inverse, y[doc], len(hashes))
    b = np.bincount(inverse, 1 - y[doc], len(hashes))
    n1, n0 = y.sum(), len(y) - y.sum()
    g2 = np.zeros(len(hashes))
    for seen, n in ((a, n1), (b, n0)):
        expected = (a + b) * n / (n1 + n0)
        for o, e in ((seen, expected), (n - seen, n - expected)):
            g2 += 2 * o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9))
    g2[a + b < least] = -1
    chosen = np.sort(np.lexsort((hashes, -g2))[:features])
    chosen = chosen[g2[chosen] >= 0]
    column = np.full(len(hashes), -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(y), len(chosen)), np.float32)
    use = column[inverse] >= 0
    x[doc[use], column[inverse[use]]] = 1
    held = np.arange(len(y)) % 3 == 2
    w, bias = regress(x[~held], y[~held])
    p = 1 / (1 + np.exp(-np.clip(x[held] @ w + bias, -30, 30)))
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[held][order])
    f1 = 2 * right / (np.arange(1, len(order) + 1) + max(1.0, y[held].sum()))
    k = int(np.argmax(np.where(np.append(np.diff(p[order]) != 0, True), f1, 0)))
    below = p[order][k + 1] if k + 1 < len(order) else 0.0
    w, bias = regress(x, y)
    heavy = hashes[chosen][w > 0.25]
    spelled: set[str] = set()
    for start, (_, _, got) in parts():
        low = pc.utf8_lower(texts.slice(start, 64)).to_pylist() + [read for _, _, read in got.found]
        words = list({w for t in low for w in _words(t)})
        if words:
            raw = np.frombuffer("".join(words).encode(), np.uint8)
            size = np.array([len(w.encode()) for w in words])
            hit = member(span_hashes(raw, np.cumsum(size) - size, np.cumsum(size)), heavy) >= 0
            spelled.update(w for w, h in zip(words, hit) if h)
    lexicon = sorted(spelled)
    some = w != 0
    return Channel(
        language_model(counts, dict.fromkeys(lexicon, 1.0)),
        hashes[chosen][some],
        w[some],
        lexicon,
        float(bias),
        float((p[order][k] + below) / 2),
    )


def _words(text: str) -> list[str]:
    return "".join(c if c.isalpha() else " " for c in text).split()


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """(text, toxic) of at most ``DOCS_PER_CLASS`` documents of each class, drawn by a hash of the id.

    Texts of more than ``LONGEST_SAMPLE`` characters are not drawn, so that the sample is bounded in bytes too.
    """
    draw = Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id")
    marks = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.filter("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    drawn = marks.withColumn("n", F.row_number().over(draw)).filter(F.col("n") <= DOCS_PER_CLASS).select("id", "toxic")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.filter(F.length("text") <= LONGEST_SAMPLE)
    rows = texts.join(F.broadcast(drawn), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).collect()
    return [(r.text, r.toxic) for r in sorted(rows, key=lambda r: r.id)]


_OUT = "doc_id long, score double, toxic boolean, restored array<struct<seen:string,read:string>>"


def toxicity(docs: DataFrame, channel: Channel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, toxic, restored)`` of every document.

    ``restored`` lists the tokens whose most probable reading differs from what is written and holds a toxic word.
    Defined cases: null and empty texts score as texts without any known word, like clean ones; a text of any length
    is read whole; a null id stays null and an id that is no integer is a ValueError; of equally probable readings the
    first counts, what is written before others; a score at the threshold is toxic; repeated rows give repeated rows;
    an empty table gives no rows; other columns are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(channel)

    def judge(batches):
        own = shared.value
        lexicon = set(own.lexicon)
        for batch in slices(batches, "text"):
            p, got = score(own, batch.column(1))
            lists: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for d, seen, read in got.found:
                if any(w in lexicon for w in read.split()):
                    lists[d].append({"seen": seen, "read": read})
            kind = pa.list_(pa.struct([("seen", pa.string()), ("read", pa.string())]))
            yield pa.record_batch(
                [batch.column(0), pa.array(p), pa.array(p >= own.threshold), pa.array(lists, kind)],
                ["doc_id", "score", "toxic", "restored"],
            )

    narrow = docs.select(integer_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(judge, _OUT)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the character model counts the whole corpus."""
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(labelled_sample(docs, table(spark, sf_dir, "labels")), character_counts(docs)))
