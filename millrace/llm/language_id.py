"""Word-level language identification of code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import integer_id, table
from .textbytes import as_bytes, letters, runs, slices, span_hashes

#: Bound of the labelled sample: documents of each language, and characters of the span taken at a place in each.
DOCS_PER_LANGUAGE = 300
SPAN_CHARS = 3000
#: Least mean probability of the words' labels, and least share of letter trigrams known from the sample, to accept.
CONFIDENCE = 0.5
COVERAGE = 0.5

_BITS = 16
_SLOTS = 1 << _BITS
_LEXICON_LEAST = 4
#: Text that is taken at a time in Python, with up to 16 languages: a worker then holds about 60 MB of features and
#: messages. With more, messages are wider and less text is taken.
_BYTES = 1 << 19


@dataclass
class Crf:
    """Weights by feature (rows) and label (columns), label transitions, lexicon word hashes and known trigrams."""

    labels: list[str]
    grams: np.ndarray
    pairs: np.ndarray
    affixes: np.ndarray
    lexicon: np.ndarray
    words: np.ndarray
    moves: np.ndarray
    known: np.ndarray


def _slot(code: np.ndarray, salt: int) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * salt)) >> np.uint64(64 - _BITS)).astype(np.int64)


@dataclass
class Featured:
    """Feature slots of every letter byte and word of a batch of texts."""

    at: np.ndarray  # letter bytes, then by them:
    gram: np.ndarray
    pair: np.ndarray
    edges: np.ndarray  # first letter byte of each word, then by words:
    size: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray


def featurise(texts: pa.Array) -> Featured:
    """Character n-grams (byte pairs and trigrams with word boundaries), affixes of up to 4 bytes and word hashes."""
    raw, meet = as_bytes(pc.utf8_lower(texts))
    mask = letters(raw)
    starts, ends, doc = runs(mask, meet)
    n = len(raw)
    shown = np.where(mask, raw, np.uint8(32)).astype(np.uint32)
    before = np.full(n, 32, np.uint32)
    after = np.full(n, 32, np.uint32)
    if n:
        before[1:] = shown[:-1]
        after[:-1] = shown[1:]
        before[starts] = 32
        after[ends - 1] = 32
    at = np.flatnonzero(mask)
    pair = (before[at] << 8) | shown[at]
    gram = _slot((pair << 8) | after[at], 0)
    padded = np.concatenate([shown, np.full(4, 32, np.uint32)])
    size = ends - starts

    def affix(first: np.ndarray, salt: int) -> np.ndarray:
        code = np.zeros(len(starts), np.uint64)
        for k in range(4):
            inside = (first + k >= starts) & (first + k < ends)
            code = (code << np.uint64(8)) | np.where(inside, padded[np.maximum(first + k, 0)], 0).astype(np.uint64)
        return _slot(code, salt)

    edges = np.searchsorted(at, starts)
    head, tail = affix(starts, 1), affix(ends - 4, 2)
    return Featured(at, gram, pair.astype(np.int64), edges, size, head, tail, span_hashes(raw, starts, ends), starts, ends, doc)


def emissions(model: Crf, x: Featured) -> np.ndarray:
    """Score of each label for each word."""
    if not len(x.doc):
        return np.zeros((0, len(model.labels)), np.float32)
    by_byte = model.grams[x.gram] + model.pairs[x.pair]
    out = np.add.reduceat(by_byte, x.edges, axis=0)
    out += model.affixes[x.head] + model.affixes[x.tail]
    at = np.minimum(np.searchsorted(model.lexicon, x.hashes), max(0, len(model.lexicon) - 1))
    if len(model.lexicon):
        out += np.where((model.lexicon[at] == x.hashes)[:, None], model.words[at], np.float32(0))
    return out


def marginals(scores: np.ndarray, doc: np.ndarray, moves: np.ndarray, block: int = 64) -> np.ndarray:
    """Probability of each label at each word, by forward-backward over each text's words (``doc`` ascending).

    Texts are cut into blocks whose transfer matrices are multiplied first, so the steps of all blocks of all texts run
    side by side; the result is that of the plain recursion over each whole text.
    """
    n, labels = scores.shape
    if not n:
        return scores.astype(np.float64)
    fresh = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    length = np.diff(np.append(fresh, n))
    blocks = -(-length // block)
    base = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    place = np.arange(n) - np.repeat(fresh, length)
    where_block = np.repeat(base, length) + place // block
    where_step = place % block
    nb = int(blocks.sum())
    x = np.zeros((block, nb, labels))
    x[where_step, where_block] = np.exp(scores - scores.max(axis=1, keepdims=True))
    full = np.zeros((block, nb), bool)
    full[where_step, where_block] = True
    m = np.exp(moves - moves.max())
    transfer = np.broadcast_to(np.eye(labels), (nb, labels, labels)).copy()
    for t in range(block):
        step = (transfer.reshape(-1, labels) @ m).reshape(nb, labels, labels) * x[t][:, None, :]
        step /= np.maximum(step.sum(axis=(1, 2), keepdims=True), 1e-300)
        transfer = np.where(full[t][:, None, None], step, transfer)
    into = np.full((nb, labels), 1.0 / labels)
    back = np.full((nb, labels), 1.0 / labels)
    for k in range(1, int(blocks.max())):
        later = base[blocks > k] + k
        v = np.einsum("bi,bij->bj", into[later - 1], transfer[later - 1])
        into[later] = v / v.sum(axis=1, keepdims=True)
        earlier = (base + blocks - 1 - k)[blocks > k]
        v = np.einsum("bij,bj->bi", transfer[earlier + 1], back[earlier + 1])
        back[earlier] = v / v.sum(axis=1, keepdims=True)
    alpha = np.empty_like(x)
    for t in range(block):
        into = (into @ m) * x[t]
        into /= np.maximum(into.sum(axis=1, keepdims=True), 1e-300)
        alpha[t] = into
    for t in range(block - 1, -1, -1):
        alpha[t] *= back
        v = (x[t] * back) @ m.T
        v /= np.maximum(v.sum(axis=1, keepdims=True), 1e-300)
        back = np.where(full[t][:, None], v, back)
    out = alpha[where_step, where_block]
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)


def train(sample: list[tuple[str, str]], epochs: int = 6, seed: int = 7, length: int = 96, batch: int = 96) -> Crf | None:
    """Fit the field by stochastic gradient (AdaGrad) on code-switched sequences spliced from labelled texts.

    ``sample`` holds (language, text). Each training sequence joins spans of 4 to 40 words of documents of random
    languages; words carry the label of their document. Returns None where the sample has no words.
    """
    labels = sorted({lang for lang, _ in sample})
    x = featurise(pa.array([t for _, t in sample], pa.string()))
    if not len(x.doc):
        return None
    rng = np.random.default_rng(seed)
    k = len(labels)
    gold_of_doc = np.array([labels.index(lang) for lang, _ in sample])
    gold = gold_of_doc[x.doc]
    hashes, counts = np.unique(x.hashes, return_counts=True)
    lexicon = hashes[counts >= _LEXICON_LEAST]
    known = np.zeros(_SLOTS, bool)
    known[x.gram] = True
    model = Crf(
        labels,
        np.zeros((_SLOTS, k), np.float32),
        np.zeros((_SLOTS, k), np.float32),
        np.zeros((_SLOTS, k), np.float32),
        lexicon,
        np.zeros((len(lexicon), k), np.float32),
        np.zeros((k, k)),
        known,
    )
    first = np.searchsorted(x.doc, np.arange(len(sample)))
    count = np.diff(np.append(first, len(x.doc)))
    of_label = [np.flatnonzero((gold_of_doc == j) & (count > 0)) for j in range(k)]
    present = [j for j in range(k) if len(of_label[j])]
    sequences = max(batch, min(max(4000, 1000 * k), len(x.doc) // length))
    lex_at = np.minimum(np.searchsorted(lexicon, x.hashes), max(0, len(lexicon) - 1)) if len(lexicon) else None
    in_lex = lexicon[lex_at] == x.hashes if len(lexicon) else np.zeros(len(x.doc), bool)
    rate, total = 0.35, {}

    def step(name: str, weights: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
        """One AdaGrad step on the rows that occur; ``grad`` has a row for each of ``rows``, repeats are summed."""
        seen, inverse = np.unique(rows, return_inverse=True)
        g = np.stack([np.bincount(inverse, grad[:, j], len(seen)) for j in range(k)], axis=1) / batch
        g += 1e-5 * weights[seen]
        square = total.setdefault(name, np.full(weights.shape, 1e-8))
        square[seen] += g * g
        weights[seen] -= (rate * g / np.sqrt(square[seen])).astype(weights.dtype)

    for _ in range(epochs * max(1, sequences // batch)):
        words = np.empty((batch, length), np.int64)
        for row in words:
            at = 0
            while at < length:
                d = rng.choice(of_label[present[rng.integers(len(present))]])
                span = min(int(rng.integers(4, 41)), length - at, int(count[d]))
                start = first[d] + int(rng.integers(0, count[d] - span + 1))
                row[at : at + span] = np.arange(start, start + span)
                at += span
        flat = words.ravel()
        letters_of = x.size[flat]
        owner = np.repeat(np.arange(len(flat)), letters_of)
        byte = np.repeat(x.edges[flat], letters_of) + np.arange(len(owner)) - np.repeat(np.cumsum(letters_of) - letters_of, letters_of)
        by_byte = model.grams[x.gram[byte]] + model.pairs[x.pair[byte]]
        e = np.add.reduceat(by_byte, np.cumsum(letters_of) - letters_of, axis=0).astype(np.float64)
        e += model.affixes[x.head[flat]] + model.affixes[x.tail[flat]]
        if len(lexicon):
            e += np.where(in_lex[flat][:, None], model.words[lex_at[flat]], 0)
        e = e.reshape(batch, length, k)
        y = gold[words]
        psi = np.exp(e - e.max(axis=2, keepdims=True))
        m = np.exp(model.moves)
        alpha, beta = np.empty_like(psi), np.empty_like(psi)
        a = np.full((batch, k), 1.0 / k)
        for t in range(length):
            a = (a @ m) * psi[:, t]
            a /= a.sum(axis=1, keepdims=True)
            alpha[:, t] = a
        b = np.full((batch, k), 1.0 / k)
        expected = np.zeros((k, k))
        for t in range(length - 1, -1, -1):
            beta[:, t] = b
            into = psi[:, t] * b
            if t:
                xi = alpha[:, t - 1][:, :, None] * m[None] * into[:, None, :]
                expected += (xi / xi.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = into @ m.T
            b /= b.sum(axis=1, keepdims=True)
        p = alpha * beta
        p /= p.sum(axis=2, keepdims=True)
        observed = np.zeros((k, k))
        np.add.at(observed, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        p[np.arange(batch)[:, None], np.arange(length)[None], y] -= 1
        g = p.reshape(-1, k)
        step("grams", model.grams, x.gram[byte], g[owner])
        step("pairs", model.pairs, x.pair[byte], g[owner])
        step("affixes", model.affixes, np.concatenate([x.head[flat], x.tail[flat]]), np.concatenate([g, g]))
        if len(lexicon) and in_lex[flat].any():
            step("words", model.words, lex_at[flat][in_lex[flat]], g[in_lex[flat]])
        step("moves", model.moves, np.arange(k), expected - observed)
    return model


def labelled_sample(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> list[tuple[str, str]]:
    """(language, span of text) of at most ``DOCS_PER_LANGUAGE`` documents of every language.

    Documents are drawn by a hash of their id, and so is the place of the span of ``SPAN_CHARS`` characters.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    named = named.filter("lang IS NOT NULL AND lang <> '' AND id IS NOT NULL")
    draw = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    drawn = named.select("id", "lang").withColumn("n", F.row_number().over(draw))
    drawn = drawn.filter(F.col("n") <= DOCS_PER_LANGUAGE).select("id", "lang").distinct()
    from_place = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - SPAN_CHARS + 1)) + 1
    spans = (
        named.filter("text IS NOT NULL")
        .join(F.broadcast(drawn), ["id", "lang"])
        .select("id", "lang", F.substring(F.col("text"), from_place.cast("int"), F.lit(SPAN_CHARS)).alias("span"))
    )
    rows = spans.dropDuplicates(["id"]).collect()
    return [(r.lang, r.span) for r in sorted(rows, key=lambda r: (r.lang, r.id))]


@dataclass
class Judged:
    """A batch under the model: features, words by text, label probabilities by word, confidence, coverage, decision."""

    x: Featured
    words: np.ndarray
    p: np.ndarray
    sure: np.ndarray
    seen: np.ndarray
    keep: np.ndarray


def _portion(model: Crf | None) -> int:
    """Bytes of text to take at a time."""
    return _BYTES if model is None else _BYTES * 16 // max(16, len(model.labels))


def judge(model: Crf | None, texts: pa.Array, confidence: float, coverage: float) -> Judged:
    """The field applied to whole texts; without a model, texts with a word are kept."""
    n = len(texts)
    x = featurise(texts)
    words = np.bincount(x.doc, minlength=n)
    if model is None:
        return Judged(x, words, np.zeros((len(x.doc), 0)), np.zeros(n), np.zeros(n), words > 0)
    p = marginals(emissions(model, x), x.doc, model.moves)
    sure = np.bincount(x.doc, p.max(axis=1), n) / np.maximum(words, 1)
    byte_doc = np.repeat(x.doc, x.size)
    seen = np.bincount(byte_doc, model.known[x.gram], n) / np.maximum(np.bincount(byte_doc, minlength=n), 1)
    return Judged(x, words, p, sure, seen, (words > 0) & (sure >= confidence) & (seen >= coverage))


_OUT = (
    "doc_id long, language string, confidence double, coverage double, n_words long, shares map<string,double>, "
    "spans array<struct<language:string,first_word:int,n_words:int>>, keep boolean"
)


def identify(
    docs: DataFrame,
    model: Crf | None,
    confidence: float = CONFIDENCE,
    coverage: float = COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: its language, the words' languages as spans, and whether it is accepted.

    Words are runs of letters. ``shares`` is each language's mean probability over the words, ``language`` the
    greatest (ties to the first by name), ``confidence`` the mean of the words' most probable labels, ``coverage`` the
    share of letter trigrams that the training sample had, ``spans`` the runs of words of one language. ``keep`` is
    false where a document has no word or either figure is below its threshold.

    Defined cases: null and empty texts and texts without letters have no language, no words and ``keep`` false; texts of
    any length are read whole; equal shares go to the language first by name, and so do equal probabilities of a word; a
    null id stays null and an id that is no integer is a ValueError; repeated rows give repeated rows; without a model
    (no labelled row at all) no language is named and every text with a word is kept; an empty table gives no rows;
    other columns are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        crf = shared.value
        for batch in slices(batches, "text", _portion(crf)):
            n = batch.num_rows
            got = judge(crf, batch.column(1), confidence, coverage)
            x, words, p = got.x, got.words, got.p
            if crf is None or not len(x.doc):
                zeros, names = pa.array(np.zeros(n)), pa.nulls(n, pa.string())
                shares = pa.array([{}] * n, pa.map_(pa.string(), pa.float64()))
                columns = [batch.column(0), names, zeros, zeros, pa.array(words), shares, pa.array([[]] * n, _SPANS)]
                yield pa.record_batch([*columns, pa.array(got.keep)], _NAMES)
                continue
            best = p.argmax(axis=1)
            k = len(crf.labels)
            shares = np.stack([np.bincount(x.doc, p[:, j], n) for j in range(k)], axis=1) / np.maximum(words, 1)[:, None]
            new = np.concatenate([[True], (x.doc[1:] != x.doc[:-1]) | (best[1:] != best[:-1])])
            at = np.flatnonzero(new)
            first = np.searchsorted(x.doc, np.arange(n))
            names = np.array(crf.labels, object)
            spans = pa.StructArray.from_arrays(
                [
                    pa.array(names[best[at]], pa.string()),
                    pa.array((at - first[x.doc[at]]).astype(np.int32)),
                    pa.array(np.diff(np.append(at, len(best))).astype(np.int32)),
                ],
                ["language", "first_word", "n_words"],
            )
            edges = np.searchsorted(x.doc[at], np.arange(n + 1)).astype(np.int32)
            keys = pa.array(np.tile(names, int((words > 0).sum())), pa.string())
            ends = np.concatenate([[0], np.cumsum((words > 0) * k)]).astype(np.int32)
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(np.where(words > 0, names[shares.argmax(axis=1)], None), pa.string()),
                    pa.array(got.sure),
                    pa.array(got.seen),
                    pa.array(words),
                    pa.MapArray.from_arrays(pa.array(ends), keys, pa.array(shares[words > 0].ravel())),
                    pa.ListArray.from_arrays(pa.array(edges), spans),
                    pa.array(got.keep),
                ],
                _NAMES,
            )

    narrow = docs.select(integer_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(label, _OUT)


_NAMES = ["doc_id", "language", "confidence", "coverage", "n_words", "shares", "spans", "keep"]
_SPANS = pa.list_(pa.struct([("language", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` (all columns) that language identification accepts.

    The decision is made on the row's own text in one pass without a shuffle; see ``identify`` for the defined cases.
    """
    model = train(labelled_sample(docs, id_col, text_col, lang_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        crf = shared.value
        parts = slices([pa.record_batch([texts], ["text"])], "text", _portion(crf))
        out = [judge(crf, part.column(0), CONFIDENCE, COVERAGE).keep for part in parts]
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.filter(accepted(F.col(text_col)))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and of its words."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(labelled_sample(docs)))
