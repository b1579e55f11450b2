"""Quality of text by a support vector machine on n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import integer_id, table
from .textbytes import Spans, alnum, as_bytes, mix64, runs, slices

#: Bound of the labelled sample that the model is fitted to, for each class.
DOCS_PER_CLASS = 2500
BITS = 18
#: Share of good held-out documents that the threshold must keep.
GOOD_KEPT = 0.99


@dataclass
class Nbsvm:
    """Log-count ratio and machine's weight of each hashed n-gram, bias and threshold."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    threshold: float


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram slot) of the 1-grams and 2-grams of every text, each pair once, in order.

    Tokens are runs of letters and digits and runs of other visible signs, as written. A pair of equal tokens is one
    n-gram whatever the token, and so is a pair of upper-case tokens, as neither depends on the vocabulary.
    """
    raw, at = as_bytes(texts)
    word = alnum(raw)
    kind = np.where(word, 2, np.where(raw > 32, 1, 0)).astype(np.int8)
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    parts = [runs(kind == k, at) for k in (1, 2)]
    starts, ends, doc = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(starts, kind="stable")
    starts, ends, doc = starts[order], ends[order], doc[order]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = mix64(Spans(raw)(starts, ends))
    upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    lower = np.concatenate([[0], np.cumsum((raw >= 97) & (raw <= 122))])
    loud = (upper[ends] - upper[starts] > 1) & (lower[ends] == lower[starts])
    same_doc = doc[1:] == doc[:-1]
    two = mix64(one[:-1] * np.uint64(3) + one[1:])
    two = np.where(one[:-1] == one[1:], np.uint64(1 << 60), two)
    two = np.where(loud[:-1] & loud[1:] & (one[:-1] != one[1:]), np.uint64(2 << 60), two)[same_doc]
    slot = np.concatenate([one, two]) >> np.uint64(64 - BITS)
    owner = np.concatenate([doc, doc[:-1][same_doc]])
    keys = np.unique((owner.astype(np.int64) << BITS) | slot.astype(np.int64))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def log_ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """``r``: log of the smoothed, normalised counts of each n-gram in good texts over those in bad ones; 0 if in neither."""
    p, q = 1.0 + good, 1.0 + bad
    return np.where(good + bad > 0, np.log((p / p.sum()) / (q / q.sum())), 0.0)


def descend(
    feats: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: dict[int, float], epochs: int, rng: np.random.Generator
) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss machine on the rows ``r[f] / |r[f]|``, by dual coordinate descent.

    The bias is the weight of one more feature that is 1 everywhere (Hsieh et al. 2008). Rows are visited in random
    order until no dual variable moves by a thousandth.
    """
    w, b = np.zeros(len(r)), 0.0
    alpha = np.zeros(len(y))
    scale = [1 / max(1e-9, float(np.linalg.norm(r[f]))) for f in feats]
    square = [float((r[f] ** 2).sum()) * s**2 + 1.0 for f, s in zip(feats, scale)]
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)).tolist():
            f = feats[i]
            x = r[f] * scale[i]
            g = y[i] * (float(w[f] @ x) + b) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[int(y[i])])
            d = (new - alpha[i]) * y[i]
            if d:
                w[f] += d * x
                b += d
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w, b


def fit(sample: list[tuple[np.ndarray, int]], c: float = 1.0, epochs: int = 20, seed: int = 3, mixed: float = 0.25) -> Nbsvm | None:
    """The model of a labelled sample of (distinct n-gram slots, quality); None where it has not both classes.

    On indicators scaled by their ``log_ratios`` a linear hinge-loss machine is fitted (``descend``), classes weighted
    to equal shares, and its weights are interpolated with their mean magnitude (Wang and Manning 2012): times ``r``,
    that is a naive Bayes prior, which votes as the ratio does. The threshold is the largest that keeps ``GOOD_KEPT`` of
    the good texts of a held-out fifth, but not above 0.
    """
    y = np.array([1 if q else -1 for _, q in sample])
    if len(set(y.tolist())) < 2:
        return None
    feats = [np.asarray(f) for f, _ in sample]
    rng = np.random.default_rng(seed)

    def train(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        counts = [
            np.bincount(np.concatenate([feats[i] for i in rows if y[i] == k] or [np.zeros(0, int)]), minlength=1 << BITS)
            for k in (1, -1)
        ]
        r = log_ratios(*counts)
        cost = {k: c * len(rows) / (2.0 * max(1, (y[rows] == k).sum())) for k in (-1, 1)}
        w, b = descend([feats[i] for i in rows], y[rows], r, cost, epochs, rng)
        mean = np.abs(w[r != 0]).mean() if (r != 0).any() else 0.0
        return r, (1 - mixed) * w + mixed * mean, b

    def decide(model: tuple[np.ndarray, np.ndarray, float], rows: np.ndarray) -> np.ndarray:
        doc = np.repeat(np.arange(len(rows)), [len(feats[i]) for i in rows])
        slot = np.concatenate([feats[i] for i in rows] or [np.zeros(0, int)])
        return scores(*model, doc, slot, len(rows))

    order = rng.permutation(len(y))
    held, rest = order[: len(y) // 5], order[len(y) // 5 :]
    threshold = 0.0
    if len(set(y[rest].tolist())) == 2:
        got = np.sort(decide(train(rest), held[y[held] > 0]))
        if len(got):
            threshold = min(0.0, float(got[int((1 - GOOD_KEPT) * len(got))]))
    r, weights, b = train(np.arange(len(y)))
    return Nbsvm(r.astype(np.float32), weights.astype(np.float32), float(b), threshold)


def scores(ratio: np.ndarray, weights: np.ndarray, bias: float, doc: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
    """Decision value of each text: the weighted sum of its n-grams' ratios over the norm of these, plus the bias.

    The same scaling as in ``descend``, so this is the fitted machine's own decision.
    """
    r = ratio[slot].astype(np.float64)
    norm = np.sqrt(np.bincount(doc, r * r, n))
    return np.bincount(doc, r * weights[slot], n) / np.maximum(norm, 1e-9) + bias


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[np.ndarray, int]]:
    """(n-gram slots, quality) of at most ``DOCS_PER_CLASS`` documents of each class, drawn by a hash of the id.

    N-grams are found where the texts are; the driver gets the slots only, at most ``2**BITS`` of a text of any length.
    """
    draw = Window.partitionBy("quality").orderBy(F.xxhash64("id"), "id")
    marks = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.filter("id IS NOT NULL AND quality IN (0, 1)").groupBy("id").agg(F.min("quality").alias("quality"))
    drawn = marks.withColumn("n", F.row_number().over(draw)).filter(F.col("n") <= DOCS_PER_CLASS).select("id", "quality")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")

    def find(batches):
        for batch in slices(batches, "text"):
            doc, slot = ngrams(batch.column(2))
            edges = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(slot.astype(np.int32)))
            yield pa.record_batch([batch.column(0), batch.column(1), lists], ["id", "quality", "slots"])

    chosen = texts.join(F.broadcast(drawn), "id").select(F.col("id").cast("long").alias("id"), "quality", "text")
    rows = chosen.mapInArrow(find, "id long, quality int, slots array<int>")
    # Of rows that repeat an id the least list counts, so that the sample is the same whatever the order of rows.
    rows = rows.groupBy("id").agg(F.min("slots").alias("slots"), F.min("quality").alias("quality")).toArrow().sort_by("id")
    return list(zip([s.values.to_numpy() for s in rows.column("slots")], rows.column("quality").to_pylist()))


def classify(docs: DataFrame, model: Nbsvm | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, keep)`` of every document: decision value, and whether it reaches the threshold.

    Defined cases: null, empty and blank texts have no n-gram, score null and are not kept; a text of any length is read
    whole; without a model (labels of one class only, or none) every other text scores null and is kept; a score at the
    threshold is kept; a null id stays null and an id that is no integer is a ValueError; repeated rows give repeated
    rows; an empty table gives no rows; other columns are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        own = shared.value
        for batch in slices(batches, "text"):
            n = batch.num_rows
            doc, slot = ngrams(batch.column(1))
            some = np.bincount(doc, minlength=n) > 0
            if own is None:
                value, keep = pa.nulls(n, pa.float64()), some
            else:
                got = scores(own.ratio, own.weights, own.bias, doc, slot, n)
                value, keep = pa.array(got, mask=~some), some & (got >= own.threshold)
            yield pa.record_batch([batch.column(0), value, pa.array(keep)], ["doc_id", "score", "keep"])

    narrow = docs.select(integer_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(judge, "doc_id long, score double, keep boolean")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from a bounded sample of ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(labelled_sample(docs, table(spark, sf_dir, "labels"))))
