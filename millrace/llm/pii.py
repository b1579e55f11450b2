"""Information-theoretic sanitisation: identifiers, and the terms that reveal them by co-occurrence in the corpus."""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, integer_id, table
from .textbytes import WORD, as_bytes, hash_of, letters, member, runs, slices, span_hashes

#: Words on each side of an identifier that count as occurring with it, whatever their length and the text's. Words of
#: other identifiers in between are not among them.
WINDOW = 8
#: Distinct surroundings from which a joint count is taken in full; fewer are weaker evidence (``revealing_terms``).
#: Copies of one text are one surrounding.
SUPPORT = 3
#: Share of an identifier's information that a term may give away before it is generalised, and before it is removed.
GENERALISE = 0.75
REMOVE = 0.9
#: Most terms (9 bytes each) that are broadcast; with more, terms meet documents in a join.
BROADCAST_TERMS = 1_000_000

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
ENTITY = re.compile(
    r"(?P<EMAIL>(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)+)"
    rf"|(?P<IP>(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d))"
    r"|(?P<IBAN>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<CARD>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<SSN>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<PHONE>\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)"
    r"|(?<![\w.])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\w))"
)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def _may_name(texts: pa.Array) -> np.ndarray:
    """True for texts with an at-sign or a digit: the others have no identifier."""
    raw, at = as_bytes(texts)
    sign = ((raw >= 48) & (raw <= 57)) | (raw == 64)
    upto = np.concatenate([[0], np.cumsum(sign)])
    return upto[at[1:]] > upto[at[:-1]]


def mentions(docs: DataFrame) -> DataFrame:
    """``(entity, term, around)`` once per document: an identifier, a term near it (null once for the identifier itself)
    and the hash of all that surrounds it there."""

    def find(batches):
        for batch in slices(batches, "text"):
            rows: dict[str, list[int]] = {"entity": [], "term": [], "around": []}
            texts = batch.column(0)
            texts = texts.filter(pa.array(_may_name(texts)))
            for text, low in zip(texts.to_pylist(), pc.utf8_lower(texts).to_pylist()):
                found = list(ENTITY.finditer(text))
                if not found:
                    continue
                plain, last = [], 0
                for m in found:
                    plain += [low[last : m.start()], " " * (m.end() - m.start())]
                    last = m.end()
                every = [(m.start(), m.group()) for m in WORD.finditer("".join([*plain, low[last:]]))]
                near: dict[str, list[str]] = {}
                for m in found:
                    i = bisect_left(every, (m.start(), ""))
                    key = m.lastgroup + ":" + re.sub(r"[^\w@.]" if m.lastgroup == "EMAIL" else r"\W", "", m.group().lower())
                    near.setdefault(key, []).extend(w for _, w in every[max(0, i - WINDOW) : i + WINDOW])
                for key, words in near.items():
                    entity, around = int(hash_of(key)), int(hash_of(" ".join(words)))
                    for term in [None, *map(int, {hash_of(w) for w in words})]:
                        rows["entity"].append(entity)
                        rows["term"].append(term)
                        rows["around"].append(around)
            signed = lambda v: [x if x is None or x < 1 << 63 else x - (1 << 64) for x in v]
            yield pa.record_batch([pa.array(signed(v), pa.int64()) for v in rows.values()], list(rows))

    return docs.select("text").filter("text IS NOT NULL").mapInArrow(find, "entity long, term long, around long")


def _distinct_terms(texts: pa.Array, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers, hashes) of the words of some texts, each once a text; only ``known`` ones if given."""
    raw, at = as_bytes(pc.utf8_lower(texts))
    starts, ends, doc = runs(letters(raw), at)
    h = _signed(span_hashes(raw, starts, ends))
    if known is not None:
        hit = member(h, known) >= 0
        h, doc = h[hit], doc[hit]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _broadcast_terms(docs: DataFrame, terms: DataFrame, small: bool):
    """The sorted hashes of the terms on every executor, or null if there are too many."""
    known = np.sort(terms.select("term").toArrow().column(0).to_numpy()) if small else None
    return docs.sparkSession.sparkContext.broadcast(known)


def occurrences(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """``(key, term)``: the given terms that each document has, ``key`` being the MD5 of its text.

    Up to ``BROADCAST_TERMS`` terms are broadcast as hashes; beyond, all words of all documents are joined with them.
    """
    small = n_terms <= BROADCAST_TERMS
    shared = _broadcast_terms(docs, terms, small)

    def find(batches):
        for batch in slices(batches, "text"):
            doc, h = _distinct_terms(batch.column(1), shared.value)
            if len(h):
                yield pa.record_batch([batch.column(0).take(pa.array(doc)), pa.array(h)], ["key", "term"])

    found = docs.filter("text IS NOT NULL").select(F.unhex(F.md5("text")).alias("key"), "text")
    found = found.mapInArrow(find, "key binary, term long")
    return found if small else found.join(terms.hint("shuffle_hash"), "term", "left_semi").select("key", "term")


def document_counts(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """``(term, with_term)``: in how many documents each given term is; broadcast or joined as in ``occurrences``.

    Near identifiers are common words too, so counts and not single occurrences leave Python.
    """
    small = n_terms <= BROADCAST_TERMS
    shared = _broadcast_terms(docs, terms, small)

    def count(batches):
        own = shared.value
        total = np.zeros(0 if own is None else len(own), np.int64)
        for batch in slices(batches, "text"):
            h = _distinct_terms(batch.column(0), own)[1]
            if own is not None:
                total += np.bincount(np.searchsorted(own, h), minlength=len(own))
            elif len(h):
                words, n = np.unique(h, return_counts=True)
                yield pa.record_batch([pa.array(words), pa.array(n.astype(np.int64))], ["term", "n"])
        some = np.flatnonzero(total)
        if len(some):
            yield pa.record_batch([pa.array(own[some]), pa.array(total[some])], ["term", "n"])

    counted = docs.select("text").filter("text IS NOT NULL").mapInArrow(count, "term long, n long")
    counted = counted.groupBy("term").agg(F.sum("n").alias("with_term"))
    return counted if small else counted.join(terms.hint("shuffle_hash"), "term", "left_semi")


def revealing_terms(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``(term, remove)``: hashes of the terms that disclose too much about some identifier.

    With document counts over the whole corpus, the information that term ``t`` gives about identifier ``e`` is
    ``PMI(e; t) = log(p(e, t) / (p(e) p(t)))``, and all there is to know is ``IC(e) = -log p(e)``. A term discloses the
    share ``PMI / IC``, greatest over all identifiers near which it occurs. A pair seen in s distinct surroundings, fewer
    than ``SUPPORT``, counts s/SUPPORT of its joint count, as if the surroundings missing had been seen without it: a term
    of a single text discloses ``1 - log(SUPPORT) / IC`` at most, which is evidence in a large corpus only.
    """
    near = cut(mentions(docs))
    alone = near.filter("term IS NULL").groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity"))
    joint = (
        near.filter("term IS NOT NULL")
        .groupBy("entity", "term")
        .agg(F.count(F.lit(1)).alias("both"), F.count_distinct("around").alias("support"))
    )
    joint = cut(joint.join(alone, "entity"))
    candidates = joint.select("term").distinct()
    with_term = document_counts(docs, candidates, candidates.count())
    n = docs.filter("text IS NOT NULL").count()
    evidence = F.least(F.lit(1.0), F.col("support") / SUPPORT)
    share = 1 + F.log(F.col("both") * evidence / F.col("with_term")) / F.greatest(
        F.lit(math.log(max(n, 2))) - F.log(F.col("with_entity")), F.lit(1e-9)
    )
    worst = joint.join(with_term, "term").groupBy("term").agg(F.max(share).alias("share"))
    return worst.filter(F.col("share") >= generalise).select("term", (F.col("share") >= remove).alias("remove"))


_OUT = "doc_id long, text string, n_identifiers int, n_generalised int, n_removed int"


def sanitise(
    docs: DataFrame,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    broadcast_terms: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, text, n_identifiers, n_generalised, n_removed)`` of every document, sanitised.

    Identifiers (mail and IP addresses, telephone, card, account and social security numbers) become the name of their
    class in brackets. Terms that disclose more than ``generalise`` of an identifier's information (``revealing_terms``)
    become the class of words that they are written like, ``[NAME]``, ``[ACRONYM]`` or ``[WORD]``: so many words share
    a class that it discloses next to nothing. Those beyond ``remove`` are removed. All other text stays as it is.

    Defined cases: a null text stays null and an empty one empty, with zero counts; a text of any length is read whole;
    a null id stays null and an id that is no integer is a ValueError; repeated rows give repeated rows and count in
    the corpus; of several identifiers that a term discloses, the one it discloses most of decides, and equal shares
    decide alike; an empty table gives no rows; other columns are not read, whatever their names.
    """
    named = docs.select(integer_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    terms = cut(revealing_terms(named, generalise, remove))
    n_terms = terms.count()
    limit = BROADCAST_TERMS if broadcast_terms is None else broadcast_terms
    known = None
    if n_terms <= limit:
        rows = terms.toArrow().sort_by("term")
        known = rows.column("term").to_numpy(), rows.column("remove").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def clean(batches):
        for batch in slices(batches, "text"):
            texts = batch.column(1)
            n = len(texts)
            counts = np.zeros((3, n), np.int32)
            low = pc.utf8_lower(pc.fill_null(texts, ""))
            raw, at = as_bytes(low)
            starts, ends, doc = runs(letters(raw), at)
            hashes = _signed(span_hashes(raw, starts, ends))
            if shared.value is not None:
                known_terms, gone = shared.value
            else:
                own = {t["term"]: t["remove"] for row in batch.column(2).to_pylist() for t in row or ()}
                known_terms = np.sort(np.array(list(own), np.int64))
                gone = np.array([own[t] for t in known_terms.tolist()], bool)
            place = member(hashes, known_terms)
            hit = place >= 0
            # The words to change, by text, as they are spelled in lower case.
            bad: dict[int, dict[str, bool]] = {}
            for d, s, e, p in zip(doc[hit].tolist(), starts[hit].tolist(), ends[hit].tolist(), place[hit].tolist()):
                bad.setdefault(d, {})[raw[s:e].tobytes().decode(errors="replace")] = bool(gone[p])
            touched = _may_name(texts)
            touched[doc[hit]] = True
            new = []
            for i in np.flatnonzero(touched).tolist():
                text, small = texts[i].as_py(), low[i].as_py()
                out, last = [], 0
                for m in ENTITY.finditer(text):
                    out += [_reword(text, small, last, m.start(), bad.get(i), counts, i), f"[{m.lastgroup}]"]
                    last = m.end()
                    counts[0, i] += 1
                new.append("".join([*out, _reword(text, small, last, len(text), bad.get(i), counts, i)]))
            if new:
                texts = pc.replace_with_mask(texts.cast(pa.string()), pa.array(touched), pa.array(new, pa.string()))
            yield pa.record_batch(
                [batch.column(0), texts.cast(pa.string()), *map(pa.array, counts)],
                ["doc_id", "text", "n_identifiers", "n_generalised", "n_removed"],
            )

    if known is None:
        per_text = occurrences(named, terms.select("term"), n_terms).join(terms, "term")
        per_text = per_text.groupBy("key").agg(F.collect_set(F.struct("term", "remove")).alias("bad"))
        named = named.withColumn("key", F.unhex(F.md5("text"))).join(per_text, "key", "left").select("doc_id", "text", "bad")
    return named.mapInArrow(clean, _OUT)


def word_class(word: str) -> str:
    """The class that a word is generalised to, by the way it is written."""
    if len(word) > 1 and word.isupper():
        return "[ACRONYM]"
    return "[NAME]" if word[:1].isupper() else "[WORD]"


def _reword(text: str, low: str, start: int, end: int, bad: dict[str, bool] | None, counts: np.ndarray, i: int) -> str:
    """That part of the text with revealing terms generalised or removed; ``low`` is the text in lower case."""
    if not bad:
        return text[start:end]
    out, last = [], start
    for m in WORD.finditer(low, start, end):
        remove = bad.get(m.group())
        if remove is None:
            continue
        counts[2 if remove else 1, i] += 1
        out += [text[last : m.start()], "" if remove else word_class(text[m.start() : m.end()])]
        last = m.end()
    return "".join([*out, text[last:end]])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sanitised against the identifiers of the whole corpus."""
    return sanitise(table(spark, sf_dir, "documents"))
