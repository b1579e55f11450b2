"""Every operator against SQL, a brute-force version, or held-out accuracy."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import exact_dedup, language_id, mixing, near_dedup, packing, pii, quality, queries, secrets, topk, toxicity
from tests.llm.brute import groups, jaccard_pairs
from tests.oracle import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF2}/documents.parquet")


@pytest.fixture(scope="module")
def labelled(docs):
    both = docs.merge(pd.read_parquet(f"{SF2}/labels.parquet"), on="doc_id")
    return both.sample(frac=1, random_state=1).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == duck_rows(queries.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_queries_run(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


# 1


def plain_marginals(scores, moves):
    k = scores.shape[1]
    m, x = np.exp(moves), np.exp(scores)
    a = [np.ones(k) / k @ m * x[0]]
    for t in range(1, len(x)):
        v = a[-1] @ m * x[t]
        a.append(v / v.sum())
    b = [np.ones(k)]
    for t in range(len(x) - 1, 0, -1):
        v = m @ (x[t] * b[-1])
        b.append(v / v.sum())
    p = np.array(a) * np.array(b[::-1])
    return p / p.sum(axis=1, keepdims=True)


def test_blocked_forward_backward_is_the_plain_one():
    rng = np.random.default_rng(0)
    lengths = [1, 63, 64, 65, 500, 2]
    doc = np.repeat([0, 1, 3, 4, 7, 8], lengths)
    scores, moves = rng.normal(size=(len(doc), 3)) * 5, rng.normal(size=(3, 3))
    got = language_id.marginals(scores, doc, moves)
    for d in set(doc.tolist()):
        assert np.allclose(got[doc == d], plain_marginals(scores[doc == d], moves), atol=1e-12)


def test_languages_of_held_out_and_switched_text(docs):
    known = docs[docs.text.str.split().str.len() > 30].reset_index(drop=True)
    fit, held = known[known.index % 2 == 0], known[known.index % 2 == 1]
    model = language_id.train(list(zip(fit.lang, fit.text)), epochs=3)
    got = language_id.judge(model, pa.array(held.text), 0.5, 0.5)
    best = [model.labels[np.bincount(got.p[got.x.doc == i].argmax(axis=1)).argmax()] for i in range(len(held))]
    assert np.mean(np.array(best) == held.lang.values) > 0.97 and got.keep.all()
    rng, right, total = random.Random(2), 0, 0
    by_lang = {lang: held.text[held.lang == lang].tolist() for lang in model.labels}
    for _ in range(60):
        words, gold = [], []
        for lang in rng.sample(model.labels, 2):
            clean = [w for w in rng.choice(by_lang[lang]).split() if w.isalpha()][:25]
            words += clean
            gold += [lang] * len(clean)
        got = language_id.judge(model, pa.array([" ".join(words)]), 0.5, 0.5)
        right += sum(model.labels[j] == g for j, g in zip(got.p.argmax(axis=1), gold))
        total += len(gold)
    assert right / total > 0.9
    assert not language_id.judge(model, pa.array(["русский текст без знакомых букв", "12 34"]), 0.5, 0.5).keep.any()


def test_every_language_is_learned(spark):
    rng = random.Random(11)
    scripts = [0x61, 0x3B1, 0x430, 0x561, 0x5D0, 0x628, 0x905, 0x995, 0xA05, 0xA85, 0xB05, 0xB85, 0xC05, 0xC85, 0xD05, 0xE01, 0x10D0, 0x1200, 0x3041, 0x30A1]
    rows = []
    for j, first in enumerate(scripts):
        words = ["".join(chr(first + rng.randrange(20)) for _ in range(5)) for _ in range(30)]
        for _ in range(9 if j < 16 else 4):
            rows.append((len(rows), " ".join(rng.choice(words) for _ in range(40)), f"l{j:02d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.labelled_sample(docs)
    assert Counter(lang for lang, _ in sample) == Counter(lang for _, _, lang in rows)
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.train(sample)).collect()}
    assert all(got[i].keep and got[i].language == lang for i, _, lang in rows)
    assert language_id.keep_identified(docs).count() == len(rows)


# 2


def plain_terms(texts):
    """Disclosure shares by counting everything."""
    n = len(texts)
    with_entity, both, around, with_term = Counter(), Counter(), {}, Counter()
    words_of = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    for t in texts:
        with_term.update(set(words_of(t)))
        near = {}
        for m in pii.ENTITY.finditer(t):
            left, right = (words_of(pii.ENTITY.sub(" ", part)) for part in (t[: m.start()], t[m.end() :]))
            near.setdefault(m.group().lower(), []).extend(left[-pii.WINDOW :] + right[: pii.WINDOW])
        for e, words in near.items():
            with_entity[e] += 1
            for w in set(words):
                both[e, w] += 1
                around.setdefault((e, w), set()).add(" ".join(words))
    share = {}
    for (e, w), k in both.items():
        evidence = min(1, len(around[e, w]) / pii.SUPPORT)
        s = 1 + math.log(k * evidence / with_term[w]) / max(math.log(n / with_entity[e]), 1e-9)
        share[w] = max(share.get(w, -9), s)
    return {w: s >= pii.REMOVE for w, s in share.items() if s >= pii.GENERALISE}


@pytest.mark.parametrize("limit", [pii.BROADCAST_TERMS, -1])
def test_revealing_terms(spark, monkeypatch, limit):
    rng = random.Random(4)
    common = [f"{a}{b}" for a in "abcdefgh" for b in ("lor", "tis", "mun", "sek")]
    texts = []
    for i in range(300):
        words = [rng.choice(common) for _ in range(14)]
        if i % 10 == 0:
            words[5:7] = ["zorblatt", "ann@corp.example"]
        if i % 6 == 0:
            words[2] = "semirare"
        if i % 12 == 0:
            words[3] = "+1 (555) 555-1234"
        if i % 15 == 0:  # far from the identifier in characters, near it in words, and beyond another one
            words[7:10] = [f"“{'x' * 400}{'abcdefgh'[i // 15 % 8]}”", "83.229.25.121", "Quuxworth"]
        texts.append(" ".join(words))
    monkeypatch.setattr(pii, "BROADCAST_TERMS", limit)
    terms = plain_terms(texts)
    assert terms["zorblatt"] and "quuxworth" in terms
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.sanitise(df).collect():
        new = lambda m: m.group() if (t := m.group().lower()) not in terms else "" if terms[t] else pii.word_class(m.group())
        parts = [re.sub(r"[^\W\d_]+", new, p) for p in pii.ENTITY.split(texts[r.doc_id])[:: pii.ENTITY.groups + 1]]
        kinds = [f"[{m.lastgroup}]" for m in pii.ENTITY.finditer(texts[r.doc_id])]
        assert r.text == "".join(p + k for p, k in zip(parts, [*kinds, ""]))


@pytest.mark.parametrize("limit", [pii.BROADCAST_TERMS, -1])
def test_terms_of_identifiers_in_one_or_two_texts(spark, monkeypatch, limit):
    rng = random.Random(7)
    common = [f"{a}{b}" for a in "abcdefgh" for b in ("lor", "tis", "mun", "sek")]
    texts = [" ".join(rng.choice(common) for _ in range(14)) for _ in range(300)]
    texts[10] = f"{texts[10]} quibbleton once@corp.example"
    for i in (20, 30):
        texts[i] = f"{texts[i]} frobnitz twice@corp.example"
    texts[40] += " lonelyword"
    monkeypatch.setattr(pii, "BROADCAST_TERMS", limit)
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[10].text.endswith(" [WORD] [EMAIL]") and got[10].n_generalised == 1  # 1 - log(3) / log(300) = 0.81
    assert all(got[i].text.endswith("  [EMAIL]") and got[i].n_removed == 1 for i in (20, 30))  # 1 - log(3/2) / log(150) = 0.92
    rest = set(got) - {10, 20, 30}
    assert all(got[i].text == texts[i] for i in rest)


def test_identifiers():
    hidden = "a.b@c.example 83.229.25.121 +1 (974) 555-3436 4952935900253052 123-45-6789 (555) 123-4567 DE89 3704 0044 0532 0130 00"
    assert pii.ENTITY.sub(lambda m: m.lastgroup, hidden) == "EMAIL IP PHONE CARD SSN PHONE IBAN"
    assert pii.ENTITY.sub("X", "call +1 555) 555 1234 or +49 (30 1234 5678 now") == "call X or X now"  # one parenthesis only
    assert [pii.word_class(w) for w in ("Zorblatt", "NATO", "X", "zorblatt", "漢字")] == ["[NAME]", "[ACRONYM]", "[NAME]", "[WORD]", "[WORD]"]
    plain = "version 4.0 of 2024 has 12,345 words at 10:30 and 1.2.3.4.5 parts, see chapter 3"
    assert pii.ENTITY.sub("X", plain).count("X") == 0


# 3


def least_bins(lengths, capacity):
    best, order = [len(lengths)], sorted(lengths, reverse=True)

    def place(i, room):
        if len(room) >= best[0]:
            return
        if i == len(order):
            best[0] = len(room)
            return
        for j in {r: j for j, r in enumerate(room) if r >= order[i]}.values():
            room[j] -= order[i]
            place(i + 1, room)
            room[j] += order[i]
        place(i + 1, [*room, capacity - order[i]])

    place(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_sets():
    rng = random.Random(5)
    for _ in range(150):
        lengths = [rng.randint(15, 70) for _ in range(rng.randint(1, 12))]
        bins = packing.bin_completion(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
        assert len(bins) == least_bins(lengths, 100)


def test_fillings_are_all_the_undominated_ones():
    rng = random.Random(6)
    for _ in range(60):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        sizes, space = sorted(counts, reverse=True), rng.randint(1, 25)
        slack = rng.randint(0, space)
        got = list(packing.fillings(sizes, counts, space, slack, [10**6]))
        want = set()
        for choice in itertools.product(*[range(counts[s] + 1) for s in sizes]):
            filling = tuple(s for s, k in zip(sizes, choice) for _ in range(k))
            waste = space - sum(filling)
            left = [s for s, k in zip(sizes, choice) if counts[s] > k]
            if 0 <= waste <= slack and not any(t <= waste or any(s < t <= s + waste for s in filling) for t in left):
                want.add(filling)
        assert set(got) == want and len(got) == len(want)
        assert [sum(f) for f in got] == sorted(map(sum, got), reverse=True)
    assert len(packing.bin_completion([1] * 3000 + [2] * 3000, 2048)) == 5  # many pieces in a bin


def test_every_token_is_packed_once(spark, docs):
    got = packing.pack(spark.createDataFrame(docs[["doc_id", "text"]]), pieces_per_shard=300).toPandas()
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == docs.set_index("doc_id").text.str.split().str.len().to_dict()
    for _, b in got.sort_values("bin_offset").groupby(["shard", "bin"]):
        assert b.n_tokens.sum() <= packing.CAPACITY
        assert b.bin_offset.tolist() == [0, *b.n_tokens.cumsum().tolist()[:-1]]
    per_shard = got.groupby("shard").agg(n=("n_tokens", "sum"), bins=("bin", "nunique"))
    assert (per_shard.bins <= np.ceil(per_shard.n / packing.CAPACITY) * 1.05 + 1).all()


# 4


def every_reading(token, spaced=False):
    """All readings of a token with their channel cost."""
    parts = []
    for at, (c, run) in enumerate(itertools.groupby(token)):
        n = len(list(run))
        options = []
        for x, cost in [(c, 0.0), *((x, -0.7 if c != "*" else -1.5) for x in toxicity.LEET.get(c, ""))]:
            options += [(x * n, n * cost)]
            options += [(x, cost - (0.5 if n > 2 else 2.0))] if n >= 2 else []
            options += [(x * 2, 2 * cost - 0.7)] if n > 2 else []
        if spaced and at:
            options += [(" " + x, cost - 1.0) for x, cost in options]
            options += [("", -2.0)] if c in toxicity.LEET and not c.isdigit() else []
        parts.append(options)
    for choice in itertools.product(*parts):
        yield "".join(x for x, _ in choice), sum(cost for _, cost in choice)


def test_viterbi_finds_the_best_reading(spark, docs):
    counts = toxicity.character_counts(spark.createDataFrame(docs[["text"]]))
    raw = "".join(docs.text)
    assert counts.sum() == len(raw.encode()) + 2 * len(docs)  # every text gives as many trigrams as bytes, and two
    lm = toxicity.language_model(counts, {"stupid": 1.0, "idiot": 1.0})

    def score(text):
        s = [0, 0, *(int(toxicity._LUT[b]) for b in text.encode()), 0]
        return sum(lm[a, b, c] for a, b, c in zip(s, s[1:], s[2:]))

    for token in ("5tup1d", "1d10t", "stuuupid", "$$a1", "the", "h3llo", "0011", "é1a"):
        got = toxicity.decode(token, lm)
        best = max(score(t) + cost for t, cost in every_reading(token))
        assert max(score(t) + cost for t, cost in every_reading(token) if t == got) == pytest.approx(best)
    for token in ("idiot", "1d!ot", "anidiot", "s$u", "aab"):
        got = toxicity.decode(token, lm, True)
        best = max(score(t) + cost for t, cost in every_reading(token, True))
        assert max(score(t) + cost for t, cost in every_reading(token, True) if t == got) == pytest.approx(best)
    assert toxicity.decode("5tup1d", lm) == "stupid" and len(toxicity.decode("x" * 200_000, lm)) in (1, 2, 200_000)


def test_toxicity_of_held_out_and_hidden_words(spark, labelled):
    counts = toxicity.character_counts(spark.createDataFrame(labelled[["text"]]))
    fit, held = labelled[:270], labelled[270:]
    model = toxicity.fit(list(zip(fit.text, fit.toxic)), counts)
    p = toxicity.score(model, pa.array(held.text))[0]
    assert np.mean((p >= model.threshold) == (held.toxic == 1)) > 0.9
    model = toxicity.fit(list(zip(labelled.text, labelled.toxic)), counts)
    swap = str.maketrans({"i": "1", "o": "0", "e": "3", "a": "4", "s": "5"})
    words = [w for w in model.lexicon if w.isascii() and len(w) > 4]
    assert {"stupid", "idiot"} & set(words)
    clean = "the and of with entthe erand"
    hide = [lambda w: w.translate(swap), lambda w: " ".join(w), lambda w: w[0] + w[1] * 4 + w[2:], lambda w: w[:2] + "-" + w[2:]]
    for f in hide:
        texts = [f"{clean} {f(w)} {clean}" for w in words]
        plain = toxicity.score(model, pa.array([f"{clean} {w} {clean}" for w in words]))[0]
        assert np.mean(toxicity.score(model, pa.array(texts))[0] >= plain - 0.05) > 0.8
    assert toxicity.score(model, pa.array([clean]))[0][0] < model.threshold


@pytest.fixture(scope="module")
def hiding(spark, labelled):
    counts = toxicity.character_counts(spark.createDataFrame(labelled[["text"]]))
    return toxicity.fit(list(zip(labelled.text, labelled.toxic)), counts)


def restored(model, texts):
    """What is read in each text."""
    got = toxicity.restore(model, pa.array(texts))
    out = [set() for _ in texts]
    for d, _, read in got.found:
        out[d].update(read.split())
    return out


def test_signs_at_the_end_of_words(hiding):
    swap = {"i": "1", "o": "0", "e": "3", "a": "4", "s": "5", "t": "7", "l": "1", "g": "9", "b": "8"}
    words = [w for w in hiding.lexicon if len(w) > 4 and w[-1] in swap]
    assert "idiot" in words
    texts = [f"the and of {w[:-1]}{swap[w[-1]]} the erand" for w in words]
    assert np.mean([w in r for w, r in zip(words, restored(hiding, texts))]) > 0.8
    texts = ["the and of idio7 the erand", "the and of idiot the erand", "the and of the erand", "the and of! the erand$$$"]
    p = toxicity.score(hiding, pa.array(texts))[0]
    assert p[0] >= p[1] - 0.05 and p[0] > p[2] == p[3]
    lm = toxicity.language_model(np.zeros((64, 64, 64)), {"kill": 1.0, "ass": 1.0})
    own = toxicity.Channel(lm, lexicon=["kill", "ass"])
    assert restored(own, ["ki11", "a55", "a$$"]) == [{"kill"}, {"ass"}, {"ass"}]


def test_accented_separated_and_unevenly_split_words(hiding):
    words = ["imbécile", "blöd", "stupid", "idiot"]
    lm = toxicity.language_model(np.zeros((64, 64, 64)), dict.fromkeys(words, 1.0))
    own = toxicity.Channel(lm, lexicon=words)
    for gap in (" ", "  ", "-", " - ", "...", "*", " * ", "\n"):
        assert all(w in r for w, r in zip(words, restored(own, [gap.join(w) for w in words]))), gap
    hidden = {"s-t-u-pid": "stupid", "st.up.i.d": "stupid", "st--upid": "stupid", "s-t-u-p1d": "stupid", "i*d*1*o*t": "idiot"}
    hidden |= {"blöööd": "blöd", "imb-é-cile": "imbécile", "s t u pid": "stupid", "i d 1 o t": "idiot"}
    assert all(w in r for w, r in zip(hidden.values(), restored(own, list(hidden)))), restored(own, list(hidden))
    assert not any(set(words) & r for r in restored(own, ["stu pie", "the and of", "idi xot"]))
    apart = toxicity.restore(own, pa.array(["i d i", "o t", "blö", "öd"]))
    assert not any(set(words) & set(read.split()) for _, _, read in apart.found)


def test_plainly_hidden_words_score_as_the_word(hiding):
    frame = "the house by the river with the people and {} other things of the day"
    forms = ["idiot", "“idiot”", "word—idiot—word", "idio7", "id iot", "idi ot", "i d i o t", "1d10t", "«idiot»", "idiot…", "\u00a0idiot\u00a0", "id\u200biot"]
    p = toxicity.score(hiding, pa.array([frame.format(f) for f in forms]))[0]
    clean = toxicity.score(hiding, pa.array([frame.format("tree")]))[0][0]
    assert (p >= p[0] - 0.05).all() and p[0] > clean + 0.3


def test_parted_words_against_brute_force(hiding):
    rng = random.Random(13)
    lm = toxicity.language_model(np.zeros((64, 64, 64)), dict.fromkeys(["abab", "ba", "caab", "öab"], 1.0))
    own = toxicity.Channel(lm, lexicon=["abab", "ba", "caab", "öab"])
    pieces = ["a", "b", "ab", "ca", "ö", "cab", "bab", "öa", "the"]
    for _ in range(60):
        words = [rng.choice(pieces) for _ in range(rng.randint(2, 9))]
        gaps = [rng.choice([" ", " ", "  ", "-", ", "]) for _ in words[1:]]
        want = set()
        for i, j in itertools.combinations(range(len(words)), 2):
            part, between = words[i : j + 1], gaps[i:j]
            blank = all(not g.strip() and len(a) > 1 and len(b) > 1 for g, a, b in zip(between, part, part[1:]))
            if "".join(part) in own.lexicon and (not blank or own.closes(part)):
                want.add(("".join(itertools.chain(*zip(part, [*between, ""]))), "".join(part)))
        text = "".join(itertools.chain(*zip(words, [*gaps, ""])))
        got = {(seen, read) for _, seen, read in toxicity.restore(own, pa.array([text])).found if read in own.lexicon}
        assert want <= got and all(seen in text or "".join(c for c in text if c.isalpha()).find(read) >= 0 for seen, read in got)


# 5


def nearest(x, k):
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d))[:, :k]
    return want, np.take_along_axis(d, want, 1)


@pytest.mark.parametrize("limit", [topk.BROADCAST_BYTES, -1])
@pytest.mark.parametrize("centres, dim", [(8, 6), (0, 6), (3, 100)])
def test_neighbours(spark, monkeypatch, limit, centres, dim):
    monkeypatch.setattr(topk, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(topk, "GROUP", 16)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, dim))
    if centres:
        x = x + (rng.normal(size=(centres, dim)) * 10)[rng.integers(0, centres, 400)]
    x = x.astype(np.float32)
    x[7] = x[9] = x[3]  # ties
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    got = topk.nearest_neighbours(df, k=5, pivots=6, block=32).toPandas().sort_values(["vec_id", "rank"])
    want, d = nearest(x, 5)
    assert (got.neighbor_id.values.reshape(400, 5) == want).all()
    assert np.allclose(got.distance.values.reshape(400, 5), d)


@pytest.mark.parametrize("limit", [topk.BROADCAST_BYTES, -1])
def test_neighbours_of_huge_vectors_and_other_dimensions(spark, monkeypatch, limit):
    monkeypatch.setattr(topk, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(7)
    three, two = (rng.normal(size=(30, 3)) * 1e19).astype(np.float32), rng.normal(size=(25, 2)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(three)] + [(100 + i, v.tolist()) for i, v in enumerate(two)] + [(200, [1.0])]
    got = topk.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=4, pivots=5, block=8).toPandas()
    got = got.sort_values(["vec_id", "rank"])
    for base, x in ((0, three), (100, two)):
        part = got[(got.vec_id >= base) & (got.vec_id < base + 100)]
        want, d = nearest(x, 4)
        assert (part.neighbor_id.values.reshape(-1, 4) - base == want).all() and np.allclose(part.distance.values.reshape(-1, 4), d)
    assert len(got) == 4 * 55


@pytest.mark.parametrize("limit", [topk.BROADCAST_BYTES, -1])
def test_search_moves_vectors_once_where_nothing_is_excluded(spark, monkeypatch, limit):
    monkeypatch.setattr(topk, "BROADCAST_BYTES", limit)
    x = np.random.default_rng(9).normal(size=(3000, 32)).astype(np.float32)
    x[40] = x[50] = x[60]
    rows = [*enumerate(x.tolist()), (100, [9.0] * 32), (7, x[7].tolist())]  # repeated ids
    x[100] = min(x[100].tolist(), [9.0] * 32)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    got = topk.nearest_neighbours(df, k=5, block=256, every=50).toPandas().sort_values(["vec_id", "rank"])
    want, d = nearest(x, 5)
    assert (got.vec_id.values[::5] == np.arange(0, 3000, 50)).all()
    assert (got.neighbor_id.values.reshape(60, 5) == want[::50]).all() and np.allclose(got.distance.values.reshape(60, 5), d[::50])
    every = topk.nearest_neighbours(df, k=5, block=256)
    assert every.count() == 15_000 and (written() - before) < 8 * x.nbytes


def test_bounds_of_each_query_exclude_candidates():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 200)) * 10
    x = (centres[np.arange(600) % 12] + rng.normal(size=(600, 200)) * 0.1).astype(np.float32)
    rows = topk.Rows(np.arange(600), x, topk.pivot_distances(x, topk.choose_pivots(x[:100].astype(float), 12)))
    state = topk.Nearest(rows, 5)
    state.offer(rows)
    assert (state.who == nearest(x, 5)[0]).all()
    state.compared = 0
    state.offer(rows)  # the radii are known now
    assert state.x_long() and state.compared < 600 * 600 * 0.1


# 6


def slots_of(texts):
    doc, slot = quality.ngrams(pa.array(texts))
    return [slot[doc == i] for i in range(len(texts))]


def test_quality_of_held_out_texts(labelled):
    model = quality.fit(list(zip(slots_of(labelled.text[:270]), labelled.quality[:270])))
    held = labelled[270:]
    doc, slot = quality.ngrams(pa.array(held.text))
    z = quality.scores(model.ratio, model.weights, model.bias, doc, slot, len(held))
    good = held.quality.values == 1
    assert np.mean((z >= model.threshold) == good) > 0.9 and np.mean((z >= model.threshold)[good]) > 0.97


def test_dual_coordinate_descent_against_subgradient_descent():
    rng = np.random.default_rng(1)
    feats = [np.unique(rng.integers(0, 12, 5)) for _ in range(40)]
    y = np.where([(f < 5).sum() > 2 for f in feats], 1, -1)
    r, cost = rng.normal(size=12), {1: 0.7, -1: 1.3}
    x = np.zeros((40, 13))
    for i, f in enumerate(feats):
        x[i, f] = r[f] / np.linalg.norm(r[f])
    x[:, 12] = 1
    c = np.array([cost[int(v)] for v in y])
    loss = lambda v: v @ v / 2 + (c * np.maximum(0, 1 - y * (x @ v))).sum()
    v, best = np.zeros(13), np.inf
    for t in range(1, 60_000):
        v = v - (v - (c * y * (y * (x @ v) < 1)) @ x) / t
        best = min(best, loss(v)) if t > 1000 else best
    w, b = quality.descend(feats, y, r, cost, 2000, rng)
    assert loss(np.append(w, b)) == pytest.approx(best, rel=2e-3)  # descent stops at moves of a thousandth


def test_quality_is_the_machine_and_its_prior_by_hand(spark):
    good = [f"the house {w} was quiet" for w in "abcdefghijkl"]
    bad = [f"click here {w} buy now" for w in "abcdefghijkl"]
    rows = [(i, t, int(i < 12)) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    sample = quality.labelled_sample(docs, labels)
    assert [q for _, q in sample] == [q for _, _, q in rows]
    slots = slots_of(good + bad)
    assert all((a == b).all() for (a, _), b in zip(sample, slots))
    counts = [Counter(s for f in part for s in f.tolist()) for part in (slots[:12], slots[12:])]
    every = set(counts[0]) | set(counts[1])
    p, q = ({s: 1 + n[s] for s in range(1 << quality.BITS)} for n in counts)
    ratio = {s: math.log(p[s] / sum(p.values()) / (q[s] / sum(q.values()))) for s in every}
    model = quality.fit(sample)
    assert all(model.ratio[s] == pytest.approx(r, abs=1e-5) for s, r in ratio.items())
    want = {}
    for i, f in enumerate(slots):
        norm = math.sqrt(sum(ratio[s] ** 2 for s in f.tolist()))
        want[i] = sum(float(model.weights[s]) * ratio[s] for s in f.tolist()) / norm + model.bias
    got = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    assert all(got[i].score == pytest.approx(v, abs=1e-4) and got[i].keep == (v >= model.threshold) for i, v in want.items())
    assert all((got[i].score > 0) == (i < 12) for i in want)
    # With the machine's vote taken away, the prior votes as the ratios do.
    prior = quality.fit(sample, mixed=1.0)
    votes = prior.weights * prior.ratio
    assert all((votes[s] > 0) == (r > 0) for s, r in ratio.items() if abs(r) > 0.5)


# 7


def test_inverted_join_is_exact(spark):
    rng = np.random.default_rng(8)
    k, rows = 12, []
    for i in range(250):
        if rows and rng.random() < 0.5:
            sig = rows[rng.integers(len(rows))].copy()
            sig[rng.random(k) < 0.3] = rng.integers(0, 1000)
        else:
            sig = np.where(rng.random(k) < 0.5, 7, rng.integers(0, 1000, k))  # 7 is hot in every coordinate
        rows.append(sig.astype(np.int64) - 500)
    df = spark.createDataFrame([(i, [int(v) for v in s]) for i, s in enumerate(rows)], "doc_id long, sig array<int>")
    for threshold in (0.4, 0.6, 0.9):
        got = {(r.doc_a, r.doc_b): r.matches for r in near_dedup.similar_signatures(df, k, threshold).collect()}
        least = {}
        for i, s in enumerate(rows):
            least.setdefault(tuple(s), i)
        rep = [least[tuple(s)] for s in rows]
        want = {(rep[i], i): k for i in range(250) if rep[i] != i}
        for i, j in itertools.combinations(sorted(set(rep)), 2):
            m = int((rows[i] == rows[j]).sum())
            if m >= math.ceil(threshold * k):
                want[i, j] = m
        assert got == want


def test_a_share_at_the_threshold_is_a_pair(spark):
    # 0.56 * 25 is more than 14 in floating numbers, 14 / 25 is not less than 0.56
    rows = [(1, [*range(14), *[50] * 11]), (2, [*range(14), *[60] * 11]), (3, [*range(13), *[70] * 12])]
    df = spark.createDataFrame(rows, "doc_id long, sig array<int>")
    assert [tuple(r) for r in near_dedup.similar_signatures(df, 25, 0.56).collect()] == [(1, 2, 14)]
    for threshold in (0.0, 1.5):
        with pytest.raises(ValueError, match="threshold"):
            near_dedup.similar_signatures(df, 25, threshold)


def test_classes_count_every_link(spark):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = rng.sample(words, 60)
        for k in range(5):
            near = list(base)
            near[rng.randrange(60)] = f"x{k}"
            texts += [" ".join(near)] * rng.randrange(1, 4)
    rows = list(enumerate(texts))
    # Ids 0 and 1 have a second text each, like another's; 2 repeats; the last have no words.
    rows += [(0, texts[-1]), (1, texts[20] + " y"), (2, texts[2]), (900, None), (901, " - "), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sigs = sorted({(r.doc_id, tuple(r.sig)) for r in near_dedup.signatures(docs).collect()})
    linked = [(i, j) for (i, (_, a)), (j, (_, b)) in itertools.combinations(enumerate(sigs), 2) if sum(map(int.__eq__, a, b)) / 96 >= 0.6]
    root = groups(linked, range(len(sigs)))
    want = Counter((sigs[i][0], min(sigs[j][0] for j in root if root[j] == root[i]), sum(i in p for p in linked)) for i in range(len(sigs)))
    want += Counter([(900, 900, 0), (901, 901, 0)])
    assert Counter(tuple(r) for r in near_dedup.near_duplicate_classes(docs).collect()) == want
    # More than those of the pairs that stand for them.
    assert len(linked) > near_dedup.near_duplicates(docs).count()
    assert near_dedup.near_duplicate_classes(docs.limit(0)).count() == 0


def test_near_dedup_query_has_a_row_for_each_document(spark):
    got = queries.queries()["op7_near_dedup"](spark, SF)
    ids = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert got.columns == ["doc_id", "class_id", "links"] and sorted(r.doc_id for r in got.collect()) == sorted(ids)


def test_recall_against_jaccard(spark, docs):
    found = near_dedup.near_duplicates(spark.createDataFrame(docs[["doc_id", "text"]])).collect()
    near = jaccard_pairs(dict(zip(docs.doc_id, docs.text)), 0.4)
    together = groups([(r.doc_a, r.doc_b) for r in found], docs.doc_id.tolist())
    close = [p for p, j in near.items() if j >= 0.7]
    assert len(close) > 50 and np.mean([together[a] == together[b] for a, b in close]) > 0.97
    assert all(near.get((r.doc_a, r.doc_b), 0) > 0.4 for r in found)


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(pairs, "doc_a long, doc_b long")).collect()}
    want = groups(pairs, {i for p in pairs for i in p})
    assert got == {i: r for i, r in want.items() if i != r}


# 8


def test_secrets_of_held_out_findings(docs):
    contexts = [t[:400].encode() for t in docs.text[:300]]
    findings, labels = secrets.labelled_findings(contexts, 3000, seed=1)
    net = secrets.train(findings, labels)
    held, truth = secrets.labelled_findings(contexts, 800, seed=2)
    p = net.probability(np.stack([secrets.windows(*f)[0] for f in held]))
    got = net.secret(p, np.array([secrets.digitless(*f) for f in held]))
    assert np.mean(got[truth]) > 0.95 and np.mean(~got[~truth]) > 0.95
    real = hit = 0
    for t in docs.text:
        raw = t.encode()
        for s, e in secrets.candidates(raw):
            if raw[max(0, s - 9) : s].lower().endswith((b'token = "', b"password=")):
                real += 1
                hit += bool(net.secret(net.probability(secrets.windows(raw, s, e)).max(), secrets.digitless(raw, s, e)))
    assert real > 5 and hit == real


def test_network_against_loops():
    rng = np.random.default_rng(4)
    findings, labels = secrets.labelled_findings([], 40, seed=3)
    net = secrets.train(findings, labels, epochs=1)
    x = np.stack([secrets.windows(*f)[0] for f in findings[:6]])
    places = secrets._LENGTH - secrets.WIDTH + 1
    z = net.forward(x)[0]
    for row, got in zip(x.tolist(), z):
        conv = [[net.offset[f] + sum(net.filters[o][row[t + o]][f] for o in range(secrets.WIDTH)) for f in range(secrets.FILTERS)] for t in range(places)]
        pooled = [max(0.0, max(conv[t][f] for t in range(a, b))) for a, b in net.pools() for f in range(secrets.FILTERS)]
        body = row[secrets.LEFT : secrets.LEFT + secrets.BODY]
        size = sum(v > 0 for v in body) / secrets.BODY
        digits = sum(v == 64 + 40 for v in body) / secrets.BODY / max(size, 1e-6)
        hidden = [max(0.0, net.dense_bias[h] + sum(v * net.dense[k][h] for k, v in enumerate([*pooled, size, digits]))) for h in range(secrets.HIDDEN)]
        assert got == pytest.approx(net.out_bias + sum(v * w for v, w in zip(hidden, net.out)))
    # The gradient of the log loss, by differences.
    y = labels[:6].astype(float)
    loss = lambda: float(np.mean(np.logaddexp(0, net.forward(x)[0]) - y * net.forward(x)[0]))
    grads = secrets.gradients(net, x, y)
    for name in ("filters", "offset", "dense", "dense_bias", "out"):
        weights = getattr(net, name)
        for at in rng.choice(np.flatnonzero(grads[name].ravel()), 5):
            i = np.unravel_index(at, weights.shape)
            was, both = weights[i], []
            for step in (1e-6, -1e-6):
                weights[i] = was + step
                both.append(loss())
            weights[i] = was
            assert (both[0] - both[1]) / 2e-6 == pytest.approx(grads[name][i], rel=1e-3, abs=1e-7), name


def test_candidates_without_digits():
    value = "wJalrXUtnFEMIKMDENGbPxRfiCYEXAMPLEKEY"
    text = f"the aws value {value} and getUserName or Donaudampfschifffahrtsgesellschaft of the house".encode()
    found = [text[s:e].decode() for s, e in secrets.candidates(text)]
    assert found == [value, "getUserName", "Donaudampfschifffahrtsgesellschaft"]


def test_digitless_secrets_of_held_out_findings(docs):
    contexts = [t[:400].encode() for t in docs.text[:300]]
    net = secrets.train(*secrets.labelled_findings(contexts, seed=1))
    rng = random.Random(2)
    letters = "".join(chr(c) for c in (*range(65, 91), *range(97, 123)))
    real = [f"the value {''.join(rng.choice(letters) for _ in range(40))} is".encode() for _ in range(60)]
    words = [w for t in docs.text[:200] for w in t.split() if w.isascii() and w.isalpha() and w.islower() and len(w) > 3]
    camel = [f"the value {rng.choice(words)}{''.join(rng.choice(words).title() for _ in range(3))} is".encode() for _ in range(60)]

    def p(texts):
        spans = [secrets.candidates(t) for t in texts]
        return np.array([net.probability(secrets.windows(t, *s[0])).max() if s else 0.0 for t, s in zip(texts, spans)])

    # Recall is held first: names of four made-up words in a row are the nearest look-alikes.
    assert np.mean(net.secret(p(real), True)) > 0.95 and np.mean(net.secret(p(camel), True)) < 0.25


def test_windows_cover_long_candidates():
    text = b"key " + bytes(range(48, 58)) * 30 + b" end"
    w = secrets.windows(text, 4, 304)
    assert len(w) == 1 + math.ceil((300 - secrets.BODY) / secrets._STRIDE) and (w[:, secrets.LEFT : secrets.LEFT + secrets.BODY] > 0).all()
    assert secrets.candidates(b"no digits here") == [] and len(secrets.candidates(b'pwd: "abc d" x1234567y')) == 1


# 9, 10


def test_equal_hashes_of_different_texts_stay_apart(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (4, "b"), (5, None), (6, None)], "doc_id long, text string")
    kept = exact_dedup.exact_dedup(df, hash_of=F.lit(b"same"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6]


def test_mixing_follows_highest_quotients(spark):
    rows = [(i, "w " * 50, f"s{0 if i < 600 else i % 4}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"s0": 1.0, "s1": 5.0, "s2": 2.0, "s3": 0.0}
    plan = mixing.mixing_plan(df, weights, budget=0.3, block_tokens=500, docs_per_shard=400).toPandas()
    supply = mixing.mixing_plan(df, budget=1.0, block_tokens=500, docs_per_shard=400).toPandas()
    for shard, part in supply.groupby("shard"):
        left = part.groupby("source").block.nunique().to_dict()
        seats, quota = max(1, math.floor(sum(left.values()) * 0.3)), Counter()
        for _ in range(seats):
            open_ = [s for s in sorted(left) if weights[s] > 0 and quota[s] < left[s]]
            if open_:
                quota[max(open_, key=lambda s: weights[s] / (2 * quota[s] + 1))] += 1
        got = plan[plan.shard == shard].groupby("source").block.nunique().to_dict()
        assert got == {s: q for s, q in quota.items() if q}
    whole = supply.merge(plan[["shard", "source", "block"]].drop_duplicates(), on=["shard", "source", "block"])
    assert sorted(whole.doc_id) == sorted(plan.doc_id)


# The pipeline


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.toPandas()
    model = language_id.train(language_id.labelled_sample(docs))
    rows = rows[language_id.judge(model, pa.array(rows.text), language_id.CONFIDENCE, language_id.COVERAGE).keep]
    rows = rows.sort_values("doc_id").drop_duplicates("text")
    sigs = {r.doc_id: np.array(r.sig) for r in near_dedup.signatures(spark.createDataFrame(rows)).collect()}
    need = math.ceil(near_dedup.THRESHOLD * near_dedup.COORDINATES)
    near = [(a, b) for a, b in itertools.combinations(sorted(sigs), 2) if (sigs[a] == sigs[b]).sum() >= need]
    root = groups(near, rows.doc_id.tolist())
    rows = rows[[root[i] == i for i in rows.doc_id]]
    con = duckdb.connect()
    con.register("documents", rows)
    mixed = {r[0] for r in con.sql(f"SELECT doc_id FROM ({mixing.OP10_SQL})").fetchall()}
    want = {r.doc_id: len(r.text.split()) for r in rows.itertuples() if r.doc_id in mixed and r.text.split()}
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == want
    assert got.groupby(["shard", "bin"]).n_tokens.sum().max() <= packing.CAPACITY
