"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, in every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import common, exact_dedup, language_id, mixing, near_dedup, packing, pii, quality, secrets, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = {
    "en": "the house and the tree were standing by the river with other things that people have",
    "fr": "la maison et les arbres sont avec une rivière où les gens ont des choses qui étaient",
    "de": "das Haus und der Baum stehen nicht über einen Fluss mit Dingen die Menschen für sich haben",
}


def text_of(lang: str, i: int) -> str:
    words = PROSE[lang].split()
    return " ".join(words[(i * 7 + k * (i % 3 + 1)) % len(words)] + ("x" * (k % 2) if k == i % 11 else "") for k in range(30)) + f" {lang}{'abcdefghij'[i % 10]}"


def plain_rows():
    return [(i, text_of(lang, i), lang, f"s{i % 3}", 100) for i, lang in enumerate(["en", "fr", "de"] * 20)]


LONG = " ".join(text_of("en", i) for i in range(3000))
AWKWARD = [
    (None, "the tree and the house by the river", "en", "s0", 5),
    (None, None, None, None, None),
    (900, None, "en", "s0", None),
    (901, "", None, None, 0),
    (902, " \n\t ", "fr", None, 3),
    (903, "1234 5678 !!!", "en", "s1", 13),
    (904, LONG, "en", "s1", len(LONG)),
    (905, "x" * 200_000, "de", "s2", 200_000),
    (906, "a\x00b ퟿ 𝔘nicode ☃ test", None, "s1", 9),
    *[(907, "the house and the river with the people", "en", "s1", 1)] * 3,
    (908, "the house and the river with the people", "en", "s1", 1),
]
CLASH = ("score", "keep", "key", "n", "term", "shard", "block", "sig", "rank", "toxic", "quality", "id", "item", "probability", "language", "n_tokens", "row", "hash", "__mr_extra", "__mr_hash", "__MR_RANK", "__mr_again", "__mr_others", "__mr_gone", "__mr_id", "__mr_source")


def table(spark, rows, clash=False):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASH if clash else ():
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (1, None, None), (2, 1, 0), (904, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def op1(docs, labels):
    return language_id.identify(docs, language_id.train(language_id.labelled_sample(docs), epochs=1))


def op4(docs, labels):
    return toxicity.toxicity(docs, toxicity.fit(toxicity.labelled_sample(docs, labels), toxicity.character_counts(docs)))


def op6(docs, labels):
    return quality.classify(docs, quality.fit(quality.labelled_sample(docs, labels)))


@pytest.fixture(scope="module")
def net(spark):
    docs = spark.createDataFrame(plain_rows(), SCHEMA)
    return secrets.train(*secrets.labelled_findings(secrets.context_sample(docs), 600), epochs=2)


ROWWISE = {"op1": op1, "op2": lambda d, _: pii.sanitise(d), "op4": op4, "op6": op6}
SETWISE = {
    "op3": lambda d, _: packing.pack(d),
    "op7": lambda d, _: near_dedup.near_duplicates(d),
    "op9": lambda d, _: exact_dedup.exact_dedup(d),
    "op10": lambda d, _: mixing.mixing_plan(d),
}
ALL = ROWWISE | SETWISE


@pytest.mark.parametrize("name", sorted(ROWWISE))
def test_every_row_has_a_result(spark, labels, name):
    rows = plain_rows() + AWKWARD
    got = ROWWISE[name](table(spark, rows), labels).collect()
    ids = lambda x: sorted((r[0] is None, r[0] or 0) for r in x)
    assert ids(got) == ids(rows)


@pytest.mark.parametrize("name", sorted(ALL))
def test_other_columns_make_no_difference(spark, labels, name):
    rows = plain_rows() + AWKWARD
    plain, clashing = (ALL[name](table(spark, rows, c), labels) for c in (False, True))
    shown = lambda df: sorted(repr([r[c] for c in plain.columns]) for r in df.collect())
    assert shown(plain) == shown(clashing)


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables(spark, labels, name):
    assert ALL[name](table(spark, []), labels).count() == 0
    assert ALL[name](table(spark, []), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ROWWISE))
def test_no_labels(spark, labels, name):
    rows = [(i, t, None, s, n) for i, t, _, s, n in plain_rows()]
    got = ROWWISE[name](table(spark, rows), labels.limit(0)).collect()
    assert len(got) == len(rows)
    if name in ("op1", "op6"):
        assert all(r.keep for r in got)
    if name == "op4":
        assert not any(r.toxic for r in got)


def test_rowwise_defined_results(spark, labels):
    rows = plain_rows() + AWKWARD
    lang = {r.doc_id: r for r in op1(table(spark, rows), labels).collect()}
    for i in (900, 901, 902, 903):
        assert (lang[i].language, lang[i].n_words, lang[i].keep, lang[i].spans) == (None, 0, False, [])
    assert lang[904].n_words == len(LONG.split()) and lang[904].keep
    clean = {r.doc_id: r for r in pii.sanitise(table(spark, rows)).collect()}
    assert clean[900].text is None and clean[901].text == "" and clean[904].text == LONG
    good = {r.doc_id: r for r in op6(table(spark, rows), labels).collect()}
    assert [(good[i].score, good[i].keep) for i in (900, 901, 902)] == [(None, False)] * 3
    toxic = {r.doc_id: r for r in op4(table(spark, rows), labels).collect()}
    assert toxic[900].score == toxic[901].score == toxic[902].score


def test_secrets(spark, net):
    rows = plain_rows() + AWKWARD + [(950, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y', None, None, 1)]
    plain, clashing = (secrets.scan(table(spark, rows, c), net) for c in (False, True))
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, clashing.collect()))
    found = {r.doc_id: r for r in plain.collect()}
    assert 900 not in found and 901 not in found
    assert found[950].secret and (found[950].start, found[950].length, found[950].preview) == (11, 40, "04db")
    assert secrets.scan(table(spark, []), net).count() == 0
    twice = secrets.scan(table(spark, rows + rows), net).collect()
    assert sorted(map(repr, twice)) == sorted(2 * list(map(repr, plain.collect())))
    assert secrets.train(*secrets.labelled_findings([], 200), epochs=1) is not None


def test_packing_defined_results(spark):
    rows = plain_rows() + AWKWARD
    got = packing.pack(table(spark, rows)).collect()
    ids = [r.doc_id for r in got]
    assert not {900, 901, 902} & set(ids) and ids.count(907) == 3 and None in ids
    assert sum(r.n_tokens for r in got if r.doc_id == 904) == len(LONG.split())
    ties = packing.pack(table(spark, [(i, "w " * n, None, None, 0) for i, n in ((5, 700), (3, 700), (9, 700), (1, 700), (2, 1348))])).collect()
    assert [r.doc_id for r in sorted(ties, key=lambda r: (r.bin, r.bin_offset))] == [2, 1, 3, 5, 9]


def test_near_dedup_defined_results(spark):
    rows = plain_rows() + AWKWARD
    pairs = {(r.doc_a, r.doc_b) for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert (907, 908) in pairs
    assert not {i for p in pairs for i in p} & {None, 900, 901, 902}
    kept = near_dedup.keep_one_of_each(table(spark, rows, True))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == table(spark, [], True).columns
    assert ids.count(907) == 3 and 908 not in ids and ids.count(None) == 2 and {900, 901, 902} <= set(ids)


def test_exact_dedup_defined_results(spark):
    rows = plain_rows() + AWKWARD + [(None, "", None, None, 0), (5, "the house and the river with the people", None, None, 0)]
    kept = exact_dedup.exact_dedup(table(spark, rows, True))
    assert kept.columns == table(spark, [], True).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 2 and 907 not in ids and 908 not in ids  # 5 is also a plain row
    assert ids.count(901) == 1 and ids.count(None) == 2 and 900 in ids


def test_mixing_defined_results(spark):
    rows = plain_rows() + AWKWARD
    plan = mixing.mixing_plan(table(spark, rows), budget=1.0).collect()
    assert len([r for r in plan if r.doc_id == 907]) == 1  # one unit of three rows
    kept = mixing.mix(table(spark, rows, True), budget=1.0)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r[0]) for r in rows)
    none = mixing.mixing_plan(table(spark, rows), {"s0": 0.0}, default_weight=0.0).count()
    assert none == 0


VECTORS = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)]


def test_topk(spark):
    bad = [(None, [1.0, 2.0, 3.0]), (100, None), (101, []), (102, [1.0]), (103, [1.0, None, 2.0]), (104, [float("nan"), 1.0, 1.0]), (105, [float("inf"), 0.0, 0.0]), (3, [9.0, 9.0, 9.0]), (3, [3.0, 3.0, 1.0])]
    df = spark.createDataFrame(VECTORS + bad, "vec_id long, embedding array<float>")
    got = topk.nearest_neighbours(df, k=4, pivots=5, block=8)
    ids = {r.vec_id for r in got.collect()}
    assert ids == set(range(40))
    clash = topk.nearest_neighbours(df.withColumn("id", F.lit(1)).withColumn("x", F.lit(2)).withColumn("d", F.lit(3)), k=4, pivots=5, block=8)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, clash.collect()))
    assert topk.nearest_neighbours(df.limit(0)).count() == 0
    one = spark.createDataFrame(VECTORS[:1], "vec_id long, embedding array<float>")
    assert topk.nearest_neighbours(one).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(6)], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.neighbor_id) for r in topk.nearest_neighbours(same, k=1).orderBy("vec_id").collect()] == [(0, 1)] + [(i, 0) for i in range(1, 6)]


def test_of_rows_that_repeat_id_and_text_the_least_stays(spark):
    rows = [(1, "a b", "fr", "z", 3), (1, "a b", "en", "z", 4), (1, "a b", "en", "z", 4), (1, "c d", None, None, 1)]
    for order in (rows, rows[::-1]):
        got = sorted(map(tuple, exact_dedup.exact_dedup(table(spark, order)).collect()), key=str)
        assert got == [(1, "a b", "en", "z", 4), (1, "c d", None, None, 1)]


@pytest.mark.parametrize("limit", [10**6, -1])
def test_wide_rows_are_the_same_however_they_are_matched(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    docs = table(spark, plain_rows() + AWKWARD, True)
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    exact, near, mixed = (ids(f(docs)) for f in (exact_dedup.exact_dedup, near_dedup.keep_one_of_each, mixing.mix))
    assert exact.count("907") == 1 and "908" not in exact and exact.count("None") == 2
    assert near.count("907") == 3 and "908" not in near and near.count("None") == 2
    plan = [(r.doc_id, r.source) for r in mixing.mixing_plan(docs).collect()]
    assert mixed == sorted(str(r.doc_id) for r in docs.collect() if (r.doc_id, r.source) in plan)


def test_ids_must_be_integers(spark):
    docs = spark.createDataFrame([("u1", "some text of words"), ("u2", "some text of words")], "doc_id string, text string").withColumns({c: F.lit("x") for c in ("lang", "source")})
    for f in (lambda d: language_id.identify(d, None), pii.sanitise, packing.pack, near_dedup.near_duplicates, lambda d: quality.classify(d, None), lambda d: secrets.scan(d, None), lambda d: toxicity.toxicity(d, None)):
        with pytest.raises(ValueError, match="must hold integers"):
            f(docs)
    with pytest.raises(ValueError, match="must hold integers"):
        topk.nearest_neighbours(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>"))
    assert [r.doc_id for r in exact_dedup.exact_dedup(docs).collect()] == ["u1"]
    assert mixing.mix(docs, budget=1.0).count() == 2


@pytest.mark.parametrize("rows", [[], plain_rows() + AWKWARD], ids=["empty", "awkward"])
@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, rows, name, stage):
    docs = table(spark, rows, clash=True)
    out = stage(spark, docs, "")
    n = out.count()
    if name != "packing":
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and n <= len(rows)
    if not rows:
        assert n == 0
