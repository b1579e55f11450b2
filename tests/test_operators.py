"""Chunking, deduplication, records, splits, formats and scores."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import chunk, dedup, formats, records, score, split


def test_chunk_parameters_are_checked():
    for size, overlap in ((100, 100), (100, 200), (0, 0), (10, -1)):
        with pytest.raises(ValueError):
            chunk.check_parameters(size, overlap)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_character_chunks_are_bounded_and_keep_words(text, size, overlap):
    chunks = chunk.split_recursively(text, size, overlap)
    assert all(c.strip() and len(c) <= size for c in chunks)
    if overlap == 0 and all(len(w) < size for w in text.split()):
        assert " ".join(chunks).split() == text.split()


def plain_semantic(text, size, overlap):
    """The definition, one step after another."""
    import re

    pieces = []
    for p in (p.strip() for p in re.split(chunk.PARAGRAPH, text)):
        if p:
            pieces += [p] if len(p) <= size else [s.strip() for s in re.split(r"(?<=[?!.])\s+(?=[À-ɏA-Z])", p) if s.strip()]
    out, now = [], ""
    for p in pieces:
        joined = now + "\n\n" + p if now else p
        if len(joined) <= size:
            now = joined
        else:
            out += [now] if now else []
            now = p
            if len(p) > size:
                out += chunk.split_recursively(p, size, overlap)
                now = ""
    out += [now] if now else []
    return [c if i == 0 or overlap == 0 else out[i - 1][-overlap:] + " " + c for i, c in enumerate(out)]


@pytest.mark.parametrize("size, overlap", [(210, 20), (480, 50), (120, 0)])
def test_semantic_chunks_follow_the_definition(spark, size, overlap):
    rng = random.Random(size)
    word = lambda: rng.choice(["alpha", "Beta", "gamma.", "Éta", "delta!", "x" * 30])
    texts = [" ".join(word() if rng.random() > 0.05 else "\n\n" for _ in range(rng.randint(0, 300))) for _ in range(30)] + [None, "", "  \n "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.c for r in df.select("doc_id", chunk.semantic_chunks(F.col("text"), size, overlap).alias("c")).collect()}
    for i, t in enumerate(texts):
        if t is None or not t.strip():
            assert got[i] is None
        else:
            assert got[i] == plain_semantic(t, size, overlap)


def sequential(rows, threshold=0.85):
    """First come, first served, one record after another."""
    grams = lambda t: (lambda s: {s} if len(s) < 3 else {s[i : i + 3] for i in range(len(s) - 2)})(t.lower().strip())
    j = lambda a, b: len(a & b) / len(a | b)
    kept, seen = [], set()
    for i, inst, out in rows:
        if (inst, out) in seen:
            continue
        seen.add((inst, out))
        a, b = grams(inst), grams(out)
        near = any(j(a, c) >= 2 * threshold - 1 and j(b, d) >= 2 * threshold - 1 and (j(a, c) + j(b, d)) / 2 >= threshold for _, c, d in kept)
        if not near:
            kept.append((i, a, b))
    return {i for i, _, _ in kept}


def test_nulls_are_no_texts_to_exact_dedup(spark):
    rows = [(1, None, "a"), (2, "a", None), (3, None, "a"), (4, None, None), (5, "null", "a"), (6, "a", "b"), (7, "a", "b")]
    df = spark.createDataFrame(rows, "rec_id long, instruction string, output string")
    assert sorted(r.rec_id for r in dedup.exact(df).collect()) == [1, 2, 4, 5, 6]


@pytest.mark.parametrize("partitions", [1, 7])
def test_near_dedup_is_first_come_first_served(spark, monkeypatch, partitions):
    monkeypatch.setattr(dedup, "BLOCK", 16)
    rng = random.Random(3)
    rows = []
    for i in range(120):
        if rows and rng.random() < 0.6:
            _, inst, out = rng.choice(rows)
            letters = list(out)
            for _ in range(rng.randint(0, 6)):
                letters[rng.randrange(len(letters))] = rng.choice("abcdefgh ")
            rows.append((i, inst if rng.random() < 0.8 else inst + " more", "".join(letters)))
        else:
            rows.append((i, rng.choice(["a", "Explain this", "Tell me about it"]), "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 160)))))
    df = spark.createDataFrame(rows, "rec_id long, instruction string, output string").withColumn("input", F.lit("")).repartition(partitions)
    assert {r.rec_id for r in dedup.deduplicate(df).collect()} == sequential(rows)


def varied(rng, n):
    """Records of which many are near an earlier one, and some of these near one that is dropped."""
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.7:
            _, inst, out = rng.choice(rows)
            letters = list(out)
            for _ in range(rng.randint(0, 8)):
                letters[rng.randrange(len(letters))] = rng.choice("abcdefgh ")
            rows.append((i * 3 + 1, rng.choice([inst, inst, inst + "!", f"own {i}"]), "".join(letters)))
        else:
            rows.append((i * 3 + 1, rng.choice(["a", "", "Explain this", "Tell me about it"]), "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 160)))))
    return rows


@pytest.mark.parametrize("rows, trigrams, parted, often", [(50, 10**6, 512, 1 / 1024), (10**6, 3_000, 0, 1 / 4), (150, 10**6, 512, 0)])
def test_near_dedup_in_batches_is_first_come_first_served(spark, monkeypatch, rows, trigrams, parted, often):
    for name, value in {"BLOCK": 16, "STRIP": 4, "ROWS": rows, "TRIGRAMS": trigrams, "PARTED": parted, "OFTEN": often, "WIDTH": 100}.items():
        monkeypatch.setattr(dedup, name, value)
    made = varied(random.Random(rows), 200)
    df = spark.createDataFrame(made, "rec_id long, instruction string, output string").repartition(3)
    assert {r.rec_id for r in dedup.deduplicate(df).collect()} == sequential(made)
    assert dedup.deduplicate(df.limit(0)).collect() == []


def test_disk_of_near_dedup_grows_with_the_records_and_not_with_their_pairs(spark):
    from pathlib import Path

    def stored(n):
        size = lambda: sum(p.stat().st_size for p in Path(spark.conf.get("spark.checkpoint.dir")).rglob("*") if p.is_file())
        before, rng = size(), random.Random(n)
        text = [rng.choice("abcdefgh ") for _ in range(200)]
        rows = [(i, "a", "".join(text[:k] + ["x"] + text[k + 1 :])) for i in range(n) for k in [rng.randrange(200)]]
        assert dedup.deduplicate(spark.createDataFrame(rows, "rec_id long, instruction string, output string")).count() == 1
        return size() - before

    small = stored(300)
    assert stored(1200) < 5 * small


def test_gates_of_records(spark):
    df = spark.createDataFrame([("a", " "), ("b", "x"), (None, "y")], "instruction string, output string").withColumn("n", F.lit(0)).withColumn("e", F.array())
    ok = lambda f: [r.o for r in df.select(records.has_required(df, f).alias("o")).collect()]
    assert ok(["instruction", "output"]) == [False, True, False]
    assert ok(["n"]) == [True] * 3 and ok(["e"]) == [False] * 3 and ok(["absent"]) == [False] * 3
    names = ["a-b_c 1.txt", "é.pdf", "../x", "a/b", "a;b", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(records.safe_name(F.col("n")).alias("o")).collect()
    assert [r.o for r in got] == [True, True, False, False, False, False]


def test_outputs_must_be_longer(spark):
    df = spark.createDataFrame([("x" * 100,), ("x" * 101,), (None,)], "generation string")
    assert [len(r.output) for r in records.rename_outputs(df).collect()] == [101]


def test_checkpoint_leaves_the_rest(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "prompt string")
    done = records.finished_hashes(df.filter("prompt = 'b'"))
    assert sorted(r.prompt for r in records.remaining(df, done).collect()) == ["a", "c"]


@pytest.mark.parametrize("n, models", [(10, 3), (2, 3), (9, 1)])
def test_ensemble_split(spark, n, models):
    names = [f"m{i}" for i in range(models)]
    got = {r.id: r.part for r in split.ensemble_split(spark.range(n), names, ["id"]).collect()}
    size = max(1, n // models)
    assert got == {i: min(i // size, models - 1) for i in range(n)}
    with pytest.raises(ValueError):
        split.ensemble_split(spark.range(n), [" ", ""], ["id"])


@pytest.fixture()
def wide(spark):
    """Rows wide enough that adaptive execution joins partitions otherwise for the rows than for their ids alone."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    text = F.concat_ws(" ", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 512) for k in range(24)])
    yield spark.range(40_000).select(((F.col("id") * 7919) % 40_000).alias("id"), text.alias("text"), F.lit("x").alias("__mr_at"))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbering_of_wide_rows_loses_none(spark, wide):
    right = (F.col("id") == F.col("row_no")).alias("right")
    got = split.numbered(wide, ["id"]).groupBy(right).agg(F.count(F.lit(1)), F.min(F.length("text"))).collect()
    assert [tuple(r) for r in got] == [(True, 40_000, 24 * 129 - 1)]
    parts = split.ensemble_split(wide, ["a", "b", "c"], ["id"])
    got = {r.part: (r.n, r.least, r.most) for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("most"), F.min(F.length("text"))).collect()}
    assert got == {0: (13_333, 0, 13_332), 1: (13_333, 13_333, 26_665), 2: (13_334, 26_666, 39_999)}
    assert parts.columns == [*wide.columns, "part", "model"]


def test_formats(spark):
    df = spark.createDataFrame([(1, "do", "this", "done"), (2, "do", "", "done"), (3, "do", None, "done")], "rec_id long, instruction string, input string, output string")
    rows = {f: [r.asDict(True) for r in formats.convert(df, f, ["rec_id"]).orderBy("rec_id").collect()] for f in formats.FORMATS}
    assert rows["alpaca"][2]["input"] is None
    assert rows["sharegpt"][0]["conversations"] == [{"from": "human", "value": "do\n\nContext: this"}, {"from": "gpt", "value": "done"}]
    assert [r["messages"][0]["content"] for r in rows["chatml"]] == ["do\n\nthis", "do", "do"]
    assert [m["role"] for m in rows["openai"][0]["messages"]] == ["system", "user", "assistant"]
    with pytest.raises(ValueError):
        formats.convert(df, "xml")
    for f in formats.FORMATS:
        turns = formats.preview(formats.convert(df, f, ["rec_id"]), 2).collect()
        assert len(turns) == 2 and turns[0].turns[-1].role == "assistant"


@pytest.mark.parametrize("n, length, grade", [(200, 350, "SUPER"), (60, 250, "GOOD"), (25, 150, "NORMAL"), (1, 1, "BAD"), (0, 0, "DISASTER")])
def test_score(spark, n, length, grade):
    df = spark.range(n).select(F.col("id").cast("string").alias("instruction"), F.repeat(F.lit("x"), length).alias("output"))
    got = score.score(df).first()
    assert (got.grade, got.record_count, got.avg_output_length) == (grade, n, float(length if n else 0))


def test_estimate():
    assert score.estimate("m", 2000, "balanced", True) == ("Free (local GPU)", "~20 min")
    assert score.estimate("gpt-3.5-turbo, other", 1000, "fast", False) == ("~$0.80", "~8 min")
    assert score.estimate("unknown", 100, "odd", False) == ("~$1.28", "~1 min")
