"""Sources, sinks, whole jobs, configuration and streaming."""

from __future__ import annotations

import json
import shutil
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.plans import config, distil, export, generate, report, sanitize
from millrace.plans.sanitize import Gates, Sanitizer, sanitize_lines, sanitize_records
from millrace.operators.score import counters
from millrace.sources import files, jsonl
from millrace.streaming import incremental


def lines_of(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


def write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_lines_are_numbered_across_splits_and_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for f in ("a", "b"):
        (tmp_path / "in" / f).write_text("".join(f"{f}{i}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = {r.line_no: r.line for r in jsonl.read_lines(spark, str(tmp_path / "in")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i + 1: f"{'a' if i < 500 else 'b'}{i % 500}" for i in range(1000)}


def test_raw_records(spark, tmp_path):
    rows = [
        {"instruction": "i1", "output": "o1"}, "no json", "", {"instruction": "i2", "output": "", "generation": "g2"}, {"instruction": "", "output": "o"},
        {"instruction": "i3", "output": "o3", "input": None}, [1, 2], "5", "null", {"instruction": "i4", "output": 0, "generation": []}, {"instruction": "i5", "output": 7, "input": "x"}, {"instruction": "late", "output": "late"},
    ]
    got = jsonl.parse_records(jsonl.read_lines(spark, write(tmp_path / "r.jsonl", rows)), 11).orderBy("rec_id").collect()
    assert [tuple(r) for r in got] == [(1, "i1", "", "o1"), (4, "i2", "", "g2"), (6, "i3", None, "o3"), (11, "i5", "x", "7")]


@pytest.mark.parametrize("name, key", [("alpaca", "instruction"), ("sharegpt", "conversations"), ("chatml", "messages"), ("openai", "messages")])
def test_export(spark, tmp_path, name, key):
    rows = [{"instruction": f"question {i} {'abc' * i}", "output": f"answer {i} {'xyz' * i} ü"} for i in range(9)] + [{"instruction": "question 0 ", "output": "answer 0  ü"}]
    n = export.export_dataset(spark, write(tmp_path / "r.jsonl", rows), str(tmp_path / "out"), name)
    out = [json.loads(v) for v in lines_of(spark, tmp_path / "out")]
    assert n == len(out) <= 9 and all(key in r for r in out)
    assert export.export_alpaca(spark, str(tmp_path / "r.jsonl"), str(tmp_path / "all")) == 10
    with pytest.raises(ValueError):
        export.export_dataset(spark, "x", "y", "xml")


def test_export_of_nothing(spark, tmp_path):
    assert export.export_dataset(spark, write(tmp_path / "r.jsonl", ["", "x"]), str(tmp_path / "out")) == 0


SMALL = Sanitizer(gates=Gates(min_chars=10, min_words=2), require_fields=("instruction", "output"))
GOOD = "What is the capital of the country of France"


def test_sanitise_lines(spark):
    rows = [
        {"instruction": GOOD, "output": "Paris, write to me@corp.example <b>now</b>"}, {"instruction": GOOD.upper(), "output": "Paris,  write to me@corp.example now"},
        {"instruction": "x", "output": "y"}, {"instruction": "", "output": "no instruction here at all"}, "broken", ["a"], " ", {"instruction": GOOD, "output": "Berlin is another one", "meta": {"n": 5, "who": ["call 123-45-6789", None]}},
    ]
    lines = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)]
    got = sanitize_lines(spark.createDataFrame(lines, "line_no long, line string"), SMALL)
    status = {r.rec_id: r.status for r in got.collect()}
    assert status == {0: "kept", 1: "duplicate", 2: "quality", 3: "require", 4: "quality", 5: "quality", 7: "kept"}
    assert counters(got).first().asDict() == dict(total=7, kept=2, filtered_quality=3, filtered_require=1, deduplicated=1, pii_redacted=2)
    assert json.loads(got.filter("rec_id = 7").first().value)["meta"] == {"n": 5, "who": ["call [PII_SSN]", None]}


def test_sanitise_nested_turns(spark):
    line = json.dumps(dict(messages=[dict(role="user", content=GOOD)]))
    lines = spark.createDataFrame([(1, line)], "line_no long, line string")
    assert sanitize_lines(lines, Sanitizer(gates=SMALL.gates)).first().reason == "empty text"
    assert sanitize_lines(lines, Sanitizer(gates=SMALL.gates, nested_text=True)).first().status == "kept"


def test_both_sanitisers_agree(spark):
    rows = [(i, f"{GOOD} {i % 5}", "", t) for i, t in enumerate(["Ａ wide text, of é words", "digits ١٢٣-٤٥-٦٧٨٩ and 123-45-6789 here", "mail a@b.co or 10.1.2.3", None, "", "x\x07y <i>z</i> and words"] * 3)]
    df = spark.createDataFrame(rows, "rec_id long, instruction string, input string, output string")
    a = {r.rec_id: (r.output, r.status, r.pii) for r in sanitize_records(df, SMALL).collect()}
    lines = jsonl.as_json(df, "rec_id").select(F.col("rec_id").alias("line_no"), F.col("value").alias("line"))
    for r in sanitize_lines(lines, SMALL).collect():
        assert r.status == a[r.rec_id][1]
        if r.value:
            assert (json.loads(r.value)["output"], r.pii) == (a[r.rec_id][0], a[r.rec_id][2])


def test_lines_are_sanitised_in_pieces_of_bounded_size(monkeypatch):
    monkeypatch.setattr(sanitize, "SLICE_BYTES", 1_000)
    lines = ["x" * n for n in (10, 3_000, 400, 400, 400, 0, 900)] + [None] + ["y" * 90] * 100
    batch = pa.record_batch([pa.array(range(len(lines)), pa.int64()), pa.array(lines)], ["line_no", "line"])
    pieces = [p.column(1).to_pylist() for p in sanitize._slices(batch)]
    assert [x for p in pieces for x in p] == lines
    assert all(sum(len(x or "") for x in p[1:]) < 1_000 for p in pieces) and len(pieces) > 10
    assert not list(sanitize._slices(batch.slice(0, 0)))


def test_gates_see_whole_texts(spark):
    whole = " ".join(f"word{i}" for i in range(2_000))  # 16,890 characters
    outputs = [whole, whole + " Ж" * 1_500, whole[:9_000] + " same" * 2_000, whole * 2]
    df = spark.createDataFrame([(i, GOOD, "", o) for i, o in enumerate(outputs)], "rec_id long, instruction string, input string, output string")
    settings = Sanitizer(gates=Gates(min_ascii_ratio=0.95, min_unique_ratio=0.5))
    lines = jsonl.as_json(df, "rec_id").select(F.col("rec_id").alias("line_no"), F.col("value").alias("line"))
    for got in (sanitize_records(df, settings), sanitize_lines(lines, settings)):
        assert {r.rec_id: r.reason for r in got.collect()} == {0: None, 1: "low ASCII ratio", 2: "low unique-word ratio", 3: "too long"}


def test_replace_keeps_the_original_where_nothing_is_left(spark, tmp_path):
    path = tmp_path / "d"
    jsonl.write_jsonl(spark.createDataFrame([(1, "a")], "rec_id long, v string"), str(path))
    assert not jsonl.replace_lines(spark.createDataFrame([], "rec_id long, value string"), str(path))
    assert lines_of(spark, path) == ['{"v":"a"}']
    assert jsonl.replace_lines(spark.createDataFrame([(2, "y"), (1, "x")], "rec_id long, value string"), str(path))
    assert lines_of(spark, path) == ["x", "y"] and [p.name for p in tmp_path.iterdir()] == ["d"]


def test_replace_keeps_the_original_where_renaming_fails(spark, tmp_path, monkeypatch):
    path = tmp_path / "d"
    jsonl.write_jsonl(spark.createDataFrame([(1, "a")], "rec_id long, v string"), str(path))
    new = spark.createDataFrame([(1, "x")], "rec_id long, value string")
    rename, calls = jsonl._rename, []
    monkeypatch.setattr(jsonl, "_rename", lambda fs, a, b: bool(calls.append(b.toString())) if a.toString().endswith(".new") else rename(fs, a, b))
    assert not jsonl.replace_lines(new, str(path)) and calls == [str(path)]
    assert lines_of(spark, path) == ['{"v":"a"}'] and [p.name for p in tmp_path.iterdir()] == ["d"]
    monkeypatch.setattr(jsonl, "_rename", lambda fs, a, b: False)
    assert not jsonl.replace_lines(new, str(path))
    assert lines_of(spark, path) == ['{"v":"a"}'] and [p.name for p in tmp_path.iterdir()] == ["d"]


class Long(generate.StubModel):
    def answer(self, instructions):
        return [f"{'An answer of many different words about it. ' * 3}{i}" for i in instructions]


def test_whole_job(spark, tmp_path, request):
    folder = f"checkpoint-{uuid.uuid4().hex}"  # must be relative; Spark resolves it where it was started
    request.addfinalizer(lambda: shutil.rmtree(folder, ignore_errors=True))
    docs = spark.createDataFrame([(i, f"Paragraph {i} about {'thing ' * (i % 7 + 1)}.\n\nSecond part {i * 31}.") for i in range(40)], "doc_id long, text string")
    settings = config.GenerationConfig("m1, m2", dataset_size=100, use_semantic_chunking=True, enable_dedup=False, sanitize_dataset=True, checkpoint_dir=folder, quality_mode="fast")
    seen = []
    distil.run(docs, lambda name: Long(), settings, str(tmp_path / "out"), seen.append)
    out = [json.loads(v) for v in lines_of(spark, tmp_path / "out")]
    assert len(out) == 40 and "Paragraph 0" in out[0]["instruction"] and seen[-1] == 100
    with pytest.raises(ValueError):  # all prompts are in the checkpoint
        distil.run(docs, lambda name: Long(), settings, str(tmp_path / "out2"))


def test_generate_carries_columns_and_batches(spark):
    calls = generate.EndpointModel(lambda prompts: [p[-5:] if p else None for p in prompts])
    df = spark.createDataFrame([(i, f"instruction {i}") for i in range(10)], "id long, instruction string")
    got = generate.generate(df, calls, 2, batch_size=3).orderBy("id").collect()
    assert [r.id for r in got] == list(range(10)) and got[3].generation == "ion 3"[-5:]


@pytest.mark.parametrize(
    "wrong",
    [
        {"teacher_model": ""}, {"teacher_model": ","}, {"teacher_model": "../m"}, {"teacher_model": "a, /etc/m"}, {"teacher_model": "m;rm"}, {"teacher_model": "x" * 256}, {"dataset_size": 99},
        {"dataset_size": 50001}, {"temperature": 2.1}, {"batch_size": 0}, {"lora_rank": 7}, {"max_new_tokens": 127}, {"quality_mode": "slow"}, {"output_format": "xml"}, {"api_key": "a\nb"},
        {"api_key": "x" * 513}, {"checkpoint_dir": "/abs"}, {"checkpoint_dir": "a/../b"}, {"checkpoint_dir": "C:x"}, {"hf_repo": "noslash"}, {"hf_repo": "a/../b"}, {"publish_dataset": True}, {"base_model": " "},
    ],
)
def test_wrong_settings(wrong):
    with pytest.raises(ValueError):
        config.GenerationConfig(**({"teacher_model": "m"} | wrong))


def test_secrets_are_hidden():
    c = config.GenerationConfig("m", api_key=" sk-1234 ", hf_token="  ")
    assert c.api_key == "sk-1234" and c.hf_token is None
    assert "sk-1234" not in f"{c!r}{c}" and c.safe_dict()["api_key"] == config.HIDDEN


def test_input_errors():
    assert config.input_errors([("a.txt", 5)], {"teacher_model": "m"}) == []
    got = config.input_errors([("../a", 60 << 20)], {"teacher_model": "", "use_vllm": False, "publish_dataset": True})
    assert len(got) == 6
    assert config.check_publication("a/b", None, {"HF_TOKEN": "t"}) == "t"
    for repo, token in (("a/b", None), ("ab", "t"), ("", "t")):
        with pytest.raises(ValueError):
            config.check_publication(repo, token)


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first é", encoding="utf-8")
    (tmp_path / "b b.txt").write_text("second", encoding="utf-8")
    (tmp_path / "bad;name.txt").write_text("x")
    (tmp_path / "c.pdf").write_bytes(b"%PDF x")
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe\xfa")
    got = {r.name: r.text for r in files.read_uploads(spark, str(tmp_path), lambda b: b.decode().upper()).collect()}
    assert got == {"a.txt": "first é", "b b.txt": "second", "c.pdf": "%PDF X"}
    plain = files.read_uploads(spark, str(tmp_path))
    assert files.merge_uploads(plain).first().text == "first é\n\nsecond\n\n"
    assert files.read_source(spark, str(tmp_path / "a.txt")).first().text == "first é"
    in_order = files.read_source(spark, str(tmp_path / "*.txt")).select("doc_id", "path").orderBy("doc_id").collect()
    assert [r.doc_id for r in in_order] == [0, 1, 2, 3] and [r.path for r in in_order] == sorted(r.path for r in in_order)
    with pytest.raises(Exception, match="too large"):
        files.read_source(spark, str(tmp_path / "a.txt"), max_bytes=3).collect()
    assert files.from_rows(spark, [{"a": 1}, {"b": "x"}]).count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = lambda o: {"instruction": GOOD, "input": "", "output": o}
    write(tmp_path / "in" / "1.json", [row("Paris is the one and not a@b.co"), row("Paris is the one and not a@b.co")])
    run = lambda: incremental.start(
        incremental.sanitized_stream(spark, str(tmp_path / "in"), SMALL), str(tmp_path / "t"), str(tmp_path / "cp")
    ).awaitTermination()
    run()
    write(tmp_path / "in" / "2.json", [row("Paris is  the one and not A@b.co"), row("Berlin is another answer")])
    run()
    got = sorted(r.output for r in spark.read.parquet(str(tmp_path / "t")).collect())
    assert got == ["Berlin is another answer", "Paris is the one and not [PII_EMAIL]"]


def test_score_of_a_file(spark, tmp_path):
    assert report.score_dataset(spark, str(tmp_path / "absent")).first().grade == "DISASTER"
    empty = report.score_dataset(spark, write(tmp_path / "e.jsonl", ["", "broken", [1]])).first()
    assert (empty.grade, empty.record_count, empty.unique_ratio) == ("DISASTER", 0, 0.0)
    rows = [{"instruction": f"q{i % 15}", "output": "x" * 150} for i in range(20)] + ["broken", {"messages": []}]
    got = report.score_dataset(spark, write(tmp_path / "s.jsonl", rows)).first()
    assert (got.grade, got.record_count) == ("NORMAL", 21) and got.unique_ratio == pytest.approx(16 / 21)
