"""Text functions, redaction and gates, on rows that the tables don't have."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from millrace.functions import pii, text
from millrace.functions.quality import Gates, message, reason
from millrace.plans.sanitize import Sanitizer, gate, json_hash, sanitize_text

CASES = [
    ("https://u@example.com/a, next", "[PII_URL] next", "[PII_URL] next"),
    ("+1-555-555-0101 x", "+1-[PII_PHONE] x", "+1-***-***-0101 x"),
    ("1234567890", "[PII_PHONE]", "***-***-7890"),
    ("4111 1111 1111 1111", "[PII_CARD]", 3 * "****-" + "1111"),
    ("4111111111111111", "[PII_CARD]", 3 * "****-" + "1111"),
    ("123-45-6789", "[PII_SSN]", "***-**-6789"),
    ("+1 192.168.1.1", "[PII_PHONE].168.1.1", "***-***-1192.168.1.1"),
    ("10.0.0.1.", "[PII_IP].", "10.0.***.***."),
    ("a@b.co c@d.org", "[PII_EMAIL] [PII_EMAIL]", "***@b.co ***@d.org"),
    ("john.doe@corp.example WWW.x.y/z", "[PII_EMAIL] [PII_URL]", "j***e@corp.example [PII_URL]"),
    ("nothing here", "nothing here", "nothing here"),
    ("", "", ""),
]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("r")).first().r


def test_redaction_and_masks(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "t string")
    t = F.col("t")
    got = df.select("t", pii.redact_pii(t).alias("r"), pii.redact_pii(t, mask=True).alias("m"), pii.has_pii(t).alias("p")).collect()
    for (raw, redacted, masked), row in zip(CASES, got):
        assert (row.r, row.m, row.p) == (redacted, masked, redacted != raw), raw


@pytest.mark.parametrize("mask", [False, True])
def test_python_rules_are_the_same(mask):
    for raw, redacted, masked in CASES:
        assert sanitize_text(raw, Sanitizer(pii_mask=mask))[0] == (masked if mask else redacted)


@pytest.mark.parametrize(
    "raw, clean",
    [("a\x00b\tc", "a b c"), ("été", "été"), ("<p>Good <i>day</i>!</p>", "Good day !"), ("ﬁne Ⅸ", "fine IX"), (None, None), ("", "")],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, text.clean_text(F.col("t")), raw) == clean


def test_html_tags_become_spaces(spark):
    assert one(spark, text.strip_html(F.col("t")), "<p>Good <i>day</i>!</p>") == " Good  day ! "


GATES = Gates(max_chars=100, min_chars=10, min_ascii_ratio=0.8, min_unique_ratio=0.5, min_words=3)


@pytest.mark.parametrize(
    "raw, why",
    [
        ("", "empty text"), (None, "empty text"), ("short", "too short"), ("word " * 40, "too long"), ("averyveryverylongword", "too few words"),
        ("same same same same same", "low unique-word ratio"), ("Привет мир это русский текст", "low ASCII ratio"), ("a fine sentence of words", None),
    ],
)
def test_gates(spark, raw, why):
    assert one(spark, reason(F.col("t"), GATES), raw) == why
    if raw is not None:
        assert gate({"a": raw}, Sanitizer(gates=GATES)) == why


def test_gate_message(spark):
    assert one(spark, message(F.col("t"), GATES), "short") == "too short (5 < 10 chars)"


def test_record_hash_ignores_case_and_spaces(spark):
    rows = [("Hello  World", "A\tb"), ("hello world", "a b"), ("hello world", None)]
    df = spark.createDataFrame(rows, "instruction string, output string")
    fields = {f: F.col(f) for f in df.columns}
    got = [r.h for r in df.select(text.record_hash(fields).alias("h")).collect()]
    assert got[0] == got[1] != got[2]
    assert got == [json_hash(dict(zip(df.columns, r))) for r in rows]


def test_shingles_and_jaccard(spark):
    s = lambda v: sorted(one(spark, text.shingles(F.col("t")), v))
    assert s("  ABCD ") == ["abc", "bcd"] and s("ab") == ["ab"] and s("") == [""]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r.j for r in df.select(text.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [1 / 3, 0.0]


def test_quality_text_budget(spark):
    df = spark.createDataFrame([("abc", None, "defgh")], "a string, b string, c string")
    columns = [F.col(c) for c in df.columns]
    assert df.select(text.quality_text(columns, 5).alias("t")).first().t == "abc de"
    assert df.select(text.quality_text(columns, 3).alias("t")).first().t == "abc"


def test_sft_text(spark):
    df = spark.createDataFrame([("do", " ", "done"), ("do", "this", "done")], "i string, n string, o string")
    a, b = (r.t for r in df.select(text.sft_text(F.col("i"), F.col("n"), F.col("o")).alias("t")).collect())
    assert a == "### Instruction:\ndo\n\n### Response:\ndone</s>"
    assert b == "### Instruction:\ndo\n\n### Input:\nthis\n\n### Response:\ndone</s>"


def test_nfkc_is_that_of_unicode_and_made_in_the_jvm(spark):
    rows = ["ＡＢＣ ①ﬁ x² é", "Ångström ẛ̣ 각", "½…ĳ x", "plain", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select("t", text.nfkc(F.col("t")).alias("n"))
    assert all(r.n == (None if r.t is None else unicodedata.normalize("NFKC", r.t)) for r in df.collect())
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")
