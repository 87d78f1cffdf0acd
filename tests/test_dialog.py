import random

import pytest
from pyspark.sql import functions as F

from vitaespark.functions import dialog as D
from vitaespark.operators import dialog
from vitaespark.plans import jobs


@pytest.mark.parametrize("said, lang, expected", [
    (" 继续 ", "zh", True), ("下一题吧", "zh", True), ("continue", "zh", False), ("Next!", "en", True),
    ("next question", "en", False), ("go on", "en", True), ("继续继续继续继续继续继续", "zh", False), ("", "en", False),
])
def test_skip(spark, said, lang, expected):
    df = spark.createDataFrame([(said, lang)], "s string, l string")
    assert df.select(D.is_skip(F.col("s"), F.col("l"))).first()[0] is expected


def talk(spark, conversations):
    rows = [(c, 2 * i, "user", "x", s) for c, skips in enumerate(conversations) for i, s in enumerate(skips)]
    rows += [(c, 2 * i + 1, "assistant", "y", True) for c, skips in enumerate(conversations) for i in range(len(skips))]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, skip boolean")


def plain_phases(skips):
    most, phase, rounds, asked, out = [1, 5, 3, 2], 0, 0, 0, []
    for skip in skips:
        if skip and asked > 0 and phase < 3:
            phase, rounds = phase + 1, 0
        if rounds >= most[phase] and phase < 3:
            phase, rounds = phase + 1, 0
        out.append(phase)
        rounds, asked = rounds + 1, asked + 1
    return out


def phases_of(spark, conversations):
    rows = dialog.phases(talk(spark, conversations), F.col("skip")).orderBy("conv_id", "turn").collect()
    return [[r.phase for r in rows if r.conv_id == c] for c in range(len(conversations))]


def test_phases(spark):
    no = [False] * 12
    assert phases_of(spark, [no])[0] == [0, 1, 1, 1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert phases_of(spark, [[True] + no])[0][:3] == [0, 1, 1]
    assert phases_of(spark, [[False, False, True] + no])[0][:6] == [0, 1, 2, 2, 2, 3]


def test_phases_against_plain_python(spark):
    rng = random.Random(1)
    conversations = [[rng.random() < 0.3 for _ in range(rng.randint(1, 16))] for _ in range(60)]
    assert phases_of(spark, conversations) == [plain_phases(c) for c in conversations]


def test_long_conversations_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(dialog, "TURNS_PER_BLOCK", 5)
    turns = talk(spark, [[False] * 20, [False] * 3])
    rows = dialog.rolling_context(turns).orderBy("conv_id", "turn").collect()
    assert len(rows) == 46
    for row in rows:
        assert len(row.context) == min(12, row.turn + 1)
        assert row.context[-1].role == ("user" if row.turn % 2 == 0 else "assistant")
    assert dialog.numbered(turns).filter("question_no <> turn").count() == 0
    assert dialog.phases(turns, F.col("skip")).filter("conv_id = 0").agg(F.max("question_no")).first()[0] == 19
    whole = dialog.transcripts(turns).filter("conv_id = 0").collect()
    assert len(whole) == 1 and whole[0].transcript.count("\n") == 39 and whole[0].transcript.startswith("候选人: x\nHR: y")


def test_very_long_conversation_is_one_transcript_and_one_report(spark):
    turns = spark.createDataFrame(
        [(7, t, "user" if t % 2 == 0 else "assistant", "w" * 400) for t in (0, 1, 2, 4095, 4096, 5000, 9001)],
        "conv_id bigint, turn bigint, role string, text string")
    report = jobs.interview_report(turns, F.lit(False)).collect()
    assert len(report) == 1 and report[0].messages == 7 and len(report[0].transcript.split("\n")) == 7
    assert report[0].transcript.count("w" * 400) == 7
    cut = dialog.transcripts(turns, 300).first().transcript
    assert "w" * 301 not in cut and dialog.transcript_lines(turns).count() == 7


def test_summary_and_rounds(spark):
    turns = talk(spark, [[False] * 7])
    phased = dialog.phases(turns, F.col("skip"))
    assert {r.phase: r.rounds for r in dialog.phase_rounds(phased).collect()} == {0: 1, 1: 5, 2: 1}
    row = dialog.session_summary(phased, turns).first()
    assert (row.messages, row.question_count, row.current_phase) == (14, 7, "competency")


def test_constraint(spark):
    df = spark.createDataFrame([([("user", "hi")], "jd_parse"), ([("system", "s"), ("user", "hi")], "chat")],
                               "m array<struct<role:string,content:string>>, t string")
    first, second = [r[0] for r in df.select(D.with_constraint(F.col("m"), F.col("t"), "RULE")).collect()]
    assert [tuple(m) for m in first] == [("system", "RULE"), ("user", "hi")]
    assert second[0].content.endswith("\n\ns") and second[0].content.startswith("【全局约束】") and len(second) == 2
