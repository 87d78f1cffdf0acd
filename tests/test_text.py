import random

import pytest
from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.functions import extract as X
from vitaespark.functions import text as T
from vitaespark.functions.strings import regex_first
from vitaespark.operators import documents

RESUME = "John\n\nEducation\nMIT\n\nSkills\nPython"


def sections(spark, text, **options):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = documents.explode_sections(df, ["doc_id"], **options).orderBy("line_no").collect()
    found = {}
    for row in rows:
        found.setdefault(row.section_key, []).append(row.line)
    return found


@pytest.mark.parametrize("text, expected", [
    ("a\n\n5\n\nb\n", "a\n\nb\n"),
    ("a\r\nb\rc\fd", "a\nb\nc\nd"),
    ("a  b\t\tc", "a b c"),
    ("con-\ntinued and a-\nb-\nc", "continued and ab-\nc"),
    ("x\n第 1 页 共 3 页\ny\nPAGE 2 of 9\nz", "x\n\ny\n\nz"),
    ("a\n\n\n\n\n\nb", "a\n\nb"),
])
def test_normalize(value, text, expected):
    assert value(T.normalize_text, text) == expected


@pytest.mark.parametrize("text, expected", [
    ("too short", False), ("long enough text with letters", True), ("-" * 40, False), ("\x01" * 30 + "abcdefghij", False),
])
def test_meaningful(value, text, expected):
    assert value(T.is_meaningful, text) is expected


def test_sections(spark):
    assert sections(spark, RESUME, merge_header=False) == {
        "header": ["John"], "education": ["Education", "MIT"], "skills": ["Skills", "Python"]}
    assert sections(spark, RESUME) == {"education": ["John", "Education", "MIT"], "skills": ["Skills", "Python"]}
    assert sections(spark, "intro\nSkills\nPython", merge_header=False) == {"header": ["intro", "Skills", "Python"]}
    assert list(sections(spark, "a\n\nProfile\nx")) == ["personal_info"]
    # a document without headings keeps its lines, and repeated sections append
    assert sections(spark, "one\ntwo") == {"header": ["one", "two"]}
    assert sections(spark, "Skills\na\n\nAwards\nb\n\nSkills\nc")["skills"] == ["Skills", "a", "Skills", "c"]


def test_format_sections(value):
    rule = "─" * 50
    assert value(T.format_sections, "Skills\nPython\nPython") == (
        f"\n{rule}\n【专业技能 / Skills】\n{rule}\n[0] Skills\n[1] Python\n[1] Python")
    assert value(lambda c: T.format_sections(c, "en"), "Skills\nGo").count("【Skills】") == 1
    # without a heading the text is numbered as it is
    assert value(T.format_sections, " one\n\n two ") == "[0] one\n[1] \n[2]  two"
    assert value(T.format_sections, "") == "[0] " and value(T.format_sections, None) is None


def test_line_of(spark):
    df = spark.createDataFrame([("b",), ("cc",), ("zz",), ("  ",), (" a b ",)], "n string")
    lines = F.array(*map(F.lit, ["a b", "xcc", " b ", "cc"]))
    bare = F.transform(lines, T.trimmed)
    assert [r[0] for r in df.select(T.line_of(lines, bare, F.col("n"))).collect()] == [2, 3, -1, -1, 0]


def test_locate_lines_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b\nxcc\n b \ncc"), (2, "q")], "d int, text string")
    needles = spark.createDataFrame([(1, k, n) for k, n in enumerate(["b", "cc", "zz", "  ", " a b ", "b"])] + [(2, 9, "q")], "d int, k int, needle string")
    for most in (10_000, 2):
        monkeypatch.setattr(documents, "NEEDLES_PER_TASK", most)
        rows = documents.locate_lines(needles, docs, "d")
        assert rows.columns == ["d", "k", "needle", "line_no"]
        assert sorted((r.k, r.line_no) for r in rows.collect()) == [(0, 2), (1, 3), (2, -1), (3, -1), (4, 0), (5, 2), (9, 0)]


def test_gap_clusters(spark):
    df = spark.createDataFrame([(k, float(p)) for k in (1, 2) for p in (0, 1, 2, 3, 100, 101, 102)], "k int, p double")
    for blocks in (1, 3, 14):
        rows = documents.gap_clusters(df, ["k"], "p", blocks=blocks).orderBy("k", "p").collect()
        assert [r.cluster_id for r in rows] == [0, 0, 0, 0, 1, 1, 1] * 2


def test_gap_clusters_against_plain_python(spark):
    rng = random.Random(5)
    data = [(k, float(rng.choice([rng.randint(0, 60), rng.randint(0, 4000)]))) for k in range(5) for _ in range(60)]
    rows = documents.gap_clusters(spark.createDataFrame(data, "k int, p double"), ["k"], "p", blocks=9).collect()
    for key in range(5):
        points = sorted(p for k, p in data if k == key)
        gaps = sorted(b - a for a, b in zip(points, points[1:]) if b > a)
        limit, number, expected = max(3 * gaps[len(gaps) // 2], 30), 0, []
        for at, point in enumerate(points):
            number += at > 0 and point - points[at - 1] > limit
            expected.append((point, number))
        assert sorted((r.p, r.cluster_id) for r in rows if r.k == key) == expected


def test_words_to_lines(spark):
    words = [(1, float(i), t, w) for i, (t, w) in enumerate([(0.0, "a"), (4.0, "b"), (8.0, "c"), (9.0, "d")])]
    df = spark.createDataFrame(words, "page_id int, x0 double, top double, text string")
    rows = documents.words_to_lines(df, ["page_id"]).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in rows] == [(0, "a b"), (1, "c d")]


def test_words_of_a_page_travel_as_plain_arrays(spark):
    words = [(1, 0.0, None, "n"), (1, None, 8.0, "x"), (1, 1.0, 8.0, None), (1, 2.0, 8.0, ""), (1, 3.0, 8.0, "z"), (2, None, None, None),
             (3, 1.0, 0.0, "b"), (3, 0.0, 0.0, "a")]
    df = spark.createDataFrame(words, "page_id int, x0 double, top double, text string")
    lines = documents.words_to_lines(df, ["page_id"])
    assert sorted((r.page_id, r.line_no, r.line) for r in lines.collect()) == [(1, 0, "n"), (1, 1, "x  z"), (2, 0, ""), (3, 0, "a b")]
    assert "collect_list(struct" not in lines._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text", ["Since 2020", "a Inc", "xy  Inc", "日本集团 x", "Y集团", "AcmeCORP.", "", "we include all", "\u017foftcorp"])
def test_company_guess_looks_for_two_letters_first(value, text):
    whole = f"(?iu)[{X._CJK}A-Za-z]{{2,20}}(?:{'|'.join(fixed.POSTING_COMPANY_SUFFIXES)})"
    assert value(X.company_guess, text) == value(lambda c: regex_first(c, X._unicode(whole)), text)


@pytest.mark.parametrize("fn, text, expected", [
    (X.years_required, "3年以上 5年 3 years 10 years", "10年"),
    (X.years_required, "3年以上", None),
    (X.years_required, "45年 0年", None),
    (lambda c: X.years_required(c, include_at_least=True), "3年以上", "3年"),
    (X.resume_skills, "JavaScript", ["Java"]),
    (X.posting_skills, "Python python", ["Python", "python"]),
    (X.posting_skills, "Java开发", []),
    (X.posting_skills, "Java, golang NEXTJS", ["Java", "golang", "NEXTJS"]),
    (X.posting_skills, "R and c++ / .net", ["c++", "R", ".net"]),
    (X.education_label, "要求硕士或本科", "硕士"),
    (X.salary_range, "月薪 15k-25k", "15k-25k"),
    (X.salary_range, "2万-3万", "2万-3万"),
    (X.position_guess, "招聘 高级 (Java) 工程师", "高级 (Java)"),
    (X.company_guess, "加入星海科技有限公司吧", "加入星海科技有限公司"),
    (X.location, "base 深圳", "深圳"),
    (X.person_name, "姓 名：李雷，男", "李雷"),
    (X.person_name, "韩梅梅\n电话 1", "韩梅梅"),
    (X.phone, "x913800138000y", "13800138000"),
    (X.email, "mail a.b+c@x-y.org!", "a.b+c@x-y.org"),
    (X.schools, "浙江大学 浙江大学 同济学院 A大学", ["浙江大学", "同济学院"]),
    (X.majors, "专业：金融学", ["金融学"]),
    (X.degrees, "phd or master", ["phd"]),
    (X.employers, "阿里云科技\nGlobex Inc. ", ["阿里云科技"]),
    (X.date_ranges, "2018.9 - 2022.6, 2022/07 至今, 2020.1-至今", ["2018.9 - 2022.6", "2020.1-至今"]),
    (X.year_of, "2020.3", 2020),
    (X.year_of, "至今", None),
    (X.model_json, 'text ```json {"a":1} ``` more', '{"a":1}'),
    (X.model_json, 'so {"a": {"b": 2}} done', '{"a": {"b": 2}}'),
    (X.model_json, "no json", None),
    (X.model_json, "", None),
])
def test_extractors(value, fn, text, expected):
    assert value(fn, text) == expected


def test_leading_literals():
    from vitaespark import fixed

    starts = {p: X.leading_literal(p) for p in fixed.HARD_SKILL_PATTERNS}
    assert all(starts.values())
    assert starts[r"Next\.?js"] == "next" and starts["CSS3?"] == "css" and starts[r"C\+\+"] == "c++"
