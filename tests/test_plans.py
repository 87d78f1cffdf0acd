import re

from pyspark.sql import functions as F

from vitaespark import workload
from vitaespark.plans import jobs
from vitaespark.workload import derive, pairs

FOLDER = "/root/testdata/sf0.001"


def test_parse_postings(spark):
    docs = spark.createDataFrame([(1, "高级工程师 深圳 15k-25k Python"), (2, "x")], "doc_id bigint, text string")
    model = spark.createDataFrame([(1, '{"position": "Lead", "hard_skills": ["Go"]}'), (2, "broken")], "doc_id bigint, content string")
    rows = {r.jd_id: r for r in jobs.parse_postings(docs, model).collect()}
    assert (rows[1].position, rows[1].location, rows[1].hard_skills) == ("Lead", "深圳", ["Go", "Python"])
    assert rows[2].position is None and rows[2].hard_skills == []
    assert {r.jd_id: r.position for r in jobs.parse_postings(docs).collect()}[1] == "高级"


def test_parse_resumes(spark):
    docs = spark.createDataFrame([(1, "姓名：李雷\n电话 13800138000\n杭州")], "doc_id bigint, text string")
    row = jobs.parse_resumes(docs).first()
    assert (row.basic_info.name, row.basic_info.phone, row.basic_info.city) == ("李雷", "13800138000", "杭州")
    assert [i.field for i in row.format_issues] == ["email"] and row.source_report.severity == "pass"


def test_tables_to_exports(spark):
    applied, postings, people = (f(spark, FOLDER) for f in (derive.applications, derive.postings, derive.resumes))
    asked = jobs.gap_questions(applied, postings, people)
    answers = asked.withColumn("answer", F.expr(pairs._ANSWER))
    assert asked.filter("question IS NULL").count() == 0
    exports = jobs.tailored_exports(applied, postings, people, answers)
    assert exports.count() == 5 * applied.count()


def test_interviews_and_calls(spark):
    turns = derive.turns(spark, FOLDER)
    report = jobs.interview_report(turns, F.lit(False))
    assert report.count() == turns.select("conv_id").distinct().count()
    calls = derive.calls(spark, FOLDER)
    metered = jobs.metered_calls(calls, ["tenant"], ["gpt", "claude"], 1, 0.1)
    assert metered.count() == calls.count() and metered.filter("decision IS NULL").count() == 0
    assert metered.filter("model NOT IN ('gpt', 'claude') AND decision <> 'API_KEY_MISSING'").count() == 0


def test_raw_texts_to_exports(spark):
    """Parse both sides, find the gaps, work answers in and export: every step takes the one before."""
    model = '{"base_info": {"name": "李雷"}, "skill_certificate": {"software_skill": ["Python"], "ai_tool_mastered": ["Kafka"]}, ' \
            '"work_experience_list": [{"company": "Acme", "position": "dev", "job_duty": "used redis"}]}'
    resumes = jobs.parse_resumes(
        spark.createDataFrame([(1, "姓名：李雷\n电话 13800138000\n杭州"), (2, "nothing")], "doc_id bigint, text string"),
        spark.createDataFrame([(1, model)], "doc_id bigint, content string"))
    postings = jobs.parse_postings(
        spark.createDataFrame([(10, "高级工程师 深圳 15k-25k Docker Redis")], "doc_id bigint, text string"))
    pairs = spark.createDataFrame([(10, 1), (10, 2)], "jd_id bigint, resume_id bigint")
    asked = jobs.gap_questions(pairs, postings, resumes)
    assert asked.filter("category = 'skill_gap' AND keyword = 'Docker' AND resume_id = 1").count() == 1
    answers = asked.withColumn("answer", F.lit("I used it for three years in production"))
    exports = jobs.tailored_exports(pairs, postings, resumes, answers)
    assert exports.count() == 10 and exports.filter("self_intro IS NULL OR jd_analysis IS NULL").count() == 0
    assert exports.filter("resume_id = 1").filter(F.col("content").cast("string").contains("Docker")).count() > 0


def scans(df):
    """Parquet scans of a plan, those that feed a reused exchange counted once."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("FileScan parquet")


def test_pairs_are_planned_once(spark, monkeypatch):
    from vitaespark.operators import matching, ordered

    applied, postings, people = (f(spark, FOLDER) for f in (derive.applications, derive.postings, derive.resumes))
    plain = matching.gaps(matching.pair_records(applied, postings, people))
    assert scans(plain) <= 6
    rows = sorted(map(str, plain.collect()))
    # with popular keys the facts get their salt before any exchange
    monkeypatch.setattr(ordered.heavy_keys, "__defaults__", (20,))
    salted = matching.gaps(matching.pair_records(applied, postings, people))
    plan = salted._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan and "hashpartitioning(jd_id#" in plan
    for line in plan.splitlines():
        if "Exchange hashpartitioning(jd_id" in line:
            assert "_salt" in line, line
    assert sorted(map(str, salted.collect())) == rows
    crowd = spark.range(3000).selectExpr("CASE WHEN id % 2 = 0 THEN 1 ELSE id END AS jd_id", "id % 150 AS resume_id").distinct()
    joined = matching.pair_records(crowd, postings, people)
    assert joined.count() == crowd.join(postings, "jd_id").join(people, "resume_id").count()


def physical(spark, name):
    return workload.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_gaps_are_worked_out_once_for_the_choice_of_questions(spark):
    plan = physical(spark, "match_question_choice")
    assert plan.count("Generate posexplode") == 1 and "Union" not in plan


def test_answers_move_no_resume(spark):
    plan = physical(spark, "match_enrich")
    assert not re.search(r"hashpartitioning\((jd_id#\w+, resume_id|resume_id#\w+, jd_id)", plan) and "posexplode" not in plan


def test_additions_move_no_resume(spark):
    assert not re.search(r"hashpartitioning\((jd_id#\w+, resume_id|resume_id#\w+, jd_id)", physical(spark, "match_append_direct"))


def test_merges_extract_what_is_read(spark):
    assert "GCP" not in physical(spark, "record_merge_resume") and "高中" not in physical(spark, "record_merge_posting")


def test_jobs_get_their_texts_after_orders_were_shuffled(spark):
    plan = derive.resumes(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "collect_list" in line:
            assert "o_orderdate" in line and "Shop" not in line and "duties" not in line, line
