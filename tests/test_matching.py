from pyspark.sql import functions as F

from vitaespark.functions import matching as M
from vitaespark.functions import records as R
from vitaespark.functions import validation as V
from vitaespark.operators import matching

RESUME = """resume_id bigint, basic_info struct<name:string,phone:string,email:string,city:string,target_job:string,
    expect_salary:string,onboard_time:string>,
    education array<struct<school:string,major:string,degree:string,start_date:string,end_date:string,awards:array<string>,source_index:array<int>>>,
    work_experience array<struct<company:string,position:string,start_date:string,end_date:string,duties:string,achievements:array<string>,source_index:array<int>>>,
    projects array<struct<name:string,description:string,results:string,source_index:array<int>>>,
    skills array<struct<name:string,category:string,source:string>>, certificates array<struct<name:string>>, languages array<struct<name:string>>"""
POSTING = """jd_id bigint, position string, company string, years_required string, education_required string,
    hard_skills array<string>, soft_skills array<string>"""


def job(company, duties, start="2020.1", end="2021.1"):
    return (company, "dev", start, end, duties, [], [])


def pair(spark, jobs=(), skills=("go",), hard=("Docker", "Redis", "Go"), soft=(), years=None, target="x", projects=(("p", "d", "", []),)):
    resumes = spark.createDataFrame([(
        1, ("张三", "13800138000", "test@qq.com", "杭州", target, None, None), [], list(jobs), list(projects),
        [(s, "工具", None) for s in skills], [], [])], RESUME)
    postings = spark.createDataFrame([(7, "Dev", "Acme", years, None, list(hard), list(soft))], POSTING)
    pairs = spark.createDataFrame([(7, 1)], "jd_id bigint, resume_id bigint")
    return matching.pair_records(pairs, postings, resumes)


def gaps(spark, **options):
    return [(g.category, g.keyword) for g in matching.gaps(pair(spark, **options)).orderBy("pos").collect()]


def test_skill_gaps(spark):
    assert gaps(spark, jobs=[job("A", "used redis, grew 5%")]) == [("skill_gap", "Docker"), ("skill_detail", "Redis")]


def test_record_gaps(spark):
    assert ("experience_gap", None) in gaps(spark, jobs=[job("A", "5% docker redis")], years="5年")
    assert ("experience_gap", None) not in gaps(spark, jobs=[job("A", "5% docker redis")], years="3年")
    found = gaps(spark, jobs=[job("A", "nothing")], hard=[], soft=["team"], target="", projects=[])
    assert found == [("soft_skill_gap", "team"), ("quant_data", None), ("project_detail", None), ("job_target", None)]
    assert ("quant_data", None) not in gaps(spark, hard=[])


def test_questions_and_choice(spark):
    rows = matching.template_questions(matching.gaps(pair(spark, jobs=[job("A", "5%")], hard=["Docker"])), "en")
    assert rows.first().question == "Skill gap: JD 要求 Docker，简历未体现. Describe your experience with Docker."
    few = rows.limit(0).withColumn("question", F.lit("q"))
    assert {r.origin for r in matching.choose_questions(rows, few).collect()} == {"template"}
    assert {r.origin for r in matching.choose_questions(rows, rows).collect()} == {"model"}


def test_choice_of_questions_beside_their_gaps(spark):
    gap = [(7, 1, 0, "a", "t0"), (7, 1, 1, "b", "t1"), (7, 2, 0, "a", "t2"), (7, 2, 1, "c", "t3"), (8, 1, 0, "b", "t4")]
    rows = spark.createDataFrame(
        [(j, r, p, c, None, q) for j, r, p, c, q in gap], "jd_id long, resume_id long, pos int, category string, keyword string, question string")
    made = F.when(F.col("category") == "a", F.array(F.lit("m1"), F.lit("m2"))).when(F.col("category") == "c", F.array().cast("array<string>"))
    apart = rows.where("category = 'a'").withColumn("question", F.explode(F.array(F.lit("m1"), F.lit("m2"))))
    beside = sorted(matching.choose_questions(rows, made).collect(), key=str)
    assert beside == sorted(matching.choose_questions(rows, apart).collect(), key=str)
    assert [(r.jd_id, r.resume_id, r.question) for r in beside if r.origin == "template"] == [(8, 1, "t4")]


def test_additions_beside_their_pairs(spark):
    rows = pair(spark)
    skill = F.array(F.struct(F.lit("x").alias("name"), F.lit("new").alias("category"), F.lit("direct").alias("source")))
    project = F.array(F.struct(F.lit("p").alias("name"), F.lit("").alias("description"), F.lit("").alias("results"), F.array().cast("array<int>").alias("source_index")))
    beside = F.array(*[F.struct(skill.alias("new_skills"), project.alias("new_projects"))] * 2)
    apart = rows.select("jd_id", "resume_id", skill.alias("new_skills"), project.alias("new_projects"))
    two, joined = matching.append_direct(rows, beside), matching.append_direct(rows, apart.union(apart))
    assert two.columns == joined.columns
    assert [r.skills for r in two.collect()] == [r.skills for r in joined.collect()] and two.count() == 2
    assert [[s.name for s in r.skills] for r in matching.append_direct(rows, F.slice(beside, 1, 0)).collect()] == [["go"]]


def answered(spark, *entries):
    return spark.createDataFrame(
        [(7, 1, i, c, k, a) for i, (c, k, a) in enumerate(entries)],
        "jd_id bigint, resume_id bigint, pos int, category string, keyword string, answer string")


def test_answer_routes(spark):
    rows = matching.route_answers(answered(
        spark, ("skill_gap", "Go", "six ch"), ("skill_gap", "Go", "five5"), ("quant_data", None, "eleven chars"),
        ("quant_data", None, "ten chars."), ("quant_data", None, None))).orderBy("pos").collect()
    assert [r.route for r in rows] == ["skills", "dropped", "log", "dropped", "dropped"]
    assert rows[0].skill.name == "Go" and rows[1].skill is None


def test_enrich(spark):
    answers = answered(
        spark, ("quant_data", None, "first one"), ("quant_data", None, "second one"), ("quant_data", None, "third one"),
        ("skill_gap", "Docker", "yes for years"), ("skill_detail", "Redis", "no"), ("experience_gap", None, "older job"),
        ("project_detail", None, "\n① My app -\nit was big"), ("job_target", "", "Data lead"))
    row = matching.enrich(pair(spark, jobs=[job("A", "a"), job("B", None)], target=""), answers).first()
    assert [w.duties for w in row.work_experience] == [
        "a。补充量化成果：first one", "。补充量化成果：second one", "older job"]
    assert [s.name for s in row.skills] == ["go", "Docker"] and row.skills[1].category == "追问补充"
    assert row.projects[1].name == "My app" and row.basic_info.target_job == "Data lead"
    untouched = matching.enrich(pair(spark), answered(spark).limit(0)).first()
    assert [s.name for s in untouched.skills] == ["go"]


def test_answers_beside_their_pairs(spark):
    """Also where ids repeat: then the answers to the gaps of all records with the ids of a pair are worked in."""
    resumes = spark.createDataFrame([
        (1, ("a", None, None, None, target, None, None), [], [job("A", duties), job("B", None)], [], [(skill, "工具", None)], [], [])
        for target, duties, skill in (("", "used redis", "go"), ("x", "built it", "rust"))]
        + [(2, ("b", None, None, None, None, None, None), [], [], [], [], [], [])], RESUME)
    postings = spark.createDataFrame(
        [(7, "Dev", "Acme", "9年", None, ["Docker", "Go"], ["team"]), (7, "", "Acme", None, None, ["Redis"], [""]), (8, "Ops", "B", None, None, None, [])], POSTING)
    applied = spark.createDataFrame([(7, 1), (7, 2), (8, 1), (8, 2), (None, 1)], "jd_id bigint, resume_id bigint")
    answer = "CASE WHEN {0}pos % 4 = 3 THEN 'no' ELSE concat(' long answer ', {0}pos, {0}category, resume_id) END"
    plain, copied = (matching.pair_records(applied, postings, resumes, copies=c) for c in (False, True))
    apart = matching.enrich(plain, matching.gaps(plain).withColumn("answer", F.expr(answer.format(""))))
    beside = matching.enrich(matching.gaps(copied, beside=True), F.expr("transform(gaps, g -> named_struct("
        f"'pos', g.pos, 'category', g.category, 'keyword', g.keyword, 'answer', {answer.format('g.')}))"))
    columns = ["jd_id", "resume_id", "basic_info", "skills", "projects", "work_experience", "job_hits"]
    assert sorted(map(str, beside.select(columns).collect())) == sorted(map(str, apart.select(columns).collect()))
    assert beside.count() == 9 and max(len(r.skills) for r in beside.collect()) > 4


def test_relevance_order_is_stable(spark):
    jobs = [job("A", "docker"), job("B", "docker redis"), job("C", "redis docker")]
    row = pair(spark, jobs=jobs).select(M.by_relevance(
        F.col("work_experience"), F.col("job_hits"), F.col("hard_words.code")).alias("w")).first()
    assert [w.company for w in row.w] == ["B", "C", "A"]
    plain = pair(spark, jobs=jobs, hard=[]).select(M.by_relevance(
        F.col("work_experience"), F.col("job_hits"), F.col("hard_words.code")).alias("w")).first()
    assert [w.company for w in plain.w] == ["A", "B", "C"]


def test_tailor_and_export(spark):
    tailored = matching.tailor(pair(spark, jobs=[job("某公司", "Python 开发", "2022", "2024")], skills=("Python", "Django", "CET-6"),
                                    hard=("Python", "Rust"), target="后端"))
    row = tailored.first()
    assert row.summary == "张三，1+年经验，Python等技能匹配JD要求。"
    assert row.experience[0].period == "2022 - 2024" and row.experience[0].jd_relevance == "高"
    assert row.skills.technical == ["Python", "Django"] and row.skills.jd_missing == ["Rust"]
    assert row.intro_zh.text.startswith("面试官您好，我是张三。应聘后端岗位。我熟练掌握Python、Django。曾在某公司担任dev，Python 开发。")
    assert row.intro_zh.estimated_seconds == round(row.intro_zh.char_count / 200 * 60)
    titles = [r.title for r in matching.export_rows(tailored).orderBy("pos").collect()]
    assert titles == ["基本信息", "个人概述", "教育经历", "工作经历", "技能证书"]


def test_what_is_made_once_per_resume_is_the_same_in_an_export(spark):
    long = job("C" * 90, 'a "quoted" redis\n\\ line', "", None)
    resumes = spark.createDataFrame([
        (1, ("", None, None, None, "x", None, None), [], [job(None, None), long, job("D", "docker redis")], [], [("go", "工具", None)], [], []),
        (2, ("b", None, None, None, None, None, None), [], [], [], [], [], []),
        (3, ("c", None, None, None, None, None, None), [], None, [], [], [], [])], RESUME)
    postings = spark.createDataFrame(
        [(7, "Dev", "A", None, None, ["Docker", "Redis"], ["quoted", "redis"]), (8, "", "A", None, None, None, [""]), (9, "", "A", None, None, [None, ""], [])], POSTING)
    applied = spark.createDataFrame([(j, r) for j in (7, 8, 9) for r in (1, 2, 3)], "jd_id bigint, resume_id bigint")
    plain, made = (matching.tailor(matching.pair_records(applied, postings, resumes, exported=e)) for e in (False, True))
    rows = [sorted(map(str, matching.export_rows(x).collect())) for x in (plain, made)]
    assert rows[0] == rows[1] and len(rows[0]) == 45
    jobs = made.select("experience_json", F.to_json("experience").alias("whole")).collect()
    assert all(r.experience_json == r.whole for r in jobs) and len({r.whole for r in jobs}) > 3
    said = matching.export_rows(made).join(plain, ["jd_id", "resume_id"]).select("self_intro", F.to_json(
        F.struct(F.col("intro_zh").alias("zh"), F.col("intro_en").alias("en"))).alias("whole")).collect()
    assert all(r.self_intro == r.whole for r in said)


def test_long_intro_is_cut(spark):
    row = matching.tailor(pair(spark, jobs=[job("C" * 200, "d")])).first()
    assert row.intro_en.char_count == 155 and row.intro_en.text.endswith("...")


def test_popular_keys_are_salted_without_loss(spark):
    from vitaespark.operators import ordered

    facts = spark.range(1000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), "id")
    records = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k bigint, v string")
    heavy = ordered.heavy_keys(facts, "k", rows_per_task=100)
    assert heavy.count() == 3
    joined = ordered.salted_join(facts, records, "k", heavy=heavy)
    assert joined.count() == 1000 and sorted(joined.columns) == ["id", "k", "v"]
    assert joined.join(facts.join(records, "k"), ["k", "id", "v"], "left_anti").count() == 0


def issues(spark, fn, *values):
    df = spark.createDataFrame([values], "a string, b string")
    return [(i.type, i.severity) for i in df.select(fn(F.col("a"), F.col("b"))).first()[0]]


def test_claims(spark):
    assert issues(spark, V.claim_issues, "提升30%", "nothing") == [("quantified", "warning")]
    assert issues(spark, V.claim_issues, "提升了30%", "30% up") == []
    assert issues(spark, V.claim_issues, "带领10人", "nothing") == [("fabricated", "block")]
    assert issues(spark, V.claim_issues, "ROI > 3 负责全部", "") == []
    assert len(issues(spark, lambda a, b: V.claim_issues(a, b, ungrouped=True), "ROI > 3 负责全部", "")) == 2


def test_time_conflict_and_formats(spark):
    def found(start, end):
        row = pair(spark, jobs=[job("A", "x", start, end)]).select(V.time_issues(F.col("work_experience")).alias("i")).first()
        return [(i.type, i.severity) for i in row.i]

    assert found("2022.1", "2020.3") == [("time_conflict", "block")]
    assert found("2022.1", "至今") == [] and found(None, "2020") == []
    assert pair(spark).select(V.format_issues(F.col("basic_info")).alias("i")).first().i == []


def test_grounding_and_severity(spark):
    df = spark.createDataFrame([("abcdef. zzzzzzz! tiny\nabc xyz uvw", "abc")], "a string, b string")
    row = df.select(V.source_report(F.col("a"), F.col("b")).alias("r")).first().r
    assert (row.grounding.total_sentences, row.grounding.grounded_sentences) == (3, 2)
    assert row.grounding.grounded_ratio == 0.667 and row.severity == "pass"


def test_fill_arguments(spark):
    cases = [
        ("{a} and {b}", {"a": "1", "b": "2"}, "1 and 2"), ("{a} and {c}", {"a": "1"}, "{a} and {c}"), ("plain", {}, "plain"),
        ("{a}", {"a": "{b}", "b": "X"}, "{b}"), ("{{a}} {a}", {"a": "1"}, "{a} 1"), ("{a}!", {"a": None}, "None!"),
        ("a } {a}", {"a": "1"}, "a } {a}"), ("", {}, ""), (None, {}, None), ("{}", {"": "e"}, "e")]
    df = spark.createDataFrame([(t, m) for t, m, _ in cases], "t string, m map<string,string>")
    assert [r[0] for r in df.select(R.fill_arguments(F.col("t"), F.col("m"))).collect()] == [want for _, _, want in cases]


def test_localised(spark):
    words = spark.createDataFrame([("k", "zh", "中"), ("k", "en", "E"), ("z", "zh", "只")], "key string, lang string, text string")
    keys = spark.createDataFrame([("k",), ("z",), ("zzz",)], "key string")
    rows = {r.key: r.text for r in matching.localised(keys, words, "en").collect()}
    assert rows == {"k": "E", "z": "只", "zzz": "zzz"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_are_not_broadcast(spark):
    """Files of a million short records are small, but their rows do not fit the driver."""
    from vitaespark.operators import ordered

    facts = spark.range(100).selectExpr("id % 7 AS k", "id")
    records = spark.range(5).selectExpr("id AS k", "concat('r', id) AS v")
    for how in ("inner", "left"):
        joined = ordered.salted_join(facts, records, "k", how)
        assert "Broadcast" not in plan_of(joined)
        assert sorted(map(str, joined.collect())) == sorted(map(str, facts.join(records, "k", how).collect()))
    heavy = ordered.heavy_keys(facts, "k", rows_per_task=10)
    salted = plan_of(ordered.salted_join(facts, records, "k", heavy=heavy))
    assert "SortMergeJoin [k" in salted and "_salt" in salted


def test_ranking_reads_keywords_once(spark):
    """Keywords are put together once per pair, and a preview's filter does not rank again."""
    from vitaespark.workload import pairs

    plan = plan_of(pairs.match_preview(spark, "/root/testdata/sf0.001")).split("== Initial Plan ==")[-1]
    assert plan.count("sort_array(") == 1 and plan.count("array_sort(") <= 2
    ranked = spark.sql("SELECT array('a', 'b', 'c', 'd') AS e, array(',1,', ',1,,2,', null, ',2,,1,') AS h, array(',1,', ',2,', null) AS c")
    some = ranked.select(M.by_relevance(F.col("e"), F.col("h"), F.col("c")), M.relevance_scores(F.col("h"), F.col("c"))).first()
    assert tuple(some) == (["b", "d", "a", "c"], [1, 2, 0, 2])
    none = ranked.select(M.by_relevance(F.col("e"), F.col("h"), F.lit(None).cast("array<string>"))).first()
    assert none[0] == ["a", "b", "c", "d"]
