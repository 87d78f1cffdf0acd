"""Registered queries: postings against résumés (G1 to G13, R1 to R8) and record assembly (M, S6)."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.functions import extract as X
from vitaespark.functions import matching as M
from vitaespark.functions import records as R
from vitaespark.operators import matching
from vitaespark.workload import derive
from vitaespark.workload.extracts import MODEL_JSON_SQL, _skill_hits
from vitaespark.workload.registry import query
from vitaespark.workload.sqltext import CJK, NL, POSTINGS, RESUMES, first, q, unicode

# --- the same records as relations -------------------------------------------------------

_JOB_TEXT = f"lower(concat_ws({NL}, company, position, start_date, end_date, duties))"
_PROJECT_TEXT = f"lower(concat_ws({NL}, 'Project ' || order_key, duties, ''))"
BASE = f"""
postings AS MATERIALIZED ({derive.as_sql(derive.POSTING, 'part')}),
people AS MATERIALIZED ({derive.as_sql(derive.CANDIDATE, 'customer')}),
job_rows AS ({derive.as_sql(derive.JOB, 'orders')}),
jobs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY started, order_key) - 1 AS pos,
    {_JOB_TEXT} AS job_text, {_PROJECT_TEXT} AS project_text FROM job_rows),
apps AS MATERIALIZED (SELECT DISTINCT l_partkey AS jd_id, o_custkey AS resume_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
jd_hard AS (SELECT jd_id, unnest([skill_1, skill_2, skill_3]) AS skill, unnest([0, 1, 2]) AS k FROM postings),
jd_soft AS (SELECT jd_id, unnest([soft_1, soft_2]) AS skill, unnest([0, 1]) AS k FROM postings),
listed AS (SELECT resume_id, unnest([list_skill_1, list_skill_2, list_skill_3]) AS name, unnest([0, 1, 2]) AS k FROM people),
history AS MATERIALIZED (SELECT resume_id, count(*) AS n_jobs, count(*) FILTER (is_project) AS n_projects,
    bool_or(regexp_matches(duties, '\\p{{Nd}}+[%％倍kKwW万]')) AS measured,
    string_agg(job_text, {NL} ORDER BY pos) || {NL} ||
    coalesce(string_agg(project_text, {NL} ORDER BY pos) FILTER (is_project), '') AS body FROM jobs GROUP BY resume_id)"""

_GAP_SELECTS = f"""
hard AS (SELECT a.jd_id, a.resume_id, 0 AS class, s.k, s.skill AS keyword, contains(coalesce(h.body, ''), lower(s.skill)) AS in_text
    FROM apps a JOIN jd_hard s USING (jd_id) LEFT JOIN history h USING (resume_id)
    WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.resume_id = a.resume_id AND lower(l.name) = lower(s.skill))),
facts AS (SELECT a.jd_id, a.resume_id, p.position, p.years_required, c.target_job, coalesce(h.n_jobs, 0) AS n_jobs,
    coalesce(h.n_projects, 0) AS n_projects, coalesce(h.measured, false) AS measured,
    coalesce(try_cast(regexp_extract(p.years_required, '^([0-9]+)', 1) AS bigint), 0) AS wanted
    FROM apps a JOIN postings p USING (jd_id) JOIN people c USING (resume_id) LEFT JOIN history h USING (resume_id)),
found AS (
    SELECT jd_id, resume_id, class, k, CASE WHEN in_text THEN 'skill_detail' ELSE 'skill_gap' END AS category, keyword,
        'JD 要求 ' || keyword || CASE WHEN in_text THEN '，简历有提及但未在技能列表中' ELSE '，简历未体现' END AS detail,
        'jd' AS source FROM hard
    UNION ALL SELECT a.jd_id, a.resume_id, 1, s.k, 'soft_skill_gap', s.skill, 'JD 要求软技能：' || s.skill, 'jd'
        FROM apps a JOIN jd_soft s USING (jd_id) LEFT JOIN history h USING (resume_id)
        WHERE NOT contains(coalesce(h.body, ''), lower(s.skill))
    UNION ALL SELECT jd_id, resume_id, 2, 0, 'quant_data', NULL, '工作经历缺少量化成果数据', 'analysis'
        FROM facts WHERE n_jobs > 0 AND NOT measured
    UNION ALL SELECT jd_id, resume_id, 3, 0, 'project_detail', NULL, '简历缺少项目经历章节', 'analysis'
        FROM facts WHERE n_projects = 0
    UNION ALL SELECT jd_id, resume_id, 4, 0, 'experience_gap', NULL,
        'JD 要求 ' || years_required || ' 经验，简历展示 ' || n_jobs || ' 段经历', 'jd'
        FROM facts WHERE wanted > 0 AND n_jobs < greatest(1, wanted // 2)
    UNION ALL SELECT jd_id, resume_id, 5, 0, 'job_target', NULL, 'JD 岗位为 ' || position || '，简历未明确求职意向', 'analysis'
        FROM facts WHERE coalesce(target_job, '') = '' AND position <> ''),
gaps AS MATERIALIZED (SELECT jd_id, resume_id, cast(row_number() OVER (PARTITION BY jd_id, resume_id ORDER BY class, k) - 1
    AS integer) AS pos, category, keyword, detail, source FROM found)"""


def paired(spark, d, **options):
    return matching.pair_records(derive.applications(spark, d), derive.postings(spark, d), derive.resumes(spark, d), **options)


def paired_with_roles(spark, d):
    """Pairs with ``roles``, the positions and companies of all postings of their id, and ``copies``, the
    number of résumés of theirs: what a join of the pairs by their ids would bring, without moving a pair."""
    posting, resume = Window.partitionBy("jd_id"), Window.partitionBy("resume_id")
    postings = derive.postings(spark, d).where("jd_id IS NOT NULL").withColumn(
        "roles", F.collect_list(F.struct("position", "company")).over(posting))
    resumes = derive.resumes(spark, d).where("resume_id IS NOT NULL").withColumn("copies", F.count(F.lit(1)).over(resume))
    return matching.pair_records(derive.applications(spark, d), postings, resumes, more=("roles",))


@query("match_gaps", f"WITH {BASE}, {_GAP_SELECTS} SELECT * FROM gaps")
def match_gaps(spark, d):
    """All gaps of all applications."""
    return matching.gaps(paired(spark, d))


def _gap_query(name, op, category):
    def run(spark, d):
        rows = matching.gaps(paired(spark, d)).filter(F.col("category") == category)
        return rows.groupBy("jd_id", "keyword").agg(F.count(F.lit(1)).alias("candidates"))

    run.__doc__ = f"{op}: candidates per posting with this gap."
    query(name, f"""WITH {BASE}, {_GAP_SELECTS} SELECT jd_id, keyword, count(*) AS candidates
        FROM gaps WHERE category = '{category}' GROUP BY ALL""")(run)


for _op, _category in zip(("G1", "G2", "G3", "G4", "G5", "G6", "G7"), fixed.GAP_CATEGORIES):
    _gap_query(f"gap_{_category}", _op, _category)

_QUESTION = " ".join(
    f"WHEN '{c}' THEN replace(replace({q(zh)}, '{{detail}}', detail), '{{keyword}}', coalesce(keyword, ''))"
    for c, (zh, _) in fixed.QUESTION_TEMPLATES.items())


@query("match_questions", f"""WITH {BASE}, {_GAP_SELECTS}
    SELECT jd_id, resume_id, pos, CASE category {_QUESTION} END AS question FROM gaps""")
def match_questions(spark, d):
    """G9"""
    return matching.template_questions(matching.gaps(paired(spark, d))).select("jd_id", "resume_id", "pos", "question")


@query("match_question_choice", f"""WITH {BASE}, {_GAP_SELECTS},
    made AS (SELECT g.jd_id, g.resume_id, g.pos, category, keyword, 'Tell me about ' || category AS question
        FROM gaps g JOIN postings p USING (jd_id)
        WHERE p.position = 'Engineer' OR (p.position = 'Analyst' AND category = 'skill_gap')),
    counts AS (SELECT jd_id, resume_id, count(*) AS n FROM gaps GROUP BY ALL),
    chosen AS (SELECT m.jd_id, m.resume_id FROM made m JOIN counts c USING (jd_id, resume_id) GROUP BY ALL
        HAVING count(*) >= any_value(c.n))
    SELECT jd_id, resume_id, pos, question, 'model' AS origin FROM made SEMI JOIN chosen USING (jd_id, resume_id)
    UNION ALL SELECT jd_id, resume_id, pos, CASE category {_QUESTION} END, 'template'
        FROM gaps ANTI JOIN chosen USING (jd_id, resume_id)""")
def match_question_choice(spark, d):
    """G10"""
    found = matching.gaps(paired_with_roles(spark, d), keep=("roles",))
    asked = F.filter(F.col("roles.position"), lambda p: (p == "Engineer") | ((p == "Analyst") & (F.col("category") == "skill_gap")))
    made = F.transform(asked, lambda _: F.concat(F.lit("Tell me about "), F.col("category")))
    return matching.choose_questions(matching.template_questions(found), made).select(
        "jd_id", "resume_id", "pos", "question", "origin")


_ANSWER = ("CASE (pos + resume_id) % 5 WHEN 0 THEN 'no' WHEN 1 THEN '  did it ' WHEN 2 THEN "
           "'I led the work on it for years and cut cost by 12%' WHEN 3 THEN NULL ELSE "
           "'① Big ' || category || repeat(' and then some', CASE WHEN resume_id % 3 = 0 THEN 45 ELSE 0 END) || ' - ' || chr(10)"
           " || 'it was about moving all of it' END")


def answers(spark, d):
    return matching.gaps(paired(spark, d)).withColumn("answer", F.expr(_ANSWER))


@query("match_answer_route", f"""WITH {BASE}, {_GAP_SELECTS},
    a AS (SELECT *, length(trim(coalesce({_ANSWER}, ''))) AS n FROM gaps),
    r AS (SELECT *, CASE WHEN category = 'skill_gap' AND n > 5 THEN 'skills' WHEN n > 10 THEN 'log' ELSE 'dropped' END AS route
        FROM a)
    SELECT jd_id, category, route, count(*) AS answers, min(CASE WHEN route = 'skills' THEN keyword || '/工具/增信问卷' END) AS skill
    FROM r GROUP BY ALL""")
def match_answer_route(spark, d):
    """G11"""
    skill = F.concat_ws("/", "skill.name", "skill.category", "skill.source")
    return matching.route_answers(answers(spark, d)).groupBy("jd_id", "category", "route").agg(
        F.count(F.lit(1)).alias("answers"),
        F.min(F.when(F.col("skill").isNotNull(), skill)).alias("skill"))


_TRIMMED = "trim(coalesce(answer, ''), ' ' || chr(10) || chr(9))"


@query("match_enrich", f"""WITH {BASE}, {_GAP_SELECTS},
    raw AS (SELECT *, {_ANSWER} AS answer FROM gaps),
    ans AS (SELECT * REPLACE ({_TRIMMED} AS answer) FROM raw WHERE length({_TRIMMED}) >= 5),
    skill AS (SELECT jd_id, resume_id, string_agg(keyword, '|' ORDER BY pos) AS names FROM ans
        WHERE category IN ('skill_gap', 'skill_detail') AND coalesce(keyword, '') <> '' GROUP BY ALL),
    proj AS (SELECT jd_id, resume_id, string_agg(trim(string_split(answer, {NL})[1], '①②③④⑤⑥⑦⑧⑨⑩- '), '|' ORDER BY pos) AS names
        FROM ans WHERE category = 'project_detail' GROUP BY ALL),
    quant AS (SELECT jd_id, resume_id, answer, row_number() OVER (PARTITION BY jd_id, resume_id ORDER BY pos) - 1 AS i
        FROM ans WHERE category = 'quant_data'),
    extra AS (SELECT jd_id, resume_id, string_agg('（追问补充）:' || answer, '|' ORDER BY pos) AS duties FROM ans
        WHERE category = 'experience_gap' GROUP BY ALL),
    target AS (SELECT jd_id, resume_id, answer FROM ans WHERE category = 'job_target'),
    work AS (SELECT a.jd_id, a.resume_id, string_agg(j.company || ':' || j.duties || coalesce('。补充量化成果：' || z.answer, ''), '|'
        ORDER BY j.pos) AS duties FROM apps a JOIN jobs j USING (resume_id)
        LEFT JOIN quant z ON z.jd_id = a.jd_id AND z.resume_id = a.resume_id AND z.i = j.pos GROUP BY ALL),
    own AS (SELECT resume_id, string_agg('Project ' || order_key, '|' ORDER BY pos) AS names FROM jobs WHERE is_project GROUP BY ALL)
    SELECT a.jd_id, a.resume_id,
        concat_ws('|', c.list_skill_1, c.list_skill_2, c.list_skill_3, skill.names) AS skills,
        concat_ws('|', own.names, proj.names) AS projects,
        md5(concat_ws('|', work.duties, extra.duties)) AS duties_md5,
        CASE WHEN c.target_job <> '' THEN c.target_job ELSE coalesce(target.answer, c.target_job) END AS target_job
    FROM apps a JOIN people c USING (resume_id) LEFT JOIN skill USING (jd_id, resume_id) LEFT JOIN proj USING (jd_id, resume_id)
        LEFT JOIN extra USING (jd_id, resume_id) LEFT JOIN work USING (jd_id, resume_id) LEFT JOIN own USING (resume_id)
        LEFT JOIN target USING (jd_id, resume_id)""")
def match_enrich(spark, d):
    """G12"""
    found = matching.gaps(paired(spark, d, copies=True), beside=True)
    answer = re.sub(r"\b(pos|category)\b", r"g.\1", _ANSWER)
    rich = matching.enrich(found, F.expr(
        f"transform(gaps, g -> named_struct('pos', g.pos, 'category', g.category, 'keyword', g.keyword, 'answer', {answer}))"))
    duties = F.transform("work_experience", lambda w: F.concat(w["company"], F.lit(":"), w["duties"]))
    return rich.select(
        "jd_id", "resume_id", F.array_join("skills.name", "|").alias("skills"),
        F.array_join("projects.name", "|").alias("projects"), F.md5(F.array_join(duties, "|")).alias("duties_md5"),
        F.col("basic_info.target_job").alias("target_job"))


@query("match_append_direct", f"""WITH {BASE}
    SELECT a.jd_id, a.resume_id, concat_ws('|', list_skill_1, list_skill_2, list_skill_3,
        CASE WHEN p.position <> '' THEN p.position END) AS skills,
        concat_ws('|', (SELECT string_agg('Project ' || order_key, '|' ORDER BY pos) FROM jobs j WHERE j.resume_id = a.resume_id AND is_project),
            CASE WHEN p.position <> '' THEN p.company END) AS projects
    FROM apps a JOIN people c USING (resume_id) JOIN postings p USING (jd_id)""")
def match_append_direct(spark, d):
    """G13"""
    pairs = paired_with_roles(spark, d)
    extra = F.expr("""flatten(array_repeat(transform(filter(roles, r -> r.position <> ''), r -> named_struct(
        'new_skills', array(named_struct('name', r.position, 'category', 'new', 'source', 'direct')),
        'new_projects', array(named_struct('name', r.company, 'description', '', 'results', '', 'source_index',
            cast(array() AS array<int>))))), cast(copies AS int)))""")
    return matching.append_direct(pairs, extra).select(
        "jd_id", "resume_id", F.array_join("skills.name", "|").alias("skills"), F.array_join("projects.name", "|").alias("projects"))


# --- ranking and tailoring -----------------------------------------------------------------

_MATCHED = f"""
hits AS (SELECT a.jd_id, a.resume_id, s.k, s.skill, EXISTS (SELECT 1 FROM listed l WHERE l.resume_id = a.resume_id
    AND contains(lower(l.name), lower(s.skill))) AS hit FROM apps a JOIN jd_hard s USING (jd_id)),
matched AS MATERIALIZED (SELECT jd_id, resume_id, coalesce(string_agg(skill, '|' ORDER BY k) FILTER (hit), '') AS jd_matched,
    coalesce(string_agg(skill, '|' ORDER BY k) FILTER (NOT hit), '') AS jd_missing,
    coalesce(string_agg(skill, '、' ORDER BY k) FILTER (hit), '') AS shown FROM hits GROUP BY ALL)"""


@query("match_skills_matched", f"WITH {BASE}, {_MATCHED} SELECT jd_id, resume_id, jd_matched, jd_missing FROM matched")
def match_skills_matched(spark, d):
    """R1"""
    names = F.col("name_hits")
    return paired(spark, d).select(
        "jd_id", "resume_id", F.array_join(M.skills_matched(F.col("hard_words"), names), "|").alias("jd_matched"),
        F.array_join(M.skills_missing(F.col("hard_words"), names), "|").alias("jd_missing"))


_WHOLE = f"""SELECT resume_id, lower(concat_ws({NL}, name, phone, email, city, target_job, expect_salary,
        concat_ws({NL}, school, major, degree, '2010.9', '2014.6'), coalesce(h.body, {NL}),
        concat_ws({NL}, list_skill_1, list_skill_2, list_skill_3), certificate, language)) AS body
        FROM people LEFT JOIN history h USING (resume_id)"""


@query("match_text_report", f"""WITH {BASE}, whole AS ({_WHOLE}),
    hits AS (SELECT a.jd_id, a.resume_id, s.k, s.skill, contains(w.body, lower(s.skill)) AS hit
        FROM apps a JOIN jd_hard s USING (jd_id) JOIN whole w USING (resume_id))
    SELECT jd_id, resume_id, coalesce(string_agg(skill, '|' ORDER BY k) FILTER (hit), '无匹配技能') AS matched,
        coalesce(string_agg(skill, '|' ORDER BY k) FILTER (NOT hit), '无缺失') AS missing FROM hits GROUP BY ALL""")
def match_text_report(spark, d):
    """R2"""
    report = paired(spark, d).select(
        "jd_id", "resume_id", M.text_match_report(F.col("hard_words"), F.col("whole_hits")).alias("r"))
    return report.select("jd_id", "resume_id", F.array_join("r.matched", "|").alias("matched"),
                         F.array_join("r.missing", "|").alias("missing"))


_SCORED = """
keywords AS (SELECT jd_id, unnest([skill_1, skill_2, skill_3, soft_1, soft_2]) AS word FROM postings),
scored AS MATERIALIZED (SELECT a.jd_id, a.resume_id, j.pos, any_value(j.order_key) AS order_key,
    any_value(j.company) AS company, any_value(j.position) AS position, any_value(j.duties) AS duties,
    any_value(j.start_date) AS start_date, any_value(j.end_date) AS end_date,
    count(*) FILTER (contains(j.job_text, lower(w.word))) AS score
    FROM apps a JOIN jobs j USING (resume_id) JOIN keywords w USING (jd_id) GROUP BY a.jd_id, a.resume_id, j.pos),
ranked AS MATERIALIZED (SELECT s.*, row_number() OVER (PARTITION BY jd_id, resume_id ORDER BY score DESC, pos) AS rn,
    contains(lower(duties), lower(skill_1)) OR contains(lower(duties), lower(skill_2)) OR contains(lower(duties), lower(skill_3))
    AS hit FROM scored s JOIN postings p USING (jd_id))"""


@query("match_skill_hits", f"""WITH {BASE},
    words AS (SELECT DISTINCT lower(skill) AS word FROM (SELECT skill FROM jd_hard UNION ALL SELECT skill FROM jd_soft) WHERE skill <> '')
    SELECT c.resume_id, word, cast((length(body) - length(replace(body, word, ''))) // length(word) AS bigint) AS n
    FROM people c JOIN history h USING (resume_id), words WHERE contains(body, word)""")
def match_skill_hits(spark, d):
    """Which posting skills each résumé's history holds, and how often; one pass per résumé."""
    return matching.resume_hits(derive.resumes(spark, d), derive.postings(spark, d))


@query("match_relevance_rank", f"""WITH {BASE}, {_SCORED}
    SELECT jd_id, resume_id, string_agg(company, '|' ORDER BY rn) AS companies, max(score) AS best FROM ranked GROUP BY ALL""")
def match_relevance_rank(spark, d):
    """R3"""
    words = F.concat("hard_words.code", "soft_words.code")
    ranked = paired(spark, d).filter(F.size("work_experience") > 0).select(
        "jd_id", "resume_id", M.by_relevance(F.col("work_experience"), F.col("job_hits"), words).alias("w"),
        F.array_max(M.relevance_scores(F.col("job_hits"), words)).alias("best"))
    return ranked.select("jd_id", "resume_id", F.array_join("w.company", "|").alias("companies"),
                         F.col("best").cast("bigint").alias("best"))


@query("match_relevance_label", f"""WITH {BASE}, {_SCORED}
    SELECT jd_id, resume_id, string_agg(CASE WHEN hit THEN '高' ELSE '中' END, '' ORDER BY pos) AS labels FROM ranked GROUP BY ALL""")
def match_relevance_label(spark, d):
    """R4"""
    built = paired(spark, d).filter(F.size("work_experience") > 0).select(
        "jd_id", "resume_id", R.experience_section(
            F.col("job_sections"), M.relevance_labels(F.col("duty_hits"), F.col("hard_words.code"))).alias("e"))
    return built.select("jd_id", "resume_id", F.array_join("e.jd_relevance", "").alias("labels"))


_PERIOD = "concat_ws(' - ', nullif(start_date, ''), nullif(end_date, ''))"


@query("match_preview", f"""WITH {BASE}, {_SCORED}
    SELECT jd_id, resume_id, string_agg(company || '/' || {_PERIOD} || '/' || duties, '|' ORDER BY rn) FILTER (rn <= 6) AS desktop,
        string_agg(company, '|' ORDER BY rn) FILTER (rn <= 3) AS mobile, any_value(school || '/' || degree) AS schools
    FROM ranked JOIN people USING (resume_id) GROUP BY ALL""")
def match_preview(spark, d):
    """R5"""
    rows = matching.tailor(paired(spark, d).filter(F.size("work_experience") > 0))
    shown = F.transform(M.preview_jobs(F.col("experience"), "desktop"), lambda j: F.concat(
        j["company"], F.lit("/"), j["period"], F.lit("/"), F.array_join(j["bullets"], ",")))
    return rows.select(
        "jd_id", "resume_id", F.array_join(shown, "|").alias("desktop"),
        F.array_join(F.transform(M.preview_jobs(F.col("experience"), "mobile"), lambda j: j["company"]), "|").alias("mobile"),
        F.array_join(F.transform(M.preview_schools(F.col("education")), lambda e: F.concat_ws("/", e["school"], e["degree"])), "|").alias("schools"))


@query("match_summary", f"""WITH {BASE}, {_MATCHED}
    SELECT jd_id, resume_id, coalesce(nullif(c.name, ''), '求职者') || '，' || coalesce(h.n_jobs, 0) || '+年经验，'
        || shown || '等技能匹配JD要求。' AS summary
    FROM matched JOIN people c USING (resume_id) LEFT JOIN history h USING (resume_id)""")
def match_summary(spark, d):
    """R6"""
    return matching.tailor(paired(spark, d)).select("jd_id", "resume_id", "summary")


_STOP = "('英语', 'English', '中文', 'CET-4', 'CET-6', 'IELTS', 'TOEFL')"
_TECH = (f"concat_ws('{{sep}}', CASE WHEN list_skill_1 NOT IN {_STOP} THEN list_skill_1 END, CASE WHEN list_skill_2 NOT IN"
         f" {_STOP} THEN list_skill_2 END, CASE WHEN list_skill_3 NOT IN {_STOP} THEN list_skill_3 END)")


def _intro_sql(lang):
    if lang == "zh":
        text = ("'面试官您好，我是' || coalesce(nullif(c.name, ''), '求职者') || '。' || CASE WHEN c.target_job <> '' THEN '应聘' || "
                f"c.target_job || '岗位。' ELSE '' END || '我熟练掌握' || {_TECH.format(sep='、')} || '。' || CASE WHEN r.company <> '' THEN "
                "'曾在' || r.company || '担任' || r.position || '，' || substring(r.duties, 1, 60) || '。' ELSE '' END || '期待能为团队贡献价值，谢谢。'")
    else:
        text = ("'Hello, I''m ' || coalesce(nullif(c.name, ''), 'a candidate') || '. ' || CASE WHEN c.target_job <> '' THEN "
                f"'Applying for ' || c.target_job || '. ' ELSE '' END || 'My skills include ' || {_TECH.format(sep=', ')} || '. ' || "
                "CASE WHEN r.company <> '' THEN 'Most recently at ' || r.company || ' as ' || coalesce(nullif(r.position, ''), "
                "'a team member') || '. ' ELSE '' END || 'I''m excited about this opportunity. Thank you.'")
    limit, rate = fixed.INTRO_LIMIT[lang], fixed.INTRO_RATE[lang]
    cut = f"CASE WHEN length({lang}) > {limit} THEN left({lang}, {limit - 3}) || '...' ELSE {lang} END"
    return text, f"{cut} AS {lang}, cast(round_even(length({cut}) * 60 / {rate}, 0) AS integer) AS {lang}_seconds"


@query("match_self_intro", f"""WITH {BASE}, {_SCORED},
    t AS (SELECT a.jd_id, a.resume_id, {_intro_sql('zh')[0]} AS zh, {_intro_sql('en')[0]} AS en
        FROM apps a JOIN people c USING (resume_id)
        LEFT JOIN ranked r ON r.jd_id = a.jd_id AND r.resume_id = a.resume_id AND r.rn = 1)
    SELECT jd_id, resume_id, {_intro_sql('zh')[1]}, {_intro_sql('en')[1]} FROM t""")
def match_self_intro(spark, d):
    """R7"""
    rows = matching.tailor(paired(spark, d))
    return rows.select(
        "jd_id", "resume_id", F.col("intro_zh.text").alias("zh"), F.col("intro_zh.estimated_seconds").alias("zh_seconds"),
        F.col("intro_en.text").alias("en"), F.col("intro_en.estimated_seconds").alias("en_seconds"))


@query("match_request_payload", f"""WITH {BASE},
    top3 AS (SELECT resume_id, list({{'company': company, 'position': position, 'duties': left(duties, 100)}} ORDER BY pos)
        AS work FROM jobs WHERE pos < 3 GROUP BY ALL)
    SELECT a.jd_id, a.resume_id, cast(to_json({{'posting': {{'position': p.position, 'company': p.company,
        'hard_skills': [skill_1, skill_2, skill_3], 'soft_skills': [soft_1, soft_2], 'years': years_required,
        'education': education_required}}, 'resume': {{'name': c.name, 'education': [{{'school': school, 'major': major}}],
        'work': coalesce(t.work, []), 'skills': [list_skill_1, list_skill_2, list_skill_3]}}}}) AS string) AS payload
    FROM apps a JOIN postings p USING (jd_id) JOIN people c USING (resume_id) LEFT JOIN top3 t USING (resume_id)""")
def match_request_payload(spark, d):
    """R8"""
    return paired(spark, d).select("jd_id", "resume_id", M.request_payload().alias("payload"))


_EXPORT = f"""WITH {BASE}, {_MATCHED}, {_SCORED},
    own AS (SELECT jd_id, resume_id, coalesce(list(skill ORDER BY k) FILTER (hit), []) AS yes,
        coalesce(list(skill ORDER BY k) FILTER (NOT hit), []) AS no FROM hits GROUP BY ALL),
    found AS (SELECT a.jd_id, a.resume_id, s.k, s.skill, contains(w.body, lower(s.skill)) AS hit
        FROM apps a JOIN jd_hard s USING (jd_id) JOIN ({_WHOLE}) w USING (resume_id)),
    analysis AS (SELECT jd_id, resume_id, to_json({{'matched': coalesce(list(skill ORDER BY k) FILTER (hit), ['无匹配技能']),
        'missing': coalesce(list(skill ORDER BY k) FILTER (NOT hit), ['无缺失'])}}) AS j FROM found GROUP BY ALL),
    lived AS (SELECT jd_id, resume_id, to_json(list({{'company': coalesce(company, ''), 'position': coalesce(position, ''), 'period': {_PERIOD},
        'bullets': CASE WHEN coalesce(duties, '') = '' THEN [] ELSE [duties] END, 'jd_relevance': CASE WHEN hit THEN '高' ELSE '中' END,
        'source_index': []::integer[]}} ORDER BY rn)) AS j FROM ranked GROUP BY ALL),
    said AS (SELECT a.jd_id, a.resume_id, {_intro_sql('zh')[0]} AS zh, {_intro_sql('en')[0]} AS en
        FROM apps a JOIN people c USING (resume_id) LEFT JOIN ranked r ON r.jd_id = a.jd_id AND r.resume_id = a.resume_id AND r.rn = 1),
    intro AS (SELECT jd_id, resume_id, {_intro_sql('zh')[1]}, {_intro_sql('en')[1]} FROM said),
    speech AS (SELECT jd_id, resume_id, to_json({{'zh': {{'text': zh, 'estimated_seconds': zh_seconds, 'char_count': length(zh)}},
        'en': {{'text': en, 'estimated_seconds': en_seconds, 'char_count': length(en)}}}}) AS j FROM intro)
    SELECT m.jd_id, m.resume_id, cast(k.pos AS integer) AS pos, k.title, CASE k.pos WHEN 0 THEN cast(to_json({{'name': coalesce(c.name, ''),
        'phone': coalesce(c.phone, ''), 'email': coalesce(c.email, ''), 'city': coalesce(c.city, ''),
        'target_job': coalesce(c.target_job, ''), 'salary': coalesce(c.expect_salary, '')}}) AS string)
        WHEN 1 THEN coalesce(nullif(c.name, ''), '求职者') || '，' || coalesce(h.n_jobs, 0) || '+年经验，' || shown || '等技能匹配JD要求。'
        WHEN 2 THEN cast(to_json([{{'school': school, 'major': major, 'degree': degree, 'period': '2010.9 - 2014.6'}}]) AS string)
        WHEN 3 THEN cast(lived.j AS string)
        ELSE cast(to_json({{'technical': list_filter([list_skill_1, list_skill_2, list_skill_3], lambda x: x <> '' AND x NOT IN {_STOP}),
        'languages': [c.language], 'certificates': [c.certificate], 'jd_matched': own.yes, 'jd_missing': own.no}}) AS string) END AS content,
        cast(speech.j AS string) AS self_intro, cast(analysis.j AS string) AS jd_analysis
    FROM matched m JOIN people c USING (resume_id) LEFT JOIN history h USING (resume_id) JOIN own USING (jd_id, resume_id)
    JOIN analysis USING (jd_id, resume_id) JOIN lived USING (jd_id, resume_id) JOIN speech USING (jd_id, resume_id)
    CROSS JOIN (VALUES (0, '基本信息'), (1, '个人概述'), (2, '教育经历'), (3, '工作经历'), (4, '技能证书')) k(pos, title)"""


@query("tailor_export", _EXPORT)
def tailor_export(spark, d):
    """Every section with its content, both introductions and the analysis."""
    return matching.export_rows(matching.tailor(paired(spark, d, exported=True)))


# --- records -----------------------------------------------------------------------------------

_REGEX_SQL = f"""SELECT doc_id, flatten([{', '.join(_skill_hits(p) for p in fixed.HARD_SKILL_PATTERNS)}]) AS hits,
    {first("text", "(?i)" + unicode(rf"(?:{'|'.join(fixed.POSITION_WORDS)})(?:\s*[（(]\s*\w+\s*[）)])?"))} AS guessed_position,
    {first("text", "(?i)" + unicode(rf"[{CJK}A-Za-z]{{2,20}}(?:{'|'.join(fixed.POSTING_COMPANY_SUFFIXES)})"))} AS guessed_company,
    {first("text", "|".join(fixed.CITIES + fixed.REMOTE_LABELS))} AS location FROM ({POSTINGS})"""


def _fields(extractors):
    """Every field of a text, each in its own column: of a struct, Spark would work out also those that nothing reads."""
    return [fn(F.col("text")).alias(f"_{name}") for name, fn in extractors.items()]


def _record(extractors):
    return F.struct(*[F.col(f"_{name}").alias(name) for name in extractors])


@query("record_merge_posting", f"""WITH x AS ({_REGEX_SQL}), m AS ({MODEL_JSON_SQL})
    SELECT doc_id, coalesce(nullif(found ->> '$.position', ''), guessed_position) AS position,
        coalesce(nullif(found ->> '$.company', ''), guessed_company) AS company, location,
        array_to_string(list_sort(list_distinct(list_concat(hits, coalesce(found ->> '$.hard_skills[*]', [])))), '|') AS hard_skills,
        cast(len(list_distinct(hits)) AS integer) AS skills_count FROM x JOIN m USING (doc_id)""")
def record_merge_posting(spark, d):
    """M1"""
    regex = derive.posting_texts(spark, d).select("doc_id", *_fields(X.POSTING_FIELDS))
    replies = derive.as_frame(derive.load(spark, d, "documents"), {"doc_id": "doc_id", "c": derive.MODEL_REPLY})
    model = replies.select("doc_id", F.from_json(X.model_json(F.col("c")), R.RAW_POSTING_SCHEMA).alias("model"))
    merged = regex.join(model, "doc_id", "left").select("doc_id", *R.merged_posting(F.col("model"), _record(X.POSTING_FIELDS)))
    return merged.select("doc_id", "position", "company", "location", F.array_join("hard_skills", "|").alias("hard_skills"),
                         "regex_fallback.skills_count")


_HARD_SQL = f"""SELECT doc_id, {first('text', unicode(r'1[3-9]\d{9}'))} AS phone,
    {first('text', r'[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')} AS email,
    {first('text', '|'.join(fixed.CITIES))} AS city FROM ({RESUMES})"""


@query("record_merge_resume", f"""WITH {BASE}, hard AS ({_HARD_SQL})
    SELECT c.resume_id, coalesce(nullif(c.phone, ''), hard.phone) AS phone, coalesce(nullif(c.email, ''), hard.email) AS email,
        coalesce(nullif(c.city, ''), hard.city) AS city, c.target_job, c.school, c.degree,
        concat_ws('|', list_skill_1 || '/工具', list_skill_2 || '/AI工具') AS skills, c.certificate, c.language,
        coalesce((SELECT string_agg(duties, '|' ORDER BY pos) FROM jobs j WHERE j.resume_id = c.resume_id), '') AS duties
    FROM people c LEFT JOIN hard ON hard.doc_id = c.resume_id""")
def record_merge_resume(spark, d):
    """M2"""
    raw = raw_resumes(spark, d)
    hard = derive.resume_texts(spark, d).select(F.col("doc_id").alias("resume_id"), *_fields(X.RESUME_FIELDS))
    merged = raw.join(hard, "resume_id", "left").select("resume_id", *R.merged_resume(F.col("raw"), _record(X.RESUME_FIELDS)))
    skills = F.transform("skills", lambda s: F.concat(s["name"], F.lit("/"), s["category"]))
    return merged.select(
        "resume_id", "basic_info.phone", "basic_info.email", "basic_info.city", "basic_info.target_job",
        F.get("education.school", 0).alias("school"), F.get("education.degree", 0).alias("degree"),
        F.array_join(skills, "|").alias("skills"), F.get("certificates.name", 0).alias("certificate"),
        F.get("languages.name", 0).alias("language"),
        F.array_join("work_experience.duties", "|").alias("duties"))


def raw_resumes(spark, d):
    """Résumés in the shape a model returns them."""
    r = derive.resumes(spark, d)
    return r.selectExpr("resume_id", """named_struct(
        'base_info', named_struct('name', basic_info.name, 'phone', basic_info.phone, 'email', basic_info.email,
            'target_city', basic_info.city, 'target_position', basic_info.target_job, 'expected_salary',
            basic_info.expect_salary, 'available_onboard_time', basic_info.onboard_time, 'source_index', array(0)),
        'education_list', transform(education, e -> named_struct('school_name', e.school, 'major', e.major, 'degree', e.degree,
            'start_date', e.start_date, 'end_date', e.end_date, 'scholarship_awards', e.awards, 'source_index', e.source_index)),
        'work_experience_list', transform(work_experience, w -> named_struct('company', w.company, 'position', w.position,
            'start_date', w.start_date, 'end_date', w.end_date, 'job_duty', w.duties, 'source_index', w.source_index)),
        'project_list', transform(projects, p -> named_struct('project_name', p.name, 'project_time', '', 'responsibility',
            p.description, 'project_data', p.results, 'source_index', p.source_index)),
        'skill_certificate', named_struct('language_cert', languages.name, 'software_skill', array(skills[0].name),
            'ai_tool_mastered', array(skills[1].name), 'other_cert', certificates.name, 'source_index', array(1))) AS raw""")


@query("record_keywords", f"""WITH {BASE}
    SELECT jd_id, concat_ws('|', skill_1, skill_2, skill_3) AS hard_skills, concat_ws('|', soft_1, soft_2) AS soft_skills,
        company AS industry, years_required AS years, education_required AS education, position, company FROM postings""")
def record_keywords(spark, d):
    """M3"""
    rows = derive.postings(spark, d).select("jd_id", *R.match_keywords())
    lists = {c: F.array_join(c, "|") for c in ("hard_skills", "soft_skills", "industry")}
    return rows.withColumns(lists)


@query("record_material", f"""WITH {BASE}
    SELECT resume_id, name, phone, email, city, target_job, expect_salary AS salary,
        cast(coalesce(n_jobs, 0) AS integer) AS jobs, cast(coalesce(n_projects, 0) AS integer) AS projects, certificate
    FROM people LEFT JOIN history USING (resume_id)""")
def record_material(spark, d):
    """M4"""
    rows = derive.resumes(spark, d).select("resume_id", *R.material_record())
    return rows.select("resume_id", "identity.*", F.size("work_experience").alias("jobs"), F.size("projects").alias("projects"),
                       F.get("certificates.name", 0).alias("certificate"))


@query("record_personal", f"""WITH {BASE}
    SELECT resume_id, coalesce(name, '') AS name, coalesce(phone, '') AS phone, coalesce(email, '') AS email,
        coalesce(city, '') AS city, coalesce(target_job, '') AS target_job, coalesce(expect_salary, '') AS salary FROM people""")
def record_personal(spark, d):
    """M5"""
    return derive.resumes(spark, d).select("resume_id", R.personal_section(F.col("basic_info")).alias("p")).select("resume_id", "p.*")


@query("record_period", f"WITH {BASE} SELECT order_key, {_PERIOD} AS period FROM jobs")
def record_period(spark, d):
    """M6"""
    return derive.jobs(spark, d).select("order_key", R.period(F.col("start_date"), F.col("end_date")).alias("period"))


@query("record_experience", f"""WITH {BASE}
    SELECT a.jd_id, a.resume_id, string_agg(j.company || '/' || coalesce(j.position, '') || '/' ||
        {_PERIOD.replace('start_date', 'j.start_date').replace('end_date', 'j.end_date')} || '/' || j.duties, '|' ORDER BY j.pos)
        AS experience FROM apps a JOIN jobs j USING (resume_id) GROUP BY ALL""")
def record_experience(spark, d):
    """M7"""
    rows = paired(spark, d).filter(F.size("work_experience") > 0).select(
        "jd_id", "resume_id", R.experience_section(
            F.col("job_sections"), M.relevance_labels(F.col("duty_hits"), F.col("hard_words.code"))).alias("e"))
    shown = F.transform("e", lambda j: F.concat_ws("/", j["company"], j["position"], j["period"], F.array_join(j["bullets"], ",")))
    return rows.select("jd_id", "resume_id", F.array_join(shown, "|").alias("experience"))


@query("record_technical_skills", f"WITH {BASE} SELECT resume_id, {_TECH.format(sep='|')} AS technical FROM people")
def record_technical_skills(spark, d):
    """M8"""
    return derive.resumes(spark, d).select("resume_id", F.array_join(R.technical_skills(F.col("skills")), "|").alias("technical"))


_KEY = "'msg_' || cast(c_nationkey + c_custkey % 3 * 10 AS string)"
_DICT = """SELECT 'msg_' || cast(n_nationkey AS string) AS key, 'zh' AS lang, n_name || '国' AS text FROM {nation}
    UNION ALL SELECT 'msg_' || cast(n_nationkey AS string), 'en', n_name FROM {nation} WHERE n_regionkey < 3
    UNION ALL SELECT 'msg_' || cast(n_nationkey + 21 AS string), 'en', 'only ' || n_name FROM {nation} WHERE n_nationkey > 10"""


@query("record_localise", f"""WITH k AS (SELECT c_custkey, {_KEY} AS key FROM customer), dict AS ({_DICT.format(nation='nation')})
    SELECT c_custkey, k.key, coalesce(en.text, zh.text, k.key) AS text FROM k
    LEFT JOIN dict en ON en.key = k.key AND en.lang = 'en' LEFT JOIN dict zh ON zh.key = k.key AND zh.lang = 'zh'""")
def record_localise(spark, d):
    """M9"""
    keys = derive.as_frame(derive.load(spark, d, "customer"), {"c_custkey": "c_custkey", "key": _KEY})
    dictionary = spark.sql(_DICT.format(nation="{nation}"), nation=derive.load(spark, d, "nation"))
    return matching.localised(keys, dictionary, "en")


_TEMPLATE = ("CASE WHEN o_orderkey % 11 = 0 THEN 'code {{order}} of {order}: {who}' WHEN o_orderkey % 11 = 1 THEN 'stray } {order}'"
             " WHEN o_orderstatus = 'F' THEN 'Order {order} for {who}, {who}!' WHEN o_orderstatus = 'O' THEN 'Open {order} {missing}'"
             " ELSE 'plain ' || o_orderpriority END")
_WHO = "CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 5 = 1 THEN '{order}' ELSE 'C' || cast(o_custkey AS string) END"


@query("record_fill_arguments", f"""WITH t AS (SELECT o_orderkey, o_custkey, o_orderstatus, {_TEMPLATE} AS template FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'code {{order}} of ' || o_orderkey || ': ' || coalesce({_WHO}, 'None')
        WHEN o_orderkey % 11 = 1 OR o_orderstatus = 'O' THEN template
        WHEN o_orderstatus = 'F' THEN 'Order ' || o_orderkey || ' for ' || coalesce({_WHO}, 'None') || ', ' || coalesce({_WHO}, 'None') || '!'
        ELSE template END AS text FROM t""")
def record_fill_arguments(spark, d):
    """M10"""
    arguments = F.create_map(
        F.lit("order"), F.col("o_orderkey").cast("string"), F.lit("who"), F.expr(_WHO))
    return derive.load(spark, d, "orders").select(
        "o_orderkey", R.fill_arguments(F.expr(_TEMPLATE), arguments).alias("text"))
