"""Registered queries: interview logs."""

from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.functions import dialog as D
from vitaespark.operators import dialog, matching, ordered
from vitaespark.workload import derive
from vitaespark.workload.pairs import BASE
from vitaespark.workload.registry import query
from vitaespark.workload.sqltext import NL, q, strip

_TURNS = derive.as_sql(derive.TURN, "conversations")
_SKIP = (
    f"(length({strip('said')}) <= 10 AND CASE WHEN lang = 'zh' THEN "
    + "(" + " OR ".join(f"starts_with(lower({strip('said')}), {q(w)})" for w in fixed.SKIP_WORDS["zh"]) + ") ELSE ("
    + " OR ".join(f"starts_with(lower({strip('said')}), {q(w)})" for w in fixed.SKIP_WORDS["en"]) + ") END)"
)


def _skip():
    return D.is_skip(F.col("said"), F.col("lang"))


@query("dialog_skip", f"SELECT conv_id, turn, {_SKIP} AS skip FROM ({_TURNS})")
def dialog_skip(spark, d):
    """I1"""
    return derive.turns(spark, d).select("conv_id", "turn", _skip().alias("skip"))


# The state machine step by step, one recursion level per user turn.
_PHASES = f"""
t AS MATERIALIZED (SELECT conv_id, turn, {_SKIP} AS skip, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n
    FROM ({_TURNS}) WHERE role = 'user'),
m(conv_id, turn, n, phase, rounds) AS (
    SELECT conv_id, turn, n, 0, 1 FROM t WHERE n = 0
    UNION ALL
    SELECT conv_id, turn, n, CASE WHEN r >= CASE p WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 3 ELSE 2 END AND p < 3 THEN p + 1 ELSE p END,
        CASE WHEN r >= CASE p WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 3 ELSE 2 END AND p < 3 THEN 1 ELSE r + 1 END
    FROM (SELECT t.conv_id, t.turn, t.n, CASE WHEN t.skip AND m.phase < 3 THEN m.phase + 1 ELSE m.phase END AS p,
        CASE WHEN t.skip AND m.phase < 3 THEN 0 ELSE m.rounds END AS r
        FROM m JOIN t ON t.conv_id = m.conv_id AND t.n = m.n + 1)),
phased AS (SELECT conv_id, turn, cast(n AS integer) AS question_no, cast(phase AS integer) AS phase,
    cast(n - min(n) OVER (PARTITION BY conv_id, phase) AS integer) AS round_no FROM m)"""


def phased(spark, d):
    return dialog.phases(derive.turns(spark, d), _skip())


@query("dialog_phases", f"WITH RECURSIVE {_PHASES} SELECT * FROM phased")
def dialog_phases(spark, d):
    """I2"""
    return phased(spark, d).select("conv_id", "turn", "question_no", "phase", "round_no")


@query("dialog_phase_rounds", f"WITH RECURSIVE {_PHASES} SELECT conv_id, phase, count(*) AS rounds FROM phased GROUP BY ALL")
def dialog_phase_rounds(spark, d):
    """I3"""
    return dialog.phase_rounds(phased(spark, d))


_TEXT = fixed.INTERVIEW_TEXT["en"]


def _said(name, **values):
    text = q(_TEXT[name])
    for mark, value in values.items():
        text = f"replace({text}, '{{{mark}}}', coalesce({value}, ''))"
    return text


_CLOSING = " ".join(f"WHEN question_no <= {n} THEN replace({q(line)}, '{{target}}', target)" for n, line in zip(
    fixed.CLOSING_LAST_QUESTION, _TEXT["closing"]))


@query("dialog_question_plan", f"""WITH RECURSIVE {BASE}, {_PHASES},
    sessions AS (SELECT DISTINCT conv_id FROM phased),
    seat AS (SELECT conv_id, min(p.jd_id) AS jd_id FROM sessions s JOIN apps p ON p.resume_id = s.conv_id GROUP BY conv_id),
    employers AS (SELECT resume_id, company, min(pos) AS pos, arg_min(position, pos) AS position FROM jobs GROUP BY ALL),
    topics AS (
        SELECT s.conv_id, 1 AS phase, 0 AS grp, 0 AS pos, CASE WHEN c.major <> '' THEN {_said('school_major', school='c.school', major='c.major')}
            ELSE {_said('school_plain', school='c.school')} END AS question FROM seat s JOIN people c ON c.resume_id = s.conv_id
        UNION ALL SELECT s.conv_id, 1, 1, j.pos, {_said('project_plain', project="'Project ' || j.order_key")}
            FROM seat s JOIN jobs j ON j.resume_id = s.conv_id WHERE j.is_project
        UNION ALL SELECT s.conv_id, 1, 2, e.pos, {_said('employer', company='e.company', position='e.position')}
            FROM seat s JOIN employers e ON e.resume_id = s.conv_id
        UNION ALL SELECT s.conv_id, 2, 0, min(k.k), {_said('skill_known', skill='k.skill')}
            FROM seat s JOIN jd_hard k USING (jd_id) GROUP BY s.conv_id, k.skill
        UNION ALL SELECT s.conv_id, 2, 1, e.pos, {_said('result_plain', company='e.company')}
            FROM seat s JOIN employers e ON e.resume_id = s.conv_id),
    plan AS (SELECT *, row_number() OVER (PARTITION BY conv_id, phase ORDER BY grp, pos) - 1 AS round_no FROM topics)
    SELECT x.conv_id, x.turn, x.phase, CASE x.phase WHEN 0 THEN {q(_TEXT['opening'])}
        WHEN 1 THEN coalesce(plan.question, {q(_TEXT['background_done'])}) WHEN 2 THEN coalesce(plan.question, {q(_TEXT['competency_done'])})
        ELSE CASE {_CLOSING} ELSE {q(_TEXT['closing'][3])} END END AS question
    FROM (SELECT phased.*, coalesce(nullif(c.target_job, ''), nullif(p.position, ''), {q(_TEXT['no_target'])}) AS target FROM phased
        LEFT JOIN seat USING (conv_id) LEFT JOIN postings p USING (jd_id)
        LEFT JOIN people c ON c.resume_id = conv_id AND jd_id IS NOT NULL) x
    LEFT JOIN plan ON plan.conv_id = x.conv_id AND plan.phase = x.phase AND plan.round_no = x.round_no""")
def dialog_question_plan(spark, d):
    """I4: conversation n interviews candidate n for the first posting applied to; without one it gets the general questions."""
    turns = derive.turns(spark, d)
    seats = (
        derive.applications(spark, d).groupBy("resume_id").agg(F.min("jd_id").alias("jd_id"))
        .join(turns.select(F.col("conv_id").alias("resume_id")).distinct(), "resume_id", "left_semi")
    )
    records = matching.pair_records(seats, derive.postings(spark, d), derive.resumes(spark, d))
    plan = dialog.question_plan(
        phased(spark, d), records.withColumn("conv_id", F.col("resume_id")), "en", ordered.heavy_keys(turns, "conv_id"))
    return plan.select("conv_id", "turn", "phase", "question")


_OPENINGS = """SELECT CASE item_id WHEN 0 THEN 'hr' WHEN 1 THEN 'hr' WHEN 2 THEN 'tech' ELSE 'p' || cast(item_id AS string) END AS persona,
    CASE item_id WHEN 0 THEN 'zh' WHEN 1 THEN 'en' WHEN 2 THEN 'en' ELSE 'zh' END AS lang, text FROM {benchmark}"""


@query("dialog_openings", f"""WITH o AS ({_OPENINGS.format(benchmark='benchmark')}), t AS ({_TURNS}),
    known AS (SELECT DISTINCT persona FROM o)
    SELECT conv_id, turn, coalesce(own.text, zh.text) AS opening FROM (SELECT t.*, CASE WHEN k.persona IS NULL THEN 'hr'
        ELSE t.persona END AS used FROM t LEFT JOIN known k USING (persona)) s
    LEFT JOIN o own ON own.persona = used AND own.lang = s.lang LEFT JOIN o zh ON zh.persona = 'hr' AND zh.lang = 'zh'""")
def dialog_openings(spark, d):
    """Opening texts come from a table."""
    openings = spark.sql(_OPENINGS.format(benchmark="{benchmark}"), benchmark=derive.load(spark, d, "benchmark"))
    return dialog.opening_lines(derive.turns(spark, d), openings).select("conv_id", "turn", "opening")


_TALK = f"SELECT * FROM ({_TURNS}) WHERE role <> 'system'"


@query("dialog_context", f"""
    SELECT a.conv_id, a.turn, string_agg(b.role || ':' || b.text, {NL} ORDER BY b.turn) AS context
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM ({_TALK})) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM ({_TALK})) b
        ON a.conv_id = b.conv_id AND b.n BETWEEN a.n - 11 AND a.n GROUP BY ALL""")
def dialog_context(spark, d):
    """I6"""
    talk = derive.turns(spark, d).filter("role <> 'system'")
    lines = F.transform("context", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return dialog.rolling_context(talk).select("conv_id", "turn", F.array_join(lines, "\n").alias("context"))


_LINE = "CASE role WHEN 'assistant' THEN 'HR' ELSE '候选人' END || ': ' || "


@query("dialog_transcripts", f"""
    SELECT conv_id, string_agg({_LINE} text, {NL} ORDER BY turn) AS transcript FROM ({_TALK}) GROUP BY ALL""")
def dialog_transcripts(spark, d):
    """I7"""
    return dialog.transcripts(derive.turns(spark, d).filter("role <> 'system'"))


@query("dialog_transcript_lines", f"SELECT conv_id, turn, {_LINE} left(text, 300) AS line FROM ({_TALK})")
def dialog_transcript_lines(spark, d):
    """I7 line by line, with the length that sizes a prompt"""
    return dialog.transcript_lines(derive.turns(spark, d).filter("role <> 'system'"), fixed.TRANSCRIPT_CHARS)


@query("dialog_summary", f"""WITH RECURSIVE {_PHASES}
    SELECT conv_id, count(*) AS messages, coalesce(any_value(n), 0) AS question_count,
        'opening|background|competency|closing' AS phases,
        ['opening', 'background', 'competency', 'closing'][coalesce(any_value(last), 0) + 1] AS current_phase
    FROM ({_TALK}) LEFT JOIN (SELECT conv_id, count(*) AS n, max(phase) AS last FROM phased GROUP BY conv_id) USING (conv_id)
    GROUP BY conv_id""")
def dialog_summary(spark, d):
    """I8"""
    talk = derive.turns(spark, d).filter("role <> 'system'")
    return dialog.session_summary(phased(spark, d), talk).withColumn("phases", F.array_join("phases", "|"))


_TASK = derive._pick("conv_id", "interview", "jd_parse", "chat")
_FULL = "Use only what the source says."


@query("dialog_messages", f"""WITH c AS (SELECT *, {_TASK} AS task FROM ({_TURNS})),
    g AS (SELECT conv_id, any_value(CASE WHEN task IN ('interview', 'generation', 'chat') THEN {q(fixed.SHORT_CONSTRAINT)} ELSE {q(_FULL)} END)
        AS rule, bool_or(role = 'system') AS has_system FROM c GROUP BY conv_id)
    SELECT c.conv_id, CASE WHEN any_value(has_system) THEN '' ELSE 'system:' || any_value(rule) || {NL} END || string_agg(role || ':' ||
        CASE WHEN role = 'system' THEN rule || {NL} || {NL} || text ELSE text END, {NL} ORDER BY turn) AS messages
    FROM c JOIN g USING (conv_id) GROUP BY c.conv_id""")
def dialog_messages(spark, d):
    """I9"""
    lists = derive.turns(spark, d).withColumn("task", F.expr(_TASK)).groupBy("conv_id", "task").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
        lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("m"))
    ready = D.with_constraint(F.col("m"), F.col("task"), _FULL)
    shown = F.transform(ready, lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return lists.select("conv_id", F.array_join(shown, "\n").alias("messages"))
