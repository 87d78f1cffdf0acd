"""Registered queries: format checks and grounding (V1 to V9)."""

from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.functions import validation as V
from vitaespark.workload import derive
from vitaespark.workload.pairs import BASE
from vitaespark.workload.registry import query
from vitaespark.workload.sqltext import RESUMES, every, q, strip, unicode

_PHONE = "replace(replace(coalesce(phone, ''), ' ', ''), '-', '')"
_YEAR = "try_cast(regexp_extract({0}, '([0-9]{{4}})', 1) AS integer)"
_START, _END = _YEAR.format("start_date"), _YEAR.format("end_date")
_ISSUES = f"""
    SELECT resume_id, 'format_phone' AS type, 'warning' AS severity, 'phone' AS field, '手机号格式异常' AS msg FROM people
        WHERE {_PHONE} <> '' AND NOT regexp_matches({_PHONE}, {q(fixed.PHONE_FORMAT)})
    UNION ALL SELECT resume_id, 'format_email', 'warning', 'email', '邮箱格式异常' FROM people
        WHERE coalesce(email, '') <> '' AND NOT regexp_matches(email, {q(fixed.EMAIL_FORMAT)})
    UNION ALL SELECT resume_id, 'time_conflict', 'block', NULL, '时间冲突: ' || company || ' ' || start_date || '-' || end_date
        FROM jobs WHERE {_START} > {_END}
    UNION ALL SELECT resume_id, 'missing_field', 'warning', f, '缺失必填字段: ' || f FROM (SELECT resume_id,
        unnest(['name', 'phone', 'email']) AS f, unnest([name, phone, email]) AS v FROM people) WHERE coalesce(v, '') = ''"""


def _issue_query(name, op, condition, pick):
    def run(spark, d):
        rows = derive.resumes(spark, d).select("resume_id", F.explode(pick()).alias("i"))
        return rows.select("resume_id", "i.type", "i.severity", "i.field", "i.msg").filter(condition)

    run.__doc__ = op
    query(name, f"WITH {BASE}, issues AS ({_ISSUES}) SELECT * FROM issues WHERE {condition}")(run)


_issue_query("check_phone", "V1", "type = 'format_phone'", lambda: V.format_issues(F.col("basic_info")))
_issue_query("check_email", "V2", "type = 'format_email'", lambda: V.format_issues(F.col("basic_info")))
_issue_query("check_time_conflict", "V3", "type = 'time_conflict'", lambda: V.time_issues(F.col("work_experience")))
_issue_query("check_missing_fields", "V4", "type = 'missing_field'", lambda: V.missing_issues(F.col("basic_info")))
_issue_query("check_record", "V1 to V4", "true", lambda: V.record_issues(F.col("basic_info"), F.col("work_experience")))

# The text under test is the résumé text; its source is the document with some of the figures.
_SOURCE = f"text || {derive._pick('doc_id', ' 30% and 12', ' 45% 5亿', ' nothing', ' 8')}"
_SOURCE_SQL = f"""SELECT doc_id, r.text AS text, d.source AS source FROM ({RESUMES}) r
    JOIN (SELECT doc_id, {_SOURCE} AS source FROM documents) d USING (doc_id)"""


def generated(spark, d):
    docs = derive.load(spark, d, "documents")
    return derive.as_frame(docs, {"doc_id": "doc_id", "text": derive.RESUME_TEXT, "source": _SOURCE})


def _claim_sql(kind, severity, rules):
    parts = []
    for pattern, label in rules:
        whole, number = every("text", unicode(pattern)), every("text", unicode(pattern), 1)
        parts.append(f"SELECT doc_id, '{kind}' AS type, '{severity}' AS severity, '{label}' AS label, unnest({whole}) AS matched,"
                     f" unnest({number}) AS number, source FROM s")
    return " UNION ALL ".join(parts)


_CLAIMS = f"""s AS MATERIALIZED ({_SOURCE_SQL}),
    claims AS ({_claim_sql('quantified', 'warning', fixed.QUANT_CLAIMS)} UNION ALL
        {_claim_sql('fabricated', 'block', fixed.TEAM_CLAIMS)}),
    claim_issues AS (SELECT doc_id, type, severity, label, matched FROM claims WHERE NOT contains(lower(source), lower(number)))"""


@query("ground_claims", f"WITH {_CLAIMS} SELECT * FROM claim_issues")
def ground_claims(spark, d):
    """V5, V6"""
    rows = generated(spark, d).select("doc_id", F.explode(V.claim_issues(F.col("text"), F.col("source"))).alias("i"))
    return rows.select("doc_id", "i.type", "i.severity", "i.label", "i.matched")


_GROUNDING = f"""
    parts AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[。.!！?？\\n]')) AS part, source FROM s),
    sentences AS (SELECT doc_id, list_distinct(string_split({strip('part')}, '')) AS chars,
        list_distinct(string_split(source, '')) AS seen FROM parts WHERE length({strip('part')}) > 5),
    judged AS (SELECT doc_id, len(list_intersect(chars, seen)) / len(chars) >= 0.1 AS grounded FROM sentences),
    grounding AS (SELECT doc_id, cast(count(*) AS integer) AS total_sentences,
        cast(count(*) FILTER (grounded) AS integer) AS grounded_sentences,
        round_even(count(*) FILTER (grounded) / count(*), 3) AS grounded_ratio FROM judged GROUP BY doc_id)"""


@query("ground_sentences", f"WITH {_CLAIMS}, {_GROUNDING} SELECT * FROM grounding")
def ground_sentences(spark, d):
    """V7"""
    rows = generated(spark, d).select("doc_id", V.sentence_grounding(F.col("text"), F.col("source")).alias("g"))
    return rows.select("doc_id", "g.*")


@query("ground_severity", f"""WITH {_CLAIMS}
    SELECT doc_id, CASE max(CASE severity WHEN 'block' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'block'
        WHEN 1 THEN 'warning' ELSE 'pass' END AS severity FROM s LEFT JOIN claim_issues USING (doc_id) GROUP BY doc_id""")
def ground_severity(spark, d):
    """V8"""
    return generated(spark, d).select(
        "doc_id", V.severity_of(V.claim_issues(F.col("text"), F.col("source"))).alias("severity"))


@query("ground_report", f"""WITH {BASE}, {_CLAIMS}, {_GROUNDING}, issues AS ({_ISSUES}),
    f AS (SELECT resume_id, count(*) AS n, bool_or(severity = 'block') AS blocked FROM issues GROUP BY ALL),
    c AS (SELECT doc_id, count(*) AS n, bool_or(severity = 'block') AS blocked FROM claim_issues GROUP BY ALL)
    SELECT s.doc_id, cast(coalesce(f.n, 0) AS integer) AS format_issues, cast(coalesce(c.n, 0) AS integer) AS source_issues,
        CASE WHEN c.blocked THEN 'block' WHEN c.n > 0 THEN 'warning' ELSE 'pass' END AS severity, g.grounded_ratio
    FROM s LEFT JOIN f ON f.resume_id = s.doc_id LEFT JOIN c ON c.doc_id = s.doc_id
    JOIN grounding g ON g.doc_id = s.doc_id""")
def ground_report(spark, d):
    """V9: the record of candidate n checked together with text n; a text without a record has no format issues."""
    records = derive.resumes(spark, d).select(
        F.col("resume_id").alias("doc_id"), V.record_issues(F.col("basic_info"), F.col("work_experience")).alias("format"))
    texts = generated(spark, d).select("doc_id", V.source_report(F.col("text"), F.col("source")).alias("source"))
    return texts.join(records, "doc_id", "left").select(
        "doc_id", F.when(F.col("format").isNull(), 0).otherwise(F.size("format")).alias("format_issues"), F.size("source.issues").alias("source_issues"),
        "source.severity", "source.grounding.grounded_ratio")
