"""Registered queries: pattern extraction."""

from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.functions import extract as X
from vitaespark.workload import derive
from vitaespark.workload.registry import query
from vitaespark.workload.sqltext import (
    CJK, POSTINGS, RESUMES, SPACE, distinct, every, first, joined, q, strip, unicode,
)

_ANY = "(?i)"


def _list_query(name, op, texts, source, fn, items, keep="x"):
    """Register an extractor that gives a list; lists are compared as joined text."""
    sql = (
        f"WITH found AS (SELECT doc_id, {items} AS items FROM ({source}))"
        f" SELECT doc_id, cast(len({distinct('items')}) AS integer) AS n, {joined(distinct('items'))} AS found FROM found"
    )

    def run(spark, d):
        return texts(spark, d).select("doc_id", fn(F.col("text")).alias("x")).select(
            "doc_id", F.size("x").alias("n"), F.array_join("x", "|").alias("found"))

    run.__doc__ = op
    query(name, sql)(run)


def _first_query(name, op, texts, source, fn, expr):
    def run(spark, d):
        return texts(spark, d).select("doc_id", fn(F.col("text")).alias("found"))

    run.__doc__ = op
    query(name, f"SELECT doc_id, {expr} AS found FROM ({source})")(run)


_POSTING = (derive.posting_texts, POSTINGS)
_RESUME = (derive.resume_texts, RESUMES)


def _skill_hits(pattern: str) -> str:
    bounded = {r"Java\b": 4, r"R\b(?!\w)": 1}
    if pattern in bounded:  # a word end, spelled as "end or a character that is no word character"
        size = bounded[pattern]
        whole = every("text", f"(?i){'Java' if size == 4 else 'R'}(?:$|[^\\p{{L}}\\p{{N}}_])")
        return f"list_transform({whole}, lambda x: x[1:{size}])"
    return every("text", _ANY + unicode(pattern))


_list_query("extract_posting_skills", "E1", *_POSTING, X.posting_skills,
            f"flatten([{', '.join(_skill_hits(p) for p in fixed.HARD_SKILL_PATTERNS)}])")
_first_query("extract_education", "E2", *_POSTING, X.education_label,
             first("text", _ANY + "|".join(fixed.EDUCATION_LABELS)))
_first_query("extract_salary", "E3", *_POSTING, X.salary_range, first("text", unicode("|".join(fixed.SALARY_SHAPES))))
_years = every("text", _ANY + unicode(r"\d+[\s-]*(?:年|years?)(?:\s*[以之])?"))
_first_query(
    "extract_years", "E4", *_POSTING, X.years_required,
    f"cast(list_max(list_filter(list_transform(list_filter({_years}, lambda x: NOT regexp_matches(x, '[以之]$')"
    f" OR regexp_matches(x, {q(_ANY + unicode('years' + chr(92) + 's*[以之]$'))})),"
    f" lambda x: try_cast(regexp_extract(x, '^[0-9]+') AS integer)), lambda x: x BETWEEN 1 AND 30)) AS string) || '年'")
_first_query(
    "extract_position", "E5", *_POSTING, X.position_guess,
    first("text", _ANY + unicode(rf"(?:{'|'.join(fixed.POSITION_WORDS)})(?:\s*[（(]\s*\w+\s*[）)])?")))
_first_query(
    "extract_posting_company", "E6", *_POSTING, X.company_guess,
    first("text", _ANY + unicode(rf"[{CJK}A-Za-z]{{2,20}}(?:{'|'.join(fixed.POSTING_COMPANY_SUFFIXES)})")))
_first_query("extract_location", "E7", *_POSTING, X.location, first("text", "|".join(fixed.CITIES + fixed.REMOTE_LABELS)))
_name_a = first("text", rf"姓[{SPACE}]*名[：:{SPACE}]*([^\n,，。.\p{{Nd}}{SPACE}]{{2,6}})", 1)
_name_b = first("text", rf"(?m)^([{CJK}·]{{2,4}})[{SPACE}]*\n[{SPACE}]*(?:电话|手机|Tel|Phone|1[3-9]\p{{Nd}})", 1)
_first_query("extract_name", "E8", *_RESUME, X.person_name, strip(f"coalesce({_name_a}, {_name_b})"))
_first_query("extract_phone", "E9", *_RESUME, X.phone, first("text", unicode(r"1[3-9]\d{9}")))
_first_query("extract_email", "E10", *_RESUME, X.email,
             first("text", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"))
_first_query("extract_city", "E11", *_RESUME, X.city, first("text", "|".join(fixed.CITIES)))
_list_query("extract_schools", "E12", *_RESUME, X.schools,
            f"list_filter({every('text', _ANY + f'[{CJK}]{{2,8}}(?:' + '|'.join(fixed.SCHOOL_SUFFIXES) + ')')},"
            " lambda x: length(x) >= 4)")
_list_query(
    "extract_majors", "E13", *_RESUME, X.majors,
    f"list_transform(list_concat({every('text', f'(?:专业|Major)[：:{SPACE}]*([^{chr(92)}n,，。.]{{2,20}})', 1)},"
    f" {every('text', '(?:' + '|'.join(fixed.MAJOR_STEMS) + ')(?:' + '|'.join(fixed.MAJOR_ENDINGS) + ')?')}),"
    f" lambda x: {strip('x')})")
_first_degree = first("text", _ANY + "|".join(fixed.DEGREE_WORDS))
_list_query("extract_degrees", "E14", *_RESUME, X.degrees,
            f"CASE WHEN {_first_degree} IS NULL THEN []::string[] ELSE [{_first_degree}] END")
_cjk_names = every("text", f"{_ANY}[{CJK}]{{2,15}}(?:{'|'.join(fixed.EMPLOYER_SUFFIXES_CJK)})")
_latin_names = every("text", f"{_ANY}[{CJK}A-Za-z]{{2,20}}(?:{'|'.join(fixed.EMPLOYER_SUFFIXES_LATIN)})(?:\\.|$|[{SPACE}])")
_list_query("extract_employers", "E15", *_RESUME, X.employers,
            f"list_transform(list_concat({_cjk_names}, {_latin_names}), lambda x: {strip('x')})")

_day = r"(?:19|20)\d{2}[.年/-]\d{1,2}"
_range = unicode(_day + r"(?:[.月/-]\d{1,2}[日号]?)?\s*[-–—至到~]\s*(?:至今|现在|present|" + _day + ")")


@query("extract_date_ranges", f"""
    SELECT doc_id, {joined('list_transform(' + every('text', _ANY + _range) + ', lambda x: x)')} AS found FROM ({RESUMES})""")
def extract_date_ranges(spark, d):
    """E16"""
    return derive.resume_texts(spark, d).select("doc_id", F.array_join(X.date_ranges(F.col("text")), "|").alias("found"))


@query("extract_resume_skills", f"""
    SELECT doc_id, {joined('list_sort(list_distinct(' + every('text', _ANY + '|'.join(fixed.RESUME_SKILL_WORDS)) + '))')} AS found FROM ({RESUMES})""")
def extract_resume_skills(spark, d):
    """E17"""
    return derive.resume_texts(spark, d).select("doc_id", F.array_join(X.resume_skills(F.col("text")), "|").alias("found"))


@query("extract_year", """
    SELECT event_id, try_cast(regexp_extract(props || strftime(ts, ' on %Y.%m') || cast(value AS string),
        '(\\d{4})', 1) AS integer) AS found FROM (SELECT event_id, ts, props, event_id AS value FROM events)""")
def extract_year(spark, d):
    """E18"""
    events = derive.load(spark, d, "events")
    stamp = F.concat(F.col("props"), F.date_format("ts", "' on 'yyyy.MM"), F.col("event_id").cast("string"))
    return events.select("event_id", X.year_of(stamp).alias("found"))


_fenced = f"regexp_extract(c, {q(f'```(?:json)?[{SPACE}]*' + r'(\{[\s\S]*?\})' + f'[{SPACE}]*```')}, 1)"
_braces = r"regexp_extract(c, '\{[\s\S]*\}')"
MODEL_JSON_SQL = f"""SELECT doc_id, CASE WHEN c = '' THEN NULL WHEN json_valid(c) THEN c
    WHEN {_fenced} <> '' AND json_valid({_fenced}) THEN {_fenced}
    WHEN {_braces} <> '' AND json_valid({_braces}) THEN {_braces} END AS found
    FROM (SELECT doc_id, {derive.MODEL_REPLY} AS c FROM documents)"""


@query("extract_model_json", f"""
    SELECT doc_id, found, found IS NULL AS quarantined, found ->> '$.position' AS position FROM ({MODEL_JSON_SQL})""")
def extract_model_json(spark, d):
    """E19"""
    replies = derive.as_frame(derive.load(spark, d, "documents"), {"doc_id": "doc_id", "c": derive.MODEL_REPLY})
    parsed = replies.select("doc_id", X.model_json(F.col("c")).alias("found"))
    return parsed.select(
        "*", F.col("found").isNull().alias("quarantined"), F.get_json_object("found", "$.position").alias("position"))


_hits = f"flatten([{', '.join(_skill_hits(p) for p in fixed.HARD_SKILL_PATTERNS)}])"


@query("extract_regex_summary", f"""
    WITH found AS (SELECT doc_id, text, {_hits} AS items FROM ({POSTINGS}))
    SELECT doc_id, cast(len(list_distinct(items)) AS integer) AS skills_count,
        {first("text", "|".join(fixed.CITIES + fixed.REMOTE_LABELS))} AS location FROM found""")
def extract_regex_summary(spark, d):
    """E20"""
    found = derive.posting_texts(spark, d).select("doc_id", X.regex_summary(F.col("text")).alias("r"))
    return found.select("doc_id", "r.skills_count", "r.location")
