"""Format checks on records and grounding of texts in their source, as column expressions.

Issues are ``struct<type, severity, field, label, matched, msg>``; a check gives an array of them.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.functions.extract import _unicode, year_of
from vitaespark.functions.strings import bind, or_empty, regex_all, trimmed, unempty

ISSUE = "struct<type:string,severity:string,field:string,label:string,matched:string,msg:string>"


def issue(kind, severity, field=None, label=None, matched=None, msg=None) -> Column:
    values = {"type": kind, "severity": severity, "field": field, "label": label, "matched": matched, "msg": msg}
    return F.struct(*[
        (v if isinstance(v, Column) else F.lit(v)).cast("string").alias(k) for k, v in values.items()
    ])


def _issues_when(*tests: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(test, found) for test, found in tests]))


def format_issues(info: Column) -> Column:
    """V1, V2: malformed phone or e-mail."""
    phone = F.replace(F.replace(or_empty(info["phone"]), F.lit(" "), F.lit("")), F.lit("-"), F.lit(""))
    email = or_empty(info["email"])
    return _issues_when(
        ((phone != "") & ~phone.rlike(_unicode(fixed.PHONE_FORMAT)),
         issue("format_phone", "warning", field="phone", msg="手机号格式异常")),
        ((email != "") & ~email.rlike(fixed.EMAIL_FORMAT),
         issue("format_email", "warning", field="email", msg="邮箱格式异常")),
    )


def time_issues(work: Column) -> Column:
    """V3: jobs that end in a year before they start; open ends are skipped."""
    def conflict(job):
        return year_of(job["start_date"]) > year_of(job["end_date"])

    def found(job):
        return issue(
            "time_conflict", "block",
            msg=F.concat(F.lit("时间冲突: "), F.coalesce(job["company"], F.lit("?")), F.lit(" "), job["start_date"],
                         F.lit("-"), job["end_date"]),
        )

    return F.transform(F.filter(work, conflict), found)


def missing_issues(info: Column) -> Column:
    """V4: missing name, phone or e-mail."""
    return _issues_when(*[
        (unempty(info[name]).isNull(),
         issue("missing_field", "warning", field=name, msg=f"缺失必填字段: {name}"))
        for name in ("name", "phone", "email")
    ])


def record_issues(info: Column, work: Column) -> Column:
    return F.concat(format_issues(info), time_issues(work), missing_issues(info))


def _claims(text: Column, source: Column, kind, severity, rules) -> list[Column]:
    def unseen(pattern, label):
        pairs = F.arrays_zip(
            regex_all(text, _unicode(pattern)).alias("whole"), regex_all(text, _unicode(pattern), 1).alias("number"))
        kept = F.filter(pairs, lambda x: ~F.contains(source, F.lower(x["number"])))
        return F.transform(kept, lambda x: issue(kind, severity, label=label, matched=x["whole"]))

    return [unseen(pattern, label) for pattern, label in rules]


def _mentions(text: Column, kind, severity, rules) -> list[Column]:
    def mentioned(pattern, label):
        return F.transform(
            regex_all(text, _unicode(pattern)), lambda x: issue(kind, severity, label=label, matched=x))

    return [mentioned(pattern, label) for pattern, label in rules]


def claim_issues(text: Column, source: Column, ungrouped: bool = False) -> Column:
    """V5, V6: figures and team sizes that the source does not hold.

    Two claim shapes carry no figure; they count only with ``ungrouped``.
    """
    def all_claims(source):
        parts = _claims(text, source, "quantified", "warning", fixed.QUANT_CLAIMS)
        if ungrouped:
            parts += _mentions(text, "quantified", "warning", fixed.QUANT_CLAIMS_UNGROUPED)
        parts += _claims(text, source, "fabricated", "block", fixed.TEAM_CLAIMS)
        if ungrouped:
            parts += _mentions(text, "fabricated", "block", fixed.TEAM_CLAIMS_UNGROUPED)
        return F.concat(*parts)

    return bind(F.lower(or_empty(source)), all_claims)


def sentence_grounding(text: Column, source: Column) -> Column:
    """V7: sentences, those with enough of their distinct characters in the source, and the ratio."""
    sentences = F.filter(
        F.transform(F.split(text, fixed.SENTENCE_BREAKS), trimmed),
        lambda s: F.length(s) > fixed.SENTENCE_MIN,
    )

    def distinct_chars(value):
        return F.array_distinct(F.split(value, ""))

    def is_grounded(sentence, seen):
        return bind(
            distinct_chars(sentence),
            lambda chars: F.size(F.filter(chars, lambda c: F.array_contains(seen, c))) / F.size(chars)
            >= fixed.GROUNDED_SHARE,
        )

    def report(sentences, seen):
        grounded = F.size(F.filter(sentences, lambda s: is_grounded(s, seen)))
        ratio = F.when(F.size(sentences) > 0, grounded / F.size(sentences)).otherwise(F.lit(0.0))
        return F.struct(
            F.size(sentences).alias("total_sentences"), grounded.alias("grounded_sentences"),
            F.bround(ratio, 3).alias("grounded_ratio"),
        )

    return bind(
        distinct_chars(or_empty(source)),
        lambda seen: bind(sentences, lambda found: report(found, seen)),
    )


def severity_of(issues: Column) -> Column:
    """V8: block beats warning beats pass."""
    levels = F.transform(issues, lambda i: i["severity"])
    return (
        F.when(F.array_contains(levels, "block"), "block")
        .when(F.size(levels) > 0, "warning").otherwise("pass")
    )


def source_report(text: Column, source: Column, ungrouped: bool = False) -> Column:
    """V5 to V8 as one struct."""
    return bind(
        claim_issues(text, source, ungrouped),
        lambda issues: F.struct(
            severity_of(issues).alias("severity"), issues.alias("issues"),
            sentence_grounding(text, source).alias("grounding"),
        ),
    )
