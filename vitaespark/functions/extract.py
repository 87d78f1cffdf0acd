"""Pattern extraction as column expressions.

"First" extractors give a string or null, "all" extractors an array in text order with
duplicates dropped unless stated.  ``(?iu)`` is case-blind matching over all letters.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.functions.strings import (
    SPACE, WORD, bind, fold_case, regex_all, regex_first, trimmed,
)

_CJK = r"\x{4e00}-\x{9fff}"


def _unicode(pattern: str) -> str:
    """Spell out the shorthand classes, which the JVM otherwise reads as ASCII only."""
    return (
        pattern.replace(r"[-\s", f"[-{SPACE}").replace(r"[\s", f"[{SPACE}")
        .replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        .replace(r"\d", r"\p{Nd}").replace(r"\w", f"[{WORD}]")
    )


def leading_literal(pattern: str) -> str:
    """The fixed text every match of a pattern starts with, in lower case."""
    found = re.match(r"(?:\\[^a-zA-Z]|[A-Za-z0-9#])+", pattern).group(0)
    if pattern[len(found):len(found) + 1] in ("?", "*"):
        found = found[:-1]
    return found.replace("\\", "").lower()


def posting_skills(text: Column) -> Column:
    """Skills by pattern order, then position; spellings that differ are kept apart.

    A cheap search for the fixed start of each pattern decides whether its expression runs.
    """

    def hits(folded, pattern):
        found = regex_all(text, "(?iU)" + _unicode(pattern))
        return F.when(F.contains(folded, F.lit(leading_literal(pattern))), found)

    return bind(
        fold_case(text),
        lambda folded: F.array_distinct(
            F.flatten(F.array_compact(F.array(*[hits(folded, p) for p in fixed.HARD_SKILL_PATTERNS])))
        ),
    )


def education_label(text: Column) -> Column:
    """E2."""
    return regex_first(text, "(?iu)" + "|".join(fixed.EDUCATION_LABELS))


def salary_range(text: Column) -> Column:
    """E3."""
    return regex_first(text, _unicode("|".join(fixed.SALARY_SHAPES)))


def years_required(text: Column, include_at_least: bool = False) -> Column:
    """The largest plausible number of years, as ``5年``.

    ``3年以上`` is left out unless ``include_at_least`` is set.
    """
    tail = "" if include_at_least else r"(?!\s*(?:以|之))"
    pattern = _unicode(r"(\d+)[\s-]*(?:" + fixed.YEARS_UNITS + ")" + tail)
    numbers = F.transform(regex_all(text, "(?iu)" + pattern, 1), lambda x: x.try_cast("int"))
    kept = F.filter(numbers, lambda x: x.between(fixed.YEARS_MIN, fixed.YEARS_MAX))
    return F.concat(F.array_max(kept).cast("string"), F.lit("年"))


def position_guess(text: Column) -> Column:
    """E5: first position word with an optional bracketed suffix."""
    words = "|".join(fixed.POSITION_WORDS)
    return regex_first(text, "(?iu)" + _unicode(rf"(?:{words})(?:\s*[（(]\s*\w+\s*[）)])?"))


def company_guess(text: Column) -> Column:
    """Letters followed by a company suffix.

    Two letters before a suffix, quickly looked for, tell whether there is a match at all.
    """
    suffixes = "|".join(fixed.POSTING_COMPANY_SUFFIXES)

    def shape(letters):
        return "(?iu)" + _unicode(rf"[{_CJK}A-Za-z]{{{letters}}}(?:{suffixes})")

    return F.when(text.rlike(shape("2")), regex_first(text, shape("2,20")))


def location(text: Column) -> Column:
    """First city or remote label."""
    return regex_first(text, "|".join(fixed.CITIES + fixed.REMOTE_LABELS))


def person_name(text: Column) -> Column:
    """A labelled name, else a short CJK line right above a phone line."""
    labelled = regex_first(text, _unicode(r"姓\s*名[：:\s]*([^\n,，。.\d\s]{2,6})".replace(
        r"[：:\s]", f"[：:{SPACE}]").replace(r"\d\s]", rf"\p{{Nd}}{SPACE}]")), 1)
    phone = "|".join(fixed.PHONE_LABELS)
    above = regex_first(
        text, _unicode(rf"(?md)^([{_CJK}·]{{2,4}})\s*\n\s*(?:{phone}|1[3-9]\d)"), 1
    )
    return trimmed(F.coalesce(labelled, above))


def phone(text: Column) -> Column:
    """First mobile number, also inside a longer run of digits."""
    return regex_first(text, _unicode(r"1[3-9]\d{9}"))


def email(text: Column) -> Column:
    """E10."""
    return regex_first(text, r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")


def city(text: Column) -> Column:
    """E11."""
    return regex_first(text, "|".join(fixed.CITIES))


def schools(text: Column) -> Column:
    """E12."""
    suffixes = "|".join(fixed.SCHOOL_SUFFIXES)
    found = regex_all(text, f"(?iu)[{_CJK}]{{2,8}}(?:{suffixes})")
    return F.array_distinct(F.filter(found, lambda x: F.length(x) >= 4))


def majors(text: Column) -> Column:
    """Labelled values first, then subject words."""
    labelled = regex_all(text, f"(?:专业|Major)[：:{SPACE}]*([^\\n,，。.]{{2,20}})", 1)
    stems, ends = "|".join(fixed.MAJOR_STEMS), "|".join(fixed.MAJOR_ENDINGS)
    words = regex_all(text, f"(?:{stems})(?:{ends})?")
    return F.array_distinct(F.transform(F.concat(labelled, words), trimmed))


def degrees(text: Column) -> Column:
    """The first degree word as an array, empty when there is none."""
    return F.array_compact(F.array(regex_first(text, "(?iu)" + "|".join(fixed.DEGREE_WORDS))))


def employers(text: Column) -> Column:
    """Names with a CJK suffix, then names with a Latin suffix."""
    cjk, latin = "|".join(fixed.EMPLOYER_SUFFIXES_CJK), "|".join(fixed.EMPLOYER_SUFFIXES_LATIN)
    first = regex_all(text, f"(?iu)[{_CJK}]{{2,15}}(?:{cjk})")
    second = regex_all(text, f"(?iud)[{_CJK}A-Za-z]{{2,20}}(?:{latin})(?:\\.|$|[{SPACE}])")
    return F.array_distinct(F.transform(F.concat(first, second), trimmed))


def date_ranges(text: Column) -> Column:
    """All ranges, repeats kept."""
    day = r"(?:19|20)\d{2}[.年/-]\d{1,2}"
    pattern = day + r"(?:[.月/-]\d{1,2}[日号]?)?\s*[-–—至到~]\s*(?:至今|现在|present|" + day + ")"
    return regex_all(text, "(?iu)" + _unicode(pattern))


def resume_skills(text: Column, limit: int | None = None) -> Column:
    """Distinct spellings, sorted; only the first ``limit`` of them if that is given."""
    found = F.array_sort(F.array_distinct(regex_all(text, "(?iu)" + "|".join(fixed.RESUME_SKILL_WORDS))))
    return found if limit is None else F.slice(found, 1, limit)


def year_of(value: Column) -> Column:
    """The first four digits in a row, as a number."""
    return F.regexp_extract(value, r"(\p{Nd}{4})", 1).try_cast("int")


def model_json(content: Column) -> Column:
    """JSON text of a model response: the whole reply, else a fenced object, else the outer braces."""
    fenced = F.regexp_extract(content, f"```(?:json)?[{SPACE}]*(\\{{[\\s\\S]*?\\}})[{SPACE}]*```", 1)
    braces = F.regexp_extract(content, r"\{[\s\S]*\}", 0)
    valid = [
        F.when(F.try_parse_json(part).isNotNull(), part) for part in (content, fenced, braces)
    ]
    return F.coalesce(*valid)


def regex_summary(text: Column) -> Column:
    """What the patterns alone found, kept beside a merged record."""
    return F.struct(
        F.size(posting_skills(text)).alias("skills_count"),
        position_guess(text).alias("guessed_position"),
        company_guess(text).alias("guessed_company"),
        location(text).alias("location"),
    )


POSTING_FIELDS = {
    "hard_skills": posting_skills, "education_required": education_label, "salary_range": salary_range,
    "years_required": years_required, "guessed_position": position_guess,
    "guessed_company": company_guess, "location": location,
}
RESUME_FIELDS = {
    "name": person_name, "phone": phone, "email": email, "city": city, "schools": schools,
    "majors": majors, "degrees": degrees, "companies": employers, "dates": date_ranges,
    "skills_detected": resume_skills,
}
