"""Interview turns as column expressions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.functions.matching import in_some_name
from vitaespark.functions.strings import bind, fill_template, first_present, or_empty, trimmed, unempty

LIMITS = [limit for _, limit in fixed.PHASES]
# No phase starts later than this question, so later turns cannot change where phases start.
DECIDING_TURNS = sum(LIMITS[:-1]) + 1


def is_skip(said: Column, lang: Column) -> Column:
    """A short text that starts with a skip word of its language."""
    text = F.lower(trimmed(said))

    def starts(code):
        return text.rlike("^(?:" + "|".join(map(re.escape, fixed.SKIP_WORDS[code])) + ")")

    return (F.length(text) <= fixed.SKIP_MAX_CHARS) & F.when(lang == "zh", starts("zh")).otherwise(starts("en"))


def phase_starts(skips: Column) -> Column:
    """Question number at which each phase after the first one starts.

    ``skips`` holds the skip flags of the first turns.  A phase that starts at turn t ends
    at the first later skip, or after its limit of turns, whichever comes first; so the
    whole machine is a few lookups and needs no fold over the turns.
    """
    def after(starts, phase):
        begun = F.element_at(starts, -1)
        skip = F.array_position(F.slice(skips, begun + 2, LIMITS[phase]), F.lit(True)).cast("int")
        lasts = F.coalesce(F.nullif(skip, F.lit(0)), F.lit(LIMITS[phase]))
        return F.concat(starts, F.array(begun + lasts))

    starts = F.array(F.lit(0))
    for phase in range(len(LIMITS) - 1):
        starts = bind(starts, lambda found, phase=phase: after(found, phase))
    return F.slice(starts, 2, len(LIMITS) - 1)


def phase_at(question_no: Column, starts: Column) -> Column:
    return F.size(F.filter(starts, lambda s: s <= question_no))


def phase_key(phase: Column) -> Column:
    return F.element_at(F.array(*[F.lit(key) for key, _ in fixed.PHASES]), phase + 1)


def with_constraint(messages: Column, task_type: Column, full_text: str) -> Column:
    """Put the standing constraint before the system message, or add one; short for talk tasks."""
    if not full_text:
        return messages
    text = F.when(task_type.isin(fixed.CONVERSATIONAL_TASKS), fixed.SHORT_CONSTRAINT).otherwise(full_text)

    def prefixed(m):
        content = F.when(m["role"] == "system", F.concat(text, F.lit("\n\n"), or_empty(m["content"])))
        return F.struct(m["role"].alias("role"), content.otherwise(m["content"]).alias("content"))

    first = F.array(F.struct(F.lit("system").alias("role"), text.alias("content")))
    plain = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return F.when(F.exists(messages, lambda m: F.coalesce(m["role"] == "system", F.lit(False))),
                  F.transform(messages, prefixed)).otherwise(F.concat(first, plain))


def _once(items: Column, key) -> Column:
    """Items with the first of each key only, in order."""
    def first_seen(items, keys):
        return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)

    return bind(items, lambda it: bind(F.transform(it, key), lambda keys: first_seen(it, keys)))


def background_questions(education: Column, projects: Column, work: Column, lang: str) -> Column:
    """I4: what the background phase asks, in order: schools, projects, employers, each once."""
    text = fixed.INTERVIEW_TEXT[lang]

    def school(e):
        named = fill_template(text["school_major"], school=e["school"], major=e["major"])
        return F.when(unempty(e["major"]).isNotNull(), named).otherwise(
            fill_template(text["school_plain"], school=e["school"]))

    def project(p):
        described = first_present(p["description"], p["results"]).isNotNull()
        return F.when(described, fill_template(text["project_described"], project=p["name"])).otherwise(
            fill_template(text["project_plain"], project=p["name"]))

    def employer(w):
        return fill_template(text["employer"], company=w["company"], position=w["position"])

    return F.concat(
        F.transform(_once(education, lambda e: or_empty(e["school"])), school),
        F.transform(_once(projects, lambda p: or_empty(p["name"])), project),
        F.transform(_once(work, lambda w: or_empty(w["company"])), employer),
    )


def competency_questions(hard: Column, name_hits: Column, work: Column, lang: str) -> Column:
    """I4: what the competency phase asks: posting skills, then results per employer."""
    text = fixed.INTERVIEW_TEXT[lang]

    def skill(word):
        return F.when(in_some_name(word, name_hits), fill_template(text["skill_known"], skill=word["name"])).otherwise(
            fill_template(text["skill_unknown"], skill=word["name"]))

    def result(w):
        duties = or_empty(w["duties"])
        measured = F.exists(F.array(*map(F.lit, fixed.RESULT_WORDS)), lambda word: F.contains(duties, word))
        return F.when(measured, fill_template(text["result_measured"], company=w["company"])).otherwise(
            fill_template(text["result_plain"], company=w["company"]))

    return F.concat(
        F.transform(F.array_distinct(hard), skill),
        F.transform(_once(work, lambda w: or_empty(w["company"])), result),
    )


def question_for(phase: Column, question_no: Column, round_no: Column, background: Column, competency: Column,
                 target: Column, lang: str) -> Column:
    """I4: the question of a turn; a phase that has run out of topics gives its closing line."""
    text = fixed.INTERVIEW_TEXT[lang]
    closing = None
    for last, line in zip([*fixed.CLOSING_LAST_QUESTION, None], text["closing"]):
        line = fill_template(line, target=first_present(target, F.lit(text["no_target"])))
        if closing is None:
            closing = F.when(question_no <= last, line)
        elif last is None:
            closing = closing.otherwise(line)
        else:
            closing = closing.when(question_no <= last, line)
    return (
        F.when(phase == 0, text["opening"])
        .when(phase == 1, F.coalesce(F.get(background, round_no), F.lit(text["background_done"])))
        .when(phase == 2, F.coalesce(F.get(competency, round_no), F.lit(text["competency_done"])))
        .otherwise(closing)
    )
