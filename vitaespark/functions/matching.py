"""Comparison of one posting with one résumé, as column expressions.

The expressions read a row that holds both records (see ``operators.matching.pair_records``).
Everything about a pair is decided inside its row.  What the résumé's texts hold was found before,
once per résumé: a pair looks the codes of its words up in those ``hits`` and reads no text.
Words are ``array<struct<name, code>>`` (see ``operators.multipattern``).
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.functions.strings import bind, fill_template, first_present, or_empty, trimmed, unempty

GAP = "struct<category:string,keyword:string,detail:string,source:string>"


def _gap(category: str, keyword=None, **values: Column) -> Column:
    if keyword is not None:
        values["keyword"] = keyword
    return F.struct(
        F.lit(category).alias("category"),
        (F.lit(None) if keyword is None else keyword).cast("string").alias("keyword"),
        fill_template(fixed.GAP_DETAILS[category], **values).alias("detail"),
        F.lit(fixed.GAP_SOURCES[category]).alias("source"),
    )


def hard_skill_gaps(hard: Column, listed: Column, hits: Column) -> Column:
    """Posting skills absent from the skill list, by whether the text holds them."""
    def gap(word):
        return F.when(F.contains(hits, word["code"]), _gap("skill_detail", word["name"])).otherwise(_gap("skill_gap", word["name"]))

    return F.transform(F.filter(hard, lambda w: ~F.array_contains(listed, F.lower(w["name"]))), gap)


def soft_skill_gaps(soft: Column, hits: Column) -> Column:
    """Soft skills the text does not hold; the skill list does not count."""
    missing = F.filter(soft, lambda w: ~F.contains(hits, w["code"]))
    return F.transform(missing, lambda w: _gap("soft_skill_gap", w["name"]))


def record_gaps(jobs: Column, projects: Column, measured: Column, years: Column, target: Column,
                position: Column) -> Column:
    """Gaps that concern the record as a whole."""
    wanted = F.coalesce(F.regexp_extract(or_empty(years), r"^(\p{Nd}+)", 1).try_cast("bigint"), F.lit(0))
    tests = [
        ((jobs > 0) & ~measured, _gap("quant_data")),
        (projects == 0, _gap("project_detail")),
        ((wanted > 0) & (jobs < F.greatest(F.lit(1), F.floor(wanted / 2))),
         _gap("experience_gap", years=years, count=jobs)),
        (unempty(target).isNull() & unempty(position).isNotNull(), _gap("job_target", position=position)),
    ]
    return F.array_compact(F.array(*[F.when(test, gap) for test, gap in tests]))


#: What ``all_gaps`` reads of either record.
POSTING_READ = ("hard_words", "soft_words", "years_required", "position")
RESUME_READ = ("skill_list_lower", "history_hits", "job_count", "project_count", "measured")


def all_gaps(posting: Callable[[str], Column] = F.col, resume: Callable[[str], Column] = F.col) -> Column:
    """Every gap of a pair in report order: hard skills, soft skills, then the record as a whole.

    ``posting`` and ``resume`` give a field of either record: columns of the row, or fields of a struct.
    """
    hits = resume("history_hits")
    return F.concat(
        hard_skill_gaps(posting("hard_words"), resume("skill_list_lower"), hits),
        soft_skill_gaps(posting("soft_words"), hits),
        record_gaps(resume("job_count"), resume("project_count"), resume("measured"), posting("years_required"),
                    resume("basic_info")["target_job"], posting("position")),
    )


def gaps_of_copies(postings: Column, resumes: Column) -> Column:
    """G8 of every posting with every résumé of a pair's ids, each gap with its place ``pos`` in its report."""
    def report(posting, resume):
        found = F.coalesce(all_gaps(posting.__getitem__, resume.__getitem__), F.array().cast(f"array<{GAP}>"))
        return F.transform(found, lambda g, i: F.struct(
            i.alias("pos"), *[g[name].alias(name) for name in ("category", "keyword", "detail", "source")]))

    return F.flatten(F.transform(postings, lambda p: F.flatten(F.transform(resumes, lambda r: report(p, r)))))


def question_text(category: Column, keyword: Column, detail: Column, lang: str = "zh") -> Column:
    """The question asked for a gap."""
    rules = None
    for name, (zh, en) in fixed.QUESTION_TEMPLATES.items():
        text = fill_template(zh if lang == "zh" else en, keyword=keyword, detail=detail)
        rules = F.when(category == name, text) if rules is None else rules.when(category == name, text)
    return rules


def in_some_name(word: Column, name_hits: Column) -> Column:
    return F.exists(name_hits, lambda hits: F.contains(hits, word["code"]))


def skills_matched(hard: Column, name_hits: Column) -> Column:
    """Posting skills that are part of some skill name."""
    return F.filter(hard, lambda w: in_some_name(w, name_hits))["name"]


def skills_missing(hard: Column, name_hits: Column) -> Column:
    """R1."""
    return F.filter(hard, lambda w: ~in_some_name(w, name_hits))["name"]


def text_match_report(hard: Column, hits: Column, lang: str = "zh") -> Column:
    """R2: posting skills found anywhere in the record, or a stand-in when there are none."""
    found = F.filter(hard, lambda w: F.contains(hits, w["code"]))["name"]
    absent = F.filter(hard, lambda w: ~F.contains(hits, w["code"]))["name"]

    def or_note(skills, note):
        return bind(skills, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(note))))

    return F.struct(
        or_note(found, fixed.NO_MATCH_TEXT[lang]).alias("matched"),
        or_note(absent, fixed.NO_MISSING_TEXT[lang]).alias("missing"),
    )


def relevance_scores(text_hits: Column, codes: Column) -> Column:
    """Number of keywords found per text; a keyword listed twice counts twice."""
    # a keyword that no text holds is sorted out once, and not looked for in each
    some = bind(F.array_join(text_hits, ""), lambda all_hits: F.filter(codes, lambda c: F.contains(all_hits, c)))
    return bind(some, lambda known: F.transform(
        text_hits, lambda hits: F.size(F.filter(known, lambda c: F.contains(hits, c)))))


def relevance_order(text_hits: Column, codes: Column) -> Column:
    """Places of the entries by number of keywords in their text, most first, ties in given order."""
    # rank and place in one number, so that numbers are sorted and not structs
    ranks = F.sort_array(F.transform(
        relevance_scores(text_hits, codes), lambda score, i: F.shiftleft(-F.coalesce(score, F.lit(0)).cast("long"), 32) + i))
    return F.transform(ranks, lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))


def in_order(entries: Column, order: Column) -> Column:
    """Entries at the places that ``relevance_order`` gives."""
    return bind(entries, lambda given: F.transform(order, lambda i: F.get(given, i)))


def by_relevance(entries: Column, text_hits: Column, codes: Column) -> Column:
    """Entries by number of keywords in their text, most first, ties in given order."""
    return in_order(entries, relevance_order(text_hits, codes))


def relevance_labels(duty_hits: Column, codes: Column) -> Column:
    """The label of each job by whether its duties hold a posting skill."""
    return bind(codes, lambda known: F.transform(duty_hits, lambda hits: F.when(
        F.exists(known, lambda c: F.contains(hits, c)), fixed.RELEVANCE_HIGH).otherwise(fixed.RELEVANCE_MEDIUM)))


def preview_jobs(experience: Column, device: str = "desktop") -> Column:
    """The first jobs with their first bullets."""
    return F.transform(
        F.slice(experience, 1, fixed.PREVIEW_JOBS[device]),
        lambda job: job.withField("bullets", F.slice(job["bullets"], 1, fixed.PREVIEW_BULLETS)),
    )


def preview_schools(education: Column) -> Column:
    """R5."""
    return F.slice(education, 1, fixed.PREVIEW_SCHOOLS)


def summary_line(name: Column, job_count: Column, matched: Column, lang: str = "zh") -> Column:
    """The number of jobs stands where the text says years."""
    template, nobody, joiner = fixed.SUMMARY_TEXT[lang]
    return fill_template(
        template, name=first_present(name, F.lit(nobody)), count=job_count,
        skills=F.array_join(F.slice(matched, 1, 3), joiner),
    )


def experience_json(job_json: Column, labels: Column, order: Column) -> Column:
    """R4 as JSON: ranked job sections with their labels, from what ``records.job_json`` made of each job."""
    jobs = bind(job_json, lambda made: bind(labels, lambda known: F.transform(order, lambda i: bind(
        F.get(made, i), lambda job: F.concat(job["head"], F.get(known, i), job["tail"])))))
    return F.concat(F.lit("["), F.array_join(jobs, ","), F.lit("]"))


def self_intro(personal: Column, top: Column, technical: Column, lang: str = "zh") -> Column:
    """Spoken introduction with the first of the ranked jobs, cut to its limit, with reading time."""
    texts, limit = fixed.INTRO_TEXT[lang], fixed.INTRO_LIMIT[lang]

    def says(part, test=None, **values):
        text = fill_template(texts[part], **values)
        return text if test is None else F.when(test, text).otherwise(F.lit(""))

    whole = F.concat(
        says("hello", name=first_present(personal["name"], F.lit(texts["nobody"]))),
        says("target", unempty(personal["target_job"]).isNotNull(), target=personal["target_job"]),
        says("skills", skills=F.array_join(F.slice(technical, 1, 4), texts["joiner"])),
        says("job", unempty(top["company"]).isNotNull(), company=top["company"],
             position=first_present(top["position"], F.lit(texts["no_position"])),
             bullet=F.substring(or_empty(F.get(top["bullets"], 0)), 1, 60)),
        says("bye"),
    )

    def report(text):
        count = F.length(text)
        return F.struct(
            text.alias("text"),
            F.bround(count / fixed.INTRO_RATE[lang] * 60, 0).cast("int").alias("estimated_seconds"),
            count.alias("char_count"),
        )

    cut = bind(whole, lambda text: F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text))
    return bind(cut, report)


def intros_json(personal: Column, sections: Column, technical: Column) -> Column:
    """R7 as JSON in all languages: one for each job as the first of the ranked ones, the last for no job."""
    def said(top):
        return F.to_json(F.struct(*[self_intro(personal, top, technical, code).alias(code) for code in fixed.INTRO_TEXT]))

    jobs = F.transform(sections, lambda s: F.struct(*[s[name].alias(name) for name in ("company", "position", "bullets")]))
    none = F.lit(None).cast("struct<company:string,position:string,bullets:array<string>>")
    tops = F.concat(F.coalesce(jobs, F.array().cast("array<struct<company:string,position:string,bullets:array<string>>>")), F.array(none))
    return F.transform(tops, said)


def request_payload() -> Column:
    """The trimmed pair as JSON, sized for a model request."""
    info = F.col("basic_info")
    posting = F.struct(
        F.col("position"), F.col("company"), F.slice("hard_skills", 1, 8).alias("hard_skills"),
        F.slice("soft_skills", 1, 5).alias("soft_skills"), F.col("years_required").alias("years"),
        F.col("education_required").alias("education"),
    )
    resume = F.struct(
        info["name"].alias("name"),
        F.transform(F.slice("education", 1, 2), lambda e: F.struct(e["school"], e["major"])).alias("education"),
        F.transform(F.slice("work_experience", 1, 3), lambda w: F.struct(
            w["company"], w["position"], F.substring(or_empty(w["duties"]), 1, 100).alias("duties"))).alias("work"),
        F.transform(F.slice("skills", 1, 10), lambda s: s["name"]).alias("skills"),
    )
    return F.to_json(F.struct(posting.alias("posting"), resume.alias("resume")), {"ignoreNullFields": "false"})


def export_contents(personal, summary, education, experience_json, skills) -> list[Column]:
    """Contents of the five sections of an export, as JSON or plain text; experience comes as JSON."""
    return [F.to_json(personal), summary, F.to_json(education), experience_json, F.to_json(skills)]


def export_sections(contents: list[Column]) -> Column:
    """The five titled sections of an export."""
    return F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(title).alias("title"), content.alias("content"))
        for i, (title, content) in enumerate(zip(fixed.EXPORT_TITLES, contents))
    ])


# --- answers to questions -------------------------------------------------------------

def answer_route(category: Column, answer: Column) -> Column:
    """Where an answer goes: ``skills``, ``log`` or ``dropped``."""
    size = F.length(trimmed(or_empty(answer)))
    return (
        F.when((category == "skill_gap") & (size > fixed.ANSWER_SKILL_MIN), "skills")
        .when(size > fixed.ANSWER_LOG_MIN, "log").otherwise("dropped")
    )


def answered_skill(keyword: Column) -> Column:
    """The skill an answer adds."""
    return F.struct(
        keyword.alias("name"), F.lit(fixed.ANSWER_SKILL_CATEGORY).alias("category"),
        F.lit(fixed.ANSWER_SKILL_SOURCE).alias("source"),
    )


def usable_answers(answers: Column) -> Column:
    """Answers long enough to be worked in, without white space around them."""
    return F.filter(
        F.transform(answers, lambda a: F.struct(
            a["category"], or_empty(a["keyword"]).alias("keyword"), trimmed(or_empty(a["answer"])).alias("answer"))),
        lambda a: F.length(a["answer"]) >= fixed.ANSWER_MERGE_MIN,
    )


def enriched_resume(answers: Column, info: Column, skills: Column, work: Column, projects: Column,
                    cuts: dict[str, int] | None = None) -> dict[str, Column]:
    """A résumé with the answers of one pair worked in.

    ``answers`` is ``array<struct<category, keyword, answer>>`` in question order (see ``usable_answers``).  Answers
    are taken whole; ``cuts`` (such as ``fixed.ENRICH_CUTS``) shortens them where a prompt has to be sized.
    """
    def cut(text, part):
        return text if not cuts or part not in cuts else F.substring(text, 1, cuts[part])

    def of(*categories):
        return F.filter(answers, lambda a: a["category"].isin(list(categories)))

    new_skills = F.transform(
        F.filter(of("skill_gap", "skill_detail"), lambda a: a["keyword"] != ""),
        lambda a: F.struct(a["keyword"].alias("name"), F.lit(fixed.ENRICH_SKILL_CATEGORY).alias("category"),
                           F.lit(fixed.ENRICH_SKILL_SOURCE).alias("source")),
    )

    def project(a):
        line = F.get(F.filter(F.split(a["answer"], "\n"), lambda x: trimmed(x) != ""), 0)
        name = F.coalesce(
            cut(F.btrim(line, F.lit(fixed.ENRICH_BULLET_CHARS)), "title"), F.lit(fixed.ENRICH_PROJECT_NAME))
        return F.struct(
            name.alias("name"), cut(a["answer"], "project").alias("description"),
            F.lit("").alias("results"), F.array().cast("array<int>").alias("source_index"),
        )

    quant = F.transform(of("quant_data"), lambda a: a["answer"])

    def measured(jobs, quant):
        # without such an answer, as for most pairs, the jobs stay as they are and are not copied
        return F.when(F.size(quant) == 0, jobs).otherwise(F.transform(jobs, lambda job, i: F.when(
            i < F.size(quant),
            job.withField("duties", F.concat(
                or_empty(job["duties"]), F.lit(fixed.ENRICH_QUANT_JOINER), cut(F.get(quant, i), "quant"))),
        ).otherwise(job)))

    def extra_job(a):
        return F.struct(
            F.lit(fixed.ENRICH_COMPANY).alias("company"), F.lit("").alias("position"),
            F.lit("").alias("start_date"), F.lit("").alias("end_date"),
            cut(a["answer"], "job").alias("duties"),
            F.array().cast("array<string>").alias("achievements"),
            F.array().cast("array<int>").alias("source_index"),
        )

    target = F.get(F.transform(of("job_target"), lambda a: F.when(
        a["keyword"] != "", a["keyword"]).otherwise(cut(a["answer"], "title"))), 0)
    return {
        "basic_info": info.withField("target_job", F.coalesce(unempty(info["target_job"]), target, info["target_job"])),
        "skills": F.concat(skills, new_skills),
        "projects": F.concat(projects, F.transform(of("project_detail"), project)),
        "work_experience": F.concat(
            bind(quant, lambda q: measured(work, q)), F.transform(of("experience_gap"), extra_job)),
    }
