"""Record shapes and projections: merging extracted and model-made fields, section records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.functions.strings import bind, first_present, or_empty, unempty

INTS = "array<int>"
STRINGS = "array<string>"

# What a model returns for a résumé, and the record built from it.
RAW_RESUME_SCHEMA = (
    "base_info struct<name:string,phone:string,email:string,target_city:string,target_position:string,"
    "expected_salary:string,available_onboard_time:string,source_index:array<int>>,"
    "education_list array<struct<school_name:string,major:string,degree:string,start_date:string,"
    "end_date:string,scholarship_awards:array<string>,source_index:array<int>>>,"
    "work_experience_list array<struct<company:string,position:string,start_date:string,end_date:string,"
    "job_duty:string,source_index:array<int>>>,"
    "project_list array<struct<project_name:string,project_time:string,responsibility:string,"
    "project_data:string,source_index:array<int>>>,"
    "skill_certificate struct<language_cert:array<string>,software_skill:array<string>,"
    "ai_tool_mastered:array<string>,other_cert:array<string>,source_index:array<int>>"
)
RAW_POSTING_SCHEMA = (
    "position string, company string, location string, salary_range string, years_required string, "
    "education_required string, responsibilities array<struct<text:string,source_index:array<int>>>, "
    "requirements array<struct<text:string,type:string,source_index:array<int>>>, "
    "hard_skills array<string>, soft_skills array<string>, industry array<string>, job_type string"
)


def or_no_items(items: Column, element: str = "string") -> Column:
    return F.coalesce(items, F.array().cast(f"array<{element}>"))


def merged_posting(model: Column, regex: Column) -> list[Column]:
    """M1: model values first, pattern values where those are missing; skills are the union of both."""
    text = {
        "position": "guessed_position", "company": "guessed_company", "location": "location",
        "salary_range": "salary_range", "years_required": "years_required",
        "education_required": "education_required",
    }
    skills = F.array_union(or_no_items(model["hard_skills"]), or_no_items(regex["hard_skills"]))
    return [
        *[first_present(model[name], regex[other]).alias(name) for name, other in text.items()],
        or_no_items(model["responsibilities"], "struct<text:string,source_index:array<int>>").alias("responsibilities"),
        or_no_items(model["requirements"], "struct<text:string,type:string,source_index:array<int>>").alias("requirements"),
        F.array_sort(skills).alias("hard_skills"),
        or_no_items(model["soft_skills"]).alias("soft_skills"),
        or_no_items(model["industry"]).alias("industry"),
        model["job_type"].alias("job_type"),
        F.struct(
            F.size(or_no_items(regex["hard_skills"])).alias("skills_count"), regex["guessed_position"],
            regex["guessed_company"], regex["location"],
        ).alias("regex_fallback"),
    ]


def _renamed(items: Column, element: str, build) -> Column:
    return or_no_items(F.transform(items, build), element)


def merged_resume(raw: Column, hard: Column) -> list[Column]:
    """M2: model values with pattern values as fall-back for four contact fields; lists renamed."""
    base, skills = raw["base_info"], raw["skill_certificate"]

    def named(items, **fixed_fields):
        return _renamed(
            items,
            "struct<name:string" + "".join(f",{k}:string" for k in fixed_fields) + ">",
            lambda x: F.struct(x.alias("name"), *[F.lit(v).cast("string").alias(k) for k, v in fixed_fields.items()]),
        )

    return [
        F.struct(
            first_present(base["name"], hard["name"]).alias("name"),
            first_present(base["phone"], hard["phone"]).alias("phone"),
            first_present(base["email"], hard["email"]).alias("email"),
            first_present(base["target_city"], hard["city"]).alias("city"),
            base["target_position"].alias("target_job"),
            base["expected_salary"].alias("expect_salary"),
            base["available_onboard_time"].alias("onboard_time"),
        ).alias("basic_info"),
        _renamed(
            raw["education_list"],
            "struct<school:string,major:string,degree:string,start_date:string,end_date:string,"
            "awards:array<string>,source_index:array<int>>",
            lambda e: F.struct(
                e["school_name"].alias("school"), e["major"], e["degree"], e["start_date"], e["end_date"],
                or_no_items(e["scholarship_awards"]).alias("awards"), e["source_index"],
            ),
        ).alias("education"),
        _renamed(
            raw["work_experience_list"],
            "struct<company:string,position:string,start_date:string,end_date:string,duties:string,"
            "achievements:array<string>,source_index:array<int>>",
            lambda w: F.struct(
                w["company"], w["position"], w["start_date"], w["end_date"], w["job_duty"].alias("duties"),
                F.array().cast(STRINGS).alias("achievements"), w["source_index"],
            ),
        ).alias("work_experience"),
        _renamed(
            raw["project_list"],
            "struct<name:string,description:string,results:string,source_index:array<int>>",
            lambda p: F.struct(
                p["project_name"].alias("name"), p["responsibility"].alias("description"),
                p["project_data"].alias("results"), p["source_index"],
            ),
        ).alias("projects"),
        F.concat(
            named(skills["software_skill"], category=fixed.SKILL_CATEGORY_TOOL, source=None),
            named(skills["ai_tool_mastered"], category=fixed.SKILL_CATEGORY_AI, source=None),
        ).alias("skills"),
        named(skills["other_cert"]).alias("certificates"),
        named(skills["language_cert"]).alias("languages"),
        hard.alias("hard_fields"),
    ]


def match_keywords() -> list[Column]:
    """M3: the posting fields that matching reads."""
    return [
        *[or_no_items(F.col(name)).alias(name) for name in ("hard_skills", "soft_skills", "industry")],
        F.col("years_required").alias("years"), F.col("education_required").alias("education"),
        F.col("position"), F.col("company"),
    ]


def material_record() -> list[Column]:
    """M4: the résumé as handed on, with the contact block renamed."""
    info = F.col("basic_info")
    return [
        F.struct(
            info["name"], info["phone"], info["email"], info["city"], info["target_job"],
            info["expect_salary"].alias("salary"),
        ).alias("identity"),
        *[F.col(name) for name in (
            "education", "work_experience", "projects", "skills", "certificates", "languages")],
    ]


def personal_section(info: Column) -> Column:
    """M5: contact block with empty strings for missing values."""
    return F.struct(
        *[or_empty(info[name]).alias(name) for name in ("name", "phone", "email", "city", "target_job")],
        or_empty(info["expect_salary"]).alias("salary"),
    )


def period(start: Column, end: Column) -> Column:
    """M6: the dates that are present, joined by a dash."""
    return F.concat_ws(" - ", unempty(start), unempty(end))


def job_sections(work: Column) -> Column:
    """M7: jobs as sections, without what depends on a posting."""
    return F.transform(
        work,
        lambda job: F.struct(
            or_empty(job["company"]).alias("company"), or_empty(job["position"]).alias("position"),
            period(job["start_date"], job["end_date"]).alias("period"),
            F.array_compact(F.array(unempty(job["duties"]))).alias("bullets"),
            or_no_items(job["source_index"], "int").alias("source_index"),
        ),
    )


def experience_section(sections: Column, labels: Column) -> Column:
    """Job sections with their relevance labels."""
    return F.zip_with(sections, labels, lambda x, label: F.struct(
        *[x[name] for name in ("company", "position", "period", "bullets")], label.alias("jd_relevance"), x["source_index"]))


def job_json(sections: Column) -> Column:
    """M7: job sections as JSON, ``array<struct<head, tail>>``: the relevance label goes between the two."""
    def parts(x):
        known = F.to_json(F.struct(*[x[name].alias(name) for name in ("company", "position", "period", "bullets")]))
        source = F.to_json(F.struct(x["source_index"].alias("source_index")))
        return F.struct(
            F.concat(F.substring(known, F.lit(1), F.length(known) - 1), F.lit(',"jd_relevance":"')).alias("head"),
            F.concat(F.lit('",'), F.substring(source, F.lit(2), F.length(source))).alias("tail"))

    return F.transform(sections, parts)


def education_section(education: Column) -> Column:
    """M7."""
    return F.transform(
        education,
        lambda e: F.struct(
            or_empty(e["school"]).alias("school"), or_empty(e["major"]).alias("major"),
            or_empty(e["degree"]).alias("degree"), period(e["start_date"], e["end_date"]).alias("period"),
        ),
    )


def skill_names(skills: Column) -> Column:
    return F.filter(F.transform(skills, lambda s: s["name"]), lambda n: unempty(n).isNotNull())


def technical_skills(skills: Column) -> Column:
    """M8: skill names that are not language skills; repeats stay."""
    return F.filter(skill_names(skills), lambda n: ~n.isin(fixed.LANGUAGE_STOP_SKILLS))


def fill_arguments(template: Column, arguments: Column) -> Column:
    """Replace ``{name}`` marks from a map; keep the template when an argument is missing.

    The template is taken apart once, so braces inside values stay as they are.  Doubled braces stand for
    single ones, and a null value for the word None.  A template with a stray brace is kept, too.
    """
    parts = F.regexp_extract_all(template, F.lit(r"\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}]"), F.lit(0))

    def filled(part):
        name = F.substring(part, F.lit(2), F.length(part) - 2)
        value = F.coalesce(F.element_at(arguments, name), F.lit("None"))
        return F.when(part.isin("{{", "}}"), F.substring(part, 1, 1)).when(part.startswith("{"), value).otherwise(part)

    def usable(part):
        name = F.substring(part, F.lit(2), F.length(part) - 2)
        is_mark = part.startswith("{") & part.endswith("}")
        return F.when(is_mark, F.map_contains_key(arguments, name)).otherwise(~part.isin("{", "}"))

    whole = bind(parts, lambda p: F.when(F.forall(p, usable), F.array_join(F.transform(p, filled), "")).otherwise(template))
    return F.when(template.isNotNull() & arguments.isNotNull(), whole).otherwise(template)


def job_text(job: Column) -> Column:
    """All values of a job, in lower case, one per line."""
    return F.lower(F.concat_ws(
        "\n", job["company"], job["position"], job["start_date"], job["end_date"], job["duties"]))


def project_text(project: Column) -> Column:
    return F.lower(F.concat_ws("\n", project["name"], project["description"], project["results"]))


def record_text() -> Column:
    """All values of a whole résumé record, in lower case; reads the record's columns and history text."""
    info = F.col("basic_info")
    education = F.transform(
        F.col("education"),
        lambda e: F.concat_ws("\n", e["school"], e["major"], e["degree"], e["start_date"], e["end_date"]),
    )

    def names(column):
        return F.array_join(F.transform(F.col(column), lambda x: x["name"]), "\n")

    return F.lower(F.concat_ws(
        "\n", info["name"], info["phone"], info["email"], info["city"], info["target_job"],
        info["expect_salary"], F.array_join(education, "\n"),
        F.col("history_text"),
        names("skills"), names("certificates"), names("languages"),
    ))


def with_features(resumes: DataFrame) -> DataFrame:
    """Add what matching reads from a résumé, so that it is computed per résumé and not per pair.

    All texts are in lower case; columns that a query does not use are pruned.  Which words the texts
    hold is found by ``operators.matching.with_hits``.
    """
    work, projects = F.col("work_experience"), F.col("projects")
    return resumes.withColumns({
        "skill_list": skill_names(F.col("skills")),
        "job_texts": F.transform(work, job_text),
        "duty_texts": F.transform(work, lambda w: F.lower(or_empty(w["duties"]))),
        "project_texts": F.transform(projects, project_text),
        "job_sections": job_sections(work),
        "job_count": F.size(work), "project_count": F.size(projects),
        "measured": F.exists(
            work, lambda w: or_empty(w["duties"]).rlike(fixed.QUANT_PATTERN.replace(r"\d", r"\p{Nd}"))),
    }).withColumns({
        "skill_list_lower": F.transform("skill_list", F.lower),
        "history_text": F.concat(
            F.array_join("job_texts", "\n"), F.lit("\n"), F.array_join("project_texts", "\n")),
    }).withColumn("whole_text", record_text())
