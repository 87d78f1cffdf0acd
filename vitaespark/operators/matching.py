"""Posting and résumé pairs: gaps, questions, answers, tailored résumés."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.functions import matching as M
from vitaespark.functions import records as R
from vitaespark.operators.multipattern import Patterns, distinct_patterns, hit_table
from vitaespark.operators.ordered import heavy_keys, salted_join
from vitaespark.session import written

POSTING_COLUMNS = [
    "jd_id", "position", "company", "years_required", "education_required", "hard_skills", "soft_skills",
]


def with_hits(rows: DataFrame, held: Callable[[Column], Column]) -> DataFrame:
    """Add which words each text of a résumé holds; ``held`` gives them for an array of texts."""
    return rows.withColumns({
        "name_hits": held(F.col("skill_list_lower")), "job_hits": held(F.col("job_texts")),
        "duty_hits": held(F.col("duty_texts")), "project_hits": held(F.col("project_texts")),
        "history_hits": F.get(held(F.array("history_text")), 0), "whole_hits": F.get(held(F.array("whole_text")), 0),
    })


def _own_hits(rows: DataFrame) -> DataFrame:
    """Hits of the words of each row's own posting, for résumés that were changed for it."""
    words = F.filter(F.array_distinct(F.concat("hard_words", "soft_words")), lambda w: w["code"] != "")

    def held(texts):
        return F.transform(texts, lambda t: F.when(t.isNotNull(), F.array_join(
            F.filter("_words", lambda w: F.contains(t, F.lower(w["name"])))["code"], "")))

    return with_hits(R.with_features(rows).withColumn("_words", words), held).drop("_words")


def posting_words(postings: DataFrame) -> Patterns:
    """All skills that postings ask for, ready to be looked for in texts."""
    return Patterns(distinct_patterns(postings, *[c for c in ("hard_skills", "soft_skills") if c in postings.columns]))


def resume_hits(resumes: DataFrame, postings: DataFrame) -> DataFrame:
    """(resume_id, word, n): posting skills in each résumé's history, with their numbers of occurrences."""
    return hit_table(R.with_features(resumes), ["resume_id"], "history_text", posting_words(postings)).withColumnRenamed("pattern", "word")


def pair_records(
    pairs: DataFrame, postings: DataFrame, resumes: DataFrame, more: tuple[str, ...] = (), copies: bool = False,
    exported: bool = False,
) -> DataFrame:
    """Both records beside each (jd_id, resume_id) pair, with what matching reads.

    All postings' skills are looked for in a résumé's texts at once, before it is paired; a pair only
    carries the hits.  Popular postings and busy candidates are salted.  The small posting joins first; a
    résumé is shuffled once and never copied per posting across the network.  The pairs are written
    once, so that finding the popular keys and joining do not work them out again.  ``more`` names further
    columns of the postings that a pair keeps.  With ``copies`` it also carries what gaps read of all postings
    and résumés with its ids, ``posting_copies`` and ``resume_copies``: one each unless ids repeat.  With ``exported``
    it carries the JSON of the jobs, and of the introductions with each of them, made once per résumé and only
    after résumés were shuffled.
    """
    pairs = written(pairs, "pairs")
    words = posting_words(postings)
    slim = postings.select(*[c for c in POSTING_COLUMNS if c in postings.columns], *more)
    coded = slim.withColumns({
        new: words.coded(F.col(c)) for c, new in (("hard_skills", "hard_words"), ("soft_skills", "soft_words")) if c in slim.columns})
    read = with_hits(R.with_features(resumes), words.held)
    if copies:
        target = F.struct("basic_info.target_job").alias("basic_info")
        coded = _with_copies(coded, "jd_id", "posting_copies", *M.POSTING_READ)
        read = _with_copies(read, "resume_id", "resume_copies", *M.RESUME_READ, target)
    if exported:
        said = M.intros_json(R.personal_section(F.col("basic_info")), F.col("job_sections"), R.technical_skills(F.col("skills")))
        read = read.repartition("resume_id").withColumns({"job_json": R.job_json(F.col("job_sections")), "intros_json": said})
    with_posting = salted_join(pairs, coded, "jd_id")
    return salted_join(with_posting, read, "resume_id", heavy=heavy_keys(pairs, "resume_id"), by=["jd_id"])


def _with_copies(records: DataFrame, key: str, name: str, *fields: str | Column) -> DataFrame:
    """Add what ``fields`` give of all records with the same key; those without a key are paired with nothing and go."""
    return records.where(F.col(key).isNotNull()).withColumn(name, F.collect_list(F.struct(*fields)).over(Window.partitionBy(key)))


def gaps(paired: DataFrame, keep: tuple[str, ...] = (), beside: bool = False) -> DataFrame:
    """One row per gap, ``pos`` giving the report order; ``keep`` names columns of the pair to stay beside it.

    With ``beside`` the rows are the pairs, made with ``copies``, and an array ``gaps`` holds the gaps of all
    pairs with their ids: what grouping the rows of gaps by pair would give, without moving any.
    """
    if beside:
        return paired.withColumn("gaps", M.gaps_of_copies(F.col("posting_copies"), F.col("resume_copies")))
    found = paired.select("jd_id", "resume_id", *keep, F.posexplode(M.all_gaps()).alias("pos", "gap"))
    return found.select("jd_id", "resume_id", *keep, "pos", "gap.*")


def template_questions(gap_rows: DataFrame, lang: str = "zh") -> DataFrame:
    """G9."""
    return gap_rows.withColumn(
        "question", M.question_text(F.col("category"), F.col("keyword"), F.col("detail"), lang))


def choose_questions(templates: DataFrame, model_made: DataFrame | Column) -> DataFrame:
    """Per pair the model-made questions when there are at least as many as gaps, else the templates.

    Model-made questions are rows of their own, or an array of questions beside each gap: then the gaps are
    worked out once and no question is moved to meet its pair.
    """
    keys = ["jd_id", "resume_id"]
    columns = [*keys, "pos", "category", "keyword", "question"]
    pair = Window.partitionBy(*keys)  # the questions of one pair, a few per gap
    if isinstance(model_made, Column):
        none = F.array().cast("array<string>")
        rows = templates.select(*columns, F.coalesce(model_made, none).alias("_made"))
        rows = rows.withColumn("_enough", F.sum(F.size("_made")).over(pair) >= F.count(F.lit(1)).over(pair))
        chosen = F.when(F.col("_enough"), F.col("_made")).otherwise(F.array("question"))
        origin = F.when(F.col("_enough"), "model").otherwise("template").alias("origin")
        return rows.select(*columns[:-1], F.explode(chosen).alias("question"), origin)
    both = model_made.select(*columns, F.lit("model").alias("origin")).unionByName(
        templates.select(*columns, F.lit("template").alias("origin")))
    gaps, made = (F.count_if(F.col("origin") == name).over(pair) for name in ("template", "model"))
    chosen = F.when((gaps > 0) & (made >= gaps), "model").otherwise("template")
    return both.withColumn("_chosen", chosen).filter(F.col("origin") == F.col("_chosen")).drop("_chosen")


def route_answers(answers: DataFrame) -> DataFrame:
    """The destination of each answer, and the skill it adds when it adds one."""
    route = M.answer_route(F.col("category"), F.col("answer"))
    return answers.withColumn("route", route).withColumn(
        "skill", F.when(F.col("route") == "skills", M.answered_skill(F.col("keyword"))))


def enrich(paired: DataFrame, answers: DataFrame | Column, cuts: dict[str, int] | None = None) -> DataFrame:
    """The résumé of each pair with the answers to its questions worked in, whole unless ``cuts`` are given.

    Answers of a pair are few (one per gap) and taken in question order.  They are rows of pairs, or an array of
    structs beside each pair: then neither they nor the résumés are moved to meet.
    """
    keys = ["jd_id", "resume_id"]

    def in_order(given):
        return F.transform(F.array_sort(given), lambda a: F.struct(a["category"], a["keyword"], a["answer"]))

    if isinstance(answers, Column):
        each = F.transform(answers, lambda a: F.struct(a["pos"], a["category"], a["keyword"], a["answer"]))
        joined = paired.select(*keys, *[c for c in paired.columns if c not in keys], in_order(each).alias("_answers"))
    else:
        given = answers.groupBy(*keys).agg(
            in_order(F.collect_list(F.struct("pos", "category", "keyword", "answer"))).alias("_answers"))
        joined = paired.join(given, keys, "left")
    none = F.array().cast("array<struct<category:string,keyword:string,answer:string>>")
    joined = joined.withColumn("_answers", M.usable_answers(F.coalesce("_answers", none)))
    new = M.enriched_resume(*[F.col(c) for c in (
        "_answers", "basic_info", "skills", "work_experience", "projects")], cuts)
    return _own_hits(joined.withColumns(new).drop("_answers"))


def append_direct(paired: DataFrame, additions: DataFrame | Column) -> DataFrame:
    """Append ``new_skills`` and ``new_projects`` given per pair as they are.

    Additions are rows of pairs, one or more of a pair making as many rows of it, or an array of such structs
    beside each pair: then no résumé is moved to meet them.
    """
    keys = ["jd_id", "resume_id"]
    if isinstance(additions, Column):
        rest = [c for c in paired.columns if c not in keys]
        joined = paired.select(*keys, *rest, F.explode_outer(additions).alias("_new")).select(*keys, *rest, "_new.new_skills", "_new.new_projects")
    else:
        joined = paired.join(additions, keys, "left")
    for name, extra in (("skills", "new_skills"), ("projects", "new_projects")):
        column = F.col(name)
        joined = joined.withColumn(name, F.when(F.col(extra).isNull(), column).otherwise(F.concat(column, extra)))
    return _own_hits(joined.drop("new_skills", "new_projects"))


def tailor(paired: DataFrame, lang: str = "zh") -> DataFrame:
    """The tailored résumé of each pair: ranked, labelled, summarised and introduced.

    ``experience_json`` is the JSON of ``experience``, put together from that of each job, which pairs made to be
    ``exported`` bring with them; a query that reads only one of the two does not work out the other.
    """
    known_intros = [F.col("intros_json")] if "intros_json" in paired.columns else []
    job_json = F.col("job_json") if "job_json" in paired.columns else R.job_json(F.col("job_sections"))
    hard, names = F.col("hard_words"), F.col("name_hits")
    keywords = F.concat("hard_words.code", "soft_words.code")
    placed = paired.withColumns({
        "_order": M.relevance_order(F.col("job_hits"), keywords),
        "_labels": M.relevance_labels(F.col("duty_hits"), F.col("hard_words.code")),
    })
    ranked = placed.select(
        "jd_id", "resume_id", "job_count", R.personal_section(F.col("basic_info")).alias("personal"),
        M.in_order(R.experience_section(F.col("job_sections"), F.col("_labels")), F.col("_order")).alias("experience"),
        M.by_relevance(F.col("projects"), F.col("project_hits"), keywords).alias("projects"),
        R.education_section(F.col("education")).alias("education"),
        F.struct(
            R.technical_skills(F.col("skills")).alias("technical"), F.col("languages.name").alias("languages"),
            F.col("certificates.name").alias("certificates"),
            M.skills_matched(hard, names).alias("jd_matched"), M.skills_missing(hard, names).alias("jd_missing"),
        ).alias("skills"),
        M.text_match_report(hard, F.col("whole_hits"), lang).alias("jd_gap"),
        M.experience_json(job_json, F.col("_labels"), F.col("_order")).alias("experience_json"),
        F.get("job_sections", F.get("_order", 0)).alias("_top"),
        *[F.get(said, F.coalesce(F.get("_order", 0), F.size(said) - 1)).alias("intro_json") for said in known_intros],
    )
    built = ranked.withColumn("summary", M.summary_line(
        F.col("personal.name"), F.col("job_count"), F.col("skills.jd_matched"), lang))
    return built.withColumns({
        f"intro_{code}": M.self_intro(F.col("personal"), F.col("_top"), F.col("skills.technical"), code)
        for code in fixed.INTRO_TEXT
    }).drop("_top")


def export_rows(tailored: DataFrame) -> DataFrame:
    """Five ordered sections per tailored résumé, each with both introductions and the analysis."""
    contents = M.export_contents(*[F.col(c) for c in ("personal", "summary", "education", "experience_json", "skills")])
    said = F.col("intro_json") if "intro_json" in tailored.columns else F.to_json(
        F.struct(*[F.col(f"intro_{code}").alias(code) for code in fixed.INTRO_TEXT]))
    # what all five share is made before they are told apart; their array is spelled out where it is exploded, since
    # Spark would work out another array once more, to see that it is not empty
    made = tailored.select(
        "jd_id", "resume_id", *[content.alias(f"_content_{i}") for i, content in enumerate(contents)],
        said.alias("self_intro"),
        F.to_json("jd_gap").alias("jd_analysis"),
    )
    sections = M.export_sections([F.col(f"_content_{i}") for i in range(len(contents))])
    rows = made.select("jd_id", "resume_id", F.explode(sections).alias("s"), "self_intro", "jd_analysis")
    return rows.select("jd_id", "resume_id", "s.*", "self_intro", "jd_analysis")


def localised(keys: DataFrame, dictionary: DataFrame, lang: str = "zh", fallback: str = "zh") -> DataFrame:
    """M9: the text of each key in a language, else in the fall-back language, else the key.

    Entries are unique per key and language; an empty text counts as present.
    """
    def entry(code, name):
        return F.max(F.when(F.col("lang") == code, F.col("text"))).alias(name)

    both = dictionary.groupBy("key").agg(entry(fallback, "_fallback"), entry(lang, "_own"))
    joined = keys.join(both, "key", "left")
    return joined.withColumn("text", F.coalesce("_own", "_fallback", "key")).drop("_own", "_fallback")
