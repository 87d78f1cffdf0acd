"""End-to-end jobs: each is one lazy plan from source tables to a result table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaespark.functions import extract as X
from vitaespark.functions import records as R
from vitaespark.functions import text as T
from vitaespark.functions import validation as V
from vitaespark.operators import dialog, limits, matching, metering


def _patterns(fields: dict) -> Column:
    return F.struct(*[fn(F.col("text")).alias(name) for name, fn in fields.items()])


def parse_postings(documents: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Posting records from ``doc_id, text`` and, if given, model responses ``doc_id, content``."""
    found = documents.select("doc_id", _patterns(X.POSTING_FIELDS).alias("_regex"))
    return _with_model(found, responses, R.RAW_POSTING_SCHEMA).select(
        F.col("doc_id").alias("jd_id"), *R.merged_posting(F.col("_model"), F.col("_regex")))


def parse_resumes(documents: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Résumé records with their issues; the text is normalised first and checked against."""
    clean = documents.withColumn("text", T.normalize_text(F.col("text")))
    found = clean.select("doc_id", "text", _patterns(X.RESUME_FIELDS).alias("_regex"))
    merged = _with_model(found, responses, R.RAW_RESUME_SCHEMA).select(
        F.col("doc_id").alias("resume_id"), "text", *R.merged_resume(F.col("_model"), F.col("_regex")))
    record = F.to_json(F.struct(*[c for c in merged.columns if c not in ("resume_id", "text")]))
    return merged.withColumns({
        "format_issues": V.record_issues(F.col("basic_info"), F.col("work_experience")),
        "source_report": V.source_report(record, F.col("text")),
    })


def _with_model(found: DataFrame, responses: DataFrame | None, schema: str) -> DataFrame:
    if responses is None:
        return found.withColumn("_model", F.from_json(F.lit(None).cast("string"), schema))
    model = responses.select("doc_id", F.from_json(X.model_json(F.col("content")), schema).alias("_model"))
    return found.join(model, "doc_id", "left")


def gap_questions(pairs: DataFrame, postings: DataFrame, resumes: DataFrame, lang: str = "zh") -> DataFrame:
    """Gaps of all pairs with the question for each."""
    return matching.template_questions(matching.gaps(matching.pair_records(pairs, postings, resumes)), lang)


def tailored_exports(pairs: DataFrame, postings: DataFrame, resumes: DataFrame, answers: DataFrame,
                     lang: str = "zh") -> DataFrame:
    """Export rows of the résumés tailored to their postings, with answers worked in."""
    paired = matching.pair_records(pairs, postings, resumes)
    return matching.export_rows(matching.tailor(matching.enrich(paired, answers), lang))


def interview_report(turns: DataFrame, skip: Column) -> DataFrame:
    """Summary and transcript per conversation."""
    summary = dialog.session_summary(dialog.phases(turns, skip), turns)
    return summary.join(dialog.transcripts(turns), "conv_id", "left")


def metered_calls(calls: DataFrame, keys: list[str], configured: list[str], max_calls: int, limit: float) -> DataFrame:
    """Every call with its cost and the gate's decision: key, then rate, then budget."""
    return limits.call_gate(metering.priced(calls), keys, configured, max_calls, limit=limit)
