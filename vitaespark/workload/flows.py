"""Registered queries: sources, sinks and streams."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from vitaespark.functions import dialog as D
from vitaespark.functions import records as R
from vitaespark.operators import documents, matching
from vitaespark.session import shared_folder
from vitaespark.sources import files
from vitaespark.streaming import run, state
from vitaespark.workload import derive
from vitaespark.workload.pairs import BASE, paired, raw_resumes
from vitaespark.workload.registry import ORACLES, query
from vitaespark.workload.sqltext import strip
from vitaespark.workload.usage import DAY, _windows

_PATH = ("source || '/' || cast(doc_id as string) || " + derive._pick(
    "doc_id", ".txt", ".MD", ".pdf", ".docx", ".jpeg", ".xyz", "", ".tar.gz", ".html", ".Yaml"))
_SUFFIX = "lower(regexp_extract(path, '[^./](\\.[^./]+)$', 1))"


@query("source_method", f"""
    SELECT doc_id, CASE WHEN {_SUFFIX} IN ('.txt', '.md', '.py', '.json', '.csv', '.log', '.xml', '.html', '.yaml', '.yml') THEN 'text'
        WHEN {_SUFFIX} = '.pdf' THEN 'pdf' WHEN {_SUFFIX} IN ('.docx', '.doc') THEN 'docx'
        WHEN {_SUFFIX} IN ('.png', '.jpg', '.jpeg', '.webp', '.bmp', '.gif', '.tiff', '.tif') THEN 'ocr' ELSE 'text_fallback' END AS method
    FROM (SELECT doc_id, {_PATH} AS path FROM documents)""")
def source_method(spark, d):
    """S1"""
    paths = derive.as_frame(derive.load(spark, d, "documents"), {"doc_id": "doc_id", "path": _PATH})
    return paths.select("doc_id", files.reading_method(F.col("path")).alias("method"))


@query("source_read_files", """
    SELECT lang, 'text' AS method, cast(sum(length(text) + 1) AS bigint) AS chars FROM documents GROUP BY lang""")
def source_read_files(spark, d):
    """S1 to S3 on real files: the texts are written per language and read back file by file."""
    folder = shared_folder(spark, "texts")
    derive.load(spark, d, "documents").select("text", "lang").write.option(
        "maxRecordsPerFile", 1000).partitionBy("lang").text(folder)
    read = files.read_documents(spark, folder).filter("success")
    return read.groupBy(F.regexp_extract("path", "lang=(\\w+)", 1).alias("lang"), "method").agg(
        F.sum(F.length("text")).alias("chars"))


@query("source_decode", """
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN chr(65533) || text || chr(65533) ELSE text END AS text FROM documents""")
def source_decode(spark, d):
    """A third of the documents gets bytes that are not UTF-8."""
    content = F.expr("CASE WHEN doc_id % 3 = 0 THEN concat(X'FF', cast(text AS binary), X'C3') ELSE cast(text AS binary) END")
    return derive.load(spark, d, "documents").select("doc_id", files.decode_text(content).alias("text"))


_MAYBE = "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN ' ' || chr(10) ELSE text END"


@query("source_report", f"""
    SELECT doc_id, coalesce({strip('t')}, '') <> '' AS success, CASE WHEN coalesce({strip('t')}, '') <> '' THEN '' ELSE
        '未能从文件中提取到任何文字内容。文件可能为空、已损坏、或为不支持格式的图片。' END AS error
    FROM (SELECT doc_id, {_MAYBE} AS t FROM documents)""")
def source_report(spark, d):
    """S3"""
    docs = derive.as_frame(derive.load(spark, d, "documents"), {"doc_id": "doc_id", "text": _MAYBE})
    usable, quarantined = documents.split_report(documents.file_report(docs))
    return usable.unionByName(quarantined).select("doc_id", "success", "error")


@query("source_records", f"""WITH {BASE}
    SELECT resume_id, phone, email, city, cast(coalesce(n_jobs, 0) AS integer) AS jobs, certificate,
        (SELECT string_agg(duties, '|' ORDER BY pos) FROM jobs j WHERE j.resume_id = p.resume_id) AS duties
    FROM people p LEFT JOIN history h USING (resume_id)""")
def source_records(spark, d):
    """Records are written as lines of JSON and read back with their schema."""
    folder = shared_folder(spark, "records")
    files.write_results(raw_resumes(spark, d).select("resume_id", "raw.*"), folder)
    back = files.read_records(spark, folder, "resume_id bigint, " + R.RAW_RESUME_SCHEMA)
    return back.select(
        "resume_id", "base_info.phone", "base_info.email", F.col("base_info.target_city").alias("city"),
        F.size("work_experience_list").alias("jobs"), F.get("skill_certificate.other_cert", 0).alias("certificate"),
        F.when(F.size("work_experience_list") > 0, F.array_join("work_experience_list.job_duty", "|")).alias("duties"))


@query("source_calls", "SELECT count(*) AS calls, count(DISTINCT user_id) AS tenants FROM events")
def source_calls(spark, d):
    """S5"""
    calls = files.read_calls(spark, f"{d}/events.parquet")
    return calls.agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("user_id").alias("tenants"))


@query("sink_export", f"""WITH {BASE} SELECT k.title, count(*) AS rows FROM apps
    CROSS JOIN (VALUES ('基本信息'), ('个人概述'), ('教育经历'), ('工作经历'), ('技能证书')) k(title) GROUP BY ALL""")
def sink_export(spark, d):
    """Exports are written by section and counted from what was written."""
    folder = shared_folder(spark, "export")
    files.write_export(matching.export_rows(matching.tailor(paired(spark, d, exported=True))), folder)
    return spark.read.parquet(folder).groupBy("title").agg(F.count(F.lit(1)).alias("rows"))


# --- streams: each must equal its batch form ----------------------------------------------------

#: Pieces in which a stream's table arrives.
PIECES = 4
#: Seconds by which rows come out of order at most.
DISORDER = 3 * DAY // 2


def _arrivals(df, seconds):
    """A table in pieces by time, each row up to ``DISORDER`` too late: neighbouring pieces overlap by that much."""
    spread = df.withColumn("_at", F.col("_second") + F.pmod(F.xxhash64(*df.columns), F.lit(seconds)))
    low, high = spread.agg(F.min("_at"), F.max("_at")).first()
    if low is None:
        return [df.drop("_second")]
    piece = F.floor((F.col("_at") - low) * PIECES / (high - low + 1))
    return [spread.where(piece == k).drop("_at", "_second") for k in range(PIECES)]


def _call_arrivals(spark, d):
    events = derive.load(spark, d, "events")
    return _arrivals(events.withColumn("_second", F.unix_seconds(F.col("ts").cast("timestamp"))), DISORDER)


@contextmanager
def _state_store(spark):
    """The store that keyed state needs, for as long as a stream runs; the session gets its own setting back."""
    before = {key: spark.conf.get(key, None) for key in state.STATE_STORE}
    for key, value in state.STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _called(rows):
    return derive.as_frame(rows, derive.CALL)


def _load(spark, d, purpose, delay, **options):
    """Main rows and corrections, added up."""
    with _state_store(spark):
        parts = run.run_arrivals(_call_arrivals(spark, d), lambda rows, clock: state.load_stream(
            _called(rows), delay_seconds=delay, clock=clock, **options), purpose)
    return _windows(parts.groupBy("window_start").agg(*[F.sum(c).alias(c) for c in state.LOAD]))


@query("stream_load_tumbling", ORACLES["load_tumbling"])
def stream_load_tumbling(spark, d):
    """U14 as a stream of calls out of order; the delay covers an hour of it, the rest is corrections"""
    return _load(spark, d, "load", 3600)


@query("stream_load_sliding", ORACLES["load_sliding"])
def stream_load_sliding(spark, d):
    """U14 as a stream of calls out of order within the delay"""
    return _load(spark, d, "load", 2 * DAY, slide_seconds=10)


def _limited(spark, d, limiter, purpose):
    """Calls come out of order by less than the delay; any that came later would be seen as ``late``."""
    with _state_store(spark):
        return run.run_arrivals(_call_arrivals(spark, d), lambda rows, clock: limiter(
            _called(rows), 2, DAY, delay_seconds=2 * DAY, step_seconds=DAY, clock=clock), purpose)


def _with_late(name):
    return f"SELECT *, false AS late FROM ({ORACLES[name]})"


@query("stream_limit_sliding", _with_late("limit_sliding"))
def stream_limit_sliding(spark, d):
    """U11 as a stream of calls out of order"""
    return _limited(spark, d, state.limit_sliding, "sliding")


@query("stream_limit_fixed_window", _with_late("limit_fixed_window"))
def stream_limit_fixed_window(spark, d):
    """U12 as a stream of calls out of order"""
    return _limited(spark, d, state.limit_fixed_window, "fixed")


@query("stream_phases", ORACLES["dialog_phases"].replace(
    "SELECT * FROM phased", "SELECT conv_id, turn, question_no, phase, false AS late FROM phased"))
def stream_phases(spark, d):
    """I2 as a stream of turns out of order: a turn a second"""
    turns = derive.load(spark, d, "conversations")
    with _state_store(spark):
        return run.run_arrivals(_arrivals(turns.withColumn("_second", F.col("turn")), 3), lambda rows, clock: state.track_phases(
            derive.as_frame(rows, derive.TURN).withColumn("ts", F.timestamp_seconds("turn")), D.is_skip(F.col("said"), F.col("lang")),
            delay_seconds=4, step_seconds=2, clock=clock), "phases")
