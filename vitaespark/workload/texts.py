"""Registered queries: text preparation."""

from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.functions import text as T
from vitaespark.operators import documents
from vitaespark.workload import derive
from vitaespark.workload.registry import query
from vitaespark.workload.sqltext import (
    LINES, NL, NORMAL, SECTIONS, q, strip, sub,
)



def normal_texts(spark, d):
    return documents.normalize(derive.resume_texts(spark, d))


@query("text_normalize", NORMAL)
def text_normalize(spark, d):
    """T1"""
    return normal_texts(spark, d)


_BARE = f"replace(replace(replace({strip('text')}, {NL}, ''), chr(9), ''), ' ', '')"
_PRINTABLE = f"1 - (length({_BARE}) - length({sub(_BARE, r'[\p{C}\p{Z}]+')})) / greatest(length({strip('text')}), 1)"
_LETTERS = (
    f"(length({strip('text')}) - length({sub(strip('text'), r'[\p{L}\p{N}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]+')}))"
    f" / greatest(length({strip('text')}), 1)"
)


@query("text_meaningful", f"""
    SELECT doc_id, length({strip('text')}) >= 20 AND {_PRINTABLE} >= 0.8 AND {_LETTERS} >= 0.25 AS meaningful,
        {_LETTERS} AS letter_ratio FROM documents""")
def text_meaningful(spark, d):
    """T2"""
    docs = derive.load(spark, d, "documents")
    return docs.select("doc_id", T.is_meaningful(F.col("text")).alias("meaningful"), T.letter_ratio(F.col("text")).alias("letter_ratio"))


@query("text_lines", f"WITH {LINES} SELECT doc_id, cast(line_no AS integer) AS line_no, raw AS line FROM raw_lines")
def text_lines(spark, d):
    """T3"""
    return documents.explode_lines(normal_texts(spark, d), ["doc_id"])


_SECTION_ROWS = "SELECT doc_id, section_key, cast(line_no AS integer) AS line_no, line FROM"


@query("text_sections_unmerged", f"WITH {SECTIONS} {_SECTION_ROWS} kept")
def text_sections_unmerged(spark, d):
    """T4"""
    return documents.explode_sections(normal_texts(spark, d), ["doc_id"], merge_header=False)


@query("text_sections", f"WITH {SECTIONS} {_SECTION_ROWS} sections")
def text_sections(spark, d):
    """T4, T5"""
    return documents.explode_sections(normal_texts(spark, d), ["doc_id"])


@query("text_section_map", f"""WITH {SECTIONS},
    s AS (SELECT doc_id, section_key, string_agg(line, {NL} ORDER BY line_no) AS body, min(line_no) AS begins
        FROM sections GROUP BY ALL)
    SELECT doc_id, string_agg(section_key || '=' || body, {NL} ORDER BY section_key) AS sections FROM s GROUP BY doc_id""")
def text_section_map(spark, d):
    """T6"""
    entries = F.transform(
        F.array_sort(F.map_entries(F.col("m"))),
        lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "\n")))
    folded = normal_texts(spark, d).select("doc_id", T.section_map(T.section_runs(F.col("text"))).alias("m"))
    return folded.select("doc_id", F.array_join(entries, "\n").alias("sections"))


_RULE = fixed.RULE_CHAR * fixed.RULE_WIDTH
_LABELS = " ".join(f"WHEN '{k}' THEN {q(f'{zh} / {en}')}" for k, (zh, en) in fixed.SECTION_LABELS.items())


_FORMAT = SECTIONS.replace(f"src AS ({NORMAL})", f"""src AS (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN d.text ELSE n.text END AS text
    FROM ({NORMAL}) n JOIN documents d USING (doc_id))""")
assert _FORMAT != SECTIONS


@query("text_section_format", f"""WITH {_FORMAT},
    stripped AS (SELECT doc_id, unnest(string_split({strip('text')}, {NL})) AS raw,
        generate_subscripts(string_split({strip('text')}, {NL}), 1) - 1 AS no FROM src),
    firsts AS (SELECT doc_id, {strip('raw')} AS line, min(no) AS no FROM stripped GROUP BY ALL),
    numbered AS (SELECT s.doc_id, section_key, line_no, '[' || f.no || '] ' || s.line AS line
        FROM sections s JOIN firsts f ON f.doc_id = s.doc_id AND f.line = s.line),
    blocks AS (SELECT doc_id, min(line_no) AS begins, {NL} || {q(_RULE)} || {NL} || '【' || (CASE section_key {_LABELS} END)
        || '】' || {NL} || {q(_RULE)} || {NL} || string_agg(line, {NL} ORDER BY line_no) AS block
        FROM numbered GROUP BY doc_id, section_key),
    titled AS (SELECT doc_id, string_agg(block, {NL} ORDER BY begins) AS formatted FROM blocks GROUP BY doc_id),
    plain AS (SELECT doc_id, string_agg('[' || no || '] ' || raw, {NL} ORDER BY no) AS formatted FROM stripped GROUP BY doc_id)
    SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM sections WHERE section_key <> 'header') THEN titled.formatted
        ELSE plain.formatted END AS formatted FROM plain LEFT JOIN titled USING (doc_id)""")
def text_section_format(spark, d):
    """T7; a quarter of the texts are bare documents, most of them without any heading."""
    bare = derive.load(spark, d, "documents").select("doc_id", F.col("text").alias("bare"))
    texts = normal_texts(spark, d).join(bare, "doc_id")
    text = F.when(F.col("doc_id") % 4 == 3, F.col("bare")).otherwise(F.col("text"))
    return texts.select("doc_id", T.format_sections(text).alias("formatted"))


_NEEDLES = {
    0: "'Education'", 1: "'  two   spaces '", 2: "substring(text, 5, 9)", 3: "'no such line at all'", 4: "''",
    5: "'and two'",
}


@query("text_locate_line", f"""WITH {LINES},
    needles AS (SELECT doc_id, unnest([{', '.join(str(i) for i in _NEEDLES)}]) AS k,
        unnest([{', '.join(_NEEDLES.values())}]) AS needle FROM src),
    stripped AS (SELECT doc_id, unnest(string_split({strip('text')}, {NL})) AS raw,
        generate_subscripts(string_split({strip('text')}, {NL}), 1) - 1 AS no FROM src),
    hits AS (SELECT n.doc_id, n.k, any_value(n.needle) AS needle,
        min(no) FILTER ({strip('raw')} = {strip('needle')}) AS a,
        min(no) FILTER (contains(raw, {strip('needle')})) AS b FROM needles n JOIN stripped s USING (doc_id) GROUP BY ALL)
    SELECT doc_id, k, needle, cast(CASE WHEN {strip('needle')} = '' THEN -1 ELSE coalesce(a, b, -1) END AS integer)
        AS line_no FROM hits""")
def text_locate_line(spark, d):
    """T8"""
    docs = normal_texts(spark, d)
    needles = docs.select("doc_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.expr(e).alias("needle")) for k, e in _NEEDLES.items()])).alias("n")
    ).select("doc_id", "n.*")
    return documents.locate_lines(needles, docs, "doc_id").select("doc_id", "k", "needle", "line_no")


@query("text_short_line_ratio", f"""WITH {LINES}
    SELECT doc_id, count(*) FILTER (length(line) BETWEEN 1 AND 29) / count(*) AS ratio,
        count(*) FILTER (length(line) BETWEEN 1 AND 29) / count(*) > 0.3 AS many_short FROM lines GROUP BY doc_id""")
def text_short_line_ratio(spark, d):
    """T9"""
    ratios = normal_texts(spark, d).select("doc_id", T.short_line_ratio(F.col("text")).alias("ratio"))
    return ratios.withColumn("many_short", F.col("ratio") > 0.3)


@query("layout_gap_clusters", """
    WITH e AS (SELECT user_id, epoch_us(ts) AS pos FROM events),
    g AS (SELECT *, pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS gap FROM e),
    r AS (SELECT user_id, gap, row_number() OVER (PARTITION BY user_id ORDER BY gap) AS rn,
        count(*) OVER (PARTITION BY user_id) AS n FROM g WHERE gap > 0),
    m AS (SELECT user_id, gap AS median FROM r WHERE rn = n // 2 + 1),
    b AS (SELECT g.*, coalesce(gap > greatest(3 * median, 30000000), false) AS brk FROM g LEFT JOIN m USING (user_id)),
    c AS (SELECT *, sum(brk::int) OVER (PARTITION BY user_id ORDER BY pos, brk DESC) AS cluster_id FROM b)
    SELECT user_id, cast(cluster_id AS bigint) AS cluster_id, count(*) AS members, min(pos) AS first_at, max(pos) AS last_at
    FROM c GROUP BY ALL""")
def layout_gap_clusters(spark, d):
    """T10"""
    events = derive.load(spark, d, "events").select(
        "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    clusters = documents.gap_clusters(events, ["user_id"], "at", floor=30_000_000)
    return clusters.groupBy("user_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("members"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def _words(spark, d):
    docs = derive.load(spark, d, "documents")
    words = docs.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", " ")).alias("at", "text"))
    return words.select(
        "page_id", (F.col("at") % 11 * 40 + 0.5).alias("x0"),
        (F.floor(F.col("at") / 11) * 13 + F.col("at") % 7 * 1.5).cast("double").alias("top"), "text")


@query("layout_words_to_lines", """
    WITH RECURSIVE raw AS (SELECT doc_id AS page_id, unnest(string_split(text, ' ')) AS text,
        generate_subscripts(string_split(text, ' '), 1) - 1 AS n FROM documents),
    words AS MATERIALIZED (SELECT page_id, n % 11 * 40 + 0.5 AS x0, cast(n // 11 * 13 + n % 7 * 1.5 AS double) AS top, text FROM raw),
    tops AS MATERIALIZED (SELECT DISTINCT page_id, top FROM words),
    nexts AS MATERIALIZED (SELECT a.page_id, a.top, b.top AS next FROM tops a ASOF JOIN tops b
        ON a.page_id = b.page_id AND a.top + 5 < b.top),
    starts AS (SELECT page_id, min(top) AS top FROM tops GROUP BY page_id
        UNION ALL SELECT n.page_id, n.next FROM starts s JOIN nexts n ON n.page_id = s.page_id AND n.top = s.top),
    placed AS (SELECT w.*, s.top AS anchor FROM words w ASOF JOIN starts s ON w.page_id = s.page_id AND w.top >= s.top),
    lines AS (SELECT page_id, anchor, string_agg(text, ' ' ORDER BY top, x0) AS line FROM placed GROUP BY ALL)
    SELECT page_id, cast(row_number() OVER (PARTITION BY page_id ORDER BY anchor) - 1 AS integer) AS line_no, line FROM lines""")
def layout_words_to_lines(spark, d):
    """T11"""
    return documents.words_to_lines(_words(spark, d), ["page_id"])


@query("layout_blank_pages", f"""
    WITH p AS (SELECT regexp_extract(url, '//([^/]+)', 1) AS host,
        CASE WHEN page_id % 3 = 0 THEN '  ' || chr(9) WHEN page_id % 7 = 0 THEN '' ELSE html END AS text FROM pages)
    SELECT host, count(*) AS page_count, count(*) FILTER ({strip('text')} = '') AS blank_pages,
        count(*) FILTER ({strip('text')} = '') > count(*) * 0.5 AS warned FROM p GROUP BY host""")
def layout_blank_pages(spark, d):
    """T12"""
    pages = derive.load(spark, d, "pages").select(
        F.regexp_extract("url", "//([^/]+)", 1).alias("host"),
        F.expr("CASE WHEN page_id % 3 = 0 THEN '  ' || chr(9) WHEN page_id % 7 = 0 THEN '' ELSE html END").alias("text"))
    return documents.blank_page_warning(pages, ["host"])
