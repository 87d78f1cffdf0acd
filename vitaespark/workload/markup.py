"""Registered queries: HTML fragment repair (H1 to H7)."""

from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.functions import html as H
from vitaespark.workload import derive
from vitaespark.workload.registry import query
from vitaespark.workload.sqltext import NL, SPACE, q, strip, sub

_BLANK = f"[{SPACE}]*"
# Pages with orphan closers and blank lines at both ends.
_FRAGMENT = (
    f"CASE page_id % 4 WHEN 0 THEN ' </div>' || {NL} || '</p> ' WHEN 1 THEN '<p>a' ELSE '' END || html || "
    f"CASE page_id % 3 WHEN 0 THEN '</div>' || {NL} || '</div></p> ' WHEN 1 THEN '<b>x</b></div> tail </span></span>' ELSE "
    f"{NL} || {NL} || {NL} || {NL} || '<h3>open' END"
)
_PAGES = f"SELECT page_id, {_FRAGMENT} AS html FROM pages"


def fragments(spark, d):
    return derive.as_frame(derive.load(spark, d, "pages"), {"page_id": "page_id", "html": _FRAGMENT})


def _opens(tag):
    return f"len(regexp_extract_all(html, {q(f'<{tag}[{SPACE}>]')}))"


def _closes(tag):
    return f"len(regexp_extract_all(html, '</{tag}>'))"


@query("html_tag_balance", " UNION ALL ".join(
    f"SELECT page_id, '{t}' AS tag, cast({_opens(t)} AS integer) AS opens, cast({_closes(t)} AS integer) AS closes,"
    f" cast({_closes(t)} - {_opens(t)} AS integer) AS excess FROM ({_PAGES})" for t in fixed.BALANCED_TAGS))
def html_tag_balance(spark, d):
    """H1"""
    html = F.col("html")
    counts = F.array(*[F.struct(
        F.lit(t).alias("tag"), H.tag_opens(html, t).alias("opens"), H.tag_closes(html, t).alias("closes"))
        for t in fixed.BALANCED_TAGS])
    rows = fragments(spark, d).select("page_id", F.explode(counts).alias("c")).select("page_id", "c.*")
    return rows.withColumn("excess", F.col("closes") - F.col("opens"))


_RUN = f"(?:{_BLANK}</(?:{'|'.join(fixed.ORPHAN_TAGS)})>{_BLANK})+"
_STRIPPED = sub(sub(strip("html"), f"^{_RUN}", "", ""), f"{_RUN}$", "", "")
_COLLAPSED = sub("html", f"</(?:div|p|h3)>{_BLANK}\\n?{_BLANK}</(div|p|h3)>", r"</\1>")


@query("html_strip_orphans", f"SELECT page_id, {_STRIPPED} AS html FROM ({_PAGES})")
def html_strip_orphans(spark, d):
    """H2"""
    return fragments(spark, d).select("page_id", H.strip_orphan_closers(F.col("html")).alias("html"))


@query("html_collapse_closers", f"SELECT page_id, {_COLLAPSED} AS html FROM ({_PAGES})")
def html_collapse_closers(spark, d):
    """H3"""
    return fragments(spark, d).select("page_id", H.collapse_closers(F.col("html")).alias("html"))


def _balance_sql(level):
    """H4 in SQL, one tag per level: cut at most the surplus off the end, else append."""
    for tag in fixed.BALANCED_TAGS:
        run = f"((?:{_BLANK}</{tag}>)+){_BLANK}$"
        level = f"""SELECT page_id, CASE WHEN excess < 0 THEN html || repeat('</{tag}>', -excess)
            WHEN excess > 0 AND tail <> '' THEN regexp_replace(html, {q(run)}, '') || array_to_string(list_slice(
                regexp_extract_all(tail, {q(f'{_BLANK}</{tag}>')}), 1, greatest(n_tail - excess, 0)), '')
            ELSE html END AS html FROM (SELECT *, len(regexp_extract_all(tail, '</{tag}>')) AS n_tail FROM (
                SELECT page_id, html, cast({_closes(tag)} - {_opens(tag)} AS integer) AS excess,
                regexp_extract(html, {q(run)}) AS tail FROM ({level})))"""
    return level


@query("html_balance", _balance_sql(_PAGES))
def html_balance(spark, d):
    """H4"""
    return fragments(spark, d).select("page_id", H.balance_tags(F.col("html")).alias("html"))


@query("html_collapse_newlines", f"""
    SELECT page_id, regexp_replace(html, '\\n{{3,}}', {NL} || {NL}, 'g') AS html FROM ({_PAGES})""")
def html_collapse_newlines(spark, d):
    """H5"""
    return fragments(spark, d).select("page_id", H.collapse_newlines(F.col("html")).alias("html"))


@query("html_document_flags", f"""
    SELECT page_id, regexp_matches(html, {q(f'(?i)<!DOCTYPE|<html[{SPACE}>]')}) AS has_html,
        regexp_matches(html, {q(f'(?i)<body[{SPACE}>]')}) AS has_body
    FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '<body', '<bodyx', 'g')
        WHEN page_id % 7 = 1 THEN regexp_replace(html, '<!DOCTYPE html><html', '<htm', 'g') ELSE html END AS html FROM pages)""")
def html_document_flags(spark, d):
    """H6"""
    changed = F.expr("CASE WHEN page_id % 3 = 0 THEN replace(html, '<body', '<bodyx')"
                     " WHEN page_id % 7 = 1 THEN replace(html, '<!DOCTYPE html><html', '<htm') ELSE html END")
    pages = derive.load(spark, d, "pages").select("page_id", changed.alias("html"))
    return pages.select("page_id", H.has_html_tag(F.col("html")).alias("has_html"), H.has_body_tag(F.col("html")).alias("has_body"))


@query("html_escape", """
    SELECT page_id, replace(replace(replace(replace(replace(coalesce(h, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
        '"', '&quot;'), chr(39), '&#x27;') AS html
    FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL ELSE html || chr(39) || '&amp;' END AS h FROM pages)""")
def html_escape(spark, d):
    """H7"""
    value = F.expr("CASE WHEN page_id % 5 = 0 THEN NULL ELSE html || chr(39) || '&amp;' END")
    return derive.load(spark, d, "pages").select("page_id", H.escape_html(value).alias("html"))


@query("html_repair", f"""SELECT page_id, regexp_replace(html, '\\n{{3,}}', {NL} || {NL}, 'g') AS html FROM (
    {_balance_sql(f"SELECT page_id, {_COLLAPSED} AS html FROM (SELECT page_id, {_STRIPPED} AS html FROM ({_PAGES}))")})""")
def html_repair(spark, d):
    """H2 to H5 in order"""
    return fragments(spark, d).select("page_id", H.repair_fragment(F.col("html")).alias("html"))
