"""Pieces of SQL for the checking database (its pattern engine has no lookaround)."""

from vitaespark import fixed
from vitaespark.functions.strings import SPACE, SPACE_NO_LF, WHITESPACE, WORD
from vitaespark.workload import derive

NL = "chr(10)"
CJK = r"\x{4e00}-\x{9fff}"


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"trim({expr}, {q(WHITESPACE)})"


def unicode(pattern: str) -> str:
    return (
        pattern.replace(r"[-\s", f"[-{SPACE}").replace(r"[\s", f"[{SPACE}")
        .replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        .replace(r"\d", r"\p{Nd}").replace(r"\w", f"[{WORD}]")
    )


def sub(expr: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(to)}, {q(flags)})"


def first(expr: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({expr}, {q(pattern)}, {group}), '')"


def every(expr: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({expr}, {q(pattern)}, {group})"


def distinct(items: str) -> str:
    """Drop repeats, keep the first of each in order."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def joined(items: str) -> str:
    return f"coalesce(array_to_string({items}, '|'), '')"


def normalized(expr: str) -> str:
    blank = f"[{SPACE}]*"
    text = f"replace(replace(replace({expr}, chr(13) || chr(10), {NL}), chr(13), {NL}), chr(12), {NL})"
    text = sub(text, f"[{SPACE_NO_LF}]{{2,}}", " ")
    text = f"regexp_replace({text}, {q(r'\n{4,}')}, {NL} || {NL} || {NL}, 'g')"
    text = sub(text, f"([{WORD}]+)-\\n([{WORD}]+)", r"\1\2")
    for pattern in (
        rf"(?m)^{blank}\p{{Nd}}+{blank}$",
        rf"(?m)^{blank}第{blank}\p{{Nd}}+{blank}页{blank}(?:共{blank}\p{{Nd}}+{blank}页)?{blank}$",
        rf"(?im)^{blank}Page[{SPACE}]+\p{{Nd}}+{blank}(?:of[{SPACE}]+\p{{Nd}}+)?{blank}$",
    ):
        text = sub(text, pattern)
    return f"regexp_replace({text}, {q(r'\n{3,}')}, {NL} || {NL}, 'g')"


RESUMES = derive.RESUME_TEXT_SQL
POSTINGS = derive.POSTING_TEXT_SQL
NORMAL = f"SELECT doc_id, {normalized('text')} AS text FROM ({RESUMES})"


def heading_key(line: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({line}, {q('(?i)' + '|'.join(p).replace(chr(92) + 's', f'[{SPACE}]'))}) THEN '{key}'"
        for key, p in fixed.SECTION_PATTERNS.items()
    )
    low, high = fixed.HEADING_MIN, fixed.HEADING_MAX
    return f"CASE WHEN length({line}) BETWEEN {low} AND {high} THEN (CASE {whens} END) END"


LINES = f"""
src AS ({NORMAL}),
raw_lines AS (SELECT doc_id, unnest(string_split(text, {NL})) AS raw,
    generate_subscripts(string_split(text, {NL}), 1) - 1 AS line_no FROM src),
lines AS (SELECT doc_id, line_no, {strip('raw')} AS line FROM raw_lines)"""

SECTIONS = f"""{LINES},
prevs AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM lines),
keyed AS (SELECT *, CASE WHEN line <> '' AND coalesce(prev, '') = '' THEN {heading_key('line')} END AS k FROM prevs),
filled AS (SELECT doc_id, line_no, line, coalesce(last_value(k IGNORE NULLS) OVER
    (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'header') AS section_key FROM keyed),
kept AS (SELECT * FROM filled WHERE line <> ''),
headed AS (SELECT *, count(*) FILTER (section_key = 'header') OVER (PARTITION BY doc_id) AS n_header,
    first_value(CASE WHEN section_key <> 'header' THEN section_key END IGNORE NULLS) OVER
    (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS goal FROM kept),
sections AS (SELECT doc_id, line_no, line, CASE WHEN section_key = 'header' AND n_header <= {fixed.HEADER_MERGE_MAX}
    THEN coalesce(goal, 'header') ELSE section_key END AS section_key FROM headed)"""
