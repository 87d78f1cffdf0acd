"""Text preparation as column expressions: normalising, quality tests, line arrays, sections.

A document is one row, so everything here stays inside that row: no shuffle, whatever
the number or length of documents.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.functions.strings import SPACE, WORD, bind, trimmed

_LINE = "(?md)"  # ^ and $ at line feeds only


def _join_cut_words(text: Column) -> Column:
    joined = F.regexp_replace(text, f"((?<![{WORD}])[{WORD}]++)-\n([{WORD}]+)", "$1$2")
    return F.when(F.contains(text, F.lit("-\n")), joined).otherwise(text)


def normalize_text(text: Column) -> Column:
    """Clean extracted text; the order of the steps matters."""
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.replace(text, F.lit("\f"), F.lit("\n"))
    text = F.regexp_replace(text, r"(?U)[\s\x1c-\x1f&&[^\n]]{2,}", " ")
    text = F.regexp_replace(text, r"\n{4,}", "\n\n\n")
    # Words cut at a line end are put together again.
    text = bind(text, _join_cut_words)
    blank = f"[{SPACE}]*"
    for pattern in (
        rf"{_LINE}^{blank}\p{{Nd}}+{blank}$",
        rf"{_LINE}^{blank}第{blank}\p{{Nd}}+{blank}页{blank}(?:共{blank}\p{{Nd}}+{blank}页)?{blank}$",
        rf"(?iumd)^{blank}Page[{SPACE}]+\p{{Nd}}+{blank}(?:of[{SPACE}]+\p{{Nd}}+)?{blank}$",
    ):
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def _count_left(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def printable_ratio(text: Column) -> Column:
    """Share of characters that are printable, counting line feed, tab and space."""
    bare = F.translate(trimmed(text), "\n\t ", "")
    unprintable = F.length(bare) - _count_left(bare, r"[\p{C}\p{Z}]+")
    return 1 - unprintable / F.greatest(F.length(trimmed(text)), F.lit(1))


def letter_ratio(text: Column) -> Column:
    """Share of letters, digits, CJK and kana characters."""
    bare = trimmed(text)
    others = _count_left(bare, r"[\p{L}\p{N}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]+")
    return (F.length(bare) - others) / F.greatest(F.length(bare), F.lit(1))


def is_meaningful(text: Column) -> Column:
    """Long enough, mostly printable, with enough letters."""
    return (
        (F.length(trimmed(text)) >= 20)
        & (printable_ratio(text) >= 0.8)
        & (letter_ratio(text) >= 0.25)
    )


def line_array(text: Column) -> Column:
    """The lines of a text; an index into it is the 0-based line number."""
    return F.split(text, "\n")


def section_of_heading(line: Column) -> Column:
    """Section key named by a trimmed heading line, null for any other line."""
    rules = None
    for key, patterns in fixed.SECTION_PATTERNS.items():
        test = line.rlike("(?iu)" + "|".join(patterns).replace(r"\s", f"[{SPACE}]"))
        rules = F.when(test, key) if rules is None else rules.when(test, key)
    short = F.length(line).between(fixed.HEADING_MIN, fixed.HEADING_MAX)
    return F.when(short, rules)


def section_runs(text: Column, merge_header: bool = True) -> Column:
    """T4 and T5: cut a text into runs of lines that belong to one section each.

    Gives ``array<struct<section_key, lines array<struct<line_no, line>>>>``.  A heading
    is a short line after a blank line (or at the start) that names a section; it stays
    in its section as content.  Blank lines are dropped.  With ``merge_header`` a short
    block before the first heading joins that heading's section; a document without
    any heading keeps its ``header`` section.
    """

    def marked(lines):
        def mark(line, at):
            after_blank = (at == 0) | (F.get(lines, at - 1) == "")
            key = F.when((line != "") & after_blank, section_of_heading(line))
            return F.struct(at.alias("line_no"), line.alias("line"), key.alias("key"))

        return F.transform(lines, mark)

    def cut(lines):
        first = F.array(F.struct(F.lit(0).alias("line_no"), F.lit("header").alias("key")))
        heads = F.filter(lines, lambda x: x["key"].isNotNull())
        return bind(
            F.concat(first, F.transform(heads, lambda x: F.struct(x["line_no"], x["key"]))),
            lambda starts: F.transform(starts, lambda s, i: run_at(lines, starts, s, i)),
        )

    def run_at(lines, starts, start, at):
        end = F.coalesce(F.get(starts, at + 1)["line_no"], F.size(lines))
        body = F.slice(lines, start["line_no"] + 1, end - start["line_no"])
        kept = F.transform(
            F.filter(body, lambda x: x["line"] != ""), lambda x: F.struct(x["line_no"], x["line"])
        )
        return F.struct(start["key"].alias("section_key"), kept.alias("lines"))

    def merged(runs):
        short = F.size(F.get(runs, 0)["lines"]) <= fixed.HEADER_MERGE_MAX
        goal = F.when(short, F.get(runs, 1)["section_key"])
        return F.transform(
            runs,
            lambda run, i: F.struct(
                F.when(i == 0, F.coalesce(goal, run["section_key"]))
                .otherwise(run["section_key"]).alias("section_key"),
                run["lines"].alias("lines"),
            ),
        )

    runs = bind(bind(F.transform(line_array(text), trimmed), marked), cut)
    runs = bind(runs, merged) if merge_header else runs
    return F.filter(runs, lambda run: F.size(run["lines"]) > 0)


def section_map(runs: Column) -> Column:
    """Fold runs into ``map<section_key, array<line>>``; repeated sections append."""

    def lines_of(runs, key):
        own = F.filter(runs, lambda run: run["section_key"] == key)
        return F.flatten(F.transform(own, lambda run: run["lines"]["line"]))

    return bind(
        runs,
        lambda runs: F.map_from_entries(
            F.transform(
                F.array_distinct(F.transform(runs, lambda run: run["section_key"])),
                lambda key: F.struct(key, lines_of(runs, key)),
            )
        ),
    )


def numbered_lines(text: Column) -> Column:
    """Line-numbered text: ``[0] first line`` and so on."""
    return F.array_join(
        F.transform(line_array(text), lambda line, i: F.concat(F.lit("["), i, F.lit("] "), line)), "\n"
    )


def section_label(key: Column, lang: str = "zh") -> Column:
    labels = None
    for name, (zh, en) in fixed.SECTION_LABELS.items():
        label = f"{zh} / {en}" if lang == "zh" else en
        labels = F.when(key == name, label) if labels is None else labels.when(key == name, label)
    return labels.otherwise(key)


def format_sections(text: Column, lang: str = "zh", merge_header: bool = True) -> Column:
    """Titled sections with source line numbers; a line points at its first equal line.

    A text without headings is numbered line by line instead.
    """
    rule = fixed.RULE_CHAR * fixed.RULE_WIDTH

    def block(key, lines, source):
        numbered = F.transform(
            lines,
            lambda line: F.concat(F.lit("["), F.array_position(source, line) - 1, F.lit("] "), line),
        )
        return F.concat(
            F.lit(f"\n{rule}\n【"), section_label(key, lang), F.lit(f"】\n{rule}\n"),
            F.array_join(numbered, "\n"),
        )

    def body(sections, source):
        return F.array_join(
            F.transform(F.map_keys(sections), lambda key: block(key, F.element_at(sections, key), source)),
            "\n",
        )

    def titled(sections, source):
        headed = F.exists(F.map_keys(sections), lambda key: key != "header")
        return F.when(headed, body(sections, source)).otherwise(numbered_lines(trimmed(text)))

    return bind(
        F.transform(line_array(trimmed(text)), trimmed),
        lambda source: bind(
            section_map(section_runs(text, merge_header)), lambda sections: titled(sections, source)
        ),
    )


def line_of(source_lines: Column, trimmed_lines: Column, needle: Column) -> Column:
    """Number of the first trimmed line equal to the needle, else first line holding it, else -1."""
    def search(needle):
        equal = F.array_position(trimmed_lines, needle)
        holds = F.array_position(F.transform(source_lines, lambda x: F.contains(x, needle)), F.lit(True))
        at = F.coalesce(F.nullif(equal, F.lit(0)), F.nullif(holds, F.lit(0)), F.lit(0)) - 1
        return F.when(needle == "", F.lit(-1)).otherwise(at).cast("int")

    return bind(trimmed(needle), search)


def short_line_ratio(text: Column, width: int = 30) -> Column:
    """Share of non-blank lines shorter than ``width``, over all lines."""
    return bind(
        F.transform(line_array(text), trimmed),
        lambda lines: F.size(F.filter(lines, lambda x: F.length(x).between(1, width - 1))) / F.size(lines),
    )
