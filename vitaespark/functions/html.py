"""Repair of HTML fragments, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.functions.strings import SPACE, bind, or_empty, trimmed

_BLANK = f"[{SPACE}]*"


def tag_opens(html: Column, tag: str) -> Column:
    """H1: number of opening tags."""
    return F.regexp_count(html, F.lit(f"<{tag}[{SPACE}>]"))


def tag_closes(html: Column, tag: str) -> Column:
    """H1: number of closing tags, counted by length as they are fixed text."""
    closer = f"</{tag}>"
    left = F.length(F.replace(html, F.lit(closer), F.lit("")))
    return ((F.length(html) - left) / len(closer)).cast("int")


def strip_orphan_closers(html: Column) -> Column:
    """H2: drop runs of closing tags at both ends of a trimmed fragment."""
    tags = "|".join(fixed.ORPHAN_TAGS)
    run = f"(?:{_BLANK}</(?:{tags})>{_BLANK})+"
    return F.regexp_replace(F.regexp_replace(trimmed(html), f"^{run}", ""), f"{run}\\z", "")


def collapse_closers(html: Column) -> Column:
    """H3: two closing tags in a row become the second one (this also breaks proper nesting)."""
    tags = "|".join(fixed.COLLAPSE_TAGS)
    return F.regexp_replace(html, f"</(?:{tags})>{_BLANK}\\n?{_BLANK}</({tags})>", "</$1>")


def balance_tags(html: Column) -> Column:
    """H4: per tag, drop surplus closers at the end, then append missing ones."""
    for tag in fixed.BALANCED_TAGS:
        html = bind(html, lambda text, tag=tag: _balance_one(text, tag))
    return html


def _balance_one(html: Column, tag: str) -> Column:
    closer_run = f"(?:{_BLANK}</{tag}>)"

    def without_surplus(excess):
        # Of the closers that end the text, the first ones stay.
        tail = F.regexp_extract(html, f"{closer_run}+{_BLANK}\\z", 0)
        stay = F.greatest(tag_closes(tail, tag) - excess, F.lit(0)).cast("string")
        first = F.concat(F.lit(f"^{closer_run}{{"), stay, F.lit("}"))
        kept = F.call_function("regexp_extract", tail, first, F.lit(0))
        return F.concat(F.substring(html, F.lit(1), F.length(html) - F.length(tail)), kept)

    return bind(
        tag_closes(html, tag) - tag_opens(html, tag),
        lambda excess: F.when(excess > 0, without_surplus(excess))
        .when(excess < 0, F.concat(html, F.repeat(F.lit(f"</{tag}>"), -excess)))
        .otherwise(html),
    )


def collapse_newlines(html: Column) -> Column:
    """H5."""
    return F.regexp_replace(html, r"\n{3,}", "\n\n")


def repair_fragment(html: Column, collapse: bool = True) -> Column:
    """H2 to H5 in order; the collapsing step can be left out."""
    html = strip_orphan_closers(html)
    html = collapse_closers(html) if collapse else html
    return collapse_newlines(balance_tags(html))


def has_html_tag(html: Column) -> Column:
    """H6."""
    return html.rlike(f"(?i)<!DOCTYPE|<html[{SPACE}>]")


def has_body_tag(html: Column) -> Column:
    """H6."""
    return html.rlike(f"(?i)<body[{SPACE}>]")


def escape_html(value: Column) -> Column:
    """H7: null becomes an empty string."""
    value = or_empty(value.cast("string"))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(plain), F.lit(entity))
    return value
