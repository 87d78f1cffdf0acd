"""Small string helpers shared by all column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode text tools understand it (the built-in trim only drops spaces).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set inside a regular-expression class; SPACE_NO_LF leaves out the line feed.
SPACE_NO_LF = (
    r"\t\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = r"\n" + SPACE_NO_LF
WORD = r"\p{L}\p{N}_"


def trimmed(text: Column) -> Column:
    """Drop all leading and trailing Unicode white space."""
    return F.btrim(text, F.lit(WHITESPACE))


def unempty(text: Column) -> Column:
    """Empty strings become null, so ``coalesce`` treats them as absent."""
    return F.nullif(text, F.lit(""))


def bind(value: Column, body) -> Column:
    """Compute ``value`` once and hand it to ``body``, also when used inside array functions."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def first_present(*values: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[unempty(v) for v in values])


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def regex_first(text: Column, pattern: str, group: int = 0) -> Column:
    """First match (or one of its groups), null when there is none."""
    return unempty(F.regexp_extract(text, pattern, group))


def regex_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def fold_case(text: Column) -> Column:
    """Lower case, with the two look-alike letters that case-blind matching folds to s and i."""
    rare = "\u017f\u0131\u0130"
    some = F.contains(text, F.lit(rare[0])) | F.contains(text, F.lit(rare[1])) | F.contains(text, F.lit(rare[2]))
    return F.lower(F.when(some, F.translate(text, rare, "sii")).otherwise(text))


def fill_template(template: str, **values: Column) -> Column:
    """Replace ``{name}`` marks by columns; each template piece becomes one ``concat`` argument."""
    parts, rest = [], template
    while rest:
        marks = [(rest.find("{" + name + "}"), name) for name in values if "{" + name + "}" in rest]
        if not marks:
            break
        at, name = min(marks)
        parts += [F.lit(rest[:at])] * (at > 0) + [or_empty(values[name].cast("string"))]
        rest = rest[at + len(name) + 2:]
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts) if len(parts) > 1 else parts[0]
