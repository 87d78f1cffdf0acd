"""Secrets in texts: fixed patterns, and strings that a language tokenizer encodes badly.

Prose costs a byte-pair vocabulary few tokens per character; random strings cost many.  A run of key
characters that yields fewer than ``least_ratio`` characters per token is reported, unless it is a known
digest (lower-case hexadecimal of a usual digest length), a UUID, a number or time, or an identifier:
words and counters joined by separators or told apart by case, each word of a good ratio itself.
"""

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaespark.llm.arrays import small_batches, text_column

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
#: Order in which kinds that begin at one place are listed.
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
#: Upper-case strings of these lengths are keys as often as digests: their ratio decides.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})")
NUMBER = re.compile(r"[0-9+/_=-]*|[0-9]{8}T[0-9]{4,6}Z?|[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2,6}Z?")
#: One word as prose writes it.  Clean documents have such words of up to 19 letters under the ratio.
PROSE, PROSE_MOST = re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), 19
SEPARATORS = re.compile(r"[-_/=+]+")
COUNTER = re.compile(r"[0-9]{1,8}|[A-Za-z][0-9]{0,3}")
UNIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

LEAST_RATIO = 2.0
SPANS = "doc_id long, spans array<struct<kind: string, start: int, end: int>>"

_VOCABULARIES: dict[str, object] = {}


def vocabulary(path: str, pattern: str):
    """A tiktoken encoding from a file of ranks; kept by the Python worker."""
    if path not in _VOCABULARIES:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _VOCABULARIES[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _VOCABULARIES[path]


def ratio(text: str, encoding) -> float:
    """Characters per token."""
    return len(text) / len(encoding.encode_ordinary(text))


def is_name(piece: str, encoding, least_ratio: float) -> bool:
    """A counter, or words told apart by case and numbers of up to three digits; short bits of case are no words."""
    if COUNTER.fullmatch(piece):
        return True
    units = UNIT.findall(piece)
    least = 3 if sum(u.isalpha() for u in units) > 1 else 2
    return all(len(u) >= least and ratio(u, encoding) >= least_ratio if u.isalpha() else len(u) <= 3 for u in units)


def is_known(text: str, encoding, least_ratio: float) -> bool:
    """Digests, UUIDs, numbers, words and identifiers are not secrets of their own."""
    bare = text.strip("=+/_-")
    if DIGEST.fullmatch(bare) or UUID.fullmatch(bare) or NUMBER.fullmatch(bare):
        return True
    if len(bare) <= PROSE_MOST and PROSE.fullmatch(bare):
        return True
    return all(is_name(piece, encoding, least_ratio) for piece in SEPARATORS.split(bare))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, in code points: the whole match each."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def random_spans(text: str, encoding, least_ratio: float = LEAST_RATIO) -> list[tuple[str, int, int]]:
    """Spans of strings with few characters per token."""
    out = []
    for m in CANDIDATE.finditer(text):
        if ratio(m[0], encoding) < least_ratio and not is_known(m[0], encoding, least_ratio):
            out.append(("random", *m.span()))
    return out


def find(docs: DataFrame, vocabulary_path: str, pattern: str, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """(doc_id, spans) for every document, spans by start, then kind.

    Null and empty texts have no spans.  Rows are independent of each other, so repeated rows give
    repeated rows, an empty table gives none, and further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding = vocabulary(vocabulary_path, pattern)
        for batch in batches:
            found = []
            for text in batch.column(1):
                text = text.as_py()
                spans = base_spans(text) + random_spans(text, coding, least_ratio)
                spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_column().alias("text")).mapInArrow(run, SPANS)


def redact(docs: DataFrame, vocabulary_path: str, pattern: str, mark: str = "[REDACTED]") -> DataFrame:
    """Documents with every span replaced by a mark; all columns stay, ``n_chars`` follows the text.

    A null text stays null.
    """
    schema = docs.schema
    at, size = schema.names.index("text"), schema.names.index("n_chars") if "n_chars" in schema.names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding = vocabulary(vocabulary_path, pattern)
        for batch in batches:
            columns, texts = list(batch.columns), []
            for value in batch.column(at):
                text = value.as_py()
                out, done = [], 0
                for _, a, b in sorted(base_spans(text or "") + random_spans(text or "", coding), key=lambda s: s[1:]):
                    if b > done:
                        out += [text[done:max(a, done)], mark]
                        done = b
                texts.append(text if not done else "".join([*out, text[done:]]))
            columns[at] = pa.array(texts, columns[at].type)
            if size is not None:
                changed = [None if n is None else len(t) if t != o else n for t, o, n in zip(
                    texts, batch.column(at).to_pylist(), batch.column(size).to_pylist())]
                columns[size] = pa.array(changed, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def digest(spans: list[tuple[str, int, int]]) -> tuple[str, str]:
    """Plain-Python form of the two digest columns, for tests: of base spans, and all as text."""
    text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k != "random")
    return hashlib.sha256(base.encode()).hexdigest(), text
