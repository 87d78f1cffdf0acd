"""A byte model by context-tree weighting.

A text is its lower-case words, each followed by a space, and an end byte.  Every byte is eight binary
decisions; each decision has a tree over the preceding bytes, 0 to ``DEPTH`` of them.  A node estimates
by Krichevsky-Trofimov, and a tree node's weighted probability is half its own estimate and half its
children's product.  Trained counts stay fixed: a prediction mixes all depths of its context, each by
the posterior weight that the tree stops there.  A context never seen ends the path.

Counting is a distributed count of (context, byte); trees are split by the last two bytes of context,
and only what lies above (at most 256 x 255 nodes, whatever the input) is common to all tasks.
For scoring, documents are dealt into chunks; each chunk asks for the entries that occur in it,
so no task holds the whole model or vocabulary.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaespark.llm.arrays import LOWER, SPACED, small_batches, steps, text_column, utf8, word_hashes, words, written

DEPTH = 5
#: Characters of text in one chunk: what is scored together, with the entries it needs.
CHUNK_CHARS = 32_000_000
#: Keys of a chunk that are gathered before repeats go.
MERGE = 1_000_000
#: Bytes of text that are scored at a time.
SCORE_BYTES = 500_000
END, SPACE = 0x0A, 0x20
#: The end of a text counts as a token; its key in place of a word's hash.
END_KEY = 0x5EED
TOKEN, GRAM = 0, 1


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, byte) codes of a run of texts, the text each belongs to, and the hash of every word with its text.

    Returns codes, where each text's codes begin, word hashes, and where each text's words begin.
    """
    begin, end, first = words(data, offsets, SPACED)
    docs = len(offsets) - 1
    length = end - begin
    # each text: DEPTH end bytes as context of its start, words with a space after each, an end byte
    sizes = np.bincount(np.repeat(np.arange(docs), np.diff(first)), weights=length + 1, minlength=docs).astype(np.int64) if len(begin) else np.zeros(docs, np.int64)
    start = np.concatenate([[0], np.cumsum(sizes + DEPTH + 1)])
    out = np.full(start[-1], END, np.uint8)
    if len(begin):
        at = np.cumsum(length + 1) - (length + 1)
        owner = np.repeat(np.arange(docs), np.diff(first))
        place = at + (owner + 1) * DEPTH + owner
        source = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        out[source + np.repeat(place, length)] = data[source + np.repeat(begin, length)]
        out[place + length] = SPACE
    code = np.zeros(max(0, len(out) - DEPTH), np.int64)
    for k in range(DEPTH + 1):
        code = (code << 8) | out[k:len(out) - DEPTH + k]
    kept = np.ones(len(code), bool)
    for k in range(DEPTH):
        kept[np.maximum(start[1:-1] - 1 - k, 0)] = False
    owner_first = start[:-1] - np.arange(docs) * DEPTH
    hashes = word_hashes(data, begin, end).view(np.int64) if len(begin) else np.zeros(0, np.int64)
    return code[kept], np.append(owner_first, len(out) - docs * DEPTH), hashes, first


def counted(keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.concatenate(keys)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n = np.concatenate(weights)[order]
    return key[first], np.add.reduceat(n, first) if len(first) else n


def entries(batches: Iterator[pa.RecordBatch], text: int, learn: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, keys, training counts) of texts; keys that occur in other texts only have count 0."""
    kept: dict[int, tuple[list, list]] = {TOKEN: ([], []), GRAM: ([], [])}
    held = 0
    for batch in batches:
        raw, offsets = utf8(batch.column(text))
        learns = batch.column(learn).to_numpy(zero_copy_only=False).astype(bool)
        for a, b in steps(offsets):
            data, own = LOWER[raw[offsets[a]:offsets[b]]], offsets[a:b + 1] - offsets[a]
            code, starts, hashes, first = stream(data, own)
            mine = learns[a:b]
            tokens = np.concatenate([hashes, np.full(b - a, END_KEY)])
            of_token = np.concatenate([np.repeat(mine, np.diff(first)), mine])
            for kind, keys, flags in ((TOKEN, tokens, of_token), (GRAM, code, np.repeat(mine, np.diff(starts)))):
                key, n = np.unique(keys[flags], return_counts=True)
                other = distinct(keys[~flags])
                kept[kind][0].extend((key, other))
                kept[kind][1].extend((n, np.zeros(len(other), np.int64)))
                held += len(key) + len(other)
            if held > 3_000_000:
                for kind in kept:
                    key, n = counted(*kept[kind])
                    kept[kind] = ([key], [n])
                held = sum(len(kept[k][0][0]) for k in kept)
                if held > 2_000_000:
                    for kind in kept:
                        yield kind, kept[kind][0][0], kept[kind][1][0]
                        kept[kind] = ([], [])
                    held = 0
    for kind in kept:
        key, n = counted(*kept[kind])
        if len(key):
            yield kind, key, n


# ---- the model ----

def log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    small = x < 8
    y = np.where(small, x + 8, x)
    for k in range(8):
        shift -= np.where(small, np.log(np.where(small, x + k, 1.0)), 0)
    inverse = 1 / y
    series = inverse / 12 - inverse ** 3 / 360 + inverse ** 5 / 1260
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series + shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of a bit sequence with these counts, by Krichevsky-Trofimov."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def log_weighted(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, children) + np.log(0.5)


def decisions(code: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """The binary node (1 to 255) that a byte passes as its decision number ``bit``, and the way it takes."""
    byte = code & 255
    return (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1


class Subtree:
    """The nodes of depth ``top`` and deeper of one decision's tree, for (context, byte) codes with counts."""

    def __init__(self, code: np.ndarray, n: np.ndarray, top: int, bit: int):
        self.code, self.bit, self.nodes = code, bit, {}
        node, way = decisions(code, bit)
        below = None
        for depth in reversed(range(top, DEPTH + 1)):
            context = (code >> 8) & ((1 << 8 * depth) - 1)
            key, first, at = np.unique((context << 8) | node, return_index=True, return_inverse=True)
            ones = np.bincount(at, weights=n * way, minlength=len(key))
            zeros = np.bincount(at, weights=n, minlength=len(key)) - ones
            own = log_kt(zeros, ones)
            total = own if below is None else log_weighted(own, np.bincount(at[below[0]], weights=below[1], minlength=len(key)))
            self.nodes[depth] = (key, at, zeros, ones, own, total)
            below = (first, total)

    def mixed(self, depth: int, deeper: np.ndarray | None, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each code's way at the decision, from this depth down, and whether the context was seen."""
        _, at, zeros, ones, own, total = self.nodes[depth]
        _, way = decisions(self.code, self.bit)
        return mix_down(zeros[at], ones[at], own[at], total[at], way, deeper, seen)


def mix_down(zeros, ones, own, total, way, deeper, seen):
    here = (np.where(way == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
    if deeper is not None:
        stop = np.exp(np.log(0.5) + own - total)
        here = np.where(seen, stop * here + (1 - stop) * deeper, here)
    return here, zeros + ones > 0


def _pair(key: Column) -> Column:
    return F.shiftright(key, 8).bitwiseAND(F.lit(0xFFFF))


def train(grams: DataFrame) -> DataFrame:
    """(key, value): log10 probability of the byte in its context, for every (key, n) of the counts."""
    spark = grams.sparkSession

    def tops(table: pa.Table) -> pa.Table:
        code, n = table.column("key").to_numpy(), table.column("n").to_numpy()
        rows = [Subtree(code, n, 2, bit).nodes[2] for bit in range(8)]
        key = np.concatenate([r[0] for r in rows])
        return pa.table({"last": (key >> 8) & 255, "node": key & 255, "zeros": np.concatenate([r[2] for r in rows]),
                         "ones": np.concatenate([r[3] for r in rows]), "total": np.concatenate([r[5] for r in rows])})

    paired = grams.withColumn("pair", _pair(F.col("key")))
    upper = paired.groupBy("pair").applyInArrow(tops, "last long, node long, zeros double, ones double, total double")
    # depth 1: at most 256 x 255 rows; the order of addition is fixed for equal results
    rows = upper.groupBy("last", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("total")).orderBy("last", "node").collect()
    size = (256, 256)
    zeros, ones, below = np.zeros(size), np.zeros(size), np.zeros(size)
    for last, node, z, o, t in rows:
        zeros[last, node], ones[last, node], below[last, node] = z, o, t
    own1 = log_kt(zeros, ones)
    total1 = log_weighted(own1, below)
    zeros0, ones0 = zeros.sum(axis=0), ones.sum(axis=0)
    own0 = log_kt(zeros0, ones0)
    total0 = log_weighted(own0, total1.sum(axis=0))
    sent = spark.sparkContext.broadcast((zeros, ones, own1, total1, zeros0, ones0, own0, total0))

    def logs(table: pa.Table) -> pa.Table:
        zeros, ones, own1, total1, zeros0, ones0, own0, total0 = sent.value
        code, n = table.column("key").to_numpy(), table.column("n").to_numpy()
        last, out = (code >> 8) & 255, np.zeros(len(code))
        for bit in range(8):
            tree, deeper, seen = Subtree(code, n, 2, bit), None, None
            for depth in reversed(range(2, DEPTH + 1)):
                deeper, seen = tree.mixed(depth, deeper, seen)
            node, way = decisions(code, bit)
            deeper, seen = mix_down(zeros[last, node], ones[last, node], own1[last, node], total1[last, node], way, deeper, seen)
            deeper, _ = mix_down(zeros0[node], ones0[node], own0[node], total0[node], way, deeper, seen)
            out += np.log10(deeper)
        return pa.table({"key": code, "value": out})

    return written(paired.groupBy("pair").applyInArrow(logs, "key long, value double"), "model")


# ---- scoring ----

ASKED = "chunk int, kind int, key long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, count_logs double, score double, bytes long"


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted without repeats; by a sort, which takes less time here than the hash table of ``np.unique``."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def chunk_keys(chunk: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What one chunk asks for; its texts are read batch by batch."""
    kept: dict[int, list] = {TOKEN: [np.array([END_KEY])], GRAM: []}
    held = 0
    for batch in batches:
        raw, offsets = utf8(batch.column("text"))
        for a, b in steps(offsets):
            code, _, hashes, _ = stream(LOWER[raw[offsets[a]:offsets[b]]], offsets[a:b + 1] - offsets[a])
            for kind, keys in ((TOKEN, hashes), (GRAM, code)):
                kept[kind].append(distinct(keys))
                held += len(kept[kind][-1])
            if held > MERGE:
                kept, held = {kind: [distinct(np.concatenate(keys))] for kind, keys in kept.items()}, 0
    for kind, keys in kept.items():
        key = distinct(np.concatenate(keys))
        for at in range(0, len(key), 100_000):
            part = key[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(part), chunk[0].as_py()), pa.int32()), pa.array(np.full(len(part), kind), pa.int32()), pa.array(part)],
                ["chunk", "kind", "key"])


def score_chunk(docs: pa.Table, looked: pa.Table) -> pa.Table:
    tables = {}
    for k in (TOKEN, GRAM):
        own = looked.column("kind").to_numpy() == k
        tables[k] = (pd.Index(looked.column("key").to_numpy()[own]), looked.column("value").to_numpy()[own])
    known, count = tables[TOKEN]
    codes, logs = tables[GRAM]
    out = []
    for batch in docs.select(["doc_id", "held_out", "text"]).to_batches(max_chunksize=1000):
        raw, offsets = utf8(batch.column(2))
        for a, b in steps(offsets, SCORE_BYTES):
            data, own = LOWER[raw[offsets[a]:offsets[b]]], offsets[a:b + 1] - offsets[a]
            code, starts, hashes, first = stream(data, own)
            per_byte = np.concatenate([[0.0], np.cumsum(logs[codes.get_indexer(code)])])
            seen = count[known.get_indexer(hashes)]
            end = float(count[known.get_loc(END_KEY)])
            n_known = np.concatenate([[0], np.cumsum(seen > 0)])
            count_logs = np.concatenate([[0.0], np.cumsum(np.log10(seen + 1))])
            out.append(pa.table({
                "doc_id": batch.column(0).slice(a, b - a), "held_out": batch.column(1).slice(a, b - a),
                "n_tokens": np.diff(first) + 1, "n_known": n_known[first[1:]] - n_known[first[:-1]] + int(end > 0),
                "count_logs": count_logs[first[1:]] - count_logs[first[:-1]] + np.log10(end + 1),
                "score": per_byte[starts[1:]] - per_byte[starts[:-1]], "bytes": np.diff(starts)}))
    return pa.concat_tables(out)


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) per row.

    Rows where ``held_out`` is not true are learned from.  Null and empty texts are an end token alone.
    Repeated rows are learned and scored once each; with nothing to learn every count is 0 and every bit has
    probability one half.  An empty table gives no rows; further columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(held_out, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), (~held).alias("learn"), text_column().alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, key, n in entries(batches, 1, 0):
            for at in range(0, len(key), 100_000):
                part = key[at:at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind), pa.int32()), pa.array(part), pa.array(n[at:at + 100_000])], ["kind", "key", "n"])

    counts = docs.select("learn", "text").mapInArrow(count, "kind int, key long, n long")
    counts = written(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    size = counts.where(f"kind = {TOKEN} and n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    model = train(counts.where(f"kind = {GRAM}").select("key", "n"))
    values = counts.where(f"kind = {TOKEN}").select("kind", "key", F.col("n").cast("double").alias("value")).union(
        model.select(F.lit(GRAM).alias("kind"), "key", "value"))

    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = chars // CHUNK_CHARS + 1
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "held_out", "learn", "text")
    asked = dealt.groupBy("chunk").applyInArrow(chunk_keys, ASKED)
    looked = asked.join(values, ["kind", "key"]).select("chunk", "kind", "key", "value")
    scored = dealt.groupBy("chunk").cogroup(looked.groupBy("chunk")).applyInArrow(score_chunk, SCORED)
    base = F.col("count_logs") - F.col("n_tokens") * F.lit(float(np.log10(size.n + size.v + 1)))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(size.n).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        (-F.col("score") / F.col("bytes") * float(np.log2(10))).alias("bits_per_byte"))
