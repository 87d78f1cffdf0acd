"""Benchmark passages in training documents.

Each shard of documents (about a megabyte of text inside one task) gets an FM-index over its words: a
document's words followed by an end symbol of its own.  All windows of the benchmark are searched
backwards through wavelet ranks, their occurrences located by sampled suffix positions, and
overlapping ones merged into spans.  There is no shuffle.  The benchmark goes to the tasks in blocks
of bounded size; a larger benchmark takes further passes over the documents.
"""

from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaespark.llm.arrays import ALNUM, LOWER, small_batches, steps, text_column, utf8, word_hashes, words, written
from vitaespark.llm.fmindex import FMIndex

WINDOW = 10
SHARD_BYTES = 1_000_000
#: Bytes of benchmark text that one pass takes: what a broadcast may cost a task.
BLOCK_BYTES = 16_000_000

HIT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32())])
FOUND = "n_words long, hits array<struct<start: int, end: int, char_start: int, char_end: int>>, items array<long>"


def windows(rows: list, size: int) -> tuple[dict[int, np.ndarray], dict[int, list[list[int]]]]:
    """Distinct windows of word hashes by length, and the items each one comes from."""
    items = [r for r in rows if r[0] is not None]
    raw, offsets = utf8(pa.array([r[1] or "" for r in items], pa.string()))
    data = LOWER[raw]
    begin, end, first = words(data, offsets, ALNUM)
    hashes = word_hashes(data, begin, end)
    owners: dict[tuple, set[int]] = defaultdict(set)
    for k, (item, _) in enumerate(items):
        own = hashes[first[k]:first[k + 1]].tolist()
        for at in range(max(1, len(own) - size + 1) if own else 0):
            owners[tuple(own[at:at + size])].add(item)
    by_length: dict[int, list[tuple]] = defaultdict(list)
    for key in owners:
        by_length[len(key)].append(key)
    return ({n: np.array(keys, np.uint64) for n, keys in by_length.items()},
            {n: [sorted(owners[k]) for k in keys] for n, keys in by_length.items()})


def search_shard(hashes: np.ndarray, first: np.ndarray, patterns, owners) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Which words of a shard are hit, and the items found in each of its documents."""
    docs, n = len(first) - 1, len(hashes)
    hit, found = np.zeros(n + 1, np.int64), defaultdict(set)
    known, symbol = np.unique(hashes, return_inverse=True)
    # an end symbol of its own after each document: 0, 1, ... in order; words follow
    doc_of = np.repeat(np.arange(docs), np.diff(first))
    text = np.empty(n + docs, np.int64)
    text[np.arange(n) + doc_of] = symbol + docs
    text[first[1:] + np.arange(docs)] = np.arange(docs)
    index = FMIndex(text)
    for size, keys in patterns.items():
        at = np.searchsorted(known, keys)
        there = (known[np.minimum(at, len(known) - 1)] == keys).all(axis=1)
        which = np.flatnonzero(there)
        if not len(which):
            continue
        low, high = index.search(at[which] + docs)
        times = np.maximum(high - low, 0)
        rows = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        where, pattern = index.locate(rows), np.repeat(which, times)
        doc = np.searchsorted(first[1:] + np.arange(docs), where, "right")
        word = where - doc
        np.add.at(hit, word, 1)
        np.add.at(hit, word + size, -1)
        for pair in np.unique(doc * len(keys) + pattern).tolist():
            found[pair // len(keys)].update(owners[size][pair % len(keys)])
    return np.cumsum(hit)[:n] > 0, found


def spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of true values."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def merged(old: list, new: list) -> list:
    """Spans of two passes, overlapping or touching ones joined."""
    out = []
    for span in sorted(old + new, key=lambda s: s["start"]):
        if out and span["start"] <= out[-1]["end"]:
            if span["end"] > out[-1]["end"]:
                out[-1] |= {"end": span["end"], "char_end": span["char_end"]}
        else:
            out.append(dict(span))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Columns ``row`` (all columns of a document), ``text``, ``n_words``, ``hits`` and ``items``.

    Hits are merged spans of words with their code points.  Null and empty texts have no words; items
    without words or id, and an empty benchmark, hit nothing; repeated documents and items are judged
    each as if alone.  Further columns of the documents stay inside ``row``, whatever their names.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    benchmark = benchmark.select(F.col("item_id").cast("long"), text_column().alias("text"))
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, ceil(total / BLOCK_BYTES))
    frame = docs.select(
        F.struct("*").alias("row"), text_column().alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<start:int,end:int,char_start:int,char_end:int>>)").alias("hits"),
        F.expr("cast(array() as array<bigint>)").alias("items"))
    schema = frame.schema
    for block in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast(windows(part.collect(), size))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            patterns, owners = sent.value
            for batch in batches:
                raw, offsets = utf8(batch.column(1))
                counts, hits, items = [], batch.column(3).to_pylist(), batch.column(4).to_pylist()
                for a, b in steps(offsets, SHARD_BYTES):
                    data = LOWER[raw[offsets[a]:offsets[b]]]
                    own = offsets[a:b + 1] - offsets[a]
                    begin, end, first = words(data, own, ALNUM)
                    counts.append(np.diff(first))
                    if not len(begin):
                        continue
                    hit, found = search_shard(word_hashes(data, begin, end), first, patterns, owners)
                    if not found:
                        continue
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    for k, got in found.items():
                        f, zero = first[k], chars[own[k]]
                        new = [{"start": int(s), "end": int(e), "char_start": int(chars[begin[f + s]] - zero),
                                "char_end": int(chars[end[f + e - 1]] - zero)} for s, e in zip(*spans(hit[f:first[k + 1]]))]
                        hits[a + k] = merged(hits[a + k], new)
                        items[a + k] = sorted({*items[a + k], *got})
                n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(hits, pa.list_(HIT)),
                     pa.array(items, pa.list_(pa.int64()))], ["row", "text", "n_words", "hits", "items"])

        frame = frame.mapInArrow(run, schema)
        if block + 1 < blocks:
            frame = written(frame, "passes")
    return frame


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents without their hit spans; all columns stay, ``n_chars`` follows the text.

    A document whose words are all hit is left out; one that is not hit stays as it is, empty or not.
    """
    found = scan(docs, benchmark, size)
    hit = F.aggregate("hits", F.lit(0), lambda n, h: n + h.end - h.start)
    rest = F.array_join(F.transform(
        F.sequence(F.lit(0), F.size("hits")),
        lambda k: F.substring(
            "text", F.coalesce(F.get("hits", k - 1)["char_end"], F.lit(0)) + 1,
            F.coalesce(F.get("hits", k)["char_start"], F.length("text")) - F.coalesce(F.get("hits", k - 1)["char_end"], F.lit(0)))), "")
    cut = found.where((F.size("hits") == 0) | (hit < F.col("n_words"))).withColumn("rest", rest)
    touched = F.size("hits") > 0
    fresh = {"text": F.col("rest"), "n_chars": F.length("rest").cast("long")}
    return cut.select(*[
        (F.when(touched, fresh[c]).otherwise(F.col(f"row.`{c}`")) if c in fresh else F.col(f"row.`{c}`")).alias(c)
        for c in docs.columns])
