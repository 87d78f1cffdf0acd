"""Quality of documents by votes of their nearest labelled neighbours in a latent-semantic space.

Terms are hashed character trigrams, shapes of words, and words that repeat their predecessor.
A bounded sample of labelled documents gives idf weights and a truncated singular value decomposition,
by power steps over the sample's parts in the tasks; the sample's vectors (its size is a parameter) go to every task, which takes exact cosine products of
its documents with all of them, block by block.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaespark.llm.arrays import LOWER, SPACED, small_batches, steps, text_column, utf8, word_hashes, words, written

#: Labelled documents of each class that are fitted and sent to the tasks, at most.
SAMPLE_PER_CLASS = 3000
TRIGRAMS, SHAPES, REPEATS = 3072, 960, 64
TERMS = TRIGRAMS + SHAPES + REPEATS
RANK = 64
#: Tasks that add up products over the sample: so many matrices come to the driver in a step.
SAMPLE_TASKS = 8
NEIGHBOURS = 15
BLOCK = 256

#: Classes of bytes for word shapes: lower, upper, digit, beyond ASCII, sentence marks, other marks.
KIND = np.full(256, 5, np.uint8)
KIND[0x61:0x7B], KIND[0x41:0x5B], KIND[0x30:0x3A], KIND[0x80:] = 1, 2, 3, 1
KIND[[ord(c) for c in ".,;:"]] = 4


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed terms, one row per text."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    if not len(data):
        return out
    low = LOWER[data].astype(np.uint32)
    doc_of = np.repeat(np.arange(n), np.diff(offsets))
    if len(low) > 2:
        code = (low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA77)) ^ (low[2:] * np.uint32(0xC2B2AE3D))
        code ^= code >> np.uint32(15)
        whole = doc_of[:-2] == doc_of[2:]
        flat = doc_of[:-2][whole] * TRIGRAMS + (code[whole] * np.uint32(0x27D4EB2F) >> np.uint32(8)) % TRIGRAMS
        out[:, :TRIGRAMS] = np.bincount(flat, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    begin, end, first = words(data, offsets, SPACED)
    if len(begin):
        owner = np.repeat(np.arange(n), np.diff(first))
        # a shape keeps each byte's kind and, for rare marks, the byte; runs of one kind count once
        shape = KIND[data]
        shape = np.where(shape == 5, data, shape)
        change = np.ones(len(data), bool)
        change[1:] = shape[1:] != shape[:-1]
        change[begin] = True
        kept = np.flatnonzero(change)
        runs = np.searchsorted(kept, np.stack([begin, end]))
        kinds = shape[kept]
        hashed = word_hashes(kinds, runs[0], runs[1])
        flat = owner * SHAPES + (hashed % np.uint64(SHAPES)).astype(np.int64)
        out[:, TRIGRAMS:TRIGRAMS + SHAPES] = np.bincount(flat, minlength=n * SHAPES).reshape(n, SHAPES)
        same = word_hashes(LOWER[data], begin, end)
        again = np.flatnonzero((same[1:] == same[:-1]) & (owner[1:] == owner[:-1])) + 1
        # a word said again counts under its length, so long stretches of one word stand out
        flat = owner[again] * REPEATS + np.minimum(end[again] - begin[again], REPEATS - 1)
        out[:, TRIGRAMS + SHAPES:] = np.bincount(flat, minlength=n * REPEATS).reshape(n, REPEATS)
    return out


class Space:
    """Weights and axes of the latent space, and the labelled vectors in it."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, prior: float):
        self.idf, self.axes, self.prior = idf, axes, prior
        self.vectors, self.votes = np.zeros((0, axes.shape[1]), np.float32), np.zeros((2, 0), np.float32)

    def hold(self, vectors: np.ndarray, good: np.ndarray, priors: tuple[float, float]) -> None:
        """Take the sample's vectors; it may hold a class more often than all labels do, so votes are brought back."""
        share = max(1e-9, float(good.mean()))
        weight = np.where(good == 1, priors[1] / share, priors[0] / max(1e-9, 1 - share))
        self.vectors, self.votes = vectors, np.stack([weight * good, weight]).astype(np.float32)

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.log1p(counts.astype(np.float32)) * self.idf
        for part in (slice(0, TRIGRAMS), slice(TRIGRAMS, TERMS)):
            weighted[:, part] /= np.maximum(np.linalg.norm(weighted[:, part], axis=1, keepdims=True), 1e-9)
        return weighted

    def project(self, weighted: np.ndarray) -> np.ndarray:
        vectors = weighted @ self.axes
        return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity."""
        cosine = self.project(self.weigh(counts)) @ self.vectors.T
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(cosine, -k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** 8
        good = (weight * self.votes[0][near]).sum(axis=1) + 1e-6 * self.prior
        every = (weight * self.votes[1][near]).sum(axis=1) + 1e-6
        return np.clip(good / every, 0, 1).astype(np.float64)


def _summed(sample: DataFrame, part, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of ``part(counts)`` over the sample's blocks: tasks add up theirs, the driver gets one matrix a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                total = (0 if total is None else total) + part(np.frombuffer(b"".join(batch.column(0).slice(a, BLOCK).to_pylist()), "<u2").reshape(-1, TERMS))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()])], ["total"])

    parts = sample.select("counts").coalesce(SAMPLE_TASKS).mapInArrow(run, "total binary").toArrow()
    return sum((np.frombuffer(p.as_py(), np.float64).reshape(shape) for p in parts.column("total")), np.zeros(shape))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Space | None:
    """A space fitted on at most ``per_class`` documents of each label, picked by a hash of their id.

    The sample's term counts stay with the tasks: the axes come from power steps, of which the driver
    sees products of the size of the axes only.  Repeated labels of one document count once, as the
    lower one; missing ones not at all.  Without any labelled document there is no space.
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good"))
    sizes = {r[0]: r[1] for r in known.groupBy("good").count().collect()}
    if not sizes:
        return None
    picked = []
    for good in sorted(sizes):
        rows = known.where(F.col("good") == good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
        picked += [(r.doc_id, r.good) for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            for a in range(0, batch.num_rows, BLOCK):
                b = min(a + BLOCK, batch.num_rows)
                counts = term_counts(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in (0, 1)), pa.array([np.minimum(r, 65535).astype("<u2").tobytes() for r in counts])],
                    ["doc_id", "good", "counts"])

    ids = docs.sparkSession.createDataFrame(picked, "doc_id long, good int")  # at most 2 * per_class ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).join(F.broadcast(ids), "doc_id")
    sample = texts.select("doc_id", "good", "text").mapInArrow(run, "doc_id long, good int, counts binary")
    # of several texts with one id the one whose counts sort first
    sample = sample.groupBy("doc_id", "good").agg(F.min("counts").alias("counts"))
    sample = written(sample, "labelled-sample")
    size = sample.count()
    if not size:
        return None
    having = _summed(sample, lambda counts: (counts > 0).sum(axis=0), (TERMS,))
    total = sum(sizes.values())
    priors = sizes.get(0, 0) / total, sizes.get(1, 0) / total
    rank = min(RANK, size, TERMS)
    basis = np.random.default_rng(0).standard_normal((TERMS, rank + 8)).astype(np.float32)
    space = Space((np.log((1 + size) / (1 + having)) + 1).astype(np.float32), basis, priors[1])
    weigh = space.weigh  # bound to the weights, which stay as they are

    def product(counts: np.ndarray) -> np.ndarray:
        weighted = weigh(counts)
        return weighted.T @ (weighted @ basis)

    def gram(counts: np.ndarray) -> np.ndarray:
        along = weigh(counts) @ basis
        return along.T @ along

    for _ in range(4):
        basis, _ = np.linalg.qr(_summed(sample, product, basis.shape))
        basis = basis.astype(np.float32)
    _, turn = np.linalg.eigh(_summed(sample, gram, (basis.shape[1],) * 2))
    space = Space(space.idf, (basis @ turn[:, ::-1][:, :rank]).astype(np.float32), priors[1])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                counts = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u2").reshape(-1, TERMS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([v.tobytes() for v in space.project(space.weigh(counts))])], ["doc_id", "good", "vector"])

    held = sample.mapInArrow(project, "doc_id long, good int, vector binary").toArrow().sort_by("doc_id")
    vectors = np.frombuffer(b"".join(held.column("vector").to_pylist()), np.float32).reshape(size, -1)
    space.hold(vectors, held.column("good").to_numpy(), priors)
    return space


def score(docs: DataFrame, space: Space | None) -> DataFrame:
    """``row`` (all columns of a document) and ``score``; 0.5 where nothing was labelled.

    Null and empty texts are far from every labelled text and get the share of label 1.  Every row is
    scored by its own text alone, repeated ones alike; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    frame = docs.select(F.struct("*").alias("row"), text_column().alias("text"))
    if space is None:
        return frame.select("row", F.lit(0.5).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            parts = [np.zeros(0)]
            for a in range(0, batch.num_rows, BLOCK):
                b = min(a + BLOCK, batch.num_rows)
                counts = np.concatenate([
                    term_counts(raw[offsets[c]:offsets[d]], offsets[c:d + 1] - offsets[c])
                    for c, d in ((a + x, a + y) for x, y in steps(offsets[a:b + 1]))])
                parts.append(fitted.score(counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts))], ["row", "score"])

    schema = frame.select("row", F.lit(0.0).alias("score")).schema
    return frame.mapInArrow(run, schema)
