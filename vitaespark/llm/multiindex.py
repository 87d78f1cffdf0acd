"""Nearest neighbours by multi-index hashing of learned binary codes.

A rotation learned on a bounded sample (principal axes, then alternating between signs and the rotation
that fits them) turns every vector into a code of up to 64 bits.  The code is split into substrings of
eight bits, each with a table of its own in every shard of vectors.  Two codes within Hamming radius r
have a substring within r / m (pigeonhole), so probing each table at the values near the query's
substring gives every code within r; these are checked and ranked by their inner products in doubles.

The radius is a query's own: how far codes of vectors with a given inner product lie apart is learned
from the sample, and the k-th best product found so far bounds what is still to be found.  It starts
from the sample's vectors and shrinks from shard to shard, so a larger table means a smaller radius.

For inner products of vectors of any length, vectors get one more component that brings all to the
largest length; for queries it is zero.
"""

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitaespark.llm.arrays import small_batches, written

#: The sample that the rotation and the radii are learned from: rows at most, and bytes of doubles at most.
SAMPLE_ROWS = 8192
SAMPLE_BYTES = 16 << 20
#: Bytes of vectors in a shard, and of queries that one pass takes.
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20
#: Share of neighbours that a radius has to hold on the sample.
HELD = 0.98
BITS = 64
ROUNDS = 30

#: The 256 byte values, those with few bits first, and how many have at most 0, 1, ... 8 bits.
BYTES = np.array(sorted(range(256), key=lambda v: (v.bit_count(), v)), np.uint8)
UP_TO = np.cumsum(np.bincount([v.bit_count() for v in range(256)]))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty or all zero, every component finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles from a list column; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Space:
    """The learned rotation, and the radius that holds what has a given inner product."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, longest: float):
        self.ids, self.sample, self.longest = ids, sample, longest
        rng = np.random.default_rng(0)
        lifted = self.lift(sample)
        self.mean = lifted.mean(axis=0)
        _, _, axes = np.linalg.svd(lifted - self.mean, full_matrices=False)
        self.bits = min(BITS, len(axes))
        flat = (lifted - self.mean) @ axes[:self.bits].T
        turn, _ = np.linalg.qr(rng.standard_normal((self.bits, self.bits)))
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        self.axes = axes[:self.bits].T @ turn
        self.learn_radii()

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors of one length: divided by the largest, with what is missing as a last component."""
        unit = vectors / self.longest
        return np.column_stack([unit, np.sqrt(np.maximum(0, 1 - (unit ** 2).sum(axis=1)))])

    def codes(self, lifted: np.ndarray) -> np.ndarray:
        """Eight bits to a byte, a byte to a substring."""
        return np.packbits((lifted - self.mean) @ self.axes > 0, axis=1)

    def query_codes(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        return self.codes(np.column_stack([unit, np.zeros(len(unit))]))

    def cosines(self, queries: np.ndarray, products: np.ndarray) -> np.ndarray:
        """Inner products as cosines of the lifted vectors, which is what codes tell of."""
        return products / np.maximum(np.linalg.norm(queries, axis=1), 1e-300) / self.longest

    def learn_radii(self) -> None:
        """For each cosine of a grid the Hamming radius that holds ``HELD`` of the sample's pairs from there on."""
        rows = np.arange(0, len(self.sample), max(1, len(self.sample) // 1024))
        inner = self.sample[rows] @ self.sample.T
        inner[np.arange(len(rows)), rows] = -np.inf
        cosine = self.cosines(self.sample[rows], inner.T).T.ravel()
        apart = np.bitwise_count(self.query_codes(self.sample[rows])[:, None] ^ self.codes(self.lift(self.sample))[None]).sum(axis=2).ravel()
        self.grid = np.linspace(-1, 1, 201)
        cell = np.clip(np.searchsorted(self.grid, cosine, "right") - 1, 0, 200)
        table = np.zeros((201, self.bits + 1), np.int64)
        np.add.at(table, (cell, apart), np.isfinite(cosine))
        table = table[::-1].cumsum(axis=0)[::-1]
        held = np.argmax(table.cumsum(axis=1) >= HELD * table.sum(axis=1, keepdims=True), axis=1)
        # too few pairs say nothing: there the radius of the last cosine with enough of them stays
        enough = np.flatnonzero(table.sum(axis=1) >= 200)
        last = enough[-1] if len(enough) else -1
        self.radii = np.where(np.arange(201) <= last, held, held[last] if last >= 0 else self.bits)

    def radius(self, cosine: np.ndarray) -> np.ndarray:
        known = self.radii[np.clip(np.searchsorted(self.grid, cosine, "right") - 1, 0, 200)]
        return np.where(np.isfinite(cosine), known, self.bits)


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order wherever its row stands."""
    return np.einsum("ij,j->i", vectors, query)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids; an id with one score counts once."""
    order = np.lexsort((ids, -scores))
    again = (ids[order][1:] == ids[order][:-1]) & (scores[order][1:] == scores[order][:-1])
    return order[np.append(True, ~again)[:len(order)]][:k]


class Shard:
    """Vectors of one shard with a table per substring of their codes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        self.ids, self.vectors, self.codes = ids, vectors, codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of every code within the radius."""
        m = len(code)
        each, over = divmod(radius, m)
        seen = np.zeros(len(self.ids), bool)
        for j in range(m):
            # if the first over + 1 substrings are all further than ``each`` and the rest not nearer, the sum exceeds the radius
            near = min(8, each if j <= over else each - 1)
            if near < 0:
                continue
            values = code[j] ^ BYTES[:UP_TO[near]]
            low = self.starts[j][values]
            times = self.starts[j][values.astype(np.int64) + 1] - low
            at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
            seen[self.order[j][at]] = True
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(axis=1) <= radius]


def learn(rows: DataFrame) -> Space | None:
    """A space from at most ``SAMPLE_ROWS`` vectors, picked by a hash of their ids; none without vectors."""
    facts = rows.agg(F.max(F.size("vector")), F.max(F.expr("aggregate(vector, 0d, (s, x) -> s + x * x)"))).first()
    if facts[0] is None:
        return None
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * facts[0])))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow()
    ids = picked.column("vec_id").to_numpy()
    return Space(ids, matrix(picked.column("vector"), facts[0]), float(np.sqrt(facts[1])))


def indexed(rows: DataFrame, space: Space) -> DataFrame:
    """One row per shard: ids, vectors and codes."""
    sent = rows.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = sent.value
        width = space.sample.shape[1]
        most = max(1, SHARD_BYTES // (8 * width))
        ids, parts, n = [], [], 0

        def shard():
            vectors = np.concatenate(parts)
            cells = [np.concatenate(ids).astype("<i8"), vectors.astype("<f8"), space.codes(space.lift(vectors))]
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()]) for c in cells], ["ids", "vectors", "codes"])

        for batch in batches:
            for a in range(0, batch.num_rows, most):
                if n and n + min(most, batch.num_rows - a) > most:
                    yield shard()
                    ids, parts, n = [], [], 0
                ids.append(batch.column(0).slice(a, most).to_numpy())
                parts.append(matrix(batch.column(1).slice(a, most), width))
                n += len(ids[-1])
        if n:
            yield shard()

    return rows.select("vec_id", "vector").mapInArrow(run, "ids binary, vectors binary, codes binary")


def _result(query: int, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), query)), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


def started(queries: DataFrame, space: Space, k: int) -> DataFrame:
    """Each query's k best vectors of the sample: a first bound for its search, and results should no more be found."""
    sent = queries.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = sent.value
        for batch in batches:
            vectors = matrix(batch.column(1), space.sample.shape[1])
            for query, vector in zip(batch.column(0).to_pylist(), vectors):
                scores = products(space.sample, vector)
                other = np.flatnonzero(space.ids != query)
                top = other[best_of(scores[other], space.ids[other], k)]
                yield _result(query, space.ids[top], scores[top])

    return queries.select("vec_id", "vector").mapInArrow(run, FOUND)


def searched(index: DataFrame, queries: pa.Table, space: Space, k: int) -> DataFrame:
    """The k best of each task for a block of queries (vec_id, vector, least: k-th best score so far)."""
    ids = queries.column("vec_id").to_numpy()
    vectors = matrix(queries.column("vector"), space.sample.shape[1])
    least = queries.column("least").fill_null(-np.inf).to_numpy()
    sent = index.sparkSession.sparkContext.broadcast((ids, vectors, least, space))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors, least, space = sent.value
        codes, least = space.query_codes(vectors), least.copy()
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(query_ids)
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["ids"], "<i8")
                shard = Shard(own, np.frombuffer(row["vectors"], "<f8").reshape(len(own), -1), np.frombuffer(row["codes"], np.uint8).reshape(len(own), -1))
                radii = space.radius(space.cosines(vectors, least))
                for q, query in enumerate(query_ids):
                    near = shard.within(codes[q], int(radii[q]))
                    near = near[own[near] != query]
                    scores = products(shard.vectors[near], vectors[q])
                    good = scores >= least[q]
                    found = np.concatenate([best[q][0], own[near[good]]]), np.concatenate([best[q][1], scores[good]])
                    top = best_of(found[1], found[0], k)
                    best[q] = found[0][top], found[1][top]
                    if len(top) == k:
                        least[q] = max(least[q], best[q][1][-1])
        for query, (ids, scores) in zip(query_ids, best):
            if len(ids):
                yield _result(int(query), ids, scores)

    return index.mapInArrow(run, FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: the k largest inner products found for every query.

    Both frames have ``vec_id`` and ``embedding``.  Candidates are all rows with another id than the
    query's.  Rows without an id, and vectors that are null, empty, zero or not finite take no part; a
    shorter vector counts as if it ended in zeros.  Repeated rows of one id and vector count once; of
    several query rows of one id the vector that sorts first is taken.  Equal products come in order of
    vec_id.  Without vectors or queries there are no rows; further columns play no part.
    """
    spark = vectors.sparkSession
    small_batches(spark)

    def plain(df):
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(
            F.col("vec_id").isNotNull() & usable(F.col("vector")))

    asked = plain(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    space = learn(plain(vectors))
    if space is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = written(indexed(plain(vectors), space), "vector-index")
    width = space.sample.shape[1]
    asked = written(asked.withColumn("vector", F.slice("vector", 1, width)), "vector-queries")
    first = written(started(asked, space, k), "vector-starts")
    bounds = first.groupBy("query_id").agg(F.when(F.count("score") >= k, F.min("score")).alias("least"))
    blocks = max(1, ceil(asked.count() * 8 * width / BLOCK_BYTES))
    found = first
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).join(bounds, F.col("vec_id") == F.col("query_id"), "left")
        part = searched(index, rows.select("vec_id", "vector", "least").toArrow(), space, k)
        found = found.unionByName(part)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
