"""Ranked lexical search by MaxScore with bounds of term pairs.

Documents are indexed in shards (one row each, some megabytes of text): for every term that the queries
hold a posting list with impacts and its largest impact, and for chosen pairs of terms the list of
documents that hold both with the largest joint impact.  A query's terms are added to its
non-essential set from the smallest impact on, as long as a document with no other terms stays below
the k-th best score so far.  Bounds of the set come from a matching of its terms: a pair counts by the
larger of its joint and its single maxima, never by their sum; where a joint maximum is too large, the
pair's intersection list becomes a source of candidates and the pair counts by its single maxima.

Every task searches its shards for all queries and gives k documents a query, so no posting list is
shuffled and a frequent term is spread over all shards.  Queries go to the tasks in blocks of bounded size.
"""

from collections.abc import Iterator
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitaespark.llm.arrays import ALNUM, LOWER, small_batches, steps, text_column, utf8, word_hashes, words, written

SHARD_BYTES = 32_000_000
#: Documents of a shard: places in it are 16-bit numbers.
SHARD_DOCS = 1 << 16
#: Bytes of query text that one pass takes: what a broadcast may cost a task.
BLOCK_BYTES = 4_000_000

POSTED = "ids array<long>, lengths binary, n_docs long, n_terms long, terms binary, starts binary, places binary, counts binary"
INDEXED = ("ids array<long>, terms binary, starts binary, places binary, parts binary, tops binary, "
           "pairs binary, pair_starts binary, pair_places binary, joint binary, kth binary")


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a column of texts, and each text's first term."""
    raw, offsets = utf8(column)
    data = LOWER[raw]
    begin, end, first = words(data, offsets, ALNUM)
    return word_hashes(data, begin, end), first


def _posted(ids: list, lengths: list, docs: list, terms: list) -> pa.RecordBatch:
    """One shard's row: lists of the known terms in it."""
    n = np.concatenate(lengths)
    key, counts = np.unique(np.concatenate(terms).astype(np.int64) * SHARD_DOCS + np.concatenate(docs), return_counts=True)
    known, starts = np.unique(key // SHARD_DOCS, return_index=True)
    cells = [pa.concat_arrays(ids), n.astype("<i8").tobytes(), int((n > 0).sum()), int(n.sum()), known.astype("<i4").tobytes(),
             np.append(starts, len(key)).astype("<i8").tobytes(), (key % SHARD_DOCS).astype("<u2").tobytes(), counts.astype("<u4").tobytes()]
    return pa.RecordBatch.from_arrays(
        [pa.array([c.to_pylist()], pa.list_(pa.int64())) if k == 0 else pa.array([c]) for k, c in enumerate(cells)],
        ["ids", "lengths", "n_docs", "n_terms", "terms", "starts", "places", "counts"])


def posted(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Shards of posting lists for the terms of ``vocabulary`` (sorted hashes); lengths count all terms."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        ids, lengths, at, terms, size, n = [], [], [], [], 0, 0
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for low, high in steps(offsets):
                for a in range(low, high, SHARD_DOCS):
                    b = min(a + SHARD_DOCS, high)
                    if n and (n + b - a > SHARD_DOCS or size > SHARD_BYTES):
                        yield _posted(ids, lengths, at, terms)
                        ids, lengths, at, terms, size, n = [], [], [], [], 0, 0
                    hashes, first = terms_of(batch.column(1).slice(a, b - a))
                    where = np.minimum(np.searchsorted(asked, hashes), max(0, len(asked) - 1))
                    known = asked[where] == hashes if len(asked) else np.zeros(len(hashes), bool)
                    ids.append(batch.column(0).slice(a, b - a))
                    lengths.append(np.diff(first))
                    at.append(np.repeat(np.arange(n, n + b - a), np.diff(first))[known])
                    terms.append(where[known])
                    size, n = size + int(offsets[b] - offsets[a]), n + b - a
        if n:
            yield _posted(ids, lengths, at, terms)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).mapInArrow(run, POSTED)


def _impacts(counts: np.ndarray, lengths: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """The document's part of each impact: a term's count damped by the document's length."""
    if 90 * int(lengths.max(initial=0)) * total_docs < 1 << 63:
        m = 10 + 90 * lengths * total_docs // max(1, total_terms)
    else:
        m = np.array([10 + 90 * int(n) * total_docs // total_terms for n in lengths], np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def indexed(shards: DataFrame, weights: np.ndarray, pairs: np.ndarray, total_docs: int, total_terms: int, k: int) -> DataFrame:
    """Shards with impacts, each list's largest one, and intersection lists of ``pairs`` with their joint maxima."""
    sent = shards.sparkSession.sparkContext.broadcast((weights, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, pairs = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                terms, starts = np.frombuffer(row["terms"], "<i4"), np.frombuffer(row["starts"], "<i8")
                places = np.frombuffer(row["places"], "<u2")
                lengths = np.frombuffer(row["lengths"], "<i8")[places]
                parts = _impacts(np.frombuffer(row["counts"], "<u4").astype(np.int64), lengths, total_docs, total_terms)
                tops = np.maximum.reduceat(parts, starts[:-1]) if len(terms) else parts[:0]
                at = np.full(len(weights), -1)
                at[terms] = np.arange(len(terms))
                there = pairs[(at[pairs] >= 0).all(axis=1)] if len(pairs) else pairs
                found, joint, kth = [np.zeros(0, "<u2")], [], []
                for a, b in there.tolist():
                    (s, e), (t, f) = starts[at[a]:at[a] + 2], starts[at[b]:at[b] + 2]
                    if e - s > f - t:
                        a, b, s, e, t, f = b, a, t, f, s, e
                    where = np.minimum(np.searchsorted(places[t:f], places[s:e]), f - t - 1)
                    both = np.flatnonzero(places[t:f][where] == places[s:e])
                    sums = weights[a] * parts[s:e][both] + weights[b] * parts[t:f][where[both]]
                    found.append(places[s:e][both])
                    joint.append(int(sums.max(initial=0)))
                    kth.append(int(np.partition(sums, -k)[-k]) if len(sums) >= k else 0)
                sizes = np.cumsum([len(x) for x in found])
                cells = [row["terms"], row["starts"], row["places"], parts.astype("<u4").tobytes(), tops.astype("<u4").tobytes(),
                         there.astype("<i4").tobytes(), sizes.astype("<i8").tobytes(), np.concatenate(found).tobytes(),
                         np.array(joint, "<i8").tobytes(), np.array(kth, "<i8").tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["ids"]], pa.list_(pa.int64())), *[pa.array([c], pa.binary()) for c in cells]],
                    [c.split(" ")[0] for c in INDEXED.split(", ")])

    return shards.mapInArrow(run, INDEXED)


class Shard:
    """Lists of one shard, ready to be searched."""

    def __init__(self, row: dict, weights: np.ndarray):
        self.n = len(row["ids"])
        self.missing = np.array([i is None for i in row["ids"]], bool)
        self.ids = np.array([i or 0 for i in row["ids"]], np.int64)
        terms, self.starts = np.frombuffer(row["terms"], "<i4"), np.frombuffer(row["starts"], "<i8")
        self.at = dict(zip(terms.tolist(), range(len(terms))))
        self.places, self.parts = np.frombuffer(row["places"], "<u2"), np.frombuffer(row["parts"], "<u4").astype(np.int64)
        self.weights = weights
        self.tops = (weights[terms] * np.frombuffer(row["tops"], "<u4")).tolist()
        pairs = np.frombuffer(row["pairs"], "<i4").reshape(-1, 2).tolist()
        self.pair_starts, self.pair_places = np.frombuffer(row["pair_starts"], "<i8"), np.frombuffer(row["pair_places"], "<u2")
        self.pair_at = {(a, b): p for p, (a, b) in enumerate(pairs)}
        self.joint, self.kth = np.frombuffer(row["joint"], "<i8").tolist(), np.frombuffer(row["kth"], "<i8").tolist()

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        s, e = self.starts[self.at[term]:self.at[term] + 2]
        return self.places[s:e], self.weights[term] * self.parts[s:e]

    def both(self, pair: int) -> np.ndarray:
        return self.pair_places[self.pair_starts[pair]:self.pair_starts[pair + 1]]


def split(shard: Shard, terms: list[int], least: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Essential terms, the others from the smallest largest impact on, the bound of each prefix of these,
    and pairs whose intersection lists give candidates beside the essential lists.

    Pairs are looked for among terms that stand next to each other.  A document in none of these lists
    scores below ``least``.
    """
    order = sorted(terms, key=lambda t: shard.tops[shard.at[t]])
    beside = {t: terms[max(0, i - 1):i] + terms[i + 1:i + 2] for i, t in enumerate(terms)}
    bounds, opened, free, bound, strict = [], [], {}, 0, 0
    excess: list[tuple[int, int]] = []
    for n, t in enumerate(order):
        top, best, mate = shard.tops[shard.at[t]], 0, None
        for other in beside[t]:
            pair = shard.pair_at.get((min(t, other), max(t, other)))
            if other in free and pair is not None:
                saved = top + free[other] - max(shard.joint[pair], top, free[other])
                if mate is None or saved > best:
                    best, mate, of = saved, other, pair
        full, tight, more = bound + top - best, strict + top - best, excess
        if mate is not None:
            over = shard.joint[of] - max(top, free[mate])
            more = [*excess, (over, of)] if over > 0 else excess
        # a document with both terms of a pair is looked up in the pair's list, all others lack one of them
        opening = list(opened)
        if tight >= least:
            for over, pair in sorted(more, reverse=True):
                if tight < least:
                    break
                opening.append(pair)
                tight -= over
                more = [x for x in more if x[1] != pair]
        if tight >= least:
            return order[n:], order[:n], bounds, opened
        bounds.append(full)
        bound, strict, opened, excess = full, tight, opening, more
        if mate is None:
            free[t] = top
        else:
            del free[mate]
    return [], order, bounds, opened


def best_of(scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id, null ids last."""
    return np.lexsort((ids, missing, -scores))[:k]


def search(shard: Shard, terms: list[int], least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of all documents that may be among the k best with at least ``least``."""
    terms = [t for t in terms if t in shard.at]
    for pair in zip(terms, terms[1:]):
        pair = shard.pair_at.get((min(pair), max(pair)))
        if pair is not None:  # k documents have the pair's k-th joint impact or more
            least = max(least, shard.kth[pair])
    essential, rest, bounds, opened = split(shard, terms, least)
    total, seen = np.zeros(shard.n, np.int64), np.zeros(shard.n, bool)
    for t in essential:
        places, impacts = shard.list_of(t)
        total[places] += impacts
        seen[places] = True
    for pair in opened:
        seen[shard.both(pair)] = True
    found = np.flatnonzero(seen)
    for t, bound in zip(reversed(rest), reversed(bounds)):
        found = found[total[found] + bound >= least]
        if not len(found):
            break
        if len(found) > k:  # what k candidates have already, the k best have, too
            least = max(least, int(np.partition(total[found], -k)[-k]))
        places, impacts = shard.list_of(t)
        where = np.minimum(np.searchsorted(places, found), len(places) - 1)
        there = places[where] == found
        total[found[there]] += impacts[where[there]]
    found = found[total[found] >= least]
    return found, total[found]


def _searched(index: DataFrame, items: list, queries: list[list[int]], weights: np.ndarray, k: int, base: int) -> DataFrame:
    """The k best documents of each task for each query."""
    sent = index.sparkSession.sparkContext.broadcast((items, queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, queries, weights = sent.value
        none = np.zeros(0, np.int64)
        best = [(none, none, none.astype(bool))] * len(queries)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, weights)
                for q, terms in enumerate(queries):
                    scores, ids, missing = best[q]
                    places, more = search(shard, terms, int(scores[-1]) if len(scores) == k else 1, k)
                    if len(places):
                        scores, ids = np.concatenate([scores, more]), np.concatenate([ids, shard.ids[places]])
                        missing = np.concatenate([missing, shard.missing[places]])
                        top = best_of(scores, ids, missing, k)
                        best[q] = scores[top], ids[top], missing[top]
        for q, (scores, ids, missing) in enumerate(best):
            if len(scores):
                n = len(scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([base + q] * n, pa.int64()), pa.array([items[q]] * n, pa.int64()),
                     pa.array(ids, mask=missing), pa.array(scores)], ["query", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "query long, item_id long, doc_id long, score long")


def chosen_pairs(queries: list[list[int]]) -> np.ndarray:
    """Pairs to store: terms that stand next to each other in a query."""
    pairs = {(min(p), max(p)) for terms in queries for p in zip(terms, terms[1:])}
    return np.array(sorted(pairs), np.int64).reshape(-1, 2)


def rank(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of every query (item_id, text).

    Null and empty texts have no terms: such documents are in no result and not counted, such queries
    have no rows.  Equal scores come in order of doc_id, a null one last; repeated rows count each, on
    both sides; an empty table on either side gives no rows; further columns play no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    queries = queries.select(F.col("item_id").cast("long").alias("item_id"), text_column().alias("text"))
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, found = max(1, ceil(size / BLOCK_BYTES)), None
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        hashes, first = terms_of(pa.array([r.text for r in rows], pa.string()))
        vocabulary, number = np.unique(hashes, return_inverse=True)
        asked = [np.unique(number[a:b]) for a, b in zip(first, first[1:])]
        shards = written(posted(docs, vocabulary), "postings")
        total = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()

        def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for terms, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.frombuffer(terms, "<i4")), pa.array(np.diff(np.frombuffer(starts, "<i8")))], ["term", "df"])

        counted = shards.select("terms", "starts").mapInArrow(lists, "term int, df long").groupBy("term").agg(F.sum("df"))
        df = np.zeros(len(vocabulary), np.int64)
        for term, n in counted.collect():  # at most the terms of one block of queries
            df[term] = n
        n_docs, n_terms = total[0] or 0, total[1] or 0
        weights = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
        # terms of like frequency stand next to each other: they are what a non-essential set consists of
        asked = [a[np.lexsort((a, -df[a]))].tolist() for a in asked]
        index = written(indexed(shards, weights, chosen_pairs(asked), n_docs, n_terms, k), "ranked-index")
        part = _searched(index, [r.item_id for r in rows], asked, weights, k, block << 32)
        found = part if found is None else found.unionByName(part)
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
