"""Packing of token sequences by a configuration linear program.

Documents become tokens, long ones are cut, and the pieces' length histogram (never more entries than
the capacity) goes to the driver.  There the configuration LP (which combinations of lengths fill a
sequence, and how often each is used) is solved by multiplicative weights: lengths that are still
badly covered get heavier, and a knapsack dynamic program prices the most valuable combination.
The fractional solution is rounded down, the rest is solved again, and what remains is placed best-fit
by counts.  Pieces then find their place by their rank among pieces of their length, on the executors.
"""

import os
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitaespark.llm.arrays import small_batches, text_column, written
from vitaespark.llm.secrets import vocabulary

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit values.

    ``ranks`` is the same vocabulary in tiktoken's form, whose library is several times faster.  Texts
    that hold an added token's string are left to the tokenizer itself, and so is everything if there
    are no ranks; the first texts of each worker are encoded both ways and must agree.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = vocabulary(ranks, pattern).encode_ordinary if ranks else None
        self.unchecked = 20

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(t in text for t in self.added):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        found = self.fast(text)
        if self.unchecked:
            self.unchecked -= 1
            if found != self.tokenizer.encode(text, add_special_tokens=False).ids:
                raise ValueError("the ranks are not the tokenizer's vocabulary")
        return found

    def encode(self, text: str) -> bytes:
        return np.array(self.ids(text), "<u4").tobytes() if sys.byteorder == "big" else array("I", self.ids(text)).tobytes()


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    key = (path, ranks, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY,
           ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: of a longer document all but the first are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, seen = encoder(tokenizer, ranks, pattern), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = coder.encode(text.as_py()) + end
                n = len(own) // 4
                first = n - (n - 1) // capacity * capacity
                begin, k = 0, 0
                while begin < n:
                    to = first if k == 0 else begin + capacity
                    out.append((doc_id, k, begin, to - begin, zlib.crc32(own[4 * begin:4 * to]), task, seen[to - begin]))
                    seen[to - begin] += 1
                    begin, k = to, k + 1
            columns = list(zip(*out)) if out else [()] * 7
            types = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_column().alias("text")).mapInArrow(run, PIECES)


def best_filling(value: np.ndarray, lengths: np.ndarray, capacity: int) -> Counter:
    """Knapsack: the multiset of lengths of the largest value that fits."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        n = np.searchsorted(lengths, room, "right")
        best[room] = best[room - 1]
        if n:
            sums = best[room - lengths[:n]] + value[:n]
            k = int(sums.argmax())
            if sums[k] > best[room]:
                best[room], chosen[room] = sums[k], k
    picked, room = Counter(), capacity
    while room > 0:
        k = int(chosen[room])
        if k < 0:
            room -= 1
            continue
        picked[int(lengths[k])] += 1
        room -= int(lengths[k])
    return picked


def fractional(demand: dict[int, int], capacity: int, rounds: int) -> dict[tuple, float]:
    """Multiplicative weights on the covering LP: how often each configuration is used.

    A length's price starts a little above its share of the capacity (so long pieces are combined
    first) and falls by a factor with every part of its demand that a chosen configuration covers.
    A configuration is used for a share ``step`` of what its scarcest length still lacks; with few
    lengths there is time for smaller steps and larger price changes.
    """
    step, rate = (0.1, 2.0) if len(demand) <= 100 else (0.5, 0.15)
    lengths = np.array(sorted(demand))
    need = np.array([demand[x] for x in lengths], float)
    at = {int(x): i for i, x in enumerate(lengths)}
    covered, used = np.zeros(len(lengths)), Counter()
    start = (lengths / capacity) ** 1.03
    for _ in range(rounds):
        open_ = covered < 0.999
        if not open_.any():
            break
        price = start * np.exp(-rate * (covered - covered.min()))
        filling = best_filling(price[open_], lengths[open_], capacity)
        key = tuple(sorted(filling.items(), reverse=True))
        x = min((1 - covered[at[v]]) * need[at[v]] / k for v, k in key)
        x = x if x < 1.5 else max(1.0, x * step)
        used[key] += x
        for v, k in key:
            covered[at[v]] += x * k / need[at[v]]
    return used


def best_fit(demand: Counter, bins: Counter, capacity: int) -> Counter:
    """Place what is left, longest first, into the fullest sequences that take it; by counts only."""
    free = {}
    for filling, n in bins.items():
        free.setdefault(capacity - sum(filling), Counter())[filling] += n
    for length in sorted(demand, reverse=True):
        left = demand[length]
        while left:
            room = min((r for r, own in free.items() if r >= length and own), default=None)
            if room is None:
                filling, n, room = (), left, capacity
            else:
                filling, n = next(iter(free[room].items()))
            each = min(room // length, left)
            take = min(n, left // each)
            if room in free and filling in free[room]:
                free[room][filling] -= take
                if not free[room][filling]:
                    del free[room][filling]
            free.setdefault(room - each * length, Counter())[filling + (length,) * each] += take
            left -= take * each
    out = Counter()
    for own in free.values():
        out.update(own)
    return out


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 600, phases: int = 2) -> Counter:
    """How many sequences are filled with which lengths; covers the histogram exactly."""
    rest = Counter({int(k): int(n) for k, n in histogram.items() if n})
    bins = Counter()
    if rest.get(capacity):
        bins[(capacity,)] = rest.pop(capacity)
    for _ in range(phases):
        if sum(rest.values()) < 200:
            break
        solved = fractional(dict(rest), capacity, rounds)
        for key, x in sorted(solved.items(), key=lambda kv: (-kv[1], kv[0])):
            n = min(int(x), *(rest[length] // k for length, k in key))
            if n > 0:
                bins[tuple(length for length, k in key for _ in range(k))] += n
                for length, k in key:
                    rest[length] -= n * k
        rest = +rest
    return best_fit(rest, bins, capacity)


def slots(bins: Counter) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, rows (first rank, first sequence, pieces per sequence, offset in a sequence)."""
    out, taken, sequence = {}, Counter(), 0
    for filling, n in sorted(bins.items(), key=lambda kv: (-kv[1], kv[0])):
        offset = 0
        for length, k in sorted(Counter(filling).items(), reverse=True):
            out.setdefault(length, []).append((taken[length], sequence, k, offset))
            taken[length] += n * k
            offset += k * length
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY,
         ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Null and empty texts are the end token alone.  Repeated rows are packed once each.  An empty table
    gives no rows; extra columns are ignored.  The tokens of one text may be as many as memory holds.
    """
    cut = written(pieces(docs, tokenizer, end_id, capacity, ranks, pattern), "pieces")
    per_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    per_task = per_task.withColumn("before", F.coalesce(before, F.lit(0)))
    # one row per length, so at most as many as the capacity
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    layout = {k: tuple(np.array(c) for c in zip(*rows)) for k, rows in slots(plan_sequences(histogram, capacity)).items()}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for value in np.unique(lengths):
            own = np.flatnonzero(lengths == value)
            first, base, each, shift = layout[int(value)]
            row = np.searchsorted(first, ranks[own], "right") - 1
            k = ranks[own] - first[row]
            sequence[own] = base[row] + k // each[row]
            offset[own] = shift[row] + k % each[row] * value
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = cut.join(per_task.select("length", "task", "before"), ["length", "task"])
    return ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        place("length", F.col("before") + F.col("nth")).alias("at")
    ).select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
