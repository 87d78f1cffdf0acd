"""Whole texts as byte arrays: words, their hashes and shingles for a batch of documents at once."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaespark.session import shared_folder

#: Bytes of text that one step of vectorised work takes at once; a longer text is a step of its own.
STEP_BYTES = 2_000_000


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python task holds: few rows, and few bytes where the setting exists."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_column(name: str = "text"):
    """A text without null, so that null and empty texts are the same from here on."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each value begins (one more entry than values)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if not len(ends):
        ends = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of documents of about ``most`` bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that end at white space: anything but 0x20 and 0x09-0x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words of letters and digits: ASCII ones (lower case) and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

BYTE_VALUES = _splitmix(256, 11)
BASE = np.uint64(0xD6E8FEB86659FD93)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word (maximal run of ``member`` bytes), and each document's first word."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = member[data]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    touching = cuts[inside[cuts] & inside[cuts + 1]]
    opens[touching] = True
    closes[touching - 1] = True
    begin = np.flatnonzero(opens)
    return begin, np.flatnonzero(closes) + 1, np.searchsorted(begin, offsets)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by differences of one running polynomial sum."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.full(len(data), BASE)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.take(BYTE_VALUES, data, out=sums[1:], mode="clip")  # a mode that needs no buffer
        sums[1:] *= powers
        np.cumsum(sums[1:], out=sums[1:])
        powers[1:] = BASE_INVERSE
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        return mix((sums[end] - sums[begin]) * powers[begin] + (end - begin).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words of one document; of all words if there are fewer."""
    n = len(hashes)
    if not n:
        return hashes
    with np.errstate(over="ignore"):
        width = min(size, n)
        out = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            out = out * np.uint64(0x9DDFEA08EB382D69) + hashes[k:n - width + 1 + k]
            out ^= out >> np.uint64(29)
        return mix(out + np.uint64(width))
