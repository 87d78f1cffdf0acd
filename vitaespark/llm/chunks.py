"""Passages that several documents share, by content-defined chunks.

A passage is a run of at least ``LEAST_WORDS`` words; white space between words does not count.  A gear
hash rolls over the bytes of a text's words with one space between them; its value at the end of a word
depends on the last 16 bytes alone.  A cut follows each word whose value is the least of some stretch of
``SPAN`` words (of equal ones the first), so cuts follow from the text around them: an insertion moves
the neighbouring ones only, and no chunk is longer than ``SPAN`` words.

Chunks are deduplicated by digest; those of two documents or more are seeds.  Two documents with the same
50 words cut them alike between the least value of their first and of their last ``SPAN`` words, so such a
run is made of seeds there.  Runs of which this holds are looked up as a whole, word by word: first all with
the same first cut together, as one stretch; then one by one, where a stretch was not found twice, along
with one copy of each other stretch that has the chunk after this cut.  Runs found in two documents or more
are joined to passages.  So the result depends neither on where chunks begin nor on which copy a text is
compared with.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitaespark.llm.arrays import SPACED, mix, small_batches, steps, text_column, utf8, word_hashes, words, written
from vitaespark.llm.nearjoin import FILTER_WORDS, filter_bits

#: A repeated passage: so many words in a row.
LEAST_WORDS = 50

#: Bytes that the gear hash remembers: each step shifts its 16 bits by one.
REACH = 16
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)
STEP = np.uint64(0x9DDFEA08EB382D69)
STEP_BACK = np.uint64(pow(int(STEP), -1, 1 << 64))

CHUNKS = "doc_id long, row long, start int, end int, words int, at int, number int, need int, digest long"
STRETCHES = "doc_id long, tag long, row long, start int, end int, at int, runs int, chunk long, digest long"
RUNS = "doc_id long, tag long, start int, end int, at int, own boolean, first long, last long, digest long"
#: Seeds up to which a document is asked whether it can have a candidate run before its text is read again.
FEW_SEEDS = 500
#: Stands for a missing id while ids are compared.
NO_ID = -(1 << 62)


def span_of(least: int) -> int:
    """Words of the stretch that has a cut: two of them fit into the words whose gear values a run of ``least`` words fixes."""
    fixed = least - REACH // 2  # words of one letter and a space each take longest to fill the hash
    return max(1, fixed // 2)


def gear(norm: np.ndarray) -> np.ndarray:
    """The rolling hash ``h = 2 h + GEAR[byte]`` of 16 bits at every byte, by doubling the bytes it has seen."""
    value = GEAR[norm]
    seen = 1
    while seen < REACH:
        more = value.copy()
        more[seen:] += value[:-seen] << np.uint16(seen)
        value, seen = more, 2 * seen
    return value


class Words:
    """Words of some texts end to end, with the cuts after some of them."""

    def __init__(self, data: np.ndarray, own: np.ndarray, least: int):
        self.least, self.span = least, span_of(least)
        self.begin, self.end, self.first = words(data, own, SPACED)
        n = len(self.begin)
        self.doc = np.repeat(np.arange(len(own) - 1), np.diff(self.first))
        self.cuts = self.picked = np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            powers = np.full(n + 1, STEP)
            powers[0] = 1
            self.powers = np.multiply.accumulate(powers)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word_hashes(data, self.begin, self.end) * self.powers[:n])])
            powers[1:] = STEP_BACK
            self.back = np.multiply.accumulate(powers)
        # each word's last byte where words stand one space apart
        self.stop = np.cumsum(self.end - self.begin + 1)
        if n < self.span:
            return
        inside = np.ones(self.stop[-1], bool)
        inside[self.stop - 1] = False
        norm = np.full(self.stop[-1], 0x20, np.uint8)
        norm[inside] = data[SPACED[data]]
        value = gear(norm)[self.stop - 2]
        opens = np.concatenate([[0], self.stop])[self.first[self.doc]]
        value[self.stop - 1 - opens < REACH] = np.iinfo(np.uint16).max
        self.picked = np.arange(n - self.span + 1) + np.lib.stride_tricks.sliding_window_view(value, self.span).argmin(1)
        self.cuts = np.unique(self.picked[self.doc[:n - self.span + 1] == self.doc[self.span - 1:]])

    def digest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of the words from a to before b, and of how many they are."""
        with np.errstate(over="ignore"):
            return mix((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64))

    def chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """First word of each chunk, and the word after its last; cuts and ends of documents end one."""
        ends = np.union1d(self.cuts + 1, self.first[1:][np.diff(self.first) > 0])
        return np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends, ends

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All runs of ``least`` words: first word, and the chunks between the cuts that the run fixes, from and to before."""
        n, least = len(self.begin), self.least
        runs = np.flatnonzero(self.doc[:max(0, n - least + 1)] == self.doc[least - 1:])
        begin = np.concatenate([[0], self.stop])[runs]
        fixed = np.searchsorted(self.stop - 1, begin + REACH)  # the first word at whose end the hash holds nothing older
        low, high = self.picked[fixed] if len(runs) else runs, self.picked[runs + least - self.span] if len(runs) else runs
        _, ends = self.chunks()
        return runs, np.searchsorted(ends, low + 1) + 1, np.searchsorted(ends, high + 1) + 1


def code_points(data: np.ndarray) -> np.ndarray:
    """How many characters begin before each byte."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def keyed(docs: DataFrame) -> DataFrame:
    """Id, a hash that stands for the row, text."""
    id_, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), text_column()
    return docs.select(id_.alias("doc_id"), F.xxhash64(id_, text).alias("row"), text.alias("text"))


def chunk(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """All chunks of all documents: place in code points, number of words, first word, number, digest.

    ``need`` tells how many chunks from this one on have to be seeds for a run of which this is the first
    fixed one; none begins so where it is 0.

    White space after a chunk's last word belongs to it, and that before the first word to the first chunk.
    A text of white space alone is one chunk without a digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            for a, b in steps(offsets):
                data, own = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                found = Words(data, own, least_words)
                (low, high), chars = found.chunks(), code_points(data)
                bare = np.flatnonzero((np.diff(own) > 0) & (np.diff(found.first) == 0))
                if len(bare):
                    whole, no = pa.array((chars[own[bare + 1]] - chars[own[bare]]).astype(np.int32)), pa.nulls(len(bare), pa.int32())
                    yield pa.RecordBatch.from_arrays([
                        *(batch.column(k).slice(a, b - a).take(pa.array(bare)) for k in (0, 1)),
                        pa.array(np.zeros(len(bare), np.int32)), whole, pa.array(np.zeros(len(bare), np.int32)), no, no, no, no.cast(pa.int64())],
                        ["doc_id", "row", "start", "end", "words", "at", "number", "need", "digest"])
                if not len(low):
                    continue
                owner = found.doc[low]
                begin = np.where(low == found.first[owner], own[owner], found.begin[low])
                end = np.where(high == found.first[owner + 1], own[owner + 1], found.begin[np.minimum(high, len(found.begin) - 1)])
                _, first, last = found.runs()
                need = np.full(len(low), np.iinfo(np.int32).max)
                np.minimum.at(need, first, last - first)
                need[need == np.iinfo(np.int32).max] = 0
                number = np.arange(len(low)) - np.searchsorted(owner, owner)
                numbers = [chars[begin] - chars[own[owner]], chars[end] - chars[own[owner]], high - low, low - found.first[owner], number, need]
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k).slice(a, b - a).take(at) for k in (0, 1)), *(pa.array(x.astype(np.int32)) for x in numbers),
                    pa.array(found.digest(low, high).view(np.int64))],
                    ["doc_id", "row", "start", "end", "words", "at", "number", "need", "digest"])

    small_batches(docs.sparkSession)
    return keyed(docs).mapInArrow(run, CHUNKS)


def with_lists(docs: DataFrame, lists: DataFrame, *columns: str) -> DataFrame:
    """doc_id, row, text and the columns of ``lists`` for the rows that these name.

    Other texts are passed over before the shuffle by a filter of fixed size; with more rows than it can
    tell apart, more texts are shuffled than needed.
    """

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, mask = filter_bits(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], ["word", "mask"])

    bits = lists.select("row").mapInArrow(marks, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    wanted = np.zeros(FILTER_WORDS, np.uint64)
    wanted[bits.column("word").to_numpy()] = bits.column("mask").to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, mask = filter_bits(batch.column(1).to_numpy())
            yield batch.filter(pa.array(((sent.value[word] & mask) != 0).reshape(2, -1).all(axis=0)))

    texts = keyed(docs).mapInArrow(asked, "doc_id long, row long, text string")
    return texts.join(lists.hint("shuffle_hash"), "row").select("doc_id", "row", "text", *columns)


def stretches(docs: DataFrame, lists: DataFrame, least_words: int) -> DataFrame:
    """Candidate runs of the documents of ``lists`` (row, tag, seeds: first words of chunks), those with one first fixed chunk together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            for a, b in steps(offsets):
                data, own = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                found = Words(data, own, least_words)
                mine = batch.column(4).slice(a, b - a)
                seed = np.zeros(len(found.begin) + 1, bool)
                seed[mine.flatten().to_numpy(zero_copy_only=False) + np.repeat(found.first[:-1], mine.value_lengths().to_numpy(zero_copy_only=False))] = True
                low, high = found.chunks()
                foreign = np.concatenate([[0], np.cumsum(~seed[low])])
                runs, first, last = found.runs()
                kept = foreign[last] == foreign[first]
                runs, first = runs[kept], first[kept]
                if not len(runs):
                    continue
                opens = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (runs[1:] != runs[:-1] + 1)]))
                counts, runs, first = np.diff(np.append(opens, len(runs))), runs[opens], first[opens]
                owner, chars, to = found.doc[runs], code_points(data), runs + counts - 1 + least_words
                zero, at = chars[own[owner]], pa.array(owner)
                numbers = [chars[found.begin[runs]] - zero, chars[found.end[to - 1]] - zero, runs - found.first[owner], counts]
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k).slice(a, b - a).take(at) for k in (0, 3, 1)), *(pa.array(x.astype(np.int32)) for x in numbers),
                    pa.array(found.digest(low[first], high[first]).view(np.int64)), pa.array(found.digest(runs, to).view(np.int64))],
                    [c.split(" ")[0] for c in STRETCHES.split(", ")])

    return with_lists(docs, lists, "tag", "seeds").mapInArrow(run, STRETCHES)


def single_runs(docs: DataFrame, lists: DataFrame, least_words: int) -> DataFrame:
    """The runs of stretches one by one; ``lists`` has for each row its tag and stretches (at, runs, own, first, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            for a, b in steps(offsets):
                data, own = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                found = Words(data, own, least_words)
                mine = batch.column(4).slice(a, b - a)
                parts = mine.flatten()
                counts = pc.struct_field(parts, "runs").to_numpy(zero_copy_only=False).astype(np.int64)
                opens = pc.struct_field(parts, "at").to_numpy(zero_copy_only=False) + np.repeat(found.first[:-1], mine.value_lengths().to_numpy(zero_copy_only=False))
                of = np.repeat(np.arange(len(counts)), counts)
                runs = opens[of] + np.arange(len(of)) - (np.cumsum(counts) - counts)[of]
                owner, chars, to = found.doc[runs], code_points(data), runs + least_words
                zero, at, part = chars[own[owner]], pa.array(owner), pa.array(of)
                numbers = [chars[found.begin[runs]] - zero, chars[found.end[to - 1]] - zero, runs - found.first[owner]]
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k).slice(a, b - a).take(at) for k in (0, 3)), *(pa.array(x.astype(np.int32)) for x in numbers),
                    *(pc.struct_field(parts, c).take(part) for c in ("own", "first", "last")), pa.array(found.digest(runs, to).view(np.int64))],
                    [c.split(" ")[0] for c in RUNS.split(", ")])

    return with_lists(docs, lists, "tag", "parts").mapInArrow(run, RUNS)


def shared(found: DataFrame) -> DataFrame:
    """Digests of two documents or more, with the smallest id."""
    ends = found.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return ends.where("first_id < last_id").select("digest", "first_id")


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, start, end, n_words, first_doc_id) of every repeated passage, in code points.

    A passage is a longest run of words of which every one lies in ``least_words`` words in a row that
    another document has, too.  ``first_doc_id`` is the smallest id among the documents found to share the
    stretch of ``least_words`` words or more with which it begins; a deduplication keeps it there.  Null and empty texts
    have no passages.  Rows with one id are one document, repeats inside it do not count; rows without an
    id are one document, too.  Equal rows give their passages once.  An empty table gives no rows.
    Further columns are not read.
    """
    small_batches(docs.sparkSession)
    cut = written(chunk(docs, least_words).where("digest is not null").select("doc_id", "row", "at", "number", "need", "digest"), "chunks")
    # rows of one id are told apart by their hash; where an id has one row, the hash is left out of the shuffles to come
    rows = cut.where("at = 0").select("doc_id", "row").distinct()
    several = rows.join(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "doc_id").select("row", F.col("row").alias("tag"))
    seeds = cut.select("row", F.struct("number", "need", "at").alias("seed"), "digest").join(shared(cut), "digest")
    seeds = seeds.groupBy("row").agg(F.collect_set("seed").alias("seeds"))
    begins = F.exists("seeds", lambda s: (s.need > 0) & (F.size(F.filter(
        "seeds", lambda x: (x.number >= s.number) & (x.number < s.number + s.need))) == s.need))
    lists = seeds.where((F.size("seeds") > FEW_SEEDS) | begins).join(several, "row", "left")
    lists = written(lists.select("row", F.coalesce("tag", F.lit(0).cast("long")).alias("tag"), F.col("seeds.at").alias("seeds")), "seeds")
    met = written(stretches(docs, lists, least_words), "stretches")
    met = written(met.join(met.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "digest"), "met")
    # a run of a stretch that was not found twice may be part of another stretch with the same first fixed chunk
    alone = met.where("first = last")
    asked = met.where("first < last").join(alone.select("chunk").distinct(), "chunk", "left_semi")
    copy = asked.groupBy("digest", "first", "last").agg(F.min(F.struct("row", "tag", "at", "runs")).alias("of"))
    parts = alone.select("row", "tag", "at", "runs", F.lit(True).alias("own"), "first", "last").unionByName(
        copy.select("of.*", F.lit(False).alias("own"), "first", "last"))
    parts = parts.groupBy("row", "tag").agg(F.collect_list(F.struct("at", "runs", "own", "first", "last")).alias("parts"))
    runs = written(single_runs(docs, written(parts, "parts"), least_words), "runs")
    twice = runs.groupBy("digest").agg(F.min("first").alias("first_id"), F.max("last").alias("last_id")).where("first_id < last_id")
    columns = ["doc_id", "tag", "start", "end", "at", "runs", "first_id"]
    found = runs.where("own").withColumn("runs", F.lit(1)).join(twice, "digest").select(*columns).unionByName(
        met.where("first < last").select(*columns[:-1], F.col("first").alias("first_id")))
    order = Window.partitionBy("doc_id", "tag").orderBy("at")
    last = F.lag(F.col("at") + F.col("runs") - 1).over(order)
    joined = found.withColumn("opens", F.when(last + least_words >= F.col("at"), 0).otherwise(1))
    joined = joined.withColumn("passage", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    passages = joined.groupBy("doc_id", "tag", "passage").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        (F.max(F.col("at") + F.col("runs") - 1) - F.min("at") + least_words).alias("n_words"), F.min(F.struct("at", "first_id")).alias("first"))
    return passages.select(
        F.expr(f"nullif(doc_id, cast({NO_ID} as bigint))").alias("doc_id"), "start", "end", "n_words",
        F.expr(f"nullif(first.first_id, cast({NO_ID} as bigint))").alias("first_doc_id"))
