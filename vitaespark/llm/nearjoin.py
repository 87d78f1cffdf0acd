"""Near-duplicates: an inverted join over the coordinates of MinHash signatures.

Documents with equal shingle sets are one class.  A class is posted under (coordinate, value) pairs of
its signature.  Two classes that agree in at least ``t`` of ``n`` coordinates share a posting among the
``n - t + 1`` first ones of each in any common order, so only those are posted, rare pairs first.

Lists are merged in two steps, so no list is expanded into all its pairs.  First every member meets hubs of
its lists, those that most of its lists have, unless a few bytes of both signatures rule the pair out:
agreeing coordinates are counted, and links confirmed on the full sets.  This goes in rounds, a few hubs
first: a later round looks only at lists whose members are still apart, and at hubs of other components.
Then lists whose members are already in one component are skipped; in the others, members of
different components are counted against each other, in blocks, and by a finer sketch before the sets.  ``t`` lies 4.75 standard deviations
below the expected count of a pair at the threshold, so fewer than one such pair in 100,000 is missed.
"""

from collections.abc import Iterator
from math import floor, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from vitaespark.llm.arrays import (LOWER, SPACED, _splitmix, mix, shingle_hashes, small_batches, steps, text_column, utf8, word_hashes,
                                   words, written)
from vitaespark.llm.components import components
from vitaespark.llm.joins import salted_left

COORDINATES = 64
#: Cells of the table of frequent pairs that each task gets, whatever the input's size.
CELLS = 1 << 20
#: Members of a list that one task compares with as many others.
BLOCK = 1000
#: Hubs that a member is compared with before its lists are looked at as a whole, round by round: two, then
#: more in lists whose members are still apart.
HUBS = (2, 16)
#: Of the lowest bytes of eight coordinates, so many agree before a member and its hub are looked at.
MINI_LEAST = 3
#: Stands for a missing id while ids are compared.
NO_ID = -(1 << 62)

#: Coordinates of the finer sketch that members of open lists get.
FINE = 512
FINE_FACTORS, FINE_SHIFTS = _splitmix(FINE, 15) | np.uint64(1), _splitmix(FINE, 16)
FACTORS, SHIFTS = _splitmix(COORDINATES, 5) | np.uint64(1), _splitmix(COORDINATES, 6)


def least_matches(percent: int, coordinates: int = COORDINATES, deviations: float = 4.75) -> int:
    share = percent / 100
    return max(1, floor(coordinates * share - deviations * sqrt(coordinates * share * (1 - share))))


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; short texts are one shingle, empty ones none."""
    raw, offsets = utf8(column)
    for a, b in steps(offsets):
        data = LOWER[raw[offsets[a]:offsets[b]]]
        begin, end, first = words(data, offsets[a:b + 1] - offsets[a], SPACED)
        hashes = word_hashes(data, begin, end) if len(begin) else np.zeros(0, np.uint64)
        every = shingle_hashes(hashes, size)
        for f, g in zip(first[:-1].tolist(), first[1:].tolist()):
            yield np.unique(every[f:g - size + 1] if g - f >= size else shingle_hashes(hashes[f:g], size))


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            part = shingles[at:at + 2048]
            hashed = (part[None, :] * FACTORS[:, None] + SHIFTS[:, None]) >> np.uint64(32)
            np.minimum(out, hashed.min(axis=1).astype(np.uint32), out=out)
    return out


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    with np.errstate(over="ignore"):
        return np.array([mix(shingles).sum(dtype=np.uint64), mix(shingles ^ FACTORS[0]).sum(dtype=np.uint64)]).tobytes()


def sign(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature) per row; no key or signature for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), set_key(s), signature(s).tobytes()) if len(s) else (0, None, None) for s in shingle_sets(batch.column(1), size)]
            n, keys, signs = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "signature"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary")


@F.pandas_udf(BinaryType())
def lowest_bytes(signature: pd.Series) -> pd.Series:
    return signature.map(lambda s: s[::4])


def tokens_of(batch: pa.Array) -> np.ndarray:
    """Posting keys of a column of signatures: coordinate and value in one number each."""
    values = np.frombuffer(b"".join(batch.to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.int64)
    return values | (np.arange(COORDINATES, dtype=np.int64) << 32)


def frequent_cells(classes: DataFrame) -> np.ndarray:
    """Approximate counts of frequent posting keys, hashed into a fixed number of cells.

    The counts only order the keys of a class: any order gives the same pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = np.unique(tokens_of(batch.column(0)) * -7046029254386353131 >> 44 & CELLS - 1, return_counts=True)
            kept = n > 2
            yield pa.RecordBatch.from_arrays([pa.array(keys[kept]), pa.array(n[kept])], ["cell", "n"])

    counted = classes.select("signature").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(CELLS, np.int32)
    rows = counted.toArrow()  # at most CELLS rows, as columns
    out[rows.column("cell").to_numpy()] = np.minimum(rows.column("n").to_numpy(), 1 << 30)
    return out


def prefixes(batch_tokens: np.ndarray, cells: np.ndarray, length: int) -> np.ndarray:
    """Coordinates of each class's rarest posting keys."""
    counts = cells[batch_tokens * -7046029254386353131 >> 44 & CELLS - 1]
    return np.argsort((counts.astype(np.int64) << 6) + np.arange(COORDINATES), axis=1, kind="stable")[:, :length]


#: 64-bit words of the filter that says which documents' sets are wanted: 8 MB, whatever the input's size.
FILTER_WORDS = 1 << 20
#: Bytes of a shingle's hash that travel; two sets of 20,000 have a chance of 1 in 700,000 to clash anywhere.
SHINGLE_BYTES = 6


def filter_bits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and masks of the two bits of each id."""
    with np.errstate(over="ignore"):
        hashed = mix(ids.view(np.uint64) + np.uint64(0x51ED270B))
    word = np.concatenate([hashed % np.uint64(FILTER_WORDS), (hashed >> np.uint64(24)) % np.uint64(FILTER_WORDS)]).astype(np.int64)
    return word, np.uint64(1) << np.concatenate([hashed >> np.uint64(58), (hashed >> np.uint64(52)) & np.uint64(63)])


def of_members(docs: DataFrame, ids: DataFrame, size: int, encode, column: str) -> DataFrame:
    """(id, column): what ``encode`` makes of the shingle sets of the documents named by the ids.

    Texts are not shuffled: tasks read them again and skip those that a filter of fixed size rules out.
    With more ids than it can tell apart, more sets are made than needed, which later joins leave out.
    """

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, mask = filter_bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], ["word", "mask"])

    rows = ids.distinct().mapInArrow(marks, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    rows = rows.toArrow()  # FILTER_WORDS rows at most, as columns
    wanted = np.zeros(FILTER_WORDS, np.uint64)
    wanted[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            word, mask = filter_bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            both = ((bits[word] & mask) != 0).reshape(2, -1).all(axis=0)
            asked = batch.filter(pa.array(both))
            coded = [encode(s) for s in shingle_sets(asked.column(1), size)]
            yield pa.RecordBatch.from_arrays([asked.column(0), pa.array(coded, pa.binary())], ["id", column])

    return written(docs.mapInArrow(gather, f"id long, {column} binary"), column)


def full_sets(docs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(id, shingles) of the documents in pairs (a, b)."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    return of_members(docs, ids, size, lambda s: (
        (s >> np.uint64(64 - 8 * SHINGLE_BYTES)).view(np.uint8).reshape(-1, 8)[:, :SHINGLE_BYTES].tobytes()), "shingles")


def sketch(shingles: np.ndarray) -> bytes:
    """The lowest bytes of ``FINE`` further coordinates: a finer estimate for members that are still apart."""
    out = np.full(FINE, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 256):
            part = shingles[at:at + 256]
            hashed = (part[None, :] * FINE_FACTORS[:, None] + FINE_SHIFTS[:, None]) >> np.uint64(32)
            np.minimum(out, hashed.min(axis=1).astype(np.uint32), out=out)
    return (out & 255).astype(np.uint8).tobytes()


def shingles_of(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // SHINGLE_BYTES, 8), np.uint8)
    out[:, :SHINGLE_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, SHINGLE_BYTES)
    return out.view(np.uint64).ravel()


def joined(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    x = table.select(F.col("id").alias("a"), F.col(column).alias("x"))
    y = table.select(F.col("id").alias("b"), F.col(column).alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")


def across(pairs: DataFrame, of_id: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components; an id without one is alone."""
    x = of_id.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    y = of_id.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    both = pairs.join(x, "a", "left").join(y, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have ``percent`` of their union in common."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = shingles_of(x.as_py()), shingles_of(y.as_py())
                x, y = (x, y) if len(x) < len(y) else (y, x)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return written(joined(pairs, sets, "shingles").mapInArrow(confirm, "a long, b long"), "confirmed")


def best_first(docs: DataFrame, agreed: DataFrame, links: DataFrame | None, size: int, percent: int) -> DataFrame:
    """The links and those among the pairs (a, b, same): each class first meets the partner most like it, then those from which it is still apart."""
    sets = full_sets(docs, agreed, size)
    best = agreed.groupBy("b").agg(F.max(F.struct("same", (-F.col("a")).alias("minus"))).alias("top"))
    found = confirmed(best.select((-F.col("top.minus")).alias("a"), "b"), sets, percent)
    links = found if links is None else links.union(found)
    rest = across(agreed.select("a", "b"), components(links))
    return written(links.union(confirmed(rest, sets, percent)), "links")


def _equal_bytes(a: Column, b: Column) -> Column:
    """In how many of their eight bytes two numbers agree."""
    apart, same = a.bitwiseXOR(b), F.lit(0)
    for k in range(8):
        same = same + (F.shiftrightunsigned(apart, 8 * k).bitwiseAND(F.lit(255)) == 0).cast("int")
    return same


def hub_pairs(members: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) of members (token, id, mini, component) and the hubs of other components that they meet most often."""
    # two hubs of each list: its smallest id, and one drawn by a hash, another one in each list
    of_hub = ["id", "mini", "component"]
    least_id, drawn = F.struct(*of_hub), F.struct(F.xxhash64("id", "token").alias("draw"), *of_hub)
    hubs = members.groupBy("token").agg(F.min(least_id).alias("one"), F.min(drawn).alias("two"))
    hubs = hubs.select("token", F.array("one", F.struct(*[f"two.{c}" for c in of_hub])).alias("hubs"))
    # members unlike their hub in a few coordinates go no further here: these steps only save work later
    like = F.filter("hubs", lambda h: (h.component != F.col("component")) & (_equal_bytes(h.mini, F.col("mini")) >= MINI_LEAST))
    met = members.join(hubs, "token").select("id", F.explode(like).alias("hub")).groupBy("id", F.col("hub.id").alias("hub")).count()
    # of the few dozen hubs of its lists each member looks at those that it meets most often
    often = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("less"), "hub"))), 1, most)
    pairs = met.groupBy("id").agg(often.alias("often")).select("id", F.explode("often.hub").alias("hub"))
    return pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def near_links(docs: DataFrame, classes: DataFrame, size: int, percent: int, rounds: tuple[int, ...]) -> DataFrame:
    """Confirmed links (a, b) that join the classes (id, n, signature) into their components."""
    least = least_matches(percent)
    length = COORDINATES - least + 1
    cells = docs.sparkSession.sparkContext.broadcast(frequent_cells(classes))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = tokens_of(batch.column(1))
            first = prefixes(tokens, cells.value, length)
            mini = np.ascontiguousarray((tokens[:, :8] & 255).astype(np.uint8)).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.take_along_axis(tokens, first, axis=1).ravel()),
                pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), length)),
                pa.array(np.repeat(mini, length))], ["token", "id", "mini"])

    posted = classes.select("id", "signature").mapInArrow(post, "token long, id long, mini long")
    lists = posted.groupBy("token").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("token")
    shared = written(posted.join(lists, "token").select("token", "id", "mini"), "postings")

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, COORDINATES) for k in (2, 3))
            same = (x == y).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(same)], ["a", "b", "same"]).filter(pa.array(same >= least))

    # the lowest byte of each coordinate: it agrees wherever the coordinate does, so no pair is lost
    short = classes.select("id", F.col("brief"))
    links, known = None, shared.withColumn("component", F.col("id"))
    for most in rounds:
        pairs = hub_pairs(known, most)
        agreed = written(joined(pairs, short, "brief").mapInArrow(agreeing, "a long, b long, same long"), "agreed")
        links = best_first(docs, agreed, links, size, percent)
        # lists whose members lie in one component are done
        of_id = components(links)
        now = known.drop("component").join(of_id, "id", "left").withColumn("component", F.coalesce("component", "id"))
        now = written(now.select("token", "id", "mini", "component"), "labelled")
        undone = now.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        known = now.join(undone.select("token"), "token", "left_semi")

    # the others compare what is still apart
    apart = known.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    open_ = known.select("token", "id", "component").join(apart, "token").join(classes.select("id", F.col("n_shingles"), "signature"), "id")
    fine = of_members(docs, open_.select("id"), size, sketch, "fine")
    open_ = open_.join(fine, "id")
    fine_least = least_matches(percent, FINE, 4.0)
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = open_.withColumn("own", own).withColumn("other", other).select(
        "token", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "component", "n_shingles", "signature", "fine")
    dealt = dealt.repartition("token", "p", "q").sortWithinPartitions("token", "p", "q")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cross(block: pa.Table) -> pa.RecordBatch | None:
            token, p, q = (block.column(k)[0].as_py() for k in range(3))
            side, ids, label, n = (block.column(k).to_numpy() for k in range(3, 7))
            keys = tokens_of(block.column(7))
            finer = np.frombuffer(b"".join(block.column(8).to_pylist()), np.uint8).reshape(-1, FINE)
            first = np.zeros(keys.shape, bool)
            np.put_along_axis(first, prefixes(keys, cells.value, length), True, axis=1)
            found = []
            for i in np.flatnonzero(side == p):
                rest = np.flatnonzero((label != label[i]) & ((side == q) if p != q else (np.arange(len(ids)) > i))
                                      & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent))
                if not len(rest):
                    continue
                same = keys[rest] == keys[i]
                # a pair in several common lists belongs to the one of its first common coordinate
                home = (same & first[rest] & first[i]).argmax(axis=1) == token >> 32
                rest = rest[home & (same.sum(axis=1) >= least)]
                alike = (finer[rest] == finer[i]).sum(axis=1)
                found += [(min(ids[i], x), max(ids[i], x), k) for x, k in zip(ids[rest], alike) if k >= fine_least]
            if not found:
                return None
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b", "same"])

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([table.column(k).to_numpy() for k in range(3)])
            cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
            for a, b in zip(cut[:-1], cut[1:]):
                if b < table.num_rows or last:
                    out = cross(table.slice(a, b - a))
                    if out is not None:
                        yield out
            held = [] if last else table.slice(cut[-2]).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from whole(False)
        if held:
            yield from whole(True)

    crossed = written(dealt.mapInArrow(compare, "a long, b long, same long").distinct(), "crossed")
    return best_first(docs, crossed, links, size, percent)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, hubs: tuple[int, ...] = HUBS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row: documents linked by ``percent`` of common shingles.

    Null and empty texts have no shingles and are linked with nothing; texts of fewer than ``size`` words
    are one shingle.  Rows with one id are one document: whatever any of them is linked with.  Rows
    without an id are one document whose component is null if it is alone.  Further columns are not
    read; an empty table gives no rows.

    ``hubs`` moves work, not results: with few hubs or rounds more is left to the comparison inside lists.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_column().alias("text"))
    signed = written(sign(docs, size), "signed")
    full = signed.where("set_key is not null")
    classes = full.groupBy("set_key").agg(
        F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"))
    classes = written(classes.withColumn("brief", lowest_bytes("signature")), "classes")
    # ids with several texts join those texts' classes
    several = full.groupBy("doc_id").agg(F.min("set_key").alias("one"), F.max("set_key").alias("two")).where("one <> two")
    multiple = classes.where("copies > 1").select("set_key", F.col("id").alias("class_id"))
    own = salted_left(signed, multiple, ["set_key"], "doc_id").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    bound = own.join(several.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    links = near_links(docs, classes, size, percent, hubs).union(bound)
    of_class = components(links).select(F.col("id").alias("class_id"), "component")
    out = salted_left(own, of_class, ["class_id"], "doc_id")
    component = F.expr(f"nullif(coalesce(component, class_id), cast({NO_ID} as bigint))")
    doc_id = F.expr(f"nullif(doc_id, cast({NO_ID} as bigint))")
    return out.select(doc_id.alias("doc_id"), "n_shingles", component.alias("component_id")).select(
        "*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
