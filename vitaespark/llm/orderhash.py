"""Order MinHash fingerprints with DataFrame functions only.

A text's k-mers (runs of ``SIZE`` words) are numbered by occurrence, so a repeated k-mer is several
elements.  For each of ``TUPLES`` hash functions the two elements with the smallest hashes are taken in
their order in the text, and the pair is hashed.  Two fingerprints agree in a tuple if both elements
occur in both texts in the same order, which follows edit distance rather than set overlap.

Texts are exploded into k-mers after the one shuffle by document, and everything after (numbering,
smallest, second smallest) happens within that partitioning.  The smallest hashes and then the second
smallest come from a hash aggregate of numbers each, so that no row per k-mer is sorted or held.
"""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitaespark.llm.arrays import text_column, written
from vitaespark.operators.ordered import join_null_safe

TUPLES, SIZE = 32, 3
#: Low bits of a packed number hold a k-mer's place in the text, the others its hash.
PLACE_BITS = 28
PLACE = (1 << PLACE_BITS) - 1
#: Stands for a missing id while ids are compared.
NO_ID = -(1 << 62)


def packed(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~PLACE)).bitwiseOR(place)


def _same(place: Column, gram: Column) -> Column:
    """Whether the sorted column ``s`` has this k-mer at a place; null outside of it."""
    return F.get("s", place).bitwiseAND(F.lit(~PLACE)) == gram


def _many_before(x: Column, i: Column) -> Column:
    """How many equal k-mers stand before place ``i`` of ``s``, found by halving; null if fewer than three."""
    gram = x.bitwiseAND(F.lit(~PLACE))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(PLACE_BITS))])
    start = F.aggregate(steps, i, lambda at, step: F.when(_same(at - step, gram), at - step).otherwise(at))
    return F.when(_same(i - 3, gram), i - start)


def _eight(number: Column) -> Column:
    """Eight hexadecimal digits of a number below 2^32."""
    return F.translate(F.lpad(F.hex(number), 8, "0"), "ABCDEF", "abcdef")


def _elements(texts: DataFrame, others: list[str]) -> DataFrame:
    """Other columns and ``x``: a row per element, or one without it for a text without words."""
    bare = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    listed = texts.select(*others, F.when(bare != "", F.split(bare, r"[\x20\x09-\x0D]+")).alias("w"))
    count = F.greatest(F.size("w") - (SIZE - 1), F.least(F.size("w"), F.lit(1)))
    grams = F.transform(F.sequence(F.lit(1), count), lambda i: packed(
        F.xxhash64(*[F.get("w", i + k) for k in range(-1, SIZE - 1)]), i.cast("long")))
    listed = listed.select(*others, F.when(F.col("w").isNotNull(), F.sort_array(grams)).alias("s"))
    # equal k-mers are neighbours now, in text order: the number of those before is the occurrence
    many = F.size(F.filter("s", lambda x, i: _same(i - 3, x.bitwiseAND(F.lit(~PLACE))))) > 0
    listed = listed.withColumn("many", F.when(many, F.transform("s", _many_before)))
    rows = listed.select(*others, "s", "many", F.posexplode_outer("s").alias("nth", "x"))
    nth, gram = F.col("nth"), F.col("x").bitwiseAND(F.lit(~PLACE))
    count = F.get("many", nth)
    for k in (3, 2, 1):
        count = F.when(F.coalesce(_same(nth - k, gram), F.lit(False)), count).otherwise(k - 1)
    return rows.select(*others, packed(F.xxhash64(gram, count), F.col("x").bitwiseAND(F.lit(PLACE))).alias("x"))


def fingerprints(texts: DataFrame, keys: list[str], carried: list[str] = ()) -> DataFrame:
    """One row per (keys) with ``fingerprint``: 8 hexadecimal digits for each tuple.

    ``texts`` has ``text``, the keys, which tell texts apart, and columns to be carried along, which depend on
    the keys.  A text without words has no elements, and all such texts are alike.  Elements are neither
    sorted nor kept: they are made once for the smallest hashes and again for the second smallest, so
    ``texts`` must give the same rows both times.
    """
    element, place = F.col("x").bitwiseAND(F.lit(~PLACE)), F.col("x").bitwiseAND(F.lit(PLACE))
    hashed = [packed(F.xxhash64(element, F.lit(j)), place) for j in range(TUPLES)]
    first = _elements(texts, [*keys, *carried]).groupBy(*keys, *carried).agg(
        *[F.min(h).alias(f"a{j}") for j, h in enumerate(hashed)])
    least = [f"a{j}" for j in range(TUPLES)]
    first, again = first.hint("shuffle_hash"), texts.select(*keys, "text")
    bare = any(texts.schema[k].nullable for k in keys)
    # keys that cannot be null are compared as they are, which leaves rows where they lie
    known = join_null_safe(again, first, keys) if bare else again.join(first, keys)
    two = _elements(known, [*keys, *carried, *least]).groupBy(*keys, *carried, *least).agg(
        *[F.min(F.when(h > F.col(f"a{j}"), h)).alias(f"b{j}") for j, h in enumerate(hashed)])

    def pair(j: int) -> Column:
        a, b = F.col(f"a{j}"), F.col(f"b{j}")
        swapped = F.coalesce(b.bitwiseAND(F.lit(PLACE)) < a.bitwiseAND(F.lit(PLACE)), F.lit(False))
        x, y = (v.bitwiseAND(F.lit(~PLACE)) for v in (a, b))
        digest = F.xxhash64(F.when(swapped, y).otherwise(x), F.when(swapped, x).otherwise(y), F.lit(j))
        return _eight(digest.bitwiseAND(F.lit(0xFFFFFFFF)))

    return two.select(*keys, *carried, F.concat(*[pair(j) for j in range(TUPLES)]).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of tuples in which two fingerprints agree."""
    agree = F.filter(F.sequence(F.lit(0), F.lit(TUPLES - 1)), lambda j: F.substring(a, j * 8 + 1, 8) == F.substring(b, j * 8 + 1, 8))
    return F.size(agree) / F.lit(float(TUPLES))


@contextmanager
def _local_joins(spark: SparkSession) -> Iterator[None]:
    """Joins on more keys than their rows are dealt by shuffle nothing, as long as this lasts."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def followers(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next smaller id, and the largest after the smallest.

    Ids are dealt by range; a block's window needs no more than its neighbour's last id.
    """
    blocks = written(ids.repartitionByRange("doc_id").withColumn("block", F.spark_partition_id()), "ids")
    # one row per block, as many as shuffle partitions
    edges = blocks.groupBy("block").agg(F.max("doc_id").alias("last"))
    before = Window.orderBy("block")
    edges = edges.withColumn("back", F.lag("last").over(before)).withColumn("top", F.max("last").over(Window.partitionBy(F.lit(1))))
    own = F.lag("doc_id").over(Window.partitionBy("block").orderBy("doc_id"))
    return blocks.withColumn("own", own).join(F.broadcast(edges), "block").select(
        "doc_id", F.coalesce("own", "back", "top").alias("next_id"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and their likeness.

    The edited text replaces the last third of the code points by the beginning of the next document's
    text in descending order of id.  A null text is empty.  Rows of one id have the same next document,
    whose text is the smallest one if several rows have its id (and its fingerprint the smallest one);
    rows without an id come last.  A single document is its own next.  An empty table gives no rows,
    further columns are not read.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_column().alias("text"))
    ids = docs.groupBy("doc_id").agg(F.max(F.length("text")).alias("longest"))
    order = followers(ids.select("doc_id"))
    wanted = ids.join(order, "doc_id").select(
        F.col("doc_id").alias("receiver"), F.col("next_id").alias("doc_id"), F.floor(F.col("longest") / 3).cast("int").alias("need"))
    starts = docs.join(wanted, "doc_id").select(F.col("receiver").alias("doc_id"), F.expr("substring(text, 1, need)").alias("start"))
    starts = starts.groupBy("doc_id").agg(F.min("start").alias("start"))
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    # rows of one id and text are alike: they are told from others by a hash and counted
    pairs = docs.join(starts, "doc_id").select(
        "doc_id", F.xxhash64("text").alias("row"), "text", size.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), size - third), F.substring("start", F.lit(1), third)).alias("edited"))
    # both texts of a document go on together; the digest travels as bytes
    both = pairs.withColumn("sha", F.unhex(F.sha2("edited", 256))).select(
        "doc_id", "row", "n_chars", "sha", F.posexplode(F.array("text", "edited")).alias("form", "text"))
    marked = fingerprints(both, ["doc_id", "row", "form"], ["n_chars", "sha"]).groupBy("doc_id", "row", "n_chars", "sha").agg(
        F.max(F.when(F.col("form") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("form") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    copies = docs.groupBy("doc_id", F.xxhash64("text").alias("row")).agg(F.count("*").cast("int").alias("copies"))
    marked = marked.join(copies, ["doc_id", "row"]).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    with _local_joins(docs.sparkSession):
        marked = written(marked.drop("copies", "copy"), "fingerprints")
    nexts = marked.groupBy("doc_id").agg(F.min("fingerprint").alias("next_fingerprint"))
    nexts = order.join(nexts.withColumnRenamed("doc_id", "next_id"), "next_id").select("doc_id", "next_fingerprint")
    return marked.join(nexts, "doc_id").select(
        F.expr(f"nullif(doc_id, cast({NO_ID} as bigint))").alias("doc_id"), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
