"""Ordered computations over keys that may be very large.

A plain window puts all rows of a key into one task.  The functions here cut the rows into
blocks of like size along keys and order: a window runs inside each (key, block), and one
small row per block carries what the later blocks need.  Bounds come from the data, so no
width has to be foreseen.  Aggregates by block combine before the shuffle.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaespark.session import written


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null, keeping the left keys."""
    if not keys:
        return left.crossJoin(right)  # the right side is one row: an aggregate without keys
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    test = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, test, how).drop(*[f"_r_{k}" for k in keys])


def in_blocks(df: DataFrame, keys: list[str], order: list, blocks: int | None = None) -> DataFrame:
    """The rows in blocks of like size along keys and order; ``_block`` rises with them.

    Blocks are range partitions, whose bounds Spark takes from a sample: a key with a third of the rows
    has a third of the blocks, and rows equal in the first order columns are cut by the later ones.  There
    are as many as shuffle partitions unless told.  They are written once, so that all that follows sees
    the same blocks.
    """
    number = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(number, *[F.col(k) for k in keys], *order).withColumn("_block", F.spark_partition_id())
    return written(cut, "blocks")


def _blocked(df: DataFrame, keys: list[str], order: list, block: Column | None, blocks: int | None) -> tuple[DataFrame, list[str]]:
    """The frame with its blocks, and the columns to drop when done."""
    if "_block" in df.columns:
        return df, []
    return (in_blocks(df, keys, order, blocks) if block is None else df.withColumn("_block", block)), ["_block"]


def running(
    df: DataFrame, keys: list[str], order: list, value: Column, out: str, inclusive: bool = True, total=F.sum,
    block: Column | None = None, blocks: int | None = None,
) -> DataFrame:
    """``total`` (sum or max) of ``value`` over the rows of a key up to (or before) each row.

    Nulls are passed over; where nothing came before, a sum is 0 and a maximum null.  ``_block`` is used
    and kept where the frame has it; ``block`` may give a cheaper one that rises with the order.
    """
    df, dropped = _blocked(df, keys, order, block, blocks)
    df = df.withColumn("_value", value)
    part = [*keys, "_block"]
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy(*part).agg(total("_value").alias("_of")).withColumn("_carried", total("_of").over(earlier)).drop("_of")
    inside = total("_value").over(
        Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    if total is F.sum:
        both = F.coalesce(F.col("_carried"), F.lit(0)) + F.coalesce(inside, F.lit(0))
    else:
        both = F.greatest(F.col("_carried"), inside)
    return join_null_safe(df, carried, part).withColumn(out, both).drop("_value", "_carried", *dropped)


def previous_value(df: DataFrame, keys: list[str], value: str, out: str, blocks: int | None = None) -> DataFrame:
    """The next smaller-or-equal value of the same key in sorted order, null for the first row."""
    return running(df, keys, [value], F.col(value), out, inclusive=False, total=F.max, blocks=blocks)


def with_key_values(df: DataFrame, per_key: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Add one row per key to the rows of a frame with ``_block``; a large key's rows meet it block by block."""
    known = join_null_safe(df.select(*keys, "_block").distinct(), per_key, keys, how)
    return join_null_safe(df, known, [*keys, "_block"], how)


def value_at_rank(df: DataFrame, keys: list[str], value: str, rank, out: str, blocks: int | None = None) -> DataFrame:
    """Exact order statistic per key: one row per key with ``out`` and the row count ``n``.

    ``rank(n)`` gives the 1-based position among the sorted values.  Equal values are counted together
    first; then only the block that holds the rank is sorted.
    """
    counts = in_blocks(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), keys, [value], blocks)
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    target = (
        counts.groupBy(*keys, "_block").agg(F.sum("_n").alias("_in_block"))
        .withColumns({
            "n": F.sum("_in_block").over(whole),
            "_before": F.coalesce(F.sum("_in_block").over(earlier), F.lit(0)),
        })
        .withColumn("_rank", rank(F.col("n")))
        .filter((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_in_block")))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(value)
    return (
        join_null_safe(counts, target, [*keys, "_block"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
        .filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
        .select(*keys, F.col(value).alias(out), "n")
    )


def trailing_count(
    df: DataFrame, keys: list[str], micros: str, window_micros: int, out: str, counted: Column | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Rows of the key in ``(t - window, t]`` for each row at ``t``, ties included.

    It is the difference of two running counts, at ``t`` and at ``t - window``: rows are counted by time
    first, and each time asks with a mark for what had come by the window's begin.
    """
    one = F.lit(1) if counted is None else counted.cast("int")
    times = df.groupBy(*keys, micros).agg(F.sum(one).alias("_n"))
    marks = times.select(*keys, micros, F.inline(F.array(
        F.struct(F.col(micros).alias("_at"), F.lit(0).alias("_mark"), F.col("_n")),
        F.struct((F.col(micros) - window_micros).alias("_at"), F.lit(1).alias("_mark"), F.lit(0).cast("long").alias("_n")))))
    upto = running(marks, keys, ["_at", "_mark"], F.col("_n"), "_upto", blocks=blocks)
    found = upto.groupBy(*keys, micros).agg(
        F.sum(F.when(F.col("_mark") == 0, F.col("_upto")).otherwise(-F.col("_upto"))).alias(out))
    return join_null_safe(df, found, [*keys, micros])


#: Heavy keys that are broadcast, at most: a few hundred kilobytes.
MOST_HEAVY = 10_000


def heavy_keys(facts: DataFrame, key: str, rows_per_task: int = 1_000_000) -> DataFrame:
    """Keys with more facts than one task should take, with the number of salts to spread them over.

    At most one row per ``rows_per_task`` facts; only the key column of the facts is read.
    """
    return (
        facts.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_task)
        .select(F.col(key).alias("_key"), F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts"))
    )


def salted_join(
    facts: DataFrame, records: DataFrame, key: str, how: str = "inner", heavy: DataFrame | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """Equi-join where a key may hold a large share of ``facts``.

    Heavy keys are spread over several salts, and their record is copied once per salt; all
    other keys join as usual.  Every row is kept.  ``heavy`` may come from a cheaper frame
    with the same keys than ``facts``; ``by`` names the columns whose hash picks the salt.

    Which keys are heavy is found first, by a job that reads the key column only.  Without any,
    this is a plain join.  Up to ``MOST_HEAVY`` of them are broadcast, so that facts get their salt
    before they are shuffled; more of them are joined.

    The records are shuffled at any size, never broadcast: by the size of its files a table of a million
    short records counts as small, and as rows it does not fit the driver.
    """
    heavy = heavy_keys(facts, key) if heavy is None else heavy
    found = heavy.limit(MOST_HEAVY + 1).collect()
    if not found:
        return facts.join(records.hint("merge"), key, how)
    if len(found) <= MOST_HEAVY:
        heavy = F.broadcast(facts.sparkSession.createDataFrame(found, heavy.schema))
    rest = [F.col(c) for c in by or facts.columns if c != key]
    spread = F.pmod(F.xxhash64(*rest), F.col("_salts")) if rest else F.lit(0)
    left = (
        facts.join(heavy, facts[key] == heavy["_key"], "left")
        .withColumn("_salt", F.coalesce(spread, F.lit(0)).cast("int")).drop("_key", "_salts")
    )
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    right = (
        records.join(heavy, records[key] == heavy["_key"], "left")
        .withColumn("_salt", F.explode(salts)).drop("_key", "_salts").hint("merge")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")
