"""Call limiters whose decision depends on earlier decisions.

Neither walks a key's calls one by one.  The sliding limiter decides block by block: each block assumes
which admitted calls it starts from, and only blocks that assumed wrongly decide again.  The anchored
limiter follows links from each time to the first one a window later, doubling the links' reach.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.operators import ordered
from vitaespark.operators.metering import budget_admission, is_recorded, micros
from vitaespark.session import written

#: Where a call without a time stands: before all others.
NO_TIME = -(1 << 62)


def admit(times: np.ndarray, window: int, most: int) -> np.ndarray:
    """Which calls of one key are admitted, times rising: fewer than ``most`` admitted ones lie less than a window back.

    With i calls up to a time and p of them out of its window, the number of refused ones obeys
    ``refused(i) = max(refused(i - 1), refused(p) + (i - p) - most)``.  Only calls with more than ``most``
    offered ones in their window can raise it, and those of one window are decided at once.
    """
    n = len(times)
    out = np.searchsorted(times, times - window, "right")
    excess = np.arange(1, n + 1) - out - most
    busy = np.flatnonzero(excess > 0)
    if not len(busy):
        return np.ones(n, bool)
    excess, known = excess[busy], np.searchsorted(busy, out[busy])  # busy calls that are out of each one's window
    refused = np.zeros(len(busy) + 1, np.int64)
    at = 0
    while at < len(busy):
        to = int(np.searchsorted(known, at, "right"))
        refused[at + 1:to + 1] = np.maximum.accumulate(np.maximum(refused[known[at:to]] + excess[at:to], refused[at]))
        at = to
    admitted = np.ones(n, bool)
    admitted[busy] = refused[1:] == refused[:-1]
    return admitted


def _decided(window: int, most: int, end: bool):
    """A column function of (admitted times before a block, its times): decisions, or the admitted times that still count after it."""
    def run(before: pa.Array, times: pa.Array) -> pa.Array:
        out = []
        for k in range(len(times)):
            first, own = (np.asarray(x[k].values.to_numpy(zero_copy_only=False), np.int64) for x in (before, times))
            both = np.concatenate([first, own])
            admitted = admit(both, window, most)
            if end:
                out.append(both[admitted & (both > both[-1] - window)])
            else:
                out.append(admitted[len(first):])
        return pa.array(out, pa.list_(pa.int64() if end else pa.bool_()))

    return F.arrow_udf(run, "array<bigint>" if end else "array<boolean>")


def sliding_limiter(calls: DataFrame, keys: list[str], max_calls: int = fixed.MAX_RPM,
                    window_seconds: int = fixed.RATE_WINDOW_SECONDS, blocks: int | None = None) -> DataFrame:
    """Admit a call iff fewer than ``max_calls`` admitted calls lie less than a window back.

    Calls are cut into blocks of like size.  A block's decisions depend on the past only through the
    admitted times of the last window, ``max_calls`` at most.  All blocks first decide as if there were
    none; then each gets what the one before has left, and those for which that is news decide again,
    until there is no news.  Only a key's later blocks can be among them, so few blocks are looked at
    again, and in a log whose windows settle by themselves few rounds do.
    """
    window = window_seconds * 1_000_000
    helper = calls.withColumn("_micros", F.coalesce(micros(), F.lit(NO_TIME)))
    cut = ordered.in_blocks(helper, keys, ["_micros", "call_id"], blocks)
    part = [*keys, "_block"]
    times = written(cut.groupBy(*part).agg(F.sort_array(F.collect_list("_micros")).alias("_times")), "call-times")
    after, decide = _decided(window, max_calls, True), _decided(window, max_calls, False)
    none = F.array().cast("array<bigint>")
    state = written(times.select(*part, F.get("_times", 0).alias("_first"), none.alias("_before"), after(none, F.col("_times")).alias("_after")), "states")
    previous = F.lag("_after").over(Window.partitionBy(*keys).orderBy("_block"))
    while True:
        seen = written(state.withColumn(
            "_given", F.filter(F.coalesce(previous, none), lambda a: a > F.col("_first") - window)), "states")
        news = seen.filter(F.col("_given") != F.col("_before"))
        if not news.limit(1).count():
            break
        # at most one row for each bound between two blocks, with ``max_calls`` times at most
        again = ordered.join_null_safe(times, F.broadcast(news.select(*part, "_first", "_given")), part).select(
            *part, "_first", F.col("_given").alias("_before"), after(F.col("_given"), F.col("_times")).alias("_after"))
        state = written(seen.filter(F.col("_given") == F.col("_before")).drop("_given").unionByName(again), "states")
    decided = ordered.join_null_safe(times, state.select(*part, "_before"), part).select(
        *part, F.posexplode(decide(F.col("_before"), F.col("_times"))).alias("_at", "admitted"))
    place = F.row_number().over(Window.partitionBy(*part).orderBy("_micros", "call_id")) - 1
    return ordered.join_null_safe(cut.withColumn("_at", place), decided, [*part, "_at"]).drop("_micros", "_block", "_at")


def _links(times: DataFrame, keys: list[str], window: int, blocks: int | None) -> tuple[DataFrame, DataFrame]:
    """From distinct times the ones that open a window in any case, and links to the first time a window later.

    A time a window or more after the one before it opens a window whatever came earlier, so no link
    leads to it.
    """
    at = F.col("_micros")
    marks = times.select(*keys, F.inline(F.array(
        F.struct(at.alias("_at"), F.lit(1).alias("_call"), at.alias("_of")),
        F.struct((at + window).alias("_at"), F.lit(0).alias("_call"), at.alias("_of")))))
    order, part = ["_at", "_call"], [*keys, "_block"]
    cut = ordered.in_blocks(marks, keys, order, blocks)
    call = F.when(F.col("_call") == 1, F.col("_at"))
    before = ordered.running(cut, keys, order, call, "_last", inclusive=False, total=F.max)
    later = Window.partitionBy(*keys).orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    carried = cut.groupBy(*part).agg(F.min(call).alias("_of_block")).withColumn("_later", F.min("_of_block").over(later)).drop("_of_block")
    inside = F.min(call).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(0, Window.unboundedFollowing))
    known = written(ordered.join_null_safe(before, carried, part).withColumn("_next", F.least(inside, "_later")), "next-times")
    opens = known.filter((F.col("_call") == 1) & (F.col("_last").isNull() | (F.col("_at") - F.col("_last") >= window)))
    links = known.filter((F.col("_call") == 0) & (F.col("_next") - F.col("_last") < window))
    return opens.select(*keys, F.col("_at").alias("_micros")), links.select(*keys, F.col("_of").alias("_micros"), "_next")


def window_starts(calls: DataFrame, keys: list[str], window: int, blocks: int | None = None) -> DataFrame:
    """Times (``keys``, ``_micros``) at which a window opens: the first call, and each first one after a window has ended.

    After k rounds the first 2^k windows of every stretch are known and links lead 2^k windows on.
    """
    known, links = _links(calls.select(*keys, "_micros").distinct(), keys, window, blocks)
    known, links = written(known, "windows"), written(links, "links")
    node = [*keys, "_micros"]
    while links.limit(1).count():
        onwards = ordered.join_null_safe(known, links, node).select(*keys, F.col("_next").alias("_micros"))
        known = written(known.unionByName(onwards), "windows")
        double = links.select(*keys, F.col("_micros").alias("_next"), F.col("_next").alias("_beyond"))
        links = written(
            ordered.join_null_safe(links, double, [*keys, "_next"]).select(*node, F.col("_beyond").alias("_next")), "links")
    return known


def fixed_window_limiter(calls: DataFrame, keys: list[str], max_calls: int = fixed.MAX_RPM,
                         window_seconds: int = fixed.RATE_WINDOW_SECONDS, blocks: int | None = None) -> DataFrame:
    """A window opens at the first call after the last one ended; only successful calls that report usage count.

    When windows open depends on times alone.  Inside a window a call is admitted while fewer than
    ``max_calls`` before it count: a difference of two running counts, at the call and where its window
    opens.
    """
    timed = calls.withColumns({"_micros": F.coalesce(micros(), F.lit(NO_TIME)), "_call": F.lit(1)})
    starts = window_starts(timed, keys, window_seconds * 1_000_000, blocks).withColumn("_call", F.lit(0))
    order = ["_micros", "_call", "call_id"]
    cut = ordered.in_blocks(timed.unionByName(starts, allowMissingColumns=True), keys, order, blocks)
    one = ((F.col("_call") == 1) & is_recorded()).cast("int")
    counted = ordered.running(cut, keys, order, one, "_counted", inclusive=False)
    opened = ordered.running(counted, keys, order, F.when(F.col("_call") == 0, F.col("_counted")), "_opened", total=F.max)
    used: Column = F.col("_counted") - F.col("_opened")
    return opened.filter("_call = 1").withColumn("admitted", used < max_calls).drop(
        "_micros", "_call", "_block", "_counted", "_opened")


def call_gate(calls: DataFrame, keys: list[str], configured: list[str], max_calls: int = fixed.MAX_RPM,
              window_seconds: int = fixed.RATE_WINDOW_SECONDS, limit: float = fixed.HARD_LIMIT_USD) -> DataFrame:
    """Why each call is refused, or ``OK``: no key for its model, then the rate, then the budget.

    A call without a key takes no place in the window.  The budget is what calls that passed and were
    recorded have cost; a call that the budget refuses has used its place.
    """
    keyed = F.coalesce(F.col("model").isin(configured), F.lit(False))
    bare = calls.filter(~keyed).withColumn("decision", F.lit(fixed.HARD_ERRORS[0]))
    rated = sliding_limiter(calls.filter(keyed), keys, max_calls, window_seconds)
    slow = rated.filter(~F.col("admitted")).drop("admitted").withColumn("decision", F.lit(fixed.HARD_ERRORS[2]))
    paid = budget_admission(rated.filter("admitted").drop("admitted"), keys, limit)
    decision = F.when(F.col("admitted"), "OK").otherwise(fixed.BUDGET_ERROR)
    return bare.unionByName(slow).unionByName(paid.withColumn("decision", decision).drop("admitted", "spent_before"))
