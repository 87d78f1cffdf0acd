"""One key with nearly all rows: every block stays small and results stay those of a plain walk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitaespark.operators import documents, limits, metering, ordered

BLOCKS, ROWS = 40, 60_000


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy("_block").count().collect()]
    return max(sizes) / sum(sizes)


@pytest.fixture(scope="module")
def overload(spark):
    """One tenant that calls two to four times a second without a break, all others hardly."""
    rows = spark.range(ROWS).select(
        F.col("id").alias("call_id"), F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(100).alias("tenant"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 333_333 + F.pmod(F.xxhash64("id"), F.lit(200_000))).alias("ts"),
        (F.xxhash64("id") % 3 != 0).alias("success"), F.lit(1).cast("long").alias("prompt_tokens"), F.lit(1).cast("long").alias("completion_tokens"),
        F.lit(0.001).cast("decimal(24,9)").alias("cost"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_003)).cast("double").alias("latency_ms"))
    return rows.cache()


def by_tenant(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.ts, r.call_id)):
        out.setdefault(r.tenant, []).append(r)
    return out


def test_blocks_cut_a_hot_key_and_ties(spark, overload):
    cut = ordered.in_blocks(overload, ["tenant"], ["ts", "call_id"], BLOCKS)
    assert cut.count() == ROWS and largest_share(cut) < 0.05
    tied = spark.range(20_000).selectExpr("1 AS k", "7 AS at", "id")
    assert largest_share(ordered.in_blocks(tied, ["k"], ["at", "id"], BLOCKS)) < 0.05


def plain_sliding(times, most, window):
    kept, out = [], []
    for now in times:
        kept = [t for t in kept[-most:] if now - t < window]
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(now)
    return out


def plain_fixed(times, counts, most, window):
    until, used, out = None, 0, []
    for now, one in zip(times, counts):
        if until is None or now >= until:
            until, used = now + window, 0
        out.append(used < most)
        used += out[-1] and one
    return out


def test_limiters_under_unbroken_overload(overload):
    got = by_tenant(limits.sliding_limiter(overload, ["tenant"], 30, blocks=BLOCKS).collect())
    fixed = by_tenant(limits.fixed_window_limiter(overload, ["tenant"], 30, blocks=BLOCKS).collect())
    assert sum(map(len, got.values())) == sum(map(len, fixed.values())) == ROWS
    for tenant, rows in got.items():
        times = [int(r.ts.timestamp() * 1e6 + 0.5) for r in rows]
        assert [r.admitted for r in rows] == plain_sliding(times, 30, 60_000_000)
        assert [r.admitted for r in fixed[tenant]] == plain_fixed(times, [r.success for r in rows], 30, 60_000_000)
    assert not all(r.admitted for r in got[100]) and all(r.admitted for r in got[1])


def test_limiters_keep_a_phase_through_all_blocks(spark):
    """Calls once a second: what is admitted depends on the very first call, through every block."""
    rows = spark.range(4000).selectExpr("id AS call_id", "1 AS tenant", "timestamp_seconds(1700000007 + id) AS ts", "true AS success",
                                        "1L AS prompt_tokens", "1L AS completion_tokens")
    for limiter, plain in ((limits.sliding_limiter, lambda t: plain_sliding(t, 7, 60)),
                           (limits.fixed_window_limiter, lambda t: plain_fixed(t, [True] * len(t), 7, 60))):
        got = limiter(rows, ["tenant"], 7, blocks=9).orderBy("call_id").collect()
        assert [r.admitted for r in got] == plain(list(range(4000)))


def test_admit_equals_a_plain_walk():
    rng = np.random.default_rng(4)
    for most in (1, 2, 5, 40):
        for spread in (1, 5, 60):
            times = np.cumsum(rng.choice([0, 0, 1, spread, spread * 9], 400))
            assert limits.admit(times, 60, most).tolist() == plain_sliding(times.tolist(), most, 60)


def test_limiters_on_odd_rows(spark):
    schema = "call_id bigint, tenant bigint, ts timestamp, success boolean, prompt_tokens bigint, completion_tokens bigint, _at_ string"
    rows = spark.createDataFrame([(1, None, None, True, 1, 1, "x"), (2, None, None, True, 1, 1, "x"), (3, 5, None, True, 1, 1, "x")], schema)
    for limiter in (limits.sliding_limiter, limits.fixed_window_limiter):
        assert [r.admitted for r in limiter(rows, ["tenant"], 1).orderBy("call_id").collect()] == [True, False, True]
        assert limiter(rows.limit(0), ["tenant"], 1).collect() == []
        assert [r.admitted for r in limiter(rows, [], 1).orderBy("call_id").collect()] == [True, False, False]


def test_budgets_and_load_of_a_hot_key(overload):
    rows = by_tenant(metering.budget_admission(overload, ["tenant"], 10, BLOCKS).collect())
    load = by_tenant(metering.offered_load(overload, ["tenant"], 30, 60, BLOCKS).collect())
    for tenant, mine in rows.items():
        spent = np.cumsum([0] + [int(r.success) for r in mine])
        assert [r.admitted for r in mine] == (spent[:-1] < 10_000).tolist()
        assert [round(float(r.spent_before) * 1000) for r in mine] == np.minimum(spent[:-1], 10_000).tolist()
        times = np.array([int(r.ts.timestamp() * 1e6 + 0.5) for r in load[tenant]])
        assert [r.current for r in load[tenant]] == (np.arange(1, len(times) + 1) - np.searchsorted(times, times - 60_000_000, "right")).tolist()


def test_order_statistics_without_a_width(spark, overload):
    got = {r.tenant: r for r in metering.latency_stats(overload, ["tenant"], BLOCKS).collect()}
    for tenant, mine in by_tenant(metering.recorded(overload).collect()).items():
        values = sorted(r.latency_ms for r in mine)
        assert got[tenant].p95 == values[min(len(values) * 95 // 100, len(values) - 1)]
    # positions whose gaps span twelve orders of magnitude
    at = np.cumsum(np.random.default_rng(1).choice([1, 2, 1e3, 1e12], 3000, p=[0.5, 0.3, 0.19, 0.01]))
    df = spark.createDataFrame([(1, float(x)) for x in at], "k int, at double")
    gaps = np.diff(at)
    limit = max(3 * sorted(gaps)[len(gaps) // 2], 30)
    got = [r.cluster_id for r in documents.gap_clusters(df, ["k"], "at", blocks=BLOCKS).orderBy("at").collect()]
    assert got == np.concatenate([[0], np.cumsum(gaps > limit)]).tolist()
