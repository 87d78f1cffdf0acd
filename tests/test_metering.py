import datetime as dt
import random

from pyspark.sql import functions as F

from vitaespark.functions import metering as P
from vitaespark.operators import limits, metering, ordered

START = dt.datetime(2024, 1, 1)
CALL = ("call_id bigint, tenant bigint, ts timestamp, model string, success boolean, prompt_tokens bigint, "
        "completion_tokens bigint, latency_ms double, cost decimal(24,9)")


def calls(spark, rows):
    """rows: (second, tenant, model, success, prompt, completion, latency, cost)"""
    from decimal import Decimal

    return spark.createDataFrame(
        [(i, t, START + dt.timedelta(seconds=s), m, ok, p, c, float(lat), Decimal(str(cost)))
         for i, (s, t, m, ok, p, c, lat, cost) in enumerate(rows)], CALL)


def at(spark, seconds, tenant=1):
    return calls(spark, [(s, tenant, "gpt", True, 1, 1, 1, 0.003) for s in seconds])


THREE = [(0, 1, "deepseek-chat", True, 500, 200, 1200, 0.00015), (1, 1, "deepseek-chat", True, 300, 150, 800, 0.0001),
         (2, 1, "gpt-4o", True, 1000, 500, 2500, 0.0075)]


def test_usage(spark):
    rows = {r.model: r for r in metering.usage_by_model(calls(spark, THREE)).collect()}
    chat = rows["deepseek-chat"]
    assert (chat.calls, chat.tokens, float(chat.cost), chat.avg_latency_ms) == (2, 1150, 0.00025, 1000.0)
    assert (rows["gpt-4o"].calls, rows["gpt-4o"].tokens) == (1, 1500)
    total = {r.model: r for r in metering.usage_with_totals(calls(spark, THREE)).collect()}["ALL"]
    assert (total.calls, total.tokens, float(total.cost)) == (3, 2650, 0.00775)


def test_latency(spark):
    row = metering.latency_stats(calls(spark, THREE), ["tenant"]).first()
    assert (row.avg, row.min, row.max, row.p95, row["count"]) == (1500.0, 800, 2500, 2500, 3)
    hundred = calls(spark, [(i, 1, "m", True, 1, 1, (i * 37) % 100, 0) for i in range(100)])
    for blocks in (1, 7, None):
        assert metering.latency_stats(hundred, ["tenant"], blocks).first().p95 == 95
    twenty = calls(spark, [(i, 1, "m", True, 1, 1, i, 0) for i in range(20)])
    assert metering.latency_stats(twenty, ["tenant"]).first().p95 == 19


def test_budget(spark):
    rows = calls(spark, [(i, 1, "m", True, 1, 1, 1, c) for i, c in enumerate((0.003, 0.004, 0.01, 0.01))])
    status = metering.budget_status(rows, ["tenant"], 0.005, 0.02).orderBy("call_id").collect()
    assert [float(r.spent) for r in status] == [0.003, 0.007, 0.017, 0.027]
    assert [r.ok for r in status] == [True, True, True, False]
    assert [r.alert for r in status] == [False, True, True, True]
    same = calls(spark, [(i, 1, "m", True, 1, 1, 1, 0.01) for i in range(4)])
    admitted = metering.budget_admission(same, ["tenant"], 0.02).orderBy("call_id").collect()
    assert [r.admitted for r in admitted] == [True, True, False, False]


def test_cost_and_route(spark):
    row = spark.range(1).select(
        P.call_cost(F.lit("gpt"), F.lit(1000), F.lit(500)).alias("gpt"),
        P.call_cost(F.lit("deepseek-chat"), F.lit(1), F.lit(0)).alias("lite"),
        P.routed_model(F.lit("interview")).alias("a"), P.routed_model(F.lit("?")).alias("b"),
        P.routed_model(F.lit("?"), "nobody").alias("c")).first()
    assert (float(row.gpt), float(row.lite)) == (0.0075, 0.00000014)
    assert (row.a, row.b, row.c) == ("deepseek_enhanced", "deepseek_lite", "deepseek_lite")


def test_fallback(spark):
    rows = [
        (1, "gpt", "gpt", 1, False, "HTTP_500"), (1, "gpt", "gpt", 2, True, ""),
        (2, "gpt", "gpt", 1, False, "RATE_LIMITED"), (2, "gpt", "gpt", 2, True, ""), (2, "gpt", "claude", 1, True, ""),
        (2, "gpt", "gemini", 1, True, ""),
        (3, "gpt", "gpt", 1, False, "A"), (3, "gpt", "gpt", 3, False, "C"), (3, "gpt", "gpt", 4, True, ""),
    ]
    df = spark.createDataFrame(rows, "request_id int, primary string, model string, attempt int, success boolean, error string")
    got = {r.request_id: r for r in metering.resolve_fallback(df).collect()}
    assert (got[1].used_model, got[1].fell_back) == ("gpt", False)
    assert (got[2].used_model, got[2].fell_back) == ("claude", True)
    assert (got[3].used_model, got[3].error) == (None, "C")
    assert {r.request_id: r.used_model for r in metering.resolve_fallback(df, ["gemini"]).collect()}[2] == "gemini"


def test_retry_schedule(spark):
    rows = metering.retry_schedule(spark.range(1), F.lit(3)).orderBy("attempt").collect()
    assert [(r.attempt, r.delay_seconds) for r in rows] == [(1, 1.0), (2, 2.0), (3, 3.0)]


def admitted(df):
    return [r.admitted for r in df.orderBy("ts", "call_id").collect()]


def test_sliding_limiter(spark):
    assert admitted(limits.sliding_limiter(at(spark, [0] * 7), ["tenant"], 5)) == [True] * 5 + [False] * 2
    # a call exactly one window later no longer sees the first one
    assert admitted(limits.sliding_limiter(at(spark, [0, 59, 60]), ["tenant"], 1)) == [True, False, True]


def plain_sliding(seconds, most, window):
    kept, out = [], []
    for now in seconds:
        kept = [t for t in kept if now - t < window]
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(now)
    return out


def plain_fixed(seconds, oks, most, window):
    until, used, out = None, 0, []
    for now, ok in zip(seconds, oks):
        if until is None or now >= until:
            until, used = now + window, 0
        out.append(used < most)
        used += out[-1] and ok
    return out


def test_limiters_against_plain_python(spark):
    rng = random.Random(3)
    rows = []
    for tenant in range(4):
        now = 0
        for _ in range(150):
            now += rng.choice([0, 0, 1, 3, 10, 30, 70, 400])
            rows.append((now, tenant, "m", rng.random() < 0.7, 1, 1, 1, 0))
    df = calls(spark, rows)
    for most, blocks in ((1, None), (2, 13), (5, 40)):
        got = limits.sliding_limiter(df, ["tenant"], most, blocks=blocks).orderBy("ts", "call_id").collect()
        fixed = limits.fixed_window_limiter(df, ["tenant"], most, blocks=blocks).orderBy("ts", "call_id").collect()
        assert len(got) == len(fixed) == len(rows)
        for tenant in range(4):
            mine = [r for r in rows if r[1] == tenant]
            seconds, oks = [r[0] for r in mine], [r[3] for r in mine]
            assert [r.admitted for r in got if r.tenant == tenant] == plain_sliding(seconds, most, 60)
            assert [r.admitted for r in fixed if r.tenant == tenant] == plain_fixed(seconds, oks, most, 60)


def test_offered_load(spark):
    rows = metering.offered_load(at(spark, [0, 60, 60, 119]), ["tenant"], 3).orderBy("call_id").collect()
    assert [(r.current, r.remaining) for r in rows] == [(1, 2), (2, 1), (2, 1), (3, 0)]


def test_blocked_computations_equal_plain_ones(spark):
    rng = random.Random(9)
    data = [(i, rng.choice([None, 1, 1, 1, 2]), rng.randint(0, 500), rng.randint(1, 9)) for i in range(600)]
    df = spark.createDataFrame(data, "id int, k int, at bigint, v bigint")
    for blocks in (1, 7, 40):
        sums = ordered.running(df, ["k"], ["at", "id"], F.col("v"), "s", blocks=blocks).collect()
        counts = ordered.trailing_count(df, ["k"], "at", 20, "n", blocks=blocks).collect()
        middle = ordered.value_at_rank(df, ["k"], "at", lambda n: F.floor(n / 2) + 1, "m", blocks).collect()
        assert len(sums) == len(counts) == 600 and len(middle) == 3
        for key in (None, 1, 2):
            mine = sorted(((a, i, v) for i, k, a, v in data if k == key))
            total, want = 0, {}
            for a, i, v in mine:
                total += v
                want[i] = total
            assert {r.id: r.s for r in sums if r.k == key} == want
            assert {r.id: r.n for r in counts if r.k == key} == {
                i: sum(a - 20 < b <= a for b, _, _ in mine) for a, i, _ in mine}
            assert [r.m for r in middle if r.k == key] == [mine[len(mine) // 2][0]]


def test_status_and_catalogue(spark):
    row = metering.status_report(calls(spark, THREE), ["tenant"], 5).first()
    assert (row.calls, row.current, row.remaining, row.p95) == (3, 3, 2, 2500)
    table = {r.name: r for r in metering.catalogue(spark, ["gpt"]).collect()}
    assert table["gpt"].configured and not table["doubao"].configured
    assert table["gpt"].cost_per_1k == "$0.0025 / $0.0100"
