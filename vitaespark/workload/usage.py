"""Registered queries: call metering, budgets and limiters."""

from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.functions import metering as P
from vitaespark.operators import limits, metering
from vitaespark.workload import derive
from vitaespark.workload.registry import query

_PRICE = {
    side: "CASE model " + " ".join(f"WHEN '{m[0]}' THEN cast({m[at]} AS decimal(12,8))" for m in fixed.MODELS) + " END"
    for side, at in (("in", 2), ("out", 3))
}
_COST = (f"cast((cast(prompt_tokens AS decimal(15,0)) * {_PRICE['in']} + cast(completion_tokens AS decimal(15,0))"
         f" * {_PRICE['out']}) * cast(0.001 AS decimal(4,3)) AS decimal(24,9))")
CALLS = (f"calls AS MATERIALIZED (SELECT *, {_COST} AS cost FROM ({derive.as_sql(derive.CALL, 'events')})),"
         " recorded AS MATERIALIZED (SELECT * FROM calls WHERE success AND prompt_tokens IS NOT NULL AND completion_tokens IS NOT NULL)")


def priced(spark, d):
    return metering.priced(derive.calls(spark, d))


def _double(name):
    return F.col(name).cast("double").alias(name)


_ROUTE = "CASE task_type " + " ".join(f"WHEN '{t}' THEN '{m}'" for t, m in fixed.TASK_ROUTING.items()) + " ELSE 'deepseek_lite' END"


@query("usage_route", f"WITH {CALLS} SELECT call_id, {_ROUTE} AS routed FROM calls")
def usage_route(spark, d):
    """U1"""
    return derive.calls(spark, d).select("call_id", P.routed_model(F.col("task_type")).alias("routed"))


_ATTEMPT = {
    "request_id": "cast(floor(event_id / 5) as bigint)",
    "primary": "CASE cast(floor(event_id / 5) as bigint) % 3 WHEN 0 THEN 'deepseek_lite' WHEN 1 THEN 'doubao' ELSE 'deepseek_enhanced' END",
    "slot": "event_id % 5", "event_type": "event_type", "value": "value",
}
_ATTEMPT_COLUMNS = [
    "request_id", "primary",
    "CASE WHEN slot < 3 THEN primary WHEN slot = 3 THEN 'gpt' ELSE CASE request_id % 4 WHEN 0 THEN 'gemini' WHEN 1 THEN"
    " CASE WHEN primary = 'doubao' THEN 'claude' ELSE 'doubao' END ELSE 'claude' END END AS model",
    "CASE WHEN slot < 3 THEN cast(slot + 1 as int) ELSE 1 END AS attempt",
    "event_type = 'purchase' AS success",
    "CASE WHEN event_type = 'purchase' THEN '' WHEN event_type = 'error' THEN 'INSUFFICIENT_BALANCE' WHEN event_type = 'view'"
    " THEN 'HTTP_500' ELSE 'NETWORK_ERROR' END AS error",
]
_CONFIGURED = ["doubao", "gpt", "gemini"]


@query("usage_fallback", f"""
    WITH a AS (SELECT {', '.join(c.replace('primary', '"primary"') for c in _ATTEMPT_COLUMNS)} FROM (
        {derive.as_sql(_ATTEMPT, 'events').replace('AS primary', 'AS "primary"')})),
    own AS (SELECT *, min(CASE WHEN error = 'INSUFFICIENT_BALANCE' THEN attempt END) OVER (PARTITION BY request_id) AS stop
        FROM a WHERE model = "primary" AND attempt <= 3),
    tried AS (SELECT * FROM own WHERE stop IS NULL OR attempt <= stop),
    mine AS (SELECT request_id, min(attempt) FILTER (success) AS won, arg_max(error, attempt) AS last_error FROM tried GROUP BY ALL),
    other AS (SELECT request_id, arg_min(model, rank) AS model FROM (SELECT *, CASE model WHEN 'doubao' THEN 0 WHEN 'gpt' THEN 1
        WHEN 'gemini' THEN 3 END AS rank FROM a WHERE model <> "primary" AND success) WHERE rank IS NOT NULL GROUP BY ALL),
    r AS (SELECT DISTINCT request_id, "primary" FROM a)
    SELECT request_id, CASE WHEN won IS NOT NULL THEN "primary" ELSE other.model END AS used_model,
        won IS NOT NULL OR other.model IS NOT NULL AS success, won IS NULL AND other.model IS NOT NULL AS fell_back,
        CASE WHEN won IS NULL AND other.model IS NULL THEN last_error END AS error
    FROM r LEFT JOIN mine USING (request_id) LEFT JOIN other USING (request_id)""")
def usage_fallback(spark, d):
    """U2"""
    attempts = derive.as_frame(derive.load(spark, d, "events"), _ATTEMPT).selectExpr(*_ATTEMPT_COLUMNS)
    return metering.resolve_fallback(attempts, _CONFIGURED).drop("primary")


@query("usage_retry_schedule", f"""WITH {CALLS}
    SELECT call_id, cast(k AS integer) AS attempt, k * 1.0::double AS delay_seconds
    FROM (SELECT call_id, unnest(range(1, 2 + call_id % 3)) AS k FROM calls WHERE NOT success)""")
def usage_retry_schedule(spark, d):
    """U3"""
    failed = derive.calls(spark, d).filter(~F.col("success")).select("call_id")
    return metering.retry_schedule(failed, (1 + F.col("call_id") % 3).cast("int"))


@query("usage_cost", f"WITH {CALLS} SELECT call_id, cast(cost AS double) AS cost FROM calls")
def usage_cost(spark, d):
    """U4"""
    return priced(spark, d).select("call_id", _double("cost"))


_USAGE = """count(*) AS calls, cast(sum(prompt_tokens) + sum(completion_tokens) AS bigint) AS tokens,
    cast(sum(prompt_tokens) AS bigint) AS prompt_tokens, cast(sum(completion_tokens) AS bigint) AS completion_tokens,
    cast(sum(cost) AS double) AS cost, round(sum(latency_ms), 3) AS latency_total"""


@query("usage_by_model", f"""WITH {CALLS}
    SELECT model, {_USAGE}, round_even(sum(latency_ms) / count(*), 1) AS avg_latency_ms,
        '$' || cast(cast(sum(cost) AS decimal(24,4)) AS string) AS cost_display FROM recorded GROUP BY model""")
def usage_by_model(spark, d):
    """U5"""
    return metering.usage_by_model(priced(spark, d)).withColumns({
        "cost": F.col("cost").cast("double"), "latency_total": F.round("latency_total", 3)})


@query("usage_with_totals", f"""WITH {CALLS}
    SELECT CASE WHEN grouping(model) = 1 THEN 'ALL' ELSE model END AS model, {_USAGE} FROM recorded GROUP BY ROLLUP (model)""")
def usage_with_totals(spark, d):
    """U6"""
    return metering.usage_with_totals(priced(spark, d)).withColumns({
        "cost": F.col("cost").cast("double"), "latency_total": F.round("latency_total", 3)})


def _latency_sql(key):
    return f"""s AS (SELECT {key} AS k, list_sort(list(latency_ms)) AS l FROM recorded GROUP BY 1),
    latency AS (SELECT k, round_even(list_avg(l), 1) AS avg, l[1] AS min, l[-1] AS max, len(l)::bigint AS count,
        CASE WHEN len(l) >= 20 THEN l[(len(l) * 95 // 100) + 1] ELSE l[-1] END AS p95 FROM s)"""


@query("usage_latency", f"WITH {CALLS}, {_latency_sql('model')} SELECT k AS model, * EXCLUDE (k) FROM latency")
def usage_latency(spark, d):
    """U7"""
    return metering.latency_stats(derive.calls(spark, d), ["model"])


@query("usage_latency_by_tenant", f"WITH {CALLS}, {_latency_sql('tenant')} SELECT k AS tenant, * EXCLUDE (k) FROM latency")
def usage_latency_by_tenant(spark, d):
    """U7 with many small groups"""
    return metering.latency_stats(derive.calls(spark, d), ["tenant"])


@query("usage_balance_alerts", f"""WITH {CALLS}
    SELECT model, cast(sum(cost) AS double) AS cost FROM recorded GROUP BY model HAVING sum(cost) >= 1.0""")
def usage_balance_alerts(spark, d):
    """U8"""
    return metering.balance_alerts(priced(spark, d)).select("model", _double("cost"))


@query("usage_total_alert", f"""WITH {CALLS}
    SELECT count(*) AS calls, cast(sum(cost) AS double) AS cost, sum(cost) > 1.0 AS alert FROM recorded""")
def usage_total_alert(spark, d):
    """U8 over all models"""
    return metering.total_alert(priced(spark, d)).select("calls", _double("cost"), "alert")


_RUNNING = "sum(cost) OVER ({0}ORDER BY ts, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND {1})"


@query("budget_status", f"""WITH {CALLS}, r AS (SELECT call_id, {_RUNNING.format('', 'CURRENT ROW')} AS spent FROM recorded)
    SELECT call_id, cast(spent AS double) AS spent, spent < 10.0 AS ok, spent >= 1.0 AS alert FROM r""")
def budget_status(spark, d):
    """U9, one budget for all calls"""
    return metering.budget_status(priced(spark, d), []).select("call_id", _double("spent"), "ok", "alert")


@query("budget_status_by_tenant", f"""WITH {CALLS},
    r AS (SELECT call_id, {_RUNNING.format('PARTITION BY tenant ', 'CURRENT ROW')} AS spent FROM recorded)
    SELECT call_id, cast(spent AS double) AS spent, spent < 0.2 AS ok, spent >= 0.05 AS alert FROM r""")
def budget_status_by_tenant(spark, d):
    """U9, one budget per tenant"""
    return metering.budget_status(priced(spark, d), ["tenant"], alert=0.05, limit=0.2).select(
        "call_id", _double("spent"), "ok", "alert")


@query("budget_admission", f"""WITH {CALLS},
    b AS (SELECT call_id, tenant, ts, CASE WHEN call_id IN (SELECT call_id FROM recorded) THEN cost ELSE 0 END AS cost FROM calls),
    r AS (SELECT call_id, tenant, coalesce({_RUNNING.format('PARTITION BY tenant ', '1 PRECEDING')}, 0) AS before FROM b),
    f AS (SELECT tenant, min(before) AS final FROM r WHERE before >= 0.2 GROUP BY tenant)
    SELECT call_id, cast(least(before, coalesce(final, before)) AS double) AS spent_before, before < 0.2 AS admitted
    FROM r LEFT JOIN f USING (tenant)""")
def budget_admission(spark, d):
    """U10"""
    return metering.budget_admission(priced(spark, d), ["tenant"], limit=0.2).select(
        "call_id", _double("spent_before"), "admitted")


DAY = 86_400
_ORDERED = """o AS MATERIALIZED (SELECT call_id, tenant, success AND prompt_tokens IS NOT NULL AND completion_tokens IS NOT NULL AS success,
    epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY tenant ORDER BY ts, call_id) AS n FROM calls)"""


@query("limit_sliding", f"""WITH RECURSIVE {CALLS}, {_ORDERED},
    s(call_id, tenant, n, admitted, kept) AS (
        SELECT call_id, tenant, n, true, [us] FROM o WHERE n = 1
        UNION ALL
        SELECT call_id, tenant, n, len(live) < 2, CASE WHEN len(live) < 2 THEN list_append(live, us) ELSE live END
        FROM (SELECT o.*, list_filter(s.kept, lambda x: o.us - x < {DAY}000000) AS live FROM s JOIN o
            ON o.tenant = s.tenant AND o.n = s.n + 1))
    SELECT call_id, tenant, admitted FROM s""")
def limit_sliding(spark, d):
    """Two calls a day per tenant, so that the limit bites."""
    return limits.sliding_limiter(derive.calls(spark, d), ["tenant"], 2, DAY).select("call_id", "tenant", "admitted")


@query("limit_fixed_window", f"""WITH RECURSIVE {CALLS}, {_ORDERED},
    s(call_id, tenant, n, admitted, until, used) AS (
        SELECT call_id, tenant, n, true, us + {DAY}000000, success::int FROM o WHERE n = 1
        UNION ALL
        SELECT call_id, tenant, n, before < 2, ends, before + CASE WHEN before < 2 AND success THEN 1 ELSE 0 END
        FROM (SELECT o.*, CASE WHEN o.us >= s.until THEN 0 ELSE s.used END AS before,
            CASE WHEN o.us >= s.until THEN o.us + {DAY}000000 ELSE s.until END AS ends FROM s JOIN o
            ON o.tenant = s.tenant AND o.n = s.n + 1))
    SELECT call_id, tenant, admitted FROM s""")
def limit_fixed_window(spark, d):
    """U12"""
    return limits.fixed_window_limiter(derive.calls(spark, d), ["tenant"], 2, DAY).select("call_id", "tenant", "admitted")


@query("call_gate", f"""WITH RECURSIVE {CALLS},
    o AS MATERIALIZED (SELECT call_id, tenant, ts, cost, epoch_us(ts) AS us, row_number() OVER (PARTITION BY tenant ORDER BY ts, call_id) AS n
        FROM calls WHERE model IN ('gpt', 'claude', 'doubao')),
    s(call_id, tenant, n, admitted, kept) AS (
        SELECT call_id, tenant, n, true, [us] FROM o WHERE n = 1
        UNION ALL
        SELECT call_id, tenant, n, len(live) < 2, CASE WHEN len(live) < 2 THEN list_append(live, us) ELSE live END
        FROM (SELECT o.*, list_filter(s.kept, lambda x: o.us - x < {DAY}000000) AS live FROM s JOIN o
            ON o.tenant = s.tenant AND o.n = s.n + 1)),
    p AS (SELECT o.call_id, o.tenant, o.ts, CASE WHEN r.call_id IS NULL THEN 0 ELSE o.cost END AS cost FROM s JOIN o USING (call_id)
        LEFT JOIN recorded r USING (call_id) WHERE admitted),
    b AS (SELECT call_id, coalesce({_RUNNING.format('PARTITION BY tenant ', '1 PRECEDING')}, 0) < 0.1 AS ok FROM p)
    SELECT c.call_id, c.tenant, CASE WHEN s.call_id IS NULL THEN 'API_KEY_MISSING' WHEN NOT s.admitted THEN 'RATE_LIMITED'
        WHEN NOT b.ok THEN 'BUDGET_EXCEEDED' ELSE 'OK' END AS decision
    FROM calls c LEFT JOIN s USING (call_id) LEFT JOIN b USING (call_id)""")
def call_gate(spark, d):
    """The gate in front of the models: key, rate (two calls a day per tenant), budget."""
    return limits.call_gate(priced(spark, d), ["tenant"], ["gpt", "claude", "doubao"], 2, DAY, 0.1).select("call_id", "tenant", "decision")


@query("limit_offered_load", f"""WITH {CALLS}, u AS (SELECT *, epoch_us(ts) AS us FROM calls),
    c AS (SELECT call_id, count(*) OVER (ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS current FROM u)
    SELECT call_id, current, greatest(0, 30 - current) AS remaining FROM c""")
def limit_offered_load(spark, d):
    """U13, all calls together, per hour"""
    return metering.offered_load(derive.calls(spark, d), [], 30, 3600).select("call_id", "current", "remaining")


@query("load_tumbling", f"""WITH {CALLS}
    SELECT epoch_us(time_bucket(INTERVAL 1 MINUTE, ts)) AS window_start, count(*) AS calls,
        cast(sum(prompt_tokens) AS bigint) AS prompt_tokens, count(*) FILTER (NOT success) AS failures FROM calls GROUP BY ALL""")
def load_tumbling(spark, d):
    """U14"""
    return _windows(metering.load_per_window(derive.calls(spark, d)))


@query("load_sliding", f"""WITH {CALLS}, w AS (SELECT *, unnest(range(0, 6)) AS k FROM calls)
    SELECT epoch_us(time_bucket(INTERVAL 10 SECOND, ts)) - k * 10000000 AS window_start, count(*) AS calls,
        cast(sum(prompt_tokens) AS bigint) AS prompt_tokens, count(*) FILTER (NOT success) AS failures FROM w GROUP BY ALL""")
def load_sliding(spark, d):
    """U14"""
    return _windows(metering.load_per_window(derive.calls(spark, d), slide="10 seconds"))


def _windows(df):
    return df.select(F.unix_micros(F.col("window_start").cast("timestamp")).alias("window_start"), "calls", "prompt_tokens", "failures")


@query("usage_status", f"""WITH {CALLS}, {_latency_sql('tenant')}, u AS (SELECT *, epoch_us(ts) AS us FROM calls),
    t AS (SELECT tenant, {_USAGE}, sum(cost) AS spent FROM recorded GROUP BY tenant), n AS (SELECT tenant, max(us) AS now FROM u GROUP BY tenant),
    r AS (SELECT tenant, count(*) AS current FROM u JOIN n USING (tenant) WHERE u.us > n.now - 86400000000 GROUP BY tenant)
    SELECT r.tenant, t.calls, tokens, latency.avg, latency.max, p95, current, greatest(0, 3 - current) AS remaining,
        round_even(coalesce(cost, 0), 4) AS total_spent, coalesce(spent, 0) < 10 AS budget_ok, coalesce(spent, 0) >= 1 AS budget_alert,
        'claude|gpt' AS models_available, 'deepseek_lite' AS default_model
    FROM r LEFT JOIN t USING (tenant) LEFT JOIN latency ON latency.k = r.tenant""")
def usage_status(spark, d):
    """U15"""
    report = metering.status_report(priced(spark, d), ["tenant"], 3, 86_400, ["gpt", "claude"])
    return report.select(
        "tenant", "calls", "tokens", "avg", "max", "p95", "current", "remaining", _double("total_spent"), "budget_ok", "budget_alert",
        F.array_join("models_available", "|").alias("models_available"), "default_model")


@query("usage_catalogue", f"""WITH {CALLS}, m(name, id, tier, provider, cost_per_1k) AS (VALUES {', '.join(
    f"('{m[0]}', '{m[1]}', '{m[4]}', '{m[5]}', '${float(m[2]):.4f} / ${float(m[3]):.4f}')" for m in fixed.MODELS)})
    SELECT m.*, name IN ('gpt', 'claude') AS configured, coalesce(n, 0) AS calls
    FROM m LEFT JOIN (SELECT model, count(*) AS n FROM calls GROUP BY model) ON model = name""")
def usage_catalogue(spark, d):
    """U16 with the calls each model got"""
    used = derive.calls(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    table = metering.catalogue(spark, ["gpt", "claude"])
    return table.join(used, table["name"] == used["model"], "left").withColumn("calls", F.coalesce("n", F.lit(0))).drop("model", "n")
