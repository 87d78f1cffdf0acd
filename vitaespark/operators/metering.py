"""Call-log operators: usage, latency, alerts, budgets, load, fall-back, status.

A call is ``call_id, tenant, ts, model, success, prompt_tokens, completion_tokens,
latency_ms, cost``.  Aggregates combine before the shuffle; running figures and order
statistics go through ``ordered`` so that one busy tenant or model does not end up in
one task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.functions import metering as P
from vitaespark.operators import ordered


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def priced(calls: DataFrame) -> DataFrame:
    """U4."""
    return calls.withColumn(
        "cost", P.call_cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens")))


def is_recorded() -> Column:
    """Whether a call counts for usage, cost and latency: it succeeded and reports its tokens."""
    told = F.col("prompt_tokens").isNotNull() & F.col("completion_tokens").isNotNull()
    return F.coalesce(F.col("success"), F.lit(False)) & told


def recorded(calls: DataFrame) -> DataFrame:
    """The calls that U5 to U9 and U15 measure; load and limits look at all calls."""
    return calls.filter(is_recorded())


def _usage() -> list[Column]:
    tokens = F.sum("prompt_tokens") + F.sum("completion_tokens")
    return [
        F.count(F.lit(1)).alias("calls"), tokens.alias("tokens"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("cost").alias("cost"), F.sum("latency_ms").alias("latency_total"),
    ]


def usage_by_model(calls: DataFrame) -> DataFrame:
    """U5."""
    return recorded(calls).groupBy("model").agg(*_usage()).withColumns({
        "avg_latency_ms": F.bround(F.col("latency_total") / F.col("calls"), 1),
        "cost_display": P.usd(F.col("cost")),
    })


def usage_with_totals(calls: DataFrame) -> DataFrame:
    """The per-model rows and a total row marked ``ALL``."""
    rolled = recorded(calls).rollup("model").agg(*_usage(), F.grouping("model").alias("_all"))
    return rolled.withColumn("model", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("model"))).drop("_all")


def latency_stats(calls: DataFrame, keys: list[str], blocks: int | None = None) -> DataFrame:
    """Average, extremes, count and the 95 % latency (nearest rank from 20 calls up, else the maximum)."""
    calls = recorded(calls)
    basic = calls.groupBy(*keys).agg(
        F.bround(F.avg("latency_ms"), 1).alias("avg"), F.min("latency_ms").alias("min"),
        F.max("latency_ms").alias("max"), F.count(F.lit(1)).alias("count"),
    )
    # floor(n * 95 / 100) on whole numbers; the last value when it would run past the end
    rank = lambda n: F.least(F.floor(n * 95 / 100) + 1, n)
    high = ordered.value_at_rank(calls, keys, "latency_ms", rank, "_p95", blocks).drop("n")
    return ordered.join_null_safe(basic, high, keys).withColumn(
        "p95", F.when(F.col("count") >= fixed.P95_MIN_RECORDS, F.col("_p95")).otherwise(F.col("max"))
    ).drop("_p95")


def balance_alerts(calls: DataFrame, threshold: float = fixed.ALERT_USD) -> DataFrame:
    """U8: models whose summed cost has reached the threshold."""
    spent = recorded(calls).groupBy("model").agg(F.sum("cost").alias("cost"))
    return spent.filter(F.col("cost") >= F.lit(str(threshold)).cast(P.MONEY))


def total_alert(calls: DataFrame, threshold: float = fixed.ALERT_USD) -> DataFrame:
    """U8 over all models: one row with the total cost and whether it is above the threshold."""
    total = recorded(calls).agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("cost"), F.lit(0)).cast(P.MONEY).alias("cost"))
    return total.withColumn("alert", F.col("cost") > _usd(threshold))


def _usd(amount: float) -> Column:
    return F.lit(str(amount)).cast(P.MONEY)


def budget_status(calls: DataFrame, keys: list[str], alert: float = fixed.ALERT_USD,
                  limit: float = fixed.HARD_LIMIT_USD, blocks: int | None = None) -> DataFrame:
    """Cost so far after each recorded call, whether it is below the limit and whether it raises an alert."""
    spent = ordered.running(recorded(calls), keys, ["ts", "call_id"], F.col("cost"), "spent", blocks=blocks)
    return spent.withColumns({
        "ok": F.col("spent") < _usd(limit), "alert": F.col("spent") >= _usd(min(alert, limit)),
    })


def budget_admission(calls: DataFrame, keys: list[str], limit: float = fixed.HARD_LIMIT_USD,
                     blocks: int | None = None) -> DataFrame:
    """A call passes while what passed before it has cost less than the limit; costs are not negative.

    Only recorded calls cost anything.  Costs never fall, so from the first refused call of a key on all are
    refused, and the cost stays what it was there; a key's blocks learn it from the first one that refuses.
    """
    cost = F.when(is_recorded(), F.col("cost")).otherwise(F.lit(0).cast(P.MONEY))
    cut = ordered.in_blocks(calls, keys, ["ts", "call_id"], blocks)
    before = ordered.running(cut, keys, ["ts", "call_id"], cost, "spent_before", inclusive=False).withColumn(
        "admitted", F.col("spent_before") < _usd(limit))
    final = before.filter(~F.col("admitted")).groupBy(*keys).agg(F.min("spent_before").alias("_final"))
    spent = F.when(F.col("admitted"), F.col("spent_before")).otherwise(F.col("_final"))
    return ordered.with_key_values(before, final, keys).withColumn("spent_before", spent).drop("_final", "_block")


def offered_load(calls: DataFrame, keys: list[str], max_calls: int = fixed.MAX_RPM,
                 window_seconds: int = fixed.RATE_WINDOW_SECONDS, blocks: int | None = None) -> DataFrame:
    """Calls in the trailing window and the room left below the limit."""
    counted = ordered.trailing_count(
        calls.withColumn("_micros", micros()), keys, "_micros", window_seconds * 1_000_000, "current", blocks=blocks)
    return counted.drop("_micros").withColumn(
        "remaining", F.greatest(F.lit(0), F.lit(max_calls) - F.col("current")))


def load_per_window(calls: DataFrame, width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Calls, tokens and failures per window; works on a table and on a stream."""
    window = F.window(F.col("ts"), width, slide) if slide else F.window(F.col("ts"), width)
    return (
        calls.groupBy(window.alias("w")).agg(
            F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
            F.count_if(~F.col("success")).alias("failures"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "calls", "prompt_tokens", "failures")
    )


def resolve_fallback(attempts: DataFrame, configured: list[str] | None = None,
                     max_tries: int = fixed.MAX_TRIES) -> DataFrame:
    """Who answered each request, from ``request_id, primary, model, attempt, success, error``.

    The primary model is tried up to ``max_tries`` times and given up at once on a hard
    error; then the chain goes on in order.  Everything is one combining aggregate.
    """
    chain = [m for m in fixed.FALLBACK_CHAIN if configured is None or m in configured]
    own = (F.col("model") == F.col("primary")) & (F.col("attempt") <= max_tries)
    rank = P.lookup(F.col("model"), {m: i for i, m in enumerate(chain)})
    other = (F.col("model") != F.col("primary")) & rank.isNotNull()
    failed = F.struct("attempt", "error")
    found = attempts.groupBy("request_id", "primary").agg(
        F.min(F.when(own & F.col("success"), F.col("attempt"))).alias("won"),
        F.min(F.when(own & F.col("error").isin(fixed.HARD_ERRORS), failed)).alias("hard"),
        F.max(F.when(own & ~F.col("success"), failed)).alias("last"),
        F.min(F.when(other & F.col("success"), F.struct(rank.alias("rank"), F.col("model")))).alias("next"),
    )
    primary_won = F.col("won").isNotNull() & (F.col("hard").isNull() | (F.col("won") < F.col("hard.attempt")))
    return found.select(
        "request_id", "primary",
        F.when(primary_won, F.col("primary")).otherwise(F.col("next.model")).alias("used_model"),
        (primary_won | F.col("next").isNotNull()).alias("success"),
        (~primary_won & F.col("next").isNotNull()).alias("fell_back"),
        F.when(~primary_won & F.col("next").isNull(), F.coalesce("hard.error", "last.error")).alias("error"),
    )


def retry_schedule(failures: DataFrame, tries: Column, base: float = fixed.RETRY_BASE_SECONDS) -> DataFrame:
    """One row per attempt with the wait before the next one."""
    return failures.withColumn("attempt", F.explode(F.sequence(F.lit(1), tries))).withColumn(
        "delay_seconds", P.retry_delay(F.col("attempt"), base))


def status_report(calls: DataFrame, keys: list[str], max_calls: int = fixed.MAX_RPM,
                  window_seconds: int = fixed.RATE_WINDOW_SECONDS, configured: list[str] | None = None) -> DataFrame:
    """Usage, latency, current load, spending, models and default model per key at its latest call.

    Load counts all calls, everything else the recorded ones.  Per key and second the calls are counted
    first; only the second in which the window begins is looked at call by call.
    """
    window, second = window_seconds * 1_000_000, 1_000_000
    usage = recorded(calls).groupBy(*keys).agg(*_usage())
    timed = calls.select(*keys, micros().alias("_at"))
    seconds = timed.groupBy(*keys, F.floor(F.col("_at") / second).alias("_second")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_at").alias("_last"))
    now = seconds.groupBy(*keys).agg(F.max("_last").alias("_now"))
    edge = F.floor((F.col("_now") - window) / second)
    whole = ordered.join_null_safe(seconds, now, keys).groupBy(*keys, "_now").agg(
        F.coalesce(F.sum(F.when(F.col("_second") > edge, F.col("_n"))), F.lit(0)).alias("_whole"))
    part = (
        ordered.join_null_safe(
            timed.withColumn("_second", F.floor(F.col("_at") / second)), now.withColumn("_second", edge), [*keys, "_second"])
        .filter(F.col("_at") > F.col("_now") - window).groupBy(*keys).agg(F.count(F.lit(1)).alias("_part"))
    )
    recent = ordered.join_null_safe(whole, part, keys, "left").select(
        *keys, (F.col("_whole") + F.coalesce("_part", F.lit(0))).alias("current"))
    latency = latency_stats(calls, keys).select(*keys, "avg", "max", "p95")
    joined = ordered.join_null_safe(ordered.join_null_safe(recent, usage, keys, "left"), latency, keys, "left")
    spent = F.coalesce(F.col("cost"), F.lit(0).cast(P.MONEY))
    return joined.withColumns({
        "remaining": F.greatest(F.lit(0), F.lit(max_calls) - F.col("current")),
        "total_spent": F.bround(spent, 4),
        "budget_ok": spent < _usd(fixed.HARD_LIMIT_USD), "budget_alert": spent >= _usd(fixed.ALERT_USD),
        "models_available": F.array(*[F.lit(m[0]) for m in fixed.MODELS if configured is None or m[0] in configured]),
        "default_model": F.lit(fixed.DEFAULT_MODEL),
    })


def catalogue(spark, configured: list[str]) -> DataFrame:
    """U16: the model table with prices as text and whether a model has a key."""
    rows = [
        (name, model_id, tier, provider, name in configured, f"${float(cost_in):.4f} / ${float(cost_out):.4f}")
        for name, model_id, cost_in, cost_out, tier, provider in fixed.MODELS
    ]
    return spark.createDataFrame(
        rows, "name string, id string, tier string, provider string, configured boolean, cost_per_1k string")
