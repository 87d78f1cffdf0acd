"""Keyed state for streams of calls and turns, timed by the watermark.

Rows may come out of order within ``delay``.  Each key holds rows back in steps of time; when the watermark
has passed a step's end its rows are decided in order, one step at a time, and leave the state.  What is
decided is never changed: a row that comes for a step that is over is passed on marked ``late``, so every
row comes out once.  A key that falls silent settles by its timers, and what it no longer needs is cleared.

The time column is left behind below the stateful operator: Spark then keeps the watermark but does not
drop rows by it, so that late ones reach the processor.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitaespark import fixed
from vitaespark.operators.metering import is_recorded, micros

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
SECOND = 1_000_000


class InOrder(StatefulProcessor):
    """Hold back, sort, decide: subclasses say what a decision is.

    A key's state is what came in the last ``delay`` and one step, and the subclass's own fields.  The rows of a
    batch are one entry of it and a key has one timer, that of its first step held, so a batch costs a key
    a few calls to the store, however many steps and rows it has.
    """

    #: Fields of a subclass's own state, and their first values.
    FIELDS, FIRST = "", ()
    #: How long after a key's last step its own state still matters; for ever if None.
    KEPT: int | None = None

    def __init__(self, step: int):
        self.step = step

    def decide(self, own: tuple, at: int, flag: bool) -> tuple[tuple, dict]:
        """New own state, and the decided columns."""
        raise NotImplementedError

    def row(self, key, at: int, name: int, late: bool, decided: dict) -> Row:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", f"done bigint, first bigint, entries bigint, {self.FIELDS}")
        self.held = handle.getMapState("held", "entry bigint", "rows array<struct<at: bigint, name: bigint, flag: boolean>>")

    def load(self) -> tuple:
        """Until when rows are decided, the first step held, the number of the next entry, and the own state."""
        found = self.place.get()
        return (None, None, 0, *self.FIRST) if found is None else tuple(found)

    def timed(self, first: int | None, now: int) -> int:
        """One timer for the first step held."""
        if first != now:
            if first is not None:
                self.handle.deleteTimer((first + 1) * self.step // 1000)
            self.handle.registerTimer((now + 1) * self.step // 1000)
        return now

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        done, first, entries, *own = self.load()
        since = done
        if since is None:  # a new key, or one whose state is no longer needed: what the watermark has passed is late
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            since = passed - passed % self.step
        fresh = []
        for r in rows:
            if r.name is None:
                continue
            if r.at < since:
                yield self.row(key, r.at, r.name, True, {})
            else:
                fresh.append((r.at, r.name, bool(r.flag)))
        if fresh:
            least = min(fresh)[0] // self.step
            first = self.timed(first, least if first is None else min(first, least))
            self.held.updateValue((entries,), (fresh,))
            self.place.update((done, first, entries + 1, *own))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        # all steps that the watermark has passed, not only the one of this timer
        until = max(expiredTimerInfo.getExpiryTimeInMs() * 1000, watermark - 1)
        until -= until % self.step
        done, first, entries, *own = self.load()
        due, rest = [], None
        if first is not None and first * self.step < until:
            held = [(k[0], [tuple(x) for x in v[0]]) for k, v in self.held.iterator()]
            for entry, rows in held:
                kept = [x for x in rows if x[0] >= until]
                due += [x for x in rows if x[0] < until]
                if kept:
                    least = min(kept)[0] // self.step
                    rest = least if rest is None else min(rest, least)
                    if len(kept) < len(rows):
                        self.held.updateValue((entry,), (kept,))
                else:
                    self.held.removeKey((entry,))
            for at, name, flag in sorted(due):
                own, decided = self.decide(tuple(own), at, flag)
                yield self.row(key, at, name, False, decided)
            done = (max(due)[0] // self.step + 1) * self.step
            if rest is not None:
                self.timed(None, rest)
            first = rest
            self.place.update((done, first, entries, *own))
        if self.KEPT is None or done is None or first is not None:
            return
        if done + self.KEPT <= watermark:
            self.place.clear()  # silent for so long that nothing before matters
        elif due:
            self.handle.registerTimer((done + self.KEPT) // 1000 + 1)

    def close(self) -> None:
        pass


class SlidingLimiter(InOrder):
    """U11 on a stream: admitted times of the last window per key."""

    FIELDS, FIRST = "times array<bigint>", ([],)

    def __init__(self, max_calls: int, window_micros: int, step: int):
        super().__init__(step)
        self.max_calls, self.window = max_calls, window_micros
        self.KEPT = window_micros

    def decide(self, own, at, flag):
        times = [t for t in own[0] if at - t < self.window]
        admitted = len(times) < self.max_calls
        return (times + [at] * admitted,), {"admitted": admitted}

    def row(self, key, at, name, late, decided):
        return Row(tenant=key[0], call_id=name, admitted=decided.get("admitted"), late=late)


class FixedWindowLimiter(SlidingLimiter):
    """U12 on a stream: end and use of the open window per key."""

    FIELDS, FIRST = "until bigint, used int", (None, 0)

    def decide(self, own, at, flag):
        until, used = own
        if until is None or at >= until:
            until, used = at + self.window, 0
        admitted = used < self.max_calls
        return (until, used + int(admitted and flag)), {"admitted": admitted}


class PhaseTracker(InOrder):
    """I2 on a stream: phase, round and question number per conversation."""

    LIMITS = [limit for _, limit in fixed.PHASES]
    FIELDS, FIRST = "phase int, rounds int, asked int", (0, 0, 0)

    def decide(self, own, at, flag):
        last = len(self.LIMITS) - 1
        phase, rounds, asked = own
        if flag and asked > 0 and phase < last:
            phase, rounds = phase + 1, 0
        if rounds >= self.LIMITS[phase] and phase < last:
            phase, rounds = phase + 1, 0
        return (phase, rounds + 1, asked + 1), {"question_no": asked, "phase": phase}

    def row(self, key, at, name, late, decided):
        return Row(conv_id=key[0], turn=name, question_no=decided.get("question_no"), phase=decided.get("phase"), late=late)


_ADMITTED = "tenant bigint, call_id bigint, admitted boolean, late boolean"


def timed(rows: DataFrame, clock: DataFrame | None, delay_seconds: int) -> DataFrame:
    """Rows with a watermark on ``ts``.

    ``clock`` is a stream of times alone: a row there moves the watermark on for all keys, as at the end of a
    log.  It belongs to no key.
    """
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    if clock is not None:
        rows = rows.unionByName(clock, allowMissingColumns=True)
    return rows.withWatermark("ts", f"{delay_seconds} seconds")


def _in_order(rows: DataFrame, key: str, processor: InOrder, schema: str) -> DataFrame:
    return rows.groupBy(key).transformWithState(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


def _calls(calls: DataFrame) -> DataFrame:
    return calls.select("tenant", micros().alias("at"), F.col("call_id").alias("name"), is_recorded().alias("flag"))


def limit_sliding(calls: DataFrame, max_calls: int = fixed.MAX_RPM, window_seconds: int = fixed.RATE_WINDOW_SECONDS,
                  delay_seconds: int = 600, step_seconds: int = 60, clock: DataFrame | None = None) -> DataFrame:
    processor = SlidingLimiter(max_calls, window_seconds * SECOND, step_seconds * SECOND)
    return _in_order(_calls(timed(calls, clock, delay_seconds)), "tenant", processor, _ADMITTED)


def limit_fixed_window(calls: DataFrame, max_calls: int = fixed.MAX_RPM, window_seconds: int = fixed.RATE_WINDOW_SECONDS,
                       delay_seconds: int = 600, step_seconds: int = 60, clock: DataFrame | None = None) -> DataFrame:
    processor = FixedWindowLimiter(max_calls, window_seconds * SECOND, step_seconds * SECOND)
    return _in_order(_calls(timed(calls, clock, delay_seconds)), "tenant", processor, _ADMITTED)


def track_phases(turns: DataFrame, skip: Column, delay_seconds: int = 600, step_seconds: int = 60,
                 clock: DataFrame | None = None) -> DataFrame:
    """I2; turns have a time ``ts``, which rises with ``turn`` inside a conversation."""
    spoken = timed(turns.withColumn("_skip", F.coalesce(skip, F.lit(False))), clock, delay_seconds).filter(
        (F.col("role") == "user") | F.col("role").isNull())
    rows = spoken.select("conv_id", micros().alias("at"), F.when(F.col("role").isNotNull(), F.col("turn")).alias("name"), F.col("_skip").alias("flag"))
    schema = "conv_id bigint, turn bigint, question_no int, phase int, late boolean"
    return _in_order(rows, "conv_id", PhaseTracker(step_seconds * SECOND), schema)


# --- windowed load ----------------------------------------------------------------------------

LOAD = ["calls", "prompt_tokens", "failures"]
#: The step of rows of the clock.
NO_STEP = -(1 << 62)


class WindowLoad(StatefulProcessor):
    """Sums of the windows that begin in one step; out once when all of them are over.

    What comes for a step that is out comes out as a correction to add to it.
    """

    def __init__(self, step: int, width: int):
        self.step, self.width = step, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "windows array<struct<at: bigint, " + ", ".join(f"{c}: bigint" for c in LOAD) + ">>")

    def rows(self, sums: pd.DataFrame, correction: bool) -> pd.DataFrame:
        return sums.reset_index().astype("int64").assign(correction=correction)[["at", *LOAD, "correction"]]

    def known(self) -> pd.DataFrame:
        kept = [tuple(x) for x in self.sums.get()[0]] if self.sums.exists() else []
        return pd.DataFrame(kept, columns=["at", *LOAD]).set_index("at")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == NO_STEP:
            return
        new = pd.concat([r.groupby("at")[LOAD].sum() for r in rows])
        over = (key[0] + 1) * self.step + self.width
        if over <= timerValues.getCurrentWatermarkInMs() * 1000 and not self.sums.exists():
            yield self.rows(new.groupby("at").sum(), True)
            return
        if not self.sums.exists():
            self.handle.registerTimer(over // 1000)
        both = pd.concat([self.known(), new]).groupby("at").sum().astype("int64")
        self.sums.update(([tuple(map(int, r)) for r in both.itertuples()],))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sums = self.known()
        self.sums.clear()
        if len(sums):
            yield self.rows(sums, False)

    def close(self) -> None:
        pass


def load_stream(calls: DataFrame, width_seconds: int = 60, slide_seconds: int | None = None, delay_seconds: int = 600,
                step_seconds: int = 3600, clock: DataFrame | None = None) -> DataFrame:
    """U14 on a stream: calls, tokens and failures per window, with ``correction`` rows for what came too late.

    A window's main row and its corrections add up to the batch form, whatever the order of the calls.
    """
    slide = slide_seconds or width_seconds
    at = F.floor(micros() / (slide * SECOND)) * (slide * SECOND)
    starts = F.transform(F.sequence(F.lit(0), F.lit(width_seconds // slide - 1)), lambda k: at - k * slide * SECOND)
    rows = timed(calls, clock, delay_seconds).select(
        F.explode_outer(F.when(F.col("call_id").isNotNull(), starts)).alias("at"), F.lit(1).cast("long").alias("calls"),
        F.coalesce("prompt_tokens", F.lit(0)).cast("long").alias("prompt_tokens"),
        F.when(F.col("success"), 0).when(~F.col("success"), 1).otherwise(0).cast("long").alias("failures"))
    step = F.coalesce(F.floor(F.col("at") / (step_seconds * SECOND)), F.lit(NO_STEP))
    found = rows.withColumn("step", step).groupBy("step").transformWithStateInPandas(
        statefulProcessor=WindowLoad(step_seconds * SECOND, width_seconds * SECOND),
        outputStructType="at bigint, " + ", ".join(f"{c} bigint" for c in LOAD) + ", correction boolean",
        outputMode="append", timeMode="eventTime")
    return found.select(
        F.timestamp_micros("at").alias("window_start"), F.timestamp_micros(F.col("at") + width_seconds * SECOND).alias("window_end"),
        *LOAD, "correction")
