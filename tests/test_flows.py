import datetime as dt
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from vitaespark.operators import dialog, limits, metering
from vitaespark.sources import files
from vitaespark.streaming import run, state


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("hello")
    (tmp_path / "b.md").write_bytes(b"ok \xff end")
    (tmp_path / "c.json").write_text("   \n")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.weird").write_text("x")
    (tmp_path / "noext").write_text("y")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert {n: (r.method, r.success) for n, r in rows.items()} == {
        "a.TXT": ("text", True), "b.md": ("text", True), "c.json": ("text", False), "d.pdf": ("pdf", False),
        "e.weird": ("text_fallback", True), "noext": ("text_fallback", True)}
    assert rows["b.md"].text == "ok � end" and rows["c.json"].error


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None, ["a"])], "id int, note string, tags array<string>")
    files.write_results(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"id":1,"note":null,"tags":["a"]}'
    back = files.read_records(spark, str(tmp_path / "out"), "id int, note string, tags array<string>")
    assert back.collect() == df.collect()
    (tmp_path / "one.json").write_text('{\n "id": 5\n}')
    assert files.read_record_files(spark, str(tmp_path / "one.json"), "id int").first().id == 5


def make_calls(spark):
    rng, now, rows = random.Random(2), 0, []
    for i in range(240):
        now += rng.choice([0, 1, 5, 20, 90])
        rows.append((i, rng.randint(0, 2), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=now), rng.random() < 0.8, 10, 5))
    return spark.createDataFrame(
        rows, "call_id bigint, tenant bigint, ts timestamp, success boolean, prompt_tokens bigint, completion_tokens bigint")


def pieces(df, *parts):
    return [df.filter(p) for p in parts]


def decisions(df):
    return sorted((r.call_id, r.admitted) for r in df.collect())


LIMITERS = ((state.limit_sliding, limits.sliding_limiter), (state.limit_fixed_window, limits.fixed_window_limiter))


def test_streams_out_of_order_equal_batches(spark):
    """Calls up to ten minutes too late, a delay of eleven: nothing is lost, nothing left undecided, none late."""
    calls = make_calls(spark)
    late_by = F.col("call_id") * 30 + F.pmod(F.xxhash64("call_id"), F.lit(600))
    parts = pieces(calls, late_by < 2000, late_by.between(2000, 3999), late_by.between(4000, 5999), late_by >= 6000)
    span = calls.agg(F.max("ts").cast("long") - F.min("ts").cast("long")).first()[0]
    for stream, batch in LIMITERS:
        got = run.run_arrivals(parts, lambda rows, clock: stream(rows, 2, delay_seconds=span, step_seconds=30, clock=clock), "t")
        assert got.filter("late OR admitted IS NULL").count() == 0
        assert decisions(got) == decisions(batch(calls, ["tenant"], 2))


def test_late_rows_come_out_marked(spark):
    """Pieces in falling order of time with a short delay: late rows are told, and kept + late = input."""
    calls = make_calls(spark)
    parts = pieces(calls, *[F.col("call_id").between(80 * k, 80 * k + 79) for k in (2, 1, 0)])
    got = run.run_arrivals(parts, lambda rows, clock: state.limit_sliding(rows, 2, delay_seconds=60, step_seconds=10, clock=clock), "t")
    assert got.count() == calls.count() == got.select("call_id").distinct().count()
    late = got.filter("late")
    assert 0 < late.count() < calls.count() and late.filter("admitted IS NOT NULL").count() == 0
    kept = got.filter("not late")
    assert kept.filter("admitted IS NULL").count() == 0
    assert decisions(kept) == decisions(limits.sliding_limiter(calls.join(late, "call_id", "left_anti"), ["tenant"], 2))


def test_state_is_bounded_by_the_delay(spark, tmp_path):
    """A long log of one busy key: what its state holds is what came in the delay and one step."""
    calls = spark.range(3000).selectExpr("id AS call_id", "1L AS tenant", "timestamp_seconds(1700000000 + id * 10) AS ts",
                                         "true AS success", "1L AS prompt_tokens", "1L AS completion_tokens")
    parts = pieces(calls, *[F.col("call_id").between(500 * k, 500 * k + 499) for k in range(6)])
    folder = f"file://{tmp_path}/bounded"
    build = lambda rows, clock: state.limit_sliding(rows, 2, delay_seconds=600, step_seconds=100, clock=clock)

    def held():
        rows = spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "held").load()
        return rows.selectExpr("coalesce(sum(size(user_map_value.rows)), 0)").first()[0]

    got = run.run_arrivals(parts, build, "t", folder, close=False)
    assert 0 < held() <= (600 + 100) / 10 + 1 and got.count() + held() == 3000
    got = run.run_arrivals([calls.limit(0)], build, "t", folder)
    assert held() == 0 and got.count() == 3000 and got.filter("late").count() == 0
    place = spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "place").load()
    assert place.count() == 0  # the key is silent for longer than its window
    assert decisions(got) == decisions(limits.sliding_limiter(calls, ["tenant"], 2))


class CountedStore:
    """Keyed state of one key in memory, with the number of calls to it."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, set()

    def __getattribute__(self, name):
        get = object.__getattribute__
        if name in ("calls", "value", "map", "timers", "getValueState", "getMapState") or name.startswith("__"):
            return get(self, name)
        self.calls += 1
        return get(self, name)

    def getValueState(self, *schema):
        return self

    getMapState = getValueState

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]

    def keys(self):
        return iter(list(self.map))

    def iterator(self):
        return iter(list(self.map.items()))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clock:
    def __init__(self, watermark, expiry=None):
        self.getCurrentWatermarkInMs, self.getExpiryTimeInMs = lambda: watermark, lambda: expiry


def test_a_batch_costs_a_key_a_few_calls_to_the_store():
    """Round 3, F8 and F10: a call to the store or a timer per step of each key made the time of the limiters."""
    for limiter in (state.SlidingLimiter, state.FixedWindowLimiter):
        store, found = CountedStore(), []
        processor = limiter(2, 60 * state.SECOND, 10 * state.SECOND)
        processor.init(store)
        times = [10 * state.SECOND * (1000 + k) for k in range(300)]
        random.Random(3).shuffle(times)
        for part, watermark in ((times[:150], 0), (times[150:], 0), ([], max(times) // 1000 - 60_000), ([], max(times) // 1000 + 10_001)):
            processor.handle.calls = 0
            rows = [Row(name=at, at=at, flag=True) for at in part]
            found += processor.handleInputRows((1,), iter(rows), Clock(watermark)) if rows else []
            while due := sorted(t for t in store.timers if t < watermark)[:1]:
                store.timers.remove(due[0])
                found += processor.handleExpiredTimer((1,), Clock(watermark), Clock(None, due[0]))
            assert store.calls <= 20
        assert [r.call_id for r in found] == sorted(times) and not any(r.late for r in found) and not store.map


def test_load_with_corrections_equals_the_batch(spark):
    calls = make_calls(spark)
    mixed = pieces(calls, *[F.pmod(F.xxhash64("call_id"), F.lit(4)) == k for k in range(4)])
    for slide, delay in ((None, 60), (10, 100_000)):
        got = run.run_arrivals(mixed, lambda rows, clock: state.load_stream(
            rows, slide_seconds=slide, delay_seconds=delay, step_seconds=600, clock=clock), "t")
        main = got.filter("not correction")
        assert main.count() == main.select("window_start").distinct().count()
        assert (got.filter("correction").count() > 0) == (delay == 60)
        batch = metering.load_per_window(calls, slide="10 seconds" if slide else None)
        added = got.groupBy("window_start", "window_end").agg(*[F.sum(c).alias(c) for c in state.LOAD])
        assert sorted(map(tuple, added.select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_phase_stream(spark):
    rng = random.Random(4)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", rng.random() < 0.3) for c in range(12) for t in range(20)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, skip boolean").withColumn("ts", F.timestamp_seconds("turn"))
    late_by = F.col("turn") + F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5))
    got = run.run_arrivals(pieces(turns, late_by < 8, late_by.between(8, 15), late_by > 15), lambda rows, clock: state.track_phases(
        rows, F.col("skip"), delay_seconds=20, step_seconds=3, clock=clock), "t")
    want = dialog.phases(turns, F.col("skip"))
    pick = lambda df: sorted((r.conv_id, r.turn, r.question_no, r.phase) for r in df.collect())
    assert got.filter("late").count() == 0 and pick(got) == pick(want)
