"""Streams end where their batch form ends."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from portlake.operators.tracks import track_steps, visit_sessions
from portlake.sources.sinks import append_new, read_sink
from portlake.streaming import tracks as R


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """A store for each partition and run is what these small streams spend their time on."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture()
def fixes(spark, tmp_path):
    rows = [(i, i % 3, 1, 0, 1_700_000_000 + 97 * i + (i % 7) * 40, float(i * 13 % 500), float(i * 29 % 700), "a") for i in range(400)]
    df = spark.createDataFrame(rows, R.AIS_SCHEMA)
    path = str(tmp_path / "in")
    # one write after the other: the stream takes files by age
    for k in range(3):
        df.where(f"event_id % 400 div 134 = {k}").coalesce(1).write.mode("append").parquet(path)
    return df, path, tmp_path


def steps(df):
    return sorted((r.event_id, r.dt) for r in df.select("event_id", "dt").collect())


def landed(spark, tmp, name, parts):
    """A stream over folders that appear one after the other, each run starting again from the checkpoint of the one before."""
    def run(build, mode="append"):
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, R.AIS_SCHEMA).repartition(2).write.parquet(f"{tmp}/{name}/{k}")
            out = R.drain(build(R.ais_stream(spark, f"{tmp}/{name}/*")), f"{tmp}/{name}-out", f"{tmp}/{name}-ck", mode, rocks=True)
        return out

    return run


def test_keyed_steps_equal_batch_over_restarts(spark, fixes):
    """The last fix of each vessel survives three runs of their own."""
    df, _, tmp = fixes
    rows = [tuple(r) for r in df.orderBy("t").collect()]
    got = landed(spark, tmp, "keyed", [rows[:150], rows[150:260], rows[260:]])(lambda s: R.track_steps_keyed(s, delay="30 days"))
    assert steps(got) == steps(track_steps(df, ["product", "mmsi"]))


def test_silent_vessels_expire_and_late_rows_are_dropped(spark, tmp_path):
    """A fix is forgotten once the watermark has passed its gap; rows behind the watermark neither count nor bring it back."""
    at = lambda i, mmsi, t, x: (i, mmsi, 1, 0, 1_700_000_000 + t, float(x), 0.0, "a")
    parts = [
        [at(1, 7, 0, 0), at(2, 7, 300, 100), at(3, 8, 0, 0)],
        [at(4, 9, 5000, 0)],  # brings the watermark to 4400, past 300 + 600
        [at(5, 9, 5100, 50)],  # a run in which the timers fire
        [at(6, 7, 700, 200), at(7, 8, 100, 50), at(8, 7, 5200, 300), at(9, 9, 5200, 150)],  # 6 and 7 are late; 8 has no fix before it
    ]
    got = landed(spark, tmp_path, "late", parts)(lambda s: R.track_steps_keyed(s, max_gap=600, min_step=1.0, delay="10 minutes"))
    assert steps(got) == [(2, 300), (5, 100), (9, 100)]
    # the same rows in one batch know nothing of lateness
    all_rows = spark.createDataFrame([r for p in parts for r in p], R.AIS_SCHEMA)
    assert (6, 400) in steps(track_steps(all_rows, ["product", "mmsi"], 600, 1.0))


class Held:
    """A state store of one key, as the processor sees it."""

    def __init__(self):
        self.value, self.timers, self.ttl = None, set(), None

    def getValueState(self, name, schema, ttl=None):  # noqa: N802
        self.ttl = ttl
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.at


@pytest.mark.parametrize("event_time", [True, False])
def test_expiry_of_a_fix(event_time):
    """In event time one timer stands, that of the last fix, and clears it; in processing time the store's own expiry is asked for."""
    held, step = Held(), R.LastFix(600, 1.0, event_time)
    step.init(held)
    frame = lambda *rows: iter([pd.DataFrame(rows, columns=["event_id", "t", "x", "y"])])
    assert [len(f) for f in step.handleInputRows((1, 7), frame((1, 100, 0.0, 0.0), (2, 400, 50.0, 0.0)), held)] == [1]
    assert [f.dt.tolist() for f in step.handleInputRows((1, 7), frame((3, 900, 90.0, 0.0), (4, 300, 0.0, 0.0)), held)] == [[500]]
    assert held.value == (900, 90.0, 0.0) and held.ttl == (None if event_time else 600_000)
    assert held.timers == ({1_500_000} if event_time else set())
    assert list(step.handleInputRows((1, 7), frame((5, 800, 0.0, 0.0)), held)) == [] and held.value[0] == 900
    held.at = 1_000_000
    list(step.handleExpiredTimer((1, 7), held, held))
    assert held.value is not None  # a timer of an earlier fix
    held.at = 1_500_000
    list(step.handleExpiredTimer((1, 7), held, held))
    assert held.value is None


def test_stateful_steps_equal_batch(spark, fixes):
    df, path, tmp = fixes
    s = R.track_steps_stream(R.ais_stream(spark, path, files_per_trigger=1), delay="30 days")
    got = R.drain(s, f"{tmp}/o2", f"{tmp}/ck2")
    assert steps(got) == steps(track_steps(df, ["product", "mmsi"]))


def test_sessions_stream_closes_silent_sessions(spark, fixes):
    df, path, tmp = fixes
    got = R.drain(R.visit_sessions_stream(R.ais_stream(spark, path), ["mmsi"], delay="1 second"), f"{tmp}/o3", f"{tmp}/ck3")
    closed = {(r.mmsi, r.start, r.fixes) for r in got.collect()}
    assert closed <= {(r.mmsi, r.start, r.fixes) for r in visit_sessions(df, ["mmsi"]).collect()}


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame(pd.DataFrame({"k": [1, 2, 2], "v": [1, 2, 2]}))
    for _ in range(2):
        append_new(df, str(tmp_path / "t"), ["k"])
    append_new(spark.createDataFrame([(3, 3)], "k long, v long"), str(tmp_path / "t"), ["k"])
    assert sorted(r.k for r in read_sink(spark, str(tmp_path / "t")).collect()) == [1, 2, 3]


def test_replays_with_null_keys_add_nothing(spark, tmp_path):
    """Null keys equal null keys, and of rows that repeat a key the same one is written whatever their order."""
    rows = [(1, "a", 5), (None, "a", 6), (None, "a", 7), (None, None, 8), (1, None, 9), (1, "a", 4), (2, "b", None)]
    want = [(1, "a", 4), (1, None, 9), (2, "b", None), (None, "a", 6), (None, None, 8)]
    path = str(tmp_path / "t")
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        append_new(spark.createDataFrame(order, "k long, l string, v long").repartition(3), path, ["k", "l"], buckets=8)
        assert sorted(map(tuple, read_sink(spark, path).collect()), key=repr) == sorted(want, key=repr)


def test_appends_read_touched_buckets_only(spark, tmp_path):
    from portlake.sources import sinks

    path = str(tmp_path / "t")
    append_new(spark.range(5000).selectExpr("id AS k", "id AS v"), path, ["k"], buckets=32)
    seen, real = [], sinks.resume_filter
    sinks.resume_filter = lambda todo, done, keys: seen.append(done) or real(todo, done, keys)
    try:
        append_new(spark.createDataFrame([(17, 0), (9999, 0)], "k long, v long"), path, ["k"], buckets=32)
    finally:
        sinks.resume_filter = real
    assert 0 < len({f.split("_bucket=")[1].split("/")[0] for f in (r[0] for r in seen[0].select(F.input_file_name()).distinct().collect())}) <= 2
    assert "PartitionFilters: [isnotnull" in seen[0]._jdf.queryExecution().toString() or "_bucket" in seen[0]._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]
    assert read_sink(spark, path).count() == 5001


def test_state_calls_do_not_grow_with_the_vessels(spark, tmp_path):
    """Vessels share states: 3000 of them in two runs leave at most BUCKETS states, and null keys are vessels of their own."""
    rows = [(i, None if i % 1500 == 7 else i % 1500, 1, 0, 1_700_000_000 + i // 1500 * 300 + (2 if i % 1500 == 8 else 0), float(i // 1500 * 50), 0.0, "a") for i in range(6000)]
    want = steps(track_steps(spark.createDataFrame(rows, R.AIS_SCHEMA), ["product", "mmsi"]))
    assert len(want) == 4500
    got = landed(spark, tmp_path, "many", [rows[:3000], rows[3000:]])(lambda s: R.track_steps_keyed(s, delay="30 days"))
    assert steps(got) == want
    got = R.drain(R.track_steps_stream(R.ais_stream(spark, f"{tmp_path}/many/*"), delay="30 days"), f"{tmp_path}/o", f"{tmp_path}/ck")
    assert steps(got) == want
    seen = spark.read.format("statestore").load(f"{tmp_path}/ck").count()
    assert 0 < seen <= R.BUCKETS


def test_silence_of_just_the_gap_stays_in_the_session(spark, tmp_path):
    """The registered query, with silences of 21,600 and 21,601 seconds inside a part and between parts."""
    import __spark_entry__ as entry

    t = [0, 21_600, 43_201, 43_202, 64_802, 86_403, 108_003, 108_004]
    rows = [(k, 1, float(k), '{"k": 1}', "a", 1_700_000_000 + s) for k, s in enumerate(t)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, value double, props string, event_type string, s long")
    e.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.start - 1_700_000_000, r.end - 1_700_000_000, r.fixes) for r in entry.queries()["visit_sessions_stream"](spark, str(tmp_path)).collect()}
    assert got == {(0, 21_600, 2), (43_201, 64_802, 3), (86_403, 108_004, 3)}
