"""Streams over position files: running steps, profiles, cell counts, sessions and incremental enrichment."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracks import MAX_GAP, MIN_STEP, windowed_cell_counts

AIS_SCHEMA = "event_id bigint, mmsi bigint, product int, port int, t bigint, x double, y double, type_code string"
STEP_SCHEMA = "product int, mmsi bigint, event_id bigint, t bigint, x double, y double, dt bigint, dx double, dy double"


def ais_stream(spark: SparkSession, path: str, schema: str = AIS_SCHEMA, files_per_trigger: int = 10_000) -> DataFrame:
    """Parquet position files as they arrive, with `ts` as event time."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.withColumn("ts", F.timestamp_seconds("t"))


#: Vessels share a state: all last fixes of a bucket are one value, so that a batch costs a few calls a bucket, not a vessel.
#: Part of a stream's checkpoint: it stays as it is while a stream lives.
BUCKETS = 1024
_FIX = np.dtype([("product", "<i4"), ("mmsi", "<i8"), ("t", "<i8"), ("x", "<f8"), ("y", "<f8")])
_NO_PRODUCT, _NO_MMSI = -(1 << 31), -(1 << 63)


def _bucketed(ais: DataFrame) -> DataFrame:
    """Rows with their bucket; a null product or vessel is a key of its own."""
    return ais.withColumns({"product": F.coalesce("product", F.lit(_NO_PRODUCT)), "mmsi": F.coalesce("mmsi", F.lit(_NO_MMSI).cast("long"))}).withColumn(
        "bucket", F.pmod(F.xxhash64("product", "mmsi"), F.lit(BUCKETS)).cast("int"))


def _unbucketed(steps: DataFrame) -> DataFrame:
    return steps.withColumns({"product": F.nullif("product", F.lit(_NO_PRODUCT)), "mmsi": F.nullif("mmsi", F.lit(_NO_MMSI).cast("long"))})


def _advance(pdf: pd.DataFrame, state: bytes, max_gap: int, min_step: float, watermark: int, stay: bool) -> tuple[pd.DataFrame, bytes, int]:
    """(steps of a bucket's new rows, the last fixes after them, time of the latest one).

    Fixes whose gap the watermark (in ms) has passed are dropped.  With `stay`, rows no later than a kept fix give no step and it stays."""
    held = np.frombuffer(state, _FIX)
    held = held[(held["t"] + max_gap) * 1000 > watermark]
    rows = {c: np.concatenate([held[c], pdf[c].to_numpy(_FIX[c])]) for c in _FIX.names}
    new = np.repeat([0, 1], [len(held), len(pdf)])
    event = np.concatenate([np.zeros(len(held), np.int64), pdf.event_id.to_numpy(np.int64)])
    order = np.lexsort((event, rows["t"], new, rows["mmsi"], rows["product"]))
    rows, new, event = {c: v[order] for c, v in rows.items()}, new[order], event[order]
    starts = lambda: np.append(True, (rows["mmsi"][1:] != rows["mmsi"][:-1]) | (rows["product"][1:] != rows["product"][:-1]))[: len(new)]
    if stay and len(held):
        first = np.maximum.accumulate(np.where(starts(), np.arange(len(new)), 0))
        keep = (new == 0) | (new[first] == 1) | (rows["t"] > rows["t"][first])
        rows, new, event = {c: v[keep] for c, v in rows.items()}, new[keep], event[keep]
    start = starts()
    prev = np.maximum(np.arange(len(new)) - 1, 0)
    dt, dx, dy = (rows[c] - rows[c][prev] for c in ("t", "x", "y"))
    step = (new == 1) & ~start & (dt > 0) & (dt <= max_gap) & ((dx**2 + dy**2) ** 0.5 >= min_step)
    out = pd.DataFrame({"product": rows["product"][step], "mmsi": rows["mmsi"][step], "event_id": event[step], "t": rows["t"][step], "x": rows["x"][step],
                        "y": rows["y"][step], "dt": dt[step], "dx": dx[step], "dy": dy[step]})
    last = np.append(start[1:], True)[: len(new)]
    fixes = np.zeros(int(last.sum()), _FIX)
    for c in _FIX.names:
        fixes[c] = rows[c][last]
    return out, fixes.tobytes(), int(fixes["t"].max()) if len(fixes) else 0


def _steps_of(max_gap: int, min_step: float):
    """State function of a bucket: the last fix of a (product, vessel) is kept until the watermark passes its gap."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = bytes(state.get[0]) if state.exists else b""
        out, held, latest = _advance(pd.concat(list(frames)), held, max_gap, min_step, state.getCurrentWatermarkMs(), False)
        state.update((held,))
        state.setTimeoutTimestamp(max((latest + max_gap) * 1000, state.getCurrentWatermarkMs() + 1))
        if len(out):
            yield out

    return run


def track_steps_stream(ais: DataFrame, max_gap: int = MAX_GAP, min_step: float = MIN_STEP, delay: str = "10 minutes") -> DataFrame:
    """Steps of a stream by keyed state; rows later than the watermark are dropped."""
    g = _bucketed(ais.withWatermark("ts", delay)).groupBy("bucket")
    return _unbucketed(g.applyInPandasWithState(_steps_of(max_gap, min_step), STEP_SCHEMA, "fixes binary", "append", GroupStateTimeout.EventTimeTimeout))


class LastFixes(StatefulProcessor):
    """The last fixes of a bucket's vessels, and the steps from them, in event time.

    A fix goes once the watermark has passed its gap: with the bucket's next rows, or by a timer that clears the bucket after its latest one."""

    def __init__(self, max_gap: int, min_step: float):
        self.max_gap, self.min_step = max_gap, min_step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fixes = handle.getValueState("fixes", "fixes binary, latest bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, before = self.fixes.get() if self.fixes.exists() else (b"", None)
        watermark = timerValues.getCurrentWatermarkInMs()
        out, held, latest = _advance(pd.concat(list(rows)), bytes(held), self.max_gap, self.min_step, watermark, True)
        self.fixes.update((held, latest))
        if before != latest:
            if before is not None:
                self.handle.deleteTimer((before + self.max_gap) * 1000)
            self.handle.registerTimer(max((latest + self.max_gap) * 1000, watermark + 1))
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # an earlier timer may outlive its fixes; only that of the latest one counts
        if self.fixes.exists() and (self.fixes.get()[1] + self.max_gap) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.fixes.clear()
        return iter(())

    def close(self) -> None:
        pass


class LastFix(StatefulProcessor):
    """The last fix of a (product, vessel), and the steps from it.

    In event time a timer drops the fix once the watermark has passed its gap; in processing time the state store drops it
    when nothing came for that long.  Rows no later than the kept fix give no step; it stays."""

    def __init__(self, max_gap: int, min_step: float, event_time: bool):
        self.max_gap, self.min_step, self.event_time = max_gap, min_step, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t bigint, x double, y double", None if self.event_time else self.max_gap * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["t", "event_id"])
        before = self.last.get() if self.last.exists() else None
        if before is not None:
            pdf = pdf[pdf.t > before[0]]
        if pdf.empty:
            return
        t, x, y = pdf.t.tolist(), pdf.x.tolist(), pdf.y.tolist()
        out = pd.DataFrame({"product": key[0], "mmsi": key[1], "event_id": pdf.event_id.to_numpy(), "t": t, "x": x, "y": y})
        first = before or (None, None, None)
        out["pt"], out["px"], out["py"] = [first[0], *t[:-1]], [first[1], *x[:-1]], [first[2], *y[:-1]]
        self.last.update((int(t[-1]), float(x[-1]), float(y[-1])))
        if self.event_time:
            if before is not None:
                self.handle.deleteTimer(self._expiry(before[0]))
            self.handle.registerTimer(max(self._expiry(t[-1]), timerValues.getCurrentWatermarkInMs() + 1))
        out = out[out.pt.notna()]
        if len(out):
            out = out.assign(dt=(out.t - out.pt).astype("int64"), dx=(out.x - out.px).astype(float), dy=(out.y - out.py).astype(float))
            keep = (out.dt > 0) & (out.dt <= self.max_gap) & ((out.dx**2 + out.dy**2) ** 0.5 >= self.min_step)
            yield out.loc[keep, ["product", "mmsi", "event_id", "t", "x", "y", "dt", "dx", "dy"]]

    def _expiry(self, t: int) -> int:
        return (int(t) + self.max_gap) * 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # an earlier timer may outlive its fix; only the last one's counts
        if self.last.exists() and self._expiry(self.last.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def track_steps_keyed(ais: DataFrame, max_gap: int = MAX_GAP, min_step: float = MIN_STEP, delay: str = "10 minutes", event_time: bool = True) -> DataFrame:
    """Steps of a stream by the state store's own values, timers and expiry; rows later than the watermark are dropped.

    Needs the RocksDB state store, which `drain(..., rocks=True)` sets."""
    # Spark asks the processor for its state in a process that gets neither the package nor its path, so it travels whole
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    if event_time:
        return _unbucketed(_bucketed(ais.withWatermark("ts", delay)).groupBy("bucket").transformWithStateInPandas(
            LastFixes(max_gap, min_step), outputStructType=STEP_SCHEMA, outputMode="Append", timeMode="EventTime"))
    return ais.groupBy("product", "mmsi").transformWithStateInPandas(
        LastFix(max_gap, min_step, False), outputStructType=STEP_SCHEMA, outputMode="Append", timeMode="ProcessingTime")


def mmsi_profile_stream(ais: DataFrame) -> DataFrame:
    """Running rows per vessel and type code (update mode)."""
    return ais.groupBy("mmsi", "type_code").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def cell_counts_stream(ais: DataFrame, size: float, duration: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Rows per cell and event-time window; late rows beyond `delay` are dropped."""
    return windowed_cell_counts(ais.withWatermark("ts", delay), ["port"], size, duration, slide)


def visit_sessions_stream(ais: DataFrame, keys: Sequence[str], gap: str = f"{MAX_GAP} seconds", delay: str = "10 minutes") -> DataFrame:
    """Presence sessions closed by a silence of `gap`."""
    g = ais.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), *keys)
    return g.agg(F.count(F.lit(1)).alias("fixes"), F.min("t").alias("start"), F.max("t").alias("end")).drop("w")


def incremental_enrich(source: DataFrame, path: str, keys: Sequence[str], enrich: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Append enriched rows of new files to a bucketed table; rows whose key it already holds are skipped, so a replay adds nothing."""
    from ..sources.sinks import append_new

    def batch(df: DataFrame, _epoch: int) -> None:
        append_new(enrich(df), path, keys)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Setting and class of the store that keeps state in RocksDB, with snapshots in the checkpoint folder, instead of on the heap.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append", rocks: bool = False) -> DataFrame:
    """Run a stream over what is available now into a parquet table and read it back; `rocks` keeps its state in RocksDB.

    In update and complete mode each batch is written under its number and the newest row per key is up to the reader."""
    spark = df.sparkSession
    before = spark.conf.get(STORE)
    if rocks:
        spark.conf.set(STORE, ROCKS)
    try:
        _run(df, path, checkpoint, mode)
    finally:
        spark.conf.set(STORE, before)
    return spark.read.parquet(path)


def _run(df: DataFrame, path: str, checkpoint: str, mode: str) -> None:
    if mode == "append":
        q = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        def batch(b: DataFrame, epoch: int) -> None:
            b.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

        q = df.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
