"""Streams over the events table, drained and compared with their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.sinks import read_sink
from ..streaming import tracks as R
from .base import query, rounded
from .q_sources import scratch
from .q_spatial import _STEPS


PARTS = 3


def parts(v, path):
    """The position table landing in `PARTS` folders one after the other, in time order, each written by all tasks."""
    a = v.ais.select("event_id", "mmsi", F.col("product").cast("int").alias("product"), F.col("port").cast("int").alias("port"), "t", "x", "y", "type_code")
    lo, hi = a.agg(F.min("t"), F.max("t")).first()
    part = F.least(F.floor((F.col("t") - lo) * PARTS / max(1, hi - lo)), F.lit(PARTS - 1))
    for k in range(PARTS):
        a.where(part == k).write.parquet(f"{path}/{k}")
        yield k


def fed(v, build, mode="append", rocks=False):
    """`build(stream)` run over each part as it lands; every run starts again from the checkpoint of the one before."""
    path, out = scratch(v, "stream"), scratch(v, "out")
    for _ in parts(v, path):
        result = R.drain(build(R.ais_stream(v.spark, f"{path}/*")), out, out + "-ck", mode, rocks)
    return result


@query("track_steps_stream", "ais", _STEPS.format(gap=3600) + " SELECT event_id, t, x, y, dt, round(dx, 4) + 0.0 AS dx, round(dy, 4) + 0.0 AS dy FROM steps")
def _(v):
    """The state store's own values and timers, kept over restarts; the delay is long enough that no row of the month is late."""
    r = fed(v, lambda s: R.track_steps_keyed(s, 3600, delay="40 days"), rocks=True)
    return rounded(r.select("event_id", "t", "x", "y", "dt", "dx", "dy"), 4)


@query("mmsi_profile_stream", "ais", "SELECT mmsi, type_code, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM ais GROUP BY ALL")
def _(v):
    r = fed(v, R.mmsi_profile_stream, "update")
    newest = r.groupBy("mmsi", "type_code").agg(F.max_by(F.struct("n", "first_t", "last_t"), "epoch").alias("r"))
    return newest.select("mmsi", "type_code", "r.*")


@query("cell_counts_stream", "ais", "SELECT time_bucket(INTERVAL 6 HOUR, make_timestamp(t * 1000000)) AS window_start, port, CAST(floor(x/2000) AS BIGINT) AS cx, CAST(floor(y/2000) AS BIGINT) AS cy, count(*) AS points FROM ais GROUP BY ALL")
def _(v):
    r = fed(v, lambda s: R.cell_counts_stream(s, 2000.0, "6 hours", delay="40 days"), "update")
    return r.groupBy("window_start", "port", "cx", "cy").agg(F.max_by("points", "epoch").alias("points"))


@query("incremental_enrich", "ais", "SELECT event_id, mmsi, t % 2 = 0 AS even FROM ais")
def _(v):
    """Run twice over the same files; the second run adds nothing."""
    out, path = scratch(v, "enrich"), scratch(v, "stream")
    list(parts(v, path))
    s = R.ais_stream(v.spark, f"{path}/*")
    fn = lambda d: d.select("event_id", "mmsi", (F.col("t") % 2 == 0).alias("even"))
    for k in ("1", "2"):
        R.incremental_enrich(s, out, ["event_id"], fn, f"{out}-ck{k}").awaitTermination()
    return read_sink(v.spark, out)


@query("track_steps_state", "ais", _STEPS.format(gap=3600) + " SELECT event_id, t, x, y, dt, round(dx, 4) + 0.0 AS dx, round(dy, 4) + 0.0 AS dy FROM steps")
def _(v):
    """Keyed state instead of tables; the delay is long enough that no row of the month is late."""
    r = fed(v, lambda s: R.track_steps_stream(s, 3600, delay="40 days"))
    return rounded(r.select("event_id", "t", "x", "y", "dt", "dx", "dy"), 4)


@query("visit_sessions_stream", "ais", """, l AS (SELECT mmsi, t, CASE WHEN t - lag(t) OVER (PARTITION BY mmsi ORDER BY t) <= 21600 THEN 0 ELSE 1 END AS s FROM ais), g AS (SELECT mmsi, t, sum(s) OVER (PARTITION BY mmsi ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT mmsi, min(t) AS start, max(t) AS "end", count(*) AS fixes FROM g GROUP BY mmsi, k""")
def _(v):
    """Sessions kept across batches, taken after the last one. Session windows that touch are one, so a silence of just the gap stays inside."""
    r = fed(v, lambda s: R.visit_sessions_stream(s, ["mmsi"], "21600 seconds"), "complete")
    last = r.agg(F.max("epoch")).first()[0]
    return r.where(F.col("epoch") == last).select("mmsi", "start", "end", "fixes")
