"""Steps, directions and presence sessions of vessels.

A vessel may send a third of all rows, so its track is cut into time windows: a step longer than the gap is never
kept, hence the last rows of a window are enough context for the next one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grid import cell

# fixed values: step rules and field cells
MAX_GAP = 600
MIN_STEP = 20.0
CELL = 1000.0
MIN_POINTS = 8
WINDOWS_PER_GAP = 36


def track_steps(ais: DataFrame, keys: Sequence[str], max_gap: int = MAX_GAP, min_step: float = MIN_STEP, tie: str = "event_id") -> DataFrame:
    """Steps between successive fixes: 0 < dt <= max_gap and length >= min_step. Columns t, x, y, dt, dx, dy."""
    span = max_gap * WINDOWS_PER_GAP
    a = ais.select(*keys, tie, "t", "x", "y", F.floor(F.col("t") / span).alias("_w"))
    # rows in the last `max_gap` seconds of a window also serve as context in the next one
    late = F.col("t") - F.col("_w") * span >= span - max_gap
    both = F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    a = a.withColumn("_ctx", F.explode(both)).withColumn("_w", F.col("_w") + F.col("_ctx"))
    w = Window.partitionBy(*keys, "_w").orderBy("t", tie)
    prev = F.lag(F.struct("t", "x", "y")).over(w)
    s = a.withColumn("p", prev).where("_ctx = 0 and p is not null").select(
        *keys, tie, "t", "x", "y", (F.col("t") - F.col("p.t")).alias("dt"), (F.col("x") - F.col("p.x")).alias("dx"), (F.col("y") - F.col("p.y")).alias("dy"))
    return s.where((F.col("dt") > 0) & (F.col("dt") <= max_gap) & (F.hypot("dx", "dy") >= min_step))


def cell_direction(steps: DataFrame, keys: Sequence[str], size: float = CELL, min_points: int = MIN_POINTS) -> DataFrame:
    """Main axis of the unit steps per cell of the current position, with the ratio of the two eigenvalues."""
    length = F.hypot("dx", "dy") + 1e-9
    s = steps.select(*keys, cell("x", size).alias("cx"), cell("y", size).alias("cy"), (F.col("dx") / length).alias("u"), (F.col("dy") / length).alias("v"))
    g = s.groupBy(*keys, "cx", "cy").agg(
        F.count(F.lit(1)).alias("points"), F.var_samp("u").alias("a"), F.covar_samp("u", "v").alias("b"), F.var_samp("v").alias("c")
    ).where(F.col("points") >= min_points)
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    half, root = (a + c) / 2, F.sqrt((a - c) * (a - c) / 4 + b * b)
    theta = F.pmod(F.degrees(0.5 * F.atan2(2 * b, a - c)) + 180.0, F.lit(180.0))
    return g.select(
        *keys, "cx", "cy", ((F.col("cx") + 0.5) * size).alias("cell_x"), ((F.col("cy") + 0.5) * size).alias("cell_y"), "points",
        theta.alias("direction"), ((half + root) / (half - root + 1e-12)).alias("anisotropy"))


def visit_sessions(ais: DataFrame, keys: Sequence[str], gap: int = MAX_GAP) -> DataFrame:
    """Presence sessions: fixes of a vessel with no silence longer than `gap`.

    Fixes are grouped inside time windows first; only the resulting partial sessions are chained per vessel.
    """
    span = gap * WINDOWS_PER_GAP
    w = Window.partitionBy(*keys, "_w").orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a = ais.select(*keys, "t", F.floor(F.col("t") / span).alias("_w"))
    a = a.withColumn("_new", F.when(F.col("t") - F.lag("t").over(w) <= gap, 0).otherwise(1)).withColumn("_s", F.sum("_new").over(upto))
    part = a.groupBy(*keys, "_w", "_s").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("fixes"))
    v = Window.partitionBy(*keys).orderBy("start")
    part = part.withColumn("_new", F.when(F.col("start") - F.lag("end").over(v) <= gap, 0).otherwise(1)).withColumn(
        "_g", F.sum("_new").over(v.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return part.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("fixes").alias("fixes")).drop("_g")


def windowed_cell_counts(steps: DataFrame, keys: Sequence[str], size: float, duration: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows per cell and time window (batch or stream; a stream sets its watermark first)."""
    win = F.window(ts, duration, slide) if slide else F.window(ts, duration)
    return steps.groupBy(win.alias("w"), *keys, cell("x", size).alias("cx"), cell("y", size).alias("cy")).agg(F.count(F.lit(1)).alias("points")).select(
        F.col("w.start").alias("window_start"), *keys, "cx", "cy", "points")
