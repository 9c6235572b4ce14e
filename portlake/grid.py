"""Spatial joins as equi-joins on grid cells followed by an exact predicate.

Sums over a radius compare blocks of positions as arrays (`discs`): boxes meet first, so a crowded berth is added as one number and only
what straddles a circle is opened up to positions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .discs import disc_sums
from .ordered import running
from .session import cut

#: Blocks of positions a group, and the positions of a block.
BLOCKS, BLOCK_LEAST, BLOCK_MOST = 8, 2048, 1 << 18
#: Positions in the cell of a position, above which a search for the nearest one begins with smaller cells.
CROWD = 16.0


def cell(c: Column | str, size: float) -> Column:
    """Index of the grid cell that holds a coordinate."""
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(float(size)))


def around(df: DataFrame, cx: str, cy: str, reach: int = 1) -> DataFrame:
    """Replace (cx, cy) by every cell at most `reach` cells away."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    return (
        df.withColumn("_dx", F.explode(span)).withColumn("_dy", F.explode(span))
        .withColumn(cx, F.col(cx) + F.col("_dx")).withColumn(cy, F.col(cy) + F.col("_dy")).drop("_dx", "_dy")
    )


def sq_dist(x1, y1, x2, y2) -> Column:
    """Squared planar distance."""
    dx, dy = F.col(x1) - F.col(x2), F.col(y1) - F.col(y2)
    return dx * dx + dy * dy


def radius_sums(
    df: DataFrame, group: Sequence[str], radii: Mapping[str, float], values: Mapping[str, Column] | None = None,
    x: str = "x", y: str = "y", least: int = BLOCK_LEAST, most: int = BLOCK_MOST,
) -> DataFrame:
    """One row per distinct (group, x, y): for each radius, `n_<r>` rows and `<value>_<r>` sums over all rows
    of the group within it, the position's own rows included.  Output columns start with the group and x, y.

    Positions are dealt by place into blocks: `BLOCKS` a group, but of at least `least` and at most `most` positions, so a position travels
    at most 2 x `BLOCKS` times in groups of up to `BLOCKS` x `most` positions.  A block that all discs of another hold whole, or none
    touches, does not travel; the other pairs of blocks are one task each, which returns sums.  Whole numbers are exact up to 2^53.
    """
    group, bounds = list(group), list(radii.values())
    vals = {"n": F.lit(1).cast("long"), **dict(values or {})}
    v, big = [f"_v{k}" for k in range(len(vals))], max(bounds)
    parts = [f"_p{i}_{k}" for i in range(len(bounds)) for k in range(len(vals))]
    pos = cut(df.groupBy(*group, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(*[F.sum(e).alias(c) for c, e in zip(v, vals.values())]))
    placed = F.coalesce((F.abs("_x") < float("inf")) & (F.abs("_y") < float("inf")), F.lit(False))
    ranked = running(pos.where(placed), group, [cell("_x", big), F.col("_y"), F.col("_x")])
    size = F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col("n") / BLOCKS)))
    dealt = cut(ranked.select(*group, "_x", "_y", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in v], F.floor((F.col("rn") - 1) / size).alias("_b")))
    blocks = dealt.groupBy(*group, "_b").agg(
        F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"), *[F.sum(c).alias(c) for c in v])
    a = blocks.select(*group, F.col("_b").alias("_i"), *[F.col(c).alias("a" + c) for c in ("x0", "x1", "y0", "y1")])
    b = blocks.select(*group, F.col("_b").alias("_j"), *[F.col(c).alias("b" + c) for c in ("x0", "x1", "y0", "y1")], *v)
    near = lambda t: F.greatest(F.col(f"b{t}0") - F.col(f"a{t}1"), F.col(f"a{t}0") - F.col(f"b{t}1"), F.lit(0.0))
    far = lambda t: F.greatest(F.col(f"b{t}1") - F.col(f"a{t}0"), F.col(f"a{t}1") - F.col(f"b{t}0"))
    pairs = a.join(b, group).withColumns(
        {"min2": near("x") * near("x") + near("y") * near("y"), "max2": far("x") * far("x") + far("y") * far("y")}
    ).where(F.col("min2") <= big * big)
    rim = F.lit(False)
    for r in bounds:
        rim = rim | (F.col("min2") <= r * r) & (F.col("max2") > r * r)
    pairs = cut(pairs.withColumn("rim", rim))
    whole = pairs.where("NOT rim").groupBy(*group, F.col("_i").alias("_b")).agg(
        *[F.sum(F.when(F.col("max2") <= r * r, F.col(c))).alias("_w" + p) for p, (r, c) in zip(parts, [(r, c) for r in bounds for c in v])])
    opened = pairs.where("rim").select(*group, "_i", "_j")
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def meet(side: str, tag: str):
        rows = dealt.withColumnRenamed("_b", side).join(opened, [*group, side])
        rows = rows.select(*[F.col(c).alias(tag + c) for c in (*group, "_i", "_j", "_x", "_y", *v)])
        keys = [tag + c for c in (*group, "_i", "_j")]
        return rows.repartition(tasks, *keys).groupBy(*keys)

    schema = T.StructType([*[dealt.schema[g] for g in group], *[T.StructField(c, T.DoubleType()) for c in ("_x", "_y", *parts)]])

    def block_sums(left: pa.Table, right: pa.Table) -> pa.Table:
        q, d = ([t.column(tag + c).to_numpy() for c in ("_x", "_y", *v)] for t, tag in ((left, "l"), (right, "r")))
        sums = disc_sums(q[0], q[1], d[0], d[1], np.stack(d[2:], 1), [r * r for r in bounds])
        out = left.select(["l" + c for c in (*group, "_x", "_y")]).rename_columns([*group, "_x", "_y"])
        for p, c in zip(parts, sums.transpose(0, 2, 1).reshape(len(parts), -1)):
            out = out.append_column(p, pa.array(c))
        return out

    partial = meet("_i", "l").cogroup(meet("_j", "r")).applyInArrow(block_sums, schema).groupBy(*group, "_x", "_y").agg(*[F.sum(p).alias(p) for p in parts])
    zero = F.lit(0.0)
    out = dealt.select(*group, "_x", "_y", "_b").join(whole, [*group, "_b"], "left").join(partial, [*group, "_x", "_y"], "left")
    out = out.select(*group, "_x", "_y", *[(F.coalesce(F.col("_w" + p), zero) + F.coalesce(F.col(p), zero)).alias(p) for p in parts])
    out = out.unionByName(pos.where(~placed).select(*group, "_x", "_y", *[zero.alias(p) for p in parts]))
    names = [(f"{name}_{r}", pos.schema[c].dataType) for r in radii for name, c in zip(vals, v)]
    return out.select(*group, F.col("_x").alias(x), F.col("_y").alias(y), *[F.col(p).cast(kind).alias(name) for p, (name, kind) in zip(parts, names)])


def with_radius_sums(df, group, radii, values=None, x="x", y="y", rows: DataFrame | None = None) -> DataFrame:
    """`radius_sums` joined back onto the rows of `df`."""
    return df.join(radius_sums(df if rows is None else rows, group, radii, values, x, y), [*group, x, y], "left")


def nearest_position(df: DataFrame, group: Sequence[str], x: str = "x", y: str = "y", first: float = 50.0, steps: int = 3, crowd: float = CROWD) -> DataFrame:
    """One row per distinct (group, x, y) with `nn`: distance to the nearest other row of the group.

    Positions shared by several rows have distance 0.  The rest climb a ladder of cell sizes, each eight
    times the last; a distance no larger than the cell is final.  Where the cell of a position holds more than `crowd` positions on average,
    the ladder begins eight times finer, and again, 64 steps at most.  Positions still open after the ladder are compared
    with the boxes of occupied coarse cells, and only cells that can hold the nearest row are opened.
    """
    group = list(group)
    pos = cut(df.groupBy(*group, x, y).agg(F.count(F.lit(1)).alias("_n")))
    done = pos.where("_n > 1").select(*group, x, y, F.lit(0.0).alias("nn"))
    rest = pos.where("_n = 1").select(*group, x, y)
    q = pos.select(*group, F.col(x).alias("qx"), F.col(y).alias("qy"))
    not_self = (F.col("qx") != F.col(x)) | (F.col("qy") != F.col(y))
    size = first
    while steps < 64:
        met = pos.groupBy(*group, cell(x, size), cell(y, size)).agg(F.count(F.lit(1)).cast("double").alias("m")).agg(F.sum(F.col("m") * F.col("m")) / F.sum("m"))
        if (met.first()[0] or 0.0) <= crowd:
            break
        size, steps = size / 8, steps + 1
    for _ in range(steps):
        cells = q.withColumns({"cx": cell("qx", size), "cy": cell("qy", size)})
        probe = around(rest.withColumns({"cx": cell(x, size), "cy": cell(y, size)}), "cx", "cy")
        found = probe.join(cells, [*group, "cx", "cy"]).where(not_self).groupBy(*group, x, y).agg(F.min(sq_dist(x, y, "qx", "qy")).alias("d2"))
        found = cut(found.where(F.col("d2") <= size * size).select(*group, x, y, F.sqrt("d2").alias("nn")))
        done = done.unionByName(found)
        rest = cut(rest.join(found.select(*group, x, y), [*group, x, y], "left_anti"))
        if rest.isEmpty():
            return done
        size *= 8
    big = q.withColumns({"cx": cell("qx", size), "cy": cell("qy", size)})
    boxes = big.groupBy(*group, "cx", "cy").agg(
        F.min("qx").alias("x0"), F.max("qx").alias("x1"), F.min("qy").alias("y0"), F.max("qy").alias("y1"), F.count(F.lit(1)).alias("m"))
    near = lambda c, t: F.greatest(F.col(f"{t}0") - F.col(c), F.col(c) - F.col(f"{t}1"), F.lit(0.0))
    far = lambda c, t: F.greatest(F.col(f"{t}1") - F.col(c), F.col(c) - F.col(f"{t}0"))
    # a box holding only the position itself says nothing about its neighbours
    alone = (F.col("m") == 1) & (F.col("x0") == F.col(x)) & (F.col("y0") == F.col(y))
    cand = rest.join(boxes, group).where(~alone).withColumns({
        "min2": near(x, "x") * near(x, "x") + near(y, "y") * near(y, "y"),
        "max2": far(x, "x") * far(x, "x") + far(y, "y") * far(y, "y"),
    })
    bound = cand.groupBy(*group, x, y).agg(F.min("max2").alias("bound"))
    open_cells = cand.join(bound, [*group, x, y]).where("min2 <= bound").select(*group, x, y, "cx", "cy")
    last = open_cells.join(big, [*group, "cx", "cy"]).where(not_self).groupBy(*group, x, y).agg(F.sqrt(F.min(sq_dist(x, y, "qx", "qy"))).alias("nn"))
    return done.unionByName(rest.join(last, [*group, x, y], "left").select(*group, x, y, "nn"))


def segment_distance(px="x", py="y", x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    """Distance from a point to a segment (a point when both ends coincide)."""
    px, py, x1, y1, x2, y2 = (F.col(c) for c in (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    t = F.when(len2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / len2)))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def cover_cells(segs: DataFrame, size: float, reach: float) -> DataFrame:
    """Repeat each segment for every cell of `size` its box, grown by `reach`, touches and that lies near it."""
    low, high, flat = F.least("y1", "y2"), F.greatest("y1", "y2"), F.col("y1") == F.col("y2")
    out = segs.withColumn("cy", F.explode(F.sequence(cell(low - F.lit(float(reach)), size), cell(high + F.lit(float(reach)), size))))
    # what of the segment lies within reach of the row
    at = lambda y: F.col("x1") + F.try_divide((F.col("x2") - F.col("x1")) * (F.greatest(low, F.least(high, y)) - F.col("y1")), F.col("y2") - F.col("y1"))
    a, b = F.when(flat, F.col("x1")).otherwise(at(F.col("cy") * size - 1.001 * reach)), F.when(flat, F.col("x2")).otherwise(at((F.col("cy") + 1) * size + 1.001 * reach))
    slack = 1.001 * reach + 1e-6 * size
    out = out.withColumn("cx", F.explode(F.sequence(cell(F.least(a, b) - slack, size), cell(F.greatest(a, b) + slack, size))))
    # of these, keep those whose centre is within reach + half diagonal
    centre = out.withColumns({"_mx": (F.col("cx") + 0.5) * size, "_my": (F.col("cy") + 0.5) * size})
    return centre.where(segment_distance("_mx", "_my") <= reach + size).drop("_mx", "_my")


def near_segments(points: DataFrame, segs: DataFrame, group: Sequence[str], reach: float, size: float = 0.0) -> DataFrame:
    """Pairs of point row and segment row of the same group at distance `dist` <= reach (segments are repeated
    over cells of `size`, `reach` at least; points are not)."""
    size = max(size, reach)
    p = points.withColumns({"cx": cell("x", size), "cy": cell("y", size)})
    s = cover_cells(segs, size, reach)
    return p.join(s, [*group, "cx", "cy"]).withColumn("dist", segment_distance()).where(F.col("dist") <= reach).drop("cx", "cy")


#: Cells by the size of an area: a side of at most 16 cells of its level, the last level whatever its side.
AREA_LEVELS = 4


def edge_cells(rings: DataFrame, group: Sequence[str], area: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An index of ring edges: the frame of each area, its edges by the cells they touch, its edges by the middle lines they cross.

    Each area has a grid of its own, from its corner (ox, oy), whose steps hx and hy are its mean edge's extents along the two axes.
    So n edges touch some 4 n cells and cross some n middle lines, whatever the area's shape.
    """
    group = list(group)
    rings = rings.where("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL").select(*group, area, "x1", "y1", "x2", "y2")
    along = lambda c: F.sum(F.abs(F.col(f"{c}2") - F.col(f"{c}1"))) / F.count(F.lit(1))
    lo, hi = (lambda c: F.min(F.least(f"{c}1", f"{c}2"))), (lambda c: F.max(F.greatest(f"{c}1", f"{c}2")))
    step = lambda c: F.when(along(c) > 0, along(c)).otherwise(1.0)
    frame = rings.groupBy(*group, area).agg(
        lo("x").alias("ox"), lo("y").alias("oy"), hi("x").alias("ex"), hi("y").alias("ey"), step("x").alias("hx"), step("y").alias("hy"))
    edges = cut(rings.join(frame, [*group, area]))
    frame = cut(frame)
    row = lambda y: F.floor((y - F.col("oy")) / F.col("hy"))
    column = lambda x: F.floor((x - F.col("ox")) / F.col("hx"))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    slack = 1e-6  # of a cell, for what rounding may shift
    spread = edges.withColumn("cy", F.explode(F.sequence(row(low - slack * F.col("hy")), row(high + slack * F.col("hy")))))
    flat = F.col("y1") == F.col("y2")
    part = lambda y: F.when(flat, F.col("x1")).otherwise(F.col("x1") + F.try_divide((F.col("x2") - F.col("x1")) * (F.greatest(low, F.least(high, y)) - F.col("y1")), F.col("y2") - F.col("y1")))
    begin, end = part(F.col("oy") + (F.col("cy") - slack) * F.col("hy")), F.when(flat, F.col("x2")).otherwise(part(F.col("oy") + (F.col("cy") + 1 + slack) * F.col("hy")))
    cells = spread.withColumn("cx", F.explode(F.sequence(column(F.least(begin, end) - slack * F.col("hx")), column(F.greatest(begin, end) + slack * F.col("hx")))))
    middle = F.col("oy") + (F.col("cy") + 0.5) * F.col("hy")
    lines = spread.withColumn("ym", middle).where((F.col("y1") > F.col("ym")) != (F.col("y2") > F.col("ym"))).select(*group, area, "cy", _meets("ym").alias("x"))
    return frame, cells.select(*group, area, "cx", "cy", "x1", "y1", "x2", "y2"), lines


def _meets(y: str) -> Column:
    """Where the line through an edge is at height `y`."""
    return F.try_divide((F.col("x2") - F.col("x1")) * (F.col(y) - F.col("y1")), F.col("y2") - F.col("y1")) + F.col("x1")


def inside_areas(points: DataFrame, rings: DataFrame, group: Sequence[str], key: str, area: str, size: float = 1000.0) -> DataFrame:
    """(`key`, `area`) for every point that lies in an area of its group by the even-odd rule over all its rings.

    `rings` has the ring segments x1, y1, x2, y2 of each area; a hole is one more ring, every ring is closed.  A large area is looked up
    in larger cells, so that it is repeated over a bounded number of them.  A point asks the edges of its own cell only: the
    crossings right of the middle of each asked cell come from one running count over the middle line, and the way from a point
    to that middle, along y and then along x, stays in the cell.  A point on an edge may count as inside or not; its distance is 0
    in either case.
    """
    group = list(group)
    frame, cells, lines = edge_cells(rings, group, area)
    side = F.greatest(F.col("ex") - F.col("ox"), F.col("ey") - F.col("oy"))
    level = F.greatest(F.lit(0.0), F.least(F.lit(float(AREA_LEVELS - 1)), F.ceil(F.log(16.0, F.greatest(side, F.lit(1.0)) / (16 * size)))))
    box = frame.withColumn("lv", level.cast("int")).withColumn("step", size * F.pow(F.lit(16.0), F.col("lv")))
    at = lambda c: F.floor(F.col(c) / F.col("step")).cast("long")
    box = box.withColumn("bx", F.explode(F.sequence(at("ox"), at("ex")))).withColumn("by", F.explode(F.sequence(at("oy"), at("ey")))).drop("step")
    levels = F.array(*[F.struct(F.lit(k).alias("lv"), F.lit(size * 16.0**k).alias("step")) for k in range(AREA_LEVELS)])
    probe = points.select(key, *group, F.col("x").alias("px"), F.col("y").alias("py"), F.explode(levels).alias("l")).select("*", "l.lv", "l.step").drop("l")
    probe = probe.withColumns({"bx": at("px"), "by": at("py")}).drop("step")
    held = probe.join(box, [*group, "lv", "bx", "by"]).where("px between ox and ex and py between oy and ey")
    held = held.withColumns({"cx": F.floor((F.col("px") - F.col("ox")) / F.col("hx")), "cy": F.floor((F.col("py") - F.col("oy")) / F.col("hy"))})
    held = cut(held.withColumns({"xm": F.col("ox") + (F.col("cx") + 0.5) * F.col("hx"), "ym": F.col("oy") + (F.col("cy") + 0.5) * F.col("hy")})
               .select(key, *group, area, "px", "py", "cx", "cy", "xm", "ym"))
    # crossings right of each middle: a running count from the right, middles before crossings at the same x
    asked = held.select(*group, area, "cy", "cx", F.col("xm").alias("x")).distinct()
    line = Window.partitionBy(*group, area, "cy").orderBy(F.col("x").desc(), F.col("hit")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = asked.withColumn("hit", F.lit(0)).unionByName(lines.select(*group, area, "cy", F.lit(None).cast("long").alias("cx"), "x", F.lit(1).alias("hit")))
    right = marks.withColumn("right", F.sum("hit").over(line)).where("hit = 0").select(*group, area, "cx", "cy", (F.col("right") % 2).alias("odd"))
    # crossings on the way to the middle, by the edges of the cell
    level = F.try_divide((F.col("y2") - F.col("y1")) * (F.col("px") - F.col("x1")), F.col("x2") - F.col("x1")) + F.col("y1")
    up = ((F.col("x1") > F.col("px")) != (F.col("x2") > F.col("px"))) & ((level > F.col("py")) != (level > F.col("ym")))
    over = ((F.col("y1") > F.col("ym")) != (F.col("y2") > F.col("ym"))) & ((F.col("px") < _meets("ym")) != (F.col("xm") < _meets("ym")))
    flips = held.join(cells, [*group, area, "cx", "cy"]).groupBy(key, *group, area, "px", "py").agg((F.sum(up.cast("int") + over.cast("int")) % 2).alias("flip"))
    told = held.join(right, [*group, area, "cx", "cy"]).join(flips, [key, *group, area, "px", "py"], "left")
    return told.where((F.col("odd") + F.coalesce("flip", F.lit(0))) % 2 == 1).select(key, area)


#: Side of the cells in which areas cover points, and how many of them an area spans before it moves to cells 16 times as large.
COVER_CELL, COVER_SPAN = 250.0, 64
_EPS = 1e-6  # of a cell, for what rounding may shift


def ring_rows(rings: DataFrame, group: Sequence[str], area: str, size: float = COVER_CELL) -> DataFrame:
    """Ring edges by the rows `cy` of cells they touch, in cells of the area's level `lv`: the first and last cell c0, c1 touched
    there, the row's middle line `ym` and whether the edge crosses it (`hit`)."""
    whole = Window.partitionBy(*group, area)
    span = lambda c: F.max(F.greatest(f"{c}1", f"{c}2")).over(whole) - F.min(F.least(f"{c}1", f"{c}2")).over(whole)
    level = F.ceil(F.log(16.0, F.greatest(span("x"), span("y"), F.lit(1.0)) / (COVER_SPAN * size)))
    r = rings.where("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL")
    r = r.withColumn("lv", F.greatest(F.lit(0), F.least(F.lit(AREA_LEVELS - 1), level)).cast("int")).withColumn("step", size * F.pow(F.lit(16.0), F.col("lv")))
    low, high, flat = F.least("y1", "y2"), F.greatest("y1", "y2"), F.col("y1") == F.col("y2")
    r = r.withColumn("cy", F.explode(F.sequence(F.floor(low / F.col("step") - _EPS), F.floor(high / F.col("step") + _EPS))))
    at = lambda y: F.col("x1") + F.try_divide((F.col("x2") - F.col("x1")) * (F.greatest(low, F.least(high, y * F.col("step"))) - F.col("y1")), F.col("y2") - F.col("y1"))
    a, b = F.when(flat, F.col("x1")).otherwise(at(F.col("cy") - _EPS)), F.when(flat, F.col("x2")).otherwise(at(F.col("cy") + 1 + _EPS))
    r = r.withColumns({"c0": F.floor(F.least(a, b) / F.col("step") - _EPS), "c1": F.floor(F.greatest(a, b) / F.col("step") + _EPS), "ym": (F.col("cy") + 0.5) * F.col("step")})
    return r.withColumn("hit", ((F.col("y1") > F.col("ym")) != (F.col("y2") > F.col("ym"))).cast("int"))


def covered_cells(rows: DataFrame, group: Sequence[str], area: str, rank: Sequence[str]) -> DataFrame:
    """Cells (lv, cx, cy) that lie whole inside an area, with the smallest `r` (struct of `rank`) of those areas.

    Between two cells that edges touch, a row of cells is inside where an odd number of edges cross its middle line before."""
    before = Window.partitionBy(*group, area, "lv", "cy").orderBy("c0", "c1").rowsBetween(Window.unboundedPreceding, -1)
    gaps = rows.withColumns({"_from": F.max("c1").over(before) + 1, "_to": F.col("c0") - 1, "_odd": F.sum("hit").over(before) % 2}).where("_from <= _to and _odd = 1")
    return gaps.withColumn("cx", F.explode(F.sequence("_from", "_to"))).groupBy(*group, "lv", "cx", "cy").agg(F.min(F.struct(*rank)).alias("r"))


def nearest_features(points: DataFrame, segs: DataFrame, group: Sequence[str], reach: float, rank: Sequence[str] = (), area: str | None = None,
                     size: float = COVER_CELL) -> DataFrame:
    """One row per distinct (group, x, y) with a feature within `reach`: `dist` to the nearest, and the smallest `rank` columns at that distance.

    `area` names the column of `segs` that tells the area whose ring a segment belongs to, null for points and lines; inside an area the
    distance is 0.  No pair of point and area is listed where an area covers the point's whole cell: of those areas only the one of
    smallest rank is kept, and only areas of smaller rank whose edges touch the cell are asked as well.  Points in no such cell
    climb a ladder of two distances, and only segments near them are spread over cells."""
    group, rank = list(group), list(rank)
    if not rank:
        segs, rank = segs.withColumn("_one", F.lit(0)), ["_one"]
    free = rank == ["_one"]
    spot = [*group, "x", "y"]
    pos = cut(points.where("x IS NOT NULL AND y IS NOT NULL").select(*spot).distinct())
    keep = [*group, *rank, "x1", "y1", "x2", "y2"]
    found = []
    open_ = pos
    if area is not None:
        rows = cut(ring_rows(segs.where(F.col(area).isNotNull()).select(*dict.fromkeys([*keep, area])), group, area, size))
        levels = rows.select("lv", "step").distinct()
        at = lambda c: F.floor(F.col(c) / F.col("step"))
        probe = lambda d: d.join(F.broadcast(levels)).withColumns({"cx": at("x"), "cy": at("y")})  # noqa: E731  (a few levels at most)
        cells = [*group, "lv", "cx", "cy"]
        full = cut(covered_cells(rows, group, area, rank))
        best = probe(pos).join(full, cells).groupBy(*spot).agg(F.min("r").alias("least"))
        todo = cut(pos.join(best, spot, "left"))
        found.append(todo.where("least IS NOT NULL").select(*spot, F.lit(0.0).alias("dist"), F.col("least").alias("r")))
        open_ = todo.where("least IS NULL").select(*spot)
        asking = open_.withColumn("least", F.lit(None).cast(todo.schema["least"].dataType)) if free else todo
        # what else can hold the points of a cell: areas whose edges touch it, of smaller rank than the one that covers it
        wanted = cut(probe(asking).groupBy(*cells).agg(F.max("least").alias("most"), F.bool_or(F.col("least").isNull()).alias("bare")))
        touched = rows.withColumn("cx", F.explode(F.sequence("c0", "c1"))).withColumn("r", F.struct(*rank)).join(wanted, cells).where("bare OR r < most")
        touched = cut(touched.select(*cells, F.col(area).alias("_a"), "r", "x1", "y1", "x2", "y2", ((F.col("cx") + 0.5) * F.col("step")).alias("xm"), "ym"))
        # crossings right of the middle of each asked cell: a running count from the right, middles before crossings at the same x
        row = [*group, "_a", "lv", "cy"]
        asked = touched.select(*row, "cx", F.col("xm").alias("mx")).distinct()
        lines = rows.where("hit = 1").select(*group, F.col(area).alias("_a"), "lv", "cy", _meets("ym").alias("mx")).join(asked.select(*row).distinct(), row, "left_semi")
        line = Window.partitionBy(*row).orderBy(F.col("mx").desc(), "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        marks = asked.withColumn("mark", F.lit(0)).unionByName(lines.withColumns({"mark": F.lit(1), "cx": F.lit(None).cast("long")}))
        odd = marks.withColumn("odd", F.sum("mark").over(line) % 2).where("mark = 0").select(*row, "cx", "odd")
        # crossings on the way from a point to that middle, along y and then along x
        level = F.try_divide((F.col("y2") - F.col("y1")) * (F.col("x") - F.col("x1")), F.col("x2") - F.col("x1")) + F.col("y1")
        up = ((F.col("x1") > F.col("x")) != (F.col("x2") > F.col("x"))) & ((level > F.col("y")) != (level > F.col("ym")))
        over = ((F.col("y1") > F.col("ym")) != (F.col("y2") > F.col("ym"))) & ((F.col("x") < _meets("ym")) != (F.col("xm") < _meets("ym")))
        told = probe(asking).join(touched, cells).where("least IS NULL OR r < least").groupBy(*spot, *[c for c in row if c not in group], "cx", "r").agg(
            (F.sum(up.cast("int") + over.cast("int")) % 2).alias("flip"), F.min(segment_distance()).alias("edge"))
        told = told.join(odd, [*row, "cx"]).where("(odd + flip) % 2 = 1 OR edge = 0")
        held = cut(told.groupBy(*spot).agg(F.min("r").alias("r")).select(*spot, F.lit(0.0).alias("dist"), "r"))
        found.append(held)
        if free:
            open_ = open_.join(held.select(*spot), spot, "left_anti")
        else:  # a point or line at distance 0 of smaller rank
            on = near_segments(todo.where("least IS NOT NULL"), segs.where(F.col(area).isNull()).select(*keep), group, 0.0, size)
            found.append(on.withColumn("r", F.struct(*rank)).where("r < least").groupBy(*spot).agg(F.min("r").alias("r")).select(*spot, F.lit(0.0).alias("dist"), "r"))
        open_ = cut(open_)
    for k, far in enumerate([reach / 8, reach]):
        side = max(far, size)
        here = open_.select(*group, cell("x", side).alias("cx"), cell("y", side).alias("cy")).distinct()
        cover = cover_cells(segs.select(*keep), side, far).join(here, [*group, "cx", "cy"], "left_semi").withColumn("r", F.struct(*rank))
        near = open_.withColumns({"cx": cell("x", side), "cy": cell("y", side)}).join(cover, [*group, "cx", "cy"]).withColumn("dist", segment_distance())
        near = cut(near.where(F.col("dist") <= far).groupBy(*spot).agg(F.min(F.struct("dist", "r")).alias("b")).select(*spot, "b.dist", "b.r"))
        found.append(near)
        if k == 0:
            open_ = cut(open_.join(near.select(*spot), spot, "left_anti"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    every = every.groupBy(*spot).agg(F.min(F.struct("dist", "r")).alias("b"))
    return every.select(*spot, "b.dist", *([] if free else ["b.r.*"]))
