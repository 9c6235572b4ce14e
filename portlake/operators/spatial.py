"""Nearest-feature, radius and cell joins for object tables (columns x, y in metres)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import axial, axial_diff
from ..grid import around, cell, near_segments, nearest_features, nearest_position, sq_dist, with_radius_sums
from ..ordered import quantiles
from ..session import cut

# fixed values: names of where a channel angle comes from
FROM_FAIRWAY, FROM_TRAFFIC = "osm_fairway", "ais_traffic"

# fixed values: reach of a layer distance, facility buffer, line reach, fairway width, field anisotropy
LAYER_REACH = 2000.0
FACILITY_BUFFER = 25.0
LINE_REACH = 100.0
MIN_ANISOTROPY = 1.5
DENSITY_RADII = {"r500": 500.0, "r1000": 1000.0}
HEADING_RADIUS = 1000.0
NEAR_DUPLICATE = 10.0


def nearest_by_layer(points: DataFrame, segs: DataFrame, group: Sequence[str], layers: Sequence[str], layer: str, reach: float, area: str | None, rest: bool = False) -> DataFrame:
    """One row per position (group, x, y) near a feature: `d_<layer>`, the distance to the nearest of each layer within `reach`, and `d_any` if `rest`.

    Layers are looked up side by side, as one more column of the group; with `rest`, what is in none of them is a layer of its own."""
    name = F.col(layer)
    known = F.when(name.isin(list(layers)), F.array_position(F.array(*[F.lit(n) for n in layers]), name).cast("int")).otherwise(0)
    s = segs.withColumn("_layer", known)
    if not rest:
        s = s.where("_layer > 0")
    p = points.select(*group, "x", "y").distinct().withColumn("_layer", F.explode(F.array(*[F.lit(k) for k in range(0 if rest else 1, len(layers) + 1)])))
    near = nearest_features(p, s, [*group, "_layer"], reach, (), area)
    return near.groupBy(*group, "x", "y").agg(
        *[F.min(F.when(F.col("_layer") == k, F.col("dist"))).alias(f"d_{n}") for k, n in enumerate(layers, 1)], *([F.min("dist").alias("d_any")] if rest else []))


def nearest_within(points: DataFrame, segs: DataFrame, group: Sequence[str], key: str, layers: Sequence[str], layer: str = "layer",
                   reach: float = LAYER_REACH, area: str | None = None) -> DataFrame:
    """Distance to the nearest feature of each layer, capped at `reach`: columns `d_<layer>`; 0 inside an area."""
    d = nearest_by_layer(points, segs, group, layers, layer, reach, area)
    return points.join(d, [*group, "x", "y"], "left").select(*points.columns, *[F.coalesce(f"d_{n}", F.lit(float(reach))).alias(f"d_{n}") for n in layers])


def facility_hit(points: DataFrame, segs: DataFrame, group: Sequence[str], key: str, attrs: Sequence[str], id_col: str,
                 buffer: float = FACILITY_BUFFER, area: str | None = None) -> DataFrame:
    """Nearest feature within `buffer` of each point with its attributes; null when none (ties to the smallest id)."""
    order = [id_col, *[a for a in attrs if a != id_col]]
    best = nearest_features(points, segs, group, buffer, order, area)
    return points.join(best, [*group, "x", "y"], "left").select(*points.columns, "dist", *order)


def nearest_field_cell(points: DataFrame, cells: DataFrame, group: Sequence[str], key: str, reach: float = LAYER_REACH) -> DataFrame:
    """Nearest field cell (cell_x, cell_y, points, direction, anisotropy) within `reach`, null when none."""
    segs = cells.withColumns({"x1": F.col("cell_x"), "x2": F.col("cell_x"), "y1": F.col("cell_y"), "y2": F.col("cell_y")})
    near = near_segments(points.select(key, *group, "x", "y"), segs, group, reach)
    best = near.groupBy(key).agg(F.min(F.struct("dist", "cell_x", "cell_y", "points", "direction", "anisotropy")).alias("b"))
    return points.join(best.select(key, "b.*"), key, "left")


def field_angle(points: DataFrame, cells: DataFrame, group: Sequence[str], key: str, axis: str = "axis_deg", reach: float = LAYER_REACH) -> DataFrame:
    """Angle between an object's axis and the traffic direction; only the nearest cell is asked, and it must be anisotropic."""
    n = nearest_field_cell(points, cells, group, key, reach)
    angle = F.when(F.col("anisotropy") >= MIN_ANISOTROPY, axial_diff(F.col(axis), F.col("direction")))
    return n.select(*points.columns, angle.alias("field_angle"))


def channel_angle(points: DataFrame, lines: DataFrame, cells: DataFrame, group: Sequence[str], key: str, line_id: str,
                  axis: str = "axis_deg", reach: float = LINE_REACH, field_reach: float = LAYER_REACH) -> DataFrame:
    """Angle to the nearest line within `reach`, else to the traffic field, with the source named."""
    near = near_segments(points.select(key, *group, "x", "y"), lines.select(*group, line_id, "x1", "y1", "x2", "y2"), group, reach)
    bearing = axial(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))))
    best = near.groupBy(key).agg(F.min(F.struct("dist", F.col(line_id), bearing.alias("bearing"))).alias("b"))
    out = field_angle(points, cells, group, key, axis, field_reach).join(best, key, "left")
    line = axial_diff(F.col(axis), F.col("b.bearing"))
    return out.select(
        *points.columns, F.coalesce(line, "field_angle").alias("channel_angle"),
        F.when(line.isNotNull(), FROM_FAIRWAY).when(F.col("field_angle").isNotNull(), FROM_TRAFFIC).alias("angle_source"))


def radius_counts(df: DataFrame, group: Sequence[str], radii: Mapping[str, float] = DENSITY_RADII) -> DataFrame:
    """Other objects of the same group within each radius: columns `n_<r>`."""
    out = with_radius_sums(df, group, radii)
    return out.withColumns({f"n_{r}": F.col(f"n_{r}") - 1 for r in radii})


def nn_distance(df: DataFrame, group: Sequence[str], first: float = 50.0) -> DataFrame:
    """Distance to the nearest other object of the group (`nn`), null for a lone object."""
    return df.join(nearest_position(df, group, first=first), [*group, "x", "y"], "left")


def near_duplicates(df: DataFrame, scene: str, pol: str, tile: str, radius: float = NEAR_DUPLICATE) -> DataFrame:
    """Unordered pairs within `radius` in a scene, split by polarisation and tile, and the rows they involve.

    The split follows from three radius counts (whole scene, same polarisation, same polarisation and tile);
    no pair is materialised.
    """
    r = {"r": radius}
    everywhere = with_radius_sums(df, [scene], r).agg(
        F.count(F.lit(1)).alias("rows"), (F.sum(F.col("n_r") - 1) / 2).cast("long").alias("pairs"), F.count_if(F.col("n_r") > 1).alias("rows_in_pairs"))
    half = lambda g, n: with_radius_sums(df, g, r).agg((F.sum(F.col("n_r") - 1) / 2).cast("long").alias(n))
    # three one-row results
    one = everywhere.crossJoin(half([scene, pol], "same_pol")).crossJoin(half([scene, pol, tile], "same_tile"))
    return one.select(
        "rows", "pairs", (F.col("pairs") - F.col("same_pol")).alias("cross_pol"), (F.col("same_pol") - F.col("same_tile")).alias("cross_tile"),
        "same_tile", "rows_in_pairs", (F.col("pairs") / F.col("rows")).alias("pair_ratio"))


def heading_dispersion(df: DataFrame, group: Sequence[str], axis: str = "axis_deg", radius: float = HEADING_RADIUS, min_n: int = 3,
                       null_as_zero: bool = False) -> DataFrame:
    """Circular spread (degrees) of neighbouring axes within `radius`, self included; needs `min_n` axes."""
    a = F.coalesce(F.col(axis), F.lit(0.0)) if null_as_zero else F.col(axis)
    th = F.radians(2.0 * a)
    vals = {"axes": F.when(a.isNotNull(), F.lit(1)), "sn": F.sin(th), "cs": F.cos(th)}
    r = with_radius_sums(df, group, {"h": radius}, vals)
    n = F.col("axes_h")
    length = F.hypot(F.col("sn_h") / n, F.col("cs_h") / n)
    spread = F.degrees(F.sqrt(F.greatest(F.lit(0.0), -2.0 * F.log(F.least(F.lit(1.0), length))))) / 2.0
    return r.select(*df.columns, F.when((n >= min_n) & (length > 0), spread).alias("heading_spread"))


def sample_cells(points: DataFrame, cells: DataFrame, group: Sequence[str], size: float, value: str, default: int = -1) -> DataFrame:
    """Value of the grid cell that holds each point."""
    p = points.withColumns({"cx": cell("x", size), "cy": cell("y", size)})
    return p.join(cells.select(*group, "cx", "cy", value), [*group, "cx", "cy"], "left").withColumn(
        value, F.coalesce(value, F.lit(default))).drop("cx", "cy")


def nearshore_filter(vessels: DataFrame, land: DataFrame, group: Sequence[str], key: str, radius: Column) -> DataFrame:
    """Drop vessels with land closer than their own radius.

    Each vessel looks in a grid whose cell is the power of two above its radius; land points are listed in the
    grids that occur, so no radius is capped.
    """
    v = vessels.withColumn("_r", radius).withColumn("_lv", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("_r"), F.lit(1.0))))).cast("int"))
    levels = v.select("_lv").distinct()
    size = F.pow(F.lit(2.0), F.col("_lv"))
    at = lambda c: F.floor(F.col(c) / size)
    # `levels` has at most one row per power of two
    lp = around(land.select(*group, "lx", "ly").join(F.broadcast(levels)).withColumns({"cx": at("lx"), "cy": at("ly")}), "cx", "cy")
    hit = v.withColumns({"cx": at("x"), "cy": at("y")}).join(lp, [*group, "_lv", "cx", "cy"]).where(
        sq_dist("x", "y", "lx", "ly") <= F.col("_r") * F.col("_r")).select(key).distinct()
    return vessels.join(hit, key, "left_anti")


def frame_calibrate(df: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Map x, y to lon, lat per port: scale by the ratio of spans, shift so that the median lands on the centre.

    `boxes`: key, lon0, lon1, lat0, lat1, centre_lon, centre_lat.
    """
    span = df.groupBy(key).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    mx = quantiles(df, [key], "x", {"mx": 0.5}).drop("n")
    my = quantiles(df, [key], "y", {"my": 0.5}).drop("n")
    tiny = F.lit(1e-9)
    cal = span.join(mx, key).join(my, key).join(boxes, key).select(
        key,
        ((F.col("lon1") - F.col("lon0")) / F.greatest(tiny, F.col("x1") - F.col("x0"))).alias("sx"),
        ((F.col("lat1") - F.col("lat0")) / F.greatest(tiny, F.col("y1") - F.col("y0"))).alias("sy"), "mx", "my", "centre_lon", "centre_lat")
    return df.join(cal, key).select(
        *df.columns,
        (F.col("centre_lon") + (F.col("x") - F.col("mx")) * F.col("sx")).alias("lon"),
        (F.col("centre_lat") + (F.col("y") - F.col("my")) * F.col("sy")).alias("lat"))


def hotspot_cell(df: DataFrame, key: str, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Most populated cell per key (ties to the smallest cell)."""
    c = df.groupBy(key, cell(x, size).alias("cx"), cell(y, size).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("neg"), "cx", "cy")).alias("b")).select(
        key, "b.cx", "b.cy", (-F.col("b.neg")).alias("n"))


def proximity_by_group(points: DataFrame, segs: DataFrame, group: Sequence[str], key: str, kinds: Sequence[str], kind: str = "kind",
                       reach: float = LAYER_REACH, area: str | None = None) -> DataFrame:
    """Nearest feature of each kind and of any kind within `reach`, 0 inside an area; rows with none in reach are dropped."""
    d = nearest_by_layer(points, segs, group, kinds, kind, reach, area, rest=True)
    return points.join(d, [*group, "x", "y"]).select(*points.columns, *[f"d_{k}" for k in kinds], "d_any")


def components(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Connected components: `node`, `component` (smallest node of the component). `edges` has columns a, b.

    Each round takes the smallest label among the neighbours and then the label of the label, so a chain of
    length n needs about log n rounds.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct())
    lab = cut(nodes.select(F.col(node).alias("v")).distinct().withColumn("l", F.col("v")))
    while True:
        seen = both.join(lab, both.b == lab.v).groupBy("a").agg(F.min("l").alias("m"))
        step = lab.join(seen, lab.v == seen.a, "left").select("v", F.least("l", F.coalesce("m", "l")).alias("l"), F.col("l").alias("old"))
        step = cut(step)
        jump = step.alias("s").join(step.select(F.col("v").alias("w"), F.col("l").alias("ll")), F.col("s.l") == F.col("w")).select(
            "v", F.least("l", "ll").alias("l"), "old")
        jump = cut(jump)
        lab = jump.select("v", "l")
        if jump.where("l <> old").isEmpty():
            return lab.select(F.col("v").alias(node), F.col("l").alias("component"))


def near_components(df: DataFrame, group: Sequence[str], key: str, radius: float) -> DataFrame:
    """`key`, `component`: objects of a group chained together by gaps of at most `radius`.

    Objects inside one cell of diagonal `radius` are always together, so cells are the graph nodes; two cells are
    linked when some pair of their positions is close enough.
    """
    size = radius / 1.4142135623730951
    pos = df.groupBy(*group, "x", "y").agg(F.min(key).alias("k")).withColumns({"cx": cell("x", size), "cy": cell("y", size)})
    pos = cut(pos)
    boxes = pos.groupBy(*group, "cx", "cy").agg(
        F.min("k").alias("node"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    boxes = cut(boxes)
    b = boxes.select(*group, "cx", "cy", *[F.col(c).alias("b" + c) for c in ("node", "x0", "x1", "y0", "y1")])
    pairs = around(boxes.withColumns({"ax": F.col("cx"), "ay": F.col("cy")}), "cx", "cy", 2).join(b, [*group, "cx", "cy"]).where("node < bnode")
    near = lambda t: F.greatest(F.col(f"b{t}0") - F.col(f"{t}1"), F.col(f"{t}0") - F.col(f"b{t}1"), F.lit(0.0))
    far = lambda t: F.greatest(F.col(f"b{t}1") - F.col(f"{t}0"), F.col(f"{t}1") - F.col(f"b{t}0"))
    pairs = cut(pairs.withColumns({"mn": near("x") * near("x") + near("y") * near("y"), "mx": far("x") * far("x") + far("y") * far("y")}).where(
        F.col("mn") <= radius * radius))
    sure = pairs.where(F.col("mx") <= radius * radius).select(F.col("node").alias("a"), F.col("bnode").alias("b"))
    unsure = pairs.where(F.col("mx") > radius * radius).select(*group, "ax", "ay", F.col("cx").alias("bx"), F.col("cy").alias("by"), "node", "bnode")
    p = pos.select(*group, F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("x").alias("px"), F.col("y").alias("py"))
    q = pos.select(*group, F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    linked = unsure.join(p, [*group, "ax", "ay"]).join(q, [*group, "bx", "by"]).where(
        sq_dist("px", "py", "qx", "qy") <= radius * radius).select(F.col("node").alias("a"), F.col("bnode").alias("b")).distinct()
    comp = components(boxes, sure.union(linked), "node")
    cells = boxes.select(*group, "cx", "cy", "node").join(comp, "node").drop("node")
    return df.withColumns({"cx": cell("x", size), "cy": cell("y", size)}).join(cells, [*group, "cx", "cy"]).select(key, "component")
