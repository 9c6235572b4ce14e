"""Density, direction and land-cover fields built from the radius and nearest joins."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import around, with_radius_sums
from ..ordered import quantiles
from .spatial import near_components, nearest_field_cell, nn_distance, radius_counts

# fixed values: field radii and quay decay length
FIELD_RADII = {"near": 2000.0, "mid": 5000.0, "far": 10000.0}
QUAY_DECAY = 2000.0
CONTEXT_RADII = {"a": 250.0, "b": 500.0, "c": 1000.0, "d": 2000.0}
PORT_AREA_FACTOR = 50.0


def pooled_field(df: DataFrame, group: Sequence[str], key: str, radii: Mapping[str, float] = FIELD_RADII, axis: str = "axis_deg",
                 quay: str = "d_quay", decay: float = QUAY_DECAY, pool: DataFrame | None = None) -> DataFrame:
    """Eleven field quantities per object from counts in three radii (self included), the doubled-angle mean in the
    middle one and quay closeness. `pool` is the population that is counted (default: the objects themselves)."""
    th = F.radians(2.0 * F.coalesce(F.col(axis), F.lit(0.0)))
    member = F.lit(1) if pool is None else F.when(F.col("_in_pool"), 1).otherwise(0)
    tagged = df if pool is None else df.join(pool.select(key).withColumn("_in_pool", F.lit(True)), key, "left").withColumn("_in_pool", F.coalesce("_in_pool", F.lit(False)))
    r = with_radius_sums(tagged, group, radii, {"m": member, "sn": member * F.sin(th), "cs": member * F.cos(th)})
    n = {k: F.col(f"m_{k}").cast("double") for k in radii}
    near, mid, far = (F.log1p(n[k]) for k in ("near", "mid", "far"))
    s2, c2 = (F.when(n["mid"] > 0, F.col(f"{t}_mid") / n["mid"]).otherwise(0.0) for t in ("sn", "cs"))
    conc = F.hypot(s2, c2)
    q = F.exp(-F.coalesce(F.col(quay), F.lit(radii["far"])) / decay)
    return r.select(
        key, (near - mid).alias("near_mid"), (mid - far).alias("mid_far"), far.alias("far"),
        (n["near"] / F.greatest(n["far"], F.lit(1.0))).alias("share_near"), s2.alias("sin2"), c2.alias("cos2"), conc.alias("concentration"),
        (near * conc).alias("near_conc"), q.alias("quay"), (near * q).alias("near_quay"), (conc * q).alias("conc_quay"))


def scene_field(df: DataFrame, scene: Sequence[str], key: str, **kw) -> DataFrame:
    """The same quantities with the population of one scene instead of the whole port."""
    return pooled_field(df, scene, key, **kw)


def local_context(df: DataFrame, group: Sequence[str], key: str, radii: Mapping[str, float] = CONTEXT_RADII, size: str = "size") -> DataFrame:
    """Neighbour counts in four radii, nearest distance, density relative to the port, mean and deviation of sizes nearby."""
    names = list(radii)
    s = F.col(size)
    r = with_radius_sums(df, group, radii, {"k": F.when(s.isNotNull(), F.lit(1)), "s1": s, "s2": s * s})
    r = nn_distance(r, group)
    totals = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_port_n"))
    r = r.join(totals, list(group))
    area = math.pi * radii[names[2]] ** 2
    second = names[1]
    m = F.col(f"s1_{second}") / F.col(f"k_{second}")
    var = F.greatest(F.lit(0.0), F.col(f"s2_{second}") / F.col(f"k_{second}") - m * m)
    density = ((F.col(f"n_{names[2]}") - 1) / area) / F.greatest(F.lit(1e-9), F.col("_port_n") / (area * PORT_AREA_FACTOR))
    return r.select(
        key, *[(F.col(f"n_{n}") - 1).alias(f"n_{n}") for n in names], "nn", density.alias("relative_density"),
        m.alias("mean_size"), F.when(F.col(f"k_{second}") > 1, F.sqrt(var)).alias("sd_size"))


def poisson_spacing(objects: DataFrame, facilities: DataFrame, group: Sequence[str], key: str, radius: float) -> DataFrame:
    """Expected nearest spacing at each object if the features within `radius` were scattered at random."""
    f = facilities.select(*group, "x", "y", F.lit(1).alias("_f"), F.lit(None).cast(objects.schema[key].dataType).alias(key))
    o = objects.select(*group, "x", "y", F.lit(0).alias("_f"), key)
    r = with_radius_sums(o.unionByName(f), group, {"r": radius}, {"f": F.col("_f")}).where(F.col(key).isNotNull())
    lam = F.col("f_r") / F.greatest(F.lit(1e-9), F.lit(math.pi * radius**2))
    return r.select(key, F.col("f_r").alias("features"), (1.0 / (2.0 * F.sqrt(F.greatest(F.lit(1e-12), lam)))).alias("expected"))


def class_medians(df: DataFrame, cls: str, values: Sequence[str], min_n: int = 10) -> DataFrame:
    """Exact median of each value per class with at least `min_n` rows."""
    out = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n)
    for v in values:
        out = out.join(quantiles(df, [cls], v, {f"med_{v}": 0.5}).drop("n"), cls, "left")
    return out


def nearest_cell_features(points: DataFrame, cells: DataFrame, group: Sequence[str], key: str, reach: float) -> DataFrame:
    """Log points, direction and log anisotropy of the nearest field cell."""
    n = nearest_field_cell(points, cells, group, key, reach)
    a = F.radians(F.col("direction"))
    return n.select(key, F.log1p(F.col("points").cast("double")).alias("log_points"), F.sin(a).alias("sin_dir"), F.cos(a).alias("cos_dir"),
                    F.log1p(F.col("anisotropy")).alias("log_anisotropy"))


# fixed values: zone codes and the near-shore buffer
ZONE_INVALID, ZONE_LAND, ZONE_NEAR, ZONE_OFFSHORE, ZONE_UNKNOWN = 0, 1, 2, 3, 4
NEAR_BUFFER = 500.0


def zone_mask(cells: DataFrame, group: Sequence[str], size: float, is_land, is_valid, cover_known, buffer: float = NEAR_BUFFER) -> DataFrame:
    """Zone code per grid cell: invalid, land, near land, offshore, or unknown cover."""
    reach = int(math.ceil(buffer / size))
    land = cells.where(is_land).select(*group, F.col("cx").alias("lx"), F.col("cy").alias("ly"))
    probe = around(land.withColumns({"cx": F.col("lx"), "cy": F.col("ly")}), "cx", "cy", reach)
    dx, dy = (F.col("cx") - F.col("lx")) * size, (F.col("cy") - F.col("ly")) * size
    close = probe.where(dx * dx + dy * dy <= buffer * buffer).select(*group, "cx", "cy").distinct().withColumn("_near", F.lit(True))
    zone = (
        F.when(~is_valid, ZONE_INVALID).when(~cover_known, ZONE_UNKNOWN).when(is_land, ZONE_LAND)
        .when(F.coalesce(F.col("_near"), F.lit(False)), ZONE_NEAR).otherwise(ZONE_OFFSHORE))
    return cells.join(close, [*group, "cx", "cy"], "left").withColumn("zone", zone).drop("_near")


def zone_shares(zones: DataFrame, group: Sequence[str]) -> DataFrame:
    """Percentage of each zone per group."""
    pct = lambda z: 100.0 * F.count_if(F.col("zone") == z) / F.count(F.lit(1))
    return zones.groupBy(*group).agg(
        pct(ZONE_LAND).alias("land_pct"), pct(ZONE_NEAR).alias("near_pct"), pct(ZONE_OFFSHORE).alias("offshore_pct"),
        pct(ZONE_INVALID).alias("invalid_pct"), pct(ZONE_UNKNOWN).alias("unknown_pct"))


def coast_cells(cells: DataFrame, group: Sequence[str], is_water) -> DataFrame:
    """Water cells with a mapped non-water cell on one of their four sides."""
    side = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    beside = cells.where(~is_water).select(*group, "cx", "cy", side.alias("s")).select(
        *group, (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy")).distinct()
    return cells.where(is_water).join(beside, [*group, "cx", "cy"], "left_semi")


def dedup_then_density(df: DataFrame, scene: Sequence[str], group: Sequence[str], key: str, radius: float, radii: Mapping[str, float]) -> DataFrame:
    """Collapse near-duplicates of a scene to the row with the smallest key, then count neighbours and the nearest one."""
    comp = near_components(df, scene, key, radius)
    rep = comp.groupBy("component").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("merged"))
    kept = df.join(rep.select(key, "merged"), key)
    return nn_distance(radius_counts(kept, group, radii), group)
