"""Port, product and class coverage tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import cell


def class_support(df: DataFrame, port: str, cls: str, matched: Column | None = None, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Objects per port and class with their share of the port (and matched objects)."""
    aggs = [F.count(F.lit(1)).alias("objects")]
    if matched is not None:
        aggs.append(F.count_if(matched).alias("matched"))
    aggs += [e.alias(n) for n, e in (extra or {}).items()]
    g = df.groupBy(port, cls).agg(*aggs)
    return g.withColumn("share_of_port", F.col("objects") / F.sum("objects").over(Window.partitionBy(port)))


def field_feasibility(df: DataFrame, port: str, size: float) -> DataFrame:
    """Extent, scenes, axis fill rate, classes and mean objects per occupied cell of each port."""
    c = df.groupBy(port, cell("x", size).alias("cx"), cell("y", size).alias("cy")).agg(F.count(F.lit(1)).alias("n")).groupBy(port).agg(F.avg("n").alias("per_cell"))
    g = df.groupBy(port).agg(
        ((F.max("x") - F.min("x")) / 1000).alias("width_km"), ((F.max("y") - F.min("y")) / 1000).alias("height_km"),
        F.countDistinct("product").alias("products"), F.count(F.lit(1)).alias("objects"),
        (F.count("axis_deg") / F.count(F.lit(1))).alias("heading_fill"), F.countDistinct("cls").alias("classes"))
    return g.join(c, port)


# fixed values: plausible hull sizes, classes shown per port, words of the function proxies
SIZE_LIMIT = 500.0
TOP_CLASSES = 12
TOP_KINDS = 14
FUNCTION_PROXIES = {
    "tanker_terminals": ("storage_tank", "infra_oil_tanks", "crane"),
    "container_terminals": ("infra_cranes", "crane", "container", "infra_container"),
    "bulk_terminals": ("silo", "infra_silos_conveyors", "conveyor"),
    "ferry_terminals": ("ferry", "passenger"),
    "shipyard": ("dry_dock", "shipyard", "slipway"),
    "rail_logistics": ("infra_rail_logistics", "railway"),
    "energy_fuel": ("infra_energy_fuel", "pipeline", "infra_pipelines"),
}


def port_profile(ais: DataFrame, classes: DataFrame, port: str = "port", mmsi: str = "mmsi", length: str = "length", beam: str = "beam") -> DataFrame:
    """Position rows, vessels, classed rows, top class and its share, mean hull and extent of each port."""
    sane = lambda c: F.when((F.col(c) > 0) & (F.col(c) < SIZE_LIMIT), F.col(c))
    g = ais.groupBy(port).agg(
        F.count(F.lit(1)).alias("ais_rows"), F.countDistinct(mmsi).alias("vessels"), F.avg(sane(length)).alias("mean_length"), F.avg(sane(beam)).alias("mean_beam"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    # rows per (port, vessel) first: the class join then sees vessels, not positions
    v = ais.groupBy(port, mmsi).agg(F.count(F.lit(1)).alias("n")).join(classes, mmsi).groupBy(port, "cls").agg(F.sum("n").alias("n"))
    top = v.groupBy(port).agg(F.sum("n").alias("classed_rows"), F.min(F.struct((-F.col("n")).alias("neg"), "cls")).alias("b"))
    top = top.select(port, "classed_rows", F.col("b.cls").alias("top_class"), (-F.col("b.neg") / F.col("classed_rows")).alias("top_share"))
    return g.join(top, port, "left")


def class_shares(ais: DataFrame, classes: DataFrame, port: str = "port", mmsi: str = "mmsi", k: int = TOP_CLASSES) -> DataFrame:
    """The k largest classes of a port by rows, with shares of the classed rows."""
    v = ais.groupBy(port, mmsi).agg(F.count(F.lit(1)).alias("n")).join(classes, mmsi).groupBy(port, "cls").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(port)
    v = v.withColumns({"share": F.col("n") / F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), "cls"))})
    return v.where(F.col("rank") <= k)


def port_meta(registry: DataFrame, port: str, date: str, orbit: str, hour: str) -> DataFrame:
    """Products, scene dates, first and last scene, most frequent orbit and hour."""
    from .rules import mode

    g = registry.groupBy(port).agg(
        F.count(F.lit(1)).alias("products"), F.countDistinct(date).alias("scene_dates"), F.min(date).alias("first_scene"), F.max(date).alias("last_scene"))
    return g.join(mode(registry, [port], orbit, "orbit_mode"), port).join(mode(registry, [port], hour, "hour_mode"), port)


def facility_pivot(facilities: DataFrame, port: str, kind: str, kinds: Sequence[str], proxies: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Feature counts of the named kinds as columns plus function proxies by word."""
    word = lambda words: F.count_if(_any([F.col(kind).contains(w) for w in words]))
    return facilities.groupBy(port).agg(
        F.count(F.lit(1)).alias("features"), *[F.count_if(F.col(kind) == k).alias("fac_" + k) for k in kinds],
        *[word(ws).alias(n) for n, ws in (FUNCTION_PROXIES if proxies is None else proxies).items()])


def _any(conds: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def top_kinds(facilities: DataFrame, kind: str, k: int = TOP_KINDS) -> list[str]:
    """The k most frequent kinds (k names reach the driver, to become columns)."""
    rows = facilities.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), kind).limit(k).collect()
    return [r[kind] for r in rows]


def port_summary(objects: DataFrame, port: str, flags: Mapping[str, Column], support: str = "support_i", levels: int = 7) -> DataFrame:
    """Conditional counters per port and the histogram of support."""
    return objects.groupBy(port).agg(
        F.count(F.lit(1)).alias("objects"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()],
        *[F.count_if(F.col(support) == i).alias(f"support_{i}") for i in range(levels)])


def coverage_counters(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whole-table counts of every value of several columns in one pass (`column`, `value`, `n`)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))


def product_coverage(ais: DataFrame, registry: DataFrame, curated: DataFrame, filled: DataFrame, product: str = "product", mmsi: str = "mmsi") -> DataFrame:
    """Per product: rows, vessels, time extent and how many of its vessels have a fine, filled, coarse, missing,
    conflicting or no class. curated(mmsi, status, final_class), filled(mmsi, filled_class)."""
    v = vessel_status(ais, curated, filled, [product], mmsi)
    count = lambda s: F.count_if(F.col("state") == s)
    g = v.groupBy(product).agg(
        F.sum("rows").alias("ais_rows"), F.count(F.lit(1)).alias("vessels"), F.min("t0").alias("t_min"), F.max("t1").alias("t_max"),
        (count("resolved") + count("filled")).alias("fine_resolved"), count("filled").alias("from_fill"), count("coarse").alias("coarse"),
        count("missing").alias("missing"), count("conflict").alias("conflict"), count("unknown").alias("unknown"))
    zero = [c for c in g.columns if c not in (product, "t_min", "t_max")]
    return registry.join(g, product, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def vessel_status(ais: DataFrame, curated: DataFrame, filled: DataFrame, keys: Sequence[str], mmsi: str = "mmsi") -> DataFrame:
    """One row per key and vessel with rows, time extent and the state of its class."""
    v = ais.groupBy(*keys, mmsi).agg(F.count(F.lit(1)).alias("rows"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    v = v.join(curated.select(mmsi, "status", "final_class"), mmsi, "left").join(filled.select(mmsi, "filled_class"), mmsi, "left")
    state = (
        F.when((F.col("status") == "fine_class_mapped") & F.col("final_class").isNotNull(), "resolved")
        .when(F.col("filled_class").isNotNull(), "filled").when(F.col("final_class").isNotNull(), "coarse")
        .when(F.col("status").isNull(), "unknown").when(F.col("status").contains("conflict"), "conflict").otherwise("missing"))
    return v.withColumn("state", state)


def coverage_summary(products: DataFrame) -> DataFrame:
    """One row of totals over `product_coverage`."""
    cols = [c for c in ("ais_rows", "fine_resolved", "from_fill", "coarse", "missing", "conflict", "unknown") if c in products.columns]
    return products.agg(
        F.count(F.lit(1)).alias("products"), F.count_if(F.col("ais_rows") == 0).alias("without_rows"), *[F.sum(c).alias(c) for c in cols])


def gap_list(ais: DataFrame, curated: DataFrame, filled: DataFrame, port: str = "port", mmsi: str = "mmsi") -> DataFrame:
    """Vessels without any class by rows, with their status and the ports that saw them (ports are few)."""
    v = vessel_status(ais, curated, filled, [port], mmsi).where(F.col("state").isin("missing", "conflict", "unknown"))
    return v.groupBy(mmsi).agg(
        F.sum("rows").alias("rows"), F.min(F.coalesce("status", F.lit("not_in_mapping"))).alias("status"),
        F.concat_ws(";", F.array_sort(F.collect_set(F.col(port).cast("string")))).alias("ports"))


def revisit_counts(df: DataFrame, port: str, scene: str, mmsi: str) -> DataFrame:
    """Per port: vessels seen in at least 2, 3 and 5 scenes, objects in such bags and quantiles of scenes per vessel."""
    from ..ordered import quantiles

    v = df.groupBy(port, mmsi).agg(F.countDistinct(scene).alias("scenes"), F.count(F.lit(1)).alias("objects"))
    g = v.groupBy(port).agg(
        F.count(F.lit(1)).alias("vessels"), *[F.count_if(F.col("scenes") >= k).alias(f"seen_{k}") for k in (2, 3, 5)],
        F.coalesce(F.sum(F.when(F.col("scenes") >= 2, F.col("objects"))), F.lit(0)).alias("bag_objects"))
    return g.join(quantiles(v, [port], "scenes", {"scenes_p50": 0.5, "scenes_p90": 0.9}).drop("n"), port)


def robust_contrast(df: DataFrame, window: Sequence[str], scene: str, value: str, floor: float = 1e-6) -> DataFrame:
    """(max - median) / MAD of the values of each window (`scene` is one of the window keys)."""
    from ..ordered import quantiles

    m = quantiles(df, window, value, {"med": 0.5}).drop("n")
    d = df.join(m, list(window)).withColumn("_dev", F.abs(F.col(value) - F.col("med")))
    mad = quantiles(d, window, "_dev", {"mad": 0.5}).drop("n")
    return df.groupBy(*window).agg(F.max(value).alias("peak")).join(m, list(window)).join(mad, list(window)).select(
        *window, ((F.col("peak") - F.col("med")) / (F.col("mad") + floor)).alias("contrast"))


def hit_rates(contrasts: DataFrame, scene: str, threshold: float = 20.0) -> DataFrame:
    """Share of windows above the threshold per scene, in percent."""
    return contrasts.groupBy(scene).agg(F.count(F.lit(1)).alias("windows"), (100.0 * F.count_if(F.col("contrast") > threshold) / F.count(F.lit(1))).alias("rate"))


def scene_alignment(points: DataFrame, scene: str, inside: Column, has_time: Column, time_ok: Column, speed: str, length: str) -> DataFrame:
    """Per scene: points, share inside the raster, matched times, median speed and length."""
    from ..ordered import quantiles

    g = points.groupBy(scene).agg(
        F.count(F.lit(1)).alias("points"), (100.0 * F.count_if(inside) / F.count(F.lit(1))).alias("inside_pct"),
        F.count_if(has_time).alias("timed"), F.count_if(has_time & time_ok).alias("time_match"))
    return g.join(quantiles(points, [scene], speed, {"speed_med": 0.5}).drop("n"), scene).join(quantiles(points, [scene], length, {"length_med": 0.5}).drop("n"), scene)


def class_distribution(df: DataFrame, cls: str, value: str, min_n: int = 10) -> DataFrame:
    """Quartiles of a value per class with at least `min_n` rows."""
    from ..ordered import quantiles

    return quantiles(df, [cls], value, {"p25": 0.25, "median": 0.5, "p75": 0.75}).where(F.col("n") >= min_n)


def validity_summary(df: DataFrame, product: str, channels: Sequence[str], joint: str, clipped: str, limit: float = 0.95) -> DataFrame:
    """Per product: rows, share with joint validity, mean validity per channel, clipped rows."""
    return df.groupBy(product).agg(
        F.count(F.lit(1)).alias("rows"), (F.count_if(F.col(joint) >= limit) / F.count(F.lit(1))).alias("valid_share"),
        *[F.avg(c).alias("mean_" + c) for c in channels], F.count_if(F.col(clipped)).alias("clipped"))
