"""Row-level cleaning, predicates, contracts and signals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, count_true, missing_names, port_key

# fixed values: quality gate and confidence tiers
MIN_CONFIDENCE = 0.30
TIER_HIGH, TIER_MEDIUM = 100, 10

# fixed values: tag words of navigation features and of quay structures
NAV_SEAMARKS = (
    "fairway", "route", "recommended_route", "recommended_track", "two-way_route", "deep_water_route", "navigation_line",
    "leading_line", "tss", "separation_line", "separation_zone", "inshore_traffic_zone", "precautionary_area", "gatway")
QUAY_KINDS = (
    "quay", "pier", "breakwater", "groyne", "jetty", "dock", "storage_tank", "crane", "silo", "works", "wastewater_plant",
    "chimney", "tower", "embankment", "infra_quay_pier_breakwater", "infra_oil_tanks", "infra_cranes", "infra_silos_conveyors",
    "infra_warehouses")
QUAY_WORDS = "quay|pier|breakwater|drydock|dry_dock|slipway|berth"
ANCHORAGE_WORDS = "anchorage|mooring"
NAV_WORDS = "route|fairway|tss"

# fixed values: land-cover codes, distance cap, coast ramp, crowding cap
CODE_WATER, CODE_BUILT, CODE_NODATA = 80, 50, 0
DISTANCE_CAP = 2000.0
COAST_RAMP = 1500.0
CROWD_CAP = 64


def canon_ports(df: DataFrame, aliases: DataFrame, raw: str = "port") -> DataFrame:
    """Replace port spellings by canonical names; `aliases` (raw_name, canonical_name) is a small dimension."""
    a = aliases.select(port_key(F.col("raw_name")).alias("_k"), F.col("canonical_name").alias("_to")).dropDuplicates(["_k"])
    d = df.withColumn("_k", port_key(F.col(raw)))
    return d.join(a, "_k", "left").withColumn(raw, F.coalesce("_to", "_k")).drop("_k", "_to")


def alias_usage(df: DataFrame, aliases: DataFrame, raw: str = "port") -> DataFrame:
    """How many rows use each raw spelling of a canonical port."""
    return canon_ports(df.withColumn("raw_name", F.col(raw)), aliases, raw).groupBy("raw_name", F.col(raw).alias("canonical_name")).agg(
        F.count(F.lit(1)).alias("rows"))


def in_bbox(df: DataFrame, boxes: DataFrame, key: str, x: str = "lon", y: str = "lat") -> DataFrame:
    """Keep rows inside their key's box (west, east, south, north)."""
    j = df.join(boxes, key)
    return j.where(F.col(x).between(F.col("west"), F.col("east")) & F.col(y).between(F.col("south"), F.col("north"))).select(*df.columns)


def quality_gate(df: DataFrame, min_conf: float = MIN_CONFIDENCE) -> DataFrame:
    return df.where((F.col("screen_status") == "passed") & (F.col("conf") >= min_conf))


def support_signals(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Add each flag, `support_i` (how many hold) and `support_missing` (names of those that do not)."""
    return df.withColumns({
        **{n: F.coalesce(f, F.lit(False)) for n, f in flags.items()},
        "support_i": count_true(flags), "support_missing": missing_names(flags)})


def object_signals() -> dict[str, Column]:
    """The six signals of an object row."""
    known = lambda c, *bad: ~F.coalesce(F.col(c), F.lit("")).isin("", *bad)
    return {
        "ais_unique_match": F.col("match_status") == "unique_spatial_candidate",
        "fine_class_resolved": (F.col("ais_class_level") == "fine") & ~F.col("ais_final_class").endswith("_coarse"),
        "valid_area_ok": known("pixel_status", "zero_only", "invalid"),
        "coast_known": known("coast_status", "unavailable", "missing"),
        "facility_context": F.col("facility_kind").isNotNull(),
        "facility_map_available": F.coalesce(F.col("map_available"), F.lit(False)),
    }


def first_label(df: DataFrame, columns: Sequence[str], vocabulary: Sequence[str], out: str = "label") -> DataFrame:
    """First non-empty class column in the given order; rows outside the vocabulary are dropped."""
    return df.withColumn(out, F.coalesce(*[blank_to_null(F.col(c)) for c in columns])).where(F.col(out).isin(*vocabulary))


def facility_kind(tags: Mapping[str, Column]) -> Column:
    """One kind per feature from its tags; navigation marks get the prefix `nav:`."""
    tag = lambda t: F.coalesce(F.trim(tags[t]), F.lit("")) if t in tags else F.lit("")
    seamark = F.lower(tag("seamark"))
    return (
        F.when(tag("man_made") != "", tag("man_made"))
        .when(tag("harbour") != "", "harbour")
        .when(F.lower(tag("waterway")) == "dock", "dock")
        .when(F.lower(tag("natural")) == "coastline", "coastline")
        .when(F.lower(tag("landuse")) == "harbour", "harbour_area")
        .when(seamark.isin(*NAV_SEAMARKS), F.concat(F.lit("nav:"), seamark))
        .when(seamark != "", F.concat(F.lit("seamark:"), seamark))
        .otherwise("other"))


def facility_groups(kind: Column) -> Column:
    """Array of the layers a feature belongs to; layers overlap."""
    k = F.lower(kind)
    coast, derived = k.contains("coastline"), kind == "coastline_derived"
    member = {
        "coast": coast & ~derived,
        "coast_derived": derived,
        "quay": kind.isin(*QUAY_KINDS) | k.rlike(QUAY_WORDS),
        "anchorage": k.rlike(ANCHORAGE_WORDS),
        "nav": kind.startswith("nav:") | k.rlike(NAV_WORDS),
        "facility": ~coast & ~kind.startswith("nav:"),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in member.items()]))


def semantic_area(code: Column) -> Column:
    return (
        F.when(code.isNull() | (code < 0), "unknown").when(code == CODE_WATER, "water").when(code == CODE_BUILT, "built")
        .when(code == CODE_NODATA, "nodata").otherwise("land"))


def proximity(dist: Column, observed: Column, ramp: float = DISTANCE_CAP, cap: float = DISTANCE_CAP) -> Column:
    """Distance to [0, 1] closeness; null where the layer was not observed or the distance is not usable."""
    ok = F.coalesce(observed, F.lit(False)) & dist.isNotNull() & ~F.isnan(dist) & dist.between(0, cap)
    return F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cap - dist) / ramp)))


def crowding(count: Column, cap: int = CROWD_CAP) -> Column:
    return F.when(count >= 0, F.log1p(F.least(count, F.lit(cap)).cast("double")) / F.log(F.lit(float(cap + 1))))


def project_permitted(df: DataFrame, permissions: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Columns whose role is allowed. `permissions` (column, role, usable) is the contract, one row per column."""
    # the contract may be long; only what it says of this frame's columns is read, one row a column
    rows = permissions.where(F.col("column").isin(df.columns)).groupBy("column").agg(F.first("role").alias("role"), F.first("usable").alias("usable")).collect()
    listed = {r["column"]: r for r in rows}
    unknown = [c for c in df.columns if c not in listed]
    if unknown:
        raise ValueError(f"columns without a role: {unknown}")
    return df.select(*[c for c in df.columns if listed[c]["role"] in roles and listed[c]["usable"]])


def assert_permitted(df: DataFrame, permissions: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Refuse a frame that carries a column outside the allowed roles."""
    bad = [c for c in df.columns if c not in project_permitted(df, permissions, roles).columns]
    if bad:
        raise ValueError(f"forbidden columns: {bad}")
    return df


def contract_report(df: DataFrame, key: Sequence[str], expected: int | None = None) -> DataFrame:
    """One row: rows, distinct keys, duplicated keys, empty keys and whether the contract holds."""
    null_key = F.lit(False)
    for k in key:
        null_key = null_key | F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.max(null_key).alias("empty"))
    out = per.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys"),
        F.count_if(F.col("c") > 1).alias("duplicated_keys"), F.coalesce(F.sum(F.when(F.col("empty"), F.col("c"))), F.lit(0)).alias("empty_keys"))
    size_ok = F.lit(True) if expected is None else F.col("rows") == expected
    return out.withColumn("ok", size_ok & (F.col("duplicated_keys") == 0) & (F.col("empty_keys") == 0))


def distance_source(osm: Column, derived: Column, pipeline: Column, cap: float = DISTANCE_CAP) -> Column:
    return (
        F.when(osm < cap, "osm_coastline").when(derived < cap, "worldcover_derived")
        .when(pipeline.isNotNull(), "pipeline_worldcover").otherwise("unavailable"))


def confidence_tier(support: Column) -> Column:
    return F.when(support >= TIER_HIGH, "high").when(support >= TIER_MEDIUM, "medium").otherwise("low")


def existed_at(edit: Column, scene: Column) -> Column:
    """Whether the feature's edit date is not after the scene date; null when undated."""
    return F.to_date(edit) <= F.to_date(scene)


def blockers(unmet: Mapping[str, Column]) -> Column:
    """Array of the names whose condition holds; empty means ready."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in unmet.items()]))


def strict_ids(df: DataFrame, key: str) -> DataFrame:
    """Exact string ids; raises on an empty or repeated id."""
    out = df.withColumn(key, F.col(key).cast("string"))
    bad = contract_report(out, [key]).where("not ok").head()
    if bad:
        raise ValueError(f"{key}: {bad.asDict()}")
    return out
