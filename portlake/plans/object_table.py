"""From detections and context layers to the object table: one lazy plan, written by port."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import clean as C
from ..operators import spatial as D
from ..session import cut
from ..operators.match import attach_dates, resolve_class


def shape(detections: DataFrame) -> DataFrame:
    """Centre, area and sides from the polygon in the full image (`source_pts`, else `pts`), the axis from `pts`, and a full object id."""
    p = F.coalesce("source_pts", "pts")
    side, c = G.side_lengths(p), G.poly_centroid(p)
    oid = F.concat_ws("|", "product", "pol", F.concat_ws(",", F.transform("roi_origin", lambda z: z.cast("string"))), "detection_id", F.col("ordinal").cast("string"))
    return detections.withColumns({
        "object_id": oid, "col": c["x"], "row": c["y"], "area_px2": G.poly_area(p), "long_px": F.array_max(side), "short_px": F.array_min(side), "axis_deg": G.long_axis_deg(F.col("pts"))})


def locate(objects: DataFrame, registry: DataFrame) -> DataFrame:
    """Port, start date and map position from the product's registry row (`geo` is its six-number transform)."""
    j = objects.join(registry.select("product", "port", "start_date", "geo"), "product")
    w = G.affine_apply(F.col("geo"), F.col("col"), F.col("row"))
    return j.withColumn("_w", w).withColumns({"x": F.col("_w.x"), "y": F.col("_w.y")}).drop("_w", "geo")


def object_table(detections: DataFrame, registry: DataFrame, facilities: DataFrame, dates: DataFrame, final: DataFrame, curated: DataFrame,
                 filled: DataFrame, cover: DataFrame, field: DataFrame, cover_size: float = 10.0) -> DataFrame:
    """Every detection with its context, class and support.

    facilities: port, facility_id, element, facility_kind, x1, y1, x2, y2 (segments). cover: port, cx, cy, code.
    field: port, cell_x, cell_y, points, direction, anisotropy."""
    key, port, product = "object_id", ["port"], ["product"]
    # located once and written: every context below starts from the slim table and returns to it by id, so the
    # plan grows by one branch per context instead of doubling with each
    base = cut(locate(shape(detections), registry))
    slim = base.select(key, "port", "product", "x", "y", "axis_deg")
    layered = facilities.withColumn("layer", F.explode(C.facility_groups(F.col("facility_kind"))))
    segs = cut(layered.select("port", "layer", "facility_id", "element", "facility_kind", "x1", "y1", "x2", "y2"))
    nav, fac = segs.where("layer = 'nav'"), segs.where("layer = 'facility'")
    contexts = [
        D.nearest_within(slim, segs.select("port", "layer", "x1", "y1", "x2", "y2"), port, key, ["coast", "coast_derived", "quay", "anchorage", "nav"]),
        D.facility_hit(slim, fac, port, key, ["facility_id", "element", "facility_kind"], "facility_id").withColumnRenamed("dist", "facility_distance"),
        D.channel_angle(slim, nav, field, port, key, "facility_id"),
        D.sample_cells(slim, cover, port, cover_size, "code").withColumn("semantic_area", C.semantic_area(F.col("code"))),
        # neighbours are those of one acquisition
        D.heading_dispersion(slim, product), D.radius_counts(slim, product), D.nn_distance(slim, product)]
    o = base
    for c in contexts:
        o = o.join(c.drop("port", "product", "x", "y", "axis_deg"), key)
    o = attach_dates(o, dates).withColumn("facility_temporal_valid", C.existed_at(F.col("facility_edit_ts"), F.col("start_date")))
    o = o.withColumn("mmsi", F.coalesce("matched_mmsi", "candidate_mmsi"))
    o = resolve_class(o, final, curated, filled)
    mapped = facilities.select("port").distinct().withColumn("map_available", F.lit(True))
    o = o.join(F.broadcast(mapped), "port", "left")
    o = o.withColumns({
        "d_coast_m": F.least("d_coast", "d_coast_derived"), "on_fairway": F.col("d_nav") <= D.LINE_REACH,
        "distance_source": C.distance_source(F.col("d_coast"), F.col("d_coast_derived"), F.col("coast_exclusion_m"))})
    return C.support_signals(o, C.object_signals())


def write_object_table(table: DataFrame, path: str) -> None:
    """Parquet by port; rows of a busy port go to many files."""
    table.write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).partitionBy("port").parquet(path)
