"""From positions to a traffic-direction field per port."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import valid_mmsi
from ..operators.tracks import CELL, MAX_GAP, MIN_POINTS, MIN_STEP, cell_direction, track_steps
from ..sources.sinks import write_partitioned


def traffic_field(ais: DataFrame, max_gap: int = MAX_GAP, size: float = CELL, min_points: int = MIN_POINTS) -> tuple[DataFrame, DataFrame]:
    """Field cells (port, cell, points, direction, anisotropy) and a summary per port."""
    cells = cell_direction(track_steps(ais, ["product", "mmsi", "port"], max_gap, MIN_STEP), ["port"], size, min_points)
    rows = ais.groupBy("port").agg(F.count(F.lit(1)).alias("ais_rows"))
    summary = cells.groupBy("port").agg(F.count(F.lit(1)).alias("cells"), F.sum("points").alias("steps")).join(rows, "port")
    return cells, summary


def traffic_field_geo(ais: DataFrame, boxes: DataFrame, max_gap: int = MAX_GAP, size: float = CELL, min_points: int = MIN_POINTS) -> DataFrame:
    """The field from longitudes and latitudes: positions inside a port's box, in metres of the box's zone, with the cells' positions.

    ais: event_id, mmsi, t, lon, lat. boxes: port, west, south, east, north (one row a port, few rows). A position in two boxes counts in both."""
    zone = boxes.withColumn("zone", G.utm_zone(F.col("west"), F.col("east")))
    inside = (F.col("lon").between(F.col("west"), F.col("east"))) & (F.col("lat").between(F.col("south"), F.col("north")))
    rows = ais.where(valid_mmsi(F.col("mmsi").cast("string"))).join(zone, inside)
    at = G.utm_forward(F.col("lon"), F.col("lat"), F.col("zone"))
    rows = rows.select("port", "mmsi", "event_id", "t", at.alias("p")).select("port", "mmsi", "event_id", "t", "p.x", "p.y")
    cells = cell_direction(track_steps(rows, ["mmsi", "port"], max_gap, MIN_STEP), ["port"], size, min_points)
    back = G.utm_inverse(F.col("cell_x"), F.col("cell_y"), F.col("zone"))
    return cells.join(zone.select("port", "zone"), "port").select(
        "port", F.round("cell_x", 1).alias("cell_x"), F.round("cell_y", 1).alias("cell_y"), F.round(back["lon"], 5).alias("cell_lon"), F.round(back["lat"], 5).alias("cell_lat"),
        "points", F.round("direction", 2).alias("direction_deg"), F.round("anisotropy", 2).alias("anisotropy"))


def write_traffic_field(ais: DataFrame, path: str, **kw) -> None:
    """Write the field per port, busiest cells first, with its provenance."""
    cells, _ = traffic_field(ais, **kw)
    write_partitioned(cells, path, "port", [F.desc("points")], {"rule": "unit steps of one vessel, main axis per cell"})
