"""Readers for nested JSON documents and feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import masked
from ..functions.text import blank_to_null

POINT = "struct<x:double,y:double>"
CORRUPT = "_corrupt"

DETECTION = (
    "pts array<array<double>>, source_pts array<array<double>>, product string, source_image string, detection_id string, "
    "roi_origin array<double>, conf double, match_status string, matched_mmsi string, candidate_mmsi string, "
    "candidate_distance_m double, prelabel_class string, pixel_status string, valid_fraction double, zero_fraction double, "
    "coast_status string, coast_exclusion_m double, screen_status string, human_reviewed string, final_dataset_eligible string"
)
SCENE_OBJECT = "struct<pts:array<array<double>>,cls_id:int,conf:double,meta:map<string,string>>"


def _points(c):
    return F.transform(c, lambda p: F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y")))


def read_detections(spark: SparkSession, path: str, id_field: str = "path") -> tuple[DataFrame, DataFrame]:
    """Detection rows, and one row of counts (documents, unreadable documents).

    Each file is one JSON array; a file that does not parse is counted, not fatal.
    """
    docs = spark.read.text(path, wholetext=True).withColumn(id_field, F.input_file_name())
    parsed = docs.withColumn("objects", F.from_json("value", f"array<struct<{_as_fields(DETECTION)}>>", {"mode": "PERMISSIVE"}))
    counts = parsed.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("objects").isNull()).alias("unreadable"))
    rows = parsed.where(F.col("objects").isNotNull()).select(id_field, F.posexplode("objects").alias("ordinal", "o")).select(id_field, "ordinal", "o.*")
    rows = rows.withColumns({"pts": _points(F.col("pts")), "source_pts": _points(F.coalesce("source_pts", "pts"))})
    return rows.where(F.size("pts") >= 3), counts


def _as_fields(ddl: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T._parse_datatype_string(ddl).fields)


def explode_scene_labels(docs: DataFrame) -> DataFrame:
    """One row per object of a scene document (`product, polarization, objects`); untyped objects get a name."""
    o = docs.select("product", F.col("polarization").alias("pol"), F.posexplode("objects").alias("ordinal", "o"))
    return o.select(
        "product", "pol", "ordinal", F.col("o.conf").alias("conf"), F.col("o.cls_id").alias("cls_id"),
        F.coalesce(blank_to_null(F.col("o.meta")["prelabel_class"]), F.lit("ship_untyped")).alias("cls"),
        blank_to_null(F.col("o.meta")["matched_mmsi"]).alias("matched_mmsi"),
    )


def read_scene_labels(spark: SparkSession, path: str) -> DataFrame:
    schema = f"product string, polarization string, image string, classes array<string>, objects array<{SCENE_OBJECT}>"
    return explode_scene_labels(spark.read.schema(schema).json(path, multiLine=True))


def labelled_lines(lines: DataFrame, schema: str, label: str) -> DataFrame:
    """JSON lines (`value`) that parse and carry a label."""
    rows = lines.withColumn("j", F.from_json("value", schema, {"mode": "PERMISSIVE"})).select("j.*")
    return rows.where(blank_to_null(F.col(label)).isNotNull())


def read_jsonl(spark: SparkSession, path: str, schema: str, label: str) -> DataFrame:
    return labelled_lines(spark.read.text(path), schema, label)


def read_features(vectors: DataFrame, index: DataFrame, id_col: str, vector: str = "v", mask: str | None = None) -> DataFrame:
    """Feature vectors joined to their index by id (never by position); masked entries become null."""
    df = vectors.join(index, id_col)
    return df.withColumn(vector, masked(F.col(vector), F.col(mask))) if mask else df


def explode_geojson(docs: DataFrame) -> DataFrame:
    """`value` holds one FeatureCollection; one row per vertex of each point, line or ring.

    Parts of multiple geometries and of collections (one level) follow each other; `ring` counts the lines and rings of a
    feature.  A feature whose geometry is missing, empty or of another kind has one row without a vertex (ring -1), so that it can be counted.
    """
    shape = "type:string,coordinates:string"
    feature = f"struct<type:string,properties:map<string,string>,geometry:struct<{shape},geometries:array<struct<{shape}>>>>"
    f = docs.select(F.explode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("f"))
    own = F.array(F.struct(F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates")))
    parts = F.when(F.col("f.geometry.type") == "GeometryCollection", F.col("f.geometry.geometries")).otherwise(own)
    vertex, path = "array<double>", "array<array<double>>"

    def lines(g):
        """The vertex lists of one geometry."""
        kind, c = g["type"], g["coordinates"]
        return (
            F.when(kind == "Point", F.array(F.array(F.from_json(c, vertex))))
            .when(kind == "MultiPoint", F.transform(F.from_json(c, path), lambda p: F.array(p)))
            .when(kind == "LineString", F.array(F.from_json(c, path)))
            .when(kind.isin("MultiLineString", "Polygon"), F.from_json(c, f"array<{path}>"))
            .when(kind == "MultiPolygon", F.flatten(F.from_json(c, f"array<array<{path}>>"))))

    listed = F.transform(parts, lambda g: F.transform(lines(g), lambda pts: F.struct(g["type"].alias("gtype"), pts.alias("pts"))))
    rings = F.flatten(F.filter(listed, lambda x: x.isNotNull()))
    rings = F.filter(rings, lambda r: F.size(r["pts"]) > 0)
    g = f.select(F.col("f.properties").alias("p"), F.posexplode_outer(rings).alias("ring", "r"))
    out = g.select("p", F.col("r.gtype").alias("gtype"), F.coalesce("ring", F.lit(-1)).alias("ring"), F.posexplode_outer("r.pts").alias("k", "pt"))
    return out.select(
        F.col("p")["facility_kind"].alias("facility_kind"), F.col("p")["osm_element"].alias("osm_element"), F.col("p")["osm_id"].alias("osm_id"),
        "gtype", "ring", "k", F.get("pt", F.lit(0)).alias("lon"), F.get("pt", F.lit(1)).alias("lat"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    return explode_geojson(spark.read.text(path, wholetext=True))


def segments(vertices: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """Vertex rows of `explode_geojson` to segments; a single point is a segment of length zero."""
    w = ["facility_kind", "osm_element", "osm_id", "ring"]
    nxt = vertices.select(*w, (F.col("k") - 1).alias("k"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    a = vertices.where(F.col("k").isNotNull()).select(*w, "k", "gtype", F.col(x).alias("x1"), F.col(y).alias("y1")).join(nxt, [*w, "k"], "left")
    return a.where(F.col("x2").isNotNull() | F.col("gtype").isin("Point", "MultiPoint")).select(
        *w, "k", "x1", "y1", F.coalesce("x2", "x1").alias("x2"), F.coalesce("y2", "y1").alias("y2"))
