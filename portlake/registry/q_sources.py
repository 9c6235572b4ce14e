"""Readers, writers, inventories, cleaning and contracts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clean as C
from ..session import shared_folder
from ..sources import ais as A
from ..sources import documents as D
from ..sources import inventory as I
from ..sources import sinks as K
from .base import query, rounded


# ids per written document: the fixtures' documents stay small however large a product or port is
DOC = 1000


def scratch(v, name: str) -> str:
    return os.path.join(shared_folder(v.spark), f"portlake-{name}-{uuid.uuid4().hex}")


_MMSI_SQL = "CASE WHEN event_id % 77 = 0 THEN '000000000' WHEN event_id % 31 = 0 THEN CAST(user_id AS VARCHAR) ELSE CAST(200000000 + user_id AS VARCHAR) END"


def ais_lines(v):
    """Position log text with short rows and bad identities mixed in."""
    e = v.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.col("event_id")
    mmsi = F.when(k % 77 == 0, "000000000").when(k % 31 == 0, F.col("user_id").cast("string")).otherwise((200000000 + F.col("user_id")).cast("string"))
    text = F.concat_ws(
        ",", F.floor(F.unix_micros("ts") / 1e6).cast("string"), mmsi, F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"),
        F.when(k % 13 == 0, "n/a").otherwise(F.col("value").cast("string")), F.lit("1.25"), F.lit("e"), F.lit("f"),
        F.concat(F.lit("  SHIP   "), F.col("user_id").cast("string"), F.lit(" ")), F.col("event_type"), F.lit("g"), F.lit("h"),
        (k % 300).cast("string"), (k % 40).cast("string"), (k % 9).cast("string"), F.lit("z"))
    return e.select(F.dayofmonth("ts").cast("string").alias("product"), F.when(k % 50 == 0, F.substring_index(text, ",", 9)).otherwise(text).alias("value"))


@query("read_ais", "", f"""WITH e AS (SELECT CAST(CAST(strftime(ts, '%d') AS INT) AS VARCHAR) AS product, event_id % 50 <> 0 AS okf, event_id % 77 <> 0 AND event_id % 31 <> 0 AS okm, event_id % 13 <> 0 AS okx, value, user_id, event_type, event_id FROM events)
SELECT product, count(*) AS rows, count(*) FILTER (NOT okf) AS bad_fields, count(*) FILTER (okf AND NOT okm) AS bad_mmsi, count(*) FILTER (okf AND okm AND okx) AS usable,
 round(sum(value) FILTER (okf AND okm AND okx), 4) AS sum_lon, count(DISTINCT user_id) FILTER (okf AND okm AND okx) AS vessels, CAST(sum(event_id % 300) FILTER (okf AND okm AND okx) AS DOUBLE) AS sum_length FROM e GROUP BY product""")
def _(v):
    path = scratch(v, "ais")
    ais_lines(v).withColumn("part", F.col("product")).select("part", "value").write.partitionBy("part").text(path)
    raw = v.spark.read.text(path).select(F.col("part").cast("string").alias("product"), "value")
    a = A.parse_ais(raw)
    good = A.usable(a).groupBy("product").agg(
        F.count(F.lit(1)).alias("usable"), F.sum("lon").alias("sum_lon"), F.countDistinct("mmsi").alias("vessels"), F.sum("dim0").alias("sum_length"))
    return rounded(A.row_quality(a, ["product"]).join(good, "product"), 4)


@query("read_table_gz", "", "SELECT c_custkey % 100 AS bucket, count(*) AS rows, count(*) FILTER (c_custkey % 3 <> 0) AS named FROM customer GROUP BY ALL")
def _(v):
    path = scratch(v, "gz")
    c = v.table("customer").select(F.col("c_custkey").cast("string").alias("﻿mmsi"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")).alias("name"))
    c.write.option("header", True).option("compression", "gzip").csv(path)
    t = A.read_table(v.spark, path)
    return t.groupBy((F.col("mmsi").cast("bigint") % 100).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.count("name").alias("named"))


@query("read_detections", "objects", """, o AS (SELECT product, count(*) AS n, round(sum(conf), 4) AS conf FROM objects GROUP BY product) SELECT product, n, conf, (SELECT count(DISTINCT (product, object_id // 1000)) FROM objects) + 1 AS documents, CAST(1 AS BIGINT) AS unreadable FROM o""")
def _(v):
    """JSON arrays of bounded size per product plus one broken file."""
    path = scratch(v, "det")
    o = v.objects.select(
        F.concat_ws("_", "product", F.floor(F.col("object_id") / DOC)).alias("p"), F.array(F.array("x", "y"), F.array(F.col("x") + 1, F.col("y")), F.array("x", F.col("y") + 1)).alias("pts"),
        F.col("product").cast("string").alias("product"), F.col("object_id").cast("string").alias("detection_id"), "conf")
    docs = o.groupBy("p").agg(F.to_json(F.collect_list(F.struct("pts", "product", "detection_id", "conf"))).alias("value"))
    broken = docs.limit(1).select(F.lit("broken").alias("p"), F.lit("{not json").alias("value"))
    docs.unionByName(broken).write.partitionBy("p").text(path)
    rows, counts = D.read_detections(v.spark, path)
    per = rows.groupBy(F.col("product").cast("bigint").alias("product")).agg(F.count(F.lit(1)).alias("n"), F.sum("conf").alias("conf"))
    return rounded(per.crossJoin(F.broadcast(counts)), 4)


@query("read_scene_labels", "objects", """SELECT product, CASE WHEN cls = 0 THEN 'ship_untyped' ELSE 'class_' || cls END AS cls, count(*) AS n, count(*) FILTER (cls % 2 = 1) AS matched FROM objects GROUP BY ALL""")
def _(v):
    path = scratch(v, "scene")
    meta = F.map_from_arrays(F.array(F.lit("prelabel_class"), F.lit("matched_mmsi")), F.array(
        F.when(F.col("cls") == 0, " ").otherwise(F.concat(F.lit("class_"), F.col("cls").cast("string"))), F.when(F.col("cls") % 2 == 1, "9").otherwise("")))
    o = v.objects.select("product", F.floor(F.col("object_id") / DOC).alias("part"), F.struct(F.array(F.array("x", "y")).alias("pts"), F.lit(1).alias("cls_id"), "conf", meta.alias("meta")).alias("o"))
    o.groupBy("product", "part").agg(F.collect_list("o").alias("objects")).select(
        F.col("product").cast("string").alias("product"), F.lit("VV").alias("polarization"), F.lit("i").alias("image"), "objects").write.option(
        "maxRecordsPerFile", 1).json(path)
    s = D.read_scene_labels(v.spark, path)
    return s.groupBy(F.col("product").cast("bigint").alias("product"), "cls").agg(F.count(F.lit(1)).alias("n"), F.count("matched_mmsi").alias("matched"))


@query("read_jsonl", "", "SELECT user_id, count(*) AS n, CAST(sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS k FROM events WHERE event_id % 9 <> 0 AND event_type <> 'error' GROUP BY user_id")
def _(v):
    """Lines with a broken document or an empty label are skipped."""
    e = v.table("events")
    good = F.to_json(F.struct("user_id", F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("label")))
    path = scratch(v, "jsonl")
    e.select(F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(good).alias("value")).write.text(path)
    r = D.read_jsonl(v.spark, path, "user_id bigint, k bigint, label string", "label")
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


@query("read_features", "features", """SELECT id, port, CAST(count(*) FILTER ((id + d) % 3 <> 0) AS BIGINT) AS supported, round(sum(v[d]) FILTER ((id + d) % 3 <> 0), 6) AS total FROM features, (SELECT unnest(range(1, 65)) AS d) r GROUP BY id, port""")
def _(v):
    f = v.features
    vec = f.select("id", "v", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda d: (F.col("id") + d) % 3 != 0).alias("m"))
    r = D.read_features(vec, f.select("id", "port"), "id", "v", "m").select("id", "port", F.explode("v").alias("x"))
    return rounded(r.groupBy("id", "port").agg(F.count("x").alias("supported"), F.sum("x").alias("total")))


@query("read_geojson", "facilities", """SELECT CAST(facility_id AS VARCHAR) AS osm_id, kind AS facility_kind, element AS osm_element, CAST(2 AS BIGINT) AS vertices, round(sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)), 4) AS length FROM facilities""")
def _(v):
    path = scratch(v, "geo")
    feat = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col("kind").alias("facility_kind"), F.col("element").alias("osm_element"), F.col("facility_id").cast("string").alias("osm_id")).alias("properties"),
        F.struct(F.lit("LineString").alias("type"), F.array(F.array("x1", "y1"), F.array("x2", "y2")).alias("coordinates")).alias("geometry"))
    docs = v.facilities.groupBy("port", F.floor(F.col("facility_id") / DOC).alias("part")).agg(F.to_json(F.struct(F.collect_list(feat).alias("features"))).alias("value"))
    docs.write.partitionBy("port", "part").text(path)
    vert = D.explode_geojson(v.spark.read.text(path, wholetext=True).select("value"))
    n = vert.groupBy("osm_id", "facility_kind", "osm_element").agg(F.count(F.lit(1)).alias("vertices"))
    s = D.segments(vert).withColumn("l", F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2))
    return rounded(n.join(s.groupBy("osm_id").agg(F.sum("l").alias("length")), "osm_id"), 4)


@query("write_geojson_rows", "objects", "SELECT port, count(*) AS features, CAST(5 * count(*) AS BIGINT) AS ring_points, round(sum(conf), 4) AS conf FROM objects GROUP BY port")
def _(v):
    """Written per port as text, read back and measured."""
    path = scratch(v, "geoout")
    o = v.objects.withColumn("pts", F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]))
    K.write_geojson(o, path, "port", ["object_id", "conf"])
    back = v.spark.read.text(path).select(F.col("port").cast("bigint").alias("port"), F.from_json(
        "value", "struct<properties:struct<conf:double>,geometry:struct<coordinates:array<array<array<double>>>>>").alias("f"))
    return rounded(back.groupBy("port").agg(
        F.count(F.lit(1)).alias("features"), F.sum(F.size(F.col("f.geometry.coordinates")[0])).alias("ring_points"), F.sum("f.properties.conf").alias("conf")), 4)


@query("write_partitioned", "cells", "SELECT port, count(*) AS rows, CAST(sum(n) AS BIGINT) AS points, CAST(max(n) AS BIGINT) AS top FROM cells GROUP BY port")
def _(v):
    path = scratch(v, "cells")
    K.write_partitioned(v.cells, path, "port", [F.desc("n")], {"cell_m": 1000})
    back = v.spark.read.option("header", True).schema("cx bigint, cy bigint, code int, n bigint, port bigint").csv(path)
    meta = v.spark.read.json(path + "_provenance").select("port", F.col("rows").cast("long"))
    return back.groupBy("port").agg(F.sum("n").alias("points"), F.max("n").alias("top")).join(meta, "port")


@query("merge_shards", "objects", "SELECT product % 3 AS shard, count(*) AS n, count(conf) FILTER (product % 3 <> 1) AS with_conf FROM objects GROUP BY ALL")
def _(v):
    o = v.objects.withColumn("shard", F.col("product") % 3)
    parts = [o.where(f"shard = {i}") for i in range(3)]
    parts[1] = parts[1].drop("conf")
    return K.merge_shards(parts).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count("conf").alias("with_conf"))


@query("resume_filter", "registry", "SELECT product, port FROM registry WHERE product NOT IN (SELECT l_orderkey FROM lineitem)")
def _(v):
    return K.resume_filter(v.registry, v.table("lineitem").select(F.col("l_orderkey").alias("product")), ["product"]).select("product", "port")


_FILES_SQL = """WITH files AS (SELECT l_orderkey AS product, CASE WHEN l_linenumber % 2 = 1 THEN 'VV' ELSE 'VH' END AS pol,
 CASE l_linenumber % 3 WHEN 0 THEN '/archive' WHEN 1 THEN '/local' ELSE '/backup' END || '/p' || l_orderkey || '_' || l_partkey || '.tif' AS path,
 CASE l_linenumber % 3 WHEN 0 THEN 'archive' WHEN 1 THEN 'local' ELSE 'backup' END AS tree FROM lineitem) """


def files(v):
    n = F.col("l_linenumber") % 3
    tree = F.when(n == 0, "archive").when(n == 1, "local").otherwise("backup")
    return v.table("lineitem").select(
        F.col("l_orderkey").alias("product"), F.when(F.col("l_linenumber") % 2 == 1, "VV").otherwise("VH").alias("pol"),
        F.concat(F.lit("/"), tree, F.lit("/p"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_partkey").cast("string"), F.lit(".tif")).alias("path"), tree.alias("tree"))


@query("pick_best_copy", "", _FILES_SQL + """, r AS (SELECT product, pol, path, CASE WHEN contains(path, '/local/') THEN 0 WHEN contains(path, '/backup/') THEN 1 ELSE 2 END AS preference FROM files)
SELECT product, pol, preference, path FROM (SELECT *, row_number() OVER (PARTITION BY product, pol ORDER BY preference, path) AS rn FROM r) q WHERE rn = 1""")
def _(v):
    return I.pick_best_copy(files(v), ["product", "pol"], ["/local/", "/backup/"])


@query("inventory_build", "", _FILES_SQL + """, m AS (SELECT product, min(path) FILTER (pol = 'VV') AS vv, min(path) FILTER (pol = 'VH') AS vh FROM files WHERE tree = 'local' GROUP BY product),
 f AS (SELECT product, min(path) FILTER (pol = 'VV') AS vv, min(path) FILTER (pol = 'VH') AS vh FROM files WHERE tree <> 'local' GROUP BY product)
SELECT o_orderkey AS product, coalesce(m.vv, f.vv) AS file_VV, coalesce(m.vh, f.vh) AS file_VH, m.vv IS NULL AND f.vv IS NOT NULL AS from_fallback_VV, m.vh IS NULL AND f.vh IS NOT NULL AS from_fallback_VH,
 concat_ws(';', CASE WHEN coalesce(m.vv, f.vv) IS NULL THEN 'VV' END, CASE WHEN coalesce(m.vh, f.vh) IS NULL THEN 'VH' END) AS missing, coalesce(m.vv, f.vv) IS NOT NULL AND coalesce(m.vh, f.vh) IS NOT NULL AS complete
FROM orders LEFT JOIN m ON m.product = o_orderkey LEFT JOIN f ON f.product = o_orderkey""")
def _(v):
    f = files(v)
    return I.inventory(v.table("orders").select(F.col("o_orderkey").alias("product")), f.where("tree = 'local'"), f.where("tree <> 'local'"), ["VV", "VH"])


@query("status_closure", "registry", ", " + _FILES_SQL[5:] + """, g AS (SELECT product, string_agg(DISTINCT tree, ';' ORDER BY tree) AS trees, string_agg(DISTINCT pol, ';' ORDER BY pol) AS pols FROM files GROUP BY product)
SELECT coalesce(r.product, g.product) AS product, r.product IS NOT NULL AS in_registry, coalesce(trees, '') AS trees, coalesce(pols, '') AS pols, coalesce(pols = 'VH;VV', false) AS complete
FROM (SELECT product FROM registry WHERE product % 10 <> 0) r FULL JOIN g USING (product)""")
def _(v):
    return I.status_closure(files(v), v.registry.where("product % 10 <> 0"), ["VV", "VH"])


@query("scene_availability", "registry", ", " + _FILES_SQL[5:] + """, h AS (SELECT product, bool_or(pol = 'VV') AS vv, bool_or(pol = 'VH') AS vh FROM files WHERE tree = 'local' GROUP BY product)
SELECT port, count(*) AS needed, count(*) FILTER (coalesce(vv, false)) AS vv, count(*) FILTER (coalesce(vh, false)) AS vh, count(*) FILTER (coalesce(vv, false) OR coalesce(vh, false)) AS any_pol,
 round(count(*) FILTER (coalesce(vv, false) OR coalesce(vh, false)) / count(*), 6) AS share FROM registry LEFT JOIN h USING (product) GROUP BY port""")
def _(v):
    return rounded(I.scene_availability(v.registry, files(v).where("tree = 'local'")))


@query("missing_scenes", "registry", ", " + _FILES_SQL[5:] + """, need AS (SELECT port, product, pol FROM registry, (SELECT unnest(['VV', 'VH']) AS pol) p), a AS (SELECT DISTINCT product, pol FROM files WHERE tree = 'archive')
SELECT n.port, n.product, n.pol, a.product IS NOT NULL AS in_archive FROM need n LEFT JOIN a ON a.product = n.product AND a.pol = n.pol WHERE NOT EXISTS (SELECT 1 FROM files l WHERE l.tree = 'local' AND l.product = n.product AND l.pol = n.pol)""")
def _(v):
    f = files(v)
    need = v.registry.select("port", "product", F.explode(F.array(F.lit("VV"), F.lit("VH"))).alias("pol"))
    return I.missing_scenes(need, f.where("tree = 'local'"), f.where("tree = 'archive'"))


# ---------------------------------------------------------------- cleaning

@query("clean_ws", "", r"SELECT p_partkey, trim(regexp_replace('  ' || replace(p_name, ' ', '   ') || chr(9) || p_type || ' ', '\s+', ' ', 'g')) AS name FROM part")
def _(v):
    raw = F.concat(F.lit("  "), F.replace(F.col("p_name"), F.lit(" "), F.lit("   ")), F.lit("\t"), F.col("p_type"), F.lit(" "))
    return v.table("part").select("p_partkey", X.clean_ws(raw).alias("name"))


_RAW_PORT_SQL = "CASE WHEN product % 3 = 0 THEN replace(port, '_', ' ') WHEN product % 3 = 1 THEN port || '_ ' ELSE port END"


def raw_ports(v):
    p = F.col("product") % 3
    return v.registry.withColumn("port", F.when(p == 0, F.replace("port", F.lit("_"), F.lit(" "))).when(p == 1, F.concat("port", F.lit("_ "))).otherwise(F.col("port")))


@query("canon_port", "registry", f""", r AS (SELECT product, {_RAW_PORT_SQL} AS raw_name, port FROM registry), k AS (SELECT raw_name, replace(port, '_', ' ') AS k FROM r)
SELECT raw_name, CASE WHEN k IN ('NATION 1', 'NATION 2') THEN 'Twin Port' ELSE k END AS canonical_name, count(*) AS rows FROM k GROUP BY ALL""")
def _(v):
    aliases = v.table("nation").where("n_nationkey in (1, 2)").select(F.col("n_name").alias("raw_name"), F.lit("Twin Port").alias("canonical_name"))
    return C.alias_usage(raw_ports(v), aliases)


@query("valid_mmsi", "", f"SELECT ok, count(*) AS n FROM (SELECT regexp_full_match({_MMSI_SQL}, '\\d{{9}}') AND {_MMSI_SQL} <> '000000000' AS ok FROM events) q GROUP BY ok")
def _(v):
    k = F.col("event_id")
    m = F.when(k % 77 == 0, "000000000").when(k % 31 == 0, F.col("user_id").cast("string")).otherwise((200000000 + F.col("user_id")).cast("string"))
    return v.table("events").groupBy(X.valid_mmsi(m).alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@query("in_bbox", "ais objects", """, b AS (SELECT port, min(x) AS west, max(x) AS east, 0.0 AS south, max(y) AS north FROM objects GROUP BY port) SELECT event_id FROM ais JOIN b USING (port) WHERE x BETWEEN west AND east AND y BETWEEN south AND north""")
def _(v):
    b = v.objects.groupBy("port").agg(F.min("x").alias("west"), F.max("x").alias("east"), F.lit(0.0).alias("south"), F.max("y").alias("north"))
    return C.in_bbox(v.ais, b, "port", "x", "y").select("event_id")


@query("quality_gate", "objects", "SELECT object_id, conf FROM objects WHERE screen_status = 'passed' AND conf >= 0.30")
def _(v):
    return C.quality_gate(v.objects).select("object_id", "conf")


_SIGNAL_SQL = """, s AS (SELECT object_id, product, port, cls % 2 = 0 AS a, cls < 7 AS b, conf > 0.1 AS c, d_coast < 1500 AS d, object_id % 3 = 0 AS e, port <> 3 AS f FROM objects)"""


def with_signals(v):
    o = v.objects.select(
        "*", F.when(F.col("cls") % 2 == 0, "unique_spatial_candidate").otherwise("none").alias("match_status"),
        F.when(F.col("cls") < 7, "fine").otherwise("coarse").alias("ais_class_level"), F.concat(F.lit("class_"), F.col("cls").cast("string")).alias("ais_final_class"),
        F.when(F.col("conf") > 0.1, "ok").otherwise("zero_only").alias("pixel_status"), F.when(F.col("d_coast") < 1500, "known").otherwise("missing").alias("coast_status"),
        F.when(F.col("object_id") % 3 == 0, "quay").alias("facility_kind"), (F.col("port") != 3).alias("map_available"))
    return C.support_signals(o, C.object_signals())


@query("support_signals", "objects", _SIGNAL_SQL + """ SELECT object_id, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) + CAST(f AS INT) AS support_i,
 concat_ws(';', CASE WHEN NOT a THEN 'ais_unique_match' END, CASE WHEN NOT b THEN 'fine_class_resolved' END, CASE WHEN NOT c THEN 'valid_area_ok' END, CASE WHEN NOT d THEN 'coast_known' END,
 CASE WHEN NOT e THEN 'facility_context' END, CASE WHEN NOT f THEN 'facility_map_available' END) AS support_missing FROM s""")
def _(v):
    return with_signals(v).select("object_id", "support_i", "support_missing")


@query("first_label", "", "SELECT c_custkey, lab AS label FROM (SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_mktsegment END), ''), CASE WHEN c_custkey % 4 = 0 THEN 'BUILDING' END) AS lab FROM customer) q WHERE lab IN ('BUILDING', 'MACHINERY')")
def _(v):
    k = F.col("c_custkey")
    d = v.table("customer").select("c_custkey", F.when(k % 2 == 0, " ").otherwise(F.col("c_mktsegment")).alias("a"), F.when(k % 4 == 0, "BUILDING").alias("b"))
    return C.first_label(d, ["a", "b"], ["BUILDING", "MACHINERY"]).select("c_custkey", "label")


_KIND_SQL = """, k AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'quay' WHEN 1 THEN 'harbour' WHEN 2 THEN 'dock' WHEN 3 THEN 'coastline' WHEN 4 THEN 'harbour_area' WHEN 5 THEN 'nav:fairway' WHEN 6 THEN 'seamark:anchorage' WHEN 7 THEN 'other' ELSE 'coastline_derived' END AS kind FROM part)"""


def kinds(v):
    m = F.col("p_partkey") % 9
    tag = lambda i, t: F.when(m == i, t)
    tags = {"man_made": F.when(m == 0, "quay").when(m == 8, "coastline_derived"), "harbour": tag(1, "yes"), "waterway": tag(2, "Dock"), "natural": tag(3, "coastline"),
            "landuse": tag(4, "harbour"), "seamark": F.when(m == 5, "Fairway").when(m == 6, "anchorage")}
    return v.table("part").select("p_partkey", C.facility_kind(tags).alias("kind"))


@query("facility_kind", "", "WITH p0 AS (SELECT 1)" + _KIND_SQL + " SELECT kind, count(*) AS n FROM k GROUP BY kind")
def _(v):
    return kinds(v).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("facility_groups", "", "WITH p0 AS (SELECT 1)" + _KIND_SQL + """, g AS (SELECT kind, unnest(CASE kind WHEN 'quay' THEN ['quay', 'facility'] WHEN 'dock' THEN ['quay', 'facility'] WHEN 'coastline' THEN ['coast'] WHEN 'coastline_derived' THEN ['coast_derived']
 WHEN 'nav:fairway' THEN ['nav'] WHEN 'seamark:anchorage' THEN ['anchorage', 'facility'] ELSE ['facility'] END) AS layer FROM k) SELECT layer, kind, count(*) AS n FROM g GROUP BY ALL""")
def _(v):
    return kinds(v).select("kind", F.explode(C.facility_groups(F.col("kind"))).alias("layer")).groupBy("layer", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("semantic_area", "cells", "SELECT port, CASE code WHEN 0 THEN 'nodata' WHEN 1 THEN 'water' WHEN 2 THEN 'built' ELSE 'land' END AS area, count(*) AS cells FROM cells GROUP BY ALL")
def _(v):
    code = F.element_at(F.array(F.lit(0), F.lit(80), F.lit(50), F.lit(10)), F.col("code") + 1)
    return v.cells.groupBy("port", C.semantic_area(code).alias("area")).agg(F.count(F.lit(1)).alias("cells"))


@query("relation_phi", "objects cells", """, c AS (SELECT port, cx, cy, n FROM cells) SELECT object_id, round(CASE WHEN object_id % 5 <> 0 AND d_coast <= 2000 THEN least(1, greatest(0, (2000 - d_coast) / 1500)) END, 6) AS coast,
 round(ln(1 + least(n, 64)) / ln(65), 6) AS crowd FROM objects o JOIN c ON c.port = o.port AND c.cx = floor(o.x / 1000) AND c.cy = floor(o.y / 1000)""")
def _(v):
    o = v.objects.withColumns({"cx": F.floor(F.col("x") / 1000), "cy": F.floor(F.col("y") / 1000)}).join(v.cells, ["port", "cx", "cy"])
    return rounded(o.select("object_id", C.proximity(F.col("d_coast"), F.col("object_id") % 5 != 0, C.COAST_RAMP).alias("coast"), C.crowding(F.col("n")).alias("crowd")))


@query("project_permitted", "objects", "SELECT object_id, x, y, size FROM objects")
def _(v):
    roles = {"object_id": "identifier", "x": "feature", "y": "feature", "size": "feature", "cls": "evaluator_only", "conf": "audit"}
    o = v.objects.select(*roles)
    perm = v.spark.createDataFrame([(c, r, r in ("identifier", "feature")) for c, r in roles.items()], "column string, role string, usable boolean")
    return C.project_permitted(o, perm, ["identifier", "feature"])


@query("assert_contract", "", """WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL) SELECT CAST(sum(c) AS BIGINT) AS rows, count(*) AS keys, count(*) FILTER (c > 1) AS duplicated_keys, CAST(0 AS BIGINT) AS empty_keys, count(*) FILTER (c > 1) = 0 AS ok FROM k""")
def _(v):
    return C.contract_report(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("distance_source", "objects", """SELECT CASE WHEN d_coast < 700 THEN 'osm_coastline' WHEN abs(x) < 900 THEN 'worldcover_derived' WHEN object_id % 2 = 0 THEN 'pipeline_worldcover' ELSE 'unavailable' END AS source, count(*) AS n FROM objects GROUP BY ALL""")
def _(v):
    s = C.distance_source(F.col("d_coast") * (2000.0 / 700.0), F.abs("x") * (2000.0 / 900.0), F.when(F.col("object_id") % 2 == 0, F.lit(1.0)))
    return v.objects.groupBy(s.alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("confidence_tier", "", "SELECT c_nationkey, n, CASE WHEN n >= 100 THEN 'high' WHEN n >= 10 THEN 'medium' ELSE 'low' END AS tier FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) q")
def _(v):
    return v.table("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).withColumn("tier", C.confidence_tier(F.col("n")))


@query("facility_temporal_valid", "", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) <= CAST(o_orderdate AS DATE) END AS valid FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(v):
    j = v.table("lineitem").join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edit = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_shipdate"))
    return j.select("l_orderkey", "l_linenumber", C.existed_at(edit, F.col("o_orderdate")).alias("valid"))


@query("blockers", "registry", """, l AS (SELECT l_orderkey AS product, count(*) AS n FROM lineitem GROUP BY ALL) SELECT r.product, concat_ws(';', CASE WHEN n IS NULL THEN 'no_ais_rows' END, CASE WHEN status = 'P' THEN 'fine_class_unresolved' END, CASE WHEN region = 'ASIA' THEN 'osm_facility_map' END) AS blockers,
 n IS NOT NULL AND status <> 'P' AND region <> 'ASIA' AS ready FROM registry r LEFT JOIN l USING (product)""")
def _(v):
    n = v.table("lineitem").groupBy(F.col("l_orderkey").alias("product")).agg(F.count(F.lit(1)).alias("n"))
    b = C.blockers({"no_ais_rows": F.col("n").isNull(), "fine_class_unresolved": F.col("status") == "P", "osm_facility_map": F.col("region") == "ASIA"})
    return v.registry.join(n, "product", "left").select("product", F.concat_ws(";", b).alias("blockers"), (F.size(b) == 0).alias("ready"))


@query("strict_ids", "", "SELECT CAST(o_orderkey AS VARCHAR) AS sample_id FROM orders")
def _(v):
    return C.strict_ids(v.table("orders").select(F.col("o_orderkey").alias("sample_id")), "sample_id")


@query("histogram_cells", "ais", """, c AS (SELECT mmsi, type_code, count(*) AS n FROM ais GROUP BY ALL)
SELECT mmsi, '{' || string_agg('"' || type_code || '":' || n, ',' ORDER BY type_code) || '}' AS hist, arg_min(type_code, struct_pack(a := -n, b := type_code)) AS top FROM c GROUP BY mmsi""")
def _(v):
    c = v.ais.groupBy("mmsi", "type_code").agg(F.count(F.lit(1)).alias("n"))
    h = c.groupBy("mmsi").agg(X.histogram_json(F.collect_list(F.struct("type_code", "n"))).alias("hist"))
    return h.withColumn("top", X.histogram_top(F.col("hist")))
