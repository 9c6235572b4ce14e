"""Scalar geometry, angles, identifiers and score arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scores as S
from ..functions import text as X
from ..operators import clean as C
from .base import query, rounded

# a rotated rectangle around each object, from its position, size and axis
_BOX_SQL = """, box AS (SELECT object_id, [
 {'x': x + size*cos(radians(axis_deg)) - size*0.25*sin(radians(axis_deg)), 'y': y + size*sin(radians(axis_deg)) + size*0.25*cos(radians(axis_deg))},
 {'x': x - size*cos(radians(axis_deg)) - size*0.25*sin(radians(axis_deg)), 'y': y - size*sin(radians(axis_deg)) + size*0.25*cos(radians(axis_deg))},
 {'x': x - size*cos(radians(axis_deg)) + size*0.25*sin(radians(axis_deg)), 'y': y - size*sin(radians(axis_deg)) - size*0.25*cos(radians(axis_deg))},
 {'x': x + size*cos(radians(axis_deg)) + size*0.25*sin(radians(axis_deg)), 'y': y + size*sin(radians(axis_deg)) - size*0.25*cos(radians(axis_deg))}] AS p
 FROM objects) """


def boxes(v):
    a, s = F.radians("axis_deg"), F.col("size")
    corner = lambda i, j: F.struct(
        (F.col("x") + i * s * F.cos(a) - j * s * 0.25 * F.sin(a)).alias("x"), (F.col("y") + i * s * F.sin(a) + j * s * 0.25 * F.cos(a)).alias("y"))
    return v.objects.select("*", F.array(corner(1, 1), corner(-1, 1), corner(-1, -1), corner(1, -1)).alias("p"))


@query("polygon_shape", "objects", _BOX_SQL + """, e AS (SELECT object_id, p, [sqrt((p[i % 4 + 1].x - p[i].x)**2 + (p[i % 4 + 1].y - p[i].y)**2) FOR i IN [1, 2, 3, 4]] AS side,
 [p[i].x * p[i % 4 + 1].y - p[i % 4 + 1].x * p[i].y FOR i IN [1, 2, 3, 4]] AS crs FROM box)
SELECT object_id, round(abs(crs[1] + crs[2] + crs[3] + crs[4]) / 2, 3) AS area, round((p[1].x + p[2].x + p[3].x + p[4].x) / 4, 3) AS cx,
 round((p[1].y + p[2].y + p[3].y + p[4].y) / 4, 3) AS cy, round(list_max(side), 3) AS long_side, round(list_min(side), 3) AS short_side FROM e""")
def _(v):
    side = G.side_lengths(F.col("p"))
    c = G.poly_centroid(F.col("p"))
    return rounded(boxes(v).select(
        "object_id", G.poly_area(F.col("p")).alias("area"), c["x"].alias("cx"), c["y"].alias("cy"),
        F.array_max(side).alias("long_side"), F.array_min(side).alias("short_side")), 3)


@query("long_axis", "objects", _BOX_SQL + """, e AS (SELECT object_id, list_min([{'l': -((p[i % 4 + 1].x - p[i].x) * (p[i % 4 + 1].x - p[i].x) + (p[i % 4 + 1].y - p[i].y) * (p[i % 4 + 1].y - p[i].y)), 'i': i,
 'dx': p[i % 4 + 1].x - p[i].x, 'dy': p[i % 4 + 1].y - p[i].y} FOR i IN [1, 2, 3, 4]]) AS b FROM box), a AS (SELECT object_id, (degrees(atan2(b.dy, b.dx)) % 180 + 180) % 180 AS a FROM e)
SELECT object_id, round(least(a, 180 - a), 4) + 0.0 AS fold FROM a""")
def _(v):
    """Direction of the rectangle's longest edge, folded into [0, 90]; a rectangle of size 0 has none, which counts as 0."""
    a = G.long_axis_deg(F.col("p"))
    return rounded(boxes(v).select("object_id", F.least(a, 180.0 - a).alias("fold")), 4)


@query("axis_offset", "objects facilities", """, f AS (SELECT port, min(facility_id) AS facility_id, arg_min(((degrees(atan2(y2 - y1, x2 - x1)) % 180) + 180) % 180, facility_id) AS ref FROM facilities GROUP BY port)
SELECT object_id, facility_id, round(abs((((axis_deg - ref + 90) % 180 + 180) % 180) - 90), 5) AS angle FROM objects JOIN f USING (port)""")
def _(v):
    ref = G.axial(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))))
    f = v.facilities.groupBy("port").agg(F.min("facility_id").alias("facility_id"), F.min_by(ref, "facility_id").alias("ref"))
    return rounded(v.objects.join(f, "port").select("object_id", "facility_id", G.axial_diff(F.col("axis_deg"), F.col("ref")).alias("angle")), 5)


@query("affine_round_trip", "objects", """, t AS (SELECT object_id, x, y, 500.0 + port AS g1, 10.0 AS g2, 0.5 AS g3, 90000.0 AS g4, 0.25 AS g5, -10.0 AS g6 FROM objects),
 w AS (SELECT *, g1 + x*g2 + y*g3 AS wx, g4 + x*g5 + y*g6 AS wy FROM t)
SELECT object_id, round(wx, 5) AS wx, round(wy, 5) AS wy, round(((wx - g1)*g6 - (wy - g4)*g3) / (g2*g6 - g3*g5), 5) AS col, round(((wy - g4)*g2 - (wx - g1)*g5) / (g2*g6 - g3*g5), 5) AS row FROM w""")
def _(v):
    t = F.array(500.0 + F.col("port"), *[F.lit(g) for g in (10.0, 0.5, 90000.0, 0.25, -10.0)])
    w = v.objects.withColumn("w", G.affine_apply(t, F.col("x"), F.col("y")))
    back = G.affine_invert(t, F.col("w.x"), F.col("w.y"))
    return rounded(w.select("object_id", F.col("w.x").alias("wx"), F.col("w.y").alias("wy"), back["col"].alias("col"), back["row"].alias("row")), 5)


@query("utm_round_trip")
def _(v):
    """Position on the globe from the object's coordinates, through the grid and back."""
    lon, lat = F.col("x") / 100.0, F.col("y") / 60.0
    d = v.objects.select("object_id", lon.alias("lon"), lat.alias("lat")).withColumn("zone", G.utm_zone(F.col("lon"), F.col("lon")))
    d = d.withColumn("p", G.utm_forward(F.col("lon"), F.col("lat"), F.col("zone")))
    d = d.withColumn("b", G.utm_inverse(F.col("p.x"), F.col("p.y"), F.col("zone")))
    return rounded(d.select("object_id", "zone", F.col("p.x").alias("easting"), F.col("p.y").alias("northing"),
                            (F.abs(F.col("b.lon") - F.col("lon")) + F.abs(F.col("b.lat") - F.col("lat"))).alias("error_deg")), 6)


@query("local_metres", "objects", """, o AS (SELECT object_id, port, x / 1000 AS lon, 30 + y / 1000 AS lat FROM objects), c AS (SELECT port, min(lon) AS lon0, min(lat) AS lat0 FROM o GROUP BY port)
SELECT object_id, round((lon - lon0)*111320*cos(radians(lat0)), 4) AS mx, round((lat - lat0)*110540, 4) AS my FROM o JOIN c USING (port)""")
def _(v):
    o = v.objects.select("object_id", "port", (F.col("x") / 1000).alias("lon"), (30 + F.col("y") / 1000).alias("lat"))
    c = o.groupBy("port").agg(F.min("lon").alias("lon0"), F.min("lat").alias("lat0"))
    m = G.local_metres(*[F.col(k) for k in ("lon", "lat", "lon0", "lat0")])
    return rounded(o.join(c, "port").select("object_id", m["x"].alias("mx"), m["y"].alias("my")), 4)


@query("tile_name", "objects", """, o AS (SELECT object_id, x / 25 AS lon, y / 50 AS lat FROM objects), t AS (SELECT object_id, CAST(floor(lon / 3) * 3 AS INT) AS a, CAST(floor(lat / 3) * 3 AS INT) AS b FROM o)
SELECT object_id, 'ESA_WorldCover_10m_2021_v200_' || CASE WHEN b >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(b) AS VARCHAR), 2, '0') || CASE WHEN a >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(a) AS VARCHAR), 3, '0') || '_Map.tif' AS tile FROM t""")
def _(v):
    return v.objects.select("object_id", X.tile_name(F.col("x") / 25, F.col("y") / 50).alias("tile"))


@query("tiles_for_bbox", "objects", """, b AS (SELECT port, min(x / 100) AS w, max(x / 100) AS e, min(y / 100) AS s, max(y / 100) AS n FROM objects GROUP BY port),
 m AS (SELECT *, 1000 / 111320.0 AS k, (1000 / 111320.0) / greatest(0.2, cos(radians((s + n) / 2))) AS kl FROM b),
 g AS (SELECT port, unnest(range(CAST(floor((w - kl) / 3) AS INT), CAST(floor((e + kl) / 3) AS INT) + 1)) * 3 AS lon, s, n, k FROM m),
 h AS (SELECT port, lon, unnest(range(CAST(floor((s - k) / 3) AS INT), CAST(floor((n + k) / 3) AS INT) + 1)) * 3 AS lat FROM g)
SELECT port, CAST(lon AS INT) AS lon, CAST(lat AS INT) AS lat FROM h""")
def _(v):
    b = v.objects.groupBy("port").agg(*[f(F.col(c) / 100).alias(a) for f, c, a in (
        (F.min, "x", "w"), (F.max, "x", "e"), (F.min, "y", "s"), (F.max, "y", "n"))])
    t = X.tile_corners(F.col("w"), F.col("s"), F.col("e"), F.col("n"), 1000.0)
    return b.select("port", F.explode(t).alias("t")).select("port", "t.lon", "t.lat")


@query("grid_cells", "objects", """SELECT port, CAST(floor(x / 500) AS BIGINT) AS cx, CAST(floor(y / 500) AS BIGINT) AS cy, (floor(x / 500) + 0.5) * 500 AS mid_x, (floor(y / 500) + 0.5) * 500 AS mid_y, count(*) AS n FROM objects GROUP BY ALL""")
def _(v):
    from ..grid import cell

    d = v.objects.select("port", cell("x", 500).alias("cx"), cell("y", 500).alias("cy")).groupBy("port", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    return d.withColumns({"mid_x": (F.col("cx") + 0.5) * 500.0, "mid_y": (F.col("cy") + 0.5) * 500.0})


@query("spatial_blocks", "objects", """SELECT concat_ws('|', product, CAST(floor(x / 1000) AS BIGINT), CAST(floor(y / 1000) AS BIGINT)) AS block, count(*) AS n FROM objects GROUP BY ALL""")
def _(v):
    return v.objects.groupBy(X.spatial_block(F.col("product"), F.col("x"), F.col("y")).alias("block")).agg(F.count(F.lit(1)).alias("n"))


@query("object_id_parts", "objects", """SELECT concat_ws('|', product, pol, tile, object_id) AS oid, CAST(product AS VARCHAR) AS product_id, CAST(object_id AS VARCHAR) AS detection FROM objects""")
def _(v):
    d = v.objects.select(X.object_id(*[F.col(c) for c in ("product", "pol", "tile", "object_id")]).alias("oid"))
    return d.select("oid", X.id_part(F.col("oid"), 1).alias("product_id"), X.id_part(F.col("oid"), 4).alias("detection"))


_PRODUCT_SQL = """, p AS (SELECT o_orderkey AS k, 'S1' || CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END || '_IW_GRDH_1SDV_' || strftime(o_orderdate, '%Y%m%d') || 'T'
 || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || '00_' || strftime(o_orderdate, '%Y%m%d') || 'T235959_' || lpad(CAST(o_custkey % 999999 AS VARCHAR), 6, '0') || '_0ABCDE_1234' AS name FROM orders)"""


def product_names(v):
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    two = lambda m: F.lpad((k % m).cast("string"), 2, "0")
    return v.table("orders").select(k.alias("k"), F.concat(
        F.lit("S1"), F.when(k % 2 == 0, "A").otherwise("B"), F.lit("_IW_GRDH_1SDV_"), d, F.lit("T"), two(24), two(60), F.lit("00_"), d,
        F.lit("T235959_"), F.lpad((F.col("o_custkey") % 999999).cast("string"), 6, "0"), F.lit("_0ABCDE_1234")).alias("name"))


@query("product_orbit", "", "WITH p0 AS (SELECT 1)" + _PRODUCT_SQL + """, q AS (SELECT k, substr(name, 1, 3) AS platform, CAST(o_orderdate AS DATE) AS date, o_custkey % 999999 AS orbit, k % 24 + (k % 60) / 60.0 + 103.8 / 15.0 AS h FROM p JOIN orders ON k = o_orderkey),
 r AS (SELECT *, h % 24 AS solar FROM q)
SELECT k, platform, date, CAST(orbit AS INT) AS orbit, CAST((((orbit - 1) % 175) + 175) % 175 + 1 AS INT) AS rel_orbit, round(solar, 5) AS solar, CASE WHEN solar BETWEEN 15 AND 21 THEN 'desc' WHEN solar BETWEEN 2 AND 9 THEN 'asc' ELSE '?' END AS direction FROM r""")
def _(v):
    f = X.product_fields(F.col("name"))
    d = product_names(v).select("k", *[c.alias(n) for n, c in f.items()]).withColumn("solar", X.solar_hour(F.col("hour"), F.col("minute"), F.lit(103.8)))
    return rounded(d.select("k", "platform", "date", "orbit", X.relative_orbit(F.col("orbit")).cast("int").alias("rel_orbit"), "solar", X.pass_direction(F.col("solar")).alias("direction")), 5)


@query("score_statistics", "preds", """, e AS (SELECT id, s1, list_max(s1) AS mx, m1, p1 FROM preds), x AS (SELECT *, list_transform(s1, lambda z: exp(z - mx)) AS ex FROM e), t AS (SELECT *, list_sum(ex) AS tot FROM x), q AS (SELECT *, list_transform(ex, lambda z: z / tot) AS p FROM t)
SELECT id, round(list_max(p), 6) AS top1, round(-list_sum(list_transform(p, lambda z: z * ln(z + 1e-12))), 6) AS entropy, m1 AS margin, round(mx + ln(tot), 6) AS energy, p1 AS pred FROM q""")
def _(v):
    s = F.col("s1")
    d = v.preds.withColumn("p", S.softmax(s))
    return rounded(d.select("id", F.array_max("p").alias("top1"), S.entropy(F.col("p")).alias("entropy"), S.margin(s).alias("margin"), S.energy(s).alias("energy"), S.argmax(s).alias("pred")))


@query("hull_geometry", "objects", """SELECT object_id, round(ln(1 + size*3*10), 6) AS log_length, round(ln(1 + size*10), 6) AS log_width, round(ln(1 + size*size*3*10*10), 6) AS log_area, round(size*3 / greatest(1e-6, size), 6) AS aspect, round(cos(radians(2*axis_deg)), 6) + 0.0 AS cos2 FROM objects""")
def _(v):
    s = F.col("size")
    return rounded(v.objects.select("object_id", *[c.alias(n) for n, c in G.hull_geometry(s * 3, s, s * s * 3, F.col("axis_deg"), 10.0).items()]))


@query("loa_radius", "objects", "SELECT object_id, round(2*size / (111320.0*greatest(0.2, abs(cos(radians(y / 50))))), 8) AS radius_deg FROM objects")
def _(v):
    return rounded(v.objects.select("object_id", G.loa_radius_deg(F.col("size"), F.col("y") / 50).alias("radius_deg")), 8)


@query("hash_order", "objects", """SELECT object_id, port, rn FROM (SELECT object_id, port, row_number() OVER (PARTITION BY port ORDER BY sha256(CAST(object_id AS VARCHAR))) AS rn FROM objects) q WHERE rn <= 20""")
def _(v):
    from ..operators.selective import cap_per_group

    return cap_per_group(v.objects, ["port"], [X.hash_key(F.col("object_id"))], 20, keep="rn").select("object_id", "port", "rn")


@query("parent_class", "preds", """, m AS (SELECT unnest(range(0, 9)) AS fine, unnest(['cargo','cargo','cargo','tanker','tanker','tanker','other','other','other']) AS coarse)
SELECT id, coarse FROM preds JOIN m ON truth = fine""")
def _(v):
    from ..operators.metrics import parent_class

    names = ["cargo"] * 3 + ["tanker"] * 3 + ["other"] * 3
    m = v.spark.createDataFrame(list(enumerate(names)), "fine int, coarse string")
    return parent_class(v.preds, m, "truth", "drop").select("id", "coarse")


@query("rarity", "preds", """, c AS (SELECT port, p1, count(*) AS n FROM preds GROUP BY ALL), g AS (SELECT p.port, k.c AS p1, coalesce(n, 1) AS n FROM (SELECT DISTINCT port FROM preds) p, (SELECT unnest(range(10)) AS c) k LEFT JOIN c ON c.port = p.port AND c.p1 = k.c)
SELECT port, CAST(p1 AS INT) AS cls, round((1.0 / n) / avg(1.0 / n) OVER (PARTITION BY port), 6) AS rarity FROM g""")
def _(v):
    from ..operators.gates import rarity

    return rounded(rarity(v.preds, "port", "p1", 10))
