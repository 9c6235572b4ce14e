"""Spatial joins and fields over objects, facilities, positions and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import axial
from ..grid import cell
from ..operators import fields as J
from ..operators import spatial as D
from ..operators import tracks as T
from .base import query, rounded

_SEG = """sqrt((x - (x1 + tt*(x2-x1)))*(x - (x1 + tt*(x2-x1))) + (y - (y1 + tt*(y2-y1)))*(y - (y1 + tt*(y2-y1))))"""
_T = "CASE WHEN (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) = 0 THEN 0 ELSE greatest(0, least(1, ((x-x1)*(x2-x1)+(y-y1)*(y2-y1)) / ((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) END"
_NEAR = f""", t AS (SELECT o.*, f.* EXCLUDE (port), {_T} AS tt FROM objects o JOIN facilities f USING (port)), dd AS (SELECT *, {_SEG} AS dist FROM t)"""
_D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)"

# a direction field over the same grid as the land-cover cells
_FIELD = """, field AS (SELECT port, (cx + 0.5)*1000 AS cell_x, (cy + 0.5)*1000 AS cell_y, n AS points, CAST((((cx*37 + cy*59) % 180) + 180) % 180 AS DOUBLE) AS direction, 1.0 + (((cx + cy) % 3) + 3) % 3 * 0.4 AS anisotropy FROM cells)"""


def field(v):
    c = v.cells
    return c.select(
        "port", ((F.col("cx") + 0.5) * 1000.0).alias("cell_x"), ((F.col("cy") + 0.5) * 1000.0).alias("cell_y"), F.col("n").alias("points"),
        F.pmod(F.col("cx") * 37 + F.col("cy") * 59, F.lit(180)).cast("double").alias("direction"),
        (1.0 + F.pmod(F.col("cx") + F.col("cy"), F.lit(3)) * 0.4).alias("anisotropy"))


@query("nearest_facility", "objects facilities", _NEAR + """ SELECT o.object_id, round(coalesce(min(dist) FILTER (dd.kind = 'liquid' AND dist <= 2000), 2000), 4) AS d_liquid, round(coalesce(min(dist) FILTER (dd.kind = 'dry' AND dist <= 2000), 2000), 4) AS d_dry
FROM objects o LEFT JOIN dd ON dd.object_id = o.object_id GROUP BY o.object_id""")
def _(v):
    return rounded(D.nearest_within(v.objects.select("object_id", "port", "x", "y"), v.facilities, ["port"], "object_id", ["liquid", "dry"], "kind").select(
        "object_id", "d_liquid", "d_dry"), 4)


@query("facility_hit", "objects facilities", _NEAR + """, b AS (SELECT object_id, min(struct_pack(dist := dist, facility_id := facility_id, kind := kind, element := element)) AS s FROM dd WHERE dist <= 600 GROUP BY object_id)
SELECT o.object_id, round(s.dist, 4) AS dist, s.facility_id AS facility_id, s.kind AS kind, s.element AS element FROM objects o LEFT JOIN b USING (object_id)""")
def _(v):
    o = v.objects.select("object_id", "port", "x", "y")
    return rounded(D.facility_hit(o, v.facilities, ["port"], "object_id", ["facility_id", "kind", "element"], "facility_id", 600.0).select(
        "object_id", "dist", "facility_id", "kind", "element"), 4)


_FIELD_NEAR = _FIELD + """, fd AS (SELECT object_id, axis_deg, min(struct_pack(d := sqrt((x-cell_x)*(x-cell_x)+(y-cell_y)*(y-cell_y)), cx := cell_x, cy := cell_y, p := points, dir := direction, an := anisotropy)) AS s
 FROM objects JOIN field USING (port) WHERE sqrt((x-cell_x)*(x-cell_x)+(y-cell_y)*(y-cell_y)) <= 2000 GROUP BY ALL)"""
_AXD = "abs((((axis_deg - {r} + 90) % 180 + 180) % 180) - 90)"


@query("field_angle", "objects cells", _FIELD_NEAR + f""" SELECT o.object_id, round(CASE WHEN s.an >= 1.5 THEN {_AXD.format(r='s.dir').replace('axis_deg', 'o.axis_deg')} END, 5) AS field_angle FROM objects o LEFT JOIN fd ON fd.object_id = o.object_id""")
def _(v):
    return rounded(D.field_angle(v.objects.select("object_id", "port", "x", "y", "axis_deg"), field(v), ["port"], "object_id").select("object_id", "field_angle"), 5)


@query("channel_angle", "objects cells facilities", _FIELD_NEAR + _NEAR + f""", ln AS (SELECT object_id, min(struct_pack(d := dist, f := facility_id, br := ((degrees(atan2(y2-y1, x2-x1)) % 180) + 180) % 180)) AS b FROM dd WHERE dist <= 400 GROUP BY object_id),
 a AS (SELECT o.object_id, CASE WHEN b IS NOT NULL THEN {_AXD.format(r='b.br').replace('axis_deg', 'o.axis_deg')} END AS la, CASE WHEN s.an >= 1.5 THEN {_AXD.format(r='s.dir').replace('axis_deg', 'o.axis_deg')} END AS fa FROM objects o LEFT JOIN ln USING (object_id) LEFT JOIN fd ON fd.object_id = o.object_id)
SELECT object_id, round(coalesce(la, fa), 5) AS channel_angle, CASE WHEN la IS NOT NULL THEN 'osm_fairway' WHEN fa IS NOT NULL THEN 'ais_traffic' END AS angle_source FROM a""")
def _(v):
    o = v.objects.select("object_id", "port", "x", "y", "axis_deg")
    return rounded(D.channel_angle(o, v.facilities, field(v), ["port"], "object_id", "facility_id", reach=400.0).select("object_id", "channel_angle", "angle_source"), 5)


@query("radius_counts", "objects", f"""SELECT a.object_id, count(*) FILTER ({_D2} <= 250000) - 1 AS n_r500, count(*) FILTER ({_D2} <= 1000000) - 1 AS n_r1000 FROM objects a JOIN objects b USING (port) GROUP BY a.object_id""")
def _(v):
    return D.radius_counts(v.objects, ["port"]).select("object_id", "n_r500", "n_r1000")


@query("nn_distance", "objects", f"""SELECT a.object_id, round(sqrt(min({_D2})), 4) AS nn FROM objects a JOIN objects b ON a.port = b.port AND a.object_id <> b.object_id GROUP BY a.object_id""")
def _(v):
    return rounded(D.nn_distance(v.objects, ["port"]).select("object_id", "nn"), 4)


@query("near_duplicates", "objects", f""", p AS (SELECT a.object_id AS i, b.object_id AS j, a.pol <> b.pol AS cp, a.tile <> b.tile AS ct FROM objects a JOIN objects b ON a.product = b.product AND a.object_id < b.object_id AND {_D2} <= 640000)
SELECT (SELECT count(*) FROM objects) AS rows, count(*) AS pairs, count(*) FILTER (cp) AS cross_pol, count(*) FILTER (NOT cp AND ct) AS cross_tile, count(*) FILTER (NOT cp AND NOT ct) AS same_tile,
 (SELECT count(DISTINCT k) FROM (SELECT i AS k FROM p UNION ALL SELECT j FROM p) u) AS rows_in_pairs, round(count(*) / (SELECT count(*) FROM objects), 6) AS pair_ratio FROM p""")
def _(v):
    return rounded(D.near_duplicates(v.objects, "product", "pol", "tile", 800.0))


@query("heading_dispersion", "objects", f""", g AS (SELECT a.object_id, count(*) AS n, sqrt(pow(avg(sin(radians(2*b.axis_deg))), 2) + pow(avg(cos(radians(2*b.axis_deg))), 2)) AS r FROM objects a JOIN objects b USING (port) WHERE {_D2} <= 1000000 GROUP BY a.object_id)
SELECT object_id, round(CASE WHEN n >= 3 AND r > 0 THEN degrees(sqrt(greatest(0, -2*ln(least(1, r)))))/2 END, 4) AS heading_spread FROM g""")
def _(v):
    return rounded(D.heading_dispersion(v.objects, ["port"]).select("object_id", "heading_spread"), 4)


@query("sample_cells", "objects cells", "SELECT object_id, coalesce(code, -1) AS code FROM objects o LEFT JOIN (SELECT * FROM cells WHERE n > 1) c ON c.port = o.port AND c.cx = floor(o.x/1000) AND c.cy = floor(o.y/1000)")
def _(v):
    return D.sample_cells(v.objects, v.cells.where("n > 1"), ["port"], 1000.0, "code").select("object_id", "code")


@query("nearshore_filter", "objects cells", """, land AS (SELECT port, (cx + 0.5)*1000 AS lx, (cy + 0.5)*1000 AS ly FROM cells WHERE code = 3)
SELECT object_id FROM objects o WHERE NOT EXISTS (SELECT 1 FROM land l WHERE l.port = o.port AND (o.x-lx)*(o.x-lx)+(o.y-ly)*(o.y-ly) <= (2*10*size)*(2*10*size))""")
def _(v):
    land = v.cells.where("code = 3").select("port", ((F.col("cx") + 0.5) * 1000.0).alias("lx"), ((F.col("cy") + 0.5) * 1000.0).alias("ly"))
    return D.nearshore_filter(v.objects, land, ["port"], "object_id", 2 * 10 * F.col("size")).select("object_id")


@query("proximity_by_group", "objects facilities", _NEAR + " SELECT object_id, round(min(dist) FILTER (kind = 'liquid'), 4) AS d_liquid, round(min(dist) FILTER (kind = 'dry'), 4) AS d_dry, round(min(dist), 4) AS d_any FROM dd WHERE dist <= 1500 GROUP BY object_id")
def _(v):
    return rounded(D.proximity_by_group(v.objects.select("object_id", "port", "x", "y"), v.facilities, ["port"], "object_id", ["liquid", "dry"], reach=1500.0).select("object_id", "d_liquid", "d_dry", "d_any"), 4)


@query("frame_calibrate", "objects", """, s AS (SELECT port, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM objects GROUP BY port)
SELECT object_id, round(100.0 + port + (x - mx) * (0.5 / (x1 - x0)), 6) AS lon, round(1.0*port + (y - my) * (0.4 / (y1 - y0)), 6) AS lat FROM objects JOIN s USING (port)""")
def _(v):
    p = F.col("port")
    box = v.objects.select("port").distinct().select(
        "port", (p + 100.0 - 0.25).alias("lon0"), (p + 100.0 + 0.25).alias("lon1"), (p - 0.2).alias("lat0"), (p + 0.2).alias("lat1"), (p + 100.0).alias("centre_lon"), (p + 0.0).alias("centre_lat"))
    return rounded(D.frame_calibrate(v.objects.select("object_id", "port", "x", "y"), box, "port").select("object_id", "lon", "lat"))


@query("hotspot_cell", "objects", ", c AS (SELECT port, CAST(floor(x/800) AS BIGINT) AS cx, CAST(floor(y/800) AS BIGINT) AS cy, count(*) AS n FROM objects GROUP BY ALL) SELECT port, cx, cy, n FROM (SELECT *, row_number() OVER (PARTITION BY port ORDER BY n DESC, cx, cy) AS rn FROM c) q WHERE rn = 1")
def _(v):
    return D.hotspot_cell(v.objects, "port", 800.0)


def _field_sql(g, extra=""):
    return f""", r AS (SELECT a.object_id, count(*) FILTER ({_D2} <= 250000) AS n2, count(*) FILTER ({_D2} <= 2250000) AS n5, count(*) AS n10, avg(sin(radians(b.axis_deg)*2)) FILTER ({_D2} <= 2250000) AS s2, avg(cos(radians(b.axis_deg)*2)) FILTER ({_D2} <= 2250000) AS c2
 FROM objects a JOIN objects b ON a.{g} = b.{g}{extra} AND {_D2} <= 9000000 GROUP BY a.object_id), z AS (SELECT *, ln(1+n2) AS l2, ln(1+n5) AS l5, ln(1+n10) AS l10, sqrt(s2*s2+c2*c2) AS conc, exp(-d_coast/2000) AS q FROM r JOIN objects USING (object_id))
SELECT object_id, round(l2-l5, 5) + 0.0 AS near_mid, round(l5-l10, 5) + 0.0 AS mid_far, round(l10, 5) AS far, round(n2/greatest(n10, 1), 5) AS share_near, round(s2, 5) + 0.0 AS sin2, round(c2, 5) + 0.0 AS cos2, round(conc, 5) AS concentration, round(l2*conc, 5) AS near_conc, round(q, 5) AS quay, round(l2*q, 5) AS near_quay, round(conc*q, 5) AS conc_quay FROM z"""


@query("pooled_field", "objects", _field_sql("port"))
def _(v):
    return rounded(J.pooled_field(v.objects, ["port"], "object_id", {"near": 500.0, "mid": 1500.0, "far": 3000.0}, quay="d_coast"), 5)


@query("scene_field", "objects", _field_sql("product"))
def _(v):
    return rounded(J.scene_field(v.objects, ["product"], "object_id", radii={"near": 500.0, "mid": 1500.0, "far": 3000.0}, quay="d_coast"), 5)


@query("local_context", "objects", f""", r AS (SELECT a.object_id, a.port, count(*) FILTER ({_D2} <= 62500) - 1 AS n_a, count(*) FILTER ({_D2} <= 250000) - 1 AS n_b, count(*) FILTER ({_D2} <= 1000000) - 1 AS n_c, count(*) FILTER ({_D2} <= 4000000) - 1 AS n_d,
 min(sqrt({_D2})) FILTER (a.object_id <> b.object_id) AS nn, avg(b.size) FILTER ({_D2} <= 250000) AS mean_size, stddev_pop(b.size) FILTER ({_D2} <= 250000) AS sd FROM objects a JOIN objects b USING (port) GROUP BY ALL), p AS (SELECT port, count(*) AS pn FROM objects GROUP BY port)
SELECT object_id, n_a, n_b, n_c, n_d, round(nn, 4) AS nn, round((n_c / (pi()*1000000)) / greatest(1e-9, pn / (pi()*1000000*50)), 4) AS relative_density, round(mean_size, 9) AS mean_size, round(CASE WHEN n_b > 0 THEN sd END, 4) AS sd_size FROM r JOIN p USING (port)""")
def _(v):
    d = J.local_context(v.objects, ["port"], "object_id")
    return d.select("object_id", "n_a", "n_b", "n_c", "n_d", F.round("mean_size", 9).alias("mean_size"), *[F.round(c, 4).alias(c) for c in ("nn", "relative_density", "sd_size")])


@query("density_normalised_proximity", "objects facilities", _NEAR + """, c AS (SELECT o.object_id, count(*) FILTER ((o.x-f.x1)*(o.x-f.x1)+(o.y-f.y1)*(o.y-f.y1) <= 6250000) AS k FROM objects o JOIN facilities f USING (port) GROUP BY o.object_id),
 m AS (SELECT object_id, min(dist) FILTER (kind = 'liquid' AND dist <= 8000) AS dl, min(dist) FILTER (kind = 'dry' AND dist <= 8000) AS dr FROM dd GROUP BY object_id),
 e AS (SELECT cls, dl / (1/(2*sqrt(greatest(1e-12, k/(pi()*6250000))))) AS l, dr / (1/(2*sqrt(greatest(1e-12, k/(pi()*6250000))))) AS r FROM objects JOIN c USING (object_id) JOIN m USING (object_id))
SELECT cls, count(*) AS n, round(quantile_cont(l, 0.5), 4) AS med_liquid, round(quantile_cont(r, 0.5), 4) AS med_dry FROM e GROUP BY cls HAVING count(*) >= 10""")
def _(v):
    o = v.objects.select("object_id", "port", "x", "y", "cls")
    d = D.proximity_by_group(o, v.facilities, ["port"], "object_id", ["liquid", "dry"], reach=8000.0)
    s = J.poisson_spacing(o, v.facilities.select("port", F.col("x1").alias("x"), F.col("y1").alias("y")), ["port"], "object_id", 2500.0)
    r = d.join(s, "object_id").select("cls", (F.col("d_liquid") / F.col("expected")).alias("liquid"), (F.col("d_dry") / F.col("expected")).alias("dry"))
    return rounded(J.class_medians(r, "cls", ["liquid", "dry"]), 4)


@query("nearest_cell_features", "objects cells", _FIELD_NEAR + """ SELECT object_id, round(ln(1 + s.p), 6) AS log_points, round(sin(radians(s.dir)), 6) AS sin_dir, round(cos(radians(s.dir)), 6) + 0.0 AS cos_dir, round(ln(1 + s.an), 6) AS log_anisotropy FROM fd""")
def _(v):
    return rounded(J.nearest_cell_features(v.objects.select("object_id", "port", "x", "y"), field(v), ["port"], "object_id", 2000.0))


@query("zone_mask", "cells", """, z AS (SELECT a.port, a.cx, a.cy, CASE WHEN a.code = 0 THEN 0 WHEN a.port = 6 THEN 4 WHEN a.code = 3 THEN 1 WHEN EXISTS (SELECT 1 FROM cells b WHERE b.port = a.port AND b.code = 3 AND ((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy))*1000000 <= 1500*1500) THEN 2 ELSE 3 END AS zone FROM cells a)
SELECT port, round(100.0*count(*) FILTER (zone = 1)/count(*), 6) AS land_pct, round(100.0*count(*) FILTER (zone = 2)/count(*), 6) AS near_pct, round(100.0*count(*) FILTER (zone = 3)/count(*), 6) AS offshore_pct, round(100.0*count(*) FILTER (zone = 0)/count(*), 6) AS invalid_pct, round(100.0*count(*) FILTER (zone = 4)/count(*), 6) AS unknown_pct FROM z GROUP BY port""")
def _(v):
    z = J.zone_mask(v.cells, ["port"], 1000.0, F.col("code") == 3, F.col("code") != 0, F.col("port") != 6, 1500.0)
    return rounded(J.zone_shares(z, ["port"]))


@query("coast_cells", "cells", "SELECT a.port, a.cx, a.cy FROM cells a WHERE a.code = 1 AND EXISTS (SELECT 1 FROM cells b WHERE b.port = a.port AND b.code <> 1 AND abs(a.cx-b.cx) + abs(a.cy-b.cy) = 1)")
def _(v):
    return J.coast_cells(v.cells, ["port"], F.col("code") == 1).select("port", "cx", "cy")


@query("dedup_density", "objects", f""", e AS (SELECT a.object_id AS i, b.object_id AS j FROM objects a JOIN objects b ON a.product = b.product AND {_D2} <= 640000),
 reach AS (SELECT * FROM reach_), c AS (SELECT i, min(j) AS rep FROM reach GROUP BY i), k AS (SELECT o.*, m.merged FROM objects o JOIN (SELECT rep, count(*) AS merged FROM c GROUP BY rep) m ON m.rep = o.object_id)
SELECT a.object_id, any_value(a.merged) AS merged, count(*) FILTER ({_D2} <= 1000000) - 1 AS n_r1000, round(min(sqrt({_D2})) FILTER (a.object_id <> b.object_id), 4) AS nn FROM k a JOIN k b USING (port) GROUP BY a.object_id""".replace("reach AS (SELECT * FROM reach_)", "reach AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM reach r JOIN e ON r.j = e.i)"))
def _(v):
    return rounded(J.dedup_then_density(v.objects, ["product"], ["port"], "object_id", 800.0, {"r1000": 1000.0}).select("object_id", "merged", "n_r1000", "nn"), 4)


@query("density_by_class", "objects", f""", d AS (SELECT a.object_id, a.port, a.cls, count(*) FILTER ({_D2} <= 250000) - 1 AS n FROM objects a JOIN objects b USING (port) GROUP BY ALL)
SELECT port, cls, count(*) AS objects, round(count(*) / sum(count(*)) OVER (PARTITION BY port), 6) AS share_of_port, round(avg(n), 6) AS mean_neighbours FROM d GROUP BY port, cls""")
def _(v):
    """Flagship: radius join, then support and density by port and class."""
    from ..operators.coverage import class_support

    n = D.radius_counts(v.objects, ["port"], {"r500": 500.0})
    s = class_support(n, "port", "cls", extra={"mean_neighbours": F.avg("n_r500")})
    return rounded(s)


@query("field_feasibility", "objects", """, c AS (SELECT port, floor(x/2000) AS cx, floor(y/2000) AS cy, count(*) AS n FROM objects GROUP BY ALL), m AS (SELECT port, avg(n) AS per_cell FROM c GROUP BY port)
SELECT port, round((max(x)-min(x))/1000, 6) AS width_km, round((max(y)-min(y))/1000, 6) AS height_km, count(DISTINCT product) AS products, count(*) AS objects, round(count(*) FILTER (size > 5)/count(*), 6) AS heading_fill, count(DISTINCT cls) AS classes, round(any_value(per_cell), 6) AS per_cell FROM objects JOIN m USING (port) GROUP BY port""")
def _(v):
    from ..operators.coverage import field_feasibility

    return rounded((field_feasibility(v.objects.withColumn("axis_deg", F.when(F.col("size") > 5, F.col("axis_deg"))), "port", 2000.0)))


# ---------------------------------------------------------------- tracks

_STEPS = """, l AS (SELECT *, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py FROM ais WINDOW w AS (PARTITION BY product, mmsi ORDER BY t, event_id)),
 steps AS (SELECT port, event_id, t, x, y, t - pt AS dt, x - px AS dx, y - py AS dy FROM l WHERE t - pt > 0 AND t - pt <= {gap} AND sqrt((x-px)*(x-px)+(y-py)*(y-py)) >= 20)"""


@query("track_steps", "ais", _STEPS.format(gap=3600) + " SELECT event_id, t, x, y, dt, round(dx, 4) + 0.0 AS dx, round(dy, 4) + 0.0 AS dy FROM steps")
def _(v):
    return rounded(T.track_steps(v.ais, ["product", "mmsi"], 3600).select("event_id", "t", "x", "y", "dt", "dx", "dy"), 4)


_CELLDIR = """, u AS (SELECT port, CAST(floor(x/2000) AS BIGINT) AS cx, CAST(floor(y/2000) AS BIGINT) AS cy, dx/(sqrt(dx*dx+dy*dy)+1e-9) AS u, dy/(sqrt(dx*dx+dy*dy)+1e-9) AS v FROM steps), g AS (SELECT port, cx, cy, count(*) AS points, var_samp(u) AS a, covar_samp(u, v) AS b, var_samp(v) AS c FROM u GROUP BY ALL HAVING count(*) >= 8)"""


@query("cell_direction", "ais", _STEPS.format(gap=21600) + _CELLDIR + """ SELECT port, cx, cy, points, round(((degrees(0.5*atan2(2*b, a-c)) + 180) % 180), 3) AS direction, round(((a+c)/2 + sqrt((a-c)*(a-c)/4 + b*b)) / ((a+c)/2 - sqrt((a-c)*(a-c)/4 + b*b) + 1e-12), 4) AS anisotropy FROM g""")
def _(v):
    s = T.track_steps(v.ais.withColumn("_p", F.col("port")), ["product", "mmsi", "port"], 21600)
    d = T.cell_direction(s, ["port"], 2000.0).select("port", "cx", "cy", "points", F.round("direction", 3).alias("direction"), F.round("anisotropy", 4).alias("anisotropy"))
    return d


@query("traffic_field", "ais", _STEPS.format(gap=21600) + _CELLDIR + ", q AS (SELECT port, count(*) AS rows FROM ais GROUP BY port) SELECT port, any_value(rows) AS ais_rows, count(*) AS cells, CAST(sum(points) AS BIGINT) AS steps FROM g JOIN q USING (port) GROUP BY port")
def _(v):
    from ..plans.traffic_field import traffic_field

    cells, summary = traffic_field(v.ais, max_gap=21600, size=2000.0)
    return summary


@query("visit_sessions", "ais", """, l AS (SELECT mmsi, t, CASE WHEN t - lag(t) OVER (PARTITION BY mmsi ORDER BY t) <= 21600 THEN 0 ELSE 1 END AS s FROM ais), g AS (SELECT mmsi, t, sum(s) OVER (PARTITION BY mmsi ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT mmsi, min(t) AS start, max(t) AS "end", count(*) AS fixes FROM g GROUP BY mmsi, k""")
def _(v):
    return T.visit_sessions(v.ais, ["mmsi"], 21600)


@query("windowed_cell_counts", "ais", """SELECT time_bucket(INTERVAL 6 HOUR, make_timestamp(t * 1000000)) AS window_start, port, CAST(floor(x/2000) AS BIGINT) AS cx, CAST(floor(y/2000) AS BIGINT) AS cy, count(*) AS points FROM ais GROUP BY ALL""")
def _(v):
    a = v.ais.withColumn("ts", F.timestamp_seconds("t"))
    return T.windowed_cell_counts(a, ["port"], 2000.0, "6 hours")


@query("object_table", "objects facilities", _NEAR + f""", d AS (SELECT object_id, min(dist) FILTER (kind = 'liquid' AND dist <= 2000) AS q, min(struct_pack(d := dist, f := facility_id)) FILTER (dist <= 25) AS h FROM dd GROUP BY object_id), n AS (SELECT a.object_id, count(*) FILTER ({_D2} <= 250000) - 1 AS n5, count(*) FILTER ({_D2} <= 1000000) - 1 AS n10, min(sqrt({_D2})) FILTER (a.object_id <> b.object_id) AS nn FROM objects a JOIN objects b USING (product) GROUP BY a.object_id)
SELECT o.object_id AS det, o.port, CAST(o.product AS VARCHAR) AS product, o.x, o.y, 64.0 AS area_px2, 16.0 AS long_px, 4.0 AS short_px, 90.0 AS axis_deg, round(coalesce(q, 2000), 3) AS d_quay, 2000.0 AS d_coast_m, h.f AS facility_id, round(h.d, 3) AS facility_distance,
 n5 AS n_r500, n10 AS n_r1000, round(nn, 3) AS nn FROM objects o LEFT JOIN d USING (object_id) JOIN n USING (object_id)""")
def _(v):
    """The whole plan over surrogate detections; a slice of its columns is compared."""
    from ..plans.object_table import object_table

    pt = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    det = v.objects.select(
        F.col("product").cast("string").alias("product"), F.col("pol").cast("string").alias("pol"), F.array(F.lit(0.0), F.lit(0.0)).alias("roi_origin"),
        F.col("object_id").cast("string").alias("detection_id"), F.lit(0).alias("ordinal"), F.array(pt(8.0, 2.0), pt(-8.0, 2.0), pt(-8.0, -2.0), pt(8.0, -2.0)).alias("source_pts"),
        F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((2.0, 8.0), (2.0, -8.0), (-2.0, -8.0), (-2.0, 8.0))]).alias("pts"),
        F.col("conf"), F.lit("unique_spatial_candidate").alias("match_status"), F.lit("ok").alias("pixel_status"), F.lit("known").alias("coast_status"),
        F.lit(None).cast("double").alias("coast_exclusion_m"), F.col("object_id").cast("string").alias("matched_mmsi"), F.lit(None).cast("string").alias("candidate_mmsi"))
    reg = v.objects.select(F.col("product").cast("string").alias("product"), "port").distinct().select(
        "product", "port", F.lit("2024-01-01").alias("start_date"), F.array(*[F.lit(g) for g in (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]).alias("geo"))
    fac = v.facilities.select("port", "facility_id", "element", F.when(F.col("kind") == "liquid", "quay").otherwise("silo_yard").alias("facility_kind"), "x1", "y1", "x2", "y2")
    dates = v.facilities.select("facility_id", "element", F.lit("2023-05-01").alias("timestamp"))
    cls = v.mapping.select(F.col("mmsi").cast("string").alias("mmsi"), "status", "final_class")
    none = cls.where("false")
    fin = none.select("mmsi", "final_class", F.lit("fine").alias("class_level"), F.lit("s").alias("source"))
    t = object_table(det, reg, fac, dates, fin, cls, none.select("mmsi", "final_class", F.lit("s").alias("source")), v.cells.select("port", "cx", "cy", "code"), field(v), 1000.0)
    return rounded(t.select(
        F.col("detection_id").cast("long").alias("det"), "port", "product", "x", "y", "area_px2", "long_px", "short_px", "axis_deg", "d_quay", "d_coast_m", "facility_id", "facility_distance",
        "n_r500", "n_r1000", "nn"), 3)


# areas: squares around every object, each third with a square hole; the distance of a point to such a square is closed
_AREAS = """, ar AS (SELECT object_id AS area_id, port, x AS ax, y AS ay, 600.0 * (1 + object_id % 4) AS h, CASE WHEN object_id % 3 = 0 THEN 150.0 * (1 + object_id % 4) ELSE 0.0 END AS hole, CASE WHEN object_id % 2 = 0 THEN 'basin' ELSE 'dock' END AS kind FROM objects),
 p AS (SELECT o.object_id, ar.*, greatest(abs(o.x - ax), abs(o.y - ay)) AS c, greatest(abs(o.x - ax) - h, 0.0) AS ox, greatest(abs(o.y - ay) - h, 0.0) AS oy FROM objects o JOIN ar USING (port)),
 d AS (SELECT object_id, area_id, kind, CASE WHEN c < hole THEN hole - c WHEN c <= h THEN 0.0 ELSE sqrt(ox*ox + oy*oy) END AS dist FROM p)"""


def areas(v):
    """Ring segments of the squares and their holes."""
    k = F.col("object_id") % 4 + 1
    a = v.objects.select(
        F.col("object_id").alias("area_id"), "port", "x", "y", F.when(F.col("object_id") % 2 == 0, "basin").otherwise("dock").alias("kind"),
        F.explode(F.when(F.col("object_id") % 3 == 0, F.array(600.0 * k, 150.0 * k)).otherwise(F.array(600.0 * k))).alias("h"))
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    ends = F.explode(F.array(*[F.array(*[F.lit(float(c)) for c in (*corners[i], *corners[(i + 1) % 4])]) for i in range(4)]))
    s = a.withColumn("e", ends)
    at = lambda c, i: (F.col(c) + F.col("h") * F.get("e", F.lit(i)))
    return s.select("port", "area_id", "kind", at("x", 0).alias("x1"), at("y", 1).alias("y1"), at("x", 2).alias("x2"), at("y", 3).alias("y2"))


@query("nearest_area", "objects", _AREAS + """ SELECT o.object_id, round(coalesce(min(dist) FILTER (d.kind = 'basin' AND dist <= 2000), 2000), 4) AS d_basin, round(coalesce(min(dist) FILTER (d.kind = 'dock' AND dist <= 2000), 2000), 4) AS d_dock
FROM objects o LEFT JOIN d USING (object_id) GROUP BY o.object_id""")
def _(v):
    o = v.objects.select("object_id", "port", "x", "y")
    return rounded(D.nearest_within(o, areas(v), ["port"], "object_id", ["basin", "dock"], "kind", area="area_id").select("object_id", "d_basin", "d_dock"), 4)


@query("area_hit", "objects", _AREAS + """, b AS (SELECT object_id, min(struct_pack(dist := round(dist, 4), area_id := area_id, kind := kind)) AS s FROM d WHERE dist <= 25 GROUP BY object_id)
SELECT o.object_id, s.dist AS dist, s.area_id AS area_id, s.kind AS kind FROM objects o LEFT JOIN b USING (object_id)""")
def _(v):
    o = v.objects.select("object_id", "port", "x", "y")
    return rounded(D.facility_hit(o, areas(v), ["port"], "object_id", ["area_id", "kind"], "area_id", area="area_id").select("object_id", "dist", "area_id", "kind"), 4)


@query("proximity_to_areas", "objects", _AREAS + """ SELECT object_id, round(min(dist) FILTER (kind = 'basin'), 4) AS d_basin, round(min(dist) FILTER (kind = 'dock'), 4) AS d_dock, round(min(dist), 4) AS d_any FROM d WHERE dist <= 2000 GROUP BY object_id""")
def _(v):
    o = v.objects.select("object_id", "port", "x", "y")
    return rounded(D.proximity_by_group(o, areas(v), ["port"], "object_id", ["basin", "dock"], area="area_id").select("object_id", "d_basin", "d_dock", "d_any"), 4)
