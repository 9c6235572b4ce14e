"""Port and product tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as C
from .base import query, rounded

_CLS = ", cl AS (SELECT mmsi, final_class AS cls FROM mapping WHERE status = 'fine_class_mapped')"


def classes(v):
    return v.mapping.where("status = 'fine_class_mapped'").select("mmsi", F.col("final_class").alias("cls"))


def sized(v):
    return v.ais.withColumns({"length": (F.col("event_id") % 700).cast("double"), "beam": (F.col("event_id") % 60).cast("double")})


@query("class_support", "objects", """SELECT port, cls, count(*) AS objects, count(*) FILTER (object_id % 3 = 0) AS matched, round(count(*)/sum(count(*)) OVER (PARTITION BY port), 6) AS share_of_port FROM objects GROUP BY port, cls""")
def _(v):
    return rounded(C.class_support(v.objects, "port", "cls", F.col("object_id") % 3 == 0))


@query("port_profile", "ais mapping", _CLS + """, g AS (SELECT port, count(*) AS ais_rows, count(DISTINCT mmsi) AS vessels, avg(CASE WHEN event_id % 700 BETWEEN 1 AND 499 THEN event_id % 700 END) AS mean_length, avg(CASE WHEN event_id % 60 > 0 THEN event_id % 60 END) AS mean_beam, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM ais GROUP BY port),
 v AS (SELECT port, cls, count(*) AS n FROM ais JOIN cl USING (mmsi) GROUP BY ALL), t AS (SELECT port, CAST(sum(n) AS BIGINT) AS classed_rows, arg_min(cls, struct_pack(a := -n, b := cls)) AS top_class, max(n)/sum(n) AS top_share FROM v GROUP BY port)
SELECT port, ais_rows, vessels, round(mean_length, 6) AS mean_length, round(mean_beam, 6) AS mean_beam, x_min, x_max, y_min, y_max, classed_rows, top_class, round(top_share, 6) AS top_share FROM g LEFT JOIN t USING (port)""")
def _(v):
    return rounded(C.port_profile(sized(v), classes(v)))


@query("class_shares", "ais mapping", _CLS + """, v AS (SELECT port, cls, count(*) AS n FROM ais JOIN cl USING (mmsi) GROUP BY ALL) SELECT port, cls, n, round(share, 6) AS share, rank FROM (SELECT port, cls, n, n/sum(n) OVER (PARTITION BY port) AS share, CAST(row_number() OVER (PARTITION BY port ORDER BY n DESC, cls) AS INT) AS rank FROM v) q WHERE rank <= 3""")
def _(v):
    return rounded(C.class_shares(v.ais, classes(v), k=3))


@query("port_meta", "registry", """, m AS (SELECT port, status, count(*) AS n FROM registry GROUP BY ALL), h AS (SELECT port, priority, count(*) AS n FROM registry GROUP BY ALL)
SELECT port, count(*) AS products, count(DISTINCT date) AS scene_dates, min(date) AS first_scene, max(date) AS last_scene, any_value(om) AS orbit_mode, any_value(hm) AS hour_mode FROM registry
 JOIN (SELECT port, arg_min(status, struct_pack(a := -n, b := status)) AS om FROM m GROUP BY port) USING (port) JOIN (SELECT port, arg_min(priority, struct_pack(a := -n, b := priority)) AS hm FROM h GROUP BY port) USING (port) GROUP BY port""")
def _(v):
    return C.port_meta(v.registry, "port", "date", "status", "priority")


@query("facility_pivot", "", """WITH f AS (SELECT p_partkey % 8 AS port, p_type || '_' || split_part(p_name, ' ', 2) AS kind FROM part), t AS (SELECT kind FROM f GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 3), r AS (SELECT kind, row_number() OVER (ORDER BY (SELECT count(*) FROM f WHERE f.kind = t.kind) DESC, kind) AS rn FROM t)
SELECT port, count(*) AS features, count(*) FILTER (kind = (SELECT kind FROM r WHERE rn = 1)) AS fac_top1, count(*) FILTER (kind = (SELECT kind FROM r WHERE rn = 2)) AS fac_top2, count(*) FILTER (kind = (SELECT kind FROM r WHERE rn = 3)) AS fac_top3, count(*) FILTER (kind LIKE '%ECON%' OR kind LIKE '%ring%') AS cheap FROM f GROUP BY port""")
def _(v):
    f = v.table("part").select((F.col("p_partkey") % 8).alias("port"), F.concat_ws("_", "p_type", F.split_part("p_name", F.lit(" "), F.lit(2))).alias("kind"))
    top = C.top_kinds(f, "kind", 3)
    out = C.facility_pivot(f, "port", "kind", top, {"cheap": ("ECON", "ring")})
    return out.withColumnsRenamed({f"fac_{k}": f"fac_top{i + 1}" for i, k in enumerate(top)})


@query("top_k_histogram", "", "SELECT p_brand, p_type, n, rank FROM (SELECT p_brand, p_type, count(*) AS n, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS INT) AS rank FROM part GROUP BY p_brand, p_type) q WHERE rank <= 2")
def _(v):
    from ..operators.rules import top_values

    return top_values(v.table("part"), ["p_brand"], "p_type", 2)


@query("port_summary", "objects", """, s AS (SELECT *, CAST(cls % 2 = 0 AS INT) + CAST(cls < 7 AS INT) + CAST(conf > 0.1 AS INT) + CAST(d_coast < 1500 AS INT) + CAST(object_id % 3 = 0 AS INT) + CAST(port <> 3 AS INT) AS k FROM objects)
SELECT port, count(*) AS objects, count(*) FILTER (object_id % 3 = 0) AS facility_hits, count(*) FILTER (d_coast < 500) AS near_coast, count(*) FILTER (k=0) AS support_0, count(*) FILTER (k=1) AS support_1, count(*) FILTER (k=2) AS support_2, count(*) FILTER (k=3) AS support_3, count(*) FILTER (k=4) AS support_4, count(*) FILTER (k=5) AS support_5, count(*) FILTER (k=6) AS support_6 FROM s GROUP BY port""")
def _(v):
    from .q_sources import with_signals

    return C.port_summary(with_signals(v), "port", {"facility_hits": F.col("facility_kind").isNotNull(), "near_coast": F.col("d_coast") < 500})


@query("coverage_counters", "", """SELECT 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY ALL""")
def _(v):
    return C.coverage_counters(v.table("lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("port_class_rollup", "objects", "SELECT port, cls, count(*) AS n FROM objects GROUP BY ROLLUP (port, cls)")
def _(v):
    return v.objects.rollup("port", "cls").agg(F.count(F.lit(1)).alias("n"))


_STATE = """, f AS (SELECT mmsi, 'filled' AS filled_class FROM mapping WHERE mmsi % 7 = 0), vs AS (SELECT {k}, a.mmsi, count(*) AS rows, min(t) AS t0, max(t) AS t1 FROM ais a GROUP BY ALL),
 st AS (SELECT vs.*, m.status, CASE WHEN m.status = 'fine_class_mapped' AND m.final_class IS NOT NULL THEN 'resolved' WHEN f.filled_class IS NOT NULL THEN 'filled' WHEN m.final_class IS NOT NULL THEN 'coarse' WHEN m.status IS NULL THEN 'unknown' WHEN m.status LIKE '%conflict%' THEN 'conflict' ELSE 'missing' END AS state FROM vs LEFT JOIN (SELECT * FROM mapping WHERE mmsi % 11 <> 0) m ON m.mmsi = vs.mmsi LEFT JOIN f ON f.mmsi = vs.mmsi)"""
_COVER = _STATE.format(k="product") + """, pc AS (SELECT product, CAST(sum(rows) AS BIGINT) AS ais_rows, count(*) AS vessels, min(t0) AS t_min, max(t1) AS t_max, count(*) FILTER (state IN ('resolved', 'filled')) AS fine_resolved, count(*) FILTER (state = 'filled') AS from_fill, count(*) FILTER (state = 'coarse') AS coarse,
 count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'conflict') AS conflict, count(*) FILTER (state = 'unknown') AS unknown FROM st GROUP BY product),
 al AS (SELECT r.product, coalesce(ais_rows, 0) AS ais_rows, coalesce(vessels, 0) AS vessels, t_min, t_max, coalesce(fine_resolved, 0) AS fine_resolved, coalesce(from_fill, 0) AS from_fill, coalesce(coarse, 0) AS coarse, coalesce(missing, 0) AS missing, coalesce(conflict, 0) AS conflict, coalesce(unknown, 0) AS unknown FROM (SELECT DISTINCT o_orderkey % 40 AS product FROM orders) r LEFT JOIN pc USING (product))"""


def coverage_inputs(v):
    reg = v.table("orders").select((F.col("o_orderkey") % 40).alias("product")).distinct()
    cur = v.mapping.where("mmsi % 11 <> 0")
    fil = v.mapping.where("mmsi % 7 = 0").select("mmsi", F.lit("filled").alias("filled_class"))
    return reg, cur, fil


@query("product_coverage", "ais mapping", _COVER + " SELECT * FROM al")
def _(v):
    reg, cur, fil = coverage_inputs(v)
    return C.product_coverage(v.ais, reg, cur, fil)


@query("coverage_summary", "ais mapping", _COVER + " SELECT count(*) AS products, count(*) FILTER (ais_rows = 0) AS without_rows, CAST(sum(ais_rows) AS BIGINT) AS ais_rows, CAST(sum(fine_resolved) AS BIGINT) AS fine_resolved, CAST(sum(from_fill) AS BIGINT) AS from_fill, CAST(sum(coarse) AS BIGINT) AS coarse, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(conflict) AS BIGINT) AS conflict, CAST(sum(unknown) AS BIGINT) AS unknown FROM al")
def _(v):
    reg, cur, fil = coverage_inputs(v)
    return C.coverage_summary(C.product_coverage(v.ais, reg, cur, fil))


@query("gap_list", "ais mapping", _STATE.format(k="port") + " SELECT mmsi, CAST(sum(rows) AS BIGINT) AS rows, min(coalesce(status, 'not_in_mapping')) AS status, string_agg(DISTINCT CAST(port AS VARCHAR), ';' ORDER BY CAST(port AS VARCHAR)) AS ports FROM st WHERE state IN ('missing', 'conflict', 'unknown') GROUP BY mmsi")
def _(v):
    _, cur, fil = coverage_inputs(v)
    return C.gap_list(v.ais, cur, fil)


@query("revisit_counts", "ais", """, v AS (SELECT port, mmsi, count(DISTINCT product) AS scenes, count(*) AS objects FROM ais GROUP BY ALL) SELECT port, count(*) AS vessels, count(*) FILTER (scenes >= 2) AS seen_2, count(*) FILTER (scenes >= 3) AS seen_3, count(*) FILTER (scenes >= 5) AS seen_5, CAST(coalesce(sum(objects) FILTER (scenes >= 2), 0) AS BIGINT) AS bag_objects,
 round(quantile_cont(scenes, 0.5), 6) AS scenes_p50, round(quantile_cont(scenes, 0.9), 6) AS scenes_p90 FROM v GROUP BY port""")
def _(v):
    return rounded(C.revisit_counts(v.ais, "port", "product", "mmsi"))


@query("robust_contrast", "dims", """, m AS (SELECT id, product, quantile_cont(x, 0.5) AS med, max(x) AS peak FROM dims GROUP BY ALL), d AS (SELECT id, product, quantile_cont(abs(x - med), 0.5) AS mad FROM dims JOIN m USING (id, product) GROUP BY ALL)
SELECT product, count(*) AS windows, round(100.0 * count(*) FILTER ((peak - med) / (mad + 1e-6) > 4)/count(*), 6) AS rate FROM m JOIN d USING (id, product) GROUP BY product""")
def _(v):
    """Each vector plays one image window, its entries the pixels."""
    return rounded(C.hit_rates(C.robust_contrast(v.dims, ["id", "product"], "product", "x"), "product", 4.0))


@query("scene_alignment", "ais", """SELECT product, count(*) AS points, round(100.0*count(*) FILTER (x < 5000)/count(*), 6) AS inside_pct, count(*) FILTER (event_id % 3 > 0) AS timed, count(*) FILTER (event_id % 3 > 0 AND t % 2 = 0) AS time_match, round(quantile_cont(x, 0.5), 6) AS speed_med, round(quantile_cont(y, 0.5), 6) AS length_med FROM ais GROUP BY product""")
def _(v):
    return rounded(C.scene_alignment(v.ais, "product", F.col("x") < 5000, F.col("event_id") % 3 > 0, F.col("t") % 2 == 0, "x", "y"))


@query("class_distribution", "", "SELECT p_brand, count(*) AS n, round(quantile_cont(p_retailprice, 0.25), 6) AS p25, round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(quantile_cont(p_retailprice, 0.75), 6) AS p75 FROM part GROUP BY p_brand HAVING count(*) >= 10")
def _(v):
    return rounded(C.class_distribution(v.table("part"), "p_brand", "p_retailprice"))


@query("validity_summary", "objects", "SELECT product, count(*) AS rows, round(count(*) FILTER (conf >= 0.3)/count(*), 6) AS valid_share, round(avg(conf), 9) AS mean_conf, round(avg(size), 9) AS mean_size, count(*) FILTER (size > 30) AS clipped FROM objects GROUP BY product")
def _(v):
    return rounded(C.validity_summary(v.objects.withColumn("c", F.col("size") > 30), "product", ["conf", "size"], "conf", "c", 0.3), 9).withColumn("valid_share", F.round("valid_share", 6))
