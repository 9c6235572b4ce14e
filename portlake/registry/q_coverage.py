"""Audits of the object table and of supervision."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from .base import query, rounded


@query("duplicate_audit", "", """WITH o AS (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem) SELECT count(*) AS rows, CAST(count(*) - count(DISTINCT (l_orderkey, l_partkey)) AS BIGINT) AS same_position, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_ids, CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS id_collisions FROM o""")
def _(v):
    li = v.table("lineitem").select("l_orderkey", "l_partkey", F.concat_ws("|", "l_orderkey", "l_linenumber").alias("oid"))
    return A.duplicate_audit(li, ["l_orderkey", "l_partkey"], "oid")


@query("label_provenance", "mapping", "SELECT final_class, status, count(*) AS objects FROM mapping WHERE final_class IS NOT NULL GROUP BY ALL")
def _(v):
    return A.label_provenance(v.mapping, ["final_class", "status"])


@query("temporal_evidence", "", """WITH j AS (SELECT l_suppkey % 8 AS port, CASE WHEN l_linenumber % 4 > 0 THEN 'quay' END AS kind, CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_shipdate AS DATE) END AS edit, CAST(o_orderdate AS DATE) AS scene FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT port, count(*) FILTER (kind IS NULL) AS no_facility_hit, count(*) FILTER (kind IS NOT NULL AND edit IS NULL) AS hit_not_dated, count(*) FILTER (kind IS NOT NULL AND edit <= scene) AS existed_before_scene, count(*) FILTER (kind IS NOT NULL AND edit > scene) AS edited_after_scene FROM j GROUP BY port""")
def _(v):
    n = F.col("l_linenumber")
    j = v.table("lineitem").join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_suppkey") % 8).alias("port"), F.when(n % 4 > 0, "quay").alias("kind"), F.when(n % 3 > 0, F.col("l_shipdate")).alias("edit"), F.col("o_orderdate").alias("scene"))
    return A.temporal_evidence(j, "port", "kind", "edit", "scene")


@query("deployable_share", "objects", "SELECT port, count(*) AS objects, count(*) FILTER (screen_status = 'passed' AND conf > 0.2) AS deployable, round(count(*) FILTER (screen_status = 'passed' AND conf > 0.2)/count(*), 6) AS share FROM objects GROUP BY port")
def _(v):
    return rounded(A.deployable_share(v.objects, "port", (F.col("screen_status") == "passed") & (F.col("conf") > 0.2)))


@query("distance_truncation", "objects", """SELECT 'd_coast' AS "column", count(*) FILTER (d_coast >= 800) AS at_cap, count(*) FILTER (d_coast < 800) AS has_value FROM objects UNION ALL SELECT 'size', count(*) FILTER (size >= 800), count(*) FILTER (size < 800) FROM objects""")
def _(v):
    return A.distance_truncation(v.objects, ["d_coast", "size"], 800.0)


_SUP = """, frozen AS (SELECT id, truth AS label FROM preds WHERE id % 3 = 0), added AS (SELECT id, product, 'A1' AS tier, p1 AS label FROM preds WHERE id % 4 = 0 UNION ALL SELECT id, product, 'A2', p2 FROM preds WHERE id % 2 = 0), roles AS (SELECT DISTINCT product, CASE WHEN product < 30 THEN 'fit' ELSE 'eval' END AS role FROM preds)"""


def supervision(v):
    p = v.preds
    added = p.where("id % 4 = 0").select("id", "product", F.lit("A1").alias("tier"), F.col("p1").alias("label")).unionByName(
        p.where("id % 2 = 0").select("id", "product", F.lit("A2").alias("tier"), F.col("p2").alias("label")))
    roles = p.select("product").distinct().withColumn("role", F.when(F.col("product") < 30, "fit").otherwise("eval"))
    return p.where("id % 3 = 0").select("id", F.col("truth").alias("label")), added, roles


@query("source_support_delta", "preds", _SUP + """ SELECT tier, count(*) AS added, count(*) FILTER (f.id IS NULL) AS novel, count(DISTINCT a.label) AS classes, count(DISTINCT a.product) AS products, count(*) FILTER (role <> 'fit') AS role_violations FROM added a LEFT JOIN frozen f ON f.id = a.id JOIN roles r ON r.product = a.product GROUP BY tier""")
def _(v):
    frozen, added, roles = supervision(v)
    return A.source_support_delta(frozen, added, "id", roles)


@query("added_per_class", "preds", _SUP + " SELECT tier, label, count(*) AS n FROM added GROUP BY ALL")
def _(v):
    return A.added_per_class(supervision(v)[1])
