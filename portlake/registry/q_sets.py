"""Set algebra, folds and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sets as S
from .base import query, rounded


@query("union_sources", "facilities", """SELECT facility_id, CASE WHEN kind = 'dry' THEN 'unnamed' ELSE kind END AS kind, 'osm' AS source FROM facilities UNION ALL SELECT s_suppkey, 'coastline_derived', 'derived' FROM supplier""")
def _(v):
    a = v.facilities.select("facility_id", F.when(F.col("kind") == "dry", " ").otherwise(F.col("kind")).alias("kind"))
    b = v.table("supplier").select(F.col("s_suppkey").alias("facility_id"), F.lit(None).cast("string").alias("kind"))
    return S.union_sources({"osm": a, "derived": b}, {"osm": "unnamed", "derived": "coastline_derived"})


@query("lopo_class_sets", "objects", """, c AS (SELECT port, cls, count(*) AS n FROM objects WHERE cls <> 0 GROUP BY ALL), k AS (SELECT cls, sum(n) AS total FROM c GROUP BY cls), g AS (SELECT p.port, k.cls, coalesce(n, 0) AS t, total - coalesce(n, 0) AS s FROM (SELECT DISTINCT port FROM objects) p CROSS JOIN k LEFT JOIN c ON c.port = p.port AND c.cls = k.cls),
 o AS (SELECT port, coalesce(string_agg(CAST(cls AS VARCHAR), ';' ORDER BY cls) FILTER (t >= 6 AND s >= 6), '') AS shared, coalesce(string_agg(CAST(cls AS VARCHAR), ';' ORDER BY cls) FILTER (s >= 6 AND t < 6), '') AS source_private, coalesce(string_agg(CAST(cls AS VARCHAR), ';' ORDER BY cls) FILTER (t >= 6 AND s < 6), '') AS target_private FROM g GROUP BY port)
SELECT *, CASE WHEN source_private <> '' AND target_private <> '' THEN 'universal' WHEN source_private <> '' THEN 'partial' WHEN target_private <> '' THEN 'open' ELSE 'closed' END AS setting FROM o""")
def _(v):
    return S.fold_class_sets(v.objects, "port", "cls", 6, 0)


@query("reconcile_keys", "registry", """, b AS (SELECT DISTINCT l_orderkey AS product FROM lineitem WHERE l_orderkey % 9 <> 0), a AS (SELECT product FROM registry WHERE product % 7 <> 0)
SELECT product, 'right' AS missing_from FROM (SELECT product FROM a EXCEPT SELECT product FROM b) q UNION ALL SELECT product, 'left' FROM (SELECT product FROM b EXCEPT SELECT product FROM a) q""")
def _(v):
    b = v.table("lineitem").select(F.col("l_orderkey").alias("product")).where("product % 9 <> 0")
    return S.reconcile(v.registry.where("product % 7 <> 0"), b, "product")


@query("manifest_diff", "registry", """, e AS (SELECT product, port, CASE WHEN product % 2 = 0 THEN 'fit' ELSE 'eval' END AS role FROM registry WHERE product % 10 <> 0), a AS (SELECT product, port, CASE WHEN product % 4 = 0 THEN 'eval' WHEN product % 2 = 0 THEN 'fit' ELSE 'eval' END AS role FROM registry WHERE product % 13 <> 0)
SELECT * FROM (SELECT coalesce(e.product, a.product) AS product, coalesce(e.port, a.port) AS port, e.role AS expected, a.role AS actual, CASE WHEN a.role IS NULL THEN 'missing' WHEN e.role IS NULL THEN 'extra' WHEN e.role <> a.role THEN 'changed' END AS difference FROM e FULL JOIN a ON a.product = e.product AND a.port = e.port) q WHERE difference IS NOT NULL""")
def _(v):
    p = F.col("product")
    e = v.registry.where("product % 10 <> 0").select("product", "port", F.when(p % 2 == 0, "fit").otherwise("eval").alias("role"))
    a = v.registry.where("product % 13 <> 0").select("product", "port", F.when(p % 4 == 0, "eval").when(p % 2 == 0, "fit").otherwise("eval").alias("role"))
    return S.manifest_diff(e, a, ["product", "port"])


@query("role_check", "registry", """, m AS (SELECT region AS fold, product, status AS role FROM registry UNION ALL SELECT region, product, 'X' FROM registry WHERE product % 17 = 0), p AS (SELECT fold, product, count(DISTINCT role) AS k FROM m GROUP BY ALL)
SELECT fold, count(*) AS products, count(*) FILTER (k > 1) AS shared_roles, (SELECT count(*) FROM registry) - count(*) AS uncovered FROM p GROUP BY fold""")
def _(v):
    r = v.registry.select(F.col("region").alias("fold"), "product", F.col("status").alias("role"))
    return S.role_check(r.unionByName(r.where("product % 17 = 0").withColumn("role", F.lit("X"))), v.registry, "fold", "product")


_TILE = "CAST(floor({x} / 3) AS BIGINT) || '_' || CAST(floor({y} / 3) AS BIGINT)"


@query("tile_gaps", "objects facilities", f""", n AS (SELECT DISTINCT {_TILE.format(x='x/200', y='y/200')} AS tile FROM objects), h AS (SELECT DISTINCT {_TILE.format(x='x1/200', y='y1/200')} AS tile FROM facilities), u AS (SELECT DISTINCT {_TILE.format(x='x2/200', y='y2/200')} AS tile FROM facilities)
SELECT tile, CASE WHEN tile IN (SELECT tile FROM u) THEN 'unpublished' ELSE 'fetchable' END AS status FROM n WHERE tile NOT IN (SELECT tile FROM h)""")
def _(v):
    t = lambda x, y: F.concat_ws("_", F.floor(F.col(x) / 200 / 3).cast("string"), F.floor(F.col(y) / 200 / 3).cast("string")).alias("tile")
    return S.tile_gaps(v.objects.select(t("x", "y")), v.facilities.select(t("x1", "y1")), v.facilities.select(t("x2", "y2")))


@query("temporal_half_split", "registry", """, n AS (SELECT port, product, date, count(*) OVER (PARTITION BY port) AS n, row_number() OVER (PARTITION BY port ORDER BY date, product) AS rn FROM registry)
SELECT port, product, date, n, CASE WHEN rn <= greatest(1, n // 2) THEN 'adapt' ELSE 'eval' END AS role FROM n""")
def _(v):
    return S.split_half(v.registry, "port", "product", "date")


@query("pseudo_target_split", "objects", """, p AS (SELECT port, product, count(*) AS rows FROM objects GROUP BY ALL), h AS (SELECT *, count(*) OVER (PARTITION BY port) AS n, row_number() OVER (PARTITION BY port ORDER BY product) AS rn FROM p),
 g AS (SELECT port, max(n) AS products, CAST(sum(CASE WHEN rn <= greatest(1, n // 2) THEN rows ELSE 0 END) AS BIGINT) AS adapt_rows, CAST(sum(CASE WHEN rn > greatest(1, n // 2) THEN rows ELSE 0 END) AS BIGINT) AS eval_rows FROM h GROUP BY port)
SELECT *, CASE WHEN products < 4 THEN 'too_few_products' WHEN adapt_rows < 25 THEN 'adapt_too_small' WHEN eval_rows < 38 THEN 'eval_too_small' ELSE 'ok' END AS status FROM g""")
def _(v):
    g = S.pseudo_target_split(v.objects.withColumn("date", F.col("product")), "port", "product", "date", 4, 25)
    return g.withColumn("status", F.when((F.col("status") == "ok") & (F.col("eval_rows") < 38), "eval_too_small").otherwise(F.col("status")))


@query("lopo_folds", "registry", ", c AS (SELECT port, count(*) AS n FROM registry GROUP BY port) SELECT port, n AS target_rows, (SELECT count(*) FROM c) - 1 AS sources, CAST((SELECT sum(n) FROM c) - n AS BIGINT) AS source_rows, n >= 550 AND (SELECT sum(n) FROM c) - n >= 500 AS usable FROM c")
def _(v):
    return S.lopo_folds(v.registry, "port", 550, 500)


@query("inner_episodes", "objects", ", c AS (SELECT port, count(*) AS n FROM objects GROUP BY port) SELECT a.port AS p, b.port AS q, b.n AS held_rows, CAST((SELECT sum(n) FROM c) - a.n - b.n AS BIGINT) AS train_rows FROM c a JOIN c b ON a.port <> b.port WHERE b.n >= 50")
def _(v):
    return S.inner_episodes(v.objects, "port", 50)


@query("ordered_domain_pairs", "registry", ", c AS (SELECT port, count(*) AS n FROM registry GROUP BY port HAVING count(*) >= 580) SELECT a.port AS a, b.port AS b, a.n AS n_a, b.n AS n_b FROM c a JOIN c b ON a.port <> b.port")
def _(v):
    return S.ordered_pairs(v.registry, "port", 580)


@query("split_axes", "preds", """, a AS (SELECT 'port' AS axis, CAST(port AS VARCHAR) AS fold, truth, p1 FROM preds UNION ALL SELECT 'product', CAST(product AS VARCHAR), truth, p1 FROM preds UNION ALL SELECT 'block', CAST(id % 5 AS VARCHAR), truth, p1 FROM preds) SELECT axis, fold, count(*) AS n, round(avg(CAST(p1 = truth AS INT)), 6) AS accuracy FROM a GROUP BY ALL""")
def _(v):
    p = v.preds.select("id", "port", "product", (F.col("id") % 5).alias("block"), "truth", "p1")
    s = S.split_axes(p, v.features.select("id"), "id", ["port", "product", "block"])
    return rounded(s.groupBy("axis", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p1") == F.col("truth")).cast("int")).alias("accuracy")))
