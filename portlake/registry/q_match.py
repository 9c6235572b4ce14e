"""Class layers, dates, match tiers, key joins and label tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match as M
from ..operators import rules as R
from .base import query, rounded
from .q_sources import with_signals

_LAYERS = """, final AS (SELECT mmsi, final_class || '_f' AS final_class, CASE WHEN mmsi % 4 = 0 THEN 'coarse' ELSE 'fine' END AS class_level, 'layer' AS source FROM mapping WHERE mmsi % 3 = 0 AND final_class IS NOT NULL),
 filled AS (SELECT mmsi, 'filled_' || (mmsi % 6) AS final_class, 'rule' AS source FROM mapping WHERE mmsi % 2 = 0)"""


def final_layer(v):
    k = F.col("mmsi")
    return v.mapping.where("mmsi % 3 = 0 and final_class is not null").select(
        "mmsi", F.concat("final_class", F.lit("_f")).alias("final_class"), F.when(k % 4 == 0, "coarse").otherwise("fine").alias("class_level"), F.lit("layer").alias("source"))


def filled_layer(v):
    return v.mapping.where("mmsi % 2 = 0").select("mmsi", F.concat(F.lit("filled_"), (F.col("mmsi") % 6).cast("string")).alias("final_class"), F.lit("rule").alias("source"))


@query("resolve_class", "ais mapping", _LAYERS + """ SELECT event_id, coalesce(f.final_class, c.final_class, g.final_class) AS ais_final_class, CASE WHEN f.mmsi IS NOT NULL THEN f.class_level WHEN coalesce(c.final_class, g.final_class) IS NOT NULL THEN 'fine' END AS ais_class_level,
 CASE WHEN f.mmsi IS NOT NULL THEN f.source WHEN c.mmsi IS NOT NULL THEN 'curated_mapping_layer' ELSE g.source END AS ais_class_source
 FROM ais a LEFT JOIN final f ON f.mmsi = a.mmsi LEFT JOIN (SELECT * FROM mapping WHERE status = 'fine_class_mapped' AND final_class IS NOT NULL) c ON c.mmsi = a.mmsi LEFT JOIN filled g ON g.mmsi = a.mmsi""")
def _(v):
    return M.resolve_class(v.ais.select("event_id", "mmsi"), final_layer(v), v.mapping, filled_layer(v)).drop("mmsi")


_SIG = ("ais_unique_match", "fine_class_resolved", "valid_area_ok", "coast_known", "facility_context", "facility_map_available")


@query("refresh_class", "objects mapping", """, s AS (SELECT object_id, cls % 2 = 0 AS a, conf > 0.1 AS c, d_coast < 1500 AS d, object_id % 3 = 0 AS e, port <> 3 AS f FROM objects), l AS (SELECT mmsi, final_class || CASE WHEN mmsi % 5 = 2 THEN '_coarse' ELSE '' END AS cls FROM mapping WHERE final_class IS NOT NULL),
 j AS (SELECT s.*, l.cls, coalesce(l.cls NOT LIKE '%\\_coarse' ESCAPE '\\', false) AS b FROM s LEFT JOIN l ON l.mmsi = s.object_id)
SELECT object_id, cls AS ais_final_class, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) + CAST(f AS INT) AS support_i,
 concat_ws(';', CASE WHEN NOT a THEN 'ais_unique_match' END, CASE WHEN NOT b THEN 'fine_class_resolved' END, CASE WHEN NOT c THEN 'valid_area_ok' END, CASE WHEN NOT d THEN 'coast_known' END, CASE WHEN NOT e THEN 'facility_context' END, CASE WHEN NOT f THEN 'facility_map_available' END) AS support_missing FROM j""")
def _(v):
    layer = v.mapping.where("final_class is not null").select(
        "mmsi", F.concat("final_class", F.when(F.col("mmsi") % 5 == 2, "_coarse").otherwise("")).alias("final_class"), F.lit("fine").alias("class_level"), F.lit("layer").alias("source"))
    o = with_signals(v).withColumns({"matched_mmsi": F.col("object_id"), "ais_class_source": F.lit("old")})
    return M.refresh_class(o, layer, _SIG).select("object_id", "ais_final_class", "support_i", "support_missing")


@query("attach_dates", "facilities", """, d AS (SELECT CASE WHEN o_orderkey % 20 = 0 THEN 'way' ELSE 'node' END AS element, o_orderkey AS facility_id, CAST(o_orderdate AS DATE) AS ts FROM orders WHERE o_orderkey % 30 <> 0)
SELECT f.facility_id, f.element, d.ts AS facility_edit_ts FROM facilities f LEFT JOIN d ON d.element = f.element AND d.facility_id = f.facility_id""")
def _(v):
    k = F.col("o_orderkey")
    d = v.table("orders").where("o_orderkey % 30 <> 0").select(F.when(k % 20 == 0, "way").otherwise("node").alias("element"), k.alias("facility_id"), F.to_date("o_orderdate").alias("timestamp"))
    return M.attach_dates(v.facilities.select("facility_id", "element"), d)


_TIER_SQL = """, o AS (SELECT object_id, abs(x)/4 AS x, abs(y)/4 AS y, 1704067200 + object_id*5000 AS t FROM objects), p AS (SELECT mmsi % 12 AS mmsi, event_id, x/10 AS x, y/10 AS y, t FROM ais),
 c AS (SELECT object_id, mmsi, event_id, sqrt((o.x-p.x)*(o.x-p.x)+(o.y-p.y)*(o.y-p.y)) AS d, (o.x-p.x)*(o.x-p.x)+(o.y-p.y)*(o.y-p.y) AS d2, abs(p.t - o.t) AS adt FROM o JOIN p ON abs(p.t - o.t) <= 1800),
 r AS (SELECT object_id, count(*) FILTER (d2 <= 22500 AND adt <= 600) AS n1, count(DISTINCT mmsi) FILTER (d2 <= 22500 AND adt <= 600) AS k1, arg_min(struct_pack(m := mmsi, d := d, a := adt), struct_pack(d := d2, a := adt, i := event_id)) FILTER (d2 <= 22500 AND adt <= 600) AS b1,
  count(*) FILTER (d2 <= 250000 AND adt <= 1800) AS n2, count(DISTINCT mmsi) FILTER (d2 <= 250000 AND adt <= 1800) AS k2, arg_min(struct_pack(m := mmsi, d := d, a := adt), struct_pack(d := d2, a := adt, i := event_id)) FILTER (d2 <= 250000 AND adt <= 1800) AS b2 FROM c GROUP BY object_id)"""


def tier_inputs(v):
    o = v.objects.select("object_id", (F.abs("x") / 4).alias("x"), (F.abs("y") / 4).alias("y"), (F.lit(1704067200) + F.col("object_id") * 5000).alias("t"))
    a = v.ais.select((F.col("mmsi") % 12).alias("mmsi"), "event_id", (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"), "t")
    return o, a


@query("match_tiers", "objects ais", _TIER_SQL + """ SELECT o.object_id, coalesce(n1, 0) AS t1_records, coalesce(k1, 0) AS t1_vessels, CASE WHEN coalesce(k1, 0) = 0 THEN 'no_candidate' WHEN k1 = 1 THEN 'unique_candidate' ELSE 'ambiguous' END AS t1_status, CASE WHEN k1 = 1 THEN b1.m END AS t1_mmsi, round(CASE WHEN k1 = 1 THEN b1.d END, 4) AS t1_distance, CASE WHEN k1 = 1 THEN b1.a END AS t1_abs_dt,
 coalesce(n2, 0) AS t2_records, coalesce(k2, 0) AS t2_vessels, CASE WHEN coalesce(k2, 0) = 0 THEN 'no_candidate' WHEN k2 = 1 THEN 'unique_candidate' ELSE 'ambiguous' END AS t2_status, CASE WHEN k2 = 1 THEN b2.m END AS t2_mmsi, round(CASE WHEN k2 = 1 THEN b2.d END, 4) AS t2_distance, CASE WHEN k2 = 1 THEN b2.a END AS t2_abs_dt FROM o LEFT JOIN r USING (object_id)""")
def _(v):
    o, a = tier_inputs(v)
    return rounded(M.match_tiers(o, a, "object_id", {"t1": (150.0, 600), "t2": (500.0, 1800)}).drop("x", "y", "t"), 4)


@query("bag_reuse", "objects ais", _TIER_SQL + """, m AS (SELECT object_id % 40 AS scene, b2.m AS mmsi FROM r WHERE k2 = 1) SELECT scene, mmsi, count(*) AS objects FROM m GROUP BY ALL HAVING count(*) > 1 ORDER BY objects DESC, scene, mmsi LIMIT 10""")
def _(v):
    o, a = tier_inputs(v)
    m = M.match_tiers(o, a, "object_id", {"t2": (500.0, 1800)}).withColumn("scene", F.col("object_id") % 40)
    return M.bag_reuse(m, "scene", "t2_mmsi").select("scene", F.col("t2_mmsi").alias("mmsi"), "objects")


@query("semi_join_keys", "", """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) q WHERE rn = 1""")
def _(v):
    w = v.table("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    li = v.table("lineitem").join(w, "l_orderkey", "left_semi")
    return M.semi_join_keys(li, li.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("ordinal_join", "objects", """, a AS (SELECT product, pol, object_id, cls, row_number() OVER (PARTITION BY product, pol ORDER BY object_id) AS j FROM objects), b AS (SELECT product, pol, object_id AS other_id, cls AS other_cls, row_number() OVER (PARTITION BY product, pol ORDER BY x, object_id) AS j FROM objects)
SELECT product, pol, count(*) AS rows, round(avg(CAST(cls = other_cls AS INT)), 6) AS agreement FROM a JOIN b USING (product, pol, j) GROUP BY ALL""")
def _(v):
    o = v.objects
    b = o.select("product", "pol", F.col("object_id").alias("other_id"), F.col("cls").alias("other_cls"), "x")
    j = M.ordinal_join(o.select("product", "pol", "object_id", "cls"), b, ["product", "pol"], [F.col("object_id")], [F.col("x"), F.col("other_id")])
    return rounded(j.groupBy("product", "pol").agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("cls") == F.col("other_cls")).cast("int")).alias("agreement")))


_TRUTH = """, truth AS (SELECT id, 'frozen' AS tier, truth AS label FROM preds WHERE id % 3 <> 0 UNION ALL SELECT id, 'boost' AS tier, (truth + CAST(id % 7 = 0 AS INT)) AS label FROM preds WHERE id % 2 = 0)"""


@query("label_join_eval", "preds", _TRUTH + """, j AS (SELECT t.tier, p.p1, l.label FROM preds p CROSS JOIN (SELECT DISTINCT tier FROM truth) t LEFT JOIN truth l ON l.id = p.id AND l.tier = t.tier)
SELECT tier, count(*) AS predictions, count(*) FILTER (label < 8) AS evaluable, count(*) FILTER (label IS NULL) AS unlabelled, count(*) FILTER (label >= 8) AS out_of_vocabulary, round(avg(CASE WHEN label < 8 THEN CAST(p1 = label AS INT) END), 6) AS accuracy FROM j GROUP BY tier""")
def _(v):
    p = v.preds
    t = p.where("id % 3 <> 0").select("id", F.lit("frozen").alias("tier"), F.col("truth").alias("label")).unionByName(
        p.where("id % 2 = 0").select("id", F.lit("boost").alias("tier"), (F.col("truth") + (F.col("id") % 7 == 0).cast("int")).alias("label")))
    return rounded(M.label_join_eval(p.select("id", F.col("p1").alias("pred")), t, "id", list(range(8))))


@query("tier_agreement", "preds", ", a AS (SELECT truth AS f, CASE WHEN id % 4 <> 0 THEN p1 END AS a FROM preds) SELECT count(*) AS rows, count(a) AS covered, round(avg(CASE WHEN a IS NOT NULL THEN CAST(a = f AS INT) END), 6) AS exact, round(avg(CASE WHEN a IS NOT NULL THEN CAST(a // 3 = f // 3 AS INT) END), 6) AS coarse FROM a")
def _(v):
    p = v.preds
    parents = v.spark.range(10).select(F.col("id").cast("int").alias("fine"), F.floor(F.col("id") / 3).alias("coarse"))
    return rounded(M.tier_agreement(p.select("id", F.col("truth").alias("label")), p.where("id % 4 <> 0").select("id", F.col("p1").alias("label")), "id", parents))


@query("eval_views", "preds", """, o AS (SELECT CASE WHEN id % 3 = 0 THEN truth END AS t1, CASE WHEN id % 2 = 0 THEN p1 END AS t2 FROM preds), w AS (SELECT 't1' AS tier, t1 AS label FROM o UNION ALL SELECT 't1_t2', coalesce(t1, t2) FROM o), g AS (SELECT tier, label, 'fine' AS grain, coalesce(label < 6, false) AS inside FROM w UNION ALL SELECT tier, label, 'coarse', coalesce(label < 9, false) FROM w)
SELECT grain, tier, count(*) FILTER (label IS NOT NULL AND inside) AS evaluable, count(*) FILTER (label IS NULL) AS unlabelled, count(*) FILTER (label IS NOT NULL AND NOT inside) AS out_of_space FROM g GROUP BY ALL""")
def _(v):
    o = v.preds.select("id", F.when(F.col("id") % 3 == 0, F.col("truth")).alias("t1"), F.when(F.col("id") % 2 == 0, F.col("p1")).alias("t2"))
    parents = v.spark.range(9).select(F.col("id").cast("int").alias("fine"), F.floor(F.col("id") / 3).alias("coarse"))
    return M.eval_views(o, parents, list(range(6)))


# ---------------------------------------------------------------- rules

_PURE = """, e AS (SELECT unnest(string_split(codes, ';')) AS code, final_class AS cls FROM mapping WHERE status = 'fine_class_mapped' AND final_class IS NOT NULL), c AS (SELECT code, cls, count(*) AS n FROM e GROUP BY ALL),
 rules AS (SELECT code, arg_min(cls, struct_pack(a := -n, b := cls)) AS rule_class, max(n) / sum(n) AS purity, CAST(sum(n) AS BIGINT) AS support FROM c GROUP BY code)"""


@query("mine_rules", "mapping", _PURE + " SELECT code, rule_class, round(purity, 6) AS purity, support FROM rules")
def _(v):
    return rounded(R.mine_rules(v.mapping))


@query("rule_distribution", "mapping", _PURE + " SELECT code, cls, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY code ORDER BY n DESC, cls) AS INT) AS rank FROM c) q WHERE rank <= 3")
def _(v):
    return R.rule_distribution(v.mapping, 3)


@query("mine_label_rules", "mapping", """, e AS (SELECT lower(final_class) || CASE WHEN mmsi % 50 = 0 THEN '' ELSE '' END AS label, CASE WHEN mmsi % 12 = 0 THEN 'OTHER' ELSE final_class END AS cls FROM mapping WHERE final_class IS NOT NULL), c AS (SELECT label, cls, count(*) AS n FROM e GROUP BY ALL)
SELECT label, arg_max(cls, n) AS rule_class, round(max(n)/sum(n), 6) AS purity, CAST(sum(n) AS BIGINT) AS support FROM c GROUP BY label HAVING max(n)/sum(n) >= 0.9""")
def _(v):
    m = v.mapping.select("mmsi", F.col("final_class").alias("src"), F.when(F.col("final_class").isNotNull() & (F.col("mmsi") % 12 == 0), "OTHER").otherwise(F.col("final_class")).alias("final_class"))
    return rounded(R.mine_label_rules(m, "src").withColumnRenamed("rule_class", "rule_class"))


@query("apply_rules", "ais mapping", _PURE + """, vs AS (SELECT mmsi, count(*) AS ais_rows, CASE WHEN mmsi % 5 = 0 THEN [CAST(mmsi % 25 AS VARCHAR), '0'] ELSE ['999'] END AS codes, CASE WHEN mmsi % 3 = 0 THEN CAST(100 + mmsi % 4 AS VARCHAR) END AS registry_code, CASE WHEN mmsi % 2 = 0 THEN ' Machinery ' END AS scraped FROM ais GROUP BY mmsi),
 g AS (SELECT * FROM rules WHERE purity >= 0.22 AND support >= 5), k AS (SELECT mmsi, 0 AS prio, code, rule_class, purity, support, 'position_type_code' AS source FROM (SELECT mmsi, unnest(codes) AS code FROM vs) u JOIN g USING (code) WHERE code <> '0'
 UNION ALL SELECT mmsi, 1, code, rule_class, purity, support, 'registry_type_code' FROM vs JOIN g ON g.code = vs.registry_code UNION ALL SELECT mmsi, 2, scraped, 'MACHINERY', 1.0, (SELECT count(*) FROM mapping WHERE final_class = 'MACHINERY'), 'web_label' FROM vs WHERE scraped IS NOT NULL AND EXISTS (SELECT 1 FROM mapping WHERE final_class = 'MACHINERY')),
 b AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY prio, support DESC, code) AS rn FROM k)
SELECT vs.mmsi, ais_rows, rule_class AS final_class, coalesce(source, 'needs_manual') AS source, code AS type_code, round(purity, 6) AS rule_purity, support AS rule_support, CASE WHEN support >= 100 THEN 'high' WHEN support >= 10 THEN 'medium' WHEN support IS NOT NULL THEN 'low' END AS confidence FROM vs LEFT JOIN b ON b.mmsi = vs.mmsi AND rn = 1""")
def _(v):
    k = F.col("mmsi")
    ve = v.ais.groupBy("mmsi").agg(F.count(F.lit(1)).alias("ais_rows")).select(
        "mmsi", "ais_rows", F.when(k % 5 == 0, F.array((k % 25).cast("string"), F.lit("0"))).otherwise(F.array(F.lit("999"))).alias("codes"),
        F.when(k % 3 == 0, (100 + k % 4).cast("string")).alias("registry_code"), F.when(k % 2 == 0, " Machinery ").alias("scraped_label"))
    labels = R.mine_label_rules(v.mapping.withColumn("src", F.col("final_class")), "src")
    return rounded(R.apply_rules(ve, R.mine_rules(v.mapping), labels, 0.22, 5))


@query("mmsi_profile", "ais", """, a AS (SELECT mmsi, type_code, 'N' || (event_id % 5) AS name, CASE WHEN event_id % 3 > 0 THEN event_id % 7 END AS length, event_id % 4 AS beam FROM ais),
 cc AS (SELECT mmsi, '{' || string_agg('"' || type_code || '":' || n, ',' ORDER BY type_code) || '}' AS type_codes FROM (SELECT mmsi, type_code, count(*) AS n FROM a GROUP BY ALL) q GROUP BY mmsi),
 nn AS (SELECT mmsi, string_agg(name, '|' ORDER BY rn) AS names FROM (SELECT mmsi, name, row_number() OVER (PARTITION BY mmsi ORDER BY count(*) DESC, name) AS rn FROM a GROUP BY mmsi, name) q WHERE rn <= 3 GROUP BY mmsi),
 ll AS (SELECT mmsi, length AS length_mode FROM (SELECT mmsi, length, row_number() OVER (PARTITION BY mmsi ORDER BY count(*) DESC, length) AS rn FROM a WHERE length IS NOT NULL GROUP BY mmsi, length) q WHERE rn = 1),
 bb AS (SELECT mmsi, beam AS beam_mode FROM (SELECT mmsi, beam, row_number() OVER (PARTITION BY mmsi ORDER BY count(*) DESC, beam) AS rn FROM a GROUP BY mmsi, beam) q WHERE rn = 1)
SELECT mmsi, ais_rows, type_codes, names, length_mode, beam_mode FROM (SELECT mmsi, count(*) AS ais_rows FROM a GROUP BY mmsi) r LEFT JOIN cc USING (mmsi) LEFT JOIN nn USING (mmsi) LEFT JOIN ll USING (mmsi) LEFT JOIN bb USING (mmsi)""")
def _(v):
    e = F.col("event_id")
    a = v.ais.select("mmsi", "type_code", F.concat(F.lit("N"), (e % 5).cast("string")).alias("name"), F.when(e % 3 > 0, e % 7).alias("length"), (e % 4).alias("beam"))
    return R.mmsi_profile(a)


@query("ais_length", "ais", """SELECT mmsi, arg_min(l, struct_pack(p := product, e := event_id)) AS length, arg_min(w, struct_pack(p := product, e := event_id)) AS beam FROM (SELECT mmsi, product, event_id, CAST(event_id % 3 * 10 AS DOUBLE) + CAST(event_id % 2 * 5 AS DOUBLE) AS l, CAST(event_id % 11 AS DOUBLE) AS w FROM ais) q WHERE l > 0 GROUP BY mmsi""")
def _(v):
    e = F.col("event_id")
    a = v.ais.select("mmsi", "product", "event_id", (e % 3 * 10).cast("double").alias("bow"), (e % 2 * 5).cast("double").alias("stern"), (e % 11).cast("double").alias("w"))
    return R.ais_length(a, "mmsi", ["product", "event_id"], "bow", "stern", "w")


@query("first_positive", "ais", """SELECT mmsi, arg_min(l, event_id) AS length FROM (SELECT mmsi, event_id, CAST(event_id % 4 AS DOUBLE) AS l FROM ais) q WHERE l > 0 GROUP BY mmsi""")
def _(v):
    a = v.ais.select("mmsi", "event_id", (F.col("event_id") % 4).cast("double").alias("l"), F.lit(0.0).alias("b"))
    return R.ais_length(a, "mmsi", ["event_id"], "l", "b", split_dims=False).select("mmsi", "length")


@query("unresolved_queue", "ais mapping", "SELECT mmsi, count(*) AS rows FROM ais WHERE mmsi NOT IN (SELECT mmsi FROM mapping WHERE status = 'fine_class_mapped') GROUP BY mmsi ORDER BY rows DESC, mmsi")
def _(v):
    """Vessels still to look up, most rows first."""
    done = v.mapping.where("status = 'fine_class_mapped'").select("mmsi")
    return v.ais.groupBy("mmsi").agg(F.count(F.lit(1)).alias("rows")).join(done, "mmsi", "left_anti").orderBy(F.desc("rows"), "mmsi")
