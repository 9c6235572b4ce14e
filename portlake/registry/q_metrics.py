"""Metrics over prediction tables and dimension audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .base import query, rounded
from .views import CLASSES, PORTS

_OK1, _OK2 = "CAST(p1 = truth AS INT)", "CAST(p2 = truth AS INT)"


@query("confusion_norm", "preds", "SELECT port, truth, p1 AS pred, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY port, truth), 6) AS share FROM preds GROUP BY port, truth, p1")
def _(v):
    return rounded(M.confusion(v.preds, ["port"], "truth", "p1"))


@query("confusion_column", "preds", "SELECT truth, p1 AS pred, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY p1), 6) AS share FROM preds GROUP BY truth, p1")
def _(v):
    return rounded(M.confusion(v.preds, [], "truth", "p1", "column"))


@query("class_recall", "preds", f"SELECT port, truth AS cls, count(*) AS n, round(avg({_OK1}), 6) AS recall FROM preds GROUP BY ALL HAVING count(*) >= 5")
def _(v):
    return rounded(M.class_recall(v.preds, ["port"], "truth", "p1", 5))


_BA = ", c AS (SELECT {k}, truth, count(*) AS n, sum({ok}) AS ok FROM {t} GROUP BY ALL) SELECT {k}, round(avg(ok/n), 6) AS ba, round(sum(ok)/sum(n), 6) AS accuracy, CAST(sum(n) AS BIGINT) AS n, count(*) AS classes FROM c GROUP BY {k}"


@query("balanced_accuracy", "preds", _BA.format(k="port", ok=_OK1, t="preds"))
def _(v):
    return rounded(M.balanced_accuracy(v.preds, ["port"], "truth", "p1"))


@query("balanced_accuracy_labels", "gold", _BA.format(k="port", ok="CAST(weak = truth AS INT)", t="gold"))
def _(v):
    return rounded(M.balanced_accuracy(v.gold, ["port"], "truth", "weak"))


@query("equal_port_ba", "preds", f", c AS (SELECT port, truth, avg({_OK1}) AS r FROM preds GROUP BY ALL), b AS (SELECT port, avg(r) AS ba FROM c GROUP BY port) SELECT round(avg(ba), 6) AS equal_port_ba, count(*) AS ports FROM b")
def _(v):
    return rounded(M.equal_port_ba(v.preds, "port", "truth", "p1"))


@query("rescue_harm", "preds", "SELECT port, count(*) AS n, count(*) FILTER (p1 <> truth AND p2 = truth) AS rescue, count(*) FILTER (p1 = truth AND p2 <> truth) AS harm, count(*) FILTER (p1 <> truth AND p2 = truth) - count(*) FILTER (p1 = truth AND p2 <> truth) AS net FROM preds GROUP BY port")
def _(v):
    return M.rescue_harm(v.preds, ["port"], "truth", "p1", "p2")


@query("rescue_harm_by_class", "preds", "SELECT truth, count(*) AS n, count(*) FILTER (p1 <> truth AND p2 = truth) AS rescue, count(*) FILTER (p1 = truth AND p2 <> truth) AS harm, count(*) FILTER (p1 <> truth AND p2 = truth) - count(*) FILTER (p1 = truth AND p2 <> truth) AS net FROM preds GROUP BY truth")
def _(v):
    return M.rescue_harm(v.preds, ["truth"], "truth", "p1", "p2")


@query("flip_flows", "preds", "SELECT p1 AS from_cls, p2 AS to_cls, count(*) AS n, count(*) FILTER (p2 = truth) AS rescue, count(*) FILTER (p1 = truth) AS harm FROM preds WHERE p1 <> p2 GROUP BY ALL")
def _(v):
    return M.flips(v.preds, "p1", "p2", "truth")


@query("worst_groups", "preds", f", c AS (SELECT port, truth, avg({_OK1}) AS a, avg({_OK2}) AS b FROM preds GROUP BY ALL), d AS (SELECT port, round(avg(b) - avg(a), 6) AS delta FROM c GROUP BY port) SELECT port, delta + 0.0 AS delta FROM d ORDER BY delta, port LIMIT 3")
def _(v):
    a, b = (M.balanced_accuracy(v.preds, ["port"], "truth", p).select("port", F.col("ba").alias(p)) for p in ("p1", "p2"))
    return rounded(a.join(b, "port").select("port", (F.col("p2") - F.col("p1")).alias("delta"))).orderBy("delta", "port").limit(3)


_PRIOR = """, k AS (SELECT unnest(range(10)) AS cls), pr AS (SELECT port, k.cls, count(*) FILTER (p1 = k.cls)/count(*) AS p, count(*) FILTER (p2 = k.cls)/count(*) AS q FROM preds CROSS JOIN k GROUP BY ALL)"""


@query("prior_tv", "preds", _PRIOR + " SELECT port, round(0.5*sum(abs(p-q)), 6) AS tv, round(sum(CASE WHEN p > 0 THEN p*ln(p/greatest(q, 1e-9)) ELSE 0 END), 6) AS kl, round(sum(CASE WHEN p > 0 THEN -p*ln(p) ELSE 0 END), 6) AS entropy FROM pr GROUP BY port")
def _(v):
    p, q = (M.class_prior(v.preds, ["port"], c, CLASSES) for c in ("p1", "p2"))
    return rounded(M.prior_distance(p, q, ["port"]))


def _auc_sql(k, t, score, pos):
    return f""", a AS (SELECT {k}, {score} AS s, {pos} AS pos FROM {t}), r AS (SELECT {k}, s, pos, rank() OVER (PARTITION BY {k} ORDER BY s) + (count(*) OVER (PARTITION BY {k}, s) - 1)/2.0 AS ar FROM a)
SELECT {k}, count(*) AS n, count(*) FILTER (pos) AS positives, round((sum(ar) FILTER (pos) - count(*) FILTER (pos)*(count(*) FILTER (pos) + 1)/2.0) / (count(*) FILTER (pos)*count(*) FILTER (NOT pos)), 6) AS auc FROM r GROUP BY {k}"""


@query("auc_by_group", "preds", _auc_sql("port", "preds", "round(m1, 1)", "p1 = truth"))
def _(v):
    return rounded(M.auc(v.preds.withColumn("s", F.round("m1", 1)), ["port"], "s", F.col("p1") == F.col("truth")))


@query("auc_labels", "gold", _auc_sql("port", "gold", "size", "truth = 1"))
def _(v):
    return rounded(M.auc(v.gold, ["port"], "size", F.col("truth") == 1))


@query("correlations", "preds", """, a AS (SELECT port, round(m1, 1) AS a, round(m2, 1) AS b FROM preds), r AS (SELECT port, a, b, rank() OVER (PARTITION BY port ORDER BY a) + (count(*) OVER (PARTITION BY port, a) - 1)/2.0 AS ra, rank() OVER (PARTITION BY port ORDER BY b) + (count(*) OVER (PARTITION BY port, b) - 1)/2.0 AS rb FROM a)
SELECT port, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM r GROUP BY port""")
def _(v):
    return rounded(M.correlations(v.preds.select("port", F.round("m1", 1).alias("a"), F.round("m2", 1).alias("b")), ["port"], "a", "b"))


@query("mutual_information", "features dims", """, q AS (SELECT d, quantile_cont(x, [0.0625,0.125,0.1875,0.25,0.3125,0.375,0.4375,0.5,0.5625,0.625,0.6875,0.75,0.8125,0.875,0.9375]) AS e FROM dims GROUP BY d), b AS (SELECT d, y, len(list_filter(e, lambda z: z <= x)) AS b FROM dims JOIN q USING (d)),
 j AS (SELECT d, b, y, count(*) AS n FROM b GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY d, b) AS nb, sum(n) OVER (PARTITION BY d, y) AS nt, sum(n) OVER (PARTITION BY d) AS nd FROM j), mi AS (SELECT d, sum((n/nd)*ln((n/nd)/((nb/nd)*(nt/nd)))) AS mi FROM w GROUP BY d), h AS (SELECT d, sum(-(nt/nd)*ln(nt/nd)) AS h FROM (SELECT DISTINCT d, y, nt, nd FROM w) u GROUP BY d)
SELECT d, round(mi, 6) AS mi, round(mi/h, 6) AS mi_share FROM mi JOIN h USING (d)""")
def _(v):
    return rounded(M.mutual_information(v.dims, "y"))


_ACT = ", act AS (SELECT id, port, product, y, d, CASE WHEN x > 0.05 THEN x ELSE 0 END AS x FROM dims)"
_ENT = _ACT + """, nz AS (SELECT * FROM act WHERE x <> 0), q AS (SELECT d, quantile_cont(x, 0.75) AS q75, count(*) AS n FROM nz GROUP BY d), e1 AS (SELECT d, sum(-(c/t)*ln(c/t))/ln(10) AS h, max(t) AS t FROM (SELECT d, y, count(*) AS c, sum(count(*)) OVER (PARTITION BY d) AS t FROM nz GROUP BY d, y) u GROUP BY d),
 e2 AS (SELECT d, sum(-(c/t)*ln(c/t))/ln(10) AS h, max(t) AS t FROM (SELECT d, y, count(*) AS c, sum(count(*)) OVER (PARTITION BY d) AS t FROM nz JOIN q USING (d) WHERE x >= q75 GROUP BY d, y) u GROUP BY d), hh AS (SELECT q.d, q.n, CASE WHEN e1.t >= 30 THEN e1.h END AS h_present, CASE WHEN e2.t >= 30 AND q.n >= 30 THEN e2.h END AS h_top FROM q JOIN e1 USING (d) JOIN e2 USING (d))"""


def active_dims(v):
    return v.dims.withColumn("x", F.when(F.col("x") > 0.05, F.col("x")).otherwise(0.0))


@query("dim_class_entropy", "features dims", _ENT + " SELECT d, n, round(h_present, 6) AS h_present, round(h_top, 6) AS h_top FROM hh")
def _(v):
    return rounded(M.dim_class_entropy(active_dims(v), "y", CLASSES, 30))


@query("facility_sharing", "features dims", _ENT + " SELECT id, round(avg(h_top), 6) AS share_mean, round(min(h_top), 6) AS share_min, round(max(h_top), 6) AS share_max FROM nz JOIN (SELECT d, h_top FROM hh WHERE h_top IS NOT NULL) h USING (d) GROUP BY id")
def _(v):
    a = active_dims(v)
    return rounded(M.sharing(a, M.dim_class_entropy(a, "y", CLASSES, 30), "id"))


@query("variance_components", "preds", """, g AS (SELECT port, product, CAST(p2 = truth AS INT) - CAST(p1 = truth AS INT) AS g FROM preds), po AS (SELECT port, 100*avg(g) AS g, 10000*var_samp(g)/count(*) AS se2 FROM g GROUP BY port HAVING count(*) >= 10), pr AS (SELECT port, product, 100*avg(g) AS g, 10000*var_samp(g)/count(*) AS se2 FROM g WHERE port IN (SELECT port FROM po) GROUP BY ALL HAVING count(*) >= 5),
 wi AS (SELECT port, var_samp(g) AS v, avg(se2) AS s FROM pr GROUP BY port HAVING count(*) >= 3), a AS (SELECT var_samp(g) AS port_observed, avg(se2) AS port_noise, count(*) AS ports FROM po), b AS (SELECT var_samp(g) AS product_observed, avg(se2) AS product_noise, count(*) AS products FROM pr), c AS (SELECT avg(v) AS within_observed, avg(s) AS within_noise FROM wi)
SELECT round(port_observed, 5) AS port_observed, round(port_noise, 5) AS port_noise, ports, round(product_observed, 5) AS product_observed, round(product_noise, 5) AS product_noise, products, round(within_observed, 5) AS within_observed, round(within_noise, 5) AS within_noise, round(greatest(0, port_observed - port_noise), 5) AS port_real, round(greatest(0, within_observed - within_noise), 5) AS within_real FROM a, b, c""")
def _(v):
    return rounded(M.variance_components(v.preds, "port", "product", "truth", "p1", "p2"), 5)


@query("within_group_percentile", "features dims", "SELECT id, d, round((row_number() OVER (PARTITION BY port, d ORDER BY x, id) - 1) / (count(*) OVER (PARTITION BY port, d) - 1), 6) AS pct FROM dims")
def _(v):
    return rounded(M.within_group_percentile(v.dims, ["port", "d"], "x", "id").select("id", "d", "pct"))


_GS = """, gr AS (SELECT * FROM (VALUES ('liquid', 0), ('liquid', 1), ('liquid', 2), ('dry', 3), ('dry', 4), ('nav', 5), ('nav', 6), ('nav', 7)) t(name, d)), pc AS (SELECT id, d, (row_number() OVER (PARTITION BY port, d ORDER BY x, id) - 1) / (count(*) OVER (PARTITION BY port, d) - 1) AS pct FROM dims),
 sc AS (SELECT id, name, round(avg(pct), 9) AS score FROM pc JOIN gr USING (d) GROUP BY ALL), oc AS (SELECT id, CASE WHEN p1 <> truth AND p2 = truth THEN 1 WHEN p1 = truth AND p2 <> truth THEN -1 ELSE 0 END AS outcome FROM preds), jj AS (SELECT * FROM sc JOIN oc USING (id) WHERE outcome <> 0)"""


def group_inputs(v):
    g = v.spark.createDataFrame([("liquid", 0), ("liquid", 1), ("liquid", 2), ("dry", 3), ("dry", 4), ("nav", 5), ("nav", 6), ("nav", 7)], "name string, d int")
    s = M.group_scores(v.dims, g, "id", "port").withColumn("score", F.round("score", 9))
    t = F.col("truth")
    o = v.preds.select("id", F.when((F.col("p1") != t) & (F.col("p2") == t), 1).when((F.col("p1") == t) & (F.col("p2") != t), -1).otherwise(0).alias("outcome"))
    return s, o


@query("group_score_auc", "preds features dims", _GS + """, r AS (SELECT *, rank() OVER (PARTITION BY name ORDER BY score) + (count(*) OVER (PARTITION BY name, score) - 1)/2.0 AS ar FROM jj), g AS (SELECT name, count(*) AS n, count(*) FILTER (outcome > 0) AS a, count(*) FILTER (outcome < 0) AS b, sum(ar) FILTER (outcome > 0) AS sa, sum(ar) FILTER (outcome < 0) AS sb FROM r GROUP BY name)
SELECT name, n, round((sa - a*(a+1)/2.0)/(a*b), 6) AS auc_rescue, round((sb - b*(b+1)/2.0)/(a*b), 6) AS auc_harm FROM g""")
def _(v):
    s, o = group_inputs(v)
    return rounded(M.group_score_auc(s, o, "id"))


@query("quartile_rates", "preds features dims", _GS + """, q AS (SELECT name, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.75) AS q3 FROM jj GROUP BY name), z AS (SELECT name, outcome, CASE WHEN score <= q1 THEN 'low' WHEN score >= q3 THEN 'high' END AS quartile FROM jj JOIN q USING (name))
SELECT name, quartile, count(*) AS n, round(avg(CAST(outcome > 0 AS INT)), 6) AS rescue_rate, round(avg(CAST(outcome < 0 AS INT)), 6) AS harm_rate FROM z WHERE quartile IS NOT NULL GROUP BY ALL""")
def _(v):
    s, o = group_inputs(v)
    return rounded(M.quartile_rates(s, o, "id"))


@query("ks_distance", "features dims", """, pt AS (SELECT DISTINCT port FROM features), c AS (SELECT p.port, d, x, count(*) FILTER (m.port = p.port) AS i, count(*) AS k FROM dims m CROSS JOIN pt p GROUP BY ALL), w AS (SELECT port, d, sum(i) OVER o AS ci, sum(k) OVER o AS ck, sum(i) OVER (PARTITION BY port, d) AS ti, sum(k) OVER (PARTITION BY port, d) AS tk FROM c WINDOW o AS (PARTITION BY port, d ORDER BY x ROWS UNBOUNDED PRECEDING))
SELECT port, round(avg(ks), 6) AS ks FROM (SELECT port, d, max(abs(ci/ti - (ck-ci)/(tk-ti))) AS ks FROM w GROUP BY port, d) q GROUP BY port""")
def _(v):
    return rounded(M.ks_distance(v.dims, "port", list(range(PORTS))).withColumn("port", F.col("port").cast("long")))


@query("criterion_check", "preds", """, r AS (SELECT port, truth, avg(CAST(p2 = truth AS INT)) - avg(CAST(p1 = truth AS INT)) AS g FROM preds GROUP BY ALL), t AS (SELECT port AS fold, avg(g) AS target FROM r GROUP BY port), e AS (SELECT a.fold, min(round(b.target + 0.01*((a.fold*7 + b.fold*3) % 11), 9)) AS worst, avg(round(b.target + 0.01*((a.fold*7 + b.fold*3) % 11), 9)) AS mean FROM t a JOIN t b ON a.fold <> b.fold GROUP BY a.fold),
 l AS (SELECT 'worst' AS criterion, fold, round(worst, 9) AS value, round(target, 9) AS target FROM e JOIN t USING (fold) UNION ALL SELECT 'mean', fold, round(mean, 9), round(target, 9) FROM e JOIN t USING (fold)), k AS (SELECT *, rank() OVER (PARTITION BY criterion ORDER BY value) + (count(*) OVER (PARTITION BY criterion, value) - 1)/2.0 AS ra, rank() OVER (PARTITION BY criterion ORDER BY target) + (count(*) OVER (PARTITION BY criterion, target) - 1)/2.0 AS rb, quantile_cont(value, 0.5) OVER (PARTITION BY criterion) AS med FROM l)
SELECT criterion, round(corr(value, target), 5) AS pearson, round(corr(ra, rb), 5) AS spearman, count(*) AS n, round(avg(target) FILTER (value > med), 5) AS gain_above, round(avg(target) FILTER (value <= med), 5) AS gain_below FROM k GROUP BY criterion""")
def _(v):
    a, b = (M.balanced_accuracy(v.preds, ["port"], "truth", p).select(F.col("port").alias("fold"), F.col("ba").alias(p)) for p in ("p1", "p2"))
    t = a.join(b, "fold").select("fold", F.round(F.col("p2") - F.col("p1"), 9).alias("gain"))
    q = t.select(F.col("fold").alias("q"), F.col("gain").alias("g"))
    e = t.select("fold").join(q, F.col("fold") != F.col("q")).select("fold", "q", F.round(F.col("g") + 0.01 * ((F.col("fold") * 7 + F.col("q") * 3) % 11), 9).alias("gain"))
    return rounded(M.criterion_check(e, t), 5)


@query("dim_coverage", "features dims", "SELECT d, count(*) AS candidates, count(*) FILTER (x > -0.1) AS valid, count(*) FILTER (x > -0.1 AND y <> 3) AS valid_labelled, count(DISTINCT CASE WHEN x > -0.1 THEN round(x, 6) END) AS distinct_values, count(DISTINCT CASE WHEN x > -0.1 THEN round(x, 6) END) > 1 AS varies FROM dims GROUP BY d")
def _(v):
    d = v.dims.withColumns({"x": F.when(F.col("x") > -0.1, F.col("x")), "y": F.when(F.col("y") != 3, F.col("y"))})
    return M.dim_coverage(d, "y")


@query("dim_support_gate", "features dims", "SELECT d, count(*) AS valid, count(DISTINCT port) AS ports, round(var_pop(x), 8) AS variance FROM dims WHERE x > d/200.0 GROUP BY d HAVING count(*) >= 30 AND count(DISTINCT port) >= 2 AND var_pop(x) >= 1e-4")
def _(v):
    return rounded(M.dim_support_gate(v.dims.withColumn("x", F.when(F.col("x") > F.col("d") / 200.0, F.col("x"))), "port"), 8)


@query("impute_train_mean", "features dims", """, a AS (SELECT id, port, d, CASE WHEN x > -0.15 THEN x END AS x FROM dims), s AS (SELECT f.port AS fold, a.d, avg(a.x) AS mu, stddev_pop(a.x) AS sd FROM a JOIN (SELECT DISTINCT port FROM a) f ON f.port <> a.port GROUP BY ALL)
SELECT id, fold, a.d AS d, round((coalesce(x, mu) - mu)/sd, 6) + 0.0 AS z FROM a JOIN s ON s.fold = a.port AND s.d = a.d""")
def _(v):
    d = v.dims.withColumn("x", F.when(F.col("x") > -0.15, F.col("x")))
    return rounded(M.impute_standardise(d, "port", v.features.select("port").distinct()))
