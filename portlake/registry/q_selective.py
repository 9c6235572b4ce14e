"""Ordered selections and risk-coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selective as S
from .base import query, rounded

_RUN = ", r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY {k}) AS n, avg(CAST(p1 <> truth AS INT)) OVER (PARTITION BY {k} ORDER BY m1 DESC, id ROWS UNBOUNDED PRECEDING) AS risk FROM preds WINDOW w AS (PARTITION BY {k} ORDER BY m1 DESC, id))"


def wrong():
    return F.col("p1") != F.col("truth")


@query("cap_per_group", "preds", "SELECT id, port, truth FROM (SELECT *, row_number() OVER (PARTITION BY port, truth ORDER BY id) AS rn FROM preds) q WHERE rn <= 4")
def _(v):
    return S.cap_per_group(v.preds, ["port", "truth"], [F.col("id")], 4).select("id", "port", "truth")


@query("hash_cap", "", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('s' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) q WHERE rn <= 50")
def _(v):
    return S.hash_cap(v.table("documents").select("doc_id", "source"), ["source"], "doc_id", 50, "s")


@query("conformal_threshold", "preds", _RUN.format(k="port") + " SELECT port, any_value(n) AS n, arg_max(m1, rn) FILTER (risk <= 0.8) AS threshold, coalesce(max(rn) FILTER (risk <= 0.8), 0) AS accepted FROM r GROUP BY port")
def _(v):
    return S.conformal_threshold(v.preds, ["port"], "m1", wrong(), 0.8, "id")


@query("conformal_by_class", "preds", _RUN.format(k="port, p1").replace("r AS", "rc AS") + _RUN.format(k="port") + """, g AS (SELECT port, arg_max(m1, rn) FILTER (risk <= 0.8) AS t FROM r GROUP BY port), c AS (SELECT port, p1, any_value(n) AS n, arg_max(m1, rn) FILTER (risk <= 0.8) AS t FROM rc GROUP BY port, p1)
SELECT c.port, c.p1, c.n, CASE WHEN c.n >= 6 THEN c.t ELSE g.t END AS threshold FROM c JOIN g USING (port)""")
def _(v):
    return S.threshold_by_class(v.preds, ["port"], "p1", "m1", wrong(), 0.8, "id", 6)


@query("conformal_by_true_class", "preds", _RUN.format(k="port, truth").replace("r AS", "rc AS") + _RUN.format(k="port") + """, g AS (SELECT port, arg_max(m1, rn) FILTER (risk <= 0.8) AS t FROM r GROUP BY port), c AS (SELECT port, truth, any_value(n) AS n, arg_max(m1, rn) FILTER (risk <= 0.8) AS t FROM rc GROUP BY port, truth)
SELECT c.port, c.truth, c.n, CASE WHEN c.n >= 6 THEN c.t ELSE g.t END AS threshold FROM c JOIN g USING (port)""")
def _(v):
    return S.threshold_by_class(v.preds, ["port"], "truth", "m1", wrong(), 0.8, "id", 6)


@query("conformal_by_cluster", "preds features", """, k AS (SELECT p.*, list_position(v[1:8], list_max(v[1:8])) AS cluster FROM preds p JOIN (SELECT id, v FROM features) f USING (id)),
 w AS (SELECT *, row_number() OVER a AS rn, count(*) OVER (PARTITION BY port, cluster) AS n, avg(CAST(p1 <> truth AS INT)) OVER a AS risk, row_number() OVER b AS gn, avg(CAST(p1 <> truth AS INT)) OVER b AS grisk FROM k
  WINDOW a AS (PARTITION BY port, cluster ORDER BY m1 DESC, id ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY port ORDER BY m1 DESC, id ROWS UNBOUNDED PRECEDING)),
 g AS (SELECT port, arg_max(m1, gn) FILTER (grisk <= 0.8) AS t FROM w GROUP BY port), c AS (SELECT port, cluster, any_value(n) AS n, arg_max(m1, rn) FILTER (risk <= 0.8) AS t FROM w GROUP BY port, cluster)
SELECT c.port, CAST(c.cluster AS INT) AS cluster, c.n, CASE WHEN c.n >= 6 THEN c.t ELSE g.t END AS threshold FROM c JOIN g USING (port)""")
def _(v):
    """The cluster of a row is the largest of its first eight dimensions here; any cluster column will do."""
    first = F.slice("v", 1, 8)
    k = v.features.select("id", F.array_position(first, F.array_max(first)).cast("int").alias("cluster"))
    return S.threshold_by_class(v.preds.join(k, "id"), ["port"], "cluster", "m1", wrong(), 0.8, "id", 6)


@query("conformal_by_tercile", "preds", """, q AS (SELECT port, quantile_cont(m1, 1/3.0::DOUBLE) AS q1, quantile_cont(m1, 2/3.0::DOUBLE) AS q2 FROM preds GROUP BY port), z AS (SELECT p.*, CASE WHEN m1 <= q1 THEN 0 WHEN m1 <= q2 THEN 1 ELSE 2 END AS tercile FROM preds p JOIN q USING (port)),
 r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY port, tercile) AS n, avg(CAST(p1 <> truth AS INT)) OVER w AS risk FROM z WINDOW w AS (PARTITION BY port, tercile ORDER BY m1 DESC, id ROWS UNBOUNDED PRECEDING))
SELECT port, tercile, any_value(n) AS n, arg_max(m1, rn) FILTER (risk <= 0.8) AS threshold, coalesce(max(rn) FILTER (risk <= 0.8), 0) AS accepted FROM r GROUP BY port, tercile""")
def _(v):
    return S.threshold_by_tercile(v.preds, ["port"], "m1", wrong(), 0.8, "id")


@query("audit_threshold", "preds", _RUN.format(k="port") + """, t AS (SELECT port, arg_max(m1, rn) FILTER (risk <= 0.8) AS th FROM r GROUP BY port), a AS (SELECT p.port, coalesce(p.m2 >= th, false) AS i, CAST(p2 <> truth AS INT) AS w FROM preds p JOIN t USING (port))
SELECT port, round(avg(CAST(i AS INT)), 6) AS coverage, round(avg(CASE WHEN i THEN w END), 6) AS risk, coalesce(avg(CASE WHEN i THEN w END) <= 0.8, false) AS met FROM a GROUP BY port""")
def _(v):
    t = S.conformal_threshold(v.preds, ["port"], "m1", wrong(), 0.8, "id")
    return rounded(S.audit_threshold(v.preds, t, ["port"], "m2", F.col("p2") != F.col("truth"), 0.8))


@query("weighted_conformal", "preds", """, r AS (SELECT port, m1, row_number() OVER w AS rn, sum((1 + id % 3)*CAST(p1 <> truth AS INT)) OVER w / sum(1 + id % 3) OVER w AS risk FROM preds WINDOW w AS (PARTITION BY port ORDER BY m1 DESC, id ROWS UNBOUNDED PRECEDING))
SELECT port, count(*) AS n, arg_max(m1, rn) FILTER (risk <= 0.75) AS threshold, coalesce(max(rn) FILTER (risk <= 0.75), 0) AS accepted FROM r GROUP BY port""")
def _(v):
    return S.conformal_threshold(v.preds, ["port"], "m1", wrong(), 0.75, "id", (1 + F.col("id") % 3).cast("double"))


@query("aurc_by_domain", "preds", _RUN.format(k="port") + " SELECT port, round(avg(risk), 6) AS aurc, any_value(n) AS n FROM r GROUP BY port")
def _(v):
    return rounded(S.aurc(v.preds, ["port"], "m1", wrong(), "id"))


@query("risk_at_coverage", "preds", _RUN.format(k="port") + ", c AS (SELECT unnest([0.1, 0.25, 0.5, 1.0])::DOUBLE AS coverage) SELECT port, coverage, round(risk, 6) AS risk FROM r JOIN c ON rn = greatest(1, CAST(floor(coverage*n) AS BIGINT))")
def _(v):
    return rounded(S.risk_at_coverage(v.preds, ["port"], "m1", wrong(), "id", [0.1, 0.25, 0.5, 1.0]))


_BUD = """, b AS (SELECT *, row_number() OVER (PARTITION BY port ORDER BY {s} DESC, id) AS rs, row_number() OVER (PARTITION BY port ORDER BY sha256('0' || CAST(id AS VARCHAR)), id) AS rh, count(*) OVER (PARTITION BY port) AS n FROM preds), sh AS (SELECT unnest([{shares}])::DOUBLE AS share),
 e AS (SELECT port, truth, share, 'score' AS arm, CASE WHEN rs <= greatest(1, floor(share*n)) THEN p2 ELSE p1 END AS pred FROM b, sh UNION ALL SELECT port, truth, share, 'random', CASE WHEN rh <= greatest(1, floor(share*n)) THEN p2 ELSE p1 END FROM b, sh),
 c AS (SELECT port, share, arm, truth, count(*) AS k, sum(CAST(pred = truth AS INT)) AS ok FROM e GROUP BY ALL), d AS (SELECT port, share, arm, round(avg(ok/k), 6) AS ba, round(sum(ok)/sum(k), 6) AS accuracy FROM c GROUP BY port, share, arm)"""


@query("budget_topk", "preds", _BUD.format(s="m2", shares="0.05, 0.2, 0.5") + " SELECT * FROM d")
def _(v):
    return rounded(S.budget_topk(v.preds, ["port"], "m2", "id", "truth", "p1", "p2", [0.05, 0.2, 0.5]))


@query("budget_headtohead", "preds", _BUD.format(s="m1", shares="0.2") + _BUD.format(s="m2", shares="0.2").replace(", b AS", ", b2 AS").replace("sh AS (", "sh2 AS (").replace(" e AS", " e2 AS").replace(" c AS", " c2 AS").replace(" d AS", " d2 AS").replace("FROM b, sh", "FROM b2, sh2").replace("FROM e ", "FROM e2 ").replace("FROM c ", "FROM c2 ") + " SELECT port, 'm1' AS ranker, arm, ba, accuracy FROM d UNION ALL SELECT port, 'm2', arm, ba, accuracy FROM d2")
def _(v):
    return rounded(S.budget_headtohead(v.preds, ["port"], ["m1", "m2"], "id", "truth", "p1", "p2", 0.2))


@query("known_rate_at_budget", "preds", _BUD.format(s="m1", shares="0.2") + " SELECT port, round(avg(CAST(truth < 6 AS INT)) FILTER (rs <= greatest(1, floor(0.2*n))), 6) AS ranked, round(avg(CAST(truth < 6 AS INT)) FILTER (rh <= greatest(1, floor(0.2*n))), 6) AS random FROM b GROUP BY port")
def _(v):
    return rounded(S.known_rate_at_budget(v.preds, ["port"], "m1", "id", F.col("truth") < 6, 0.2))


@query("loo_bag_consistency", "preds", """, b AS (SELECT *, (id // 8) % 5 AS bag FROM preds) SELECT a.id, round(avg(CAST(c.p1 = a.p1 AS INT)), 6) AS consistency FROM b a LEFT JOIN b c ON c.port = a.port AND c.bag = a.bag AND c.product <> a.product GROUP BY a.id""")
def _(v):
    b = v.preds.withColumn("bag", F.floor(F.col("id") / 8) % 5)
    return rounded(S.loo_bag_consistency(b, ["port", "bag"], "product", "p1", "consistency").select("id", "consistency"))


@query("joint_rank", "preds", """, z AS (SELECT id, port, round((m1 - avg(m1) OVER p)/(stddev_pop(m1) OVER p + 1e-9), 9) AS za, round((m2 - avg(m2) OVER p)/(stddev_pop(m2) OVER p + 1e-9), 9) AS zb, greatest(1, floor(0.2*count(*) OVER p)) AS k FROM preds WINDOW p AS (PARTITION BY port)), s AS (SELECT *, round(za + zb, 9) AS zs FROM z),
 r AS (SELECT *, row_number() OVER (PARTITION BY port ORDER BY za DESC, id) AS ra, row_number() OVER (PARTITION BY port ORDER BY zb DESC, id) AS rb, row_number() OVER (PARTITION BY port ORDER BY zs DESC, id) AS rs FROM s), f AS (SELECT *, row_number() OVER (PARTITION BY port ORDER BY CASE WHEN ra <= k AND rb <= k THEN 0 ELSE 1 END, rs) AS rf FROM r)
SELECT id, port, ra <= k AS by_a, rb <= k AS by_b, rs <= k AS by_sum, rf <= k AS by_and FROM f""")
def _(v):
    return S.joint_rank(v.preds, ["port"], "m1", "m2", "id", 0.2)


@query("rank_sum", "preds", "SELECT id, round((row_number() OVER (PARTITION BY port ORDER BY m1, id) - 1)/(count(*) OVER (PARTITION BY port) - 1) + (row_number() OVER (PARTITION BY port ORDER BY m2, id) - 1)/(count(*) OVER (PARTITION BY port) - 1), 6) AS combo FROM preds")
def _(v):
    return rounded(S.rank_sum(v.preds.select("id", "port", "m1", "m2"), ["port"], "m1", "m2", "id").select("id", "combo"))


@query("stratified_round_robin", "", """WITH s AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY sha256('r' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS turn FROM orders) SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(turn AS INT) AS turn FROM s ORDER BY turn, o_orderstatus, o_orderpriority LIMIT 100""")
def _(v):
    return S.stratified_round_robin(v.table("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"], "o_orderkey", 100, "r")


@query("leave_one_out_tau", "preds", ", s AS (SELECT port, round(avg(m1), 6) AS score FROM preds GROUP BY port) SELECT a.port, a.score, round(greatest(0.05, max(b.score) + 0.02), 6) AS tau FROM s a JOIN s b ON a.port <> b.port GROUP BY a.port, a.score")
def _(v):
    s = v.preds.groupBy("port").agg(F.round(F.avg("m1"), 6).alias("score"))
    return rounded(S.leave_one_out_tau(s, "port", "score", 0.02, 0.05))


@query("source_side_threshold", "preds", "SELECT port, count(*) AS n, round(quantile_cont(m1, 0.05), 8) AS threshold FROM preds WHERE truth < 7 GROUP BY port")
def _(v):
    return rounded(S.source_side_threshold(v.preds.where("truth < 7"), "port", "m1"), 8)


@query("percentile_of_reference", "preds", "SELECT t.id, t.port, round(t.m1, 2) AS dist, round(count(*) FILTER (round(r.m1, 2) < round(t.m1, 2))/count(*), 6) AS percentile FROM (SELECT * FROM preds WHERE product >= 24) t JOIN (SELECT * FROM preds WHERE product < 24) r USING (port) GROUP BY ALL")
def _(v):
    d = v.preds.select("id", "port", "product", F.round("m1", 2).alias("dist"))
    return rounded(S.percentile_of_reference(d.where("product < 24"), d.where("product >= 24"), ["port"], "dist", "id"))
