"""Moment tests over a bank of three heads and two mechanisms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import bank as B
from ..operators.metrics import long_predictions
from .base import query, rounded

_SOFT = "list_transform({a}, lambda z: exp(z - list_max({a})) / list_sum(list_transform({a}, lambda w: exp(w - list_max({a})))))"
_BASE = f""", s3 AS (SELECT *, list_transform(list_zip(s1, s2), lambda t: (t[1] + t[2])/2) AS s3 FROM preds),
 probs AS (SELECT id AS sample, port, 0 AS head, {_SOFT.format(a='s1')} AS p FROM s3 UNION ALL SELECT id, port, 1, {_SOFT.format(a='s2')} FROM s3 UNION ALL SELECT id, port, 2, {_SOFT.format(a='s3')} FROM s3),
 phi AS (SELECT id AS sample, port, id % 2 AS grp, product AS block, d, CASE WHEN (id + d) % 4 <> 0 THEN least(1.0, abs(v[d*5 + 1])*4) END AS phi FROM features, (SELECT unnest(range(3)) AS d) r),
 rel AS (SELECT id AS sample, mech, d, [(((c*7 + d*3 + mech*5 + id % 5) % 10) + 0.5)/10 FOR c IN [0,1,2,3,4,5,6,7,8,9]] AS q FROM features, (SELECT unnest(range(3)) AS d) r, (SELECT unnest(range(2)) AS mech) m),
 obs AS (SELECT port, grp, d, avg(phi) AS observed, count(phi) AS n, count(DISTINCT CASE WHEN phi IS NOT NULL THEN block END) AS blocks, avg(CASE WHEN phi IS NOT NULL THEN CAST(abs(phi) < 1e-9 AS INT) END) AS zero_share FROM phi GROUP BY ALL),
 ob AS (SELECT *, CASE WHEN n < 23 THEN 'too_few_available_objects' WHEN blocks < 3 THEN 'too_few_spatial_blocks' ELSE 'active' END AS reason FROM obs),
 pm AS (SELECT f.port, f.grp, f.d, head, mech, avg(list_sum(list_transform(list_zip(p, q), lambda t: t[1]*t[2]))) AS predicted FROM phi f JOIN rel r ON r.sample = f.sample AND r.d = f.d JOIN probs b ON b.sample = f.sample WHERE phi IS NOT NULL GROUP BY ALL),
 mo AS (SELECT pm.*, observed, n, blocks, zero_share, reason FROM pm JOIN ob USING (port, grp, d))"""
_FILT = _BASE + """, wo AS (SELECT port, head, mech, max(CASE WHEN reason = 'active' THEN abs(predicted - observed) END) AS w FROM mo GROUP BY ALL), sc AS (SELECT port, head, min(w) AS score FROM wo GROUP BY ALL), fe AS (SELECT *, coalesce(score <= 0.275 + 1e-12, false) AS feasible FROM sc),
 fb AS (SELECT port, head, score, feasible, CASE WHEN NOT bool_or(score IS NOT NULL) OVER (PARTITION BY port) THEN 'no_active_knowledge' WHEN bool_or(feasible) OVER (PARTITION BY port) THEN 'compatible' ELSE 'mechanism_conflict' END AS status, feasible OR NOT bool_or(feasible) OVER (PARTITION BY port) AS retained FROM fe)"""
TAU, CELL, BLOCKS = 0.275, 23, 3


def bank(v):
    p = v.preds
    s3 = F.zip_with("s1", "s2", lambda a, b: (a + b) / 2)
    heads = F.explode(F.array(*[F.struct(F.lit(i).alias("head"), S.softmax(c).alias("p")) for i, c in enumerate((F.col("s1"), F.col("s2"), s3))]))
    probs = p.select(F.col("id").alias("sample"), "port", heads.alias("h")).select("sample", "port", "h.head", "h.p")
    f = v.features.select(F.col("id").alias("sample"), "port", (F.col("id") % 2).alias("grp"), F.col("product").alias("block"), "v", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("d"))
    phi = f.select("sample", "port", "grp", "block", "d", F.when((F.col("sample") + F.col("d")) % 4 != 0, F.least(F.lit(1.0), F.abs(F.element_at("v", F.col("d") * 5 + 1)) * 4)).alias("phi"))
    rel = f.select("sample", "d", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("mech")).withColumn(
        "q", F.array(*[((F.lit(c * 7) + F.col("d") * 3 + F.col("mech") * 5 + F.col("sample") % 5) % 10 + 0.5) / 10 for c in range(10)]))
    return phi, probs, rel


def bank_moments(v):
    phi, probs, rel = bank(v)
    return B.moments(phi, probs.drop("port"), rel, ["port"], min_cell=CELL, min_blocks=BLOCKS)


@query("bank_moments", "preds features", _BASE + " SELECT port, grp, d, head, mech, round(predicted, 6) AS predicted, round(observed, 6) AS observed, n, blocks, reason FROM mo")
def _(v):
    return rounded(bank_moments(v).select("port", "grp", "d", "head", "mech", "predicted", "observed", "n", "blocks", "reason"))


@query("filter_bank", "preds features", _FILT + " SELECT port, head, round(score, 6) AS score, feasible, status, retained FROM fb")
def _(v):
    return rounded(B.filter_bank(bank_moments(v), ["port"], TAU).drop("mechanism"))


@query("calibrate_tau", "preds features", _FILT + " SELECT count(score) AS n_ports, round(CASE WHEN count(score) >= 4 THEN greatest(0.05, max(score) + 0.02) END, 6) AS tau, CASE WHEN count(score) < 4 THEN 'calibration_unavailable' WHEN greatest(0.05, max(score) + 0.02) >= 0.5 THEN 'uninformative' ELSE 'ready' END AS status FROM sc WHERE head = 2")
def _(v):
    return rounded(B.calibrate_tau(bank_moments(v), "port", 2))


@query("ensemble_predict", "preds features", _FILT + """, k AS (SELECT p.sample, p.head, p.p FROM probs p JOIN fb ON fb.port = p.port AND fb.head = p.head AND retained), u AS (SELECT sample, count(DISTINCT list_position(p, list_max(p))) = 1 AS unanimous FROM k GROUP BY sample), e AS (SELECT sample, c AS cls, avg(p[c + 1]) AS m, min(p[c + 1]) AS lo, max(p[c + 1]) AS hi FROM k, (SELECT unnest(range(10)) AS c) r GROUP BY ALL)
SELECT sample, CAST(cls AS INT) AS cls, round(m, 6) AS mean, round(lo, 6) AS lower, round(hi, 6) AS upper, unanimous FROM e JOIN u USING (sample)""")
def _(v):
    _, probs, _ = bank(v)
    keep = B.filter_bank(bank_moments(v), ["port"], TAU).where("retained")
    return rounded(B.ensemble_predict(probs, keep, ["port"]))


_POOL = """, obs0 AS (SELECT port, d, avg(phi) AS observed, count(phi) AS n, count(DISTINCT CASE WHEN phi IS NOT NULL THEN block END) AS blocks FROM phi GROUP BY ALL),
 pm0 AS (SELECT f.port, f.d, head, mech, avg(list_sum(list_transform(list_zip(p, q), lambda t: t[1]*t[2]))) AS predicted FROM phi f JOIN rel r ON r.sample = f.sample AND r.d = f.d JOIN probs b ON b.sample = f.sample WHERE phi IS NOT NULL GROUP BY ALL),
 res AS (SELECT 'full' AS variant, port, head, mech, CASE WHEN reason = 'active' THEN abs(predicted - observed) END AS r FROM mo
  UNION ALL SELECT CASE WHEN d = 2 THEN 'group_only' ELSE 'static' END, port, head, mech, CASE WHEN reason = 'active' THEN abs(predicted - observed) END FROM mo
  UNION ALL SELECT 'pooled', port, head, mech, CASE WHEN n >= 23 AND blocks >= 3 THEN abs(predicted - observed) END FROM pm0 JOIN obs0 USING (port, d)),
 arm AS (SELECT variant, port, head, min(w) AS score FROM (SELECT variant, port, head, mech, max(r) AS w FROM res GROUP BY ALL) q GROUP BY ALL)"""


@query("variant_filters", "preds features", _FILT + _POOL + """, sb AS (SELECT port, head, score FROM (SELECT *, row_number() OVER (PARTITION BY port ORDER BY score, head) AS rn FROM sc WHERE score IS NOT NULL) q WHERE rn = 1)
SELECT variant, port, head, round(score, 6) AS score, coalesce(score <= 0.275 + 1e-12, false) AS feasible FROM arm UNION ALL SELECT 'single_best', port, head, round(score, 6), true FROM sb""")
def _(v):
    """Dimension 2 is the group dimension here; `pooled` puts all rows of a port into one group."""
    m = bank_moments(v)
    phi, probs, rel = bank(v)
    one = B.moments(phi.withColumn("grp", F.lit(0)), probs.drop("port"), rel, ["port"], min_cell=CELL, min_blocks=BLOCKS)
    d = F.col("d")
    parts = {
        "static": B.dimension_filter(m, ["port"], TAU, d != 2), "group_only": B.dimension_filter(m, ["port"], TAU, d == 2), "full": B.filter_bank(m, ["port"], TAU),
        "pooled": B.filter_bank(one, ["port"], TAU), "single_best": B.single_best(m, ["port"]).withColumn("feasible", F.lit(True))}
    out = None
    for n, part in parts.items():
        part = part.select(F.lit(n).alias("variant"), "port", "head", "score", "feasible")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query("group_mechanisms", "preds features", _FILT + """, w AS (SELECT port, grp, mech, coalesce(max(CASE WHEN reason = 'active' THEN abs(predicted - observed) END), 1e9) AS s FROM mo GROUP BY ALL)
SELECT port, grp, mech AS mechanism, round(CASE WHEN s < 1e9 THEN s END, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY port, grp ORDER BY s, mech) AS rn FROM w) q WHERE rn = 1""")
def _(v):
    return rounded(B.group_mechanisms(bank_moments(v), ["port"]))


@query("moment_cell_report", "preds features", _BASE + """, h AS (SELECT port, grp, d, max(r) AS spread_head FROM (SELECT port, grp, d, head, max(predicted) - min(predicted) AS r FROM mo GROUP BY ALL) q GROUP BY ALL), k AS (SELECT port, grp, d, max(r) AS spread_mech FROM (SELECT port, grp, d, mech, max(predicted) - min(predicted) AS r FROM mo GROUP BY ALL) q GROUP BY ALL)
SELECT port, grp, d, round(any_value(observed), 6) AS observed, any_value(n) AS n, any_value(reason) AS reason, round(any_value(zero_share), 6) AS zero_share, round(min(predicted), 6) AS predicted_min, round(max(predicted), 6) AS predicted_max, round(avg(predicted), 6) AS predicted_mean, round(max(abs(predicted - observed)), 6) AS worst_residual, round(any_value(spread_head), 6) AS spread_head, round(any_value(spread_mech), 6) AS spread_mech FROM mo JOIN h USING (port, grp, d) JOIN k USING (port, grp, d) GROUP BY port, grp, d""")
def _(v):
    return rounded(B.cell_report(bank_moments(v), ["port"]))


@query("head_disagreement", "preds features", _BASE + ", a AS (SELECT sample, head, list_position(p, list_max(p)) AS c FROM probs) SELECT a.head AS h1, b.head AS h2, round(avg(CAST(a.c <> b.c AS INT)), 6) AS disagreement FROM a JOIN a b ON a.sample = b.sample AND a.head < b.head GROUP BY ALL")
def _(v):
    return rounded(B.head_disagreement(bank(v)[1]))


_SUB = """, hs AS (SELECT id, truth, list_transform(list_zip(s1, s2), lambda t: round(t[1]*2 - t[2], 6)) AS s3, s1, s2 FROM preds), mk AS (SELECT unnest(range(1, 8)) AS mask),
 sp AS (SELECT id, truth, mask, mask % 2 + (mask // 2) % 2 + mask // 4 AS size, [round((CASE WHEN mask % 2 = 1 THEN s1[c] ELSE 0 END + CASE WHEN (mask // 2) % 2 = 1 THEN s2[c] ELSE 0 END + CASE WHEN mask >= 4 THEN s3[c] ELSE 0 END) / (mask % 2 + (mask // 2) % 2 + mask // 4), 9) FOR c IN [1,2,3,4,5,6,7,8,9,10]] AS m FROM hs, mk),
 pr AS (SELECT id, truth, mask, size, list_position(m, list_max(m)) - 1 = truth AS ok FROM sp), bs AS (SELECT id, ok AS base FROM pr WHERE mask = 7)"""


def subsets(v):
    s3 = F.zip_with("s1", "s2", lambda a, b: F.round(a * 2 - b, 6))
    return v.preds.select("id", "truth", F.array("s1", "s2", s3).alias("ps"))


@query("subset_oracle", "preds", _SUB + """, c AS (SELECT mask, size, truth, count(*) AS n, count(*) FILTER (ok) AS k, count(*) FILTER (ok AND NOT base) AS r, count(*) FILTER (NOT ok AND base) AS h FROM pr JOIN bs USING (id) GROUP BY ALL)
SELECT CAST(mask AS INT) AS mask, CAST(size AS INT) AS size, round(sum(k)/sum(n), 6) AS accuracy, round(avg(k/n), 6) AS ba, CAST(sum(r) AS BIGINT) AS rescue, CAST(sum(h) AS BIGINT) AS harm, false AS deployable, mask = 7 AS is_full FROM c GROUP BY mask, size""")
def _(v):
    return rounded(B.subset_oracle(subsets(v), 3, "id", "truth"))


@query("oracle_summary", "preds", _SUB + """, c AS (SELECT mask, truth, count(*) AS n, count(*) FILTER (ok) AS k, count(*) FILTER (ok AND NOT base) AS r, count(*) FILTER (NOT ok AND base) AS h FROM pr JOIN bs USING (id) GROUP BY ALL), g AS (SELECT CAST(mask AS INT) AS mask, round(sum(k)/sum(n), 9) AS a, round(avg(k/n), 9) AS b, sum(r) AS r, sum(h) AS h FROM c GROUP BY mask)
SELECT (SELECT mask FROM g ORDER BY a DESC, mask <> 7, mask LIMIT 1) AS best_accuracy_mask, round(max(a), 6) AS best_accuracy, (SELECT mask FROM g ORDER BY b DESC, mask <> 7, mask LIMIT 1) AS best_ba_mask, round(max(b), 6) AS best_ba, CAST(max(r) FILTER (h = 0) AS BIGINT) AS rescue_without_harm, count(*) AS subsets FROM g""")
def _(v):
    s = rounded(B.subset_oracle(subsets(v), 3, "id", "truth"), 9)
    return rounded(B.oracle_summary(s))


@query("union_ceiling", "preds", _SUB + ", g AS (SELECT id, bool_or(ok) AS a, bool_or(ok AND size = 1) AS h, bool_or(ok AND mask = 7) AS f FROM pr GROUP BY id) SELECT round(avg(CAST(a AS INT)), 6) AS any_subset, round(avg(CAST(h AS INT)), 6) AS any_head, round(avg(CAST(f AS INT)), 6) AS full, count(*) FILTER (NOT f AND NOT a) AS beyond_reach FROM g")
def _(v):
    return rounded(B.union_ceiling(subsets(v), 3, "id", "truth"))


@query("role_selection", "preds", ", l AS (SELECT port, truth, 'h1' AS arm, p1 AS p FROM preds UNION ALL SELECT port, truth, 'h2', p2 FROM preds), c AS (SELECT port, arm, truth, avg(CAST(p = truth AS INT)) AS r FROM l GROUP BY ALL), b AS (SELECT port, arm, avg(r) AS ba FROM c GROUP BY ALL), g AS (SELECT arm, round(avg(ba), 12) AS ba FROM b GROUP BY arm) SELECT arm, round(ba, 6) AS ba FROM g ORDER BY ba DESC, arm LIMIT 1")
def _(v):
    return rounded(B.best_fixed_head(long_predictions(v.preds, {"h1": "p1", "h2": "p2"}, ["port", "truth"]), "port", "truth"))
