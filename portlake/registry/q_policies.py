"""Decision rules, control arms, selection rules and paired statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import metrics as M
from ..operators import policies as P
from .base import query, rounded
from .q_gates import port_gain
from .views import CLASSES

_TEN = "[1,2,3,4,5,6,7,8,9,10]"
_SMX = "list_transform({a}, lambda z: exp(z - list_max({a})) / list_sum(list_transform({a}, lambda w: exp(w - list_max({a})))))"


def long(df, col, name="x"):
    return df.select("id", F.posexplode(col).alias("cls", name))


@query("balanced_weights", "preds", ", c AS (SELECT port, truth, count(*) AS n, count(*) OVER (PARTITION BY port) AS k FROM preds GROUP BY port, truth) SELECT id, round(1.0/((SELECT count(DISTINCT port) FROM preds)*k*n), 10) AS weight FROM preds JOIN c USING (port, truth)")
def _(v):
    return rounded(P.balanced_weights(v.preds, "port", "truth").select("id", "weight"), 10)


@query("direction_operator", "preds", f""", q AS (SELECT id, p1 + 1 AS a, {_SMX.format(a='s1')} AS p, s2 AS g FROM preds), u AS (SELECT *, [CASE WHEN c = a THEN 0.0 ELSE greatest(g[c], 0.0) END FOR c IN {_TEN}] AS u FROM q), r AS (SELECT *, [CASE WHEN u[c] >= list_sort(u, 'DESC')[3] THEN u[c]*0.5 ELSE 0.0 END FOR c IN {_TEN}] AS r FROM u),
 f AS (SELECT *, [p[a]*r[c]/(1 + list_sum(r)) FOR c IN {_TEN}] AS f FROM r) SELECT id, CAST(c - 1 AS INT) AS cls, round(greatest(0, p[c] + f[c] - CASE WHEN c = a THEN list_sum(f) ELSE 0 END), 6) AS x FROM f, (SELECT unnest({_TEN}) AS c) k""")
def _(v):
    d = v.preds.withColumn("p", S.softmax(F.col("s1")))
    return rounded(long(d.select("id", P.direction_operator(F.col("p"), F.col("s2"), 0.5).alias("o")), "o"))


@query("coupling_law", "preds", f"SELECT id, CAST(c - 1 AS INT) AS cls, round(s1[c] + (1 - least(1.0, m1))*0.7*s2[c], 6) + 0.0 AS x FROM preds, (SELECT unnest({_TEN}) AS c) k")
def _(v):
    o = P.coupling_law(F.col("s1"), F.col("s2"), F.least(F.lit(1.0), F.col("m1")), 0.7)
    return rounded(long(v.preds.select("id", o.alias("o")), "o"))


@query("knowledge_penalty", "preds features", f""", q AS (SELECT id, v, {_SMX.format(a='s1')} AS p FROM preds JOIN features USING (id)) SELECT id, CAST(c - 1 AS INT) AS cls, round(ln(greatest(p[c], 1e-12)) - 0.3*((((c*7 % 10)/10.0 - abs(v[1]))/0.1)**2 + (((c*3 % 10)/10.0 - abs(v[2]))/0.2)**2 + (((c*9 % 10)/10.0 - abs(v[3]))/0.4)**2)/3, 5) AS x FROM q, (SELECT unnest({_TEN}) AS c) k""")
def _(v):
    d = v.preds.join(v.features.select("id", "v"), "id")
    exp = F.array(*[F.array(*[F.lit((c * k % 10) / 10.0) for k in (7, 3, 9)]) for c in range(1, 11)])
    obs = F.array(*[F.abs(F.element_at("v", i)) for i in (1, 2, 3)])
    sig = F.array(*[F.lit(s) for s in (0.1, 0.2, 0.4)])
    return rounded(long(d.select("id", P.knowledge_penalty(S.softmax(F.col("s1")), exp, obs, sig, 0.3).alias("o")), "o"), 5)


_PRI = ", k AS (SELECT unnest(range(10)) AS cls), pa AS (SELECT port, list(pr ORDER BY cls) AS a FROM (SELECT f.port, k.cls, count(*) FILTER (p.truth = k.cls)/count(*) AS pr FROM preds p JOIN (SELECT DISTINCT port FROM preds) f ON f.port <> p.port CROSS JOIN k GROUP BY ALL) q GROUP BY port)"


def source_prior(v):
    from ..operators.shift import prior_array

    return prior_array(M.others_prior(v.preds, "port", "truth", CLASSES), "port", "a", CLASSES)


@query("prior_offset", "preds", _PRI + f" SELECT id, CAST(c - 1 AS INT) AS cls, round(s1[c] + ln(greatest(a[c], 1e-9)), 6) AS x FROM preds JOIN pa USING (port), (SELECT unnest({_TEN}) AS c) z")
def _(v):
    d = v.preds.join(F.broadcast(source_prior(v)), "port")
    return rounded(long(d.select("id", P.prior_offset(F.col("s1"), F.col("a")).alias("o")), "o"))


@query("support_mask", "preds", _PRI + f", q AS (SELECT id, a, {_SMX.format(a='s1')} AS p FROM preds JOIN pa USING (port)), m AS (SELECT id, [CASE WHEN a[c] >= 0.1 THEN p[c] ELSE 0 END FOR c IN {_TEN}] AS m, p FROM q) SELECT id, CAST(c - 1 AS INT) AS cls, round(CASE WHEN list_sum(m) > 1e-12 THEN m[c]/list_sum(m) ELSE p[c] END, 6) AS x FROM m, (SELECT unnest({_TEN}) AS c) z")
def _(v):
    d = v.preds.join(F.broadcast(source_prior(v)), "port").withColumn("p", S.softmax(F.col("s1")))
    return rounded(long(d.select("id", P.support_mask(F.col("p"), F.col("a"), 0.1).alias("o")), "o"))


_ARMS = """, rk AS (SELECT *, row_number() OVER (ORDER BY id) AS gi, row_number() OVER (ORDER BY sha256('g' || CAST(id AS VARCHAR)), id) AS gj, row_number() OVER (PARTITION BY port ORDER BY id) AS wi, row_number() OVER (PARTITION BY port ORDER BY sha256('w' || CAST(id AS VARCHAR)), id) AS wj FROM preds)"""


@query("control_arms", "preds", _ARMS + """ SELECT a.id, g.p2 AS row_shuffle, w.p2 AS within_shuffle, CAST(a.s2[3] AS DOUBLE) AS column_first FROM rk a JOIN rk g ON a.gi = g.gj JOIN rk w ON w.port = a.port AND a.wi = w.wj""")
def _(v):
    p = v.preds.select("id", "port", "p2", "s2")
    a = P.permuted(p, [], "id", "p2", "g").select("id", F.col("p2").alias("row_shuffle"))
    b = P.permuted(p, ["port"], "id", "p2", "w").select("id", F.col("p2").alias("within_shuffle"))
    c = p.select("id", P.column_permutation(F.col("s2"), [2, 0, 1, 3, 4, 5, 6, 7, 8, 9])[0].alias("column_first"))
    return a.join(b, "id").join(c, "id")


@query("port_mean_replace", "preds", f", m AS (SELECT port, c, avg(s2[c]) AS m FROM preds, (SELECT unnest({_TEN}) AS c) k GROUP BY ALL) SELECT id, CAST(c - 1 AS INT) AS cls, round(m, 7) + 0.0 AS x FROM preds JOIN m USING (port)")
def _(v):
    return rounded(long(P.port_mean_arrays(v.preds, "port", "s2", "o"), "o"), 7)


_PAIR = """, r AS (SELECT least(truth, o) AS a, greatest(truth, o) AS b, truth < o AS f, round(s1[least(truth, o) + 1] - s1[greatest(truth, o) + 1], 9) AS s FROM preds, (SELECT CAST(unnest(range(10)) AS INT) AS o) k WHERE o <> truth), ar AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY s) + (count(*) OVER (PARTITION BY a, b, s) - 1)/2.0 AS ar FROM r),
 pa AS (SELECT a, b, count(*) AS n, (sum(ar) FILTER (f) - count(*) FILTER (f)*(count(*) FILTER (f) + 1)/2.0)/(count(*) FILTER (f)*count(*) FILTER (NOT f)) AS auc FROM ar GROUP BY a, b)"""


@query("pair_auc", "preds", _PAIR + " SELECT a, b, n, round(auc, 6) AS auc FROM pa")
def _(v):
    return rounded(P.pair_auc(v.preds, "s1", "truth", CLASSES))


_BLK = _PAIR + """, ed AS (SELECT a AS i, b AS j FROM pa WHERE round(auc, 9) < 0.47 UNION SELECT b, a FROM pa WHERE round(auc, 9) < 0.47 UNION SELECT CAST(unnest(range(10)) AS INT) AS i, CAST(unnest(range(10)) AS INT)), reach AS (SELECT i, j FROM ed UNION SELECT r.i, e.j FROM reach r JOIN ed e ON r.j = e.i), bl AS (SELECT i AS cls, min(j) AS block FROM reach GROUP BY i)"""


def class_blocks(v):
    pairs = rounded(P.pair_auc(v.preds, "s1", "truth", CLASSES), 9)
    classes = v.spark.range(CLASSES).select(F.col("id").cast("int").alias("cls"))
    return P.class_blocks(pairs, classes, 0.47)


@query("class_blocks", "preds", _BLK + " SELECT cls, block FROM bl")
def _(v):
    return class_blocks(v)


@query("block_accuracy", "preds", _BLK + """, rb AS (SELECT x.cls, y.block FROM (SELECT cls, row_number() OVER (ORDER BY sha256('b' || CAST(cls AS VARCHAR)), cls) AS k FROM bl) x JOIN (SELECT block, row_number() OVER (ORDER BY cls) AS k FROM bl) y USING (k)),
 c AS (SELECT 'blocks' AS arm, port, t.block AS tb, avg(CAST(t.block = q.block AS INT)) AS r FROM preds p JOIN bl t ON t.cls = p.truth JOIN bl q ON q.cls = p.p1 GROUP BY ALL UNION ALL SELECT 'random', port, t.block, avg(CAST(t.block = q.block AS INT)) FROM preds p JOIN rb t ON t.cls = p.truth JOIN rb q ON q.cls = p.p1 GROUP BY ALL) SELECT arm, port, round(avg(r), 6) AS ba FROM c GROUP BY arm, port""")
def _(v):
    b = class_blocks(v)
    a = P.block_accuracy(v.preds, b, ["port"], "truth", "p1").select(F.lit("blocks").alias("arm"), "port", "ba")
    r = P.block_accuracy(v.preds, P.random_blocks(b, "b"), ["port"], "truth", "p1").select(F.lit("random").alias("arm"), "port", "ba")
    return rounded(a.unionByName(r))


_EPS = """, e AS (SELECT port, product, round(avg(m1), 6) AS stat, round(avg(CAST(p2 = truth AS INT)) - avg(CAST(p1 = truth AS INT)), 9) AS gain FROM preds GROUP BY ALL)"""
_RULE = _EPS + """, f AS (SELECT d.port AS fold, e.stat, e.gain FROM e JOIN (SELECT DISTINCT port FROM e) d ON d.port <> e.port), c AS (SELECT DISTINCT fold, stat AS t FROM f), g AS (SELECT c.fold, dir AS direction, t, count(*) FILTER (dir*f.stat >= dir*t) AS k, count(*) AS n, round(coalesce(sum(gain) FILTER (dir*f.stat >= dir*t), 0)/count(*), 9) AS value FROM c JOIN f ON f.fold = c.fold, (SELECT unnest([1, -1]) AS dir) d GROUP BY ALL),
 ru AS (SELECT fold, value AS train_gain, direction, t AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY value DESC, direction DESC, t) AS rn FROM g WHERE k < n) q WHERE rn = 1)"""


def rule_episodes(v):
    ok = lambda p: F.avg((F.col(p) == F.col("truth")).cast("int"))
    return v.preds.groupBy("port", "product").agg(F.round(F.avg("m1"), 6).alias("stat"), F.round(ok("p2") - ok("p1"), 9).alias("gain"))


@query("select_threshold_rule", "preds", _RULE + " SELECT fold, round(train_gain, 6) AS train_gain, direction, threshold FROM ru")
def _(v):
    return rounded(P.select_threshold_rule(rule_episodes(v), "port", "stat", "gain"))


@query("rule_regret", "preds", _RULE + " SELECT port, count(*) AS episodes, CAST(sum(CAST(direction*stat >= direction*threshold AS INT)) AS BIGINT) AS used, round(avg(CASE WHEN direction*stat >= direction*threshold THEN gain ELSE 0 END), 6) + 0.0 AS gain, round(avg(greatest(gain, 0) - CASE WHEN direction*stat >= direction*threshold THEN gain ELSE 0 END), 6) + 0.0 AS regret FROM e JOIN ru ON ru.fold = e.port GROUP BY port")
def _(v):
    e = rule_episodes(v)
    return rounded(P.rule_regret(e, P.select_threshold_rule(e, "port", "stat", "gain"), "port", "stat", "gain"))


@query("deployability_stats", "preds", """, b AS (SELECT *, row_number() OVER (PARTITION BY port ORDER BY m1 DESC, id) AS rs, row_number() OVER (PARTITION BY port ORDER BY sha256('0' || CAST(id AS VARCHAR)), id) AS rh, count(*) OVER (PARTITION BY port) AS n, avg(CAST(p1 <> truth AS INT)) OVER (PARTITION BY port ORDER BY m1 DESC, id ROWS UNBOUNDED PRECEDING) AS risk FROM preds),
 c AS (SELECT port, truth, avg(CAST(CASE WHEN rs <= floor(0.2*n) THEN p2 ELSE p1 END = truth AS INT)) AS a, avg(CAST(CASE WHEN rh <= floor(0.2*n) THEN p2 ELSE p1 END = truth AS INT)) AS r FROM b GROUP BY ALL), d AS (SELECT port, avg(a) - avg(r) AS payoff FROM c GROUP BY port), m AS (SELECT port, avg(m1) AS mu FROM preds GROUP BY port)
SELECT b.port, any_value(n) AS n, round(any_value(payoff), 6) + 0.0 AS payoff, round(1 - avg(risk), 6) AS rank_quality, round(stddev_pop(m1), 6) AS sd, round((sum(pow(m1 - mu, 3))/count(*))/pow(sum(pow(m1 - mu, 2))/count(*), 1.5), 5) AS skew, round(quantile_cont(m1, 0.75) - quantile_cont(m1, 0.25), 6) AS iqr, round(quantile_cont(m1, 0.9) - quantile_cont(m1, 0.1), 6) AS q90q10 FROM b JOIN d USING (port) JOIN m USING (port) GROUP BY b.port""")
def _(v):
    d = P.deployability(v.preds, "port", "id", "m1", "truth", "p1", "p2")
    return rounded(d).withColumn("skew", F.round("skew", 5))


@query("rank_invariance", "preds", ", p AS (SELECT DISTINCT port FROM preds) SELECT port, CAST(0 AS BIGINT) AS changed, exponent FROM p, (SELECT unnest([0.3, 2.0, 7.0])::DOUBLE AS exponent) e")
def _(v):
    d = v.preds.withColumn("s", F.col("m1") + 1.0)
    return P.rank_invariance(d, "port", "id", "s", 0.2, [0.3, 2.0, 7.0])


@query("destroyed_conditional", "preds", """, a AS (SELECT *, row_number() OVER (PARTITION BY port, truth ORDER BY id) AS i, row_number() OVER (PARTITION BY port, truth ORDER BY sha256('c' || CAST(id AS VARCHAR)), id) AS j, row_number() OVER (PARTITION BY port ORDER BY id) AS k, row_number() OVER (PARTITION BY port ORDER BY sha256('a' || CAST(id AS VARCHAR)), id) AS l FROM preds),
 w AS (SELECT a.port, a.truth, avg(CAST(b.p1 = a.truth AS INT)) AS r, avg(CAST(c.p1 = a.truth AS INT)) AS s FROM a JOIN a b ON a.port = b.port AND a.truth = b.truth AND a.i = b.j JOIN a c ON a.port = c.port AND a.k = c.l GROUP BY ALL) SELECT port, round(avg(r), 6) AS within_ba, round(avg(s), 6) AS across_ba FROM w GROUP BY port""")
def _(v):
    p = v.preds.select("id", "port", "truth", "p1")
    w = M.balanced_accuracy(P.permuted(p, ["port", "truth"], "id", "p1", "c"), ["port"], "truth", "p1").select("port", F.col("ba").alias("within_ba"))
    a = M.balanced_accuracy(P.permuted(p, ["port"], "id", "p1", "a"), ["port"], "truth", "p1").select("port", F.col("ba").alias("across_ba"))
    return rounded(w.join(a, "port"))


_GAIN = ", gn AS (SELECT port AS fold, round(avg(r2) - avg(r1), 9) AS gain FROM (SELECT port, truth, avg(CAST(p2 = truth AS INT)) AS r2, avg(CAST(p1 = truth AS INT)) AS r1 FROM preds GROUP BY ALL) q GROUP BY port)"


def gains(v):
    return port_gain(v).withColumn("gain", F.round("gain", 9))


@query("bootstrap_ci", "preds", _GAIN + """, u AS (SELECT gain, row_number() OVER (ORDER BY fold) AS rn, count(*) OVER () AS n FROM gn), dr AS (SELECT rep, (CAST('0x' || substr(md5('s:' || rep || ':' || rn), 1, 8) AS BIGINT) % n) + 1 AS pick FROM u, (SELECT unnest(range(1, 201)) AS rep) r), m AS (SELECT rep, avg(gain) AS m FROM dr JOIN u ON u.rn = dr.pick GROUP BY rep)
SELECT (SELECT round(avg(gain), 6) FROM gn) AS mean, (SELECT count(*) FROM gn) AS units, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def _(v):
    return rounded(P.bootstrap_ci(gains(v), "fold", "gain", 200, "s"))


@query("wilcoxon", "preds", _GAIN + """, r AS (SELECT gain, rank() OVER (ORDER BY abs(gain)) + (count(*) OVER (PARTITION BY abs(gain)) - 1)/2.0 AS ar FROM gn WHERE gain <> 0), t AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT count(*) AS c FROM gn WHERE gain <> 0 GROUP BY abs(gain)) q)
SELECT count(*) AS n, round(sum(ar) FILTER (gain > 0), 6) AS w_plus, round((sum(ar) FILTER (gain > 0) - count(*)*(count(*) + 1)/4.0)/sqrt(count(*)*(count(*) + 1)*(2*count(*) + 1)/24.0 - (SELECT t FROM t)/48.0), 6) AS z FROM r""")
def _(v):
    return rounded(P.wilcoxon(gains(v), "gain"))


@query("sign_test", "preds", _GAIN + """, g AS (SELECT count(*) FILTER (gain > 0) AS positive, count(*) FILTER (gain <> 0) AS n FROM gn), t AS (SELECT positive, n, unnest(range(0, least(positive, n - positive) + 1)) AS i FROM g)
SELECT positive, n, round(least(1.0, 2*sum(factorial(CAST(n AS INT))/(factorial(CAST(i AS INT))*factorial(CAST(n - i AS INT))))/pow(2.0, n)), 6) AS p_value FROM t GROUP BY positive, n""")
def _(v):
    return rounded(P.sign_test(gains(v), "gain"))


@query("permutation_null", "preds")
def _(v):
    d = gains(v).join(v.preds.groupBy(F.col("port").alias("fold")).agg(F.avg("m1").alias("stat")), "fold")
    return rounded(P.permutation_null(d, "fold", "stat", F.col("gain") > 0, 50, "n"))
