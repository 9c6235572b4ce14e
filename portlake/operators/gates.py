"""Label-free gates between a base and an expert, and the policies built on them.

Rows carry a base prediction (p1), an expert prediction (p2) and scores; gates decide which one counts.
Class profiles and per-port summaries are small tables, joined as such.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.text import hash_key
from ..ordered import quantiles, running
from .metrics import auc, balanced_accuracy, class_prior


def rarity(df: DataFrame, port: str, pred: str, classes: int) -> DataFrame:
    """1 / count of each predicted class (0 counts as 1), scaled to mean one per port."""
    n = df.groupBy(port).agg(*[F.count_if(F.col(pred) == c).alias(f"_{c}") for c in range(classes)])
    inv = lambda c: 1.0 / F.greatest(F.lit(1), F.col(f"_{c}"))
    mean = sum((inv(c) for c in range(classes)), F.lit(0.0)) / classes
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), (inv(c) / mean).alias("rarity")) for c in range(classes)]))
    return n.select(port, each.alias("_e")).select(port, "_e.*")


def gate_features(df: DataFrame, s1: str, s2: str, classes: int, knowledge: str | None = None) -> DataFrame:
    """Margins, entropies and top probabilities of both predictions, whether they differ, base class one-hot, knowledge norm."""
    q1, q2 = S.softmax(F.col(s1)), S.softmax(F.col(s2))
    d = df.withColumns({"_q1": q1, "_q2": q2})
    cols = {
        "margin1": S.margin(F.col(s1)), "margin2": S.margin(F.col(s2)), "entropy1": S.entropy(F.col("_q1")), "entropy2": S.entropy(F.col("_q2")),
        "top1": F.array_max("_q1"), "top2": F.array_max("_q2"), "differ": (S.argmax(F.col(s1)) != S.argmax(F.col(s2))).cast("double")}
    cols |= {f"is_{c}": (S.argmax(F.col(s1)) == c).cast("double") for c in range(classes)}
    if knowledge:
        cols["knowledge_norm"] = S.norm(F.col(knowledge))
    return d.withColumns(cols).drop("_q1", "_q2")


def gated(base: str, expert: str, use: Column) -> Column:
    return F.when(F.coalesce(use, F.lit(False)), F.col(expert)).otherwise(F.col(base))


def tau_grid(df: DataFrame, keys: Sequence[str], score: str, truth: str, base: str, expert: str, taus: Sequence[float]) -> DataFrame:
    """Balanced accuracy of the gate `score > tau` for every tau of the grid."""
    t = df.withColumn("tau", F.explode(F.array(*[F.lit(x) for x in taus])))
    t = t.withColumn("_p", gated(base, expert, F.col(score) > F.col("tau")))
    return balanced_accuracy(t, [*keys, "tau"], truth, "_p")


def best_tau(grid: DataFrame, keys: Sequence[str], value: str = "ba", param: str = "tau", digits: int = 12) -> DataFrame:
    """Grid point with the largest value, the smaller one on a tie."""
    b = grid.groupBy(*keys).agg(F.min(F.struct((-F.round(value, digits)).alias("neg"), F.col(param).alias("v"))).alias("b"))
    return b.select(*keys, F.col("b.v").alias(param), (-F.col("b.neg")).alias(value))


def class_aware_gate(df: DataFrame, port: str, score: str, base: str, expert: str, classes: int, tau: float, deltas: Sequence[float]) -> DataFrame:
    """Expert where score > tau + delta * rarity(expert class); one row per sample and delta."""
    r = rarity(df, port, base, classes).select(port, F.col("cls").alias(expert), "rarity")
    j = df.join(F.broadcast(r), [port, expert]).withColumn("delta", F.explode(F.array(*[F.lit(x) for x in deltas])))
    return j.withColumn("gated", gated(base, expert, (F.col(score) > tau + F.col("delta") * F.col("rarity")) | (F.col(expert) == F.col(base))))


def class_gain(df: DataFrame, keys: Sequence[str], truth: str, base: str, expert: str, min_n: int = 1) -> DataFrame:
    """Recall difference expert minus base per truth class."""
    return df.groupBy(*keys, F.col(truth).alias("cls")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(expert) == F.col(truth)).cast("int")).alias("r2"), F.avg((F.col(base) == F.col(truth)).cast("int")).alias("r1")).where(
        F.col("n") >= min_n).withColumn("gain", F.col("r2") - F.col("r1"))


def source_gain(df: DataFrame, port: str, truth: str, base: str, expert: str, classes: int) -> DataFrame:
    """Per target fold and class: mean gain over the other ports (absent classes count 0)."""
    g = class_gain(df, [port], truth, base, expert)
    ports = df.select(port).distinct()
    tot = g.groupBy("cls").agg(F.sum("gain").alias("_t"))
    n = ports.agg(F.count(F.lit(1)).alias("_n"))
    # ports x classes of already aggregated gains
    grid = ports.join(F.broadcast(tot)).join(F.broadcast(n)).join(g.select(port, "cls", "gain"), [port, "cls"], "left")
    return grid.select(F.col(port).alias("fold"), "cls", ((F.col("_t") - F.coalesce("gain", F.lit(0.0))) / (F.col("_n") - 1)).alias("dk"))


def prior_shift(df: DataFrame, port: str, pred: str, classes: int) -> DataFrame:
    """Predicted class prior of a port minus that of all other ports together."""
    n = df.groupBy(port).agg(*[F.count_if(F.col(pred) == c).alias(f"_{c}") for c in range(classes)], F.count(F.lit(1)).alias("_n"))
    tot = n.agg(*[F.sum(f"_{c}").alias(f"t_{c}") for c in range(classes)], F.sum("_n").alias("t_n"))
    j = n.join(F.broadcast(tot))
    own = lambda c: F.col(f"_{c}") / F.col("_n")
    rest = lambda c: (F.col(f"t_{c}") - F.col(f"_{c}")) / (F.col("t_n") - F.col("_n"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), (own(c) - rest(c)).alias("shift")) for c in range(classes)]))
    return j.select(F.col(port).alias("fold"), each.alias("_e")).select("fold", "_e.*")


def prior_shift_gate(shift: DataFrame, dk: DataFrame) -> DataFrame:
    """g = shift . dK per fold, its cosine, and the decision to use the expert."""
    j = shift.join(dk, ["fold", "cls"])
    s, k = F.col("shift"), F.col("dk")
    g = j.groupBy("fold").agg(F.sum(s * k).alias("g"), (F.sum(s * k) / (F.sqrt(F.sum(s * s)) * F.sqrt(F.sum(k * k)) + 1e-9)).alias("cosine"))
    return g.withColumn("use_expert", F.col("g") > 0)


def shuffled_gate(shift: DataFrame, dk: DataFrame, seed: str) -> DataFrame:
    """Control: the same product with classes re-paired in hash order."""
    w = Window.partitionBy("fold")
    a = dk.withColumns({"_i": F.row_number().over(w.orderBy("cls")), "_j": F.row_number().over(w.orderBy(hash_key(F.col("cls"), seed), F.col("cls")))})
    moved = a.select("fold", F.col("_i").alias("k"), "cls").join(a.select("fold", F.col("_j").alias("k"), "dk"), ["fold", "k"]).drop("k")
    return prior_shift_gate(shift, moved)


def risk_taus(episodes: DataFrame, taus: Sequence[float]) -> DataFrame:
    """Per fold: tau by mean minus deviation and by lower quartile of the realised gain over its episodes.

    episodes(fold, q, g, gain): expert used where g > tau, else gain 0. Small per-port table."""
    e = episodes.withColumn("tau", F.explode(F.array(*[F.lit(x) for x in taus]))).withColumn("val", F.when(F.col("g") > F.col("tau"), F.col("gain")).otherwise(0.0))
    m = e.groupBy("fold", "tau").agg((F.avg("val") - F.stddev_pop("val")).alias("risk"))
    q = quantiles(e, ["fold", "tau"], "val", {"p25": 0.25}).drop("n")
    a = best_tau(m, ["fold"], "risk").select("fold", F.col("tau").alias("tau_risk"))
    return a.join(best_tau(q, ["fold"], "p25").select("fold", F.col("tau").alias("tau_p25")), "fold")


def source_matching(shift: DataFrame, gains: DataFrame, temperature: float) -> DataFrame:
    """Expected gain of a fold from the other ports' gains, weighted by the softmax of the cosine of their shifts.

    shift(fold, cls, shift); gains(fold, gain)."""
    a = shift.select("fold", "cls", F.col("shift").alias("a"))
    b = shift.select(F.col("fold").alias("q"), "cls", F.col("shift").alias("b"))
    c = a.join(b, "cls").where(F.col("fold") != F.col("q")).groupBy("fold", "q").agg(
        (F.sum(F.col("a") * F.col("b")) / (F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b"))) + 1e-9)).alias("cos"))
    w = c.withColumn("w", F.exp(F.col("cos") / temperature)).join(gains.withColumnRenamed("fold", "q"), "q")
    return w.groupBy("fold").agg((F.sum(F.col("w") * F.col("gain")) / F.sum("w")).alias("matched_gain")).withColumn("use_expert", F.col("matched_gain") > 0)


def per_class_mask(df: DataFrame, port: str, truth: str, base: str, expert: str, s1: str, s2: str, classes: int, min_n: int = 3) -> DataFrame:
    """Blend class by class: the expert's probability where source recall improves under the fold, else the base's."""
    r = class_gain(df, [port], truth, base, expert, min_n)
    ports = df.select(port).distinct().withColumnRenamed(port, "fold")
    up = ports.join(F.broadcast(r), ports["fold"] != r[port]).groupBy("fold", "cls").agg((F.avg("r2") > F.avg("r1")).alias("up"))
    m = up.groupBy("fold").agg(*[F.coalesce(F.max(F.when(F.col("cls") == c, F.col("up"))), F.lit(False)).cast("double").alias(f"_{c}") for c in range(classes)])
    m = m.select("fold", F.array(*[f"_{c}" for c in range(classes)]).alias("_w"))
    d = df.withColumn("fold", F.col(port)).join(F.broadcast(m), "fold")
    a, b = S.softmax(F.col(s1)), S.softmax(F.col(s2))
    both = F.zip_with(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), F.col("_w"), lambda q, w: F.when(w > 0, q["y"]).otherwise(q["x"]))
    return d.withColumn("masked", S.argmax(both)).drop("_w", "fold")


def reference_gates(df: DataFrame, port: str, key: str, score: str, margin: str, base: str, expert: str, tau: float, seed: str = "0") -> DataFrame:
    """Arms next to the gate `score > tau`: as many rows in hash order, and rows at or below the median margin."""
    med = quantiles(df, [port], margin, {"_med": 0.5}).drop("n")
    g = df.withColumn("_sel", (F.col(score) > tau).cast("long")).join(F.broadcast(med), port)
    r = running(g, [port], [hash_key(F.col(key), seed), F.col(key)], {"sel": F.col("_sel")})
    return r.select(
        *df.columns, gated(base, expert, F.col("_sel") == 1).alias("gate"), gated(base, expert, F.col("rn") <= F.col("tot_sel")).alias("random"),
        gated(base, expert, F.col(margin) <= F.col("_med")).alias("low_margin"))


def worst_class_tau(df: DataFrame, keys: Sequence[str], score: str, truth: str, base: str, expert: str, taus: Sequence[float], min_n: int = 5) -> DataFrame:
    """Tau whose worst class recall is best."""
    t = df.withColumn("tau", F.explode(F.array(*[F.lit(x) for x in taus]))).withColumn("_p", gated(base, expert, F.col(score) > F.col("tau")))
    c = t.groupBy(*keys, "tau", truth).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_p") == F.col(truth)).cast("int")).alias("r")).where(F.col("n") >= min_n)
    return best_tau(c.groupBy(*keys, "tau").agg(F.min("r").alias("worst")), keys, "worst")


def multi_candidate_gate(df: DataFrame, candidates: Mapping[str, str]) -> Column:
    """Prediction of the candidate with the largest correctness score (first on a tie). candidates: score column -> prediction column."""
    arms = F.array(*[F.struct((-F.col(s)).alias("neg"), F.lit(i).alias("i"), F.col(p).alias("p")) for i, (s, p) in enumerate(candidates.items())])
    return F.array_min(arms)["p"]


def conservative_theta(df: DataFrame, fold: str, inner: str, advantage: str, truth: str, safe: str, strong: str, thetas: Sequence[float]) -> DataFrame:
    """Per fold, the theta whose worst gain over its inner ports is best: strong where advantage > theta."""
    t = df.withColumn("theta", F.explode(F.array(*[F.lit(x) for x in thetas]))).withColumn("_p", gated(safe, strong, F.col(advantage) > F.col("theta")))
    g = balanced_accuracy(t, [fold, inner, "theta"], truth, "_p").select(fold, inner, "theta", "ba")
    b = balanced_accuracy(df, [fold, inner], truth, safe).select(fold, inner, F.col("ba").alias("_b"))
    w = g.join(b, [fold, inner]).groupBy(fold, "theta").agg(F.min(F.col("ba") - F.col("_b")).alias("worst_gain"))
    return best_tau(w, [fold], "worst_gain", "theta")


def quantile_rule(df: DataFrame, port: str, advantage: str, safe: str, strong: str, qs: Mapping[str, float]) -> DataFrame:
    """Strong where the advantage exceeds its own port quantile; one prediction column per quantile."""
    q = quantiles(df, [port], advantage, {f"_q_{n}": v for n, v in qs.items()}).drop("n")
    j = df.join(F.broadcast(q), port)
    return j.select(*df.columns, *[gated(safe, strong, F.col(advantage) > F.col(f"_q_{n}")).alias(n) for n in qs])


def rate_matched_gate(target: DataFrame, source: DataFrame, port: str, score: str, base: str, expert: str, tau: float, key: str) -> DataFrame:
    """Use the expert on the same share of each target port as the source gate does.

    source(fold, score): the share above `tau` on a fold's source rows sets the target's quantile."""
    rate = source.groupBy(F.col("fold").alias(port)).agg(F.avg((F.col(score) > tau).cast("int")).alias("rate"))
    r = running(target, [port], [F.col(score).desc(), F.col(key)]).join(F.broadcast(rate), port)
    return r.select(*target.columns, "rate", gated(base, expert, F.col("rn") <= F.round(F.col("rate") * F.col("n"))).alias("matched"))


def veto(df: DataFrame, fold: str, expert: str, unsafe: DataFrame, pred: str, base: str, out: str) -> DataFrame:
    """Fall back to the base where the expert's class is unsafe for the fold. unsafe(fold, cls)."""
    u = unsafe.select(F.col("fold").alias(fold), F.col("cls").alias(expert), F.lit(True).alias("_u")).distinct()
    return df.join(F.broadcast(u), [fold, expert], "left").withColumn(out, F.when(F.coalesce("_u", F.lit(False)), F.col(base)).otherwise(F.col(pred))).drop("_u")


def port_veto(df: DataFrame, port: str, score: str, pred: str, base: str, minimum: DataFrame, out: str) -> DataFrame:
    """Keep the base on ports whose mean score is below the fold's minimum. minimum(fold, least)."""
    m = df.groupBy(port).agg(F.avg(score).alias("_m")).join(minimum.withColumnRenamed("fold", port), port).select(port, (F.col("_m") >= F.col("least")).alias("_keep"))
    return df.join(F.broadcast(m), port).withColumn(out, F.when(F.col("_keep"), F.col(pred)).otherwise(F.col(base))).drop("_keep")


def net_gain_label(truth: str, base: str, expert: str) -> Column:
    """+1 rescue, -1 harm, 0 otherwise."""
    b, e = F.col(base) == F.col(truth), F.col(expert) == F.col(truth)
    return F.when(~b & e, 1).when(b & ~e, -1).otherwise(0)


def predictor_auc(df: DataFrame, label: str, predictors: Sequence[str]) -> DataFrame:
    """AUC of each candidate predictor for the sign of a non-zero label."""
    d = df.where(F.col(label) != 0).select(label, F.explode(F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(p).cast("double").alias("value")) for p in predictors])).alias("_p")).select(label, "_p.*")
    return auc(d, ["predictor"], "value", F.col(label) > 0)


def absorption_rate(df: DataFrame, keys: Sequence[str], known: Column, correct: Column, conf: str, q: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """Threshold from the low quantile of correct known confidences; accepted share of known and unknown, and per unknown class."""
    t = quantiles(df.where(known & correct), keys, conf, {"threshold": q}).drop("n")
    d = df.join(F.broadcast(t), list(keys)) if keys else df.join(F.broadcast(t))
    over = (F.col(conf) >= F.col("threshold")).cast("int")
    g = d.groupBy(*keys).agg(F.max("threshold").alias("threshold"), F.avg(F.when(known, over)).alias("known_accepted"), F.avg(F.when(~known, over)).alias("absorbed"))
    return g, d.where(~known).withColumn("_over", over)


def open_set_counts(df: DataFrame, keys: Sequence[str], truth: str, pred: str, accept: Column, known: Column) -> DataFrame:
    """Balanced accuracy of known classes with a rejection counted wrong, recall of unknowns, unknowns accepted."""
    d = df.withColumns({"_a": accept, "_k": known, "_p": F.when(accept, F.col(pred)).otherwise(-1)})
    b = balanced_accuracy(d.where("_k"), keys, truth, "_p").select(*keys, F.col("ba").alias("known_ba"))
    u = d.groupBy(*keys).agg(
        F.avg(F.when(~F.col("_k"), (~F.col("_a")).cast("int"))).alias("unknown_recall"), F.avg(F.when(~F.col("_k"), F.col("_a").cast("int"))).alias("unknown_accepted"))
    return b.join(u, list(keys))


def classwise_weight(df: DataFrame, keys: Sequence[str], visual: str, knowledge: str, truth: str, classes: int, grid: Sequence[float]) -> DataFrame:
    """Per class the weight on the knowledge part of the score that gives the best recall (smaller weight on a tie)."""
    t = df.withColumn("w", F.explode(F.array(*[F.lit(x) for x in grid])))
    t = t.withColumn("_p", S.argmax(F.transform(S.add(F.col(visual), F.col(knowledge), F.col("w")), lambda z: F.round(z, 9))))
    r = t.groupBy(*keys, F.col(truth).alias("cls"), "w").agg(F.avg((F.col("_p") == F.col(truth)).cast("int")).alias("recall"))
    return best_tau(r, [*keys, "cls"], "recall", "w")


def candidate_oracle(df: DataFrame, keys: Sequence[str], truth: str, preds: Sequence[str]) -> DataFrame:
    """Balanced accuracy when any right candidate counts (evaluation only)."""
    hit = F.lit(False)
    for p in preds:
        hit = hit | (F.col(p) == F.col(truth))
    return balanced_accuracy(df.withColumn("_p", F.when(hit, F.col(truth)).otherwise(-1)), keys, truth, "_p").withColumn("deployable", F.lit(False))
