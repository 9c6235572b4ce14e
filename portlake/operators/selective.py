"""Ordered selections: caps, budgets, conformal thresholds and risk-coverage summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_key
from ..ordered import quantiles, running, value_ranks
from .metrics import balanced_accuracy

# fixed value: calibration rows a predicted class needs for its own threshold
MIN_CLASS_CALIBRATION = 100


def cap_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, keep: str | None = None) -> DataFrame:
    """First `limit` rows per group in a fixed order.

    Each task keeps its own first rows before the shuffle, so a hot group sends at most `limit` rows per task.
    """
    rn = keep or "_rn"
    out = df.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rn) <= limit)
    return out if keep else out.drop(rn)


def hash_cap(df: DataFrame, keys: Sequence[str], id_col: str, limit: int, seed: str = "") -> DataFrame:
    """Reproducible sample of at most `limit` rows per group."""
    return cap_per_group(df, keys, [hash_key(F.col(id_col), seed), F.col(id_col)], limit)


def by_score(df: DataFrame, keys: Sequence[str], score: str, key: str, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows ranked by descending score (ties by id) with running sums."""
    return running(df, keys, [F.col(score).desc(), F.col(key)], sums)


def conformal_threshold(df: DataFrame, keys: Sequence[str], score: str, wrong: Column, alpha: float, key: str, weight: Column | None = None) -> DataFrame:
    """Score of the longest prefix (by descending score) whose running error stays at or below `alpha`; null if none.

    With `weight` the running error is the ratio of two weighted sums.
    """
    w = F.lit(1.0) if weight is None else weight
    r = by_score(df, keys, score, key, {"e": w * wrong.cast("double"), "w": w})
    ok = F.col("run_e") / F.col("run_w") <= alpha
    return r.groupBy(*keys).agg(
        F.max(F.when(ok, F.struct("rn", F.col(score).alias("s")))).alias("b"), F.max("n").alias("n")).select(
        *keys, "n", F.col("b.s").alias("threshold"), F.coalesce(F.col("b.rn"), F.lit(0)).alias("accepted"))


def threshold_by_class(df: DataFrame, keys: Sequence[str], pred: str, score: str, wrong: Column, alpha: float, key: str, min_rows: int = MIN_CLASS_CALIBRATION) -> DataFrame:
    """Threshold per value of `pred` (a predicted class, a true class, a cluster) where it has `min_rows` calibration rows, else the global one."""
    g = conformal_threshold(df, keys, score, wrong, alpha, key).select(*keys, F.col("threshold").alias("_g"))
    c = conformal_threshold(df, [*keys, pred], score, wrong, alpha, key)
    j = c.join(g, list(keys)) if keys else c.crossJoin(g)
    return j.select(*keys, pred, "n", F.when(F.col("n") >= min_rows, F.col("threshold")).otherwise(F.col("_g")).alias("threshold"))


def threshold_by_tercile(df: DataFrame, keys: Sequence[str], score: str, wrong: Column, alpha: float, key: str) -> DataFrame:
    """Threshold within each third of the score distribution."""
    q = quantiles(df, keys, score, {"q1": 1 / 3, "q2": 2 / 3}).drop("n")
    d = (df.join(q, list(keys)) if keys else df.crossJoin(F.broadcast(q))).withColumn(
        "tercile", F.when(F.col(score) <= F.col("q1"), 0).when(F.col(score) <= F.col("q2"), 1).otherwise(2))
    return conformal_threshold(d, [*keys, "tercile"], score, wrong, alpha, key)


def audit_threshold(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], score: str, wrong: Column, alpha: float) -> DataFrame:
    """Coverage and risk of a threshold on other rows, and whether the target was met."""
    t = thresholds.select(*keys, "threshold")
    d = (df.join(t, list(keys)) if keys else df.crossJoin(F.broadcast(t))).withColumns({"_in": F.coalesce(F.col(score) >= F.col("threshold"), F.lit(False)), "_w": wrong.cast("int")})
    return d.groupBy(*keys).agg(F.avg(F.col("_in").cast("int")).alias("coverage"), F.avg(F.when(F.col("_in"), F.col("_w"))).alias("risk")).withColumn(
        "met", F.coalesce(F.col("risk") <= alpha, F.lit(False)))


def aurc(df: DataFrame, keys: Sequence[str], score: str, wrong: Column, key: str) -> DataFrame:
    """Mean of the running error over all prefixes."""
    r = by_score(df, keys, score, key, {"e": wrong.cast("long")})
    return r.groupBy(*keys).agg(F.avg(F.col("run_e") / F.col("rn")).alias("aurc"), F.max("n").alias("n"))


def risk_at_coverage(df: DataFrame, keys: Sequence[str], score: str, wrong: Column, key: str, coverages: Sequence[float]) -> DataFrame:
    """Error among the top share of rows, for several shares from one ranking."""
    r = by_score(df, keys, score, key, {"e": wrong.cast("long")})
    g = r.groupBy(*keys).agg(*[
        F.max(F.when(F.col("rn") == F.greatest(F.lit(1), F.floor(F.lit(c) * F.col("n"))), F.col("run_e") / F.col("rn"))).alias(f"_{i}") for i, c in enumerate(coverages)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("coverage"), F.col(f"_{i}").alias("risk")) for i, c in enumerate(coverages)]))
    return g.select(*keys, each.alias("_e")).select(*keys, "_e.*")


def budget_pick(df: DataFrame, keys: Sequence[str], score: str, key: str, shares: Sequence[float], seed: str = "0") -> DataFrame:
    """Mark, per share, the top rows by score and as many rows in hash order (`share`, `top`, `random`)."""
    a = by_score(df, keys, score, key).withColumnsRenamed({"rn": "_by_score", "n": "_n"})
    b = running(a, keys, [hash_key(F.col(key), seed), F.col(key)]).drop("n").withColumnRenamed("rn", "_by_hash")
    s = b.withColumn("share", F.explode(F.array(*[F.lit(x) for x in shares])))
    k = F.greatest(F.lit(1), F.floor(F.col("share") * F.col("_n")))
    return s.select(*df.columns, "share", (F.col("_by_score") <= k).alias("top"), (F.col("_by_hash") <= k).alias("random"))


def budget_topk(df: DataFrame, keys: Sequence[str], score: str, key: str, truth: str, base: str, expert: str, shares: Sequence[float], seed: str = "0") -> DataFrame:
    """Balanced accuracy when the expert decides the top share (or a random share) and the base the rest."""
    p = budget_pick(df.select(key, *keys, score, truth, base, expert), keys, score, key, shares, seed)
    arm = lambda n, c: F.struct(F.lit(n).alias("arm"), F.when(F.col(c), F.col(expert)).otherwise(F.col(base)).alias("pred"))
    e = p.select(*keys, truth, "share", F.explode(F.array(arm("score", "top"), arm("random", "random"))).alias("a")).select(*keys, truth, "share", "a.*")
    return balanced_accuracy(e, [*keys, "share", "arm"], truth, "pred").select(*keys, "share", "arm", "ba", "accuracy")


def budget_headtohead(df: DataFrame, keys: Sequence[str], rankers: Sequence[str], key: str, truth: str, base: str, expert: str, share: float) -> DataFrame:
    """The same budget spent by several rankers, next to the random floor."""
    long = df.select(key, *keys, truth, base, expert, F.explode(F.array(*[F.struct(F.lit(r).alias("ranker"), F.col(r).cast("double").alias("_score")) for r in rankers])).alias("_r")).select(
        key, *keys, truth, base, expert, "_r.*")
    return budget_topk(long, [*keys, "ranker"], "_score", key, truth, base, expert, [share]).drop("share")


def known_rate_at_budget(df: DataFrame, keys: Sequence[str], score: str, key: str, known: Column, share: float) -> DataFrame:
    """Share of known classes in the ranked and in the random top share."""
    p = budget_pick(df.withColumn("_known", known.cast("int")), keys, score, key, [share])
    return p.groupBy(*keys).agg(F.avg(F.when(F.col("top"), F.col("_known"))).alias("ranked"), F.avg(F.when(F.col("random"), F.col("_known"))).alias("random"))


def loo_bag_consistency(df: DataFrame, bag: Sequence[str], product: str, pred: str, out: str) -> DataFrame:
    """Share of the bag's members in other products that carry the same prediction; null without such members or without a bag.

    Rows are counted once by (bag, product, prediction); the other three counts are sums over that table, which comes back to the
    rows in one join that takes nulls as equal."""
    bag = list(bag)
    keys = [*bag, product, pred]
    over = lambda *k: F.sum("_c").over(Window.partitionBy(*k))
    c = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    rest = F.col("_all") - F.col("_own")
    c = c.withColumns({"_all": over(*bag), "_own": over(*bag, product), "_same": over(*bag, pred)})
    named = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in bag], F.lit(True))
    share = F.when(named & (rest > 0), (F.col("_same") - F.col("_c")) / rest)
    c = c.select(*[F.col(k).alias(f"_k_{k}") for k in keys], share.alias("_share"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(c, same).select(*df.columns, F.col("_share").alias(out))


def joint_rank(df: DataFrame, keys: Sequence[str], a: str, b: str, key: str, share: float) -> DataFrame:
    """Four selections of the same size by two scores: each alone, their z-sum, and rows high on both filled up by the sum."""
    m = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in (a, b) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-9)
    d = df.join(m, list(keys)).select(key, *keys, F.round(z(a), 9).alias("_za"), F.round(z(b), 9).alias("_zb")).withColumn("_zs", F.round(F.col("_za") + F.col("_zb"), 9))
    for c in ("_za", "_zb", "_zs"):
        d = by_score(d.drop("_n"), keys, c, key).withColumnsRenamed({"rn": "r" + c, "n": "_n"})
    k = F.greatest(F.lit(1), F.floor(share * F.col("_n")))
    d = d.withColumn("_both", ((F.col("r_za") <= k) & (F.col("r_zb") <= k)).cast("int"))
    d = running(d, keys, [F.col("_both").desc(), F.col("r_zs")]).drop("n").withColumnRenamed("rn", "r_and")
    return d.select(key, *keys, (F.col("r_za") <= k).alias("by_a"), (F.col("r_zb") <= k).alias("by_b"), (F.col("r_zs") <= k).alias("by_sum"), (F.col("r_and") <= k).alias("by_and"))


def rank_sum(df: DataFrame, keys: Sequence[str], a: str, b: str, key: str, out: str = "combo") -> DataFrame:
    """Sum of two within-group percentiles."""
    from .metrics import within_group_percentile

    d = within_group_percentile(within_group_percentile(df, keys, a, key, "_pa"), keys, b, key, "_pb")
    return d.select(*df.columns, (F.col("_pa") + F.col("_pb")).alias(out))


def stratified_round_robin(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: str = "") -> DataFrame:
    """`n` rows taken one per stratum in turn, hash order inside a stratum."""
    c = cap_per_group(df, strata, [hash_key(F.col(key), seed), F.col(key)], n, keep="turn")
    return c.orderBy("turn", *strata).limit(n)


def leave_one_out_tau(scores: DataFrame, port: str, score: str, margin: float, floor: float) -> DataFrame:
    """Tolerance of each port from the other ports' scores: their largest plus a margin, at least `floor`.

    Only the two largest scores matter, so nothing is compared pairwise."""
    s = scores.where(F.col(score).isNotNull())
    w = Window.orderBy(F.desc(score), port)
    top = s.withColumn("_r", F.row_number().over(w)).where("_r <= 2").agg(
        F.max(F.when(F.col("_r") == 1, F.col(port))).alias("_top"), F.max(F.when(F.col("_r") == 1, F.col(score))).alias("_s1"), F.max(F.when(F.col("_r") == 2, F.col(score))).alias("_s2"))
    others = F.when(F.col(port) == F.col("_top"), F.col("_s2")).otherwise(F.col("_s1"))
    return s.crossJoin(F.broadcast(top)).select(port, score, F.greatest(F.lit(floor), others + margin).alias("tau"))


def source_side_threshold(source: DataFrame, held: str, score: str, q: float = 0.05) -> DataFrame:
    """Low quantile of known scores on each held source port."""
    return quantiles(source, [held], score, {"threshold": q})


def percentile_of_reference(train: DataFrame, target: DataFrame, keys: Sequence[str], dist: str, key: str) -> DataFrame:
    """Share of training distances below each target distance."""
    u = train.select(*keys, dist, F.lit(1).alias("_t")).unionByName(target.select(*keys, dist, F.lit(0).alias("_t")))
    r = value_ranks(u, keys, dist, {"train": F.col("_t")}).select(*keys, dist, (F.col("below_train") / F.col("tot_train")).alias("percentile"))
    return target.select(key, *keys, dist).join(r, [*keys, dist])
