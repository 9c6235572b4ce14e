"""Decision rules over score arrays, control arms, selection rules and paired statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.text import hash_key
from ..ordered import quantiles, running
from .metrics import auc, balanced_accuracy
from .selective import aurc, budget_topk
from .spatial import components


def balanced_weights(df: DataFrame, port: str, cls: str) -> DataFrame:
    """Row weight 1 / (ports * classes of the port * rows of the class in the port); weights sum to one."""
    c = df.groupBy(port, cls).agg(F.count(F.lit(1)).alias("_n"))
    c = c.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(port)))
    ports = df.agg(F.countDistinct(port).alias("_p"))
    w = c.join(F.broadcast(ports)).select(port, cls, (1.0 / (F.col("_p") * F.col("_c") * F.col("_n"))).alias("weight"))
    return df.join(w, [port, cls])


def direction_operator(p: Column, gain: Column, kappa: float = 1.0, topk: int = 3) -> Column:
    """Move probability from the predicted class towards the `topk` largest positive gains, mass conserved."""
    def step(row):
        q, a = row["p"], row["a"]
        u = F.transform(row["g"], lambda g, i: F.when(i == a, 0.0).otherwise(F.greatest(g, F.lit(0.0))))
        strong = S.let(u, lambda v: S.let(F.element_at(F.sort_array(v, asc=False), topk), lambda limit: F.transform(v, lambda g: F.when(g >= limit, g * kappa).otherwise(0.0))))
        flow = S.let(strong, lambda r: S.let(F.element_at(q, a + 1) / (1.0 + S.total(r)), lambda unit: F.transform(r, lambda g: unit * g)))
        return S.let(flow, lambda f: S.let(S.total(f), lambda out: F.transform(
            F.zip_with(q, f, lambda x, y: x + y), lambda x, i: F.greatest(F.lit(0.0), F.when(i == a, x - out).otherwise(x)))))

    bound = S.let(p, lambda q: F.struct(q.alias("p"), S.argmax(q).alias("a"), gain.alias("g")))
    return S.let(bound, step)


def coupling_law(visual: Column, knowledge: Column, novelty: Column, kappa: float) -> Column:
    """Visual logits plus knowledge logits damped by novelty."""
    return F.zip_with(visual, knowledge, lambda v, k: v + (1.0 - novelty) * kappa * k)


def knowledge_penalty(p: Column, expected: Column, observed: Column, sigma: Column, lam: float) -> Column:
    """log p minus `lam` times the mean squared scaled deviation per class; `expected` is array over classes of array over dims."""
    def deviation(e):
        d = F.zip_with(F.zip_with(e, observed, lambda x, o: x - o), sigma, lambda x, s: (x / s) * (x / s))
        return S.mean(d)

    return F.zip_with(p, expected, lambda q, e: F.log(F.greatest(q, F.lit(1e-12))) - lam * deviation(e))


def prior_offset(scores: Column, prior: Column) -> Column:
    """Add the log class frequency of the source to the scores."""
    return F.zip_with(scores, prior, lambda s, p: s + F.log(F.greatest(p, F.lit(1e-9))))


def support_mask(p: Column, prior: Column, tau: float) -> Column:
    """Drop classes whose estimated prior is below `tau` and renormalise; unmasked if nothing survives."""
    kept = F.zip_with(p, prior, lambda x, q: F.when(q >= tau, x).otherwise(0.0))
    return S.let(kept, lambda k: S.let(S.total(k), lambda t: F.when(t > 1e-12, F.transform(k, lambda x: x / t)).otherwise(p)))


def hash_permutation(df: DataFrame, keys: Sequence[str], key: str, seed: str) -> DataFrame:
    """`key`, `donor`: every row of a group receives another row of the group in hash order (a permutation)."""
    ids = df.select(*keys, key)
    a = running(ids, keys, [F.col(key)]).drop("n")
    b = running(ids, keys, [hash_key(F.col(key), seed), F.col(key)]).drop("n").withColumnRenamed(key, "donor")
    return a.join(b, [*keys, "rn"]).select(key, "donor")


def hash_permutations(df: DataFrame, keys: Sequence[str], key: str, seeds: Sequence[str]) -> DataFrame:
    """`key`, `donor`, `seed`: the permutations of `hash_permutation` for all seeds, with the seeds as rows."""
    ids = df.select(*keys, key)
    a = running(ids, keys, [F.col(key)]).drop("n")
    many = ids.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    b = running(many, [*keys, "seed"], [F.sha2(F.concat("seed", F.col(key).cast("string")), 256), F.col(key)]).drop("n").withColumnRenamed(key, "donor")
    return a.join(b, [*keys, "rn"]).select(key, "donor", "seed")


def permuted(df: DataFrame, keys: Sequence[str], key: str, value: str, seed: str) -> DataFrame:
    """`df` with `value` taken from the donor row."""
    m = hash_permutation(df, keys, key, seed)
    d = df.select(F.col(key).alias("donor"), F.col(value).alias("_v"))
    return df.join(m, key).join(d, "donor").withColumn(value, F.col("_v")).select(*df.columns)


def port_mean_arrays(df: DataFrame, port: str, value: str, out: str, weight: Column | None = None) -> DataFrame:
    """Replace an array by its port mean, element by element."""
    m = df.select(port, F.posexplode(value).alias("d", "x")).groupBy(port, "d").agg(F.avg("x").alias("m"))
    m = m.groupBy(port).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias(out))
    return df.join(F.broadcast(m), port)


def column_permutation(value: Column, order: Sequence[int]) -> Column:
    return F.array(*[F.element_at(value, i + 1) for i in order])


def pair_auc(df: DataFrame, scores: str, truth: str, classes: int) -> DataFrame:
    """AUC of the score difference between every two classes on the rows of those classes."""
    other = F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))
    r = df.select(truth, scores, other.alias("_o")).where(F.col("_o") != F.col(truth))
    a, b = F.least(truth, "_o"), F.greatest(truth, "_o")
    r = r.select(a.alias("a"), b.alias("b"), (F.col(truth) == a).alias("_first"), F.round(F.element_at(scores, a + 1) - F.element_at(scores, b + 1), 9).alias("_s"))
    return auc(r, ["a", "b"], "_s", F.col("_first")).select("a", "b", "n", "auc")


def class_blocks(pairs: DataFrame, classes: DataFrame, tau: float) -> DataFrame:
    """Classes that cannot be told apart (pair AUC below `tau`) joined into blocks: `cls`, `block` (smallest class)."""
    return components(classes, pairs.where(F.col("auc") < tau).select("a", "b"), "cls").withColumnRenamed("component", "block")


def block_accuracy(df: DataFrame, blocks: DataFrame, keys: Sequence[str], truth: str, pred: str) -> DataFrame:
    """Balanced accuracy after truth and prediction are replaced by their blocks (a class table, broadcast)."""
    b = lambda c, o: F.broadcast(blocks.select(F.col("cls").alias(c), F.col("block").alias(o)))
    return balanced_accuracy(df.join(b(truth, "_t"), truth).join(b(pred, "_p"), pred), keys, "_t", "_p")


def random_blocks(blocks: DataFrame, seed: str) -> DataFrame:
    """A partition with the same block sizes over hash-ordered classes (class tables are tiny)."""
    w = Window.orderBy("cls")
    a = blocks.withColumns({"_i": F.row_number().over(w), "_j": F.row_number().over(Window.orderBy(hash_key(F.col("cls"), seed), F.col("cls")))})
    return a.select("cls", F.col("_j").alias("k")).join(a.select(F.col("_i").alias("k"), "block"), "k").select("cls", "block")


def select_threshold_rule(episodes: DataFrame, port: str, stat: str, gain: str) -> DataFrame:
    """Per held-out port: the direction and threshold on `stat` with the largest mean gain over the other ports' episodes.

    Prefix sums over the sorted statistic give the gain of every candidate threshold in one pass."""
    e = episodes.select(port, F.round(stat, 6).alias("t"), F.col(gain).alias("g"))
    folds = e.select(F.col(port).alias("fold")).distinct()
    # ports x episodes: both are per-port tables
    f = folds.join(e, F.col("fold") != F.col(port)).groupBy("fold", "t").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("c"))
    both = f.select("fold", "t", "g", "c", F.explode(F.array(F.lit(1), F.lit(-1))).alias("direction"))
    r = running(both, ["fold", "direction"], [(F.col("direction") * F.col("t")).desc()], {"g": F.col("g"), "c": F.col("c")})
    # selecting nobody or everybody is no rule
    cand = r.where(F.col("run_c") < F.col("tot_c")).withColumn("value", F.round(F.col("run_g") / F.col("tot_c"), 9))
    return cand.groupBy("fold").agg(F.min(F.struct((-F.col("value")).alias("neg"), (-F.col("direction")).alias("d"), "t")).alias("b")).select(
        "fold", (-F.col("b.neg")).alias("train_gain"), (-F.col("b.d")).alias("direction"), F.col("b.t").alias("threshold"))


def rule_regret(episodes: DataFrame, rules: DataFrame, port: str, stat: str, gain: str) -> DataFrame:
    """Realised gain of the chosen rule on the held-out port and the regret against knowing the sign."""
    j = episodes.join(rules.withColumnRenamed("fold", port), port)
    use = F.col("direction") * F.round(stat, 6) >= F.col("direction") * F.col("threshold")
    return j.groupBy(port).agg(
        F.count(F.lit(1)).alias("episodes"), F.sum(use.cast("int")).alias("used"), F.avg(F.when(use, F.col(gain)).otherwise(0.0)).alias("gain"),
        F.avg(F.greatest(F.col(gain), F.lit(0.0)) - F.when(use, F.col(gain)).otherwise(0.0)).alias("regret"))


def deployability(df: DataFrame, port: str, key: str, margin: str, truth: str, base: str, expert: str, share: float = 0.2) -> DataFrame:
    """Payoff of a budget over random, 1 - AURC and label-free shape of the margin per domain."""
    b = budget_topk(df, [port], margin, key, truth, base, expert, [share]).groupBy(port).agg(
        (F.max(F.when(F.col("arm") == "score", F.col("ba"))) - F.max(F.when(F.col("arm") == "random", F.col("ba")))).alias("payoff"))
    r = aurc(df, [port], margin, F.col(base) != F.col(truth), key).select(port, "n", (1 - F.col("aurc")).alias("rank_quality"))
    q = quantiles(df, [port], margin, {"_10": 0.1, "_25": 0.25, "_75": 0.75, "_90": 0.9}).drop("n")
    m = df.groupBy(port).agg(F.stddev_pop(margin).alias("sd"), F.skewness(margin).alias("skew"))
    return b.join(r, port).join(m, port).join(q, port).select(
        port, "n", "payoff", "rank_quality", "sd", "skew", (F.col("_75") - F.col("_25")).alias("iqr"), (F.col("_90") - F.col("_10")).alias("q90q10"))


def rank_invariance(df: DataFrame, port: str, key: str, score: str, share: float, exponents: Sequence[float]) -> DataFrame:
    """Rows that enter or leave the top share when the score is raised to a power (expected none)."""
    def top(expr, out):
        r = running(df.select(key, port, expr.alias("_s")), [port], [F.col("_s").desc(), F.col(key)])
        return r.where(F.col("rn") <= F.greatest(F.lit(1), F.floor(share * F.col("n")))).select(port, key, F.lit(True).alias(out))

    base = top(F.col(score), "_a")
    out = None
    for g in exponents:
        j = base.join(top(F.pow(F.greatest(F.col(score), F.lit(1e-6)), F.lit(g)), "_b"), [port, key], "full")
        one = j.groupBy(port).agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("changed")).withColumn("exponent", F.lit(g))
        out = one if out is None else out.unionByName(one)
    return out


def bootstrap_ci(pairs: DataFrame, key: str, delta: str, reps: int, seed: str, level: float = 0.95) -> DataFrame:
    """Mean difference over units with a percentile interval; replicate r draws unit `hash(r, slot)`.

    Units are ports: a small table, numbered once; replicates are rows."""
    u = running(pairs.select(key, delta), [], [F.col(key)])
    slots = u.select("n", F.col("rn").alias("slot")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    draw = slots.withColumn("rn", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("rep").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long"), F.col("n")) + 1)
    m = draw.join(F.broadcast(u.select("rn", delta)), "rn").groupBy("rep").agg(F.avg(delta).alias("m"))
    a = (1 - level) / 2
    ci = quantiles(m, [], "m", {"low": a, "high": 1 - a}).drop("n")
    return u.agg(F.avg(delta).alias("mean"), F.count(F.lit(1)).alias("units")).crossJoin(ci)


def wilcoxon(pairs: DataFrame, delta: str) -> DataFrame:
    """Signed-rank statistic with tie-averaged ranks and its normal approximation (zeros dropped)."""
    from ..ordered import value_ranks

    d = pairs.where(F.col(delta) != 0).select(F.abs(delta).alias("_a"), (F.col(delta) > 0).cast("long").alias("_p"))
    r = value_ranks(d, [], "_a", {"pos": F.col("_p")})
    g = r.agg(F.sum(F.col("pos") * F.col("avg_rank")).alias("w_plus"), F.max("n").alias("n"), F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("_t"))
    n = F.col("n")
    mu, sd = n * (n + 1) / 4.0, F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_t") / 48.0)
    return g.select("n", "w_plus", ((F.col("w_plus") - mu) / sd).alias("z"))


def sign_test(pairs: DataFrame, delta: str) -> DataFrame:
    """Positive and non-zero units with the two-sided exact binomial p-value."""
    g = pairs.agg(F.count_if(F.col(delta) > 0).alias("positive"), F.count_if(F.col(delta) != 0).alias("n"))
    k = F.least(F.col("positive"), F.col("n") - F.col("positive"))
    upto = lambda i: F.when(i > 0, F.sequence(F.lit(1), i)).otherwise(F.array().cast("array<bigint>"))
    # log of C(n, i) / 2^n, so that no number of units overflows
    share = lambda i: F.exp(F.aggregate(upto(i), -F.col("n") * F.log(F.lit(2.0)), lambda s, j: s + F.log((F.col("n") - j + 1) / j)))
    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k), F.lit(0.0), lambda s, i: s + share(i))
    return g.select("positive", "n", F.least(F.lit(1.0), 2 * tail).alias("p_value"))


def permutation_null(df: DataFrame, key: str, score: str, label: Column, reps: int, seed: str) -> DataFrame:
    """AUC of the score under labels re-paired in hash order; replicates are rows. For per-port tables."""
    d = df.withColumn("_l", label.cast("int")).select(key, score, "_l")
    r = d.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    a = running(r, ["rep"], [F.col(key)]).select("rep", "rn", score)
    b = running(r, ["rep"], [hash_key(F.concat_ws(":", F.col("rep").cast("string"), F.col(key).cast("string")), seed), F.col(key)]).select("rep", "rn", "_l")
    return auc(a.join(b, ["rep", "rn"]), ["rep"], score, F.col("_l") == 1).select("rep", "auc")
