"""Evaluation of predictions: confusion, recall, priors, ranks and dimension audits.

Frames hold one row per sample with a truth column and prediction columns; `keys` is the domain (for example port).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ordered import quantiles, running, value_ranks, with_average_rank


def parent_class(df: DataFrame, parents: DataFrame, cls: str, unknown: str = "error") -> DataFrame:
    """Add `coarse` from a (fine, coarse) table; an unknown class is dropped or raises."""
    p = parents.select(F.col("fine").alias(cls), "coarse")
    if unknown == "drop":
        return df.join(p, cls)
    out = df.join(p, cls, "left")
    if not out.where(F.col(cls).isNotNull() & F.col("coarse").isNull()).limit(1).isEmpty():
        raise ValueError(f"classes without a parent in {cls}")
    return out


def confusion(df: DataFrame, keys: Sequence[str], truth: str, pred: str, by: str = "row") -> DataFrame:
    """Counts per (truth, prediction) with shares of the row (truth) or column (prediction)."""
    g = df.groupBy(*keys, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys, "truth" if by == "row" else "pred")
    return g.withColumn("share", F.col("n") / F.sum("n").over(w))


def class_recall(df: DataFrame, keys: Sequence[str], truth: str, pred: str, min_n: int = 1) -> DataFrame:
    """Recall of each truth class present in the group."""
    return df.groupBy(*keys, F.col(truth).alias("cls")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(pred) == F.col(truth)).cast("int")).alias("recall")).where(F.col("n") >= min_n)


def balanced_accuracy(df: DataFrame, keys: Sequence[str], truth: str, pred: str, min_n: int = 1) -> DataFrame:
    """Mean recall over truth classes, accuracy, rows and classes per group."""
    c = df.groupBy(*keys, truth).agg(F.count(F.lit(1)).alias("_n"), F.sum((F.col(pred) == F.col(truth)).cast("int")).alias("_ok")).where(F.col("_n") >= min_n)
    return c.groupBy(*keys).agg(
        F.avg(F.col("_ok") / F.col("_n")).alias("ba"), (F.sum("_ok") / F.sum("_n")).alias("accuracy"), F.sum("_n").alias("n"), F.count(F.lit(1)).alias("classes"))


def equal_port_ba(df: DataFrame, port: str, truth: str, pred: str) -> DataFrame:
    return balanced_accuracy(df, [port], truth, pred).agg(F.avg("ba").alias("equal_port_ba"), F.count(F.lit(1)).alias("ports"))


def long_predictions(df: DataFrame, preds: Mapping[str, str | Column], keep: Sequence[str]) -> DataFrame:
    """One row per sample and arm (`arm`, `pred`)."""
    arms = [F.struct(F.lit(n).alias("arm"), (F.col(c) if isinstance(c, str) else c).cast("int").alias("pred")) for n, c in preds.items()]
    return df.select(*keep, F.explode(F.array(*arms)).alias("_a")).select(*keep, "_a.arm", "_a.pred")


def rescue_harm(df: DataFrame, keys: Sequence[str], truth: str, base: str, alt: str) -> DataFrame:
    """Wrong to right, right to wrong and the net per group."""
    b, a = F.col(base) == F.col(truth), F.col(alt) == F.col(truth)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~b & a).alias("rescue"), F.count_if(b & ~a).alias("harm"),
        (F.count_if(~b & a) - F.count_if(b & ~a)).alias("net"))


def flips(df: DataFrame, base: str, alt: str, truth: str) -> DataFrame:
    """Rescues and harms per (from, to) prediction change."""
    c = df.where(F.col(base) != F.col(alt))
    return c.groupBy(F.col(base).alias("from_cls"), F.col(alt).alias("to_cls")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(alt) == F.col(truth)).alias("rescue"), F.count_if(F.col(base) == F.col(truth)).alias("harm"))


def class_prior(df: DataFrame, keys: Sequence[str], label: str, classes: int) -> DataFrame:
    """Share of every class per group, zeros kept (`keys`, `cls`, `prior`)."""
    n = df.groupBy(*keys).agg(*[F.count_if(F.col(label) == c).alias(f"_{c}") for c in range(classes)], F.count(F.lit(1)).alias("_n"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), (F.col(f"_{c}") / F.col("_n")).alias("prior")) for c in range(classes)]))
    return n.select(*keys, each.alias("_p")).select(*keys, "_p.cls", "_p.prior")


def others_prior(df: DataFrame, port: str, label: str, classes: int) -> DataFrame:
    """Share of every class over all other ports: totals minus own counts (`port`, `cls`, `prior`), one pass over the rows."""
    own = df.groupBy(port).agg(*[F.count_if(F.col(label) == c).alias(f"_{c}") for c in range(classes)], F.count(F.lit(1)).alias("_n"))
    total = own.agg(*[F.sum(c).alias(f"t{c}") for c in own.columns if c != port])
    j = own.join(F.broadcast(total))  # one row
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), ((F.col(f"t_{c}") - F.col(f"_{c}")) / (F.col("t_n") - F.col("_n"))).alias("prior")) for c in range(classes)]))
    return j.select(port, each.alias("_p")).select(port, "_p.cls", "_p.prior")


def prior_distance(p: DataFrame, q: DataFrame, keys: Sequence[str], eps: float = 1e-9) -> DataFrame:
    """Total variation and KL(p || q) of two priors over the same keys, entropy of p."""
    j = p.join(q.withColumnRenamed("prior", "_q"), [*keys, "cls"])
    a, b = F.col("prior"), F.col("_q")
    return j.groupBy(*keys).agg(
        (0.5 * F.sum(F.abs(a - b))).alias("tv"), F.sum(F.when(a > 0, a * F.log(a / F.greatest(b, F.lit(eps)))).otherwise(0.0)).alias("kl"),
        F.sum(F.when(a > 0, -a * F.log(a)).otherwise(0.0)).alias("entropy"))


def auc(df: DataFrame, keys: Sequence[str], score: str, label: Column) -> DataFrame:
    """Mann-Whitney AUC of a boolean label, ties sharing the mean rank."""
    d = df.withColumn("_pos", label.cast("long"))
    r = value_ranks(d, keys, score, {"pos": F.col("_pos")})
    g = r.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("avg_rank")).alias("_s"), F.max("tot_pos").alias("positives"), F.max("n").alias("n"))
    p, neg = F.col("positives"), F.col("n") - F.col("positives")
    return g.select(*keys, "n", "positives", F.when((p > 0) & (neg > 0), (F.col("_s") - p * (p + 1) / 2) / (p * neg)).alias("auc"))


def correlations(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Pearson and Spearman correlation (ties share ranks)."""
    r = with_average_rank(with_average_rank(df, keys, a, "_ra"), keys, b, "_rb")
    return r.groupBy(*keys).agg(F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"), F.count(F.lit(1)).alias("n"))


def mutual_information(dims: DataFrame, target: str, bins: int = 16, d: str = "d", x: str = "x") -> DataFrame:
    """Information between each dimension, cut at its quantiles, and the target, over the entropy of the target."""
    q = quantiles(dims, [d], x, {f"q{i}": i / bins for i in range(1, bins)} | {"top": 1.0}).drop("n")
    edges = F.array(*[f"q{i}" for i in range(1, bins)])
    q = q.select(d, F.filter(edges, lambda e: e < F.col("top")).alias("_edges"))
    b = dims.where(F.col(x).isNotNull()).join(F.broadcast(q), d).select(
        d, target, F.size(F.filter("_edges", lambda e: e <= F.col(x))).alias("_b"))
    j = b.groupBy(d, "_b", target).agg(F.count(F.lit(1)).alias("n"))
    w = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    j = j.withColumns({"nb": w(d, "_b"), "nt": w(d, target), "nd": w(d)})
    p = F.col("n") / F.col("nd")
    mi = j.groupBy(d).agg(F.sum(p * F.log(p / (F.col("nb") / F.col("nd") * F.col("nt") / F.col("nd")))).alias("mi"))
    h = j.select(d, target, "nt", "nd").distinct().groupBy(d).agg(F.sum(-(F.col("nt") / F.col("nd")) * F.log(F.col("nt") / F.col("nd"))).alias("h"))
    return mi.join(h, d).select(d, "mi", (F.col("mi") / F.col("h")).alias("mi_share"))


def dim_class_entropy(dims: DataFrame, cls: str, classes: int, min_n: int = 200, d: str = "d", x: str = "x") -> DataFrame:
    """Class entropy (over log C) of the rows where a dimension is active, and of its top quartile; null below `min_n` rows."""
    act = dims.where(F.col(x) != 0)
    q = quantiles(act, [d], x, {"q75": 0.75})
    a = act.join(F.broadcast(q.select(d, "q75")), d)

    def ent(rows, name):
        c = rows.groupBy(d, cls).agg(F.count(F.lit(1)).alias("n"))
        c = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(d)))
        return c.groupBy(d).agg((F.sum(-F.col("p") * F.log("p")) / F.log(F.lit(float(classes)))).alias(name), F.sum("n").alias("_n")).select(
            d, F.when(F.col("_n") >= min_n, F.col(name)).alias(name))

    top = ent(a.where(F.col(x) >= F.col("q75")), "h_top")
    return q.select(d, "n").join(ent(a, "h_present"), d, "left").join(top, d, "left").withColumn("h_top", F.when(F.col("n") >= min_n, F.col("h_top")))


def sharing(dims: DataFrame, entropies: DataFrame, key: str, d: str = "d", x: str = "x") -> DataFrame:
    """Mean, least and largest top-quartile entropy over the active dimensions of a row."""
    j = dims.where(F.col(x) != 0).join(F.broadcast(entropies.where("h_top is not null").select(d, "h_top")), d)
    return j.groupBy(key).agg(F.avg("h_top").alias("share_mean"), F.min("h_top").alias("share_min"), F.max("h_top").alias("share_max"))


def variance_components(df: DataFrame, port: str, product: str, truth: str, base: str, alt: str, min_port: int = 10, min_product: int = 5, min_products: int = 3) -> DataFrame:
    """Gains (in points) between and within ports: observed, sampling and remaining variance."""
    gain = (F.col(alt) == F.col(truth)).cast("int") - (F.col(base) == F.col(truth)).cast("int")
    d = df.withColumn("_g", gain)

    def level(keys, least):
        return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (100 * F.avg("_g")).alias("g"), (10000 * F.var_samp("_g") / F.count(F.lit(1))).alias("se2")).where(F.col("n") >= least)

    ports = level([port], min_port)
    prods = level([port, product], min_product).join(ports.select(port), port, "left_semi")
    a = ports.agg(F.var_samp("g").alias("port_observed"), F.avg("se2").alias("port_noise"), F.count(F.lit(1)).alias("ports"))
    b = prods.agg(F.var_samp("g").alias("product_observed"), F.avg("se2").alias("product_noise"), F.count(F.lit(1)).alias("products"))
    c = prods.groupBy(port).agg(F.count(F.lit(1)).alias("k"), F.var_samp("g").alias("v"), F.avg("se2").alias("s")).where(F.col("k") >= min_products)
    c = c.agg(F.avg("v").alias("within_observed"), F.avg("s").alias("within_noise"))
    left = lambda o, s: F.greatest(F.lit(0.0), F.col(o) - F.col(s))
    # three one-row frames
    return a.crossJoin(b).crossJoin(c).withColumns({
        "port_real": left("port_observed", "port_noise"), "within_real": left("within_observed", "within_noise")})


def within_group_percentile(df: DataFrame, keys: Sequence[str], value: str, key: str, out: str = "pct") -> DataFrame:
    """(rank - 1) / (n - 1) within the group, ties by id."""
    r = running(df, keys, [F.col(value), F.col(key)])
    return r.withColumn(out, (F.col("rn") - 1) / F.greatest(F.lit(1), F.col("n") - 1)).drop("rn", "n")


def group_scores(dims: DataFrame, groups: DataFrame, key: str, port: str, d: str = "d", x: str = "x") -> DataFrame:
    """Mean within-port percentile of named groups of dimensions (`groups`: name, d) per sample."""
    p = within_group_percentile(dims.join(F.broadcast(groups.select(d).distinct()), d, "left_semi").select(key, port, d, x), [port, d], x, key)
    return p.join(F.broadcast(groups), d).groupBy(key, "name").agg(F.avg("pct").alias("score"))


def group_score_auc(scores: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """AUC of each group score for rescue and for harm among samples whose outcome changed. outcomes(key, outcome +1/-1)."""
    j = scores.join(outcomes.where("outcome <> 0"), key)
    r = auc(j, ["name"], "score", F.col("outcome") > 0).select("name", "n", F.col("auc").alias("auc_rescue"))
    h = auc(j, ["name"], "score", F.col("outcome") < 0).select("name", F.col("auc").alias("auc_harm"))
    return r.join(h, "name")


def quartile_rates(scores: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Rescue and harm rates in the lowest and highest quartile of each score."""
    j = scores.join(outcomes.where("outcome <> 0"), key)
    q = quantiles(j, ["name"], "score", {"q1": 0.25, "q3": 0.75}).drop("n")
    s = j.join(q, "name").withColumn("quartile", F.when(F.col("score") <= F.col("q1"), "low").when(F.col("score") >= F.col("q3"), "high")).where("quartile is not null")
    return s.groupBy("name", "quartile").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("outcome") > 0).cast("int")).alias("rescue_rate"), F.avg((F.col("outcome") < 0).cast("int")).alias("harm_rate"))


def ks_distance(dims: DataFrame, port: str, ports: Sequence, d: str = "d", x: str = "x") -> DataFrame:
    """Mean over dimensions of the two-sample KS statistic, each port against the rest."""
    cols = {f"p{i}": (F.col(port) == p).cast("long") for i, p in enumerate(ports)}
    r = value_ranks(dims, [d], x, cols)
    upto = F.col("avg_rank") + (F.col("c") - 1) / 2
    each = []
    for i, p in enumerate(ports):
        inside, total = F.col(f"below_p{i}") + F.col(f"p{i}"), F.col(f"tot_p{i}")
        each.append(F.struct(F.lit(p).alias(port), F.abs(inside / total - (upto - inside) / (F.col("n") - total)).alias("gap")))
    k = r.select(d, F.explode(F.array(*each)).alias("_s")).select(d, "_s.*").groupBy(d, port).agg(F.max("gap").alias("ks"))
    return k.groupBy(port).agg(F.avg("ks").alias("ks"))


def criterion_check(episodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Whether a fold's worst or mean source-side gain tells its target gain.

    episodes(fold, q, gain), targets(fold, gain): both are per-port tables."""
    e = episodes.groupBy("fold").agg(F.min("gain").alias("worst"), F.avg("gain").alias("mean"))
    j = e.join(targets.withColumnRenamed("gain", "target"), "fold")
    long = j.select("fold", "target", F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("value")) for c in ("worst", "mean")])).alias("_c")).select("fold", "target", "_c.*")
    med = quantiles(long, ["criterion"], "value", {"median": 0.5}).drop("n")
    split = long.join(med, "criterion").groupBy("criterion").agg(
        F.avg(F.when(F.col("value") > F.col("median"), F.col("target"))).alias("gain_above"), F.avg(F.when(F.col("value") <= F.col("median"), F.col("target"))).alias("gain_below"))
    return correlations(long, ["criterion"], "value", "target").join(split, "criterion")


def dim_coverage(dims: DataFrame, label: str, d: str = "d", x: str = "x", digits: int = 6) -> DataFrame:
    """Candidates, valid, valid and labelled, distinct values and whether a dimension varies."""
    ok = F.col(x).isNotNull()
    return dims.groupBy(d).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(ok).alias("valid"), F.count_if(ok & F.col(label).isNotNull()).alias("valid_labelled"),
        F.countDistinct(F.round(x, digits)).alias("distinct_values")).withColumn("varies", F.col("distinct_values") > 1)


def dim_support_gate(dims: DataFrame, port: str, min_valid: int = 30, min_ports: int = 2, min_variance: float = 1e-4, d: str = "d", x: str = "x") -> DataFrame:
    """Dimensions with enough valid rows, ports and variance."""
    v = dims.where(F.col(x).isNotNull())
    return v.groupBy(d).agg(F.count(F.lit(1)).alias("valid"), F.countDistinct(port).alias("ports"), F.var_pop(x).alias("variance")).where(
        (F.col("valid") >= min_valid) & (F.col("ports") >= min_ports) & (F.col("variance") >= min_variance))


def impute_standardise(dims: DataFrame, port: str, targets: DataFrame, key: str = "id", d: str = "d", x: str = "x", eps: float = 1e-9) -> DataFrame:
    """Per fold (target port): null to the mean of the other ports, then centred and scaled by their moments.

    Moments of a fold are the totals minus the target's own, so the rows are read once."""
    m = dims.where(F.col(x).isNotNull()).groupBy(port, d).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))
    t = m.groupBy(d).agg(*[F.sum(c).alias("t_" + c) for c in "nsq"])
    folds = targets.select(F.col(port).alias("fold"))
    f = folds.join(F.broadcast(t)).join(m.select(F.col(port).alias("fold"), d, "n", "s", "q"), ["fold", d], "left")
    n, s, q = (F.col("t_" + c) - F.coalesce(F.col(c), F.lit(0)) for c in "nsq")
    mu = s / n
    sd = F.sqrt(F.greatest(F.lit(0.0), q / n - mu * mu))
    f = f.select("fold", d, mu.alias("mu"), F.when(sd < eps, 1.0).otherwise(sd).alias("sd"))
    # the target's own rows under its fold; `f` has one row per fold and dimension
    own = dims.withColumn("fold", F.col(port)).join(f, ["fold", d])
    return own.select(key, "fold", d, ((F.coalesce(F.col(x), F.col("mu")) - F.col("mu")) / F.col("sd")).alias("z"))
