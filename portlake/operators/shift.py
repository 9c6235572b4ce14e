"""Shift between domains: decomposition, profile similarity, neighbourhood density, energy distance, label shift."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.text import hash_key
from ..session import cut
from .selective import cap_per_group, hash_cap

BLOCK_ROWS = 2048
#: Blocks grow with the rows, so that a row is repeated a bounded number of times: at most so many blocks a port, or of all ports
#: beside one a port.  A tile is worked off in strips of `STRIP` rows.
PORT_BLOCKS, ALL_BLOCKS, STRIP = 8, 24, 512


def shift_decompose(source: DataFrame, target: DataFrame, fold: str, truth: str, source_pred: str, target_pred: str) -> DataFrame:
    """Source accuracy, source recalls weighted by the target's class shares, target accuracy, and the distance of the priors."""
    s = source.groupBy(fold, F.col(truth).alias("cls")).agg(F.count(F.lit(1)).alias("ns"), F.avg((F.col(source_pred) == F.col(truth)).cast("int")).alias("rs"))
    t = target.groupBy(fold, F.col(truth).alias("cls")).agg(F.count(F.lit(1)).alias("nt"), F.avg((F.col(target_pred) == F.col(truth)).cast("int")).alias("rt"))
    j = s.join(t, [fold, "cls"], "full").fillna(0)
    sums = j.groupBy(fold).agg(F.sum("ns").alias("S"), F.sum("nt").alias("T"))
    j = j.join(sums, fold)
    ps, pt = F.col("ns") / F.col("S"), F.col("nt") / F.col("T")
    return j.groupBy(fold).agg(
        F.sum(ps * F.col("rs")).alias("source_acc"), F.sum(pt * F.col("rs")).alias("label_shifted_acc"), F.sum(pt * F.col("rt")).alias("target_acc"),
        (0.5 * F.sum(F.abs(pt - ps))).alias("prior_tv"))


def pair_matrix(profiles: DataFrame, key: str, d: str, x: str, top: int = 10) -> DataFrame:
    """Cosine and Jaccard of the `top` largest entries between every two profiles (a small table of means)."""
    p = profiles.select(key, d, x)
    t = cap_per_group(p, [key], [F.col(x).desc(), F.col(d)], top).select(key, d, F.lit(1).alias("_t"))
    p = p.join(t, [key, d], "left").fillna({"_t": 0})
    q = p.select(F.col(key).alias("other"), d, F.col(x).alias("_y"), F.col("_t").alias("_u"))
    j = p.join(q, d).where(F.col(key) < F.col("other"))
    return j.groupBy(key, "other").agg(
        (F.sum(F.col(x) * F.col("_y")) / (F.sqrt(F.sum(F.col(x) * F.col(x))) * F.sqrt(F.sum(F.col("_y") * F.col("_y"))) + 1e-12)).alias("cosine"),
        (F.sum(F.col("_t") * F.col("_u")) / F.sum(F.greatest("_t", "_u"))).alias("jaccard"))


def mean_shift(df: DataFrame, port: str, value: str) -> DataFrame:
    """Per target port: subtract its own mean, add the mean of the other ports (sums once, totals minus own)."""
    m = df.select(port, F.posexplode(value).alias("d", "x")).groupBy(port, "d").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    t = m.groupBy("d").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    m = m.join(F.broadcast(t), "d").select(port, "d", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n")) - F.col("s") / F.col("n")).alias("m"))
    a = m.groupBy(port).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("_m"))
    return df.join(F.broadcast(a), port).withColumn(value, S.add(F.col(value), F.col("_m"))).drop("_m")


def neighbour_entropy(df: DataFrame, port: str, key: str, vector: str, temperature: float = 0.05, block: int = BLOCK_ROWS) -> DataFrame:
    """Mean entropy of the softmax over cosine neighbours per port.

    The measure compares every row with every other row of its port.  Rows are dealt into blocks of about `block`
    rows, `PORT_BLOCKS` at most; each pair of blocks is one task that returns two partial sums per row, never the pairs."""
    n = df.groupBy(port).agg(F.least(F.lit(PORT_BLOCKS), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(float(block))))).cast("int").alias("_k"))
    d = df.join(F.broadcast(n), port).select(port, key, vector, "_k", F.pmod(F.xxhash64(key), F.col("_k")).cast("int").alias("_b"))
    left = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).select(port, key, vector, F.col("_b").alias("_i"), F.col("_o").alias("_j"))
    right = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).select(
        F.col(port).alias("_rp"), F.col(key).alias("_rk"), F.col(vector).alias("_rv"), F.col("_o").alias("_ri"), F.col("_b").alias("_rj"))
    kt = dict(df.dtypes)

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({port: [], key: [], "z": [], "zs": []})
        unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
        p, q, ka, kb = unit(np.stack(a[vector].to_numpy())), unit(np.stack(b["_rv"].to_numpy())).T, a[key].to_numpy(), b["_rk"].to_numpy()
        diagonal = bool(np.isin(ka, kb).any())  # equal keys meet in the pair of a block with itself only
        z, zs = np.zeros(len(a)), np.zeros(len(a))
        for at in range(0, len(a), STRIP):
            s = p[at : at + STRIP] @ q / temperature
            e = np.exp(s)
            if diagonal:
                e[ka[at : at + STRIP, None] == kb[None, :]] = 0.0
            z[at : at + STRIP], zs[at : at + STRIP] = e.sum(1), np.einsum("ij,ij->i", e, s)
        return pd.DataFrame({port: a[port], key: a[key], "z": z, "zs": zs})

    parts = left.groupBy(port, "_i", "_j").cogroup(right.groupBy("_rp", "_ri", "_rj")).applyInPandas(
        tile, f"`{port}` {kt[port]}, `{key}` {kt[key]}, z double, zs double")
    r = parts.groupBy(port, key).agg(F.sum("z").alias("z"), F.sum("zs").alias("zs")).where("z > 0")
    return r.groupBy(port).agg(F.avg(F.log("z") - F.col("zs") / F.col("z")).alias("snd"))


def energy_distance(df: DataFrame, port: str, key: str, vector: str, cap: int | None = None, seed: str = "", block: int = BLOCK_ROWS) -> DataFrame:
    """Energy distance between every two ports over all their rows, or over `cap` rows a port in hash order if given.

    Rows are dealt into blocks of about `block` rows, larger ones if there would be more than `ALL_BLOCKS`; each pair of blocks is one task
    that returns a single sum of distances."""
    rows = hash_cap(df.select(port, key, vector), [port], key, cap, seed) if cap else df.select(port, key, vector)
    sizes = rows.groupBy(port).agg(F.count(F.lit(1)).alias("rows"))
    each = F.greatest(F.lit(float(block)), F.ceil(F.sum("rows").over(Window.partitionBy()) / ALL_BLOCKS))  # over one row a port
    blocks = cut(sizes.select(F.col(port).alias("p"), F.ceil(F.col("rows") / each).cast("int").alias("k")))
    dealt = rows.select(F.col(port).alias("p"), key, vector).join(blocks, "p").select("p", F.pmod(F.xxhash64(key), F.col("k")).cast("int").alias("i"), vector)
    each = blocks.select("p", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    one, two = each.toDF("a", "i"), each.toDF("b", "j")
    tiles = one.join(two, (F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("i") <= F.col("j"))))  # of blocks, not rows
    left = tiles.join(dealt.toDF("a", "i", vector), ["a", "i"]).select("a", "i", "b", "j", vector)
    right = tiles.join(dealt.toDF("b", "j", vector), ["b", "j"]).select(*[F.col(c).alias(f"_{c}") for c in "aibj"], F.col(vector).alias(vector))
    pt = dict(df.dtypes)[port]

    def tile(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"a": [], "b": [], "total": []})
        p, q = (np.stack(s[vector].to_numpy()).astype(float) for s in (x, y))
        pp, qq, total = (p * p).sum(1), (q * q).sum(1), 0.0
        for at in range(0, len(p), STRIP):
            total += np.sqrt(np.maximum(pp[at : at + STRIP, None] + qq[None, :] - 2 * p[at : at + STRIP] @ q.T, 0)).sum()
        a, i, b, j = key
        return pd.DataFrame({"a": [a], "b": [b], "total": [total * (2 if a == b and i != j else 1)]})

    sums = left.groupBy("a", "i", "b", "j").cogroup(right.groupBy("_a", "_i", "_b", "_j")).applyInPandas(tile, f"a {pt}, b {pt}, total double")
    sums = sums.groupBy("a", "b").agg(F.sum("total").alias("total"))
    size = lambda name, n: sizes.select(F.col(port).alias(name), F.col("rows").alias(n))
    mean = cut(sums.join(size("a", "na"), "a").join(size("b", "nb"), "b").select("a", "b", (F.col("total") / F.col("na") / F.col("nb")).alias("m")))
    own = mean.where("a = b")
    return mean.where("a < b").join(own.select("a", F.col("m").alias("ma")), "a").join(own.select("b", F.col("m").alias("mb")), "b").select(
        "a", "b", (2 * F.col("m") - F.col("ma") - F.col("mb")).alias("energy"))


def nonnegative_solve(a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Least squares with non-negative unknowns: grow the free set by the steepest gradient, step back to feasibility."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        grad = a.T @ (b - a @ x)
        grad[free] = -np.inf
        k = int(np.argmax(grad))
        if grad[k] <= 1e-12:
            break
        free[k] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (z[free] > 0).all():
                x = z
                break
            bad = free & (z <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x = x + step * (z - x)
            free &= x > 1e-14
            x[~free] = 0.0
            if not free.any():
                break
    return x


def estimate_prior(confusion: DataFrame, predicted: DataFrame, fold: str, classes: int, shrink: float = 0.0) -> DataFrame:
    """Class prior of the target per fold from source confusion counts and the target's predicted histogram.

    confusion(fold, truth, pred, n) and predicted(fold, pred, n) hold at most classes^2 rows per fold."""
    ft = dict(confusion.dtypes)[fold]
    u = confusion.select(fold, "truth", "pred", "n").unionByName(predicted.select(fold, F.lit(-1).alias("truth"), "pred", "n"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        c, h = np.zeros((classes, classes)), np.zeros(classes)
        for t, p, n in pdf[["truth", "pred", "n"]].itertuples(index=False):
            if t < 0:
                h[p] += n
            else:
                c[t, p] += n
        c = c / np.maximum(c.sum(1, keepdims=True), 1)
        c = (1 - shrink) * c + shrink * np.eye(classes)
        x = nonnegative_solve(c.T, h / max(h.sum(), 1))
        return pd.DataFrame({fold: pdf[fold].iloc[0], "cls": np.arange(classes), "prior": x / max(x.sum(), 1e-9)})

    return u.groupBy(fold).applyInPandas(solve, f"`{fold}` {ft}, cls int, prior double")


def prior_array(prior: DataFrame, fold: str, out: str, classes: int) -> DataFrame:
    """Long (fold, cls, prior) to one array per fold."""
    g = prior.groupBy(fold).agg(*[F.coalesce(F.max(F.when(F.col("cls") == c, F.col("prior"))), F.lit(0.0)).alias(f"_{c}") for c in range(classes)])
    return g.select(fold, F.array(*[f"_{c}" for c in range(classes)]).alias(out))


def reweight(p: Column, target: Column, source: Column) -> Column:
    """Posterior under new class shares, normalised."""
    w = F.zip_with(target, source, lambda t, s: F.greatest(t / F.greatest(s, F.lit(1e-6)), F.lit(1e-6)))
    return S.normalise(S.multiply(p, w))


def mixture_confidence(df: DataFrame, port: str, key: str, cls: str, vector: str, per_pair: int = 8, temperature: float = 0.05, seed: str = "m") -> DataFrame:
    """Confidence of mixed samples within against across predicted classes, per port.

    The mixes (at most `per_pair` per pair of classes, hash-chosen members) are few; one pass over the rows scores them."""
    members = cap_per_group(df, [port, cls], [hash_key(F.col(key), seed), F.col(key)], 2 * per_pair, keep="_m").select(port, cls, "_m", vector)
    a = members.where(F.col("_m") <= per_pair).select(port, F.col(cls).alias("ca"), F.col("_m").alias("r"), F.col(vector).alias("va"))
    b = members.select(port, F.col(cls).alias("cb"), F.when(F.col("_m") > per_pair, F.col("_m") - per_pair).otherwise(F.col("_m")).alias("r"), (F.col("_m") > per_pair).alias("second"), F.col(vector).alias("vb"))
    mix = a.join(b, [port, "r"]).where((F.col("ca") < F.col("cb")) & ~F.col("second") | (F.col("ca") == F.col("cb")) & F.col("second"))
    mix = mix.select(port, "ca", "cb", "r", F.zip_with("va", "vb", lambda x, y: 0.5 * x + 0.5 * y).alias("mv"))
    s = df.select(port, vector).join(F.broadcast(mix), port).select(port, "ca", "cb", "r", (S.dot(F.col("mv"), F.col(vector)) / temperature).alias("s"))
    m = s.groupBy(port, "ca", "cb", "r").agg(F.max("s").alias("top"), F.sum(F.exp("s")).alias("z")).withColumn("conf", F.exp("top") / F.col("z"))
    return m.groupBy(port).agg((F.avg(F.when(F.col("ca") == F.col("cb"), F.col("conf"))) - F.avg(F.when(F.col("ca") != F.col("cb"), F.col("conf")))).alias("mixval"))


def perturb_consistency(df: DataFrame, port: str, key: str, scores: str, sigma: float, reps: int, seed: str = "p") -> DataFrame:
    """Share of predictions that survive noise on the scores, scaled by each score's deviation in the port.

    Noise is a hash of (row, class, replicate) mapped to a normal variate, so every run draws the same."""
    e = df.select(port, key, F.posexplode(scores).alias("c", "x"))
    sd = e.groupBy(port, "c").agg(F.stddev_pop("x").alias("sd"))
    sd = sd.groupBy(port).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "sd"))), lambda s: s["sd"]).alias("_sd"))
    u = lambda i, tag: (F.pmod(F.xxhash64(F.lit(seed + tag), F.col(key), i, F.col("rep")), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    d = df.join(F.broadcast(sd), port).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    noise = F.transform(F.col("_sd"), lambda s, i: s * sigma * F.sqrt(-2.0 * F.log(u(i, "a"))) * F.cos(2.0 * np.pi * u(i, "b")))
    d = d.withColumn("_same", (S.argmax(S.add(F.col(scores), noise)) == S.argmax(F.col(scores))).cast("int"))
    return d.groupBy(port).agg(F.avg("_same").alias("consistency"))
