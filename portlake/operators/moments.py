"""Additive moments per (port, class) and the linear models that follow from them.

One scan gives n, the sum of x and the sum of x x' for every (port, class), the latter as the packed upper triangle.  The
moments of a fold are the totals minus those of the ports it leaves out, so all folds, inner folds, penalties and feature
blocks share that scan.  A fold is a row of names: the moments themselves reach the tasks once, not once a fold.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# fixed values: covariance shrinkage and ridge of the aligners
SHRINKAGE = 0.05
ALIGN_RIDGE = 1e-6
MODEL_BYTES_LIMIT = 256 * 1024 * 1024
COMBINE_SALT = 64
HELD_GROUPS = 2048


def sufficient_stats(df: DataFrame, port: str, cls: str, vector: str) -> DataFrame:
    """`port`, `cls`, n, s (sum), g (sum of outer products, upper triangle row by row).

    Each task folds its batches into one row per (port, class); those rows are added up in two steps, so a port that
    fills many tasks is not gathered in one."""
    types = dict(df.dtypes)
    schema = f"port {types[port]}, cls {types[cls]}, salt int, n double, s array<double>, g array<double>"

    def fold(batches):
        acc: dict = {}
        salt = TaskContext.get().partitionId() % COMBINE_SALT
        rows = lambda: pd.DataFrame([(p, c, salt, n, s, pack(g)) for (p, c), (n, s, g) in acc.items()], columns=["port", "cls", "salt", "n", "s", "g"])
        for pdf in batches:
            if len(acc) > HELD_GROUPS:
                yield rows()
                acc.clear()
            if pdf.empty:
                continue
            x = np.stack(pdf[vector].to_numpy()).astype(float)
            codes, keys = pd.factorize(pd.MultiIndex.from_frame(pdf[[port, cls]]))
            for k, key in enumerate(keys):
                m = x[codes == k]
                n, s, g = acc.get(key, (0.0, 0.0, 0.0))
                acc[key] = (n + len(m), s + m.sum(0), g + m.T @ m)
        yield rows()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        return pd.DataFrame({"port": [first.port], "cls": [first.cls], "salt": [first.salt], "n": [pdf.n.sum()],
                             "s": [np.sum(np.stack(pdf.s.to_numpy()), 0)], "g": [np.sum(np.stack(pdf.g.to_numpy()), 0)]})

    part = df.select(port, cls, vector).mapInPandas(fold, schema)
    part = part.groupBy("port", "cls", "salt").applyInPandas(add, schema)
    return part.withColumn("salt", F.lit(0)).groupBy("port", "cls").applyInPandas(add, schema).drop("salt")


def pack(g: np.ndarray) -> np.ndarray:
    """Upper triangle of a symmetric matrix, row by row."""
    return g[np.triu_indices(len(g))]


def unpack(g, d: int) -> np.ndarray:
    """Symmetric matrices of `d` rows from their packed triangles (the last axis of `g`)."""
    g = np.asarray(g, float)
    i, j = np.triu_indices(d)
    out = np.empty((*g.shape[:-1], d, d))
    out[..., i, j] = g
    out[..., j, i] = g
    return out


def small_moments(df: DataFrame, keys: Sequence[str], vector: str, d: int) -> DataFrame:
    """The same moments as plain aggregates for few dimensions: n, s<i>, g<i>_<j>."""
    e = [F.element_at(vector, i + 1) for i in range(d)]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(e[i]).alias(f"s{i}") for i in range(d)],
        *[F.sum(e[i] * e[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)])


def fold_moments(stats: DataFrame, folds: DataFrame) -> DataFrame:
    """Moments of every fold as signed rows: class totals, and minus the ports the fold leaves out.

    folds(fold, target, leave_out array of ports).  Every fold receives classes x d x d / 2 numbers by the shuffle, so `on_folds`
    takes this way only where the moments are too large for the tasks' memory."""
    total = stats.groupBy("cls").applyInPandas(
        lambda p: pd.DataFrame({"cls": [p.cls.iloc[0]], "n": [p.n.sum()], "s": [np.sum(np.stack(p.s), 0)], "g": [np.sum(np.stack(p.g), 0)]}),
        f"cls {dict(stats.dtypes)['cls']}, n double, s array<double>, g array<double>")
    # both sides have a row per fold and class, no more
    plus = folds.select("fold", "target").join(total).withColumn("sign", F.lit(1.0))
    minus = folds.select("fold", "target", F.explode("leave_out").alias("port")).join(stats, "port").drop("port").withColumn("sign", F.lit(-1.0))
    return plus.unionByName(minus)


class Moments:
    """The moments of all ports in one task's memory; a fold's are the totals less what it leaves out."""

    def __init__(self, pdf: pd.DataFrame):
        self.cls = sorted(pdf.cls.unique())
        self.place = {c: k for k, c in enumerate(self.cls)}
        self.d = len(pdf.s.iloc[0])
        self.ports = {port: ([self.place[c] for c in rows.cls], rows.n.to_numpy(float), np.stack(rows.s.to_numpy()).astype(float), np.stack(rows.g.to_numpy()).astype(float)) for port, rows in pdf.groupby("port")}
        self.total = self._zero()
        for port in self.ports:
            self._add(self.total, port, 1.0)

    def _zero(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = len(self.cls)
        return np.zeros(k), np.zeros((k, self.d)), np.zeros((k, self.d * (self.d + 1) // 2))

    def _add(self, to: tuple, port, sign: float) -> None:
        if port in self.ports:
            at, *parts = self.ports[port]
            for whole, part in zip(to, parts):
                whole[at] += sign * part

    def only(self, ports: Sequence) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """The same of some ports alone."""
        held = self._zero()
        for port in set(ports):
            self._add(held, port, 1.0)
        return _with_extra(self.cls, *held, ())

    def without(self, leave_out: Sequence, extra: Sequence[tuple] = ()) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Classes, n[C], s[C, d], g[C, d, d] of a fold (classes without rows dropped); `extra` adds signed (class, n, s, g)."""
        cls, (n, s, g) = self.cls, [x.copy() for x in self.total]
        for port in set(leave_out):
            self._add((n, s, g), port, -1.0)
        return _with_extra(cls, n, s, g, extra)


def _with_extra(cls: list, n, s, g, extra: Sequence[tuple]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Signed rows added to packed moments, classes without rows dropped, triangles unpacked."""
    held = {c: [n[k], s[k], g[k]] for k, c in enumerate(cls)}
    for c, m, t, q, sign in extra:
        mine = held.setdefault(c, [0.0, 0.0, 0.0])
        held[c] = [mine[0] + sign * m, mine[1] + sign * np.asarray(t, float), mine[2] + sign * np.asarray(q, float)]
    kept = [c for c in sorted(held) if held[c][0] > 0.5]
    if not kept:
        return [], np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0, 0))
    s = np.stack([held[c][1] for c in kept])
    return kept, np.array([held[c][0] for c in kept]), s, unpack(np.stack([held[c][2] for c in kept]), s.shape[1])


def on_folds(stats: DataFrame, folds: DataFrame, fn: Callable, schema: str, extra: DataFrame | None = None, limit: int = 0, left: bool = False) -> DataFrame:
    """`fn(fold, target, classes, n, s, g)` -> rows, for every fold; with `left`, also the same four of what the fold leaves out.

    The moments number ports x classes x d x d / 2, whatever the rows and the folds; once Spark has found that they keep within
    the limit they go to all tasks, and a fold in the shuffle is its names only.  Beyond it each fold gets its signed rows.
    `extra`: signed moment rows of a fold (fold, target, cls, n, s, g, sign), for example of pseudo-labelled target rows."""
    spark = stats.sparkSession
    stats = cut(stats)
    size = stats.agg(F.sum((F.size("s") + F.size("g")) * 8)).first()[0] or 0
    if not size:
        return spark.createDataFrame([], schema)
    more = lambda pdf: [(r.cls, r.n, r.s, r.g, r.sign) for r in pdf.itertuples()]
    if size > (limit or MODEL_BYTES_LIMIT):
        signed = fold_moments(stats, folds)
        signed = signed if extra is None else signed.unionByName(extra)

        def one(p: pd.DataFrame) -> pd.DataFrame:
            out = [_with_extra([], [], [], [], more(p[p.sign < 0].assign(sign=1.0)))] if left else []
            return fn(p.fold.iloc[0], p.target.iloc[0], *_with_extra([], [], [], [], more(p)), *out)

        return signed.groupBy("fold").applyInPandas(one, schema)
    held = spark.sparkContext.broadcast(Moments(stats.toPandas()))
    if extra is None:
        def run(batches):
            for b in batches:
                for f in b.itertuples():
                    yield fn(f.fold, f.target, *held.value.without(f.leave_out), *([held.value.only(f.leave_out)] if left else []))

        return folds.select("fold", "target", "leave_out").repartition("fold").mapInPandas(run, schema)

    def both(mine: pd.DataFrame, added: pd.DataFrame) -> pd.DataFrame:
        first = (mine if len(mine) else added).iloc[0]
        if len(mine):
            return fn(first.fold, first.target, *held.value.without(first.leave_out, more(added)))
        return fn(first.fold, first.target, *_with_extra([], [], [], [], more(added)))

    return folds.groupBy("fold").cogroup(extra.groupBy("fold")).applyInPandas(both, schema)


def lopo(stats: DataFrame) -> DataFrame:
    """One fold per port, leaving it out."""
    return stats.select("port").distinct().select(F.col("port").cast("string").alias("fold"), F.col("port").alias("target"), F.array("port").alias("leave_out"))


def inner_folds(stats: DataFrame) -> DataFrame:
    """One fold per (p, q): both left out, q evaluated; the fold is named `p|q`."""
    a = stats.select(F.col("port").alias("p")).distinct()
    b = a.withColumnRenamed("p", "q")
    return a.join(b, F.col("p") != F.col("q")).select(F.concat_ws("|", "p", "q").alias("fold"), F.col("q").alias("target"), F.array("p", "q").alias("leave_out"))


def scale_of(n, s, g, eps: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation over all rows of a fold."""
    mu = s.sum(0) / n.sum()
    sd = np.sqrt(np.maximum(np.diagonal(g.sum(0)) / n.sum() - mu * mu, 0.0))
    return mu, np.where(sd < eps, 1.0, sd)


class Ridge:
    """One-against-rest targets of +-1, classes weighted equally, over the moments of a fold; one scaled system for all arms."""

    def __init__(self, n, s, g, standardise: bool):
        d = s.shape[1]
        self.mu, self.sd = scale_of(n, s, g) if standardise else (np.zeros(d), np.ones(d))
        mu = self.mu
        zs = (s - n[:, None] * mu) / self.sd
        zg = (g - mu[None, :, None] * s[:, None, :] - s[:, :, None] * mu[None, None, :] + n[:, None, None] * np.outer(mu, mu)) / np.outer(self.sd, self.sd)
        w = n.sum() / (len(n) * n)
        total = (w * n).sum()
        self.xbar = (w[:, None] * zs).sum(0) / total
        self.gram = (w[:, None, None] * zg).sum(0) - total * np.outer(self.xbar, self.xbar)
        self.ybar = (2 * w * n - total) / total
        self.xy = 2 * w[:, None] * zs - (w[:, None] * zs).sum(0) - total * self.ybar[:, None] * self.xbar
        self.inverse: dict[float, np.ndarray] = {}

    def fit(self, alpha: float, dims: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Weights [C, d] in raw features, 0 outside `dims`, and intercepts [C].

        Leaving out one dimension takes a row and a column off the inverse of the whole system, which is found once a penalty."""
        d = len(self.xbar)
        keep = np.arange(d) if dims is None else np.asarray(list(dims))
        coef = np.zeros((len(self.xy), d))
        if len(keep) >= d - 1:
            if alpha not in self.inverse:
                self.inverse[alpha] = np.linalg.inv(self.gram + alpha * np.eye(d))
            inverse = self.inverse[alpha]
            coef = self.xy @ inverse
            for out in np.setdiff1d(np.arange(d), keep):
                coef = coef - np.outer(coef[:, out] / inverse[out, out], inverse[out])
                coef[:, out] = 0.0
        else:
            coef[:, keep] = np.linalg.solve(self.gram[np.ix_(keep, keep)] + alpha * np.eye(len(keep)), self.xy[:, keep].T).T
        b = self.ybar - coef @ self.xbar
        return coef / self.sd, b - (coef / self.sd) @ self.mu


def fit_ridge(stats: DataFrame, folds: DataFrame, arms: Sequence[tuple[str, float, Sequence[int] | None]], standardise: bool = True,
              extra: DataFrame | None = None, limit: int = 0) -> DataFrame:
    """Models (fold, target, arm, cls, w over all dimensions, b) for every fold and arm (name, alpha, dimensions or all).

    `extra`: signed moment rows to add to a fold (for example pseudo-labelled target rows)."""
    def solve(fold, target, cls, n, s, g) -> pd.DataFrame:
        system = Ridge(n, s, g, standardise) if len(cls) else None
        out = []
        for name, alpha, dims in arms if system else ():
            w, b = system.fit(alpha, dims)
            out += [(fold, target, name, c, w[i], b[i]) for i, c in enumerate(cls)]
        return pd.DataFrame(out, columns=["fold", "target", "arm", "cls", "w", "b"])

    t = dict(stats.dtypes)
    return on_folds(stats, folds, solve, f"fold string, target {t['port']}, arm string, cls {t['cls']}, w array<double>, b double", extra, limit)


def small_enough(df: DataFrame, *arrays: str) -> pd.DataFrame:
    """The rows of `df`, once Spark has found that their arrays keep within the limit."""
    df = cut(df)
    size = df.agg(F.sum(sum((F.size(a) for a in arrays), F.lit(0)) * 8)).first()[0] or 0
    if size > MODEL_BYTES_LIMIT:
        raise ValueError(f"models take {size} bytes, more than a broadcast may; fit fewer folds or arms at a time")
    return df.toPandas()


def collect_models(models: DataFrame) -> dict:
    """Models by target: {target: [(fold, arm, classes, W, b)]}. Size is folds x arms x classes x dimensions, and checked."""
    pdf = small_enough(models, "w")
    out: dict = {}
    for (target, fold, arm), rows in pdf.groupby(["target", "fold", "arm"], sort=True):
        rows = rows.sort_values("cls")
        out.setdefault(target, []).append((fold, arm, rows.cls.to_numpy(), np.stack(rows.w.to_numpy()), rows.b.to_numpy()))
    return out


def score(df: DataFrame, models: DataFrame, port: str, key: str, vector: str, keep: Sequence[str] = (), classes: int | None = None) -> DataFrame:
    """Scores of each row under every model whose target is its port: (`key`, kept, fold, arm, scores, pred)."""
    held = df.sparkSession.sparkContext.broadcast(collect_models(models))
    t = dict(df.dtypes)
    keep = list(keep)
    schema = ", ".join([f"`{c}` {t[c]}" for c in [key, *keep]]) + ", fold string, arm string, scores array<double>, pred int"

    def run(batches):
        for pdf in batches:
            for p, rows in pdf.groupby(port):
                x = np.stack(rows[vector].to_numpy()).astype(float)
                for fold, arm, cls, w, b in held.value.get(p, []):
                    z = x @ w.T + b
                    full = np.full((len(x), classes or int(cls.max()) + 1), -1e9)
                    full[:, cls] = z
                    out = rows[[key, *keep]].copy()
                    out["fold"], out["arm"], out["scores"], out["pred"] = fold, arm, list(full), cls[z.argmax(1)].astype(int)
                    yield out

    return df.select(key, port, vector, *[c for c in keep if c != port]).mapInPandas(run, schema)


def recall_counts(df: DataFrame, models: DataFrame, port: str, truth: str, vector: str, edit: Callable | None = None) -> DataFrame:
    """Rows and hits per (fold, arm, truth): the models are applied inside the tasks and only counts leave them.

    `edit(x, arm)` may change the features before scoring (for example replace a dimension)."""
    held = df.sparkSession.sparkContext.broadcast(collect_models(models))
    t = dict(df.dtypes)

    def run(batches):
        acc: dict = {}
        for pdf in batches:
            for p, rows in pdf.groupby(port):
                x, y = np.stack(rows[vector].to_numpy()).astype(float), rows[truth].to_numpy()
                for fold, arm, cls, w, b in held.value.get(p, []):
                    xe = x if edit is None else edit(x, arm)
                    ok = cls[(xe @ w.T + b).argmax(1)] == y
                    for c in np.unique(y):
                        k = acc.setdefault((fold, arm, c), [0, 0])
                        k[0] += int((y == c).sum())
                        k[1] += int(ok[y == c].sum())
        yield pd.DataFrame([(*k, *v) for k, v in acc.items()], columns=["fold", "arm", "truth", "n", "ok"])

    c = df.select(port, truth, vector).mapInPandas(run, f"fold string, arm string, truth {t[truth]}, n bigint, ok bigint")
    return c.groupBy("fold", "arm", "truth").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))


def intervention_counts(df: DataFrame, models: DataFrame, port: str, truth: str, vector: str, other: str, name: str, keys: Sequence[str] = (), joint: bool = False) -> DataFrame:
    """Rows and hits per (`keys`, what, truth) when one dimension after the other is taken from the vector `other`.

    A changed dimension adds (new - old) * weight to the scores, so no changed vector is built.  `what` is
    `name`_d for dimension d, and with `joint` also `name`_all for all of them at once."""
    held = df.sparkSession.sparkContext.broadcast(collect_models(models))
    t, keys = dict(df.dtypes), list(keys)

    def run(batches):
        acc: dict = {}
        for pdf in batches:
            for at, rows in pdf.groupby([port, *keys]):
                x, new, y = np.stack(rows[vector].to_numpy()).astype(float), np.stack(rows[other].to_numpy()).astype(float), rows[truth].to_numpy()
                there, n = np.unique(y, return_inverse=True)
                for _, _, cls, w, b in held.value.get(at[0], []):
                    z = x @ w.T + b
                    arms = [(f"{name}_{d}", z + (new[:, d] - x[:, d])[:, None] * w[:, d]) for d in range(x.shape[1])]
                    for what, scores in [*arms, (f"{name}_all", new @ w.T + b)] if joint else arms:
                        ok = np.bincount(n, cls[scores.argmax(1)] == y, len(there))
                        for c, rows_, hits in zip(there, np.bincount(n), ok):
                            k = acc.setdefault((*at[1:], what, c), [0, 0])
                            k[0] += int(rows_)
                            k[1] += int(hits)
        yield pd.DataFrame([(*k, *v) for k, v in acc.items()], columns=[*keys, "what", "truth", "n", "ok"])

    kind = ", ".join([*[f"`{k}` {t[k]}" for k in keys], f"what string, truth {t[truth]}, n bigint, ok bigint"])
    c = df.select(port, truth, vector, other, *keys).mapInPandas(run, kind)
    return c.groupBy(*keys, "what", "truth").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))


def ba_of_counts(counts: DataFrame, keys: Sequence[str] = ("fold", "arm")) -> DataFrame:
    """Balanced accuracy, accuracy and rows from recall counts."""
    return counts.groupBy(*keys).agg(F.avg(F.col("ok") / F.col("n")).alias("ba"), (F.sum("ok") / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))


def tune_alpha(df: DataFrame, stats: DataFrame, port: str, truth: str, vector: str, alphas: Sequence[float]) -> DataFrame:
    """Per target port the penalty with the best mean balanced accuracy over inner ports (smaller on a tie)."""
    models = fit_ridge(stats, inner_folds(stats), [(str(a), a, None) for a in alphas])
    b = ba_of_counts(recall_counts(df, models, port, truth, vector)).withColumn("p", F.split_part("fold", F.lit("|"), F.lit(1)))
    m = b.groupBy("p", "arm").agg(F.avg("ba").alias("ba"))
    return m.groupBy("p").agg(F.min(F.struct((-F.round("ba", 12)).alias("neg"), F.col("arm").cast("double").alias("alpha"))).alias("b")).select(
        "p", "b.alpha", (-F.col("b.neg")).alias("inner_ba"))


def fit_pca(stats: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """Leading axes of each fold's training covariance: (fold, target, axis, variance, share, v, mean)."""
    def axes(fold, target, cls, n, s, g):
        mu = s.sum(0) / n.sum()
        cov = (g.sum(0) - n.sum() * np.outer(mu, mu)) / (n.sum() - 1)
        val, vec = np.linalg.eigh(cov)
        o = np.argsort(-val)[:k]
        v = vec[:, o] * np.sign(vec[np.abs(vec[:, o]).argmax(0), o])
        return pd.DataFrame([(fold, target, i, val[j], val[j] / val.sum(), v[:, i], mu) for i, j in enumerate(o)],
                            columns=["fold", "target", "axis", "variance", "share", "v", "mean"])

    t = dict(stats.dtypes)["port"]
    return on_folds(stats, folds, axes, f"fold string, target {t}, axis int, variance double, share double, v array<double>, mean array<double>")


def root_pair(side: str, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric square root of a covariance and its inverse.

    A direction whose spread is lost in rounding next to the widest one makes the inverse meaningless and is refused."""
    axes, spread, _ = np.linalg.svd(cov, hermitian=True)
    flat = np.flatnonzero(spread < spread[0] * len(spread) * np.finfo(float).eps)
    if len(flat):
        raise ValueError(f"{len(flat)} of {len(spread)} directions of the {side} rows have no spread; raise the ridge")
    deviation = np.sqrt(spread)
    return axes * deviation @ axes.T, axes / deviation @ axes.T


def coral(stats: DataFrame, direction: str = "t2s", ridge: float = ALIGN_RIDGE) -> DataFrame:
    """Per port, the map that gives one side's rows the other side's mean and covariance.

    t2s moves the port's rows into the frame of the other ports, s2t the other way round.
    (target, origin_mean, destination_mean, m flattened, residual of the covariances)."""
    def mean_cov(n, s, g):
        mu = s / n
        return mu, (g - n * np.outer(mu, mu)) / (n - 1) + ridge * np.eye(len(mu))

    def align(fold, target, cls, n, s, g, left) -> pd.DataFrame:
        rest, own = (n.sum(), s.sum(0), g.sum(0)), tuple(x.sum(0) for x in left[1:])
        (mo, co), (md, cd) = [mean_cov(*side) for side in ((own, rest) if direction == "t2s" else (rest, own))]
        m = root_pair("origin", co)[1] @ root_pair("destination", cd)[0]  # whiten, then colour
        res = np.linalg.norm(m.T @ co @ m - cd) / np.linalg.norm(cd)
        return pd.DataFrame({"target": [target], "origin_mean": [mo], "destination_mean": [md], "m": [m.ravel()], "residual": [res]})

    return on_folds(stats, lopo(stats), align, f"target {dict(stats.dtypes)['port']}, origin_mean array<double>, destination_mean array<double>, m array<double>, residual double", left=True)


def apply_maps(df: DataFrame, maps: DataFrame, port: str, vector: str, own: bool = True) -> DataFrame:
    """Move each row by the map of its port (`own`), or by every other port's map (adds `target`)."""
    pdf = small_enough(maps, "m")
    held = df.sparkSession.sparkContext.broadcast({r.target: (np.asarray(r.origin_mean, float), np.asarray(r.destination_mean, float), np.asarray(r.m, float).reshape(len(r.origin_mean), -1)) for r in pdf.itertuples()})
    t = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {t[c]}" for c in df.columns) + f", target {t[port]}"

    def run(batches):
        for b in batches:
            for p, rows in b.groupby(port):
                x = np.stack(rows[vector].to_numpy()).astype(float)
                for target, (mo, md, m) in held.value.items():
                    if (target == p) == own:
                        out = rows.copy()
                        out[vector], out["target"] = list((x - mo) @ m + md), target
                        yield out

    return df.mapInPandas(run, schema)


def precision_models(stats: DataFrame, folds: DataFrame, centred: bool, diagonal: bool = False, shrink: float = SHRINKAGE) -> DataFrame:
    """Class means and shrunk inverse covariance per fold: pooled over all rows, or around the class means."""
    def fit(fold, target, cls, n, s, g):
        d = s.shape[1]
        mu = s / n[:, None]
        if centred:
            cov = (g.sum(0) - np.einsum("c,ci,cj->ij", n, mu, mu)) / n.sum()
        else:
            m = s.sum(0) / n.sum()
            cov = g.sum(0) / n.sum() - np.outer(m, m)
        cov = np.diag(np.diagonal(cov)) if diagonal else cov
        cov = (1 - shrink) * cov + shrink * np.trace(cov) / d * np.eye(d)
        return pd.DataFrame([(fold, target, c, mu[i], n[i], np.linalg.inv(cov).ravel()) for i, c in enumerate(cls)], columns=["fold", "target", "cls", "mu", "n", "precision"])

    t = dict(stats.dtypes)
    return on_folds(stats, folds, fit, f"fold string, target {t['port']}, cls {t['cls']}, mu array<double>, n double, precision array<double>")


def class_distances(df: DataFrame, models: DataFrame, port: str, key: str, vector: str, keep: Sequence[str] = ()) -> DataFrame:
    """Squared distance of each row to the class means of its port's fold: (`key`, kept, classes, d2 array)."""
    pdf = small_enough(models, "mu", "precision")
    held = {}
    for target, rows in pdf.groupby("target"):
        rows = rows.sort_values("cls")
        d = len(rows.mu.iloc[0])
        held[target] = (rows.cls.tolist(), np.stack(rows.mu.to_numpy()), np.asarray(rows.precision.iloc[0], float).reshape(d, d))
    held = df.sparkSession.sparkContext.broadcast(held)
    t = dict(df.dtypes)
    cols = [key, *keep]
    schema = ", ".join(f"`{c}` {t[c]}" for c in cols) + ", classes array<int>, d2 array<double>"

    def run(batches):
        for b in batches:
            for p, rows in b.groupby(port):
                if p not in held.value:
                    continue
                cls, mu, prec = held.value[p]
                x = np.stack(rows[vector].to_numpy()).astype(float)
                diff = x[:, None, :] - mu[None, :, :]
                d2 = np.einsum("ncd,de,nce->nc", diff, prec, diff)
                out = rows[cols].copy()
                out["classes"], out["d2"] = [cls] * len(x), list(d2)
                yield out

    return df.select(*dict.fromkeys([*cols, port, vector])).mapInPandas(run, schema)


def novelty(distances: DataFrame) -> DataFrame:
    """Distance to the nearest class mean (larger is more novel)."""
    return distances.withColumn("novelty", F.sqrt(F.greatest(F.lit(0.0), F.array_min("d2"))))


def class_distinctiveness(distances: DataFrame, truth: str, port: str) -> DataFrame:
    """Own distance minus the nearest other class's distance, mean per class and port (negative: well separated)."""
    pos = F.array_position("classes", F.col(truth))
    own = F.element_at("d2", pos.cast("int"))
    other = F.array_min(F.filter("d2", lambda _, i: i != pos - 1))
    d = distances.where(pos > 0)
    return d.groupBy(port, F.col(truth).alias("cls")).agg(F.avg(F.sqrt(F.greatest(own, F.lit(0.0))) - F.sqrt(F.greatest(other, F.lit(0.0)))).alias("distinctiveness"), F.count(F.lit(1)).alias("n"))


def pseudo_moments(scored: DataFrame, vectors: DataFrame, key: str, port: str, vector: str, margin: str, share: float) -> DataFrame:
    """Signed moment rows of each port's most confident rows under their predicted class, to add to that port's fold."""
    from .selective import by_score

    top = by_score(scored.select(key, port, "pred", margin), [port], margin, key)
    top = top.where(F.col("rn") <= F.greatest(F.lit(1), F.floor(share * F.col("n")))).select(key, port, "pred").join(vectors.select(key, vector), key)
    m = sufficient_stats(top, port, "pred", vector)
    return m.select(F.col("port").cast("string").alias("fold"), F.col("port").alias("target"), "cls", "n", "s", "g", F.lit(1.0).alias("sign"))


def source_subsets(stats: DataFrame, sizes: Sequence[int], seed: str = "") -> DataFrame:
    """Folds that train on the first k other ports in hash order: fold `port:k`, everything else left out."""
    from ..functions.text import hash_key
    from ..ordered import running

    p = stats.select("port").distinct()
    q = p.withColumnRenamed("port", "src")
    r = running(p.join(q, F.col("port") != F.col("src")), ["port"], [hash_key(F.concat_ws(":", "port", "src"), seed), F.col("src")])
    k = r.withColumn("k", F.explode(F.array(*[F.lit(s) for s in sizes]))).where(F.col("k") <= F.col("n"))
    # ports are few: the list of left-out ports is part of the fold's definition
    out = k.groupBy("port", "k").agg(F.collect_list(F.when(F.col("rn") > F.col("k"), F.col("src"))).alias("o"))
    return out.select(F.concat_ws(":", "port", "k").alias("fold"), F.col("port").alias("target"), F.concat("o", F.array("port")).alias("leave_out"))


def regional_sources(stats: DataFrame, regions: DataFrame) -> DataFrame:
    """Folds that train only on ports of the target's region: fold `port:region`. regions(port, region)."""
    p = stats.select("port").distinct().join(regions, "port")
    q = p.select(F.col("port").alias("src"), F.col("region").alias("r2"))
    j = p.join(q).groupBy("port", "region").agg(F.collect_list(F.when((F.col("r2") != F.col("region")) | (F.col("src") == F.col("port")), F.col("src"))).alias("leave_out"))
    return j.select(F.concat_ws(":", "port", "region").alias("fold"), F.col("port").alias("target"), "leave_out")


def profile_gate(profiles: DataFrame, gains: DataFrame, alpha: float = 10.0) -> DataFrame:
    """Predicted gain of each port from its mean profile, ridge over the other ports. Per-port tables (port, v), (port, gain)."""
    j = profiles.join(gains, "port")
    t = dict(profiles.dtypes)["port"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("port")
        x, y = np.stack(pdf.v.to_numpy()).astype(float), pdf.gain.to_numpy()
        x = (x - x.mean(0)) / (x.std(0) + 1e-9)
        out = []
        for i in range(len(y)):
            m = np.arange(len(y)) != i
            xm, ym = x[m].mean(0), y[m].mean()
            w = np.linalg.solve((x[m] - xm).T @ (x[m] - xm) + alpha * np.eye(x.shape[1]), (x[m] - xm).T @ (y[m] - ym))
            out.append(float((x[i] - xm) @ w + ym))
        return pd.DataFrame({"port": pdf.port, "predicted_gain": out, "gain": y})

    return j.withColumn("_k", F.lit(0)).groupBy("_k").applyInPandas(fit, f"port {t}, predicted_gain double, gain double").withColumn("use_expert", F.col("predicted_gain") > 0)


def drop_one_arms(d: int, alpha: float) -> list[tuple[str, float, list[int]]]:
    return [("all", alpha, list(range(d)))] + [(f"drop_{i}", alpha, [j for j in range(d) if j != i]) for i in range(d)]


def single_arms(d: int, alpha: float) -> list[tuple[str, float, list[int]]]:
    return [(f"only_{i}", alpha, [i]) for i in range(d)]


def block_arms(blocks: Mapping[str, Sequence[int]], alphas: Sequence[float]) -> list[tuple[str, float, list[int]]]:
    return [(f"{n}@{a}", a, list(b)) for n, b in blocks.items() for a in alphas]
