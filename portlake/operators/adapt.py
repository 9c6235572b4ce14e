"""Linear feature maps for all target ports at once, by gradients summed over all source rows.

A problem is a target port, a kind of map and two penalties.  It minimises the cross-entropy of a linear classifier on the mapped
rows of the other ports, plus what the map changes in the target's covariance and mean.  With Z = X M and residuals R the
gradients of the map and of the classifier both follow from X'R: d x classes numbers a problem are all that leaves a
task in a step.  The target enters by its mean and covariance alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .moments import Moments, small_enough, sufficient_stats

DIAGONAL, FULL = "diagonal", "full"
STEPS, MEMORY, FLAT = 60, 8, 1e-7


@dataclass
class Problem:
    """Parameters of one problem as a vector: the map, the classifier's weights [d, classes] and its intercepts."""

    target: int
    kind: str
    lam: float
    mu: float
    mean: np.ndarray
    cov: np.ndarray
    square: np.ndarray
    n: float
    classes: int
    x: np.ndarray = field(default=None)
    f: float = np.inf
    grad: np.ndarray = field(default=None)
    done: bool = False

    def __post_init__(self):
        d = len(self.mean)
        start = np.ones(d) if self.kind == DIAGONAL else np.eye(d).ravel()
        self.x = np.concatenate([start, np.zeros((d + 1) * self.classes)])
        # curvature along each parameter at the start: of the penalties for the map, of the classifier's loss for the rest
        var, square = np.diagonal(self.cov), self.square
        bend = 8 * self.lam * (np.outer(var, var) + self.cov**2) + 2 * self.mu * (self.mean**2)[:, None] + square[:, None] / self.classes
        bend = np.diagonal(bend) if self.kind == DIAGONAL else bend.ravel()
        spread = (1 - 1 / self.classes) / self.classes + 1e-3
        self.curve = np.concatenate([bend, np.repeat(square * spread, self.classes), np.full(self.classes, spread)]) + 1e-6

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Map [d, d], weights [d, classes], intercepts."""
        d = len(self.mean)
        m = d if self.kind == DIAGONAL else d * d
        matrix = np.diag(x[:m]) if self.kind == DIAGONAL else x[:m].reshape(d, d)
        return matrix, x[m : m + d * self.classes].reshape(d, self.classes), x[m + d * self.classes :]

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classifier in raw features."""
        m, w, b = self.split(x)
        return m @ w, b

    def whole(self, x: np.ndarray, loss: float, xr: np.ndarray, r: np.ndarray) -> tuple[float, np.ndarray]:
        """Objective and gradient, from the summed cross-entropy, X'R and the residuals' sum."""
        m, w, _ = self.split(x)
        loss, xr, r = loss / self.n, xr / self.n, r / self.n
        off, shift = m.T @ self.cov @ m - self.cov, m.T @ self.mean - self.mean
        by_map = xr @ w.T + self.lam * 4 * self.cov @ m @ off + self.mu * 2 * np.outer(self.mean, shift)
        by_map = np.diagonal(by_map) if self.kind == DIAGONAL else by_map.ravel()
        return loss + self.lam * (off**2).sum() + self.mu * (shift**2).sum(), np.concatenate([by_map, (m.T @ xr).ravel(), r])


class Descent:
    """Limited-memory quasi-Newton steps of one problem; each trial point is measured from outside."""

    def __init__(self, problem: Problem):
        self.p, self.pairs, self.step, self.way = problem, [], 1.0, None

    def trial(self) -> np.ndarray:
        p = self.p
        if p.grad is None or p.done:
            return p.x
        if self.way is None:
            q, left = p.grad.copy(), []
            for s, y, rho in reversed(self.pairs):
                a = rho * (s @ q)
                left.append(a)
                q -= a * y
            if self.pairs:
                s, y, _ = self.pairs[-1]
                q *= (s @ y) / (y @ (y / p.curve))
            q /= p.curve
            for (s, y, rho), a in zip(self.pairs, reversed(left)):
                q += (a - rho * (y @ q)) * s
            self.way, self.step = -q, 1.0
        return p.x + self.step * self.way

    def told(self, x: np.ndarray, f: float, grad: np.ndarray) -> None:
        p = self.p
        if p.grad is None:
            p.f, p.grad = f, grad
        elif f <= p.f + 1e-4 * self.step * (p.grad @ self.way):
            s, y = x - p.x, grad - p.grad
            if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
                self.pairs = [*self.pairs, (s, y, 1 / (s @ y))][-MEMORY:]
            p.done = p.f - f < FLAT * max(1.0, abs(f))
            p.x, p.f, p.grad, self.way = x, f, grad, None
        else:
            self.step /= 4
            if self.step < 1e-6:
                if self.pairs:
                    self.pairs, self.way = [], None  # once more along the gradient
                else:
                    p.done = True


def linear_maps(rows: DataFrame, port: str, truth: str, vector: str, grid: Sequence[tuple[float, float]], kinds: Sequence[str] = (DIAGONAL, FULL), steps: int = STEPS) -> DataFrame:
    """target, kind, lam, mu, m (map, row by row), w, b (classifier on mapped rows), classes, loss (mean cross-entropy of the source
    rows), objective, for every port, kind of map and (lam, mu).

    All labelled rows of the other ports count; a step is one pass over the rows for all problems.  Rows with a null port, label or vector
    are left out; a port without source rows elsewhere has no row here."""
    spark = rows.sparkSession
    t = dict(rows.dtypes)
    kind = f"target {t[port]}, kind string, lam double, mu double, m array<double>, w array<double>, b array<double>, classes array<{t[truth]}>, loss double, objective double"
    used = cut(rows.where(F.col(port).isNotNull() & F.col(truth).isNotNull() & F.col(vector).isNotNull()).select(F.col(port).alias("port"), F.col(truth).alias("cls"), F.col(vector).cast("array<double>").alias("v")))
    stats = sufficient_stats(used, "port", "cls", "v")
    moments = small_enough(stats, "s", "g")
    if moments.empty:
        return spark.createDataFrame([], kind)
    held = Moments(moments)
    problems = []
    for p in sorted(held.ports):
        _, n, s, g = held.only([p])
        rest = held.total[0].sum() - n.sum()
        if rest > 0.5:
            mean = s.sum(0) / n.sum()
            cov = (g.sum(0) - n.sum() * np.outer(mean, mean)) / max(1.0, n.sum() - 1)
            _, _, _, others = held.without([p])
            square = np.diagonal(others.sum(0)) / rest
            problems += [Problem(p, k, lam, mu, mean, cov, square, rest, len(held.cls)) for k in kinds for lam, mu in grid]
    schema = pa.schema([("problem", pa.int32()), ("place", pa.int32()), ("total", pa.float64())])
    place, d, many = held.place, held.d, len(held.cls)

    def measured(points: list[tuple]) -> dict[int, np.ndarray]:
        """For each problem (target, W, b): summed cross-entropy, X'R and the residuals' sum over the other ports' rows."""
        sent = spark.sparkContext.broadcast(points)

        def run(batches):
            sums = {k: np.zeros(1 + (d + 1) * many) for k, *_ in sent.value}
            for b in batches:
                if not len(b):
                    continue
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                y = np.array([place[c] for c in b.column("cls").to_pylist()])
                ports = np.array(b.column("port").to_pylist(), object)
                for k, target, w, bias in sent.value:
                    mine = np.flatnonzero(ports != target)
                    z = x[mine] @ w + bias
                    z -= z.max(1, keepdims=True)
                    e = np.exp(z)
                    total = e.sum(1, keepdims=True)
                    sums[k][0] += (np.log(total[:, 0]) - z[np.arange(len(mine)), y[mine]]).sum()
                    r = e / total
                    r[np.arange(len(mine)), y[mine]] -= 1
                    sums[k][1 : 1 + d * many] += (x[mine].T @ r).ravel()
                    sums[k][1 + d * many :] += r.sum(0)
            for k, v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], schema=schema)

        # classes x d numbers a problem
        got = used.mapInArrow(run, "problem int, place int, total double").groupBy("problem", "place").agg(F.sum("total").alias("total")).toPandas()
        sent.unpersist()
        out = {k: np.zeros(1 + (d + 1) * many) for k, *_ in points}
        for k, part in got.groupby("problem"):
            out[k][part["place"].to_numpy()] = part["total"].to_numpy()
        return out

    ways = [Descent(p) for p in problems]
    loss = [np.inf] * len(problems)
    for _ in range(steps + 1):
        open_ = [k for k, p in enumerate(problems) if not p.done]
        if not open_:
            break
        trials = {k: ways[k].trial() for k in open_}
        for k, v in measured([(k, problems[k].target, *problems[k].scores(x)) for k, x in trials.items()]).items():
            f, grad = problems[k].whole(trials[k], v[0], v[1 : 1 + d * many].reshape(d, many), v[1 + d * many :])
            ways[k].told(trials[k], f, grad)
            if problems[k].x is trials[k]:
                loss[k] = v[0] / problems[k].n
    plain = lambda v: v.item() if isinstance(v, np.generic) else v
    out = []
    for p, ce in zip(problems, loss):
        m, w, b = p.split(p.x)
        out.append((plain(p.target), p.kind, p.lam, p.mu, m.ravel().tolist(), w.ravel().tolist(), b.tolist(), [plain(c) for c in held.cls], float(ce), float(p.f)))
    return spark.createDataFrame(out, kind)
