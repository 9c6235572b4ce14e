"""Gates by boosted trees, fitted for all folds at once.

Every fold leaves out one port, or two where an inner episode chooses the threshold of a target.  The folds share the bins of the
features, so a level of all trees of all folds is one Spark job: tasks add up gradients by (fold, node, feature, bin), of the
smaller child of each split only, and the other child is its parent less that one.  Rows carry the sums of the trees so
far, one number a fold, written once a round.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# fixed values: rounds, depth, step, leaf size of the gates, weight of a harm
ROUNDS, DEPTH, RATE, LEAST, HARM_WEIGHT = 20, 4, 0.1, 20, 2.0
RIDGE, BINS = 1.0, 64
TAUS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
#: A gain has to differ by more than this share to count as larger; sums come in any order.
_SAME = 1e-9


@dataclass
class Tree:
    """Splits of a tree in heap order: children of node i are 2 i + 1 and 2 i + 2; a feature of -1 ends a branch."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            f = self.feature[at]
            on = f >= 0
            if not on.any():
                return at
            step = bins[rows, np.maximum(f, 0)] > self.limit[at]
            at = np.where(on, 2 * at + 1 + step, at)


@dataclass
class Gates:
    """Trees of all folds; a fold is the tuple of places of the ports it leaves out."""

    ports: list
    columns: list[str]
    edges: list[np.ndarray]
    folds: list[tuple[int, ...]]
    start: np.ndarray
    trees: list[list[Tree]] = field(default_factory=list)

    def binned(self, values: np.ndarray) -> np.ndarray:
        """Bins of feature columns; a value that is no number has the last one."""
        out = np.empty(values.shape, np.uint8)
        for f, edges in enumerate(self.edges):
            out[:, f] = np.searchsorted(edges, values[:, f], "left")
        return out

    def margin(self, bins: np.ndarray, fold: int) -> np.ndarray:
        out = np.full(len(bins), self.start[fold])
        for tree in self.trees[fold] if self.trees else ():
            out += tree.value[tree.leaves(bins)]
        return out

    def probability(self, bins: np.ndarray, fold: int) -> np.ndarray:
        return sigmoid(self.margin(bins, fold))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def best_split(hist: np.ndarray, ridge: float, least: float) -> tuple[float, int, int]:
    """(gain, feature, limit) of a node's best split from hist[feature, bin, (g, h, n)]; feature -1 if none helps.

    Of equal gains the first feature and the lowest limit count."""
    left = np.cumsum(hist, 1)[:, :-1]
    whole = hist[0].sum(0)
    right = whole - left
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + ridge)
    gain = np.where((left[..., 2] >= least - 0.5) & (right[..., 2] >= least - 0.5), worth(left) + worth(right) - worth(whole), -np.inf)
    top = gain.max() if gain.size else -np.inf
    if not top > _SAME * max(1.0, abs(worth(whole))):
        return 0.0, -1, 0
    f, b = np.argwhere(gain >= top - _SAME * abs(top))[0]
    return float(gain[f, b]), int(f), int(b)


class Growing:
    """The trees of one round, level by level; the children of a split get their values from its sums."""

    def __init__(self, folds: int, depth: int):
        size = 2 ** (depth + 1) - 1
        self.trees = [Tree(np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size)) for _ in range(folds)]
        self.hist: dict[tuple[int, int], np.ndarray] = {}
        #: (fold, node) whose sums the next job brings.
        self.wanted: list[tuple[int, int]] = [(k, 0) for k in range(folds)]

    def grow(self, sums: dict[tuple[int, int], np.ndarray], rate: float, ridge: float, least: float) -> None:
        """Take the sums that were wanted, close or split their nodes and the siblings', and name the next ones wanted."""
        nodes = dict(sums)
        for k, node in list(sums):
            if node:
                twin, parent = node + 1 if node % 2 else node - 1, (node - 1) // 2
                nodes[k, twin] = self.hist[k, parent] - sums[k, node]
        self.hist, self.wanted = {}, []
        for (k, node), hist in sorted(nodes.items()):
            whole, tree = hist[0].sum(0), self.trees[k]
            if node == 0:
                tree.value[0] = -rate * whole[0] / (whole[1] + ridge)
            _, f, b = best_split(hist, ridge, least)
            if f >= 0:
                tree.feature[node], tree.limit[node] = f, b
                self.hist[k, node] = hist
                left = hist[f, : b + 1].sum(0)
                for child, part in ((2 * node + 1, left), (2 * node + 2, whole - left)):
                    tree.value[child] = -rate * part[0] / (part[1] + ridge)
                self.wanted.append((k, 2 * node + (1 if 2 * left[2] <= whole[2] else 2)))


def _weights(rows: DataFrame, place: dict, label: str, weight: str | None, balance: str | None, folds: list[tuple[int, ...]], port: str) -> tuple[np.ndarray, np.ndarray, dict]:
    """Start of each fold, factor of each (fold, class), and the classes' places: from counts per (port, class)."""
    w = F.col(weight) if weight else F.lit(1.0)
    cls = F.col(balance) if balance else F.lit(0)
    # a row for each port and class
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(port).alias("p"), cls.alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w * F.col(label)).alias("one"), F.sum(w).alias("w")).collect()
    classes = {c: k for k, c in enumerate(sorted({r["c"] for r in counts}))}
    n, one, all_ = (np.zeros((len(place), max(1, len(classes)))) for _ in range(3))
    for r in counts:
        at = place[r["p"]], classes[r["c"]]
        n[at], one[at], all_[at] = r["n"], r["one"], r["w"]
    start, factor = np.zeros(len(folds)), np.ones((len(folds), n.shape[1]))
    for k, out in enumerate(folds):
        keep = [p for p in range(len(place)) if p not in out]
        m = n[keep].sum(0)
        if balance:
            factor[k] = m.sum() / np.maximum(1, (m > 0).sum() * m)
        a, b = (one[keep].sum(0) * factor[k]).sum(), (all_[keep].sum(0) * factor[k]).sum()
        share = min(max(a / b, 1e-6), 1 - 1e-6) if b > 0 else 0.5
        start[k] = np.log(share / (1 - share))
    return start, factor, classes


def fit_gates(rows: DataFrame, port: str, columns: Sequence[str], label: str, weight: str | None = None, balance: str | None = None, inner: bool = True,
              rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = RIDGE, least: int = LEAST) -> Gates:
    """Boosted logistic trees for every port left out, and with `inner` for every pair of ports left out.

    A row teaches the folds that do not leave out its port, with `weight`, and times the inverse frequency of its class `balance` in the
    fold; a row with a null label teaches none.  Missing features fall in the last bin."""
    spark, columns = rows.sparkSession, list(columns)
    ports = sorted(r[0] for r in rows.where(F.col(port).isNotNull()).select(port).distinct().collect())  # ports are few: they are the folds
    place = {p: k for k, p in enumerate(ports)}
    folds = [(k,) for k in range(len(ports))] + (list(combinations(range(len(ports)), 2)) if inner else [])
    steps = [k / bins for k in range(1, bins)]
    cuts = rows.agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c).cast("double")), steps, 10_000).alias(c) for c in columns]).first()
    edges = [np.unique(np.array(cuts[c] if cuts[c] else [], float)) for c in columns]
    start, factor, classes = _weights(rows, place, label, weight, balance, folds, port)
    gates = Gates(ports, columns, edges, folds, start, [[] for _ in folds])
    outside = np.array([[p not in out for out in folds] for p in range(len(ports))]).reshape(len(ports), len(folds))
    taught = rows.where(F.col(label).isNotNull() & F.col(port).isNotNull()).select(
        F.col(port).alias("p"), (F.col(balance) if balance else F.lit(0)).alias("c"), F.col(label).cast("double").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), *[F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(columns)])
    kind = "p int, c int, y double, w double, bins binary, margin binary"
    schema = pa.schema([("p", pa.int32()), ("c", pa.int32()), ("y", pa.float64()), ("w", pa.float64()), ("bins", pa.binary()), ("margin", pa.binary())])
    width, many = len(columns), len(folds)

    def prepare(batches):
        for b in batches:
            x = np.column_stack([b.column(f"f{k}").to_numpy(zero_copy_only=False) for k in range(width)]) if width else np.zeros((len(b), 0))
            data = gates.binned(np.where(np.isnan(x), np.inf, x))
            yield pa.RecordBatch.from_arrays([
                pa.array([place[p] for p in b.column("p").to_pylist()], pa.int32()), pa.array([classes[c] for c in b.column("c").to_pylist()], pa.int32()), b.column("y"), b.column("w"),
                pa.array([r.tobytes() for r in data], pa.binary()), pa.array([start.tobytes()] * len(b), pa.binary())], schema=schema)

    state = cut(taught.mapInArrow(prepare, kind))
    sums_schema = pa.schema([("fold", pa.int32()), ("node", pa.int32()), ("place", pa.int32()), ("g", pa.float64()), ("h", pa.float64()), ("n", pa.float64())])

    def parsed(b):
        return (b.column("p").to_numpy(), b.column("c").to_numpy(), b.column("y").to_numpy(), b.column("w").to_numpy(),
                np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(len(b), width), np.frombuffer(b"".join(b.column("margin").to_pylist()), np.float64).reshape(len(b), many))

    def level(trees: list[Tree], wanted: list[tuple[int, int]]) -> dict:
        sent = spark.sparkContext.broadcast((trees, wanted))

        def run(batches):
            trees, wanted = sent.value
            held = {at: np.zeros((width * bins, 3)) for at in wanted}
            by_fold: dict[int, list[int]] = {}
            for k, node in wanted:
                by_fold.setdefault(k, []).append(node)
            for b in batches:
                if not len(b):
                    continue
                p, c, y, w, data, margin = parsed(b)
                for k, nodes in by_fold.items():
                    at = trees[k].leaves(data)
                    use = np.flatnonzero(outside[p, k] & np.isin(at, nodes))
                    q = sigmoid(margin[use, k])
                    wk = w[use] * factor[k, c[use]]
                    g, h = wk * (q - y[use]), wk * q * (1 - q)
                    for node in nodes:
                        here = at[use] == node
                        spot = (np.arange(width) * bins + data[use[here]]).ravel()
                        for j, v in enumerate((g[here], h[here], np.ones(here.sum()))):
                            held[k, node][:, j] += np.bincount(spot, np.repeat(v, width), width * bins)
            for (k, node), hist in held.items():
                some = np.flatnonzero(hist[:, 2])
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(np.full(len(some), node), pa.int32()), pa.array(some, pa.int32()), *[pa.array(hist[some, j]) for j in range(3)]], schema=sums_schema)

        # a row for each fold, node, feature and bin
        got = state.mapInArrow(run, "fold int, node int, place int, g double, h double, n double").groupBy("fold", "node", "place").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()
        out = {at: np.zeros((width * bins, 3)) for at in wanted}
        for (k, node), part in got.groupby(["fold", "node"]):
            out[k, node][part["place"].to_numpy()] = part[["g", "h", "n"]].to_numpy()
        sent.unpersist()
        return {at: hist.reshape(width, bins, 3) for at, hist in out.items()}

    for _ in range(rounds if width and ports else 0):
        new = Growing(many, depth)
        for _ in range(depth):  # the leaves' values follow from their parents' sums
            if new.wanted:
                new.grow(level(new.trees, new.wanted), rate, ridge, least)
        for k, tree in enumerate(new.trees):
            gates.trees[k].append(tree)
        trees = spark.sparkContext.broadcast(new.trees)

        def step(batches, trees=trees):
            for b in batches:
                data, margin = parsed(b)[4:]
                after = margin + np.column_stack([t.value[t.leaves(data)] for t in trees.value])
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([r.tobytes() for r in after], pa.binary())], schema=schema)

        state = cut(state.mapInArrow(step, kind))
    return gates


def _features(b, columns: Sequence[str]) -> np.ndarray:
    x = np.column_stack([b.column(f"_f{k}").to_numpy(zero_copy_only=False) for k in range(len(columns))]) if columns else np.zeros((len(b), 0))
    return np.where(np.isnan(x), np.inf, x)


def score_gates(rows: DataFrame, gates: Gates, port: str, key: str, keep: Sequence[str] = (), out: str = "gate") -> DataFrame:
    """`key`, kept columns and the probability of a benefit from the trees that leave out the row's port; null for an unknown port."""
    held = rows.sparkSession.sparkContext.broadcast(gates)
    place = {p: k for k, p in enumerate(gates.ports)}
    names = list(dict.fromkeys([key, port, *keep]))
    t = dict(rows.dtypes)

    def run(batches):
        for b in batches:
            p = np.array([place.get(v, -1) for v in b.column(port).to_pylist()], np.int64)
            data = held.value.binned(_features(b, gates.columns))
            score = np.full(len(b), np.nan)
            for k in np.unique(p[p >= 0]).tolist():
                score[p == k] = held.value.probability(data[p == k], k)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(score, mask=p < 0)], names=[*names, out])

    made = rows.select(*names, *[F.col(c).cast("double").alias(f"_f{k}") for k, c in enumerate(gates.columns)])
    return made.mapInArrow(run, ", ".join([*[f"`{n}` {t[n]}" for n in names], f"`{out}` double"]))


def inner_taus(rows: DataFrame, gates: Gates, port: str, truth: str, base: str, expert: str, taus: Sequence[float] = TAUS) -> DataFrame:
    """For each target port the threshold with the best mean balanced accuracy over its inner episodes (the smaller one of equals).

    An episode of target p is another port q, scored by the trees that saw neither; only counts leave the tasks."""
    held = rows.sparkSession.sparkContext.broadcast(gates)
    place = {p: k for k, p in enumerate(gates.ports)}
    pair = {out: k for k, out in enumerate(gates.folds) if len(out) == 2}
    t = dict(rows.dtypes)
    kind = f"target {t[port]}, episode {t[port]}, tau double, truth {t[truth]}, n long, ok long"

    def run(batches):
        acc: dict = {}
        for b in batches:
            p = np.array([place.get(v, -1) for v in b.column(port).to_pylist()], np.int64)
            data = held.value.binned(_features(b, gates.columns))
            y, one, two = (np.array(b.column(c).to_pylist(), object) for c in (truth, base, expert))
            for q in np.unique(p[p >= 0]).tolist():
                mine = np.flatnonzero(p == q)
                for target in range(len(gates.ports)):
                    if (fold := pair.get((min(q, target), max(q, target)))) is None:
                        continue
                    score = held.value.probability(data[mine], fold)
                    for tau in taus:
                        ok = np.where(score > tau, two[mine], one[mine]) == y[mine]
                        for c in set(y[mine].tolist()) - {None}:
                            k = acc.setdefault((gates.ports[target], gates.ports[q], tau, c), [0, 0])
                            k[0] += int((y[mine] == c).sum())
                            k[1] += int(ok[y[mine] == c].sum())
        if acc:
            yield pa.RecordBatch.from_pylist([dict(zip(("target", "episode", "tau", "truth", "n", "ok"), (*k, *v))) for k, v in acc.items()], schema=_arrow(t[port], t[truth]))

    made = rows.where(F.col(port).isNotNull()).select(*dict.fromkeys([port, truth, base, expert]), *[F.col(c).cast("double").alias(f"_f{k}") for k, c in enumerate(gates.columns)])
    counts = made.mapInArrow(run, kind).groupBy("target", "episode", "tau", "truth").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
    ba = counts.groupBy("target", "episode", "tau").agg(F.avg(F.col("ok") / F.col("n")).alias("ba")).groupBy("target", "tau").agg(F.avg("ba").alias("ba"))
    best = ba.groupBy("target").agg(F.min(F.struct((-F.round("ba", 12)).alias("neg"), "tau")).alias("b"))
    return best.select(F.col("target").alias(port), F.col("b.tau").alias("tau"), (-F.col("b.neg")).alias("inner_ba"))


def _arrow(port: str, truth: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([("target", kinds[port]), ("episode", kinds[port]), ("tau", pa.float64()), ("truth", kinds[truth]), ("n", pa.int64()), ("ok", pa.int64())])
