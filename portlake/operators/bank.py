"""Moment tests over a bank of heads: which heads agree with observed relations under one mechanism.

Frames: phi(sample, *keys, grp, block, d, phi) with phi null where unobserved; probs(sample, head, p array over classes);
relations(sample, mech, d, q array over classes).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import argmax, dot
from .metrics import balanced_accuracy

# fixed values: cell support, tolerance margin, floor and limits
MIN_CELL, MIN_BLOCKS = 64, 4
MARGIN, FLOOR, MIN_PORTS, UNINFORMATIVE = 0.02, 0.05, 4, 0.50
SLACK = 1e-12


def observed_moments(phi: DataFrame, keys: Sequence[str], group: str = "grp", min_cell: int = MIN_CELL, min_blocks: int = MIN_BLOCKS,
                     enabled: Column | None = None) -> DataFrame:
    """Mean of the observed relation per (group, dimension) with the reason a cell is not active."""
    g = phi.groupBy(*keys, group, "d").agg(
        F.avg("phi").alias("observed"), F.count("phi").alias("n"), F.countDistinct(F.when(F.col("phi").isNotNull(), F.col("block"))).alias("blocks"),
        F.avg(F.when(F.col("phi").isNotNull(), (F.abs("phi") < 1e-9).cast("int"))).alias("zero_share"))
    on = F.lit(True) if enabled is None else enabled
    reason = (
        F.when(~on, "disabled_by_source_support").when(F.col("n") < min_cell, "too_few_available_objects")
        .when(F.col("blocks") < min_blocks, "too_few_spatial_blocks").otherwise("active"))
    return g.withColumn("reason", reason).withColumn("active", F.col("reason") == "active")


def predicted_moments(phi: DataFrame, probs: DataFrame, relations: DataFrame, keys: Sequence[str], group: str = "grp") -> DataFrame:
    """Expected relation under every head and mechanism over exactly the rows whose relation was observed."""
    rows = phi.where(F.col("phi").isNotNull()).select("sample", *keys, group, "d")
    j = rows.join(relations, ["sample", "d"]).join(probs, "sample")
    return j.groupBy(*keys, group, "d", "head", "mech").agg(F.avg(dot(F.col("p"), F.col("q"))).alias("predicted"))


def moments(phi, probs, relations, keys, group="grp", min_cell=MIN_CELL, min_blocks=MIN_BLOCKS, enabled=None) -> DataFrame:
    """Observed next to predicted for every cell, head and mechanism."""
    o = observed_moments(phi, keys, group, min_cell, min_blocks, enabled)
    return predicted_moments(phi, probs, relations, keys, group).join(o, [*keys, group, "d"])


def _scores(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per head: the best mechanism's worst residual over all active cells (null without active cells)."""
    res = F.when(F.col("active"), F.abs(F.col("predicted") - F.col("observed")))
    worst = m.groupBy(*keys, "head", "mech").agg(F.max(res).alias("worst"))
    return worst.groupBy(*keys, "head").agg(F.min(F.struct("worst", "mech")).alias("b")).select(*keys, "head", F.col("b.worst").alias("score"), F.col("b.mech").alias("mechanism"))


def filter_bank(m: DataFrame, keys: Sequence[str], tau: float | Column) -> DataFrame:
    """Retained heads: one mechanism must fit all active cells within `tau`; if none fits, all stay and the conflict shows."""
    s = _scores(m, keys)
    t = F.lit(tau) if isinstance(tau, (int, float)) else tau
    s = s.withColumn("feasible", F.coalesce(F.col("score") <= t + SLACK, F.lit(False)))
    w = Window.partitionBy(*keys)
    any_ok, any_active = F.max("feasible").over(w), F.max(F.col("score").isNotNull()).over(w)
    status = F.when(~any_active, "no_active_knowledge").when(any_ok, "compatible").otherwise("mechanism_conflict")
    return s.withColumns({"status": status, "retained": F.col("feasible") | ~any_ok})


def dimension_filter(m: DataFrame, keys: Sequence[str], tau: float, dims: Column) -> DataFrame:
    """Ablation: the filter with only the moments of some dimensions, a condition on `d`."""
    return filter_bank(m.where(dims), keys, tau)


def group_mechanisms(m: DataFrame, keys: Sequence[str], group: str = "grp") -> DataFrame:
    """Ablation: each group takes the mechanism whose worst residual over all heads and active dimensions is smallest
    (the first on a tie, and where nothing is active)."""
    res = F.when(F.col("active"), F.abs(F.col("predicted") - F.col("observed")))
    worst = m.groupBy(*keys, group, "mech").agg(F.coalesce(F.max(res), F.lit(float("inf"))).alias("score"))
    return worst.groupBy(*keys, group).agg(F.min(F.struct("score", "mech")).alias("b")).select(
        *keys, group, F.col("b.mech").alias("mechanism"), F.when(F.col("b.score") < float("inf"), F.col("b.score")).alias("score"))


def single_best(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ablation: only the head with the smallest score (lowest head on a tie)."""
    return _scores(m, keys).where("score is not null").groupBy(*keys).agg(F.min(F.struct("score", "head")).alias("b")).select(*keys, "b.head", "b.score")


def calibrate_tau(m: DataFrame, port: str, anchor, margin: float = MARGIN, floor: float = FLOOR, min_ports: int = MIN_PORTS, uninformative: float = UNINFORMATIVE) -> DataFrame:
    """Tolerance from calibration ports: the largest of their best worst residuals under the anchor head, plus a margin."""
    s = _scores(m.where(F.col("head") == anchor), [port]).where("score is not null")
    g = s.agg(F.count(F.lit(1)).alias("n_ports"), F.max("score").alias("_m"))
    tau = F.when(F.col("n_ports") >= min_ports, F.greatest(F.lit(floor), F.col("_m") + margin))
    return g.select("n_ports", tau.alias("tau"), F.when(tau.isNull(), "calibration_unavailable").when(tau >= uninformative, "uninformative").otherwise("ready").alias("status"))


def ensemble_predict(probs: DataFrame, keep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, lower and upper envelope per class of the retained heads, and whether all of them agree.

    probs(sample, *keys, head, p); keep(*keys, head)."""
    k = probs.join(keep.select(*keys, "head"), [*keys, "head"])
    agree = k.groupBy("sample").agg((F.countDistinct(argmax(F.col("p"))) == 1).alias("unanimous"))
    e = k.select("sample", F.posexplode("p").alias("cls", "p")).groupBy("sample", "cls").agg(F.avg("p").alias("mean"), F.min("p").alias("lower"), F.max("p").alias("upper"))
    return e.join(agree, "sample")


#: Bytes of subset means that a task holds at a time.
HELD_BYTES = 32 << 20


def subset_sizes(heads: int) -> np.ndarray:
    """Heads in each subset, by mask."""
    return np.array([bin(m).count("1") for m in range(2**heads)])


def subset_picks(scores: np.ndarray) -> np.ndarray:
    """Argmax of the equal-weight mean of every subset: [mask, row] from scores[row, head, class]; mask 0 has none (-1).

    The sums of all subsets that a head ends follow from those without it, so each subset costs one addition."""
    rows, heads, classes = scores.shape
    sums = np.zeros((2**heads, rows, classes))
    for h in range(heads):
        sums[2**h : 2 ** (h + 1)] = sums[: 2**h] + scores[None, :, h]
    pick = np.round(sums / np.maximum(1, subset_sizes(heads))[:, None, None], 9).argmax(2)
    pick[0] = -1
    return pick


def _runs(batches, heads: int, truth: str, p: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(picks [mask, row], truths) of a bounded number of rows at a time; rows without scores have picks of -1."""
    for b in batches:
        y = np.array(b.column(truth).to_pylist(), object)
        has = b.column(p).is_valid().to_numpy(zero_copy_only=False)
        full = b.column(p).filter(b.column(p).is_valid())
        scores = full.flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(full), heads, -1) if len(full) else np.zeros((0, heads, 1))
        if not has.all():
            yield np.full((2**heads, int((~has).sum())), -1), y[~has]
        y, step = y[has], max(1, HELD_BYTES // (2**heads * scores.shape[2] * 8))
        for k in range(0, len(y), step):
            yield subset_picks(scores[k : k + step]), y[k : k + step]


def subset_oracle(samples: DataFrame, heads: int, key: str, truth: str, p: str = "ps") -> DataFrame:
    """Accuracy, balanced accuracy, rescues and harms of every subset against the full bank (evaluation only).

    A row goes through all subsets inside its task; one row per subset and class leaves it.  `p` is array<array<double>> by head."""
    full = 2**heads - 1
    kind = dict(samples.dtypes)[truth]

    def run(batches):
        held: dict = {}
        for pick, y in _runs(batches, heads, truth, p):
            for c in set(y.tolist()):
                ok = pick[:, y == c] == (-2 if c is None else c)
                base = ok[full]
                mine = held.setdefault(c, np.zeros((4, 2**heads), np.int64))
                mine += np.stack([np.full(2**heads, ok.shape[1]), ok.sum(1), (ok & ~base).sum(1), (~ok & base).sum(1)])
        for c, counts in held.items():
            yield pa.RecordBatch.from_pydict({"mask": np.arange(1, 2**heads, dtype=np.int32), "truth": pa.array([c] * full, pa.int32() if kind == "int" else pa.int64()), **dict(zip(("n", "ok", "r", "h"), counts[:, 1:]))})

    c = samples.select(truth, p).mapInArrow(run, f"mask int, truth {kind}, n long, ok long, r long, h long")
    c = c.groupBy("mask", "truth").agg(*[F.sum(x).alias(x) for x in ("n", "ok", "r", "h")])
    size = F.bit_count("mask").alias("size")
    return c.groupBy("mask", size).agg(
        (F.sum("ok") / F.sum("n")).alias("accuracy"), F.avg(F.col("ok") / F.col("n")).alias("ba"), F.sum("r").alias("rescue"), F.sum("h").alias("harm")).withColumn(
        "deployable", F.lit(False)).withColumn("is_full", F.col("mask") == full)


def oracle_summary(subsets: DataFrame) -> DataFrame:
    """Best subset by accuracy and by balanced accuracy (full bank, then the smaller mask, on a tie) and the most rescues at no harm."""
    pick = lambda c: F.min(F.struct((-F.col(c)).alias("neg"), (~F.col("is_full")).alias("nf"), "mask"))
    g = subsets.agg(pick("accuracy").alias("a"), pick("ba").alias("b"), F.max(F.when(F.col("harm") == 0, F.col("rescue"))).alias("rescue_without_harm"), F.count(F.lit(1)).alias("subsets"))
    return g.select(F.col("a.mask").alias("best_accuracy_mask"), (-F.col("a.neg")).alias("best_accuracy"), F.col("b.mask").alias("best_ba_mask"), (-F.col("b.neg")).alias("best_ba"), "rescue_without_harm", "subsets")


def union_ceiling(samples: DataFrame, heads: int, key: str, truth: str, p: str = "ps") -> DataFrame:
    """Share of samples some subset, or some single head, gets right; a task returns five numbers."""
    single = subset_sizes(heads) == 1

    def run(batches):
        total = np.zeros(5, np.int64)
        for pick, y in _runs(batches, heads, truth, p):
            ok = pick[1:] == np.array([-2 if c is None else c for c in y.tolist()])
            some, full = ok.any(0), ok[-1]
            total += [len(y), some.sum(), ok[single[1:]].any(0).sum(), full.sum(), (~full & ~some).sum()]
        if total[0]:
            yield pa.RecordBatch.from_pydict(dict(zip(("n", "any_subset", "any_head", "full", "beyond"), total[:, None])))

    c = samples.select(truth, p).mapInArrow(run, "n long, any_subset long, any_head long, full long, beyond long")
    return c.agg(*[(F.sum(x) / F.sum("n")).alias(x) for x in ("any_subset", "any_head", "full")], F.coalesce(F.sum("beyond"), F.lit(0)).alias("beyond_reach"))


def cell_report(m: DataFrame, keys: Sequence[str], group: str = "grp") -> DataFrame:
    """Per cell: observed, zero share, range and mean of predictions, spread over mechanisms and heads, worst residual."""
    cell = [*keys, group, "d"]
    h = m.groupBy(*cell, "head").agg((F.max("predicted") - F.min("predicted")).alias("r")).groupBy(*cell).agg(F.max("r").alias("spread_head"))
    k = m.groupBy(*cell, "mech").agg((F.max("predicted") - F.min("predicted")).alias("r")).groupBy(*cell).agg(F.max("r").alias("spread_mech"))
    g = m.groupBy(*cell).agg(
        F.first("observed").alias("observed"), F.first("n").alias("n"), F.first("reason").alias("reason"), F.first("zero_share").alias("zero_share"),
        F.min("predicted").alias("predicted_min"), F.max("predicted").alias("predicted_max"), F.avg("predicted").alias("predicted_mean"),
        F.max(F.abs(F.col("predicted") - F.col("observed"))).alias("worst_residual"))
    return g.join(h, cell).join(k, cell)


def head_disagreement(probs: DataFrame) -> DataFrame:
    """Share of samples two heads label differently, for every pair of heads."""
    a = probs.select("sample", F.col("head").alias("h1"), argmax(F.col("p")).alias("c1"))
    b = a.select("sample", F.col("h1").alias("h2"), F.col("c1").alias("c2"))
    return a.join(b, "sample").where("h1 < h2").groupBy("h1", "h2").agg(F.avg((F.col("c1") != F.col("c2")).cast("int")).alias("disagreement"))


def best_fixed_head(arms: DataFrame, port: str, truth: str) -> DataFrame:
    """Head with the best mean balanced accuracy over ports (lowest name on a tie). arms: port, truth, arm, pred."""
    b = balanced_accuracy(arms, [port, "arm"], truth, "pred").groupBy("arm").agg(F.avg("ba").alias("ba"))
    return b.agg(F.min(F.struct((-F.round("ba", 12)).alias("neg"), "arm")).alias("b")).select(F.col("b.arm").alias("arm"), (-F.col("b.neg")).alias("ba"))
