"""Centroids and curve search against brute force, on awkward rows, ties and large numbers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from portlake.llm import centroids, curves

SCHEMA = "vec_id long, embedding array<double>, label int, digest string, cluster int, v string, rank int"


def vectors(spark, rows):
    """With extra columns whose names the operators use."""
    return spark.createDataFrame([(i, v, 1, "clash", 7, "clash", 3) for i, v in rows], SCHEMA).repartition(3)


def brute_clusters(rows, k, rounds, dims):
    """The definition in Python's integers."""
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v: min(range(len(centers)), key=lambda j: (far(v, centers[j]), j))
    for _ in range(rounds):
        mine = [best(v) for _, v in kept]
        for j in range(len(centers)):
            rows_ = [v for (_, v), b in zip(kept, mine) if b == j]
            if rows_:
                centers[j] = [sum(c) // len(rows_) for c in zip(*rows_)]
    out = [(i, best(v), far(v, centers[best(v)])) for i, v in kept]
    total = {j: sum(d for _, b, d in out if b == j) for j in range(len(centers))}
    fit = lambda v: v if v < 1 << 63 else None
    every = None if any(fit(d) is None for _, _, d in out) else fit(sum(total.values()))
    own = {j: None if any(fit(d) is None for _, b, d in out if b == j) else fit(t) for j, t in total.items()}
    text = {j: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for j, c in enumerate(centers)}
    return sorted(((i, b, fit(d), own[b], every, text[b]) for i, b, d in out), key=repr)


def clustered(df, **more):
    return sorted((tuple(r) for r in centroids.cluster(df, **more).collect()), key=repr)


def mixed_rows(dims, n, seed):
    """Clusters, exact copies, ties, ids that repeat or are null, and rows that take no part."""
    rng = np.random.default_rng(seed)
    heart = rng.normal(size=(4, dims))
    rows = [(i, (heart[i % 4] + 0.1 * rng.normal(size=dims)).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(n // 3)]  # a third of the rows is one vector
    rows += [(5, rows[7][1]), (5, rows[7][1]), (None, rows[3][1]), (900, [0.0] * dims), (901, [-0.0] * dims)]
    rows += [(1000, None), (1001, []), (1002, [1.0] * (dims - 1)), (1003, [math.nan] + [1.0] * (dims - 1)), (1004, [math.inf] * dims), (1005, [None] * dims), (1006, [1.0] * (dims + 1))]
    return rows


def test_clusters_equal_the_definition(spark):
    rows = mixed_rows(8, 120, 1)
    assert clustered(vectors(spark, rows), k=9, rounds=3, dims=8) == brute_clusters(rows, 9, 3, 8)


@pytest.mark.parametrize("scale", [1e4, 3e5, 1e9, 1e30, 1e300])
def test_clusters_stay_exact_with_large_components(spark, scale):
    rows = [(i, [x * scale for x in v] if v and all(x is not None for x in v) else v) for i, v in mixed_rows(4, 24, 2)]
    assert clustered(vectors(spark, rows), k=5, rounds=2, dims=4) == brute_clusters(rows, 5, 2, 4)


def test_few_rows_and_none(spark):
    rows = [(3, [0.5, 0.25]), (4, [0.5, 0.25]), (8, [-3.0, 1.0])]
    assert clustered(vectors(spark, rows), k=40, dims=2) == brute_clusters(rows, 40, 5, 2)
    assert clustered(vectors(spark, [(1, None), (2, [1.0])]), dims=2) == []
    assert clustered(vectors(spark, []), dims=2) == []


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(3)
    for size in (1, 50, 10_000):
        rows, centers = np.round(rng.normal(size=(300, 16)) * size).astype(np.int64), np.round(rng.normal(size=(20, 16)) * size).astype(np.int64)
        rows[:20] = centers
        pivots = centroids.Pivots(centers[:8])
        low = pivots.bounds(pivots.far(rows), pivots.far(centers))
        assert (low <= centroids.squares(rows, centers)).all()
        assert (low[:8, :8] == 0).diagonal().all()


def test_pivots_spare_distances_between_clusters():
    rng = np.random.default_rng(4)
    heart = rng.normal(size=(10, 32)) * 1000
    rows = np.concatenate([h + rng.normal(size=(100, 32)) for h in heart]).astype(np.int64)
    centers = heart.astype(np.int64)
    pivots = centroids.Pivots(centers[:8])
    best, least, measured = centroids.nearest(rows, pivots.far(rows), centers, pivots)
    assert (best == np.repeat(np.arange(10), 100)).all() and (least == centroids.squares(rows, centers).min(1)).all()
    assert measured < 2000  # of 10,000


def brute_neighbours(rows, k, every):
    """All pairs, by row: rows that repeat id and vector are one."""
    ok = {(i, tuple(x + 0.0 for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for i, q in ok:
        if i % every == 0:
            near = sorted((distance(q, v), j) for j, v in ok if len(v) == len(q) and (j, v) != (i, q))[:k]
            out += [(i, r + 1, j, d) for r, (d, j) in enumerate(near)]
    return sorted(out)


def distance(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def found(df, **more):
    return sorted(tuple(r) for r in curves.neighbours(df, **more).collect())


def test_neighbours_equal_brute_force_on_awkward_rows(spark):
    rows = mixed_rows(6, 200, 5) + [(10, [2.0] * 5), (11, [1.0] * 5), (20, [1e200] * 6), (21, [-1e200] * 6)]
    assert found(vectors(spark, rows), every=10) == brute_neighbours(rows, 10, 10)
    assert found(vectors(spark, [])) == [] and found(vectors(spark, [(100, [1.0])])) == []


def test_copies_share_their_smallest_ids(spark):
    """A third of all rows is one vector: its queries get the smallest other ids."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(300 + i, [float(i), 1.0, 0.5]) for i in range(600)]
    assert found(vectors(spark, rows), shortest=32, block=16) == brute_neighbours(rows, 10, 100)


def test_short_windows_reach_the_recall(spark):
    """Vectors near a plane of few dimensions: windows far shorter than the table hold nine of ten neighbours."""
    rng = np.random.default_rng(6)
    data = rng.normal(size=(12_000, 3)) @ rng.normal(size=(3, 16)) + 0.01 * rng.normal(size=(12_000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    got = curves.neighbours(df, every=100, shortest=64, block=128).collect()
    exact = data.astype(np.float32).astype(np.float64)
    hits = 0
    for q in range(0, 12_000, 100):
        d = ((exact - exact[q]) ** 2).sum(1)
        d[q] = math.inf
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(d)[:10].tolist()))
    assert len(got) == 1200 and hits >= 0.9 * 1200


def test_hilbert_steps_to_a_neighbour():
    side = np.arange(16)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    walk = cells[np.argsort(curves.hilbert(cells, 4))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
