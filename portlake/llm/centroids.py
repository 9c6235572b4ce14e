"""Centroid clustering in whole numbers, with Ptolemy's inequality to spare distances.

For a vector x, a centroid c and two pivots p, s:  d(x, c) d(p, s) >= |d(x, p) d(c, s) - d(x, s) d(c, p)|.
Pivots are fixed, so the distances of a vector to them are computed once and written with it; a round computes those of the
centroids only.  The pivot pairs give each centroid a lower bound, rounded down by more than the arithmetic can err.
The centroid with the smallest bound is measured, then every other one whose bound does not exceed what was found.
What is measured is exact: in doubles while every value in it is a whole number below 2^53, then in 64 bits, then in
Python's integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import text

CENTROIDS, ROUNDS, DIMS, SCALE, SALT = 40, 5, 64, 256, "2:"
#: The first centroids at the start serve as pivots: all their pairs.
PIVOTS = 8
ROWS = 4096
#: Absolute components below which sums of squares fit a double, and 64 bits.
DOUBLE, LONG = 1 << 21, 1 << 27
_SLACK = 32 * np.finfo(np.float64).eps
_LIMB = 32


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x), as 64-bit numbers if they are below 2^62, else as Python's."""
    if not len(values) or np.abs(values).max() * scale < 1 << 62:
        return np.floor(values * scale).astype(np.int64)
    return np.array([[math.floor(Fraction(x) * scale) for x in row] for row in values.tolist()], object)


def kind_of(*parts: np.ndarray):
    """The narrowest arithmetic that is exact for squared distances of these rows."""
    top = max((int(np.abs(p).max()) for p in parts if p.size), default=0)
    return np.float64 if top < DOUBLE else np.int64 if top < LONG else object


def as_double(values: np.ndarray) -> np.ndarray:
    """Nearest doubles; infinite beyond their range."""
    if values.dtype != object:
        return values.astype(np.float64)
    return np.array([float(v) if v < 1 << 1023 else math.inf for v in values.ravel().tolist()], np.float64).reshape(values.shape)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of `a` to all rows of `b`."""
    kind = kind_of(a, b)
    a, b = a.astype(kind), b.astype(kind)
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


class Pivots:
    """Fixed pivots, and the pairs of them that lie apart."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        apart = np.sqrt(as_double(squares(rows, rows)))
        self.pairs = [(i, j, apart[i, j]) for i in range(len(rows)) for j in range(i) if 0 < apart[i, j] < math.inf]

    def far(self, rows: np.ndarray) -> np.ndarray:
        """Distances to the pivots, nearest doubles."""
        return np.sqrt(as_double(squares(rows, self.rows)))

    def bounds(self, rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """A number that no squared distance of a row to a centroid is below, from their distances to the pivots."""
        best = np.zeros((len(rows), len(centroids)))
        with np.errstate(invalid="ignore", over="ignore"):
            for i, j, apart in self.pairs:
                one, two = rows[:, i : i + 1] * centroids[None, :, j], rows[:, j : j + 1] * centroids[None, :, i]
                np.fmax(best, (np.abs(one - two) - _SLACK * (one + two)) / apart, out=best)  # fmax passes over what is no number
            low = best * best * (1 - _SLACK)
        return np.where(np.isfinite(low), low, 0.0)


def nearest(rows: np.ndarray, cached: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (the smallest number of equals), its squared distance, and how many were measured."""
    kind = kind_of(rows, centroids)
    low = pivots.bounds(cached, pivots.far(centroids))
    rows, centroids = rows.astype(kind), centroids.astype(kind)
    own, other = (rows * rows).sum(1), (centroids * centroids).sum(1)
    first = low.argmin(1)
    upper = own + other[first] - 2 * (rows * centroids[first]).sum(1)
    alive = low <= as_double(upper)[:, None] * (1 + _SLACK)
    best = np.full(len(rows), len(centroids), np.int64)
    least = upper.copy()
    for j in range(len(centroids)):
        at = np.flatnonzero(alive[:, j])
        d = own[at] + other[j] - 2 * (rows[at] @ centroids[j])
        better = (d < least[at]) | ((d == least[at]) & (j < best[at]))
        least[at[better]], best[at[better]] = d[better], j
    return best, least if kind is object else least.astype(np.int64), int(alive.sum())


def _packed(rows: np.ndarray) -> list[bytes]:
    """Rows as bytes: 32-bit numbers where they fit, else text."""
    if rows.dtype != object and np.abs(rows).max(initial=0) < 1 << 31:
        return [r.tobytes() for r in rows.astype(np.int32)]
    return [",".join(map(str, r)).encode() for r in rows.tolist()]


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    values = column.to_pylist()
    if all(len(v) == 4 * dims and b"," not in v for v in values):
        return np.frombuffer(b"".join(values), np.int32).reshape(-1, dims).astype(np.int64)
    rows = [np.frombuffer(v, np.int32).tolist() if len(v) == 4 * dims and v.count(b",") != dims - 1 else [int(x) for x in v.split(b",")] for v in values]
    return np.array(rows, object)


def _limbs(value: int) -> Iterator[int]:
    """`value` as digits of 32 bits, the last one signed."""
    while not -(1 << 31) <= value < 1 << 31:
        yield value & ((1 << _LIMB) - 1)
        value >>= _LIMB
    yield value


def starts(kept: DataFrame, k: int, salt: str) -> list:
    """The `k` rows with the smallest hash, equal hashes by their components.  Only rows under a hash that about 4 k of them
    have are sorted, whatever the size of the table."""
    hashed = kept.withColumn("h", F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    total = kept.count()
    share = min(1.0, (4 * k + 200) / max(1, total))
    while True:
        below = hashed if share >= 1 else hashed.where(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") < int(share * 2**32))
        got = below.orderBy("h", "v").limit(k).collect()
        if len(got) == min(k, total) or share >= 1:
            return got
        share = min(1.0, 8 * share)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT, pivots: int = PIVOTS,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept row: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly `dims` components, none null or not finite, as floor(`scale` x).  The `k` kept rows with the smallest
    sha256 of `salt` and id start as centroids 0, 1, ...; each round assigns all rows to the nearest centroid (the smallest number of
    equals) and moves each centroid to the floor of its rows' mean, one without rows stays; then rows are assigned once more.

    Rows that repeat count as often as they stand; a null id is hashed as an empty text and kept.  With fewer than `k` kept rows each is
    a centroid.  An empty table gives no rows.  A distance or sum beyond 63 bits is null; the clusters stay exact.  Other columns
    are left out.
    """
    spark = vectors.sparkSession
    values = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    kept = values.where((F.size("v") == dims) & good)
    told = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    first = starts(kept, k, salt)
    if not first:
        return spark.createDataFrame([], told)
    centers = whole(np.array([r["v"] for r in first], np.float64), scale)
    fixed = Pivots(centers[:pivots])
    sent = spark.sparkContext.broadcast(fixed)
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("far", pa.binary())])

    def prepare(batches):
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.slice(at, ROWS)
                rows = whole(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)
                yield text.batch_of(schema, part.column("vec_id"), _packed(rows), [f.tobytes() for f in sent.value.far(rows)])

    rows = cut(kept.mapInArrow(prepare, "vec_id long, v binary, far binary"))

    def assigned(batches, at, n):
        for b in batches:
            for a in range(0, len(b), ROWS):
                part = b.slice(a, ROWS)
                mine = _unpacked(part.column("v"), dims)
                cached = np.frombuffer(b"".join(part.column("far").to_pylist()), np.float64).reshape(len(part), n)
                yield part, mine, *nearest(mine, cached, at, sent.value)[:2]

    def summed(at) -> DataFrame:
        """(cluster, place, limb, total): sums of each component in digits; place -1 counts the rows.  A few rows a task."""
        place = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("limb", pa.int32()), ("total", pa.int64())])

        def run(batches):
            total, count = np.zeros(at.value.shape, object), np.zeros(len(at.value), np.int64)
            for _, mine, best, _ in assigned(batches, at.value, len(sent.value.rows)):
                count += np.bincount(best, minlength=len(count))
                order = np.argsort(best, kind="stable")
                begin = np.flatnonzero(np.diff(best[order], prepend=-1))
                if kind_of(mine) is object:
                    mine = mine.astype(object)
                total[best[order][begin]] += np.add.reduceat(mine[order], begin, axis=0).astype(object)
            out = [(j, -1, 0, int(n)) for j, n in enumerate(count) if n]
            out += [(j, d, e, limb) for j in np.flatnonzero(count).tolist() for d in range(dims) for e, limb in enumerate(_limbs(int(total[j, d])))]
            if out:
                yield text.batch_of(place, *zip(*out))

        return rows.mapInArrow(run, "cluster int, place int, limb int, total long").groupBy("cluster", "place", "limb").agg(F.sum("total").alias("total"))

    for _ in range(rounds):
        total, count = {}, {}
        # a row for each centroid, component and digit, whatever the number of vectors
        for r in summed(spark.sparkContext.broadcast(centers)).collect():
            if r["place"] < 0:
                count[r["cluster"]] = r["total"]
            else:
                key = (r["cluster"], r["place"])
                total[key] = total.get(key, 0) + (r["total"] << (_LIMB * r["limb"]))
        moved = [[total[j, d] // count[j] for d in range(dims)] if j in count else centers[j].tolist() for j in range(len(centers))]
        centers = np.array(moved, object)
        if max(map(abs, centers.ravel().tolist())) < 1 << 62:
            centers = centers.astype(np.int64)
    last = spark.sparkContext.broadcast(centers)
    out = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches):
        for part, _, best, least in assigned(batches, last.value, len(sent.value.rows)):
            yield text.batch_of(out, part.column("vec_id"), best.astype(np.int32), [d if d < 1 << 63 else None for d in least.tolist()])

    placed = cut(rows.mapInArrow(run, "vec_id long, cluster int, distance long"))
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("distance").alias("c"), F.count(F.lit(1)).alias("n")).collect()  # one row a centroid
    known = {r["cluster"]: int(r["s"]) if r["c"] == r["n"] else None for r in sums}
    fit = lambda v: v if v is not None and v < 1 << 63 else None
    whole_sum = fit(None if None in known.values() else sum(known.values()))
    names = [(j, fit(s), whole_sum, hashlib.sha256(",".join(map(str, centers[j].tolist())).encode()).hexdigest()) for j, s in known.items()]
    about = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
