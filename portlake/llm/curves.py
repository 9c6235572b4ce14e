"""Nearest neighbours along shifted space-filling curves.

1. Equal vectors become one, with the smallest ids that carry it; a query never needs more of them than neighbours.
2. Each curve projects the vectors onto a few random directions, shifts them, and orders them by their Hilbert number; one
   range-partitioned sort ranks all curves.
3. The windows are fitted on a bounded sample of queries: their true neighbours come from one exact pass, and the smallest window
   that holds the wanted share of them, over the number of curves that makes it cheapest, is taken.  Where vectors have
   structure windows are short; where they have none (uniform directions in many dimensions) they grow to the table.
4. Ranks fall into blocks.  A query goes to the blocks of its windows, a block meets its queries in one task and
   returns each query's best, and the bests of all blocks and curves merge.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ordered import running
from ..session import cut
from . import text

K, EVERY = 10, 100
CURVES, AXES, BITS = 4, 6, 10
#: Queries of the sample that fits the windows, the share of their neighbours that the windows must hold, the shortest window.
SAMPLE, RECALL, SHORTEST = 128, 0.96, 4096
#: Vectors in a block; queries compared with it at a time.
BLOCK, AT_ONCE = 2048, 64
_SLACK = 1e-9


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Numbers along the Hilbert curve of rows of `bits`-bit coordinates (at most 62 bits in all)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # turn and mirror the sub-cubes, from the coarsest down
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, 0) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b) & 1
    return out


def directions(dims: int, curve: int, axes: int) -> np.ndarray:
    """Random directions of a curve, a column each."""
    return np.random.default_rng([curve, dims]).standard_normal((dims, axes)) / math.sqrt(max(1, dims))


#: How a vector's first byte tells the width of the components behind it.
_WIDTHS = {4: np.dtype("<f4"), 8: np.dtype("<f8")}


def _parsed(values: list[bytes]) -> np.ndarray:
    """Vectors of one length from their bytes, in doubles."""
    kind = _WIDTHS[values[0][0]]
    return np.frombuffer(b"".join([v[1:] for v in values]), kind).reshape(len(values), -1).astype(np.float64)


def _length(value: bytes) -> int:
    return (len(value) - 1) // value[0]


def _by_length(column: pa.Array, limit: int = 4096):
    """(places, vectors) for runs of vectors of one length, a bounded number of components at a time."""
    values = column.to_pylist()
    size = np.array([_length(v) for v in values], np.int64)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        step = max(1, limit * 64 // n)
        for k in range(0, len(at), step):
            yield at[k : k + step], _parsed([values[j] for j in at[k : k + step].tolist()])


def spread(base: DataFrame, curves: int, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of all vectors on each axis of each curve."""
    schema = pa.schema([("place", pa.int32()), ("n", pa.int64()), ("s", pa.float64()), ("q", pa.float64())])

    def run(batches):
        n, s, q = 0, np.zeros(curves * axes), np.zeros(curves * axes)
        for b in batches:
            for at, x in _by_length(b.column("v")):
                p = np.clip(np.concatenate([x @ directions(x.shape[1], c, axes) for c in range(curves)], 1), -1e150, 1e150)
                n, s, q = n + len(at), s + p.sum(0), q + (p * p).sum(0)
        if n:
            yield text.batch_of(schema, np.arange(curves * axes), np.full(curves * axes, n), s, q)

    got = base.select("v").mapInArrow(run, "place int, n long, s double, q double").groupBy("place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    mean, dev = np.zeros(curves * axes), np.ones(curves * axes)
    for r in got:  # a row for each axis
        mean[r["place"]] = r["s"] / r["n"]
        dev[r["place"]] = math.sqrt(max(0.0, r["q"] / r["n"] - mean[r["place"]] ** 2)) or 1.0
    return mean.reshape(curves, axes), dev.reshape(curves, axes)


def ranks(base: DataFrame, curves: int, axes: int, bits: int) -> DataFrame:
    """(curve, digest, rn, n): the place of each vector on each curve; vectors of other lengths lie elsewhere on it."""
    mean, dev = spread(base, curves, axes)
    sent = base.sparkSession.sparkContext.broadcast((mean, dev))
    schema = pa.schema([("curve", pa.int32()), ("length", pa.int32()), ("key", pa.int64()), ("digest", pa.binary())])

    def run(batches):
        mean, dev = sent.value
        cells = 1 << bits
        for b in batches:
            for at, x in _by_length(b.column("v")):
                digest = b.column("digest").take(pa.array(at))
                for c in range(curves):
                    shift = c / curves  # of a cell of the coarsest level, and so of all others
                    p = ((x @ directions(x.shape[1], c, axes) - mean[c]) / dev[c] + 4) / 9 + shift / 9
                    cell = np.clip(np.nan_to_num(p) * cells, 0, cells - 1).astype(np.int64)
                    yield text.batch_of(schema, np.full(len(at), c), np.full(len(at), x.shape[1]), hilbert(cell, bits), digest)

    keyed = base.select("v", "digest").mapInArrow(run, "curve int, length int, key long, digest binary")
    return cut(running(keyed, ["curve"], [F.col("length"), F.col("key"), F.col("digest")]).select("curve", "digest", "rn", "n"))


def best_of(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the `k` nearest rows of each query, all that tie with the last one included."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    with np.errstate(over="ignore", invalid="ignore"):
        size = (queries * queries).sum(1)[:, None] + (rows * rows).sum(1)[None, :]
        rough, slack = size - 2 * (queries @ rows.T), _SLACK * size
        sure = np.isfinite(rough) & np.isfinite(slack)  # what is too large for this form is measured in any case
        kth = np.partition(np.where(sure, rough + slack, np.inf), min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1]
        q, r = np.nonzero(~sure | (rough - slack <= kth[:, None]))
    return q, r, distance(queries[q], rows[r])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of pairs, added up component by component."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for d in range(a.shape[1]):
            gap = a[:, d] - b[:, d]
            out += gap * gap
        return np.sqrt(out)


def _top(q: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the `k` smallest distances of their query, ties with the last one included."""
    order = np.lexsort((d, q))
    q, d = q[order], d[order]
    begin = np.flatnonzero(np.diff(q, prepend=-1))
    size = np.diff(np.append(begin, len(q)))
    last = d[np.minimum(begin + k, begin + size) - 1]
    return order[d <= np.repeat(last, size)]


def sampled(base: DataFrame, asked: DataFrame, k: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, neighbour) digests: the true `k` nearest of at most `sample` queries, by one pass over all vectors."""
    some = text.smallest(asked.withColumn("h", F.xxhash64(F.lit("windows"), "digest")), sample, "digest")
    if not some:
        return np.zeros(0, object), np.zeros(0, object)
    lengths: dict[int, list] = {}
    for r in some:
        lengths.setdefault(_length(bytes(r["v"])), []).append((bytes(r["digest"]), bytes(r["v"])))
    sent = base.sparkSession.sparkContext.broadcast({n: ([d for d, _ in rows], _parsed([v for _, v in rows])) for n, rows in lengths.items()})
    schema = pa.schema([("query", pa.binary()), ("digest", pa.binary()), ("d", pa.float64())])

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            for at, x in _by_length(b.column("v")):
                names, queries = sent.value.get(x.shape[1], ([], None))
                if names:
                    digest = b.column("digest").take(pa.array(at)).to_pylist()
                    q, r, d = best_of(queries, x, k + 1)
                    held += [(d_, names[i], digest[j]) for i, j, d_ in zip(q.tolist(), r.tolist(), d.tolist()) if names[i] != digest[j]]
            if len(held) > 100_000:
                held = _least(held, k)
        held = _least(held, k)
        if held:
            d, query, digest = zip(*held)
            yield text.batch_of(schema, query, digest, d)

    found = base.select("v", "digest").mapInArrow(run, "query binary, digest binary, d double")
    near = found.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("d", "digest"))).where(F.col("k") <= k).select("query", "digest").toPandas()
    return near["query"].to_numpy(object), near["digest"].to_numpy(object)


def _least(held: list[tuple], k: int) -> list[tuple]:
    out, seen = [], {}
    for entry in sorted(held):
        seen[entry[1]] = seen.get(entry[1], 0) + 1
        if seen[entry[1]] <= k:
            out.append(entry)
    return out


def windows(placed: DataFrame, query: np.ndarray, near: np.ndarray, curves: int, recall: float, shortest: int) -> tuple[int, int]:
    """How many curves to use, and how far to look on each side: the cheapest choice that holds `recall` of the sample's neighbours."""
    spark = placed.sparkSession
    if not len(query):
        return 1, shortest
    names = spark.createDataFrame([(bytes(x),) for x in {*query.tolist(), *near.tolist()}], "digest binary")
    places: dict[bytes, dict[int, int]] = {}
    n = 1
    for r in placed.join(F.broadcast(names), "digest").collect():  # some thousand rows: the sample and its neighbours
        places.setdefault(bytes(r["digest"]), {})[r["curve"]] = r["rn"]
        n = max(n, r["n"])
    gaps = np.array([[abs(places[bytes(a)][c] - places[bytes(b)][c]) for c in range(curves)] for a, b in zip(query, near)])
    best = None
    for used in range(1, curves + 1):
        gap = np.sort(gaps[:, :used].min(1))
        wide = max(shortest, int(gap[min(len(gap) - 1, math.ceil(recall * len(gap)) - 1)]))
        cost = used * min(2 * wide, n)
        if best is None or cost < best[0]:
            best = (cost, used, wide)
    return best[1:]


def neighbours(vectors: DataFrame, k: int = K, every: int = EVERY, curves: int = CURVES, axes: int = AXES, bits: int = BITS, recall: float = RECALL, sample: int = SAMPLE,
               shortest: int = SHORTEST, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query, rank, vec_id, score: for each row whose id is divisible by `every`, its `k` nearest other rows that were found.

    Nearest first, ties to the smaller id; score is the Euclidean distance in doubles, components added in their order.  Vectors that
    are null, empty, all zero, or hold a null or a value that is not finite take no part, nor do rows without an id: they could not be
    named.  Vectors of another length are no neighbours.  Rows that repeat id and vector are one row; an id with several vectors is
    several rows.  Fewer rows than `k`: all of them.  The bounded sample fits the windows only; every row is ranked and searched.
    """
    values = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where("vec_id IS NOT NULL")
    good = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf))) & F.exists("x", lambda e: e != 0)
    kind = _WIDTHS[4 if dict(vectors.select(F.col(vector_col).alias("x")).dtypes)["x"] == "array<float>" else 8]
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary())])

    def packed(batches):
        width = bytes([kind.itemsize])
        for b in batches:
            x = b.column("x")
            ends = x.offsets.to_numpy().astype(np.int64)
            flat = x.values.to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)  # no minus zero
            yield text.batch_of(schema, b.column("vec_id"), [width + flat[a:z].tobytes() for a, z in pairwise(ends.tolist())])

    rows = values.where(good).mapInArrow(packed, "vec_id long, v binary").select("vec_id", "v", F.unhex(F.sha2("v", 256)).alias("digest"))
    # of equal vectors the k + 1 smallest ids are enough for any query
    order = Window.partitionBy("digest").orderBy("vec_id")
    ids = rows.select("digest", "vec_id").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= k + 1)
    ids = ids.groupBy("digest").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    base = cut(rows.groupBy("digest").agg(F.first("v").alias("v")).join(ids.hint("merge"), "digest"))
    queries = cut(rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "digest", "v").distinct())
    asked = queries.groupBy("digest").agg(F.first("v").alias("v"))
    placed = ranks(base, curves, axes, bits)
    used, wide = windows(placed, *sampled(base, asked, k, sample), curves, recall, shortest)
    on = placed.where(F.col("curve") < used).withColumn("block", F.floor((F.col("rn") - 1) / block).cast("int"))
    here = on.join(base.hint("merge"), "digest").select("curve", "block", F.lit(False).alias("asks"), "digest", "v", "ids")
    low, high = F.greatest(F.col("rn") - 1 - wide, F.lit(0)), F.least(F.col("rn") - 1 + wide, F.col("n") - 1)
    there = on.join(asked.hint("merge"), "digest").select("curve", F.explode(F.sequence(F.floor(low / block).cast("int"), F.floor(high / block).cast("int"))).alias("block"), F.lit(True).alias("asks"), "digest", "v", F.lit(None).cast("array<long>").alias("ids"))
    found = pa.schema([("query", pa.binary()), ("digest", pa.binary()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def compare(side: dict, asking: list[tuple[bytes, bytes]]):
        for n in {_length(v) for _, v in asking} & side.keys():
            digest, values, ids_ = side[n]
            if isinstance(values, list):
                values = _parsed(values)
                side[n] = (digest, values, ids_)
            mine = [(name, v) for name, v in asking if _length(v) == n]
            q, r, d = best_of(_parsed([v for _, v in mine]), values, k + 1)
            keep = _top(q, d, k + 1)
            yield text.batch_of(found, [mine[i][0] for i in q[keep].tolist()], [digest[j] for j in r[keep].tolist()], d[keep], [ids_[j] for j in r[keep].tolist()])

    def run(batches):
        at, side, held = None, {}, []
        for b in batches:
            for curve, number, asks, digest, v, ids_ in zip(*(c.to_pylist() for c in b.columns)):
                if (curve, number) != at:
                    yield from compare(side, held)
                    at, side, held = (curve, number), {}, []
                if asks:
                    held.append((digest, v))
                    if len(held) >= AT_ONCE:
                        yield from compare(side, held)
                        held = []
                else:
                    for part, value in zip(side.setdefault(_length(v), ([], [], [])), (digest, v, ids_)):
                        part.append(value)
        yield from compare(side, held)

    dealt = here.unionAll(there).repartition("curve", "block").sortWithinPartitions("curve", "block", "asks")
    seen = dealt.mapInArrow(run, "query binary, digest binary, score double, ids array<long>")
    near = seen.select("query", "score", F.explode("ids").alias("vec_id"), "digest").distinct()
    best = near.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("k") <= k + 1)
    told = queries.select(F.col("vec_id").alias("query_id"), "digest").join(best.select(F.col("query"), F.col("digest").alias("other"), "vec_id", "score"), F.col("digest") == F.col("query"))
    told = told.where((F.col("vec_id") != F.col("query_id")) | (F.col("digest") != F.col("other")))
    place = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("score", "vec_id"))
    return told.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
