"""Ranks, running sums and exact quantiles that never put one group into one task.

A plain `row_number() over (partition by port order by score)` sorts a whole port in a single task, which
fails when a port holds a third of all rows.  Here the rows are range-partitioned over (keys, order) into
slabs, each slab is ranked on its own, and the slab totals (at most one row per slab and group) supply the
offsets.  The slab number is written with the rows, so both branches see the same slabs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add `rn` (row number in `order` within `keys`), `n` (group size) and, for each entry of `sums`,
    `run_<name>` (running sum up to and including the row) and `tot_<name>`."""
    keys, sums = list(keys), dict(sums or {})
    cols = df.columns
    base = df.withColumns({f"_v_{s}": e for s, e in sums.items()}) if sums else df
    # without a number, adaptive execution merges small slabs (neighbours stay neighbours) up to its advisory size
    by = [*[F.col(k) for k in keys], *order]
    base = base.repartitionByRange(parts, *by) if parts else base.repartitionByRange(*by)
    base = cut(base.withColumn("_slab", F.spark_partition_id()))

    per = base.groupBy(*keys, "_slab").agg(F.count(F.lit(1)).alias("_c"), *[F.sum(f"_v_{s}").alias(f"_s_{s}") for s in sums])
    before = Window.partitionBy(*keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slab").alias("_k__slab"),
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        F.sum("_c").over(whole).alias("n"),
        *[F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums],
        *[F.sum(f"_s_{s}").over(whole).alias(f"tot_{s}") for s in sums],
    )
    inside = Window.partitionBy(*keys, "_slab").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = base.withColumns(
        {"_rn": F.row_number().over(inside), **{f"_r_{s}": F.sum(f"_v_{s}").over(upto) for s in sums}}
    )
    cond = F.col("_slab") == F.col("_k__slab")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return local.join(offsets, cond).select(
        *cols,
        (F.col("_rn") + F.col("_before")).alias("rn"),
        "n",
        *[(F.coalesce(F.col(f"_r_{s}"), F.lit(0)) + F.col(f"_b_{s}")).alias(f"run_{s}") for s in sums],
        *[f"tot_{s}" for s in sums],
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Mapping[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles of `value` per group, plus `n` non-null values.

    Equal values are counted first, so that a value that fills a group is one row from then on."""
    keys = list(keys)
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    r = running(per, keys, [F.col(value)], {"_c": F.col("_c")})
    top, n = F.col("run__c"), F.col("tot__c")  # ranks top - _c + 1 .. top have this value
    holds = lambda rank: (rank <= top) & (rank > top - F.col("_c"))
    place = {q: F.lit(p) * (n - 1) for q, p in qs.items()}
    aggs = [F.max(n).alias("n")]
    for q in qs:
        aggs += [F.max(F.when(holds(F.floor(place[q]) + 1), F.col(value))).alias(f"_lo_{q}"), F.max(F.when(holds(F.ceil(place[q]) + 1), F.col(value))).alias(f"_hi_{q}")]
    out = r.groupBy(*keys).agg(*aggs)
    share = {q: F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1)) for q, p in qs.items()}
    return out.select(*keys, "n", *[(F.col(f"_lo_{q}") + (F.col(f"_hi_{q}") - F.col(f"_lo_{q}")) * share[q]).alias(q) for q in qs])


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, counts: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per distinct (keys, value): `c` rows, `avg_rank` (ties share the mean rank), `n` rows in the
    group, and for every entry of `counts` its total at this value, `below_<name>` before it and `tot_<name>`."""
    keys, counts = list(keys), dict(counts or {})
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("c"), *[F.sum(e).alias(s) for s, e in counts.items()]
    )
    r = running(per, keys, [F.col(value)], {"c": F.col("c"), **{s: F.col(s) for s in counts}})
    return r.select(
        *keys, value, "c", *counts,
        (F.col("run_c") - F.col("c") + (F.col("c") + 1) / 2).alias("avg_rank"),
        F.col("tot_c").alias("n"),
        *[(F.col(f"run_{s}") - F.col(s)).alias(f"below_{s}") for s in counts],
        *[f"tot_{s}" for s in counts],
    )


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the tie-averaged rank of `value` within `keys`."""
    r = value_ranks(df, keys, value).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(value).alias("_k_v"), F.col("avg_rank").alias(name))
    cond = F.col(value) == F.col("_k_v")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(r, cond, "left").drop("_k_v", *[f"_k_{k}" for k in keys])
