"""Set algebra over sources, folds, keys and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed value: objects a class needs on a side of a fold
MIN_OBJECTS = 20
UNTYPED = "ship_untyped"


def union_sources(parts: dict[str, DataFrame], defaults: dict[str, str], kind: str = "kind") -> DataFrame:
    """Union of feature sources; a source's default fills an empty kind and `source` names where a row came from."""
    out = None
    for name, df in parts.items():
        d = df.withColumns({kind: F.coalesce(F.nullif(F.trim(F.col(kind).cast("string")), F.lit("")), F.lit(defaults.get(name))), "source": F.lit(name)})
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def fold_class_sets(df: DataFrame, port: str, cls: str, min_objects: int = MIN_OBJECTS, untyped=None) -> DataFrame:
    """Per held-out port: shared, source-private and target-private classes and the transfer setting.

    Works on (port, class) counts; source support is the total minus the port's own."""
    c = df.where(F.col(cls) != untyped) if untyped is not None else df
    c = c.groupBy(port, cls).agg(F.count(F.lit(1)).alias("n"))
    ports, classes = df.select(port).distinct(), c.groupBy(cls).agg(F.sum("n").alias("total"))
    # ports x classes, both small dimensions of already aggregated counts
    g = ports.join(F.broadcast(classes)).join(c, [port, cls], "left").withColumn("t", F.coalesce("n", F.lit(0))).withColumn("s", F.col("total") - F.col("t"))
    ts, ss = F.col("t") >= min_objects, F.col("s") >= min_objects
    names = lambda cond: F.concat_ws(";", F.array_sort(F.collect_list(F.when(cond, F.col(cls).cast("string")))))
    out = g.groupBy(port).agg(names(ts & ss).alias("shared"), names(ss & ~ts).alias("source_private"), names(ts & ~ss).alias("target_private"))
    sp, tp = F.col("source_private") != "", F.col("target_private") != ""
    return out.withColumn("setting", F.when(sp & tp, "universal").when(sp, "partial").when(tp, "open").otherwise("closed"))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys only one side has."""
    sides = left.select(key, F.lit(1).alias("_s")).unionByName(right.select(key, F.lit(2).alias("_s")))
    seen = sides.groupBy(key).agg(F.bit_or("_s").alias("_s")).where("_s < 3")  # one shuffle, no join; null keys equal null keys
    return seen.select(key, F.when(F.col("_s") == 1, "right").otherwise("left").alias("missing_from"))


def manifest_diff(expected: DataFrame, actual: DataFrame, keys: Sequence[str], role: str = "role") -> DataFrame:
    """Missing, extra and changed roles between two manifests."""
    j = expected.select(*keys, F.col(role).alias("expected")).join(actual.select(*keys, F.col(role).alias("actual")), list(keys), "full")
    what = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("expected") != F.col("actual"), "changed")
    return j.withColumn("difference", what).where(F.col("difference").isNotNull())


def role_check(manifest: DataFrame, registry: DataFrame, fold: str, product: str, role: str = "role") -> DataFrame:
    """Per fold: products listed, products with more than one role, registry products not covered."""
    per = manifest.groupBy(fold, product).agg(F.countDistinct(role).alias("roles"))
    total = registry.agg(F.countDistinct(product).alias("total"))
    known = per.join(registry.select(product).distinct().withColumn("_k", F.lit(1)), product, "left")
    g = known.groupBy(fold).agg(F.count(F.lit(1)).alias("products"), F.count_if(F.col("roles") > 1).alias("shared_roles"), F.count("_k").alias("known"))
    return g.join(F.broadcast(total)).select(fold, "products", "shared_roles", (F.col("total") - F.col("known")).alias("uncovered"))


def tile_gaps(needed: DataFrame, have: DataFrame, unpublished: DataFrame, tile: str = "tile") -> DataFrame:
    """Needed tiles that are absent, and whether they can be fetched or were never published."""
    gone = needed.select(tile).distinct().join(have.select(tile).distinct(), tile, "left_anti")
    return gone.join(unpublished.select(tile).distinct().withColumn("_u", F.lit(True)), tile, "left").select(
        tile, F.when(F.col("_u"), "unpublished").otherwise("fetchable").alias("status"))


def split_half(df: DataFrame, port: str, product: str, date: str) -> DataFrame:
    """Oldest half of a port's products (at least one) adapts, the rest evaluates."""
    from ..ordered import running

    p = df.groupBy(port, product).agg(F.min(date).alias(date))
    r = running(p, [port], [F.col(date), F.col(product)])
    half = F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    return r.select(port, product, date, "n", F.when(F.col("rn") <= half, "adapt").otherwise("eval").alias("role"))


def pseudo_target_split(df: DataFrame, port: str, product: str, date: str, min_products: int, min_rows: int) -> DataFrame:
    """Date halves of a would-be target with the reason it cannot serve, if any."""
    h = split_half(df, port, product, date)
    n = df.groupBy(port, product).agg(F.count(F.lit(1)).alias("rows"))
    g = h.join(n, [port, product]).groupBy(port).agg(
        F.max("n").alias("products"), F.sum(F.when(F.col("role") == "adapt", F.col("rows")).otherwise(0)).alias("adapt_rows"),
        F.sum(F.when(F.col("role") == "eval", F.col("rows")).otherwise(0)).alias("eval_rows"))
    reason = (
        F.when(F.col("products") < min_products, "too_few_products").when(F.col("adapt_rows") < min_rows, "adapt_too_small")
        .when(F.col("eval_rows") < min_rows, "eval_too_small").otherwise("ok"))
    return g.withColumn("status", reason)


def lopo_folds(df: DataFrame, port: str, min_target: int, min_sources: int) -> DataFrame:
    """Leave-one-port-out plan: target rows, source ports and rows, and whether the fold is usable."""
    c = df.groupBy(port).agg(F.count(F.lit(1)).alias("target_rows"))
    # port totals only
    t = c.agg(F.sum("target_rows").alias("_all"), F.count(F.lit(1)).alias("_ports"))
    return c.join(F.broadcast(t)).select(
        port, "target_rows", (F.col("_ports") - 1).alias("sources"), (F.col("_all") - F.col("target_rows")).alias("source_rows"),
        ((F.col("target_rows") >= min_target) & (F.col("_all") - F.col("target_rows") >= min_sources)).alias("usable"))


def inner_episodes(df: DataFrame, port: str, min_rows: int) -> DataFrame:
    """Pairs (target p, held source q) with the rows left for training after both are removed."""
    c = df.groupBy(port).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("_all"))
    a, b = c.select(F.col(port).alias("p"), F.col("n").alias("np")), c.select(F.col(port).alias("q"), F.col("n").alias("nq"))
    return a.join(b, F.col("p") != F.col("q")).join(F.broadcast(t)).select(
        "p", "q", F.col("nq").alias("held_rows"), (F.col("_all") - F.col("np") - F.col("nq")).alias("train_rows")).where(F.col("held_rows") >= min_rows)


def ordered_pairs(df: DataFrame, port: str, min_rows: int) -> DataFrame:
    """Every ordered pair of different ports with at least `min_rows` rows."""
    c = df.groupBy(port).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    a, b = c.select(F.col(port).alias("a"), F.col("n").alias("n_a")), c.select(F.col(port).alias("b"), F.col("n").alias("n_b"))
    return a.join(b, F.col("a") != F.col("b"))


def split_axes(df: DataFrame, ids: DataFrame, key: str, fold_keys: Sequence[str]) -> DataFrame:
    """The same rows under several fold keys (`axis`, `fold`); raises when the two id sets differ."""
    gone = ids.join(df, key, "left_anti").limit(1).count() + df.join(ids, key, "left_anti").limit(1).count()
    if gone:
        raise ValueError("rows and ids do not line up")
    axes = F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), F.col(k).cast("string").alias("fold")) for k in fold_keys]))
    return df.select("*", axes.alias("_a")).select(*df.columns, "_a.axis", "_a.fold")
