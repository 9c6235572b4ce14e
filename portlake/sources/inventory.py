"""File inventories: best copies, product by polarisation tables, closure against the registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Metadata of files below `root` (contents are pruned from the scan)."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        .select("path", "modificationTime", "length")
    )


def pick_best_copy(files: DataFrame, keys: Sequence[str], prefer: Sequence[str], path: str = "path") -> DataFrame:
    """One file per key: the first preference its path contains, then the smallest path."""
    rank = F.lit(len(prefer))
    for i, p in reversed(list(enumerate(prefer))):
        rank = F.when(F.col(path).contains(p), i).otherwise(rank)
    best = F.min(F.struct(rank.alias("preference"), F.col(path).alias(path))).alias("b")
    return files.groupBy(*keys).agg(best).select(*keys, "b.preference", f"b.{path}")


def inventory(registry: DataFrame, files: DataFrame, fallback: DataFrame, pols: Sequence[str]) -> DataFrame:
    """Per product: has a file per polarisation, on the main root or else on the fallback root."""

    def wide(df, tag):
        return df.groupBy("product").pivot("pol", list(pols)).agg(F.min("path")).select(
            "product", *[F.col(p).alias(f"{tag}_{p}") for p in pols])

    out = registry.join(wide(files, "main"), "product", "left").join(wide(fallback, "fall"), "product", "left")
    have = {p: F.coalesce(F.col(f"main_{p}"), F.col(f"fall_{p}")) for p in pols}
    absent = F.concat_ws(";", *[F.when(have[p].isNull(), F.lit(p)) for p in pols])
    return out.select(
        *registry.columns, *[have[p].alias(f"file_{p}") for p in pols],
        *[(F.col(f"main_{p}").isNull() & F.col(f"fall_{p}").isNotNull()).alias(f"from_fallback_{p}") for p in pols],
        absent.alias("missing"), (absent == "").alias("complete"))


def status_closure(done: DataFrame, registry: DataFrame, pols: Sequence[str]) -> DataFrame:
    """Registry products with the source trees and polarisations that completed them."""
    got = done.groupBy("product").agg(
        F.array_sort(F.collect_set("tree")).alias("trees"), F.array_sort(F.collect_set("pol")).alias("pols"))
    full = F.lit(True)
    for p in pols:
        full = full & F.array_contains("pols", p)
    out = registry.select("product").distinct().withColumn("in_registry", F.lit(True)).join(got, "product", "full")
    return out.select(
        "product", F.coalesce("in_registry", F.lit(False)).alias("in_registry"),
        F.concat_ws(";", "trees").alias("trees"), F.concat_ws(";", "pols").alias("pols"),
        F.coalesce(full, F.lit(False)).alias("complete"))


def scene_availability(needed: DataFrame, have: DataFrame) -> DataFrame:
    """Needed products per port with a VV, a VH or any file."""
    h = have.groupBy("product").agg(F.bool_or(F.col("pol") == "VV").alias("vv"), F.bool_or(F.col("pol") == "VH").alias("vh"))
    j = needed.select("port", "product").distinct().join(h, "product", "left")
    hit = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    any_hit = F.count_if(F.coalesce(F.col("vv"), F.lit(False)) | F.coalesce(F.col("vh"), F.lit(False)))
    return j.groupBy("port").agg(
        F.count(F.lit(1)).alias("needed"), hit("vv").alias("vv"), hit("vh").alias("vh"), any_hit.alias("any_pol"),
        (any_hit / F.count(F.lit(1))).alias("share"))


def missing_scenes(needed: DataFrame, local: DataFrame, archive: DataFrame) -> DataFrame:
    """Needed (port, product, pol) not held locally, and whether the archive has them."""
    keys = ["product", "pol"]
    gone = needed.select("port", *keys).distinct().join(local.select(*keys).distinct(), keys, "left_anti")
    return gone.join(archive.select(*keys).distinct().withColumn("in_archive", F.lit(True)), keys, "left").withColumn(
        "in_archive", F.coalesce("in_archive", F.lit(False))).select("port", *keys, "in_archive")


def window_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
