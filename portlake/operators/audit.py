"""Audits of the object table: duplicates, provenance, temporal evidence, truncation, supervision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_audit(df: DataFrame, position: Sequence[str], key: str) -> DataFrame:
    """Rows, rows repeating an earlier position, distinct ids and id collisions."""
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    pos = df.groupBy(*position).agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") - 1).alias("same_position"))
    ids = df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("distinct_ids"), F.sum(F.col("c") - 1).alias("id_collisions"))
    # three one-row frames
    return rows.crossJoin(pos).crossJoin(ids)


def label_provenance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(F.col(columns[0]).isNotNull()).groupBy(*columns).agg(F.count(F.lit(1)).alias("objects"))


def temporal_evidence(df: DataFrame, port: str, kind: str, edit: str, scene: str) -> DataFrame:
    """Per port: no feature, undated feature, feature older or newer than the scene."""
    hit, dated = F.col(kind).isNotNull(), F.col(edit).isNotNull()
    old = F.to_date(edit) <= F.to_date(scene)
    return df.groupBy(port).agg(
        F.count_if(~hit).alias("no_facility_hit"), F.count_if(hit & ~dated).alias("hit_not_dated"),
        F.count_if(hit & dated & old).alias("existed_before_scene"), F.count_if(hit & dated & ~old).alias("edited_after_scene"))


def deployable_share(df: DataFrame, port: str, ok: Column) -> DataFrame:
    return df.groupBy(port).agg(F.count(F.lit(1)).alias("objects"), F.count_if(ok).alias("deployable"), (F.count_if(ok) / F.count(F.lit(1))).alias("share"))


def distance_truncation(df: DataFrame, columns: Sequence[str], cap: float) -> DataFrame:
    """How many values of each distance sit at the cap (or are missing)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns]))
    at = F.col("v").isNull() | (F.col("v") >= cap)
    return df.select(pairs.alias("p")).select("p.*").groupBy("column").agg(F.count_if(at).alias("at_cap"), F.count_if(~at).alias("has_value"))


def source_support_delta(frozen: DataFrame, added: DataFrame, key: str, roles: DataFrame, product: str = "product") -> DataFrame:
    """Per tier: labels added, those without a frozen label, classes, and rows whose product is not a fit product.

    frozen(key, label), added(key, product, tier, label), roles(product, role)."""
    j = added.join(frozen.select(key, F.lit(True).alias("_old")), key, "left").join(roles, product, "left")
    return j.groupBy("tier").agg(
        F.count(F.lit(1)).alias("added"), F.count_if(F.col("_old").isNull()).alias("novel"), F.countDistinct("label").alias("classes"),
        F.countDistinct(product).alias("products"), F.count_if(F.coalesce(F.col("role"), F.lit("")) != "fit").alias("role_violations"))


def added_per_class(added: DataFrame) -> DataFrame:
    return added.groupBy("tier", "label").agg(F.count(F.lit(1)).alias("n"))
