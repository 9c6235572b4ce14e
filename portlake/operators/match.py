"""Joins of objects with vessel classes, dates, positions and label tiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, count_true, missing_names
from ..grid import around, cell, sq_dist

# fixed values: match tiers (metres, seconds)
TIERS = {"t1": (150.0, 180), "t2": (500.0, 300)}
# fixed values: the settled status, and the name of the curated layer
RESOLVED, CURATED_SOURCE = "fine_class_mapped", "curated_mapping_layer"


def resolve_class(df: DataFrame, final: DataFrame, curated: DataFrame, filled: DataFrame, key: str = "mmsi") -> DataFrame:
    """Class of each vessel by layer: final, else curated with a resolved status, else filled.

    final(mmsi, final_class, class_level, source), curated(mmsi, status, final_class), filled(mmsi, final_class, source).
    """
    f = final.where(blank_to_null(F.col("final_class")).isNotNull()).select(key, F.col("final_class").alias("_c1"), F.col("class_level").alias("_l1"), F.col("source").alias("_s1"))
    c = curated.where((F.col("status") == RESOLVED) & blank_to_null(F.col("final_class")).isNotNull()).select(key, F.col("final_class").alias("_c2"))
    g = filled.where(blank_to_null(F.col("final_class")).isNotNull()).select(key, F.col("final_class").alias("_c3"), F.col("source").alias("_s3"))
    j = df.join(f, key, "left").join(c, key, "left").join(g, key, "left")
    level = F.when(F.col("_c1").isNotNull(), F.col("_l1")).when(F.coalesce("_c2", "_c3").isNotNull(), "fine")
    src = F.when(F.col("_c1").isNotNull(), F.col("_s1")).when(F.col("_c2").isNotNull(), CURATED_SOURCE).otherwise(F.col("_s3"))
    return j.select(*df.columns, F.coalesce("_c1", "_c2", "_c3").alias("ais_final_class"), level.alias("ais_class_level"), src.alias("ais_class_source"))


def refresh_class(df: DataFrame, layer: DataFrame, signals: Sequence[str], key: str = "matched_mmsi") -> DataFrame:
    """Overwrite class columns from a newer layer, blank stale ones, recompute the support columns.

    layer(mmsi, final_class, class_level, source)."""
    n = layer.select(F.col("mmsi").alias(key), *[F.col(c).alias("_" + c) for c in ("final_class", "class_level", "source")], F.lit(True).alias("_hit"))
    j = df.join(n, key, "left")
    new = lambda c: F.when(F.col("_hit"), F.col(c))
    j = j.withColumns({"ais_final_class": new("_final_class"), "ais_class_level": new("_class_level"), "ais_class_source": new("_source")})
    resolved = F.coalesce((F.col("ais_class_level") == "fine") & ~F.col("ais_final_class").endswith("_coarse"), F.lit(False))
    j = j.withColumn("fine_class_resolved", resolved)
    flags = {s: F.col(s) for s in signals}
    return j.withColumns({"support_i": count_true(flags), "support_missing": missing_names(flags)}).select(*df.columns)


def attach_dates(df: DataFrame, dates: DataFrame, keys: Sequence[str] = ("element", "facility_id"), stamp: str = "timestamp") -> DataFrame:
    """Edit date of the feature an object touches, by element and id (ids of ways and nodes overlap); the latest of several."""
    return df.join(dates.groupBy(*keys).agg(F.max(stamp).alias("facility_edit_ts")), list(keys), "left")


def match_tiers(objects: DataFrame, ais: DataFrame, key: str, tiers: Mapping[str, tuple[float, int]] = TIERS, idx: str = "event_id") -> DataFrame:
    """Match objects (x, y, t) to positions (x, y, t, mmsi) in each distance and time tier, tiers independent.

    A match needs exactly one vessel in the tier; its nearest record is taken by (distance, |dt|, index).
    """
    dist = max(d for d, _ in tiers.values())
    secs = max(s for _, s in tiers.values())
    o = objects.select(key, "x", "y", "t", cell("x", dist).alias("cx"), cell("y", dist).alias("cy"), F.floor(F.col("t") / secs).alias("ct"))
    o = around(o, "cx", "cy").withColumn("ct", F.explode(F.array(F.col("ct") - 1, F.col("ct"), F.col("ct") + 1)))
    a = ais.select("mmsi", F.col(idx).alias("_i"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("t").alias("at"),
                   cell("x", dist).alias("cx"), cell("y", dist).alias("cy"), F.floor(F.col("t") / secs).alias("ct"))
    c = o.join(a, ["cx", "cy", "ct"]).withColumns({"d2": sq_dist("x", "y", "ax", "ay"), "adt": F.abs(F.col("at") - F.col("t"))})
    c = c.where((F.col("d2") <= dist * dist) & (F.col("adt") <= secs))
    inside = {n: (F.col("d2") <= d * d) & (F.col("adt") <= s) for n, (d, s) in tiers.items()}
    # one row per object and vessel first, so that a chatty vessel collapses before vessels are counted
    per = c.groupBy(key, "mmsi").agg(*[e for n, w in inside.items() for e in (
        F.count_if(w).alias(f"{n}_records"), F.min(F.when(w, F.struct("d2", "adt", "_i"))).alias(f"{n}_best"))])
    g = per.groupBy(key).agg(*[e for n in tiers for e in (
        F.sum(f"{n}_records").alias(f"{n}_records"), F.count_if(F.col(f"{n}_records") > 0).alias(f"{n}_mmsi_n"),
        F.min(F.when(F.col(f"{n}_records") > 0, F.struct(F.col(f"{n}_best").alias("b"), F.col("mmsi").alias("mmsi")))).alias(f"{n}_best"))])
    out = objects.join(g, key, "left")
    cols = []
    for n in tiers:
        k = F.coalesce(F.col(f"{n}_mmsi_n"), F.lit(0))
        one = k == 1
        cols += [
            F.coalesce(f"{n}_records", F.lit(0)).alias(f"{n}_records"), k.alias(f"{n}_vessels"),
            F.when(k == 0, "no_candidate").when(one, "unique_candidate").otherwise("ambiguous").alias(f"{n}_status"),
            F.when(one, F.col(f"{n}_best.mmsi")).alias(f"{n}_mmsi"), F.when(one, F.sqrt(f"{n}_best.b.d2")).alias(f"{n}_distance"),
            F.when(one, F.col(f"{n}_best.b.adt")).alias(f"{n}_abs_dt")]
    return out.select(*objects.columns, *cols)


def semi_join_keys(df: DataFrame, wanted: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Rows with a wanted key, first occurrence per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.join(wanted.select(*keys).distinct(), list(keys), "left_semi").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def ordinal_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence, right_order: Sequence) -> DataFrame:
    """Pair the j-th row of each side within `keys`; positions come from an explicit order."""
    from ..ordered import running

    a = running(left, keys, left_order).drop("n").withColumnRenamed("rn", "ordinal")
    b = running(right, keys, right_order).drop("n").withColumnRenamed("rn", "ordinal")
    return a.join(b, [*keys, "ordinal"])


def label_join_eval(preds: DataFrame, truth: DataFrame, key: str, vocabulary: Sequence) -> DataFrame:
    """Predictions against each label tier: evaluable, unlabelled, outside the vocabulary, accuracy on the evaluable.

    truth(key, tier, label)."""
    tiers = truth.select("tier").distinct()
    # a handful of tiers
    t = preds.join(F.broadcast(tiers)).join(truth, [key, "tier"], "left")
    inside = F.col("label").isin(*vocabulary)
    return t.groupBy("tier").agg(
        F.count(F.lit(1)).alias("predictions"), F.count_if(inside).alias("evaluable"), F.count_if(F.col("label").isNull()).alias("unlabelled"),
        F.count_if(F.col("label").isNotNull() & ~inside).alias("out_of_vocabulary"),
        F.avg(F.when(inside, (F.col("pred") == F.col("label")).cast("int"))).alias("accuracy"))


def bag_reuse(matches: DataFrame, scene: str, mmsi: str, top: int = 10) -> DataFrame:
    """(scene, vessel) pairs matched to more than one object, most reused first."""
    g = matches.where(F.col(mmsi).isNotNull()).groupBy(scene, mmsi).agg(F.count(F.lit(1)).alias("objects")).where("objects > 1")
    return g.orderBy(F.desc("objects"), scene, mmsi).limit(top)


def tier_agreement(frozen: DataFrame, auxiliary: DataFrame, key: str, parents: DataFrame) -> DataFrame:
    """Agreement of auxiliary with frozen labels, fine and coarse, and coverage. Both sides: key, label."""
    p = lambda a, b: parents.select(F.col("fine").alias(a), F.col("coarse").alias(b))
    j = frozen.select(key, F.col("label").alias("f")).join(auxiliary.select(key, F.col("label").alias("a")), key, "left")
    j = j.join(p("f", "fc"), "f", "left").join(p("a", "ac"), "a", "left")
    both = F.col("a").isNotNull()
    return j.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(both).alias("covered"),
        F.avg(F.when(both, (F.col("a") == F.col("f")).cast("int"))).alias("exact"),
        F.avg(F.when(both, F.coalesce(F.col("ac") == F.col("fc"), F.lit(False)).cast("int"))).alias("coarse"))


def eval_views(objects: DataFrame, parents: DataFrame, vocabulary: Sequence, key: str = "id") -> DataFrame:
    """Fine and coarse views over tier 1 and tier 1 or 2 labels: evaluable, unlabelled and out-of-space counts.

    objects(key, t1, t2)."""
    views = F.explode(F.array(
        F.struct(F.lit("t1").alias("tier"), F.col("t1").alias("label")), F.struct(F.lit("t1_t2").alias("tier"), F.coalesce("t1", "t2").alias("label"))))
    o = objects.select(key, views.alias("v")).select(key, "v.tier", "v.label").join(parents.select(F.col("fine").alias("label"), "coarse"), "label", "left")
    grain = F.explode(F.array(
        F.struct(F.lit("fine").alias("grain"), F.col("label").isin(*vocabulary).alias("inside")), F.struct(F.lit("coarse").alias("grain"), F.col("coarse").isNotNull().alias("inside"))))
    o = o.select("tier", "label", grain.alias("g")).select("tier", "g.grain", "label", F.coalesce("g.inside", F.lit(False)).alias("inside"))
    return o.groupBy("grain", "tier").agg(
        F.count_if(F.col("label").isNotNull() & F.col("inside")).alias("evaluable"), F.count_if(F.col("label").isNull()).alias("unlabelled"),
        F.count_if(F.col("label").isNotNull() & ~F.col("inside")).alias("out_of_space"))
