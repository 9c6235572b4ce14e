"""Vessel profiles and class rules mined from curated vessels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, histogram_json
from .clean import confidence_tier

# fixed values: rule thresholds
PURITY_MIN, SUPPORT_MIN, LABEL_PURITY_MIN = 0.95, 5, 0.9
RESOLVED = "fine_class_mapped"

# fixed values: names of the sources a class may come from
BY_CODE, BY_REGISTRY, BY_LABEL, BY_HAND = "position_type_code", "registry_type_code", "web_label", "needs_manual"


def top_values(df: DataFrame, key: Sequence[str], value: str, k: int) -> DataFrame:
    """The k most frequent values per key with counts, ties to the smallest value."""
    c = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*key).orderBy(F.desc("n"), value)
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mode(df: DataFrame, key: Sequence[str], value: str, out: str) -> DataFrame:
    """Most frequent value per key, ties to the smallest."""
    c = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(value).alias("v"))).alias("b")).select(*key, F.col("b.v").alias(out))


def mmsi_profile(ais: DataFrame, key: str = "mmsi", code: str = "type_code", name: str = "name", length: str = "length", beam: str = "beam", names: int = 3) -> DataFrame:
    """Per vessel: rows, histogram of type codes, top names, most frequent length and beam.

    One scan: every row gives one (field, value) pair per field, and pairs are counted once for all fields."""
    kinds = dict(ais.dtypes)
    fields = {"row": F.lit(""), "code": F.col(code).cast("string"), "name": F.col(name).cast("string"), "length": F.col(length).cast("string"), "beam": F.col(beam).cast("string")}
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in fields.items()]))
    n = ais.select(key, pairs.alias("p")).select(key, "p.*").where("value is not null").groupBy(key, "field", "value").agg(F.count(F.lit(1)).alias("n"))
    of = lambda f, *cols: F.collect_list(F.when(F.col("field") == f, F.struct(*cols)))  # noqa: E731  a vessel's distinct values, most frequent first once sorted
    ranked = lambda f: F.array_sort(of(f, (-F.col("n")).alias("neg"), "value"))
    typed = lambda c: F.array_sort(of(c, (-F.col("n")).alias("neg"), F.col("value").cast(kinds[{"length": length, "beam": beam}[c]]).alias("value")))
    g = n.groupBy(key).agg(
        F.sum(F.when(F.col("field") == "row", F.col("n"))).alias("ais_rows"), of("code", F.col("value").alias(code), "n").alias("_codes"), ranked("name").alias("_names"),
        typed("length").alias("_length"), typed("beam").alias("_beam"))
    return g.select(
        key, "ais_rows", F.when(F.size("_codes") > 0, histogram_json(F.col("_codes"))).alias("type_codes"),
        F.when(F.size("_names") > 0, F.concat_ws("|", F.transform(F.slice("_names", 1, names), lambda s: s["value"]))).alias("names"),
        F.get("_length", F.lit(0))["value"].alias("length_mode"), F.get("_beam", F.lit(0))["value"].alias("beam_mode"))


def _purity(pairs: DataFrame, code: str, cls: str) -> DataFrame:
    """Counts of classes per code, to majority class, purity and support."""
    c = pairs.groupBy(code, cls).agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy(code).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(cls).alias("v"))).alias("b"), F.sum("n").alias("support"))
    return g.select(code, F.col("b.v").alias("rule_class"), (-F.col("b.neg") / F.col("support")).alias("purity"), "support")


def mine_rules(curated: DataFrame, codes: str = "codes", cls: str = "final_class", status: str = "status") -> DataFrame:
    """Type code to majority class with purity and support, from vessels whose class is settled."""
    e = curated.where((F.col(status) == RESOLVED) & blank_to_null(F.col(cls)).isNotNull())
    e = e.select(F.explode(F.split(F.col(codes), ";")).alias("code"), F.col(cls).alias("cls")).where("code <> ''")
    return _purity(e, "code", "cls")


def rule_distribution(curated: DataFrame, k: int = 6, codes: str = "codes", cls: str = "final_class", status: str = "status") -> DataFrame:
    """The k most frequent classes behind each code."""
    e = curated.where((F.col(status) == RESOLVED) & blank_to_null(F.col(cls)).isNotNull())
    e = e.select(F.explode(F.split(F.col(codes), ";")).alias("code"), F.col(cls).alias("cls")).where("code <> ''")
    return top_values(e, ["code"], "cls", k)


def mine_label_rules(curated: DataFrame, label: str, cls: str = "final_class", min_purity: float = LABEL_PURITY_MIN) -> DataFrame:
    """Source label to class where nearly all settled vessels agree."""
    e = curated.where(blank_to_null(F.col(label)).isNotNull() & blank_to_null(F.col(cls)).isNotNull())
    return _purity(e.select(F.lower(F.trim(F.col(label))).alias("label"), F.col(cls).alias("cls")), "label", "cls").where(F.col("purity") >= min_purity)


def apply_rules(vessels: DataFrame, rules: DataFrame, label_rules: DataFrame, min_purity: float = PURITY_MIN, min_support: int = SUPPORT_MIN) -> DataFrame:
    """Class of unresolved vessels: best observed code, else the registry code, else the scraped label, else manual.

    vessels(mmsi, ais_rows, codes array<string>, registry_code, scraped_label)."""
    good = rules.where((F.col("purity") >= min_purity) & (F.col("support") >= min_support))
    seen = vessels.select("mmsi", F.explode("codes").alias("code"), F.lit(0).alias("prio"), F.lit(BY_CODE).alias("source")).where("code <> '' and code <> '0'")
    reg = vessels.where(blank_to_null(F.col("registry_code")).isNotNull()).select("mmsi", F.col("registry_code").alias("code"), F.lit(1).alias("prio"), F.lit(BY_REGISTRY).alias("source"))
    by_code = seen.unionByName(reg).join(good, "code")
    by_label = vessels.where(blank_to_null(F.col("scraped_label")).isNotNull()).select(
        "mmsi", F.col("scraped_label").alias("code"), F.lit(2).alias("prio"), F.lit(BY_LABEL).alias("source"), F.lower(F.trim(F.col("scraped_label"))).alias("label"))
    by_label = by_label.join(label_rules, "label").drop("label")
    cand = by_code.unionByName(by_label)
    best = cand.groupBy("mmsi").agg(F.min(F.struct("prio", (-F.col("support")).alias("neg"), "code", "rule_class", "purity", "support", "source")).alias("b"))
    j = vessels.join(best, "mmsi", "left")
    return j.select(
        "mmsi", "ais_rows", F.col("b.rule_class").alias("final_class"), F.coalesce("b.source", F.lit(BY_HAND)).alias("source"),
        F.col("b.code").alias("type_code"), F.col("b.purity").alias("rule_purity"), F.col("b.support").alias("rule_support"),
        F.when(F.col("b.support").isNotNull(), confidence_tier(F.col("b.support"))).alias("confidence"))


def rule_summary(filled: DataFrame) -> DataFrame:
    """Vessels and rows per source of their class."""
    return filled.groupBy("source").agg(F.count(F.lit(1)).alias("vessels"), F.sum("ais_rows").alias("ais_rows"), F.countDistinct("final_class").alias("classes"))


def ais_length(ais: DataFrame, key: str, order: Sequence[str], bow: str, stern: str, beam: str | None = None, split_dims: bool = True) -> DataFrame:
    """First positive length (and beam) per vessel in file order.

    `split_dims`: the two fields are distances to bow and stern and add up; otherwise they are length and beam.
    """
    length = F.col(bow) + F.col(stern) if split_dims else F.col(bow)
    width = (F.col(beam) if beam else F.lit(None).cast("double")) if split_dims else F.col(stern)
    a = ais.withColumns({"_l": length, "_w": width}).where(F.col("_l") > 0)
    return a.groupBy(key).agg(F.min(F.struct(*order, F.col("_l").alias("_l"), F.col("_w").alias("_w"))).alias("b")).select(
        key, F.col("b._l").alias("length"), F.col("b._w").alias("beam"))
