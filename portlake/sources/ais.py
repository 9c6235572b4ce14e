"""Readers for position logs and delimited tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_ws, valid_mmsi

# fixed values: field positions of the headerless position log
FIELD_TIME, FIELD_MMSI, FIELD_LON, FIELD_LAT, FIELD_NAME, FIELD_TYPE = 0, 1, 6, 7, 10, 11
FIELD_DIMENSIONS = (14, 15, 16)
MIN_FIELDS = 18

# product folder in the path of a log file
PRODUCT_IN_PATH = r"([^/]+)/ais/[^/]+$"


def parse_ais(lines: DataFrame) -> DataFrame:
    """Split raw lines (`value`, and `product` if known) into typed columns.

    `ok_fields` and `ok_mmsi` mark the two kinds of bad row, which are counted separately downstream.
    """
    f = F.split(F.col("value"), ",")
    g = lambda k: F.get(f, F.lit(k))
    num = lambda k, t: F.trim(g(k)).try_cast(t)
    keep = [c for c in lines.columns if c != "value"]
    return lines.select(
        *keep,
        (F.size(f) >= MIN_FIELDS).alias("ok_fields"),
        num(FIELD_TIME, "bigint").alias("t"),
        clean_ws(g(FIELD_MMSI)).alias("mmsi"),
        num(FIELD_LON, "double").alias("lon"),
        num(FIELD_LAT, "double").alias("lat"),
        clean_ws(g(FIELD_NAME)).alias("name"),
        clean_ws(g(FIELD_TYPE)).alias("type_code"),
        *[num(k, "double").alias(f"dim{i}") for i, k in enumerate(FIELD_DIMENSIONS)],
    ).withColumn("ok_mmsi", F.col("ok_fields") & valid_mmsi(F.col("mmsi")))


def read_ais(spark: SparkSession, path: str) -> DataFrame:
    """Position log files; the product is the folder above `ais/` (else the file name)."""
    raw = spark.read.text(path)
    name = F.input_file_name()
    product = F.regexp_extract(name, PRODUCT_IN_PATH, 1)
    raw = raw.withColumn("product", F.when(product != "", product).otherwise(F.regexp_extract(name, r"([^/]+?)(\.[^/.]+)?$", 1)))
    return parse_ais(raw)


def usable(ais: DataFrame) -> DataFrame:
    """Rows with enough fields, a valid identity, a time and a position."""
    return ais.where(F.col("ok_mmsi") & F.col("t").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull())


def row_quality(ais: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, rows with too few fields and rows with a bad identity per key."""
    return ais.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("ok_fields")).alias("bad_fields"),
        F.count_if(F.col("ok_fields") & ~F.col("ok_mmsi")).alias("bad_mmsi"),
    )


def read_table(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Header CSV (gzip allowed) with every column a trimmed string, empty as null, BOM removed."""
    df = spark.read.csv(path, header=True, encoding=encoding, quote='"', escape='"', multiLine=False)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return df.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns])
