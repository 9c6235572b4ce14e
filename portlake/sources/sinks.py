"""Writers: map features, partitioned tables, shard merges and resumable appends."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

#: Folders of an appended table, and the column that names them.
BUCKETS, BUCKET = 64, "_bucket"


def geojson_rows(objects: DataFrame, keys: Sequence[str], props: Sequence[str], pts: str = "pts") -> DataFrame:
    """One GeoJSON polygon feature per object; the ring is closed. `pts` holds lon/lat as x/y."""
    ring = F.concat(F.col(pts), F.slice(F.col(pts), 1, 1))
    coords = F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*[F.col(p) for p in props]).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry"),
    )
    return objects.select(*keys, F.to_json(feature).alias("value"))


def write_geojson(objects: DataFrame, path: str, partition: str, props: Sequence[str], pts: str = "pts") -> None:
    geojson_rows(objects, [partition], props, pts).write.mode("overwrite").partitionBy(partition).text(path)


def write_partitioned(df: DataFrame, path: str, partition: str, order: Sequence, provenance: dict | None = None) -> None:
    """Write per-partition CSV tables, sorted inside each file, next to a small provenance table."""
    df.sortWithinPartitions(partition, *order).write.mode("overwrite").partitionBy(partition).option("header", True).csv(path)
    if provenance is not None:
        meta = df.groupBy(partition).agg(F.count(F.lit(1)).alias("rows")).withColumns(
            {k: F.lit(str(v)) for k, v in provenance.items()} | {"generated": F.current_timestamp()})
        meta.write.mode("overwrite").json(path.rstrip("/") + "_provenance")


def merge_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; a column missing in a shard is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)


def _same(keys: Sequence[str]) -> Column:
    """Equal keys; two nulls are equal."""
    return reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys])


def resume_filter(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the sink does not hold yet; a null in a key equals a null."""
    return todo.alias("t").join(done.select(*keys).distinct().alias("d"), _same(keys), "left_anti")


def first_of_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key (nulls are equal): the first by the text of its other columns, so that a replay writes the same one."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})).alias("_r"))
    return one.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append_new(todo: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Append the rows a table lacks; the first run creates it.

    The table lies in `buckets` folders by a hash of the key, and only the folders that the new rows fall into are read, so an append
    costs what it touches.  A replay adds nothing, rows with null keys included.  `buckets` stays what it was at the first run."""
    spark: SparkSession = todo.sparkSession
    new = first_of_key(todo, keys).withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    if _exists(spark, path):
        new = cut(new)
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most `buckets` numbers
        held = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))
        new = resume_filter(new, held, [*keys, BUCKET])
    new.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(path)


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that `append_new` wrote."""
    return spark.read.parquet(path).drop(BUCKET)
