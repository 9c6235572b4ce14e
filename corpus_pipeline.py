"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents that the one before it kept, written to Parquet in the shared folder and read
again, so a lost executor costs a stage no more than its own tasks.  All stages but the last return the columns of
`documents`; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portlake.llm import decontam, langid, ngram_join, packing, quality, text
from portlake.session import bound_batches, cut, ship

#: Models are fitted and texts are encoded in the stages, which SQL cannot express.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; dictionaries come from the labelled two thirds of these documents."""
    told = langid.classify(docs, langid.fit(docs.where(text.in_fold())), keep=tuple(docs.columns))
    # the kept columns come last, so doc_id is taken from them by its place
    return told.where("NOT rejected").drop("lang_pred", "score", "margin", "rejected").toDF("_id", *docs.columns).drop("_id")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier."""
    model = quality.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    told = quality.assess(docs, model, keep=tuple(docs.columns))
    return told.where("kept").toDF(*[f"_{k}" for k in range(len(told.columns) - len(docs.columns))], *docs.columns).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest doc_id.

    Of rows that repeat its id and text, the first by their other columns stays.  Of a class without ids one text stays.
    """
    told = ngram_join.similar(docs)
    first = told.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))).select("doc_id", "text_hash").distinct()
    first = first.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    hashed = docs.withColumn("_text", text.text_hash())
    stay = hashed.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")))
    others = [c for c in docs.columns if c != "doc_id"]
    one = stay.groupBy("doc_id", "_text").agg(F.min(F.struct(*others)).alias("_row"))
    return one.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"_row.{c}").alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (text.text_hash() == F.col("_hash")), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with checksums of their ids."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def bounded(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """`stage`, with texts in batches that leave room for the tables of an executor's workers."""

    def told(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return told


_STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("ngram_join", near_duplicates), ("decontamination", decontamination), ("packing", packed)]
STAGES = [(name, bounded(stage)) for name, stage in _STAGES]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
