"""The `query` decorator and the two registries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query under `name`; `sql` follows a WITH list of the named surrogate views."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(Views(spark, sf_dir))

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            ORACLE[name] = with_views(views, sql)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, and fold -0.0 into 0.0."""
    return df.select(*[
        (F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes
    ])
