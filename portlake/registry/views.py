"""Surrogate views: the given tables dressed as the tables the operators expect.

Every view exists twice, as a Spark frame and as SQL; both use the same double arithmetic in the same order.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = 10
PORTS = 8


def _e(i: int) -> str:
    return f"CAST(e[{i}] AS DOUBLE)"


def _score(c: int, lo: int, hi: int) -> str:
    return "round(" + " + ".join(_e(i) for i in range(lo, hi + 1) if i % CLASSES == c) + ", 6)"


def _scores(lo: int, hi: int) -> str:
    return ", ".join(_score(c, lo, hi) for c in range(CLASSES))


# one definition per view; {E} holds the vector as `e`, array literals differ per engine
_BODIES = {
    "objects": (
        "emb",
        "SELECT vec_id AS object_id, vec_id % 8 AS port, vec_id % 40 AS product, {div40} % 2 AS pol, {div80} % 4 AS tile, "
        f"round({_e(1)} * 10000, 3) AS x, round({_e(2)} * 10000, 3) AS y, "
        f"((round({_e(3)} * 1800, 3) % 180) + 180) % 180 AS axis_deg, round(abs({_e(4)}) * 300, 2) AS size, "
        f"round(abs({_e(5)}) * 5, 4) AS conf, round(abs({_e(6)}) * 8000, 2) AS d_coast, label AS cls, "
        "CASE WHEN vec_id % 7 = 0 THEN 'failed' ELSE 'passed' END AS screen_status FROM emb",
    ),
    "facilities": (
        "emb",
        "SELECT vec_id AS facility_id, {div10} % 8 AS port, CASE WHEN label % 2 = 0 THEN 'liquid' ELSE 'dry' END AS kind, "
        "CASE WHEN vec_id % 20 = 0 THEN 'way' ELSE 'node' END AS element, "
        f"round({_e(1)} * 10000, 3) AS x1, round({_e(2)} * 10000, 3) AS y1, "
        f"round({_e(1)} * 10000, 3) + round({_e(4)} * 2000, 3) AS x2, round({_e(2)} * 10000, 3) + round({_e(5)} * 2000, 3) AS y2 "
        "FROM emb WHERE vec_id % 10 = 0",
    ),
    "preds": (
        "emb",
        "SELECT *, {argmax_s1} AS p1, {argmax_s2} AS p2, round({top_s1} - {second_s1}, 6) AS m1, round({top_s2} - {second_s2}, 6) AS m2 FROM ("
        f"SELECT vec_id AS id, vec_id % 8 AS port, vec_id % 40 AS product, label AS truth, {{open}}{_scores(1, 32)}{{close}} AS s1, "
        f"{{open}}{_scores(33, 64)}{{close}} AS s2 FROM emb) q",
    ),
}
_SPARK = {
    "div10": "(vec_id div 10)", "div40": "(vec_id div 40)", "div80": "(vec_id div 80)", "open": "array(", "close": ")",
    **{f"argmax_{s}": f"CAST(array_position({s}, array_max({s})) - 1 AS INT)" for s in ("s1", "s2")},
    **{f"top_{s}": f"element_at(sort_array({s}, false), 1)" for s in ("s1", "s2")},
    **{f"second_{s}": f"element_at(sort_array({s}, false), 2)" for s in ("s1", "s2")},
}
_DUCK = {
    "div10": "(vec_id // 10)", "div40": "(vec_id // 40)", "div80": "(vec_id // 80)", "open": "[", "close": "]",
    **{f"argmax_{s}": f"CAST(list_position({s}, list_max({s})) - 1 AS INT)" for s in ("s1", "s2")},
    **{f"top_{s}": f"list_sort({s}, 'DESC')[1]" for s in ("s1", "s2")},
    **{f"second_{s}": f"list_sort({s}, 'DESC')[2]" for s in ("s1", "s2")},
}

_SQL = {
    "emb": "SELECT vec_id, label, embedding AS e FROM embeddings",
    **{k: body.format(**_DUCK) for k, (_, body) in _BODIES.items()},
    "features": "SELECT vec_id AS id, vec_id % 8 AS port, vec_id % 40 AS product, label AS y, list_transform(e, lambda z: CAST(z AS DOUBLE)) AS v FROM emb",
    "dims": "SELECT id, port, product, y, CAST(d - 1 AS INT) AS d, v[d] AS x FROM features, (SELECT unnest(range(1, 65)) AS d) r",
    "ais": "SELECT event_id, user_id AS mmsi, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS t, CAST(strftime(ts, '%d') AS INT) AS product, "
           "CAST(strftime(ts, '%d') AS INT) % 8 AS port, "
           "round(value * 100, 3) AS x, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) * 100 AS y, event_type AS type_code FROM events",
    "registry": "SELECT o_orderkey AS product, CAST(o_orderdate AS DATE) AS date, n_name AS port, r_name AS region, o_custkey AS owner, "
                "o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey "
                "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "mapping": "SELECT c_custkey AS mmsi, CASE WHEN c_custkey % 5 = 0 THEN 'conflict_sources' WHEN c_custkey % 5 = 1 THEN 'needs_manual' ELSE 'fine_class_mapped' END AS status, "
               "CASE WHEN c_custkey % 5 = 1 THEN NULL ELSE c_mktsegment END AS final_class, "
               "concat(c_nationkey, ';', 100 + c_custkey % 4) AS codes FROM customer",
    "gold": "SELECT l.doc_id AS id, d.lang AS port, d.source AS product, l.quality AS truth, l.toxic AS weak, d.n_chars AS size FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "cells": "SELECT port, CAST(floor(x / 1000) AS BIGINT) AS cx, CAST(floor(y / 1000) AS BIGINT) AS cy, "
             "CAST((((floor(x / 1000) * 7 + floor(y / 1000) * 13) % 4) + 4) % 4 AS INT) AS code, count(*) AS n FROM objects GROUP BY ALL",
}
_NEEDS = {
    "objects": ["emb"], "facilities": ["emb"], "preds": ["emb"], "features": ["emb"], "dims": ["emb", "features"],
    "cells": ["emb", "objects"],
}


def with_views(names: str, sql: str) -> str:
    """Prefix `sql` with the named views; `sql` starts with SELECT or with `, more AS (...) SELECT`."""
    order: list[str] = []
    for n in names.split():
        for m in [*_NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    if not order:
        return sql
    return ("WITH RECURSIVE " if " reach AS (" in sql else "WITH ") + ", ".join(f"{n} AS ({_SQL[n]})" for n in order) + " " + sql


class Views:
    """Spark side of the surrogate views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def emb(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "label", F.col("embedding").alias("e"))

    def _body(self, name: str) -> DataFrame:
        body = _BODIES[name][1].format(**_SPARK)
        for i in range(1, 65):
            body = body.replace(f"e[{i}]", f"element_at(e, {i})")
        return self.spark.sql(body.replace("FROM emb", "FROM {emb}"), emb=self.emb)

    @cached_property
    def objects(self) -> DataFrame:
        return self._body("objects")

    @cached_property
    def facilities(self) -> DataFrame:
        return self._body("facilities")

    @cached_property
    def preds(self) -> DataFrame:
        return self._body("preds")

    @cached_property
    def features(self) -> DataFrame:
        return self.emb.select(
            F.col("vec_id").alias("id"), (F.col("vec_id") % 8).alias("port"), (F.col("vec_id") % 40).alias("product"),
            F.col("label").alias("y"), F.col("e").cast("array<double>").alias("v"))

    @cached_property
    def dims(self) -> DataFrame:
        return self.features.select("id", "port", "product", "y", F.posexplode("v").alias("d", "x"))

    @cached_property
    def ais(self) -> DataFrame:
        ts = F.col("ts").cast("timestamp")
        return self.table("events").select(
            "event_id", F.col("user_id").alias("mmsi"), F.floor(F.unix_micros(ts) / 1e6).alias("t"), F.dayofmonth(ts).alias("product"),
            (F.dayofmonth(ts) % 8).alias("port"),
            F.round(F.col("value") * 100, 3).alias("x"), (F.regexp_extract("props", "([0-9]+)", 1).cast("double") * 100).alias("y"),
            F.col("event_type").alias("type_code"))

    @cached_property
    def registry(self) -> DataFrame:
        o, c, n, r = (self.table(t) for t in ("orders", "customer", "nation", "region"))
        j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        return j.select(
            F.col("o_orderkey").alias("product"), F.to_date("o_orderdate").alias("date"), F.col("n_name").alias("port"),
            F.col("r_name").alias("region"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))

    @cached_property
    def mapping(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("mmsi"),
            F.when(k % 5 == 0, "conflict_sources").when(k % 5 == 1, "needs_manual").otherwise("fine_class_mapped").alias("status"),
            F.when(k % 5 != 1, F.col("c_mktsegment")).alias("final_class"),
            F.concat(F.col("c_nationkey").cast("string"), F.lit(";"), (100 + k % 4).cast("string")).alias("codes"))

    @cached_property
    def gold(self) -> DataFrame:
        return self.table("labels").join(self.table("documents").select("doc_id", "lang", "source", "n_chars"), "doc_id").select(
            F.col("doc_id").alias("id"), F.col("lang").alias("port"), F.col("source").alias("product"),
            F.col("quality").alias("truth"), F.col("toxic").alias("weak"), F.col("n_chars").alias("size"))

    @cached_property
    def cells(self) -> DataFrame:
        fx, fy = F.floor(F.col("x") / 1000), F.floor(F.col("y") / 1000)
        return self.objects.select("port", fx.alias("cx"), fy.alias("cy"), F.pmod(fx * 7 + fy * 13, F.lit(4)).cast("int").alias("code")).groupBy(
            "port", "cx", "cy", "code").agg(F.count(F.lit(1)).alias("n"))
