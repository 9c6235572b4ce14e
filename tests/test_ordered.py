"""Slab ranks, sums and quantiles against numpy, with a group that holds most rows and heavy ties."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from portlake.ordered import quantiles, running, value_ranks


def frame(spark, n=4000):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(n), "g": np.where(np.arange(n) % 3 > 0, "hot", (np.arange(n) % 7).astype(str)), "v": rng.integers(0, 9, n).astype(float)})
    return pdf, spark.createDataFrame(pdf)


def test_running_matches_pandas(spark):
    pdf, df = frame(spark)
    got = running(df, ["g"], [F.col("v").desc(), F.col("id")], {"v": F.col("v")}, parts=7).toPandas().sort_values("id")
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).assign(rn=lambda d: d.groupby("g").cumcount() + 1, run=lambda d: d.groupby("g").v.cumsum()).sort_values("id")
    assert (got.rn.to_numpy() == want.rn.to_numpy()).all()
    assert np.allclose(got.run_v, want.run)
    assert (got.n.to_numpy() == pdf.groupby("g").v.transform("size").to_numpy()).all()


def test_hot_group_is_spread(spark):
    _, df = frame(spark)
    from portlake.session import cut

    s = cut(df.repartitionByRange(8, "g", "v", "id").withColumn("_slab", F.spark_partition_id())).where("g = 'hot'")
    assert s.select("_slab").distinct().count() >= 4


def test_quantiles_exact(spark):
    pdf, df = frame(spark)
    got = quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.93}).toPandas().set_index("g")
    for g, rows in pdf.groupby("g"):
        assert np.allclose(got.loc[g, ["a", "b", "c"]].astype(float), np.quantile(rows.v, [0.1, 0.5, 0.93]))


def test_average_ranks(spark):
    pdf, df = frame(spark)
    got = value_ranks(df, ["g"], "v").toPandas()
    want = pdf.assign(r=pdf.groupby("g").v.rank()).drop_duplicates(["g", "v"])
    m = got.merge(want, on=["g", "v"])
    assert len(m) == len(want) and np.allclose(m.avg_rank, m.r)


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, 1.0), (3, "a", 5.0)], "id int, g string, v double")
    got = {r.id: (r.rn, r.n) for r in running(df, ["g"], [F.col("v")]).collect()}
    assert got == {1: (2, 2), 2: (1, 2), 3: (1, 1)}


def test_quantiles_of_a_value_that_fills_its_group(spark):
    from portlake.ordered import quantiles

    rows = [("a", 0.0)] * 900 + [("a", float(k)) for k in range(1, 101)] + [("b", 2.0), ("b", 4.0)]
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"q50": 0.5, "q95": 0.95}).collect()}
    import numpy as np
    a = [v for g, v in rows if g == "a"]
    assert got["a"].n == 1000 and got["a"].q50 == 0.0 and abs(got["a"].q95 - np.quantile(a, 0.95)) < 1e-9 and got["b"].q50 == 3.0
