"""Models from Spark's own learning library: probes, domain odds, clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ordered import running
from .selective import hash_cap

# fixed values: odds limits, group pipeline
ODDS_LOW, ODDS_HIGH = 0.05, 20.0
GROUP_AXES, GROUPS = 16, 4


def vectors(df: DataFrame, columns: Sequence[str] | str, out: str = "_x") -> DataFrame:
    """ML vector from an array column or from several numeric columns."""
    if isinstance(columns, str):
        return df.withColumn(out, array_to_vector(F.col(columns)))
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep").transform(df)


def logistic_probe(train: DataFrame, test: DataFrame, columns, label: str, reg: float = 1e-3, weight: str | None = None, out: str = "probe") -> DataFrame:
    """Multinomial probe fitted on `train`; adds `<out>` (class) and `<out>_p` (array) to `test`."""
    lr = LogisticRegression(featuresCol="_x", labelCol=label, regParam=reg, maxIter=50, probabilityCol="_prob", predictionCol="_pred", rawPredictionCol="_raw")
    if weight:
        lr = lr.setWeightCol(weight)
    m = lr.fit(vectors(train, columns))
    r = m.transform(vectors(test, columns))
    return r.withColumns({out: F.col("_pred").cast("int"), out + "_p": vector_to_array("_prob")}).drop("_x", "_prob", "_pred", "_raw")


def density_ratio(source: DataFrame, target: DataFrame, columns, key: str) -> DataFrame:
    """Clipped odds that a source row comes from the target domain, from a classifier between the two."""
    both = source.select(key, *_names(columns), F.lit(0.0).alias("_d")).unionByName(target.select(key, *_names(columns), F.lit(1.0).alias("_d")))
    # balanced prior: the odds are then a ratio of densities
    r = logistic_probe(both, source, columns, "_d", out="_o")
    n = both.groupBy().agg(F.count_if(F.col("_d") == 0).alias("_a"), F.count_if(F.col("_d") == 1).alias("_b"))
    p = F.element_at("_o_p", 2)
    odds = p / F.greatest(F.lit(1e-12), 1 - p) * F.col("_a") / F.col("_b")
    return r.join(F.broadcast(n)).withColumn("ratio", F.least(F.lit(ODDS_HIGH), F.greatest(F.lit(ODDS_LOW), odds))).drop("_o", "_o_p", "_a", "_b")


def _names(columns) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def surrogate_risk(calibration: DataFrame, target: DataFrame, columns: Sequence[str], wrong: str, score: str, key: str, port: str, alpha: float) -> DataFrame:
    """Error model fitted on calibration rows; per port the longest score prefix whose predicted risk stays at or below
    `alpha`, with its coverage, realised risk and whether the target was met."""
    p = logistic_probe(calibration, target, columns, wrong, out="_e").withColumn("_risk", F.element_at("_e_p", 2))
    r = running(p.select(key, port, score, wrong, "_risk"), [port], [F.col(score).desc(), F.col(key)], {"r": F.col("_risk"), "w": F.col(wrong).cast("double")})
    g = r.groupBy(port).agg(F.max(F.when(F.col("run_r") / F.col("rn") <= alpha, F.struct("rn", "run_w", "run_r"))).alias("b"), F.max("n").alias("n"))
    risk = F.col("b.run_w") / F.col("b.rn")
    return g.select(
        port, "n", (F.coalesce(F.col("b.rn"), F.lit(0)) / F.col("n")).alias("coverage"), (F.col("b.run_r") / F.col("b.rn")).alias("predicted_risk"),
        risk.alias("risk"), F.coalesce(risk <= alpha, F.lit(False)).alias("met"))


def scaled_surrogate_thresholds(df: DataFrame, surrogates: Sequence[str], keys: Sequence[str], score: str, key: str, alpha: float) -> DataFrame:
    """Each surrogate scaled to mean one on the calibration rows; threshold of the longest score prefix whose mean
    surrogate stays at or below `alpha`."""
    long = df.select(key, *keys, score, F.explode(F.array(*[F.struct(F.lit(s).alias("surrogate"), F.col(s).alias("_v")) for s in surrogates])).alias("_s")).select(key, *keys, score, "_s.*")
    m = long.groupBy(*keys, "surrogate").agg(F.greatest(F.avg("_v"), F.lit(1e-6)).alias("_m"))
    r = running(long.join(F.broadcast(m), [*keys, "surrogate"]), [*keys, "surrogate"], [F.col(score).desc(), F.col(key)], {"v": F.col("_v") / F.col("_m")})
    return r.groupBy(*keys, "surrogate").agg(
        F.max(F.when(F.col("run_v") / F.col("rn") <= alpha, F.struct("rn", F.col(score).alias("s")))).alias("b"), F.max("n").alias("n")).select(
        *keys, "surrogate", "n", F.col("b.s").alias("threshold"), F.coalesce(F.col("b.rn"), F.lit(0)).alias("accepted"))


def calibrated_gate(source: DataFrame, target: DataFrame, difference: str, better: str) -> DataFrame:
    """Switch point of a one-feature logistic on source score differences; adds `use_expert` to `target`."""
    m = LogisticRegression(featuresCol="_x", labelCol=better, maxIter=50).fit(vectors(source.select(F.col(difference).cast("double").alias(difference), better), [difference]))
    a = float(m.coefficients[0])
    point = -float(m.intercept) / a if abs(a) > 1e-9 else 0.0
    return target.withColumns({"switch_point": F.lit(point), "use_expert": F.col(difference) > point})


def group_assign(df: DataFrame, port: str, key: str, vector: str, sources: Column, cap: int | None = None, axes: int = GROUP_AXES, groups: int = GROUPS) -> DataFrame:
    """Scale, project and cluster all source rows (or `cap` rows a port in hash order), then give every row its nearest frozen centre (`grp`)."""
    rows = df.where(sources).select(port, key, vector)
    train = hash_cap(rows, [port], key, cap) if cap else rows
    pipe = Pipeline(stages=[
        StandardScaler(inputCol="_x", outputCol="_s", withMean=True, withStd=True), PCA(k=axes, inputCol="_s", outputCol="_p"),
        KMeans(k=groups, seed=1, featuresCol="_p", predictionCol="grp", maxIter=30)])
    return pipe.fit(vectors(train, vector)).transform(vectors(df, vector)).drop("_x", "_s", "_p")


def geo_regions(ports: DataFrame, lon: str, lat: str, k: int) -> DataFrame:
    """Ports clustered by position; the cluster is the fold."""
    return KMeans(k=k, seed=1, featuresCol="_x", predictionCol="region", maxIter=30).fit(vectors(ports, [lon, lat])).transform(vectors(ports, [lon, lat])).drop("_x")


def stacked_policy(train: DataFrame, test: DataFrame, heads: Sequence[str], label: str) -> DataFrame:
    """Probe on the concatenated scores of all heads."""
    cat = lambda d: d.withColumn("_cat", F.concat(*[F.col(h) for h in heads]))
    return logistic_probe(cat(train), cat(test), "_cat", label, out="stacked").drop("_cat", "stacked_p")
