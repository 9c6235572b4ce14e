"""Projection against known lengths, polygons and tiles by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from portlake.functions import geometry as G
from portlake.functions import scores as S
from portlake.functions import text as X


def test_utm_known_values(spark):
    df = spark.createDataFrame([(3.0, 0.0, 31), (3.0, 45.0, 31), (3.0, -45.0, 31)], "lon double, lat double, zone int")
    p = [r.p for r in df.select(G.utm_forward(F.col("lon"), F.col("lat"), F.col("zone")).alias("p")).collect()]
    # meridian arcs of the ellipsoid times the scale on the central meridian
    assert [round(q.x, 3) for q in p] == [500000.0] * 3
    assert p[0].y == 0 and abs(p[1].y - 4984944.378 * 0.9996) < 0.01 and abs(p[2].y + p[1].y) < 1e-6


def test_utm_round_trip(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(0.2, 5.8, 50), rng.uniform(-70, 75, 50))], "lon double, lat double")
    df = df.withColumn("zone", G.utm_zone(F.col("lon"), F.col("lon"))).withColumn("p", G.utm_forward(F.col("lon"), F.col("lat"), F.col("zone")))
    b = df.select("lon", "lat", G.utm_inverse(F.col("p.x"), F.col("p.y"), F.col("zone")).alias("b")).collect()
    assert max(abs(r.b.lon - r.lon) + abs(r.b.lat - r.lat) for r in b) < 1e-9


def test_polygon(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (0.0, 1.0)],)], "p array<struct<x:double,y:double>>")
    r = df.select(G.poly_area(F.col("p")).alias("a"), G.poly_centroid(F.col("p")).alias("c"), G.long_axis_deg(F.col("p")).alias("d"), G.side_lengths(F.col("p")).alias("s")).head()
    assert (r.a, r.c.x, r.c.y, r.d, r.s) == (4.0, 2.0, 0.5, 0.0, [4.0, 1.0, 4.0, 1.0])


@pytest.mark.parametrize("a,b,want", [(10, 170, 20), (90, 0, 90), (179, 1, 2), (45, 45, 0)])
def test_axial_diff(spark, a, b, want):
    assert abs(spark.range(1).select(G.axial_diff(F.lit(float(a)), F.lit(float(b)))).head()[0] - want) < 1e-9


def test_tiles_and_ids(spark):
    df = spark.createDataFrame([(103.8, 1.2), (-0.1, -33.9)], "lon double, lat double")
    t = [r[0] for r in df.select(X.tile_name(F.col("lon"), F.col("lat"))).collect()]
    assert t == ["ESA_WorldCover_10m_2021_v200_N00E102_Map.tif", "ESA_WorldCover_10m_2021_v200_S36W003_Map.tif"]
    m = spark.createDataFrame([("123456789",), ("000000000",), ("12345678",)], "m string")
    assert [r[0] for r in m.select(X.valid_mmsi(F.col("m"))).collect()] == [True, False, False]


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([0.0, 0.0, 0.0],)], "s array<double>")
    r = df.select(S.argmax(F.col("s")).alias("a"), S.softmax(F.col("s")).alias("p"), S.margin(F.col("s")).alias("m"), S.energy(F.col("s")).alias("e")).collect()
    assert [x.a for x in r] == [1, 0] and [x.m for x in r] == [0.0, 0.0]
    assert abs(sum(r[0].p) - 1) < 1e-12 and abs(r[1].e - np.log(3)) < 1e-12


def test_long_axis_of_rectangles_of_size_0_equals_its_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rows = [(k, [0.1, 0.05 * k, 0.02 * k, z] + [0.0] * 60, 0) for k, z in enumerate((0.0, 0.3, -0.0, 1e-6, -0.2, 3.4e-5, 0.0))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["long_axis"]).fetchall())
    assert sorted(tuple(r) for r in entry.queries()["long_axis"](spark, str(tmp_path)).collect()) == want
    assert [f for _, f in want][:3] == [0.0, 36.0, 0.0]
