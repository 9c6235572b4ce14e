"""Cell joins against brute force, including crowded cells, copies and isolated points."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from portlake.grid import near_segments, radius_sums
from portlake.operators import spatial as D
from portlake.operators import tracks as T


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    berth = rng.normal(0, 30, (150, 2))
    wide = rng.uniform(-6000, 6000, (120, 2))
    copies = np.repeat([[700.0, 700.0]], 40, 0)
    lone = np.array([[90000.0, -90000.0], [-250000.0, 10.0]])
    xy = np.round(np.vstack([berth, wide, copies, lone]), 3)
    pdf = pd.DataFrame({"id": np.arange(len(xy)), "port": "A", "x": xy[:, 0], "y": xy[:, 1], "w": rng.uniform(1, 2, len(xy))})
    return pdf, spark.createDataFrame(pdf)


def dist(pdf):
    xy = pdf[["x", "y"]].to_numpy()
    return np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))


def test_radius_sums(points):
    pdf, df = points
    d = dist(pdf)
    got = radius_sums(df, ["port"], {"a": 25.0, "b": 400.0, "c": 3000.0}, {"w": F.col("w")}).toPandas()
    m = pdf.merge(got, on=["port", "x", "y"]).sort_values("id")
    for k, r in {"a": 25.0, "b": 400.0, "c": 3000.0}.items():
        assert (m[f"n_{k}"].to_numpy() == (d <= r).sum(1)).all()
        assert np.allclose(m[f"w_{k}"], (d <= r) @ pdf.w.to_numpy())


def test_nn_distance(points):
    pdf, df = points
    d = dist(pdf)
    np.fill_diagonal(d, np.inf)
    got = D.nn_distance(df, ["port"], first=20.0).toPandas().sort_values("id")
    assert np.allclose(got.nn, d.min(1))


def test_lone_object_has_no_neighbour(spark):
    df = spark.createDataFrame([(1, "A", 0.0, 0.0), (2, "B", 1.0, 1.0)], "id int, port string, x double, y double")
    assert [r.nn for r in D.nn_distance(df, ["port"]).collect()] == [None, None]


def test_near_components(points):
    pdf, df = points
    d = dist(pdf)
    got = D.near_components(df, ["port"], "id", 150.0).toPandas().set_index("id").component
    label = np.arange(len(pdf))
    while True:
        new = np.array([label[d[i] <= 150.0].min() for i in range(len(pdf))])
        if (new == label).all():
            break
        label = new
    assert (got.loc[pdf.id].to_numpy() == label).all()


def test_near_segments(spark, points):
    pdf, df = points
    rng = np.random.default_rng(9)
    seg = pd.DataFrame(rng.uniform(-6000, 6000, (30, 4)), columns=["x1", "y1", "x2", "y2"]).assign(port="A", s=np.arange(30))
    seg.loc[0, ["x2", "y2"]] = seg.loc[0, ["x1", "y1"]].to_numpy()
    got = near_segments(df, spark.createDataFrame(seg), ["port"], 500.0).select("id", "s", "dist").toPandas().set_index(["id", "s"]).dist
    n = 0
    for p in pdf.itertuples():
        for q in seg.itertuples():
            dx, dy = q.x2 - q.x1, q.y2 - q.y1
            t = 0 if dx == dy == 0 else np.clip(((p.x - q.x1) * dx + (p.y - q.y1) * dy) / (dx * dx + dy * dy), 0, 1)
            e = np.hypot(p.x - q.x1 - t * dx, p.y - q.y1 - t * dy)
            if e <= 500:
                n += 1
                assert abs(got[(p.id, q.s)] - e) < 1e-6
    assert n == len(got)


def test_track_steps_across_windows(spark):
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.integers(1, 1500, 3000))
    pdf = pd.DataFrame({"event_id": np.arange(3000), "mmsi": 1, "t": t, "x": np.cumsum(rng.normal(0, 40, 3000)), "y": np.cumsum(rng.normal(0, 40, 3000))})
    got = T.track_steps(spark.createDataFrame(pdf), ["mmsi"]).toPandas().sort_values("event_id")
    dt, dx, dy = pdf.t.diff(), pdf.x.diff(), pdf.y.diff()
    keep = (dt > 0) & (dt <= 600) & (np.hypot(dx, dy) >= 20)
    assert got.event_id.tolist() == pdf.event_id[keep].tolist()
    assert np.allclose(got.dx, dx[keep])


def test_sessions_across_windows(spark):
    rng = np.random.default_rng(4)
    t = np.cumsum(rng.choice([30, 500, 900], 2000, p=[0.6, 0.37, 0.03]))
    got = T.visit_sessions(spark.createDataFrame(pd.DataFrame({"mmsi": 1, "t": t})), ["mmsi"]).toPandas().sort_values("start")
    cut = np.flatnonzero(np.diff(t) > 600)
    assert got.start.tolist() == t[np.r_[0, cut + 1]].tolist() and got.end.tolist() == t[np.r_[cut, len(t) - 1]].tolist()
    assert got.fixes.sum() == 2000


def test_areas_with_holes_and_far_larger_than_a_cell(spark):
    from portlake.grid import inside_areas

    def ring(area, x0, y0, x1, y1):
        c = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        return [("g", area, *map(float, c[i]), *map(float, c[(i + 1) % 4])) for i in range(4)]

    rings = spark.createDataFrame(ring("big", 0, 0, 500_000, 400_000) + ring("big", 100_000, 100_000, 200_000, 200_000) + ring("small", 10, 10, 20, 20), "g string, a string, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, "g", 15.0, 15.0), (2, "g", 150_000.0, 150_000.0), (3, "g", 499_000.0, 1.0), (4, "g", -1.0, 5.0), (5, "h", 15.0, 15.0)], "k int, g string, x double, y double")
    assert {tuple(r) for r in inside_areas(points, rings, ["g"], "k", "a").collect()} == {(1, "big"), (1, "small"), (3, "big")}


def test_all_geometry_types(spark):
    import json

    from portlake.sources.documents import explode_geojson, segments

    shapes = [
        {"type": "Point", "coordinates": [1, 2]}, {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}, {"type": "LineString", "coordinates": [[0, 0], [1, 1]]},
        {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]},
        {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]], [[5.5, 5.1], [5.6, 5.1], [5.6, 5.2], [5.5, 5.1]]]]},
        {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [9, 9]}, {"type": "LineString", "coordinates": [[0, 0], [2, 2]]}]}, None, {"type": "Circle", "coordinates": [1]}]
    doc = json.dumps({"features": [{"type": "Feature", "properties": {"osm_id": str(k), "osm_element": "way", "facility_kind": "f"}, "geometry": g} for k, g in enumerate(shapes)]})
    rows = explode_geojson(spark.createDataFrame([(doc,)], "value string"))
    n = {r.osm_id: (r.vertices, r.rings) for r in rows.groupBy("osm_id").agg(F.count("k").alias("vertices"), F.countDistinct("ring").alias("rings")).collect()}
    assert n == {"0": (1, 1), "1": (2, 2), "2": (2, 1), "3": (4, 2), "4": (4, 1), "5": (12, 3), "6": (3, 2), "7": (0, 1), "8": (0, 1)}
    assert {r.osm_id: r["count"] for r in segments(rows).groupBy("osm_id").count().collect()} == {"0": 1, "1": 2, "2": 1, "3": 2, "4": 3, "5": 9, "6": 2}


def test_traffic_field_from_positions(spark):
    """Vessels sailing east and west along a parallel: cells on their way, axis east, other boxes and bad ids left out."""
    from portlake.plans.traffic_field import traffic_field_geo

    rows = [(k, "123456789", 60 * k, 103.8 + 0.002 * k, 1.2) for k in range(60)] + [(300 + k, "123456781", 60 * k, 103.918 - 0.002 * k, 1.2) for k in range(60)] + [(100 + k, "000000000", 60 * k, 103.8 + 0.002 * k, 1.2) for k in range(60)] + [(200 + k, "123456780", 60 * k, 10.0 + k * 0.01, 1.2) for k in range(9)]
    ais = spark.createDataFrame(rows, "event_id long, mmsi string, t long, lon double, lat double")
    boxes = spark.createDataFrame([("S", 103.5, 1.0, 104.2, 1.5)], "port string, west double, south double, east double, north double")
    got = traffic_field_geo(ais, boxes, size=5000.0, min_points=8).collect()
    assert got and sum(r.points for r in got) <= 118
    for r in got:
        assert min(r.direction_deg, 180 - r.direction_deg) < 1 and 103.75 < r.cell_lon < 104.0 and abs(r.cell_lat - 1.2) < 0.05 and r.anisotropy > 100


def loop(points):
    """Edges of a closed ring."""
    return [(*a, *b) for a, b in zip(points, [*points[1:], points[0]])]


def brute_inside(x, y, edges):
    """Even-odd rule by a ray to the right, over all edges."""
    e = np.array(edges)
    straddle = (e[:, 1] > y) != (e[:, 3] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        meets = (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0]
    return bool((straddle & (x < meets)).sum() % 2)


def shapes():
    rng = np.random.default_rng(8)
    out = {}
    for k in range(6):  # stars of very different sizes, each with a hole
        turn = np.sort(rng.uniform(0, 2 * np.pi, 40 + 30 * k))
        r = 10.0 ** (1 + k) * rng.uniform(0.4, 1, len(turn))
        star = np.stack([50 * k + r * np.cos(turn), r * np.sin(turn)], 1).tolist()
        out[f"star{k}"] = loop(star) + loop([(50 * k + 0.1 * x, 0.1 * y) for x, y in zip(r * np.cos(turn), r * np.sin(turn))])
    teeth = []
    for k in range(150):  # a comb: every edge spans the whole height
        teeth += [(10.0 * k, 0.0), (10.0 * k + 3, 1000.0), (10.0 * k + 6, 1000.0), (10.0 * k + 7, 0.0)]
    out["comb"] = loop([*teeth, (1500.0, -5.0), (0.0, -5.0)])
    t = np.linspace(0, 2 * np.pi, 1500, endpoint=False)  # a ragged coast, and one long edge that closes it
    out["coast"] = loop([*zip((4000 * t / 6.3).tolist(), (300 * np.sin(5 * t) + rng.normal(0, 20, len(t))).tolist()), (4000.0, 5000.0), (0.0, 5000.0)])
    out["flat"] = loop([(0.0, 0.0), (100.0, 0.0), (50.0, 0.0)])
    out["line"] = loop([(5.0, 0.0), (5.0, 10.0)])
    out["grid"] = loop([(0.0, 0.0), (0.0, 64.0), (64.0, 64.0), (64.0, 32.0), (32.0, 32.0), (32.0, 0.0)])  # vertices on cell borders
    return out


def test_areas_of_all_shapes(spark):
    from portlake.grid import inside_areas

    rng = np.random.default_rng(9)
    xy = np.concatenate([rng.normal(0, 10.0**k, (60, 2)) for k in range(1, 7)] + [rng.uniform((-50, -350), (4100, 1100), (400, 2)), rng.uniform(0, 64, (60, 2)), np.repeat([[7.5, 8.25]], 30, 0)])
    held = shapes()
    rings = spark.createDataFrame([("g", a, *map(float, e)) for a, edges in held.items() for e in edges] + [("h", "star1", *map(float, e)) for e in held["star0"]], "p string, a string, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([("g", k, float(x), float(y)) for k, (x, y) in enumerate(xy)] + [("none", 10_000, 0.0, 0.0), ("g", 10_001, None, 0.0)], "p string, k long, x double, y double")
    want = {(k, a) for k, (x, y) in enumerate(xy) for a, edges in held.items() if brute_inside(x, y, edges)}
    assert {tuple(r) for r in inside_areas(points, rings, ["p"], "k", "a").collect()} == want
    assert inside_areas(points.limit(0), rings, ["p"], "k", "a").count() == inside_areas(points, rings.limit(0), ["p"], "k", "a").count() == 0


def test_area_index_grows_with_the_edges(spark):
    """Rows for each edge: a few cells and middle lines, for smooth, ragged and comb-shaped areas, and few edges a cell."""
    from portlake.grid import edge_cells

    for name, edges in shapes().items():
        rings = spark.createDataFrame([("g", name, *map(float, e)) for e in edges], "p string, a string, x1 double, y1 double, x2 double, y2 double")
        _, cells, lines = edge_cells(rings, ["p"], "a")
        assert cells.count() <= 6 * len(edges) + 20 and lines.count() <= 2 * len(edges) + 20, name
        assert cells.groupBy("cx", "cy").count().agg({"count": "max"}).first()[0] <= 60, name


def squares(n, seed=3):
    rng = np.random.default_rng(seed)
    c, h = np.round(rng.normal(0, 1200, (n, 2)), 3), 300.0 * rng.integers(1, 9, n)
    rows = []
    for k in range(n):
        for side in (h[k], h[k] / 4) if k % 3 == 0 else (h[k],):
            x, y = c[k]
            rows += [(1, k, "ab"[k % 2], *map(float, e)) for e in loop([(x - side, y - side), (x + side, y - side), (x + side, y + side), (x - side, y + side)])]
    return c, h, rows


SQUARES = "g int, a int, kind string, x1 double, y1 double, x2 double, y2 double"


def test_crowded_areas_without_pairs(spark, monkeypatch):
    """What is written grows with points and areas, not with their pairs; distances and the smallest id equal those of all pairs."""
    from portlake import grid

    c, h, rows = squares(700)
    xy = np.round(np.concatenate([np.random.default_rng(4).normal(0, 1500, (700, 2)), c[:50] + [[150.0, 0.0]], [[30_000.0, 0.0], [5_000.0, 5_000.0]]]), 3)
    points = spark.createDataFrame([(k, 1, float(x), float(y)) for k, (x, y) in enumerate(xy)], "k int, g int, x double, y double")
    written, real = [], grid.cut
    monkeypatch.setattr(grid, "cut", lambda df: (lambda d: written.append(d.count()) or d)(real(df)))
    segs = spark.createDataFrame(rows, SQUARES)
    hit = {r.k: r for r in D.facility_hit(points, segs, ["g"], "k", ["a", "kind"], "a", area="a").collect()}
    near = {r.k: r for r in D.proximity_by_group(points, segs, ["g"], "k", ["a"], area="a").collect()}
    capped = {r.k: r for r in D.nearest_within(points, segs, ["g"], "k", ["a", "b"], "kind", area="a").collect()}
    assert sum(written) < 150 * len(xy)
    far = np.abs(xy[:, None] - c[None]).max(2)
    out = np.hypot(*np.maximum(np.abs(xy[:, None] - c[None]) - h[None, :, None], 0).transpose(2, 0, 1))
    hole = np.where(np.arange(len(c)) % 3 == 0, h / 4, 0)
    d = np.where(far < hole, hole - far, np.where(far <= h, 0, out))
    for k in range(len(xy)):
        best = min((v, a) for a, v in enumerate(d[k]))
        assert (hit[k].dist, hit[k].a) == (pytest.approx(best[0], abs=1e-6), best[1]) if best[0] <= 25 else hit[k].dist is None, k
        assert abs(near[k].d_any - best[0]) < 1e-6 if best[0] <= 2000 else k not in near
        assert abs(capped[k].d_a - min(2000, d[k, ::2].min())) < 1e-6 and abs(capped[k].d_b - min(2000, d[k, 1::2].min())) < 1e-6


def test_nearest_of_areas_of_all_shapes(spark):
    """Insides by the even-odd rule for ragged rings, with lines of smaller and larger id on the points."""
    from portlake.grid import nearest_features

    rng = np.random.default_rng(19)
    held = shapes()
    names = {a: 2 * k + 2 for k, a in enumerate(held)}
    xy = np.round(np.concatenate([rng.normal(0, 10.0**k, (60, 2)) for k in range(1, 7)] + [rng.uniform((-50, -350), (4100, 1100), (300, 2)), rng.uniform(0, 64, (60, 2))]), 3)
    segs = [(1, names[a], names[a], *map(float, e)) for a, edges in held.items() for e in edges] + [(1, None, k, *map(float, xy[5 * k]), *map(float, xy[5 * k])) for k in range(1, 18, 2)]
    got = {(r.x, r.y): r for r in nearest_features(
        spark.createDataFrame([(1, float(x), float(y)) for x, y in xy], "g int, x double, y double"),
        spark.createDataFrame(segs, "g int, a int, f int, x1 double, y1 double, x2 double, y2 double"), ["g"], 400.0, ["f"], "a", 20.0).collect()}
    e = np.array([s[3:] for s in segs])
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    for x, y in xy.tolist():
        t = np.clip(np.divide((x - e[:, 0]) * dx + (y - e[:, 1]) * dy, dx * dx + dy * dy, out=np.zeros(len(e)), where=dx * dx + dy * dy > 0), 0, 1)
        all_ = [(d, s[2]) for d, s in zip(np.hypot(x - e[:, 0] - t * dx, y - e[:, 1] - t * dy), segs)] + [(0.0, names[a]) for a, edges in held.items() if brute_inside(x, y, edges)]
        d, f = min(all_)
        if d > 400:
            assert (x, y) not in got
        else:
            assert abs(got[x, y].dist - d) < 1e-6 and (d > 1e-9 or got[x, y].f == f), (x, y)


def test_reconcile_without_a_join(spark):
    """One grouping tells what only one side has; repeated keys count once and null keys equal null keys."""
    from portlake.operators.sets import reconcile

    side = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k int")
    got = reconcile(side(1, 1, 2, None, 3), side(3, 4, 4, None), "k")
    assert sorted(map(tuple, got.collect())) == [(1, "right"), (2, "right"), (4, "left")]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def most_rows(spark, df):
    """The most rows that a node of the plans made while `df` was counted."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    df.write.format("noop").mode("overwrite").save()
    plans, most = store.executionsList(), 0
    for k in range(before, plans.size()):
        told, values = plans.apply(k).metrics(), store.executionMetrics(plans.apply(k).executionId())
        for i in range(told.size()):
            if "output rows" in told.apply(i).name() and values.contains(told.apply(i).accumulatorId()):
                most = max(most, int(values.apply(told.apply(i).accumulatorId()).split("\n")[-1].split(" ")[0].replace(",", "")))
    return most


def test_radius_sums_list_no_pairs_of_positions(spark):
    """every position lies on the rim of the circles of most others, in crowds smaller than a cell of the grid."""
    rng = np.random.default_rng(8)
    xy = np.round(rng.normal(0, 40, (4000, 2)) + rng.choice([0.0, 1000.0], (4000, 1)), 3)
    xy[:5] = [[np.nan, 1.0], [np.inf, 0.0], [5.0, 5.0], [5.0, 5.0], [900000.0, 2.0]]
    pdf = pd.DataFrame({"port": "A", "x": xy[:, 0], "y": xy[:, 1], "w": rng.uniform(1, 2, len(xy))})
    pdf.loc[7, "w"] = np.inf
    df = spark.createDataFrame(pdf)
    radii = {"a": 30.0, "b": 1000.0, "c": 1414.0}
    got = radius_sums(df, ["port"], radii, {"w": F.col("w")}, least=256)
    assert most_rows(spark, got) < 50 * len(pdf)
    m = pdf[5:].merge(got.toPandas(), on=["port", "x", "y"])
    real = pdf[2:]
    d = np.sqrt(((m[["x", "y"]].to_numpy()[:, None] - real[["x", "y"]].to_numpy()[None]) ** 2).sum(2))
    for k, r in radii.items():
        assert (m[f"n_{k}"].to_numpy() == (d <= r).sum(1)).all()
        want = np.where(d <= r, real.w.to_numpy()[None], 0.0).sum(1)
        assert np.allclose(m[f"w_{k}"], want) and np.isinf(want).any() and np.isfinite(want).any()


def test_nearest_position_of_a_crowd_begins_finer(spark):
    rng = np.random.default_rng(9)
    xy = np.round(np.vstack([rng.normal(0, 10, (1500, 2)), rng.uniform(-5000, 5000, (20, 2))]), 3)
    pdf = pd.DataFrame({"id": range(len(xy)), "port": "A", "x": xy[:, 0], "y": xy[:, 1]})
    got = D.nn_distance(spark.createDataFrame(pdf), ["port"])
    assert most_rows(spark, got) < 200 * len(pdf)
    d = dist(pdf)
    np.fill_diagonal(d, np.inf)
    assert np.allclose(got.toPandas().sort_values("id").nn, d.min(1))
