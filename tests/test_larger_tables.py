"""Queries on rows that only larger tables have, and their operators on many rows."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import rows_of

from tessella.functions import models, polygons
from tessella.operators import alignment, candidates, long_pairs, problem, verification
from tessella.plans import catalog
from tessella.plans import models as plans


def agrees(spark, folder, name, **tables):
    """Whether a query gives the rows of its SQL over tables of (column, value) rows."""
    connection = duckdb.connect()
    for table, rows in tables.items():
        spark.createDataFrame(rows).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(folder))
    want = connection.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())
    return got


def suppliers(ids):
    return [{"s_suppkey": i, "s_name": f"s{i}", "s_nationkey": i % 25, "s_acctbal": float(i % 900)} for i in ids]


def customers(ids):
    return [{"c_custkey": i} for i in ids]


def test_axes_exactly_as_far_apart_as_their_reach(spark, tmp_path):
    """Their angle equals the reach, but for rounding (F10)."""
    agrees(spark, tmp_path, "j8_near_axes", supplier=suppliers([36, 37, 54, 87, 397, 586, 639, 667, 687, 693, 731, 999, 1027, 2171, 3573, 3927, 4546, 4716, 5794, 5847]))


def test_points_on_edges_far_from_the_origin(spark, tmp_path):
    """Points on an edge, of boxes whose corners are large numbers (F11)."""
    agrees(spark, tmp_path, "f5_contains", customer=customers([9068, 19148, 39498, 41828, 46868, 49388, 54428, 67028, 67218, 87188]))


def test_outlines_meet_points_in_cells(spark, tmp_path):
    """Boxes above and below a point are not compared with it (F6)."""
    got = agrees(spark, tmp_path, "j14_smallest_outline", supplier=suppliers(range(0, 300, 7)), customer=customers(range(4000)))
    assert "gy" in got._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_line_asks_for_each_place_once(spark, tmp_path):
    """Points and lines in one place are compared once, not each with each (F8)."""
    agrees(spark, tmp_path, "j13_nearest_edge", supplier=suppliers(range(2600)))
    asked = spark.range(40_000).select(F.col("id").alias("q"), (F.col("id") % 2).cast("double").alias("x"), F.lit(5.0).alias("y"))
    lines = spark.range(40_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(9.0).alias("x1"), F.lit(0.0).alias("y1"))
    start = time.monotonic()
    got = candidates.nearest_line(asked, lines, 30).collect()
    assert time.monotonic() - start < 20
    assert len(got) == 40_000 and {(r["a"], r["b"], r["distance"]) for r in got} == {(0, 1, 5.0)}


def slow_placement(photos, edges, sizes):
    """By going through all links for each photo."""
    left, maps, shift = sorted(photos), {}, 0.0
    while left:
        own = {left[0]: np.eye(3)}
        while ways := [(w, -k) for k, (a, b, w, _) in enumerate(edges) if (a in own) != (b in own)]:
            a, b, _, h = edges[-max(ways)[1]]
            own |= {b: own[a] @ np.linalg.inv(h)} if a in own else {a: own[b] @ h}
        corners = np.concatenate([models.apply(t, polygons.rectangle(*sizes[p])) for p, t in own.items()])
        low, high = np.nanmin(corners, axis=0), np.nanmax(corners, axis=0)
        maps |= {p: np.array([[1, 0, shift - low[0]], [0, 1, -low[1]], [0, 0, 1.0]]) @ t for p, t in own.items()}
        shift += high[0] - low[0] + 0.1 * max(max(s) for s in sizes.values())
        left = [p for p in left if p not in own]
    return maps


def test_placement_of_many_photos():
    """The same layout in time that grows with the links; before, a photo went through all links (F5)."""
    rng = np.random.default_rng(4)
    move = lambda a, b: np.array([[1, 0.01, 10.0 * a - 5.0 * b], [0, 1, 3.0], [0, 0, 1]])
    edges = [(a, b, float(rng.integers(5)), move(a, b)) for a in range(60) for b in (a + 1, a + 3) if a % 11 < 8 and b < 60]
    sizes = {i: (1000.0, 800.0) for i in range(60)}
    got, want = (f(list(range(60)), edges, sizes) for f in (problem.placement, slow_placement))
    assert list(got) == list(want) and all((got[p] == want[p]).all() for p in want)
    many = [(a, a + 1, 1.0, np.eye(3)) for a in range(20_000) if a % 16]
    start = time.monotonic()
    assert len(problem.placement(list(range(20_001)), many, {i: (10.0, 8.0) for i in range(20_001)})) == 20_001
    assert time.monotonic() - start < 20


def test_homography_of_many_points():
    """Memory that grows with the points; before, with their square (F7, F9)."""
    rng = np.random.default_rng(2)
    h = np.array([[1.1, 0.02, 5], [-0.03, 0.9, 7], [1e-5, 2e-5, 1]])
    a = rng.uniform(0, 1000, (100_000, 2))
    assert np.allclose(models.least_squares("homography", a, models.apply(h, a)), h, atol=1e-8)


@pytest.mark.parametrize("name", ["n2_translations", "n2_affine_layout", "k10_alignment_summary", "v7_model_choice"])
def test_layouts_leave_matches_where_they_are(spark, monkeypatch, name):
    """The same rows where no match comes to the driver (F2, F3, F4, F7)."""
    sf = "/root/testdata/sf0.001"
    want = [r.asDict() for r in catalog.QUERIES[name](spark, sf).collect()]
    monkeypatch.setattr(alignment, "MOST_ON_DRIVER", 0)
    monkeypatch.setattr(alignment, "problem", None)
    got = [r.asDict() for r in catalog.QUERIES[name](spark, sf).collect()]
    assert len(got) == len(want) > 0
    for g, w in zip(got, want, strict=True):
        assert all(g[k] == (pytest.approx(v, abs=1e-6) if isinstance(v, (float, list)) else v) for k, v in w.items())


def test_maps_of_spread_pairs(spark):
    """Also of pairs of a few matches, or in a row, that give no homography."""
    rows = [(0, 1, i, float(i * 37 % 101), float(i * 53 % 97), i * 37 % 101 * 1.2 + 3, i * 53 % 97 * 1.1 - 4, 1.0 + i % 3) for i in range(60)]
    rows += [(1, 2, i, float(i), 2.0 * i, i + 5.0, 2.0 * i, 1.0) for i in range(4)] + [(2, 3, 0, 1.0, 1.0, 2.0, 2.0, 1.0)]
    matches = spark.createDataFrame(rows, "a long, b long, idx long, ax double, ay double, bx double, by double, sigma double").repartition(5)
    want, got = alignment.pair_maps(alignment.problem(matches)), alignment.pair_maps(alignment.SpreadPairs(matches))
    assert [g is None for g in got] == [w is None for w in want] == [False, False, True]
    assert all(np.allclose(g, w, atol=1e-7) for g, w in zip(got[:2], want, strict=False))


def test_long_translations_are_those_of_one_task(spark, monkeypatch):
    """Pairs of very many matches are fitted where these are, by the same draws (F1)."""
    matches = plans._pairs(spark, "/root/testdata/sf0.001").withColumn("threshold", F.lit(4.0)).withColumn("ax", F.when(F.col("idx") % 50 == 0, float("nan")).otherwise(F.col("ax")))
    few = matches.where("a > 7 OR idx % 9 = 0")
    want = {r["a"]: r for r in verification.model_fits(few, "translation").collect()}
    monkeypatch.setattr(verification, "MOST_IN_A_TASK", 200)
    got = {r["a"]: r for r in verification.model_fits(few, "translation").collect()}
    assert set(got) == set(want) == set(range(10))
    for a, w in want.items():
        assert got[a]["inliers"] == w["inliers"]
        assert [*got[a]["transform"], got[a]["rmse"], got[a]["median_error"]] == pytest.approx([*w["transform"], w["rmse"], w["median_error"]])


@pytest.mark.parametrize("mode", ["automatic", "plane"])
def test_long_evidence_is_that_of_one_task(spark, monkeypatch, mode):
    """Pairs of very many matches are verified where these are, with the same draws; no task has a pair's matches (F1)."""
    matches = plans._pairs(spark, "/root/testdata/sf0.001").where("a < 6").withColumn("source", F.when(F.col("a") > 0, "s"))
    matches = matches.withColumn("bx", F.when(F.col("idx") % 50 == 0, float("nan")).when(F.col("idx") % 51 == 0, None).when(F.col("a") == 4, F.col("idx") * 7919 % 1009).otherwise(F.col("bx")))
    few = matches.where("a > 4 OR idx % 9 = 0").unionByName(matches.where("a < 3 AND ax < 300")).unionByName(matches.where("a = 1").withColumn("ax", F.col("ax") + 0.001 * F.col("idx")))
    run = lambda: {r["a"]: r.asDict() for r in verification.verify(few, mode).collect()}
    want = run()
    handed = []
    monkeypatch.setattr(verification, "MOST_IN_A_TASK", 70)
    monkeypatch.setattr(verification, "LongPairs", lambda rows, keys: handed.extend(keys) or long_pairs.LongPairs(rows, keys))
    got = run()
    assert set(got) == set(want) == set(range(6)) and len(handed) >= 4
    for a, w in want.items():
        for column, value in w.items():
            assert got[a][column] == (pytest.approx(value, rel=1e-6, abs=1e-9) if isinstance(value, float) or column == "transform" else value), (a, column)


def test_long_pairs_on_kernels_of_many_points():
    """Scores in blocks, hull corners and places are those of the plain functions (F1)."""
    rng = np.random.default_rng(3)
    m = np.column_stack([rng.uniform(0, 1000, (5000, 4)), rng.integers(1, 4, 5000)])
    maps = np.array([[[1, 0, d], [0.01 * d, 1, 3], [s * 1e-3, 0, 1]] for s in (0, 1, -2) for d in range(30)], float)
    got = long_pairs.scores(maps, m, 200.0)
    for h, (cost, inliers) in zip(maps, got, strict=True):
        r = models.residuals(h, m[:, :2], m[:, 2:4])
        assert cost == pytest.approx(m[:, 4] @ np.minimum(r, 200) ** 2) and inliers == m[r < 200, 4].sum()
    points = np.round(rng.normal(size=(4000, 2)), 1)
    assert {tuple(p) for p in polygons.corners(points)} == {tuple(p) for p in points[polygons.hull(points)]}
