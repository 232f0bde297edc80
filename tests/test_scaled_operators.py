"""Operators that work in parts, against the same thing done whole."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.functions import polygons
from tessella.operators import alignment, candidates, graph, matching, ordering, verification


def test_numbered_is_the_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(50), rng.choice([None, "a", "b"])) for i in range(3000)]
    got = ordering.numbered(spark.createDataFrame(rows, "id long, x int, s string").repartition(7), [F.col("x"), F.col("s"), F.col("id")]).collect()
    want = sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "", r[0]))
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == [r[0] for r in want]
    assert sorted(r["place"] for r in got) == list(range(3000))
    assert ordering.numbered(spark.createDataFrame([], "id long"), [F.col("id")]).count() == 0


@pytest.mark.parametrize("mutual", [True, False])
@pytest.mark.parametrize("block", [1, 3, 7])
def test_descriptors_in_blocks_match_as_whole_images(spark, block, mutual):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(15, 6))
    rows = [(image, i, [float(x) for x in base[rng.integers(15)] + rng.normal(size=6) * 0.05]) for image, n in ((0, 14), (1, 9), (2, 1), (3, 20)) for i in range(n)]
    rows += [(1, 50, rows[3][2]), (1, 51, rows[3][2]), (3, 60, [float("nan")] * 6)]
    d = spark.createDataFrame(rows, "image long, idx long, vec array<double>")
    key = lambda r: (r["a"], r["b"], r["ia"], r["ib"], round(r["score"], 9))
    whole = sorted(map(key, matching.descriptor_join(d, ratio=0.9, mutual=mutual).collect()))
    assert whole and sorted(map(key, matching.descriptor_join(d, ratio=0.9, mutual=mutual, block=block).collect())) == whole


def test_quota_by_group_is_the_walk_over_all(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(g * 10, g * 10 + 10), 2))): rng.random() for g in range(4) for _ in range(30)}
    rows = [(a, b, v) for (a, b), v in pairs.items()]
    used, kept = {}, []
    for a, b, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if len(kept) >= 4 * 12:
            break
        if used.get(a, 0) < 6 or used.get(b, 0) < 6:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            kept.append((a, b))
    got = candidates.quota(spark.createDataFrame(rows, "a long, b long, overlap double"), 6, 12).collect()
    assert [(r["a"], r["b"]) for r in got] == kept and len(kept) == 48


def test_breadth_first_takes_the_strongest_first(spark):
    rng = random.Random(6)
    edges = {tuple(sorted(rng.sample(range(40), 2))): rng.randrange(9) for _ in range(90)}
    near = {}
    for (a, b), w in edges.items():
        near.setdefault(a, []).append((-w, b))
        near.setdefault(b, []).append((-w, a))
    seen, at = [0], 0
    while at < len(seen):
        seen += [x for _, x in sorted(near.get(seen[at], [])) if x not in seen]
        at += 1
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, weight long")
    for count in (1, 5, 17, 100):
        assert graph.breadth_first(frame, 0, count) == seen[:count]


def test_only_links_with_another_way_round_can_go(spark):
    edges = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)]
    frame = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, graph.still_joined(frame, frame).collect())) == sorted(set(edges) - {(2, 3)})


def test_closest_pair_however_far(spark):
    rng = random.Random(2)
    for spread in (1.0, 1e6):
        points = [(i, rng.random() * spread, rng.random() * spread) for i in range(60)] + [(99, 50 * spread, 0.0)]
        want = min(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 for i, a in enumerate(points) for b in points[:i])
        assert candidates.closest_distance(spark.createDataFrame(points, "id long, x double, y double")).first()[0] == pytest.approx(want)
    two = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 7.0)], "id long, x double, y double")
    assert candidates.closest_distance(two).first()[0] == pytest.approx((5000**2 + 49) ** 0.5)
    assert candidates.closest_distance(two.limit(1)).first()[0] is None


def test_clipping_in_columns_is_clipping(spark):
    rng = np.random.default_rng(7)
    shapes = [rng.uniform(0, 10, 2) + polygons.rectangle(*rng.uniform(1, 8, 2)) @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) for t in rng.uniform(0, 6, 60)]
    shapes[1] = shapes[1][::-1]
    as_rows = lambda s: [(float(x), float(y)) for x, y in s]
    frame = spark.createDataFrame([(i, as_rows(a), as_rows(b)) for i, (a, b) in enumerate(zip(shapes, shapes[1:], strict=False))], "id int, p array<struct<x:double,y:double>>, q array<struct<x:double,y:double>>")
    got = {r["id"]: r["area"] for r in frame.select("id", F.abs(C.signed_area(C.clipped(F.col("p"), F.col("q")))).alias("area")).collect()}
    for i, (a, b) in enumerate(zip(shapes, shapes[1:], strict=False)):
        assert got[i] == pytest.approx(abs(polygons.area(polygons.clip(a, b))), abs=1e-9)


def test_upper_median_of_even_and_odd_numbers(spark):
    rows = [(n, float(v)) for n in range(1, 12) for v in random.Random(n).sample(range(100), n)] + [(20, None), (20, 3.0), (20, 9.0)]
    got = {r["k"]: r["m"] for r in spark.createDataFrame(rows, "k int, v double").groupBy("k").agg(verification.upper_median("v").alias("m")).collect()}
    for k in range(1, 12):
        own = sorted(v for n, v in rows if n == k)
        assert got[k] == own[k // 2]
    assert got[20] == 9.0


@pytest.mark.parametrize("model", ["translation", "similarity", "affine"])
def test_normal_blocks_are_those_of_numpy(spark, model):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(50, 4)) * 100
    sigma = rng.uniform(0.5, 2, 50)
    rows = [(0, 1, i, *map(float, p), float(s)) for i, (p, s) in enumerate(zip(points, sigma, strict=True))]
    got = alignment.normal_blocks(spark.createDataFrame(rows, "a long, b long, idx long, ax double, ay double, bx double, by double, sigma double"), model).first()
    pair = alignment.Pair(0, 1, points[:, :2], points[:, 2:], sigma)
    block, side = alignment.pair_block(model, pair, alignment._identity(model), alignment._identity(model), robust=False)
    assert np.allclose(got["block"], block.ravel()) and np.allclose(got["side"], side)
