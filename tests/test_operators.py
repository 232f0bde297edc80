"""Kernels and operators against ground truth with stated tolerances."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.config import Analysis
from tessella.functions import models, polygons
from tessella.operators import alignment, candidates, frames, graph, matching, raster, verification
from tessella.sources import photos, reports

FAST = Analysis(max_iterations=800)


def brute_matches(a, b, ratio, mutual):
    d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    out = []
    for i in range(len(a)):
        order = np.argsort(d[i], kind="stable")
        d1, d2 = math.sqrt(d[i, order[0]]), math.sqrt(d[i, order[1]])
        if d2 > 0 and d1 < ratio * d2 and (not mutual or np.argmin(d[:, order[0]]) == i):
            out.append((i, int(order[0])))
    return out


def test_descriptor_join_equals_brute_force(spark):
    rng = np.random.default_rng(42)
    a = rng.normal(size=(160, 32))
    b = np.concatenate([a[::2][:60] + rng.uniform(-0.05, 0.05, (60, 32)), rng.normal(size=(100, 32))])
    rows = [(1, i, v.tolist()) for i, v in enumerate(a)] + [(2, i, v.tolist()) for i, v in enumerate(b)]
    rows += [(3, 0, [0.0] * 32), (1, 160, [float("nan")] * 32)]
    d = spark.createDataFrame(rows, "image long, idx long, vec array<double>")
    got = matching.descriptor_join(d).collect()
    pairs = sorted((r["ia"], r["ib"]) for r in got if (r["a"], r["b"]) == (1, 2))
    assert pairs == brute_matches(a, b, 0.8, True) and len(pairs) >= 55
    assert not [r for r in got if r["b"] == 3]
    affinity = {(r["a"], r["b"]): r["affinity"] for r in matching.affinity(d).collect()}
    assert affinity == {(1, 2): len(pairs), (1, 3): 0, (2, 3): 0}
    assert matching.descriptor_join(d.limit(0)).count() == 0


def test_candidates_of_dated_photos(spark):
    p = spark.createDataFrame([(i, f"p{i}.jpg", i * 60) for i in range(8)], "id long, name string, s long").withColumn("capture_date", F.timestamp_seconds("s"))
    known = {(0, 5): 40, (2, 7): 30}
    a = spark.createDataFrame([(i, j, known.get((i, j), 0)) for i in range(8) for j in range(i + 1, 8)], "a long, b long, affinity long")
    got = {(r["a"], r["b"]): r["reasons"] for r in candidates.candidates(p, a).collect()}
    assert {(i, i + 1) for i in range(7)} <= set(got) and (0, 5) in got and len(got) < 28
    assert "neighbour" in got[(0, 5)]
    assert len(alignment.groups(list(range(8)), list(got))) == 1
    few = candidates.candidates(p.where("id < 4"), a).collect()
    assert len(few) == 6 and all(r["reasons"] == ["all"] for r in few)


@pytest.mark.parametrize("missing", [True, False])
def test_order_without_dates_goes_by_name(spark, missing):
    rows = [(0, "b.jpg", 10), (1, "a.jpg", None if missing else 1), (2, "c10.jpg" if missing else "c.jpg", 5 if missing else 20), (3, "c9.jpg" if missing else "d.jpg", 30)]
    p = spark.createDataFrame(rows, "id long, name string, s long").withColumn("capture_date", F.timestamp_seconds("s"))
    got = {r["id"]: r["place"] for r in candidates.shooting_order(p).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == ([1, 0, 3, 2] if missing else [1, 0, 2, 3])


def test_bridges(spark):
    groups = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)], "id long, component long")
    a = spark.createDataFrame([(1, 3, 9), (2, 4, 20), (0, 3, 15)], "a long, b long, affinity long")
    tried = spark.createDataFrame([(2, 4)], "a long, b long")
    assert [(r["a"], r["b"]) for r in candidates.bridges(a, groups, tried, limit=5).collect()] == [(0, 3), (1, 3)]
    single = spark.createDataFrame([(i, i) for i in range(30)], "id long, component long")
    many = spark.createDataFrame([(i, j, 0 if (i + j) % 3 == 0 else i + j) for i in range(30) for j in range(i + 1, 30)], "a long, b long, affinity long")
    assert candidates.bridges(many, single, tried.limit(0), limit=30).count() == 30
    assert candidates.bridges(many.limit(0), single, tried, limit=30).count() == 0


@pytest.mark.parametrize("small", [0, 100_000])
def test_spanning_tree_is_that_of_taking_edges_one_by_one(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(3)
    edges = [(i, j, rng.randint(0, 4)) for i in range(14) for j in range(i + 1, 14) if rng.random() < 0.5]
    root, want = list(range(14)), set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b))
    got = candidates.spanning_tree(spark.createDataFrame(edges, "a long, b long, affinity long"))
    assert {tuple(r) for r in got.collect()} == want


def test_quota(spark):
    o = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8), (0, 3, 0.7), (1, 2, 0.6), (1, 3, 0.5)], "a long, b long, overlap double")
    assert {(r["a"], r["b"]) for r in candidates.quota(o, per_photo=1).collect()} == {(0, 1), (0, 2), (0, 3)}


@pytest.mark.parametrize("small", [0, 100_000])
def test_components_prefer_the_lower_member(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    v = spark.createDataFrame([(i,) for i in range(5)], "id long")
    for rows in ([(2, 3, 100), (0, 1, 100)], [(0, 1, 100), (2, 3, 100)]):
        e = spark.createDataFrame(rows, "a long, b long, inliers long")
        got = graph.ordered_components(graph.components(v, e), e).orderBy("place").collect()
        assert [r["members"] for r in got] == [[0, 1], [2, 3], [4]]


def test_inconsistent_pairs():
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    loops = [(i, j, k, (0, 1) not in ((i, j), (i, k), (j, k))) for i in range(4) for j in range(i + 1, 4) for k in range(j + 1, 4)]
    assert graph.inconsistent(pairs, loops) == [(0, 1)]
    assert graph.inconsistent(pairs, [(*x[:3], True) for x in loops]) == []


def shifted(rng, n, h, noise=0.3, size=(1200, 900)):
    a = rng.uniform((0, 0), size, (n, 2))
    return a, models.apply(h, a) + rng.uniform(-noise, noise, (n, 2))


TRUE = {
    "translation": np.array([[1, 0, -400.0], [0, 1, 30], [0, 0, 1]]),
    "similarity": np.array([[0.98, -0.2, 12.0], [0.2, 0.98, -7], [0, 0, 1]]),
    "affine": np.array([[1.1, 0.1, 5.0], [-0.05, 0.9, 9], [0, 0, 1]]),
    "homography": np.array([[1, 0, -50.0], [0, 1, 0], [2.5e-4, 0, 1]]),
}


@pytest.mark.parametrize("kind", TRUE)
def test_robust_fit_finds_the_map(kind):
    rng = np.random.default_rng(7)
    a, b = shifted(rng, 200, TRUE[kind])
    wrong = rng.choice(200, 60, replace=False)
    b[wrong] = rng.uniform(0, 900, (60, 2))
    a[wrong[0]], b[wrong[1]] = np.nan, np.inf
    got = models.fit(kind, a, b, 3.0, 2000)
    assert len(got.inliers) >= 138 and not {int(wrong[0]), int(wrong[1])} & set(got.inliers)
    centre = np.array([[600.0, 450.0]])
    assert np.abs(models.apply(got.transform, centre) - models.apply(TRUE[kind], centre)).max() < 0.5
    again = models.fit(kind, a, b, 3.0, 2000)
    assert np.array_equal(again.transform, got.transform)


def test_simplest_model():
    fit = lambda m, n, r: models.Fit(m, np.eye(3), np.arange(n), r, r)
    assert models.simplest([fit("translation", 95, 4.0), fit("similarity", 100, 0.8)], 10).model == "similarity"
    assert models.simplest([fit("translation", 95, 1.0), fit("similarity", 100, 0.8)], 10).model == "translation"


def test_false_alarms():
    assert models.log10_false_alarms(600, 150, 4, 10, 4e6) < -100
    assert models.log10_false_alarms(600, 6, 4, 10, 4e6) > 0
    assert models.log10_false_alarms(4, 4, 4, 10, 4e6) == float("inf")


def test_polygons():
    assert abs(polygons.area(polygons.overlap(TRUE["translation"] + np.array([[0, 0, -200], [0, 0, -130], [0, 0, 0]]), (1000, 800), (1000, 800)))) == pytest.approx(400 * 700, abs=1)
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10], [5, 5]], float)
    assert polygons.hull_area(square) == 100
    strip = np.column_stack([np.linspace(0, 1000, 50), np.tile([0.0, 2.0], 25)])
    stray = np.vstack([strip, [[500, 700]]])
    assert polygons.peeled_hull_area(stray) < 5000 and polygons.hull_area(stray) > 300_000
    for window in (square[:4], square[:4][::-1]):
        assert abs(polygons.area(polygons.clip(square[:4] + 5, window))) == pytest.approx(25)
    assert not len(polygons.clip(square[:4] + 50, square[:4]))


def match_rows(pairs, size=(1200, 900)):
    return [(a, b, s, i, *map(float, p), *map(float, q), float(size[0]), float(size[1]), float(size[0]), float(size[1])) for a, b, s, x, y in pairs for i, (p, q) in enumerate(zip(x, y, strict=True))]


MATCHES = "a long, b long, source string, idx int, ax double, ay double, bx double, by double, wa double, ha double, wb double, hb double"


def test_verdicts(spark):
    rng = np.random.default_rng(5)
    noise = (rng.uniform(0, 900, (80, 2)), rng.uniform(0, 900, (80, 2)))
    line = np.column_stack([np.linspace(500, 1100, 60), np.full(60, 400.0)])
    rows = match_rows([
        (0, 1, "s", *shifted(rng, 120, TRUE["translation"])), (0, 2, "s", *shifted(rng, 10, TRUE["translation"])), (0, 3, "s", *noise),
        (0, 4, "s", *shifted(rng, 300, TRUE["homography"], 0.5)), (0, 5, "s", line, line - [400, 0]),
    ])
    df = spark.createDataFrame(rows, MATCHES)
    got = {r["b"]: r for r in verification.verify(df, "automatic", FAST).collect()}
    assert got[1]["verdict"] == "verified" and got[1]["model"] == "translation" and got[1]["transform"][2] == pytest.approx(-400, abs=0.5)
    assert got[2]["verdict"] == "tooFewMatches"
    assert got[3]["verdict"] in ("noConsistentModel", "lowConfidence", "degenerateInliers", "implausibleModel")
    assert got[4]["model"] == "homography"
    assert got[5]["verdict"] == "degenerateInliers"
    plane = {r["b"]: r["verdict"] for r in verification.verify(df.where("b = 4"), "plane", FAST).collect()}
    assert plane[4] == "modelMismatch"
    fits = {r["b"]: len(r["inliers"]) for r in verification.model_fits(df.withColumn("threshold", F.lit(3.0)), "translation", FAST).collect()}
    assert fits[1] >= 115


def grid_pairs(rng, columns, rows, maps, noise=0.3, size=(1200, 900), n=60):
    """Photo i shows the scene through maps[i] (photo to scene); neighbours share matches."""
    out = []
    for i in range(columns * rows):
        for j in range(i + 1, columns * rows):
            if abs(i % columns - j % columns) + abs(i // columns - j // columns) != 1:
                continue
            p = models.apply(maps[i], rng.uniform((0, 0), size, (3000, 2)))
            q = models.apply(np.linalg.inv(maps[j]), p)
            k = np.flatnonzero(((q >= 0) & (q <= size)).all(axis=1))[:n]
            if len(k):
                pa = models.apply(np.linalg.inv(maps[i]), p[k])
                out.append(alignment.Pair(i, j, pa + rng.uniform(-noise, noise, pa.shape), q[k] + rng.uniform(-noise, noise, (len(k), 2)), np.ones(len(k))))
    return out


def at(x, y):
    return np.array([[1, 0, x], [0, 1, y], [0, 0, 1.0]])


def test_alignment_of_tiles_and_a_false_link():
    rng = np.random.default_rng(1)
    maps = [at(820 * (i % 2), 600 * (i // 2)) for i in range(4)]
    pairs = grid_pairs(rng, 2, 2, maps)
    layout = alignment.align([0, 1, 2, 3], pairs, 0)
    assert layout.model == "translation" and layout.rms < 0.6 and not layout.left_out
    for i in range(4):
        assert np.abs(layout.transforms[i] - maps[i])[:2, 2].max() < 0.5
    extra = alignment.Pair(0, 3, pairs[0].pa, pairs[0].pb + [0, 300], pairs[0].sigma)
    wrong = alignment.align([0, 1, 2, 3], [*pairs, extra], 0)
    assert [p for p, _, _ in wrong.left_out] == [(0, 3)] and wrong.model == "translation" and wrong.rms < 0.6


def test_alignment_of_tilted_views():
    rng = np.random.default_rng(2)
    tilt = [np.eye(3), np.array([[1, 0, 700], [0, 1, 20], [1.2e-4, 0, 1.0]]), np.array([[1, 0, 30], [0, 1, 600], [0, 1.6e-4, 1.0]]), np.array([[1, 0, 700], [0, 1, 600], [1e-4, 1e-4, 1.0]])]
    pairs = grid_pairs(rng, 2, 2, tilt, noise=0.2)
    layout = alignment.align([0, 1, 2, 3], pairs, 0, sizes={i: (1200.0, 900.0) for i in range(4)})
    assert layout.model == "homography" and layout.rms < 1
    centre = np.array([[600.0, 450.0]])
    for i in range(4):
        assert np.abs(models.apply(layout.transforms[i], centre) - models.apply(tilt[i], centre)).max() < 2.5


def test_rotation_finds_the_focal_length():
    rng = np.random.default_rng(3)
    f, size, yaws = 1400.0, (1600, 1200), [-24, -8, 8, 24]
    turn = [alignment.rotation_matrix(np.array([0, np.radians(y), 0])) for y in yaws]
    pairs = []
    for i, j in ((0, 1), (1, 2), (2, 3), (0, 2), (1, 3)):
        a = rng.uniform((0, 0), size, (2000, 2))
        v = (np.column_stack([a - np.array(size) / 2, np.full(len(a), f)]) @ turn[i].T) @ turn[j]
        b = v[:, :2] / v[:, 2:] * f + np.array(size) / 2
        k = np.flatnonzero((v[:, 2] > 0) & ((b >= 0) & (b <= size)).all(axis=1))[:120]
        pairs.append(alignment.Pair(i, j, a[k] + rng.normal(0, 0.2, (len(k), 2)), b[k] + rng.normal(0, 0.2, (len(k), 2)), np.ones(len(k))))
    pairs.append(alignment.Pair(0, 3, np.full((5, 2), np.nan), np.full((5, 2), np.nan), np.ones(5)))
    got = alignment.solve_rotation([0, 1, 2, 3], pairs, dict.fromkeys(range(4), size), 1)
    assert got.focal == pytest.approx(f, rel=0.01) and got.rms < 1 and got.pair_rms[(0, 3)] == 0
    assert alignment.solve_rotation([0, 1, 2, 3], pairs[:5], dict.fromkeys(range(4), size), 1, focal=1.6 * f).method in (0, 1)


def test_normal_blocks_and_transfer(spark):
    rng = np.random.default_rng(4)
    maps = [at(0, 0), at(820, 30)]
    (pair,) = grid_pairs(rng, 2, 1, maps)
    rows = [(0, 1, i, *map(float, p), *map(float, q), 1.0) for i, (p, q) in enumerate(zip(pair.pa, pair.pb, strict=True))]
    m = spark.createDataFrame(rows, "a long, b long, idx long, ax double, ay double, bx double, by double, sigma double")
    assert [(p.a, p.b, len(p.pa)) for p in alignment.problem(m)] == [(0, 1, len(rows))]
    block = alignment.normal_blocks(m, "translation").first()
    assert block["block"][0] == pytest.approx(len(rows))
    layout = spark.createDataFrame([(i, maps[i].ravel().tolist()) for i in (0, 1)], "image long, transform array<double>")
    assert alignment.transfer_rms(m, layout).first()["rms"] < 0.6


@pytest.mark.parametrize("rms, n, want", [(lambda d: 2 + d / 100, 15, True), (lambda d: 5.0, 15, False), (lambda d: 10 + d / 500, 15, False), (lambda d: 2 + d / 100, 9, False)])
def test_error_grows_with_distance(spark, rms, n, want):
    rows = [(i, i + 1, 100.0 * (i + 1), float(rms(100.0 * (i + 1)))) for i in range(n)]
    assert alignment.grows_with_distance(spark.createDataFrame(rows, "a long, b long, distance double, rms double")).first()["grows"] is want


def track():
    return [(i, i / 100, 0.0, 100.0 if i == 47 else float(i % 7)) for i in range(1, 151)]


def test_frame_selection(spark):
    kept = frames.selected(track())
    gaps = np.diff(kept)
    assert 47 in kept and gaps[:-1].min() >= 16 and gaps.max() <= 34
    jump = [(0, 0.0, 0.0, 1.0), (1, 0.0, 0.5, 1.0), (2, 0.0, 0.51, 1.0)]
    assert frames.selected(jump) == [0, 1]
    rows = [("a", *f) for f in track()] + [("b", *f) for f in jump]
    df = spark.createDataFrame(rows, "video string, idx long, px double, py double, sharpness double").repartition(3)
    got = {(r["video"], r["idx"]) for r in frames.select_frames(df).collect()}
    assert got == {("a", i) for i in kept} | {("b", 0), ("b", 1)}


def test_frame_selection_stream_resumes(spark, tmp_path):
    from tessella.streaming.selection import select_stream

    schema = "video string, idx long, px double, py double, sharpness double, ended boolean"
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = [("a", *f, False) for f in track()]

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        query = select_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    spark.createDataFrame(rows[:70], schema).coalesce(1).write.mode("append").parquet(source)
    run()  # stops here, and starts again from its checkpoint
    spark.createDataFrame([*rows[60:], ("a", 10_000, 0.0, 0.0, 0.0, True)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    got = sorted(r["idx"] for r in spark.read.parquet(out).collect())
    assert got == frames.selected(track())


def test_early_pairs(spark, tmp_path):
    from tessella.streaming.selection import early_pairs

    source = str(tmp_path / "seen")
    spark.createDataFrame([(i,) for i in range(4)], "image long").withColumn("at", F.timestamp_seconds(F.col("image") * 10 + 1_000_000)).write.parquet(source)
    stream = spark.readStream.schema("image long, at timestamp").parquet(source)
    pairs = spark.createDataFrame([(0, 1), (2, 3), (1, 9)], "a long, b long")
    query = early_pairs(stream, pairs).writeStream.format("memory").queryName("early").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("early").collect()} == {(0, 1), (2, 3)}


def test_phase_shift():
    rng = np.random.default_rng(8)
    scene = np.cumsum(np.cumsum(rng.normal(size=(400, 500)), axis=0), axis=1)
    scene = np.abs(np.fft.ifft2(np.fft.fft2(rng.normal(size=(400, 500))) * np.exp(-np.hypot(*np.meshgrid(np.fft.fftfreq(500), np.fft.fftfreq(400))) * 20)))
    a, b = scene[50:290, 60:380], scene[50 + 11 : 290 + 11, 60 - 19 : 380 - 19]
    dx, dy, peak = raster.phase_shift(a, b)
    assert abs(dx - 19) < 1.5 and abs(dy + 11) < 1.5 and peak > 0.1


def test_largest_rectangle(spark):
    rng = random.Random(11)
    for _ in range(3):
        h, w = rng.randint(1, 8), rng.randint(1, 8)
        m = np.array([[rng.random() < 0.7 for _ in range(w)] for _ in range(h)])
        want = max(((y1 - y0) * (x1 - x0) for y0 in range(h) for y1 in range(y0 + 1, h + 1) for x0 in range(w) for x1 in range(x0 + 1, w + 1) if m[y0:y1, x0:x1].all()), default=0)
        got = raster.largest_rectangle(spark.createDataFrame([(0, y, x, int(m[y, x])) for y in range(h) for x in range(w)], "image long, y long, x long, v int")).collect()
        assert (got[0]["area"] if got else 0) == want
        if got:
            r = got[0]
            assert m[r["y"] : r["y"] + r["height"], r["x"] : r["x"] + r["width"]].all()


def test_local_maxima_pass_over_nan(spark):
    rows = [(0, 0, x, v) for x, v in enumerate([1.0, float("nan"), 3.0, 2.0, float("inf")])]
    got = raster.local_maxima(spark.createDataFrame(rows, "image long, y long, x long, value double")).collect()
    assert sorted(r["x"] for r in got) == [0, 2, 4]


def test_narrow_range_is_stretched(spark):
    v = spark.createDataFrame([(4000 + i % 1024,) for i in range(4096)], "value long")
    low, high = raster.percentile_levels(v).first()
    assert low <= 4001 and high >= 5020
    got = [r[0] for r in v.select(raster.stretched(F.col("value"), F.lit(low), F.lit(high))).distinct().collect()]
    assert min(got) == 0 and max(got) == 255
    wide = v.select(F.col("value") * 12)
    low, high = wide.toDF("value").transform(raster.percentile_levels).first()
    assert high - low < 32768


def test_multi_band_and_gains():
    flat = [np.full((64, 64), 10.0), np.full((64, 64), 10.0)]
    left = np.zeros((64, 64))
    left[:, :32] = 1
    assert np.allclose(raster.multi_band(flat, [left, 1 - left], 4), 10)
    gains = raster.gains([(0, 1, 1000, 100.0, 110.0), (1, 2, 1000, 110.0, 100.0)])
    assert gains[0] * 100 == pytest.approx(gains[1] * 110, rel=0.03)


def png(width, height):
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + part(b"IEND", b"")


def jpeg(width, height, orientation):
    date, own = b"2024:05:06 07:08:09\0", 8 + 2 + 2 * 12 + 4
    first = struct.pack("<HHHII", 2, 0x0112, 3, 1, orientation) + struct.pack("<HHII", 0x8769, 4, 1, own) + b"\0" * 4
    text = own + 2 + 2 * 12 + 4
    second = struct.pack("<HHHII", 2, 0x9003, 2, len(date), text) + struct.pack("<HHII", 0xA405, 3, 1, 28) + b"\0" * 4
    exif = b"Exif\0\0II*\0" + struct.pack("<I", 8) + first + second + date
    sof = struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0"
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">H", len(sof) + 2) + sof + b"\xff\xd9"


def test_photo_headers(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(40, 30))
    (tmp_path / "b.jpg").write_bytes(jpeg(400, 300, 6))
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8broken")
    got = {r["name"]: r for r in photos.describe(spark, str(tmp_path)).collect()}
    assert (got["a.png"]["width"], got["a.png"]["height"], got["a.png"]["unreadable"]) == (40, 30, False)
    b = got["b.jpg"]
    assert (b["width"], b["height"], b["orientation"], b["focal_35mm"], str(b["capture_date"])) == (300, 400, 6, 28.0, "2024-05-06 07:08:09")
    assert got["c.jpg"]["unreadable"] and got["c.jpg"]["width"] == 0
    assert spark.createDataFrame([("x.MOV",), ("x.jpg",)], "p string").select(photos.is_video(F.col("p"))).collect() == [(True,), (False,)]


def test_report_round_trip(spark):
    rows = [(1, "a", float("nan"), [1.0]), (2, None, float("-inf"), []), (3, "c", 2.5, None)]
    schema = T.StructType.fromDDL("id long, name string, score double, points array<double>")
    df = spark.createDataFrame(rows, schema)
    back = reports.decoded(reports.encoded(df, ("score",)), schema, ("score",)).orderBy("id").collect()
    assert math.isnan(back[0]["score"]) and back[1]["score"] == float("-inf") and back[2]["points"] is None and back[0]["points"] == [1.0]


def test_stratified_keeps_small_pairs_whole(spark):
    rows = [(p, i, float(i % 90), float(i % 70), float(i), 100, 80) for p, n in ((0, 20), (1, 900)) for i in range(n)]
    got = verification.stratified(spark.createDataFrame(rows, "pair long, idx long, x double, y double, sigma double, width int, height int")).groupBy("pair").count().collect()
    assert {r["pair"]: r["count"] for r in got} == {0: 20, 1: 300}
