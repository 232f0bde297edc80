"""Modes, turned cameras, misplaced photos, sparse systems, seams and crop, against ground truth."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import AT, CONFIG, scene

from tessella import engine
from tessella.config import Stitching
from tessella.functions import models
from tessella.functions.blocks import BlockSystem, least_degree_order
from tessella.operators import alignment, raster, stitching
from tessella.sources import images, photos


def grid_system(rng, columns, rows, size):
    n = columns * rows
    system, whole = BlockSystem([size] * n), np.zeros((n * size,) * 2)
    for i in range(n):
        for j in (i + 1, i + columns, i + columns + 1):
            if j < n:
                half = rng.normal(size=(3 * size, 2 * size))
                block = half.T @ half
                for a, u in enumerate((i, j)):
                    for b, v in enumerate((i, j)):
                        part = block[a * size : (a + 1) * size, b * size : (b + 1) * size]
                        system.add(u, v, part)
                        whole[u * size : (u + 1) * size, v * size : (v + 1) * size] += part
    system.side[:] = rng.normal(size=n * size)
    return system, whole


@pytest.mark.parametrize("shape", [(1, 1, 3), (2, 1, 1), (5, 4, 3), (7, 6, 8)])
def test_block_system_is_the_dense_one(shape):
    system, whole = grid_system(np.random.default_rng(1), *shape)
    extra = np.linspace(0.1, 0.2, len(whole))
    assert np.allclose(system.solved(extra), np.linalg.solve(whole + np.diag(extra), -system.side))
    assert np.allclose(system.solved(0.5), np.linalg.solve(whole + 0.5 * np.eye(len(whole)), -system.side))


def test_blocks_of_different_sizes_and_singular_systems():
    rng = np.random.default_rng(2)
    half = rng.normal(size=(9, 6))
    whole = half.T @ half
    system = BlockSystem([3, 2, 1])
    at = [0, 3, 5, 6]
    for i in range(3):
        for j in range(3):
            system.add(i, j, whole[at[i] : at[i + 1], at[j] : at[j + 1]])
    system.side[:] = rng.normal(size=6)
    assert np.allclose(system.solved(), np.linalg.solve(whole, -system.side))
    nothing = BlockSystem([2, 2])
    with pytest.raises(np.linalg.LinAlgError):
        nothing.solved()
    assert sorted(least_degree_order([{1}, {0, 2}, {1}])) == [0, 1, 2] and len(BlockSystem([]).solved()) == 0


def grid_pairs(columns, rows, maps, step, size, matches, noise, seed=3):
    """Pairs of neighbours in a grid of views: scene points seen through each photo's map from photo to scene."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(columns * rows):
        for j in (i + 1 if i % columns < columns - 1 else None, i + columns if i + columns < columns * rows else None):
            if j is not None:
                ca, cb = (np.array([k % columns, k // columns]) * step for k in (i, j))
                low, high = np.maximum(ca, cb) + 1, np.minimum(ca, cb) + np.array(size) - 1
                points = rng.uniform(low, high, size=(matches, 2))
                pa, pb = (models.apply(np.linalg.inv(maps[k]), points) + rng.normal(size=(matches, 2)) * noise for k in (i, j))
                out.append(alignment.Pair(i, j, pa, pb, np.ones(matches)))
    return out


def tilted(k, columns, step, perspective):
    rng = np.random.default_rng(100 + k)
    x, y = np.array([k % columns, k // columns]) * step
    p, q = rng.uniform(-perspective, perspective, 2)
    return np.array([[1, 0, x], [0, 1, y], [0, 0, 1.0]]) @ np.array([[1, 0, 0], [0, 1, 0], [p, q, 1.0]])


def test_many_photos_are_solved_in_a_few_seconds():
    columns, rows, step, size = 25, 21, np.array([800.0, 600.0]), (1200, 900)
    maps = {k: tilted(k, columns, step, 0 if k == 262 else 1e-5) for k in range(columns * rows)}  # the plane is the anchor's own
    pairs = grid_pairs(columns, rows, maps, step, size, 40, 0.3)
    began = time.time()
    layout = alignment.solve_homography(sorted(maps), pairs, 262)
    assert layout.rms < 1 and time.time() - began < 90
    assert len(maps) == 525


def test_misplaced_photo_is_left_out_of_a_document():
    columns, step, size = 8, np.array([800.0, 600.0]), (1200, 900)
    maps = {k: tilted(k, columns, step, 1.2e-4) for k in range(40)}
    maps[0] = np.eye(3)
    pairs = grid_pairs(columns, 5, maps, step, size, 60, 0.3)
    for p in pairs:
        if p.b == 39:
            p.pb = p.pb * 0.15
    sizes = dict.fromkeys(range(40), (1200.0, 900.0))
    layout = alignment.align(list(range(40)), pairs, 0, {}, sizes)
    assert (layout.model, layout.misplaced) == ("homography", [39]) and layout.rms < 1
    flat = {k: np.array([[1, 0, x], [0, 1, y], [0, 0, 1.0]]) for k in range(40) for x, y in [np.array([k % columns, k // columns]) * step]}
    flat[39] = flat[39] @ np.diag([5.0, 5.0, 1.0])
    layout = alignment.align(list(range(40)), grid_pairs(columns, 5, flat, step, size, 60, 0.3), 0, {}, sizes)
    assert (layout.model, layout.misplaced) == ("similarity", [])


def ring(count, step, focal, size, links=(1, 2), matches=150, noise=0.4):
    rng = np.random.default_rng(5)
    turns = {k: alignment.rotation_matrix(np.array([0, np.radians(step * k), 0])) for k in range(count)}
    centre = np.array(size) / 2
    pairs = []
    for i in range(count):
        for d in links:
            j = i + d
            if j < count:
                pa = rng.uniform([0, 0], size, size=(matches * 6, 2))
                ray = alignment.rays(pa, focal, centre) @ turns[i].T @ turns[j]
                pb = ray[:, :2] / ray[:, 2:] * focal + centre
                ok = (ray[:, 2] > 0) & (pb > 0).all(axis=1) & (pb < size).all(axis=1)
                pa, pb = pa[ok][:matches], pb[ok][:matches]
                if len(pa) > 10:
                    pairs.append(alignment.Pair(i, j, pa + rng.normal(size=pa.shape) * noise, pb + rng.normal(size=pb.shape) * noise, np.ones(len(pa))))
    return turns, pairs


def test_a_sweep_is_turned_cameras():
    size, focal = (1200.0, 900.0), 1400.0
    turns, pairs = ring(7, 15, focal, size)
    sizes = dict.fromkeys(turns, size)
    layout = alignment.align(sorted(turns), pairs, 3, {}, sizes)
    assert layout.model == "rotation" and layout.cameras.focal == pytest.approx(focal, rel=0.01) and layout.rms < 1
    assert alignment.focal_from_pairs(pairs, sizes) == pytest.approx(focal, rel=0.15)
    apart = layout.cameras.rotations[2].T @ layout.cameras.rotations[5]
    assert np.degrees(np.arccos((np.trace(apart) - 1) / 2)) == pytest.approx(45, abs=0.5)
    assert alignment.align(sorted(turns), pairs, 3, {}, sizes, "plane").model in ("translation", "similarity", "affine")
    assert alignment.align(sorted(turns), pairs, 3, {}, sizes, "rotation").model == "rotation"


def test_align_refuses_what_is_not_a_problem():
    pair = alignment.Pair(0, 1, np.zeros((4, 2)), np.zeros((4, 2)), np.ones(4))
    for bad in (dict(mode="sideways"), dict(mode="rotation"), dict(anchor=9), dict(pairs=[alignment.Pair(0, 7, pair.pa, pair.pb, pair.sigma)])):
        with pytest.raises(ValueError):
            alignment.align(**{"photos": [0, 1], "pairs": [pair], "anchor": 0, **bad})
    solves, photos_ = alignment.Solves(), [0, 1]
    one = solves.get("translation", photos_, [pair], 0)
    assert solves.get("translation", photos_, [pair], 0).transforms is one.transforms


@pytest.mark.parametrize("projection", ["rectilinear", "cylindrical", "spherical"])
def test_projections_go_both_ways(projection):
    placed = stitching.Placed(300, 200, alignment.rotation_matrix(np.array([0.1, 0.3, -0.05])), projection, 250.0)
    points = np.random.default_rng(1).uniform([0, 0], [300, 200], (50, 2))
    at = placed.target(points)
    assert np.allclose(placed.source(at[:, 0], at[:, 1]), points)
    x0, y0, x1, y1 = placed.box()
    assert (at >= [x0 - 1, y0 - 1]).all() and (at <= [x1 + 1, y1 + 1]).all()


def test_seams_share_the_overlap_out():
    rng = np.random.default_rng(2)
    left, right = rng.uniform(0, 255, (40, 60)), rng.uniform(0, 255, (40, 60))
    right[:, 12] = left[:, 42]  # where both agree: column 42 of the panorama
    copies = {1: (left, np.ones((40, 60), bool), 0, 0), 2: (right, np.ones((40, 60), bool), 30, 0)}
    seams = stitching.found_seams(copies, 4.0)
    a, b = np.zeros((40, 90), bool), np.zeros((40, 90), bool)
    a[:, :60], b[:, 30:] = seams[1].mask, seams[2].mask
    assert (a ^ b).all() and a[:, :42].all() and b[:, 43:].all()
    u, v = np.meshgrid(np.arange(0, 360) + 0.5, np.arange(0, 160) + 0.5)
    assert (seams[1].at(u, v) | seams[2].at(u, v)).all()


def test_gains_by_block_pass_over_smoothly():
    p = np.stack(np.meshgrid(np.linspace(0, 100, 21), np.linspace(0, 80, 17)), axis=-1)
    assert np.allclose(stitching.gain_at(np.array([1.5]), p, 100, 80), 1.5)
    assert np.allclose(stitching.gain_at(np.array([1, 2, 3.0]), p, 100, 80)[..., 1], 2)
    grid = np.array([[0, 1.0], [2, 3]])
    got = stitching.gain_at(grid.ravel(), p, 100, 80)[..., 0]
    assert got[0, 0] == 0 and got[-1, -1] == 3 and got[8, 10] == pytest.approx(1.5)


@pytest.fixture(scope="module")
def bright(spark, tmp_path_factory):
    """Four tiles of 16 bits, of which one is darker."""
    folder = tmp_path_factory.mktemp("deep")
    whole = scene(520, 420).astype(np.uint16) * 230 + 4000 + np.random.default_rng(1).integers(0, 230, (420, 520, 1)).astype(np.uint16)
    for i, (x, y) in enumerate(AT):
        (folder / f"tile{i}.png").write_bytes(images.encode_png((whole[y : y + 240, x : x + 300] * (0.9 if i == 1 else 1)).astype(np.uint16)))
    return engine.analyze(spark, str(folder), CONFIG), whole


@pytest.mark.parametrize(("exposure", "seams", "blending"), [("gain", "voronoi", "multiband"), ("channels", "path", "hard"), ("blocks", "path", "multiband")])
def test_panorama_keeps_its_depth_and_levels_exposure(bright, exposure, seams, blending):
    report, whole = bright
    layout = engine.align(report)
    tiles = engine.stitch(report, layout, Stitching(exposure=exposure, seams=seams, blending=blending))
    out, x0, y0 = stitching.assembled(tiles)
    anchor = np.array(AT[layout.anchor])
    seen = out[..., 3] > 0
    y, x = np.nonzero(seen)
    truth = whole[np.clip(y + y0 + anchor[1], 0, 419), np.clip(x + x0 + anchor[0], 0, 519), 0].astype(float)
    got = out[y, x, 0].astype(float)
    ratio = got / truth
    assert len(np.unique(got)) > 3000  # more than 8 bits
    assert abs(np.median(ratio) - 1) < 0.08 and np.quantile(np.abs(ratio / np.median(ratio) - 1), 0.9) < 0.08


def test_crop_is_covered_everywhere(bright):
    report, _ = bright
    layout = engine.align(report)
    tiles, (x, y, w, h) = stitching.cropped(engine.stitch(report, layout, Stitching(blending="hard")))
    out, x0, y0 = stitching.assembled(tiles)
    assert (x0, y0) == (x, y) and out.shape[:2] == (h, w) and (out[..., 3] > 0).all() and w * h > 250 * 250
    cut = engine.stitch(report, layout, Stitching(blending="hard", crop=True))
    assert stitching.assembled(cut)[0].shape == out.shape


def test_jpeg_and_tiff_pixels_and_files_that_fail(spark, tmp_path):
    jvm = spark._jvm
    whole = scene(200, 160)
    image = jvm.java.awt.image.BufferedImage(200, 160, 1)
    for y in range(160):
        image.setRGB(0, y, 200, 1, spark.sparkContext._gateway.new_array(jvm.int, 200), 0, 200)
        for x in range(0, 200):
            r, g, b = (int(v) for v in whole[y, x])
            image.setRGB(x, y, (r << 16) | (g << 8) | b)
    for kind in ("jpg", "tiff"):
        assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(tmp_path / f"a.{kind}")))
    (tmp_path / "b.png").write_bytes(images.encode_png(whole))
    good = (tmp_path / "a.jpg").read_bytes()
    (tmp_path / "broken.jpg").write_bytes(good[:300] + b"\0" * 40)  # a header and no pixels
    described = {r["name"]: r for r in photos.describe(spark, str(tmp_path)).collect()}
    assert {(r["width"], r["height"]) for n, r in described.items() if not r["unreadable"]} == {(200, 160)}
    wanted = photos.describe(spark, str(tmp_path)).where("NOT unreadable").select("name", "path", "orientation")
    for r in images.pixel_rows(spark, str(tmp_path), wanted).collect():
        if r["name"] != "broken.jpg":
            p = images.decoded(r["content"], r["raw"], r["rows"], r["columns"], r["bands"], r["orientation"])
            assert np.abs(p.astype(float) - whole).mean() < (6 if r["name"] == "a.jpg" else 1e-9)
    report = engine.analyze(spark, str(tmp_path), CONFIG)
    assert {r["name"] for r in report.photos.where("unreadable").collect()} == {"broken.jpg"}
    assert report.keypoints.select("image").distinct().count() == 3


def test_a_wide_sweep_is_drawn_on_a_cylinder(spark, tmp_path):
    focal, size, texture = 330.0, (300, 240), scene(1100, 420, seed=4)[..., 0].astype(float)
    yaws = np.radians(np.arange(-60, 61, 15))
    for k, yaw in enumerate(yaws):
        x, y = np.meshgrid(np.arange(size[0]) + 0.5 - size[0] / 2, np.arange(size[1]) + 0.5 - size[1] / 2)
        ray = np.stack([x, y, np.full(x.shape, focal)], axis=-1) @ alignment.rotation_matrix(np.array([0, yaw, 0])).T
        at = stitching.from_rays(ray, "cylindrical", focal) + np.array([550, 210])
        colour, _ = stitching.sampled(texture[..., None], at[..., 0] - 0.5, at[..., 1] - 0.5)
        (tmp_path / f"v{k}.png").write_bytes(images.encode_png(np.repeat(np.clip(colour, 0, 255).astype(np.uint8), 3, axis=2)))
    report = engine.analyze(spark, str(tmp_path), CONFIG, "rotation")
    layout = engine.align(report, "rotation")
    assert layout.model == "rotation" and layout.cameras.focal == pytest.approx(focal, rel=0.03) and len(layout.cameras.rotations) == len(yaws)
    assert engine.projected(spark, layout)[0] == "cylindrical"
    out, x0, y0 = stitching.assembled(engine.stitch(report, layout, Stitching(blending="hard")))
    assert 800 < out.shape[1] < 1100
    seen = out[..., 3] > 0
    y, x = np.nonzero(seen)
    truth = texture[np.clip(y + y0 + 210, 0, 419), np.clip(x + x0 + 550, 0, 1099)]
    assert np.corrcoef(truth, out[y, x, 0] / 257.0)[0, 1] > 0.9


def test_projection_follows_the_empty_arc(spark):
    yaws = spark.createDataFrame([(p, float(y)) for p, own in enumerate([range(0, 90, 10), range(300, 480, 10), range(0, 360, 10)]) for y in own], "project int, yaw double").withColumn("yaw", F.pmod("yaw", F.lit(360.0)))
    from tessella.functions import columns

    got = raster.circular_gap(yaws).select("project", columns.projection_of(F.col("extent")).alias("p")).orderBy("project").collect()
    assert [r["p"] for r in got] == ["rectilinear", "cylindrical", "refused"]


@pytest.mark.parametrize("suffix", ["png", "tiff", "jpg"])
def test_panorama_is_written_whole(bright, spark, tmp_path, suffix):
    report, _ = bright
    tiles = engine.stitch(report, engine.align(report), Stitching(blending="hard", exposure="none"))
    path = str(tmp_path / f"out.{suffix}")
    _, _, w, h = engine.export(tiles, path)
    assert [p.name for p in tmp_path.iterdir()] == [f"out.{suffix}"]
    pixels = stitching.assembled(tiles)[0]
    row = images.pixel_rows(spark, path, spark.createDataFrame([(f"file:{path}",)], "path string")).first()
    back = images.decoded(row["content"], row["raw"], row["rows"], row["columns"], row["bands"])
    assert back.shape[:2] == (h, w) == pixels.shape[:2]
    if suffix == "png":
        assert np.array_equal(back, pixels)
    else:
        assert np.abs(back.astype(float) - (images.flattened(pixels) >> 8)).mean() < (1e-9 if suffix == "tiff" else 6)
    with pytest.raises(ValueError):
        images.write_image(spark, pixels, str(tmp_path / "out.heic"))
    with pytest.raises(ValueError):
        images.write_image(spark, np.zeros((1, 70_000, 4), np.uint16), str(tmp_path / "long.jpg"))


def test_thumbnails_and_reuse(bright, spark, tmp_path):
    report, _ = bright
    rows = engine.thumbnails(report, 64).collect()
    assert len(rows) == 4 and all((r["width"], r["height"]) == (64, 51) and images.decode_png(bytes(r["png"])).shape == (51, 64, 3) for r in rows)
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert [photos.reused(spark, str(tmp_path), "k", make).count() for _ in range(2)] == [3, 3] and made == [1]
    key = photos.cache_key(F.lit("a.mov"), F.col("id"), F.timestamp_seconds("id"))
    assert spark.range(3).select(key.alias("k")).distinct().count() == 3
