"""End to end on synthetic tiles, and the parts of rendering, against ground truth."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import engine
from tessella.config import Analysis, Stitching
from tessella.functions import features
from tessella.operators import alignment, problem, stitching
from tessella.sources import images
from tessella.streaming import progress

CONFIG = Analysis(max_iterations=500)


def scene(width, height, seed=1):
    rng = np.random.default_rng(seed)
    out = np.zeros((height, width))
    for size in (3, 8, 20):
        noise = rng.normal(size=(height // size + 2, width // size + 2))
        y, x = np.arange(height) / size, np.arange(width) / size
        i, j = y.astype(int), x.astype(int)
        a, b = (y - i)[:, None], (x - j)[None]
        out += (noise[np.ix_(i, j)] * (1 - a) * (1 - b) + noise[np.ix_(i + 1, j)] * a * (1 - b) + noise[np.ix_(i, j + 1)] * (1 - a) * b + noise[np.ix_(i + 1, j + 1)] * a * b) * size**0.5
    out = (out - out.min()) / (out.max() - out.min())
    return np.repeat((out * 255).astype(np.uint8)[..., None], 3, axis=2)


AT = [(0, 0), (190, 12), (200, 150), (10, 160)]


@pytest.fixture(scope="module")
def report(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("photos")
    whole = scene(520, 420)
    for i, (x, y) in enumerate(AT):
        (folder / f"tile{i}.png").write_bytes(images.encode_png(whole[y : y + 240, x : x + 300]))
    (folder / "tile9.png").write_bytes(images.encode_png(scene(300, 240, seed=5)))
    (folder / "tile99.png").write_bytes(b"no photo")
    return engine.analyze(spark, str(folder), CONFIG)


def test_tiles_are_verified_and_the_stranger_is_not(report):
    got = {(r["a"], r["b"]): r for r in report.evidence.collect()}
    good = {k for k, r in got.items() if r["verdict"] == "verified"}
    assert {(0, 1), (1, 2), (2, 3)} <= good or {(0, 1), (0, 3), (2, 3)} <= good
    assert not any(4 in k for k in good)
    for (a, b), r in got.items():
        if r["verdict"] == "verified":
            assert r["model"] == "translation"
            assert r["transform"][2] == pytest.approx(AT[a][0] - AT[b][0], abs=0.5) and r["transform"][5] == pytest.approx(AT[a][1] - AT[b][1], abs=0.5)
    assert report.photos.where("unreadable").count() == 1
    assert "group 0: [0, 1, 2, 3]" in engine.text_report(report)


def test_report_is_saved_and_read(spark, report, tmp_path):
    report.save(str(tmp_path / "r"))
    back = engine.Report.load(spark, str(tmp_path / "r"))
    assert back.identity() == report.identity() and back.config == report.config
    assert back.evidence.count() == report.evidence.count()


@pytest.mark.parametrize("blending", ["multiband", "none", "feather"])
def test_stitched_tiles_show_the_scene(report, blending):
    layout = engine.align(report)
    assert layout.model == "translation" and layout.rms < 0.5 and sorted(layout.transforms) == [0, 1, 2, 3]
    tiles = engine.stitch(report, layout, Stitching(blending=blending))
    out, x, y = stitching.assembled(tiles)
    anchor = AT[layout.anchor]
    whole = scene(520, 420)
    assert abs(out.shape[0] - 400) <= 2 and abs(out.shape[1] - 500) <= 2
    inner = out[150:250, 100:400, 0].astype(float) / 257
    want = whole[150 + anchor[1] + y : 250 + anchor[1] + y, 100 + anchor[0] + x : 400 + anchor[0] + x, 0].astype(float)
    assert np.abs(inner - want).mean() < 6
    rect = stitching.inscribed(out[..., 3] > 0)
    assert rect[2] * rect[3] > 0.6 * out.shape[0] * out.shape[1]


def test_keypoints_follow_a_shift_and_a_turn():
    a = scene(260, 220)[..., 0] / 255
    points, vectors = features.keypoints(a)
    turned, other = features.keypoints(np.rot90(a))
    assert len(points) > 40 and np.allclose((vectors**2).sum(axis=1), 1)
    d = ((vectors[:, None] - other[None]) ** 2).sum(axis=2)
    near = d.argmin(axis=1)
    moved = np.column_stack([points[:, 1], 259 - points[:, 0]])
    assert (np.linalg.norm(turned[near, :2] - moved, axis=1) < 2).mean() > 0.6


def test_png_round_trip():
    rng = np.random.default_rng(0)
    for dtype, channels in ((np.uint8, 1), (np.uint8, 3), (np.uint16, 4)):
        p = rng.integers(0, np.iinfo(dtype).max, (7, 9, channels)).astype(dtype)
        assert np.array_equal(images.decode_png(images.encode_png(p)), p)
    p = rng.integers(0, 255, (5, 12)).astype(np.uint8)
    above = np.zeros(12, np.uint8)
    for kind in range(5):
        filtered = np.array([(int(v) - _guess(p[1], p[0], i, kind, 3)) & 255 for i, v in enumerate(p[1])], np.uint8)
        assert np.array_equal(images._unfiltered(filtered, p[0], kind, 3), p[1])
    assert images._unfiltered(above, above, 4, 3).tolist() == [0] * 12
    with pytest.raises(ValueError):
        images.decode_png(b"abc")


def _guess(row, above, i, kind, step):
    a, c = (int(row[i - step]), int(above[i - step])) if i >= step else (0, 0)
    b = int(above[i])
    if kind < 4:
        return (0, a, b, (a + b) // 2)[kind]
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


def test_pixel_helpers():
    p = np.arange(24, dtype=np.uint8).reshape(4, 6, 1)
    assert images.reduced(p, 3, 2)[0, 0, 0] == pytest.approx(p[:2, :2].mean())
    assert images.reduced(p, 4, 3).mean() == pytest.approx(p.mean())
    assert images.working_size(4000, 3000, 1.5) == (1414, 1061)
    for o in range(1, 9):
        assert images.upright(p, o).shape[:2] == ((6, 4) if o >= 5 else (4, 6))
    assert images.upright(p, 6)[0, 0, 0] == p[3, 0, 0] and images.upright(p, 8)[0, 0, 0] == p[0, 5, 0]
    clear = np.zeros((2, 2, 4), np.uint16)
    assert (images.flattened(clear) == 65535).all() and (images.gray(clear) == 1).all()
    assert images.planar_canvas(np.full((10, 20, 3), 255, np.uint8), 10, (16, 8))[:, 4, 9].tolist() == [1, 1, 1]
    assert images.preview(np.zeros((100, 50, 3), np.uint8), 20).shape == (20, 10, 3)


def test_inscribed_equals_search():
    rng = random.Random(11)
    for _ in range(60):
        h, w = rng.randint(1, 10), rng.randint(1, 14)
        m = np.array([[rng.random() < 0.8 for _ in range(w)] for _ in range(h)])
        want = max(((y1 - y0) * (x1 - x0) for y0 in range(h) for y1 in range(y0 + 1, h + 1) for x0 in range(w) for x1 in range(x0 + 1, w + 1) if m[y0:y1, x0:x1].all()), default=0)
        x, y, a, b = stitching.inscribed(m)
        assert a * b == want and m[y : y + b, x : x + a].all()
    band = np.zeros((80, 300), bool)
    for i in range(300):
        band[10 + int(5 * np.sin(i / 20)) : 70 + int(5 * np.cos(i / 30)), i] = True
    x, y, a, b = stitching.inscribed(band, most=5000)
    assert band[y : y + b, x : x + a].all() and a * b >= 0.9 * stitching.inscribed(band)[2] * stitching.inscribed(band)[3]


def test_seams():
    assert stitching.seam_rounds([(0, 1), (2, 3), (1, 2), (0, 3)]) == {(0, 1): 1, (2, 3): 1, (1, 2): 2, (0, 3): 2}
    cost = np.full((6, 5), 9.0)
    for y, x in enumerate([1, 2, 2, 3, 2, 1]):
        cost[y, x] = 0
    assert stitching.cheapest_seam(cost).tolist() == [1, 2, 2, 3, 2, 1]
    small = np.zeros((4, 4), bool)
    small[:, 0] = True
    assert stitching.seam_mask(small, np.ones((8, 8), bool)).sum() == 32


def test_problem_of_two_sources(spark):
    rng = np.random.default_rng(0)
    a = rng.uniform(0, 1000, (400, 2))
    rows = [(1, 0, "x", i, *map(float, p + [30, 5]), *map(float, p), 0.4, 1000.0, 800.0, 1000.0, 800.0) for i, p in enumerate(a)]
    rows += [(0, 1, "y", i, *map(float, p), *map(float, p + [30.2, 5]), 1.0, 1000.0, 800.0, 1000.0, 800.0) for i, p in enumerate(a[:100])]
    df = spark.createDataFrame(rows, "a long, b long, source string, idx long, ax double, ay double, bx double, by double, rmse double, wa double, ha double, wb double, hb double")
    got = problem.build(df, CONFIG).collect()
    assert len(got) == 300 and {(r["a"], r["b"]) for r in got} == {(0, 1)}
    assert all(abs(r["bx"] - r["ax"] - 30) < 0.5 and r["sigma"] >= 0.5 for r in got)


def test_layout_helpers():
    sizes = dict.fromkeys(range(3), (100.0, 80.0))
    move = lambda x, y: np.array([[1, 0, x], [0, 1, y], [0, 0, 1.0]])
    assert problem.predicted({0: move(0, 0), 1: move(50, 0), 2: move(500, 0)}, sizes) == [(0, 1, pytest.approx(0.5))]
    placed = problem.placement([0, 1, 2], [(0, 1, 9, move(-50, 0))], sizes)
    assert placed[1][0, 2] - placed[0][0, 2] == pytest.approx(50) and placed[2][0, 2] > 150
    h = np.array([[1, 0.1, 3], [-0.1, 1, 4], [1e-4, 0, 1]])
    centre = np.array([50.0, 40.0])
    s = problem.local_similarity(h, centre)
    assert s[0, 0] == s[1, 1] and s[0, 1] == -s[1, 0]
    turn = alignment.rotation_matrix(np.array([0, 0.1, 0]))
    c = np.array([50.0, 40.0])
    assert np.allclose(problem.camera_homography(100, turn, c, 100, turn, c), np.eye(3))
    tilt = alignment.rotation_matrix(np.array([0.2, 0, 0.1]))
    level = problem.straightened({i: tilt @ alignment.rotation_matrix(np.array([0, y, 0])) for i, y in enumerate((-0.6, 0, 0.6))})
    assert max(abs(r[1, 0]) for r in level.values()) < 1e-6


def test_progress():
    seen, now = [], [0.0]
    meter = progress.Meter(seen.append, clock=lambda: now[0])
    for f in (0.1, 0.05, 0.1005, 0.2, 1.0):
        meter.update(f)
    meter.cancelled = True
    meter.update(1.0)
    assert seen == [0.1, 0.2, 1.0]
    both = progress.Combined({"a": 10, "b": 30})
    assert [both.update("a", 5), both.update("b", 15), both.update("a", 0)] == [0.125, 0.5, 0.5]
    assert list(progress.in_order(range(20), lambda x: x * x, 3)) == [x * x for x in range(20)]


def test_cancel_tag(spark):
    with progress.cancellable(spark, "job") as cancel:
        assert spark.range(3).count() == 3
        assert list(cancel()) == []
    assert spark.range(2).select(F.sum("id")).first()[0] == 1
