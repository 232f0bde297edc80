"""Smaller kernels against direct versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import columns, features, models
from tessella.operators import candidates, frames, graph


def direct_maxima(logits):
    h, w = logits.shape
    out = []
    for y in range(h):
        for x in range(w):
            v = logits[y, x]
            near = [logits[j, i] for j in range(max(0, y - 1), min(h, y + 2)) for i in range(max(0, x - 1), min(w, x + 2)) if not np.isnan(logits[j, i])]
            if not np.isnan(v) and v > -np.inf and v >= max(near):
                out.append((-v, y * w + x))
    return [divmod(k, w) for _, k in sorted(out)]


def test_ranked_maxima():
    rng = np.random.default_rng(3)
    for case in range(4):
        logits = rng.integers(0, 6, (12, 14)).astype(float) if case == 1 else rng.normal(size=(12, 14))
        if case == 2:
            logits[3, 3], logits[5, 5], logits[0, 0] = np.nan, np.inf, -np.inf
        want = direct_maxima(logits)
        got = features.ranked_maxima(logits, logits, 1000)
        assert len(got) == len(want)
        assert all(abs(p[0] - 0.5 - x) <= 1 and abs(p[1] - 0.5 - y) <= 1 for p, (y, x) in zip(got, want, strict=True))
    ranker = rng.normal(size=(12, 14))
    few = features.ranked_maxima(rng.normal(size=(12, 14)), ranker, 5, margin=3)
    assert len(few) == 5 and np.isfinite(few).all()


def test_tangent_affine():
    h = np.array([[1, 0.1, 3], [-0.1, 1.2, 4], [1e-4, 2e-4, 1]])
    p = np.array([[100.0, 50.0], [300.0, 250.0], [200.0, 10.0]])
    t = models.tangent_affine(h, p)
    c = p.mean(axis=0)[None]
    assert np.allclose(models.apply(t, c), models.apply(h, c))
    for d in (np.array([[1e-3, 0]]), np.array([[0, 1e-3]])):
        assert np.allclose(models.apply(t, c + d), models.apply(h, c + d), atol=1e-6)


def test_grown_tree_is_a_maximum_tree(spark):
    rng = np.random.default_rng(4)
    pairs = [(i, j, int(w)) for (i, j), w in zip([(i, j) for i in range(9) for j in range(i + 1, 9)], rng.permutation(36), strict=True)]
    got = graph.grown_tree(pairs, 3)
    want = candidates.spanning_tree(spark.createDataFrame(pairs, "a long, b long, affinity long")).collect()
    assert {tuple(r) for r in want} == set(got) and 3 in got[0]


def test_facing(spark):
    rows = spark.createDataFrame([(3, 5), (2, 5)], "behind long, n long")
    assert [r[0] for r in rows.select(columns.facing(F.col("behind"), F.col("n"))).collect()] == [-1, 1]


def test_measured_frames(spark):
    rng = np.random.default_rng(5)
    spectrum = np.exp(-np.hypot(*np.meshgrid(np.fft.fftfreq(400), np.fft.fftfreq(300))) * 20)
    scene = np.real(np.fft.ifft2(np.fft.fft2(rng.normal(size=(300, 400))) * spectrum))
    scene = ((scene - scene.min()) / (scene.max() - scene.min()) * 255).astype(np.uint8)
    rows = [(v, i, 160, 200, scene[20 : 180, 10 + 8 * i : 210 + 8 * i].tobytes()) for v in ("a", "b") for i in range(4)]
    df = spark.createDataFrame(rows, "video string, idx long, height int, width int, pixels binary").repartition(3)
    got = {(r["video"], r["idx"]): r for r in frames.measure_frames(df).collect()}
    assert len(got) == 8 and got["a", 0]["dx"] == 0
    for v in "ab":
        for i in (1, 2, 3):
            assert got[v, i]["dx"] == pytest.approx(8 / 200, abs=0.01) and abs(got[v, i]["dy"]) < 0.01 and got[v, i]["sharpness"] > 0
