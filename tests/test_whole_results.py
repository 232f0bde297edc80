"""Results that must not depend on a cap: copies, missing values, long chains."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import CONFIG, scene

from tessella import engine
from tessella.config import DEFAULTS
from tessella.operators import graph, matching, problem, verification
from tessella.plans import models as plans
from tessella.sources import images

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("copies", "rows"), [(6, 500), (60, 300), (300, 1000), (700, 700)])
def test_nearest_takes_the_lowest_of_many_copies(copies, rows):
    for seed in range(10):
        rng = np.random.default_rng(seed)
        b = rng.normal(size=(rows, 64))
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        same = np.sort(rng.permutation(rows)[:copies])
        b[same] = b[same[0]]
        a = np.concatenate([b[same[:1]] + rng.normal(size=(20, 64)) * 1e-3, rng.normal(size=(20, 64))])
        d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
        best, first, second = matching.nearest(a, b)
        assert best.tolist() == d.argmin(axis=1).tolist()
        two = np.sort(d, axis=1)[:, :2]
        assert (first == two[:, 0]).all() and (second == two[:, 1]).all()


def test_centre_of_a_long_chain(spark):
    """The end photo has the heaviest link: it wins if far photos tie at a cap."""
    n = 141
    edges = spark.createDataFrame([(i, i + 1, 1000 if i == 0 else 1) for i in range(n - 1)], "a long, b long, weight long")
    first = graph.centre(edges, spark.range(n)).first()
    assert (first["id"], first["eccentricity"]) == (n // 2, n // 2)


@pytest.mark.parametrize(("name", "module", "step"), [("v1_verify", verification, "verify"), ("a4_model_fits", verification, "model_fits"), ("n7_problem", problem, "build")])
def test_queries_draw_as_often_as_the_defaults(spark, monkeypatch, name, module, step):
    got, run = [], getattr(module, step)

    def seen(*args, **named):
        got.append(next((x for x in (*args, *named.values()) if isinstance(x, type(DEFAULTS))), DEFAULTS))
        return run(*args, **named)

    monkeypatch.setattr(module, step, seen)
    plans.QUERIES[name](spark, SF)
    assert got == [DEFAULTS]


def test_local_similarities_of_all_maps(spark, monkeypatch):
    maps = plans.given(spark, SF, "maps")
    got = plans.QUERIES["g6_local_similarities"](spark, SF).collect()
    assert sorted(r["image"] for r in got) == sorted(r["image"] for r in maps.select("image").collect())
    assert all(r["a"] is not None and r["b"] is not None for r in got)
    behind = maps.limit(3).withColumn("t8", F.lit(-2.0))
    monkeypatch.setattr(plans, "given", lambda *_: behind)
    assert [(r["a"], r["b"]) for r in plans.QUERIES["g6_local_similarities"](spark, SF).collect()] == [(None, None)] * 3


def test_analysis_compares_the_pairs_that_the_layout_predicts(spark, tmp_path):
    at = [(190 * (i % 3), 150 * (i // 3)) for i in range(9)]
    whole = scene(680, 540)
    for i, (x, y) in enumerate(at):
        (tmp_path / f"tile{i}.png").write_bytes(images.encode_png(whole[y : y + 240, x : x + 300]))
    report = engine.analyze(spark, str(tmp_path), CONFIG)
    rows = {(r["a"], r["b"]): r["reasons"] for r in report.candidates.collect()}
    shared = {(a, b) for b in range(9) for a in range(b) if max(300 - abs(at[a][0] - at[b][0]), 0) * max(240 - abs(at[a][1] - at[b][1]), 0) > 0.06 * 300 * 240}
    assert shared <= set(rows) and ["overlap"] in rows.values()
    assert len(rows) == report.candidates.count()
    assert {(r["a"], r["b"]) for r in report.evidence.collect()} >= shared
