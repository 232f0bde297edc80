"""Queries of model fitting, verification, alignment and rendering kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.operators import alignment, frames, problem, stitching, verification
from tessella.operators.raster import multi_band
from tessella.plans.inputs import given, over
from tessella.plans.joins import t_of

c = F.col


def _pairs(spark, sf_dir) -> DataFrame:
    """Matches of twelve pairs of neighbours: photo p and p + 1, a shift with some noise."""
    m = given(spark, sf_dir, "matches")
    size = {k: F.lit(v) for k, v in (("wa", 1000.0), ("ha", 800.0), ("wb", 1000.0), ("hb", 800.0))}
    return m.select(c("pair").alias("a"), (c("pair") + 1).alias("b"), F.lit("s").alias("source"), c("idx").cast("int").alias("idx"), "ax", "ay", (c("bx") + 40 + c("pair")).alias("bx"), (c("by_") - 7).alias("by")).withColumns(size)


def a4_model_fits(spark, sf_dir):
    """Robust translations of each pair."""
    fits = verification.model_fits(_pairs(spark, sf_dir).withColumn("threshold", F.lit(4.0)), "translation")
    return fits.select("a", "b", F.size("inliers").alias("inliers"), F.round("rmse", 4).alias("rmse"))


def v1_verify(spark, sf_dir):
    return verification.verify(_pairs(spark, sf_dir), "automatic").select("a", "b", "model", "matches", "verdict")


def n7_problem(spark, sf_dir):
    return problem.build(_pairs(spark, sf_dir).withColumn("rmse", F.lit(1.0))).select("a", "b", "idx")


def _aligned(spark, sf_dir, model: str, rounds: int) -> alignment.Layout:
    m = _pairs(spark, sf_dir).withColumn("sigma", F.lit(1.0)).select("a", "b", "idx", "ax", "ay", "bx", "by", "sigma")
    pairs = alignment.uncapped(m)
    return alignment.solve_linear(model, sorted({x for ends in alignment.ends_of(pairs) for x in ends}), pairs, 0, rounds)


def n2_translations(spark, sf_dir):
    """A chain of photos: least squares without reweighting are sums of mean shifts."""
    layout = _aligned(spark, sf_dir, "translation", 1)
    rows = [(int(p), round(t[0, 2], 4), round(t[1, 2], 4)) for p, t in layout.transforms.items()]
    return spark.createDataFrame([(p, float(x), float(y)) for p, x, y in rows], "image long, x double, y double")


def n2_affine_layout(spark, sf_dir):
    layout = _aligned(spark, sf_dir, "affine", 8)
    return spark.createDataFrame([(p, [float(v) for v in t]) for p, t in alignment.rows_of(layout)], "image long, transform array<double>")


def k10_alignment_summary(spark, sf_dir):
    """Names and errors of an alignment's pairs, worst first."""
    layout = _aligned(spark, sf_dir, "similarity", 8)
    errors = spark.createDataFrame([(int(a), int(b), float(v)) for (a, b), v in layout.pair_rms.items()], "a long, b long, rms double")
    names = given(spark, sf_dir, "photos").select("id", "name")
    joined = errors.join(names.toDF("a", "name_a"), "a").join(names.toDF("b", "name_b"), "b")
    return joined.select("name_a", "name_b", F.round("rms", 3).alias("rms")).orderBy(F.desc("rms"))


def f7_overlap_areas(spark, sf_dir):
    """Overlap areas of photos under pure shifts: the rectangle of one in the other's, by half-planes."""
    p = given(spark, sf_dir, "photos").select("id", (c("id") * 37 % 1500 - 700).cast("double").alias("x"), (c("id") * 23 % 1200 - 500).cast("double").alias("y"))
    moved = C.rectangle(c("x"), c("y"), c("x") + 1000, c("y") + 800)
    own = C.rectangle(F.lit(0), F.lit(0), F.lit(1000), F.lit(800))
    return p.select("id", F.round(F.abs(C.signed_area(C.clipped(moved, own))), 3).alias("area"))


def f6_clipped_areas(spark, sf_dir):
    """Boxes clipped to a window, by half-planes."""
    window = C.rectangle(F.lit(0), F.lit(0), F.lit(600), F.lit(500))
    shape = C.rectangle(c("x0"), c("y0"), c("x0") + c("w"), c("y0") + c("h"))
    return given(spark, sf_dir, "boxes").select("id", F.round(F.abs(C.signed_area(C.clipped(shape, window))), 3).alias("area"))


def g6_local_similarities(spark, sf_dir):
    """What each photo's map looks like at a point; null where the point is behind the plane."""
    a, b = C.local_similarity(c("t"), F.lit(300.0), F.lit(200.0))
    return given(spark, sf_dir, "maps").select("image", t_of().alias("t")).select("image", F.round(a, 5).alias("a"), F.round(b, 5).alias("b"))


def r7_multi_band(spark, sf_dir):
    """Two neighbouring photos of each row of four blended by bands, a tile per group."""

    def blended(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        grid = {i: np.zeros((40, 50)) for i in (0, 1)}
        for image, y, x, v in zip(rows["image"], rows["y"], rows["x"], rows["value"], strict=True):
            grid[image % 2][int(y), int(x)] = v
        left = np.zeros((40, 50))
        left[:, :25] = 1
        out = multi_band([grid[0], grid[1]], [left, 1 - left], 3)
        return pd.DataFrame({"tile": [key[0]], "mean": [out.mean()], "least": [out.min()], "most": [out.max()]})

    p = given(spark, sf_dir, "pixels").withColumn("tile", F.floor(c("image") / 2))
    return p.groupBy("tile").applyInPandas(blended, "tile long, mean double, least double, most double")


def r5_seam_rounds(spark, sf_dir):
    """Rounds of seams: the pairs of one project, in order."""
    pairs = [(r["a"], r["b"]) for r in given(spark, sf_dir, "links").orderBy("a", "b").collect()]
    return spark.createDataFrame([(a, b, n) for (a, b), n in stitching.seam_rounds(pairs).items()], "a long, b long, round int")


def v7_model_choice(spark, sf_dir):
    """The kind of map that a chain of photos takes."""
    m = _pairs(spark, sf_dir).withColumn("sigma", F.lit(1.0)).select("a", "b", "idx", "ax", "ay", "bx", "by", "sigma")
    pairs = alignment.uncapped(m)
    layout = alignment.choose(sorted({x for ends in alignment.ends_of(pairs) for x in ends}), pairs, 0)
    return spark.createDataFrame([(layout.model, bool(layout.rms < 10))], "model string, near boolean")


def w9_selected_track(spark, sf_dir):
    """Frames kept along the positions that shifts and their peaks give: both steps together."""
    f = given(spark, sf_dir, "frames")
    at = frames.positions(f).join(f.select("video", "idx", "sharpness"), ["video", "idx"])
    return frames.select_frames(at.select("video", "idx", F.col("position").alias("px"), F.lit(0.0).alias("py"), "sharpness"))


def g5_first_layout(spark, sf_dir):
    """A first layout of a project's photos along its strongest links."""
    links = [(r["a"], r["b"], float(r["inliers"]), np.array([[1, 0, 10.0 * r["a"] - 5.0 * r["b"]], [0, 1, 3.0], [0, 0, 1]])) for r in given(spark, sf_dir, "links").orderBy("a", "b").collect()]
    ids = [r["id"] for r in given(spark, sf_dir, "vertices").orderBy("id").collect()]
    placed = problem.placement(ids, links, {i: (1000.0, 800.0) for i in ids})
    return spark.createDataFrame([(int(i), float(t[0, 2]), float(t[1, 2])) for i, t in sorted(placed.items())], "image long, x double, y double")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k.split("_")[0] in ("a4", "v1", "n7", "n2", "k10", "f7", "f6", "g6", "r7", "r5", "v7", "w9", "g5")}

ORACLES = {
    "n2_translations": over("matches", """, s AS (SELECT pair, avg(ax - bx - 40 - pair) AS dx, avg(ay - by_ + 7) AS dy FROM matches GROUP BY 1)
        SELECT 0 AS image, 0.0 AS x, 0.0 AS y UNION ALL SELECT pair + 1, round(sum(dx) OVER (ORDER BY pair), 4), round(sum(dy) OVER (ORDER BY pair), 4) FROM s"""),
    "f7_overlap_areas": over("photos", ", s AS (SELECT id, id * 37 % 1500 - 700 AS x, id * 23 % 1200 - 500 AS y FROM photos) SELECT id, (greatest(0, 1000 - abs(x)) * greatest(0, 800 - abs(y)))::DOUBLE AS area FROM s"),
    "f6_clipped_areas": over("boxes", "SELECT id, round(greatest(0, least(600, x0 + w) - greatest(0, x0)) * greatest(0, least(500, y0 + h) - greatest(0, y0)), 3) AS area FROM boxes"),
    "w9_selected_track": None,
}
ORACLES = {k: v for k, v in ORACLES.items() if v}
