"""Rasters as keyed rows: (image, y, x, value) tables, aggregated rather than walked.

Where a kernel needs neighbours beyond what a window gives, rows are grouped into tiles and the
kernel runs on one tile in numpy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.blocks import BlockSystem
from tessella.functions.columns import mapped


def area_reduce(pixels: DataFrame, factor: int) -> DataFrame:
    """(image, y, x, value) reduced by a whole factor: the mean of each block."""
    return pixels.groupBy("image", F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")).agg(F.avg("value").alias("value"))


def percentile_levels(values: DataFrame, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """One row (low, high): the least values whose cumulated counts exceed floor(q n).

    Counts per value come first, so the window runs over different values, of which 16 bits hold 65536.
    """
    histogram = values.groupBy("value").agg(F.count("*").alias("n"))
    run = histogram.withColumns({"upto": F.sum("n").over(Window.orderBy("value")), "total": F.sum("n").over(Window.partitionBy(F.lit(1)))})
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(q * F.col("total")), F.col("value")))
    return run.agg(at(low).alias("low"), at(high).alias("high"))


def stretched(value: Column, low: Column, high: Column) -> Column:
    """16 bits to 8: between the levels if they are close, else by the upper byte."""
    useful = (high - low > 0) & (high - low < 32768)
    scaled = F.floor((value - low) * 255.0 / F.when(useful, high - low) + 0.5)
    return F.when(useful, F.least(F.lit(255), F.greatest(F.lit(0), scaled))).otherwise(F.floor(value / 257.0 + 0.5)).cast("int")


def oriented(x: Column, y: Column, w: Column, h: Column, orientation: Column) -> tuple[Column, Column]:
    """Where a stored pixel stands in the upright photo, for EXIF orientations 1 to 8."""
    right, down = w - 1 - x, h - 1 - y
    ox = F.when(orientation.isin(1, 4), x).when(orientation.isin(2, 3), right).when(orientation.isin(5, 8), y).otherwise(down)
    oy = F.when(orientation.isin(1, 2), y).when(orientation.isin(3, 4), down).when(orientation.isin(5, 6), x).otherwise(right)
    return ox, oy


def canvas(photos: DataFrame) -> DataFrame:
    """One row (x0, y0, x1, y1): the box around all photos (width, height, transform); null corners are an error."""
    corner = F.explode(F.array(*(F.struct((F.col("width") * i).cast("double").alias("x"), (F.col("height") * j).cast("double").alias("y")) for i in (0, 1) for j in (0, 1))))
    rows = photos.withColumn("c", corner)
    u, v = mapped(F.col("transform"), F.col("c.x"), F.col("c.y"))
    bad = u.isNull() | (F.abs(u) > 1e7) | (F.abs(v) > 1e7)
    rows = rows.select(F.when(bad, F.raise_error(F.lit("a photo lies behind the plane"))).otherwise(u).alias("u"), v.alias("v"))
    return rows.agg(F.floor(F.min("u")).alias("x0"), F.floor(F.min("v")).alias("y0"), F.ceil(F.max("u")).alias("x1"), F.ceil(F.max("v")).alias("y1"))


def outline(photos: DataFrame, steps: int = 8) -> DataFrame:
    """(image, k, u, v): points along each photo's edge in the panorama."""
    t = F.sequence(F.lit(0), F.lit(4 * steps - 1))
    rows = photos.withColumn("k", F.explode(t)).withColumns({"side": F.floor(F.col("k") / steps), "at": (F.col("k") % steps) / steps})
    x = F.when(F.col("side") == 0, F.col("at")).when(F.col("side") == 1, 1.0).when(F.col("side") == 2, 1 - F.col("at")).otherwise(0.0) * F.col("width")
    y = F.when(F.col("side") == 0, 0.0).when(F.col("side") == 1, F.col("at")).when(F.col("side") == 2, 1.0).otherwise(1 - F.col("at")) * F.col("height")
    u, v = mapped(F.col("transform"), x, y)
    return rows.select("image", "k", u.alias("u"), v.alias("v"))


def warp_nearest(pixels: DataFrame, places: DataFrame) -> DataFrame:
    """(u, v, image, value) of pixels moved by whole-pixel offsets (image, dx, dy)."""
    return pixels.join(places, "image").select((F.col("x") + F.col("dx")).alias("u"), (F.col("y") + F.col("dy")).alias("v"), "image", "value")


def overlap_depth(warped: DataFrame) -> DataFrame:
    return warped.groupBy("u", "v").agg(F.count("*").alias("depth")).agg(F.max("depth").alias("depth"))


def hard(warped: DataFrame) -> DataFrame:
    """The last photo wins where it covers."""
    return warped.groupBy("u", "v").agg(F.max_by("value", "image").alias("value"), F.max("image").alias("image"))


def feathered(warped: DataFrame) -> DataFrame:
    """One band: the mean weighted by (…, weight)."""
    return warped.groupBy("u", "v").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"))


def voronoi(warped: DataFrame, centres: DataFrame) -> DataFrame:
    """(u, v, image): of the photos that cover a pixel the one whose centre is nearest; ties to the lower."""
    d = (F.col("u") - F.col("cx")) * (F.col("u") - F.col("cx")) + (F.col("v") - F.col("cy")) * (F.col("v") - F.col("cy"))
    return warped.join(centres, "image").withColumn("d", d).groupBy("u", "v").agg(F.min_by("image", F.struct("d", "image")).alias("image"))


def overlap_means(warped: DataFrame, by: Sequence[str] = (), owner: str = "image") -> DataFrame:
    """(by…, i, j, n, mi, mj): over the pixels that two images of different owners share, how many and each one's mean."""
    left = warped.select("u", "v", *by, F.col("image").alias("i"), F.col(owner).alias("oi"), F.col("value").alias("vi"))
    right = warped.select("u", "v", *by, F.col("image").alias("j"), F.col(owner).alias("oj"), F.col("value").alias("vj"))
    return left.join(right, ["u", "v", *by]).where("oi < oj").groupBy(*by, "i", "j").agg(F.count("*").alias("n"), F.avg("vi").alias("mi"), F.avg("vj").alias("mj"))


def gains(means: Sequence[tuple[int, int, int, float, float]], deviation: float = 10.0, spread: float = 0.1) -> dict[int, float]:
    """Exposure gains that level the overlaps and stay near 1: a small linear system, one unknown a photo."""
    photos = sorted({p for i, j, *_ in means for p in (i, j)})
    at = {p: k for k, p in enumerate(photos)}
    system = BlockSystem([1] * len(photos))
    for i, j, n, mi, mj in means:
        for x, m in ((at[i], mi), (at[j], mj)):
            system.add(x, x, np.array([[n * (m * m / deviation**2 + 1 / spread**2)]]))
            system.add_side(x, np.array([-n / spread**2]))
        system.add(max(at[i], at[j]), min(at[i], at[j]), np.array([[-n * mi * mj / deviation**2]]))
    return dict(zip(photos, system.solved().tolist(), strict=True))


def finished(composite: DataFrame) -> DataFrame:
    """Pixels with alpha 0 lose their colour."""
    return composite.withColumn("value", F.when(F.col("alpha") > 0, F.col("value")).otherwise(0))


def column_heights(mask: DataFrame) -> DataFrame:
    """(image, y, x, height): how many set pixels end here, going up a column of (image, y, x, v)."""
    breaks = F.max(F.when(F.col("v") == 0, F.col("y"))).over(Window.partitionBy("image", "x").orderBy("y"))
    first = F.min("y").over(Window.partitionBy("image", "x"))
    return mask.select("image", "y", "x", F.when(F.col("v") > 0, F.col("y") - F.coalesce(breaks, first - 1)).otherwise(0).alias("height"))


def largest_rectangle(mask: DataFrame) -> DataFrame:
    """(image, area, y, x, width, height) of each mask's largest all-set rectangle; of equals the uppermost, then leftmost.

    Column heights are a window; each row then finds its best rectangle with a stack, rows in parallel.
    """

    def best(key: tuple, row: pd.DataFrame) -> pd.DataFrame:
        row = row.sort_values("x")
        xs, hs = row["x"].tolist(), row["height"].tolist()
        out, stack = (0, 0, 0, 0, 0), []
        for i, h in enumerate([*hs, 0]):
            start = i
            while stack and stack[-1][1] >= h:
                at, tall = stack.pop()
                found = (tall * (i - at), int(key[1]) - tall + 1, xs[at], i - at, tall)
                if tall and (found[0], -found[1], -found[2]) > (out[0], -out[1], -out[2]):
                    out = found
                start = at
            stack.append((start, h))
        return pd.DataFrame([(key[0], *out)], columns=["image", "area", "y", "x", "width", "height"])

    rows = column_heights(mask).groupBy("image", "y").applyInPandas(best, "image long, area long, y long, x long, width long, height long")
    top = F.max_by(F.struct("area", "y", "x", "width", "height"), F.struct("area", -F.col("y"), -F.col("x"))).alias("r")
    return rows.where("area > 0").groupBy("image").agg(top).select("image", "r.*")


def local_maxima(pixels: DataFrame) -> DataFrame:
    """(image, y, x, value) of pixels that no neighbour in 3x3 exceeds; NaN never is one.

    Two passes of one-dimensional windows, rows then columns, instead of a join with eight neighbours.
    """
    usable = F.when(F.isnan("value"), float("-inf")).otherwise(F.col("value"))
    across = F.max(usable).over(Window.partitionBy("image", "y").orderBy("x").rangeBetween(-1, 1))
    rows = pixels.withColumn("across", across)
    down = F.max("across").over(Window.partitionBy("image", "x").orderBy("y").rangeBetween(-1, 1))
    return rows.withColumn("top", down).where(~F.isnan("value") & (F.col("value") >= F.col("top"))).select("image", "y", "x", "value")


def laplacian_variance(pixels: DataFrame) -> DataFrame:
    """(image, sharpness): the variance of the 4-neighbour Laplacian over inner pixels."""
    rows = Window.partitionBy("image", "y").orderBy("x")
    columns = Window.partitionBy("image", "x").orderBy("y")
    both = pixels.withColumns({"l": F.lag("value").over(rows), "r": F.lead("value").over(rows)})
    both = both.withColumns({"u": F.lag("value").over(columns), "d": F.lead("value").over(columns)})
    lap = both.withColumn("lap", F.col("l") + F.col("r") + F.col("u") + F.col("d") - 4 * F.col("value")).where("lap IS NOT NULL")
    return lap.groupBy("image").agg((F.avg(F.col("lap") * F.col("lap")) - F.avg("lap") * F.avg("lap")).alias("sharpness"))


def multi_band(images: list[np.ndarray], weights: list[np.ndarray], bands: int) -> np.ndarray:
    """Laplacian bands of tiles with their halo, each blended by equally smoothed weights."""

    def down(a):
        p = np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2)), mode="edge")
        return (p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]) / 4

    def up(a, shape):
        return a.repeat(2, axis=0).repeat(2, axis=1)[: shape[0], : shape[1]]

    total = norm = None
    for image, weight in zip(images, weights, strict=True):
        a, w, levels = image.astype(float), weight.astype(float), []
        for _ in range(bands):
            if min(a.shape) < 2:
                break
            small = down(a)
            levels.append((a - up(small, a.shape), w))
            a, w = small, down(w)
        levels.append((a, w))
        if total is None:
            total, norm = [np.zeros_like(v) for v, _ in levels], [np.zeros_like(v) for v, _ in levels]
        for k, (v, own) in enumerate(levels):
            total[k] += v * own
            norm[k] += own
    out = total[-1] / np.maximum(norm[-1], 1e-12)
    for v, n in zip(total[-2::-1], norm[-2::-1], strict=True):
        out = v / np.maximum(n, 1e-12) + up(out, v.shape)
    return out


def band_count(area: Column) -> Column:
    """How many bands a blend takes, from the canvas area."""
    wanted = F.ceil(F.log2(F.greatest(F.lit(2.0), 0.05 * F.sqrt(area)))) - 1
    return F.least(F.lit(10), F.greatest(F.lit(1), wanted)).cast("int")


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dx, dy, peak) by which ``b`` is shifted against ``a``: Hann window, phase of the cross spectrum."""
    window = np.outer(np.hanning(a.shape[0]), np.hanning(a.shape[1]))
    fa, fb = np.fft.rfft2((a - a.mean()) * window), np.fft.rfft2((b - b.mean()) * window)
    cross = np.conj(fa) * fb
    surface = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-12), s=a.shape)
    y, x = np.unravel_index(int(np.argmax(surface)), surface.shape)

    def fine(left, mid, right):
        below = left - 2 * mid + right
        return 0.0 if abs(below) < 1e-12 else 0.5 * (left - right) / below

    h, w = surface.shape
    dy = y + fine(surface[y - 1, x], surface[y, x], surface[(y + 1) % h, x])
    dx = x + fine(surface[y, x - 1], surface[y, x], surface[y, (x + 1) % w])
    return float(dx - w if dx > w / 2 else dx), float(dy - h if dy > h / 2 else dy), float(surface[y, x])


def common_profile(photos: DataFrame, group: str, profile: str, default: str = "default") -> DataFrame:
    """(group, profile): the colour profile that all photos of a group share, else the default; null counts as one of its own."""
    got = photos.groupBy(group).agg(F.count_distinct(F.coalesce(F.col(profile).cast("string"), F.lit(""))).alias("n"), F.min(F.col(profile).cast("string")).alias("only"))
    return got.select(group, F.when((F.col("n") == 1) & F.col("only").isNotNull(), F.col("only")).otherwise(default).alias("profile"))


def bilinear(pixels: DataFrame, asked: DataFrame) -> DataFrame:
    """(image, q, value) of pixels (image, y, x, value) at points (image, q, x, y): each asks for the pixels around it."""
    at = asked.select("image", "q", F.col("x").alias("px"), F.col("y").alias("py"))
    near = at.withColumn("x", F.explode(F.array(F.floor("px"), F.floor("px") + 1))).withColumn("y", F.explode(F.array(F.floor("py"), F.floor("py") + 1)))
    weight = (1 - F.abs(F.col("px") - F.col("x"))) * (1 - F.abs(F.col("py") - F.col("y")))
    return near.withColumn("weight", weight).join(pixels, ["image", "y", "x"]).groupBy("image", "q").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def circular_gap(yaws: DataFrame, group: str = "project") -> DataFrame:
    """(group, gap, extent, middle) of angles (group, yaw) in degrees: each project's widest empty arc, and the rest."""
    rows = yaws.withColumn("before", F.lag("yaw").over(Window.partitionBy(group).orderBy("yaw")))
    last = F.max("yaw").over(Window.partitionBy(group))
    best = rows.withColumn("gap", F.col("yaw") - F.coalesce(F.col("before"), last - 360)).groupBy(group).agg(F.max_by(F.struct("gap", "yaw"), F.struct("gap", -F.col("yaw"))).alias("g"))
    extent = 360 - F.col("g.gap")
    return best.select(group, F.col("g.gap").alias("gap"), extent.alias("extent"), F.pmod(F.col("g.yaw") + extent / 2, F.lit(360.0)).alias("middle"))
