"""Column expressions: projective maps, polygons, norms, photo scalars. All stay inside codegen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = F.lit


def mapped(t: Column, x: Column, y: Column, least: float = 1e-9) -> tuple[Column, Column]:
    """The point (x, y) through the row-major 3x3 map ``t``; null where it lies behind the plane."""
    z = t[6] * x + t[7] * y + t[8]
    inside = z > least
    return F.when(inside, (t[0] * x + t[1] * y + t[2]) / z), F.when(inside, (t[3] * x + t[4] * y + t[5]) / z)


def jacobian(t: Column, x: Column, y: Column, h: float = 0.5) -> tuple[Column, Column, Column, Column]:
    """dx'/dx, dx'/dy, dy'/dx, dy'/dy by central differences."""
    right, left = mapped(t, x + h, y), mapped(t, x - h, y)
    down, up = mapped(t, x, y + h), mapped(t, x, y - h)
    return (right[0] - left[0]) / (2 * h), (down[0] - up[0]) / (2 * h), (right[1] - left[1]) / (2 * h), (down[1] - up[1]) / (2 * h)


def singular_values(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Of the matrix ((a, b), (c, d)), larger first."""
    sum_ = a * a + b * b + c * c + d * d
    det = a * d - b * c
    root = F.sqrt(F.greatest(sum_ * sum_ - 4 * det * det, F.lit(0.0)))
    return F.sqrt((sum_ + root) / 2), F.sqrt(F.greatest((sum_ - root) / 2, F.lit(0.0)))


def stretch(t: Column, x: Column, y: Column) -> Column:
    """The square root of the map's local area change."""
    a, b, c, d = jacobian(t, x, y)
    return F.sqrt(F.abs(a * d - b * c))


def determinant(t: Column) -> Column:
    return t[0] * (t[4] * t[8] - t[5] * t[7]) - t[1] * (t[3] * t[8] - t[5] * t[6]) + t[2] * (t[3] * t[7] - t[4] * t[6])


def inverse(t: Column) -> Column:
    """The inverse of a 3x3 map, null where its determinant vanishes."""
    det = determinant(t)
    rows = [(4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3)]
    return F.when(F.abs(det) > 1e-12, F.array(*((t[i] * t[j] - t[k] * t[m]) / det for i, j, k, m in rows)))


def product(s: Column, t: Column) -> Column:
    return F.array(*(s[3 * i] * t[j] + s[3 * i + 1] * t[3 + j] + s[3 * i + 2] * t[6 + j] for i in range(3) for j in range(3)))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that it names several times: as a lambda's variable it is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _turned(items: Column) -> Column:
    """An array with its first item last."""
    return F.concat(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 1, 1))


def signed_area(points: Column) -> Column:
    """Shoelace area of an array of (x, y) structs."""
    crossed = _once(points, lambda own: F.zip_with(own, _turned(own), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]))
    return F.aggregate(crossed, F.lit(0.0), lambda s, v: s + v) / 2


def contains(points: Column, x: Column, y: Column) -> Column:
    """Whether a convex polygon holds a point; false for fewer than three corners or no area."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    side = F.zip_with(points, following, lambda p, q: (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"]))
    one_side = F.forall(side, lambda v: v >= 0) | F.forall(side, lambda v: v <= 0)
    return (F.size(points) >= 3) & (F.abs(signed_area(points)) > 1e-12) & one_side


def even_odd(points: Column, x: Column, y: Column) -> Column:
    """Whether any polygon holds a point, by the parity of crossed edges."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    crossed = F.zip_with(
        points, following,
        lambda p, q: F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]), 1).otherwise(0),
    )
    return F.aggregate(crossed, F.lit(0), lambda s, v: s + v) % 2 == 1


def clipped(points: Column, window: Column) -> Column:
    """A convex polygon within a convex window of either orientation, both arrays of (x, y) structs."""
    edge = lambda p, q: F.struct(p["x"].alias("x"), p["y"].alias("y"), (q["x"] - p["x"]).alias("u"), (q["y"] - p["y"]).alias("v"))
    edges = _once(F.when(signed_area(window) >= 0, window).otherwise(F.reverse(window)), lambda w: F.zip_with(w, _turned(w), edge))

    def half(polygon: Column, edge: Column) -> Column:
        side = lambda p: edge["u"] * (p["y"] - edge["y"]) - edge["v"] * (p["x"] - edge["x"])
        sided = F.transform(polygon, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), side(p).alias("s")))

        def step(p: Column, q: Column) -> Column:
            share = p["s"] / (p["s"] - q["s"])
            own = F.struct(p["x"].alias("x"), p["y"].alias("y"))
            cut = F.struct((p["x"] + (q["x"] - p["x"]) * share).alias("x"), (p["y"] + (q["y"] - p["y"]) * share).alias("y"))
            crosses = (p["s"] < 0) != (q["s"] < 0)
            return F.when((p["s"] >= 0) & crosses, F.array(own, cut)).when(p["s"] >= 0, F.array(own)).when(crosses, F.array(cut)).otherwise(F.slice(F.array(own), 1, 0))

        return F.flatten(_once(sided, lambda s: F.zip_with(s, _turned(s), step)))

    return F.aggregate(edges, points, half)


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The corners of a box, in order."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))


def normalised(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A keypoint about the photo's middle, in halves of its long side."""
    half = F.greatest(width, height) / 2
    return (x - width / 2) / half, (y - height / 2) / half


def learned_rescaled(v: Column, middle: float, correction: float = 0.42) -> Column:
    """A learned extractor's coordinate with its stretch about the canvas centre taken back."""
    return (v - middle) * (1 + correction / middle) + middle


def local_similarity(t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """(a, b) of the similarity ((a, -b), (b, a)) that a map looks like at a point."""
    a, b, c, d = jacobian(t, x, y)
    return (a + d) / 2, (c - b) / 2


def l2_normalised(vector: Column) -> Column:
    """A vector by its length; zero stays zero."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.transform(vector, lambda v: F.when(length > 0, v.cast("double") / length).otherwise(0.0))


def percent_encoded(text: Column) -> Column:
    """A path component for a URL."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def projection_of(extent: Column, widest: float = 330.0, flat: float = 100.0) -> Column:
    """How a sweep of so many degrees is drawn; ``refused`` beyond the widest."""
    return F.when(extent > widest, "refused").when(extent > flat, "cylindrical").otherwise("rectilinear")


def huber(s: Column, k: float = 2.0) -> Column:
    return F.when(s <= k, 1.0).otherwise(k / s)


def root_sift(vector: Column) -> Column:
    """L1-normalised, then the square root of each value."""
    total = F.aggregate(vector, F.lit(0.0), lambda s, v: s + F.abs(v.cast("double")))
    return F.transform(vector, lambda v: F.when(total > 0, F.sqrt(F.abs(v.cast("double")) / total)).otherwise(0.0))


def selu(x: Column) -> Column:
    return 1.0507009873554805 * F.when(x > 0, x).otherwise(1.6732632423543772 * (F.exp(x) - 1))


def inlier_threshold(width: Column, height: Column, at_megapixel: float = 3.0) -> Column:
    return at_megapixel * F.sqrt(width * height / 1e6)


def focal_prior(f35: Column, width: Column, height: Column) -> Column:
    """Focal length in pixels from the 35 mm equivalent and the photo's diagonal."""
    return f35 * F.sqrt((width * width + height * height).cast("double")) / 43.2666


def long_side(width: Column, height: Column, megapixels: float) -> Column:
    longest = F.greatest(width, height)
    return F.floor(longest * F.least(F.lit(1.0), F.sqrt(megapixels * 1e6 / (width * height))) + 0.5)


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def nan_last(x: Column) -> Column:
    """A sort key under which NaN ranks below every number in descending order."""
    return F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(x)


def rescaled(v: Column, factor: Column | float) -> Column:
    """A pixel-centre coordinate on another grid."""
    return (v + 0.5) * factor - 0.5


def track_orientation(b: Column, a: Column) -> Column:
    """0, 90, 180 or 270 degrees from the first column (a, b) of an affine map."""
    return F.pmod(F.round(F.degrees(F.atan2(b, a)) / 90).cast("int") * 90, F.lit(360))


def facing(depth_behind: Column, points: Column) -> Column:
    """-1 where most of a pair's points lie behind the plane, so that its map is turned round; else 1."""
    return F.when(2 * depth_behind > points, -1).otherwise(1)
