"""Descriptor similarity joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.config import DEFAULTS

BLOCK = 8192  # descriptors of one image that travel together; a photo has 6000 at most
_BLOCK = 512
_LISTED = 16_384  # distances taken by subtraction at a time


def strongest(descriptors: DataFrame, response: str, most: int = DEFAULTS.affinity_descriptors) -> DataFrame:
    """The ``most`` descriptors of each image with the largest response; ties by idx."""
    turn = Window.partitionBy("image").orderBy(F.desc(response), "idx")
    return descriptors.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= most).drop("_turn")


def all_pairs(images: DataFrame) -> DataFrame:
    """(a, b) for all a < b: as many rows as the exhaustive mode compares."""
    return images.select(F.col("image").alias("a")).join(images.select(F.col("image").alias("b")), F.col("a") < F.col("b"))


def nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``a``: its nearest row of ``b`` (lowest index on ties) and two smallest squared distances.

    A matrix product finds a short list for each row: every row of ``b`` whose rough distance is within a
    rounding bound of the second smallest. The distances on it are then taken by subtraction.
    """
    best, first, second = np.empty(len(a), dtype=np.int64), np.empty(len(a)), np.empty(len(a))
    square = (b * b).sum(axis=1)
    unit = 4 * (a.shape[1] + 4) * np.finfo(np.float64).eps
    for at in range(0, len(a), _BLOCK):
        part = a[at : at + _BLOCK]
        rough = square - 2 * part @ b.T
        bound = np.partition(rough, 1, axis=1)[:, 1] + 2 * unit * ((part * part).sum(axis=1) + square.max())
        rows, short = np.nonzero(~(rough > bound[:, None]))  # in order of rows, then of columns; not finite: all
        exact = np.empty(len(rows))
        for k in range(0, len(rows), _LISTED):
            own = slice(k, k + _LISTED)
            exact[own] = ((part[rows[own]] - b[short[own]]) ** 2).sum(axis=1)
        order = np.lexsort((exact, rows))  # stable: the lowest index first
        begin = np.searchsorted(rows, np.arange(len(part)))
        best[at : at + _BLOCK] = short[order[begin]]
        first[at : at + _BLOCK] = exact[order[begin]]
        second[at : at + _BLOCK] = exact[order[begin + 1]]
    return best, first, second


def match_pair(a: np.ndarray, b: np.ndarray, ratio: float, mutual: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a, rows of b and scores 1 - d1/d2 that pass the ratio test, and the mutual test if asked."""
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    usable_a, usable_b = np.flatnonzero(np.isfinite(a).all(axis=1)), np.flatnonzero(np.isfinite(b).all(axis=1))
    if not len(usable_a) or len(usable_b) < 2:
        return none
    best, first, second = nearest(a[usable_a], b[usable_b])
    first, second = np.sqrt(np.maximum(first, 0)), np.sqrt(np.maximum(second, 0))
    good = (second > 0) & (first < ratio * second)
    if mutual:
        if len(usable_a) == 1:
            back = np.zeros(len(usable_b), dtype=np.int64)
        else:
            back, _, _ = nearest(b[usable_b], a[usable_a])
        good &= back[best] == np.arange(len(usable_a))
    rows = np.flatnonzero(good)
    return usable_a[rows], usable_b[best[rows]], 1 - first[rows] / second[rows]


def descriptor_join(descriptors: DataFrame, pairs: DataFrame | None = None, ratio: float = DEFAULTS.ratio, mutual: bool = DEFAULTS.mutual, block: int = BLOCK) -> DataFrame:
    """(a, b, ia, ib, score): matches of descriptors (image, idx, vec) between the images of ``pairs``.

    Descriptors travel in packed blocks of at most ``block`` to the pairs of blocks that meet, so work
    follows the number of pairs and memory that of two blocks. Where every image is one block, as a
    photo is, its pair is finished at once; else each row's two nearest in every block of the other
    image are brought together again.
    """
    finite = descriptors.where(F.forall("vec", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))))
    counts = descriptors.groupBy("image").agg(F.count("*").alias("n"))
    pairs = all_pairs(counts.select("image")) if pairs is None else pairs.select("a", "b").distinct()
    many = (counts.agg(F.max("n")).first()[0] or 0) > block
    if many:
        turn = F.row_number().over(Window.partitionBy("image").orderBy("idx")) - 1
        given = finite.withColumn("block", F.floor(turn / block))
    else:
        given = descriptors.withColumn("block", F.lit(0).cast("long"))
    packed = given.groupBy("image", "block").agg(F.sort_array(F.collect_list(F.struct("idx", "vec"))).alias("d")).drop("block")
    packed = packed.select("image", F.col("d.idx").alias("idx"), F.flatten("d.vec").alias("flat"))
    left, right = packed.toDF("a", "ids_a", "flat_a"), packed.toDF("b", "ids_b", "flat_b")
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "ids_a", "flat_a", "ids_b", "flat_b")
    kind = rows.schema["a"].dataType.simpleString()
    if not many:
        return rows.mapInArrow(_each_pair(lambda x, y: match_pair(x, y, ratio, mutual)), f"a {kind}, b {kind}, ia long, ib long, score double")
    found = rows.mapInArrow(_each_pair(_both_nearest), f"a {kind}, b {kind}, ia long, ib long, first double, second double, forward boolean")
    best = F.min(F.struct("first", "other")).alias("best")
    ahead = found.where("forward").select("a", "b", "ia", F.col("ib").alias("other"), "first", "second").groupBy("a", "b", "ia").agg(best, F.element_at(F.array_sort(F.flatten(F.collect_list(F.array("first", "second")))), 2).alias("second"))
    ahead = ahead.select("a", "b", "ia", F.col("best.other").alias("ib"), F.sqrt("best.first").alias("first"), F.sqrt("second").alias("second"))
    good = ahead.where((F.col("second") > 0) & (F.col("second") < float("inf")) & (F.col("first") < ratio * F.col("second")))
    if mutual:
        back = found.where("NOT forward").select("a", "b", "ib", F.col("ia").alias("other"), "first").groupBy("a", "b", "ib").agg(best)
        good = good.join(back.select("a", "b", "ib", F.col("best.other").alias("ia")), ["a", "b", "ia", "ib"], "left_semi")
    return good.select("a", "b", "ia", "ib", (1 - F.col("first") / F.col("second")).alias("score"))


def _each_pair(kernel):
    """Rows (a, b, ids and vectors of either) to the rows that ``kernel`` finds, its indices turned into ids."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids_a, flat_a, ids_b, flat_b = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in range(2, 6))
                x, y = flat_a.astype(np.float64).reshape(len(ids_a), -1), flat_b.astype(np.float64).reshape(len(ids_b), -1)
                ra, rb, *others = kernel(x, y)
                ends = [pa.array([batch.column(k)[i].as_py()] * len(ra), batch.schema.field(k).type) for k in (0, 1)]
                names = ["a", "b", "ia", "ib", *(["score"] if len(others) == 1 else ["first", "second", "forward"])]
                yield pa.RecordBatch.from_arrays([*ends, pa.array(ids_a[ra]).cast(pa.int64()), pa.array(ids_b[rb]).cast(pa.int64()), *map(pa.array, others)], names=names)

    return made


def _both_nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each row of ``a`` its nearest of ``b`` and two least squared distances, then the other way round."""

    def one_way(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(y) == 1:
            return np.zeros(len(x), np.int64), ((x - y) ** 2).sum(axis=1), np.full(len(x), np.inf)
        return nearest(x, y)

    to, first, second = one_way(a, b)
    back, first_back, second_back = one_way(b, a)
    forward = np.concatenate([np.ones(len(a), bool), np.zeros(len(b), bool)])
    return np.concatenate([np.arange(len(a)), back]), np.concatenate([to, np.arange(len(b))]), np.concatenate([first, first_back]), np.concatenate([second, second_back]), forward


def affinity(descriptors: DataFrame, ratio: float = DEFAULTS.ratio, mutual: bool = True) -> DataFrame:
    """(a, b, affinity) for all pairs of images, zero where nothing matches."""
    counts = descriptor_join(descriptors, ratio=ratio, mutual=mutual).groupBy("a", "b").agg(F.count("*").alias("affinity"))
    pairs = all_pairs(descriptors.select("image").distinct())
    return pairs.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("affinity", F.lit(0)).alias("affinity"))


def learned_join(keypoints: DataFrame, pairs: DataFrame, load: Callable[[], Callable[..., tuple[np.ndarray, np.ndarray]]], threshold: float = DEFAULTS.learned_threshold) -> DataFrame:
    """(a, b, ia, ib, confidence): a learned matcher's partners for keypoints (image, idx, x, y, vec) of ``pairs``.

    ``load`` is called once in each task and gives a function of (points a, vectors a, points b, vectors b) that tells for
    each keypoint of a its place in b, or -1, and how sure it is. An image has as many keypoints as its extractor gives.
    """
    packed = keypoints.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y", "vec"))).alias("k"))
    packed = packed.select("image", F.col("k.idx").alias("ids"), F.col("k.x").alias("x"), F.col("k.y").alias("y"), F.flatten("k.vec").alias("flat"))
    rows = pairs.select("a", "b").distinct()
    for end in "ab":
        rows = rows.join(packed.toDF(end, *(f"{n}_{end}" for n in ("ids", "x", "y", "flat"))), end)
    ordered = rows.select("a", "b", *(f"{n}_{end}" for end in "ab" for n in ("ids", "x", "y", "flat")))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = load()
        for batch in batches:
            for i in range(batch.num_rows):
                columns = [batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in range(2, 10)]
                ends = [(ids, np.column_stack([x, y]), flat.astype(np.float64).reshape(len(ids), -1)) for ids, x, y, flat in (columns[:4], columns[4:])]
                partner, sure = matcher(ends[0][1], ends[0][2], ends[1][1], ends[1][2])
                found = np.flatnonzero((np.asarray(partner) >= 0) & (np.asarray(partner) < len(ends[1][0])) & (np.asarray(sure) > threshold))
                names = [pa.array([batch.column(k)[i].as_py()] * len(found), batch.schema.field(k).type) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*names, pa.array(ends[0][0][found]).cast(pa.int64()), pa.array(ends[1][0][np.asarray(partner)[found]]).cast(pa.int64()), pa.array(np.asarray(sure, dtype=float)[found])], names=["a", "b", "ia", "ib", "confidence"]
                )

    kind = ordered.schema["a"].dataType.simpleString()
    return ordered.mapInArrow(matched, f"a {kind}, b {kind}, ia long, ib long, confidence double")


def confident(partners: DataFrame, threshold: float = DEFAULTS.learned_threshold) -> DataFrame:
    """Of a learned matcher's answers (a, b, ia, ib, confidence, count_b) those to keep."""
    return partners.where((F.col("confidence") > threshold) & F.col("ib").between(0, F.col("count_b") - 1))
