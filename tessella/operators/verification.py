"""Robust models and verdicts for pairs of photos."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.config import DEFAULTS, MODELS, MODES, Analysis
from tessella.functions import models, polygons
from tessella.functions.columns import finite, focal_prior, jacobian, singular_values
from tessella.operators.long_pairs import LongPairs
from tessella.operators.spread import Spread

VERDICT_FIELDS = (
    "a long, b long, source string, model string, transform array<double>, inliers array<int>, rmse double, median_error double, "
    "matches int, matches_in_overlap int, overlap_area double, inlier_coverage double, confidence double, log10_nfa double, verdict string"
)


FITS = "a long, b long, source string, transform array<double>, inliers array<int>, rmse double, median_error double"
#: A pair's matches up to so many are fitted in one task; translations and evidence of more where they are, with the same draws.
MOST_IN_A_TASK = 200_000


def model_fits(matches: DataFrame, model: str, config: Analysis = DEFAULTS) -> DataFrame:
    """One row per (a, b, source) of matches (idx, ax, ay, bx, by, threshold): the robust fit, or none."""

    def fitted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["idx"])
        got = models.fit(model, rows[["ax", "ay"]].to_numpy(float), rows[["bx", "by"]].to_numpy(float), float(rows["threshold"].iloc[0]), config.max_iterations, config.confidence, config.seed)
        if got is None:
            return pd.DataFrame({"a": [], "b": [], "source": [], "transform": [], "inliers": [], "rmse": [], "median_error": []})
        return pd.DataFrame([[*key, got.transform.ravel(), rows["idx"].to_numpy()[got.inliers], got.rmse, got.median]], columns=["a", "b", "source", "transform", "inliers", "rmse", "median_error"])

    matches = matches.select("a", "b", "source", "idx", "ax", "ay", "bx", "by", "threshold")
    one_task = lambda rows: rows.groupBy("a", "b", "source").applyInPandas(fitted, FITS)
    if model != "translation":
        return one_task(matches)
    sizes = matches.groupBy("a", "b", "source").agg(F.count("*").alias("n"), F.min_by("threshold", "idx").alias("limit")).where(F.col("n") > MOST_IN_A_TASK)
    large = sizes.drop("n").collect()  # one row for each pair of very many matches
    if not large:
        return one_task(matches)
    same = F.broadcast(matches.sparkSession.createDataFrame(large, sizes.drop("n").schema).drop("limit"))
    on = [F.col(f"m.{k}").eqNullSafe(F.col(f"l.{k}")) for k in ("a", "b", "source")]
    long = _long_translations(matches.alias("m").join(same.alias("l"), on, "left_semi"), {tuple(r)[:3]: r["limit"] for r in large}, config)
    return one_task(matches.alias("m").join(same.alias("l"), on, "left_anti")).unionByName(long)


_BUCKETS = 1 << 14


def _long_translations(matches: DataFrame, limits: dict[tuple, float], config: Analysis) -> DataFrame:
    """``models.fit`` of translations by passes over the matches: the same draws, each scored by sums."""
    values = ["idx", "ax", "ay", "bx", "by"]
    usable = matches.where(finite(F.col("ax")) & finite(F.col("ay")) & finite(F.col("bx")) & finite(F.col("by")))
    rows = Spread(usable, ["a", "b", "source"], values)
    limit, numbers = [limits[k] for k in rows.keys], range(len(rows.keys))
    ends = [r[1:] for r in sorted(rows.rows.groupBy("_key").agg(F.min("idx"), -F.max("idx")).collect())]
    bucket = lambda k, v: ((v - ends[k][0]) / (-ends[k][1] - ends[k][0] + 1) * _BUCKETS).astype(int)  # noqa: E731  rising with idx
    above = [np.cumsum(h) for h in rows.each(lambda k, m: np.bincount(bucket(k, m[:, 0]), minlength=_BUCKETS), np.add)]
    stack = lambda u, v: np.concatenate([u, v])

    def shifts_at(ranks: list[np.ndarray]) -> list[np.ndarray]:
        """The shifts of the matches at some places in the order of idx."""
        wanted = [np.searchsorted(above[k], ranks[k], side="right") for k in numbers]
        near = rows.each(lambda k, m: m[np.isin(bucket(k, m[:, 0]), wanted[k])], stack)
        out = []
        for k in numbers:
            own = near[k][np.argsort(near[k][:, 0], kind="stable")]
            held = np.unique(wanted[k])
            counts = np.diff(np.concatenate(([0], above[k])))[held]
            starts = dict(zip(held.tolist(), (np.cumsum(counts) - counts).tolist(), strict=True))
            at = [starts[w] + r - (above[k][w - 1] if w else 0) for w, r in zip(wanted[k].tolist(), ranks[k].tolist(), strict=True)]
            out.append(own[np.array(at, int), 3:5] - own[np.array(at, int), 1:3])
        return out

    def residuals(m: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return models.residuals(_shift(shift), m[:, 1:3], m[:, 3:5])

    def scored(shifts: list[np.ndarray]) -> list[np.ndarray]:
        """(cost, inliers, sum of the inliers' own shifts) of each key's shifts."""

        def own(k: int, m: np.ndarray) -> np.ndarray:
            each, d = [np.minimum(residuals(m, t), limit[k]) for t in shifts[k]], m[:, 3:5] - m[:, 1:3]
            return np.array([[(r**2).sum(), (r < limit[k]).sum(), *(r < limit[k]).astype(float) @ d] for r in each]).reshape(-1, 4)

        return rows.each(own, np.add)

    draws = [np.random.default_rng(config.seed) for _ in numbers]
    best, cost, sums = [None] * len(numbers), [np.inf] * len(numbers), [None] * len(numbers)
    needed, done, batch = [config.max_iterations] * len(numbers), [0] * len(numbers), 16
    open_ = lambda k: done[k] < min(needed[k], config.max_iterations)
    while any(map(open_, numbers)):
        ranks = [np.concatenate([draws[k].choice(above[k][-1], 1, replace=False) for _ in range(batch)]) if open_(k) else np.empty(0, int) for k in numbers]
        shifts = shifts_at(ranks)
        for k, got in enumerate(scored(shifts)):
            for shift, (new, *own) in zip(shifts[k], got, strict=True):
                if not open_(k):
                    break
                done[k] += 1
                if new < cost[k]:
                    best[k], cost[k], sums[k] = shift, new, own
                    needed[k] = models.draws_needed(own[0] / above[k][-1], 1, config.confidence, needed[k])
        batch = min(4 * batch, 128)

    going = set(numbers)
    for _ in range(10):
        going = {k for k in going if sums[k][0] >= 1}
        if not going:
            break
        shifts = [np.array([sums[k][1:]]) / sums[k][0] if k in going else np.empty((0, 2)) for k in numbers]
        got = scored(shifts)
        going = {k for k in going if got[k][0, 0] < cost[k] - 1e-12}
        for k in going:
            best[k], cost[k], sums[k] = shifts[k][0], got[k][0, 0], got[k][0, 1:].tolist()

    def errors(k: int, m: np.ndarray) -> np.ndarray:
        own = residuals(m, best[k])
        return own[own < limit[k]]

    place = lambda k, own: np.minimum((own / limit[k] * _BUCKETS).astype(int), _BUCKETS - 1)
    facts = rows.each(lambda k, m: (lambda own: np.concatenate([[len(own), (own**2).sum()], np.bincount(place(k, own), minlength=_BUCKETS)]))(errors(k, m)), np.add)
    filled = [np.cumsum(f[2:]) for f in facts]
    middle = [int(np.searchsorted(filled[k], facts[k][0] // 2, side="right")) for k in numbers]
    around = rows.each(lambda k, m: (lambda own: own[place(k, own) == middle[k]])(errors(k, m)), stack)
    medians = [float(np.sort(around[k])[int(facts[k][0] // 2 - (filled[k][middle[k] - 1] if middle[k] else 0))]) if facts[k][0] else None for k in numbers]

    def inside(batches):
        for batch in batches:
            m = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            keys = m[:, 0].astype(int)
            near = np.zeros(len(m), bool)
            for k in np.unique(keys):
                near[keys == k] = residuals(m[keys == k][:, 1:], best[k]) < limit[k]
            yield pa.RecordBatch.from_pydict({"_key": pa.array(keys[near], pa.int32()), "idx": pa.array(m[near, 1].astype(np.int32), pa.int32())})

    inliers = rows.rows.mapInArrow(inside, "_key int, idx int").groupBy("_key").agg(F.sort_array(F.collect_list("idx")).alias("inliers"))
    found = [(k, *rows.keys[k], [float(v) for v in _shift(best[k]).ravel()], float(np.sqrt(facts[k][1] / facts[k][0])), medians[k]) for k in numbers if facts[k][0]]
    fits = matches.sparkSession.createDataFrame(found, "_key int, a long, b long, source string, transform array<double>, rmse double, median_error double")
    return fits.join(inliers, "_key").select("a", "b", "source", "transform", "inliers", "rmse", "median_error")


def _shift(by: np.ndarray) -> np.ndarray:
    return np.array([[1, 0, by[0]], [0, 1, by[1]], [0, 0, 1.0]])


def verify(matches: DataFrame, mode: str = "automatic", config: Analysis = DEFAULTS) -> DataFrame:
    """Evidence and verdict for each (a, b, source) of matches (idx, ax, ay, bx, by, wa, ha, wb, hb)."""
    kinds = MODES[mode]
    names, order = ["a", "b", "source"], ["idx", "ax", "ay", "bx", "by"]  # matches of one idx are told apart by their points

    def verified(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order).reset_index(drop=True)
        return pd.DataFrame([[*key, *_evidence(rows, kinds, mode, config)]], columns=[f.split()[0] for f in VERDICT_FIELDS.split(", ")])

    matches = matches.select(*names, *order, "wa", "ha", "wb", "hb")
    one_task = lambda rows: rows.groupBy(*names).applyInPandas(verified, VERDICT_FIELDS)
    alike = matches.groupBy(*names, "wa", "ha", "wb", "hb").agg(F.count("*").alias("n"), F.min("idx").alias("idx"))
    sizes = alike.groupBy(*names).agg(F.sum("n").alias("n"), F.min(F.struct("idx", "wa", "ha", "wb", "hb")).alias("size")).where(F.col("n") > MOST_IN_A_TASK)
    large = sizes.orderBy(*names).collect()  # one row for each pair of very many matches
    if not large:
        return one_task(matches)
    same = F.broadcast(matches.sparkSession.createDataFrame([tuple(r)[:3] for r in large], sizes.select(*names).schema))
    on = [F.col(f"m.{k}").eqNullSafe(F.col(f"l.{k}")) for k in names]
    long = _long_evidence(matches.alias("m").join(same.alias("l"), on, "left_semi"), large, kinds, mode, config)
    return one_task(matches.alias("m").join(same.alias("l"), on, "left_anti")).unionByName(long)


def _long_evidence(matches: DataFrame, large: list, kinds: tuple[str, ...], mode: str, config: Analysis) -> DataFrame:
    """``_evidence`` of pairs (a, b, source, n, size) by passes over their matches."""
    sizes = [tuple(map(float, r["size"][1:])) for r in large]
    limits = [_threshold(wb, hb, config) for _, _, wb, hb in sizes]
    pairs = LongPairs(matches, [tuple(r)[:3] for r in large])
    fits = pairs.fits(tuple(dict.fromkeys((*kinds, *(["homography"] if mode == "plane" else [])))), limits, config)
    chosen = {k: best for k, f in enumerate(fits) if (best := models.simplest([f[x] for x in kinds if x in f], limits[k], config.simpler_share))}
    maps = {k: f.transform for k, f in chosen.items()}
    regions = {k: _region(t, sizes[k]) for k, t in maps.items()}
    measures = pairs.measures(maps, regions, limits) if maps else {}
    rows = []
    for k, r in enumerate(large):
        if k not in chosen:
            rows.append((k, *tuple(r)[:3], *_nothing(r["n"], "noConsistentModel")))
            continue
        median, inside, hull, covered = measures[k]
        judged = _judged(chosen[k], fits[k].get("homography") if mode == "plane" else None, regions[k], sizes[k], limits[k], r["n"], inside, hull, covered, mode, config)
        rows.append((k, *tuple(r)[:3], chosen[k].model, chosen[k].transform.ravel().tolist(), None, chosen[k].rmse, median, *judged))
    plain = [f.split()[0] for f in VERDICT_FIELDS.split(", ")]
    found = matches.sparkSession.createDataFrame(rows, f"_key int, {VERDICT_FIELDS}").drop("inliers")
    return found.join(pairs.inliers(maps, limits), "_key", "left").select(*plain)


def _threshold(wb: float, hb: float, config: Analysis) -> float:
    return float(config.inlier_threshold * np.sqrt(wb * hb / 1e6))


def _nothing(number: int, why: str) -> list:
    return [None, None, None, None, None, number, 0, 0.0, 0.0, 0.0, float("inf"), why]


def _evidence(rows: pd.DataFrame, kinds: tuple[str, ...], mode: str, config: Analysis) -> list:
    a, b = rows[["ax", "ay"]].to_numpy(float), rows[["bx", "by"]].to_numpy(float)
    wa, ha, wb, hb = min(map(tuple, rows.loc[rows["idx"] == rows["idx"].iloc[0], ["wa", "ha", "wb", "hb"]].to_numpy(float).tolist()))
    threshold = _threshold(wb, hb, config)
    if len(rows) < config.minimum_inliers:
        return _nothing(len(rows), "tooFewMatches")
    fits = [f for k in kinds if (f := models.fit(k, a, b, threshold, config.max_iterations, config.confidence, config.seed))]
    chosen = models.simplest(fits, threshold, config.simpler_share)
    if chosen is None:
        return _nothing(len(rows), "noConsistentModel")
    perspective = models.fit("homography", a, b, threshold, config.max_iterations, config.confidence, config.seed) if mode == "plane" else None
    region = _region(chosen.transform, (wa, ha, wb, hb))
    inside = int(polygons.within(region, a).sum()) if len(region) else 0
    covered = polygons.coverage(a[chosen.inliers], region) if len(region) else 0.0
    judged = _judged(chosen, perspective, region, (wa, ha, wb, hb), threshold, len(rows), inside, polygons.peeled_hull_area(a[chosen.inliers]), covered, mode, config)
    return [chosen.model, chosen.transform.ravel(), rows["idx"].to_numpy(np.int32)[chosen.inliers], chosen.rmse, chosen.median, *judged]


def _region(transform: np.ndarray, size: tuple[float, ...]) -> np.ndarray:
    """The overlap of both photos in the first one; no corners where it has no area."""
    region = polygons.overlap(transform, size[:2], size[2:])
    return region if polygons.area(region) else np.empty((0, 2))


def _judged(chosen: models.Fit, perspective: models.Fit | None, region: np.ndarray, size: tuple[float, ...], threshold: float, number: int, inside: int, hull: float, covered: float, mode: str, config: Analysis) -> list:
    """From ``matches`` to ``verdict``: what follows from a pair's fit and measures."""
    wa, ha, wb, hb = size
    inliers = len(chosen.inliers)
    overlap = abs(polygons.area(region))
    inside = max(inside, inliers)
    back = models.apply(chosen.transform, region) if len(region) else region
    area_b = abs(polygons.area(back)) if len(region) >= 3 and np.isfinite(back).all() else wb * hb
    alarms = models.log10_false_alarms(inside, inliers, models.SAMPLE[chosen.model], threshold, area_b or wb * hb)
    confidence = inliers / (8 + 0.3 * inside)
    facts = dict(
        matches=number, inliers=inliers, perspective=len(perspective.inliers) if perspective else 0, overlap=overlap,
        plausible=models.plausible(chosen.transform, (wa, ha), (wb, hb), mode in ("plane", "automatic") and chosen.model != "homography"),
        hull=hull / (wa * ha), coverage=covered, alarms=alarms,
    )
    return [number, inside, overlap, covered, confidence, alarms, _cascade(facts, config)]


def _cascade(f: dict, config: Analysis) -> str:
    if f["perspective"] >= config.minimum_inliers and f["perspective"] >= 1.5 * f["inliers"]:
        return "modelMismatch"
    if not f["overlap"] or f["inliers"] < config.minimum_inliers:
        return "noConsistentModel"
    if not f["plausible"]:
        return "implausibleModel"
    if f["hull"] < config.minimum_hull_fraction or f["coverage"] < config.minimum_coverage:
        return "degenerateInliers"
    return "lowConfidence" if f["alarms"] >= 0 else "verified"


def verdict(matches: Column, fitted: Column, perspective: Column, inliers: Column, overlap: Column, plausible: Column, hull: Column, covered: Column, log10_nfa: Column, config: Analysis = DEFAULTS) -> Column:
    """The verdict of a pair from its measures; the order of the tests is part of the result."""
    least = config.minimum_inliers
    return (
        F.when(matches < least, "tooFewMatches")
        .when(~fitted, "noConsistentModel")
        .when((perspective >= least) & (perspective >= 1.5 * inliers), "modelMismatch")
        .when((overlap <= 0) | (inliers < least), "noConsistentModel")
        .when(~plausible, "implausibleModel")
        .when((hull < config.minimum_hull_fraction) | (covered < config.minimum_coverage), "degenerateInliers")
        .when(log10_nfa >= 0, "lowConfidence")
        .otherwise("verified")
    )


def log_factorials(numbers: DataFrame, most: int) -> DataFrame:
    """(n, value): log10 of n! for n up to ``most``, by a running sum; a lookup of that fixed length."""
    spark = numbers.sparkSession
    steps = spark.range(0, most + 1).select(F.col("id").alias("n"), F.log10(F.greatest(F.col("id"), F.lit(1)).cast("double")).alias("step"))
    return steps.select("n", F.sum("step").over(Window.orderBy("n")).alias("value"))


def log10_nfa(n: Column, k: Column, s: Column, threshold: Column, area: Column, table: Column) -> Column:
    """The a-contrario score from an array of log-factorials (position i holds i!)."""
    at = lambda x: F.element_at(table, (x + 1).cast("int"))
    choose = lambda m, r: at(m) - at(r) - at(m - r)
    alpha = F.least(F.lit(1.0), F.pi() * threshold * threshold / area)
    value = F.log10((n - s).cast("double")) + choose(n, k) + choose(k, s) + (k - s) * F.log10(alpha)
    return F.when((n <= s) | (k <= s) | (area <= 0), F.lit(float("inf"))).otherwise(value)


def simplest_model(fits: DataFrame, share: float = DEFAULTS.simpler_share) -> DataFrame:
    """Of fits (pair, model, inliers, rmse, threshold) the model of fewest degrees of freedom that suffices."""
    dof = F.create_map(*(F.lit(x) for m in MODELS.items() for x in m))
    rows = fits.withColumn("dof", F.element_at(dof, F.col("model")))
    best = F.max_by(F.struct("inliers", "rmse"), F.struct("inliers", -F.col("dof"))).over(Window.partitionBy("pair"))
    rows = rows.withColumn("best", best)
    good = (F.col("inliers") >= share * F.col("best.inliers")) & (F.col("rmse") <= 1.5 * F.col("best.rmse") + 0.1 * F.col("threshold"))
    return rows.where(good).groupBy("pair").agg(F.min_by("model", "dof").alias("model"))


def earns_perspective(stretch: Column, document_rms: Column, planar_rms: Column) -> Column:
    return (stretch <= 4) & ~F.isnan(stretch) & (document_rms < 0.5 * planar_rms)


def candidate_models(photos: DataFrame) -> DataFrame:
    """``photos`` (…, mode) with a row for each model that the mode allows."""
    table = F.create_map(*(x for mode, kinds in MODES.items() for x in (F.lit(mode), F.array(*(F.lit(k) for k in kinds)))))
    return photos.withColumn("model", F.explode(F.element_at(table, F.col("mode"))))


def best_evidence(evidence: DataFrame) -> DataFrame:
    """One row per (a, b): verified first, then most inliers, then the first seen (seq)."""
    by = Window.partitionBy("a", "b").orderBy(F.desc("verified"), F.desc("inliers"), "seq")
    return evidence.withColumn("_turn", F.row_number().over(by)).where("_turn = 1").drop("_turn")


def stratified(matches: DataFrame, cap: int = DEFAULTS.match_cap, grid: int = DEFAULTS.grid) -> DataFrame:
    """At most ``cap`` matches (idx, x, y, sigma, width, height) of each pair, dealt out evenly over a grid.

    Cells give their best match in turn, one per round, in cell order. Pairs within the cap keep all.
    """
    at = lambda v, size: F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor(F.col(v) / F.col(size) * grid)))
    rows = matches.withColumn("cell", at("y", "height") * grid + at("x", "width"))
    rows = rows.withColumn("round", F.row_number().over(Window.partitionBy("pair", "cell").orderBy("sigma", "idx")))
    turn = F.row_number().over(Window.partitionBy("pair").orderBy("round", "cell"))
    number = F.count("*").over(Window.partitionBy("pair"))
    return rows.withColumns({"turn": turn, "number": number}).where((F.col("number") <= cap) | (F.col("turn") <= cap)).drop("turn", "number", "round")


def upper_median(values: str) -> Column:
    """The element at position n/2 of the sorted values: no interpolation. Counts by value are combined, not lists.

    The half-way value from above: for an even number the upper of the two in the middle.
    """
    return F.expr(f"percentile_disc(0.5D) WITHIN GROUP (ORDER BY `{values}` DESC)")


def plausible(t: Column, width: Column, height: Column, long_a: Column, long_b: Column) -> Column:
    """Whether a planar map keeps orientation, hardly shears at the photo's middle, and scales by less than three."""
    a, b, c, d = jacobian(t, width / 2.0, height / 2.0)
    large, small = singular_values(a, b, c, d)
    relative = F.sqrt(F.abs(a * d - b * c)) * long_a / long_b
    return F.coalesce((a * d - b * c > 0) & (large < 2 * small) & (relative > 1 / 3) & (relative < 3), F.lit(False))


def trimmed(matches: DataFrame, group: str, least: int = 8, most_gone: float = 0.3) -> DataFrame:
    """(group, pair, left) of matches (group, pair, error) within three upper medians, two pixels at least.

    A pair stays if it keeps ``least`` matches, or all of its own; a group of which nothing or more than
    ``most_gone`` would go is left as it is and gives no rows. Whether the rest still hangs together is the caller's to ask.
    """
    limits = matches.groupBy(group).agg(F.greatest(3 * upper_median("error"), F.lit(2.0)).alias("limit"), F.count("*").alias("number"))
    pairs = matches.join(limits, group).groupBy(group, "pair", "number").agg(F.count("*").alias("own"), F.count_if(F.col("error") <= F.col("limit")).alias("left"))
    kept = pairs.where(F.col("left") >= F.least(F.lit(least), F.col("own")))
    gone = kept.groupBy(group, "number").agg((F.col("number") - F.sum("left")).alias("gone")).where((F.col("gone") > 0) & (F.col("gone") <= most_gone * F.col("number")))
    return kept.join(gone.select(group), group).select(group, "pair", "left")


def focals_usable(focals: DataFrame, group: str, least: float = 0.67, most: float = 1.5, apart: float = 1.05) -> DataFrame:
    """(group, usable) of (group, focal, prior, trusted, exif): all finite and above zero, the upper median near a trusted
    prior, and alike where they come from EXIF."""
    got = focals.groupBy(group).agg(
        F.bool_and(finite(F.col("focal")) & (F.col("focal") > 0)).alias("sound"), upper_median("focal").alias("middle"), F.max("prior").alias("prior"),
        F.bool_and("trusted").alias("trusted"), F.bool_and("exif").alias("exif"), (F.max("focal") <= apart * F.min("focal")).alias("alike"),
    )
    near = ~F.col("trusted") | F.col("middle").between(least * F.col("prior"), most * F.col("prior"))
    return got.select(group, (F.col("sound") & near & (~F.col("exif") | F.col("alike"))).alias("usable"))


def focal_priors(photos: DataFrame, group: str) -> DataFrame:
    """(group, id, focal): by EXIF where all photos of the group have it, else the upper median of the focal lengths that
    homographies give and that see more than 5 and less than 150 degrees, else a view of 72 degrees.

    ``photos``: group, id, f35, width, height, from_homography (null where there is none).
    """
    longest = F.greatest("width", "height")
    view = 2 * F.degrees(F.atan(longest / (2 * F.col("from_homography"))))
    rows = photos.withColumn("seen", F.when((view > 5) & (view < 150), F.col("from_homography")))
    known = rows.groupBy(group).agg(F.bool_and(F.col("f35").isNotNull()).alias("every"), upper_median("seen").alias("middle"))
    fallback = longest / (2 * F.tan(F.radians(F.lit(36.0))))
    focal = F.when(F.col("every"), focal_prior(F.col("f35"), F.col("width"), F.col("height"))).otherwise(F.coalesce("middle", fallback))
    return rows.join(known, group).select(group, "id", focal.alias("focal"))
