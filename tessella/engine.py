"""The three entry points: analyse a folder of photos, align them, stitch them."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.config import DEFAULTS, Analysis, Stitching
from tessella.functions import columns, features, models
from tessella.operators import alignment, candidates, graph, matching, problem, raster, stitching, verification
from tessella.operators.ordering import numbered
from tessella.runtime import stored
from tessella.sources import images as pixels_of
from tessella.sources import photos

Progress = Callable[[str, int, int], None]
VERSION = 1
_OVERLAP_PHOTOS, _OVERLAP_ROUNDS = 8, 2  # rounds of pairs that the layout predicts, above so many photos
_KEYPOINTS = "image long, idx long, x double, y double, size double, angle double, response double, vec array<double>, error string"


@dataclass
class Report:
    """Everything an analysis found, as tables."""

    photos: DataFrame
    keypoints: DataFrame
    candidates: DataFrame
    evidence: DataFrame
    matches: DataFrame
    groups: DataFrame
    config: Analysis

    TABLES = ("photos", "keypoints", "candidates", "evidence", "matches", "groups")

    def save(self, path: str) -> None:
        """The tables in a folder; the settings, written last, make it a whole report."""
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.photos.sparkSession
        spark.createDataFrame([(VERSION, json.dumps(asdict(self.config)))], "version int, config string").write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Report:
        settings = spark.read.parquet(f"{path}/settings").first()
        if settings["version"] > VERSION:
            raise ValueError("the report is of a later version")
        known = {k: v for k, v in json.loads(settings["config"]).items() if k in Analysis.__dataclass_fields__}
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in cls.TABLES), Analysis(**known))

    def identity(self) -> str:
        """A digest of the settings and the verified evidence, the same for equal reports."""
        rows = self.evidence.where("verdict = 'verified'").select("a", "b", "source", F.size("inliers").alias("n")).orderBy("a", "b", "source")
        lines = F.array_join(F.sort_array(F.collect_list(F.concat_ws("|", *(F.col(c).cast("string") for c in ("a", "b", "source", "n"))))), "\n")
        return hashlib.sha256((json.dumps(asdict(self.config), sort_keys=True) + (rows.agg(lines).first()[0] or "")).encode()).hexdigest()[:16]


def extracted(files: DataFrame, megapixels: float = 1.5, most: int = 6000) -> DataFrame:
    """Keypoints and descriptors of photos (id, orientation and what ``pixel_rows`` gives): spread over the cluster, one at a time in a task.

    A photo whose pixels can't be decoded is one row with its ``error`` and nothing else.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                image = r.id
                try:
                    gray = pixels_of.gray(pixels_of.decoded(r.content, r.raw, r.rows, r.columns, r.bands, r.orientation))
                except (ValueError, zlib.error, struct.error) as problem_:
                    yield pd.DataFrame([[image, *[None] * 7, str(problem_) or "the pixels can't be decoded"]], columns=[f.split()[0] for f in _KEYPOINTS.split(", ")])
                    continue
                h, w = gray.shape
                small_w, small_h = pixels_of.working_size(w, h, megapixels)
                points, vectors = features.keypoints(pixels_of.reduced(gray, small_w, small_h), most)
                points[:, 0] = (points[:, 0] + 0.5) * (w / small_w) - 0.5
                points[:, 1] = (points[:, 1] + 0.5) * (h / small_h) - 0.5
                yield pd.DataFrame({"image": image, "idx": np.arange(len(points)), **{n: points[:, k] for k, n in enumerate(("x", "y", "size", "angle", "response"))}, "vec": list(vectors), "error": None})

    return files.select("id", "orientation", "content", "raw", "rows", "columns", "bands").mapInPandas(run, _KEYPOINTS)


def analyze(spark: SparkSession, path: str, config: Analysis = DEFAULTS, mode: str = "automatic", progress: Progress = lambda *_: None) -> Report:
    """Photos of a folder to a report: keypoints, candidate pairs, verified evidence, groups."""
    described = numbered(photos.describe(spark, path), [candidates.natural_key(F.col("name")), F.col("path")], "id")
    described = stored(described)
    progress("scan", 1, 4)
    good = described.where("NOT unreadable")
    found = stored(extracted(pixels_of.pixel_rows(spark, path, good.select("id", "path", "orientation")).repartition("id")))
    points, failed = found.where("error IS NULL").drop("error"), found.where("error IS NOT NULL").select(F.col("image").alias("id")).withColumn("failed", F.lit(True))
    described = stored(described.join(failed, "id", "left").withColumn("unreadable", F.col("unreadable") | F.coalesce("failed", F.lit(False))).drop("failed"))
    good = described.where("NOT unreadable")
    progress("extract", 2, 4)
    descriptors = points.select("image", "idx", "vec", "response")
    affinities = stored(matching.affinity(matching.strongest(descriptors, "response", config.affinity_descriptors), config.ratio))
    chosen = stored(candidates.candidates(good.select("id", "name", "capture_date"), affinities, config.proposal_neighbours))
    tried, evidence, matches, groups = chosen.select("a", "b"), None, None, None

    def examine(pairs: DataFrame) -> None:
        nonlocal evidence, matches, groups
        new_matches = stored(_matched(descriptors, points, good, pairs, config))
        new_evidence = stored(verification.verify(new_matches, mode, config))
        matches = new_matches if matches is None else matches.unionByName(new_matches)
        evidence = new_evidence if evidence is None else evidence.unionByName(new_evidence)
        verified = evidence.where("verdict = 'verified'").select("a", "b")
        groups = stored(graph.components(good.select("id"), verified))

    examine(tried)
    for turn in range(config.bridge_rounds):
        if groups.agg(F.count_distinct("component")).first()[0] <= 1:
            break
        bridges = stored(candidates.bridges(affinities, groups, tried, config.bridge_pairs, good.count()))
        if bridges.isEmpty():
            break
        fresh = bridges.select("a", "b")
        tried = stored(tried.unionByName(fresh))
        chosen = chosen.unionByName(bridges.withColumn("reasons", F.array(F.lit("bridge"))))
        progress("bridges", turn + 1, config.bridge_rounds)
        examine(fresh)
    if good.count() > _OVERLAP_PHOTOS:
        for turn in range(_OVERLAP_ROUNDS):
            fresh = _overlapping(Report(described, points, chosen, evidence, matches, groups, config), tried)
            if fresh is None:
                break
            tried = stored(tried.unionByName(fresh))
            chosen = chosen.unionByName(fresh.select("a", "b", F.lit(None).cast("long").alias("affinity"), F.array(F.lit("overlap")).alias("reasons")))
            progress("overlap", turn + 1, _OVERLAP_ROUNDS)
            examine(fresh)
    progress("verify", 4, 4)
    return Report(described, points, chosen, evidence, matches, groups, config)


def _matched(descriptors: DataFrame, points: DataFrame, good: DataFrame, pairs: DataFrame, config: Analysis) -> DataFrame:
    found = matching.descriptor_join(descriptors, pairs, config.ratio, config.mutual)
    at = points.select("image", "idx", "x", "y")
    size = good.select("id", F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"))
    rows = found.join(at.toDF("a", "ia", "ax", "ay"), ["a", "ia"]).join(at.toDF("b", "ib", "bx", "by"), ["b", "ib"]).join(size.toDF("a", "wa", "ha"), "a").join(size.toDF("b", "wb", "hb"), "b")
    return rows.select("a", "b", F.lit("rootSIFT").alias("source"), F.col("ia").cast("int").alias("idx"), "ax", "ay", "bx", "by", "wa", "ha", "wb", "hb")


def _overlapping(report: Report, tried: DataFrame) -> DataFrame | None:
    """(a, b) of untried pairs that a provisional layout of the largest group lays over each other; None if there are none."""
    try:
        layout, pairs, sizes = _aligned(report)
    except (ValueError, np.linalg.LinAlgError):
        return None
    if len(layout.transforms) < 2:
        return None
    # The layout only has to be right locally: homographies that fit the pairs better predict the overlaps.
    if layout.model != "homography":
        gone = {k for k, *_ in layout.left_out}
        kept = [p for p in pairs if p.a in layout.transforms and p.b in layout.transforms and (p.a, p.b) not in gone]
        try:
            document = alignment.solve_homography(sorted(layout.transforms), kept, layout.anchor)
            middle = lambda x: models.upper_median(np.array(list(x.pair_rms.values())))
            layout = document if middle(document) < middle(layout) else layout
        except (ValueError, np.linalg.LinAlgError):
            pass
    known = {(r["a"], r["b"]) for r in tried.collect()}  # a few per photo of the project
    rows = [(int(a), int(b), float(v)) for a, b, v in problem.predicted(layout.transforms, sizes) if (a, b) not in known]
    if not rows:
        return None
    overlaps = report.photos.sparkSession.createDataFrame(rows, "a long, b long, overlap double")
    return stored(candidates.quota(overlaps, report.config.overlap_per_photo, len(layout.transforms)).select("a", "b"))


def align(report: Report, mode: str = "automatic", straighten: bool = True, provisional: bool = False) -> alignment.Layout:
    """A map for each photo of the largest group, or turned cameras.

    ``straighten`` levels turned cameras of wide sweeps; a ``provisional`` layout keeps pairs that are far off, for a first look.
    """
    layout = _aligned(report, mode, provisional)[0]
    if straighten and layout.cameras is not None:
        layout.cameras.rotations = problem.straightened(layout.cameras.rotations)
    return layout


def _aligned(report: Report, mode: str = "automatic", provisional: bool = False) -> tuple[alignment.Layout, list[alignment.Pair], dict[int, tuple[float, float]]]:
    """The layout of the largest group, its pairs and the sizes of its photos."""
    spark = report.photos.sparkSession
    labels = report.groups
    main = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").first()
    members = sorted(r["id"] for r in labels.where(F.col("component") == main["component"]).collect())
    if len(members) == 1:
        return alignment.Layout("translation", members[0], {members[0]: np.eye(3)}, 0.0, {}), [], {}
    group = spark.createDataFrame([(m,) for m in members], "id long")
    verified = report.evidence.where("verdict = 'verified'").join(group, F.col("a") == F.col("id"), "left_semi")
    inliers = verified.select("a", "b", "source", "rmse", F.explode("inliers").alias("idx")).join(report.matches, ["a", "b", "source", "idx"])
    pairs = alignment.problem(problem.build(inliers, report.config))
    known = report.photos.join(group, "id").select("id", "width", "height", "focal_35mm").collect()
    sizes = {r["id"]: (float(r["width"]), float(r["height"])) for r in known}
    exif = [r["focal_35mm"] * float(np.hypot(r["width"], r["height"])) / 43.2666 for r in known if r["focal_35mm"]]
    focal = models.upper_median(np.array(exif)) if len(exif) == len(known) else alignment.focal_from_pairs(pairs, sizes)
    thresholds = {(p.a, p.b): report.config.inlier_threshold * (sizes[p.b][0] * sizes[p.b][1] / 1e6) ** 0.5 for p in pairs}
    links = spark.createDataFrame([(p.a, p.b, len(p.pa)) for p in pairs], "a long, b long, weight long")
    anchor = graph.centre(links, group).first()["id"]
    if provisional:
        return alignment.choose(members, pairs, anchor, sizes, mode, alignment.Solves(sizes, focal)), pairs, sizes
    return alignment.align(members, pairs, anchor, thresholds, sizes, mode, focal), pairs, sizes


def projected(spark: SparkSession, layout: alignment.Layout, request: Stitching = Stitching()) -> tuple[str, np.ndarray]:
    """How a layout is drawn, and the turn that brings its middle to the front.

    Turned cameras are drawn by the arc that their middles leave empty; more than 330 degrees are refused.
    """
    if layout.cameras is None:
        return "planar", np.eye(3)
    forward = {p: r[:, 2] for p, r in layout.cameras.rotations.items()}
    yaws = spark.createDataFrame([(0, float(np.degrees(np.arctan2(d[0], d[2])) % 360)) for d in forward.values()], "project int, yaw double")
    drawn = raster.circular_gap(yaws).select("extent", "middle", columns.projection_of(F.col("extent")).alias("projection")).first()
    if drawn["projection"] == "refused":
        raise ValueError("the sweep is wider than 330 degrees")
    middle = np.radians(drawn["middle"])
    turn = np.array([[np.cos(middle), 0, -np.sin(middle)], [0, 1, 0], [np.sin(middle), 0, np.cos(middle)]])
    return (drawn["projection"] if request.projection == "automatic" else request.projection), turn


def stitch(report: Report, layout: alignment.Layout, request: Stitching = Stitching()) -> DataFrame:
    """16-bit RGBA tiles of the panorama, in the layout's plane or drawn from turned cameras."""
    spark = report.photos.sparkSession
    projection, turn = projected(spark, layout, request)
    if layout.cameras is None:
        placed = [(p, t, "planar", 0.0) for p, t in alignment.rows_of(layout)]
    else:
        placed = [(p, (turn @ r).ravel().tolist(), projection, float(layout.cameras.focal)) for p, r in sorted(layout.cameras.rotations.items())]
    maps = spark.createDataFrame(placed, "id long, transform array<double>, projection string, focal double")
    wanted = report.photos.select("id", "path", "width", "height", "orientation").join(maps, "id")
    rows = pixels_of.pixel_rows(spark, [r["path"] for r in wanted.select("path").collect()], wanted)

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                p = pixels_of.decoded(r.content, r.raw, r.rows, r.columns, r.bands, r.orientation)
                if p.shape[:2] != (r.height, r.width):
                    raise ValueError(f"{r.path} has changed since the analysis")
                depth = 16 if p.dtype == np.uint16 else 8
                p = np.repeat(p[..., :1], 3, axis=2) if p.shape[2] < 3 else p[..., :3]
                yield pd.DataFrame([[r.id, r.width, r.height, r.transform, r.projection, r.focal, depth, p.astype("<u2" if depth == 16 else np.uint8).tobytes()]], columns=[f.split()[0] for f in _DECODED.split(", ")])

    decoded_rows = stored(rows.repartition("id").mapInPandas(decoded, _DECODED))
    gains = _gains(decoded_rows, request.exposure) if request.exposure != "none" else {}
    gain_rows = spark.createDataFrame([(p, [float(g) for g in gains.get(p, [1.0])]) for p, *_ in placed], "id long, gain array<double>")
    seams = _seams(decoded_rows) if request.seams == "path" else None
    tiles = stitching.composite(decoded_rows.join(gain_rows, "id"), request.blending, seams=seams)
    return stitching.cropped(stored(tiles))[0] if request.crop else tiles


_DECODED = "id long, width int, height int, transform array<double>, projection string, focal double, depth int, pixels binary"


def _pixels(row) -> np.ndarray:
    """(height, width, 3) samples from 0 to 255."""
    p = np.frombuffer(row.pixels, "<u2" if row.depth == 16 else np.uint8).reshape(row.height, row.width, 3)
    return p.astype(float) / (257 if row.depth == 16 else 1)


def _gains(rows: DataFrame, exposure: str = "gain", step: int = 8, cell: int = 16) -> dict[int, list[float]]:
    """Exposure gains from coarse samples of where photos overlap: one a photo, one a channel, or a grid of blocks a photo."""
    if exposure not in ("gain", "channels", "blocks"):
        raise ValueError(f"unknown exposure {exposure!r}")

    def coarse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                p, placed = _pixels(r), stitching.Placed.of(r)
                y, x = (k.ravel() for k in np.mgrid[step // 2 : r.height : step, step // 2 : r.width : step])
                at = placed.target(np.column_stack([x, y]).astype(float))
                seen = np.isfinite(at).all(axis=1)
                u, v = (np.floor(at[seen, k] / cell).astype(np.int64) for k in (0, 1))
                x, y = x[seen], y[seen]
                block = (y * BLOCKS // r.height * BLOCKS + x * BLOCKS // r.width) if exposure == "blocks" else 0
                luma = p[y, x] @ np.array([0.299, 0.587, 0.114])
                values = p[y, x].T if exposure == "channels" else [luma]
                for channel, value in enumerate(values):
                    yield pd.DataFrame({"image": r.id * BLOCKS * BLOCKS + block, "photo": r.id, "channel": channel, "u": u, "v": v, "value": value})

    samples = rows.mapInPandas(coarse, "image long, photo long, channel int, u long, v long, value double").groupBy("image", "photo", "channel", "u", "v").agg(F.avg("value").alias("value"))
    means = raster.overlap_means(samples, ["channel"], "photo").orderBy("channel", "i", "j").collect()  # one row per overlapping pair of photos or blocks
    found = [raster.gains([(m["i"], m["j"], m["n"], m["mi"], m["mj"]) for m in means if m["channel"] == k]) for k in range(3 if exposure == "channels" else 1)]
    size = BLOCKS * BLOCKS
    photos_ = sorted({k // size for f in found for k in f})
    if exposure != "blocks":
        return {p: [f.get(p * size, 1.0) for f in found] for p in photos_}
    own = {p: {k % size: g for k, g in found[0].items() if k // size == p} for p in photos_}
    return {p: [known.get(b, float(np.mean(list(known.values())))) for b in range(size)] for p, known in own.items()}  # a block that nothing overlaps goes with its photo


BLOCKS = 8  # of a photo, either way, with a gain of their own


def _seams(rows: DataFrame) -> dict[int, stitching.Seam]:
    """Seams of all photos at a low resolution of the whole panorama, which the driver holds."""
    boxes = [stitching.Placed.of(r).box() for r in rows.select("id", "width", "height", "transform", "projection", "focal").toLocalIterator()]
    step = stitching.coarse_step(boxes)

    def copied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                luma = (_pixels(r) @ np.array([0.299, 0.587, 0.114]))[..., None]
                small, inside, x0, y0 = stitching.coarse_copy(luma, stitching.Placed.of(r), step)
                yield pd.DataFrame([[r.id, x0, y0, *small.shape, small.astype("<f4").tobytes(), np.packbits(inside).tobytes()]], columns=["id", "x0", "y0", "rows", "cols", "values", "mask"])

    copies = {}
    for r in rows.mapInPandas(copied, "id long, x0 int, y0 int, rows int, cols int, values binary, mask binary").toLocalIterator():
        inside = np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=r["rows"] * r["cols"]).reshape(r["rows"], r["cols"]).astype(bool)
        copies[r["id"]] = (np.frombuffer(r["values"], "<f4").reshape(r["rows"], r["cols"]).astype(float), inside, r["x0"], r["y0"])
    return stitching.found_seams(copies, step)


def thumbnails(report: Report, long_side: int = 256) -> DataFrame:
    """(id, width, height, png): small pictures of the photos that could be read, made where the photos are."""
    wanted = report.photos.where("NOT unreadable").select("id", "path", "orientation")
    rows = pixels_of.pixel_rows(report.photos.sparkSession, [r["path"] for r in wanted.select("path").collect()], wanted)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                small = pixels_of.preview(pixels_of.decoded(r.content, r.raw, r.rows, r.columns, r.bands, r.orientation), long_side)
                yield pd.DataFrame([[r.id, small.shape[1], small.shape[0], pixels_of.encode_png(small)]], columns=["id", "width", "height", "png"])

    return rows.mapInPandas(made, "id long, width int, height int, png binary")


def export(tiles: DataFrame, path: str) -> tuple[int, int, int, int]:
    """A panorama that the driver can hold as one PNG, TIFF or JPEG file; its corner and size in the layout's plane."""
    pixels, x, y = stitching.assembled(tiles)
    pixels_of.write_image(tiles.sparkSession, pixels, path)
    return x, y, pixels.shape[1], pixels.shape[0]


def text_report(report: Report) -> str:
    """Photos, candidates, pairs and groups as lines of text, for projects of a size that people read."""
    lines = [f"{r['id']:4d}  {r['width']}x{r['height']}  {r['name']}{'  unreadable' if r['unreadable'] else ''}" for r in report.photos.orderBy("id").collect()]
    lines += [f"{r['a']}-{r['b']}  {r['affinity']}  {', '.join(r['reasons'])}" for r in report.candidates.orderBy("a", "b").collect()]
    lines += [f"{r['a']}-{r['b']} {r['source']}: {r['verdict']}, {r['model']}, {len(r['inliers'] or [])} of {r['matches']}" for r in report.evidence.orderBy("a", "b", "source").collect()]
    lines += [f"group {r['component']}: {r['members']}" for r in report.groups.groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("members")).orderBy("component").collect()]
    return "\n".join(lines)
