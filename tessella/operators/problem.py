"""The alignment problem of verified pairs, and which photos a predicted layout brings together."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.config import DEFAULTS, Analysis
from tessella.functions import models, polygons
from tessella.operators.verification import stratified

PROBLEM = "a long, b long, idx long, ax double, ay double, bx double, by double, sigma double, width double, height double"


def deduplicated(points: np.ndarray, sigma: np.ndarray, radius: float) -> np.ndarray:
    """Of matches (ax, ay, bx, by) close in both photos the one of lower sigma, first in order; indices."""
    cells: dict[tuple[int, int], list[int]] = {}
    kept = []
    for i in np.lexsort([np.arange(len(sigma)), sigma]):
        x, y = (points[i, :2] // max(radius, 1e-9)).astype(int)
        near = (k for u in (-1, 0, 1) for v in (-1, 0, 1) for k in cells.get((x + u, y + v), ()))
        if any(np.hypot(*(points[i, :2] - points[k, :2])) < radius and np.hypot(*(points[i, 2:] - points[k, 2:])) < radius for k in near):
            continue
        cells.setdefault((x, y), []).append(int(i))
        kept.append(int(i))
    return np.array(sorted(kept), dtype=np.int64)


def build(inliers: DataFrame, config: Analysis = DEFAULTS) -> DataFrame:
    """Matches for the alignment from verified inliers (a, b, source, idx, ax, ay, bx, by, rmse, wa, ha, wb, hb).

    All sources of a pair go together, oriented to a < b, without repeats; if a common map keeps
    fewer than nine tenths of the best source's inliers, that source alone is taken. Then at most
    ``match_cap`` matches are dealt out over a grid.
    """
    flip = F.col("a") > F.col("b")
    turned = {x: F.when(flip, F.col(y)).otherwise(F.col(x)) for p, q in (("a", "b"), ("ax", "bx"), ("ay", "by"), ("wa", "wb"), ("ha", "hb")) for x, y in ((p, q), (q, p))}
    rows = inliers.select("source", "idx", "rmse", *(v.alias(k) for k, v in turned.items()))

    def merged(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["source", "idx"]).reset_index(drop=True)
        points, sigma = group[["ax", "ay", "bx", "by"]].to_numpy(float), np.maximum(0.5, group["rmse"].to_numpy(float))
        threshold = config.inlier_threshold * np.sqrt(group["wb"].iloc[0] * group["hb"].iloc[0] / 1e6)
        kept = deduplicated(points, sigma, 0.5 * threshold)
        counts = group.groupby("source").size().sort_index()
        if len(counts) > 1:
            best = counts.idxmax()
            refit = models.fit("homography", points[kept, :2], points[kept, 2:], threshold, config.max_iterations, config.confidence, config.seed) if len(kept) >= 8 else None
            if refit is None or len(refit.inliers) < 0.9 * counts[best]:
                kept = np.flatnonzero((group["source"] == best).to_numpy())
            else:
                kept = kept[refit.inliers]
        out = group.loc[kept, ["ax", "ay", "bx", "by"]].reset_index(drop=True)
        return out.assign(a=key[0], b=key[1], idx=np.arange(len(kept)), sigma=sigma[kept], width=group["wa"].iloc[0], height=group["ha"].iloc[0])[[f.split()[0] for f in PROBLEM.split(", ")]]

    joint = rows.groupBy("a", "b").applyInPandas(merged, PROBLEM)
    named = joint.withColumns({"pair": F.struct("a", "b"), "x": F.col("ax"), "y": F.col("ay")})
    return stratified(named, config.match_cap, config.grid).select("a", "b", "idx", "ax", "ay", "bx", "by", "sigma")


def predicted(layout: dict[int, np.ndarray], sizes: dict[int, tuple[float, float]], least: float = 0.05) -> list[tuple[int, int, float]]:
    """(a, b, overlap) of photos that a layout lays over each other by more than ``least`` of the smaller."""
    shapes = {p: models.apply(t, polygons.rectangle(*sizes[p])) for p, t in layout.items()}
    shapes = {p: s for p, s in shapes.items() if np.isfinite(s).all()}
    boxes = {p: (*s.min(axis=0), *s.max(axis=0)) for p, s in shapes.items()}
    order, out = sorted(shapes, key=lambda p: boxes[p][0]), []
    for k, p in enumerate(order):
        for q in order[k + 1 :]:
            if boxes[q][0] >= boxes[p][2]:
                break
            if boxes[q][1] < boxes[p][3] and boxes[p][1] < boxes[q][3]:
                share = abs(polygons.area(polygons.clip(shapes[p], shapes[q]))) / max(min(abs(polygons.area(shapes[p])), abs(polygons.area(shapes[q]))), 1e-9)
                if share > least:
                    out.append((min(p, q), max(p, q), share))
    return sorted(out)


def placement(photos: list[int], edges: list[tuple[int, int, float, np.ndarray]], sizes: dict[int, tuple[float, float]]) -> dict[int, np.ndarray]:
    """A first layout: maps chained along the strongest links, components side by side."""
    links: dict[int, list[int]] = {p: [] for p in photos}
    for k, (a, b, _, _) in enumerate(edges):
        links[a].append(k)
        links[b].append(k)
    maps, shift, gap = {}, 0.0, 0.1 * max((max(s) for s in sizes.values()), default=0.0)
    for first in sorted(photos):
        if first in maps:
            continue
        own, ways = {first: np.eye(3)}, [(-edges[k][2], k) for k in links[first]]
        heapq.heapify(ways)  # the strongest first, of equals the first given
        while ways:
            a, b, _, h = edges[heapq.heappop(ways)[1]]
            if a in own and b in own:
                continue
            new = b if a in own else a
            own[new] = own[a] @ np.linalg.inv(h) if new == b else own[b] @ h
            for k in links[new]:
                heapq.heappush(ways, (-edges[k][2], k))
        corners = np.concatenate([models.apply(t, polygons.rectangle(*sizes[p])) for p, t in own.items()])
        low, high = np.nanmin(corners, axis=0), np.nanmax(corners, axis=0)
        move = np.array([[1, 0, shift - low[0]], [0, 1, -low[1]], [0, 0, 1.0]])
        maps |= {p: move @ t for p, t in own.items()}
        shift += high[0] - low[0] + gap
    return maps


def local_similarity(h: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The similarity that a map looks like at a point."""
    step = np.array([[0.5, 0.0], [0.0, 0.5]])
    j = np.column_stack([(models.apply(h, centre[None] + d) - models.apply(h, centre[None] - d))[0] for d in step])
    a, b = (j[0, 0] + j[1, 1]) / 2, (j[1, 0] - j[0, 1]) / 2
    at = models.apply(h, centre[None])[0]
    linear = np.array([[a, -b], [b, a]])
    out = np.eye(3)
    out[:2, :2], out[:2, 2] = linear, at - linear @ centre
    return out


def camera_homography(focal_a: float, ra: np.ndarray, ca: np.ndarray, focal_b: float, rb: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """What two turned cameras imply between their photos."""
    k = lambda f, c: np.array([[f, 0, c[0]], [0, f, c[1]], [0, 0, 1.0]])
    h = k(focal_b, cb) @ rb.T @ ra @ np.linalg.inv(k(focal_a, ca))
    return h / h[2, 2]


def straightened(rotations: dict[int, np.ndarray], least_photos: int = 3, least_extent: float = 30.0) -> dict[int, np.ndarray]:
    """Rotations turned so that the cameras' x axes lie level, for sweeps that are wide enough."""
    axes = np.array([r[:, 2] for r in rotations.values()])
    if len(axes) < least_photos or np.degrees(np.arccos(np.clip(axes @ axes.T, -1, 1))).max() < least_extent:
        return rotations
    side = np.array([r[:, 0] for r in rotations.values()])
    up = np.linalg.eigh(side.T @ side)[1][:, 0]
    up = up if up @ np.mean([r[:, 1] for r in rotations.values()], axis=0) > 0 else -up
    front = axes.mean(axis=0) - up * (up @ axes.mean(axis=0))
    if np.linalg.norm(front) < 1e-9:
        return rotations
    front /= np.linalg.norm(front)
    turn = np.stack([np.cross(up, front), up, front])
    return {p: turn @ r for p, r in rotations.items()}
