"""Rendering a layout: inverse warps by tile, seams, bands, crop. Tiles are the unit of parallel work."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import models
from tessella.operators.raster import multi_band

TILE = 512
HALO = 64
PROJECTIONS = ("planar", "rectilinear", "cylindrical", "spherical")
SEAM_PIXELS = 100_000  # of the whole panorama at which seams are found


def to_rays(u: np.ndarray, v: np.ndarray, projection: str, focal: float) -> np.ndarray:
    """Directions of panorama points about the middle of the panorama."""
    if projection == "cylindrical":
        return np.stack([np.sin(u / focal), v / focal, np.cos(u / focal)], axis=-1)
    if projection == "spherical":
        return np.stack([np.sin(u / focal) * np.cos(v / focal), np.sin(v / focal), np.cos(u / focal) * np.cos(v / focal)], axis=-1)
    return np.stack([u / focal, v / focal, np.ones_like(u)], axis=-1)


def from_rays(rays: np.ndarray, projection: str, focal: float) -> np.ndarray:
    """The panorama points (…, 2) of directions; not a number where a plane has none."""
    x, y, z = rays[..., 0], rays[..., 1], rays[..., 2]
    if projection == "cylindrical":
        return np.stack([np.arctan2(x, z), y / np.hypot(x, z)], axis=-1) * focal
    if projection == "spherical":
        return np.stack([np.arctan2(x, z), np.arctan2(y, np.hypot(x, z))], axis=-1) * focal
    z = np.where(z > 1e-6, z, np.nan)
    return np.stack([x / z, y / z], axis=-1) * focal


@dataclass
class Placed:
    """How a photo lies in the panorama: by a map of the plane, or as a turned camera seen through a projection."""

    width: int
    height: int
    transform: np.ndarray  # photo to plane, or the camera's rotation
    projection: str = "planar"
    focal: float = 0.0  # of photo and panorama, in photo pixels

    @classmethod
    def of(cls, row) -> Placed:
        return cls(row.width, row.height, np.array(row.transform, dtype=float).reshape(3, 3), row.projection, row.focal)

    def source(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """(…, 2) points of the photo under panorama points; not a number where there are none."""
        if self.projection == "planar":
            p = models.apply(np.linalg.inv(self.transform), np.column_stack([u.ravel(), v.ravel()]))
            return p.reshape(*u.shape, 2)
        ray = to_rays(u, v, self.projection, self.focal) @ self.transform  # the camera's own axes
        z = np.where(ray[..., 2] > 1e-6, ray[..., 2], np.nan)
        return ray[..., :2] / z[..., None] * self.focal + np.array([self.width, self.height]) / 2

    def target(self, points: np.ndarray) -> np.ndarray:
        """Panorama points of (n, 2) photo points."""
        if self.projection == "planar":
            return models.apply(self.transform, points)
        ray = np.column_stack([points - np.array([self.width, self.height]) / 2, np.full(len(points), self.focal)]) @ self.transform.T
        return from_rays(ray, self.projection, self.focal)

    def centre(self) -> np.ndarray:
        return self.target(np.array([[self.width / 2, self.height / 2]]))[0]

    def box(self) -> tuple[int, int, int, int]:
        """The photo's box in the panorama; a photo behind the plane, or across the seam of a full turn, is refused."""
        t = np.linspace(0, 1, 2 if self.projection == "planar" else 65)
        edge = np.concatenate([np.column_stack([t, 0 * t]), np.column_stack([t, 0 * t + 1]), np.column_stack([0 * t, t]), np.column_stack([0 * t + 1, t])])
        at = self.target(edge * [self.width, self.height])
        if not np.isfinite(at).all() or np.abs(at).max() > 1e7:
            raise ValueError("a photo lies behind the plane")
        if self.projection in ("cylindrical", "spherical") and np.ptp(at[:, 0]) > np.pi * self.focal:
            raise ValueError("a photo lies across the back of the panorama")
        low, high = np.floor(at.min(axis=0)).astype(int), np.ceil(at.max(axis=0)).astype(int)
        return int(low[0]), int(low[1]), int(high[0]), int(high[1])


def sampled(pixels: np.ndarray, x: np.ndarray, y: np.ndarray, size: tuple[int, int] | None = None, corner: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray]:
    """Bicubic samples at (x, y), mirrored at the photo's border, and where they lie inside the photo.

    ``pixels`` may be a part of a photo of ``size`` (height, width) that begins at ``corner`` (row, column).
    """
    h, w = size or pixels.shape[:2]
    inside = (x > -0.5) & (x < w - 0.5) & (y > -0.5) & (y < h - 0.5)
    x0, y0 = np.floor(np.where(inside, x, corner[1])).astype(int), np.floor(np.where(inside, y, corner[0])).astype(int)

    def weights(t):
        a = -0.75
        near = lambda d: (a + 2) * d**3 - (a + 3) * d**2 + 1
        far = lambda d: a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a
        return [far(t + 1), near(t), near(1 - t), far(2 - t)]

    wx, wy = weights(np.where(inside, x, corner[1]) - x0), weights(np.where(inside, y, corner[0]) - y0)
    mirrored = lambda i, n: np.clip(np.where(i < 0, -i - 1, np.where(i >= n, 2 * n - 1 - i, i)), 0, n - 1)
    within = lambda i, start, n: np.clip(i - start, 0, n - 1)
    out = np.zeros((*x.shape, pixels.shape[2]))
    for j in range(4):
        rows = within(mirrored(y0 + j - 1, h), corner[0], pixels.shape[0])
        for i in range(4):
            out += (wy[j] * wx[i])[..., None] * pixels[rows, within(mirrored(x0 + i - 1, w), corner[1], pixels.shape[1])]
    return out, inside


def tiles_of(box: tuple[int, int, int, int], tile: int = TILE) -> list[tuple[int, int]]:
    x0, y0, x1, y1 = box
    return [(i, j) for j in range(y0 // tile, (y1 - 1) // tile + 1) for i in range(x0 // tile, (x1 - 1) // tile + 1)]


_PATCH = "ty int, tx int, id long, width int, height int, transform array<double>, projection string, focal double, gain array<double>, row int, col int, rows int, cols int, depth int, patch binary"


def _patches(batches: Iterator[pd.DataFrame], tile: int, halo: int) -> Iterator[pd.DataFrame]:
    """Photos to the part of each that a tile needs: what a tile doesn't show doesn't travel."""
    for batch in batches:
        for r in batch.itertuples():
            placed = Placed.of(r)
            x0, y0, x1, y1 = placed.box()
            pixels = np.frombuffer(r.pixels, "<u2" if r.depth == 16 else np.uint8).reshape(r.height, r.width, 3)
            for tx, ty in tiles_of((x0 - halo, y0 - halo, x1 + halo, y1 + halo), tile):
                step = np.linspace(-halo, tile + halo, 33)
                u, v = np.meshgrid(tx * tile + step, ty * tile + step)
                p = placed.source(u, v) - 0.5
                known = np.isfinite(p).all(axis=-1)
                if not known.any():
                    continue
                # between the points asked a source moves by less than their distance, but for horizons, where all of it is taken
                slack = 3 + (np.nanmax(np.abs(np.diff(p, axis=1)), initial=0) + np.nanmax(np.abs(np.diff(p, axis=0)), initial=0)) / 2
                low, high = (p[known].min(axis=0) - slack, p[known].max(axis=0) + slack) if known.all() else (np.zeros(2), np.array([r.width, r.height]))
                left, top = (int(x) for x in np.clip(np.floor(low), 0, [r.width, r.height]))
                right, bottom = (int(x) for x in np.clip(np.ceil(high) + 1, 0, [r.width, r.height]))
                if right > left and bottom > top:
                    part = np.ascontiguousarray(pixels[top:bottom, left:right])
                    yield pd.DataFrame([[ty, tx, r.id, r.width, r.height, r.transform, r.projection, r.focal, r.gain, top, left, *part.shape[:2], r.depth, part.tobytes()]], columns=[f.split()[0] for f in _PATCH.split(", ")])


def composite(photos: DataFrame, blending: str = "multiband", bands: int = 5, tile: int = TILE, seams: dict[int, Seam] | None = None) -> DataFrame:
    """(ty, tx, height, width, pixels) of 16-bit RGBA tiles from photos (id, width, height, transform, projection, focal, gain, depth, pixels).

    ``pixels`` has a photo's RGB samples of ``depth`` 8 or 16 bits, ``gain`` one factor per channel and block of
    the photo. The parts of a photo that tiles show go to them; a tile with its halo is then rendered by
    itself, so a panorama's size doesn't matter to a task. ``seams``: coarse masks, a few bytes a photo.
    """
    halo = HALO if blending == "multiband" else 0
    sent = photos.sparkSession.sparkContext.broadcast(seams or {})  # SEAM_PIXELS in all, times the overlap

    def rendered(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ty, tx = key
        group = group.sort_values("id")
        u, v = np.meshgrid(np.arange(tx * tile - halo, (tx + 1) * tile + halo) + 0.5, np.arange(ty * tile - halo, (ty + 1) * tile + halo) + 0.5)
        colours, masks, near = [], [], []
        for r in group.itertuples():
            placed = Placed.of(r)
            p = np.nan_to_num(placed.source(u, v) - 0.5, nan=-1e6, posinf=-1e6, neginf=-1e6)
            pixels = np.frombuffer(r.patch, "<u2" if r.depth == 16 else np.uint8).reshape(r.rows, r.cols, 3)
            colour, inside = sampled(pixels.astype(float), p[..., 0], p[..., 1], (r.height, r.width), (r.row, r.col))
            colours.append(colour * gain_at(np.array(r.gain, dtype=float), p, r.width, r.height) * (1 if r.depth == 16 else 257))
            masks.append(inside)
            distance = np.hypot(u - placed.centre()[0], v - placed.centre()[1])
            allowed = sent.value[r.id].at(u, v) if r.id in sent.value else np.ones(u.shape, bool)
            near.append(np.where(inside, distance + np.where(allowed, 0, 1e7), np.inf))
        covered = np.any(masks, axis=0)
        if blending == "none" and not sent.value:
            owner = len(masks) - 1 - np.argmax(np.stack(masks[::-1]), axis=0)
        else:
            owner = np.argmin(np.stack(near), axis=0)
        own = [(owner == k) & m for k, m in enumerate(masks)]
        if blending == "multiband":
            # beyond a photo's edge its bands see its nearest own colour, not black
            filled = [np.where(m[..., None], c, _mean(c, m)) for c, m in zip(colours, masks, strict=True)]
            out = np.stack([multi_band([f[..., k] for f in filled], own, bands) for k in range(3)], axis=-1)
        else:
            out = sum(c * o[..., None] for c, o in zip(colours, own, strict=True))
        rgba = np.dstack([np.clip(np.round(out), 0, 65535), np.full(covered.shape, 65535)]) * covered[..., None]
        rgba = rgba[halo : halo + tile, halo : halo + tile].astype("<u2")
        return pd.DataFrame([[ty, tx, tile, tile, rgba.tobytes()]], columns=["ty", "tx", "height", "width", "pixels"])

    parts = photos.mapInPandas(lambda batches: _patches(batches, tile, halo), _PATCH)
    return parts.groupBy("ty", "tx").applyInPandas(rendered, "ty int, tx int, height int, width int, pixels binary")


def gain_at(gain: np.ndarray, p: np.ndarray, width: int, height: int) -> np.ndarray:
    """(…, 3) factors at photo points: one for all, one per channel, or a square grid of blocks between which they pass over."""
    if len(gain) in (1, 3):
        return np.broadcast_to(gain, (*p.shape[:-1], 3))
    side = int(round((len(gain)) ** 0.5))
    grid = gain.reshape(side, side)
    x, y = np.clip(p[..., 0] / width * side - 0.5, 0, side - 1), np.clip(p[..., 1] / height * side - 0.5, 0, side - 1)
    i, j = np.minimum(x.astype(int), side - 2), np.minimum(y.astype(int), side - 2)
    a, b = x - i, y - j
    return (grid[j, i] * (1 - a) * (1 - b) + grid[j, i + 1] * a * (1 - b) + grid[j + 1, i] * (1 - a) * b + grid[j + 1, i + 1] * a * b)[..., None]


def _mean(colour: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return colour[mask].mean(axis=0) if mask.any() else np.zeros(colour.shape[-1])


def assembled(tiles: DataFrame, tile: int = TILE) -> tuple[np.ndarray, int, int]:
    """A whole panorama on the driver for export, and where its corner stands; only for what fits there."""
    rows = list(tiles.toLocalIterator())
    if not rows:
        return np.zeros((0, 0, 4), np.uint16), 0, 0
    x0, y0 = min(r["tx"] for r in rows), min(r["ty"] for r in rows)
    x1, y1 = max(r["tx"] for r in rows) + 1, max(r["ty"] for r in rows) + 1
    out = np.zeros(((y1 - y0) * tile, (x1 - x0) * tile, 4), np.uint16)
    for r in rows:
        at = ((r["ty"] - y0) * tile, (r["tx"] - x0) * tile)
        out[at[0] : at[0] + tile, at[1] : at[1] + tile] = np.frombuffer(r["pixels"], "<u2").reshape(tile, tile, 4)
    used = np.argwhere(out[..., 3] > 0)
    if not len(used):
        return out[:0, :0], 0, 0
    low, high = used.min(axis=0), used.max(axis=0) + 1
    return out[low[0] : high[0], low[1] : high[1]], int(x0 * tile + low[1]), int(y0 * tile + low[0])


def inscribed(mask: np.ndarray, most: int = 60_000_000) -> tuple[int, int, int, int]:
    """(x, y, width, height) of the largest all-set rectangle; beyond ``most`` pixels first at half size, then grown."""
    if mask.size > most:
        h, w = mask.shape[0] // 2 * 2, mask.shape[1] // 2 * 2
        small = mask[:h:2, :w:2] & mask[1:h:2, :w:2] & mask[:h:2, 1:w:2] & mask[1:h:2, 1:w:2]
        x, y, w, h = (2 * k for k in inscribed(small, most))
        while x and h and mask[y : y + h, x - 1].all():
            x, w = x - 1, w + 1
        while h and x + w < mask.shape[1] and mask[y : y + h, x + w].all():
            w += 1
        while y and w and mask[y - 1, x : x + w].all():
            y, h = y - 1, h + 1
        while w and y + h < mask.shape[0] and mask[y + h, x : x + w].all():
            h += 1
        return x, y, w, h
    best, heights = (0, 0, 0, 0), np.zeros(mask.shape[1], dtype=np.int64)
    for y in range(mask.shape[0]):
        heights = np.where(mask[y], heights + 1, 0)
        stack: list[tuple[int, int]] = []
        for x, tall in enumerate([*heights.tolist(), 0]):
            start = x
            while stack and stack[-1][1] >= tall:
                start, own = stack.pop()
                if own * (x - start) > best[2] * best[3]:
                    best = (start, y - own + 1, x - start, own)
            stack.append((start, tall))
    return best


@dataclass
class Seam:
    """Where a photo may own the panorama: a coarse mask and its place."""

    mask: np.ndarray
    x0: float
    y0: float
    step: float

    def at(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The mask under panorama points of a regular grid, a coarse pixel wider; false outside."""
        i, j = np.floor((u[0] - self.x0) / self.step).astype(int), np.floor((v[:, 0] - self.y0) / self.step).astype(int)
        h, w = self.mask.shape
        wide = dilated(self.mask)[np.ix_(np.clip(j, 0, h - 1), np.clip(i, 0, w - 1))]
        return wide & ((j >= 0) & (j < h))[:, None] & ((i >= 0) & (i < w))[None]


def coarse_step(boxes: list[tuple[int, int, int, int]], most: int = SEAM_PIXELS) -> float:
    """How many panorama pixels a coarse one spans, so that the whole has ``most``."""
    if not boxes:
        return 1.0
    x0, y0, x1, y1 = (f(b[k] for b in boxes) for k, f in enumerate((min, min, max, max)))
    return max(1.0, ((x1 - x0) * (y1 - y0) / most) ** 0.5)


def coarse_copy(pixels: np.ndarray, placed: Placed, step: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """A photo's luma in the coarse panorama, where it covers it, and its corner in coarse pixels."""
    x0, y0, x1, y1 = (int(np.floor(k / step)) for k in placed.box())
    u, v = np.meshgrid((np.arange(x0, x1 + 1) + 0.5) * step, (np.arange(y0, y1 + 1) + 0.5) * step)
    p = np.nan_to_num(placed.source(u, v) - 0.5, nan=-1e6, posinf=-1e6, neginf=-1e6)
    colour, inside = sampled(pixels, p[..., 0], p[..., 1])
    return colour[..., 0] * inside, inside, x0, y0


def found_seams(copies: dict[int, tuple[np.ndarray, np.ndarray, int, int]], step: float) -> dict[int, Seam]:
    """A mask per photo such that of two photos that overlap one owns either side of the cheapest path between their middles.

    Pairs go in rounds of which none shares a photo, in the order of the pairs, so each finds the masks that the ones
    before it left.
    """
    masks = {p: c[1].copy() for p, c in copies.items()}
    box = {p: (c[2], c[3], c[2] + c[1].shape[1], c[3] + c[1].shape[0]) for p, c in copies.items()}
    meets = lambda p, q: max(box[p][0], box[q][0]) < min(box[p][2], box[q][2]) and max(box[p][1], box[q][1]) < min(box[p][3], box[q][3])
    pairs = [(p, q) for p in sorted(copies) for q in sorted(copies) if p < q and meets(p, q)]
    rounds = seam_rounds(pairs)
    for p, q in sorted(pairs, key=lambda k: (rounds[k], k)):
        x0, y0, x1, y1 = max(box[p][0], box[q][0]), max(box[p][1], box[q][1]), min(box[p][2], box[q][2]), min(box[p][3], box[q][3])
        part = lambda a, k: a[y0 - box[k][1] : y1 - box[k][1], x0 - box[k][0] : x1 - box[k][0]]
        shared = part(masks[p], p) & part(masks[q], q)
        if not shared.any():
            continue
        cost = np.where(shared, np.abs(part(copies[p][0], p) - part(copies[q][0], q)) + 1e-3, 0.0)
        apart = np.array([(box[q][k] + box[q][k + 2]) - (box[p][k] + box[p][k + 2]) for k in (0, 1)])
        across = abs(apart[0]) >= abs(apart[1])  # the seam runs across the way from one middle to the other
        path = cheapest_seam(cost if across else cost.T)
        place = np.arange(cost.shape[1] if across else cost.shape[0])[None] < path[:, None]
        first = place if across else place.T  # the side of the lower coordinates
        to_p = first if (apart[0] if across else apart[1]) >= 0 else ~first
        part(masks[p], p)[shared & ~to_p] = False
        part(masks[q], q)[shared & to_p] = False
    return {p: Seam(m, box[p][0] * step, box[p][1] * step, step) for p, m in masks.items()}


def seam_rounds(pairs: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Rounds in which seams of pairs can be found side by side, equal to finding them in order."""
    latest: dict[int, int] = {}
    out = {}
    for i, j in pairs:
        out[(i, j)] = latest[i] = latest[j] = 1 + max(latest.get(i, 0), latest.get(j, 0))
    return out


def cheapest_seam(cost: np.ndarray) -> np.ndarray:
    """For each row the column of the cheapest connected path from top to bottom."""
    total = cost.astype(float).copy()
    for y in range(1, len(total)):
        above = np.pad(total[y - 1], 1, constant_values=np.inf)
        total[y] += np.minimum(np.minimum(above[:-2], above[1:-1]), above[2:])
    path = np.empty(len(total), dtype=np.int64)
    path[-1] = int(np.argmin(total[-1]))
    for y in range(len(total) - 2, -1, -1):
        low = max(0, path[y + 1] - 1)
        path[y] = low + int(np.argmin(total[y, low : path[y + 1] + 2]))
    return path


def dilated(mask: np.ndarray) -> np.ndarray:
    """A mask one pixel wider on all sides."""
    wide = mask.copy()
    wide[1:] |= mask[:-1]
    wide[:-1] |= mask[1:]
    out = wide.copy()
    out[:, 1:] |= wide[:, :-1]
    out[:, :-1] |= wide[:, 1:]
    return out


def seam_mask(small: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """A seam mask found at low resolution, one pixel wider, at full size within the valid mask."""
    y = np.arange(valid.shape[0]) * small.shape[0] // valid.shape[0]
    x = np.arange(valid.shape[1]) * small.shape[1] // valid.shape[1]
    return dilated(small)[np.ix_(y, x)] & valid


def cropped(tiles: DataFrame, block: int = 8, tile: int = TILE) -> tuple[DataFrame, tuple[int, int, int, int]]:
    """Tiles cut to a rectangle that is covered everywhere, and it (x, y, width, height) in panorama pixels.

    Each tile sends which of its blocks are covered whole; the largest rectangle of such blocks is found on the
    driver (a 64th of the panorama's pixels, one bit each) and is the crop. Pixels outside become transparent and
    tiles without any go.
    """

    def covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                alpha = np.frombuffer(r.pixels, "<u2").reshape(tile, tile, 4)[..., 3] > 0
                whole = alpha.reshape(tile // block, block, tile // block, block).all(axis=(1, 3))
                yield pd.DataFrame([[r.ty, r.tx, np.packbits(whole).tobytes()]], columns=["ty", "tx", "bits"])

    rows = tiles.mapInPandas(covered, "ty int, tx int, bits binary").collect()
    if not rows:
        return tiles, (0, 0, 0, 0)
    n = tile // block
    x0, y0 = min(r["tx"] for r in rows), min(r["ty"] for r in rows)
    mask = np.zeros(((max(r["ty"] for r in rows) + 1 - y0) * n, (max(r["tx"] for r in rows) + 1 - x0) * n), dtype=bool)
    for r in rows:
        mask[(r["ty"] - y0) * n : (r["ty"] - y0 + 1) * n, (r["tx"] - x0) * n : (r["tx"] - x0 + 1) * n] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).reshape(n, n)
    x, y, w, h = inscribed(mask)
    left, top, width, height = x0 * tile + x * block, y0 * tile + y * block, w * block, h * block

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                rgba = np.frombuffer(r.pixels, "<u2").reshape(tile, tile, 4).copy()
                u, v = r.tx * tile + np.arange(tile), r.ty * tile + np.arange(tile)
                rgba[(v < top) | (v >= top + height)] = 0
                rgba[:, (u < left) | (u >= left + width)] = 0
                yield pd.DataFrame([[r.ty, r.tx, r.height, r.width, rgba.tobytes()]], columns=["ty", "tx", "height", "width", "pixels"])

    inside = (F.col("tx") * tile < left + width) & ((F.col("tx") + 1) * tile > left) & (F.col("ty") * tile < top + height) & ((F.col("ty") + 1) * tile > top)
    return tiles.where(inside).mapInPandas(cut, tiles.schema), (left, top, width, height)


def export_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles as a Parquet table; Spark's committer makes them visible all at once."""
    tiles.select("ty", "tx", "height", "width", F.col("pixels")).write.mode("overwrite").parquet(path)
