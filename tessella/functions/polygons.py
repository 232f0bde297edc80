"""Polygon kernels on (n, 2) arrays: clipping, hulls, overlap of two photos."""

from __future__ import annotations

import numpy as np


def half_plane(points: np.ndarray, a: float, b: float, c: float) -> np.ndarray:
    """The part of a convex polygon where a x + b y + c >= 0."""
    if not len(points):
        return points
    side = points @ np.array([a, b]) + c
    out = []
    for i in range(len(points)):
        j = (i + 1) % len(points)
        if side[i] >= 0:
            out.append(points[i])
        if (side[i] < 0) != (side[j] < 0):
            out.append(points[i] + (points[j] - points[i]) * side[i] / (side[i] - side[j]))
    return np.array(out).reshape(-1, 2)


def clip(points: np.ndarray, window: np.ndarray) -> np.ndarray:
    """A convex polygon within a convex window of either orientation."""
    turn = 1.0 if area(window) >= 0 else -1.0
    for i in range(len(window)):
        p, q = window[i], window[(i + 1) % len(window)]
        a, b = -(q[1] - p[1]) * turn, (q[0] - p[0]) * turn
        points = half_plane(points, a, b, -(a * p[0] + b * p[1]))
    return points


def area(points: np.ndarray) -> float:
    """Signed shoelace area."""
    if len(points) < 3:
        return 0.0
    x, y = points[:, 0], points[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def rectangle(width: float, height: float) -> np.ndarray:
    return np.array([[0.0, 0.0], [width, 0.0], [width, height], [0.0, height]])


def overlap(h: np.ndarray, size_a: tuple[float, float], size_b: tuple[float, float]) -> np.ndarray:
    """The part of photo A that ``h`` takes into photo B: A's rectangle under five linear half-planes."""
    h = np.asarray(h, dtype=float).reshape(3, 3)
    points = rectangle(*size_a)
    lines = [h[2] - np.array([0, 0, 1e-9]), h[0], size_b[0] * h[2] - h[0], h[1], size_b[1] * h[2] - h[1]]
    for a, b, c in lines:
        points = half_plane(points, a, b, c)
    return points


def hull(points: np.ndarray) -> np.ndarray:
    """Indices of the convex hull's corners, by monotone chains."""
    order = np.lexsort([points[:, 1], points[:, 0]])
    order = order[np.concatenate(([True], (np.diff(points[order], axis=0) != 0).any(axis=1)))] if len(order) else order
    if len(order) < 3:
        return order

    def chain(indices):
        out: list[int] = []
        for i in indices:
            while len(out) > 1 and _turn(points[out[-2]], points[out[-1]], points[i]) <= 0:
                out.pop()
            out.append(int(i))
        return out

    return np.array(chain(order)[:-1] + chain(order[::-1])[:-1])


def corners(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of very many points: those within the hull of a few extreme ones go first."""
    if len(points) > 100:
        turns = np.arange(16) * np.pi / 8
        ends = points[(points @ np.stack([np.cos(turns), np.sin(turns)])).argmax(axis=0)]
        ends = ends[hull(ends)]
        if len(ends) > 2:
            points = points[~(_sides(ends, points) > 0).all(axis=0)]
    return points[hull(points)]


def within(polygon: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Which points are in a convex polygon, its edges included."""
    side = _sides(polygon, points)
    return (side >= 0).all(axis=0) | (side <= 0).all(axis=0)


def _sides(polygon: np.ndarray, points: np.ndarray) -> np.ndarray:
    following = np.roll(polygon, -1, axis=0)
    return (following[:, 0] - polygon[:, 0])[:, None] * (points[:, 1][None] - polygon[:, 1][:, None]) - (following[:, 1] - polygon[:, 1])[:, None] * (points[:, 0][None] - polygon[:, 0][:, None])


def hull_area(points: np.ndarray) -> float:
    return abs(area(points[hull(points)])) if len(points) > 2 else 0.0


def peeled_hull_area(points: np.ndarray) -> float:
    """The hull of what is left without the corners of the hull; a stray point doesn't count."""
    if len(points) < 3:
        return 0.0
    rest = np.delete(points, hull(points), axis=0)
    return hull_area(rest)


def coverage(points: np.ndarray, polygon: np.ndarray, grid: int = 8) -> float:
    """The share of grid cells of the polygon's box, among those it touches, that hold a point."""
    return coverage_of(taken(points, polygon, grid), polygon, grid)


def taken(points: np.ndarray, polygon: np.ndarray, grid: int = 8) -> set[tuple[int, int]]:
    """The grid cells of the polygon's box that hold a point."""
    low, high = polygon.min(axis=0), polygon.max(axis=0)
    cells = np.clip(((points - low) / np.maximum(high - low, 1e-9) * grid).astype(int), 0, grid - 1)
    return set(map(tuple, np.unique(cells, axis=0).tolist()))


def coverage_of(taken: set[tuple[int, int]], polygon: np.ndarray, grid: int = 8) -> float:
    """``coverage`` by points in the given cells."""
    low, high = polygon.min(axis=0), polygon.max(axis=0)
    size = (high - low) / grid
    boxes = ((i, j, clip(polygon, low + size * (np.array([i, j]) + np.array([[0, 0], [1, 0], [1, 1], [0, 1]])))) for i in range(grid) for j in range(grid))
    touched = {(i, j) for i, j, part in boxes if abs(area(part)) > 1e-9}
    return len(taken & touched) / max(len(touched), 1)


def _turn(o: np.ndarray, p: np.ndarray, q: np.ndarray) -> float:
    return (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
