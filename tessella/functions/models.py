"""Fitting of plane maps: translation, similarity, affine, homography; robust, seeded."""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma, log, log10, pi

import numpy as np

from tessella.config import DEFAULTS, MODELS

SAMPLE = {"translation": 1, "similarity": 2, "affine": 3, "homography": 4}


@dataclass
class Fit:
    model: str
    transform: np.ndarray
    inliers: np.ndarray
    rmse: float
    median: float


def apply(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Points through a 3x3 map; NaN behind the plane."""
    z = points @ h[2, :2] + h[2, 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (points @ h[:2, :2].T + h[:2, 2]) / z[:, None]
    out[z <= 1e-12] = np.nan
    return out


def least_squares(model: str, a: np.ndarray, b: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray | None:
    """The map of the given kind from points ``a`` to points ``b``; None where it is not determined."""
    n = len(a)
    if n < SAMPLE[model]:
        return None
    w = np.ones(n) if weights is None else weights
    if model == "translation":
        t = np.average(b - a, axis=0, weights=w)
        return np.array([[1, 0, t[0]], [0, 1, t[1]], [0, 0, 1.0]])
    ca, cb = np.average(a, axis=0, weights=w), np.average(b, axis=0, weights=w)
    if model == "homography":
        return _homography(a, b, w)
    r = np.sqrt(w)[:, None]
    return linear_map(model, ca, cb, (a - ca) * r, (b - cb) * r, w.sum())


def linear_map(model: str, ca: np.ndarray, cb: np.ndarray, p: np.ndarray, q: np.ndarray, weight: float) -> np.ndarray | None:
    """The similarity or affine map from points about their centres, times the roots of weights of that sum.

    A triangle of (p, q) does as well.
    """
    scale = max(np.sqrt((p**2).sum() / weight), 1e-12)
    p = p / scale
    if model == "similarity":
        rows = np.concatenate([np.column_stack([p[:, 0], -p[:, 1]]), np.column_stack([p[:, 1], p[:, 0]])])
        if np.linalg.matrix_rank(rows) < 2:
            return None
        u = np.linalg.lstsq(rows, np.concatenate([q[:, 0], q[:, 1]]), rcond=None)[0] / scale
        linear = np.array([[u[0], -u[1]], [u[1], u[0]]])
    else:
        if np.linalg.matrix_rank(p, tol=1e-9) < 2:
            return None
        linear = np.linalg.lstsq(p, q, rcond=None)[0].T / scale
    out = np.eye(3)
    out[:2, :2] = linear
    out[:2, 2] = cb - linear @ ca
    return out


def _homography(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray | None:
    """Normalised direct linear transform."""

    def normal(p):
        c = p.mean(axis=0)
        return normaliser(c, np.sqrt(((p - c) ** 2).sum(axis=1)).mean())

    ta, tb = normal(a), normal(b)
    return homography_of(triangle(transform_rows(a, b, w, ta, tb)), ta, tb)


def normaliser(centre: np.ndarray, apart: float) -> np.ndarray:
    """The map that takes points to their centre, at a mean distance of the root of two."""
    s = np.sqrt(2) / max(apart, 1e-12)
    return np.array([[s, 0, -s * centre[0]], [0, s, -s * centre[1]], [0, 0, 1.0]])


def transform_rows(a: np.ndarray, b: np.ndarray, w: np.ndarray, ta: np.ndarray, tb: np.ndarray) -> np.ndarray:
    """Two linear equations for the nine numbers of a homography from each match."""
    p, q = apply(ta, a), apply(tb, b)
    one, zero = np.ones(len(a)), np.zeros(len(a))
    top = np.column_stack([p, one, zero, zero, zero, -q[:, 0] * p[:, 0], -q[:, 0] * p[:, 1], -q[:, 0]])
    low = np.column_stack([zero, zero, zero, p, one, -q[:, 1] * p[:, 0], -q[:, 1] * p[:, 1], -q[:, 1]])
    return np.concatenate([top * np.sqrt(w)[:, None], low * np.sqrt(w)[:, None]])


def triangle(rows: np.ndarray) -> np.ndarray:
    """As many rows as columns at most, with the singular values and right vectors of ``rows``."""
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def homography_of(rows: np.ndarray, ta: np.ndarray, tb: np.ndarray) -> np.ndarray | None:
    _, s, v = np.linalg.svd(rows)
    if s[min(7, len(s) - 1)] < 1e-9:
        return None
    h = np.linalg.inv(tb) @ v[-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def residuals(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.sqrt(((apply(h, a) - b) ** 2).sum(axis=1))
    return np.where(np.isfinite(out), out, np.inf)


def upper_median(values: np.ndarray) -> float:
    return float(np.sort(values)[len(values) // 2]) if len(values) else float("nan")


def draws_needed(share: float, size: int, confidence: float, before: int) -> int:
    """After how many draws one of inliers alone is as good as certain."""
    if share <= 0:
        return before
    return 1 if share >= 1 else int(np.ceil(log(1 - confidence) / min(log(1 - share**size), -1e-12)))


def fit(model: str, a: np.ndarray, b: np.ndarray, threshold: float, iterations: int = DEFAULTS.max_iterations, confidence: float = DEFAULTS.confidence, seed: int = DEFAULTS.seed) -> Fit | None:
    """Random samples scored by truncated squared residuals, then refits on the inliers; seeded.

    Rows that are not finite take no part and are never inliers.
    """
    usable = np.flatnonzero(np.isfinite(a).all(axis=1) & np.isfinite(b).all(axis=1))
    size = SAMPLE[model]
    if len(usable) < size:
        return None
    x, y = a[usable], b[usable]
    rng = np.random.default_rng(seed)
    best, cost, needed, done = None, np.inf, iterations, 0
    while done < min(needed, iterations):
        done += 1
        drawn = rng.choice(len(x), size, replace=False)
        h = least_squares(model, x[drawn], y[drawn])
        if h is None or not np.isfinite(h).all():
            continue
        own = np.minimum(residuals(h, x, y), threshold)
        if (new := float((own**2).sum())) < cost:
            best, cost = h, new
            share = (own < threshold).mean()
            needed = draws_needed(share, size, confidence, needed)
    if best is None:
        return None
    for _ in range(10):
        inside = residuals(best, x, y) < threshold
        if inside.sum() < size:
            break
        h = least_squares(model, x[inside], y[inside])
        if h is None or not np.isfinite(h).all():
            break
        new = float((np.minimum(residuals(h, x, y), threshold) ** 2).sum())
        if new >= cost - 1e-12:
            break
        best, cost = h, new
    own = residuals(best, x, y)
    inside = own < threshold
    if inside.sum() < size:
        return None
    return Fit(model, best, usable[inside], float(np.sqrt((own[inside] ** 2).mean())), upper_median(own[inside]))


def simplest(fits: list[Fit], threshold: float, share: float = DEFAULTS.simpler_share) -> Fit | None:
    """The fit of fewest degrees of freedom that has nearly the best one's inliers and residual."""
    if not fits:
        return None
    best = max(fits, key=lambda f: (len(f.inliers), -MODELS[f.model]))
    good = [f for f in fits if len(f.inliers) >= share * len(best.inliers) and f.rmse <= 1.5 * best.rmse + 0.1 * threshold]
    return min(good, key=lambda f: MODELS[f.model]) if good else best


def log10_false_alarms(n: int, k: int, sample: int, threshold: float, area: float) -> float:
    """The expected number of chance fits with k of n inliers, as a power of ten."""
    if n <= sample or k <= sample or area <= 0:
        return float("inf")
    choose = lambda m, r: (lgamma(m + 1) - lgamma(r + 1) - lgamma(m - r + 1)) / log(10)
    alpha = min(1.0, pi * threshold * threshold / area)
    return log10(n - sample) + choose(n, k) + choose(k, sample) + (k - sample) * log10(alpha)


def plausible(h: np.ndarray, size_a: tuple[float, float], size_b: tuple[float, float], planar: bool) -> bool:
    """Orientation kept; for a planar mode also a singular-value ratio below 2 and a relative scale within 3."""
    centre = np.array([[size_a[0] / 2, size_a[1] / 2]])
    j = np.column_stack([(apply(h, centre + d) - apply(h, centre - d))[0] for d in (np.array([[0.5, 0]]), np.array([[0, 0.5]]))])
    det = np.linalg.det(j)
    if not np.isfinite(det) or det <= 0:
        return False
    if not planar:
        return True
    s = np.linalg.svd(j, compute_uv=False)
    relative = np.sqrt(det) * max(size_a) / max(size_b)
    return bool(s[0] / s[1] < 2 and 1 / 3 < relative < 3)


def tangent_affine(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The affine map that a homography looks like at the centroid of its matches."""
    centre = points.mean(axis=0)
    z = h[2] @ np.append(centre, 1.0)
    at = apply(h, centre[None])[0]
    linear = (h[:2, :2] - np.outer(at, h[2, :2])) / z
    out = np.eye(3)
    out[:2, :2], out[:2, 2] = linear, at - linear @ centre
    return out
