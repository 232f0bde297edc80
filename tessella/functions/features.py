"""Scale-space keypoints and gradient-histogram descriptors of gray images, in numpy."""

from __future__ import annotations

import numpy as np

_LEVELS, _SIGMA, _CONTRAST, _EDGE = 3, 1.6, 0.02, 10.0


def smoothed(image: np.ndarray, sigma: float) -> np.ndarray:
    radius = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded = np.pad(image, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="reflect" if image.shape[axis] > radius else "edge")
        image = sum(k * np.take(padded, range(i, i + image.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return image


def keypoints(image: np.ndarray, most: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """(n, 5) keypoints x, y, size, angle, response, strongest first, and their (n, 128) root descriptors."""
    found, vectors, octave, scale = [], [], image.astype(float), 1.0
    while min(octave.shape) >= 24:
        sigmas = [_SIGMA * 2 ** (i / _LEVELS) for i in range(_LEVELS + 3)]
        stack = [smoothed(octave, np.sqrt(max(_SIGMA**2 - 0.25, 0.01)) if scale == 1 else 0.5)]
        for a, b in zip(sigmas[:-1], sigmas[1:], strict=True):
            stack.append(smoothed(stack[-1], np.sqrt(b * b - a * a)))
        difference = np.diff(np.stack(stack), axis=0)
        for level, y, x, response in _extrema(difference):
            for angle in _angles(stack[level], y, x, 1.5 * sigmas[level]):
                vector = _descriptor(stack[level], y, x, sigmas[level], angle)
                if vector is not None:
                    found.append(((x + 0.5) * scale - 0.5, (y + 0.5) * scale - 0.5, sigmas[level] * scale * 2, angle, response))
                    vectors.append(vector)
        octave, scale = stack[_LEVELS][::2, ::2], scale * 2
    if not found:
        return np.zeros((0, 5)), np.zeros((0, 128))
    points, vectors_ = np.array(found), np.array(vectors)
    order = np.lexsort([points[:, 0], points[:, 1], -points[:, 4]])[:most]
    return points[order], vectors_[order]


def _extrema(d: np.ndarray):
    inner = d[1:-1, 1:-1, 1:-1]
    strong = np.abs(inner) > _CONTRAST / _LEVELS
    high, low = strong & (inner > 0), strong & (inner < 0)
    for dz in (0, 1, 2):
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                if (dz, dy, dx) != (1, 1, 1):
                    other = d[dz : dz + inner.shape[0], dy : dy + inner.shape[1], dx : dx + inner.shape[2]]
                    high &= inner > other
                    low &= inner < other
    for z, y, x in np.argwhere(high | low):
        level, y, x = z + 1, y + 1, x + 1
        p = d[level]
        dxx, dyy = p[y, x + 1] + p[y, x - 1] - 2 * p[y, x], p[y + 1, x] + p[y - 1, x] - 2 * p[y, x]
        dxy = (p[y + 1, x + 1] - p[y + 1, x - 1] - p[y - 1, x + 1] + p[y - 1, x - 1]) / 4
        det = dxx * dyy - dxy * dxy
        if det <= 0 or (dxx + dyy) ** 2 * _EDGE >= (_EDGE + 1) ** 2 * det:
            continue
        step = np.linalg.solve([[dxx, dxy], [dxy, dyy]], [-(p[y, x + 1] - p[y, x - 1]) / 2, -(p[y + 1, x] - p[y - 1, x]) / 2])
        if np.abs(step).max() < 1:
            yield level, y + step[1], x + step[0], abs(float(p[y, x]))


def _patch(image: np.ndarray, y: float, x: float, radius: int):
    cy, cx = round(y), round(x)
    if cy - radius < 1 or cx - radius < 1 or cy + radius >= image.shape[0] - 1 or cx + radius >= image.shape[1] - 1:
        return None
    rows, columns = slice(cy - radius, cy + radius + 1), slice(cx - radius, cx + radius + 1)
    gx = (image[rows, cx - radius + 1 : cx + radius + 2] - image[rows, cx - radius - 1 : cx + radius]) / 2
    gy = (image[cy - radius + 1 : cy + radius + 2, columns] - image[cy - radius - 1 : cy + radius, columns]) / 2
    v, u = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    return gx, gy, u + cx - x, v + cy - y


def _angles(image: np.ndarray, y: float, x: float, sigma: float) -> list[float]:
    got = _patch(image, y, x, int(3 * sigma))
    if got is None:
        return []
    gx, gy, u, v = got
    weight = np.hypot(gx, gy) * np.exp(-(u * u + v * v) / (2 * sigma * sigma))
    angle = np.arctan2(gy, gx) / (2 * np.pi) * 36
    histogram = np.bincount(np.floor(angle).astype(int).ravel() % 36, weight.ravel(), 36)
    for _ in range(4):
        histogram = (np.roll(histogram, 1) + histogram + np.roll(histogram, -1)) / 3
    left, right = np.roll(histogram, 1), np.roll(histogram, -1)
    out = []
    for i in np.flatnonzero((histogram > left) & (histogram > right) & (histogram >= 0.8 * histogram.max())):
        fine = 0.5 * (left[i] - right[i]) / (left[i] - 2 * histogram[i] + right[i])
        out.append(float((i + 0.5 + fine) % 36 * 2 * np.pi / 36))
    return out


def _descriptor(image: np.ndarray, y: float, x: float, sigma: float, angle: float) -> np.ndarray | None:
    cell = 3 * sigma
    got = _patch(image, y, x, int(round(cell * 2.5 * np.sqrt(2))))
    if got is None:
        return None
    gx, gy, u, v = got
    c, s = np.cos(angle), np.sin(angle)
    bx, by = (c * u + s * v) / cell + 1.5, (-s * u + c * v) / cell + 1.5
    turn = ((np.arctan2(gy, gx) - angle) / (2 * np.pi) * 8) % 8
    weight = np.hypot(gx, gy) * np.exp(-((bx - 1.5) ** 2 + (by - 1.5) ** 2) / 8)
    inside = (bx > -1) & (bx < 4) & (by > -1) & (by < 4)
    bx, by, turn, weight = bx[inside], by[inside], turn[inside], weight[inside]
    out = np.zeros((6, 6, 8))
    x0, y0, t0 = np.floor(bx).astype(int), np.floor(by).astype(int), np.floor(turn).astype(int)
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                share = np.abs(1 - i - (by - y0)) * np.abs(1 - j - (bx - x0)) * np.abs(1 - k - (turn - t0))
                np.add.at(out, (y0 + i + 1, x0 + j + 1, (t0 + k) % 8), weight * share)
    flat = out[1:5, 1:5].ravel()
    length = np.linalg.norm(flat)
    if length < 1e-9:
        return None
    flat = np.minimum(flat / length, 0.2)
    return np.sqrt(flat / flat.sum())


def ranked_maxima(logits: np.ndarray, ranker: np.ndarray, most: int, margin: int = 256, temperature: float = 0.5) -> np.ndarray:
    """(n, 3) x, y, logit of the strongest 3x3 maxima, those near the cut chosen by a second map.

    The first ``most + margin`` maxima by logit get sub-pixel places from a softmax over their 3x3
    neighbours; within ``margin`` of the cut they are ordered again by the ranker there. NaN and
    infinite logits below are never maxima; ties go to the earlier pixel, row by row.
    """
    h, w = logits.shape
    padded = np.pad(np.where(np.isnan(logits), -np.inf, logits), 1, constant_values=-np.inf)
    around = np.stack([padded[i : i + h, j : j + w] for i in range(3) for j in range(3)])
    top = (around[4] >= around.max(axis=0)) & (around[4] > -np.inf)
    y, x = np.nonzero(top)
    order = np.lexsort([y * w + x, -around[4][y, x]])[: most + margin]
    y, x = y[order], x[order]
    near = around[:, y, x]
    finite = np.where(np.isfinite(near), near, np.where(near > 0, near[4], -np.inf))
    middle = np.where(np.isfinite(near[4]), near[4], 0.0)
    weight = np.exp((finite - middle) / temperature, where=np.isfinite(near[4])[None], out=np.zeros_like(near))
    weight[4, ~np.isfinite(near[4])] = 1.0
    weight /= weight.sum(axis=0)
    dy, dx = (np.repeat([-1, 0, 1], 3)[:, None] * weight).sum(axis=0), (np.tile([-1, 0, 1], 3)[:, None] * weight).sum(axis=0)
    points = np.column_stack([x + dx, y + dy, near[4]])
    low = max(0, most - margin)
    if len(points) > most:
        second = _bilinear(ranker, points[low:, 0], points[low:, 1])
        again = np.argsort(-np.where(np.isnan(second), -np.inf, second), kind="stable")
        points = np.vstack([points[:low], points[low:][again]])[:most]
    points[:, :2] += 0.5
    return points


def _bilinear(values: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h, w = values.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    i, j = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    a, b = y - i, x - j
    k, m = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
    return values[i, j] * (1 - a) * (1 - b) + values[k, j] * a * (1 - b) + values[i, m] * (1 - a) * b + values[k, m] * a * b
