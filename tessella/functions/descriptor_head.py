"""A learned extractor's descriptor head: deformable samples of a feature map, at the keypoints only.

The feature map is never made whole: each pixel that is read is upsampled from the levels of the network's dense part and
normalised there. Weights come from a file; none are part of this package.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MAGIC = b"ALKH"  # fixed value: the file's first bytes
_LIMITS = (4096, 256, 15, 4096)  # channels, positions, patch, length
BLOCK = 256  # keypoints at a time


@dataclass
class Head:
    """Weights by what they do; ``patch`` is the side of the patch that the offsets come from."""

    channels: int
    positions: int
    patch: int
    length: int
    offsets: np.ndarray  # (2 positions, channels * patch * patch)
    offsets_bias: np.ndarray
    second: np.ndarray  # (2 positions, 2 positions)
    second_bias: np.ndarray
    samples: np.ndarray  # (channels, channels)
    aggregation: np.ndarray  # (positions * channels, length)


def read_head(data: bytes) -> Head:
    """The head of a weights file; a file of another kind, with odd sizes or cut short is refused."""
    if data[:4] != MAGIC or len(data) < 20:
        raise ValueError("not a descriptor head")
    sizes = struct.unpack("<4i", data[4:20])
    if any(not 1 <= n <= most for n, most in zip(sizes, _LIMITS, strict=True)) or sizes[2] % 2 == 0:
        raise ValueError("a descriptor head with impossible sizes")
    c, p, k, d = sizes
    shapes = ((2 * p, c * k * k), (2 * p,), (2 * p, 2 * p), (2 * p,), (c, c), (p * c, d))
    ends = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
    if len(data) != 20 + 4 * ends[-1]:
        raise ValueError("a descriptor head of the wrong length")
    flat = np.frombuffer(data, "<f4", offset=20)
    return Head(c, p, k, d, *(flat[a:b].reshape(s) for a, b, s in zip(ends[:-1], ends[1:], shapes, strict=True)))


def selu(x: np.ndarray) -> np.ndarray:
    return 1.0507009873554805 * np.where(x > 0, x, 1.6732632423543772 * np.expm1(np.minimum(x, 0)))


@dataclass
class FeatureMap:
    """Levels (channels, height, width) that together make a map of ``width`` x ``height``."""

    levels: list[np.ndarray]
    width: int
    height: int

    def at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """(n, channels) at whole pixels: each level upsampled with its corners kept, one after the other, at unit length."""
        parts = []
        for level in self.levels:
            _, h, w = level.shape
            u, v = x * ((w - 1) / (self.width - 1)), y * ((h - 1) / (self.height - 1))
            i, j = np.minimum(u.astype(int), max(w - 2, 0)), np.minimum(v.astype(int), max(h - 2, 0))
            a, b = u - i, v - j
            right, below = np.minimum(i + 1, w - 1), np.minimum(j + 1, h - 1)
            parts.append((level[:, j, i] * (1 - a) + level[:, j, right] * a) * (1 - b) + (level[:, below, i] * (1 - a) + level[:, below, right] * a) * b)
        whole = np.concatenate(parts).T
        return whole / np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-12)

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """(n, channels) at any points, by the four pixels around; what lies outside counts as zero."""
        known = np.isfinite(x) & np.isfinite(y)
        x, y = np.where(known, x, -9.0), np.where(known, y, -9.0)
        left, top = np.floor(x), np.floor(y)
        out = np.zeros((len(x), sum(level.shape[0] for level in self.levels)))
        for du, wx in ((0, 1 - (x - left)), (1, x - left)):
            for dv, wy in ((0, 1 - (y - top)), (1, y - top)):
                i, j = left + du, top + dv
                inside = (i >= 0) & (j >= 0) & (i < self.width) & (j < self.height) & known
                if inside.any():
                    out[inside] += (wx * wy)[inside, None] * self.at(i[inside], j[inside])
        return out


def described(head: Head, levels: list[np.ndarray], width: int, height: int, keypoints: np.ndarray) -> np.ndarray:
    """(n, length) descriptors of unit length of (n, 2) keypoints."""
    if sum(level.shape[0] for level in levels) != head.channels or min(width, height) <= head.patch or any(level.shape[1] > height or level.shape[2] > width for level in levels):
        raise ValueError("the head doesn't fit the feature levels")
    points = np.clip(np.where(np.isfinite(keypoints), keypoints, 0.0), 0, [width - 1, height - 1])
    own = FeatureMap([np.asarray(level, dtype=float) for level in levels], width, height)
    parts = [_described(head, own, points[i : i + BLOCK]) for i in range(0, len(points), BLOCK)]
    return np.concatenate(parts) if parts else np.zeros((0, head.length))


def _described(head: Head, own: FeatureMap, points: np.ndarray) -> np.ndarray:
    k, n = head.patch, len(points)
    corner = [np.clip(np.trunc(np.trunc(points[:, i]) - k / 2 + 1), 0, size - 1 - k) for i, size in enumerate((own.width, own.height))]
    dy, dx = (a.ravel() for a in np.mgrid[:k, :k])
    around = own.at((corner[0][:, None] + dx).ravel(), (corner[1][:, None] + dy).ravel()).reshape(n, k * k, head.channels)
    patches = around.transpose(0, 2, 1).reshape(n, -1)  # channel, row, column
    most = max(own.width, own.height) / 4
    offsets = np.clip(selu(patches @ head.offsets.T + head.offsets_bias) @ head.second.T + head.second_bias, -most, most)
    p = head.positions
    x, y = points[:, :1] + offsets[:, :p], points[:, 1:] + offsets[:, p:]
    sampled = own.between(x.ravel(), y.ravel())
    out = selu(sampled @ head.samples.T).reshape(n, -1) @ head.aggregation
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
