"""Pictures of pairs: both photos side by side, their matches as lines, and a band in the verdict's colour."""

from __future__ import annotations

import numpy as np

from tessella.sources.images import preview

GAP, BAND = 16, 24
GOOD, WEAK, BAD = (70, 200, 110), (235, 190, 70), (225, 85, 75)
_GROUND = 26


def line(canvas: np.ndarray, a: np.ndarray, b: np.ndarray, colour: tuple[int, int, int], share: float = 1.0) -> None:
    """Draws from ``a`` to ``b`` (x, y), mixed with what is there."""
    steps = int(np.ceil(np.abs(b - a).max())) + 1
    x, y = (np.round(np.linspace(a[k], b[k], steps)).astype(int) for k in (0, 1))
    inside = (x >= 0) & (y >= 0) & (x < canvas.shape[1]) & (y < canvas.shape[0])
    at = y[inside], x[inside]
    canvas[at] = np.round(canvas[at] * (1 - share) + np.array(colour) * share).astype(np.uint8)


def pair_picture(photo_a: np.ndarray, photo_b: np.ndarray, matches: np.ndarray, inliers: np.ndarray, verdict: str, long_side: int = 900, show_outliers: bool = True) -> np.ndarray:
    """(height, width, 3) of 8 bits from photos of 8 bits and matches (ax, ay, bx, by), of which ``inliers`` is a mask."""
    small = [preview(p[..., :3] if p.shape[-1] >= 3 else np.repeat(p[..., :1], 3, axis=2), long_side) for p in (photo_a, photo_b)]
    width, height = small[0].shape[1] + GAP + small[1].shape[1], max(s.shape[0] for s in small) + BAND
    canvas = np.full((height, width, 3), _GROUND, np.uint8)
    canvas[:BAND] = GOOD if verdict == "verified" else WEAK if verdict in ("lowConfidence", "degenerateInliers", "modelMismatch") else BAD
    right = small[0].shape[1] + GAP
    for s, left in zip(small, (0, right), strict=True):
        canvas[BAND : BAND + s.shape[0], left : left + s.shape[1]] = s
    scale = [s.shape[1] / p.shape[1] for s, p in zip(small, (photo_a, photo_b), strict=True)]
    ends = [matches[:, :2] * scale[0] + [0, BAND], matches[:, 2:] * scale[1] + [right, BAND]]
    for kind, colour, share in ((False, BAD, 0.35), (True, GOOD, 0.8)):
        if kind or show_outliers:
            for i in np.flatnonzero(inliers == kind):
                line(canvas, ends[0][i], ends[1][i], colour, share)
    return canvas
