"""A hashed linear scorer: logistic regression over sets of hashed features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DIMENSIONS = 1 << 31  # of hashed features; a model holds weights for its telling ones only


@dataclass
class Linear:
    """Weights by feature number, and an offset. A text's features count equally, scaled to unit length."""

    weights: np.ndarray
    offset: float

    def logits(self, owner: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        """``features[k]`` belongs to text ``owner[k]`` of ``n``; each pair is given once."""
        size = np.bincount(owner, minlength=n)
        total = np.bincount(owner, weights=self.weights[features], minlength=n)
        return self.offset + total / np.sqrt(np.maximum(size, 1))

    def scores(self, owner: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        return sigmoid(self.logits(owner, features, n))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fit(rows: list[np.ndarray], targets: np.ndarray, start: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.5, decay: float = 1e-6, seed: int = 11) -> Linear:
    """AdaGrad over shuffled batches, from weights ``start``; ``targets`` are probabilities."""
    model = Linear(start.astype(np.float64), 0.0)
    if not len(rows):
        return model
    share = np.clip(targets.mean(), 1e-3, 1 - 1e-3)
    model.offset = float(np.log(share / (1 - share)))
    squares, offset_square = np.full(len(start), 1e-2), 1e-2
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            own = order[start : start + batch]
            sizes = np.array([len(rows[i]) for i in own])
            owner = np.repeat(np.arange(len(own)), sizes)
            features = np.concatenate([rows[i] for i in own]).astype(np.int64)
            error = (model.scores(owner, features, len(own)) - targets[own]) / len(own)
            spread = error / np.sqrt(np.maximum(sizes, 1))
            touched, at = np.unique(features, return_inverse=True)
            gradient = np.bincount(at, weights=spread[owner], minlength=len(touched)) + decay * model.weights[touched]
            squares[touched] += gradient**2 * len(own)
            model.weights[touched] -= rate * gradient * np.sqrt(len(own)) / np.sqrt(squares[touched])
            step = error.sum()
            offset_square += step**2 * len(own)
            model.offset -= rate * step * np.sqrt(len(own)) / np.sqrt(offset_square)
    return model


def telling(rows: list[np.ndarray], targets: np.ndarray, least_z: float, least_rows: float = 3, two_sided: bool = False) -> np.ndarray:
    """The features whose share of positive rows is far above the mean (or below, if two-sided)."""
    if not len(rows):
        return np.empty(0, dtype=np.int64)
    features, at = np.unique(np.concatenate(rows), return_inverse=True)
    total = np.bincount(at, minlength=len(features))
    positive = np.bincount(at, weights=np.repeat(targets, [len(r) for r in rows]), minlength=len(features))
    share = targets.mean()
    z = (positive - total * share) / np.sqrt(np.maximum(total * share * (1 - share), 1e-9))
    good = (z > least_z) & (positive >= least_rows)
    if two_sided:
        good |= (z < -least_z) & (total - positive >= least_rows)
    return features[good].astype(np.int64)


def restricted(rows: list[np.ndarray], features: np.ndarray) -> list[np.ndarray]:
    """Each row's positions in sorted ``features`` of those features that it has."""
    return [chosen(r, features)[1] for r in rows]


def chosen(values: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``values`` are in sorted ``features``, and where."""
    if not len(features):
        return np.zeros(len(values), dtype=bool), np.empty(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(features, values), len(features) - 1)
    hit = features[at] == values
    return hit, at[hit]
