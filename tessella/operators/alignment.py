"""Global alignment: one map per photo from the matches of many pairs.

The unknowns of one layout are few (photos times parameters) and live on the driver as numpy
arrays; what grows with the data, the matches, is reduced on the cluster to one block of normal
equations per pair, summed in pair order so that results don't depend on the number of tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.config import MODES
from tessella.functions import models
from tessella.functions.blocks import BlockSystem
from tessella.functions.columns import inverse, mapped, product, stretch
from tessella.operators.graph import grown_tree, inconsistent
from tessella.operators.ordering import numbered
from tessella.operators.problem import camera_homography
from tessella.operators.spread import Spread
from tessella.operators.verification import upper_median

HUBER = 2.0
PARAMETERS = {"translation": 2, "similarity": 4, "affine": 6}


@dataclass
class Layout:
    model: str
    anchor: int
    transforms: dict[int, np.ndarray]
    rms: float
    pair_rms: dict[tuple[int, int], float]
    left_out: list[tuple[tuple[int, int], str, float | None]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    misplaced: list[int] = field(default_factory=list)
    cameras: Cameras | None = None  # of a rotation layout


@dataclass
class Pair:
    """Matches of photos a and b: (n, 2) points in each, and a residual scale for each match."""

    a: int
    b: int
    pa: np.ndarray
    pb: np.ndarray
    sigma: np.ndarray


def problem(matches: DataFrame) -> list[Pair]:
    """The pairs of one layout from (a, b, idx, ax, ay, bx, by, sigma); each is capped by ``stratified``."""
    rows = matches.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("idx", "ax", "ay", "bx", "by", "sigma"))).alias("m")).orderBy("a", "b")
    out = []
    for r in rows.toLocalIterator():
        m = np.array([[x["ax"], x["ay"], x["bx"], x["by"], x["sigma"]] for x in r["m"]], dtype=float)
        out.append(Pair(r["a"], r["b"], m[:, :2], m[:, 2:4], m[:, 4]))
    return out


#: Up to so many matches are solved on the driver, more where they are, with the same result up to rounding.
MOST_ON_DRIVER = 200_000


class SpreadPairs:
    """The pairs of one layout whose matches stay on the cluster."""

    def __init__(self, matches: DataFrame):
        self.rows = Spread(matches, ["a", "b"], ["ax", "ay", "bx", "by", "sigma"])
        self.ends: list[tuple[int, int]] = self.rows.keys

    def each(self, work: Callable[[Pair], np.ndarray], combine: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
        ends = self.ends
        return self.rows.each(lambda k, m: work(Pair(*ends[k], m[:, :2], m[:, 2:4], m[:, 4])), combine)


def uncapped(matches: DataFrame) -> list[Pair] | SpreadPairs:
    """As ``problem`` for any number of matches. Turned cameras need the list."""
    return problem(matches) if matches.count() <= MOST_ON_DRIVER else SpreadPairs(matches)


def ends_of(pairs: list[Pair] | SpreadPairs) -> list[tuple[int, int]]:
    return pairs.ends if isinstance(pairs, SpreadPairs) else [(p.a, p.b) for p in pairs]


def each_pair(pairs: list[Pair] | SpreadPairs, work: Callable[[Pair], np.ndarray], combine: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> list[np.ndarray]:
    """``work`` of each pair, in order; where a pair's matches are spread, what its parts give is combined."""
    return pairs.each(work, combine) if isinstance(pairs, SpreadPairs) else [work(p) for p in pairs]


def _scale(pairs: list[Pair] | SpreadPairs) -> float:
    """The largest coordinate."""
    return max((float(v) for v in each_pair(pairs, lambda p: np.abs(p.pa).max(initial=0.0), np.maximum)), default=1.0) or 1.0


def _scaled(pair: Pair, scale: float) -> Pair:
    return Pair(pair.a, pair.b, pair.pa / scale, pair.pb / scale, pair.sigma / scale)


def connected(photos: list[int], pairs: list[Pair] | SpreadPairs) -> bool:
    return len(groups(photos, ends_of(pairs))) <= 1


def groups(photos: list[int], edges: list[tuple[int, int]]) -> list[list[int]]:
    """Connected groups of a photo graph, in order of their least members."""
    root = {p: p for p in photos}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    out: dict[int, list[int]] = {}
    for p in sorted(photos):
        out.setdefault(find(p), []).append(p)
    return [out[r] for r in sorted(out)]


def _basis(model: str, points: np.ndarray) -> np.ndarray:
    """(n, 2, parameters): the mapped point is this times the parameters (translation: plus the point)."""
    x, y = points[:, 0], points[:, 1]
    one, zero = np.ones(len(x)), np.zeros(len(x))
    if model == "translation":
        rows = [[one, zero], [zero, one]]
    elif model == "similarity":
        rows = [[x, -y, one, zero], [y, x, zero, one]]
    else:
        rows = [[x, y, one, zero, zero, zero], [zero, zero, zero, x, y, one]]
    return np.stack([np.stack(r, axis=1) for r in rows], axis=1)


def _matrix(model: str, v: np.ndarray) -> np.ndarray:
    if model == "translation":
        return np.array([[1, 0, v[0]], [0, 1, v[1]], [0, 0, 1.0]])
    if model == "similarity":
        return np.array([[v[0], -v[1], v[2]], [v[1], v[0], v[3]], [0, 0, 1.0]])
    return np.array([[v[0], v[1], v[2]], [v[3], v[4], v[5]], [0, 0, 1.0]])


def _identity(model: str) -> np.ndarray:
    return {"translation": np.zeros(2), "similarity": np.array([1.0, 0, 0, 0]), "affine": np.array([1.0, 0, 0, 0, 1, 0])}[model]


def pair_block(model: str, pair: Pair, xa: np.ndarray, xb: np.ndarray, robust: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pair's part of the normal equations at the given parameters, weighted by residual."""
    ja, jb = _basis(model, pair.pa), -_basis(model, pair.pb)
    j = np.concatenate([ja, jb], axis=2)
    r = j @ np.concatenate([xa, xb])
    if model == "translation":
        r = r + pair.pa - pair.pb
    s = np.sqrt((r**2).sum(axis=1)) / pair.sigma
    w = np.where(s <= HUBER, 1.0, HUBER / np.maximum(s, 1e-12)) if robust else np.ones(len(s))
    w = w / pair.sigma**2
    return np.einsum("n,nki,nkj->ij", w, j, j, optimize=True), np.einsum("n,nki,nk->i", w, j, r, optimize=True)


def solve_linear(model: str, photos: list[int], pairs: list[Pair] | SpreadPairs, anchor: int, rounds: int = 8) -> Layout:
    """Reweighted least squares for maps that are linear in their parameters; the anchor stays the identity."""
    if not connected(photos, pairs):
        raise ValueError("the photos don't hang together")
    scale = _scale(pairs)
    size, free = PARAMETERS[model], [p for p in photos if p != anchor]
    place = {p: i for i, p in enumerate(free)}
    x = {p: _identity(model) for p in photos}
    for turn in range(rounds):
        system = BlockSystem([size] * len(free))

        def block(p: Pair, x=x, robust=turn > 0) -> np.ndarray:
            return np.column_stack(pair_block(model, _scaled(p, scale), x[p.a], x[p.b], robust))

        for ends, sums in zip(ends_of(pairs), each_pair(pairs, block), strict=True):
            _add_pair(system, place, ends, (size, size), sums[:, :-1], sums[:, -1])
        extra = np.zeros(len(free) * size)
        if model != "translation":
            linear = [place[p] * size + i for p in free for i in ((0, 1) if model == "similarity" else (0, 1, 3, 4))]
            extra[linear] = 1e-9 * max(float(np.mean(system.diagonal())) if free else 0.0, 1e-12)
        step = system.solved_safely(extra)
        for p in free:
            x[p] = x[p] + step[place[p] * size : (place[p] + 1) * size]
        if not len(step) or np.abs(step).max() < 1e-9:
            break
    grow = np.diag([scale, scale, 1.0])
    transforms = {p: grow @ _matrix(model, v) @ np.linalg.inv(grow) for p, v in x.items()}
    return _layout(model, anchor, transforms, pairs)


def _add_pair(system: BlockSystem, place: dict, ends: tuple, sizes: tuple[int, ...], block: np.ndarray, side: np.ndarray) -> None:
    """Adds the normal equations of some unknowns, in order; those without a place are fixed."""
    at = np.concatenate(([0], np.cumsum(sizes)))
    for i, u in enumerate(ends):
        if u not in place:
            continue
        system.add_side(place[u], side[at[i] : at[i + 1]])
        for k, v in enumerate(ends):
            if v in place:
                system.add(place[u], place[v], block[at[i] : at[i + 1], at[k] : at[k + 1]])


def transfer(pair: Pair, ta: np.ndarray, tb: np.ndarray) -> np.ndarray:
    """Distances of the matches in the common plane; 1e6 where a point can't be mapped."""
    d = np.sqrt(((models.apply(ta, pair.pa) - models.apply(tb, pair.pb)) ** 2).sum(axis=1))
    return np.where(np.isfinite(d), d, 1e6)


def _layout(model: str, anchor: int, transforms: dict[int, np.ndarray], pairs: list[Pair] | SpreadPairs) -> Layout:
    def squares(p: Pair) -> np.ndarray:
        d = transfer(p, transforms[p.a], transforms[p.b])
        return np.array([len(d), (d**2).sum()])

    each = dict(zip(ends_of(pairs), each_pair(pairs, squares), strict=True))
    number, total = sum(each.values(), np.zeros(2))
    pair_rms = {k: float(np.sqrt(v / n)) if n else 0.0 for k, (n, v) in each.items()}
    return Layout(model, anchor, transforms, float(np.sqrt(total / number)) if number else 0.0, pair_rms)


def chained(photos: list[int], pairs: list[Pair] | SpreadPairs, anchor: int) -> dict[int, np.ndarray] | None:
    """Maps along the tree of most matches from the anchor, each by its pair's own map; None where one is missing."""
    ends, sizes = ends_of(pairs), each_pair(pairs, lambda p: np.array(float(len(p.pa))))
    maps = {k: h for k, h in enumerate(pair_maps(pairs)) if h is not None and np.isfinite(h).all() and abs(np.linalg.det(h)) > 1e-12}
    known = {anchor: np.eye(3)}
    for a, b in grown_tree([(*ends[k], float(sizes[k])) for k in maps], anchor):
        h = next(maps[k] for k in maps if ends[k] == (a, b))
        new = known[a] @ np.linalg.inv(h) if a in known else known[b] @ h
        if abs(new[2, 2]) < 1e-9:
            return None
        known[b if a in known else a] = new / new[2, 2]
    return known if len(known) == len(photos) else None


def solve_homography(photos: list[int], pairs: list[Pair] | SpreadPairs, anchor: int, rounds: int = 60, start: Layout | None = None) -> Layout:
    """Levenberg-Marquardt over eight parameters a photo, from the affine layout or the chained maps, whichever fits better.

    Residuals count in photo pixels: those in the plane are divided by how much the pair's maps stretch there, so that maps
    don't fit by shrinking.
    """
    start = start or solve_linear("affine", photos, pairs, anchor)
    scale = _scale(pairs)
    grow = np.diag([scale, scale, 1.0])
    sums = each_pair(pairs, lambda p: np.array([len(p.pa), *(p.pa / scale).sum(axis=0), *(p.pb / scale).sum(axis=0)]))
    middles = {k: (v[1:3] / v[0], v[3:5] / v[0]) for k, v in zip(ends_of(pairs), sums, strict=True)}
    free = [p for p in photos if p != anchor]
    place = {p: i for i, p in enumerate(free)}
    x = {p: (np.linalg.inv(grow) @ start.transforms[p] @ grow).ravel()[:8] for p in photos}

    def mapped(v, points):
        h = np.append(v, 1.0).reshape(3, 3)
        z = points @ h[2, :2] + h[2, 2]
        z = np.where(np.abs(z) < 1e-9, 1e-9, z)
        out = (points @ h[:2, :2].T + h[:2, 2]) / z[:, None]
        zero, one = np.zeros(len(z)), np.ones(len(z))
        row = np.column_stack([points, one]) / z[:, None]
        ju = np.column_stack([row, np.column_stack([zero] * 3), -out[:, :1] * row[:, :2]])
        jv = np.column_stack([np.column_stack([zero] * 3), row, -out[:, 1:] * row[:, :2]])
        return out, np.stack([ju, jv], axis=1)

    def stretched(values, p):
        """The stretch of the pair's maps at the middle of its matches."""
        out = []
        for v, middle in zip((values[p.a], values[p.b]), middles[p.a, p.b], strict=True):
            z, at = middle @ v[6:8] + 1.0, mapped(v, middle[None])[0][0]
            linear = (np.array([[v[0], v[1]], [v[3], v[4]]]) - np.outer(at, v[6:8])) / z
            out.append(np.sqrt(abs(np.linalg.det(linear))))
        return max(float(np.mean(out)), 1e-6)

    def cost(values):
        def own(p):
            p = _scaled(p, scale)
            r = np.sqrt(((mapped(values[p.a], p.pa)[0] - mapped(values[p.b], p.pb)[0]) ** 2).sum(axis=1)) / (p.sigma * stretched(values, p))
            return np.where(r <= HUBER, r * r, 2 * HUBER * r - HUBER**2).sum()

        return sum(map(float, each_pair(pairs, own)))

    def block(values):
        def own(p):
            p = _scaled(p, scale)
            (ua, ja), (ub, jb) = mapped(values[p.a], p.pa), mapped(values[p.b], p.pb)
            r = ua - ub
            sigma = p.sigma * stretched(values, p)
            s = np.sqrt((r**2).sum(axis=1)) / sigma
            w = np.where(s <= HUBER, 1.0, HUBER / np.maximum(s, 1e-12)) / sigma**2
            j = np.concatenate([ja, -jb], axis=2)
            return np.column_stack([np.einsum("n,nki,nkj->ij", w, j, j, optimize=True), np.einsum("n,nki,nk->i", w, j, r, optimize=True)])

        return own

    along = chained(photos, pairs, anchor)
    if along is not None:
        other = {p: (lambda t: (t / t[2, 2]).ravel()[:8])(np.linalg.inv(grow) @ along[p] @ grow) for p in photos}
        x = other if cost(other) < cost(x) else x
    now, damping = cost(x), 1e-3
    for _ in range(rounds):
        system = BlockSystem([8] * len(free))
        for ends, own in zip(ends_of(pairs), each_pair(pairs, block(x)), strict=True):
            _add_pair(system, place, ends, (8, 8), own[:, :-1], own[:, -1])
        before, better = now, False
        for _ in range(10):
            step = system.solved_safely(damping * (system.diagonal() + 1e-12))
            tried = {p: x[p] + step[8 * place[p] : 8 * place[p] + 8] if p != anchor else x[p] for p in photos}
            if (new := cost(tried)) < now:
                x, now, damping, better = tried, new, damping / 10, True
                break
            damping *= 10
        if not better or before - now < 1e-9 * max(before, 1e-12):
            break
    transforms = {p: grow @ np.append(v, 1.0).reshape(3, 3) @ np.linalg.inv(grow) for p, v in x.items()}
    return _layout("homography", anchor, transforms, pairs)


def rotation_matrix(w: np.ndarray) -> np.ndarray:
    """The rotation by the vector ``w``."""
    angle = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    if angle < 1e-12:
        return np.eye(3) + k
    return np.eye(3) + np.sin(angle) / angle * k + (1 - np.cos(angle)) / angle**2 * (k @ k)


@dataclass
class Cameras:
    """One focal length and a rotation per photo, about the photos' centres."""

    focal: float
    rotations: dict[int, np.ndarray]
    rms: float
    pair_rms: dict[tuple[int, int], float]
    method: int


def rays(points: np.ndarray, focal: float, centre: np.ndarray) -> np.ndarray:
    v = np.column_stack([points - centre, np.full(len(points), focal)])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


LEAST_VIEW, MOST_VIEW = 5.0, 150.0  # degrees that a photo's long side may see


def solve_rotation(photos: list[int], pairs: list[Pair], sizes: dict[int, tuple[float, float]], anchor: int, focal: float | None = None, rounds: int = 60) -> Cameras:
    """Rays of matched points are brought together over rotations and a common focal length.

    Without a prior the focal length starts from a field of view of 72 degrees. Pairs whose rays
    stay apart by more than three upper medians (two pixels at least) are left out once.
    """
    centre = {p: np.array(sizes[p]) / 2 for p in photos}
    usable = [Pair(p.a, p.b, p.pa[k], p.pb[k], p.sigma[k]) for p in pairs for k in [np.isfinite(p.pa).all(axis=1) & np.isfinite(p.pb).all(axis=1)] if k.any()]
    f = focal or float(np.mean([max(s) for s in sizes.values()])) / (2 * np.tan(np.radians(36)))
    best: Cameras | None = None
    for start in (f, 0.7 * f, 1.4 * f):
        got = _bundle(photos, usable, centre, anchor, start, rounds)
        if best is None or got.rms < best.rms - 1e-9:
            best = got
    each = np.concatenate([_apart(p, best, centre) for p in usable]) if usable else np.zeros(0)
    limit = max(3 * models.upper_median(each), 2.0) if len(each) else np.inf
    kept = [Pair(p.a, p.b, p.pa[k], p.pb[k], p.sigma[k]) for p in usable for k in [_apart(p, best, centre) <= limit] if k.sum() >= min(8, len(k))]
    removed = len(each) - sum(len(p.pa) for p in kept)
    if 0 < removed <= 0.3 * len(each) and connected(photos, kept):
        best = _bundle(photos, kept, centre, anchor, best.focal, rounds, best.rotations)
    best.pair_rms |= {(p.a, p.b): 0.0 for p in pairs if (p.a, p.b) not in best.pair_rms}
    view = np.degrees(2 * np.arctan(max(max(sizes[p]) for p in photos) / (2 * best.focal)))
    if not LEAST_VIEW * 1.2 < view < MOST_VIEW * 0.9:  # driven to the bound: the photos aren't views of turned cameras
        best.rms = float("inf")
    best.method = 0 if focal is None or 0.67 <= best.focal / focal <= 1.5 else 1
    return best


def _apart(pair: Pair, cameras: Cameras, centre: dict[int, np.ndarray]) -> np.ndarray:
    u = rays(pair.pa, cameras.focal, centre[pair.a]) @ cameras.rotations[pair.a].T
    v = rays(pair.pb, cameras.focal, centre[pair.b]) @ cameras.rotations[pair.b].T
    return np.linalg.norm(u - v, axis=1) * cameras.focal


def _bundle(photos, pairs, centre, anchor, focal, rounds, rotations=None) -> Cameras:
    free = [p for p in photos if p != anchor]
    place = {p: i for i, p in enumerate(free)} | {"focal": len(free)}
    turn = dict(rotations or _chained(photos, pairs, centre, anchor, focal))
    log_f = np.log(focal)

    def value(turn, log_f):
        cameras = Cameras(float(np.exp(log_f)), turn, 0, {}, 0)
        return sum(float(np.where(s <= HUBER, s * s, 2 * HUBER * s - HUBER**2).sum()) for p in pairs for s in [_apart(p, cameras, centre) / p.sigma])

    longest = 2 * max(float(c.max()) for c in centre.values())
    seen = lambda log_f: np.degrees(2 * np.arctan(longest / (2 * np.exp(log_f))))
    now, damping = value(turn, log_f), 1e-3
    for _ in range(rounds):
        f = float(np.exp(log_f))
        system = BlockSystem([3] * len(free) + [1])
        for p in pairs:
            u = rays(p.pa, f, centre[p.a]) @ turn[p.a].T
            v = rays(p.pb, f, centre[p.b]) @ turn[p.b].T
            r = (u - v) * f
            e = 1e-6
            moved = np.exp(log_f + e)
            jf = ((rays(p.pa, moved, centre[p.a]) @ turn[p.a].T - rays(p.pb, moved, centre[p.b]) @ turn[p.b].T) * moved - r) / e
            # a turn by w moves a ray by w x ray
            moves = [np.stack([np.cross(np.broadcast_to(axis, ray.shape), ray) for axis in np.eye(3)], axis=2) * sign * f for ray, sign in ((u, 1), (v, -1))]
            j = np.concatenate([jf[:, :, None], *moves], axis=2)
            s = np.linalg.norm(r, axis=1) / p.sigma
            w = np.where(s <= HUBER, 1.0, HUBER / np.maximum(s, 1e-12)) / p.sigma**2
            _add_pair(system, place, ("focal", p.a, p.b), (1, 3, 3), np.einsum("n,nki,nkj->ij", w, j, j, optimize=True), np.einsum("n,nki,nk->i", w, j, r, optimize=True))
        before, better = now, False
        for _ in range(10):
            step = system.solved_safely(damping * (system.diagonal() + 1e-12))
            tried = {p: rotation_matrix(step[3 * place[p] : 3 * place[p] + 3]) @ turn[p] if p != anchor else turn[p] for p in photos}
            # without a bound all rays come together as the focal length goes to nothing
            if LEAST_VIEW < seen(log_f + step[-1]) < MOST_VIEW and (new := value(tried, log_f + step[-1])) < now:
                turn, log_f, now, damping, better = tried, log_f + step[-1], new, damping / 10, True
                break
            damping *= 10
        if not better or before - now < 1e-10 * max(before, 1e-12):
            break
    out = Cameras(float(np.exp(log_f)), turn, 0.0, {}, 0)
    each = {(p.a, p.b): _apart(p, out, centre) for p in pairs}
    every = np.concatenate(list(each.values())) if each else np.zeros(1)
    out.rms = float(np.sqrt((every**2).mean()))
    out.pair_rms = {k: float(np.sqrt((v**2).mean())) for k, v in each.items()}
    return out


def _chained(photos, pairs, centre, anchor, focal) -> dict[int, np.ndarray]:
    """Rotations along the tree of most matches from the anchor; each from its pair's rays alone."""
    turn = {anchor: np.eye(3)}
    while len(turn) < len(photos):
        ways = [(len(p.pa), -i, p) for i, p in enumerate(pairs) if (p.a in turn) != (p.b in turn)]
        if not ways:
            return turn | {p: np.eye(3) for p in photos if p not in turn}
        _, _, p = max(ways, key=lambda w: w[:2])
        u, v = rays(p.pa, focal, centre[p.a]), rays(p.pb, focal, centre[p.b])
        known, new, x, y = (p.a, p.b, u, v) if p.a in turn else (p.b, p.a, v, u)
        left, _, right = np.linalg.svd((x @ turn[known].T).T @ y)
        turn[new] = left @ np.diag([1, 1, np.sign(np.linalg.det(left @ right))]) @ right
    return turn


def worst_stretch(layout: Layout, sizes: dict[int, tuple[float, float]]) -> dict[int, float]:
    """Per photo the corner scale furthest from 1, as a factor of at least 1."""
    out = {}
    for p, t in layout.transforms.items():
        w, h = sizes[p]
        corners = np.array([[0, 0], [w, 0], [w, h], [0, h]], float)
        scale = [np.sqrt(abs(np.linalg.det(np.column_stack([(models.apply(t, c + d) - models.apply(t, c - d))[0] for d in (np.array([[0.5, 0.0]]), np.array([[0.0, 0.5]]))])))) for c in corners[:, None, :]]
        scale = np.array(scale)
        out[p] = float(np.where(np.isfinite(scale) & (scale > 0), np.maximum(scale, 1 / np.maximum(scale, 1e-12)), np.inf).max())
    return out


def rotation_layout(photos: list[int], pairs: list[Pair], anchor: int, sizes: dict[int, tuple[float, float]], focal: float | None = None) -> Layout:
    """Turned cameras; the transforms are what they imply in the anchor's plane, where that can be seen."""
    cameras = solve_rotation(photos, pairs, sizes, anchor, focal)
    centre = {p: np.array(sizes[p]) / 2 for p in photos}
    maps = {p: camera_homography(cameras.focal, cameras.rotations[p], centre[p], cameras.focal, cameras.rotations[anchor], centre[anchor]) for p in photos}
    return Layout("rotation", anchor, maps, cameras.rms, dict(cameras.pair_rms), cameras=cameras)


class Solves:
    """The layouts of some pairs by kind of map, each solved once."""

    def __init__(self, sizes: dict[int, tuple[float, float]] | None = None, focal: float | None = None):
        self.sizes, self.focal = sizes, focal
        self.known: dict[tuple, Layout] = {}

    def get(self, kind: str, photos: list[int], pairs: list[Pair] | SpreadPairs, anchor: int) -> Layout:
        key = (kind, anchor, tuple(photos), tuple(pairs.ends if isinstance(pairs, SpreadPairs) else ((p.a, p.b, len(p.pa)) for p in pairs)))
        if key not in self.known:
            if kind == "rotation":
                self.known[key] = rotation_layout(photos, pairs, anchor, self.sizes, self.focal)
            elif kind == "homography":
                self.known[key] = solve_homography(photos, pairs, anchor, start=self.get("affine", photos, pairs, anchor))
            else:
                self.known[key] = solve_linear(kind, photos, pairs, anchor)
        found = self.known[key]
        return replace(found, pair_rms=dict(found.pair_rms), left_out=[], notes=[], misplaced=[])


ROTATION_PHOTOS = 60  # above so many, automatic mode tries turned cameras on a part of them first
ROTATION_TRIAL = 40


def choose(photos: list[int], pairs: list[Pair] | SpreadPairs, anchor: int, sizes: dict[int, tuple[float, float]] | None = None, mode: str = "automatic", solves: Solves | None = None) -> Layout:
    """The simplest kind of map of the mode that explains the matches nearly as well as the best.

    ``plane`` has no perspective, ``document`` no turned cameras, ``rotation`` these alone.
    """
    solves = solves or Solves(sizes)
    get = lambda kind: solves.get(kind, photos, pairs, anchor)
    if mode == "rotation":
        return get("rotation")
    translation = get("translation")
    if translation.rms <= 0.5:
        return translation
    similarity = get("similarity")
    if similarity.rms <= 0.5 and translation.rms > 1.25 * similarity.rms + 0.5:
        return similarity
    affine = get("affine")
    planar = (translation, similarity, affine)
    if mode == "plane":
        within = 1.25 * min(k.rms for k in planar) + 0.5
        return next(k for k in planar if k.rms <= within)
    document = get("homography")
    every = [*planar, document]
    turned = None
    if mode == "automatic" and sizes is not None and affine.rms > 1.25 * document.rms + 0.5 and _turns(photos, pairs, anchor, solves, document.rms):
        turned = get("rotation")
        every.append(turned)
    within = 1.25 * min(k.rms for k in every) + 0.5
    stretched = sizes is not None and max(worst_stretch(document, sizes).values()) > OVERSTRETCHED
    earned = not stretched and document.rms < 0.5 * min(k.rms for k in planar)
    for kind in (translation, similarity):
        if kind.rms <= within:
            return kind
    if affine.rms <= within:
        return affine
    if turned is not None and turned.rms <= within:  # three numbers a photo instead of eight
        return turned
    return document if earned else affine


def _turns(photos: list[int], pairs: list[Pair], anchor: int, solves: Solves, within: float) -> bool:
    """Whether turned cameras are worth a solve of all photos: they fit the ones around the anchor."""
    if len(photos) <= ROTATION_PHOTOS:
        return True
    near, front = [anchor], [anchor]
    links: dict[int, list[tuple[int, int]]] = {}
    for p in pairs:
        links.setdefault(p.a, []).append((-len(p.pa), p.b))
        links.setdefault(p.b, []).append((-len(p.pa), p.a))
    while front and len(near) < ROTATION_TRIAL:
        new = [b for a in front for _, b in sorted(links.get(a, [])) if b not in near]
        front = list(dict.fromkeys(new))[: ROTATION_TRIAL - len(near)]
        near += front
    some = set(near)
    trial = solves.get("rotation", sorted(near), [p for p in pairs if p.a in some and p.b in some], anchor)
    return trial.rms <= 2 * within + 1.0


OVERSTRETCHED = 4.0


def without_misplaced(layout: Layout, photos: list[int], pairs: list[Pair], anchor: int, mode: str, solves: Solves, least_photos: int = 40, most_share: float = 0.05) -> tuple[Layout, list[int]]:
    """The layout without the few photos that keep perspective from being earned, where that is the case; and these photos."""
    if mode not in ("automatic", "document") or solves.sizes is None or len(photos) < least_photos or layout.model not in ("affine",):
        return layout, []
    document = solves.get("homography", photos, pairs, anchor)
    off = [p for p, s in worst_stretch(document, solves.sizes).items() if s > OVERSTRETCHED]
    if not off or anchor in off or len(off) > most_share * len(photos):
        return layout, []
    rest = [p for p in photos if p not in off]
    kept = [p for p in pairs if p.a not in off and p.b not in off]
    if not connected(rest, kept):
        return layout, []
    trial = choose(rest, kept, anchor, solves.sizes, mode, solves)
    return (trial, sorted(off)) if trial.model == "homography" else (layout, [])


def focal_of(h: np.ndarray, centre_a: np.ndarray, centre_b: np.ndarray) -> float | None:
    """The focal length that a turning camera's map between two photos implies, if it does.

    About the photos' middles the map is K R / K; the first two rows of R are of equal length and at a right angle, which
    gives the square of the focal length twice; the better conditioned one counts.
    """
    to = lambda c: np.array([[1, 0, c[0]], [0, 1, c[1]], [0, 0, 1.0]])
    m = np.linalg.inv(to(centre_b)) @ h @ to(centre_a)
    p, q = m[0], m[1]
    below = np.array([p[0] * q[0] + p[1] * q[1], p[0] ** 2 + p[1] ** 2 - q[0] ** 2 - q[1] ** 2])
    above = np.array([-p[2] * q[2], q[2] ** 2 - p[2] ** 2])
    k = int(np.argmax(np.abs(below)))
    square = above[k] / below[k] if abs(below[k]) > 1e-12 else -1.0
    return float(np.sqrt(square)) if np.isfinite(square) and square > 0 else None


def focal_from_pairs(pairs: list[Pair], sizes: dict[int, tuple[float, float]]) -> float | None:
    """The upper median of the focal lengths that pairs imply and that see more than 5 and less than 150 degrees."""
    found = []
    for p in pairs:
        h = pair_map(p)
        f = focal_of(h, np.array(sizes[p.a]) / 2, np.array(sizes[p.b]) / 2) if h is not None and np.isfinite(h).all() else None
        if f and LEAST_VIEW < np.degrees(2 * np.arctan(max(sizes[p.a]) / (2 * f))) < MOST_VIEW:
            found.append(f)
    return models.upper_median(np.array(found)) if found else None


def offenders(layout: Layout, thresholds: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """Pairs off by more than three medians, their threshold, and half of the worst; worst first."""
    if not layout.pair_rms:
        return []
    values = np.array(list(layout.pair_rms.values()))
    middle, worst = models.upper_median(values), values.max()
    out = [k for k, v in layout.pair_rms.items() if v > max(3 * middle, thresholds.get(k, 3.0), worst / 2)]
    return sorted(out, key=lambda k: (-layout.pair_rms[k], k))


def pair_map(pair: Pair) -> np.ndarray | None:
    """From photo a to photo b, by the pair's own matches."""
    for kind, least in (("homography", 8), ("similarity", 2)):
        if len(pair.pa) >= least and (h := models.least_squares(kind, pair.pa, pair.pb, 1 / pair.sigma**2)) is not None:
            return h
    return None


def pair_maps(pairs: list[Pair] | SpreadPairs) -> list[np.ndarray | None]:
    """``pair_map`` of each pair."""
    if not isinstance(pairs, SpreadPairs):
        return [pair_map(p) for p in pairs]
    number = each_pair(pairs, lambda p: np.array([len(p.pa), *p.pa.sum(axis=0), *p.pb.sum(axis=0)]))
    centre = {k: (v[1:3] / v[0], v[3:5] / v[0]) for k, v in zip(pairs.ends, number, strict=True)}
    apart = each_pair(pairs, lambda p: np.array([np.linalg.norm(q - c, axis=1).sum() for q, c in zip((p.pa, p.pb), centre[p.a, p.b], strict=True)]))
    normal = {k: [models.normaliser(c, d / n[0]) for c, d in zip(centre[k], own, strict=True)] for k, own, n in zip(pairs.ends, apart, number, strict=True)}
    both = lambda u, v: models.triangle(np.concatenate([u, v]))
    rows = each_pair(pairs, lambda p: models.triangle(models.transform_rows(p.pa, p.pb, 1 / p.sigma**2, *normal[p.a, p.b])), both)
    maps = [models.homography_of(r, *normal[k]) if n[0] >= 8 else None for k, r, n in zip(pairs.ends, rows, number, strict=True)]
    if any(h is None for h in maps):  # a similarity, from as few rows with the same least squares

        def similar(p: Pair) -> np.ndarray:
            j = np.concatenate([_basis("similarity", p.pa), p.pb[:, :, None]], axis=2) / p.sigma[:, None, None]
            return models.triangle(j.reshape(-1, 5))

        for k, (r, n) in enumerate(zip(each_pair(pairs, similar, both), number, strict=True)):
            if maps[k] is None and n[0] >= 2 and np.linalg.matrix_rank(r[:, :4]) == 4:
                maps[k] = _matrix("similarity", np.linalg.lstsq(r[:, :4], r[:, 4], rcond=None)[0])
    return maps


def loops(pairs: list[Pair], threshold: float = 3.0) -> list[tuple[int, int, int, bool]]:
    """All triangles i < j < k of pairs, and whether one of the three ways round them closes.

    A way round closes if the upper median of its error is within eight thresholds.
    """
    known = {(p.a, p.b): (p, h) for p in pairs if (h := pair_map(p)) is not None}
    step = {k: h for k, (_, h) in known.items()}
    step |= {(b, a): np.linalg.pinv(h) for (a, b), h in list(step.items())}
    near: dict[int, set[int]] = {}
    for a, b in known:
        near.setdefault(a, set()).add(b)
    out = []
    for i, j in sorted(known):
        for k in sorted(near.get(i, set()) & near.get(j, set())):
            ways = []
            for a, b, via in ((i, j, k), (j, k, i), (i, k, j)):
                pair = known[(a, b)][0]
                around = models.apply(step[(via, b)] @ step[(a, via)], pair.pa)
                ways.append(models.upper_median(np.nan_to_num(np.linalg.norm(around - pair.pb, axis=1), nan=1e9)))
            out.append((i, j, k, min(ways) <= 8 * threshold))
    return out


class Cancelled(Exception):
    """The caller no longer wants the layout."""


def align(
    photos: list[int], pairs: list[Pair], anchor: int, thresholds: dict[tuple[int, int], float] | None = None, sizes: dict[int, tuple[float, float]] | None = None,
    mode: str = "automatic", focal: float | None = None, cancelled: Callable[[], bool] = lambda: False,
) -> Layout:
    """Leave out pairs that break loops, choose a model, leave out misplaced photos, then pairs that are far off.

    Photos that a removal cuts off the anchor's group are noted and not placed. ``focal`` is a prior for turned cameras.
    """
    thresholds = thresholds or {}
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if anchor not in photos or any(p.a not in photos or p.b not in photos or p.a == p.b for p in pairs):
        raise ValueError("the anchor or a pair names a photo that isn't there")
    if mode == "rotation" and sizes is None:
        raise ValueError("turned cameras need the photos' sizes")
    solves = Solves(sizes, focal)
    broken = inconsistent([(p.a, p.b) for p in pairs], loops(pairs, max(thresholds.values(), default=3.0)))
    out: list[tuple[tuple[int, int], str, float | None]] = [(k, "brokenLoops", None) for k in broken]
    pairs = [p for p in pairs if (p.a, p.b) not in broken]
    group = next(g for g in groups(photos, [(p.a, p.b) for p in pairs]) if anchor in g)
    lost, photos = [p for p in photos if p not in group], group
    pairs = [p for p in pairs if p.a in group and p.b in group]
    layout = choose(photos, pairs, anchor, sizes, mode, solves)
    layout, misplaced = without_misplaced(layout, photos, pairs, anchor, mode, solves)
    if misplaced:
        photos = [p for p in photos if p not in misplaced]
        pairs = [p for p in pairs if p.a not in misplaced and p.b not in misplaced]
    first = len(out)
    limit = max(2, (len(pairs) - (len(photos) - 1)) // 4)
    while len(out) - first < limit and len(pairs) >= len(photos):
        if cancelled():
            raise Cancelled
        gone = next((k for k in offenders(layout, thresholds) if connected(photos, [p for p in pairs if (p.a, p.b) != k])), None)
        if gone is None:
            break
        out.append((gone, "offBy", layout.pair_rms[gone]))
        pairs = [p for p in pairs if (p.a, p.b) != gone]
        layout = choose(photos, pairs, anchor, sizes, mode, solves)
    layout.left_out, layout.misplaced = out, misplaced
    if misplaced:
        layout.notes.append(f"{len(misplaced)} photos are misplaced")
    if lost:
        layout.notes.append(f"{len(lost)} photos hang on inconsistent pairs alone")
    return layout


def _basis_columns(model: str, x: Column, y: Column) -> tuple[list[Column], list[Column]]:
    """The rows of ``_basis`` as columns."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return {
        "translation": ([one, zero], [zero, one]),
        "similarity": ([x, -y, one, zero], [y, x, zero, one]),
        "affine": ([x, y, one, zero, zero, zero], [zero, zero, zero, x, y, one]),
    }[model]


def normal_blocks(matches: DataFrame, model: str) -> DataFrame:
    """(a, b, block, side): each pair's normal equations at the identity, as sums where its matches are."""
    ua, va = _basis_columns(model, F.col("ax"), F.col("ay"))
    ub, vb = _basis_columns(model, F.col("bx"), F.col("by"))
    u, v = [*ua, *(-x for x in ub)], [*va, *(-x for x in vb)]
    weight, n = 1 / (F.col("sigma") * F.col("sigma")), len(u)
    ru, rv = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    upper = {(i, j): F.sum(weight * (u[i] * u[j] + v[i] * v[j])) for i in range(n) for j in range(i, n)}
    side = F.array(*(F.sum(weight * (u[i] * ru + v[i] * rv)) for i in range(n)))
    return matches.groupBy("a", "b").agg(F.array(*(upper[min(i, j), max(i, j)] for i in range(n) for j in range(n))).alias("block"), side.alias("side"))


def best_anchors(maps: DataFrame, group: str = "project") -> DataFrame:
    """(group, anchor, worst): of each project's photos the one from which the worst stretch of any photo's corner is least.

    ``maps``: group, image, width, height, transform. Photos meet within their project only.
    """
    anchors = maps.select(group, F.col("image").alias("anchor"), inverse(F.col("transform")).alias("back"))
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    seen = maps.join(anchors, group).select(group, "anchor", "image", "width", "height", product(F.col("back"), F.col("transform")).alias("t"), corner.alias("k"))
    s = stretch(F.col("t"), (F.col("k.i") * F.col("width")).cast("double"), (F.col("k.j") * F.col("height")).cast("double"))
    worst = seen.groupBy(group, "anchor").agg(F.max(F.coalesce(F.greatest(s, 1 / s), F.lit(1e9))).alias("worst"))
    rounded = worst.withColumn("worst", F.round("worst", 4))
    return rounded.groupBy(group).agg(F.min(F.struct("worst", "anchor")).alias("best")).select(group, "best.anchor", "best.worst")


def transfer_rms(matches: DataFrame, layout: DataFrame) -> DataFrame:
    """(a, b, n, rms) of matches through the maps (image, transform) of their photos; 1e6 for points behind."""
    rows = matches.join(layout.toDF("a", "ta"), "a").join(layout.toDF("b", "tb"), "b")
    xa, ya = mapped(F.col("ta"), F.col("ax"), F.col("ay"))
    xb, yb = mapped(F.col("tb"), F.col("bx"), F.col("by"))
    square = F.coalesce((xa - xb) * (xa - xb) + (ya - yb) * (ya - yb), F.lit(1e12))
    return rows.withColumn("square", square).groupBy("a", "b").agg(F.count("*").alias("n"), F.sqrt(F.sum("square") / F.count("*")).alias("rms"))


def grows_with_distance(pairs: DataFrame, least: int = 12, ratio: float = 1.5) -> DataFrame:
    """One row: whether the upper-median error of the furthest third of pairs is well above the nearest's."""
    placed = numbered(pairs, [F.col("distance"), F.col("a"), F.col("b")], "turn")
    number = placed.agg(F.count("*").alias("number"))  # one row
    third = F.floor(F.col("number") / 3)
    rows = placed.join(F.broadcast(number)).select(F.when(F.col("turn") < third, F.col("rms")).alias("near"), F.when(F.col("turn") >= F.col("number") - third, F.col("rms")).alias("far"))
    got = rows.agg(F.count("*").alias("pairs"), F.count("near").alias("n"), upper_median("near").alias("near"), upper_median("far").alias("far"))
    enough = (F.col("pairs") >= least) & (F.col("n") >= 4)
    return got.select("pairs", F.coalesce(F.when(enough, F.col("far") >= ratio * F.col("near")), F.lit(False)).alias("grows"))


def expected_seconds(model: Column, matches: Column) -> Column:
    """The cost model of a planar solve, in seconds; fixed values per match."""
    per = {"translation": 3.4e-8, "similarity": 5.4e-8, "affine": 7.8e-8, "homography": 7.2e-7}
    return F.element_at(F.create_map(*(F.lit(x) for kv in per.items() for x in kv)), model) * matches


def rows_of(layout: Layout) -> Iterator[tuple[int, list[float]]]:
    return ((p, t.ravel().tolist()) for p, t in sorted(layout.transforms.items()))
