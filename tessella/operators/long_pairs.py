"""Fits and measures of pairs of photos with more matches than one task should hold."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.config import Analysis
from tessella.functions import models, polygons
from tessella.functions.columns import finite
from tessella.operators.spread import Spread
from tessella.runtime import stored

VALUES = ["ax", "ay", "bx", "by"]
_BUCKETS = 1 << 14
_FEW = 1 << 16  # residuals of a pair that come to the driver
_MOST_DRAWS = 1 << 10  # of a pair and model, scored in one pass
_ROWS, _MAPS = 2048, 32  # of a block that stays in a core's cache

Fits = list[dict[str, models.Fit]]


class LongPairs:
    """Matches (idx, ax, ay, bx, by) of some pairs (a, b, source), kept on the cluster.

    One table has them in the order of idx, from which draws are taken by their places; in another
    equal matches of a pair are one row with their number (n), over which sums are made.
    """

    def __init__(self, matches: DataFrame, keys: Sequence[tuple]):
        spark, names = matches.sparkSession, ["a", "b", "source"]
        types = ", ".join(f"{k} {matches.schema[k].dataType.simpleString()}" for k in names)
        numbers = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], f"{types}, _key int")
        same = [F.col(f"m.{k}").eqNullSafe(F.col(f"k.{k}")) for k in names]
        value = {v: F.coalesce(F.col(f"m.{v}").cast("double"), F.lit(float("nan"))) for v in VALUES}
        rows = matches.alias("m").join(F.broadcast(numbers.alias("k")), same).select("_key", "idx", *(c.alias(v) for v, c in value.items()))  # the keys, which the driver holds too
        usable = finite(F.col("ax")) & finite(F.col("ay")) & finite(F.col("bx")) & finite(F.col("by"))
        first = F.shiftleft(F.col("_key").cast("long"), 33) + F.shiftleft((~usable).cast("long"), 32) + F.col("idx") + (1 << 31)  # one number sorts faster than three columns
        order = ["_first", *VALUES]
        dealt = rows.withColumn("_first", first).repartitionByRange(*order).sortWithinPartitions(*order)
        self.placed = stored(dealt.drop("_first").withColumn("_at", F.monotonically_increasing_id()))
        parts = self.placed.groupBy("_key", F.shiftright("_at", 33).alias("part")).agg(F.min("_at").alias("first"), F.count_if(usable).alias("usable")).orderBy("_key", "part").collect()
        own = [[r for r in parts if r["_key"] == k] for k in range(len(keys))]
        self.firsts = [np.array([r["first"] for r in o], np.int64) for o in own]
        self.upto = [np.cumsum([r["usable"] for r in o]) for o in own]
        once = self.placed.groupBy("_key", *VALUES).agg(F.count("*").cast("double").alias("n")).sortWithinPartitions("_key")
        self.spread = Spread.of(list(keys), stored(once))

    def points_at(self, ranks: list[np.ndarray]) -> list[np.ndarray]:
        """For each pair its usable matches (ax, ay, bx, by) at some places in the order of idx."""
        places = []
        for first, upto, own in zip(self.firsts, self.upto, ranks, strict=True):
            part = np.searchsorted(upto, own, side="right")
            places.append(first[part] + own - np.concatenate(([0], upto))[part])
        wanted = self.placed.sparkSession.createDataFrame(pa.table({"_at": np.unique(np.concatenate(places))}))
        got = self.placed.join(F.broadcast(wanted), "_at").select("_at", *VALUES).toArrow().sort_by("_at")  # as many rows as draws
        at, values = got["_at"].to_numpy(), np.column_stack([got[v].to_numpy() for v in VALUES])
        return [values[np.searchsorted(at, own)] for own in places]

    def fits(self, kinds: Sequence[str], limits: list[float], config: Analysis) -> Fits:
        """``models.fit`` of each kind, by the same draws; a fit's inliers are a range of their number."""
        number = [int(u[-1]) for u in self.upto]
        tasks = [(k, kind) for k in range(len(number)) for kind in kinds if number[k] >= models.SAMPLE[kind]]
        draws = {t: np.random.default_rng(config.seed) for t in tasks}
        best: dict[tuple[int, str], np.ndarray] = {}
        cost, done, needed = dict.fromkeys(tasks, np.inf), dict.fromkeys(tasks, 0), dict.fromkeys(tasks, config.max_iterations)
        left = lambda t: min(needed[t], config.max_iterations) - done[t]
        batch, frames = 32, [None] * len(number)
        while going := [t for t in tasks if left(t) > 0]:
            most = min(batch, max(16, (1 << 16) // len(going)))
            ranks = {t: np.stack([draws[t].choice(number[t[0]], models.SAMPLE[t[1]], replace=False) for _ in range(min(most, left(t)))]) for t in going}
            of = [[t for t in going if t[0] == k] for k in range(len(number))]
            points = self.points_at([np.concatenate([np.empty(0, np.int64), *(ranks[t].ravel() for t in own)]) for own in of])
            frames = [f or _frame(p) if len(p) else f for f, p in zip(frames, points, strict=True)]
            maps: list[np.ndarray] = []
            drawn: dict[tuple[int, str], list[int | None]] = {}
            for own, p in zip(of, points, strict=True):
                found, at = [], 0
                for t in own:
                    drawn[t] = []
                    for _ in range(len(ranks[t])):
                        m, at = p[at : at + models.SAMPLE[t[1]]], at + models.SAMPLE[t[1]]
                        h = models.least_squares(t[1], m[:, :2], m[:, 2:])
                        usable = h is not None and np.isfinite(h).all()
                        drawn[t].append(len(found) if usable else None)
                        found += [h] if usable else []
                maps.append(np.array(found).reshape(-1, 3, 3))
            sums = self.spread.each(lambda k, m, maps=maps: scores(maps[k], _usable(m), limits[k]), np.add)
            for t in going:
                for i in drawn[t]:
                    if left(t) <= 0:
                        break
                    done[t] += 1
                    if i is not None and sums[t[0]][i, 0] < cost[t]:
                        best[t], cost[t] = maps[t[0]][i], sums[t[0]][i, 0]
                        needed[t] = models.draws_needed(sums[t[0]][i, 1] / number[t[0]], models.SAMPLE[t[1]], config.confidence, needed[t])
            batch = min(4 * batch, _MOST_DRAWS)
        facts = self._refitted(best, frames, limits)
        return [{kind: models.Fit(kind, best[k, kind], range(int(f[1])), float(np.sqrt(f[2] / f[1])), float("nan")) for kind in kinds if (f := facts.get((k, kind))) is not None and f[1] >= models.SAMPLE[kind]} for k in range(len(number))]

    def _refitted(self, best: dict, frames: list, limits: list[float]) -> dict:
        """Refits of the best maps on their inliers, in place; (cost, inliers, sum of squares) of each."""
        facts, triangles = {}, {}
        for t, (f, *rows) in self._sums(best, frames, limits).items():
            facts[t], triangles[t] = f, rows
        going = set(best)
        for _ in range(10):
            going = {t for t in going if facts[t][1] >= models.SAMPLE[t[1]]}
            if not going:
                break
            apart = self._apart({t: (best[t], *_centres(triangles[t][0], frames[t[0]])) for t in going if t[1] == "homography"}, limits)
            new = {t: _solved(t[1], facts[t][1], triangles[t], frames[t[0]], apart.get(t)) for t in going}
            new = {t: h for t, h in new.items() if h is not None and np.isfinite(h).all()}
            got = self._sums(new, frames, limits) if new else {}
            going = {t for t in new if got[t][0][0] < facts[t][0] - 1e-12}
            for t in going:
                best[t], facts[t], triangles[t] = new[t], got[t][0], got[t][1:]
        return facts

    def _sums(self, maps: dict, frames: list, limits: list[float]) -> dict:
        """For each map (cost, inliers, sum of squares) and what a refit on its inliers needs."""
        kinds = [[kind for i, kind in maps if i == k] for k in range(len(limits))]

        def own(k: int, m: np.ndarray) -> list[list[np.ndarray]]:
            m, out = _usable(m), []
            for kind in kinds[k]:
                r = models.residuals(maps[k, kind], m[:, :2], m[:, 2:4])
                inside = r < limits[k]
                a, b, n = m[inside, :2], m[inside, 2:4], m[inside, 4]
                ta, tb = frames[k]
                lines = np.column_stack([np.ones(len(a)), models.apply(ta, a), models.apply(tb, b)]) * np.sqrt(n)[:, None]
                facts = np.array([m[:, 4] @ np.minimum(r, limits[k]) ** 2, n.sum(), n @ r[inside] ** 2])
                out.append([facts, models.triangle(lines), *([models.triangle(models.transform_rows(a, b, n, ta, tb))] if kind == "homography" else [])])
            return out

        def both(u, v):
            return [[x[0] + y[0], *(models.triangle(np.concatenate(rows)) for rows in zip(x[1:], y[1:], strict=True))] for x, y in zip(u, v, strict=True)]

        got = self.spread.each(own, both)
        return {(k, kind): x for k, of in enumerate(kinds) for kind, x in zip(of, got[k], strict=True)}

    def _apart(self, asked: dict, limits: list[float]) -> dict:
        """The mean distances of a homography's inliers from their centres, in either photo."""
        if not asked:
            return {}
        of = [[t for t in asked if t[0] == k] for k in range(len(limits))]

        def own(k: int, m: np.ndarray) -> np.ndarray:
            m, out = _usable(m), np.zeros((len(of[k]), 3))
            for i, t in enumerate(of[k]):
                h, ca, cb = asked[t]
                near = m[models.residuals(h, m[:, :2], m[:, 2:4]) < limits[k]]
                out[i] = near[:, 4] @ np.column_stack([np.ones(len(near)), *(np.sqrt(((p - c) ** 2).sum(axis=1)) for p, c in ((near[:, :2], ca), (near[:, 2:4], cb)))])
            return out

        got = self.spread.each(own, np.add)
        return {t: row[1:] / row[0] for k in range(len(limits)) for t, row in zip(of[k], got[k], strict=True)}

    def measures(self, chosen: dict[int, np.ndarray], regions: dict[int, np.ndarray], limits: list[float]) -> dict[int, tuple[float, int, float, float]]:
        """For each chosen map (median error, matches in the region, inliers' hull without its corners, coverage)."""
        ends = {k: (0.0, limits[k]) for k in chosen}

        def bucket(k: int, r: np.ndarray) -> np.ndarray:
            low, high = ends[k]
            return np.clip(np.floor((r - low) / (high - low) * _BUCKETS), -1, _BUCKETS).astype(int)

        def inliers(k: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            m = _usable(m)
            r = models.residuals(chosen[k], m[:, :2], m[:, 2:4])
            return m[r < limits[k]], r[r < limits[k]]

        def counts(k: int, r: np.ndarray, n: np.ndarray) -> np.ndarray:
            """Below, in each bucket, above."""
            return np.bincount(bucket(k, r) + 1, n, _BUCKETS + 2)

        def first(k: int, m: np.ndarray) -> list:
            if k not in chosen:
                return []
            near, r = inliers(k, m)
            region = regions[k]
            inside = m[polygons.within(region, m[:, :2]), 4].sum() if len(region) else 0.0
            return [counts(k, r, near[:, 4]), inside, polygons.corners(near[:, :2]), polygons.taken(near[:, :2], region) if len(region) else set()]

        def joined(u: list, v: list) -> list:
            return [u[0] + v[0], u[1] + v[1], polygons.corners(np.concatenate([u[2], v[2]])), u[3] | v[3]] if u else []

        facts = self.spread.each(first, joined)
        filled = {k: facts[k][0] for k in chosen}
        half = {k: filled[k].sum() // 2 for k in chosen}  # the upper of two in the middle
        for turn in range(4):
            middle = {k: int(np.searchsorted(np.cumsum(filled[k]), half[k], side="right")) - 1 for k in chosen}
            if turn == 3 or all(filled[k][middle[k] + 1] <= _FEW for k in chosen):
                break
            ends.update({k: (low + (high - low) * middle[k] / _BUCKETS, low + (high - low) * (middle[k] + 1) / _BUCKETS) for k, (low, high) in ends.items() if high - low > 1e-9 * limits[k]})
            filled = dict(enumerate(self.spread.each(lambda k, m: (lambda near, r: counts(k, r, near[:, 4]))(*inliers(k, m)) if k in chosen else np.zeros(1), np.add)))
        outer = {k: facts[k][2] for k in chosen}

        def second(k: int, m: np.ndarray) -> list:
            if k not in chosen:
                return []
            near, r = inliers(k, m)
            around = np.column_stack([r, near[:, 4]])[bucket(k, r) == middle[k]]
            place, corner = near[:, 0] + 1j * near[:, 1], outer[k][:, 0] + 1j * outer[k][:, 1]
            on = np.isin(place, corner)
            copies = np.array([near[on, 4][place[on] == c].sum() for c in corner])
            return [_summed(around), polygons.corners(near[~on, :2]), copies]

        def joined_again(u: list, v: list) -> list:
            return [_summed(np.concatenate([u[0], v[0]])), polygons.corners(np.concatenate([u[1], v[1]])), u[2] + v[2]] if u else []

        more, out = self.spread.each(second, joined_again), {}
        for k in chosen:
            around, rest, copies = more[k]
            below = filled[k][: middle[k] + 1].sum()
            median = float(around[np.searchsorted(np.cumsum(around[:, 1]), half[k] - below, side="right"), 0])
            hull = polygons.hull_area(np.concatenate([rest, outer[k][copies > 1]]))
            out[k] = median, int(facts[k][1]), hull, polygons.coverage_of(facts[k][3], regions[k]) if len(regions[k]) else 0.0
        return out

    def inliers(self, chosen: dict[int, np.ndarray], limits: list[float]) -> DataFrame:
        """(_key, inliers): the idx of the matches that the chosen maps fit, in their order."""

        def inside(batches):
            for batch in batches:
                keys, idx, *m = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                m, near = np.column_stack(m), np.zeros(len(keys), bool)
                for k in set(np.unique(keys).tolist()) & set(chosen):
                    near[keys == k] = models.residuals(chosen[k], m[keys == k, :2], m[keys == k, 2:]) < limits[k]
                yield pa.RecordBatch.from_pydict({"_key": pa.array(keys[near], pa.int32()), "idx": pa.array(idx[near].astype(np.int32), pa.int32())})

        return self.placed.select("_key", "idx", *VALUES).mapInArrow(inside, "_key int, idx int").groupBy("_key").agg(F.sort_array(F.collect_list("idx")).alias("inliers"))


def scores(maps: np.ndarray, m: np.ndarray, limit: float) -> np.ndarray:
    """(cost, inliers) of each 3x3 map over matches (ax, ay, bx, by, n): ``models.residuals`` in blocks, by products."""
    out, most = np.zeros((len(maps), 2)), limit * limit
    for start in range(0, len(m), _ROWS):
        rows = m[start : start + _ROWS]
        p, n = np.column_stack([rows[:, :2], np.ones(len(rows))]), rows[:, 4]
        for at in range(0, len(maps), _MAPS):
            h = maps[at : at + _MAPS]
            x, y = p @ h[:, 0].T, p @ h[:, 1].T
            bent = (h[:, 2] != (0, 0, 1)).any()
            if bent:
                z = p @ h[:, 2].T
                z[z <= 1e-12] = np.nan
                x /= z
                y /= z
            x -= rows[:, 2:3]
            y -= rows[:, 3:4]
            x *= x
            y *= y
            x += y
            near = x < most  # not where it is NaN
            np.copyto(x, most, where=~near)
            out[at : at + _MAPS, 0] += n @ x
            out[at : at + _MAPS, 1] += n @ near.astype(float)
    return out


def _usable(m: np.ndarray) -> np.ndarray:
    return m[np.isfinite(m).all(axis=1)]


def _summed(rows: np.ndarray) -> np.ndarray:
    """(value, n) by value."""
    values, at = np.unique(rows[:, 0], return_inverse=True)
    return np.column_stack([values, np.bincount(at, rows[:, 1], len(values))])


def _frame(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps of either photo's points to about the origin, by those of a few matches."""
    return tuple(models.normaliser(c, d if (d := np.sqrt(((p - c) ** 2).sum(axis=1)).mean()) > 1e-9 else 1.0) for p in (points[:, :2], points[:, 2:]) for c in (p.mean(axis=0),))


def _centres(lines: np.ndarray, frame: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The centres of both photos' points from the triangle of (1, a, b) in their frame."""
    r = np.linalg.qr(lines, mode="r")
    middle = r[0, 1:] / r[0, 0]
    return tuple(models.apply(np.linalg.inv(t), c[None])[0] for t, c in zip(frame, (middle[:2], middle[2:]), strict=True))


def _solved(kind: str, number: float, triangles: list[np.ndarray], frame: tuple[np.ndarray, np.ndarray], apart: np.ndarray | None) -> np.ndarray | None:
    """``models.least_squares`` from the triangles of its equations."""
    ca, cb = _centres(triangles[0], frame)
    ta, tb = frame
    if kind == "translation":
        return np.array([[1, 0, (cb - ca)[0]], [0, 1, (cb - ca)[1]], [0, 0, 1.0]])
    if kind == "homography":
        na, nb = models.normaliser(ca, apart[0]), models.normaliser(cb, apart[1])
        # a map h in the frame is l h r in the normalised one, and its equations are as many times larger as the second photo
        back = np.kron(tb @ np.linalg.inv(nb), (na @ np.linalg.inv(ta)).T)
        return models.homography_of(nb[0, 0] / tb[0, 0] * triangles[1] @ back, na, nb)
    r = np.linalg.qr(triangles[0], mode="r")[1:]
    return models.linear_map(kind, ca, cb, r[:, 1:3] / ta[0, 0], r[:, 3:5] / tb[0, 0], number)
