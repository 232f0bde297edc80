"""Components, centres, triangles and exclusion over photo graphs."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ordering import numbered
from tessella.runtime import checkpointed


def least_reachable(edges: DataFrame) -> DataFrame:
    """(u, v): for each node u of edges (u, v), but for the roots, the least node v that it reaches.

    Alternating large-star and small-star joins, each round checkpointed, until the edges stay the
    same (their number and the sum of their hashes); rounds grow with the logarithm of the longest path.
    """
    now = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    while (new := tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != state and new[0]:
        state = new
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        now = checkpointed(large.join(own, "u").select(F.explode(ends).alias("e")).select("e.*").where("u <> v").distinct())
    return now


#: Photo graphs of up to so many edges, a few MB, are searched on the driver; larger ones by joins, with the same result.
#: A project's graph is that small, and rounds of joins cost some seconds whatever their rows (see the README's figures).
SMALL = 100_000


def small_edges(edges: DataFrame) -> list | None:
    """The edges on the driver if there are few, else None."""
    rows = edges.limit(SMALL + 1).collect()
    return rows if len(rows) <= SMALL else None


class Groups:
    """Union-find whose roots are the least members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (up := self.parent.get(x, x)) != x:
            path.append(x)
            x = up
        self.parent.update(dict.fromkeys(path, x))
        return x

    def join(self, a: int, b: int) -> bool:
        x, y = self.root(a), self.root(b)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least vertex reachable over (a, b); single vertices are their own."""
    few = small_edges(edges.select("a", "b"))
    if few is not None:
        found = Groups()
        for a, b in few:
            found.join(a, b)
        rows = [(x, found.root(x)) for x in found.parent]
        known = vertices.sparkSession.createDataFrame(rows, "id long, root long")
        return vertices.join(known, "id", "left").select("id", F.coalesce("root", "id").alias("component"))
    roots = least_reachable(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return vertices.join(roots.toDF("id", "root"), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def ordered_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, place, members, size, strength): by size, then the sum of inliers, then the least member."""
    strength = edges.join(labels.toDF("a", "component"), "a").groupBy("component").agg(F.sum("inliers").alias("strength"))
    grouped = labels.groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("members"), F.count("*").alias("size"))
    both = grouped.join(strength, "component", "left").withColumn("strength", F.coalesce("strength", F.lit(0)))
    return numbered(both, [-F.col("size"), -F.col("strength"), F.col("component")])


def distances(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(source, id, distance) in hops between all connected vertices of a photo graph, however long its paths.

    Links go both ways, so what is next to one front is in that front, the one before or the next.
    """
    ways = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    front = checkpointed(vertices.select(F.col("id").alias("source"), "id", F.lit(0).alias("distance")))
    seen, before = front, front.limit(0)
    for hop in count(1):
        step = front.select("source", "id").join(ways, F.col("id") == F.col("a")).select("source", F.col("b").alias("id")).distinct()
        known = front.unionByName(before)
        before, front = front, checkpointed(step.join(known, ["source", "id"], "left_anti").withColumn("distance", F.lit(hop)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if hop % 32 == 0:  # keeps the plan short
            seen = checkpointed(seen.repartition("source"))


def centre(edges: DataFrame, vertices: DataFrame, weight: str = "weight") -> DataFrame:
    """(id, eccentricity, weight) in order of eccentricity, weight falling, id: the first row is the centre."""
    far = distances(edges, vertices).groupBy(F.col("source").alias("id")).agg(F.max("distance").alias("eccentricity"))
    heavy = edges.select(F.explode(F.array("a", "b")).alias("id"), weight).groupBy("id").agg(F.sum(weight).alias("weight"))
    return far.join(heavy, "id", "left").withColumn("weight", F.coalesce("weight", F.lit(0))).orderBy("eccentricity", F.desc("weight"), "id")


def triangles(edges: DataFrame) -> DataFrame:
    """(i, j, k) with i < j < k all linked."""
    ij, jk, ik = edges.select(F.col("a").alias("i"), F.col("b").alias("j")), edges.select(F.col("a").alias("j"), F.col("b").alias("k")), edges.select(F.col("a").alias("i"), F.col("b").alias("k"))
    return ij.join(jk, "j").join(ik, ["i", "k"], "left_semi").select("i", "j", "k")


def degrees(edges: DataFrame, weight: str = "inliers") -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("id"), weight).groupBy("id").agg(F.count("*").alias("degree"), F.sum(weight).alias("weight"))


def breadth_first(edges: DataFrame, start: int, count: int) -> list[int]:
    """The first ``count`` vertices from ``start``, strongest links first.

    The front of each round asks for its neighbours, ``2 * count`` of each vertex at most: no more can be new.
    """
    ways = edges.select(F.col("a").alias("id"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other"), "weight"))
    seen, front = [start], [start]
    while front and len(seen) < count:
        turn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "other"))
        near: dict[int, list[int]] = {}
        asked = ways.where(F.col("id").isin(front)).groupBy("id", "other").agg(F.max("weight").alias("weight")).withColumn("turn", turn)
        for r in asked.where(F.col("turn") <= 2 * count).orderBy("id", "turn").collect():
            near.setdefault(r["id"], []).append(r["other"])
        new = []
        for x in front:
            new += [other for other in near.get(x, []) if other not in seen and other not in new]
        front = new[: count - len(seen)]
        seen += front
    return seen


def still_joined(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Those of ``chosen`` (a, b) whose ends hang together without them; a front for each, all fronts at once."""
    ways = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    front = checkpointed(chosen.select(F.col("a").alias("ea"), F.col("b").alias("eb"), F.col("a").alias("id")).distinct())
    seen = front
    while not front.isEmpty():
        own = ((F.col("a") == F.col("ea")) & (F.col("b") == F.col("eb"))) | ((F.col("a") == F.col("eb")) & (F.col("b") == F.col("ea")))
        step = front.join(ways, F.col("id") == F.col("a")).where(~own).select("ea", "eb", F.col("b").alias("id")).distinct()
        front = checkpointed(step.join(seen, ["ea", "eb", "id"], "left_anti"))
        seen = checkpointed(seen.unionByName(front))
    return seen.where("id = eb").select(F.col("ea").alias("a"), F.col("eb").alias("b")).distinct()


def offenders(links: DataFrame, threshold: float = 3.0) -> DataFrame:
    """(a, b, error) of links whose error exceeds three upper medians, the threshold and half of the worst, and without
    which their ends still hang together."""
    stats = links.agg(F.expr("percentile_disc(0.5D) WITHIN GROUP (ORDER BY error DESC)").alias("middle"), F.max("error").alias("worst"))  # one row
    far = checkpointed(links.join(F.broadcast(stats)).where(F.col("error") > F.greatest(3 * F.col("middle"), F.lit(threshold), F.col("worst") / 2)).select("a", "b", "error"))
    return far.join(still_joined(links, far), ["a", "b"])


def closing(triangles_: DataFrame, shifts: DataFrame, threshold: float = 3.0) -> DataFrame:
    """(i, j, k, closes) of triangles whose links have shifts (a, b, dx, dy): whether the way round ends where it began.

    The three ways round have the same error where maps are shifts; it must be within eight thresholds.
    """
    side = lambda p, q, n: shifts.toDF(p, q, f"x{n}", f"y{n}")
    rows = triangles_.join(side("i", "j", 1), ["i", "j"]).join(side("j", "k", 2), ["j", "k"]).join(side("i", "k", 3), ["i", "k"])
    off = F.sqrt((F.col("x1") + F.col("x2") - F.col("x3")) ** 2 + (F.col("y1") + F.col("y2") - F.col("y3")) ** 2)
    return rows.select("i", "j", "k", (off <= 8 * threshold).alias("closes"))


def loop_votes(triangles_: DataFrame, closes: str = "closes") -> DataFrame:
    """(a, b, agree, disagree): how many triangles with each side close, and how many do not."""
    sides = F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("k").alias("b")), F.struct(F.col("i").alias("a"), F.col("k").alias("b")))
    return triangles_.select(F.explode(sides).alias("e"), closes).groupBy("e.a", "e.b").agg(F.count_if(F.col(closes)).alias("agree"), F.count_if(~F.col(closes)).alias("disagree"))


def inconsistent(pairs: list[tuple[int, int]], loops: list[tuple[int, int, int, bool]]) -> list[tuple[int, int]]:
    """Pairs to remove, worst first, so that no pair is in more open than closed loops.

    ``loops`` has triangles i < j < k and whether they close; of equals the pair first in the list goes.
    """
    place = {p: n for n, p in enumerate(pairs)}
    alive = [(((i, j), (j, k), (i, k)), ok) for i, j, k, ok in loops]
    removed = []
    while True:
        agree, disagree = dict.fromkeys(pairs, 0), dict.fromkeys(pairs, 0)
        for sides, ok in alive:
            for s in sides:
                (agree if ok else disagree)[s] += 1
        worst = [p for p in pairs if p not in removed and disagree[p] >= 2 and disagree[p] > agree[p]]
        if not worst:
            return removed
        gone = max(worst, key=lambda p: (disagree[p] - agree[p], disagree[p], -place[p]))
        removed.append(gone)
        alive = [(sides, ok) for sides, ok in alive if gone not in sides]


def exclusions(nodes: DataFrame, edges: DataFrame, least_features: int = 50) -> DataFrame:
    """(id, reason) of the photos outside the main group; null inside it.

    ``nodes``: id, component (place of its group, -1 outside), size of the main group, excluded,
    unreadable, features. ``edges``: a, b, verified, weak.
    """
    ends = edges.select(F.explode(F.array("a", "b")).alias("id"), "verified", "weak")
    touching = ends.groupBy("id").agg(F.bool_or("verified").alias("verified"), F.bool_or("weak").alias("weak"))
    reason = (
        F.when((F.col("component") == 0) & (F.col("main_size") >= 2), F.lit(None))
        .when(F.col("excluded"), "excludedByUser")
        .when(F.col("unreadable"), "unreadable")
        .when(F.col("features") < least_features, "tooFewFeatures")
        .when(F.coalesce("verified", F.lit(False)), "separateGroup")
        .when(F.coalesce("weak", F.lit(False)), "weakLinkOnly")
        .otherwise("noVerifiedPair")
    )
    return nodes.join(touching, "id", "left").select("id", reason.alias("reason"))


def grown_tree(pairs: list[tuple[int, int, float]], anchor: int) -> list[tuple[int, int]]:
    """Edges of a maximum tree grown from ``anchor``, in the order in which they join; of equals the first pair."""
    reached, out = {anchor}, []
    while True:
        ways = [(weight, -k) for k, (a, b, weight) in enumerate(pairs) if (a in reached) != (b in reached)]
        if not ways:
            return out
        a, b, _ = pairs[-max(ways)[1]]
        out.append((a, b))
        reached |= {a, b}
