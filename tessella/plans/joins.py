"""Queries of matching, candidates, joins and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.config import DEFAULTS
from tessella.functions import columns as C
from tessella.operators import candidates, matching, verification
from tessella.plans.inputs import given, over
from tessella.runtime import table

RATIO = 0.95  # the tables' vectors lie far apart; the default ratio passes next to none

_MATCHED = """, pairs AS (SELECT x.image AS a, y.image AS b, x.idx AS ia, y.idx AS ib,
    list_sum(list_transform(list_zip(x.vec, y.vec), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) AS d
    FROM descriptors x JOIN descriptors y ON x.image < y.image),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY a, b, ia ORDER BY d, ib) AS f, lead(d) OVER (PARTITION BY a, b, ia ORDER BY d, ib) AS d2,
    row_number() OVER (PARTITION BY a, b, ib ORDER BY d, ia) AS r FROM pairs),
  matched AS (SELECT a, b, ia, ib, round(1 - sqrt(d) / sqrt(d2), 6) AS score FROM ranked WHERE f = 1 AND r = 1 AND d2 > 0 AND sqrt(d) < 0.95 * sqrt(d2)),
  affinities AS (SELECT p.a, p.b, count(m.ia) AS affinity FROM (SELECT DISTINCT x.image AS a, y.image AS b FROM descriptors x JOIN descriptors y ON x.image < y.image) p
    LEFT JOIN matched m ON p.a = m.a AND p.b = m.b GROUP BY ALL)"""
_BOTH = """, ways AS (SELECT a AS id, a, b, affinity FROM affinities UNION ALL SELECT b, a, b, affinity FROM affinities),
  partners AS (SELECT DISTINCT a, b FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY affinity DESC, a, b) AS turn FROM ways WHERE affinity > 0) WHERE turn <= 2)"""
_TREE = """, placed AS (SELECT a, b, row_number() OVER (ORDER BY affinity DESC, a, b) AS place FROM affinities),
  reach(place, src, dst) AS (SELECT p.place, p.a, p.a FROM placed p UNION SELECT r.place, r.src, CASE WHEN e.a = r.dst THEN e.b ELSE e.a END FROM reach r JOIN placed e ON e.place < r.place AND (e.a = r.dst OR e.b = r.dst)),
  tree AS (SELECT p.a, p.b FROM placed p WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.place = p.place AND r.dst = p.b))"""


def _affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.affinity(given(spark, sf_dir, "descriptors"), RATIO)


def j1_descriptor_join(spark, sf_dir):
    return matching.descriptor_join(given(spark, sf_dir, "descriptors"), ratio=RATIO).withColumn("score", F.round("score", 6))


def j2_all_pairs(spark, sf_dir):
    return matching.all_pairs(given(spark, sf_dir, "descriptors").select("image").distinct())


def j3_pair_lookup(spark, sf_dir):
    links, photos = given(spark, sf_dir, "links"), given(spark, sf_dir, "photos")
    return links.join(photos.select(F.col("id").alias("a"), F.col("name").alias("name_a")), "a").join(photos.select(F.col("id").alias("b"), F.col("name").alias("name_b")), "b").select("a", "b", "name_a", "name_b")


def j6_untried(spark, sf_dir):
    tried = given(spark, sf_dir, "links").where("inliers > 50").select("a", "b")
    return given(spark, sf_dir, "links").join(tried, ["a", "b"], "left_anti").select("a", "b", "inliers")


CELL = 50


def _shapes(spark, sf_dir) -> DataFrame:
    """Tilted four-cornered shapes (id, points)."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, w, h = (F.col(k) for k in ("x0", "y0", "w", "h"))
    return given(spark, sf_dir, "boxes").select("id", F.array(corner(x0, y0), corner(x0 + w, y0 + 3), corner(x0 + w + 2, y0 + h), corner(x0 + 1, y0 + h - 2)).alias("points"))


def j7_box_overlap(spark, sf_dir):
    """Convex shapes that lie over each other."""
    return candidates.overlapping(_shapes(spark, sf_dir), CELL).select("a", "b", F.round("share", 6).alias("share"))


def j8_near_axes(spark, sf_dir):
    """Optical axes nearer than their half fields of view together, by yaw and pitch."""
    p = given(spark, sf_dir, "photos").select("id", F.radians(F.col("id") * 37 % 360).alias("yaw"), F.radians(F.col("id") * 11 % 41 - 20).alias("pitch"), F.radians(5.0 + F.col("id") % 7).alias("half"))
    return candidates.near_axes(p).select("a", "b", F.round("score", 5).alias("score"))


def j10_best_evidence_lookup(spark, sf_dir):
    """The best evidence of pairs asked for in either order."""
    asked = given(spark, sf_dir, "links").select(F.col("b").alias("p"), F.col("a").alias("q"))
    best = verification.best_evidence(given(spark, sf_dir, "evidence")).select("a", "b", "source", "verified", F.col("inliers").alias("inliers"))
    return asked.join(best, (F.least("p", "q") == best["a"]) & (F.greatest("p", "q") == best["b"])).select("p", "q", "source", "verified", "inliers")


def j11_oriented_evidence(spark, sf_dir):
    e = given(spark, sf_dir, "evidence")
    flip = F.col("a") % 3 > F.col("b") % 3
    return e.select("seq", F.when(flip, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("b"), flip.alias("flipped"))


def j13_nearest_node(spark, sf_dir):
    """For each query point the nearest centre within 30; points meet centres in cells of that size."""
    boxes = given(spark, sf_dir, "boxes")
    centre = boxes.select("id", (F.col("x0") + F.col("w") / 2).alias("cx"), (F.col("y0") + F.col("h") / 2).alias("cy"))
    asked = given(spark, sf_dir, "photos").select(F.col("id").alias("q"), (F.col("id") * 31 % 1000).cast("double").alias("x"), (F.col("id") * 17 % 1000).cast("double").alias("y"))
    cells = asked.withColumn("gx", F.explode(F.sequence(F.floor(F.col("x") / 30) - 1, F.floor(F.col("x") / 30) + 1))).withColumn("gy", F.explode(F.sequence(F.floor(F.col("y") / 30) - 1, F.floor(F.col("y") / 30) + 1)))
    near = cells.join(centre.withColumns({"gx": F.floor(F.col("cx") / 30), "gy": F.floor(F.col("cy") / 30)}), ["gx", "gy"])
    d = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)
    return near.withColumn("d", d).where("d <= 30").groupBy("q").agg(F.min_by("id", F.struct("d", "id")).alias("id"))


def j14_smallest_outline(spark, sf_dir):
    """For each query point the smallest box outline that holds it, by crossed edges."""
    boxes = given(spark, sf_dir, "boxes")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    shapes = boxes.select("id", F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("points"), F.explode(F.sequence(F.floor(x0 / CELL), F.floor(x1 / CELL))).alias("gx"), y0.alias("top"), y1.alias("low"))
    shapes = shapes.withColumn("gy", F.explode(F.sequence(F.floor(F.col("top") / CELL), F.floor(F.col("low") / CELL)))).drop("top", "low")
    asked = given(spark, sf_dir, "photos").select(F.col("id").alias("q"), (F.col("id") * 31 % 1000 + 0.5).cast("double").alias("x"), (F.col("id") * 17 % 1000 + 0.5).cast("double").alias("y")).withColumns({"gx": F.floor(F.col("x") / CELL), "gy": F.floor(F.col("y") / CELL)})
    inside = asked.join(shapes, ["gx", "gy"]).where(C.even_odd(F.col("points"), F.col("x"), F.col("y")))
    return inside.groupBy("q").agg(F.min_by("id", F.struct(F.abs(C.signed_area(F.col("points"))), "id")).alias("id"))


def j13_nearest_edge(spark, sf_dir):
    """For each query point the nearest link within 30, links being drawn between their photos' places."""
    at = given(spark, sf_dir, "vertices").select("id", (F.col("id") * 29 % 400).cast("double").alias("x"), (F.col("id") * 13 % 300).cast("double").alias("y"))
    lines = given(spark, sf_dir, "links").select("a", "b").join(at.toDF("a", "x0", "y0"), "a").join(at.toDF("b", "x1", "y1"), "b")
    asked = given(spark, sf_dir, "photos").select(F.col("id").alias("q"), (F.col("id") * 31 % 400).cast("double").alias("x"), (F.col("id") * 17 % 300).cast("double").alias("y"))
    return candidates.nearest_line(asked, lines, 30).select("q", "a", "b", F.round("distance", 6).alias("distance"))


def j13_nearest_match(spark, sf_dir):
    """For each pair and cursor the nearest match within 12 of it."""
    m = given(spark, sf_dir, "matches").select("pair", "idx", F.col("ax").alias("mx"), F.col("ay").alias("my"), F.floor(F.col("ax") / 12).alias("gx"), F.floor(F.col("ay") / 12).alias("gy"))
    asked = m.select("pair").distinct().withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(19)))).select("pair", "q", (F.col("q") * 53 % 1000).cast("double").alias("x"), (F.col("q") * 37 % 700).cast("double").alias("y"))
    around = lambda v: F.explode(F.sequence(F.floor(F.col(v) / 12) - 1, F.floor(F.col(v) / 12) + 1))
    near = asked.withColumn("gx", around("x")).withColumn("gy", around("y")).join(m, ["pair", "gx", "gy"])
    d = F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2)
    return near.withColumn("d", d).where("d <= 12").groupBy("pair", "q").agg(F.min_by("idx", F.struct("d", "idx")).alias("idx"))


def j15_closest_distance(spark, sf_dir):
    """The least distance of two centres, however far apart they lie."""
    c = given(spark, sf_dir, "boxes").select("id", (F.col("x0") + F.col("w") / 2).alias("x"), (F.col("y0") + F.col("h") / 2).alias("y"))
    return candidates.closest_distance(c).select(F.round("distance", 6).alias("distance"))


def a1_affinity(spark, sf_dir):
    return _affinity(spark, sf_dir)


def w3_top_partners(spark, sf_dir):
    return candidates.top_partners(_affinity(spark, sf_dir))


def g2_spanning_tree(spark, sf_dir):
    return candidates.spanning_tree(_affinity(spark, sf_dir))


def u1_candidates(spark, sf_dir):
    """Consecutive, neighbour and spanning-tree pairs with their reasons, in photo order of label."""
    affinities = _affinity(spark, sf_dir)
    photos = given(spark, sf_dir, "descriptors").select(F.col("image").alias("id")).distinct().withColumns({"name": F.concat(F.lit("photo"), "id"), "capture_date": F.lit(None).cast("timestamp")})
    return candidates.candidates(photos, affinities).withColumn("reasons", F.array_join("reasons", ","))


def w6_bridges(spark, sf_dir):
    affinities = _affinity(spark, sf_dir)
    groups = given(spark, sf_dir, "descriptors").select(F.col("image").alias("id")).distinct().withColumn("component", F.floor(F.col("id") / 4))
    tried = affinities.where("(a + b) % 5 = 0")
    return candidates.bridges(affinities, groups, tried, limit=10)


def l2_overlap_quota(spark, sf_dir):
    overlaps = given(spark, sf_dir, "links").select("a", "b", F.col("inliers").cast("double").alias("overlap"))
    return candidates.quota(overlaps, 2).select("a", "b")


def w4_strongest(spark, sf_dir):
    d = given(spark, sf_dir, "descriptors").select("image", "idx", F.abs(F.col("vec")[0].cast("double")).alias("response"))
    return matching.strongest(d, "response", 20).select("image", "idx")


def p6_confident(spark, sf_dir):
    m = given(spark, sf_dir, "matches").select(F.col("pair").alias("a"), F.lit(0).alias("b"), F.col("idx").alias("ia"), (F.col("idx") % 60 - 3).alias("ib"), F.col("score").alias("confidence"), F.lit(50).alias("count_b"))
    return matching.confident(m, 0.05).select("a", "ia", "ib")


def p1_active(spark, sf_dir):
    photos = given(spark, sf_dir, "photos")
    return photos.where("height > 900").join(photos.where("s_nationkey % 5 = 0").select("id"), "id", "left_anti").select("id")


def _column_query(source: str, *made):
    def run(spark, sf_dir):
        return given(spark, sf_dir, source).select(*(m() if callable(m) else m for m in made))

    return run


c = F.col


def t_of():
    return F.array(*(F.col(f"t{i}") for i in range(9)))


p2_sift_rescale = _column_query("matches", "idx", lambda: F.round(C.rescaled(c("ax"), F.lit(1.5)), 6).alias("x"), lambda: F.round(C.rescaled(c("ay"), F.lit(1.5)), 6).alias("y"))
p3_learned_rescale = _column_query("matches", "idx", lambda: F.round(C.learned_rescaled(c("ax"), 512), 6).alias("x"), lambda: F.round(C.learned_rescaled(c("ay"), 384), 6).alias("y"))


def p5_normalised(spark, sf_dir):
    """Keypoints of matches about the middle of their photo."""
    size = given(spark, sf_dir, "photos").select(c("id").alias("pair"), "width", "height")
    x, y = C.normalised(c("ax"), c("ay"), c("width"), c("height"))
    return given(spark, sf_dir, "matches").join(size, "pair").select("idx", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


p9_canvas = _column_query("photos", "id", lambda: F.when(c("width") >= c("height"), "landscape").otherwise("portrait").alias("canvas"), lambda: F.round(F.least(F.when(c("width") >= c("height"), 1024).otherwise(768) / c("width"), F.when(c("width") >= c("height"), 768).otherwise(1024) / c("height")), 9).alias("fit"))
p10_threshold = _column_query("photos", "id", lambda: F.round(C.inlier_threshold(c("width"), c("height"), DEFAULTS.inlier_threshold), 6).alias("threshold"))
p11_focal = _column_query("photos", "id", lambda: F.round(C.focal_prior(c("f35"), c("width"), c("height")), 6).alias("focal"))
s5_long_side = _column_query("photos", "id", lambda: C.long_side(c("width"), c("height"), 1.5).cast("long").alias("side"))


def p4_in_content(spark, sf_dir):
    return given(spark, sf_dir, "matches").where("ax < 900 AND ay < 600").select("pair", "idx")


def p7_finite(spark, sf_dir):
    m = given(spark, sf_dir, "matches").withColumns({"ax": F.when(c("idx") % 7 == 0, F.lit(float("nan"))).otherwise(c("ax")), "by_": F.when(c("idx") % 11 == 0, F.lit(float("inf"))).otherwise(c("by_"))})
    return m.where(C.finite(c("ax")) & C.finite(c("ay")) & C.finite(c("bx")) & C.finite(c("by_"))).select("pair", "idx")


def p8_visible(spark, sf_dir):
    state = F.when(c("verified"), "verified").when(c("inliers") >= 15, "rejected").otherwise("failed")
    return given(spark, sf_dir, "evidence").withColumn("state", state).where(c("state").isin("verified", "failed")).groupBy("state").agg(F.count("*").alias("n"))


def _matches_mapped(spark, sf_dir):
    maps = given(spark, sf_dir, "maps").select(c("image").alias("pair"), t_of().alias("t"))
    return given(spark, sf_dir, "matches").join(maps, "pair")


def p12_reprojection(spark, sf_dir):
    m = _matches_mapped(spark, sf_dir)
    x, y = C.mapped(c("t"), c("ax"), c("ay"))
    return m.select("idx", F.round(F.sqrt((x - c("bx")) ** 2 + (y - c("by_")) ** 2), 5).alias("error"))


def j12_grid_dedup(spark, sf_dir):
    """Of matches within a radius in both photos the one of lower sigma stays, greedily; one pair per group."""
    import pandas as pd

    def dedup(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["sigma", "idx"])
        cells, kept = {}, []
        for i, ax, ay, bx, by in zip(rows["idx"], rows["ax"], rows["ay"], rows["bx"], rows["by_"], strict=True):
            gx, gy = int(ax // 5), int(ay // 5)
            near = (k for u in (-1, 0, 1) for v in (-1, 0, 1) for k in cells.get((gx + u, gy + v), ()))
            if any((ax - p) ** 2 + (ay - q) ** 2 < 25 and (bx - r) ** 2 + (by - s) ** 2 < 25 for p, q, r, s in near):
                continue
            cells.setdefault((gx, gy), []).append((ax, ay, bx, by))
            kept.append(i)
        return pd.DataFrame({"idx": kept})

    return given(spark, sf_dir, "matches").select("pair", "idx", "ax", "ay", "bx", "by_", "sigma").groupBy("pair").applyInPandas(dedup, "idx long")


QUERIES = {k: v for k, v in list(globals().items()) if k.split("_")[0][:1] in "jawgulpsw" and k.split("_")[0][1:].isdigit()}

ORACLES = {
    "j1_descriptor_join": over("descriptors", _MATCHED + " SELECT a, b, ia, ib, score FROM matched"),
    "j2_all_pairs": over("descriptors", "SELECT DISTINCT x.image AS a, y.image AS b FROM descriptors x JOIN descriptors y ON x.image < y.image"),
    "j3_pair_lookup": over("links photos", "SELECT l.a, l.b, p.name AS name_a, q.name AS name_b FROM links l JOIN photos p ON l.a = p.id JOIN photos q ON l.b = q.id"),
    "j6_untried": over("links", "SELECT a, b, inliers FROM links l WHERE NOT EXISTS (SELECT 1 FROM links t WHERE t.inliers > 50 AND t.a = l.a AND t.b = l.b)"),
    # the corners of a convex overlap are corners of one shape inside the other and crossings of their edges; in order of their angle they give its area
    "j7_box_overlap": over("boxes", """, k AS (SELECT id, n, CASE n WHEN 0 THEN x0 WHEN 1 THEN x0 + w WHEN 2 THEN x0 + w + 2 ELSE x0 + 1 END AS x, CASE n WHEN 0 THEN y0 WHEN 1 THEN y0 + 3 WHEN 2 THEN y0 + h ELSE y0 + h - 2 END AS y FROM boxes, (SELECT unnest(range(4)) AS n)),
        e AS (SELECT p.id, p.n, p.x, p.y, q.x AS u, q.y AS v FROM k p JOIN k q ON p.id = q.id AND q.n = (p.n + 1) % 4), areas AS (SELECT id, sum(x * v - u * y) / 2 AS area FROM e GROUP BY 1),
        c AS (SELECT a.id AS a, b.id AS b FROM boxes a JOIN boxes b ON a.id < b.id AND a.x0 < b.x0 + b.w + 2 AND b.x0 < a.x0 + a.w + 2 AND a.y0 < b.y0 + b.h AND b.y0 < a.y0 + a.h),
        ways AS (SELECT a, b, a AS one, b AS other FROM c UNION ALL SELECT a, b, b, a FROM c),
        inside AS (SELECT t.a, t.b, k.x, k.y FROM ways t JOIN k ON k.id = t.one JOIN e ON e.id = t.other GROUP BY t.a, t.b, t.one, k.n, k.x, k.y HAVING min((e.u - e.x) * (k.y - e.y) - (e.v - e.y) * (k.x - e.x)) >= 0),
        d AS (SELECT c.a, c.b, p.x, p.y, p.u - p.x AS px, p.v - p.y AS py, q.x AS qx0, q.y AS qy0, q.u - q.x AS qx, q.v - q.y AS qy FROM c JOIN e p ON p.id = c.a JOIN e q ON q.id = c.b),
        f AS (SELECT *, ((qx0 - x) * qy - (qy0 - y) * qx) / nullif(px * qy - py * qx, 0) AS s, ((qx0 - x) * py - (qy0 - y) * px) / nullif(px * qy - py * qx, 0) AS t FROM d),
        pts AS (SELECT * FROM inside UNION ALL SELECT a, b, x + s * px, y + s * py FROM f WHERE s BETWEEN 0 AND 1 AND t BETWEEN 0 AND 1),
        m AS (SELECT *, avg(x) OVER w AS cx, avg(y) OVER w AS cy FROM pts WINDOW w AS (PARTITION BY a, b)), o AS (SELECT *, row_number() OVER w AS n, lead(x) OVER w AS u, lead(y) OVER w AS v, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy
          FROM m WINDOW w AS (PARTITION BY a, b ORDER BY atan2(y - cy, x - cx), x, y)),
        s AS (SELECT o.a, o.b, sum(x * coalesce(v, fy) - coalesce(u, fx) * y) / 2 AS area FROM o GROUP BY 1, 2)
        SELECT s.a, s.b, round(s.area / least(p.area, q.area), 6) AS share FROM s JOIN areas p ON p.id = s.a JOIN areas q ON q.id = s.b WHERE s.area / least(p.area, q.area) > 0.05"""),
    "j8_near_axes": over("photos", """, p AS (SELECT id, radians(id * 37 % 360) AS yaw, radians(id * 11 % 41 - 20) AS pitch, radians(5.0::DOUBLE + id % 7) AS half FROM photos),
        q AS (SELECT a.id AS a, b.id AS b, acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, sin(a.pitch) * sin(b.pitch) + cos(a.pitch) * cos(b.pitch) * cos(a.yaw - b.yaw)))) AS angle, a.half + b.half AS reach FROM p a JOIN p b ON a.id < b.id)
        SELECT a, b, round(1 - angle / reach, 5) AS score FROM q WHERE angle < reach"""),
    "j10_best_evidence_lookup": over("links evidence", """, e AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY verified DESC, inliers DESC, seq) AS turn FROM evidence)
        SELECT l.b AS p, l.a AS q, e.source, e.verified, e.inliers FROM links l JOIN e ON e.a = least(l.a, l.b) AND e.b = greatest(l.a, l.b) WHERE e.turn = 1"""),
    "j13_nearest_edge": over("links vertices photos", """, spots AS (SELECT id, (id * 29 % 400)::DOUBLE AS x, (id * 13 % 300)::DOUBLE AS y FROM vertices), l AS (SELECT k.a, k.b, p.x, p.y, q.x - p.x AS u, q.y - p.y AS v FROM links k JOIN spots p ON p.id = k.a JOIN spots q ON q.id = k.b),
        c AS (SELECT id AS q, (id * 31 % 400)::DOUBLE AS px, (id * 17 % 300)::DOUBLE AS py FROM photos), t AS (SELECT q, a, b, px, py, x, y, u, v, greatest(0, least(1, CASE WHEN u * u + v * v > 0 THEN ((px - x) * u + (py - y) * v) / (u * u + v * v) ELSE 0 END)) AS s FROM c, l),
        d AS (SELECT q, a, b, sqrt((px - x - s * u) ** 2 + (py - y - s * v) ** 2) AS d FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d, 9), a, b) AS turn FROM d WHERE d <= 30) SELECT q, a, b, round(d, 6) AS distance FROM r WHERE turn = 1"""),
    "j13_nearest_match": over("matches", """, c AS (SELECT pair, q, (q * 53 % 1000)::DOUBLE AS x, (q * 37 % 700)::DOUBLE AS y FROM (SELECT DISTINCT pair FROM matches), (SELECT unnest(range(20)) AS q)),
        d AS (SELECT c.pair, c.q, m.idx, sqrt((c.x - ax) ** 2 + (c.y - ay) ** 2) AS d FROM c JOIN matches m ON m.pair = c.pair) SELECT pair, q, min_by(idx, (d, idx)) AS idx FROM d WHERE d <= 12 GROUP BY 1, 2"""),
    "l2_overlap_quota": over("links", """, o AS (SELECT a, b, row_number() OVER (ORDER BY inliers DESC, a, b) AS n FROM links), photos AS (SELECT count(*) AS n FROM (SELECT a FROM links UNION SELECT b FROM links)),
        walk(n, used, ok, a, b) AS (SELECT 0, []::BIGINT[], false, 0::BIGINT, 0::BIGINT UNION ALL
          SELECT o.n, CASE WHEN t.take THEN list_concat(t.used, [o.a, o.b]) ELSE t.used END, t.take, o.a, o.b FROM (SELECT w.n, w.used, o2.a, o2.b,
            (len(list_filter(w.used, lambda x: x = o2.a)) < 2 OR len(list_filter(w.used, lambda x: x = o2.b)) < 2) AND len(w.used) < 8 * (SELECT n FROM photos) AS take FROM walk w JOIN o o2 ON o2.n = w.n + 1) t JOIN o ON o.n = t.n + 1)
        SELECT a, b FROM walk WHERE ok"""),
    "j11_oriented_evidence": over("evidence", "SELECT seq, CASE WHEN a % 3 > b % 3 THEN b ELSE a END AS a, CASE WHEN a % 3 > b % 3 THEN a ELSE b END AS b, a % 3 > b % 3 AS flipped FROM evidence"),
    "j12_grid_dedup": None,
    "j13_nearest_node": over("boxes photos", """, d AS (SELECT p.id AS q, b.id, sqrt((p.id * 31 % 1000 - b.x0 - b.w / 2) ** 2 + (p.id * 17 % 1000 - b.y0 - b.h / 2) ** 2) AS d FROM photos p, boxes b)
        SELECT q, min_by(id, (d, id)) AS id FROM d WHERE d <= 30 GROUP BY q"""),
    "j14_smallest_outline": over("boxes photos", """SELECT p.id AS q, min_by(b.id, (b.w * b.h, b.id)) AS id FROM photos p JOIN boxes b
        ON p.id * 31 % 1000 + 0.5 BETWEEN b.x0 AND b.x0 + b.w AND p.id * 17 % 1000 + 0.5 BETWEEN b.y0 AND b.y0 + b.h GROUP BY p.id"""),
    "j15_closest_distance": over("boxes", "SELECT round(min(sqrt((a.x0 + a.w / 2 - b.x0 - b.w / 2) ** 2 + (a.y0 + a.h / 2 - b.y0 - b.h / 2) ** 2)), 6) AS distance FROM boxes a JOIN boxes b ON a.id < b.id"),
    "a1_affinity": over("descriptors", _MATCHED + " SELECT a, b, affinity FROM affinities"),
    "w3_top_partners": over("descriptors", _MATCHED + _BOTH + " SELECT a, b FROM partners"),
    "g2_spanning_tree": over("descriptors", _MATCHED + _TREE + " SELECT a, b FROM tree"),
    "u1_candidates": over("descriptors", _MATCHED + _BOTH + _TREE + """, named AS (SELECT a, b, 'neighbour' AS reason FROM partners UNION ALL SELECT a, b, 'spanningTree' FROM tree
        UNION ALL SELECT id, following, 'consecutive' FROM (SELECT image AS id, lead(image) OVER (ORDER BY image) AS following FROM (SELECT DISTINCT image FROM descriptors)) WHERE following IS NOT NULL)
        SELECT n.a, n.b, f.affinity, array_to_string(list_sort(list(DISTINCT n.reason)), ',') AS reasons FROM named n LEFT JOIN affinities f ON n.a = f.a AND n.b = f.b GROUP BY n.a, n.b, f.affinity"""),
    "w6_bridges": over("descriptors", _MATCHED + """, u AS (SELECT a, b, affinity, row_number() OVER (PARTITION BY least(a // 4, b // 4), greatest(a // 4, b // 4) ORDER BY affinity DESC, a, b) AS turn
        FROM affinities WHERE affinity > 0 AND (a + b) % 5 <> 0 AND a // 4 <> b // 4) SELECT a, b, affinity FROM u WHERE turn <= 2 ORDER BY affinity DESC, a, b LIMIT 10"""),
    "w4_strongest": over("descriptors", "SELECT image, idx FROM (SELECT image, idx, row_number() OVER (PARTITION BY image ORDER BY abs(vec[1]::DOUBLE) DESC, idx) AS turn FROM descriptors) WHERE turn <= 20"),
    "p1_active": over("photos", "SELECT id FROM photos WHERE height > 900 AND s_nationkey % 5 <> 0"),
    "p2_sift_rescale": over("matches", "SELECT idx, round((ax + 0.5) * 1.5 - 0.5, 6) AS x, round((ay + 0.5) * 1.5 - 0.5, 6) AS y FROM matches"),
    "p3_learned_rescale": over("matches", "SELECT idx, round((ax - 512) * (1 + 0.42::DOUBLE / 512) + 512, 6) AS x, round((ay - 384) * (1 + 0.42::DOUBLE / 384) + 384, 6) AS y FROM matches"),
    "p4_in_content": over("matches", "SELECT pair, idx FROM matches WHERE ax < 900 AND ay < 600"),
    "p5_normalised": over("matches photos", "SELECT m.idx, round((ax - width / 2) / (greatest(width, height) / 2), 6) AS x, round((ay - height / 2) / (greatest(width, height) / 2), 6) AS y FROM matches m JOIN photos p ON p.id = m.pair"),
    "p6_confident": over("matches", "SELECT pair AS a, idx AS ia, idx % 60 - 3 AS ib FROM matches WHERE score > 0.05::DOUBLE AND idx % 60 - 3 BETWEEN 0 AND 49"),
    "p7_finite": over("matches", "SELECT pair, idx FROM matches WHERE idx % 7 <> 0 AND idx % 11 <> 0"),
    "p8_visible": over("evidence", "SELECT CASE WHEN verified THEN 'verified' ELSE 'failed' END AS state, count(*) AS n FROM evidence WHERE verified OR inliers < 15 GROUP BY 1"),
    "p9_canvas": over("photos", """SELECT id, CASE WHEN width >= height THEN 'landscape' ELSE 'portrait' END AS canvas,
        round(CASE WHEN width >= height THEN least(1024 / width, 768 / height) ELSE least(768 / width, 1024 / height) END, 9) AS fit FROM photos"""),
    "p10_threshold": over("photos", "SELECT id, round(3 * sqrt(width * height / 1e6), 6) AS threshold FROM photos"),
    "p11_focal": over("photos", "SELECT id, round(f35 * sqrt((width * width + height * height)::DOUBLE) / 43.2666::DOUBLE, 6) AS focal FROM photos"),
    "p12_reprojection": over("matches maps", """SELECT m.idx, round(sqrt(((t0 * ax + t1 * ay + t2) / z - bx) ** 2 + ((t3 * ax + t4 * ay + t5) / z - by_) ** 2), 5) AS error
        FROM (SELECT m.*, p.*, CASE WHEN t6 * ax + t7 * ay + t8 > 1e-9 THEN t6 * ax + t7 * ay + t8 END AS z FROM matches m JOIN maps p ON m.pair = p.image) m"""),
    "s5_long_side": over("photos", "SELECT id, floor(greatest(width, height) * least(1.0::DOUBLE, sqrt(1.5e6 / (width * height))) + 0.5)::BIGINT AS side FROM photos"),
}
ORACLES = {k: v for k, v in ORACLES.items() if v}
