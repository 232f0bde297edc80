"""Operator inputs derived from the tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessella.runtime import table

INPUTS = {
    "descriptors": "SELECT CAST(label AS BIGINT) AS image, vec_id AS idx, embedding AS vec FROM {embeddings}",
    "photos": """SELECT s_suppkey AS id, s_name AS name, 1000 + (s_suppkey * 37) % 3000 AS width, 800 + (s_suppkey * 53) % 2500 AS height,
        s_suppkey % 8 + 1 AS orientation, CAST(20 + s_suppkey % 60 AS DOUBLE) AS f35, s_acctbal, s_nationkey FROM {supplier}""",
    "evidence": """SELECT o_orderkey AS seq, least(o_custkey % 40, o_orderkey % 40) AS a, greatest(o_custkey % 40, o_orderkey % 40) AS b,
        CAST(floor(o_totalprice) AS BIGINT) % 97 AS inliers, o_orderstatus = 'F' AS verified, o_orderpriority AS source
        FROM {orders} WHERE o_custkey % 40 <> o_orderkey % 40""",
    # groups of sixteen in a ring with chords, and one photo alone after each; every supplier takes part
    "links": """SELECT least(x, y) AS a, greatest(x, y) AS b, max(inliers) AS inliers FROM (
        SELECT x, least(CASE WHEN x % 17 = 16 THEN x ELSE x - x % 17 + (x % 17 * k + d) % 16 END, last) AS y, abs(CAST(floor(s_acctbal) AS BIGINT)) % m AS inliers
        FROM (SELECT s_suppkey AS x, s_acctbal, (SELECT max(s_suppkey) FROM {supplier}) AS last FROM {supplier}) AS s
        CROSS JOIN (SELECT 1 AS k, 1 AS d, 97 AS m UNION ALL SELECT 1, 2, 89 UNION ALL SELECT 7, 3, 61) AS steps) AS w
        WHERE x <> y GROUP BY 1, 2""",
    "vertices": "SELECT s_suppkey AS id FROM {supplier}",
    "matches": """SELECT l_suppkey % 12 AS pair, l_orderkey * 8 + l_linenumber AS idx, l_quantity * 20 AS ax, CAST(l_partkey % 97 AS DOUBLE) * 8 AS ay,
        l_quantity * 20 + l_discount * 100 AS bx, CAST(l_partkey % 97 AS DOUBLE) * 8 + l_tax * 100 AS by_, l_extendedprice AS sigma, l_discount AS score,
        l_returnflag AS kind FROM {lineitem}""",
    "maps": """SELECT p_partkey AS image, 1000 + p_size * 10 AS width, 700 + p_size * 9 AS height, 1 + CAST(p_partkey % 10 AS DOUBLE) / 100 AS t0, CAST(p_partkey % 7 AS DOUBLE) / 100 AS t1,
        CAST(p_partkey % 100 AS DOUBLE) AS t2, -CAST(p_partkey % 5 AS DOUBLE) / 100 AS t3, 1 + CAST(p_partkey % 13 AS DOUBLE) / 100 AS t4, CAST(p_partkey % 50 AS DOUBLE) AS t5,
        CAST(p_partkey % 3 - 1 AS DOUBLE) / 2000 AS t6, CAST(p_partkey % 4 AS DOUBLE) / 100000 AS t7, CAST(1 AS DOUBLE) AS t8 FROM {part}""",
    "pixels": """SELECT CAST(floor(o_orderkey / 2000) AS BIGINT) AS image, CAST(floor((o_orderkey % 2000) / 50) AS BIGINT) AS y, o_orderkey % 50 AS x,
        CAST(CAST(floor(o_totalprice) AS BIGINT) % 256 AS DOUBLE) AS value FROM {orders}""",
    "frames": "SELECT user_id AS video, event_id AS idx, value / 1000 AS shift, CAST(event_id % 50 AS DOUBLE) / 100 AS peak, value AS sharpness FROM {events}",
    "boxes": """SELECT c_custkey AS id, CAST(c_custkey % 40 AS DOUBLE) * 25 AS x0, CAST(floor(c_custkey / 40) AS DOUBLE) * 13 AS y0,
        CAST(20 + c_custkey % 30 AS DOUBLE) AS w, CAST(15 + c_custkey % 20 AS DOUBLE) AS h FROM {customer}""",
}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = INPUTS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in re.findall(r"\{(\w+)\}", text)})


def over(names: str, body: str) -> str:
    """``body`` as DuckDB SQL with the named inputs before it."""
    own = ", ".join(f"{n} AS ({re.sub(r'[{}]', '', INPUTS[n])})" for n in names.split())
    return f"WITH RECURSIVE {own}{' ' if body.lstrip().startswith(',') else ' '}{body}"
