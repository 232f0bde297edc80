"""Exact deduplication by skew-safe combining.

Each task first deduplicates its own rows (the map side of the aggregation), rows then meet in
salted digest groups, and the salt winners are combined globally. All of these aggregations
group by the whole content beside its digest, so rows are equal only if their texts are. A
group with a third of all rows sends one row per task and at most ``SALTS`` rows to its last task,
and its rows meet their group's result by (digest, salt).

Defined cases: a null text counts as empty; a text is compared whole, whatever its length; rows
whose id is null take part and win only where no row of their group has an id; of rows that repeat
the id that wins, one is kept; an empty table gives an empty result; further columns are ignored
by ``exact_groups``, whatever their names, and kept by ``drop_exact_copies``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.runtime import checkpointed

SALTS = 16


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed. Null becomes empty."""
    whole = F.coalesce(text, F.lit(""))
    plain = F.octet_length(whole) == F.char_length(whole)
    return F.when(plain, F.lower(whole)).otherwise(
        F.translate(whole, string.ascii_uppercase, string.ascii_lowercase)
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept and text_sha256; one row of a group is kept."""
    body = ascii_lower(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body")).withColumn("digest", _digest("body")).withColumn("salt", _salt("id", salts))
    totals = checkpointed(_totals(rows))
    narrow = checkpointed(rows.select("id", "digest", "salt"))  # no later pass reads a text
    named = _named(narrow, totals.where("variants = 1"))
    clash = totals.where("variants > 1").select("digest")
    if not clash.isEmpty():  # different texts under one digest: told apart by content
        mixed = rows.join(clash, "digest", "left_semi")
        own = _merged(mixed).groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        named = named.unionByName(mixed.join(own, ["digest", "body"]).withColumn("variant", F.xxhash64("body")).select(*named.columns))
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    found = named.withColumn("kept", kept)
    again = found.where("kept").groupBy("digest", "variant").agg(F.count("*").alias("winners"), F.min("salt").alias("first")).where("winners > 1")
    if not again.isEmpty():  # rows that repeat the id that wins: one of those of the least salt is kept
        tied = found.where("kept").join(again, ["digest", "variant"], "left")
        turn = F.row_number().over(Window.partitionBy("digest", "variant", "salt").orderBy("id"))
        lone = tied.where("winners IS NULL").select(*found.columns)
        few = tied.where("salt = first").withColumn("kept", turn == 1).select(*found.columns)
        others = tied.where("salt <> first").withColumn("kept", F.lit(False)).select(*found.columns)
        found = found.where("NOT kept").unionByName(lone).unionByName(few).unionByName(others)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the largest id.

    Where rows share that id, one of them stays, by the order of all their columns.
    """
    # positions instead of names, so that no column can clash with those of the operator
    names = docs.columns
    fields = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at_id, at_text = (f"c{names.index(c)}" for c in (id_col, text_col))
    rows = fields.select("*", F.col(at_id).alias("id"), ascii_lower(F.col(at_text)).alias("body")).withColumn("digest", _digest("body")).withColumn("salt", _salt("id", salts))
    narrow = rows.select("id", "digest", "salt", "body")
    totals = checkpointed(_totals(narrow))
    best = totals.where("variants = 1").select(F.col("digest").alias("b_digest"), F.col("keep_id").alias("b_id"))
    won = (F.col("digest") == F.col("b_digest")) & F.col("id").eqNullSafe(F.col("b_id"))
    kept = rows.join(best, won, "left_semi")
    clash = totals.where("variants > 1").select("digest")
    if not clash.isEmpty():  # different texts under one digest: told apart by content
        own = _merged(narrow.join(clash, "digest", "left_semi")).groupBy("body").agg(F.max("keep_id").alias("b_id"))
        own = own.withColumnRenamed("body", "b_body")
        kept = kept.unionByName(rows.join(own, (F.col("body") == F.col("b_body")) & F.col("id").eqNullSafe(F.col("b_id")), "left_semi"))
    again = rows.select("id", "digest").join(best, won, "left_semi").groupBy("id", "digest").count().where("count > 1")
    if not (again.isEmpty() and clash.isEmpty()):  # rows that repeat the id that wins: first one of each salt, then one of these
        order = [F.to_json(F.struct(c)) for c in fields.columns]
        for group in (["digest", "salt", "body"], ["digest", "body"]):
            kept = kept.withColumn("turn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("turn = 1").drop("turn")
    return kept.select(*(F.col(c).alias(n) for c, n in zip(fields.columns, names, strict=True)))


def _digest(body: str) -> Column:
    return F.unhex(F.sha2(F.col(body), 256))


def _salt(id_col: str, salts: int) -> Column:
    """By the id and, for rows without one, the partition: a group of these spreads too."""
    return F.pmod(F.xxhash64(id_col, F.when(F.col(id_col).isNull(), F.spark_partition_id())), F.lit(salts))


def _merged(rows: DataFrame) -> DataFrame:
    """The winners of salted digest groups; the map side deduplicates each task's own rows."""
    return rows.groupBy("digest", "salt", "body").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))


def _totals(rows: DataFrame) -> DataFrame:
    """Per digest: the winner and size of its group, and how many different contents it has."""
    return (
        _merged(rows)
        .repartition("digest")
        .groupBy("digest", "body")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        .groupBy("digest")
        .agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("variants"))
    )


def _named(narrow: DataFrame, totals: DataFrame) -> DataFrame:
    """Each row with its group's winner and size. Totals are first given to each salt that a group has, so a hot group stays spread."""
    by_salt = narrow.select("digest", "salt").distinct().join(totals, "digest")
    return narrow.join(by_salt, ["digest", "salt"]).select("id", "digest", "salt", "keep_id", "group_size", F.lit(0).cast("long").alias("variant"))
