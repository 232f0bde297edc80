"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A document of a source whose target is e times its size is expected e times. The expected copies
are summed up over the source's documents, in order of their size, from one random offset per
source, and a document is emitted once for each integer that its step crosses. In order of size
the taken words of a source stay within one largest document of its target.

Defined cases: a null text has size 0 and is taken with 0 words; sources of size 0 get target 0;
a null source is a source of its own, last in order; rows of a source of equal size go by their id,
null first, and rows equal in both are told apart by nobody; repeated rows are rows of their own; a
text is counted whole, whatever its length; an empty table gives an empty mix; further columns are
kept, or ignored, whatever their names. A broadcast of the sources' steps, one row each, is used up
to ``MOST_BROADCAST`` sources and gives the same rows as the join beyond. All windows over sources
hold one row per source in one task: sources are names, not addresses of pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.ranking import ranked
from tessella.runtime import checkpointed

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 17
MOST_BROADCAST = 10_000  # sources; beyond it the join is left to the planner and its skew handling
WORD = r"[^\x20\x09-\x0D]+"
_STEPS = 1 << 16  # offsets are multiples of 1/65536, so that sums with them stay exact


def word_count(text: Column) -> Column:
    """Words between spaces, tabs and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) with ``weight`` and ``target``.

    Shares of the total by weight; a source stops at ``most`` times its size and what it leaves
    goes to the others by weight, until none is above. In order of their ceiling per weight, the
    sources that stop come first, so one pass finds the share at which the rest lie below theirs.
    One row per source meets in the windows.
    """
    place = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(place) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (turn + 1).cast("int"))
    ceiling = F.col("source_size") * most
    by_ceiling = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").isNull(), "source")
    earlier = by_ceiling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    stepped = (
        sizes.withColumn("weight", weight)
        .withColumn("ceiling", ceiling)
        .withColumn("given", F.coalesce(F.sum("ceiling").over(earlier), F.lit(0)))
        .withColumn("spent", F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
        .withColumn("share", (F.sum("source_size").over(every) - F.col("given")) / (F.sum("weight").over(every) - F.col("spent")))
        .withColumn("share", F.when(F.col("ceiling") / F.col("weight") >= F.col("share"), F.col("share")))
        .withColumn("share", F.min_by("share", F.when(F.col("share").isNotNull(), F.struct(F.col("ceiling") / F.col("weight"), F.col("source").isNull(), "source"))).over(every))
    )
    target = F.least(F.col("ceiling").cast("double"), F.col("weight") * F.col("share"))
    return stepped.select("source", "source_size", "weight", F.coalesce(target, F.col("ceiling").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: its id, source, size, source_size, target, and ``copies`` to take."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    return _mixed(sized, weights, most, seed).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, in the columns of ``docs``.

    Rows that share an id, size and source are told apart by no one; they share their copies out.
    """
    names = docs.columns
    fields = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at_id, at_text, at_source = (f"c{names.index(c)}" for c in (id_col, text_col, source_col))
    sized = fields.withColumns({"id": F.col(at_id), "source": F.col(at_source), "size": word_count(F.col(at_text))})
    key = [F.col("id"), F.col("source"), F.col("size")]
    taken = _mixed(sized.select(*key), weights, most, seed)
    # rows of one key are neighbours in the order, so their copies are dealt out among them again
    per_key = taken.groupBy("id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    found = sized.join(
        per_key.toDF("p_id", "p_source", "p_size", "copies", "rows"),
        F.col("id").eqNullSafe(F.col("p_id")) & F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")),
    )
    single = found.where("rows = 1").withColumn("mine", F.col("copies"))
    nth = F.row_number().over(Window.partitionBy("id", "source", "size").orderBy(F.xxhash64(at_text), at_text))
    shared = found.where("rows > 1").withColumn("mine", F.floor((F.col("copies") + F.col("rows") - nth) / F.col("rows")))
    every = single.unionByName(shared) if not per_key.where("rows > 1").isEmpty() else single
    return every.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("mine").cast("int")))).where("mine > 0").select(*(F.col(c).alias(n) for c, n in zip(fields.columns, names, strict=True)))


def _mixed(sized: DataFrame, weights: Sequence[int], most: int, seed: int) -> DataFrame:
    rows, _ = ranked(sized, "source", ["size", "id"])  # the one pass over the texts
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    steps = targets.select(F.col("source").alias("t_source"), "source_size", "target", expected.alias("expected"), _offset(seed).alias("offset"))
    steps = checkpointed(steps)  # one row per source
    few = steps.count() <= MOST_BROADCAST
    joined = rows.join(F.broadcast(steps) if few else steps, F.col("source").eqNullSafe(F.col("t_source")))
    crossed = F.floor((F.col("rank") + 1) * F.col("expected") + F.col("offset")) - F.floor(F.col("rank") * F.col("expected") + F.col("offset"))
    return joined.select("id", "source", "size", "source_size", "target", F.least(crossed, F.lit(most)).cast("long").alias("copies"))


def _offset(seed: int) -> Column:
    """A source's random offset in [0, 1), the same in each run."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")))
    return F.conv(F.substring(F.sha2(named, 256), 1, 4), 16, 10).cast("double") / _STEPS
