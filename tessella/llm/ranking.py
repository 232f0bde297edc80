"""Ranks and prefix sums over groups that one task could not hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.runtime import checkpointed

_WITHIN = (1 << 33) - 1  # monotonically_increasing_id: partition above 33 bits, row below


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``rank``, 0-based within ``group`` in ``order``; and the slices it came from.

    Rows are dealt by range of (group, order), so a hot group spreads over many partitions. Only
    the counts of (partition, group) slices meet in a window: as many rows as partitions and groups
    together. The dealt rows are checkpointed first, as another run may deal them otherwise. Finding
    the ranges reads ``rows`` once more, so they are kept until they are dealt; what a lost executor
    had of them is made again.
    """
    keys = [group, *order]
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        dealt = checkpointed(kept.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    finally:
        kept.unpersist()
    dealt = dealt.withColumn("_slice", F.shiftright("_at", 33))
    slices = dealt.groupBy("_slice", group).agg(F.min(F.col("_at").bitwiseAND(_WITHIN)).alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumnRenamed(group, "_group")
    joined = dealt.join(starts, (dealt["_slice"] == starts["_slice"]) & dealt[group].eqNullSafe(starts["_group"]))
    rank = F.col("_at").bitwiseAND(_WITHIN) - F.col("_first") + F.col("_before")
    return joined.select(*(dealt[c] for c in rows.columns), rank.alias("rank")), slices
