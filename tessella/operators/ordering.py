"""Positions in a total order that no single task could hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.runtime import checkpointed

_WITHIN = (1 << 33) - 1  # monotonically_increasing_id: partition above 33 bits, row below


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``rows`` with their 0-based position in ``order``.

    Rows are dealt by range and numbered where they are; only the counts of the partitions meet in
    a window. The dealt rows are checkpointed first, as another run may deal them otherwise.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(keys, order, strict=True)))
    dealt = checkpointed(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys).withColumn("_at", F.monotonically_increasing_id()))
    parts = dealt.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_part", before.alias("_before"))  # as many rows as partitions
    placed = dealt.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_at").bitwiseAND(_WITHIN) + F.col("_before")).drop("_at", "_part", "_before")


def beside(placed: DataFrame, columns: Sequence[str], place: str = "place", suffix: str = "_before", step: int = 1) -> DataFrame:
    """``placed`` with ``columns`` of the row ``step`` places before, null for the first ones."""
    other = placed.select((F.col(place) + step).alias(place), *(F.col(c).alias(c + suffix) for c in columns))
    return placed.join(other, place, "left")
