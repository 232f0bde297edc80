"""Sums over the matches of each pair, made where the matches are."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.runtime import stored

CHUNK = 1 << 16  # rows in hand at a time


class Spread:
    """Rows of doubles by key, stored in the shared folder; the driver holds the keys only.

    A key's rows may lie in any number of tasks. Parts are combined in the order of their tasks.
    """

    def __init__(self, rows: DataFrame, keys: list[str], values: list[str]):
        self.keys = [tuple(r) for r in rows.select(*keys).distinct().orderBy(*keys).collect()]
        types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
        numbers = rows.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(self.keys)], f"{types}, _key int")
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
        both = rows.alias("r").join(F.broadcast(numbers.alias("n")), same)  # the keys, which the driver holds too
        self.rows = stored(both.select("_key", *(F.col(f"r.{v}").cast("double").alias(v) for v in values)))

    @classmethod
    def of(cls, keys: list[tuple], rows: DataFrame) -> Spread:
        """Stored rows whose first column, ``_key``, has the places of their keys."""
        out = cls.__new__(cls)
        out.keys, out.rows = keys, rows
        return out

    def each(self, work: Callable[[int, np.ndarray], np.ndarray], combine: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
        """For each key ``work`` of its number and rows; what parts of them give is combined."""

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for rows in _chunks(batches):
                rows = rows[np.argsort(rows[:, 0], kind="stable")]
                for own in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
                    key = int(own[0, 0])
                    new = work(key, own[:, 1:])
                    found[key] = combine(found[key], new) if key in found else new
            task = TaskContext.get().partitionId()
            for key, value in found.items():
                yield pa.RecordBatch.from_pydict({"_key": pa.array([key], pa.int32()), "task": pa.array([task], pa.int32()), "value": [pickle.dumps(value)]})

        def whole(table: pa.Table) -> pa.Table:
            values = [pickle.loads(v) for v in table.sort_by("task")["value"].to_pylist()]
            out = values[0]
            for v in values[1:]:
                out = combine(out, v)
            return pa.table({"_key": table["_key"][:1], "value": [pickle.dumps(out)]})

        made = self.rows.mapInArrow(parts, "_key int, task int, value binary").groupBy("_key").applyInArrow(whole, "_key int, value binary")
        got = {r["_key"]: pickle.loads(r["value"]) for r in made.collect()}
        return [got[k] for k in range(len(self.keys))]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    held, number = [], 0
    for batch in batches:
        held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]))
        number += batch.num_rows
        if number >= CHUNK:
            yield np.concatenate(held)
            held, number = [], 0
    if number:
        yield np.concatenate(held)
