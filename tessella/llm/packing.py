"""Best-fit packing into bins of several permitted lengths.

Pieces of one length are alike, so the packing is found over counts by length: a table as long as
the largest bin, whatever the input. Lengths go from long to short; each piece goes to the open
bin with the least room that it fits in, and where none has room the bin of the least cost per
token is opened. Bins that are alike are handled together as a range. This is done for every set
of permitted sizes that holds the largest, each bin is then downsized to the least size that
holds its contents, and the plan of the least total cost is taken. Rows find their places by
their rank within their length, so nothing but counts is gathered.

Defined cases: a text longer than the largest bin is cut into pieces, none dropped; a text without
words is one piece of length 0 outside any bin (null bin_id); null texts count as empty; repeated
rows are packed one by one; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.mixing import word_count
from tessella.llm.ranking import ranked

CAPACITIES = (512, 1024, 2048, 4096)


def sequence_cost(capacity: int) -> float:
    """The cost of a sequence: a fixed part, one part per token, one with the square of its length."""
    return 64.0 + capacity + capacity * capacity / 16384.0


@dataclass
class Plan:
    """Where pieces go. ``runs``: (length, first rank, pieces, first bin, pieces a bin, offset)."""

    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    bins: list[tuple[int, int, int]] = field(default_factory=list)  # (first bin, bins, capacity)
    cost: float = 0.0


class _Rooms:
    """Open bins by the room they have; the bits of a number tell which rooms occur."""

    def __init__(self) -> None:
        self.by_room: dict[int, deque] = defaultdict(deque)
        self.bits = 0

    def add(self, room: int, first: int, count: int, used: int) -> None:
        if count:
            self.by_room[room].append((first, count, used))
            self.bits |= 1 << room

    def least(self, length: int) -> int | None:
        above = self.bits >> length
        return length + (above & -above).bit_length() - 1 if above else None

    def take(self, room: int) -> tuple[int, int, int]:
        own = self.by_room[room].popleft()
        if not self.by_room[room]:
            self.bits &= ~(1 << room)
        return own


def _packed(counts: Sequence[tuple[int, int]], sizes: Sequence[int], permitted: Sequence[int], cost: Callable[[int], float]) -> Plan:
    """Best fit in falling order of length; bins are opened in ``sizes`` and end in ``permitted``."""
    plan, rooms, opened = Plan(), _Rooms(), 0
    left = sum(length * n for length, n in counts)
    for length, n in counts:
        rank = 0
        while rank < n:
            room = rooms.least(length)
            if room is None:
                fitting = [c for c in sizes if c >= length]
                size = min(fitting, key=lambda c: (cost(c) / min(c, left), -c))
                each = size // length
                # as long as enough is left to fill any bin, the choice stays the same
                many = max(1, min((n - rank) // each, (left - sizes[-1]) // (each * length)))
                rooms.add(size, opened, many, 0)
                opened += many
                room = size
            first, count, used = rooms.take(room)
            each = room // length
            full = min(count, (n - rank) // each)
            if full:
                plan.runs.append((length, rank, full * each, first, each, used))
                rooms.add(room - each * length, first, full, used + each * length)
                rank += full * each
            rest = n - rank if full < count else 0
            rest = min(rest, each - 1)
            if rest:
                plan.runs.append((length, rank, rest, first + full, rest, used))
                rooms.add(room - rest * length, first + full, 1, used + rest * length)
                rank += rest
            rooms.add(room, first + full + bool(rest), count - full - bool(rest), used)
            left -= (full * each + rest) * length
    for groups in rooms.by_room.values():
        for first, count, used in groups:
            size = next(c for c in permitted if c >= used)
            plan.bins.append((first, count, size))
            plan.cost += count * cost(size)
    plan.bins.sort()
    return plan


def best_plan(counts: dict[int, int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> Plan:
    """The cheapest plan over all sets of sizes to open; ``counts`` has the pieces of each length."""
    permitted = sorted(set(capacities))
    ordered = sorted(((length, n) for length, n in counts.items() if length > 0 and n), reverse=True)
    if ordered and ordered[0][0] > permitted[-1]:
        raise ValueError("a piece is longer than the largest bin")
    smaller = permitted[:-1]
    tried = ([*some, permitted[-1]] for k in range(len(smaller) + 1) for some in combinations(smaller, k))
    return min((_packed(ordered, sizes, permitted, cost) for sizes in tried), key=lambda p: p.cost)


def pieces_of(docs: DataFrame, largest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length): the words of each text in pieces of at most ``largest``."""
    sized = docs.select(F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"))
    last = F.greatest(F.ceil(F.col("size") / largest) - 1, F.lit(0))
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return cut.select("id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.lit(largest), F.col("size") - F.col("piece") * largest).cast("long").alias("length"))


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, bin_id, bin_capacity, and its offset in the bin."""
    pieces = pieces_of(docs, max(capacities), id_col, text_col)
    rows, _ = ranked(pieces, "length", ["id", "piece"])
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # as many as lengths
    plan = best_plan(counts, capacities, cost)
    runs = np.array(sorted(plan.runs), dtype=np.int64).reshape(-1, 6)
    bins = np.array(plan.bins, dtype=np.int64).reshape(-1, 3)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = runs[:, 0] * (1 << 44) + runs[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            number = size = offset = np.zeros(len(length), dtype=np.int64)
            if len(runs):
                run = runs[np.maximum(np.searchsorted(place, length * (1 << 44) + rank, side="right") - 1, 0)]
                nth, among = np.divmod(rank - run[:, 1], run[:, 4])
                number = run[:, 3] + nth
                size = bins[np.maximum(np.searchsorted(bins[:, 0], number, side="right") - 1, 0), 2]
                offset = run[:, 5] + among * length
            own = [pa.array(x, mask=length <= 0) for x in (number, size, offset)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *own], names=["id", "piece", "start", "length", "bin_id", "bin_capacity", "offset"])

    kind = pieces.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(placed, f"id {kind}, piece long, start long, length long, bin_id long, bin_capacity long, offset long")
    return found.withColumnRenamed("id", id_col)
