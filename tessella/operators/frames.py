"""Video frame selection over tables: positions along a sweep, and which frames to keep."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.raster import phase_shift

STEP = 1 / 3
WEAK_PEAK = 0.02


def positions(measures: DataFrame, least_peak: float = WEAK_PEAK) -> DataFrame:
    """(video, idx, position): the running sum of shifts; a weak peak carries the last good shift on."""
    order = Window.partitionBy("video").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.coalesce(F.last(F.when(F.col("peak") >= least_peak, F.col("shift")), ignorenulls=True).over(order), F.lit(0.0))
    first = F.row_number().over(Window.partitionBy("video").orderBy("idx")) == 1
    rows = measures.withColumn("velocity", F.when(first, 0.0).otherwise(carried))
    return rows.withColumn("position", F.sum("velocity").over(order)).select("video", "idx", "position")


@dataclass
class Selector:
    """The state of one sweep: where the last kept frame was, and the best one since.

    The first frame is kept. A frame more than ``step`` from the anchor commits the held one, which
    becomes the anchor, and if it is still too far, itself; within the outer half of the step the
    sharpest frame so far is held. What is held at the end is kept too.
    """

    step: float = STEP
    anchor: tuple[float, float] | None = None
    held: tuple[int, float, float, float] | None = None  # index, sharpness, x, y
    last: int | None = None

    def feed(self, index: int, x: float, y: float, sharpness: float) -> list[int]:
        """The indices that this frame makes final. Frames older than the last one fed are passed over."""
        if self.last is not None and index <= self.last:
            return []
        self.last = index
        if self.anchor is None:
            self.anchor = (x, y)
            return [index]
        kept = []
        if self._far(x, y) > self.step:
            if self.held is not None:
                kept.append(self.held[0])
                self.anchor = self.held[2:]
                self.held = None
            if self._far(x, y) > self.step:
                kept.append(index)
                self.anchor = (x, y)
                return kept
        if self._far(x, y) >= self.step / 2 and sharpness > (self.held[1] if self.held else float("-inf")):
            self.held = (index, sharpness, x, y)
        return kept

    def flush(self) -> list[int]:
        out = [self.held[0]] if self.held else []
        self.held = None
        return out

    def _far(self, x: float, y: float) -> float:
        return max(abs(x - self.anchor[0]), abs(y - self.anchor[1]))


def selected(frames: Iterable[tuple[int, float, float, float]], step: float = STEP) -> list[int]:
    selector = Selector(step)
    kept = [i for f in frames for i in selector.feed(*f)]
    return sorted({*kept, *selector.flush()})


def select_frames(frames: DataFrame, step: float = STEP) -> DataFrame:
    """(video, idx) of the kept frames of (video, idx, px, py, sharpness); one sweep per group.

    Sweeps stream through sorted, batch by batch, with the state of one sweep in hand at a time, so
    neither a long sweep nor many need memory.
    """
    dealt = frames.select("video", "idx", "px", "py", "sharpness").repartition("video").sortWithinPartitions("video", "idx")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, selector = None, Selector(step)
        for batch in batches:
            out = []
            for v, i, x, y, s in zip(batch["video"], batch["idx"], batch["px"], batch["py"], batch["sharpness"], strict=True):
                if v != video:
                    out += [(video, k) for k in selector.flush()]
                    video, selector = v, Selector(step)
                out += [(v, k) for k in selector.feed(int(i), float(x), float(y), float(s))]
            yield pd.DataFrame(out, columns=["video", "idx"])
        if video is not None and (rest := selector.flush()):
            yield pd.DataFrame([(video, k) for k in rest], columns=["video", "idx"])

    kind = dealt.schema["video"].dataType.simpleString()
    return dealt.mapInPandas(walk, f"video {kind}, idx long")


def frame_name(stem: Column, index: Column, seconds: Column) -> Column:
    """``<stem>_f<index>_<seconds>s.jpg`` with zeros before."""
    hundredths = F.round(seconds * 100).cast("long")
    return F.format_string("%s_f%04d_%03d.%02ds.jpg", stem, index, F.floor(hundredths / 100), hundredths % 100)


def thinned(rows: DataFrame, by: str, order: str, most: int = 16) -> DataFrame:
    """Every (n / most)-th row of each group, at least every row."""
    turn = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    number = F.count("*").over(Window.partitionBy(by))
    stride = F.greatest(F.lit(1), F.floor(number / most))
    return rows.withColumns({"turn": turn, "stride": stride}).where("turn % stride = 0").drop("turn", "stride")


def latest_events(events: DataFrame) -> DataFrame:
    """The last event (seq) of each stage."""
    return events.groupBy("stage").agg(F.max("seq").alias("seq"), F.max_by("completed", "seq").alias("completed"))


def timeline(events: DataFrame) -> DataFrame:
    """(stage, first, last) in the order in which stages were first seen."""
    return events.groupBy("stage").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min("seq").alias("seen")).orderBy("seen")


def small_frame(pixels: bytes, height: int, width: int, most_side: int) -> np.ndarray:
    """A frame of 8 bits, thinned to at most twice ``most_side``."""
    step = max(1, max(height, width) // most_side)
    return np.ascontiguousarray(np.frombuffer(pixels, np.uint8).reshape(height, width)[::step, ::step])


def frame_measures(before: np.ndarray | None, gray: np.ndarray) -> tuple[float, float, float, float]:
    """(dx, dy, peak, sharpness): the shift against the frame before, in widths of the frame; none without one of its size."""
    now = gray.astype(float)
    lap = now[1:-1, 2:] + now[1:-1, :-2] + now[2:, 1:-1] + now[:-2, 1:-1] - 4 * now[1:-1, 1:-1]
    shift = phase_shift(before.astype(float), now) if before is not None and before.shape == now.shape else (0.0, 0.0, 0.0)
    return -shift[0] / now.shape[1], -shift[1] / now.shape[1], shift[2], float(lap.var())


def measure_frames(images: DataFrame, most_side: int = 320) -> DataFrame:
    """(video, idx, dx, dy, peak, sharpness) of gray frames (video, idx, height, width, pixels of 8 bits).

    A frame's shift is against the one before it in its video, in widths of the frame; only that
    one is kept in hand. The first frame has no shift.
    """
    dealt = images.select("video", "idx", "height", "width", "pixels").repartition("video").sortWithinPartitions("video", "idx")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video = before = None
        for batch in batches:
            out = []
            for v, i, h, w, p in zip(batch["video"], batch["idx"], batch["height"], batch["width"], batch["pixels"], strict=True):
                gray = small_frame(p, h, w, most_side)
                out.append((v, i, *frame_measures(before if v == video else None, gray)))
                video, before = v, gray
            yield pd.DataFrame(out, columns=["video", "idx", "dx", "dy", "peak", "sharpness"])

    kind = dealt.schema["video"].dataType.simpleString()
    return dealt.mapInPandas(walk, f"video {kind}, idx long, dx double, dy double, peak double, sharpness double")
