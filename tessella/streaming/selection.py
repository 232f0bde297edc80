"""Frame selection and pair matching over streams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.frames import STEP, WEAK_PEAK, Selector, frame_measures, small_frame

_STATE = "anchored boolean, ax double, ay double, held long, sharpness double, hx double, hy double, last long"


def select_stream(frames: DataFrame, step: float = STEP) -> DataFrame:
    """(video, idx) of kept frames of a stream (video, idx, px, py, sharpness, ended).

    State per video: the anchor, the held frame, and the last index. A micro-batch's frames are
    taken in order of idx; frames at or before the last index are dropped. A row with ``ended``
    set closes the sweep: the held frame is kept and the state goes.
    """

    def feed(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        selector = Selector(step)
        if state.exists:
            anchored, ax, ay, held, sharpness, hx, hy, last = state.get
            selector.anchor = (ax, ay) if anchored else None
            selector.held = (held, sharpness, hx, hy) if held >= 0 else None
            selector.last = last if last >= 0 else None
        rows = pd.concat(list(batches)).sort_values(["ended", "idx"])
        kept: list[int] = []
        for i, x, y, s, ended in zip(rows["idx"], rows["px"], rows["py"], rows["sharpness"], rows["ended"], strict=True):
            kept += selector.flush() if ended else selector.feed(int(i), float(x), float(y), float(s))
        if bool(rows["ended"].any()):
            state.remove()
        else:
            anchor, held = selector.anchor, selector.held or (-1, 0.0, 0.0, 0.0)
            state.update((anchor is not None, *(anchor or (0.0, 0.0)), *held, -1 if selector.last is None else selector.last))
        yield pd.DataFrame({"video": [key[0]] * len(kept), "idx": kept})

    kind = frames.schema["video"].dataType.simpleString()
    return frames.groupBy("video").applyInPandasWithState(feed, f"video {kind}, idx long", _STATE, "append", GroupStateTimeout.NoTimeout)


_MEASURED = "frame binary, height int, width int, vx double, vy double, x double, y double, last long"


def measure_stream(images: DataFrame, most_side: int = 320, least_peak: float = WEAK_PEAK) -> DataFrame:
    """(video, idx, px, py, peak, sharpness, ended) of a stream of gray frames (video, idx, height, width, pixels, ended).

    State per video: the thinned frame before, the speed and the position. A micro-batch's frames are taken in order of idx,
    those at or before the last index are dropped. A shift without a clear peak is replaced by the speed. A row with ``ended``
    set (and no pixels) closes the sweep and is passed on.
    """

    def feed(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, vx, vy, x, y, last = None, 0.0, 0.0, 0.0, 0.0, -1
        if state.exists:
            frame, h, w, vx, vy, x, y, last = state.get
            before = np.frombuffer(frame, np.uint8).reshape(h, w) if h else None
        rows = pd.concat(list(batches)).sort_values(["ended", "idx"])
        out = []
        for i, h, w, p, ended in zip(rows["idx"], rows["height"], rows["width"], rows["pixels"], rows["ended"], strict=True):
            if ended:
                out.append((key[0], int(i), x, y, 0.0, 0.0, True))
            elif i > last:
                gray = small_frame(bytes(p), int(h), int(w), most_side)
                dx, dy, peak, sharpness = frame_measures(before, gray)
                if before is not None and peak >= least_peak:
                    vx, vy = dx, dy
                if before is not None:
                    x, y = x + vx, y + vy
                before, last = gray, int(i)
                out.append((key[0], last, x, y, peak, sharpness, False))
        if bool(rows["ended"].any()):
            state.remove()
        else:
            h, w = before.shape if before is not None else (0, 0)
            state.update((before.tobytes() if before is not None else b"", h, w, vx, vy, x, y, last))
        yield pd.DataFrame(out, columns=["video", "idx", "px", "py", "peak", "sharpness", "ended"])

    kind = images.schema["video"].dataType.simpleString()
    return images.groupBy("video").applyInPandasWithState(feed, f"video {kind}, idx long, px double, py double, peak double, sharpness double, ended boolean", _MEASURED, "append", GroupStateTimeout.NoTimeout)


def early_pairs(extractions: DataFrame, pairs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Pairs (a, b) of a static list as soon as both photos of a stream (image, at) have been seen.

    Photos of a pair that come more than ``delay`` apart don't meet: their state has gone. The list is broadcast only
    where the planner finds it small.
    """
    seen = extractions.withWatermark("at", delay)
    left = seen.select(F.col("image").alias("a"), F.col("at").alias("at_a")).join(pairs, "a")
    right = extractions.withWatermark("at", delay).select(F.col("image").alias("b"), F.col("at").alias("at_b"))
    near = F.expr(f"at_b BETWEEN at_a - INTERVAL {delay} AND at_a + INTERVAL {delay}")
    return left.alias("l").join(right.alias("r"), (F.col("l.b") == F.col("r.b")) & near).select("a", F.col("l.b").alias("b"))
