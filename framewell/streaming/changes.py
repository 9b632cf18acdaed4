"""Change scores of a stream of frames: keyed state holds one frame for each medium.

Frames of a micro-batch are scored in frame order. A frame that isn't after its medium's
last one is flagged late and not scored, so each score compares frames in order. Results
equal the batch scores when no frame is late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "media_id string, frame int, previous_frame int, t double, score double, normalized double, flags array<string>"
STATE = "frame int, data binary"


def score(before: bytes, now: bytes) -> float:
    """Mean absolute difference of two frames of equal size."""
    a, b = (np.frombuffer(x, np.uint8).astype(np.int16) for x in (before, now))
    return int(np.abs(a - b).sum(dtype=np.int64)) / max(len(a), 1)


def change_stream(frames: DataFrame) -> DataFrame:
    """``frames``: a streaming DataFrame of media_id, frame, t and data."""

    def step(key, batches: Iterator[pd.DataFrame], state):
        last, data = state.get if state.exists else (None, None)
        pdf = pd.concat([*batches]).sort_values("frame", kind="stable")
        out = []
        for frame, t, now in zip(pdf["frame"], pdf["t"], pdf["data"], strict=True):
            frame, now = int(frame), bytes(now)
            if last is not None and frame <= last:
                out.append((key[0], frame, None, t, None, None, ["LATE_FRAME"]))
                continue
            if last is not None:
                s = score(data, now)
                out.append((key[0], frame, last, t, s, s / 255.0, []))
            last, data = frame, now
        if last is not None:
            state.update((last, data))
        yield pd.DataFrame(out, columns=["media_id", "frame", "previous_frame", "t", "score", "normalized", "flags"]).astype({"previous_frame": "Int32"})

    return frames.select("media_id", "frame", "t", "data").groupBy("media_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def windowed_counts(stream: DataFrame, time: str = "ts", length: str = "10 minutes", hop: str = "5 minutes", late: str = "15 minutes") -> DataFrame:
    """(window start, media_id, n, mean): hopping event-time windows; rows later than the watermark are left out."""
    w = F.window(time, length, hop)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), "media_id").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")).select(F.col("w.start").alias("start"), "media_id", "n", "mean")
