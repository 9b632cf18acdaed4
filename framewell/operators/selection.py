"""Temporal selection: predicates over the frame axis, compiled before any pixel is made."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import fail, require

#: Frames that an automatic stride aims at.
AUTO_FRAMES = 1800


@dataclass(frozen=True)
class Selection:
    """``all``, ``frame_interval`` [start, end), ``time_interval`` [start, end) or ``indices``; then every k-th."""

    mode: str = "all"
    start: float | None = None
    end: float | None = None
    indices: tuple[int, ...] = ()
    every: int = 1

    def __post_init__(self):
        require(self.mode in ("all", "frame_interval", "time_interval", "indices"), "TIME_SELECTION_INVALID", f"unknown selection mode {self.mode}")
        require(self.every >= 1, "TIME_SELECTION_INVALID", "every must be 1 or more")
        if self.mode in ("frame_interval", "time_interval"):
            require(self.start is not None and self.end is not None and 0 <= self.start < self.end, "TIME_SELECTION_INVALID", "an interval needs 0 <= start < end")
        if self.mode == "indices":
            require(bool(self.indices) and self.indices[0] >= 0 and all(a < b for a, b in zip(self.indices, self.indices[1:], strict=False)), "TIME_SELECTION_INVALID", "indices must be strictly increasing from 0")


def select(px: DataFrame, s: Selection, frame_table: DataFrame | None = None) -> DataFrame:
    """Rows of the selected frames. Strides of times are by ordinal among the selected frames."""
    if s.mode == "all":
        return px if s.every == 1 else px.where(F.col("frame") % s.every == 0)
    if s.mode == "frame_interval":
        a, z = int(s.start), int(s.end)
        out = px.where((F.col("frame") >= a) & (F.col("frame") < z))
        return out if s.every == 1 else out.where((F.col("frame") - a) % s.every == 0)
    if s.mode == "indices":
        return px.where(F.col("frame").isin([*s.indices[:: s.every]]))
    within = (F.col("t") >= s.start) & (F.col("t") < s.end)
    if s.every == 1:
        return px.where(within)
    ft = (frame_table if frame_table is not None else px.select("media_id", "frame", "t").distinct()).where(within)
    nth = F.row_number().over(Window.partitionBy("media_id").orderBy("frame")) - 1
    chosen = ft.withColumn("_n", nth).where(F.col("_n") % s.every == 0).select("media_id", "frame")
    return px.where(within).join(chosen, ["media_id", "frame"], "left_semi")


def check_frames(s: Selection, count: int) -> None:
    """An interval must lie within ``count`` frames."""
    if s.mode == "frame_interval" and (s.start >= count or s.end > count):
        raise fail("FRAME_OUT_OF_RANGE", f"frames {int(s.start)}..{int(s.end)} are not within 0..{count}")
    if s.mode == "indices" and s.indices[-1] >= count:
        raise fail("FRAME_OUT_OF_RANGE", f"frame {s.indices[-1]} is not within 0..{count}")


def check_any(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise fail("TIME_SELECTION_INVALID", "the selection holds no frame")
    return df


def from_closed(start: int, end: int, every: int = 1) -> Selection:
    """A closed frame range as a half-open selection."""
    require(start <= end, "INVALID_RANGE", "start is after end")
    return Selection("frame_interval", start, end + 1, every=every)


def closed_count(start: int, end: int, every: int = 1) -> int:
    return (end - start) // every + 1


def picks(start: int, end: int, count: int) -> list[int]:
    """Up to ``count`` frames at equal steps from start to end, both included; half-even rounding, each once."""
    require(count >= 1 and start <= end, "INVALID_RANGE", "picks need a count and start <= end")
    if count == 1:
        return [start]
    return [*dict.fromkeys(round(start + (end - start) * i / (count - 1)) for i in range(count))]


def picks_of(bounds: DataFrame, count: int) -> DataFrame:
    """(media_id, frame) of the picks for each row (media_id, start, end)."""
    i = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i")
    f = F.rint(F.col("start") + (F.col("end") - F.col("start")) * F.col("i") / max(count - 1, 1)).cast("int")
    return bounds.select("*", i).select("media_id", f.alias("frame")).distinct()


def auto_stride(count: int) -> int:
    return max(1, math.ceil(count / AUTO_FRAMES))


def auto_stride_col(count: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / AUTO_FRAMES))
