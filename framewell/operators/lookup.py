"""As-of lookups, frame pairs, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import require
from .sampling import CHANNELS


def as_of(frames: DataFrame, probes: DataFrame) -> DataFrame:
    """(media_id, probe_id, at, frame): the last frame at or before each probe's time; before the first, the first.

    Frames and probes are merged and sorted by time within a medium, and the last frame is
    carried forward; the first frame is one minimum of the medium. One shuffle, no range
    join, and no frame that is counted anew for each row.
    """
    a = frames.select("media_id", F.col("t").alias("at"), F.lit(0).alias("kind"), "frame", F.lit(None).cast("bigint").alias("probe_id"))
    b = probes.select("media_id", "at", F.lit(1).alias("kind"), F.lit(None).cast(frames.schema["frame"].dataType).alias("frame"), F.col("probe_id").cast("bigint"))
    w = Window.partitionBy("media_id").orderBy("at", "kind", "frame")
    first = F.min(F.when(F.col("frame").isNotNull(), F.struct("at", "frame"))).over(Window.partitionBy("media_id"))
    found = F.coalesce(F.last("frame", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), first["frame"])
    return a.unionByName(b).withColumn("found", found).where("kind = 1").select("media_id", "probe_id", "at", F.col("found").alias("frame"))


def frame_range(frames: DataFrame, start: float, end: float) -> DataFrame:
    """(media_id, first, last, total): the closed frame range of a closed time range."""
    require(start <= end, "INVALID_RANGE", "start is after end")
    eps = 1e-6
    pick = lambda at: F.coalesce(F.max_by("frame", F.when(F.col("t") <= at + eps, F.col("t"))), F.min("frame"))
    return frames.groupBy("media_id").agg(pick(start).alias("first"), pick(end).alias("last"), F.count(F.lit(1)).alias("total"))


def compare(px: DataFrame, a: int, b: int, threshold: int = 0) -> DataFrame:
    """How two frames of each medium differ: changed pixels (greatest channel difference over the threshold), their share, mean and greatest difference, bounding box.

    Both frames are folded by one aggregate on the pixel; nothing is joined to itself.
    """
    at = lambda c, k: F.max(F.when(F.col("frame") == k, F.col(c)))
    cells = px.where(F.col("frame").isin(a, b)).groupBy("media_id", "y", "x").agg(*[F.abs(at(c, a) - at(c, b)).alias(c) for c in CHANNELS])
    d = F.greatest(*CHANNELS)
    hit = d > threshold
    x, y = F.when(hit, F.col("x")), F.when(hit, F.col("y"))
    return cells.groupBy("media_id").agg(
        F.count_if(hit).alias("changed"), (F.count_if(hit) / F.count(F.lit(1))).alias("changed_ratio"), (F.sum(F.col("r") + F.col("g") + F.col("b")) / (F.count(F.lit(1)) * 3)).alias("mean_diff"),
        F.max(d).alias("max_diff"), F.min(x).alias("box_x"), F.min(y).alias("box_y"), (F.max(x) - F.min(x) + 1).alias("box_w"), (F.max(y) - F.min(y) + 1).alias("box_h"),
    )


def page(df: DataFrame, order: list, offset: int, limit: int) -> tuple[DataFrame, dict]:
    """A page of rows in ``order``, with total, has_more and next_offset."""
    require(offset >= 0 and limit >= 1, "INVALID_RANGE", "offset >= 0 and limit >= 1")
    total = df.count()
    more = offset + limit < total
    return df.orderBy(*order).offset(offset).limit(limit), {"total": total, "has_more": more, "next_offset": offset + limit if more else None}
