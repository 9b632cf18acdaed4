"""Change between adjacent frames: differences, scores, events, anomalies and timing flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import require
from .sampling import CHANNELS, Rect, crop

#: Bounds of black, white and flat frames; most anomalies of a scan.
BLACK_MAX, WHITE_MIN, FLAT_STD, ANOMALIES = 16, 240, 2.0, 200


def differences(px: DataFrame, per_second: bool = False) -> DataFrame:
    """Absolute differences of each pixel between adjacent selected frames."""
    w = Window.partitionBy("media_id", "y", "x").orderBy("frame")
    out = px.select("media_id", "frame", "t", "y", "x", F.lag("t").over(w).alias("_t"), *[F.abs(F.col(c) - F.lag(c).over(w)).alias(c) for c in CHANNELS]).where(F.col("_t").isNotNull())
    if per_second:
        dt = F.col("t") - F.col("_t")
        checked = F.when(dt > 0, dt).otherwise(F.raise_error(F.lit("time does not increase between frames")).cast("double"))
        out = out.select("media_id", "frame", "t", "y", "x", *[(F.col(c) / checked).alias(c) for c in CHANNELS])
    return out.drop("_t")


def change_scores(px: DataFrame, point: tuple[int, int] | None = None, rect: Rect | None = None, step: int | None = None) -> DataFrame:
    """(media_id, frame, previous_frame, t, score, normalized): how much each frame differs from the one before.

    A point's score is the sum of its channel differences (of 765); a rectangle's, a grid's
    (every ``step``-th pixel of rectangle or frame) and the whole frame's is their mean (of 255).
    """
    require(point is None or rect is None and step is None, "INVALID_RANGE", "a point stands alone")
    if point:
        px = px.where((F.col("x") == point[0]) & (F.col("y") == point[1]))
    if rect:
        px = crop(px, rect)
    if step:
        x0, y0 = (rect or (0, 0))[:2]
        px = px.where(((F.col("x") - x0) % step == 0) & ((F.col("y") - y0) % step == 0))
    w = Window.partitionBy("media_id", "y", "x").orderBy("frame")
    d = sum((F.abs(F.col(c) - F.lag(c).over(w)) for c in CHANNELS), F.lit(0))
    steps = px.select("media_id", "frame", "t", F.lag("frame").over(w).alias("previous_frame"), d.alias("d")).where(F.col("previous_frame").isNotNull())
    if point:
        return steps.select("media_id", "frame", "previous_frame", "t", F.col("d").cast("double").alias("score"), (F.col("d") / 765.0).alias("normalized"))
    sums = steps.groupBy("media_id", "frame", "previous_frame").agg(F.min("t").alias("t"), F.sum("d").alias("s"), F.count(F.lit(1)).alias("n"))
    score = F.col("s") / (F.col("n") * 3)
    return sums.select("media_id", "frame", "previous_frame", "t", score.alias("score"), (score / 255.0).alias("normalized"))


def top_changes(scores: DataFrame, k: int) -> DataFrame:
    require(k >= 1, "INVALID_RANGE", "k must be 1 or more")
    return scores.orderBy(F.desc("score"), "media_id", "frame").limit(k)


def threshold(scores: DataFrame) -> DataFrame:
    """(media_id, threshold): mean plus three standard deviations of all records but the greatest; a single record's own score."""
    w = Window.partitionBy("media_id").orderBy(F.desc("normalized"), "frame")
    ranked = scores.select("media_id", "normalized", F.row_number().over(w).alias("rank"))
    rest = F.when(F.col("rank") > 1, F.col("normalized"))
    return ranked.groupBy("media_id").agg(F.coalesce(F.avg(rest) + 3 * F.stddev_pop(rest), F.max("normalized")).alias("threshold"))


def events(scores: DataFrame, limit: float | None = None, min_gap: int = 1, min_records: int = 1) -> DataFrame:
    """Runs of records over the threshold, at most ``min_gap`` records apart.

    An event starts at the frame before its first record; its peak is its highest record, the
    earlier of equal ones.
    """
    require(min_gap >= 1 and min_records >= 1, "INVALID_RANGE", "min_gap and min_records must be 1 or more")
    order = Window.partitionBy("media_id").orderBy("frame")
    numbered = scores.withColumn("i", F.row_number().over(order)).withColumn("previous_t", F.coalesce(F.lag("t").over(order), F.col("t")))
    over = numbered.where(F.col("normalized") > limit) if limit is not None else numbered.join(threshold(scores), "media_id").where(F.col("normalized") > F.col("threshold"))
    first = F.when(F.col("i") - F.lag("i").over(order) <= min_gap, 0).otherwise(1)
    runs = over.withColumn("first", first).withColumn("event", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    best = F.struct(F.col("normalized"), -F.col("frame"))
    out = runs.groupBy("media_id", "event").agg(
        F.min("previous_frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.max_by("frame", best).alias("peak_frame"), F.max_by("score", best).alias("peak_score"),
        F.max("normalized").alias("peak_normalized"), F.avg("normalized").alias("mean_normalized"), F.count(F.lit(1)).alias("record_count"),
    )
    return out.where(F.col("record_count") >= min_records)


def frame_kinds(px: DataFrame) -> DataFrame:
    """(media_id, frame, t, kind): black, white, flat or null, in this order."""
    v = F.explode(F.array(*CHANNELS))
    long = px.select("media_id", "frame", "t", v.alias("v"))
    n, s, q = F.count(F.lit(1)), F.sum("v"), F.sum(F.col("v") * F.col("v"))
    g = long.groupBy("media_id", "frame").agg(F.min("t").alias("t"), F.max("v").alias("hi"), F.min("v").alias("lo"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("sd"))
    return g.select("media_id", "frame", "t", F.when(F.col("hi") < BLACK_MAX, "black").when(F.col("lo") > WHITE_MIN, "white").when(F.col("sd") < FLAT_STD, "flat").alias("kind"))


def anomalies(px: DataFrame, cap: int = ANOMALIES) -> DataFrame:
    """(media_id, ordinal, kind, frame): odd frames by frame, then flashes (events of one or two records); the first ``cap`` of each medium."""
    odd = frame_kinds(px).where("kind is not null").select("media_id", F.lit(0).alias("part"), "kind", "frame")
    flash = events(change_scores(px)).where("record_count <= 2").select("media_id", F.lit(1).alias("part"), F.lit("flash").alias("kind"), F.col("peak_frame").alias("frame"))
    w = Window.partitionBy("media_id").orderBy("part", "frame")
    return odd.unionByName(flash).withColumn("ordinal", F.row_number().over(w)).where(F.col("ordinal") <= cap).select("media_id", "ordinal", "kind", "frame")


def irregular(frame_table: DataFrame) -> DataFrame:
    """(media_id, frames, irregular): whether intervals differ by more than a tenth of their mean."""
    w = Window.partitionBy("media_id").orderBy("frame")
    d = frame_table.select("media_id", (F.col("t") - F.lag("t").over(w)).alias("d"))
    return d.groupBy("media_id").agg(F.count(F.lit(1)).alias("frames"), F.coalesce((F.count("d") >= 2) & (F.max("d") - F.min("d") > 0.1 * F.avg("d")), F.lit(False)).alias("irregular"))


def timing(packets: DataFrame, num: int, den: int, fps: float | None = None) -> DataFrame:
    """Timeline and flags of decoded packets (media_id, frame, pts, duration_pts).

    Time counts from the first stamp and isn't negative; where stamps are missing it is
    estimated from the rate, or is the frame's number. A missing duration is the distance to
    the next stamp, if that is positive.
    """
    w = Window.partitionBy("media_id").orderBy("frame")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seconds: Column = (F.col("pts") - F.first("pts", ignorenulls=True).over(every)) * num / den
    before = F.last("pts", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.lead("pts").over(w) - F.col("pts")
    guess = F.col("frame") / fps if fps else F.col("frame").cast("double")
    t = F.when(F.col("pts").isNull(), guess).otherwise(F.greatest(seconds, F.lit(0.0)))
    flags = F.array_compact(F.array(
        F.when(F.col("pts").isNull(), "PTS_MISSING"), F.when(F.col("pts") == before, "PTS_DUPLICATE"), F.when(F.col("pts") < before, "PTS_NON_MONOTONIC"),
        F.when(seconds < 0, "TIMELINE_NEGATIVE_NORMALIZED"), F.when(F.col("pts").isNull(), "TIMELINE_ESTIMATED_FROM_FPS" if fps else "TIMELINE_ESTIMATED_FROM_INDEX"),
    ))
    return packets.select("media_id", "frame", "pts", F.round(t, 6).alias("t"), F.coalesce("duration_pts", F.when(gap > 0, gap)).alias("duration_pts"), flags.alias("flags"))


def frame_count(indexed: int | None, container: int | None, duration: float | None, fps: float | None) -> tuple[int | None, bool]:
    """(frames, estimated) from the first source that knows."""
    if indexed:
        return indexed, False
    if container:
        return container, False
    if duration and fps:
        return round(duration * fps), True
    return None, True


def duration(stream: Column, container: Column, start: Column) -> Column:
    """Seconds from a medium's first moment: the stream's own, else the container's less a positive start before its end."""
    return F.coalesce(stream, F.when((start > 0) & (container > start), container - start).otherwise(container))


def coarse_vfr(average: float | None, base: float | None) -> bool:
    return bool(average and base and abs(average - base) / base > 1e-3)
