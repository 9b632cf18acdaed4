"""Spatial selection and sampling: projections of pixels onto points, paths, lines and rectangles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import fail, require

#: Points of one request that are sent to every executor.
MAX_POINTS = 65_536
CHANNELS = ("r", "g", "b")
Rect = tuple[int, int, int, int]


def parse_numbers(text: str, n: int) -> tuple[int, ...]:
    """"x,y" or "x,y,w,h"."""
    try:
        out = tuple(int(p) for p in text.split(","))
    except ValueError:
        out = ()
    require(len(out) == n, "INVALID_RANGE", f"{text!r} is not {n} whole numbers")
    return out


def check_rect(rect: Rect, width: int, height: int) -> Rect:
    x, y, w, h = rect
    require(w > 0 and h > 0 and x >= 0 and y >= 0 and x + w <= width and y + h <= height, "COORDINATE_OUT_OF_RANGE", f"rectangle {rect} is not within {width}x{height}")
    return rect


def check_point(x: int, y: int, width: int, height: int) -> None:
    require(0 <= x < width and 0 <= y < height, "COORDINATE_OUT_OF_RANGE", f"point {x},{y} is not within {width}x{height}")


def pixel_id(width: int, x: Column | str = "x", y: Column | str = "y") -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return y * width + x


def from_pixel_id(pid: Column, width: int) -> Column:
    return F.struct((pid % width).alias("x"), F.floor(pid / width).cast("int").alias("y"))


def in_rect(rect: Rect) -> Column:
    x, y, w, h = rect
    return (F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h)


def crop(px: DataFrame, rect: Rect) -> DataFrame:
    return px.where(in_rect(rect))


def grid_points(spark: SparkSession, rect: Rect, step: int) -> DataFrame:
    """(k, x, y), row-major from the rectangle's top-left."""
    require(step >= 1, "INVALID_RANGE", "step must be 1 or more")
    x, y, w, h = rect
    nx, ny = -(-w // step), -(-h // step)
    return spark.range(nx * ny).select(F.col("id").cast("int").alias("k"), (F.lit(x) + F.col("id") % nx * step).cast("int").alias("x"), (F.lit(y) + F.floor(F.col("id") / nx) * step).cast("int").alias("y"))


def point_table(spark: SparkSession, points: Sequence[tuple[float, float]], order: str = "selection") -> DataFrame:
    """(k, x, y) of a request's points, numbered in the order asked for."""
    require(0 < len(points) <= MAX_POINTS, "INVALID_RANGE", f"1 to {MAX_POINTS} points")
    keys = {"selection": None, "yx": lambda p: (p[1], p[0]), "xy": lambda p: p, "pixel-id": lambda p: (p[1], p[0])}
    require(order in keys, "INVALID_RANGE", f"unknown order {order}")
    points = [*points] if keys[order] is None else sorted(points, key=keys[order])
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "k int, x double, y double")


def resample_polyline(points: Sequence[tuple[float, float]], count: int) -> list[tuple[float, float]]:
    """``count`` points at equal arc length along a polyline, ends included."""
    p = np.asarray(points, float)
    require(len(p) >= 2 and count >= 2, "MODEL_VALIDATION_FAILED", "a path needs two points and two samples")
    at = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
    require(at[-1] > 0, "MODEL_VALIDATION_FAILED", "the path has no length")
    want = np.linspace(0, at[-1], count)
    return list(zip(np.interp(want, at, p[:, 0]).tolist(), np.interp(want, at, p[:, 1]).tolist(), strict=True))


def _bounded(points: DataFrame, width: int, height: int, boundary: str) -> DataFrame:
    if boundary == "clip":
        return points.select("k", F.least(F.greatest("x", F.lit(0.0)), F.lit(width - 1.0)).alias("x"), F.least(F.greatest("y", F.lit(0.0)), F.lit(height - 1.0)).alias("y"))
    require(boundary == "error", "OPERATOR_CONFIG_INVALID", "boundary is error or clip")
    if points.where((F.col("x") < 0) | (F.col("x") > width - 1) | (F.col("y") < 0) | (F.col("y") > height - 1)).limit(1).count():
        raise fail("COORDINATE_OUT_OF_RANGE", "a point lies outside the frame")
    return points


def points_t(px: DataFrame, points: DataFrame, width: int, height: int, interpolation: str = "nearest", block: int = 1, boundary: str = "error") -> DataFrame:
    """(media_id, frame, t, k, r, g, b) at each point of each frame.

    The points, at most MAX_POINTS, are broadcast; pixels that no point needs are dropped in
    the join, before any aggregation.
    """
    points = _bounded(points, width, height, boundary)
    if block > 1:
        offs = F.explode(F.sequence(F.lit(0), F.lit(block - 1)))
        cells = points.select("k", F.floor(F.col("x") + 0.5).cast("int").alias("x0"), F.floor(F.col("y") + 0.5).cast("int").alias("y0")).withColumn("dx", offs).withColumn("dy", offs)
        cells = cells.select("k", (F.col("x0") + F.col("dx")).alias("x"), (F.col("y0") + F.col("dy")).alias("y"))
        met = px.join(F.broadcast(cells), ["x", "y"])
        return met.groupBy("media_id", "frame", "k").agg(F.min("t").alias("t"), *[(F.sum(c) / F.count(F.lit(1))).alias(c) for c in CHANNELS]).select("media_id", "frame", "t", "k", *CHANNELS)
    if interpolation == "nearest":
        cells = points.select("k", F.floor(F.col("x") + 0.5).cast("int").alias("x"), F.floor(F.col("y") + 0.5).cast("int").alias("y"))
        return px.join(F.broadcast(cells), ["x", "y"]).select("media_id", "frame", "t", "k", *CHANNELS)
    require(interpolation == "bilinear", "OPERATOR_CONFIG_INVALID", "interpolation is nearest or bilinear")
    fx, fy = F.floor("x").cast("int"), F.floor("y").cast("int")
    corners = F.array(*[F.struct(F.least(fx + i, F.lit(width - 1)).alias("x"), F.least(fy + j, F.lit(height - 1)).alias("y"), ((1 - F.abs(F.lit(i) - (F.col("x") - fx))) * (1 - F.abs(F.lit(j) - (F.col("y") - fy)))).alias("w")) for i in (0, 1) for j in (0, 1)])
    cells = points.select("k", F.explode(corners).alias("c")).select("k", "c.x", "c.y", "c.w").groupBy("k", "x", "y").agg(F.sum("w").alias("w"))
    met = px.join(F.broadcast(cells), ["x", "y"])
    return met.groupBy("media_id", "frame", "k").agg(F.min("t").alias("t"), *[F.sum(F.col(c) * F.col("w")).alias(c) for c in CHANNELS]).select("media_id", "frame", "t", "k", *CHANNELS)


def xt(px: DataFrame, y: int) -> DataFrame:
    """The row ``y`` of every frame."""
    return px.where(F.col("y") == y).select("media_id", "frame", "t", "x", *CHANNELS)


def yt(px: DataFrame, x: int) -> DataFrame:
    """The column ``x`` of every frame."""
    return px.where(F.col("x") == x).select("media_id", "frame", "t", "y", *CHANNELS)


def path_t(px: DataFrame, path: Sequence[tuple[float, float]], width: int, height: int, count: int, interpolation: str = "bilinear", boundary: str = "error") -> DataFrame:
    points = point_table(px.sparkSession, resample_polyline(path, count))
    return points_t(px, points, width, height, interpolation, boundary=boundary)


def timeline(px: DataFrame, points: DataFrame, width: int, height: int, block: int = 1) -> DataFrame:
    """Point-major samples as whole code values; block means are rounded half-even."""
    out = points_t(px, points, width, height, block=block)
    return out.select("media_id", "k", "frame", "t", *[F.rint(c).cast("int").alias(c) for c in CHANNELS])


def cells(tensor: DataFrame, axes: Sequence[str], selection: Sequence[int | slice], shape: Sequence[int]) -> DataFrame:
    """Rows of a long tensor that an array selection takes; out of range is an error, never clipped."""
    require(len(axes) == len(selection) == len(shape), "ARRAY_SELECTION_OUT_OF_RANGE", "one selector for each axis")
    cond = F.lit(True)
    for axis, s, n in zip(axes, selection, shape, strict=True):
        if isinstance(s, slice):
            a, z, k = s.start or 0, n if s.stop is None else s.stop, 1 if s.step is None else s.step
            require(0 <= a <= z <= n and k >= 1, "ARRAY_SELECTION_OUT_OF_RANGE", f"{s} is not within {axis} of {n}")
            cond = cond & (F.col(axis) >= a) & (F.col(axis) < z) & ((F.col(axis) - a) % k == 0)
        else:
            require(0 <= s < n, "ARRAY_SELECTION_OUT_OF_RANGE", f"{s} is not within {axis} of {n}")
            cond = cond & (F.col(axis) == s)
    return tensor.where(cond)
