"""Dense optical flow between frame pairs. The estimator needs an optional library; statistics and compensation don't."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import fail
from ..functions import color

#: Fixed values of the estimator.
FARNEBACK = {"pyr_scale": 0.5, "levels": 3, "winsize": 15, "iterations": 3, "poly_n": 5, "poly_sigma": 1.2, "flags": 0}


def library():
    try:
        import cv2
    except ImportError:
        raise fail("DEPENDENCY_MISSING", "optical flow needs the cv2 library", "install OpenCV's Python package") from None
    return cv2


def farneback(frames: DataFrame, accumulate: bool = False) -> DataFrame:
    """(media_id, frame, y, x, dx, dy) from each frame to the next; ``accumulate`` sums them per pixel.

    ``frames``: media_id, frame, height, width and data, the gray picture's bytes.
    """
    library()
    w = Window.partitionBy("media_id").orderBy("frame")
    pairs = frames.withColumn("next", F.lead("data").over(w)).where("next is not null")

    def step(batches):
        cv2 = library()
        for batch in batches:
            for r in batch.to_pylist():
                shape = (r["height"], r["width"])
                a, b = (np.frombuffer(r[k], np.uint8).reshape(shape) for k in ("data", "next"))
                f = cv2.calcOpticalFlowFarneback(a, b, None, *FARNEBACK.values())
                y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
                n = f.shape[0] * f.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([r["media_id"]] * n), pa.array([r["frame"]] * n, pa.int32()), pa.array(y.ravel(), pa.int32()), pa.array(x.ravel(), pa.int32()), pa.array(f[..., 0].ravel().astype(float)), pa.array(f[..., 1].ravel().astype(float))], ["media_id", "frame", "y", "x", "dx", "dy"])

    out = pairs.select("media_id", "frame", "height", "width", "data", "next").mapInArrow(step, "media_id string, frame int, y int, x int, dx double, dy double")
    if accumulate:
        out = out.groupBy("media_id", "y", "x").agg(F.min("frame").alias("frame"), F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))
    return out


def flow_summary(flow: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Magnitudes, the moving area's bounding box and its direction; no direction if the mean vector is 0.05 or shorter."""
    m = F.hypot("dx", "dy")
    hit = m > threshold
    x, y = F.when(hit, F.col("x")), F.when(hit, F.col("y"))
    mx, my = F.avg(F.when(hit, F.col("dx"))), F.avg(F.when(hit, F.col("dy")))
    return flow.groupBy("media_id", "frame").agg(
        F.avg(m).alias("mean_magnitude"), F.max(m).alias("max_magnitude"), F.percentile(m, 0.95).alias("p95_magnitude"), F.count_if(hit).alias("moving"),
        F.min(x).alias("box_x"), F.min(y).alias("box_y"), (F.max(x) - F.min(x) + 1).alias("box_w"), (F.max(y) - F.min(y) + 1).alias("box_h"),
        F.when(F.hypot(mx, my) > 0.05, F.degrees(F.atan2(my, mx))).alias("direction"),
    )


def global_motion(flow: DataFrame) -> DataFrame:
    """(media_id, frame, dx, dy, a, b): the least-squares similarity x' = a x - b y + dx, y' = b x + a y + dy of the field.

    A closed form from sums, so it aggregates before the shuffle; it isn't a robust estimate.
    """
    X, Y = F.col("x"), F.col("y")
    tx, ty = X + F.col("dx"), Y + F.col("dy")
    n = F.count(F.lit(1))
    s = flow.groupBy("media_id", "frame").agg(n.alias("n"), F.sum(X).alias("x"), F.sum(Y).alias("y"), F.sum(tx).alias("u"), F.sum(ty).alias("v"), F.sum(X * X + Y * Y).alias("q"), F.sum(X * tx + Y * ty).alias("p"), F.sum(X * ty - Y * tx).alias("c"))
    d = F.col("q") - (F.col("x") * F.col("x") + F.col("y") * F.col("y")) / F.col("n")
    a = F.when(d > 0, (F.col("p") - (F.col("x") * F.col("u") + F.col("y") * F.col("v")) / F.col("n")) / d).otherwise(1.0)
    b = F.when(d > 0, (F.col("c") - (F.col("x") * F.col("v") - F.col("y") * F.col("u")) / F.col("n")) / d).otherwise(0.0)
    s = s.withColumn("a", a).withColumn("b", b)
    return s.select("media_id", "frame", ((F.col("u") - F.col("a") * F.col("x") + F.col("b") * F.col("y")) / F.col("n")).alias("dx"), ((F.col("v") - F.col("b") * F.col("x") - F.col("a") * F.col("y")) / F.col("n")).alias("dy"), "a", "b")


def compensate(flow: DataFrame, motion: DataFrame) -> DataFrame:
    """The field without the global motion."""
    m = motion.select("media_id", "frame", F.col("dx").alias("_dx"), F.col("dy").alias("_dy"), "a", "b")
    j = flow.join(m, ["media_id", "frame"])
    gx = (F.col("a") - 1) * F.col("x") - F.col("b") * F.col("y") + F.col("_dx")
    gy = F.col("b") * F.col("x") + (F.col("a") - 1) * F.col("y") + F.col("_dy")
    return j.select("media_id", "frame", "y", "x", (F.col("dx") - gx).alias("dx"), (F.col("dy") - gy).alias("dy"))


def _shown(flow: DataFrame) -> DataFrame:
    """``flow`` with ``_m``: its magnitude as 0-255, scaled by the greatest of its frame."""
    m = F.hypot("dx", "dy")
    most = flow.groupBy("media_id", "frame").agg(F.max(m).alias("_most"))
    value = F.when(F.col("_most") > 1e-9, F.floor(F.least(m * 255.0 / F.col("_most"), F.lit(255.0)) + 1e-9)).otherwise(0)
    return flow.join(most, ["media_id", "frame"]).withColumn("_m", value.cast("double"))


def magnitude_preview(flow: DataFrame) -> DataFrame:
    """(media_id, frame, y, x, r, g, b): magnitudes on the fire scale."""
    return _shown(flow).withColumn("c", color.heat(F.col("_m"))).select("media_id", "frame", "y", "x", "c.r", "c.g", "c.b")


def direction_preview(flow: DataFrame) -> DataFrame:
    """(media_id, frame, y, x, r, g, b): the direction as hue, in steps of two degrees, the magnitude as value."""
    hue = F.floor(F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(360.0)) / 2) * 2
    return _shown(flow).withColumn("c", color.from_hsv(hue, F.lit(1.0), F.col("_m") / 255.0)).select("media_id", "frame", "y", "x", "c.r", "c.g", "c.b")
