"""Display pictures from numeric ones; never returned as data."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import require
from ..functions.color import heat
from .aggregate import percentiles
from .sampling import CHANNELS


def stretch(df: DataFrame, by: Sequence[str], columns: Sequence[str], low: float = 1.0, high: float = 99.0) -> DataFrame:
    """Values as 0-255 between two percentiles taken over all columns together; flat pictures are 128."""
    require(0 <= low < high <= 100, "OPERATOR_CONFIG_INVALID", "0 <= low < high <= 100")
    long = df.select(*by, F.explode(F.array(*columns)).alias("_v"))
    lo = percentiles(long, by, ["_v"], low).select(*by, F.col("_v").alias("_lo"))
    hi = percentiles(long, by, ["_v"], high).select(*by, F.col("_v").alias("_hi"))
    out = df.join(lo.join(hi, [*by]), [*by])
    span = F.col("_hi") - F.col("_lo")
    unit = lambda c: F.least(F.greatest((F.col(c) - F.col("_lo")) / span, F.lit(0.0)), F.lit(1.0))
    return out.select(*[F.when(span < 1e-12, 128).otherwise(F.floor(unit(c) * 255.0 + 0.5)).cast("int").alias(c) if c in columns else F.col(c) for c in df.columns])


def automatic(df: DataFrame, by: Sequence[str], columns: Sequence[str], time: str = "frame", codes: bool = False) -> DataFrame:
    """The default picture of a table: the first slice of its time axis, if it has one, as 0-255.

    Code values (``codes``) stay; others go between the 1st and 99th percentile of the slice,
    cut to whole numbers; a flat slice is 0.
    """
    if time in df.columns:
        first = df.groupBy(*by).agg(F.min(time).alias(time))
        df = df.join(first, [*by, time], "left_semi").drop(time)
    if codes:
        return df
    long = df.select(*by, F.explode(F.array(*columns)).alias("_v"))
    ends = [percentiles(long, by, ["_v"], p).select(*by, F.col("_v").alias(n)) for p, n in ((1.0, "_lo"), (99.0, "_hi"))]
    out = df.join(ends[0].join(ends[1], [*by]), [*by])
    span = F.col("_hi") - F.col("_lo")
    shown = lambda c: F.floor(F.least(F.greatest((F.col(c) - F.col("_lo")) * 255.0 / span, F.lit(0.0)), F.lit(255.0)) + 1e-9)
    return out.select(*[F.when(span <= 0, 0).otherwise(shown(c)).cast("int").alias(c) if c in columns else F.col(c) for c in df.columns])


def compare_heat(px: DataFrame, a: int, b: int, scale: str = "fire") -> DataFrame:
    """(media_id, y, x, r, g, b): the largest channel difference of two frames, scaled by its maximum, on a colour scale."""
    folded = px.where(F.col("frame").isin(a, b)).groupBy("media_id", "y", "x").agg(*[F.max(F.when(F.col("frame") == f, F.struct(*CHANNELS))).alias(n) for f, n in ((a, "p"), (b, "q"))])
    d = folded.where("p IS NOT NULL AND q IS NOT NULL").select("media_id", "y", "x", F.greatest(*[F.abs(F.col(f"p.{c}") - F.col(f"q.{c}")) for c in CHANNELS]).alias("d"))
    most = d.groupBy("media_id").agg(F.max("d").alias("most"))
    v = F.when(F.col("most") > 0, F.floor(F.col("d") * (255.0 / F.col("most")) + 0.5)).otherwise(0).cast("double")
    return d.join(most, "media_id").withColumn("c", heat(v, scale)).select("media_id", "y", "x", "c.r", "c.g", "c.b")


def destripe(df: DataFrame, by: Sequence[str], column: str = "v") -> DataFrame:
    """Value minus the means of its column and row plus that of its picture."""
    mean = lambda *k: F.avg(column).over(Window.partitionBy(*by, *k))
    return df.select(*[(F.col(column) - mean("x") - mean("y") + mean()).alias(column) if c == column else F.col(c) for c in df.columns])


def box_smooth(df: DataFrame, width: int, height: int, n: int, by: Sequence[str] = ("media_id",)) -> DataFrame:
    """Mean of the n x n box at each pixel, the picture's edges repeated; below 2 nothing changes.

    Separable: each pass sends a value to the at most n places whose box holds it, with the
    number of times that the repeated edge counts, so work grows with n, not its square.
    """
    require(0 <= n <= 64, "OPERATOR_CONFIG_INVALID", "smooth is 0 to 64")
    if n < 2:
        return df.select(*by, "y", "x", F.col("v").cast("double").alias("v"))
    before = n // 2

    def along(d: DataFrame, axis: str, other: str, size: int) -> DataFrame:
        offs = F.explode(F.sequence(F.lit(-before), F.lit(n - 1 - before)))
        clamp = lambda e: F.least(F.greatest(e, F.lit(0)), F.lit(size - 1))
        # place p reads clamp(p + o); turned round: value at q goes to each p with clamp(p + o) = q
        places = d.sparkSession.range(size).select(F.col("id").cast("int").alias("_p"), offs.alias("_o")).select("_p", clamp(F.col("_p") + F.col("_o")).alias(axis)).groupBy("_p", axis).agg(F.count(F.lit(1)).alias("_w"))
        met = d.join(F.broadcast(places), axis)  # size x n rows of whole numbers at most
        return met.groupBy(*by, other, F.col("_p").alias(axis)).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))

    out = along(along(df, "x", "y", width), "y", "x", height)
    return out.select(*by, "y", "x", (F.col("v") / (n * n)).alias("v"))


def upscale(df: DataFrame, scale: int) -> DataFrame:
    """Each pixel as a square of scale x scale."""
    require(scale >= 1, "INVALID_RANGE", "scale must be 1 or more")
    k = F.sequence(F.lit(0), F.lit(scale - 1))
    out = df.withColumn("_i", F.explode(k)).withColumn("_j", F.explode(k))
    return out.select(*[(F.col("y") * scale + F.col("_i")).alias("y") if c == "y" else (F.col("x") * scale + F.col("_j")).alias("x") if c == "x" else F.col(c) for c in df.columns])


def fit_within(width: int, height: int, most_w: int, most_h: int) -> tuple[int, int]:
    """Size that fits, never larger than the picture."""
    f = min(1.0, most_w / width, most_h / height)
    return max(1, int(width * f)), max(1, int(height * f))


def sheet_layout(count: int, width: int, height: int, gap: int = 2, label: int = 14) -> tuple[int, int, list[tuple[int, int]]]:
    """(sheet width, height, top-left of each picture): near-square, gap between pictures, a label bar under each."""
    require(count >= 1, "INVALID_RANGE", "a sheet needs a picture")
    cols = math.ceil(math.sqrt(count))
    rows = -(-count // cols)
    at = [((k % cols) * (width + gap), (k // cols) * (height + label + gap)) for k in range(count)]
    return cols * (width + gap) - gap, rows * (height + label + gap) - gap, at


def contact_sheet(px: DataFrame, frames: Sequence[int], width: int, height: int, gap: int = 2, label: int = 14) -> DataFrame:
    """Pixels of the sheet of the given frames, in their order."""
    _, _, at = sheet_layout(len(frames), width, height, gap, label)
    spot = F.create_map(*[e for f, (x, y) in zip(frames, at, strict=True) for e in (F.lit(f), F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")))])
    return px.where(F.col("frame").isin([*frames])).withColumn("_s", spot[F.col("frame")]).select("media_id", "frame", (F.col("y") + F.col("_s.y")).alias("y"), (F.col("x") + F.col("_s.x")).alias("x"), "r", "g", "b")
