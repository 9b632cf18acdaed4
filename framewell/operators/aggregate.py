"""Exact aggregates over regions and over time.

Code values are whole numbers, so sums of values and of squares are exact in any order.
Medians and percentiles come from histograms: values are counted before the shuffle and a
group is at most as many rows as it has different values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..errors import require
from ..functions import color
from .sampling import CHANNELS, Rect, crop

REDUCTIONS = ("mean", "min", "max", "median", "std", "rms", "percentile", "diff")


def moment(df: DataFrame, name: str, c: str) -> Column:
    """A streaming reduction of a column of ``df``, with sums that are exact for whole numbers; population standard deviation."""
    v = F.col(c).cast("bigint" if isinstance(df.schema[c].dataType, IntegralType) else "double")
    n = F.count(c)
    mean = F.sum(v) / n
    return {
        "mean": mean,
        "min": F.min(c).cast("double"),
        "max": F.max(c).cast("double"),
        "std": F.sqrt(F.greatest(F.sum(v * v) / n - mean * mean, F.lit(0.0))),
        "rms": F.sqrt(F.sum(v * v) / n),
    }[name]


def percentiles(df: DataFrame, by: Sequence[str], columns: Sequence[str], p: float) -> DataFrame:
    """The exact ``p``-th percentile (0-100, linear interpolation) of each column for each group, by histogram."""
    require(0 <= p <= 100, "OPERATOR_CONFIG_INVALID", "percentile is 0 to 100")
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns])).alias("e")).select(*by, "e.c", "e.v")
    counts = long.groupBy(*by, "c", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by, "c").orderBy("v")
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n").over(Window.partitionBy(*by, "c"))
    placed = counts.select(*by, "c", "v", upto.alias("upto"), total.alias("total")).withColumn("at", (F.col("total") - 1) * (p / 100))
    low, high = F.floor("at"), F.ceil("at")
    pick = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    got = placed.groupBy(*by, "c").agg(pick(low).alias("lo"), pick(high).alias("hi"), F.first(F.col("at") - F.floor("at")).alias("f"))
    got = got.withColumn("q", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("f"))
    return got.groupBy(*by).agg(*[F.max(F.when(F.col("c") == c, F.col("q"))).alias(c) for c in columns])


def reduce_by(df: DataFrame, by: Sequence[str], name: str, columns: Sequence[str] = CHANNELS, percentile: float | None = None) -> DataFrame:
    require(name in REDUCTIONS, "OPERATOR_CONFIG_INVALID", f"unknown reduction {name}")
    require((name == "percentile") == (percentile is not None), "OPERATOR_CONFIG_INVALID", "a percentile is set for the percentile reduction, and for no other")
    if name in ("median", "percentile"):
        return percentiles(df, by, columns, 50.0 if name == "median" else percentile)
    require(name != "diff", "OPERATOR_CONFIG_INVALID", "diff is over time")
    return df.groupBy(*by).agg(*[moment(df, name, c).alias(c) for c in columns])


def roi_t(px: DataFrame, rect: Rect, name: str, percentile: float | None = None) -> DataFrame:
    """One row for each frame: the reduction of the rectangle."""
    return reduce_by(crop(px, rect), ["media_id", "frame"], name, percentile=percentile)


def over_time(px: DataFrame, name: str, rect: Rect | None = None, percentile: float | None = None) -> DataFrame:
    """One row for each pixel: the reduction over time. ``diff`` is the mean absolute step between adjacent frames."""
    if rect:
        px = crop(px, rect)
    by = ["media_id", "y", "x"]
    if name != "diff":
        return reduce_by(px, by, name, percentile=percentile)
    w = Window.partitionBy(*by).orderBy("frame")
    steps = px.select(*by, *[F.abs(F.col(c) - F.lag(c).over(w)).alias(c) for c in CHANNELS]).where(F.col("r").isNotNull())
    return steps.groupBy(*by).agg(*[(F.sum(c) / F.count(c)).alias(c) for c in CHANNELS])


def summary(reduced: DataFrame) -> DataFrame:
    """Least, greatest and mean value of each channel of a reduced picture."""
    return reduced.groupBy("media_id").agg(*[f(c).alias(f"{n}_{c}") for c in CHANNELS for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def region_stats(px: DataFrame, rect: Rect | None = None) -> DataFrame:
    """One row for each frame: count, statistics of the channels, mean HSV and Lab, luminance. Hue is averaged arithmetically."""
    if rect:
        px = crop(px, rect)
    by = ["media_id", "frame"]
    full = px.withColumn("_hsv", color.hsv(*map(F.col, CHANNELS))).withColumn("_lab", color.lab(*map(F.col, CHANNELS))).withColumn("_l", color.luminance(*map(F.col, CHANNELS)))
    stats = full.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pixel_count"),
        *[moment(px, n, c).alias(f"{n}_{c}") for n in ("mean", "min", "max", "std") for c in CHANNELS],
        *[F.avg(f"_hsv.{c}").alias(f"mean_{n}") for c, n in (("h", "hue"), ("s", "saturation"), ("v", "value"))],
        *[F.avg(f"_lab.{c}").alias(f"mean_lab_{c}") for c in "lab"],
        F.avg("_l").alias("mean_luminance"),
        F.stddev_pop("_l").alias("std_luminance"),
    )
    medians = percentiles(px, by, CHANNELS, 50.0).select(*by, *[F.col(c).alias(f"median_{c}") for c in CHANNELS])
    return stats.join(medians, by)


def bounding_box(by: Sequence[str], df: DataFrame, mask: Column) -> DataFrame:
    """(left, top, width, height) of the masked pixels of each group; null where none is."""
    x, y = F.when(mask, F.col("x")), F.when(mask, F.col("y"))
    return df.groupBy(*by).agg(F.min(x).alias("box_x"), F.min(y).alias("box_y"), (F.max(x) - F.min(x) + 1).alias("box_w"), (F.max(y) - F.min(y) + 1).alias("box_h"))


def content_counts(native: DataFrame) -> DataFrame:
    """Counts of transparent, partly transparent and opaque pixels and of alpha levels and palette entries, for each medium.

    ``native``: media_id, alpha (null: none), index (palette index, null: none).
    """
    n = F.count(F.lit(1))
    out = native.groupBy("media_id").agg(
        n.alias("pixels"), F.count_if(F.col("alpha") == 0).alias("transparent"), F.count_if((F.col("alpha") > 0) & (F.col("alpha") < 255)).alias("partial"),
        F.count_if(F.coalesce("alpha", F.lit(255)) == 255).alias("opaque"), F.count_distinct("alpha").alias("alpha_levels"), F.count_distinct("index").alias("palette_used"),
        F.count("alpha").alias("with_alpha"),
    )
    kind = F.when(F.col("with_alpha") == 0, "none").when(F.col("partial") > 0, "continuous").when(F.col("transparent") > 0, "binary").otherwise("explicit_but_opaque")
    ratios = [(F.col(c) / F.col("pixels")).alias(f"{c}_ratio") for c in ("transparent", "partial", "opaque")]
    return out.select("*", *ratios, kind.alias("transparency"))


def alpha_histogram(native: DataFrame) -> DataFrame:
    """(media_id, alpha, n): pixels without alpha count as 255."""
    return native.groupBy("media_id", F.coalesce("alpha", F.lit(255)).alias("alpha")).agg(F.count(F.lit(1)).alias("n"))


def image_flags(content: DataFrame) -> Column:
    """Flags of an image from its counts."""
    gone = F.col("transparent_ratio")
    return F.array_compact(F.array(
        F.when(F.col("palette_used") > 0, "INDEXED_COLOR_IMAGE"), F.when((F.col("palette_used") > 0) & (F.col("transparency") != "none"), "PALETTE_TRANSPARENCY"),
        F.when(gone == 1, "FULLY_TRANSPARENT_IMAGE").when(gone >= 0.9, "MOSTLY_TRANSPARENT_IMAGE"),
    ))
