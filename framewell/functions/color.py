"""Colour and scalar functions as column expressions; all stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB to XYZ (D65) rows, white point, luma weights.
_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
_WHITE = (0.95047, 1.0, 1.08883)
BT709 = (0.2126, 0.7152, 0.0722)
BT601 = (0.299, 0.587, 0.114)


def weighted(r: Column, g: Column, b: Column, weights=BT601) -> Column:
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError("grayscale weights must sum to 1")
    return weights[0] * r + weights[1] * g + weights[2] * b


def luminance(r, g, b) -> Column:
    """BT.709 on code values."""
    return weighted(r, g, b, BT709)


def luma601(r, g, b) -> Column:
    return weighted(r, g, b, BT601)


def hex_code(r, g, b) -> Column:
    return F.format_string("#%02X%02X%02X", r, g, b)


def hsv(r, g, b, scale: float = 100.0) -> Column:
    """struct(h 0-360, s, v 0-scale); grey has hue 0, ties go red, green, blue."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = (top - low).cast("double")
    h = F.when(d == 0, 0.0).when(top == r, F.pmod((g - b) / d, F.lit(6.0))).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return F.struct((h * 60.0).alias("h"), F.when(top == 0, 0.0).otherwise(d / top * scale).alias("s"), (top / 255.0 * scale).alias("v"))


def from_hsv(h, s, v) -> Column:
    """struct(r, g, b) of hue 0-360 and s, v 0-1; half-even rounding."""
    k = lambda n: F.pmod(n + h / 60.0, F.lit(6.0))
    one = lambda n: F.rint((v - v * s * F.greatest(F.lit(0.0), F.least(k(n), 4.0 - k(n), F.lit(1.0)))) * 255.0).cast("int")
    return F.struct(one(5).alias("r"), one(3).alias("g"), one(1).alias("b"))


def linear(c: Column) -> Column:
    """sRGB code value to linear light, 0-1."""
    u = c / 255.0
    return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, 2.4))


def linear_luminance(r, g, b) -> Column:
    return sum(w * linear(c) for w, c in zip(_XYZ[1], (r, g, b), strict=True)) * 255.0


def lab(r, g, b) -> Column:
    """struct(l, a, b) of CIE Lab under D65."""
    lin = [linear(c) for c in (r, g, b)]
    xyz = [sum(m * c for m, c in zip(row, lin, strict=True)) / w for row, w in zip(_XYZ, _WHITE, strict=True)]
    f = [F.when(v > (6 / 29) ** 3, F.cbrt(v)).otherwise(v / (3 * (6 / 29) ** 2) + 4 / 29) for v in xyz]
    return F.struct((116 * f[1] - 16).alias("l"), (500 * (f[0] - f[1])).alias("a"), (200 * (f[1] - f[2])).alias("b"))


def from_lab(lightness, a, b) -> Column:
    """struct(r, g, b) nearest to a Lab colour, clipped to the gamut."""
    fy = (lightness + 16) / 116
    cube = lambda v: F.when(v > 6 / 29, v * v * v).otherwise(3 * (6 / 29) ** 2 * (v - 4 / 29))
    xyz = [cube(v) * w for v, w in zip((fy + a / 500, fy, fy - b / 200), _WHITE, strict=True)]
    import numpy as np

    rows = np.linalg.inv(np.array(_XYZ)).tolist()
    out = []
    for row, name in zip(rows, "rgb", strict=True):
        u = F.least(F.greatest(sum(m * c for m, c in zip(row, xyz, strict=True)), F.lit(0.0)), F.lit(1.0))
        out.append(F.rint(F.when(u <= 0.0031308, u * 12.92).otherwise(1.055 * F.pow(u, 1 / 2.4) - 0.055) * 255.0).cast("int").alias(name))
    return F.struct(*out)


def heat(v: Column, name: str = "fire") -> Column:
    """struct(r, g, b) of a display value 0-255 on the fire or gray scale."""
    if name == "gray":
        return F.struct(*[F.floor(v + 0.5).cast("int").alias(c) for c in "rgb"])
    step = lambda k: F.floor(F.least(F.greatest(v * 3.0 / 255.0 - k, F.lit(0.0)), F.lit(1.0)) * 255.0 + 0.5).cast("int")
    return F.struct(*[step(k).alias(c) for k, c in enumerate("rgb")])


def milliseconds(seconds: Column) -> Column:
    return F.round(seconds * 1000.0, 3)


def polar(x: Column, y: Column) -> Column:
    return F.struct(F.hypot(x, y).alias("magnitude"), F.degrees(F.atan2(y, x)).alias("angle"))
