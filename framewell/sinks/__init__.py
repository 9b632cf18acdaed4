"""Files for people: PNG, CSV, JSON envelopes, curves."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FramewellError, fail


def write_file(path: str, data: bytes) -> None:
    """A file appears whole or not at all."""
    tmp = f"{path}.{os.getpid()}.part"
    try:
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, path)
    except OSError as e:
        raise fail("OUTPUT_WRITE_FAILED", str(e)) from e
    finally:
        if os.path.exists(tmp):
            os.unlink(tmp)


def png(a: np.ndarray) -> bytes:
    """PNG of an array of bytes: gray [h,w], RGB [h,w,3] or RGBA [h,w,4]."""
    bands = 1 if a.ndim == 2 else a.shape[2]
    color = {1: 0, 3: 2, 4: 6}[bands]
    h, w = a.shape[:2]
    rows = np.zeros((h, w * bands + 1), np.uint8)
    rows[:, 1:] = a.reshape(h, w * bands)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def picture(px: DataFrame, width: int, height: int, most: int = 1 << 24) -> np.ndarray:
    """Pixels of one frame as an array in the driver, guarded by ``most`` pixels."""
    if width * height > most:
        raise fail("MATERIALIZATION_LIMIT_EXCEEDED", f"{width}x{height} pixels are over {most}")
    out = np.zeros((height, width, 3), np.uint8)
    for r in px.select("y", "x", "r", "g", "b").toLocalIterator():
        out[r["y"], r["x"]] = (r["r"], r["g"], r["b"])
    return out


def write_csv(df: DataFrame, path: str, order: Sequence[str], bom: bool = True) -> None:
    """One CSV file in a fixed order, with a header and a byte-order mark, row by row."""
    import csv
    import io

    tmp = f"{path}.part"
    with open(tmp, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for r in df.orderBy(*order).toLocalIterator():
            out.writerow(r)
    os.replace(tmp, path)
    assert io


def write_csv_dataset(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """The same rows as a folder of range-partitioned parts, for results of any size."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("header", True).csv(path)


def timeline_csv(samples: DataFrame, width: int, path: str) -> None:
    """Point-major timeline: pixel_id, x, y, frame, time_seconds, time_ms, r, g, b."""
    rows = samples.select((F.col("y") * width + F.col("x")).alias("pixel_id"), "x", "y", "frame", F.round("t", 6).alias("time_seconds"), F.round(F.col("t") * 1000, 3).alias("time_ms"), "r", "g", "b")
    write_csv(rows, path, ["pixel_id", "frame"])


def success(**data) -> str:
    return json.dumps({"ok": True, **data}, ensure_ascii=False)


def failure(error: FramewellError) -> str:
    return json.dumps({"ok": False, "error": error.to_dict()}, ensure_ascii=False)


def curve(values: Sequence[float], markers: Sequence[int] = (), width: int = 768, height: int = 256, low: float | None = None) -> np.ndarray:
    """A line drawing of a short series, with vertical marks."""
    out = np.full((height, width, 3), 255, np.uint8)
    v = np.asarray(values, float)
    if not len(v):
        return out
    lo, hi = (v.min() if low is None else low), v.max()
    at = np.interp(np.linspace(0, len(v) - 1, width), np.arange(len(v)), v)
    y = (height - 1 - np.clip((at - lo) / (hi - lo if hi > lo else 1), 0, 1) * (height - 1)).astype(int)
    for m in markers:
        out[:, int(m * (width - 1) / max(len(v) - 1, 1))] = (255, 128, 128)
    for x in range(width):
        a, z = sorted((y[max(x - 1, 0)], y[x]))
        out[a : z + 1, x] = (32, 64, 160)
    return out
