"""Spectra of series and pictures. Series are built by aggregates; each transform runs on one Arrow group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import fail, require
from .sampling import CHANNELS, Rect, crop

#: Fewest samples, peaks reported, least masked centre, relative floor of peaks.
MIN_SAMPLES, PEAKS, CENTRE, FLOOR = 8, 5, 2, 1e-6


def series(px: DataFrame, source: str = "luma", rect: Rect | None = None, point: tuple[int, int] | None = None) -> DataFrame:
    """(media_id, frame, t, v): mean luma, or mean absolute change, of each frame. Sums are of whole numbers, so exact."""
    require(source in ("luma", "change"), "OPERATOR_CONFIG_INVALID", "source is luma or change")
    if point:
        rect = (*point, 1, 1)
    if rect:
        px = crop(px, rect)
    by = px.groupBy("media_id", "frame") if source == "luma" else None
    if source == "luma":
        s = F.sum(299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b"))
        return by.agg(F.min("t").alias("t"), (s.cast("double") / 1000 / F.count(F.lit(1))).alias("v"))
    w = Window.partitionBy("media_id", "y", "x").orderBy("frame")
    d = px.select("media_id", "frame", "t", sum((F.abs(F.col(c) - F.lag(c).over(w)) for c in CHANNELS), F.lit(0)).alias("d")).where("d is not null")
    return d.groupBy("media_id", "frame").agg(F.min("t").alias("t"), (F.sum("d") / (F.count(F.lit(1)) * 3)).alias("v"))


def _sorted(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(group["frame"].to_numpy(), kind="stable")
    return group["t"].to_numpy()[order], group["v"].to_numpy()[order]


def regular_interval(t: np.ndarray, allow_irregular: bool) -> float:
    d = np.diff(t)
    mean = float(d.mean()) if len(d) else 0.0
    require(mean > 0, "TIMESTAMP_MISSING", "the times give no sampling rate")
    if not allow_irregular and len(d) >= 2 and d.max() - d.min() > 0.1 * mean:
        raise fail("TIME_SELECTION_INVALID", "the time axis is irregular; resample it or allow an estimate")
    return mean


def temporal_fft(values: DataFrame, allow_irregular: bool = False) -> DataFrame:
    """(media_id, k, frequency, re, im, samples, irregular): transform of each series without its mean."""

    def step(key, group):
        t, v = _sorted(group)
        require(len(v) >= MIN_SAMPLES, "OPERATOR_CONFIG_INVALID", f"a spectrum needs {MIN_SAMPLES} samples, not {len(v)}")
        d = regular_interval(t, allow_irregular)
        z, f, gaps = np.fft.rfft(v - v.mean()), np.fft.rfftfreq(len(v), d), np.diff(t)
        odd = bool(gaps.max() - gaps.min() > 0.1 * d)
        n = len(z)
        return pa.table({"media_id": [key[0].as_py()] * n, "k": pa.array(range(n), pa.int32()), "frequency": f, "re": z.real, "im": z.imag, "samples": pa.array([len(v)] * n, pa.int32()), "irregular": [odd] * n})

    return values.groupBy("media_id").applyInArrow(step, "media_id string, k int, frequency double, re double, im double, samples int, irregular boolean")


def temporal_peaks(values: DataFrame, fps: float | None = None, count: int = PEAKS, allow_irregular: bool = False) -> DataFrame:
    """(media_id, rank, frequency, period_seconds, period_frames, magnitude, peak_ratio): strongest first, lower frequency first on ties.

    The last bin of an even series counts half and the mean isn't a peak; flat series have none.
    """
    z = temporal_fft(values, allow_irregular).where("k > 0")
    even = (F.col("samples") % 2 == 0) & (F.col("k") == (F.col("samples") / 2).cast("int"))
    z = z.select("media_id", "k", "frequency", (F.hypot("re", "im") * F.when(even, 0.5).otherwise(1.0)).alias("magnitude"), "samples")
    every, order = Window.partitionBy("media_id"), Window.partitionBy("media_id").orderBy(F.desc("magnitude"), "k")
    ranked = z.withColumn("total", F.sum("magnitude").over(every)).withColumn("rank", F.row_number().over(order))
    # the first bin's frequency times the sample count is the rate
    rate = F.lit(fps) if fps else F.col("frequency") / F.col("k") * F.col("samples")
    return ranked.where((F.col("rank") <= count) & (F.col("total") >= 1e-9)).select("media_id", "rank", "frequency", (1 / F.col("frequency")).alias("period_seconds"), (rate / F.col("frequency")).alias("period_frames"), "magnitude", (F.col("magnitude") / F.col("total")).alias("peak_ratio"))


WINDOWS = {"hann": np.hanning, "hamming": np.hamming, "rect": np.ones}


def windowed(v: np.ndarray, t: np.ndarray, window: str, length: int, hop: int, padding: str = "none", normalization: str = "none"):
    """(centre times, frequencies, complex spectra) of the windows of one regular series."""
    require(window in WINDOWS, "OPERATOR_CONFIG_INVALID", f"window is one of {', '.join(WINDOWS)}")
    require(length >= 2 and hop >= 1, "OPERATOR_CONFIG_INVALID", "length >= 2 and hop >= 1")
    require(padding in ("none", "end", "center") and normalization in ("none", "window_sum", "window_energy"), "OPERATOR_CONFIG_INVALID", "unknown padding or normalization")
    require(len(v) >= 2, "OPERATOR_CONFIG_INVALID", "a series needs two samples")
    d = np.diff(t)
    step = float(d.mean())
    require(step > 0 and np.allclose(d, step, rtol=0.05, atol=1e-9), "TIME_SELECTION_INVALID", "windows need a regular, increasing time axis")
    lead = length // 2 if padding == "center" else 0
    n = len(v) + (length - 1 if padding == "center" else 0)
    require(padding != "none" or n >= length, "OPERATOR_CONFIG_INVALID", "the series is shorter than the window")
    windows = max(0, n - length) // hop + 1
    if padding == "end" and (windows - 1) * hop + length < n:
        windows += 1
    starts = np.arange(windows) * hop
    buffer = np.zeros(max(n, int(starts[-1]) + length))
    buffer[lead : lead + len(v)] = v
    w = WINDOWS[window](length)
    scale = {"none": 1.0, "window_sum": w.sum(), "window_energy": np.sqrt((w * w).sum())}[normalization]
    require(scale > 0, "OPERATOR_CONFIG_INVALID", "the window has no weight")
    spectra = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(buffer, length)[starts] * w, axis=1) / scale
    return t[0] + (starts - lead + (length - 1) / 2) * step, np.fft.rfftfreq(length, step), spectra


def stft(values: DataFrame, window: str, length: int, hop: int, padding: str = "none", normalization: str = "none") -> DataFrame:
    """(media_id, window, t, k, frequency, re, im) of each series."""

    def step(key, group):
        t, v = _sorted(group)
        at, f, z = windowed(v, t, window, length, hop, padding, normalization)
        n, m = z.shape
        grid = np.arange(n * m)
        return pa.table({"media_id": [key[0].as_py()] * (n * m), "window": pa.array(grid // m, pa.int32()), "t": np.repeat(at, m), "k": pa.array(grid % m, pa.int32()), "frequency": np.tile(f, n), "re": z.real.ravel(), "im": z.imag.ravel()})

    return values.groupBy("media_id").applyInArrow(step, "media_id string, window int, t double, k int, frequency double, re double, im double")


def _picture(group: pa.Table, column: str = "v") -> np.ndarray:
    y, x = group["y"].to_numpy(), group["x"].to_numpy()
    y, x = y - y.min(), x - x.min()
    out = np.zeros((int(y.max()) + 1, int(x.max()) + 1))
    out[y, x] = group[column].to_numpy()
    return out


def _luma(px: DataFrame) -> DataFrame:
    return px.select("media_id", "frame", "y", "x", ((299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b")) / 1000.0).alias("v"))


def spatial_fft(px: DataFrame, rect: Rect | None = None) -> DataFrame:
    """(media_id, frame, v, u, re, im, height, width): centred transform of each frame's luma without its mean."""
    if rect:
        px = crop(px, rect)

    def step(key, group):
        p = _picture(group)
        h, w = p.shape
        require(h >= 8 and w >= 8, "OPERATOR_CONFIG_INVALID", "a region of 8 by 8 pixels at least")
        z = np.fft.fftshift(np.fft.fft2(p - p.mean()))
        v, u = np.mgrid[0:h, 0:w]
        n = h * w
        return pa.table({"media_id": [key[0].as_py()] * n, "frame": pa.array([key[1].as_py()] * n, pa.int32()), "v": pa.array((v - h // 2).ravel(), pa.int32()), "u": pa.array((u - w // 2).ravel(), pa.int32()), "re": z.real.ravel(), "im": z.imag.ravel(), "height": pa.array([h] * n, pa.int32()), "width": pa.array([w] * n, pa.int32())})

    return _luma(px).groupBy("media_id", "frame").applyInArrow(step, "media_id string, frame int, v int, u int, re double, im double, height int, width int")


def spatial_peaks(spectrum: DataFrame, count: int = PEAKS) -> DataFrame:
    """(media_id, frame, rank, u, v, period_px, angle_deg, magnitude): one of each conjugate pair, centre masked; ties by (v, u)."""
    u, v, h, w = (F.col(c) for c in ("u", "v", "height", "width"))
    block = F.greatest(F.lit(CENTRE), F.floor(F.least(h, w) / 32))
    centre = (F.abs(u) <= block) & (F.abs(v) <= block)
    own = (v == 0) | ((h % 2 == 0) & (v == -F.floor(h / 2)))  # rows that are their own conjugate
    edge = (w % 2 == 0) & (u == -F.floor(w / 2))
    half = (v <= 0) & (~own | (u >= 0) | edge)
    z = spectrum.where(~centre & half).withColumn("magnitude", F.hypot("re", "im"))
    top = Window.partitionBy("media_id", "frame")
    z = z.withColumn("top", F.max("magnitude").over(top)).where((F.col("magnitude") > 0) & (F.col("magnitude") >= F.col("top") * FLOOR))
    z = z.withColumn("rank", F.row_number().over(top.orderBy(F.desc("magnitude"), "v", "u"))).where(F.col("rank") <= count)
    return z.select("media_id", "frame", "rank", "u", "v", (1 / F.hypot(u / w, v / h)).alias("period_px"), F.degrees(F.atan2(v.cast("double"), u.cast("double"))).alias("angle_deg"), "magnitude")


def log_preview(spectrum: DataFrame, by: list[str], row: str, column: str) -> DataFrame:
    """(by, y, x, v): display values 0-255 of log(1 + magnitude), scaled by the greatest of each group; all 0 if that is 0."""
    m = F.log1p(F.hypot("re", "im"))
    most = F.max("_m").over(Window.partitionBy(*by))
    out = spectrum.withColumn("_m", m).withColumn("_most", most)
    # the largest value is exactly 255; a little under a whole number is that number
    value = F.when(F.col("_most") > 0, F.floor(F.col("_m") * 255.0 / F.col("_most") + 1e-9)).otherwise(0)
    return out.select(*by, F.col(row).alias("y"), F.col(column).alias("x"), value.cast("int").alias("v"))


def assess_pattern(gray: np.ndarray) -> dict:
    """Whether a picture has a regular fine texture: both axes' residuals repeat, at nearly one period."""
    h, w = (min(n, 1024) for n in gray.shape)
    top, left = (gray.shape[0] - h) // 2, (gray.shape[1] - w) // 2
    out = dict.fromkeys(("status", "x_period", "x_correlation", "y_period", "y_correlation", "residual_std"))
    if min(h, w) < 32:
        return out | {"status": "insufficient_data"}
    p = gray[top : top + h, left : left + w].astype(np.float64)
    r = np.diff(np.diff(p, axis=0), axis=1)
    r = r - r.mean()
    power = float((r * r).mean())
    out |= {"residual_std": power**0.5, "status": "not_detected"}
    if power < 64:
        return out
    lags = range(2, min(16, r.shape[0] // 4, r.shape[1] // 4) + 1)
    for axis, a in (("x", r.T), ("y", r)):
        c = [float((a[:-k] * a[k:]).mean() / power) for k in lags]
        best = int(np.argmax(c))
        out |= {f"{axis}_period": lags[best], f"{axis}_correlation": c[best]}
    if min(out["x_correlation"], out["y_correlation"]) >= 0.78 and abs(out["x_period"] - out["y_period"]) <= 1:
        out["status"] = "candidate"
    return out


def regular_pattern(px: DataFrame) -> DataFrame:
    """One row for each frame: ``assess_pattern`` of its luma."""
    schema = "media_id string, frame int, status string, x_period int, x_correlation double, y_period int, y_correlation double, residual_std double"
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.float64())

    def step(key, group):
        a = assess_pattern(_picture(group))
        row = [key[0].as_py(), key[1].as_py(), *(a[k] for k in ("status", "x_period", "x_correlation", "y_period", "y_correlation", "residual_std"))]
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.table({n: pa.array([v], k) for n, v, k in zip(names, row, kinds, strict=True)})

    return _luma(px).groupBy("media_id", "frame").applyInArrow(step, schema)
