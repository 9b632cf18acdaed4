"""Still pictures: Spark's image source for decoded RGB, a PNG and NetPBM/BMP header reader for native samples."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import fail, require

# Leading bytes of formats, and extensions of each kind.
MAGIC = {"png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff", "gif": b"GIF8", "bmp": b"BM", "webp": b"RIFF", "mp4": b"ftyp", "mkv": b"\x1aE\xdf\xa3", "avi": b"RIFF"}
IMAGES = ("png", "jpg", "jpeg", "bmp", "gif", "webp", "tif", "tiff", "ppm", "pgm", "pbm")
VIDEOS = ("mp4", "mkv", "mov", "avi", "webm", "m4v", "ts", "flv")


def media_type(uri: Column) -> Column:
    """image, video or null by extension."""
    ext = F.lower(F.regexp_extract(uri, r"\.([^./]+)$", 1))
    return F.when(ext.isin(*IMAGES), "image").when(ext.isin(*VIDEOS), "video")


def actual_format(content: Column) -> Column:
    """The format that a file's first bytes say, whatever its name."""
    at = lambda k, n: F.hex(F.substring(content, k, n))
    h = lambda b: b.hex().upper()
    return (
        F.when(at(1, 8) == h(MAGIC["png"]), "png").when(at(1, 3) == h(MAGIC["jpeg"]), "jpeg").when(at(1, 4) == h(MAGIC["gif"]), "gif").when(at(1, 2) == h(MAGIC["bmp"]), "bmp")
        .when((at(1, 4) == h(b"RIFF")) & (at(9, 4) == h(b"WEBP")), "webp").when((at(1, 4) == h(b"RIFF")) & (at(9, 4) == h(b"AVI ")), "avi")
        .when(at(5, 4) == h(MAGIC["mp4"]), "mp4").when(at(1, 4) == h(MAGIC["mkv"]), "mkv").when(at(1, 2).isin(*[h(f"P{k}".encode()) for k in range(1, 7)]), "netpbm")
    )


def media(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, uri, media_type, actual_format, size_bytes, sha256, modified): identity of each file."""
    b = spark.read.format("binaryFile").load(path)
    return b.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("media_id"), F.col("path").alias("uri"), media_type(F.col("path")).alias("media_type"), actual_format(F.col("content")).alias("actual_format"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def frames(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, frame, t, height, width, channels, data): each picture as one RGB frame, row by row."""
    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def step(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                # the source stores blue first, alpha last
                rgb = np.repeat(a, 3, axis=2) if r["nChannels"] == 1 else a[..., 2::-1]
                out.append((r["origin"].rsplit("/", 1)[-1], r["height"], r["width"], np.ascontiguousarray(rgb).tobytes()))
            ids, h, w, d = zip(*out, strict=True) if out else ([], [], [], [])
            n = len(out)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([0] * n, pa.int32()), pa.array([0.0] * n), pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array([3] * n, pa.int32()), pa.array(d, pa.binary())], ["media_id", "frame", "t", "height", "width", "channels", "data"])

    return i.mapInArrow(step, "media_id string, frame int, t double, height int, width int, channels int, data binary")


def pixels(frames: DataFrame, rect: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Frames as rows of pixels. A rectangle bounds what is unpacked, before any row is made."""

    def step(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)
                x0, y0, w, h = rect or (0, 0, r["width"], r["height"])
                require(x0 >= 0 and y0 >= 0 and x0 + w <= r["width"] and y0 + h <= r["height"], "COORDINATE_OUT_OF_RANGE", "the rectangle leaves the frame")
                for lo in range(y0, y0 + h, 256):
                    part = a[lo : min(lo + 256, y0 + h), x0 : x0 + w].astype(np.int32)
                    n = part.shape[0] * w
                    y, x = np.divmod(np.arange(n, dtype=np.int32), w)
                    yield pa.RecordBatch.from_arrays([pa.array([r["media_id"]] * n), pa.array(np.full(n, r["frame"], np.int32)), pa.array(np.full(n, r["t"])), pa.array(y + np.int32(lo)), pa.array(x + np.int32(x0)), *(pa.array(part[..., k].ravel()) for k in range(3))], ["media_id", "frame", "t", "y", "x", "r", "g", "b"])

    return frames.select("media_id", "frame", "t", "height", "width", "data").mapInArrow(step, "media_id string, frame int, t double, y int, x int, r int, g int, b int")


def row_bytes(y: int) -> Column:
    """The packed bytes of one row of a frame: a substring, so nothing is exploded."""
    return F.substring(F.col("data"), F.lit(y) * F.col("width") * 3 + 1, F.col("width") * 3)


def read_png(data: bytes) -> dict:
    """Samples of a PNG as stored: array, mode, bits, bands, palette, alpha representation."""
    if data[:8] != MAGIC["png"]:
        raise fail("UNSUPPORTED_MEDIA", "not a PNG")
    at, chunks, idat = 8, {}, []
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise fail("DECODE_FAILED", "a PNG chunk is cut off or its checksum is wrong")
        idat.append(body) if kind == b"IDAT" else chunks.setdefault(kind, body)
        at += 12 + size
    width, height, bits, color, _, _, interlace = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    require(not interlace, "UNSUPPORTED_MEDIA", "interlaced PNG")
    bands = {0: ("L",), 2: ("R", "G", "B"), 3: ("P",), 4: ("L", "A"), 6: ("R", "G", "B", "A")}[color]
    stride, step = (width * len(bands) * bits + 7) // 8, max(1, len(bands) * bits // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(height, stride + 1)
    rows = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for k in range(height):
        rows[k] = above = _unfilter(int(raw[k, 0]), raw[k, 1:], above, step)
    if bits == 16:
        a = rows.reshape(height, -1).view(">u2").astype(np.uint16)
    elif bits == 8:
        a = rows
    else:
        a = (np.unpackbits(rows, axis=1).reshape(height, -1, bits) @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, : width * len(bands)]
    a = a.reshape(height, width, len(bands))
    clear = chunks.get(b"tRNS")
    alpha = "straight" if "A" in bands else "palette_or_color_key" if clear is not None else "none"
    palette = np.frombuffer(chunks[b"PLTE"], np.uint8).reshape(-1, 3) if b"PLTE" in chunks else None
    return {"samples": a[..., 0] if len(bands) == 1 else a, "bits": bits, "bands": bands, "palette": palette, "alpha": alpha, "transparency": clear}


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:
        out = line.reshape(-1, step) if len(line) % step == 0 else line[:, None]
        return np.cumsum(out, axis=0, dtype=np.uint8).reshape(-1)
    out = np.zeros(len(line) + step, np.int32)
    up = np.concatenate([np.zeros(step, np.int32), above.astype(np.int32)])
    for i in range(len(line)):
        a, b, c = int(out[i]), int(up[i + step]), int(up[i])
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i + step] = (int(line[i]) + guess) & 255
    return out[step:].astype(np.uint8)


def native_samples(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, y, x, index, alpha, samples array<int>) of PNG files, as stored and without colour conversion."""
    b = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("media_id"), "content")

    def step(batches):
        for batch in batches:
            for r in batch.to_pylist():
                p = read_png(r["content"])
                a = p["samples"]
                h, w = a.shape[:2]
                flat = a.reshape(h * w, -1).astype(np.int32)
                y, x = np.divmod(np.arange(h * w, dtype=np.int32), w)
                index = flat[:, 0] if p["bands"] == ("P",) else None
                alpha = flat[:, -1] >> (p["bits"] - 8) if "A" in p["bands"] else None
                if index is not None and p["transparency"] is not None:
                    table = np.full(256, 255, np.int32)
                    table[: len(p["transparency"])] = np.frombuffer(p["transparency"], np.uint8)
                    alpha = table[index]
                n = h * w
                none = pa.nulls(n, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r["media_id"]] * n), pa.array(y), pa.array(x), none if index is None else pa.array(index), none if alpha is None else pa.array(alpha.astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.int32()))], ["media_id", "y", "x", "index", "alpha", "samples"])

    return b.mapInArrow(step, "media_id string, y int, x int, `index` int, alpha int, samples array<int>")


def decoder():
    """The optional video decoder."""
    try:
        import av
    except ImportError:
        raise fail("DEPENDENCY_MISSING", "video needs the av library", "install PyAV") from None
    return av


def register_video_source(spark: SparkSession) -> None:
    """Register the ``clip`` data source: frames of one video file, where a decoder is installed."""
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path = options["path"]

        def read(self, partition):
            av = decoder()
            name = self.path.rsplit("/", 1)[-1]
            with av.open(self.path) as box:
                first = None
                for k, f in enumerate(box.decode(video=0)):
                    a = f.to_ndarray(format="rgb24")
                    first = f.time if first is None else first
                    t = k if f.time is None else round(max(f.time - first, 0.0), 6)
                    yield name, k, f.pts, float(t), bool(f.key_frame), a.shape[0], a.shape[1], 3, a.tobytes()

    class Clip(DataSource):
        @classmethod
        def name(cls):
            return "clip"

        def schema(self):
            return "media_id string, frame int, pts bigint, t double, key_frame boolean, height int, width int, channels int, data binary"

        def reader(self, schema):
            decoder()
            return Reader(self.options)

    spark.dataSource.register(Clip)
