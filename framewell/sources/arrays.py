"""Array files: NPY headers, partial reads and chunked tensors as rows."""

from __future__ import annotations

import ast
import hashlib
import os
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import fail, require


def npy_header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, dtype, offset of the data); object arrays and other orders are refused."""
    with open(path, "rb") as f:
        head = f.read(8)
        if head[:6] != b"\x93NUMPY":
            raise fail("UNSUPPORTED_MEDIA", f"{path} is not an NPY file")
        n = struct.unpack("<H", f.read(2))[0] if head[6] == 1 else struct.unpack("<I", f.read(4))[0]
        d = ast.literal_eval(f.read(n).decode("latin1"))
        kind = np.dtype(d["descr"])
        require(kind.kind != "O" and not d["fortran_order"], "UNSUPPORTED_MEDIA", "object or column-major array")
        return tuple(d["shape"]), kind, f.tell()


def read_npy(spark: SparkSession, path: str, rows: int = 1024) -> DataFrame:
    """(chunk, lo, hi, data binary) of an NPY file that every executor can open, by ranges of its first axis."""
    shape, kind, at = npy_header(path)
    require(len(shape) > 0, "ARTIFACT_SCHEMA_MISMATCH", "a scalar has no first axis")
    width = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
    n = -(-shape[0] // rows)

    def step(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                lo, hi = k * rows, min((k + 1) * rows, shape[0])
                with open(path, "rb") as f:
                    f.seek(at + lo * width)
                    data = f.read((hi - lo) * width)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([lo], pa.int64()), pa.array([hi], pa.int64()), pa.array([data], pa.binary())], ["chunk", "lo", "hi", "data"])

    return spark.range(0, n, 1, max(1, min(n, 64))).mapInArrow(step, "chunk long, lo long, hi long, data binary")


def tensor_chunks(cells: DataFrame, axes: Sequence[str], values: Sequence[str], shape: Sequence[int], rows: int, dtype: str = "<f8") -> DataFrame:
    """(chunk, lo, hi, sha256, data) of a long tensor, dense and row-major, by ranges of its first axis.

    A cell that isn't there is zero; the channel axis is last.
    """
    inner = int(np.prod(shape[1:], dtype=np.int64)) * len(values)
    place = F.col(axes[0]) % rows
    for a, n in zip(axes[1:], shape[1:], strict=True):
        place = place * n + F.col(a)
    keyed = cells.select(F.floor(F.col(axes[0]) / rows).cast("long").alias("chunk"), place.cast("long").alias("p"), *[F.col(v).cast("double").alias(f"v{k}") for k, v in enumerate(values)])

    def step(key, group):
        k = key[0].as_py()
        lo, hi = k * rows, min((k + 1) * rows, shape[0])
        out = np.zeros(((hi - lo) * inner // len(values), len(values)))
        out[group["p"].to_numpy()] = np.stack([group[f"v{c}"].to_numpy() for c in range(len(values))], axis=1)
        data = out.astype(dtype).tobytes()
        return pa.table({"chunk": pa.array([k], pa.int64()), "lo": pa.array([lo], pa.int64()), "hi": pa.array([hi], pa.int64()), "sha256": [hashlib.sha256(data).hexdigest()], "data": pa.array([data], pa.binary())})

    return keyed.groupBy("chunk").applyInArrow(step, "chunk long, lo long, hi long, sha256 string, data binary")


def write_npy(chunks: DataFrame, shape: Sequence[int], path: str, dtype: str = "<f8") -> None:
    """One NPY file from chunks, one chunk at a time in the driver; each must come exactly once. Never overwrites."""
    if os.path.exists(path):
        raise fail("OUTPUT_WRITE_FAILED", f"{path} exists")
    tmp, want = f"{path}.part", 0
    try:
        with open(tmp, "wb") as f:
            np.lib.format.write_array_header_1_0(f, {"descr": np.lib.format.dtype_to_descr(np.dtype(dtype)), "fortran_order": False, "shape": tuple(shape)})
            for r in chunks.orderBy("chunk").toLocalIterator():
                require(r["lo"] == want and hashlib.sha256(r["data"]).hexdigest() == r["sha256"], "ARTIFACT_CHECKSUM_MISMATCH", f"chunk {r['chunk']} is missing, repeated or damaged")
                f.write(r["data"])
                want = r["hi"]
        require(want == shape[0], "ARTIFACT_SCHEMA_MISMATCH", f"{want} rows of {shape[0]}")
        os.link(tmp, path)  # fails if another writer was first
    finally:
        if os.path.exists(tmp):
            os.unlink(tmp)
