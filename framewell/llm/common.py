"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest object an operator sends to every executor. A vocabulary file or one
#: benchmark shard is checked against it before it is broadcast.
BROADCAST_BYTES = 64 << 20
#: Bytes of text that one vectorised step works on; bounds a Python worker's memory.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        at = tempfile.mkdtemp(prefix="framewell-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    ``release`` has the driver collect its garbage, after which the shuffle files of finished
    jobs go, instead of half an hour later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/framewell/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if release:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def raw_file(path: str) -> bytes:
    """A vocabulary file's bytes, refused above the broadcast bound."""
    with open(path, "rb") as f:
        data = f.read(BROADCAST_BYTES + 1)
    if len(data) > BROADCAST_BYTES:
        raise ValueError(f"{path} is over {BROADCAST_BYTES} bytes and cannot be broadcast")
    return data


def fresh(name: str, columns) -> str:
    """``name``, or with underscores before it, so that no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def repeated_ids(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether an id occurs more than once."""
    return docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count() > 0


def numbered(docs: DataFrame, name: str = "row") -> DataFrame:
    """``docs`` (doc_id, text and others) with a column ``name`` that identifies a row's id and text.

    It is the id where no id repeats, else a number in order of id and text hash, so that
    different texts of one id are documents of their own and rows equal in both are one.
    Rows without an id have none.
    """
    if not repeated_ids(docs):
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    digest = fresh("_hash", docs.columns)
    own = docs.withColumn(digest, F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")))
    pairs = own.where("doc_id is not null").select("doc_id", digest).distinct()
    order = [F.col("doc_id").cast("long"), F.col(digest)]
    pairs = written(pairs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "rows")
    return own.join(pairs, ["doc_id", digest], "left").select(*docs.columns, name)


def release() -> None:
    """Give memory that was freed back to the system, where the C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(step):
    """``step`` over record batches for ``mapInArrow``: a reused Python worker keeps no freed memory from batch to batch."""

    def run(batches):
        def each():
            for batch in batches:
                yield batch
                del batch
                release()

        yield from step(each())
        release()

    return run


def hex_sha256(col):
    return F.sha2(col.cast("binary"), 256)


def text_parts(column, limit: int = CHUNK_BYTES):
    """Slices of an Arrow text column as (first row, uint8 buffer, row offsets).

    A slice holds ``limit`` bytes, or a single longer row. Null rows are empty.
    """
    import pyarrow as pa

    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def runs_to_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``starts[i] .. starts[i]+lengths[i]``."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def words8(b: np.ndarray) -> np.ndarray:
    """For each position the next eight bytes as one little-endian number; zero past the end."""
    p = np.zeros(len(b) + 8, np.uint64)
    p[: len(b)] = b
    p[:-1] |= p[1:] << np.uint64(8)
    p[:-2] |= p[2:] << np.uint64(16)
    p[:-4] |= p[4:] << np.uint64(32)
    return p[: len(b)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor-shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: The prime 2^61 - 1 and the base of the polynomials.
_PRIME, _BASE = (1 << 61) - 1, 0x1D8AF066E5A3C1B7
_P = np.uint64(_PRIME)
#: Units summed before a running sum is reduced: it stays under 64 bits, and its arrays in the cache.
_RUN = 1 << 17
_powers_of: dict[int, np.ndarray] = {}


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime."""
    low, shift = np.uint64((1 << 31) - 1), np.uint64(31)
    ah, al, bh, bl = a >> shift, a & low, b >> shift, b & low
    mid = ah * bl + al * bh
    return reduced(((ah * bh) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << shift) + al * bl)


def reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo the prime."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _powers(base: int, n: int) -> np.ndarray:
    """base^i modulo the prime for i below n at least."""
    out = _powers_of.get(base)
    if out is None or len(out) < n:
        out = np.ones(1, np.uint64)
        while len(out) < max(n, 1 << 16):
            out = np.concatenate([out, times(out, np.uint64(pow(base, len(out), _PRIME)))])
        _powers_of[base] = out
    return out


class SliceHash:
    """64-bit hashes of any slices of an array of bytes or of hashes, from one running sum.

    A slice's hash is a polynomial in its units modulo the prime, mixed with its length:
    modulo a power of two, complementary Thue-Morse words would agree whatever the base.
    """

    def __init__(self, units: np.ndarray):
        n = len(units)
        up, low = _powers(_BASE, n + 1), np.uint64(0xFFFFFFFF)
        self.down = _powers(pow(_BASE, -1, _PRIME), n + 1)
        self.sum = np.zeros(n + 1, np.uint64)
        for at in range(0, n, _RUN):
            u = units[at : at + _RUN]
            p = up[at : at + len(u)]
            if u.dtype == np.uint8:
                u = u.astype(np.uint64) + np.uint64(1)
                a, b = np.cumsum((p & low) * u), np.cumsum((p >> np.uint64(32)) * u)
            else:
                p = times(p, reduced(u))
                a, b = np.cumsum(p & low), np.cumsum(p >> np.uint64(32))
            # b times 2^32 is a rotation of 61 bits
            b = reduced(b)
            b = ((b & np.uint64((1 << 29) - 1)) << np.uint64(32)) | (b >> np.uint64(29))
            self.sum[at + 1 : at + 1 + len(u)] = reduced(reduced(a) + b + self.sum[at])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = times(reduced(self.sum[end] + (_P - self.sum[start])), self.down[start])
        return mixed(value + (end - start).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def gram_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` units from each place, built by doubling; cheap, good to choose places by, not to prove equality."""
    wide, have = (words8(units), 8) if units.dtype == np.uint8 and size >= 8 else (units.astype(np.uint64), 1)
    n = max(len(units) - size + 1, 0)
    if not n:
        return np.empty(0, np.uint64)
    wide = wide[: len(units) - have + 1]
    while have < size:
        step = min(have, size - have)
        left, right = wide[:-step], wide[step:]
        wide = (left ^ (left >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25) + right * np.uint64(0xE7037ED1A0B428DB)
        have += step
    return mixed(wide[:n])


def word_slices(b: np.ndarray, off: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text) of maximal runs without ``space``, per text."""
    n = len(b)
    head = np.zeros(n + 1, bool)
    head[off] = True
    solid = ~space
    before = np.zeros(n + 1, bool)  # a word's byte stands at i-1 in the same text
    before[1:] = solid
    before[head] = False
    start = np.flatnonzero(solid & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = solid
    after[head] = False
    end = np.flatnonzero(solid & ~after[1:]) + 1
    return start, end, np.searchsorted(start, off, "left")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of ``edges`` (a, b): root is the least node of its component.

    Alternating stars: every node sends its larger neighbours, then its smaller ones, to the
    least node it knows, until the edges are stars. Minima are aggregated before the shuffle
    and joined back, so no node's neighbours meet in one task; each round is a written table.
    """
    star = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        star = written(small, "edges")
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
