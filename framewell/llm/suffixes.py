"""Suffix-array deduplication: remove bytes of strings of ``length`` bytes that start earlier.

Windows can repeat only where their seeds do (``windows``), so suffixes are taken at the
repeated seeds. Stretches of equal content are one; of the others, whose windows may be
equal in part, the suffixes at the seed (for some very common seeds, the reversed prefixes)
are range-partitioned by their leading bytes (Spark samples the splitters) and sorted; a task
cuts its part of the order into buckets of ``BUCKET`` suffixes, sorts the windows of each
by multikey quicksort, eight bytes at a time, and marks all but the earliest of each run
of equal windows. Equal windows have equal seeds, so neither splitters nor buckets cut the
suffixes of a seed, unless these are more than a bucket holds. A window of such a hot seed can
have an equal in another bucket only within the bytes that its suffix shares with its
bucket's first or last; these windows are compared across boundaries, in a task or between
tasks, by a second grouping on whole windows.

Defined results: null and empty texts and texts under ``length`` bytes lose nothing;
different texts of one doc_id are documents of their own, the one of lesser hash the
earlier; rows equal in id and text are one document, and lose the same bytes; rows without
a doc_id are kept whole and make no other go; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, numbered, partitions, runs_to_index, trimmed, words8, written
from .windows import repeated

#: Stretches of a bucket; different stretches of a seed above which its better side is looked for.
BUCKET, MANY = 20_000, 20


def bytes_as_units(b: np.ndarray, off: np.ndarray):
    return b, off


def equal_runs(words: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the slices ``start .. start + length`` by eight bytes at a time.

    Returns (slices that have an equal, run of each); a slice alone in its run leaves at once.
    """
    keep = np.arange(len(start))
    run = np.zeros(len(start), np.int64)
    for k in range(0, length, 8):
        key = words[start[keep] + min(k, length - 8)]
        order = np.lexsort((key, run))
        keep, run, key = keep[order], run[order], key[order]
        new = np.ones(len(keep), bool)
        new[1:] = (run[1:] != run[:-1]) | (key[1:] != key[:-1])
        run = np.cumsum(new) - 1
        many = np.bincount(run, minlength=1)[run] > 1 if len(run) else np.zeros(0, bool)
        keep, run = keep[many], run[many]
    return keep, run


def _runs(doc: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, from, to) covered by windows at the places, adjacent ones joined."""
    if not len(doc):
        return doc, at, at
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], at[first], at[last] + length


def _buckets(batches, length: int, seed: int, most: int):
    """Cut sorted rows into buckets of at most ``most`` rows and work through them one by one.

    A bucket ends where a seed ends; only a seed of more rows than a bucket is cut.
    """
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        while rows > most:
            t = pa.Table.from_batches(held)
            seeds = t["key"]
            cut = bisect.bisect_left(range(most + 1), seeds[most].as_py()[:seed], key=lambda i: seeds[i].as_py()[:seed]) or most
            yield from _bucket(t.slice(0, cut).to_batches(), length, seed)
            held, rows = t.slice(cut).to_batches(), rows - cut
    if rows:
        yield from _bucket(held, length, seed)


def _bucket(batches, length: int, seed: int):
    """Sort one bucket; yields covered spans, and the windows that may have an equal in a neighbouring bucket."""
    names = ["doc_id", "from", "to", "window"]
    t = pa.Table.from_batches(batches).combine_chunks()
    doc, at, windows, place = (t[c].to_numpy() for c in ("doc_id", "at", "windows", "place"))
    size = windows.astype(np.int64) + length - 1
    data = t["stretch"].combine_chunks()
    data = data if data.type == pa.large_binary() else data.cast(pa.large_binary())
    off = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    b = np.frombuffer(data.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off[:-1] - off[0]
    words = words8(b)
    start = runs_to_index(off, windows.astype(np.int64))
    owner = np.repeat(np.arange(len(doc)), windows)
    w_doc, w_at = doc[owner], (at[owner] + start - off[owner]).astype(np.int64)
    keep, run = equal_runs(words, start, length)
    order = np.lexsort((w_at[keep], w_doc[keep], run))
    keep, run = keep[order], run[order]
    head = np.ones(len(keep), bool)
    head[1:] = run[1:] != run[:-1]
    least = np.maximum.accumulate(np.where(head, np.arange(len(keep)), 0)) if len(keep) else np.empty(0, np.int64)
    later = (w_doc[keep] != w_doc[keep][least]) | (w_at[keep] != w_at[keep][least])
    d, f, z = _runs(w_doc[keep[later]], w_at[keep[later]], length)
    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(f.astype(np.int32)), pa.array(z.astype(np.int32)), pa.nulls(len(d), pa.binary())], names)
    # windows that may have an equal in a neighbouring bucket: of hot seeds, those within what their key shares with the bucket's first or last
    raw, keys = b.tobytes(), t["key"].to_pylist()
    hot = t["hot"].to_numpy(zero_copy_only=False).astype(bool)
    shared = np.array([max(_common(k, keys[0]), _common(k, keys[-1])) - seed if h else -1 for k, h in zip(keys, hot, strict=True)])
    left = t["leftwards"].to_numpy(zero_copy_only=False).astype(bool)
    before = place[owner] - (start - off[owner])  # the window's bytes left of its seed
    beyond = np.where(left[owner], before, length - seed - before)
    gone = np.zeros(len(start), bool)
    gone[keep[later]] = True
    out = np.flatnonzero((beyond <= shared[owner]) & ~gone)
    for i in range(0, len(out), 20_000):
        z = out[i : i + 20_000]
        content = [raw[s : s + length] for s in start[z].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(w_doc[z], pa.int64()), pa.array(w_at[z].astype(np.int32)), pa.array((w_at[z] + length).astype(np.int32)), pa.array(content, pa.binary())], names)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common start."""
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n if not x else n - (x.bit_length() + 7) // 8


def covered(docs: DataFrame, length: int = 100, seed: int = 32) -> DataFrame:
    """(doc_id, from, to): byte spans of ``docs``, where an id has one text, covered by windows that start earlier too."""
    spark = docs.sparkSession
    found = repeated(docs, bytes_as_units, length, seed)
    first = written(found.groupBy("seed", "content").agg(F.min(F.struct("doc_id", "at", "windows", "place")).alias("x"), F.count(F.lit(1)).alias("n")), "first", release=True)
    # later stretches of equal content are covered whole
    several = first.where("n > 1").select("seed", "content", F.col("x.doc_id").alias("d0"), F.col("x.at").alias("a0"))
    span = [F.col("doc_id"), F.col("at").alias("from"), (F.col("at") + F.col("windows") + (length - 1)).alias("to")]
    whole = found.join(several, ["seed", "content"]).where("doc_id <> d0 or at <> a0").select(*span)
    # stretches that share a seed but not all content
    mixed = first.groupBy("seed").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    some = first.join(mixed, "seed").select("seed", "k", "x.*")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("b"))
    some = some.join(texts, "doc_id").select("seed", "k", "doc_id", "at", "windows", "place", F.substring(F.col("b"), F.col("at") + 1, F.col("windows") + (length - 1)).alias("stretch"))
    some = written(some, "suffixes", release=True)
    seed_bytes, right = F.substring(F.col("stretch"), F.col("place") + 1, F.lit(seed)), F.substring(F.col("stretch"), F.col("place") + 1 + seed, F.lit(length))
    back = F.unhex(F.reverse(F.hex(F.substring(F.col("stretch"), F.lit(1), F.col("place")))))
    # a seed with many stretches is sorted on the side where they differ more, so a boundary within it shares little
    side = some.where(F.col("k") > MANY).groupBy("seed").agg((F.approx_count_distinct(F.substring(back, 1, 16)) > F.approx_count_distinct(F.substring(right, 1, 16))).alias("leftwards"))
    some = some.join(side, "seed", "left").withColumn("leftwards", F.coalesce("leftwards", F.lit(False)))
    some = some.withColumn("key", F.concat(seed_bytes, F.when(F.col("leftwards"), back).otherwise(right)))
    most = BUCKET  # as the driver has it
    some = some.withColumn("hot", F.col("k") > most)
    deal = [F.when(F.col("hot"), F.col("key")).otherwise(seed_bytes), F.when(F.col("hot"), F.col("doc_id")), F.when(F.col("hot"), F.col("at"))]
    dealt = some.repartitionByRange(partitions(spark), *deal).sortWithinPartitions("key", "doc_id", "at").select("doc_id", "at", "windows", "place", "stretch", "key", "leftwards", "hot")
    marked = written(dealt.mapInArrow(trimmed(lambda batches: _buckets(batches, length, seed, most)), "doc_id long, `from` int, `to` int, window binary"), "marked", release=True)
    edge = marked.where("window is not null")
    least = edge.groupBy("window").agg(F.min(F.struct("doc_id", "from")).alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1")
    across = edge.join(least, "window").where((F.col("doc_id") != F.col("x.doc_id")) | (F.col("from") != F.col("x.from")))
    return whole.unionByName(marked.where("window is null").drop("window")).unionByName(across.select("doc_id", "from", "to"))


def _spans(flat, n: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans within 0..n."""
    out: list[list[int]] = []
    for f, z in sorted((x["from"], min(x["to"], n)) for x in flat or []):
        if out and f <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        elif f < z:
            out.append([f, z])
    return [tuple(x) for x in out]


def with_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id", name: str = "spans") -> DataFrame:
    """Add ``name``, all spans of the row whose ``key`` is their doc_id; a document's spans are bounded by its length."""
    own = fresh("_doc", docs.columns)
    lists = spans.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set(F.struct("from", "to")).alias(name))
    return docs.join(lists, docs[key] == lists[own], "left").drop(own)


def digests(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def step(batches):
        for batch in batches:
            rows = []
            for text, flat in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                b = (text or "").encode()
                spans = _spans(flat, len(b))
                sha, at = hashlib.sha256(), 0
                for f, z in spans:
                    sha.update(b[at:f])
                    at = z
                sha.update(b[at:])
                rows.append((len(b), sum(z - f for f, z in spans), len(spans), sha.hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = covered(own.select(F.col("row").alias("doc_id"), "text"), length)
    return with_spans(own, spans, "row").select("doc_id", "text", "spans").mapInArrow(trimmed(step), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_text(text: str, flat) -> str:
    """The text without its spans; a character that a span cuts stays whole."""
    b = text.encode()
    out, at = [], 0
    for f, z in _spans(flat, len(b)):
        while f < z and b[f] & 0xC0 == 0x80:
            f += 1
        while z > f and z < len(b) and b[z] & 0xC0 == 0x80:
            z -= 1
        out.append(b[at:f])
        at = z
    return b"".join([*out, b[at:]]).decode()
