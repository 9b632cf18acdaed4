"""Repeated windows of fixed length: the candidates that the two substring operators refine.

A text is a row of units (bytes or words). Every window of ``length`` units has one seed:
of its ``seed``-unit grams the one of least hash, leftmost on ties. Equal windows have
equal seeds at equal places, so windows can repeat only where seeds do. Runs of windows
with the same seed are one stretch, and only a stretch's seed hash, content hash and place
are shuffled: about one row for every (length - seed) / 2 units. Seeds are counted before
the shuffle, and the rows of those that repeat are kept by a semi-join, whose large
partitions Spark can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SliceHash, gram_hashes, text_parts, trimmed, written

#: Units that one pass covers, so that a place fits under a 40-bit hash in 64 bits.
PASS = 1 << 24


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def chosen_seeds(units: np.ndarray, off: np.ndarray, length: int, seed: int):
    """For each pass: (text, window, seed place) of all whole windows, and the gram hashes and first place of the pass."""
    n = int(off[-1])
    for at in range(0, max(n - length + 1, 0), PASS - length):
        end = min(n, at + PASS)
        gram = gram_hashes(units[at:end], seed)
        key = (gram >> np.uint64(24) << np.uint64(24)) | np.arange(len(gram), dtype=np.uint64)
        chosen = (sliding_min(key, length - seed + 1) & np.uint64(PASS - 1)).astype(np.int64)
        first = np.arange(at, at + len(chosen))
        doc = np.searchsorted(off, first, "right") - 1
        whole = first + length <= off[doc + 1]
        if at + PASS < n:
            whole &= first < at + PASS - length
        first, chosen, doc = first[whole], chosen[whole], doc[whole]
        if len(first):
            yield doc, first, chosen, gram, at


def _begins(doc: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Where a new stretch begins among windows."""
    new = np.ones(len(doc), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    return np.flatnonzero(new)


def stretches(units: np.ndarray, off: np.ndarray, length: int, seed: int):
    """Per stretch: (text, first window, windows, seed place, seed hash, content hash); places are of the whole array."""
    hashes, out = SliceHash(units), []
    for doc, first, chosen, gram, at in chosen_seeds(units, off, length, seed):
        begin = _begins(doc, chosen)
        count = np.diff(np.append(begin, len(first)))
        s = first[begin]
        out.append((doc[begin], s, count, chosen[begin] + at, gram[chosen[begin]], hashes.of(s, s + count + length - 1)))
    if not out:
        return [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def seeds(docs: DataFrame, units, length: int, seed: int) -> DataFrame:
    """(seed, content, doc_id, at, windows, place) of every stretch; ``units(bytes, offsets)`` gives (units, offsets in units)."""

    def step(batches):
        for batch in batches:
            for at, b, off in text_parts(batch.column(1)):
                u, o = units(b, off)
                doc, s, n, p, h, c = stretches(u, o, length, seed)
                ids = batch.column(0).slice(at, len(off) - 1).take(pa.array(doc))
                for i in range(0, len(doc), 50_000):
                    z = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(h[z].view(np.int64)), pa.array(c[z].view(np.int64)), ids.slice(i, 50_000), pa.array((s - o[doc])[z].astype(np.int32)), pa.array(n[z].astype(np.int32)), pa.array((p - s)[z].astype(np.int32))], ["seed", "content", "doc_id", "at", "windows", "place"])

    return _texts(docs).mapInArrow(trimmed(step), "seed long, content long, doc_id long, at int, windows int, place int")


def seed_counts(docs: DataFrame, units, length: int, seed: int) -> DataFrame:
    """(seed, n): how many stretches have each seed, counted within a slice of the texts before Spark sees them."""

    def step(batches):
        for batch in batches:
            for _, b, off in text_parts(batch.column(1)):
                u, o = units(b, off)
                found = [gram[chosen[_begins(doc, chosen)]] for doc, _, chosen, gram, _ in chosen_seeds(u, o, length, seed)]
                if found:
                    h, n = np.unique(np.concatenate(found), return_counts=True)
                    for i in range(0, len(h), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 50_000].view(np.int64)), pa.array(n[i : i + 50_000].astype(np.int64))], ["seed", "n"])

    return _texts(docs).mapInArrow(trimmed(step), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))


def repeated(docs: DataFrame, units, length: int, seed: int) -> DataFrame:
    """The stretches whose seed occurs more than once, as a written table."""
    # a table of its own: Spark splits a large partition only between plain exchanges
    several = written(seed_counts(docs, units, length, seed).where("n > 1").select("seed"), "seeds", release=True)
    return written(seeds(docs, units, length, seed).join(several, "seed", "left_semi"), "stretches", release=True)
