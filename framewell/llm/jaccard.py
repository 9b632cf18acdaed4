"""N-gram Jaccard join: MinHash banding, verified on full sets of word n-grams.

A document's set holds the n-grams of its white-space-separated words (all its words as
one n-gram if it has fewer). Equal texts are one class. ``banding`` chooses bands and rows
for the target recall at the threshold; classes that share a band hash are linked to the
least of them, and the components of these links are the candidate groups. Inside a group
every pair is verified on the full sets, in blocks of bounded size, so no link inside a
group is missed and no pair is emitted: a block returns, for each class, how many
documents it links to, and a spanning forest of the links. A group of several blocks is
first parted by set size: a set meets its own size class and the two beside it, as two sets
further apart can't be that like.

Defined results: rows of one doc_id are one document (that of the least text hash); rows
without a doc_id are left out; a text without words is linked to equal texts only; the
class id is the least doc_id of the documents connected by links, so every document has
one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SliceHash, components, mixed, repeated_ids, runs_to_index, text_parts, trimmed, word_slices, written

#: Classes and bytes of text in one block of a candidate group.
BLOCK, BLOCK_BYTES = 512, 8 << 20
_U = np.uint64


def banding(threshold: float, recall: float, most: int = 96) -> tuple[int, int]:
    """(bands, rows): the most selective choice within ``most`` hashes that reaches ``recall`` at ``threshold``."""
    best = None
    for rows in range(1, most + 1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                best = (bands, rows)
                break
    if best is None:
        raise ValueError("no banding within the hash budget reaches the recall")
    return best


def shingles(b: np.ndarray, off: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of each text end to end, offsets)."""
    from .bpe import SPACE, byte_classes

    n = len(off) - 1
    if not len(b):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    start, end, first = word_slices(b, off, byte_classes(b)[0] == SPACE)
    word = SliceHash(b).of(start, end)
    counts = np.diff(first)
    grams = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = runs_to_index(first[:-1], grams)
    short = np.repeat(counts < size, grams)
    doc = np.repeat(np.arange(n), grams)
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = ~short | (at + k < first[1:][doc])
        w = np.where(inside, word[np.minimum(at + k, len(word) - 1)] if len(word) else 0, _U(0))
        h = mixed(h * _U(0x9FB21C651E98DF25) + w + _U(k + 1))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[fresh], np.concatenate([[0], np.cumsum(np.bincount(doc[fresh], minlength=n))]).astype(np.int64)


def band_hashes(h: np.ndarray, off: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each text and band; 0 for empty sets."""
    n = len(off) - 1
    out = np.zeros((n, bands), np.uint64)
    full = np.flatnonzero(np.diff(off))
    if not len(full):
        return out
    keys = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64))
    for k in range(bands * rows):
        low = np.minimum.reduceat((h ^ keys[k]) * (keys[-1 - k] | _U(1)), off[:-1][full])
        out[full, k // rows] = mixed(out[full, k // rows] * _U(0x9FB21C651E98DF25) + low + _U(k + 1))
    return out


def sketch(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, n_bytes, n_grams, bands array<long>) of every document."""

    def step(batches):
        for batch in batches:
            for at, b, off in text_parts(batch.column(1)):
                h, o = shingles(b, off, size)
                sig = band_hashes(h, o, bands, rows).view(np.int64)
                data, ends = b.tobytes(), off.tolist()
                digest = [hashlib.blake2b(data[s:e], digest_size=16).digest() for s, e in zip(ends, ends[1:], strict=False)]
                empty = np.diff(o) == 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(empty, 0, bands))]).astype(np.int32)), pa.array(sig[~empty].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(off) - 1), pa.array(digest, pa.binary()), pa.array(np.diff(off)), pa.array(np.diff(o)), lists], ["doc_id", "text_hash", "n_bytes", "n_grams", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(step), "doc_id long, text_hash binary, n_bytes long, n_grams long, bands array<long>")


def _linked(sets: list[np.ndarray], cross: int | None, numerator: int, denominator: int):
    """Pairs (i, j) of sets whose likeness is at least numerator / denominator; only pairs across ``cross`` if given."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    doc = np.repeat(np.arange(n), sizes)
    values, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = many[column] > 1
    doc, column = doc[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    width = int(column.max()) + 1 if len(column) else 0
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    a = n if cross is None else cross
    common = np.zeros((a, n - (0 if cross is None else cross)), np.float32)
    step = 4096
    for lo in range(0, width, step):
        s, e = np.searchsorted(column, [lo, lo + step])
        m = np.zeros((n, min(step, width - lo)), np.float32)
        m[doc[s:e], column[s:e] - lo] = 1
        common += m[:a] @ (m if cross is None else m[cross:]).T
    inter = np.rint(common).astype(np.int64)
    left, right = sizes[:a], sizes if cross is None else sizes[cross:]
    ok = (inter * (numerator + denominator) >= numerator * (left[:, None] + right[None, :])) & (inter > 0)
    if cross is None:
        ok &= ~np.eye(n, dtype=bool)
    return ok


def _forest(ok: np.ndarray, cross: int | None) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    n = len(ok) if cross is None else cross + ok.shape[1]
    seen, out = np.zeros(n, bool), []
    shift = 0 if cross is None else cross

    def around(i):
        if cross is None:
            return np.flatnonzero(ok[i])
        return np.flatnonzero(ok[i]) + shift if i < cross else np.flatnonzero(ok[:, i - shift])

    for root in range(n):
        if seen[root]:
            continue
        seen[root], stack = True, [root]
        while stack:
            i = stack.pop()
            near = around(i)
            near = near[~seen[near]]
            seen[near] = True
            out += [(i, j) for j in near.tolist()]
            stack += near.tolist()
    return out


def join(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (4, 5), recall: float = 0.9999) -> DataFrame:
    """(doc_id, class_id, n_links) of every document; ``threshold`` is a fraction.

    n_links counts the other documents with a likeness of ``threshold`` or more, equal texts among them.
    """
    top, bottom = threshold
    bands, rows = banding(top / bottom, recall)
    found = sketch(docs.where(F.col("doc_id").isNotNull()), size, bands, rows).groupBy("doc_id").agg(F.min(F.struct("text_hash", "n_bytes", "n_grams", "bands")).alias("x")).select("doc_id", "x.*")
    found = written(found, "sketch")
    # a class: equal texts
    classes = found.groupBy("text_hash").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("n_bytes", "n_grams", "bands")).alias("x")).select("text_hash", "rep", "copies", "x.*")
    classes = written(classes, "classes")
    keyed = classes.select("rep", F.posexplode("bands").alias("band", "hash"))
    met = keyed.groupBy("band", "hash").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = keyed.join(met, ["band", "hash"]).where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    groups = components(edges)
    members = groups.join(classes.select(F.col("rep").alias("node"), "copies", "n_bytes", "n_grams"), "node")
    # a size class is a little wider than the threshold allows, so that rounding parts no pair
    width = -math.log(top / bottom) * (1 + 1e-9)
    members = members.withColumn("class", F.floor(F.log(F.col("n_grams").cast("double")) / width).cast("int"))
    # the blocks of a group and of each of its size classes, a few dozen at most, as their width grows with the size
    blocks_of = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    spans = members.groupBy("root", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b"))
    sizes = spans.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("class", blocks_of(F.col("n"), F.col("b"))))).alias("blocks"), blocks_of(F.sum("n"), F.sum("b")).alias("whole"))
    one = F.create_map(F.lit(0), F.lit(1))
    sizes = sizes.select("root", F.when(F.col("whole") > 1, F.col("blocks")).otherwise(one).alias("blocks"), (F.col("whole") > 1).alias("parted"))
    members = members.join(sizes, "root").withColumn("class", F.when(F.col("parted"), F.col("class")).otherwise(0))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")[F.col("class")]).cast("int"))
    own, block = F.col("class"), F.col("block")

    def met_by(shift, pair):
        """``pair`` of each block of the size class ``shift`` further."""
        n = F.coalesce(F.col("blocks")[own + shift], F.lit(0))
        return F.transform(F.filter(F.sequence(F.lit(0), n), lambda k: k < n), pair)

    def pair(class_i, i, class_j, j, side):
        return F.struct(class_i.alias("class_i"), i.alias("i"), class_j.alias("class_j"), j.alias("j"), side.cast("int").alias("side"))

    # pairs of blocks that a member takes part in, and its side of them
    within = met_by(0, lambda k: pair(own, F.least(block, k), own, F.greatest(block, k), block > k))
    above = met_by(1, lambda k: pair(own, block, own + 1, k, F.lit(0)))
    below = met_by(-1, lambda k: pair(own - 1, k, own, block, F.lit(1)))
    members = members.select(F.col("node").alias("doc_id"), "root", "copies", F.explode(F.concat(within, above, below)).alias("p")).select("doc_id", "root", "copies", "p.*")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if repeated_ids(texts):  # the row that the sketch took stands for its id
        texts = _hashed(texts).join(found.select("doc_id", "text_hash"), ["doc_id", "text_hash"]).groupBy("doc_id").agg(F.first("text").alias("text"))
    work = texts.join(members, "doc_id")

    def verify(key, group):
        _, class_i, i, class_j, j = (k.as_py() for k in key)
        order = np.lexsort((group["doc_id"].to_numpy(), group["side"].to_numpy()))
        group = group.take(pa.array(order))
        ids, copies, side = (group[c].to_numpy() for c in ("doc_id", "copies", "side"))
        sets = []
        for _, b, off in text_parts(group["text"].combine_chunks()):
            h, o = shingles(b, off, size)
            sets += [h[s:e] for s, e in zip(o.tolist(), o[1:].tolist(), strict=False)]
        cross = None if (class_i, i) == (class_j, j) else int((side == 0).sum())
        schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
        if len(ids) < 2 or cross in (0, len(ids)):
            return schema.empty_table()
        ok = _linked(sets, cross, top, bottom)
        if cross is None:
            links = ok @ copies
        else:
            links = np.concatenate([ok @ copies[cross:], ok.T @ copies[:cross]])
        pairs = _forest(ok, cross)
        has = np.flatnonzero(links)
        node = np.concatenate([ids[has], ids[[p[0] for p in pairs]]]) if pairs else ids[has]
        other = [None] * len(has) + [int(ids[p[1]]) for p in pairs]
        return pa.table({"node": pa.array(node, pa.int64()), "links": pa.array([*links[has].tolist(), *[0] * len(pairs)], pa.int64()), "other": pa.array(other, pa.int64())}, schema=schema)

    verified = written(work.groupBy("root", "class_i", "i", "class_j", "j").applyInArrow(verify, "node long, links long, other long"), "verified")
    linked = components(verified.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").join(counts.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("text_hash", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return found.select("doc_id", "text_hash").join(classes, "text_hash").select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"))


def _hashed(texts: DataFrame) -> DataFrame:
    """``texts`` (doc_id, text) with the text hash of the sketch."""

    def step(batches):
        for batch in batches:
            digest = [hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digest, pa.binary())], ["doc_id", "text", "text_hash"])

    return texts.mapInArrow(trimmed(step), "doc_id long, text string, text_hash binary")
