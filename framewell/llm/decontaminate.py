"""Benchmark decontamination: a BM25 index of test items with block-max WAND.

Test items are indexed by word, those of like length together: up to ``LEAST`` words, up to
twice as many, and so on. Every training passage (overlapping stretches of a document, twice
as long as the longest item that the length class allows) is a query; WAND with block maxima
retrieves all items whose score reaches ``RETRIEVE`` of the item's score against itself. The
passages of an item depend on its own length alone, so it matches the same documents
whatever other items share its shard. The maxima of
blocks of items are summed for all passages of a batch at once; WAND then walks the postings
of the blocks that are left. A retrieved pair is contaminated if the passage
holds enough of the item's question and of its answer, as word n-grams.

An item's answer is what follows its last "Answer:" (or "A:") line mark, else its last
question mark, else its last sentence; its question is the rest.

The index is broadcast in shards of at most ``SHARD_BYTES`` of item text (or one item that
is longer alone); more items mean more shards, each of which reads the documents once. A
shard is built, broadcast, used up and released before the next one is built. Document
frequencies and the mean length are those of all items.

Defined results: null and empty texts and items match nothing; items of fewer than
``GRAM`` words match as one gram; equal texts of several items all match, and rows equal in
id and text are one item; repeated documents give repeated results; a document without an id
is searched like others, and an item without one is reported without; an item may be as long
as one record; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, SliceHash, mixed, runs_to_index, text_parts, trimmed, word_slices, written

SHARD_BYTES = 8 << 20
#: Share of an item's own score that a passage must reach, and of question and answer n-grams that it must hold.
RETRIEVE, QUESTION, ANSWER = 0.5, 0.5, 0.5
GRAM = 5
#: BM25's saturation and length parameters; items in a block.
K1, B, BLOCK = 1.2, 0.75, 4
#: Words of the shortest length class; hash buckets from which a shard is put together.
LEAST, BUCKETS = 64, 16
#: Bound that a passage's commonest words may leave unlooked-up; (passage, block) sums held at once.
REST, HELD = 0.25, 1 << 20
_ANSWER_MARK = re.compile(r"(?im)^\s*a(?:nswer)?\s*:")
_SENTENCE_END = re.compile(r"[.!?]+[\s\"')\]]*")


def word_hashes(texts: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, word hashes end to end, word offsets of the texts) in parts; words are lower-cased runs of letters and digits."""
    from .bpe import LETTER, NUMBER, byte_classes

    for at, b, off in text_parts(pc.utf8_lower(texts.fill_null("")), limit):
        if not len(b):
            yield at, np.empty(0, np.uint64), np.zeros(len(off), np.int64)
            continue
        cls = byte_classes(b)[0]
        start, end, first = word_slices(b, off, (cls != LETTER) & (cls != NUMBER))
        yield at, SliceHash(b).of(start, end), first


def grams(words: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of the word n-grams; all words as one gram if there are fewer."""
    size = max(1, min(size, len(words)))
    if not len(words):
        return np.empty(0, np.uint64)
    h = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        h = mixed(h * np.uint64(0x9FB21C651E98DF25) + words[k : len(words) - size + 1 + k] + np.uint64(k + 1))
    return h


def question_and_answer(text: str) -> tuple[str, str]:
    marks = list(_ANSWER_MARK.finditer(text))
    if marks:
        return text[: marks[-1].start()], text[marks[-1].end() :]
    body = text.rstrip()
    at = body.rfind("?", 0, max(len(body) - 1, 0)) + 1
    if not at:
        ends = [m.end() for m in _SENTENCE_END.finditer(body) if m.end() < len(body)]
        at = ends[-1] if ends else 0
    return body[:at], body[at:]


def _hashed(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, words, off in word_hashes(pa.array(texts, pa.string())):
        out += [words[s:e] for s, e in zip(off.tolist(), off[1:].tolist(), strict=False)]
    return out


def length_class(words: int) -> int:
    """The longest item of a class: ``LEAST`` words, or the next power of two times that."""
    return LEAST << max(0, -(-words // LEAST) - 1).bit_length()


class Shard:
    """The indexes of a shard's length classes, over one list of terms."""

    def __init__(self, ids: list, texts: list[str], df: dict[int, int], n_items: int, mean_length: float):
        items = [(i, t, w) for i, t, w in zip(ids, texts, _hashed(texts), strict=True) if len(w)]
        self.terms = np.unique(np.concatenate([w for *_, w in items])) if items else np.empty(0, np.uint64)
        classes = sorted({length_class(len(w)) for *_, w in items})
        self.classes = [Index([x for x in items if length_class(len(x[2])) == c], c, self.terms, df, n_items, mean_length) for c in classes]

    def matches(self, words: np.ndarray, off: np.ndarray) -> dict[tuple[int, int, int], tuple[float, float, float]]:
        """(text, class, item) -> (score, question share, answer share) of the contaminated pairs."""
        if not self.classes:
            return {}
        k = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        k = np.where(self.terms[k] == words, k, -1)
        return {(t, c, i): v for c, index in enumerate(self.classes) for (t, i), v in index.matches(k, words, off).items()}

    def id_of(self, c: int, item: int):
        return self.classes[c].ids[item]


class Index:
    """Postings of one length class with impacts over the item's threshold, so that a score of 1 is a retrieval."""

    def __init__(self, keep: list, longest: int, terms: np.ndarray, df: dict[int, int], n_items: int, mean_length: float):
        # items that share their commonest words stand together, which makes block maxima tight
        keep.sort(key=lambda k: sorted(set(k[2].view(np.int64).tolist()), key=lambda t: (-df.get(t, 1), t))[:4])
        self.ids = [k[0] for k in keep]
        words = [k[2] for k in keep]
        parts = [question_and_answer(k[1]) for k in keep]
        self.question = [np.unique(grams(w)) for w in _hashed([p[0] for p in parts])]
        self.answer = [np.unique(grams(w)) for w in _hashed([p[1] for p in parts])]
        self.longest, self.terms = longest, terms
        lists: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for i, w in enumerate(words):
            term, tf = np.unique(w, return_counts=True)
            n = np.array([df.get(int(t), 1) for t in term.view(np.int64)], float)
            idf = np.log1p((n_items - n + 0.5) / (n + 0.5))
            gain = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean_length))
            for t, g in zip(np.searchsorted(self.terms, term).tolist(), (gain / (RETRIEVE * gain.sum())).tolist(), strict=True):
                lists[t].append((i, g))
        self.items = [[p[0] for p in x] for x in lists]
        self.gains = [[p[1] for p in x] for x in lists]
        self.block_max = [{} for _ in self.items]
        for x, g, m in zip(self.items, self.gains, self.block_max, strict=True):
            for i, v in zip(x, g, strict=True):
                m[i // BLOCK] = max(m.get(i // BLOCK, 0.0), v)
        self.bound = np.array([max(g, default=0.0) for g in self.gains] or [0.0])
        self.spread = np.array([len(m) for m in self.block_max] or [0])
        self.block_start = np.cumsum(self.spread) - self.spread
        self.block_at = np.array([k for m in self.block_max for k in m], np.int64)
        self.block_bound = np.array([v for m in self.block_max for v in m.values()], float)
        self.blocks = -(-len(keep) // BLOCK)

    def search(self, terms: list[int], allowed: list[int] | None = None) -> list[tuple[int, float]]:
        """All (item, score) with a score of 1 or more for a query of distinct terms: block-max WAND.

        ``allowed``: the blocks whose bound reaches 1, if that is known; others are skipped.
        """
        bound, items, gains, maxima = self.bound, self.items, self.gains, self.block_max
        allowed = range(self.blocks) if allowed is None else allowed
        at = dict.fromkeys(terms, 0)
        cursors = sorted((items[t][0], t) for t in terms if items[t])
        out, slack = [], 1 - 1e-9
        while cursors:
            total, pivot = 0.0, -1
            for k, (_, t) in enumerate(cursors):
                total += bound[t]
                if total >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            k = bisect_left(allowed, block)
            if k == len(allowed):
                break
            if allowed[k] != block:
                to, moving = allowed[k] * BLOCK, cursors
            elif sum(maxima[t].get(block, 0.0) for _, t in cursors) < slack:
                to, moving = (block + 1) * BLOCK, cursors
            else:
                score = 0.0
                for _, t in cursors[: pivot + 1]:
                    j = bisect_left(items[t], item, at[t])
                    if j < len(items[t]) and items[t][j] == item:
                        score += gains[t][j]
                if score >= slack:
                    out.append((item, score))
                to, moving = item + 1, cursors[: pivot + 1]
            rest = cursors[len(moving) :]
            moved = []
            for _, t in moving:
                at[t] = j = bisect_left(items[t], to, at[t])
                if j < len(items[t]):
                    moved.append((items[t][j], t))
            cursors = sorted(moved + rest)
        return out

    def passages(self, k: np.ndarray, off: np.ndarray):
        """(text, from, to) of the passages whose summed bounds reach 1; ``k`` has the term of each word, or -1."""
        size, step = 2 * self.longest, self.longest
        sums = np.concatenate([[0.0], np.cumsum(np.append(self.bound, 0.0)[k])])
        count = np.diff(off)
        each = np.where(count > 0, np.maximum(1, -(-(count - size) // step) + 1), 0)
        text = np.repeat(np.arange(len(count)), each)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
        start = off[text] + nth * step
        end = np.minimum(start + size, off[text + 1])
        some = np.flatnonzero(sums[end] - sums[start] >= 1 - 1e-6)
        return text[some], start[some], end[some]

    def blocks_of(self, k: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(passage, its distinct terms, blocks) where the block's maxima sum to 1: bounds for all passages at once.

        A passage's commonest words, with bounds of ``REST`` in all, count by their bound alone.
        """
        size = max(1, len(self.terms))
        for lo in range(0, len(start), step := max(1, HELD // max(self.blocks, 1))):
            s, e = start[lo : lo + step], end[lo : lo + step]
            p = np.repeat(np.arange(len(s)), e - s)
            t = k[runs_to_index(s, e - s)]
            p, t = np.divmod(np.unique(p[t >= 0] * size + t[t >= 0]), size)
            order = np.lexsort((t, -self.spread[t], p))
            p, t = p[order], t[order]
            first = np.searchsorted(p, np.arange(len(s) + 1))
            run = np.cumsum(self.bound[t])
            before = np.concatenate([[0.0], run])[first[:-1]]
            common = run - before[p] <= REST
            rest = np.bincount(p[common], self.bound[t[common]], len(s))
            q, u = p[~common], t[~common]
            at = runs_to_index(self.block_start[u], self.spread[u])
            sums = np.bincount(np.repeat(q, self.spread[u]) * self.blocks + self.block_at[at], self.block_bound[at], len(s) * self.blocks).reshape(len(s), self.blocks)
            hit = sums + rest[:, None] >= 1 - 1e-6
            for i in np.flatnonzero(hit.any(axis=1)).tolist():
                yield lo + i, t[first[i] : first[i + 1]].tolist(), np.flatnonzero(hit[i]).tolist()

    def matches(self, k: np.ndarray, words: np.ndarray, off: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(text, item) -> (score, question share, answer share) of the contaminated pairs."""
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        texts, starts, ends = self.passages(k, off)
        for i, terms, blocks in self.blocks_of(k, starts, ends):
            got = self.search(terms, blocks)
            if not got:
                continue
            text, passage = int(texts[i]), words[starts[i] : ends[i]]
            own = grams(passage)
            for item, score in got:
                q, a = (self._share(x, passage, own) for x in (self.question[item], self.answer[item]))
                if q >= QUESTION and a >= ANSWER:
                    old = out.get((text, item))
                    if old is None or score * RETRIEVE > old[0]:
                        out[text, item] = (score * RETRIEVE, q, a)
        return out

    def _share(self, wanted: np.ndarray, words: np.ndarray, own: np.ndarray) -> float:
        if not len(wanted):
            return 1.0
        share = float(np.isin(wanted, own).mean())
        if len(wanted) == 1 and not share:  # perhaps a part of fewer words than a gram
            share = float(any(wanted[0] in grams(words, n) for n in range(1, min(GRAM, len(words) + 1))))
        return share


def shards(benchmark: DataFrame) -> Iterator[Shard]:
    """The shards of the index, one by one; each is collected by itself and bounded in bytes."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    total, n = items.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    many = max(1, -(-(total or 0) // SHARD_BYTES))
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(many * BUCKETS))

    def terms(batches):
        for batch in batches:
            for _, words, off in word_hashes(batch.column(0)):
                doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
                pairs = np.unique(np.stack([doc.astype(np.uint64), words]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64)), pa.array(np.ones(pairs.shape[1], np.int64))], ["term", "n"])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([len(words)])], ["term", "n"])

    counts = items.select("text").mapInArrow(trimmed(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    groups: list[list[int]] = [[]]
    if many > 1:
        counts, filled = written(counts, "terms"), 0
        for b, size in sorted(items.groupBy(bucket.alias("b")).agg(F.sum(F.octet_length("text"))).collect()):  # BUCKETS rows for each shard
            if groups[-1] and filled + size > SHARD_BYTES:
                groups.append([])
                filled = 0
            groups[-1].append(b)
            filled += size
    words = counts.where("term is null").first()
    mean = (words["n"] if words else 0) / max(n, 1) or 1.0
    for group in groups:
        own = items.where(bucket.isin(group)) if many > 1 else items
        rows = own.orderBy("item_id", "text").collect()
        df = counts.where("term is not null")
        if many > 1:
            df = df.join(own.select("text").mapInArrow(trimmed(terms), "term long, n long").select("term").distinct(), "term")
        yield Shard([r["item_id"] for r in rows], [r["text"] for r in rows], {r["term"]: r["n"] for r in df.collect()}, n, mean)


def _each(benchmark: DataFrame, spark: SparkSession) -> Iterator[tuple[Broadcast, bool]]:
    """Each shard's broadcast and whether others follow; what is done with one that others follow must be done at once."""
    coming = shards(benchmark)
    shard = next(coming)
    while shard is not None:
        sent, shard = spark.sparkContext.broadcast(shard), None
        shard = next(coming, None)
        yield sent, shard is not None
        if shard is not None:
            sent.destroy()


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of the contaminated pairs; score 1 is the item itself."""
    out = None
    for sent, more in _each(benchmark, docs.sparkSession):

        def step(batches, sent=sent):
            for batch in batches:
                for at, words, off in word_hashes(batch.column(1)):
                    found = sent.value.matches(words, off)
                    if found:
                        rows = pa.array([t for t, *_ in found])
                        cols = zip(*found.values(), strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(off) - 1).take(rows), pa.array([sent.value.id_of(c, i) for _, c, i in found], pa.int64()), *(pa.array(c, pa.float64()) for c in cols)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(step), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        part = written(part, "hits") if more else part
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that no item of the benchmark matches."""
    text = docs.columns.index("text")
    for sent, more in _each(benchmark, docs.sparkSession):

        def step(batches, sent=sent):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for at, words, off in word_hashes(batch.column(text)):
                    keep[[at + t for t, *_ in sent.value.matches(words, off)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(trimmed(step), docs.schema)
        docs = written(docs, "clean") if more else docs
    return docs
