"""Substring deduplication by repeated-phrase automata.

Windows of ``length`` words can recur only where their seeds do (``windows``). The
stretches around repeated seeds are dealt to shards by seed, each distinct stretch once
with the number of its copies. A shard works through its seeds in batches: it confirms
the recurring windows (whole word sequences, counted with copies), compiles the phrases
they form (each stretch's runs of such windows) into an Aho-Corasick automaton in which each
word is one symbol, and streams all stretches through it, which locates every occurrence.
What it finds applies to all copies of a stretch. Where a seed has very many different
stretches, their windows are counted before the shuffle and dealt out one by one.

Defined results: a word is a maximal run without ASCII white space; null texts have no
words; windows never cross documents; different texts of one doc_id are documents of their own,
and rows equal in id and text are copies, whose windows recur; rows without a doc_id are
kept whole and make no other go; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SliceHash, numbered, partitions, trimmed, word_slices, written
from .suffixes import _spans, with_spans
from .windows import repeated

#: Fixed value: what a word is.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Windows that one automaton is confirmed from.
BATCH = 40_000
#: Different stretches of a seed above which its windows are dealt out one by one.
MANY = 2_000


def words_as_units(b: np.ndarray, off: np.ndarray):
    start, end, first = word_slices(b, off, (b == 0x20) | (b >= 0x09) & (b <= 0x0D))
    return SliceHash(b).of(start, end), first


def locate(segments: list[tuple[list[str], int]], length: int) -> list[list[tuple[int, int]]]:
    """For each (words, copies): runs (from, to) of its windows that occur more than once in all."""
    import ahocorasick

    symbol: dict[str, str] = {}
    texts = []
    for words, _ in segments:
        out = []
        for w in words:
            s = symbol.get(w)
            if s is None:
                k = len(symbol) + 1
                s = symbol[w] = chr(k if k < 0xD800 else k + 0x800)
            out.append(s)
        texts.append("".join(out))
    counts: dict[str, int] = {}
    for text, (_, copies) in zip(texts, segments, strict=True):
        for i in range(len(text) - length + 1):
            w = text[i : i + length]
            counts[w] = counts.get(w, 0) + copies
    automaton = ahocorasick.Automaton()
    for text in texts:
        # a stretch's run of recurring windows is one phrase: fewer nodes than its windows one by one
        at, ends = 0, len(text) - length + 1
        while at < ends:
            to = at
            while to < ends and counts[text[to : to + length]] > 1:
                to += 1
            if to > at:
                automaton.add_word(text[at : to + length - 1], to - at)
            at = to + 1
    if not len(automaton):
        return [[] for _ in segments]
    automaton.make_automaton()
    found = []
    for text in texts:
        runs: list[list[int]] = []
        for end, n in automaton.iter(text):
            last = end - length + 2
            first = last - n
            while runs and runs[-1][1] >= first:
                first = min(first, runs.pop()[0])
            runs.append([first, last])
        found.append([tuple(r) for r in runs])
    return found


def _shard(batches, length: int):
    """Work through one shard, whose rows (key, id1, id2, copies, segment) are sorted by key."""
    names = ["id1", "id2", "first", "last"]
    held: list[tuple] = []
    windows, key = 0, None

    def flush():
        found = locate([(r[3].split(" "), r[2]) for r in held], length)
        rows = [(r[0], r[1], f, z) for r, runs in zip(held, found, strict=True) for f, z in runs]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names)

    for batch in batches:
        for k, a, b, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key and windows >= BATCH:
                yield flush()
                held, windows = [], 0
            key = k
            held.append((a, b, n, text))
            windows += text.count(" ") + 2 - length
    if held:
        yield flush()


def _segments(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(id1, id2, copies, many, shift, segment): the words of wanted stretches; of seeds with many, each window."""

    def step(batches):
        names = ["seed", "content", "copies", "many", "shift", "segment"]
        for batch in batches:
            out: list[tuple] = []
            for text, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall(text)
                for x in wants:
                    at, n = x["at"], x["windows"]
                    if not x["many"]:
                        out.append((x["seed"], x["content"], x["n"], False, 0, " ".join(words[at : at + n + length - 1])))
                    else:
                        out += [(x["seed"], x["content"], x["n"], True, i, " ".join(words[at + i : at + i + length])) for i in range(n)]
                if len(out) > 5_000:
                    yield _rows(out, names)
                    out = []
            if out:
                yield _rows(out, names)

    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("seed", "content", "at", "windows", "n", "many")).alias("wants"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    return own.join(lists, "doc_id").select("text", "wants").mapInArrow(trimmed(step), "seed long, content long, copies long, many boolean, shift int, segment string")


def _rows(out, names):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def recurring(docs: DataFrame, length: int = 35, seed: int = 12) -> DataFrame:
    """(doc_id, from, to): word spans of ``docs``, where an id has one text, covered by windows that occur elsewhere too."""
    spark = docs.sparkSession
    found = repeated(docs, words_as_units, length, seed)
    first = found.groupBy("seed", "content").agg(F.min(F.struct("doc_id", "at", "windows")).alias("x"), F.count(F.lit(1)).alias("n"))
    first = written(first.select("seed", "content", "x.*", "n"), "first", release=True)
    many = first.groupBy("seed").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > MANY).select("seed", F.lit(True).alias("many"))
    wanted = first.join(many, "seed", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    parts = written(_segments(docs, wanted, length), "segments", release=True)
    plain = parts.where("not many").select(F.col("seed").alias("key"), F.col("seed").alias("id1"), F.col("content").alias("id2"), "copies", "segment")
    ids = [F.xxhash64("segment").alias("id1"), F.xxhash64(F.lit(1), "segment").alias("id2")]
    single = parts.where("many").groupBy("segment").agg(F.sum("copies").alias("copies")).select(ids[0].alias("key"), *ids, "copies", "segment")
    shards = plain.unionByName(single).repartition(partitions(spark), "key").sortWithinPartitions("key")
    located = written(shards.mapInArrow(trimmed(lambda batches: _shard(batches, length)), "id1 long, id2 long, first int, last int"), "located", release=True)
    spread = parts.where("many").select("seed", "content", "shift", *ids).join(located, ["id1", "id2"]).select("seed", "content", F.col("shift").alias("first"), (F.col("shift") + 1).alias("last"))
    every = located.select(F.col("id1").alias("seed"), F.col("id2").alias("content"), "first", "last").unionByName(spread)
    return found.join(every, ["seed", "content"]).select("doc_id", (F.col("at") + F.col("first")).alias("from"), (F.col("at") + F.col("last") + (length - 1)).alias("to"))


def digests(docs: DataFrame, length: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""

    def step(batches):
        for batch in batches:
            rows = []
            for text, flat in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = WORD.findall(text or "")
                kept, at = [], 0
                for f, z in _spans(flat, len(words)):
                    kept += words[at:f]
                    at = z
                kept += words[at:]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    own = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = recurring(own.select(F.col("row").alias("doc_id"), "text"), length)
    return with_spans(own, spans, "row").select("doc_id", "text", "spans").mapInArrow(trimmed(step), "doc_id long, n_words long, n_removed long, kept_sha256 string")
