"""Token-ID output: Elias-Fano document boundaries over one concatenated id array.

Documents are range-partitioned and sorted by id, encoded, and written as blocks. A block
is self-contained bytes:

    magic "FWTK", version u8, id width u8, low bits of the two lists u8 u8, flags u64
    n_docs u64, n_ids u64, before u64 (ids of earlier blocks of the part), least doc id i64
    sizes of the six arrays, u64 each
    boundaries: low bits, high bits, select samples; doc ids: the same three; then the ids

Both lists are monotone and Elias-Fano coded: the low bits are packed, the high bits are
set at place ``(value >> low) + index`` of a bit vector, and every SAMPLE-th set bit's
place is kept as u32, so ``select`` answers one offset by a short popcount scan. Blocks
are rows of a Parquet table, whose committer keeps only the output of tasks that ended,
so a lost executor leaves no half-written block.

Defined results: a null or empty text has the end id alone; documents without an id come
before all others, in blocks that say so; equal doc ids, and documents without one, follow
each other in order of text hash and text, so that many of them are spread over tasks; an
empty table gives no blocks; other columns are ignored.
"""

from __future__ import annotations

import os
import string
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, raw_file, trimmed

SAMPLE = 256
MAGIC = b"FWTK\x01"
HEADER = struct.Struct("<5sBBBQQQQq6Q")
#: Flag of a block whose documents have no ids.
NO_IDS = 1
#: Characters of text in a block, unless one document is longer.
BLOCK_CHARS = 4_000_000
#: Documents that are split and looked up at a time, so that their words stay in the cache.
SLICE = 64
#: Distinct words after which a worker's memo starts anew; the one before it is kept for words that come again.
MEMO = 1_000_000


class EliasFano:
    """A non-decreasing list of non-negative numbers in about 2 + log2(max / n) bits each."""

    def __init__(self, n: int, low: int, low_bytes: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.low_bytes, self.high, self.samples = n, low, low_bytes, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v, n = values.astype(np.uint64), len(values)
        top = int(v[-1]) if n else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        at = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(at[-1]) + 8) // 8 * 8 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, low, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def _low(self, i: int) -> int:
        out = 0
        for k in range(self.low):
            p = i * self.low + k
            out |= (int(self.low_bytes[p >> 3]) >> (p & 7) & 1) << k
        return out

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample by popcounts of bytes."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE + 1
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (c := word.bit_count()) < left:
            left -= c
            byte += 1
            word = int(self.high[byte])
        for _ in range(left - 1):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - i) << self.low | self._low(i)

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low_bytes, count=self.n * self.low, bitorder="little").reshape(self.n, self.low).astype(np.uint64)
        return (at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low) | (bits << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def arrays(self) -> list[bytes]:
        return [self.low_bytes.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()]


def pack(doc_ids: np.ndarray | None, counts: np.ndarray, ids: bytes, width: int, before: int) -> bytes:
    """One block from ascending doc ids (None: there are none), ids per document and all ids in ``width`` bytes each."""
    flags = NO_IDS if doc_ids is None else 0
    if doc_ids is None:
        doc_ids = np.zeros(len(counts), np.int64)
    least = int(doc_ids[0]) if len(doc_ids) else 0
    ends, names = EliasFano.of(np.cumsum(counts)), EliasFano.of(doc_ids.astype(np.int64).view(np.uint64) - np.int64(least).view(np.uint64))
    parts = [*ends.arrays(), *names.arrays()]
    head = HEADER.pack(MAGIC, width, ends.low, names.low, flags, len(doc_ids), len(ids) // width, before, least, *map(len, parts))
    return b"".join([head, *parts, ids])


class Block:
    """A block read back."""

    def __init__(self, data: bytes):
        magic, self.width, low, low2, self.flags, self.n_docs, self.n_ids, self.before, self.least, *sizes = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at, parts = HEADER.size, []
        for size, kind in zip(sizes, (np.uint8, np.uint8, "<u4") * 2, strict=True):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        self.ends = EliasFano(self.n_docs, low, *parts[:3])
        self.names = EliasFano(self.n_docs, low2, *parts[3:])
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at)

    def span(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def doc_ids(self) -> pa.Array:
        if self.flags & NO_IDS:
            return pa.nulls(self.n_docs, pa.int64())
        return pa.array([self.names.select(i) + self.least for i in range(self.n_docs)], pa.int64())


class WordEncoder:
    """The tokenizers library applied once to each distinct word.

    For files whose splitting drops white space and never crosses it: a text's ids are then
    those of its white-space-separated words. ``splits_at_spaces`` says whether a file is
    such; texts of other files, and texts with control characters that Python alone takes
    for white space, go to the library whole.

    New words go to the library many at a time. Where a file marks the last id of each of
    its pieces, words that are one piece (letters alone, by the library's own splitting of
    each letter) are encoded as one text and cut at the marks; others are a text each.
    """

    ODD = "\x1c\x1d\x1e\x1f"
    #: Marks that end a word and that the library encodes by themselves.
    MARKS = string.punctuation
    #: Words in one text; what ends the last id of a piece.
    JOINED, LAST = 400, "</w>"

    def __init__(self, raw: bytes, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.kind, self.memo, self.older = Tokenizer.from_str(raw.decode()), f"<u{width}", {}, {}
        self.by_word, self.normal = splits_at_spaces(self.tok), self.tok.normalizer
        self.ids = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        self.by_mark = all(self.ids(w + m) == self.ids(w) + self.ids(m) for w in ("abc", "É", "日本") for m in (*self.MARKS, ".,", "?!"))
        self.any_case = self.ids("ABC dEf XYZ") == self.ids("abc def xyz")
        self.letters, self.others, self.latin = set(), set(), False
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.last[[i for w, i in vocab.items() if w.endswith(self.LAST)]] = True
        self.latin = self._plain(string.ascii_letters)

    def whole(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        return [np.array(e.ids, self.kind).tobytes() for e in encode(texts, add_special_tokens=False)]

    def _pieces(self, text: str) -> list[str]:
        text = self.normal.normalize_str(text) if self.normal else text
        return [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)] if self.tok.pre_tokenizer else [text]

    def _plain(self, word: str) -> bool:
        """Whether the library takes the word for one piece, whatever marks follow: each character is a letter to it."""
        if word.isascii() and word.isalpha() and self.latin or self.letters.issuperset(word):
            return True
        if not self.others.isdisjoint(word):
            return False
        mark = self._pieces(",")
        for c in set(word) - self.letters:
            inside, before = self._pieces(f"a{c}b"), self._pieces(f"{c},")
            (self.letters if c.isalpha() and len(inside) == 1 and len(before) == 2 and before[1:] == mark else self.others).add(c)
        return self.letters.issuperset(word)

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of words; letters alone and the marks after them are encoded once each."""
        memo, older, marks, plain = self.memo, self.older, self.MARKS if self.by_mark else "", self._plain
        parts, one, rest = [], set(), set()
        for w in words:
            if w in older:
                memo[w] = older[w]
                continue
            core = w.rstrip(marks)
            if core and plain(core):
                tail = w[len(core) :]
                if self.any_case and core.isascii():
                    core = core.lower()
                one.add(core)
                if tail:
                    rest.add(tail)
                if core != w:
                    parts.append((w, core, tail))
            else:
                rest.add(w)
        one, rest = [w for w in one if w not in memo], [w for w in rest if w not in memo]
        groups = [one[i : i + self.JOINED] for i in range(0, len(one), self.JOINED)]
        for words, ids in zip(groups, self.whole([" ".join(g) for g in groups]), strict=True):
            self._cut(words, ids)
        for i in range(0, len(rest), 20_000):
            memo.update(zip(rest[i : i + 20_000], self.whole(rest[i : i + 20_000]), strict=True))
        for w, core, tail in parts:
            memo[w] = memo[core] + memo[tail] if tail else memo[core]

    def _cut(self, words: list[str], ids: bytes) -> None:
        """Remember words of one piece each from the ids of their joined text."""
        ends = (np.flatnonzero(self.last[np.frombuffer(ids, self.kind)]) + 1) * np.dtype(self.kind).itemsize
        if len(ends) == len(words) and ends[-1] == len(ids):
            at = [0, *ends.tolist()]
            self.memo.update((w, ids[s:e]) for w, s, e in zip(words, at, at[1:], strict=False))
        else:  # a file without such marks
            self.memo.update(zip(words, self.whole(words), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.whole(texts)
        split = [None if any(c in t for c in self.ODD) else t.split() for t in texts]
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        found, new, get = [], set(), self.memo.get
        for s in split:
            got = list(map(get, s)) if s else []
            holes = [i for i, x in enumerate(got) if x is None]
            if holes:
                new.update(map(s.__getitem__, holes))
            found.append((got, holes))
        if new:
            self._learn(new)
        memo, out = self.memo, []
        for t, s, (got, holes) in zip(texts, split, found, strict=True):
            for i in holes:
                got[i] = memo[s[i]]
            out.append(self.whole([t])[0] if s is None else b"".join(got))
        return out


def splits_at_spaces(tok) -> bool:
    """Whether words encode alone as they do in a text, tried on a probe with every white-space character."""
    probe = ["Xa", "don't", "é", "12!?", "<|endoftext|>b"]
    spaces = " \t\n\x0b\x0c\r\x85\xa0       　"
    whole = tok.encode("".join(f"{w}{s}{w}{s}{s}" for s in spaces for w in probe), add_special_tokens=False).ids
    alone = [i for _ in spaces for w in probe for _ in range(2) for i in tok.encode(w, add_special_tokens=False).ids]
    return whole == alone


_encoders: dict[tuple[int, int], WordEncoder] = {}


def encoder_of(raw: bytes, width: int) -> WordEncoder:
    """The worker's encoder of a file, kept from task to task.

    A step must reach it by this function: globals that a nested function names itself are
    sent with it, so that every task would get an empty dictionary of its own.
    """
    key = (zlib.crc32(raw), width)
    if key not in _encoders:
        _encoders[key] = WordEncoder(raw, width)
    return _encoders[key]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write their blocks under ``path`` in ascending id order."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    raw = raw_file(tokenizer)
    width = 2 if Tokenizer.from_str(raw.decode()).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    sent = spark.sparkContext.broadcast(raw)

    def step(batches):
        enc, part, block, before = encoder_of(sent.value, width), TaskContext.get().partitionId(), 0, 0
        stop = np.array([end_id], enc.kind).tobytes()
        for batch in batches:
            none = batch.column(0).null_count  # they come first
            ids, texts = batch.column(0).fill_null(0).to_numpy(), [t or "" for t in batch.column(1).to_pylist()]
            i = 0
            while i < len(texts):
                j, n = i, 0
                end = none if i < none else len(texts)
                while j < end and (j == i or n + len(texts[j]) <= BLOCK_CHARS):
                    n += len(texts[j])
                    j += 1
                got = [x for k in range(i, j, SLICE) for x in enc.encode(texts[k : min(k + SLICE, j)])]
                counts = np.fromiter(map(len, got), np.int64, j - i) // width + 1
                data = pack(None if i < none else ids[i:j], counts, stop.join(got) + stop, width, before)
                total = int(counts.sum())
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], ["part", "block", "n_ids", "data"])
                block, before, i = block + 1, before + total, j

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = ["id", F.xxhash64("text"), "text"]
    rows = rows.repartitionByRange(partitions(spark), *order[:2]).sortWithinPartitions(*order)
    rows.mapInArrow(trimmed(step), "part int, block int, n_ids long, data binary").write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, per_block, schema: str) -> DataFrame:
    """Apply ``per_block(block, ids before it)``, which returns a record batch, to each block of ``path``.

    The ids before a part come from one total per part; a block carries those before it in its part.
    """
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each written partition
    base, at = {}, 0
    for r in totals:
        base[r["part"]] = at
        at += r["n"]

    def step(batches):
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = Block(data.as_buffer())
                yield per_block(b, base[part] + b.before)

    return blocks.select("part", "data").mapInArrow(trimmed(step), schema)


def spans(b: Block, before: int) -> pa.RecordBatch:
    """(doc_id, start, n_tokens, ids_crc32) of a block's documents, each found by select."""
    ids, ends = b.ids.astype("<u4"), [b.ends.select(i) for i in range(b.n_docs)]
    at = list(zip([0, *ends], ends, strict=False))
    columns = [s + before for s, _ in at], [e - s for s, e in at], [zlib.crc32(ids[s:e]) for s, e in at]
    return pa.RecordBatch.from_arrays([b.doc_ids(), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "start", "n_tokens", "ids_crc32"])


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    return read(spark, path, spans, "doc_id long, start long, n_tokens long, ids_crc32 long")
