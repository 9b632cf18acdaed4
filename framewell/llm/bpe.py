"""Byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash (hash and displace) resolves every pre-token that is
itself a vocabulary entry; the candidate entry's bytes are compared, so a hit is exact.
Other pre-tokens are merged with a heap over linked bytes, once for each distinct piece,
and kept in a bounded memo. Splitting into pre-tokens, hashing, look-up, assembling and
decoding are array operations over an Arrow batch's own UTF-8 buffer.

Defined results: a null or empty text has no ids (digests of nothing); long texts are
processed whole; repeated rows give repeated rows; an empty table gives an empty table;
columns other than the named id and text are ignored. No special token is ever produced.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mixed, raw_file, runs_to_index, text_parts, trimmed, words8

#: Distinct pieces that a worker remembers; beyond it the memo starts anew.
MEMO = 1_000_000
#: Bytes of text split and looked up at once.
PART = 4 << 20
#: The split pattern that ``split_points`` implements (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE, LETTER, NUMBER, OTHER = range(4)
_U = np.uint64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of each code point: white space, letter, number or other."""
    if not _classes:
        import regex

        out = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pat in ((SPACE, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pat, every):
                a, z = ord(m[0][0]), ord(m[0][-1])
                out[a : z + 1] = kind
        out[0xD800:0xE000] = OTHER
        _classes.append(out)
    return _classes[0]


def byte_classes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of the character that each byte belongs to, whether a byte starts a character)."""
    table = classes()
    cls = table[:256][b]
    first = (b & 0xC0) != 0x80
    lead = np.flatnonzero(b >= 0xC0)
    if len(lead):
        n = len(b)
        at = lambda k: (b[np.minimum(lead + k, n - 1)] & 0x3F).astype(np.uint32)
        b0 = b[lead].astype(np.uint32)
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        cp = np.where(size == 2, (b0 & 0x1F) << 6 | at(1), np.where(size == 3, (b0 & 0x0F) << 12 | at(1) << 6 | at(2), (b0 & 7) << 18 | at(1) << 12 | at(2) << 6 | at(3)))
        kind = table[np.minimum(cp, 0x10FFFF)]
        cls[lead] = kind
        for k in (1, 2, 3):
            more = size > k
            cls[np.minimum(lead[more] + k, n - 1)] = kind[more]
    return cls, first


def split_points(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions where PATTERN's matches start, for texts laid end to end at ``off``.

    A match never crosses a text's end and the matches cover every byte.
    """
    n = len(b)
    if not n:
        return np.empty(0, np.int64)
    cls, first = byte_classes(b)
    head = np.zeros(n + 1, bool)
    head[off] = True
    head = head[:n]
    run = head.copy()
    run[1:] |= cls[1:] != cls[:-1]
    space = cls == SPACE
    after = np.zeros(n, bool)  # a run that follows white space of the same text
    after[1:] = run[1:] & ~head[1:] & space[:-1] & ~space[1:]
    start = run.copy()
    at = np.flatnonzero(after)
    blank = b[at - 1] == 0x20
    start[at[blank]] = False
    last = at - 1
    while (inside := ~first[last]).any():
        last = np.where(inside, last - 1, last)
    start[last] = True
    # contractions: an apostrophe that starts a match, with letters right behind it
    at = np.flatnonzero((b == 0x27) & start)
    at = at[(at + 1 < n)]
    at = at[(cls[at + 1] == LETTER) & ~head[at + 1]]
    if len(at):
        end_of = off[np.searchsorted(off, at, "right")]
        pad = np.concatenate([b, np.zeros(3, np.uint8)])
        x, y = pad[at + 1], pad[at + 2]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = (((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)) & (at + 3 <= end_of)
        size = np.where(one, 2, np.where(two, 3, 0))
        at, size, end_of = at[size > 0], size[size > 0], end_of[size > 0]
        start[at + 1] = False
        nxt = at + size
        ok = nxt < end_of
        # a character after the contraction starts a match
        start[nxt[ok]] = True
    return np.flatnonzero(start)


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: ``slot = of(keys)`` is a bijection onto 0..n-1."""

    def __init__(self, keys: np.ndarray, per_bucket: int = 2):
        self.n = n = len(keys)
        self.buckets = m = max(1, n // per_bucket)
        bucket = (mixed(keys) % _U(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=m)
        starts = np.concatenate([[0], np.cumsum(size)])
        taken = np.zeros(n, bool)
        shift = np.zeros(m, np.int64)  # >= 0: a seed; < 0: -(slot + 1), for a bucket of one key
        free = None
        for k in np.argsort(-size, kind="stable").tolist():
            if not size[k]:
                break
            own = keys[order[starts[k] : starts[k + 1]]]
            if size[k] == 1:
                if free is None:
                    free = iter(np.flatnonzero(~taken).tolist())
                shift[k] = -next(free) - 1
                continue
            seed, slots = 0, None
            while slots is None:
                tried = self._slots(own[None, :], np.arange(seed, seed + 64, dtype=np.uint64)[:, None]).astype(np.int64)
                good = ~taken[tried].any(axis=1)
                for i in np.flatnonzero(good).tolist():
                    if len(set(row := tried[i].tolist())) == len(row):
                        seed, slots = seed + i, row
                        break
                else:
                    seed += 64
            taken[slots] = True
            shift[k] = seed
        self.shift = shift

    def _slots(self, keys, seed):
        return mixed(keys + (seed + _U(1)) * _U(0x9E3779B97F4A7C15)) % _U(self.n)

    def of(self, keys: np.ndarray) -> np.ndarray:
        d = self.shift[(mixed(keys) % _U(self.buckets)).astype(np.int64)]
        return np.where(d < 0, -d - 1, self._slots(keys, np.maximum(d, 0).astype(np.uint64)).astype(np.int64))


class Vocabulary:
    """Ranks of byte strings, with the perfect hash over them and the merge table."""

    def __init__(self, raw: bytes):
        pairs = [line.split() for line in raw.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(a): int(r) for a, r in pairs}
        toks = sorted(self.ranks, key=self.ranks.get)
        self.ids = np.array([self.ranks[t] for t in toks], np.int64)
        self.top = int(self.ids.max()) + 1
        self.bytes = np.frombuffer(b"".join(toks), np.uint8)
        size = np.array([len(t) for t in toks], np.int64)
        off = np.concatenate([[0], np.cumsum(size)])
        # by id, for decoding
        self.size = np.zeros(self.top, np.int64)
        self.start = np.zeros(self.top, np.int64)
        self.size[self.ids], self.start[self.ids] = size, off[:-1]
        keys, w0, w1, w2 = self.keys(self.bytes, off[:-1], off[1:])
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two entries have the same 64-bit key")
        self.hash = PerfectHash(keys)
        slot = self.hash.of(keys)
        for name, of in (("id_at", self.ids), ("size_at", size), ("w0", w0), ("w1", w1), ("w2", w2)):
            out = np.empty_like(of)
            out[slot] = of
            setattr(self, name, out)
        self.merges: dict[int, int] | None = None
        self.memo: dict[bytes, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"merges": None, "byte_pairs": None, "byte_id": None, "memo": {}}

    @staticmethod
    def keys(b, start, end):
        """(64-bit key, first 8, next 8 and last 8 bytes) of each slice; the middle of slices over 24 bytes is hashed too."""
        w = words8(b)
        size = end - start
        w = np.append(w, _U(0))
        n = len(b)
        w0 = w[np.minimum(start, n)] & _MASK[np.minimum(size, 8)]
        w1 = w[np.minimum(start + 8, n)] & _MASK[np.clip(size - 8, 0, 8)]
        w2 = np.where(size > 16, w[np.maximum(end - 8, 0)], _U(0))
        key = mixed(mixed(w0) + size.astype(np.uint64)) + mixed(w1 + _U(0x632BE59BD9B4E019)) * _U(3) + mixed(w2 ^ _U(0x85157AF5)) * _U(5)
        for i in np.flatnonzero(size > 24).tolist():
            key[i] = _U(int.from_bytes(hashlib.blake2b(b[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little"))
        return key, w0, w1, w2

    def _merge_table(self) -> dict[int, int]:
        """(left id << 32 | right id) -> merged id, for each split of an entry in two entries."""
        get, out = self.ranks.get, {}
        for tok, r in self.ranks.items():
            for k in range(1, len(tok)):
                if (a := get(tok[:k])) is not None and (b := get(tok[k:])) is not None:
                    out[a << 32 | b] = r
        return out

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: a heap of (rank, place) over linked bytes; the lowest rank, then the leftmost, merges first."""
        if self.merges is None:
            self.merges = self._merge_table()
            self.byte_id = one = [self.ranks[bytes([k])] for k in range(256)]
            self.byte_pairs = [[self.merges.get(x << 32 | y) for y in one] for x in one]
        get, n, pair = self.merges.get, len(piece), self.byte_pairs
        ids = [*map(self.byte_id.__getitem__, piece)]
        heap = [r << 32 | i for i, (x, y) in enumerate(zip(piece, piece[1:], strict=False)) if (r := pair[x][y]) is not None]
        if not heap:
            return ids
        heapify(heap)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        while heap:
            e = heappop(heap)
            i, r = e & 0xFFFFFFFF, e >> 32
            j = right[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 32 | ids[j]) != r:
                continue  # one of the two has merged since
            ids[i], ids[j] = r, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                s = get(r << 32 | ids[k])
                if s is not None:
                    heappush(heap, s << 32 | i)
            h = left[i]
            if h >= 0:
                s = get(ids[h] << 32 | r)
                if s is not None:
                    heappush(heap, s << 32 | h)
        return [x for x in ids if x >= 0]

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece, end to end, and how many each has."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        out = []
        for p in pieces:
            got = memo.get(p)
            if got is None:
                got = memo[p] = np.array(self.merge(p), "<u4").tobytes()
            out.append(got)
        return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out)) >> 2

    def encode(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets of the texts in them)."""
        start = split_points(b, off)
        if not len(start):
            return np.empty(0, "<u4"), np.zeros(len(off), np.int64)
        end = np.append(start[1:], len(b))
        key, w0, w1, w2 = self.keys(b, start, end)
        size = end - start
        slot = self.hash.of(key)
        hit = (self.size_at[slot] == size) & (self.w0[slot] == w0) & (self.w1[slot] == w1) & (self.w2[slot] == w2)
        for i in np.flatnonzero(hit & (size > 24)).tolist():
            s = self.start[self.id_at[slot[i]]]
            hit[i] = b[start[i] : end[i]].tobytes() == self.bytes[s : s + size[i]].tobytes()
        count = np.ones(len(start), np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            _, one, group = np.unique(key[miss], return_index=True, return_inverse=True)
            rep = miss[one]
            same = (size[miss] == size[rep][group]) & (w0[miss] == w0[rep][group]) & (w1[miss] == w1[rep][group]) & (w2[miss] == w2[rep][group])
            if not same.all():  # keys that collide: each differing place stands for itself
                odd = np.flatnonzero(~same)
                group[odd] = len(rep) + np.arange(len(odd))
                rep = np.concatenate([rep, miss[odd]])
            data = b.tobytes()
            ids, each = self._pieces([data[s:e] for s, e in zip(start[rep].tolist(), end[rep].tolist(), strict=True)])
            begin = np.cumsum(each) - each
            count[miss] = each[group]
        place = np.cumsum(count)
        out = np.empty(int(place[-1]), "<u4")
        out[(place - count)[hit]] = self.id_at[slot[hit]]
        if len(miss):
            out[runs_to_index((place - count)[miss], count[miss])] = ids[runs_to_index(begin[group], count[miss])]
        before = np.concatenate([[0], place])
        return out, before[np.searchsorted(start, off, "left")]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids end to end, where each id's bytes end)."""
        ids = ids.astype(np.int64)
        size = self.size[ids]
        return self.bytes[runs_to_index(self.start[ids], size)], np.cumsum(size)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    raw = raw_file(path)
    key = hashlib.sha256(raw).hexdigest()
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(raw)
    return _vocabularies[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row's whole text."""
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def step(batches):
        v = vocab.value
        for batch in batches:
            for at, b, off in text_parts(batch.column(1), PART):
                ids, o = v.encode(b, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(off) - 1), pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(ids.astype(np.int32)))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(trimmed(step), f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) of rows of ids; null ids give no bytes."""
    vocab = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def step(batches):
        v = vocab.value
        for batch in batches:
            out = [v.decode(np.array(x or [], np.int64))[0].tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(trimmed(step), f"`{id_col}` {kind}, bytes binary")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, decode its ids, and return counts and digests of both.

    The ids never leave the worker, so no id array crosses to the JVM.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def step(batches):
        v, sha = vocab.value, lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for at, b, off in text_parts(batch.column(1), PART):
                ids, o = v.encode(b, off)
                data, ends = v.decode(ids)
                ends = np.concatenate([[0], ends])[o].tolist()
                o = o.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(off) - 1),
                        pa.array(np.diff(o), pa.int64()),
                        pa.array([sha(ids[x:y]) for x, y in zip(o, o[1:], strict=False)]),
                        pa.array([sha(data[x:y]) for x, y in zip(ends, ends[1:], strict=False)]),
                    ],
                    [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(trimmed(step), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
