"""Byte-level BPE in two tiers: a minimal perfect hash for whole pieces, a heap for the rest.

The vocabulary file has one token and its rank a line. Its tokens get a minimal perfect hash
(hash, displace and compress): a first hash picks a bucket, the bucket's displacement places
each of its tokens on a slot of its own, and slot numbers lead to ranks. A piece of text that
is a token costs one lookup and one comparison. Other pieces are merged from single bytes:
a heap holds the mergeable neighbours by rank and position, bytes form a linked list, and
stale heap entries are skipped, so a piece of n bytes takes n log n steps. Up to 32 bytes a
look at all neighbours takes less than a heap.

A text is first cut at single spaces between other characters, where every piece ends whatever
stands around. Each task resolves the distinct chunks of a slice of texts together and
remembers the latest of them. The tables are as large as the vocabulary file and
broadcast.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Recent, lean, parted
from .shingles import mix

#: Pieces and chunks that a worker remembers; up to twice as many are held.
REMEMBERED, CHUNKS = 100_000, 50_000
SLICE = 250_000
#: Bytes of a piece that is merged without a heap.
FEW = 32
_LOAD = 4
_CUT, _UNEVEN = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"^\s| \s|\s |\s$")


class Vocabulary:
    """Tokens by rank with their perfect hash. Small enough to ship to every task."""

    def __init__(self, tokens: list[bytes], ranks: list[int]):
        order = np.argsort(np.asarray(ranks), kind="stable")
        self.tokens = [tokens[i] for i in order]
        self.ranks = np.asarray(ranks, dtype=np.uint32)[order]
        self._place(np.array([xxhash.xxh3_64_intdigest(t) for t in self.tokens], dtype=np.uint64))
        self._chunks: Recent | None = None

    @classmethod
    @functools.cache
    def read(cls, path: str) -> Vocabulary:
        tokens, ranks = [], []
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    tokens.append(base64.b64decode(token))
                    ranks.append(int(rank))
        return cls(tokens, ranks)

    def _place(self, keys: np.ndarray) -> None:
        """Largest buckets first, each by the first displacement that finds only free slots.
        Buckets of one token come last and take the slots that are left."""
        n = len(keys)
        self.buckets = max(1, n // _LOAD)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        self.slot = np.full(n, -1, dtype=np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        for b in np.argsort(-sizes, kind="stable").tolist():
            if sizes[b] < 2:
                break
            members = by_bucket[ends[b] - sizes[b]: ends[b]]
            start, tries = 0, 64
            while True:
                shifts = np.arange(start, start + tries)
                at = np.sort(self._slots(keys[members][None, :], shifts[:, None]), axis=1)
                fits = (self.slot[at] < 0).all(axis=1) & (np.diff(at, axis=1) > 0).all(axis=1)
                if fits.any():
                    break
                start, tries = start + tries, min(4 * tries, 4096)
            self.shift[b] = start + int(fits.argmax())
            self.slot[self._slots(keys[members], self.shift[b])] = members
        free = np.flatnonzero(self.slot < 0)
        alone = np.flatnonzero(sizes == 1)
        self.slot[free] = by_bucket[ends[alone] - 1]
        self.shift[alone] = -1 - free

    def _slots(self, keys: np.ndarray, shift) -> np.ndarray:
        """A shift below zero names the slot itself."""
        shift = np.asarray(shift, dtype=np.int64)
        turned = mix(keys + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return np.where(shift < 0, -1 - shift, (turned % np.uint64(len(self.slot))).astype(np.int64))

    def find(self, pieces: list[bytes]) -> list[int]:
        """Index of each piece among the tokens, or -1."""
        keys = np.array([xxhash.xxh3_64_intdigest(p) for p in pieces], dtype=np.uint64)
        at = self.slot[self._slots(keys, self.shift[(keys % np.uint64(self.buckets)).astype(np.int64)])]
        return [i if self.tokens[i] == p else -1 for i, p in zip(at.tolist(), pieces)]

    def _start(self) -> None:
        self._chunks, self._pieces = Recent(CHUNKS), Recent(REMEMBERED)
        self._code = [int(r).to_bytes(4, "little") for r in self.ranks]
        self._bytes = dict(zip(self.ranks.tolist(), self.tokens))
        index = {t: i for i, t in enumerate(self.tokens)}
        self._byte = [index.get(bytes([b])) for b in range(256)]
        # What a token makes with the one behind it: each split of a token into two tokens.
        none: dict[int, int] = {}
        self._none = len(self.tokens)
        self._follow = [none] * len(self.tokens)
        for token, i in index.items():
            for k in range(1, len(token)):
                left, right = index.get(token[:k]), index.get(token[k:])
                if left is not None and right is not None:
                    if self._follow[left] is none:
                        self._follow[left] = {}
                    self._follow[left][right] = i

    def forget(self) -> None:
        """Drops what is remembered, so that an idle worker does not hold it through other stages."""
        if self._chunks is not None:
            self._chunks, self._pieces = Recent(CHUNKS), Recent(REMEMBERED)

    def _resolved(self, pieces: list[str]) -> Iterator[bytes]:
        """Packed ids of pieces, by whole-piece lookup first and merging second."""
        raw = [p.encode() for p in pieces]
        code = self._code.__getitem__
        for piece, at in zip(raw, self.find(raw)):
            yield self._code[at] if at >= 0 else b"".join(map(code, self._merge(piece)))

    def _joined(self, chunks: list[str], pieces: regex.Pattern) -> Iterator[bytes]:
        """Packed ids of chunks. A chunk stands behind a space, or behind nothing if it begins with one."""
        cut = [(" " + c,) if c.isascii() and c.isalpha() else pieces.findall(c[1:] if c[0] == " " else " " + c)
               for c in chunks]
        known = self._pieces.filled(set().union(*cut), self._resolved)
        return (b"".join(map(known.__getitem__, c)) for c in cut)

    def _long(self, text: str, pieces: regex.Pattern) -> Iterator[bytes]:
        """Packed ids of a text, a bounded number of pieces at a time."""
        found = (m.group() for m in pieces.finditer(text))
        while part := list(islice(found, REMEMBERED)):
            known = self._pieces.filled(set(part), self._resolved)
            yield b"".join(map(known.__getitem__, part))

    def packed(self, texts: Iterable[str], pieces: regex.Pattern) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self._chunks is None:
            self._start()
        for some in _slices(texts):
            if len(some[0]) > SLICE:
                yield b"".join(self._long(some[0], pieces))
                continue
            cut = [_chunks(t) for t in some]
            known = self._chunks.filled(set().union(*cut), lambda new: self._joined(new, pieces))
            for chunks in cut:
                yield b"".join(map(known.__getitem__, chunks))

    def _merge(self, piece: bytes) -> list[int]:
        return self._merge_few(piece) if len(piece) <= FEW else self._merge_many(piece)

    def _merge_few(self, piece: bytes) -> list[int]:
        """The leftmost best pair first, found by a look at all: cheaper than a heap for few."""
        follow, none = self._follow, self._none
        part = list(map(self._byte.__getitem__, piece))
        makes = [follow[a].get(b, none) for a, b in pairwise(part)]
        makes.append(none)
        while (made := min(makes)) < none:
            i = makes.index(made)
            part[i] = made
            del part[i + 1], makes[i]
            if i + 1 < len(part):
                makes[i] = follow[made].get(part[i + 1], none)
            if i:
                makes[i - 1] = follow[part[i - 1]].get(made, none)
        return part

    def _merge_many(self, piece: bytes) -> list[int]:
        follow, n = self._follow, len(piece)
        part = [self._byte[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # What each part makes with the next one. A heap entry is a token and the place of its left
        # part, in one number, and is stale once another token, or none, can be made there.
        makes = [follow[a].get(b) for a, b in pairwise(part)]
        makes.append(None)
        heap = [made * n + i for i, made in enumerate(makes) if made is not None]
        heapify(heap)
        while heap:
            made, i = divmod(heappop(heap), n)
            if makes[i] != made:
                continue
            j = after[i]
            part[i], part[j], makes[j] = made, None, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = makes[i] = follow[made].get(part[k])
                if new is not None:
                    heappush(heap, new * n + i)
            else:
                makes[i] = None
            h = before[i]
            if h >= 0:
                new = makes[h] = follow[part[h]].get(made)
                if new is not None:
                    heappush(heap, new * n + h)
        return [p for p in part if p is not None]

    def decode(self, ids: bytes) -> bytes:
        if self._chunks is None:
            self._start()
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _chunks(text: str) -> list[str]:
    """The text cut at single spaces between characters that are no white space, which are left
    out. The first chunk is marked by one more space in front."""
    if not text:
        return []
    parts = _CUT.split(text) if _UNEVEN.search(text) else text.split(" ")
    parts[0] = " " + parts[0]
    return parts


def _slices(texts: Iterable[str]) -> Iterator[list[str]]:
    """Neighbouring texts of ``SLICE`` characters together; a longer text is alone."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > SLICE:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def _texts(column: pa.Array) -> Iterator[str]:
    """One at a time, as a batch may hold many long texts."""
    return (v.as_py() or "" for v in column)


def _run(rows: DataFrame, path: str, schema: str, made) -> DataFrame:
    """First column of ``rows`` and what ``made`` gives for the vocabulary and the second."""
    shipped = rows.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches, 2_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), *made(shipped.value, batch.column(1))], names=names)
        shipped.value.forget()
    return rows.mapInArrow(lean(run), schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` per row of ``docs(doc_id, text)``: token ids of the whole text as
    little-endian unsigned 32-bit integers.

    ``path`` names a rank file on the driver, ``pattern`` splits a text into pieces that are
    encoded apart. There are no special tokens; null and empty texts give no ids. Rows are
    independent, so repeated or null doc_ids stay as they are; other columns are ignored.
    """
    cut = regex.compile(pattern)
    return _run(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, "doc_id long, ids binary",
                lambda v, column: [pa.array(list(v.packed(_texts(column), cut)), pa.binary())])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded(doc_id, ids)`` with a column ``decoded``: the tokens' bytes. Null ids: empty."""
    return _run(encoded.select("doc_id", "ids"), path, "doc_id long, ids binary, decoded binary",
                lambda v, column: [column, pa.array([v.decode(i or b"") for i in _texts(column)], pa.binary())])


def round_trips(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row of ``docs(doc_id, text)``: count
    and digest of ``encode``'s ids, and digest of the bytes that ``decode`` gives back for them.

    The same as both one after the other, in one pass. Nulls and repeats as in ``encode``.
    """
    cut = regex.compile(pattern)

    def made(vocabulary: Vocabulary, column: pa.Array) -> list[pa.Array]:
        n, ids, back = [], [], []
        for packed in vocabulary.packed(_texts(column), cut):
            n.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            back.append(hashlib.sha256(vocabulary.decode(packed)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]

    return _run(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path,
                "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", made)


def ids_array(ids: Column) -> Column:
    """Packed ids as an array of long; no ids give an empty array."""
    def number(i: Column) -> Column:
        digits = F.hex(F.substring(ids, i, F.lit(4)))
        return F.conv(F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)]), 16, 10).cast("long")

    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(ids) / 4).cast("int")),
                         lambda n: 4 * n - 3)
    return F.when(F.octet_length(ids) >= 4, F.transform(starts, number)).otherwise(F.array().cast("array<long>"))
