"""SentencePiece encoding (BPE models) by vectorised merge rounds, and decoding.

A text is normalised (spaces become ``SPACE``, one more goes in front) and cut into words at
places that no piece spans: before a run of spaces and around line ends, where the vocabulary
allows it. The distinct words of a slice of texts are encoded together. All their symbols are
one flat numpy array, cut once more wherever two neighbours stand together in no piece. In
every round each segment takes its best-ranked pair and merges its occurrences from the left,
all at once; segments without a pair leave, the rest is compacted, until none is left.

Merging all occurrences at once equals one merge after the other as long as no merge opens a
pair that ranks as high. Vocabularies have such pairs, since a piece can be made in several
ways, so occurrences behind the first that opens one wait for a later round. Characters that
no piece has become their UTF-8 bytes.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words remembered by a task's worker, and characters of text encoded together.
REMEMBERED, SLICE = 300_000, 4_000_000
# Fixed values of the model file's format: piece types and field numbers.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_PIECE, _TRAINER, _NORMALIZER = 1, 2, 3
_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, data[at: at + size]
        at += size


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("taplight.bytewise", _one_by_one)


class Pieces:
    """A model's pieces with its table of pairs. Small enough to ship to every task."""

    def __init__(self, pieces: list[tuple[str, float, int]], prefix: bool, begin: int, end: int):
        self.prefix, self.begin, self.end = prefix, begin, end
        self.size = len(pieces)
        usual = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.spelled: list[bytes] = []
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(piece[1:-1], 16)] = i
            self.spelled.append(b"" if kind == CONTROL else bytes([int(piece[1:-1], 16)]) if kind == BYTE
                                else b" \xe2\x81\x87 " if kind == UNKNOWN else piece.encode())
        self.is_byte = np.array([kind == BYTE for _, _, kind in pieces])
        self.controls = np.array([kind == CONTROL for _, _, kind in pieces])
        scores = np.array([s for _, s, _ in pieces])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        symbol = np.arange(0x110000, dtype=np.int32) + self.size
        for piece, i in usual.items():
            if len(piece) == 1:
                symbol[ord(piece)] = i
        self._rare = symbol
        left, right, made = [], [], []
        inner = set()
        for piece, i in usual.items():
            for k in range(1, len(piece)):
                inner.add((piece[k - 1], piece[k]))
                halves = [int(symbol[ord(h)]) if len(h) == 1 else usual.get(h, -1) for h in (piece[:k], piece[k:])]
                if min(halves) >= 0:
                    left.append(halves[0])
                    right.append(halves[1])
                    made.append(i)
        self._place(np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(made, dtype=np.int32))
        self._inner = np.sort(np.array([ord(a) << 21 | ord(b) for a, b in inner], dtype=np.int64))
        # Merging into such a piece may open a pair of a rank as high.
        rank, parts = self.rank, np.concatenate([left, right]).astype(np.int64)
        twice = np.concatenate([made, made]).astype(np.int64)
        known = parts < self.size
        self.opens = np.zeros(self.size, dtype=bool)
        self.opens[parts[known & (rank[twice] <= rank[np.minimum(parts, self.size - 1)])]] = True
        spaces = all(b != SPACE or a == SPACE for a, b in inner)
        self.words = re.compile(rf"[ {SPACE}]*[^ {SPACE}\n]+|[ {SPACE}]+|\n" if spaces and not any(
            "\n" in p for p in inner) else r"(?s).+")
        self._memo: dict[str, bytes] = {}

    @classmethod
    @functools.cache
    def read(cls, path: str) -> Pieces:
        """Model at ``path``: BPE with byte fallback, no rewriting of characters."""
        pieces, settings = [], {}
        with open(path, "rb") as file:
            for field, value in _fields(file.read()):
                if field == _PIECE:
                    part = dict(_fields(value))
                    pieces.append((part[1].decode(), struct.unpack("<f", part.get(2, bytes(4)))[0], part.get(3, NORMAL)))
                elif field in (_TRAINER, _NORMALIZER):
                    settings |= {(field, k): v for k, v in _fields(value)}
        trainer, rewrite = (lambda k, usual: settings.get((_TRAINER, k), usual)), (
            lambda k, usual: settings.get((_NORMALIZER, k), usual))
        if trainer(3, 1) != 2 or not trainer(35, 0) or trainer(24, 0) or {USER_DEFINED, UNUSED} & {p[2] for p in pieces}:
            raise ValueError("only BPE models with byte fallback and without user-defined or unused pieces")
        if rewrite(2, b"") or rewrite(4, 1) or not rewrite(5, 1):
            raise ValueError("only models that keep characters and spaces as they are")
        return cls(pieces, bool(rewrite(3, 1)), trainer(41, 1), trainer(42, 2))

    def _place(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        """Open addressing: a pair lies in the first free slot from its hash on."""
        keys = left << 21 | right
        self._bits = max(4, int(8 * len(keys)).bit_length())
        self._keys = np.full(1 << self._bits, -1, dtype=np.int64)
        self._made = np.zeros(1 << self._bits, dtype=np.int32)
        at, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):
            free = waiting[self._keys[at[waiting]] < 0]
            _, first = np.unique(at[free], return_index=True)
            taken = free[first]
            self._keys[at[taken]], self._made[at[taken]] = keys[taken], made[taken]
            waiting = np.setdiff1d(waiting, taken, assume_unique=True)
            at[waiting] = (at[waiting] + 1) & ((1 << self._bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _MIX >> np.uint64(64 - self._bits)).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        keys = left.astype(np.int64) << 21 | right
        at, looking = self._slot(keys), np.arange(len(keys))
        out = np.full(len(keys), -1, dtype=np.int32)
        while len(looking):
            found = self._keys[at]
            hit = found == keys
            out[looking[hit]] = self._made[at[hit]]
            more = ~hit & (found >= 0)
            looking, keys, at = looking[more], keys[more], at[more] + 1 & ((1 << self._bits) - 1)
        return out

    def _ranks(self, made: np.ndarray) -> np.ndarray:
        return np.where(made >= 0, self.rank[made], _NONE)

    def _merged(self, symbol: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, and their places' first positions, in order.

        ``segment`` numbers the segments in order; places are those of the symbols given.
        """
        place = np.arange(len(symbol))
        made = np.full(len(symbol), -1, dtype=np.int32)
        same = segment[1:] == segment[:-1]
        made[:-1][same] = self._pairs(symbol[:-1][same], symbol[1:][same])
        rank = self._ranks(made)
        done = []
        while len(symbol):
            first = np.flatnonzero(np.diff(segment, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(first, append=len(symbol))
            ends = best == _NONE
            if ends.any():
                out = np.repeat(ends, size)
                done.append((place[out], symbol[out]))
                stay = ~out
                place, symbol, segment, made, rank = (x[stay] for x in (place, symbol, segment, made, rank))
                best, size = best[~ends], size[~ends]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            # Of overlapping occurrences every second one is free when its turn comes.
            starts = np.diff(hit, prepend=-2) != 1
            run = np.flatnonzero(starts)
            chosen = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))) % 2 == 0]
            chosen = self._first_safe(chosen, symbol, segment, made, rank)
            symbol[chosen] = made[chosen]
            keep = np.ones(len(symbol), dtype=bool)
            keep[chosen + 1] = False
            moved = chosen - np.arange(len(chosen))
            place, symbol, segment, made, rank = (x[keep] for x in (place, symbol, segment, made, rank))
            touched = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            inside = touched[touched + 1 < len(symbol)]
            inside = inside[segment[inside] == segment[inside + 1]]
            made[touched] = -1
            made[inside] = self._pairs(symbol[inside], symbol[inside + 1])
            rank[touched] = self._ranks(made[touched])
        places = np.concatenate([d[0] for d in done]) if done else np.empty(0, np.int64)
        symbols = np.concatenate([d[1] for d in done]) if done else np.empty(0, np.int32)
        order = np.argsort(places, kind="stable")
        return symbols[order], places[order]

    def _first_safe(self, chosen, symbol, segment, made, rank) -> np.ndarray:
        """``chosen`` without those behind a segment's first merge that opens a pair as good."""
        maybe = np.flatnonzero(self.opens[made[chosen]])
        if not len(maybe):
            return chosen
        at = chosen[maybe]
        new = made[at]
        before = at - 1
        behind = at + 2
        has_before = (at > 0) & (segment[before] == segment[at])
        has_behind = behind < len(symbol)
        has_behind[has_behind] = segment[behind[has_behind]] == segment[at[has_behind]]
        # The left neighbour may itself be the outcome of the occurrence before.
        last = chosen[np.maximum(maybe - 1, 0)]
        left = np.where(last == at - 2, made[last], symbol[before])
        opened = np.full(len(at), _NONE, dtype=np.int32)
        opened[has_before] = self._ranks(self._pairs(left[has_before], new[has_before]))
        opened[has_behind] = np.minimum(opened[has_behind], self._ranks(self._pairs(
            new[has_behind], symbol[behind[has_behind]])))
        stop = at[opened <= rank[at]]
        if not len(stop):
            return chosen
        segments, first = np.unique(segment[stop], return_index=True)
        k = np.minimum(np.searchsorted(segments, segment[chosen]), len(segments) - 1)
        return chosen[(segments[k] != segment[chosen]) | (chosen <= stop[first[k]])]

    def _encode(self, words: list[str]) -> list[bytes]:
        """Packed ids of words, which may not be empty."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        points[points == 32] = ord(SPACE)
        size = np.array([len(w) for w in words])
        cut = np.ones(len(points), dtype=bool)
        cut[1:] = ~_among(self._inner, points[:-1] << 21 | points[1:])
        starts = np.cumsum(size) - size
        cut[starts] = True
        symbol, place = self._merged(self._rare[points], np.cumsum(cut))
        word = np.searchsorted(starts, place, side="right") - 1
        rare = np.flatnonzero(symbol >= self.size)
        if len(rare):
            spelled = [chr(c).encode() for c in (symbol[rare] - self.size).tolist()]
            n = np.ones(len(symbol), dtype=np.int64)
            n[rare] = [len(s) for s in spelled]
            first = (np.cumsum(n) - n)[rare]
            symbol, word = np.repeat(symbol, n), np.repeat(word, n)
            at = np.repeat(first - np.cumsum(n[rare]) + n[rare], n[rare]) + np.arange(n[rare].sum())
            symbol[at] = self.byte_ids[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
        data = symbol.astype("<u4").tobytes()
        ends = 4 * np.searchsorted(word, np.arange(len(words)), side="right")
        return [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def _known(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of words, those asked for among them."""
        memo = self._memo
        new = [w for w in words if w not in memo]
        if len(memo) + len(new) > REMEMBERED:
            memo.clear()
            new = list(words)
        if new:
            memo.update(zip(new, self._encode(new)))
        return memo

    def _long(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text, a bounded number of words at a time."""
        words = (m.group() for m in self.words.finditer(text))
        while part := list(islice(words, REMEMBERED)):
            known = self._known(set(part))
            yield b"".join(map(known.__getitem__, part))

    def packed(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text with the begin and end ids, as little-endian unsigned 32-bit integers."""
        lead = SPACE if self.prefix else ""
        begin, end = (struct.pack("<I", i) for i in (self.begin, self.end))
        for some in _slices(texts):
            if len(some[0]) > SLICE:
                yield b"".join([begin, *self._long(lead + some[0]), end])
                continue
            cut = [self.words.findall(lead + t) if t else [] for t in some]
            known = self._known(set().union(*cut))
            for words in cut:
                yield b"".join([begin, *map(known.__getitem__, words), end])

    def text(self, ids: bytes) -> str:
        """The text that packed ids spell. Control ids are nothing; a byte that is no part of a
        character becomes U+FFFD."""
        numbers = np.frombuffer(ids, dtype="<u4")
        spoken = numbers[~self.controls[numbers]]
        data = b"".join(map(self.spelled.__getitem__, spoken.tolist()))
        mark = SPACE.encode()
        whole = data.decode(errors="taplight.bytewise")
        if self.prefix and len(spoken) and not self.is_byte[spoken[0]] and data.startswith(mark):
            whole = whole[1:]
        return whole.replace(SPACE, " ")


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(values, keys), len(values) - 1)
    return values[at] == keys


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts of ``SLICE`` characters together; a longer text is alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > SLICE:
            yield texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield texts[start:]


def _run(docs: DataFrame, path: str, schema: str, made) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(Pieces.read(path))
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *made(shipped.value, batch.column(1))], names=names)
    return docs.mapInArrow(run, schema)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` per row of ``docs(doc_id, text)``: the whole text's ids with the begin and
    end ids, as little-endian unsigned 32-bit integers.

    ``path`` names a model file on the driver. A null text counts as empty and gives the two
    ids alone. Rows are independent: repeated or null doc_ids stay as they are, other columns
    are ignored, an empty table gives no rows.
    """
    return _run(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, "doc_id long, ids binary",
                lambda model, column: [pa.array(list(model.packed(_texts(column))), pa.binary())])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, decoded`` per row of ``encoded(doc_id, ids)``: the text. Null ids: empty."""
    return _run(encoded.select("doc_id", "ids"), path, "doc_id long, decoded string",
                lambda model, column: [pa.array([model.text(i or b"") for i in column.to_pylist()], pa.string())])


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row of ``docs(doc_id, text)``: count
    and digest of ``encode``'s ids, and digest of the text that ``decode`` gives back for them.

    The same as both one after the other, in one pass. Nulls and repeats as in ``encode``.
    """
    def made(model: Pieces, column: pa.Array) -> list[pa.Array]:
        n, ids, back = [], [], []
        for packed in model.packed(_texts(column)):
            n.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            back.append(hashlib.sha256(model.text(packed).encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]

    return _run(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path,
                "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", made)
