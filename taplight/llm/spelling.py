"""Spelling variants: words one inserted, deleted or replaced code point apart.

Two such words have letter-count vectors at a squared distance of two at most, and their
lengths differ by one at most. Words are dealt into blocks by their counts over ``GROUPS``
groups of letters (which sum to the length). One edit changes one group's count by one, or
moves one letter from a group to another, so a block meets itself and its neighbours in those
few directions, once each. A block's squared distances to its neighbours come from products of
the count matrices (Gram blocks); pairs at most two apart are verified code point by code
point. Letters are grouped by their frequency in the words, so that blocks stay even.

A block with many words is cut into chunks of about ``CHUNK`` words by hash, and what it meets
into parts of about ``PART``, so a task holds a bounded number of words whatever the
vocabulary. Only links leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ordered_groups, written

LEAST_LETTERS, LEAST_COUNT, FACTOR = 6, 5, 5
GROUPS, CHUNK, PART = 5, 2_000, 8_000
#: One in so many runs, by hash, is read with a letter missing.
SLIP = 199
#: Letters of words: a to z and the Latin letters of one byte.
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
_CELLS = 4_000_000
_LINK = "word string, n long, near string, near_n long"


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of ``docs(doc_id, text)``: lower-cased runs of letters, some with a slip,
    that have ``least_letters`` code points and occur ``least`` times over all texts."""
    # Runs shorter than a word give none. A greedy match of that many letters is a whole run.
    run = F.explode(F.regexp_extract_all(
        F.translate("text", UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{least_letters},}}"), F.lit(0)))
    runs = docs.where("text is not null").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), run.alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run"))
    at = (h % F.char_length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return runs.select(F.when(h % SLIP == 0, slipped).otherwise(F.col("run")).alias("word")).groupBy("word").agg(
        F.count("*").alias("n")).where((F.col("n") >= least) & (F.char_length("word") >= least_letters))


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """The letters dealt into groups of even weight, by their number of places in ``words``.

    At most one row a letter reaches the driver.
    """
    found = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()
    count = {r["letter"]: r["count"] for r in found}
    dealt, weight = [""] * groups, [0] * groups
    for letter in sorted(LETTERS, key=lambda c: (-count.get(c, 0), c)):
        g = min(range(groups), key=lambda i: (weight[i], i))
        dealt[g] += letter
        weight[g] += count.get(letter, 0)
    return dealt


def _named(counts: list[Column]) -> Column:
    """A block's name; null where a count is below zero."""
    text = F.concat_ws(":", *counts)
    return F.when(F.least(*counts, F.lit(0)) >= 0, text)


def _met_by(counts: list[Column]) -> Column:
    """Names of the blocks that meet a word of these counts: its own, those with one letter
    moved to a later group, and those with one letter less."""
    names = [_named(counts)]
    for i in range(len(counts)):
        less = [c - 1 if k == i else c for k, c in enumerate(counts)]
        names.append(_named(less))
        names += [_named([c + 1 if k == j else c for k, c in enumerate(less)]) for j in range(i + 1, len(counts))]
    return F.filter(F.array(*names), lambda n: n.isNotNull())


def _dealt(words: DataFrame, chunk: int, part: int) -> DataFrame:
    """``block, chunk, part, side, word, n``: what each task compares. Rows of side 0 are words of
    the block, which meet those of side 1, of the same block, and of side 2, of its neighbours."""
    counts = [F.char_length("word") - F.char_length(F.translate("word", letters, ""))
              for letters in letter_groups(words)]
    # The key comes from counts of this very table, so it is written to be computed once.
    keyed = written(words.select("word", "n", *[c.alias(f"g{i}") for i, c in enumerate(counts)]), "keyed")
    groups = [F.col(f"g{i}") for i in range(len(counts))]
    own = keyed.select("word", "n", _named(groups).alias("block"))
    other = keyed.select("word", "n", F.posexplode(_met_by(groups)).alias("nth", "block")).select(
        "word", "n", "block", F.when(F.col("nth") == 0, 1).otherwise(2).alias("side"))
    size = own.groupBy("block").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    met = other.groupBy("block").agg(F.ceil(F.count("*") / part).alias("parts"))
    plan = written(size.join(met, "block"), "blocks")

    def slot(n: str) -> Column:
        return F.pmod(F.xxhash64("word"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))

    mine = own.join(plan, "block").select(
        "block", slot("chunks").alias("chunk"), every("parts").alias("part"), F.lit(0).alias("side"), "word", "n")
    rest = other.join(plan, "block").select(
        "block", every("chunks").alias("chunk"), slot("parts").alias("part"), "side", "word", "n")
    return mine.union(rest)


class _Words:
    """Words of one side as letters in one array, with their counts by letter."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)

    def counts(self, columns: np.ndarray, width: int) -> np.ndarray:
        row = np.repeat(np.arange(len(self.words)), self.size)
        flat = np.bincount(row * width + columns[self.letters], minlength=len(self.words) * width)
        # Products of counts stay exact in single precision up to words of 2,000 letters.
        exact = np.float32 if not len(self.size) or self.size.max() < 2_000 else np.float64
        return flat.reshape(len(self.words), width).astype(exact)

    def spelled(self, rows: np.ndarray, size: int) -> np.ndarray:
        return self.letters[self.at[rows][:, None] + np.arange(size)]


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``b`` are one edit from ``a``; b's words are as long, or one letter longer."""
    size = a.shape[1]
    head = a == b[:, :size]
    if b.shape[1] == size:
        return head.sum(axis=1) == size - 1
    tail = (a == b[:, 1:])[:, ::-1]
    before = np.where(head.all(axis=1), size, head.argmin(axis=1))
    behind = np.where(tail.all(axis=1), size, tail.argmin(axis=1))
    return before + behind >= size


def _near(own: _Words, met: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both sides that are one edit apart, each pair once."""
    columns = np.zeros(256, dtype=np.int64)
    present = np.unique(np.concatenate([own.letters, met.letters]))
    columns[present] = np.arange(len(present))
    left, right = own.counts(columns, len(present)), met.counts(columns, len(present))
    squares = (left * left).sum(axis=1)[:, None]
    size = int(own.size[0])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, _CELLS // max(1, len(own.words)))
    for lo in range(0, len(met.words), step):
        block = right[lo: lo + step]
        distance = squares + (block * block).sum(axis=1)[None, :] - 2 * (left @ block.T)
        # Words of one length with equal counts are permutations, never one edit.
        i, j = np.nonzero((distance <= 2) & (distance > 0))
        j = j + lo
        for length in (size, size + 1):
            there = np.flatnonzero(met.size[j] == length)
            for at in range(0, len(there), max(1, _CELLS // size)):
                some = there[at: at + max(1, _CELLS // size)]
                x, y = i[some], j[some]
                hit = _one_edit(own.spelled(x, size), met.spelled(y, length))
                found.append((x[hit], y[hit]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in ordered_groups(batches, ["block", "chunk", "part"]):
        words, n = np.array(rows.column("word").to_pylist(), dtype=object), rows.column("n").to_numpy()
        side = rows.column("side").to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side)
        if not len(a) or not len(b):
            continue
        i, j = _near(_Words(words[a]), _Words(words[b]))
        i, j = a[i], b[j]
        # A pair inside a block is seen from both of its words; one view is enough.
        once = (side[j] == 2) | (words[i] < words[j])
        i, j = i[once], j[once]
        x, y = np.concatenate([i, j]), np.concatenate([j, i])
        yield pa.RecordBatch.from_arrays(
            [pa.array(words[x], pa.string()), pa.array(n[x], pa.int64()),
             pa.array(words[y], pa.string()), pa.array(n[y], pa.int64())], names=["word", "n", "near", "near_n"])


def near_words(words: DataFrame, chunk: int = CHUNK, part: int = PART) -> DataFrame:
    """``word, n, near, near_n``: each pair of ``words(word, n)`` one edit apart, in both directions.

    Words are made of ``LETTERS`` and are distinct. No words, or one, give no rows.
    """
    keys = ["block", "chunk", "part"]
    return _dealt(words, chunk, part).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_links, _LINK)


def spelling_variants(docs: DataFrame, chunk: int = CHUNK, part: int = PART) -> DataFrame:
    """Per word of ``docs(doc_id, text)``: ``word, form, root, n, n_near, form_n``.

    ``form`` is the word's most frequent near word (ties: the smallest) if it occurs ``FACTOR``
    times as often, else null; ``root`` follows forms to the last. A null text has no words; a
    null doc_id hashes as ``null``; repeated rows count as often as they occur; other columns
    are ignored; an empty table gives no rows. Words of any length take part.
    """
    words = written(word_counts(docs), "words")
    best = near_words(words, chunk, part).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    best = best.select(F.col("word").alias("w"), "n_near", F.col("best.near").alias("near"),
                       (-F.col("best.m")).alias("near_n"))
    likelier = F.col("near_n") >= FACTOR * F.col("n")
    judged = written(words.join(best, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(likelier, F.col("near")).alias("form"), F.when(likelier, F.col("near_n")).alias("form_n")), "judged")
    links = judged.where("form is not null").select("word", F.col("form").alias("root"))
    top = words.agg(F.max("n")).first()[0] or 1
    # Counts grow by FACTOR a step, which bounds the steps; each round doubles those behind.
    steps = max(1, math.ceil(math.log(max(top / LEAST_COUNT, FACTOR), FACTOR)))
    for _ in range(max(1, math.ceil(math.log2(steps)))):
        onward = links.select(F.col("word").alias("w"), F.col("root").alias("next"))
        links = written(links.join(onward, F.col("root") == F.col("w"), "left").select(
            "word", F.coalesce("next", "root").alias("root")), "roots")
    return judged.join(links.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
