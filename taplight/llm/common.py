"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the folder that driver and executors share.

    That is ``spark.checkpoint.dir`` of the session. Where it is unset, a local master gets
    a temporary folder, since there driver and executors are one process on one machine;
    any other master must name a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="taplight-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, however often read.

    Later stages restart from this table when an executor is lost.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, every other character as it is.

    ``lower`` also folds other scripts, so it serves only texts of one byte a character.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def row_key(*columns: Column) -> Column:
    """128 bits that name a row by its values; equal rows share it, and nulls count as values."""
    parts = [F.when(c.isNull(), F.lit("n")).otherwise(
        F.concat(F.lit("v"), F.octet_length(c.cast("string")), F.lit(":"), c.cast("string")))
        for c in columns]
    return F.md5(F.concat(*parts))


def parted(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time, so that few texts are Python values at once.

    They are copies: whoever holds the last ones does not hold a whole batch while the next is read.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.take(pa.array(np.arange(at, min(at + rows, batch.num_rows))))
        del batch


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, after which the worker gives freed memory back to the system.

    Workers outlive their tasks, and else hold through later stages what their largest batch took.
    """
    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()
    return task


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows as tables that end where a group of equal keys ends."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if rest is not None:
            rows = pa.concat_tables([rest, rows])
        if not rows.num_rows:
            continue
        columns = [rows.column(k) for k in keys]
        last = [c[-1] for c in columns]
        cut = rows.num_rows
        while cut and all(c[cut - 1] == v for c, v in zip(columns, last)):
            cut -= 1
        rest = rows.slice(cut).combine_chunks()
        if cut:
            yield rows.slice(0, cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def group_sizes(rows: pa.Table, keys: list[str]) -> tuple[list[int], list[int]]:
    """First row and row count of each group of equal keys in sorted rows."""
    n = rows.num_rows
    columns = [rows.column(k).to_pylist() for k in keys]
    values = list(zip(*columns))
    first = [i for i in range(n) if i == 0 or values[i] != values[i - 1]]
    return first, [b - a for a, b in zip(first, first[1:] + [n])]


def ordered_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Each group of equal keys of sorted rows, whole. Keys are not null."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if rest is not None:
            rows = pa.concat_tables([rest, rows])
        rows, n = rows.combine_chunks(), rows.num_rows
        if not n:
            continue
        new = np.zeros(n - 1, dtype=bool)
        for k in keys:
            column = rows.column(k)
            new |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy()
        first = [0, *(np.flatnonzero(new) + 1).tolist()]
        for lo, hi in zip(first, first[1:]):
            yield rows.slice(lo, hi - lo)
        rest = rows.slice(first[-1])
    if rest is not None:
        yield rest


class Recent:
    """Values of the keys that were used last: ``size`` of them at least, twice as many at most."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def filled(self, keys: set, make: Callable[[list], Iterable]) -> dict:
        """A dict with the values of ``keys`` and others; ``make`` gives those of unknown keys."""
        new = [k for k in keys if k not in self.young]
        if len(self.young) + len(new) > self.size:
            self.old, self.young, new = self.young, {}, list(keys)
        unknown = []
        for k in new:
            value = self.old.get(k)
            if value is None:
                unknown.append(k)
            else:
                self.young[k] = value
        if unknown:
            self.young.update(zip(unknown, make(unknown)))
        return self.young


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row that the links i - j reach, for each of n rows."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def likely(rows: DataFrame, column: str, wanted: DataFrame, words: int = 1 << 18) -> DataFrame:
    """``rows`` with a flag ``likely_``: false only where ``column`` is not among the values of
    ``wanted`` (one column of the same type).

    A bitmap of 64 bits a word is built from the wanted values' hashes and broadcast. It has at
    most ``words`` rows whatever the input. Exact joins can follow with few rows to shuffle.
    """
    def word(h: Column) -> Column:
        return F.pmod(h, F.lit(words))

    def bit(h: Column) -> Column:
        return F.pmod(F.shiftrightunsigned(h, 40), F.lit(64)).cast("int")

    h = F.xxhash64(wanted.columns[0])
    bits = wanted.select(word(h).alias("word_"), bit(h).alias("bit_")).groupBy(F.col("word_").alias("w_")).agg(
        F.bit_or(F.expr("shiftleft(1L, bit_)")).alias("bits_"))
    own = F.xxhash64(column)
    return rows.join(F.broadcast(bits), word(own) == F.col("w_"), "left").withColumn(
        "likely_", F.coalesce(F.getbit("bits_", bit(own)) == 1, F.lit(False))).drop("w_", "bits_")


def without_rows(rows: DataFrame, column: str, dropped: DataFrame) -> DataFrame:
    """``rows`` whose ``column`` is not among the values of ``dropped`` (one column).

    Rows that a bitmap rules out pass without a shuffle; only the others are joined.
    """
    flagged = likely(rows, column, dropped)
    name = dropped.columns[0]
    clear = flagged.where("not likely_").drop("likely_")
    near = flagged.where("likely_").drop("likely_")
    # Not an anti join, which the optimizer would move below the bitmap.
    return clear.union(near.join(dropped.select(F.col(name).alias("dropped_")), F.col(column) == F.col(
        "dropped_"), "left").where("dropped_ is null").drop("dropped_"))
