"""Near-duplicate vectors by random-hyperplane sign hashing in several tables.

Each table hashes a vector to the signs of 16 random projections. Two vectors at cosine 0.93
agree on a table with a chance of 0.13 and miss all 80 tables with one of 1.5e-5; at 0.97 it
is below 1e-10. Vectors that share a bucket are compared by exact cosine in blocks: buckets
are sorted side by side inside a task, and a bucket of more than ``BLOCK`` vectors is dealt
out as pairs of chunks, each a task-sized matrix product. A link is counted in the first
table where its two vectors meet, so blocks send on sums and one root per vector, never
pairs. Equal vectors collapse into one class with a weight before all that.

``bits`` should grow with the logarithm of the rows per label and ``tables`` with it; the
defaults suit up to some 10^7 vectors a label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_sizes, local_roots, whole_groups, written
from .components import connected_components

BITS, TABLES, BLOCK, SMALL = 16, 80, 1000, 8


def _hashes(tables: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            labels = batch.column(1).to_pylist()
            lists = batch.column(2)
            digest: list = [None] * n
            group: list = [None] * n
            raw: list = [None] * n
            keys: list = [None] * n
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            holes = np.zeros(n, dtype=bool)
            flat = lists.flatten()
            values = np.asarray(flat.fill_null(float("nan")), dtype=dtype)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if n else sizes
            holes[np.asarray(lists.is_null())] = True
            for dim in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero((sizes == dim) & ~holes)
                x = values[starts[at][:, None] + np.arange(dim)]
                wide = x.astype(np.float64)
                norm = _norms(wide)
                fine = np.isfinite(norm) & (norm > 0) & np.array([labels[i] is not None for i in at], dtype=bool)
                at, x = at[fine], x[fine]
                if not len(at):
                    continue
                if dim not in planes:
                    planes[dim] = np.random.default_rng(dim).standard_normal((dim, tables * BITS))
                unit = wide[fine] / norm[fine][:, None]
                signs = (unit @ planes[dim] > 0).reshape(len(at), tables, BITS)
                codes = np.packbits(signs, axis=2).reshape(len(at), tables, 2).copy().view(np.uint16)[:, :, 0]
                for j, i in enumerate(at.tolist()):
                    raw[i], keys[i] = x[j].tobytes(), codes[j].tobytes()
                    group[i] = hashlib.md5(f"{dim}:{labels[i]}".encode()).digest()
                    digest[i] = hashlib.md5(group[i] + raw[i]).digest()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digest, pa.binary()), pa.array(group, pa.binary()),
                 pa.array(raw, pa.binary()), pa.array(keys, pa.binary())],
                names=["vec_id", "digest", "grp", "raw", "codes"])
    return run


def _norms(x: np.ndarray) -> np.ndarray:
    """Length of each row; not finite where a component is not, and safe from overflow."""
    with np.errstate(all="ignore"):
        top = np.abs(x).max(axis=1)
        scaled = x / np.where(top > 0, top, 1)[:, None]
        return np.where(np.isfinite(top), top * np.sqrt((scaled * scaled).sum(axis=1)), np.nan)


def _pairs(first: np.ndarray, sizes: np.ndarray, x: list[np.ndarray], chunk: np.ndarray,
           cross: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of a common group whose cosine is at least ``least``."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    row_group = np.repeat(np.arange(len(first)), sizes)
    small = (sizes <= SMALL)[row_group]
    for d in range(1, SMALL):
        i = np.flatnonzero(small[:-d] & (row_group[:-d] == row_group[d:])) if len(small) > d else left[0]
        if not len(i):
            break
        j = i + d
        fine = ~cross[i] | (chunk[i] != chunk[j])
        i, j = i[fine], j[fine]
        dot = np.array([x[a] @ x[b] for a, b in zip(i.tolist(), j.tolist())])
        keep = dot >= least
        left.append(i[keep])
        right.append(j[keep])
    for g in np.flatnonzero(sizes > SMALL).tolist():
        at = np.arange(first[g], first[g] + sizes[g])
        m = np.stack([x[a] for a in at.tolist()])
        hit = np.triu(m @ m.T >= least, 1)
        if cross[at[0]]:
            hit &= chunk[at][:, None] != chunk[at][None, :]
        i, j = np.nonzero(hit)
        left.append(at[i])
        right.append(at[j])
    return np.concatenate(left), np.concatenate(right)


def _compare(least: float, dtype: str):
    names = ["bucket", "lo", "hi", "grp", "chunk", "t", "digest", "copies", "raw", "codes"]

    def judge(rows: pa.Table) -> pa.RecordBatch:
        n = rows.num_rows
        col = {c: rows.column(c) for c in names}
        lo, hi = col["lo"].to_numpy(), col["hi"].to_numpy()
        first, sizes = map(np.array, group_sizes(rows, names[:4]))
        x = [np.frombuffer(r, dtype=dtype).astype(np.float64) for r in col["raw"].to_pylist()]
        x = [v / _norms(v[None, :])[0] for v in x]
        i, j = _pairs(first, sizes, x, col["chunk"].to_numpy(), lo != hi, least)
        digest, copies, t = col["digest"].to_pylist(), col["copies"].to_numpy(), col["t"].to_numpy()
        root = local_roots(n, i, j)
        codes = [np.frombuffer(c, dtype=np.uint16) for c in col["codes"].to_pylist()]
        linked = np.zeros(n, dtype=np.int64)
        for at in range(0, len(i), 20_000):
            a, b = i[at: at + 20_000], j[at: at + 20_000]
            same = np.stack([codes[k] for k in a.tolist()]) == np.stack([codes[k] for k in b.tolist()])
            mine = same.argmax(axis=1) == t[a]
            np.add.at(linked, a[mine], copies[b[mine]])
            np.add.at(linked, b[mine], copies[a[mine]])
        out = np.flatnonzero((linked > 0) | (root != np.arange(n))).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array([digest[k] for k in out], pa.binary()), pa.array(linked[out], pa.int64()),
             pa.array([digest[root[k]] for k in out], pa.binary())], names=["digest", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, names[:4]):
            yield judge(rows)
    return run


def vector_components(vectors: DataFrame, least: float = 0.93, tables: int = TABLES,
                      block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors(vec_id, embedding, label)``.

    Rows are linked when their labels are equal and not null, their vectors equally long and
    their cosine in double precision is at least ``least``. Null, empty and zero vectors and
    vectors with null or non-finite components link with nothing. ``n_links`` counts other
    rows, repeated rows included. ``component_id`` is the smallest vec_id that links reach.
    Rows with a null id take part in links and carry their component's id, null if it has
    none; ``kept`` compares null-safely. An empty table gives no rows.
    """
    kind = dict(vectors.dtypes)["embedding"]
    dtype = "<f4" if kind == "array<float>" else "<f8"
    if dtype == "<f8":
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = written(vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        "embedding").mapInArrow(_hashes(tables, dtype), (
            "vec_id long, digest binary, grp binary, raw binary, codes binary")), "vectors")
    classes = written(rows.where("digest is not null").groupBy("digest").agg(
        F.count("*").alias("copies"), F.first("grp").alias("grp"), F.first("raw").alias("raw"),
        F.first("codes").alias("codes")), "classes")
    spread = classes.select("digest", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("t"),
                            "grp", "codes").select(
        "digest", "t", F.xxhash64("grp", "t", F.substring("codes", 2 * F.col("t") + 1, F.lit(2))).alias("bucket"))
    shared = written(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = spread.join(shared, "bucket")
    parts = F.ceil(F.col("n") / block).cast("int")
    chunk = F.pmod(F.xxhash64("digest", F.lit(7)), parts).cast("int")
    blocks = met.withColumn("parts", parts).withColumn("chunk", chunk).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "bucket", "digest", "t", "chunk", F.least("chunk", "other").alias("lo"),
        F.greatest("chunk", "other").alias("hi"))
    order = ["bucket", "lo", "hi", "grp"]
    judged = written(blocks.join(classes, "digest").repartition("bucket", "lo", "hi").sortWithinPartitions(
        *order).select(*order, "chunk", "t", "digest", "copies", "raw", "codes").mapInArrow(
        _compare(least, dtype), "digest binary, links long, root binary"), "blocks")
    links = judged.groupBy("digest").agg(F.sum("links").alias("links"))
    roots = connected_components(judged.select("digest", "root"), "digest", "root")
    found = classes.select("digest", "copies").join(links, "digest", "left").join(
        roots, F.col("digest") == F.col("node"), "left").select(
        F.col("digest").alias("d"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"),
        F.coalesce("root", "digest").alias("root"))
    placed = written(rows.select("vec_id", "digest").join(
        found, F.col("digest") == F.col("d"), "left").select("vec_id", "n", "root"), "placed")
    least_id = placed.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("c"))
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("c"))
    return placed.join(least_id.withColumnRenamed("root", "r"), F.col("root") == F.col("r"), "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
