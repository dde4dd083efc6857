"""b-bit MinHash near-duplicate detection over word-shingle sets.

A text's set holds its distinct shingles of five words (``shingles.py``). Sets are reduced to
128 minima; 32 bands of four minima give candidates: sets that agree on a whole band. Of
each minimum four bits are kept, packed as bit planes, so the share of equal minima is a few
xor, or and bit_count operations; equal low bits of unequal minima are corrected for. Pairs
whose estimate is not clearly below the threshold are confirmed on the full sets.

Two sets at similarity 0.75 miss all 32 bands with a chance of 5e-6, and are rejected by
the estimate (4.5 standard deviations below the threshold) with one of about 3e-6.

Groups of copies never turn into all pairs. Equal sets collapse into one class first. In a
bucket every class is compared with the bucket's smallest class only; then components are
formed, and a second pass compares those classes of a bucket that are still in different
components, side by side inside tasks: a bucket with many shingles or rows is dealt out as
pairs of chunks, a task holds one row's candidates at a time, and a task sends on one root per class, never pairs. Every candidate pair thus ends
either confirmed, refused, or inside one component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import group_sizes, lean, likely, local_roots, parted, row_key, whole_groups, without_rows, written
from .components import connected_components
from .shingles import in_chunks, mix, shingle_sets

BANDS, ROWS, BITS = 32, 4, 4
MINIMA = BANDS * ROWS
PERCENT = 75
SIGMAS = 4.5
BLOCK_SHINGLES = 300_000
BLOCK_ROWS = 5_000

_SKETCH = ("doc_id long, row_key string, n_shingles long, digest binary, class_key long, "
           "bands array<long>, planes array<long>")


def _sketches(sets: list[np.ndarray], factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x bands) and bit planes (texts x planes) of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    minima = np.empty((MINIMA, len(sets)), dtype=np.uint64)
    turned = np.empty_like(flat)
    for k in range(MINIMA):
        np.multiply(flat, factors[k], out=turned)
        np.minimum.reduceat(turned, starts, out=minima[k])
    keys = np.empty((BANDS, len(sets)), dtype=np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, dtype=np.uint64)
        for r in range(ROWS):
            key = mix(key + minima[b * ROWS + r])
        keys[b] = key
    low = np.ascontiguousarray((minima >> np.uint64(20)).T)
    planes = [np.packbits(((low >> np.uint64(j)) & np.uint64(1)).astype(np.uint8), axis=1).view("<i8")
              for j in range(BITS)]
    return keys.T.view(np.int64), np.concatenate(planes, axis=1)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = np.random.default_rng(11).integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in parted(batches):
        at = 0
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        for chunk in in_chunks(texts):
            sets = shingle_sets(chunk)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            planes: list = [None] * len(sets)
            if full:
                keys, bits = _sketches([sets[i] for i in full], factors)
                for j, i in enumerate(full):
                    bands[i], planes[i] = keys[j], bits[j]
            digests = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(at, len(chunk)), batch.column(1).slice(at, len(chunk)),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([int.from_bytes(d[:8], "big", signed=True) if d else None for d in digests], pa.int64()),
                pa.array(bands, pa.list_(pa.int64())), pa.array(planes, pa.list_(pa.int64()))],
                names=["doc_id", "row_key", "n_shingles", "digest", "class_key", "bands", "planes"])
            at += len(chunk)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")


def sketch(docs: DataFrame) -> DataFrame:
    """Set size, set digest and MinHash sketch of each row's text; null parts for empty sets."""
    return _keyed(docs).mapInArrow(lean(_sketch_batches), _SKETCH)


def similarity_bound(percent: int = PERCENT) -> float:
    """Least estimate at which a pair is still confirmed."""
    t, chance = percent / 100, 2.0 ** -BITS
    share = chance + (1 - chance) * t
    return t - SIGMAS * (share * (1 - share) / MINIMA) ** 0.5 / (1 - chance)


def estimated_similarity(a: str, b: str) -> Column:
    """Estimate from the packed signatures of two column prefixes."""
    words = MINIMA // 64
    unequal = F.lit(0)
    for w in range(words):
        differs = F.lit(0).cast("long")
        for j in range(BITS):
            i = j * words + w
            differs = differs.bitwiseOR(
                F.col(f"{a}_planes")[i].bitwiseXOR(F.col(f"{b}_planes")[i]))
        unequal = unequal + F.bit_count(differs)
    chance = 2.0 ** -BITS
    return ((1 - unequal / MINIMA) - chance) / (1 - chance)


def _likely(percent: int) -> Column:
    """Bounds on the sizes, exact, and on the estimate."""
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    return (small * 100 >= large * percent) & (estimated_similarity("a", "b") >= similarity_bound(percent))


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            names = batch.schema.names
            left = batch.column(names.index("a_text")).cast(pa.binary()).to_pylist()
            right = batch.column(names.index("b_text")).cast(pa.binary()).to_pylist()
            keep = []
            for x, y in zip(left, right):
                s, t = shingle_sets([x, y])
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            kept = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if kept.num_rows:
                yield kept
    return run


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``k, text`` for the wanted row keys, written."""
    wanted = written(keys.distinct(), "wanted")
    hashed = _keyed(docs).select(F.col("row_key").alias("k"), "text").where("text is not null")
    # An inner join: the optimizer would move a semi join below the prefilter.
    return written(likely(hashed, "k", wanted).where("likely_").drop("likely_").join(wanted, "k").groupBy("k").agg(
        F.first("text").alias("text")), "texts")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` (digests) with their text keys, checked on whole texts."""
    pairs = written(pairs, "pairs")
    texts = _texts(docs, pairs.select(F.col("a_row_key").alias("k")).union(
        pairs.select(F.col("b_row_key").alias("k"))))
    left = texts.select(F.col("k").alias("a_row_key"), F.col("text").alias("a_text"))
    right = texts.select(F.col("k").alias("b_row_key"), F.col("text").alias("b_text"))
    return pairs.join(left, "a_row_key").join(right, "b_row_key").select(
        "a", "b", "a_text", "b_text").mapInArrow(lean(_confirm(percent)), "a binary, b binary")


_BLOCK = ["band", "lo", "hi"]


def _compare(percent: int):
    """Links between the classes of each block that are likely and not in one component."""
    bound, chance = similarity_bound(percent), 2.0 ** -BITS

    def links(rows: pa.Table, first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        part = rows.slice(first, size)
        # Unsigned, since bitwise_count counts the bits of a negative number's absolute value.
        planes = np.array(part.column("a_planes").to_pylist(), dtype=np.int64).view(np.uint64).reshape(size, BITS, -1)
        n = part.column("a_n").to_numpy()
        chunk = part.column("chunk").to_numpy()
        cross = part.column("lo")[0] != part.column("hi")[0]
        none = np.empty(0, dtype=np.int64)
        names: dict = {}
        root = np.array([names.setdefault(r, len(names)) for r in part.column("root").to_pylist()])

        def likely(i: int) -> np.ndarray:
            """Later rows that may be linked to row i."""
            differ = np.bitwise_or.reduce(planes[i] ^ planes[i + 1:], axis=1)
            unequal = np.bitwise_count(differ).sum(axis=1)
            estimate = ((1 - unequal / MINIMA) - chance) / (1 - chance)
            small, large = np.minimum(n[i], n[i + 1:]), np.maximum(n[i], n[i + 1:])
            fine = (estimate >= bound) & (100 * small >= percent * large) & (root[i] != root[i + 1:])
            return i + 1 + np.flatnonzero(fine & (chunk[i] != chunk[i + 1:]) if cross else fine)

        sets: list[np.ndarray] = []
        left, right = [none], [none]
        for i in range(size - 1):
            may = likely(i)
            if not len(may):
                continue
            if not sets:
                for texts in in_chunks(part.column("text").cast(pa.binary()).to_pylist()):
                    sets += shingle_sets(texts)
                owner = np.repeat(np.arange(size), [len(s) for s in sets])
                flat = np.concatenate(sets)
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            length = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
            both = np.bincount(owner[at], minlength=size)
            j = may[100 * both[may] >= percent * (n[i] + n[may] - both[may])]
            # One link to each component, which is row i's from here on.
            reached, at = np.unique(root[j], return_index=True)
            left.append(np.full(len(at), i))
            right.append(j[at])
            root[np.isin(root, reached)] = root[i]
        return first + np.concatenate(left), first + np.concatenate(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(parted(batches, 2_000), _BLOCK):
            found = [links(rows, f, s) for f, s in zip(*group_sizes(rows, _BLOCK)) if s > 1]
            if not found:
                continue
            i, j = (np.concatenate(x) for x in zip(*found))
            root = local_roots(rows.num_rows, i, j)
            digest = rows.column("a").to_pylist()
            moved = np.flatnonzero(root != np.arange(len(root))).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest[k] for k in moved], pa.binary()),
                 pa.array([digest[root[k]] for k in moved], pa.binary())], names=["a", "b"])
    return run


def _between_components(members: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between classes that share a band and are not in one component yet."""
    split = written(members.groupBy("band").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"),
        F.ceil(F.greatest(F.sum("a_n") / BLOCK_SHINGLES, F.count("*") / BLOCK_ROWS)).cast("int").alias("parts")).where(
        "low != high and n > 2").select("band", "parts"), "split")
    rest = written(members.where("class_key != head").join(split, "band").withColumn(
        "chunk", F.pmod(F.xxhash64("a", F.lit(7)), F.col("parts")).cast("int")), "rest")
    texts = _texts(docs, rest.select(F.col("a_row_key").alias("k")))
    blocks = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "band", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk",
        "a", "a_n", "a_planes", "root", F.col("a_row_key").alias("k"))
    return blocks.join(texts, "k").drop("k").repartition(*_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(
        lean(_compare(percent)), "a binary, b binary")


def _side(classes: DataFrame, name: str) -> DataFrame:
    return classes.select(
        F.col("class_key").alias(f"{name}_key"), F.col("digest").alias(name),
        F.col("n_shingles").alias(f"{name}_n"), F.col("planes").alias(f"{name}_planes"),
        F.col("row_key").alias(f"{name}_row_key"))


def near_links(docs: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Confirmed links ``a, b`` between set digests; they join all that is similar."""
    classes = written(sketches.where("digest is not null").groupBy("digest").agg(
        F.first("class_key").alias("class_key"), F.first("n_shingles").alias("n_shingles"),
        F.min("row_key").alias("row_key"),
        F.first("bands").alias("bands"), F.first("planes").alias("planes")), "classes")
    bands = classes.select("class_key", F.explode("bands").alias("band"))
    heads = written(bands.groupBy("band").agg(
        F.min("class_key").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"), "heads")
    hits = written(bands.join(heads, "band"), "buckets")

    stars = hits.where("class_key != head").select(
        F.col("class_key").alias("a_key"), F.col("head").alias("b_key")).distinct()
    first = stars.join(_side(classes, "a"), "a_key").join(_side(classes, "b"), "b_key").where(
        _likely(percent)).select("a", "b", "a_row_key", "b_row_key")
    links = written(_confirmed(first, docs, percent), "links")

    roots = connected_components(links, "a", "b")
    members = hits.join(_side(classes, "a").withColumnRenamed("a_key", "class_key"), "class_key").join(
        roots, F.col("a") == F.col("node"), "left").select(
        "band", "class_key", "head", "a", "a_n", "a_planes", "a_row_key",
        F.coalesce("root", "a").alias("root"))
    second = _between_components(written(members, "members"), docs, percent)
    return links.union(written(second, "links"))


def _rooted(docs: DataFrame, percent: int) -> DataFrame:
    """``doc_id, row_key, n_shingles, root`` per row; a null root for empty sets."""
    sketches = written(sketch(docs), "sketches")
    roots = connected_components(near_links(docs, sketches, percent), "a", "b")
    return written(sketches.select("doc_id", "row_key", "n_shingles", "digest").join(
        roots, F.col("digest") == F.col("node"), "left").select(
        "doc_id", "row_key", "n_shingles", F.coalesce("root", "digest").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``.

    Documents are linked when ``100 * intersection >= percent * union`` of their sets. Rows
    without words, or with null text, have size 0 and stand alone. ``component_id`` is the
    smallest doc_id that links reach; ``kept`` marks the rows that carry it. Rows that repeat
    an id are each judged by their text. A row with a null id takes part in links; it is kept
    only if its component has no id at all (component_id null). Other columns are ignored; an
    empty table gives no rows.
    """
    rows = _rooted(docs, percent)
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = rows.join(written(least.withColumnRenamed("root", "r"), "least"), F.col("root") == F.col("r"), "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the smallest doc_id, null last.

    Of rows equal in id and text one stays. Rows without words stay as they are. Columns pass
    through. Only rows that a bitmap does not rule out as dropped or repeated are shuffled.
    """
    key = "near_row_key_"
    rows = _rooted(docs, percent).where("root is not null").groupBy("root", "row_key").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    rows = written(rows, "rows")
    best = written(rows.groupBy(F.col("root").alias("r")).agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).getField("row_key").alias("best")), "best")
    judged = written(rows.join(best, F.col("root") == F.col("r")).select(
        "row_key", "n", (F.col("row_key") == F.col("best")).alias("stays")), "judged")
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    lost = judged.where("not stays").select("row_key")
    repeated = judged.where("stays and n > 1").select("row_key")
    left = likely(without_rows(keyed, key, lost), key, repeated)
    once = left.where("likely_").join(repeated, F.col(key) == F.col("row_key"), "left")
    return left.where("not likely_").drop("likely_", key).union(
        once.where("row_key is null").drop("likely_", key, "row_key")).union(
        once.where("row_key is not null").dropDuplicates([key]).drop("likely_", key, "row_key"))
