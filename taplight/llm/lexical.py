"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds no terms. Documents of a similar number of entries form blocks; a block is a
bit matrix with one row (a slice) a hash value and one column a document. A document's entry
for each of its terms sets ``HASHES`` rows, and a term that occurs more often sets further
entries, one a level of ``LEVELS``. The slices of a term and level, anded, mark every document
that has the term that often, and a few others. So the weights of a query's terms, summed over
those slices, times what an occurrence count of a level can score at most in a document of that
length, bound a document's score from above.

A search first scores exactly the documents with the highest bounds of each query. The last
place among them is a score that enough documents reach, and everything whose bound lies below
it is provably outside the result. All other documents are scored exactly from their texts.
Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import likely, written
from .shingles import in_chunks, mix, word_hashes

TOP = 50
HASHES, BITS = 5, 16
#: Occurrences from which a level's entry is set. A level's score is that of its last count.
LEVELS = (1, 2, 3, 4, 6, 9, 14, 24, 48)
#: Bits of a block, and queries that are searched together.
CELLS, QUERIES = 1 << 25, 5_000
_TERM = np.zeros(256, dtype=bool)
_TERM[0x30:0x3A] = _TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True
_SALT = 0x9E3779B97F4A7C15
_BLOCK = ("doc_ids binary, row_keys binary, lengths binary, peaks binary, rows long, slices binary, "
          "n_docs long, n_terms long, df array<struct<term:int,n:long>>")


def term_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and counts of each text's distinct terms: runs of ASCII letters and digits and of
    all other characters from 128 on, with A-Z as a-z."""
    for some in in_chunks([t.encode() if t else b"" for t in texts]):
        hashes, first = word_hashes(b" ".join(some), _TERM)
        ends = np.searchsorted(first, np.cumsum([len(t) + 1 for t in some]))
        for lo, hi in zip([0, *ends.tolist()], ends.tolist()):
            yield np.unique(hashes[lo:hi], return_counts=True)


def _slots(hashes: np.ndarray, level: int, rows: int) -> list[np.ndarray]:
    salts = [np.uint64((level * HASHES + i + 1) * _SALT % 2**64) for i in range(HASHES)]
    return [(mix(hashes + salt) % np.uint64(rows)).astype(np.int64) for salt in salts]


class _Block:
    """Documents of one size class on their way into slices."""

    def __init__(self, rows: int):
        self.rows = rows
        self.docs: list[tuple] = []

    def full(self) -> bool:
        return bool(self.docs) and self.rows * (len(self.docs) + 1) > CELLS

    def sealed(self) -> tuple:
        n = len(self.docs)
        matrix = np.zeros((self.rows, n), dtype=bool)
        for level, least in enumerate(LEVELS):
            picked = [(d, h[c >= least]) for d, (_, _, h, c) in enumerate(self.docs)]
            hashes = np.concatenate([h for _, h in picked])
            column = np.repeat([d for d, _ in picked], [len(h) for _, h in picked])
            for slot in _slots(hashes, level, self.rows):
                matrix[slot, column] = True
        facts = zip(*((d[0], d[1], d[3].sum(), d[3].max()) for d in self.docs))
        return (*(np.array(f, dtype=np.int64).tobytes() for f in facts), self.rows,
                np.packbits(matrix, axis=1).tobytes())


class _Corpus:
    """Numbers of documents, of terms, and of documents that hold each watched term."""

    def __init__(self, watched: np.ndarray):
        self.watched, self.df = watched, np.zeros(len(watched), dtype=np.int64)
        self.n_docs = self.n_terms = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.n_docs += 1
        self.n_terms += int(counts.sum())
        if len(self.watched):
            at = np.minimum(np.searchsorted(self.watched, hashes), len(self.watched) - 1)
            self.df[at[self.watched[at] == hashes]] += 1

    def row(self) -> pa.RecordBatch:
        return _row(corpus=(self.n_docs, self.n_terms, [
            {"term": int(t), "n": int(self.df[t])} for t in np.flatnonzero(self.df)]))


def _row(block: tuple = (None,) * 6, corpus: tuple = (0, 0, [])) -> pa.RecordBatch:
    kinds = [pa.binary()] * 4 + [pa.int64(), pa.binary(), pa.int64(), pa.int64(),
                                 pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int64())]))]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*block, *corpus), kinds)],
                                      names=[f.split()[0] for f in _BLOCK.split(", ")])


def _signed(watched: np.ndarray, slices: bool = True):
    """Rows of blocks, and of corpus counts; without ``slices`` counts alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = _Corpus(watched)
        for batch in batches:
            blocks: dict[int, _Block] = {}
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, key, (hashes, counts) in zip(ids, keys, term_counts(batch.column(2).to_pylist())):
                if not len(hashes):
                    continue
                corpus.add(hashes, counts)
                if not slices:
                    continue
                entries = int(sum((counts >= least).sum() for least in LEVELS))
                rows = BITS << (entries - 1).bit_length()
                block = blocks.setdefault(rows, _Block(rows))
                if block.full():
                    yield _row(block.sealed())
                    block = blocks[rows] = _Block(rows)
                block.docs.append((2**63 - 1 if doc is None else doc, key, hashes, counts))
            for block in blocks.values():
                yield _row(block.sealed())
        yield corpus.row()
    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, text``; rows with equal keys are equal but for chance, which costs one
    more exact score."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64("doc_id", "text").alias("row_key"), "text")


def build_index(docs: DataFrame, watched: np.ndarray, slices: bool = True) -> DataFrame:
    """Blocks of signatures for ``docs(doc_id, text)``, as a written table, and rows without a
    block for the numbers of documents, of terms, and of documents that hold each of the sorted
    ``watched`` hashes. Without ``slices`` those rows alone."""
    return written(_mapped(_keyed(docs), (watched, slices), lambda state: _signed(*state), _BLOCK), "signatures")


def _mapped(rows: DataFrame, state, made, schema: str) -> DataFrame:
    """``rows`` through ``made(state)``, with the state shipped once a worker."""
    shipped = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return made(shipped.value)(batches)
    return rows.mapInArrow(run, schema)


def _worth(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied by."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Queries:
    """Weighted queries: the numbers of each one's terms, and the terms' hashes and weights."""

    def __init__(self, terms: list[np.ndarray]):
        self.hashes = np.unique(np.concatenate([*terms, np.empty(0, np.uint64)]))
        self.terms = [np.searchsorted(self.hashes, np.unique(t)) for t in terms]

    def weigh(self, counted: DataFrame) -> None:
        """Takes corpus counts from an index: a row for each of the queries' terms is collected."""
        total = counted.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        self.n_docs, self.n_terms = total[0] or 0, total[1] or 0
        df = np.zeros(len(self.hashes), dtype=np.int64)
        for r in counted.select(F.explode("df").alias("d")).groupBy("d.term").agg(F.sum("d.n").alias("n")).collect():
            df[r["term"]] = r["n"]
        self.weights = np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * d + 1)))
                                 for d in df.tolist()], dtype=np.int64)

    def _length_factor(self, n: np.ndarray) -> np.ndarray:
        return 50 + 50 * n * self.n_docs // self.n_terms

    def bounds(self, lengths: np.ndarray, peaks: np.ndarray, slices: np.ndarray) -> Iterator[np.ndarray]:
        """Query by query, upper bounds of the scores of a block's documents."""
        m, steps = self._length_factor(lengths), []
        below = np.zeros(len(m), dtype=np.int64)
        for level, least in enumerate(LEVELS):
            if least > peaks.max():
                break
            last = np.minimum(peaks, LEVELS[level + 1] - 1) if level + 1 < len(LEVELS) else peaks
            worth = np.where(peaks >= least, _worth(last, m), below)
            steps.append(worth - below)
            below = worth
        slots = [_slots(self.hashes, level, len(slices)) for level in range(len(steps))]
        for terms in self.terms:
            total, held = np.zeros(len(m), dtype=np.int64), None
            for step, slot in zip(steps, slots):
                marks = slices[slot[0][terms]]
                for more in slot[1:]:
                    marks &= slices[more[terms]]
                held = marks if held is None else held & marks
                some = held.any(axis=1)
                terms, held = terms[some], held[some]
                if not len(terms):
                    break
                bits = np.unpackbits(held, axis=1, count=len(m))
                # Sums of weights are whole numbers far below 2**53.
                total += (self.weights[terms].astype(float) @ bits).astype(np.int64) * step
            yield total

    def score(self, query: int, hashes: np.ndarray, counts: np.ndarray) -> int:
        """The exact score of a document with terms."""
        terms = self.terms[query]
        wanted = self.hashes[terms]
        at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        hit = hashes[at] == wanted
        m = self._length_factor(counts.sum())
        return int((self.weights[terms[hit]] * _worth(counts[at[hit]], m)).sum())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Ids, keys, lengths, peaks and slices of the blocks of an index."""
    for batch in batches:
        for row in batch.to_pylist():
            yield *(np.frombuffer(row[c], dtype=np.int64) for c in ("doc_ids", "row_keys", "lengths", "peaks")), \
                np.frombuffer(row["slices"], dtype=np.uint8).reshape(row["rows"], -1)


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    """Rows of query, document id, key and bound from such arrays, the query's number first."""
    sizes = [len(f[1]) for f in found]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat([f[0] for f in found], sizes).astype(np.int32)),
         *(pa.array(np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)]), pa.int64()) for k in (1, 2, 3))],
        names=["query", "doc_id", "row_key", "bound"])


_PAIR = "query int, doc_id long, row_key long, bound long"


def _highest(state: tuple[Queries, int]):
    """A task's documents with the highest bounds of each query, smaller ids first."""
    queries, top = state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple | None] = [None] * len(queries.terms)
        for ids, keys, lengths, peaks, slices in _blocks(batches):
            for q, bound in enumerate(queries.bounds(lengths, peaks, slices)):
                at = np.flatnonzero(bound > (best[q][2][-1] - 1 if best[q] and len(best[q][2]) == top else 0))
                if not len(at):
                    continue
                new = ids[at], keys[at], bound[at]
                if best[q]:
                    new = tuple(np.concatenate(x) for x in zip(best[q], new))
                order = np.lexsort((new[0], -new[2]))[:top]
                best[q] = tuple(x[order] for x in new)
        yield _pairs([(q, *b) for q, b in enumerate(best) if b])
    return run


def _open(state: tuple[Queries, dict[int, tuple[int, int]]]):
    """Documents that a query's threshold (a score, and the last id that may tie) doesn't exclude."""
    queries, thresholds = state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, lengths, peaks, slices in _blocks(batches):
            found = []
            for q, bound in enumerate(queries.bounds(lengths, peaks, slices)):
                least, last = thresholds.get(q, (1, 2**63 - 1))
                at = np.flatnonzero((bound > least) | ((bound == least) & (ids <= last)))
                if len(at):
                    found.append((q, ids[at], keys[at], bound[at]))
            yield _pairs(found)
    return run


def _exact(queries: Queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, doc, score = [], [], []
            rows = zip(batch.column(0).to_pylist(), batch.column(2), term_counts(batch.column(1).to_pylist()))
            for doc_id, wanted, (hashes, counts) in rows:
                for q in wanted.as_py() if len(hashes) else ():
                    value = queries.score(q, hashes, counts)
                    if value > 0:
                        query.append(q)
                        doc.append(doc_id)
                        score.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(doc, pa.int64()), pa.array(
                score, pa.int64())], names=["query", "doc_id", "score"])
    return run


def _scored(docs: DataFrame, pairs: DataFrame, queries: Queries, top: int) -> DataFrame:
    """``query, doc_id, score, rank`` of the best documents among ``pairs(query, row_key)``, scored
    from their texts. A bitmap keeps the texts of all others out of the join."""
    wanted = written(pairs.groupBy(F.col("row_key").alias("k")).agg(F.collect_set("query").alias("queries")), "pairs")
    near = likely(_keyed(docs), "row_key", wanted.select("k")).where("likely_")
    # A left join, since an inner one would add its own filter below the bitmap.
    rows = near.join(wanted, F.col("row_key") == F.col("k"), "left").where("k is not null").select(
        "doc_id", "text", "queries")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return _mapped(rows, queries, _exact, "query int, doc_id long, score long").withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _items(items: DataFrame, size: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and term hashes of the queries, ``size`` at a time."""
    ids, texts = [], []
    for row in items.select("item_id", "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        if len(ids) == size:
            yield ids, [h for h, _ in term_counts(texts)]
            ids, texts = [], []
    if ids:
        yield ids, [h for h, _ in term_counts(texts)]


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, together: int = QUERIES) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``top`` documents of ``docs(doc_id, text)`` with a
    score above 0 for each row of ``items(item_id, text)``; equal scores by ascending doc_id.

    Weights, lengths and scores are whole numbers, so that any machine gives the same ranks.
    Null and empty texts have no terms: such documents count nowhere, such items give no rows.
    Repeated documents and items each count and rank; null ids stay, those of documents last.
    Other columns are ignored; empty tables give no rows. Items go through the driver,
    ``together`` at a time; the index is built once.
    """
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    index, result = None, None
    for ids, terms in _items(items, together):
        queries = Queries(terms)
        counted = build_index(docs, queries.hashes, slices=index is None)
        if index is None:
            index = counted.where("slices is not null")
        queries.weigh(counted)
        first = Window.partitionBy("query").orderBy(F.col("bound").desc(), "doc_id")
        seeds = _mapped(index, (queries, top), _highest, _PAIR).withColumn("nth", F.row_number().over(first)).where(
            F.col("nth") <= top)
        # One row a query: the last place among the documents with the highest bounds.
        last = _scored(docs, seeds, queries, top).where(F.col("rank") == top).collect()
        thresholds = {r["query"]: (r["score"], 2**63 - 1 if r["doc_id"] is None else r["doc_id"]) for r in last}
        best = _scored(docs, _mapped(index, (queries, thresholds), _open, _PAIR), queries, top)
        named = spark.createDataFrame(list(enumerate(ids)), f"q int, item_id {kind}")
        part = written(best, "best").join(named, F.col("query") == F.col("q")).select(
            "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        result = part if result is None else result.union(part)
    if result is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return result
