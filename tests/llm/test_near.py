"""Near-duplicate texts and vectors, and the components below them, against all pairs."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import reference
from taplight.llm import common, near_text, vector_links
from taplight.llm.common import parted
from taplight.llm.components import connected_components

SCHEMA = "doc_id long, text string, bands string, root int"


def _texts(seed: int) -> dict:
    """A large group around one text, chains, copies, shared passages, short and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage = make(90), make(30)
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    chain = make(60)
    for _ in range(12):
        chain = chain[3:] + make(3)
        texts.append("  ".join(chain))
    texts += [" ".join(passage + make(rng.randrange(0, 40))) for _ in range(25)]
    texts += [texts[0], texts[0].upper(), "Eins zwei", "eins\tZWEI", "eins zwei drei", "", "   ", None, None,
              "É a b c d e", "é a b c d e", "x " * 30_000]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("block", [near_text.BLOCK_SHINGLES, 400])
def test_near_text_matches_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_text, "BLOCK_SHINGLES", block)
    rows = _texts(block)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows.items()], SCHEMA)
    got = {r["doc_id"]: r for r in near_text.near_duplicates(docs).collect()}
    size, root = reference.near_components(rows)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {
        i: (size[i], root[i], root[i] == i) for i in rows}


def test_near_text_with_few_rows_a_block(spark, monkeypatch):
    monkeypatch.setattr(near_text, "BLOCK_ROWS", 5)
    rows = _texts(3)
    rows.update({1000 + i: f"one two three four five six seven eight {i}" for i in range(60)})
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows.items()], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in near_text.near_duplicates(docs).collect()}
    assert got == reference.near_components(rows)[1]


def test_a_block_needs_no_square_of_its_rows():
    n = 4000
    texts = [f"one two three four five six seven eight {i}" for i in range(n)] + ["one two three four five six seven eight 0 x"]
    zeros = [[0] * (near_text.BITS * near_text.MINIMA // 64)] * (n + 1)
    batch = pa.RecordBatch.from_pydict({
        "band": [1] * (n + 1), "lo": [0] * (n + 1), "hi": [0] * (n + 1), "chunk": [0] * (n + 1),
        "a": [b"%06d" % i for i in range(n + 1)], "a_n": [5] * n + [6], "a_planes": zeros,
        "root": list(range(n + 1)), "text": texts})
    tracemalloc.start()
    links = [x for b in near_text._compare(75)(iter([batch])) for x in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [tuple(x.values()) for x in links] == [(b"%06d" % n, b"000000")]
    assert peak < n * n, peak        # bytes of a matrix of flags


def test_near_text_odd_rows(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(None, text, "x", 1), (5, text, "x", 1), (5, text, "x", 1), (7, None, "x", 1),
                                  (7, "p q r s t u", "x", 1), (None, "one two", "x", 1)], SCHEMA)
    got = sorted(map(tuple, near_text.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 3, 5, False), (5, 3, 5, True), (5, 3, 5, True), (7, 0, 7, True), (7, 2, 7, True),
                          (None, 1, None, True)], key=str)
    assert near_text.near_duplicates(docs.limit(0)).count() == 0
    left = near_text.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(
        [(5, text), (7, None), (7, "p q r s t u"), (None, "one two")], key=str)


def test_estimate_follows_similarity(spark):
    rng = random.Random(3)
    a = [f"t{rng.randrange(10**6)}" for _ in range(1000)]
    b = a[:850] + [f"u{i}" for i in range(150)]
    sketches = near_text.sketch(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string"))
    x, y = (sketches.where(f"doc_id = {i}").selectExpr(f"planes as {n}_planes") for i, n in ((1, "a"), (2, "b")))
    estimate = x.crossJoin(y).select(near_text.estimated_similarity("a", "b")).first()[0]
    s, t = reference.shingles(" ".join(a)), reference.shingles(" ".join(b))
    assert abs(estimate - len(s & t) / len(s | t)) < 0.15


@pytest.mark.parametrize("block", [vector_links.BLOCK, 7])
def test_vectors_match_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    rows = []
    for label in (0, 1, None):
        centre = rng.standard_normal(16)
        rows += [(label, (centre + rng.standard_normal(16) * s).tolist()) for s in rng.uniform(0.05, 0.3, 40)]
        rows += [(label, rng.standard_normal(16).tolist()) for _ in range(20)]
    rows += [(0, rows[0][1]), (0, rows[0][1]), (0, [2 * v for v in rows[0][1]]), (0, None), (0, []), (0, [0.0] * 16),
             (0, [float("nan")] * 16), (0, [float("inf")] + [1.0] * 15), (0, [None] + [1.0] * 15), (0, rows[0][1][:8])]
    table = [(i, v, label, "clash") for i, (label, v) in enumerate(rows)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int, digest string")
    groups, links = reference.Sets(range(len(rows))), [0] * len(rows)

    def fit(v):
        return v and None not in v and np.isfinite(v).all() and np.any(v)
    for i, (a, x) in enumerate(rows):
        for j, (b, y) in enumerate(rows[:i]):
            if a is not None and a == b and fit(x) and fit(y) and len(x) == len(y):
                if np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    groups.link(i, j)
                    links[i] += 1
                    links[j] += 1
    got = sorted(map(tuple, vector_links.vector_components(df, block=block).collect()))
    assert got == [(i, links[i], groups.find(i), groups.find(i) == i) for i in range(len(rows))]
    assert vector_links.vector_components(df.limit(0)).count() == 0


def test_repeated_and_null_vector_ids(spark):
    v = [1.0, 2.0]
    df = spark.createDataFrame([(3, v, 0), (3, v, 0), (None, v, 0), (None, [5.0, -1.0], 0)],
                               "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, vector_links.vector_components(df).collect()), key=str) == sorted(
        [(3, 2, 3, True), (3, 2, 3, True), (None, 2, 3, False), (None, 0, None, True)], key=str)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(0, i) for i in range(200, 260)]
    pairs += [(400 + i, 401 + i) for i in range(40)] + [(1, None), (7, 7)]
    groups = reference.Sets(range(500))
    for a, b in pairs:
        if b is not None:
            groups.link(a, b)
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    touched = {x for a, b in pairs if b is not None and a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in got} == {x: groups.find(x) for x in touched} and len(got) == len(touched)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_texts_are_taken_a_few_at_a_time():
    batch = pa.RecordBatch.from_pydict({"n": list(range(1201))})
    parts = list(parted(iter([batch, batch.slice(0, 0)])))
    assert [p.num_rows for p in parts] == [500, 500, 201]
    assert [n for p in parts for n in p.column(0).to_pylist()] == list(range(1201))


def test_no_batch_is_held_while_the_next_is_read():
    held = []

    def batches():
        for _ in range(3):
            held.append(pa.total_allocated_bytes() - before)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4_000_000))], names=["n"])

    before = pa.total_allocated_bytes()
    for part in parted(batches(), 1_000_000):
        assert part.num_rows == 1_000_000
    assert max(held) < 12_000_000


def test_workers_give_back_what_a_task_freed(monkeypatch):
    done = []
    monkeypatch.setattr(common, "_give_back", lambda: done.append(sum(seen)))
    seen = []

    def run(batches):
        for batch in batches:
            seen.append(batch.num_rows)
            yield batch

    batch = pa.RecordBatch.from_pydict({"n": [1, 2, 3]})
    assert [b.num_rows for b in common.lean(run)(iter([batch, batch]))] == [3, 3]
    assert done == [6]


def test_giving_back_frees_what_small_values_took():
    def now() -> int:
        with open("/proc/self/smaps_rollup") as lines:
            return sum(int(line.split()[1]) for line in lines if line.startswith("Pss_Anon:"))

    kept, texts = [], []
    for i in range(60_000):
        texts.append(bytes(4_000))
        if i % 1_000 == 0:
            kept.append(bytes(4_000))
    full = now()
    texts.clear()
    common._give_back()
    assert full - now() > 150_000 and len(kept) == 60
