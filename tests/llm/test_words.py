"""Sentence pieces, ranked search and spelling variants against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from taplight.llm import lexical, pieces, spelling
from taplight.llm.common import ordered_groups

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, word string, n long, rank int, ids binary"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "w", 7, 1, bytearray(b"x")) for i, t in rows], SCHEMA)


# ------------------------------------------------------------------ sentence pieces

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def _texts(library) -> list:
    rng = random.Random(3)
    fixed = [None, "", "a", " ", "  a   b    c  ", "\n\n \n", "é🎉中文", "▁a▁▁b", "<s>abc</s><0x0A><unk>", "\x00a\x00",
             "the" * 50, "a" * 1000, " " * 300 + "x" + " " * 17, "thethe the\tthe", "é", "﻿abc"]
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "thera n", "ab \n▁", "aeinrst ABC.,:!?0123456789éèñöß\n\t中🎉"]
    made = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    known = [library.id_to_piece(i) for i in range(259, 32000)]
    made += ["".join(rng.choice(known) for _ in range(rng.randrange(1, 12))) for _ in range(800)]
    made += ["".join(rng.choice(known).replace("▁", "") for _ in range(rng.randrange(1, 12))) for _ in range(800)]
    return fixed + made


def test_pieces_equal_the_library(spark, library):
    rows = list(enumerate(_texts(library))) + [(3, "again"), (3, "again"), (None, "no id")]
    docs = _docs(spark, rows)
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in pieces.round_trips(docs, MODEL).collect()) == want
    encoded = pieces.encode(docs, MODEL)
    assert Counter((r[0], hashlib.sha256(r[1]).hexdigest()) for r in encoded.collect()) == Counter(
        {k: n for k, n in ((k[:1] + k[2:3], n) for k, n in want.items())})
    back = pieces.decode(encoded, MODEL)
    assert Counter((r[0], hashlib.sha256(r[1].encode()).hexdigest()) for r in back.collect()) == Counter(
        {k: n for k, n in ((k[:1] + k[3:], n) for k, n in want.items())})
    assert pieces.round_trips(docs.limit(0), MODEL).count() == 0


def test_long_texts_and_words_without_spaces(library):
    rng, model = random.Random(4), pieces.Pieces.read(MODEL)
    known = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    for text in ("".join(rng.choice(known) for _ in range(60_000)), "".join(rng.choice("thera") for _ in range(100_000)),
                 "ab" * 50_000, " " * 70_000, "\n" * 1000 + "中" * 30_000):
        want = np.array(library.encode(text, add_bos=True, add_eos=True), "<u4").tobytes()
        assert list(model.packed([text])) == [want]
        assert model.text(want) == text


def test_slices_don_t_change_ids(library, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 100)
    monkeypatch.setattr(pieces, "REMEMBERED", 40)
    model = pieces.Pieces.read(MODEL)
    texts = [t or "" for t in _texts(library)][:300] + ["one two  three " * 40]
    for text, packed in zip(texts, model.packed(texts)):
        assert packed == np.array(library.encode(text, add_bos=True, add_eos=True), "<u4").tobytes()


def test_any_ids_decode_as_the_library_does(library):
    rng, model = random.Random(5), pieces.Pieces.read(MODEL)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), rng.choice([259, 260, 29871])])
               for _ in range(rng.randrange(8))]
        assert model.text(np.array(ids, "<u4").tobytes()) == library.decode(ids)


# ------------------------------------------------------------------ ranked search

def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().lower().decode())


def _ranked(rows, items, top=50):
    docs = [(i, Counter(_terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        terms, found = set(_terms(text)), []
        for i, c in docs:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (
                (1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i, item))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, k, f[2], -f[0]) for k, f in enumerate(found[:top], 1)]
    return out


def _random_docs(rng, n):
    words = [f"w{i}" for i in range(300)] + ["É", "naïve", "中文", "X1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 40, 200, 2000])))) for i in range(n)]


def test_search_equals_scoring_every_document(spark):
    rng = random.Random(9)
    rows = _random_docs(rng, 300)
    rows += [(400 + i, "copied text w250 w251 w1 w1 w1") for i in range(120)]   # ties beyond the last place
    rows += [(5, "w9 repeated w7"), (5, "w9 repeated w7"), (None, "w9 without id"), (None, "w9 without id"),
             (900, None), (901, ""), (902, "..."), (903, "w3 " * 30_000 + "w299 " * 50), (904, "A-B_c w8W8")]
    items = [(0, "w1 w2 w250 copied"), (1, "W9 w9 repeated without"), (2, "w299 w298 É naïve 中文"), (3, None), (4, ""),
             (5, "unseen"), (6, "x1, X1; w0"), (7, "w3"), (7, "w3"), (None, "a b c"), (9, " ".join(f"w{i}" for i in range(300)))]
    docs = _docs(spark, rows).repartition(5)
    queries = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, query int")
    for together in (50, 3):
        got = lexical.ranked_search(docs, queries, together=together)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(_ranked(rows, items), key=str)
    assert sorted(map(tuple, lexical.ranked_search(docs, queries, top=3).collect()), key=str) == sorted(
        _ranked(rows, items, 3), key=str)


def test_search_over_nothing(spark):
    docs, items = _docs(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id string, text string")
    assert lexical.ranked_search(docs.limit(0), items).collect() == []
    assert lexical.ranked_search(docs, items.limit(0)).dtypes == [
        ("item_id", "string"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert lexical.ranked_search(_docs(spark, [(1, None), (2, "!")]), items).collect() == []


def test_bounds_are_bounds_and_leave_most_out(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 1 << 16)   # many small blocks
    rng = random.Random(10)
    rows = _random_docs(rng, 400)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(20)) for _ in range(10)]
    queries = lexical.Queries([h for h, _ in lexical.term_counts(texts)])
    index = lexical.build_index(_docs(spark, rows), queries.hashes)
    queries.weigh(index)
    assert queries.n_docs == 400 and index.where("slices is not null").count() > 5
    counts = dict(zip((i for i, _ in rows), lexical.term_counts([t for _, t in rows])))
    above = total = 0
    for row in index.where("slices is not null").collect():
        ids, _, lengths, peaks = (np.frombuffer(row[c], np.int64) for c in ("doc_ids", "row_keys", "lengths", "peaks"))
        slices = np.frombuffer(row["slices"], np.uint8).reshape(row["rows"], -1)
        for q, bound in enumerate(queries.bounds(lengths, peaks, slices)):
            exact = np.array([queries.score(q, *counts[i]) for i in ids.tolist()])
            assert (bound >= exact).all()
            above, total = above + bound.sum(), total + exact.sum()
    assert above < 1.3 * total


# ------------------------------------------------------------------ spelling variants

def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    out, form = {}, {}
    for w in n:
        near = [v for v in n if _one_edit(v, w)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
        out[w] = [n[w], len(near), n[form[w]] if form[w] else None]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, *out[w])
    return sorted(out.values(), key=str)


def _spelled(rng, n):
    base = ["receive", "separate", "definitely", "occurrence", "élève", "naïveté", "straße", "ÿÿÿÿÿÿ", "anagram", "margana"]
    words = Counter()
    for w in base:
        words[w] += 700
        for _ in range(25):
            v = list(w)
            for _ in range(rng.randrange(1, 3)):
                k = rng.randrange(len(v))
                v[k:k + 1] = rng.choice([[], [rng.choice("abcdeéß")], [v[k], rng.choice("xyz")]])
            words["".join(v)] += rng.choice([5, 6, 30, 140])
    return words


def test_variants_equal_brute_force(spark):
    rng = random.Random(12)
    words = [w for w, k in _spelled(rng, 10).items() for _ in range(k)]
    rng.shuffle(words)
    rows = [(i // 2, " ".join(w.upper() if rng.random() < .1 and w.isascii() else w for w in words[i::60]))
            for i in range(60)]
    long = "ab" * 40_000
    rows += [(100 + i, f"{long} {long}c") for i in range(5)]
    rows += [(None, "withoutid " * 6), (None, None), (7, ""), (8, "a b c"), (9, "receiveé-receivex_receive9receive")]
    rows += [rows[0], rows[0]]
    want = _variants(rows)
    assert sum(r[1] is not None for r in want) > 30 and any(r[1] and r[1] != r[2] for r in want)
    docs = _docs(spark, rows).repartition(4)
    for sizes in ((2000, 8000), (3, 5)):
        got = spelling.spelling_variants(docs, *sizes)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(_docs(spark, [(1, "receive " * 9)]).limit(0)).collect() == []
    assert [tuple(r) for r in spelling.spelling_variants(_docs(spark, [(1, "wonder " * 9)])).collect()] == [
        ("wonder", None, "wonder", 9, 0, None)]


def test_words_are_dealt_into_bounded_groups(spark):
    rng = random.Random(13)
    words = list({"".join(rng.choice("ab") for _ in range(12)) for _ in range(1500)})
    table = spark.createDataFrame([(w, 5 + i % 9) for i, w in enumerate(words)], "word string, n long")
    sizes = spelling._dealt(table, 50, 100).groupBy("block", "chunk", "part", (spelling.F.col("side") == 0).alias(
        "own")).count().collect()
    assert max(r["count"] for r in sizes if r["own"]) < 90 and max(r["count"] for r in sizes if not r["own"]) < 160
    got = {(r["word"], r["near"]) for r in spelling.near_words(table, 50, 100).collect()}
    assert got == {(a, b) for a in words for b in words if _one_edit(a, b)}


def test_ordered_groups():
    import pyarrow as pa
    keys = ["a", "a", "b", "b", "b", "c"]
    batches = [pa.RecordBatch.from_pydict({"k": keys[i: i + 2], "v": [i, i + 1]}) for i in (0, 2, 4)]
    batches.insert(1, batches[0].slice(0, 0))
    assert [g.column("v").to_pylist() for g in ordered_groups(batches, ["k"])] == [[0, 1], [2, 3, 4], [5]]
    assert list(ordered_groups([], ["k"])) == []
