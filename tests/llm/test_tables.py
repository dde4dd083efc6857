"""URL lists, sharding and archives against plain Python; SQL checks; the pipeline."""

import hashlib
import random
from collections import defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
import reference
from oracle import compare
from taplight.llm import queries, sharding, url_lists, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    ok, note = compare(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)
    assert ok, note


def test_entry_has_the_queries():
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())


def test_url_keys(spark):
    rows = [("HTTPS://u@A.b.Example.com:80/x//y/?q=1#f",), ("http://h.org",), ("no url",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "url string").select(url_lists.url_keys(url_lists.F.col("url"))).collect()]
    assert got == [["d:a.b.example.com", "d:b.example.com", "d:example.com", "p:a.b.example.com/x",
                    "p:a.b.example.com/x/y"], ["d:h.org"], [], [], []]


def test_captures_against_lists(spark):
    rng = random.Random(6)
    entries = [(rng.choice("ab"), rng.choice(["d:x.com", "d:y.x.com", "p:y.x.com/p"]), rng.choice(["add", "remove"]),
                rng.randrange(0, 400)) for _ in range(120)]
    entries += [("a", "d:x.com", "add", 50), ("a", "d:x.com", "remove", 50), (None, "d:x.com", "add", 1),
                ("a", None, "add", 1), ("a", "d:x.com", "other", 1), ("a", "d:x.com", "add", None)]
    captures = [(i, rng.choice(["http://y.x.com/p/q", "http://x.com/", "http://z.org/"]), rng.randrange(-20, 500))
                for i in range(300)]
    captures += [(900, None, 10), (901, "http://x.com/", None), (902, "http://x.com/", 60), (902, "http://x.com/", 60), (None, "", 5)]
    state = defaultdict(list)
    for name, key, action, at in entries:
        if None not in (name, key, at) and action in ("add", "remove"):
            state[name, key].append((at, action == "remove"))
    keys = {"http://y.x.com/p/q": ["d:y.x.com", "d:x.com", "p:y.x.com/p"], "http://x.com/": ["d:x.com"]}

    def active(url, t):
        found = []
        for (name, key), events in state.items():
            past = [e for e in events if t is not None and e[0] <= t]
            if key in keys.get(url, ()) and past and not max(past)[1]:
                found.append((-len(key), key, name))
        return len(found), min(found)[1:] if found else (None, None)

    got = url_lists.filter_captures(
        spark.createDataFrame([(*c, "z") for c in captures], "page_id long, url string, fetched_at long, key string"),
        spark.createDataFrame(entries, "list_name string, key string, action string, at long"), bucket=70)
    rows = [(r["page_id"], r["fetched_at"], r["n_active"], r["decided_by"], r["decided_list"], r["blocked"]) for r in got.collect()]
    want = []
    for i, url, t in captures:
        n, (key, name) = active(url, t)
        want.append((i, t, n, key, name, n > 0))
    assert sorted(rows, key=str) == sorted(want, key=str)
    none = url_lists.filter_captures(
        spark.createDataFrame(captures, "page_id long, url string, fetched_at long"),
        spark.createDataFrame([], "list_name string, key string, action string, at long"))
    assert none.where("blocked").count() == 0 and none.count() == len(captures)


def test_shards_fit_and_cover(spark):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randrange(0, 60)) for i in range(400)] + [(7, "hot" * rng.randrange(1, 30)) for _ in range(150)]
    rows += [(8, "same" * 5)] * 90 + [(None, "y" * 30)] * 40 + [(9, None)] * 3 + [(10, "z" * 5000)]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, shard string, depth int")
    got = sharding.assign_shards(docs, limit=700).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"]) for r in got) == sorted((str(i), len(t or "")) for i, t in rows)
    size = defaultdict(lambda: [0, 0])
    for r in got:
        size[r["shard"]][0] += r["n_bytes"]
        size[r["shard"]][1] += 1
    for r in got:
        assert [r["shard_bytes"], r["shard_rows"]] == size[r["shard"]], r
    assert all(b <= 700 or n == 1 for b, n in size.values())
    plain = [s for s in size if "." not in s and "#" not in s]
    assert not any(a != b and b.startswith(a) for a in plain for b in plain)
    assert sharding.assign_shards(docs.limit(0)).count() == 0
    one = sharding.assign_shards(docs, limit=10**9).collect()
    assert {r["shard"] for r in one} == {""}


def test_written_shards_read_back(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * 50) for i in range(100)], "doc_id long, text string")
    assigned = sharding.assign_shards(docs, limit=900)
    sharding.write_shards(docs, str(tmp_path / "shards"), limit=900)
    back = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "shards"))
    assert back.count() == 100
    folders = list((tmp_path / "shards").glob("shard=*"))
    assert len(folders) == assigned.select("shard").distinct().count() > 1
    assert all(len(list(f.glob("*.parquet"))) == 1 for f in folders)


def test_hot_and_repeated_rows_are_written_once(spark, tmp_path, monkeypatch):
    rows = [(7, "é" * (i % 9) + f"text {i}") for i in range(200)] + [(7, "same")] * 300 + [(8, "x" * 40)] * 50
    rows += [(i, f"t{i}") for i in range(20, 60)] + [(None, "n"), (None, None), (9, "z" * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, sharding.shard_and_read(docs, 300).collect()), key=str) == sorted(
        _extendible([(i, t) for i, t in rows], 300), key=str)
    for few in (0, sharding.FEW):   # directories joined by shuffle and by broadcast
        monkeypatch.setattr(sharding, "FEW", few)
        wide = docs.withColumn("shard", docs["text"])
        sharding.write_shards(wide, str(tmp_path / str(few)), limit=300)
        back = spark.read.schema("doc_id long, text string, shard string, shard_ string").parquet(str(tmp_path / str(few)))
        assert sorted(map(tuple, back.select("doc_id", "text", "shard").collect()), key=str) == sorted(
            [(i, t, t) for i, t in rows], key=str)
    assert sharding.shard_and_read(docs.limit(0), 300).count() == 0


def _bits(value: str) -> str:
    return f"{int(hashlib.md5(value.encode()).hexdigest()[:15], 16):060b}"


def _extendible(rows, limit):
    """Extendible hashing, one split at a time. Rows are (key, text)."""
    size = lambda part: sum(len((t or "").encode()) for _, t in part)
    out = []

    def split(part, bits, depth, name, ends):
        if size(part) <= limit or len(set(part)) == 1 or depth == 60:
            ends(part, name[:], depth)
            return
        for bit in "01":
            some = [r for r in part if bits(r)[depth] == bit]
            if some:
                split(some, bits, depth + 1, name + bit, ends)

    def place(part, name, depth):
        out.extend((i, len((t or "").encode()), name, depth, size(part), len(part)) for i, t in part)

    def inner(part, name, depth):
        if size(part) <= limit or len(part) == 1:
            place(part, name, depth)
            return

        def pages(some, bits, deep):
            if size(some) <= limit:
                place(some, f"{name}.{bits}", depth + deep)
                return
            per = max(1, limit // max(1, size(some[:1])))
            for k in range(0, len(some), per):
                place(some[k: k + per], f"{name}.{bits}#{k // per}", depth + deep)
        split(part, lambda r: _bits("n" if r[1] is None else "t" + r[1]), 0, "", pages)

    split(rows, lambda r: _bits("n" if r[0] is None else f"k{r[0]}"), 0, "", inner)
    return out


def _pages():
    rng = random.Random(9)
    long = ["é" * 60 + str(i) for i in range(5)]
    pages = [(i, rng.choice(["http://a.org/x", "https://B.a.org:8/?q=1", "http://c.de/é p"]),
              rng.choice([*long, "short", "", None])) for i in range(60)]
    return pages + [(70, None, long[0]), (3, "http://dup.org/", long[1]), (3, "http://dup.org/", long[1]), (71, "", "x" * 300_000)]


def test_archives_read_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc.write_index, "__defaults__", (3,))
    pages = _pages()
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    got = sorted(map(tuple, warc.archive_and_read(df).collect()), key=str)
    least = {}
    for i, _, html in pages:
        least[html or ""] = min(i, least.get(html or "", i))
    want = []
    for i, _, html in pages:
        body = (html or "").encode()
        again = len(body) >= 100 and least[html] != i
        want.append((i, len(body), reference.sha(html or ""), "revisit" if again else "response", least[html] if again else None))
    assert got == sorted(want, key=str)
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_lookup_gives_payload_and_nothing_for_unknown(spark):
    from taplight.llm.common import shared_folder
    pages = spark.createDataFrame(_pages(), "page_id long, url string, html string")
    folder = shared_folder(spark, "warc-test")
    top = warc.write_index(warc.write_archives(pages, folder), folder, 4)
    wanted = spark.createDataFrame([("", 71), ("http://dup.org/", 3), ("http://nowhere.org/", 3), (None, 70)],
                                   "url string, page_id long")
    got = warc.read_captures(wanted, folder, top, with_payload=True).collect()
    assert sorted((r["page_id"], r["url"]) for r in got if r["url"]) == [(3, "http://dup.org/")] * 2
    assert sorted(r["page_id"] for r in got) == [3, 3, 70, 71]
    assert {bytes(r["payload"]) for r in got if r["page_id"] == 71} == {b"x" * 300_000}


def test_pipeline_equals_plain_stages(spark):
    import base64
    import re

    import numpy as np
    import public_tokenizers
    import tiktoken

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, frame, SF).collect()}
    assert len(kept) >= 0.97 * len(docs)
    texts = {i: docs[i]["text"] for i in kept}
    _, root = reference.near_components(texts)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {(n, tuple(w[s: s + n])) for _, t in items for w in [reference.words(t)] for n in [min(10, len(w))]
               for s in range(len(w) - n + 1) if n}
    lengths = {n for n, _ in windows}
    clean = {}
    for i in kept:
        w = reference.words(texts[i])
        if root[i] == i and not any((n, tuple(w[s: s + n])) in windows for n in lengths for s in range(len(w) - n + 1)):
            text, cuts, end = texts[i], [], -1
            for a, _, _, b in reference.secrets(text):
                if a > end:
                    cuts.append([a, b])
                else:
                    cuts[-1][1] = max(cuts[-1][1], b)
                end = max(end, b)
            for a, b in reversed(cuts):
                text = text[:a] + "<SECRET>" + text[b:]
            clean[i] = text
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(
        public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, text in clean.items():
        ids = np.array(plain.encode_ordinary(text), "<u4")
        want[i] = (len(ids), __import__("hashlib").sha256(ids.tobytes()).hexdigest(), reference.sha(text))
    got = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, SF).collect()}
    random_found = {i for i in clean if i in got and got[i] != want[i]}
    assert got.keys() == want.keys() and not random_found and re
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secrets", "tokens"]
