"""The language model's sample and predictions against plain Python."""

import random
import zlib

import pyarrow as pa
import regex
import xxhash
import zstandard

from taplight.llm import language

SCHEMA = "doc_id long, text string, lang string, h long, k string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA)


def _hash(doc_id, text):
    """The session's 64-bit hash of id and text."""
    seed = 42 if doc_id is None else xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42)
    h = xxhash.xxh64_intdigest(text.encode(), seed)
    return h - (h >> 63 << 64)


def _letters(text):
    return regex.sub(r"[^\p{L}]+", " ", text.lower()).strip().encode()


def _dictionaries(rows, size, most, part):
    out = {}
    for lang in {r[2] for r in rows if r[2] is not None}:
        texts, used = [], 0
        found = {(_hash(i, t), t) for i, t, n in rows if n == lang and t}
        for h, text in sorted(found, key=lambda f: (f[0] % 2**30, f[0]))[:most]:
            if used < size:
                at = h % (len(text) - part + 1) if len(text) > part else 0
                texts.append(_letters(text[at: at + part]))
                used += min(len(text.encode()), part)
        if any(texts):
            out[lang] = b" ".join(texts)[:size]
    return out


def _word(rng, letters):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9)))


def _rows(rng):
    spoken = {"aa": "abcdé", "bb": "defgh", "cc": "ghiß!", "dd": "ijk1l"}
    rows = []
    for i in range(160):
        lang = rng.choice(list(spoken))
        rows.append((i, " ".join(_word(rng, spoken[lang]) for _ in range(rng.choice([1, 3, 40, 3000]))), lang))
    return rows + [rows[3]] * 5 + [(None, "abba deda", "aa"), (500, None, "aa"), (501, "", "bb"), (502, "hi gih", None), (503, "12 !?", "cc")]


def test_sample_equals_plain_python(spark):
    rows = _rows(random.Random(1))
    for size, most, part in ((65536, 400, 4096), (3000, 400, 100), (65536, 7, 50)):
        got = language.dictionaries(_docs(spark, rows), size, most, part)
        assert got == _dictionaries(rows, size, most, part)


def test_predictions_equal_a_plain_loop(spark):
    rows = _rows(random.Random(2))
    held = {i for i, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    content = _dictionaries([r for r in rows if r[0] not in held], 65536, 400, 4096)
    packers = {}
    for lang, text in content.items():
        made = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=language.LEVEL)
        packers[lang] = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=made, write_content_size=False,
                                                 write_checksum=False, write_dict_id=False)
    want = []
    for i, text, _ in rows:
        raw = _letters(text or "")
        if not raw:
            want.append((i, i in held, "und", 0.0, True))
            continue
        sizes = {n: sum(len(p.compress(b" " * 48 + raw[k: k + 4096])) for k in range(0, len(raw), 4096))
                 for n, p in packers.items()}
        best = min(sorted(sizes), key=sizes.get)
        second = min(v for n, v in sizes.items() if n != best)
        score = 1 / sum(2.0 ** -min(200.0, (v - sizes[best]) / 2) for v in sizes.values())
        want.append((i, i in held, best, round(score, 9), (second - sizes[best]) / second < language.MARGIN))
    got = [(r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9), r["rejected"])
           for r in language.identify_documents(_docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_long_texts_crowd_nothing_out(spark):
    rows = [(i, f"short{chr(97 + i % 26)} words", "en") for i in range(50)] + [(100 + i, "long " * 30_000, "en") for i in range(3)]
    content = language.dictionaries(_docs(spark, rows))["en"]
    assert all(f"short{chr(97 + i)}".encode() in content for i in range(26)) and b"long" in content


def test_one_id_with_many_rows_is_learned(spark):
    rows = [(7, f"words of one id {chr(97 + i % 26) * (1 + i // 26)}", "en") for i in range(2000)] + [(8, "andere sprache", "de")]
    assert set(language.dictionaries(_docs(spark, rows))) == {"de", "en"}


def test_copies_are_collected_once(spark, monkeypatch):
    seen = []
    collect = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: seen.append(collect(df)) or seen[-1])
    docs = _docs(spark, [(1, "one text that is copied", "en")] * 3000 + [(2, "ein anderer text", "de")])
    assert language.dictionaries(docs)["en"] == b"one text that is copied"
    assert max(map(len, seen)) <= 2
    assert language.dictionaries(docs.where("lang is null")) == {}


def test_sample_is_taken_without_python_workers(monkeypatch, spark):
    docs = spark.sql("SELECT id AS doc_id, concat('word ', id) AS text, 'aa' AS lang FROM range(50)")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: 1 / 0)
    assert set(language.dictionaries(docs)) == {"aa"}
    assert language.dictionaries(docs.where("lang is null")) == {}


def test_texts_are_judged_a_few_at_a_time():
    class Shipped:
        value = {"aa": b"abba deda " * 50, "bb": b"figh hif " * 50}

    batch = pa.RecordBatch.from_pydict({"c0": list(range(1201)), "t": ["abba deda"] * 1200 + [None]})
    parts = list(language._classify(Shipped, 0.0, 1, 1)(iter([batch])))
    assert [p.num_rows for p in parts] == [500, 500, 201]
    assert [n for p in parts for n in p.column(0).to_pylist()] == list(range(1201))
    assert [n for p in parts for n in p.column(1).to_pylist()] == ["aa"] * 1200 + ["und"]
