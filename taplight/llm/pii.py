"""Personal data by bootstrapped contextual extraction.

Seeds are what fixed patterns find: e-mail and IP addresses, card and phone numbers. Every
seed, and every other token with a digit or an @, is a mention of an instance in a lexical
pattern: its two left words, or its left and right word. So is every run of two or more tokens
of digits, spaces, brackets and hyphens. A token over ``LONGEST_TOKEN`` (a URL, text without
spaces) is no instance as a whole; the identifier-shaped parts inside it are. Spark scores the pattern-instance graph in
``ROUNDS`` rounds. A pattern's confidence for a kind is the summed score of its instances of
that kind over its instances plus one, if at least ``LEAST_SEEDS`` of them are seeds; an unseen
instance of a fitting shape scores one minus the product of its patterns' doubts. Instances
over ``ACCEPT`` count for patterns in the next round. In the end the confident patterns'
mentions of accepted instances are reported as ``found_<kind>``, unless they lie inside longer ones.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"found_{k}" for k in BASE))
ROUNDS, LEAST_SEEDS, CONFIDENT, ACCEPT = 3, 3, 0.7, 0.8
LONGEST_TOKEN = 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"(?<![\w.@-])[+(]?[0-9](?:[\x20()-]*[0-9])*(?!\w)")
_PART = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]*[A-Za-z0-9]|(?<![0-9])\+?[0-9](?:[().-]*[0-9])*")
_WORDS = re.compile(r"\w+")
_EDGES = re.compile(r"^\W+|\W+$")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: from each @ the local part is read backwards."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, stop)`` of the fixed patterns' matches, sorted."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or "0") <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def _fits(value: str) -> int:
    """Bits of the kinds an unseen instance may belong to, by its shape."""
    digits = len(_DIGIT.findall(value))
    return (("@" in value) | (value.count(".") == 3 and digits >= 4) << 1 | (digits >= 12) << 2
            | (6 <= digits <= 15 and digits * 2 >= len(value)) << 3)


def _word(token: str) -> str:
    word = _EDGES.sub("", token.lower())
    return "#" if _DIGIT.search(word) else word or "."


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """``(start, stop, kind number or -1, fits, instance, [patterns])`` of the text's candidates."""
    if not _DIGIT.search(text) and "@" not in text and not spans:
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    out, nth = [], 0

    def patterns(first: int, last: int, start: int, stop: int) -> list[str]:
        left = [_word(text[slice(*tokens[i])]) if i >= 0 else "^" for i in (first - 2, first - 1)]
        right = _word(text[slice(*tokens[last + 1])]) if last + 1 < len(tokens) else "$"
        if tokens[first][1] - tokens[first][0] > LONGEST_TOKEN:
            inside = _WORDS.findall(text, max(tokens[first][0], start - LONGEST_TOKEN), start)
            left = [*left, *map(_word, inside)][-2:]
        if tokens[last][1] - tokens[last][0] > LONGEST_TOKEN:
            m = _WORDS.search(text, stop, min(tokens[last][1], stop + LONGEST_TOKEN))
            right = _word(m.group()) if m else right
        return [f"{left[0]} {left[1]} _", f"{left[1]} _ {right}"]

    def add(first: int, last: int, start: int, stop: int) -> None:
        fits = _fits(text[start:stop])
        if fits:
            out.append((start, stop, -1, fits, text[start:stop].lower(), patterns(first, last, start, stop)))

    taken: set[int] = set()
    for start, kind, stop in spans:
        while nth and tokens[nth][0] > start:
            nth -= 1
        while tokens[nth][1] <= start:
            nth += 1
        last = nth
        while last + 1 < len(tokens) and tokens[last + 1][0] < stop:
            last += 1
        taken.update(range(nth, last + 1))
        out.append((start, stop, kind, 0, text[start:stop].lower(), patterns(nth, last, start, stop)))
    starts = [a for a, _, _ in spans]
    ends = list(accumulate((b for _, _, b in spans), max))

    def free(start: int, stop: int) -> bool:
        """No seed overlaps the place."""
        before = bisect_left(starts, stop)
        return not before or ends[before - 1] <= start

    for i, (a, b) in enumerate(tokens):
        if b - a > LONGEST_TOKEN:
            for m in _PART.finditer(text, a, b):
                if free(*m.span()):
                    add(i, i, *m.span())
            continue
        if i in taken or not (_DIGIT.search(text, a, b) or text.find("@", a, b) >= 0):
            continue
        token = text[a:b]
        lead = len(token) - len(token.lstrip("\"'([{<,;:.!?*#%$&|"))
        value = token[lead:].rstrip("\"')]}>,;:.!?*#%$&|")
        add(i, i, a + lead, a + lead + len(value))
    at = [a for a, _ in tokens]
    for m in _RUN.finditer(text):
        first, last = bisect_right(at, m.start()) - 1, bisect_right(at, m.end() - 1) - 1
        if first != last and free(*m.span()):
            add(first, last, *m.span())
    return out


_ROW = ("doc_id long, doc_key string, spans array<struct<start:int,nth:int,stop:int>>, mentions array<struct<"
        "start:int,stop:int,kind:int,fits:int,instance:string,patterns:array<string>>>")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    i32 = pa.int32()
    span = pa.struct([("start", i32), ("nth", i32), ("stop", i32)])
    mention = pa.struct([("start", i32), ("stop", i32), ("kind", i32), ("fits", i32), ("instance", pa.string()),
                         ("patterns", pa.list_(pa.string()))])
    for batch in batches:
        spans, found = [], []
        for value in batch.column(2):
            text = value.as_py() or ""
            spans.append(base_spans(text))
            found.append(mentions(text, spans[-1]))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1),
            pa.array([[dict(zip(("start", "nth", "stop"), s)) for s in row] for row in spans], pa.list_(span)),
            pa.array([[dict(zip([f.name for f in mention], m)) for m in row] for row in found], pa.list_(mention))],
            names=["doc_id", "doc_key", "spans", "mentions"])


def _score(mentioned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pattern, kind, confidence)`` and ``(instance, kind, score)`` after the rounds."""
    edges = written(mentioned.select("pattern", "instance").distinct(), "edges")
    shapes = written(mentioned.groupBy("instance").agg(
        F.max("fits").alias("fits"), F.max("kind").alias("kind")), "instances")
    seeds = written(mentioned.where("kind >= 0").select(
        "instance", "kind", F.lit(1.0).alias("score"), F.lit(1).alias("seed")).distinct(), "seeds")
    sizes = written(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(
        F.col("n") >= LEAST_SEEDS), "patterns")
    unseen = shapes.where("kind < 0").select("instance", "fits")
    scores, trusted = seeds, None
    for _ in range(ROUNDS):
        support = edges.join(scores, "instance").groupBy("pattern", "kind").agg(
            F.sum("score").alias("sum"), F.sum("seed").alias("seeds")).where(F.col("seeds") >= LEAST_SEEDS)
        trusted = written(support.join(sizes, "pattern").withColumn(
            "confidence", F.col("sum") / (F.col("n") + 1)).where(F.col("confidence") >= CONFIDENT).select(
            "pattern", "kind", "confidence"), "trusted")
        reached = edges.join(trusted, "pattern").join(unseen, "instance").where(
            F.expr("(shiftright(fits, kind) & 1) = 1")).groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score")).where(F.col("score") >= ACCEPT)
        best = reached.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b")).select(
            "instance", (-F.col("b.k")).alias("kind"), F.col("b.score").alias("score"), F.lit(0).alias("seed"))
        scores = written(seeds.union(best), "scores")
    return trusted, scores


def _named(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["nth"] + 1), s["start"], s["stop"])))


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256,
    spans, n_found``.

    ``spans`` lists kind:start:stop in code points by start, then kind, comma-joined, and
    ``base_sha256`` hashes the list of the four fixed kinds. Null text counts as empty: zeros
    and empty lists. Repeated rows each get their result and weigh no more than one, since the
    graph has each pattern and instance pair once. Other columns are ignored.
    """
    rows = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("doc_key"),
        "text").mapInArrow(_extract, _ROW), "mentions")
    flat = rows.select("doc_key", F.explode("mentions").alias("m")).select("doc_key", "m.*").withColumn(
        "pattern", F.explode("patterns")).drop("patterns")
    trusted, scores = _score(flat)
    found = flat.where("kind < 0").drop("kind").join(trusted, "pattern").join(
        scores.where("seed = 0").select("instance", "kind"), ["instance", "kind"]).select(
        "doc_key", "start", (F.col("kind") + len(BASE)).alias("nth"), "stop").distinct()
    line = Window.partitionBy("doc_key").orderBy("start", F.col("stop").desc())
    found = found.withColumn("reach_", F.max("stop").over(line.rowsBetween(
        Window.unboundedPreceding, -1))).where("reach_ is null or reach_ < stop").groupBy("doc_key").agg(
        F.collect_list(F.struct("start", "nth", "stop")).alias("more")).withColumnRenamed("doc_key", "k")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.nth = {i})) as long)").alias(f"n_{k}")
              for i, k in enumerate(BASE)]
    return rows.select("doc_id", "doc_key", "spans").join(found, F.col("doc_key") == F.col("k"), "left").select(
        "doc_id", *counts, F.sha2(_named(F.col("spans")), 256).alias("base_sha256"),
        _named(F.array_sort(F.when(F.col("more").isNull(), F.col("spans")).otherwise(
            F.concat("spans", "more")))).alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_found"))
