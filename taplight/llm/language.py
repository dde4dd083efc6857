"""Language identification by compression with per-language dictionaries.

A language's dictionary is raw content for zstandard: distinct training texts of that language
in the order of a hash of id and text, up to ``DICTIONARY_BYTES``. A text of more than ``PART``
characters gives one window of that size, at a place that its hash picks, so that no text
crowds out the others. That sample is the model's only bound; predictions read whole texts.
Texts and dictionaries are
reduced to lower-case letters and single spaces, so that case and junk symbols don't count. A
text is cut into chunks of ``CHUNK`` bytes; every chunk is compressed with each dictionary,
and the language with the fewest bytes over all chunks wins. A margin below ``MARGIN`` of the
runner-up's bytes counts as a rejection. Each chunk starts with a run of spaces, since
zstandard stores blocks that it can hardly shorten as they are, which would make languages
tie on a few words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, parted

DICTIONARY_BYTES = 64 * 1024
SAMPLE_ROWS = 400
PART = 4096
CHUNK = 4096
LEVEL = 6
MARGIN = 0.002
UNKNOWN = "und"
FIELDS = ("lang_pred", "score", "margin", "rejected")
_LEAD = b" " * 48
_OTHER = regex.compile(r"[^\p{L}]+")


def letters(text: str | None) -> bytes:
    """The text's letters in lower case, each run of other characters as one space."""
    return _OTHER.sub(" ", (text or "").lower()).strip().encode()


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training, by its id. A null id is never held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def dictionaries(training: DataFrame, size: int = DICTIONARY_BYTES, rows: int = SAMPLE_ROWS,
                 part: int = PART) -> dict[str, bytes]:
    """Dictionary content per language from ``training(doc_id, text, lang)``.

    Rows with null lang or text, or empty text, are left out; equal rows count as one. About
    ``4 * rows`` hashes and at most ``rows`` windows of ``part`` characters a language reach the
    driver, whatever the table holds. Texts are not shuffled: rows are thinned where they are read.
    """
    usable = training.where("lang is not null and text is not null and text != ''").select(
        "lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    distinct = usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not distinct:
        return {}
    # Hashes below a share that holds four times the rows wanted; all rows of a rare language.
    share = F.create_map(*[F.lit(x) for r in distinct for x in (r["lang"], min(1.0, 4 * rows / max(1, r["n"])))])
    place = F.pmod(F.col("h"), F.lit(1 << 30))
    order = Window.partitionBy("lang").orderBy(place, "h")
    keys = usable.where(place <= share[F.col("lang")] * (1 << 30)).groupBy("lang", "h").agg(F.max(F.least(
        F.octet_length("text"), F.lit(part))).alias("n")).withColumn("before", F.sum("n").over(
            order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).withColumn(
        "nth", F.row_number().over(order)).where((F.col("nth") <= rows) & (F.col("before") < size))
    chosen = [(r["lang"], r["h"]) for r in keys.select("lang", "h").collect()]
    # From Arrow: a list would go through Python workers of another kind, which then stand idle beside these.
    wanted = training.sparkSession.createDataFrame(pa.table({
        "l": pa.array([lang for lang, _ in chosen], pa.string()), "k": pa.array([h for _, h in chosen], pa.int64())}))
    length = F.char_length("text")
    window = F.substring(F.col("text"), F.when(length > part, F.pmod(F.col("h"), length - part + 1) + 1).otherwise(
        1).cast("int"), F.lit(part))
    texts = usable.join(F.broadcast(wanted), (F.col("lang") == F.col("l")) & (F.col("h") == F.col("k"))).groupBy(
        "lang", "h").agg(F.max(window).alias("text")).collect()
    content: dict[str, list[bytes]] = {r["lang"]: [] for r in distinct}
    for lang, _, text in sorted(texts, key=lambda r: (r[0], r[1] % (1 << 30), r[1])):
        content[lang].append(letters(text))
    return {lang: b" ".join(some)[:size] for lang, some in content.items() if any(some)}


def _classify(shipped, margin: float, at: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = shipped.value
        langs = sorted(content)
        packers = []
        for lang in langs:
            made = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))
        for batch in parted(batches):
            pred, score, lead, out = [], [], [], []
            for value in batch.column(at):
                raw = letters(value.as_py())
                if not packers or not raw:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    lead.append(0.0)
                    out.append(True)
                    continue
                parts = [_LEAD + raw[i: i + CHUNK] for i in range(0, len(raw), CHUNK)]
                sizes = [sum(len(p.compress(x)) for x in parts) for p in packers]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                rest = sizes[:best] + sizes[best + 1:]
                ahead = (min(rest) - sizes[best]) / min(rest) if rest else 1.0
                pred.append(langs[best])
                lead.append(ahead)
                score.append(1 / sum(2.0 ** -min(200.0, (s - sizes[best]) / 2) for s in sizes))
                out.append(ahead < margin)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                 pa.array(lead, pa.float64()), pa.array(out, pa.bool_())],
                names=[*batch.schema.names[:width], *FIELDS])
    return run


def identify(docs: DataFrame, content: dict[str, bytes], keep: list[str], margin: float = MARGIN) -> DataFrame:
    """The columns ``keep`` of each row and a struct ``language_`` for its whole text, with
    fields ``lang_pred, score, margin, rejected``.

    ``lang_pred`` is a language of ``content``, the first by name on equal sizes, or ``und``
    where the text is null or has no letter, or no language was learned. ``score`` is 1 for a
    clear winner and 1/n when n languages tie; ``margin`` is the lead over the runner-up as a
    share of its bytes. ``rejected`` marks ``und`` and narrow margins, ties among them. Rows
    are independent and pass without a shuffle.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(content)
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)],
                       *([] if "text" in keep else [F.col("text").alias("t")]))
    at = keep.index("text") if "text" in keep else len(keep)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names),
                        "lang_pred string, score double, margin double, rejected boolean"])
    return rows.mapInArrow(lean(_classify(shipped, margin, at, len(keep))), schema).select(
        *[F.col(n).alias(c) for c, n in zip(keep, names)], F.struct(*FIELDS).alias("language_"))


def identify_documents(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Learns from rows of ``docs(doc_id, text, lang)`` that are not held out, and predicts
    every row: ``doc_id, held_out, lang_pred, score, margin, rejected``.

    Null texts, empty ones and those without a letter give ``und`` with score 0. A null lang or
    id trains nothing or as any other. Repeated rows train once and each get their result;
    other columns are ignored; an empty table, or one without labels, learns nothing. Long
    texts are compressed whole, chunk by chunk.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    content = dictionaries(rows.where(~held_out(F.col("doc_id"))))
    return identify(rows, content, ["doc_id"], margin).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "language_.*")


def keep_identified(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """``docs`` without the rows whose language is rejected; a null ``lang`` becomes the
    predicted one. Learns as ``identify_documents`` does; the other columns pass through."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    content = dictionaries(rows.where(~held_out(F.col("doc_id"))))
    judged = identify(docs, content, docs.columns, margin).where("not language_.rejected")
    return judged.withColumn("lang", F.coalesce("lang", "language_.lang_pred")).drop("language_")
