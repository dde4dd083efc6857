"""Shards of bounded size by extendible hashing, in DataFrame operations only.

A row's key is hashed to 60 bits. A bucket is a prefix of those bits; one that is over the
byte limit splits on the next bit, the others stay. Rather than one pass over the rows a bit,
a round looks ``STEP`` bits ahead: it counts the rows of oversized buckets by their next bits,
which gives the sizes of all prefixes in between, and only what is still oversized goes into
the next round. The leaves are the directory; a row finds its leaf through the local depths
that occur below its first ``STEP`` bits.

Rows with one key share all 60 bits, so a key over the limit splits further on 60 bits of a
content hash. Rows equal in both are interchangeable: they are counted, and their count is cut
into pages that fit. A single row over the limit is a shard of its own.

Writing looks each row up in the directory, which has a row a shard, and sends it to its shard:
one shuffle of whole rows. Only rows on pages are numbered first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, written

BITS, STEP = 60, 10
LIMIT_BYTES = 128 << 20
#: Directories of so many rows at most (some 50 bytes each) are sent to every task.
FEW = 300_000


def hash_bits(value: Column) -> Column:
    """The first 60 bits of the value's MD5."""
    return F.conv(F.substring(F.md5(value), 1, BITS // 4), 16, 10).cast("long")


def _prefix(word: Column, depth) -> Column:
    return F.call_function("shiftright", word, (F.lit(BITS) - depth).cast("int"))


def _leaves(rows: DataFrame, limit: int) -> DataFrame:
    """``grp, depth, prefix, shard_bytes, shard_rows, kinds`` of the buckets that end splitting.

    ``rows`` has ``grp, word, bytes, copies``, one row a distinct row. A bucket ends when it
    fits, holds one distinct row, or has no bit left.
    """
    active, found = None, None
    for base in range(0, BITS, STEP):
        left = rows if active is None else rows.join(active.select(
            F.col("grp").alias("g"), F.col("prefix").alias("p")),
            (F.col("grp") == F.col("g")) & (_prefix(F.col("word"), F.lit(base)) == F.col("p")), "left_semi")
        fine = left.groupBy("grp", _prefix(F.col("word"), F.lit(base + STEP)).alias("bits")).agg(
            F.sum(F.col("bytes") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"),
            F.count("*").alias("kinds"))
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(base + STEP)))).groupBy(
            "grp", "depth", F.call_function("shiftright", F.col("bits"), (
                F.lit(base + STEP) - F.col("depth")).cast("int")).alias("prefix")).agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"), F.sum("kinds").alias("kinds"))
        levels = written(levels.withColumn("ends", (F.col("shard_bytes") <= limit) | (F.col("kinds") == 1)), "levels")
        over = levels.where("not ends").select(F.col("grp").alias("g"), (F.col("depth") + 1).alias("d"),
                                               F.col("prefix").alias("p"))
        ends = levels.where(F.col("ends") & (F.col("depth") > base if base else F.col("depth") >= 0))
        first = ends.where("depth = 0") if not base else None
        parted = ends.where("depth > 0").join(over, (F.col("grp") == F.col("g")) & (F.col("depth") == F.col("d")) & (
            F.call_function("shiftright", F.col("prefix"), F.lit(1)) == F.col("p")), "left_semi")
        part = parted if first is None else first.union(parted)
        active = levels.where((F.col("depth") == base + STEP) & ~F.col("ends"))
        if base + STEP == BITS:
            part = part.union(active)
        part = part.drop("ends")
        found = part if found is None else found.union(part)
        if active.isEmpty():
            break
    return written(found, "leaves")


def _find(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """``rows`` with the columns of their leaf."""
    near = leaves.select("grp", "depth", "prefix").withColumn("top", F.explode(F.when(
        F.col("depth") >= STEP, F.array(F.call_function("shiftright", F.col("prefix"), (
            F.greatest(F.col("depth"), F.lit(STEP)) - STEP).cast("int")))).otherwise(F.sequence(
                F.expr(f"shiftleft(prefix, {STEP} - least(depth, {STEP}))"),
                F.expr(f"shiftleft(prefix + 1, {STEP} - least(depth, {STEP})) - 1")))))
    depths = written(near.groupBy("grp", "top").agg(F.collect_set("depth").alias("depths")), "directory").select(
        F.col("grp").alias("g"), "top", "depths")
    tried = rows.join(depths, (F.col("grp") == F.col("g")) & (
        _prefix(F.col("word"), F.lit(STEP)) == F.col("top"))).withColumn("d", F.explode("depths")).drop(
        "g", "top", "depths").withColumn("p", _prefix(F.col("word"), F.col("d")))
    leaf = leaves.withColumnRenamed("grp", "g")
    return tried.join(leaf, (F.col("grp") == F.col("g")) & (F.col("d") == F.col("depth")) & (
        F.col("p") == F.col("prefix"))).drop("g", "d", "p")


def _name(depth: Column, prefix: Column) -> Column:
    return F.when(depth == 0, "").otherwise(F.lpad(F.conv(prefix.cast("string"), 10, 2), depth, "0"))


def _key_word(key: str) -> Column:
    return hash_bits(F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n")))


def _content_word(content: str) -> Column:
    return hash_bits(F.coalesce(F.concat(F.lit("t"), F.col(content)), F.lit("n")))


def _size(content: str) -> Column:
    return F.coalesce(F.octet_length(content), F.lit(0)).cast("long")


def _directory(docs: DataFrame, key: str, content: str, limit: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """The leaves, the distinct rows in those that end there, the rows of hot keys, and the
    leaves by content hash of the latter, if there are any."""
    rows = docs.select(F.col(key).alias("k"), _size(content).alias("bytes"), _key_word(key).alias("word"),
                       _content_word(content).alias("inner")).groupBy(
        "k", "bytes", "word", "inner").agg(F.count("*").alias("copies"))
    rows = written(rows.withColumn("grp", F.lit(0).cast("long")), "rows")
    leaves = _leaves(rows, limit)
    placed = written(_find(rows, leaves).withColumn("shard", _name(F.col("depth"), F.col("prefix"))), "placed")
    whole = (F.col("shard_bytes") <= limit) | ((F.col("kinds") == 1) & (F.col("copies") == 1))
    hot = placed.where(~whole).select("k", "bytes", "copies", "inner", F.col("word").alias("grp"), F.col("inner").alias("word"),
                                      F.col("depth").alias("outer_depth"), F.col("shard").alias("outer"))
    return leaves, placed.where(whole), hot, None if hot.isEmpty() else _leaves(hot, limit)


def _per_page(limit: int, n_bytes: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), n_bytes)))


def assign_shards(docs: DataFrame, key: str = "doc_id", content: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """Per row: the key, ``n_bytes, shard, shard_depth, shard_bytes, shard_rows``.

    A row's bytes are the UTF-8 length of ``content``; null counts as 0 and a null key as a
    key of its own. ``shard`` is the bucket's bit prefix; buckets of one key add ``.`` and bits
    of the content hash, pages of equal rows add ``#`` and a number. No shard exceeds ``limit``
    unless it is one single row. Equal rows are dealt out to pages in any order, as they can't
    be told apart. Other columns are ignored; an empty table gives no rows.
    """
    _, done, hot, inner = _directory(docs, key, content, limit)
    out = ["k", "bytes", "shard", "depth", "shard_bytes", "shard_rows"]
    result = done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*out)
    if inner is not None:
        split = _find(hot, inner).withColumn("depth", F.col("depth") + F.col("outer_depth")).withColumn(
            "shard", F.concat("outer", F.lit("."), _name(F.col("depth") - F.col("outer_depth"), F.col("prefix"))))
        paged = split.withColumn("per", F.when(F.col("shard_bytes") <= limit, F.col("copies")).otherwise(
            _per_page(limit, F.col("bytes")))).withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(
                F.col("copies") / F.col("per")) - 1))).withColumn(
            "here", F.least(F.col("per"), F.col("copies") - F.col("page") * F.col("per")))
        cut = F.col("shard_bytes") > limit
        paged = paged.repartition("grp", "word", "page").select(
            "k", "bytes", F.when(cut, F.concat("shard", F.lit("#"), "page")).otherwise(F.col("shard")).alias("shard"),
            "depth", F.when(cut, F.col("bytes") * F.col("here")).otherwise(F.col("shard_bytes")).alias("shard_bytes"),
            F.when(cut, F.col("here")).otherwise(F.col("shard_rows")).alias("shard_rows"),
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("here"))).alias("copy"))
        result = result.union(paged.select(*out))
    return result.select(F.col("k").alias(key), F.col("bytes").alias("n_bytes"), "shard", F.col("depth").cast(
        "long").alias("shard_depth"), "shard_bytes", "shard_rows")


def _numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``nth_``, a number from 0 among the rows equal in ``by``, which are not null.

    Rows are numbered by partition and place, so no group has to meet in one task.
    """
    placed = written(rows.withColumn("part_", F.spark_partition_id()).withColumn(
        "id_", F.monotonically_increasing_id()), "numbered")
    part = placed.groupBy(*by, "part_").agg(F.count("*").alias("n_"))
    before = part.withColumn("before_", F.coalesce(F.sum("n_").over(Window.partitionBy(*by).orderBy(
        "part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    inside = Window.partitionBy(*by, "part_").orderBy("id_")
    return placed.withColumn("in_", F.row_number().over(inside)).join(before, [*by, "part_"]).withColumn(
        "nth_", F.col("before_") + F.col("in_") - 1).drop("part_", "id_", "in_", "before_")


def _cells(leaves: DataFrame, bits: Column) -> DataFrame:
    """``leaves`` a row for each prefix of ``bits`` bits (``cell``) that they cover or lie in, with
    the range of words from ``lo`` to below ``hi``."""
    deeper = (F.greatest(F.col("depth"), bits) - bits).cast("int")
    wider = (bits - F.least(F.col("depth"), bits)).cast("int")
    free = (F.lit(BITS) - F.col("depth")).cast("int")
    left = lambda word, n: F.call_function("shiftleft", word, n)
    cells = F.when(wider > 0, F.sequence(left(F.col("prefix"), wider), left(F.col("prefix") + 1, wider) - 1)).otherwise(
        F.array(F.call_function("shiftright", F.col("prefix"), deeper)))
    return leaves.withColumns({"cell": F.explode(cells), "lo": left(F.col("prefix"), free),
                               "hi": left(F.col("prefix") + 1, free)})


def _sent(leaves: DataFrame) -> DataFrame:
    """To be broadcast where it is small; else Spark joins it by a shuffle of the rows."""
    return F.broadcast(leaves) if leaves.count() <= FEW else leaves


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", content: str = "text", limit: int = LIMIT_BYTES) -> None:
    """Writes the rows of ``docs`` to the shards that ``assign_shards`` names, each one Parquet file
    below ``path/shard=...``, every row with all its columns once.

    If ``docs`` has a column ``shard``, the folders are named ``shard_=...``. Equal rows take
    their pages in any order.
    """
    leaves, _, hot, inner = _directory(docs, key, content, limit)
    rows = docs.select(F.struct(*docs.columns).alias("row_"), _key_word(key).alias("word_"), _content_word(content).alias(
        "inner_"), _size(content).alias("bytes_"))
    bits = F.lit(leaves.count().bit_length())
    outer = _cells(leaves, bits).select("cell", "lo", "hi", _name(F.col("depth"), F.col("prefix")).alias("shard"),
                                        "depth", "prefix")
    if inner is None:
        outer = outer.withColumn("grp", F.lit(None).cast("long"))
    else:
        heads = hot.select("grp", "outer_depth").distinct().select("grp", F.col("outer_depth").alias("d"), _prefix(
            F.col("grp"), F.col("outer_depth")).alias("p"))
        outer = outer.join(heads, (F.col("depth") == F.col("d")) & (F.col("prefix") == F.col("p")), "left").drop("d", "p")
    outer = written(outer.drop("depth", "prefix"), "outer")
    found = rows.join(_sent(outer), (_prefix(F.col("word_"), bits) == F.col("cell")) & (F.col("word_") >= F.col("lo")) & (
        F.col("word_") < F.col("hi"))).drop("cell", "lo", "hi")
    sent = found.where("grp is null").select("row_", "shard")
    if inner is not None:
        width = inner.groupBy("grp").agg(F.ceil(F.log2(F.count("*") + 1)).cast("int").alias("bits"))
        parts = written(_cells(inner.join(width, "grp"), F.col("bits")).select(
            F.col("grp").alias("g"), "bits", "cell", "lo", "hi", _name(F.col("depth"), F.col("prefix")).alias("inside"),
            (F.col("shard_bytes") > limit).alias("paged")), "inner")
        wide = parts.select(F.col("g").alias("w"), "bits").distinct()
        deep = found.where("grp is not null").join(_sent(wide), F.col("grp") == F.col("w")).withColumn(
            "at_", _prefix(F.col("inner_"), F.col("bits"))).drop("w", "bits")
        deep = deep.join(_sent(parts.drop("bits")), (F.col("grp") == F.col("g")) & (F.col("at_") == F.col("cell")) & (
            F.col("inner_") >= F.col("lo")) & (F.col("inner_") < F.col("hi"))).withColumn(
            "shard", F.concat("shard", F.lit("."), "inside"))
        sent = sent.union(deep.where("not paged").select("row_", "shard"))
        if not parts.where("paged").isEmpty():
            page = F.floor(F.col("nth_") / _per_page(limit, F.col("bytes_"))).cast("long")
            paged = _numbered(deep.where("paged").select("row_", "shard", "word_", "inner_", "bytes_"), [
                "word_", "inner_", "bytes_"])
            sent = sent.union(paged.select("row_", F.concat("shard", F.lit("#"), page).alias("shard")))
    name = "shard"
    while name in docs.columns:
        name += "_"
    sent.withColumnRenamed("shard", name).repartition(name).select("row_.*", name).write.partitionBy(name).parquet(path)


def shard_and_read(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """The columns of ``assign_shards`` for ``docs(doc_id, text)``, counted in the written shards."""
    path = shared_folder(docs.sparkSession, "shards")
    rows = docs.select("doc_id", "text")
    write_shards(rows, path, limit=limit)
    # The schema keeps shard names such as 0101 from being read as numbers; the empty name comes as null.
    back = docs.sparkSession.read.schema(f"{rows.schema['doc_id'].simpleString().replace(':', ' ')}, text string, shard string"
                                         ).parquet(path).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(
                                             0)).cast("long").alias("n_bytes"), F.coalesce("shard", F.lit("")).alias("shard"))
    sums = back.groupBy(F.col("shard").alias("s_")).agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    bits = F.regexp_replace(F.regexp_replace("shard", "#.*", ""), "[.]", "")
    return back.join(sums, F.col("shard") == F.col("s_")).select(
        "doc_id", "n_bytes", "shard", F.char_length(bits).cast("long").alias("shard_depth"), "shard_bytes", "shard_rows")
