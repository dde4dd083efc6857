"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every item is cut into windows of ten words. A document holds a window only if it holds all
of the window's words, so of the words ordered from rare to frequent (by their count over
all documents) a prefix of one is enough to find it: the window is joined where its rarest
word stands. The word's place gives the place of the whole window (positional bound), the
document's word count bounds it (length bound), and the words there are compared one by one.

The window table is broadcast in blocks of ``BLOCK_WINDOWS`` windows; more windows mean more
blocks, each matched against all documents. Documents are never shuffled: only counts of
benchmark words and the places of windows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, row_key, without_rows, written

WINDOW = 10
BLOCK_WINDOWS = 100_000
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the lower-cased text: runs of a-z, 0-9 and characters past ASCII. Null: none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), _BETWEEN), ""),
                      F.array().cast("array<string>"))


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``item_id, window, words, win``: each item's distinct windows; a shorter item is one window."""
    w = items.select("item_id", words_of(F.col("text")).alias("all_words")).where(
        F.size("all_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all_words") - (width - 1)))
    return w.select("item_id", "all_words", F.explode(starts).alias("at")).select(
        "item_id", F.slice("all_words", F.col("at"), F.lit(width)).alias("words")).select(
        "item_id", "words", F.md5(F.concat_ws(" ", "words")).alias("win")).distinct()


def window_places(docs: DataFrame, windows: DataFrame, blocks: int) -> DataFrame:
    """``doc_key, start, stop, win``: where windows stand in documents, in words from 0.

    ``docs`` has ``doc_key, words``; ``windows`` has ``win, words``, one row a window.
    """
    found = None
    for b in range(blocks):
        block = windows if blocks == 1 else windows.where(
            F.pmod(F.xxhash64("win"), F.lit(blocks)) == b)
        tokens = block.select("win", F.col("words").alias("win_words"),
                              F.posexplode("words").alias("offset", "token"))
        vocabulary = tokens.select("token").distinct()
        counts = docs.select(F.explode("words").alias("token")).join(
            F.broadcast(vocabulary), "token").groupBy("token").agg(F.count("*").alias("n"))
        rarest = Window.partitionBy("win").orderBy("n", "token", "offset")
        prefix = written(tokens.join(counts, "token").withColumn(
            "nth", F.row_number().over(rarest)).where("nth = 1").select(
            "win", "win_words", "offset", "token"), "prefixes")
        start = F.col("at") - F.col("offset")
        length = F.size("win_words")
        places = docs.select("doc_key", "words", F.posexplode("words").alias("at", "token")).join(
            F.broadcast(prefix), "token").where(
            (start >= 0) & (start + length <= F.size("words"))).where(
            F.slice("words", start + 1, length) == F.col("win_words")).select(
            "doc_key", start.alias("start"), (start + length).alias("stop"), "win")
        found = places if found is None else found.union(places)
    return found.distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, doc_key``.

    A word is hit when it lies in an occurrence of an item's window. ``items_sha256`` is over
    the sorted ids, comma-joined, of the items with occurring windows. Null and empty texts
    have no words; they, and empty tables on either side, give zeros and false. Items with a
    null id cause hits but are not counted; items that share an id count once. Repeated rows
    each get their result. Other columns are ignored. ``doc_key`` names a row by its values.
    """
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(
        "doc_id", row_key(F.col("doc_id"), F.col("text")).alias("doc_key"), words_of(F.col("text")).alias("words"))
    by_item = written(item_windows(items, width), "windows")
    windows = by_item.groupBy("win").agg(F.first("words").alias("words"))
    blocks = max(1, -(-windows.count() // block_windows))
    places = written(window_places(words, windows, blocks), "places")

    before = Window.partitionBy("doc_key").orderBy("start", "stop").rowsBetween(
        Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("reached", F.lit(0))))
    hits = places.select("doc_key", "start", "stop").distinct().withColumn(
        "reached", F.max("stop").over(before)).groupBy("doc_key").agg(F.sum(fresh).alias("n_hit"))
    ids = places.select("doc_key", "win").distinct().join(
        by_item.where("item_id is not null").select("win", F.col("item_id").cast("string").alias("item")),
        "win").select("doc_key", "item").distinct().groupBy("doc_key").agg(
        F.count("*").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item"))).alias("items"))
    found = hits.join(ids, "doc_key", "left").withColumnRenamed("doc_key", "k")
    return words.select("doc_id", "doc_key", F.size("words").cast("long").alias("n_words")).join(
        found, F.col("doc_key") == F.col("k"), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"), "doc_key")


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold an item's window; columns pass through."""
    key = "decontaminate_key_"
    found = written(contamination(docs, items, width).where("contaminated").select(
        "doc_key").distinct(), "contaminated")
    keyed = docs.withColumn(key, row_key(F.col("doc_id").cast("long"), F.col("text")))
    return without_rows(keyed, key, found).drop(key)
