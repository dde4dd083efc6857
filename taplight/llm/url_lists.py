"""URL filters as a temporal join: captures against the list entries active when fetched.

Dated add and remove entries become validity intervals [from, to) per list and key. A key is
a host, every host below it included (``d:example.com``), or a host with leading path segments
(``p:example.com/a/b``). A capture looks up all keys of its URL, from the whole host down to
its last two labels and along its path, at its fetch time.

Both sides are cut by time bucket: an interval is listed in each bucket it touches up to the
last fetch, a capture in its own, so a busy host's captures and a busy key's history spread
over buckets and the as-of condition only compares rows of one key and bucket. Intervals are
formed inside buckets too; a bucket takes over the last action of the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, written

BUCKET_SECONDS = 30 * 86400


def url_host(url: Column) -> Column:
    """Lower-case host without user and port; empty where the URL has none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_keys(url: Column) -> Column:
    """All keys under which an entry may name the URL; none without a host."""
    host = url_host(url)
    labels = F.split(host, "\\.")
    steps = F.filter(F.split(url_path(url), "/"), lambda s: s != "")
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.concat(
        F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    paths = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(
        F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))).otherwise(
        F.array().cast("array<string>"))
    return F.when(F.coalesce(host, F.lit("")) != "", F.array_distinct(F.concat(hosts, paths))).otherwise(
        F.array().cast("array<string>"))


def validity_intervals(entries: DataFrame, bucket: int = BUCKET_SECONDS) -> DataFrame:
    """``list_name, key, valid_from, valid_to`` from ``entries(list_name, key, action, at)``.

    ``at`` is in epoch seconds; ``action`` is ``add`` or ``remove``. Of actions at one time
    remove wins; repeated adds or removes change nothing; an interval without a later remove
    has a null end. Rows with a null in a used column, or another action, are left out.
    """
    clean = entries.where(F.col("action").isin("add", "remove") & F.col("at").isNotNull()).groupBy(
        "list_name", "key", F.col("at").cast("long").alias("at")).agg(F.max("action").alias("action")).where(
        "list_name is not null and key is not null").withColumn("b", F.floor(F.col("at") / bucket))
    clean = written(clean, "entries")
    keys = ["list_name", "key"]
    inside = Window.partitionBy(*keys, "b").orderBy("at")
    across = Window.partitionBy(*keys).orderBy("b")
    carried = clean.groupBy(*keys, "b").agg(F.max_by("action", "at").alias("last")).withColumn(
        "before", F.lag("last").over(across)).drop("last")
    changes = written(clean.join(carried, [*keys, "b"]).withColumn("before", F.coalesce(
        F.lag("action").over(inside), "before", F.lit("remove"))).where("action != before").drop("before"), "changes")
    later = changes.groupBy(*keys, "b").agg(F.min("at").alias("first")).withColumn(
        "later", F.lead("first").over(across)).drop("first")
    return changes.join(later, [*keys, "b"]).withColumn("valid_to", F.coalesce(
        F.lead("at").over(inside), "later")).where("action = 'add'").select(
        *keys, F.col("at").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame, bucket: int = BUCKET_SECONDS) -> DataFrame:
    """Per row of ``captures(page_id, url, fetched_at)``: ``page_id, host, fetched_at, n_active,
    blocked, decided_by, decided_list, listed_since``.

    ``n_active`` counts the active (list, key) pairs that name the URL. The longest key decides,
    then the smaller key, then the smaller list name. Null or host-less URLs and null times
    match nothing (empty host for null). Repeated rows each get their result; other columns are
    ignored; an empty entry table blocks nothing.
    """
    rows = written(captures.select("page_id", "url", F.col("fetched_at").cast("long").alias("fetched_at"), row_key(
        F.col("page_id"), F.col("url"), F.col("fetched_at")).alias("row_key"), F.coalesce(
        url_host(F.col("url")), F.lit("")).alias("host")), "captures")
    asked = rows.where("fetched_at is not null").select(
        "row_key", "fetched_at", F.floor(F.col("fetched_at") / bucket).alias("b"),
        F.explode(url_keys(F.col("url"))).alias("key")).distinct()
    last = rows.agg(F.max("fetched_at").alias("last"))
    spans = validity_intervals(entries, bucket).join(F.broadcast(last)).where("valid_from <= last").withColumn(
        "b", F.explode(F.sequence(F.floor(F.col("valid_from") / bucket), F.floor(
            F.least(F.coalesce("valid_to", "last"), "last") / bucket)))).drop("last")
    spans = written(spans, "intervals")
    best = F.struct((-F.char_length("key")).alias("n"), "key", "list_name", "valid_from")
    active = asked.join(spans, ["key", "b"]).where(
        (F.col("valid_from") <= F.col("fetched_at")) & (
            F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))).groupBy("row_key").agg(
        F.count("*").alias("n"), F.min(best).alias("best")).withColumnRenamed("row_key", "k")
    return rows.join(active, F.col("row_key") == F.col("k"), "left").select(
        "page_id", "host", "fetched_at", F.coalesce("n", F.lit(0)).cast("long").alias("n_active"),
        F.col("n").isNotNull().alias("blocked"), F.col("best.key").alias("decided_by"),
        F.col("best.list_name").alias("decided_list"), F.col("best.valid_from").alias("listed_since"))


def _hashed(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def page_captures(pages: DataFrame, start: int = 1_704_067_200, days: int = 360) -> DataFrame:
    """Pages with a fetch time spread over ``days`` by a hash of their id, since pages have none."""
    return pages.select("page_id", "url", (F.lit(start) + _hashed(F.col("page_id").cast("string")) % (
        days * 86400)).alias("fetched_at"))


def derived_entries(pages: DataFrame, start: int = 1_704_067_200, days: int = 360) -> DataFrame:
    """Dated entries made from the pages' own URLs: one in four of their keys gets a history of
    one to four actions on one of three lists, timed by hashes of the key."""
    keys = pages.select(F.explode(url_keys(F.col("url"))).alias("key")).distinct().where(
        _hashed(F.concat(F.lit("q"), F.col("key"))) % 4 == 0)
    turn = keys.withColumn("nth", F.explode(F.sequence(F.lit(0), (
        _hashed(F.concat(F.lit("n"), F.col("key"))) % 4).cast("int"))))
    return turn.select(
        F.concat(F.lit("list"), (_hashed(F.concat(F.lit("l"), F.col("key"))) % 3).cast("string")).alias("list_name"),
        "key", F.when(F.col("nth") % 2 == 0, "add").otherwise("remove").alias("action"),
        (F.lit(start) + _hashed(F.concat(F.col("nth").cast("string"), F.col("key"))) % (days * 86400)).alias("at"))
