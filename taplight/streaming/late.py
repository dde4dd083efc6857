"""Late rows kept and counted, instead of dropped by the operator that finds them late.

A stateful operator drops rows at or behind its watermark in silence. Here a stream is split in
front of it: every trigger writes its rows in time to one table and its late ones to another, by
the rule that Spark applies, so a stream over the first table loses nothing and the second says
what is missing. A trigger that is run again overwrites its own rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _watermark(spark: SparkSession, folder: str, epoch: int, lateness_ms: int) -> int | None:
    """Watermark of a trigger in milliseconds: the latest time of all earlier ones less the lateness."""
    try:
        marks = spark.read.option("basePath", f"{folder}/marks").parquet(f"{folder}/marks/epoch=*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    latest = marks.where(F.col("epoch") < epoch).agg(F.max("latest_us")).first()[0]
    return None if latest is None else latest // 1000 - lateness_ms


def split_batch(batch: DataFrame, epoch: int, folder: str, event_time: str, lateness_seconds: float) -> None:
    """Writes one trigger's rows to ``folder/kept`` or ``folder/late``. Rows without a time are late."""
    mark = _watermark(batch.sparkSession, folder, epoch, int(lateness_seconds * 1000))
    us = F.unix_micros(event_time)
    late = us.isNull() if mark is None else us.isNull() | (us <= mark * 1000)
    rows = batch.persist()
    try:
        rows.where(~late).write.mode("overwrite").parquet(f"{folder}/kept/epoch={epoch}")
        rows.where(late).write.mode("overwrite").parquet(f"{folder}/late/epoch={epoch}")
        rows.agg(F.max(us).alias("latest_us")).write.mode("overwrite").parquet(f"{folder}/marks/epoch={epoch}")
    finally:
        rows.unpersist()


def split_late(stream: DataFrame, folder: str, checkpoint: str, event_time: str = "event_time",
               lateness_seconds: float = 10.0, **trigger):
    """Splits a stream with a timestamp column ``event_time`` against its watermark, trigger by trigger."""
    return stream.writeStream.foreachBatch(
        lambda batch, epoch: split_batch(batch, epoch, folder, event_time, lateness_seconds)).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_split(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of a split stream with their trigger (``epoch``) and a flag ``late``."""
    kept, late = (spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}/epoch=*").withColumn(
        "late", F.lit(name == "late")) for name in ("kept", "late"))
    return kept.unionByName(late)
