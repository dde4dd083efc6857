"""Alert tables: append new alerts once, load the newest, export reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.reports import REPORT_COLUMNS, newest, report_rows

_EVIDENCE = schemas.ALERTS["evidence"].dataType
_RAW = schemas.ALERTS["raw_features"].dataType


def encode_alerts(alerts: DataFrame) -> DataFrame:
    """Nested columns as JSON text, with the day and class columns the table is laid out by."""
    return alerts.withColumns({
        "evidence": F.to_json("evidence"), "raw_features": F.to_json("raw_features"),
        "day": F.to_date(F.timestamp_seconds("ts"))})


def decode_alerts(stored: DataFrame) -> DataFrame:
    return stored.withColumns({
        "evidence": F.coalesce(F.from_json("evidence", _EVIDENCE), F.array().cast(_EVIDENCE)),
        "raw_features": F.coalesce(F.from_json("raw_features", _RAW), F.create_map().cast(_RAW)),
    }).drop("day")


def new_alerts(alerts: DataFrame, stored: DataFrame) -> DataFrame:
    """Alerts not stored yet, one row per id.

    Only ids of the days the batch touches are compared, so the stored side is pruned by
    partition instead of being read whole.
    """
    encoded = encode_alerts(alerts).dropDuplicates(["alert_id"])
    days = encoded.select("day").distinct()
    known = stored.join(days, "day", "left_semi").select("alert_id")
    return encoded.join(known, "alert_id", "left_anti")


def write_alerts(alerts: DataFrame, path: str) -> None:
    """Append alerts whose id is not in the table; calling again adds nothing. One writer at
    a time: two at once may both find an id missing."""
    try:
        rows = new_alerts(alerts, alerts.sparkSession.read.parquet(path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = encode_alerts(alerts).dropDuplicates(["alert_id"])
    rows.write.mode("append").partitionBy("day", "threat_class").parquet(path)


def load_alerts(stored: DataFrame, limit: int = 1000, threat_class: str | None = None) -> DataFrame:
    """Newest alerts with their nested columns restored."""
    rows = stored if threat_class is None else stored.where(F.col("threat_class") == threat_class)
    return decode_alerts(newest(rows, limit))


def read_alerts(spark: SparkSession, path: str, limit: int = 1000,
                threat_class: str | None = None) -> DataFrame:
    return load_alerts(spark.read.parquet(path), limit, threat_class)


def export_report_csv(alerts: DataFrame, path: str, **filters) -> None:
    report_rows(alerts, include_raw_features=False, **filters).write.mode("overwrite") \
        .option("header", True).option("escape", '"').csv(path)


def export_report_json(alerts: DataFrame, path: str, **filters) -> None:
    report_rows(alerts, **filters).withColumn(
        "evidence", F.from_json("evidence", _EVIDENCE)).write.mode("overwrite").json(path)


__all__ = ["encode_alerts", "decode_alerts", "new_alerts", "write_alerts", "load_alerts",
           "read_alerts", "export_report_csv", "export_report_json", "REPORT_COLUMNS"]
