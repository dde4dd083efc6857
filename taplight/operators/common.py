"""Detection rows: identity of the flow plus verdict and evidence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
            "packet_count", "bytes_transferred", "duration_seconds", "start_time")


def evidence(name: str, value: Column, contribution: float | Column,
             description: Column) -> Column:
    share = contribution if isinstance(contribution, Column) else F.lit(float(contribution))
    return F.struct(F.lit(name).alias("feature_name"), value.cast("double").alias("value"),
                    share.alias("contribution"), description.alias("description"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join in which a null key equals a null key, so no row is lost to one."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


COPY = "_copy"


def with_row_hash(records: DataFrame, columns: Sequence[str | Column] | None = None) -> DataFrame:
    """``columns`` (all by default) and a hash of the whole row, which orders rows of one id and time."""
    values = [F.to_json(c) if kind.startswith("map") else F.col(c) for c, kind in records.dtypes]
    return records.select(*(["*"] if columns is None else columns), F.xxhash64(*values).alias("_hash"))


def with_copy_number(records: DataFrame, columns: Sequence[str | Column] | None = None) -> DataFrame:
    """Number the rows that share a flow id and start time, so that verdicts join back to
    one row each. Rows equal in all columns are interchangeable.

    Only ``columns`` (all by default) and a hash of the whole row travel to be numbered.
    """
    return with_row_hash(records, columns).withColumn(COPY, F.row_number().over(
        Window.partitionBy("flow_id", "start_time").orderBy("_hash"))).drop("_hash")


def text(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *values)


def detections(df: DataFrame, detector: str, threat_class: str, severity: Column,
               confidence: Column, items: Column, model: str | Column) -> DataFrame:
    version = model if isinstance(model, Column) else F.lit(model)
    return df.select(
        *IDENTITY, F.lit(detector).alias("detector"), F.lit(threat_class).alias("threat_class"),
        severity.alias("severity"), confidence.cast("double").alias("confidence"),
        items.alias("evidence"), version.alias("model_version"))


def with_rates(flows: DataFrame) -> DataFrame:
    """Per-second rates over at least one second, and bytes per packet."""
    dur = F.greatest(F.col("duration_seconds"), F.lit(1.0))
    return flows.withColumns({
        "pkt_rate": F.col("packet_count") / dur,
        "byte_rate": F.col("bytes_transferred") / dur,
        "avg_pkt": F.col("bytes_transferred") / F.greatest(F.col("packet_count"), F.lit(1)),
    })
