"""Version 5 flow-export datagrams held as a binary column.

Header, big-endian: version u16, count u16, uptime ms u32, seconds u32, nanoseconds u32,
sequence u32, 4 bytes more. Each record is 48 bytes; the decoded ones are at the offsets
in ``_FIELDS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import tcp_flags_decode

HEADER_BYTES, RECORD_BYTES = 24, 48
# Fixed values: (offset, width) inside a record.
_FIELDS = {"packet_count": (16, 4), "bytes_transferred": (20, 4), "first": (24, 4),
           "last": (28, 4), "src_port": (32, 2), "dst_port": (34, 2), "flag_bits": (37, 1),
           "proto": (38, 1)}


def _uint(data: Column, offset: Column | int, width: int) -> Column:
    start = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    return F.conv(F.hex(F.substring(data, start, F.lit(width))), 16, 10).cast("bigint")


def _ipv4(data: Column, offset: Column) -> Column:
    return F.concat_ws(".", *[_uint(data, offset + i, 1).cast("string") for i in range(4)])


def with_header(datagrams: DataFrame, payload: str = "payload") -> DataFrame:
    p = F.col(payload)
    return datagrams.withColumns({
        "version": _uint(p, 0, 2), "record_count": _uint(p, 2, 2), "uptime_ms": _uint(p, 4, 4),
        "export_secs": _uint(p, 8, 4), "export_nsecs": _uint(p, 12, 4), "sequence": _uint(p, 16, 4)})


def is_complete(payload: str = "payload") -> Column:
    """Version 5 with at least one record and room for all it announces; null is malformed."""
    return F.coalesce((F.col("version") == 5) & (F.col("record_count") > 0) & (
        F.octet_length(payload) >= HEADER_BYTES + RECORD_BYTES * F.col("record_count")), F.lit(False))


def malformed_datagrams(datagrams: DataFrame, exporter: str = "exporter",
                        payload: str = "payload") -> DataFrame:
    """Datagrams per exporter, and how many of them can't be decoded."""
    return with_header(datagrams, payload).groupBy(exporter).agg(
        F.count(F.lit(1)).alias("datagrams"),
        F.count_if(~is_complete(payload)).alias("malformed"))


def netflow_v5_decode(datagrams: DataFrame, payload: str = "payload") -> DataFrame:
    """One flow row per record of each complete version 5 datagram."""
    headed = with_header(datagrams, payload).where(is_complete(payload))
    rows = headed.withColumn("record_no", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.col("record_count") - 1)))
    base = (F.lit(HEADER_BYTES) + F.col("record_no") * RECORD_BYTES).cast("int")
    p = F.col(payload)
    boot = F.col("export_secs") + F.col("export_nsecs") / 1e9 - F.col("uptime_ms") / 1000.0
    fields = {name: _uint(p, base + offset, width) for name, (offset, width) in _FIELDS.items()}
    decoded = rows.withColumns({
        **fields, "src_ip": _ipv4(p, base), "dst_ip": _ipv4(p, base + 4), "_boot": boot})
    protocol = F.lit("tcp")
    for number, name in S.PROTOCOL_NUMBERS.items():
        protocol = F.when(F.col("proto") == number, name).otherwise(protocol)
    start, end = F.col("_boot") + F.col("first") / 1000.0, F.col("_boot") + F.col("last") / 1000.0
    kept = [c for c in datagrams.columns if c != payload]
    return decoded.select(
        *kept, "record_no", "src_ip", "dst_ip", F.col("src_port").cast("int").alias("src_port"),
        F.col("dst_port").cast("int").alias("dst_port"), protocol.alias("protocol"),
        tcp_flags_decode(F.col("flag_bits")).alias("flags"), "packet_count", "bytes_transferred",
        start.alias("start_time"), end.alias("end_time"),
        F.greatest(F.lit(0.0), end - start).alias("duration_seconds"))


def export_sequence_gaps(datagrams: DataFrame, exporter: str = "exporter",
                         arrival: str = "arrival", bucket: int = 100_000) -> DataFrame:
    """Records lost per exporter, from jumps in the sequence numbers.

    Arrivals are cut into buckets, so one busy exporter is followed by many tasks. A bucket
    reports its own gaps and its edges; edges meet in a scan over the exporter's buckets.
    Datagrams that can't be decoded don't count; ``malformed_datagrams`` reports them.
    """
    def gap(seq: Column, expected: Column) -> Column:
        jump = F.pmod(seq - expected, F.lit(2 ** 32))
        return F.when((jump > 0) & (jump < 2 ** 31 - 1), jump).otherwise(0)

    rows = with_header(datagrams).where(is_complete()).select(
        exporter, arrival, "sequence", "record_count", F.floor(F.col(arrival) / bucket).alias("_b"),
        F.pmod(F.col("sequence") + F.col("record_count"), F.lit(2 ** 32)).alias("_next"))
    w = Window.partitionBy(exporter, "_b").orderBy(arrival, "sequence")
    at = F.struct(arrival, "sequence")
    edges = rows.withColumn("_gap", gap(F.col("sequence"), F.lag("_next").over(w))) \
        .groupBy(exporter, "_b").agg(
            F.sum("_gap").alias("_inner"), F.min_by("sequence", at).alias("_first"),
            F.max_by("_next", at).alias("_last"), F.sum("record_count").alias("_records"))
    over = Window.partitionBy(exporter).orderBy("_b")
    return edges.withColumn("_edge", gap(F.col("_first"), F.lag("_last").over(over))) \
        .groupBy(exporter).agg((F.sum("_inner") + F.sum("_edge")).alias("lost_records"),
                               F.sum("_records").alias("records"))
