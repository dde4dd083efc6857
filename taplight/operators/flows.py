"""Packets to flow records, and questions about the flow table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import flow_duration, flow_key
from .common import join_null_safe
from .ordered import BUCKET, anchored_groups, bucketed, with_carry

FIVE_TUPLE = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")


def with_flow_key(packets: DataFrame) -> DataFrame:
    return packets.withColumn("flow_id", flow_key(
        F.col("protocol"), F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port")))


def _last_non_empty(value: str, *order: str) -> Column:
    filled = F.coalesce(F.col(value).cast("string"), F.lit("")) != ""
    return F.max_by(value, F.when(filled, F.struct(*order)))


def _counters(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Exact counters, sets and last-seen fields per key; all of it combines map-side.

    The key decides which packets belong together; the record shows its first packet's
    5-tuple, so spellings that share a key don't split it.
    """
    at = ("ts", "packet_id")
    has_name = F.coalesce(F.col("dns_query"), F.lit("")) != ""
    flows = packets.groupBy(*keys).agg(
        F.min_by(F.struct(*FIVE_TUPLE), F.struct(*at)).alias("_tuple"),
        F.count(F.lit(1)).alias("packet_count"),
        F.sum("packet_size").cast("bigint").alias("bytes_transferred"),
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.array_sort(F.collect_set("flags")).alias("flags"),
        F.array_sort(F.collect_set("dst_port")).alias("dst_ports"),
        F.coalesce(_last_non_empty("ja3", *at), F.lit("")).alias("ja3"),
        F.coalesce(_last_non_empty("dns_query", *at), F.lit("")).alias("dns_query"),
        F.coalesce(F.max_by("dns_qtype", F.when(has_name, F.struct(*at))),
                   F.lit(0)).alias("dns_qtype"),
        F.max_by("tls_counts", F.when(F.size("tls_counts") > 0, F.struct(*at)))
         .alias("tls_counts"))
    flows = flows.select(*keys, "_tuple.*", *[c for c in flows.columns if c not in (*keys, "_tuple")])
    return flows.withColumn("duration_seconds", flow_duration(
        F.col("packet_count"), F.col("start_time"), F.col("end_time")))


def _series(heads: DataFrame, keys: list[str]) -> DataFrame:
    """Time and size series of packets already cut to the first 64 per key."""
    packed = heads.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("ts", "packet_id", "packet_size"))).alias("_s"))
    return packed.select(*keys, F.transform("_s", lambda x: x["ts"]).alias("timestamps"),
                         F.transform("_s", lambda x: x["packet_size"]).alias("packet_sizes"))


def build_flows(packets: DataFrame, bucket_seconds: float = 60.0) -> DataFrame:
    """One flow per 5-tuple: exact counters, first 64 packets as series.

    Counters never shuffle raw packets. The series read three narrow columns: buckets that
    start past a flow's 64th packet drop out by count, and the rest keep 64 rows at most,
    so a flood flow gathers no more than any other.
    """
    keyed = with_flow_key(packets)
    narrow = bucketed(keyed.select("flow_id", "ts", "packet_id", "packet_size"),
                      F.col("ts"), bucket_seconds)
    before = F.coalesce("_before", F.lit(0))
    early = with_carry(narrow, ["flow_id"], {"_before": (F.count(F.lit(1)), "sum")}) \
        .where(before < S.SERIES_CAP)
    place = F.row_number().over(
        Window.partitionBy("flow_id", BUCKET).orderBy("ts", "packet_id"))
    heads = early.withColumn("_n", place).where(F.col("_n") <= S.SERIES_CAP) \
                 .where(before + F.col("_n") <= S.SERIES_CAP)
    return _counters(keyed, ["flow_id"]).join(_series(heads, ["flow_id"]), "flow_id")


def is_closing(flags: Column, protocol: Column) -> Column:
    text = F.coalesce(flags, F.lit(""))
    return (F.lower(protocol) == "tcp") & (text.contains("F") | text.contains("R"))


def export_flows(packets: DataFrame, idle: float = S.FLOW_IDLE_SECONDS,
                 active: float = S.FLOW_ACTIVE_SECONDS,
                 bucket_seconds: float = 60.0) -> DataFrame:
    """Flow records cut after a FIN/RST, after ``idle`` seconds of silence, or once a
    record is ``active`` seconds old; each packet lands in exactly one record."""
    keyed = with_flow_key(packets)
    cut = anchored_groups(keyed, ["flow_id"], "ts", ["ts", "packet_id"], active, idle,
                          is_closing(F.col("flags"), F.col("protocol")), name="_cut",
                          bucket_seconds=bucket_seconds)
    # A record lasts at most ``active`` seconds, so its packets can be numbered directly.
    record = ["flow_id", "_cut_run", "_cut"]
    place = F.row_number().over(Window.partitionBy(*record).orderBy("ts", "packet_id"))
    heads = cut.select(*record, "ts", "packet_id", "packet_size") \
               .withColumn("_n", place).where(F.col("_n") <= S.SERIES_CAP)
    return join_null_safe(_counters(cut, record), _series(heads, record), record) \
        .drop("_cut", "_cut_run")


def expire_flows(flows: DataFrame, now: float, ttl: float = S.FLOW_TTL_SECONDS) -> DataFrame:
    """Flows still live at ``now``: last packet at most ``ttl`` seconds ago."""
    return flows.where(F.col("end_time") + ttl >= now)


def flow_table_stats(flows: DataFrame) -> DataFrame:
    return flows.agg(F.count(F.lit(1)).alias("total_flows"),
                     F.coalesce(F.sum("packet_count"), F.lit(0)).alias("total_packets"),
                     F.coalesce(F.sum("bytes_transferred"), F.lit(0)).alias("total_bytes"))


def recent_by_source(flows: DataFrame, src_ip: str, limit: int = 10) -> DataFrame:
    return flows.where(F.col("src_ip") == src_ip) \
                .orderBy(F.desc("packet_count"), "flow_id").limit(limit)


def top_talkers_packets(flows: DataFrame, n: int = 10) -> DataFrame:
    return flows.groupBy(F.col("src_ip").alias("source_ip")) \
                .agg(F.sum("packet_count").alias("packet_count")) \
                .orderBy(F.desc("packet_count"), "source_ip").limit(n)


def flow_summary_columns(flows: DataFrame) -> DataFrame:
    """Serialised view: summary-aware port and host counts, series clipped to 50."""
    raw = F.col("raw_features")
    ports = F.size(F.array_distinct(F.coalesce("dst_ports", F.array().cast("array<int>"))))
    return flows.withColumns({
        "dst_port_count": F.greatest(ports.cast("bigint"), F.coalesce(
            raw["unique_dst_ports"].cast("bigint"), F.lit(0))),
        "unique_dst_hosts": F.greatest(F.lit(1).cast("bigint"), F.coalesce(
            raw["unique_dst_hosts"].cast("bigint"), F.lit(1))),
        "timestamps": F.slice("timestamps", 1, S.SERIES_SERIALISED),
        "packet_sizes": F.slice("packet_sizes", 1, S.SERIES_SERIALISED),
    })
