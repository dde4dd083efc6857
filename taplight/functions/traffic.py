"""Rate, direction, flag and fan-out features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S

__all__ = [
    "flow_key", "flow_duration", "packet_rate", "byte_rate", "syn_flood_ratio",
    "amplification_ratio", "with_ddos_features", "byte_direction_ratio", "byte_skew",
    "session_duration_stats", "with_exfil_features", "one_sided_exfil_features",
    "scan_type", "scan_features", "tcp_flags_decode", "tcp_flags_encode",
]


def flow_key(protocol: Column, src_ip: Column, src_port: Column, dst_ip: Column,
             dst_port: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the directional 5-tuple."""
    text = F.concat_ws(":", F.lower(protocol), src_ip,
                       F.coalesce(src_port, F.lit(0)).cast("string"), dst_ip,
                       F.coalesce(dst_port, F.lit(0)).cast("string"))
    return F.substring(F.sha2(text, 256), 1, 16)


def flow_duration(packet_count: Column, start: Column, end: Column) -> Column:
    return F.when(packet_count <= 1, 0.0).otherwise(end - start)


def _per_second(amount: Column, duration: Column) -> Column:
    return F.when(duration > 0, amount / duration).otherwise(0.0)


def packet_rate(packets: Column, duration: Column) -> Column:
    return _per_second(packets, duration)


def byte_rate(nbytes: Column, duration: Column) -> Column:
    return _per_second(nbytes, duration)


def syn_flood_ratio(packets: DataFrame, *keys: str) -> DataFrame:
    """SYN-without-ACK and ACK counts per key, with their ratios."""
    flags = F.upper(F.coalesce(F.col("flags"), F.lit("")))
    ack = flags.contains("A")
    syn = flags.contains("S") & ~ack
    counts = packets.groupBy(*keys).agg(
        F.count_if(syn).alias("syn_count"), F.count_if(ack).alias("ack_count"),
        F.count(F.lit(1)).alias("total_packets"))
    return counts.withColumns({
        "syn_to_ack_ratio": F.col("syn_count") / F.greatest(F.col("ack_count"), F.lit(1)),
        "syn_rate": F.col("syn_count") / F.greatest(F.col("total_packets"), F.lit(1)),
    })


def amplification_ratio(flows: DataFrame) -> DataFrame:
    """Bytes answered per byte asked, for each directional pair that has an answer.

    Both directions are summed to one row per pair before they meet, so the join is
    one row against at most one row whatever the key frequencies are.
    """
    pair = ["protocol", "src_ip", "src_port", "dst_ip", "dst_port"]
    sums = flows.groupBy(*pair).agg(F.sum("bytes_transferred").alias("request_bytes"))
    answers = sums.select(
        "protocol", F.col("dst_ip").alias("src_ip"), F.col("dst_port").alias("src_port"),
        F.col("src_ip").alias("dst_ip"), F.col("src_port").alias("dst_port"),
        F.col("request_bytes").alias("response_bytes"))
    return sums.join(answers, pair).withColumn(
        "amplification_ratio",
        F.col("response_bytes") / F.greatest(F.col("request_bytes"), F.lit(1)))


def with_ddos_features(flows: DataFrame, packets: DataFrame | None = None) -> DataFrame:
    """Rate, count and fan-out columns; SYN columns too when packets are given."""
    dur = F.col("duration_seconds")
    out = flows.withColumns({
        "packet_rate": packet_rate(F.col("packet_count"), dur),
        "byte_rate": byte_rate(F.col("bytes_transferred"), dur),
        "dst_port_count": F.size(F.coalesce(F.col("dst_ports"), F.array().cast("array<int>"))),
        "src_port_count": F.when(F.col("src_port").isNotNull(), 1).otherwise(0),
    })
    if packets is None:
        return out
    syn = syn_flood_ratio(packets, "flow_id").select("flow_id", "syn_count",
                                                     "syn_to_ack_ratio", "syn_rate")
    return out.join(syn, "flow_id", "left").na.fill(
        {"syn_count": 0, "syn_to_ack_ratio": 0.0, "syn_rate": 0.0})


def byte_direction_ratio(outbound: Column, inbound: Column) -> Column:
    total, ratio = outbound + inbound, outbound / F.greatest(inbound, F.lit(1))
    return F.struct(ratio.alias("ratio"), total.alias("total_bytes"),
                    ((ratio > 10.0) & (total > 10 * S.MIB)).alias("exfil_likely"))


def byte_skew(outbound: Column, inbound: Column) -> Column:
    total = outbound + inbound
    return F.when(total == 0, 0.0).otherwise(F.abs(outbound - inbound) / total)


def session_duration_stats(nbytes: Column, duration: Column) -> Column:
    """Throughput with the long (> 60 s) and high (> 100 kB/s) flags."""
    throughput = _per_second(nbytes, duration)
    return F.struct(throughput.alias("throughput_bytes_sec"),
                    ((duration > 0) & (duration > 60)).alias("is_long_duration"),
                    ((duration > 0) & (throughput > 100_000)).alias("is_high_throughput"))


def with_exfil_features(flows: DataFrame, outbound: str = "outbound_bytes",
                        inbound: str = "inbound_bytes") -> DataFrame:
    out, back = F.col(outbound), F.col(inbound)
    staged = flows.withColumn("_ratio", byte_direction_ratio(out, back)).withColumn(
        "_session", session_duration_stats(F.col("bytes_transferred"), F.col("duration_seconds")))
    slow = F.col("_session.is_long_duration") & (F.col("_session.throughput_bytes_sec") < 10_000)
    return staged.select(
        *flows.columns, "_ratio.*", "_session.*", byte_skew(out, back).alias("byte_skew"),
        (F.col("_ratio.exfil_likely") | slow).alias("exfil_alert"))


def one_sided_exfil_features(nbytes: Column, packets: Column, duration: Column) -> Column:
    per_packet = nbytes / F.greatest(packets, F.lit(1))
    return F.struct(nbytes.cast("double").alias("outbound_bytes_abs"),
                    per_packet.alias("bytes_per_packet"),
                    (nbytes / F.greatest(duration, F.lit(1.0))).alias("throughput_bytes_sec"),
                    ((nbytes > S.MIB) & (per_packet > 500.0)).alias("exfil_likely"))


def scan_type(ports: Column, hosts: Column) -> Column:
    return F.when(ports > hosts, "horizontal").when(hosts > ports, "vertical").otherwise("mixed")


def scan_features(flows: DataFrame) -> DataFrame:
    """Own port count of each flow against the distinct hosts of its source.

    Distinct (source, host) pairs are reduced first, so a busy source reaches the
    join as one row.
    """
    hosts = flows.select("src_ip", "dst_ip").distinct() \
                 .groupBy("src_ip").agg(F.count(F.lit(1)).alias("unique_dst_hosts"))
    ports = F.size(F.array_distinct(F.coalesce(F.col("dst_ports"),
                                               F.array().cast("array<int>"))))
    kind = scan_type(F.col("unique_dst_ports"), F.col("unique_dst_hosts"))
    counted = flows.withColumn("unique_dst_ports", ports)
    hosts = hosts.withColumnRenamed("src_ip", "_src")
    return counted.join(hosts, F.col("src_ip").eqNullSafe(F.col("_src"))).drop("_src").withColumns({
        "scan_type": kind,
        "is_horizontal_scan": kind == "horizontal",
        "is_vertical_scan": kind == "vertical",
        "fan_out_ratio": F.col("unique_dst_ports") / F.greatest(F.col("unique_dst_hosts"), F.lit(1)),
        "port_scan_alert": (F.col("unique_dst_ports") > S.SCAN_PORTS)
                           | (F.col("unique_dst_hosts") > S.SCAN_HOSTS),
    })


def tcp_flags_decode(bits: Column, letters: bool = False) -> Column:
    """Flag names of a bit mask as an array, or the letter string."""
    table = S.TCP_FLAG_LETTERS if letters else S.TCP_FLAG_NAMES
    names = F.array_compact(F.array(*[
        F.when(bits.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in table]))
    return F.array_join(names, "") if letters else names


def tcp_flags_encode(names: Column) -> Column:
    """Bit mask of an array of flag names or letters; unknown names add nothing."""
    upper = F.transform(names, lambda x: F.upper(x))
    bits = F.lit(0)
    for bit, name in S.TCP_FLAG_NAMES:
        hit = F.array_contains(upper, name)
        if name != "URG":
            hit = hit | F.array_contains(upper, name[0])
        bits = bits.bitwiseOR(F.when(hit, bit).otherwise(0))
    return bits
