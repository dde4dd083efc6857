"""Streaming twins of the keyed operators.

Same names and rules as the batch side. Verdicts that need no state run as plain columns
on the fold's output, so one rule text serves both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings as S
from ..operators import beacon, dns, exfil, lifecycle, scan
from ..operators.ddos import ddos_amplifier_rule, ddos_rate_rule
from ..operators.flows import with_flow_key
from ..operators.slow_rate import slow_rate_candidate
from ..sources.alert_store import write_alerts
from . import folds
from .ordered_fold import ordered_fold


def stream_flows(packets: DataFrame, lateness: str = "10 seconds",
                 idle: float = S.FLOW_IDLE_SECONDS, active: float = S.FLOW_ACTIVE_SECONDS
                 ) -> DataFrame:
    """Flow records from a packet stream, each emitted once when it is cut."""
    rows = with_flow_key(packets).select(
        "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_id", "ts",
        "flags", "packet_size")
    return ordered_fold(rows, ["flow_id"], "ts", "packet_id", folds.FlowRecords(idle, active),
                        lateness)


def _contacts(flows: DataFrame) -> DataFrame:
    port = F.coalesce(F.col("dst_port"), F.lit(-1))
    return flows.where((port != 53) & (F.coalesce("src_port", F.lit(-1)) != 53)).select(
        "flow_id", "src_ip", "dst_ip", port.alias("port"), "start_time", "packet_count",
        "bytes_transferred")


def beacon_pair(flows: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    series = ordered_fold(_contacts(flows), ["src_ip", "dst_ip", "port"], "start_time", "flow_id",
                          folds.TrailingStarts(S.BEACON_PAIR_ROWS), lateness)
    return beacon.periodic_series(series, "series").drop("series")


def beacon_destination(flows: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """Destination series hits. A flow the pair test also caught appears in both streams;
    the alert key is the same, so the merge folds them together."""
    series = ordered_fold(_contacts(flows), ["dst_ip", "port"], "start_time", "flow_id",
                          folds.TrailingStarts(S.BEACON_DESTINATION_ROWS, sparse_only=True),
                          lateness)
    return beacon.periodic_series(series, "series").drop("series")


def scan_fanout_running(flows: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    raw = F.col("raw_features")
    rows = flows.select(
        "flow_id", "src_ip", "dst_ip", "dst_port", "dst_ports", "start_time",
        F.try_element_at(raw, F.lit("unique_dst_ports")).cast("bigint").alias("summary_ports"),
        F.try_element_at(raw, F.lit("unique_dst_hosts")).cast("bigint").alias("summary_hosts"))
    return ordered_fold(rows, ["src_ip"], "start_time", "flow_id", folds.ScanFanout(), lateness)


def port_scan_rule(flows: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    return scan.port_scan_rule(scan_fanout_running(flows, lateness))


def source_ip_entropy(flows: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    rows = flows.select("flow_id", "src_ip", "dst_ip", "start_time")
    return ordered_fold(rows, ["dst_ip"], "start_time", "flow_id", folds.SourceEntropy(), lateness)


def slow_rate_concurrency(flows: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    rows = slow_rate_candidate(flows).select(
        "flow_id", "src_ip", "dst_ip", "dst_port", "start_time", "slow_end")
    counted = ordered_fold(rows, ["dst_ip", "dst_port"], "start_time", "flow_id",
                           folds.SlowConnections(), lateness)
    return counted.where(F.col("concurrent") >= S.SLOW_MIN_CONCURRENT)


def _merged(alerts: DataFrame, fold: folds.AlertMerge, lateness: str) -> DataFrame:
    rows = alerts.select(
        "alert_id", "threat_class", "source_ip", "destination_ip", "protocol", "ts", "confidence",
        "severity", F.lower("source_ip").alias("src_key"), F.lower("destination_ip").alias("dst_key"),
        F.to_json("evidence").alias("evidence_json"))
    merged = ordered_fold(rows, ["threat_class", "src_key", "dst_key", "protocol"], "ts",
                          "alert_id", fold, lateness)
    scored = lifecycle.severity_scorer(F.col("confidence"), F.col("threat_class"))
    return merged.withColumns({
        "severity": F.when(F.col("n_detections") > 1, scored).otherwise(F.col("first_severity")),
        "evidence": F.from_json("evidence_json", alerts.schema["evidence"].dataType)}).drop(
        "first_severity", "evidence_json")


def stream_alerts(alerts: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """Merged alerts with all their evidence, one row per group once its 300-second window has closed."""
    return _merged(alerts, folds.AlertMerge(), lateness)


def stream_alert_updates(alerts: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """A group as it stands whenever alerts joined it, and once more when it has ``closed``."""
    return _merged(alerts, folds.AlertUpdates(), lateness)


def store_updates(batch: DataFrame, epoch: int, path: str) -> None:
    """Writes one trigger's updates. A trigger that is run again overwrites its own rows, and no others."""
    batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def write_alert_updates(alerts: DataFrame, path: str, checkpoint: str, lateness: str = "10 seconds", **trigger):
    """Keeps a table of alert updates by trigger; ``current_alerts`` reads it as one row an alert."""
    return stream_alert_updates(alerts, lateness).writeStream.foreachBatch(
        lambda batch, epoch: store_updates(batch, epoch, path)).option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or {"availableNow": True})).start()


def current_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of each alert: new groups appear, grown ones replace what they were."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/epoch=*")
    latest = F.max_by(F.struct(*[c for c in rows.columns if c not in ("alert_id", "epoch")]), F.struct("epoch", "closed"))
    return rows.groupBy("alert_id").agg(latest.alias("a")).select("alert_id", "a.*")


def flow_verdicts(flows: DataFrame) -> DataFrame:
    """Alerts of every detector that judges a flow by itself."""
    def slim(hits: DataFrame, detector: str, threat_class: str) -> DataFrame:
        from ..operators.common import detections, evidence
        items = F.array(evidence("packet_rate", F.round("pkt_rate", 2), 0.6,
                                 F.format_string("Packet rate %.1f pps", F.col("pkt_rate"))))
        return detections(hits, detector, threat_class, F.col("severity"), F.col("confidence"),
                          items, "one_sided_rate_v2")

    found = slim(ddos_rate_rule(flows), "ddos", "ddos") \
        .unionByName(slim(ddos_amplifier_rule(flows), "ddos", "ddos")) \
        .unionByName(exfil.exfil_detect(flows)).unionByName(dns.dns_tunnel_detect(flows))
    return lifecycle.to_alerts(found)


def stream_detect(flows: DataFrame, path: str, checkpoint: str, **trigger):
    """Write the flow verdicts of every micro-batch to the alert table.

    Alert ids follow from the flow and the detector, and the store skips known ids, so a
    replayed batch adds nothing.
    """
    def store(batch: DataFrame, _epoch: int) -> None:
        alerts = flow_verdicts(batch).withColumn(
            "raw_features", F.create_map().cast("map<string,double>"))
        write_alerts(alerts, path)

    return flows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint) \
                .trigger(**(trigger or {"availableNow": True})).start()
