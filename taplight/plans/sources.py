"""Catalogue: sources, sinks and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import telemetry as W
from ..session import scratch_folder
from ..sources import alert_store, export_datagrams as D, flow_files, reference_lists as RL
from .registry import query
from .views import BASE


@query("read_flow_table", "SELECT flow_id, src_ip, start_time, packet_count FROM flows_v", ["flows_v"])
def _(v):
    path = scratch_folder(v.spark, "flows")
    v.flows.select("flow_id", "src_ip", "start_time", "packet_count").write.parquet(path)
    return flow_files.read_flow_table(v.spark, path)


@query("read_flow_json", """SELECT flow_id, start_time, packet_count, bytes_transferred, protocol
    FROM flows_v""", ["flows_v"])
def _(v):
    path = scratch_folder(v.spark, "flow-json")
    v.flows.select("flow_id", "start_time", "packet_count", "bytes_transferred", "protocol").write.json(path)
    return flow_files.read_flow_json(v.spark, path, multi_line=False).select(
        "flow_id", "start_time", "packet_count", "bytes_transferred", "protocol")


_STEP = "CASE WHEN packet_count > 1 THEN duration_seconds/(packet_count-1) ELSE 0 END"


@query("normalize_flows", f"""SELECT flow_id, start_time, start_time + duration_seconds AS end_time,
    CAST(least(packet_count, 50) AS INTEGER) AS n_times,
    round(start_time + (least(packet_count, 50)-1)*({_STEP}), 5) AS last_time,
    CAST(least(packet_count, 50) * (bytes_transferred // packet_count) AS BIGINT) AS size_sum,
    CAST(len(list_distinct(list_append(dst_ports, dst_port))) AS INTEGER) AS n_ports FROM flows_v""",
       ["flows_v"])
def _(v):
    f = flow_files.normalize_flows(v.flows.drop("end_time").withColumn(
        "end_time", F.lit(None).cast("double")))
    return f.select("flow_id", "start_time", "end_time", F.size("timestamps").alias("n_times"),
                    F.round(F.array_max("timestamps"), 5).alias("last_time"),
                    F.aggregate("packet_sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
                     .alias("size_sum"), F.size("dst_ports").alias("n_ports"))


@query("alias_fields", """SELECT alert_id, source_ip AS src_ip, destination_ip AS dst_ip,
    destination_port AS dst_port, 'tcp' AS protocol, bytes_transferred FROM alerts_v""", ["alerts_v"])
def _(v):
    rows = v.alerts.select("alert_id", "source_ip", "destination_ip", "destination_port",
                           "bytes_transferred")
    return flow_files.alias_fields(rows).select("alert_id", "src_ip", "dst_ip", "dst_port",
                                                "protocol", "bytes_transferred")


@query("netflow_v5_decode", """SELECT 'exp' || CAST((flow_no // 8) % 4 AS VARCHAR) AS exporter, src_ip,
    dst_ip, src_port, dst_port, protocol, packet_count, bytes_transferred,
    start_time, start_time + duration_seconds AS end_time FROM flows_v""", ["flows_v"])
def _(v):
    return D.netflow_v5_decode(v.datagrams).select(
        "exporter", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_count",
        "bytes_transferred", "start_time", "end_time")


_GAPS = """dg AS (SELECT 'exp' || CAST((flow_no // 8) % 4 AS VARCHAR) AS exporter, flow_no // 8 AS o,
      count(*) AS n FROM flows_v GROUP BY ALL),
  j AS (SELECT *, o*7 - lag(o*7 + n) OVER (PARTITION BY exporter ORDER BY o) AS gap FROM dg),
  g AS (SELECT exporter, CAST(sum(CASE WHEN gap > 0 THEN gap ELSE 0 END) AS BIGINT) AS lost_records,
    CAST(sum(n) AS BIGINT) AS records FROM j GROUP BY exporter)"""


def _with_noise(v):
    """The datagrams, and beside every third one a cut copy and one of another version."""
    third = v.datagrams.where(F.col("arrival") % 3 == 0)
    cut = third.withColumn("payload", F.substring("payload", 1, 40))
    other = third.withColumn("payload", F.concat(F.unhex(F.lit("0009")), F.expr("substring(payload, 3)")))
    return v.datagrams.unionByName(cut).unionByName(other)


@query("export_sequence_gaps", f"WITH {_GAPS} SELECT * FROM g", ["flows_v"])
def _(v):
    return D.export_sequence_gaps(_with_noise(v), bucket=500)


@query("malformed_datagrams", f"""WITH {_GAPS} SELECT exporter,
    count(*) + 2 * count(*) FILTER (o % 3 = 0) AS datagrams, 2 * count(*) FILTER (o % 3 = 0) AS malformed
  FROM dg GROUP BY exporter""", ["flows_v"])
def _(v):
    return D.malformed_datagrams(_with_noise(v))


@query("loss_accounting", f"""WITH {_GAPS} SELECT exporter, records + lost_records AS sent,
    records AS received, lost_records, CAST(0 AS BIGINT) AS unprocessed FROM g""", ["flows_v"])
def _(v):
    processed = D.netflow_v5_decode(v.datagrams).groupBy("exporter").agg(
        F.count(F.lit(1)).alias("processed"))
    return W.loss_accounting(D.export_sequence_gaps(v.datagrams), processed) \
            .withColumn("unprocessed", F.col("unprocessed").cast("bigint"))


@query("domain_corpus_load", """WITH d AS (SELECT split_part(lower(domain), '.', 1) AS domain, label
    FROM names_v), u AS (SELECT domain, min(label) AS label FROM d GROUP BY domain)
  SELECT label, CASE WHEN label = 1 THEN 'md5' END AS family, count(*) AS names FROM u GROUP BY ALL""",
       ["names_v"])
def _(v):
    family = F.when(F.col("label") == 1, "md5")
    rows = v.names.select("domain", "label", family.alias("family"))
    corpus = RL.merge_corpus([rows.where("label = 0"), rows.where("label = 1")])
    return RL.corpus_counts(corpus)


@query("fingerprint_load", """SELECT DISTINCT md5(CAST(c_custkey % 50 AS VARCHAR)) AS ja3, 'malware' AS label,
    'f' || CAST(c_custkey % 50 % 7 AS VARCHAR) AS family FROM customer""")
def _(v):
    # Fifty fingerprints made from the customers' keys, as one JSON list.
    key = F.col("c_custkey") % 50
    rows = v.table("customer").select(F.struct(
        F.md5(key.cast("string")).alias("ja3"), F.lit("malware").alias("label"),
        F.concat(F.lit("f"), (key % 7).cast("string")).alias("family")).alias("row")).distinct()
    path = scratch_folder(v.spark, "fingerprints")
    rows.agg(F.to_json(F.collect_list("row")).alias("value")).write.text(path)
    return RL.read_fingerprints(v.spark, path).select("ja3", "label", "family")


@query("write_alerts", "SELECT alert_id, threat_class FROM alerts_v", ["alerts_v"])
def _(v):
    # Half of the alerts first; then all of them, each twice: only the missing ones are added.
    path = scratch_folder(v.spark, "alerts")
    alert_store.write_alerts(v.alerts.where(F.substring("alert_id", 2, 20).cast("bigint") % 2 == 0), path)
    alert_store.write_alerts(v.alerts.unionByName(v.alerts), path)
    return v.spark.read.parquet(path).select("alert_id", "threat_class")


@query("load_alerts", """SELECT alert_id, ts, evidence[1].feature_name AS first_feature,
    extensions_count FROM alerts_v WHERE threat_class = 'dga' ORDER BY ts DESC, alert_id DESC
    LIMIT 1000""", ["alerts_v"])
def _(v):
    path = scratch_folder(v.spark, "alerts")
    alert_store.write_alerts(v.alerts, path)
    return alert_store.read_alerts(v.spark, path, 1000, "dga").select(
        "alert_id", "ts", F.get("evidence", F.lit(0))["feature_name"].alias("first_feature"),
        F.col("raw_features")["extensions_count"].alias("extensions_count"))


@query("export_report_csv", """SELECT alert_id, severity, confidence FROM alerts_v
    ORDER BY ts DESC, alert_id DESC LIMIT 100""", ["alerts_v"])
def _(v):
    path = scratch_folder(v.spark, "report-csv")
    alert_store.export_report_csv(v.alerts, path)
    return v.spark.read.option("header", True).option("escape", '"').csv(path).select(
        "alert_id", "severity", F.col("confidence").cast("double").alias("confidence"))


@query("export_report_json", """SELECT alert_id, evidence[2].feature_name AS second_feature FROM alerts_v
    WHERE severity = 'high' ORDER BY ts DESC, alert_id DESC LIMIT 100""", ["alerts_v"])
def _(v):
    path = scratch_folder(v.spark, "report-json")
    alert_store.export_report_json(v.alerts, path, include_raw_features=True, severity="high")
    rows = v.spark.read.schema("alert_id string, evidence array<struct<feature_name:string>>").json(path)
    return rows.select("alert_id", F.get("evidence", F.lit(1))["feature_name"].alias("second_feature"))


# ------------------------------------------------------------------ telemetry
@query("second_buckets", """SELECT CAST(floor(start_time) AS BIGINT) AS second, count(*) AS flows,
    CAST(sum(packet_count) AS BIGINT) AS packets, CAST(sum(bytes_transferred) AS BIGINT) AS bytes
  FROM flows_v GROUP BY 1""", ["flows_v"])
def _(v):
    return W.second_buckets(v.flows)


_NOW = BASE + 100_000


@query("time_series_zero_filled", f"""WITH b AS (SELECT CAST(floor((start_time - {_NOW - 60})/1) AS BIGINT) AS b,
    count(*) AS f, CAST(sum(packet_count) AS BIGINT) AS p, CAST(sum(bytes_transferred) AS BIGINT) AS y
    FROM flows_v WHERE start_time >= {_NOW - 60} AND start_time < {_NOW} GROUP BY 1)
  SELECT r - 60 AS offset_s, coalesce(f, 0) AS flows, coalesce(p, 0) AS packets, coalesce(y, 0) AS bytes
  FROM range(60) t(r) LEFT JOIN b ON b = r""", ["flows_v"])
def _(v):
    return W.time_series_zero_filled(v.flows, _NOW)


@query("throughput_rates", """WITH s AS (SELECT CAST(floor(start_time) AS BIGINT) AS second, count(*) AS f,
    CAST(sum(packet_count) AS BIGINT) AS p, CAST(sum(bytes_transferred) AS BIGINT) AS y FROM flows_v GROUP BY 1)
  SELECT second // 60 * 60 AS interval_start, round(sum(f)/60, 2)::DOUBLE AS flows_per_sec,
    round(sum(p)/60, 2)::DOUBLE AS packets_per_sec, round(sum(y)/60, 2)::DOUBLE AS bytes_per_sec,
    max(f) AS peak_flows_per_sec FROM s GROUP BY 1""", ["flows_v"])
def _(v):
    return W.throughput_rates(v.flows)


@query("latency_percentiles", """WITH l AS (SELECT list_sort(list(value)) AS v FROM
    (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000))
  SELECT CAST(len(v) AS INTEGER) AS samples,
    round(v[CAST(round_even(0.50*(len(v)-1), 0) AS INTEGER)+1], 3) AS p50_ms,
    round(v[CAST(round_even(0.95*(len(v)-1), 0) AS INTEGER)+1], 3) AS p95_ms,
    round(v[CAST(round_even(0.99*(len(v)-1), 0) AS INTEGER)+1], 3) AS p99_ms,
    round(v[1], 3) AS min_ms, round(v[-1], 3) AS max_ms, round(list_avg(v), 3) AS mean_ms FROM l""")
def _(v):
    return W.latency_percentiles(v.table("events"), "value", "ts", "event_id")


@query("latency_percentiles_exact", """WITH l AS (SELECT list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL)
  SELECT len(v) AS samples, round(v[CAST(round_even(0.5*(len(v)-1), 0) AS BIGINT)+1], 3) AS p50_ms,
    round(v[CAST(round_even(0.95*(len(v)-1), 0) AS BIGINT)+1], 3) AS p95_ms,
    round(v[CAST(round_even(0.99*(len(v)-1), 0) AS BIGINT)+1], 3) AS p99_ms, round(v[1], 3) AS min_ms,
    round(v[-1], 3) AS max_ms, round(list_avg(v), 3) AS mean_ms FROM l""")
def _(v):
    return W.latency_percentiles_exact(v.table("events"), "value")


@query("latency_ema")
def _(v):
    hour = F.date_trunc("hour", "ts").alias("hour")
    return W.latency_ema(v.table("events").select(hour, "event_type", "ts", "event_id", "value"),
                         ["event_type", "hour"], "ts", "event_id", "value")
