"""Catalogue: alert lifecycle operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..operators import exfil, scan
from ..session import cut_lineage
from .detectors import _EXFIL, _RUNNING, _SCAN_HIT, _SCAN_RULE, detection_rows, detections_sql
from .registry import query

_SCAN_ALERTS = f"""{_RUNNING}, found AS (SELECT flow_id, src_ip AS source_ip, unique_dst_ports,
    unique_dst_hosts, {_SCAN_RULE} FROM fan WHERE {_SCAN_HIT})"""
_LIFT = """CASE WHEN confidence >= 0.8 AND severity IN ('low','medium') THEN 'high'
    WHEN confidence >= 0.6 AND confidence < 0.8 AND severity = 'low' THEN 'medium'
    ELSE severity END"""


@query("port_scans", f"""WITH {_SCAN_ALERTS} SELECT flow_id, source_ip, 'port_scan' AS threat_class,
    {_LIFT} AS severity, confidence, unique_dst_ports, unique_dst_hosts FROM found
  ORDER BY confidence DESC, flow_id LIMIT 100""", ["flows_v"])
def _(v):
    from ..operators.reports import port_scans
    alerts = L.to_alerts(scan.scan_detect(v.flows))
    return port_scans(alerts).select(
        "flow_id", "source_ip", "threat_class", "severity", "confidence",
        L.evidence_value("unique_dst_ports", raw=None).cast("bigint").alias("unique_dst_ports"),
        L.evidence_value("unique_dst_hosts", raw=None).cast("bigint").alias("unique_dst_hosts"))


@query("detect_all", detections_sql({}), ["traffic_v"])
def _(v):
    return detection_rows(L.detect_all(cut_lineage(v.traffic)))


@query("assign_severity", """SELECT alert_id, CASE WHEN threat_class IN ('port_scan','tls_malware')
    THEN severity WHEN threat_class = 'ddos' THEN CASE WHEN confidence > 0.6 THEN 'high' ELSE 'medium' END
    WHEN threat_class = 'c2_beacon' THEN CASE WHEN confidence > 0.5 THEN 'high' ELSE 'medium' END
    WHEN threat_class = 'dga' THEN CASE WHEN confidence > 0.6 THEN 'high' ELSE 'medium' END
    WHEN threat_class = 'exfiltration' THEN CASE WHEN confidence > 0.5 THEN 'high' ELSE 'medium' END
    ELSE 'low' END AS severity FROM alerts_v""", ["alerts_v"])
def _(v):
    return v.alerts.select("alert_id", L.assign_severity(
        F.col("threat_class"), F.col("confidence"), F.col("severity")).alias("severity"))


@query("finalize_severity", f"SELECT alert_id, {_LIFT} AS severity FROM alerts_v", ["alerts_v"])
def _(v):
    return v.alerts.select("alert_id", L.finalize_severity(
        F.col("severity"), F.col("confidence")).alias("severity"))


@query("dedup_within_flow", f"""SELECT flow_id, 'exfiltration' AS threat_class,
    0.9::DOUBLE AS confidence, 'outbound_bytes_abs,bytes_per_packet,throughput_bytes_sec,extra' AS names
  FROM flows_v WHERE {_EXFIL}""", ["flows_v"])
def _(v):
    first = exfil.exfil_detect(v.flows)
    extra = F.array_append("evidence", F.struct(
        F.lit("extra").alias("feature_name"), F.lit(1.0).alias("value"),
        F.lit(0.1).alias("contribution"), F.lit("second look").alias("description")))
    second = first.withColumns({"confidence": F.lit(0.9), "evidence": extra,
                                "detector": F.lit("slow_rate")})
    out = L.dedup_within_flow(L.to_alerts(first.unionByName(second)))
    return out.select("flow_id", "threat_class", "confidence", F.array_join(F.transform(
        "evidence", lambda e: e["feature_name"]), ",").alias("names"))


@query("backfill_identity", f"""SELECT flow_id, src_ip AS source_ip, dst_ip AS destination_ip
    FROM flows_v WHERE {_EXFIL}""", ["flows_v"])
def _(v):
    alerts = L.to_alerts(exfil.exfil_detect(v.flows)).withColumns({
        "source_ip": F.lit("0.0.0.0"), "destination_ip": F.lit("")})
    return L.backfill_identity(alerts, v.flows).select("flow_id", "source_ip", "destination_ip")


_SCORER = """CASE WHEN {c}='ddos' AND {p}>=0.75 THEN 'critical' WHEN {c}='ddos' AND {p}>=0.55 THEN 'high'
    WHEN {c}='c2_beacon' AND {p}>=0.65 THEN 'critical' WHEN {c}='c2_beacon' AND {p}>=0.45 THEN 'high'
    WHEN {c} IN ('exfiltration','tls_malware') AND {p}>=0.7 THEN 'critical'
    WHEN {c} IN ('exfiltration','tls_malware') AND {p}>=0.5 THEN 'high'
    WHEN {c}='port_scan' AND {p}>=0.6 THEN 'high' WHEN {c}='port_scan' AND {p}>=0.4 THEN 'medium'
    WHEN {p}>=0.8 THEN 'critical' WHEN {p}>=0.6 THEN 'high' WHEN {p}>=0.4 THEN 'medium' ELSE 'low' END"""


@query("severity_scorer", f"""SELECT alert_id, {_SCORER.format(c='threat_class', p='confidence')}
    AS severity FROM alerts_v""", ["alerts_v"])
def _(v):
    return v.alerts.select("alert_id", L.severity_scorer(
        F.col("confidence"), F.col("threat_class")).alias("severity"))


@query("combine_confidence", """SELECT alert_id, round(least(1.0, greatest(0.0, confidence*0.4 +
    (packet_count/200.0::DOUBLE)*0.6)), 4)::DOUBLE AS confidence FROM alerts_v""", ["alerts_v"])
def _(v):
    return v.alerts.select("alert_id", L.combine_confidence(
        F.col("confidence"), F.col("packet_count") / 200.0).alias("confidence"))


# Walk each key's alerts in order, carrying the time of the group's first alert.
_MERGE = f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY threat_class, source_ip,
    destination_ip, protocol ORDER BY ts, alert_id) AS rn FROM alerts_v),
  walk AS (SELECT threat_class, source_ip, destination_ip, protocol, rn, ts AS g FROM o WHERE rn = 1
    UNION ALL SELECT o.threat_class, o.source_ip, o.destination_ip, o.protocol, o.rn,
      CASE WHEN o.ts >= w.g + 300 THEN o.ts ELSE w.g END
    FROM walk w JOIN o ON o.threat_class = w.threat_class AND o.source_ip = w.source_ip
      AND o.destination_ip = w.destination_ip AND o.protocol = w.protocol AND o.rn = w.rn + 1),
  j AS (SELECT o.*, w.g FROM o JOIN walk w USING (threat_class, source_ip, destination_ip, protocol, rn)),
  heads AS (SELECT threat_class, source_ip, destination_ip, protocol, g,
      arg_min(alert_id, (ts, alert_id)) AS alert_id, min(ts) AS ts, max(confidence) AS confidence,
      arg_min(severity, (ts, alert_id)) AS sev, count(*) AS n_detections FROM j GROUP BY ALL),
  ev AS (SELECT threat_class, source_ip, destination_ip, protocol, g, name, min((ts, alert_id, i)) AS pos
    FROM (SELECT *, unnest([e.feature_name for e in evidence]) AS name,
      generate_subscripts(evidence, 1) AS i FROM j) GROUP BY ALL),
  names AS (SELECT threat_class, source_ip, destination_ip, protocol, g,
      string_agg(name, ',' ORDER BY pos) AS names FROM ev GROUP BY ALL)
  SELECT h.alert_id, h.threat_class, h.source_ip, h.destination_ip, h.protocol, h.ts, h.confidence,
    h.n_detections, n.names, CASE WHEN n_detections > 1
      THEN {_SCORER.format(c='h.threat_class', p='h.confidence')} ELSE sev END AS severity
  FROM heads h JOIN names n USING (threat_class, source_ip, destination_ip, protocol, g)"""


def _names():
    return F.array_join(F.transform("evidence", lambda e: e["feature_name"]), ",").alias("names")


def _merged(df):
    return df.select("alert_id", "threat_class", "source_ip", "destination_ip", "protocol", "ts",
                     "confidence", "n_detections", _names(), "severity")


@query("merge_alerts", _MERGE, ["alerts_v"])
def _(v):
    return _merged(L.merge_alerts(v.alerts))


@query("coalesce_batch", f"""WITH j AS (SELECT *, CAST(floor(ts/60) AS BIGINT) AS minute FROM alerts_v),
  heads AS (SELECT minute, threat_class, source_ip, destination_ip, protocol,
      arg_min(alert_id, (ts, alert_id)) AS alert_id, max(confidence) AS confidence,
      arg_min(severity, (ts, alert_id)) AS sev, count(*) AS coalesced FROM j GROUP BY ALL)
  SELECT minute, alert_id, threat_class, confidence, coalesced, CASE WHEN coalesced > 1
      THEN {_SCORER.format(c='threat_class', p='confidence')} ELSE sev END AS severity FROM heads""",
       ["alerts_v"])
def _(v):
    batched = v.alerts.withColumn("minute", F.floor(F.col("ts") / 60))
    return L.coalesce_batch(batched, ["minute"]).select(
        "minute", "alert_id", "threat_class", "confidence", "coalesced", "severity")


@query("rank_evidence", """SELECT alert_id, array_to_string([e.feature_name for e in evidence], ',')
    AS names FROM alerts_v""", ["alerts_v"])
def _(v):
    return v.alerts.withColumn("evidence", L.rank_evidence(F.reverse("evidence"))) \
            .select("alert_id", _names())


@query("top_evidence", """SELECT alert_id, evidence[1].feature_name || ',' || evidence[2].feature_name
    AS names FROM alerts_v""", ["alerts_v"])
def _(v):
    return v.alerts.withColumn("evidence", L.top_evidence(F.reverse("evidence"), 2)) \
            .select("alert_id", _names())


@query("explain_alert", """SELECT alert_id, array_to_string([e.description for e in evidence], '. ')
    || '.' AS explanation FROM alerts_v""", ["alerts_v"])
def _(v):
    return v.alerts.select("alert_id", L.explain_alert(F.col("evidence")).alias("explanation"))


@query("contribution_summary", """SELECT alert_id, e.feature_name AS name,
    round(e.contribution, 2)::DOUBLE AS share FROM (SELECT alert_id, unnest(evidence) AS e
    FROM alerts_v)""", ["alerts_v"])
def _(v):
    return v.alerts.select("alert_id", F.explode(
        L.contribution_summary(F.col("evidence"))).alias("name", "share"))


@query("evidence_value", """SELECT alert_id,
    coalesce(list_filter(evidence, lambda e: e.feature_name = 'packet_rate')[1].value, 0.0)::DOUBLE AS rate,
    extensions_count FROM alerts_v""", ["alerts_v"])
def _(v):
    return v.alerts.select("alert_id", L.evidence_value("packet_rate").alias("rate"),
                           L.evidence_value("extensions_count").alias("extensions_count"))


@query("validate_alerts", """SELECT alert_id, CASE WHEN confidence < 0.05 THEN
    'confidence out of range' ELSE '' END || CASE WHEN packet_count = 1 THEN
    CASE WHEN confidence < 0.05 THEN ',' ELSE '' END || 'protocol unknown' ELSE '' END AS errors
  FROM alerts_v""", ["alerts_v"])
def _(v):
    broken = v.alerts.withColumns({
        "confidence": F.when(F.col("confidence") < 0.05, -1.0).otherwise(F.col("confidence")),
        "protocol": F.when(F.col("packet_count") == 1, "gre").otherwise(F.col("protocol"))})
    return L.validate_alerts(broken).select("alert_id", F.array_join("errors", ",").alias("errors"))


@query("active_alerts", """SELECT alert_id, ts FROM alerts_v ORDER BY ts DESC, alert_id DESC
    LIMIT 1000""", ["alerts_v"])
def _(v):
    return L.active_alerts(v.alerts, 500).select("alert_id", "ts")


@query("threat_counts", """SELECT threat_class, count(*) AS detections FROM alerts_v GROUP BY 1""",
       ["alerts_v"])
def _(v):
    return L.threat_counts(v.alerts)


@query("push_rate_limit", """SELECT CAST(floor(ts) AS BIGINT) AS second, least(count(*), 1) AS pushed,
    greatest(count(*) - 1, 0) AS suppressed FROM alerts_v GROUP BY 1""", ["alerts_v"])
def _(v):
    return L.push_rate_limit(v.alerts, 1)


@query("pushed_alerts", """SELECT alert_id FROM (SELECT alert_id, row_number() OVER (
    PARTITION BY floor(ts) ORDER BY ts, alert_id) AS n FROM alerts_v) WHERE n <= 1""", ["alerts_v"])
def _(v):
    return L.pushed_alerts(v.alerts, 1).select("alert_id")


@query("latest_status", """SELECT alert_id, coalesce(s, 'new') AS status FROM alerts_v LEFT JOIN
    (SELECT alert_id, arg_max(status, updated_at) AS s FROM statuses_v GROUP BY 1) USING (alert_id)""",
       ["alerts_v", "statuses_v"])
def _(v):
    return L.latest_status(v.alerts, v.statuses).select("alert_id", "status")


@query("alert_notes", """SELECT alert_id, coalesce(n, '') AS notes FROM alerts_v LEFT JOIN
    (SELECT alert_id, string_agg(note, ';' ORDER BY created_at) AS n FROM notes_v GROUP BY 1)
    USING (alert_id)""", ["alerts_v", "notes_v"])
def _(v):
    return L.alert_notes(v.alerts, v.notes).select("alert_id", F.array_join("notes", ";").alias("notes"))
