"""Catalogue: listings, breakdowns, reports and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings as S
from ..functions import scan_type, shannon_entropy
from ..operators import reports as R
from ..operators import lifecycle as L
from .features import _ENT
from ..session import cut_lineage
from .registry import query

A = ["alerts_v"]


@query("list_threats", """SELECT alert_id, threat_class, severity, ts FROM alerts_v
    WHERE severity = 'high' AND threat_class = 'ddos' ORDER BY ts DESC, alert_id DESC LIMIT 100""", A)
def _(v):
    return R.list_threats(v.alerts, "HIGH", "ddos").select("alert_id", "threat_class", "severity", "ts")


@query("alert_by_id", "SELECT alert_id, flow_id, confidence FROM alerts_v WHERE alert_id = 'a000000042'", A)
def _(v):
    return R.alert_by_id(v.alerts, "a000000042").select("alert_id", "flow_id", "confidence")


def _class_top(name, cls, fn):
    sql = f"""SELECT alert_id, confidence FROM alerts_v WHERE threat_class = '{cls}'
      ORDER BY confidence DESC, flow_id LIMIT 100"""
    query(name, sql, A)(lambda v: fn(v.alerts).select("alert_id", "confidence"))


_class_top("dga_detections", "dga", R.dga_detections)
_class_top("dns_tunnel_detections", "dns_tunnel", R.dns_tunnel_detections)
_class_top("tls_fingerprints", "tls_malware", R.tls_fingerprints)
_class_top("port_scan_alerts", "port_scan", R.port_scans)


@query("exfil_anomalies", """SELECT alert_id, bytes_transferred FROM alerts_v
    WHERE threat_class = 'exfiltration' ORDER BY bytes_transferred DESC, alert_id LIMIT 100""", A)
def _(v):
    return R.exfil_anomalies(v.alerts).select("alert_id", "bytes_transferred")


@query("tls_malware_recent", """SELECT alert_id, ts FROM alerts_v WHERE threat_class = 'tls_malware'
    ORDER BY ts DESC, alert_id DESC LIMIT 100""", A)
def _(v):
    return R.tls_malware_recent(v.alerts).select("alert_id", "ts")


@query("traffic_stats", """SELECT n AS total_flows, b AS total_bytes, p AS total_packets,
    b // n AS avg_bytes_per_flow, p // n AS avg_packets_per_flow FROM (SELECT count(*) n,
    CAST(sum(bytes_transferred) AS BIGINT) b, CAST(sum(packet_count) AS BIGINT) p FROM flows_v)""",
       ["flows_v"])
def _(v):
    return R.traffic_stats(v.flows)


@query("top_talkers_bytes", """SELECT src_ip AS ip, CAST(sum(bytes_transferred) AS BIGINT) AS bytes
    FROM flows_v GROUP BY 1 ORDER BY bytes DESC, ip LIMIT 10""", ["flows_v"])
def _(v):
    return R.top_talkers_bytes(v.flows, "src_ip")


@query("protocol_counts", "SELECT protocol, count(*) AS count FROM flows_v GROUP BY 1", ["flows_v"])
def _(v):
    return R.protocol_counts(v.flows)


@query("protocol_distribution", """SELECT protocol, round(count(*)*100.0::DOUBLE/sum(count(*)) OVER (), 1)
    AS percent FROM flows_v GROUP BY 1""", ["flows_v"])
def _(v):
    return R.protocol_distribution(v.flows)


@query("alert_stats", """SELECT 'threat_class' AS kind, threat_class AS value, count(*) AS n FROM alerts_v
    GROUP BY threat_class UNION ALL SELECT 'severity', s, count(alert_id) FROM
    (VALUES ('critical'),('high'),('medium'),('low')) t(s) LEFT JOIN alerts_v ON severity = s GROUP BY s""", A)
def _(v):
    return R.alert_stats(v.alerts)


@query("dns_analytics", """SELECT count(*) FILTER (threat_class='dga') AS dga_detections,
    count(*) FILTER (threat_class='dns_tunnel') AS tunnel_detections,
    count(*) FILTER (threat_class IN ('dga','dns_tunnel')) AS total,
    round(avg(evidence[2].value) FILTER (threat_class='dga' AND evidence[2].value > 0), 3) AS mean_domain_entropy,
    count(*) FILTER (threat_class='dga' AND evidence[2].value > 0) AS entropy_samples FROM alerts_v""", A)
def _(v):
    return R.dns_analytics(v.alerts)


@query("dns_top_sources", """SELECT source_ip, count(*) AS detections FROM alerts_v
    WHERE threat_class='dga' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", A)
def _(v):
    return R.dns_top_sources(v.alerts)


@query("dns_samples", """SELECT alert_id, source_ip, destination_ip, evidence[2].value AS domain_entropy,
    bigram_likelihood, confidence, severity FROM alerts_v WHERE threat_class='dga'
    ORDER BY ts, alert_id LIMIT 25""", A)
def _(v):
    return R.dns_samples(v.alerts)


@query("tls_analytics", """SELECT count(*) FILTER (threat_class='tls_malware') AS sessions_flagged,
    count(*) FILTER (threat_class='tls_malware' AND severity IN ('high','critical')) AS malware_verdicts
    FROM alerts_v""", A)
def _(v):
    return R.tls_analytics(v.alerts)


@query("tls_samples", """SELECT alert_id, flow_id, source_ip, destination_ip, extensions_count,
    ciphers_count, confidence, severity FROM alerts_v WHERE threat_class='tls_malware'
    ORDER BY ts, alert_id LIMIT 25""", A)
def _(v):
    return R.tls_samples(v.alerts)


_FILTERED = """(SELECT * FROM alerts_v WHERE threat_class='ddos' ORDER BY ts DESC, alert_id DESC LIMIT 100)"""


@query("report_summary", f"""SELECT count(*) FILTER (severity='critical') AS critical,
    count(*) FILTER (severity='high') AS high, count(*) FILTER (severity='medium') AS medium,
    count(*) FILTER (severity='low') AS low, count(*) AS total FROM {_FILTERED}""", A)
def _(v):
    return R.report_summary(v.alerts, report_type="ddos")


@query("report_rows", f"""SELECT alert_id, ts, threat_class, severity, confidence, source_ip, source_port,
    destination_ip, destination_port, protocol, bytes_transferred, packet_count, duration_seconds
  FROM {_FILTERED}""", A)
def _(v):
    return R.report_rows(v.alerts, include_evidence=False, threat_class="ddos")


_DISPLAY = "CASE threat_class " + " ".join(
    f"WHEN '{k}' THEN '{d}'" for k, d in S.DISPLAY_CLASS.items()) + " ELSE threat_class END"


@query("detection_mix", f"SELECT {_DISPLAY} AS cls, count(*) AS count FROM alerts_v GROUP BY 1", A)
def _(v):
    return R.detection_mix(v.alerts)


@query("annotated_talkers", f"""SELECT source_ip AS ip, CAST(sum(bytes_transferred) AS BIGINT) AS bytes,
    CAST(sum(packet_count) AS BIGINT) AS pkts, count(*) AS flows,
    array_to_string(list_sort(list_distinct(list({_DISPLAY}))), ', ') AS note,
    bool_or(severity IN ('high','critical')) AS flagged FROM alerts_v GROUP BY 1
    ORDER BY bytes DESC, ip LIMIT 10""", A)
def _(v):
    return R.annotated_talkers(v.alerts)


@query("recon_summary", """SELECT count(*) AS total, count(DISTINCT source_ip) AS active FROM alerts_v
    WHERE threat_class='port_scan'""", A)
def _(v):
    return R.recon_summary(v.alerts)


@query("recon_rows", """SELECT source_ip AS src, CAST(evidence[3].value AS BIGINT) AS ports,
    CAST(0 AS BIGINT) AS hosts, CAST(round(duration_seconds) AS BIGINT) AS dur, 'TCP scan' AS tech
    FROM (SELECT * FROM alerts_v WHERE threat_class='port_scan' ORDER BY confidence DESC, flow_id LIMIT 25)""", A)
def _(v):
    return R.recon_rows(v.alerts)


@query("exfil_summary", """SELECT count(*) AS total, sum(bytes_transferred)::DOUBLE AS bytes FROM alerts_v
    WHERE threat_class='exfiltration'""", A)
def _(v):
    return R.exfil_summary(v.alerts)


@query("exfil_rows", """SELECT source_ip AS src, destination_ip AS dst, bytes_transferred::DOUBLE AS out,
    confidence FROM (SELECT * FROM alerts_v WHERE threat_class='exfiltration'
    ORDER BY bytes_transferred DESC, alert_id LIMIT 25)""", A)
def _(v):
    return R.exfil_rows(v.alerts)


@query("traffic_summary", """SELECT n AS total_flows, b AS total_bytes, p AS total_packets,
    round(d, 6) AS avg_duration FROM (SELECT count(*) n, CAST(sum(bytes_transferred) AS BIGINT) b,
      CAST(sum(packet_count) AS BIGINT) p FROM alerts_v), (SELECT avg(duration_seconds) d FROM
      (SELECT * FROM alerts_v ORDER BY ts DESC, alert_id DESC LIMIT 500))""", A)
def _(v):
    return R.traffic_summary(v.alerts).withColumn("avg_duration", F.round("avg_duration", 6))


@query("headline_metrics", """SELECT count(*) AS total_detections,
    count(*) FILTER (severity IN ('high','critical')) AS active_threats,
    round(sum(bytes_transferred)/86400*8/1e6, 2)::DOUBLE AS throughput_mbps FROM alerts_v""", A)
def _(v):
    return R.headline_metrics(v.alerts, 86400)


@query("severity_distribution", """SELECT severity, count(*) AS count,
    round(count(*)*100.0::DOUBLE/sum(count(*)) OVER (), 6) AS percentage FROM alerts_v GROUP BY 1""", A)
def _(v):
    return R.severity_distribution(v.alerts).withColumn("percentage", F.round("percentage", 6))


_DEV = "bytes_transferred/10485760"


@query("exfil_deviation", f"""SELECT alert_id, round({_DEV}, 6) AS byte_ratio, round({_DEV}-1, 6) AS deviation
    FROM alerts_v WHERE threat_class='exfiltration'""", A)
def _(v):
    return R.exfil_deviation(v.alerts).select("alert_id", F.round("byte_ratio", 6).alias("byte_ratio"),
                                              F.round("deviation", 6).alias("deviation"))


@query("exfil_top_sources", f"""SELECT source_ip AS ip, count(*) AS count,
    CAST(sum(bytes_transferred) AS BIGINT) AS total_bytes, round(max({_DEV}), 6) AS max_ratio,
    round(greatest(0.0, max({_DEV}-1)), 6)::DOUBLE AS max_deviation FROM alerts_v
    WHERE threat_class='exfiltration' GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 8""", A)
def _(v):
    return R.exfil_top_sources(v.alerts).withColumns({
        c: F.round(c, 6) for c in ("max_ratio", "max_deviation")})


@query("exfil_protocol_breakdown", """SELECT protocol, count(*) AS count,
    CAST(sum(bytes_transferred) AS BIGINT) AS total_bytes,
    CAST(round(count(*)*100.0::DOUBLE/sum(count(*)) OVER ()) AS BIGINT) AS percentage FROM alerts_v
    WHERE threat_class='exfiltration' GROUP BY 1""", A)
def _(v):
    return R.exfil_protocol_breakdown(v.alerts)


@query("exfil_direction_summary", f"""SELECT count(*) FILTER (packet_count % 3 > 0) AS outbound,
    count(*) FILTER (packet_count % 3 = 0) AS inbound, round(max({_DEV}-1), 6) AS max_deviation,
    CAST(sum(bytes_transferred) FILTER (packet_count % 3 > 0) AS BIGINT) AS outbound_bytes
    FROM alerts_v WHERE threat_class='exfiltration'""", A)
def _(v):
    rows = R.exfil_deviation(v.alerts).withColumn("direction", F.when(
        F.col("packet_count") % 3 > 0, "outbound").otherwise("inbound"))
    return R.exfil_direction_summary(rows).withColumn("max_deviation", F.round("max_deviation", 6))


# Fingerprint rows: TLS flows of the flow table, grouped by fingerprint.
_FPS = """fps AS (SELECT ja3, md5(ja3) AS ja4, CAST(ciphers_count AS BIGINT) AS c,
    CASE WHEN extensions_count > 9 THEN 'TLS 1.3' ELSE 'TLS 1.2' END AS tls_version,
    'suite-' || CAST(CAST(ciphers_count AS BIGINT) AS VARCHAR) AS cipher_suite, count(*) AS connections
  FROM flows_v WHERE ja3 <> '' GROUP BY ALL)"""


def _fingerprints(v):
    raw = F.col("raw_features")
    return v.flows.where(F.col("ja3") != "").groupBy(
        "ja3", F.md5("ja3").alias("ja4"),
        F.when(raw["extensions_count"] > 9, "TLS 1.3").otherwise("TLS 1.2").alias("tls_version"),
        F.concat(F.lit("suite-"), raw["ciphers_count"].cast("bigint").cast("string"))
         .alias("cipher_suite")).agg(F.count(F.lit(1)).alias("connections"))


def _weighted(col: str, limit: str = "") -> str:
    return f"""WITH {_FPS} SELECT {col}, CAST(sum(connections) AS BIGINT) AS count,
      CAST(round(sum(connections)*100.0::DOUBLE/sum(sum(connections)) OVER ()) AS BIGINT) AS percentage
      FROM fps GROUP BY 1 ORDER BY 2 DESC, 1 {limit}"""


@query("cipher_distribution", _weighted("cipher_suite", "LIMIT 8"), ["flows_v"])
def _(v):
    return R.cipher_distribution(_fingerprints(v))


@query("tls_version_distribution", _weighted("tls_version"), ["flows_v"])
def _(v):
    return R.tls_version_distribution(_fingerprints(v))


@query("fingerprint_uniques", f"""WITH {_FPS} SELECT count(DISTINCT ja3) AS unique_ja3,
    count(DISTINCT ja4) AS unique_ja4, CAST(sum(connections) AS BIGINT) AS connections FROM fps""", ["flows_v"])
def _(v):
    return R.fingerprint_uniques(_fingerprints(v))


@query("fingerprint_uniques_merged", f"""WITH {_FPS} SELECT count(DISTINCT ja3) AS unique_ja3,
    count(DISTINCT ja4) AS unique_ja4, CAST(sum(connections) AS BIGINT) AS connections FROM fps""", ["flows_v"])
def _(v):
    # Sketches are exact up to some thousand values, as many as the view holds.
    sketches = R.fingerprint_sketches(_fingerprints(v), "cipher_suite", "tls_version")
    return R.fingerprint_uniques_merged(cut_lineage(sketches))


@query("scan_type_distribution", """SELECT t AS scan_type, count(*) AS count,
    round(count(*)*100.0::DOUBLE/sum(count(*)) OVER (), 6) AS percentage FROM (SELECT
      CASE WHEN p > h THEN 'horizontal' WHEN h > p THEN 'vertical' ELSE 'mixed' END AS t
      FROM (SELECT src_ip, count(DISTINCT dst_port) p, count(DISTINCT dst_ip) h FROM flows_v GROUP BY 1))
    GROUP BY 1""", ["flows_v"])
def _(v):
    n = v.flows.groupBy("src_ip").agg(F.countDistinct("dst_port").alias("p"),
                                      F.countDistinct("dst_ip").alias("h"))
    kinds = n.select(scan_type(F.col("p"), F.col("h")).alias("scan_type"))
    return R.scan_type_distribution(kinds).withColumn("percentage", F.round("percentage", 6))


@query("entropy_band_filter", f"""WITH {_ENT.format(col='domain', src='names_v')}
  SELECT CASE WHEN round(h, 6) > 3.5 THEN 'high' WHEN round(h, 6) >= 3.0 THEN 'medium' ELSE 'low' END AS band,
    count(*) AS names, CAST(sum(length(domain)) AS BIGINT) AS queries
  FROM names_v JOIN ent USING (name_id) GROUP BY 1""", ["names_v"])
def _(v):
    rows = v.names.select(F.round(shannon_entropy(F.col("domain")), 6).alias("entropy"),
                          F.length("domain").alias("queries"))
    return R.entropy_band_filter(rows)


def _with_status(v):
    return L.latest_status(v.alerts, v.statuses)


_STATUSED = """st AS (SELECT a.*, coalesce(s, 'new') AS status FROM alerts_v a LEFT JOIN
    (SELECT alert_id, arg_max(status, updated_at) AS s FROM statuses_v GROUP BY 1) USING (alert_id))"""
SA = ["alerts_v", "statuses_v"]


@query("alert_filter_sort", f"""WITH {_STATUSED} SELECT alert_id, source_ip, status, confidence FROM st
    WHERE (contains(source_ip, '10.0.0') OR contains(alert_id, '10.0.0')) AND severity = 'high'
      AND status = 'resolved'""", SA)
def _(v):
    return R.alert_filter_sort(_with_status(v), "10.0.0", severity="high", status="resolved",
                               sort_by="confidence").select("alert_id", "source_ip", "status", "confidence")


@query("alert_search", f"""WITH {_STATUSED},
  c AS (SELECT alert_id FROM st WHERE threat_class = 'dns_tunnel' ORDER BY alert_id LIMIT 3)
  SELECT alert_id, 70 AS relevance FROM c
  UNION ALL (SELECT alert_id, 50 FROM st WHERE contains(lower(concat_ws(' ', alert_id, source_ip,
      destination_ip, threat_class, severity, status, protocol, flow_id, nullif(domain, ''),
      nullif(ja3, ''))), 'tunnel') AND alert_id NOT IN (SELECT alert_id FROM c)
    ORDER BY alert_id LIMIT 12)""", SA)
def _(v):
    return R.alert_search(_with_status(v), "Tunnel")


@query("alert_search_ip", f"""WITH {_STATUSED} SELECT alert_id, 90 AS relevance FROM st
    WHERE source_ip = '10.0.0.2' ORDER BY alert_id LIMIT 15""", SA)
def _(v):
    return R.alert_search(_with_status(v), "10.0.0.2")


@query("top_dst_ports", """SELECT dst_port, protocol, n, round(n*100.0::DOUBLE/(SELECT count(*) FROM flows_v), 6)
    AS percent FROM (SELECT dst_port, protocol, count(*) AS n FROM flows_v GROUP BY 1, 2
    ORDER BY n DESC, dst_port, protocol LIMIT 8)""", ["flows_v"])
def _(v):
    return R.top_dst_ports(v.flows).withColumn("percent", F.round("percent", 6))


@query("alert_rates", """SELECT alert_id, round(packet_count/greatest(duration_seconds,1.0), 6) AS packets_per_second,
    round(bytes_transferred*8/greatest(duration_seconds,1.0), 5) AS bits_per_second FROM alerts_v""", A)
def _(v):
    return R.alert_rates(v.alerts).select(
        "alert_id", F.round("packets_per_second", 6).alias("packets_per_second"),
        F.round("bits_per_second", 5).alias("bits_per_second"))


@query("quick_search", """SELECT alert_id FROM alerts_v WHERE protocol = 'udp' ORDER BY alert_id LIMIT 20""", A)
def _(v):
    return R.quick_search(v.alerts, "UDP").select("alert_id")
