"""Catalogue: flow building and detection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import beacon, ddos, dns, exfil, flows as FL, scan, slow_rate
from .features import _ENT, dft_ctes
from .registry import query

# ------------------------------------------------------------------ flows


@query("flow_key", "SELECT packet_id, flow_id FROM packets_v", ["packets_v"])
def _(v):
    return FL.with_flow_key(v.packets).select("packet_id", "flow_id")


_BUILD = """SELECT {key}, count(*) AS packet_count, CAST(sum(packet_size) AS BIGINT) AS bytes_transferred,
    min(ts) AS start_time, max(ts) AS end_time,
    CASE WHEN count(*) <= 1 THEN 0.0 ELSE max(ts) - min(ts) END AS duration_seconds,
    array_to_string(list_sort(list_distinct(list(flags))), ',') AS flags,
    array_to_string([CAST(x AS VARCHAR) FOR x IN list(packet_size ORDER BY ts, packet_id)[1:64]], ' ')
      AS sizes,
    coalesce(arg_max(ja3, (ts, packet_id)) FILTER (ja3 <> ''), '') AS ja3,
    coalesce(arg_max(dns_query, (ts, packet_id)) FILTER (dns_query <> ''), '') AS dns_query,
    CAST(coalesce(arg_max(dns_qtype, (ts, packet_id)) FILTER (dns_query <> ''), 0) AS INTEGER)
      AS dns_qtype
  FROM {src} GROUP BY ALL"""


def _flat(flows):
    return flows.select(
        "flow_id", "packet_count", "bytes_transferred", "start_time", "end_time",
        "duration_seconds", F.array_join("flags", ",").alias("flags"),
        F.array_join(F.col("packet_sizes").cast("array<string>"), " ").alias("sizes"),
        "ja3", "dns_query", "dns_qtype")


@query("build_flows", _BUILD.format(key="flow_id", src="packets_v"), ["packets_v"])
def _(v):
    return _flat(FL.build_flows(v.packets))


@query("flow_duration", """SELECT flow_id, CASE WHEN count(*) <= 1 THEN 0.0 ELSE max(ts) - min(ts) END
    AS duration_seconds FROM packets_v GROUP BY flow_id""", ["packets_v"])
def _(v):
    agg = FL.with_flow_key(v.packets).groupBy("flow_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return agg.select("flow_id", FL.flow_duration(
        F.col("n"), F.col("a"), F.col("b")).alias("duration_seconds"))


# A record's start is fixed; walk each flow's packets in order carrying it.
_CUT = """WITH RECURSIVE ordered AS (SELECT *, row_number() OVER (PARTITION BY flow_id
      ORDER BY ts, packet_id) AS rn,
    lag(ts) OVER (PARTITION BY flow_id ORDER BY ts, packet_id) AS pts,
    lag(flags) OVER (PARTITION BY flow_id ORDER BY ts, packet_id) AS pflags FROM packets_v),
  walk AS (SELECT flow_id, rn, ts, ts AS cut FROM ordered WHERE rn = 1
    UNION ALL SELECT o.flow_id, o.rn, o.ts, CASE WHEN o.ts >= o.pts + 15 OR o.ts >= w.cut + 30
        OR (o.protocol = 'tcp' AND (contains(o.pflags, 'F') OR contains(o.pflags, 'R')))
      THEN o.ts ELSE w.cut END
    FROM walk w JOIN ordered o ON o.flow_id = w.flow_id AND o.rn = w.rn + 1),
  cut AS (SELECT o.*, w.cut FROM ordered o JOIN walk w USING (flow_id, rn)),
  recs AS (""" + _BUILD.format(key="flow_id, cut", src="cut") + """)
  SELECT * EXCLUDE (cut) FROM recs"""


@query("export_flows", _CUT, ["packets_v"])
def _(v):
    return _flat(FL.export_flows(v.packets))


@query("expire_flows", """SELECT flow_id, max(ts) AS end_time FROM packets_v GROUP BY flow_id
    HAVING max(ts) + 60 >= (SELECT max(ts) FROM packets_v)""", ["packets_v"])
def _(v):
    p = FL.with_flow_key(v.packets)
    now = p.agg(F.max("ts")).first()[0]
    return FL.expire_flows(p.groupBy("flow_id").agg(F.max("ts").alias("end_time")), now)


@query("flow_table_stats", """SELECT count(*) AS total_flows,
    CAST(sum(packet_count) AS BIGINT) AS total_packets,
    CAST(sum(bytes_transferred) AS BIGINT) AS total_bytes FROM flows_v""", ["flows_v"])
def _(v):
    return FL.flow_table_stats(v.flows)


@query("recent_by_source", """SELECT flow_id, src_ip, packet_count FROM flows_v
    WHERE src_ip = '10.98.0.7' ORDER BY packet_count DESC, flow_id LIMIT 10""", ["flows_v"])
def _(v):
    return FL.recent_by_source(v.flows, "10.98.0.7").select("flow_id", "src_ip", "packet_count")


@query("top_talkers_packets", """SELECT src_ip AS source_ip,
    CAST(sum(packet_count) AS BIGINT) AS packet_count FROM flows_v GROUP BY src_ip
    ORDER BY packet_count DESC, source_ip LIMIT 10""", ["flows_v"])
def _(v):
    return FL.top_talkers_packets(v.flows)


@query("flow_summary_columns", """SELECT flow_id,
    greatest(CAST(len(dst_ports) AS BIGINT), sum_ports) AS dst_port_count,
    greatest(1, sum_hosts) AS unique_dst_hosts FROM flows_v""", ["flows_v"])
def _(v):
    return FL.flow_summary_columns(v.flows).select("flow_id", "dst_port_count", "unique_dst_hosts")


# --------------------------------------------------------- volumetric rules
_RATED = """rated AS (SELECT *, packet_count / greatest(duration_seconds, 1.0) AS rate,
    bytes_transferred / greatest(packet_count, 1) AS size FROM flows_v)"""
_RATE_HIT = "(rate > 111 AND size < 300)"
_AMP_HIT = f"""(NOT {_RATE_HIT} AND protocol = 'udp' AND dst_port IN (53,123,161,389,1900,11211)
    AND rate > 20 AND size < 300)"""


def _conf(t: float) -> str:
    return f"round(0.5 + 0.5*least(1.0, (rate - {t}) / ({t}*20 - {t})), 4)::DOUBLE"


# Rates over small-packet flows: the derived flows are large-packet, so scale bytes down.
def _small(v):
    return v.flows.withColumn("bytes_transferred", F.floor(F.col("bytes_transferred") / 8))


_SMALL = """flows_s AS (SELECT * REPLACE (bytes_transferred // 8 AS bytes_transferred) FROM flows_v)"""
_RATED_S = _SMALL + ", " + _RATED.replace("FROM flows_v", "FROM flows_s")


@query("ddos_rate_rule", f"""WITH {_RATED_S} SELECT flow_id, round(rate, 4) AS pkt_rate,
    {_conf(111.0)} AS confidence, CASE WHEN {_conf(111.0)} > 0.75 THEN 'high' ELSE 'medium' END AS severity
  FROM rated WHERE {_RATE_HIT}""", ["flows_v"])
def _(v):
    return ddos.ddos_rate_rule(_small(v)).select(
        "flow_id", F.round("pkt_rate", 4).alias("pkt_rate"), "confidence", "severity")


@query("ddos_amplifier_rule", f"""WITH {_RATED_S} SELECT flow_id, dst_port, {_conf(20.0)} AS confidence,
    'medium' AS severity FROM rated WHERE {_AMP_HIT}""", ["flows_v"])
def _(v):
    return ddos.ddos_amplifier_rule(_small(v)).select("flow_id", "dst_port", "confidence", "severity")


_ENTROPY = """win AS (SELECT flow_id, list(src_ip) OVER w AS srcs, list(start_time) OVER w AS ts, start_time
    FROM flows_v WINDOW w AS (PARTITION BY dst_ip ORDER BY start_time, flow_id
      ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)),
  inwin AS (SELECT flow_id, unnest(list_filter(
    [CASE WHEN ts[i] >= start_time - 30 THEN srcs[i] END for i in range(1, len(ts)+1)],
    lambda x: x IS NOT NULL)) AS src FROM win),
  cnt AS (SELECT flow_id, src, count(*) AS c FROM inwin GROUP BY ALL),
  ent AS (SELECT flow_id, CASE WHEN sum(c) < 2 THEN 1.0 WHEN count(*) = 1 THEN 0.0
      ELSE (log2(sum(c)) - sum(c*log2(c))/sum(c)) / log2(count(*)) END AS h FROM cnt GROUP BY flow_id)"""


@query("source_ip_entropy", f"WITH {_ENTROPY} SELECT flow_id, round(h, 6) AS src_ip_entropy FROM ent",
       ["flows_v"])
def _(v):
    return ddos.source_ip_entropy(v.flows).select(
        "flow_id", F.round("src_ip_entropy", 6).alias("src_ip_entropy"))


@query("ddos_detect", f"""WITH {_RATED_S}, {_ENTROPY} SELECT flow_id, threat_class, confidence,
    CASE WHEN rate_hit AND confidence > 0.75 THEN 'high' ELSE 'medium' END AS severity,
    round(h, 3) AS src_ip_entropy, CASE WHEN rate_hit THEN 'one_sided_rate_v2'
      ELSE 'one_sided_amplifier_v2' END AS model_version
  FROM (SELECT flow_id, 'ddos' AS threat_class, {_RATE_HIT} AS rate_hit,
      CASE WHEN {_RATE_HIT} THEN {_conf(111.0)} ELSE {_conf(20.0)} END AS confidence
    FROM rated WHERE {_RATE_HIT} OR {_AMP_HIT}) JOIN ent USING (flow_id)""", ["flows_v"])
def _(v):
    d = ddos.ddos_detect(_small(v))
    h = F.filter("evidence", lambda e: e["feature_name"] == "src_ip_entropy")[0]["value"]
    return d.select("flow_id", "threat_class", "confidence", "severity",
                    h.alias("src_ip_entropy"), "model_version")


# ----------------------------------------------------------------- periodic
def _beacon_sql(series_cte: str, source: str) -> str:
    return f"""{series_cte},
  g AS (SELECT *, [s[i+1] - s[i] for i in range(1, len(s))] AS gaps FROM {source} WHERE len(s) >= 5),
  t AS (SELECT *, list_avg(gaps) AS m, list_stddev_samp(gaps) / list_avg(gaps) AS cv FROM g
    WHERE list_avg(gaps) > 0),
  c AS (SELECT * FROM t WHERE cv < 0.25 AND ((cv < 0.15 AND m >= 0.4)
    OR len(list_filter(gaps, lambda x: x <= 0)) > 0)),
  {dft_ctes('c', 'flow_id', 'gaps')},
  r AS (SELECT flow_id, m, cv, coalesce(p/total, 0) AS score,
      coalesce(1.0/(d.k/m/d.n), m) AS period,
      list_avg([abs(x - m) for x in gaps]) / m AS jit FROM c LEFT JOIN dft d USING (flow_id)),
  hits AS (SELECT *, round(least(1.0, (1-least(cv,1.0))*0.6 + least(score,1.0)*0.4), 4)::DOUBLE AS confidence
    FROM r WHERE (cv < 0.15 AND m >= 0.4) OR (cv < 0.25 AND score > 0.2))"""


_PAIR = _beacon_sql("""pairs AS (SELECT flow_id, list(start_time) OVER (PARTITION BY src_ip, dst_ip, dst_port
    ORDER BY start_time, flow_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS s FROM periodic_v)""", "pairs")
_BEACON_COLS = """flow_id, round(cv, 5) AS cv, round(score, 5) AS periodicity_score,
    round(period, 3) AS dominant_period, round(jit, 5) AS jitter, confidence,
    CASE WHEN confidence > 0.5 THEN 'high' ELSE 'medium' END AS severity"""


def _beacon_cols(df):
    return df.select("flow_id", F.round("cv", 5).alias("cv"),
                     F.round("periodicity_score", 5).alias("periodicity_score"),
                     F.round("dominant_period", 3).alias("dominant_period"),
                     F.round("jitter", 5).alias("jitter"), "confidence", "severity")


@query("beacon_pair", f"WITH {_PAIR} SELECT {_BEACON_COLS} FROM hits", ["periodic_v"])
def _(v):
    return _beacon_cols(beacon.beacon_pair(v.periodic))


@query("beacon_destination", f"""WITH ph AS (WITH {_PAIR} SELECT flow_id FROM hits),
  {_beacon_sql('''dests AS (SELECT flow_id, list(start_time) OVER w AS s, min(src_ip) OVER u AS lo,
      max(src_ip) OVER u AS hi FROM periodic_v WINDOW
      w AS (PARTITION BY dst_ip, dst_port ORDER BY start_time, flow_id ROWS BETWEEN 127 PRECEDING AND CURRENT ROW),
      u AS (PARTITION BY dst_ip, dst_port ORDER BY start_time, flow_id ROWS UNBOUNDED PRECEDING)),
    open_rows AS (SELECT flow_id, s FROM dests WHERE lo <> hi
      AND flow_id NOT IN (SELECT flow_id FROM ph))''', 'open_rows')}
  SELECT {_BEACON_COLS} FROM hits""", ["periodic_v"])
def _(v):
    return _beacon_cols(beacon.beacon_destination(v.periodic))


@query("beacon_intra_flow", """SELECT flow_id, 0.0::DOUBLE AS cv, 0.0::DOUBLE AS periodicity_score,
    0.0::DOUBLE AS confidence FROM series_v WHERE false""", ["series_v"])
def _(v):
    return beacon.beacon_intra_flow(v.series).select(
        "flow_id", "cv", "periodicity_score", "confidence")


# --------------------------------------------------------------------- scans
_RUNNING = """ports AS (SELECT src_ip, flow_id, start_time, unnest(list_distinct(list_append(dst_ports, dst_port))) AS item
    FROM flows_v),
  newp AS (SELECT flow_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY src_ip, item
      ORDER BY start_time, flow_id) AS rn FROM ports) WHERE rn = 1 GROUP BY flow_id),
  newh AS (SELECT flow_id, 1 AS n FROM (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip
      ORDER BY start_time, flow_id) AS rn FROM flows_v) WHERE rn = 1),
  fan AS (SELECT f.flow_id, f.src_ip,
    CAST(greatest(len(list_distinct(list_append(dst_ports, dst_port))), sum_ports,
      sum(coalesce(p.n, 0)) OVER w, max(sum_ports) OVER w) AS BIGINT) AS unique_dst_ports,
    CAST(greatest(1, sum_hosts, sum(coalesce(h.n, 0)) OVER w) AS BIGINT) AS unique_dst_hosts
    FROM flows_v f LEFT JOIN newp p USING (flow_id) LEFT JOIN newh h USING (flow_id)
    WINDOW w AS (PARTITION BY f.src_ip ORDER BY start_time, f.flow_id ROWS UNBOUNDED PRECEDING))"""
_SCAN_RULE = """round(least(1.0, (unique_dst_ports/20 + unique_dst_hosts/15)/4), 4)::DOUBLE AS confidence,
    CASE WHEN unique_dst_ports > 50 OR unique_dst_hosts > 30 THEN 'high' ELSE 'medium' END AS severity,
    CASE WHEN unique_dst_ports > unique_dst_hosts THEN 'horizontal'
      WHEN unique_dst_hosts > unique_dst_ports THEN 'vertical' ELSE 'mixed' END AS scan_type"""
_SCAN_HIT = "(unique_dst_ports > 20 OR unique_dst_hosts > 15)"


@query("scan_fanout_running", f"""WITH {_RUNNING} SELECT flow_id, unique_dst_ports, unique_dst_hosts
    FROM fan""", ["flows_v"])
def _(v):
    return scan.scan_fanout_running(v.flows).select("flow_id", "unique_dst_ports", "unique_dst_hosts")


_BATCH = """fan AS (SELECT src_ip, CAST(greatest(any_value(np), max(sum_ports)) AS BIGINT) AS unique_dst_ports,
    count(DISTINCT dst_ip) AS unique_dst_hosts FROM flows_v
    JOIN (SELECT src_ip, count(DISTINCT p) AS np FROM (SELECT src_ip,
      unnest(list_append(dst_ports, dst_port)) AS p FROM flows_v) GROUP BY src_ip) USING (src_ip)
    GROUP BY src_ip)"""


@query("scan_fanout_batch", f"WITH {_BATCH} SELECT * FROM fan", ["flows_v"])
def _(v):
    return scan.scan_fanout_batch(v.flows)


@query("port_scan_rule", f"""WITH {_BATCH} SELECT *, {_SCAN_RULE} FROM fan WHERE {_SCAN_HIT}""",
       ["flows_v"])
def _(v):
    return scan.port_scan_rule(scan.scan_fanout_batch(v.flows))


# ----------------------------------------------------------------- slow rate
_SLOW = """pk AS (SELECT *, [start_time + i*(duration_seconds/(packet_count-1)) for i in range(packet_count)] AS ts
    FROM slow_v),
  cand AS (SELECT *, start_time + duration_seconds AS slow_end,
      greatest(list_max([ts[i+1]-ts[i] for i in range(1, len(ts))]),
        CASE WHEN start_time + duration_seconds > list_max(ts)
          THEN start_time + duration_seconds - list_max(ts) ELSE 0 END) AS max_silence
    FROM pk WHERE dst_port IN (80,443,8000,8008,8080,8443,8888) AND duration_seconds >= 20
      AND packet_count/duration_seconds <= 2 AND bytes_transferred/packet_count <= 300
      AND bytes_transferred/duration_seconds <= 1000 AND packet_count >= 5),
  ok AS (SELECT * FROM cand WHERE max_silence <= 45)"""


@query("slow_rate_candidate", f"""WITH {_SLOW} SELECT flow_id, round(max_silence, 6) AS max_silence
    FROM ok""", ["slow_v"])
def _(v):
    return slow_rate.slow_rate_candidate(v.slow).select(
        "flow_id", F.round("max_silence", 6).alias("max_silence"))


@query("slow_rate_concurrency", f"""WITH {_SLOW},
  c AS (SELECT a.flow_id, count(*) AS concurrent, count(DISTINCT b.src_ip) AS distinct_sources
    FROM ok a JOIN ok b ON a.dst_ip = b.dst_ip AND a.dst_port = b.dst_port
      AND (b.start_time, b.flow_id) <= (a.start_time, a.flow_id)
      AND b.start_time <= a.slow_end AND b.slow_end >= a.start_time GROUP BY a.flow_id),
  s AS (SELECT *, round(least(0.95, 0.62 + 0.33*least(1.0, (concurrent-8)/8)), 4)::DOUBLE AS confidence
    FROM c WHERE concurrent >= 8)
  SELECT *, CASE WHEN confidence > 0.75 THEN 'high' ELSE 'medium' END AS severity FROM s""", ["slow_v"])
def _(v):
    return slow_rate.slow_rate_concurrency(slow_rate.slow_rate_candidate(v.slow)).select(
        "flow_id", "concurrent", "distinct_sources", "confidence", "severity")


# --------------------------------------------------------- exfiltration, DNS
_EXFIL = """bytes_transferred > 1048576 AND bytes_transferred / greatest(packet_count,1) > 500"""


@query("exfil_rule", f"""SELECT flow_id, bytes_transferred, 0.82::DOUBLE AS confidence,
    CASE WHEN bytes_transferred > 104857600 THEN 'critical' WHEN bytes_transferred > 10485760 THEN 'high'
      ELSE 'medium' END AS severity FROM flows_v WHERE {_EXFIL}""", ["flows_v"])
def _(v):
    return exfil.exfil_rule(v.flows).select("flow_id", "bytes_transferred", "confidence", "severity")


_TUNNEL = f"""q AS (SELECT *, flow_id AS name_id, split_part(dns_query, '.', 1) AS first FROM flows_v
    WHERE dst_port = 53 OR dns_query <> '' OR txt_query_volume IS NOT NULL),
  {_ENT.format(col='first', src='q')},
  m AS (SELECT flow_id, bytes_transferred, dst_port, length(dns_query) AS query_length,
      coalesce(list_max([length(p) for p in string_split(dns_query, '.') if p <> '']), 0) AS longest,
      coalesce(h, 0.0) AS entropy,
      CASE WHEN coalesce(query_frequency, 0) <> 0 THEN query_frequency
        ELSE packet_count / greatest(duration_seconds, 1.0) END AS qps,
      dns_qtype = 16 OR coalesce(txt_query_volume, 0) > 0 AS is_txt
    FROM q LEFT JOIN ent USING (name_id)),
  sc AS (SELECT *, (CASE WHEN longest >= 24 OR query_length >= 40 THEN 30 ELSE 0 END
      + CASE WHEN entropy >= 3.5 THEN 30 ELSE 0 END + CASE WHEN is_txt THEN 20 ELSE 0 END
      + CASE WHEN qps >= 2 AND dst_port = 53 THEN 15 ELSE 0 END
      + CASE WHEN bytes_transferred >= 40000 AND dst_port = 53 THEN 15 ELSE 0 END) AS points FROM m)"""


@query("dns_tunnel_score", f"""WITH {_TUNNEL} SELECT flow_id, round(entropy, 6) AS entropy,
    round(qps, 5) AS qps, least(1.0, points/100)::DOUBLE AS confidence,
    CASE WHEN points >= 70 THEN 'high' ELSE 'medium' END AS severity
  FROM sc WHERE points >= 50""", ["flows_v"])
def _(v):
    return dns.dns_tunnel_score(v.flows).select(
        "flow_id", F.round("entropy", 6).alias("entropy"), F.round("qps", 5).alias("qps"),
        "confidence", "severity")


# ------------------------------------------------------------- all detectors
def _on_traffic(sql: str) -> str:
    return sql.replace("flows_v", "traffic_v").replace("periodic_v", "contacts")


_CV = "flow_id, round(cv, 4) AS cv, confidence, CASE WHEN confidence > 0.5 THEN 'high' ELSE 'medium' END AS severity"


def _lives(source: str, key: str, column: str, idle: float | None) -> str:
    """Rows of ``source`` whose ``column`` also names the life of the key's state."""
    if idle is None:
        return f"SELECT * FROM {source}"
    line = f"OVER (PARTITION BY {key} ORDER BY start_time, flow_id)"
    return f"""SELECT * REPLACE ({column} || '#' || life AS {column}) FROM (SELECT *, sum(opens) {line} AS life FROM (
      SELECT *, CASE WHEN start_time < lag(start_time) {line} + {idle} THEN 0 ELSE 1 END AS opens FROM {source}))"""


_DESTINATION = f"""{_beacon_sql('''dests AS (SELECT flow_id, list(start_time) OVER w AS s, min(src_ip) OVER u AS lo,
      max(src_ip) OVER u AS hi FROM sparse WINDOW
      w AS (PARTITION BY dst_ip, dst_port ORDER BY start_time, flow_id ROWS BETWEEN 127 PRECEDING AND CURRENT ROW),
      u AS (PARTITION BY dst_ip, dst_port ORDER BY start_time, flow_id ROWS UNBOUNDED PRECEDING)),
    open_rows AS (SELECT flow_id, s FROM dests WHERE lo <> hi
      AND flow_id NOT IN (SELECT flow_id FROM ph))''', 'open_rows')}"""


def detections_sql(idle: dict[str, float]) -> str:
    """No destination has both sparse flows and others, so its series are those of its sparse flows."""
    beacon_idle, scan_idle = idle.get("beacon"), idle.get("scan")
    running_ = _RUNNING.replace("flows_v", "sources")
    return f"""WITH dd AS (WITH {_on_traffic(_RATED)}, {_on_traffic(_ENTROPY)} SELECT flow_id, confidence,
      CASE WHEN rate_hit AND confidence > 0.75 THEN 'high' ELSE 'medium' END AS severity, round(h, 3) AS evidence
    FROM (SELECT flow_id, {_RATE_HIT} AS rate_hit,
        CASE WHEN {_RATE_HIT} THEN {_conf(111.0)} ELSE {_conf(20.0)} END AS confidence
      FROM rated WHERE {_RATE_HIT} OR {_AMP_HIT}) JOIN ent USING (flow_id)),
  meets AS (SELECT * FROM traffic_v WHERE dst_port <> 53),
  contacts AS ({_lives('meets', 'src_ip, dst_ip, dst_port', 'src_ip', beacon_idle)}),
  sparse AS (SELECT * FROM ({_lives('meets', 'dst_ip, dst_port', 'dst_ip', beacon_idle)})
    WHERE packet_count <= 40 AND bytes_transferred < 25000),
  sources AS ({_lives('traffic_v', 'src_ip', 'src_ip', scan_idle)}),
  bp AS (WITH {_on_traffic(_PAIR)} SELECT {_CV} FROM hits), ph AS (SELECT flow_id FROM bp),
  bd AS (WITH {_DESTINATION} SELECT {_CV} FROM hits),
  sc AS (WITH {running_} SELECT flow_id, unique_dst_ports, {_SCAN_RULE} FROM fan WHERE {_SCAN_HIT}),
  dt AS (WITH {_on_traffic(_TUNNEL)} SELECT flow_id, query_length, least(1.0, points/100)::DOUBLE AS confidence,
      CASE WHEN points >= 70 THEN 'high' ELSE 'medium' END AS severity FROM sc WHERE points >= 50),
  sl AS (WITH {_SLOW}, c AS (SELECT a.flow_id, count(*) AS concurrent FROM ok a JOIN ok b ON a.dst_ip = b.dst_ip
        AND a.dst_port = b.dst_port AND (b.start_time, b.flow_id) <= (a.start_time, a.flow_id)
        AND b.start_time <= a.slow_end AND b.slow_end >= a.start_time GROUP BY a.flow_id)
    SELECT flow_id, concurrent, round(least(0.95, 0.62 + 0.33*least(1.0, (concurrent-8)/8)), 4)::DOUBLE AS confidence
    FROM c WHERE concurrent >= 8)
  SELECT flow_id, 'ddos' AS detector, 'ddos' AS threat_class, severity, confidence, evidence::DOUBLE AS evidence FROM dd
  UNION ALL SELECT flow_id, 'beacon', 'c2_beacon', severity, confidence, cv FROM bp
  UNION ALL SELECT flow_id, 'beacon', 'c2_beacon', severity, confidence, cv FROM bd
  UNION ALL SELECT flow_id, 'scan', 'port_scan', severity, confidence, unique_dst_ports FROM sc
  UNION ALL SELECT flow_id, 'exfil', 'exfiltration', CASE WHEN bytes_transferred > 104857600 THEN 'critical'
      WHEN bytes_transferred > 10485760 THEN 'high' ELSE 'medium' END, 0.82, bytes_transferred
    FROM traffic_v WHERE {_EXFIL}
  UNION ALL SELECT flow_id, 'dns_tunnel', 'dns_tunnel', severity, confidence, NULL FROM dt
  UNION ALL SELECT flow_id, 'slow_rate', 'ddos', CASE WHEN confidence > 0.75 THEN 'high' ELSE 'medium' END, confidence,
    concurrent FROM sl"""


def detection_rows(found):
    """Verdicts with the value of the evidence that carries each detector's state."""
    names = {"ddos": "src_ip_entropy", "beacon": "inter_arrival_cv", "scan": "unique_dst_ports",
             "exfil": "outbound_bytes_abs", "slow_rate": "concurrent_slow_connections"}
    wanted = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("detector")]
    value = F.get(F.filter("evidence", lambda e: e["feature_name"] == wanted), F.lit(0))["value"]
    return found.select("flow_id", "detector", "threat_class", "severity", "confidence", value.alias("evidence"))
