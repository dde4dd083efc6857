"""Questions over the alert and flow tables.

Grouped answers combine map-side; ordered ones are top-k (``orderBy().limit()``), which
keeps only k rows per task. Every order ends in a unique column, so ties are stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from .lifecycle import evidence_value


def _n() -> Column:
    return F.count(F.lit(1))


def _of_class(alerts: DataFrame, *classes: str) -> DataFrame:
    return alerts.where(F.lower("threat_class").isin(*classes))


def _share(n: str, scale: int | None) -> Column:
    """Percentage of the (small, already grouped) table's total."""
    value = F.col(n) * 100.0 / F.sum(n).over(Window.partitionBy())
    return value if scale is None else F.round(value, scale)


def _severe() -> Column:
    return F.lower("severity").isin("high", "critical")


def display_class() -> Column:
    names = F.create_map(*[F.lit(x) for kv in S.DISPLAY_CLASS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.col("threat_class")), F.col("threat_class"))


def newest(alerts: DataFrame, limit: int) -> DataFrame:
    return alerts.orderBy(F.desc("ts"), F.desc("alert_id")).limit(limit)


# ------------------------------------------------------------------- listings
def list_threats(alerts: DataFrame, severity: str | None = None, threat_class: str | None = None,
                 limit: int = 100) -> DataFrame:
    if severity:
        alerts = alerts.where(F.lower("severity") == severity.lower())
    if threat_class:
        alerts = alerts.where(F.lower("threat_class") == threat_class.lower())
    return newest(alerts, limit)


def alert_by_id(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.where(F.col("alert_id") == alert_id)


def _confident(alerts: DataFrame, threat_class: str, limit: int) -> DataFrame:
    tie = "flow_id" if "flow_id" in alerts.columns else "alert_id"
    return _of_class(alerts, threat_class).orderBy(F.desc("confidence"), tie).limit(limit)


def dga_detections(alerts: DataFrame, limit: int = 100) -> DataFrame:
    return _confident(alerts, "dga", limit)


def dns_tunnel_detections(alerts: DataFrame, limit: int = 100) -> DataFrame:
    return _confident(alerts, "dns_tunnel", limit)


def port_scans(alerts: DataFrame, limit: int = 100) -> DataFrame:
    return _confident(alerts, "port_scan", limit)


def tls_fingerprints(alerts: DataFrame, limit: int = 100) -> DataFrame:
    return _confident(alerts, "tls_malware", limit)


def exfil_anomalies(alerts: DataFrame, limit: int = 100) -> DataFrame:
    return _of_class(alerts, "exfiltration").orderBy(
        F.desc("bytes_transferred"), "alert_id").limit(limit)


def tls_malware_recent(alerts: DataFrame, limit: int = 100) -> DataFrame:
    return newest(_of_class(alerts, "tls_malware"), limit)


# --------------------------------------------------------------------- traffic
def traffic_stats(rows: DataFrame) -> DataFrame:
    totals = rows.agg(_n().alias("total_flows"),
                      F.coalesce(F.sum("bytes_transferred"), F.lit(0)).alias("total_bytes"),
                      F.coalesce(F.sum("packet_count"), F.lit(0)).alias("total_packets"))
    n = F.greatest("total_flows", F.lit(1))
    return totals.withColumns({
        "avg_bytes_per_flow": F.floor(F.col("total_bytes") / n),
        "avg_packets_per_flow": F.floor(F.col("total_packets") / n)})


def top_talkers_bytes(rows: DataFrame, source: str = "source_ip", limit: int = 10) -> DataFrame:
    return rows.groupBy(F.col(source).alias("ip")).agg(F.sum("bytes_transferred").alias("bytes")) \
               .orderBy(F.desc("bytes"), "ip").limit(limit)


def protocol_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("protocol").agg(_n().alias("count")).orderBy(F.desc("count"), "protocol")


def protocol_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("protocol").agg(_n().alias("n")) \
               .select("protocol", _share("n", 1).alias("percent"))


def top_dst_ports(flows: DataFrame, limit: int = 8) -> DataFrame:
    counted = flows.groupBy("dst_port", "protocol").agg(_n().alias("n"))
    total = flows.agg(_n().alias("_total"))
    top = counted.orderBy(F.desc("n"), "dst_port", "protocol").limit(limit)
    return top.join(F.broadcast(total)).select(         # one row by construction
        "dst_port", "protocol", "n", (F.col("n") * 100.0 / F.col("_total")).alias("percent"))


def traffic_summary(alerts: DataFrame, recent: int = 500) -> DataFrame:
    duration = newest(alerts, recent).where(F.col("duration_seconds").isNotNull()) \
        .agg(F.coalesce(F.avg("duration_seconds"), F.lit(0.0)).alias("avg_duration"))
    return traffic_stats(alerts).select("total_flows", "total_bytes", "total_packets") \
                                .join(F.broadcast(duration))


def headline_metrics(alerts: DataFrame, seconds: float) -> DataFrame:
    mbps = F.round(F.sum("bytes_transferred") / seconds * 8 / 1e6, 2)
    return alerts.agg(_n().alias("total_detections"), F.count_if(_severe()).alias("active_threats"),
                      mbps.alias("throughput_mbps"))


# ------------------------------------------------------------------ breakdowns
def alert_stats(alerts: DataFrame) -> DataFrame:
    """Counts by class and by severity, all four severities listed."""
    counted = alerts.groupingSets(
        [("threat_class",), ("severity",)], "threat_class", "severity").agg(_n().alias("n"))
    by_class = counted.where(F.col("threat_class").isNotNull()) \
        .select(F.lit("threat_class").alias("kind"), F.col("threat_class").alias("value"), "n")
    levels = alerts.sparkSession.createDataFrame([(s,) for s in S.SEVERITIES], "value string")
    by_level = levels.join(counted.where(F.col("severity").isNotNull()),
                           F.col("value") == F.col("severity"), "left") \
        .select(F.lit("severity").alias("kind"), "value", F.coalesce("n", F.lit(0)).alias("n"))
    return by_class.unionByName(by_level)


def severity_distribution(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(_n().alias("count")) \
                 .withColumn("percentage", _share("count", None))


def detection_mix(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(display_class().alias("cls")).agg(_n().alias("count")) \
                 .orderBy(F.desc("count"), "cls")


def annotated_talkers(alerts: DataFrame, limit: int = 10) -> DataFrame:
    """Top talkers with what was detected from each."""
    top = top_talkers_bytes(alerts, limit=limit)
    notes = alerts.groupBy(F.col("source_ip").alias("ip")).agg(
        F.sum("packet_count").alias("pkts"), _n().alias("flows"),
        F.array_sort(F.collect_set(display_class())).alias("classes"),
        F.coalesce(F.bool_or(_severe()), F.lit(False)).alias("flagged"))
    return top.join(notes, "ip", "left").select(
        "ip", "bytes", F.coalesce("pkts", F.lit(0)).alias("pkts"),
        F.coalesce("flows", F.lit(0)).alias("flows"),
        F.when(F.size("classes") > 0, F.array_join("classes", ", "))
         .otherwise("No detections").alias("note"), F.coalesce("flagged", F.lit(False)).alias("flagged"))


# --------------------------------------------------------------- class reports
def dns_analytics(alerts: DataFrame) -> DataFrame:
    """Headline figures of the name detectors (top sources and samples are listings)."""
    entropy = F.when(F.lower("threat_class") == "dga", evidence_value("domain_entropy"))
    positive = F.when(entropy > 0, entropy)
    return alerts.agg(
        F.count_if(F.lower("threat_class") == "dga").alias("dga_detections"),
        F.count_if(F.lower("threat_class") == "dns_tunnel").alias("tunnel_detections"),
        F.count_if(F.lower("threat_class").isin("dga", "dns_tunnel")).alias("total"),
        F.round(F.avg(positive), 3).alias("mean_domain_entropy"),
        F.count(positive).alias("entropy_samples"))


def dns_top_sources(alerts: DataFrame, limit: int = 10) -> DataFrame:
    return _of_class(alerts, "dga").groupBy("source_ip").agg(_n().alias("detections")) \
        .orderBy(F.desc("detections"), "source_ip").limit(limit)


def dns_samples(alerts: DataFrame, limit: int = 25) -> DataFrame:
    return _of_class(alerts, "dga").orderBy("ts", "alert_id").limit(limit).select(
        "alert_id", "source_ip", "destination_ip",
        evidence_value("domain_entropy").alias("domain_entropy"),
        evidence_value("bigram_likelihood").alias("bigram_likelihood"),
        F.round("confidence", 4).alias("confidence"), "severity")


def tls_analytics(alerts: DataFrame) -> DataFrame:
    tls = F.lower("threat_class") == "tls_malware"
    return alerts.agg(F.count_if(tls).alias("sessions_flagged"),
                      F.count_if(tls & _severe()).alias("malware_verdicts"))


def tls_samples(alerts: DataFrame, limit: int = 25) -> DataFrame:
    return _of_class(alerts, "tls_malware").orderBy("ts", "alert_id").limit(limit).select(
        "alert_id", "flow_id", "source_ip", "destination_ip",
        evidence_value("extensions_count").alias("extensions_count"),
        evidence_value("ciphers_count").alias("ciphers_count"),
        F.round("confidence", 4).alias("confidence"), "severity")


def recon_summary(alerts: DataFrame) -> DataFrame:
    return _of_class(alerts, "port_scan").agg(
        _n().alias("total"), F.countDistinct("source_ip").alias("active"))


def recon_rows(alerts: DataFrame, limit: int = 25) -> DataFrame:
    return port_scans(alerts, limit).select(
        F.col("source_ip").alias("src"),
        F.round(evidence_value("unique_dst_ports")).cast("bigint").alias("ports"),
        F.round(evidence_value("unique_dst_hosts")).cast("bigint").alias("hosts"),
        F.round("duration_seconds").cast("bigint").alias("dur"),
        F.concat(F.upper("protocol"), F.lit(" scan")).alias("tech"))


def _out_bytes() -> Column:
    listed = F.nullif(F.col("bytes_transferred"), F.lit(0)).cast("double")
    return F.coalesce(listed, evidence_value("total_bytes_transferred"))


def exfil_summary(alerts: DataFrame) -> DataFrame:
    return _of_class(alerts, "exfiltration").agg(
        _n().alias("total"), F.coalesce(F.sum(_out_bytes()), F.lit(0.0)).alias("bytes"))


def exfil_rows(alerts: DataFrame, limit: int = 25) -> DataFrame:
    return exfil_anomalies(alerts, limit).select(
        F.col("source_ip").alias("src"), F.col("destination_ip").alias("dst"),
        _out_bytes().alias("out"), "confidence")


def exfil_deviation(alerts: DataFrame) -> DataFrame:
    ratio = F.col("bytes_transferred") / (10 * S.MIB)
    return _of_class(alerts, "exfiltration").withColumns(
        {"byte_ratio": ratio, "deviation": ratio - 1})


def exfil_top_sources(alerts: DataFrame, limit: int = 8) -> DataFrame:
    return exfil_deviation(alerts).groupBy(F.col("source_ip").alias("ip")).agg(
        _n().alias("count"), F.sum("bytes_transferred").alias("total_bytes"),
        F.greatest(F.lit(0.0), F.max("byte_ratio")).alias("max_ratio"),
        F.greatest(F.lit(0.0), F.max("deviation")).alias("max_deviation")) \
        .orderBy(F.desc("total_bytes"), "ip").limit(limit)


def exfil_protocol_breakdown(alerts: DataFrame) -> DataFrame:
    return _of_class(alerts, "exfiltration").groupBy("protocol").agg(
        _n().alias("count"), F.sum("bytes_transferred").alias("total_bytes")) \
        .withColumn("percentage", _share("count", 0).cast("bigint"))


def exfil_direction_summary(rows: DataFrame) -> DataFrame:
    """``rows`` carry a ``direction`` and a ``deviation`` column."""
    out = F.col("direction") == "outbound"
    return rows.agg(F.count_if(out).alias("outbound"),
                    F.count_if(F.col("direction") == "inbound").alias("inbound"),
                    F.coalesce(F.max("deviation"), F.lit(0.0)).alias("max_deviation"),
                    F.coalesce(F.sum(F.when(out, F.col("bytes_transferred"))), F.lit(0))
                     .alias("outbound_bytes"))


def weighted_distribution(rows: DataFrame, value: str, weight: str,
                          limit: int | None = None) -> DataFrame:
    """Weighted counts of a column with whole-number shares of the total."""
    out = rows.groupBy(value).agg(F.sum(weight).alias("count")) \
              .withColumn("percentage", _share("count", 0).cast("bigint"))
    return out.orderBy(F.desc("count"), value).limit(limit) if limit else out


def cipher_distribution(fingerprints: DataFrame) -> DataFrame:
    return weighted_distribution(fingerprints, "cipher_suite", "connections", 8)


def tls_version_distribution(fingerprints: DataFrame) -> DataFrame:
    return weighted_distribution(fingerprints, "tls_version", "connections")


def fingerprint_uniques(fingerprints: DataFrame, exact: bool = True) -> DataFrame:
    distinct = F.countDistinct if exact else F.approx_count_distinct
    return fingerprints.agg(distinct("ja3").alias("unique_ja3"), distinct("ja4").alias("unique_ja4"),
                            F.sum("connections").alias("connections"))


def fingerprint_sketches(fingerprints: DataFrame, *parts: str, precision: int = 14) -> DataFrame:
    """A roll-up row for each combination of ``parts`` (an hour, say), with sketches of the
    fingerprints seen and the sum of connections. Rows can be stored and merged later."""
    return fingerprints.groupBy(*parts).agg(
        F.hll_sketch_agg("ja3", precision).alias("ja3_sketch"), F.hll_sketch_agg("ja4", precision).alias("ja4_sketch"),
        F.sum("connections").alias("connections"))


def fingerprint_uniques_merged(sketches: DataFrame, *parts: str) -> DataFrame:
    """Distinct fingerprints from stored sketches, within 2 % with the usual precision of 14 (three
    standard errors), over all rows or by ``parts``. No fingerprint is read again."""
    return sketches.groupBy(*parts).agg(
        F.hll_sketch_estimate(F.hll_union_agg("ja3_sketch")).alias("unique_ja3"),
        F.hll_sketch_estimate(F.hll_union_agg("ja4_sketch")).alias("unique_ja4"),
        F.sum("connections").alias("connections"))


def scan_type_distribution(scans: DataFrame) -> DataFrame:
    return scans.groupBy("scan_type").agg(_n().alias("count")) \
                .withColumn("percentage", _share("count", None))


def entropy_band(entropy: Column) -> Column:
    return F.when(entropy > 3.5, "high").when(entropy >= 3.0, "medium").otherwise("low")


def entropy_band_filter(rows: DataFrame, entropy: str = "entropy", queries: str = "queries"
                        ) -> DataFrame:
    return rows.groupBy(entropy_band(F.col(entropy)).alias("band")).agg(
        _n().alias("names"), F.sum(queries).alias("queries"))


# --------------------------------------------------------------------- reports
def report_filter(alerts: DataFrame, threat_class: str | None = None,
                  report_type: str | None = None, severity: str | None = None,
                  limit: int = 100) -> DataFrame:
    """Exact-match filters, newest first; a report type that names a class filters by it."""
    wanted = threat_class or (report_type if report_type in S.THREAT_CLASSES else None)
    if wanted:
        alerts = alerts.where(F.col("threat_class") == wanted)
    if severity:
        alerts = alerts.where(F.col("severity") == severity)
    return newest(alerts, limit)


def report_summary(alerts: DataFrame, **filters) -> DataFrame:
    """Counts per severity of the rows that made the report, after its limit."""
    return report_filter(alerts, **filters).agg(*[
        F.count_if(F.col("severity") == s).alias(s) for s in S.SEVERITIES], _n().alias("total"))


REPORT_COLUMNS = ("alert_id", "ts", "threat_class", "severity", "confidence", "source_ip",
                  "source_port", "destination_ip", "destination_port", "protocol",
                  "bytes_transferred", "packet_count", "duration_seconds")


def report_rows(alerts: DataFrame, include_evidence: bool = True,
                include_raw_features: bool = False, **filters) -> DataFrame:
    extra = [F.to_json("evidence").alias("evidence")] if include_evidence else []
    extra += [F.to_json("raw_features").alias("raw_features")] if include_raw_features else []
    return report_filter(alerts, **filters).select(*REPORT_COLUMNS, *extra)


# ---------------------------------------------------------------------- search
def alert_rates(alerts: DataFrame) -> DataFrame:
    dur = F.greatest("duration_seconds", F.lit(1.0))
    return alerts.withColumns({"packets_per_second": F.col("packet_count") / dur,
                               "bits_per_second": F.col("bytes_transferred") * 8 / dur})


def _any_contains(needle: str, *columns: str) -> Column:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(needle.lower()), F.lit(False))
    return hit


def alert_filter_sort(alerts: DataFrame, text: str = "", threat_class: str | None = None,
                      severity: str | None = None, status: str | None = None,
                      sort_by: str = "ts", ascending: bool = False) -> DataFrame:
    out = alerts
    if text:
        out = out.where(_any_contains(text, "source_ip", "destination_ip", "threat_class",
                                      "flow_id", "alert_id"))
    for column, value in (("threat_class", threat_class), ("severity", severity),
                          ("status", status)):
        if value:
            out = out.where(F.col(column) == value)
    key = F.col(sort_by)
    return out.orderBy(key.asc() if ascending else key.desc(), "alert_id")


def quick_search(alerts: DataFrame, text: str, limit: int = 20) -> DataFrame:
    return alerts.where(_any_contains(text, "source_ip", "destination_ip", "threat_class",
                                      "severity", "protocol")).orderBy("alert_id").limit(limit)


# Alert states a search can name.
_STATUSES = ("new", "investigating", "resolved", "false_positive")


def alert_search(alerts: DataFrame, text: str, limit: int = 15) -> DataFrame:
    """Ranked hits in tiers; an alert counts in the first tier that still has room for it.

    ``alerts`` carry ``status``, ``domain`` and ``ja3``. A tier takes a few rows at most, so
    its candidates are a top-k of its own quota plus all earlier quotas. Those few
    candidates, a fixed number whatever the table holds, are then walked in tier order.
    """
    q = text.strip().lower()
    digits = q.replace("thr", "", 1).lstrip("- ") if q.startswith("thr") else ""
    whole = F.lower(F.concat_ws(" ", "alert_id", "source_ip", "destination_ip", "threat_class",
                                "severity", "status", "protocol", "flow_id",
                                F.nullif("domain", F.lit("")), F.nullif("ja3", F.lit(""))))
    # (relevance, condition, quota, only the newest match counts)
    tiers: list[tuple[int, Column, int, bool]] = []
    if digits.isdigit():
        tiers.append((100, F.col("alert_id").contains(digits), 1, False))
    tiers += [(90, (F.lower("source_ip") == q) | (F.lower("destination_ip") == q), limit, False),
              (85, F.lower("domain") == q, 1, True), (80, F.lower("ja3") == q, 1, True)]
    tiers += [(70, F.col("threat_class") == c, 3, False) for c in S.THREAT_CLASSES
              if q in S.DISPLAY_CLASS[c].lower() or q in c]
    tiers += [(60, F.col("severity") == s, 2, False) for s in S.SEVERITIES if q in s]
    tiers += [(55, F.col("status") == s, 2, False) for s in _STATUSES
              if q in s or q in s.replace("_", " ")]
    tiers.append((50, whole.contains(q), 20, False))
    parts, room = [], 0
    for rank, (relevance, hit, quota, newest_only) in enumerate(tiers):
        room += quota
        order = F.desc("alert_id") if newest_only else F.asc("alert_id")
        parts.append(alerts.where(hit & F.lit(bool(q))).orderBy(order)
                     .limit(1 if newest_only else room)
                     .select(F.lit(rank).alias("rank"), "alert_id",
                             F.lit(quota).alias("quota"), F.lit(relevance).alias("relevance")))
    candidates = parts[0]
    for part in parts[1:]:
        candidates = candidates.unionByName(part)
    queue = candidates.agg(F.array_sort(F.collect_list(
        F.struct("rank", "alert_id", "quota", "relevance"))).alias("queue"))

    def walk(taken, c):
        used = F.size(F.filter(taken, lambda t: t["rank"] == c["rank"]))
        known = F.exists(taken, lambda t: t["alert_id"] == c["alert_id"])
        closed = (c["relevance"] == 50) & (F.size(F.filter(
            taken, lambda t: t["relevance"] > 50)) >= 5)
        return F.when(known | closed | (used >= c["quota"]), taken) \
                .otherwise(F.array_append(taken, c))

    empty = F.array().cast("array<struct<rank:int,alert_id:string,quota:int,relevance:int>>")
    found = queue.select(F.inline(F.aggregate("queue", empty, walk)))
    return found.orderBy("rank", "alert_id").limit(limit).select("alert_id", "relevance")
