"""From detections to stored alerts: severity, merge, evidence, status."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..session import cut_lineage
from . import beacon, ddos, dns, exfil, scan, slow_rate
from .common import IDENTITY, join_null_safe, with_copy_number
from .ordered import anchored_groups

# Rank of a detector when one flow raises the same class twice.
DETECTOR_ORDER = ("ddos", "ddos_forest", "beacon", "dga", "tls", "scan", "exfil",
                  "dns_tunnel", "slow_rate")
MERGE_KEY = ("threat_class", "source_ip", "destination_ip", "protocol")


def detect_all(flows: DataFrame, learned: Sequence[DataFrame] = (),
               idle: Mapping[str, float] | None = None) -> DataFrame:
    """Union of all detectors. ``learned`` adds model verdicts (names, TLS, forest).

    ``idle`` (``settings.STATE_IDLE_SECONDS``, say) drops what a quiet source or pair had shown, as a
    stream does; without it a table's whole history counts.
    """
    quiet = idle or {}
    # Two detectors join by copy number; the flows are numbered and stored once for both.
    numbered = cut_lineage(with_copy_number(flows, IDENTITY))
    parts = [ddos.ddos_of_numbered(numbered), beacon.beacon_of_numbered(numbered, quiet.get("beacon")),
             scan.scan_detect(flows, quiet.get("scan")),
             exfil.exfil_detect(flows), dns.dns_tunnel_detect(flows)]
    if "timestamps" in flows.columns:
        parts.append(slow_rate.slow_rate_detect(flows))
    return reduce(DataFrame.unionByName, [*parts, *learned])


def assign_severity(threat_class: Column, confidence: Column, detector_severity: Column) -> Column:
    """Class-specific cut; scan and TLS verdicts keep their detector's severity."""
    # Confidence above which a class rates high.
    cuts = {"ddos": 0.6, "c2_beacon": 0.5, "dga": 0.6, "exfiltration": 0.5}
    out = F.when(threat_class.isin("port_scan", "tls_malware"), detector_severity)
    for name, cut in cuts.items():
        out = out.when(threat_class == name,
                       F.when(confidence > cut, "high").otherwise("medium"))
    return out.otherwise("low")


def finalize_severity(severity: Column, confidence: Column) -> Column:
    """High confidence lifts a low verdict."""
    level = F.coalesce(severity, F.lit("low"))
    return F.when((confidence >= 0.8) & level.isin("low", "medium"), "high") \
            .when((confidence >= 0.6) & (confidence < 0.8) & (level == "low"), "medium") \
            .otherwise(level)


def clip_confidence(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def to_alerts(found: DataFrame) -> DataFrame:
    """Alert rows: stable id, final severity, the detector's own severity kept beside it."""
    conf = clip_confidence(F.col("confidence"))
    base = assign_severity(F.col("threat_class"), conf, F.col("severity"))
    ident = F.substring(F.sha2(F.concat_ws(
        "|", "flow_id", F.col("start_time").cast("string"), "detector", "threat_class"), 256), 1, 24)
    return found.select(
        ident.alias("alert_id"), F.col("start_time").alias("ts"), "flow_id", "threat_class",
        finalize_severity(base, conf).alias("severity"), conf.alias("confidence"),
        F.col("src_ip").alias("source_ip"), F.col("src_port").alias("source_port"),
        F.col("dst_ip").alias("destination_ip"), F.col("dst_port").alias("destination_port"),
        "protocol", "bytes_transferred", "packet_count", "duration_seconds", "evidence",
        "model_version", "detector", F.col("severity").alias("detector_severity"))


def _first_by_name(items: Column) -> Column:
    """Evidence with later repeats of a name removed, order kept."""
    names = F.transform(items, lambda e: e["feature_name"])
    return F.filter(items, lambda e, i: F.array_position(names, e["feature_name"]) == i + 1)


def dedup_within_flow(alerts: DataFrame) -> DataFrame:
    """One alert per flow record, class, endpoints and protocol.

    The first detector's alert stays. A later one that is more confident raises the
    confidence and brings evidence under new names. A flow meets each detector at most
    once, so a group holds only a handful of rows.
    """
    rank = F.array_position(F.lit(list(DETECTOR_ORDER)), F.col("detector"))
    rows = alerts.withColumns({"_rank": rank, "_row": F.struct("confidence", "evidence")})
    kept = [c for c in alerts.columns if c not in ("flow_id", "ts", *MERGE_KEY)]
    grouped = rows.groupBy(
        "flow_id", "ts", "threat_class", F.lower("source_ip").alias("_s"),
        F.lower("destination_ip").alias("_d"), "protocol").agg(
        F.min_by(F.struct("source_ip", "destination_ip", *kept), "_rank").alias("_first"),
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_row"))),
                    lambda x: x["_row"]).alias("_all"))
    merged = F.aggregate(
        F.slice("_all", F.lit(2), F.size("_all")), F.get("_all", F.lit(0)),
        lambda acc, x: F.when(
            x["confidence"] > acc["confidence"],
            F.struct(x["confidence"].alias("confidence"), _first_by_name(
                F.concat(acc["evidence"], x["evidence"])).alias("evidence")))
        .otherwise(acc))
    return grouped.withColumn("_m", merged).select(
        "flow_id", "ts", "threat_class", "protocol", "_first.*", F.col("_m.confidence").alias("_conf"),
        F.col("_m.evidence").alias("_ev")) \
        .withColumns({"confidence": F.col("_conf"), "evidence": F.col("_ev")}) \
        .drop("_conf", "_ev").select(*alerts.columns)


def backfill_identity(alerts: DataFrame, flows: DataFrame) -> DataFrame:
    """Fill unknown addresses and the flow id from the flow the alert came from."""
    known = flows.groupBy("flow_id").agg(       # records of one flow share its addresses
        F.first("src_ip", True).alias("_src"), F.first("dst_ip", True).alias("_dst"))
    joined = alerts.join(known, "flow_id", "left")

    def filled(have: str, flow_value: str) -> Column:
        missing = F.col(have).isNull() | F.col(have).isin("", "0.0.0.0")
        return F.when(missing, F.coalesce(F.nullif(flow_value, F.lit("")), F.col(have))) \
                .otherwise(F.col(have))

    return joined.withColumns({
        "source_ip": filled("source_ip", "_src"), "destination_ip": filled("destination_ip", "_dst"),
        "flow_id": F.coalesce(F.nullif("flow_id", F.lit("")), F.col("alert_id")),
    }).drop("_src", "_dst").select(*alerts.columns)


def severity_scorer(confidence: Column, threat_class: Column) -> Column:
    """Class override with the highest threshold met, else the base bands."""
    # Thresholds per class, highest first.
    overrides = {
        "ddos": (("critical", 0.75), ("high", 0.55)),
        "c2_beacon": (("critical", 0.65), ("high", 0.45)),
        "exfiltration": (("critical", 0.7), ("high", 0.5)),
        "tls_malware": (("critical", 0.7), ("high", 0.5)),
        "port_scan": (("high", 0.6), ("medium", 0.4)),
    }
    cases = [((threat_class == cls) & (confidence >= cut), level)
             for cls, levels in overrides.items() for level, cut in levels]
    cases += [(confidence >= 0.8, "critical"), (confidence >= 0.6, "high"),
              (confidence >= 0.4, "medium")]
    out = F.when(*[cases[0][0], F.lit(cases[0][1])])
    for condition, level in cases[1:]:
        out = out.when(condition, level)
    return out.otherwise("low")


def combine_confidence(rule: Column, learned: Column, rule_weight: float = 0.4,
                       learned_weight: float = 0.6) -> Column:
    total = rule_weight + learned_weight
    return F.round(clip_confidence(rule * (rule_weight / total)
                                   + learned * (learned_weight / total)), 4)


def _with_merge_key(alerts: DataFrame) -> DataFrame:
    return alerts.withColumns({"_s": F.lower("source_ip"), "_d": F.lower("destination_ip")})


def _merge_groups(rows: DataFrame, group: Sequence[str], order: Sequence[str],
                  count: Column) -> DataFrame:
    """Merge each group into its first alert.

    Evidence goes through one row per (group, name) before it is gathered, so a group of
    any size contributes only as many rows as it has distinct feature names.
    """
    at = F.struct(*order)
    first = [c for c in rows.columns if c not in (*group, "evidence", "confidence", "severity")]
    heads = rows.groupBy(*group).agg(
        F.min_by(F.struct(*first), at).alias("_head"), F.max("confidence").alias("confidence"),
        F.min_by("severity", at).alias("_severity"), F.count(F.lit(1)).alias("_rows"),
        F.sum(count).alias("n_detections"))
    named = rows.select(*group, at.alias("_at"), F.posexplode("evidence").alias("_i", "_e")) \
        .groupBy(*group, F.col("_e.feature_name").alias("_name")) \
        .agg(F.min(F.struct("_at", "_i", "_e")).alias("_x")) \
        .groupBy(*group).agg(F.transform(F.array_sort(F.collect_list("_x")),
                                         lambda x: x["_e"]).alias("evidence"))
    scored = severity_scorer(F.col("confidence"), F.col("threat_class"))
    return join_null_safe(heads, named, group, "left").select(
        *group, "_head.*", "confidence", "n_detections", "evidence",
        F.when(F.col("_rows") > 1, scored).otherwise(F.col("_severity")).alias("severity"))


def merge_alerts(alerts: DataFrame, window: float = S.MERGE_WINDOW_SECONDS,
                 span_limit: int = 100_000) -> DataFrame:
    """Alerts of one class, endpoints and protocol merged within ``window`` seconds of the
    first of the group; the window never slides. Severity is re-derived once a second
    detection joins. ``n_detections`` honours a count column left by ``coalesce_batch``."""
    key = ["threat_class", "_s", "_d", "protocol"]
    keyed = _with_merge_key(alerts)
    if "coalesced" not in keyed.columns:
        keyed = keyed.withColumn("coalesced", F.lit(1).cast("bigint"))
    grouped = anchored_groups(keyed, key, "ts", ["ts", "alert_id"], window, name="group_ts",
                              span_limit=span_limit).drop("group_ts_run")
    merged = _merge_groups(grouped, [*key, "group_ts"], ["ts", "alert_id"], F.col("coalesced"))
    return merged.drop("_s", "_d", "group_ts", "coalesced")


def coalesce_batch(alerts: DataFrame, batch: Sequence[str] = ()) -> DataFrame:
    """Pre-merge within a micro-batch; ``coalesced`` keeps detection totals exact."""
    key = [*batch, "threat_class", "_s", "_d", "protocol"]
    keyed = _with_merge_key(alerts)
    merged = _merge_groups(keyed, key, ["ts", "alert_id"], F.lit(1).cast("bigint"))
    return merged.drop("_s", "_d").withColumnRenamed("n_detections", "coalesced")


def rank_evidence(items: Column) -> Column:
    """Highest contribution first; equal contributions keep their order."""
    indexed = F.transform(items, lambda e, i: F.struct(
        (-e["contribution"]).alias("k"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(indexed), lambda x: x["e"])


def top_evidence(items: Column, n: int = 6) -> Column:
    return F.slice(rank_evidence(items), 1, n)


def explain_alert(items: Column, n: int = 3) -> Column:
    joined = F.array_join(F.transform(top_evidence(items, n), lambda e: e["description"]), ". ")
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.concat(joined, F.lit("."))) \
            .otherwise("Alert raised by detection system")


def contribution_summary(items: Column) -> Column:
    return F.map_from_entries(F.transform(items, lambda e: F.struct(
        e["feature_name"], F.round(e["contribution"], 2))))


def evidence_value(name: str, default: float | None = 0.0, items: str = "evidence",
                   raw: str | None = "raw_features") -> Column:
    """Value of the named evidence item, else the raw feature, else the default."""
    found = F.get(F.filter(items, lambda e: e["feature_name"] == name), F.lit(0))["value"]
    options = [found] + ([F.try_element_at(raw, F.lit(name))] if raw else []) + [F.lit(default)]
    return F.coalesce(*options)


def validate_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts with the list of rules each one breaks."""
    rules: Mapping[str, Column] = {
        "alert_id missing": F.coalesce("alert_id", F.lit("")) == "",
        "flow_id missing": F.coalesce("flow_id", F.lit("")) == "",
        "threat_class unknown": ~F.coalesce(F.col("threat_class").isin(*S.THREAT_CLASSES),
                                            F.lit(False)),
        "severity unknown": ~F.coalesce(F.col("severity").isin(*S.SEVERITIES), F.lit(False)),
        "confidence out of range": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "evidence count": ~F.coalesce(F.size("evidence").between(1, 6), F.lit(False)),
        "evidence fields": F.exists("evidence", lambda e: e["feature_name"].isNull()
                                    | e["value"].isNull() | e["description"].isNull()
                                    | ~F.coalesce(e["contribution"].between(0, 1), F.lit(False))),
        "protocol unknown": ~F.coalesce(F.col("protocol").isin(*S.ALERT_PROTOCOLS), F.lit(False)),
        "negative counts": (F.col("bytes_transferred") < 0) | (F.col("packet_count") < 0)
                           | (F.col("duration_seconds") < 0),
    }
    return alerts.withColumn("errors", F.array_compact(F.array(*[
        F.when(broken, F.lit(rule)) for rule, broken in rules.items()])))


def active_alerts(alerts: DataFrame, max_history: int = 10_000, least: int = 1000) -> DataFrame:
    """The newest alerts a bounded active set would hold: ``max_history``, but no fewer than
    ``least``, which the alert manager's contract fixes at 1,000; 0 lifts it."""
    return alerts.orderBy(F.desc("ts"), F.desc("alert_id")).limit(max(least, max_history))


def threat_counts(alerts: DataFrame, count: str | None = None) -> DataFrame:
    n = F.count(F.lit(1)) if count is None else F.sum(count)
    return alerts.groupBy("threat_class").agg(n.alias("detections"))


def push_rate_limit(alerts: DataFrame, rate: int = S.PUSH_RATE) -> DataFrame:
    """Per second: how many new alerts are forwarded and how many are suppressed.

    Only counts are needed, so no second is ever numbered row by row.
    """
    return alerts.groupBy(F.floor("ts").alias("second")).agg(F.count(F.lit(1)).alias("n")) \
        .select("second", F.least("n", F.lit(rate)).alias("pushed"),
                F.greatest(F.col("n") - rate, F.lit(0)).alias("suppressed"))


def pushed_alerts(alerts: DataFrame, rate: int = S.PUSH_RATE) -> DataFrame:
    """The alerts themselves that fit the budget, earliest first in each second.

    A busy second is split over slots: each slot keeps its earliest ``rate``, and only
    those meet for the final cut.
    """
    slotted = alerts.withColumns({"_second": F.floor("ts"),
                                  "_slot": F.pmod(F.xxhash64("alert_id"), F.lit(64))})
    order = ["ts", "alert_id"]
    for keys in (["_second", "_slot"], ["_second"]):
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        slotted = slotted.withColumn("_n", n).where(F.col("_n") <= rate).drop("_n")
    return slotted.drop("_second", "_slot")


def latest_status(alerts: DataFrame, statuses: DataFrame) -> DataFrame:
    """Current status per alert, ``new`` where none was set."""
    current = statuses.groupBy("alert_id").agg(F.max_by("status", "updated_at").alias("status"))
    return alerts.join(current, "alert_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("new")))


def alert_notes(alerts: DataFrame, notes: DataFrame) -> DataFrame:
    """Alerts with their notes, oldest first."""
    listed = notes.groupBy("alert_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("created_at", "note"))),
        lambda x: x["note"]).alias("notes"))
    return alerts.join(listed, "alert_id", "left").withColumn(
        "notes", F.coalesce("notes", F.array().cast("array<string>")))
