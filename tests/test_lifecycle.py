"""Alert merge, severity, evidence and status rules."""

import random

import pytest
from pyspark.sql import functions as F

from taplight import schemas
from taplight.operators import lifecycle as L, reports as R

_BASE = dict(flow_id="f", threat_class="ddos", severity="low", confidence=0.5, source_ip="10.0.0.1",
             source_port=1, destination_ip="10.0.0.2", destination_port=80, protocol="tcp",
             bytes_transferred=10, packet_count=1, duration_seconds=1.0, evidence=[("rate", 1.0, 0.5, "d")],
             model_version="v", raw_features={})


def alerts(spark, rows):
    full = [{**_BASE, "alert_id": f"a{i:03d}", "ts": 0.0, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f.name] for f in schemas.ALERTS.fields) for r in full],
                                 schemas.ALERTS)


def test_merge_window_is_anchored(spark):
    df = alerts(spark, [dict(ts=0.0), dict(ts=200.0), dict(ts=299.0), dict(ts=300.0), dict(ts=450.0)])
    got = sorted((r.alert_id, r.n_detections) for r in L.merge_alerts(df).collect())
    assert got == [("a000", 3), ("a003", 2)]


def test_merge_takes_best_confidence_and_first_evidence(spark):
    df = alerts(spark, [
        dict(ts=0.0, confidence=0.3, evidence=[("x", 1.0, 0.5, "first"), ("y", 1.0, 0.1, "y")]),
        dict(ts=9.0, confidence=0.8, source_ip="10.0.0.1", evidence=[("x", 2.0, 0.9, "second"),
                                                                       ("z", 3.0, 0.2, "z")])])
    row = L.merge_alerts(df).first()
    assert (row.confidence, row.severity, row.alert_id) == (0.8, "critical", "a000")
    assert [(e.feature_name, e.value) for e in row.evidence] == [("x", 1.0), ("y", 1.0), ("z", 3.0)]


def test_single_alert_keeps_its_severity(spark):
    assert L.merge_alerts(alerts(spark, [dict(severity="medium", confidence=0.9)])).first().severity \
        == "medium"


def test_case_of_addresses_does_not_split_a_group(spark):
    df = alerts(spark, [dict(ts=0.0, source_ip="FE80::A"), dict(ts=1.0, source_ip="fe80::a")])
    assert L.merge_alerts(df).first().n_detections == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_pre_merge_keeps_totals(spark, seed):
    """Coalescing before the merge leaves every detection counted once."""
    rng = random.Random(seed)
    rows = [dict(ts=float(rng.randrange(900)), source_ip=f"10.0.0.{rng.randrange(3)}",
                 confidence=rng.random()) for _ in range(60)]
    df = alerts(spark, rows).withColumn("batch", F.floor(F.col("ts") / 300))
    pre = L.coalesce_batch(df, ["batch"])
    assert pre.agg(F.sum("coalesced")).first()[0] == 60
    merged = L.merge_alerts(pre.drop("batch"))
    direct = L.merge_alerts(df.drop("batch"))
    for out in (merged, direct):
        assert out.agg(F.sum("n_detections")).first()[0] == 60
    best = [r[0] for r in direct.groupBy("source_ip").agg(F.max("confidence").alias("c"))
            .orderBy("source_ip").select("c").collect()]
    assert best == [r[0] for r in merged.groupBy("source_ip").agg(F.max("confidence").alias("c"))
                    .orderBy("source_ip").select("c").collect()]


@pytest.mark.parametrize("cls,conf,level", [
    ("ddos", 0.75, "critical"), ("ddos", 0.74, "high"), ("ddos", 0.54, "medium"),
    ("port_scan", 0.9, "high"), ("port_scan", 0.4, "medium"), ("port_scan", 0.39, "low"),
    ("dns_tunnel", 0.8, "critical"), ("dga", 0.6, "high"), ("c2_beacon", 0.65, "critical")])
def test_severity_scorer(spark, cls, conf, level):
    row = spark.range(1).select(L.severity_scorer(F.lit(conf), F.lit(cls)).alias("s")).first()
    assert row.s == level


@pytest.mark.parametrize("sev,conf,level", [
    ("low", 0.8, "high"), ("medium", 0.8, "high"), ("low", 0.6, "medium"), ("low", 0.59, "low"),
    ("medium", 0.7, "medium"), ("critical", 0.9, "critical")])
def test_finalize_severity(spark, sev, conf, level):
    row = spark.range(1).select(L.finalize_severity(F.lit(sev), F.lit(conf)).alias("s")).first()
    assert row.s == level


def test_same_flow_dedup_adds_new_evidence_only_with_more_confidence(spark):
    df = alerts(spark, [
        dict(confidence=0.6, evidence=[("a", 1.0, 0.5, "a")]),
        dict(confidence=0.5, evidence=[("b", 1.0, 0.5, "b")]),
        dict(flow_id="g", confidence=0.6, evidence=[("a", 1.0, 0.5, "a")]),
        dict(flow_id="g", confidence=0.7, evidence=[("a", 9.0, 0.5, "a"), ("b", 1.0, 0.5, "b")])])
    tagged = df.withColumn("detector", F.when(F.col("alert_id").isin("a000", "a002"), "ddos")
                           .otherwise("slow_rate"))
    got = {r.flow_id: (r.alert_id, r.confidence, [(e.feature_name, e.value) for e in r.evidence])
           for r in L.dedup_within_flow(tagged).collect()}
    assert got == {"f": ("a000", 0.6, [("a", 1.0)]), "g": ("a002", 0.7, [("a", 1.0), ("b", 1.0)])}


def test_validation_lists_broken_rules(spark):
    df = alerts(spark, [dict(), dict(confidence=1.2, protocol="gre"), dict(evidence=[]),
                        dict(evidence=[(f"e{i}", 1.0, 0.1, "d") for i in range(7)]),
                        dict(threat_class="worm", evidence=[("x", None, 0.1, "d")])])
    got = {r.alert_id: r.errors for r in L.validate_alerts(df).collect()}
    assert got["a000"] == [] and got["a001"] == ["confidence out of range", "protocol unknown"]
    assert got["a002"] == ["evidence count"] and got["a003"] == ["evidence count"]
    assert got["a004"] == ["threat_class unknown", "evidence fields"]


def test_explanation_and_ranking(spark):
    df = alerts(spark, [dict(evidence=[("a", 1.0, 0.1, "low"), ("b", 1.0, 0.9, "top"),
                                       ("c", 1.0, 0.5, "mid"), ("d", 1.0, 0.5, "later")]),
                        dict(evidence=[])])
    got = [r[0] for r in df.orderBy("alert_id").select(L.explain_alert(F.col("evidence"))).collect()]
    assert got == ["top. mid. later.", "Alert raised by detection system"]


def test_push_budget(spark):
    df = alerts(spark, [dict(ts=5.0 + i / 1000) for i in range(10)] + [dict(ts=6.0)])
    got = {r.second: (r.pushed, r.suppressed) for r in L.push_rate_limit(df, 4).collect()}
    assert got == {5: (4, 6), 6: (1, 0)}
    assert sorted(r.alert_id for r in L.pushed_alerts(df, 4).collect()) \
        == ["a000", "a001", "a002", "a003", "a010"]


def search(spark, rows, text):
    df = alerts(spark, rows).withColumns({
        "status": F.lit("new"), "ja3": F.lit(""),
        "domain": F.when(F.col("alert_id") == "a004", "evil.example").otherwise("")})
    return [(r.alert_id, r.relevance) for r in R.alert_search(df, text).collect()]


def test_search_tiers(spark):
    rows = [dict(threat_class="dga") for _ in range(8)] + [dict(severity="high")]
    assert search(spark, rows, "evil.example") == [("a004", 85)]
    assert search(spark, rows, "THR-007") == [("a007", 100)]
    dga = search(spark, rows, "dga")
    assert dga[:3] == [("a000", 70), ("a001", 70), ("a002", 70)]
    assert [x[1] for x in dga[3:]] == [50] * 5
    assert search(spark, rows, "high") == [("a008", 60)]
    assert search(spark, rows, "10.0.0.1")[0] == ("a000", 90)
    assert search(spark, rows, "  ") == []
    # A hit takes its best tier and is not listed again; quotas leave room for later tiers.
    every = search(spark, rows, "e")
    assert len({a for a, _ in every}) == len(every)


def test_report_counts_after_the_limit(spark):
    df = alerts(spark, [dict(ts=float(i), severity="high" if i > 3 else "low") for i in range(6)])
    row = R.report_summary(df, limit=3)
    assert row.first().asDict() == {"critical": 0, "high": 2, "medium": 0, "low": 1, "total": 3}


def test_alert_stats_lists_every_level(spark):
    got = {(r.kind, r.value): r.n for r in R.alert_stats(alerts(spark, [dict(), dict()])).collect()}
    assert got == {("threat_class", "ddos"): 2, ("severity", "low"): 2, ("severity", "medium"): 0,
                   ("severity", "high"): 0, ("severity", "critical"): 0}
