"""Null keys, repeats and mixed case neither lose, split nor multiply rows."""

from pyspark.sql import functions as F

from taplight.operators import flows as FL, lifecycle as L, scan, slow_rate
from taplight.plans.views import Views

SF = "/root/testdata/sf0.001"


def _holes(df, *columns):
    odd = F.pmod(F.xxhash64("start_time" if "start_time" in df.columns else "ts"), F.lit(3)) == 0
    return df.withColumns({c: F.when(odd, F.lit(None)).otherwise(F.col(c)) for c in columns})


def test_fanout_keeps_every_flow(spark):
    flows = _holes(Views(spark, SF).flows, "src_ip", "dst_port")
    n = flows.count()
    assert scan.scan_fanout_running(flows).count() == n
    assert scan.scan_fanout_running(flows.unionByName(flows)).count() == 2 * n


def test_slow_rate_repeats_do_not_multiply(spark):
    found = slow_rate.slow_rate_candidate(Views(spark, SF).flows)
    n = found.count()
    assert slow_rate.slow_rate_concurrency(found.unionByName(found)).count() <= 2 * n


def test_merge_counts_every_alert(spark):
    alerts = _holes(Views(spark, SF).alerts, "protocol", "source_ip")
    merged = L.merge_alerts(alerts)
    assert merged.agg(F.sum("n_detections")).first()[0] == alerts.count()
    batch = L.coalesce_batch(alerts)
    assert batch.where("evidence is null").count() == 0


def test_mixed_case_protocol_is_one_flow(spark):
    packets = Views(spark, SF).packets
    mixed = packets.withColumn("protocol", F.when(F.col("packet_id") % 2 == 0, F.upper("protocol")).otherwise(
        F.col("protocol")))
    assert FL.build_flows(mixed).count() == FL.build_flows(packets).count()
