"""Streaming operators give what their batch twins give, in any arrival order."""

import pytest
from pyspark.sql import functions as F

from taplight.operators import flows as FL, lifecycle, scan, slow_rate
from taplight.operators.ddos import source_ip_entropy
from taplight.plans.views import Views
from taplight.streaming import operators as ST

SF = "/root/testdata/sf0.001"


def run(spark, tmp_path, df, build, ts, parts=3, late="300000 seconds"):
    """Feed ``df`` as files in shuffled order, then a sentinel that moves the watermark."""
    folder = str(tmp_path / "in")
    rows = df.withColumn("_p", F.pmod(F.xxhash64(*[F.col(df.columns[0])]), F.lit(parts)))
    for p in range(parts):
        rows.where(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(folder)
    end = df.agg(F.max(ts)).first()[0] + 500_000
    sentinel = df.limit(1)
    for step in (0, 1, 2):
        late_row = sentinel.withColumn(ts, F.lit(end + step))
        late_row = late_row.withColumn(df.columns[0], F.lit(f"~{step}").cast(df.schema[0].dataType)
                                       if df.schema[0].dataType.simpleString() == "string"
                                       else F.lit(-1 - step).cast("bigint"))
        for c in ("src_ip", "dst_ip", "source_ip"):
            if c in df.columns:
                late_row = late_row.withColumn(c, F.lit("sentinel"))
        late_row.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    name = "t_" + tmp_path.name.replace("-", "_")
    query = build(stream, late).writeStream.format("memory").queryName(name) \
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.table(name)


def pairs(df, *cols):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r)
                  for r in df.select(*cols).collect())


def test_stream_flows_equals_export_flows(spark, tmp_path):
    packets = Views(spark, SF).packets
    cols = ("flow_id", "start_time", "end_time", "packet_count", "bytes_transferred")
    streamed = run(spark, tmp_path, packets, ST.stream_flows, "ts").where("src_ip <> 'sentinel'")
    assert pairs(streamed, *cols) == pairs(FL.export_flows(packets), *cols)


def test_stream_alerts_equals_merge_alerts(spark, tmp_path):
    alerts = Views(spark, SF).alerts
    cols = ("alert_id", "ts", "confidence", "n_detections", "severity")
    streamed = run(spark, tmp_path, alerts, ST.stream_alerts, "ts").where("source_ip <> 'sentinel'")
    assert pairs(streamed, *cols) == pairs(lifecycle.merge_alerts(alerts), *cols)


def test_stream_scan_equals_batch(spark, tmp_path):
    flows = Views(spark, SF).flows
    cols = ("flow_id", "unique_dst_ports", "unique_dst_hosts")
    streamed = run(spark, tmp_path, flows, lambda s, late: ST.ordered_fold(
        s.select("flow_id", "src_ip", "dst_ip", "dst_port", "dst_ports", "start_time",
                 F.coalesce(F.try_element_at("raw_features", F.lit("unique_dst_ports")),
                            F.lit(0.0)).alias("summary_ports"),
                 F.coalesce(F.try_element_at("raw_features", F.lit("unique_dst_hosts")),
                            F.lit(0.0)).alias("summary_hosts")),
        ["src_ip"], "start_time", "flow_id", ST.folds.ScanFanout(ttl=1e9), late), "start_time")
    streamed = streamed.where("src_ip <> 'sentinel'")
    assert pairs(streamed, *cols) == pairs(scan.scan_fanout_running(flows), *cols)


def test_stream_entropy_equals_batch(spark, tmp_path):
    flows = Views(spark, SF).flows
    streamed = run(spark, tmp_path, flows, ST.source_ip_entropy, "start_time")
    assert pairs(streamed.where("src_ip <> 'sentinel'"), "flow_id", "src_ip_entropy") \
        == pairs(source_ip_entropy(flows), "flow_id", "src_ip_entropy")


def test_stream_slow_rate_equals_batch(spark, tmp_path):
    flows = Views(spark, SF).slow
    cols = ("flow_id", "concurrent", "distinct_sources")
    streamed = run(spark, tmp_path, flows, ST.slow_rate_concurrency, "start_time")
    batch = slow_rate.slow_rate_concurrency(slow_rate.slow_rate_candidate(flows))
    assert pairs(streamed, *cols) == pairs(batch, *cols)


def test_stream_beacon_equals_batch(spark, tmp_path):
    from taplight.operators import beacon
    flows = Views(spark, SF).periodic
    streamed = run(spark, tmp_path, flows, ST.beacon_pair, "start_time")
    assert pairs(streamed, "flow_id", "confidence") \
        == pairs(beacon.beacon_pair(flows), "flow_id", "confidence")


def test_stream_detect_is_idempotent(spark, tmp_path):
    flows = Views(spark, SF).flows
    flows.coalesce(2).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "alerts")
    counts = []
    for attempt in range(2):
        stream = spark.readStream.schema(flows.schema).parquet(str(tmp_path / "in"))
        query = ST.stream_detect(stream, out, str(tmp_path / f"ck{attempt}"))
        query.awaitTermination(300)
        assert query.exception() is None
        counts.append(spark.read.parquet(out).count())
    assert counts[0] > 0 and counts[0] == counts[1]
    assert spark.read.parquet(out).select("alert_id").distinct().count() == counts[0]


if __name__ == "__main__":
    raise SystemExit(pytest.main([__file__, "-x", "-q"]))
