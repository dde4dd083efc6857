"""Readers, writers and telemetry on small files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from taplight.operators import telemetry as W
from taplight.plans.views import Views
from taplight.sources import alert_store, export_datagrams, flow_files, reference_lists as RL

SF = "/root/testdata/sf0.001"
REC = {"flow_id": "x", "src_ip": "1.1.1.1", "dst_ip": "2.2.2.2", "src_port": 1, "dst_port": 80,
       "protocol": "TCP", "packet_count": 4, "bytes_transferred": 403, "start_time": 100.0,
       "duration_seconds": 9.0, "flags": ["SYN"], "raw_features": {"a": 2, "dga_family": "fam",
                                                                     "b": "0.5"}}


def test_flow_json_shapes(spark, tmp_path):
    shapes = {"list": [REC, REC], "flows": {"flows": [REC]}, "records": {"records": [REC, REC, REC]},
              "single": REC}
    for name, body in shapes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "bad.json").write_text('[{"flow_id": ')
    rows = flow_files.read_flow_json(spark, str(tmp_path)).collect()
    assert len(rows) == 7
    assert {(r.dga_family, r.flags[0], r.raw_features["a"], r.raw_features["b"]) for r in rows} \
        == {("fam", "SYN", 2.0, 0.5)}
    assert all("dga_family" not in r.raw_features for r in rows)


def test_normalize_defaults(spark, tmp_path):
    with_series = {**REC, "timestamps": [105.0, 101.0, 103.0], "duration_seconds": 1.0}
    longer = {**with_series, "duration_seconds": 20.0}
    no_key = {k: v for k, v in REC.items() if k not in ("flow_id", "src_port")}
    (tmp_path / "a.json").write_text(json.dumps([REC, with_series, longer, no_key]))
    rows = flow_files.normalize_flows(flow_files.read_flow_json(spark, str(tmp_path))).collect()
    assert rows[0].timestamps == [100.0, 103.0, 106.0, 109.0]
    assert rows[0].packet_sizes == [100] * 4 and rows[0].dst_ports == [80]
    assert (rows[1].start_time, rows[1].end_time) == (101.0, 105.0)
    assert (rows[2].start_time, rows[2].end_time) == (101.0, 121.0)
    assert len(rows[3].flow_id) == 16 and rows[3].protocol == "tcp"


def test_alias_defaults(spark):
    df = spark.createDataFrame([("1.1.1.1", None)], "source_ip string, protocol string")
    row = flow_files.alias_fields(df).first()
    assert (row.src_ip, row.protocol, row.packet_count, row.bytes_transferred) == ("1.1.1.1", "tcp", 10, 1000)


def test_truncated_datagrams_are_skipped(spark):
    d = Views(spark, SF).datagrams
    cut = d.withColumn("payload", F.expr("substring(payload, 1, 60)"))
    assert export_datagrams.netflow_v5_decode(cut).count() == 0


@pytest.mark.parametrize("bucket", [3, 10_000])
def test_sequence_gaps_do_not_depend_on_buckets(spark, bucket):
    got = export_datagrams.export_sequence_gaps(Views(spark, SF).datagrams, bucket=bucket)
    base = export_datagrams.export_sequence_gaps(Views(spark, SF).datagrams, bucket=7)
    assert sorted(got.collect()) == sorted(base.collect())


def test_alert_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "alerts")
    alerts = Views(spark, SF).alerts
    half = alerts.where(F.col("alert_id") < "a000000500")
    alert_store.write_alerts(half, path)
    alert_store.write_alerts(alerts, path)
    alert_store.write_alerts(alerts, path)
    stored = spark.read.parquet(path)
    assert stored.count() == alerts.count() == stored.select("alert_id").distinct().count()
    newest = alert_store.read_alerts(spark, path, 5, "ddos").collect()
    want = alerts.where("threat_class = 'ddos'").orderBy(F.desc("ts"), F.desc("alert_id")).limit(5)
    assert [r.alert_id for r in newest] == [r.alert_id for r in want.collect()]
    assert newest[0].evidence[0].feature_name in ("packet_rate", "byte_rate")
    assert newest[0].raw_features["extensions_count"] >= 0


def test_report_exports(spark, tmp_path):
    alerts = Views(spark, SF).alerts
    alert_store.export_report_csv(alerts, str(tmp_path / "csv"), threat_class="dga", limit=7)
    rows = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()
    assert len(rows) == 7 and json.loads(rows[0].evidence)[1]["feature_name"] == "domain_entropy"
    alert_store.export_report_json(alerts, str(tmp_path / "json"), severity="high", limit=3)
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_name_lists(spark, tmp_path):
    (tmp_path / "good.txt").write_text("Google.com\n\n example.org \ngoogle.com\n")
    (tmp_path / "dga.csv").write_text("domain,class,subclass,host\nqzx,dga,fam,h\nexample,dga,fam,h\n")
    good = RL.read_name_list(spark, str(tmp_path / "good.txt"), 0)
    corpus = RL.merge_corpus([good, RL.read_name_csv(spark, str(tmp_path / "dga.csv"))])
    got = {r.domain: (r.label, r.family) for r in corpus.collect()}
    assert got == {"google": (0, None), "example": (0, None), "qzx": (1, "fam")}
    (tmp_path / "ja3.json").write_text(json.dumps([
        {"ja3": "abc", "ciphers": ["x"], "family": "f", "label": "malware"}, {"ja3": ""}]))
    assert [r.ja3 for r in RL.read_fingerprints(spark, str(tmp_path / "ja3.json")).collect()] == ["abc"]


def test_ema_rounds_at_every_step(spark):
    rng = random.Random(4)
    rows = [(k, float(i), i, round(rng.uniform(0, 90), 2)) for k in "ab" for i in range(150)]
    df = spark.createDataFrame(rows, "k string, ts double, i int, v double")
    got = {r.k: (r.ema, r.samples) for r in W.latency_ema(df, ["k"], "ts", "i", "v").collect()}
    for k in "ab":
        ema = 0.0
        for _, _, _, x in [r for r in rows if r[0] == k]:
            ema = round(ema * 0.9 + x * 0.1 if ema else x, 2)
        assert got[k] == (ema, 150)


def test_percentiles_use_nearest_rank(spark):
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("v"), "id")
    row = W.latency_percentiles(df, "v", "id", "id").first()
    assert (row.p50_ms, row.p95_ms, row.max_ms, row.mean_ms) == (5.0, 10.0, 10.0, 5.5)
