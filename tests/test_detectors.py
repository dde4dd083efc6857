"""Detectors at the edges of their thresholds."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taplight import schemas
from taplight.operators import beacon, ddos, dns, exfil, flows as FL, scan, slow_rate

_NULL = {f.name: None for f in schemas.FLOWS.fields}


def flows(spark, rows):
    base = {**_NULL, "src_ip": "10.0.0.1", "dst_ip": "192.0.2.1", "src_port": 5000, "dst_port": 443,
            "protocol": "tcp", "packet_count": 10, "bytes_transferred": 1000, "start_time": 0.0,
            "end_time": 1.0, "duration_seconds": 1.0, "raw_features": {}}
    full = [{**base, "flow_id": f"f{i:04d}", **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f.name] for f in schemas.FLOWS.fields) for r in full],
                                 schemas.FLOWS)


def ids(df):
    return sorted(r.flow_id for r in df.select("flow_id").collect())


def test_rate_threshold_is_exclusive(spark):
    df = flows(spark, [dict(packet_count=111, bytes_transferred=111 * 60),
                       dict(packet_count=112, bytes_transferred=112 * 60),
                       dict(packet_count=500, bytes_transferred=500 * 300),
                       dict(packet_count=11101, bytes_transferred=1000, duration_seconds=100.0)])
    assert ids(ddos.ddos_rate_rule(df)) == ["f0001", "f0003"]


def test_amplifier_only_when_the_rate_rule_is_silent(spark):
    df = flows(spark, [dict(protocol="udp", dst_port=53, packet_count=21, bytes_transferred=2100),
                       dict(protocol="udp", dst_port=53, packet_count=20, bytes_transferred=2000),
                       dict(protocol="tcp", dst_port=53, packet_count=50, bytes_transferred=2000),
                       dict(protocol="udp", dst_port=53, packet_count=200, bytes_transferred=2000)])
    assert ids(ddos.ddos_amplifier_rule(df)) == ["f0000"]


def test_entropy_extremes(spark):
    one = [dict(dst_ip="d1", src_ip="s", start_time=float(i)) for i in range(3)]
    many = [dict(dst_ip="d2", src_ip=f"s{i}", start_time=float(i)) for i in range(4)]
    late = [dict(dst_ip="d1", src_ip="t", start_time=100.0)]
    got = {r.flow_id: round(r.src_ip_entropy, 6)
           for r in ddos.source_ip_entropy(flows(spark, one + many + late)).collect()}
    assert got["f0000"] == 1.0 and got["f0002"] == 0.0
    assert got["f0006"] == 1.0 and got["f0007"] == 1.0


@pytest.mark.parametrize("cap,chunk_bucket", [(4, 1.0), (500, 60.0)])
def test_entropy_matches_brute_force(spark, cap, chunk_bucket):
    import math
    import random
    rng = random.Random(3)
    rows = [dict(dst_ip="d" if rng.random() < .7 else "e", src_ip=f"s{rng.randrange(4)}",
                 start_time=float(rng.randrange(200))) for _ in range(150)]
    df = flows(spark, rows)
    got = {r.flow_id: r.src_ip_entropy for r in ddos.source_ip_entropy(
        df, cap=cap, bucket_seconds=chunk_bucket).collect()}
    order = sorted(enumerate(rows), key=lambda x: (x[1]["start_time"], x[0]))
    seen = {}
    for i, r in order:
        win = seen.setdefault(r["dst_ip"], [])
        win.append((r["start_time"], r["src_ip"]))
        recent = [s for t, s in win[-cap:] if t >= r["start_time"] - 30]
        counts = [recent.count(s) for s in set(recent)]
        n = len(recent)
        h = -sum(c / n * math.log2(c / n) for c in counts)
        want = 1.0 if n < 2 else (0.0 if len(counts) == 1 else h / math.log2(len(counts)))
        assert got[f"f{i:04d}"] == pytest.approx(want, abs=1e-9)


def test_beacon_needs_five_starts(spark):
    regular = [dict(src_ip=f"s{n}", dst_ip=f"d{n}", start_time=60.0 * i)
               for n in (4, 5) for i in range(n)]
    assert ids(beacon.beacon_pair(flows(spark, regular))) == ["f0008"]


def test_beacon_variation_limit_and_name_lookups(spark):
    def series(src, gaps, port=443):
        t, out = 0.0, []
        for g in [0.0, *gaps]:
            t += g
            out.append(dict(src_ip=src, dst_ip=src, dst_port=port, start_time=t))
        return out
    steady, shaky = [100, 100, 100, 130], [100, 100, 100, 140]      # cv 0.1395 and 0.1818
    df = flows(spark, series("a", steady) + series("b", shaky) + series("c", steady, 53))
    assert [r.src_ip for r in beacon.beacon_pair(df).collect()] == ["a"]


def test_beacon_destination_needs_two_sources_and_sparse_flows(spark):
    def fan(dst, sources, **kw):
        return [dict(src_ip=f"{dst}-{i % sources}-{i}" if sources > 1 else dst, dst_ip=dst,
                     start_time=60.0 * i, **kw) for i in range(6)]
    df = flows(spark, fan("two", 2) + fan("big", 2, packet_count=41))
    hits = beacon.beacon_destination(df)
    assert {r.dst_ip for r in hits.collect()} == {"two"} and hits.count() == 2


def test_scan_thresholds(spark):
    def ports(src, n):
        return [dict(src_ip=src, dst_port=1000 + i, start_time=float(i)) for i in range(n)]

    def hosts(src, n):
        return [dict(src_ip=src, dst_ip=f"192.0.2.{i}", start_time=float(i)) for i in range(n)]
    df = flows(spark, ports("p20", 20) + ports("p21", 21) + hosts("h15", 15) + hosts("h16", 16))
    hits = scan.port_scan_rule(scan.scan_fanout_running(df)).collect()
    assert sorted((r.src_ip, r.scan_type) for r in hits) == [("h16", "vertical"), ("p21", "horizontal")]
    batch = scan.port_scan_rule(scan.scan_fanout_batch(df)).collect()
    assert sorted(r.src_ip for r in batch) == ["h16", "p21"]


def test_scan_summary_counts(spark):
    df = flows(spark, [dict(raw_features={"unique_dst_ports": 60.0, "unique_dst_hosts": 3.0})])
    row = scan.port_scan_rule(scan.scan_fanout_running(df)).first()
    assert (row.unique_dst_ports, row.unique_dst_hosts, row.severity) == (60, 3, "high")


def slow_rows(n, **kw):
    return [dict(flow_id=f"s{i}", src_ip=f"10.0.0.{i % 3}", dst_port=80, start_time=float(i),
                 end_time=i + 200.0, duration_seconds=200.0, packet_count=17,
                 bytes_transferred=17 * 70, timestamps=[i + 12.0 * k for k in range(17)], **kw)
            for i in range(n)]


def test_eighth_slow_connection_fires(spark):
    def fired(rows):
        return slow_rate.slow_rate_concurrency(slow_rate.slow_rate_candidate(flows(spark, rows)))
    assert fired(slow_rows(7)).count() == 0
    hit = fired(slow_rows(8)).collect()
    assert [(r.flow_id, r.concurrent, r.distinct_sources) for r in hit] == [("s7", 8, 3)]


def test_slow_rate_ignores_other_ports_and_silence(spark):
    silent = [{**r, "timestamps": [*r["timestamps"][:-1], r["timestamps"][-2] + s]}
              for r, s in zip(slow_rows(2), (45.0, 45.1))]
    silent = [{**r, "duration_seconds": r["timestamps"][-1] - r["start_time"],
               "end_time": r["timestamps"][-1]} for r in silent]
    assert ids(slow_rate.slow_rate_candidate(flows(spark, silent))) == ["s0"]
    ssh = [{**r, "dst_port": 22} for r in slow_rows(3)]
    assert slow_rate.slow_rate_candidate(flows(spark, ssh)).count() == 0


def test_sources_at_a_hot_server_match_pairs(spark):
    """The sweep agrees with a pairwise count on a server that holds every connection."""
    import random
    rng = random.Random(9)
    rows = [dict(flow_id=f"h{i:03d}", src_ip=f"10.0.0.{rng.randrange(5)}", dst_port=80,
                 packet_count=8, bytes_transferred=400, start_time=float(rng.randrange(400)),
                 duration_seconds=float(20 + rng.randrange(60))) for i in range(120)]
    for r in rows:
        r["end_time"] = r["start_time"] + r["duration_seconds"]
        r["timestamps"] = [r["start_time"] + k * r["duration_seconds"] / 7 for k in range(8)]
    got = {r.flow_id: (r.concurrent, r.distinct_sources) for r in slow_rate.slow_rate_concurrency(
        slow_rate.slow_rate_candidate(flows(spark, rows)), 1).collect()}
    for a in rows:
        prior = [b for b in rows if (b["start_time"], b["flow_id"]) <= (a["start_time"], a["flow_id"])
                 and b["end_time"] >= a["start_time"]]
        assert got[a["flow_id"]] == (len(prior), len({b["src_ip"] for b in prior}))


def test_dns_tunnel_label_edges(spark):
    label = "abcdefgh" * 3                                    # 24 letters, entropy 3.0
    rows = [dict(dst_port=53, dns_query=f"{label}.t.io", dns_qtype=16),
            dict(dst_port=53, dns_query=f"{label[:23]}.t.io", dns_qtype=16),
            dict(dst_port=53, dns_query="x.io", dns_qtype=16, packet_count=2, bytes_transferred=40_000),
            dict(dst_port=443, dns_query="", packet_count=900)]
    got = {r.flow_id: r.confidence for r in dns.dns_tunnel_score(flows(spark, rows)).collect()}
    assert got == {"f0000": 0.65, "f0002": 0.5}


def test_exfil_edges(spark):
    mib = 1024 * 1024
    rows = [dict(bytes_transferred=mib, packet_count=1), dict(bytes_transferred=mib + 1, packet_count=1),
            dict(bytes_transferred=2 * mib, packet_count=2 * mib // 500 + 1),
            dict(bytes_transferred=101 * mib, packet_count=1000)]
    got = {r.flow_id: r.severity for r in exfil.exfil_rule(flows(spark, rows)).collect()}
    assert got == {"f0001": "medium", "f0003": "critical"}


def packet(i, ts, flags="A", port=80, **kw):
    base = dict(packet_id=i, src_ip="a", dst_ip="b", src_port=1, dst_port=port, protocol="tcp",
                ts=ts, flags=flags, packet_size=100, ja3="", dns_query="", dns_qtype=0, tls_counts=None)
    row = {**base, **kw}
    return tuple(row[f.name] for f in schemas.PACKETS.fields)


def test_flow_series_are_capped_and_counters_exact(spark):
    df = spark.createDataFrame([packet(i, float(i)) for i in range(65)], schemas.PACKETS)
    for bucket in (3.0, 1000.0):
        row = FL.build_flows(df, bucket).first()
        assert (row.packet_count, row.bytes_transferred, row.duration_seconds) == (65, 6500, 64.0)
        assert row.timestamps == [float(i) for i in range(64)]
    single = FL.build_flows(spark.createDataFrame([packet(1, 5.0)], schemas.PACKETS)).first()
    assert single.duration_seconds == 0.0


def test_export_cuts(spark):
    times = [(0.0, "S"), (10.0, "A"), (24.9, "A"), (30.0, "A"), (40.0, "FA"), (41.0, "A"),
             (56.0, "A"), (70.9, "A")]
    df = spark.createDataFrame([packet(i, t, f) for i, (t, f) in enumerate(times)], schemas.PACKETS)
    got = sorted((r.start_time, r.packet_count) for r in FL.export_flows(df).collect())
    assert got == [(0.0, 3), (30.0, 2), (41.0, 1), (56.0, 2)]
    udp = df.withColumn("protocol", F.lit("udp"))
    assert (41.0, 1) not in [(r.start_time, r.packet_count) for r in FL.export_flows(udp).collect()]


def test_schema_names_are_types():
    assert isinstance(schemas.ALERTS, T.StructType)
