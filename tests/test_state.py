"""Idle state, alert updates, late rows, ranks without sorting, stored sketches."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taplight import settings as S
from taplight.operators import lifecycle, ordered, reports, scan, telemetry
from taplight.plans.views import Views
from taplight.streaming import eviction, late, operators as ST
from taplight.streaming.ordered_fold import Fold, ordered_fold

SF = "/root/testdata/sf0.001"
FLOWS = ("flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, packet_count long, "
         "bytes_transferred long, duration_seconds double, start_time double, dst_ports array<int>, raw_features map<string,double>")


def _flow(i, src, dst, at, port=80):
    return (f"f{i:04}", src, dst, 1, port, "tcp", 1, 1, 1.0, float(at), [port], {})


def test_a_quiet_source_starts_anew(spark):
    rows = [_flow(i, "a", f"h{i}", i * 10) for i in range(5)] + [_flow(10 + i, "a", f"h{i}", 2000 + i) for i in range(3)]
    rows += [_flow(20, None, "h", 899.0), _flow(21, None, "h2", 899.0 + 900.0), _flow(22, None, "h3", 899.0 + 900.0)]
    df = spark.createDataFrame(rows, FLOWS)
    hosts = {r["flow_id"]: r["unique_dst_hosts"] for r in scan.scan_fanout_running(df, idle=900.0).collect()}
    assert [hosts[f"f{i:04}"] for i in (4, 10, 12, 20, 21, 22)] == [5, 1, 3, 1, 1, 2]
    always = {r["flow_id"]: r["unique_dst_hosts"] for r in scan.scan_fanout_running(df).collect()}
    assert [always[f"f{i:04}"] for i in (4, 10, 12, 22)] == [5, 5, 5, 3]


def test_idle_runs_span_time_buckets(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), round(rng.uniform(0, 40_000), 3), i) for i in range(600)] + [("a", 100_000.0, 601)]
    df = spark.createDataFrame(rows, "k string, ts double, i int")
    got = {r["i"]: r["_idle"] for r in ordered.idle_runs(df, ["k"], ["ts", "i"], 150.0, bucket_seconds=100.0).collect()}
    for k in "abc":
        opened = last = None
        for _, ts, i in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            if last is None or ts >= last + 150.0:
                opened = ts
            last = ts
            assert got[i] == opened


def _lives(rows):
    """Lives of every state in plain Python."""
    keys = {"beacon": lambda r: (" ".join(map(str, (r[1], r[2], r[4]))), r[5]), "scan": lambda r: (r[1], r[2]),
            "ddos": lambda r: (r[2], r[1]), "slow_rate": lambda r: (f"{r[2]} {r[4]}", r[1])}
    out = []
    for rule, idle in S.STATE_IDLE_SECONDS.items():
        alive = {}
        for r in sorted(rows, key=lambda r: (r[9], r[0])):
            key, peer = keys[rule](r)
            life = alive.get(key)
            if life and r[9] >= life[1] + idle:
                out.append((rule, key, life[0], life[1], life[2], len(life[3])))
                life = None
            if life is None:
                life = alive[key] = [r[9], r[9], 0, set()]
            life[1], life[2] = r[9], life[2] + 1
            life[3].add(peer)
        out += [(rule, k, a, b, n, len(p)) for k, (a, b, n, p) in alive.items()]
    return sorted(out)


def test_lives_of_state_in_any_number_of_triggers(spark, tmp_path):
    rng = random.Random(3)
    rows = [_flow(i, rng.choice("abc"), rng.choice("xyz"), rng.choice([100, 150, 3100, 9100]) + rng.randrange(40), rng.choice([80, 443]))
            for i in range(300)]
    df = spark.createDataFrame(rows, FLOWS)
    want = _lives(rows)
    assert sorted(map(tuple, eviction.state_lifetimes(df).collect())) == want
    folder = str(tmp_path / "in")
    for lo, hi in ((0, 120), (120, 145), (145, 3120), (3120, 1e9)):
        df.where((F.col("start_time") >= lo) & (F.col("start_time") < hi)).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([_flow(9999, "end", "end", 1e6)], FLOWS).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = eviction.stream_state_lifetimes(stream, "5 seconds").writeStream.format("parquet").option(
        "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).where("key <> 'end'").select(
        "rule", "key", "opened", "last_seen", "n_rows", "peers").collect())) == want


def test_wall_clock_state_expires(spark, tmp_path):
    folder, out = str(tmp_path / "in"), []

    def run():
        stream = spark.readStream.schema(spark.createDataFrame([], FLOWS).schema).parquet(folder)
        query = eviction.wall_clock_counts(stream, 3.0).writeStream.outputMode("update").foreachBatch(
            lambda b, _: out.append({(r["rule"], r["key"]): (r["n_rows"], r["peers"]) for r in b.collect()})).option(
            "checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()   # the wall clock never runs out of triggers
        query.awaitTermination(120)

    for wait, n in ((0, 2), (0, 1), (4, 1)):
        time.sleep(wait)
        spark.createDataFrame([_flow(i, "a", f"h{i}", i) for i in range(n)], FLOWS).coalesce(1).write.mode("append").parquet(folder)
        run()
    counts = [b["scan", "a"] for b in out if ("scan", "a") in b]
    assert counts[0] == (2, 2) and counts[-1] == (1, 1)


def test_alert_updates_replay_and_end_as_the_batch_merge(spark, tmp_path):
    alerts = Views(spark, SF).alerts.where("ts < 1704070000")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    cuts = alerts.approxQuantile("ts", [0.5], 0.01)
    for lo, hi in ((float("-inf"), cuts[0]), (cuts[0], float("inf"))):
        alerts.where((F.col("ts") > lo) & (F.col("ts") <= hi)).coalesce(1).write.mode("append").parquet(folder)
    alerts.limit(1).withColumns({"source_ip": F.lit("end"), "ts": F.lit(4e9)}).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(alerts.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    ST.write_alert_updates(stream, out, str(tmp_path / "ck"), "60 seconds").awaitTermination()

    def rows(df):
        return sorted((r["alert_id"], r["n_detections"], round(r["confidence"], 6), r["severity"], tuple(
            (e["feature_name"], e["value"], e["contribution"], e["description"]) for e in r["evidence"])) for r in df.collect())

    now = ST.current_alerts(spark, out).where("source_ip <> 'end'")
    want = rows(lifecycle.merge_alerts(alerts))
    assert rows(now) == want and now.where("not closed").count() == 0
    stored = spark.read.option("basePath", out).parquet(f"{out}/epoch=*")
    assert stored.where("not closed").count() > 0
    again = [r["epoch"] for r in stored.select("epoch").distinct().collect()][0]
    rerun = stored.where(F.col("epoch") == again).drop("epoch")
    ST.store_updates(spark.createDataFrame(rerun.collect(), rerun.schema), again, out)
    assert rows(ST.current_alerts(spark, out).where("source_ip <> 'end'")) == want


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "i int, event_time timestamp, late boolean"
    files = [[(1, 100), (2, 50)], [(3, 95), (4, 90), (5, 89), (6, None)], [(7, 300)], [(8, 101), (9, 290), (10, 291)]]
    for rows in files:
        spark.createDataFrame([(i, t) for i, t in rows], "i int, t long").select(
            "i", F.timestamp_seconds("t").alias("event_time"), F.lit(True).alias("late")).select(
            "i", "event_time", "late").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).drop("late")
    late.split_late(stream, out, str(tmp_path / "ck"), lateness_seconds=10.0).awaitTermination()
    got = {r["i"]: (r["epoch"], r["late"]) for r in late.read_split(spark, out).collect()}
    assert got == {1: (0, False), 2: (0, False), 3: (1, False), 4: (1, True), 5: (1, True), 6: (1, True), 7: (2, False),
                   8: (3, True), 9: (3, True), 10: (3, False)}
    batch = spark.read.schema(schema).parquet(folder).drop("late").where("i in (3, 4, 5, 6)")
    late.split_batch(batch, 1, out, "event_time", 10.0)
    assert {r["i"]: (r["epoch"], r["late"]) for r in late.read_split(spark, out).collect()} == got


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 1.0, 1.0], [float(i % 7) for i in range(100)], [1e308, -1e308, 0.0, 5e-324, 1.0, 1.0000000000000002],
    [math.exp(random.Random(4).gauss(0, 8)) * (1 + i) for i in range(50)],
    [random.Random(i).gauss(0, 1) ** 9 for i in range(500)]])
def test_values_at_ranks(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
    ranks = sorted({0, len(values) - 1, len(values) // 2, len(values) // 3})
    for bins in (2, 4096):
        got = telemetry.values_at_ranks(df, "x", ranks if bins > 2 else ranks[:1], bins)
        assert got == {r: sorted(values)[r] for r in got} and len(got) == (len(ranks) if bins > 2 else 1)
    row = telemetry.latency_percentiles_exact(df, "x").first()
    assert row["samples"] == len(values) and row["p50_ms"] == pytest.approx(sorted(values)[round(.5 * (len(values) - 1))], abs=6e-4)
    assert tuple(telemetry.latency_percentiles_exact(df.limit(0), "x").first()) == (0, *[None] * 6)


def test_merged_sketches_stay_near_the_exact_count(spark):
    df = spark.range(60_000).select((F.col("id") % 24).alias("hour"), F.md5((F.col("id") % 20_000).cast("string")).alias("ja3"),
                                    F.md5((F.col("id") % 70).cast("string")).alias("ja4"), F.lit(1).alias("connections"))
    stored = reports.fingerprint_sketches(df, "hour")
    row = reports.fingerprint_uniques_merged(stored).first()
    assert abs(row["unique_ja3"] - 20_000) <= 400 and row["unique_ja4"] == 70 and row["connections"] == 60_000
    assert reports.fingerprint_uniques_merged(stored, "hour").count() == 24


def test_many_keys_share_a_bucket_and_stay_apart(spark, tmp_path):
    class Seen(Fold):
        """Counts a key's rows; a row of output per life, and one each time it has grown."""

        output = T.StructType([T.StructField("k", T.StringType()), T.StructField("p", T.LongType()),
                               T.StructField("n", T.LongType()), T.StructField("last", T.DoubleType())])

        def step(self, state, row):
            return {"k": row["k"], "p": row["p"], "n": (state or {"n": 0})["n"] + 1, "last": row["ts"]}, []

        def expires_at(self, state):
            return state["last"] + 100.0

        def on_expiry(self, state):
            return [(state["k"], state["p"], state["n"], state["last"])]

    first = [(i, f"k{i % 50}" if i % 50 else None, i % 3 if i % 7 else None, 10.0 + i % 40) for i in range(3000)]
    later = [(5000, "k1", 1, 90.0), (5001, "k1", 1, 400.0), (5002, None, None, 401.0), (5003, "k2", 2, None)]
    schema = "i long, k string, p long, ts double"
    for n, part in enumerate((first, [(6000, "end", 0, 60.0)], later, [(6001, "end", 0, 9000.0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = ordered_fold(stream, ["k", "p"], "ts", "i", Seen(), "0 seconds", buckets=2)
    found.writeStream.format("memory").queryName("shared").option("checkpointLocation", str(tmp_path / "ck")).trigger(
        availableNow=True).start().awaitTermination(120)
    want = {}
    for _, k, p, ts in first + later[:1]:
        n, last = want.get((k, p), (0, 0.0))
        want[k, p] = (n + 1, max(last, ts))
    want = sorted(((k, p, *v) for (k, p), v in want.items()), key=str)
    got = [tuple(r) for r in spark.table("shared").collect() if r["k"] != "end"]
    assert sorted(got, key=str) == sorted([*want, ("k1", 1, 1, 400.0), (None, None, 1, 401.0)], key=str)


def test_idle_state_needs_no_python_and_opens_at_the_very_end(spark, tmp_path):
    idle = S.STATE_IDLE_SECONDS["scan"]
    times = [1000.0, 1000.0 + idle - 0.000001, 1000.0 + 2 * idle - 0.000001, 1000.0 + 3 * idle]
    rows = [_flow(i, "s", f"h{i}", t) for i, t in enumerate(times)] + [_flow(9, "end", "end", 10_000_000)]
    spark.createDataFrame(rows, FLOWS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    lives = eviction.stream_state_lifetimes(stream, "0 seconds")
    assert "TransformWithState" not in lives._jdf.queryExecution().toString()
    lives.writeStream.format("memory").queryName("very_end").option("checkpointLocation", str(tmp_path / "ck")).trigger(
        availableNow=True).start().awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("very_end").where("rule = 'scan' and key = 's'").select(
        "opened", "last_seen", "n_rows", "peers").collect())
    assert got == [(times[0], times[1], 2, 2), (times[2], times[2], 1, 1), (times[3], times[3], 1, 1)]
