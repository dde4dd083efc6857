"""Work and results of steps that were rewritten so that their cost grows no faster than their input."""

import random
import threading

from pyspark.sql import functions as F

from taplight import settings as S
from taplight.operators import evaluation as E, models as M, scan
from taplight.operators.common import COPY, IDENTITY, with_copy_number
from taplight.streaming.eviction import state_keys, state_lifetimes

FLOW = ("flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, packet_count long, "
        "bytes_transferred long, duration_seconds double, start_time double")


def _flows(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(f"f{i % (n - 5)}", rng.choice(["a", "b", "c", None]), rng.choice(["x", "y"]), 5000, rng.choice([80, 53, None]), "tcp",
             rng.randrange(1, 900), rng.randrange(1, 90000), float(rng.randrange(1, 5)),
             float(rng.choice([0, 30, 900, 3600, 86400])) + rng.randrange(0, 2000) / 4) for i in range(n)]
    return spark.createDataFrame(rows, FLOW)


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lives_are_the_same_for_hot_and_cold_keys(spark):
    flows = _flows(spark)
    lives = {}
    for r in sorted(state_keys(flows).collect(), key=lambda r: r["start_time"]):
        known = lives.setdefault((r["rule"], r["key"]), [])
        if not known or r["start_time"] >= known[-1][1] + S.STATE_IDLE_SECONDS[r["rule"]]:
            known.append([r["start_time"], 0.0, 0, set()])
        known[-1][1], known[-1][2] = r["start_time"], known[-1][2] + 1
        known[-1][3].add(r["peer"])
    wanted = sorted((*k, lo, hi, n, len(peers)) for k, v in lives.items() for lo, hi, n, peers in v)
    for hot_rows in (0, 40, 10 ** 6):
        assert sorted(map(tuple, state_lifetimes(flows, hot_rows).collect())) == wanted


def test_rows_without_a_time_open_a_life_without_one(spark):
    flows = _flows(spark, 60).withColumn("start_time", F.when(F.col("flow_id") > "f3", F.col("start_time")))
    found = [sorted(map(str, state_lifetimes(flows, hot).collect())) for hot in (0, 10 ** 6)]
    assert found[0] == found[1] and any("opened=None" in r for r in found[0])


def test_lives_of_cold_keys_shuffle_once(spark):
    assert _exchanges(state_lifetimes(_flows(spark))) <= 2


def _labelled(spark):
    rows = [(f"f{i % 37}" if i % 11 else None, ["ddos", "exfiltration", "benign", None][i % 4], [float(t) for t in range(i % 9)],
             100.0 + i, i * 70, float(i % 7), 5.0, None) for i in range(120)]
    return spark.createDataFrame(rows, "flow_id string, label string, timestamps array<double>, start_time double, "
                                       "bytes_transferred long, duration_seconds double, end_time double, packet_sizes array<long>") \
        .withColumn("packet_count", F.size("timestamps").cast("long") + 20)


def _judged(copies):
    big = copies.where("bytes_transferred > 3000").select("flow_id", F.lit("exfiltration").alias("threat_class"))
    return big.unionByName(copies.where("packet_count < 24").select("flow_id", F.lit("ddos").alias("threat_class")))


def test_loss_study_judges_copies_without_shuffling_them(spark):
    labelled, classes = _labelled(spark), ("ddos", "exfiltration", "dga")
    copies = E.packet_loss_resample(labelled, trials=13).withColumn("flow_id", F.concat_ws(
        "#", "flow_id", F.col("loss").cast("string"), F.col("trial").cast("string")))
    outcomes = E._outcomes(copies.select("flow_id", "label", "loss", "trial"), _judged(copies))
    scores = E._class_scores(outcomes, classes, ["loss", "trial"], True).where("tp + fp + fn > 0")
    wanted = scores.groupBy("loss", "trial").agg(F.round(F.avg("f1"), 4).alias("f")).groupBy("loss").agg(
        F.round(F.avg("f"), 4), F.count(F.lit(1)))
    found = E.loss_study(labelled, _judged, classes, trials=13)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftleft" in plan and "loss#" in plan and "collect_set" not in plan


def test_copies_that_are_alike_are_judged_once(spark):
    schema = "flow_id string, label string, packet_count long, bytes_transferred long, duration_seconds double, " \
        "start_time double, end_time double, timestamps array<double>, raw_features map<string,double>"
    times, flows = [float(i) for i in range(30)], []
    for i in range(40):
        flows.append((f"t{i}", "ddos", 30, 4000, 29.0, 0.0, 29.0, times, None))                            # drawn packets
        flows.append((f"n{i}", "exfiltration", 25, 3100 + i, 1.0, 0.0, 1.0, None, {"query_frequency": 2.0}))  # no draw
        flows.append((f"f{i}", "ddos", 25, 100, 1.0, 0.0, 1.0, [], {"syn_to_ack_ratio": 2.0}))              # a drawn feature
    labelled, sizes, trials = spark.createDataFrame([*flows, flows[1], (None, *flows[4][1:])], schema), [], 25

    def judged(copies):
        sizes.append(copies.count())
        syn = copies.where(F.try_element_at("raw_features", F.lit("syn_to_ack_ratio")) > 2.2).select(
            "flow_id", F.lit("ddos").alias("threat_class"))
        return _judged(copies).unionByName(syn)

    copies = E.packet_loss_resample(labelled, trials=trials).withColumn("flow_id", F.concat_ws(
        "#", "flow_id", F.col("loss").cast("string"), F.col("trial").cast("string")))
    outcomes = E._outcomes(copies.select("flow_id", "label", "loss", "trial"), judged(copies).withColumn("x", F.lit(1)))
    scores = E._class_scores(outcomes, ("ddos", "exfiltration"), ["loss", "trial"], True).where("tp + fp + fn > 0")
    wanted = scores.groupBy("loss", "trial").agg(F.round(F.avg("f1"), 4).alias("f")).groupBy("loss").agg(
        F.round(F.avg("f"), 4), F.count(F.lit(1)))
    found = E.loss_study(labelled, judged, ("ddos", "exfiltration"), trials=trials)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    assert sizes == [122 * 6 * trials, 80 * (1 + 5 * trials) + 42 * 6]


def test_all_detectors_share_one_numbered_table(spark, monkeypatch):
    from taplight.operators import beacon, common, ddos, lifecycle
    rows = [(f"f{i}", "a", "b", 1, 443, "tcp", 40_000, 4_000_000, 1.0, 60.0 * i, [443], {}, "", 0) for i in range(12)]
    flows = spark.createDataFrame(rows, "flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
        "packet_count long, bytes_transferred long, duration_seconds double, start_time double, dst_ports array<int>, "
        "raw_features map<string,double>, dns_query string, dns_qtype int")
    apart = ddos.ddos_detect(flows).unionByName(beacon.beacon_detect(flows)).select("flow_id", "detector", "confidence")
    want, made = sorted(map(tuple, apart.collect())), []
    for module in (beacon, ddos, lifecycle):
        monkeypatch.setattr(module, "with_copy_number", lambda *a: made.append(a) or common.with_copy_number(*a), raising=False)
    found = lifecycle.detect_all(flows).where("detector in ('ddos', 'beacon')").select("flow_id", "detector", "confidence")
    assert sorted(map(tuple, found.collect())) == want and {r[1] for r in want} == {"ddos", "beacon"}
    assert len(made) == 1


def test_one_draw_a_trial_serves_all_levels(spark):
    out = E.packet_loss_resample(_labelled(spark), partitions=3)
    assert out.rdd.getNumPartitions() == 3
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode([0.0") < plan.index("md5(") and plan.count(":packet:") <= plan.count("explode(")


def test_tls_training_does_not_gather_a_class_in_one_task(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(M.Pipeline, "fit", lambda self, rows: seen.append(rows))
    names = M.TLS_FEATURES
    rows = spark.createDataFrame([(i % 2, "x" * 50, *[float(i + j) for j in range(len(names))]) for i in range(60)],
                                 ["label", "other", *names])
    M.train_tls(rows)
    assert "other" not in seen[0].columns
    seen[0].collect()
    assert "SortMergeJoin" not in seen[0]._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_numbering_moves_only_the_columns_it_is_asked_for(spark):
    flows = _flows(spark).withColumn("wide", F.repeat(F.lit("x"), 100))
    numbered = with_copy_number(flows, IDENTITY)
    assert numbered.columns == [*IDENTITY, COPY]
    both = [sorted(map(str, df.select(*numbered.columns).collect())) for df in (numbered, with_copy_number(flows))]
    assert both[0] == both[1]


def test_fan_out_counts_each_sources_first_sightings(spark):
    flows = _flows(spark).withColumns({"dst_ports": F.array(F.col("packet_count").cast("int") % 40), "raw_features": F.create_map(
        F.lit("unique_dst_ports"), (F.col("packet_count") % 7).cast("double"))})
    found = scan.scan_fanout_running(flows, bucket_seconds=50.0)
    seen, wanted = {}, []
    for r in sorted(flows.collect(), key=lambda r: (r["start_time"], r["flow_id"])):
        ports, hosts, most = seen.setdefault(r["src_ip"], (set(), set(), []))
        ports.update(r["dst_ports"])
        ports.update([] if r["dst_port"] is None else [r["dst_port"]])
        hosts.add(r["dst_ip"])
        most.append(int(r["raw_features"]["unique_dst_ports"]))
        wanted.append((r["flow_id"], r["start_time"], max(len(ports), *most, 0), len(hosts)))
    assert sorted(map(tuple, found.select("flow_id", "start_time", "unique_dst_ports", "unique_dst_hosts").collect())) == sorted(wanted)
    assert "LeftOuter" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_folds_are_trained_side_by_side(spark, monkeypatch):
    meet = threading.Barrier(3, timeout=60)

    def train(rows, *rest):
        meet.wait()
        return rows.count()
    monkeypatch.setattr(E, "train_dga", train)
    monkeypatch.setattr(E, "score_names", lambda rows, model: rows.withColumn("dga_probability", F.col("label") * 0.5))
    names = spark.createDataFrame([(f"n{i}", i % 2) for i in range(60)], "domain string, label int")
    assert E.cross_validated_auc(names, folds=3).collect()[0]["mean_auc"] == 1.0
