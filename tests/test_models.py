"""Learned detectors and evaluation against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from taplight.operators import evaluation as E, models as M


def test_auc_matches_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), round(rng.random(), 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "label int, score double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    for resolution in (0.05, 10.0):
        assert E.auc(df, "label", "score", resolution).first().auc == pytest.approx(want)


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(103).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    a, b = (E.stratified_split(df, "label", "id").orderBy("id").collect() for _ in range(2))
    assert a == b
    for label, n in ((0, 68), (1, 35)):
        assert sum(r.is_train for r in a if r.label == label) == int(n * 0.8)


def test_isolation_forest_ranks_the_outlier_first(spark):
    df = spark.range(600).select(
        F.col("id").cast("string").alias("flow_id"),
        F.when(F.col("id") == 7, 500.0).otherwise((F.col("id") % 37) / 10.0).alias("x"),
        F.when(F.col("id") == 7, -80.0).otherwise((F.col("id") % 23) / 10.0).alias("y"))
    forest = M.isolation_forest(df, ("x", "y"), trees=40)
    rows = forest.transform(df).orderBy("score").collect()
    assert rows[0].flow_id == "7" and rows[0].score < 0
    below = sum(r.score < 0 for r in rows)
    assert 5 <= below <= 45                       # about five per cent by construction
    again = M.isolation_forest(df, ("x", "y"), trees=40)
    assert again.offset == forest.offset


def test_loss_keeps_at_least_one_packet_and_scales(spark):
    df = spark.createDataFrame(
        [("f", 10, 1000, 9.0, 0.0, 9.0, [float(i) for i in range(10)],
          {"query_frequency": 4.0, "unique_dst_ports": 10.0, "syn_to_ack_ratio": 2.0})],
        "flow_id string, packet_count bigint, bytes_transferred bigint, duration_seconds double, "
        "start_time double, end_time double, timestamps array<double>, "
        "raw_features map<string,double>")
    out = E.packet_loss_resample(df, (0.0, 0.5, 1.0), 3).collect()
    assert len(out) == 9
    for r in out:
        kept = len(r.timestamps)
        assert kept >= 1 and r.packet_count == max(1, kept) and r.bytes_transferred == 100 * kept
        if r.loss == 0.0:
            assert kept == 10 and r.raw_features["query_frequency"] == 4.0
        if r.loss == 1.0:
            assert kept == 1 and r.raw_features["query_frequency"] == 0.4


def test_gate_fails_on_drop_rise_and_absence(spark):
    schema = "metric string, kind string, rate double"
    base = spark.createDataFrame([("a", "detection", 0.9), ("b", "false_positive", 0.02),
                                  ("c", "detection", 0.5), ("d", "detection", 0.5)], schema)
    now = spark.createDataFrame([("a", "detection", 0.896), ("b", "false_positive", 0.03),
                                 ("c", "detection", 0.49)], schema)
    gate = E.regression_gate(base, now)
    assert {r.metric: r.holds for r in gate.collect()} == {"a": True, "b": False, "c": False, "d": False}
    assert E.gate_passes(gate).first().passes is False


def test_rollup_ignores_generation_time(spark):
    def art(stamp, n):
        return spark.createDataFrame([("x", "rows", n), ("x", "generated_at", stamp)],
                                     "artifact string, metric string, value string")
    old, same, changed = (E.evaluation_rollup(a, ["x", "y"]) for a in (
        art("1", "5"), art("2", "5"), art("2", "6")))
    assert E.stale_artifacts(old, same).count() == 0
    assert [r.artifact for r in E.stale_artifacts(old, changed).collect()] == ["x"]
    assert {r.artifact: r.status for r in old.collect()} == {"x": "available", "y": "unavailable"}


def test_ablation_cost(spark):
    rows = [("ddos", m, f) for m, f in zip(E.MODES, (0.9, 0.4, 0.8))]
    row = E.ablation_cost(spark.createDataFrame(rows, "class string, mode string, f1 double")).first()
    assert (row.cost, row.regained) == (0.5, 0.4)


def test_each_ablation_mode_has_its_own_verdicts(spark):
    from taplight.plans import evaluation as P
    # label, source port (its remainder by 24 is how few answers an attack has), port, protocol, packets, bytes, seconds
    rows = [("ddos", 24 * 50 + 15, 80, "tcp", 400, 400_000, 20.0),       # both directions only
            ("ddos", 24 * 50, 80, "tcp", 4000, 4_000_000, 20.0),         # substitutes only
            ("ddos", 24 * 50, 80, "tcp", 40_000, 4_000_000, 20.0),       # always
            ("exfiltration", 24 * 50 + 23, 80, "tcp", 40, 40_000, 20.0),  # both directions only
            ("benign", 24 * 50 + 23, 80, "udp", 40, 40_000, 20.0)]       # answers 23 times the request
    flows = spark.createDataFrame([(f"f{i}", *r, {}, "", 0) for i, r in enumerate(rows)], "flow_id string, label string, "
        "src_port int, dst_port int, protocol string, packet_count long, bytes_transferred long, duration_seconds double, "
        "raw_features map<string,double>, dns_query string, dns_qtype int")
    found = E.one_sided_ablation(P._both_directions(flows), P._found_by_direction, ("ddos", "exfiltration"))
    got = {(r["mode"], r["class"]): (r["tp"], r["fp"], r["fn"]) for r in found.collect()}
    assert got == {("bidirectional", "ddos"): (2, 1, 1), ("unidirectional", "ddos"): (1, 0, 2), ("recovered", "ddos"): (2, 0, 1),
                   ("bidirectional", "exfiltration"): (1, 0, 0), ("unidirectional", "exfiltration"): (0, 0, 1),
                   ("recovered", "exfiltration"): (0, 0, 1)}
    cost = {r["class"]: (r["cost"], r["regained"]) for r in E.ablation_cost(found).collect()}
    assert cost["ddos"][0] > 0 and cost["ddos"][1] > 0 and cost["exfiltration"] == (1.0, 0.0)


def test_forest_scores_are_those_of_a_walk_down_each_tree(spark, monkeypatch):
    monkeypatch.setattr(M, "_SCORED", 7)
    rows = [(i, float(i * 37 % 101), None if i % 9 == 4 else float(i * 53 % 97)) for i in range(60)]
    df = spark.createDataFrame(rows, "flow_id long, a double, b double")
    forest = M.isolation_forest(df.where("b is not null"), ("a", "b"), trees=5, sample=16)
    nodes = forest.nodes

    def depth(root, x):
        at = root
        while nodes["feature"][at] >= 0:
            value = x[nodes["feature"][at]]
            at = nodes["left" if value is not None and value <= nodes["threshold"][at] else "right"][at]
        return nodes["depth"][at]

    got = {r["flow_id"]: r["score"] for r in forest.transform(df).collect()}
    for i, *x in rows:
        mean = sum(depth(r, x) for r in forest.roots) / len(forest.roots)
        assert abs(got[i] - (-2 ** (-mean / float(M._average_path(16))) - forest.offset)) < 1e-12


def test_names_are_scored_once_and_cleaned_once(spark):
    rows = spark.createDataFrame([(x, int(i % 2)) for i, x in enumerate(("abc.com", "x9q7z1k.net", "login.org", "q8w7e6.net"))],
                                 "domain string, label int")
    matrix = M.name_matrix(rows)
    model = M.train_dga(matrix, rounds=2)
    flows = spark.createDataFrame([("f1", "www.x9q7z1k.net"), ("f2", "abc.com"), ("f3", ""), ("f4", None)],
                                  "flow_id string, dns_query string")
    for name, kind in (("src_ip", "string"), ("dst_ip", "string"), ("src_port", "int"), ("dst_port", "int"),
                       ("protocol", "string"), ("packet_count", "long"), ("bytes_transferred", "long"),
                       ("duration_seconds", "double"), ("start_time", "double")):
        flows = flows.withColumn(name, F.lit(None).cast(kind))
    found = M.dga_detect(flows, model).select("flow_id", "confidence")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF(UDF(UDF(") == 1
    asked = flows.where("dns_query != ''").withColumn("domain", M.registrable_label(F.col("dns_query")))
    scored = M.score_names(M.name_matrix(asked), model).where("dga_probability > 0.5")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, scored.select("flow_id", "dga_probability").collect()))
    cleaned = matrix.select(*M.NAME_FEATURES)._jdf.queryExecution().optimizedPlan().toString()
    assert cleaned.count("regexp_replace(domain") == 1
