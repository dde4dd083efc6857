"""Scoring detectors against labels, and robustness studies."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from .models import NAME_FEATURES, score_names, train_dga
from .ordered import BUCKET, bucketed, running


def _n() -> Column:
    return F.count(F.lit(1))


def _unit(*parts: Column) -> Column:
    """Repeatable uniform draw in [0, 1) from the first 32 bits of an MD5."""
    text = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint") / float(2 ** 32)


# --------------------------------------------------------------------- splits
def _ranked_by_draw(df: DataFrame, label: str, ident: str, seed: int) -> DataFrame:
    """Position of each row in its class under a repeatable shuffle.

    Draws are uniform, so slicing them spreads a class of any size evenly over tasks.
    """
    drawn = df.withColumn("_draw", _unit(F.col(ident), F.lit(seed)))
    return running(bucketed(drawn, F.col("_draw"), 1 / 1024), [label], ["_draw", ident],
                   {"_rank": (F.lit(1).cast("bigint"), "sum")}).drop(BUCKET, "_draw")


def stratified_split(df: DataFrame, label: str, ident: str, train_share: float = 0.8,
                     seed: int = 42) -> DataFrame:
    """Adds ``is_train``: an exact share of every class."""
    sizes = df.groupBy(label).agg(_n().alias("_size"))
    ranked = _ranked_by_draw(df, label, ident, seed).join(sizes, label)
    return ranked.withColumn("is_train", F.col("_rank") <= F.floor(F.col("_size") * train_share)) \
                 .drop("_rank", "_size")


def stratified_folds(df: DataFrame, label: str, ident: str, folds: int = 5,
                     seed: int = 42) -> DataFrame:
    return _ranked_by_draw(df, label, ident, seed) \
        .withColumn("fold", (F.col("_rank") % folds).cast("int")).drop("_rank")


# -------------------------------------------------------------------- metrics
def auc(df: DataFrame, label: str, score: str, resolution: float = 1 / 1024) -> DataFrame:
    """Area under the ROC curve by rank sums over the distinct scores.

    Equal scores collapse first; the running count of negatives below each score is a
    two-level scan over score slices, so nothing is sorted in one task.
    """
    table = df.groupBy(F.col(score).cast("double").alias("_s")).agg(
        F.sum(F.col(label).cast("bigint")).alias("_pos"),
        F.sum(1 - F.col(label).cast("bigint")).alias("_neg")).withColumn("_all", F.lit(0))
    below = running(bucketed(table, F.col("_s"), resolution), ["_all"], ["_s"],
                    {"_below": (F.col("_neg"), "sum")}, inclusive=False)
    wins = F.sum(F.col("_pos") * (F.col("_below") + 0.5 * F.col("_neg")))
    return below.agg(F.try_divide(wins, F.sum("_pos") * F.sum("_neg").cast("double")).alias("auc"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def _prf(df: DataFrame, digits: int = 4) -> DataFrame:
    """Precision, recall and F1 from tp/fp/fn columns; empty denominators give 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return df.withColumns({"precision": F.round(p, digits), "recall": F.round(r, digits),
                           "f1": F.round(_ratio(2 * p * r, p + r), digits)})


def binary_metrics(df: DataFrame, label: str, pred: str, score: str | None = None) -> DataFrame:
    y, yhat = F.col(label) == 1, F.col(pred) == 1
    counts = df.agg(_n().alias("n"), F.count_if(y & yhat).alias("tp"),
                    F.count_if(~y & yhat).alias("fp"), F.count_if(y & ~yhat).alias("fn"),
                    F.count_if(~y & ~yhat).alias("tn"))
    out = _prf(counts).withColumns({
        "accuracy": F.round(_ratio(F.col("tp") + F.col("tn"), F.col("n")), 4),
        "fpr": F.round(F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1)), 4)})
    if score is None:
        return out
    area = auc(df, label, score).select(F.round("auc", 4).alias("auc"))
    return out.join(F.broadcast(area))      # one row against one row


def cross_validated_auc(names: DataFrame, features: Sequence[str] = NAME_FEATURES, folds: int = 5,
                        rounds: int = 200, seed: int = 42) -> DataFrame:
    """Mean and population deviation of held-out AUC over stratified folds."""
    folded = stratified_folds(names, "label", "domain", folds, seed)

    def held_out(k: int) -> DataFrame:
        model = train_dga(folded.where(F.col("fold") != k), rounds, features, seed)
        return auc(score_names(folded.where(F.col("fold") == k), model), "label", "dga_probability")

    # Boosting is a chain of short jobs that leave most cores idle, so the folds go side by side.
    with ThreadPoolExecutor(max(1, folds)) as pool:
        work = inheritable_thread_target(names.sparkSession)(held_out)
        parts = list(pool.map(work, range(folds)))
    return reduce(DataFrame.unionByName, parts).agg(
        F.round(F.avg("auc"), 4).alias("mean_auc"), F.round(F.stddev_pop("auc"), 4).alias("sd_auc"))


def length_confound_report(names: DataFrame, name: str = "domain") -> DataFrame:
    """How far name length alone separates the classes."""
    rows = names.select("label", F.length(name).alias("len"))
    stats = rows.groupBy().agg(*[
        f(F.when(F.col("label") == k, F.col("len"))).alias(f"{who}_len_{stat}")
        for k, who in ((0, "benign"), (1, "dga"))
        for stat, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))])
    bounds = stats.withColumns({
        "_lo": F.greatest("benign_len_min", "dga_len_min"),
        "_hi": F.least("benign_len_max", "dga_len_max")})
    inside = rows.join(F.broadcast(bounds.select("_lo", "_hi"))).agg(*[
        F.round(100.0 * F.try_divide(
            F.count_if((F.col("label") == k) & F.col("len").between(F.col("_lo"), F.col("_hi"))),
            F.count_if(F.col("label") == k)), 1).alias(f"length_overlap_{who}_pct")
        for k, who in ((0, "benign"), (1, "dga"))])
    area = auc(rows, "label", "len", 1.0).select(
        F.round(F.greatest("auc", 1 - F.col("auc")), 4).alias("length_only_auc"))
    rounded = {f"{w}_len_mean": F.round(f"{w}_len_mean", 2) for w in ("benign", "dga")}
    return stats.withColumns(rounded).join(F.broadcast(inside)).join(F.broadcast(area))


def threshold_eval(rows: DataFrame, label: Column, fires: Column) -> DataFrame:
    """Confusion counts and accuracy of a fixed cut-off."""
    hit = F.coalesce(fires, F.lit(False))
    return rows.agg(F.count_if(label & hit).alias("tp"), F.count_if(~label & ~hit).alias("tn"),
                    F.count_if(~label & hit).alias("fp"), F.count_if(label & ~hit).alias("fn"),
                    F.round(F.try_divide(F.count_if(label == hit), _n()), 4).alias("accuracy"))


# Alert class that counts as correct for each generated label.
EXPECTED = {"ddos": "ddos", "slowloris": "ddos", "slowloris_tool": "ddos",
            "dns_tunnel": "dns_tunnel", "dga": "dga", "c2_beacon": "c2_beacon",
            "port_scan": "port_scan", "tls_malware": "tls_malware",
            "exfiltration": "exfiltration"}
BENIGN = ("benign", "benign_keepalive")


def _outcomes(labelled: DataFrame, found: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Labelled flows with the set of classes raised for each (at most seven values)."""
    keys = ["flow_id", *extra]
    classes = found.groupBy(*keys).agg(F.collect_set("threat_class").alias("classes"))
    return labelled.join(classes, keys, "left").withColumn(
        "classes", F.coalesce("classes", F.array().cast("array<string>")))


def per_class_detection_rate(labelled: DataFrame, found: DataFrame) -> DataFrame:
    """Share of each label found as its expected class, and with any alert."""
    expected = F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv])
    right = F.array_contains("classes", F.try_element_at(expected, F.col("label")))
    return _outcomes(labelled, found).groupBy("label").agg(
        _n().alias("n"),
        F.round(F.avg(F.coalesce(right, F.lit(False)).cast("int")), 4).alias("detected_correct_class"),
        F.round(F.avg((F.size("classes") > 0).cast("int")), 4).alias("any_alert"))


def multi_seed_summary(runs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.round(F.avg(value), 4).alias("mean"),
                                   F.round(F.min(value), 4).alias("min"),
                                   F.round(F.max(value), 4).alias("max"))


# ------------------------------------------------------------ one-way ablation
TWO_SIDED = ("syn_to_ack_ratio", "amplification_ratio", "byte_ratio_outbound")
MODES = ("bidirectional", "unidirectional", "recovered")


def strip_two_sided(flows: DataFrame) -> DataFrame:
    return flows.withColumn("raw_features", F.map_filter(
        "raw_features", lambda k, v: ~k.isin(*TWO_SIDED)))


def add_one_sided_substitutes(flows: DataFrame) -> DataFrame:
    rate = F.col("packet_count") / F.greatest(F.coalesce("duration_seconds", F.lit(0.0)), F.lit(1e-6))
    amp = F.when(F.col("dst_port").isin(*S.AMPLIFIER_PORTS), rate).otherwise(0.0)
    names = ("packet_rate_one_sided", "amplifier_request_rate", "outbound_bytes_abs",
             "bytes_per_packet")
    values = (rate, amp, F.col("bytes_transferred").cast("double"),
              F.col("bytes_transferred") / F.greatest("packet_count", F.lit(1)))
    kept = F.map_filter("raw_features", lambda k, v: ~k.isin(*names))
    added = F.create_map(*[x for n, v in zip(names, values) for x in (F.lit(n), v)])
    return flows.withColumn("raw_features", F.map_concat(kept, added))


def two_sided_rules(flows: DataFrame) -> DataFrame:
    """Classes reachable from the features that need the return direction."""
    syn, amplified, outbound = (F.coalesce(F.try_element_at("raw_features", F.lit(n)), F.lit(0.0)) for n in TWO_SIDED)
    flood = (syn > S.SYN_TO_ACK_CEILING) | ((amplified > S.AMPLIFICATION_CEILING) & (F.lower("protocol") == "udp"))
    return flows.withColumn("classes", F.array_compact(F.array(
        F.when(flood, F.lit("ddos")), F.when(outbound > S.OUTBOUND_RATIO_CEILING, F.lit("exfiltration")))))


def one_sided_rules(flows: DataFrame) -> DataFrame:
    """Classes reachable from the one-way substitutes alone."""
    f = {n: F.coalesce(F.try_element_at("raw_features", F.lit(n)), F.lit(0.0)) for n in (
        "packet_rate_one_sided", "amplifier_request_rate", "outbound_bytes_abs",
        "bytes_per_packet")}
    flood = (f["packet_rate_one_sided"] > 50.0) | (f["amplifier_request_rate"] > 20.0)
    bulk = (f["outbound_bytes_abs"] > 1_000_000) & (f["bytes_per_packet"] > 500.0)
    return flows.withColumn("classes", F.array_compact(F.array(
        F.when(flood, F.lit("ddos")), F.when(bulk, F.lit("exfiltration")))))


def _class_scores(outcomes: DataFrame, classes: Sequence[str], by: Sequence[str],
                  all_false_positives: bool) -> DataFrame:
    """tp/fp/fn per class. False positives come from benign rows only, or from any row of
    another class."""
    rows = outcomes.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    fired = F.array_contains("classes", F.col("class"))
    other = F.col("label") != F.col("class")
    wrong = other if all_false_positives else other & F.col("label").isin(*BENIGN)
    return _prf(rows.groupBy(*by, "class").agg(
        F.count_if((F.col("label") == F.col("class")) & fired).alias("tp"),
        F.count_if(wrong & fired).alias("fp"),
        F.count_if((F.col("label") == F.col("class")) & ~fired).alias("fn")))


def one_sided_ablation(labelled: DataFrame, detect: Callable[[DataFrame], DataFrame],
                       classes: Sequence[str] = S.THREAT_CLASSES) -> DataFrame:
    """Precision, recall and F1 per class with both directions, one, and substitutes.

    Each mode runs its own detection, so keyed detectors never see another mode's flows.
    """
    parts = []
    for mode in MODES:
        work = labelled if mode == MODES[0] else strip_two_sided(labelled)
        if mode == MODES[2]:
            work = add_one_sided_substitutes(work)
        outcomes = _outcomes(labelled.select("flow_id", "label"), detect(work))
        parts.append(outcomes.withColumn("mode", F.lit(mode)))
    return _class_scores(reduce(DataFrame.unionByName, parts), classes, ["mode"], False)


def ablation_cost(scores: DataFrame) -> DataFrame:
    """F1 lost by seeing one direction, and what the substitutes regain."""
    wide = scores.groupBy("class").pivot("mode", list(MODES)).agg(F.first("f1"))
    return wide.withColumns({
        "cost": F.round(F.col("bidirectional") - F.col("unidirectional"), 4),
        "regained": F.round(F.col("recovered") - F.col("unidirectional"), 4)})


# ------------------------------------------------------------------ packet loss
LOSS_LEVELS = (0.0, 0.01, 0.02, 0.05, 0.10, 0.20)


#: Derived features that draws change, also where a flow has no packet times.
_DRAWN_FEATURES = ("syn_to_ack_ratio", "byte_ratio_outbound")


def packet_loss_resample(flows: DataFrame, levels: Sequence[float] = LOSS_LEVELS, trials: int = 5,
                         seed: int = 42, partitions: int | None = None, alike_once: bool = False) -> DataFrame:
    """Flows as a lossy tap would have seen them, one copy per loss level and trial.

    With ``alike_once`` copies that no draw tells apart, those without loss and those of flows that
    have neither packet times nor a drawn feature, are made once a level, as trial -1.

    ``partitions`` deals flows that come from few files over so many tasks before they multiply.

    Every packet survives with probability 1 - p by a repeatable draw; at least one always
    does. Counters scale with the surviving share; times and sizes follow the survivors.
    """
    if partitions is not None:
        flows = flows.repartition(partitions, "flow_id")
    n = F.size(F.coalesce("timestamps", F.array().cast("array<double>")))
    p, place = F.col("loss"), F.sequence(F.lit(0), F.col("_n") - 1)

    def draw(what: str, i: Column | None = None) -> Column:
        key = [F.col("flow_id"), F.lit(what), F.col("trial"), F.lit(seed)]
        return _unit(*key, *([] if i is None else [i]))

    # A trial's draws don't depend on the level, so they are made before levels multiply the rows.
    each = F.sequence(F.lit(0), F.lit(trials - 1))
    if alike_once:
        drawn_too = F.lit(False) if "raw_features" not in flows.columns else F.coalesce(
            F.arrays_overlap(F.map_keys("raw_features"), F.array(*[F.lit(f) for f in _DRAWN_FEATURES])), F.lit(False))
        lossy_levels = F.lit(any(x > 0 for x in levels)) & ((n > 0) | drawn_too)
        each = F.concat(F.array(F.lit(-1)), F.when(lossy_levels, each).otherwise(F.array().cast("array<int>")))
        levels_of = F.filter(F.array(*[F.lit(float(x)) for x in levels]), lambda x: F.when(
            lossy_levels, (x > 0) == (F.col("trial") >= 0)).otherwise(F.lit(True)))
    else:
        levels_of = F.array(*[F.lit(float(x)) for x in levels])
    trial_rows = flows.withColumn("trial", F.explode(each)).withColumn("_n", n) \
        .withColumns({"_draws": F.when(F.col("_n") > 0, F.transform(place, lambda i: draw("packet", i))),
                      "_lucky": F.when(F.col("_n") > 0, F.floor(draw("keep") * F.col("_n")).cast("int"))})
    copies = trial_rows.withColumn("loss", F.explode(levels_of)) \
        .select(*[c for c in flows.columns if c not in ("loss", "trial")], "loss", "trial", "_n", "_draws", "_lucky")
    drawn = F.filter(place, lambda i: F.get("_draws", i) >= p)
    staged = copies.withColumn("_drawn", F.when((F.col("_n") > 0) & (p > 0), drawn)).withColumn(
        "_kept", F.when(F.size("_drawn") == 0, F.array("_lucky")).otherwise(F.col("_drawn")))
    share = F.when(p <= 0, 1.0).when(F.col("_n") > 0, F.size("_kept") / F.col("_n")).otherwise(1 - p)
    sized = staged.withColumn("_share", share)
    lossy = F.col("loss") > 0
    series = F.when(F.col("_kept").isNotNull(), F.transform(
        "_kept", lambda i: F.get("timestamps", i))).otherwise(F.col("timestamps"))
    sizes = {} if "packet_sizes" not in flows.columns else {"packet_sizes": F.when(
        F.col("_kept").isNotNull() & (F.size("packet_sizes") > 0), F.transform(F.filter(
            "_kept", lambda i: i < F.size("packet_sizes")), lambda i: F.get("packet_sizes", i)))
        .otherwise(F.col("packet_sizes"))}
    scaled = {c: F.bround(F.col(c) * F.col("_share")).cast("bigint")
              for c in ("packet_count", "bytes_transferred")}
    out = sized.withColumns({
        "timestamps": series, **sizes,
        "packet_count": F.when(lossy, F.greatest(F.lit(1), scaled["packet_count"]))
                         .otherwise(F.col("packet_count")),
        "bytes_transferred": F.when(lossy, scaled["bytes_transferred"])
                              .otherwise(F.col("bytes_transferred"))})
    timed = lossy & (F.size("timestamps") >= 2)
    first, last = F.get("timestamps", F.lit(0)), F.element_at("timestamps", -1)
    out = out.withColumns({
        "start_time": F.when(timed, first).otherwise(F.col("start_time")),
        "end_time": F.when(timed, last).otherwise(F.col("end_time")),
        "duration_seconds": F.when(timed, F.round(F.greatest(last - first, F.lit(0.001)), 4))
                             .otherwise(F.col("duration_seconds"))})
    if "raw_features" in flows.columns:
        out = out.withColumn("raw_features", F.when(lossy, _degraded(draw)).otherwise(
            F.col("raw_features")))
    return out.drop("_n", "_draws", "_lucky", "_drawn", "_kept", "_share")


def _degraded(draw: Callable[..., Column]) -> Column:
    """Derived features under the same loss."""
    p, share = F.col("loss"), F.col("_share")

    def survivors(what: str, n: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(1), n), lambda i: draw(what, i) >= p))

    def changed(key: Column, value: Column) -> Column:
        syn = survivors("syn", F.greatest(F.lit(1), F.bround(value * 20).cast("int")))
        syn_ratio = F.round(syn / F.greatest(survivors("ack", F.lit(20)), F.lit(1)), 3)
        out_kept, in_kept = (F.greatest(1 - p * (0.5 + draw(side)), F.lit(0.01))
                             for side in ("out", "in"))
        return F.when(key == "syn_to_ack_ratio", syn_ratio) \
            .when(key == "byte_ratio_outbound", F.round(value * out_kept / in_kept, 3)) \
            .when(key.isin("txt_query_volume", "unique_dst_ports", "unique_dst_hosts"),
                  F.bround(value * share)) \
            .when(key == "query_frequency", F.round(value * share, 3)) \
            .when(key == "avg_packet_interval", F.round(F.try_divide(value, share), 4)) \
            .otherwise(value)

    return F.transform_values("raw_features", changed)


def loss_study(labelled: DataFrame, detect: Callable[[DataFrame], DataFrame],
               classes: Sequence[str] = S.THREAT_CLASSES, levels: Sequence[float] = LOSS_LEVELS,
               trials: int = 5, **resample) -> DataFrame:
    """Macro F1 per loss level, averaged over trials.

    ``detect`` takes the stacked copies, whose ``flow_id`` names level and trial too, and
    must judge each flow by itself. Copies that are alike are judged once, as trial -1 for all trials.
    Copies are never shuffled: what a class made of a flow's copies is a bit per copy, which combines
    map-side, so that only flows meet their labels.
    """
    tag = F.concat_ws("#", F.col("loss").cast("string"), F.col("trial").cast("string"))
    copies = packet_loss_resample(labelled, levels=levels, trials=trials, alike_once=True, **resample).withColumn(
        "flow_id", F.concat_ws("#", "flow_id", tag))
    spark, width = labelled.sparkSession, 62
    places = [(f"{float(p)}#{t}", float(p), t) for p in dict.fromkeys(levels) for t in range(trials)]
    # A name's places begin at its own or, for a copy that stands for all trials, at its level's first.
    first = [(f"{float(p)}#-1", i * trials) for i, p in enumerate(dict.fromkeys(levels))]
    table = F.create_map(*[F.lit(x) for name, i in [*first, *((name, i) for i, (name, _, _) in enumerate(places))] for x in (name, i)])
    suffix = F.substring_index("flow_id", "#", -2)
    words = range(-(-len(places) // width))

    def bits(w: int) -> Column:
        lo = F.greatest(F.col("_at") - w * width, F.lit(0))
        n = F.least(F.col("_at") + F.col("_many") - w * width, F.lit(width)) - lo
        run = F.call_function("shiftleft", F.lit(1).cast("bigint"), n) - 1
        return F.when(n > 0, F.call_function("shiftleft", run, lo)).otherwise(F.lit(0).cast("bigint"))

    fired = detect(copies).where(F.col("threat_class").isin(*classes)).select(
        F.expr("left(flow_id, length(flow_id) - length(substring_index(flow_id, '#', -2)))").alias("_flow"),
        F.col("threat_class").alias("class"), F.try_element_at(table, suffix).alias("_at"),
        F.when(suffix.endswith("#-1"), trials).otherwise(1).alias("_many")).groupBy("_flow", "class").agg(*[
            F.bit_or(bits(w)).alias(f"_w{w}") for w in words])
    # A flow without an id is one whose copies are named by level and trial alone.
    flows = labelled.select("label", F.when(F.col("flow_id").isNull(), "").otherwise(
        F.concat("flow_id", F.lit("#"))).alias("_flow"))
    masks = flows.join(fired, "_flow").groupBy("label", "class", *[f"_w{w}" for w in words]).agg(_n().alias("_rows"))
    hits = masks.select("label", "class", "_rows", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(len(places) - 1)), lambda i: reduce(Column.__or__, [
            (F.floor(i / width) == w) & (F.call_function("shiftright", F.col(f"_w{w}"), i % width).bitwiseAND(1) == 1)
            for w in words]))).alias("_at"))
    right = F.col("label") == F.col("class")
    found = hits.groupBy("class", "_at").agg(F.sum(F.when(right, F.col("_rows")).otherwise(0)).alias("tp"),
                                             F.sum(F.when(~right, F.col("_rows")).otherwise(0)).alias("fp"))
    sizes = labelled.groupBy(F.col("label").alias("class")).agg(_n().alias("_size"))
    cells = spark.createDataFrame([(c, i, p, t) for c in classes for i, (_, p, t) in enumerate(places)],
                                  "class string, _at int, loss double, trial int")
    counts = cells.join(found, ["class", "_at"], "left").join(sizes, "class", "left").select(
        "class", "loss", "trial", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp")],
        (F.coalesce("_size", F.lit(0)) - F.coalesce("tp", F.lit(0))).alias("fn"))
    seen = _prf(counts).where((F.col("tp") + F.col("fp") + F.col("fn")) > 0)
    per_trial = seen.groupBy("loss", "trial").agg(F.round(F.avg("f1"), 4).alias("macro_f1"))
    return per_trial.groupBy("loss").agg(F.round(F.avg("macro_f1"), 4).alias("macro_f1"),
                                         _n().alias("trials"))


# ------------------------------------------------------------- gates, roll-up
def regression_gate(baseline: DataFrame, current: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Per metric: baseline, current and whether it holds.

    Both sides have ``metric``, ``kind`` and ``rate``; a detection rate may not drop and a
    ``false_positive`` rate may not rise by more than the tolerance. A metric missing from
    the current run fails.
    """
    joined = baseline.withColumnRenamed("rate", "baseline").join(
        current.select("metric", F.col("rate").alias("current")), "metric", "left")
    holds = F.when(F.col("kind") == "false_positive",
                   F.col("current") <= F.col("baseline") + tolerance) \
             .otherwise(F.col("current") >= F.col("baseline") - tolerance)
    return joined.withColumn("holds", F.coalesce(holds, F.lit(False)))


def gate_passes(gate: DataFrame) -> DataFrame:
    return gate.agg(F.coalesce(F.bool_and("holds"), F.lit(True)).alias("passes"))


def evaluation_rollup(artifacts: DataFrame, expected: Sequence[str]) -> DataFrame:
    """One row per expected artifact: its metrics as JSON, or marked unavailable.

    ``artifacts`` has ``artifact``, ``metric`` and ``value``. ``fingerprint`` ignores the
    generation time, so equal content always compares equal.
    """
    entries = F.array_sort(F.collect_list(F.struct("metric", "value")))
    timeless = F.filter("_entries", lambda e: e["metric"] != "generated_at")
    packed = artifacts.groupBy("artifact").agg(entries.alias("_entries"))
    wanted = artifacts.sparkSession.createDataFrame([(a,) for a in expected], "artifact string")
    return wanted.join(packed, "artifact", "left").select(
        "artifact", F.when(F.col("_entries").isNull(), "unavailable").otherwise("available")
                     .alias("status"),
        F.to_json(F.map_from_entries("_entries")).alias("metrics"),
        F.sha2(F.to_json(timeless), 256).alias("fingerprint"))


def stale_artifacts(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Artifacts whose stored roll-up differs from a fresh one."""
    return fresh.select("artifact", "fingerprint").join(
        stored.select("artifact", F.col("fingerprint").alias("_old")), "artifact", "left") \
        .where(~F.col("fingerprint").eqNullSafe(F.col("_old"))).select("artifact")

