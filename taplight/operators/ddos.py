"""Volumetric denial of service: rate rules, source entropy, forest score."""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings as S
from ..session import cut_lineage
from .common import (COPY, IDENTITY, detections, evidence, join_null_safe, text, with_copy_number,
                     with_rates)
from .ordered import CHUNK, HOME, bucketed, chunked, sorted_scan


def rate_confidence(rate: Column, threshold: float) -> Column:
    """0.5 at the threshold, rising to 1.0 at twenty times it."""
    ceiling = threshold * S.RATE_CEILING_FACTOR
    share = F.least(F.lit(1.0), (rate - threshold) / (ceiling - threshold))
    return F.round(0.5 + 0.5 * share, 4)


def _rate_hit() -> Column:
    return (F.col("pkt_rate") > S.RATE_THRESHOLD) & (F.col("avg_pkt") < S.SMALL_PACKET_CEILING)


def _amplifier_hit() -> Column:
    return (~_rate_hit() & F.col("dst_port").isin(*S.AMPLIFIER_PORTS)
            & (F.col("pkt_rate") > S.AMPLIFIER_RATE_THRESHOLD)
            & (F.lower("protocol") == "udp")
            & (F.col("avg_pkt") < S.SMALL_PACKET_CEILING))


def ddos_rate_rule(flows: DataFrame) -> DataFrame:
    """Flows above 111 packets per second with small packets."""
    return with_rates(flows).where(_rate_hit()) \
        .withColumn("confidence", rate_confidence(F.col("pkt_rate"), S.RATE_THRESHOLD)) \
        .withColumn("severity", F.when(F.col("confidence") > 0.75, "high").otherwise("medium"))


def ddos_amplifier_rule(flows: DataFrame) -> DataFrame:
    """UDP request floods at amplifier ports that the rate rule did not already take."""
    return with_rates(flows).where(F.coalesce(_amplifier_hit(), F.lit(False))) \
        .withColumn("confidence",
                    rate_confidence(F.col("pkt_rate"), S.AMPLIFIER_RATE_THRESHOLD)) \
        .withColumn("severity", F.lit("medium"))


_ENTROPY = T.StructType([T.StructField("flow_id", T.StringType()),
                         T.StructField("start_time", T.DoubleType()),
                         T.StructField(COPY, T.IntegerType()),
                         T.StructField("src_ip_entropy", T.DoubleType())])


def _entropy_scan(window: float, cap: int):
    weight = [0.0] + [c * math.log2(c) for c in range(1, cap + 2)]

    def scan(batches):
        key, recent, counts, mass = None, deque(), {}, 0.0
        for pdf in batches:
            ids, times, copies, values = [], [], [], []
            for dst, chunk, ts, src, flow, copy, wanted in zip(
                    pdf["dst_ip"], pdf[CHUNK], pdf["start_time"], pdf["src_ip"],
                    pdf["flow_id"], pdf[COPY], pdf["_wanted"]):
                if (dst, chunk) != key:
                    key, recent, counts, mass = (dst, chunk), deque(), {}, 0.0
                recent.append((ts, src))
                c = counts.get(src, 0) + 1
                counts[src] = c
                mass += weight[c] - weight[c - 1]
                while len(recent) > cap or recent[0][0] < ts - window:
                    _, old = recent.popleft()
                    c = counts.pop(old) - 1
                    mass += weight[c] - weight[c + 1]
                    if c:
                        counts[old] = c
                if wanted:
                    n = len(recent)
                    if n < 2:
                        entropy = 1.0
                    elif len(counts) == 1:
                        entropy = 0.0
                    else:
                        entropy = (math.log2(n) - mass / n) / math.log2(len(counts))
                    ids.append(flow)
                    times.append(ts)
                    copies.append(copy)
                    values.append(entropy)
            yield pd.DataFrame({"flow_id": ids, "start_time": times, COPY: copies,
                                "src_ip_entropy": values})

    return scan


def source_ip_entropy(flows: DataFrame, wanted: Column | None = None,
                      window: float = S.ENTROPY_WINDOW_SECONDS,
                      cap: int = S.ENTROPY_WINDOW_ROWS,
                      bucket_seconds: float = 60.0) -> DataFrame:
    """Normalised entropy of the sources toward each flow's destination.

    Over the trailing ``window`` seconds, at most ``cap`` flows. A destination under flood
    is cut into chunks with their lead-in, so it spreads over tasks; each chunk is streamed
    with sliding counts. ``wanted`` limits which rows get an answer, not what they see.
    """
    return _entropies(with_copy_number(flows), wanted, window, cap, bucket_seconds).drop(COPY)


def _entropies(flows: DataFrame, wanted: Column | None = None,
               window: float = S.ENTROPY_WINDOW_SECONDS, cap: int = S.ENTROPY_WINDOW_ROWS,
               bucket_seconds: float = 60.0) -> DataFrame:
    rows = flows.select("dst_ip", "start_time", "flow_id", COPY, "src_ip",
                        (F.lit(True) if wanted is None else wanted).alias("_wanted"))
    placed = chunked(bucketed(rows, F.col("start_time"), bucket_seconds), ["dst_ip"],
                     ["start_time", "flow_id", COPY], cap - 1)
    asked = placed.withColumn("_wanted", F.col("_wanted") & F.col(HOME)).drop(HOME)
    return sorted_scan(asked, ["dst_ip", CHUNK], ["start_time", "flow_id", COPY],
                       _entropy_scan(window, cap), _ENTROPY)


def with_rate_verdicts(flows: DataFrame) -> DataFrame:
    """``flows`` with their rates, and whether the rate rule or the amplifier rule fires."""
    return with_rates(flows).withColumn("_rate", F.coalesce(_rate_hit(), F.lit(False))) \
                            .withColumn("_amp", F.coalesce(_amplifier_hit(), F.lit(False)))


def ddos_detect(flows: DataFrame) -> DataFrame:
    """Both rate rules with their entropy evidence.

    Only destinations with a firing flow enter the entropy pass.
    """
    # Numbered once and stored narrow; the context and the hits are read from it.
    return ddos_of_numbered(cut_lineage(with_copy_number(flows, IDENTITY)))


def ddos_of_numbered(numbered: DataFrame) -> DataFrame:
    """``ddos_detect`` of stored flows that have their copy numbers."""
    rated = with_rate_verdicts(numbered)
    fires = F.col("_rate") | F.col("_amp")
    hit = rated.where(fires)
    context = join_null_safe(
        rated.select("dst_ip", "start_time", "flow_id", COPY, "src_ip", fires.alias("_fires")),
        hit.select("dst_ip").distinct(), ["dst_ip"], "left_semi")
    entropy = _entropies(context, F.col("_fires"))
    return ddos_detections(join_null_safe(hit, entropy, ["flow_id", "start_time", COPY]))


def ddos_detections(scored: DataFrame) -> DataFrame:
    """Detections of firing flows from their rates and ``src_ip_entropy``."""
    rate, size, h = F.col("pkt_rate"), F.col("avg_pkt"), F.col("src_ip_entropy")
    conf = F.when(F.col("_rate"), rate_confidence(rate, S.RATE_THRESHOLD)) \
            .otherwise(rate_confidence(rate, S.AMPLIFIER_RATE_THRESHOLD))
    entropy_text = text(S.EVIDENCE_TEXT["ddos: source ip entropy toward"], h)
    flood = F.array(
        evidence("packet_rate", F.round(rate, 2), 0.55,
                 text(S.EVIDENCE_TEXT["ddos: sustained one way packet"], rate)),
        evidence("byte_rate", F.round("byte_rate", 2), 0.20,
                 text(S.EVIDENCE_TEXT["ddos: byte rate b s"], F.col("byte_rate"))),
        evidence("avg_packet_size", F.round(size, 1), 0.10,
                 text(S.EVIDENCE_TEXT["ddos: average packet size b"], size)),
        evidence("src_ip_entropy", F.round(h, 3), 0.15, entropy_text))
    amplifier = F.array(
        evidence("packet_rate", F.round(rate, 2), 0.6,
                 text(S.EVIDENCE_TEXT["ddos: request rate to amplifier"], F.col("dst_port"), rate)),
        evidence("src_ip_entropy", F.round(h, 3), 0.4, entropy_text))
    return detections(
        scored.withColumn("_conf", conf), "ddos", "ddos",
        F.when(F.col("_rate") & (F.col("_conf") > 0.75), "high").otherwise("medium"),
        F.col("_conf"), F.when(F.col("_rate"), flood).otherwise(amplifier),
        F.when(F.col("_rate"), "one_sided_rate_v2").otherwise("one_sided_amplifier_v2"))


def ddos_calibration(scores: DataFrame, score: str = "score") -> DataFrame:
    """Score range of benign reference flows; no row for fewer than five."""
    return scores.agg(F.min(score).alias("score_lo"), F.max(score).alias("score_hi"),
                      F.count(F.lit(1)).alias("n")).where(F.col("n") >= 5)


def ddos_forest_detect(scored: DataFrame, calibration: DataFrame) -> DataFrame:
    """Flows the rules left alone that score below every benign reference flow.

    ``scored`` has a ``score`` column (see the forest in ``models``), ``calibration`` the one
    row of ``ddos_calibration``, or none, and then nothing is found.
    """
    rated = with_rates(scored).join(F.broadcast(calibration.select("score_lo", "score_hi")))
    quiet = ~F.coalesce(_rate_hit() | _amplifier_hit(), F.lit(False))
    anomalous = rated.where(quiet & (F.col("pkt_rate") >= S.FOREST_MIN_RATE)
                            & (F.col("score") < F.col("score_lo")))
    span = F.greatest(F.col("score_hi") - F.col("score_lo"), F.lit(1e-6))
    conf = F.round(0.5 + 0.5 * F.least(F.lit(1.0), (F.col("score_lo") - F.col("score")) / span), 4)
    items = F.array(
        evidence("packet_rate", F.round("pkt_rate", 2), 0.4,
                 text(S.EVIDENCE_TEXT["ddos: anomalous packet rate pps"], F.col("pkt_rate"))),
        evidence("byte_rate", F.round("byte_rate", 2), 0.4,
                 text(S.EVIDENCE_TEXT["ddos: anomalous byte rate b"], F.col("byte_rate"))),
        evidence("isolation_forest_score", F.round("score", 4), 0.2,
                 F.lit(S.EVIDENCE_TEXT["ddos: isolation forest score negative"])))
    return detections(anomalous.withColumn("_conf", conf), "ddos", "ddos",
                      F.when(F.col("_conf") > 0.75, "high").otherwise("medium"),
                      F.col("_conf"), items, "isolation_forest_v2")
