"""All detectors over one flow stream.

Every keyed detector is an ordered fold that hands its rows' identity on; the verdicts and the
evidence are the columns of the batch detectors, so one text serves both. The two beacon tests
are chained: the destination test runs on what the pair test has judged, and leaves its hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings as S
from ..operators import beacon, ddos, dns, exfil, scan, slow_rate
from ..operators.common import IDENTITY
from . import folds
from .ordered_fold import Fold, ordered_fold, with_event_time


def _carried(rows: DataFrame, keys: list[str], fold: Fold, lateness: str, carry: list[str],
             wanted: str | None = None) -> DataFrame:
    """``carry`` columns of the rows with what the fold adds, and their event time.

    Column names may not begin with an underscore: Spark's worker would leave them out.
    """
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name in carry]
    return ordered_fold(rows, keys, "start_time", "flow_id", folds.Carrying(fold, fields, wanted), lateness)


def _timed(flows: DataFrame, lateness: str) -> DataFrame:
    """``flows`` with a watermark that every row moves, also those that a detector leaves out.

    All columns are tied to the event time, since Spark moves other filters below the watermark;
    there, one branch that keeps few rows would hold back the watermark of all.
    """
    timed = flows if "event_time" in flows.columns else with_event_time(flows, "start_time", lateness)
    return timed.select(*[F.when(F.col("event_time").isNotNull(), F.col(c)).alias(c) if c != "event_time" else c
                          for c in timed.columns])


def ddos_stream(flows: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    extra = ["rate_hit", "pkt_rate", "byte_rate", "avg_pkt"]
    rows = ddos.with_rate_verdicts(_timed(flows, lateness)).withColumns({
        "rate_hit": F.col("_rate"), "fires": F.col("_rate") | F.col("_amp")}).select(
        *IDENTITY, *extra, "fires", "event_time")
    return ddos.ddos_detections(_carried(rows, ["dst_ip"], folds.SourceEntropy(), lateness, [
        *IDENTITY, *extra], "fires").withColumnRenamed("rate_hit", "_rate"))


def beacon_stream(flows: DataFrame, lateness: str = "10 seconds",
                  idle: float = S.STATE_IDLE_SECONDS["beacon"]) -> DataFrame:
    port = F.coalesce(F.col("dst_port"), F.lit(-1))
    rows = _timed(flows, lateness).where((port != 53) & (F.coalesce("src_port", F.lit(-1)) != 53)).select(
        *IDENTITY, port.alias("port"), "event_time")
    measures = ["cv", "periodicity_score", "dominant_period", "jitter", "confidence", "severity"]
    pair = beacon.periodic_series(
        _carried(rows, ["src_ip", "dst_ip", "port"], folds.TrailingStarts(S.BEACON_PAIR_ROWS, ttl=idle),
                 lateness, [*IDENTITY, "port"]), "series", keep_all=True)
    judged = pair.select(*IDENTITY, "port", F.col("_regular").alias("pair_hit"),
                         *[F.col(m).alias(f"pair_{m}") for m in measures], "event_time")
    both = beacon.periodic_series(
        _carried(judged, ["dst_ip", "port"], folds.TrailingStarts(
            S.BEACON_DESTINATION_ROWS, sparse_only=True, ttl=idle, every_row=True), lateness,
            [c for c in judged.columns if c not in ("port", "event_time")]), "series", keep_all=True)
    # Rows are dropped by a generator: in a stream's filter the spectrum can't be evaluated.
    found = both.withColumn("hit", F.explode(F.when(F.col("pair_hit") | F.col("_regular"), F.array(F.lit(1)))))
    return beacon.beacon_detections(found.select(*IDENTITY, *[
        F.when(F.col("pair_hit"), F.col(f"pair_{m}")).otherwise(F.col(m)).alias(m) for m in measures]))


def scan_stream(flows: DataFrame, lateness: str = "10 seconds", cap: int | None = None,
                idle: float = S.STATE_IDLE_SECONDS["scan"]) -> DataFrame:
    """Exact counts unless ``cap`` bounds the flow keys that a source's state holds."""
    raw = F.col("raw_features")
    rows = _timed(flows, lateness).select(
        *IDENTITY, "dst_ports", "event_time", *[F.try_element_at(raw, F.lit(f"unique_dst_{n}")).cast("bigint").alias(
            f"summary_{n}") for n in ("ports", "hosts")])
    counted = _carried(rows, ["src_ip"], folds.ScanFanout(cap, idle), lateness, list(IDENTITY))
    return scan.scan_detections(scan.port_scan_rule(counted))


def slow_rate_stream(flows: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    extra = ["pkt_rate", "byte_rate", "avg_pkt", "slow_duration", "slow_end"]
    rows = slow_rate.slow_rate_candidate(_timed(flows, lateness)).select(*IDENTITY, *extra, "event_time")
    counted = _carried(rows, ["dst_ip", "dst_port"], folds.SlowConnections(), lateness, [*IDENTITY, *extra])
    return slow_rate.slow_rate_detections(slow_rate.graded(counted.where(
        F.col("concurrent") >= S.SLOW_MIN_CONCURRENT)))


def detect_stream(flows: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """Detections of every rule detector, each flow's once the watermark has passed its start.

    The result is that of ``detect_all`` with ``settings.STATE_IDLE_SECONDS`` on the same rows.
    ``flows`` has epoch seconds in ``start_time``; rows without a time take part in no keyed detector.
    """
    keyed = [f(flows, lateness) for f in (ddos_stream, beacon_stream, scan_stream, slow_rate_stream)]
    return reduce(DataFrame.unionByName, [*keyed, exfil.exfil_detect(flows), dns.dns_tunnel_detect(flows)])
