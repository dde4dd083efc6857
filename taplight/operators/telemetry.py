"""Traffic and latency telemetry over time."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import sorted_scan


def second_buckets(flows: DataFrame, ts: str = "start_time", seconds: int = 1) -> DataFrame:
    """Flows, packets and bytes seen per tumbling bucket."""
    bucket = F.floor(F.col(ts) / seconds) * seconds
    return flows.groupBy(bucket.alias("second")).agg(
        F.count(F.lit(1)).alias("flows"), F.sum("packet_count").alias("packets"),
        F.sum("bytes_transferred").alias("bytes"))


def time_series_zero_filled(flows: DataFrame, now: int, buckets: int = 60,
                            bucket_seconds: int = 1, ts: str = "start_time") -> DataFrame:
    """Fixed buckets up to ``now``, oldest first, empty ones as zeros."""
    first = now - buckets * bucket_seconds
    inside = flows.where((F.col(ts) >= first) & (F.col(ts) < now))
    number = F.floor((F.col(ts) - first) / bucket_seconds)
    seen = inside.groupBy(number.alias("bucket")).agg(
        F.count(F.lit(1)).alias("flows"), F.sum("packet_count").alias("packets"),
        F.sum("bytes_transferred").alias("bytes"))
    frame = flows.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    zero = F.lit(0).cast("bigint")
    return frame.join(seen, "bucket", "left").select(
        ((F.col("bucket") - buckets) * bucket_seconds).alias("offset_s"),
        *[F.coalesce(c, zero).alias(c) for c in ("flows", "packets", "bytes")]).orderBy("offset_s")


def throughput_rates(flows: DataFrame, interval: int = 60, ts: str = "start_time") -> DataFrame:
    """Rates per interval, with the busiest second inside it."""
    seconds = second_buckets(flows, ts)
    start = F.floor(F.col("second") / interval) * interval
    return seconds.groupBy(start.alias("interval_start")).agg(
        F.round(F.sum("flows") / interval, 2).alias("flows_per_sec"),
        F.round(F.sum("packets") / interval, 2).alias("packets_per_sec"),
        F.round(F.sum("bytes") / interval, 2).alias("bytes_per_sec"),
        F.max("flows").alias("peak_flows_per_sec"))


def latency_percentiles(samples: DataFrame, value: str, ts: str, tie: str,
                        last: int = 1000) -> DataFrame:
    """Nearest-rank percentiles of the newest ``last`` samples."""
    recent = samples.orderBy(F.desc(ts), F.desc(tie)).limit(last)
    window = recent.agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("v"))

    def rank(q: float) -> Column:
        return F.round(F.get("v", F.bround(q * (F.size("v") - 1)).cast("int")), 3)

    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x)
    return window.select(
        F.size("v").alias("samples"), rank(0.50).alias("p50_ms"), rank(0.95).alias("p95_ms"),
        rank(0.99).alias("p99_ms"), F.round(F.array_min("v"), 3).alias("min_ms"),
        F.round(F.array_max("v"), 3).alias("max_ms"),
        F.round(F.try_divide(total, F.size("v")), 3).alias("mean_ms"))


def values_at_ranks(samples: DataFrame, value: str, ranks: Sequence[int], bins: int = 4096) -> dict[int, float]:
    """The values that stand at ``ranks`` (from 0) when all samples are sorted, without sorting them.

    Each round counts the samples of the ranges still open in ``bins`` equal parts, a map-side
    count, and goes on with the part that holds the rank, between its own least and greatest
    value. A round tells at least the two apart, and most narrow a range thousandfold. At most
    ``bins`` rows a rank reach the driver. Nulls and NaN are no samples.
    """
    v = F.col("v")
    rows = samples.select(F.col(value).cast("double").alias("v")).where(v.isNotNull() & ~F.isnan(v))
    bounds = rows.agg(F.min("v"), F.max("v")).first()
    open_, found = {r: (bounds[0], bounds[1], 0) for r in ranks}, {}
    while open_:
        found.update({r: lo for r, (lo, hi, _) in open_.items() if lo == hi})
        open_ = {r: x for r, x in open_.items() if r not in found}
        if not open_:
            break
        # Open ranges are the same or apart, so a sample lies in one of them at most.
        ranges = sorted({x[:2] for x in open_.values()})
        part = F.lit(None).cast("int")
        for k, (lo, hi) in enumerate(ranges):
            # Halved only where the width of a range exceeds the largest number: half of the least is 0.
            half = 2.0 if math.isinf(hi - lo) else 1.0
            share = (v / half - lo / half) / (hi / half - lo / half)
            part = F.when((v >= lo) & (v <= hi), k * bins + F.least(F.lit(bins - 1), F.floor(share * bins))).otherwise(part)
        counted = sorted(map(tuple, rows.groupBy(part.alias("part")).agg(
            F.count(F.lit(1)), F.min("v"), F.max("v")).where("part is not null").collect()))
        for r, (lo, hi, before) in open_.items():
            k = ranges.index((lo, hi))
            for at, n, least, most in counted:
                if at // bins == k:
                    if before + n > r:
                        open_[r] = (least, most, before)
                        break
                    before += n
    return found


def latency_percentiles_exact(samples: DataFrame, value: str) -> DataFrame:
    """Nearest-rank percentiles over any number of samples: the columns of ``latency_percentiles``."""
    v = F.col(value).cast("double")
    kept = samples.where(v.isNotNull() & ~F.isnan(v))
    total = kept.agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"))
    n, lo, hi, mean = total.first()
    ranks = {q: round(q * (n - 1)) for q in (0.50, 0.95, 0.99)} if n else {}
    at = values_at_ranks(kept, value, sorted(set(ranks.values())))
    cells = [n, *(at.get(ranks.get(q)) for q in (0.50, 0.95, 0.99)), lo, hi, mean]
    names = ["p50_ms", "p95_ms", "p99_ms", "min_ms", "max_ms", "mean_ms"]
    row = samples.sparkSession.createDataFrame([cells], "samples bigint, " + ", ".join(f"{c} double" for c in names))
    return row.select("samples", *[F.round(c, 3).alias(c) for c in names])


def latency_percentiles_approx(samples: DataFrame, value: str, accuracy: int = 10_000) -> DataFrame:
    """Whole-table percentiles by mergeable sketch, for series too long to hold."""
    p = F.percentile_approx(value, [0.5, 0.95, 0.99], accuracy)
    return samples.agg(F.count(F.lit(1)).alias("samples"), p.alias("p")).select(
        "samples", *[F.get("p", F.lit(i)).alias(n)
                     for i, n in enumerate(("p50_ms", "p95_ms", "p99_ms"))])


def latency_ema(samples: DataFrame, keys: list[str], ts: str, tie: str, value: str) -> DataFrame:
    """Final moving average (0.9 old, 0.1 new, two decimals at each step) per key.

    The rounding makes every step depend on the one before, so a key is read in order;
    rows are streamed and nothing but the current average is held. Keys should be time
    slices (an exporter's hour, say), which bounds what one task reads.
    """
    schema = T.StructType([*[samples.schema[k] for k in keys], T.StructField("ema", T.DoubleType()),
                           T.StructField("samples", T.LongType())])

    def scan(batches):
        current, ema, n = None, 0.0, 0
        for pdf in batches:
            done = []
            for key, x in zip(zip(*[pdf[k] for k in keys]), pdf[value]):
                if key != current:
                    if current is not None:
                        done.append((*current, ema, n))
                    current, ema, n = key, 0.0, 0
                ema = round(ema * 0.9 + x * 0.1 if ema else x, 2)
                n += 1
            yield pd.DataFrame(done, columns=[*keys, "ema", "samples"])
        if current is not None:
            yield pd.DataFrame([(*current, ema, n)], columns=[*keys, "ema", "samples"])

    return sorted_scan(samples.select(*keys, ts, tie, value), keys, [ts, tie], scan, schema)


def loss_accounting(gaps: DataFrame, processed: DataFrame, exporter: str = "exporter") -> DataFrame:
    """Sent, received, lost and unprocessed records per exporter.

    ``gaps`` is the output of ``export_sequence_gaps``; ``processed`` counts decoded rows.
    """
    return gaps.join(processed, exporter, "left").select(
        exporter, (F.col("records") + F.col("lost_records")).alias("sent"),
        F.col("records").alias("received"), "lost_records",
        F.greatest(F.lit(0), F.col("records") - F.coalesce("processed", F.lit(0)))
         .alias("unprocessed"))
