"""Timing features over ordered arrays of epoch seconds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings as S

__all__ = [
    "inter_arrival_times", "coefficient_of_variation", "fft_periodicity", "jitter",
    "array_mean", "with_beacon_features", "destination_rarity", "size_sequence_stats",
    "packet_size_sequence",
]


def inter_arrival_times(series: Column) -> Column:
    """Differences of neighbours; empty for fewer than two points."""
    n = F.coalesce(F.size(series), F.lit(0))
    gaps = F.zip_with(F.slice(series, F.lit(2), F.greatest(n - 1, F.lit(0))),
                      F.slice(series, F.lit(1), F.greatest(n - 1, F.lit(0))),
                      lambda later, earlier: later - earlier)
    return F.when(n >= 2, gaps).otherwise(F.array().cast("array<double>"))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    A plain column expression inside a lambda would be evaluated again per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_mean(values: Column) -> Column:
    return _let(values, lambda v: F.try_divide(
        F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x), F.size(v)))


def _moments(values: Column, deviation, finish) -> Column:
    """``finish(sum of deviations from the mean, n, mean)`` of one array."""
    def with_mean(s):
        total = F.aggregate(s["v"], F.lit(0.0), lambda acc, x: acc + deviation(x - s["m"]))
        return finish(total, F.size(s["v"]), s["m"])

    return _let(values, lambda v: _let(
        F.struct(v.alias("v"), array_mean(v).alias("m")), with_mean))


def coefficient_of_variation(values: Column) -> Column:
    """Sample deviation over mean; 1 when undefined, 0 when constant."""
    return F.coalesce(_moments(
        values, lambda d: d * d,
        lambda total, n, mean: F.when((n >= 2) & (mean != 0), F.try_divide(
            F.sqrt(F.try_divide(total, n - 1)), mean))), F.lit(1.0))


def jitter(values: Column) -> Column:
    """Mean absolute deviation over mean; 1 when undefined."""
    return F.coalesce(_moments(
        values, F.abs, lambda total, n, mean: F.when(
            (n >= 2) & (mean != 0), F.try_divide(total, n * mean))), F.lit(1.0))


_PERIODICITY = T.StructType([
    T.StructField("dominant_freq", T.DoubleType()),
    T.StructField("periodicity_score", T.DoubleType()),
    T.StructField("dominant_period", T.DoubleType()),
    T.StructField("fft_power", T.DoubleType()),
])


@F.pandas_udf(_PERIODICITY)
def _periodicity(gaps: pd.Series, rate: pd.Series) -> pd.DataFrame:
    # Series of equal length share one transform call. Power shares are compared at nine
    # decimals, so bins that tie up to rounding noise resolve to the lowest one.
    out = np.zeros((len(gaps), 4))
    by_length: dict[int, list[int]] = {}
    kept: list[np.ndarray | None] = []
    for row, values in enumerate(gaps):
        arr = np.asarray(values if values is not None else [], dtype=float)
        arr = arr[arr > 0] if arr.size >= 4 else arr[:0]
        kept.append(arr)
        if arr.size >= 4:
            by_length.setdefault(arr.size, []).append(row)
    for n, rows in by_length.items():
        power = np.abs(np.fft.fft(np.stack([kept[r] for r in rows]), axis=1)[:, : n // 2]) ** 2
        total = power.sum(axis=1)
        best = np.round(power / total[:, None], 9)[:, 1:].argmax(axis=1) + 1
        chosen = power[np.arange(len(rows)), best]
        freq = best * rate.to_numpy(dtype=float)[rows] / n
        out[rows, 0] = freq
        out[rows, 1] = chosen / total
        out[rows, 2] = np.divide(1.0, freq, out=np.zeros_like(freq), where=freq > 0)
        out[rows, 3] = chosen
    return pd.DataFrame(out, columns=["dominant_freq", "periodicity_score",
                                      "dominant_period", "fft_power"])


def fft_periodicity(gaps: Column, sample_rate: Column | None = None) -> Column:
    """Spectrum summary of positive gaps (at least four), series of at most 128 points."""
    rate = sample_rate if sample_rate is not None else F.lit(1.0)
    return _periodicity(gaps, rate.cast("double"))


def with_beacon_features(flows: DataFrame,
                         min_observations: int = S.BEACON_MIN_OBSERVATIONS) -> DataFrame:
    """Per-flow timing bundle; too few observations give the neutral values."""
    n = F.coalesce(F.size("timestamps"), F.lit(0))
    enough = n >= min_observations
    rate = F.col("packet_count") / F.greatest(F.col("duration_seconds"), F.lit(1.0))
    staged = flows.withColumn(
        "_gaps", F.when(enough, inter_arrival_times(F.col("timestamps"))))
    scored = staged.withColumn("_fft", fft_periodicity(F.col("_gaps"), rate))
    cv = coefficient_of_variation(F.col("_gaps"))
    return scored.withColumns({
        "inter_arrival_cv": F.when(enough, cv).otherwise(1.0),
        "periodicity_score": F.when(enough, F.col("_fft.periodicity_score")).otherwise(0.0),
        "dominant_period": F.when(enough, F.col("_fft.dominant_period")).otherwise(0.0),
        "jitter": F.when(enough, jitter(F.col("_gaps"))).otherwise(1.0),
        "destination_rarity": F.lit(0.5),
        "timing_consistency": F.when(enough, 1.0 - F.least(cv, F.lit(1.0))).otherwise(0.0),
        "observation_count": n,
        "is_sufficient_observations": enough,
    }).drop("_gaps", "_fft")


def destination_rarity(flows: DataFrame) -> DataFrame:
    """Inverse frequency of each destination, one row per destination."""
    return flows.groupBy("dst_ip").agg(F.count(F.lit(1)).alias("flows")) \
                .withColumn("rarity", 1.0 / F.col("flows"))


def packet_size_sequence(sizes: Column, n: int = 20) -> Column:
    """First ``n`` sizes as doubles, padded with zeros."""
    head = F.coalesce(F.slice(sizes, 1, n), F.array()).cast("array<double>")
    return F.slice(F.concat(head, F.array_repeat(F.lit(0.0), n)), 1, n)


def size_sequence_stats(sizes: Column) -> Column:
    """Struct of mean, median, population deviation, min and max; zeros when empty."""
    values = F.array_sort(F.coalesce(sizes, F.array()).cast("array<double>"))

    def stats(v):
        n = F.size(v)
        low, high = F.get(v, F.floor((n - 1) / 2).cast("int")), F.get(v, F.floor(n / 2).cast("int"))
        spread = _moments(v, lambda d: d * d, lambda total, k, _: F.sqrt(F.try_divide(total, k)))
        named = {"mean_size": array_mean(v), "median_size": (low + high) / 2,
                 "std_size": spread, "min_size": F.array_min(v), "max_size": F.array_max(v)}
        return F.struct(*[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in named.items()])

    return _let(values, stats)
