"""TLS fingerprints from ClientHello metadata columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from .timing import packet_size_sequence

__all__ = ["ja3_metadata_hash", "ja4_metadata_hash", "ja3_standard", "ja3_counts",
           "with_tls_features"]


def _sorted_or_blank(values: Column) -> Column:
    """Sorted list joined with ':', a blank when there is nothing to list."""
    joined = F.array_join(F.array_sort(values.cast("array<string>")), ":")
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, joined).otherwise(" ")


def _text_or_blank(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(" ")


def ja3_metadata_hash(version: Column, ciphers: Column, extensions: Column,
                      curves: Column, point_formats: Column) -> Column:
    return F.md5(F.concat_ws(":", _text_or_blank(version), *[
        _sorted_or_blank(c) for c in (ciphers, extensions, curves, point_formats)]))


def ja4_metadata_hash(ja3: Column, hostname: Column, extensions: Column,
                      rtt: Column | None = None) -> Column:
    rtt_text = F.lit("0.000") if rtt is None else \
        F.format_string("%.3f", F.coalesce(rtt, F.lit(0.0)))
    return F.sha2(F.concat_ws(":", ja3, _text_or_blank(hostname),
                              _sorted_or_blank(extensions), rtt_text), 256)


def _without_grease(codes: Column) -> Column:
    return F.filter(F.coalesce(codes, F.array().cast("array<int>")),
                    lambda x: ~x.isin(*S.GREASE))


def ja3_standard(version: Column, ciphers: Column, extensions: Column,
                 curves: Column, point_formats: Column) -> Column:
    """Order-keeping JA3 over numeric code points, GREASE values left out."""
    parts = [F.array_join(_without_grease(c).cast("array<string>"), "-")
             for c in (ciphers, extensions, curves)]
    formats = F.array_join(F.coalesce(point_formats, F.array()).cast("array<string>"), "-")
    return F.md5(F.concat_ws(",", version.cast("string"), *parts, formats))


def ja3_counts(ciphers: Column, extensions: Column, curves: Column,
               point_formats: Column) -> Column:
    return F.struct(F.size(_without_grease(ciphers)).alias("ciphers_count"),
                    F.size(_without_grease(extensions)).alias("extensions_count"),
                    F.size(_without_grease(curves)).alias("curves_count"),
                    F.size(F.coalesce(point_formats, F.array())).alias("point_formats_count"))


def with_tls_features(flows: DataFrame) -> DataFrame:
    """Hashes, list counts, padded sizes and host prefix of ClientHello columns."""
    lists = ("ciphers", "extensions", "curves", "point_formats")
    version = F.coalesce(F.col("tls_version"), F.lit("TLS 1.2"))
    hashed = flows.withColumn("ja3_hash", ja3_metadata_hash(version, *[F.col(c) for c in lists]))
    return hashed.withColumns({
        "ja4_hash": ja4_metadata_hash(F.col("ja3_hash"), F.col("hostname"), F.col("extensions")),
        "packet_size_sequence": packet_size_sequence(F.col("packet_sizes")),
        **{f"{c}_count": F.coalesce(F.size(c), F.lit(0)) for c in lists},
        "hostname_prefix": F.substring(F.coalesce(F.col("hostname"), F.lit("")), 1, 32),
    })
