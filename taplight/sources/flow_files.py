"""Flow records from JSON and tables, and their repair rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas, settings as S
from ..functions import flow_duration, flow_key

_RAW = T.MapType(T.StringType(), T.StringType())
_RECORD = T.StructType([
    *[f for f in schemas.FLOWS.fields if f.name not in ("flags", "raw_features")],
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("flags", T.StringType()),
    T.StructField("raw_features", _RAW),
])
_FILE = T.StructType([
    *_RECORD.fields,
    T.StructField("flows", T.ArrayType(_RECORD)),
    T.StructField("records", T.ArrayType(_RECORD)),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_flow_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Flow rows of JSON files: a list, one record, or a ``flows`` / ``records`` wrapper.

    Files that do not parse add nothing. ``multi_line=False`` reads one record per line,
    which splits large files over tasks.
    """
    rows = spark.read.schema(_FILE).option("multiLine", multi_line) \
                .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    single = F.array(F.struct(*[F.col(f.name) for f in _RECORD.fields]))
    records = rows.where(F.col("_corrupt_record").isNull()).select(
        F.inline(F.coalesce("flows", "records", single)))
    raw = F.coalesce("raw_features", F.create_map().cast(_RAW))
    numbers = F.map_filter(F.transform_values(raw, lambda k, v: v.try_cast("double")),
                           lambda k, v: v.isNotNull())
    listed = F.from_json("flags", "array<string>")
    flags = F.when(F.col("flags").startswith("["), listed) \
             .when(F.col("flags").isNull(), F.array().cast("array<string>")) \
             .otherwise(F.array("flags"))
    return records.withColumns({
        "dga_family": F.try_element_at(raw, F.lit("dga_family")),
        "raw_features": numbers, "flags": flags})


def read_flow_table(spark: SparkSession, path: str) -> DataFrame:
    """Flow rows that are tabular already."""
    return spark.read.parquet(path)


def normalize_flows(records: DataFrame, now: float = 0.0) -> DataFrame:
    """Defaults, consistent start and end, packet series and port list for each record."""
    count = F.coalesce(F.col("packet_count"), F.lit(0)).cast("bigint")
    nbytes = F.coalesce(F.col("bytes_transferred"), F.lit(0)).cast("bigint")
    named = records.withColumns({
        "src_ip": F.coalesce("src_ip", F.lit("0.0.0.0")),
        "dst_ip": F.coalesce("dst_ip", F.lit("0.0.0.0")),
        "protocol": F.lower(F.coalesce("protocol", F.lit("tcp"))),
        "packet_count": count, "bytes_transferred": nbytes,
        "_dur": F.coalesce("duration_seconds", F.lit(0.0)),
        "_given": F.coalesce("timestamps", F.array().cast("array<double>")),
        "_start": F.coalesce("start_time", *(["timestamp"] if "timestamp" in records.columns
                                             else []), F.lit(float(now))),
    })
    has_series = F.size("_given") > 0
    low, high = F.array_min("_given"), F.array_max("_given")
    start = F.when(has_series, low).otherwise(F.col("_start"))
    shown = F.least("packet_count", F.lit(S.SERIES_SERIALISED)).cast("int")
    stretched = (F.col("_dur") > 0) & (F.col("packet_count") > 1)
    step = F.when(stretched, F.try_divide("_dur", F.col("packet_count") - 1)).otherwise(0.0)
    steps = F.sequence(F.lit(0), F.greatest(shown - 1, F.lit(0)))
    made = F.transform(steps, lambda i: F.col("_start") + i * F.col("_step"))
    no_packets = F.array().cast("array<double>")
    span = F.when(F.size("_given") > 1, high - low).otherwise(0.0)
    end = F.when(has_series, F.when((F.col("_dur") > span) | (F.size("_given") == 1),
                                    low + F.col("_dur")).otherwise(high)) \
           .when((F.col("packet_count") > 0) & (F.col("_dur") > 0), F.col("_start") + F.col("_dur")) \
           .otherwise(F.coalesce("end_time", F.col("_start") + F.col("_dur")))
    sizes = F.coalesce("packet_sizes", F.array().cast("array<bigint>"))
    average = F.floor(F.col("bytes_transferred") / F.greatest("packet_count", F.lit(1)))
    own_port = F.when(F.col("dst_port").isNotNull(), F.array("dst_port")) \
                .otherwise(F.array().cast("array<int>"))
    repaired = named.withColumn("_step", step).withColumns({
        "flow_id": F.coalesce(F.nullif("flow_id", F.lit("")), flow_key(
            F.col("protocol"), F.col("src_ip"), F.col("src_port"), F.col("dst_ip"),
            F.col("dst_port"))),
        "end_time": end, "start_time": start,
        "timestamps": F.when(has_series, F.col("_given"))
                       .when(F.col("packet_count") > 0, made).otherwise(no_packets),
        "packet_sizes": F.when(F.size(sizes) > 0, F.slice(sizes, 1, S.SERIES_SERIALISED))
                         .when(F.col("packet_count") > 0, F.array_repeat(average, shown))
                         .otherwise(F.array().cast("array<bigint>")),
        "dst_ports": F.array_union(F.slice(F.coalesce("dst_ports", F.array().cast("array<int>")),
                                           1, S.SCAN_FLOW_CAP), own_port),
    })
    return repaired.withColumn("duration_seconds", flow_duration(
        F.col("packet_count"), F.col("start_time"), F.col("end_time"))) \
        .drop("_dur", "_given", "_start", "_step")


# Dashboard field names and the defaults of absent ones.
_ALIASES = {
    "src_ip": ("source_ip", None), "dst_ip": ("destination_ip", None),
    "src_port": ("source_port", None), "dst_port": ("destination_port", None),
    "protocol": (None, "tcp"), "packet_count": (None, 10),
    "bytes_transferred": (None, 1000), "duration_seconds": (None, 1.0),
}


def alias_fields(records: DataFrame) -> DataFrame:
    """Dashboard-style names mapped to flow names, with their defaults."""
    have = set(records.columns)
    out: dict[str, Column] = {}
    for name, (alias, default) in _ALIASES.items():
        options = [F.col(c) for c in (name, alias) if c and c in have]
        if default is not None:
            options.append(F.lit(default))
        if options:
            out[name] = F.coalesce(*options)
    return records.withColumns(out).drop(*[a for a, _ in _ALIASES.values() if a])
