"""Row layouts shared by the readers and the operators."""

from __future__ import annotations

from pyspark.sql import types as T

EVIDENCE = T.StructType([
    T.StructField("feature_name", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("contribution", T.DoubleType()),
    T.StructField("description", T.StringType()),
])

PACKETS = T.StructType([
    T.StructField("packet_id", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("flags", T.StringType()),
    T.StructField("packet_size", T.IntegerType()),
    T.StructField("ja3", T.StringType()),
    T.StructField("dns_query", T.StringType()),
    T.StructField("dns_qtype", T.IntegerType()),
    T.StructField("tls_counts", T.ArrayType(T.IntegerType())),
])

FLOWS = T.StructType([
    T.StructField("flow_id", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("packet_count", T.LongType()),
    T.StructField("bytes_transferred", T.LongType()),
    T.StructField("start_time", T.DoubleType()),
    T.StructField("end_time", T.DoubleType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("timestamps", T.ArrayType(T.DoubleType())),
    T.StructField("packet_sizes", T.ArrayType(T.LongType())),
    T.StructField("dst_ports", T.ArrayType(T.IntegerType())),
    T.StructField("flags", T.ArrayType(T.StringType())),
    T.StructField("ja3", T.StringType()),
    T.StructField("dns_query", T.StringType()),
    T.StructField("dns_qtype", T.IntegerType()),
    T.StructField("raw_features", T.MapType(T.StringType(), T.DoubleType())),
])

ALERTS = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("flow_id", T.StringType()),
    T.StructField("threat_class", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("source_port", T.IntegerType()),
    T.StructField("destination_ip", T.StringType()),
    T.StructField("destination_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("bytes_transferred", T.LongType()),
    T.StructField("packet_count", T.LongType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("evidence", T.ArrayType(EVIDENCE)),
    T.StructField("model_version", T.StringType()),
    T.StructField("raw_features", T.MapType(T.StringType(), T.DoubleType())),
])
