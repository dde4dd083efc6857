"""Labelled name and fingerprint lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FINGERPRINT = """ja3 string, ja3s string, host string, ciphers array<string>,
    family string, label string"""


def read_name_list(spark: SparkSession, path: str, label: int, family: str | None = None) -> DataFrame:
    """One name per line, lower case, blanks left out."""
    name = F.lower(F.trim(F.col("value")))
    return spark.read.text(path).where(name != "").select(
        name.alias("domain"), F.lit(label).alias("label"), F.lit(family).cast("string").alias("family"))


def read_name_csv(spark: SparkSession, path: str) -> DataFrame:
    """Generated-name corpus with ``domain, class, subclass, host`` columns."""
    rows = spark.read.option("header", True).schema(
        "domain string, class string, subclass string, host string").csv(path)
    return rows.select(
        F.lower(F.trim("domain")).alias("domain"),
        F.when(F.lower("class") == "dga", 1).otherwise(0).alias("label"),
        F.col("subclass").alias("family")).where(F.coalesce("domain", F.lit("")) != "")


def merge_corpus(parts: Sequence[DataFrame], first_label_only: bool = True) -> DataFrame:
    """Union of lists with each name once; on a clash the earlier list wins."""
    out = None
    for rank, part in enumerate(parts):
        name = F.substring_index("domain", ".", 1) if first_label_only else F.col("domain")
        rows = part.select(F.lower(F.trim(name)).alias("domain"), "label", "family",
                           F.lit(rank).alias("_rank"))
        out = rows if out is None else out.unionByName(rows)
    best = F.min(F.struct("_rank", "label", "family")).alias("_best")
    return out.where(F.coalesce("domain", F.lit("")) != "").groupBy("domain").agg(best) \
              .select("domain", "_best.label", "_best.family")


def corpus_counts(corpus: DataFrame) -> DataFrame:
    """Names per label and family."""
    return corpus.groupBy("label", "family").agg(F.count(F.lit(1)).alias("names"))


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """JA3 list: one row per sample, ``label`` and ``family`` as given."""
    return spark.read.schema(_FINGERPRINT).option("multiLine", True).json(path) \
                .where(F.coalesce("ja3", F.lit("")) != "")
