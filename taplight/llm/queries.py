"""Queries of this subpackage over the provided tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, language, lexical, near_text, pieces, pii, secret_scan, sharding, spelling, sql, url_lists, vector_links, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_hyperplane_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.vector_components(_table(spark, sf_dir, "embeddings"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trips(_table(spark, sf_dir, "documents"), public_tokenizers.path(
        "byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("doc_key")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(_table(spark, sf_dir, "documents"))


def op2_compression_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(_table(spark, sf_dir, "documents"))


def op9_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_and_read(_table(spark, sf_dir, "documents"), limit=1 << 20)


def op7_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_lists.filter_captures(url_lists.page_captures(pages), url_lists.derived_entries(pages))


def op10_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages"))


def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_secret_scan,
        op2_compression_language_id,
        op3_bootstrapped_pii,
        op4_prefix_decontamination,
        op5_hyperplane_near_dedup,
        op6_minhash_near_dedup,
        op7_temporal_url_filter,
        op8_byte_bpe,
        op9_extendible_sharding,
        op10_warc_capture_index,
        op11_sentence_pieces,
        op12_ranked_search,
        op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": sql.SECRETS,
        "op4_prefix_decontamination": sql.DECONTAMINATION,
        "op5_hyperplane_near_dedup": sql.NEAR_VECTORS,
        "op6_minhash_near_dedup": sql.NEAR_TEXT,
        "op7_temporal_url_filter": sql.URL_FILTER,
        "op9_extendible_sharding": sql.SHARDING,
        "op10_warc_capture_index": sql.WARC,
        "op12_ranked_search": sql.RANKED_SEARCH,
        "op13_spelling_variants": sql.SPELLING,
    }
