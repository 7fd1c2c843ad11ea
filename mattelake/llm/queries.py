"""The registered queries of the subpackage, and SQL where DuckDB can compute the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mattelake.llm import byte_cnn, embedding_dedup, gray_simhash, hilbert_pack, langid, line_dedup, media, mixing, pii, toxicity
from mattelake.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_pack.pack(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_pii": op3_pii,
    "op4_webp_media": op4_webp_media,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_hilbert_packing": op7_hilbert_packing,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {"op1_line_dedup": line_dedup.ORACLE, "op5_embedding_near_dedup": embedding_dedup.ORACLE}
