"""The queries of this subpackage, opN_<name> and pipeline, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, html, licenses, lines, minhash, mixing, quality, sharding, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """The vocabulary file's path and the pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op2_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(_table(spark, sf_dir, "pages"))


def op3_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents")).drop("line_coverage", "ngram_coverage")


def op4_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), *vocabulary(), with_ids=False).drop("ids")


def op6_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumnsRenamed({"__n_lines": "n_lines", "__n_dropped": "n_dropped"})


def op8_setsketch_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    weights = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, weights).withColumn("n_offending", F.size("offending")).drop("offending")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_consistent_parsing": op1_consistent_parsing,
    "op2_text_density": op2_text_density,
    "op3_repetition_quality": op3_repetition_quality,
    "op4_stratified_shards": op4_stratified_shards,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_license_sentences": op6_license_sentences,
    "op7_fuzzy_lines": op7_fuzzy_lines,
    "op8_setsketch_duplicates": op8_setsketch_duplicates,
    "op9_entropy_mix": op9_entropy_mix,
    "op10_noisy_or_toxicity": op10_noisy_or_toxicity,
}
ORACLES: dict[str, str] = {"op3_repetition_quality": quality.oracle(), "op4_stratified_shards": sharding.oracle(), "op6_license_sentences": licenses.oracle()}
