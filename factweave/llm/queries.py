"""The registered queries of this subpackage: thin bindings of its operators to the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fuzzy_lines, hyperminhash, license_scan, mixing, multi_index, nce_lm, resampling, sentence_spans, spaced_seeds, suffix_dedup


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir))


def op2_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(_documents(spark, sf_dir))


def op3_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_spans.remove_repeated_spans(_documents(spark, sf_dir))
    return found.select("doc_id", "n_sentences", "n_removed", "n_removed_bytes", F.sha2("kept", 256).alias("kept_sha256"))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0")
    return resampling.resample(_documents(spark, sf_dir), good)


def op6_nce_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nce_lm.score(_documents(spark, sf_dir))


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_notices(_documents(spark, sf_dir))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fuzzy_lines.dedup_lines(_documents(spark, sf_dir))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_array": suffix_dedup.ORACLE_SQL.format(documents="documents"),
        "op2_hyperminhash": hyperminhash.ORACLE_SQL.format(documents="documents"),
        "op3_entropy_mixing": mixing.ORACLE_SQL.format(documents="documents"),
        "op7_multi_index": multi_index.ORACLE_SQL.format(embeddings="embeddings"),
        "op10_spaced_seeds": spaced_seeds.ORACLE_SQL.format(documents="documents", benchmark="benchmark"),
    }
