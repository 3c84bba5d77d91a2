"""The queries of the training-data operators: opN_<name> over whole tables, with production parameters."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracles import MINHASH_SQL, VECTOR_SQL, WARC_SQL


def _operator(name: str):
    """An operator's module, loaded when its query runs: what it imports is only needed then."""
    return importlib.import_module(f"{__package__}.{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _operator("warc").round_trip(table(spark, sf_dir, "pages"))


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file of this name lies; nothing of it is kept in the repository."""
    return importlib.import_module("public_tokenizers").path(name)


def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _operator("rp_forest").near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _operator("quality").judge(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _operator("sharding").shard(table(spark, sf_dir, "documents"))


def op5_deep_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _operator("suffix_dedup").digest(table(spark, sf_dir, "documents"))


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _operator("piece_bpe").digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _operator("minhash").near_duplicates(table(spark, sf_dir, "documents"))


def op8_bitmask_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _operator("lang_id").identify(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _operator("secret_scan").digest(table(spark, sf_dir, "documents"))


def op10_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _operator("packing").pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_rp_forest": VECTOR_SQL, "op2_adaptive_quality": _operator("quality").oracle_sql(), "op3_warc_dictionary": WARC_SQL, "op7_superminhash": MINHASH_SQL}
