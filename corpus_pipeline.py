"""The corpus pipeline: documents to packed training sequences, in five stages.

1. language: documents that no language fits (null texts, texts without a letter) go.
2. near_dedup: of each group of near-duplicates (Jaccard similarity of word shingles from 0.8) the document with the smallest id stays.
3. repeats: bytes covered by 200-byte strings that also start elsewhere are cut out of the texts; documents stay.
4. secrets: found secrets are masked; documents stay.
5. packing: documents as pieces of at most 4096 tokens in as few sequences as found.

Every stage takes (spark, docs, sf_dir) and gives the columns of its input (n_chars follows the text), the last one the
pieces. Null and repeated ids, null texts and empty tables have the results that the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.llm import lang_id, minhash, packing, secret_scan, suffix_dedup
from morphlake.llm.common import materialize
from morphlake.llm.queries import table, tokenizer_path

ORACLE_SQL = None  # its stages are not expressible in SQL; tests/llm compares it with a brute-force version


def _sized(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, percent=80, bands=38)  # 38 bands of 6 miss a pair at 0.8 with probability 1e-5


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(suffix_dedup.strip(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("repeats", repeats), ("secrets", secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else materialize(docs, name), sf_dir)
    return docs
