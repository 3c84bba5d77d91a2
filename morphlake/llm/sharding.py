"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get numbers 0 .. n-1 by (id, CRC-32, size): a range exchange of those light columns, a sort in each part, and the
parts' row counts added up (one number for each part, by running sums). A keyed Feistel network over the least even number of
bits that holds n permutes the numbers; values of n and above are walked on until they fall below n. The permuted number
p gives shard p % shards and slot p // shards: reproducible from (seed, n) alone, computable for any row without a sort of
the shuffled data, counts of shards at most one apart, slots without gaps. Law: `rows`.

Equal texts are no groups under this law: each row has a place of its own, which depends on its number alone. Null texts
count as empty, long ones are only measured. Other columns, whatever their names, are not read. Null ids come first; repeated rows are numbered each on its own (equal rows are
interchangeable). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix

ROUNDS = 6


def feistel(x: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The permutation of 0 .. n-1 (or its inverse) at x, by cycle walking in the next even power of two."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (1 << 64) - 1))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & mask)
        return (left << half) | right

    out = once(x.astype(np.uint64))
    while len(walk := np.flatnonzero(out >= n)):
        out[walk] = once(out[walk])
    return out.astype(np.int64)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df (light columns) with `row`: 0 .. n-1 by order, and `total`."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    kept = materialize(sorted_.withColumn("part", F.shiftrightunsigned("at", 33)).withColumn("at", F.expr("at & 8589934591L")), "rows")
    # one row for each part of the exchange, so bounded by the number of partitions: running sums in one task
    parts = kept.groupBy("part").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lower = parts.select("part", (upto - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return kept.join(F.broadcast(lower), "part").withColumn("row", F.col("base") + F.col("at")).drop("part", "at", "base")


def shard(docs: DataFrame, shards: int = 40, seed: int = 20240917, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    kind = light.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p = feistel(b.column("row").to_numpy(), b.column("total")[0].as_py(), seed)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("size"), b.column("text_crc32"), pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], names=["id", "size", "text_crc32", "shard", "slot"])

    out = numbered(light, ["id", "text_crc32", "size"]).mapInArrow(run, f"id {kind}, size long, text_crc32 long, shard int, slot long")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
