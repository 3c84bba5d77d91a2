"""Shared parts of the training-data operators: shared tables, batch word hashing, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.sources.store import written

# ---------------------------------------------------------------- shared tables


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    return written(df, name)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# ---------------------------------------------------------------- memory of Python workers


def give_back() -> None:
    """Free memory that the allocators keep goes back to the system (where the C library can do that)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow: a worker that waits for its next task keeps no free memory of the last one.

    Spark takes turns among the workers of an executor, so all of them would hold what the largest task took.
    """

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return held


def pieces(b: pa.RecordBatch, text: int | str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most limit bytes of text, one row at least: what is made of texts stays small."""
    _, offsets = text_bytes(b.column(text))
    for i, j in chunks(offsets, limit):
        yield b.slice(i, j - i)


# ---------------------------------------------------------------- words in Arrow batches

_SPACE = np.zeros(256, np.bool_)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_P = np.uint64(0x9E3779B97F4A7C55)  # odd, so that it has an inverse modulo 2**64
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
CHUNK_BYTES = 1 << 18  # text handled at once: its arrays take some 25 times as much


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least; only those of usual chunks are kept."""
    if n > 4 * CHUNK_BYTES:
        return _powers(_P, n), _powers(_PINV, n)
    if not _POW:
        _POW[:] = [_powers(_P, 4 * CHUNK_BYTES), _powers(_PINV, 4 * CHUNK_BYTES)]
    return _POW[0], _POW[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary Arrow column and where each row starts in them; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(at):
        return raw[:0], np.zeros(1, np.int64)
    at = at.astype(np.int64)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most limit bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_parts(raw: np.ndarray, first: int, end: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """A long row's bytes in parts of about `limit` that end at white space (or at the row's end)."""
    while first < end:
        at = first + limit
        while at < end:
            space = np.flatnonzero(_SPACE[raw[at : min(end, at + limit)]])
            if len(space):
                at += int(space[0])
                break
            at += limit
        yield first, min(at, end)
        first = at


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of some rows: first and end bytes, a 64-bit hash each, and where rows start."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool):
        self.raw = _LOWER[raw] if lower else raw
        n = len(raw)
        word = ~_SPACE[raw]
        cut = np.zeros(n + 1, np.bool_)
        cut[offsets] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | cut[1:n]
        last = word.copy()
        last[:-1] &= ~word[1:] | cut[1:n]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.start, offsets)
        p, pinv = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
        size = (self.end - self.start).astype(np.uint64)
        self.hash = mix((sums[self.end] - sums[self.start]) * pinv[self.start] + size * np.uint64(0xD1342543DE82EF95))


def words_of(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> Iterator[tuple[int, Words]]:
    """Words of all rows, some rows at a time: (number of the first row, Words)."""
    for i, j in chunks(offsets):
        yield i, Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)


SHINGLE = 5


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its five-word shingles, A-Z lowered; fewer words make one shingle."""
    c = [np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
    for _, w in words_of(raw, offsets, True):
        h, total = w.hash, len(w.hash)
        if total >= SHINGLE:
            grams = np.zeros(total - SHINGLE + 1, np.uint64)
            for k in range(SHINGLE):
                grams += h[k : total - SHINGLE + 1 + k] * c[k]
            grams = mix(grams)
        for i in range(len(w.row) - 1):
            a, b = int(w.row[i]), int(w.row[i + 1])
            if b - a >= SHINGLE:
                yield np.unique(grams[a : b - SHINGLE + 1])
            elif b > a:
                acc = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for k in range(a, b):
                        acc = acc * c[0] + h[k] * c[1]
                yield mix(np.array([acc], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): for each id in edges the smallest id reachable; alternating large and small stars.

    Every round is two aggregations with map-side combining and two equi-joins; AQE splits hub keys. The rounds are
    logarithmic in practice (a star takes two). Ids without an edge are absent.
    """
    e = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s")).select("s.u", "s.v").where("u != v").distinct()
        e = materialize(small, "edges")
        now = tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum("v")).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
