"""MinHash near-dedup by SuperMinHash: signatures, banding, verification on full sets, connected components.

A document's set is its distinct five-word shingles (A-Z lowered; fewer words make one shingle). SuperMinHash gives each
element one correlated permutation of the signature's places: at level j it offers j + a fraction to the place that its
permutation names, so every place's minimum comes from few levels and the levels stop once all places hold less than the
next level. Signatures are cut into bands; documents that share a band are candidates, and every link is confirmed on the
full sets (100 * intersection >= 85 * union by default).

Scale: rows with equal sets are folded into their smallest id before banding, so a group of exact copies costs one row.
A bucket never lists its pairs: its members first meet one pivot (the member that shares the most buckets), and a bucket
that this makes one component is done. In the others, dealt to pairs of blocks of `block` members, the members outside
the largest component meet those of other components inside the task; signatures drop hopeless pairs, each pair is tried
in its first common bucket only, and a task gives no more links than a forest. Texts move once by id in either step.

Misses: with `bands` of `rows` a pair at similarity 0.85 escapes all bands with probability (1 - 0.85**rows)**bands,
1e-5 at the default 27 x 6.

Null and empty texts and texts without a word have an empty set and link with nothing. Null ids are kept, unlinked.
Repeated rows with one id count as one document (their sets joined as equal or separate texts of that id); an empty table
gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, free_name, frugal, materialize, mix, shingle_sets, text_bytes

BANDS, ROWS = 27, 6
BLOCK = 2048
PERCENT = 85
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_FRAC = np.uint64((1 << 40) - 1)


def superminhash(elements: np.ndarray, m: int) -> np.ndarray:
    """The m places of the SuperMinHash signature of distinct 64-bit elements, as level * 2**40 + fraction."""
    n = len(elements)
    sig = np.full(m, np.iinfo(np.int64).max, np.int64)
    if not n:
        return sig
    place = None
    rows = None
    for level in range(m):
        r = mix(elements + np.uint64(int(_GOLD) * (level + 1) & (1 << 64) - 1))
        k = level + ((r >> np.uint64(40)) % np.uint64(m - level)).astype(np.int64)
        value = (r & _FRAC).astype(np.int64) + (level << 40)
        if level == 0:
            first = at = k
        else:
            if place is None:  # the permutations are only written out where a second level is needed
                rows = np.arange(n)
                place = np.tile(np.arange(m, dtype=np.int16), (n, 1))
                place[rows, first] = 0
                place[rows, 0] = first
            at = place[rows, k].copy()
            place[rows, k] = place[rows, level]
            place[rows, level] = at
        np.minimum.at(sig, at, value)
        if sig.max() < (level + 1) << 40:  # no later level can go below any place
            break
    return sig


def signature_batches(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(id, n_shingles, set digest, band keys, one byte of each place) for the (id, text) rows."""
    m = bands * rows
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    for b in batches:
        raw, offsets = text_bytes(b.column(1))
        sizes, digests, keys, small = [], [], [], []
        for s in shingle_sets(raw, offsets):
            sizes.append(len(s))
            if not len(s):
                digests.append(None)
                keys.append(None)
                small.append(None)
                continue
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            sig = superminhash(s, m).astype(np.uint64)
            acc = salt.copy()
            for c in sig.reshape(bands, rows).T:
                acc = mix(acc ^ c) + _GOLD
            keys.append(acc.view(np.int64))
            small.append(mix(sig).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(small, pa.binary())], names=["id", "n_shingles", "digest", "bands", "places"])


def _likely(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x = np.frombuffer(b"".join(b.column("pa").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            y = np.frombuffer(b"".join(b.column("pb").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            b = b.filter(pa.array((x == y).mean(axis=1) >= least))
        yield b.select(["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets: list[list[np.ndarray]] = []
        for name in ("ta", "tb"):
            # a text that stands in many rows of the batch is only cut once
            column = b.column(name).dictionary_encode() if b.num_rows else None
            if column is None:
                continue
            raw, offsets = text_bytes(column.dictionary)
            distinct = list(shingle_sets(raw, offsets))
            sets.append([distinct[i] for i in column.indices.to_pylist()])
        keep = []
        for x, y in zip(*sets, strict=True) if sets else ():
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _confirm(pairs: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, places: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; signatures drop hopeless ones first."""
    p = percent / 100
    least = p - 5 * (p * (1 - p) / places) ** 0.5
    kind = pairs.schema["a"].dataType.simpleString()
    side = reps.select("id", "places")
    likely = (
        pairs.join(side.withColumnsRenamed({"id": "a", "places": "pa"}), "a").join(side.withColumnsRenamed({"id": "b", "places": "pb"}), "b")
        .select("a", "b", "pa", "pb").mapInArrow(frugal(lambda it: _likely(it, least)), f"a {kind}, b {kind}")
    )
    likely = materialize(likely, "likely")
    a = texts.withColumnsRenamed({"id": "a", "text": "ta"})
    b = texts.withColumnsRenamed({"id": "b", "text": "tb"})
    return likely.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(frugal(lambda it: _verified(it, percent)), f"a {kind}, b {kind}")


def _bucket_rows(batches: Iterator[pa.RecordBatch], percent: int, least: float) -> Iterator[pa.RecordBatch]:
    """Links that unite components in each run of equal (key, p, q): a forest of them, confirmed on full sets."""
    kind, now, rows, out = None, None, [], ([], [])
    names = ("key", "p", "q", "side", "band", "id", "comp", "n_shingles", "places", "bands", "text")
    for b in batches:
        kind = b.column("id").type
        for row in zip(*(b.column(c).to_pylist() for c in names), strict=True):
            if row[:3] != now:
                _settle(rows, percent, least, out)
                now, rows = row[:3], []
            rows.append(row)
    _settle(rows, percent, least, out)
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], kind)], names=["a", "b"])


def _settle(rows: list[tuple], percent: int, least: float, out: tuple[list, list]) -> None:
    if len(rows) < 2:
        return
    across = rows[0][1] != rows[0][2]
    side = np.array([r[3] for r in rows])
    size = np.array([r[7] for r in rows])
    places = np.frombuffer(b"".join(r[8] for r in rows), np.uint8).reshape(len(rows), -1)
    bands = np.array([r[9] for r in rows], np.int64)
    number = {c: i for i, c in enumerate(dict.fromkeys(r[6] for r in rows))}
    comp = np.array([number[r[6]] for r in rows])
    sets: dict[int, np.ndarray] = {}

    def set_of(i: int) -> np.ndarray:
        if i not in sets:
            raw = np.frombuffer((rows[i][10] or "").encode("utf-8", "replace"), np.uint8)
            sets[i] = next(shingle_sets(raw, np.array([0, len(raw)])))
        return sets[i]

    # rows outside the largest component meet all rows of other components, one row at a time
    largest = np.bincount(comp).argmax()
    first = comp != largest
    for i in np.flatnonzero(first).tolist():
        others = (comp != comp[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        others &= ~first | (np.arange(len(rows)) > i)
        if across:
            others &= side != side[i]
        at = np.flatnonzero(others)
        if not len(at):
            continue
        alike = (places[at] == places[i]).mean(axis=1)
        # each pair is looked at in its first common band only
        fit = (alike >= least) & ((bands[at] == bands[i]).argmax(axis=1) == rows[i][4])
        for j in at[fit][np.argsort(-alike[fit], kind="stable")].tolist():
            if comp[i] == comp[j]:
                continue
            x, y = set_of(i), set_of(j)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                comp[comp == comp[j]] = comp[i]
                out[0].append(rows[i][5])
                out[1].append(rows[j][5])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, kept): groups of documents linked by Jaccard similarity >= percent / 100."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = materialize(texts.mapInArrow(frugal(lambda it: signature_batches(it, bands, rows)), f"id {kind}, n_shingles long, digest binary, bands array<long>, places binary"), "signed")
    named = signed.where("digest is not null and id is not null")
    # copies: rows of one set hang on its smallest id
    folded = named.groupBy("digest").agg(F.min("id").alias("rep"))
    copies = materialize(named.select("id", "digest").join(folded, "digest").where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b")), "copies")
    reps = materialize(named.join(folded, "digest").where("id = rep").dropDuplicates(["digest"]).select("id", "n_shingles", "bands", "places"), "reps")

    banded = reps.select("id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = materialize(banded.join(shared, "key").select("key", "band", "id", "n_shingles", "c"), "members")
    weight = members.groupBy("id").agg(F.sum("c").alias("w"))
    members = materialize(members.join(weight, "id").select("key", "band", "id", "n_shingles", "w"), "members")

    # each bucket's heaviest member meets all others
    pivot = members.groupBy("key").agg(F.max(F.struct("w", F.col("id").alias("id2"), F.col("n_shingles").alias("n2"))).alias("p")).select("key", "p.id2", "p.n2")
    met = members.join(pivot, "key").where(f"id != id2 and 100 * least(n_shingles, n2) >= {percent} * greatest(n_shingles, n2)")
    met = met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
    links = materialize(_confirm(met, reps, texts, percent, bands * rows), "links")

    # buckets that are not one component yet: their members of different components meet, in blocks
    placed = materialize(members.join(components(links), "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("comp")), "placed")
    split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("lo != hi").select("key", "blocks")
    left = placed.join(split, "key").withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    left = left.select("key", "band", "id", "comp", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "side")
    left = left.join(reps, "id").join(texts.where("id is not null"), "id").select("key", "p", "q", "side", "band", "id", "comp", "n_shingles", "places", "bands", "text")
    share = percent / 100
    least = share - 5 * (share * (1 - share) / (bands * rows)) ** 0.5
    more = left.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "id").mapInArrow(frugal(lambda it: _bucket_rows(it, percent, least)), f"a {kind}, b {kind}")

    groups = components(links.union(more).union(copies).select("a", "b"))
    out = signed.groupBy("id").agg(F.max("n_shingles").alias("n_shingles")).join(groups, "id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"), F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the near-duplicates: of each group the row of the smallest id stays; unlinked rows all stay."""
    gone = free_name(docs, "gone")
    drop = near_duplicates(docs, id_col, text_col, **options).where("not kept").select(F.col(id_col).alias(gone))
    return docs.join(drop, F.col(id_col) == F.col(gone), "left_anti")
