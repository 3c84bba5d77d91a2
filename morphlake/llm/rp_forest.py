"""Embedding near-dedup by a random-projection tree forest with spill.

Every tree splits by random directions at a median, each side also keeping what lies within the spill of the cut;
vectors of one label that share a leaf are compared in double precision, each pair counted only in its first common leaf,
links are united into components. The trees' medians come from a bounded sample (`sample` vectors); all vectors are
placed. Depth, spill and number of trees are planned for isotropic vectors: those of least work for which a pair just at
the threshold is missed with probability `miss` at most (`plan_forest` has the formula). Where vectors crowd, that formula
doesn't hold: every node widens its spill by its own projections or stays a leaf (`grow_tree`), and trees are added until
the share of the sample's own links that a tree was seen to part comes to `miss` (`build_forest`). That share is an
estimate: a group too small to show in the sample has the plan's probability only.

Scale: equal vectors of a label are folded and weigh as many as they are. Vectors go to their leaves in one exchange, in
the precision they came in, each with the numbers of the leaves it shares with others before this one. A leaf that by the
sample holds more than `block` vectors of a label is dealt to pairs of blocks; whatever comes to a task is compared in tiles
of a block by a block, so memory is bounded even where the sample was wrong. A leaf gives counts and edges that unite its
components, never its pairs.

Null, zero or non-finite vectors and null labels link with nothing; vectors of different lengths neither. Repeated rows of
one id and vector count once. Null ids are left out of all links. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

THRESHOLD = 0.93
LEAF = 512
BLOCK = 1024
SAMPLE = 20_000
MISS = 1e-6


def _unit(values: list | None) -> np.ndarray | None:
    if not values or any(v is None for v in values):
        return None
    v = np.array(values, np.float64)
    norm = float(np.sqrt(v @ v)) if np.isfinite(v).all() else 0.0
    if not norm or not math.isfinite(norm):
        scale = float(np.abs(v).max()) if np.isfinite(v).all() else 0.0
        if not scale:
            return None
        v = v / scale  # squares that overflow or vanish
        norm = float(np.sqrt(v @ v))
    return v / norm


def _units(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(id, label, dim, vector, digest): the vector's bytes in its own precision, the digest of its direction."""
    for b in batches:
        rows = b.column(2).to_pylist()
        units = [_unit(v) for v in rows]
        raw = [None if u is None else np.array(v, kind).tobytes() for u, v in zip(units, rows, strict=True)]
        digest = [None if u is None else hashlib.md5(u.astype("<f8").tobytes()).digest() for u in units]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([None if u is None else len(u) for u in units], pa.int32()), pa.array(raw, pa.binary()), pa.array(digest, pa.binary())], names=["id", "label", "dim", "vector", "digest"])


def _matrix(raw: bytes, kind: str, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(raw, kind).reshape(-1, dim).astype(np.float64)
    with np.errstate(over="ignore", under="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
    odd = ~np.isfinite(norm) | (norm == 0)
    if odd.any():  # squares that overflow or vanish
        x[odd] /= np.abs(x[odd]).max(axis=1, keepdims=True)
        norm[odd] = np.sqrt((x[odd] * x[odd]).sum(axis=1))
    return x / norm[:, None]


# ---------------------------------------------------------------- the forest


def plan_forest(largest: int, dim: int, threshold: float, leaf: int, miss: float) -> tuple[int, int, float]:
    """(depth, trees, spill): of all spills, that with the least leaf entries for each vector.

    Two unit vectors at the threshold differ by d = sqrt(2 - 2 * threshold). Along a random direction the difference is
    about normal with sigma d / sqrt(dim), positions with 1 / sqrt(dim). A level parts the pair where the cut falls
    between them and both lie outside the spill: about E max(|x| - 2 * spill, 0) times the density at the median. That
    density is the isotropic one; `build_forest` sees to groups that are denser.
    """
    if largest <= leaf:
        return 0, 1, 0.0
    d = math.sqrt(2 - 2 * threshold)
    best = None
    for k in (0.25, 0.5, 0.75, 1.0, 1.5):  # spill in sigmas of the difference
        t = 2 * k
        tail = math.exp(-t * t / 2) / math.sqrt(2 * math.pi) - t * 0.5 * math.erfc(t / math.sqrt(2))
        part = min(0.5, 2 * tail * d / math.sqrt(2 * math.pi))
        both = math.erf(k * d / math.sqrt(2))  # share within the spill
        depth = math.ceil(math.log(leaf / largest) / math.log((1 + both) / 2))
        lost = 1 - (1 - part) ** depth
        trees = max(2, math.ceil(math.log(miss) / math.log(lost)))
        work = trees * (1 + both) ** depth
        if best is None or work < best[0]:
            best = (work, depth, trees, k * d / math.sqrt(dim))
    return best[1:]


_GRID = np.linspace(0.0, 8.0, 2001)
_TAIL = np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in _GRID])  # of the normal distribution
_SPILLS = (0.25, 0.5, 0.75, 1.0, 1.25, 1.5)  # in sigmas of the difference of a pair at the threshold


def _parted(away: np.ndarray, spill: float, sigma: float) -> float:
    """Share of the links at the threshold that a cut parts, for rows at these distances from it."""
    return float(np.where(away > spill, np.interp((away + spill) / sigma, _GRID, _TAIL), 0.0).mean())


def grow_tree(sample: np.ndarray, depth: int, spill: float, sigma: float, part: float, tight: float, scale: float, leaf: int, rng: np.random.Generator, number: int) -> tuple[list | int, int]:
    """(tree, next leaf number): nested [direction, cut, spill, left, right]; a leaf is its number.

    Every node takes its cut's density from its own projections: its spill is the planned one if the cut then parts at most
    `part` of the links, else the first wider one with which it parts at most `tight`. A node that no such spill splits well
    (most of its rows would go to both sides: a group of near copies) stays a leaf, which is dealt to pairs of blocks and
    loses nothing.
    """

    def grow(rows: np.ndarray, left: int) -> list | int:
        nonlocal number
        if left and len(rows) >= 8 and len(rows) * scale > leaf:
            r = rng.standard_normal(sample.shape[1])
            r /= np.sqrt(r @ r)
            p = sample[rows] @ r
            cut = float(np.median(p))
            away = np.abs(p - cut)
            wide = spill
            if _parted(away, spill, sigma) > part:
                wide = next((k * sigma for k in _SPILLS if k * sigma > spill and _parted(away, k * sigma, sigma) <= tight), None)
            if wide is not None and (away <= wide).mean() <= 0.5:
                return [r, cut, wide, grow(rows[p <= cut + wide], left - 1), grow(rows[p > cut - wide], left - 1)]
        number += 1
        return number - 1

    return grow(np.arange(len(sample)), depth), number


def _probes(sample: np.ndarray, threshold: float, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows, partners) to measure a tree by, one entry for each order of magnitude of a row's number of links in the
    sample: the links of least cosine of some rows, and for all of them made-up partners just at the threshold."""
    at = rng.choice(len(sample), min(768, len(sample)), replace=False)
    made = rng.standard_normal((len(at), sample.shape[1]))
    made -= (made * sample[at]).sum(axis=1, keepdims=True) * sample[at]
    made /= np.maximum(np.sqrt((made * made).sum(axis=1, keepdims=True)), 1e-300)
    out = [(sample[at], threshold * sample[at] + math.sqrt(max(0.0, 1 - threshold * threshold)) * made)]
    strata: dict[int, list[tuple[int, int]]] = {}
    for i in at.tolist():
        cos = sample @ sample[i]
        near = np.flatnonzero(cos >= threshold)
        near = near[near != i]
        if len(near):
            least = near[np.argsort(cos[near], kind="stable")[:8]]
            strata.setdefault(len(near).bit_length() // 2, []).extend((i, j) for j in least.tolist())
    return out + [(sample[[i for i, _ in own]], sample[[j for _, j in own]]) for own in strata.values() if len(own) >= 16]


def build_forest(sample: np.ndarray, plan: tuple[int, int, float], n: int, threshold: float, leaf: int, miss: float, seed: int) -> list:
    """As many trees as the plan has, or more where those of the sample's own links that a tree was seen to part ask for it.

    Some trees are tried for several values of `tight`; the one with the least rows to compare, over all trees, is taken.
    """
    depth, trees, spill = plan
    sigma = math.sqrt(2 - 2 * threshold) / math.sqrt(sample.shape[1])
    scale = n / len(sample)
    isotropic = np.abs(np.random.default_rng(seed).standard_normal(4096)) / math.sqrt(sample.shape[1])
    part = max(1.25 * _parted(isotropic, spill, sigma), 1e-4)
    probes = _probes(sample, threshold, np.random.default_rng((seed, 1 << 20)))
    best = None
    for tight in (part, part / 8, part / 64, 0.0):
        forest, lost, work, number = [], [], 0.0, 0
        for t in range(min(trees, 12)):
            tree, number = grow_tree(sample, depth + 8, spill, sigma, part, tight, scale, leaf, np.random.default_rng((seed, t)), number)
            forest.append(tree)
            lost.append([np.mean([set(a).isdisjoint(b) for a, b in zip(leaves_of(x, [tree]), leaves_of(y, [tree]), strict=True)]) for x, y in probes])
            _, sizes = np.unique(np.concatenate(leaves_of(sample[:4000], [tree])), return_counts=True)
            work += float((sizes * np.ceil(sizes * scale * len(sample) / min(len(sample), 4000) / BLOCK)).sum())
        # the highest share lost in a tree, two standard errors up
        worst = min(0.95, float((np.mean(lost, axis=0) + 2 * np.std(lost, axis=0) / math.sqrt(len(lost))).max()))
        need = max(trees, math.ceil(math.log(miss) / math.log(worst)) if worst > miss else 1)
        if best is None or work / len(forest) * need < best[0]:
            best = (work / len(forest) * need, tight, need, forest, number)
    _, tight, need, forest, number = best
    for t in range(len(forest), need):
        tree, number = grow_tree(sample, depth + 8, spill, sigma, part, tight, scale, leaf, np.random.default_rng((seed, t)), number)
        forest.append(tree)
    return forest


def placed_in(vectors: np.ndarray, forest: list) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of all places, by row and then leaf."""
    rows, leaves = [], []

    def down(node, own: np.ndarray) -> None:
        if not len(own):
            return
        if not isinstance(node, list):
            rows.append(own)
            leaves.append(np.full(len(own), node))
            return
        r, cut, spill, left, right = node
        p = vectors[own] @ r
        down(left, own[p <= cut + spill])
        down(right, own[p > cut - spill])

    for tree in forest:
        down(tree, np.arange(len(vectors)))
    row, leaf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, leaves))
    order = np.lexsort((leaf, row))
    return row[order], leaf[order]


def leaves_of(vectors: np.ndarray, forest: list) -> list[list[int]]:
    """For each vector the ascending numbers of its leaves in all trees."""
    row, leaf = placed_in(vectors, forest)
    return [x.tolist() for x in np.split(leaf, np.searchsorted(row, np.arange(1, len(vectors))))] if len(vectors) else []


# ---------------------------------------------------------------- leaves


def _placed(batches: Iterator[pa.RecordBatch], forest: list, blocks: dict, kind: str, dim: int) -> Iterator[pa.RecordBatch]:
    """A row for each leaf of each vector (and pair of blocks that its own is in): with the leaves before it, packed."""
    for b in batches:
        if not b.num_rows:
            continue
        row, leaf = placed_in(_matrix(b"".join(b.column("vector").to_pylist()), kind, dim), forest)
        start = np.searchsorted(row, np.arange(b.num_rows))
        turn = np.arange(len(row)) - start[row]
        many = np.ones(len(row), np.int64)
        if blocks:
            labels = b.column("label").to_pylist()
            many[:] = [blocks.get((labels[r], k), 1) for r, k in zip(row.tolist(), leaf.tolist(), strict=True)]
        own = np.zeros(len(row), np.int64)
        split = np.flatnonzero(many > 1)
        if len(split):
            own[split] = [int.from_bytes(hashlib.md5(str(i).encode()).digest()[:4], "little") for i in b.column("id").take(pa.array(row[split])).to_pylist()] % many[split]
        entry = np.repeat(np.arange(len(row)), many)
        other = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)
        other[many[entry] == 1] = 0
        size = turn[entry]
        ends = np.cumsum(size)
        earlier = leaf[np.repeat(start[row[entry]] - (ends - size), size) + np.arange(int(ends[-1]))].astype("<i4")
        at = np.concatenate([[0], ends * 4]).astype(np.int32)
        before = pa.BinaryArray.from_buffers(pa.binary(), len(entry), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(earlier.tobytes())])
        rows = b.select(["id", "label", "dim", "vector", "weight"]).take(pa.array(row[entry]))
        p, q = np.minimum(own[entry], other), np.maximum(own[entry], other)
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(leaf[entry].astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(q.astype(np.int32)), pa.array(own[entry].astype(np.int32)), before], names=[*rows.schema.names, "leaf", "p", "q", "side", "before"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row reachable over the edges a - b."""
    own = np.arange(n)
    while True:
        new = own.copy()
        np.minimum.at(new, a, own[b])
        np.minimum.at(new, b, own[a])
        new = new[new]
        if (new == own).all():
            return own
        own = new


def _met(before: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the rows i and j shared a leaf before."""
    wide = max((len(x) for x in before), default=0)
    out = np.zeros(len(i), np.bool_)
    if not wide:
        return out
    table = np.full((len(before), wide), -1, np.int32)
    for k, x in enumerate(before):
        table[k, : len(x)] = x
    other = np.where(table < 0, -2, table)
    for k in range(0, len(i), 1 << 14):
        x, y = table[i[k : k + (1 << 14)]], other[j[k : k + (1 << 14)]]
        out[k : k + (1 << 14)] = (x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
    return out


def _tiles(n: int, side: np.ndarray, across: bool, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row lists whose pairs are all to be compared; a list with itself for the pairs within."""
    parts = [np.flatnonzero(side == x) for x in np.unique(side)] if across else [np.arange(n)]
    cut = [[own[k : k + block] for k in range(0, len(own), block)] for own in parts]
    if across:
        if len(cut) == 2:
            yield from ((x, y) for x in cut[0] for y in cut[1])
        return
    for k, x in enumerate(cut[0]):
        yield from ((x, y) for y in cut[0][k:])


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, kind: str, block: int) -> Iterator[pa.RecordBatch]:
    """(id, links, root) of the rows that have any, for each run of equal (label, dim, leaf, p, q)."""

    def settle(t: pa.Table) -> pa.RecordBatch | None:
        n = t.num_rows
        dim, p, q = (t.column(c)[0].as_py() for c in ("dim", "p", "q"))
        x = _matrix(b"".join(t.column("vector").to_pylist()), kind, dim)
        weight, side = t.column("weight").to_numpy(), t.column("side").to_numpy()
        before = None
        links, edges = np.zeros(n, np.int64), []
        for rows, columns in _tiles(n, side, p != q, block):
            near = x[rows] @ x[columns].T >= threshold
            if rows is columns:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            if not len(i):
                continue
            if before is None:
                before = [np.frombuffer(v, "<i4") for v in t.column("before").to_pylist()]
            i, j = rows[i], columns[j]
            new = ~_met(before, i, j)  # a pair that met before was counted and united there
            i, j = i[new], j[new]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            root = _roots(n, i, j)
            moved = np.flatnonzero(root != np.arange(n))
            edges.append(np.stack([moved, root[moved]]))
        if not edges:
            return None
        a, b = np.concatenate(edges, axis=1)
        root = _roots(n, a, b)
        hit = np.flatnonzero((links > 0) | (root != np.arange(n)))
        ids = t.column("id").combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(hit)), pa.array(links[hit]), ids.take(pa.array(root[hit]))], names=["id", "links", "root"])

    def groups(t: pa.Table) -> np.ndarray:
        """Where runs start."""
        labels = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        new = labels[1:] != labels[:-1]
        for c in ("dim", "leaf", "p", "q"):
            v = t.column(c).to_numpy()
            new |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n < 4096:
            continue
        t = pa.Table.from_batches(held)
        first = groups(t)
        for a, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if e - a > 1 and (out := settle(t.slice(a, e - a))) is not None:
                yield out
        held = t.slice(int(first[-1])).to_batches()
        n = sum(x.num_rows for x in held)
    if n:
        t = pa.Table.from_batches(held)
        first = [*groups(t).tolist(), n]
        for a, e in zip(first[:-1], first[1:], strict=True):
            if e - a > 1 and (out := settle(t.slice(a, e - a))) is not None:
                yield out


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
    leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE, miss: float = MISS, seed: int = 11,
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    light = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    kind, label_kind, number = (t.simpleString() for t in (light.schema["id"].dataType, light.schema["label"].dataType, light.schema["v"].dataType.elementType))
    number = "<f4" if number == "float" else "<f8"
    units = light.mapInArrow(lambda it: _units(it, number), f"id {kind}, label {label_kind}, dim int, vector binary, digest binary")
    units = materialize(units.where("id is not null and label is not null and vector is not null").dropDuplicates(["id", "label", "digest"]), "units")
    folded = units.groupBy("label", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    members = materialize(units.select("id", "label", "digest").join(folded, ["label", "digest"]).select("id", "rep", "label", "digest", "weight"), "copies")
    reps = materialize(units.join(members.where("id = rep").select("id", "label", "digest", "weight"), ["id", "label", "digest"]).select("id", "label", "dim", "vector", "weight"), "reps")
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n"), F.sum("n").alias("all"))
    # each vector length with a forest has its own (one as a rule)
    compared = None
    for r in sizes.collect():
        own = reps.where(F.col("dim") == r.dim)
        plan = plan_forest(r.n, r.dim, threshold, leaf, miss)
        forest: list = [0]
        blocks: dict = {}
        if plan[0] or r.n > block:
            taken = own.select("label", "vector").orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # bounded by `sample`
            x = _matrix(b"".join(bytes(t.vector) for t in taken), number, r.dim)
            if plan[0]:
                forest = build_forest(x, plan, r.n, threshold, leaf, miss, seed)
            row, at = placed_in(x, forest)
            seen = Counter(zip((taken[k].label for k in row.tolist()), at.tolist(), strict=True))
            scale = r["all"] / len(taken)
            blocks = {k: math.ceil(n * scale / block) for k, n in seen.items() if n * scale > 2 * block}
        schema = f"id {kind}, label {label_kind}, dim int, vector binary, weight long, leaf int, p int, q int, side int, before binary"
        dealt = own.mapInArrow(lambda it, forest=forest, blocks=blocks, dim=r.dim: _placed(it, forest, blocks, number, dim), schema)
        keys = ["label", "dim", "leaf", "p", "q"]
        part = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda it: _compare(it, threshold, number, block), f"id {kind}, links long, root {kind}")
        compared = part if compared is None else compared.union(part)
    if compared is None:
        return light.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    compared = materialize(compared, "compared")
    links = compared.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    counted = members.join(links, "rep", "left").groupBy("id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"))
    edges = compared.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")).union(members.where("id != rep").select("id", "rep"))
    groups = components(edges)
    out = light.select("id").join(counted, "id", "left").join(groups, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"))
