import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from morphlake.llm import suffix_dedup as S


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((-1 if i is None else i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(8, 60)) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [prose(rng.randint(0, 40)) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts.insert(rng.randint(0, len(parts)), p[a : len(p) - rng.randint(0, len(p) // 4)])
        rows.append((i, "".join(parts)))
    rows += [(150, rows[3][1]), (151, rows[3][1]), (152, None), (153, ""), (154, "x" * 900), (155, "ab" * 700), (156, "short"), (156, "short"), (None, rows[5][1] + "!"), (157, passages[0] * 5), (7, rows[7][1])]
    return rows


@pytest.mark.parametrize(("length", "gram", "block", "local"), [(60, 12, 8192, 32), (60, 12, 7, 3), (60, 12, 4, 1000), (200, 32, 4096, 32)])
def test_equals_brute_force(spark, length, gram, block, local):
    rows = corpus(length)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string").repartition(4)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digest(df, length=length, gram=gram, block=block, local=local).collect())
    assert got == brute(rows, length)
    assert sum(r[2] for r in got) > 1000


def test_strip_keeps_columns(spark):
    p = "A passage of some words that both of the documents hold, é included. " * 4
    df = spark.createDataFrame([(1, "head:" + p + "tail", "a"), (2, p + "end", "b"), (3, None, "c"), (4, "free", None)], "doc_id long, text string, row string")
    got = {r.doc_id: (r.text, r.row) for r in S.strip(df).collect()}
    assert got[3] == (None, "c") and got[4] == ("free", None)
    assert got[1][0] == "head:tail" and got[2][0] == "end"
    assert S.digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_deep_shallow_sorts(seed):
    rng = random.Random(seed)
    stem = bytes(rng.choice(b"ab") for _ in range(70))
    strings = [stem[: rng.randint(0, 70)] + bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    group = np.sort(np.array([rng.randint(0, 2) for _ in strings]))
    rows, size = np.zeros((200, 112), np.uint8), np.array([len(s) for s in strings])
    for i, s in enumerate(strings):
        rows[i, : len(s)] = np.frombuffer(s, np.uint8)
    order, lcp = S.deep_shallow(rows, size, group, 16)
    assert group[order].tolist() == group.tolist()
    for g in range(3):
        own = [k for k in range(200) if group[k] == g]
        assert [strings[i] for i in order[own]] == sorted(strings[i] for i in own)
        assert lcp[own[0]] == 0 and all(lcp[k] == S.common_prefix(strings[order[k - 1]], strings[order[k]]) for k in own[1:])


@pytest.mark.parametrize("pairs", [1, 64])
def test_reach_equals_all_pairs(monkeypatch, pairs):
    monkeypatch.setattr(S, "PAIRS", pairs)
    rng = random.Random(pairs)
    length, before = 40, 24
    stem = [bytes(rng.choice(b"abcd") for _ in range(64)) for _ in range(3)]
    rows = []
    for g in range(30):
        for _ in range(rng.randint(1, 40)):
            s = bytearray(rng.choice(stem))
            for _ in range(rng.randint(0, 2)):
                s[rng.randrange(64)] = 120
            lo, hi = rng.choice([0, 0, 5]), rng.choice([64, 64, 50])
            rows.append((g, bytes(s[lo:24])[::-1], bytes(s[24:hi])))
    group = np.array([r[0] for r in rows])
    lefts, rights = np.zeros((len(rows), 24), np.uint8), np.zeros((len(rows), 40), np.uint8)
    for i, (_, a, b) in enumerate(rows):
        lefts[i, : len(a)], rights[i, : len(b)] = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    got = S.reach(rights, np.array([len(r[2]) for r in rows]), lefts, np.array([len(r[1]) for r in rows]), group, length, before)
    for i, (g, a, b) in enumerate(rows):
        best = [-1, -1]
        for j, (h, c, d) in enumerate(rows):
            if i != j and g == h and (x := S.common_prefix(a, c)) + (y := S.common_prefix(b, d)) >= length:
                best = [max(best[0], x), max(best[1], y)]
        assert [got[0][i], got[1][i]] == best


def test_windows_find_the_same_anchors():
    rng = random.Random(3)
    raw = np.frombuffer(bytes(rng.choice(b"abcdefgh ") for _ in range(30_000)), np.uint8)
    offsets = np.array([0, 500, 520, 29_000, 30_000])
    whole = [np.concatenate(x) for x in zip(*S.anchors(raw, offsets, 200, 32), strict=True)]
    cut = [np.concatenate(x) for x in zip(*S.anchors(raw, offsets, 200, 32, 700), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True)) and len(whole[0]) > 200


def test_long_text_and_clashing_names(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_500_000))
    df = spark.createDataFrame([(1, long, 1, 2, 3), (2, "x" + long[700_000:701_000] + "y", 4, 5, 6)], "doc_id long, text string, copies int, Spans int, digest int")
    got = {r.doc_id: r for r in S.strip(df).collect()}
    assert got[2].text == "xy" and (got[2].copies, got[2].Spans, got[2].digest) == (4, 5, 6)
    assert got[1].text == long[:700_000] + long[701_000:]


def test_groups_are_settled_in_small_pieces():
    n, rng = 10_000, np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, 368, np.uint8)) for _ in range(n // 2)]
    rows = {
        "key": pa.array(np.repeat(np.arange(n // 2), 2)), "number": pa.array(np.zeros(n, np.int64)), "digest": pa.array([i.to_bytes(16, "little") for i in range(n)], pa.binary()),
        "pos": pa.array(np.full(n, 168, np.int32)), "left": pa.array(np.full(n, 168, np.int32)), "context": pa.array([texts[i // 2] for i in range(n)], pa.binary()),
    }
    tracemalloc.start()
    found = list(S._settled(iter([pa.RecordBatch.from_pydict(rows)]), S.LENGTH, S.GRAM))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    spans = [(d, s, e) for b in found for d, s, e in zip(*(b.column(c).to_pylist() for c in ("digest", "s", "e")), strict=True)]
    assert sorted(spans) == sorted((i.to_bytes(16, "little"), 0, 368) for i in range(n))
    assert peak < 30 << 20, peak


def test_whole_groups_stay_whole():
    sizes = [1, 5000, 2, 3000, 1, 1, 9000, 4]
    key = np.repeat(np.arange(len(sizes)), sizes)
    batches = pa.table({"key": key, "number": np.zeros(len(key), np.int64)}).to_batches(max_chunksize=10_000)
    tables = list(S._whole_groups(iter(batches), 2048))
    assert np.concatenate([t.column("key").to_numpy() for t in tables]).tolist() == key.tolist()
    own = [set(t.column("key").to_numpy().tolist()) for t in tables]
    assert sum(map(len, own)) == len(sizes)
    assert all(t.num_rows <= 9000 + 2048 for t in tables)
