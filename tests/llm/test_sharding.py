import zlib

import numpy as np
import pytest

from morphlake.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 40, 41, 1000, 4097])
def test_feistel_is_a_permutation_with_inverse(n):
    p = sharding.feistel(np.arange(n), n, 7)
    assert sorted(p) == list(range(n))
    assert (sharding.feistel(p, n, 7, inverse=True) == np.arange(n)).all()


def test_shards(spark):
    rows = [(i % 97 if i % 50 else None, "text é %d" % (i % 13) if i % 7 else None, i) for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size long").repartition(5)
    out = sharding.shard(df).collect()
    assert len(out) == 1003
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(v) for v in by.values()]
    assert len(by) == 40 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in out) == want
    again = sharding.shard(df.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert sharding.shard(df.limit(0)).count() == 0


def test_equals_plain_feistel(spark):
    """Shard and slot against a Feistel network in plain integers over the sorted rows."""
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(500)), "é" * int(rng.integers(40)) + str(int(rng.integers(9))), 0) for _ in range(777)] + [(None, "a", 0), (None, None, 0), (3, "x" * 2_000_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(7)
    m64 = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m64
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m64
        return x ^ x >> 31

    n, seed = len(rows), 20240917
    half = ((n - 1).bit_length() + 1) // 2
    keys = [mix((k * 0x9E3779B97F4A7C15 + seed) & m64) for k in range(1, 7)]

    def place(x):
        while True:
            left, right = x >> half, x & (1 << half) - 1
            for k in keys:
                left, right = right, left ^ (mix(right ^ k) & (1 << half) - 1)
            x = left << half | right
            if x < n:
                return x

    light = [(-1 if i is None else i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t, _ in rows]
    want = sorted((i, size, crc, place(k) % 40, place(k) // 40) for k, (i, crc, size) in enumerate(sorted(light)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard(df).collect()) == want
