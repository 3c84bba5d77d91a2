import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from morphlake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def exact(items, cap):
    """The least number of bins, by trying every bin for every item."""
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for r in sorted({x for x in bins if x >= items[i]}):
            k = bins.index(r)
            go(i + 1, bins[:k] + [r - items[i]] + bins[k + 1 :])
        go(i + 1, [*bins, cap - items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_bins_hold_and_are_few(seed):
    rng = random.Random(seed)
    items = [rng.randint(5, 60) for _ in range(rng.randint(1, 11))]
    counts = {x: items.count(x) for x in items}
    plan = packing.bin_completion(counts, 100)
    got = {}
    for filling, times in plan:
        assert sum(x * c for x, c in filling) <= 100
        for x, c in filling:
            got[x] = got.get(x, 0) + c * times
    assert got == counts
    assert sum(t for _, t in plan) == exact(items, 100)


def test_branching_beats_best_fit():
    counts = {44: 1, 40: 1, 36: 1, 30: 1, 26: 1, 24: 1}
    assert sum(t for _, t in packing.best_fit(counts, 100)) == 3
    plan = packing.bin_completion(counts, 100)
    assert sum(t for _, t in plan) == 2


def test_pack_equals_tokenizer(spark):
    rng = random.Random(2)
    words = ["Hello", "naïve", "it's", "x1y22", "Σίσυφος", "日本語", "a b", "<|endoftext|>", "foo<|startoftext|>", "é", "…!!", "́", "'s", "don't", "\x1c", "𝒳"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 300))) + rng.choice(["", "\n\t x"])) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "word " * 9000), (302, "dup"), (None, "null id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").repartition(5)
    out = [r.asDict() for r in packing.pack(df, PATH).collect()]
    tok = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i or -1, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) == -(-sum(r["length"] for r in out) // 4096)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_plain_words_are_parted_as_the_tokenizer_does():
    rng = random.Random(5)
    tok = Tokenizer.from_file(PATH)
    words = list(dict.fromkeys("".join(rng.choice("abcXYZéÀß09.,-!<'_×ë§") for _ in range(rng.randint(1, 7))) for _ in range(20_000)))
    text = " ".join(words).encode()
    raw = np.frombuffer(text, np.uint8)
    packing._STATE.clear()
    got = next(packing.token_ids(raw, np.array([0, len(raw)]), PATH))
    assert got.tolist() == tok.encode(text.decode(), add_special_tokens=False).ids


def test_memo_forgets_and_still_agrees():
    rng = random.Random(6)
    memo, all_ids = packing.WordIds(64), {}
    for _ in range(200):
        keys = np.unique(np.array([rng.randint(1, 400) for _ in range(20)], np.uint64))
        slots = memo.find(keys)
        for k, s in zip(keys.tolist(), slots.tolist(), strict=True):
            if s >= 0:
                assert memo.ids(np.array([s])).tolist() == all_ids[k]
        new = keys[slots < 0]
        for k in new.tolist():
            all_ids.setdefault(k, [k] * (k % 4))
        memo.put(new, np.array([len(all_ids[k]) for k in new.tolist()], np.int64), np.array([i for k in new.tolist() for i in all_ids[k]], np.uint32))
    assert memo.n <= 48 and (memo.find(np.array([rng.randint(1, 400)], np.uint64)) >= -1).all()


@pytest.mark.parametrize(("low", "high", "n"), [(700, 1500, 20_000), (900, 1300, 20_000), (1000, 1400, 300)])
def test_production_search_on_mid_lengths(low, high, n):
    rng = random.Random(n)
    counts = {}
    for _ in range(n):
        x = rng.randint(low, high)
        counts[x] = counts.get(x, 0) + 1
    size = lambda plan: sum(t for _, t in plan)
    plan = packing.bin_completion(counts)
    assert packing.lower_bound(counts, 4096) <= size(plan) <= size(packing.best_fit(counts, 4096))
    if n > 1000:
        assert size(plan) < size(packing.best_fit(counts, 4096))


def test_a_bin_of_many_pieces_is_enumerated():
    counts = {50: 2, 13: 4, 11: 2, 9: 2, 8: 2, 7: 2, 2: 4}
    plan = packing.bin_completion(counts, 100)
    assert sum(t for _, t in plan) == packing.lower_bound(counts, 100)


def test_long_text(spark):
    text = "Some words of it, 12 é's. " * 60_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = packing.pack(df, PATH).orderBy("piece").collect()
    ids = np.array([*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 1], "<u4")
    assert [r.ids_crc32 for r in got] == [zlib.crc32(ids[k : k + 4096].tobytes()) for k in range(0, len(ids), 4096)]
