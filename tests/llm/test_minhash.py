import random
import re

import numpy as np
import pytest

from morphlake.llm import minhash


def brute(rows, percent=85):
    sets, comp = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            comp[x] = comp[comp[x]]
            x = comp[x]
        return x

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                comp[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["É", "the", "The"]
    rows, n = [], 0
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 150))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((n, rng.choice([" ", "\n", "  "]).join(w)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "a b"), (n + 4, "A B"), (n + 5, "a\x0bb"), (n + 6, "a b"), (n + 7, "x " * 40000), (n + 8, "X " * 39000)]
    # one large group of near copies of a base that is not the smallest id
    base = [rng.choice(vocab) for _ in range(120)]
    for k in range(60):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = "n%d" % rng.randrange(1000)
        rows.append((n + 9 + k, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_equals_brute_force(spark, block):
    rows = corpus()
    df = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, id long, key string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, block=block).collect()}
    assert got == brute(rows)


def test_keep_one_and_empty(spark):
    df = spark.createDataFrame([(3, "a b c d e f", 1), (1, "A b c d e f", 2), (None, "a b c d e f", 3), (5, "other words", 4)], "doc_id long, text string, a int")
    assert sorted((r.a for r in minhash.keep_one(df).collect())) == [2, 3, 4]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_signature_estimates_and_stops():
    rng = np.random.default_rng(1)
    both, own = rng.integers(0, 2**63, 900).astype(np.uint64), rng.integers(0, 2**63, 200).astype(np.uint64)
    x = minhash.superminhash(np.unique(np.concatenate([both, own[:100]])), 512)
    y = minhash.superminhash(np.unique(np.concatenate([both, own[100:]])), 512)
    assert abs((x == y).mean() - 900 / 1100) < 0.06
    one = minhash.superminhash(own[:1], 32)
    assert sorted(one >> 40) == list(range(32))  # one element: each level names one place
