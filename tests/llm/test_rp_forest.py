import numpy as np
import pytest

from morphlake.llm import rp_forest as R


def rows_of(seed, n, dim):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    for i in range(0, n, 3):  # near copies at many angles
        base[i] = base[rng.integers(n)] + rng.standard_normal(dim) * rng.uniform(0.02, 0.5)
    base[5] = base[9]
    base[n // 2 : n // 2 + 40] = base[1] + 0.01 * rng.standard_normal((40, dim))
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 3 == 0)) for i, v in enumerate(base)]
    rows += [(n, None, 0), (n + 1, [0.0] * dim, 0), (n + 2, [None] + [1.0] * (dim - 1), 0), (n + 3, [float("nan")] * dim, 0), (n + 4, rows[1][1], None), (n + 5, rows[1][1], rows[1][2]), (n + 6, rows[1][1][:-1], rows[1][2]), (n + 7, [], 0), (n + 5, rows[1][1], rows[1][2]), (n + 8, [float("inf")] + [1.0] * (dim - 1), 0)]
    return rows


def brute(rows, threshold):
    seen, ok = set(), []
    for i, v, label in rows:
        if label is None or not v or any(x is None for x in v) or not np.isfinite(v).all() or not np.any(v):
            continue
        if (i, tuple(v), label) not in seen:
            seen.add((i, tuple(v), label))
            ok.append((i, np.array(v) / np.sqrt(np.dot(v, v)), label))
    links = {i: 0 for i, _, _ in rows}
    comp = {i: i for i in links}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            if ok[a][2] == ok[b][2] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= threshold:
                links[ok[a][0]] += 1
                links[ok[b][0]] += 1
                p, q = sorted((find(ok[a][0]), find(ok[b][0])))
                comp[q] = p
    return {i: (links[i], find(i)) for i in links}


@pytest.mark.parametrize(("leaf", "block"), [(512, 1024), (24, 1024), (24, 8)])
def test_equals_brute_force(spark, leaf, block):
    rows = rows_of(4, 400, 32)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, id string").repartition(3)
    out = R.near_duplicates(df, leaf=leaf, block=block).collect()
    assert len(out) == len(rows)
    want = brute(rows, 0.93)
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert sum(w[0] for w in want.values()) > 900


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert R.near_duplicates(df).count() == 0


def test_plan_keeps_misses_small():
    for n in (10**4, 10**6, 10**9):
        depth, trees, spill = R.plan_forest(n, 64, 0.93, 512, 1e-6)
        assert depth >= 4 and 2 <= trees < 400 and spill >= 0


@pytest.mark.parametrize("share", [0.05, 0.33, 0.6])
def test_hot_group_of_near_copies(spark, share):
    """Members of the group have cosines of 0.93 to 0.95; no link of theirs is lost to cuts through the group."""
    rng = np.random.default_rng(5)
    n, dim = 4000, 64
    x = rng.standard_normal((n, dim)) / np.sqrt(dim)
    hot = int(n * share)
    x[:hot] = x[0] / np.sqrt(x[0] @ x[0]) + np.sqrt(1 / 0.94 - 1) * x[n - hot :][rng.permutation(hot)]
    x = x.astype(np.float32).astype(np.float64)
    unit = np.array([v / np.sqrt(v @ v) for v in x])
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    assert near.sum() > 0.5 * hot * hot
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in R.near_duplicates(df, leaf=64).collect()}
    assert [got[i] for i in range(n)] == near.sum(axis=1).tolist()


@pytest.mark.parametrize("n", [12_000])
def test_recall_of_a_built_forest(spark, n):
    """Planted pairs just above the threshold in one label of more than 10,000 vectors: the forest has levels and spill."""
    depth, trees, spill = R.plan_forest(n, 64, 0.93, R.LEAF, R.MISS)
    assert depth >= 4 and spill > 0
    rng = np.random.default_rng(11)
    x = rng.standard_normal((n, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    side = rng.standard_normal((n // 2, 64))
    side -= (side * x[: n // 2]).sum(axis=1, keepdims=True) * x[: n // 2]
    side /= np.sqrt((side * side).sum(axis=1, keepdims=True))
    cos = rng.uniform(0.9301, 0.94, (n // 2, 1))
    x[n // 2 :] = cos * x[: n // 2] + np.sqrt(1 - cos * cos) * side
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in R.near_duplicates(df).collect()}
    found = sum(got[i + n // 2] == (1, i) for i in range(n // 2))
    assert found >= 0.999 * (n // 2)
