"""Operator 2 against all pairs in double precision."""

import numpy as np
import pytest

from ledgerline.llm import vector_dup as vd

SCHEMA = "vec_id long, embedding array<float>, label string, id string, cells int"


def all_pairs(rows, cosine=0.93):
    usable = [(k, np.array(v, np.float64)) for k, (_, v, l) in enumerate(rows) if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [0] * len(rows)
    ids = [r[0] for r in rows]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (a, u) in enumerate(usable):
        for b, w in usable[x + 1 :]:
            if rows[a][2] == rows[b][2] and len(u) == len(w) and u @ w / (np.sqrt(u @ u) * np.sqrt(w @ w)) >= cosine:
                links[a] += 1
                links[b] += 1
                i, j = sorted((find(ids[a]), find(ids[b])))
                root[j] = i
    return sorted((i, n, find(i)) for i, n in zip(ids, links))


def clusters(seed, dims=16, labels="abc"):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(14):
        centre = rng.standard_normal(dims)
        for _ in range(int(rng.integers(1, 14))):
            rows.append((len(rows), (centre + rng.uniform(0.1, 0.35) * rng.standard_normal(dims)).astype(np.float32).tolist(), labels[k % len(labels)]))
    return rows


def found(spark, rows, p=vd.VectorDup()):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted((r.vec_id, r.n_links, r.component_id) for r in vd.near_vectors(df, p).collect())


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 8)])
def test_links_and_components_match_all_pairs(spark, seed, block):
    rows = clusters(seed)
    want = all_pairs(rows)
    assert sum(n for _, n, _ in want) > 50
    assert found(spark, rows, vd.VectorDup(block_rows=block)) == want


def test_cells_of_large_labels_keep_the_links(spark):
    """With cells forced to the depth of a large label the recall still holds."""

    class Deep(vd.VectorDup):
        def depth(self, largest):
            return 2

    rows = clusters(5, labels="a")
    assert found(spark, rows, Deep()) == all_pairs(rows)


def test_unusable_vectors_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, "a"), (2, [], "a"), (3, [0.0, 0.0], "a"), (4, [1.0, None], "a"), (5, [nan, 1.0], "a"), (6, [inf, 1.0], "a"),
        (7, [1.0, 2.0], None), (8, [1.0, 2.0], "a"), (9, [2.0, 4.0], "a"), (10, [1.0, 2.0], "b"), (11, [1.0, 2.0, 3.0], "a"),
        (12, [-0.0, 1.0], "c"), (13, [0.0, 1.0], "c"), (14, [1e-30, 2e-30], "a"), (15, [3e30, 6e30], "a"),
    ]
    assert found(spark, rows) == all_pairs(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert vd.near_vectors(df.limit(0)).collect() == []
    twice = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vd.near_vectors(df.filter("vec_id = 8").union(df.filter("vec_id = 8"))).collect())
    assert twice == [(8, 1, 8, True)] * 2


def test_doubles_of_any_scale(spark):
    rows = [
        (1, [1e200, 2e200], "a"), (2, [1e200, 2.01e200], "a"), (3, [1e-200, 2e-200], "a"), (4, [1e-200, 2.01e-200], "a"), (5, [1e200, -2e200], "a"),
        (6, [5e-324, 1e-323], "a"), (7, [1.7e308, 1.7e308], "b"), (8, [1.6e308, 1.7e308], "b"), (9, [-1.7e308, 1.7e308], "b"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vd.near_vectors(df).collect())
    assert got == [(1, 4, 1), (2, 4, 1), (3, 4, 1), (4, 4, 1), (5, 0, 5), (6, 4, 1), (7, 1, 7), (8, 1, 7), (9, 0, 9)]


def test_calibrated_count():
    """A pair at the threshold reaches least_count but for a share of ``miss``."""
    p = vd.VectorDup()
    rng = np.random.default_rng(3)
    u, v = np.zeros(32), np.zeros(32)
    u[0] = 1
    v[0], v[1] = p.cosine, np.sqrt(1 - p.cosine**2)
    apart = np.abs(rng.standard_normal((4000, p.projections, 2)) @ np.array([u[0] - v[0], u[1] - v[1]]))
    missed = ((apart <= p.window).sum(axis=1) < p.least_count).mean()
    assert missed <= 20 * p.miss
