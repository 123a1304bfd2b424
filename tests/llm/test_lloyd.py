"""Operator 13 against Lloyd's rounds in plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from ledgerline.llm import lloyd, registry
from tests.conftest import SF001

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, k=8, rounds=10, dims=64, scale=1024):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * int(x)) if abs(x) > 2**53 else math.floor(scale * x) for x in v], v))
    key = [("~" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, _, v in kept]
    c = [kept[j][1] for j in sorted(range(len(kept)), key=key.__getitem__)[:k]]

    def assign():
        out = []
        for _, q, _ in kept:
            d = [sum((a - b) ** 2 for a, b in zip(q, x)) for x in c]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        mine = [a for a, _ in assign()]
        for j in range(len(c)):
            own = [q for (_, q, _), m in zip(kept, mine) if m == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    out = assign()
    per = {j: sum(d for m, d in out if m == j) for j in range(len(c))}
    return sorted(
        ((i, m, d, per[m], sum(per.values()), hashlib.sha256(",".join(map(str, c[m])).encode()).hexdigest()) for (i, _, _), (m, d) in zip(kept, out)), key=repr
    )


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_whole_query_against_plain_python(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    got = rows_of(registry.op13_centroid_clusters(spark, SF001))
    assert got == brute(rows) and len(got) > 8


@pytest.mark.parametrize("blocks, group", [(1, 5), (3, 7), (4, 4096)])
def test_edge_rows(spark, blocks, group):
    rng = random.Random(11)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5]) + rng.random() / 50 for _ in range(6)], "a") for i in range(40)]
    rows += [(100, None, "a"), (101, [], "a"), (102, [1.0] * 5, "a"), (103, [1.0] * 5 + [nan], "a"), (104, [inf] + [0.0] * 5, "a"), (105, [None] + [0.0] * 5, "a")]
    rows += [(3, rows[3][1], "b")] * 3 + [(3, rows[4][1], "b"), (None, rows[5][1], "b"), (106, [0.0] * 6, None), (107, [-0.0] * 6, "c"), (108, [1e-320] * 6, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    got = rows_of(lloyd.report(df, dims=6, blocks=blocks, group=group))
    assert got == brute([r[:2] for r in rows], dims=6)
    few = spark.createDataFrame(rows[:5], df.schema)
    assert rows_of(lloyd.report(few, dims=6, blocks=blocks)) == brute([r[:2] for r in rows[:5]], dims=6)
    assert rows_of(lloyd.report(df.limit(0), dims=6, blocks=blocks)) == []


def test_values_beyond_64_bits_stay_exact(spark):
    rng = random.Random(12)
    rows = [(i, [rng.choice([1e9, -1e9, 3e15, 0.25]) * rng.random() for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, k=3, rounds=4, dims=4)
    top = (1 << 63) - 1
    fits = [(i, m, *(x if x <= top else None for x in (d, c, t)), h) for i, m, d, c, t, h in want]
    assert rows_of(lloyd.report(df, k=3, rounds=4, dims=4, blocks=2)) == sorted(fits, key=repr)
    assert any(r[2] is None for r in fits)


def test_quantise_is_exact():
    x = np.array([[1e300, -1e300, 0.3, -0.3], [2.0**51, 1e18, -1e-300, 1 / 1024]])
    assert lloyd.quantise(x, 1024).tolist() == [[math.floor(int(v) * 1024) if abs(v) > 2**53 else math.floor(v * 1024) for v in r] for r in x.tolist()]
    assert lloyd.quantise(x[:, 2:] / 3, 1000).tolist() == [[v.as_integer_ratio()[0] * 1000 // v.as_integer_ratio()[1] for v in r] for r in (x[:, 2:] / 3).tolist()]
