"""Distinct counts from marks against counting sets of values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.distinct import mark_firsts
from ledgerline.operators.median import bucket_weights, sets_median
from ledgerline.sources.io import materialize
from tests.conftest import plan_text


def rows_of(seed, n=600):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(40), 7, 7, 7]), rng.choice([None, "a", "b", "c"]), rng.choice([None, "x", "y"]), rng.choice([None, 1.0])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_marks_sum_to_distinct_counts(spark, seed):
    data = rows_of(seed)
    df = spark.createDataFrame(data, "o long, k string, l string, other double").repartition(5)
    marked = mark_firsts(df, "o", ["k", "l"], ["m0", "m1", "m2"])
    assert marked.columns == ["o", "k", "l", "other", "m0", "m1", "m2"] and marked.count() == len(data)
    got = {(r.k, r.l): (r.m0, r.m1, r.m2) for r in marked.groupBy("k", "l").agg(*[F.sum(c).alias(c) for c in ("m0", "m1", "m2")]).collect()}
    assert sum(v[0] for v in got.values()) == len({o for o, *_ in data if o is not None})
    for k in {d[1] for d in data}:
        assert sum(v[1] for (a, _), v in got.items() if a == k) == len({d[0] for d in data if d[1] == k and d[0] is not None})
        for l in {d[2] for d in data if d[1] == k}:
            assert got[k, l][2] == len({d[0] for d in data if d[1:3] == (k, l) and d[0] is not None})


def test_one_window_and_no_copies(spark):
    df = spark.createDataFrame(rows_of(9), "o long, k string, l string, other double")
    plan = plan_text(mark_firsts(df, "o", ["k", "l"], ["m0", "m1", "m2"]))
    assert "Generate" not in plan and "Expand" not in plan and len(re.findall(r"^\(\d+\) Window", plan, re.M)) == 1


def test_edges(spark):
    df = spark.createDataFrame([], "o long, k string")
    assert mark_firsts(df, "o", ["k"], ["a", "b"]).collect() == []
    no_keys = mark_firsts(spark.createDataFrame([(1,), (1,), (None,), (2,)], "o long"), "o", [], ["a"])
    assert no_keys.agg(F.sum("a")).first()[0] == 2
    with pytest.raises(ValueError):
        mark_firsts(df, "o", ["k"], ["a"])


def test_sets_median_against_sorting(spark):
    rng = random.Random(4)
    data = [(rng.choice([None, "a", "b"]), rng.choice(["x", "y", None]), rng.choice([None, *range(60)]), rng.randrange(1, 4)) for _ in range(500)]
    df = spark.createDataFrame(data, "k string, l string, v int, w int").withColumn("v", (F.col("v") * 1.25).cast("decimal(12,2)"))
    for bits in (3, 20):
        b = materialize(bucket_weights(df, ["k", "l"], "v", "w", bucket_bits=bits), "buckets")
        out = sets_median(df, b, [["k", "l"], ["k"], ["l"]], ["k", "l"], {"k": "no_k", "l": "no_l"}, "v", "w", "m", bits).collect()
        got = {(r.k, r.l, r.no_k, r.no_l): float(r.m) for r in out}
        want = {}
        for k, l, v, w in data:
            for key in ((k, l, 0, 0), (k, None, 0, 1), (None, l, 1, 0)):
                if v is not None:
                    want.setdefault(key, []).extend([v * 1.25] * w)
        assert got == {key: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2 for key, v in want.items()}
