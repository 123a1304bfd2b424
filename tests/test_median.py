"""exact_median against a brute-force median of the expanded rows."""

import random
import re
from decimal import Decimal

import numpy as np
import pytest

from ledgerline.operators.median import exact_median, histogram
from tests.conftest import plan_text


def brute(rows):
    groups = {}
    for g, v, w in rows:
        if v is not None:
            groups.setdefault(g, []).extend([float(v)] * w)
    return {g: float(np.percentile(np.array(vs), 50)) for g, vs in groups.items()}


@pytest.mark.parametrize("seed,bits", [(1, 3), (2, 0), (3, 20), (4, 6)])
def test_exact_median_matches_brute_force(spark, seed, bits):
    rnd = random.Random(seed)
    rows = []
    for _ in range(400):
        g = rnd.choice(["a", "b", None, "c"])
        v = None if rnd.random() < 0.05 else Decimal(rnd.randint(-500, 5000)) / 100
        rows.append((g, v, rnd.randint(1, 3)))
    rows.append(("solo", Decimal("7.25"), 1))
    df = spark.createDataFrame(rows, "g string, v decimal(12,2), w long")
    got = {r.g: float(r.m) for r in exact_median(df, ["g"], "v", "w", name="m", bucket_bits=bits).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for g in want:
        assert abs(got[g] - want[g]) < 1e-9, (g, got[g], want[g])


def test_exact_median_unweighted_half_cent(spark):
    df = spark.createDataFrame([("x", Decimal("92692.83")), ("x", Decimal("92692.84"))], "g string, v decimal(12,2)")
    r = exact_median(df, ["g"], "v", name="m").collect()[0]
    assert r.m == Decimal("92692.835")


def test_exact_median_keeps_the_scale_of_its_value(spark):
    df = spark.createDataFrame([("x", Decimal("1.2399")), ("x", Decimal("1.2399"))], "g string, v decimal(12,4)")
    assert exact_median(df, ["g"], "v", name="m").collect()[0].m == Decimal("1.2399")
    with pytest.raises(TypeError):
        exact_median(df.select("g", df.v.cast("double").alias("v")), ["g"], "v")


def test_rows_are_merged_by_value_before_the_shuffle(spark):
    df = spark.createDataFrame([("x", Decimal("1.00"), i) for i in range(10)], "g string, v decimal(12,2), other long")
    plan = plan_text(histogram(df, ["g"], "v"))
    assert "partial_sum" in plan and len(re.findall(r"hashpartitioning\(g#\d+, _u#\d+", plan)) == 1
    # everything else starts from the histogram: no exchange by the group keys below its aggregate
    plan = plan_text(exact_median(df, ["g"], "v", name="m"))
    assert "partial_sum" in plan and "Exchange SinglePartition" not in plan


@pytest.mark.parametrize("seed", [11, 12])
def test_keep_last_matches_brute_force(spark, seed):
    from ledgerline.operators.ranking import keep_last

    rnd = random.Random(seed)
    rows = [(rnd.choice([None, 1, 2, 3]), rnd.choice([None, 10, 20]), rnd.randint(0, 5), rnd.randint(0, 1000), i)
            for i in range(300)]
    df = spark.createDataFrame(rows, "a long, b long, load long, tie long, rid long")
    got = sorted(r.rid for r in keep_last(df, ["a", "b"], ["load", "tie", "rid"]).collect())
    # brute force: drop a row when a later copy with equal, non-NULL keys exists
    want = sorted(
        r[4] for r in rows
        if r[0] is None or r[1] is None
        or not any(o[0] == r[0] and o[1] == r[1] and (o[2], o[3], o[4]) > (r[2], r[3], r[4]) for o in rows)
    )
    assert got == want
