"""Medians of doubles against sorting, and the order of their bits."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.median import exact_median, ordered_bits

INF, NAN = float("inf"), float("nan")
SPECIAL = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, INF, -INF, 1.0, -1.0, 2.0, 1.9999999999999998, 4503599627370497.5]


def middle(vs):
    vs = sorted((0.0 if v == 0 else v for v in vs), key=lambda v: (math.isnan(v), v if not math.isnan(v) else 0.0))
    a, b = vs[(len(vs) - 1) // 2], vs[len(vs) // 2]
    return a if a == b or (math.isnan(a) and math.isnan(b)) else a + (b / 2 - a / 2)


def same(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == b


def test_bits_are_those_of_the_double(spark):
    rng = random.Random(1)
    vs = SPECIAL + [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(4000)] + [2.0**e for e in range(-1074, 1024)] + [3 * 2.0**e for e in range(-1073, 1022, 7)]
    df = spark.createDataFrame([(v,) for v in vs], "v double")
    for v, bits in df.select("v", ordered_bits(F.col("v"))).collect():
        if math.isnan(v):
            assert bits == (2047 << 52) + 1
        else:
            size = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
            assert bits == (-size if v < 0 else size), v


@pytest.mark.parametrize("seed", range(3))
def test_medians_match_sorting(spark, seed):
    rng = random.Random(seed)
    pick = [lambda: rng.gauss(0, 1), lambda: rng.choice(SPECIAL), lambda: rng.lognormvariate(0, 50), lambda: 1.0 + rng.random() * 1e-12, lambda: rng.choice([None, NAN, 1.5])]
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice(pick)(), rng.randrange(1, 4), "x") for _ in range(600)] + [("one", 2.5, 1, "x"), ("null", None, 1, "x"), ("far", -INF, 1, "x"), ("far", INF, 1, "x")]
    df = spark.createDataFrame(rows, "g string, v double, w int, median string")
    for weight in (None, "w"):
        got = {r.g: r.m for r in exact_median(df, ["g"], "v", weight, "m").collect()}
        want = {}
        for g, v, w, _ in rows:
            if v is not None:
                want.setdefault(g, []).extend([v] * (w if weight else 1))
        assert got.keys() == want.keys() and "null" not in got
        assert all(same(got[g], middle(vs)) for g, vs in want.items()), (got, {g: middle(v) for g, v in want.items()})


def test_floats_whole_numbers_and_empty_tables(spark):
    f = spark.createDataFrame([(0.1,), (0.3,), (0.2,)], "v float")
    assert abs(exact_median(f, [], "v", name="m").first().m - 0.2) < 1e-7
    whole = spark.createDataFrame([("a", 2), ("a", 5), ("b", 2**62), ("b", 2**62 + 2)], "g string, v long")
    assert {r.g: float(r.m) for r in exact_median(whole, ["g"], "v", name="m").collect()} == {"a": 3.5, "b": float(2**62 + 1)}
    assert exact_median(f.limit(0), ["v"], "v").collect() == []
    with pytest.raises(TypeError):
        exact_median(spark.createDataFrame([("x",)], "v string"), [], "v")
