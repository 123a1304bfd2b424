"""Dependent joins as the caller writes them, against loops over the rows."""

import random

from pyspark.sql import functions as F

from ledgerline.operators.joins import correlation_removed, lateral_top, scalar_top
from ledgerline.plans import operator_queries as oq
from tests.conftest import SF001, plan_text


def tables(spark):
    rng = random.Random(2)
    outer = [(k, rng.choice([1, 2, 3, None])) for k in [None, *range(12)]]
    inner = [(rng.choice([None, *range(9)]), rng.choice([None, *range(5)]), i) for i in range(80)]
    return outer, inner, spark.createDataFrame(outer, "k long, x long"), spark.createDataFrame(inner, "f long, v long, i long")


def first(inner, k, n):
    own = [r for r in inner if r[0] is not None and r[0] == k]
    return sorted(own, key=lambda r: (r[1] is not None, -(r[1] or 0), r[2]))[:n]


def test_top_rows_per_outer_row(spark):
    outer, inner, o, i = tables(spark)
    dependent = i.where(F.col("f") == F.col("k").outer())
    order = [F.col("v").desc_nulls_first(), F.col("i").asc()]
    for n in (1, 3):
        got = lateral_top(o, dependent, order, n)
        assert correlation_removed(plan_text(got))
        want = [(k, x, *r) for k, x in outer for r in first(inner, k, n) or [(None, None, None)]]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
        assert lateral_top(o, dependent, order, n, how="inner").count() == sum(len(first(inner, k, n)) for k, _ in outer)


def test_scalar_top(spark):
    outer, inner, o, i = tables(spark)
    top = scalar_top(i.where(F.col("f") == F.col("k").outer()), "i", [F.col("v").desc_nulls_first(), F.col("i").asc()])
    got = o.select("k", top.alias("t"))
    assert correlation_removed(plan_text(got))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((k, (first(inner, k, 1) or [(0, 0, None)])[0][2])) for k, _ in outer)


def test_queries_join_by_keys(spark):
    assert correlation_removed(plan_text(oq.j6_lateral_api(spark, SF001))) and correlation_removed(plan_text(oq.j7_scalar_api(spark, SF001)))
