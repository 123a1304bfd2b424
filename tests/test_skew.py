"""A key holding a third of all rows is pre-reduced before it moves."""

import random
import re
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from ledgerline.operators.integrity import cascade_delete, fk_summary
from ledgerline.operators.median import exact_median
from ledgerline.operators.ranking import keep_last, top_per_group
from ledgerline.plans import analyses as an
from tests.conftest import plan_text


def _hot(spark, n=3000):
    rnd = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"k{i % 97}", Decimal(rnd.randint(0, 10**6)) / 100, i) for i in range(n)]
    return spark.createDataFrame(rows, "k string, v decimal(12,2), load long").repartition(8)


def test_top_per_group_limits_before_the_shuffle(spark):
    df = _hot(spark)
    for out in (top_per_group(df, ["k"], [F.col("v").desc(), F.col("load")]), keep_last(df, ["k"], ["load"])):
        plan = plan_text(out)
        # a Partial limit is planned only on the map side of the shuffle
        assert "WindowGroupLimit" in plan and "Exchange" in plan
        assert re.search(r"row_number\(\), \d+, Partial", plan), plan
    assert top_per_group(df, ["k"], [F.col("load").desc()]).filter("k = 'hot'").collect()[0].load == 2997


def test_exact_median_of_a_hot_group(spark):
    df = _hot(spark)
    got = {r.k: float(r.m) for r in exact_median(df, ["k"], "v", name="m", bucket_bits=10).collect()}
    hot = [float(r.v) for r in df.filter("k = 'hot'").collect()]
    assert abs(got["hot"] - float(np.percentile(hot, 50))) < 1e-9


def test_orphan_summary_counts_per_key_first(spark):
    child = spark.createDataFrame([(i, 1 if i % 3 == 0 else 1000 + i % 5) for i in range(900)], "id long, fk long")
    parent = spark.createDataFrame([(1,)], "pk long")
    r = fk_summary(child, "fk", parent, "pk", "child.fk").collect()[0]
    assert (r.orphan_rows, r.missing_keys) == (600, 5)
    assert "partial_count" in plan_text(fk_summary(child, "fk", parent, "pk", "x"))


def _commerce(spark, n=3000):
    """One order and one seller hold a third of all items each."""
    items = [(0 if i % 3 == 0 else i, i, i % 40, 0 if i % 3 == 1 else i % 50, Decimal(i % 500) / 4) for i in range(n)]
    items = spark.createDataFrame(items, "order_id long, order_item_id int, product_id long, seller_id long, price decimal(12,2)")
    products = spark.createDataFrame([(k, f"cat{k % 5}") for k in range(40)], "product_id long, product_category_name string")
    sellers = spark.createDataFrame([(k, f"c{k % 7}", f"s{k % 2}") for k in range(50)], "seller_id long, seller_city string, seller_state string")
    return items.repartition(8), products, sellers


def test_a_hot_order_is_reduced_before_the_shuffle(spark):
    items, products, _ = _commerce(spark)
    out = an.item_categories(items, products)
    plan = plan_text(out)
    # nodes are listed from the scans up: the partial count comes first
    assert plan.index("partial_count") < plan.index("hashpartitioning(order_id")
    hot = {r.product_category_name: r._n_items for r in out.filter("order_id = 0").collect()}
    assert sum(hot.values()) == 1000 and len(hot) == 5


def test_a_hot_seller_is_spread_over_its_orders(spark):
    items, products, sellers = _commerce(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for build in (an.seller_top_category, an.seller_top_category_known):
            plan = plan_text(build(sellers, items, products, -1))
            assert re.search(r"hashpartitioning\(seller_id#\d+L, order_id#\d+L", plan)
            assert "BroadcastHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cascade_spreads_rows_without_a_reference(spark):
    child = spark.createDataFrame([(i, None if i % 3 else i % 7) for i in range(900)], "id long, fk long")
    parent = spark.createDataFrame([(1,), (1,), (2,)], "pk long")
    got = sorted(r.id for r in cascade_delete(child, "fk", parent, "pk").collect())
    assert got == [i for i in range(900) if i % 3 or i % 7 in (1, 2)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan_text(cascade_delete(child, "fk", parent, "pk")))
        assert any("fk#" in x and "_deal#" in x for x in dealt) and not any("fk#" in x and "_deal#" not in x for x in dealt)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
