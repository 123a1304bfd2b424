"""Hand-made edge rows (FIXTURES.md section D)."""

import datetime as dt
import statistics
from decimal import Decimal

import pytest
from pyspark.errors import ArithmeticException, DateTimeException, SparkRuntimeException
from pyspark.sql import functions as F

from ledgerline.functions.scalars import blank_to_null, mean, round2
from ledgerline.operators import cleaning as cl
from ledgerline.operators import integrity as ig
from ledgerline.operators.joins import orphans, semi_by_tuple
from ledgerline.operators.ranking import keep_last
from ledgerline.plans import analyses as an

ITEMS = "order_id long, order_item_id int, product_id long, seller_id long, price decimal(12,2)"
SELLERS = "seller_id long, seller_city string, seller_state string"
PRODUCTS = "product_id long, product_category_name string"
ORDERS = "order_id long, customer_id long, order_status string, order_purchase_timestamp timestamp_ntz"
CUSTOMERS = "customer_id long, customer_unique_id long"


def d(x):
    return None if x is None else Decimal(str(x))


def test_keep_last_null_keys_and_three_copies(spark):
    df = spark.createDataFrame(
        [(None, 1), (None, 2), (7, 1), (7, 2), (7, 3), (8, 5)], "k long, load int")
    out = sorted(keep_last(df, ["k"], ["load"]).collect(), key=lambda r: (r.k or -1, r.load))
    assert [(r.k, r.load) for r in out] == [(None, 1), (None, 2), (7, 3), (8, 5)]


def test_keep_last_is_idempotent_and_keys_hold(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 1, 11), (1, 2, 5), (2, 1, 1)], "a long, b long, load int")
    once = keep_last(df, ["a", "b"], ["load"])
    twice = keep_last(once, ["a", "b"], ["load"])
    assert sorted(once.collect()) == sorted(twice.collect())
    assert ig.key_violations(once, ["a", "b"]).count() == 0


def test_grouping_flag_tells_real_null_from_subtotal(spark):
    rows = [(1, None, "A", d(10)), (2, "a", "A", d(20))]
    df = spark.createDataFrame(rows, "order_id long, product_category_name string, payment_type string, payment_value decimal(12,2)")
    out = df.groupingSets([["product_category_name", "payment_type"], ["payment_type"]],
                          "product_category_name", "payment_type").agg(
        F.grouping("product_category_name").cast("int").alias("g"), F.sum("payment_value").alias("s"))
    got = {(r.product_category_name, r.g): r.s for r in out.collect()}
    assert got[(None, 0)] == Decimal("10.00")
    assert got[(None, 1)] == Decimal("30.00")


def test_stddev_of_one_row_is_null_and_fails_cv_limit(spark):
    items = spark.createDataFrame([(1, 1, 1, 1, d(5))], ITEMS)
    sellers = spark.createDataFrame([(1, "c", "s")], SELLERS)
    assert an.volatile_seller_regions(sellers, items, 0, 0, 0).count() == 0


def test_zero_mean_price_raises_in_strict_mode(spark):
    items = spark.createDataFrame([(1, 1, 1, 1, d(0)), (2, 1, 1, 1, d(0))], ITEMS)
    with pytest.raises((ArithmeticException, SparkRuntimeException)):
        items.groupBy("seller_id").agg((F.stddev_samp("price") / F.avg("price")).alias("cv")).collect()


def test_tuple_in_with_null_never_matches(spark):
    left = spark.createDataFrame([(2, None), (3, "x")], "a long, b string")
    right = spark.createDataFrame([(2, None), (3, "x")], "a long, b string")
    assert [(r.a, r.b) for r in semi_by_tuple(left, right, ["a", "b"]).collect()] == [(3, "x")]


def _ltv_inputs(spark, orders, items):
    customers = spark.createDataFrame([(10, 1), (11, 1)], CUSTOMERS)
    products = spark.createDataFrame([(100, "cat_a"), (101, "cat_b"), (102, None)], PRODUCTS)
    return customers, spark.createDataFrame(orders, ORDERS), spark.createDataFrame(items, ITEMS), products


def test_latest_order_null_timestamp_ranks_first(spark):
    orders = [(1, 10, "delivered", None), (2, 11, "delivered", dt.datetime(2020, 1, 1))]
    items = [(1, 1, 100, 1, d(5)), (2, 1, 101, 1, d(7))]
    out = an.customer_ltv_latest_order(*_ltv_inputs(spark, orders, items)).collect()
    assert out[0].latest_order_id == 1 and out[0].latest_order_date is None


def test_dearest_item_null_price_ranks_first(spark):
    orders = [(1, 10, "delivered", dt.datetime(2020, 1, 1)), (2, 10, "shipped", dt.datetime(2019, 1, 1))]
    items = [(1, 1, 100, 1, None), (1, 2, 101, 1, d(5))]
    out = an.customer_ltv_latest_order(*_ltv_inputs(spark, orders, items)).collect()
    assert out[0].latest_order_top_category == "cat_a"


def test_person_without_delivered_order(spark):
    orders = [(1, 10, "O", dt.datetime(2020, 1, 1)), (2, 11, "O", dt.datetime(2020, 2, 1))]
    items = [(1, 1, 100, 1, d(5))]
    r = an.customer_ltv_latest_order(*_ltv_inputs(spark, orders, items)).collect()[0]
    assert (r.latest_order_id, r.latest_order_date, r.latest_order_amount, r.latest_order_top_category) == (
        None, None, 0.0, "Uncategorized")


def test_ltv_segment_limits(spark):
    labels = []
    for v in (500.00, 500.01, 200.00, 199.99):
        orders = [(1, 10, "delivered", dt.datetime(2020, 1, 1)), (2, 11, "delivered", dt.datetime(2020, 1, 2))]
        items = [(1, 1, 100, 1, d(v))]
        labels.append(an.customer_ltv_latest_order(*_ltv_inputs(spark, orders, items)).collect()[0].customer_segment)
    assert labels == ["High Value", "VIP", "High Value", "Standard"]


def test_half_cent_median_rounds_up(spark):
    df = spark.createDataFrame([(d("92692.83"),), (d("92692.84"),)], "v decimal(12,2)")
    got = df.agg(round2(F.percentile("v", F.lit(0.5))).alias("m")).collect()[0].m
    assert got == 92692.84


def test_round2_rounds_once(spark):
    df = spark.createDataFrame([(12.3449999, 0.0049999, 12.345, None)], "a double, b double, c double, d double")
    assert tuple(df.select(*[round2(c).alias(c) for c in "abcd"]).collect()[0]) == (12.34, 0.0, 12.35, None)


def test_mean_of_money_is_rounded_once(spark):
    # 12.345 - 1/30000000 after division: six decimals would read 12.345000
    df = spark.createDataFrame([(d("37034999.90"), 3000000)], "s decimal(22,2), n long")
    assert df.select(round2(mean("s", "n")).alias("m")).collect()[0].m == 12.34
    assert df.select(mean("s", F.lit(0)).alias("m")).collect()[0].m is None


def test_equal_prices_have_no_dispersion(spark):
    """Sellers whose prices are all equal: variance exactly 0, never NaN."""
    prices = ["599.49", "0.10", "33.33", "89999.99", "0.01", "1234.57"]
    sellers, items, pays, order = [], [], [], 0
    for s, (n, price) in enumerate((n, p) for n in range(2, 12) for p in prices):
        sellers.append((s, f"c{s}", f"s{s}"))
        for k in range(n):
            order += 1
            items += [(order, i, 1, s, d(price)) for i in range(1 + k % 2)]
            pays += [(order, i, "A", d(1)) for i in range(1 + k % 3)]
    frames = (
        spark.createDataFrame(sellers, SELLERS), spark.createDataFrame(items, ITEMS),
        spark.createDataFrame(pays, "order_id long, payment_sequential int, payment_type string, payment_value decimal(12,2)"),
    )
    assert an.seller_price_dispersion(*frames, 0, 0, 50).count() == 0
    out = an.seller_price_dispersion(*frames, 0, 0, -1).collect()
    assert len(out) == 2 * len(sellers)
    assert {(r.price_variance, r.cv) for r in out} == {(0.0, 0.0)}


def test_dispersion_of_fanned_rows(spark):
    """Against the definition: every item once per payment of its order."""
    sellers = spark.createDataFrame([(1, "c", "s"), (2, "d", "s")], SELLERS)
    rows = [(1, 1, 5), (1, 1, 7), (2, 1, 100), (3, 2, 1), (3, 2, None), (4, 2, 9)]
    items = spark.createDataFrame([(o, i, 1, s, d(p)) for i, (o, s, p) in enumerate(rows)], ITEMS)
    payments_of = {1: 3, 2: 1, 3: 2, 4: 2}
    pays = spark.createDataFrame(
        [(o, i, "A", d(1)) for o, m in payments_of.items() for i in range(m)],
        "order_id long, payment_sequential int, payment_type string, payment_value decimal(12,2)")
    got = {(r.seller_city, r.is_state_summary): r for r in an.seller_price_dispersion(sellers, items, pays, 0, 0, -1).collect()}
    for key, mine in (("c", {1}), ("d", {2}), (None, {1, 2})):
        fanned = [p for o, s, p in rows if s in mine and p is not None for _ in range(payments_of[o])]
        r = got[(key, int(key is None))]
        assert r.total_revenue == sum(fanned) and r.sellers_count == len(mine)
        assert abs(r.price_variance - statistics.variance(fanned)) < 0.006
        assert abs(r.cv - statistics.stdev(fanned) / statistics.mean(fanned) * 100) < 0.006


def test_blank_to_null(spark):
    df = spark.createDataFrame([("",), ("   ",), ("\t",), ("x",)], "c string")
    assert [r.c for r in df.select(blank_to_null("c").alias("c")).collect()] == [None, None, "\t", "x"]


def test_null_reference_passes_check_and_cascade(spark):
    child = spark.createDataFrame([(1, None), (2, 5), (3, 6)], "id long, fk long")
    parent = spark.createDataFrame([(5,)], "pk long")
    assert [r.id for r in orphans(child, "fk", parent, "pk").collect()] == [3]
    assert sorted(r.id for r in ig.cascade_delete(child, "fk", parent, "pk").collect()) == [1, 2]


def test_insert_twice_keeps_first_and_is_idempotent(spark):
    base = spark.createDataFrame([("a", "A")], "k string, v string")
    new = spark.createDataFrame([("b", "B1"), ("b", "B2"), ("a", "other")], "k string, v string")
    once = cl.insert_if_absent(base, new, ["k"])
    assert sorted(once.collect()) == [("a", "A"), ("b", "B1")]
    twice = cl.insert_if_absent(once, new, ["k"])
    assert sorted(twice.collect()) == sorted(once.collect())


def test_strict_timestamp_cast_fails_and_quarantine_splits(spark):
    raw = spark.createDataFrame([(1, "2020-01-01 10:00:00"), (2, "not a date"), (3, ""), (4, None)], "id long, ts string")
    with pytest.raises(DateTimeException):
        cl.cast_timestamps(raw, ["ts"]).collect()
    clean, bad = cl.quarantine_timestamps(raw, ["ts"])
    assert sorted(r.id for r in clean.collect()) == [1, 4]
    assert sorted(r.id for r in bad.collect()) == [2, 3]


def test_restrict_reports_blockers(spark):
    to_delete = spark.createDataFrame([(1,), (2,)], "customer_id long")
    orders = spark.createDataFrame([(10, 1), (11, 1)], "order_id long, customer_id long")
    got = ig.restrict_blockers(to_delete, "customer_id", orders, "customer_id").collect()
    assert [(r.customer_id, r.blocking_rows) for r in got] == [(1, 2)]


def test_set_null_and_rename(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, fk string")
    deleted = spark.createDataFrame([("a",)], "pk string")
    out = sorted(ig.set_null_on_delete(child, "fk", deleted, "pk").collect(), key=lambda r: r.id)
    assert [r.fk for r in out] == [None, "b", None]
    mapping = spark.createDataFrame([("b", "z")], "old_key string, new_key string")
    out = sorted(ig.rename_references(child, "fk", mapping).collect(), key=lambda r: r.id)
    assert [r.fk for r in out] == ["a", "z", None]


def test_ties_are_broken_the_stated_way(spark):
    items = spark.createDataFrame([(1, 1, 100, 1, d(5)), (1, 2, 101, 1, d(5))], ITEMS)
    products = spark.createDataFrame([(100, "zeta"), (101, "alpha")], PRODUCTS)
    r = an.order_facts(items, products).collect()[0]
    assert r.top_category == "alpha"
