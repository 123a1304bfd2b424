"""Sources and sinks (S1, S7, S8) and the cleanup run."""

import dataclasses
import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerline.plans.cleanup import materialize_to, run_cleanup
from ledgerline.plans.operator_queries import LOAD_ORDER
from ledgerline.sources import io
from ledgerline.sources.tables import raw_tables
from tests.conftest import SF001, plan_text


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="ll-test-")


def test_csv_roundtrip_with_declared_schema(spark, scratch):
    raw = raw_tables(spark, SF001).orders
    path = os.path.join(scratch, "orders_csv")
    io.write_csv(raw, path)
    back = io.read_raw_csv(spark, path, "orders")
    assert back.schema == raw.schema
    assert back.count() == raw.count()
    assert back.exceptAll(raw).count() == 0


def test_csv_failfast_rejects_bad_number(spark, scratch):
    path = os.path.join(scratch, "bad_csv")
    os.makedirs(path)
    with open(os.path.join(path, "p.csv"), "w") as f:
        f.write("product_id,product_category_name\n1,a\nx,b\n")
    with pytest.raises(Exception):
        io.read_raw_csv(spark, path, "products").collect()
    assert io.read_raw_csv(spark, path, "products", mode="PERMISSIVE").filter("product_id IS NULL").count() == 1


def test_write_version_never_overwrites(spark, scratch):
    df = spark.range(5)
    p = io.write_version(df, os.path.join(scratch, "v1"))
    with pytest.raises(Exception):
        io.write_version(df, p)
    assert spark.read.parquet(p).count() == 5


def test_range_layout_sorted_files(spark, scratch):
    items = raw_tables(spark, SF001).order_items
    p = io.write_range_layout(items, os.path.join(scratch, "items_by_seller"), "seller_id", 4)
    back = spark.read.parquet(p)
    assert back.count() == items.count()
    ranges = sorted(
        (r.lo, r.hi)
        for r in back.groupBy(F.input_file_name().alias("f")).agg(F.min("seller_id").alias("lo"), F.max("seller_id").alias("hi")).collect()
    )
    assert len(ranges) >= 2
    # each file holds its own key range, so min/max statistics prune files
    assert all(a_hi < b_lo for (_, a_hi), (b_lo, _) in zip(ranges, ranges[1:]))


def test_cleanup_strict_and_lenient(spark, scratch):
    raw = raw_tables(spark, SF001)
    res = run_cleanup(raw, strict_types=True, load_order=LOAD_ORDER)
    assert dict(res.tables["orders"].dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    report = {r.table_name: r.violations for r in res.key_report.collect()}
    assert all(v == 0 for v in report.values()), report
    refs = {r.relation: r.orphan_rows for r in res.reference_report.collect()}
    assert refs["reviews.order_id -> orders.order_id"] > 0
    assert [r.product_category_name for r in res.missing_categories.collect()] != []

    bad = raw_tables(spark, SF001, defects=True)
    res2 = run_cleanup(bad, strict_types=False, load_order=LOAD_ORDER, drop_orphans=True)
    assert res2.rejected_orders.count() > 0
    assert res2.tables["orders"].count() + res2.rejected_orders.count() == bad.orders.count()
    out = materialize_to(res2, scratch, "v1")
    assert out["reviews"].join(out["orders"], "order_id", "left_anti").count() == 0


def test_bucketed_tables_join_without_exchange(spark, scratch):
    from ledgerline.sources.tables import commerce_tables

    t = commerce_tables(spark, SF001)
    io.write_bucketed(t.order_items, "ll_items_b", os.path.join(scratch, "items_b"), "order_id", 8)
    io.write_bucketed(t.orders, "ll_orders_b", os.path.join(scratch, "orders_b"), "order_id", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("ll_items_b").join(spark.table("ll_orders_b"), "order_id")
        plan = plan_text(j)
        assert j.count() == t.order_items.join(t.orders, "order_id").count()
        assert "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS ll_items_b")
        spark.sql("DROP TABLE IF EXISTS ll_orders_b")


def test_cleanup_asks_for_a_load_order(spark):
    with pytest.raises(ValueError, match="load order"):
        run_cleanup(raw_tables(spark, SF001))


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_keep_last_by_stored_order(spark, scratch, kind):
    """The copy stored last is kept, though it is not the greatest."""
    path = os.path.join(scratch, "reviews")
    rows = spark.createDataFrame([(1, 9), (2, 5), (1, 3), (2, 4), (None, 7), (None, 7)], "review_id long, order_id long").coalesce(1)
    if kind == "parquet":
        rows.write.parquet(path)
        stored = io.with_stored_order(spark.read.parquet(path))
    else:
        io.write_csv(rows, path)
        stored = io.with_stored_order(io.read_raw_csv(spark, path, "reviews"))
    raw = dataclasses.replace(raw_tables(spark, SF001), reviews=stored)
    res = run_cleanup(raw, load_order={k: v for k, v in LOAD_ORDER.items() if k != "reviews"})
    out = res.tables["reviews"]
    assert out.columns == ["review_id", "order_id"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 3), (2, 4), (None, 7), (None, 7)], key=str)


def test_cleanup_reads_each_table_once(spark):
    res = run_cleanup(raw_tables(spark, SF001), load_order=LOAD_ORDER, drop_orphans=True)
    locations = re.findall(r"Location: InMemoryFileIndex \[([^\]]*)\]", plan_text(res.tables["order_items"]))
    assert sum("lineitem" in x for x in locations) == 1


def test_profile_covers_every_raw_table(spark):
    from ledgerline.plans.cleanup import quality_profile
    from ledgerline.sources.schemas import RAW

    rows = {(r.table_name, r.check_name, r.column_name): r.n_bad for r in quality_profile(raw_tables(spark, SF001, defects=True)).collect()}
    assert {k[0] for k in rows} == set(RAW)
    assert rows["products", "blank_text", "product_category_name"] > 0
    assert rows["orders", "unparsable_timestamp", "order_purchase_timestamp"] > 0
    assert ("translation", "key_violations", "product_category_name") in rows
