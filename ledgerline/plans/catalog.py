"""Registry of every implemented query: Spark builder + oracle SQL.

Thresholds are the fixture constants of FIXTURES.md section C: with the
reference's own constants every group passes on this data, so the HAVING
clauses would not be exercised.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.plans import analyses as an
from ledgerline.plans import oracle as sql
from ledgerline.sources.tables import DELIVERED_STATUS, LazyTables, commerce_tables

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Builder
    oracle: str | None


# Fixture thresholds (FIXTURES.md section C, sf0.01).
Q1_MIN_REVENUE = 100_000_000
Q2_MIN_TOTAL, Q2_MIN_ORDERS = 250_000_000, 1_800
X_MIN_TOTAL, X_MIN_ORDERS = 195_000_000, 900
Q3L_LIMITS = (200_000_000, 1_000, 56.5)
Q3O_LIMITS = (30_000_000, 500, 56.5)
Q4_MIN_ORDERS, Q4_VIP, Q4_HIGH = 1, 6_000_000, 4_000_000
Q4 = (Q4_MIN_ORDERS, Q4_VIP, Q4_HIGH, DELIVERED_STATUS)
Q5_MIN_REVENUE = 31_000_000


def _analyses() -> dict[str, Entry]:
    def on(analysis: Callable[[LazyTables], DataFrame], oracle: str) -> Entry:
        return Entry(lambda spark, sf_dir: analysis(commerce_tables(spark, sf_dir)), oracle)

    def category_payments(analysis, *limits) -> Callable[[LazyTables], DataFrame]:
        return lambda t: analysis(t.order_items, t.payments, t.products, *limits)

    def lifetime_value(analysis) -> Callable[[LazyTables], DataFrame]:
        return lambda t: analysis(t.customers, t.orders, t.order_items, t.products, *Q4)

    q2, x = (Q2_MIN_TOTAL, Q2_MIN_ORDERS), (X_MIN_TOTAL, X_MIN_ORDERS)
    return {
        "q1_rollup": on(lambda t: an.seller_sales_rollup(t.sellers, t.order_items, Q1_MIN_REVENUE), sql.q1_rollup(Q1_MIN_REVENUE)),
        "q1_rollup_by_order": on(
            lambda t: an.seller_sales_rollup_by_order(t.sellers, t.order_items, Q1_MIN_REVENUE), sql.q1_rollup_by_order(Q1_MIN_REVENUE)),
        "q2_sets": on(category_payments(an.category_payment_sets, *q2), sql.q2_sets(*q2)),
        "q2_sets_by_order": on(category_payments(an.category_payment_sets_by_order, *q2), sql.q2_sets_by_order(*q2)),
        "x1_union_filtered": on(category_payments(an.category_payment_union_filtered, *x), sql.x1_union_filtered(*x)),
        "x2_union": on(category_payments(an.category_payment_union, *x), sql.x2_union(*x)),
        "q3_dispersion": on(
            lambda t: an.seller_price_dispersion(t.sellers, t.order_items, t.payments, *Q3L_LIMITS), sql.q3_dispersion(*Q3L_LIMITS)),
        "q3_volatile_regions": on(lambda t: an.volatile_seller_regions(t.sellers, t.order_items, *Q3O_LIMITS), sql.q3_volatile_regions(*Q3O_LIMITS)),
        "q4_ltv_latest": on(lifetime_value(an.customer_ltv_latest_order), sql.q4_ltv_latest(*Q4)),
        "q4_ltv_first_id": on(lifetime_value(an.customer_ltv_first_id_order), sql.q4_ltv_first_id(*Q4)),
        "q5_top_category": on(lambda t: an.seller_top_category(t.sellers, t.order_items, t.products, Q5_MIN_REVENUE), sql.q5_top_category(Q5_MIN_REVENUE)),
        "q5_top_category_known": on(
            lambda t: an.seller_top_category_known(t.sellers, t.order_items, t.products, Q5_MIN_REVENUE), sql.q5_top_category_known(Q5_MIN_REVENUE)),
    }


def _operators() -> dict[str, Entry]:
    from ledgerline.plans import operator_queries as oq

    sqls = sql.operator_sql()
    return {name: Entry(fn, sqls.get(name)) for name, fn in oq.BUILDERS.items()}


def registry() -> dict[str, Entry]:
    reg: dict[str, Entry] = {}
    reg.update(_analyses())
    reg.update(_operators())
    return reg


# The analyses timed by bench.py.
HEADLINE = [
    "q1_rollup", "q1_rollup_by_order", "q2_sets", "q2_sets_by_order",
    "q3_dispersion", "q3_volatile_regions", "q4_ltv_latest", "q4_ltv_first_id",
    "q5_top_category", "q5_top_category_known", "x1_union_filtered", "x2_union",
]
