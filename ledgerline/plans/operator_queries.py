"""

Each builder takes (spark, sf_dir) and returns an unevaluated DataFrame. Money
leaves as double (exact decimal first), flags as int, counts as bigint, so
the results compare value for value with the oracle SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.scalars import MONEY, flag, mean, money_out, round2, segment_label
from ledgerline.operators import cleaning as cl
from ledgerline.operators import integrity as ig
from ledgerline.operators.joins import lateral_top, missing_references, orphans, scalar_top
from ledgerline.operators.median import exact_median
from ledgerline.operators.ranking import keep_last, top_per_group
from ledgerline.operators.reference_graph import Change, apply_change
from ledgerline.plans import analyses as an
from ledgerline.plans.analyses import CAT, CITY, PAY, PERSON, STATE, TS
from ledgerline.plans.cleanup import CleanResult, quality_profile, run_cleanup
from ledgerline.sources import tables as tb
from ledgerline.session import scratch_path
from ledgerline.sources.io import materialize
from ledgerline.sources.lookup import lookup, write_lookup_layout
from ledgerline.sources.ordered import read_page, with_positions, write_in_order
from ledgerline.sources.rejects import CsvLoad, load_csv
from ledgerline.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS, TEXT_TIMESTAMPS

Tables = tb.Tables

# Fixed values of the operator queries (chosen rows to act on, labels).
DELETED_ORDER_STATUS = "P"            # d6: orders removed, children follow
RESTRICTED_SEGMENT = "AUTOMOBILE"     # d7: customers asked to be removed
RENAMED_SEGMENT = "BUILDING"          # d9: customers that get a new id
RENAME_OFFSET = 1_000_000_000         # d9: new id = old id + offset
DELETED_TRANSLATIONS = ("Brand#1", "Brand#2")  # d8: translations removed
DELETED_CATEGORY = "Brand#3"          # d6_d9: products removed, their items follow
GRAPH_COLUMNS = {                     # d6_d9: what is shown of each table
    "customers": ["customer_id", None, None, None],
    "orders": ["order_id", "customer_id", None, None],
    "order_items": ["order_id", "order_item_id", "product_id", "seller_id"],
    "payments": ["order_id", "payment_sequential", None, None],
    "reviews": ["review_id", "order_id", None, None],
    "sellers": ["seller_id", None, None, None],
    "products": ["product_id", "product_category_name", None, None],
    "translation": ["product_category_name", None, None, None],
}
NEW_TRANSLATION_PREFIX = "brand_no_"  # d12: English name of inserted rows
# s8: what is looked up in the laid-out items, column by column
LOOKUP_CUSTOMERS, LOOKUP_PRODUCTS, LOOKUP_SELLERS = (1, 7, 42), (3, 55, 101), (2, 9)
LOOKUP_FROM, LOOKUP_BEFORE = "1995-03-01", "1995-04-01"
LOOKUP_CATEGORY = "Brand#11"
PAGE_FIRST, PAGE_LAST, PAGE_BLOCK = 1_001, 2_500, 1_000  # s9: a page and the rows of a folder
# d5, d14: the columns that stand for the load time of the fixture's tables
LOAD_ORDER = {
    "customers": ["customer_unique_id"],
    "order_items": ["product_id", "seller_id", "price"],
    "payments": ["payment_type", "payment_value"],
    "reviews": ["order_id"],
    "translation": ["product_category_name_english"],
}


def _t(spark: SparkSession, d: str) -> Tables:
    return tb.commerce_tables(spark, d)


def _raw(spark: SparkSession, d: str, defects: bool = False) -> Tables:
    return tb.raw_tables(spark, d, defects)


def _items_out(df: DataFrame) -> DataFrame:
    return df.withColumn("price", money_out("price"))


def cleaned_products(spark: SparkSession, d: str) -> DataFrame:
    return cl.blank_category_to_null(_raw(spark, d).products)


# ---------------------------------------------------------------------------
# Cleaning
# ---------------------------------------------------------------------------

def d1_text_to_ts(spark: SparkSession, d: str) -> DataFrame:
    return cl.cast_timestamps(_raw(spark, d).orders, TEXT_TIMESTAMPS)


def d1_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return cl.unparsable_cells(_raw(spark, d, defects=True).orders, "order_id", TEXT_TIMESTAMPS)


def d5_dedupe_items(spark: SparkSession, d: str) -> DataFrame:
    items = tb.order_items_loaded(spark, d)
    kept = keep_last(items, PRIMARY_KEYS["order_items"], ["loaded_at", "product_id", "seller_id", "price"])
    return _items_out(kept)


def d5_dedupe_reviews(spark: SparkSession, d: str) -> DataFrame:
    return keep_last(_raw(spark, d).reviews, PRIMARY_KEYS["reviews"], ["order_id"])


def d10_blank_to_null(spark: SparkSession, d: str) -> DataFrame:
    return cleaned_products(spark, d)


def new_translations(spark: SparkSession, d: str) -> DataFrame:
    """Translation rows for every category the products use (rule-named)."""
    cats = cleaned_products(spark, d).select(CAT).filter(F.col(CAT).isNotNull()).distinct()
    english = F.lower(F.regexp_replace(F.col(CAT), "Brand#", NEW_TRANSLATION_PREFIX))
    return cats.select(CAT, english.alias("product_category_name_english"))


def d12_insert_absent(spark: SparkSession, d: str) -> DataFrame:
    base = _t(spark, d).translation
    return cl.insert_if_absent(base, new_translations(spark, d), [CAT])


def d13_profile(spark: SparkSession, d: str) -> DataFrame:
    """One row per check over the raw layer (with timestamp defects)."""
    return quality_profile(_raw(spark, d, defects=True))


# ---------------------------------------------------------------------------
# Integrity
# ---------------------------------------------------------------------------

SINGLE_KEY_TABLES = ("orders", "customers", "sellers", "products", "reviews", "translation")
COMPOSITE_KEY_TABLES = ("order_items", "payments")


def d2_pk_single(spark: SparkSession, d: str) -> DataFrame:
    r = _raw(spark, d)
    frames = []
    for name in SINGLE_KEY_TABLES:
        df = cleaned_products(spark, d) if name == "products" else getattr(r, name)
        (k,) = PRIMARY_KEYS[name]
        v = ig.key_violations(df.select(k), [k])
        frames.append(v.select(F.lit(name).alias("table_name"), F.col(k).cast("string").alias("key_value"), "n_rows", "problem"))
    return ig.union_all(frames)


def d3_pk_composite(spark: SparkSession, d: str) -> DataFrame:
    r = _raw(spark, d)
    frames = []
    for name in COMPOSITE_KEY_TABLES:
        k1, k2 = PRIMARY_KEYS[name]
        v = ig.key_violations(getattr(r, name).select(k1, k2), [k1, k2])
        frames.append(v.select(
            F.lit(name).alias("table_name"), F.col(k1).cast("bigint").alias("key_1"),
            F.col(k2).cast("bigint").alias("key_2"), "n_rows", "problem"))
    return ig.union_all(frames)


def d4_fk_orphans(spark: SparkSession, d: str) -> DataFrame:
    r = _raw(spark, d)
    products = cleaned_products(spark, d)
    parents = {"orders": r.orders, "products": products, "sellers": r.sellers, "customers": r.customers,
               "translation": r.translation}
    children = {"order_items": r.order_items, "payments": r.payments, "reviews": r.reviews, "orders": r.orders,
                "products": products}
    frames = [
        ig.fk_summary(children[child], fk, parents[parent], pk, f"{child}.{fk} -> {parent}.{pk}")
        for child, fk, parent, pk, _ in FOREIGN_KEYS
    ]
    return ig.union_all(frames)


def d6_cascade(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    surviving = t.orders.filter(F.col("order_status") != F.lit(DELETED_ORDER_STATUS))
    return _items_out(ig.cascade_delete(t.order_items, "order_id", surviving, "order_id"))


def d7_restrict(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    to_delete = tb.customer_segments(spark, d).filter(F.col("segment") == F.lit(RESTRICTED_SEGMENT))
    return ig.restrict_blockers(to_delete, "customer_id", t.orders, "customer_id")


def d8_set_null(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    deleted = t.translation.filter(F.col(CAT).isin(*DELETED_TRANSLATIONS))
    return ig.set_null_on_delete(t.products, CAT, deleted, CAT)


def d9_rename(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    mapping = tb.customer_segments(spark, d).filter(F.col("segment") == F.lit(RENAMED_SEGMENT)).select(
        F.col("customer_id").alias("old_key"), (F.col("customer_id") + F.lit(RENAME_OFFSET)).alias("new_key"))
    return ig.rename_references(t.orders, "customer_id", mapping)


def _graph_change(spark: SparkSession, d: str, references: list[tuple[str, str, str, str, str]]) -> Change:
    """Customers of a segment, a category of products and translations are
    deleted, and the customers of another segment renamed, in one step."""
    t = _t(spark, d)
    segments = tb.customer_segments(spark, d)
    renamed = segments.filter(F.col("segment") == F.lit(RENAMED_SEGMENT)).select(
        F.col("customer_id").alias("old_key"), (F.col("customer_id") + F.lit(RENAME_OFFSET)).alias("new_key"))
    return apply_change(
        {name: getattr(t, name) for name in PRIMARY_KEYS}, references,
        deleted={
            "customers": segments.filter(F.col("segment") == F.lit(RESTRICTED_SEGMENT)).select("customer_id"),
            "products": t.products.filter(F.col(CAT) == F.lit(DELETED_CATEGORY)).select(CAT),
            "translation": t.translation.filter(F.col(CAT).isin(*DELETED_TRANSLATIONS)).select(CAT),
        },
        renamed={"customers": ("customer_id", renamed)},
    )


def d6_d9_delete(spark: SparkSession, d: str) -> DataFrame:
    """What stays of every table: its key and its references as text. The
    customers' deletion is carried on to their orders and what belongs to them."""
    cascading = [(c, fk, p, pk, "cascade" if action == "restrict" else action) for c, fk, p, pk, action in FOREIGN_KEYS]
    after = _graph_change(spark, d, cascading).tables
    return ig.union_all([
        after[name].select(F.lit(name).alias("table_name"), *[
            (F.col(c).cast("string") if c else F.lit(None).cast("string")).alias(f"value_{i}") for i, c in enumerate(columns, 1)
        ])
        for name, columns in GRAPH_COLUMNS.items()
    ])


def d6_d9_refused(spark: SparkSession, d: str) -> DataFrame:
    """The same change with the references as declared: customers with orders
    can't be deleted, so nothing is."""
    return _graph_change(spark, d, FOREIGN_KEYS).blockers


def cleanup(spark: SparkSession, d: str) -> CleanResult:
    """D14 over the raw layer with defects: bad rows rejected, the last copy of
    each key kept, missing translations added, orphans cascaded."""
    return run_cleanup(
        _raw(spark, d, defects=True), strict_types=False, load_order=LOAD_ORDER, new_translations=new_translations(spark, d), drop_orphans=True
    )


def clean_table(name: str):
    def build(spark: SparkSession, d: str) -> DataFrame:
        df = cleanup(spark, d).tables[name]
        return df.select(*[money_out(c).alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])

    return build


def clean_report(name: str):
    def build(spark: SparkSession, d: str) -> DataFrame:
        return getattr(cleanup(spark, d), name)

    return build


def d11_missing_reference(spark: SparkSession, d: str) -> DataFrame:
    return missing_references(cleaned_products(spark, d), CAT, _t(spark, d).translation, CAT)


# ---------------------------------------------------------------------------
# Joins
# ---------------------------------------------------------------------------

def j2_fanout(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    j = t.order_items.select("order_id", "order_item_id", "product_id", "price").join(
        t.payments.select("order_id", "payment_sequential", "payment_value"), "order_id")
    return j.select("order_id", "order_item_id", "product_id", "payment_sequential",
                    money_out("price").alias("price"), money_out("payment_value").alias("payment_value"))


def _per_seller_order(items: DataFrame) -> DataFrame:
    return items.groupBy("seller_id", "order_id").agg(
        F.sum("price").alias("order_seller_price"), F.count(F.lit(1)).alias("items_count"))


def j3_join_preaggregated(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    j = _per_seller_order(t.order_items).join(t.sellers, "seller_id")
    return j.select("seller_id", "order_id", CITY, STATE, money_out("order_seller_price").alias("order_seller_price"),
                    "items_count")


def j4_left(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    per_order = t.order_items.groupBy("order_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("price").alias("_amt"))
    j = t.orders.select("order_id").join(per_order, "order_id", "left")
    return j.select("order_id", F.coalesce(F.col("n_items"), F.lit(0)).cast("bigint").alias("n_items"),
                    money_out(F.coalesce(F.col("_amt"), F.lit(0).cast(MONEY))).alias("order_amount"))


def j5_anti(spark: SparkSession, d: str) -> DataFrame:
    p = cleaned_products(spark, d)
    return orphans(p, CAT, _t(spark, d).translation, CAT)


def j6_lateral_top1(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    cats = an.category_revenue(t.order_items, t.products, "left")
    top = top_per_group(cats, ["seller_id"], an.top_category_order())
    return top.select("seller_id", CAT, money_out("category_revenue").alias("category_revenue"))


def j6_lateral_api(spark: SparkSession, d: str) -> DataFrame:
    """The best category of every seller, as a dependent join over the sellers."""
    t = _t(spark, d)
    # the correlation comes last: Spark's groupBy wants a plan that is resolved
    revenue = an.category_revenue(t.order_items, t.products, "left").withColumnRenamed("seller_id", "_seller")
    inner = revenue.where(F.col("_seller") == F.col("s.seller_id").outer()).select(CAT, "category_revenue")
    top = lateral_top(t.sellers.select("seller_id", CITY).alias("s"), inner, an.top_category_order())
    return top.select("seller_id", CITY, CAT, money_out("category_revenue").alias("category_revenue"))


def j7_scalar_api(spark: SparkSession, d: str) -> DataFrame:
    """The category of the dearest item of every order, as a scalar subquery."""
    t = _t(spark, d)
    items = t.order_items.select(F.col("order_id").alias("_order"), "product_id", "price").join(t.products, "product_id", "left")
    label = F.coalesce(F.col(CAT), F.lit(an.LABEL_UNCATEGORIZED)).alias("_label")
    inner = items.where(F.col("_order") == F.col("o.order_id").outer()).select("price", label)
    dearest = scalar_top(inner, "_label", [F.col("price").desc_nulls_first(), F.col("_label").asc()])
    return t.orders.alias("o").select("order_id", "customer_id", dearest.alias("top_category"))


def p12_tuple_semi(spark: SparkSession, d: str) -> DataFrame:
    from ledgerline.plans.catalog import X_MIN_ORDERS, X_MIN_TOTAL

    t = _t(spark, d)
    _, _, passing = an.passing_pairs(t.order_items, t.payments, t.products, X_MIN_TOTAL, X_MIN_ORDERS)
    return passing.withColumn("payment_value", money_out("payment_value"))


# ---------------------------------------------------------------------------
# Aggregates
# ---------------------------------------------------------------------------

def a2_multi_key(spark: SparkSession, d: str) -> DataFrame:
    agg = _per_seller_order(_t(spark, d).order_items)
    return agg.withColumn("order_seller_price", money_out("order_seller_price"))


def a3_rollup(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return an.item_sellers(t.order_items, t.sellers).rollup(STATE, CITY).agg(
        flag(STATE).alias("g_state"), flag(CITY).alias("g_city"),
        money_out(F.sum("price")).alias("revenue"), F.count(F.lit(1)).alias("n_items"))


def a4_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    ol = an.order_level(t.order_items, t.payments, t.products)
    return ol.groupingSets(an.CAT_PAY_SETS, CAT, PAY).agg(
        flag(CAT).alias("grouping_category"), flag(PAY).alias("grouping_payment"),
        money_out(F.sum("payment_value")).alias("total_payment"), F.count(F.lit(1)).alias("n_rows"))


def a5_hierarchy_sets(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return an.item_sellers(t.order_items, t.sellers).groupingSets(an.REGION_SETS, STATE, CITY).agg(
        flag(CITY).alias("is_state_summary"), money_out(F.sum("price")).alias("revenue"),
        F.count_distinct("order_id").alias("uq_orders"))


def a10_two_distincts(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return an.item_sellers(t.order_items, t.sellers).groupBy(STATE).agg(
        F.count_distinct("seller_id").alias("sellers_count"), F.count_distinct("order_id").alias("orders_count"))


def a13_stddev_variance_cv(spark: SparkSession, d: str) -> DataFrame:
    items = _t(spark, d).order_items
    return items.groupBy("seller_id").agg(
        round2(mean(F.sum("price"), F.count("price"))).alias("avg_price"),
        round2(F.stddev_samp("price")).alias("price_stddev"),
        round2(F.var_samp("price")).alias("price_variance"),
        round2(an.price_cv()).alias("cv"))


def a16_median(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    j = t.order_items.select("product_id", "price").join(t.products, "product_id")
    return exact_median(j, [CAT], "price", name="_m").select(CAT, round2("_m").alias("median_price"))


def a16_median_double(spark: SparkSession, d: str) -> DataFrame:
    """Median of a net price in double precision, per category."""
    t = _t(spark, d)
    j = tb.net_prices(spark, d).join(t.products, "product_id")
    return exact_median(j, [CAT], "net_price", name="median_net_price")


def a17_median_finest(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return an.category_payment_sets_by_order(t.order_items, t.payments, t.products, min_total=-1, min_orders=-1)


def a19_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d).products.select(CAT).distinct()


# ---------------------------------------------------------------------------
# Windows, order, sets
# ---------------------------------------------------------------------------

def w1_row_number(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    delivered = t.orders.filter(F.col("order_status") == F.lit(tb.DELIVERED_STATUS)).select("order_id", "customer_id", TS)
    rows = t.customers.join(delivered, "customer_id")
    return top_per_group(rows, [PERSON], an.latest_first()).select(PERSON, "order_id", TS)


def w2_first_value(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    return an.order_facts(t.order_items, t.products).select("order_id", "top_category")


def w3_partition_sum(spark: SparkSession, d: str) -> DataFrame:
    """SUM over the order on each item row; as aggregate + join back, which
    pre-aggregates a hot order instead of holding it in one window task."""
    items = _t(spark, d).order_items
    totals = items.groupBy("order_id").agg(F.sum("price").alias("order_amount"))
    j = items.select("order_id", "order_item_id", "product_id", "price").join(totals, "order_id")
    return j.select("order_id", "order_item_id", "product_id", money_out("price").alias("price"),
                    money_out("order_amount").alias("order_amount"))


def w4_first_per_key(spark: SparkSession, d: str) -> DataFrame:
    items = _t(spark, d).order_items
    order = [F.col("price").desc_nulls_first(), F.col("order_id"), F.col("order_item_id"), F.col("product_id")]
    top = top_per_group(items, ["seller_id"], order)
    return _items_out(top)


def o5_top_by_sum(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    ol = an.order_level(t.order_items, t.payments, t.products)
    per = ol.groupBy(PAY, CAT).agg(F.sum("payment_value").alias("total_payment"))
    top = top_per_group(per, [PAY], [F.col("total_payment").desc_nulls_first(), F.col(CAT).asc_nulls_first()])
    return top.withColumn("total_payment", money_out("total_payment"))


def u1_union_all(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    ol = materialize(an.order_level(t.order_items, t.payments, t.products), "order-level")
    return an._union_out(
        an._grain(ol, [PAY, CAT], -1, -1, count_rows=True),
        an._grain(ol, [CAT], -1, -1),
        an._grain(ol, [PAY], -1, -1),
    )


# ---------------------------------------------------------------------------
# Scalars, literals
# ---------------------------------------------------------------------------

def f1_round_half_up(spark: SparkSession, d: str) -> DataFrame:
    items = _t(spark, d).order_items
    return items.groupBy("seller_id").agg(
        round2(mean(F.sum("price"), F.count("price"))).alias("avg_price"),
        round2(mean(F.sum("price"), F.count_distinct("order_id"))).alias("avg_order_value"))


def f5_coalesce(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    facts = an.order_facts(t.order_items, t.products)
    j = t.orders.select("order_id").join(facts, "order_id", "left")
    return j.select(
        "order_id",
        money_out(F.coalesce(F.col("order_amount"), F.lit(0).cast(MONEY))).alias("order_amount"),
        F.coalesce(F.col("top_category"), F.lit(an.LABEL_UNCATEGORIZED)).alias("top_category"))


def f6_segments(spark: SparkSession, d: str) -> DataFrame:
    from ledgerline.plans.catalog import Q4_HIGH, Q4_VIP

    t = _t(spark, d)
    per_order = t.order_items.groupBy("order_id").agg(F.sum("price").alias("_amt"))
    j = t.customers.join(t.orders.select("order_id", "customer_id"), "customer_id").join(per_order, "order_id", "left")
    ltv = j.groupBy(PERSON).agg(F.coalesce(F.sum("_amt"), F.lit(0)).alias("_ltv"))
    return ltv.select(PERSON, round2("_ltv").alias("lifetime_value"),
                      segment_label("_ltv", Q4_VIP, Q4_HIGH).alias("customer_segment"))


def s3_values(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d)
    j = t.products.join(t.translation, CAT, "left")
    return j.groupBy("product_category_name_english").agg(F.count(F.lit(1)).alias("n_products"))


# ---------------------------------------------------------------------------
# Sources: raw dumps with broken lines
# ---------------------------------------------------------------------------

def _loaded_dump(spark: SparkSession, d: str) -> CsvLoad:
    """The orders written as a CSV dump with broken lines, and loaded."""
    path = scratch_path(spark, f"order-dump-{uuid.uuid4().hex}")
    tb.order_dump(spark, d).write.text(path)
    return load_csv(spark, path, "orders", header=False)


def s1_load(spark: SparkSession, d: str) -> DataFrame:
    return _loaded_dump(spark, d).rows


def s1_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Which file and place a line has depends on the number of tasks that wrote
    the dump, so the query returns the rest."""
    return _loaded_dump(spark, d).rejects.select("line", "problem", "column_name")


def s1_reject_report(spark: SparkSession, d: str) -> DataFrame:
    return _loaded_dump(spark, d).report.agg(F.sum("n_records").alias("n_records"), F.sum("n_rejected").alias("n_rejected"))


# ---------------------------------------------------------------------------
# Sinks: lookup layout (S8), total order
# ---------------------------------------------------------------------------

LOOKUP_COLUMNS = ["customer_id", TS, "product_id", "seller_id", CAT]


def _laid_out_items(spark: SparkSession, d: str) -> DataFrame:
    """Items with customer, timestamp and category, laid out for lookups by any
    of the five columns that the reference has indexes on."""
    t = _t(spark, d)
    wide = (
        t.order_items.join(t.orders.select("order_id", "customer_id", TS), "order_id")
        .join(t.products.select("product_id", CAT), "product_id", "left")
        .select("order_id", "order_item_id", *LOOKUP_COLUMNS, "price")
    )
    path = scratch_path(spark, f"lookup-{uuid.uuid4().hex}")
    n_files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_lookup_layout(materialize(wide, "lookup-rows"), path, LOOKUP_COLUMNS, n_files)
    return spark.read.parquet(path)


def looked_up(column: str, **wanted) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _items_out(lookup(_laid_out_items(spark, d), column, **wanted))


def s9_positions(spark: SparkSession, d: str) -> DataFrame:
    items = _t(spark, d).order_items
    return _items_out(with_positions(items, [F.col("price").desc_nulls_first(), F.col("order_id"), F.col("order_item_id")]))


def s9_page(spark: SparkSession, d: str) -> DataFrame:
    items = _t(spark, d).order_items
    path = scratch_path(spark, f"page-{uuid.uuid4().hex}")
    write_in_order(items, path, [F.col("price").desc_nulls_first(), F.col("order_id"), F.col("order_item_id")], PAGE_BLOCK)
    return _items_out(read_page(spark.read.parquet(path), PAGE_FIRST, PAGE_LAST, PAGE_BLOCK))


BUILDERS = {
    "s1_load": s1_load, "s1_rejects": s1_rejects, "s1_reject_report": s1_reject_report,
    "s8_lookup_customer": looked_up("customer_id", values=LOOKUP_CUSTOMERS),
    "s8_lookup_timestamp": looked_up(TS, low=LOOKUP_FROM, before=LOOKUP_BEFORE),
    "s8_lookup_product": looked_up("product_id", values=LOOKUP_PRODUCTS),
    "s8_lookup_seller": looked_up("seller_id", values=LOOKUP_SELLERS),
    "s8_lookup_category": looked_up(CAT, values=[LOOKUP_CATEGORY]),
    "s9_positions": s9_positions, "s9_page": s9_page,
    "d1_text_to_ts": d1_text_to_ts, "d1_quarantine": d1_quarantine,
    "d5_dedupe_items": d5_dedupe_items, "d5_dedupe_reviews": d5_dedupe_reviews,
    "d10_blank_to_null": d10_blank_to_null, "d12_insert_absent": d12_insert_absent, "d13_profile": d13_profile,
    "d2_pk_single": d2_pk_single, "d3_pk_composite": d3_pk_composite, "d4_fk_orphans": d4_fk_orphans,
    "d6_cascade": d6_cascade, "d7_restrict": d7_restrict, "d8_set_null": d8_set_null, "d9_rename": d9_rename,
    "d6_d9_delete": d6_d9_delete, "d6_d9_refused": d6_d9_refused,
    "d11_missing_reference": d11_missing_reference,
    **{f"d14_clean_{name}": clean_table(name) for name in PRIMARY_KEYS},
    **{f"d14_{name}": clean_report(name) for name in (
        "profile", "key_report", "reference_report", "missing_categories", "rejected_orders")},
    "j2_fanout": j2_fanout, "j3_join_preaggregated": j3_join_preaggregated, "j4_left": j4_left,
    "j5_anti": j5_anti, "j6_lateral_top1": j6_lateral_top1, "j6_lateral_api": j6_lateral_api, "j7_scalar_api": j7_scalar_api, "p12_tuple_semi": p12_tuple_semi,
    "a2_multi_key": a2_multi_key, "a3_rollup": a3_rollup, "a4_grouping_sets": a4_grouping_sets,
    "a5_hierarchy_sets": a5_hierarchy_sets, "a10_two_distincts": a10_two_distincts,
    "a13_stddev_variance_cv": a13_stddev_variance_cv, "a16_median": a16_median, "a16_median_double": a16_median_double,
    "a17_median_finest": a17_median_finest, "a19_distinct": a19_distinct,
    "w1_row_number": w1_row_number, "w2_first_value": w2_first_value, "w3_partition_sum": w3_partition_sum,
    "w4_first_per_key": w4_first_per_key, "o5_top_by_sum": o5_top_by_sum, "u1_union_all": u1_union_all,
    "f1_round_half_up": f1_round_half_up, "f5_coalesce": f5_coalesce, "f6_segments": f6_segments,
    "s3_values": s3_values,
}
