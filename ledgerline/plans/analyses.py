"""

Each function takes DataFrames plus its thresholds (defaults are the
reference's constants) and returns an unevaluated, ordered DataFrame.

Scale notes, shared by all of them:

* No join carries a hint: sellers and products are joined after the fact side
  has been reduced where that is possible, and Spark chooses the join from
  file sizes and, through AQE, from measured sizes.
* Where the reference joins items and payments many-to-many, both sides are
  first reduced to their order grain (items per category, payment sums or
  counts per type) so the k x m fan-out is never shuffled; sums stay exact
  because money is decimal. The reduction has a map-side step, so one order
  with a third of all items moves as a row per category and task.
* Top-1 searches use ``row_number`` + ``rn = 1`` (partial WindowGroupLimit
  before the shuffle) or a ``min_by`` aggregate; both pre-reduce hot keys.
* Distinct counts of subtotals are sums of marks (``operators.distinct``): one
  row of each (order, group) is marked where the rows lie by order, the marks are
  summed at the finest level, and only those sums are copied per grouping set.
* Medians (``operators.median``) come from weights per coarse bucket, again
  summed upwards; only the values of the middle buckets are moved.
* An order grain with several readers is written once to the shared
  checkpoint folder and read back (S5, ``materialize``): X1, Q2L and Q2O; Q3L
  writes one row per seller and payment multiple.
* Ties the reference leaves open get a stated, total tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import WIDE, flag, mean, money_out, round2, segment_label, typed_null
from ledgerline.operators.distinct import mark_firsts
from ledgerline.operators.grouping import expand_sets
from ledgerline.operators.joins import null_safe_join, semi_by_tuple
from ledgerline.operators.median import bucket_weights, sets_median
from ledgerline.operators.ranking import top_per_group
from ledgerline.sources.io import materialize

CAT, PAY = "product_category_name", "payment_type"
STATE, CITY = "seller_state", "seller_city"
PERSON = "customer_unique_id"
TS = "order_purchase_timestamp"

# Default labels of the reference; the two spellings differ on purpose.
LABEL_UNCATEGORIZED = "Uncategorized"
LABEL_UNCATEGORISED = "Uncategorised"


def _c(name: str) -> Column:
    return F.col(name)


# ---------------------------------------------------------------------------
# Shared building blocks
# ---------------------------------------------------------------------------

def item_sellers(items: DataFrame, sellers: DataFrame) -> DataFrame:
    """Items with the seller's city and state (inner)."""
    return items.select("seller_id", "order_id", "price").join(
        sellers.select("seller_id", CITY, STATE), "seller_id"
    )


# Marks of order-grain rows: their sums are distinct orders per (category, type),
# per category and per type.
PAIR_MARKS = ["_of_pair", "_of_category", "_of_type"]


def item_categories(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items per (order, category), counted map-side before the shuffle."""
    return (
        items.select("order_id", "product_id")
        .join(products.select("product_id", CAT), "product_id")
        .groupBy("order_id", CAT)
        .agg(F.count(F.lit(1)).alias("_n_items"))
    )


def order_level(items: DataFrame, payments: DataFrame, products: DataFrame) -> DataFrame:
    """Payment value per (category, payment type, order) over items x payments.

    The reference sums payment_value over the joined rows. Per order that sum
    is (items of the category) x (sum of payments of the type), so both sides
    are reduced to the order grain before the join: the fan-out is never
    materialised and the result is exactly the same.
    """
    return marked_order_level(items, payments, products).drop(*PAIR_MARKS)


def marked_order_level(items: DataFrame, payments: DataFrame, products: DataFrame) -> DataFrame:
    """``order_level`` with ``PAIR_MARKS``."""
    pay_sums = payments.groupBy("order_id", PAY).agg(F.sum("payment_value").alias("_pay"))
    return _marked_pairs(item_categories(items, products), pay_sums).select(
        CAT, PAY, "order_id", (_c("_pay") * _c("_n_items")).alias("payment_value"), *PAIR_MARKS
    )


def _marked_pairs(categories: DataFrame, payments: DataFrame) -> DataFrame:
    """Items per (order, category) joined with payments per order, with ``PAIR_MARKS``.

    A payment that is the first of its order stands once beside every category
    of the order, and a category that is the first of its order once beside the
    first payment of every type; so the marks of either side, made before
    the join, tell the distinct orders of each grain.
    """
    c = mark_firsts(categories, "order_id", [CAT], ["_first_category", "_each_category"]).drop("_each_category")
    p = mark_firsts(payments, "order_id", [PAY], ["_first_payment", "_first_of_type"])
    return c.join(p, "order_id").withColumns({
        "_of_pair": _c("_first_of_type"), "_of_category": _c("_first_payment"), "_of_type": _c("_first_of_type") * _c("_first_category"),
    })


def pair_sets(finest: DataFrame, flags: dict[str, str], uq: str, min_total: float, min_orders: int) -> DataFrame:
    """``_total`` and distinct orders per set of ``CAT_PAY_SETS`` within the
    limits, from one row per (category, type) with ``_total`` and ``PAIR_MARKS``."""
    sets = expand_sets(finest, CAT_PAY_SETS, [CAT, PAY], flags, ["_total", *PAIR_MARKS])
    no_cat, no_pay = _c(flags[CAT]) == 1, _c(flags[PAY]) == 1
    orders = F.when(no_cat, _c("_of_type")).when(no_pay, _c("_of_category")).otherwise(_c("_of_pair"))
    agg = sets.groupBy(CAT, PAY, *flags.values()).agg(F.sum("_total").alias("_total"), F.sum(orders).alias(uq))
    return agg.filter((_c("_total") > F.lit(min_total)) & (_c(uq) > F.lit(min_orders)))


def _pair_sums(rows: DataFrame, total: Column) -> DataFrame:
    return rows.groupBy(CAT, PAY).agg(F.sum(total).alias("_total"), *[F.sum(m).alias(m) for m in PAIR_MARKS])


def weighted_payment_rows(items: DataFrame, payments: DataFrame, products: DataFrame) -> DataFrame:
    """Joined (item x payment) rows of the reference as weighted rows.

    One row per (order, category, payment) with ``_w`` = number of items of
    that category in the order: it stands for ``_w`` identical joined rows.
    """
    pays = payments.select("order_id", PAY, "payment_value")
    return _marked_pairs(item_categories(items, products).withColumnRenamed("_n_items", "_w"), pays)


def merged_spread(parts: DataFrame, keys: list[str], total: str, n: str, avg: str, within: Column, others: list[Column]) -> DataFrame:
    """Merge partial moments by the parallel-variance formula: per ``keys`` the
    sums ``_s1`` of totals and ``_n`` of row counts and the sum of squared
    deviations ``_m2``, beside ``others``.

    A part has ``n`` values of mean ``avg`` and squared deviations ``within``.
    All terms are squares or such sums, so the result is never negative and equal
    values give exactly no spread. The window holds the parts of a group, which
    the caller has reduced to a few.
    """
    group = Window.partitionBy(*keys)
    centre = F.sum(_c(n) * _c(avg)).over(group) / F.nullif(F.sum(n).over(group), F.lit(0))
    spread = within + _c(n) * F.pow(_c(avg) - _c("_centre"), F.lit(2.0))
    return parts.withColumn("_centre", centre).groupBy(*keys).agg(
        F.sum(n).alias("_n"), F.sum(total).alias("_s1"), F.sum(spread).alias("_m2"), *others
    )


def order_facts(items: DataFrame, products: DataFrame, label: str = LABEL_UNCATEGORIZED) -> DataFrame:
    """Per order: item amount and the category of its dearest item.

    One aggregate per order (partial aggregation, skew-safe). The dearest
    item is chosen by price DESC with NULL price first (the reference's DESC
    order), ties broken by the label-coalesced category ascending.
    """
    it = items.select("order_id", "product_id", "price").join(
        products.select("product_id", CAT), "product_id", "left"
    )
    cat = F.coalesce(_c(CAT), F.lit(label))
    # min over (has price, -price, category): NULL price sorts first, then
    # the highest price, then the smallest category.
    rank_key = F.struct(_c("price").isNotNull(), -_c("price"), cat)
    return it.groupBy("order_id").agg(
        F.sum("price").alias("order_amount"),
        F.min_by(cat, rank_key).alias("top_category"),
    )


# ---------------------------------------------------------------------------
# Q1: hierarchical seller sales
# ---------------------------------------------------------------------------

def _q1_out(agg: DataFrame, min_revenue: float) -> DataFrame:
    out = agg.filter(_c("_total") > F.lit(min_revenue)).select(
        CITY,
        STATE,
        money_out("_total").alias("total"),
        "uq_orders_count",
        round2(mean("_total", "uq_orders_count")).alias("avg_order_value"),
        round2("_sd").alias("price_sttdev"),
    )
    return out.orderBy(_c(STATE).asc_nulls_first(), _c(CITY).asc_nulls_first(), _c("total").desc_nulls_first())


def seller_sales_rollup(sellers: DataFrame, items: DataFrame, min_revenue: float = 50000) -> DataFrame:
    """Q1L: revenue, distinct orders, order value and price SD per city,
    state subtotal and grand total (ROLLUP), groups above ``min_revenue``."""
    per_item = item_sellers(items, sellers).groupBy(STATE, CITY).agg(
        F.sum("price").alias("_s1"), F.count("price").alias("_n"), F.var_pop("price").alias("_v")
    )
    pairs = items.select("seller_id", "order_id").distinct().join(sellers.select("seller_id", CITY, STATE), "seller_id")
    marks = ["_orders", "_orders_of_state", "_orders_of_city"]
    counts = mark_firsts(pairs.select(STATE, CITY, "order_id"), "order_id", [STATE, CITY], marks).groupBy(STATE, CITY).agg(
        *[F.sum(m).alias(m) for m in marks]
    )
    finest = null_safe_join(per_item, counts, [STATE, CITY]).withColumn("_a", mean("_s1", "_n").cast("double"))
    # from here on one row per city
    flags = {STATE: "_no_state", CITY: "_no_city"}
    keys = [STATE, CITY, *flags.values()]
    sets = expand_sets(finest, [[STATE, CITY], [STATE], []], [STATE, CITY], flags, ["_s1", "_n", "_a", "_v", *marks])
    uq = F.when(_c("_no_city") == 0, _c("_orders_of_city")).when(_c("_no_state") == 0, _c("_orders_of_state")).otherwise(_c("_orders"))
    agg = merged_spread(sets.withColumn("_uq", uq), keys, "_s1", "_n", "_a", _c("_n") * _c("_v"), [F.sum("_uq").alias("uq_orders_count")])
    sd = F.when(_c("_n") > F.lit(1), F.sqrt(_c("_m2") / (_c("_n") - F.lit(1))))
    return _q1_out(agg.select(STATE, CITY, _c("_s1").alias("_total"), "uq_orders_count", sd.alias("_sd")), min_revenue)


def seller_sales_rollup_by_order(sellers: DataFrame, items: DataFrame, min_revenue: float = 50000) -> DataFrame:
    """Q1O: same shape from (seller, order) totals. Counts (seller, order)
    pairs and takes the SD of per-order mean prices (not the same numbers)."""
    per_order = items.groupBy("seller_id", "order_id").agg(
        F.sum("price").alias("order_seller_price"),
        F.count(F.lit(1)).alias("items_count"),
    )
    agg = (
        per_order.join(sellers.select("seller_id", CITY, STATE), "seller_id")
        .rollup(STATE, CITY)
        .agg(
            F.sum("order_seller_price").alias("_total"),
            F.count("order_id").alias("uq_orders_count"),
            # per-order mean price; the reference divides a float sum, so
            # double precision is the faithful (and cheap) type here
            F.stddev_samp(_c("order_seller_price").cast("double") / _c("items_count")).alias("_sd"),
        )
    )
    return _q1_out(agg, min_revenue)


# ---------------------------------------------------------------------------
# Q2: category x payment grouping sets
# ---------------------------------------------------------------------------

CAT_PAY_SETS = [[CAT, PAY], [CAT], [PAY]]


def _labels() -> list[Column]:
    """Last sort keys, which make the order of Q2, X1 and X2 total."""
    return [_c(CAT).asc_nulls_last(), _c(PAY).asc_nulls_last()]


def _union_order(out: DataFrame) -> DataFrame:
    return out.orderBy(_c("grouping_category").asc(), _c("unique_orders").desc(), _c("grouping_payment").asc(), *_labels())


def category_payment_sets(
    items: DataFrame, payments: DataFrame, products: DataFrame,
    min_total: float = 100000, min_orders: int = 500,
) -> DataFrame:
    """Q2L: total, distinct orders and median payment over the joined
    (item x payment) rows for (category, type), (category), (type)."""
    flags = {CAT: "is_cat_aggaregated", PAY: "is_pay_aggregated"}
    # written once (S5): read for the bucket weights, then for the middle buckets
    rows = materialize(weighted_payment_rows(items, payments, products).drop("order_id"), "payment-rows")
    others = [F.sum(_c("payment_value") * _c("_w")).alias("_total"), *[F.sum(m).alias(m) for m in PAIR_MARKS]]
    buckets = materialize(bucket_weights(rows, [CAT, PAY], "payment_value", "_w", others), "payment-buckets")
    agg = pair_sets(_pair_sums(buckets, _c("_total")), flags, "uq_orders_count", min_total, min_orders)
    medians = sets_median(rows, buckets, CAT_PAY_SETS, [CAT, PAY], flags, "payment_value", "_w", "_median")
    agg = null_safe_join(agg, medians, [CAT, PAY, *flags.values()], "left")
    out = agg.select(
        CAT, PAY, "is_cat_aggaregated", "is_pay_aggregated",
        money_out("_total").alias("total"),
        "uq_orders_count",
        round2("_median").alias("median_payment"),
    )
    return out.orderBy(
        _c("is_cat_aggaregated").asc(), _c("uq_orders_count").desc(), _c("is_pay_aggregated").asc(), *_labels()
    )


def category_payment_sets_by_order(
    items: DataFrame, payments: DataFrame, products: DataFrame,
    min_total: float = 100000, min_orders: int = 500,
) -> DataFrame:
    """Q2O: the same sets over the order grain; the median of per-order sums
    is shown for (category, type) rows only and NULL on subtotals.

    The median is computed in its own aggregate at the finest grain and
    joined NULL-safely (A17), so no subtotal group pays for a percentile.
    """
    flags = {CAT: "grouping_category", PAY: "grouping_payment"}
    ol = materialize(marked_order_level(items, payments, products).drop("order_id"), "order-level")
    others = [F.sum("payment_value").alias("_total"), *[F.sum(m).alias(m) for m in PAIR_MARKS]]
    buckets = materialize(bucket_weights(ol, [CAT, PAY], "payment_value", None, others), "payment-buckets")
    sets = pair_sets(_pair_sums(buckets, _c("_total")), flags, "uq_orders", min_total, min_orders)
    med = sets_median(ol, buckets, None, [CAT, PAY], {}, "payment_value", None, "_median").select(
        CAT, PAY, F.lit(0).alias("grouping_category"), F.lit(0).alias("grouping_payment"), "_median"
    )
    out = null_safe_join(sets, med, [CAT, PAY, "grouping_category", "grouping_payment"], "left").select(
        CAT, PAY,
        money_out("_total").alias("total_payment"),
        "uq_orders",
        round2("_median").alias("median_payment"),
        "grouping_category", "grouping_payment",
    )
    return out.orderBy(_c("grouping_category").asc(), _c("uq_orders").desc(), _c("grouping_payment").asc(), *_labels())


def _grain(ol: DataFrame, keys: list[str], min_total: float, min_orders: int, count_rows: bool = False) -> DataFrame:
    n = F.count(F.lit(1)) if count_rows else F.count_distinct("order_id")
    return (
        ol.groupBy(*keys)
        .agg(F.sum("payment_value").alias("_total"), n.alias("unique_orders"), F.count_distinct("order_id").alias("_uq"))
        .filter((_c("_total") > F.lit(min_total)) & (_c("_uq") > F.lit(min_orders)))
    )


def _union_out(detail: DataFrame, by_cat: DataFrame, by_pay: DataFrame) -> DataFrame:
    def shape(df: DataFrame, cat: Column, pay: Column, gc: int, gp: int) -> DataFrame:
        return df.select(
            cat.alias(CAT), pay.alias(PAY),
            money_out("_total").alias("total_payment"),
            _c("unique_orders").cast("bigint").alias("unique_orders"),
            F.lit(gc).alias("grouping_category"), F.lit(gp).alias("grouping_payment"),
        )

    out = (
        shape(detail, _c(CAT), _c(PAY), 0, 0)
        .unionByName(shape(by_cat, _c(CAT), typed_null(), 0, 1))
        .unionByName(shape(by_pay, typed_null(), _c(PAY), 1, 0))
    )
    return _union_order(out)


def _grains(ol: DataFrame, sets: list[list[str]], min_total: float, min_orders: int) -> DataFrame:
    """Several unioned grains of the order-level rows in one read, each with
    its own HAVING. Detail rows are unique per (category, type, order), so
    their COUNT(*) equals the distinct order count."""
    flags = {CAT: "grouping_category", PAY: "grouping_payment"}
    grains = (
        expand_sets(ol, sets, [CAT, PAY], flags, ["order_id", "payment_value"])
        .groupBy(CAT, PAY, *flags.values())
        .agg(
            F.sum("payment_value").alias("_total"),
            F.count(F.lit(1)).alias("_rows"),
            F.count_distinct("order_id").alias("_uq"),
        )
        .filter((_c("_total") > F.lit(min_total)) & (_c("_uq") > F.lit(min_orders)))
    )
    detail = (_c("grouping_category") == 0) & (_c("grouping_payment") == 0)
    out = grains.select(
        CAT, PAY,
        money_out("_total").alias("total_payment"),
        F.when(detail, _c("_rows")).otherwise(_c("_uq")).cast("bigint").alias("unique_orders"),
        _c("grouping_category").cast("int").alias("grouping_category"),
        _c("grouping_payment").cast("int").alias("grouping_payment"),
    )
    return out


def passing_pairs(
    items: DataFrame, payments: DataFrame, products: DataFrame, min_total: float, min_orders: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(order-level rows, (category, type) pairs within the limits, order-level
    rows of those pairs). The order grain is written once (S5); so are the
    pairs, at most categories x types rows, whose file size then tells Spark
    whether the semi join may broadcast them."""
    ol = materialize(order_level(items, payments, products), "order-level")
    stats = materialize(_grain(ol, [PAY, CAT], min_total, min_orders), "passing-pairs")
    return ol, stats, semi_by_tuple(ol, stats, [CAT, PAY])


def category_payment_union_filtered(
    items: DataFrame, payments: DataFrame, products: DataFrame,
    min_total: float = 100000, min_orders: int = 500,
) -> DataFrame:
    """Three unioned grains; the subtotals only count (category, type)
    pairs that passed at detail level (tuple IN: NULL categories drop out)."""
    _, stats, passing = passing_pairs(items, payments, products, min_total, min_orders)
    detail = stats.select(
        CAT, PAY, money_out("_total").alias("total_payment"),
        _c("unique_orders").cast("bigint").alias("unique_orders"),
        F.lit(0).alias("grouping_category"), F.lit(0).alias("grouping_payment"))
    subtotals = _grains(passing, [[CAT], [PAY]], min_total, min_orders)
    out = detail.unionByName(subtotals)
    return _union_order(out)


def category_payment_union(
    items: DataFrame, payments: DataFrame, products: DataFrame,
    min_total: float = 100000, min_orders: int = 500,
) -> DataFrame:
    """Three unioned grains, each with its own HAVING (= Q2O without the
    median), all from one read of the order-level rows."""
    flags = {CAT: "grouping_category", PAY: "grouping_payment"}
    ol = marked_order_level(items, payments, products)
    sets = pair_sets(_pair_sums(ol, _c("payment_value")), flags, "unique_orders", min_total, min_orders)
    out = sets.select(
        CAT, PAY, money_out("_total").alias("total_payment"), _c("unique_orders").cast("bigint").alias("unique_orders"), *flags.values()
    )
    return _union_order(out)


# ---------------------------------------------------------------------------
# Q3: price dispersion by region
# ---------------------------------------------------------------------------

REGION_SETS = [[STATE, CITY], [STATE]]


def seller_price_dispersion(
    sellers: DataFrame, items: DataFrame, payments: DataFrame,
    min_revenue: float = 30000, min_orders: int = 100, min_cv: float = 50,
) -> DataFrame:
    """Q3L: per (state, city) and state: sellers, orders, revenue, variance
    and CV of item prices over the payment-fanned rows.

    The reference joins payments only to multiply item rows (no payment
    column is used): an item counts once per payment of its order. Items are
    reduced to (seller, order) rows; with m payments, n prices, their mean and population variance v, such a row stands for
    k = m * n prices. Rows of one group and one k are aggregated natively
    (count, avg, var_pop of the means), and the few k of a group are merged by
    the parallel-variance formula. All terms are squares or variances, so the
    sum is never negative and equal prices give exactly no spread.
    """
    pay_counts = payments.groupBy("order_id").agg(F.count(F.lit(1)).alias("_m"))
    per = items.groupBy("seller_id", "order_id").agg(
        F.count("price").alias("_n"), F.sum("price").alias("_s1"), F.var_pop("price").alias("_v")
    )
    k = (_c("_m") * _c("_n")).alias("_k")
    rows = per.join(pay_counts, "order_id").join(sellers.select("seller_id", CITY, STATE), "seller_id").select(
        STATE, CITY, "seller_id", "order_id", k, (_c("_s1") * _c("_m")).alias("_total"),
        mean("_s1", "_n").cast("double").alias("_mean"), (_c("_m") * _c("_n") * _c("_v")).alias("_within"),
    )
    rows = mark_firsts(rows, "order_id", [STATE, CITY], ["_any", "_orders_of_state", "_orders_of_city"])
    marks = ["_orders_of_state", "_orders_of_city"]
    parts = rows.groupBy("seller_id", STATE, CITY, "_k").agg(
        (F.count("_mean") * _c("_k")).alias("_w"), F.avg("_mean").alias("_a"), F.var_pop("_mean").alias("_v"),
        F.sum("_within").alias("_within"), F.sum("_total").alias("_total"), *[F.sum(m).alias(m) for m in marks],
    )
    # sellers have one city each as a rule; marks hold for any
    parts = materialize(mark_firsts(parts, "seller_id", [STATE, CITY], ["_any", "_sellers_of_state", "_sellers_of_city"]).drop("_any"), "seller-moments")
    flags = {CITY: "is_state_summary"}
    keys = [STATE, CITY, "is_state_summary"]
    state = _c("is_state_summary") == 1
    sets = expand_sets(
        parts, REGION_SETS, [STATE, CITY], flags, ["_w", "_a", "_v", "_within", "_total", *marks, "_sellers_of_state", "_sellers_of_city"]
    )
    centres = sets.groupBy(*keys).agg((F.sum(_c("_w") * _c("_a")) / F.nullif(F.sum("_w"), F.lit(0))).alias("_centre"))
    spread = _c("_within") + _c("_w") * (_c("_v") + F.pow(_c("_a") - _c("_centre"), F.lit(2.0)))
    agg = null_safe_join(sets, centres, keys).groupBy(*keys).agg(
        F.sum("_w").alias("_n"), F.sum("_total").alias("_s1"), F.sum(spread).alias("_m2"),
        F.sum(F.when(state, _c("_orders_of_state")).otherwise(_c("_orders_of_city"))).alias("orders_count"),
        F.sum(F.when(state, _c("_sellers_of_state")).otherwise(_c("_sellers_of_city"))).alias("sellers_count"),
    )
    # one row has no sample variance
    variance = F.when(_c("_n") > F.lit(1), _c("_m2") / (_c("_n") - F.lit(1)))
    cv = F.sqrt(variance) / mean("_s1", "_n").cast("double") * F.lit(100)
    out = agg.select("*", variance.alias("_variance"), cv.alias("_cv")).filter(
        (_c("_s1") > F.lit(min_revenue)) & (_c("orders_count") > F.lit(min_orders)) & (_c("_cv") > F.lit(min_cv))
    ).select(
        CITY, STATE, "is_state_summary", "sellers_count", "orders_count",
        money_out("_s1").alias("total_revenue"),
        round2("_variance").alias("price_variance"),
        round2("_cv").alias("cv"),
    )
    return _region_order(out)


def _region_order(out: DataFrame) -> DataFrame:
    return out.orderBy(
        _c(STATE).asc_nulls_last(), _c("is_state_summary").desc_nulls_first(), _c("total_revenue").desc_nulls_first(), _c(CITY).asc_nulls_last()
    )


def price_cv() -> Column:
    """Coefficient of variation of the item prices, in per cent."""
    return F.stddev_samp("price") / mean(F.sum("price"), F.count("price")).cast("double") * F.lit(100)


def volatile_seller_regions(
    sellers: DataFrame, items: DataFrame,
    min_revenue: float = 30000, min_orders: int = 100, min_cv: float = 50,
) -> DataFrame:
    """Q3O: filter *sellers* by the three limits first, then per (state, city)
    and state: revenue, summed order counts, mean of the rounded seller CVs."""
    stats = (
        items.groupBy("seller_id")
        .agg(F.sum("price").alias("_rev"), F.count_distinct("order_id").alias("_orders"), price_cv().alias("_cv_raw"))
        .filter((_c("_rev") > F.lit(min_revenue)) & (_c("_orders") > F.lit(min_orders)) & (_c("_cv_raw") > F.lit(min_cv)))
        # the reference rounds each seller's CV (numeric) before averaging
        .select("seller_id", "_rev", "_orders", F.round(_c("_cv_raw").cast(WIDE), 2).alias("_cv"))
    )
    agg = stats.join(sellers.select("seller_id", CITY, STATE), "seller_id").groupingSets(REGION_SETS, STATE, CITY).agg(
        F.sum("_rev").alias("_total"),
        F.sum("_orders").alias("orders_count"),
        F.sum("_cv").alias("_cv_sum"),
        F.count("_cv").alias("_cv_n"),
        flag(CITY).alias("is_state_summary"),
        F.count_distinct("seller_id").alias("sellers_count"),
    )
    out = agg.select(
        CITY, STATE,
        money_out("_total").alias("total_revenue"),
        _c("orders_count").cast("bigint").alias("orders_count"),
        round2(mean("_cv_sum", "_cv_n")).alias("avg_cv"),
        "is_state_summary", "sellers_count",
    )
    return _region_order(out)


# ---------------------------------------------------------------------------
# Q4: customer lifetime value with the latest delivered order
# ---------------------------------------------------------------------------

def _persons(
    customers: DataFrame, orders: DataFrame, items: DataFrame, min_orders: int, delivered: str, first: list[Column]
) -> DataFrame:
    """Per person with more than ``min_orders`` orders: distinct orders,
    lifetime value, smallest customer_id and, of the delivered orders, the one
    that is first by ``first``, then newest (NULL first, as in the reference),
    then of the smallest id.

    Items enter as per-order amounts (SUM is result-preserving), so the
    customer x order x item join is never built at item grain. The latest
    order is a minimum over structs of the same aggregate: partial per task, no
    window and no second read of the orders.
    """
    amounts = items.groupBy("order_id").agg(F.sum("price").alias("order_amount"))
    co = customers.select("customer_id", PERSON).join(orders.select("order_id", "customer_id", "order_status", TS), "customer_id")
    # zone-free subtraction: the newest has the smallest distance
    age = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz") - _c(TS)
    place = F.struct(
        *[c.alias(f"_f{i}") for i, c in enumerate(first)], _c(TS).isNotNull().alias("_dated"), age.alias("_age"),
        _c("order_id").alias("order_id"), _c(TS).alias(TS), _c("customer_id").alias("_of"), _c("order_amount").alias("order_amount"),
    )
    return (
        co.join(amounts, "order_id", "left")
        .groupBy(PERSON)
        .agg(
            F.min("customer_id").alias("customer_id"),
            F.count_distinct("order_id").alias("total_orders_count"),
            F.coalesce(F.sum("order_amount"), F.lit(0)).alias("_ltv"),
            F.min(F.when(_c("order_status") == F.lit(delivered), place)).alias("_latest"),
        )
        .filter(_c("total_orders_count") > F.lit(min_orders))
    )


def _ltv_out(persons: DataFrame, items: DataFrame, products: DataFrame, vip: float, high: float, label: str) -> DataFrame:
    """The output for persons with their latest order (``_latest``, may be NULL);
    the dearest category is looked up for those orders only."""
    p = persons.select(PERSON, "total_orders_count", "_ltv", "_latest.order_id", f"_latest.{TS}", "_latest.order_amount")
    # persons without a delivered order are dealt by their own id
    p = p.withColumn("_deal", F.when(_c("order_id").isNull(), F.xxhash64(PERSON)).otherwise(F.xxhash64("order_id")))
    it = items.select(_c("order_id").alias("_order"), F.xxhash64("order_id").alias("_hash"), "product_id", "price")
    j = p.join(it, (_c("_deal") == _c("_hash")) & (_c("order_id") == _c("_order")), "left").join(products.select("product_id", CAT), "product_id", "left")
    # the dearest item: NULL price first, then the highest price, then the smallest label
    dearest = F.struct(_c("price").isNotNull(), -_c("price"), F.coalesce(_c(CAT), F.lit(label)).alias("label"))
    out = j.groupBy(PERSON, "_deal", "order_id", "total_orders_count", "_ltv", TS, "order_amount").agg(F.min(dearest)["label"].alias("top_category")).select(
        PERSON,
        "total_orders_count",
        round2("_ltv").alias("lifetime_value"),
        segment_label("_ltv", vip, high).alias("customer_segment"),
        _c("order_id").alias("latest_order_id"),
        _c(TS).alias("latest_order_date"),
        round2(F.coalesce(_c("order_amount"), F.lit(0))).alias("latest_order_amount"),
        F.coalesce(_c("top_category"), F.lit(label)).alias("latest_order_top_category"),
    )
    # the reference sorts by the rounded output column
    return out.orderBy(_c("lifetime_value").desc_nulls_first(), _c(PERSON).asc())


def latest_first() -> list[Column]:
    return [F.col(TS).desc_nulls_first(), F.col("order_id").asc()]


def customer_ltv_latest_order(
    customers: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame,
    min_orders: int = 1, vip: float = 500, high: float = 200,
    delivered: str = "delivered", label: str = LABEL_UNCATEGORIZED,
) -> DataFrame:
    """Q4L: persons with more than ``min_orders`` orders: order count, LTV,
    segment and their latest delivered order over *all* their customer ids
    (id, date, amount, dearest item's category). Latest = newest purchase
    timestamp, NULL first as in the reference, then smallest order id."""
    return _ltv_out(_persons(customers, orders, items, min_orders, delivered, []), items, products, vip, high, label)


def customer_ltv_first_id_order(
    customers: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame,
    min_orders: int = 1, vip: float = 500, high: float = 200,
    delivered: str = "delivered", label: str = LABEL_UNCATEGORIZED,
) -> DataFrame:
    """Q4O: as Q4L, but the latest delivered order is searched only among
    the orders of the person's smallest customer_id."""
    persons = _persons(customers, orders, items, min_orders, delivered, [_c("customer_id")])
    own = F.when(_c("_latest._of") == _c("customer_id"), _c("_latest"))
    return _ltv_out(persons.withColumn("_latest", own), items, products, vip, high, label)


# ---------------------------------------------------------------------------
# Q5: seller performance and best category
# ---------------------------------------------------------------------------

def top_category_order() -> list[Column]:
    return [F.col("category_revenue").desc_nulls_first(), F.col(CAT).asc_nulls_first()]


def _seller_metrics(sellers: DataFrame, items: DataFrame, min_revenue: float) -> DataFrame:
    """Orders and revenue per known seller. Items are aggregated before the
    join, the distinct phase by (seller, order), so a hot seller is spread."""
    per = (
        items.groupBy("seller_id")
        .agg(F.count_distinct("order_id").alias("total_orders_count"), F.coalesce(F.sum("price"), F.lit(0)).alias("_rev"))
        .filter(_c("_rev") > F.lit(min_revenue))
    )
    return per.join(sellers.select("seller_id"), "seller_id")


def category_revenue(items: DataFrame, products: DataFrame, how: str = "left") -> DataFrame:
    """Revenue per (seller, category); ``left`` keeps unknown products as a
    NULL category group, ``inner`` drops them."""
    return (
        items.select("seller_id", "product_id", "price")
        .join(products.select("product_id", CAT), "product_id", how)
        .groupBy("seller_id", CAT)
        .agg(F.sum("price").alias("category_revenue"))
    )


def _q5_out(metrics: DataFrame, top: DataFrame, label: str) -> DataFrame:
    out = metrics.join(top.select("seller_id", CAT), "seller_id", "left").select(
        "seller_id",
        "total_orders_count",
        round2("_rev").alias("total_revenue"),
        F.coalesce(_c(CAT), F.lit(label)).alias("top_category_name"),
        "_rev",
    )
    # the reference sorts by the unrounded revenue
    return out.orderBy(_c("_rev").desc_nulls_first(), _c("seller_id").asc()).drop("_rev")


def seller_top_category(
    sellers: DataFrame, items: DataFrame, products: DataFrame,
    min_revenue: float = 1000, label: str = LABEL_UNCATEGORISED,
) -> DataFrame:
    """Q5L: sellers above ``min_revenue``: orders, revenue and the category
    with the greatest revenue (unknown products form a NULL group; ties go
    to the smallest category, NULL first)."""
    metrics = _seller_metrics(sellers, items, min_revenue)
    cats = category_revenue(items, products, "left").join(metrics.select("seller_id"), "seller_id", "left_semi")
    return _q5_out(metrics, top_per_group(cats, ["seller_id"], top_category_order()), label)


def seller_top_category_known(
    sellers: DataFrame, items: DataFrame, products: DataFrame,
    min_revenue: float = 1000, label: str = LABEL_UNCATEGORIZED,
) -> DataFrame:
    """Q5O: as Q5L, but the category search joins products (inner): items of
    unknown products are left out of the search (DISTINCT ON form)."""
    metrics = _seller_metrics(sellers, items, min_revenue)
    cats = category_revenue(items, products, "inner").join(metrics.select("seller_id"), "seller_id")
    return _q5_out(metrics, top_per_group(cats, ["seller_id"], top_category_order()), label)
