"""The commerce tables, derived from the driver's TPC-H-style parquet tables.

Every table is a lazy projection (or, for payments, an aggregation) of the
given files, so column pruning and filters reach the parquet scan and the
work grows with the data. Mapping (FIXTURES.md section B):

    order_items  <- lineitem      payments  <- lineitem by (order, returnflag)
    orders       <- orders        reviews   <- events
    customers    <- customer      sellers   <- supplier + nation + region
    products     <- part          translation <- literal rows (bounded)
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.scalars import MONEY
from ledgerline.sources.schemas import RAW

# Fixed values of the fixture (FIXTURES.md): the order status playing
# "delivered", the brand that has no category, the brands missing from the
# translation table, and the payment sequence of each return flag.
DELIVERED_STATUS = "F"
NULL_CATEGORY_BRAND = "Brand#13"
BLANK_CATEGORY_TEXT = "  "
UNTRANSLATED_BRANDS = ("Brand#7", "Brand#21")
BRAND_COUNT = 25
PAYMENT_SEQUENCE = {"A": 1, "N": 2, "R": 3}
PERSON_IDS_PER_CUSTOMER = 3
TEXT_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
# Raw-text defects injected for the quarantine check.
BAD_TEXT_EVERY, BAD_TEXT = 997, "not a date"
EMPTY_TEXT_EVERY = 991
# Broken lines of the order dump, by order id: (every, rest). The first that
# applies: the last field is missing, a field too many, a customer id that is text.
SHORT_LINE, LONG_LINE, TEXT_CUSTOMER = (499, 0), (503, 1), (509, 2)
TEXT_CUSTOMER_PREFIX, LONG_LINE_END = "C-", ",?"


# Declared schemas of the driver's parquet files: reading with a schema
# skips the footer-inference job Spark would otherwise run per read.
_I, _L, _D, _S, _TS = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()
DRIVER_SCHEMAS = {
    "region": [("r_regionkey", _I), ("r_name", _S)],
    "nation": [("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)],
    "customer": [("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I), ("c_acctbal", _D), ("c_mktsegment", _S)],
    "supplier": [("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)],
    "part": [("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S), ("p_size", _I),
             ("p_retailprice", _D)],
    "orders": [("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S), ("o_totalprice", _D),
               ("o_orderdate", _TS), ("o_orderpriority", _S)],
    "lineitem": [("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L), ("l_linenumber", _I),
                 ("l_quantity", _D), ("l_extendedprice", _D), ("l_discount", _D), ("l_tax", _D),
                 ("l_returnflag", _S), ("l_linestatus", _S), ("l_shipdate", _TS)],
    "events": [("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S), ("value", _D), ("props", _S)],
}

@dataclass(frozen=True)
class Tables:
    orders: DataFrame
    order_items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    customers: DataFrame
    sellers: DataFrame
    products: DataFrame
    translation: DataFrame


class LazyTables(Tables):
    """``Tables`` whose members are built when first asked for: an analysis that
    reads three tables lists the files of three. Members may be given as
    DataFrames too, so ``dataclasses.replace`` works as for ``Tables``."""

    def __init__(self, **members: Callable[[], DataFrame] | DataFrame) -> None:
        self.__dict__["_builders"] = {name: m for name, m in members.items() if not isinstance(m, DataFrame)}
        self.__dict__.update({name: m for name, m in members.items() if isinstance(m, DataFrame)})

    def __getattr__(self, name: str) -> DataFrame:
        try:
            build = self.__dict__["_builders"][name]
        except KeyError:
            raise AttributeError(name) from None
        self.__dict__[name] = build()
        return self.__dict__[name]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = T.StructType([T.StructField(n, t, True) for n, t in DRIVER_SCHEMAS[name]])
    return spark.read.schema(schema).parquet(os.path.join(sf_dir, f"{name}.parquet"))


def translation_rows() -> list[tuple[str, str]]:
    """Translation rows: every brand but the untranslated ones (rule-built)."""
    rows = []
    for i in range(1, BRAND_COUNT + 1):
        name = f"Brand#{i}"
        if name not in UNTRANSLATED_BRANDS:
            rows.append((name, f"brand_{i}"))
    return rows


def translation(spark: SparkSession) -> DataFrame:
    """S3: an inline literal table with a declared schema."""
    return spark.createDataFrame(translation_rows(), RAW["translation"])


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
    )


def order_items_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the column that tells which stored copy came later.

    Parquet has no physical row address; the ship date stands in for the
    load time and (product, seller, price) complete a total order.
    """
    li = _read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        F.col("l_shipdate").alias("loaded_at"),
    )


def net_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id and the price after discount, in double precision as stored."""
    li = _read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("product_id"), (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("net_price"))


def customer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id with its market segment (used to pick rows to act on)."""
    c = _read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payment per (order, return flag): several payments per order."""
    li = _read(spark, sf_dir, "lineitem")
    seq = F.col("l_returnflag")
    seq_expr = F.lit(None).cast("int")
    for k, v in sorted(PAYMENT_SEQUENCE.items(), key=lambda kv: kv[1], reverse=True):
        seq_expr = F.when(seq == F.lit(k), F.lit(v)).otherwise(seq_expr)
    return (
        li.groupBy("l_orderkey", "l_returnflag")
        .agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("payment_value"))
        .select(
            F.col("l_orderkey").alias("order_id"),
            seq_expr.alias("payment_sequential"),
            F.col("l_returnflag").alias("payment_type"),
            "payment_value",
        )
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean orders: typed timestamps; 'approved' is unknown for open orders."""
    o = _read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        F.when(F.col("o_orderstatus") != F.lit("O"), F.col("o_orderdate")).alias("order_approved_at"),
    )


def raw_orders(spark: SparkSession, sf_dir: str, defects: bool = False) -> DataFrame:
    """Orders as delivered: timestamps as text; optionally with bad text."""
    o = _read(spark, sf_dir, "orders")
    purchase = F.date_format("o_orderdate", TEXT_TS_FORMAT)
    if defects:
        key = F.col("o_orderkey")
        purchase = (
            F.when(key % BAD_TEXT_EVERY == 0, F.lit(BAD_TEXT))
            .when(key % EMPTY_TEXT_EVERY == 0, F.lit(""))
            .otherwise(purchase)
        )
    approved = F.when(F.col("o_orderstatus") != F.lit("O"), F.date_format("o_orderdate", TEXT_TS_FORMAT))
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
        approved.alias("order_approved_at"),
    )


def order_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw orders as lines of a CSV dump without a header, some of them broken."""
    o = raw_orders(spark, sf_dir)

    def breaks(rule: tuple[int, int]) -> Column:
        return F.col("order_id") % F.lit(rule[0]) == F.lit(rule[1])

    short, long = breaks(SHORT_LINE), breaks(LONG_LINE) & ~breaks(SHORT_LINE)
    text = breaks(TEXT_CUSTOMER) & ~breaks(SHORT_LINE) & ~breaks(LONG_LINE)
    quoted = F.concat(F.lit('"'), F.col("order_purchase_timestamp"), F.lit('"'))
    return o.select(F.concat(
        F.col("order_id").cast("string"), F.lit(","),
        F.when(text, F.lit(TEXT_CUSTOMER_PREFIX)).otherwise(F.lit("")), F.col("customer_id").cast("string"), F.lit(","),
        F.col("order_status"), F.lit(","), quoted,
        F.when(short, F.lit("")).otherwise(F.concat(F.lit(","), F.coalesce("order_approved_at", F.lit("")))),
        F.when(long, F.lit(LONG_LINE_END)).otherwise(F.lit("")),
    ).alias("line"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("customer_id"),
        F.floor(F.col("c_custkey") / F.lit(PERSON_IDS_PER_CUSTOMER)).cast("bigint").alias("customer_unique_id"),
    )


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier with its nation as city and region as state.

    nation (25 rows) and region (5 rows) are fixed-size dimensions, so
    broadcasting them is bounded regardless of the scale factor.
    """
    s = _read(spark, sf_dir, "supplier")
    n = _read(spark, sf_dir, "nation")
    r = _read(spark, sf_dir, "region")
    geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", F.col("n_name").alias("seller_city"), F.col("r_name").alias("seller_state")
    )
    return s.join(F.broadcast(geo), s.s_nationkey == geo.n_nationkey).select(
        F.col("s_suppkey").alias("seller_id"), "seller_city", "seller_state"
    )


def products(spark: SparkSession, sf_dir: str, blank: bool = False) -> DataFrame:
    """Part as product; one brand has no category (NULL, or blank text raw)."""
    p = _read(spark, sf_dir, "part")
    missing = F.lit(BLANK_CATEGORY_TEXT) if blank else F.lit(None).cast("string")
    cat = F.when(F.col("p_brand") == F.lit(NULL_CATEGORY_BRAND), missing).otherwise(F.col("p_brand"))
    return p.select(F.col("p_partkey").alias("product_id"), cat.alias("product_category_name"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every review id twice; a quarter of the rows point at no order."""
    e = _read(spark, sf_dir, "events")
    return e.select(
        F.floor(F.col("event_id") / F.lit(2)).cast("bigint").alias("review_id"),
        (F.col("event_id") * F.lit(2)).alias("order_id"),
    )


def _lazy(spark: SparkSession, sf_dir: str, **own: Callable[[], DataFrame]) -> LazyTables:
    builders = {
        build.__name__: (lambda build=build: build(spark, sf_dir))
        for build in (orders, order_items, payments, reviews, customers, sellers, products)
    }
    return LazyTables(**(builders | {"translation": lambda: translation(spark)} | own))


def commerce_tables(spark: SparkSession, sf_dir: str) -> LazyTables:
    """The analysis-ready tables (typed timestamps, NULL category): lazy plans
    over the files that are in the folder now, without hints."""
    return _lazy(spark, sf_dir)


def raw_tables(spark: SparkSession, sf_dir: str, defects: bool = False) -> LazyTables:
    """The raw layer: text timestamps, blank categories, duplicates kept."""
    return _lazy(
        spark, sf_dir, orders=lambda: raw_orders(spark, sf_dir, defects=defects), products=lambda: products(spark, sf_dir, blank=True)
    )
