"""Declared schemas for the raw and the clean layer. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()
_TS = T.TimestampNTZType()
_MONEY = T.DecimalType(12, 2)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Raw layer: as delivered. Timestamps are text, nothing is a key yet.
RAW = {
    "orders": _struct(
        ("order_id", _L), ("customer_id", _L), ("order_status", _S),
        ("order_purchase_timestamp", _S), ("order_approved_at", _S),
    ),
    "order_items": _struct(
        ("order_id", _L), ("order_item_id", _I), ("product_id", _L),
        ("seller_id", _L), ("price", _MONEY),
    ),
    "payments": _struct(
        ("order_id", _L), ("payment_sequential", _I), ("payment_type", _S),
        ("payment_value", _MONEY),
    ),
    "reviews": _struct(("review_id", _L), ("order_id", _L)),
    "customers": _struct(("customer_id", _L), ("customer_unique_id", _L)),
    "sellers": _struct(("seller_id", _L), ("seller_city", _S), ("seller_state", _S)),
    "products": _struct(("product_id", _L), ("product_category_name", _S)),
    "translation": _struct(
        ("product_category_name", _S), ("product_category_name_english", _S)
    ),
}

# Clean layer: the two order timestamps are typed, zone-free.
CLEAN = dict(RAW)
CLEAN["orders"] = _struct(
    ("order_id", _L), ("customer_id", _L), ("order_status", _S),
    ("order_purchase_timestamp", _TS), ("order_approved_at", _TS),
)

# Keys of each table (primary key columns), used by the checks and dedupe.
PRIMARY_KEYS = {
    "orders": ["order_id"],
    "order_items": ["order_id", "order_item_id"],
    "payments": ["order_id", "payment_sequential"],
    "reviews": ["review_id"],
    "customers": ["customer_id"],
    "sellers": ["seller_id"],
    "products": ["product_id"],
    "translation": ["product_category_name"],
}

# (child, fk column, parent, parent key, action on parent delete)
FOREIGN_KEYS = [
    ("order_items", "order_id", "orders", "order_id", "cascade"),
    ("payments", "order_id", "orders", "order_id", "cascade"),
    ("reviews", "order_id", "orders", "order_id", "cascade"),
    ("order_items", "product_id", "products", "product_id", "cascade"),
    ("order_items", "seller_id", "sellers", "seller_id", "cascade"),
    ("orders", "customer_id", "customers", "customer_id", "restrict"),
    ("products", "product_category_name", "translation", "product_category_name", "set_null"),
]

# Timestamp columns that arrive as text.
TEXT_TIMESTAMPS = ["order_purchase_timestamp", "order_approved_at"]
