"""Independent SQL for every registered query (DuckDB dialect).

The statements are written from the definitions of the analyses and
operators, over the same table mapping as ``ledgerline.sources.tables``, plus
the stated tie-breaks: one CTE per measure, a top row by ``QUALIFY``, distinct
counts by grouping twice, subtotals as a union of levels. They are *not*
transcriptions of the Spark plans, so a passing comparison checks the
pre-aggregation rewrites too.

Rounding has rules of its own here, apart from the Spark side's decimals:
``ratio`` divides whole cents in integers, ``median`` orders whole cents (a
midpoint of two is exact in binary), ``r2`` rounds a statistic in doubles.
"""

from __future__ import annotations

from ledgerline.sources import tables as tb


def r2(expr: str) -> str:
    """A statistic in double precision, rounded to two digits."""
    return f"ROUND(CAST({expr} AS DOUBLE), 2)"


def ratio(cents: str, n: str) -> str:
    """Non-negative cents by a count, half a cent up, in money as double."""
    return f"CAST((2 * ({cents}) + ({n})) // (2 * ({n})) AS DOUBLE) / 100"


def median(cents: str) -> str:
    """Continuous median of whole cents, half a cent up, in money as double."""
    return f"ROUND(QUANTILE_CONT(CAST({cents} AS DOUBLE), 0.5)) / 100"


def union_of_levels(levels: list[list[str]], keys: list[str], measures: str, source: str, flags: dict[str, str]) -> str:
    """Subtotals: one grouped SELECT per level; keys outside a level are NULL
    and their flag is 1."""
    parts = []
    for level in levels:
        shown = [k if k in level else f"CAST(NULL AS VARCHAR) AS {k}" for k in keys]
        marks = [f"{int(k not in level)} AS {name}" for k, name in flags.items()]
        group = f" GROUP BY {', '.join(level)}" if level else ""
        parts.append(f"SELECT {', '.join([*shown, *marks])}, {measures} FROM {source}{group}")
    return "\nUNION ALL\n".join(parts)


def _translation_values() -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in tb.translation_rows())


def _payment_sequence_case() -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(tb.PAYMENT_SEQUENCE.items()))
    return f"CASE l_returnflag {arms} END"


def fixture_ctes() -> str:
    """The commerce tables as CTEs over the driver's views."""
    return f"""
t_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_suppkey AS seller_id, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS cents
  FROM lineitem),
t_payments AS (
  SELECT l_orderkey AS order_id, {_payment_sequence_case()} AS payment_sequential,
         l_returnflag AS payment_type,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(12,2)) AS payment_value
  FROM lineitem GROUP BY l_orderkey, l_returnflag),
t_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
         o_orderdate AS order_purchase_timestamp,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS order_approved_at
  FROM orders),
t_customers AS (
  SELECT c_custkey AS customer_id, CAST(floor(c_custkey / {tb.PERSON_IDS_PER_CUSTOMER}) AS BIGINT) AS customer_unique_id
  FROM customer),
t_sellers AS (
  SELECT s_suppkey AS seller_id, n_name AS seller_city, r_name AS seller_state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
t_products AS (
  SELECT p_partkey AS product_id,
         CASE WHEN p_brand = '{tb.NULL_CATEGORY_BRAND}' THEN NULL ELSE p_brand END AS product_category_name
  FROM part),
t_products_raw AS (
  SELECT p_partkey AS product_id,
         CASE WHEN p_brand = '{tb.NULL_CATEGORY_BRAND}' THEN '{tb.BLANK_CATEGORY_TEXT}' ELSE p_brand END AS product_category_name
  FROM part),
t_reviews AS (
  SELECT CAST(floor(event_id / 2) AS BIGINT) AS review_id, event_id * 2 AS order_id FROM events),
t_translation AS (
  SELECT * FROM (VALUES {_translation_values()}) v(product_category_name, product_category_name_english)),
t_orders_raw AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_purchase_timestamp,
         CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS order_approved_at
  FROM orders),
t_items_loaded AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_suppkey AS seller_id, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, l_shipdate AS loaded_at
  FROM lineitem),
t_products_clean AS (
  SELECT product_id,
         CASE WHEN trim(product_category_name) <> '' THEN product_category_name END AS product_category_name
  FROM t_products_raw),
t_segments AS (SELECT c_custkey AS customer_id, c_mktsegment AS segment FROM customer),
t_orders_bad AS (
  SELECT order_id, customer_id, order_status,
         CASE WHEN order_id % {tb.BAD_TEXT_EVERY} = 0 THEN '{tb.BAD_TEXT}'
              WHEN order_id % {tb.EMPTY_TEXT_EVERY} = 0 THEN ''
              ELSE order_purchase_timestamp END AS order_purchase_timestamp,
         order_approved_at
  FROM t_orders_raw)"""


def with_fixtures(body: str, ctes: str = "") -> str:
    extra = f",\n{ctes}" if ctes else ""
    return f"WITH {fixture_ctes()}{extra}\n{body}"


# ---------------------------------------------------------------------------
# Analyses
# ---------------------------------------------------------------------------

REGION = ["seller_state", "seller_city"]
CATEGORY_TYPE = ["product_category_name", "payment_type"]
CATEGORY_TYPE_SETS = [CATEGORY_TYPE, CATEGORY_TYPE[:1], CATEGORY_TYPE[1:]]


def q1_rollup(min_revenue: float) -> str:
    return with_fixtures(f"""
SELECT s.seller_city, s.seller_state,
       CAST(SUM(i.price) AS DOUBLE) AS total,
       COUNT(DISTINCT i.order_id) AS uq_orders_count,
       {ratio('SUM(i.cents)', 'COUNT(DISTINCT i.order_id)')} AS avg_order_value,
       {r2('STDDEV_SAMP(i.price)')} AS price_sttdev
FROM t_sellers s JOIN t_items i ON s.seller_id = i.seller_id
GROUP BY ROLLUP (s.seller_state, s.seller_city)
HAVING SUM(i.price) > {min_revenue}
ORDER BY s.seller_state NULLS FIRST, s.seller_city NULLS FIRST, total DESC NULLS FIRST""")


BASKET_CTE = """basket AS (
  SELECT seller_id, order_id, SUM(price) AS amount, SUM(cents) AS amount_cents, COUNT(*) AS n_lines
  FROM t_items GROUP BY ALL)"""


def q1_rollup_by_order(min_revenue: float) -> str:
    measures = f"""CAST(SUM(amount) AS DOUBLE) AS total, COUNT(order_id) AS uq_orders_count,
  {ratio('SUM(amount_cents)', 'COUNT(order_id)')} AS avg_order_value, {r2('STDDEV_SAMP(amount / n_lines)')} AS price_sttdev"""
    levels = union_of_levels([REGION, REGION[:1], []], REGION, measures, "basket JOIN t_sellers USING (seller_id)", {})
    return with_fixtures(f"""
FROM level SELECT seller_city, seller_state, total, uq_orders_count, avg_order_value, price_sttdev
WHERE total > {min_revenue}
ORDER BY seller_state NULLS FIRST, seller_city NULLS FIRST, total DESC NULLS FIRST""", BASKET_CTE + f""",
level AS ({levels})""")


def q2_sets(min_total: float, min_orders: int) -> str:
    return with_fixtures(f"""
SELECT p.product_category_name, pay.payment_type,
       CAST(GROUPING(p.product_category_name) AS INTEGER) AS is_cat_aggaregated,
       CAST(GROUPING(pay.payment_type) AS INTEGER) AS is_pay_aggregated,
       CAST(SUM(pay.payment_value) AS DOUBLE) AS total,
       COUNT(DISTINCT i.order_id) AS uq_orders_count,
       {median('pay.payment_value * 100')} AS median_payment
FROM t_items i
JOIN t_payments pay ON i.order_id = pay.order_id
JOIN t_products p ON i.product_id = p.product_id
GROUP BY GROUPING SETS ((p.product_category_name, pay.payment_type), (p.product_category_name), (pay.payment_type))
HAVING SUM(pay.payment_value) > {min_total} AND COUNT(DISTINCT i.order_id) > {min_orders}
ORDER BY is_cat_aggaregated, uq_orders_count DESC, is_pay_aggregated,
         p.product_category_name NULLS LAST, pay.payment_type NULLS LAST""")


ORDER_LEVEL_CTE = """order_level AS (
  SELECT payment_type, product_category_name, order_id, SUM(payment_value) AS payment_value,
         SUM(CAST(payment_value * 100 AS BIGINT)) AS pay_cents
  FROM t_items JOIN t_products USING (product_id) JOIN t_payments USING (order_id)
  GROUP BY ALL)"""

UNION_ORDER = """ORDER BY grouping_category, unique_orders DESC, grouping_payment,
         product_category_name NULLS LAST, payment_type NULLS LAST"""


def q2_sets_by_order(min_total: float, min_orders: int) -> str:
    measures = f"SUM(payment_value) AS total, COUNT(DISTINCT order_id) AS uq_orders, {median('pay_cents')} AS middle"
    levels = union_of_levels(
        CATEGORY_TYPE_SETS, CATEGORY_TYPE, measures, "order_level",
        {"product_category_name": "grouping_category", "payment_type": "grouping_payment"},
    )
    return with_fixtures(f"""
FROM level
SELECT product_category_name, payment_type, CAST(total AS DOUBLE) AS total_payment, uq_orders,
       CASE grouping_category + grouping_payment WHEN 0 THEN middle END AS median_payment, grouping_category, grouping_payment
WHERE total > {min_total} AND uq_orders > {min_orders}
ORDER BY grouping_category, uq_orders DESC, grouping_payment, product_category_name NULLS LAST, payment_type NULLS LAST""",
        ORDER_LEVEL_CTE + f""",
level AS ({levels})""")


def _levels_of_orders(levels: list[list[str]], source: str, min_total: float, min_orders: int) -> str:
    """Totals and orders per level; rows are grouped by order first, so that a
    plain count gives the distinct orders."""
    parts = []
    for level in levels:
        shown = ", ".join(k if k in level else f"CAST(NULL AS VARCHAR) AS {k}" for k in CATEGORY_TYPE)
        marks = ", ".join(
            f"{int(k not in level)} AS {name}" for k, name in zip(CATEGORY_TYPE, ("grouping_category", "grouping_payment"))
        )
        parts.append(f"""SELECT {shown}, CAST(SUM(of_order) AS DOUBLE) AS total_payment, COUNT(*) AS unique_orders, {marks}
  FROM (SELECT {', '.join(level)}, order_id, SUM(payment_value) AS of_order FROM {source} GROUP BY ALL)
  GROUP BY {', '.join(level)} HAVING SUM(of_order) > {min_total} AND COUNT(*) > {min_orders}""")
    return "\nUNION ALL\n".join(parts)


def x1_union_filtered(min_total: float, min_orders: int) -> str:
    pairs = _levels_of_orders([CATEGORY_TYPE], "order_level", min_total, min_orders)
    subtotals = _levels_of_orders(CATEGORY_TYPE_SETS[1:], "of_passing", min_total, min_orders)
    return with_fixtures(f"""
FROM passing UNION ALL
{subtotals}
{UNION_ORDER}""", ORDER_LEVEL_CTE + f""",
passing AS ({pairs}),
of_passing AS (FROM order_level SEMI JOIN passing USING (product_category_name, payment_type))""")


def x2_union(min_total: float, min_orders: int) -> str:
    levels = _levels_of_orders(CATEGORY_TYPE_SETS, "order_level", min_total, min_orders)
    return with_fixtures(f"{levels}\n{UNION_ORDER}", ORDER_LEVEL_CTE)


def q3_dispersion(min_revenue: float, min_orders: int, min_cv: float) -> str:
    cv = "STDDEV_SAMP(i.price) / (SUM(i.cents) / 100.0 / COUNT(*)) * 100"
    return with_fixtures(f"""
SELECT s.seller_city, s.seller_state,
       CAST(GROUPING(s.seller_city) AS INTEGER) AS is_state_summary,
       COUNT(DISTINCT s.seller_id) AS sellers_count,
       COUNT(DISTINCT i.order_id) AS orders_count,
       CAST(SUM(i.price) AS DOUBLE) AS total_revenue,
       {r2('VAR_SAMP(i.price)')} AS price_variance,
       {r2(cv)} AS cv
FROM t_sellers s
JOIN t_items i ON s.seller_id = i.seller_id
JOIN t_payments pay ON i.order_id = pay.order_id
GROUP BY GROUPING SETS ((s.seller_state, s.seller_city), (s.seller_state))
HAVING SUM(i.price) > {min_revenue} AND COUNT(DISTINCT i.order_id) > {min_orders} AND {cv} > {min_cv}
ORDER BY s.seller_state NULLS LAST, is_state_summary DESC, total_revenue DESC NULLS FIRST, s.seller_city NULLS LAST""")


def q3_volatile_regions(min_revenue: float, min_orders: int, min_cv: float) -> str:
    measures = f"""CAST(SUM(revenue) AS DOUBLE) AS total_revenue, CAST(SUM(n_orders) AS BIGINT) AS orders_count,
  {ratio('SUM(cv_hundredths)', 'COUNT(cv_hundredths)')} AS avg_cv, COUNT(DISTINCT seller_id) AS sellers_count"""
    levels = union_of_levels(
        [REGION, REGION[:1]], REGION, measures, "volatile JOIN t_sellers USING (seller_id)", {"seller_city": "is_state_summary"}
    )
    return with_fixtures(f"""
{levels}
ORDER BY seller_state NULLS LAST, is_state_summary DESC, total_revenue DESC NULLS FIRST, seller_city NULLS LAST""",
        BASKET_CTE + f""",
visits AS (SELECT seller_id, COUNT(order_id) AS n_orders FROM basket GROUP BY ALL),
prices AS (
  SELECT seller_id, SUM(price) AS revenue, STDDEV_SAMP(price) / (SUM(cents) / 100.0 / COUNT(*)) * 100 AS cv
  FROM t_items GROUP BY ALL),
volatile AS (
  SELECT seller_id, revenue, n_orders, CAST(ROUND(cv * 100) AS BIGINT) AS cv_hundredths
  FROM prices JOIN visits USING (seller_id)
  WHERE revenue > {min_revenue} AND n_orders > {min_orders} AND cv > {min_cv})""")


LABEL_CTE = """item_label AS (
  SELECT i.order_id, i.price, COALESCE(p.product_category_name, 'Uncategorized') AS label
  FROM t_items i LEFT JOIN t_products p USING (product_id)),
dearest AS (
  FROM item_label SELECT order_id, label
  QUALIFY ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY price DESC NULLS FIRST, label) = 1),
spent AS (SELECT order_id, SUM(price) AS amount FROM t_items GROUP BY ALL)"""


def _ltv(min_orders: int, vip: float, high: float, delivered: str, first_id_only: bool) -> str:
    among = " AND owned.customer_id = person.first_id" if first_id_only else ""
    return with_fixtures(f"""
SELECT customer_unique_id, n_orders AS total_orders_count, CAST(worth AS DOUBLE) AS lifetime_value,
       CASE WHEN worth > {vip} THEN 'VIP' WHEN worth >= {high} THEN 'High Value' ELSE 'Standard' END AS customer_segment,
       newest.order_id AS latest_order_id, newest.order_purchase_timestamp AS latest_order_date,
       CAST(COALESCE(spent.amount, 0) AS DOUBLE) AS latest_order_amount,
       COALESCE(dearest.label, 'Uncategorized') AS latest_order_top_category
FROM person LEFT JOIN newest USING (customer_unique_id)
LEFT JOIN spent ON spent.order_id = newest.order_id
LEFT JOIN dearest ON dearest.order_id = newest.order_id
ORDER BY lifetime_value DESC NULLS FIRST, customer_unique_id""", LABEL_CTE + f""",
owned AS (FROM t_customers JOIN t_orders USING (customer_id)),
person AS (
  SELECT customer_unique_id, MIN(customer_id) AS first_id, COUNT(DISTINCT order_id) AS n_orders, COALESCE(SUM(amount), 0) AS worth
  FROM owned LEFT JOIN spent USING (order_id) GROUP BY customer_unique_id
  HAVING COUNT(DISTINCT order_id) > {min_orders}),
newest AS (
  SELECT owned.customer_unique_id, order_id, order_purchase_timestamp
  FROM owned JOIN person ON owned.customer_unique_id = person.customer_unique_id{among}
  WHERE order_status = '{delivered}'
  QUALIFY ROW_NUMBER() OVER (
    PARTITION BY owned.customer_unique_id ORDER BY order_purchase_timestamp DESC NULLS FIRST, order_id) = 1)""")


def q4_ltv_latest(min_orders: int, vip: float, high: float, delivered: str) -> str:
    return _ltv(min_orders, vip, high, delivered, False)


def q4_ltv_first_id(min_orders: int, vip: float, high: float, delivered: str) -> str:
    return _ltv(min_orders, vip, high, delivered, True)


def _best_category(min_revenue: float, join: str, label: str) -> str:
    return with_fixtures(f"""
SELECT seller_id, n_orders AS total_orders_count, CAST(earned AS DOUBLE) AS total_revenue,
       COALESCE(best.product_category_name, '{label}') AS top_category_name
FROM income JOIN visits USING (seller_id) LEFT JOIN best USING (seller_id)
ORDER BY earned DESC NULLS FIRST, seller_id""", f"""
income AS (
  SELECT seller_id, COALESCE(SUM(price), 0) AS earned FROM t_items SEMI JOIN t_sellers USING (seller_id)
  GROUP BY ALL HAVING COALESCE(SUM(price), 0) > {min_revenue}),
visits AS (SELECT seller_id, COUNT(order_id) AS n_orders FROM (SELECT DISTINCT seller_id, order_id FROM t_items) GROUP BY ALL),
best AS (
  SELECT seller_id, product_category_name FROM t_items {join} t_products USING (product_id)
  GROUP BY seller_id, product_category_name
  QUALIFY ROW_NUMBER() OVER (PARTITION BY seller_id ORDER BY SUM(price) DESC NULLS FIRST, product_category_name NULLS FIRST) = 1)""")


def q5_top_category(min_revenue: float) -> str:
    return _best_category(min_revenue, "LEFT JOIN", "Uncategorised")


def q5_top_category_known(min_revenue: float) -> str:
    return _best_category(min_revenue, "JOIN", "Uncategorized")


# ---------------------------------------------------------------------------
# Operator-level queries
# ---------------------------------------------------------------------------

def _ops_sql() -> dict[str, str]:
    from ledgerline.plans import operator_queries as oq
    from ledgerline.plans.catalog import Q4_HIGH, Q4_VIP, X_MIN_ORDERS, X_MIN_TOTAL
    from ledgerline.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS

    q: dict[str, str] = {}
    w = with_fixtures
    q["d1_text_to_ts"] = w("""
SELECT order_id, customer_id, order_status,
       CAST(order_purchase_timestamp AS TIMESTAMP) AS order_purchase_timestamp,
       CAST(order_approved_at AS TIMESTAMP) AS order_approved_at
FROM t_orders_raw""")
    q["d1_quarantine"] = w(" UNION ALL ".join(
        f"""SELECT order_id, '{c}' AS column_name, {c} AS raw_value FROM t_orders_bad
            WHERE {c} IS NOT NULL AND TRY_CAST({c} AS TIMESTAMP) IS NULL"""
        for c in ("order_purchase_timestamp", "order_approved_at")))
    # a copy is removed when a later copy with the same key exists
    q["d5_dedupe_items"] = w("""
SELECT order_id, order_item_id, product_id, seller_id, CAST(price AS DOUBLE) AS price, loaded_at
FROM t_items_loaded a
WHERE a.order_id IS NULL OR a.order_item_id IS NULL OR NOT EXISTS (
  SELECT 1 FROM t_items_loaded b
  WHERE b.order_id = a.order_id AND b.order_item_id = a.order_item_id
    AND (b.loaded_at > a.loaded_at
         OR (b.loaded_at = a.loaded_at AND b.product_id > a.product_id)
         OR (b.loaded_at = a.loaded_at AND b.product_id = a.product_id AND b.seller_id > a.seller_id)
         OR (b.loaded_at = a.loaded_at AND b.product_id = a.product_id AND b.seller_id = a.seller_id
             AND b.price > a.price)))""")
    q["d5_dedupe_reviews"] = w("""
SELECT review_id, order_id FROM t_reviews a
WHERE a.review_id IS NULL OR NOT EXISTS (
  SELECT 1 FROM t_reviews b WHERE b.review_id = a.review_id AND b.order_id > a.order_id)""")
    q["d10_blank_to_null"] = w("SELECT product_id, product_category_name FROM t_products_clean")
    q["d12_insert_absent"] = w(f"""
SELECT product_category_name, product_category_name_english FROM t_translation
UNION ALL
SELECT n.product_category_name, n.product_category_name_english
FROM (SELECT DISTINCT product_category_name,
             lower(replace(product_category_name, 'Brand#', '{oq.NEW_TRANSLATION_PREFIX}')) AS product_category_name_english
      FROM t_products_clean WHERE product_category_name IS NOT NULL) n
WHERE n.product_category_name NOT IN (SELECT product_category_name FROM t_translation)""")

    raw_cols = {
        "orders": ("t_orders_bad", ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at"]),
        "order_items": ("t_items", ["order_id", "order_item_id", "product_id", "seller_id", "price"]),
        "payments": ("t_payments", ["order_id", "payment_sequential", "payment_type", "payment_value"]),
        "reviews": ("t_reviews", ["review_id", "order_id"]),
        "customers": ("t_customers", ["customer_id", "customer_unique_id"]),
        "sellers": ("t_sellers", ["seller_id", "seller_city", "seller_state"]),
        "products": ("t_products_raw", ["product_id", "product_category_name"]),
        "translation": ("t_translation", ["product_category_name", "product_category_name_english"]),
    }
    text_cols = {
        "orders": ["order_status", "order_purchase_timestamp", "order_approved_at"], "payments": ["payment_type"],
        "sellers": ["seller_city", "seller_state"], "products": ["product_category_name"],
        "translation": ["product_category_name", "product_category_name_english"],
    }

    def orphans(relation: str, child: str, fk: str, parent: str, key: str, extra: str = "") -> str:
        return f"""SELECT {relation}, COUNT(*) AS orphan_rows, COUNT(DISTINCT {fk}) AS missing_keys{extra}
FROM {child} WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {key} FROM {parent} WHERE {key} IS NOT NULL)"""

    def bad_keys(source: str, keys: list[str]) -> str:
        nulls = " OR ".join(f"{k} IS NULL" for k in keys)
        return f"(SELECT {', '.join(keys)} FROM {source} GROUP BY ALL HAVING COUNT(*) > 1 OR {nulls})"

    def counted(name: str, check: str, column: str, condition: str) -> str:
        return f"""SELECT '{name}' AS table_name, '{check}' AS check_name, '{column}' AS column_name,
  COUNT(*) FILTER (WHERE {condition}) AS n_bad FROM {raw_cols[name][0]}"""

    parts = [counted(n, "null_values", c, f"{c} IS NULL") for n, (_, cols) in raw_cols.items() for c in cols]
    parts += [counted(n, "blank_text", c, f"trim({c}) = ''") for n, cols in text_cols.items() for c in cols]
    parts += [
        counted("orders", "unparsable_timestamp", c, f"{c} IS NOT NULL AND TRY_CAST({c} AS TIMESTAMP) IS NULL")
        for c in ("order_purchase_timestamp", "order_approved_at")
    ]
    for name, keys in PRIMARY_KEYS.items():
        parts.append(f"SELECT '{name}', 'key_violations', '{','.join(keys)}', COUNT(*) FROM {bad_keys(raw_cols[name][0], keys)}")
    for child, fk, parent, key, _ in FOREIGN_KEYS:
        found = orphans("1", raw_cols[child][0], fk, raw_cols[parent][0], key)
        parts.append(f"SELECT '{child}', 'orphans', '{fk}', orphan_rows FROM ({found})")
    q["d13_profile"] = w("\nUNION ALL\n".join(parts))
    # the checks of single queries below look at the repaired products
    raw_cols["products"] = ("t_products_clean", raw_cols["products"][1])
    pk = PRIMARY_KEYS

    # Typed, de-duplicated by the load order of the fixture, repaired
    def last(name: str) -> str:
        by = ", ".join(f"{c} DESC NULLS LAST" for c in oq.LOAD_ORDER[name])
        keys = PRIMARY_KEYS[name]
        nulls = " OR ".join(f"{k} IS NULL" for k in keys)
        return f"""SELECT {', '.join(raw_cols[name][1])} FROM {raw_cols[name][0]}
  QUALIFY {nulls} OR ROW_NUMBER() OVER (PARTITION BY {', '.join(keys)} ORDER BY {by}) = 1"""

    parses = " AND ".join(f"({c} IS NULL OR TRY_CAST({c} AS TIMESTAMP) IS NOT NULL)" for c in ("order_purchase_timestamp", "order_approved_at"))
    steps = [f"c_{n} AS ({last(n)})" for n in ("customers", "order_items", "payments", "reviews")]
    steps += [
        f"""c_orders AS (SELECT order_id, customer_id, order_status, CAST(order_purchase_timestamp AS TIMESTAMP) AS order_purchase_timestamp,
  CAST(order_approved_at AS TIMESTAMP) AS order_approved_at FROM t_orders_bad WHERE {parses})""",
        "c_sellers AS (FROM t_sellers)",
        "c_products AS (FROM t_products_clean)",
        f"""c_translation AS ({last('translation')} UNION ALL
  SELECT DISTINCT product_category_name, lower(replace(product_category_name, 'Brand#', '{oq.NEW_TRANSLATION_PREFIX}'))
  FROM t_products_clean ANTI JOIN t_translation USING (product_category_name) WHERE product_category_name IS NOT NULL)""",
    ]
    cleaned = ",\n".join(steps)

    def d14(body: str) -> str:
        return w(body, cleaned)

    for name, (_, cols) in raw_cols.items():
        shown = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in ("price", "payment_value") else c for c in cols)
        kept = " AND ".join(
            f"({fk} IS NULL OR {fk} IN (SELECT {key} FROM c_{parent}))" for child, fk, parent, key, action in FOREIGN_KEYS if child == name and action == "cascade"
        )
        q[f"d14_clean_{name}"] = d14(f"SELECT {shown} FROM c_{name}" + (f" WHERE {kept}" if kept else ""))
    q["d14_rejected_orders"] = d14(f"FROM t_orders_bad WHERE NOT ({parses})")
    q["d14_missing_categories"] = d14(
        "SELECT DISTINCT product_category_name FROM c_products ANTI JOIN t_translation USING (product_category_name) WHERE product_category_name IS NOT NULL"
    )
    q["d14_key_report"] = d14("\nUNION ALL\n".join(
        f"SELECT '{n}' AS table_name, '{','.join(keys)}' AS key_columns, COUNT(*) AS violations FROM {bad_keys(f'c_{n}', keys)}" for n, keys in PRIMARY_KEYS.items()
    ))
    q["d14_reference_report"] = d14("\nUNION ALL\n".join(
        orphans(f"'{c}.{fk} -> {p}.{key}' AS relation", f"c_{c}", fk, f"c_{p}", key, f", '{action}' AS on_delete") for c, fk, p, key, action in FOREIGN_KEYS
    ))
    q["d14_profile"] = q["d13_profile"]

    single = []
    for name in oq.SINGLE_KEY_TABLES:
        tbl = raw_cols[name][0]
        (k,) = pk[name]
        single.append(f"""SELECT '{name}' AS table_name, CAST({k} AS VARCHAR) AS key_value, COUNT(*) AS n_rows,
       CASE WHEN {k} IS NULL THEN 'null_key' ELSE 'duplicate' END AS problem
FROM {tbl} GROUP BY {k} HAVING COUNT(*) > 1 OR {k} IS NULL""")
    q["d2_pk_single"] = w("\nUNION ALL\n".join(single))
    comp = []
    for name in oq.COMPOSITE_KEY_TABLES:
        tbl = raw_cols[name][0]
        k1, k2 = pk[name]
        comp.append(f"""SELECT '{name}' AS table_name, CAST({k1} AS BIGINT) AS key_1, CAST({k2} AS BIGINT) AS key_2,
       COUNT(*) AS n_rows, CASE WHEN {k1} IS NULL OR {k2} IS NULL THEN 'null_key' ELSE 'duplicate' END AS problem
FROM {tbl} GROUP BY {k1}, {k2} HAVING COUNT(*) > 1 OR {k1} IS NULL OR {k2} IS NULL""")
    q["d3_pk_composite"] = w("\nUNION ALL\n".join(comp))
    rel = []
    for child, fk, parent, ppk, _ in FOREIGN_KEYS:
        ct, pt = raw_cols[child][0], raw_cols[parent][0]
        ct = "t_orders" if ct == "t_orders_bad" else ct
        rel.append(f"""SELECT '{child}.{fk} -> {parent}.{ppk}' AS relation, COUNT(*) AS orphan_rows,
       COUNT(DISTINCT c.{fk}) AS missing_keys
FROM {ct} c LEFT JOIN {pt} p ON p.{ppk} = c.{fk}
WHERE c.{fk} IS NOT NULL AND p.{ppk} IS NULL""")
    q["d4_fk_orphans"] = w("\nUNION ALL\n".join(rel))
    q["d6_cascade"] = w(f"""
SELECT i.order_id, i.order_item_id, i.product_id, i.seller_id, CAST(i.price AS DOUBLE) AS price
FROM t_items i
WHERE i.order_id IS NULL
   OR i.order_id IN (SELECT order_id FROM t_orders WHERE order_status <> '{oq.DELETED_ORDER_STATUS}')""")
    q["d7_restrict"] = w(f"""
SELECT c.customer_id, COUNT(*) AS blocking_rows
FROM (SELECT DISTINCT customer_id FROM t_segments WHERE segment = '{oq.RESTRICTED_SEGMENT}') c
JOIN t_orders o ON o.customer_id = c.customer_id
GROUP BY c.customer_id""")
    deleted = ", ".join(f"'{x}'" for x in oq.DELETED_TRANSLATIONS)
    q["d8_set_null"] = w(f"""
SELECT p.product_id,
       CASE WHEN p.product_category_name IN (SELECT product_category_name FROM t_translation
                                             WHERE product_category_name IN ({deleted}))
            THEN NULL ELSE p.product_category_name END AS product_category_name
FROM t_products p""")
    gone_orders = f"SELECT o.order_id FROM t_orders o JOIN t_segments s USING (customer_id) WHERE s.segment = '{oq.RESTRICTED_SEGMENT}'"
    gone_products = f"SELECT product_id FROM t_products WHERE product_category_name = '{oq.DELETED_CATEGORY}'"
    seg = {name: f"{{}} IN (SELECT customer_id FROM t_segments WHERE segment = '{value}')" for name, value in (
        ("gone", oq.RESTRICTED_SEGMENT), ("renamed", oq.RENAMED_SEGMENT))}
    new_id = f"CASE WHEN {seg['renamed'].format('customer_id')} THEN customer_id + {oq.RENAME_OFFSET} ELSE customer_id END"
    of_orders = f"order_id IS NULL OR order_id NOT IN ({gone_orders})"
    left = {
        "customers": ([new_id], "t_customers", f"NOT {seg['gone'].format('customer_id')}"),
        "orders": (["order_id", new_id], "t_orders", f"customer_id IS NULL OR NOT {seg['gone'].format('customer_id')}"),
        "order_items": (["order_id", "order_item_id", "product_id", "seller_id"], "t_items",
                        f"({of_orders}) AND (product_id IS NULL OR product_id NOT IN ({gone_products}))"),
        "payments": (["order_id", "payment_sequential"], "t_payments", of_orders),
        "reviews": (["review_id", "order_id"], "t_reviews", of_orders),
        "sellers": (["seller_id"], "t_sellers", "TRUE"),
        "products": (["product_id", f"CASE WHEN product_category_name NOT IN ({deleted}) THEN product_category_name END"], "t_products",
                     f"product_category_name IS DISTINCT FROM '{oq.DELETED_CATEGORY}'"),
        "translation": (["product_category_name"], "t_translation", f"product_category_name NOT IN ({deleted})"),
    }
    q["d6_d9_delete"] = w("\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, " + ", ".join(f"CAST({c} AS VARCHAR) AS value_{i}" for i, c in enumerate([*cols, *["NULL"] * (4 - len(cols))], 1))
        + f" FROM {source} WHERE {stays}" for name, (cols, source, stays) in left.items()))
    q["d6_d9_refused"] = w(f"""
SELECT 'orders.customer_id -> customers.customer_id' AS reference, CAST(customer_id AS VARCHAR) AS key_value, COUNT(*) AS blocking_rows
FROM t_orders WHERE {seg['gone'].format('customer_id')} GROUP BY customer_id""")
    q["d9_rename"] = w(f"""
SELECT o.order_id, COALESCE(m.new_key, o.customer_id) AS customer_id, o.order_status,
       o.order_purchase_timestamp, o.order_approved_at
FROM t_orders o
LEFT JOIN (SELECT customer_id AS old_key, customer_id + {oq.RENAME_OFFSET} AS new_key
           FROM t_segments WHERE segment = '{oq.RENAMED_SEGMENT}') m ON o.customer_id = m.old_key""")
    q["d11_missing_reference"] = w("""
SELECT DISTINCT p.product_category_name
FROM t_products_clean p LEFT JOIN t_translation t ON p.product_category_name = t.product_category_name
WHERE p.product_category_name IS NOT NULL AND t.product_category_name IS NULL""")

    q["j2_fanout"] = w("""
SELECT i.order_id, i.order_item_id, i.product_id, pay.payment_sequential,
       CAST(i.price AS DOUBLE) AS price, CAST(pay.payment_value AS DOUBLE) AS payment_value
FROM t_items i JOIN t_payments pay ON i.order_id = pay.order_id""")
    q["j3_join_preaggregated"] = w("""
SELECT u.seller_id, u.order_id, s.seller_city, s.seller_state,
       CAST(u.order_seller_price AS DOUBLE) AS order_seller_price, u.items_count
FROM (SELECT seller_id, order_id, SUM(price) AS order_seller_price, COUNT(*) AS items_count
      FROM t_items GROUP BY seller_id, order_id) u
JOIN t_sellers s ON s.seller_id = u.seller_id""")
    q["j4_left"] = w("""
SELECT o.order_id, COUNT(i.order_id) AS n_items, CAST(COALESCE(SUM(i.price), 0) AS DOUBLE) AS order_amount
FROM t_orders o LEFT JOIN t_items i ON o.order_id = i.order_id
GROUP BY o.order_id""")
    q["j5_anti"] = w("""
SELECT p.product_id, p.product_category_name
FROM t_products_clean p LEFT JOIN t_translation t ON p.product_category_name = t.product_category_name
WHERE p.product_category_name IS NOT NULL AND t.product_category_name IS NULL""")
    q["j6_lateral_top1"] = w("""
SELECT seller_id, product_category_name, CAST(SUM(price) AS DOUBLE) AS category_revenue
FROM t_items LEFT JOIN t_products USING (product_id)
GROUP BY seller_id, product_category_name
QUALIFY ROW_NUMBER() OVER (PARTITION BY seller_id ORDER BY SUM(price) DESC NULLS FIRST, product_category_name NULLS FIRST) = 1""")
    q["j6_lateral_api"] = w("""
SELECT s.seller_id, s.seller_city, best.product_category_name, CAST(best.revenue AS DOUBLE) AS category_revenue
FROM t_sellers s LEFT JOIN LATERAL (
  SELECT product_category_name, SUM(price) AS revenue
  FROM t_items i LEFT JOIN t_products p USING (product_id) WHERE i.seller_id = s.seller_id
  GROUP BY product_category_name ORDER BY revenue DESC NULLS FIRST, product_category_name NULLS FIRST LIMIT 1) best ON TRUE""")
    q["j7_scalar_api"] = w("""
SELECT o.order_id, o.customer_id, (
  SELECT COALESCE(p.product_category_name, 'Uncategorized') AS label
  FROM t_items i LEFT JOIN t_products p USING (product_id) WHERE i.order_id = o.order_id
  ORDER BY i.price DESC NULLS FIRST, label LIMIT 1) AS top_category
FROM t_orders o""")
    q["p12_tuple_semi"] = w(f"""
SELECT product_category_name, payment_type, order_id, CAST(payment_value AS DOUBLE) AS payment_value
FROM order_level
WHERE (product_category_name, payment_type) IN (
  SELECT product_category_name, payment_type FROM order_level
  GROUP BY payment_type, product_category_name
  HAVING SUM(payment_value) > {X_MIN_TOTAL} AND COUNT(DISTINCT order_id) > {X_MIN_ORDERS})""", ORDER_LEVEL_CTE)

    q["a2_multi_key"] = w("""
SELECT seller_id, order_id, CAST(SUM(price) AS DOUBLE) AS order_seller_price, COUNT(*) AS items_count
FROM t_items GROUP BY seller_id, order_id""")
    q["a3_rollup"] = w("""
SELECT s.seller_state, s.seller_city,
       CAST(GROUPING(s.seller_state) AS INTEGER) AS g_state, CAST(GROUPING(s.seller_city) AS INTEGER) AS g_city,
       CAST(SUM(i.price) AS DOUBLE) AS revenue, COUNT(*) AS n_items
FROM t_items i JOIN t_sellers s ON s.seller_id = i.seller_id
GROUP BY ROLLUP (s.seller_state, s.seller_city)""")
    q["a4_grouping_sets"] = w("""
SELECT product_category_name, payment_type,
       CAST(GROUPING(product_category_name) AS INTEGER) AS grouping_category,
       CAST(GROUPING(payment_type) AS INTEGER) AS grouping_payment,
       CAST(SUM(payment_value) AS DOUBLE) AS total_payment, COUNT(*) AS n_rows
FROM order_level
GROUP BY GROUPING SETS ((product_category_name, payment_type), (product_category_name), (payment_type))""",
                            ORDER_LEVEL_CTE)
    q["a5_hierarchy_sets"] = w("""
SELECT s.seller_state, s.seller_city, CAST(GROUPING(s.seller_city) AS INTEGER) AS is_state_summary,
       CAST(SUM(i.price) AS DOUBLE) AS revenue, COUNT(DISTINCT i.order_id) AS uq_orders
FROM t_items i JOIN t_sellers s ON s.seller_id = i.seller_id
GROUP BY GROUPING SETS ((s.seller_state, s.seller_city), (s.seller_state))""")
    q["a10_two_distincts"] = w("""
SELECT s.seller_state, COUNT(DISTINCT s.seller_id) AS sellers_count, COUNT(DISTINCT i.order_id) AS orders_count
FROM t_items i JOIN t_sellers s ON s.seller_id = i.seller_id
GROUP BY s.seller_state""")
    q["a13_stddev_variance_cv"] = w(f"""
SELECT seller_id, {ratio('SUM(cents)', 'COUNT(cents)')} AS avg_price, {r2('STDDEV_SAMP(price)')} AS price_stddev,
       {r2('VAR_SAMP(price)')} AS price_variance,
       {r2('STDDEV_SAMP(price) / (SUM(cents) / 100.0 / COUNT(cents)) * 100')} AS cv
FROM t_items GROUP BY seller_id""")
    q["a16_median"] = w(f"""
SELECT p.product_category_name,
       {median('i.cents')} AS median_price
FROM t_items i JOIN t_products p ON i.product_id = p.product_id
GROUP BY p.product_category_name""")
    q["a16_median_double"] = w("""
SELECT product_category_name, v[(len(v) - 1) // 2 + 1] + (v[len(v) // 2 + 1] / 2 - v[(len(v) - 1) // 2 + 1] / 2) AS median_net_price
FROM (
  SELECT p.product_category_name, list_sort(list(l_extendedprice * (1.0::DOUBLE - l_discount))) AS v
  FROM lineitem JOIN t_products p ON l_partkey = p.product_id GROUP BY p.product_category_name) per""")
    q["a17_median_finest"] = q2_sets_by_order(-1, -1)
    q["a19_distinct"] = w("SELECT DISTINCT product_category_name FROM t_products")

    q["w1_row_number"] = w(f"""
SELECT customer_unique_id, order_id, order_purchase_timestamp FROM (
  SELECT c.customer_unique_id, o.order_id, o.order_purchase_timestamp,
         ROW_NUMBER() OVER (PARTITION BY c.customer_unique_id
                            ORDER BY o.order_purchase_timestamp DESC NULLS FIRST, o.order_id) AS rn
  FROM t_customers c JOIN t_orders o ON c.customer_id = o.customer_id
  WHERE o.order_status = '{tb.DELIVERED_STATUS}') r
WHERE rn = 1""")
    q["w2_first_value"] = w("""
SELECT DISTINCT i.order_id,
       FIRST_VALUE(COALESCE(p.product_category_name, 'Uncategorized')) OVER (
           PARTITION BY i.order_id
           ORDER BY i.price DESC NULLS FIRST, COALESCE(p.product_category_name, 'Uncategorized')) AS top_category
FROM t_items i LEFT JOIN t_products p ON i.product_id = p.product_id""")
    q["w3_partition_sum"] = w("""
SELECT order_id, order_item_id, product_id, CAST(price AS DOUBLE) AS price,
       CAST(SUM(price) OVER (PARTITION BY order_id) AS DOUBLE) AS order_amount
FROM t_items""")
    q["w4_first_per_key"] = w("""
SELECT DISTINCT ON (seller_id) order_id, order_item_id, product_id, seller_id, CAST(price AS DOUBLE) AS price
FROM t_items
ORDER BY seller_id, price DESC NULLS FIRST, order_id, order_item_id, product_id""")
    q["o5_top_by_sum"] = w("""
SELECT DISTINCT ON (payment_type) payment_type, product_category_name,
       CAST(SUM(payment_value) AS DOUBLE) AS total_payment
FROM order_level
GROUP BY payment_type, product_category_name
ORDER BY payment_type, SUM(payment_value) DESC NULLS FIRST, product_category_name NULLS FIRST""", ORDER_LEVEL_CTE)
    q["u1_union_all"] = w("""
SELECT product_category_name, payment_type, CAST(SUM(payment_value) AS DOUBLE) AS total_payment,
       COUNT(*) AS unique_orders, 0 AS grouping_category, 0 AS grouping_payment
FROM order_level GROUP BY product_category_name, payment_type
UNION ALL
SELECT product_category_name, CAST(NULL AS VARCHAR), CAST(SUM(payment_value) AS DOUBLE), COUNT(DISTINCT order_id), 0, 1
FROM order_level GROUP BY product_category_name
UNION ALL
SELECT CAST(NULL AS VARCHAR), payment_type, CAST(SUM(payment_value) AS DOUBLE), COUNT(DISTINCT order_id), 1, 0
FROM order_level GROUP BY payment_type""", ORDER_LEVEL_CTE)

    q["f1_round_half_up"] = w(f"""
SELECT seller_id, {ratio('SUM(cents)', 'COUNT(cents)')} AS avg_price,
       {ratio('SUM(cents)', 'COUNT(DISTINCT order_id)')} AS avg_order_value
FROM t_items GROUP BY seller_id""")
    q["f5_coalesce"] = w("""
SELECT o.order_id, CAST(COALESCE(f.order_amount, 0) AS DOUBLE) AS order_amount,
       COALESCE(f.top_category, 'Uncategorized') AS top_category
FROM t_orders o
LEFT JOIN (
  SELECT DISTINCT i.order_id,
         SUM(i.price) OVER (PARTITION BY i.order_id) AS order_amount,
         FIRST_VALUE(COALESCE(p.product_category_name, 'Uncategorized')) OVER (
             PARTITION BY i.order_id
             ORDER BY i.price DESC NULLS FIRST, COALESCE(p.product_category_name, 'Uncategorized')) AS top_category
  FROM t_items i LEFT JOIN t_products p ON i.product_id = p.product_id) f ON f.order_id = o.order_id""")
    q["f6_segments"] = w(f"""
SELECT c.customer_unique_id, CAST(COALESCE(SUM(i.price), 0) AS DOUBLE) AS lifetime_value,
       CASE WHEN COALESCE(SUM(i.price), 0) > {Q4_VIP} THEN 'VIP'
            WHEN COALESCE(SUM(i.price), 0) >= {Q4_HIGH} THEN 'High Value'
            ELSE 'Standard' END AS customer_segment
FROM t_customers c JOIN t_orders o ON c.customer_id = o.customer_id
LEFT JOIN t_items i ON o.order_id = i.order_id
GROUP BY c.customer_unique_id""")
    q["s3_values"] = w("""
SELECT t.product_category_name_english, COUNT(*) AS n_products
FROM t_products p LEFT JOIN t_translation t ON p.product_category_name = t.product_category_name
GROUP BY t.product_category_name_english""")

    wide = """
SELECT i.order_id, i.order_item_id, o.customer_id, o.order_purchase_timestamp, i.product_id, i.seller_id,
       p.product_category_name, CAST(i.price AS DOUBLE) AS price
FROM t_items i JOIN t_orders o USING (order_id) LEFT JOIN t_products p ON p.product_id = i.product_id
WHERE """
    q["s8_lookup_customer"] = w(f"{wide} o.customer_id IN {oq.LOOKUP_CUSTOMERS}")
    q["s8_lookup_timestamp"] = w(
        f"{wide} o.order_purchase_timestamp >= DATE '{oq.LOOKUP_FROM}' AND o.order_purchase_timestamp < DATE '{oq.LOOKUP_BEFORE}'")
    q["s8_lookup_product"] = w(f"{wide} i.product_id IN {oq.LOOKUP_PRODUCTS}")
    q["s8_lookup_seller"] = w(f"{wide} i.seller_id IN {oq.LOOKUP_SELLERS}")
    q["s8_lookup_category"] = w(f"{wide} p.product_category_name = '{oq.LOOKUP_CATEGORY}'")
    every = {rule: f"order_id % {n} = {rest}" for rule, (n, rest) in (
        ("short", tb.SHORT_LINE), ("long", tb.LONG_LINE), ("text", tb.TEXT_CUSTOMER))}
    dump = f"""
FROM (SELECT order_id, customer_id, order_status, strftime(order_purchase_timestamp, '%Y-%m-%d %H:%M:%S') AS order_purchase_timestamp,
             strftime(order_approved_at, '%Y-%m-%d %H:%M:%S') AS order_approved_at,
             CASE WHEN {every['short']} THEN 'short' WHEN {every['long']} THEN 'long' WHEN {every['text']} THEN 'text' ELSE 'fits' END AS kind
      FROM t_orders)"""
    q["s1_load"] = w(f"SELECT * EXCLUDE (kind) {dump} WHERE kind = 'fits'")
    q["s1_rejects"] = w(f"""
SELECT order_id || ',' || CASE kind WHEN 'text' THEN '{tb.TEXT_CUSTOMER_PREFIX}' ELSE '' END || customer_id || ',' || order_status
       || ',"' || order_purchase_timestamp || '"' || CASE kind WHEN 'short' THEN '' ELSE ',' || COALESCE(order_approved_at, '') END
       || CASE kind WHEN 'long' THEN '{tb.LONG_LINE_END}' ELSE '' END AS line,
       CASE kind WHEN 'text' THEN 'value' ELSE 'field_count' END AS problem,
       CASE kind WHEN 'text' THEN 'customer_id' END AS column_name
{dump} WHERE kind <> 'fits'""")
    q["s1_reject_report"] = w(f"SELECT COUNT(*) AS n_records, COUNT(*) FILTER (kind <> 'fits') AS n_rejected {dump}")
    placed = """
SELECT order_id, order_item_id, product_id, seller_id, CAST(price AS DOUBLE) AS price,
       ROW_NUMBER() OVER (ORDER BY price DESC NULLS FIRST, order_id, order_item_id) AS position
FROM t_items"""
    q["s9_positions"] = w(placed)
    q["s9_page"] = w(f"{placed} QUALIFY position BETWEEN {oq.PAGE_FIRST} AND {oq.PAGE_LAST}")
    return q


def operator_sql() -> dict[str, str]:
    return _ops_sql()
