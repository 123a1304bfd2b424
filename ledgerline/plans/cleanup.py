"""The quality profile and the cleanup steps of the reference.

Order of the cleanup: type the timestamps, then remove duplicates before
each key, repair blank categories and the translation table before the
category reference is bound, report on keys and references, and only then let
orphans go, parents first.

Each step is a lazy DataFrame that reads its table once; ``materialize_to``
writes the clean tables as new versions (S7) into a shared folder and re-reads
them, which cuts the lineage so a lost executor only recomputes from the
written files.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators import cleaning as cl
from ledgerline.operators import integrity as ig
from ledgerline.operators.joins import missing_references
from ledgerline.operators.ranking import keep_last
from ledgerline.sources.io import STORED_ORDER, read_version, version_path, write_version
from ledgerline.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS, TEXT_TIMESTAMPS
from ledgerline.sources.tables import Tables

CAT = "product_category_name"
#: Tables whose copies are removed, as in the reference.
DEDUPED = ("customers", "order_items", "payments", "reviews", "translation")


@dataclass
class CleanResult:
    tables: dict[str, DataFrame]
    rejected_orders: DataFrame
    profile: DataFrame
    key_report: DataFrame
    reference_report: DataFrame
    missing_categories: DataFrame
    notes: list[str] = field(default_factory=list)


def _columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in STORED_ORDER]


def quality_profile(raw: Tables) -> DataFrame:
    """table_name, check_name, column_name, n_bad over all eight raw tables.

    Per column NULLs, per text column blank text, per timestamp text what does
    not parse (one scan of a table for all of these); per key its violations,
    per reference the orphan rows.
    """
    frames = []
    for name in PRIMARY_KEYS:
        df = getattr(raw, name)
        checks = [("null_values", c, F.col(c).isNull()) for c in _columns(df)]
        text = [c for c in _columns(df) if isinstance(df.schema[c].dataType, T.StringType)]
        checks += [("blank_text", c, F.trim(F.col(c)) == "") for c in text]
        checks += [("unparsable_timestamp", c, cl.unparsable(c)) for c in text if name == "orders" and c in TEXT_TIMESTAMPS]
        frames.append(ig.condition_counts(df, name, checks))
    for name, keys in PRIMARY_KEYS.items():
        violations = ig.key_violations(getattr(raw, name).select(*keys), keys)
        frames.append(ig.count_check(violations, name, "key_violations", ",".join(keys)))
    for child, fk, parent, pk, _ in FOREIGN_KEYS:
        summary = ig.fk_summary(getattr(raw, child), fk, getattr(raw, parent), pk, child)
        frames.append(summary.select(
            F.lit(child).alias("table_name"), F.lit("orphans").alias("check_name"), F.lit(fk).alias("column_name"),
            F.col("orphan_rows").alias("n_bad")))
    return ig.union_all(frames)


def _load_order(name: str, df: DataFrame, explicit: Sequence[str] | None) -> list[str]:
    """The columns that say which copy was stored later."""
    if explicit:
        return list(explicit)
    if set(STORED_ORDER) <= set(df.columns):
        return list(STORED_ORDER)
    raise ValueError(
        f"no load order for {name}: name its columns in load_order, or read the table through sources.io.with_stored_order to keep the copy stored last"
    )


def run_cleanup(
    raw: Tables,
    strict_types: bool = True,
    load_order: dict[str, Sequence[str]] | None = None,
    new_translations: DataFrame | None = None,
    drop_orphans: bool = False,
) -> CleanResult:
    """Run D13, D1, D5, D10-D12, D2-D4 and D6 in the reference's order.

    ``strict_types`` fails on malformed timestamp text (as the reference's
    ALTER TYPE does); otherwise bad rows go to ``rejected_orders``.
    ``load_order`` names, per table with copies, the columns whose greatest
    values mark the copy to keep. Without an entry the table must carry its
    stored order (``sources.io.with_stored_order``), and the copy stored last
    is kept as in the reference; with neither, a ValueError asks for one.
    ``drop_orphans`` applies the cascade rule to children whose parent is
    missing instead of only reporting them; the reports describe the tables
    before that.
    """
    load_order = load_order or {}
    notes: list[str] = []

    # 1. types
    if strict_types:
        orders = cl.cast_timestamps(raw.orders, TEXT_TIMESTAMPS)
        rejected = raw.orders.limit(0)
    else:
        orders, rejected = cl.quarantine_timestamps(raw.orders, TEXT_TIMESTAMPS)

    # 2. duplicates go before each key is declared
    tables = {"orders": orders, "products": raw.products, "sellers": raw.sellers}
    for name in DEDUPED:
        df = getattr(raw, name)
        tables[name] = keep_last(df, PRIMARY_KEYS[name], _load_order(name, df, load_order.get(name)))
    tables = {name: df.select(*_columns(df)) for name, df in tables.items()}

    # 3. blank categories become NULL, missing translations are added
    tables["products"] = cl.blank_category_to_null(tables["products"])
    missing = missing_references(tables["products"], CAT, tables["translation"], CAT)
    if new_translations is not None:
        tables["translation"] = cl.insert_if_absent(tables["translation"], new_translations, [CAT])

    # 4. key report (empty = every primary key holds)
    key_rows = []
    for name, keys in PRIMARY_KEYS.items():
        v = ig.key_violations(tables[name].select(*keys), keys)
        key_rows.append(v.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"), "violations"))

    # 5. reference report over all tables, then the cascade for orphans
    ref_rows = [
        ig.fk_summary(tables[child], fk, tables[parent], pk, f"{child}.{fk} -> {parent}.{pk}").withColumn("on_delete", F.lit(action))
        for child, fk, parent, pk, action in FOREIGN_KEYS
    ]
    if drop_orphans:
        for child, fk, parent, pk, action in FOREIGN_KEYS:
            if action == "cascade":
                tables[child] = ig.cascade_delete(tables[child], fk, tables[parent], pk)
        notes.append("children with a missing parent were removed (cascade rule)")

    return CleanResult(
        tables, rejected, quality_profile(raw), ig.union_all(key_rows), ig.union_all(ref_rows), missing, notes
    )


def materialize_to(result: CleanResult, base: str | None, version: str) -> dict[str, DataFrame]:
    """Write every clean table as a new version under ``base`` and return
    DataFrames that read the written files (lineage cut at the files).

    ``base`` defaults to a ``clean`` folder in the shared folder the cluster
    names in ``spark.checkpoint.dir``; never a machine-local path.
    """
    if base is None:
        from ledgerline.session import scratch_path

        base = scratch_path(result.tables["orders"].sparkSession, "clean")
    out = {}
    for name, df in result.tables.items():
        path = write_version(df, version_path(base, name, version))
        out[name] = read_version(df.sparkSession, path)
    return out
