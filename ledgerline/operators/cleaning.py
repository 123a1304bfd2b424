"""Cleaning operators: typed casts, de-duplication, blank repair, upsert.

All are narrow projections or one keyed shuffle; none collects data.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import blank_to_null
from ledgerline.operators.ranking import top_per_group

TS_TYPE = "timestamp_ntz"


def cast_timestamps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """D1 strict: text to zone-free timestamp; NULL stays NULL.

    Under ANSI mode (on by default) a malformed or empty text fails the
    job, like ``ALTER ... TYPE timestamp USING col::timestamp``.
    """
    present = [c for c in columns if c in df.columns]
    return df.select(*[F.col(c).cast(TS_TYPE).alias(c) if c in present else F.col(c) for c in df.columns])


def unparsable(c: str) -> Column:
    """Text present that does not parse as a timestamp."""
    return F.col(c).isNotNull() & F.col(c).try_cast(TS_TYPE).isNull()


def quarantine_timestamps(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """D1 lenient: split into (clean rows with typed columns, rejected rows).

    A row is rejected when any listed column holds text that does not parse.
    Both outputs come from one lazy plan; nothing is dropped silently.
    """
    present = [c for c in columns if c in df.columns]
    bad = reduce(lambda a, b: a | b, [unparsable(c) for c in present])
    clean = df.filter(~bad).select(
        *[F.col(c).try_cast(TS_TYPE).alias(c) if c in present else F.col(c) for c in df.columns]
    )
    return clean, df.filter(bad)


def unparsable_cells(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """D1 report: one row per (key, column, raw text) that does not parse."""
    present = [c for c in columns if c in df.columns]
    stacked = df.select(
        key,
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("raw_value")) for c in present])).alias("_cell"),
    ).select(key, "_cell.column_name", "_cell.raw_value")
    return stacked.filter(F.col("raw_value").isNotNull() & F.col("raw_value").try_cast(TS_TYPE).isNull())


def blank_category_to_null(df: DataFrame, column: str = "product_category_name") -> DataFrame:
    """Empty or all-space text becomes NULL; everything else is kept."""
    return df.withColumn(column, blank_to_null(column))


def insert_if_absent(base: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column | str] | None = None) -> DataFrame:
    """``INSERT ... ON CONFLICT (keys) DO NOTHING``.

    Rows of ``new`` whose key already exists in ``base`` are ignored; among
    new rows sharing a key the first under ``order`` wins (default: the
    non-key columns ascending, a total and stated tie-break). Re-running
    with the same input changes nothing (idempotent).
    """
    order = list(order) if order else [F.col(c).asc_nulls_last() for c in new.columns if c not in keys]
    first = top_per_group(new, list(keys), order) if order else new.dropDuplicates(list(keys))
    fresh = first.join(base.select(*keys), list(keys), "left_anti")
    return base.unionByName(fresh.select(*base.columns))
