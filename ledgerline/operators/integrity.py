"""Key and reference checks, and the re-aimed referential actions.

Spark does not enforce keys, so each constraint of the reference becomes a
DataFrame that lists its violations (empty = the constraint holds), and each
ON DELETE / ON UPDATE rule becomes a join that produces the next version of
the child table. Every check is one keyed aggregation or one anti/semi join.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.ranking import any_null


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that break a primary key (NULL part or repeated).

    Returns the key columns, ``n_rows`` and ``problem`` ('null_key' or
    'duplicate'). Partial aggregation makes a hot key cheap to count.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    nulls = any_null(keys)
    return counted.filter(nulls | (F.col("n_rows") > F.lit(1))).withColumn(
        "problem", F.when(nulls, F.lit("null_key")).otherwise(F.lit("duplicate"))
    )


def fk_summary(child: DataFrame, fk: str, parent: DataFrame, pk: str, relation: str) -> DataFrame:
    """D4 summary: one row with orphan rows and distinct missing keys.

    References are counted per key first (partial aggregation: a hot key
    collapses map-side), so the anti join sees each distinct key once.
    """
    per_key = child.filter(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("_rows"))
    missing = per_key.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")
    return missing.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint").alias("orphan_rows"),
        F.count(F.lit(1)).alias("missing_keys"),
    ).select(F.lit(relation).alias("relation"), "orphan_rows", "missing_keys")


def cascade_delete(child: DataFrame, fk: str, surviving_parent: DataFrame, pk: str) -> DataFrame:
    """ON DELETE CASCADE as a new child version.

    A child row survives when its reference is NULL or points at a surviving
    parent. Apply parent-first along the reference chain. One read of the
    child; rows without a reference, however many, are spread over tasks.
    """
    keys = surviving_parent.select(F.col(pk).alias("_pk"), F.xxhash64(pk).alias("_pk_hash")).distinct().withColumn("_found", F.lit(True))
    # joined by hash and key, where rows without a reference have a hash of all columns
    deal = F.when(F.col(fk).isNull(), F.xxhash64(*child.columns)).otherwise(F.xxhash64(fk))
    j = child.withColumn("_deal", deal).join(keys, (F.col("_deal") == F.col("_pk_hash")) & (F.col(fk) == F.col("_pk")), "left")
    return j.filter(F.col(fk).isNull() | F.col("_found")).select(*[j[c] for c in child.columns])


def restrict_blockers(to_delete: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    """ON DELETE RESTRICT as a report: requested deletions that still
    have children, with how many. Non-empty means the delete is refused."""
    refs = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias(pk)).agg(F.count(F.lit(1)).alias("blocking_rows"))
    return to_delete.select(pk).distinct().join(refs, pk)


def set_null_on_delete(child: DataFrame, fk: str, deleted_parent: DataFrame, pk: str) -> DataFrame:
    """ON DELETE SET NULL: children of deleted parents lose the reference."""
    gone = deleted_parent.select(F.col(pk).alias("_gone")).distinct().withColumn("_hit", F.lit(True))
    j = child.join(gone, child[fk] == gone["_gone"], "left")
    return j.withColumn(fk, F.when(F.col("_hit").isNull(), F.col(fk))).drop("_gone", "_hit")


def rename_references(child: DataFrame, fk: str, mapping: DataFrame, old: str = "old_key", new: str = "new_key") -> DataFrame:
    """ON UPDATE CASCADE: a renamed parent key reaches its children.

    ``mapping`` holds (old, new) pairs with unique ``old``.
    """
    m = mapping.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    j = child.join(m, child[fk] == m["_old"], "left")
    return j.withColumn(fk, F.coalesce(F.col("_new"), F.col(fk))).drop("_old", "_new")


def condition_counts(df: DataFrame, table: str, checks: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """D13 part: rows meeting each (check, column, condition), all counted
    in one scan of ``df`` (one global aggregate, partial per task), one
    output row per check."""
    row = df.agg(*[F.count_if(cond).alias(f"_c{i}") for i, (_, _, cond) in enumerate(checks)])
    stack = F.explode(F.array(*[
        F.struct(F.lit(check).alias("check_name"), F.lit(col).alias("column_name"), F.col(f"_c{i}").alias("n_bad"))
        for i, (check, col, _) in enumerate(checks)
    ]))
    return row.select(stack.alias("_s")).select(F.lit(table).alias("table_name"), "_s.check_name", "_s.column_name", "_s.n_bad")


def null_counts(df: DataFrame, table: str) -> DataFrame:
    """D13 part: NULL count of every column, one row per column."""
    return condition_counts(df, table, [("null_values", c, F.col(c).isNull()) for c in df.columns])


def count_check(df: DataFrame, table: str, check: str, column: str) -> DataFrame:
    """D13 part: the row count of a violation DataFrame as a profile row."""
    return df.agg(F.count(F.lit(1)).alias("n_bad")).select(
        F.lit(table).alias("table_name"), F.lit(check).alias("check_name"), F.lit(column).alias("column_name"), "n_bad"
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
