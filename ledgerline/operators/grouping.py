"""Grouping sets by copies made inside each task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import typed_null


def expand_sets(
    df: DataFrame, sets: list[list[str]], keys: list[str], flag_names: dict[str, str], carry: list[str]
) -> DataFrame:
    """One copy of each row per grouping set, made inside its task.

    Keys outside the set are NULL and the GROUPING() flags are columns, so
    any aggregate grouped by keys + flags is the GROUPING SETS result. Unlike
    Spark's Expand, the generator keeps the input partitioning: rows that
    are hash-partitioned by order_id stay so, and COUNT(DISTINCT order_id)
    needs no shuffle for its distinct phase.
    """
    dtypes = dict(df.dtypes)
    copies = F.array(*[
        F.struct(
            *[(F.col(k) if k in group else typed_null(dtypes[k])).alias(k) for k in keys],
            *[F.lit(0 if k in group else 1).alias(name) for k, name in flag_names.items()],
        )
        for group in sets
    ])
    return df.select(F.explode(copies).alias("_set"), *carry).select("_set.*", *carry)
