"""Distinct counts that merge over subtotals.

COUNT(DISTINCT x) at several levels of grouping is usually taken by copying
every row once per level. Here one row of each (x, keys of the level) is
marked instead: then the distinct count of a group is the SUM of its marks, the
marks are summed at the finest level with a map-side step, and every
subtotal is a sum of those few sums. No row of the input is copied and
nothing is shuffled for a distinct phase of its own.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mark_firsts(df: DataFrame, counted: str, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Add ``names[j]``: 1 on one row of each (counted, keys[:j]), else 0.

    So the sum of ``names[j]`` over a group of keys[:j] is its exact
    COUNT(DISTINCT counted), and sums of sums stay exact for any grouping by
    keys[:j]. NULL keys form groups; rows whose ``counted`` is NULL have no
    marks, as COUNT(DISTINCT) leaves them out, and are dealt by their keys.

    One window over the counted value, ordered by the keys. Reduce the rows
    to the (counted, keys) grain first, map-side: a hot counted value then
    holds no more rows than there are key combinations.
    """
    if len(names) != len(keys) + 1:
        raise ValueError("one name per level is needed, the level without keys included")
    # rows without a counted value would all meet in one task
    deal = F.when(F.col(counted).isNull(), F.xxhash64(*keys))
    by = Window.partitionBy(counted, "_deal").orderBy(*[F.col(k).asc_nulls_first() for k in keys or ["_deal"]])
    new = F.row_number().over(by) == 1
    out = df.withColumn("_deal", deal) if keys else df.withColumn("_deal", F.lit(None).cast("bigint"))
    columns: list[Column] = [_mark(new, counted).alias(names[0])]
    for j in range(1, len(keys) + 1):
        differs = [~F.col(k).eqNullSafe(F.lag(k).over(by)) for k in keys[:j]]
        columns.append(_mark(new | reduce(lambda a, b: a | b, differs), counted).alias(names[j]))
    return out.select(*df.columns, *columns)


def _mark(new: Column, counted: str) -> Column:
    return (new & F.col(counted).isNotNull()).cast("int")
