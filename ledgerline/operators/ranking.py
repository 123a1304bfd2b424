"""Top-N per group and keep-last de-duplication.

Both are ``row_number()`` over a window partitioned by the group keys and a
filter on the rank. Spark plans a *partial* ``WindowGroupLimit`` before the
shuffle, so a hot key is cut to N rows per map task before it moves: a group
holding a third of all rows never lands whole in one reducer. The ordering
must be total (callers add tie-break columns); then the result is the same
on every re-run, which keeps recomputation after an executor loss safe.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_COL = "_rank"


def _cols(cs: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    n: int = 1,
    rank_col: str | None = None,
) -> DataFrame:
    """Keep the first ``n`` rows of each ``keys`` group under ``order``.

    Covers ROW_NUMBER (W1), DISTINCT ON (W4) and LATERAL ... LIMIT n
    (J6, O5-O8). ``keys`` must not be empty: a window without a partition
    would put every row into one task.
    """
    if not keys:
        raise ValueError("top_per_group needs at least one partition key")
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    name = rank_col or RANK_COL
    ranked = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= F.lit(n))
    return ranked if rank_col else ranked.drop(name)


def any_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def keep_last(df: DataFrame, keys: Sequence[str], load_order: Sequence[Column | str]) -> DataFrame:
    """Remove a row when a later copy with equal keys exists.

    ``load_order`` lists the columns that say which copy came later, most
    significant first; the greatest wins. Rows with a NULL key are never
    removed (NULL never equals NULL): each is a partition of its own, so one
    read and one window with a partial limit serve both kinds of rows.
    """
    order = [c.desc_nulls_last() if isinstance(c, Column) else F.col(c).desc_nulls_last() for c in load_order]
    alone = df.withColumn("_alone", F.when(any_null(keys), F.monotonically_increasing_id()))
    return top_per_group(alone, [*keys, "_alone"], order).drop("_alone")
