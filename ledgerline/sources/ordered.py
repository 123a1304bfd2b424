"""A written result that keeps its total order, with row positions.

Range partitions give the coarse order, a sort inside each gives the fine one,
and the partitions' row counts, added up, give every row its position. No
window runs over the whole table.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import scratch_path
from ledgerline.sources.lookup import _unused

ROWS_OF_A_PARTITION = 2 ** 33  # monotonically_increasing_id keeps the row number in its low 33 bits
FOLDER_DIGITS = 19
FOLDER = "first_position"


def with_positions(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """``df`` with the 1-based place of each row in ``order``.

    The sorted rows are written under the shared checkpoint folder with their
    partition and row number, so that a lost executor can't shift positions
    between the count and its use. The driver gets one count per partition.

    Rows that tie in ``order`` are told apart by a hash of the whole row, and a
    key with a third of all rows is thus spread over partitions; identical
    rows get neighbouring positions. NULLs stand where ``order`` says. An empty
    table gives an empty one. A column called ``name`` raises.
    """
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {name} already")
    part, row, start, spread = (_unused(df, n) for n in ("_part", "_row", "_start", "_spread"))
    spark = df.sparkSession
    path = scratch_path(spark, f"ordered-{uuid.uuid4().hex}")
    columns = [F.col(f"`{c}`") for c in df.columns]
    ordered = df.withColumn(spread, F.xxhash64(*columns)).orderBy(*order, spread)
    number = F.monotonically_increasing_id()
    ordered.select(*columns, F.spark_partition_id().alias(part), (number % ROWS_OF_A_PARTITION).alias(row)).write.parquet(path)
    stored = spark.read.parquet(path)
    counts = sorted(tuple(r) for r in stored.groupBy(part).count().collect())
    starts = [0, *accumulate(n for _, n in counts)]
    offsets = spark.createDataFrame([(p, s) for (p, _), s in zip(counts, starts)], f"`{part}` int, `{start}` bigint")
    # one row per partition of the sort: bounded by spark.sql.shuffle.partitions
    placed = stored.join(F.broadcast(offsets), part)
    return placed.select(*columns, (F.col(start) + F.col(row) + 1).alias(name))


def write_in_order(df: DataFrame, path: str, order: Sequence[Column | str], block_rows: int = 10_000_000, name: str = "position") -> str:
    """Write ``df`` with positions in folders named by the first position that
    each may hold (``first_position=`` and 19 digits), sorted inside the files.
    A page of the result (positions a to b) reads its folders only."""
    if FOLDER in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {FOLDER} already")
    placed = with_positions(df, order, name)
    first = F.col(name) - F.pmod(F.col(name) - 1, F.lit(block_rows))
    (
        placed.withColumn(FOLDER, F.lpad(first.cast("string"), FOLDER_DIGITS, "0"))
        .sortWithinPartitions(FOLDER, name)
        .write.mode("errorifexists").partitionBy(FOLDER).parquet(path)
    )
    return path


def read_page(df: DataFrame, first: int, last: int, block_rows: int = 10_000_000, name: str = "position") -> DataFrame:
    """Rows ``first`` to ``last`` of a table of ``write_in_order``, in order;
    ``block_rows`` as it was written with."""
    if first < 1 or last < first:
        return df.where(F.lit(False)).drop(FOLDER)
    lowest, highest = (p - (p - 1) % block_rows for p in (first, last))
    page = df.where(F.col(FOLDER).cast("bigint").between(lowest, highest) & F.col(name).between(first, last))
    return page.drop(FOLDER).orderBy(name)
