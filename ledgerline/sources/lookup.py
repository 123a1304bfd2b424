"""One table layout that serves lookups by several columns.

A sort key serves its first column only. Here every lookup column is turned
into a rank of ``bits`` bits, the bits of all ranks are interleaved into one
cell number (a Z-order curve), and the rows are range-partitioned and sorted by
it. Any one column then spans few cells of each file: ranges are skipped by
the row groups' min/max statistics, points by dictionaries and Bloom filters.

With r row groups and c columns, a row group spans about r^(-1/c) of each
column's rows: at 100 TB (400,000 row groups) and five columns, one in 13.
Points on columns of many values read less, since the filters tell which row
groups hold the value itself.

Spark doesn't hand filters on zone-free timestamps to Parquet. Such a lookup
column gets a date beside it (``_day_of_<column>``), which it does hand down;
``lookup`` filters by both and leaves the date out again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_OF = "_day_of_"
CELL_BITS = 60  # of all columns together, so that a cell number is a positive long
MAX_BITS = 8  # of one column: 255 bounds


def _unused(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _number(df: DataFrame, name: str) -> Column:
    """A double that grows with the column. Texts have no such number, so they
    are placed by their hash, which serves equality."""
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    return F.when(column.isNotNull(), F.xxhash64(column).cast("double"))


def rank_bounds(df: DataFrame, columns: Sequence[str], bits: int) -> dict[str, list[float]]:
    """2^bits - 1 bounds per column that cut its rows into about equal parts.

    One aggregation of mergeable sketches over all rows; the driver gets one
    row. A value that holds many rows takes several bounds, so the others
    still have ranks of their own. A column without values has no bounds.
    """
    cuts = [i / 2 ** bits for i in range(1, 2 ** bits)]
    found = df.agg(*(F.percentile_approx(_number(df, c), cuts, 10_000).alias(f"b{i}") for i, c in enumerate(columns))).first()
    return {c: list(found[i] or []) for i, c in enumerate(columns)}


def _rank(value: Column, bounds: Sequence[float], bits: int) -> Column:
    """How many bounds are not above the value, by binary search; 0 for NULL."""
    if not bounds:
        return F.lit(0).cast("bigint")
    known = F.array(*(F.lit(float(b)) for b in bounds))
    steps = F.array(*(F.lit(2 ** b) for b in reversed(range(bits))))
    found = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(known, at + step - 1) <= value, step).otherwise(F.lit(0)))
    return found.cast("bigint")


def cell_number(ranks: Sequence[Column], bits: int) -> Column:
    """The ranks' bits interleaved, highest bits first."""
    total = F.lit(0).cast("bigint")
    for b in range(bits):
        for i, rank in enumerate(ranks):
            bit = F.shiftright(rank, b).bitwiseAND(F.lit(1).cast("bigint"))
            total = total + F.shiftleft(bit, b * len(ranks) + len(ranks) - 1 - i)
    return total


def write_lookup_layout(
    df: DataFrame, path: str, columns: Sequence[str], n_files: int, block_rows: int = 1_000_000, bits: int | None = None,
) -> str:
    """Write ``df`` as Parquet laid out for lookups by any of ``columns``.

    ``n_files`` range partitions, row groups of at most ``block_rows`` rows.
    ``bits`` per column is MAX_BITS, or as many as fit into CELL_BITS. Rows of
    one cell are dealt to files by a hash of the whole row, so a value or a
    combination with a third of all rows isn't one task. The input is read
    twice (bounds, then rows); write a costly one first.

    Filter it with ``lookup``, or by plain conditions. NULLs form the lowest rank of their column, equal rows are all kept, an
    empty table gives an empty layout, columns of any name are left as they
    are. Columns that can't be hashed or compared (maps) raise.
    """
    if not columns or len(set(columns)) < len(columns) or len(columns) > CELL_BITS:
        raise ValueError(f"name 1 to {CELL_BITS} different lookup columns")
    bits = bits or min(MAX_BITS, CELL_BITS // len(columns))
    if bits > MAX_BITS or bits * len(columns) > CELL_BITS:
        raise ValueError(f"{bits} bits for {len(columns)} columns: at most {MAX_BITS} each and {CELL_BITS} together")
    days = {f"{DAY_OF}{c}": F.col(f"`{c}`").cast("date") for c in columns if isinstance(df.schema[c].dataType, T.TimestampNTZType)}
    if {d.lower() for d in days} & {c.lower() for c in df.columns}:
        raise ValueError(f"the table has one of the columns {sorted(days)} already")
    bounds = rank_bounds(df, columns, bits)
    cell, spread = _unused(df, "_cell"), _unused(df, "_spread")
    ranks = [_rank(_number(df, c), bounds[c], bits) for c in columns]
    placed = df.withColumns({cell: cell_number(ranks, bits), spread: F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))})
    laid = (
        placed.repartitionByRange(n_files, cell, spread)
        .sortWithinPartitions(cell, *(F.col(f"`{c}`") for c in columns))
        .select(*(F.col(f"`{c}`") for c in df.columns), *(day.alias(name) for name, day in days.items()))
    )
    writer = laid.write.mode("errorifexists").option("parquet.block.row.count.limit", block_rows)
    for c in columns:
        if not isinstance(df.schema[c].dataType, (T.BooleanType, T.FractionalType)):
            writer = (
                writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
                .option(f"parquet.bloom.filter.expected.ndv#{c}", block_rows)
                .option("parquet.bloom.filter.adaptive.enabled", "true")
            )
    writer.parquet(path)
    return path


def lookup(stored: DataFrame, column: str, values: Sequence | None = None, low=None, before=None) -> DataFrame:
    """Rows of a written layout whose ``column`` is one of ``values``, or at
    least ``low`` and less than ``before`` (either may be left out). NULLs are
    never found; no values find nothing."""
    if (values is None) == (low is None and before is None):
        raise ValueError("give values or a range")
    name, kind = F.col(f"`{column}`"), stored.schema[column].dataType

    def typed(value) -> Column:
        return F.lit(value).cast(kind)

    day_name = f"{DAY_OF}{column}"
    day = F.col(f"`{day_name}`") if day_name in stored.columns else None
    conditions = []
    if values is not None:
        conditions.append(name.isin(*(typed(v) for v in values)) if values else F.lit(False))
        if day is not None and values:
            conditions.append(day.isin(*(typed(v).cast("date") for v in values)))
    if low is not None:
        conditions.append(name >= typed(low))
        if day is not None:
            conditions.append(day >= typed(low).cast("date"))
    if before is not None:
        conditions.append(name < typed(before))
        if day is not None:
            conditions.append(day <= typed(before).cast("date"))
    found = stored
    for condition in conditions:
        found = found.where(condition)
    return found.drop(*(c for c in stored.columns if c.startswith(DAY_OF) and c[len(DAY_OF):] in stored.columns))
