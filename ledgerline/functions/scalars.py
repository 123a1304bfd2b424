"""Column expressions shared by the analyses (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Money is exact: two decimals, twelve digits. Sums stay decimal until output.
MONEY = "decimal(12,2)"
# Wide exact type used before a two-digit round: 18 decimals, so that only
# one rounding takes place. A bare "decimal" in Spark means decimal(10,0) and
# would truncate, so the width is always spelled out.
WIDE = "decimal(38,18)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_money(c: Column | str) -> Column:
    """Cast to the exact money type."""
    return _col(c).cast(MONEY)


def round2(c: Column | str) -> Column:
    """Round to two decimals, half away from zero, returned as double.

    The value becomes an exact decimal first and is rounded once: a decimal as
    it is, a double read to 15 significant digits as the reference's cast to
    numeric does. So 92692.83499999999 gives 92692.84 and 12.3449999 gives
    12.34. The choice is made from the column's type when the query is planned.
    """
    col = _col(c)
    read = F.when(col.isNotNull(), F.format_string("%.14e", col.cast("double"))).cast(WIDE)
    return F.round(F.when(F.typeof(col) == "double", read).otherwise(col.cast(WIDE)), 2).cast("double")


def mean(total: Column | str, n: Column | str) -> Column:
    """Exact decimal quotient of a money sum and a count, to 18 decimals.

    ``avg`` of a decimal keeps only six decimals, so rounding it to two would
    round twice. NULL where there is nothing to divide.
    """
    return _col(total).cast("decimal(22,2)") / F.nullif(_col(n), F.lit(0))


def money_out(c: Column | str) -> Column:
    """Exact money (or an exact decimal sum) presented as double."""
    return _col(c).cast("double")


def flag(c: Column | str) -> Column:
    """GROUPING() flag as int (Spark returns tinyint)."""
    return F.grouping(c).cast("int")


def typed_null(type_name: str = "string") -> Column:
    return F.lit(None).cast(type_name)


def blank_to_null(c: Column | str) -> Column:
    """Empty or all-space text becomes NULL; other text is kept unchanged.

    Only the space character counts as blank (a tab is kept), like TRIM.
    """
    col = _col(c)
    return F.when(F.trim(col) != F.lit(""), col)


def segment_label(value: Column | str, vip: float, high: float) -> Column:
    """Lifetime-value segment: above ``vip`` is VIP, from ``high`` up High Value."""
    v = _col(value)
    return (
        F.when(v > F.lit(vip), F.lit("VIP"))
        .when(v >= F.lit(high), F.lit("High Value"))
        .otherwise(F.lit("Standard"))
    )
