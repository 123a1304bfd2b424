"""Join helpers: NULL-safe key joins, tuple membership, orphans."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL matches NULL (``<=>``).

    Needed when a key may be a real NULL, e.g. a NULL category next to a
    subtotal row. Spark still plans this as an equi-join.
    """
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys])
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def semi_by_tuple(df: DataFrame, allowed: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(a, b) IN (SELECT a, b ...)``; a NULL component never matches."""
    return df.join(allowed.select(*cols), list(cols), "left_semi")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose non-NULL reference has no parent row."""
    keys = parent.select(F.col(pk).alias(fk))
    return child.filter(F.col(fk).isNotNull()).join(keys, fk, "left_anti")


def missing_references(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Distinct non-NULL reference values with no parent."""
    return orphans(child.select(fk), fk, parent, pk).distinct()


def lateral_top(outer: DataFrame, inner: DataFrame, order: Sequence[Column], n: int = 1, how: str = "left") -> DataFrame:
    """``outer CROSS/LEFT JOIN LATERAL (inner ORDER BY order LIMIT n)``.

    ``inner`` is any DataFrame that refers to columns of the row outside by
    ``F.col(name).outer()``, as the caller would write the dependent query; group
    before that filter, as ``groupBy`` needs a plan without open references. Give
    the outer side an alias and refer to ``alias.name``: a bare name that the inner
    plan has at any depth, renamed or not, is taken from there.
    Spark removes the correlation: equalities with outer columns become join
    keys, and the limit a rank per key with a partial limit before its shuffle, so
    nothing is evaluated row by row (``correlation_removed`` checks a plan).
    ``order`` must be total; ``how`` is "left" or "inner".
    """
    return outer.lateralJoin(inner.orderBy(*order).limit(n), how=how)


def scalar_top(inner: DataFrame, value: str, order: Sequence[Column]) -> Column:
    """``(SELECT value FROM inner ORDER BY order LIMIT 1)`` as a column of the
    row outside; NULL where the inner query has no row."""
    return inner.orderBy(*order).limit(1).select(value).scalar()


def correlation_removed(plan: str) -> bool:
    """Whether a physical plan (text) joins by keys only: no nested loop and no
    cartesian product, which is what a correlation left in place would give."""
    return "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
