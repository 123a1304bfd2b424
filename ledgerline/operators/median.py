"""Exact continuous median (PERCENTILE_CONT(0.5)), optionally weighted.

Decimals and whole numbers have units; floats and doubles are mapped to 64-bit
integers of the same order and found by their leading bits (``radix_median``).

The rows are first reduced to a histogram: one row per (group, value) with the
sum of weights. That is a partial aggregation spread over groups and values,
so a hot group is reduced map-side and no task receives it whole. Everything
else is derived from the histogram; un-aggregated rows never move again.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.grouping import expand_sets
from ledgerline.operators.joins import null_safe_join
from ledgerline.sources.io import materialize

# Fixed value: values are cut into coarse buckets of 2**BUCKET_BITS units of
# the last decimal digit. A decimal(12,2) has at most 10**12 / 2**20 buckets
# of at most 2**20 values, so neither of the two windows below grows with the rows.
BUCKET_BITS = 20
UNITS, WEIGHT = "_u", "_w"
# Fixed value: bits that each round of the radix descent tells apart, so that
# no group has more than 2**RADIX_BITS counts in a round.
RADIX_BITS = 16


def value_scale(df: DataFrame, value: str) -> int:
    """Decimal places of ``value``; other types have no exact units."""
    kind = df.schema[value].dataType
    if not isinstance(kind, T.DecimalType):
        raise TypeError(f"an exact median needs a decimal value; {value} is {kind.simpleString()}")
    return kind.scale


def _units(df: DataFrame, value: str) -> Column:
    return (F.col(value) * F.lit(10 ** value_scale(df, value)).cast("decimal(20,0)")).cast("bigint")


def _weight(weight: str | None) -> Column:
    return F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")


def histogram(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """keys, ``_u`` (value in units of its last decimal place) and ``_w`` (rows,
    or sum of ``weight``) per distinct value; NULL values are left out."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, _units(df, value).alias(UNITS), _weight(weight).alias(WEIGHT))
    return rows.groupBy(*keys, UNITS).agg(F.sum(WEIGHT).alias(WEIGHT))


def bucket_weights(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, others: Sequence[Column] = (), bucket_bits: int = BUCKET_BITS
) -> DataFrame:
    """keys, coarse bucket ``_b`` and its weight ``_c``, beside the aggregates
    ``others``: one map-side reduced pass. Rows of NULL value are the bucket NULL."""
    bucket = F.shiftright(_units(df, value), bucket_bits)
    rows = df.withColumns({"_b": bucket, "_own": _weight(weight)})
    return rows.groupBy(*keys, "_b").agg(F.sum("_own").alias("_c"), *others)


def _holds(k: str) -> Column:
    return (F.col("_start") <= F.col(k)) & (F.col(k) < F.col("_end"))


SO_FAR = Window.unboundedPreceding, Window.currentRow


def _middle_buckets(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of weights ``_c`` per (group, bucket): the bucket(s) that hold the middle
    ranks k1 = (n-1) div 2 and k2 = n div 2, and the rank they start at."""
    b = (
        buckets.withColumn("_end", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(*SO_FAR)))
        .withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
        .withColumn("_start", F.col("_end") - F.col("_c"))
        .withColumn("_k1", F.expr("(_n - 1) div 2"))
        .withColumn("_k2", F.expr("_n div 2"))
    )
    return b.filter(_holds("_k1") | _holds("_k2")).select(*keys, "_b", "_start", "_k1", "_k2")


def _picked(near: DataFrame, keys: Sequence[str], scale: int, name: str) -> DataFrame:
    """Walk the values of the middle buckets in order and take both middle ranks."""
    by_value = Window.partitionBy(*keys, "_b").orderBy(UNITS).rowsBetween(*SO_FAR)
    ranked = near.withColumn("_end", F.col("_start") + F.sum(WEIGHT).over(by_value)).withColumn("_start", F.col("_end") - F.col(WEIGHT))
    picked = ranked.groupBy(*keys).agg(
        F.max(F.when(_holds("_k1"), F.col(UNITS))).alias("_v1"), F.max(F.when(_holds("_k2"), F.col(UNITS))).alias("_v2")
    )
    both = F.col("_v1").cast("decimal(20,0)") + F.col("_v2").cast("decimal(20,0)")
    mid = both * F.lit(5) / F.lit(10 ** (scale + 1)).cast("decimal(20,0)")
    return picked.select(*keys, mid.cast(f"decimal(38,{scale + 1})").alias(name))


def histogram_median(hist: DataFrame, keys: Sequence[str], scale: int, name: str = "median", bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Exact PERCENTILE_CONT(0.5) per group of a histogram (``histogram``).

    Weights per (group, coarse bucket), where a bucket is the units shifted
    right by ``bucket_bits``, give the bucket(s) that hold the middle ranks; the
    values of those buckets are walked in order. The result is
    (v[k1] + v[k2]) / 2 as an exact decimal. A group without values has no row;
    NULL keys form groups.
    """
    keys = list(keys)
    hist = hist.select(*keys, UNITS, WEIGHT).withColumn("_b", F.shiftright(UNITS, bucket_bits))
    targets = _middle_buckets(hist.groupBy(*keys, "_b").agg(F.sum(WEIGHT).alias("_c")), keys)
    near = null_safe_join(hist, targets, [*keys, "_b"])
    near = near.groupBy(*keys, "_b", UNITS, "_start", "_k1", "_k2").agg(F.sum(WEIGHT).alias(WEIGHT))
    return _picked(near, keys, scale, name)


def sets_median(
    df: DataFrame, buckets: DataFrame, sets: list[list[str]] | None, keys: Sequence[str], flags: dict[str, str], value: str,
    weight: str | None = None, name: str = "median", bucket_bits: int = BUCKET_BITS,
) -> DataFrame:
    """Exact median per group of every grouping set over ``keys`` (None: of the
    keys themselves, without flags).

    ``buckets`` are the written ``bucket_weights`` of ``df``: they are summed up
    to each set and tell the middle buckets of every group. Of the rows themselves only
    those in some group's middle bucket are read again, copied per set and
    moved, reduced to (group, value) map-side. Keys outside a set are NULL and its
    ``flags`` columns 1; a group without values has no row.
    """
    groups = [*keys, *flags.values()]

    def per_set(rows: DataFrame, *carry: str) -> DataFrame:
        return rows.select(*keys, *carry) if sets is None else expand_sets(rows, sets, list(keys), flags, list(carry))

    coarse = per_set(buckets.filter(F.col("_b").isNotNull()), "_b", "_c").groupBy(*groups, "_b").agg(F.sum("_c").alias("_c"))
    targets = _middle_buckets(coarse, groups)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, _units(df, value).alias(UNITS), _weight(weight).alias(WEIGHT))
    rows = rows.withColumn("_b", F.shiftright(UNITS, bucket_bits)).join(targets.select("_b").distinct(), "_b", "left_semi")
    near = per_set(rows, "_b", UNITS, WEIGHT).groupBy(*groups, "_b", UNITS).agg(F.sum(WEIGHT).alias(WEIGHT))
    return _picked(null_safe_join(near, targets, [*groups, "_b"]), groups, value_scale(df, value), name)


def ordered_bits(value: Column) -> Column:
    """A double as a 64-bit integer of the same order: the bits of its size
    (exponent, then mantissa), negative for negative numbers. So -0.0 and 0.0 are
    one value, infinities are the outermost numbers and NaN lies above them, as
    Spark and the reference order them."""
    v = value.cast("double")
    size = F.abs(v)
    # a power of two at most twice off, put right by comparing; all steps are exact
    guess = F.floor(F.log2(F.greatest(size, F.lit(2.0**-1022)))).cast("int")
    exponent = F.when(F.pow(F.lit(2.0), F.least(guess, F.lit(1023))) > size, guess - 1).when(
        (guess < 1023) & (F.pow(F.lit(2.0), F.least(guess + 1, F.lit(1023))) <= size), guess + 1
    ).otherwise(F.least(guess, F.lit(1023)))
    exponent = F.greatest(exponent, F.lit(-1022))
    fraction = (size / F.pow(F.lit(2.0), exponent) - F.lit(1.0)) * F.lit(2.0**52)
    normal = (exponent + F.lit(1023)).cast("bigint") * F.lit(1 << 52) + fraction.cast("bigint")
    subnormal = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
    infinite = F.lit(2047 << 52).cast("bigint")
    bits = F.when(F.isnan(v), infinite + F.lit(1)).when(size == F.lit(float("inf")), infinite).when(size < F.lit(2.0**-1022), subnormal).otherwise(normal)
    return F.when((v < 0) & ~F.isnan(v), -bits).otherwise(bits)


def radix_median(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, name: str = "median") -> DataFrame:
    """Exact PERCENTILE_CONT(0.5) of a float or double ``value`` per group.

    Every value is an integer of 64 ordered bits. A round counts the rows of
    each group by the next 16 bits, of those rows whose bits so far hold a
    middle rank, and keeps the one or two buckets that hold the ranks. Only such
    counts are shuffled, at most 65,536 per group and round; a hot group is
    counted map-side. The kept buckets, two rows per group, are written after
    each round, so that their size tells Spark whether they may be broadcast.

    The result is v[k1] where both middle values are equal, else
    v[k1] + (v[k2] / 2 - v[k1] / 2) in double. NULL values are left out; -0.0
    counts as 0.0; NaN is the greatest value, and a middle of infinities of both
    signs is NaN. A group without values has no row; NULL keys form groups.
    """
    keys = list(keys)
    v = F.col(value).cast("double") + F.lit(0.0)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, v.alias("_v"), ordered_bits(v).alias(UNITS), _weight(weight).alias(WEIGHT))
    kept = None
    for shift in range(64 - RADIX_BITS, -1, -RADIX_BITS):
        here = rows.withColumn("_b", F.shiftright(UNITS, shift))
        if kept is None:
            counts = here.groupBy(*keys, "_b").agg(F.sum(WEIGHT).alias("_c"), F.max("_v").alias("_v"))
            by, total = Window.partitionBy(*keys), F.sum("_c").over(Window.partitionBy(*keys))
            ranked = counts.withColumns({"_k1": F.floor((total - 1) / 2), "_k2": F.floor(total / 2), "_from": F.lit(0).cast("bigint")})
        else:
            inside = null_safe_join(here.withColumn("_up", F.shiftright(UNITS, shift + RADIX_BITS)), kept, [*keys, "_up"])
            ranked = inside.groupBy(*keys, "_up", "_from", "_k1", "_k2", "_b").agg(F.sum(WEIGHT).alias("_c"), F.max("_v").alias("_v"))
            by = Window.partitionBy(*keys, "_up")
        ranked = ranked.withColumn("_end", F.col("_from") + F.sum("_c").over(by.orderBy("_b").rowsBetween(*SO_FAR)))
        ranked = ranked.withColumn("_start", F.col("_end") - F.col("_c")).filter(_holds("_k1") | _holds("_k2"))
        kept = materialize(ranked.select(*keys, F.col("_b").alias("_up"), F.col("_start").alias("_from"), "_end", "_start", "_v", "_k1", "_k2"), "radix")
        last, kept = kept, kept.select(*keys, "_up", "_from", "_k1", "_k2")
    picked = last.groupBy(*keys).agg(F.max(F.when(_holds("_k1"), F.col("_v"))).alias("_v1"), F.max(F.when(_holds("_k2"), F.col("_v"))).alias("_v2"))
    middle = F.col("_v1") + (F.col("_v2") / F.lit(2.0) - F.col("_v1") / F.lit(2.0))
    return picked.select(*keys, F.when(F.col("_v1") == F.col("_v2"), F.col("_v1")).otherwise(middle).alias(name))


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, name: str = "median", bucket_bits: int = BUCKET_BITS
) -> DataFrame:
    """Exact median of ``value`` per group, each row counted ``weight``
    times (default 1). Decimals give an exact decimal of one more place, whole
    numbers one of one place, floats and doubles a double (``radix_median``).
    Raises a TypeError for a value that is not a number."""
    kind = df.schema[value].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return radix_median(df, keys, value, weight, name)
    if isinstance(kind, T.IntegralType):
        df = df.withColumn(value, F.col(value).cast("decimal(19,0)"))
    return histogram_median(histogram(df, keys, value, weight), keys, value_scale(df, value), name, bucket_bits)
