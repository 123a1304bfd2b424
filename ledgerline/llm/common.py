"""Helpers shared by the operators: cuts of lineage, connected components,
blocked groups and views of Arrow strings as numpy bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import scratch_path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    The written table survives lost executors; later jobs restart from it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every id of an undirected edge list.

    component is the smallest id reachable.  Alternating large-star and
    small-star rounds; every round is two map-side-combined aggregates and
    two joins over rows that only shrink to one edge per id, and is written
    to the shared folder.  No group is gathered: both sides of each join are
    written tables, so Spark can split the partition of a hot id.
    """
    e = (
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    e, seen = cut(e, "edges"), None
    while True:
        mark = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).union(e.select("v", "u"))
        low = cut(both.groupBy("n").agg(F.min("m").alias("lo")).select("n", F.least("n", "lo").alias("lo")), "lows")
        large = cut(e.join(low, F.col("v") == F.col("n")).select("u", F.col("lo").alias("v")), "edges")
        small_low = cut(large.groupBy("u").agg(F.min("v").alias("lo")), "lows")
        small = (
            large.join(small_low, "u").filter("v > lo").select(F.col("v").alias("u"), F.col("lo").alias("v"))
            .union(small_low.select("u", "lo"))
            .distinct()
        )
        e = cut(small, "edges")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def block_pairs(
    members: DataFrame, keys: list[str], by: str, payload: list[str], block_rows: int, weight: Column | None = None, block_weight: int = 1 << 25
) -> DataFrame:
    """Split every group of ``keys`` into hashed blocks and return one row
    per pair of blocks: keys, left (list), right (list; empty on the diagonal).

    A list holds about ``block_rows`` rows, or rows of ``block_weight``
    together, however large its group is, so a hot group spreads over many
    tasks.  Groups of one row are left out.
    """
    heavy = F.sum(F.lit(0) if weight is None else weight) / F.lit(block_weight)
    need = F.ceil(F.greatest(F.count("*") / F.lit(block_rows), heavy)).cast("int")
    sizes = cut(members.groupBy(*keys).agg(F.count("*").alias("_size"), need.alias("_blocks")).filter("_size > 1"), "sizes")
    m = members.join(sizes, keys)
    m = m.withColumn("_own", F.pmod(F.xxhash64(by, *keys), F.col("_blocks")).cast("int"))
    m = m.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    item = F.struct(*payload)
    return (
        m.withColumns({"_low": low, "_high": high})
        .groupBy(*keys, "_low", "_high")
        .agg(
            F.collect_list(F.when(F.col("_own") == F.col("_low"), item)).alias("left"),
            F.collect_list(F.when(F.col("_own") != F.col("_low"), item)).alias("right"),
        )
        .drop("_low", "_high")
    )


def lowest_reachable(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the lowest one reachable over the links x - y."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most_bytes`` together (one row may exceed it)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        yield at, min(to, n)
        at = to


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def nz(column: Column) -> Column:
    """Text with NULL as empty."""
    return F.coalesce(column.cast("string"), F.lit(""))
