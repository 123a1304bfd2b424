"""Sources and sinks: raw CSV load (S1), versioned writes (S7), layouts.

Nothing here infers a schema: every reader takes the declared StructType.
Sinks write a *new* path; a path that is being read is never overwritten.
"""

from __future__ import annotations

import os
import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import scratch_path
from ledgerline.sources.schemas import RAW

# Where a row is stored, most significant first (see ``with_stored_order``).
STORED_ORDER = ["_stored_file", "_stored_block", "_stored_row"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate under the shared checkpoint folder and read it
    back, so that several readers share one computation and a lost executor
    costs no more than a re-read."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_stored_order(df: DataFrame) -> DataFrame:
    """Add the columns ``STORED_ORDER`` to a DataFrame read straight from files:
    the greater they are, the later the row is stored (file name, block of the
    file, row). Keep-last then keeps the copy that was stored last.

    Parquet names the row; for text files, rows of one block are numbered as
    they are read.
    """
    if "row_index" in df.select("_metadata").schema["_metadata"].dataType.names:
        block, row = F.lit(0).cast("bigint"), F.col("_metadata.row_index")
    else:
        block, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    return df.select("*", F.col("_metadata.file_path").alias("_stored_file"), block.alias("_stored_block"), row.alias("_stored_row"))


def read_raw_csv(spark: SparkSession, path: str, table: str, mode: str = "FAILFAST", header: bool = True) -> DataFrame:
    """A raw CSV dump with the table's declared raw schema.

    ``mode`` is Spark's CSV parse mode: FAILFAST aborts on a malformed line,
    PERMISSIVE turns unparsable fields into NULL. Timestamps stay text here;
    the cleaning step types them. An empty field reads as NULL (Spark's
    default ``nullValue``), so an empty timestamp text in a dump is a NULL
    timestamp, not a rejected one.
    """
    return spark.read.schema(RAW[table]).option("header", header).option("mode", mode).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Write a table as CSV with a header (used to stage raw dumps)."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_version(df: DataFrame, path: str) -> str:
    """Write an immutable new version of a table as parquet.

    Fails if ``path`` exists: the reference rewrites tables in place, here
    each step writes a new version and the old one stays readable. Writing
    a table also cuts the lineage for later steps (read it back).
    """
    df.write.mode("errorifexists").parquet(path)
    return path


def write_range_layout(df: DataFrame, path: str, key: str, n_files: int, sort_by: Sequence[str] | None = None) -> str:
    """Range-partition and sort by ``key`` so min/max statistics in the
    parquet footers let filters on ``key`` skip files and row groups (the
    re-aimed B-tree index on a lookup column)."""
    cols = list(sort_by or [key])
    df.repartitionByRange(n_files, key).sortWithinPartitions(*cols).write.mode("errorifexists").parquet(path)
    return path


def write_bucketed(df: DataFrame, table: str, path: str, key: str, n_buckets: int) -> str:
    """Bucket by a join key (re-aimed index on a foreign key).

    Tables bucketed the same way on the join key join without a shuffle.
    The table is registered in the session catalog at ``path``.
    """
    (df.write.mode("errorifexists").format("parquet").option("path", path)
       .bucketBy(n_buckets, key).sortBy(key).saveAsTable(table))
    return path


def read_version(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """Read back a written version (with the clean schema when known)."""
    from ledgerline.sources.schemas import CLEAN

    reader = spark.read
    if table and table in CLEAN:
        reader = reader.schema(CLEAN[table])
    return reader.parquet(path)


def version_path(base: str, table: str, version: str) -> str:
    return os.path.join(base, table, version)
