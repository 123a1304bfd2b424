"""Loading raw CSV dumps with a reject channel.

A line that does not fit the declared schema is neither dropped nor turned into
NULLs: it is kept whole, with its file, its place there and what is wrong.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.session import scratch_path
from ledgerline.sources.schemas import RAW

# Columns that the staged table has beside the declared ones.
LINE, FILE, BLOCK, ROW = "_load_line", "_load_file", "_load_block", "_load_row"
QUOTED = {"quote": '"', "escape": '"'}


@dataclass(frozen=True)
class CsvLoad:
    """A loaded dump: ``staged`` holds every record once, typed, with its place."""

    staged: DataFrame
    schema: T.StructType
    options: dict[str, str]

    @cached_property
    def rows(self) -> DataFrame:
        """The records that fit the declared schema."""
        return self.staged.filter(F.col(LINE).isNull()).select(*self.schema.names)

    @cached_property
    def _blocks(self) -> DataFrame:
        """Per block of a file: its first row and how many records of the file
        come before it. The window sees one row per block."""
        blocks = self.staged.groupBy(FILE, BLOCK).agg(F.min(ROW).alias("_first"), F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        return blocks.select(FILE, BLOCK, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))

    @cached_property
    def rejects(self) -> DataFrame:
        """file, block (its first byte), record (1, 2, ... in the file, blank
        lines and the header not counted), line (as it stands there), problem
        and column_name.

        ``problem`` is 'field_count' (too few or too many fields, column_name
        NULL) or 'value' (column_name: the first column whose text is not of its type).
        """
        broken = self.staged.filter(F.col(LINE).isNotNull()).select(FILE, BLOCK, ROW, LINE)
        parse = {**self.options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": LINE}

        def reread(types: list[str]) -> Column:
            fields = [f"`{name}` {type_}" for name, type_ in zip(self.schema.names, types)]
            return F.from_csv(F.col(LINE), ", ".join([*fields, f"{LINE} string"]), parse)

        # as at the load, a field that is not of its type is NULL where its text isn't
        bad_value = F.coalesce(*[
            F.when(F.col(f"_text.`{n}`").isNotNull() & F.col(f"_typed.`{n}`").isNull(), F.lit(n)) for n in self.schema.names
        ])
        told = broken.withColumns({
            "_text": reread(["string"] * len(self.schema)), "_typed": reread([f.dataType.simpleString() for f in self.schema]),
        }).withColumn("_count", F.col(f"_text.{LINE}").isNotNull())
        return told.join(self._blocks, [FILE, BLOCK]).select(
            F.col(FILE).alias("file"), F.col(BLOCK).alias("block"),
            (F.col("_before") + F.col(ROW) - F.col("_first") + F.lit(1)).alias("record"), F.col(LINE).alias("line"),
            F.when(F.col("_count"), F.lit("field_count")).otherwise(F.lit("value")).alias("problem"),
            F.when(~F.col("_count"), bad_value).alias("column_name"),
        )

    @cached_property
    def report(self) -> DataFrame:
        """file, n_records, n_rejected: one row per file that holds records."""
        return self.staged.groupBy(F.col(FILE).alias("file")).agg(
            F.count(F.lit(1)).alias("n_records"), F.count(LINE).alias("n_rejected"))


def load_csv(spark: SparkSession, path: str, table: str | T.StructType, header: bool = True, multi_line: bool = False) -> CsvLoad:
    """Read a dump once, typed by the declared raw schema (a table's name or a
    ``StructType``), and stage it as Parquet under the shared checkpoint folder.

    A record is rejected if its number of fields differs from the schema's or
    a field's text is not of its type; the rest of the load goes on. Quotes are
    doubled inside quoted fields. An empty field is NULL. With ``header``, a
    file whose first line does not name the declared columns, in their order, fails
    the load. Blank lines are no records. ``multi_line`` lets quoted fields hold line
    breaks; a file is then one task's work, and a quote left open takes what follows.
    Files without records give no rows anywhere.

    Staging fixes each record's place for good: later reads (after the loss of
    an executor, with another number of cores) do not split the dump anew.
    """
    schema = RAW[table] if isinstance(table, str) else table
    options = dict(QUOTED)
    read = (
        spark.read.schema(T.StructType([*schema.fields, T.StructField(LINE, T.StringType())]))
        .options(**options, header=header, multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=LINE)
        .option("enforceSchema", not header)
        .option("columnPruning", False)
        .csv(path)
    )
    placed = read.select(
        "*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK), F.monotonically_increasing_id().alias(ROW))
    staged = scratch_path(spark, f"csv-load-{uuid.uuid4().hex}")
    placed.write.parquet(staged)
    return CsvLoad(spark.read.schema(placed.schema).parquet(staged), schema, options)
