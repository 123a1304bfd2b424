"""Incremental typing of raw order dumps (S1 + D1 on a file stream).

New CSV files in ``source_dir`` are read with the declared raw schema; each
micro-batch is split into typed rows and rejected rows (malformed timestamp
text) and written under ``batch_id=<n>`` folders with overwrite, so a batch
replayed after a failure replaces its own output instead of duplicating it.
Progress is kept in a checkpoint under the cluster's shared
``spark.checkpoint.dir`` unless a location is given.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators.cleaning import quarantine_timestamps
from ledgerline.session import ensure_checkpoint_dir
from ledgerline.sources.schemas import RAW, TEXT_TIMESTAMPS


def start_clean_orders(
    spark: SparkSession,
    source_dir: str,
    clean_dir: str,
    rejected_dir: str,
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops."""
    checkpoint = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "stream-clean-orders")
    raw = spark.readStream.schema(RAW["orders"]).option("header", True).option("mode", "FAILFAST").csv(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        clean, rejected = quarantine_timestamps(batch, TEXT_TIMESTAMPS)
        clean.write.mode("overwrite").parquet(os.path.join(clean_dir, f"batch_id={batch_id}"))
        rejected.write.mode("overwrite").parquet(os.path.join(rejected_dir, f"batch_id={batch_id}"))

    writer = raw.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
