"""The raw-orders stream gives the same split as the batch quarantine."""

import os
import tempfile

from ledgerline.operators.cleaning import quarantine_timestamps
from ledgerline.sources.io import read_raw_csv, write_csv
from ledgerline.sources.schemas import TEXT_TIMESTAMPS
from ledgerline.sources.tables import raw_tables
from ledgerline.streaming.raw_orders import start_clean_orders
from tests.conftest import SF01


def test_stream_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="ll-stream-")
    raw = raw_tables(spark, SF01, defects=True).orders
    src = os.path.join(base, "src")
    write_csv(raw, src)
    q = start_clean_orders(spark, src, os.path.join(base, "clean"), os.path.join(base, "rejected"),
                           checkpoint=os.path.join(base, "ckpt"))
    q.awaitTermination(300)
    clean = spark.read.parquet(os.path.join(base, "clean"))
    rejected = spark.read.parquet(os.path.join(base, "rejected"))
    # same input in batch mode (an empty CSV field reads as NULL)
    b_clean, b_rejected = quarantine_timestamps(read_raw_csv(spark, src, "orders"), TEXT_TIMESTAMPS)
    assert rejected.count() == b_rejected.count() > 0
    assert clean.drop("batch_id").exceptAll(b_clean).count() == 0
    assert clean.count() == b_clean.count()
