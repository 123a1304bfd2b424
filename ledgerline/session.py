"""Session helpers.

``local_session`` is for tests, the benchmark and small local runs. The library
changes no setting of a cluster's session; it reads ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every query in this package relies on.
REQUIRED_CONF = {
    # Zone-free timestamps are read and shown as written.
    "spark.sql.session.timeZone": "UTC",
    # Division by zero and bad casts raise, as in the reference engine.
    "spark.sql.ansi.enabled": "true",
    # Runtime re-planning: broadcast small sides once their size is known,
    # coalesce tiny shuffle partitions, split skewed join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerline") -> SparkSession:
    """A local session for tests and benchmarks (no UI, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        # local runs: small shuffles are CPU-bound here, so let AQE keep
        # several partitions instead of merging everything under 1 MB
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # local catalog tables (bucketed layouts in tests) stay out of the cwd
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="ledgerline-warehouse-"))
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is missing, a session in one JVM (``local[..]``) gets a
    scratch folder of its own; any other session raises, because a folder of
    the driver's machine would be out of the executors' reach.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    current = tempfile.mkdtemp(prefix="ledgerline-ckpt-")
    spark.conf.set("spark.checkpoint.dir", current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
