"""Session settings shared by the library, the bench and the tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Runtime settings the operators rely on. Everything is event time in UTC; AQE
# coalesces small shuffles and splits skewed joins.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A batch for Python ends here, not only at its ten thousandth row, which may be a long page.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "changeflow", master: str | None = None, cpus: int | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster pass an existing one to `configure`."""
    cpus = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.appName(app)
        .master(master or f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        # Small local data: keep all cores busy instead of merging partitions up to a megabyte.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
