"""SparkSession construction with settings sized for the reports.

On a cluster the session already exists and carries the cluster's settings; ``get_session``
only fills in what is unset so it never overrides an operator's configuration.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings the reports rely on. AQE re-plans joins from runtime sizes (turns a shuffled join into a
# broadcast only when the measured side is small), splits skewed join partitions and coalesces small
# shuffle partitions, so no report hard-codes a physical strategy for a table whose size grows.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",     # as a bucket of a shared view (sources.shared)
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ledgerline", driver_memory: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    running = SparkSession.getActiveSession()
    if running is None:
        for k, v in DEFAULTS.items():
            builder = builder.config(k, v)
        if shuffle_partitions:
            builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def local_session(cpus: int | None = None, driver_memory: str = "12g") -> SparkSession:
    """Single-machine session (tests, benchmark). In local mode the driver JVM is the only
    executor, so its heap is the memory of the whole job."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return get_session(master=f"local[{cpus}]", shuffle_partitions=cpus, driver_memory=driver_memory)
