"""Session used by the bench and the tests; a cluster brings its own."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", app: str = "tiercurve") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        # Few bytes of customers' months become many rows: partitions of the default 1 MB would leave cores idle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # The default of 100 is less than one query of many stages generates.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tiercurve-warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
