"""The session settings the library is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local(cpus: int | None = None, memory: str = "8g", **settings: str) -> SparkSession:
    """A session in this process, for tests and the benchmark; on a cluster the submitter's session serves."""
    n = cpus or os.cpu_count() or 1
    conf = SETTINGS | {"spark.master": f"local[{n}]", "spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(n)} | settings
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
