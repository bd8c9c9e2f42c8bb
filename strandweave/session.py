"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

_RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # shuffles begin with many partitions and are merged by their measured size, so what one
    # task sorts or aggregates does not grow with the input
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    # compressed: rows of names and numbers take some 20 to 40 times as much memory in a sort
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # what a task reads is bounded likewise: it may sort its rows to aggregate them before the shuffle
    "spark.sql.files.maxPartitionBytes": "8m",
    "spark.sql.files.openCostInBytes": "1m",
    # settled tables take up to some 24 times their bytes once they are read: one of 8 MB made a broadcast of 235 MB,
    # which the driver holds, so the broadcast threshold is compared with this multiple of a file's size
    "spark.sql.sources.fileCompressionFactor": "24",
    # lookups by read name or node follow hot keys: let AQE split them even when
    # that costs one more exchange further up
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; memory and cores stay the cluster's."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "20g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
