"""Cut lineage by writing a table to the cluster's shared checkpoint folder.

Iterative jobs write each round as Parquet instead of caching it: the rows outlive
lost executors, and the file sizes give the optimizer exact statistics, so a side is
broadcast only when its measured size is below the session's threshold.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SERIAL = itertools.count()
_RUN = uuid.uuid4().hex[:12]


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="strandweave-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir().rstrip("/")


def settle(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df``, read it back, and return it with metrics observed while writing.

    ``rows`` is always among the metrics.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandweave-{_RUN}/{next(_SERIAL):05d}-{label}"
    watch = Observation()
    exprs = [F.count(F.lit(1)).alias("rows")] + [c.alias(k) for k, c in metrics.items()]
    # the folder is new and read only after success, so files may be committed directly
    (
        df.observe(watch, *exprs)
        .write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        # bases have two bits each, which an entropy coder finds and snappy does not
        .option("compression", "zstd")
        .parquet(path)
    )
    seen = dict(watch.get)
    seen.setdefault("rows", 0)
    return spark.read.schema(df.schema).parquet(path), seen


def table(df: DataFrame, label: str) -> DataFrame:
    return settle(df, label)[0]
