from pyspark.sql import functions as F

from strandweave.plans.settle import table
from strandweave.session import tune


def test_small_files_of_many_rows_are_not_broadcast(spark):
    tune(spark)
    rows = table(spark.range(3_000_000).select("id", (F.col("id") * 3).alias("x")).coalesce(1), "many")
    few = table(spark.range(1000).withColumnRenamed("id", "x").coalesce(1), "few")
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert size(rows) > 3_000_000 * 16
    assert "BroadcastExchange" not in plan(rows.join(rows.withColumnRenamed("x", "y"), "id"))
    assert "BroadcastExchange" in plan(rows.join(few, "x"))
