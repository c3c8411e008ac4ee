"""Where executors and driver share files."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode a temporary one where none is set. Elsewhere a folder of one machine would be lost to the others, so it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    own = spark.sparkContext.getCheckpointDir()
    if where or own:
        if not own:
            spark.sparkContext.setCheckpointDir(where)
        return where or own
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    where = tempfile.mkdtemp(prefix="polyloom-")
    spark.sparkContext.setCheckpointDir(where)
    return where


def running(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """The rows with the sum of ``value`` over all rows before them in an order (0 for the first): a range sort that is written once, sums within its partitions, and the sums of
    the partitions before (one small row each). No task has all rows."""
    checkpoint_dir(df.sparkSession)
    placed = df.orderBy(*order).withColumn("part_", F.spark_partition_id()).checkpoint()
    sums = placed.groupBy("part_").agg(F.sum(value).alias("sum_"))
    before = F.coalesce(F.sum("sum_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(sums.select("part_", before.alias("start_"))), "part_").withColumn(name, F.col("start_") + inner).drop("part_", "start_")
