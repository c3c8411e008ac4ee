"""An extension: haplotype status from a folder of logs as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from polyloom.operators.genotype import haplotype_status

LOG = "sequence_id string, state string, ts timestamp"


def log_stream(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def status_stream(logs: DataFrame) -> DataFrame:
    """Running status of each individual; one row of counts for each is the state."""
    return haplotype_status(logs.withColumn("individual", F.substring_index("sequence_id", "_", 2)))


def windowed_counts(logs: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts of states by event time; state older than the watermark is dropped."""
    return logs.withWatermark("ts", late).groupBy(F.window("ts", width), "state").agg(F.count("*").alias("n"))


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """What is there now, then stop; a later call goes on from the checkpoint."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
