"""Statistics of a growing ensemble of maps: realisations arrive as files, and node statistics follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """nodes(realisation, i, j, value) from Parquet files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def statistics(nodes: DataFrame) -> DataFrame:
    """Per node: count, mean and standard deviation (n - 1) so far. The state is three numbers a node, whatever the ensemble's size."""
    return nodes.groupBy("i", "j").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def windowed_rates(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Samples per well and time window, for logs that arrive while drilling: (window, well, n, mean). Rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "well").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def run(out: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Start a query into a table in memory, for small results and tests; checkpoint is a shared folder."""
    return out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).start()
