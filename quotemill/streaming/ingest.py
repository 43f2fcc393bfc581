"""Documents as they arrive: parsed row by row, copies within the watermark left out, totals by time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators import parsing

LATE = "30 days"


def arriving(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream of documents."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)


def fresh(stream: DataFrame, keys: list[str], at: str, late: str = LATE) -> DataFrame:
    """Rows whose keys were not seen within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def parsed(stream: DataFrame) -> DataFrame:
    """Items of a stream of documents; parsing needs one row at a time and keeps no state."""
    return parsing.parse_quotes(stream)


def arrivals_by_window(stream: DataFrame, at: str, width: str = "7 days", late: str = LATE) -> DataFrame:
    """(window_start, source, n_docs): documents by week of arrival; a window is closed once the watermark has passed it."""
    counted = stream.where(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp_ltz")).withWatermark(at, late).groupBy(F.window(at, width), "source").agg(F.count(F.lit(1)).alias("n_docs"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "source", "n_docs")


def run_available(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Works off what has arrived and stops; started again with the same checkpoint it goes on from there."""
    result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
