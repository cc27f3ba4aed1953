"""What changes between runs, as a stream: new documents are measured as they arrive.

The reference point is a run's findings; a stream adds each batch's new ones. Windowed
counts are kept by event time with a watermark, so late rows are counted until it passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import craft


def arriving(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def measured(stream: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Readability of arriving documents; no state."""
    return craft.readability(stream, 1, id_col, text_col)


def fresh(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Rows with a key not seen within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def activity(stream: DataFrame, at: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, window), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def into(stream: DataFrame, path: str, checkpoint: str):
    """Append to a table; a restarted stream goes on from its checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
