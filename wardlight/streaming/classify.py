"""Classification of a stream of captures, an extension: every row is judged by itself, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.classify import classify_rows


def read_captures(spark: SparkSession, folder: str, schema: str, most_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def once_per_url(captures: DataFrame, at: str = "captured_at", delay: str = "1 hour") -> DataFrame:
    """The first capture of a url within the delay."""
    return captures.withWatermark(at, delay).dropDuplicatesWithinWatermark(["url"])


def write_labels(captures: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the labels of a stream of captures (job_id, url, html, ...) to a table of Parquet files."""
    labels = classify_rows(captures).select("job_id", "path", "label", "confidence", F.array_join("classified_as", ",").alias("classified_as"))
    writer = labels.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def hourly_counts(labels: DataFrame, at: str = "captured_at", delay: str = "1 hour") -> DataFrame:
    """Labels an hour, of a stream or a table with a time."""
    return labels.withWatermark(at, delay).groupBy(F.window(at, "1 hour").alias("hour"), "label").agg(F.count(F.lit(1)).alias("n"))
