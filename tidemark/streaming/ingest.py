"""Incremental ingestion of new telemetry files: an extension beyond the batch operators.

Files that arrived since the last run are read once (available-now trigger, checkpointed), typed and
labelled by the batch operators, and written as month partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, day: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Appends transformed rows of new CSV files to ``target``, exactly once a file."""
    rows = transform(spark.readStream.schema(schema).option("header", "true").csv(source))
    out = rows.withColumn("year", F.year(day)).withColumn("month", F.date_format(day, "MM"))
    return out.writeStream.format("parquet").partitionBy("year", "month").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def daily_counts(stream: DataFrame, day: str, key: str, late: str = "8 days") -> DataFrame:
    """Rows of each day and key of a stream, complete once the watermark has passed the day."""
    return stream.withWatermark(day, late).groupBy(F.window(day, "1 day"), key).agg(F.count("*").alias("n_rows")).select(F.to_date("window.start").alias("day"), key, "n_rows")
