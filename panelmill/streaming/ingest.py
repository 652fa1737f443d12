"""The panel's cells from a stream of events, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.settings import DEFAULT, Settings


def stream_cells(events: DataFrame, late: str = "2 hours", settings: Settings = DEFAULT) -> DataFrame:
    """Occupancy and volume of each zone and hour of a stream (ts, user_id, value); an hour is final once the watermark passes it.

    Only hours inside the watermark are state, so it doesn't grow with the stream.
    """
    timed = events.where("user_id is not null").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return (timed.groupBy((F.col("user_id") % settings.zones).cast("int").alias("zone_id"), F.window("at", "1 hour").alias("hour"))
            .agg(F.count("*").cast("double").alias("occupancy"), F.sum("value").alias("volume"))
            .select("zone_id", F.col("hour.start").cast("timestamp_ntz").alias("ts"), "occupancy", "volume"))


def ingest(spark: SparkSession, source: str, path: str, late: str = "2 hours", settings: Settings = DEFAULT) -> DataFrame:
    """Run the stream over the Parquet files of a folder until it has read them, append final hours below path, and read them back."""
    schema = spark.read.parquet(source).schema
    events = spark.readStream.schema(schema).parquet(source)
    query = (stream_cells(events, late, settings).writeStream.format("parquet").outputMode("append").option("path", f"{path}/cells")
             .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema("zone_id int, ts timestamp_ntz, occupancy double, volume double").parquet(f"{path}/cells")
