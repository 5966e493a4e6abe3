"""Incremental bars from arriving tick files.

Files that were processed are remembered by the checkpoint, so a run only works on new ones. A slot
is written once the watermark has passed it; empty slots and day-close returns need the whole day
and stay with the batch functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def slot_stream(ticks: DataFrame, step_seconds: int, lateness: str = "10 minutes", price: str = "last_price",
                volume: str = "delta_volume", moment: str = "datetime") -> DataFrame:
    """Open, close, high, low and volume per contract and slot, labelled by the right edge."""
    stamped = ticks.withColumn("_at", F.col(moment).cast("timestamp")).withWatermark("_at", lateness)
    slots = stamped.where(F.col(volume) > 0).groupBy(
        "instrument", F.window("_at", f"{step_seconds} seconds").alias("_slot")).agg(
        F.min_by(price, F.struct(moment, "tick_id")).alias("open"), F.max_by(price, F.struct(moment, "tick_id")).alias("close"),
        F.max(price).alias("high"), F.min(price).alias("low"), F.sum(volume).alias("volume"))
    return slots.select("instrument", F.col("_slot.end").alias("slot_end"), "open", "close", "high", "low", "volume")


def read_tick_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def write_new_slots(slots: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived since the last run, then stop. ``checkpoint`` must be shared storage."""
    return (
        slots.writeStream.outputMode("append").format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
