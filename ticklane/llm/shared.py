"""Tables written between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.session import CHECKPOINT_DIR

# rows up to which a side that was counted may be broadcast
BROADCAST_ROWS = 500_000
NO_ID = -(1 << 63)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get(CHECKPOINT_DIR, None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="ticklane-shared-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write the table once to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored table if its counted rows allow it; Spark chooses the join otherwise."""
    return F.broadcast(df) if df.count() <= rows else df


def row_key(id_column: str, text_column: str) -> list[Column]:
    """Two columns that name a row: equal rows share them, rows of one id with other texts don't."""
    return [F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("key_id"),
            F.xxhash64(F.col(text_column)).alias("key_text")]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; plain ASCII takes the fast path, null is empty."""
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))
