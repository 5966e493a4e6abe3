"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ticklane")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        # reads of GBK files
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application below ``spark.checkpoint.dir``, which the driver and all executors share.

    Only a local session without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get(CHECKPOINT_DIR, None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="ticklane-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# rows of fixed width up to which a counted table may be broadcast
BROADCAST_ROWS = 200_000


def stored(df: DataFrame) -> DataFrame:
    """Write the table once to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_key_rows(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Join a table with one row of fixed width per key (a single row without keys).

    The table is stored and counted: a key may hold any share of the rows of ``df``, so they are shuffled on it only if
    the keys are too many for a broadcast, and then a key's rows are few. Null keys meet null keys.
    """
    table = stored(table)
    few = not keys or table.count() <= BROADCAST_ROWS
    names = {key: f"_key_{i}" for i, key in enumerate(keys)}
    table = table.withColumnsRenamed(names)
    same = F.lit(True)
    for key, name in names.items():
        same = same & F.col(key).eqNullSafe(F.col(name))
    return df.join(F.broadcast(table) if few else table, same).drop(*names.values()) if keys else df.crossJoin(F.broadcast(table))
