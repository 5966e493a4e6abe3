"""Readers and writers of the stored layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane import constants as K
from ticklane.functions.scalar import contract_from_path
from ticklane.operators.bars import strip_contract_prefix
from ticklane.operators.ticks import name_stock_columns
from ticklane.sources import records


def read_table(spark: SparkSession, path: str, dates: list | None = None, stocks: list | None = None,
               columns: list[str] | None = None) -> DataFrame:
    """A stored table; dates, stocks and columns prune the scan."""
    table = spark.read.parquet(path)
    if dates is not None:
        table = table.where(F.col("date").isin(dates))
    if stocks is not None:
        table = table.where(F.col("tscode").isin(stocks))
    return table.select(*columns) if columns else table


def read_pairs(spark: SparkSession, path: str, pairs: DataFrame, keys: tuple[str, ...] = ("date", "tscode")) -> DataFrame:
    """The requested (date, stock) pairs of a stored table."""
    return spark.read.parquet(path).join(pairs.select(*keys).distinct(), list(keys), "left_semi")


def write_table(table: DataFrame, path: str, partitions: list[str], replace_touched: bool = False) -> None:
    """Write a partitioned table. ``replace_touched`` overwrites only the partitions present in ``table``.

    Rows are gathered by partition and rebalanced by bytes: small partitions share a task and have a file each, a large
    one is split over as many tasks as ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` asks for.
    """
    writer = table.hint("rebalance", *[F.col(name) for name in partitions]).write.mode("overwrite").partitionBy(*partitions)
    if replace_touched:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def append_table(table: DataFrame, path: str) -> None:
    table.write.mode("append").parquet(path)


def read_stock_csv(spark: SparkSession, path: str, constituents: DataFrame | None = None,
                   encoding: str = "GBK") -> DataFrame:
    """Level-2 stock ticks from CSV with named columns, of constituents only if given.

    For GBK the session needs ``spark.sql.legacy.javaCharsets``, as in :func:`ticklane.session.local_session`.
    """
    raw = spark.read.option("header", True).option("encoding", encoding).csv(path)
    ticks = name_stock_columns(raw)
    text = {"tscode", "exchange_tscode", "date", "time", "transaction_flag", "bs_flag"}
    whole = {"volume", "transaction_number", "daily_accumulated_volume", "total_ask_volume", "total_bid_volume"}
    typed = [F.col(c) if c in text else F.col(c).cast("bigint" if c in whole or "_volume" in c else "double").alias(c)
             for c in ticks.columns]
    ticks = ticks.select(*typed)
    if constituents is not None:
        ticks = ticks.join(constituents.select("tscode").distinct(), "tscode", "left_semi")
    return ticks


def read_future_csv(spark: SparkSession, path: str, contracts: list[str], exchange: str = "CFFEX") -> DataFrame:
    """Futures ticks of several contracts, one CSV each, with the contract prefix taken off the columns."""
    tables = []
    for contract in contracts:
        raw = spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/{exchange}.{contract}.csv")
        # a dotted name needs quoting until the prefix is gone
        ticks = strip_contract_prefix(raw, contract, exchange)
        tables.append(ticks.withColumn("instrument", F.lit(contract)))
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result


FUTURE_COLUMNS = ["datetime", "last_price", "highest", "lowest", "bid_price1", "bid_volume1", "ask_price1", "ask_volume1",
                  "volume", "amount", "open_interest"]


def read_future_folder(spark: SparkSession, path: str, exchange: str = "CFFEX") -> DataFrame:
    """Futures ticks of all contracts below a folder in one scan.

    Columns are taken by position, as their headers carry the contract; the contract is that of the file's or its
    folder's name, such as ``CFFEX.IF2209.csv``.
    """
    types = {"datetime": "string", **{c: "bigint" for c in ("bid_volume1", "ask_volume1", "volume", "open_interest")}}
    schema = ", ".join(f"{c} {types.get(c, 'double')}" for c in FUTURE_COLUMNS)
    ticks = spark.read.option("header", True).option("recursiveFileLookup", True).schema(schema).csv(path)
    contract = F.regexp_extract(F.col("_metadata.file_path"), rf"{exchange}\.([A-Za-z]+[0-9]+)[./]", 1)
    return ticks.select(*FUTURE_COLUMNS, contract.alias("instrument"))


def with_contract(table: DataFrame) -> DataFrame:
    """Add the contract found in the name of the file a row came from."""
    return table.withColumn("instrument", contract_from_path(F.col("_metadata.file_path")))


def read_daily_text(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated daily bars."""
    schema = "date string, open double, high double, low double, close double, volume bigint, amount double"
    return spark.read.option("sep", "\t").schema(schema).csv(path)


def read_fixed_width(spark: SparkSession, path: str, settled: bool = False) -> DataFrame:
    """Daily bars stored as 32-byte records, with the contract of the file's name; ``settled`` has float prices and a settlement price."""
    records.register(spark)
    return spark.read.format("records").option("layout", "settled" if settled else "daily").load(path)


def write_fixed_width(bars: DataFrame, path: str, settled: bool = False) -> None:
    """Write bars (instrument, date as yyyymmdd, and the fields of the layout) as records, a file per contract and task.

    Whole fields that are missing are 0; values that a field can't hold fail.
    """
    records.register(bars.sparkSession)
    ordered = bars.hint("rebalance", F.col("instrument")).sortWithinPartitions("instrument", "date")
    ordered.write.format("records").option("layout", "settled" if settled else "daily").mode("append").save(path)


def read_metadata(spark: SparkSession, path: str | None = None, url: str | None = None, table: str | None = None,
                  properties: dict | None = None) -> DataFrame:
    """A metadata table, stored as parquet or read over JDBC."""
    if path is not None:
        return spark.read.parquet(path)
    return spark.read.jdbc(url, table, properties=properties or {})


def read_factor_list(spark: SparkSession, path: str) -> DataFrame:
    """Factor configuration: code, version, type, number, name, parameter, source."""
    schema = "code string, version string, type string, number string, name string, parameter string, source string"
    return spark.read.option("header", True).schema(schema).csv(path)


def read_factor(spark: SparkSession, path: str, code: str, product: str | None = None,
                organized: bool = False) -> DataFrame:
    """A stored factor table of the raw or the organized layer."""
    layer = "organized" if organized else "raw"
    table = spark.read.parquet(f"{path}/{layer}/{code}")
    return table if product is None else table.where(F.col("product") == product)


def write_factor(table: DataFrame, path: str, code: str, organized: bool = False) -> None:
    layer = "organized" if organized else "raw"
    write_table(table, f"{path}/{layer}/{code}", ["product"], replace_touched=True)


def write_report(table: DataFrame, path: str) -> None:
    """A small report as CSV with a header."""
    table.write.mode("overwrite").option("header", True).csv(path)


def read_book_patch(spark: SparkSession, path: str) -> DataFrame:
    """Book patch landed as parquet: date, tscode, hhmmss (int), bid0_price .. ask9_volume."""
    table = spark.read.parquet(path)
    levels = [F.col(f"{side}{i - 1}_{field}").alias(f"{side}_{field}{i}") for side in ("bid", "ask")
              for i in range(1, K.BOOK_DEPTH + 1) for field in ("price", "volume")]
    clock = F.lpad(F.col("hhmmss").cast("string"), 6, "0")
    time = F.concat(clock.substr(1, 2), F.lit(":"), clock.substr(3, 2), F.lit(":"), clock.substr(5, 2), F.lit(".000"))
    return table.select("tscode", "date", time.alias("time"), *levels)
