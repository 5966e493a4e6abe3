"""Searches over tick data and inventories of stored tables."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane import constants as K
from ticklane.operators.ticks import KEYS


def traverse(ticks: DataFrame, value: Column, name: str, keep: Column | None = None, first_only: bool = False) -> DataFrame:
    """Apply an aggregate to every (stock, date); ``first_only`` stops at one hit."""
    found = ticks.groupBy(*KEYS).agg(value.alias(name))
    found = found.where(keep if keep is not None else F.col(name).isNotNull())
    return found.limit(1) if first_only else found


def last_trade_time() -> Column:
    return F.max(F.when(F.col("volume") > 0, F.col("time")))


def last_trade_at(ticks: DataFrame, time: str, first_only: bool = True) -> DataFrame:
    """Stock and date whose last trade is at a given time."""
    return traverse(ticks, last_trade_time(), "last_time", F.col("last_time") == time, first_only)


def trades_after_close(ticks: DataFrame) -> DataFrame:
    return ticks.where((F.col("time") >= K.SESSION_END) & (F.col("volume") > 0))


def repeated_trades(ticks: DataFrame) -> DataFrame:
    """Traded rows whose time repeats, and the row after each of them."""
    repeated = (F.col("volume") > 0) & (F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "time")) > 1)
    day = Window.partitionBy(*KEYS).orderBy("time", "tick_order")
    marked = ticks.withColumn("_repeated", repeated)
    marked = marked.withColumn("_after", F.coalesce(F.lag("_repeated").over(day), F.lit(False)))
    return marked.where(F.col("_repeated") | F.col("_after")).withColumn("is_repeat", F.col("_repeated")) \
        .drop("_repeated", "_after")


def movable_noon_trades(ticks: DataFrame) -> DataFrame:
    """Traded rows inside the noon break of days without a traded 11:30:00 row."""
    day = Window.partitionBy(*KEYS)
    noon_trade = F.max(F.when((F.col("time") == K.NOON_END) & (F.col("volume") > 0), 1).otherwise(0)).over(day)
    inside = (F.col("time") > K.NOON_END) & (F.col("time") < K.NOON_START) & (F.col("volume") > 0)
    return ticks.withColumn("_noon", noon_trade).where(inside & (F.col("_noon") == 0)).drop("_noon")


def missing_noon_record(ticks: DataFrame) -> DataFrame:
    """(stock, date) without an 11:30:00 row."""
    return traverse(ticks, F.sum(F.when(F.col("time") == K.NOON_END, 1).otherwise(0)), "noon_rows",
                    F.col("noon_rows") == 0).select(*KEYS)


def auction_duplicates(ticks: DataFrame) -> DataFrame:
    auction = ticks.where((F.col("time") >= K.AUCTION_START) & (F.col("time") < K.AUCTION_SECOND_STAGE_END))
    return auction.withColumn("repeats", F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "time"))) \
        .where(F.col("repeats") > 1)


def closing_duplicates(ticks: DataFrame) -> DataFrame:
    """(stock, date) with several 15:00:00 rows."""
    return ticks.where(F.col("time") == K.SESSION_END).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows")) \
        .where(F.col("rows") > 1)


def cells_equal(data: DataFrame, value, columns: list[str], keys: list[str]) -> DataFrame:
    """One row per cell equal to a value: keys and column name."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    hits = F.filter(cells, lambda cell: cell["value"] == value)
    return data.select(*keys, F.explode(hits).alias("_cell")).select(*keys, F.col("_cell.column").alias("column"))


def columns_equal(data: DataFrame, value, columns: list[str], keys: list[str]) -> DataFrame:
    """Array of the columns equal to a value per row, for rows that have any."""
    names = F.filter(F.array(*[F.when(F.col(c) == value, F.lit(c)) for c in columns]), lambda n: n.isNotNull())
    return data.select(*keys, names.alias("columns")).where(F.size("columns") > 0)


def table_inventory(ticks: DataFrame, product: Column) -> DataFrame:
    """Contracts, rows and date range per product."""
    return ticks.groupBy(product.alias("product")).agg(
        F.count_distinct("instrument").alias("instruments"), F.count_distinct("date").alias("dates"),
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def contract_detail(ticks: DataFrame) -> DataFrame:
    """Rows and first and last time per contract."""
    return ticks.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("rows"), F.min("datetime").alias("first_time"), F.max("datetime").alias("last_time"))


def daily_counts(ticks: DataFrame, keys: list[str]) -> DataFrame:
    return ticks.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def monthly_stock_days(ticks: DataFrame) -> DataFrame:
    """Stock days per year and month. Pairs are made distinct first, so the count is a plain sum."""
    return ticks.select(*KEYS).distinct().groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.count(F.lit(1)).alias("stock_days"))


def _hash_order(seed: int, keys: list[str]) -> Column:
    """The same random-looking order on any cluster and after any retry."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(key).cast("string") for key in keys]))


def window_sample(data: DataFrame, keys: list[str], position: str, rows: int, picks: int, seed: int = 7) -> DataFrame:
    """``rows`` consecutive rows from a random start in each of ``picks`` randomly chosen key groups."""
    groups = data.groupBy(*keys).agg(F.max(position).alias("_max"))
    place = F.conv(F.substring(_hash_order(seed + 1, keys), 1, 12), 16, 10).cast("bigint")
    chosen = groups.orderBy(_hash_order(seed, keys)).limit(picks).withColumn(
        "_start", place % F.greatest(F.col("_max") - rows + 2, F.lit(1)))
    return data.join(chosen, keys).where(
        (F.col(position) >= F.col("_start")) & (F.col(position) < F.col("_start") + rows)).drop("_max", "_start")


def paired_sample(left: DataFrame, right: DataFrame, keys: list[str], picks: int, seed: int = 7) -> DataFrame:
    """Rows of both layers for randomly chosen keys that occur in both, tagged with their layer."""
    both = left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_semi")
    # a few keys; as values they are looked for where the layers are read
    chosen = both.orderBy(_hash_order(seed, keys)).limit(picks).collect()
    of_key = lambda row: reduce(and_, [F.col(key) == F.lit(row[key]) for key in keys])
    wanted = reduce(or_, [of_key(row) for row in chosen], F.lit(False))
    tag = lambda df, layer: df.where(wanted).withColumn("layer", F.lit(layer))
    return tag(left, "original").unionByName(tag(right, "organized"))


def every_kth(data: DataFrame, position: str, k: int) -> DataFrame:
    return data.where(F.col(position) % k == 0)


def side_by_side(feeds: dict[str, DataFrame], condition: Column) -> DataFrame:
    """The same slice of several feeds with a feed column."""
    parts = [feed.where(condition).withColumn("feed", F.lit(name)) for name, feed in feeds.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
