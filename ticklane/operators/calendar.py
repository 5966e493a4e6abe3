"""Trading calendar and metadata queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane import constants as K
from ticklane.functions.intervals import join_intervals


def trading_dates(config: DataFrame, start=None, end=None) -> DataFrame:
    """Valid (stock, date) pairs, optionally inside a span."""
    valid = config.where(F.col("status") == K.STATUS_OK)
    if start is not None:
        valid = valid.where(F.col("date") >= F.lit(start))
    if end is not None:
        valid = valid.where(F.col("date") <= F.lit(end))
    return valid.select("tscode", "date").distinct()


def trading_date_lists(config: DataFrame, start=None, end=None) -> DataFrame:
    """Sorted array of valid dates per stock; a stock has one entry per trading day at most."""
    return trading_dates(config, start, end).groupBy("tscode").agg(F.sort_array(F.collect_list("date")).alias("dates"))


def invalid_pairs(config: DataFrame, statuses=(K.STATUS_SUSPENDED, K.STATUS_BAD_DATA)) -> DataFrame:
    return config.where(F.col("status").isin(*statuses)).select("date", "tscode").distinct()


def invalid_dates(config: DataFrame, statuses=(K.STATUS_SUSPENDED, K.STATUS_BAD_DATA)) -> DataFrame:
    return config.where(F.col("status").isin(*statuses)).select("date").distinct()


def special_treatment(config: DataFrame) -> DataFrame:
    """(date, stock) pairs under special treatment."""
    return config.where(F.col("is_st") == 1).select("date", "tscode").distinct()


def mark_special_treatment(config: DataFrame, daily_status: DataFrame) -> DataFrame:
    """Set is_st from a daily status table (date, tscode, is_st)."""
    status = daily_status.groupBy("date", "tscode").agg(F.max("is_st").alias("_st"))
    return config.join(status, ["date", "tscode"], "left").withColumn(
        "is_st", F.coalesce(F.col("_st"), F.col("is_st"))).drop("_st")


def mark_suspended(config: DataFrame, traded: DataFrame) -> DataFrame:
    """Status 1 for constituents that did not trade on a date."""
    seen = traded.select("date", "tscode").distinct().withColumn("_traded", F.lit(True))
    return config.join(seen, ["date", "tscode"], "left").withColumn(
        "status", F.when(F.col("_traded").isNull(), K.STATUS_SUSPENDED).otherwise(F.col("status"))).drop("_traded")


def contract_spans(contracts: DataFrame) -> DataFrame:
    """First and last date of each contract."""
    return contracts.groupBy("product", "instrument").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))


def main_spans(contracts: DataFrame) -> DataFrame:
    """First and last date on which a contract is the main one."""
    return contract_spans(contracts.where(F.col("is_main") == K.IS_MAIN))


def main_contracts(contracts: DataFrame) -> DataFrame:
    """Main contract per product and date."""
    return contracts.where(F.col("is_main") == K.IS_MAIN).select("product", "date", "instrument")


def dates_outside(contracts: DataFrame, start, end) -> DataFrame:
    date = F.col("date")
    return contracts.where((date < F.lit(start)) | (date > F.lit(end))).select("date").distinct()


def neighbour_dates(dates: DataFrame, n: int, keys: list[str] | None = None, backward: bool = True,
                    needs_more: bool = False) -> DataFrame:
    """For each date the n-th trading date before (or after) and the list of all up to it.

    Where fewer exist the date is null and the list holds those; ``needs_more`` demands more than n of them.
    """
    keys = keys or []
    calendar = dates.select(*keys, "date").distinct()
    day = Window.partitionBy(*keys).orderBy("date")
    frame = day.rowsBetween(-n, -1) if backward else day.rowsBetween(1, n)
    single = F.lag("date", n).over(day) if backward else F.lead("date", n).over(day)
    if needs_more:
        one_more = F.lag("date", n + 1).over(day) if backward else F.lead("date", n + 1).over(day)
        single = F.when(one_more.isNotNull(), single)
    return calendar.withColumn("neighbour", single).withColumn("dates", F.collect_list("date").over(frame))


def latest_dates(dates: DataFrame, n: int) -> DataFrame:
    """The last n dates."""
    return dates.select("date").distinct().orderBy(F.desc("date")).limit(n)


def day_window(ticks: DataFrame, calendar: DataFrame, days: int) -> DataFrame:
    """Ticks of the ``days`` trading days of the stock before each date, tagged with that date as ``for_date``.

    Each tick goes to the dates it serves (``days`` of them at most), found on the calendar of its stock.
    """
    day = Window.partitionBy("tscode").orderBy("date").rowsBetween(1, days)
    serves = calendar.select("tscode", "date").distinct().withColumn("_for", F.collect_list("date").over(day))
    return ticks.join(serves, ["tscode", "date"]).withColumn("for_date", F.explode("_for")).drop("_for")


def expand_intervals(constituents: DataFrame, dates: DataFrame) -> DataFrame:
    """(product, date, tscode) of interval rows over a date list, with the default status."""
    distinct = dates.select("date").distinct()
    return join_intervals(constituents, distinct, "start_date", "end_date", "date").select("product", "date", "tscode").distinct() \
        .withColumn("status", F.lit(K.STATUS_OK)).withColumn("is_st", F.lit(0))


def compress_intervals(daily: DataFrame) -> DataFrame:
    """Runs of dates with an equal set of stocks, per product: start, end, size and fingerprint.

    The set of a date is summed up by an order-free fingerprint, so it is never collected.
    """
    code = F.xxhash64("tscode").cast("decimal(38,0)")
    per_date = daily.select("product", "date", "tscode").distinct().groupBy("product", "date").agg(
        F.count(F.lit(1)).alias("stocks"), F.sum(code).alias("_sum"), F.bit_xor(F.xxhash64("tscode", F.lit(1))).alias("_xor"))
    day = Window.partitionBy("product").orderBy("date")
    changed = F.coalesce(
        (F.lag("_sum").over(day) != F.col("_sum")) | (F.lag("_xor").over(day) != F.col("_xor"))
        | (F.lag("stocks").over(day) != F.col("stocks")), F.lit(True))
    runs = per_date.withColumn("_changed", changed.cast("int")).withColumn(
        "_run", F.sum("_changed").over(day.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("product", "_run").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.max("stocks").alias("stocks")).drop("_run")


def without_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not listed: deletion, or skipping finished work."""
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def run_records(results: DataFrame, run_code: str, moment: Column | None = None) -> DataFrame:
    """Tag result rows with a run code and time, to append to a record table."""
    return results.withColumn("run_code", F.lit(run_code)).withColumn(
        "created", F.current_timestamp() if moment is None else moment)
