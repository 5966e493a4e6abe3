"""Repairs of the organized tick layer, each a table-to-table function keyed by (stock, date).

``data`` is the layer to repair and ``raw`` the original one; both carry ``tick_order``, the order
of rows in their source.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane import constants as K
from ticklane.functions.series import previous_value
from ticklane.functions.scalar import nearly_equal, price_limit_rate, swap_date_format, time_string, whole_seconds
from ticklane.operators.ticks import BOOK_COLUMNS, KEYS, in_session

def _day():
    return Window.partitionBy(*KEYS)


def _ordered():
    return Window.partitionBy(*KEYS).orderBy("time", "tick_order")


def _like(rows: DataFrame, data: DataFrame) -> DataFrame:
    return rows.select(*data.columns)


def _union(data: DataFrame, rows: DataFrame) -> DataFrame:
    return data.unionByName(_like(rows, data))


def restore_auction_duplicates(data: DataFrame | Callable[..., DataFrame], raw: DataFrame) -> DataFrame:
    """Add the raw auction rows whose time occurs more than once.

    ``data`` is the layer or the function that organizes it (``clean_stock_ticks``): then the raw rows are read and sorted
    once for both.
    """
    auction = (F.col("time") >= K.AUCTION_START) & (F.col("time") < K.AUCTION_SECOND_STAGE_END)
    rows = F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "time"))
    if not isinstance(data, DataFrame):
        return data(raw, original=auction & (rows > 1)).drop("_original")
    return _union(data, raw.where(auction).withColumn("_n", rows).where(F.col("_n") > 1))


def _beside(data: DataFrame, rows: DataFrame) -> DataFrame:
    """The layer and, tagged by ``_extra``, raw rows that may join it.

    What a day of the layer holds is then a window over both: the layer is read once. ``_known`` tells the days that the
    layer has; keys with nulls are no day.
    """
    both = data.withColumn("_extra", F.lit(False)).unionByName(_like(rows, data).withColumn("_extra", F.lit(True)))
    has_key = F.col(KEYS[0]).isNotNull() & F.col(KEYS[1]).isNotNull()
    return both.withColumn("_known", has_key & _any(~F.col("_extra")))


def _any(condition: Column) -> Column:
    """Whether some row of the day meets the condition."""
    return F.max(F.when(condition, 1).otherwise(0)).over(_day()) == 1


def replace_closing_record(data: DataFrame, raw: DataFrame) -> DataFrame:
    """Where 15:00:00 holds no trade, take the traded raw rows of that time instead."""
    at_close = F.col("time") == K.SESSION_END
    traded = at_close & (F.col("volume") > 0)
    both = _beside(data, raw.where(traded)).withColumn("_closed", F.col("_known") & _any(traded & ~F.col("_extra")))
    stays = F.when(F.col("_extra"), F.col("_known") & ~F.col("_closed")).otherwise(~at_close | (at_close & F.col("_closed")))
    return _like(both.where(stays), data)


def carry_transaction_number(data: DataFrame) -> DataFrame:
    """Zero transaction numbers after the first one repeat the last number."""
    number = F.when(F.col("transaction_number") != 0, F.col("transaction_number"))
    last = F.last(number, ignorenulls=True).over(_ordered().rowsBetween(Window.unboundedPreceding, 0))
    return data.withColumn("transaction_number", F.coalesce(last, F.col("transaction_number")))


def _with_traded_volume(raw: DataFrame) -> DataFrame:
    """On days without any volume, volume and amount are the steps of the cumulative columns."""
    silent = F.max("volume").over(_day()) == 0
    step = lambda total, column: F.coalesce(
        F.greatest(F.col(total) - F.lag(total).over(_ordered()), F.lit(0)), F.lit(0)).cast(raw.schema[column].dataType)
    marked = raw.withColumns({"_silent": silent, "_volume": step("daily_accumulated_volume", "volume"),
                              "_amount": step("daily_amount", "amount")})
    return marked.withColumns({column: F.when(F.col("_silent"), F.col(f"_{column}")).otherwise(F.col(column))
                               for column in ("volume", "amount")}).drop("_silent", "_volume", "_amount")


def restore_close_records(data: DataFrame, raw: DataFrame, step: int = K.STOCK_TICK_SECONDS) -> DataFrame:
    """Add a missing 15:00:00 record, or else a missing 11:30:00 record with the rows leading to it.

    The close is the raw row of that time, or a later last trade moved to it. The noon record repeats
    the last raw morning row every ``step`` seconds. Raw days without volume take it from the cumulative columns.
    """
    raw = _with_traded_volume(raw)
    last_trade = F.max(F.when(F.col("volume") > 0, F.col("time"))).over(_day())
    morning = F.col("time") <= K.NOON_END
    rank = F.row_number().over(Window.partitionBy(*KEYS, morning).orderBy(F.desc("time"), F.desc("tick_order")))
    close_time = F.when(F.col("_last_trade") <= K.SESSION_END, F.lit(K.SESSION_END)).otherwise(F.col("_last_trade"))
    # the few raw rows of a day that either record can come from
    source = raw.withColumns({"_last_trade": last_trade, "_rank": rank}).withColumns({
        "_closes": F.coalesce(F.col("time") == close_time, F.lit(False)),
        "_before_noon": F.coalesce(morning, F.lit(False)) & (F.col("_rank") == 1)})
    source = source.where(F.col("_closes") | F.col("_before_noon"))
    marks = {"_closes": F.lit(False), "_before_noon": F.lit(False)}
    columns = [*data.columns, *marks]
    both = _beside(data.withColumns(marks), source.select(*columns))
    of_layer = ~F.col("_extra")
    both = both.withColumns({"_has_close": _any(of_layer & (F.col("time") == K.SESSION_END)),
                             "_has_noon": _any(of_layer & (F.col("time") == K.NOON_END))})
    closes = F.col("_closes") & ~F.col("_has_close")
    leads = F.col("_before_noon") & F.col("_has_close") & ~F.col("_has_noon")
    second = whole_seconds("time")
    gap = whole_seconds(F.lit(K.NOON_END)) - second
    # less than a step before noon the row itself is repeated
    steps = F.when(gap >= step, F.sequence(F.lit(1), F.floor(gap / step).cast("int"))).when(
        gap >= 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    added = both.where(of_layer | (F.col("_known") & (closes | leads))).withColumn(
        "_step", F.explode(F.when(of_layer | closes, F.array(F.lit(0))).otherwise(steps)))
    time = F.when(of_layer, F.col("time")).when(closes, F.lit(K.SESSION_END)) \
        .otherwise(time_string(second + F.col("_step") * step))
    return _like(added.withColumn("time", time), data)


def volume_from_totals(data: DataFrame) -> DataFrame:
    """On days with more than 99.9 % zero volume, take volume and amount from the cumulative columns."""
    zero_share = F.avg(F.when(F.col("volume") == 0, 1.0).otherwise(0.0)).over(_day())
    change = lambda column: F.col(column) - F.lag(column).over(_ordered())
    repaired = data.withColumns({"_empty": zero_share > 0.999, "_volume": change("daily_accumulated_volume"),
                                 "_amount": change("daily_amount")})
    return repaired.withColumns({
        "volume": F.when(F.col("_empty") & (F.col("volume") == 0), F.col("_volume")).otherwise(F.col("volume")),
        "amount": F.when(F.col("_empty") & (F.col("amount") == 0), F.col("_amount")).otherwise(F.col("amount")),
    }).drop("_empty", "_volume", "_amount")


def clear_untraded_volume(data: DataFrame) -> DataFrame:
    """Volume and amount are 0 where the cumulative volume did not move."""
    change = F.col("daily_accumulated_volume") - F.lag("daily_accumulated_volume").over(_ordered())
    marked = data.withColumn("_idle", F.coalesce((change == 0) & (F.col("volume") > 0), F.lit(False)))
    clear = lambda column: F.when(F.col("_idle"), F.lit(0)).otherwise(F.col(column)).cast(data.schema[column].dataType)
    return marked.withColumns({"volume": clear("volume"), "amount": clear("amount")}).drop("_idle")


def drop_repeat_records(data: DataFrame) -> DataFrame:
    """Of the rows at a repeated session time keep those that are the first with their cumulative volume."""
    repeated = in_session() & (F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "time")) > 1)
    first = F.row_number().over(
        Window.partitionBy(*KEYS, "daily_accumulated_volume").orderBy("time", "tick_order")) == 1
    return data.withColumn("_keep", ~repeated | first).where(F.col("_keep")).drop("_keep")


def set_status(config: DataFrame, keys: DataFrame, status: int) -> DataFrame:
    """Set the status of the listed (date, stock) pairs."""
    marked = keys.select("date", "tscode").distinct().withColumn("_marked", F.lit(True))
    return config.join(marked, ["date", "tscode"], "left").withColumn(
        "status", F.when(F.col("_marked"), F.lit(status)).otherwise(F.col("status"))).select(*config.columns)


def patch_book_levels(data: DataFrame, patch: DataFrame) -> DataFrame:
    """Replace zero levels between 09:30 and 14:57 from a patch feed, except at the price limit.

    ``patch`` has tscode, date, time and the level columns.
    """
    # a column per level: levels that are not asked for are neither worked out nor shuffled
    levels = patch.select(*KEYS, "time", *[F.col(c).alias(f"_patch_{c}") for c in BOOK_COLUMNS])
    change = F.try_divide(F.col("price") - F.col("close"), F.col("close"))
    limit = price_limit_rate("tscode", swap_date_format(F.col("date").cast("string")))
    open_book = (F.col("time") >= K.SESSION_START) & (F.col("time") < K.CLOSING_AUCTION_START) \
        & ~F.coalesce(nearly_equal(F.abs(change), limit), F.lit(False))
    joined = data.join(levels, [*KEYS, "time"], "left").withColumn("_open_book", open_book)
    fixed = {c: F.when(F.col("_open_book") & (F.col(c) == 0), F.coalesce(F.col(f"_patch_{c}"), F.col(c)))
             .otherwise(F.col(c)) for c in BOOK_COLUMNS}
    return joined.withColumns(fixed).select(*data.columns)


def restore_book_levels(data: DataFrame, raw: DataFrame) -> DataFrame:
    """Undo a patch: where a raw row has a zero level, take all levels from it."""
    zero = reduce(or_, [F.col(c) == 0 for c in BOOK_COLUMNS])
    # a value per level keeps the aggregate in a hash table and free of levels that are not asked for
    marked = raw.withColumn("_order", F.when(zero, F.col("tick_order")))
    source = marked.groupBy(*KEYS, "time").agg(F.max("_order").alias("_raw_order"), *[
        F.max_by(c, "_order").alias(f"_raw_{c}") for c in BOOK_COLUMNS])
    joined = data.join(source, [*KEYS, "time"], "left")
    return joined.withColumns({c: F.when(F.col("_raw_order").isNotNull(), F.col(f"_raw_{c}")).otherwise(F.col(c))
                               for c in BOOK_COLUMNS}).select(*data.columns)


def rebuild_closing_record(data: DataFrame, raw: DataFrame, step: int = K.STOCK_TICK_SECONDS) -> DataFrame:
    """Make the last traded raw row the 15:00:00 record, drop later rows, and fill up to it if it was missing."""
    traded = raw.where(F.col("volume") > 0).withColumn("_rank", F.row_number().over(
        Window.partitionBy(*KEYS).orderBy(F.desc("time"), F.desc("tick_order")))).where(F.col("_rank") == 1)
    closing = traded.withColumn("time", F.lit(K.SESSION_END))
    both = _beside(data, closing).withColumn("_found", F.col("_known") & _any(F.col("_extra")))
    has_close = _any(~F.col("_extra") & (F.col("time") == K.SESSION_END))
    rank = F.row_number().over(Window.partitionBy(*KEYS, "_extra", F.col("time") < K.SESSION_END).orderBy(
        F.desc("time"), "tick_order"))
    rest = ~F.col("_extra") & F.col("_found")
    # of a found day its rows before the close, and the closing row; other days as they are
    both = both.withColumns({"_has_close": has_close, "_rank": rank}).where(
        F.when(F.col("_extra"), F.col("_found")).otherwise(~F.col("_found") | (F.col("time") < K.SESSION_END)))
    gap = whole_seconds(F.lit(K.SESSION_END)) - whole_seconds("time")
    copies = F.when(rest & ~F.col("_has_close") & (F.col("_rank") == 1), F.floor((gap - 1) / step)).otherwise(0)
    filled = both.withColumn("_copies", copies.cast("int")).withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.col("_copies"))))
    second = whole_seconds("time")
    copied = F.col("_copy") > 0
    jump = F.when(F.col("time") == K.NOON_END, K.NOON_BREAK_SECONDS).otherwise(0)
    filled = filled.withColumn("time", F.when(copied, time_string(second + F.col("_copy") * step + jump))
                               .otherwise(F.col("time")))
    for column in ("volume", "amount", "transaction_number"):
        filled = filled.withColumn(
            column, F.when(copied, F.lit(0)).otherwise(F.col(column)).cast(data.schema[column].dataType))
    return _like(filled, data)


def gaps_of(ticks: DataFrame, low: float, high: float) -> DataFrame:
    """(instrument, date, gap_start, gap_end) of gaps between the two bounds, in seconds."""
    minutes = ticks.select("instrument", "date", "datetime", F.date_trunc("minute", F.col("datetime")).alias("_minute"))
    spans = previous_value(minutes, ["instrument", "date"], ["datetime"], "_minute", "datetime", "gap_start").select(
        "instrument", "date", "gap_start", F.col("datetime").alias("gap_end"))
    seconds = F.timestamp_diff("MICROSECOND", F.col("gap_start"), F.col("gap_end")) / 1e6
    return spans.where((seconds > low) & (seconds < high))


def insert_patch_rows(ticks: DataFrame, patch: DataFrame, low: float = 300,
                      high: float = K.NOON_BREAK_SECONDS) -> DataFrame:
    """Add the patch rows that lie strictly inside a gap of the same contract and date."""
    gaps = gaps_of(ticks, low, high).withColumnsRenamed({"instrument": "_i", "date": "_d"})
    inside = (F.col("instrument") == F.col("_i")) & (F.col("date") == F.col("_d")) \
        & (F.col("datetime") > F.col("gap_start")) & (F.col("datetime") < F.col("gap_end"))
    # gaps of a day do not overlap, so a patch row meets one gap at most
    return ticks.unionByName(_like(patch.join(gaps, inside), ticks))


def repair_failed(data: DataFrame, failed: DataFrame, fix: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a repair to the failed (stock, date) pairs only."""
    keys = failed.select(*KEYS).distinct()
    return data.join(keys, KEYS, "left_anti").unionByName(_like(fix(data.join(keys, KEYS, "left_semi")), data))


def update_by_key(table: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Take new values of some columns where the keys match."""
    renamed = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in columns])
    return table.join(renamed, keys, "left").withColumns(
        {c: F.coalesce(F.col(f"_u_{c}"), F.col(c)) for c in columns}).select(*table.columns)


def reset_small_issues(config: DataFrame, results: DataFrame, bound: int = 10) -> DataFrame:
    """Status 0 again for failed pairs with at most ``bound`` issues."""
    small = results.where((F.col("result") == K.RESULT_FAILED) & (F.col("issue_count") <= bound))
    return set_status(config, small, K.STATUS_OK)
