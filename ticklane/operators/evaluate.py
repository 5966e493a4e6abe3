"""Factor and prediction tests: quantile-band backtests, signal backtests, scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane.functions.quantiles import exact_quantiles
from ticklane.functions.series import CHUNK_ROWS, SeriesColumns, running_totals
from ticklane.session import cut_lineage, stored



def _count_when(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def _amount_when(condition: Column, value: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0.0))


def quantile_band_trades(data: DataFrame, factor: str, ret: str, keys: list[str], group_number: int = 10,
                         position: str = "pos", action_delay: int = 1, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per traded bar with its band, action (1 or -1) and profit.

    Band i lies between the (i-1)-th and i-th of the points at 50 %, .., 100 %; the same distance
    below the median is the short side. A trade uses open and return ``action_delay`` bars later.
    """
    points = [0.5 + i * 0.5 / group_number for i in range(group_number + 1)]
    # the factor table is derived once, for the quantiles and for the trades
    data = stored(data)
    splits = exact_quantiles(data, factor, points, keys, output="_splits", reread=True)
    columns = SeriesColumns()
    later_open, later_ret = columns.lead("open", action_delay), columns.lead(ret, action_delay)
    rows = columns.apply(data, keys, position, chunk_rows).join(splits, keys)
    value, split = F.col(factor), lambda i: F.get(F.col("_splits"), i)
    mirrored = lambda i: split(0) - (split(i) - split(0))
    bands = F.sequence(F.lit(1), F.lit(group_number))
    inside_long = F.filter(bands, lambda i: (value > split(i - 1)) & (value < split(i)))
    inside_short = F.filter(bands, lambda i: (value < mirrored(i - 1)) & (value > mirrored(i)))
    traded = rows.withColumn("_long", F.get(inside_long, F.lit(0))).withColumn("_short", F.get(inside_short, F.lit(0)))
    traded = traded.withColumn("band", F.coalesce("_long", "_short")).where(F.col("band").isNotNull())
    action = F.when(F.col("_long").isNotNull(), 1).otherwise(-1)
    profit = F.coalesce(F.col(later_open), F.col("open")) * F.coalesce(F.col(later_ret), F.col(ret)) * action
    return traded.withColumn("action", action).withColumn("profit", profit).select(
        *data.columns, "band", "action", "profit")


def quantile_band_report(trades: DataFrame, keys: list[str], bands: DataFrame | None = None) -> DataFrame:
    """Counts and win and loss sums per band; ``bands`` adds rows for bands without trades."""
    profit, long = F.col("profit"), F.col("action") == 1
    win, lose = profit > 0, profit < 0
    report = trades.groupBy(*keys, "band").agg(
        F.count(F.lit(1)).alias("trade_count"),
        _count_when(long).alias("long_trade_count"), _count_when(~long).alias("short_trade_count"),
        _count_when(win).alias("win_trade_count"), _count_when(lose).alias("lose_trade_count"),
        _amount_when(win, "profit").alias("win_trade_amount"),
        F.abs(_amount_when(lose, "profit")).alias("lose_trade_amount"),
        _amount_when(win & long, "profit").alias("long_win_trade_amount"),
        F.abs(_amount_when(lose & long, "profit")).alias("long_lose_trade_amount"),
        _amount_when(win & ~long, "profit").alias("short_win_trade_amount"),
        F.abs(_amount_when(lose & ~long, "profit")).alias("short_lose_trade_amount"))
    if bands is not None:
        report = bands.join(report, [*keys, "band"], "left").na.fill(0)
    return report


def daily_profit(trades: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Profit per date and its running total."""
    daily = trades.groupBy(*keys, date).agg(F.sum("profit").alias("profit"))
    # one row per date
    so_far = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("total_profit", F.sum("profit").over(so_far))


def threshold_band_report(data: DataFrame, factor: str, keys: list[str], ret_length: int, points: int = 21,
                          position: str = "pos", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Bands between quantiles of the absolute factor value, pooled over all series.

    The factor of the bar before decides the side; bounds belong to both neighbouring bands.
    """
    shares = [i / (points - 1) for i in range(points)]
    data = stored(data)
    levels = exact_quantiles(data.withColumn("_abs", F.abs(F.col(factor))), "_abs", shares, output="_levels", reread=True)
    columns = SeriesColumns()
    before, exit_open = columns.lag(factor, 1), columns.lead("open", ret_length)
    rows = columns.apply(data, keys, position, chunk_rows).where(F.col(before).isNotNull())
    # a single row of fixed width
    rows = rows.crossJoin(levels)
    level = lambda i: F.get(F.col("_levels"), i)
    size = F.abs(F.col(before))
    inside = F.filter(F.sequence(F.lit(1), F.lit(points - 1)), lambda i: (size >= level(i - 1)) & (size <= level(i)))
    flagged = rows.withColumn("band", F.explode(inside))
    # zero lies in both sides of the lowest band; the short side is set last
    flag = F.when((F.col(before) > 0) | ((F.col(before) == 0) & (level(F.col("band") - 1) > 0)), 1).otherwise(-1)
    flagged = flagged.withColumn("flag", flag).withColumn(
        "yields", F.try_divide(F.col(exit_open) - F.col("open"), F.col("open")) * F.col("flag"))
    win, lose, long = F.col("yields") > 0, F.col("yields") < 0, F.col("flag") == 1
    bounds = flagged.groupBy("band").agg(
        F.max(level(F.col("band") - 1)).alias("small_threshold"), F.max(level(F.col("band"))).alias("big_threshold"),
        F.count(F.lit(1)).alias("trade_count"), _count_when(long).alias("long_trade_count"),
        _count_when(~long).alias("short_trade_count"), _count_when(win).alias("_wins"),
        F.sum("yields").alias("_total"),
        *[_amount_when(c, "yields").alias(n) for n, c in {
            "_win": win, "_lose": lose, "_long_win": win & long, "_long_lose": lose & long,
            "_short_win": win & ~long, "_short_lose": lose & ~long}.items()])
    rate = lambda a, b: F.try_divide(F.col(a), -F.col(b))
    return bounds.select(
        "band", "small_threshold", "big_threshold", "trade_count", "long_trade_count", "short_trade_count",
        F.try_divide(F.col("_wins"), F.col("trade_count")).alias("win_rate"),
        rate("_win", "_lose").alias("profit_rate"), rate("_long_win", "_long_lose").alias("long_profit_rate"),
        rate("_short_win", "_short_lose").alias("short_profit_rate"),
        F.try_divide(F.col("_total"), F.col("trade_count")).alias("average_profit"))


def prediction_flags(data: DataFrame, predict: str, ret: str, keys: list[str], length: int = 4800, width: float = 2.0,
                     position: str = "pos", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """flag ±1 where a prediction is beyond ``width`` times the rolling mean of its absolute value."""
    columns = SeriesColumns()
    size = columns.value("_size", F.abs(F.col(predict)), [predict])
    usual = columns.rolling("avg", size, length)
    rows = columns.apply(data, keys, position, chunk_rows)
    flag = F.when(F.col(predict) > F.col(usual) * width, 1).when(F.col(predict) < -F.col(usual) * width, -1).otherwise(0)
    return rows.withColumn("flag", flag).withColumn("trade_ret", F.col(ret) * F.col("flag")) \
        .select(*data.columns, "flag", "trade_ret")


def signal_flags(data: DataFrame, signal: str, amount: str, keys: list[str], ret_length: int, length: int = 500,
                 width: float = 1.5, least_amount: float = 50.0, least_trades: int = 50, position: str = "pos",
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Trade the signal of the bar before when it beats ``width`` times the mean absolute signal.

    Bars below ``least_amount`` are not traded, and series with fewer than ``least_trades`` trades drop out.
    """
    columns = SeriesColumns()
    before, exit_open = columns.lag(signal, 1), columns.lead("open", ret_length)
    size = columns.value("_size", F.abs(F.col(signal)), [signal])
    usual = columns.rolling("avg", size, length)
    rows = columns.apply(data, keys, position, chunk_rows)
    level = F.col(usual) * width
    flag = F.when(F.col(before) > level, 1).when(F.col(before) < -level, -1).otherwise(0)
    flag = F.when(F.col(amount) < least_amount, 0).otherwise(flag)
    traded = rows.withColumn("flag", flag).withColumn(
        "trade_ret", F.try_divide(F.col(exit_open) - F.col("open"), F.col("open")) * F.col("flag"))
    # stored once: the number of trades and the rows are two passes
    traded = cut_lineage(traded)
    active = traded.groupBy(*keys).agg(F.sum(F.abs("flag")).alias("_trades")).where(F.col("_trades") >= least_trades)
    return traded.join(active, keys, "left_semi").select(*data.columns, "flag", "trade_ret")


def backtest_report(trades: DataFrame, product: str = "product", total: str = "all") -> DataFrame:
    """Report per product and one row over all of them, best win-lose rate first after the total."""
    ret, long, short = F.col("trade_ret"), F.col("flag") == 1, F.col("flag") == -1
    sums = trades.groupBy(product).agg(
        F.coalesce(F.sum(ret), F.lit(0.0)).alias("profit"), _count_when(long | short).alias("count"),
        _amount_when(long, "trade_ret").alias("long_profit"), _count_when(long).alias("long_count"),
        _amount_when(short, "trade_ret").alias("short_profit"), _count_when(short).alias("short_count"),
        _count_when(ret > 0).alias("_wins"), _count_when(ret < 0).alias("_losses"),
        *[_amount_when(c & side, "trade_ret").alias(n) for n, c, side in (
            ("_long_win", ret > 0, long), ("_long_lose", ret < 0, long),
            ("_short_win", ret > 0, short), ("_short_lose", ret < 0, short))])
    names = [c for c in sums.columns if c != product]
    both = sums.rollup(product).agg(*[F.sum(c).alias(c) for c in names], F.grouping_id().alias("_total"))
    rate = lambda a, b: F.try_divide(a, b)
    col = F.col
    report = both.select(
        F.when(col("_total") == 1, F.lit(total)).otherwise(col(product)).alias(product), "_total",
        "profit", "long_profit", "short_profit",
        rate(col("_long_win") + col("_short_win"), -(col("_long_lose") + col("_short_lose"))).alias("win_lose_rate"),
        rate(col("_long_win"), -col("_long_lose")).alias("long_win_lose_rate"),
        rate(col("_short_win"), -col("_short_lose")).alias("short_win_lose_rate"),
        "count", "long_count", "short_count",
        rate(col("profit"), col("count")).alias("avg_profit"),
        rate(col("long_profit"), col("long_count")).alias("long_avg_profit"),
        rate(col("short_profit"), col("short_count")).alias("short_avg_profit"),
        F.coalesce(rate(col("_wins"), col("_wins") + col("_losses")), F.lit(0.0)).alias("win_rate"))
    return report.orderBy(col("_total").desc(), col("win_lose_rate").desc()).drop("_total")


def profit_curve(trades: DataFrame, moment: str = "datetime", bucket: str = "date") -> DataFrame:
    """Profit of all products per time and the running totals: all, long and short."""
    long, short = F.col("flag") == 1, F.col("flag") == -1
    points = trades.groupBy(bucket, moment).agg(
        F.coalesce(F.sum("trade_ret"), F.lit(0.0)).alias("profit"),
        _amount_when(long, "trade_ret").alias("long_profit"), _amount_when(short, "trade_ret").alias("short_profit"))
    names = ("profit", "long_profit", "short_profit")
    return running_totals(points.withColumn("_all", F.lit(1)), ["_all"], [moment], bucket,
                          {f"total_{name}": name for name in names}).drop("_all")


def merge_profits(trades: DataFrame, products: list[str], keys: list[str]) -> DataFrame:
    """One column per product, 0 where a product has no row at a time; products not listed add up in ``other``."""
    of = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("trade_ret"))), F.lit(0.0))
    listed = F.coalesce(F.col("product").isin(products), F.lit(False))
    return trades.groupBy(*keys).agg(*[of(F.col("product") == product).alias(product) for product in products], of(~listed).alias("other"))


def evaluate(data: DataFrame, predict: str, real: str, scores: dict[str, Callable[[Column, Column], Column]],
             keys: list[str] | None = None) -> DataFrame:
    """The given aggregates of prediction and real value, per key."""
    return data.groupBy(*(keys or [])).agg(*[score(F.col(predict), F.col(real)).alias(name) for name, score in scores.items()])


def prediction_scores(data: DataFrame, predict: str, real: str, keys: list[str] | None = None) -> DataFrame:
    """Correlation, winning rate (same sign among non-zero products) and mean squared error."""
    product = F.col(predict) * F.col(real)
    return data.groupBy(*(keys or [])).agg(
        F.corr(predict, real).alias("correlation"),
        F.avg(F.when(product > 0, 1.0).when(product < 0, 0.0)).alias("winning_rate"),
        F.avg((F.col(predict) - F.col(real)) * (F.col(predict) - F.col(real))).alias("mean_squared_error"))
