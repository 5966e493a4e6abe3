"""Factor reports: distribution, stability, information coefficient, quality, extremes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklane import constants as K
from ticklane.functions.quantiles import exact_quantiles

SHARES = (0.01, 0.05, 0.1, 0.5, 0.9, 0.95, 0.99)


def share_name(share: float) -> str:
    return f"p{round(share * 100):02d}"


def distribution(data: DataFrame, value: str, keys: list[str], shares=SHARES) -> DataFrame:
    """Count, mean, deviation, extremes and exact quantiles per key."""
    plain = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    quantiles = exact_quantiles(data, value, list(shares), keys)
    return plain.join(quantiles, keys, "left").select(
        *keys, "count", "mean", "std", "min", "max",
        *[F.col("quantiles")[i].alias(share_name(s)) for i, s in enumerate(shares)])


def histogram(data: DataFrame, value: str, bins: int = 1000) -> DataFrame:
    """Equal-width bins over the value range; the last bin includes the maximum."""
    # one row
    ends = data.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    bin_ = F.least(F.floor(F.try_divide(F.col(value) - F.col("_low"), width)), F.lit(bins - 1))
    return data.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(
        F.coalesce(bin_, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def daily_stability(data: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean and deviation per date."""
    return data.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def quality_counts(data: DataFrame, values: list[str], instrument: str = "instrument", date: str = "date",
                   time: str = "time") -> DataFrame:
    """Null and zero values and rows per session half, per contract and date, with contract and grand totals."""
    total = lambda parts: sum(parts[1:], parts[0])
    null = total([F.when(F.col(v).isNull(), 1).otherwise(0) for v in values])
    zero = total([F.when(F.col(v) == 0, 1).otherwise(0) for v in values])
    half = lambda low, high: F.sum(F.when(F.col(time).between(low, high), 1).otherwise(0))
    return data.rollup(instrument, date).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(null).alias("null_count"), F.sum(zero).alias("zero_count"),
        half(K.SESSION_START, K.NOON_END).alias("morning_count"),
        half(K.NOON_START, K.SESSION_END).alias("afternoon_count"))


def period_means(data: DataFrame, value: str, keys: list[str], length: int, date: str = "date") -> DataFrame:
    """Mean per period, a prefix of the date text: 4 for years, 7 for months."""
    return data.groupBy(*keys, F.col(date).cast("string").substr(1, length).alias("period")).agg(
        F.avg(value).alias("mean"))


def describe_by_period(data: DataFrame, value: str, keys: list[str], periods: list[str] | None = None, length: int = 7,
                       shares=(0.25, 0.5, 0.75), date: str = "date") -> DataFrame:
    """One row per key and period; with a list of periods one group of columns for each of these instead."""
    tagged = data.withColumn("period", F.col(date).cast("string").substr(1, length))
    described = distribution(tagged, value, [*keys, "period"], shares)
    if periods is None:
        return described
    return described.groupBy(*keys).pivot("period", periods).agg(
        *[F.first(c).alias(c) for c in ("count", "mean", "std")], *[F.first(share_name(s)).alias(share_name(s)) for s in shares])


def daily_information_coefficient(data: DataFrame, factor: str, ret: str, keys: list[str]) -> DataFrame:
    """Pearson and rank correlation of a factor with the forward return, per key (contract and date).

    Equal values share the mean of their places.
    """
    present = data.where(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    ranked = present
    for name, value in (("_factor_rank", factor), ("_ret_rank", ret)):
        first = F.rank().over(Window.partitionBy(*keys).orderBy(value))
        same = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
        ranked = ranked.withColumn(name, first + (same - 1) / 2)
    return ranked.groupBy(*keys).agg(F.corr(factor, ret).alias("ic"), F.corr("_factor_rank", "_ret_rank").alias("rank_ic"))


def information_ratio(daily: DataFrame, keys: list[str], value: str = "ic") -> DataFrame:
    """Mean, deviation and ratio of a daily coefficient."""
    return daily.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).withColumn(
        "ratio", F.try_divide(F.col("mean"), F.col("std")))


def moments(data: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Population excess kurtosis and skewness, mean and deviation."""
    return data.groupBy(*keys).agg(F.kurtosis(value).alias("kurtosis"), F.skewness(value).alias("skewness"),
                                   F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def correlation(data: DataFrame, left: str, right: str, keys: list[str] | None = None) -> DataFrame:
    return data.groupBy(*(keys or [])).agg(F.corr(left, right).alias("correlation"))


def extreme_days(daily: DataFrame, keys: list[str], k: int, columns=("mean", "std")) -> DataFrame:
    """Dates among the k largest or smallest daily values; ties of the k-th value are kept."""
    sides = F.array(*[F.struct(F.lit(column).alias("measure"), F.lit(side).alias("side"), F.col(column).alias("value"),
                               (F.col(column) * sign).alias("_order"))
                      for column in columns for side, sign in (("largest", -1), ("smallest", 1))])
    rows = daily.select(*keys, "date", F.explode(sides).alias("_one")).select(*keys, "date", "_one.*").where(F.col("value").isNotNull())
    place = F.rank().over(Window.partitionBy(*keys, "measure", "side").orderBy("_order"))
    return rows.withColumn("place", place).where(F.col("place") <= k).select(*keys, "date", "measure", "side", "place", "value")


def factor_reports(table: DataFrame, values: list[str],
                   reports: dict[str, Callable[[DataFrame, str], DataFrame]]) -> dict[tuple[str, str], DataFrame]:
    """Every report for every factor column, by (report, column)."""
    return {(name, value): report(table, value) for name, report in reports.items() for value in values}


def training_summary(data: DataFrame, date: str = "date", share: float = 0.75) -> DataFrame:
    """Rows, first and last date, number of dates and the date at ``share`` of them."""
    dates = data.groupBy(date).agg(F.count(F.lit(1)).alias("_rows"))
    # a date list holds a few thousand entries
    ordered = dates.agg(F.sum("_rows").alias("rows"), F.sort_array(F.collect_list(date)).alias("_dates"))
    return ordered.select("rows", F.size("_dates").alias("dates"), F.get("_dates", F.lit(0)).alias("first_date"),
                          F.element_at("_dates", -1).alias("last_date"),
                          F.get("_dates", F.bround(F.size("_dates") * share).cast("int")).alias("split_date"))
