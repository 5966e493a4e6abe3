"""Window columns with the warm-up rules the market operators use."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def full_window(aggregate: Column, value: Column, window: WindowSpec, rows: int) -> Column:
    """Aggregate over the last ``rows`` rows, null until all of them hold a value."""
    frame = window.rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(frame) == rows, aggregate.over(frame))


def difference_from(value: str, window: WindowSpec, rows: int) -> Column:
    """x − lag(x, rows); in the warm-up x − first x of the partition."""
    return F.col(value) - F.coalesce(F.lag(value, rows).over(window), F.first(value).over(window))


def partial_mean(value: str, window: WindowSpec, rows: int) -> Column:
    """Rolling mean; in the warm-up the mean of all rows so far."""
    return F.avg(value).over(window.rowsBetween(1 - rows, 0))


def partial_std(value: str, window: WindowSpec, rows: int, first: Column | None = None) -> Column:
    """Rolling sample deviation; in the warm-up the population deviation of all rows so far.

    ``first`` replaces the value of the first row (0 by default).
    """
    frame = window.rowsBetween(1 - rows, 0)
    count = F.count(value).over(frame)
    # the warm-up covers the first rows-1 rows; a single row has no sample deviation
    warm_up = F.when(F.row_number().over(window) == 1, F.lit(0.0) if first is None else first) \
        .otherwise(F.stddev_pop(value).over(frame))
    return F.when((count == rows) & F.lit(rows > 1), F.stddev_samp(value).over(frame)).otherwise(warm_up)


def min_max_scaled(value: str, window: WindowSpec, rows: int) -> Column:
    """(x − min) / (max − min) over the last rows, 0 where they are equal, null in the warm-up."""
    low = full_window(F.min(value), F.col(value), window, rows)
    high = full_window(F.max(value), F.col(value), window, rows)
    return F.when(high == low, F.lit(0.0)).otherwise((F.col(value) - low) / (high - low))


def running(aggregate: Column, window: WindowSpec) -> Column:
    return aggregate.over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def corrected_skewness(value: str, frame: WindowSpec) -> Column:
    """Bias-corrected sample skewness."""
    n = F.count(value).over(frame)
    return F.when(n > 2, F.skewness(value).over(frame) * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(value: str, frame: WindowSpec) -> Column:
    """Bias-corrected sample excess kurtosis."""
    n = F.count(value).over(frame)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value).over(frame) + 6))
