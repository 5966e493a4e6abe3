"""Joins of points with the intervals that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN_DAYS = 31


def join_intervals(intervals: DataFrame, points: DataFrame, start: str, end: str, point: str, keys: list[str] | None = None,
                   bin_days: int = BIN_DAYS) -> DataFrame:
    """Every interval with every point inside it, ends included; dates. ``keys`` must be equal in addition.

    An interval is dealt out to the bins of days that it touches, within the days that there are points on, and meets
    points of the same bin in an equi join; a point has one bin, so no pair comes twice. Intervals with a null end and
    null points match nothing.
    """
    keys = keys or []
    number = lambda date: F.floor(F.unix_date(date) / bin_days)
    # one row
    span = points.agg(F.min(point).alias("_first"), F.max(point).alias("_last"))
    first, last = F.greatest(F.col(start), F.col("_first")), F.least(F.col(end), F.col("_last"))
    whole = F.col(start).isNotNull() & F.col(end).isNotNull() & (first <= last)
    binned = intervals.crossJoin(F.broadcast(span)).where(whole).withColumn(
        "_bin", F.explode(F.sequence(number(first), number(last)))).drop("_first", "_last")
    names = {key: f"_{key}_of_point" for key in keys}
    right = points.withColumnsRenamed(names).withColumn("_point_bin", number(F.col(point)))
    same = (F.col("_bin") == F.col("_point_bin")) & F.col(point).between(F.col(start), F.col(end))
    for key, name in names.items():
        same = same & (F.col(key) == F.col(name))
    return binned.join(right, same).drop("_bin", "_point_bin", *names.values())
