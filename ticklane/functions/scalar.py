"""Scalar column functions: time strings, stock codes, price limits, safe arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklane import constants as K
from ticklane.functions.quantiles import exact_quantiles
from ticklane.session import with_key_rows

ColumnOrName = Column | str


def _col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- time strings -------------------------------------------------------------------------

def seconds_of_day(time: ColumnOrName) -> Column:
    """Seconds since midnight of ``HH:MM:SS[.mmm]`` as a double."""
    time = _col(time)
    return (time.substr(1, 2).cast("int") * 3600 + time.substr(4, 2).cast("int") * 60).cast("double") \
        + time.substr(7, 12).cast("double")


def whole_seconds(time: ColumnOrName) -> Column:
    """Seconds since midnight without the fraction, as an int."""
    time = _col(time)
    return time.substr(1, 2).cast("int") * 3600 + time.substr(4, 2).cast("int") * 60 + time.substr(7, 2).cast("int")


def _two_digits(number: Column, count: int, tail: str) -> Column:
    """Text of a number below ``count``, looked up in a constant."""
    return F.get(F.split(F.lit(" ".join(f"{i:02d}{tail}" for i in range(count))), " "), number)


def time_string(seconds: ColumnOrName) -> Column:
    """``HH:MM:SS.000`` of whole seconds since midnight; the days before and after have the same times."""
    # long fillings write a time for each row: looking its parts up takes a fraction of printing a timestamp
    second = F.pmod(_col(seconds).cast("int"), F.lit(86_400))
    minute = F.floor(second / 60).cast("int")
    return F.concat(_two_digits(F.floor(second / 3600).cast("int"), 24, ":"), _two_digits(minute % 60, 60, ":"),
                    _two_digits(second % 60, 60, ".000"))


def time_difference(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Whole seconds from start to end; null where end lies before start."""
    gap = seconds_of_day(end) - seconds_of_day(start)
    return F.when(gap >= 0, F.floor(gap).cast("int"))


def advance_time(time: ColumnOrName, step: ColumnOrName | int) -> Column:
    """Step a time forward; a step that starts at 11:30:00 also jumps the noon break."""
    step = F.lit(step) if isinstance(step, int) else _col(step)
    seconds = whole_seconds(time)
    jump = F.when(_col(time).substr(1, 12).isin("11:30:00", K.NOON_END), K.NOON_BREAK_SECONDS).otherwise(0)
    return time_string(seconds + step + jump)


def advance_datetime(moment: ColumnOrName, step_seconds: ColumnOrName | float) -> Column:
    """Step a timestamp forward with the same noon rule."""
    moment = _col(moment)
    step = F.lit(float(step_seconds)) if isinstance(step_seconds, (int, float)) else _col(step_seconds)
    at_noon = (F.hour(moment) == 11) & (F.minute(moment) == 30) & (F.second(moment) == 0) \
        & (F.date_trunc("second", moment) == moment)
    total = step + F.when(at_noon, float(K.NOON_BREAK_SECONDS)).otherwise(0.0)
    return moment + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), total.cast("decimal(18,6)"))


def align_half_second(datetime_text: ColumnOrName) -> Column:
    """Cut the fraction to .0 or .5 and pad it to nine digits."""
    text = _col(datetime_text)
    half = F.when(F.split_part(text, F.lit("."), F.lit(2)).substr(1, 1).cast("int") > 4, "5").otherwise("0")
    return F.concat(F.split_part(text, F.lit("."), F.lit(1)), F.lit("."), half, F.lit("00000000"))


def carry_seconds(hour: ColumnOrName, minute: ColumnOrName, second: ColumnOrName) -> Column:
    """Struct (hour, minute, second) after carrying a second or minute of 60."""
    second = _col(second).cast("int")
    minute_raw = _col(minute).cast("int") + F.when(second == 60, 1).otherwise(0)
    hour_raw = _col(hour).cast("int") + F.when((second == 60) & (minute_raw == 60), 1).otherwise(0)
    return F.struct(
        hour_raw.alias("hour"),
        F.when((second == 60) & (minute_raw == 60), 0).otherwise(minute_raw).alias("minute"),
        F.when(second == 60, 0).otherwise(second).alias("second"),
    )


def swap_date_format(date: ColumnOrName) -> Column:
    """``yyyymmdd`` to ``yyyy-mm-dd`` and back."""
    date = _col(date)
    dashed = F.concat_ws("-", date.substr(1, 4), date.substr(5, 2), date.substr(7, 2))
    return F.when(F.length(date) == 8, dashed).otherwise(F.replace(date, F.lit("-"), F.lit("")))


def with_milliseconds(time: ColumnOrName) -> Column:
    time = _col(time)
    return F.when(F.length(time) == 8, F.concat(time, F.lit(".000"))).otherwise(time)


# --- codes and limits ---------------------------------------------------------------------

# Exchange markers per code format, first for Shanghai, then for Shenzhen.
EXCHANGE_MARKERS = {
    "prefix": ("sh", "sz"),
    "suffix": (".SH", ".SZ"),
    "file": ("SH#", "SZ#"),
    "vendor": (".XSHG", ".XSHE"),
}


def exchange_code(code: ColumnOrName, style: str = "prefix") -> Column:
    """Full exchange code of a stock; null for a prefix no exchange uses."""
    code = _col(code)
    shanghai, shenzhen = EXCHANGE_MARKERS[style]
    marker = F.when(code.startswith("6"), shanghai).when(code.startswith("0") | code.startswith("3"), shenzhen)
    if style == "prefix":
        return F.concat(marker, code)
    if style == "file":
        return F.concat(marker, code, F.lit(".txt"))
    return F.concat(code, marker)


def price_limit_rate(code: ColumnOrName, date: ColumnOrName, is_st: ColumnOrName | None = None) -> Column:
    """Daily limit of a stock by board, date (yyyymmdd) and special-treatment flag."""
    code, date = _col(code), _col(date)
    special = F.lit(False) if is_st is None else F.coalesce(_col(is_st).cast("boolean"), F.lit(False))
    growth_board = code.startswith("68") | code.startswith("300")
    return (
        F.when(growth_board & (date >= "20200824"), 0.2)
        .when(code.startswith("8"), 0.3)
        .when(special, 0.05)
        .otherwise(0.1)
    )


def nearly_equal(left: ColumnOrName, right: ColumnOrName, distance: float = K.LIMIT_TOLERANCE) -> Column:
    return F.abs(_col(left) - _col(right)) < distance


def product_of(contract: ColumnOrName) -> Column:
    return _col(contract).substr(1, 2)


def contract_from_path(path: ColumnOrName, prefix: str = "CFFEX") -> Column:
    """Contract in a file name such as ``.../CFFEX.IF2209.csv``."""
    return F.regexp_extract(_col(path), rf"{prefix}\.([A-Za-z]+[0-9]+)\.[A-Za-z]+$", 1)


def stock_from_path(path: ColumnOrName) -> Column:
    """Six-digit stock code in a file name such as ``.../600917.pkl``."""
    return F.regexp_extract(_col(path), r"([0-9]{6})\.[A-Za-z]+$", 1)


# --- arithmetic ---------------------------------------------------------------------------

def round_half_up(value: ColumnOrName, digits: int = 2) -> Column:
    return F.round(_col(value), digits)


def nearest_integer(value: ColumnOrName) -> Column:
    """A double rounded to a bigint, halves away from zero: what ``round`` and a cast give, without a decimal for each row."""
    value = _col(value)
    size = F.abs(value)
    below = F.floor(size)
    nearest = below + F.when(size - below >= 0.5, 1).otherwise(0)
    # a larger double is a whole number or none at all
    return F.when(size < float(1 << 52), F.when(value < 0, -nearest).otherwise(nearest)).otherwise(
        F.round(value).cast("bigint"))


def divide_or_zero(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """Ratio that is 0 where the denominator is 0 or a part is missing."""
    return F.coalesce(F.try_divide(_col(numerator), _col(denominator)), F.lit(0.0))


def positive_log(value: ColumnOrName) -> Column:
    value = _col(value)
    return F.when(value > 0, F.log(value))


def nan_to_null(value: ColumnOrName) -> Column:
    value = _col(value)
    return F.when(~F.isnan(value), value)


def weighted_levels(side: str, depth: int) -> Column:
    """Book amount with level weights depth, depth-1, .., 1."""
    return reduce(lambda a, b: a + b, [
        F.col(f"{side}_price{i}") * F.col(f"{side}_volume{i}") * (depth + 1 - i) for i in range(1, depth + 1)])


def level_amount(side: str, depth: int) -> Column:
    """Plain book amount of the first ``depth`` levels."""
    return reduce(lambda a, b: a + b, [
        F.col(f"{side}_price{i}") * F.col(f"{side}_volume{i}") for i in range(1, depth + 1)])


def parse_parameters(text: ColumnOrName) -> Column:
    """``"20|50|100"`` to an array of ints."""
    return F.transform(F.split(_col(text), r"\|"), lambda item: item.cast("int"))


def strip_whitespace(text: ColumnOrName) -> Column:
    return F.regexp_replace(_col(text), r"\s+", "")


# --- whole-column normalisation ------------------------------------------------------------

def clip_outliers(df: DataFrame, column: str, keys: list[str] | None = None, width: float = 5.0,
                  scale: float = 1.4826, output: str | None = None) -> DataFrame:
    """Clip to median ± width · scale · mean absolute deviation from the median."""
    keys = keys or []
    median = exact_quantiles(df, column, [0.5], keys).select(*keys, F.col("quantiles")[0].alias("_median"))
    centred = with_key_rows(df, median, keys)
    spread = centred.groupBy(*keys).agg(F.avg(F.abs(F.col(column) - F.col("_median"))).alias("_mad"),
                                        F.max("_median").alias("_median"))
    reach = F.col("_mad") * scale * width
    clipped = F.greatest(F.least(F.col(column), F.col("_median") + reach), F.col("_median") - reach)
    return with_key_rows(df, spread, keys).withColumn(
        output or column, F.when(F.col(column).isNotNull(), clipped)).drop("_median", "_mad")


def zero_small_values(df: DataFrame, column: str, keys: list[str] | None = None, width: float = 0.01,
                      scale: float = 1.4826, output: str | None = None) -> DataFrame:
    """Set values within width · scale · mean absolute deviation of zero to zero."""
    keys = keys or []
    mean = df.groupBy(*keys).agg(F.avg(column).alias("_mean"))
    spread = with_key_rows(df, mean, keys).groupBy(*keys).agg(
        F.avg(F.abs(F.col(column) - F.col("_mean"))).alias("_mad"))
    small = F.abs(F.col(column)) < F.col("_mad") * scale * width
    return with_key_rows(df, spread, keys).withColumn(
        output or column, F.when(small, F.lit(0.0)).otherwise(F.col(column))).drop("_mad")


def scale_by_extreme(df: DataFrame, column: str, keys: list[str] | None = None,
                     output: str | None = None) -> DataFrame:
    """Divide by twice the larger absolute extreme."""
    keys = keys or []
    extremes = df.groupBy(*keys).agg(
        F.greatest(F.abs(F.max(column)), F.abs(F.min(column))).alias("_extreme"))
    return with_key_rows(df, extremes, keys).withColumn(
        output or column, F.try_divide(F.col(column), F.col("_extreme") * 2)).drop("_extreme")
