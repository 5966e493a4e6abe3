"""Price-volume factors of a contract's bars.

A factor is a code, a version, default lengths and a function that records its column for one
length. Missing values become 0 at the end; a factor built on another one sees those zeros.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklane.functions.scalar import positive_log
from ticklane.functions.series import CHUNK_ROWS, SeriesColumns, running_total
from ticklane.operators import indicators as ind

LONG = (50, 100, 200, 500)
SHORT = (10, 20, 50, 100)


@dataclass(frozen=True)
class PriceVolumeFactor:
    code: str
    params: tuple[int, ...]
    record: Callable[[SeriesColumns, int], str]
    version: str = "1.0"
    action_delay: int = 1

    def key(self, param: int) -> str:
        return f"{self.code}__{param}"

    @property
    def full_name(self) -> str:
        return f"{self.code}_{self.version}"


FACTORS: dict[str, PriceVolumeFactor] = {}


def factor(code: str, params: tuple[int, ...]):
    def register(record: Callable[[SeriesColumns, int], str]):
        FACTORS[code] = PriceVolumeFactor(code, params, record)
        return record

    return register


def filled(c: SeriesColumns, code: str, n: int) -> str:
    """Column of a factor for one length with missing values as 0."""
    source = FACTORS[code].record(c, n)
    return c.value(FACTORS[code].key(n), F.coalesce(F.col(source), F.lit(0.0)), [source])


def _ratio(c: SeriesColumns, name: str, top: str, bottom: str) -> str:
    return c.value(name, F.try_divide(F.col(top), F.col(bottom)), [top, bottom])


def _change(c: SeriesColumns, source: str, rows: int) -> str:
    """x − x ``rows`` rows ago."""
    before = c.lag(source, rows)
    return c.value(f"{source}__change{rows}", F.col(source) - F.col(before), [source, before])


def _gap(c: SeriesColumns, left: str, right: str) -> str:
    return c.value(f"{left}__minus__{right}", F.col(left) - F.col(right), [left, right])


def _mean_price(c: SeriesColumns) -> str:
    return c.value("mean_price", (F.col("open") + F.col("close") + F.col("high") + F.col("low")) / 4)


def _log(c: SeriesColumns, source: str) -> str:
    return c.value(f"log__{source}", positive_log(source), [source])


def _log_change(c: SeriesColumns) -> str:
    last = c.lag("close", 1)
    return c.value("log_change", positive_log(F.try_divide(F.col("close"), F.col(last))), ["close", last])


def _change_of_close(c: SeriesColumns) -> str:
    last = c.lag("close", 1)
    return c.value("change", F.col("close") - F.col(last), ["close", last])


@factor("FCT_01_001_WILLIAM", (1000,))
def _william(c, n):
    high, low = c.rolling("max", "high", n), c.rolling("min", "low", n)
    middle = (F.col(high) + F.col(low)) / 2
    return c.value(f"william__{n}", F.try_divide(F.col("close") - middle, F.col(high) - F.col(low)), [high, low])


@factor("FCT_01_002_CLOSE_MINUS_MOVING_AVERAGE", (200, 500, 1000, 1500))
def _close_minus_average(c, n):
    mean, atr = ind.moving_average(c, n), ind.average_true_range(c, 2 * n)
    log = positive_log(F.try_divide(F.col("close"), F.col(mean)))
    return c.value(f"close_minus_average__{n}", F.try_divide(log, F.col(atr) * math.sqrt(n)), [mean, atr])


@factor("FCT_01_003_LINEAR_PER_ATR", SHORT)
def _linear_per_atr(c, n):
    slope = ind.linear_regression(c, n, _log(c, _mean_price(c)))
    return _ratio(c, f"linear_per_atr__{n}", slope, ind.average_true_range(c, n))


def linear_deviation(c: SeriesColumns, n: int, mode: str = "literal") -> str:
    """Last residual of a line over the standard error of the residuals.

    ``literal`` evaluates the line fitted on 1..n at n points from 0 to 1; ``intended`` on 1..n.
    """
    slope, intercept = (ind.linear_regression(c, n, "close", result=r) for r in ("slope", "intercept"))
    step = 1 / (n - 1) if mode == "literal" else 1.0
    start = 0.0 if mode == "literal" else 1.0

    def build(w) -> Column:
        frame = w.rowsBetween(1 - n, 0)
        y = F.col("close")
        # residual i is y_i − a − b·(start + step·i): expand the sum of squares around the window mean
        i_mean, i_square = (n - 1) / 2, n * (n * n - 1) / 12
        b = F.col(slope) * step
        level = F.avg(y).over(frame) - F.col(intercept) - F.col(slope) * start - b * i_mean
        squares = (F.var_pop(y).over(frame) * n - 2 * b * F.col(slope) * i_square + b * b * i_square
                   + n * level * level)
        estimate = F.col(intercept) + F.col(slope) * (start + step * (n - 1))
        error = F.sqrt(F.greatest(squares, F.lit(0.0)) / (n - 1)) / math.sqrt(n)
        return F.when(F.count(y).over(frame) == n, F.try_divide(y - estimate, error))

    # slope and intercept are those of the current row, so only the frame looks back
    return c.add(f"linear_deviation__{mode}__{n}", build, [slope, intercept], back=0)


@factor("FCT_01_004_LINEAR_DEVIATION", SHORT)
def _linear_deviation(c, n):
    return linear_deviation(c, n)


@factor("FCT_01_005_QUADRATIC_DEVIATION", SHORT)
def _quadratic_deviation(c, n):
    return ind.polynomial_regression(c, n, "close", 2, "deviation")


@factor("FCT_01_006_CUBIC_DEVIATION", SHORT)
def _cubic_deviation(c, n):
    return ind.polynomial_regression(c, n, "close", 3, "deviation")


@factor("FCT_01_007_PRICE_MOMENTUM", SHORT)
def _price_momentum(c, n):
    mean = _mean_price(c)
    last = c.lag(mean, 1)
    step = c.value("log_step", positive_log(F.try_divide(F.col(mean), F.col(last))), [mean, last])
    spread = ind.standard_deviation(c, 2 * n, step)
    first = c.lag(mean, n - 1)
    move = positive_log(F.try_divide(F.col(mean), F.col(first)))
    return c.value(f"price_momentum__{n}", F.try_divide(move, F.col(spread) * math.sqrt(n)), [first, spread])


@factor("FCT_01_008_ADX", (14,))
def _adx(c, n):
    return ind.adx(c, n)


@factor("FCT_01_009_MIN_ADX", (20,))
def _min_adx(c, n):
    return c.rolling("min", ind.adx(c), n)


@factor("FCT_01_010_RESIDUAL_MIN_ADX", (20,))
def _residual_min_adx(c, n):
    return _gap(c, ind.adx(c), c.rolling("min", ind.adx(c), n))


@factor("FCT_01_011_MAX_ADX", (20,))
def _max_adx(c, n):
    return c.rolling("max", ind.adx(c), n)


@factor("FCT_01_012_RESIDUAL_MAX_ADX", (20,))
def _residual_max_adx(c, n):
    return _gap(c, c.rolling("max", ind.adx(c), n), ind.adx(c))


@factor("FCT_01_013_DELTA_ADX", (20,))
def _delta_adx(c, n):
    return _change(c, ind.adx(c), n)


@factor("FCT_01_014_ACCEL_ADX", (20,))
def _accel_adx(c, n):
    adx = ind.adx(c)
    near, far = c.lag(adx, n), c.lag(adx, 2 * n)
    return c.value(f"accel_adx__{n}", F.col(adx) + F.col(far) - F.col(near) * 2, [adx, near, far])


def _intensity(c: SeriesColumns) -> str:
    tr = ind.true_range(c)
    return c.value("intensity", F.try_divide(F.col("close") - F.col("open"), F.col(tr)), [tr])


@factor("FCT_01_015_INTRADAY_INTENSITY", LONG)
def _intraday_intensity(c, n):
    return ind.moving_average(c, n, _intensity(c))


@factor("FCT_01_016_DELTA_INTRADAY_INTENSITY", LONG)
def _delta_intraday_intensity(c, n):
    return _change(c, _intensity(c), n)


@factor("FCT_01_017_PRICE_VARIANCE_RATIO", LONG)
def _price_variance_ratio(c, n):
    log = _log(c, "close")
    return _ratio(c, f"price_variance_ratio__{n}", ind.variance(c, n, log), ind.variance(c, 2 * n, log))


@factor("FCT_01_018_MIN_PRICE_VARIANCE_RATIO", LONG)
def _min_price_variance_ratio(c, n):
    return c.rolling("min", filled(c, "FCT_01_017_PRICE_VARIANCE_RATIO", n), n)


@factor("FCT_01_019_MAX_PRICE_VARIANCE_RATIO", LONG)
def _max_price_variance_ratio(c, n):
    return c.rolling("max", filled(c, "FCT_01_017_PRICE_VARIANCE_RATIO", n), n)


@factor("FCT_01_020_CHANGE_VARIANCE_RATIO", LONG)
def _change_variance_ratio(c, n):
    log = _log_change(c)
    return _ratio(c, f"change_variance_ratio__{n}", ind.variance(c, n, log), ind.variance(c, 2 * n, log))


@factor("FCT_01_021_MIN_CHANGE_VARIANCE_RATIO", LONG)
def _min_change_variance_ratio(c, n):
    return c.rolling("min", filled(c, "FCT_01_020_CHANGE_VARIANCE_RATIO", n), n)


@factor("FCT_01_022_MAX_CHANGE_VARIANCE_RATIO", LONG)
def _max_change_variance_ratio(c, n):
    return c.rolling("max", filled(c, "FCT_01_020_CHANGE_VARIANCE_RATIO", n), n)


@factor("FCT_01_023_ATR_RATIO", LONG)
def _atr_ratio(c, n):
    return _ratio(c, f"atr_ratio__{n}", ind.average_true_range(c, n), ind.average_true_range(c, 2 * n))


@factor("FCT_01_024_DELTA_PRICE_VARIANCE_RATIO", LONG)
def _delta_price_variance_ratio(c, n):
    return _change(c, filled(c, "FCT_01_017_PRICE_VARIANCE_RATIO", n), 2 * n)


@factor("FCT_01_025_DELTA_CHANGE_VARIANCE_RATIO", LONG)
def _delta_change_variance_ratio(c, n):
    return _change(c, filled(c, "FCT_01_020_CHANGE_VARIANCE_RATIO", n), 2 * n)


@factor("FCT_01_026_DELTA_ATR_RATIO", LONG)
def _delta_atr_ratio(c, n):
    return _change(c, filled(c, "FCT_01_023_ATR_RATIO", n), 2 * n)


@factor("FCT_01_027_PRICE_SKEWNESS", LONG)
def _price_skewness(c, n):
    return ind.skewness(c, n)


@factor("FCT_01_028_CHANGE_SKEWNESS", LONG)
def _change_skewness(c, n):
    return ind.skewness(c, n, _change_of_close(c))


@factor("FCT_01_029_PRICE_KURTOSIS", LONG)
def _price_kurtosis(c, n):
    return ind.kurtosis(c, n)


@factor("FCT_01_030_CHANGE_KURTOSIS", LONG)
def _change_kurtosis(c, n):
    return ind.kurtosis(c, n, _change_of_close(c))


@factor("FCT_01_031_DELTA_PRICE_SKEWNESS", LONG)
def _delta_price_skewness(c, n):
    return _change(c, filled(c, "FCT_01_027_PRICE_SKEWNESS", n), n)


@factor("FCT_01_032_DELTA_CHANGE_SKEWNESS", LONG)
def _delta_change_skewness(c, n):
    return _change(c, filled(c, "FCT_01_028_CHANGE_SKEWNESS", n), n)


@factor("FCT_01_033_DELTA_PRICE_KURTOSIS", LONG)
def _delta_price_kurtosis(c, n):
    return _change(c, filled(c, "FCT_01_029_PRICE_KURTOSIS", n), n)


@factor("FCT_01_034_DELTA_CHANGE_KURTOSIS", LONG)
def _delta_change_kurtosis(c, n):
    return _change(c, filled(c, "FCT_01_030_CHANGE_KURTOSIS", n), n)


@factor("FCT_01_035_VOLUME_MOMENTUM", LONG)
def _volume_momentum(c, n):
    return _ratio(c, f"volume_momentum__{n}", ind.moving_average(c, n, "volume"),
                  ind.moving_average(c, 2 * n, "volume"))


@factor("FCT_01_036_DELTA_VOLUME_MOMENTUM", LONG)
def _delta_volume_momentum(c, n):
    return _change(c, filled(c, "FCT_01_035_VOLUME_MOMENTUM", n), n)


@factor("FCT_01_037_VOLUME_WEIGHTED_MA_OVER_MA", LONG)
def _weighted_over_plain(c, n):
    weighted, plain = ind.weighted_moving_average(c, n), ind.moving_average(c, n)
    return c.value(f"weighted_over_plain__{n}", positive_log(F.try_divide(F.col(weighted), F.col(plain))),
                   [weighted, plain])


@factor("FCT_01_038_DIFF_VOLUME_WEIGHTED_MA_OVER_MA", LONG)
def _diff_weighted_over_plain(c, n):
    code = "FCT_01_037_VOLUME_WEIGHTED_MA_OVER_MA"
    return _gap(c, filled(c, code, n), filled(c, code, 2 * n))


@factor("FCT_01_039_PRICE_VOLUME_FIT", LONG)
def _price_volume_fit(c, n):
    volume = c.value("log_volume", F.when(F.col("volume") > 0, F.log("volume")).otherwise(F.lit(0.0)))
    return ind.linear_regression(c, n, _log(c, "close"), volume)


@factor("FCT_01_040_DIFF_PRICE_VOLUME_FIT", LONG)
def _diff_price_volume_fit(c, n):
    return _change(c, filled(c, "FCT_01_039_PRICE_VOLUME_FIT", n), 2 * n)


@factor("FCT_01_041_DELTA_PRICE_VOLUME_FIT", LONG)
def _delta_price_volume_fit(c, n):
    code = "FCT_01_039_PRICE_VOLUME_FIT"
    return _gap(c, filled(c, code, n), filled(c, code, 2 * n))


def _volume_indicator(c: SeriesColumns, n: int, name: str, rising: bool) -> str:
    last, volume = c.lag("close", 1), c.lag("volume", 1)
    moved = F.col("volume") > F.col(volume) if rising else F.col("volume") < F.col(volume)
    change = c.value(f"{name}_change", F.when(moved, F.try_divide(F.col(last), F.col("close"))).otherwise(F.lit(0.0)),
                     [last, volume])
    return _ratio(c, f"{name}__{n}", ind.moving_average(c, n, change), ind.standard_deviation(c, 2 * n, change))


@factor("FCT_01_042_POSITIVE_VOLUME_INDICATOR", LONG)
def _positive_volume(c, n):
    return _volume_indicator(c, n, "positive_volume", rising=True)


@factor("FCT_01_043_DELTA_POSITIVE_VOLUME_INDICATOR", LONG)
def _delta_positive_volume(c, n):
    return _change(c, filled(c, "FCT_01_042_POSITIVE_VOLUME_INDICATOR", n), n)


@factor("FCT_01_044_NEGATIVE_VOLUME_INDICATOR", LONG)
def _negative_volume(c, n):
    return _volume_indicator(c, n, "negative_volume", rising=False)


@factor("FCT_01_045_DELTA_NEGATIVE_VOLUME_INDICATOR", LONG)
def _delta_negative_volume(c, n):
    return _change(c, filled(c, "FCT_01_044_NEGATIVE_VOLUME_INDICATOR", n), n)


def _normal_volume_and_price(c: SeriesColumns, n: int) -> tuple[str, str]:
    log = _log_change(c)
    volume = _ratio(c, f"normal_volume__{n}", "volume", ind.median(c, n, "volume"))
    middle = ind.median(c, n, log)
    low, high = ind.quantile(c, n, log, 0.25), ind.quantile(c, n, log, 0.75)
    price = c.value(f"normal_price__{n}",
                    F.try_divide(F.col(log) - F.col(middle), F.col(high) - F.col(low)), [log, middle, low, high])
    return volume, price


@factor("FCT_01_046_PRODUCT_PRICE_VOLUME", (250,))
def _product_price_volume(c, n):
    volume, price = _normal_volume_and_price(c, n)
    return c.value(f"product_price_volume__{n}", F.col(volume) * F.col(price), [volume, price])


@factor("FCT_01_047_SUM_PRICE_VOLUME", (250,))
def _sum_price_volume(c, n):
    volume, price = _normal_volume_and_price(c, n)
    signed = F.when(F.col(price) >= 0, F.col(volume) + F.col(price)).when(
        F.col(price) < 0, -(F.col(volume) - F.col(price)))
    return c.value(f"sum_price_volume__{n}", signed, [volume, price])


@factor("FCT_01_048_DELTA_PRODUCT_PRICE_VOLUME", (250,))
def _delta_product_price_volume(c, n):
    return _change(c, filled(c, "FCT_01_046_PRODUCT_PRICE_VOLUME", n), 2 * n)


@factor("FCT_01_049_DELTA_SUM_PRICE_VOLUME", (250,))
def _delta_sum_price_volume(c, n):
    return _change(c, filled(c, "FCT_01_047_SUM_PRICE_VOLUME", n), 2 * n)


@factor("FCT_01_050_N_DAY_HIGH", LONG)
def _n_day_high(c, n):
    """Rows since the latest maximum of the window; n + 1 when the current row holds it."""
    def build(w):
        frame = w.rowsBetween(1 - n, 0)
        rows = F.col("pos") - F.max_by("pos", F.struct("close", "pos")).over(frame)
        rows = F.when(F.max("close").over(frame) == F.col("close"), n + 1).otherwise(rows)
        return F.when(F.count("close").over(frame) == n, (rows - 1) * 100.0 / n - 50)

    return c.add(f"n_day_high__{n}", build, ["close"], back=n - 1)


def rows_since_first_beyond(values: np.ndarray, n: int, lower: bool) -> np.ndarray:
    """How many rows ago the oldest of the last n values was beyond the current one, n + 1 if none was; NaN until n are there.

    The extremes of 1, 2, 4, .. values from each row on are built up; then every row walks from the start of its window
    over the longest stretches that hold nothing beyond its value.
    """
    rows = len(values)
    missing = np.isnan(values)
    values = np.where(missing, np.inf, values if lower else -values)
    extremes = [values]
    while 1 << len(extremes) <= min(n, rows):
        half, last = 1 << (len(extremes) - 1), extremes[-1]
        extremes.append(np.minimum(last[:-half], last[half:]))
    here = np.arange(rows)
    at = np.maximum(here - n + 1, 0)
    for level in range(len(extremes) - 1, -1, -1):
        inside = at < len(extremes[level])
        clear = inside & (extremes[level][np.where(inside, at, 0)] >= values)
        at = at + (clear.astype("int64") << level)
    result = np.where(at <= here, here - at, n + 1).astype("float64")
    holes = np.concatenate([[0], np.cumsum(missing)])
    full = (here >= n - 1) & (holes[1:] == holes[np.maximum(here - n + 1, 0)])
    return np.where(full, result, np.nan)


def oldest_beyond(c: SeriesColumns, n: int, column: str, lower: bool, mode: str = "literal") -> str:
    """100(k−1)/n − 50 where k is how many rows ago the window was beyond the current value.

    ``literal`` takes the oldest such row; ``intended`` the most recent extreme. k is n + 1 if there is none.
    """
    name = f"beyond__{column}__{'lower' if lower else 'higher'}__{mode}__{n}"
    if mode == "literal":
        rows = c.in_arrow(column, n, lambda values: rows_since_first_beyond(values, n, lower), f"{name}__rows")
        return c.value(name, (F.col(rows) - 1) * 100.0 / n - 50, [rows])

    def build(w):
        frame = w.rowsBetween(1 - n, 0)
        extreme = F.min(column) if lower else F.max(column)
        pick = F.min_by if lower else F.max_by
        order = F.struct(column, -F.col("pos")) if lower else F.struct(F.col(column), F.col("pos"))
        rows = F.when(extreme.over(frame) == F.col(column), n + 1).otherwise(F.col("pos") - pick("pos", order).over(frame))
        return F.when(F.count(column).over(frame) == n, (rows - 1) * 100.0 / n - 50)

    return c.add(name, build, [column], back=n - 1)


@factor("FCT_01_051_N_DAY_LOW", LONG)
def _n_day_low(c, n):
    return oldest_beyond(c, n, "close", lower=True)


@factor("FCT_01_052_N_DAY_NARROWER", LONG)
def _n_day_narrower(c, n):
    return oldest_beyond(c, n, ind.true_range(c), lower=True)


@factor("FCT_01_053_N_DAY_WIDER", LONG)
def _n_day_wider(c, n):
    return oldest_beyond(c, n, ind.true_range(c), lower=False)


@factor("FCT_01_055_DELTA_ON_BALANCE_VOLUME", LONG)
def _delta_on_balance_volume(c, n):
    """The change of a running total is the sum of its last steps."""
    total = c.rolling("sum", ind.signed_volume(c), n)
    before = c.lag("pos", n)
    return c.value(f"delta_obv__{n}", F.when(F.col(before).isNotNull(), F.col(total)), [total, before])


@factor("FCT_01_056_DETRENDED_RSI", (50,))
def _detrended_rsi(c, n):
    zero = lambda name: c.value(f"{name}__filled", F.coalesce(F.col(name), F.lit(0.0)), [name])
    fast, slow = zero(ind.rsi(c, n)), zero(ind.rsi(c, 2 * n))
    return ind.linear_regression(c, n, fast, slow, "deviation")


def threshold_rsi(c: SeriesColumns, n: int, upper: float = 70, lower: float = 30) -> str:
    rsi = ind.rsi(c, n)
    return c.value(f"threshold_rsi__{n}", F.when(F.col(rsi) >= upper, 1.0).when(F.col(rsi) <= lower, -1.0)
                   .otherwise(0.0), [rsi])


@factor("FCT_01_057_THRESHOLDED_RSI", LONG)
def _threshold_rsi(c, n):
    return threshold_rsi(c, n)


@factor("FCT_01_058_SUPPORT_CLOSE_THREE_BOLL", (20,))
def _support_three_bands(c, n):
    """Distance of the close to the price level of the heaviest of three bands of the previous range."""
    top = c.lag(c.rolling("max", "high", n), 1)
    bottom = c.lag(c.rolling("min", "low", n), 1)
    mean = _mean_price(c)
    width = (F.col(top) - F.col(bottom)) / 3
    band = F.when(F.col(mean) < F.col(bottom), None)
    for i in (1, 2, 3):
        band = band.when(F.col(mean) < F.col(bottom) + width * i, i)
    band = c.value(f"band__{n}", band, [top, bottom, mean])
    totals, counts = [], []
    for i in (1, 2, 3):
        inside = F.when(F.col(band) == i, F.col(mean))
        totals.append(c.add(f"band{i}_total__{n}", lambda w, inside=inside: F.coalesce(
            F.sum(inside).over(w.rowsBetween(1 - n, 0)), F.lit(0.0)), [band, mean], back=n - 1))
        counts.append(c.add(f"band{i}_count__{n}", lambda w, inside=inside: F.count(inside).over(
            w.rowsBetween(1 - n, 0)), [band, mean], back=n - 1))
    heaviest = F.greatest(*[F.col(t) for t in totals])
    support = F.when(heaviest <= 0, F.col("close"))
    for total, count in zip(totals, counts):
        support = support.when(F.col(total) == heaviest, F.try_divide(F.col(total), F.col(count)))
    support = c.value(f"support__{n}", F.when(F.col(bottom).isNotNull(), support), [*totals, *counts, bottom])
    spread = c.rolling("std", support, n)
    distance = F.col("close") - F.col(support)
    reach = F.greatest(F.col(spread) * 4, F.col("close") * 0.004)
    value = F.when(F.try_divide(F.abs(distance), F.col(support)) > 0.03, F.lit(0.0)).when(
        F.col(spread).isNotNull(), F.try_divide(distance, reach))
    return c.value(f"support_three_bands__{n}", value, [support, spread])


# The on-balance volume itself runs from the start of a series, see ``on_balance_volume``.
OBV_CODE = "FCT_01_054_ON_BALANCE_VOLUME"


def on_balance_volume(bars: DataFrame, keys: list[str], bucket: str, position: str = "pos",
                      chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Running total of signed volume, carried over buckets."""
    columns = SeriesColumns()
    signed = ind.signed_volume(columns)
    steps = columns.apply(bars, keys, position, chunk_rows, keep=[signed])
    return running_total(steps, keys, [position], bucket, signed, OBV_CODE).drop(signed)


def factor_columns(bars: DataFrame, requests: dict[str, list[int] | None], keys: list[str], position: str = "pos",
                   bucket: str = "date", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Bars with one column per requested factor and length, all computed in one pass over each series.

    ``requests`` maps factor codes to lengths (None: the defaults).
    """
    columns = SeriesColumns()
    keep = []
    for code, params in requests.items():
        if code == OBV_CODE:
            continue
        for n in params or FACTORS[code].params:
            keep.append(filled(columns, code, n))
    result = columns.apply(bars, keys, position, chunk_rows, keep) if keep else bars
    if OBV_CODE in requests:
        result = on_balance_volume(result, keys, bucket, position, chunk_rows)
    return result
