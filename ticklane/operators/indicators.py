"""Rolling indicators as recorded series columns.

Every function records its columns on a :class:`SeriesColumns` and returns the name of the result,
``<indicator>__<target>__<length>``. A rolling value is null until its window is full.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ticklane.functions.series import SeriesColumns
from ticklane.functions.windows import corrected_kurtosis, corrected_skewness


def _renamed(columns: SeriesColumns, name: str, source: str) -> str:
    return columns.value(name, F.col(source), [source])


def moving_average(columns: SeriesColumns, length: int, target: str = "close") -> str:
    return _renamed(columns, f"moving_average__{target}__{length}", columns.rolling("avg", target, length))


def weighted_moving_average(columns: SeriesColumns, length: int, target: str = "close",
                            weight: str = "volume") -> str:
    product = columns.value(f"{target}__times__{weight}", F.col(target) * F.col(weight), [target, weight])
    top = columns.rolling("sum", product, length)
    bottom = columns.rolling("sum", weight, length)
    return columns.value(f"weighted_moving_average__{target}__{weight}__{length}",
                         F.try_divide(F.col(top), F.col(bottom)), [top, bottom])


def exponential_moving_average(columns: SeriesColumns, length: int, target: str = "close") -> str:
    return _renamed(columns, f"exp_moving_average__{target}__{length}", columns.smooth(target, length))


def standard_deviation(columns: SeriesColumns, length: int, target: str = "close") -> str:
    return _renamed(columns, f"standard_deviation__{target}__{length}", columns.rolling("std", target, length))


def variance(columns: SeriesColumns, length: int, target: str = "close") -> str:
    return _renamed(columns, f"variance__{target}__{length}", columns.rolling("var", target, length))


def _shape(columns: SeriesColumns, kind: str, length: int, target: str, measure: Callable) -> str:
    def build(w):
        frame = w.rowsBetween(1 - length, 0)
        return F.when(F.count(target).over(frame) == length, measure(target, frame))

    return columns.add(f"{kind}__{target}__{length}", build, [target], back=length - 1)


def skewness(columns: SeriesColumns, length: int, target: str = "close") -> str:
    return _shape(columns, "skewness", length, target, corrected_skewness)


def kurtosis(columns: SeriesColumns, length: int, target: str = "close") -> str:
    return _shape(columns, "kurtosis", length, target, corrected_kurtosis)


def quantile(columns: SeriesColumns, length: int, target: str = "close", proportion: float = 0.5) -> str:
    share = str(proportion).replace(".", "_")
    return columns.rolling_quantile(target, length, proportion, f"quantile__{target}__{length}__{share}")


def median(columns: SeriesColumns, length: int, target: str = "close") -> str:
    return _renamed(columns, f"median__{target}__{length}", quantile(columns, length, target, 0.5))


def true_range(columns: SeriesColumns) -> str:
    last = columns.lag("close", 1)
    return columns.value("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col(last)),
                                          F.abs(F.col("low") - F.col(last))), ["high", "low", last])


def average_true_range(columns: SeriesColumns, length: int) -> str:
    return _renamed(columns, f"atr__{length}", columns.rolling("avg", true_range(columns), length))


def linear_regression(columns: SeriesColumns, length: int, target: str = "close", variable: str = "",
                      result: str | Callable[[Column, Column, Column], Column] = "slope") -> str:
    """Least squares over the window, on 1..length or on another column.

    ``result``: slope, intercept, predict (fitted value of the last row), deviation (last value minus it), or a named
    function of the slope, the intercept and the fitted value of the last row.
    """
    by_row = variable == ""
    label = result if isinstance(result, str) else result.__name__
    name = f"linear_regression__{target}__{variable or 'row'}__{length}__{label}"

    def build(w) -> Column:
        frame = w.rowsBetween(1 - length, 0)
        y = F.col(target)
        full = F.count(y).over(frame) == length
        x = F.col("pos") if by_row else F.col(variable)
        slope = F.regr_slope(y, x).over(frame)
        if not by_row:
            # a constant regressor fits with slope 0
            slope = F.when(F.min(x).over(frame) == F.max(x).over(frame), F.lit(0.0)).otherwise(slope)
        mean = F.avg(y).over(frame)
        # row numbers 1..length have mean (length + 1) / 2 wherever the window lies
        to_zero = F.lit((length + 1) / 2) if by_row else F.avg(x).over(frame)
        to_last = F.lit((length - 1) / 2) if by_row else x - F.avg(x).over(frame)
        intercept, fitted = mean - slope * to_zero, mean + slope * to_last
        if callable(result):
            return F.when(full, result(slope, intercept, fitted))
        return F.when(full, {"slope": slope, "intercept": intercept, "predict": fitted, "deviation": y - fitted}[result])

    return columns.add(name, build, [target] if by_row else [target, variable], back=length - 1)


def polynomial_basis(length: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal polynomials of degree 0..order on ``length`` points 1/length apart around zero.

    Their coefficients (row: power, column: degree) and their values at the last point.
    """
    grid = (np.arange(length) - (length - 1) / 2) / length
    basis, triangle = np.linalg.qr(np.vander(grid, order + 1, increasing=True))
    return np.linalg.inv(triangle), basis[-1]


def power_sums(columns: SeriesColumns, length: int, target: str, order: int) -> list[str]:
    """Sums over the window of the target times powers of the place, in window lengths from the start of the row's block.

    Positions are cut into blocks as long as the window, which so covers the end of one block and the start of the next:
    a running sum backwards in the one and forwards in the other. Nothing is subtracted, so values outside a window leave
    no trace in it. Null until the window is full.
    """
    place = F.pmod(F.col("pos"), F.lit(length))
    run = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    missing = columns.add(f"{target}__last_missing", lambda w: F.coalesce(
        F.max(F.when(F.col(target).isNull(), F.col("pos"))).over(run(w)), F.min("pos").over(run(w)) - 1), [target])
    names = []
    for power in range(order + 1):
        here = lambda start: F.col(target) * F.pow((place - start) / F.lit(float(length)), F.lit(power)) if power else F.col(target)  # noqa: B023, E731
        label = f"{target}__power{power}__{length}"
        forwards = columns.within_blocks(f"{label}__forwards", lambda w, v=here(0): F.sum(v).over(run(w)), length, [target])
        backwards = columns.within_blocks(f"{label}__backwards", lambda w, v=here(length): F.sum(v).over(run(w)), length, [target], reverse=True)
        before = columns.lag(backwards, length - 1)
        total = F.col(forwards) + F.when(place == length - 1, F.lit(0.0)).otherwise(F.col(before))
        names.append(columns.value(label, F.when(F.col("pos") - F.col(missing) >= length, total), [forwards, before, missing]))
    return names


def polynomial_regression(columns: SeriesColumns, length: int, target: str = "close", order: int = 2,
                          result: str = "predict") -> str:
    """Polynomial least squares on 1..length: ``predict`` is the last fitted value, ``deviation`` the last
    residual over the standard error of the residuals.

    On a fixed grid the fit is a projection on fixed polynomials, so each coefficient is a combination of power sums,
    moved from the start of the block to the middle of the window.
    """
    name = f"polynomial_regression__{target}__{order}__{length}__{result}"
    powers, at_last = polynomial_basis(length, order)
    sums = power_sums(columns, length, target, order)
    shift = (F.lit((length - 1) / 2) - F.pmod(F.col("pos"), F.lit(length))) / F.lit(float(length))
    centred = []
    for power in range(order + 1):
        moved = sum((F.col(sums[j]) * F.lit(float(math.comb(power, j))) * F.pow(shift, F.lit(power - j)) for j in range(power)), F.lit(0.0))
        centred.append(columns.value(f"{sums[power]}__centred", F.col(sums[power]) + moved, sums[:power + 1]))
    coefficients = [columns.value(f"{target}__polynomial{degree}of{order}__{length}", sum(
        (F.col(centred[power]) * F.lit(float(powers[power][degree])) for power in range(degree + 1)), F.lit(0.0)), centred)
        for degree in range(order + 1)]
    predict = sum((F.col(c) * float(at_last[degree]) for degree, c in enumerate(coefficients)), F.lit(0.0))
    if result == "predict":
        return columns.value(name, predict, coefficients)

    def build(w) -> Column:
        # the basis is orthonormal and starts with the constant: residual square = variance − fitted squares
        spread = F.var_pop(target).over(w.rowsBetween(1 - length, 0)) * length
        squares = spread - sum((F.col(c) * F.col(c) for c in coefficients[1:]), F.lit(0.0))
        error = F.sqrt(F.greatest(squares, F.lit(0.0)) / (length - 1)) / F.sqrt(F.lit(float(length)))
        return F.try_divide(F.col(target) - predict, error)

    return columns.add(name, build, [target, *coefficients])


def adx(columns: SeriesColumns, length: int = 14, smoothing: int = 6) -> str:
    """Directional index: |DI+ − DI−| over their sum, averaged."""
    last_high, last_low = columns.lag("high", 1), columns.lag("low", 1)
    up = columns.value("up", F.col("high") - F.col(last_high), ["high", last_high])
    down = columns.value("down", F.col(last_low) - F.col("low"), ["low", last_low])
    one_side = lambda a, b: F.when(F.col(a) > F.col(b), F.col(a)).when(F.col(a) <= F.col(b), F.lit(0.0))
    plus = columns.value("dm_plus", one_side(up, down), [up, down])
    minus = columns.value("dm_minus", one_side(down, up), [up, down])
    atr = average_true_range(columns, length)
    di = []
    for side in (plus, minus):
        mean = columns.rolling("avg", side, length)
        di.append(columns.value(f"{side}__di{length}", F.try_divide(F.col(mean), F.col(atr)), [mean, atr]))
    dx = columns.value(f"dx__{length}", F.try_divide(F.abs(F.col(di[0]) - F.col(di[1])) * 100,
                                                     F.col(di[0]) + F.col(di[1])), di)
    return _renamed(columns, f"adx__{length}__{smoothing}", columns.rolling("avg", dx, smoothing))


def signed_volume(columns: SeriesColumns) -> str:
    """Volume with the sign of the close change; its running total is the on-balance volume."""
    last = columns.lag("close", 1)
    sign = F.when(F.col("close") > F.col(last), 1).when(F.col("close") < F.col(last), -1).otherwise(0)
    return columns.value("signed_volume", sign * F.col("volume"), ["close", "volume", last])


def rsi(columns: SeriesColumns, length: int) -> str:
    """100 − 100/(1 + smoothed rises / smoothed falls)."""
    last = columns.lag("close", 1)
    change = F.col("close") - F.col(last)
    rise = columns.value("rise", F.when(change > 0, change).otherwise(F.lit(0.0)), ["close", last])
    fall = columns.value("fall", F.when(change < 0, -change).otherwise(F.lit(0.0)), ["close", last])
    rises, falls = columns.smooth(rise, length), columns.smooth(fall, length)
    ratio = F.try_divide(F.col(rises), F.col(falls))
    value = F.when((F.col(falls) == 0) & (F.col(rises) > 0), F.lit(100.0)).otherwise(100 - 100 / (1 + ratio))
    return columns.value(f"rsi__{length}", value, [rises, falls])
