"""Indicators of eight bars against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from ticklane.functions.series import SeriesColumns
from ticklane.operators import indicators as ind
from ticklane.operators import price_volume as pv

CLOSE = [10.0, 11.0, 13.0, 12.0, 14.0, 17.0, 16.0, 18.0]
# high is one above the close, low two below, volume 1..8; windows of three rows, of four for the kurtosis
GOLDEN = {
    "moving_average": (lambda c: ind.moving_average(c, 3), [None, None, 34 / 3, 12, 13, 43 / 3, 47 / 3, 17]),
    "weighted": (lambda c: ind.weighted_moving_average(c, 3), [None, None, 71 / 6, 109 / 9, 157 / 12, 220 / 15, 284 / 18, 358 / 21]),
    "exponential": (lambda c: ind.exponential_moving_average(c, 3), [10, 10.5, 11.75, 11.875, 12.9375, 14.96875, 15.484375, 16.7421875]),
    "variance": (lambda c: ind.variance(c, 3), [None, None, 7 / 3, 1, 1, 19 / 3, 7 / 3, 1]),
    "deviation": (lambda c: ind.standard_deviation(c, 3), [None, None, *[math.sqrt(v) for v in (7 / 3, 1, 1, 19 / 3, 7 / 3, 1)]]),
    "skewness": (lambda c: ind.skewness(c, 3), [None, None, 0.9352, 0, 0, 0.5856, -0.9352, 0]),
    "kurtosis": (lambda c: ind.kurtosis(c, 4), [None, None, None, -1.2, -1.2, 1.5, -1.69951, 0.34286]),
    "median": (lambda c: ind.median(c, 3), [None, None, 11, 12, 13, 14, 16, 17]),
    "quantile": (lambda c: ind.quantile(c, 3, "close", 0.25), [None, None, 10.5, 11.5, 12.5, 13, 15, 16.5]),
    "true_range": (ind.true_range, [3, 3, 3, 3, 3, 4, 3, 3]),
    "atr": (lambda c: ind.average_true_range(c, 3), [None, None, 3, 3, 3, 10 / 3, 10 / 3, 10 / 3]),
    "slope": (lambda c: ind.linear_regression(c, 3), [None, None, 1.5, 0.5, 0.5, 2.5, 1, 0.5]),
    "parabola": (lambda c: ind.polynomial_regression(c, 3), [None, None, 13, 12, 14, 17, 16, 18]),
    "rsi": (lambda c: ind.rsi(c, 3), [None, 100, 100, 55.5556, 84, 94.5205, 65.7143, 84.5494]),
}


def test_indicators_of_eight_bars(spark):
    rows = [("A", i, v, v + 1, v - 2, i + 1, "d") for i, v in enumerate(CLOSE)]
    bars = spark.createDataFrame(rows, "instrument string, pos long, close double, high double, low double, volume long, date string")
    columns = SeriesColumns()
    names = {name: record(columns) for name, (record, _) in GOLDEN.items()}
    for chunk in (3, 100):
        found = columns.apply(bars, ["instrument"], chunk_rows=chunk).orderBy("pos").toPandas()
        for name, (_, expected) in GOLDEN.items():
            got = [None if v != v else v for v in found[names[name]].astype(float)]
            assert got == [None if v is None else pytest.approx(v, abs=1e-4) for v in expected], (name, chunk)
    obv = pv.on_balance_volume(bars, ["instrument"], "date").orderBy("pos").select(F.col(pv.OBV_CODE).cast("long")).collect()
    assert [r[0] for r in obv] == [0, 2, 5, 1, 6, 12, 5, 13]
