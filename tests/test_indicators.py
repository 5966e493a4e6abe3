import numpy as np
import pandas as pd
import pytest

from conftest import per_series
from ticklane.functions.series import SeriesColumns
from ticklane.operators import indicators as ind
from ticklane.operators import price_volume as pv

KEYS = ["instrument"]
N = 10


def compare(bars, bars_pd, record, expected, digits=6, chunk_rows=60):
    columns = SeriesColumns()
    name = record(columns)
    got = per_series(columns.apply(bars, KEYS, chunk_rows=chunk_rows).toPandas(), name)
    for key, part in bars_pd.groupby("instrument"):
        want = np.asarray(expected(part.sort_values("pos").reset_index(drop=True)), dtype="float64")
        np.testing.assert_array_almost_equal(got[key], want, digits)
    return got


def tr(p):
    last = p["close"].shift(1)
    return pd.concat([p["high"] - p["low"], (p["high"] - last).abs(), (p["low"] - last).abs()], axis=1).max(axis=1)


def test_first_value_after_a_full_window(bars, bars_pd):
    got = compare(bars, bars_pd, lambda c: ind.moving_average(c, N), lambda p: p["close"].rolling(N).mean())
    assert np.isnan(got["A"][:9]).all() and not np.isnan(got["A"][9])


@pytest.mark.parametrize("record,expected", [
    (lambda c: ind.skewness(c, N), lambda p: p["close"].rolling(N).skew()),
    (lambda c: ind.kurtosis(c, N), lambda p: p["close"].rolling(N).kurt()),
    (lambda c: ind.median(c, N), lambda p: p["close"].rolling(N).median()),
    (lambda c: ind.quantile(c, N, "close", 0.3), lambda p: p["close"].rolling(N).quantile(0.3)),
    (ind.true_range, tr),
    (lambda c: ind.average_true_range(c, N), lambda p: tr(p).rolling(N).mean()),
    (lambda c: ind.weighted_moving_average(c, N),
     lambda p: (p["close"] * p["volume"]).rolling(N).sum() / p["volume"].rolling(N).sum()),
    (lambda c: ind.linear_regression(c, N), lambda p: p["close"].rolling(N).apply(
        lambda v: np.polyfit(np.arange(1, N + 1), v, 1)[0], raw=True)),
    (lambda c: ind.linear_regression(c, N, result="predict"), lambda p: p["close"].rolling(N).apply(
        lambda v: np.polyval(np.polyfit(np.arange(1, N + 1), v, 1), N), raw=True)),
    (lambda c: ind.linear_regression(c, N, result="intercept"), lambda p: p["close"].rolling(N).apply(
        lambda v: np.polyfit(np.arange(1, N + 1), v, 1)[1], raw=True)),
    (lambda c: ind.polynomial_regression(c, N, order=2), lambda p: p["close"].rolling(N).apply(
        lambda v: np.polyval(np.polyfit(np.arange(1, N + 1), v, 2), N), raw=True)),
])
def test_indicator_equals_pandas(bars, bars_pd, record, expected):
    compare(bars, bars_pd, record, expected, digits=5)


def test_rsi_and_exponential_average(bars, bars_pd):
    def rsi(p):
        change = p["close"].diff()
        up = change.where(change > 0, 0.0).fillna(0).ewm(span=6, adjust=False).mean()
        down = (-change).where(change < 0, 0.0).fillna(0).ewm(span=6, adjust=False).mean()
        return 100 - 100 / (1 + up / down)

    compare(bars, bars_pd, lambda c: ind.rsi(c, 6), rsi)
    compare(bars, bars_pd, lambda c: ind.exponential_moving_average(c, N),
            lambda p: p["close"].ewm(span=N, adjust=False).mean())


def test_adx(bars, bars_pd):
    def adx(p):
        up, down = p["high"].diff(), -p["low"].diff()
        plus = pd.Series(np.where(up.isna(), np.nan, np.where(up > down, up, 0)))
        minus = pd.Series(np.where(up.isna(), np.nan, np.where(down > up, down, 0)))
        atr = tr(p).rolling(14).mean()
        di_plus, di_minus = plus.rolling(14).mean() / atr, minus.rolling(14).mean() / atr
        return ((di_plus - di_minus).abs() * 100 / (di_plus + di_minus)).rolling(6).mean()

    compare(bars, bars_pd, lambda c: ind.adx(c), adx)


def deviation(order, literal=False):
    def one(v):
        n = len(v)
        x = np.arange(1, n + 1)
        at = np.linspace(0, 1, n) if literal else x
        fitted = np.polyval(np.polyfit(x, v, order), at)
        return (v[-1] - fitted[-1]) / (np.sqrt(((v - fitted) ** 2).sum() / (n - 1)) / np.sqrt(n))

    return lambda p: p["close"].rolling(N).apply(one, raw=True)


def test_deviation_factors(bars, bars_pd):
    compare(bars, bars_pd, lambda c: pv.linear_deviation(c, N, "literal"), deviation(1, literal=True), 4)
    compare(bars, bars_pd, lambda c: pv.linear_deviation(c, N, "intended"), deviation(1), 4)
    compare(bars, bars_pd, lambda c: ind.polynomial_regression(c, N, order=2, result="deviation"), deviation(2), 4)
    compare(bars, bars_pd, lambda c: ind.polynomial_regression(c, N, order=3, result="deviation"), deviation(3), 4)


def test_distance_to_extremes(bars, bars_pd):
    def high(v):
        n, best, found = len(v) + 1, v[-1], len(v) + 1
        for back in range(1, len(v)):
            if v[-1 - back] > best:
                found, best = back, v[-1 - back]
        return 100 * (found - 1) / len(v) - 50

    def low_literal(v):
        found = len(v) + 1
        for back in range(1, len(v)):
            if v[-1 - back] < v[-1]:
                found = back
        return 100 * (found - 1) / len(v) - 50

    compare(bars, bars_pd, lambda c: pv.FACTORS["FCT_01_050_N_DAY_HIGH"].record(c, N),
            lambda p: p["close"].rolling(N).apply(high, raw=True))
    compare(bars, bars_pd, lambda c: pv.oldest_beyond(c, N, "close", True),
            lambda p: p["close"].rolling(N).apply(low_literal, raw=True))
    compare(bars, bars_pd, lambda c: pv.oldest_beyond(c, N, "close", True, "intended"),
            lambda p: (-p["close"]).rolling(N).apply(high, raw=True))


def test_every_factor_is_complete_and_independent_of_chunking(bars):
    requests = {code: [6] for code in pv.FACTORS if code != "FCT_01_008_ADX"} | {pv.OBV_CODE: None}
    small = pv.factor_columns(bars, requests, KEYS, chunk_rows=45).toPandas().sort_values(["instrument", "pos"])
    large = pv.factor_columns(bars, requests, KEYS, chunk_rows=10_000).toPandas().sort_values(["instrument", "pos"])
    keys = [c for c in small.columns if c.startswith("FCT")]
    assert len(keys) == 57
    assert not small[keys].isna().any().any()
    np.testing.assert_allclose(small[keys].to_numpy(float), large[keys].to_numpy(float), rtol=1e-6, atol=1e-7)


def test_on_balance_volume(bars, bars_pd):
    got = per_series(pv.on_balance_volume(bars, KEYS, "date", chunk_rows=30).toPandas(), pv.OBV_CODE)
    for key, part in bars_pd.groupby("instrument"):
        part = part.sort_values("pos")
        np.testing.assert_allclose(got[key], (np.sign(part["close"].diff()).fillna(0) * part["volume"]).cumsum())
