"""Sliding structures: recursive smoothing, order statistics, block search, power sums."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticklane.functions.series import SeriesColumns
from ticklane.operators import indicators as ind
from ticklane.operators import price_volume as pv

KEYS = ["instrument"]


def frame_of(series: dict[str, np.ndarray]) -> pd.DataFrame:
    return pd.concat([pd.DataFrame({"instrument": k, "pos": np.arange(len(v), dtype="int64"), "x": v}) for k, v in series.items()])


def table(spark, series):
    df = spark.createDataFrame(frame_of(series)).repartition(4)
    return df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def column_of(df, name):
    frame = df.select("instrument", "pos", name).toPandas().sort_values("pos")
    return {k: part[name].to_numpy(dtype="float64") for k, part in frame.groupby("instrument")}


def plain_smoothing(values, span):
    """The recursion itself; a value after g missing ones weighs the older part with (1-a)^(g+1) against a."""
    alpha, result, old, weight = 2 / (span + 1), [], np.nan, 1.0
    for x in values:
        weight *= 1 - alpha
        if not np.isnan(x):
            old = x if np.isnan(old) else (weight * old + alpha * x) / (weight + alpha)
            weight = 1.0
        result.append(old)
    return np.array(result)


@pytest.mark.parametrize("span", [1, 3, 12])
def test_smoothing_is_exact_at_every_chunk(spark, span):
    rng = np.random.default_rng(1)
    x = rng.normal(100, 5, 1200)
    x[130] = 1e17
    x[300:900] = np.nan
    holes = np.where(rng.random(700) < 0.4, np.nan, rng.normal(0, 1, 700))
    series = {"spike": x, "holes": holes, "none": np.full(40, np.nan), "late": np.r_[np.full(450, np.nan), np.arange(5.0)], "one": np.array([3.0])}
    for chunk in (5, 400, 20_000):
        columns = SeriesColumns()
        name = columns.smooth("x", span)
        later = columns.lag(name, 2)
        found = column_of(columns.apply(table(spark, series), KEYS, chunk_rows=chunk), name)
        for key, values in series.items():
            np.testing.assert_allclose(found[key], plain_smoothing(values, span), rtol=1e-9, atol=1e-12, err_msg=f"{key} {chunk}")
        assert later


def test_python_sees_keys_position_and_inputs_only(spark):
    rng = np.random.default_rng(2)
    df = table(spark, {"a": rng.normal(0, 1, 300), "b": rng.normal(0, 1, 90)})
    wide = df.select("*", *[(F.col("x") * i).alias(f"other_{i}") for i in range(50)])
    columns = SeriesColumns()
    reach = columns.rolling_apply("x", 8, lambda v: v.max() - v.min(), "reach")
    smooth = columns.smooth(reach, 4)
    rank = columns.rolling_quantile(smooth, 20, 0.3, "rank")
    result = columns.apply(wide, KEYS, chunk_rows=37)
    assert result.columns == [*wide.columns, reach, smooth, rank]
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    python = [line for line in plan.splitlines() if "InArrow" in line or "InPandas" in line]
    assert python and not any("other_" in line for line in python)
    found = result.toPandas().sort_values(["instrument", "pos"])
    for _, part in found.groupby("instrument"):
        wanted = part["x"].rolling(8).apply(np.ptp, raw=True)
        np.testing.assert_allclose(part[reach], wanted)
        np.testing.assert_allclose(part[smooth], plain_smoothing(wanted.to_numpy(), 4))
        np.testing.assert_allclose(part[rank], [np.nan if np.isnan(w).any() or len(w) < 20 else np.quantile(w, 0.3)
                                                for w in part[smooth].rolling(20)])
        np.testing.assert_allclose(part["other_7"], part["x"] * 7)


def test_order_statistics_of_wide_windows(spark):
    rng = np.random.default_rng(3)
    x = np.round(np.cumsum(rng.normal(0, 1, 9000)), 1)
    x[6000] = 1e17
    for chunk in (2000, 20_000):
        columns = SeriesColumns()
        names = [ind.median(columns, 4800, "x"), ind.quantile(columns, 4800, "x", 0.9)]
        rows = columns.apply(table(spark, {"a": x}), KEYS, chunk_rows=chunk)
        for name, share in zip(names, (0.5, 0.9)):
            found = column_of(rows, name)["a"]
            assert np.isnan(found[:4799]).all()
            for i in (4799, 5000, 5999, 6000, 7777, 8999):
                assert found[i] == pytest.approx(np.quantile(x[i - 4799:i + 1], share))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 100])
@pytest.mark.parametrize("lower", [True, False])
def test_oldest_value_beyond_the_current_one(n, lower):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 12, 300).astype(float)
    values[rng.integers(0, 300, 6)] = np.nan
    found = pv.rows_since_first_beyond(values, n, lower)
    for i in range(300):
        window = values[max(0, i - n + 1):i + 1]
        if len(window) < n or np.isnan(window).any():
            assert np.isnan(found[i])
            continue
        beyond = [k for k, v in enumerate(window) if (v < values[i] if lower else v > values[i])]
        assert found[i] == (n - 1 - beyond[0] if beyond else n + 1)
    assert len(pv.rows_since_first_beyond(values[:0], n, lower)) == 0


def test_search_and_polynomials_keep_no_arrays(spark):
    df = table(spark, {"a": np.arange(50.0)})
    columns = SeriesColumns()
    pv.oldest_beyond(columns, 10, "x", True)
    ind.polynomial_regression(columns, 10, "x", 3, "deviation")
    plan = columns.apply(df, KEYS)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "zip_with" not in plan


@pytest.mark.parametrize("length,order", [(1500, 2), (1500, 3), (11, 3)])
def test_polynomials_of_large_prices(spark, length, order):
    rng = np.random.default_rng(5)
    x = 1e6 + np.cumsum(rng.normal(0, 3, 4000))
    x[700] = np.nan
    holes = x.copy()
    for chunk in (900, 20_000):
        columns = SeriesColumns()
        fit = ind.polynomial_regression(columns, length, "x", order)
        gap = ind.polynomial_regression(columns, length, "x", order, "deviation")
        rows = columns.apply(table(spark, {"a": holes}), KEYS, chunk_rows=chunk)
        fitted, deviation = column_of(rows, fit)["a"], column_of(rows, gap)["a"]
        assert np.isnan(fitted[:length - 1]).all() and np.isnan(fitted[700:700 + length]).all() and not np.isnan(fitted[700 + length:]).any()
        for i in [length - 1] * (length < 700) + [700 + length, 2500, 3001, 3999]:
            window = x[i - length + 1:i + 1]
            if np.isnan(window).any():
                continue
            t = np.linspace(-1, 1, length)
            values = np.polynomial.polynomial.polyval(t, np.polynomial.polynomial.polyfit(t, window - 1e6, order)) + 1e6
            error = np.sqrt(((window - values) ** 2).sum() / (length - 1)) / np.sqrt(length)
            assert fitted[i] == pytest.approx(values[-1], rel=1e-12, abs=1e-6)
            assert deviation[i] == pytest.approx((window[-1] - values[-1]) / error, rel=1e-6, abs=1e-6)


def test_values_outside_a_window_leave_no_trace(spark):
    x = np.sin(np.arange(400.0))
    x[137] = 1e17
    columns = SeriesColumns()
    fit = ind.polynomial_regression(columns, 20, "x", 2)
    found = column_of(columns.apply(table(spark, {"a": x}), KEYS), fit)["a"]
    t = np.arange(20.0)
    for i in (60, 136, 157, 158, 170, 399):
        assert found[i] == pytest.approx(np.polyval(np.polyfit(t, x[i - 19:i + 1], 2), 19), abs=1e-9)
