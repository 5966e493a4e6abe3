import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import per_series
from ticklane.functions import series as sr
from ticklane.functions.quantiles import exact_quantiles
from ticklane.sources.market import Market

KEYS = ["instrument"]


def both(bars, bars_pd, columns, name, expected, chunk_rows=37):
    got = per_series(columns.apply(bars, KEYS, chunk_rows=chunk_rows).toPandas(), name)
    for key, part in bars_pd.groupby("instrument"):
        np.testing.assert_allclose(got[key], expected(part.sort_values("pos")).to_numpy(dtype="float64"), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("kind,rows", [("avg", 5), ("sum", 12), ("min", 7), ("max", 50), ("std", 9), ("var", 20)])
def test_rolling_equals_pandas_for_any_chunking(bars, bars_pd, kind, rows):
    columns = sr.SeriesColumns()
    name = columns.rolling(kind, "close", rows)
    rule = {"avg": "mean"}.get(kind, kind)
    both(bars, bars_pd, columns, name, lambda p: getattr(p["close"].rolling(rows), rule)())


def test_wide_windows(bars, bars_pd):
    columns = sr.SeriesColumns()
    name = columns.rolling("avg", "close", 60)
    both(bars, bars_pd, columns, name, lambda p: p["close"].rolling(60).mean())


def test_sums_wait_for_full_windows_with_nulls(spark, bars, bars_pd):
    holes = bars.withColumn("x", F.when(F.col("pos") % 13 != 4, F.col("close")))
    columns = sr.SeriesColumns()
    name = columns.rolling("sum", "x", 6)
    both(holes, bars_pd, columns, name, lambda p: p["close"].where(p["pos"] % 13 != 4).rolling(6).sum())


def test_smoothing_equals_recursion_across_chunks(bars, bars_pd):
    columns = sr.SeriesColumns()
    name = columns.smooth("close", 5)
    both(bars, bars_pd, columns, name, lambda p: p["close"].ewm(span=5, adjust=False).mean(), chunk_rows=50)


def test_custom_function_and_lead(bars, bars_pd):
    columns = sr.SeriesColumns()
    name = columns.rolling_apply("close", 8, lambda v: v.max() - v.min(), "reach")
    later = columns.lead(name, 3)
    both(bars, bars_pd, columns, later, lambda p: p["close"].rolling(8).apply(np.ptp, raw=True).shift(-3))


def test_rows_are_neither_lost_nor_repeated(bars):
    columns = sr.SeriesColumns()
    columns.lag("close", 90)
    result = columns.apply(bars, KEYS, chunk_rows=11)
    assert result.count() == bars.count()
    assert result.select("instrument", "pos").distinct().count() == bars.count()


def test_positions_and_carried_values(bars, bars_pd):
    numbered = sr.with_position(bars.drop("pos").withColumn("seq", F.col("open") * 0 + F.monotonically_increasing_id()),
                                KEYS, ["seq"], "date", "place")
    assert numbered.groupBy("instrument").agg(F.max("place").alias("m")).toPandas()["m"].tolist() == [259, 259]
    total = sr.running_total(bars, KEYS, ["pos"], "date", "volume", "total").toPandas()
    before = sr.previous_value(bars, KEYS, ["pos"], "date", "close", "before").toPandas()
    after = sr.next_value(bars, KEYS, ["pos"], "date", "close", "after").toPandas()
    for key, part in bars_pd.groupby("instrument"):
        part = part.sort_values("pos")
        np.testing.assert_allclose(per_series(total, "total")[key], part["volume"].cumsum())
        np.testing.assert_allclose(per_series(before, "before")[key], part["close"].shift(1))
        np.testing.assert_allclose(per_series(after, "after")[key], part["close"].shift(-1))


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_exact_quantiles(spark, size):
    rng = np.random.default_rng(size)
    # a third of all rows share one value
    values = np.where(rng.random(size) < 0.34, 5.0, np.round(rng.normal(5, 3, size), 2))
    frame = pd.DataFrame({"k": np.where(np.arange(size) % 2 == 0, "a", "b"), "v": values})
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    rows = exact_quantiles(spark.createDataFrame(frame), "v", shares, ["k"], most_rows=8).collect()
    for row in rows:
        np.testing.assert_allclose(row["quantiles"], frame[frame.k == row["k"]]["v"].quantile(shares))
    whole = exact_quantiles(spark.createDataFrame(frame), "v", shares, most_rows=8).collect()
    np.testing.assert_allclose(whole[0]["quantiles"], frame["v"].quantile(shares))


def test_wide_windows_follow_the_same_rule_at_every_length(spark):
    rows = 700
    values = np.ones(rows)
    values[0] = 1e17
    frame = pd.DataFrame({"instrument": "A", "pos": np.arange(rows, dtype="int64"), "spike": values,
                          "hole": np.where(np.arange(rows) == 3, np.nan, 1.0)})
    frame["gap"] = frame["hole"].astype(object).where(frame["hole"].notna(), None)
    df = spark.createDataFrame(frame.drop(columns="gap")).withColumn("gap", F.when(~F.isnan("hole"), F.col("hole")))
    for length in (255, 256, 300):
        for chunk in (50, 20_000):
            columns = sr.SeriesColumns()
            names = [columns.rolling("avg", c, length) for c in ("spike", "hole", "gap")]
            last = columns.apply(df, ["instrument"], "pos", chunk).where("pos = 600").first()
            assert [last[n] for n in names] == [1.0, 1.0, 1.0], (length, chunk)


def test_positions_may_be_negative(spark):
    df = spark.createDataFrame([("A", i - 30, float(i)) for i in range(60)], "instrument string, pos long, x double")
    for chunk in (5, 7, 400):
        columns = sr.SeriesColumns()
        columns.lag("x", 3)
        columns.lead("x", 2)
        found = {r.pos: (r["x__lag3"], r["x__lead2"]) for r in columns.apply(df, ["instrument"], "pos", chunk).collect()}
        assert found == {i - 30: (float(i - 3) if i >= 3 else None, float(i + 2) if i < 58 else None) for i in range(60)}


def test_ticks_of_one_moment_keep_the_order_of_their_ids(spark, tmp_path):
    ids = [1 << 26, 1, -5, (1 << 63) - 1, 1 << 40]
    spark.sql("SELECT TIMESTAMP '2024-01-01 10:00:00' AS ts").crossJoin(spark.createDataFrame([(i,) for i in ids], "event_id long")) \
        .selectExpr("event_id", "ts", "7L AS user_id", "'click' AS event_type", "CAST(event_id % 1000 AS DOUBLE) AS value",
                    "'{\"k\": 1}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    ticks = Market(spark, str(tmp_path)).future_ticks()
    assert [r.tick_id for r in ticks.orderBy("tick_order").collect()] == sorted(ids)
