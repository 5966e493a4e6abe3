import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticklane.operators import evaluate as e
from ticklane.operators import factor_tables as ft
from ticklane.operators import price_volume as pv
from ticklane.operators import reports as rp
from ticklane.operators import training as tr

KEYS = ["instrument"]


@pytest.fixture(scope="module")
def table(spark, bars):
    made = pv.factor_columns(bars, {"FCT_01_001_WILLIAM": [8], "FCT_01_035_VOLUME_MOMENTUM": [5]}, KEYS, chunk_rows=70)
    made = made.withColumnsRenamed({"FCT_01_001_WILLIAM__8": "factor", "FCT_01_035_VOLUME_MOMENTUM__5": "other"})
    return made.withColumn("ret", F.sin(F.col("pos") * 0.7) / 100 + F.col("factor") / 200).cache()


def test_band_backtest(table):
    trades = e.quantile_band_trades(table, "factor", "ret", KEYS, 4, chunk_rows=50)
    report = e.quantile_band_report(trades, KEYS).toPandas().set_index(["instrument", "band"])
    for key, data in table.toPandas().groupby("instrument"):
        data = data.sort_values("pos")
        points = np.percentile(data.factor, [50 + i * 12.5 for i in range(5)])
        profit = data.open.shift(-1).fillna(data.open) * data.ret.shift(-1).fillna(data.ret)
        for band in range(1, 5):
            low, high = points[band - 1], points[band]
            long = (data.factor > low) & (data.factor < high)
            short = (data.factor < 2 * points[0] - low) & (data.factor > 2 * points[0] - high)
            gain = np.concatenate([profit[long], -profit[short]])
            row = report.loc[(key, band)]
            assert (row.trade_count, row.long_trade_count) == (len(gain), long.sum())
            assert row.win_trade_amount == pytest.approx(gain[gain > 0].sum())
            assert row.lose_trade_amount == pytest.approx(-gain[gain < 0].sum())
    total = e.daily_profit(trades, KEYS).groupBy("instrument").agg(F.max_by("total_profit", "date").alias("t")).toPandas()
    want = trades.groupBy("instrument").agg(F.sum("profit").alias("t")).toPandas()
    np.testing.assert_allclose(total.sort_values("instrument").t, want.sort_values("instrument").t)


def test_prediction_backtest_report(table):
    flags = e.prediction_flags(table.withColumn("p", F.col("factor")), "p", "ret", KEYS, 20, 1.1, chunk_rows=64)
    report = e.backtest_report(flags.withColumnRenamed("instrument", "product")).collect()
    assert report[0]["product"] == "all"
    rates = [r["win_lose_rate"] for r in report[1:]]
    assert rates == sorted(rates, reverse=True)
    data = flags.toPandas()
    assert report[0]["count"] == (data.flag != 0).sum() == sum(r["count"] for r in report[1:])
    assert report[0]["profit"] == pytest.approx(data.trade_ret.sum())
    curve = e.profit_curve(flags.withColumn("datetime", F.format_string("%05d", "pos"))).orderBy("datetime").toPandas()
    assert curve.total_profit.iloc[-1] == pytest.approx(data.trade_ret.sum())
    assert curve.total_long_profit.iloc[-1] + curve.total_short_profit.iloc[-1] == pytest.approx(data.trade_ret.sum())


def test_scores_and_reports(spark, table):
    rows = spark.createDataFrame([(1.0, 2.0), (-2.0, 4.0), (-3.0, -6.0), (4.0, 8.0), (0.0, 10.0)], "p double, r double")
    score = e.prediction_scores(rows, "p", "r").first()
    assert score["winning_rate"] == 0.75 and score["mean_squared_error"] == pytest.approx((1 + 36 + 9 + 16 + 100) / 5)
    ic = rp.daily_information_coefficient(table, "factor", "ret", ["instrument", "date"]).toPandas()
    day = table.where("instrument = 'A' and date = 'd03'").toPandas()
    row = ic[(ic.instrument == "A") & (ic.date == "d03")].iloc[0]
    assert row.ic == pytest.approx(day.factor.corr(day.ret))
    assert row.rank_ic == pytest.approx(day.factor.rank().corr(day.ret.rank()))
    ties = rp.extreme_days(spark.createDataFrame([("a", f"d{i}", float(v)) for i, v in enumerate([1, 5, 5, 3])],
                                                 "k string, date string, mean double"), ["k"], 1, ("mean",)).toPandas()
    assert sorted(ties[ties.side == "largest"].date) == ["d1", "d2"]
    made = rp.factor_reports(table, ["factor", "other"], {
        "stability": lambda df, value: rp.daily_stability(df, value, ["instrument", "date"]),
        "moments": lambda df, value: rp.moments(df, value, KEYS)})
    assert len(made) == 4 and made["moments", "other"].count() == 2
    bins = rp.histogram(table, "factor", 7).toPandas()
    assert bins["count"].sum() == table.count() and bins.bin.max() == 6


def test_models(table, tmp_path):
    train, test = tr.split_by_date(table, "d04", "date")
    model = tr.fit(train, ["factor", "other"], "ret", tr.BoostConfig(max_iter=3, max_depth=2))
    tr.save(model, str(tmp_path / "model"))
    first = tr.predict(model, test, ["factor", "other"]).orderBy("instrument", "pos").toPandas()
    again = tr.predict(tr.load(str(tmp_path / "model")), test, ["factor", "other"]).orderBy("instrument", "pos").toPandas()
    pd.testing.assert_frame_equal(first, again)
    merged = tr.walk_forward(table, ["factor", "other"], "ret", ["d03", "d05"], config=tr.BoostConfig(max_iter=1, max_depth=1))
    assert merged.count() == table.where("date >= 'd03'").count()
    assert {r[0] for r in merged.where("date = 'd06'").select("trained_before").distinct().collect()} == {"d05"}
    mirrored = tr.mirror_rows(table.select("instrument", "factor", "ret"), ["instrument"])
    assert mirrored.agg(F.sum("factor")).first()[0] == pytest.approx(0)


def test_factor_registry_and_organizing(spark, table):
    request = ft.resolve_factor("FCT_01_001_WILLIAM_1.0", "20|50")
    assert request.keys == ["FCT_01_001_WILLIAM__20", "FCT_01_001_WILLIAM__50"] and not request.is_spot
    assert ft.resolve_factor("FCT_02_016_AMOUNT_AND_COMMISSION_RATIO_1.0").is_spot
    with pytest.raises(KeyError):
        ft.resolve_factor("FCT_99_000_NONE_1.0")
    config = ft.factor_config(spark)
    assert config.count() == len(ft.all_factors()) == 57 + 63
    assert ft.select_factors(config, ["FCT_01_001_WILLIAM_1.0"]).first()["params"] == [1000]
    holes = table.withColumn("factor", F.when(F.col("pos") % 2 == 0, F.col("factor")))
    days = spark.createDataFrame([("d01",)], "date string")
    done = ft.organize(holes, "X", [(None, ft.zero_missing_on(days, ["factor"])),
                                    ({"X"}, ft.excluding_dates(spark.createDataFrame([("d02",)], "date string")))])
    assert done.where("date = 'd02'").count() == 0
    assert done.where("date = 'd01' and factor is null").count() == 0 < done.where("date = 'd03' and factor is null").count()
    cut = ft.cut_to_main_span(table, spark.createDataFrame([("P", "A", "d02", 0), ("P", "A", "d04", 0), ("P", "A", "d05", 1)],
                                                           "product string, instrument string, date string, is_main int"))
    assert sorted(r[0] for r in cut.select("date").distinct().collect()) == ["d02", "d03", "d04"]
