import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from ticklane.functions import scalar as s
from ticklane.operators import bars as b
from ticklane.operators import repair as rp


def moment(text):
    return dt.datetime.fromisoformat(f"2022-04-18 {text}")


def make_ticks(spark, rows):
    frame = [("IF2209", dt.date(2022, 4, 18), moment(t), i, p, v, 10 + i) for i, (t, p, v) in enumerate(rows)]
    return spark.createDataFrame(frame, "instrument string, date date, datetime timestamp_ntz, tick_id long, "
                                        "last_price double, delta_volume long, open_interest long")


def second():
    return F.hour("datetime") * 3600 + F.minute("datetime") * 60 + F.second("datetime")


def test_reference_session_has_4800_bars(spark):
    session = b.Session()
    assert session.bars == 4800 and session.morning_bars == 2400
    labels = spark.range(session.bars).select(session.label(F.col("id")).alias("edge")).toPandas()["edge"].tolist()
    clock = [f"{v // 3600:02d}:{v % 3600 // 60:02d}:{v % 60:02d}" for v in (labels[0], labels[2399], labels[2400], labels[-1])]
    assert clock == ["09:30:03", "11:30:00", "13:00:03", "15:00:00"]


def test_bars_on_grid(spark):
    ticks = make_ticks(spark, [("09:28:59", 1.0, 5), ("09:29:00", 10.0, 1), ("09:30:02.500", 12.0, 2), ("09:30:03", 11.0, 4),
                               ("11:30:01", 20.0, 3), ("13:00:02.500", 21.0, 1), ("13:00:03", 22.0, 1), ("15:00:00", 30.0, 9)])
    made = b.session_bars(ticks, ["instrument", "date"], b.Session(), second(), ["datetime", "tick_id"]).toPandas() \
        .set_index("slot").sort_index()
    assert len(made) == 4800 and made.index.tolist() == list(range(4800))
    assert made["volume"].sum() == 1 + 2 + 4 + 3 + 1 + 1  # nothing before 09:29:00 and nothing at 15:00:00
    first = made.loc[0]
    assert (first.open, first.close, first.high, first.low, first.volume) == (10, 12, 12, 10, 3)
    assert made.loc[5, ["open", "close", "high", "low", "volume"]].tolist() == [11, 11, 11, 11, 0]
    assert made.loc[2400, "volume"] == 4 and made.loc[2400, "datetime"] == "2022-04-18 13:00:03"
    assert made.loc[4799, "close"] == 22
    with_close = b.session_bars(ticks, ["instrument", "date"], b.Session(), second(), ["datetime", "tick_id"],
                                include_close=True).toPandas().set_index("slot")
    assert with_close.loc[4799, "close"] == 30


def test_traded_volume_and_gap_filling(spark):
    ticks = make_ticks(spark, [("09:30:00", 1.0, 5), ("09:30:02", 2.0, 5), ("09:31:00", 3.0, 9), ("11:30:00", 4.0, 9),
                               ("13:00:01", 5.0, 12)]).withColumnRenamed("delta_volume", "volume").withColumn(
        "hour", F.hour("datetime"))
    keys, order = ["instrument", "date"], ["datetime", "tick_id"]
    traded = b.traded_volume(ticks, keys, order, "hour").orderBy("tick_id").toPandas()
    assert traded["delta_volume"].tolist() == [5, 4, 3]
    filled = b.fill_gaps(ticks.where("tick_id in (0, 1)"), keys, order, "datetime", 0.5, "hour")
    again = filled.drop("filled").withColumn("hour", F.hour("datetime"))
    assert filled.count() == 5
    assert b.fill_gaps(again, keys, order, "datetime", 0.5, "hour").count() == 5  # filling twice changes nothing
    noon = b.fill_gaps(ticks.where("tick_id > 2"), keys, order, "datetime", 0.5, "hour").orderBy("datetime").toPandas()
    # a gap of 5401 seconds counts as one second, the copy follows the break
    assert [str(v)[11:] for v in noon["datetime"]] == ["11:30:00", "13:00:00.500000", "13:00:01"]


def test_forward_returns(spark):
    close = [10.0, 11, 12, 13, 14, 15]
    frame = pd.DataFrame({"instrument": "A", "pos": range(6), "open": [c - 0.5 for c in close], "close": close})
    made = b.forward_returns(spark.createDataFrame(frame), ["instrument"], minutes=(1,), bars_per_minute=2,
                             chunk_rows=2).orderBy("pos").toPandas()["ret__1"].tolist()
    expected = [(13 - 10.5) / 10.5, (14 - 11.5) / 11.5, (15 - 12.5) / 12.5, (15 - 13.5) / 13.5, (15 - 14.5) / 14.5, 0.0]
    assert all(abs(a - e) < 1e-12 for a, e in zip(made, expected))


def test_patch_rows_go_into_gaps_only(spark):
    ticks = make_ticks(spark, [("09:30:00", 1.0, 1), ("09:40:00", 2.0, 1), ("09:42:00", 3.0, 1)])
    patch = make_ticks(spark, [("09:35:00", 7.0, 1), ("09:41:00", 8.0, 1), ("09:40:00", 9.0, 1)])
    prices = sorted(r["last_price"] for r in rp.insert_patch_rows(ticks, patch).collect())
    assert prices == [1.0, 2.0, 3.0, 7.0]


def test_scalar_functions(spark):
    row = spark.range(1).select(
        s.advance_time(F.lit("11:30:00.000"), 3).alias("noon"), s.advance_time(F.lit("09:59:58.000"), 3).alias("carry"),
        s.align_half_second(F.lit("2022-04-18 09:30:00.490000000")).alias("low"),
        s.align_half_second(F.lit("2022-04-18 09:30:00.500000000")).alias("high"),
        s.swap_date_format(F.lit("20221208")).alias("dashed"), s.swap_date_format(F.lit("2022-12-08")).alias("plain"),
        s.exchange_code(F.lit("688005")).alias("sh"), s.exchange_code(F.lit("300001"), "vendor").alias("sz"),
        s.exchange_code(F.lit("900001")).alias("none"), s.time_difference(F.lit("11:29:57.000"), F.lit("11:30:00.000")).alias("d"),
        s.divide_or_zero(F.lit(1.0), F.lit(0.0)).alias("zero"), s.parse_parameters(F.lit("20|50")).alias("params"),
        *[s.price_limit_rate(F.lit(c), F.lit(d), F.lit(st)).alias(n) for n, c, d, st in (
            ("old", "300111", "20200823", False), ("new", "300111", "20200824", False), ("star", "688001", "20210101", False),
            ("north", "830001", "20210101", False), ("st", "600001", "20210101", True), ("main", "600001", "20210101", False))],
        s.contract_from_path(F.lit("/x/CFFEX.IF2209.csv")).alias("contract")).first().asDict()
    assert row == {
        "noon": "13:00:03.000", "carry": "10:00:01.000", "low": "2022-04-18 09:30:00.000000000",
        "high": "2022-04-18 09:30:00.500000000", "dashed": "2022-12-08", "plain": "20221208", "sh": "sh688005",
        "sz": "300001.XSHE", "none": None, "d": 3, "zero": 0.0, "params": [20, 50], "old": 0.1, "new": 0.2, "star": 0.2,
        "north": 0.3, "st": 0.05, "main": 0.1, "contract": "IF2209"}


def test_intervals_meet_points_once_and_without_a_nested_loop(spark):
    from ticklane.functions.intervals import join_intervals

    days = spark.sql("SELECT explode(sequence(DATE '2020-01-05', DATE '2021-03-01', INTERVAL 9 DAYS)) AS date").union(spark.sql("SELECT NULL"))
    spans = [("a", "1990-01-01", "2030-12-31"), ("b", "2020-02-10", "2020-02-10"), ("b", "2020-02-10", "2020-06-01"), ("c", "2020-05-01", "2020-04-01"),
             ("d", None, "2021-01-01"), ("e", "2025-01-01", "2026-01-01"), ("f", "2020-12-31", "2021-01-01")]
    intervals = spark.createDataFrame(spans, "k string, a string, z string").selectExpr("k", "date(a) AS a", "date(z) AS z")
    for bin_days in (1, 31, 1000):
        joined = join_intervals(intervals, days, "a", "z", "date", bin_days=bin_days)
        found = sorted((r.k, str(r.a), str(r.date)) for r in joined.collect())
        wanted = sorted((k, a, str(r.date)) for k, a, z in spans for r in days.collect() if a and r.date and a <= str(r.date) <= z)
        assert found == wanted and joined.columns == ["k", "a", "z", "date"]
    keyed = join_intervals(intervals, days.selectExpr("date", "'a' AS k"), "a", "z", "date", ["k"])
    assert {r.k for r in keyed.collect()} == {"a"}
    hint = joined.join(days, "date")._jdf.queryExecution().executedPlan().toString()
    condition = [line for line in hint.splitlines() if "NestedLoop" in line and "_bin" in line]
    assert not condition
    assert join_intervals(intervals, days.limit(0), "a", "z", "date").count() == 0
