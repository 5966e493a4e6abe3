"""Order-book factors against plain pandas on random ticks of a few stocks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from ticklane.operators import cross_section as cs

DATES = [dt.date(2022, 4, d) for d in (18, 19, 20, 21)]
TIMES = ["09:16:00.000", "09:18:00.000", "09:21:00.000", "09:23:00.000", "09:25:00.000", "09:30:00.000",
         *[f"10:{m:02d}:00.000" for m in range(12)]]
STOCKS = ["600001", "000002", "300003"]
SESSION = [x for x in TIMES if x > "09:30:00.000"]


def ticks_frame() -> pd.DataFrame:
    rng = np.random.default_rng(5)
    rows = []
    for stock in STOCKS:
        for date in DATES:
            price, total, amount, number = 10.0, 0, 0.0, 0
            for i, time in enumerate(TIMES):
                price = round(price + rng.choice([-0.1, 0.0, 0.1]), 2)
                volume = int(rng.integers(0, 3)) * 10 if i >= 4 else 0
                number += int(volume > 0) * int(rng.integers(1, 4))
                total, amount = total + volume, amount + volume * price
                row = {"tscode": stock, "date": date, "time": time, "tick_order": i, "price": price, "close": 10.0,
                       "volume": volume, "amount": volume * price, "transaction_number": number,
                       "daily_accumulated_volume": total, "daily_amount": amount}
                for side, sign in (("bid", -1), ("ask", 1)):
                    for level in range(1, 11):
                        row[f"{side}_price{level}"] = price + sign * level * 0.01
                        row[f"{side}_volume{level}"] = int(rng.integers(0, 50))
                    volumes = [row[f"{side}_volume{k}"] for k in range(1, 11)]
                    values = [row[f"{side}_price{k}"] * v for k, v in enumerate(volumes, 1)]
                    row[f"total_{side}_volume"] = sum(volumes)
                    row[f"weighted_average_{side}_price"] = sum(values) / max(sum(volumes), 1)
                    row[f"grade10_{side}_amount"], row[f"grade5_{side}_amount"] = sum(values), sum(values[:5])
                rows.append(row)
    return pd.DataFrame(rows)


@pytest.fixture(scope="module")
def frame():
    return ticks_frame()


@pytest.fixture(scope="module")
def result(spark, frame):
    ticks = spark.createDataFrame(frame).cache()
    members = spark.createDataFrame([("IF", s, dt.date(2020, 1, 1), dt.date(2030, 1, 1)) for s in STOCKS],
                                    "product string, tscode string, start_date date, end_date date")
    requests = {code: (3,) if factor.params else None for code, factor in cs.SPOT_FACTORS.items()}
    # all 63 factors in one pass
    return cs.spot_factors(ticks, members, requests).toPandas().set_index(["date", "time"]).sort_index()


def expect(result, column, series, times=TIMES):
    got = result[column][result.index.get_level_values("time").isin(times)]
    np.testing.assert_allclose(got.to_numpy(float), series.reindex(got.index).to_numpy(float), rtol=1e-9, atol=1e-9)


def grouped(frame, column):
    return frame.groupby(["date", "time"])[column]


def ratio(frame, top, bottom):
    return grouped(frame, top).sum() / grouped(frame, bottom).sum()


def test_one_pass_gives_every_factor(result):
    assert len(result) == len(DATES) * len(TIMES)
    assert sum(c.startswith("FCT_02") for c in result.columns) == 62
    before = result[result.index.get_level_values("time") <= "09:30:00.000"]
    assert before["FCT_02_001_TOTAL_COMMISSION_RATIO"].isna().all()


def test_ratios_and_their_warm_up_rules(frame, result):
    part = frame.assign(both=frame.grade10_bid_amount + frame.grade10_ask_amount)
    base = ratio(part, "grade10_bid_amount", "both")
    base = base[base.index.get_level_values("time") > "09:30:00.000"]
    expect(result, "FCT_02_002_10_GRADE_COMMISSION_RATIO", base, SESSION)
    for name, rule in {
        "036_10_GRADE_COMMISSION_RATIO_DIFFERENCE": lambda x: (x - x.shift(3)).fillna(x - x.iloc[0]),
        "040_10_GRADE_COMMISSION_RATIO_MEAN": lambda x: x.rolling(3, min_periods=1).mean(),
        "041_10_GRADE_COMMISSION_RATIO_STD": lambda x: x.rolling(3).std().fillna(x.expanding().std(ddof=0)),
    }.items():
        expect(result, f"FCT_02_{name}__3", base.groupby(level="date", group_keys=False).apply(rule), SESSION)


def test_traded_amount_over_book(frame, result):
    base = ratio(frame, "amount", "grade5_ask_amount")
    base = base[base.index.get_level_values("time") > "09:30:00.000"]
    day = base.groupby(level="date", group_keys=False)
    expect(result, "FCT_02_031_AMOUNT_ASK_5_GRADE_COMMISSION_RATIO__3",
           day.apply(lambda x: x.rolling(3, min_periods=1).mean()), SESSION)

    def spread(x):
        warm = x.expanding().std(ddof=0)
        warm.iloc[0] = x.iloc[0]  # the first value is the ratio itself
        return x.rolling(3).std().fillna(warm)

    expect(result, "FCT_02_055_AMOUNT_ASK_5_GRADE_COMMISSION_RATIO_STD__3", day.apply(spread), SESSION)


def test_price_moves(frame, result):
    stock = frame.sort_values("tick_order").groupby(["tscode", "date"])
    part = frame.assign(dp=stock["price"].diff().fillna(0))
    part["up"], part["down"] = part.amount.where(part.dp > 0, 0), part.amount.where(part.dp < 0, 0)
    part["diff"] = part.up - part.down
    total = grouped(part, "amount").sum()
    expect(result, "FCT_02_017_RISING_FALLING_AMOUNT_RATIO", (grouped(part, "diff").sum() / total).where(total != 0, 0), SESSION)
    started = frame[frame.time >= "09:30:00.000"].copy()
    change = started.price - started.groupby(["tscode", "date"])["price"].shift(3).fillna(started.close)
    expect(result, "FCT_02_006_RISING_STOCK_RATIO__3", grouped(started.assign(c=(change > 1e-12).astype(float)), "c").mean(), SESSION)


def test_auction_factors(frame, result):
    increase, volatility = {}, {}
    for (stock, date), day in frame.groupby(["tscode", "date"]):
        second = day[(day.time >= "09:20:00.000") & (day.time <= "09:25:00.000")]
        opening = day[(day.time <= "09:30:00.000") & (day.volume > 0)]
        ok = len(opening) > 0
        increase[stock, date] = (opening.iloc[0].price / second.iloc[0].ask_price1 - 1) if ok else 0.0
        inside = day[(day.time >= "09:20:00.000") & (day.time <= opening.iloc[0].time)] if ok else day.iloc[:0]
        middle = (inside.ask_price1 + inside.bid_price1) / 2
        volatility[stock, date] = ((middle.shift(-1) - middle) / middle).std() if len(inside) else 0.0
    for column, values in (("FCT_02_008_CALL_AUCTION_SECOND_STAGE_INCREASE", increase),
                           ("FCT_02_010_CALL_AUCTION_SECOND_STAGE_RETURN_VOLATILITY", volatility)):
        for date in DATES:
            want = np.nanmean([values[s, date] for s in STOCKS])
            assert result.loc[(date, "10:00:00.000"), column] == pytest.approx(want)
            assert result.loc[(date, "09:16:00.000"), column] == 0


def test_large_orders_use_previous_days(frame, result):
    last = frame.sort_values("tick_order").groupby(["tscode", "date"]).last()
    rising, moving = {}, {}
    for (stock, date), day in frame.sort_values("tick_order").groupby(["tscode", "date"]):
        earlier = [d for d in DATES if d < date][-3:]
        if earlier:
            usual = pd.Series(last.loc[stock].loc[earlier].daily_amount.sum() / last.loc[stock].loc[earlier].transaction_number.sum(),
                              index=day.index)
        else:
            usual = (day.daily_amount / day.transaction_number).replace([np.inf], np.nan).fillna(0)
        trades, change = day.transaction_number.diff().fillna(0), day.price.diff().fillna(0)
        large = (day.amount / trades.where(trades != 0)).fillna(0) > 2 * usual
        for i in day.index:
            key = (date, day.time[i])
            rising[key] = rising.get(key, 0) + day.amount[i] * (large[i] and change[i] > 0)
            moving[key] = moving.get(key, 0) + day.amount[i] * (large[i] and change[i] != 0)
    want = pd.Series({k: rising[k] / moving[k] if moving[k] else 0.0 for k in rising})
    expect(result, "FCT_02_062_LARGE_ORDER_BUYING_RATIO", want)


def test_invalid_pairs_are_left_out(spark, frame):
    ticks = spark.createDataFrame(frame)
    members = spark.createDataFrame([("IF", s, dt.date(2020, 1, 1), dt.date(2022, 4, 19)) for s in STOCKS],
                                    "product string, tscode string, start_date date, end_date date")
    invalid = spark.createDataFrame([(DATES[0], STOCKS[0])], "date date, tscode string")
    kept = cs.constituent_ticks(ticks, members, invalid).select("date", "tscode").distinct().count()
    assert kept == 2 * 3 - 1
