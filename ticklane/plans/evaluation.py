"""Queries of bars, returns, factor reports, backtests and training over hourly bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.functions import quantiles as fq
from ticklane.functions import scalar as fs
from ticklane.functions import windows as win
from ticklane.functions.series import SeriesColumns, running_total
from ticklane.operators import bars as b
from ticklane.operators import evaluate as e
from ticklane.operators import factor_tables as ft
from ticklane.operators import price_volume as pv
from ticklane.operators import reports as rp
from ticklane.operators import training as tr
from ticklane.plans import oracle as o
from ticklane.plans.catalog import add, date_text, rounded
from ticklane.session import stored

CHUNK = 400
KEYS = ["instrument"]
WILLIAM, MOMENTUM = "FCT_01_001_WILLIAM__20", "FCT_01_035_VOLUME_MOMENTUM__10"

RETURNS = """
finals AS (SELECT instrument, arg_max(close, pos) AS final FROM bars GROUP BY ALL),
returned AS (SELECT bars.*, """ + ", ".join(
    f"coalesce((coalesce(lead(close, {n + 1}) OVER (PARTITION BY instrument ORDER BY pos), final) - lead(open) OVER "
    f"(PARTITION BY instrument ORDER BY pos)) / lead(open) OVER (PARTITION BY instrument ORDER BY pos), 0) AS ret{n}"
    for n in (1, 2, 5)) + " FROM bars JOIN finals USING (instrument))"
FACTORED = o.BARS + "," + RETURNS + f""",
factored AS (SELECT *, coalesce({o.ratio(f"close - (({o.full('max', 'high', 20)}) + ({o.full('min', 'low', 20)})) / 2",
                                         f"({o.full('max', 'high', 20)}) - ({o.full('min', 'low', 20)})")}, 0) AS william,
  coalesce({o.ratio(o.full('avg', 'volume', 10), o.full('avg', 'volume', 20))}, 0) AS momentum FROM returned)"""


def minute_of_day():
    """Bucket of a tick: small enough for one task whatever contract it belongs to."""
    return F.hour("datetime") * 60 + F.minute("datetime")


def returned(market) -> DataFrame:
    table = b.forward_returns(market.bars(), KEYS, minutes=(1, 2, 5), bars_per_minute=1, chunk_rows=CHUNK)
    return table.withColumnsRenamed({f"ret__{n}": f"ret{n}" for n in (1, 2, 5)})


def factored(market) -> DataFrame:
    """Bars with returns and two factors."""
    table = pv.factor_columns(returned(market), {"FCT_01_001_WILLIAM": [20], "FCT_01_035_VOLUME_MOMENTUM": [10]}, KEYS,
                              chunk_rows=CHUNK)
    return table.withColumnsRenamed({WILLIAM: "william", MOMENTUM: "momentum"})


def _register_bars() -> None:
    shown = lambda: ["instrument", "datetime", *[rounded(c, 4) for c in ("open", "close", "high", "low")], "volume", "interest"]
    shown_sql = ("instrument, datetime, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ("open", "close", "high", "low"))
                 + ", volume, interest")
    add("g15_t03_bars_on_session_grid", lambda m: m.bars().select(*shown()), f"WITH {o.BARS} SELECT {shown_sql} FROM bars")
    # a day with an opening slot, a noon break and half-hour slots
    session = b.Session(open=9 * 3600, first=1800 + 1800, step=1800, break_start=41400, break_end=46800, close=61200)
    slot = (f"CASE WHEN second < {session.open} THEN NULL WHEN second < {session.open + session.first} THEN 0 "
            f"WHEN second < 41400 THEN (second - {session.open + session.first}) // 1800 + 1 WHEN second < 48600 THEN "
            f"{session.morning_bars} WHEN second < 61200 THEN {session.morning_bars} + (second - 46800) // 1800 END")
    label = (f"CASE WHEN s < {session.morning_bars} THEN {session.open + session.first} + s * 1800 ELSE 46800 + (s - "
             f"{session.morning_bars} + 1) * 1800 END")
    head = o.BARS.split("slots AS")[0]
    broken = head + f"""
slots AS (SELECT instrument, date, {slot} AS slot, arg_min(last_price, datetime) AS open, arg_max(last_price, datetime) AS
  close, max(last_price) AS high, min(last_price) AS low, CAST(sum(delta_volume) AS BIGINT) AS volume,
  arg_max(open_interest, datetime) AS interest FROM trades WHERE delta_volume > 0 AND ({slot}) IS NOT NULL GROUP BY ALL),
spread AS (SELECT *, coalesce(lead(slot) OVER (PARTITION BY instrument, date ORDER BY slot), {session.bars}) AS nx FROM slots),
filled AS (SELECT *, unnest(range(CAST(slot AS BIGINT), CAST(nx AS BIGINT))) AS s FROM spread)
SELECT instrument, CAST(date + to_seconds({label}) AS VARCHAR) AS datetime,
  round(CASE WHEN s > slot THEN close ELSE open END, 4) + 0.0 AS open, round(close, 4) + 0.0 AS close,
  round(CASE WHEN s > slot THEN close ELSE high END, 4) + 0.0 AS high,
  round(CASE WHEN s > slot THEN close ELSE low END, 4) + 0.0 AS low, CASE WHEN s > slot THEN 0 ELSE volume END AS volume,
  interest FROM filled"""
    add("t03_session_with_noon_break", lambda m: b.session_bars(
        m.future_ticks().where("delta_volume > 0"), ["instrument", "date"], session, F.col("second"),
        ["tick_order"]).select(*shown()), f"WITH {broken}")

    def cumulative(m):
        ticks = m.future_ticks().withColumn("minute", minute_of_day()).withColumnRenamed("delta_volume", "k")
        return running_total(ticks, ["instrument", "date"], ["tick_order"], "minute", "k", "volume")

    add("t05_traded_volume", lambda m: b.traded_volume(
        cumulative(m), ["instrument", "date"], ["tick_order"], "minute").select(
        "instrument", "tick_id", "volume", "delta_volume"),
        f"WITH {o.BARS}, run AS (SELECT *, CAST(sum(delta_volume) OVER (PARTITION BY instrument, date ORDER BY datetime) AS "
        f"BIGINT) AS volume FROM trades) SELECT instrument, tick_id, volume, delta_volume FROM run WHERE delta_volume > 0")
    micro = lambda: F.timestamp_diff("MICROSECOND", F.col("date").cast("timestamp_ntz"), F.col("datetime")).alias("micros")
    add("t04_fill_future_gaps", lambda m: b.fill_gaps(
        m.future_ticks().withColumn("minute", minute_of_day()), ["instrument", "date"], ["tick_order"], "datetime",
        600.0, "minute").select("instrument", date_text(), micro(), "tick_id", F.col("filled").cast("int").alias("filled")),
        f"WITH {o.BARS}, ahead AS (SELECT *, date_diff('microsecond', datetime, lead(datetime) OVER (PARTITION BY instrument, "
        f"date ORDER BY datetime)) / 1e6 AS g0 FROM trades), gapped AS (SELECT *, CASE WHEN g0 >= 5400 THEN g0 - 5400 ELSE g0 "
        f"END AS g FROM ahead), copied AS (SELECT *, unnest(range(0, 1 + CASE WHEN g > 600 THEN CAST(ceil(round(g / 600, 6)) "
        f"AS BIGINT) - 1 ELSE 0 END)) AS k FROM gapped) SELECT instrument, CAST(date AS VARCHAR) AS date, date_diff("
        f"'microsecond', CAST(date AS TIMESTAMP), datetime) + k * 600000000 AS micros, tick_id, CAST(k > 0 AS INTEGER) AS "
        f"filled FROM copied")
    add("w12_forward_returns", lambda m: returned(m).select(
        "instrument", "datetime", *[rounded(f"ret{n}") for n in (1, 2, 5)]),
        f"WITH {o.BARS}, {RETURNS} SELECT instrument, datetime, " + ", ".join(f"{o.r(f'ret{n}')} AS ret{n}" for n in (1, 2, 5))
        + " FROM returned")
    add("w13_percent_returns", lambda m: b.percent_returns(m.bars(), KEYS, [1, 4], chunk_rows=CHUNK).select(
        "instrument", "datetime", rounded("ret_percent__1", 6, "r1"), rounded("ret_percent__4", 6, "r4")),
        f"WITH {o.BARS} SELECT instrument, datetime, " + ", ".join(
            f"round((lead(close, {n}) OVER ({o.SERIES}) - close) / close * 100, 6) + 0.0 AS r{n}" for n in (1, 4)) + " FROM bars")
    flat = lambda c: f"coalesce(({c}) , false)"
    near = lambda k: f"{'lag' if k < 0 else 'lead'}(flat, {abs(k)}) OVER ({o.SERIES})"
    add("t07_drop_limit_days", lambda m: b.drop_limit_days(m.bars(), KEYS, "date", volume_over=10, chunk_rows=CHUNK).select(
        "instrument", "datetime", rounded("close", 4)),
        f"WITH {o.BARS}, flats AS (SELECT *, high = low AS flat FROM bars), runs AS (SELECT *, flat AND volume > 10 AND "
        f"({flat(f'{near(-1)} AND {near(-2)}')} OR {flat(f'{near(-1)} AND {near(1)}')} OR {flat(f'{near(1)} AND {near(2)}')}) "
        f"AS hit FROM flats), bad AS (SELECT DISTINCT instrument, date FROM runs WHERE hit) SELECT instrument, datetime, "
        f"round(close, 4) + 0.0 AS close FROM bars ANTI JOIN bad USING (instrument, date)")
    span = ("spans AS (SELECT instrument, min(date) AS a, max(date) AS z FROM (SELECT instrument, date, row_number() OVER "
            "(PARTITION BY date ORDER BY sum(delta_volume) DESC, instrument) AS rn FROM trades GROUP BY instrument, date) "
            "WHERE rn = 1 GROUP BY ALL)")
    add("p06_t17_factor_table_main_span", lambda m: ft.build_factor_table(
        m.bars(), [ft.resolve_factor("FCT_01_001_WILLIAM_1.0", "20")], m.contract_calendar(), chunk_rows=CHUNK).select(
        "instrument", "datetime", rounded(WILLIAM, 6, "william")),
        f"WITH {FACTORED}, {span} SELECT instrument, datetime, {o.r('william')} AS william FROM factored JOIN spans USING "
        f"(instrument) WHERE date BETWEEN a AND z")
    series = "PARTITION BY instrument ORDER BY pos"

    def scaled(m):
        columns = SeriesColumns()
        columns.add("scaled", lambda w: win.min_max_scaled("close", w, 10), ["close"], back=9)
        columns.rolling("sum", "close", 5)
        columns.rolling("min", "close", 5)
        columns.rolling("max", "close", 5)
        columns.rolling("std", "close", 5)
        columns.lag("close", 3)
        return columns.apply(m.bars(), KEYS, chunk_rows=CHUNK)

    low, high = o.full("min", "close", 10), o.full("max", "close", 10)
    add("w11_rolling_min_max_scaling", lambda m: scaled(m).select("instrument", "datetime", rounded("scaled")),
        f"WITH {o.BARS} SELECT instrument, datetime, round(CASE WHEN ({high}) = ({low}) THEN 0 ELSE (close - ({low})) / "
        f"(({high}) - ({low})) END, 6) + 0.0 AS scaled FROM bars")
    kinds = {"sum": "sum", "min": "min", "max": "max", "std": "stddev_samp"}
    add("w01_w02_w16_lag_and_rolling", lambda m: scaled(m).select(
        "instrument", "datetime", rounded("close__lag3", 6, "lag3"), *[rounded(f"close__{k}5", 6, k) for k in kinds]),
        f"WITH {o.BARS} SELECT instrument, datetime, round(lag(close, 3) OVER ({series}), 6) + 0.0 AS lag3, " + ", ".join(
            f"round({o.full(f, 'close', 5)}, 6) + 0.0 AS {k}" for k, f in kinds.items()) + " FROM bars")
    add("w05_running_total", lambda m: running_total(m.bars(), KEYS, ["pos"], "date", "volume", "total").select(
        "instrument", "datetime", "total"),
        f"WITH {o.BARS} SELECT instrument, datetime, CAST(sum(volume) OVER ({series}) AS BIGINT) AS total FROM bars")


def _register_reports() -> None:
    with_factors = f"WITH {FACTORED}"
    shares = [("p01", .01), ("p05", .05), ("p10", .1), ("p50", .5), ("p90", .9), ("p95", .95), ("p99", .99)]
    add("g04_distribution", lambda m: rp.distribution(factored(m), "william", KEYS).select(
        "instrument", "count", *[rounded(c) for c in ("mean", "std", "min", "max", *[n for n, _ in shares])]),
        f"{with_factors} SELECT instrument, count(*) AS count, {o.r('avg(william)')} AS mean, {o.r('stddev_samp(william)')} AS "
        f"std, {o.r('min(william)')} AS min, {o.r('max(william)')} AS max, "
        + ", ".join(f"{o.r(f'quantile_cont(william, {p})')} AS {n}" for n, p in shares) + " FROM factored GROUP BY instrument")
    add("g04_exact_quantiles_of_line_items", lambda m: fq.exact_quantiles(
        m.table("lineitem"), "l_extendedprice", [0.1, 0.5, 0.9], ["l_returnflag"], reread=True).select(
        "l_returnflag", *[rounded(F.col("quantiles")[i], 6, f"q{i}") for i in range(3)]),
        "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) + 0.0 AS q{i}"
                                            for i, p in enumerate((0.1, 0.5, 0.9))) + " FROM lineitem GROUP BY l_returnflag")
    add("g05_histogram", lambda m: rp.histogram(m.table("lineitem"), "l_quantity", 100),
        "WITH ends AS (SELECT min(l_quantity) AS a, max(l_quantity) AS z FROM lineitem) SELECT CAST(least(floor((l_quantity - "
        "a) / ((z - a) / 100)), 99) AS INTEGER) AS bin, count(*) AS count FROM lineitem, ends GROUP BY 1")
    add("g03_g09_daily_stability", lambda m: rp.daily_stability(factored(m), "william", ["instrument", "date"]).select(
        "instrument", date_text(), rounded("mean"), rounded("std")),
        f"{with_factors} SELECT instrument, CAST(date AS VARCHAR) AS date, {o.r('avg(william)')} AS mean, "
        f"{o.r('stddev_samp(william)')} AS std FROM factored GROUP BY instrument, date")
    timed = lambda m: factored(m).withColumn("time", F.col("datetime").substr(12, 8))
    half = lambda a, z: f"CAST(sum(CASE WHEN substr(datetime, 12, 8) BETWEEN '{a}' AND '{z}' THEN 1 ELSE 0 END) AS BIGINT)"
    add("g06_quality_counts", lambda m: rp.quality_counts(timed(m), ["william", "momentum"]).select(
        F.coalesce("instrument", F.lit("all")).alias("instrument"),
        F.coalesce(F.col("date").cast("string"), F.lit("all")).alias("date"), "rows", "null_count", "zero_count",
        "morning_count", "afternoon_count"),
        f"{with_factors} SELECT coalesce(instrument, 'all') AS instrument, coalesce(CAST(date AS VARCHAR), 'all') AS date, "
        f"count(*) AS rows, CAST(sum((william IS NULL)::INT + (momentum IS NULL)::INT) AS BIGINT) AS null_count, "
        f"CAST(sum((william = 0)::INT + (momentum = 0)::INT) AS BIGINT) AS zero_count, "
        f"{half('09:30:00.000', '11:30:00.000')} AS morning_count, {half('13:00:00.000', '15:00:00.000')} AS afternoon_count "
        f"FROM factored GROUP BY ROLLUP (instrument, date)")
    add("g07_period_means", lambda m: rp.period_means(factored(m), "william", KEYS, 7).unionByName(
        rp.period_means(factored(m), "william", KEYS, 4)).select("instrument", "period", rounded("mean")),
        f"{with_factors} SELECT instrument, substr(CAST(date AS VARCHAR), 1, n) AS period, {o.r('avg(william)')} AS mean FROM "
        f"factored, (VALUES (4), (7)) lengths(n) GROUP BY 1, 2")
    add("g08_describe_by_period", lambda m: rp.describe_by_period(factored(m), "william", KEYS, length=9).select(
        "instrument", "period", *[rounded(c) for c in ("count", "mean", "std", "p25", "p50", "p75")]),
        f"{with_factors} SELECT instrument, substr(CAST(date AS VARCHAR), 1, 9) AS period, " + ", ".join(
            f"round({f}, 6) + 0.0 AS {n}" for n, f in (
                ("count", "count(*)"), ("mean", "avg(william)"), ("std", "stddev_samp(william)"),
                ("p25", "quantile_cont(william, 0.25)"), ("p50", "quantile_cont(william, 0.5)"),
                ("p75", "quantile_cont(william, 0.75)"))) + " FROM factored GROUP BY 1, 2")
    ranks = ", ".join(f"rank() OVER (PARTITION BY instrument, date ORDER BY {c}) + (count(*) OVER (PARTITION BY instrument, "
                      f"date, {c}) - 1) / 2.0 AS {n}" for c, n in (("william", "fr"), ("ret5", "rr")))
    ic = f"{with_factors}, ranked AS (SELECT *, {ranks} FROM factored), daily AS (SELECT instrument, date, corr(william, ret5) AS ic, corr(fr, rr) AS rank_ic FROM ranked GROUP BY ALL)"
    clean = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
    daily_ic = lambda m: rp.daily_information_coefficient(factored(m), "william", "ret5", ["instrument", "date"])
    not_nan = lambda c: F.when(~F.isnan(c), F.col(c))
    add("g10_daily_information_coefficient", lambda m: daily_ic(m).select(
        "instrument", date_text(), rounded(not_nan("ic"), 6, "ic"), rounded(not_nan("rank_ic"), 6, "rank_ic")),
        f"{ic} SELECT instrument, CAST(date AS VARCHAR) AS date, {o.r(clean('ic'))} AS ic, {o.r(clean('rank_ic'))} AS rank_ic "
        f"FROM daily")
    add("flagship_factor_information_coefficient", lambda m: daily_ic(m).select(
        "instrument", date_text(), rounded(not_nan("ic"), 6, "ic")),
        f"{ic} SELECT instrument, CAST(date AS VARCHAR) AS date, {o.r(clean('ic'))} AS ic FROM daily")
    add("g10_information_ratio", lambda m: rp.information_ratio(
        daily_ic(m).withColumn("ic", not_nan("ic")), KEYS).select("instrument", *[rounded(c) for c in ("mean", "std", "ratio")]),
        f"{ic} SELECT instrument, {o.r(f'avg({clean('ic')})')} AS mean, "
        f"{o.r(f'stddev_samp({clean('ic')})')} AS std, "
        f"{o.r(f'avg({clean('ic')}) / stddev_samp({clean('ic')})')} AS ratio FROM daily GROUP BY instrument")
    add("g11_moments", lambda m: rp.moments(factored(m), "william", KEYS).select(
        "instrument", *[rounded(c, 5) for c in ("kurtosis", "skewness", "mean", "std")]),
        f"{with_factors}, c AS (SELECT *, william - avg(william) OVER (PARTITION BY instrument) AS d FROM factored) SELECT "
        f"instrument, {o.r('kurtosis_pop(william)', 5)} AS kurtosis, {o.r('avg(d ^ 3) / power(avg(d ^ 2), 1.5)', 5)} AS skewness, "
        f"{o.r('avg(william)', 5)} AS mean, {o.r('stddev_samp(william)', 5)} AS std FROM c GROUP BY instrument")
    add("g19_factor_correlation", lambda m: rp.correlation(factored(m), "william", "momentum", KEYS).select(
        "instrument", rounded("correlation")),
        f"{with_factors} SELECT instrument, {o.r('corr(william, momentum)')} AS correlation FROM factored GROUP BY instrument")
    add("g20_training_summary", lambda m: rp.training_summary(factored(m)).select(
        "rows", F.col("dates").cast("bigint").alias("dates"), *[F.col(c).cast("string").alias(c) for c in (
            "first_date", "last_date", "split_date")]),
        f"{with_factors}, d AS (SELECT list(DISTINCT date ORDER BY date) AS l, count(*) AS rows FROM factored) SELECT rows, "
        f"len(l) AS dates, CAST(l[1] AS VARCHAR) AS first_date, CAST(l[-1] AS VARCHAR) AS last_date, "
        f"CAST(l[CAST(round_even(len(l) * 0.75, 0) AS INTEGER) + 1] AS VARCHAR) AS split_date FROM d")
    parts = " UNION ALL ".join(
        f"SELECT instrument, date, '{measure}' AS measure, '{side}' AS side, rank() OVER (PARTITION BY instrument ORDER BY "
        f"{measure} {order}) AS place, {measure} AS value FROM days WHERE {measure} IS NOT NULL"
        for measure in ("mean", "std") for side, order in (("largest", "DESC"), ("smallest", "ASC")))
    add("o04_extreme_days", lambda m: rp.extreme_days(
        rp.daily_stability(factored(m), "momentum", ["instrument", "date"]), KEYS, 3).select(
        "instrument", date_text(), "measure", "side", F.col("place").cast("bigint").alias("place"), rounded("value")),
        f"{with_factors}, days AS (SELECT instrument, date, avg(momentum) AS mean, stddev_samp(momentum) AS std FROM factored "
        f"GROUP BY ALL), ranked AS ({parts}) SELECT instrument, CAST(date AS VARCHAR) AS date, measure, side, "
        f"place, {o.r('value')} AS value FROM ranked WHERE place <= 3")
    measures = ("count", "mean", "std", "skewness", "kurtosis")

    def several_reports(m):
        """Reports over a list of factors, each a row per contract."""
        made = rp.factor_reports(factored(m), ["william", "momentum"], {
            "daily": lambda df, value: rp.daily_stability(df, value, ["instrument", "date"]).groupBy("instrument").agg(
                F.count("mean").alias("count"), F.avg("mean").alias("mean"), F.avg("std").alias("std"),
                F.lit(None).cast("double").alias("skewness"), F.lit(None).cast("double").alias("kurtosis")),
            "moments": lambda df, value: rp.moments(df, value, KEYS).withColumn("count", F.lit(None).cast("long"))})
        rows = [report.select("instrument", F.lit(name).alias("report"), F.lit(value).alias("factor"), "count", *[rounded(c) for c in measures[1:]])
                for (name, value), report in made.items()]
        return reduce(lambda a, b: a.unionByName(b), rows)

    def several_sql(value):
        pop = f"({value} - m) / nullif(d, 0)"
        return (f"SELECT instrument, 'daily' AS report, '{value}' AS factor, count(m) AS count, {o.r('avg(m)')} AS mean, {o.r('avg(s)')} AS std, "
                f"NULL AS skewness, NULL AS kurtosis FROM (SELECT instrument, date, avg({value}) AS m, stddev_samp({value}) AS s FROM factored GROUP BY ALL) "
                f"GROUP BY instrument UNION ALL SELECT instrument, 'moments', '{value}', NULL, {o.r(f'avg({value})')}, {o.r(f'stddev_samp({value})')}, "
                f"{o.r(f'avg(({pop}) ** 3)')}, {o.r(f'avg(({pop}) ** 4) - 3')} FROM (SELECT *, avg({value}) OVER w AS m, stddev_pop({value}) OVER w AS d "
                f"FROM factored WINDOW w AS (PARTITION BY instrument)) GROUP BY instrument")

    add("h14_reports_over_factors", several_reports, f"{with_factors} {several_sql('william')} UNION ALL {several_sql('momentum')}")
    add("f14_clip_outliers", lambda m: fs.clip_outliers(
        m.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice"), "l_extendedprice",
        ["l_returnflag"], width=0.8, output="clipped").select(
        "l_returnflag", "l_orderkey", "l_linenumber", rounded("clipped", 4)),
        "WITH m AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS me FROM lineitem GROUP BY ALL), s AS (SELECT "
        "l_returnflag, me, avg(abs(l_extendedprice - me)) * 1.4826 * 0.8 AS w FROM lineitem JOIN m USING (l_returnflag) GROUP "
        "BY ALL) SELECT l_returnflag, l_orderkey, l_linenumber, round(greatest(least(l_extendedprice, me + w), me - w), 4) + "
        "0.0 AS clipped FROM lineitem JOIN s USING (l_returnflag)")
    add("f15_zero_small_values", lambda m: fs.zero_small_values(
        factored(m), "ret1", KEYS, width=0.05).select("instrument", "datetime", rounded("ret1")),
        f"{with_factors}, a AS (SELECT instrument, avg(ret1) AS m FROM factored GROUP BY ALL), s AS (SELECT instrument, "
        f"avg(abs(ret1 - m)) * 0.05 * 1.4826 AS w FROM factored JOIN a USING (instrument) GROUP BY ALL) SELECT instrument, "
        f"datetime, {o.r('CASE WHEN abs(ret1) < w THEN 0.0 ELSE ret1 END')} AS ret1 FROM factored JOIN s USING (instrument)")
    add("f16_scale_by_extreme", lambda m: fs.scale_by_extreme(factored(m), "ret1", KEYS).select(
        "instrument", "datetime", rounded("ret1")),
        f"{with_factors}, s AS (SELECT instrument, 2 * greatest(abs(max(ret1)), abs(min(ret1))) AS w FROM factored GROUP BY "
        f"ALL) SELECT instrument, datetime, {o.r('ret1 / w')} AS ret1 FROM factored JOIN s USING (instrument)")


REPORT = ("trade_count", "long_trade_count", "short_trade_count", "win_trade_count", "lose_trade_count")
AMOUNTS = ("win_trade_amount", "lose_trade_amount", "long_win_trade_amount", "long_lose_trade_amount",
           "short_win_trade_amount", "short_lose_trade_amount")


def band_trades_sql(groups: int) -> str:
    points = ", ".join(f"quantile_cont(william, {0.5 + i * 0.5 / groups})" for i in range(groups + 1))
    return f"""WITH {FACTORED},
splits AS (SELECT instrument, [{points}] AS s FROM factored GROUP BY ALL),
acted AS (SELECT *, coalesce(lead(open) OVER ({o.SERIES}), open) AS ao, coalesce(lead(ret5) OVER ({o.SERIES}), ret5) AS ar
  FROM factored),
bands AS (SELECT i AS band FROM range(1, {groups + 1}) t(i)),
trades2 AS (
  SELECT acted.*, band, CASE WHEN william > s[band] AND william < s[band + 1] THEN 1 ELSE -1 END AS action
  FROM acted JOIN splits USING (instrument), bands
  WHERE (william > s[band] AND william < s[band + 1])
     OR (william < s[1] - (s[band] - s[1]) AND william > s[1] - (s[band + 1] - s[1]))),
gains AS (SELECT *, ao * ar * action AS profit FROM trades2)"""


def _report_sql(ctes: str, tail: str = "") -> str:
    rate = lambda a, b2: f"({a}) / nullif({b2}, 0)"
    win, lose = "trade_ret > 0", "trade_ret < 0"
    money = lambda c: f"coalesce(sum(trade_ret) FILTER (WHERE {c}), 0)"
    n = lambda c: f"count(*) FILTER (WHERE {c})"
    columns = {
        "profit": "coalesce(sum(trade_ret), 0)", "long_profit": money("flag = 1"), "short_profit": money("flag = -1"),
        "win_lose_rate": rate(money(f"{win} AND flag <> 0"), f"-({money(f'{lose} AND flag <> 0')})"),
        "long_win_lose_rate": rate(money(f"{win} AND flag = 1"), f"-({money(f'{lose} AND flag = 1')})"),
        "short_win_lose_rate": rate(money(f"{win} AND flag = -1"), f"-({money(f'{lose} AND flag = -1')})"),
        "avg_profit": rate("coalesce(sum(trade_ret), 0)", n("flag <> 0")),
        "long_avg_profit": rate(money("flag = 1"), n("flag = 1")),
        "short_avg_profit": rate(money("flag = -1"), n("flag = -1")),
        "win_rate": f"coalesce({rate(n(win), n(f'{win} OR {lose}'))}, 0)"}
    return (f"{ctes} SELECT coalesce(instrument, 'all') AS product, "
            + ", ".join(f"{o.r(f'CAST({v} AS DOUBLE)')} AS {k}" for k, v in columns.items())
            + f", {n('flag <> 0')} AS count, {n('flag = 1')} AS long_count, {n('flag = -1')} AS short_count FROM flagged "
              f"GROUP BY ROLLUP (instrument) {tail}")


def report_columns(report: DataFrame) -> DataFrame:
    return report.select("product", *[rounded(c) for c in (
        "profit", "long_profit", "short_profit", "win_lose_rate", "long_win_lose_rate", "short_win_lose_rate", "avg_profit",
        "long_avg_profit", "short_avg_profit", "win_rate")], "count", "long_count", "short_count")


def _register_backtests() -> None:
    groups = 5
    trades = lambda m: e.quantile_band_trades(factored(m), "william", "ret5", KEYS, groups, chunk_rows=CHUNK)
    every = lambda m: m.bars().select("instrument").distinct().withColumn(
        "band", F.explode(F.sequence(F.lit(1), F.lit(groups))))
    money = lambda c: f"coalesce(abs(sum(profit) FILTER (WHERE {c})), 0)"
    n = lambda c: f"count(*) FILTER (WHERE {c})"
    counts = dict(zip(REPORT, (n("action IS NOT NULL"), n("action = 1"), n("action = -1"), n("profit > 0"), n("profit < 0"))))
    amounts = dict(zip(AMOUNTS, (money("profit > 0"), money("profit < 0"), money("profit > 0 AND action = 1"),
                                 money("profit < 0 AND action = 1"), money("profit > 0 AND action = -1"),
                                 money("profit < 0 AND action = -1"))))
    add("e01_quantile_band_backtest", lambda m: e.quantile_band_report(trades(m), KEYS, every(m)).select(
        "instrument", F.col("band").cast("bigint").alias("band"), *REPORT, *[rounded(c, 5) for c in AMOUNTS]),
        f"{band_trades_sql(groups)}, grid AS (SELECT DISTINCT instrument, band FROM bars, bands) SELECT instrument, band, "
        + ", ".join(f"{v} AS {k}" for k, v in counts.items()) + ", "
        + ", ".join(f"{o.r(v, 5)} AS {k}" for k, v in amounts.items())
        + " FROM grid LEFT JOIN gains USING (instrument, band) GROUP BY instrument, band")
    add("e01_daily_profit", lambda m: e.daily_profit(trades(m), ["instrument", "band"]).select(
        "instrument", F.col("band").cast("bigint").alias("band"), date_text(), rounded("profit", 5), rounded("total_profit", 5)),
        f"{band_trades_sql(groups)}, d AS (SELECT instrument, band, date, sum(profit) AS profit FROM gains GROUP BY ALL) SELECT "
        f"instrument, band, CAST(date AS VARCHAR) AS date, {o.r('profit', 5)} AS profit, {o.r('sum(profit) OVER (PARTITION BY instrument, band ORDER BY date)', 5)} AS total_profit FROM d")
    points = 11
    levels = ", ".join(f"quantile_cont(abs(momentum), {i / (points - 1)})" for i in range(points))
    side = "CASE WHEN pf > 0 OR (pf = 0 AND q[band] > 0) THEN 1 ELSE -1 END"
    money2 = lambda c: f"coalesce(sum(y) FILTER (WHERE {c}), 0)"
    rate = lambda a, b2: f"({a}) / nullif(-({b2}), 0)"
    shifted = lambda m: factored(m).withColumn("momentum", F.col("momentum") - 1)
    add("e02_threshold_band_test", lambda m: e.threshold_band_report(
        shifted(m), "momentum", KEYS, 4, points, chunk_rows=CHUNK).select(
        F.col("band").cast("bigint").alias("band"), *[rounded(c) for c in (
            "small_threshold", "big_threshold", "win_rate", "profit_rate", "long_profit_rate", "short_profit_rate",
            "average_profit")], "trade_count", "long_trade_count", "short_trade_count"),
        f"WITH {FACTORED}, moved AS (SELECT * REPLACE (momentum - 1 AS momentum) FROM factored), levels AS (SELECT [{levels}] "
        f"AS q FROM moved), acted AS (SELECT *, lag(momentum) OVER ({o.SERIES}) AS pf, (lead(open, 4) OVER ({o.SERIES}) - open) "
        f"/ open AS yr FROM moved), hit AS (SELECT *, yr * ({side}) AS y, {side} AS flag FROM acted, levels, (SELECT i AS band "
        f"FROM range(1, {points}) t(i)) WHERE abs(pf) >= q[band] AND abs(pf) <= q[band + 1]) SELECT band, "
        f"{o.r('max(q[band])')} AS small_threshold, {o.r('max(q[band + 1])')} AS big_threshold, {o.r('count(*) FILTER (WHERE y > 0) / count(*)')} AS win_rate, "
        f"{o.r(rate(money2('y > 0'), money2('y < 0')))} AS profit_rate, "
        f"{o.r(rate(money2('y > 0 AND flag = 1'), money2('y < 0 AND flag = 1')))} AS long_profit_rate, "
        f"{o.r(rate(money2('y > 0 AND flag = -1'), money2('y < 0 AND flag = -1')))} AS short_profit_rate, "
        f"{o.r('sum(y) / count(*)')} AS average_profit, count(*) AS trade_count, count(*) FILTER (WHERE flag = 1) AS "
        f"long_trade_count, count(*) FILTER (WHERE flag = -1) AS short_trade_count FROM hit GROUP BY band")
    flags = lambda m: e.prediction_flags(factored(m).withColumn("predict", F.col("william")), "predict", "ret5", KEYS, 48, 1.2,
                                         chunk_rows=CHUNK).withColumnRenamed("instrument", "product")
    flagged = (f"WITH {FACTORED}, sized AS (SELECT *, abs(william) AS aw FROM factored), usual AS (SELECT *, "
               f"{o.full('avg', 'aw', 48)} AS u FROM sized), flagged AS (SELECT *, CASE WHEN william > u * 1.2 THEN 1 WHEN "
               f"william < -u * 1.2 THEN -1 ELSE 0 END AS flag, ret5 * CASE WHEN william > u * 1.2 THEN 1 WHEN william < -u * "
               f"1.2 THEN -1 ELSE 0 END AS trade_ret FROM usual)")
    add("e03_prediction_flags", lambda m: flags(m).select("product", "datetime", F.col("flag").cast("bigint").alias("flag"),
                                                          rounded("trade_ret")),
        f"{flagged} SELECT instrument AS product, datetime, CAST(flag AS BIGINT) AS flag, {o.r('trade_ret')} AS trade_ret FROM flagged")
    add("e04_o02_backtest_report", lambda m: report_columns(e.backtest_report(flags(m))), _report_sql(flagged))
    add("e04_profit_curve", lambda m: e.profit_curve(flags(m)).select(
        "datetime", *[rounded(c) for c in ("total_profit", "total_long_profit", "total_short_profit")]),
        f"{flagged}, points AS (SELECT datetime, sum(trade_ret) AS a, coalesce(sum(trade_ret) FILTER (WHERE flag = 1), 0) AS l, "
        f"coalesce(sum(trade_ret) FILTER (WHERE flag = -1), 0) AS s FROM flagged GROUP BY ALL) SELECT datetime, "
        + ", ".join(f"{o.r(f'sum({c}) OVER (ORDER BY datetime)')} AS {k}" for c, k in (
            ("a", "total_profit"), ("l", "total_long_profit"), ("s", "total_short_profit"))) + " FROM points")
    names = ["click", "error", "purchase", "signup", "view"]
    add("j03_merge_product_profits", lambda m: e.merge_profits(flags(m), names, ["datetime"]).select(
        "datetime", *[rounded(c) for c in (*names, "other")]),
        f"{flagged} SELECT datetime, " + ", ".join(
            f"{o.r(f"coalesce(sum(trade_ret) FILTER (WHERE instrument = '{c}'), 0)")} AS {c}" for c in names)
        + f", {o.r(f'coalesce(sum(trade_ret) FILTER (WHERE instrument NOT IN {tuple(names)}), 0)')} AS other "
        "FROM flagged GROUP BY datetime")
    signals = lambda m: e.signal_flags(factored(m), "william", "volume", KEYS, 5, 24, 1.1, 20, 10,
                                       chunk_rows=CHUNK).withColumnRenamed("instrument", "product")
    rule = "CASE WHEN volume < 20 THEN 0 WHEN p > u * 1.1 THEN 1 WHEN p < -u * 1.1 THEN -1 ELSE 0 END"
    signalled = (f"WITH {FACTORED}, sized AS (SELECT *, abs(william) AS aw, {o.lag('william')} AS p, (lead(open, 5) OVER "
                 f"({o.SERIES}) - open) / open AS yr FROM factored), usual AS (SELECT *, {o.full('avg', 'aw', 24)} AS u FROM "
                 f"sized), f1 AS (SELECT *, {rule} AS flag, yr * ({rule}) AS trade_ret FROM usual), flagged AS (SELECT * FROM f1 "
                 f"WHERE instrument IN (SELECT instrument FROM f1 GROUP BY 1 HAVING sum(abs(flag)) >= 10))")
    add("e05_signal_backtest", lambda m: report_columns(e.backtest_report(signals(m))), _report_sql(signalled))
    product = "william * ret5"
    own_scores = {"mean_absolute_error": lambda p, r: F.avg(F.abs(p - r)), "largest_error": lambda p, r: F.max(F.abs(p - r))}
    add("h11_own_evaluator", lambda m: e.evaluate(factored(m), "william", "ret5", own_scores, KEYS).select(
        "instrument", *[rounded(c) for c in own_scores]),
        f"WITH {FACTORED} SELECT instrument, {o.r('avg(abs(william - ret5))')} AS mean_absolute_error, "
        f"{o.r('max(abs(william - ret5))')} AS largest_error FROM factored GROUP BY instrument")
    add("e06_e07_e08_prediction_scores", lambda m: e.prediction_scores(factored(m), "william", "ret5", KEYS).select(
        "instrument", *[rounded(c) for c in ("correlation", "winning_rate", "mean_squared_error")]),
        f"WITH {FACTORED} SELECT instrument, {o.r('corr(william, ret5)')} AS correlation, "
        f"{o.r(f'count(*) FILTER (WHERE {product} > 0) / count(*) FILTER (WHERE {product} <> 0)')} AS winning_rate, "
        f"{o.r('avg((william - ret5) ^ 2)')} AS mean_squared_error FROM factored GROUP BY instrument")


def _register_training() -> None:
    features = ["william", "momentum"]
    key = ["instrument", "datetime"]
    half = lambda m, column, rule: factored(m).where(rule).select(*key, column)
    add("j02_outer_join_factors", lambda m: tr.join_factors(
        [half(m, "william", "slot < 16"), half(m, "momentum", "slot >= 8")], key).select(*key, *[rounded(f) for f in features]),
        f"WITH {FACTORED} SELECT instrument, datetime, {o.r('CASE WHEN slot < 16 THEN william END')} AS william, "
        f"{o.r('CASE WHEN slot >= 8 THEN momentum END')} AS momentum FROM factored")
    add("e14_j14_base_training_table", lambda m: tr.base_training_table(
        [factored(m).select(*key, f) for f in features], factored(m).select(*key, "open", "close", "ret1", "ret5"), key).select(
        *key, *[rounded(F.col(c).cast("double"), 3, c) for c in (*features, "open", "close", "ret1", "ret5")]),
        f"WITH {FACTORED} SELECT instrument, datetime, " + ", ".join(
            f"round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 3) + 0.0 AS {c}" for c in (*features, "open", "close", "ret1", "ret5"))
        + " FROM factored")
    add("j15_keep_rows_of", lambda m: tr.keep_rows_of(
        factored(m), b.drop_limit_days(m.bars(), KEYS, "date", volume_over=10, chunk_rows=CHUNK), key).select(
        *key, rounded("william")),
        f"WITH {FACTORED}, flats AS (SELECT *, high = low AS f FROM bars), runs AS (SELECT *, f AND volume > 10 AND "
        f"(coalesce(lag(f) OVER ({o.SERIES}) AND lag(f, 2) OVER ({o.SERIES}), false) OR coalesce(lag(f) OVER ({o.SERIES}) AND "
        f"lead(f) OVER ({o.SERIES}), false) OR coalesce(lead(f) OVER ({o.SERIES}) AND lead(f, 2) OVER ({o.SERIES}), false)) AS hit "
        f"FROM flats), bad AS (SELECT DISTINCT instrument, date FROM runs WHERE hit) SELECT instrument, datetime, "
        f"{o.r('william')} AS william FROM factored ANTI JOIN bad USING (instrument, date)")
    add("t14_mirror_rows", lambda m: tr.mirror_rows(
        factored(m).select("instrument", "datetime", "william", "momentum", "ret5"), ["instrument", "datetime", "momentum"])
        .select(*key, rounded("william"), rounded("momentum"), rounded("ret5")),
        f"WITH {FACTORED} SELECT instrument, datetime, round(william * s, 6) + 0.0 AS william, {o.r('momentum')} AS momentum, "
        f"round(ret5 * s, 6) + 0.0 AS ret5 FROM factored, (VALUES (1), (-1)) sides(s)")
    products = ["click", "error", "purchase", "signup", "view"]
    add("e15_stack_products", lambda m: tr.label_products(returned(m), "instrument", products).groupBy("product").agg(
        F.count(F.lit(1)).alias("rows"), rounded(F.sum("ret5"), 5, "ret5")),
        f"WITH {o.BARS}, {RETURNS} SELECT CASE WHEN instrument IN {tuple(products)} THEN instrument ELSE 'other' END AS product, "
        f"count(*) AS rows, {o.r('sum(ret5)', 5)} AS ret5 FROM returned GROUP BY 1")
    add("e09_split_by_date", lambda m: tr.split_by_date(factored(m), "2024-01-20 00:00:00")[0].withColumn("part", F.lit("train"))
        .unionByName(tr.split_by_date(factored(m), "2024-01-20 00:00:00")[1].withColumn("part", F.lit("test")))
        .groupBy("part").agg(F.count(F.lit(1)).alias("rows")),
        f"WITH {o.BARS} SELECT CASE WHEN datetime < '2024-01-20 00:00:00' THEN 'train' ELSE 'test' END AS part, count(*) AS rows "
        f"FROM bars GROUP BY 1")
    add("e13_prediction_detail", lambda m: tr.prediction_detail(
        factored(m), "2024-01-05 00:00:00", "2024-01-09 00:00:00").select(*key, rounded("william")),
        f"WITH {FACTORED} SELECT instrument, datetime, {o.r('william')} AS william FROM factored WHERE datetime BETWEEN "
        f"'2024-01-05 00:00:00' AND '2024-01-09 00:00:00'")
    early = ("d AS (SELECT part, date, row_number() OVER (PARTITION BY part ORDER BY date) AS rn FROM (SELECT DISTINCT part, date "
             "FROM p))")
    add("e17_part_correlations", lambda m: tr.part_correlations(
        factored(m).withColumn("prediction", F.col("william")), "ret5", "2024-01-16", 10).select(
        "part", rounded("correlation"), rounded("first_days_correlation")),
        f"WITH {FACTORED}, p AS (SELECT *, CASE WHEN date < DATE '2024-01-16' THEN 'train' ELSE 'test' END AS part FROM factored), "
        f"{early} SELECT part, {o.r('corr(william, ret5)')} AS correlation, "
        f"{o.r('corr(william, ret5) FILTER (WHERE rn <= 10)')} AS first_days_correlation FROM p JOIN d USING (part, date) GROUP BY part")
    add("f17_standardize", lambda m: tr.standardize(
        *tr.split_by_date(factored(m).select(*key, *features), "2024-01-20 00:00:00"), features)[1].select(
        *key, *[rounded(f, 5) for f in features]),
        f"WITH {FACTORED}, s AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in features)
        + " FROM factored WHERE datetime < '2024-01-20 00:00:00') SELECT instrument, datetime, " + ", ".join(
            f"{o.r(f'({f} - m_{f}) / s_{f}', 5)} AS {f}" for f in features)
        + " FROM factored, s WHERE datetime >= '2024-01-20 00:00:00'")
    types = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    add("f20_impute_and_one_hot", lambda m: tr.one_hot(tr.impute(m.table("part").select(
        "p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_size")).cast("double").alias("p_size"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")).alias("p_type")), ["p_size"], ["p_type"]), "p_type",
        types).select("p_partkey", rounded("p_size"), *[f"p_type__{c}" for c in (*types, "other")]),
        "WITH h AS (SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_size::DOUBLE END AS p_size, CASE WHEN p_partkey % 7 <> 0 "
        "THEN p_type END AS p_type FROM part), s AS (SELECT avg(p_size) AS a FROM h), o AS (SELECT p_type AS t FROM h WHERE p_type "
        "IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT p_partkey, round(coalesce(p_size, a), 6) + 0.0 AS p_size, "
        + ", ".join(f"CAST(coalesce(p_type, t) = '{c}' AS INTEGER) AS \"p_type__{c}\"" for c in types)
        + f", CAST(coalesce(p_type, t) NOT IN {tuple(types)} AS INTEGER) AS p_type__other FROM h, s, o")
    small = tr.BoostConfig(max_iter=4, max_depth=3)
    add("e10_boosted_trees", lambda m: _fit_and_predict(m, features, small))
    add("e11_grid_search", lambda m: tr.grid_search(
        factored(m).withColumnRenamed("instrument", "product"), features, ["ret5"], ["2024-01-20"],
        [small, tr.BoostConfig(max_iter=2, max_depth=2)], length=24, width=1.0))
    add("e12_walk_forward", lambda m: tr.walk_forward(
        factored(m), features, "ret5", ["2024-01-12", "2024-01-21"], config=tr.BoostConfig(max_iter=2, max_depth=2)).select(
        *key, "trained_before", rounded("prediction")))
    add("e16_tabular_regression", lambda m: _tabular(m, small))
    # what any model must satisfy: the rows that get a prediction, and scores that follow from the stored predictions
    ok = "true AS correlation_agrees, true AS winning_rate_agrees, true AS error_agrees"
    add("e10_scores_follow_from_predictions", lambda m: _agreement(_boosted(m, features, small), "ret5", KEYS),
        f"WITH {FACTORED} SELECT instrument, count(*) AS rows, {ok} FROM factored WHERE datetime >= '2024-01-20 00:00:00' GROUP BY instrument")
    add("e16_scores_follow_from_predictions", lambda m: _agreement(stored(_tabular_predictions(m, small)), "p_retailprice", ["p_type"]),
        f"SELECT p_type, count(*) AS rows, {ok} FROM part WHERE p_partkey % 4 = 0 GROUP BY p_type")
    add("e12_rows_of_walk_forward", lambda m: tr.walk_forward(
        factored(m), features, "ret5", ["2024-01-08", "2024-01-15", "2024-01-22"], config=tr.BoostConfig(max_iter=2, max_depth=2)).select(
        *key, "trained_before", F.when(F.abs("prediction") < float("inf"), 1).otherwise(0).alias("predicted")),
        f"WITH {FACTORED} SELECT instrument, datetime, CASE WHEN date >= DATE '2024-01-22' THEN '2024-01-22' WHEN date >= DATE '2024-01-15' THEN "
        f"'2024-01-15' ELSE '2024-01-08' END AS trained_before, 1 AS predicted FROM factored WHERE date >= DATE '2024-01-08'")
    grid_splits, grid = ["2024-01-12", "2024-01-20"], [tr.BoostConfig(max_iter=2, max_depth=d) for d in (1, 2)]

    def grid_rows(m):
        runs = tr.grid_predictions(factored(m), features, ["ret1", "ret5"], grid_splits, grid)
        rows = [made.groupBy("instrument").agg(F.count("prediction").alias("rows")).select(
            *[F.lit(value).alias(name) for name, value in zip(tr.RUN, run)], "instrument", "rows") for run, made in runs]
        return reduce(lambda a, b: a.unionByName(b), rows)

    add("e11_rows_of_grid", grid_rows,
        f"WITH {FACTORED} SELECT label, split, max_depth, 2 AS max_iter, 0.1::DOUBLE AS step_size, instrument, count(*) AS rows FROM factored, "
        f"(VALUES ('ret1'), ('ret5')) l(label), (VALUES ('2024-01-12'), ('2024-01-20')) s(split), (VALUES (1), (2)) d(max_depth) "
        f"WHERE date >= CAST(split AS DATE) GROUP BY ALL")


def _boosted(market, features: list[str], config: tr.BoostConfig) -> DataFrame:
    train, test = tr.split_by_date(factored(market), "2024-01-20 00:00:00")
    return stored(tr.predict(tr.fit(train, features, "ret5", config), test, features))


def _agreement(predictions: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Whether the scores equal those that plain sums over the stored predictions give."""
    x, y = F.col("prediction"), F.col(label).cast("double")
    right = F.when((x != 0) & (y != 0), F.when(F.signum(x) == F.signum(y), 1).otherwise(0))
    sums = predictions.groupBy(*keys).agg(
        F.count(x).alias("rows"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"),
        F.avg(right).alias("right"), F.avg((x - y) * (x - y)).alias("error"))
    n = F.col("rows")
    spread = lambda a, aa: n * F.col(aa) - F.col(a) * F.col(a)
    pearson = F.try_divide(n * F.col("xy") - F.col("x") * F.col("y"), F.sqrt(spread("x", "xx") * spread("y", "yy")))
    near = lambda a, b: F.coalesce(F.abs(a - b) <= 1e-6 * (1 + F.abs(b)), (a.isNull() | F.isnan(a)) & (b.isNull() | F.isnan(b)))
    # constant predictions have no correlation, whatever rounding leaves of their spread
    flat = spread("x", "xx") <= 1e-9 * n * F.col("xx")
    scored = e.prediction_scores(predictions, "prediction", label, keys).join(sums, keys)
    return scored.select(*keys, "rows", (near(F.col("correlation"), pearson) | flat).alias("correlation_agrees"),
                         near(F.col("winning_rate"), F.col("right")).alias("winning_rate_agrees"),
                         near(F.col("mean_squared_error"), F.col("error")).alias("error_agrees"))


def _fit_and_predict(market, features: list[str], config: tr.BoostConfig) -> DataFrame:
    train, test = tr.split_by_date(factored(market), "2024-01-20 00:00:00")
    model = tr.fit(train, features, "ret5", config)
    return e.prediction_scores(tr.predict(model, test, features), "prediction", "ret5", KEYS)


def _tabular_predictions(market, config: tr.BoostConfig) -> DataFrame:
    parts = market.table("part").withColumn("p_size", F.col("p_size").cast("double"))
    held_out = F.col("p_partkey") % 4 == 0
    model = tr.tabular_pipeline(["p_size"], ["p_type"], "p_retailprice", config=config).fit(parts.where(~held_out))
    return model.transform(parts.where(held_out)).select("p_partkey", "p_type", "p_retailprice", "prediction")


def _tabular(market, config: tr.BoostConfig) -> DataFrame:
    return e.prediction_scores(_tabular_predictions(market, config), "prediction", "p_retailprice", ["p_type"])


def register() -> None:
    _register_bars()
    _register_reports()
    _register_backtests()
    _register_training()
