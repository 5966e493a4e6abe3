"""Queries of tick cleaning, quality rules and repairs, over stock ticks with planted defects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane import constants as K
from ticklane.operators import bars as bar_ops
from ticklane.operators import calendar as cal
from ticklane.operators import quality as q
from ticklane.operators import repair as x
from ticklane.operators import ticks as t
from ticklane.plans import oracle as o
from ticklane.plans.catalog import add, rounded

SHOWN = ["tscode", "date", "time", "tick_order", "price", "volume", "amount", "transaction_number"]
SHOWN_SQL = ("tscode, CAST(date AS VARCHAR) AS date, time, CAST(tick_order AS BIGINT) AS tick_order, "
             "round(price, 9) + 0.0 AS price, coalesce(CAST(volume AS BIGINT), -1) AS volume, round(amount, 4) + 0.0 AS amount, "
             "CAST(transaction_number AS BIGINT) AS transaction_number")
BOOK_SQL = ", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in ("bid_price1", "ask_price1", "bid_price3"))
KEYS_SQL = "tscode, CAST(date AS VARCHAR) AS date"


def shown(df: DataFrame, *more) -> DataFrame:
    return df.select("tscode", F.col("date").cast("string").alias("date"), "time",
                     F.col("tick_order").cast("bigint").alias("tick_order"), rounded("price", 9),
                     F.coalesce(F.col("volume").cast("bigint"), F.lit(-1)).alias("volume"), rounded("amount", 4),
                     F.col("transaction_number").cast("bigint").alias("transaction_number"), *more)


def _ticks(name: str, build: Callable, ctes: str, source: str, where: str = "", columns: str = SHOWN_SQL) -> None:
    add(name, lambda market: shown(build(market)), f"WITH {ctes} SELECT {columns} FROM {source} {where}")


def rule_sql() -> dict[str, str]:
    """Issue count of each rule over one (stock, date) group of the CTE ``flagged``."""
    at = lambda moment: f"count(CASE WHEN time = '{moment}' THEN 1 END)"
    some = lambda condition: f"count(CASE WHEN {condition} THEN 1 END)"
    flag = lambda condition: f"CASE WHEN {condition} THEN 1 ELSE 0 END"
    repeats = f"count(DISTINCT CASE WHEN {o.IN_SESSION} AND same_time > 1 THEN time END)"
    late = "time > '09:32:00.000'"
    closing = "time = '15:00:00.000' AND volume > 0"
    return {
        "incomplete_length": flag("count(*) < 25"),
        "volume_order": some("back"),
        "zero_price": some(f"price = 0 AND {late}"),
        "zero_ohlc": some(f"(open = 0 OR close = 0 OR high = 0 OR low = 0) AND {late}"),
        "organized_repeats": repeats,
        "noon_missing": flag(f"{at('11:30:00.000')} = 0"),
        "closing_auction_late": flag("coalesce(max(CASE WHEN volume > 0 THEN time END), '') > '15:00:00.000'"),
        "auction_duplicates": some("time >= '09:15:00.000' AND time < '09:25:00.000' AND same_time > 1"),
        "closing_duplicates": f"CASE WHEN {at('15:00:00.000')} > 1 THEN {some(closing)} ELSE 0 END",
        "time_missing": f"CASE WHEN count(*) = 1 THEN 0 WHEN {some('half = 1')} = 0 OR {some('half = 2')} = 0 THEN 1 "
                        f"ELSE {some('gap > 15')} END",
        "zero_transaction_number": some("time > first_number AND transaction_number = 0"),
        "volume_not_cleared": some("moved_volume = 0 AND volume > 0"),
        "repeat_records": repeats,
        "close_missing": flag(f"{at('15:00:00.000')} = 0 OR {at('11:30:00.000')} = 0"),
        "no_volume": flag(f"{some('volume = 0')}::DOUBLE / count(*) > 0.999"),
        "level_missing": some("level_missing"),
        "incomplete_day": flag("max(time) < '15:00:00.000'"),
        "always_fail": "1",
        "always_pass": "0",
    }


def _missing_level_sql() -> str:
    def side(name: str, bound: str) -> str:
        prices = "[" + ", ".join(f"{name}_price{i}" for i in o.LEVELS) + "]"
        n = f"len([p for p in {prices} if p <> 0])"
        return (f"CASE WHEN {n} < 10 THEN NOT abs((CASE WHEN {n} = 0 THEN price ELSE {prices}[{n}] END) - {bound}) < 0.001 "
                f"END")

    levels = " OR ".join(f"{s}_{f}{i} = 0" for s in ("bid", "ask") for f in ("price", "volume") for i in o.LEVELS)
    limit = ("(CASE WHEN (tscode LIKE '68%' OR tscode LIKE '300%') AND strftime(date, '%Y%m%d') >= '20200824' THEN 0.2 "
             "WHEN tscode LIKE '8%' THEN 0.3 ELSE 0.1 END)")
    return (f"(time < '14:57:00.000' AND time > '09:25:00.000' AND (time >= '13:00:00.000' OR time <= '11:30:00.000') "
            f"AND ({levels}) AND coalesce({side('bid', f'round(close * (1 - {limit}), 2)')}, "
            f"{side('ask', f'round(close * (1 + {limit}), 2)')}, true))")


def flagged_ctes() -> str:
    return o.RAW.strip() + f""",
halved AS (SELECT *, {o.tick_second()} AS s2, CASE WHEN time BETWEEN '09:30:00.000' AND '11:30:00.000' THEN 1
    WHEN time BETWEEN '13:00:00.000' AND '15:00:00.000' THEN 2 END AS half FROM raw),
flagged AS (
  SELECT *,
    lag(daily_accumulated_volume) OVER (PARTITION BY tscode, date ORDER BY time, daily_accumulated_volume)
      > daily_accumulated_volume AS back,
    daily_accumulated_volume - lag(daily_accumulated_volume) OVER ({o.ROWS}) AS moved_volume,
    count(*) OVER (PARTITION BY tscode, date, time) AS same_time,
    CASE WHEN half IS NOT NULL THEN s2 - lag(s2) OVER (PARTITION BY tscode, date, half ORDER BY time, tick_order) END AS gap,
    min(CASE WHEN transaction_number <> 0 THEN time END) OVER (PARTITION BY tscode, date) AS first_number,
    {_missing_level_sql()} AS level_missing
  FROM halved)"""


NUMBERS = {"v01": ["incomplete_length", "volume_order", "zero_price", "zero_ohlc"],
           "v02": ["organized_repeats", "noon_missing"], "v05": ["closing_auction_late"], "v06": ["auction_duplicates"],
           "v07": ["closing_duplicates"], "v08": ["time_missing"], "v09": ["zero_transaction_number"],
           "v10": ["volume_not_cleared"], "v11": ["repeat_records"], "v12": ["close_missing"], "v14": ["no_volume"],
           "v15": ["level_missing"], "v16": ["incomplete_day"], "v17": ["always_fail", "always_pass"]}
MINIMUM_ROWS = 25


def _validation_sql(rules: list[str], keep: str = "") -> str:
    known = rule_sql()
    tolerated = {"zero_transaction_number": 1}
    parts = [f"SELECT tscode, date, n, '{name}' AS rule, {name} AS issues, {tolerated.get(name, 0)} AS bound FROM counted"
             for name in rules]
    counts = ", ".join(f"CAST({known[name]} AS BIGINT) AS {name}" for name in rules)
    return (f"WITH {flagged_ctes()}, counted AS (SELECT tscode, date, count(*) AS n, {counts} FROM flagged GROUP BY ALL), "
            f"results AS ({' UNION ALL '.join(parts)}) "
            f"SELECT {KEYS_SQL}, rule, CAST(n AS BIGINT) AS record_count, issues AS issue_count, "
            f"CAST(CASE WHEN issues > bound THEN 1 ELSE 0 END AS INTEGER) AS result FROM results {keep}")


def results(df: DataFrame) -> DataFrame:
    return df.select("tscode", F.col("date").cast("string").alias("date"), "rule", "record_count", "issue_count", "result")


def _register_rules() -> None:
    for number, rules in NUMBERS.items():
        add(f"{number}_{rules[0]}", lambda market, rules=rules: results(
            q.validate_stock_ticks(market.raw_stock_ticks(), rules, minimum_rows=MINIMUM_ROWS)), _validation_sql(rules))
    every = [r for rules in NUMBERS.values() for r in rules]
    add("v19_validation_job", lambda market: q.validate_stock_ticks(
        market.raw_stock_ticks(), every, minimum_rows=MINIMUM_ROWS).groupBy("rule", "result").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("issue_count").alias("issues")),
        f"SELECT rule, result, count(*) AS groups, CAST(sum(issue_count) AS BIGINT) AS issues "
        f"FROM ({_validation_sql(every)}) GROUP BY rule, result")

    halted = lambda market: market.stock_ticks().where("volume > 40").select("tscode", "date").distinct()
    add("v01_suspended_stocks", lambda market: results(q.validate_stock_ticks(
        market.raw_stock_ticks(), ["zero_price"], halted(market))),
        f"WITH {flagged_ctes()}, counted AS (SELECT tscode, date, count(*) AS n, {rule_sql()['zero_price']} AS issues "
        f"FROM flagged GROUP BY ALL), halted AS (SELECT DISTINCT tscode, date, true AS h FROM ticks WHERE volume > 40) "
        f"SELECT {KEYS_SQL}, CASE WHEN h THEN 'suspended' ELSE 'zero_price' END AS rule, CAST(n AS BIGINT) AS record_count, "
        f"CAST(CASE WHEN h THEN 1 ELSE issues END AS BIGINT) AS issue_count, CAST(CASE WHEN h OR issues > 0 THEN 1 ELSE 0 "
        f"END AS INTEGER) AS result FROM counted LEFT JOIN halted USING (tscode, date)")

    def failed(market, rule):
        return q.validate_stock_ticks(market.stored_raw_ticks(), [rule]).where("result = 1")

    add("v22_recheck_failed_keys", lambda market: results(q.validate_stock_ticks(
        t.clean_stock_ticks(market.stored_raw_ticks().join(
            failed(market, "zero_price").hint("shuffle_hash"), ["tscode", "date"], "left_semi")),
        ["zero_price"])),
        f"WITH {o.CLEAN}, bad AS (SELECT tscode, date FROM raw GROUP BY ALL HAVING count(CASE WHEN price = 0 AND time > "
        f"'09:32:00.000' THEN 1 END) > 0), counted AS (SELECT tscode, date, count(*) AS n, count(CASE WHEN price = 0 AND "
        f"time > '09:32:00.000' THEN 1 END) AS issues FROM clean SEMI JOIN bad USING (tscode, date) GROUP BY ALL) "
        f"SELECT {KEYS_SQL}, 'zero_price' AS rule, n AS record_count, issues AS issue_count, "
        f"CAST(issues > 0 AS INTEGER) AS result FROM counted")
    add("v13_book_amounts_present", lambda market: market.stock_ticks().groupBy("date").agg(
        F.count(F.lit(1)).alias("record_count")).select(
        F.col("date").cast("string").alias("date"), "record_count",
        F.lit(0 if q.has_book_amounts(market.stock_ticks()) else 1).alias("result")),
        f"WITH {o.TICKS} SELECT CAST(date AS VARCHAR) AS date, count(*) AS record_count, 0 AS result FROM ticks GROUP BY ALL")
    gaps = ("gaps AS (SELECT instrument, date, datetime, lag(datetime) OVER (PARTITION BY instrument, date ORDER BY "
            "datetime) AS before FROM trades)")
    seconds = "date_diff('microsecond', before, datetime) / 1e6"
    add("v04_future_gaps", lambda market: q.future_gaps(market.future_ticks()).select(
        "instrument", F.col("date").cast("string").alias("date"), "record_count",
        F.col("issue_count").cast("bigint").alias("issue_count")),
        f"WITH {o.BARS}, {gaps} SELECT instrument, CAST(date AS VARCHAR) AS date, count(*) AS record_count, "
        f"count(CASE WHEN {seconds} > 300 AND {seconds} < 5400 THEN 1 END) AS issue_count FROM gaps GROUP BY ALL")
    expected = lambda market: cal.expand_intervals(market.constituents(), market.stock_dates())
    add("v20_missing_stocks", lambda market: q.missing_stocks(
        expected(market), market.stock_ticks().where("volume > 0")).select(
        "product", "tscode", F.col("date").cast("string").alias("date")),
        f"WITH {o.TICKS}, {o.MEMBERS}, days AS (SELECT DISTINCT date FROM ticks) SELECT product, c.tscode, "
        f"CAST(d.date AS VARCHAR) AS date FROM constituents c JOIN days d ON d.date BETWEEN start_date AND end_date "
        f"ANTI JOIN (SELECT DISTINCT tscode, date FROM ticks WHERE volume > 0) h ON h.tscode = c.tscode AND h.date = d.date")
    add("v21_content_differences", lambda market: q.content_differences(
        shown(t.clean_stock_ticks(market.stored_raw_ticks(), original=F.lit(True)), "_original")).groupBy(
        "surplus").agg(
        F.count(F.lit(1)).alias("rows")).select(F.col("surplus").cast("bigint").alias("surplus"), "rows"),
        f"WITH {o.CLEAN} SELECT 1 AS surplus, (SELECT count(*) FROM raw) - (SELECT count(*) FROM clean) AS rows")
    feeds = (f"target AS (SELECT instrument, date_trunc('second', datetime) AS datetime, arg_min(last_price, tick_id) AS p "
             f"FROM trades GROUP BY ALL), shifted AS (SELECT instrument, CASE WHEN extract('minute' FROM datetime) % 5 = 0 "
             f"THEN datetime + INTERVAL 500 MILLISECOND ELSE datetime END AS datetime, CASE WHEN p > 200 THEN p + 1 ELSE p "
             f"END AS p FROM target WHERE extract('minute' FROM datetime) % 7 <> 0)")
    add("v03_feed_reconciliation", lambda market: q.reconcile_report(_feeds(market), ["instrument"]),
        f"WITH {o.BARS}, {feeds}, near AS (SELECT t.instrument, t.p AS a, s.p AS b FROM target t FULL JOIN shifted s ON "
        f"t.instrument = s.instrument AND t.datetime = date_trunc('second', s.datetime)) SELECT coalesce(instrument, '') AS "
        f"instrument, count(a) AS target_count, count(b) AS compare_count, count(CASE WHEN a = b THEN 1 END) AS same_count, "
        f"count(CASE WHEN a <> b THEN 1 END) AS different_count, count(CASE WHEN b IS NULL THEN 1 END) AS "
        f"only_in_target_count, count(CASE WHEN a IS NULL THEN 1 END) AS only_in_compare_count FROM near GROUP BY ALL")
    add("v18_factor_close_records", lambda market: q.factor_close_records(
        t.clean_stock_ticks(market.raw_stock_ticks()), ["date"]).select(
        F.col("date").cast("string").alias("date"), "record_count", "result"),
        f"WITH {o.CLEAN} SELECT CAST(date AS VARCHAR) AS date, count(*) AS record_count, CAST(CASE WHEN count(CASE WHEN "
        f"time = '15:00:00.000' THEN 1 END) = 0 OR count(CASE WHEN time = '11:30:00.000' THEN 1 END) = 0 THEN 1 ELSE 0 END "
        f"AS INTEGER) AS result FROM clean GROUP BY ALL")


def _feeds(market) -> DataFrame:
    trades = market.future_ticks().withColumn("datetime", F.date_trunc("second", "datetime").cast("timestamp_ntz"))
    target = trades.groupBy("instrument", "datetime").agg(F.min_by("last_price", "tick_id").alias("last_price"))
    later = F.col("datetime") + F.expr("INTERVAL '0.5' SECOND")
    compare = target.where(F.minute("datetime") % 7 != 0).select(
        "instrument", F.when(F.minute("datetime") % 5 == 0, later).otherwise(F.col("datetime")).alias("datetime"),
        F.when(F.col("last_price") > 200, F.col("last_price") + 1).otherwise(F.col("last_price")).alias("last_price"))
    return q.reconcile_feeds(target, compare, ["instrument"], ["last_price"])


def _register_cleaning() -> None:
    _ticks("t01_clean_stock_ticks", lambda m: t.clean_stock_ticks(m.raw_stock_ticks()), o.CLEAN, "clean")
    _ticks("p04_session_filter", lambda m: m.raw_stock_ticks().where(t.in_session()), o.RAW, "raw", f"WHERE {o.IN_SESSION}")
    add("p08_swap_book_sides", lambda m: t.swap_book_sides(m.stock_ticks()).select(
        "tscode", F.col("date").cast("string").alias("date"), "time", rounded("bid_price1", 9), rounded("ask_price1", 9),
        F.col("total_bid_volume").cast("bigint").alias("total_bid_volume")),
        f"WITH {o.TICKS} SELECT {KEYS_SQL}, time, round(ask_price1, 9) + 0.0 AS bid_price1, round(bid_price1, 9) + 0.0 AS "
        f"ask_price1, CAST(total_ask_volume AS BIGINT) AS total_bid_volume FROM ticks")
    add("t06_book_amounts", lambda m: t.add_book_amounts(
        m.stock_ticks().drop(*[f"grade{d}_{s}_amount" for d in (5, 10) for s in ("bid", "ask")])).select(
        "tscode", F.col("date").cast("string").alias("date"), "time",
        *[rounded(f"grade{d}_{s}_amount", 3) for d in (10, 5) for s in ("bid", "ask")]),
        f"WITH {o.TICKS} SELECT {KEYS_SQL}, time, "
        + ", ".join(f"round(grade{d}_{s}_amount, 3) + 0.0 AS grade{d}_{s}_amount" for d in (10, 5) for s in ("bid", "ask"))
        + " FROM ticks")
    snapped = o.CLEAN + f""",
opened AS (SELECT *, arg_min(close, CASE WHEN close > 0 THEN (time, tick_order) END) OVER (PARTITION BY tscode, date)
  AS last_close, time BETWEEN '09:30:00.000' AND '09:32:00.000' AS opening FROM clean),
priced AS (SELECT * REPLACE (CASE WHEN opening AND price = 0 THEN last_close ELSE price END AS price) FROM opened),
offgrid AS (SELECT *, {o.tick_second()} AS s3, time >= '09:30:00' AND {o.tick_second()} % 3 <> 0 AS off FROM priced),
aimed AS (SELECT *, CASE WHEN off THEN {o.clock('s3 - s3 % 3 + 3')} ELSE time END AS aim FROM offgrid),
ranked AS (SELECT *, NOT off OR row_number() OVER (PARTITION BY tscode, date, aim ORDER BY off, tick_order) = 1 AS wins
  FROM aimed),
snapped AS (SELECT * REPLACE (CASE WHEN wins THEN aim ELSE time END AS time) FROM ranked),
lasts AS (SELECT *, coalesce(max(CASE WHEN volume > 0 THEN time END) OVER (PARTITION BY tscode, date), '') AS last_trade
  FROM snapped),
closed AS (SELECT * REPLACE (CASE WHEN last_trade > '15:00:00.000' AND time = last_trade THEN '15:00:00.000' ELSE time END
  AS time) FROM lasts WHERE last_trade <= '15:00:00.000' OR time = last_trade OR time < '15:00:00.000')"""
    enrich = lambda m: t.move_closing_trade(t.snap_to_grid(t.fill_opening_prices(t.clean_stock_ticks(m.raw_stock_ticks()))))
    _ticks("t02_align_stock_ticks", enrich, snapped, "closed")
    step = K.STOCK_TICK_SECONDS
    filled = snapped + f""",
ahead AS (SELECT *, {o.tick_second()} AS s4, lead({o.tick_second()}) OVER (PARTITION BY tscode, date,
  time >= '09:30:00.000' ORDER BY time, tick_order) - {o.tick_second()} AS raw_gap FROM closed),
gapped AS (SELECT *, CASE WHEN raw_gap >= 5400 THEN raw_gap - 5400 ELSE raw_gap END AS g FROM ahead),
copied AS (SELECT *, unnest(range(0, 1 + CASE WHEN time >= '09:30:00.000' AND g > {step} THEN (g - 1) // {step} ELSE 0 END))
  AS copy FROM gapped),
filled AS (SELECT * REPLACE (CASE WHEN copy > 0 THEN 0 ELSE volume END AS volume, CASE WHEN copy > 0 THEN 0 ELSE amount END
  AS amount), s4 + copy * {step} + CASE WHEN time = '11:30:00.000' AND copy > 0 THEN 5400 ELSE 0 END AS s5 FROM copied)"""
    add("t02_enrich_stock_ticks", lambda m: t.enrich_stock_ticks(
        t.clean_stock_ticks(m.raw_stock_ticks())).groupBy("tscode", "date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("filled").cast("bigint")).alias("filled_rows"),
        F.sum("volume").alias("volume"), F.sum(t.whole_seconds("time").cast("bigint")).alias("seconds")).select(
        "tscode", F.col("date").cast("string").alias("date"), "rows", "filled_rows", "volume", "seconds"),
        f"WITH {filled} SELECT {KEYS_SQL}, count(*) AS rows, CAST(sum(CASE WHEN copy > 0 THEN 1 ELSE 0 END) AS BIGINT) AS "
        f"filled_rows, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(s5) AS BIGINT) AS seconds FROM filled "
        f"GROUP BY tscode, date")


def _register_repairs() -> None:
    # a repair reads the original layer for itself and for the organized one
    raw = lambda m: m.stored_raw_ticks()
    clean = lambda m: t.clean_stock_ticks(m.stored_raw_ticks())
    single = lambda m: m.raw_stock_ticks()
    _ticks("x01_restore_auction_duplicates", lambda m: x.restore_auction_duplicates(t.clean_stock_ticks, raw(m)),
           o.CLEAN + ", twice AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY tscode, date, time) AS n FROM raw "
                     "WHERE time >= '09:15:00.000' AND time < '09:25:00.000') WHERE n > 1), "
                     "joined AS (SELECT * FROM clean UNION ALL SELECT * EXCLUDE (n) FROM twice)", "joined")
    untraded = ("untraded AS (SELECT * REPLACE (CASE WHEN time = '15:00:00.000' AND num % 5 = 1 THEN 0 ELSE volume END AS "
                "volume) FROM clean)")
    number = lambda: F.col("tscode").substr(4, 20).cast("bigint")
    hidden = lambda m: clean(m).withColumn("volume", F.when(
        (F.col("time") == "15:00:00.000") & (number() % 5 == 1), 0).otherwise(F.col("volume")))
    _ticks("x02_replace_closing_record", lambda m: x.replace_closing_record(hidden(m), raw(m)),
           o.CLEAN + f", {untraded}, good AS (SELECT DISTINCT tscode, date FROM untraded WHERE time = '15:00:00.000' AND "
                     "volume > 0), joined AS (SELECT * FROM untraded WHERE time <> '15:00:00.000' UNION ALL SELECT * FROM "
                     "untraded SEMI JOIN good USING (tscode, date) WHERE time = '15:00:00.000' UNION ALL SELECT * FROM raw "
                     "ANTI JOIN good USING (tscode, date) WHERE time = '15:00:00.000' AND volume > 0 AND (tscode, date) IN "
                     "(SELECT (tscode, date) FROM untraded))", "joined")
    _ticks("x03_carry_transaction_number", lambda m: x.carry_transaction_number(t.clean_stock_ticks(single(m))),
           o.CLEAN + f", fixed AS (SELECT * REPLACE (coalesce(last_value(nullif(transaction_number, 0) IGNORE NULLS) OVER "
                     f"({o.ROWS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), transaction_number) AS "
                     f"transaction_number) FROM clean)", "fixed")
    step = 60
    step_of = lambda total: f"coalesce(greatest({total} - lag({total}) OVER ({o.ROWS}), 0), 0)"
    ended = lambda rows: o.CLEAN + f""",
bare AS ({rows}),
marked AS (SELECT *, max(volume) OVER (PARTITION BY tscode, date) = 0 AS e, {step_of('daily_accumulated_volume')} AS dv,
  {step_of('daily_amount')} AS da FROM bare),
kept AS (SELECT * EXCLUDE (e, dv, da) REPLACE (CASE WHEN e THEN dv ELSE volume END AS volume, CASE WHEN e THEN da ELSE amount END
  AS amount) FROM marked),
flags AS (SELECT tscode, date, max(time = '15:00:00.000') AS hc, max(time = '11:30:00.000') AS hn FROM clean GROUP BY ALL),
src AS (SELECT kept.*, hc, hn, max(CASE WHEN volume > 0 THEN time END) OVER (PARTITION BY tscode, date) AS lt
  FROM kept JOIN flags USING (tscode, date)),
closes2 AS (SELECT * REPLACE ('15:00:00.000' AS time) FROM src WHERE NOT hc AND lt IS NOT NULL AND time = CASE WHEN lt <=
  '15:00:00.000' THEN '15:00:00.000' ELSE lt END),
lastm AS (SELECT *, {o.tick_second()} AS s6 FROM src WHERE hc AND NOT hn AND time <= '11:30:00.000'
  QUALIFY row_number() OVER (PARTITION BY tscode, date ORDER BY time DESC, tick_order DESC) = 1),
noons AS (SELECT *, unnest(CASE WHEN s6 = 41400 THEN [0] ELSE range(1, (41400 - s6) // {step} + 1) END) AS st FROM lastm),
noon_rows AS (SELECT * EXCLUDE (st, s6) REPLACE ({o.clock(f's6 + st * {step}')} AS time) FROM noons),
ended AS (SELECT * FROM clean UNION ALL SELECT * EXCLUDE (hc, hn, lt) FROM closes2 UNION ALL
  SELECT * EXCLUDE (hc, hn, lt) FROM noon_rows)"""
    _ticks("x04_restore_close_records", lambda m: x.restore_close_records(clean(m), raw(m), step), ended("SELECT * FROM raw"), "ended")
    bare = lambda m: raw(m).withColumns({c: F.when(number() % 4 == 0, F.lit(0)).otherwise(F.col(c)) for c in ("volume", "amount")})
    _ticks("x04_restore_close_of_days_without_volume", lambda m: x.restore_close_records(clean(m), bare(m), step),
           ended("SELECT * REPLACE (CASE WHEN num % 4 = 0 THEN 0 ELSE volume END AS volume, CASE WHEN num % 4 = 0 THEN 0 ELSE amount "
                 "END AS amount) FROM raw"), "ended")
    empty = ("emptied AS (SELECT * REPLACE (CASE WHEN num % 4 = 0 THEN 0 ELSE volume END AS volume, CASE WHEN num % 4 = 0 "
             "THEN 0 ELSE amount END AS amount) FROM clean)")
    emptied = lambda m: t.clean_stock_ticks(single(m)).withColumns({
        c: F.when(number() % 4 == 0, F.lit(0)).otherwise(F.col(c)) for c in ("volume", "amount")})
    _ticks("x05_volume_from_totals", lambda m: x.volume_from_totals(emptied(m)),
           o.CLEAN + f", {empty}, shares AS (SELECT *, avg(CASE WHEN volume = 0 THEN 1.0::DOUBLE ELSE 0 END) OVER "
                     f"(PARTITION BY tscode, date) > 0.999 AS e, daily_accumulated_volume - lag(daily_accumulated_volume) "
                     f"OVER ({o.ROWS}) AS dv, daily_amount - lag(daily_amount) OVER ({o.ROWS}) AS da FROM emptied), "
                     f"fixed AS (SELECT * REPLACE (CASE WHEN e AND volume = 0 THEN dv ELSE volume END AS volume, CASE WHEN e "
                     f"AND amount = 0 THEN da ELSE amount END AS amount) FROM shares)", "fixed")
    idle = f"daily_accumulated_volume - lag(daily_accumulated_volume) OVER ({o.ROWS}) = 0 AND volume > 0"
    _ticks("x06_clear_untraded_volume", lambda m: x.clear_untraded_volume(single(m)),
           o.RAW + f", idle AS (SELECT *, {idle} AS i FROM raw), fixed AS (SELECT * REPLACE (CASE WHEN i THEN 0 ELSE volume "
                   f"END AS volume, CASE WHEN i THEN 0 ELSE amount END AS amount) FROM idle)", "fixed")
    _ticks("x07_drop_repeat_records", lambda m: x.drop_repeat_records(single(m)),
           o.RAW + f", ranked AS (SELECT *, count(*) OVER (PARTITION BY tscode, date, time) AS n, row_number() OVER "
                   f"(PARTITION BY tscode, date, daily_accumulated_volume ORDER BY time, tick_order) AS rn FROM raw)",
           "ranked", f"WHERE NOT ({o.IN_SESSION} AND n > 1) OR rn = 1")
    config = lambda m: raw(m).select("date", "tscode").distinct().withColumn("status", F.lit(0))
    bad = lambda m: raw(m).where("price = 0 and time > '09:32:00.000'")
    status = lambda df: df.select(F.col("date").cast("string").alias("date"), "tscode", "status")
    bad_sql = "SELECT DISTINCT tscode, date FROM raw WHERE price = 0 AND time > '09:32:00.000'"
    add("x08_mark_bad_data", lambda m: status(x.set_status(config(m), bad(m), 2)),
        f"WITH {o.RAW}, bad AS ({bad_sql}) SELECT DISTINCT CAST(date AS VARCHAR) AS date, tscode, CAST(CASE WHEN (tscode, "
        f"date) IN (SELECT (tscode, date) FROM bad) THEN 2 ELSE 0 END AS INTEGER) AS status FROM raw")
    add("x15_reset_small_issues", lambda m: status(x.reset_small_issues(
        config(m).withColumn("status", F.lit(2)), q.validate_stock_ticks(m.stored_raw_ticks(), ["level_missing"]), 12)),
        f"WITH {flagged_ctes()}, counted AS (SELECT tscode, date, {rule_sql()['level_missing']} AS c FROM flagged GROUP BY "
        f"ALL) SELECT CAST(date AS VARCHAR) AS date, tscode, CAST(CASE WHEN c BETWEEN 1 AND 12 THEN 0 ELSE 2 END AS INTEGER) "
        f"AS status FROM counted")
    book = lambda df: shown(df, rounded("bid_price1", 9), rounded("ask_price1", 9), rounded("bid_price3", 9))
    patch = lambda m: m.stock_ticks().select("tscode", "date", "time", *[
        (F.col(c) + 1).alias(c) for c in t.BOOK_COLUMNS])
    limit = ("(CASE WHEN (tscode LIKE '68%' OR tscode LIKE '300%') AND strftime(date, '%Y%m%d') >= '20200824' THEN 0.2 "
             "WHEN tscode LIKE '8%' THEN 0.3 ELSE 0.1 END)")
    fix = ", ".join(f"CASE WHEN ob AND c.{c} = 0 THEN coalesce(p.{c} + 1, c.{c}) ELSE c.{c} END AS {c}"
                    for c in ("bid_price1", "ask_price1", "bid_price3"))
    others = ", ".join(f"c.{c}" for c in SHOWN)
    add("x09_patch_book_levels", lambda m: book(x.patch_book_levels(clean(m), patch(m))),
        f"WITH {o.CLEAN}, marked AS (SELECT *, time >= '09:30:00.000' AND time < '14:57:00.000' AND NOT coalesce(abs(abs("
        f"(price - close) / nullif(close, 0)) - {limit}) < 0.001, false) AS ob FROM clean), fixed AS (SELECT {others}, {fix} "
        f"FROM marked c LEFT JOIN ticks p USING (tscode, date, time)) SELECT {SHOWN_SQL}, {BOOK_SQL} FROM fixed")
    add("x10_swap_bid_ask", lambda m: book(t.swap_book_sides(single(m))),
        f"WITH {o.RAW} SELECT {SHOWN_SQL}, round(ask_price1, 9) + 0.0 AS bid_price1, round(bid_price1, 9) + 0.0 AS ask_price1, "
        f"round(ask_price3, 9) + 0.0 AS bid_price3 FROM raw")
    bumped = lambda m: clean(m).withColumns({c: F.col(c) + 1 for c in t.BOOK_COLUMNS})
    zero = " OR ".join(f"{s}_{f}{i} = 0" for s in ("bid", "ask") for f in ("price", "volume") for i in o.LEVELS)
    restore = ", ".join(f"CASE WHEN r.time IS NOT NULL THEN r.{c} ELSE c.{c} + 1 END AS {c}"
                        for c in ("bid_price1", "ask_price1", "bid_price3"))
    add("x11_restore_book_levels", lambda m: book(x.restore_book_levels(bumped(m), raw(m))),
        f"WITH {o.CLEAN}, zeros AS (SELECT * FROM raw WHERE {zero} QUALIFY row_number() OVER (PARTITION BY tscode, date, time "
        f"ORDER BY tick_order DESC) = 1), fixed AS (SELECT {others}, {restore} FROM clean c LEFT JOIN zeros r ON r.tscode = "
        f"c.tscode AND r.date = c.date AND r.time = c.time) SELECT {SHOWN_SQL}, {BOOK_SQL} FROM fixed")
    micro = lambda: F.timestamp_diff("MICROSECOND", F.col("date").cast("timestamp_ntz"), F.col("datetime")).alias("micros")
    micro_sql = "date_diff('microsecond', CAST(date AS TIMESTAMP), datetime) AS micros"
    keep = "tick_id % 3 <> 0"
    add("x12_insert_patch_rows", lambda m: x.insert_patch_rows(
        m.future_ticks().where(keep), m.future_ticks().where(f"not ({keep})")).select(
        "instrument", F.col("date").cast("string").alias("date"), micro(), rounded("last_price", 9)),
        f"WITH {o.BARS}, kept AS (SELECT * FROM trades WHERE {keep}), gaps AS (SELECT instrument AS gi, date AS gd, "
        f"lag(datetime) OVER (PARTITION BY instrument, date ORDER BY datetime) AS a, datetime AS b FROM kept), spans AS "
        f"(SELECT * FROM gaps WHERE date_diff('microsecond', a, b) / 1e6 > 300 AND date_diff('microsecond', a, b) / 1e6 < "
        f"5400), added AS (SELECT t.* FROM trades t JOIN spans ON instrument = gi AND date = gd AND datetime > a AND datetime "
        f"< b WHERE NOT ({keep})) SELECT instrument, CAST(date AS VARCHAR) AS date, {micro_sql}, round(last_price, 9) + 0.0 "
        f"AS last_price FROM (SELECT * FROM kept UNION ALL SELECT * FROM added)")
    _ticks("x13_repair_failed_keys", lambda m: x.repair_failed(
        raw(m), q.validate_stock_ticks(raw(m), ["volume_not_cleared"]).where("result = 1"), x.clear_untraded_volume),
           o.RAW + f", idle AS (SELECT *, {idle} AS i FROM raw), fixed AS (SELECT * REPLACE (CASE WHEN i THEN 0 ELSE volume "
                   f"END AS volume, CASE WHEN i THEN 0 ELSE amount END AS amount) FROM idle)", "fixed")
    returns = lambda m: bar_ops.percent_returns(m.bars(), ["instrument"], [5], chunk_rows=400)
    add("x14_refresh_returns", lambda m: x.update_by_key(
        m.bars().withColumn("ret_percent__5", F.lit(0.0)), returns(m).where("slot >= 12 and ret_percent__5 is not null"),
        ["instrument", "datetime"], ["ret_percent__5"]).select("instrument", "datetime", rounded("ret_percent__5", 6, "ret")),
        f"WITH {o.BARS}, later AS (SELECT *, (lead(close, 5) OVER ({o.SERIES}) - close) / close * 100 AS v FROM bars) SELECT "
        f"instrument, datetime, round(CASE WHEN slot >= 12 THEN coalesce(v, 0.0) ELSE 0.0 END, 6) + 0.0 AS ret FROM later")
    rebuilt = o.CLEAN + f""",
traded AS (SELECT * REPLACE ('15:00:00.000' AS time) FROM raw WHERE volume > 0 AND (tscode, date) IN (SELECT (tscode, date)
  FROM clean) QUALIFY row_number() OVER (PARTITION BY tscode, date ORDER BY time DESC, tick_order DESC) = 1),
known AS (SELECT clean.*, max(clean.time = '15:00:00.000') OVER (PARTITION BY clean.tscode, clean.date) AS hc
  FROM clean SEMI JOIN traded USING (tscode, date)),
rest AS (SELECT *, {o.tick_second()} AS s7, row_number() OVER (PARTITION BY tscode, date ORDER BY time DESC, tick_order) AS
  rk FROM known WHERE time < '15:00:00.000'),
copies AS (SELECT *, unnest(range(0, 1 + CASE WHEN NOT hc AND rk = 1 THEN (54000 - s7 - 1) // {step} ELSE 0 END)) AS cp
  FROM rest),
spread2 AS (SELECT * EXCLUDE (cp, rk, s7, hc) REPLACE ({o.clock(f"s7 + cp * {step} + CASE WHEN time = '11:30:00.000' AND cp > 0 THEN 5400 ELSE 0 END")}
  AS time, CASE WHEN cp > 0 THEN 0 ELSE volume END AS volume, CASE WHEN cp > 0 THEN 0 ELSE amount END AS amount,
  CASE WHEN cp > 0 THEN 0 ELSE transaction_number END AS transaction_number) FROM copies),
rebuilt AS (SELECT * FROM spread2 UNION ALL SELECT * FROM clean ANTI JOIN traded USING (tscode, date) UNION ALL SELECT * FROM
  traded)"""
    _ticks("t16_rebuild_closing_record", lambda m: x.rebuild_closing_record(clean(m), raw(m), step), rebuilt, "rebuilt")


def register() -> None:
    _register_cleaning()
    _register_rules()
    _register_repairs()
