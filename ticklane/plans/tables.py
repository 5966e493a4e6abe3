"""Queries of calendar and metadata operators, joins, exploration, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane import constants as K
from ticklane.functions import scalar as s
from ticklane.functions.series import SeriesColumns, with_position
from ticklane.operators import calendar as cal
from ticklane.operators import cross_section as cs
from ticklane.operators import explore as ex
from ticklane.operators import factor_tables as ft
from ticklane.operators import repair as rp
from ticklane.operators import ticks as tk
from ticklane.operators.bars import strip_contract_prefix
from ticklane.plans import oracle as o
from ticklane.plans.catalog import add, date_text, rounded
from ticklane.plans.evaluation import FACTORED, factored
from ticklane.sources import files

KEYS_SQL = "tscode, CAST(date AS VARCHAR) AS date"
CHUNK = 400

# status of a (date, stock) pair: 2 where it has a zero price late in the day, 1 where it barely trades
CONFIG = """
config AS (
  SELECT c.product, t.date, t.tscode,
    CASE WHEN max(CASE WHEN price = 0 AND time > '14:30:00.000' THEN 1 ELSE 0 END) = 1 THEN 2
         WHEN sum(volume) < 60 THEN 1 ELSE 0 END AS status,
    CASE WHEN CAST(substr(t.tscode, 4) AS BIGINT) % 9 = 0 THEN 1 ELSE 0 END AS is_st
  FROM raw t JOIN constituents c ON t.tscode = c.tscode AND t.date BETWEEN c.start_date AND c.end_date
  GROUP BY c.product, t.date, t.tscode)"""
BASE = o.RAW.strip() + ",\n" + o.MEMBERS.strip() + ",\n" + CONFIG.strip()


def config(market) -> DataFrame:
    members = cs.constituent_ticks(market.raw_stock_ticks(), market.constituents())
    late_zero = F.max(F.when((F.col("price") == 0) & (F.col("time") > "14:30:00.000"), 1).otherwise(0)) == 1
    return members.groupBy("product", "date", "tscode").agg(
        F.when(late_zero, 2).when(F.sum("volume") < 60, 1).otherwise(0).alias("status"),
        F.when(F.first("tscode").substr(4, 20).cast("bigint") % 9 == 0, 1).otherwise(0).alias("is_st"))


def _pairs(df: DataFrame, *more) -> DataFrame:
    return df.select("tscode", date_text(), *more)


def _register_calendar() -> None:
    add("m01_trading_dates", lambda m: _pairs(cal.trading_dates(config(m), "1996-01-01", "1999-12-31")),
        f"WITH {BASE} SELECT DISTINCT {KEYS_SQL} FROM config WHERE status = 0 AND date BETWEEN '1996-01-01' AND '1999-12-31'")
    add("m01_trading_date_lists", lambda m: cal.trading_date_lists(config(m)).select(
        "tscode", F.size("dates").cast("bigint").alias("n"), F.concat_ws("|", "dates").alias("dates")),
        f"WITH {BASE} SELECT tscode, count(DISTINCT date) AS n, array_to_string(list(DISTINCT date ORDER BY date), '|') AS dates "
        f"FROM config WHERE status = 0 GROUP BY tscode")
    add("m02_invalid_pairs", lambda m: _pairs(cal.invalid_pairs(config(m))),
        f"WITH {BASE} SELECT DISTINCT {KEYS_SQL} FROM config WHERE status IN (1, 2)")
    add("m02_invalid_dates", lambda m: cal.invalid_dates(config(m), (2,)).select(date_text()),
        f"WITH {BASE} SELECT DISTINCT CAST(date AS VARCHAR) AS date FROM config WHERE status = 2")
    status = lambda df: df.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))
    add("m03_update_status", lambda m: status(rp.set_status(config(m), config(m).where("is_st = 1"), 2)),
        f"WITH {BASE} SELECT CAST(CASE WHEN is_st = 1 THEN 2 ELSE status END AS INTEGER) AS status, count(*) AS rows FROM config "
        f"GROUP BY 1")
    add("m04_special_treatment", lambda m: _pairs(cal.special_treatment(config(m))),
        f"WITH {BASE} SELECT DISTINCT {KEYS_SQL} FROM config WHERE is_st = 1")
    daily = lambda m: m.stock_ticks().where("volume > 45").select("date", "tscode", F.lit(1).alias("is_st"))
    add("m04_mark_special_treatment", lambda m: cal.mark_special_treatment(config(m), daily(m)).groupBy("is_st").agg(
        F.count(F.lit(1)).alias("rows")),
        f"WITH {BASE}, st AS (SELECT DISTINCT tscode, date FROM ticks WHERE volume > 45) SELECT CAST(CASE WHEN st.tscode IS NOT "
        f"NULL THEN 1 ELSE is_st END AS INTEGER) AS is_st, count(*) AS rows FROM config LEFT JOIN st USING (tscode, date) GROUP BY 1")
    add("m05_mark_suspended", lambda m: cal.mark_suspended(config(m), m.stock_ticks().where("volume > 30")).groupBy(
        "status").agg(F.count(F.lit(1)).alias("rows")),
        f"WITH {BASE}, t AS (SELECT DISTINCT tscode, date FROM ticks WHERE volume > 30) SELECT CAST(CASE WHEN t.tscode IS NULL "
        f"THEN 1 ELSE status END AS INTEGER) AS status, count(*) AS rows FROM config LEFT JOIN t USING (tscode, date) GROUP BY 1")
    contracts = (o.BARS + ", daily AS (SELECT instrument, date, sum(delta_volume) AS v FROM trades GROUP BY ALL), calendar AS "
                          "(SELECT 'EV' AS product, instrument, date, CASE WHEN row_number() OVER (PARTITION BY date ORDER BY v "
                          "DESC, instrument) = 1 THEN 0 ELSE 1 END AS is_main FROM daily)")
    add("m07_contract_spans", lambda m: cal.contract_spans(m.contract_calendar()).select(
        "product", "instrument", F.col("start_date").cast("string").alias("start_date"),
        F.col("end_date").cast("string").alias("end_date")),
        f"WITH {contracts} SELECT product, instrument, CAST(min(date) AS VARCHAR) AS start_date, CAST(max(date) AS VARCHAR) AS "
        f"end_date FROM calendar GROUP BY ALL")
    add("m08_dates_outside", lambda m: cal.dates_outside(m.contract_calendar(), "2024-01-05", "2024-01-25").select(date_text()),
        f"WITH {contracts} SELECT DISTINCT CAST(date AS VARCHAR) AS date FROM calendar WHERE date < '2024-01-05' OR date > "
        f"'2024-01-25'")
    add("m09_main_contracts", lambda m: cal.main_contracts(m.contract_calendar()).select("product", date_text(), "instrument"),
        f"WITH {contracts} SELECT product, CAST(date AS VARCHAR) AS date, instrument FROM calendar WHERE is_main = 0")
    add("t15_main_contract_of_each_date", lambda m: m.contract_calendar().select("product", "instrument", date_text(), "is_main"),
        f"WITH {contracts} SELECT product, instrument, CAST(date AS VARCHAR) AS date, CAST(is_main AS INTEGER) AS is_main FROM "
        f"calendar")
    days = lambda m: m.contract_calendar().select("date").distinct()
    for name, backward, more in (("m10_last_n_dates", True, False), ("m10_next_n_dates", False, False),
                                 ("m10_last_n_dates_strict", True, True)):
        step = "lag" if backward else "lead"
        frame = "ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING" if backward else "ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING"
        single = f"{step}(date, 3) OVER (ORDER BY date)"
        if more:
            single = f"CASE WHEN {step}(date, 4) OVER (ORDER BY date) IS NOT NULL THEN {single} END"
        add(name, lambda m, backward=backward, more=more: cal.neighbour_dates(
            days(m), 3, backward=backward, needs_more=more).select(
            date_text(), F.col("neighbour").cast("string").alias("neighbour"), F.concat_ws("|", "dates").alias("dates")),
            f"WITH {contracts}, d AS (SELECT DISTINCT date FROM calendar) SELECT CAST(date AS VARCHAR) AS date, CAST({single} AS "
            f"VARCHAR) AS neighbour, coalesce(array_to_string(list(date) OVER (ORDER BY date {frame}), '|'), '') AS dates FROM d")
    add("w14_trading_days_before", lambda m: cal.neighbour_dates(cal.trading_dates(config(m)), 2, ["tscode"]).select(
        "tscode", date_text(), F.col("neighbour").cast("string").alias("neighbour"), F.size("dates").cast("bigint").alias("n")),
        f"WITH {BASE}, d AS (SELECT DISTINCT tscode, date FROM config WHERE status = 0) SELECT {KEYS_SQL}, CAST(lag(date, 2) OVER w "
        f"AS VARCHAR) AS neighbour, count(*) OVER (PARTITION BY tscode ORDER BY date ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS n "
        f"FROM d WINDOW w AS (PARTITION BY tscode ORDER BY date)")
    add("w15_day_window", lambda m: cal.day_window(m.stock_ticks(), m.stock_ticks(), 3).groupBy("tscode", "for_date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume")).select(
        "tscode", F.col("for_date").cast("string").alias("date"), "rows", "volume"),
        f"WITH {o.TICKS}, d AS (SELECT tscode, date, count(*) AS n, sum(volume) AS v FROM ticks GROUP BY ALL), w AS (SELECT tscode, "
        f"date, sum(n) OVER x AS n, sum(v) OVER x AS v FROM d WINDOW x AS (PARTITION BY tscode ORDER BY date ROWS BETWEEN 3 "
        f"PRECEDING AND 1 PRECEDING)) SELECT {KEYS_SQL}, CAST(n AS BIGINT) AS rows, CAST(v AS BIGINT) AS volume FROM w WHERE n IS "
        f"NOT NULL")
    add("o05_latest_dates", lambda m: cal.latest_dates(m.contract_calendar(), 5).select(date_text()),
        f"WITH {contracts} SELECT CAST(date AS VARCHAR) AS date FROM (SELECT DISTINCT date FROM calendar) ORDER BY 1 DESC LIMIT 5")
    quarters = lambda m: m.stock_dates()
    add("m11_load_constituents", lambda m: cal.expand_intervals(m.constituents(), quarters(m)).select(
        "product", date_text(), "tscode", "status"),
        f"WITH {BASE}, d AS (SELECT DISTINCT date FROM ticks) SELECT DISTINCT product, CAST(date AS VARCHAR) AS date, tscode, 0 AS "
        f"status FROM constituents JOIN d ON date BETWEEN start_date AND end_date")
    runs = ("sets AS (SELECT product, date, list(DISTINCT tscode ORDER BY tscode) AS l FROM constituents JOIN (SELECT DISTINCT date "
            "FROM ticks) ON date BETWEEN start_date AND end_date GROUP BY ALL), flags AS (SELECT *, CASE WHEN lag(l) OVER w = l "
            "THEN 0 ELSE 1 END AS c FROM sets WINDOW w AS (PARTITION BY product ORDER BY date)), ids AS (SELECT *, sum(c) OVER "
            "(PARTITION BY product ORDER BY date) AS run FROM flags)")
    add("g17_compress_intervals", lambda m: cal.compress_intervals(
        cal.expand_intervals(m.constituents(), quarters(m))).select(
        "product", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"),
        "stocks"),
        f"WITH {BASE}, {runs} SELECT product, CAST(min(date) AS VARCHAR) AS start_date, CAST(max(date) AS VARCHAR) AS end_date, "
        f"CAST(max(len(l)) AS BIGINT) AS stocks FROM ids GROUP BY product, run")
    add("g18_constituents_of_product", lambda m: m.constituents().select("product", "tscode").distinct(),
        f"WITH {BASE} SELECT DISTINCT product, tscode FROM constituents")
    add("m12_run_records", lambda m: cal.run_records(
        config(m).groupBy("status").agg(F.count(F.lit(1)).alias("rows")), "run-1", F.lit("2024-02-01")),
        f"WITH {BASE} SELECT CAST(status AS INTEGER) AS status, count(*) AS rows, 'run-1' AS run_code, '2024-02-01' AS created FROM "
        f"config GROUP BY 1")
    add("m13_delete_by_stock", lambda m: _pairs(cal.without_keys(
        config(m), config(m).where("is_st = 1"), ["tscode"]), "status"),
        f"WITH {BASE} SELECT {KEYS_SQL}, CAST(status AS INTEGER) AS status FROM config WHERE tscode NOT IN (SELECT tscode FROM "
        f"config WHERE is_st = 1)")


def _register_joins() -> None:
    clock = "CAST(date AS VARCHAR) || ' ' || substr(time, 1, 8)"
    index_bars = lambda m: cs.constituent_ticks(m.stock_ticks(), m.constituents()).groupBy("product", "date", "time").agg(
        F.sum("volume").alias("volume")).where("time >= '09:30:00.000'").select(
        "product", "date", F.concat(F.col("date").cast("string"), F.lit(" "), F.col("time").substr(1, 8)).alias("datetime"),
        "volume")
    spot = lambda m: cs.spot_factors(m.stock_ticks(), m.constituents(), {"FCT_02_001_TOTAL_COMMISSION_RATIO": None})
    amount = lambda side: f"total_{side}_volume * weighted_average_{side}_price"
    joined = (f"{o.TICKS}, {o.MEMBERS}, grouped AS (SELECT product, date, time, CAST(sum(volume) AS BIGINT) AS volume, "
              f"sum({amount('bid')}) AS b, sum({amount('bid')} + {amount('ask')}) AS t FROM ticks x JOIN constituents c ON x.tscode "
              f"= c.tscode AND date BETWEEN start_date AND end_date GROUP BY ALL)")
    add("j01_align_spot_factor_to_bars", lambda m: cs.align_to_bars(index_bars(m), spot(m)).select(
        "product", "datetime", "volume", rounded("FCT_02_001_TOTAL_COMMISSION_RATIO", 6, "ratio")),
        f"WITH {joined} SELECT product, {clock} AS datetime, volume, CASE WHEN time > '09:30:00.000' THEN "
        f"round(coalesce(b / nullif(t, 0), 0), 6) + 0.0 END AS ratio FROM grouped WHERE time >= '09:30:00.000'")
    add("j04_constituents_of_date", lambda m: cs.constituent_ticks(m.stock_ticks(), m.constituents()).groupBy(
        "product", "date").agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume")).select(
        "product", date_text(), "rows", "volume"),
        f"WITH {o.TICKS}, {o.MEMBERS} SELECT product, CAST(date AS VARCHAR) AS date, count(*) AS rows, CAST(sum(volume) AS BIGINT) "
        f"AS volume FROM ticks t JOIN constituents c ON t.tscode = c.tscode AND date BETWEEN start_date AND end_date GROUP BY ALL")
    add("j05_drop_invalid_pairs", lambda m: cs.constituent_ticks(
        m.raw_stock_ticks(), m.constituents(), cal.invalid_pairs(config(m))).groupBy("product").agg(
        F.count(F.lit(1)).alias("rows")),
        f"WITH {BASE} SELECT c.product, count(*) AS rows FROM raw t JOIN constituents c ON t.tscode = c.tscode AND t.date BETWEEN "
        f"c.start_date AND c.end_date WHERE (t.tscode, t.date) NOT IN (SELECT (tscode, date) FROM config WHERE status IN (1, 2)) "
        f"GROUP BY ALL")
    add("j06_skip_finished_keys", lambda m: cal.without_keys(
        m.bars(), m.bars().where("slot = 3 and volume > 100"), ["instrument", "date"]).select(
        "instrument", "datetime", "volume"),
        f"WITH {o.BARS} SELECT instrument, datetime, volume FROM bars WHERE (instrument, date) NOT IN (SELECT (instrument, date) "
        f"FROM bars WHERE slot = 3 AND volume > 100)")
    daily = lambda m: m.stock_ticks().groupBy("tscode", "date").agg(F.min_by("price", "time").alias("open"))
    add("j07_t13_adjustment_factors", lambda m: ft.adjustment_factors(
        daily(m), daily(m).withColumn("open", F.col("open") * (1 + F.quarter("date") / 10)), ["tscode"]).select(
        "tscode", date_text(), rounded("value"), rounded("change")),
        f"WITH {o.TICKS}, d AS (SELECT tscode, date, arg_min(price, time) AS open FROM ticks GROUP BY ALL), v AS (SELECT *, open * "
        f"(1 + quarter(date) / 10.0::DOUBLE) / open AS value FROM d) SELECT {KEYS_SQL}, {o.r('value')} AS value, "
        f"{o.r('value - lag(value) OVER (PARTITION BY tscode ORDER BY date)')} AS change FROM v")
    add("j08_t10_replace_cells", lambda m: ft.organize(factored(m), "FCT_01_001_WILLIAM", [
        ({"FCT_01_001_WILLIAM"}, ft.replacing_cells(
            factored(m).where("slot = 5").withColumn("william", F.col("momentum") * 2), ["instrument", "datetime"], ["william"])),
        ({"other"}, lambda df: df.limit(0))]).select("instrument", "datetime", rounded("william")),
        f"WITH {FACTORED} SELECT instrument, datetime, {o.r('CASE WHEN slot = 5 THEN momentum * 2 ELSE william END')} AS william "
        f"FROM factored")
    holidays = lambda m: m.bars().where("slot = 3 and volume > 200").select("date").distinct()
    holidays_sql = "SELECT date FROM bars WHERE slot = 3 AND volume > 200"
    sparse = lambda m: factored(m).withColumn("william", F.when(F.col("slot") % 4 != 1, F.col("william")))
    add("t08_t09_t11_organize_factor", lambda m: ft.organize(sparse(m), "any", [
        (None, ft.zero_missing_on(holidays(m), ["william"])),
        (None, ft.excluding_dates(m.bars().where("slot = 6 and volume > 250")))]).select(
        "instrument", "datetime", rounded("william")),
        f"WITH {FACTORED} SELECT instrument, datetime, {o.r(f'CASE WHEN slot % 4 <> 1 THEN william WHEN date IN ({holidays_sql}) THEN 0.0 END')} AS william FROM factored "
        f"WHERE date NOT IN (SELECT date FROM bars WHERE slot = 6 AND volume > 250)")
    add("t12_recompute_dates", lambda m: ft.recompute_dates(
        factored(m), factored(m).withColumn("william", -F.col("william")), holidays(m)).select(
        "instrument", "datetime", rounded("william")),
        f"WITH {FACTORED} SELECT instrument, datetime, {o.r(f'CASE WHEN date IN ({holidays_sql}) THEN -william ELSE william END')} AS william FROM factored")

    def previous(m):
        columns = SeriesColumns()
        columns.lag("close", 1)
        # a slot may miss dates, so its rows are numbered, not its days
        slots = with_position(m.bars().withColumn("month", F.trunc("date", "month")), ["instrument", "slot"], ["date"], "month", "day")
        return columns.apply(slots, ["instrument", "slot"], "day", CHUNK)

    add("j09_previous_date_same_time", lambda m: previous(m).select(
        "instrument", "datetime", rounded(s.divide_or_zero("close", "close__lag1"), 6, "rate")),
        f"WITH {o.BARS} SELECT instrument, datetime, {o.r('coalesce(close / lag(close) OVER (PARTITION BY instrument, slot ORDER BY date), 0)')} AS rate FROM bars")
    add("j10_w10_duplicate_counts", lambda m: ex.auction_duplicates(m.raw_stock_ticks()).groupBy("tscode", "date", "time").agg(
        F.max("repeats").alias("repeats")).select("tscode", date_text(), "time", "repeats"),
        f"WITH {o.RAW} SELECT {KEYS_SQL}, time, count(*) AS repeats FROM raw WHERE time >= '09:15:00.000' AND time < "
        f"'09:25:00.000' GROUP BY tscode, raw.date, time HAVING count(*) > 1")
    quarter = lambda m: m.stock_ticks().select(F.lit("IX").alias("product"), "date").distinct()
    add("j11_stock_date_map", lambda m: config(m).where("status = 0").select("product", "date", "tscode").join(
        quarter(m).select("date"), "date").groupBy("product", "tscode").agg(F.count(F.lit(1)).alias("dates")),
        f"WITH {BASE} SELECT product, tscode, count(*) AS dates FROM config WHERE status = 0 GROUP BY ALL")


def _register_exploration() -> None:
    raw = lambda m: m.raw_stock_ticks()
    last = "max(CASE WHEN volume > 0 THEN time END)"
    add("y01_y02_last_trade_times", lambda m: _pairs(ex.traverse(raw(m), ex.last_trade_time(), "last_time"), "last_time"),
        f"WITH {o.RAW} SELECT {KEYS_SQL}, {last} AS last_time FROM raw GROUP BY tscode, raw.date HAVING {last} IS NOT NULL")
    add("y03_last_trade_at_close", lambda m: _pairs(ex.last_trade_at(raw(m), "15:00:00.000", first_only=False)),
        f"WITH {o.RAW} SELECT {KEYS_SQL} FROM raw GROUP BY tscode, raw.date HAVING {last} = '15:00:00.000'")
    add("y01_first_hit_only", lambda m: ex.last_trade_at(raw(m), "15:00:00.000").agg(F.count(F.lit(1)).alias("hits")),
        f"WITH {o.RAW}, found AS (SELECT tscode, date FROM raw GROUP BY tscode, date HAVING {last} = '15:00:00.000') SELECT "
        f"least(count(*), 1) AS hits FROM found")
    add("y04_trades_after_close", lambda m: _pairs(ex.trades_after_close(raw(m)), "time", "volume"),
        f"WITH {o.RAW} SELECT {KEYS_SQL}, time, CAST(volume AS BIGINT) AS volume FROM raw WHERE time >= '15:00:00.000' AND volume > 0")
    add("y05_repeated_trades", lambda m: _pairs(ex.repeated_trades(raw(m)), "time", F.col("tick_order").cast("bigint"),
                                                F.col("is_repeat").cast("int").alias("is_repeat")),
        f"WITH {o.RAW}, a AS (SELECT *, volume > 0 AND count(*) OVER (PARTITION BY tscode, date, time) > 1 AS rep FROM raw), b AS "
        f"(SELECT *, coalesce(lag(rep) OVER ({o.ROWS}), false) AS aft FROM a) SELECT {KEYS_SQL}, time, CAST(tick_order AS BIGINT) "
        f"AS tick_order, CAST(rep AS INTEGER) AS is_repeat FROM b WHERE rep OR aft")
    add("y06_movable_noon_trades", lambda m: _pairs(ex.movable_noon_trades(raw(m)), "time", "volume"),
        f"WITH {o.RAW}, a AS (SELECT *, max(CASE WHEN time = '11:30:00.000' AND volume > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY "
        f"tscode, date) AS h FROM raw) SELECT {KEYS_SQL}, time, CAST(volume AS BIGINT) AS volume FROM a WHERE time > '11:30:00.000' "
        f"AND time < '13:00:00.000' AND volume > 0 AND h = 0")
    add("y07_missing_noon_record", lambda m: _pairs(ex.missing_noon_record(raw(m))),
        f"WITH {o.RAW} SELECT {KEYS_SQL} FROM raw GROUP BY tscode, raw.date HAVING count(*) FILTER (WHERE time = '11:30:00.000') = 0")
    add("y08_auction_duplicates", lambda m: _pairs(ex.auction_duplicates(raw(m)), "time", "repeats"),
        f"WITH {o.RAW} SELECT {KEYS_SQL}, time, repeats FROM (SELECT *, count(*) OVER (PARTITION BY tscode, date, time) AS repeats "
        f"FROM raw WHERE time >= '09:15:00.000' AND time < '09:25:00.000') WHERE repeats > 1")
    add("y09_closing_duplicates", lambda m: _pairs(ex.closing_duplicates(raw(m)), "rows"),
        f"WITH {o.RAW} SELECT {KEYS_SQL}, count(*) AS rows FROM raw WHERE time = '15:00:00.000' GROUP BY tscode, raw.date HAVING "
        f"count(*) > 1")
    cells = ["volume", "bid_price1", "ask_price1"]
    add("p12_cells_equal", lambda m: _pairs(ex.cells_equal(m.stock_ticks(), 0, cells, ["tscode", "date", "time"]), "time", "column"),
        f"WITH {o.TICKS} " + " UNION ALL ".join(
            f"SELECT {KEYS_SQL}, time, '{c}' AS \"column\" FROM ticks WHERE {c} = 0" for c in cells))
    add("p12_columns_equal", lambda m: _pairs(ex.columns_equal(m.stock_ticks(), 0, cells, ["tscode", "date", "time"]), "time",
                                              F.concat_ws(",", "columns").alias("columns")),
        f"WITH {o.TICKS}, x AS (SELECT *, concat_ws(',', " + ", ".join(f"CASE WHEN {c} = 0 THEN '{c}' END" for c in cells)
        + f") AS columns FROM ticks) SELECT {KEYS_SQL}, time, columns FROM x WHERE columns <> ''")
    text = lambda *names: [F.col(n).cast("string").alias(n) for n in names]
    add("s18_g16_table_inventory", lambda m: ex.table_inventory(m.future_ticks(), s.product_of("instrument")).select(
        "product", "instruments", "dates", "rows", *text("first_date", "last_date")),
        f"WITH {o.BARS} SELECT substr(instrument, 1, 2) AS product, count(DISTINCT instrument) AS instruments, count(DISTINCT date) "
        f"AS dates, count(*) AS rows, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM trades "
        f"GROUP BY 1")
    since = lambda c: F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col(c)).alias(c)
    add("g13_contract_detail", lambda m: ex.contract_detail(m.future_ticks()).select(
        "instrument", "rows", since("first_time"), since("last_time")),
        f"WITH {o.BARS} SELECT instrument, count(*) AS rows, date_diff('microsecond', TIMESTAMP '2024-01-01', min(datetime)) AS "
        f"first_time, date_diff('microsecond', TIMESTAMP '2024-01-01', max(datetime)) AS last_time FROM trades GROUP BY 1")
    add("g12_daily_counts", lambda m: ex.daily_counts(m.future_ticks(), ["instrument", "date"]).select("instrument", date_text(), "rows"),
        f"WITH {o.BARS} SELECT instrument, CAST(date AS VARCHAR) AS date, count(*) AS rows FROM trades GROUP BY ALL")
    add("g14_monthly_stock_days", lambda m: ex.monthly_stock_days(m.stock_ticks()),
        f"WITH {o.TICKS} SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, count(DISTINCT (tscode, "
        f"date)) AS stock_days FROM ticks GROUP BY 1, 2")
    add("g21_run_summary", lambda m: config(m).groupBy("product", "status").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("date").alias("dates")),
        f"WITH {BASE} SELECT product, CAST(status AS INTEGER) AS status, count(*) AS rows, count(DISTINCT date) AS dates FROM config "
        f"GROUP BY 1, 2")
    add("p05_p11_constituent_slice", lambda m: cs.constituent_ticks(m.stock_ticks(), m.constituents()).where(
        (F.col("product") == "ASIA") & F.col("date").between("1997-01-01", "1999-12-31")
        & F.col("time").between("10:00:00.000", "14:00:00.000")).select("tscode", date_text(), "time", rounded("price", 9)),
        f"WITH {o.TICKS}, {o.MEMBERS} SELECT t.tscode, CAST(date AS VARCHAR) AS date, time, round(price, 9) + 0.0 AS price FROM "
        f"ticks t JOIN constituents c ON t.tscode = c.tscode AND date BETWEEN start_date AND end_date WHERE product = 'ASIA' AND "
        f"date BETWEEN '1997-01-01' AND '1999-12-31' AND time BETWEEN '10:00:00.000' AND '14:00:00.000'")
    slice_ = lambda: (F.col("instrument") == "view") & F.col("date").between("2024-01-03", "2024-01-06")
    add("p14_u01_feeds_side_by_side", lambda m: ex.side_by_side(
        {"first": m.bars(), "second": m.bars().withColumn("close", F.col("close") + 1)}, slice_()).select(
        "feed", "datetime", rounded("close", 4)),
        f"WITH {o.BARS} SELECT feed, datetime, round(close + d, 4) + 0.0 AS close FROM bars, (VALUES ('first', 0), ('second', 1)) "
        f"f(feed, d) WHERE instrument = 'view' AND date BETWEEN '2024-01-03' AND '2024-01-06'")
    add("o06_every_kth_row", lambda m: ex.every_kth(m.bars(), "pos", 7).select("instrument", "datetime", rounded("close", 4)),
        f"WITH {o.BARS} SELECT instrument, datetime, round(close, 4) + 0.0 AS close FROM bars WHERE pos % 7 = 0")
    add("o01_o03_first_and_last_row", lambda m: m.future_ticks().groupBy("instrument", "date").agg(
        F.min_by("last_price", "datetime").alias("first_price"), F.max_by("last_price", "datetime").alias("last_price")).select(
        "instrument", date_text(), rounded("first_price", 4), rounded("last_price", 4)).orderBy("instrument", "date"),
        f"WITH {o.BARS} SELECT instrument, CAST(date AS VARCHAR) AS date, round(arg_min(last_price, datetime), 4) + 0.0 AS "
        f"first_price, round(arg_max(last_price, datetime), 4) + 0.0 AS last_price FROM trades GROUP BY ALL")
    add("p09_window_sample", lambda m: ex.window_sample(m.bars(), ["instrument"], "pos", 100, 2).select(
        "instrument", "datetime", rounded("close", 4)),
        f"WITH {o.BARS}, g AS (SELECT instrument, max(pos) AS top, md5(concat_ws('|', 7, instrument)) AS h FROM bars GROUP BY 1), "
        f"c AS (SELECT *, ('0x' || substr(md5(concat_ws('|', 8, instrument)), 1, 12))::BIGINT % greatest(top - 98, 1) AS begin_at FROM g "
        f"ORDER BY h LIMIT 2) SELECT bars.instrument, datetime, {o.r('close', 4)} AS close FROM bars JOIN c ON bars.instrument = "
        f"c.instrument AND pos >= begin_at AND pos < begin_at + 100")
    add("p10_paired_sample", lambda m: ex.paired_sample(
        m.stored_raw_ticks(), tk.clean_stock_ticks(m.stored_raw_ticks()), ["tscode", "date"], 3).select("tscode", date_text(), "time", "layer"),
        f"WITH {o.CLEAN}, c AS (SELECT tscode, date FROM (SELECT DISTINCT tscode, raw.date FROM raw SEMI JOIN clean USING (tscode, "
        f"date)) ORDER BY md5(concat_ws('|', 7, tscode, date)) LIMIT 3) SELECT tscode, CAST(raw.date AS VARCHAR) AS date, time, "
        f"'original' AS layer FROM raw SEMI JOIN c USING (tscode, date) UNION ALL SELECT tscode, CAST(clean.date AS VARCHAR), time, "
        f"'organized' FROM clean SEMI JOIN c USING (tscode, date)")
    add("p03_drop_incomplete", lambda m: tk.drop_incomplete(m.bars().withColumn(
        "gap", F.when(F.col("volume") > 0, F.col("volume")))).select("instrument", "datetime", "gap"),
        f"WITH {o.BARS} SELECT instrument, datetime, volume AS gap FROM bars WHERE volume > 0")
    add("p07_cast_columns", lambda m: m.bars().select("instrument", "datetime", rounded(
        F.col("close").cast("float").cast("double"), 3, "close"), F.col("volume").cast("double").alias("volume")),
        f"WITH {o.BARS} SELECT instrument, datetime, round(CAST(CAST(close AS FLOAT) AS DOUBLE), 3) + 0.0 AS close, CAST(volume AS "
        f"DOUBLE) AS volume FROM bars")
    add("p13_select_by_pattern", lambda m: m.table("lineitem").select(m.table("lineitem").colRegex("`l_.*key`"), "l_returnflag").where(
        F.col("l_returnflag").rlike("^[AR]$")),
        "SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag FROM lineitem WHERE regexp_matches(l_returnflag, '^[AR]$')")


def _register_sets() -> None:
    busy = lambda m: m.bars().where("volume > 150").select("datetime").distinct()
    rich = lambda m: m.bars().where("close > 160").select("datetime").distinct()
    a, b = ("SELECT DISTINCT datetime FROM bars WHERE volume > 150", "SELECT DISTINCT datetime FROM bars WHERE close > 160")
    both = lambda m: busy(m).exceptAll(rich(m)).withColumn("side", F.lit("left")).unionByName(
        rich(m).exceptAll(busy(m)).withColumn("side", F.lit("right")))
    add("u02_difference_both_ways", both,
        f"WITH {o.BARS} SELECT datetime, 'left' AS side FROM ({a} EXCEPT {b}) UNION ALL SELECT datetime, 'right' AS side FROM ({b} "
        f"EXCEPT {a})")
    add("u03_intersection", lambda m: busy(m).intersect(rich(m)), f"WITH {o.BARS} {a} INTERSECT {b}")
    add("u04_distinct_union", lambda m: busy(m).union(rich(m)).distinct(), f"WITH {o.BARS} {a} UNION {b}")
    add("u05_drop_duplicates_on_key", lambda m: m.future_ticks().select("instrument", "date").dropDuplicates(
        ["instrument", "date"]).select("instrument", date_text()),
        f"WITH {o.BARS} SELECT DISTINCT instrument, CAST(date AS VARCHAR) AS date FROM trades")
    from ticklane.operators.quality import content_differences
    cols = lambda m: m.bars().select("instrument", "datetime", "volume")
    add("u06_content_fingerprint", lambda m: content_differences(
        cols(m), cols(m).withColumn("volume", F.when(F.col("volume") > 250, 0).otherwise(F.col("volume")))).agg(
        F.count(F.lit(1)).alias("fingerprints"), F.sum(F.abs("surplus")).alias("rows")),
        f"WITH {o.BARS} SELECT 2 * count(*) FILTER (WHERE volume > 250) AS fingerprints, 2 * count(*) FILTER (WHERE volume > 250) AS "
        f"rows FROM bars")


def _register_scalars() -> None:
    ticks = lambda m: m.raw_stock_ticks().select("tscode", "date", "time", "tick_order", "price", "close", "volume")
    show = lambda m, *columns: ticks(m).select("tscode", date_text(), F.col("tick_order").cast("bigint"), *columns)
    head = f"{KEYS_SQL}, CAST(tick_order AS BIGINT) AS tick_order"
    second = o.tick_second()
    add("f01_time_difference", lambda m: show(m, s.time_difference(F.lit("10:00:00.000"), "time").cast("bigint").alias("seconds")),
        f"WITH {o.RAW} SELECT {head}, CASE WHEN {second} >= 36000 THEN {second} - 36000 END AS seconds FROM raw")
    add("f02_f04_advance_time", lambda m: show(m, s.advance_time("time", 63).alias("next_time")),
        f"WITH {o.RAW} SELECT {head}, {o.clock(f"{second} + 63 + CASE WHEN time = '11:30:00.000' THEN 5400 ELSE 0 END")} AS next_time FROM raw")
    add("f02_advance_datetime", lambda m: m.bars().select("instrument", "datetime", s.advance_datetime(
        F.col("datetime").cast("timestamp_ntz") - F.expr("INTERVAL '30' MINUTE"), 3).cast("string").alias("next")),
        f"WITH {o.BARS} SELECT instrument, datetime, CAST(CAST(datetime AS TIMESTAMP) - INTERVAL 30 MINUTE + INTERVAL 3 SECOND + "
        f"CASE WHEN slot = 11 THEN INTERVAL 90 MINUTE ELSE INTERVAL 0 MINUTE END AS VARCHAR) AS next FROM bars")
    add("f03_align_half_second", lambda m: m.future_ticks().select("tick_id", s.align_half_second(F.concat(
        F.lit("2024-01-01 10:00:00."), F.lpad((F.col("tick_id") % 10).cast("string"), 1, "0"), F.lit("12345678"))).alias("aligned")),
        f"WITH {o.BARS} SELECT tick_id, '2024-01-01 10:00:00.' || CASE WHEN tick_id % 10 > 4 THEN '5' ELSE '0' END || '00000000' AS "
        f"aligned FROM trades")
    carried = lambda: s.carry_seconds((F.col("tick_order") % 20).cast("int"), (F.col("volume") % 60).cast("int"),
                                      (F.col("tick_order") % 61).cast("int"))
    add("f04_carry_seconds", lambda m: show(m, *[carried()[p].cast("bigint").alias(p) for p in ("hour", "minute", "second")]),
        f"WITH {o.RAW}, p AS (SELECT *, tick_order % 20 AS h, volume % 60 AS mi, tick_order % 61 AS se FROM raw) SELECT {head}, h + "
        f"CASE WHEN se = 60 AND mi = 59 THEN 1 ELSE 0 END AS hour, CASE WHEN se = 60 THEN (mi + 1) % 60 ELSE mi END AS minute, CASE "
        f"WHEN se = 60 THEN 0 ELSE se END AS second FROM p")
    add("f05_f06_swap_date_format", lambda m: show(
        m, s.swap_date_format(F.col("date").cast("string")).alias("compact"),
        s.swap_date_format(s.swap_date_format(F.col("date").cast("string"))).alias("dashed"),
        s.with_milliseconds(F.col("time").substr(1, 8)).alias("milli")),
        f"WITH {o.RAW} SELECT {head}, strftime(date, '%Y%m%d') AS compact, strftime(date, '%Y-%m-%d') AS dashed, substr(time, 1, 8) "
        f"|| '.000' AS milli FROM raw")
    market = "CASE substr(tscode, 1, 1) WHEN '6' THEN '{}' WHEN '0' THEN '{}' WHEN '3' THEN '{}' END"
    add("f07_exchange_codes", lambda m: m.stock_ticks().select("tscode").distinct().select(
        "tscode", *[s.exchange_code("tscode", style).alias(style) for style in s.EXCHANGE_MARKERS]),
        f"WITH {o.TICKS}, c AS (SELECT DISTINCT tscode FROM ticks) SELECT tscode, {market.format('sh', 'sz', 'sz')} || tscode AS "
        f"prefix, tscode || {market.format('.SH', '.SZ', '.SZ')} AS suffix, {market.format('SH#', 'SZ#', 'SZ#')} || tscode || "
        f"'.txt' AS file, tscode || {market.format('.XSHG', '.XSHE', '.XSHE')} AS vendor FROM c")
    limit = ("CASE WHEN (tscode LIKE '68%' OR tscode LIKE '300%') AND day >= '20200824' THEN 0.2 WHEN tscode LIKE '8%' THEN 0.3 "
             "WHEN st THEN 0.05 ELSE 0.1 END")
    add("f08_f09_price_limits", lambda m: m.stock_ticks().select(
        "tscode", "date", "time", "price", "close", (F.year("date") + 22).cast("string").alias("_y")).select(
        "tscode", date_text(), "time", s.price_limit_rate("tscode", F.concat("_y", F.lit("0901")), F.col("price") > 900).alias("rate"),
        s.nearly_equal(F.col("price") / F.col("close"), F.lit(1.0), 0.05).cast("int").alias("near")),
        f"WITH {o.TICKS}, x AS (SELECT *, CAST(year(date) + 22 AS VARCHAR) || '0901' AS day, price > 900 AS st FROM ticks) SELECT "
        f"{KEYS_SQL}, time, CAST({limit} AS DOUBLE) AS rate, CAST(abs(price / close - 1) < 0.05 AS INTEGER) AS near FROM x")
    add("f10_f11_round_and_divide", lambda m: m.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", s.round_half_up(F.col("l_quantity") / 8, 2).alias("rounded"),
        rounded(s.divide_or_zero("l_extendedprice", F.col("l_tax")), 4, "ratio")),
        "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / 8, 2) AS rounded, round(coalesce(l_extendedprice / "
        "nullif(l_tax, 0), 0), 4) + 0.0 AS ratio FROM lineitem")
    add("f12_f13_names_and_codes", lambda m: m.table("orders").select(
        "o_orderkey", F.concat(F.lit("/data/CFFEX.IF"), F.col("o_custkey").cast("string"), F.lit(".csv")).alias("_a"),
        F.concat(F.lit("/data/"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit(".pkl")).alias("_b")).select(
        "o_orderkey", s.contract_from_path("_a").alias("contract"), s.product_of(s.contract_from_path("_a")).alias("product"),
        s.stock_from_path("_b").alias("stock")),
        "SELECT o_orderkey, 'IF' || o_custkey AS contract, 'IF' AS product, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS stock FROM "
        "orders")
    add("f18_level_weighted_amounts", lambda m: m.stock_ticks().select(
        "tscode", date_text(), "time", *[rounded(s.weighted_levels(side, d), 3, f"{side}{d}") for side in ("bid", "ask") for d in (10, 5)]),
        f"WITH {o.TICKS} SELECT {KEYS_SQL}, time, " + ", ".join(
            f"round({o._levels(side, d, True)}, 3) + 0.0 AS {side}{d}" for side in ("bid", "ask") for d in (10, 5)) + " FROM ticks")
    add("f19_f21_parse_and_strip", lambda m: m.table("part").select(
        "p_partkey", s.strip_whitespace("p_name").alias("name"), F.concat_ws("+", s.parse_parameters(
            F.concat_ws("|", F.col("p_size").cast("string"), F.lit("20")))).alias("params")),
        "SELECT p_partkey, regexp_replace(p_name, '\\s+', '', 'g') AS name, p_size || '+20' AS params FROM part")


def _register_registry() -> None:
    names = ["FCT_01_001_WILLIAM_1.0", "FCT_01_035_VOLUME_MOMENTUM_1.0"]
    add("m06_h12_build_factors_by_name", lambda m: ft.build_factor_table(
        m.bars(), [ft.resolve_factor(names[0], "20"), ft.resolve_factor(names[1], "10")], chunk_rows=CHUNK).select(
        "instrument", "datetime", rounded("FCT_01_001_WILLIAM__20", 6, "william"),
        rounded("FCT_01_035_VOLUME_MOMENTUM__10", 6, "momentum")),
        f"WITH {FACTORED} SELECT instrument, datetime, {o.r('william')} AS william, {o.r('momentum')} AS momentum FROM factored")


def _register_layouts() -> None:
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    add("s01_s05_s06_pruned_read", lambda m: files.read_table(
        m.spark, f"{m.folder}/lineitem.parquet", columns=[*keys, "l_quantity"]).where(F.col("l_quantity") > 45),
        "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45")
    add("s07_read_requested_keys", lambda m: files.read_pairs(
        m.spark, f"{m.folder}/lineitem.parquet", m.table("orders").where("o_orderstatus = 'F'").select(
            F.col("o_orderkey").alias("l_orderkey")), ("l_orderkey",)).select(*keys),
        "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE "
        "o_orderstatus = 'F')")

    def positional(m):
        ticks = m.stock_ticks().withColumn("surplus", F.lit(1))
        named = [F.col(c) if c in ticks.columns else F.lit(None).cast("string") for c in K.STOCK_TICK_COLUMNS]
        return ticks.select(*[c.alias(f"_c{i}") for i, c in enumerate(named)], "surplus")

    add("p02_name_columns_by_position", lambda m: tk.name_stock_columns(positional(m)).select(
        "tscode", date_text(), "time", rounded("price", 9), rounded("bid_price1", 9), F.col("total_bid_volume").cast("bigint")),
        f"WITH {o.TICKS} SELECT {KEYS_SQL}, time, round(price, 9) + 0.0 AS price, round(bid_price1, 9) + 0.0 AS bid_price1, "
        f"CAST(total_bid_volume AS BIGINT) AS total_bid_volume FROM ticks")
    prefixed = lambda m: m.future_ticks().select(
        F.col("tick_id"), F.col("last_price").alias("CFFEX.IF2401.last_price"), F.col("delta_volume").alias("CFFEX.IF2401.volume"))
    add("p01_strip_contract_prefix", lambda m: strip_contract_prefix(prefixed(m), "IF2401").select(
        "tick_id", rounded("last_price", 4), "volume"),
        f"WITH {o.BARS} SELECT tick_id, round(last_price, 4) + 0.0 AS last_price, delta_volume AS volume FROM trades")


def register() -> None:
    _register_layouts()
    _register_calendar()
    _register_joins()
    _register_exploration()
    _register_sets()
    _register_scalars()
    _register_registry()
