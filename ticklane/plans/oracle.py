"""SQL of the market tables and small helpers to write window SQL, for the result checks."""

from __future__ import annotations

BARS = """
trades AS (
  SELECT event_type AS instrument, CAST(ts AS DATE) AS date, ts AS datetime, event_id AS tick_id,
         CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS second,
         value + 100 AS last_price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS delta_volume,
         user_id AS open_interest
  FROM events),
slots AS (
  SELECT instrument, date, CAST(second // 3600 AS BIGINT) AS slot,
         arg_min(last_price, datetime) AS open, arg_max(last_price, datetime) AS close,
         max(last_price) AS high, min(last_price) AS low,
         CAST(sum(delta_volume) AS BIGINT) AS volume, arg_max(open_interest, datetime) AS interest
  FROM trades WHERE delta_volume > 0 GROUP BY ALL),
spread AS (
  SELECT *, coalesce(lead(slot) OVER (PARTITION BY instrument, date ORDER BY slot), 24) AS next_slot FROM slots),
bars AS (
  SELECT instrument, date, s AS slot, CAST(date + to_hours(CAST(s + 1 AS INTEGER)) AS VARCHAR) AS datetime,
         CASE WHEN s > slot THEN close ELSE open END AS open, close,
         CASE WHEN s > slot THEN close ELSE high END AS high,
         CASE WHEN s > slot THEN close ELSE low END AS low,
         CASE WHEN s > slot THEN 0 ELSE volume END AS volume, interest,
         row_number() OVER (PARTITION BY instrument ORDER BY date, s) - 1 AS pos
  FROM (SELECT *, unnest(range(slot, next_slot)) AS s FROM spread))"""

SERIES = "PARTITION BY instrument ORDER BY pos"


def frame(n: int, series: str = SERIES) -> str:
    return f"OVER ({series} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(function: str, x: str, n: int, series: str = SERIES, extra: str = "") -> str:
    """Aggregate over the last n rows, null until all hold a value."""
    over = frame(n, series)
    return f"CASE WHEN count({x}) {over} = {n} THEN {function}({x}{extra}) {over} END"


def lag(x: str, k: int = 1, series: str = SERIES) -> str:
    return f"lag({x}, {k}) OVER ({series})"


def lead(x: str, k: int = 1, series: str = SERIES) -> str:
    return f"lead({x}, {k}) OVER ({series})"


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def ln(x: str) -> str:
    return f"(CASE WHEN ({x}) > 0 THEN ln({x}) END)"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


Stage = dict[str, str]


def staged(base: str, stages: list[Stage], select: str, ctes: str = "", tail: str = "") -> str:
    """WITH base tables, then one CTE per stage that adds columns, then the final projection."""
    parts = [ctes.strip()] if ctes else []
    current = base
    for i, stage in enumerate(stages):
        columns = ", ".join(f"{expression} AS {name}" for name, expression in stage.items())
        parts.append(f"stage{i} AS (SELECT *, {columns} FROM {current})")
        current = f"stage{i}"
    head = "WITH " + ",\n".join(parts) if parts else ""
    return f"{head}\nSELECT {select} FROM {current} {tail}".strip()


LEVELS = range(1, 11)
STOCK = "PARTITION BY tscode, date ORDER BY time"
WHOLE = "(PARTITION BY tscode, date ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _levels(side: str, depth: int, weighted: bool = False) -> str:
    return "(" + " + ".join(f"{side}_price{i} * {side}_volume{i}" + (f" * {depth + 1 - i}" if weighted else "")
                            for i in range(1, depth + 1)) + ")"


TICKS = f"""
daily AS (
  SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS cents,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units,
    CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) AS BIGINT) AS paid,
    count(*) AS trades,
    {', '.join(f'''CAST(sum(CASE WHEN l_linestatus = '{flag}' THEN CAST(round(l_extendedprice * 100) AS BIGINT) END) AS DOUBLE) AS {side}_cents,
    CAST(sum(CASE WHEN l_linestatus = '{flag}' THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS {side}_units'''
               for side, flag in (('bid', 'O'), ('ask', 'F')))}
  FROM lineitem GROUP BY ALL),
placed AS (
  SELECT *, CAST(date_trunc('quarter', day) AS DATE) AS date,
    CAST(day - CAST(date_trunc('quarter', day) AS DATE) AS BIGINT) AS d FROM daily),
quotes AS (
  SELECT CASE l_suppkey % 4 WHEN 0 THEN '600' WHEN 1 THEN '000' WHEN 2 THEN '300' ELSE '688' END
         || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS tscode, date,
    CASE WHEN d < 16 THEN 33300 + d * 18 WHEN d < 32 THEN 33600 + (d - 16) * 18
         WHEN d < 62 THEN 34200 + (d - 32) * 240 ELSE 46800 + (d - 62) * 240 END AS second,
    cents / 100.0::DOUBLE / units AS price,
    CASE WHEN d >= 28 AND units % 7 <> 0 THEN units ELSE 0 END AS volume,
    CASE WHEN d >= 28 AND units % 7 <> 0 THEN paid ELSE 0 END AS paid,
    CASE WHEN d >= 28 AND units % 7 <> 0 THEN trades ELSE 0 END AS trades,
    coalesce(bid_cents / 100.0::DOUBLE / bid_units, 0.0) AS bid_price, coalesce(bid_units, 0) AS bid_volume,
    coalesce(ask_cents / 100.0::DOUBLE / ask_units, 0.0) AS ask_price, coalesce(ask_units, 0) AS ask_volume
  FROM placed),
timed AS (
  SELECT *, printf('%02d:%02d:%02d.000', second // 3600, second % 3600 // 60, second % 60) AS time,
    paid / 10000.0::DOUBLE AS amount FROM quotes),
booked AS (
  SELECT tscode, date, time, price, volume, amount,
    CAST(sum(trades) OVER w AS BIGINT) AS transaction_number,
    CAST(sum(volume) OVER w AS BIGINT) AS daily_accumulated_volume,
    CAST(sum(paid) OVER w AS DOUBLE) / 10000.0::DOUBLE AS daily_amount,
    max(price) OVER w AS high, min(price) OVER w AS low, first_value(price) OVER w AS open,
    {', '.join(f"coalesce(lag({s}_{f}, {i - 1}) OVER w, 0) AS {s}_{f}{i}" for s in ('ask', 'bid') for f in ('price', 'volume') for i in LEVELS)}
  FROM timed WINDOW w AS (PARTITION BY tscode, date ORDER BY time)),
closes AS (
  SELECT tscode, date, lag(last_price) OVER (PARTITION BY tscode ORDER BY date) AS previous_close
  FROM (SELECT tscode, date, arg_max(price, time) AS last_price FROM booked GROUP BY ALL)),
totals AS (
  SELECT booked.*, coalesce(previous_close, open) AS close,
    {', '.join("(" + " + ".join(f"{s}_volume{i}" for i in LEVELS) + f") AS total_{s}_volume" for s in ('bid', 'ask'))}
  FROM booked JOIN closes USING (tscode, date)),
ticks AS (
  SELECT *, {', '.join(f"coalesce({_levels(s, 10)} / nullif(total_{s}_volume, 0), 0.0) AS weighted_average_{s}_price" for s in ('bid', 'ask'))},
    {', '.join(f"{_levels(s, d)} AS grade{d}_{s}_amount" for d in (10, 5) for s in ('bid', 'ask'))}
  FROM totals)"""

MEMBERS = """
constituents AS (
  SELECT r_name AS product,
    CASE s_suppkey % 4 WHEN 0 THEN '600' WHEN 1 THEN '000' WHEN 2 THEN '300' ELSE '688' END
      || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS tscode,
    CASE WHEN s_suppkey % 2 = 1 THEN DATE '1998-01-01' ELSE DATE '1990-01-01' END AS start_date,
    DATE '2030-12-31' AS end_date
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def tick_second(time: str = "time") -> str:
    return (f"(CAST(substr({time}, 1, 2) AS BIGINT) * 3600 + CAST(substr({time}, 4, 2) AS BIGINT) * 60 "
            f"+ CAST(substr({time}, 7, 2) AS BIGINT))")


def clock(second: str) -> str:
    return f"printf('%02d:%02d:%02d.000', ({second}) // 3600, ({second}) % 3600 // 60, ({second}) % 60)"


RAW = TICKS + f""",
numbered AS (SELECT *, CAST(substr(tscode, 4) AS BIGINT) AS num, {tick_second()} AS sec FROM ticks),
keyed AS (SELECT *, (num * 31 + sec // 3) % 97 AS k FROM numbered),
moved AS (
  SELECT * REPLACE (
    CASE WHEN time = '11:26:00.000' AND num % 3 = 0 THEN '11:31:00.000'
         WHEN time = '11:26:00.000' AND num % 3 = 1 THEN '11:30:00.000'
         WHEN time = '14:56:00.000' AND num % 5 = 0 THEN '15:00:03.000'
         WHEN time = '14:56:00.000' AND num % 5 < 3 THEN '15:00:00.000'
         WHEN time < '09:30:00.000' THEN time
         ELSE {clock("sec + CASE WHEN k % 7 = 2 THEN 1 WHEN k % 7 = 3 THEN 2 ELSE 0 END")} END AS time,
    CASE WHEN k % 19 = 4 THEN 0.0 ELSE price END AS price,
    CASE WHEN k % 23 = 7 THEN 0 ELSE transaction_number END AS transaction_number,
    CASE WHEN k % 29 = 8 AND volume = 0 THEN 10 ELSE volume END AS volume) FROM keyed),
raw AS (
  SELECT * EXCLUDE (copy, volume), CASE WHEN copy = 1 AND k % 20 = 3 THEN 0 ELSE volume END AS volume,
    sec * 2 + copy AS tick_order
  FROM (SELECT *, unnest(CASE WHEN k % 10 = 3 THEN [0, 1] ELSE [0] END) AS copy FROM moved))"""

CLEAN = RAW + """,
trading AS (
  SELECT * FROM raw WHERE time >= '09:15:00.000'
    AND NOT (time > '15:00:00.000' AND (price = 0 OR transaction_number = 0))
    AND NOT (time > '11:30:00.000' AND time < '13:00:00.000')),
crowd AS (
  SELECT *, count(*) OVER s AS n, max(CASE WHEN volume > 0 THEN 1 ELSE 0 END) OVER s AS has_trade,
    row_number() OVER (PARTITION BY tscode, date, time ORDER BY CASE WHEN volume = 0 THEN 0 ELSE 1 END, tick_order) AS rn
  FROM trading WINDOW s AS (PARTITION BY tscode, date, time)),
clean AS (
  SELECT * EXCLUDE (n, has_trade, rn) FROM crowd
  WHERE NOT (n > 1 AND time >= '09:25:00' AND volume = 0 AND (has_trade = 1 OR rn = 1)))"""

IN_SESSION = ("(time >= '09:30:00.000' AND time <= '15:00:00.000' AND (time >= '13:00:00.000' OR time <= '11:30:00.000'))")
ROWS = "PARTITION BY tscode, date ORDER BY time, tick_order"
