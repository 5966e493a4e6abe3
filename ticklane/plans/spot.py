"""Queries of the order-book factors over the constituents of each region."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticklane.operators import cross_section as cs
from ticklane.plans import oracle as o
from ticklane.plans.catalog import add, rounded

LENGTHS = (2, 5)
SIZE = 20.0
DAY = "PARTITION BY product, date, time > '09:30:00.000' ORDER BY time"
OPEN = "time > '09:30:00.000'"

total = lambda side: f"total_{side}_volume * weighted_average_{side}_price"
BOOK = {("BID", "TOTAL"): total("bid"), ("ASK", "TOTAL"): total("ask"),
        ("BID", "10_GRADE"): "grade10_bid_amount", ("ASK", "10_GRADE"): "grade10_ask_amount",
        ("BID", "5_GRADE"): "grade5_bid_amount", ("ASK", "5_GRADE"): "grade5_ask_amount"}

PRICE_MOVE = {"dp": f"coalesce(price - {o.lag('price', 1, o.STOCK)}, 0)"}
PER_TRADE = [{**PRICE_MOVE, "dn": f"coalesce(transaction_number - {o.lag('transaction_number', 1, o.STOCK)}, 0)"},
             {"per": "CASE WHEN dn = 0 THEN 0 ELSE amount / dn END"},
             {"up": "CASE WHEN dp > 0 THEN per ELSE 0 END", "down": "CASE WHEN dp < 0 THEN per ELSE 0 END"}]
STAGE1 = "time >= '09:15:00.000' AND time <= '09:20:00.000'"
STAGE2 = "time >= '09:20:00.000' AND time <= '09:25:00.000'"
AUCTION = [{
    "a1": f"arg_min(ask_price1, CASE WHEN {STAGE1} THEN time END) OVER {o.WHOLE}",
    "z1": f"arg_max(ask_price1, CASE WHEN {STAGE1} THEN time END) OVER {o.WHOLE}",
    "a2": f"arg_min(ask_price1, CASE WHEN {STAGE2} THEN time END) OVER {o.WHOLE}",
    "op": f"arg_min(price, CASE WHEN time <= '09:30:00.000' AND volume > 0 THEN time END) OVER {o.WHOLE}",
    "ot": f"min(CASE WHEN time <= '09:30:00.000' AND volume > 0 THEN time END) OVER {o.WHOLE}"}]


def spot_sql(stages: list[o.Stage], sums: dict[str, str], values: list[o.Stage], outputs: dict[str, str],
             session: bool = True, extra: str = "", tail: str = "") -> str:
    ctes = o.TICKS.strip() + ",\n" + o.MEMBERS.strip()
    current = "ticks"
    for i, stage in enumerate(stages):
        ctes += f",\ntick{i} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {current})"
        current = f"tick{i}"
    agg = ", ".join(f"{e} AS {n}" for n, e in sums.items())
    ctes += (f",\ngrouped AS (SELECT product, date, time, {agg} FROM {current} t JOIN constituents c "
             f"ON t.tscode = c.tscode AND t.date BETWEEN c.start_date AND c.end_date "
             f"{'WHERE ' + OPEN if session else ''} GROUP BY product, date, time)")
    if extra:
        ctes += ",\n" + extra
    select = "product, CAST(date AS VARCHAR) AS date, time, " + ", ".join(
        f"{o.r(f'CAST({e} AS DOUBLE)')} AS {n}" for n, e in outputs.items())
    return o.staged(tail or "grouped", values, select, ctes)


def share(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} = 0 THEN 0 ELSE {top} / {bottom} END"


def _spot(code: str, sql: str, params: tuple[int, ...] | None = None) -> None:
    number = "aux" if "AUXILIARY" in code else code[7:].lower()
    factor = cs.SPOT_FACTORS[code]
    params = LENGTHS if factor.params else None
    keys = list(cs.GRADE_AMOUNTS) if number == "aux" else factor.keys(params or ())

    def build(market):
        table = cs.spot_factors(market.stock_ticks(), market.constituents(), {code: params}, size=SIZE)
        return table.select("product", F.col("date").cast("string").alias("date"), "time",
                            *[rounded(k, 6, f"value{i}") for i, k in enumerate(keys)])

    add(f"d{number}", build, sql)


def _outputs(count: int) -> dict[str, str]:
    return {f"value{i}": f"v{i}" for i in range(count)}


def _simple(code: str, sums: dict[str, str], value: str, stages=(), session: bool = True) -> None:
    _spot(code, spot_sql(list(stages), sums, [{"v0": value}], _outputs(1), session))


def warm(rule: str, x: str, n: int, first: str = "0") -> str:
    over = o.frame(n, DAY)
    if rule == "DIFFERENCE":
        return f"{x} - coalesce({o.lag(x, n, DAY)}, first_value({x}) OVER ({DAY}))"
    if rule == "DELTA":
        return f"{x} - {o.lag(x, n, DAY)}"
    if rule == "MEAN":
        return f"avg({x}) {over}"
    return (f"CASE WHEN count({x}) {over} = {n} THEN stddev_samp({x}) {over} "
            f"WHEN row_number() OVER ({DAY}) = 1 THEN {first} ELSE stddev_pop({x}) {over} END")


COMMISSION = {
    "001_TOTAL_COMMISSION_RATIO": (total("bid"), total("ask")),
    "002_10_GRADE_COMMISSION_RATIO": ("grade10_bid_amount", "grade10_ask_amount"),
    "003_10_GRADE_WEIGHTED_COMMISSION_RATIO": (o._levels("bid", 10, True), o._levels("ask", 10, True)),
    "004_5_GRADE_COMMISSION_RATIO": ("grade5_bid_amount", "grade5_ask_amount"),
    "005_5_GRADE_WEIGHTED_COMMISSION_RATIO": (o._levels("bid", 5, True), o._levels("ask", 5, True)),
}


def _moved(bid: str, ask: str) -> dict[str, str]:
    up = f"({bid} + CASE WHEN dp > 0 THEN amount ELSE 0 END)"
    down = f"({ask} + CASE WHEN dp < 0 THEN amount ELSE 0 END)"
    return {"top": f"sum({up})", "den": f"sum({up} + {down})"}


# base value of a factor other factors build on: (tick stages, sums, ratio)
BASES: dict[str, tuple[list[o.Stage], dict[str, str], str]] = {
    number[:3]: ([], {"top": f"sum({bid})", "den": f"sum({bid} + {ask})"}, share("top", "den"))
    for number, (bid, ask) in COMMISSION.items()}
BASES["016"] = ([PRICE_MOVE], _moved("grade10_bid_amount", "grade10_ask_amount"), share("top", "den"))
BASES["023"] = ([PRICE_MOVE], _moved("bid_price1 * bid_volume1", "ask_price1 * ask_volume1"), share("top", "den"))
BASES["017"] = ([PRICE_MOVE], {"top": "sum(sign(dp) * amount)", "den": "sum(amount)"}, share("top", "den"))


def register() -> None:
    by_number = {code[7:10]: code for code in cs.SPOT_FACTORS if code.startswith("FCT_02")}
    _spot("FCT_AUXILIARY_FILE_GENERATION", spot_sql(
        [], {f"v{i}": f"avg({name})" for i, name in enumerate(cs.GRADE_AMOUNTS)}, [], _outputs(4)))
    for number, (stages, sums, value) in BASES.items():
        _simple(by_number[number], sums, value, stages)
    derived = {"021": ("001", "DELTA"), "035": ("001", "DIFFERENCE"), "036": ("002", "DIFFERENCE"),
               "037": ("004", "DIFFERENCE"), "040": ("002", "MEAN"), "041": ("002", "STD"), "042": ("004", "MEAN"),
               "043": ("004", "STD"), "044": ("003", "DIFFERENCE"), "045": ("003", "MEAN"), "046": ("003", "STD"),
               "047": ("005", "DIFFERENCE"), "048": ("005", "MEAN"), "049": ("005", "STD"), "056": ("016", "MEAN"),
               "057": ("016", "STD"), "058": ("017", "MEAN"), "059": ("017", "STD"), "060": ("023", "MEAN"),
               "061": ("023", "STD")}
    for number, (base, rule) in derived.items():
        stages, sums, value = BASES[base]
        _spot(by_number[number], spot_sql(stages, sums, [
            {"base": value}, {f"v{i}": warm(rule, "base", n) for i, n in enumerate(LENGTHS)}], _outputs(2)))

    started = "time >= '09:30:00.000'"
    session = "PARTITION BY tscode, date, time >= '09:30:00.000' ORDER BY time"
    _spot(by_number["006"], spot_sql(
        [{f"ch{i}": f"CASE WHEN {started} THEN price - coalesce({o.lag('price', n, session)}, close) ELSE 0 END"
          for i, n in enumerate(LENGTHS)}],
        {f"v{i}": f"avg(CASE WHEN ch{i} > 0 THEN 1.0::DOUBLE ELSE 0.0 END)" for i in range(2)}, [], _outputs(2)))
    _simple(by_number["007"], {"v": "avg((bid_price1 - ask_price1) / nullif(bid_price1 + ask_price1, 0))"}, "v")
    _simple(by_number["018"], {"v": "avg(CASE WHEN volume = 0 THEN 1.0::DOUBLE ELSE 0.0 END)"}, "v")
    _simple(by_number["038"], {"v": "avg(CASE WHEN price > close THEN 1.0::DOUBLE ELSE 0.0 END)"}, "v")
    second = "coalesce((op - a2) / nullif(a2, 0), 0)"
    first = "coalesce((z1 - a1) / nullif(a1, 0), 0)"
    _simple(by_number["008"], {"v": f"avg(CASE WHEN {started} AND a2 IS NOT NULL AND op IS NOT NULL THEN {second} "
                                    f"ELSE 0 END)"}, "v", AUCTION, session=False)
    _simple(by_number["009"], {"v": f"avg(CASE WHEN {started} AND a2 IS NOT NULL AND op IS NOT NULL AND a1 IS NOT NULL "
                                    f"THEN {second} - {first} ELSE 0 END)"}, "v", AUCTION, session=False)
    volatility = [*AUCTION, {"ins": "(time >= '09:20:00.000' AND time <= ot)", "mid": "(ask_price1 + bid_price1) / 2"},
                  {"fw": f"CASE WHEN ins AND {o.lead('ins', 1, o.STOCK)} THEN ({o.lead('mid', 1, o.STOCK)} - mid) "
                         f"/ nullif(mid, 0) END"},
                  {"vol": f"CASE WHEN NOT {started} OR coalesce(max(CAST(ins AS INT)) OVER {o.WHOLE}, 0) = 0 THEN 0 "
                          f"ELSE stddev_samp(fw) OVER {o.WHOLE} END"}]
    _simple(by_number["010"], {"v": "avg(vol)"}, "v", volatility, session=False)
    per_day = "(PARTITION BY product, date)"
    stage_value = f"sum(b) OVER {per_day} / nullif(sum(b) OVER {per_day} + sum(a) OVER {per_day}, 0)"
    _simple(by_number["011"], {s[0]: f"sum(CASE WHEN {STAGE1} THEN {s}_price1 * ({s}_volume1 + {s}_volume2) END)"
                               for s in ("bid", "ask")}, stage_value, session=False)
    _simple(by_number["012"], {
        s[0]: f"sum(CASE WHEN time >= '09:20:00.000' AND time <= ot THEN CASE WHEN bid_price2 = 0 THEN "
              f"{s}_price1 * ({s}_volume1 + {s}_volume2) ELSE {o._levels(s, 10)} END END)" for s in ("bid", "ask")},
        stage_value, AUCTION, session=False)
    _simple(by_number["022"], {"v": "avg(oy)"}, "v", [
        {"oy": f"arg_min(bid_price1 / close, CASE WHEN time >= '09:15:00.000' AND time < '09:20:00.000' AND "
               f"bid_price1 <> 0 AND close <> 0 THEN time END) OVER {o.WHOLE}"}], session=False)
    for number, side in (("013", "bid"), ("014", "ask")):
        extra = ("dates AS (SELECT DISTINCT product, date FROM grouped), "
                 f"means AS (SELECT product, date, avg(m) AS dm FROM grouped WHERE {OPEN} GROUP BY ALL), "
                 "usual AS (SELECT product, date, avg(dm) OVER (PARTITION BY product ORDER BY date ROWS BETWEEN 3 "
                 "PRECEDING AND 1 PRECEDING) AS u FROM dates LEFT JOIN means USING (product, date)), "
                 "joined AS (SELECT * FROM grouped JOIN usual USING (product, date))")
        _spot(by_number[number], spot_sql([], {"m": f"avg(grade5_{side}_amount)"},
                                          [{"v0": "CASE WHEN m > u * 1.5 THEN 1.0 ELSE 0.0 END"}], _outputs(1),
                                          session=False, extra=extra, tail="joined"))
    stages, sums, value = BASES["001"]
    extra = (f"valued AS (SELECT *, {value} AS base FROM grouped), "
             "dates AS (SELECT product, date, lag(date) OVER (PARTITION BY product ORDER BY date) AS prev "
             "FROM (SELECT DISTINCT product, date FROM valued)), "
             "joined AS (SELECT v.*, p.base AS before FROM valued v JOIN dates d USING (product, date) LEFT JOIN valued p "
             "ON p.product = v.product AND p.date = d.prev AND p.time = v.time)")
    _spot(by_number["015"], spot_sql(stages, sums, [{"v0": "coalesce(base / nullif(before, 0), 0)"}], _outputs(1),
                                     extra=extra, tail="joined"))
    so_far = f"OVER ({o.STOCK})"
    _simple(by_number["019"], {"top": "sum(ru)", "den": "sum(ru + rd)"}, share("top", "den"),
            [*PER_TRADE, {"ru": f"sum(up) {so_far}", "rd": f"sum(down) {so_far}"}])
    _spot(by_number["020"], spot_sql(
        [*PER_TRADE, {f"{s[0]}{i}": o.full("sum", s, n, o.STOCK) for i, n in enumerate(LENGTHS) for s in ("up", "down")}],
        {f"{k}{i}": f"coalesce(sum({e}), 0)" for i in range(2) for k, e in (("top", f"u{i}"), ("den", f"u{i} + d{i}"))},
        [{f"v{i}": share(f"top{i}", f"den{i}") for i in range(2)}], _outputs(2)))
    limit = ("CASE WHEN (tscode LIKE '68%' OR tscode LIKE '300%') AND strftime(t.date, '%Y%m%d') >= '20200824' THEN 0.2 "
             "WHEN tscode LIKE '8%' THEN 0.3 ELSE 0.1 END").replace("tscode", "t.tscode")
    for number, sign in (("024", ">"), ("025", "<")):
        ret = "((price - close) / nullif(close, 0))"
        _simple(by_number[number], {"v": f"sum(CASE WHEN {ret} {sign} 0 AND abs(abs({ret}) - {limit}) < 0.001 "
                                         f"THEN 1.0::DOUBLE ELSE 0.0 END)"}, f"v / {SIZE}", session=False)
    for numbers, rule in ((range(26, 32), "MEAN"), (range(50, 56), "STD")):
        for number in numbers:
            code = by_number[f"{number:03d}"]
            side = "BID" if "_BID_" in code else "ASK"
            depth = next(d for d in ("TOTAL", "10_GRADE", "5_GRADE") if f"_{d}_" in code)
            _spot(code, spot_sql([], {"am": "sum(amount)", "bk": f"sum({BOOK[side, depth]})"}, [
                {"base": share("am", "bk")}, {f"v{i}": warm(rule, "base", n, "base") for i, n in enumerate(LENGTHS)}], _outputs(2)))
    for number, depth in (("032", "TOTAL"), ("033", "10_GRADE"), ("034", "5_GRADE")):
        _spot(by_number[number], spot_sql(
            [{f"{s}{i}": o.full("stddev_samp", f"({BOOK[s, depth]})", n, o.STOCK)
              for i, n in enumerate(LENGTHS) for s in ("BID", "ASK")}],
            {f"{s}{i}": f"sum({s}{i})" for i in range(2) for s in ("BID", "ASK")},
            [{f"v{i}": f"coalesce(BID{i} / nullif(ASK{i}, 0), 0)" for i in range(2)}], _outputs(2), session=False))
    for number, days, fall_back in (("039", 4, False), ("062", 3, True)):
        over = f"OVER (PARTITION BY tscode ORDER BY date ROWS BETWEEN {days} PRECEDING AND 1 PRECEDING)"
        usual = (f"(SELECT tscode AS k, date AS kd, sum(a) {over} / nullif(sum(n) {over}, 0) AS usual, "
                 f"count(a) {over} > 0 AS known FROM (SELECT tscode, date, arg_max(daily_amount, time) AS a, "
                 f"arg_max(transaction_number, time) AS n FROM ticks GROUP BY ALL))")
        level = ("CASE WHEN known THEN usual ELSE coalesce(daily_amount / nullif(transaction_number, 0), 0) END"
                 if fall_back else "usual")
        sql = spot_sql([*PER_TRADE], {"top": "sum(lu)", "den": "sum(lu + ld)"},
                       [{"v0": share("top", "den")}], _outputs(1), session=False)
        # the usual trade size is joined in before grouping
        big = f"dn <> 0 AND per > 2 * ({level})"
        sql = sql.replace("FROM tick2 t JOIN constituents", (
            f"FROM (SELECT *, CASE WHEN {big} AND dp > 0 THEN amount ELSE 0 END AS lu, "
            f"CASE WHEN {big} AND dp < 0 THEN amount ELSE 0 END AS ld FROM tick2 JOIN {usual} ON k = tscode AND kd = date) "
            "t JOIN constituents"))
        _spot(by_number[number], sql)
