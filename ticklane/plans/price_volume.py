"""Queries of the indicators and price-volume factors over hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticklane.functions.series import SeriesColumns
from ticklane.operators import indicators as ind
from ticklane.operators import price_volume as pv
from ticklane.plans import oracle as o
from ticklane.plans.catalog import add, rounded

CHUNK = 400
KEYS = ["instrument"]


def _indicator(name: str, record, stages: list[o.Stage], result: str, digits: int = 6) -> None:
    """``record`` returns the recorded column names; ``result`` names the SQL columns to compare."""
    outputs = result.split()

    def build(market):
        columns = SeriesColumns()
        recorded = record(columns)
        recorded = [recorded] if isinstance(recorded, str) else list(recorded)
        table = columns.apply(market.bars(), KEYS, chunk_rows=CHUNK, keep=recorded)
        return table.select("instrument", "datetime",
                            *[rounded(F.col(c), digits, alias) for c, alias in zip(recorded, outputs)])

    select = "instrument, datetime, " + ", ".join(f"{o.r(c, digits)} AS {c}" for c in outputs)
    add(name, build, o.staged("bars", stages, select, o.BARS))


TR_STAGE = {"tr": f"greatest(high - low, coalesce(abs(high - {o.lag('close')}), high - low), "
                  f"coalesce(abs(low - {o.lag('close')}), high - low))"}


def ema_sql(source_ctes: str, base: str, value: str, span: int, name: str) -> str:
    """Recursive smoothing as a fold over all values so far."""
    alpha = 2 / (span + 1)
    return (f"{source_ctes}, {name} AS (SELECT instrument, pos, list_reduce(list({value}) OVER ({o.SERIES}), "
            f"lambda y, x: {alpha!r} * x + {1 - alpha!r} * y) AS {name} FROM {base})")


def _poly_stage(n: int, order: int, value: str = "close") -> list[o.Stage]:
    """Least squares on centred row numbers, even and odd moments solved apart."""
    c = (n - 1) / 2
    u = [i - c for i in range(n)]
    s2, s4, s6 = (sum(v ** k for v in u) for k in (2, 4, 6))
    over = o.frame(n)
    moment = lambda k: (f"list_sum([y * power(i - 1 - {c}, {k}) for y, i in list({value}) {over}])")
    full = f"count({value}) {over} = {n}"
    stage1 = {f"m{k}": f"CASE WHEN {full} THEN {moment(k)} END" for k in range(order + 1)}
    stage1["ys"] = f"CASE WHEN {full} THEN list({value}) {over} END"
    det = n * s4 - s2 * s2
    stage2 = {"p0": f"(m0 * {s4!r} - m2 * {s2!r}) / {det!r}", "p2": f"(m2 * {n} - m0 * {s2!r}) / {det!r}"}
    if order == 2:
        stage2["p1"] = f"m1 / {s2!r}"
        stage2["p3"] = "0.0"
    else:
        odd = s2 * s6 - s4 * s4
        stage2["p1"] = f"(m1 * {s6!r} - m3 * {s4!r}) / {odd!r}"
        stage2["p3"] = f"(m3 * {s2!r} - m1 * {s4!r}) / {odd!r}"
    value_at = lambda x: f"(p0 + p1 * ({x}) + p2 * power({x}, 2) + p3 * power({x}, 3))"
    stage3 = {
        "fit": value_at(repr(c)),
        "se": f"sqrt(list_sum([power(y - {value_at(f'i - 1 - {c}')}, 2) for y, i in ys]) / {n - 1}) / sqrt({n})",
    }
    return [stage1, stage2, stage3]


def _register_indicators() -> None:
    n = 10
    _indicator("i01_moving_average", lambda c: [ind.moving_average(c, n), ind.moving_average(c, 50)],
               [{"ma10": o.full("avg", "close", n), "ma50": o.full("avg", "close", 50)}], "ma10 ma50")
    _indicator("i02_weighted_moving_average", lambda c: ind.weighted_moving_average(c, n),
               [{"wma": o.ratio(o.full("sum", "close * volume", n), o.full("sum", "volume", n))}], "wma")
    ema = ema_sql(o.BARS, "bars", "close", n, "ema")
    add("i03_exp_moving_average",
        lambda market: _one(market, lambda c: ind.exponential_moving_average(c, n), "ema"),
        f"WITH {ema} SELECT instrument, datetime, {o.r('ema')} AS ema FROM bars JOIN ema USING (instrument, pos)")
    _indicator("i04_standard_deviation", lambda c: ind.standard_deviation(c, n),
               [{"std": o.full("stddev_samp", "close", n)}], "std")
    _indicator("i05_variance", lambda c: ind.variance(c, n), [{"variance": o.full("var_samp", "close", n)}], "variance")
    _indicator("i06_skewness", lambda c: ind.skewness(c, n), [{"skew": o.full("skewness", "close", n)}], "skew", 4)
    _indicator("i07_kurtosis", lambda c: ind.kurtosis(c, n), [{"kurt": o.full("kurtosis", "close", n)}], "kurt", 4)
    _indicator("i08_median", lambda c: ind.median(c, n), [{"mid": o.full("median", "close", n)}], "mid")
    _indicator("i09_quantile",
               lambda c: [ind.quantile(c, n, "close", p) for p in (0.25, 0.5, 0.9)],
               [{f"q{i}": o.full("quantile_cont", "close", n, extra=f", {p}")
                 for i, p in enumerate((0.25, 0.5, 0.9))}], "q0 q1 q2")
    _indicator("i10_true_range", ind.true_range, [TR_STAGE], "tr")
    _indicator("i11_average_true_range", lambda c: ind.average_true_range(c, n),
               [TR_STAGE, {"atr": o.full("avg", "tr", n)}], "atr")
    over = o.frame(n)
    guard = f"count(close) {over} = {n}"
    line = lambda x: f"(regr_intercept(close, pos) {over} + regr_slope(close, pos) {over} * ({x}))"
    _indicator("i12_linear_regression",
               lambda c: [ind.linear_regression(c, n, result=k) for k in ("slope", "intercept", "predict", "deviation")],
               [{"slope": f"CASE WHEN {guard} THEN regr_slope(close, pos) {over} END",
                 "intercept": f"CASE WHEN {guard} THEN {line(f'pos - {n}')} END",
                 "predict": f"CASE WHEN {guard} THEN {line('pos')} END",
                 "deviation": f"CASE WHEN {guard} THEN close - {line('pos')} END"}],
               "slope intercept predict deviation")
    rise = lambda slope, intercept, fitted: (fitted - intercept) / F.abs(intercept)
    rise.__name__ = "rise"
    _indicator("h05_function_of_fitted_line", lambda c: ind.linear_regression(c, n, result=rise),
               [{"rise": f"CASE WHEN {guard} THEN ({line('pos')} - {line(f'pos - {n}')}) / abs({line(f'pos - {n}')}) END"}], "rise")
    _indicator("i12_linear_regression_on_column",
               lambda c: ind.linear_regression(c, n, "close", "volume"),
               [{"slope": f"CASE WHEN {guard} THEN CASE WHEN min(volume) {over} = max(volume) {over} THEN 0 "
                          f"ELSE regr_slope(close, volume) {over} END END"}], "slope")
    _indicator("i13_polynomial_regression", lambda c: ind.polynomial_regression(c, n),
               _poly_stage(n, 2), "fit")
    _indicator("i14_adx", lambda c: ind.adx(c, 14, 6), _adx_stages(14, 6), "adx")
    _indicator("i16_rsi", lambda c: ind.rsi(c, 24), [], "rsi")  # SQL replaced below
    from ticklane.plans.catalog import SQL
    SQL["i16_rsi"] = rsi_sql([24], "instrument, datetime, " + o.r("rsi24") + " AS rsi")
    add("i15_obv", lambda market: pv.on_balance_volume(market.bars(), KEYS, "date", chunk_rows=CHUNK).select(
        "instrument", "datetime", F.col(pv.OBV_CODE).cast("bigint").alias("obv")),
        o.staged("bars", [SIGNED, {"obv": f"sum(signed) OVER ({o.SERIES})"}],
                 "instrument, datetime, CAST(obv AS BIGINT) AS obv", o.BARS))
    spread = lambda values: values.max() - values.min()
    add("w04_rolling_custom_function",
        lambda market: _one(market, lambda c: c.rolling_apply("close", n, spread, "reach"), "reach"),
        o.staged("bars", [{"reach": o.full("max", "close", n) + " - " + o.full("min", "close", n)}],
                 "instrument, datetime, " + o.r("reach") + " AS reach", o.BARS))
    _indicator("w02_windows_of_default_lengths", lambda c: [ind.moving_average(c, 500), c.rolling("sum", "volume", 500), c.rolling("std", "close", 500)],
               [{"mean500": o.full("avg", "close", 500), "sum500": o.full("sum", "volume", 500),
                 "std500": o.full("stddev_samp", "close", 500)}], "mean500 sum500 std500")
    _indicator("w02_wide_window_by_running_sum", lambda c: [ind.moving_average(c, 300), c.rolling("sum", "volume", 300)],
               [{"mean300": o.full("avg", "close", 300), "sum300": o.full("sum", "volume", 300)}], "mean300 sum300")


def _one(market, record, alias: str, digits: int = 6):
    columns = SeriesColumns()
    recorded = record(columns)
    table = columns.apply(market.bars(), KEYS, chunk_rows=CHUNK, keep=[recorded])
    return table.select("instrument", "datetime", rounded(F.col(recorded), digits, alias))


SIGNED = {"signed": f"CASE WHEN close > {o.lag('close')} THEN volume WHEN close < {o.lag('close')} THEN -volume "
                    f"ELSE 0 END"}


def _adx_stages(n: int, m: int) -> list[o.Stage]:
    return [
        TR_STAGE,
        {"up": f"high - {o.lag('high')}", "down": f"{o.lag('low')} - low"},
        {"dmp": "CASE WHEN up > down THEN up WHEN up <= down THEN 0 END",
         "dmm": "CASE WHEN down > up THEN down WHEN down <= up THEN 0 END"},
        {"dip": o.ratio(o.full("avg", "dmp", n), o.full("avg", "tr", n)),
         "dim": o.ratio(o.full("avg", "dmm", n), o.full("avg", "tr", n))},
        {"dx": o.ratio("abs(dip - dim) * 100", "dip + dim")},
        {"adx": o.full("avg", "dx", m)},
    ]


def rsi_sql(lengths: list[int], select: str, stages: list[o.Stage] | None = None) -> str:
    ctes = (o.BARS + f""",
moves AS (SELECT *, CASE WHEN close > {o.lag('close')} THEN close - {o.lag('close')} ELSE 0.0 END AS rise,
  CASE WHEN close < {o.lag('close')} THEN {o.lag('close')} - close ELSE 0.0 END AS fall FROM bars)""")
    joined = "moves"
    columns = []
    for n in lengths:
        for side in ("rise", "fall"):
            ctes = ema_sql(ctes, "moves", side, n, f"{side}{n}")
            joined += f" JOIN {side}{n} USING (instrument, pos)"
        columns.append(f"CASE WHEN fall{n} = 0 AND rise{n} > 0 THEN 100 "
                       f"ELSE 100 - 100 / (1 + rise{n} / nullif(fall{n}, 0)) END AS rsi{n}")
    ctes += f", rsis AS (SELECT moves.*, {', '.join(columns)} FROM {joined})"
    return o.staged("rsis", stages or [], select, ctes)


# --- factors: SQL stages per factor and length, the last name is the raw factor value ----------------------------

def _mean_price() -> o.Stage:
    return {"mp": "(open + close + high + low) / 4"}


def _beyond(x: str, n: int, sign: str) -> o.Stage:
    over = o.frame(n)
    return {"place": f"CASE WHEN count({x}) {over} = {n} THEN coalesce(list_position([y {sign} {x} for y in "
                     f"list({x}) {over}], true), 0) END",
            }


def _beyond_value(n: int) -> o.Stage:
    return {"raw": f"100.0 * ((CASE WHEN place = 0 THEN {n + 1} ELSE {n} - place END) - 1) / {n} - 50"}


def _support_stages(n: int) -> list[o.Stage]:
    over = o.frame(n)
    inside = lambda i: f"CASE WHEN band = {i} THEN mp END"
    return [
        {"hh": o.full("max", "high", n), "ll": o.full("min", "low", n), "mp": "(open + close + high + low) / 4"},
        {"top": o.lag("hh"), "bottom": o.lag("ll")},
        {"band": "CASE WHEN mp < bottom THEN NULL WHEN mp < bottom + (top - bottom) / 3 THEN 1 "
                 "WHEN mp < bottom + (top - bottom) / 3 * 2 THEN 2 WHEN mp < bottom + (top - bottom) / 3 * 3 THEN 3 END"},
        {**{f"t{i}": f"coalesce(sum({inside(i)}) {over}, 0)" for i in (1, 2, 3)},
         **{f"n{i}": f"count({inside(i)}) {over}" for i in (1, 2, 3)}},
        {"support": "CASE WHEN bottom IS NULL THEN NULL WHEN greatest(t1, t2, t3) <= 0 THEN close "
                    "WHEN t1 = greatest(t1, t2, t3) THEN t1 / n1 WHEN t2 = greatest(t1, t2, t3) THEN t2 / n2 "
                    "ELSE t3 / n3 END"},
        {"spread": o.full("stddev_samp", "support", n)},
        {"raw": "CASE WHEN abs(close - support) / support > 0.03 THEN 0 WHEN spread IS NOT NULL THEN "
                "(close - support) / greatest(4 * spread, close * 0.004) END"},
    ]


def _filled(stages: list[o.Stage], suffix: str = "") -> list[o.Stage]:
    last = {("raw0" if name == "raw" else name): expression for name, expression in stages[-1].items()}
    return [*stages[:-1], last, {f"base{suffix}": "coalesce(raw0, 0)"}]


def _linear_deviation_stages(n: int) -> list[o.Stage]:
    over = o.frame(n)
    guard = f"count(close) {over} = {n}"
    point = lambda i: f"(a + b * ({i}) / {n - 1})"
    return [
        {"b": f"CASE WHEN {guard} THEN regr_slope(close, pos) {over} END",
         "ys": f"list(close) {over}", "m": f"avg(close) {over}"},
        {"a": f"m - b * {(n + 1) / 2}"},
        {"raw": o.ratio(f"close - {point(n - 1)}",
                        f"(sqrt(list_sum([power(y - {point('i - 1')}, 2) for y, i in ys]) / {n - 1}) / sqrt({n}))")},
    ]


def _stages(number: int, n: int) -> list[o.Stage]:
    """SQL stages of one factor for one length, ending with ``raw``."""
    change = {"chg": f"close - {o.lag('close')}"}
    logc = {"lc": o.ln("close")}
    logchg = {"lchg": o.ln(f"close / {o.lag('close')}")}
    stat = lambda f, x: [{"raw": o.full(f, x, n)}]
    intensity = [TR_STAGE, {"ii": o.ratio("close - open", "tr")}]
    var_ratio = lambda x: {"raw": o.ratio(o.full("var_samp", x, n), o.full("var_samp", x, 2 * n))}
    wma = lambda k: o.ln(o.ratio(o.ratio(o.full("sum", "close * volume", k), o.full("sum", "volume", k)),
                                 o.full("avg", "close", k)))
    fit = lambda k: (f"CASE WHEN count(lc) {o.frame(k)} = {k} THEN CASE WHEN min(lv) {o.frame(k)} = max(lv) {o.frame(k)} "
                     f"THEN 0 ELSE regr_slope(lc, lv) {o.frame(k)} END END")
    logs = {"lc": o.ln("close"), "lv": "CASE WHEN volume > 0 THEN ln(volume) ELSE 0 END"}
    base_change = lambda number_, k: [*_filled(_stages(number_, n)), {"raw": f"base - {o.lag('base', k)}"}]

    def volume_indicator(sign: str) -> list[o.Stage]:
        return [{"pc": f"CASE WHEN volume {sign} {o.lag('volume')} THEN {o.lag('close')} / close ELSE 0.0 END"},
                {"raw": o.ratio(o.full("avg", "pc", n), o.full("stddev_samp", "pc", 2 * n))}]

    normal = [logchg, {"nv": o.ratio("volume", o.full("median", "volume", n)),
                       "q1": o.full("quantile_cont", "lchg", n, extra=", 0.25"),
                       "q2": o.full("median", "lchg", n),
                       "q3": o.full("quantile_cont", "lchg", n, extra=", 0.75")},
              {"np": o.ratio("lchg - q2", "q3 - q1")}]
    adx = _adx_stages(14, 6)
    low_adx, high_adx = o.full("min", "adx", n), o.full("max", "adx", n)
    table = {
        1: [{"hh": o.full("max", "high", n), "ll": o.full("min", "low", n)},
            {"raw": o.ratio("close - (hh + ll) / 2", "hh - ll")}],
        2: [TR_STAGE, {"raw": o.ratio(o.ln(o.ratio("close", o.full("avg", "close", n))),
                                      f"sqrt({n}) * ({o.full('avg', 'tr', 2 * n)})")}],
        3: [TR_STAGE, {"lm": o.ln("(open + close + high + low) / 4")},
            {"raw": o.ratio(f"CASE WHEN count(lm) {o.frame(n)} = {n} THEN regr_slope(lm, pos) {o.frame(n)} END",
                            o.full("avg", "tr", n))}],
        4: _linear_deviation_stages(n),
        5: [*_poly_stage(n, 2), {"raw": "(close - fit) / nullif(se, 0)"}],
        6: [*_poly_stage(n, 3), {"raw": "(close - fit) / nullif(se, 0)"}],
        7: [_mean_price(), {"ls": o.ln(f"mp / {o.lag('mp')}")},
            {"raw": o.ratio(o.ln(f"mp / {o.lag('mp', n - 1)}"), f"({o.full('stddev_samp', 'ls', 2 * n)}) * sqrt({n})")}],
        8: [*_adx_stages(n, 6), {"raw": "adx"}],
        9: [*adx, {"raw": low_adx}],
        10: [*adx, {"raw": f"adx - ({low_adx})"}],
        11: [*adx, {"raw": high_adx}],
        12: [*adx, {"raw": f"({high_adx}) - adx"}],
        13: [*adx, {"raw": f"adx - {o.lag('adx', n)}"}],
        14: [*adx, {"raw": f"adx + {o.lag('adx', 2 * n)} - 2 * {o.lag('adx', n)}"}],
        15: [*intensity, {"raw": o.full("avg", "ii", n)}],
        16: [*intensity, {"raw": f"ii - {o.lag('ii', n)}"}],
        17: [logc, var_ratio("lc")],
        20: [logchg, var_ratio("lchg")],
        23: [TR_STAGE, {"raw": o.ratio(o.full("avg", "tr", n), o.full("avg", "tr", 2 * n))}],
        27: stat("skewness", "close"),
        28: [change, *stat("skewness", "chg")],
        29: stat("kurtosis", "close"),
        30: [change, *stat("kurtosis", "chg")],
        35: [{"raw": o.ratio(o.full("avg", "volume", n), o.full("avg", "volume", 2 * n))}],
        37: [{"raw": wma(n)}],
        38: [{"raw": f"coalesce({wma(n)}, 0) - coalesce({wma(2 * n)}, 0)"}],
        39: [logs, {"raw": fit(n)}],
        41: [logs, {"raw": f"coalesce({fit(n)}, 0) - coalesce({fit(2 * n)}, 0)"}],
        42: volume_indicator(">"),
        44: volume_indicator("<"),
        46: [*normal, {"raw": "nv * np"}],
        47: [*normal, {"raw": "CASE WHEN np >= 0 THEN nv + np WHEN np < 0 THEN -(nv - np) END"}],
        50: [{"hh": o.full("max", "close", n), "top_pos": f"arg_max(pos, (close, pos)) {o.frame(n)}"},
             {"raw": f"CASE WHEN hh IS NOT NULL THEN 100.0 * ((CASE WHEN hh = close THEN {n + 1} ELSE pos - top_pos END) - 1)"
                     f" / {n} - 50 END"}],
        51: [_beyond("close", n, "<"), _beyond_value(n)],
        52: [TR_STAGE, _beyond("tr", n, "<"), _beyond_value(n)],
        53: [TR_STAGE, _beyond("tr", n, ">"), _beyond_value(n)],
        54: [SIGNED, {"raw": f"sum(signed) OVER ({o.SERIES})"}],
        55: [SIGNED, {"obv": f"sum(signed) OVER ({o.SERIES})"}, {"raw": f"obv - {o.lag('obv', n)}"}],
        58: _support_stages(n),
    }
    if number in table:
        return table[number]
    derived = {
        18: lambda: [*_filled(_stages(17, n)), {"raw": o.full("min", "base", n)}],
        19: lambda: [*_filled(_stages(17, n)), {"raw": o.full("max", "base", n)}],
        21: lambda: [*_filled(_stages(20, n)), {"raw": o.full("min", "base", n)}],
        22: lambda: [*_filled(_stages(20, n)), {"raw": o.full("max", "base", n)}],
        24: lambda: base_change(17, 2 * n), 25: lambda: base_change(20, 2 * n), 26: lambda: base_change(23, 2 * n),
        31: lambda: base_change(27, n), 32: lambda: base_change(28, n), 33: lambda: base_change(29, n),
        34: lambda: base_change(30, n), 36: lambda: base_change(35, n), 40: lambda: base_change(39, 2 * n),
        43: lambda: base_change(42, n), 45: lambda: base_change(44, n), 48: lambda: base_change(46, 2 * n),
        49: lambda: base_change(47, 2 * n),
    }
    return derived[number]()



# lengths for the short hourly series of the test tables; the defaults suit 3-second bars
TEST_LENGTHS = {number: (10, 20) for number in range(1, 59)}
TEST_LENGTHS.update({8: (14,), 54: (1,), 56: (12,), 57: (12, 24), 58: (20,)})
LOOSE = {29, 30, 33, 34, 27, 28, 31, 32, 5, 6, 4}


def _register_factors() -> None:
    for code, spec in sorted({**pv.FACTORS, pv.OBV_CODE: None}.items()):
        number = int(code[7:10])
        digits = 4 if number in LOOSE else 6
        lengths = TEST_LENGTHS[number]
        name = "c" + code[7:].lower()
        keys = [pv.OBV_CODE if code == pv.OBV_CODE else spec.key(n) for n in lengths]

        def build(market, code=code, lengths=lengths, keys=keys, digits=digits):
            table = pv.factor_columns(market.bars(), {code: list(lengths)}, KEYS, chunk_rows=CHUNK)
            return table.select("instrument", "datetime", *[
                rounded(F.col(k).cast("double"), digits, f"value{i}") for i, k in enumerate(keys)])

        add(name, build, _factor_sql(number, lengths, digits))


def _register_modes() -> None:
    """The intended form of operators whose reference formula differs."""
    n = 10
    over = o.frame(n)
    guard = f"count(close) {over} = {n}"
    residual = "power(y - (a + b * i), 2)"
    _indicator("c004_linear_deviation_intended", lambda c: pv.linear_deviation(c, n, "intended"), [
        {"b": f"CASE WHEN {guard} THEN regr_slope(close, pos) {over} END", "ys": f"list(close) {over}", "m": f"avg(close) {over}"},
        {"a": f"m - b * {(n + 1) / 2}"},
        {"v": o.ratio(f"close - (a + b * {n})", f"(sqrt(list_sum([{residual} for y, i in ys]) / {n - 1}) / sqrt({n}))")}], "v", 5)
    for name, column, lower in (("c051_n_day_low_intended", "close", True), ("c053_n_day_wider_intended", "tr", False)):
        best, pick, order = ("min", "arg_min", f"({column}, -pos)") if lower else ("max", "arg_max", f"({column}, pos)")
        _indicator(name, lambda c, column=column, lower=lower: pv.oldest_beyond(
            c, n, ind.true_range(c) if column == "tr" else column, lower, "intended"),
            [TR_STAGE, {"best": o.full(best, column, n), "best_pos": f"{pick}(pos, {order}) {over}"},
             {"v": f"CASE WHEN best IS NOT NULL THEN 100.0 * ((CASE WHEN best = {column} THEN {n + 1} ELSE pos - best_pos END) "
                   f"- 1) / {n} - 50 END"}], "v")


def _factor_sql(number: int, lengths: tuple[int, ...], digits: int) -> str:
    if number == 57:
        select = ", ".join(f"CASE WHEN rsi{n} >= 70 THEN 1.0 WHEN rsi{n} <= 30 THEN -1.0 ELSE 0.0 END::DOUBLE AS value{i}"
                           for i, n in enumerate(lengths))
        return rsi_sql(list(lengths), f"instrument, datetime, {select}")
    if number == 56:
        n = lengths[0]
        over = o.frame(n)
        fitted = (f"avg(fast) {over} + (CASE WHEN min(slow) {over} = max(slow) {over} THEN 0 ELSE regr_slope(fast, slow) "
                  f"{over} END) * (slow - avg(slow) {over})")
        stages = [{"fast": f"coalesce(rsi{n}, 0)", "slow": f"coalesce(rsi{2 * n}, 0)"},
                  {"raw": f"CASE WHEN count(fast) {over} = {n} THEN fast - ({fitted}) END"}]
        return rsi_sql([n, 2 * n], f"instrument, datetime, {o.r('coalesce(raw, 0)', digits)} AS value0", stages)
    # one branch of stages per length, joined on the bar
    branches = []
    for i, n in enumerate(lengths):
        body = o.staged("bars", _stages(number, n),
                        f"instrument, datetime, {o.r('CAST(coalesce(raw, 0) AS DOUBLE)', digits)} AS value{i}")
        branches.append(f"v{i} AS ({body})")
    joins = "v0" + "".join(f" JOIN v{i} USING (instrument, datetime)" for i in range(1, len(lengths)))
    return f"WITH {o.BARS.strip()},\n" + ",\n".join(branches) + f"\nSELECT * FROM {joins}"


def register() -> None:
    _register_indicators()
    _register_factors()
    _register_modes()
