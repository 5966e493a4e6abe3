"""Order-book factors of an index: per-stock columns, then one value per product, date and time.

Each factor gives the columns it needs on a stock's ticks, the sums over constituents, and the
value built from these sums. Any number of factors is computed in one pass: the ticks are read
once, joined with the constituents once and grouped once. A factor of the trading session is null
up to and including 09:30:00.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane import constants as K
from ticklane.functions import windows as win
from ticklane.functions.scalar import (
    divide_or_zero,
    level_amount,
    nearly_equal,
    price_limit_rate,
    swap_date_format,
    weighted_levels,
    whole_seconds,
)

STOCK_DAY = ["tscode", "date"]
POINT = ["product", "date", "time"]
ROLLING = (20, 50, 100, 200)

Enrich = Callable[[DataFrame, tuple], DataFrame]


def _stock_window():
    return Window.partitionBy(*STOCK_DAY).orderBy("time")


def _whole_day():
    return Window.partitionBy(*STOCK_DAY).orderBy("time").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)


def _in_session() -> Column:
    return F.col("time") > K.SESSION_START


def _product_window(session: bool):
    """Times of a date in order; session factors do not see the rows before the session."""
    part = [F.col("product"), F.col("date")] + ([_in_session()] if session else [])
    return Window.partitionBy(*part).orderBy("time")


@dataclass(frozen=True)
class SpotFactor:
    code: str
    sums: Callable[[tuple], dict[str, Column]]
    value: Callable[["SpotFactor", tuple], dict[str, Column]] | None = None
    enrich: Enrich | None = None
    params: tuple[int, ...] = ()
    session: bool = True
    # aggregates per product and date, and windows over these dates, available to ``value``
    daily: Callable[[], dict[str, Column]] | None = None
    over_dates: Callable[[Window], dict[str, Column]] | None = None
    # columns ``value`` needs first: of other factors, or its own
    needs: tuple[str, ...] = ()
    first: Callable[[], dict[str, Column]] | None = None
    version: str = "1.0"
    action_delay: int = 1

    def key(self, param: int | None = None) -> str:
        return self.code if param is None else f"{self.code}__{param}"

    def keys(self, params: tuple = ()) -> list[str]:
        return [self.key(p) for p in params] if params else [self.code]

    @property
    def full_name(self) -> str:
        return f"{self.code}_{self.version}"


SPOT_FACTORS: dict[str, SpotFactor] = {}


def _add(code: str, **parts) -> SpotFactor:
    SPOT_FACTORS[code] = SpotFactor(code, **parts)
    return SPOT_FACTORS[code]


# --- per-stock columns ---------------------------------------------------------------------

def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are not there yet, so that factors can share them."""
    present = set(df.columns)
    new = {name: column for name, column in columns.items() if name not in present}
    return df.withColumns(new) if new else df


def _total_amount(side: str) -> Column:
    return F.col(f"total_{side}_volume") * F.col(f"weighted_average_{side}_price")


def _price_change(df: DataFrame, params: tuple = ()) -> DataFrame:
    day = _stock_window()
    return _with(df, delta_price=F.coalesce(F.col("price") - F.lag("price").over(day), F.lit(0.0)))


def _amount_per_trade(df: DataFrame, params: tuple = ()) -> DataFrame:
    day = _stock_window()
    df = _price_change(df)
    df = _with(df, delta_transaction_number=F.coalesce(
        F.col("transaction_number") - F.lag("transaction_number").over(day), F.lit(0)))
    df = _with(df, amount_per_transaction=divide_or_zero("amount", "delta_transaction_number"))
    return _with(
        df,
        rising_per_transaction=F.when(F.col("delta_price") > 0, F.col("amount_per_transaction")).otherwise(0.0),
        falling_per_transaction=F.when(F.col("delta_price") < 0, F.col("amount_per_transaction")).otherwise(0.0))


def _share(top: str, bottom: str) -> Callable:
    return lambda factor, params: {factor.code: divide_or_zero(top, bottom)}


def _mean(column: str) -> Callable:
    return lambda factor, params: {factor.code: F.col(column)}


def _first_when(value: Column, condition: Column, window) -> Column:
    """Value of the first row of the stock's day that meets the condition."""
    return F.min_by(value, F.when(condition, F.col("time"))).over(window)


# --- commission ratios ---------------------------------------------------------------------

def _commission(code: str, name: str, amount: Callable[[str], Column]) -> None:
    """``amount`` gives the book amount of a side."""
    _add(code, value=_share(f"{name}_bid", f"{name}_both"),
         sums=lambda params: {f"{name}_bid": F.sum(amount("bid")), f"{name}_both": F.sum(amount("bid") + amount("ask"))})


_commission("FCT_02_001_TOTAL_COMMISSION_RATIO", "total", _total_amount)
_commission("FCT_02_002_10_GRADE_COMMISSION_RATIO", "grade10", lambda side: F.col(f"grade10_{side}_amount"))
_commission("FCT_02_003_10_GRADE_WEIGHTED_COMMISSION_RATIO", "weighted10", lambda side: weighted_levels(side, 10))
_commission("FCT_02_004_5_GRADE_COMMISSION_RATIO", "grade5", lambda side: F.col(f"grade5_{side}_amount"))
_commission("FCT_02_005_5_GRADE_WEIGHTED_COMMISSION_RATIO", "weighted5", lambda side: weighted_levels(side, 5))

GRADE_AMOUNTS = ("grade10_bid_amount", "grade10_ask_amount", "grade5_bid_amount", "grade5_ask_amount")
_add("FCT_AUXILIARY_FILE_GENERATION",
     sums=lambda params: {f"mean_{name}": F.avg(name) for name in GRADE_AMOUNTS},
     value=lambda factor, params: {name: F.col(f"mean_{name}") for name in GRADE_AMOUNTS})


# --- price moves ---------------------------------------------------------------------------

def _moves(df: DataFrame, params: tuple) -> DataFrame:
    started = F.col("time") >= K.SESSION_START
    session = Window.partitionBy(*STOCK_DAY, started).orderBy("time")
    change = lambda n: F.col("price") - F.coalesce(F.lag("price", n).over(session), F.col("close"))
    return _with(df, **{f"change_{n}": F.when(started, change(n)).otherwise(0.0) for n in params})


_add("FCT_02_006_RISING_STOCK_RATIO", params=ROLLING, enrich=_moves,
     sums=lambda params: {f"rising_{n}": F.avg(F.when(F.col(f"change_{n}") > 0, 1.0).when(
         F.col(f"change_{n}").isNotNull(), 0.0)) for n in params},
     value=lambda factor, params: {factor.key(n): F.col(f"rising_{n}") for n in params})

_add("FCT_02_007_SPREAD",
     sums=lambda params: {"spread": F.avg(F.try_divide(F.col("bid_price1") - F.col("ask_price1"),
                                                       F.col("bid_price1") + F.col("ask_price1")))},
     value=_mean("spread"))

_add("FCT_02_018_UNTRADED_STOCK_RATIO",
     sums=lambda params: {"untraded": F.avg(F.when(F.col("volume") == 0, 1.0).otherwise(0.0))},
     value=_mean("untraded"))

_add("FCT_02_038_DAILY_RISING_STOCK_RATIO",
     sums=lambda params: {"daily_rising": F.avg(F.when(F.col("price") > F.col("close"), 1.0).otherwise(0.0))},
     value=_mean("daily_rising"))


# --- opening auction -----------------------------------------------------------------------

def _auction(df: DataFrame, params: tuple = ()) -> DataFrame:
    day = _whole_day()
    time = F.col("time")
    first_stage = time.between(K.AUCTION_START, K.AUCTION_SECOND_STAGE_START)
    second_stage = time.between(K.AUCTION_SECOND_STAGE_START, K.AUCTION_SECOND_STAGE_END)
    opening_trade = (time <= K.SESSION_START) & (F.col("volume") > 0)
    ask = F.col("ask_price1")
    df = _with(
        df,
        _ask_1_first=_first_when(ask, first_stage, day),
        _ask_1_last=F.max_by(ask, F.when(first_stage, time)).over(day),
        _ask_2_first=_first_when(ask, second_stage, day),
        _open_price=_first_when(F.col("price"), opening_trade, day),
        _open_time=F.min(F.when(opening_trade, time)).over(day))
    started = time >= K.SESSION_START
    has_second = F.col("_ask_2_first").isNotNull() & F.col("_open_price").isNotNull()
    second = divide_or_zero(F.col("_open_price") - F.col("_ask_2_first"), F.col("_ask_2_first"))
    first = divide_or_zero(F.col("_ask_1_last") - F.col("_ask_1_first"), F.col("_ask_1_first"))
    has_both = has_second & F.col("_ask_1_first").isNotNull()
    return _with(
        df,
        second_stage_increase=F.when(started & has_second, second).otherwise(0.0),
        stage_difference=F.when(started & has_both, second - first).otherwise(0.0))


_add("FCT_02_008_CALL_AUCTION_SECOND_STAGE_INCREASE", enrich=_auction, session=False,
     sums=lambda params: {"second_stage_increase_mean": F.avg("second_stage_increase")},
     value=_mean("second_stage_increase_mean"))
_add("FCT_02_009_TWO_CALL_AUCTION_STAGE_DIFFERENCE", enrich=_auction, session=False,
     sums=lambda params: {"stage_difference_mean": F.avg("stage_difference")},
     value=_mean("stage_difference_mean"))


def _auction_volatility(df: DataFrame, params: tuple = ()) -> DataFrame:
    df = _auction(df)
    time = F.col("time")
    # time of the first trade up to the opening, as in the two factors above
    inside = (time >= K.AUCTION_SECOND_STAGE_START) & (time <= F.col("_open_time"))
    middle = (F.col("ask_price1") + F.col("bid_price1")) / 2
    df = _with(df, _inside=inside, _middle=middle)
    day = _stock_window()
    forward = F.when(F.col("_inside") & F.lead("_inside").over(day),
                     F.try_divide(F.lead("_middle").over(day) - F.col("_middle"), F.col("_middle")))
    df = _with(df, _forward=forward)
    spread = F.stddev_samp("_forward").over(_whole_day())
    none_inside = ~F.coalesce(F.max(F.col("_inside").cast("int")).over(_whole_day()) == 1, F.lit(False))
    started = time >= K.SESSION_START
    return _with(df, auction_volatility=F.when(~started | none_inside, 0.0).otherwise(spread))


_add("FCT_02_010_CALL_AUCTION_SECOND_STAGE_RETURN_VOLATILITY", enrich=_auction_volatility, session=False,
     sums=lambda params: {"auction_volatility_mean": F.avg("auction_volatility")},
     value=_mean("auction_volatility_mean"))


def _stage_ratio(bid: str, ask: str) -> Callable:
    """One value per product and date: the ratio of the day's sums."""
    def value(factor, params):
        day = Window.partitionBy("product", "date")
        top = F.sum(bid).over(day)
        return {factor.code: F.try_divide(top, top + F.sum(ask).over(day))}

    return value


def _first_stage_sums(params: tuple) -> dict[str, Column]:
    inside = F.col("time").between(K.AUCTION_START, K.AUCTION_SECOND_STAGE_START)
    amount = lambda side: F.col(f"{side}_price1") * (F.col(f"{side}_volume1") + F.col(f"{side}_volume2"))
    return {f"first_stage_{side}": F.sum(F.when(inside, amount(side))) for side in ("bid", "ask")}


_add("FCT_02_011_FIRST_STAGE_COMMISSION_RATIO", sums=_first_stage_sums, session=False,
     value=_stage_ratio("first_stage_bid", "first_stage_ask"))


def _second_stage_sums(params: tuple) -> dict[str, Column]:
    inside = (F.col("time") >= K.AUCTION_SECOND_STAGE_START) & (F.col("time") <= F.col("_open_time"))
    only_first = lambda side: F.col(f"{side}_price1") * (F.col(f"{side}_volume1") + F.col(f"{side}_volume2"))
    amount = lambda side: F.when(F.col("bid_price2") == 0, only_first(side)).otherwise(level_amount(side, 10))
    return {f"second_stage_{side}": F.sum(F.when(inside, amount(side))) for side in ("bid", "ask")}


_add("FCT_02_012_SECOND_STAGE_COMMISSION_RATIO", enrich=_auction, sums=_second_stage_sums, session=False,
     value=_stage_ratio("second_stage_bid", "second_stage_ask"))


def _overnight(df: DataFrame, params: tuple = ()) -> DataFrame:
    valid = (F.col("time") >= K.AUCTION_START) & (F.col("time") < K.AUCTION_SECOND_STAGE_START) \
        & (F.col("bid_price1") != 0) & (F.col("close") != 0)
    return _with(df, overnight_yield=_first_when(F.try_divide(F.col("bid_price1"), F.col("close")), valid, _whole_day()))


_add("FCT_02_022_OVER_NIGHT_YIELD", enrich=_overnight, session=False,
     sums=lambda params: {"overnight_yield_mean": F.avg("overnight_yield")}, value=_mean("overnight_yield_mean"))


# --- large book amounts --------------------------------------------------------------------

def _large_amount(side: str) -> dict:
    """1 where the mean book amount is above 1.5 times its session mean of the previous three dates."""
    column, usual = f"mean5_{side}", f"_usual5_{side}"
    return {
        "session": False,
        "sums": lambda params: {column: F.avg(f"grade5_{side}_amount")},
        "daily": lambda: {f"_day5_{side}": F.avg(F.when(_in_session(), F.col(column)))},
        "over_dates": lambda dates: {usual: F.avg(f"_day5_{side}").over(dates.rowsBetween(-3, -1))},
        "value": lambda factor, params: {factor.code: F.when(F.col(column) > F.col(usual) * 1.5, 1.0).otherwise(0.0)},
    }


_add("FCT_02_013_BID_LARGE_AMOUNT_BILL", **_large_amount("bid"))
_add("FCT_02_014_ASK_LARGE_AMOUNT_BILL", **_large_amount("ask"))


def _change_rate(factor: SpotFactor, params: tuple) -> dict[str, Column]:
    """Ratio to the value at the same time of the previous date, 0 if that date has no such time."""
    base = "FCT_02_001_TOTAL_COMMISSION_RATIO"
    same_time = Window.partitionBy("product", "time").orderBy("date")
    adjacent = F.lag("date").over(same_time) == F.col("_previous_date")
    rate = F.when(adjacent, divide_or_zero(F.col(base), F.lag(base).over(same_time))).otherwise(0.0)
    return {factor.code: F.coalesce(rate, F.lit(0.0))}


_add("FCT_02_015_TOTAL_COMMISSION_RATIO_CHANGE_RATE", needs=("FCT_02_001_TOTAL_COMMISSION_RATIO",), value=_change_rate,
     sums=lambda params: SPOT_FACTORS["FCT_02_001_TOTAL_COMMISSION_RATIO"].sums(()),
     daily=lambda: {"_session_date": F.max(F.when(_in_session(), F.col("date")))},
     over_dates=lambda dates: {"_previous_date": F.last("_session_date", ignorenulls=True).over(
         dates.rowsBetween(Window.unboundedPreceding, -1))})


# --- traded amount and book ----------------------------------------------------------------

def _amount_and_book(code: str, name: str, book: Callable[[str], Column]) -> None:
    def sums(params):
        rising = F.when(F.col("delta_price") > 0, F.col("amount")).otherwise(0.0)
        falling = F.when(F.col("delta_price") < 0, F.col("amount")).otherwise(0.0)
        bid, ask = book("bid") + rising, book("ask") + falling
        return {f"{name}_up": F.sum(bid), f"{name}_all": F.sum(bid + ask)}

    _add(code, enrich=_price_change, sums=sums, value=_share(f"{name}_up", f"{name}_all"))


_amount_and_book("FCT_02_016_AMOUNT_AND_COMMISSION_RATIO", "moved10", lambda side: F.col(f"grade10_{side}_amount"))
_amount_and_book("FCT_02_023_AMOUNT_AND_1ST_COMMISSION_RATIO", "moved1",
                 lambda side: F.col(f"{side}_price1") * F.col(f"{side}_volume1"))

_add("FCT_02_017_RISING_FALLING_AMOUNT_RATIO", enrich=_price_change, value=_share("amount_balance", "amount_all"),
     sums=lambda params: {
         "amount_balance": F.sum(F.signum("delta_price") * F.col("amount")), "amount_all": F.sum("amount")})


def _accumulated(df: DataFrame, params: tuple = ()) -> DataFrame:
    so_far = _stock_window().rowsBetween(Window.unboundedPreceding, 0)
    df = _amount_per_trade(df)
    return _with(df, rising_so_far=F.sum("rising_per_transaction").over(so_far),
                 falling_so_far=F.sum("falling_per_transaction").over(so_far))


_add("FCT_02_019_DAILY_ACCUMULATED_LARGE_ORDER_RATIO", enrich=_accumulated,
     sums=lambda params: {"rising_total": F.sum("rising_so_far"),
                          "moving_total": F.sum(F.col("rising_so_far") + F.col("falling_so_far"))},
     value=_share("rising_total", "moving_total"))


def _rolled(df: DataFrame, params: tuple) -> DataFrame:
    df = _amount_per_trade(df)
    day = _stock_window()
    last = lambda column, n: win.full_window(F.sum(column), F.col(column), day, n)
    return _with(df, **{f"{side}_last_{n}": last(f"{side}_per_transaction", n)
                        for n in params for side in ("rising", "falling")})


_add("FCT_02_020_ROLLING_ACCUMULATED_LARGE_ORDER_RATIO", params=ROLLING, enrich=_rolled,
     sums=lambda params: {
         **{f"rising_rolled_{n}": F.sum(f"rising_last_{n}") for n in params},
         **{f"moving_rolled_{n}": F.sum(F.col(f"rising_last_{n}") + F.col(f"falling_last_{n}")) for n in params}},
     value=lambda factor, params: {
         factor.key(n): divide_or_zero(f"rising_rolled_{n}", f"moving_rolled_{n}") for n in params})


# --- limits --------------------------------------------------------------------------------

def _limit_sums(rising: bool) -> Callable:
    def sums(params):
        change = F.try_divide(F.col("price") - F.col("close"), F.col("close"))
        limit = price_limit_rate("tscode", swap_date_format(F.col("date").cast("string")))
        at_limit = nearly_equal(F.abs(change), limit) & ((change > 0) if rising else (change < 0))
        return {f"{'rising' if rising else 'falling'}_limit": F.sum(F.when(at_limit, 1.0).otherwise(0.0))}

    return sums


def index_size(default: float | None = None) -> Column:
    """Constituents of the product; ``default`` for products without a fixed size."""
    size = F.lit(default).cast("double")
    for product, count in K.INDEX_SIZES.items():
        size = F.when(F.col("product") == product, float(count)).otherwise(size)
    return size


for _code, _name in (("FCT_02_024_RISING_LIMIT_STOCK_PROPORTION", "rising"),
                     ("FCT_02_025_FALLING_LIMIT_STOCK_PROPORTION", "falling")):
    _add(_code, session=False, sums=_limit_sums(_name == "rising"),
         value=lambda factor, params, name=_name: {factor.code: F.try_divide(F.col(f"{name}_limit"), F.col("_size"))})


# --- traded amount over book amount --------------------------------------------------------

def _book_amount(side: str, depth: str) -> Column:
    """Book amount of a side: all of it, or its first ten or five levels."""
    side = side.lower()
    return _total_amount(side) if depth == "TOTAL" else F.col(f"grade{depth.split('_')[0]}_{side}_amount")


def _book_sums(side: str, depth: str) -> Callable:
    return lambda params: {"amount_all": F.sum("amount"),
                           f"book_{side}_{depth}": F.sum(_book_amount(side, depth))}


def _book_ratio(side: str, depth: str, deviation: bool) -> Callable:
    def value(factor, params):
        ratio = f"_ratio_{side}_{depth}"
        window = _product_window(session=True)
        # the first deviation of a date is the ratio itself
        rule = (lambda n: win.partial_std(ratio, window, n, F.col(ratio))) if deviation \
            else (lambda n: win.partial_mean(ratio, window, n))
        return {factor.key(n): rule(n) for n in params}

    return value


def _book(side: str, depth: str, deviation: bool) -> dict:
    return {"params": ROLLING, "sums": _book_sums(side, depth), "value": _book_ratio(side, depth, deviation),
            "first": lambda: {f"_ratio_{side}_{depth}": divide_or_zero("amount_all", f"book_{side}_{depth}")}}


# fixed values: published codes with side, depth and whether the deviation is taken
for _code, _side, _depth, _deviation in (
        ("FCT_02_026_AMOUNT_BID_TOTAL_COMMISSION_RATIO", "BID", "TOTAL", False),
        ("FCT_02_027_AMOUNT_ASK_TOTAL_COMMISSION_RATIO", "ASK", "TOTAL", False),
        ("FCT_02_028_AMOUNT_BID_10_GRADE_COMMISSION_RATIO", "BID", "10_GRADE", False),
        ("FCT_02_029_AMOUNT_ASK_10_GRADE_COMMISSION_RATIO", "ASK", "10_GRADE", False),
        ("FCT_02_030_AMOUNT_BID_5_GRADE_COMMISSION_RATIO", "BID", "5_GRADE", False),
        ("FCT_02_031_AMOUNT_ASK_5_GRADE_COMMISSION_RATIO", "ASK", "5_GRADE", False),
        ("FCT_02_050_AMOUNT_BID_TOTAL_COMMISSION_RATIO_STD", "BID", "TOTAL", True),
        ("FCT_02_051_AMOUNT_BID_10_GRADE_COMMISSION_RATIO_STD", "BID", "10_GRADE", True),
        ("FCT_02_052_AMOUNT_BID_5_GRADE_COMMISSION_RATIO_STD", "BID", "5_GRADE", True),
        ("FCT_02_053_AMOUNT_ASK_TOTAL_COMMISSION_RATIO_STD", "ASK", "TOTAL", True),
        ("FCT_02_054_AMOUNT_ASK_10_GRADE_COMMISSION_RATIO_STD", "ASK", "10_GRADE", True),
        ("FCT_02_055_AMOUNT_ASK_5_GRADE_COMMISSION_RATIO_STD", "ASK", "5_GRADE", True)):
    _add(_code, **_book(_side, _depth, _deviation))


# --- volatility of the book ----------------------------------------------------------------

def _volatility(depth: str) -> dict:
    def enrich(df, params):
        day = _stock_window()
        amounts = {side: f"_book_{side}_{depth}" for side in ("BID", "ASK")}
        df = _with(df, **{name: _book_amount(side, depth) for side, name in amounts.items()})
        return _with(df, **{f"std_{side}_{depth}_{n}": win.full_window(F.stddev_samp(name), F.col(name), day, n)
                            for n in params for side, name in amounts.items()})

    return {
        "enrich": enrich,
        "sums": lambda params: {f"std_sum_{side}_{depth}_{n}": F.sum(f"std_{side}_{depth}_{n}")
                                for side in ("BID", "ASK") for n in params},
        "value": lambda factor, params: {
            factor.key(n): divide_or_zero(f"std_sum_BID_{depth}_{n}", f"std_sum_ASK_{depth}_{n}") for n in params},
        "params": ROLLING, "session": False,
    }


_add("FCT_02_032_TOTAL_COMMISSION_VOLATILITY_RATIO", **_volatility("TOTAL"))
_add("FCT_02_033_10_GRADE_COMMISSION_VOLATILITY_RATIO", **_volatility("10_GRADE"))
_add("FCT_02_034_5_GRADE_COMMISSION_VOLATILITY_RATIO", **_volatility("5_GRADE"))


# --- large orders --------------------------------------------------------------------------

LARGE_ORDER_DAYS = (3, 4)


def _usual_trade_size(df: DataFrame) -> DataFrame:
    """Mean trade size of the stock over its previous 3 and 4 trading days, from one daily table."""
    daily = df.groupBy(*STOCK_DAY).agg(
        F.max_by("daily_amount", "time").alias("_amount"), F.max_by("transaction_number", "time").alias("_number"))
    dates = Window.partitionBy("tscode").orderBy("date")
    columns = []
    for days in LARGE_ORDER_DAYS:
        earlier = dates.rowsBetween(-days, -1)
        columns += [F.try_divide(F.sum("_amount").over(earlier), F.sum("_number").over(earlier)).alias(f"_usual{days}"),
                    (F.count("_amount").over(earlier) > 0).alias(f"_known{days}")]
    return df.join(daily.select(*STOCK_DAY, *columns), STOCK_DAY)


def _large_orders(days: int, fall_back: bool) -> Enrich:
    """Mark trades of more than twice the mean trade size of the previous trading days of the stock."""
    name = f"large{days}"

    def enrich(df, params):
        df = _amount_per_trade(df)
        if f"_usual{days}" not in df.columns:
            df = _usual_trade_size(df)
        usual = F.col(f"_usual{days}")
        if fall_back:
            usual = F.when(F.col(f"_known{days}"), usual).otherwise(divide_or_zero("daily_amount", "transaction_number"))
        large = (F.col("delta_transaction_number") != 0) & (F.col("amount_per_transaction") > usual * 2)
        return _with(df, **{f"{name}_up": F.when(large & (F.col("delta_price") > 0), F.col("amount")).otherwise(0.0),
                            f"{name}_down": F.when(large & (F.col("delta_price") < 0), F.col("amount")).otherwise(0.0)})

    return enrich


for _code, _days, _fall_back in (("FCT_02_039_LARGE_ORDER_BID_ASK_VOLUME_RATIO", 4, False),
                                 ("FCT_02_062_LARGE_ORDER_BUYING_RATIO", 3, True)):
    _add(_code, enrich=_large_orders(_days, _fall_back), session=False,
         sums=lambda params, d=_days: {f"large{d}_rising": F.sum(f"large{d}_up"),
                                       f"large{d}_moving": F.sum(F.col(f"large{d}_up") + F.col(f"large{d}_down"))},
         value=_share(f"large{_days}_rising", f"large{_days}_moving"))


# --- factors of factors --------------------------------------------------------------------

WARM_UP = {"DIFFERENCE": win.difference_from, "MEAN": win.partial_mean, "STD": win.partial_std}


def _derived(code: str, base: str, rule: Callable) -> None:
    source = SPOT_FACTORS[base]
    _add(code, params=ROLLING, enrich=source.enrich, session=source.session, needs=(base,),
         sums=lambda params: source.sums(()),
         value=lambda factor, params: {
             factor.key(n): rule(base, _product_window(session=True), n) for n in params})


_derived("FCT_02_021_DELTA_TOTAL_COMMISSION_RATIO", "FCT_02_001_TOTAL_COMMISSION_RATIO",
         lambda base, w, n: F.col(base) - F.lag(base, n).over(w))
_derived("FCT_02_035_TOTAL_COMMISSION_RATIO_DIFFERENCE", "FCT_02_001_TOTAL_COMMISSION_RATIO", win.difference_from)
for _code, _base in {
    "FCT_02_036_10_GRADE_COMMISSION_RATIO_DIFFERENCE": "FCT_02_002_10_GRADE_COMMISSION_RATIO",
    "FCT_02_037_5_GRADE_COMMISSION_RATIO_DIFFERENCE": "FCT_02_004_5_GRADE_COMMISSION_RATIO",
    "FCT_02_040_10_GRADE_COMMISSION_RATIO_MEAN": "FCT_02_002_10_GRADE_COMMISSION_RATIO",
    "FCT_02_041_10_GRADE_COMMISSION_RATIO_STD": "FCT_02_002_10_GRADE_COMMISSION_RATIO",
    "FCT_02_042_5_GRADE_COMMISSION_RATIO_MEAN": "FCT_02_004_5_GRADE_COMMISSION_RATIO",
    "FCT_02_043_5_GRADE_COMMISSION_RATIO_STD": "FCT_02_004_5_GRADE_COMMISSION_RATIO",
    "FCT_02_044_10_GRADE_WEIGHTED_COMMISSION_RATIO_DIFFERENCE": "FCT_02_003_10_GRADE_WEIGHTED_COMMISSION_RATIO",
    "FCT_02_045_10_GRADE_WEIGHTED_COMMISSION_RATIO_MEAN": "FCT_02_003_10_GRADE_WEIGHTED_COMMISSION_RATIO",
    "FCT_02_046_10_GRADE_WEIGHTED_COMMISSION_RATIO_STD": "FCT_02_003_10_GRADE_WEIGHTED_COMMISSION_RATIO",
    "FCT_02_047_5_GRADE_WEIGHTED_COMMISSION_RATIO_DIFFERENCE": "FCT_02_005_5_GRADE_WEIGHTED_COMMISSION_RATIO",
    "FCT_02_048_5_GRADE_WEIGHTED_COMMISSION_RATIO_MEAN": "FCT_02_005_5_GRADE_WEIGHTED_COMMISSION_RATIO",
    "FCT_02_049_5_GRADE_WEIGHTED_COMMISSION_RATIO_STD": "FCT_02_005_5_GRADE_WEIGHTED_COMMISSION_RATIO",
    "FCT_02_056_AMOUNT_AND_COMMISSION_RATIO_MEAN": "FCT_02_016_AMOUNT_AND_COMMISSION_RATIO",
    "FCT_02_057_AMOUNT_AND_COMMISSION_RATIO_STD": "FCT_02_016_AMOUNT_AND_COMMISSION_RATIO",
    "FCT_02_058_RISING_FALLING_AMOUNT_RATIO_MEAN": "FCT_02_017_RISING_FALLING_AMOUNT_RATIO",
    "FCT_02_059_RISING_FALLING_AMOUNT_RATIO_STD": "FCT_02_017_RISING_FALLING_AMOUNT_RATIO",
    "FCT_02_060_AMOUNT_AND_1ST_COMMISSION_RATIO_MEAN": "FCT_02_023_AMOUNT_AND_1ST_COMMISSION_RATIO",
    "FCT_02_061_AMOUNT_AND_1ST_COMMISSION_RATIO_STD": "FCT_02_023_AMOUNT_AND_1ST_COMMISSION_RATIO",
}.items():
    _derived(_code, _base, WARM_UP[_code.rsplit("_", 1)[1]])


# --- running factors -----------------------------------------------------------------------

def constituent_ticks(ticks: DataFrame, constituents: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """Ticks of the stocks in a product on a date, without the (date, stock) pairs marked invalid.

    The interval condition rides on the equality of the stock code, so nothing is broadcast blindly.
    """
    if invalid is not None:
        ticks = ticks.join(invalid.select("date", "tscode").distinct(), ["date", "tscode"], "left_anti")
    member = constituents.select("product", F.col("tscode").alias("_member"), "start_date", "end_date")
    inside = (F.col("tscode") == F.col("_member")) & F.col("date").between(F.col("start_date"), F.col("end_date"))
    return ticks.join(member, inside).drop("_member", "start_date", "end_date")


def _with_dates(table: DataFrame, factors: list[SpotFactor]) -> DataFrame:
    """Join what the factors need to know about other dates, from one table with a row per product and date."""
    dated = [f for f in factors if f.daily is not None]
    if not dated:
        return table
    daily = {name: column for f in dated for name, column in f.daily().items()}
    dates = table.groupBy("product", "date").agg(*[column.alias(name) for name, column in daily.items()])
    order = Window.partitionBy("product").orderBy("date")
    known = {name: column for f in dated for name, column in f.over_dates(order).items()}
    return table.join(dates.select("product", "date", *[c.alias(n) for n, c in known.items()]), ["product", "date"])


def _evaluate(table: DataFrame, chosen: list[tuple[SpotFactor, tuple]]) -> DataFrame:
    """Add the values of all factors: what they need first, then themselves, one projection each."""
    keep = lambda factor, column: F.when(_in_session(), column) if factor.session else column
    first: dict[str, Column] = {}
    second: dict[str, Column] = {}
    for factor, params in chosen:
        for code in factor.needs:
            base = SPOT_FACTORS[code]
            first.update({n: keep(base, c) for n, c in base.value(base, ()).items()})
        if factor.first is not None:
            first.update({n: keep(factor, c) for n, c in factor.first().items()})
    for factor, params in chosen:
        second.update({n: keep(factor, c) for n, c in factor.value(factor, params).items() if n not in first})
    if first:
        table = table.withColumns(first)
    return table.withColumns(second) if second else table


def spot_factors(ticks: DataFrame, constituents: DataFrame, requests: dict[str, tuple[int, ...] | None],
                 invalid: DataFrame | None = None, size: float | None = None) -> DataFrame:
    """(product, date, time) with one column per requested factor and length."""
    sums: dict[str, Column] = {}
    keep: list[str] = []
    chosen = []
    for code, params in requests.items():
        factor = SPOT_FACTORS[code]
        lengths = tuple(params or factor.params)
        chosen.append((factor, lengths))
        if factor.enrich is not None:
            ticks = factor.enrich(ticks, lengths)
        sums.update(factor.sums(lengths))
        keep += GRADE_AMOUNTS if code == "FCT_AUXILIARY_FILE_GENERATION" else factor.keys(lengths)
    members = constituent_ticks(ticks, constituents, invalid)
    table = members.groupBy(*POINT).agg(*[column.alias(name) for name, column in sums.items()])
    if any("LIMIT_STOCK" in factor.code for factor, _ in chosen):
        table = table.withColumn("_size", index_size(size))
    table = _evaluate(_with_dates(table, [factor for factor, _ in chosen]), chosen)
    result = table.select(*POINT, *dict.fromkeys(keep))
    if all(factor.session for factor, _ in chosen):
        result = result.where(_in_session())
    return result


def align_to_bars(bars: DataFrame, spot: DataFrame, step: int = K.STOCK_TICK_SECONDS) -> DataFrame:
    """Left join of bars with the spot rows on the bar grid, on product and datetime text."""
    aligned = spot.where(whole_seconds("time") % step == 0).withColumn(
        "datetime", F.concat(F.col("date").cast("string"), F.lit(" "), F.col("time").substr(1, 8)))
    return bars.join(aligned.drop("date"), ["product", "datetime"], "left")
