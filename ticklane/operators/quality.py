"""Data-quality rules.

A stock rule is a count of issues per (stock, date); all rules requested together share one scan
and one shuffle. Results are rows (tscode, date, rule, result, issue_count, message), result 0 is a
pass and 1 a failure.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane import constants as K
from ticklane.functions.scalar import nearly_equal, price_limit_rate, round_half_up, swap_date_format, whole_seconds
from ticklane.operators.ticks import BOOK_COLUMNS, KEYS, in_session


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))


@dataclass(frozen=True)
class Rule:
    issues: Column
    message: str
    # a rule that fails only above this many issues
    tolerated: int = 0


def _order_columns(ticks: DataFrame) -> DataFrame:
    """Columns that compare a row with its neighbours; all windows share keys and one exchange, and but one share a sort."""
    day = Window.partitionBy(*KEYS).orderBy("time", "tick_order")
    by_volume = Window.partitionBy(*KEYS).orderBy("time", "daily_accumulated_volume")
    half = F.when(F.col("time").between(K.SESSION_START, K.NOON_END), 1).when(
        F.col("time").between(K.NOON_START, K.SESSION_END), 2)
    second = whole_seconds("time")
    first_number = F.min(F.when(F.col("transaction_number") != 0, F.col("time"))).over(Window.partitionBy(*KEYS))
    # the rows of a half follow each other in the day
    return (
        ticks.withColumn("_half", half)
        .withColumn("_reversed", F.lag("daily_accumulated_volume").over(by_volume) > F.col("daily_accumulated_volume"))
        .withColumn("_volume_change", F.col("daily_accumulated_volume") - F.lag("daily_accumulated_volume").over(day))
        .withColumn("_gap", F.when(F.lag("_half").over(day) == F.col("_half"), second - F.lag(second).over(day)))
        .withColumn("_same_time", F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "time")))
        .withColumn("_first_number", first_number)
    )


def missing_level(is_st: Column | None = None) -> Column:
    """A zero book level that the price limit does not explain."""
    limit = price_limit_rate("tscode", swap_date_format(F.col("date").cast("string")), is_st)
    up = round_half_up(F.col("close") * (1 + limit), 2)
    down = round_half_up(F.col("close") * (1 - limit), 2)

    def off_limit(side: str, bound: Column) -> Column:
        prices = F.array(*[F.col(f"{side}_price{i}") for i in range(1, K.BOOK_DEPTH + 1)])
        present = F.size(F.filter(prices, lambda p: p != 0))
        edge = F.when(present == 0, F.col("price")).otherwise(F.get(prices, present - 1))
        return F.when(present < K.BOOK_DEPTH, ~nearly_equal(edge, bound))

    any_zero = reduce(or_, [F.col(c) == 0 for c in BOOK_COLUMNS])
    quoting = (F.col("time") < K.CLOSING_AUCTION_START) & (F.col("time") > K.AUCTION_SECOND_STAGE_END) \
        & ((F.col("time") >= K.NOON_START) | (F.col("time") <= K.NOON_END))
    return quoting & any_zero & F.coalesce(off_limit("bid", down), off_limit("ask", up), F.lit(True))


def stock_rules(minimum_rows: int = K.TICKS_PER_SESSION) -> dict[str, Rule]:
    """All tick rules by name."""
    time, traded = F.col("time"), F.col("volume") > 0
    rows = F.count(F.lit(1))
    last_trade = F.coalesce(F.max(F.when(traded, time)), F.lit(""))
    at = lambda moment: _count(time == moment)
    morning, afternoon = _count(F.col("_half") == 1), _count(F.col("_half") == 2)
    gaps = _count(F.col("_gap") > 15)
    repeats = F.count_distinct(F.when(in_session() & (F.col("_same_time") > 1), time))
    auction = (time >= K.AUCTION_START) & (time < K.AUCTION_SECOND_STAGE_END)
    close_rows = at(K.SESSION_END)
    closing_trades = _count((time == K.SESSION_END) & traded)
    late = time > K.VALID_DATA_START
    zero_ohlc = (F.col("open") == 0) | (F.col("close") == 0) | (F.col("high") == 0) | (F.col("low") == 0)
    flag = lambda condition: F.when(condition, 1).otherwise(0)
    return {
        "incomplete_length": Rule(flag(rows < minimum_rows), "The data is incomplete"),
        "volume_order": Rule(_count(F.col("_reversed")), "The volume has reverse order"),
        "zero_price": Rule(_count((F.col("price") == 0) & late), "Invalid price value"),
        "zero_ohlc": Rule(_count(zero_ohlc & late), "Invalid OHLC value"),
        "organized_repeats": Rule(repeats, "Repeat records"),
        "noon_missing": Rule(flag(at(K.NOON_END) == 0), "Miss 11:30:00 data"),
        "closing_auction_late": Rule(flag(last_trade > K.SESSION_END), "The last trade lies after the close"),
        "auction_duplicates": Rule(_count(auction & (F.col("_same_time") > 1)), "Duplicate rows in the opening auction"),
        "closing_duplicates": Rule(F.when(close_rows > 1, closing_trades).otherwise(0), "Multiple records at 15:00"),
        "time_missing": Rule(
            F.when(rows == 1, 0).when((morning == 0) | (afternoon == 0), 1).otherwise(gaps),
            "Data missing in trading time"),
        "zero_transaction_number": Rule(
            _count((time > F.col("_first_number")) & (F.col("transaction_number") == 0)),
            "Zero transaction numbers after the first trade", tolerated=1),
        "volume_not_cleared": Rule(_count((F.col("_volume_change") == 0) & traded), "Volume without a trade"),
        "repeat_records": Rule(repeats, "Repeat records"),
        "close_missing": Rule(flag((close_rows == 0) | (at(K.NOON_END) == 0)), "The close record is missing"),
        "no_volume": Rule(flag(_count(F.col("volume") == 0) / rows > 0.999), "Nearly no traded rows"),
        "level_missing": Rule(_count(F.col("_level_missing")), "The bid or ask data is missing"),
        "incomplete_day": Rule(flag(F.max(time) < K.SESSION_END), "The day ends before the close"),
        "always_fail": Rule(F.lit(1), "Marked as bad"),
        "always_pass": Rule(F.lit(0), ""),
    }


def validate_stock_ticks(ticks: DataFrame, rules: list[str] | None = None, suspended: DataFrame | None = None,
                         minimum_rows: int = K.TICKS_PER_SESSION) -> DataFrame:
    """One result row per stock, date and rule. Suspended (date, stock) pairs fail with that message alone."""
    known = stock_rules(minimum_rows)
    chosen = {name: known[name] for name in (rules or known)}
    if "level_missing" in chosen:
        # ahead of the windows, so that their sorts don't carry the book
        ticks = ticks.withColumn("_level_missing", missing_level())
    issues = _order_columns(ticks).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("record_count"),
        *[rule.issues.cast("bigint").alias(name) for name, rule in chosen.items()])
    outcome = F.array(*[
        F.struct(
            F.lit(name).alias("rule"),
            F.when(F.col(name) > rule.tolerated, K.RESULT_FAILED).otherwise(K.RESULT_OK).alias("result"),
            F.col(name).alias("issue_count"),
            F.when(F.col(name) > rule.tolerated, F.lit(rule.message)).otherwise("").alias("message"))
        for name, rule in chosen.items()])
    if suspended is not None:
        halted = suspended.select("tscode", "date").distinct().withColumn("_halted", F.lit(True))
        only = F.array(F.struct(F.lit("suspended").alias("rule"), F.lit(K.RESULT_FAILED).alias("result"),
                                F.lit(1).cast("bigint").alias("issue_count"),
                                F.lit("The stock is suspended").alias("message")))
        outcome = F.when(F.col("_halted"), only).otherwise(outcome)
        issues = issues.join(halted, KEYS, "left")
    return issues.select(*KEYS, "record_count", F.explode(outcome).alias("_o")).select(
        *KEYS, "record_count", "_o.rule", "_o.result", "_o.issue_count", "_o.message")


def has_book_amounts(ticks: DataFrame) -> bool:
    """Whether the five- and ten-level amounts have been added."""
    wanted = {f"grade{d}_{s}_amount" for d in (5, 10) for s in ("bid", "ask")}
    return wanted <= set(ticks.columns)


def future_gaps(ticks: DataFrame, low: int = 300, high: int = K.NOON_BREAK_SECONDS) -> DataFrame:
    """Gaps of more than ``low`` and less than ``high`` seconds per contract and date.

    Ticks of one contract and day may be many, so gaps are taken between minutes: a minute
    contributes its first and last tick and its own largest inner gap cannot exceed the bound.
    """
    if low < 60:
        raise ValueError("gaps shorter than a minute need the plain window")
    minute = F.date_trunc("minute", F.col("datetime"))
    edges = ticks.groupBy("instrument", "date", minute.alias("_minute")).agg(
        F.min("datetime").alias("_first"), F.max("datetime").alias("_last"), F.count(F.lit(1)).alias("_rows"))
    day = Window.partitionBy("instrument", "date").orderBy("_minute")
    gap = F.timestamp_diff("MICROSECOND", F.lag("_last").over(day), F.col("_first")) / 1e6
    return edges.withColumn("_gap", gap).groupBy("instrument", "date").agg(
        F.sum("_rows").alias("record_count"), _count((F.col("_gap") > low) & (F.col("_gap") < high)).alias("issue_count"))


def missing_stocks(constituent_dates: DataFrame, ticks: DataFrame) -> DataFrame:
    """Constituents of a date without ticks."""
    return constituent_dates.join(ticks.select(*KEYS).distinct(), KEYS, "left_anti")


def factor_close_records(factors: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a factor table holds the 11:30 and 15:00 record per contract and date."""
    return factors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.when((_count(F.col("time") == K.SESSION_END) == 0) | (_count(F.col("time") == K.NOON_END) == 0),
               K.RESULT_FAILED).otherwise(K.RESULT_OK).alias("result"))


def pair_half_second(moment: Column) -> Column:
    """The other tick of the same second on the half-second grid."""
    half = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.5).cast("decimal(18,6)"))
    return F.when(F.date_trunc("second", moment) == moment, moment + half).otherwise(moment - half)


def reconcile_feeds(target: DataFrame, compare: DataFrame, keys: list[str], fields: list[str],
                    moment: str = "datetime") -> DataFrame:
    """Match two feeds on a time aligned to half a second; unmatched rows may match half a second apart.

    Rows: keys, datetime, status (same, different, only_in_target, only_in_compare) and both abstracts.
    Times are expected to be unique per key within a feed.
    """
    abstract = F.concat_ws("|", *[F.coalesce(F.col(f).cast("double").cast("string"), F.lit("")) for f in fields])
    left = target.select(*keys, moment, abstract.alias("target_abstract"))
    right = compare.select(*keys, moment, abstract.alias("compare_abstract"))
    both = left.join(right, [*keys, moment], "full")
    matched = both.where(F.col("target_abstract").isNotNull() & F.col("compare_abstract").isNotNull())
    # rows of one side only, each tagged with the second it belongs to, meet in a second join
    lone_left = both.where(F.col("compare_abstract").isNull()).select(*keys, moment, "target_abstract")
    lone_right = both.where(F.col("target_abstract").isNull()).select(
        *keys, F.col(moment).alias("_compare_moment"), "compare_abstract",
        pair_half_second(F.col(moment)).alias(moment))
    paired = lone_left.join(lone_right, [*keys, moment], "full").withColumn(
        moment, F.when(F.col("target_abstract").isNull(), F.col("_compare_moment")).otherwise(F.col(moment)))
    status = (
        F.when(F.col("compare_abstract").isNull(), "only_in_target")
        .when(F.col("target_abstract").isNull(), "only_in_compare")
        .when(F.col("target_abstract") == F.col("compare_abstract"), "same")
        .otherwise("different"))
    columns = [*keys, moment, "target_abstract", "compare_abstract"]
    return matched.select(*columns).unionByName(paired.select(*columns)).withColumn("status", status)


def reconcile_report(reconciled: DataFrame, keys: list[str]) -> DataFrame:
    count = lambda *states: _count(F.col("status").isin(*states)).cast("bigint")
    return reconciled.groupBy(*keys).agg(
        count("same", "different", "only_in_target").alias("target_count"),
        count("same", "different", "only_in_compare").alias("compare_count"),
        *[count(s).alias(f"{s}_count") for s in ("same", "different", "only_in_target", "only_in_compare")])


def content_differences(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """Row fingerprints that occur on one side more often than on the other.

    Without ``right`` one table holds both sides and the left one is marked in ``_original``: rows that agree can then meet
    before they are shuffled.
    """
    mark = lambda df: F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
                                              for c in sorted(df.columns) if right is not None or c != "_original"])
                            ).alias("fingerprint")
    if right is None:
        signed = left.select(mark(left), F.when(F.col("_original"), 1).otherwise(-1).alias("_n"))
    else:
        signed = left.select(mark(left), F.lit(1).alias("_n")).unionByName(right.select(mark(right), F.lit(-1).alias("_n")))
    return signed.groupBy("fingerprint").agg(F.sum("_n").alias("surplus")).where(F.col("surplus") != 0)
