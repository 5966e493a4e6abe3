"""Futures ticks to bars: column clean-up, traded volume, session grid, forward returns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane import constants as K
from ticklane.functions.series import SeriesColumns, last_value, next_value, previous_value


@dataclass(frozen=True)
class Session:
    """Trading session of a day in seconds since midnight.

    Bars are half-open and labelled by their right edge. The first bar may be longer (it holds
    the opening auction); the bar that starts when the break starts ends one step after it.
    """

    open: int = 9 * 3600 + 29 * 60
    first: int = 63
    step: int = 3
    break_start: int = 11 * 3600 + 30 * 60
    break_end: int = 13 * 3600
    close: int = 15 * 3600

    @property
    def morning_bars(self) -> int:
        """Bars that end at or before the break."""
        return (self.break_start - self.open - self.first) // self.step + 1

    @property
    def bars(self) -> int:
        return self.morning_bars + (self.close - self.break_end) // self.step

    def slot(self, second: Column, include_close: bool = False) -> Column:
        """Bar number of a second of the day; null outside the session.

        A tick exactly at the close is outside unless ``include_close``.
        """
        head = self.open + self.first
        until = second <= self.close if include_close else second < self.close
        morning = F.floor((second - head) / self.step) + 1
        noon = F.lit(self.morning_bars)
        afternoon = F.lit(self.morning_bars) + F.floor((second - self.break_end) / self.step)
        slot = (
            F.when(second < self.open, None)
            .when(second < head, 0)
            .when(second < self.break_start, morning)
            .when(second < self.break_end + self.step, noon)
            .when(until, F.least(afternoon, F.lit(self.bars - 1)))
        )
        return slot.cast("int")

    def label(self, slot: Column) -> Column:
        """Right edge of a bar in seconds since midnight."""
        return (
            F.when(slot < self.morning_bars, self.open + self.first + slot * self.step)
            .otherwise(self.break_end + (slot - self.morning_bars + 1) * self.step)
        ).cast("int")


def continuous_session(step: int) -> Session:
    """A session around the clock without a break."""
    return Session(open=0, first=step, step=step, break_start=86400, break_end=86400, close=86400)


def strip_contract_prefix(ticks: DataFrame, contract: str, exchange: str = "CFFEX") -> DataFrame:
    """``CFFEX.IF2209.last_price`` to ``last_price``."""
    prefix = f"{exchange}.{contract}."
    names = [name[len(prefix):] if name.startswith(prefix) else name for name in ticks.columns]
    return ticks.toDF(*names)


def traded_volume(ticks: DataFrame, keys: list[str], order: list[str], bucket: str,
                  volume: str = "volume") -> DataFrame:
    """Volume of each tick from the cumulative one; the first tick keeps its value, only trades stay."""
    with_previous = previous_value(ticks, keys, order, bucket, volume, "_previous")
    return (
        with_previous.withColumn("delta_volume", F.col(volume) - F.coalesce("_previous", F.lit(0)))
        .where(F.col("delta_volume") > 0)
        .drop("_previous")
    )


def slot_bars(trades: DataFrame, keys: list[str], session: Session, second: Column, order: list[str],
              price: str = "last_price", volume: str = "delta_volume", interest: str = "open_interest",
              include_close: bool = False) -> DataFrame:
    """Open, close, high, low, volume, interest per non-empty slot. ``keys`` end with the date.

    Give one fixed-width ``order`` column where possible: several make a struct, and Spark then sorts
    the ticks before it aggregates them.
    """
    moment = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return (
        trades.withColumn("slot", session.slot(second, include_close))
        .where(F.col("slot").isNotNull())
        .groupBy(*keys, "slot")
        .agg(
            F.min_by(price, moment).alias("open"),
            F.max_by(price, moment).alias("close"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.sum(volume).alias("volume"),
            F.max_by(interest, moment).alias("interest"),
        )
    )


def fill_grid(bars: DataFrame, keys: list[str], session: Session) -> DataFrame:
    """Every slot from the first trade of a day on; an empty one repeats the last close with volume 0.

    Each bar emits the empty slots up to the next one, so no cross join with the grid is needed.
    """
    day = Window.partitionBy(*keys).orderBy("slot")
    next_slot = F.coalesce(F.lead("slot").over(day), F.lit(session.bars))
    spread = bars.withColumn("_until", next_slot - 1).withColumn(
        "_slot", F.explode(F.sequence(F.col("slot"), F.col("_until"))))
    empty = F.col("_slot") > F.col("slot")
    repeated = lambda column: F.when(empty, F.col("close")).otherwise(F.col(column)).alias(column)
    return spread.select(
        *keys, F.col("_slot").alias("slot"),
        repeated("open"), F.col("close"), repeated("high"), repeated("low"),
        F.when(empty, F.lit(0).cast(bars.schema["volume"].dataType)).otherwise(F.col("volume")).alias("volume"),
        "interest",
    )


def session_bars(trades: DataFrame, keys: list[str], session: Session, second: Column, order: list[str],
                 **columns) -> DataFrame:
    """Bars on the full session grid with their label as ``datetime`` text (``keys`` end with the date)."""
    filled = fill_grid(slot_bars(trades, keys, session, second, order, **columns), keys, session)
    edge = session.label(F.col("slot"))
    moment = F.col(keys[-1]).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), edge)
    return filled.withColumn("datetime", moment.cast("string"))


def return_name(minutes: int) -> str:
    return f"ret__{minutes}"


def forward_returns(bars: DataFrame, keys: list[str], position: str = "pos", minutes=K.RETURN_MINUTES,
                    bars_per_minute: int = K.BARS_PER_MINUTE, chunk_rows: int = 20_000) -> DataFrame:
    """Return from the next open to the close N minutes later.

    The tail of a series uses its last close; the last bar has return 0.
    """
    # stretches of positions carry the last close, so bars never meet on the contract alone
    stretch = F.floor(F.col(position) / max(chunk_rows, 1))
    final = last_value(bars.withColumn("_stretch", stretch), keys, [position], "_stretch", "close", "_final")
    columns = SeriesColumns()
    entry = columns.lead("open", 1)
    for n in minutes:
        columns.lead("close", n * bars_per_minute + 1)
    priced = columns.apply(final, keys, position, chunk_rows)
    for n in minutes:
        exit_price = F.coalesce(F.col(f"close__lead{n * bars_per_minute + 1}"), F.col("_final"))
        change = F.try_divide(exit_price - F.col(entry), F.col(entry))
        priced = priced.withColumn(return_name(n), F.coalesce(change, F.lit(0.0)))
    return priced.select(*bars.columns, *[return_name(n) for n in minutes])


def percent_returns(bars: DataFrame, keys: list[str], lengths: list[int], position: str = "pos",
                    chunk_rows: int = 20_000) -> DataFrame:
    """Close-to-close forward return in percent."""
    columns = SeriesColumns()
    for n in lengths:
        columns.lead("close", n)
    priced = columns.apply(bars, keys, position, chunk_rows)
    return priced.select(*bars.columns, *[
        (F.try_divide(F.col(f"close__lead{n}") - F.col("close"), F.col("close")) * 100).alias(f"ret_percent__{n}")
        for n in lengths])


def fill_gaps(ticks: DataFrame, keys: list[str], order: list[str], moment: str, step: float, bucket: str,
              zero: list[str] | None = None, break_seconds: int = K.NOON_BREAK_SECONDS,
              break_start: str = "11:30:00") -> DataFrame:
    """Repeat a tick every ``step`` seconds until the next one of the same keys.

    A gap of at least the noon break is shortened by it; copies of a tick at exactly 11:30:00
    continue after the break. Columns in ``zero`` are 0 in the copies. ``bucket`` (an hour, say)
    splits the ticks of a busy contract and day over tasks.
    """
    here = F.col(moment)
    ahead = next_value(ticks, keys, order, bucket, moment, "_there")
    gap = F.timestamp_diff("MICROSECOND", here, F.col("_there")) / 1e6
    gap = F.when(gap >= break_seconds, gap - break_seconds).otherwise(gap)
    # the k-th copy sits k steps later while k * step < gap
    copies = F.when(gap > step, F.ceil(F.round(gap / step, 6)) - 1).otherwise(0)
    spread = ahead.withColumn("_copies", F.coalesce(copies, F.lit(0)).cast("int")).withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.col("_copies"))))
    at_break = here.cast("string").substr(12, 20) == break_start
    seconds = F.col("_copy") * step + F.when(at_break & (F.col("_copy") > 0), break_seconds).otherwise(0)
    shifted = here + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    filled = spread.withColumn(moment, shifted)
    for column in zero or []:
        filled = filled.withColumn(
            column, F.when(F.col("_copy") > 0, F.lit(0)).otherwise(F.col(column)).cast(ticks.schema[column].dataType))
    return filled.select(*ticks.columns, (F.col("_copy") > 0).alias("filled"))


def drop_limit_days(bars: DataFrame, keys: list[str], date: str, position: str = "pos", volume_over: int = 100,
                    chunk_rows: int = 20_000) -> DataFrame:
    """Drop the dates that hold a flat bar (high = low, volume above a bound) inside a run of three flat bars."""
    flat = SeriesColumns()
    flat.value("_flat", (F.col("high") == F.col("low")).cast("int"))
    for rows in (1, 2):
        flat.lag("_flat", rows)
        flat.lead("_flat", rows)
    marked = flat.apply(bars, keys, position, chunk_rows)
    is_flat = lambda *names: [F.col(name) == 1 for name in names]
    before, around, after = (is_flat("_flat__lag1", "_flat__lag2"), is_flat("_flat__lag1", "_flat__lead1"),
                             is_flat("_flat__lead1", "_flat__lead2"))
    in_run = (before[0] & before[1]) | (around[0] & around[1]) | (after[0] & after[1])
    bad = marked.where((F.col("_flat") == 1) & in_run & (F.col("volume") > volume_over))
    return bars.join(bad.select(*keys, date).distinct(), [*keys, date], "left_anti")
