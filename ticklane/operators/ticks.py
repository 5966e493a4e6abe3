"""Stock ticks: column layout, cleaning, alignment to the 3-second grid, gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane import constants as K
from ticklane.functions.scalar import level_amount, time_string, whole_seconds

KEYS = ["tscode", "date"]
BOOK_COLUMNS = [f"{side}_{field}{i}" for side in ("bid", "ask") for field in ("price", "volume")
                for i in range(1, K.BOOK_DEPTH + 1)]


def in_session(time: Column | None = None) -> Column:
    """09:30 to 15:00 without the noon break, bounds included."""
    time = F.col("time") if time is None else time
    return time.between(K.SESSION_START, K.SESSION_END) & ((time >= K.NOON_START) | (time <= K.NOON_END))


def name_stock_columns(ticks: DataFrame) -> DataFrame:
    """Name the columns by position and drop surplus ones on the right."""
    names = K.STOCK_TICK_COLUMNS
    return ticks.select(*[F.col(f"`{c}`") for c in ticks.columns[:len(names)]]).toDF(*names)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows without any null."""
    return df.na.drop()


def swap_book_sides(ticks: DataFrame) -> DataFrame:
    """Exchange all bid and ask columns."""
    def other(name: str) -> str:
        return name.replace("bid", "#").replace("ask", "bid").replace("#", "ask")

    present = set(ticks.columns)
    return ticks.select(*[F.col(other(c)).alias(c) if other(c) in present else F.col(c) for c in ticks.columns])


def add_book_amounts(ticks: DataFrame) -> DataFrame:
    """Amounts of the first ten and five levels of each side."""
    return ticks.withColumns({f"grade{depth}_{side}_amount": level_amount(side, depth)
                              for depth in (10, 5) for side in ("bid", "ask")})


def clean_stock_ticks(ticks: DataFrame, order: str = "tick_order", original: Column | None = None) -> DataFrame:
    """Drop rows outside trading hours and repeated rows without volume.

    From 09:25 on, a time with traded rows loses its untraded ones; a time with only untraded rows
    loses the first of them. With ``original`` the rows of the original layer that meet it come back too, as they are and
    marked in ``_original``: a comparison of the two layers then reads and sorts them once.
    """
    time = F.col("time")
    after_hours = (time > K.SESSION_END) & ((F.col("price") == 0) | (F.col("transaction_number") == 0))
    at_noon = (time > K.NOON_END) & (time < K.NOON_START)
    ticks = ticks.drop(*[c for c in K.UNUSED_STOCK_TICK_COLUMNS if c in ticks.columns])
    inside = (time >= K.AUCTION_START) & ~after_hours & ~at_noon & (time != "0::.0")
    if original is None:
        kept, counts = ticks.where(inside), F.lit(True)
    else:
        kept, counts = ticks.withColumn("_inside", F.coalesce(inside, F.lit(False))), F.col("_inside")
    same_time = Window.partitionBy(*KEYS, "time")
    repeated = (F.count(F.when(counts, 1)).over(same_time) > 1) & (time >= K.AUCTION_SECOND_STAGE_END[:8])
    traded = F.max(F.when(counts & (F.col("volume") > 0), 1).otherwise(0)).over(same_time) == 1
    untraded = F.col("volume") == 0
    # the ranked window comes first: its sort serves the others
    rank = F.row_number().over(same_time.orderBy(F.when(~counts, 2).when(untraded, 0).otherwise(1), order))
    drop = repeated & untraded & (traded | (F.col("_rank") == 1))
    marked = kept.withColumn("_rank", rank).withColumn("_drop", drop)
    if original is None:
        return marked.where(~F.col("_drop")).drop("_drop", "_rank")
    stays = F.col("_inside") & F.coalesce(~F.col("_drop"), F.lit(False))
    organized, asked = F.array(F.lit(False)), F.array(F.lit(True))
    layers = F.when(stays & F.col("_asked"), F.array(F.lit(False), F.lit(True))).when(stays, organized).when(
        F.col("_asked"), asked)
    # a condition with a window over the rows of a time uses the sort that is there
    return marked.withColumn("_asked", original).withColumn("_original", F.explode(layers)).drop(
        "_drop", "_rank", "_inside", "_asked")


def fill_opening_prices(ticks: DataFrame) -> DataFrame:
    """Zero prices between 09:30 and 09:32 take the previous close of the day's first valid row."""
    day = Window.partitionBy(*KEYS)
    last_close = F.min_by("close", F.when(F.col("close") > 0, F.struct("time", "tick_order"))).over(day)
    opening = F.col("time").between(K.SESSION_START, K.VALID_DATA_START)
    return ticks.withColumn("_last_close", last_close).withColumns({
        c: F.when(opening & (F.col(c) == 0), F.col("_last_close")).otherwise(F.col(c))
        for c in ("price", "open", "high", "low")}).drop("_last_close")


def snap_to_grid(ticks: DataFrame, step: int = K.STOCK_TICK_SECONDS, drop_unplaced: bool = False) -> DataFrame:
    """Move an off-grid session row up to the next free grid time.

    A row that is on the grid owns its time; of the off-grid rows the first one takes a free time.
    The others keep their time, or are dropped with ``drop_unplaced``.
    """
    second = whole_seconds("time")
    off = (F.col("time") >= K.SESSION_START[:8]) & (second % step != 0)
    target = F.when(off, time_string(second - second % step + step)).otherwise(F.col("time"))
    placed = ticks.withColumn("_off", off).withColumn("_target", target)
    rank = F.row_number().over(Window.partitionBy(*KEYS, "_target").orderBy("_off", "tick_order"))
    placed = placed.withColumn("_wins", ~F.col("_off") | (rank == 1))
    if drop_unplaced:
        placed = placed.where(F.col("_wins"))
    return placed.withColumn("time", F.when(F.col("_wins"), F.col("_target")).otherwise(F.col("time"))) \
        .drop("_off", "_target", "_wins")


def move_closing_trade(ticks: DataFrame) -> DataFrame:
    """If the last trade lies after 15:00:00 it becomes the 15:00:00 row and everything later goes."""
    day = Window.partitionBy(*KEYS)
    last_trade = F.max(F.when(F.col("volume") > 0, F.col("time"))).over(day)
    marked = ticks.withColumn("_last", F.coalesce(last_trade, F.lit(""))).withColumn(
        "_late", F.col("_last") > K.SESSION_END)
    time = F.when(F.col("_late") & (F.col("time") == F.col("_last")), F.lit(K.SESSION_END)).otherwise(F.col("time"))
    stays = ~F.col("_late") | (F.col("time") == F.col("_last")) | (F.col("time") < K.SESSION_END)
    return marked.where(stays).withColumn("time", time).drop("_last", "_late")


def fill_tick_gaps(ticks: DataFrame, step: int = K.STOCK_TICK_SECONDS, zero: tuple[str, ...] = ("volume", "amount"),
                   since: str = K.SESSION_START) -> DataFrame:
    """Repeat a session row every ``step`` seconds up to the next one, with ``zero`` columns at 0.

    A gap over the noon break counts without it, and copies of the 11:30:00 row follow the break.
    """
    day = Window.partitionBy(*KEYS, F.col("time") >= since).orderBy("time", "tick_order")
    second = whole_seconds("time")
    gap = F.col("_next") - F.col("_second")
    gap = F.when(gap >= K.NOON_BREAK_SECONDS, gap - K.NOON_BREAK_SECONDS).otherwise(gap)
    copies = F.when((F.col("time") >= since) & (gap > step), F.floor((gap - 1) / step)).otherwise(0)
    jump = F.when(F.col("time") == K.NOON_END, K.NOON_BREAK_SECONDS).otherwise(0)
    # what the copies of a row share is worked out before they are made
    spread = ticks.withColumn("_second", second).withColumn("_next", F.lead("_second").over(day)).withColumns({
        "_copies": F.coalesce(copies, F.lit(0)).cast("int"), "_start": F.col("_second") + jump}).withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.col("_copies"))))
    copied = F.col("_copy") > 0
    filled = spread.withColumn("time", F.when(copied, time_string(F.col("_start") + F.col("_copy") * step))
                               .otherwise(F.col("time")))
    for column in zero:
        filled = filled.withColumn(
            column, F.when(copied, F.lit(0)).otherwise(F.col(column)).cast(ticks.schema[column].dataType))
    return filled.withColumn("filled", copied).drop("_copy", "_copies", "_second", "_next", "_start")


def enrich_stock_ticks(ticks: DataFrame, step: int = K.STOCK_TICK_SECONDS) -> DataFrame:
    """Fill opening prices, align to the grid, move the closing trade, fill gaps."""
    return (
        ticks.transform(fill_opening_prices).transform(snap_to_grid).transform(move_closing_trade)
        .transform(fill_tick_gaps, step)
    )


def compact_by_date(ticks: DataFrame, path: str) -> None:
    """Write one folder per date; a large date is split over several tasks, small ones share a task."""
    ticks.hint("rebalance", F.col("date")).write.mode("overwrite").partitionBy("date").parquet(path)
