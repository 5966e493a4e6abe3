"""The market tables built from the star-schema parquet tables this repository is run on.

==================  =================================================================================
market table        source and rule
==================  =================================================================================
futures ticks       ``events``: contract = event_type, price = 100 + value, traded volume = ``$.k`` of
                    props, open interest = user_id, date and second of day from ts
bars                hourly bars of those ticks around the clock, on the full slot grid
stock ticks         ``lineitem`` per supplier and ship day: a quarter is a trading date and its days are
                    times of that date (16 days per auction stage, 30 per session half)
order book          level k of a side is the side's price k-1 ticks ago; an absent level is 0
constituents        ``supplier`` in its region; odd suppliers join in 1998
contract calendar   contracts and dates of the futures ticks; the busiest one of a date is the main one
==================  =================================================================================

Sums use exact integers (cents, 1e-4 of a cent) so that prices do not depend on the order of rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticklane import constants as K
from ticklane.functions.scalar import nearest_integer, time_string, whole_seconds
from ticklane.functions.series import with_position
from ticklane.operators.bars import continuous_session, session_bars

BAR_KEYS = ["instrument"]
HOURLY = continuous_session(3600)
SIDES = ("bid", "ask")
JOIN_DATE = "1998-01-01"
FIRST_TRADE_DAY = 28
QUARTER_DAYS = 92
# more than any 64-bit id, counted from the smallest one
ORDER_IDS = Decimal(10) ** 20
SMALLEST_ID = Decimal(-(1 << 63))


class Market:
    """Lazy access to one folder of parquet tables and the market tables derived from it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self._bars: DataFrame | None = None
        self._ticks: DataFrame | None = None
        self._defects: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- futures -----------------------------------------------------------------------

    def future_ticks(self) -> DataFrame:
        events = self.table("events")
        ts = F.col("ts").cast("timestamp_ntz")
        second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
        # time within the day, then the whole id: one fixed-width key lets first and last values be picked
        # in a hash aggregate, without sorting the ticks
        micros = F.timestamp_diff("MICROSECOND", ts.cast("date").cast("timestamp_ntz"), ts)
        tick_order = (micros.cast("decimal(12,0)") * F.lit(ORDER_IDS)
                      + (F.col("event_id").cast("decimal(19,0)") - F.lit(SMALLEST_ID)))
        return events.select(
            F.col("event_type").alias("instrument"),
            ts.cast("date").alias("date"),
            ts.alias("datetime"),
            F.col("event_id").alias("tick_id"),
            tick_order.alias("tick_order"),
            second.alias("second"),
            (F.col("value") + 100).alias("last_price"),
            F.get_json_object("props", "$.k").cast("bigint").alias("delta_volume"),
            F.col("user_id").alias("open_interest"),
        )

    def bars(self) -> DataFrame:
        """Hourly bars with ``pos``, the number of a bar in its contract.

        The bar table is far smaller than the ticks (24 rows per contract and day) and is read
        more than once, so it is persisted, as the stored bar layer would be.
        """
        if self._bars is None:
            trades = self.future_ticks().where(F.col("delta_volume") > 0)
            self._bars = session_bars(trades, ["instrument", "date"], HOURLY, F.col("second"),
                                      ["tick_order"]).persist()
        return with_position(self._bars, BAR_KEYS, ["slot"], "date")

    def release(self) -> None:
        if self._bars is not None:
            self._bars.unpersist()
        self._bars = None

    # --- stocks ------------------------------------------------------------------------

    def stock_ticks(self) -> DataFrame:
        """Level-2 ticks per stock, date and time with ten book levels and cumulative columns.

        Only the plan is kept; nothing is stored, so a query reads just the columns it needs.
        """
        if self._ticks is None:
            self._ticks = self._quoted_ticks()
        return self._ticks

    def stock_dates(self) -> DataFrame:
        """The dates that have stock ticks, from one column."""
        return self.table("lineitem").select(F.date_trunc("quarter", F.col("l_shipdate")).cast("date").alias("date")).distinct()

    def _quoted_ticks(self) -> DataFrame:
        # columns of their own, as the integers and the sums use them several times
        line = self.table("lineitem").withColumns({
            "_exact_cents": F.col("l_extendedprice") * 100,
            "_exact_paid": F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10_000}).withColumns({
                "_line_cents": nearest_integer("_exact_cents"), "_line_paid": nearest_integer("_exact_paid")})
        cents, paid = F.col("_line_cents"), F.col("_line_paid")
        units = F.col("l_quantity").cast("bigint")
        side = {"bid": F.col("l_linestatus") == "O", "ask": F.col("l_linestatus") == "F"}
        sums = [F.sum(cents).alias("_cents"), F.sum(units).alias("volume"), F.sum(paid).alias("_paid"),
                F.count(F.lit(1)).alias("_trades")]
        for name, is_side in side.items():
            sums += [F.sum(F.when(is_side, cents)).alias(f"_{name}_cents"),
                     F.sum(F.when(is_side, units)).alias(f"_{name}_units")]
        # map-side sums first: a busy supplier leaves each task with at most one row per day
        daily = line.groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("_day")).agg(*sums)
        quarter = F.trunc("_day", "quarter")
        offset = F.datediff("_day", quarter)
        # before the opening trade, and for every seventh volume, a tick only quotes
        traded = (offset >= FIRST_TRADE_DAY) & (F.col("volume") % 7 != 0)
        ticks = daily.select(
            stock_code(F.col("l_suppkey")).alias("tscode"),
            quarter.alias("date"),
            quarter_time(offset).alias("time"),
            (F.col("_cents") / F.lit(100.0) / F.col("volume")).alias("price"),
            F.when(traded, F.col("volume")).otherwise(0).alias("volume"),
            (F.when(traded, F.col("_paid")).otherwise(0) / F.lit(10_000.0)).alias("amount"),
            F.when(traded, F.col("_paid")).otherwise(0).alias("_paid"),
            F.when(traded, F.col("_trades")).otherwise(0).alias("_trades"),
            *[F.coalesce(F.try_divide(F.col(f"_{name}_cents") / F.lit(100.0), F.col(f"_{name}_units")),
                         F.lit(0.0)).alias(f"_{name}_price") for name in SIDES],
            *[F.coalesce(F.col(f"_{name}_units"), F.lit(0)).alias(f"_{name}_volume") for name in SIDES],
        )
        # a day is one row of a stock, so the row before the first one of a date holds the last price of the date before;
        # the stock's window comes first: the windows of its dates need no other exchange or sort
        dates = Window.partitionBy("tscode").orderBy("date", "time")
        ticks = ticks.withColumn("_before", F.lag("price").over(dates))
        day = Window.partitionBy("tscode", "date").orderBy("time")
        so_far = day.rowsBetween(Window.unboundedPreceding, 0)
        book = [F.lag(f"_{name}_{field}", level - 1, 0).over(day).alias(f"{name}_{field}{level}")
                for name in reversed(SIDES) for field in ("price", "volume") for level in range(1, K.BOOK_DEPTH + 1)]
        ticks = ticks.select(
            "tscode", "date", "time", "price", "volume", "amount",
            F.sum("_trades").over(so_far).alias("transaction_number"),
            F.sum("volume").over(so_far).alias("daily_accumulated_volume"),
            (F.sum("_paid").over(so_far) / F.lit(10_000.0)).alias("daily_amount"),
            F.max("price").over(so_far).alias("high"),
            F.min("price").over(so_far).alias("low"),
            F.first("price").over(so_far).alias("open"),
            F.coalesce(F.first("_before").over(so_far), F.first("price").over(so_far)).alias("close"),
            *book,
            *[F.sum(f"_{name}_volume").over(day.rowsBetween(1 - K.BOOK_DEPTH, 0)).alias(f"total_{name}_volume")
              for name in SIDES],
            *[F.sum(F.col(f"_{name}_price") * F.col(f"_{name}_volume")).over(day.rowsBetween(1 - depth, 0))
              .alias(f"grade{depth}_{name}_amount") for depth in (10, 5) for name in SIDES],
        )
        # level k is the tick k-1 rows ago, so the book totals above are rolling sums
        return ticks.withColumns({
            f"weighted_average_{name}_price": F.coalesce(
                F.try_divide(F.col(f"grade10_{name}_amount"), F.col(f"total_{name}_volume")), F.lit(0.0))
            for name in SIDES})

    def raw_stock_ticks(self) -> DataFrame:
        """The stock ticks with the defects the quality rules look for, placed by a rule on stock and time.

        Repeated rows, zero prices and transaction numbers, volume without a trade, off-grid times,
        rows inside the noon break, closing trades at and after 15:00. ``tick_order`` is the file order.
        """
        if self._defects is None:
            self._defects = self._defective_ticks()
        return self._defects

    def stored_raw_ticks(self) -> DataFrame:
        """The same rows for jobs that read the original layer several times.

        It stands for the stored original layer, which is read again each time: keeping it would fill the
        executors' disks.
        """
        return self.raw_stock_ticks()

    def _defective_ticks(self) -> DataFrame:
        number, second = F.col("_number"), F.col("_second")
        ticks = self.stock_ticks().withColumns({
            "_number": F.col("tscode").substr(4, 20).cast("bigint"), "_second": whole_seconds("time")}) \
            .withColumn("_k", (number * 31 + second / 3).cast("bigint") % 97)
        last_morning, last_row = F.col("time") == "11:26:00.000", F.col("time") == "14:56:00.000"
        shift = F.when(F.col("time") < K.SESSION_START, 0).when(F.col("_k") % 7 == 2, 1) \
            .when(F.col("_k") % 7 == 3, 2).otherwise(0)
        time = (
            F.when(last_morning & (number % 3 == 0), "11:31:00.000").when(last_morning & (number % 3 == 1), K.NOON_END)
            .when(last_row & (number % 5 == 0), "15:00:03.000").when(last_row & (number % 5 < 3), K.SESSION_END)
            .when(shift > 0, time_string(second + shift)).otherwise(F.col("time")))
        # the time is generated beside the number of the copy: a condition on it is then checked on the finished column;
        # pushed below, it would repeat the whole rule for each use of the time
        copy = lambda n: F.struct(F.lit(n).alias("copy"), F.col("_time").alias("time"))
        copies = F.when(F.col("_k") % 10 == 3, F.array(copy(0), copy(1))).otherwise(F.array(copy(0)))
        k = F.col("_k")
        placed = ticks.withColumns({"_time": time, "_order": second * 2}).withColumn("_copy", F.explode(copies))
        traded = F.when((k % 29 == 8) & (F.col("volume") == 0), 10).otherwise(F.col("volume"))
        return placed.withColumns({
            "time": F.col("_copy.time"),
            "tick_order": (F.col("_order") + F.col("_copy.copy")).cast("bigint"),
            "price": F.when(k % 19 == 4, 0.0).otherwise(F.col("price")),
            "transaction_number": F.when(k % 23 == 7, 0).otherwise(F.col("transaction_number")),
            "volume": F.when((F.col("_copy.copy") == 1) & (k % 20 == 3), 0).otherwise(traded),
        }).drop("_copy", "_time", "_order", "_k", "_number", "_second")

    def constituents(self) -> DataFrame:
        """(product, tscode, start_date, end_date)."""
        members = (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        )
        late = F.col("s_suppkey") % 2 == 1
        return members.select(
            F.col("r_name").alias("product"),
            stock_code(F.col("s_suppkey")).alias("tscode"),
            F.when(late, F.lit(JOIN_DATE)).otherwise(F.lit("1990-01-01")).cast("date").alias("start_date"),
            F.lit("2030-12-31").cast("date").alias("end_date"),
        )

    def contract_calendar(self) -> DataFrame:
        """(product, instrument, date, is_main) with the contract of the largest volume as the main one."""
        daily = self.future_ticks().groupBy("instrument", "date").agg(F.sum("delta_volume").alias("_volume"))
        busiest = Window.partitionBy("date").orderBy(F.col("_volume").desc(), "instrument")
        return daily.select(
            F.lit("EV").alias("product"), "instrument", "date",
            F.when(F.row_number().over(busiest) == 1, K.IS_MAIN).otherwise(1).alias("is_main"))


def stock_code(supplier: Column) -> Column:
    """Code of a supplier; the board prefix rotates over four boards."""
    board = F.element_at(F.array(*[F.lit(b) for b in ("600", "000", "300", "688")]),
                         (supplier % 4 + 1).cast("int"))
    return F.concat(board, F.lpad(supplier.cast("string"), 9, "0"))


def quarter_time(offset: Column) -> Column:
    """Time that stands for a day of the quarter (0..91)."""
    seconds = [33300 + d * 18 if d < 16 else 33600 + (d - 16) * 18 if d < 32 else 34200 + (d - 32) * 240 if d < 62
               else 46800 + (d - 62) * 240 for d in range(QUARTER_DAYS)]
    # looked up, as a condition on the time repeats its expression
    times = F.array(*[F.lit(f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}.000") for s in seconds])
    return F.when(offset.isNotNull(), F.element_at(times, offset + 1))
