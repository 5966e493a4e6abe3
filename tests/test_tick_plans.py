"""What the plans of tick queries read, sort and check; their rows are tested beside their SQL."""

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from ticklane.functions.scalar import nearest_integer, time_string
from ticklane.operators import explore as ex
from ticklane.operators import quality as q
from ticklane.operators import repair as x
from ticklane.operators import ticks as t
from ticklane.plans import load_catalog
from ticklane.sources.market import Market

LINE = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    """Two stocks with a trade on most days of two quarters."""
    folder = str(tmp_path_factory.mktemp("lines"))
    days = spark.range(180).where("id % 11 <> 3").crossJoin(spark.range(1, 3).withColumnRenamed("id", "s"))
    days.selectExpr(
        "id as l_orderkey", "1L as l_partkey", "s as l_suppkey", "1 as l_linenumber", "double(1 + id % 40) as l_quantity",
        "double(100 + id) as l_extendedprice", "0D as l_discount", "0D as l_tax", "'A' as l_returnflag",
        "if(id % 2 = 0, 'O', 'F') as l_linestatus",
        "cast(date_add(date'1996-01-01', int(id)) as timestamp_ntz) as l_shipdate").write.parquet(f"{folder}/lineitem.parquet")
    return Market(spark, folder)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_conditions_on_the_time_do_not_repeat_its_rule(market):
    # the time of the planted rows, pushed into a condition, would be worked out again for every row read
    for df in (ex.closing_duplicates(market.raw_stock_ticks()), ex.trades_after_close(market.raw_stock_ticks())):
        conditions = [line for line in plan(df).splitlines() if re.search(r"Filter |DataFilters", line)]
        assert conditions and not any("11:26:00.000" in line or "make_dt_interval" in line for line in conditions)


def test_last_price_of_the_date_before_is_the_close(market):
    rows = market.stock_ticks().orderBy("tscode", "date", "time").select("tscode", "date", "price", "close", "open").collect()
    last, closes = {}, {}
    for row in rows:
        closes.setdefault((row.tscode, row.date), last.get(row.tscode, row.open))
        assert row.close == closes[row.tscode, row.date]
        following = rows[rows.index(row) + 1:rows.index(row) + 2]
        if following and following[0].date != row.date:
            last[row.tscode] = row.price
    assert len(closes) == 4


@pytest.mark.parametrize("repair", [x.replace_closing_record, x.restore_close_records, x.rebuild_closing_record])
def test_repairs_read_each_layer_once(market, repair):
    raw = market.raw_stock_ticks()
    assert plan(repair(t.clean_stock_ticks(raw), raw)).count("FileScan") == 2


def test_chosen_keys_are_looked_for_where_the_layers_are_read(market):
    raw = market.raw_stock_ticks()
    sample = ex.paired_sample(raw, t.clean_stock_ticks(raw), ["tscode", "date"], 2)
    assert "Join" not in plan(sample)
    assert sample.select("tscode", "date").distinct().count() == 2
    assert sample.select("layer").distinct().count() == 2


def test_cleaning_sorts_once(spark, market):
    raw = spark.createDataFrame(market.raw_stock_ticks().limit(5).collect(), market.raw_stock_ticks().schema)
    assert plan(t.clean_stock_ticks(raw)).count("Sort [") == 1


def test_rules_do_not_sort_the_book(market):
    # what comes after the planted rows: the rules' windows
    rules = ["volume_order", "volume_not_cleared", "time_missing", "auction_duplicates", "level_missing"]
    windows = plan(q.validate_stock_ticks(market.raw_stock_ticks(), rules)).split("Generate explode(CASE WHEN ((_k")[0]
    assert windows.count("Sort [") == 2 and windows.count("Exchange") == 0


def test_restored_levels_are_those_asked_for(market):
    raw = market.raw_stock_ticks()
    restored = x.restore_book_levels(raw.withColumns({c: F.col(c) + 1 for c in t.BOOK_COLUMNS}), raw).select("bid_price1")
    assert "SortAggregate" not in plan(restored) and plan(restored).count("max_by") < 10


def test_patched_levels_are_those_asked_for(market):
    patched = x.patch_book_levels(t.clean_stock_ticks(market.raw_stock_ticks()), market.stock_ticks()).select("bid_price1")
    # neither the other levels' columns nor the rows that they lag behind
    assert "bid_price1" in plan(patched) and not re.search(r"(bid|ask)_(price|volume)([2-9]|10)#", plan(patched))


def test_planted_times_keep_the_grid_and_totals_are_whole_without_decimals(spark, market):
    assert "round(" not in plan(market.stock_ticks().select("price", "amount")).split("FileScan")[1]
    rng = random.Random(5)
    values = [0.0, -0.0, 0.5, -0.5, 2.5, -2.5, 0.49999999999999994, -0.49999999999999994, 4503599627370495.5, -4503599627370495.5,
              4503599627370497.0, 9e18, -1e-300, None]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-3, 17) for _ in range(3000)]
    values += [math.nextafter(rng.randint(-10**6, 10**6) + 0.5, way) for way in (-1e9, 1e9) for _ in range(500)]
    numbers = spark.createDataFrame([(v,) for v in values], "v double")
    assert numbers.where(~F.round("v").cast("bigint").eqNullSafe(nearest_integer("v"))).count() == 0


def test_layers_that_are_compared_are_read_once(market):
    raw = market.raw_stock_ticks()
    both = t.clean_stock_ticks(raw, original=F.lit(True))
    assert both.where("_original").drop("_original").exceptAll(raw).count() == 0
    assert both.where("not _original").drop("_original").exceptAll(t.clean_stock_ticks(raw)).count() == 0
    assert both.count() == raw.count() + t.clean_stock_ticks(raw).count()
    found = q.content_differences(both)
    two = q.content_differences(raw, t.clean_stock_ticks(raw))
    assert two.count() > 0 and found.exceptAll(two).count() == 0 == two.exceptAll(found).count()
    query = load_catalog()[0]["v21_content_differences"](market)
    assert plan(query).count("FileScan") == 1 and query.collect()[0].surplus == 1


def test_auction_duplicates_come_from_one_reading(spark, market):
    raw = market.raw_stock_ticks()
    # a stock with a null key, a null time and a time that comes three times
    odd = raw.where("time < '09:24:00.000'").withColumn("time", F.when(F.col("tick_order") % 5 == 0, F.lit("09:20:00.000")).when(
        F.col("tick_order") % 7 > 0, F.col("time"))).withColumn("tscode", F.when(F.col("date") > "1996-04-01", F.col("tscode")))
    rows = raw.unionByName(odd).unionByName(odd.where("tick_order % 3 = 0"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    one, two = x.restore_auction_duplicates(t.clean_stock_ticks, rows), x.restore_auction_duplicates(t.clean_stock_ticks(rows), rows)
    assert one.columns == two.columns and two.count() > t.clean_stock_ticks(rows).count()
    assert one.exceptAll(two).count() == 0 == two.exceptAll(one).count()
    assert plan(one).count("Sort [") == 1
    assert plan(load_catalog()[0]["x01_restore_auction_duplicates"](market)).count("FileScan") == 1


def test_failed_keys_are_looked_up_without_a_sort(market):
    checked = plan(load_catalog()[0]["v22_recheck_failed_keys"](market))
    assert "ShuffledHashJoin" in checked and "SortMergeJoin" not in checked


def test_enriching_fills_every_three_seconds(market):
    seconds = lambda time: int(time[:2]) * 3600 + int(time[3:5]) * 60 + int(time[6:8])
    aligned = t.move_closing_trade(t.snap_to_grid(t.fill_opening_prices(t.clean_stock_ticks(market.raw_stock_ticks()))))
    days = {}
    for row in aligned.select("tscode", F.col("date").cast("string").alias("date"), "time", "tick_order", "volume").collect():
        days.setdefault((row.tscode, row.date), []).append((row.time, row.tick_order, row.volume))
    expected = set()
    for key, rows in days.items():
        rows.sort()
        copies = []
        for (time, _, _), (later, _, _) in zip(rows, rows[1:], strict=False):
            gap = seconds(later) - seconds(time)
            reached = seconds(time) + (5400 if time == "11:30:00.000" else 0)
            if time >= "09:30:00.000":
                copies += [reached + s for s in range(3, gap - 5400 if gap >= 5400 else gap, 3)]
        assert len(copies) > 4000
        expected.add((*key, len(rows) + len(copies), len(copies), sum(v for _, _, v in rows),
                      sum(copies) + sum(seconds(time) for time, _, _ in rows)))
    name = "t02_enrich_stock_ticks"
    queries, sql = load_catalog()
    assert {tuple(row) for row in queries[name](market).collect()} == expected
    lines = f"'{market.folder}/lineitem.parquet/*.parquet'"
    connection = duckdb.connect()
    connection.sql(f"create view lineitem as select * from {lines}")
    assert set(connection.sql(sql[name]).fetchall()) == expected


def test_times_are_looked_up(spark):
    seconds = [*range(-90_000, 180_000, 7), *range(80_000, 87_000), -1, 2**31 - 1, -2**31, None]
    rows = spark.createDataFrame([(s,) for s in seconds], "s int").select("s", time_string("s").alias("time"))
    for row in rows.collect():
        clock = None if row.s is None else row.s % 86_400
        assert row.time == (None if clock is None else f"{clock // 3600:02d}:{clock // 60 % 60:02d}:{clock % 60:02d}.000")
    assert "interval" not in plan(rows) and "split(" not in plan(rows)


def test_copies_share_what_their_row_knows(market):
    # the time is parsed and the next one looked up before the copies are made
    filled = plan(t.fill_tick_gaps(market.raw_stock_ticks()).select("tscode", "time", "volume"))
    above, below = filled.split("Generate explode(sequence", 1)
    assert "substr" not in above and "substr" in below
    assert below.count("lead(") == 1
