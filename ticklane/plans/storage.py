"""Queries that write a table in a stored format and read it back, checked against the table itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane import constants as K
from ticklane.operators.factor_tables import build_factor_table, factor_config, resolve_factor
from ticklane.operators.ticks import compact_by_date
from ticklane.plans import oracle as o
from ticklane.plans.catalog import add, date_text, rounded
from ticklane.plans.evaluation import CHUNK, FACTORED, factored
from ticklane.session import shared_folder, stored
from ticklane.sources import files
from ticklane.sources.market import stock_code

TICK = ["tscode", "date", "time", "price", "volume"]
TICK_SQL = "tscode, CAST(date AS VARCHAR) AS date, time, round(price, 9) + 0.0 AS price, volume"


def _path(market) -> str:
    return f"{shared_folder(market.spark)}/layer-{uuid.uuid4().hex}"


def _ticks_back(table: DataFrame) -> DataFrame:
    return table.select("tscode", F.col("date").cast("string").alias("date"), "time", rounded("price", 9), "volume")


def _partitioned(market) -> DataFrame:
    path = _path(market)
    ticks = market.stock_ticks().select(*TICK)
    files.write_table(ticks, path, ["date"])
    return _ticks_back(files.read_table(market.spark, path))


def _compacted(market) -> DataFrame:
    path = _path(market)
    compact_by_date(market.stock_ticks().select(*TICK), path)
    return _ticks_back(files.read_table(market.spark, path))


def _appended(market) -> DataFrame:
    path = _path(market)
    ticks = market.stock_ticks().select(*TICK)
    for rule in ("volume = 0", "volume <> 0"):
        files.append_table(ticks.where(rule), path)
    return _ticks_back(files.read_table(market.spark, path))


def _stock_csv(market) -> DataFrame:
    # reads and writes of GBK need this setting of the session
    conf, name = market.spark.conf, "spark.sql.legacy.javaCharsets"
    before = conf.get(name)
    conf.set(name, "true")
    path = _path(market)
    ticks = market.stock_ticks()
    raw = ticks.select(*[(F.col(name) if name in ticks.columns else F.lit(0)).cast("string").alias(name) for name in K.STOCK_TICK_COLUMNS])
    raw.write.option("header", True).option("encoding", "GBK").option("compression", "gzip").csv(path)
    members = market.table("supplier").select(stock_code(F.col("s_suppkey")).alias("tscode"))
    back = stored(_ticks_back(files.read_stock_csv(market.spark, path, members)))
    conf.set(name, before)
    return back


def _future_csv(market) -> DataFrame:
    path = _path(market)
    known = {"datetime": F.date_format("datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "last_price": F.col("last_price"),
             "volume": F.col("delta_volume"), "open_interest": F.col("open_interest")}
    ticks = market.future_ticks().select(
        F.concat(F.lit("CFFEX."), F.col("instrument"), F.lit("2401")).alias("contract"),
        *[known.get(name, F.lit(0)).alias(name) for name in files.FUTURE_COLUMNS])
    ticks.write.partitionBy("contract").option("header", True).csv(path)
    return files.read_future_folder(market.spark, path).select(
        "instrument", "datetime", rounded("last_price"), "volume", "open_interest")


def _daily(market) -> DataFrame:
    return market.bars().groupBy("instrument", "date").agg(
        F.min_by("open", "slot").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "slot").alias("close"), F.sum("volume").alias("volume"))


DAILY_SQL = (f"WITH {o.BARS} SELECT instrument, CAST(date AS VARCHAR) AS date, {o.r('arg_min(open, slot)')} AS open, "
             f"{o.r('max(high)')} AS high, {o.r('min(low)')} AS low, {o.r('arg_max(close, slot)')} AS close, "
             f"CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY instrument, date")


def _daily_by_contract(market) -> DataFrame:
    path = _path(market)
    files.write_table(_daily(market).withColumn("product", F.col("instrument")), path, ["product", "instrument"])
    return files.read_table(market.spark, path).select(
        "instrument", date_text(), *[rounded(c) for c in ("open", "high", "low", "close")], "volume")


def _daily_text(market) -> DataFrame:
    path = _path(market)
    columns = ["open", "high", "low", "close", "volume", F.lit(0.0).alias("amount")]
    # the file holds no contract: the date carries it through
    _daily(market).select(F.concat_ws("/", "instrument", "date").alias("date"), *columns).write.option("sep", "\t").csv(path)
    back = files.read_daily_text(market.spark, path).withColumn("_parts", F.split("date", "/"))
    return back.select(F.col("_parts")[0].alias("instrument"), F.col("_parts")[1].alias("date"),
                       *[rounded(c) for c in ("open", "high", "low", "close")], "volume")


def _factor(market) -> DataFrame:
    path, code = _path(market), "FCT_01_001_WILLIAM_1.0"
    table = factored(market).select(F.col("instrument").alias("product"), "datetime", "william")
    files.write_factor(table, path, code)
    files.write_factor(table.where("product = 'view'").withColumn("william", F.col("william") * 2), path, code)
    files.write_factor(table.withColumn("william", -F.col("william")), path, code, organized=True)
    parts = [files.read_factor(market.spark, path, code).withColumn("layer", F.lit("raw")),
             files.read_factor(market.spark, path, code, "view", organized=True).withColumn("layer", F.lit("organized"))]
    return parts[0].unionByName(parts[1]).select("product", F.col("datetime").cast("string"), "layer", rounded("william"))


def _records(settled: bool):
    def build(market) -> DataFrame:
        path = _path(market)
        daily = market.bars().groupBy("instrument", "date").agg(
            F.min_by("open", "slot").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "slot").alias("close"), F.sum("volume").alias("volume"), F.max_by("interest", "slot").alias("interest"))
        daily = daily.withColumns({"date": F.date_format("date", "yyyyMMdd").cast("int"), "amount": F.col("close") * F.col("volume"),
                                   "settlement": (F.col("high") + F.col("low")) / 2})
        files.write_fixed_width(daily, path, settled)
        back = files.read_fixed_width(market.spark, path, settled)
        last = ["interest", rounded("settlement", 4)] if settled else [rounded("amount", 0)]
        return back.select("instrument", "date", *[rounded(c, 4) for c in ("open", "high", "low", "close")], "volume", *last)

    return build


def _records_sql(settled: bool) -> str:
    kept = (lambda c: f"round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 4) + 0.0") if settled else (lambda c: f"round({c}, 2) + 0.0")
    last = (f"interest, {kept('(high + low) / 2')} AS settlement" if settled
            else "round(CAST(CAST(close * volume AS FLOAT) AS DOUBLE), 0) + 0.0 AS amount")
    return (f"WITH {o.BARS}, daily AS (SELECT instrument, date, arg_min(open, slot) AS open, max(high) AS high, min(low) AS low, "
            f"arg_max(close, slot) AS close, CAST(sum(volume) AS BIGINT) AS volume, arg_max(interest, slot) AS interest FROM bars GROUP BY ALL) "
            f"SELECT instrument, CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date, "
            + ", ".join(f"{kept(c)} AS {c}" for c in ("open", "high", "low", "close")) + f", volume, {last} FROM daily")


def _book_patch(market) -> DataFrame:
    path = _path(market)
    levels = [(side, i, field) for side in ("bid", "ask") for i in range(1, K.BOOK_DEPTH + 1) for field in ("price", "volume")]
    clock = F.regexp_replace(F.substring("time", 1, 8), ":", "").cast("int")
    patch = market.stock_ticks().select(F.col("date").cast("string").alias("date"), "tscode", clock.alias("hhmmss"),
                                        *[F.col(f"{side}_{field}{i}").alias(f"{side}{i - 1}_{field}") for side, i, field in levels])
    files.write_table(patch, path, ["date"])
    back = files.read_book_patch(market.spark, path)
    return back.select("tscode", F.col("date").cast("string").alias("date"), "time", *[
        rounded(f"{side}_price{i}", 9) for side in ("bid", "ask") for i in (1, 10)], "bid_volume2", "ask_volume9")


def _factor_list(market) -> DataFrame:
    path = _path(market)
    names = {"FCT_01_001_WILLIAM": "20", "FCT_01_035_VOLUME_MOMENTUM": "10"}
    wanted = factor_config(market.spark).where(F.col("code").isin(*names))
    lengths = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    files.write_report(wanted.select("code", "version", "type", "number", F.col("full_name").alias("name"),
                                     F.element_at(lengths, F.col("code")).alias("parameter"), F.lit("list").alias("source")), path)
    # a list of factors to compute is a few lines long
    listed = files.read_factor_list(market.spark, path).orderBy("code").collect()
    requests = [resolve_factor(f"{row.code}_{row.version}", row.parameter) for row in listed]
    table = build_factor_table(market.bars(), requests, chunk_rows=CHUNK)
    return table.select("instrument", "datetime", rounded(requests[0].keys[0], 6, "william"), rounded(requests[1].keys[0], 6, "momentum"))


def _report(market) -> DataFrame:
    path = _path(market)
    report = market.table("orders").groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    files.write_report(report, path)
    return market.spark.read.option("header", True).schema("o_orderstatus string, o_orderpriority string, orders bigint, cents bigint").csv(path)


def register() -> None:
    for name, build in (("s02_partitioned_table", _partitioned), ("s08_compacted_by_date", _compacted), ("s02_appended_table", _appended),
                        ("s03_stock_csv_in_gbk", _stock_csv)):
        add(name, build, f"WITH {o.TICKS} SELECT {TICK_SQL} FROM ticks")
    add("s04_future_csv_folder", _future_csv,
        "SELECT event_type || '2401' AS instrument, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS datetime, "
        f"{o.r('value + 100')} AS last_price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume, user_id AS open_interest FROM events")
    add("s09_daily_bars_by_contract", _daily_by_contract, DAILY_SQL)
    add("s11_daily_bars_as_text", _daily_text, DAILY_SQL)
    both = "SELECT instrument AS product, datetime, '{}' AS layer, round({}, 6) + 0.0 AS william FROM factored"
    add("s10_factor_layers", _factor,
        f"WITH {FACTORED} {both.format('raw', "CASE WHEN instrument = 'view' THEN william * 2 ELSE william END")} UNION ALL "
        f"{both.format('organized', '-william')} WHERE instrument = 'view'")
    for name, settled in (("s12_fixed_width_bars", False), ("s13_fixed_width_bars_with_settlement", True)):
        add(name, _records(settled), _records_sql(settled))
    prices = ", ".join(f"round({side}_price{i}, 9) + 0.0 AS {side}_price{i}" for side in ("bid", "ask") for i in (1, 10))
    add("s15_book_patch", _book_patch,
        f"WITH {o.TICKS} SELECT tscode, CAST(date AS VARCHAR) AS date, time, {prices}, bid_volume2, ask_volume9 FROM ticks")
    add("s16_factor_list", _factor_list,
        f"WITH {FACTORED} SELECT instrument, datetime, {o.r('william')} AS william, {o.r('momentum')} AS momentum FROM factored")
    add("s17_csv_report", _report,
        "SELECT o_orderstatus, o_orderpriority, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents "
        "FROM orders GROUP BY ALL")
