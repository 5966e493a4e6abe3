import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklane import constants as K
from ticklane.sources import files
from ticklane.streaming import bars as stream


def test_stock_csv_in_gbk(spark, tmp_path):
    header = [f"列{i}" for i in range(66)]
    row = ["600001.SH", "600001", "2022-04-18", "09:30:00.000", *["1"] * 62]
    other = ["000002.SZ", *row[1:]]
    (tmp_path / "a.csv").write_bytes("\n".join(",".join(r) for r in (header, row, other)).encode("gbk"))
    members = spark.createDataFrame([("600001.SH",)], "tscode string")
    ticks = files.read_stock_csv(spark, str(tmp_path / "a.csv"), members)
    assert ticks.columns == ["tscode", *[c for c in K.STOCK_TICK_COLUMNS if c != "tscode"]] and ticks.count() == 1
    types = dict(ticks.dtypes)
    assert (types["price"], types["volume"], types["ask_volume3"], types["time"]) == ("double", "bigint", "bigint", "string")


def test_future_csv(spark, tmp_path):
    for contract in ("IF2209", "IC2209"):
        (tmp_path / f"CFFEX.{contract}.csv").write_text(
            f"datetime,CFFEX.{contract}.last_price,CFFEX.{contract}.volume\n2022-04-18 09:30:00.500000000,4000.2,5\n")
    ticks = files.read_future_csv(spark, str(tmp_path), ["IF2209", "IC2209"])
    assert ticks.columns == ["datetime", "last_price", "volume", "instrument"] and ticks.count() == 2
    named = files.with_contract(spark.read.option("header", True).csv(str(tmp_path / "CFFEX.IF2209.csv")).select("*", "_metadata"))
    assert named.first()["instrument"] == "IF2209"


def test_fixed_width_bars(spark, tmp_path):
    plain = b"".join(struct.pack("<IIIIIfII", 20220418 + i, 1000, 1100, 900, 1050 + i, 5.5, 77, 0) for i in range(3))
    (tmp_path / "sh600001.day").write_bytes(plain)
    rows = files.read_fixed_width(spark, str(tmp_path / "sh600001.day")).orderBy("date").collect()
    assert [(r["date"], r["close"], r["amount"], r["volume"]) for r in rows][2] == (20220420, 10.52, 5.5, 77)
    (tmp_path / "if.day").write_bytes(struct.pack("<iffffiif", 20220418, 1.5, 2.5, 0.5, 2.0, 9, 8, 2.25))
    assert files.read_fixed_width(spark, str(tmp_path / "if.day"), settled=True).first()["settlement"] == 2.25


def test_partitioned_layer_and_partial_overwrite(spark, tmp_path):
    path = str(tmp_path / "ticks")
    data = spark.createDataFrame([(d, s, i) for i, (d, s) in enumerate((d, s) for d in ("d1", "d2") for s in ("a", "b", "c"))],
                                 "date string, tscode string, v long")
    files.write_table(data, path, ["date"])
    files.write_table(data.where("date = 'd2'").withColumn("v", F.lit(100)), path, ["date"], replace_touched=True)
    assert {r["v"] for r in files.read_table(spark, path, dates=["d2"]).collect()} == {100}
    assert files.read_table(spark, path, dates=["d1"], stocks=["a"], columns=["v"]).collect()[0]["v"] == 0
    wanted = spark.createDataFrame([("d1", "b"), ("d9", "b")], "date string, tscode string")
    assert [r["v"] for r in files.read_pairs(spark, path, wanted).collect()] == [1]
    plan = files.read_table(spark, path, dates=["d2"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "date" in plan.split("PartitionFilters")[1][:80]


def test_factor_layer_text_bars_and_reports(spark, tmp_path):
    factor = spark.createDataFrame([("IF", 1.0), ("IC", 2.0)], "product string, value double")
    files.write_factor(factor, str(tmp_path), "F1")
    files.write_factor(factor.where("product = 'IF'").withColumn("value", F.lit(5.0)), str(tmp_path), "F1")
    assert {(r["product"], r["value"]) for r in files.read_factor(spark, str(tmp_path), "F1").collect()} == {("IF", 5.0), ("IC", 2.0)}
    assert files.read_factor(spark, str(tmp_path), "F1", "IC").count() == 1
    (tmp_path / "daily.txt").write_text("2022-04-18\t1.0\t2.0\t0.5\t1.5\t100\t150.5\n")
    assert files.read_daily_text(spark, str(tmp_path / "daily.txt")).first()["amount"] == 150.5
    files.write_report(factor, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 2
    files.append_table(factor, str(tmp_path / "log"))
    files.append_table(factor, str(tmp_path / "log"))
    assert files.read_metadata(spark, str(tmp_path / "log")).count() == 4
    patch = pd.DataFrame([{"date": "d", "tscode": "a", "hhmmss": 93003,
                           **{f"{s}{i}_{f}": 1.0 for s in ("bid", "ask") for i in range(10) for f in ("price", "volume")}}])
    spark.createDataFrame(patch).write.parquet(str(tmp_path / "patch"))
    assert files.read_book_patch(spark, str(tmp_path / "patch")).first()["time"] == "09:30:03.000"


def test_stream_processes_each_file_once(spark, tmp_path):
    schema = T.StructType([T.StructField("instrument", T.StringType()), T.StructField("datetime", T.TimestampNTZType()),
                           T.StructField("tick_id", T.LongType()), T.StructField("last_price", T.DoubleType()),
                           T.StructField("delta_volume", T.LongType())])
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def arrive(minutes, first):
        rows = pd.DataFrame({"instrument": "IF", "datetime": pd.to_datetime("2022-04-18 09:00") + pd.to_timedelta(minutes, unit="min"),
                             "tick_id": range(first, first + len(minutes)), "last_price": [float(v) for v in minutes],
                             "delta_volume": 1})
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        slots = stream.slot_stream(stream.read_tick_stream(spark, source, schema), 600, "1 minute")
        stream.write_new_slots(slots, target, mark).awaitTermination()

    arrive([0, 3, 9, 12, 40], 0)
    run()
    arrive([45, 90], 10)
    run()
    run()
    made = spark.read.parquet(target).orderBy("slot_end").toPandas()
    assert made["volume"].tolist() == [3, 1, 2] and made["close"].tolist() == [9, 12, 45]


def test_compaction_and_cut_lineage(spark, tmp_path):
    from ticklane.operators.ticks import compact_by_date
    from ticklane.session import cut_lineage

    ticks = spark.createDataFrame([(f"d{i % 2}", f"s{i}", i) for i in range(20)], "date string, tscode string, v long")
    compact_by_date(ticks.repartition(5), str(tmp_path / "days"))
    assert len(list((tmp_path / "days" / "date=d0").glob("*.parquet"))) == 1 and spark.read.parquet(str(tmp_path / "days")).count() == 20
    cut = cut_lineage(ticks.withColumn("w", F.col("v") * 2))
    assert cut.agg(F.sum("w")).first()[0] == 380
    assert "Project" not in cut._jdf.queryExecution().optimizedPlan().toString()


def test_a_hot_partition_gets_several_files_and_small_ones_one(spark, tmp_path):
    rows = spark.range(200_000).select(F.when(F.col("id") < 150_000, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id") % 25)).alias("product"),
                                       F.xxhash64("id").alias("v"))
    name, before = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set(name, "256k")
    try:
        files.write_table(rows.repartition(6), str(tmp_path / "t"), ["product"])
    finally:
        spark.conf.set(name, before)
    sizes = {p.name: [f.stat().st_size for f in p.glob("*.parquet")] for p in (tmp_path / "t").glob("product=*")}
    assert len(sizes) == 26 and len(sizes.pop("product=hot")) >= 3 and all(len(parts) == 1 for parts in sizes.values())
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200_000


def test_records_are_cut_at_their_borders(spark, tmp_path):
    from ticklane.sources import records

    assert records.cut_ranges([("a", 100), ("b", 0), ("c", 31), ("d", 320)], 100) == [
        [("a", 0, 96)], [("d", 0, 96)], [("d", 96, 96)], [("d", 192, 96)], [("d", 288, 32)]]
    assert records.cut_ranges([("a", 64), ("b", 64)], 1 << 20) == [[("a", 0, 64), ("b", 0, 64)]]
    bars = spark.range(5000).select(F.when(F.col("id") < 4000, "big").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("instrument"),
                                    (F.col("id") + 20000101).cast("int").alias("date"), (F.col("id") / 100).alias("open"), F.lit(2.25).alias("high"),
                                    F.lit(0.0).alias("low"), F.lit(1.5).alias("close"), F.lit(7).alias("volume"), F.lit(0.5).alias("amount"))
    path = str(tmp_path / "bars")
    files.write_fixed_width(bars.repartition(4), path)
    (tmp_path / "bars" / "big-cut.day").write_bytes(b"x" * 20)
    table = spark.read.format("records").option("rangeBytes", 32 * 300 + 5).load(path)
    assert table.rdd.getNumPartitions() == 17
    same = [c for c in bars.columns]
    back = table.select(*same).orderBy("date").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in bars.orderBy("date").collect()]
    assert not [p for p in (tmp_path / "bars").iterdir() if p.name.startswith("_")]
    assert files.read_fixed_width(spark, path).where("instrument = 'big'").count() == 4000
    settled = bars.select("instrument", "date", "open", "high", "low", "close", F.lit(3).alias("interest"), "volume", F.lit(1.25).alias("settlement"))
    files.write_fixed_width(settled, str(tmp_path / "settled"), settled=True)
    assert files.read_fixed_width(spark, str(tmp_path / "settled"), settled=True).agg(F.sum("settlement"), F.sum("interest")).first() == (6250.0, 15000)
    files.write_fixed_width(bars.limit(0), str(tmp_path / "none"))
    assert files.read_fixed_width(spark, str(tmp_path / "none")).count() == 0
