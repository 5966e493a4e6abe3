"""Negative fixtures for the rules, and repairs that make them pass."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ticklane.operators import quality as q
from ticklane.operators import repair as x
from ticklane.operators import ticks as t

DAY = dt.date(2022, 4, 18)
SCHEMA = ("tscode string, date date, time string, tick_order long, price double, open double, high double, low double, "
          "close double, volume long, amount double, transaction_number long, daily_accumulated_volume long, "
          "daily_amount double, " + ", ".join(f"{c} double" for c in t.BOOK_COLUMNS))


def make(spark, rows, code="600001"):
    """rows: (time, volume, changes)"""
    data, total, number = [], 0, 0
    for i, (time, volume, *changes) in enumerate(rows):
        total += volume
        number += volume > 0
        row = dict(tscode=code, date=DAY, time=time, tick_order=i, price=10.0, open=10.0, high=10.5, low=9.5, close=10.0,
                   volume=volume, amount=volume * 10.0, transaction_number=number, daily_accumulated_volume=total,
                   daily_amount=total * 10.0, **{c: 1.0 for c in t.BOOK_COLUMNS})
        row.update(changes[0] if changes else {})
        data.append(tuple(row[f.split()[0]] for f in SCHEMA.split(", ")))
    return spark.createDataFrame(data, SCHEMA)


GOOD = [("09:20:00.000", 0), ("09:25:00.000", 5), ("11:29:55.000", 1), ("11:30:00.000", 1), ("13:00:00.000", 1),
        ("13:00:10.000", 1), ("15:00:00.000", 2)]


def failures(ticks, **options):
    rows = q.validate_stock_ticks(ticks, minimum_rows=3, **options).where("result = 1").collect()
    return {r["rule"] for r in rows} - {"always_fail"}


def test_good_day_passes(spark):
    # long pauses inside a half are the one thing this short day cannot avoid
    assert failures(make(spark, GOOD)) <= {"time_missing"}


@pytest.fixture(scope="module")
def broken(spark):
    cases = {
        "volume_order": [*GOOD[:-1], ("15:00:00.000", 2, {"daily_accumulated_volume": 1})],
        "zero_price": [*GOOD[:4], ("13:00:00.000", 1, {"price": 0.0}), *GOOD[5:]],
        "zero_ohlc": [*GOOD[:4], ("13:00:00.000", 1, {"high": 0.0}), *GOOD[5:]],
        "repeat_records": [*GOOD[:5], ("13:00:10.000", 0), *GOOD[5:]],
        "noon_missing": [r for r in GOOD if r[0] != "11:30:00.000"],
        "close_missing": GOOD[:-1],
        "closing_auction_late": [*GOOD, ("15:00:03.000", 4)],
        "auction_duplicates": [GOOD[0], *GOOD],
        "closing_duplicates": [*GOOD, ("15:00:00.000", 0)],
        "zero_transaction_number": [*GOOD[:4], *[(m, 1, {"transaction_number": 0}) for m in ("13:00:00.000", "13:00:10.000")],
                                    GOOD[-1]],
        "volume_not_cleared": [*GOOD[:5], ("13:00:10.000", 0, {"volume": 7}), GOOD[-1]],
        "no_volume": [(m, 0) for m, *_ in GOOD],
        "level_missing": [*GOOD[:4], ("13:00:00.000", 1, {"bid_price3": 0.0}), *GOOD[5:]],
        "incomplete_day": GOOD[:-1],
        "incomplete_length": [("15:00:00.000", 1), ("11:30:00.000", 1)],
    }
    frames = [make(spark, rows, f"60{i:04d}") for i, rows in enumerate(cases.values())]
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    found = q.validate_stock_ticks(union, minimum_rows=3).where("result = 1").collect()
    by_code = {}
    for row in found:
        by_code.setdefault(row["tscode"], set()).add(row["rule"])
    return {name: by_code.get(f"60{i:04d}", set()) for i, name in enumerate(cases)}


@pytest.mark.parametrize("rule", ["volume_order", "zero_price", "zero_ohlc", "repeat_records", "noon_missing", "close_missing",
                                  "closing_auction_late", "auction_duplicates", "closing_duplicates",
                                  "zero_transaction_number", "volume_not_cleared", "no_volume", "level_missing",
                                  "incomplete_day", "incomplete_length"])
def test_rule_finds_its_defect(broken, rule):
    assert rule in broken[rule]


def test_price_limit_explains_missing_levels(spark):
    # at the upper limit the ask side is empty
    empty_ask = {f"ask_{f}{i}": 0.0 for f in ("price", "volume") for i in range(1, 11)}
    limit_up = make(spark, [*GOOD[:4], ("13:00:00.000", 1, {"price": 11.0, **empty_ask}), *GOOD[5:]])
    assert "level_missing" not in failures(limit_up)
    plain = make(spark, [*GOOD[:4], ("13:00:00.000", 1, empty_ask), *GOOD[5:]])
    assert "level_missing" in failures(plain)


def test_suspended_stock_fails_with_that_alone(spark):
    ticks = make(spark, GOOD)
    rows = q.validate_stock_ticks(ticks, suspended=ticks.select("tscode", "date")).collect()
    assert [(r["rule"], r["result"]) for r in rows] == [("suspended", 1)]


def test_cleaner(spark):
    rows = [("09:14:59.000", 0), ("0::.0", 0), ("09:20:00.000", 0), ("09:20:00.000", 0), ("10:00:00.000", 0), ("10:00:00.000", 5),
            ("10:00:03.000", 0), ("10:00:03.000", 0), ("10:00:06.000", 0), ("10:00:06.000", 0), ("10:00:06.000", 0),
            ("12:00:00.000", 4), ("15:00:03.000", 1), ("15:00:06.000", 1, {"price": 0.0})]
    kept = [(r["time"][:8], r["volume"]) for r in t.clean_stock_ticks(make(spark, rows)).orderBy("tick_order").collect()]
    assert kept == [("09:20:00", 0), ("09:20:00", 0), ("10:00:00", 5), ("10:00:03", 0), ("10:00:06", 0), ("10:00:06", 0),
                    ("15:00:03", 1)]


def test_alignment_and_filling(spark):
    rows = [("09:29:58.000", 0), ("09:30:01.000", 1, {"price": 0.0, "close": 9.0}), ("09:30:02.000", 1), ("09:30:09.000", 1), ("10:30:00.000", 1),
            ("11:30:00.000", 1), ("13:00:03.000", 1), ("14:00:00.000", 1), ("14:59:57.000", 1), ("15:00:00.000", 0), ("15:00:05.000", 3),
            ("15:00:09.000", 0)]
    ticks = make(spark, rows)
    aligned = t.move_closing_trade(t.snap_to_grid(t.fill_opening_prices(ticks))).orderBy("time", "tick_order").collect()
    assert [r["time"][:8] for r in aligned] == ["09:29:58", "09:30:02", "09:30:03", "09:30:09", "10:30:00", "11:30:00", "13:00:03",
                                                "14:00:00", "14:59:57", "15:00:00"]
    assert aligned[2]["price"] == 10.0  # the first row of the day with a previous close
    assert aligned[-1]["volume"] == 3
    full = t.enrich_stock_ticks(ticks)
    assert full.where("time >= '09:30:03.000'").select("time").distinct().count() == 2400 + 2400
    assert t.fill_tick_gaps(full.drop("filled")).where("filled").count() == 0
    assert full.agg(F.sum("volume")).first()[0] == ticks.agg(F.sum("volume")).first()[0]


def test_repairs_make_rules_pass(spark):
    late = make(spark, [*GOOD[:-1], ("15:00:00.000", 0), ("15:00:03.000", 4)])
    fixed = x.rebuild_closing_record(late, late)
    assert {"closing_auction_late", "incomplete_day"}.isdisjoint(failures(fixed))
    short = make(spark, GOOD[:-1])
    full = make(spark, GOOD)
    assert "close_missing" not in failures(x.restore_close_records(short, full))
    no_noon = make(spark, [r for r in GOOD if r[0] != "11:30:00.000"])
    restored = x.restore_close_records(no_noon, no_noon)
    assert "noon_missing" in failures(no_noon)
    assert restored.where("time > '11:29:55.000' and time < '13:00:00.000'").count() == 1  # 11:29:58 only, 3 s apart
    uncleared = make(spark, [*GOOD[:5], ("13:00:10.000", 0, {"volume": 7}), GOOD[-1]])
    assert "volume_not_cleared" not in failures(x.clear_untraded_volume(uncleared))
    zeros = make(spark, [*GOOD[:4], *[(m, 1, {"transaction_number": 0}) for m in ("13:00:00.000", "13:00:10.000")], GOOD[-1]])
    assert "zero_transaction_number" not in failures(x.carry_transaction_number(zeros))
    repeats = make(spark, [*GOOD[:5], ("13:00:10.000", 0), ("13:00:10.000", 0), *GOOD[5:]])
    assert "repeat_records" in failures(repeats)
    once = x.drop_repeat_records(repeats).where("time = '13:00:10.000'").collect()
    assert [r["volume"] for r in once] == [1]
    empty = make(spark, [(m, v, {"volume": 0, "amount": 0.0}) for m, v in GOOD])
    rebuilt = x.volume_from_totals(empty).orderBy("tick_order").collect()
    assert [r["volume"] for r in rebuilt][1:] == [v for _, v in GOOD][1:]


def test_patch_and_restore_levels(spark):
    broken_book = make(spark, [*GOOD[:4], ("13:00:00.000", 1, {"bid_price3": 0.0}), *GOOD[5:]])
    patch = make(spark, GOOD).withColumn("bid_price3", F.lit(8.0))
    patched = x.patch_book_levels(broken_book, patch)
    assert patched.where("time = '13:00:00.000'").first()["bid_price3"] == 8.0
    assert patched.where("time = '13:00:10.000'").first()["bid_price3"] == 1.0
    assert x.restore_book_levels(patched, broken_book).where("time = '13:00:00.000'").first()["bid_price3"] == 0.0
    swapped = t.swap_book_sides(broken_book)
    assert swapped.where("time = '13:00:00.000'").first()["ask_price3"] == 0.0
    assert swapped.columns == broken_book.columns


def test_reconciliation(spark):
    def feed(rows):
        return spark.createDataFrame([("IF", dt.datetime(2022, 4, 18, 9, 30, s, us), p) for s, us, p in rows],
                                     "instrument string, datetime timestamp_ntz, price double")

    target = feed([(0, 0, 1.0), (1, 0, 2.0), (2, 500000, 3.0), (3, 0, 4.0), (4, 0, 5.0)])
    other = feed([(0, 0, 1.0), (1, 0, 9.0), (2, 0, 3.0), (3, 500000, 9.0), (6, 0, 1.0)])
    report = q.reconcile_report(q.reconcile_feeds(target, other, ["instrument"], ["price"]), ["instrument"]).first()
    assert (report["same_count"], report["different_count"]) == (2, 2)
    assert (report["only_in_target_count"], report["only_in_compare_count"]) == (1, 1)
    assert (report["target_count"], report["compare_count"]) == (5, 5)


def test_fingerprints_see_changed_content(spark):
    ticks = make(spark, GOOD).select("tscode", "time", "volume")
    assert q.content_differences(ticks, ticks).count() == 0
    assert q.content_differences(ticks, ticks.withColumn("volume", F.col("volume") + 1)).count() > 0
