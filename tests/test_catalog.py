import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from check import canonical
from conftest import SF

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
# one query of each kind of plan; check.py runs them all
SAMPLE = ["c058_support_close_three_boll", "d015_total_commission_ratio_change_rate", "d062_large_order_buying_ratio",
          "v15_level_missing", "x04_restore_close_records", "e02_threshold_band_test", "e04_o02_backtest_report",
          "g17_compress_intervals", "t04_fill_future_gaps", "w15_day_window"]


def test_catalog_needs_no_session():
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q) and len(q) > 300"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, capture_output=True)


def test_every_survey_number_has_a_query():
    names = set(entry.queries())
    for letter, count in (("c", 58), ("d", 62)):
        for i in range(1, count + 1):
            assert any(n.startswith(f"{letter}{i:03d}") for n in names), (letter, i)
    for i in range(1, 17):
        assert any(n.startswith(f"i{i:02d}") for n in names)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_sample_equals_sql(spark):
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    for name in SAMPLE:
        ours, theirs = entry.queries()[name](spark, SF).toPandas(), connection.sql(entry.oracle_sql()[name]).df()
        assert sorted(ours.columns) == sorted(theirs.columns), name
        assert canonical(ours) == canonical(theirs), name
    assert entry.entry(spark).count() > 0
