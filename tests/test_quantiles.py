"""Exact quantiles by narrowing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticklane.functions import quantiles as fq

SHARES = [0.0, 0.001, 0.1, 1 / 3, 0.5, 0.77, 0.999, 1.0]


def check(spark, frame, most_rows, reread=False):
    df = spark.createDataFrame(frame).repartition(5)
    found = {row["k"]: row["quantiles"] for row in fq.exact_quantiles(df, "v", SHARES, ["k"], most_rows=most_rows, reread=reread).collect()}
    assert set(found) == set(frame["k"])
    for key, part in frame.groupby("k", dropna=False):
        np.testing.assert_array_equal(found[None if key is None or key != key else key], np.quantile(part["v"], SHARES), err_msg=str(key))


@pytest.mark.parametrize("most_rows", [1, 40, 50_000])
def test_one_huge_key_a_frequent_value_and_outliers(spark, most_rows):
    rng = np.random.default_rng(2)
    huge = np.where(rng.random(20_000) < 0.34, 101.25, rng.integers(10_000, 20_000, 20_000) / 64)
    huge[:4] = [1e300, -1e300, 1e-300, 0.0]
    frame = pd.concat([pd.DataFrame({"k": "huge", "v": huge}), pd.DataFrame({"k": "one", "v": [7.0] * 300}),
                       pd.DataFrame({"k": "signs", "v": rng.integers(-50, 50, 500) / 8}), pd.DataFrame({"k": "pair", "v": [2.0, 1.0]})])
    check(spark, frame, most_rows)


def test_no_range_above_the_bound_is_sorted(spark, monkeypatch):
    """What the last pass may sort is at most most_rows rows a range, except for single values."""
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"k": "a", "v": np.concatenate([rng.integers(0, 1 << 40, 30_000) / 1024, [5.0] * 15_000])})
    seen = []
    kept = fq._holding_ranks

    def watch(*args):
        ranges = kept(*args)
        seen.append(ranges.where("NOT _open AND _low < _high").agg(F.max("_rows")).first()[0] or 0)
        return ranges

    monkeypatch.setattr(fq, "_holding_ranks", watch)
    check(spark, frame, 100, reread=True)
    assert len(seen) > 1 and max(seen) <= 100


def test_nulls_infinities_and_empty_tables(spark):
    inf = float("inf")
    rows = [("a", x) for x in (1.0, None, inf, -inf, 3.0, -0.0)] + [(None, 4.0), (None, 6.0), ("b", None), ("n", float("nan")), ("n", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = {row.k: row.q for row in fq.exact_quantiles(df, "v", [0.0, 0.5, 1.0], ["k"], "q", most_rows=1).collect()}
    assert found["a"] == [-inf, 1.0, inf] and found[None] == [4.0, 5.0, 6.0] and set(found) == {"a", None, "n"}
    assert found["n"][0] == 1.0 and np.isnan(found["n"][2])
    assert fq.exact_quantiles(df.limit(0), "v", [0.5], ["k"]).count() == 0 and fq.exact_quantiles(df.limit(0), "v", [0.5]).count() == 0
    assert fq.exact_quantiles(df.where("k = 'a'"), "v", [0.5, 0.75]).first()[0] == [1.0, 3.0]
